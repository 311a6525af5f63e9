"""Byte-pair encoding and decoding as streaming transducers.

Merges are applied by rank, so what follows can change how a word's beginning is cut, but
only so far back. :func:`lookahead` computes that distance from the list of merges: once so
many symbols are known behind a token's end, nothing can change the token any more. The
encoder therefore holds a window of bounded size, emits tokens as soon as they are stable,
and goes on from the last of them, whatever the length of the word. Decoding sends the
bytes of the tokens through an incremental state machine from bytes to text.

Model files are those of the public tokenizers library: pairs of symbols by rank, a suffix
for the end of a word, composed and lower-cased text, words by a pattern.
"""

import codecs
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

# The pieces of a text that are encoded one by one; the second form is for
# lower-case ASCII text, where it finds the same.
WORDS = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
ASCII_WORDS = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\x09-\x0d\x20a-z0-9]+")
SPACE = re.compile(r"[\x20\x09-\x0d]")


# Marks that a later version of Unicode orders in another way.
REORDERED = "\u1df6\U0001e4ec\U0001e4ed"


def _unassigned() -> re.Pattern:
    """Characters on which Python's Unicode tables and newer ones may differ."""
    runs, start = [REORDERED], None
    for code in range(0x110001):
        free = code < 0x110000 and unicodedata.category(chr(code)) == "Cn"
        if free and start is None:
            start = code
        elif not free and start is not None:
            runs.append(f"\\U{start:08x}-\\U{code - 1:08x}")
            start = None
    return re.compile(f"[{''.join(runs)}]")

PIECE_CHARS = 1 << 16
CACHED_WORDS = 100_000
CACHED_SYMBOLS = 64
CHUNK = 1 << 20


def byte_alphabet() -> list[str]:
    """A printable character for each byte: its own where it has one, else from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


def lookahead(merges: Iterable[tuple[str, str]], sizes: dict[str, int]) -> int:
    """How many symbols behind a token's end make it final.

    Compare a word with the same word continued. Both are merged alike, by rank, until the
    continued one merges across the end; from then on they differ right of some place, the
    edge, at which both have a boundary. A later merge, of higher rank, moves the edge left
    only if its right part is the token at the edge, by the size of its left part, and
    leaves the merged token at the edge in one of the two and its left part in the other.
    A merge with its left part at the edge only changes the token there. ``reach`` of a
    token is how far the edge can still move with that token at it; going through the
    merges from the highest rank down it needs higher ranks only, so one pass gives it.
    """
    reach: dict[str, int] = {}
    most = 0
    for left, right in reversed(list(merges)):
        whole = left + right
        moved = sizes[left] + max(reach.get(whole, 0), reach.get(left, 0))
        held = reach.get(whole, 0)
        most = max(most, moved)
        reach[right] = max(reach.get(right, 0), moved)
        reach[left] = max(reach.get(left, 0), held)
    return most


class Encoder:
    """Text to ids; words are kept by a cache of bounded size."""

    def __init__(self, model: str):
        parts = json.loads(model)
        bpe = parts["model"]
        self.vocab: dict[str, int] = bpe["vocab"]
        self.suffix: str = bpe["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in bpe["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(merges)}
        self.alphabet = byte_alphabet()
        sizes = {c + end: 1 for c in self.alphabet for end in ("", self.suffix)}
        for left, right in merges:
            if left not in sizes or right not in sizes:
                raise ValueError(f"the merge {left!r} {right!r} comes before its parts")
            sizes[left + right] = sizes[left] + sizes[right]
        self.lookahead = lookahead(merges, sizes)
        self.sizes = sizes
        special = {t["content"]: t["id"] for t in parts["added_tokens"]}
        self.special = special
        longest_first = sorted(map(re.escape, special), key=len, reverse=True)
        self.special_pattern = re.compile(f"({'|'.join(longest_first)})") if special else None
        self.cache = _Words(self)
        self.model = model
        self.unassigned = _unassigned()
        self.cutter: Tokenizer | None = None

    def merge(self, symbols: list[str]) -> list[str]:
        """Merges by rank, leftmost first; the symbols are at most a window."""
        rank, none, parts = self.ranks.get, len(self.ranks), list(symbols)
        ranks = [rank(pair, none) for pair in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = rank((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = rank((parts[i], parts[i + 1]), none)
        return parts

    def symbols(self, word: str, step: int = 1 << 10) -> Iterator[str]:
        """A symbol for each byte of a word."""
        for start in range(0, len(word), step):
            for byte in word[start : start + step].encode("utf-8", "replace"):
                yield self.alphabet[byte]

    def tokens(self, word: str, window: int | None = None) -> Iterator[str]:
        return self.stable(self.symbols(word), window)

    def stable(self, symbols: Iterable[str], window: int | None = None) -> Iterator[str]:
        """Tokens of a word, each as soon as nothing that follows can change it."""
        window = window or 4 * self.lookahead
        held: list[str] = []
        for symbol in symbols:
            held.append(symbol)
            # The last symbol may be the one that carries the suffix.
            if len(held) > self.lookahead + window:
                known = held[:-1]
                done = 0
                for token in self.merge(known):
                    size = self.sizes[token]
                    if done + size > len(known) - self.lookahead:
                        break
                    done += size
                    yield token
                held = held[done:]
        if held:
            held[-1] += self.suffix
            yield from self.merge(held)

    def ids_of(self, word: str) -> bytes:
        if len(word) > CACHED_SYMBOLS:
            return np.fromiter(map(self.vocab.__getitem__, self.tokens(word)), np.int32).tobytes()
        # A short word is less than a window: all of it is known at once.
        symbols = list(word) if word.isascii() and word.isprintable() else [
            self.alphabet[byte] for byte in word.encode("utf-8", "replace")]
        symbols[-1] += self.suffix
        return array("i", map(self.vocab.__getitem__, self.merge(symbols))).tobytes()

    def pieces(self, text: str) -> Iterator[str]:
        """Cuts in front of white space, across which nothing is composed, matched or merged."""
        start = 0
        while len(text) - start > PIECE_CHARS:
            cut = SPACE.search(text, start + PIECE_CHARS)
            if not cut:
                break
            yield text[start : cut.start()]
            start = cut.start()
        yield text[start:]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text."""
        out = []
        for piece in self.pieces(text):
            parts = [piece]
            if self.special_pattern and "<" in piece:
                parts = self.special_pattern.split(piece)
            for i, part in enumerate(parts):
                if i % 2:
                    out.append(np.int32(self.special[part]).tobytes())
                elif part.isascii():
                    out.append(self.words(ASCII_WORDS.findall(part.lower())))
                elif self.has_unassigned(part):
                    out.extend(map(self.ids_of_symbols, self.cut_by_library(part)))
                else:
                    # A capital sigma is lowered the same way wherever it stands.
                    plain = unicodedata.normalize("NFC", part).replace("Σ", "σ")
                    out.append(self.words(WORDS.findall(plain.lower())))
        return np.frombuffer(b"".join(out), np.int32)

    def has_unassigned(self, text: str) -> bool:
        try:
            text.encode("latin-1")  # quick, and all of these are assigned
            return False
        except UnicodeEncodeError:
            return self.unassigned.search(text) is not None

    def cut_by_library(self, text: str) -> Iterator[list[str]]:
        """Symbols of the words of a text with characters newer than Python's tables.

        Whether such a character is a letter is asked of the tokenizers library.
        """
        if self.cutter is None:
            self.cutter = Tokenizer.from_str(self.model)
        normal = self.cutter.normalizer.normalize_str(text)
        for word, _ in self.cutter.pre_tokenizer.pre_tokenize_str(normal):
            yield list(word)

    def ids_of_symbols(self, symbols: list[str]) -> bytes:
        found = self.stable(symbols)
        return array("i", map(self.vocab.__getitem__, found)).tobytes()

    def words(self, words: list[str]) -> bytes:
        return b"".join(map(self.cache.__getitem__, words))


class _Words(dict):
    """Ids by word, in two generations of bounded size; long words are not kept."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word) or self.encoder.ids_of(word)
        if len(word) <= CACHED_SYMBOLS:
            if len(self) >= CACHED_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Decoder:
    """Ids to text, some ids at a time; ids that the model does not have are left out.

    ``plain`` gives the bytes that were encoded, with a space after each word. Otherwise
    tokens are written as the model file writes them, with a space between two.
    """

    def __init__(self, model: str, plain: bool = False):
        parts = json.loads(model)
        suffix = parts["model"]["end_of_word_suffix"] or ""
        alphabet = {c: b for b, c in enumerate(byte_alphabet())}
        self.plain = plain
        self.bytes: dict[int, bytes] = {}
        for token, i in parts["model"]["vocab"].items():
            if plain:
                word = token.removesuffix(suffix) if suffix else token
                end = b" " if len(word) < len(token) else b""
                self.bytes[i] = bytes(alphabet[c] for c in word) + end
            else:
                self.bytes[i] = token.encode()
        for token in parts["added_tokens"]:
            self.bytes[token["id"]] = token["content"].encode()

    def decode(self, ids, step: int = 1 << 16) -> str:
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        between, get, out = b"" if self.plain else b" ", self.bytes.get, []
        first = True
        for start in range(0, len(ids), step):
            known = [b for b in map(get, ids[start : start + step]) if b is not None]
            if known:
                out.append(machine.decode((b"" if first else between) + between.join(known)))
                first = False
        out.append(machine.decode(b"", True))
        return "".join(out)


def load(spark: SparkSession, path: str):
    """The model file as a broadcast; its size is that of the vocabulary.

    What a worker builds from it is kept in the dictionary, for the tasks that follow.
    """
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast({"model": file.read()})


def _lists(found: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, found)])
    flat = np.concatenate(found) if found else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def _chunks(batch: pa.Array, cost=len) -> Iterator[list]:
    """Values of a batch, some at a time, so that results are sent on before all are made."""
    held, size = [], 0
    for value in batch:
        value = value.as_py()
        held.append(value)
        size += cost(value or ())
        if size > CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def _encoder(model) -> Encoder:
    held = model.value
    if "encoder" not in held:
        held["encoder"] = Encoder(held["model"])
    return held["encoder"]


def _decoder(model, plain: bool) -> Decoder:
    held = model.value
    if ("decoder", plain) not in held:
        held["decoder", plain] = Decoder(held["model"], plain)
    return held["decoder", plain]


def encode_column(text: Column, model) -> Column:
    """Ids of a text, without special tokens around it; a missing text has no ids.

    The strings of special tokens inside a text become their ids.
    """

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = _encoder(model).encode
        for batch in batches:
            for texts in _chunks(batch):
                yield _lists([encode(text or "") for text in texts])

    return ids(text)


def decode_column(ids: Column, model, plain: bool = False) -> Column:
    """Text of ids; missing ids give a missing text."""

    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decode = _decoder(model, plain).decode
        for batch in batches:
            for lists in _chunks(batch):
                yield pa.array([ids if ids is None else decode(ids) for ids in lists],
                               pa.string())

    return texts(ids)


def coded_column(text: Column, model, plain: bool = False) -> Column:
    """Struct of the ids of a text and of the text that they decode to, in one pass."""

    @F.arrow_udf("struct<ids: array<int>, decoded: string>")
    def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode, decode = _encoder(model).encode, _decoder(model, plain).decode
        for batch in batches:
            for texts in _chunks(batch):
                ids = [encode(text or "") for text in texts]
                back = pa.array([decode(found.tolist()) for found in ids], pa.string())
                yield pa.StructArray.from_arrays([_lists(ids), back], ["ids", "decoded"])

    return coded(text)
