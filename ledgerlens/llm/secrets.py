"""Secrets in texts: fixed patterns, and values that would be hard to guess.

The patterns find assignments to names like password or token, cloud access keys and long
hexadecimal strings. Beyond them, values in further credential contexts are judged by what
it takes to guess them: the cheapest way to cut a value into dictionary words, dates,
repeats, keyboard walks and brute-force spans, found by dynamic programming. Costs are
decimal logarithms of guesses and add up over the segments; repeats and walks are charged
by the character, so the program keeps a fixed number of states and takes linear time.
"""

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The base patterns with the shortest find that counts (of the last group),
# in the order in which finds at the same place are listed.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "guess")
# Texts that are sent on at once.
CHUNK = 500

# Names in front of a value that is judged by its guess cost. A scheme of an authorization
# header may come between, if what follows it is no name with a value of its own.
_NAMED = (
    r"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|"
    r"private[_-]?key|client[_-]?key|auth(?:orization)?|credentials?|bearer)"
    r"[\"']?[\x20\t]*(?::=|=>|[:=])")
CONTEXT = re.compile(
    _NAMED + r"[\x20\t]*[\"']?(?:(?:bearer|basic|token)[\x20\t]+[\"']?(?!" + _NAMED + r"))?"
    r"([^\s\"'<>,;]+)",
    re.IGNORECASE | re.ASCII)

# Words by how early a guesser tries them.
COMMON = (
    "password admin welcome login letmein secret master dragon monkey shadow sunshine princess "
    "football baseball superman batman trustno iloveyou abc pass test guest root user default "
    "changeme qwerty hello freedom whatever michael jordan hunter ranger buster soccer hockey "
    "killer george andrew charlie thomas jennifer jessica daniel ashley matthew robert summer "
    "winter spring autumn january february march april may june july august september october "
    "november december monday tuesday wednesday thursday friday saturday sunday love angel "
    "tiger lion eagle computer internet server database system manager service public private "
    "access token key account money company office home house family friend baby star silver "
    "gold diamond orange banana apple cheese coffee pepper ginger cookie flower rose blue red "
    "green black white yellow purple magic music guitar piano dance game player winner london "
    "paris berlin madrid america canada example sample demo temp"
).split()

KEYBOARD = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")


def _neighbours() -> dict[str, frozenset[str]]:
    """Keys side by side, and below each other in slanted rows."""
    found: dict[str, set[str]] = {}
    at = {(y, x): key for y, row in enumerate(KEYBOARD) for x, key in enumerate(row)}
    for (y, x), key in at.items():
        beside = [(y, x - 1), (y, x + 1), (y + 1, x), (y + 1, x - 1)]
        if y == 0:  # the first row starts one key further left
            beside[2:] = [(1, x - 1), (1, x - 2)]
        for place in beside:
            if place in at:
                found.setdefault(key, set()).add(at[place])
                found.setdefault(at[place], set()).add(key)
    return {key: frozenset(keys) for key, keys in found.items()}


NEIGHBOURS = _neighbours()
DIGITS = frozenset("0123456789")


@dataclass(frozen=True)
class Cost:
    """Decimal logarithms of guesses."""

    segment: float = math.log10(5)  # which kind of segment comes next
    repeat: float = 0.1  # one character more of a repeat
    straight: float = 0.2  # one key more of a walk in the same direction
    turn: float = math.log10(4.6)  # or in another
    year: float = math.log10(150)
    date: float = math.log10(365.25 * 150)
    capital: float = math.log10(2)


def alphabet(char: str) -> float:
    """Brute force of one character: the size of its class."""
    if char in DIGITS:
        return 1.0
    if "a" <= char <= "z" or "A" <= char <= "Z":
        return math.log10(26)
    return math.log10(33) if char < "\x7f" else 2.0


def date_cost(text: str, cost: Cost) -> float | None:
    """Of a year, or a day written with eight digits or with separators."""
    if len(text) == 4 and text.isdigit():
        return cost.year if 1900 <= int(text) < 2050 else None
    digits = text
    if len(text) == 10:
        a, b = (4, 7) if text[4] in "-/." else (2, 5)
        if text[a] != text[b] or text[a] not in "-/.":
            return None
        digits = text[:a] + text[a + 1 : b] + text[b + 1 :]
    if len(digits) != 8 or not (digits.isascii() and digits.isdigit()):
        return None
    forms = ((digits[:4], digits[4:6], digits[6:]), (digits[4:], digits[2:4], digits[:2]),
             (digits[4:], digits[:2], digits[2:4]))
    for year, month, day in forms:
        if 1900 <= int(year) < 2050 and 1 <= int(month) <= 12 and 1 <= int(day) <= 31:
            return cost.date
    return None


def step(before: str, char: str) -> str | None:
    """Direction from one character to the next in a walk; None if they are not beside."""
    a, b = before.lower(), char.lower()
    if b in NEIGHBOURS.get(a, ()):
        for row in KEYBOARD:
            if a in row and b in row:
                return "right" if row.index(b) > row.index(a) else "left"
        return "slant"
    if a.isascii() and b.isascii() and a.isalnum() and b.isalnum() and abs(ord(a) - ord(b)) == 1:
        return "up" if ord(b) > ord(a) else "down"
    return None


def guess_cost(value: str, words: dict[str, int], longest: int, cost: Cost = Cost()) -> float:
    """Least decimal logarithm of guesses over all ways to cut ``value`` into segments.

    ``best`` is of all segmentations of the characters so far; ``brute``, ``repeat`` and
    ``walk`` are of those that end in an open segment of that kind (three characters at
    least for the latter two). Earlier values of ``best`` are kept as far back as a word or
    date can reach.
    """
    free = math.inf
    reach = max(longest, 10)
    kept = [0.0]  # best at the last places, newest last
    brute = repeat = walk = free
    lowered = value.lower() if len(value.lower()) == len(value) else value
    for i, char in enumerate(value):
        size, best = alphabet(char), kept[-1]
        new_brute = min(best + cost.segment, brute) + size
        same = i >= 1 and value[i - 1] == char
        new_repeat = repeat + cost.repeat if same else free
        if same and i >= 2 and value[i - 2] == char:
            new_repeat = min(new_repeat, kept[-3] + cost.segment + size + 2 * cost.repeat)
        way = step(value[i - 1], char) if i else None
        last = step(value[i - 2], value[i - 1]) if i >= 2 else None
        price = cost.straight if way == last else cost.turn
        new_walk = walk + price if way else free
        if way and last:
            start = alphabet(value[i - 2]) + cost.turn
            new_walk = min(new_walk, kept[-3] + cost.segment + start + price)
        least = min(new_brute, new_repeat, new_walk)
        for length in range(1, min(i + 1, reach) + 1):
            a = i + 1 - length
            if length <= longest and (rank := words.get(lowered[a : i + 1])):
                part = value[a : i + 1]
                extra = 0.0 if part == lowered[a : i + 1] else cost.capital
                least = min(least, kept[-length] + cost.segment + math.log10(rank) + extra)
            if length in (4, 8, 10):
                price = date_cost(value[a : i + 1], cost)
                if price is not None:
                    least = min(least, kept[-length] + cost.segment + price)
        brute, repeat, walk = new_brute, new_repeat, new_walk
        kept.append(least)
        del kept[: -reach - 1]
    return kept[-1]


@dataclass(frozen=True)
class Rule:
    """A value is a secret from ``guesses`` (decimal logarithm) on, if not too short."""

    guesses: float = 10.0
    least: int = 6
    words: tuple[str, ...] = tuple(COMMON)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns; per kind leftmost and without overlap."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text)
             if m.end() - m.start(2) >= ASSIGN_LEAST]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)
              if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def _covered(start: int, end: int, spans: list[tuple[int, int, int]]) -> bool:
    """Whether spans, of base_spans, leave nothing of a value uncovered."""
    for first, _, last in sorted(spans):
        if first <= start:
            start = max(start, last)
    return start >= end


def find(text: str, rule: Rule, words: dict[str, int], longest: int) -> list[tuple]:
    """(kind, start, end, guesses) by start, then kind; guesses of values, else None.

    Values that base spans cover wholly add no span. One that reaches beyond them is a span
    of its own whatever its cost, as a part of it is a secret already.
    """
    base = base_spans(text)
    spans = {(start, kind): (end, None) for start, kind, end in base}
    for match in CONTEXT.finditer(text):
        start, end = match.span(1)
        guesses = guess_cost(match[1], words, longest)
        covering = [s for s in base if s[0] < end and start < s[2]]
        for s in covering:
            if s[1] == 0:
                spans[s[:2]] = (s[2], guesses)
        hard = end - start >= rule.least and guesses >= rule.guesses
        if not _covered(start, end, covering) if covering else hard:
            spans[start, 3] = (end, guesses)
    return [(KINDS[kind], start, end, guesses)
            for (start, kind), (end, guesses) in sorted(spans.items())]


def _finder(rule: Rule):
    """Spans of a text, with the words of the rule ready to be looked up."""
    words = {word: rank for rank, word in enumerate(dict.fromkeys(rule.words), 1)}
    longest = max(map(len, words), default=0)
    return lambda text: find(text, rule, words, longest)


def span_column(text: Column, rule: Rule = Rule()) -> Column:
    """Array of (kind, start, end, guesses); places count code points, the end is exclusive.

    A missing or empty text has no spans.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()),
                               ("end", pa.int64()), ("guesses", pa.float64())]))

    @F.arrow_udf("array<struct<kind:string,start:bigint,end:bigint,guesses:double>>")
    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        found = _finder(rule)
        names = ("kind", "start", "end", "guesses")
        for batch in batches:
            rows = [[dict(zip(names, s)) for s in found(value.as_py() or "")] for value in batch]
            yield pa.array(rows, kind)

    return spans(text)


def redacted_column(text: Column, rule: Rule = Rule(), mark: str = "[SECRET]") -> Column:
    """``text`` with each span, or run of spans that touch or overlap, replaced by ``mark``.

    A missing text stays missing.
    """
    @F.arrow_udf("string")
    def redacted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        found = _finder(rule)
        for batch in batches:
            for first in range(0, len(batch), CHUNK):  # sent on before all are made
                texts = [value.as_py() for value in batch.slice(first, CHUNK)]
                yield pa.array(
                    [t if t is None else redact(t, found(t), mark) for t in texts], pa.string())

    return redacted(text)


def redact(text: str, spans: list[tuple], mark: str) -> str:
    """``text`` with the (kind, start, end, guesses) of ``spans`` replaced."""
    out, done = [], 0
    for i, (_, start, end, _) in enumerate(sorted(spans, key=lambda s: s[1])):
        if i == 0 or start > done:
            out += [text[done:start], mark]
        done = max(done, end)
    return "".join([*out, text[done:]])
