"""Near-duplicate documents by SimHash, with pivot distance tables.

A fingerprint has 64 bits. Documents are linked when their fingerprints differ in at most
``bits`` bits; groups are the connected components of these links.

1. Fingerprints are made per document and reduced to distinct ones, so a thousand copies
   cost one row from there on.
2. Two fingerprints that differ in at most ``bits`` bits agree in all but ``bits`` of the
   ``blocks`` blocks of the 64 bits. Each fingerprint goes to one bucket for every choice of
   ``blocks - bits`` blocks; buckets with one member are dropped.
3. In a bucket every member has its row of Hamming distances to the pivots, which are
   pseudo-random reference fingerprints. By the triangle inequality a pair is discarded as
   soon as one coordinate differs by more than ``bits``; the survivors are verified. Buckets
   with two members are pairs already, and need no further shuffle.
4. Buckets give only as many links as connect their members; links become components.

A bucket with more than ``bucket_rows`` members is cut into parts, and each pair of parts is
a group of its own. No pair is lost by that, and no group grows with the data.
"""

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.components import components
from ledgerlens.session import cut_lineage

# Of the 64-bit hash of a shingle.
SEED = 42
PIVOTS = 32
ROWS_PER_TASK = 1_000_000


@dataclass(frozen=True)
class Rule:
    """words: of a shingle. bits: that linked fingerprints may differ in."""

    words: int = 3
    bits: int = 3
    blocks: int = 6
    bucket_rows: int = 2048


# --- fingerprints ---------------------------------------------------------------------------

# For a byte, its bits as four 16-bit lanes of a word: the lower and the upper half.
_BYTE = np.arange(256, dtype=np.uint64)
_LANES = [
    sum(((_BYTE >> np.uint64(first + i)) & np.uint64(1)) << np.uint64(16 * i) for i in range(4))
    for first in (0, 4)
]
_LANE_ROWS = 65_535


def shingle_hashes(text: bytes, words: int) -> list[int]:
    """XXH64 of each run of ``words`` words; of the whole sequence if there are fewer."""
    found = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not found:
        return []
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        return [digest(b" ".join(found), SEED)]
    joined = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    pairs = zip(starts[: len(found) - words + 1].tolist(), ends[words - 1 :].tolist())
    return [digest(joined[a:b], SEED) for a, b in pairs]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per document the bits set in over half of its hashes; no hashes give zero."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    starts = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
    # Lanes of 16 bits hold at most 65,535 rows, so long documents are summed in slices.
    cuts, owner = [], []
    for i, (start, count) in enumerate(zip(starts.tolist(), counts[full].tolist())):
        for begin in range(start, start + count, _LANE_ROWS):
            cuts.append(begin)
            owner.append(i)
    owner = np.asarray(owner)
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    totals = counts[full].astype(np.int64)
    made = np.zeros(len(full), np.uint64)
    for byte in range(8):
        values = ((hashes >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.int64)
        for half in range(2):
            lanes = np.add.reduceat(_LANES[half][values], cuts)
            for lane in range(4):
                ones = ((lanes >> np.uint64(16 * lane)) & np.uint64(0xFFFF)).astype(np.int64)
                ones = np.add.reduceat(ones, first)
                bit = np.uint64(8 * byte + 4 * half + lane)
                made |= (2 * ones > totals).astype(np.uint64) << bit
    out[full] = made
    return out


def fingerprint_column(text: Column, words: int = 3) -> Column:
    """Fingerprint of a text as a signed long; a missing or empty text gives zero."""

    @F.arrow_udf("long")
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts, counts, done = [], [], []
            held = 0
            for value in batch:
                hashes = shingle_hashes(value.as_py() or b"", words)
                parts.append(np.array(hashes, np.uint64))
                counts.append(len(hashes))
                held += len(hashes)
                if held > 1_000_000:
                    done.append(majority(np.concatenate(parts), np.array(counts)))
                    parts, counts, held = [], [], 0
            if counts:
                done.append(majority(np.concatenate(parts), np.array(counts)))
            made_here = np.concatenate(done) if done else np.zeros(0, np.uint64)
            yield pa.array(made_here.view(np.int64))

    return made(text.cast("binary"))


# --- pairs ----------------------------------------------------------------------------------


def masks(rule: Rule) -> list[int]:
    """Bit masks of every choice of ``blocks - bits`` blocks, as signed longs."""
    edges = [64 * i // rule.blocks for i in range(rule.blocks + 1)]
    single = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(edges)]
    chosen = itertools.combinations(single, rule.blocks - rule.bits)
    return [m - (1 << 64) if m >= 1 << 63 else m for m in map(sum, chosen)]


def pivots(count: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints: pseudo-random, the same for all data."""
    return np.array([xxhash.xxh64_intdigest(b"pivot %d" % i, SEED) for i in range(count)],
                    np.uint64)


def spanning_links(group: np.ndarray, value: np.ndarray, bits: int) -> tuple:
    """Links that connect the values within ``bits`` bits of each other in each group.

    ``group`` is sorted. Rows are compared with the row ``shift`` places on while that is
    in the same group.
    """
    n = len(value)
    table = np.bitwise_count(value[:, None] ^ pivots()[None, :]).astype(np.int8)
    parent = np.arange(n)
    alive = np.arange(n)
    for shift in range(1, n):
        alive = alive[alive + shift < n]
        alive = alive[group[alive] == group[alive + shift]]
        if not len(alive):
            break
        left = alive
        for some in range(0, PIVOTS, 8):
            far = np.abs(table[left, some : some + 8] - table[left + shift, some : some + 8])
            left = left[far.max(axis=1) <= bits]
        left = left[np.bitwise_count(value[left] ^ value[left + shift]) <= bits]
        a, b = left, left + shift
        while len(a):  # join the trees of both ends until every link is inside one tree
            a, b = _roots(parent, a), _roots(parent, b)
            open_ = a != b
            a, b = np.maximum(a[open_], b[open_]), np.minimum(a[open_], b[open_])
            np.minimum.at(parent, a, b)
    root = _roots(parent, np.arange(n))
    linked = np.flatnonzero(root != np.arange(n))
    return value[linked], value[root[linked]]


def _roots(parent: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    while True:
        up = parent[nodes]
        if np.array_equal(up, nodes):
            return nodes
        nodes = up


def _compare(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple = (np.zeros(0, np.int64), np.zeros(0, np.uint64))

        def links(group, value):
            a, b = spanning_links(group, value, bits)
            pairs = np.unique(np.stack([a.view(np.int64), b.view(np.int64)]), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(p) for p in pairs], ["a", "b"])

        for batch in batches:
            group = np.concatenate([kept[0], batch.column(0).to_numpy()])
            value = np.concatenate(
                [kept[1], batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if not len(group):
                continue
            # The last group may go on in the next batch.
            cut = int(np.searchsorted(group, group[-1]))
            kept = (group[cut:], value[cut:])
            yield links(group[:cut], value[:cut])
        if len(kept[0]):
            yield links(*kept)

    return run


def fingerprint_links(values: DataFrame, column: str, rule: Rule = Rule()) -> DataFrame:
    """Links (a, b) that connect all distinct values within ``rule.bits`` bits.

    ``values`` is a written table of distinct fingerprints without nulls. Each becomes a row
    for every table, so the few files it comes from are spread over more tasks first.
    """
    tasks = 1 + values.count() * len(masks(rule)) // ROWS_PER_TASK
    chosen = F.array(*[
        F.struct(F.lit(i).cast("short").alias("_table"),
                 F.col(column).bitwiseAND(F.lit(mask)).alias("_bucket"))
        for i, mask in enumerate(masks(rule))
    ])
    rows = values.repartition(tasks).select(F.col(column).alias("_value"), F.inline(chosen))
    shared = cut_lineage(
        rows.groupBy("_table", "_bucket")
        .agg(F.count(F.lit(1)).alias("_rows"), F.min("_value").alias("a"),
             F.max("_value").alias("b"))
        .filter("_rows > 1"),
        "buckets",
    )
    # Most buckets that are shared at all have two members, which the aggregate holds.
    pairs = _near_pairs(shared.filter("_rows = 2").select("a", "b"), rule.bits)
    parts = F.ceil(F.col("_rows") / rule.bucket_rows).cast("int")
    sizes = shared.filter("_rows > 2").select("_table", "_bucket", parts.alias("_parts"))
    own = F.pmod(F.xxhash64("_value"), F.col("_parts")).cast("int")
    others = F.sequence(F.lit(0), F.col("_parts") - 1)
    groups = F.transform(others, lambda other: F.xxhash64(
        "_table", "_bucket", F.least(own, other), F.greatest(own, other)))
    grouped = rows.join(sizes, ["_table", "_bucket"]).select(
        F.explode(groups).alias("_group"), "_value")
    ordered = grouped.repartition("_group").sortWithinPartitions("_group")
    return pairs.unionByName(ordered.mapInArrow(_compare(rule.bits), "a long, b long"))


def _near_pairs(pairs: DataFrame, bits: int) -> DataFrame:
    """Pairs that no pivot discards and that are within ``bits`` bits."""
    signed = F.array(*[F.lit(int(p)) for p in pivots().view(np.int64)])
    apart = F.exists(signed, lambda p: F.abs(
        F.bit_count(F.col("a").bitwiseXOR(p)) - F.bit_count(F.col("b").bitwiseXOR(p))) > bits)
    return pairs.filter(~apart).filter(
        F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)


def group(marked: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, fingerprint, component_id and root of a written table with the first two.

    The root is the smallest fingerprint of a component, as a signed long; every component
    has one, even if none of its rows has a doc_id.
    """
    distinct = cut_lineage(
        marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "distinct")
    links = fingerprint_links(distinct.select("fingerprint"), "fingerprint", rule)
    roots = components(links, "a", "b")
    rooted = distinct.join(
        roots, F.col("fingerprint") == F.col("node"), "left"
    ).select("fingerprint", "first_id", F.coalesce("root", "fingerprint").alias("root"))
    rooted = cut_lineage(rooted, "roots")
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id")).hint("rebalance")
    named = cut_lineage(
        rooted.join(least, "root").select("fingerprint", "component_id", "root"), "named")
    return marked.join(named, "fingerprint").select(
        "doc_id", "fingerprint", "component_id", "root")


def near_duplicates(docs: DataFrame, rule: Rule = Rule(), doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """doc_id, fingerprint (long), component_id (smallest doc_id reachable), root per row.

    A missing or empty text has fingerprint zero and is linked like any other. Repeated
    rows come back repeated, rows without a doc_id take part but never name a component
    (it is null if no member has an id), other columns are left alone, and an empty table
    gives an empty one.
    """
    return group(cut_lineage(
        docs.select(F.col(doc_id).alias("doc_id"),
                    fingerprint_column(F.col(text), rule.words).alias("fingerprint")),
        "fingerprints"), rule)
