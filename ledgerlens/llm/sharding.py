"""Shards by a hierarchical weighted hash tree.

A row descends from the root over region and rack to a shard. At each node every child
draws -ln(u) / weight, where u is a hash of the row's key and the child's name, and the
smallest draw wins. A child wins in proportion to its weight, and a change of weight moves
rows only to or from the child that changed, so movement stays in the subtrees whose
weights change. A tree grows at its root: every added shard is a region of its own beside the
ones that are there, whose weights stay, so rows move only into the added shard.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import text_or_empty
from ledgerlens.llm.prefix import ROWS_PER_RANGE, before
from ledgerlens.session import cut_lineage

SEED = 11


@dataclass(frozen=True)
class Node:
    """A shard (with its number) or an inner node; weights above zero."""

    name: str
    weight: float = 1.0
    shard: int | None = None
    children: tuple["Node", ...] = ()


def inner(name: str, children: list[Node]) -> Node:
    return Node(name, sum(child.weight for child in children), None, tuple(children))


def tree(weights: list[float], per_rack: int = 2, racks: int = 2) -> Node:
    """Shards in racks in regions, filled in the order of their numbers.

    This is how a tree begins. A tree of more weights is another tree, in which rows move
    among the old shards too: use :func:`grow` for shards that come later.
    """
    shards = [Node(f"shard {i}", w, i) for i, w in enumerate(weights) if w > 0]
    groups: dict[tuple[int, int], list[Node]] = {}
    for node in shards:
        rack = node.shard // per_rack
        groups.setdefault((rack // racks, rack), []).append(node)
    regions: dict[int, list[Node]] = {}
    for (region, rack), members in groups.items():
        regions.setdefault(region, []).append(inner(f"rack {rack}", members))
    return inner("root", [inner(f"region {r}", members) for r, members in regions.items()])


def numbers(node: Node) -> list[int]:
    """Numbers of the shards of a tree."""
    if node.shard is not None:
        return [node.shard]
    return [number for child in node.children for number in numbers(child)]


def grow(root: Node, weights: list[float]) -> Node:
    """The tree with a shard more for each weight, numbered on; each is a region of its own."""
    first = max(numbers(root)) + 1
    added = [inner(f"region of shard {first + i}", [Node(f"shard {first + i}", weight, first + i)])
             for i, weight in enumerate(weights)]
    return inner("root", [*root.children, *added])


def draw(key: Column, node: Node) -> Column:
    """Exponential draw of a node for a key; the smallest of several wins."""
    mixed = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.lit(node.name), key), 11)
    return -F.log((mixed + 0.5) / float(1 << 53)) / node.weight


def descend(key: Column, node: Node) -> Column:
    """Number of the shard that a key reaches from ``node``."""
    if node.shard is not None:
        return F.lit(node.shard)
    if len(node.children) == 1:
        return descend(key, node.children[0])
    draws = [F.struct(draw(key, child).alias("draw"), F.lit(i).alias("child"))
             for i, child in enumerate(node.children)]
    won = F.least(*draws)["child"]
    chosen = F.when(won == 0, descend(key, node.children[0]))
    for i, child in enumerate(node.children[1:], 1):
        chosen = chosen.when(won == i, descend(key, child))
    return chosen


def shards(docs: DataFrame, now: Node, grown: Node, doc_id: str = "doc_id", text: str = "text",
           rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and grown_shard of every row.

    The shard depends on the id and the tree alone; a missing id is a key like any other.
    Slots number the rows of a shard from 0 without gaps, by a hash of id and text. A
    missing text has size 1 and the checksum of empty text; rows that are equal get slots
    in any order; an empty table gives an empty one.
    """
    content = text_or_empty(text).cast("binary")
    key = F.xxhash64(F.lit(SEED), F.col(doc_id))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(content) + 1).cast("long").alias("size"),
        F.crc32(content).alias("text_crc32"),
        descend(key, now).cast("int").alias("shard"),
        descend(key, grown).cast("int").alias("grown_shard"),
    )
    mixed = F.xxhash64("doc_id", "text_crc32", "size").alias("_key")
    rows = cut_lineage(rows.select("*", mixed), "shards")
    placed = before(rows, "shard", "_key", ["doc_id", "text_crc32", "size"], F.lit(1),
                    rows_per_range)
    return placed.select("doc_id", "size", "text_crc32", "shard",
                         F.col("_before").alias("slot"), "grown_shard")
