"""Shards by a hierarchical weighted hash tree.

A document descends from the root through regions and racks to a shard. At each
node every child draws ``-ln(u) / weight``, with ``u`` hashed from the
document's id and the child's path and the weight that of all its shards, and
the least draw wins: a child is chosen in proportion to its weight. Only the
children of the nodes on the way draw, so a document costs fan-out times depth
draws, whatever the number of shards.

A draw depends on nothing but its child. Where a weight changes, documents move
only into or out of the subtrees whose weights change. A shard that is added
(``grow``) opens a subtree of its own at the top: no other weight changes, so it
takes documents only into itself. Subtrees that have been added one by one are
folded into racks by planning a new tree, which moves documents again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from fernweft.llm.common import id_hash
from fernweft.materialize import materialize
from fernweft.operators.order import places

NODES = "array<struct<shard:int,children:array<struct<path:string,weight:double,node:int>>>>"


@dataclass(frozen=True)
class Node:
    """A region, rack or shard. Leaves bear a shard number and a weight."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int | None = None
    weight: float = field(default=1.0)

    def leaves(self, path: str = "", places: tuple[int, ...] = ()) -> Iterator[tuple[str, Node, tuple[int, ...]]]:
        """Path, node and place (child number at each level) of every shard."""
        if not self.children:
            yield path, self, places
        for i, c in enumerate(self.children):
            yield from c.leaves(f"{path}/{c.name}", (*places, i))

    def shards(self) -> int:
        return sum(1 for _ in self.leaves())

    def total(self) -> float:
        """Weight of all shards below."""
        return sum(c.total() for c in self.children) if self.children else self.weight

    def depth(self) -> int:
        return 1 + max(c.depth() for c in self.children) if self.children else 0

    def most_draws(self) -> int:
        """Draws of a document at most: children of the nodes on its way."""
        return len(self.children) + max(c.most_draws() for c in self.children) if self.children else 0


def shard_tree(shards: int, per_rack: int = 8, racks: int = 8) -> Node:
    """Equal shards, filled rack by rack and region by region. Shard n is in the
    same rack and region under every count of shards."""
    leaves = [Node(f"shard{n}", shard=n) for n in range(shards)]
    parts = [Node(f"rack{k}", tuple(leaves[at : at + per_rack])) for k, at in enumerate(range(0, shards, per_rack))]
    tops = [Node(f"region{k}", tuple(parts[at : at + racks])) for k, at in enumerate(range(0, len(parts), racks))]
    return Node("root", tuple(tops))


def grow(tree: Node, weight: float = 1.0) -> Node:
    """The tree with one shard more, in a region and rack of its own."""
    n = 1 + max((leaf.shard for _, leaf, _ in tree.leaves()), default=-1)
    return Node(tree.name, (*tree.children, Node(f"region-of-{n}", (Node("rack0", (Node(f"shard{n}", shard=n, weight=weight),)),))))


def draw(key: Column, path: Column, weight: Column) -> Column:
    """A child's draw for a document: exponential with the child's weight."""
    bits = F.shiftrightunsigned(F.xxhash64(key, path), 11)
    return -F.log((bits.cast("double") + 0.5) / float(1 << 53)) / weight


def table_of(tree: Node) -> list[dict]:
    """Nodes by number, the root first; a shard's only child is itself, so that
    a descent may go on below it."""
    rows: list[dict] = []

    def number(node: Node, path: str) -> int:
        at = len(rows)
        rows.append({"shard": node.shard, "children": [{"path": path, "weight": 1.0, "node": at}]})
        if node.children:
            paths = [f"{path}/{c.name}" for c in node.children]
            rows[at]["children"] = [{"path": p, "weight": c.total(), "node": number(c, p)} for p, c in zip(paths, node.children)]
        return at

    number(tree, "")
    return rows


def descend(tree: Node, key: Column) -> Column:
    """The shard that ``key`` reaches. Equal draws go to the child that is first
    in the tree. The tree is one constant, and the expression has one step for
    each of its levels."""
    nodes = F.from_json(F.lit(json.dumps(table_of(tree))), NODES)
    at = F.lit(0)
    for _ in range(tree.depth()):
        drawn = F.transform(F.get(nodes, at)["children"], lambda c: F.struct(draw(key, c["path"], c["weight"]).alias("draw"), c["node"].alias("node")))
        at = F.array_min(drawn)["node"]
    return F.get(nodes, at)["shard"]


def assign(docs: DataFrame, tree: Node, grown: Node | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and slot of each row; one output row for each input row.

    Columns ``doc_id, size`` (UTF-8 bytes and one), ``text_crc32, shard, slot``
    and ``grown_shard`` (shard under the tree ``grown``, else null). Slots
    number the rows of a shard from 0 without gaps, in the order of a hash of
    the id, then id, size and checksum; rows equal in all of these are
    interchangeable.

    A null text has no bytes: size 1, checksum 0. Null ids count as one id. A
    repeated id, be it that of most rows, is dealt over many tasks.
    Repeated rows go to one shard and get slots of their own. Long texts are
    read whole, for their size and checksum, and never shuffled. An empty table
    gives no rows. Other columns are not read.
    """
    content = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    key = F.col("doc_id")
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(content) + F.lit(1)).cast("long").alias("size"),
        F.crc32(content).alias("text_crc32"),
    )
    placed = materialize(
        rows.select(
            "*",
            descend(tree, key).alias("shard"),
            (descend(grown, key) if grown else F.lit(None).cast("int")).alias("grown_shard"),
            id_hash(key, "slot:").alias("place"),
        ),
        "shards",
    )
    # One order of all rows: each shard's begins where its first row stands.
    order = [F.col("shard"), F.col("place"), F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("text_crc32")]
    ordered = materialize(places(placed, order, "at"), "shard-order")
    begins = ordered.groupBy("shard").agg(F.min("at").alias("begin")).hint("broadcast")  # one row a shard
    numbered = ordered.join(begins, "shard")
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("at") - F.col("begin")).cast("long").alias("slot"), "grown_shard")


def shard_of(docs: DataFrame, tree: Node, name: str = "shard", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with the shard of each row as a column; nothing is shuffled.

    A column of the same name is replaced.
    """
    return docs.withColumn(name, descend(tree, F.col(id_col).cast("long")))
