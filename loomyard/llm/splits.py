"""Splits that keep related records together (problem 3).

Method: Boruvka rounds. In each, every component takes its least outgoing edge (edges have a total order by hash, so no
cycle but the mutual pair can arise), the chosen edges are contracted, and they are kept: together they are the spanning
forest, written to the shared folder round by round. Components at least halve per round. The roots are stratified by
size band and dealt systematically to the splits.

Scale: edges are distinct and kept as least edge per pair of components; the least edge per component is a min_by
aggregate with map-side combine, so a hub with a third of all edges is no hot spot; joins on component labels have one
row per label on one side and are split by AQE on the other. All lineage is cut by reliable checkpoints. Labels are
composed from the last, smallest round backwards, so only one join is as large as the set of nodes. The table is read once. Components are never
collected; only sums per size band and hash slot reach the driver, at most 64 * SLOTS figures at any size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import hash_hex, norm_key
from ..session import cut

#: Hash slots per size band, three hex digits.
SLOTS = 4096


@dataclass
class Forest:
    """members: (node, root). edges: (a, b, round), the spanning forest: nodes less components many."""

    members: DataFrame
    edges: DataFrame


def spanning_forest(edges: DataFrame, nodes: DataFrame | None = None) -> Forest:
    """Connected components of undirected edges (a, b) and further lone nodes (node).

    Null ends, loops and repeated edges change nothing. No edges: every node is its own root. The root of a component
    is one of its nodes.
    """
    ends = edges.where("a is not null and b is not null").select("a", "b")
    lone = ends.where("a = b").select(F.col("a").alias("node"))
    if nodes is not None:
        lone = lone.unionByName(nodes.where("node is not null").select("node"))
    lone = lone.distinct()
    e = ends.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    # (u, v): components of the ends; w: total order.
    e = cut(e.select(F.col("a").alias("u"), F.col("b").alias("v"), F.struct(F.xxhash64("a", "b").alias("h"), "a", "b").alias("w")))
    chosen, labels = [], []
    while not e.isEmpty():
        sides = F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("v").alias("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
        both = e.select(sides.alias("x"), "w").select("x.u", "x.v", "w")
        least = cut(both.groupBy("u").agg(F.min_by(F.struct("v", "w"), "w").alias("m")).select("u", F.col("m.v").alias("v"), F.col("m.w").alias("w")))
        chosen.append(least.select("w.a", "w.b", F.lit(len(chosen) + 1).alias("round")).distinct())
        # Only the two ends of a mutual choice form a cycle; its lesser label becomes the root.
        up, back = least.select("u", "v"), least.select(F.col("u").alias("x"), F.col("v").alias("y"))
        mutual = (F.col("y") == F.col("u")) & (F.col("u") < F.col("v"))
        parent = up.join(back, F.col("v") == F.col("x")).select("u", F.when(mutual, F.col("u")).otherwise(F.col("v")).alias("p"))
        parent = _to_roots(parent)
        labels.append(parent)
        label = parent.withColumnRenamed("u", "x")
        e = e.join(label, F.col("u") == F.col("x")).select(F.col("p").alias("u"), "v", "w")
        e = e.join(label, F.col("v") == F.col("x")).select("u", F.col("p").alias("v"), "w").where("u <> v")
        e = cut(e.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min("w").alias("w")))
    forest = chosen[0] if chosen else ends.limit(0).withColumn("round", F.lit(0))
    for c in chosen[1:]:
        forest = forest.unionByName(c)
    if not labels:
        return Forest(lone.withColumn("root", F.col("node")), forest)
    root = labels.pop()
    for label in reversed(labels):
        later = root.select(F.col("u").alias("x"), F.col("p").alias("q"))
        root = label.join(later, F.col("p") == F.col("x"), "left").select("u", F.coalesce("q", "p").alias("p"))
    members = cut(root.select(F.col("u").alias("node"), F.col("p").alias("root")))  # every node with an edge
    alone = lone.join(members.select("node"), "node", "left_anti").withColumn("root", F.col("node"))
    return Forest(members.unionByName(alone), forest)


def _to_roots(parent: DataFrame) -> DataFrame:
    """(u, p) with p the root of u's tree, by pointer jumping: the depth becomes a quarter with each checkpoint."""
    while True:
        jump = parent
        for _ in range(2):
            top = jump.select(F.col("u").alias("x"), F.col("p").alias("y"))
            jump = jump.join(top, F.col("p") == F.col("x")).select("u", F.col("y").alias("p"), (F.col("y") != F.col("p")).alias("moved"))
        parent = cut(jump)
        if parent.where("moved").isEmpty():
            return parent.select("u", "p")
        parent = parent.select("u", "p")


def shared_key_edges(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(edges, lone nodes) that join rows with a common value in any of `keys`; values are normalised, nulls join nothing. The
    nodes that stand alone in a row are given besides the edges; they may have edges from other rows."""
    node = [F.when(norm_key(f"`{k}`").isNotNull(), F.concat(F.lit(f"{k}|"), norm_key(f"`{k}`"))) for k in keys]
    present = cut(rows.select(F.array_compact(F.array(*node)).alias("n")).distinct())
    nodes = present.where(F.size("n") == 1).select(F.get("n", F.lit(0)).alias("node"))
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("n") - 1, F.lit(1))), lambda i: F.struct(F.get("n", i - 1).alias("a"), F.get("n", i).alias("b")))
    return present.select(F.explode(pairs).alias("x")).select("x.a", "x.b").where("b is not null"), nodes


def linked_rows(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, Forest]:
    """Rows with a column `root`: rows of one component have one root. Rows with all keys null stand alone, root null."""
    edges, nodes = shared_key_edges(rows, keys)
    forest = spanning_forest(edges, nodes)
    first = F.coalesce(*[F.when(norm_key(f"`{k}`").isNotNull(), F.concat(F.lit(f"{k}|"), norm_key(f"`{k}`"))) for k in keys])
    keyed = rows.withColumn("__node", first)
    return keyed.join(forest.members.withColumnRenamed("node", "__node"), "__node", "left").drop("__node"), forest


def split_rows(rows: DataFrame, keys: list[str], row_id: str, *, shares: dict[str, int] | None = None, salt: str = "splits") -> DataFrame:
    """Every row with `root` and `split`; rows linked by any of `keys`, directly or not, share their split.

    shares are whole per cents that add up to 100. Roots are banded by size (powers of two) and ordered by hash in the
    band, 4,096 slots of it. Along the cumulated size, from the band of the largest down, each slot goes to the split that
    then lacks most, so every band is divided in the given proportions, and what a large component leaves uneven is made
    up for by the bands below. Rows without any key are components of their own, dealt by the hash of their row_id.
    """
    shares = shares or {"train": 70, "validation": 15, "test": 15}
    if sum(shares.values()) != 100:
        raise ValueError("shares must add up to 100")
    linked, _ = linked_rows(rows, keys)
    linked = cut(linked.withColumn("root", F.coalesce("root", F.concat(F.lit("row|"), F.col(row_id).cast("string")))))
    band = F.floor(F.log2("size")).cast("int")
    sizes = linked.groupBy("root").agg(F.count("*").alias("size")).select("root", "size", band.alias("band"), F.substring(hash_hex(salt, F.col("root")), 1, 3).alias("slot"))
    held = {k: 0 for k in shares}
    dealt = []
    for r in sorted(sizes.groupBy("band", "slot").agg(F.sum("size").alias("size")).collect(), key=lambda r: (-r["band"], r["slot"])):
        total = sum(held.values()) + r["size"]
        best = max(shares, key=lambda k: shares[k] * total - 100 * held[k])
        held[best] += r["size"]
        dealt.append((r["band"], r["slot"], best))
    slots = rows.sparkSession.createDataFrame(dealt, "band int, slot string, split string")  # at most 64 * SLOTS rows
    root = sizes.join(F.broadcast(slots), ["band", "slot"]).select("root", "split")
    return linked.join(root, "root")


def groups(rows: DataFrame, keys: list[str], key: str) -> DataFrame:
    """(value, group): every value of `key` with the least value that must share its split, itself if there is none less.

    Representatives and membership: one row per value, however large the groups are.
    """
    edges, nodes = shared_key_edges(rows, keys)
    m = spanning_forest(edges, nodes).members.where(F.col("node").startswith(f"{key}|"))
    m = m.select("root", F.expr(f"substring(node, {len(key) + 2})").alias("value"))
    first = m.groupBy("root").agg(F.min("value").alias("group"))
    return m.join(first, "root").select("value", "group")


def together(rows: DataFrame, keys: list[str], key: str, *, block: int = 1_000) -> DataFrame:
    """All pairs (a, b), a < b, of different values of `key` that must share a split: `groups`, written out.

    A group of n values is spread over n / block tasks, each of which pairs a part of the values with all of them.
    """
    m = cut(groups(rows, keys, key))
    size = m.groupBy("group").count().where("count > 1").select("group", F.ceil(F.col("count") / block).cast("int").alias("parts"))
    m = m.join(size, "group")  # values alone have no pair
    a = m.select("group", F.col("value").alias("a"), F.pmod(F.xxhash64("value"), F.col("parts")).cast("int").alias("part"))
    b = m.select("group", F.col("value").alias("b"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return a.join(b, ["group", "part"]).where("a < b").select("a", "b")
