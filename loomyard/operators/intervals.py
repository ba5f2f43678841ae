"""Merging intervals into continuous periods, and the gaps between the periods (problem 7).

Method: an ordered map of disjoint intervals per key in keyed state (`IntervalMap`); an insertion finds the overlapped
stretches by binary search, merges them and so updates the gaps. Insertions come in batches, in any order, and are
located and merged as arrays. The same map backs the streaming operator in `loomyard.streaming.intervals`.

Scale: rows are keyed by (entity, bucket of the start), so an entity that holds a third of all rows is spread over many
tasks; the state of one key is dropped before the next begins. What reaches over a bucket's end is passed on as one
carry row per (entity, bucket), taken from a pre-aggregated max(end); only the first and last stretch of a bucket take
part in stitching. Nothing is collected, no side is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LOWEST = np.iinfo(np.int64).min


def disjoint(key: np.ndarray, start: np.ndarray, end: np.ndarray, join: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The disjoint stretches (key, start, end) of intervals in any order; keys are whole numbers in rising order."""
    if not len(key):
        return key, start, end
    order = np.lexsort((start, key))
    key, start, end = key[order], start[order], end[order]
    # The furthest end so far within the key: ends by rank, lifted by key, so that one running maximum serves all keys.
    known, rank = np.unique(end, return_inverse=True)
    reach = known[np.maximum.accumulate(key * len(known) + rank) - key * len(known)]
    new = np.append(True, (key[1:] != key[:-1]) | (start[1:] - join > reach[:-1]))
    at = np.flatnonzero(new)
    return key[at], start[at], reach[np.append(at[1:], len(key)) - 1]


class IntervalMap:
    """Disjoint intervals in order. Touching ones (start == end + join) become one; join=1 for inclusive integer ends."""

    __slots__ = ("_ends", "_starts", "join")

    def __init__(self, join: int = 0) -> None:
        self._starts = self._ends = np.zeros(0, np.int64)
        self.join = join

    @property
    def starts(self) -> list[int]:
        return self._starts.tolist()

    @property
    def ends(self) -> list[int]:
        return self._ends.tolist()

    def add(self, start: int, end: int) -> None:
        self.insert(np.array([start], np.int64), np.array([end], np.int64))

    def insert(self, start: np.ndarray, end: np.ndarray) -> None:
        """Insert intervals in any order. Binary search finds what they overlap; the rest of the map is left as it is."""
        if not len(start):
            return
        _, start, end = disjoint(np.zeros(len(start), np.int64), start, end, self.join)
        lo, hi = np.searchsorted(self._ends, start - self.join), np.searchsorted(self._starts, end + self.join, side="right")
        edge = np.zeros(len(self._starts) + 1, np.int64)
        np.add.at(edge, lo[lo < hi], 1)
        np.add.at(edge, hi[lo < hi], -1)
        met = np.cumsum(edge[:-1]) > 0
        s, e = np.concatenate([start, self._starts[met]]), np.concatenate([end, self._ends[met]])
        _, s, e = disjoint(np.zeros(len(s), np.int64), s, e, self.join)
        at = np.searchsorted(self._starts[~met], s)
        self._starts, self._ends = np.insert(self._starts[~met], at, s), np.insert(self._ends[~met], at, e)

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        return self._starts, self._ends

    def gaps(self) -> list[tuple[int, int]]:
        return list(zip(self.ends, self.starts[1:]))


def merge_intervals(
    df: DataFrame, entity: str, start: str, end: str, *, bucket_width: int = 3_600_000_000, join: int = 0
) -> DataFrame:
    """Continuous periods and gaps: (entity, kind, start, end) with kind 'period' or 'gap'.

    Rows with a null entity, start or end, and empty or reversed ones (end <= start; with join=1, end < start), take no
    part. Repeated rows change nothing. An empty table gives an empty result. Extra columns are ignored, whatever their
    names. `bucket_width` (in units of start) only spreads the work; the result doesn't depend on it.
    """
    rows = df.select(F.col(entity).alias("e"), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("t"))
    rows = rows.where(F.col("e").isNotNull() & F.col("s").isNotNull() & (F.col("t") >= F.col("s") if join else F.col("t") > F.col("s")))
    rows = rows.withColumn("b", F.expr(f"s div {bucket_width} - if(s % {bucket_width} < 0, 1, 0)"))
    reach = rows.groupBy("e", "b").agg(F.max("t").alias("t"))
    before = Window.partitionBy("e").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    carry = reach.withColumn("t", F.max("t").over(before)).where(F.col("t").isNotNull())
    both = rows.select("e", "b", F.col("s"), "t").unionByName(carry.select("e", "b", F.lit(None).cast("long").alias("s"), "t"))
    kind = df.schema[entity].dataType.simpleString()
    pieces = (
        both.repartition(F.col("e"), F.col("b"))
        .sortWithinPartitions("e", "b")
        .mapInArrow(_bucket_pieces(join), f"e {kind}, b long, s long, t long, own boolean, last boolean, next long, n long")
    )
    # Inner stretches are final. The last one of a bucket, and what later buckets add to it, are stitched.
    inner = pieces.where(F.col("own") & ~F.col("last"))
    ends = pieces.where(~F.col("own") | F.col("last"))
    order = Window.partitionBy("e").orderBy("b", "own")
    ends = ends.withColumn("g", F.sum(F.col("own").cast("int")).over(order)).withColumn("next", F.first("n", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)))
    stitched = ends.groupBy("e", "g").agg(F.min("s").alias("s"), F.max("t").alias("t"), F.max(F.when(F.col("own"), F.col("next"))).alias("next"))
    whole = inner.select("e", "s", "t", "next").unionByName(stitched.select("e", "s", "t", "next"))
    # One row is one period and, if another period follows, one gap.
    out = whole.select("e", F.explode(F.array(F.struct(F.lit("period").alias("kind"), "s", "t"), F.struct(F.lit("gap").alias("kind"), F.col("t").alias("s"), F.col("next").alias("t")))).alias("x"))
    return out.where(F.col("x.t").isNotNull()).select(F.col("e").alias(entity), "x.kind", F.col("x.s").alias("start"), F.col("x.t").alias("end"))


def _bucket_pieces(join: int):
    """Rows grouped by (entity, bucket), in any order of time, to the disjoint stretches of each bucket.

    The keys of an Arrow batch are worked off together. The last one may go on in the next batch: its map is kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, reach = None, IntervalMap(join), LOWEST  # of the open key: (entity, bucket), its map, its carry
        for batch in batches:
            if not batch.num_rows:
                continue
            name = batch.column(0)
            code, b = name.dictionary_encode().indices.to_numpy(), batch.column(1).to_numpy()
            key = np.cumsum(np.append(False, (code[1:] != code[:-1]) | (b[1:] != b[:-1]))).astype(np.int64)
            own = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            s, t = batch.column(2).fill_null(0).to_numpy(), batch.column(3).to_numpy()
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            if held is not None and held != (name[0].as_py(), int(b[0])):
                yield _flush(pa.array([held[0]], name.type), np.array([held[1]]), np.zeros(len(state.arrays()[0]), np.int64), *state.arrays(), np.array([reach]), join)
                state, reach = IntervalMap(join), LOWEST
            carry = np.full(len(first), LOWEST, np.int64)
            carry[key[~own]] = t[~own]
            carry[0] = max(carry[0], reach)
            k, s, t = disjoint(key[own], s[own], t[own], join)
            opening = int(np.searchsorted(k, 1))
            state.insert(s[:opening], t[:opening])
            last = len(first) - 1
            if last:  # all keys but the last are complete
                closing = int(np.searchsorted(k, last))
                s0, t0 = state.arrays()
                k0 = np.concatenate([np.zeros(len(s0), np.int64), k[opening:closing]])
                yield _flush(name.take(pa.array(first[:-1])), b[first[:-1]], k0, np.concatenate([s0, s[opening:closing]]), np.concatenate([t0, t[opening:closing]]), carry[:-1], join)
                state = IntervalMap(join)
                state.insert(s[closing:], t[closing:])
            held, reach = (name[int(first[-1])].as_py(), int(b[first[-1]])), int(carry[-1])
        if held is not None:
            yield _flush(pa.array([held[0]], name.type), np.array([held[1]]), np.zeros(len(state.arrays()[0]), np.int64), *state.arrays(), np.array([reach]), join)

    return run


def _flush(name: pa.Array, bucket: np.ndarray, key: np.ndarray, s: np.ndarray, t: np.ndarray, carry: np.ndarray, join: int) -> pa.RecordBatch:
    """The pieces of complete keys: stretches in order by key; what an earlier bucket's reach covers has no start of its own."""
    own = (carry[key] == LOWEST) | (s - join > carry[key])
    n = len(key)
    ends_key = np.append(key[1:] != key[:-1], True)[:n]
    ends_covered = ~own & np.append(own[1:] | (key[1:] != key[:-1]), True)[:n]
    keep = own | ends_covered
    followed = own & ~ends_key  # what follows an own stretch in its key is an own one
    nxt = np.append(s[1:], 0)[:n]
    first = np.flatnonzero(own & np.append(True, (key[1:] != key[:-1]) | ~own[:-1])[:n])
    start_of = np.zeros(len(carry), np.int64)
    start_of[key[first]] = s[first]
    k, o = key[keep], own[keep]
    return pa.RecordBatch.from_arrays(
        [
            name.take(pa.array(k)), pa.array(bucket[k]), pa.array(s[keep], mask=~o), pa.array(t[keep]), pa.array(o),
            pa.array((own & ends_key)[keep]), pa.array(nxt[keep], mask=~followed[keep]), pa.array(start_of[k], mask=~o),
        ],
        names=["e", "b", "s", "t", "own", "last", "next", "n"],
    )
