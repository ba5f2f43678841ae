"""Bundles of metrics, errors by group, comparison of report cards, choice of models, permutation tests and importance."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import hash_hex
from ..operators.ranking import positions
from ..session import cut
from . import uplift as U


def checked(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """Predictions fit for metrics: a null or NaN value on either side raises when the plan runs; so does an empty table in
    metric_bundle, which then has no group to report."""
    off = F.col("y_true").isNull() | F.col("y_pred").isNull() | F.isnan("y_true") | F.isnan("y_pred")
    return df.where(F.when(off, F.raise_error(F.lit("a value or a prediction is missing"))).otherwise(F.lit(True)))


def metric_bundle(df: DataFrame, group: list[str], shares: Sequence[float] = (0.1, 0.25)) -> DataFrame:
    """(group, n, pehe, mae, spearman, topk_<per cent>..., qini): all metrics of every (model, target) in a fixed order.

    Positions by prediction and by truth are made once and shared by the top-k and Qini figures.
    """
    df = checked(df, group)
    plain = df.groupBy(*group).agg(F.count("*").alias("n"), U.pehe().alias("pehe"), U.mae().alias("mae"))
    o = U._ordered(df, group)
    tops = []
    for s in shares:
        k = U.top_count(F.col("n"), s)
        tops.append((F.sum(((F.col("by_true") <= k) & (F.col("by_pred") <= k)).cast("double")) / F.max(k)).alias(f"topk_{round(s * 100)}"))
    half = F.max("n") * F.sum("y_true") / 2
    area = lambda p: F.sum(F.col("y_true") * (F.col("n") - F.col(p) + 0.5)) - half
    flat = (F.min("y_true") == F.max("y_true")) | (F.min("y_pred") == F.max("y_pred"))
    ranked = o.groupBy(*group).agg(*tops, F.when(~flat & (area("by_true") > 0), F.try_divide(area("by_pred"), area("by_true"))).alias("qini"))
    return plain.join(U.spearman(df, group), group).join(ranked, group)


def group_errors(df: DataFrame, group: list[str], by: str) -> DataFrame:
    """PEHE, bias and size within every value of `by`, per group; a null value is a group."""
    return df.groupBy(*group, by).agg(F.count("*").alias("n"), U.pehe().alias("pehe"), F.avg(F.col("y_pred") - F.col("y_true")).alias("bias"))


def largest_errors(df: DataFrame, n: int, targets: Sequence[str], target: str = "arm", pos: str = "pos") -> DataFrame:
    """The n largest absolute errors over all targets; ties in the order of the targets, then of the rows."""
    order = F.array_position(F.array(*[F.lit(t) for t in targets]), F.col(target))
    error = F.abs(F.col("y_pred") - F.col("y_true"))
    return df.withColumn("error", error).orderBy(F.desc("error"), order, pos).limit(n)


def card_differences(a: DataFrame, b: DataFrame, keys: Sequence[str], metrics: Sequence[str], tolerance: float = 1e-9) -> DataFrame:
    """(keys, metric, left, right): figures of two report cards that differ by more than the tolerance. NaN counts as null,
    null equals null; a row that one card lacks differs in every metric that the other has."""
    clean = lambda df, side: df.select(*keys, *[F.nanvl(F.col(m).cast("double"), F.lit(None).cast("double")).alias(f"{side}_{m}") for m in metrics])
    j = clean(a, "l").join(clean(b, "r"), list(keys), "full_outer")
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"l_{m}").alias("left"), F.col(f"r_{m}").alias("right")) for m in metrics]))
    x = j.select(*keys, each.alias("x")).select(*keys, "x.*")
    same = (F.col("left").isNull() & F.col("right").isNull()) | F.coalesce(F.abs(F.col("left") - F.col("right")) <= tolerance, F.lit(False))
    return x.where(~same)


def choose_model(df: DataFrame, target: str, model: str, families: Sequence[str]) -> DataFrame:
    """(target, model, pehe): per target the model of least PEHE, ties by the order of the families."""
    order = F.array_position(F.array(*[F.lit(m) for m in families]), F.col(model))
    per = df.groupBy(target, model).agg(F.round(U.pehe(), 9).alias("pehe"))
    return per.groupBy(target).agg(F.min_by(F.struct(model, "pehe"), F.struct("pehe", order)).alias("x")).select(target, "x.*")


def permutation_test(df: DataFrame, group: str, value: str, *, draws: int = 5_000, seed: int = 0, most_rows: int = 100_000) -> DataFrame:
    """(n, observed, p): the population variance within groups, averaged over groups, against that under random group
    labels; p is (1 + draws at or below) / (1 + draws).

    Up to most_rows the draws are spread over tasks, each of which holds the values. Draw k takes numpy's generator of
    (seed, k), so any spread gives the same p. Beyond, the values are spread instead, see _drawn_in_chunks. Nulls take no part.
    """
    rows = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(F.col(group).cast("string").alias("g"), F.col(value).cast("double").alias("v"))
    n = rows.count()
    if n > most_rows:
        return _drawn_in_chunks(rows, n, draws, seed)
    rows = rows.orderBy("g", "v").collect()
    spark = df.sparkSession
    out = "n long, observed double, p double"
    if not rows:
        return spark.createDataFrame([], out)
    _, code = np.unique([r.g for r in rows], return_inverse=True)
    x, size = np.array([r.v for r in rows]), np.bincount(code)
    x = x - x.mean()

    def within(v: np.ndarray) -> float:
        return float((np.bincount(code, v * v) / size - (np.bincount(code, v) / size) ** 2).mean())

    observed = within(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = sum(within(np.random.default_rng([seed, k]).permutation(x)) <= observed + 1e-12 for k in batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([hits], pa.int64())], names=["hits"])

    hits = spark.range(draws).mapInArrow(run, "hits long").agg(F.sum("hits").alias("hits"))
    return hits.select(F.lit(len(x)).cast("long").alias("n"), F.lit(observed).alias("observed"), ((1 + F.col("hits")) / (1 + draws)).alias("p"))


def _drawn_in_chunks(rows: DataFrame, n: int, draws: int, seed: int, chunk_work: int = 50_000) -> DataFrame:
    """The permutation test with the values spread over tasks. Equal values become one with its number. The values are dealt
    into chunks by hash; per draw a tree of hypergeometric draws tells how many rows of each group a chunk has, and within the
    chunk the values of many rows are shared out by hypergeometric draws, all others permuted. That is a uniform permutation.
    A generator belongs to (seed, node of the tree or chunk, slice of draws), so any spread gives the same draws.
    """
    spark = rows.sparkSession
    first = rows.groupBy("g").agg(F.count("*").alias("n"), F.sum("v").alias("s")).orderBy("g").collect()
    size = np.array([r.n for r in first], np.int64)
    k, mean = len(size), sum(r.s for r in first) / n
    x = F.col("v") - F.lit(mean)
    per = rows.groupBy("g").agg((F.sum(x * x) / F.count("*") - F.pow(F.avg(x), 2)).alias("w"))
    observed = per.agg(F.avg("w")).first()[0]
    many = 16 * k  # rows of a value from which sharing out is cheaper than permuting
    values = cut(rows.groupBy("v").agg(F.count("*").alias("c")))
    work = values.agg(F.sum(F.least("c", F.lit(many)))).first()[0]
    chunks = int(min(1 << 16, -(-work // chunk_work)))
    values = values.select(F.pmod(F.xxhash64("v"), F.lit(chunks)).cast("int").alias("chunk"), (F.col("v") - F.lit(mean)).alias("x"), "c")
    held = np.zeros(chunks, np.int64)
    for r in values.groupBy("chunk").agg(F.sum("c").alias("n")).collect():
        held[r.chunk] = r.n
    upto = np.append(0, np.cumsum(held))
    slice_of = max(1, min(draws, 2_000_000 // k))

    def run(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        order = np.argsort(table.column("x").to_numpy())
        x, c = table.column("x").to_numpy()[order], table.column("c").to_numpy()[order]
        light = np.repeat(x[c < many], c[c < many])
        out = []
        for lo in range(0, draws, slice_of):
            rows_of = _rows_in_chunk(size, upto, chunk, min(slice_of, draws - lo), seed, lo)
            rng = np.random.default_rng([seed, 1, chunk, lo])
            total, squares = np.zeros(rows_of.shape), np.zeros(len(rows_of))
            for v, m in zip(x[c >= many], c[c >= many]):
                part = _shared_out(rng, rows_of, int(m))
                rows_of = rows_of - part
                total += part * v
                squares += (part / size).sum(axis=1) * v * v
            ends = np.concatenate([np.zeros((len(rows_of), 1), np.int64), np.cumsum(rows_of, axis=1)], axis=1)
            for d in range(len(rows_of) if len(light) else 0):
                rng.shuffle(light)
                total[d] += np.diff(np.append(0.0, np.cumsum(light))[ends[d]])
                squares[d] += (np.diff(np.append(0.0, np.cumsum(light * light))[ends[d]]) / size).sum()
            draw = np.repeat(np.arange(lo, lo + len(rows_of)), k)
            q = np.zeros(total.shape)
            q[:, 0] = squares
            out.append(pa.table({"draw": draw, "g": np.tile(np.arange(k), len(rows_of)), "s": total.ravel(), "q": q.ravel()}))
        return pa.concat_tables(out)

    values = values.repartition(min(chunks, 1_000), "chunk")  # few bytes, much work: not to be coalesced
    sums = values.groupBy("chunk").applyInArrow(run, "draw long, g long, s double, q double").groupBy("draw", "g").agg(F.sum("s").alias("s"), F.sum("q").alias("q"))
    rows_in = spark.createDataFrame([(i, int(m)) for i, m in enumerate(size)], "g long, m long")
    each = sums.join(rows_in, "g").groupBy("draw").agg(((F.sum("q") - F.sum(F.pow(F.col("s") / F.col("m"), 2))) / k).alias("w"))
    hits = each.agg(F.count_if((F.col("w") <= observed + 1e-12) & ~F.isnan("w")).alias("hits"))
    return hits.select(F.lit(n).cast("long").alias("n"), F.lit(observed).alias("observed"), ((1 + F.col("hits")) / (1 + draws)).alias("p"))


def _rows_in_chunk(size: np.ndarray, upto: np.ndarray, chunk: int, draws: int, seed: int, first: int) -> np.ndarray:
    """(draws, groups): rows of each group that fall into the chunk, down the tree of halves of the chunks."""
    lo, hi = 0, len(upto) - 1
    have = np.tile(size, (draws, 1))
    while hi - lo > 1:
        mid = (lo + hi) // 2
        left = _shared_out(np.random.default_rng([seed, 0, lo, hi, first]), have, int(upto[mid] - upto[lo]))
        lo, hi, have = (lo, mid, left) if chunk < mid else (mid, hi, have - left)
    return have


def _shared_out(rng: np.random.Generator, have: np.ndarray, need: int, exact: int = 10**9) -> np.ndarray:
    """Per row of `have` the groups' parts of a draw of `need` without replacement. Numpy draws no more than 10**9 of a kind;
    beyond that the normal distribution of the same mean and variance, rounded."""
    out = np.zeros_like(have)
    left, rest = np.full(len(have), need, np.int64), have.sum(axis=1)
    for i in range(have.shape[1] - 1):
        good = have[:, i]
        bad = rest - good
        if rest.max(initial=0) < exact:
            part = rng.hypergeometric(good, bad, left)
        else:
            p = good / np.maximum(rest, 1)
            spread = np.sqrt(left * p * (1 - p) * np.maximum(rest - left, 0) / np.maximum(rest - 1, 1))
            part = np.clip(np.rint(rng.normal(left * p, spread)).astype(np.int64), np.maximum(left - bad, 0), np.minimum(good, left))
        out[:, i] = part
        left, rest = left - part, bad
    out[:, -1] = left
    return out


def importance(test: DataFrame, features: Sequence[str], predict, *, y: str, row: str, repeats: int = 10, salt: str = "importance") -> DataFrame:
    """(feature, importance): how much the negative RMSE falls when a feature's values are permuted, the mean over repeats.

    A repeat permutes by the order of a hash of (salt, feature, repeat, row). All repeats of a feature are one table and
    one prediction: `predict` maps a frame to itself with a column `prediction`.
    """
    mse = lambda df, by: df.groupBy(*by).agg(F.sqrt(F.avg(F.pow(F.col("prediction") - F.col(y), 2))).alias("rmse"))
    base = mse(predict(test), []).withColumnRenamed("rmse", "base")
    out = []
    for f in features:
        r = test.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
        r = r.withColumn("__h", hash_hex(salt, F.lit(f), F.col("repeat").cast("string"), F.col(row).cast("string")))
        a = positions(r, ["repeat"], [F.col("__h"), F.col(row)], name="__p")
        b = positions(r.select("repeat", row, F.col(f).alias("__v")), ["repeat"], [F.col(row)], name="__p").select("repeat", "__p", "__v")
        swapped = a.join(b, ["repeat", "__p"]).withColumn(f, F.col("__v")).select(*test.columns, "repeat")
        out.append(mse(predict(swapped), ["repeat"]).agg(F.avg("rmse").alias("permuted")).select(F.lit(f).alias("feature"), "permuted"))
    return reduce(DataFrame.unionByName, out).crossJoin(F.broadcast(base)).select("feature", (F.col("permuted") - F.col("base")).alias("importance"))  # one row


def leading_features(df: DataFrame, n: int, features: Sequence[str]) -> DataFrame:
    """The n features of greatest mean importance over folds and targets; ties in the given order."""
    order = F.array_position(F.array(*[F.lit(f) for f in features]), F.col("feature"))
    return df.groupBy("feature").agg(F.avg("importance").alias("importance")).orderBy(F.desc("importance"), order).limit(n)


def running_total(df: DataFrame, group: list[str], order: Column, value: str, name: str) -> DataFrame:
    """The cumulative sum along an order, for groups of any size: sums of the range partitions, then within each."""
    p = positions(df, group, [order, F.col("pos")], name="__p").withColumn("__b", F.expr("(__p - 1) div 65536"))
    sums = p.groupBy(*group, "__b").agg(F.sum(value).alias("__s"))
    before = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__s").over(before), F.lit(0))).drop("__s")
    inner = Window.partitionBy(*group, "__b").orderBy("__p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return p.join(sums, [*group, "__b"]).withColumn(name, F.col("__before") + F.sum(value).over(inner)).withColumn("step", F.col("__p")).drop("__p", "__b", "__before")
