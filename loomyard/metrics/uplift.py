"""Metrics of effect predictions. Input: (target columns, y_true, y_pred, pos); pos is the stable row order for ties."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import positions

# The Lehmer generator with the Mersenne prime 2**31 - 1.
PRIME, FACTOR = 2147483647, 16807


def pehe() -> Column:
    return F.sqrt(F.avg(F.pow(F.col("y_pred") - F.col("y_true"), 2)))


def mae() -> Column:
    return F.avg(F.abs(F.col("y_pred") - F.col("y_true")))


def average_ranks(df: DataFrame, group: list[str], value: str, name: str, tie: str = "pos") -> DataFrame:
    """Ranks from 1, equal values share their mean rank."""
    p = positions(df, group, [F.col(value), F.col(tie)], name="__p")
    mean = p.groupBy(*group, value).agg(F.avg("__p").alias(name))
    return p.drop("__p").join(mean, [*group, value])


def spearman(df: DataFrame, group: list[str]) -> DataFrame:
    """Pearson correlation of average ranks; null for constant input or a single row."""
    r = average_ranks(average_ranks(df, group, "y_true", "rt"), group, "y_pred", "rp")
    c = F.try_divide(F.covar_pop("rt", "rp"), F.stddev_pop("rt") * F.stddev_pop("rp"))
    return r.groupBy(*group).agg(c.alias("spearman"))


def _ordered(df: DataFrame, group: list[str]) -> DataFrame:
    a = positions(df, group, [F.col("y_pred").desc(), F.col("pos")], name="by_pred")
    a = positions(a, group, [F.col("y_true").desc(), F.col("pos")], name="by_true")
    n = df.groupBy(*group).agg(F.count("*").alias("n"))
    return a.join(n, group)


def top_count(n: Column, share: float) -> Column:
    """ceil(share * n) after rounding to 9 digits, between 1 and n."""
    return F.greatest(F.lit(1), F.least(n, F.ceil(F.round(n * share, 9))))


def topk_recall(df: DataFrame, group: list[str], share: float) -> DataFrame:
    """Share of the k rows of greatest y_true that are among the k of greatest y_pred."""
    o = _ordered(df, group)
    k = top_count(F.col("n"), share)
    return o.groupBy(*group).agg((F.sum(((F.col("by_true") <= k) & (F.col("by_pred") <= k)).cast("double")) / F.max(k)).alias("topk_recall"))


def qini(df: DataFrame, group: list[str]) -> DataFrame:
    """Area between the gain curve and the diagonal, over that of the perfect order; null if that is not positive or a side is constant.

    The trapezoid area under the cumulative sum is the sum of y * (n - position + 1/2): no curve has to be built.
    """
    o = _ordered(df, group)
    half = F.max("n") * F.sum("y_true") / 2
    area = lambda p: F.sum(F.col("y_true") * (F.col("n") - F.col(p) + 0.5)) - half
    best = area("by_true")
    flat = (F.min("y_true") == F.max("y_true")) | (F.min("y_pred") == F.max("y_pred"))
    return o.groupBy(*group).agg(F.when(~flat & (best > 0), F.try_divide(area("by_pred"), best)).alias("qini"))


def poisson_edges() -> list[float]:
    """Cumulated Poisson(1) probabilities, as far as 31 bits can tell them apart."""
    edges, total, p = [], 0.0, math.exp(-1.0)
    while p > 2.0**-32:
        total += p
        edges.append(total)
        p /= len(edges)
    return edges


def draw_seed(salt: str, unit: Column) -> Column:
    """A unit's seed from its hash, between 1 and PRIME - 1."""
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(salt), unit.cast("string")), 256), 1, 12), 16, 10).cast("long")
    return h % (PRIME - 1) + 1


def _weighted_sums(draws: int):
    """Per key and draw the sums of num and den, weighted; a vector of sums per key and partition, no row is repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, multiplier = np.empty(draws, np.int64), 1
        for k in range(draws):
            multiplier = multiplier * FACTOR % PRIME
            step[k] = multiplier
        edges, held = np.array(poisson_edges()), {}

        def emit() -> pa.RecordBatch:
            keys = list(held)
            num, den = (np.concatenate([held[k][i] for k in keys]) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()).take(pa.array(np.repeat(np.arange(len(keys)), draws))), pa.array(np.tile(np.arange(draws), len(keys))), pa.array(num), pa.array(den)], names=["k", "draw", "num", "den"])

        for batch in batches:
            code = batch.column(0).dictionary_encode()
            at, seed = code.indices.to_numpy(), batch.column(1).to_numpy()
            num, den = (batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (2, 3))
            for i, k in enumerate(code.dictionary.to_pylist()):
                own = np.flatnonzero(at == i)
                sums = held.setdefault(k, (np.zeros(draws), np.zeros(draws)))
                for lo in range(0, len(own), 256):
                    part = own[lo : lo + 256]
                    w = np.searchsorted(edges, (seed[part, None] * step % PRIME) / PRIME, side="right")
                    sums[0][:] += num[part] @ w
                    sums[1][:] += den[part] @ w
            if len(held) * draws > 2_000_000:
                yield emit()
                held.clear()
        if held:
            yield emit()

    return run


def _interval(df: DataFrame, key: Column, seed: Column, num: Column, den: Column, draws: int) -> DataFrame:
    """(k, low, high): 2.5 and 97.5 percentiles of the ratio of weighted sums over the draws. Rows with a null num take no part."""
    rows = df.where(num.isNotNull()).select(key.alias("k"), seed.alias("seed"), num.cast("double").alias("num"), den.cast("double").alias("den"))
    sums = rows.mapInArrow(_weighted_sums(draws), "k string, draw long, num double, den double")
    m = sums.groupBy("k", "draw").agg((F.sum("num") / F.nullif(F.sum("den"), F.lit(0.0))).alias("m"))
    return m.groupBy("k").agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))


def hash_bootstrap(df: DataFrame, group: list[str], value: str, unit: str, *, draws: int, salt: str) -> DataFrame:
    """Bootstrap of the mean with Poisson(1) weights: a unit's seed comes from its hash, its draws from a multiplicative
    generator, so any engine gives the same draws. One hash per row; a vector of sums per group and partition.

    The size of a resample is free instead of fixed at n, as it must be where no task sees all rows.
    """
    out = _interval(df, F.to_json(F.struct(*group)), draw_seed(salt, F.col(unit)), F.col(value), F.lit(1.0), draws)
    return out.select(F.from_json("k", df.select(*group).schema).alias("g"), "low", "high").select("g.*", "low", "high")


def cluster_bootstrap(df: DataFrame, cluster: str, value: str, *, draws: int, salt: str) -> DataFrame:
    """The same over clusters: sums per cluster first, then a ratio of weighted sums per draw."""
    sums = df.groupBy(cluster).agg(F.sum(value).alias("s"), F.count(value).alias("c"))
    return _interval(sums, F.lit(""), draw_seed(salt, F.col(cluster)), F.col("s"), F.col("c"), draws).drop("k")


def exact_bootstrap(values: DataFrame, value: str, pos: str, *, draws: int, seed: int, most_rows: int = 100_000) -> tuple[float, float] | None:
    """Percentile interval of the mean from numpy's default_rng(seed) row resamples, for samples of checked size."""
    rows = values.where(F.col(value).isNotNull()).orderBy(pos).limit(most_rows + 1).select(value).collect()
    if len(rows) > most_rows:
        raise ValueError("too many rows for the exact bootstrap; use hash_bootstrap")
    if not rows:
        return None
    x = np.array([r[0] for r in rows], float)
    rng = np.random.default_rng(seed)
    means = np.array([x[rng.integers(0, len(x), len(x))].mean() for _ in range(draws)])
    return float(np.percentile(means, 2.5)), float(np.percentile(means, 97.5))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin from 1, n) over [low, high]; the last bin holds its right end; other values are left out. Empty bins are not listed."""
    width = (high - low) / bins
    b = F.least(F.floor((F.col(value) - low) / width) + 1, F.lit(bins))
    return df.where(F.col(value).between(low, high)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def normal_tail(z: Column) -> Column:
    """Two-sided p of a standard normal value, by the rational approximation of the error function (error below 2e-7)."""
    x = F.abs(z) / math.sqrt(2.0)
    # Abramowitz and Stegun, Handbook of Mathematical Functions, formula 7.1.26.
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.when(z.isNotNull(), F.least(F.lit(1.0), poly * F.exp(-x * x)))


def signed_rank(df: DataFrame, value: str, unit: str, group: list[str]) -> DataFrame:
    """Wilcoxon signed-rank test per group, over non-zero values: (group, n, w_plus, z, p). Ties share ranks and correct the
    variance; z and p are the normal approximation, null without values."""
    d = df.where(F.col(value) != 0).select(*group, F.abs(value).alias("a"), (F.col(value) > 0).alias("up"), F.col(unit).alias("pos"))
    r = average_ranks(d, group, "a", "r")
    ties = r.groupBy(*group, "a").agg(F.count("*").alias("t")).groupBy(*group).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    s = r.groupBy(*group).agg(F.count("*").alias("n"), F.sum(F.when(F.col("up"), F.col("r")).otherwise(0.0)).alias("w_plus")).join(ties, group)
    n = F.col("n")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    s = s.withColumn("z", F.when(var > 0, (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(var)))
    return s.select(*group, "n", "w_plus", "z", normal_tail(F.col("z")).alias("p"))
