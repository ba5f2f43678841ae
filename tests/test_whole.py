"""Queries that must do their whole job, against plain sums over all rows."""

import hashlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from loomyard.queries import metrics, quality


def test_feature_integration_takes_every_order(spark, small):
    orders = pq.read_table(f"{small}/orders.parquet").to_pandas()
    n, total = orders.groupby("o_custkey").size(), orders.groupby("o_custkey")["o_totalprice"].sum().astype(float)
    got = quality.feature_integration(spark, small).collect()
    assert sum(r.n_orders or 0 for r in got) == len(orders)
    for r in got:
        assert r.n_orders_missing == (r.c_custkey not in n.index) and (r.n_orders or 0) == n.get(r.c_custkey, 0)
        assert float(r.total or 0) == pytest.approx(total.get(r.c_custkey, 0.0), abs=0.01)


def draw_weights(salt, units, draws):
    """(draw, unit) Poisson weights from the same hash and generator, in plain integers."""
    edges, total, p = [], 0.0, float(np.exp(-1.0))
    for k in range(1, 14):
        total += p
        edges.append(total)
        p /= k
    seeds = [int(hashlib.sha256(f"{salt}:{x}".encode()).hexdigest()[:12], 16) % (2**31 - 2) + 1 for x in units]
    u = [[s * pow(16807, d + 1, 2**31 - 1) % (2**31 - 1) / (2**31 - 1) for s in seeds] for d in range(draws)]
    return np.searchsorted(np.array(edges), np.array(u), side="right")


def test_bootstraps_draw_as_often_as_the_reference(spark, small):
    rows = metrics.predictions(spark, small).toPandas()
    got = {r.arm: (r.low, r.high) for r in metrics.bootstrap_hash_ci(spark, small).collect()}
    units = sorted(rows["pos"].unique())
    w = draw_weights("boot", units, 1_000)
    assert set(got) == set(rows["arm"])
    for arm, part in rows.groupby("arm"):
        own = w[:, np.searchsorted(units, part["pos"])]
        assert got[arm] == pytest.approx(np.percentile(own @ part["y_true"].to_numpy(float) / own.sum(1), [2.5, 97.5]), abs=2e-6)
    nation = pq.read_table(f"{small}/customer.parquet").to_pandas().set_index("c_custkey")["c_nationkey"]
    per = rows.groupby(nation.loc[rows["pos"]].to_numpy())["y_true"].agg(["sum", "count"]).astype(float)
    w = draw_weights("cluster", per.index, 10_000)
    r = metrics.cluster_bootstrap(spark, small).first()
    assert (r.low, r.high) == pytest.approx(np.percentile(w @ per["sum"].to_numpy() / (w @ per["count"].to_numpy()), [2.5, 97.5]), abs=2e-6)


def test_more_folds_than_are_read_raise(spark):
    from loomyard.models import oof

    df = spark.range(102).selectExpr("id AS i", "id AS f", "CAST(id AS double) AS x", "CAST(id AS double) AS y")
    with pytest.raises(ValueError, match="100 folds"):
        oof.ridge(df, "y", numeric=["x"], categorical=[], row="i", fold="f")


def test_split_counts_follow_their_rule():
    from fractions import Fraction

    from loomyard.operators.sampling import split_counts

    assert split_counts(3, (0, 0.5, 0.5)) == [0, 2, 1] and split_counts(1, (0, 0.5, 0.5)) == [0, 1, 0] and split_counts(10, (0.7, 0.15, 0.15)) == [6, 2, 2]
    for n in range(40):
        for shares in ((0.7, 0.15, 0.15), (0.0, 0.5, 0.5), (0.0, 0.0, 1.0), (0.0, 1.0, 0.0), (1.0, 0.0, 0.0), (0.98, 0.01, 0.01), (0.02, 0.49, 0.49), (0.5, 0.5, 0.0)):
            got = split_counts(n, shares)
            assert sum(got) == n and min(got) >= 0
            assert all(x == 0 for x, s in zip(got, shares) if s == 0)
            if n >= sum(s > 0 for s in shares) and n >= 3:
                assert all(x >= 1 for x, s in zip(got, shares) if s > 0)
            assert all(abs(x - Fraction(str(s)) * n) <= 2 for x, s in zip(got, shares))
    for shares in ((0.5, 0.5, 0.5), (-0.1, 0.6, 0.5)):
        with pytest.raises(ValueError):
            split_counts(5, shares)


def test_a_unit_in_two_groups_and_a_short_quota_are_refused(spark):
    from loomyard.operators import sampling as S

    df = spark.createDataFrame([("a", 1), ("b", 1), ("a", 2)], "g string, u long")
    with pytest.raises(Exception, match="two groups"):
        S.group_split(df, "g", "u", seed=1).collect()
    rows = spark.createDataFrame([(i, "c", "rare" if i == 0 else "often", 1, i * 10, i * 10 + 5) for i in range(5)], "id long, city string, kind string, d long, s long, t long")
    kw = {"city": "city", "kind": "kind", "scope": "d", "start": "s", "end": "t", "key": "id", "seed": 1}
    assert S.quota_sample(rows, quota=1, **kw).count() == 2 and S.quota_sample(rows, quota=2, refuse=False, **kw).count() == 3
    with pytest.raises(Exception, match="short of the quota"):
        S.quota_sample(rows, quota=2, **kw).collect()


def test_signed_rank_equals_plain_sums(spark):
    import math

    from loomyard.metrics import uplift as U

    x = [3.0, -3.0, 3.0, 1.0, -2.0, 0.0, 5.0, 5.0, -1.0, 7.0, 0.0, 2.0]
    r = U.signed_rank(spark.createDataFrame([("g", i, v) for i, v in enumerate(x)], "g string, i long, v double"), "v", "i", ["g"]).first()
    kept = sorted((abs(v), v > 0) for v in x if v)
    a = [v for v, _ in kept]
    rank = {v: sum(i + 1 for i, w in enumerate(a) if w == v) / a.count(v) for v in a}
    n, plus = len(a), sum(rank[v] for v, up in kept if up)
    var = n * (n + 1) * (2 * n + 1) / 24 - sum(a.count(v) ** 3 - a.count(v) for v in set(a)) / 48
    z = (plus - n * (n + 1) / 4) / math.sqrt(var)
    assert (r.n, r.w_plus) == (n, plus) and r.z == pytest.approx(z) and r.p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=1e-6)


def test_checkpoints_carry_their_true_size_through_many_joins(spark):
    """The estimate of a loop of self-joins squares with every round unless a cut replaces it: planning would stall."""
    from loomyard.session import cut

    df = spark.range(50).selectExpr("id AS u", "id % 7 AS p")
    for _ in range(8):
        top = df.selectExpr("u AS x", "p AS y")
        df = cut(df.join(top, df.p == top.x).selectExpr("u", "y AS p"))
    assert df.count() == 50
    assert len(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 7


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace

    from loomyard import session

    unset = SimpleNamespace(isDefined=lambda: False)
    sc = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: unset)))
    with pytest.raises(RuntimeError, match="executors share"):
        session.ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d=None: d)))
