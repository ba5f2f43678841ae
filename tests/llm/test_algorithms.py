"""Problems 2, 3, 5 and 6 against brute force, and the odd cases."""

import random

import pytest
from pyspark.sql import functions as F

from loomyard.llm import nearest, splits, stable_sample, target_sample


@pytest.mark.parametrize("seed", range(3))
def test_nearest_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    left = [(i, rng.choice(["a", "a", "b", None]), rng.choice([None, *range(-50, 50)])) for i in range(60)] + [(0, "a", 3), (0, "a", 3)]
    right = [(rng.choice(["a", "b", None]), rng.choice([None, *range(-60, 60)]), rng.randrange(200)) for _ in range(60)]
    l, r = spark.createDataFrame(left, "id long, e string, u long"), spark.createDataFrame(right, "e string, u long, pid long")
    got = sorted((x.id, x.u, x.pid) for x in nearest.nearest_in_time(l, r, entity="e", left_time="u", right_time="u", right_id="pid", tolerance=4, bucket_width=rng.choice([10, 30, 1000])).collect())
    want = []
    for i, e, u in left:
        near = [(abs(v - u), v, p) for x, v, p in right if e is not None and u is not None and x == e and v is not None and abs(v - u) <= 4]
        want += [(i, u, min(near)[2])] if near else []
    assert got == sorted(want)
    assert nearest.nearest_in_time(l.limit(0), r, entity="e", left_time="u", right_time="u", right_id="pid", tolerance=4).count() == 0
    assert nearest.nearest_in_time(l, r.limit(0), entity="e", left_time="u", right_time="u", right_id="pid", tolerance=4).count() == 0
    with pytest.raises(ValueError):
        nearest.nearest_in_time(l.withColumn("pid", F.lit(1)), r, entity="e", left_time="u", right_time="u", right_id="pid", tolerance=4)


def components(rows):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for r in rows:
        nodes = [(i, v.strip().lower()) for i, v in enumerate(r) if v is not None]
        for n in nodes:
            find(n)
        for a, b in zip(nodes, nodes[1:]):
            up[find(a)] = find(b)
    return find, up


@pytest.mark.parametrize("seed", range(2))
def test_links_equal_union_find(spark, seed):
    rng = random.Random(seed)
    pick = lambda p, n: rng.choice([None, f"{p}{rng.randrange(n)}", f" {p.upper()}{rng.randrange(n)} "])
    rows = [(pick("s", 60), pick("l", 40), pick("r", 30)) for _ in range(70)] + [(None, None, None), ("x", "hub", None)] + [(None, "hub", f"h{i}") for i in range(9)]
    df = spark.createDataFrame(rows, "s string, l string, r string").withColumn("id", F.monotonically_increasing_id()).withColumn("root_", F.lit(1))
    find, up = components(rows)
    recs = sorted({n[1] for n in up if n[0] == 2})
    want = {(a, b) for a in recs for b in recs if a < b and find((2, a)) == find((2, b))}
    f = splits.spanning_forest(*splits.shared_key_edges(df, ["s", "l", "r"]))
    n, roots = f.members.count(), f.members.select("root").distinct().count()
    assert n == len(up) and roots == len({find(x) for x in up}) and f.edges.select("a", "b").distinct().count() == n - roots
    assert {tuple(x) for x in splits.together(df, ["s", "l", "r"], "r", block=2).collect()} == want
    out = splits.split_rows(df, ["s", "l", "r"], "id").collect()
    assert len(out) == len(rows) and len({r.root for r in out}) == roots + sum(r == (None, None, None) for r in rows)
    assert all(len({x.split for x in out if x.root == r}) == 1 for r in {x.root for x in out})


def test_splits_stay_near_their_shares_and_empty_tables_pass(spark):
    df = spark.range(4000).select("id", F.concat(F.lit("k"), (F.col("id") / (1 + F.col("id") % 3)).cast("int").cast("string")).alias("k"), F.lit(None).cast("string").alias("z"))
    got = {r["split"]: r["count"] / 4000 for r in splits.split_rows(df, ["k", "z"], "id").groupBy("split").count().collect()}
    assert abs(got["train"] - 0.7) < 0.03 and abs(got["validation"] - 0.15) < 0.03 and abs(got["test"] - 0.15) < 0.03
    assert splits.split_rows(df.limit(0), ["k", "z"], "id").count() == 0
    assert splits.together(df.limit(0), ["k", "z"], "k").count() == 0


def test_what_a_hot_component_leaves_uneven_is_made_up_for(spark):
    """A third of all rows in one component, a tenth in another: the others restore the shares."""
    key = F.when(F.col("id") < 1200, "hot").when(F.col("id") < 1500, "warm").otherwise(F.concat(F.lit("k"), (F.col("id") / 3).cast("int").cast("string")))
    df = spark.range(3600).select("id", key.alias("k"))
    out = splits.split_rows(df, ["k"], "id")
    assert {r["split"]: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 2520, "validation": 540, "test": 540}
    assert out.where("k in ('hot', 'warm')").select("k", "split").distinct().count() == 2


def test_target_sample_quotas_ties_and_odd_rows(spark):
    rows = [("A b", "T", f"i{i}") for i in range(50)] + [("a-b", " t ", f"I{i} ") for i in range(50)] + [("c", "t", f"j{i}") for i in range(3)] + [(None, "t", "n"), (" ", "t", "n2"), ("c", "t", None)]
    df = spark.createDataFrame(rows, "source_city string, scenario_type string, scenario_id string").withColumn("rank", F.lit(0))
    t = spark.createDataFrame([("a_b", "t", 600, 1), ("C", "t", 400, 5), ("none", "t", 0, 0)], "source_city string, scenario_type string, target_permille long, min_rows long")
    sample, report = target_sample.target_sample(df, t)
    got = {r.source_city: (r.available, r.quota, r.drawn, r.shortfall, r.exhausted) for r in report.collect()}
    assert got == {"a_b": (50, 6, 6, 0, False), "c": (3, 5, 3, 2, True), "none": (0, 0, 0, 0, False)}
    first = sorted(tuple(r) for r in sample.collect())
    assert len(first) == 9 and first == sorted(tuple(r) for r in target_sample.target_sample(df.repartition(7), t)[0].collect())
    none, empty = target_sample.target_sample(df.limit(0), t)
    assert none.count() == 0 and {r.exhausted for r in empty.where("min_rows > 0").collect()} == {True}
    assert target_sample.target_sample(df, t.limit(0))[0].count() == 0


def test_stable_sample_keeps_what_it_had(spark):
    rows = [(i, f"K{i % 300}" if i % 50 else None, "c", "t", i) for i in range(1000)]
    df = spark.createDataFrame(rows, "row_id long, k string, city string, kind string, at long").withColumn("ranked", F.lit("x"))
    kw = {"city": "city", "kind": "kind", "at": "at", "tie": "row_id", "salt": "s"}
    ids = lambda d, rate: {r.k for r in stable_sample.stable_sample_ordered(d.drop("ranked"), "k", rate=rate, **kw).collect()}
    some, every = ids(df.where("at < 400"), 0.3), ids(df.repartition(5), 0.3)
    assert some <= every and every == ids(df, 0.3) and every <= ids(df, 0.6) and 50 < len(every) < 130
    assert ids(df, 0.0) == set() and len(ids(df, 1.0)) == len({r[1] for r in rows if r[1]})
    ranks = sorted(r.ranked for r in stable_sample.stable_sample_ordered(df.drop("ranked"), "k", rate=0.3, **kw).collect())
    assert ranks == list(range(1, len(every) + 1))
    assert stable_sample.stable_sample(df.limit(0), "k", rate=0.5, salt="s").count() == 0
    with pytest.raises(ValueError):
        stable_sample.stable_sample(df, "k", rate=1.5, salt="s")
