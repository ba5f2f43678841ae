"""Core operators against naive models."""

import random
import sqlite3
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from loomyard.functions.keys import WHITE_SPACE, norm_category, norm_key
from loomyard.metrics import evaluation as V
from loomyard.metrics import uplift as U
from loomyard.operators import flags, pairing, sampling
from loomyard.operators.ranking import positions, ranked_by_hash
from loomyard.plans.explain import plan_facts
from loomyard.quality import cleaning, expectations
from loomyard.quality.contract import Contract, Field, integrate
from loomyard.sources import files, geometry
from loomyard.sources.sqlite import SqliteSource


def test_normal_forms(spark):
    df = spark.createDataFrame([(WHITE_SPACE + "Ab C-d ",), ("",), (None,), (" \t",)], "x string")
    assert [tuple(r) for r in df.select(norm_key("x"), norm_category("x")).collect()] == [("ab c-d", "ab_c_d"), ("", None), (None, None), ("", None)]


@pytest.mark.parametrize("seed", range(3))
def test_ranks_and_positions(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", None]), f"{rng.randrange(2**20):05x}" + "0" * 11, i) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, h string, i long")
    want = {}
    for g in ("a", "b", None):
        for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1:]), 1):
            want[r[2]] = n
    assert {r.i: r["rank"] for r in ranked_by_hash(df, ["g"], "h", ["i"], digits=1).collect()} == want
    some = df.where("g is not null")
    assert {r.i: r.pos for r in positions(some, ["g"], [F.col("h"), F.col("i")]).collect()} == {i: n for i, n in want.items() if rows[i][0]}


def greedy(rows, quota=None):
    sizes = {}
    for r in rows:
        sizes[r[0], r[1]] = sizes.get((r[0], r[1]), 0) + 1
    import hashlib

    key = lambda i: hashlib.sha256(f"7:{i}".encode()).hexdigest()[:16]
    held, n, out = {}, {}, set()
    for c, k, s, i, a, z in sorted(rows, key=lambda r: (r[0], sizes[r[0], r[1]], r[1], key(r[3]), r[3])):
        if quota and n.get((c, k), 0) >= quota:
            continue
        if all(not (a < y and x < z) for x, y in held.get((c, s), [])):
            held.setdefault((c, s), []).append((a, z))
            n[c, k] = n.get((c, k), 0) + 1
            out.add(i)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_greedy_acceptance_equals_the_global_loop(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("AB"), rng.choice("xyz"), rng.choice("pqr"), i, s := rng.randrange(120), s + 15) for i in range(150)]
    df = spark.createDataFrame(rows, "c string, k string, s string, i long, a long, z long")
    kw = {"city": "c", "kind": "k", "scope": "s", "start": "a", "end": "z", "key": "i", "seed": 7}
    got = sampling.greedy_ranking(df, bucket_width=40, **kw).collect()
    assert {r.i for r in got} == greedy(rows)
    assert {r.i for r in sampling.quota_sample(df, quota=2, **kw).collect()} == greedy(rows, 2)


def test_split_counts_and_folds(spark):
    assert [sampling.split_counts(n, (0.7, 0.15, 0.15)) for n in (0, 1, 2, 3, 10, 100)] == [[0, 0, 0], [1, 0, 0], [2, 0, 0], [1, 1, 1], [6, 2, 2], [70, 15, 15]]
    assert sampling.split_counts(5, (0.8, 0.2, 0.0)) == [4, 1, 0]
    df = spark.createDataFrame([(u, f"{u}{i}") for u in range(13) for i in range(u % 4 + 1)], "u long, i string")
    folds = sampling.balanced_folds(df, "u", "i", folds=3, seed=0).collect()
    load = [sum(r["size"] for r in folds if r.fold == k) for k in range(3)]
    assert sum(load) == df.count() and max(load) - min(load) <= 4


def test_pairing_rules(spark):
    long = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5), (1, "c", 0.2), (2, "a", 0.1), (2, "b", None), (2, "c", 0.3), (3, "a", 0.0), (3, "b", 0.0), (3, "c", 0.0)], "u long, arm string, v double")
    got = {r.u: r for r in pairing.labels(long, "u", "arm", "v", ["a", "b", "c"], "c").collect()}
    assert set(got) == {1, 3} and got[1].best_arm == "a" and got[3].best_arm == "a" and got[1].delta_b == 0.3
    with pytest.raises(ValueError):
        pairing.normal_arms(["a", "a"], "a", ["a", "b"])
    df = spark.createDataFrame([(float("nan"), 0.2), (-1.0, 0.0), (0.2, 0.2)], "p double, q double")
    choice = [r[0] for r in df.select(pairing.policy_choice({"p": F.col("p"), "q": F.col("q")}, "ctl")).collect()]
    assert choice == ["q", "ctl", "p"]


def test_metric_vector(spark):
    rows = [("t", float(y), float(p), i) for i, (y, p) in enumerate(zip([1, 2, 3, 4], [2, 2, 5, 3]))]
    df = spark.createDataFrame(rows, "t string, y_true double, y_pred double, pos long")
    assert df.agg(U.pehe(), U.mae()).first() == pytest.approx((1.5**0.5, 1.0))
    assert U.spearman(df, ["t"]).first().spearman == pytest.approx(3.5 / 22.5**0.5)
    assert U.qini(df, ["t"]).first().qini == pytest.approx(0.6)
    assert U.topk_recall(df, ["t"], 0.5).first().topk_recall == 1.0 and U.topk_recall(df, ["t"], 0.25).first().topk_recall == 0.0
    assert [r.gain for r in V.running_total(df, ["t"], F.col("y_pred").desc(), "y_true", "gain").orderBy("step").collect()] == [3, 7, 8, 10]
    both = V.metric_bundle(df, ["t"], (0.5, 0.25)).first()
    assert (both.n, both.topk_50, both.topk_25) == (4, 1.0, 0.0) and both.qini == pytest.approx(0.6) and both.pehe == pytest.approx(1.5**0.5)
    with pytest.raises(Exception, match="missing"):
        V.metric_bundle(df.withColumn("y_pred", F.when(F.col("pos") > 0, F.col("y_pred"))), ["t"]).collect()
    flat = df.withColumn("y_pred", F.lit(1.0))
    assert U.spearman(flat, ["t"]).first().spearman is None and U.qini(flat, ["t"]).first().qini is None
    low, high = U.exact_bootstrap(df, "y_true", "pos", draws=200, seed=0)
    assert 1 <= low < 2.5 < high <= 4


def test_ridge_is_the_closed_form(spark):
    import numpy as np

    from loomyard.models import oof

    rng = np.random.default_rng(0)
    x, f = rng.normal(size=60), np.arange(60) % 3
    y = 2 * x + rng.normal(size=60) * 0.1
    df = spark.createDataFrame([(int(i), int(f[i]), float(x[i]), float(y[i])) for i in range(60)], "i long, f long, x double, y double")
    got = {r.id: r.y_pred for r in oof.ridge(df, "y", numeric=["x"], categorical=[], row="i", fold="f").collect()}
    for k in range(3):
        tr, te = f != k, f == k
        z = (x - x[tr].mean()) / x[tr].std()
        b = (z[tr] * (y[tr] - y[tr].mean())).sum() / ((z[tr] ** 2).sum() + 1.0)
        for i in np.flatnonzero(te):
            assert got[i] == pytest.approx(y[tr].mean() + b * z[i], abs=1e-9)
    const = {r.id: r.y_pred for r in oof.constant(df, "y", row="i", fold="f").collect()}
    assert const[0] == pytest.approx(y[f != 0].mean())
    told = {(r.fold, r.feature): r.importance for r in oof.fold_importance(df.withColumn("z", F.col("i") * 0.01), "y", numeric=["x", "z"], categorical=[], row="i", fold="f", repeats=3).collect()}
    assert len(told) == 6 and all(told[k, "x"] > 1 > 0.2 > abs(told[k, "z"]) for k in range(3))
    with pytest.raises(ValueError):
        oof.guard(["ok", "score_a"], ("score",))


def test_boosting_beats_constant_on_a_planted_signal(spark):
    import numpy as np

    from loomyard.models import oof

    rng = np.random.default_rng(1)
    x = rng.normal(size=200)
    df = spark.createDataFrame([(i, i % 2, float(x[i]), float((x[i] > 0) * 1.0)) for i in range(200)], "i long, f long, x double, y double")
    err = lambda d: d.agg(F.avg(F.pow(F.col("y_true") - F.col("y_pred"), 2))).first()[0]
    assert err(oof.boosting(df, "y", numeric=["x"], categorical=[], row="i", fold="f", rounds=5, rate=0.1)) < 0.5 * err(oof.constant(df, "y", row="i", fold="f"))


def test_quality(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, None), (3, "c")], "k long, v string")
    assert sorted(tuple(r) for r in cleaning.duplicate_kinds(df, ["k"], ["v"]).collect()) == [(1, 2, "exact"), (2, 2, "conflict")]
    assert sorted(tuple(r) for r in cleaning.resolve_duplicates(df, ["k"], ["v"]).collect()) == [(1, "a"), (3, "c")]
    rep = expectations.report([("u", lambda: expectations.unique(df, "u", ["k"])), ("x", lambda: 1 / 0), ("d", lambda: expectations.in_domain(df, "d", "v", ["a", "b", "c"]))], spark)
    assert [(r.check, r.status) for r in rep.orderBy("position").collect() if r.check] == [("u", "FAIL"), ("x", "FAIL"), ("d", "PASS")]
    assert expectations.same_rows(df, df.limit(4), "s").first().violations == 1
    c = Contract([Field("a", "double", model_feature=True), Field("y", "double", "outcome", model_feature=True), Field("a", "double")], forbidden=("delta",))
    assert len(c.check()) == 2
    base = spark.createDataFrame([(1,), (2,)], "k long")
    with pytest.raises(Exception, match="key is not unique"):
        integrate(base, {"s": df.select("k", F.col("v").alias("w"))}, "k").collect()
    t = spark.createDataFrame([("12",), ("x",), (" ",), (None,)], "s string").select(flags.typed(F.col("s"), "int").alias("v"), flags.invalid(F.col("s"), "int").alias("bad"))
    assert [r.v for r in t.collect()] == [12, None, None, None]


def test_sqlite_source_reads_archives_and_survives_a_broken_file(spark, tmp_path):
    for n in ("one", "two"):
        con = sqlite3.connect(tmp_path / f"{n}.db")
        con.execute("create table f(token blob, ts int)")
        con.executemany("insert into f values (?, ?)", [(bytes([i]), i) for i in range(5)])
        con.commit()
        con.close()
    with zipfile.ZipFile(tmp_path / "more.zip", "w") as z:
        z.write(tmp_path / "two.db", "in/two.db")
    (tmp_path / "two.db").unlink()
    (tmp_path / "bad.db").write_bytes(b"no database at all, whatever its name says" * 50)
    spark.dataSource.register(SqliteSource)
    df = spark.read.format("sqlitelog").schema("token binary, ts long, log string, error string").option("query", "select token, ts from f").option("paths", f"{tmp_path}/*.db;{tmp_path}/*.zip").load()
    got = df.select(F.lower(F.hex("token")).alias("t"), "ts", "log", "error").collect()
    assert {r.log for r in got} == {"one", "two", "bad"} and sum(r.error is not None for r in got) == 1 and len(got) == 11


def test_geometry_and_projection(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)]
    wkb = struct.pack("<BII", 1, 3, 1) + struct.pack("<I", 4) + b"".join(struct.pack("<dd", *p) for p in ring)
    blob = b"GP\x00\x01" + struct.pack("<i", 0) + wkb
    assert geometry.rings(geometry.strip_header(blob)) == [ring]
    layer = spark.createDataFrame([(1, bytearray(blob)), (2, None), (3, bytearray(b"junk"))], "k long, g binary")
    edges = geometry.polygon_edges_of(layer, "k", "g")
    assert edges.count() == 3
    from loomyard.operators.spatial import points_in_polygons

    pts = spark.createDataFrame([(1, 2.0, 1.0), (2, 1.0, 2.0), (3, 2.0, 2.0), (4, None, 1.0)], "id long, x double, y double")
    assert sorted(r.id for r in points_in_polygons(pts, edges, key="id", x="x", y="y", cell=1.5).collect()) == [1, 3]
    e, n = geometry.utm(F.lit(3.0), F.lit(0.0), 31)
    assert spark.range(1).select(e, n).first() == pytest.approx((500000.0, 0.0), abs=1e-6)
    e, n = geometry.utm(F.lit(3.0), F.lit(45.0), 31)
    assert spark.range(1).select(n).first()[0] == pytest.approx(0.9996 * 4984944.378, abs=0.01)  # length of the meridian to 45 degrees


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, None)], "k long, v string")
    files.write_checked(df, f"{tmp_path}/t")
    with pytest.raises(Exception):  # noqa: B017
        files.write_table(df, f"{tmp_path}/t")
    files.write_table(df, f"{tmp_path}/u", {"rows": 2, "x": float("nan")})
    assert spark.read.text(f"{tmp_path}/u.provenance").first()[0] == '{"rows": 2, "x": null}'
    assert files.csv_bytes(df, ["k"])[0] == b"k,v\n1,\n2,b\n"
    files.update_partitions(df.withColumn("p", F.lit(1)), f"{tmp_path}/p", ["p"])
    files.update_partitions(df.withColumn("p", F.lit(2)), f"{tmp_path}/p", ["p"])
    assert spark.read.parquet(f"{tmp_path}/p").count() == 4


def test_stream_of_interval_maps(spark, tmp_path):
    from loomyard.streaming.intervals import stream_periods

    spark.createDataFrame([("a", 1, 3), ("a", 3, 5), ("a", 9, 10), ("b", 0, 1), (None, 0, 1)], "e string, s long, t long").coalesce(1).write.parquet(f"{tmp_path}/in")
    spark.createDataFrame([("a", 4, 9)], "e string, s long, t long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    src = spark.readStream.schema("e string, s long, t long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = stream_periods(src, "e", "s", "t").writeStream.outputMode("update").format("memory").queryName("maps").option("checkpointLocation", f"{tmp_path}/ck").start()
    q.processAllAvailable()
    q.stop()
    last = {r.e: (r.starts, r.ends) for r in spark.table("maps").orderBy("version").collect()}
    assert last == {"a": ([1], [10]), "b": ([0], [1])}


def test_plans_push_down_and_prune(spark, small):
    from loomyard.sources.tables import table

    f = plan_facts(table(spark, small, "lineitem", "l_orderkey", "l_shipdate").where("l_orderkey < 10"))
    assert f.exchanges == 0 and not f.cartesian and "LessThan(l_orderkey,10)" in f.pushed[0] and "l_tax" not in f.columns[0]


def test_registry_names_match_and_every_query_runs(spark, small):
    from loomyard.queries import registry

    names = registry.queries()
    assert set(registry.oracle_sql()) <= set(names)
    for n, f in names.items():
        if n not in ("ridge_oof",):
            assert f(spark, small).columns, n
