"""Files around the tables."""

import json

import pytest
from pyspark.sql import functions as F

from loomyard.operators import assembly as A
from loomyard.operators import describe as D
from loomyard.quality import expectations as E
from loomyard.quality import policy
from loomyard.quality.contract import Contract, Field
from loomyard.sources import artifacts as X


def test_archives_and_single_files(tmp_path):
    for d, names in (("a", ["log_north_1.zip", "other.txt"]), ("b", ["log_north_1.zip", "log_south_2.zip"])):
        (tmp_path / d).mkdir()
        for n in names:
            (tmp_path / d / n).write_text(n)
    found, over = X.discover_archives([str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "none")], r"log_(?P<city>[a-z]+)_(?P<part>\d+)\.zip")
    assert [(f["city"], f["part"], f["path"].split("/")[-2]) for f in found] == [("north", "1", "a"), ("south", "2", "b")] and len(over) == 1
    assert X.exactly_one(str(tmp_path), "a/*.txt").endswith("other.txt")
    with pytest.raises(FileNotFoundError):
        X.exactly_one(str(tmp_path), "*/*.zip")


def test_contract_from_yaml_and_contracted_load(spark, tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text("keys: [k]\nforbidden: [score]\nfields:\n  - {name: speed, dtype: double, model_feature: true}\n  - {name: lane, dtype: string, required: false}\n")
    c = X.load_contract(str(path))
    assert c.features() == ["speed"] and c.keys == ("k",)
    spark.range(3).selectExpr("id AS k", "id * 1.0D AS speed", "false AS speed_missing", "'x' AS undeclared").write.parquet(str(tmp_path / "t"))
    out = X.load_contracted(spark, {"t": str(tmp_path / "t")}, c)
    assert out["t"].columns == ["k", "speed", "speed_missing"]
    path.write_text("fields:\n  - {name: a, dtype: double, role: nonsense}\n")
    with pytest.raises(ValueError, match="unknown role"):
        X.load_contract(str(path))
    with pytest.raises(ValueError, match="no source has"):
        X.load_contracted(spark, {"t": str(tmp_path / "t")}, Contract([Field("absent", "double")]))


def test_scenario_manifest_rules(spark, tmp_path):
    t = "0123456789abcdef"
    head, good = "scenario_id,log_name,scenario_token,db_file\n", f"l:{t},l,{t},l.db\n"
    path = tmp_path / "m.csv"
    columns = ["scenario_id", "log_name", "scenario_token", "db_file"]
    path.write_text(head + good)
    assert X.scenario_manifest(spark, str(path), columns, limit=1).count() == 1
    for bad, why in ((head, "empty"), (head + good + good, "repeated"), (head + f"l:{t.upper()},l,{t.upper()},l.db\n", "token"), (head + f"x:{t},l,{t},l.db\n", "id"), (head + f"l:{t},l,{t},m.db\n", "file"), (head + f"l:{t},l,{t},\n", "blank")):
        path.write_text(bad)
        with pytest.raises(ValueError, match=why):
            X.scenario_manifest(spark, str(path), columns)


def test_all_or_nothing_shards_and_provenance(spark, tmp_path):
    df = spark.range(10).selectExpr("id", "id % 2 AS fold")
    ok, bad = E.report([("n", lambda: E.holds(df, "n", F.col("id") >= 0))], spark), E.report([("n", lambda: E.holds(df, "n", F.col("id") > 0))], spark)
    out = str(tmp_path / "out")
    with pytest.raises(ValueError, match="checks failed"):
        X.write_all({"t": df}, out, bad)
    assert not (tmp_path / "out").exists()
    record = X.provenance({}, {"seed": 7}, {"folds": df.groupBy("fold").count()})
    X.write_all({"t": df, "even": df.where("fold = 0")}, out, ok, record)
    assert json.loads((tmp_path / "out" / "provenance.json").read_text())["counts"]["folds"] == [{"count": 5, "fold": 0}, {"count": 5, "fold": 1}]
    assert spark.read.parquet(out + "/even").count() == 5
    with pytest.raises(FileExistsError):
        X.write_all({"t": df}, out)
    with pytest.raises(PermissionError):
        X.guard_paths([str(tmp_path / "safe" / "x")], [str(tmp_path / "safe")])
    made = []

    def part(n):
        def run():
            made.append(n)
            return df.where(F.col("fold") == n) if n < 2 else df.select(F.raise_error(F.lit("broken")))

        return run

    parts = {f"p{n}": part(n) for n in range(3)}
    assert list(X.write_shards(parts, str(tmp_path / "s"))) == ["p2"] and made == [0, 1, 2]
    assert list(X.write_shards(parts, str(tmp_path / "s"))) == ["p2"] and made == [0, 1, 2, 2]
    assert X.load_shards(spark, str(tmp_path / "s")).count() == 10
    assert json.loads((tmp_path / "s" / "failures.json").read_text())["p2"]
    a = X.digest(str(tmp_path / "out"))
    assert a == X.digest(str(tmp_path / "out")) and X.recorded_digest({"outputs": {"x/t.csv": "h"}}, "y/t.csv") == "h" and X.recorded_digest({}, "t") is None


def test_tables_dimensions_reports_and_listings(spark, tmp_path):
    from loomyard.sources.files import write_table

    df = spark.range(4).selectExpr("id", "id % 2 AS fold")
    write_table(df, str(tmp_path / "t"), {"seed": 1})
    assert X.load_modeling_table(spark, str(tmp_path / "t"), ["id"])[1] == {"seed": 1}
    write_table(df.withColumn("fold", F.lit(0)), str(tmp_path / "u"))
    for args in ((str(tmp_path / "u"), ["id"]), (str(tmp_path / "t"), ["x"])):
        with pytest.raises(ValueError):
            X.load_modeling_table(spark, *args)
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"complete": True, "logs": {"north": ["a", "b"], "south": ["c"]}}))
    assert {tuple(r) for r in X.dimension_from_json(spark, str(p), "logs", "log", "city").collect()} == {("a", "north"), ("b", "north"), ("c", "south")}
    p.write_text(json.dumps({"complete": False, "logs": {}}))
    with pytest.raises(ValueError):
        X.dimension_from_json(spark, str(p), "logs", "log", "city")
    assert "| 1 | 1 |" in X.report_text("R", {"t": df})
    run = {"run_id": "r1", "planner": "a", "config": 1, "packages": [], "manifest": "m"}
    assert X.experiment_record([run, {**run, "run_id": "r2", "planner": "b"}], str(p))["arms"] == ["a", "b"]
    with pytest.raises(ValueError, match="differ in config"):
        X.experiment_record([run, {**run, "run_id": "r2", "config": 2}], str(p))
    names = lambda rows: spark.createDataFrame(rows, "name string, size long")
    got = {r["name"]: r.status for r in X.reconcile_listing(names([("a", 1), ("b", 2), ("c", 3)]), names([("a", 1), ("b", 9), ("d", 4)])).collect()}
    assert got == {"a": "ok", "b": "other size", "c": "missing", "d": "extra"}
    assert X.of_keys(df, spark.range(2), "id").count() == 2


def test_checked_joins_and_encodings(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    twice = a.unionByName(a.limit(1))
    assert A.join_one_to_one(a, a.withColumnRenamed("v", "w"), ["k"]).count() == 2
    for f in (lambda: A.join_one_to_one(a, twice.withColumnRenamed("v", "w"), ["k"]), lambda: A.join_many_to_one(a, twice.withColumnRenamed("v", "w"), ["k"]), lambda: A.align(a, twice.withColumnRenamed("v", "w"), "k", "w")):
        with pytest.raises(Exception, match="not unique"):
            f().collect()
    assert A.join_many_to_one(twice, a.withColumnRenamed("v", "w"), ["k"]).count() == 3
    b = spark.createDataFrame([(1, "x", 0.5), (2, "z", 0.1)], "k int, v string, s double")
    with pytest.raises(Exception, match="identity differs"):
        A.join_checked(a, b, "k", ["v"]).collect()
    with pytest.raises(Exception, match="not covered"):
        A.join_checked(a, b.limit(1), "k", []).collect()
    with pytest.raises(Exception, match="no prediction"):
        A.align(a, b.limit(1), "k", "s").collect()
    with pytest.raises(Exception, match="no row"):
        A.align(a.limit(1), b, "k", "s").collect()
    assert A.align(a, b, "k", "s").count() == 2
    f = A.frame({"p": a, "q": a.limit(1)}, {"b": b.select("k", "s")}, "k")
    assert sorted((r.subset, r.k, r.s) for r in f.collect()) == [("p", 1, 0.5), ("p", 2, 0.1), ("q", 1, 0.5)]
    m = A.model_frame(spark.createDataFrame([(1, True, None, 2.5)], "id int, b boolean, c string, d double"), ["b", "c", "d"]).first()
    assert (m.id, m.b, m.c, m.d) == (1, 1.0, "__missing__", 2.5)
    one = spark.createDataFrame([("a", "front", 1), ("b", "front", 2), ("b", "rear", 3)], "g string, c string, v int")
    assert {(r.g, r.v) for r in A.singleton(one, ["g"], "c", "front", ["v"]).collect()} == {("a", 1), ("b", 2)}
    with pytest.raises(Exception, match="no single row"):
        A.singleton(one, ["g"], "c", "top", ["v"]).collect()
    n = spark.createDataFrame([([("7", "a"), (None, "b")],), (None,)], "r array<struct<key: string, x: string>>")
    assert [[tuple(x) for x in r.n] for r in n.select(A.normal_records(F.col("r"), "key", "x").alias("n")).collect()] == [[("7", "a")], []]
    g = spark.createDataFrame([(0.0, 1.0), (1.0, 0.5), (1.0, 1.0), (None, None)], "a double, c double")
    assert [r[0] for r in g.select(A.gated(["a"], "c")).collect()] == [True, True, False, False]
    kept, rest = A.split_by_null(g, "a")
    assert (kept.count(), rest.count()) == (3, 1) and A.conform(a, {"w": "v", "k": "k"}, run="r").columns == ["w", "k", "run"]
    d = {(r.k, r["column"]): (r.left, r.right) for r in A.disagreements(a, b.where("k = 2"), "k", ["v"]).collect()}
    assert d == {(1, "v"): ("x", "<absent>"), (2, "v"): ("y", "z")}


def test_policies_and_descriptions_of_odd_tables(spark):
    c = Contract([Field("m", "double", missing="exclude_pair"), Field("e", "string", missing="not_applicable_when_succeeded"), Field("f", "double", missing="null_with_indicator"), Field("k", "string", missing="fail_validation"), Field("u", "string", missing="constant_from_metadata")])
    rows = [(1.0, None, None, "a", None, True), (None, "x", 1.0, "b", "v", False), (2.0, None, 2.0, "c", "v", False)]
    df = spark.createDataFrame(rows, "m double, e string, f double, k string, u string, ok boolean")
    assert {r["column"]: r.n_missing for r in policy.summary(df, c, succeeded="ok").collect()} == {"m": 1, "e": 1, "f": 1, "k": 0, "u": 1}
    out = policy.apply(df, c, succeeded="ok", constants={"u": "w"}).collect()
    assert [(r.k, r.u, r.f_missing) for r in sorted(out, key=lambda r: r.k)] == [("a", "w", True), ("c", "v", False)]
    with pytest.raises(Exception, match="k: missing"):
        policy.apply(df.withColumn("k", F.lit(None).cast("string")), c).collect()
    e = df.limit(0)
    assert D.value_counts(e, ["k"]).count() == 0 and D.percentiles(e, ["k"], "m", [0.5]).count() == 0 and D.cumulative_share(e, ["k"], "m", "f").count() == 0
    assert [tuple(r) for r in D.variance_within(e, ["k"], "m").collect()] == [(0, 0, None, None)] and D.decompose(e, "m", {"x": F.col("ok")}).count() == 0
    assert {(r["part"], r.n) for r in D.decompose(df, "f", {"x": F.col("ok"), "y": F.col("m").isNull()}).collect()} == {("x", 1), ("y", 1), ("rest", 1)}


def test_permutation_test_equals_brute_force(spark):
    import numpy as np

    from loomyard.metrics import evaluation as V

    x, g = [0.1, 0.2, 0.15, 0.9, 0.8, 0.95, 0.5], list("aaabbbc")
    r = V.permutation_test(spark.createDataFrame(list(zip(g, x)), "g string, v double"), "g", "v", draws=300, seed=5).first()
    order = sorted(zip(g, x))
    code, v = np.unique([a for a, _ in order], return_inverse=True)[1], np.array([b for _, b in order])
    within = lambda y: float(np.mean([y[code == k].var() for k in range(3)]))
    hits = sum(within(np.random.default_rng([5, k]).permutation(v)) <= within(v) + 1e-12 for k in range(300))
    assert (r.n, r.observed, r.p) == (7, pytest.approx(within(v)), pytest.approx((1 + hits) / 301))
    assert V.permutation_test(spark.createDataFrame([], "g string, v double"), "g", "v").count() == 0


def test_permutation_test_beyond_the_rows_that_a_task_holds(spark):
    import numpy as np

    from loomyard.metrics import evaluation as V

    rng = np.random.default_rng(2)
    g = np.repeat(list("abc"), [300, 500, 400])
    for shift in (0.0, 0.06, 0.5):
        x = np.where(rng.random(1200) < 0.3, 0.0, np.round(rng.random(1200), 3)) + shift * (g == "b")
        df = spark.createDataFrame(list(zip(g.tolist(), x.tolist())), "g string, v double")
        whole, spread = (V.permutation_test(df, "g", "v", draws=2_000, most_rows=m).first() for m in (2_000, 100))
        assert spread.n == 1200 and spread.observed == pytest.approx(whole.observed) and spread.p == pytest.approx(whole.p, abs=0.06)
    # Many chunks deal out every row once, and a group of the chunk has its share.
    size, upto = np.array([300, 500, 400]), np.array([0, 100, 350, 360, 900, 1200])
    parts = [V._rows_in_chunk(size, upto, c, 4_000, 7, 0) for c in range(5)]
    assert (sum(parts) == size).all() and all((p.sum(axis=1) == b - a).all() for p, a, b in zip(parts, upto, upto[1:]))
    assert parts[3].mean(axis=0) == pytest.approx(size * 540 / 1200, rel=0.02)
    near = V._shared_out(np.random.default_rng(1), np.tile(size, (4_000, 1)), 540, exact=1)
    assert near.mean(axis=0) == pytest.approx(size * 0.45, rel=0.02) and near.std(axis=0) == pytest.approx(parts[3].std(axis=0), rel=0.1)


def test_map_layers_and_their_coordinate_system(spark, tmp_path):
    import sqlite3
    import struct

    from loomyard.operators.spatial import map_features, points_in_polygons
    from loomyard.sources.geometry import load_map, projected_crs

    def blob(ring):
        wkb = struct.pack("<BIII", 1, 3, 1, len(ring)) + b"".join(struct.pack("<dd", *p) for p in ring)
        return b"GP\0\x01" + struct.pack("<i", 0) + wkb

    for name, crs in (("a.gpkg", "EPSG:32617"), ("b.gpkg", "EPSG:32617")):
        con = sqlite3.connect(tmp_path / name)
        con.execute("CREATE TABLE meta (key TEXT, value TEXT)")
        con.execute("INSERT INTO meta VALUES ('projectedCoordSystem', ?)", (crs,))
        con.execute("CREATE TABLE lanes (fid INTEGER, geom BLOB)")
        con.execute("CREATE TABLE connectors (fid INTEGER, exit INTEGER, geom BLOB)")
        if name == "a.gpkg":
            con.execute("INSERT INTO lanes VALUES (1, ?)", (blob([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]),))
            con.execute("INSERT INTO connectors VALUES (7, 1, ?)", (blob([(10, 0), (14, 0), (14, 4), (10, 0)]),))
        con.commit()
        con.close()
    path = str(tmp_path / "*.gpkg")
    assert projected_crs(spark, path) == "EPSG:32617"
    edges, links = load_map(spark, path, {"lanes": "fid", "connectors": "fid"}, ("connectors", "exit", "fid"))
    assert [tuple(r) for r in links.collect()] == [(1, 7)] and edges["lanes"].count() == 4
    pts = spark.createDataFrame([(1, 2.0, 4.0, "t"), (2, 13.5, 1.0, None), (3, 50.0, 50.0, "t"), (4, None, 1.0, "t")], "id int, x double, y double, token string")
    hits = {n: points_in_polygons(pts, e, key="id", x="x", y="y", cell=3.0) for n, e in edges.items()}
    lights = spark.createDataFrame([(1, "green"), (1, "red"), (2, "red"), (3, "odd"), (4, "red")], "id int, state string")
    got = {r.id: (r.lanes_ids, r.connectors_ids, r.place, r.light) for r in map_features(pts, hits, lights, key="id", located=F.col("x").isNotNull(), tokened=F.col("token").isNotNull(), order=["red", "green"]).collect()}
    assert got == {1: ("1", "", "lanes", "red"), 2: ("", "7", "connectors", None), 3: ("", "", "off the map", "unknown"), 4: (None, None, None, None)}
    con = sqlite3.connect(tmp_path / "c.gpkg")
    con.execute("CREATE TABLE meta (key TEXT, value TEXT)")
    con.execute("INSERT INTO meta VALUES ('projectedCoordSystem', 'EPSG:1')")
    con.commit()
    con.close()
    with pytest.raises(ValueError, match="2 coordinate systems"):
        projected_crs(spark, path)


def test_layouts_keep_null_groups_and_every_row(spark):
    from loomyard.operators import ranking as R
    from loomyard.operators import temporal as T

    rows = [(g, i, i * i % 11) for g in ("a", None) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, i int, v int")
    want = {(g, i): (i + 1, (i - 1) ** 2 % 11 if i else None, max((j * j % 11 for j in range(i)), default=None)) for g, i, _ in rows}
    out = R.greatest_before(R.previous(R.positions(df, ["g"], [F.col("i")], name="p"), ["g"], ["i"], "v", "before"), ["g"], ["i"], "v", "top")
    assert {(r.g, r.i): (r.p, r.before, r.top) for r in out.collect()} == want
    sums = {r.i: r.s for r in T.rolling_sum(df.where("g = 'a'"), [], "i", "v", 3, "s").collect()}
    assert sums == {i: None if i < 2 else sum(j * j % 11 for j in (i - 2, i - 1, i)) for i in range(40)}
    assert R.positions(df.limit(0), [], [F.col("i")]).count() == 0
