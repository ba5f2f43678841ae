"""Problems 1, 4 and 7: brute force on small inputs, and the odd cases."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from loomyard.operators.asof import asof_backward
from loomyard.operators.intervals import IntervalMap, merge_intervals
from loomyard.operators.orphans import contiguous_runs, dangling_references
from loomyard.operators.packed import explode_packed, split_packed


def merged(rows, join=0):
    by = {}
    for e, s, t in rows:
        if e is not None and s is not None and t is not None and (t >= s if join else t > s):
            by.setdefault(e, []).append((s, t))
    out = []
    for e, xs in by.items():
        cur = None
        for s, t in sorted(xs):
            if cur and s <= cur[1] + join:
                cur[1] = max(cur[1], t)
            else:
                if cur:
                    out += [(e, "period", *cur), (e, "gap", cur[1], s)]
                cur = [s, t]
        out.append((e, "period", *cur))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("join", [0, 1])
def test_periods_equal_brute_force_for_any_bucket(spark, seed, join):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "a", "a", "b", "c", None]), rng.choice([None, *range(-60, 60)]), 0) for _ in range(80)]
    rows = [(e, s, None if rng.random() < 0.05 else (s or 0) + rng.choice([-3, 0, 1, 2, 5, 40])) for e, s, _ in rows]
    rows += rows[:10]
    df = spark.createDataFrame(rows, "e string, s long, t long")
    for width in (3, 17, 1000):
        got = sorted(tuple(r) for r in merge_intervals(df, "e", "s", "t", bucket_width=width, join=join).collect())
        assert got == merged(rows, join)


def test_interval_map_keeps_order_and_gaps():
    m = IntervalMap()
    for s, t in ((5, 7), (1, 2), (2, 3), (9, 12), (6, 10)):
        m.add(s, t)
    assert (m.starts, m.ends, m.gaps()) == ([1, 5], [3, 12], [(3, 5)])


@pytest.mark.parametrize("join", [0, 1])
def test_interval_map_takes_batches_in_any_order(join):
    rng = random.Random(join)
    for _ in range(300):
        rows = [(s, s + rng.randrange(1, 9)) for s in (rng.randrange(60) for _ in range(rng.randrange(30)))]
        m, left = IntervalMap(join), list(rows)
        while left:
            n = rng.randrange(1, 7)
            m.insert(np.array([s for s, _ in left[:n]]), np.array([t for _, t in left[:n]]))
            left = left[n:]
        assert list(zip(m.starts, m.ends)) == [(s, t) for _, k, s, t in merged([("e", *r) for r in rows], join) if k == "period"]


def test_periods_of_an_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], "e string, b long, s long, t long, kind string")
    assert merge_intervals(empty, "e", "s", "t").count() == 0
    df = spark.createDataFrame([("x", 1, 0, 9, "own")], "e string, b long, s long, t long, kind string")
    assert [tuple(r) for r in merge_intervals(df, "e", "s", "t").collect()] == [("x", "period", 0, 9)]


@pytest.mark.parametrize("seed", range(3))
def test_asof_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    left = [(i, rng.choice(["a", "a", "b", None]), rng.choice([None, *range(-20, 40)])) for i in range(60)]
    right = [(rng.choice(["a", "b", "z", None]), rng.randrange(-30, 40), rng.randrange(100)) for _ in range(25)]
    l, r = spark.createDataFrame(left, "id long, e string, u long"), spark.createDataFrame(right, "e string, u long, v long")
    got = {x.id: x.asof_v for x in asof_backward(l, r, "e", "u", "u", ["v"], bucket_width=rng.choice([5, 1000])).collect()}
    assert len(got) == len(left)
    for i, e, u in left:
        best = max(((b, v) for a, b, v in right if a == e and e is not None and u is not None and b <= u), default=(0, None))
        assert got[i] == best[1]


def test_runs_compress_and_references_beyond_their_end_dangle(spark):
    parents = spark.createDataFrame([("t", k) for k in (1, 2, 3, 7, 7, 8, None)] + [(None, 4)], "e string, k long")
    runs = contiguous_runs(parents, "e", "k")
    assert sorted((r.run_start, r.run_end) for r in runs.collect()) == [(1, 3), (7, 8)]
    kids = spark.createDataFrame([(i, "t", k) for i, k in enumerate((0, 1, 3, 4, 6, 7, 8, 9, 3))] + [(90, None, 1), (91, "t", None)], "id long, e string, k long")
    assert sorted(r.id for r in dangling_references(kids, runs, "e", "k").collect()) == [0, 3, 4, 7, 90, 91]
    assert dangling_references(kids.limit(0), runs, "e", "k").count() == 0
    assert dangling_references(kids, runs.limit(0), "e", "k").count() == 11


def test_p1_lists_late_deleted_missing_and_miscounted(spark, tmp_path):
    ts = "cast('2024-01-%s' as timestamp)"
    spark.sql(f"select * from values (' S1', {ts % '05'}, cast(null as timestamp)), ('s2', {ts % '01'}, {ts % '03'}), ('s2', {ts % '06'}, null) t(scenario_id, ingested_at, deleted_at)").write.parquet(f"{tmp_path}/scenario_sample.parquet")
    spark.sql(f"select * from values (1L, 's1 ', 'R1', false, {ts % '05'}), (2L, 's1', 'r1', false, {ts % '04'}), (3L, 's2', 'r1', false, {ts % '03'}), (4L, 'S2', 'r9', true, {ts % '07'}), (5L, null, null, false, {ts % '07'}) t(outcome_id, scenario_id, run_id, succeeded, recorded_at)").write.parquet(f"{tmp_path}/planner_outcome.parquet")
    spark.sql(f"select * from values (1L, 'r1 ', 2L, {ts % '08'}), (2L, 'r1', 3L, {ts % '08'}), (3L, 'r2', 0L, {ts % '08'}), (4L, 'r2', 1L, {ts % '08'}), (5L, 'r3', null, {ts % '08'}) t(result_id, run_id, failed, finished_at)").write.parquet(f"{tmp_path}/run_result.parquet")
    from loomyard.queries.problems import p1_found

    got = sorted(tuple(r) for r in p1_found(spark, str(tmp_path)).collect())
    assert got == [("planner_outcome", 2, "scenario_id"), ("planner_outcome", 3, "scenario_id"), ("planner_outcome", 4, "run_id"), ("run_result", 2, "failed"), ("run_result", 4, "failed")]


TAG = re.compile(r"'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|\w+")


def tags(text):
    out = []
    for m in TAG.findall(text):
        out.append(m[1:-1].replace(m[0] * 2, m[0]) if m[0] in "'\"" else m)
    return out


@pytest.mark.parametrize("seed", range(30))
def test_packed_fields_equal_a_sequential_scan(seed):
    rng = random.Random(seed)
    parts = ["a", "bc_1", "é9", "'", '"', "''", '""', "|", ", ", ";", " ", "\n", "–", "'x, y'", '"p ""q"" r"', "日本"]
    rows = ["".join(rng.choice(parts) for _ in range(rng.randrange(9))) for _ in range(40)] + [None, ""]
    keep, lists = split_packed(pa.array(rows))
    assert [rows[i] for i in keep] == [r for r in rows if r is not None]
    assert lists.to_pylist() == [tags(r) for r in rows if r is not None]


def test_packed_rows_in_spark(spark):
    long = "t," * 300_000
    rows = [(1, "a|'b, c'|a", "x"), (1, "a|'b, c'|a", "x"), (2, None, "x"), (3, "", "x"), (4, long, "x")]
    df = spark.createDataFrame(rows, "id long, f string, position string")
    got = explode_packed(df, "f", ["id"])
    assert got.where("id = 4").count() == 300_000
    assert sorted(tuple(r) for r in got.where("id < 4").collect()) == sorted([(1, 1, "a"), (1, 2, "b, c"), (1, 3, "a")] * 2)
    assert explode_packed(df.limit(0), "f", ["id"]).count() == 0
