"""Files around the tables: archives, run artifacts, contracts, provenance, reports; sharded and all-or-nothing writes.

Everything here lists names or reads small files on the driver; tables are read and written by Spark.
"""

from __future__ import annotations

import glob
import hashlib
import json
import os
import re
from collections.abc import Callable, Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..quality.contract import Contract, Field
from .files import read_text_table, to_json, write_table

TOKEN = "^[0-9a-f]{16}$"


def discover_archives(directories: Sequence[str], pattern: str) -> tuple[list[dict[str, str]], list[str]]:
    """(archives, paths passed over). An archive's name must match the pattern in full; its named groups identify it, and of
    archives with the same groups the one in the first directory wins. Sorted by the groups."""
    found, over = {}, []
    form = re.compile(pattern)
    for d in directories:
        for path in sorted(Path(d).glob("*")) if Path(d).is_dir() else []:
            m = form.fullmatch(path.name)
            if not m or not path.is_file():
                continue
            key = tuple(sorted(m.groupdict().items()))
            if key in found:
                over.append(str(path))
            else:
                found[key] = {**m.groupdict(), "path": str(path)}
    return [found[k] for k in sorted(found)], over


def exactly_one(root: str, pattern: str) -> str:
    """The only file below root that matches; none or several are an error."""
    hits = sorted(glob.glob(os.path.join(root, pattern), recursive=True))
    if len(hits) != 1:
        raise FileNotFoundError(f"{pattern}: {len(hits)} files instead of one below {root}")
    return hits[0]


def load_contract(path: str) -> Contract:
    """A contract from YAML: `fields` (name, dtype, role, model_feature, before_simulation, missing, required), `forbidden`, `keys`.
    Its own rules are checked: a contract with problems is refused."""
    import yaml

    raw = yaml.safe_load(Path(path).read_text())
    c = Contract([Field(**f) for f in raw["fields"]], tuple(raw.get("forbidden", ())), tuple(raw.get("keys", ())))
    if bad := c.check():
        raise ValueError("; ".join(bad))
    return c


def scenario_manifest(spark: SparkSession, path: str, columns: Sequence[str], *, limit: int | None = None) -> DataFrame:
    """A scenario manifest: not empty, required fields not blank, unique scenario_id = log_name:token, a lower-case token of
    16 hex digits, db_file = log_name.db. Any break is an error that names the rule. With `limit` the first rows by id."""
    df = read_text_table(spark, path, list(columns))
    blank = lambda c: F.coalesce(F.btrim(c) == "", F.lit(True))
    rules = {
        "blank": blank("scenario_id") | blank("log_name") | blank("scenario_token") | blank("db_file"), "token": ~F.col("scenario_token").rlike(TOKEN),
        "id": F.col("scenario_id") != F.concat_ws(":", "log_name", "scenario_token"), "file": F.col("db_file") != F.concat("log_name", F.lit(".db")),
    }
    r = df.agg(F.count("*").alias("n"), F.countDistinct("scenario_id").alias("ids"), *[F.count(F.when(F.coalesce(c, F.lit(True)), 1)).alias(k) for k, c in rules.items()]).first()
    bad = [k for k in rules if r[k]] + (["empty"] if not r["n"] else []) + (["repeated id"] if r["ids"] != r["n"] else [])
    if bad:
        raise ValueError(f"manifest {path}: {', '.join(bad)}")
    return df.orderBy("scenario_id").limit(limit) if limit else df


def of_keys(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The rows with a key of the list: a semi join, so there is no limit to the list. Spark broadcasts it if it is small."""
    return df.join(keys.select(on).distinct(), on, "left_semi")


def dimension_from_json(spark: SparkSession, path: str, entries: str, key: str, value: str) -> DataFrame:
    """(key, value) rows from a provenance file that maps names to lists, {entries: {value: [key, ...]}}; refused unless
    its `complete` is true."""
    raw = json.loads(Path(path).read_text())
    if raw.get("complete") is not True:
        raise ValueError(f"{path}: not complete")
    rows = [(k, v) for v, keys in sorted(raw[entries].items()) for k in keys]
    return spark.createDataFrame(rows, f"`{key}` string, `{value}` string")


def load_shards(spark: SparkSession, folder: str) -> DataFrame:
    """All shards there are below the folder, not only those of the last run."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(folder)


def load_contracted(spark: SparkSession, paths: Mapping[str, str], contract: Contract, *, required: bool = True) -> dict[str, DataFrame]:
    """Per source its keys, declared columns and their _missing flags, nothing else, so that only these are read. Required
    fields that no source has are an error, found from the schemas alone."""
    names = {f.name for f in contract.fields}
    out = {}
    for source, path in paths.items():
        df = spark.read.parquet(path)
        out[source] = df.select(*[c for c in df.columns if c in contract.keys or c in names or (c.endswith("_missing") and c[:-8] in names)])
    have = {c for df in out.values() for c in df.columns}
    if required and (lack := [f.name for f in contract.fields if f.required and f.name not in have]):
        raise ValueError(f"no source has {lack}")
    return out


def load_modeling_table(spark: SparkSession, path: str, required: Sequence[str], fold: str = "fold") -> tuple[DataFrame, dict]:
    """(table, provenance beside it). Required columns must be there, and at least two folds."""
    df = spark.read.parquet(path)
    if lack := [c for c in required if c not in df.columns]:
        raise ValueError(f"{path}: columns are missing: {lack}")
    if df.select(fold).where(F.col(fold).isNotNull()).distinct().limit(2).count() < 2:
        raise ValueError(f"{path}: fewer than two folds")
    return df, read_provenance(spark, path)


def read_provenance(spark: SparkSession, path: str) -> dict:
    try:
        return json.loads(spark.read.text(path.rstrip("/") + ".provenance", wholetext=True).first()[0])
    except Exception as e:
        raise FileNotFoundError(f"{path}: no provenance beside it") from e


def provenance(inputs: Mapping[str, str], parameters: Mapping[str, object], counts: Mapping[str, DataFrame], outputs: Mapping[str, str] = {}, *, most_rows: int = 10_000) -> dict:
    """What a result was made of: digests of input and output files, parameters, small aggregates (their size is checked)."""
    small = {}
    for name, df in counts.items():
        rows = df.orderBy(*[c for c in df.columns]).limit(most_rows + 1).collect()
        if len(rows) > most_rows:
            raise ValueError(f"{name}: too many rows for a provenance record")
        small[name] = [r.asDict() for r in rows]
    return {"inputs": {k: digest(p) for k, p in inputs.items()}, "parameters": dict(parameters), "counts": small, "outputs": {k: digest(p) for k, p in outputs.items()}}


def digest(path: str) -> str:
    """SHA-256 of a file, or of the names and bytes of a folder's data files in order."""
    h = hashlib.sha256()
    files = [path] if os.path.isfile(path) else sorted(p for p in glob.glob(f"{path}/**", recursive=True) if os.path.isfile(p) and not os.path.basename(p).startswith(("_", ".")))
    for p in files:
        if p != path:
            h.update(os.path.relpath(p, path).encode())
        with open(p, "rb") as f:
            while block := f.read(1 << 20):
                h.update(block)
    return h.hexdigest()


def recorded_digest(record: Mapping, path: str) -> str | None:
    """The digest a provenance record has for a path's name, among inputs or outputs."""
    name = os.path.basename(path)
    return next((part[k] for part in (record.get("outputs", {}), record.get("inputs", {})) for k in part if os.path.basename(k) == name), None)


def write_shards(parts: Mapping[str, Callable[[], DataFrame]], folder: str) -> dict[str, str]:
    """One table per part below the folder. Parts that are there are skipped, so a broken run is resumed; a part that fails is
    left out and noted in failures.json, and the others go on. Returns the failures."""
    failed = {}
    for name, make in parts.items():
        path = os.path.join(folder, name)
        if os.path.exists(os.path.join(path, "_SUCCESS")):
            continue
        try:
            make().write.mode("overwrite").parquet(path)
        except Exception as e:  # noqa: BLE001
            failed[name] = (str(e).splitlines() or [""])[0][:200]
    Path(folder).mkdir(parents=True, exist_ok=True)
    Path(folder, "failures.json").write_text(to_json(failed))
    return failed


def guard_paths(outputs: Sequence[str], protected: Sequence[str]) -> None:
    """Refuses outputs that exist, that lie in a protected folder, or that contain one."""
    for o in map(os.path.abspath, outputs):
        if os.path.exists(o):
            raise FileExistsError(o)
        for p in map(os.path.abspath, protected):
            if os.path.commonpath([o, p]) in (o, p):
                raise PermissionError(f"{o} is protected by {p}")


def write_all(tables: Mapping[str, DataFrame], folder: str, checks: DataFrame | None = None, record: Mapping | None = None, protected: Sequence[str] = ()) -> None:
    """All tables or none: checks must hold first, every table is written to a staging folder, and one rename publishes them;
    the provenance is the last thing in it. Several subsets of one frame are several tables."""
    guard_paths([folder], protected)
    if checks is not None and (bad := [r["check"] for r in checks.where("status = 'FAIL'").limit(20).collect()]):
        raise ValueError(f"checks failed: {bad}")
    staging = folder.rstrip("/") + ".staging"
    if os.path.exists(staging):
        raise FileExistsError(staging)
    for name, df in tables.items():
        write_table(df, os.path.join(staging, name))
    Path(staging, "provenance.json").write_text(to_json(dict(record or {})))
    os.rename(staging, folder)


def report_text(title: str, sections: Mapping[str, DataFrame], *, most_rows: int = 1_000) -> str:
    """A report of small tables in Markdown; nulls are blank. Longer tables are refused."""
    lines = [f"# {title}"]
    for name, df in sections.items():
        rows = df.limit(most_rows + 1).collect()
        if len(rows) > most_rows:
            raise ValueError(f"{name}: too long for a report")
        cells = [[("" if v is None else str(v)).replace("|", "\\|") for v in r] for r in rows]
        lines += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *["| " + " | ".join(r) + " |" for r in cells]]
    return "\n".join(lines) + "\n"


def experiment_record(runs: Sequence[Mapping], table: str, same: Sequence[str] = ("config", "packages", "manifest")) -> dict:
    """The record of an experiment from the manifests of its runs; runs that differ in what must be the same are refused."""
    if not runs:
        raise ValueError("no runs")
    for key in same:
        if len({to_json(r.get(key)) for r in runs}) != 1:
            raise ValueError(f"runs differ in {key}")
    ids = [r["run_id"] for r in runs]
    if len(set(ids)) != len(ids):
        raise ValueError("a run is named twice")
    return {"table": table, "digest": digest(table), "runs": sorted(ids), "arms": sorted({r["planner"] for r in runs}), **{k: runs[0].get(k) for k in same}}


def reconcile_listing(listed: DataFrame, found: DataFrame, key: str = "name", size: str = "size") -> DataFrame:
    """(name, listed_size, found_size, status): every listed file against those found: ok, missing, other size or extra."""
    a, b = listed.select(key, F.col(size).alias("listed_size")), found.select(key, F.col(size).alias("found_size"))
    status = F.when(F.col("found_size").isNull(), "missing").when(F.col("listed_size").isNull(), "extra").when(F.col("listed_size") != F.col("found_size"), "other size").otherwise("ok")
    return a.join(b, key, "full_outer").select(key, "listed_size", "found_size", status.alias("status"))
