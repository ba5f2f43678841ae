"""References to records that do not exist (problem 1).

Method: the integer keys that exist per entity are compressed into contiguous runs; a reference is matched as of its key
to the preceding run start and is dangling if there is none or it lies beyond that run's end. With time as the integer
key a run is a stretch in which the record exists (delivered, not deleted), so late and deleted parents are the same test.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .asof import asof_backward
from .intervals import merge_intervals

LONG_MIN, LONG_MAX = -(2**62), 2**62


def contiguous_runs(parents: DataFrame, entity: str, first: str, last: str | None = None, *, bucket_width: int = 2**40) -> DataFrame:
    """(entity, run_start, run_end), inclusive: keys first..last of each row, joined where they overlap or follow on.

    `last` None means single keys. Null entities and keys and rows with last < first give no key.
    """
    runs = parents.select(F.col(entity).alias("entity"), F.col(first).alias("a"), F.col(last or first).alias("z"))
    out = merge_intervals(runs, "entity", "a", "z", bucket_width=bucket_width, join=1)
    return out.where("kind = 'period'").select(F.col("entity").alias(entity), F.col("start").alias("run_start"), F.col("end").alias("run_end"))


def dangling_references(children: DataFrame, runs: DataFrame, entity: str, key: str, *, bucket_width: int = 2**40) -> DataFrame:
    """The rows of `children` whose (entity, key) lies in no run; `runs` come from contiguous_runs.

    A null entity or key is in no run, so such a row is dangling; leave those out first that aren't references.
    Repeated rows are each reported. Columns and rows of `children` come back as they are.
    """
    hit = asof_backward(children, runs, entity, key, "run_start", ["run_end"], bucket_width=bucket_width, prefix="__asof_")
    beyond = F.col("__asof_run_end").isNull() | (F.col(f"`{key}`") > F.col("__asof_run_end"))
    return hit.where(beyond).drop("__asof_run_end")


def dangling_by_period(found: DataFrame, table: str, ref: str, when: str) -> DataFrame:
    """Counts per table, reference and month of `when` (null month for rows without a time)."""
    return found.groupBy(table, ref, F.date_format(F.col(when), "yyyy-MM").alias("month")).agg(F.count("*").alias("n_dangling"))
