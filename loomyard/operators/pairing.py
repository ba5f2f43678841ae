"""Long outcomes of several arms on the same units, to matched wide rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-9


def normal_arms(arms: Sequence[str], control: str, known: Sequence[str]) -> list[str]:
    """The arms in the order of `known`; unknown, repeated or missing-control lists are refused."""
    if len(set(arms)) != len(arms):
        raise ValueError("an arm is named twice")
    if unknown := set(arms) - set(known):
        raise ValueError(f"unknown arms: {sorted(unknown)}")
    if control not in arms:
        raise ValueError("the control arm is missing")
    return [a for a in known if a in arms]


def slug(arm: str) -> str:
    return "".join(c if c.isalnum() else "_" for c in arm.lower()).strip("_")


def pivot_arms(long: DataFrame, unit: str, arm: str, value: str, arms: Sequence[str]) -> DataFrame:
    """One row per unit with score_<arm> columns; a missing arm is null. The arm list is given, so no job is run for it."""
    wide = long.groupBy(unit).pivot(arm, list(arms)).agg(F.first(value))
    return wide.select(unit, *[F.col(f"`{a}`").alias(f"score_{slug(a)}") for a in arms])


def complete_units(long: DataFrame, unit: str, arm: str, k: int) -> DataFrame:
    """The units that have exactly k different arms."""
    return long.groupBy(unit).agg(F.countDistinct(arm).alias("n")).where(F.col("n") == k).select(unit)


def best_arm(scores: dict[str, Column], tolerance: float = TOLERANCE) -> Column:
    """The first arm, in the given order, within `tolerance` of the row's greatest score; null if all are null."""
    top = F.greatest(*scores.values())
    return reduce(lambda acc, a: acc.when(scores[a] >= top - tolerance, a), list(scores)[1:], F.when(next(iter(scores.values())) >= top - tolerance, next(iter(scores))))


def compare(delta: Column, tolerance: float = TOLERANCE) -> Column:
    return F.when(delta > tolerance, "better").when(delta < -tolerance, "worse").when(delta.isNotNull(), "tie")


def labels(long: DataFrame, unit: str, arm: str, value: str, arms: Sequence[str], control: str) -> DataFrame:
    """Units with all arms: scores, deltas of every other arm against the control, the best arm.

    A unit that lacks an arm, or has a null score in one, is left out for all arms. Rows with other arms are ignored. Of
    repeated rows of one unit and arm any one is taken; exclude conflicts first with `quality`.
    """
    wide = pivot_arms(long, unit, arm, value, arms).dropna()
    scores = {slug(a): F.col(f"score_{slug(a)}") for a in arms}
    c = scores[slug(control)]
    deltas = [(s - c).alias(f"delta_{a}") for a, s in scores.items() if a != slug(control)]
    return wide.select(unit, *scores.values(), *deltas, best_arm(scores).alias("best_arm"))


def policy_choice(predicted: dict[str, Column], control: str) -> Column:
    """The arm of the greatest predicted effect if above 0, else the control; NaN and null never win, the first wins ties."""
    safe = {a: F.coalesce(F.nanvl(c, F.lit(float("-inf"))), F.lit(float("-inf"))) for a, c in predicted.items()}
    top = F.greatest(*safe.values()) if len(safe) > 1 else next(iter(safe.values()))
    out = F.when(top <= 0, control)
    for a, c in safe.items():
        out = out.when(c == top, a)
    return out
