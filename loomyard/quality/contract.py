"""A declared feature contract: fields, roles, missing policies; its rules need the schema only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The vocabularies of a contract.
ROLES = ("metadata", "covariate", "treatment", "outcome", "provenance")
MISSING = ("fail_validation", "exclude_pair", "null_with_indicator", "not_applicable_when_succeeded", "constant_from_metadata")


@dataclass(frozen=True)
class Field:
    name: str
    dtype: str
    role: str = "covariate"
    model_feature: bool = False
    before_simulation: bool = True
    missing: str = "null_with_indicator"
    required: bool = True


@dataclass
class Contract:
    fields: list[Field]
    forbidden: tuple[str, ...] = ()
    keys: tuple[str, ...] = ()

    def check(self) -> list[str]:
        """Unknown words, repeated names, and features that leak: outcomes, later knowledge or forbidden parts of names."""
        bad, seen = [], set()
        for f in self.fields:
            if f.name in seen:
                bad.append(f"{f.name}: declared twice")
            seen.add(f.name)
            if f.role not in ROLES:
                bad.append(f"{f.name}: unknown role {f.role}")
            if f.missing not in MISSING:
                bad.append(f"{f.name}: unknown missing policy {f.missing}")
            if f.model_feature and (f.role != "covariate" or not f.before_simulation):
                bad.append(f"{f.name}: not usable as a feature")
            if f.model_feature and any(x in f.name for x in self.forbidden):
                bad.append(f"{f.name}: forbidden name")
        return bad

    def features(self) -> list[str]:
        return [f.name for f in self.fields if f.model_feature]

    def schema(self) -> T.StructType:
        out = T.StructType()
        for f in self.fields:
            out.add(T.StructField(f.name, T._parse_datatype_string(f.dtype), True, {"role": f.role, "model_feature": f.model_feature, "missing": f.missing}))
        return out

    def undeclared(self, df: DataFrame) -> list[str]:
        known = {f.name for f in self.fields} | {f"{f.name}_missing" for f in self.fields} | set(self.keys)
        return sorted(set(df.columns) - known)

    def absent(self, df: DataFrame) -> list[str]:
        return [f.name for f in self.fields if f.required and f.name not in df.columns]

    def project(self, df: DataFrame) -> DataFrame:
        """Keys and features in the contract's order and types, each feature with its _missing flag (a flag that came along is kept)."""
        out = [F.col(k) for k in self.keys]
        for f in self.fields:
            if f.name in df.columns and f.name not in self.keys:
                flag = F.coalesce(F.col(f"{f.name}_missing"), F.col(f.name).isNull()) if f"{f.name}_missing" in df.columns else F.col(f.name).isNull()
                out += [F.col(f.name).cast(f.dtype).alias(f.name, metadata={"role": f.role}), flag.alias(f"{f.name}_missing")]
        return df.select(*out)


def integrate(base: DataFrame, sources: dict[str, DataFrame], key: str) -> DataFrame:
    """Left star join, one row per base row. Sources must be unique by key: a repeated key raises when the plan runs."""
    out = base
    for name, s in sources.items():
        clash = (set(s.columns) & set(out.columns)) - {key}
        if clash:
            raise ValueError(f"{name}: columns already there: {sorted(clash)}")
        one = s.groupBy(key).agg(F.count("*").alias("__n"), *[F.first(c).alias(c) for c in s.columns if c != key])
        checked = F.when(F.col("__n") > 1, F.raise_error(F.lit(f"{name}: key is not unique"))).otherwise(F.lit(True))
        out = out.join(one.where(checked).drop("__n"), key, "left")
    return out
