"""Out-of-fold effect models: constant, ridge, boosting; permutation importance and model choice."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..metrics.evaluation import importance

OUT = "id, fold, model, target, y_true, y_pred"


def guard(features: list[str], forbidden: tuple[str, ...]) -> None:
    """Refuses feature names that would leak an outcome."""
    bad = [f for f in features if any(x in f for x in forbidden)]
    if bad:
        raise ValueError(f"features that leak: {bad}")


def constant(df: DataFrame, target: str, *, row: str, fold: str) -> DataFrame:
    """Every row predicted by the mean of the other folds; two aggregates, no loop. One fold only gives null."""
    per = df.groupBy(fold).agg(F.sum(target).alias("s"), F.count(target).alias("c"))
    total = per.agg(F.sum("s").alias("ts"), F.sum("c").alias("tc"))
    mean = per.crossJoin(F.broadcast(total)).select(fold, ((F.col("ts") - F.col("s")) / F.nullif(F.col("tc") - F.col("c"), F.lit(0))).alias("y_pred"))
    return df.join(mean, fold).select(F.col(row).alias("id"), F.col(fold).alias("fold"), F.lit("constant").alias("model"), F.lit(target).alias("target"), F.col(target).alias("y_true"), "y_pred")


def _encoded(train: DataFrame, numeric: list[str], categorical: list[str]):
    """Median imputation and z-scores from the training rows; nulls of categories are a category of their own."""
    med = train.agg(*[F.median(c).alias(f"m_{c}") for c in numeric]).first() if numeric else {}
    filled = [F.coalesce(F.nullif(F.col(c).cast("double"), F.lit(float("nan"))), F.lit(med[f"m_{c}"] or 0.0)) for c in numeric]
    stats = train.agg(*[x for c, e in zip(numeric, filled) for x in (F.avg(e).alias(f"a_{c}"), F.stddev_pop(e).alias(f"s_{c}"))]).first() if numeric else {}
    scaled = [((e - stats[f"a_{c}"]) / (stats[f"s_{c}"] or 1.0)).alias(f"z_{c}") for c, e in zip(numeric, filled)]
    cats = [F.coalesce(F.col(c).cast("string"), F.lit("__missing__")).alias(f"c_{c}") for c in categorical]
    prepare = lambda d: d.select("*", *scaled, *cats)
    stages = [StringIndexer(inputCols=[f"c_{c}" for c in categorical], outputCols=[f"i_{c}" for c in categorical], handleInvalid="keep"), OneHotEncoder(inputCols=[f"i_{c}" for c in categorical], outputCols=[f"o_{c}" for c in categorical], dropLast=True)] if categorical else []
    stages.append(VectorAssembler(inputCols=[f"z_{c}" for c in numeric] + [f"o_{c}" for c in categorical], outputCol="features"))
    return prepare, stages


def _cross_fit(df: DataFrame, target: str, numeric: list[str], categorical: list[str], row: str, fold: str, name: str, estimator) -> DataFrame:
    out = []
    folds = [r[0] for r in df.select(fold).distinct().orderBy(fold).limit(101).collect()]
    if len(folds) > 100:
        raise ValueError("more than 100 folds")
    for k in folds:
        train, test = df.where((F.col(fold) != k) & F.col(target).isNotNull()), df.where(F.col(fold) == k)
        prepare, stages = _encoded(train, numeric, categorical)
        ready = prepare(train)
        model = Pipeline(stages=[*stages, estimator(ready)]).fit(ready)
        p = model.transform(prepare(test))
        out.append(p.select(F.col(row).alias("id"), F.col(fold).alias("fold"), F.lit(name).alias("model"), F.lit(target).alias("target"), F.col(target).alias("y_true"), F.col("prediction").alias("y_pred")))
    return reduce(DataFrame.unionByName, out)


def ridge(df: DataFrame, target: str, *, numeric: list[str], categorical: list[str], row: str, fold: str, alpha: float = 1.0) -> DataFrame:
    """Closed-form ridge with an unpenalised intercept. Spark divides the loss by n and scales by the label's deviation,
    so the penalty is handed over as alpha * sd(y) / n."""

    return _cross_fit(df, target, numeric, categorical, row, fold, "ridge", lambda train: _ridge(train, target, alpha))


def _ridge(train: DataFrame, target: str, alpha: float) -> LinearRegression:
    s = train.agg(F.stddev_pop(target), F.count(target)).first()
    return LinearRegression(labelCol=target, solver="normal", standardization=False, elasticNetParam=0.0, regParam=alpha * (s[0] or 0.0) / max(s[1], 1))


def boosting(df: DataFrame, target: str, *, numeric: list[str], categorical: list[str], row: str, fold: str, rounds: int = 200, rate: float = 0.05) -> DataFrame:
    """Boosted trees of depth 3. Not equal in numbers to other libraries' boosting; judged by behaviour."""
    return _cross_fit(df, target, numeric, categorical, row, fold, "boosting", lambda _: GBTRegressor(labelCol=target, maxDepth=3, stepSize=rate, maxIter=rounds, minInstancesPerNode=5, seed=0))


def fold_importance(df: DataFrame, target: str, *, numeric: list[str], categorical: list[str], row: str, fold: str, alpha: float = 1.0, repeats: int = 10) -> DataFrame:
    """(fold, feature, importance) of ridge: fitted on the other folds, scored on the fold with each feature permuted in turn."""
    folds = [r[0] for r in df.select(fold).distinct().orderBy(fold).limit(101).collect()]
    if len(folds) > 100:
        raise ValueError("more than 100 folds")
    out = []
    for k in folds:
        train, test = df.where((F.col(fold) != k) & F.col(target).isNotNull()), df.where((F.col(fold) == k) & F.col(target).isNotNull())
        prepare, stages = _encoded(train, numeric, categorical)
        ready = prepare(train)
        model = Pipeline(stages=[*stages, _ridge(ready, target, alpha)]).fit(ready)
        one = importance(test.select(row, target, *numeric, *categorical), [*numeric, *categorical], lambda d, m=model, p=prepare: m.transform(p(d)), y=target, row=row, repeats=repeats, salt=f"fold {k}")
        out.append(one.select(F.lit(k).alias("fold"), "feature", "importance"))
    return reduce(DataFrame.unionByName, out)
