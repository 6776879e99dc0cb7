"""Model training, evaluation and scoring with pyspark.ml and closed forms."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemark.functions import demand, weather
from tidemark.operators.evaluation import fold_summary, regression_metrics
from tidemark.plans.ordered import sorted_codes, with_group_stats
from tidemark.plans.scalars import with_row, with_stats
from tidemark.plans.series import with_ordinal
from tidemark.session import cut

FEATURES = "features"
#: Rows that a task of a fit should read at most.
TASK_ROWS = 100_000


def dealt(df: DataFrame) -> DataFrame:
    """The rows checkpointed, and dealt over more tasks where those that made them hold many: every tree and level reads them again, so
    a table of a few large files would keep all but a few cores idle. Small tables keep their tasks."""
    kept = cut(df)
    rows = kept.count()
    if rows <= TASK_ROWS * kept.rdd.getNumPartitions():
        return kept
    return cut(kept.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))))


def preprocessing(numeric: Sequence[str], categorical: Sequence[str] = ()) -> list:
    """Stages: standardised numbers and one-hot categories (an unseen category is its own index)."""
    stages, parts = [], []
    if numeric:
        stages += [VectorAssembler(inputCols=list(numeric), outputCol="__num", handleInvalid="skip"),
                   StandardScaler(inputCol="__num", outputCol="__scaled", withMean=True, withStd=True)]
        parts.append("__scaled")
    for c in categorical:
        stages.append(StringIndexer(inputCol=c, outputCol=f"__{c}_i", handleInvalid="keep"))
        parts.append(f"__{c}_o")
    if categorical:
        stages.append(OneHotEncoder(inputCols=[f"__{c}_i" for c in categorical], outputCols=[f"__{c}_o" for c in categorical]))
    return [*stages, VectorAssembler(inputCols=parts, outputCol=FEATURES)]


def regressor(kind: str, label: str, **params):
    """A fresh estimator: gbt, forest, linear, ridge, lasso or elastic_net."""
    base = {"featuresCol": FEATURES, "labelCol": label, "predictionCol": "predicted"}
    if kind == "gbt":
        return GBTRegressor(**base, seed=42, **{"maxIter": 100, "maxDepth": 3, "stepSize": 0.1, **params})
    if kind == "forest":
        return RandomForestRegressor(**base, seed=42, **{"numTrees": 100, **params})
    # penalties on the mean squared error of scaled features; a ridge penalty of 1 on the sum is 1/n here, see `fit`
    shapes = {"linear": (0.0, 0.0), "ridge": (0.0, 0.0), "lasso": (0.1, 1.0), "elastic_net": (0.1, 0.5)}
    if kind not in shapes:
        raise ValueError(f"unknown regressor {kind}")
    reg, mix = shapes[kind]
    return LinearRegression(**base, **{"regParam": reg, "elasticNetParam": mix, "standardization": False, **params})


def fit(df: DataFrame, kind: str, numeric: Sequence[str], categorical: Sequence[str], label: str, **params) -> PipelineModel:
    if kind == "ridge" and "regParam" not in params:
        params = {**params, "regParam": 1.0 / max(1, df.where(F.col(label).isNotNull()).count())}
    return Pipeline(stages=[*preprocessing(numeric, categorical), regressor(kind, label, **params)]).fit(df)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """The rows with a `predicted` column."""
    return model.transform(df).select(*df.columns, "predicted")


def hash_split(df: DataFrame, ids: Sequence[str], tenths: int = 8) -> DataFrame:
    """Repeatable 80/20 split by a hash of the row's identity."""
    return df.withColumn("is_train", F.pmod(F.xxhash64(*ids), F.lit(10)) < tenths)


def time_folds(df: DataFrame, time: str, ties: Sequence[str], k: int = 5, key: str | None = None) -> DataFrame:
    """Expanding folds, of each key's rows if one is named: `fold` numbers the last k blocks of n // (k + 1) rows (null before them);
    fold f trains on all rows before its block."""
    keys = [key] if key else []
    o = with_ordinal(df, keys, time, ties, name="__pos")
    s = with_group_stats(o, keys, __n=F.count(F.lit(1))) if key else with_stats(o, source=df, n=F.count(F.lit(1))).withColumn("__n", F.col("__stats.n"))
    size = F.floor(F.col("__n") / (k + 1))
    first = F.col("__n") - k * size
    fold = F.when(F.col("__pos") >= first, F.floor((F.col("__pos") - first) / size))
    return s.withColumn("fold", fold).drop("__pos", "__stats", "__n")


def cross_validate(folded: DataFrame, kind: str, numeric: Sequence[str], categorical: Sequence[str], label: str, k: int, **params) -> DataFrame:
    """Predictions of every fold by a model trained on the rows before it."""
    kept = dealt(folded)
    out = None
    for f in range(k):
        train = kept.where(F.col("fold").isNull() | (F.col("fold") < f))
        one = predict(fit(train, kind, numeric, categorical, label, **params), kept.where(F.col("fold") == f))
        out = one if out is None else out.unionByName(one)
    return out


def cross_validation_report(folded: DataFrame, kind: str, numeric, categorical, label: str, k: int, **params) -> DataFrame:
    return fold_summary(cross_validate(folded, kind, numeric, categorical, label, k, **params), actual=label)


def linear_by_key(df: DataFrame, key: str, numeric: Sequence[str], label: str, min_rows: int = 50) -> DataFrame:
    """Least squares per key from sums of products: (key, n, intercept, coefficients).

    The sums are map-side combined, so no key's rows meet in one task; only the small systems are solved
    in Python, one row per key."""
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in numeric]]
    have = df.dropna(subset=[*numeric, label])
    means = with_group_stats(have, [key], **{f"__m{i}": F.avg(c) for i, c in enumerate(numeric)})
    x = [F.lit(1.0), *[F.col(c).cast("double") - F.col(f"__m{i}") for i, c in enumerate(numeric)]]
    p = len(x)
    gram = [F.sum(x[i] * x[j]).alias(f"g{i}_{j}") for i in range(p) for j in range(i, p)]
    side = [F.sum(x[i] * F.col(label)).alias(f"b{i}") for i in range(p)]
    g = means.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *gram, *side, *[F.max(f"__m{i}").alias(f"m{i}") for i in range(p - 1)])
    g = g.where(F.col("n") >= min_rows).select(
        key, "n", F.array(*[F.col(f"g{min(i, j)}_{max(i, j)}") for i in range(p) for j in range(p)]).alias("gram"),
        F.array(*[F.col(f"b{i}") for i in range(p)]).alias("side"), F.array(*[F.col(f"m{i}") for i in range(p - 1)]).alias("means"))

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def solve(gram: pd.Series, side: pd.Series, mean: pd.Series) -> pd.Series:
        out = []
        for a, b, m in zip(gram, side, mean):
            w = np.linalg.lstsq(np.asarray(a).reshape(p, p), np.asarray(b), rcond=None)[0]
            out.append([float(w[0] - w[1:] @ np.asarray(m)), *map(float, w[1:])])
        return pd.Series(out)

    s = g.withColumn("w", solve("gram", "side", "means"))
    return s.select(key, "n", F.col("w")[0].alias("intercept"), F.slice("w", 2, p - 1).alias("coefficients"))


def score_linear(df: DataFrame, models: DataFrame, key: str, numeric: Sequence[str]) -> DataFrame:
    """Apply per-key linear models; rows of a key without a model get no prediction."""
    j = df.join(models.select(key, "intercept", "coefficients"), key, "left")
    p = F.col("intercept")
    for i, c in enumerate(numeric):
        p = p + F.col("coefficients")[i] * F.col(c)
    return j.withColumn("predicted", p).drop("intercept", "coefficients")


def impurity_importance(model: PipelineModel, df: DataFrame) -> DataFrame:
    """(feature, importance) of a tree model; names from the assembled vector's metadata."""
    meta = model.transform(df.limit(1)).schema[FEATURES].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for group in meta.values() for a in group}
    pairs = [(names[i], float(v)) for i, v in enumerate(model.stages[-1].featureImportances.toArray())]
    return df.sparkSession.createDataFrame(pairs, "feature string, importance double")


def with_shuffled(df: DataFrame, cols: Sequence[str], key: str, seed: int = 42) -> DataFrame:
    """The rows with `__new_<col>` for each column: the value of the row with the same position in another order."""
    home = sorted_codes(df, key, "__i")
    other = df.select(F.concat_ws("|", F.xxhash64(key, F.lit(seed)).cast("string"), F.col(key).cast("string")).alias("__h"), *[F.col(c).alias(f"__new_{c}") for c in cols])
    away = other.join(sorted_codes(other, "__h", "__i"), "__h").drop("__h")
    return df.join(home, key).join(away, "__i").drop("__i")


def shuffled(df: DataFrame, col: str, key: str, seed: int = 42) -> DataFrame:
    """`col` permuted over the rows."""
    return with_shuffled(df, [col], key, seed).withColumn(col, F.col(f"__new_{col}")).drop(f"__new_{col}")


def permutation_importance(model: PipelineModel, df: DataFrame, cols: Sequence[str], key: str, label: str) -> DataFrame:
    """Increase of the RMSE when a column is permuted."""
    kept = cut(df)
    base = regression_metrics(predict(model, kept), actual=label, names=["rmse"]).select(F.col("rmse").alias("base"))
    # one order of the rows serves all columns
    mixed, out = cut(with_shuffled(kept, cols, key)), None
    for c in cols:
        m = regression_metrics(predict(model, mixed.withColumn(c, F.col(f"__new_{c}"))), actual=label, names=["rmse"])
        one = with_row(m, base, "__b").select(F.lit(c).alias("feature"), (F.col("rmse") - F.col("__b.base")).alias("importance"))
        out = one if out is None else out.unionByName(one)
    return out.orderBy(F.col("importance").desc())


def score_routed(routed: DataFrame, models: dict[str, PipelineModel], model_col: str = "model_id") -> DataFrame:
    """Rows scored by the model they are routed to; the rest keeps an empty prediction and an error."""
    out = routed.where(F.col(model_col).isNull() | ~F.col(model_col).isin(list(models))).withColumn("predicted", F.lit(None).cast("double"))
    for name, m in models.items():
        out = out.unionByName(predict(m, routed.where(F.col(model_col) == name)))
    return out.withColumn("error", F.when(F.col("predicted").isNull(), F.coalesce(F.col("error"), F.concat(F.lit("model not loaded: "), F.col(model_col)))))


def score_registered(routed: DataFrame, models: DataFrame, numeric: Sequence[str], model_col: str = "model_id") -> DataFrame:
    """Rows scored by the linear model they are routed to, for any number of models in one join; models: model_col, intercept,
    coefficients. A row without a model, or whose model is absent, keeps an empty prediction and an error."""
    scored = score_linear(routed, models, model_col, numeric)
    absent = F.concat(F.lit("model not loaded: "), F.col(model_col))
    return scored.withColumn("error", F.when(F.col("predicted").isNull(), F.coalesce(F.col("error"), absent)))


def compare_regressors(train: DataFrame, test: DataFrame, kinds: dict[str, dict], numeric, categorical, label: str, ids: Sequence[str], top: int = 3) -> DataFrame:
    """Metrics of every regressor and of the mean of the best `top` by R²."""
    train, test = dealt(train), dealt(test)
    joined, scores = test.select(*ids, label), []
    for name, params in kinds.items():
        p = predict(fit(train, params.get("kind", name), numeric, categorical, label, **{k: v for k, v in params.items() if k != "kind"}), test)
        joined = joined.join(p.select(*ids, F.col("predicted").alias(f"p_{name}")), list(ids))
    joined = cut(joined)
    out = None
    for name in kinds:
        one = regression_metrics(joined, actual=label, predicted=f"p_{name}", names=["rmse", "mae", "r2"]).withColumn("model", F.lit(name))
        out = one if out is None else out.unionByName(one)
    # one row per regressor
    scores = sorted(out.select("model", "r2").collect(), key=lambda r: (-(r["r2"] or float("-inf")), r["model"]))[:top]
    mean = sum((F.col(f"p_{r['model']}") for r in scores), F.lit(0.0)) / len(scores)
    ens = regression_metrics(joined.withColumn("ensemble", mean), actual=label, predicted="ensemble", names=["rmse", "mae", "r2"])
    return out.unionByName(ens.withColumn("model", F.lit("ensemble")))


def resolve_mixed(df: DataFrame, key: str = "location_id", kind: str = "parking_type", value: str = "occupancy", limit: float = 0.6) -> DataFrame:
    """Mixed places count as public when their mean occupancy exceeds the limit, else as residential."""
    s = with_group_stats(df, [key], __mean=F.avg(value))
    return s.withColumn(kind, F.when(F.col(kind) == "Mixed", F.when(F.col("__mean") > limit, "Public").otherwise("Resident")).otherwise(F.col(kind))).drop("__mean")


def rule_ensemble(df: DataFrame, configs: Sequence[dict], split: str, time: str = "timestamp", key: str = "location_id", value: str = "occupancy") -> DataFrame:
    """Weighted mean of rule scores under several weight sets, measured per location from the split time on.

    configs: {"weights": {component: weight}, "share": ensemble weight}; shares are normalised."""
    test = resolve_mixed(df, key).where(F.col(time) >= F.lit(split).cast("timestamp"))
    w = weather.factor(F.col("temperature"), F.col("humidity"), F.col("wind_speed"), F.col("precipitation"), F.month(time))
    parts = demand.rule_components(F.col("parking_type"), F.col(time), F.col("latitude"), F.col("longitude"), F.col("capacity"), w)
    total = sum(c.get("share", 1.0 / len(configs)) for c in configs)
    mix = F.lit(0.0)
    for c in configs:
        mix = mix + F.lit(c.get("share", 1.0 / len(configs)) / total) * demand.rule_score(parts, c["weights"])
    return regression_metrics(test.withColumn("predicted", mix), [key], value, "predicted", names=["rmse", "mae", "r2"])


def stack(train: DataFrame, test: DataFrame, kinds: dict[str, dict], numeric, categorical, label: str, ids: Sequence[str], folds: int = 3, **meta) -> DataFrame:
    """Stacked prediction of the test rows: base models predict held-out folds, a boosted meta model
    learns from those, the base models refitted on all training rows feed it for the test."""
    t = dealt(train.withColumn("__fold", F.pmod(F.xxhash64(*ids), F.lit(folds))))
    names = list(kinds)
    learned, asked = t, test
    for name, params in kinds.items():
        held = None
        for f in range(folds):
            p = predict(fit(t.where(F.col("__fold") != f), name, numeric, categorical, label, **params), t.where(F.col("__fold") == f))
            p = p.select(*ids, F.col("predicted").alias(f"p_{name}"))
            held = p if held is None else held.unionByName(p)
        learned = learned.join(held, list(ids))
        full = predict(fit(t, name, numeric, categorical, label, **params), test)
        asked = asked.join(full.select(*ids, F.col("predicted").alias(f"p_{name}")), list(ids))
    top = fit(cut(learned), "gbt", [f"p_{n}" for n in names], [], label, **{"maxIter": 50, **meta})
    return predict(top, asked)


def screen_numeric(df: DataFrame, cols: Sequence[str], label: str, is_train: Column) -> DataFrame:
    """One-variable line per column fitted on the training rows: slope and test errors, best R² first."""
    long = df.select(is_train.alias("__t"), F.col(label).cast("double").alias("__y"), *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        ["__t", "__y"], list(cols), "variable", "x").dropna()
    line = long.where("__t").groupBy("variable").agg(F.regr_slope("__y", "x").alias("coefficient"), F.regr_intercept("__y", "x").alias("__a"))
    scored = long.where("NOT __t").join(line, "variable").withColumn("__p", F.col("__a") + F.col("coefficient") * F.col("x"))
    return regression_metrics(scored, ["variable", "coefficient"], "__y", "__p", names=["rmse", "r2"]).drop("sample_size").orderBy(F.col("r2").desc())


def screen_categories(df: DataFrame, cols: Sequence[str], label: str, is_train: Column) -> DataFrame:
    """Category means of the training rows as predictors; an unseen category takes the overall mean."""
    long = df.select(is_train.alias("__t"), F.col(label).cast("double").alias("__y"), *[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        ["__t", "__y"], list(cols), "variable", "category").dropna()
    means = long.where("__t").groupBy("variable", "category").agg(F.avg("__y").alias("__m"))
    s = with_row(long.where("NOT __t").join(means, ["variable", "category"], "left"), long.where("__t").agg(F.avg("__y").alias("m")), "__o")
    s = s.withColumn("__p", F.coalesce("__m", "__o.m"))
    return regression_metrics(s, ["variable"], "__y", "__p", names=["rmse", "r2"]).drop("sample_size").orderBy(F.col("r2").desc())


def screen_groups(train: DataFrame, test: DataFrame, groups: dict[str, tuple[Sequence[str], Sequence[str]]], label: str, **params) -> DataFrame:
    """Random forest per group of variables (numeric, categorical)."""
    train, test = dealt(train), dealt(test)
    out = None
    for name, (numeric, categorical) in groups.items():
        m = regression_metrics(predict(fit(train, "forest", numeric, categorical, label, **params), test), actual=label, names=["rmse", "r2"])
        one = m.withColumn("group", F.lit(name)).drop("sample_size")
        out = one if out is None else out.unionByName(one)
    return out.orderBy(F.col("r2").desc())


def geo_clusters(df: DataFrame, lat: str = "latitude", lon: str = "longitude", k: int = 5, seed: int = 42, out: str = "location_cluster") -> DataFrame:
    """k-means over the distinct coordinates, joined back to the rows. A single place is cluster 0; rows without coordinates are -1."""
    coords = df.select(lat, lon).where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).distinct()
    n = min(k, coords.limit(k).count())
    if n < 2:
        return df.withColumn(out, F.when(F.col(lat).isNotNull() & F.col(lon).isNotNull(), 0).otherwise(-1).cast("bigint"))
    v = VectorAssembler(inputCols=[lat, lon], outputCol="__v").transform(coords)
    named = KMeans(k=n, seed=seed, featuresCol="__v", predictionCol=out).fit(v).transform(v).select(lat, lon, F.col(out).cast("bigint").alias(out))
    return df.join(named, [lat, lon], "left").fillna(-1, [out])
