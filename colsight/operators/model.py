"""Baseline models: encoding, split, fit, evaluation, forest importance."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colsight.functions.exprs import (
    c,
    dtype_of,
    free_name,
    is_atomic,
    is_number,
    is_number_or_bool,
    is_temporal,
    literal,
    number,
    quoted,
    text,
    value,
)
from colsight.operators import forest
from colsight.operators.blocks import value_counts
from colsight.session import materialize

# Distinct values up to which a numeric target counts as classes; share and
# seed of the test split; iterations of the logistic fit; trees, seed and least rows of the forest.
CLASS_LIMIT = 10
TEST_SHARE, SPLIT_SEED = 0.2, 42
LOGISTIC_ITERATIONS = 1000
TREES, FOREST_SEED, FOREST_ROWS = 180, 42, 20

# Text columns with up to so many levels become 0/1 columns of a model, others one sparse
# vector: a choice of plan, the model is the same.
COLUMN_LEVELS = 50
LINEAR_ITERATIONS = 1000
WIDE_FEATURES = 4096
# Levels beyond which dummy_encode numbers them and spreads the rows before it spells them out: a choice of plan.
WIDE_COLUMNS = 1000
FOREST_BINS = forest.BINS
FOREST_DEPTH = 10


def _cells(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(ordinal, value) of the present texts of some columns."""
    cells = F.array(*[F.struct(F.lit(i).alias("ordinal"), text(df, n).alias("value")) for i, n in enumerate(names)])
    return df.select(F.inline(cells)).filter(F.col("value").isNotNull())


def levels_of(df: DataFrame, names: Sequence[str]) -> dict[str, list[str]]:
    """Sorted text levels of some columns, found in one job. They reach the driver, so this
    is for columns that are spelled out in a schema."""
    out: dict[str, list[str]] = {n: [] for n in names}
    for r in _cells(df, names).distinct().collect() if names else []:
        out[names[r["ordinal"]]].append(r["value"])
    return {n: sorted(found) for n, found in out.items()}


def numbered(values: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """Number the distinct values of each ordinal from 0 in sorted order.

    ``values`` is (ordinal, value); the result (ordinal, value, index), and the number of
    values per ordinal. Ranges are numbered on their own and shifted by the sizes of those
    before, so only sizes of ranges reach the driver.
    """
    ordered = values.distinct().repartitionByRange("ordinal", "value").withColumn("part", F.spark_partition_id())
    placed = materialize(ordered)
    sizes = placed.groupBy("ordinal", "part").count().orderBy("ordinal", "part").collect()
    totals: dict[int, int] = {}
    starts = []
    for r in sizes:
        starts.append((r["ordinal"], r["part"], totals.get(r["ordinal"], 0)))
        totals[r["ordinal"]] = totals.get(r["ordinal"], 0) + r["count"]
    first = values.sparkSession.createDataFrame(starts, "ordinal int, part int, start bigint")
    place = F.row_number().over(Window.partitionBy("ordinal", "part").orderBy("value"))
    joined = placed.withColumn("place", place).join(F.broadcast(first), ["ordinal", "part"])
    index = (F.col("start") + F.col("place") - 1).cast("double").alias("index")
    return joined.select("ordinal", "value", index), totals


def dummy_name(column: str, level: str) -> str:
    return f"{column}_{level}"


def dummy_encode(df: DataFrame, target: str, levels: dict[str, list[str]] | None = None) -> DataFrame:
    """Explicit 0/1 columns for text features, first level dropped; target kept.

    A missing category is all zeros, like the first level. Booleans pass as 0/1, datetimes
    and nested columns are left out. Rows that miss a number or the target are removed.
    Every level becomes a column. Where that is too wide, ``dummy_long`` has the same ones
    as rows, and models encode levels sparsely (see ``training_frame``).
    """
    features = [n for n in df.columns if n != target and is_atomic(dtype_of(df, n)) and not is_temporal(dtype_of(df, n))]
    numbers = [n for n in features if is_number_or_bool(dtype_of(df, n))]
    texts = [n for n in features if n not in numbers]
    levels = levels_of(df, texts) if levels is None else levels
    slot = free_name([target, *features], "_x")
    plain = [(value if n == target or is_number(dtype_of(df, n)) else number if n in numbers else text)(df, n) for n in [target, *features]]
    rows = complete_rows(df, numbers, target).select(*[col.alias(f"{slot}{i}") for i, col in enumerate(plain)])
    wide = sum(len(levels[n]) for n in texts) > WIDE_COLUMNS
    if wide:  # a split of the input is that many times as much work as its size tells
        places = {f"{slot}{i}": levels[n] for i, n in enumerate(features, 1) if n in texts}
        looked_up = {x: f"cast(coalesce(array_position(array({', '.join(map(literal, found))}), {x}), 0) AS int)" for x, found in places.items() if found}
        rows = rows.selectExpr(*[f"{looked_up.get(x, x)} AS {x}" for x in rows.columns])
        rows = rows.repartition(df.sparkSession.sparkContext.defaultParallelism)
    # Texts of expressions: with thousands of levels, columns built one by one take longer than the job.
    cols = [f"{slot}0 AS {quoted(target)}"]
    for i, n in enumerate(features, 1):
        if n in numbers:
            cols.append(f"{slot}{i} AS {quoted(n)}")
        else:
            first = {level: place for place, level in reversed(list(enumerate(levels[n], 1)))}
            for level in levels[n][1:]:  # a wide row looks up the place of its level once, its cells compare numbers
                one = f"if({slot}{i} = {first[level]}, 1, 0)" if wide else f"coalesce(cast({slot}{i} = {literal(level)} AS int), 0)"
                cols.append(f"{one} AS {quoted(dummy_name(n, level))}")
    return rows.selectExpr(*cols)


def dummy_long(df: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Long form of the text levels: (key columns, column, level), a row per present text."""
    names = list(columns or [n for n in df.columns if n not in key and isinstance(dtype_of(df, n), T.StringType)])
    cells = F.array(*[F.struct(F.lit(n).alias("column"), text(df, n).alias("level")) for n in names])
    return df.select(*[c(k) for k in key], F.inline(cells)).filter(F.col("level").isNotNull())


def complete_rows(df: DataFrame, numbers: Sequence[str], target: str) -> DataFrame:
    keep = value(df, target).isNotNull()
    for n in numbers:
        keep = keep & value(df, n).isNotNull()
    return df.filter(keep)


def task_type(df: DataFrame, target: str) -> str:
    """Classes for anything but numbers and for numbers with few distinct values."""
    if not is_number(dtype_of(df, target)):
        return "classification"
    few = value_counts(df, target).limit(CLASS_LIMIT + 1).count() <= CLASS_LIMIT
    return "classification" if few else "regression"


def task_types(profile: DataFrame) -> DataFrame:
    """Task type of every profiled column when used as a training target."""
    many = (F.col("kind") == "number") & (F.col("n_distinct") > CLASS_LIMIT)
    return profile.select("table_name", "column", F.when(many, "regression").otherwise("classification").alias("task_type"))


def hash_split(
    df: DataFrame, key: Sequence[str] | None = None, share: float = TEST_SHARE, seed: int = SPLIT_SEED, name: str = "is_test"
) -> DataFrame:
    """Add a boolean column ``name``: a fixed function of the key (by default the whole row), so
    that every evaluation and retry splits alike."""
    return _added(df, name, split_mark(df, key, share, seed))


def split_mark(df: DataFrame, key: Sequence[str] | None = None, share: float = TEST_SHARE, seed: int = SPLIT_SEED) -> Column:
    """Whether a row is a test row, as an expression over the table's columns."""
    cols = [value(df, n) for n in (key or [n for n in df.columns if is_atomic(dtype_of(df, n))])]
    return F.pmod(F.xxhash64(*cols, F.lit(seed)), F.lit(1000)) < int(share * 1000)


def modulo_split(df: DataFrame, key: str, folds: int = 5, name: str = "is_test") -> DataFrame:
    """Split by key modulo: one of ``folds`` parts is the test part. Any SQL engine agrees."""
    return _added(df, name, F.pmod(c(key), F.lit(folds)) == 0)


def _added(df: DataFrame, name: str, column: Column) -> DataFrame:
    if name.lower() in (n.lower() for n in df.columns):
        raise ValueError(f"The table has a column {name}; choose another name for the split.")
    return df.withColumn(name, column)


@dataclass
class TrainedModel:
    task_type: str
    target: str
    model: object
    predictions: DataFrame
    train_rows: int
    test_rows: int
    feature_count: int
    classes: list[str] = field(default_factory=list)
    excluded: list[str] = field(default_factory=list)
    train: DataFrame | None = None

    def metrics(self) -> dict[str, str]:
        out = {
            "task_type": self.task_type, "target_column": self.target, "train_rows": str(self.train_rows),
            "test_rows": str(self.test_rows), "feature_count": str(self.feature_count),
        }
        if self.excluded:
            out["excluded_features"] = ", ".join(self.excluded)
        summary = self.model.summary
        if summary.totalIterations >= self.model.getMaxIter():
            out["converged"] = "false"
        return out


@dataclass
class TrainingFrame:
    rows: DataFrame
    feature_count: int
    classes: list[str]
    excluded: list[str]


def training_frame(
    df: DataFrame,
    target: str,
    task: str,
    exclude: Sequence[str] = (),
    split_key: Sequence[str] | None = None,
    split_column: str | None = None,
) -> TrainingFrame:
    """(label, features, is_test); datetimes and ``exclude`` stay out and are listed.
    ``split_column`` names a boolean column that marks the test rows, else ``split_mark`` does;
    a column of the table that happens to be called is_test is a feature like any other.

    Text columns with few levels become 0/1 columns, the others a sparse one-hot vector over
    a table of numbered levels. First level and missing are all zeros.
    """
    skip = {target, split_column, *exclude}
    usable = [n for n in df.columns if n not in skip and is_atomic(dtype_of(df, n)) and not is_temporal(dtype_of(df, n))]
    excluded = [n for n in df.columns if n not in (target, split_column) and n not in usable]
    numbers = [n for n in usable if is_number_or_bool(dtype_of(df, n))]
    texts = [n for n in usable if n not in numbers]
    table, sizes = numbered(_cells(df, texts)) if texts else (None, {})
    size = {n: sizes.get(i, 0) for i, n in enumerate(texts)}
    few = {n: [] for n in texts if size[n] <= COLUMN_LEVELS}
    if few:
        wanted = table.filter(F.col("ordinal").isin([i for i, n in enumerate(texts) if n in few]))
        for r in wanted.orderBy("ordinal", "index").collect():  # at most COLUMN_LEVELS per column
            few[texts[r["ordinal"]]].append(r["value"])
    sparse = [n for n in texts if n not in few]

    rows = complete_rows(df, numbers, target)
    mark = split_mark(rows, split_key) if split_column is None else c(split_column)
    slots = [number(df, n).alias(f"f{i}") for i, n in enumerate(numbers)]
    for n, found in few.items():
        for level in found[1:]:
            slots.append(F.coalesce((text(df, n) == level).cast("double"), F.lit(0.0)).alias(f"f{len(slots)}"))
    inputs = [f"f{i}" for i in range(len(slots))]
    width = len(slots)
    label = number(df, target) if task == "regression" else value(df, target)
    columns = [label.alias("label"), mark.alias("is_test"), *slots, *[text(df, n).alias(f"t{i}") for i, n in enumerate(sparse)]]
    wide = rows.select(*columns).filter(F.col("label").isNotNull())
    classes: list[str] = []
    if task == "classification":
        wide, labels, _ = label_encoded(wide, "label")
        classes = [str(r["value"]) for r in labels.orderBy("index").collect()]
    for i, n in enumerate(sparse):
        levels = table.filter(F.col("ordinal") == texts.index(n))
        wide = _one_hot(wide, f"t{i}", levels, size[n], f"h{i}")
        inputs.append(f"h{i}")
        width += size[n] - 1
    if not inputs:
        raise ValueError("No usable feature columns.")
    rows = VectorAssembler(inputCols=inputs, outputCol="features").transform(wide).select("label", "features", "is_test")
    return TrainingFrame(rows, width, classes, excluded)


def _one_hot(df: DataFrame, name: str, levels: DataFrame, size: int, out: str) -> DataFrame:
    """Sparse 0/1 vector of a text column; the first level shares the dropped slot with
    missing values."""
    found = df.join(levels.select("value", "index"), F.col(name) == F.col("value"), "left")
    nominal = {"ml_attr": {"type": "nominal", "num_vals": size, "name": out}}
    slot = F.when(F.col("index") > 0, F.col("index") - 1).otherwise(F.lit(float(size - 1)))
    indexed = found.select(*[c(n) for n in df.columns], slot.alias(f"{out}_index", metadata=nominal))
    encoder = OneHotEncoder(inputCols=[f"{out}_index"], outputCols=[out], dropLast=True)
    return encoder.fit(indexed).transform(indexed).drop(f"{out}_index")


def label_encoded(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame, int]:
    """Replace a class column by its index in sorted order; also the classes (value, index)
    and their number."""
    labels, sizes = numbered(df.select(F.lit(0).alias("ordinal"), c(name).alias("value")))
    n = sizes.get(0, 0)
    nominal = {"ml_attr": {"type": "nominal", "num_vals": max(n, 2), "name": name}}
    joined = df.join(labels.select("value", "index"), F.col(name) == F.col("value"))
    out = joined.select(*[(F.col("index").alias(k, metadata=nominal) if k == name else c(k)) for k in df.columns])
    return out, labels, n


def fit_logistic(train: DataFrame, n_rows: int | None = None) -> object:
    """L2 logistic fit. The penalty of strength 1 on summed losses is 1/n on mean losses."""
    n = train.count() if n_rows is None else n_rows
    return LogisticRegression(
        maxIter=LOGISTIC_ITERATIONS, regParam=1.0 / max(n, 1), elasticNetParam=0.0, standardization=False
    ).fit(train)


def steepest(trained: TrainedModel) -> float:
    """Largest entry of the gradient of the penalised logistic loss at the fitted coefficients,
    each taken per standard deviation of its feature: near 0 at the optimum."""
    fitted, train = trained.model, trained.train
    weights, offsets = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    if len(weights) == 1:  # two classes share one row
        weights, offsets = np.vstack([0 * weights[0], weights[0]]), np.array([0.0, offsets[0]])
    x = vector_to_array("features")
    width, strength = weights.shape[1], fitted.getRegParam()
    cells = train.select("label", *[F.get(x, F.lit(j)).alias(f"x{j}") for j in range(width)])
    margins = [sum((F.col(f"x{j}") * float(w[j]) for j in range(width)), F.lit(float(b))) for w, b in zip(weights, offsets)]
    top = F.greatest(*margins)
    powers = [F.exp(m - top) for m in margins]
    total = sum(powers[1:], powers[0])
    misses = [(p / total - (F.col("label") == k).cast("double")).alias(f"m{k}") for k, p in enumerate(powers)]
    missed = cells.select(*[f"x{j}" for j in range(width)], *misses)
    sums = missed.agg(
        *[F.avg(F.col(f"m{k}") * F.col(f"x{j}")).alias(f"g{k}_{j}") for k in range(len(weights)) for j in range(width)],
        *[F.stddev_pop(f"x{j}").alias(f"s{j}") for j in range(width)],
        *[F.avg(f"m{k}").alias(f"b{k}") for k in range(len(weights))],
    ).first()
    slopes = [
        abs(sums[f"g{k}_{j}"] + strength * weights[k][j]) / (sums[f"s{j}"] or 1.0) for k in range(len(weights)) for j in range(width)
    ]
    return max(slopes + [abs(sums[f"b{k}"]) for k in range(len(weights))])


def fit_linear(train: DataFrame) -> object:
    """Ordinary least squares with intercept; the solver falls back to iterations when
    there are many columns."""
    width = len(train.first()["features"])
    solver = "auto" if width <= WIDE_FEATURES else "l-bfgs"
    return LinearRegression(regParam=0.0, solver=solver, maxIter=LINEAR_ITERATIONS).fit(train)


def train_model(
    df: DataFrame,
    target: str | None,
    exclude: Sequence[str] = (),
    split_key: Sequence[str] | None = None,
    split_column: str | None = None,
) -> TrainedModel:
    """Fit the baseline model of a target on 80 % of the rows and predict the rest. What the
    fit reads again and again is written once."""
    if not target or target not in df.columns:
        raise ValueError("TRAIN_MODEL requires a valid target_column.")
    task = task_type(df, target)
    frame = training_frame(df, target, task, exclude, split_key, split_column)
    rows = materialize(frame.rows)
    sizes = {r["is_test"]: r["count"] for r in rows.groupBy("is_test").count().collect()}
    if not sizes:
        raise ValueError("No valid rows after filtering missing values.")
    train, test = rows.filter(~F.col("is_test")), rows.filter("is_test")
    model = fit_logistic(train, sizes.get(False, 0)) if task == "classification" else fit_linear(train)
    predictions = model.transform(test).select("label", "prediction")
    return TrainedModel(
        task, target, model, predictions, sizes.get(False, 0), sizes.get(True, 0),
        frame.feature_count, frame.classes, frame.excluded, train,
    )


def linear_fit_single(df: DataFrame, feature: str, target: str) -> DataFrame:
    """Slope and intercept of a one-feature least-squares line, as aggregates."""
    x, y = number(df, feature), number(df, target)
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_count(y, x).alias("n"))


def evaluate_classification(predictions: DataFrame) -> DataFrame:
    """Accuracy and support-weighted precision, recall, F1 from (label, prediction)."""
    confusion = predictions.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    actual = confusion.groupBy(F.col("label").alias("class")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    guessed = confusion.groupBy(F.col("prediction").alias("class")).agg(F.sum("n").alias("predicted"))
    per_class = actual.join(guessed, "class", "left")
    precision = F.coalesce(F.try_divide(F.col("tp"), F.col("predicted")), F.lit(0.0))
    recall = F.col("tp") / F.col("support")
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))

    def weighted(col: Column) -> Column:
        return F.sum(F.col("support") * col) / F.sum("support")

    return per_class.agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        weighted(precision).alias("precision_weighted"),
        weighted(recall).alias("recall_weighted"),
        weighted(f1).alias("f1_weighted"),
    )


def evaluate_regression(predictions: DataFrame) -> DataFrame:
    """MAE, RMSE and R2 from (label, prediction), one aggregate."""
    e = F.col("label") - F.col("prediction")
    spread = F.var_pop("label") * F.count("label")
    return predictions.agg(
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - F.try_divide(F.sum(e * e), spread)).alias("r2"),
    )


def evaluate(trained: TrainedModel | None) -> DataFrame:
    if trained is None:
        raise ValueError("No trained model available for evaluation.")
    if trained.task_type == "classification":
        return evaluate_classification(trained.predictions)
    return evaluate_regression(trained.predictions)


def feature_importance(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    target_type: str,
    trees: int = TREES,
    depth: int = FOREST_DEPTH,
    bins: int = FOREST_BINS,
) -> DataFrame:
    """(feature, feature_importance) of a random forest on the complete rows.

    A text feature is split by one level against all others, as 0/1 columns of its levels would be,
    and is summed up as one feature; any number of levels and classes can be fitted, see ``forest``.
    At every node the square root of the number of features is looked at for classes, all of them
    for numbers. Fewer than 20 rows give no result.
    """
    spark = df.sparkSession
    empty = spark.createDataFrame([], "feature string, feature_importance double")
    features = list(features)
    if not features:
        return empty
    classify = target_type == "classification"
    table = forest.prepare(df, features, target, classify, bins)
    if table.count < FOREST_ROWS:
        return empty
    looked_at = math.ceil(math.sqrt(len(features))) if classify else None
    weights = forest.importances(forest.grow(table, trees, depth, FOREST_SEED, looked_at=looked_at), len(features))
    return spark.createDataFrame(
        [(n, float(w)) for n, w in zip(features, weights)], "feature string, feature_importance double"
    )
