"""Association tests of features against a target column.

Numeric features share one aggregate per test family. Categories and ranks go through
value counts (feature, value, ...), so that a value held by a third of all rows is one
row per task when it reaches the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colsight.functions.exprs import (
    c,
    clamp01,
    corr_sql,
    dtype_of,
    exact_round,
    free_name,
    is_number_or_bool,
    is_temporal,
    number,
    number_sql,
    share,
    text,
    value,
)
from colsight.functions.tails import chi2_tail, f_tail, mann_whitney_tail, pearson_tail
from colsight.operators.blocks import (
    COLUMNS_PER_AGGREGATE,
    ROWS_PER_BUCKET,
    per_column_agg,
    range_bucket,
    running_totals,
    union_all,
)
from colsight.session import materialize

# Rows a test needs, rows a group needs, and the target flag.
MIN_ROWS = 12
MIN_GROUP = 3
# A value that holds more than this share of all pairs has its rank broadcast: at most 1,000 values.
HOT_SHARE = 0.001
# Ranks of a feature with up to so many values are broadcast: a choice of plan, the result is the same.
FEW_VALUES = 10_000
TARGET_FLAG = "Target column contains missing values; pairwise rows were dropped per test."

RESULT_SCHEMA = (
    "ordinal int, feature string, test_type string, n bigint, statistic double, df1 double, df2 double, "
    "p_value double, effect_size double, correlation double"
)
ANOVA_SCHEMA = (
    "ordinal int, feature string, rows bigint, n bigint, k bigint, ssb double, ssw double, f_stat double, "
    "df1 double, df2 double, eta_squared double"
)


def _result(df: DataFrame, test_type: str, **cols: Column) -> DataFrame:
    none = F.lit(None).cast("double")
    return df.select(
        F.col("ordinal").cast("int").alias("ordinal"),
        F.col("feature"),
        F.lit(test_type).alias("test_type"),
        cols["n"].cast("bigint").alias("n"),
        *[cols.get(k, none).cast("double").alias(k) for k in ("statistic", "df1", "df2", "p_value", "effect_size", "correlation")],
    )


def _long(df: DataFrame, cells: Sequence[Column], target: Column) -> DataFrame:
    """(ordinal, x, y) rows where both sides are present; the ordinal stands for the feature."""
    packed = F.array(*[F.struct(F.lit(i).alias("ordinal"), x.alias("x")) for i, x in enumerate(cells)])
    rows = df.select(target.alias("y"), packed.alias("cells")).filter(F.col("y").isNotNull())
    return rows.select("y", F.inline("cells")).filter(F.col("x").isNotNull())


def _feature(features: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in features]), F.col("ordinal") + 1).alias("feature")


# --- moments by class and by category --------------------------------------------------


def class_moments(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """(class, ordinal, feature, n, mean, var) of numeric features per target class."""
    key = free_name(features, "_class")
    rows = df.select(value(df, target).alias(key), *[c(n) for n in dict.fromkeys(features)])
    rows = rows.filter(F.col(key).isNotNull())
    long = per_column_agg(
        rows,
        features,
        lambda n: {a: f"{fn}({number_sql(rows, n)})" for a, fn in (("n", "count"), ("mean", "avg"), ("var", "var_samp"))},
        keys=[key],
    )
    return long.filter(F.col("n") > 0).select(
        F.col(key).alias("class"), "ordinal", F.col("column").alias("feature"), "n", "mean", "var"
    )


def _digest(col: Column) -> Column:
    """Bytes that stand for a text where it is a key only: its own if they are fewer than sixteen, else a digest of sixteen."""
    return F.when(F.octet_length(col) < 16, col.cast("binary")).otherwise(F.unhex(F.md5(col)))


def category_moments(df: DataFrame, target: str, features: Sequence[str], digest: bool = False) -> DataFrame:
    """(class, ordinal, feature, n, mean, var) of a numeric target per feature level. With
    ``digest`` a level is named by its digest, so whole texts are not shuffled."""
    levels = [_digest(text(df, n)) if digest else text(df, n) for n in features]
    long = _long(df, levels, number(df, target))
    grouped = long.groupBy("ordinal", F.col("x").alias("class")).agg(
        F.count("y").alias("n"), F.avg("y").alias("mean"), F.var_samp("y").alias("var")
    )
    return grouped.select("class", "ordinal", _feature(features), "n", "mean", "var")


def anova(moments: DataFrame, centres: dict[str, float] | None = None) -> DataFrame:
    """One-way ANOVA per feature from group moments.

    Groups below ``MIN_GROUP`` rows are left out; two groups must remain. ``rows`` counts
    all rows, ``n`` those of the kept groups. ``centres`` has the overall mean per feature:
    group means are taken relative to it, so that a single pass over the groups is
    numerically safe. Any value near the mean will do, the result does not depend on it.
    """
    if centres is None:
        overall = F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("centre")
        centres = {r["feature"]: r["centre"] for r in moments.groupBy("feature").agg(overall).collect()}
    if not centres:
        return moments.sparkSession.createDataFrame([], ANOVA_SCHEMA)
    places = F.create_map(*[F.lit(v) for pair in centres.items() for v in (pair[0], float(pair[1] or 0.0))])
    keep = F.col("n") >= MIN_GROUP
    n = F.when(keep, F.col("n"))
    shifted = F.col("mean") - F.coalesce(F.element_at(places, F.col("feature")), F.lit(0.0))
    sums = moments.groupBy("ordinal", "feature").agg(
        F.sum("n").alias("rows"),
        F.count_if(keep).alias("k"),
        F.sum(n).alias("n"),
        F.sum(n * shifted).alias("s1"),
        F.sum(n * shifted * shifted).alias("s2"),
        F.sum((n - 1) * F.col("var")).alias("ssw"),
    )
    between = F.greatest(F.col("s2") - F.col("s1") * F.col("s1") / F.col("n"), F.lit(0.0))
    df1, df2 = F.col("k") - 1, F.col("n") - F.col("k")
    ratio = F.try_divide(F.col("ssb") / df1, F.try_divide(F.col("ssw"), df2))
    f = F.when((F.col("ssw") == 0) & (F.col("ssb") > 0), F.lit(float("inf"))).otherwise(ratio)
    return (
        sums.filter(F.col("k") >= 2)
        .withColumn("ssb", between)
        .select(
            "ordinal",
            "feature",
            "rows",
            "n",
            "k",
            "ssb",
            "ssw",
            f.alias("f_stat"),
            df1.cast("double").alias("df1"),
            df2.cast("double").alias("df2"),
            F.coalesce(F.try_divide(F.col("ssb"), F.col("ssb") + F.col("ssw")), F.lit(0.0)).alias("eta_squared"),
        )
    )


def anova_by_class(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    means = df.filter(value(df, target).isNotNull()).agg(*[F.avg(number(df, n)).alias(f"m{i}") for i, n in enumerate(features)]).first()
    return anova(class_moments(df, target, features), {n: means[f"m{i}"] for i, n in enumerate(features)})


def anova_by_category(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    centre = df.agg(F.avg(number(df, target))).first()[0]
    return anova(category_moments(df, target, features, digest=True), dict.fromkeys(features, centre))


def cohens_d(moments: DataFrame) -> DataFrame:
    """|d| per feature with two classes, pooled sample variance; 0 when nothing varies."""
    ends = moments.groupBy("ordinal", "feature").agg(
        F.count(F.lit(1)).alias("k"),
        F.min(F.struct("class", "n", "mean", "var")).alias("a"),
        F.max(F.struct("class", "n", "mean", "var")).alias("b"),
    )

    def scatter(side: str) -> Column:
        return (F.col(f"{side}.n") - 1) * F.coalesce(f"{side}.var", F.lit(0.0))

    freedom = F.greatest(F.lit(1), F.col("a.n") + F.col("b.n") - 2)
    pooled = F.sqrt((scatter("a") + scatter("b")) / freedom)
    d = F.coalesce(F.try_divide(F.col("a.mean") - F.col("b.mean"), pooled), F.lit(0.0))
    return ends.filter(F.col("k") == 2).select(
        "ordinal", "feature", F.col("a.n").alias("n0"), F.col("b.n").alias("n1"), F.abs(d).alias("cohens_d")
    )


# --- ranks -----------------------------------------------------------------------------


def average_ranks(counted: DataFrame, by: Sequence[str], order: str, n: str, bucket: Column | None) -> DataFrame:
    """Add ``avg_rank``: the mean position of tied values within a group."""
    placed = running_totals(counted, by, [order], [n], bucket)
    return placed.withColumn("avg_rank", F.col(f"{n}_before") + (F.col(n) + 1) / 2.0)


def mann_whitney(
    df: DataFrame,
    target: str,
    features: Sequence[str],
    first_class: dict[str, object] | None = None,
    n_rows: int | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """(ordinal, feature, n0, n1, u_stat, tie_term, z) for targets with two classes.

    Class 0 is the smaller of the two values found with the feature. Ranks come from
    value counts and running totals over value ranges.
    """
    if first_class is None:
        ends = class_moments(df, target, features).groupBy("feature").agg(F.min("class").alias("first")).collect()
        first_class = {r["feature"]: r["first"] for r in ends}
    features = [n for n in features if n in first_class]
    y = value(df, target)
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("ordinal"),
                number(df, n).alias("x"),
                (y == _same_type(first_class[n], df, target)).cast("int").alias("zero"),
            )
            for i, n in enumerate(features)
        ]
    )
    long = df.select(cells.alias("cells")).select(F.inline("cells")).filter("x is not null and zero is not null")
    counted = long.groupBy("ordinal", "x").agg(F.count(F.lit(1)).alias("n"), F.sum("zero").alias("zeros"))
    size = (df.count() if n_rows is None else n_rows) * len(features)
    ranked = average_ranks(counted, ["ordinal"], "x", "n", range_bucket(long, ["ordinal", "x"], size, rows_per_bucket))
    n = F.col("n").cast("double")
    sums = ranked.groupBy("ordinal").agg(
        F.sum("zeros").alias("n0"),
        (F.sum("n") - F.sum("zeros")).alias("n1"),
        F.sum(F.col("zeros") * F.col("avg_rank")).alias("r0"),
        F.sum(n * n * n - n).alias("tie_term"),
    )
    n0, n1 = F.col("n0").cast("double"), F.col("n1").cast("double")
    total = n0 + n1
    u = F.col("r0") - n0 * (n0 + 1) / 2
    spread = F.sqrt(n0 * n1 / 12.0 * (total + 1 - F.try_divide(F.col("tie_term"), total * (total - 1))))
    z = F.try_divide(F.greatest(u, n0 * n1 - u) - n0 * n1 / 2 - 0.5, spread)
    return sums.select("ordinal", _feature(features), "n0", "n1", u.alias("u_stat"), "tie_term", z.alias("z"))


def _same_type(v: object, df: DataFrame, target: str) -> Column:
    dt = dtype_of(df, target)
    return F.lit(str(v)).cast(dt) if is_temporal(dt) else F.lit(v).cast(dt)


def pearson(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """(ordinal, feature, n, r, t) over pair-complete rows, one fused scan."""
    y = number_sql(df, target)
    out = per_column_agg(
        df, features, lambda n: {"n": f"regr_count({y}, {number_sql(df, n)})", "r": corr_sql(number_sql(df, n), y)}
    )
    r, n = F.col("r"), F.col("n")
    t = F.try_divide(r * F.sqrt(F.greatest(n - 2, F.lit(0))), F.sqrt((1 - r) * (1 + r)))
    return out.select("ordinal", F.col("column").alias("feature"), "n", "r", t.alias("t_stat"))


def spearman(
    df: DataFrame,
    target: str,
    features: Sequence[str],
    n_rows: int | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """(ordinal, feature, n, rho) over pair-complete rows, average ranks on ties.

    Features are ranked from their value counts, and the rows take the ranks: those of a feature with
    few values by a broadcast, others by value, see ``_with_ranks``. Rows are then summed up per value
    of the target, and its ranks come from one scan of these sums in ranges: no rank of the target is
    joined to rows, and features with few values share the scan.
    """
    x, y = [number(df, n) for n in features], number(df, target)
    long = _long(df, x, y)
    counts = materialize(long.groupBy("ordinal", "x").agg(F.count(F.lit(1)).alias("pairs")))
    facts = counts.groupBy("ordinal").agg(F.count(F.lit(1)).alias("values"), F.sum("pairs").alias("n")).collect()
    size = {r["ordinal"]: r["n"] for r in facts}  # a feature without pairs has no row
    few = [r["ordinal"] for r in facts if r["values"] <= FEW_VALUES]
    many = [i for i in size if i not in few]
    if not size:
        return df.sparkSession.createDataFrame([], "ordinal int, feature string, n bigint, rho double")

    def ranks_of(chosen: list[int], bucket: Column | None) -> DataFrame:
        """Ranks less their mean."""
        middle = F.element_at(F.create_map(*[F.lit(v) for i in chosen for v in (i, (size[i] + 1) / 2.0)]), F.col("ordinal"))
        placed = average_ranks(counts.filter(F.col("ordinal").isin(chosen)), ["ordinal"], "x", "pairs", bucket)
        return placed.select("ordinal", "x", "pairs", (F.col("avg_rank") - middle).alias("dx"))

    sums, ranks = [], []
    present = df.select(y.alias("y"), *[col.alias(f"x{i}") for i, col in enumerate(x)]).filter(F.col("y").isNotNull())
    for start in range(0, len(few), COLUMNS_PER_AGGREGATE):
        chosen = few[start : start + COLUMNS_PER_AGGREGATE]
        placed = ranks_of(chosen, None)
        ranks.append(placed)
        rows = present
        for i in chosen:
            its = placed.filter(F.col("ordinal") == i).select(F.col("x").alias(f"x{i}"), F.col("dx").alias(f"dx{i}"))
            rows = rows.join(F.broadcast(its), f"x{i}", "left")  # at most FEW_VALUES rows
        bucket = range_bucket(present, ["y"], df.count() if n_rows is None else n_rows, rows_per_bucket)
        cells = [a for i in chosen for a in (F.count(f"dx{i}").alias(f"n{i}"), F.sum(f"dx{i}").alias(f"s{i}"))]
        sums.append(_rank_sums(rows.groupBy("y").agg(*cells), chosen, bucket))
    if many:
        placed = materialize(ranks_of(many, range_bucket(counts, ["ordinal", "x"], sum(r["values"] for r in facts), rows_per_bucket)))
        ranks.append(placed)
        wanted = long.filter(F.col("ordinal").isin(many))
        pairs = wanted.groupBy("ordinal", "x", "y").agg(F.count(F.lit(1)).alias("n"))
        ranked = _with_ranks(pairs, placed, "x")
        cells = [F.sum("n").alias("n"), F.sum(F.col("n") * F.col("dx")).alias("s")]
        bucket = range_bucket(wanted, ["ordinal", "y"], sum(size[i] for i in many), rows_per_bucket)
        sums.append(_rank_sums(ranked.groupBy("ordinal", "y").agg(*cells), None, bucket))

    n = F.col("n")
    earlier = Window.partitionBy("ordinal").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = F.element_at(F.create_map(*[F.lit(v) for i, k in size.items() for v in (i, k)]), F.col("ordinal"))
    # Rows of a range are ``shift`` further from the mean rank than their place within it.
    shift = F.coalesce(F.sum("n").over(earlier), F.lit(0)) - (sizes + 1) / 2.0
    moved = union_all(sums).withColumn("shift", shift)
    by_y = moved.groupBy("ordinal").agg(
        F.sum("n").alias("n"),
        F.sum("values").alias("values"),
        F.sum(F.col("sl") + F.col("shift") * F.col("s")).alias("sxy"),
        F.sum(F.col("nll") + F.col("shift") * (2 * F.col("nl") + F.col("shift") * n)).alias("syy"),
    )
    by_x = union_all(ranks).groupBy("ordinal").agg(F.sum(F.col("pairs") * F.col("dx") * F.col("dx")).alias("sxx"))
    syy = F.when(F.col("values") > 1, F.greatest(F.col("syy"), F.lit(0.0))).otherwise(0.0)
    rho = F.try_divide(F.col("sxy"), F.sqrt(F.col("sxx")) * F.sqrt(syy))
    rho = F.when(rho.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), rho)))
    return by_y.join(F.broadcast(by_x), "ordinal").select("ordinal", _feature(features), "n", rho.alias("rho"))  # a row per feature


def _rank_sums(grouped: DataFrame, chosen: Sequence[int] | None, bucket: Column | None) -> DataFrame:
    """Per ordinal and range of y: its rows ``n``, values of y, the sum ``s`` of the other side's ranks, and sums
    of both by the average rank within the range. ``grouped`` has a row per y with columns n<i> and
    s<i> of the chosen ordinals, or (without) a row per ordinal and y."""
    by, slots = (["ordinal"], [""]) if chosen is None else ([], chosen)
    keys = [*by, "bucket"]
    inside = Window.partitionBy(*keys).orderBy("y").rowsBetween(Window.unboundedPreceding, -1)
    cut = grouped.withColumn("bucket", F.lit(0) if bucket is None else bucket)
    places = [(F.coalesce(F.sum(f"n{i}").over(inside), F.lit(0)) + (F.col(f"n{i}") + 1) / 2.0).alias(f"l{i}") for i in slots]
    placed = cut.select(*keys, *[f"{a}{i}" for i in slots for a in "ns"], *places)
    aggs = []
    for i in slots:
        n, s, at = F.col(f"n{i}"), F.col(f"s{i}"), F.col(f"l{i}")
        found = {"n": F.sum(n), "values": F.count_if(n > 0), "s": F.sum(s), "sl": F.sum(s * at), "nl": F.sum(n * at), "nll": F.sum(n * at * at)}
        aggs += [F.coalesce(v, F.lit(0)).alias(f"{a}_{i}") for a, v in found.items()]
    names = ("n", "values", "s", "sl", "nl", "nll")
    summed = placed.groupBy(*keys).agg(*aggs)
    if chosen is None:
        return summed.select("ordinal", "bucket", *[F.col(f"{a}_").alias(a) for a in names])
    rows = [F.struct(F.lit(i).alias("ordinal"), "bucket", *[F.col(f"{a}_{i}").alias(a) for a in names]) for i in slots]
    return summed.select(F.inline(F.array(*rows)))


def hot_values(ranks: DataFrame, share: float = HOT_SHARE) -> DataFrame:
    """The values that more than ``share`` of all pairs hold: at most 1 / share rows."""
    limit = share * (ranks.agg(F.sum("pairs")).first()[0] or 0)
    return ranks.filter(F.col("pairs") > limit)


def _with_ranks(pairs: DataFrame, ranks: DataFrame, col: str, share: float = HOT_SHARE) -> DataFrame:
    """Add the columns of ``ranks`` (one row per ordinal and value) to the pairs, looked up by value.

    Values are counted already, so the hot ones are known exactly: their ranks are broadcast.
    Pairs of a hot value are spread by a salt over the join of the others, in which they
    find nothing, so no task gets more of them than of any other pairs. The salt of a rank is 0
    by way of its count: a literal would be taken out of the join keys.
    """
    more = [n for n in ranks.columns if n not in ("ordinal", col, "pairs")]
    hot = hot_values(ranks, share).select("ordinal", col, *[F.col(n).alias(f"hot_{n}") for n in more])
    marked = pairs.join(F.broadcast(hot), ["ordinal", col], "left")
    other = F.col("y" if col == "x" else "x")
    salt = F.when(F.col(f"hot_{more[0]}").isNotNull(), F.xxhash64(other)).otherwise(F.lit(0))
    zero = F.least(F.col("pairs"), F.lit(0).cast("bigint"))
    found = marked.withColumn("salt", salt).join(ranks.withColumn("salt", zero).drop("pairs"), ["ordinal", col, "salt"], "left")
    looked_up = [F.coalesce(F.col(f"hot_{n}"), F.col(n)).alias(n) for n in more]
    return found.select(*pairs.columns, *looked_up)


# --- contingency -----------------------------------------------------------------------


def contingency(df: DataFrame, target: str, features: Sequence[str], digest: bool = False) -> DataFrame:
    """(ordinal, feature, level, class, n): non-empty cells of every feature x target table.
    With ``digest`` levels and classes are named by their digests."""
    cells = [_digest(text(df, n)) if digest else text(df, n) for n in features]
    long = _long(df, cells, _digest(text(df, target)) if digest else text(df, target))
    counted = long.groupBy("ordinal", F.col("x").alias("level"), F.col("y").alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select("ordinal", _feature(features), "level", "class", "n")


def chi_square(cells: DataFrame) -> DataFrame:
    """Chi-square test of independence per feature from non-empty cells.

    Level and class totals are joined to the cells; empty cells add their expected
    counts, which is what the non-empty ones leave over. A 2 x 2 table gets the Yates
    correction: all four cells share one |O - E|, so no empty cell is built there either.
    """
    level_totals = cells.groupBy("ordinal", "level").agg(F.sum("n").alias("level_n"))
    class_totals = cells.groupBy("ordinal", "class").agg(F.sum("n").alias("class_n"))
    levels = level_totals.groupBy("ordinal").agg(F.count(F.lit(1)).alias("r"), F.product(F.col("level_n").cast("double")).alias("level_prod"))
    classes = class_totals.groupBy("ordinal").agg(
        F.count(F.lit(1)).alias("k"), F.sum("class_n").alias("n"), F.product(F.col("class_n").cast("double")).alias("class_prod")
    )
    shape = levels.join(F.broadcast(classes), "ordinal")  # a row per feature
    joined = (
        cells.withColumnRenamed("n", "observed")
        .join(level_totals, ["ordinal", "level"])
        .join(class_totals, ["ordinal", "class"])
        .join(F.broadcast(classes.select("ordinal", "n")), "ordinal")  # a row per feature
    )
    expected = F.col("level_n") * (F.col("class_n") / F.col("n"))
    gap = F.abs(F.col("observed") - expected)
    sums = joined.groupBy("ordinal", "feature").agg(
        F.sum(gap * gap / expected).alias("filled"),
        F.sum(expected).alias("expected_filled"),
        F.count(F.lit(1)).alias("cells"),
        F.max(gap).alias("gap"),
    )
    r, k, n = F.col("r"), F.col("k"), F.col("n").cast("double")
    dof = (r - 1) * (k - 1)
    empty = F.when(F.col("cells") < r * k, F.greatest(n - F.col("expected_filled"), F.lit(0.0))).otherwise(0.0)
    corrected = F.greatest(F.col("gap") - 0.5, F.lit(0.0))
    yates = corrected * corrected * (n * n / F.col("level_prod")) * (n / F.col("class_prod"))
    chi2 = F.when(dof == 1, yates).otherwise(F.col("filled") + empty)
    smaller = F.least(r, k) - 1
    return (
        sums.join(F.broadcast(shape), "ordinal")
        .filter((r >= 2) & (k >= 2))
        .select(
            "ordinal",
            "feature",
            F.col("n").alias("n"),
            chi2.alias("chi2"),
            dof.cast("double").alias("dof"),
            F.sqrt(chi2 / n / smaller).alias("cramers_v"),
        )
    )


# --- all tests of one target -----------------------------------------------------------


def target_flags(df: DataFrame, target: str) -> DataFrame:
    """One row with the quality flags of the target column."""
    if target not in df.columns:
        raise ValueError(f"Target column '{target}' is not present in dataframe.")
    gaps = F.count_if(value(df, target).isNull())
    flags = F.array_compact(F.array(F.when(gaps > 0, F.lit(TARGET_FLAG))))
    return df.agg(gaps.alias("target_missing"), flags.alias("flags"))


def run_tests(df: DataFrame, target: str, features: Sequence[str], target_type: str) -> DataFrame:
    """One row per tested feature (``RESULT_SCHEMA`` plus target and target_type).

    The test is chosen by data type: for classes, numbers take Mann-Whitney (two
    classes) or ANOVA, anything else chi-square; for a numeric target, numbers take
    Pearson with Spearman, anything else ANOVA. Unknown features and the target itself
    are skipped; so are features with too few rows.
    """
    if target not in df.columns:
        raise ValueError(f"Target column '{target}' is not present in dataframe.")
    wanted = [n for n in dict.fromkeys(features) if n in df.columns and n != target]
    numeric = [n for n in wanted if is_number_or_bool(dtype_of(df, n))]
    other = [n for n in wanted if n not in numeric]
    parts: list[DataFrame] = []
    if target_type == "classification":
        if numeric:
            parts += _numeric_by_class(df, target, numeric)
        if other:
            parts.append(_categories_by_class(df, target, other))
    else:
        if numeric:
            parts.append(_numeric_by_number(df, target, numeric))
        if other:
            parts.append(_number_by_category(df, target, other))
    if not parts:
        results = df.sparkSession.createDataFrame([], RESULT_SCHEMA)
    else:
        results = union_all(parts)
    order = F.array_position(F.array(*[F.lit(n) for n in wanted or [""]]), F.col("feature")).cast("int")
    return results.select(
        F.lit(target).alias("target"),
        F.lit(target_type).alias("target_type"),
        "feature",
        order.alias("ordinal"),
        *[n for n in results.columns if n not in ("ordinal", "feature")],
    )


def _numeric_by_class(df: DataFrame, target: str, features: list[str]) -> list[DataFrame]:
    moments = class_moments(df, target, features)
    facts = (
        moments.groupBy("feature")
        .agg(
            F.count(F.lit(1)).alias("k"),
            F.sum("n").alias("n"),
            F.min("n").alias("least"),
            F.min("class").alias("first"),
            (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("centre"),
        )
        .collect()
    )
    enough = {r["feature"]: r for r in facts if r["n"] >= MIN_ROWS}
    two = [n for n in features if n in enough and enough[n]["k"] == 2 and enough[n]["least"] >= MIN_GROUP]
    many = [n for n in features if n in enough and enough[n]["k"] > 2]
    parts = []
    if two:
        first = {n: enough[n]["first"] for n in two}
        u = mann_whitney(df, target, two, first, n_rows=max(enough[n]["n"] for n in two))
        d = cohens_d(moments).select("feature", "cohens_d")
        joined = u.join(d, "feature")
        p = mann_whitney_tail("u_stat", F.col("n0").cast("double"), F.col("n1").cast("double"), "tie_term")
        parts.append(
            _result(joined, "mann_whitney_u", n=F.col("n0") + F.col("n1"), statistic=F.col("u_stat"), p_value=p, effect_size=F.col("cohens_d"))
        )
    if many:
        tested = anova(moments.filter(F.col("feature").isin(many)), {n: enough[n]["centre"] for n in many})
        parts.append(_anova_result(tested, "anova_multi_class"))
    return parts


def _anova_result(tested: DataFrame, test_type: str) -> DataFrame:
    return _result(
        tested.filter(F.col("rows") >= MIN_ROWS),
        test_type,
        n=F.col("rows"),
        statistic=F.col("f_stat"),
        df1=F.col("df1"),
        df2=F.col("df2"),
        p_value=f_tail("f_stat", "df1", "df2"),
        effect_size=F.col("eta_squared"),
    )


def _categories_by_class(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    tested = chi_square(contingency(df, target, features, digest=True)).filter(F.col("n") >= MIN_ROWS)
    return _result(
        tested, "chi_square", n=F.col("n"), statistic=F.col("chi2"), df1=F.col("dof"),
        p_value=chi2_tail("chi2", "dof"), effect_size=F.col("cramers_v"),
    )


def _numeric_by_number(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    straight = pearson(df, target, features).filter(F.col("n") >= MIN_ROWS)
    ranked = spearman(df, target, features).select("feature", "rho")
    joined = straight.join(ranked, "feature")
    return _result(
        joined, "pearson_spearman", n=F.col("n"), statistic=F.col("t_stat"), df1=F.col("n") - 2,
        p_value=pearson_tail("r", F.col("n").cast("double")), effect_size=F.abs("r"),
        correlation=F.coalesce("rho", "r"),
    )


def _number_by_category(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    return _anova_result(anova_by_category(df, target, features), "anova")


def with_confidence(results: DataFrame) -> DataFrame:
    """Add ``confidence_score``; missing parts count as 0."""
    # Weights of significance, effect, correlation and importance.
    certainty = F.when(F.col("p_value").isNotNull(), clamp01(1.0 - F.col("p_value"))).otherwise(0.0)
    score = (
        0.35 * certainty
        + 0.25 * share(F.col("effect_size"))
        + 0.2 * share(F.col("correlation"))
        + 0.2 * share(F.col("feature_importance"))
    )
    return results.withColumn("confidence_score", exact_round(score, 4))


def quality_flags(df: DataFrame, target: str) -> list[str]:
    """Flags of the target column, as they belong to a bundle of results."""
    return list(target_flags(df, target).first()["flags"])


def result_bundle(
    df: DataFrame,
    target: str,
    features: Sequence[str],
    target_type: str,
    importance: DataFrame | None = None,
    tests: DataFrame | None = None,
) -> DataFrame:
    """Test results with model importance (feature, feature_importance) and confidence.
    ``tests`` are results at hand, else the tests are run here."""
    if tests is None:
        tests = run_tests(df, target, features, target_type)
    if importance is None:
        scored = tests.withColumn("feature_importance", F.lit(None).cast("double"))
    else:
        scored = tests.join(importance.select("feature", "feature_importance"), "feature", "left")
    model = "random_forest_classifier" if target_type == "classification" else "random_forest_regressor"
    flags = F.array(*[F.lit(x) for x in quality_flags(df, target)]).cast("array<string>")
    full = with_confidence(scored).withColumn("model_type_used", F.lit(model)).withColumn("data_quality_flags", flags)
    return full.select("target", "target_type", *[n for n in full.columns if n not in ("target", "target_type")])
