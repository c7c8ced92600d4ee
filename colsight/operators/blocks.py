"""Building blocks the operators share.

* ``per_column_agg``   one scan, one aggregate for many columns, result in long form
* ``value_counts`` / ``frequency_stats``   typed frequency tables
* ``exact_quantiles``  interpolated quantiles without a shuffle of the rows
* ``range_bucket`` / ``running_totals``   ordered scans split over many tasks
* ``duplicate_count``  surplus copies of rows
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colsight.functions.exprs import c, dtype_of, free_name, literal, number, quoted, value, value_sql

COLUMNS_PER_AGGREGATE = 12
LONG_TEXT_LENGTH = 128
ROWS_PER_BUCKET = 2_000_000
MAX_BUCKETS = 2048
QUANTILE_CELL = 100_000
# Values that a sketch takes as a rule: of more, a share is drawn. A sketch only proposes where to
# count; every row is counted on either side of it, so the draw can't change a result.
SKETCH_ROWS = 1_000_000
# Distance from a wanted rank to the fence that is sought for it, in standard errors of the draw.
DRAW_ERRORS = 5.0
SUSPECT_LIMIT = 1_000_000


# Two values around the ranks of a quantile, by name of the column and probability.
Cuts = dict[tuple[str, float], tuple[float, float]]


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def per_column_agg(
    df: DataFrame,
    columns: Sequence[str],
    metrics: Callable[[str], dict[str, str]],
    keys: Sequence[str] = (),
) -> DataFrame:
    """Run ``metrics`` (result name -> SQL aggregate) for every column in one aggregate and
    return one row per column (and per group of ``keys``). Wide tables are cut into
    aggregates of up to ``COLUMNS_PER_AGGREGATE`` columns: beyond that the generated code
    is too large to be compiled well. Each reads its own columns only."""
    parts = []
    slot = free_name(keys, "_m")
    numbered = list(enumerate(columns))
    n_chunks = max(1, -(-len(numbered) // COLUMNS_PER_AGGREGATE))
    size = max(1, -(-len(numbered) // n_chunks))
    for start in range(0, len(numbered), size):
        aggs, rows = [], []
        for i, n in numbered[start : start + size]:
            found = metrics(n)
            aggs.append(F.expr(f"struct({', '.join(f'{e} AS {a}' for a, e in found.items())})").alias(f"{slot}{i}"))
            fields = ", ".join(f"{slot}{i}.{a} AS {a}" for a in found)
            rows.append(f"struct({i} AS ordinal, {literal(n)} AS column, {fields})")
        wide = df.groupBy(*[c(k) for k in keys]).agg(*aggs)
        parts.append(wide.selectExpr(*[quoted(k) for k in keys], f"inline(array({', '.join(rows)}))"))
    return union_all(parts)


def gap_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(ordinal, column, n_rows, n_missing) of any number of columns."""
    return per_column_agg(df, columns, lambda n: {"n_rows": "count(1)", "n_missing": f"count_if({value_sql(df, n)} IS NULL)"})


def comparable(df: DataFrame, name: str) -> Column:
    """The column in a form that can be hashed and grouped: a map as its sorted entries,
    a nested type with maps inside as JSON."""
    dt = dtype_of(df, name)
    if isinstance(dt, T.MapType) and "map<" not in dt.valueType.simpleString():
        return F.array_sort(F.map_entries(c(name)))
    if "map<" in dt.simpleString():
        return F.when(c(name).isNotNull(), F.to_json(F.struct(c(name))))
    return value(df, name)


def value_counts(df: DataFrame, name: str) -> DataFrame:
    """Typed (value, n) of one column, missing values left out."""
    v = value(df, name)
    return df.select(v.alias("value")).filter(F.col("value").isNotNull()).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def long_text_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """String columns that are long on average. Only steers how distinct values are counted,
    never the result."""
    names = [n for n in columns if isinstance(dtype_of(df, n), T.StringType)]
    if not names:
        return []
    lengths = per_column_agg(df, names, lambda n: {"mean": f"avg(length({quoted(n)}))"}).collect()
    return [r["column"] for r in lengths if r["mean"] is not None and r["mean"] > LONG_TEXT_LENGTH]


def _digest_stats(df: DataFrame, ordinal: int, name: str, measures: Mapping[str, str]) -> DataFrame:
    """Distinct count and top value of a long text column. Only 16-byte digests are
    shuffled; the texts themselves are read once more to find the smallest top text."""
    keyed = df.select(c(name).alias("value"), F.unhex(F.md5(c(name))).alias("digest")).filter(F.col("value").isNotNull())
    counts = keyed.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    by_count = counts.groupBy("n").agg(F.count(F.lit(1)).alias("texts"))
    found = by_count.agg(F.sum("texts").alias("distinct"), F.max(F.struct("n", "texts")).alias("top")).first()
    if found["distinct"] is None:
        distinct, top_n, texts = 0, None, 0
    else:
        distinct, (top_n, texts) = found["distinct"], found["top"]
    if top_n is None or top_n == 1:
        winners = keyed
    else:
        best = counts.filter(F.col("n") == top_n).select("digest")
        winners = keyed.join(F.broadcast(best) if texts <= SUSPECT_LIMIT else best, "digest", "left_semi")
    measured = {}
    if measures:
        measured = keyed.withColumn("n", F.lit(1)).agg(*[F.expr(e).alias(a) for a, e in measures.items()]).first().asDict()
    return winners.agg(F.min("value").alias("top_value")).select(
        F.lit(ordinal).alias("ordinal"),
        F.lit(int(distinct)).cast("bigint").alias("n_distinct"),
        "top_value",
        F.lit(top_n).cast("bigint").alias("top_frequency"),
        *[F.lit(measured[a]).cast("double").alias(a) for a in measures],
    )


def _family(dt: T.DataType) -> T.DataType:
    """Type in which the values of a column are counted: integers share one."""
    return T.LongType() if isinstance(dt, T.IntegralType) else dt


def _families(df: DataFrame, columns: Sequence[str]) -> dict[T.DataType, list[int]]:
    out: dict[T.DataType, list[int]] = {}
    for i, n in enumerate(columns):
        out.setdefault(_family(dtype_of(df, n)), []).append(i)
    return out


def typed_counts(df: DataFrame, columns: Sequence[str], dt: T.DataType, ordinals: Sequence[int]) -> DataFrame:
    """(ordinal, value, n) of the columns of one type family."""
    cells = [f"struct({i} AS ordinal, cast({value_sql(df, columns[i])} AS {dt.simpleString()}) AS value)" for i in ordinals]
    long = df.selectExpr(f"inline(array({', '.join(cells)}))").filter("value is not null")
    return long.groupBy("ordinal", "value").agg(F.count(F.lit(1)).alias("n"))


def _best(counts: DataFrame, *more: Column) -> DataFrame:
    """Per ordinal: distinct values and the smallest of the most frequent ones."""
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col("value").alias("value"))).alias("best")
    # With an object buffer among its functions the aggregate hashes the few ordinals;
    # without one, a minimum over structs would sort all distinct values first.
    hashed = F.collect_set("ordinal").alias("ordinals")
    found = counts.groupBy("ordinal").agg(F.count(F.lit(1)).alias("n_distinct"), best, hashed, *more)
    return found.withColumn("ordinal", F.col("ordinals")[0]).drop("ordinals")


def frequency_stats(df: DataFrame, columns: Sequence[str], text_measures: Mapping[str, str] | None = None) -> DataFrame:
    """(ordinal, n_distinct, top_value, top_frequency) per column; the top value is the
    smallest of the most frequent ones, compared by its own type.

    Columns of one type are counted together: one scan and one shuffle per type, and
    counts are combined before the shuffle, so a hot value is one row per task. Columns
    without any value still get their row.

    ``text_measures`` (name -> SQL aggregate over ``value`` and its count ``n``) are taken
    for text columns along the way: what depends on the value alone is evaluated once
    per distinct value.
    """
    measures = dict(text_measures or {})
    long_text = set(long_text_columns(df, columns))
    short = [n for n in columns if n not in long_text]
    parts = [_digest_stats(df, i, n, measures) for i, n in enumerate(columns) if n in long_text]
    for dt, places in _families(df, short).items():
        ordinals = [columns.index(short[i]) for i in places]
        wanted = {a: (e if isinstance(dt, T.StringType) else "max(cast(NULL AS double))") for a, e in measures.items()}
        best = _best(typed_counts(df, columns, dt, ordinals), *[F.expr(e).alias(a) for a, e in wanted.items()])
        top = F.col("best.value").cast("string")
        parts.append(
            best.select(
                "ordinal",
                "n_distinct",
                (F.initcap(top) if isinstance(dt, T.BooleanType) else top).alias("top_value"),
                (-F.col("best.neg")).alias("top_frequency"),
                *measures,
            )
        )
    every = df.sparkSession.range(len(columns)).select(F.col("id").cast("int").alias("ordinal"))
    counted = every.join(union_all(parts), "ordinal", "left")
    return counted.select("ordinal", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"), "top_value", "top_frequency", *measures)


def smallest_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, object]:
    """Typed smallest mode per column, None when all values are missing."""
    out: dict[str, object] = {n: None for n in columns}
    long_text = long_text_columns(df, columns)
    for i, n in enumerate(long_text):  # only digests are shuffled, the text is read again for the winner
        out[n] = _digest_stats(df, i, n, {}).first()["top_value"]
    columns = [n for n in columns if n not in long_text]
    families = _families(df, columns)
    parts = []
    for k, (dt, ordinals) in enumerate(families.items()):
        slots = [
            (F.col("best.value") if j == k else F.lit(None).cast(t)).alias(f"v{j}") for j, t in enumerate(families)
        ]
        parts.append(_best(typed_counts(df, columns, dt, ordinals)).select("ordinal", F.lit(k).alias("family"), *slots))
    for row in union_all(parts).collect() if parts else []:
        out[columns[row["ordinal"]]] = row[f"v{row['family']}"]
    return out


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str | tuple[str, Column]],
    probs: Sequence[float],
    cell: int = QUANTILE_CELL,
    width: int = COLUMNS_PER_AGGREGATE,
    sizes: Mapping[str, int] | None = None,
    fences: Cuts | None = None,
) -> dict[str, list[float] | None]:
    """Interpolated quantiles of many columns (None for a column without values).

    Columns are taken ``width`` at a time, so that an aggregate holds a bounded number
    of sketches, and at most ``cell`` values of a fence. ``sizes`` are the numbers of
    present values, if they are known already. ``fences`` are the first fences of an earlier
    call on nearly the same rows: they are tried before a sketch is taken, and those of this
    call are noted there.
    """
    out: dict[str, list[float] | None] = {}
    for start in range(0, len(columns), width):
        out |= _exact_quantiles(df, columns[start : start + width], probs, cell, sizes, {} if fences is None else fences)
    return out


def draw(df: DataFrame, share: float) -> tuple[DataFrame, str]:
    """Rows whose drawn number, in a column of the returned name, is below ``share``."""
    name = free_name(df.columns, "_draw")
    return df.withColumn(name, F.rand(42)).filter(c(name) < share), name


def _exact_quantiles(
    df: DataFrame,
    columns: Sequence[str | tuple[str, Column]],
    probs: Sequence[float],
    cell: int,
    sizes: Mapping[str, int] | None,
    first_cuts: Cuts,
) -> dict[str, list[float] | None]:
    """Quantiles of some columns.

    The exact ``percentile`` aggregate keeps every distinct value of a column in one
    reducer. Here the wanted ranks are fenced in first: a bounded sketch (of drawn rows, if
    there are many) names a value on either side of a rank, a count over all rows tells how
    many lie below, at and between the two, and the fence is narrowed until it is a single
    value or holds at most ``cell`` rows. Only the rows inside the last fence meet the exact aggregate. Every
    round is one fused scan without a shuffle of rows, and a hot value ends a fence
    instead of filling it.
    """
    cols: dict[str, Column] = {}
    for item in columns:
        name, col = item if isinstance(item, tuple) else (item, number(df, item))
        cols[name] = col
    if not cols:
        return {}
    names = list(cols)
    base = df.select(*[cols[n].alias(f"q{i}") for i, n in enumerate(names)])
    if sizes is None:
        counts = base.agg(*[F.count(f"q{i}").alias(f"n{i}") for i in range(len(names))]).first()
        sizes = {n: counts[f"n{i}"] for i, n in enumerate(names)}
    size = {i: sizes[n] for i, n in enumerate(names) if sizes[n]}

    known: dict[tuple[int, int], float] = {}
    fences = []
    for i, n in size.items():
        for p in probs:
            low = int(p * (n - 1))
            ranks = tuple(sorted({low, min(low + 1, n - 1)}))
            fences.append(_Fence(i, p, ranks, None, None, 0, n))

    while wide := [f for f in fences if f.inside > cell]:
        settled = [f for f in fences if f.inside <= cell]
        cuts = {k: first_cuts[key] for k, f in enumerate(wide) if f.whole() and (key := (names[f.column], f.prob)) in first_cuts}
        if sought := {k: f for k, f in enumerate(wide) if k not in cuts}:
            cuts |= _sketched(df, cols, sought)
        first_cuts |= {(names[f.column], f.prob): cuts[k] for k, f in enumerate(wide) if f.whole()}
        found = base.agg(*[m.alias(f"{a}{k}") for k, f in enumerate(wide) for a, m in f.sizes(*cuts[k])]).first()
        for k, f in enumerate(wide):
            lo, hi = cuts[k]
            inner = f.narrow(lo, hi, found[f"below{k}"], found[f"at_lo{k}"], found[f"mid{k}"], found[f"at_hi{k}"], known)
            settled += inner
            if any(g.lo is None or g.hi is None for g in inner):  # missed a rank, not worth another try
                first_cuts.pop((names[f.column], f.prob), None)
        fences = settled

    if fences:
        got = base.agg(*[f.exact().alias(f"p{k}") for k, f in enumerate(fences)]).first()
        for k, f in enumerate(fences):
            known.update({(f.column, r): v for r, v in zip(f.ranks, got[f"p{k}"])})

    out: dict[str, list[float] | None] = {n: None for n in names}
    for i, n in size.items():
        values = []
        for p in probs:
            pos = p * (n - 1)
            low = int(pos)
            a, b = known[i, low], known[i, min(low + 1, n - 1)]
            values.append(a + (b - a) * (pos - low) if a != b else a)
        out[names[i]] = values
    return out


def _sketched(df: DataFrame, cols: Mapping[str, Column], fences: Mapping[int, _Fence]) -> dict[int, tuple[float, float]]:
    """A value on either side of the wanted ranks of every fence. Of a fence with many values a share
    is drawn; a sketch that gets none of them is taken of all."""
    shares = {k: min(1.0, SKETCH_ROWS / f.inside) for k, f in fences.items()}
    values = [col.alias(f"q{i}") for i, col in enumerate(cols.values())]
    drawn, place = draw(df, max(shares.values()))
    cuts = drawn.select(c(place).alias("draw"), *values).agg(*[f.sketch(shares[k]).alias(f"s{k}") for k, f in fences.items()]).first()
    out = {k: cuts[f"s{k}"] for k in fences}
    if empty := [k for k, cut in out.items() if cut is None]:
        out |= df.select(*values).agg(*[fences[k].sketch(1.0).alias(str(k)) for k in empty]).first().asDict()
        out = {int(k): cut for k, cut in out.items() if cut is not None}
    return {k: (cut[0], cut[1]) for k, cut in out.items()}


@dataclass(frozen=True)
class _Fence:
    """Open value range that holds the wanted 0-based ranks of a column."""

    column: int
    prob: float
    ranks: tuple[int, ...]
    lo: float | None
    hi: float | None
    below: int
    inside: int

    def value(self) -> Column:
        return F.col(f"q{self.column}")

    def within(self) -> Column:
        keep = F.lit(True)
        if self.lo is not None:
            keep = keep & (self.value() > self.lo)
        if self.hi is not None:
            keep = keep & (self.value() < self.hi)
        return F.when(keep, self.value())

    def whole(self) -> bool:
        return self.lo is None and self.hi is None

    def sketch(self, share: float) -> Column:
        """Values around the ranks, of those whose ``draw`` is below the share."""
        slack = 2.0 / 10_000 + (DRAW_ERRORS * (0.25 / SKETCH_ROWS) ** 0.5 if share < 1 else 0.0)
        values = self.within() if share >= 1 else F.when(F.col("draw") < share, self.within())
        a = max(0.0, (self.ranks[0] - self.below) / self.inside - slack)
        b = min(1.0, (self.ranks[-1] - self.below + 1) / self.inside + slack)
        return F.percentile_approx(values, [a, b], 10_000)

    def sizes(self, lo: float, hi: float) -> list[tuple[str, Column]]:
        v = self.value()
        return [
            ("below", F.count_if(v < lo)),
            ("at_lo", F.count_if(v == lo)),
            ("mid", F.count_if((v > lo) & (v < hi))),
            ("at_hi", F.count_if(v == hi)),
        ]

    def narrow(
        self, lo: float, hi: float, below: int, at_lo: int, mid: int, at_hi: int, known: dict[tuple[int, int], float]
    ) -> list[_Fence]:
        """Note the ranks that lo or hi answer; return fences for the others."""
        start_mid = below + at_lo
        start_hi = start_mid + mid
        after_hi = start_hi + at_hi if hi > lo else start_mid
        parts: dict[str, list[int]] = {"under": [], "mid": [], "over": []}
        for r in self.ranks:
            if r < below:
                parts["under"].append(r)
            elif r < start_mid:
                known[self.column, r] = lo
            elif r < start_hi:
                parts["mid"].append(r)
            elif r < after_hi:
                known[self.column, r] = hi
            else:
                parts["over"].append(r)
        bounds = {
            "under": (self.lo, lo, self.below, below - self.below),
            "mid": (lo, hi, start_mid, mid),
            "over": (hi, self.hi, after_hi, self.below + self.inside - after_hi),
        }
        return [_Fence(self.column, self.prob, tuple(rs), *bounds[k]) for k, rs in parts.items() if rs]

    def exact(self) -> Column:
        last = max(self.inside - 1, 1)
        return F.percentile(self.within(), [(r - self.below) / last for r in self.ranks])


def range_bucket(df: DataFrame, keys: Sequence[str], n_rows: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> Column | None:
    """Bucket number that grows with the sort order of ``keys``.

    Boundaries come from a random sample of the keys and become literals, so the
    number is a pure function of the row: the same on every evaluation and retry.
    Small inputs need no buckets (None). A bucket number is found by bisection. There are
    at most ``MAX_BUCKETS``, which bounds the sample and the literals; beyond that a range
    has more rows, and its sort spills.
    """
    n_buckets = min(-(-n_rows // rows_per_bucket), MAX_BUCKETS)
    if n_buckets <= 1:
        return None
    fraction = min(1.0, 20.0 * n_buckets / n_rows)
    sample = df.select(*[c(k) for k in keys]).sample(False, fraction, 42).distinct()
    rows = [tuple(r) for r in sample.orderBy(*[c(k) for k in keys]).collect()]
    picked = sorted({int(i * len(rows) / n_buckets) for i in range(1, n_buckets)} - {0}) if rows else []
    bounds = [rows[i] for i in picked if i < len(rows)]
    if not bounds:
        return None

    def as_struct(values: list[Column]) -> Column:
        return F.struct(*[v.alias(f"k{i}") for i, v in enumerate(values)])

    types = [dtype_of(df, k) for k in keys]
    fences = F.array(*[as_struct([F.lit(v).cast(t) for v, t in zip(row, types)]) for row in bounds])
    key = as_struct([c(k) for k in keys])

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        searching = acc["lo"] < acc["hi"]
        right = F.get(fences, mid) <= key
        return F.struct(
            F.when(searching & right, mid + 1).otherwise(acc["lo"]).alias("lo"),
            F.when(searching & ~right, mid).otherwise(acc["hi"]).alias("hi"),
        )

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))
    return F.coalesce(F.aggregate(steps, start, halve)["lo"], F.lit(0))


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    sums: Sequence[str],
    bucket: Column | None,
) -> DataFrame:
    """Add ``<s>_before`` and ``<s>_total`` to rows that are unique per (by, order): the sum
    of ``s`` over the earlier rows and over all rows of the same group.

    Each (group, bucket) is scanned on its own; bucket totals, a small table, carry the
    sum across buckets. No task sees a whole group. Without buckets (small inputs) it
    is one window per group.
    """
    if bucket is None:
        plain = Window.partitionBy(*[c(k) for k in by]).orderBy(*[c(o) for o in order])
        plain = plain.rowsBetween(Window.unboundedPreceding, -1)
        whole = Window.partitionBy(*[c(k) for k in by])
        return df.select(
            "*",
            *[F.coalesce(F.sum(c(s)).over(plain), F.lit(0)).alias(f"{s}_before") for s in sums],
            *[F.sum(c(s)).over(whole).alias(f"{s}_total") for s in sums],
        )
    stem = free_name([*df.columns, *by], "_")
    at = f"{stem}bucket"
    bucketed = df.withColumn(at, bucket)
    keys = [*by, at]
    totals = bucketed.groupBy(*[c(k) for k in keys]).agg(*[F.sum(c(s)).alias(f"{stem}t{i}") for i, s in enumerate(sums)])
    earlier = Window.partitionBy(*[c(k) for k in by]).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*[c(k) for k in by])
    carried = totals.select(
        *[c(k) for k in keys],
        *[F.coalesce(F.sum(f"{stem}t{i}").over(earlier), F.lit(0)).alias(f"{stem}c{i}") for i in range(len(sums))],
        *[F.sum(f"{stem}t{i}").over(whole).alias(f"{s}_total") for i, s in enumerate(sums)],
    )
    inside = Window.partitionBy(*[c(k) for k in keys]).orderBy(*[c(o) for o in order])
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    local = bucketed.select(
        "*", *[F.coalesce(F.sum(c(s)).over(inside), F.lit(0)).alias(f"{stem}l{i}") for i, s in enumerate(sums)]
    )
    joined = local.join(carried, keys, "inner")
    return joined.select(
        *[c(n) for n in df.columns],
        *[(F.col(f"{stem}l{i}") + F.col(f"{stem}c{i}")).alias(f"{s}_before") for i, s in enumerate(sums)],
        *[F.col(f"{s}_total") for s in sums],
    )


def duplicate_count(df: DataFrame, columns: Sequence[str] | None = None, suspect_limit: int = SUSPECT_LIMIT) -> tuple[int, int]:
    """(rows, surplus copies of rows); NULL equals NULL.

    Rows are first counted by a 64-bit hash: 8 bytes per row cross the shuffle instead
    of the row, and rows with a hash of their own are settled. Rows that share a hash
    are then compared in full, so a collision cannot change the count.
    """
    names = list(columns or df.columns)
    if not names:
        return df.count(), 0
    cols = [comparable(df, n).alias(f"v{i}") for i, n in enumerate(names)]
    keyed = df.select(F.xxhash64(*[comparable(df, n) for n in names]).alias("h"), *cols)
    counts = keyed.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    seen = counts.agg(
        F.sum("n").alias("rows"),
        F.count(F.lit(1)).alias("hashes"),
        F.count_if(F.col("n") > 1).alias("shared"),
    ).first()
    rows = int(seen["rows"] or 0)
    if not seen["shared"]:
        return rows, 0
    suspects = keyed
    settled = 0
    if seen["shared"] <= suspect_limit:
        shared = counts.filter(F.col("n") > 1).select("h")
        suspects = keyed.join(F.broadcast(shared), "h", "left_semi")
        settled = seen["hashes"] - seen["shared"]
    distinct = suspects.groupBy("h", *[f"v{i}" for i in range(len(names))]).agg(F.count(F.lit(1)).alias("n"))
    return rows, rows - settled - distinct.count()
