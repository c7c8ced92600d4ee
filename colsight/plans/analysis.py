"""Jobs made of operators: driver analysis, step lists and report recipes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from colsight.functions.exprs import nan_to_null
from colsight.operators import cleaning, drivers, model, stats, tables, targets
from colsight.operators import profile as P
from colsight.session import materialize

STEP_SCHEMA = "step_id string, operation string, status string, summary string, metrics map<string,string>"


@dataclass
class DriverAnalysis:
    target: str
    target_type: str
    results: DataFrame
    ranking: DataFrame
    answer: DataFrame
    hypotheses: DataFrame
    data_quality_flags: list[str] = field(default_factory=list)


# Fixed text: flag of an analysis without model importance.
FOREST_FLAG = "Model importance is missing: the forest could not be fitted ({})."


def driver_analysis(
    df: DataFrame,
    target: str,
    target_type: str | None = None,
    profile: DataFrame | Sequence[Row] | None = None,
    importance: bool = True,
    trees: int = model.TREES,
    limits: targets.Limits = targets.NO_LIMITS,
) -> DriverAnalysis:
    """Which columns move a target: hypotheses, tests, importance, ranking, answer, flags.

    All columns are tested unless ``limits`` are given. If no forest can be fitted, importance
    is missing and a flag says so.
    """
    df = nan_to_null(df)
    if target not in df.columns:
        raise ValueError(f"Target column '{target}' is not present in dataframe.")
    rows = P.collect_profile(df, profile)
    small = P.profile_frame(df.sparkSession, rows)
    if target_type is None:
        types = targets.target_types(small).filter(F.col("column") == target).first()
        target_type = types["target_type"] if types else "classification"
    table = rows[0]["table_name"]
    wanted = df.sparkSession.createDataFrame([(table, target, target_type)], "table_name string, target string, target_type string")
    hypotheses = targets.hypotheses(small, wanted, limits)
    features = [r["feature"] for r in hypotheses.orderBy("ordinal").collect()]
    found = stats.run_tests(df, target, features, target_type)
    tests = df.sparkSession.createDataFrame(found.collect(), found.schema)
    flags = stats.quality_flags(df, target)
    weights = None
    if importance:
        tested = [r["feature"] for r in tests.orderBy("ordinal").collect()]
        try:
            weights = model.feature_importance(df, tested, target, target_type, trees=trees)
        except (RuntimeError, PySparkException) as exc:  # the tests stand without the forest
            flags.append(FOREST_FLAG.format(str(exc).splitlines()[0][:200]))
    kept = stats.result_bundle(df, target, features, target_type, weights, tests)
    ranking = drivers.rank_drivers(kept)
    return DriverAnalysis(target, target_type, kept, ranking, drivers.answers(ranking, wanted), hypotheses, flags)


@dataclass
class StepRun:
    results: DataFrame
    frames: dict[str, DataFrame]
    table: DataFrame
    log: list[tuple] = field(default_factory=list)


def _points(df: DataFrame, key: str, val: str) -> dict[str, str]:
    return {str(r[key]): str(r[val]) for r in df.collect()}


def _summary_step(df, params, state):
    frame = tables.summary(df)
    return frame, "Generated dataframe summary statistics.", {"rows": str(df.count()), "columns": str(len(df.columns))}, df


def _groupby_step(df, params, state):
    agg = params.get("agg", "mean")
    frame = tables.group_top(df, params.get("group_by"), params.get("target_column"), agg, order_column=params.get("order_column"))
    text = f"Computed {agg} by {params['group_by']} for {params['target_column']}."
    return frame, text, _points(frame, "group", "value"), df


def _correlation_step(df, params, state):
    found = tables.correlation_pairs(df)
    pairs = df.sparkSession.createDataFrame(found.collect(), found.schema)
    frame = tables.correlation_matrix(df, pairs=pairs)
    best = tables.strongest_correlation(df, pairs=pairs).first()
    metrics = {} if best is None else {
        "strongest_pair": f"{best['column_a']}, {best['column_b']}", "strongest_value": str(best["r"]),
    }
    return frame, "Computed correlation matrix for numeric columns.", metrics, df


def _trend_step(df, params, state):
    when, target = params.get("datetime_column"), params.get("target_column")
    frame = tables.trend_points(df, when, target)
    numeric = target in df.columns and P.kind_of(df.schema[target].dataType) == "number"
    text = f"Monthly mean trend for {target}" if numeric else "Monthly row-count trend"
    return frame, text, _points(frame, "month_end", "value"), df


def _train_step(df, params, state):
    trained = model.train_model(
        df, params.get("target_column"), params.get("exclude", ()), params.get("split_key"), params.get("split_column")
    )
    state["model"] = trained
    text = f"Trained baseline {trained.task_type} model on target '{trained.target}'."
    return trained.predictions, text, trained.metrics(), df


def _evaluate_step(df, params, state):
    trained = state.get("model")
    frame = model.evaluate(trained)
    row = frame.first().asDict()
    return frame, f"Evaluated {trained.task_type} model performance.", {k: str(v) for k, v in row.items()}, df


def _clean_step(df, params, state):
    operations = params.get("operations", cleaning.DEFAULT_OPERATIONS)
    cleaned, removed = cleaning.clean_counted(df, operations)
    cleaned = materialize(cleaned)
    frame = cleaning.clean_metrics(df, cleaned, removed)
    row = {k: str(v) for k, v in frame.first().asDict().items() if v is not None}
    return frame, "Applied deterministic data cleaning operations.", row, cleaned


STEPS = {
    "SUMMARY": _summary_step,
    "GROUPBY": _groupby_step,
    "CORRELATION": _correlation_step,
    "TREND": _trend_step,
    "TRAIN_MODEL": _train_step,
    "EVALUATE_MODEL": _evaluate_step,
    "CLEAN_DATA": _clean_step,
}


def run_steps(df: DataFrame, steps: Sequence[dict]) -> StepRun:
    """Run steps in order. A failing step is recorded and the run goes on; a cleaning
    step replaces the table for the later ones; evaluation uses the last trained model.

    Each step dict has step_id, operation and optional parameters. ``frames`` holds the
    result DataFrame of every step that succeeded.
    """
    current = nan_to_null(df)
    state: dict[str, object] = {}
    frames: dict[str, DataFrame] = {}
    log = []
    for step in steps:
        sid, op = step["step_id"], step["operation"]
        try:
            if op not in STEPS:
                raise ValueError(f"Unknown operation_type: {op}")
            frame, text, metrics, current = STEPS[op](current, step.get("parameters", {}), state)
            frames[sid] = frame
            log.append((sid, op, "SUCCESS", text, metrics))
        except Exception as exc:  # noqa: BLE001 - a step may fail in any way, the run continues
            log.append((sid, op, "FAILED", f"{op} failed: {exc}", None))
    results = df.sparkSession.createDataFrame(log, STEP_SCHEMA)
    return StepRun(results, frames, current, log)


def recipe(kind: str, profile: Sequence[Row] | None, target: str | None = None) -> list[dict]:
    """Step list of a report kind, filled in from the profile; without one, a summary."""
    if profile is None:
        return [_step(1, "SUMMARY")]
    numbers = P.columns_with_role(profile, P.METRIC)
    categories = P.columns_with_role(profile, P.CATEGORY, P.BOOLEAN)
    dates = P.columns_with_role(profile, P.DATETIME)
    compare = []
    if categories and numbers:
        compare = [_step(2, "GROUPBY", group_by=categories[0], target_column=numbers[0], agg="mean")]
    if kind == "DESCRIPTIVE":
        steps = [_step(1, "SUMMARY"), *compare]
        if dates:
            steps.append(_step(3, "TREND", datetime_column=dates[0], target_column=numbers[0] if numbers else None))
        return steps
    if kind == "DIAGNOSTIC":
        return [_step(1, "SUMMARY"), *compare, _step(3, "CORRELATION")]
    if kind == "PREDICTIVE":
        chosen = target or (numbers[-1] if numbers else categories[-1] if categories else None)
        skip = P.columns_with_role(profile, P.IDENTIFIER)
        return [
            _step(1, "TRAIN_MODEL", target_column=chosen, exclude=[n for n in skip if n != chosen]),
            _step(2, "EVALUATE_MODEL"),
        ]
    if kind == "DATA_CLEANING":
        return [_step(1, "CLEAN_DATA", operations=list(cleaning.DEFAULT_OPERATIONS)), _step(2, "SUMMARY")]
    raise ValueError(f"Unknown report kind: {kind}")


def _step(number: int, operation: str, **parameters) -> dict:
    return {"step_id": f"step_{number}", "operation": operation, "parameters": parameters}


def report(df: DataFrame, kind: str, target: str | None = None, profile: DataFrame | Sequence[Row] | None = None) -> StepRun | DriverAnalysis:
    """Run a report kind. EXPLANATORY is a driver analysis of its target."""
    rows = P.collect_profile(nan_to_null(df), profile)
    if kind == "EXPLANATORY":
        if target is None:
            raise ValueError("An explanatory report needs a target.")
        return driver_analysis(df, target, profile=rows)
    return run_steps(df, recipe(kind, rows, target))


def report_with_drivers(df: DataFrame, steps: Sequence[dict], target: str, **options) -> tuple[StepRun, DriverAnalysis]:
    """Run steps, then the driver analysis on the table they leave behind."""
    run = run_steps(df, steps)
    return run, driver_analysis(run.table, target, **options)
