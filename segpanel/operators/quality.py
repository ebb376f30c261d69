"""Data quality as tables: rule counts, coverage, reconciliation, key checks, signal status.

Each check is one aggregation over its input, so a table is scanned once however many rules
apply. Results are rows, and a caller decides what a failing row means.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segpanel.functions import expr as E
from segpanel.functions.expr import UNKNOWN, pct
from segpanel.operators.aggregate import sum_or_zero
from segpanel.roles import Box

TOLERANCE = 1e-6
SEVERITIES = ("low", "medium", "high", "critical")
GRAINS = ("area", "grid")


def long_counts(wide: DataFrame, names: Sequence[str], label: str, value: str) -> DataFrame:
    """One-row wide counts to (label, value) rows."""
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias(label), F.col(n).cast("bigint").alias(value)) for n in names
    ])))


def rule_table(df: DataFrame, rules: Mapping[str, Column], label: str = "rule_name") -> DataFrame:
    """(rule, issues, pct) for named conditions; a rule value may also be an aggregate count."""
    wide = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count_if(c).alias(n) for n, c in rules.items()])
    longer = wide.select("__rows", F.inline(F.array(*[
        F.struct(F.lit(n).alias(label), F.col(n).alias("issue_count")) for n in rules
    ])))
    return longer.select(label, "issue_count",
                         pct(F.col("issue_count"), F.col("__rows"), 4).alias("issue_pct"))


def rule_table_with_surplus(df: DataFrame, rules: Mapping[str, Column], key: str, surplus: str,
                            label: str = "rule_name") -> DataFrame:
    """``rule_table`` and the rows beyond the first of every key, in one pass: counts per key, then their sums."""
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(c).alias(n) for n, c in rules.items()])
    extra = F.when(F.col(key).isNotNull(), F.col("__n") - 1).otherwise(0)
    wide = per_key.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("__rows"), F.coalesce(F.sum(extra), F.lit(0)).alias(surplus),
                       *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in rules])
    longer = wide.select("__rows", F.inline(F.array(*[
        F.struct(F.lit(n).alias(label), F.col(n).alias("issue_count")) for n in [*rules, surplus]])))
    return longer.select(label, "issue_count", pct(F.col("issue_count"), F.col("__rows"), 4).alias("issue_pct"))


def flag_counts(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    return rule_table(df, {f: F.col(f) for f in flags}, "quality_flag")


def flag_overlap(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """How flags combine on rows."""
    hits = reduce(lambda a, b: a + b, [F.coalesce(F.col(f), F.lit(False)).cast("int") for f in flags])
    any_null = reduce(lambda a, b: a | b, [F.col(f).isNull() for f in flags])
    return df.select(hits.alias("h"), any_null.alias("u")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("h").alias("flag_total"),
        F.count_if(F.col("h") >= 1).alias("rows_with_flag"),
        F.count_if(F.col("h") > 1).alias("rows_with_overlap"),
        F.max("h").cast("bigint").alias("max_flags_per_row"),
        F.count_if(F.col("u")).alias("rows_with_null_flag"),
    )


def date_coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    wide = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("date_column"), F.col(f"min_{c}").alias("min_date"),
                 F.col(f"max_{c}").alias("max_date")) for c in columns
    ])))


def overall_counts(df: DataFrame, identity: str, eligible: str) -> DataFrame:
    """Rows, eligible rows and exact distinct ids. Ids are grouped first, so a repeated id is
    one row per task when it is shuffled."""
    ids = df.groupBy(identity).agg(
        F.count(F.lit(1)).alias("k"), F.count_if(F.col(eligible)).alias("e")
    )
    return ids.agg(
        F.coalesce(F.sum("k"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("e"), F.lit(0)).alias("eligible_rows"),
        F.count(identity).alias("distinct_ids"),
    )


def check_weekly(weekly: DataFrame, week: str = "week", value: str = "n") -> DataFrame:
    return weekly.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(week).isNull()).alias("null_weeks"),
        F.count_if(F.col(value).isNull()).alias("null_values"),
        F.count_if(F.col(value) < 0).alias("negative_values"),
    )


def check_eligibility(df: DataFrame, time: str, flag: str) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(flag).isNull()).alias("null_flags"),
        F.count_if(F.col(flag)).alias("eligible_rows"),
        F.count_if(F.col(flag) & F.col(time).isNull()).alias("eligible_without_date"),
    )


def check_bins(bins: DataFrame, time: str, keys: Sequence[str], flags: Sequence[str],
               weight: str = "weight") -> DataFrame:
    any_null = lambda cs: reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cs])
    return bins.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(time).isNull()).alias("null_dates"),
        F.count_if(any_null(keys)).alias("null_keys"),
        F.count_if(any_null(flags)).alias("null_flags"),
        F.count_if(F.coalesce(F.col(weight) <= 0, F.lit(True))).alias("bad_weights"),
    )


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)) == "", F.lit(True))


def _any(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def check_weekly_keys(weekly: DataFrame, keys: Sequence[str], week: str = "week") -> DataFrame:
    """Blank labels, weeks that are no Monday, duplicate keys, segments."""
    grouped = weekly.groupBy(week, *keys).agg(F.count(F.lit(1)).alias("k"))
    bad_week = F.coalesce(~E.is_monday(week), F.lit(True))
    segments = weekly.select(*keys).distinct().agg(F.count(F.lit(1)).alias("s")).scalar()
    return grouped.agg(
        F.coalesce(F.sum("k"), F.lit(0)).alias("rows"),
        sum_or_zero(_any([_blank(k) for k in keys]), "k").alias("blank_key_rows"),
        sum_or_zero(bad_week, "k").alias("bad_week_rows"),
        F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("duplicate_rows"),
    ).withColumn("segments", segments)


def anomaly_rules(keys: Sequence[str]) -> dict[str, Column]:
    """Row rules every published anomaly must satisfy."""
    expected, residual, actual = F.col("expected"), F.col("residual"), F.col("actual")

    def bad_optional(c: str) -> Column:
        return F.col(c).isNotNull() & (~E.finite(c) | (F.col(c) < 0))

    def mismatch(source: str, c: str) -> Column:
        off = F.col(c).isNull() | ~E.finite(c) | (F.abs(expected - F.col(c)) > TOLERANCE)
        return (F.col("expected_source") == source) & off

    true = lambda c: F.coalesce(F.col(c), F.lit(False))
    return {
        "bad_week": F.col("week").isNull() | ~E.is_monday("week"),
        "blank_key": _any([_blank(k) for k in keys]),
        "bad_actual": actual.isNull() | (actual < 0),
        "bad_expected": ~E.finite(expected) | (expected < 0)
        | bad_optional("expected_history") | bad_optional("expected_model"),
        "bad_residual": ~E.finite(residual),
        "bad_score": ~E.finite("score") | (F.col("score") < 0),
        "bad_source": ~F.coalesce(F.col("expected_source").isin("model", "trailing_mean"), F.lit(False)),
        "bad_severity": ~F.coalesce(F.col("severity").isin(list(SEVERITIES)), F.lit(False)),
        "flag_not_true": ~(true("is_anomaly") & true("passes_volume")),
        "residual_arithmetic": F.abs(actual.cast("double") - expected - residual) > TOLERANCE,
        "published_residual_not_positive": F.col("severity").isin("high", "critical") & (residual <= 0),
        "history_source_mismatch": mismatch("trailing_mean", "expected_history"),
        "model_source_mismatch": mismatch("model", "expected_model"),
    }


def check_anomalies(anomalies: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rule rows plus one row for surplus logical keys."""
    rules = rule_table(anomalies, anomaly_rules(keys)).select("rule_name", "issue_count")
    return rules.unionByName(_surplus(anomalies, ["week", *keys], "duplicate_key"))


def _surplus(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    grouped = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("k"))
    return grouped.agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).cast("bigint").alias("issue_count")).select(
        F.lit(name).alias("rule_name"), "issue_count"
    )


def hotspot_rules(box: Box) -> dict[str, Column]:
    grid = F.col("grain") == "grid"
    has_cell = F.col("cell_x").isNotNull() | F.col("cell_y").isNotNull()
    off_centre = (F.abs(F.col("map_x") - F.col("cell_x")) > 1e-7) | (F.abs(F.col("map_y") - F.col("cell_y")) > 1e-7)
    return {
        "not_flagged": ~F.coalesce(F.col("is_hotspot"), F.lit(False)),
        "bad_grain": ~F.coalesce(F.col("grain").isin(list(GRAINS)), F.lit(False)),
        "bad_severity": ~F.coalesce(F.col("severity").isin(list(SEVERITIES)), F.lit(False)),
        "blank_key": _any([_blank(k) for k in ("grp", "cat", "cls")]),
        "bad_rank": F.coalesce(F.col("rank_overall") < 1, F.lit(True)),
        "grid_with_area": grid & F.col("area").isNotNull(),
        "grid_off_centre": grid & F.coalesce(off_centre, F.lit(True)),
        "area_without_area": ~grid & F.col("area").isNull(),
        "area_with_cell": ~grid & has_cell,
        "map_point_outside": ~E.inside_box("map_x", "map_y", box),
    }


def check_hotspots(hotspots: DataFrame, box: Box, last_day: Column) -> DataFrame:
    """Row rules plus snapshot rules: one date, one window pair, unique ranks and keys,
    one group per area."""
    rows = rule_table(hotspots, hotspot_rules(box)).select("rule_name", "issue_count")
    snapshot = hotspots.agg(
        (F.countDistinct("snapshot_day") - 1).alias("extra_snapshot_days"),
        F.count_if(F.col("snapshot_day").isNull()).alias("null_snapshot_days"),
        F.count_if(F.col("snapshot_day") > last_day).alias("future_snapshot_rows"),
        (F.countDistinct("recent_days") - 1).alias("extra_recent_windows"),
        (F.countDistinct("baseline_days") - 1).alias("extra_baseline_windows"),
    )
    names = snapshot.columns
    floor = snapshot.select(*[F.greatest(F.col(n), F.lit(0)).alias(n) for n in names])
    snapshot_rows = long_counts(floor, names, "rule_name", "issue_count")
    areas = hotspots.filter(F.col("grain") == "area").select("area", "grp").distinct()
    split = areas.groupBy("area").agg(F.count(F.lit(1)).alias("k")).agg(
        F.count_if(F.col("k") > 1).alias("issue_count")
    ).select(F.lit("area_in_two_groups").alias("rule_name"), "issue_count")
    parts = [
        snapshot_rows, split,
        _surplus(hotspots, ["rank_overall"], "duplicate_rank"),
        _surplus(hotspots, ["grain", "grp", "area", "cell_x", "cell_y", "cat", "cls"], "duplicate_key"),
    ]
    return reduce(DataFrame.unionByName, parts, rows)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def duplicate_distribution(df: DataFrame, identity: str) -> DataFrame:
    """Multiplicity histogram with the surplus rows each multiplicity causes."""
    copies = df.filter(F.col(identity).isNotNull()).groupBy(identity).agg(F.count(F.lit(1)).alias("copies"))
    return copies.groupBy("copies").agg(
        F.count(F.lit(1)).alias("ids"),
        F.sum(F.col("copies") - 1).alias("surplus_rows"),
    )


def code_consistency(df: DataFrame, code: str, description: str, separator: str = " | ") -> DataFrame:
    """Codes with more than one description, descriptions joined in order.

    Pairs are made distinct first, so a list holds a code's spellings, not its rows.
    """
    pairs = df.filter(F.col(code).isNotNull() & F.col(description).isNotNull()).groupBy(code, description).agg(
        F.count(F.lit(1)).alias("k")
    )
    return pairs.groupBy(code).agg(
        F.count(F.lit(1)).alias("descriptions"),
        F.sum("k").alias("rows"),
        F.concat_ws(separator, F.array_sort(F.collect_list(description))).alias("description_list"),
    ).filter(F.col("descriptions") > 1)


def allowed_value_audit(df: DataFrame, allowed: Mapping[str, Sequence[str]]) -> DataFrame:
    """Per column: rows checked, missing, outside the allowed list."""
    stats = []
    for i, (c, values) in enumerate(allowed.items()):
        known = F.coalesce(F.col(c).isin(list(values)), F.lit(False))
        stats += [F.count(c).alias(f"c{i}"), F.count_if(F.col(c).isNull()).alias(f"m{i}"),
                  F.count_if(F.col(c).isNotNull() & ~known).alias(f"u{i}")]
    wide = df.agg(*stats)
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("checked"),
                 F.col(f"m{i}").alias("missing"), F.col(f"u{i}").alias("unexpected"))
        for i, c in enumerate(allowed)
    ])))


def time_quality(df: DataFrame, text: str) -> DataFrame:
    ok = E.valid_time(text)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(text).isNull()).alias("missing"),
        F.count_if(ok).alias("valid"),
        F.count_if(~ok).alias("invalid"),
        F.min(F.when(ok, F.col(text))).alias("first_time"),
        F.max(F.when(ok, F.col(text))).alias("last_time"),
    )


def xy_quality(df: DataFrame, box: Box, x: str = "x", y: str = "y") -> DataFrame:
    kind = E.classify_xy(x, y, box)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(kind == k).alias(k) for k in ("missing", "zero", "outside", "valid")],
        F.min(F.when(kind == "valid", F.col(x))).alias("x_min"),
        F.max(F.when(kind == "valid", F.col(x))).alias("x_max"),
        F.min(F.when(kind == "valid", F.col(y))).alias("y_min"),
        F.max(F.when(kind == "valid", F.col(y))).alias("y_max"),
    )


def issue_by_group(df: DataFrame, issue: Column, group: str) -> DataFrame:
    return df.groupBy(issue.alias("issue"), E.fill_unknown(group).alias(group)).agg(
        F.count(F.lit(1)).alias("rows")
    )


def weighted_xy_quality(bins: DataFrame, box: Box, weight: str = "weight") -> DataFrame:
    kind = E.classify_xy("x", "y", box)
    out = bins.agg(
        F.coalesce(F.sum(weight), F.lit(0)).cast("bigint").alias("events"),
        *[sum_or_zero(kind == k, weight).alias(f"{k}_events") for k in ("valid", "missing", "zero", "outside")],
    )
    return out.withColumn("coverage_pct", pct(F.col("valid_events"), F.col("events"), 4))


def reconcile_totals(events: DataFrame, weekly: DataFrame, keys: Sequence[str],
                     eligible: Column, value: str = "n") -> DataFrame:
    """Eligible events against weekly volume, overall and for unknown labels."""
    left = events.filter(eligible).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col(k).isNull()).alias(f"unknown_{k}") for k in keys],
    )
    right = weekly.agg(
        F.coalesce(F.sum(value), F.lit(0)).cast("bigint").alias("total"),
        *[sum_or_zero(F.col(k) == UNKNOWN, value).alias(f"unknown_{k}") for k in keys],
    )
    names = ["total", *[f"unknown_{k}" for k in keys]]
    a = long_counts(left, names, "measure", "from_events")
    b = long_counts(right, names, "measure", "from_weekly")
    return a.join(b, "measure").withColumn("matches", F.col("from_events") == F.col("from_weekly"))


def key_set_diff(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys on one side only."""
    want, have = expected.select(*keys).distinct(), actual.select(*keys).distinct()
    missing = want.join(have, list(keys), "left_anti")
    surplus = have.join(want, list(keys), "left_anti")
    return missing.withColumn("status", F.lit("missing")).unionByName(
        surplus.withColumn("status", F.lit("unexpected"))
    )


def compare_values(published: DataFrame, derived: DataFrame, keys: Sequence[str], left: str, right: str,
                   tolerance: float = TOLERANCE) -> DataFrame:
    """Full comparison of two keyed value columns as counts."""
    a = published.select(*keys, F.col(left).alias("a"), F.lit(True).alias("in_a"))
    b = derived.select(*keys, F.col(right).alias("b"), F.lit(True).alias("in_b"))
    both = a.join(b, list(keys), "full_outer")
    in_a, in_b = F.col("in_a").isNotNull(), F.col("in_b").isNotNull()
    differs = (F.col("a").isNull() != F.col("b").isNull()) | (F.abs(F.col("a") - F.col("b")) > tolerance)
    return both.agg(
        F.count_if(in_a & in_b).alias("matched_keys"),
        F.count_if(in_a & ~in_b).alias("only_published"),
        F.count_if(~in_a & in_b).alias("only_derived"),
        F.count_if(in_a & in_b & F.coalesce(differs, F.lit(False))).alias("value_mismatches"),
    )


def freshness(snapshot: Column, horizon: Column, max_age_days: int = 1) -> list[Column]:
    """Age in days and the verdict for a snapshot date against the data horizon."""
    age = F.datediff(horizon, snapshot)
    verdict = (
        F.when(snapshot.isNull() | horizon.isNull(), "invalid")
        .when(age < 0, "incompatible")
        .when(age > max_age_days, "stale")
        .otherwise("current")
    )
    return [age.cast("bigint").alias("age_days"), verdict.alias("freshness")]


def grid_alignment(df: DataFrame, size: float, x: str = "cell_x", y: str = "cell_y") -> DataFrame:
    ok = E.grid_aligned(x, size) & E.grid_aligned(y, size)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(ok).alias("aligned_rows"),
                  F.coalesce(F.bool_and(ok), F.lit(True)).alias("all_aligned"))


def signal_status(facts: DataFrame, rules: Sequence[tuple[Column, str, str]], empty: Column) -> DataFrame:
    """Status of one published signal from a one-row table of facts.

    Rules are (failing condition, status, reason); the first that fails wins, and a condition
    that cannot be decided counts as failing. Without a failure the signal is empty or available.
    """
    status, reason = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for condition, verdict, text in rules:
        failing = F.coalesce(condition, F.lit(True))
        status, reason = status.when(failing, verdict), reason.when(failing, text)
    return facts.select(
        "*", status.when(empty, "empty").otherwise("available").alias("status"), reason.alias("reason")
    )


SEVERITY_NAMES = ("low", "medium", "high", "critical")


def _one(df: DataFrame) -> Column:
    return df.select(F.struct("*")).scalar()


def _by_severity(rows: DataFrame, amount: Column) -> DataFrame:
    """Total and per severity sums of ``amount`` as one row."""
    def total(column: Column) -> Column:
        return F.coalesce(F.sum(column), F.lit(0)).cast("bigint")
    return rows.agg(total(amount).alias("rows"), *[total(F.when(F.col("severity") == s, amount)).alias(s) for s in SEVERITY_NAMES])


def _severities_differ() -> Column:
    out = F.lit(False)
    for s in SEVERITY_NAMES:
        out = out | (F.col(f"s.{s}") != F.col(f"m.{s}"))
    return out


def anomaly_status(flagged: DataFrame, metrics: DataFrame, weekly: DataFrame, scoring_end: Column, week: str = "week") -> DataFrame:
    """status, reason, rows of an anomaly table against its metrics (severity, rows), which are a table of their own,
    the weekly table's horizon and the week up to which it was scored. The last observed week counts as partial."""
    h = weekly.agg(F.min(week).alias("first_week"), F.date_sub(F.max(week), 7).alias("complete"))
    d = flagged.agg(F.min(week).alias("lo"), F.max(week).alias("hi"))
    facts = _by_severity(flagged, F.lit(1)).select(F.struct("*").alias("s")).withColumns(
        {"m": _one(_by_severity(metrics, F.col("rows"))), "d": _one(d), "h": _one(h), "e": scoring_end})
    col = F.col
    rules = [
        (col("s.rows") != col("m.rows"), "invalid", "row_count_off"),
        (_severities_differ(), "invalid", "severity_off"),
        (F.weekday("e") != 0, "invalid", "scoring_no_monday"),
        (F.coalesce(col("d.lo") < col("h.first_week"), F.lit(False)), "invalid", "before_horizon"),
        (F.coalesce(col("d.hi") > col("e"), F.lit(False)), "invalid", "after_scoring"),
        (col("e") < col("h.complete"), "stale", "scored_too_early"),
        (col("e") > col("h.complete"), "incompatible", "scored_too_late"),
    ]
    return signal_status(facts, rules, col("s.rows") == 0).select("status", "reason", col("s.rows").alias("rows"))


def hotspot_status(flagged: DataFrame, last_day: Column, metrics: DataFrame | None = None, max_age_days: int = 1) -> DataFrame:
    """status, reason, rows and metrics_match of a hotspot table against the last observed day.

    Only the snapshot's day decides. Published metrics (severity, rows) are optional: whether they agree with the table is told
    (null without them) and never withholds its rows.
    """
    d = flagged.agg(F.min("snapshot_day").alias("lo"), F.max("snapshot_day").alias("hi"))
    facts = _by_severity(flagged, F.lit(1)).select(F.struct("*").alias("s")).withColumns({"d": _one(d), "last": last_day})
    match = F.lit(None).cast("boolean")
    if metrics is not None:
        facts = facts.withColumn("m", _one(_by_severity(metrics, F.col("rows"))))
        match = (F.col("s.rows") == F.col("m.rows")) & ~_severities_differ()
    some, age = F.col("s.rows") > 0, F.datediff("last", "d.hi")
    rules = [
        (some & (F.col("d.lo") != F.col("d.hi")), "invalid", "several_snapshots"),
        (some & F.coalesce(age > max_age_days, F.lit(True)), "stale", "snapshot_old"),
        (some & F.coalesce(age < 0, F.lit(True)), "incompatible", "snapshot_ahead"),
    ]
    return signal_status(facts.withColumn("metrics_match", match), rules, ~some).select("status", "reason", F.col("s.rows").alias("rows"), "metrics_match")


def forecast_status(rows: DataFrame, weekly: DataFrame, keys: Sequence[str], week: str = "week") -> DataFrame:
    """status, reason, rows of a next-week forecast against the segments and the horizon of the weekly table."""
    one = rows.agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct(week).alias("weeks"), F.countDistinct("model").alias("models"),
        F.min(week).alias("week"), F.count_if(F.col("predicted").isNull()).alias("no_value"),
        F.countDistinct(F.struct(*keys)).alias("segments"))
    facts = one.withColumns({"last_week": weekly.agg(F.max(week)).scalar(),
                             "expected": weekly.select(*keys).distinct().agg(F.count(F.lit(1))).scalar()})
    rules = [
        (F.col("weeks") != 1, "invalid", "not_one_week"),
        (F.col("models") != 1, "invalid", "not_one_model"),
        (F.col("no_value") > 0, "invalid", "no_prediction"),
        (F.col("rows") != F.col("segments"), "invalid", "keys_repeat"),
        (F.col("segments") != F.col("expected"), "invalid", "segments_off"),
        (F.datediff("week", "last_week") < 7, "stale", "week_not_ahead"),
        (F.datediff("week", "last_week") > 7, "incompatible", "week_too_far"),
    ]
    return signal_status(facts, rules, F.col("rows") == 0).select("status", "reason", "rows")


def forecast_reconcile(published: DataFrame, source: DataFrame, summary: DataFrame) -> DataFrame:
    """Recompute what a published forecast claims: change arithmetic, counts and totals."""
    base, pred = F.col("baseline"), F.col("predicted")
    wrong_change = F.when(base.isNull(), F.col("change").isNotNull()).otherwise(
        F.coalesce(F.abs(pred - base - F.col("change")) > TOLERANCE, F.lit(True))
    )
    wrong_pct = F.when(F.coalesce(base > 0, F.lit(False)), F.coalesce(
        F.abs(F.col("change") * 100.0 / base - F.col("change_pct")) > 1e-4, F.lit(True)
    )).otherwise(F.col("change_pct").isNotNull())
    p = published.agg(
        F.count(F.lit(1)).alias("published_rows"),
        F.coalesce(F.sum(pred), F.lit(0.0)).alias("published_total"),
        F.count_if(wrong_change).alias("wrong_change_rows"),
        F.count_if(wrong_pct).alias("wrong_pct_rows"),
        F.count_if(~E.finite(pred) | (pred < 0)).alias("bad_prediction_rows"),
    )
    s = source.agg(F.count(F.lit(1)).alias("source_rows"), F.sum("predicted").alias("source_total"))
    one = summary.select(F.struct("*")).scalar()
    joined = p.withColumn("s", s.select(F.struct("*")).scalar()).withColumn("m", one)
    return joined.select(
        "published_rows", F.col("s.source_rows").alias("source_rows"),
        "wrong_change_rows", "wrong_pct_rows", "bad_prediction_rows",
        (F.col("m.source_rows") - F.col("m.published_rows") == F.col("m.withheld_rows")).alias("withheld_adds_up"),
        (F.col("m.withheld_unmappable") + F.col("m.withheld_mismatch") == F.col("m.withheld_rows")).alias("reasons_add_up"),
        (F.abs(F.col("m.predicted_total") - F.col("published_total")) <= 1e-4).alias("total_matches"),
        (F.abs(F.col("m.source_total") - F.col("s.source_total")) <= 1e-4).alias("source_total_matches"),
        (F.abs(pct(F.col("published_rows"), F.col("s.source_rows"), 4) - F.col("m.row_coverage_pct")) <= 1e-4)
        .alias("coverage_matches"),
    )


