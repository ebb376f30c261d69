"""Panels, baselines, the lag ensemble, evaluation, and the joins they are made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries import tables as t
from queries.registry import query
from segpanel.functions.expr import dround, sround
from segpanel.functions.windows import PriorRows, array_mad, array_median
from segpanel.operators import evaluate as ev
from segpanel.operators import forecast as fc
from segpanel.operators import quality as q
from segpanel.operators.aggregate import segment_profile
from segpanel.operators.panel import dense_panel, join_observed, panel_dates
from segpanel.session import materialize


def panel(spark, sf, keys=t.KEYS):
    """Weekly table (written once: it feeds bounds and panel), its dates, and the panel."""
    weekly = materialize(t.weekly(spark, sf, keys))
    dates = panel_dates(weekly)
    return weekly, dates, dense_panel(weekly, keys, dates.forecast, dates.last)


def baselines(spark, sf, keys=t.KEYS):
    _, dates, dense = panel(spark, sf, keys)
    return fc.baseline_forecasts(dense, keys, dates)


def features(spark, sf, keys=t.KEYS):
    _, dates, dense = panel(spark, sf, keys)
    return dates, fc.ml_features(dense, keys, dates)


def fitted(spark, sf, keys=t.KEYS):
    """Features of the weeks that fit and prediction use, and the grid result."""
    dates, rows = features(spark, sf, keys)
    used = materialize(rows.filter(F.col("week") >= F.lit(dates.validation_start)))
    return used, fc.fit_grid(used, dates.validation_start, dates.validation_end)


def predictions(spark, sf, keys=t.KEYS):
    used, grid = fitted(spark, sf, keys)
    return fc.predict(used, fc.fit_best(grid), keys)


_SEG = "first_week, last_week, observed_weeks, total"
_K4 = "grp, area, cat, cls"


@query("dense_panel", f"SELECT week, {_K4}, n, {_SEG} FROM panel4")
def dense(spark, sf):
    return panel(spark, sf)[2]


@query("join_panel_left", f"SELECT week, {_K4}, coalesce(n, 0) AS n FROM panel4")
def join_panel_left(spark, sf):
    weekly, dates, _ = panel(spark, sf)
    weeks = F.sequence(F.col("first_week"), F.lit(dates.forecast), F.expr("INTERVAL 7 DAYS"))
    grid = segment_profile(weekly, t.KEYS).select(*t.KEYS, F.explode(weeks).alias("week"))
    return join_observed(grid, weekly, t.KEYS)


_W = "(PARTITION BY grp, area, cat, cls ORDER BY week"


@query("lag_features", f"SELECT week, {_K4}, " + ", ".join(f"lag(n, {i}) OVER {_W}) AS lag_{i}" for i in (1, 2, 4, 8, 52)) + " FROM panel4")
def lag_features(spark, sf):
    prior = PriorRows(t.KEYS, "week", "n")
    return panel(spark, sf)[2].select("week", *t.KEYS, *[prior.lag(i).alias(f"lag_{i}") for i in (1, 2, 4, 8, 52)])


def _prior(fn: str, n) -> str:
    return f"{fn}(n) OVER {_W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


@query("trailing_stats", f"SELECT week, {_K4}, " + ", ".join(
    f"round({_prior('avg', n)}, 6) AS mean_{n}, {_prior('count', n)} AS count_{n}, round({_prior('stddev_pop', n)}, 6) AS std_{n}, {_prior('min', n)} AS min_{n}, {_prior('max', n)} AS max_{n}"
    for n in (4, 8)) + " FROM panel4")
def trailing_stats(spark, sf):
    prior = PriorRows(t.KEYS, "week", "n")
    cols = []
    for n in (4, 8):
        cols += [dround(prior.mean(n), 6).alias(f"mean_{n}"), prior.count(n).alias(f"count_{n}"),
                 dround(prior.std(n), 6).alias(f"std_{n}"), prior.low(n).alias(f"min_{n}"), prior.high(n).alias(f"max_{n}")]
    return panel(spark, sf)[2].select("week", *t.KEYS, *cols)


@query("prior_cumulative", f"""SELECT week, {_K4}, {_prior('count', 'UNBOUNDED')} AS prior_weeks, {_prior('sum', 'UNBOUNDED')} AS prior_total,
  round({_prior('avg', 'UNBOUNDED')}, 6) AS prior_mean FROM panel4""")
def prior_cumulative(spark, sf):
    prior = PriorRows(t.KEYS, "week", "n")
    return panel(spark, sf)[2].select("week", *t.KEYS, prior.count().alias("prior_weeks"), prior.total().alias("prior_total"),
                                      dround(prior.mean(), 6).alias("prior_mean"))


@query("rolling_median_mad", "SELECT week, grp, cat, round(median_long, 6) AS median_26, round(mad_long, 6) AS mad_26 FROM afeat2")
def rolling_median_mad(spark, sf):
    _, dates, dense_rows = panel(spark, sf, t.KEYS2)
    prior = PriorRows(t.KEYS2, "week", "n")
    rows = dense_rows.filter(F.col("week") < F.lit(dates.last)).select("week", *t.KEYS2, prior.recent_values(26).alias("v"))
    centred = rows.withColumn("m", array_median(F.col("v")))
    return centred.select("week", *t.KEYS2, dround("m", 6).alias("median_26"), dround(array_mad(F.col("v"), F.col("m")), 6).alias("mad_26"))


_METHODS = ", ".join(fc.METHODS)


@query("baseline_forecasts", f"SELECT week, {_K4}, actual, {_METHODS}, is_backtest, is_next_week, {_SEG} FROM blines4")
def baseline_forecasts(spark, sf):
    return baselines(spark, sf)


@query("unpivot_methods", "SELECT * FROM blong4")
def unpivot_methods(spark, sf):
    return fc.unpivot_methods(baselines(spark, sf), t.KEYS)


def _metrics(source: str, by: str = "", filt: str = "true") -> str:
    cols = f"{by}, " if by else ""
    return f"""SELECT method, {cols}count(predicted) FILTER (WHERE actual IS NOT NULL) AS predictions, count(*) AS backtest_rows,
  round(count(predicted) FILTER (WHERE actual IS NOT NULL) * 100.0 / count(*), 2) AS coverage_pct,
  CAST(coalesce(sum(actual) FILTER (WHERE predicted IS NOT NULL), 0) AS BIGINT) AS events, CAST(sum(actual) AS BIGINT) AS all_events,
  round(round(avg(abs(predicted - actual)), 10), 4) AS mae, round(round(sqrt(avg((predicted - actual) ** 2)), 10), 4) AS rmse,
  round(round(sum(abs(predicted - actual) * actual) / nullif(sum(actual) FILTER (WHERE predicted IS NOT NULL), 0), 10), 4) AS wmae
  FROM {source} WHERE {filt} GROUP BY method{', ' + by if by else ''}"""


def _register_metrics() -> None:
    for name, by in (("baseline_metrics", []), ("baseline_metrics_grp", ["grp"]), ("baseline_metrics_cat", ["cat"]),
                     ("baseline_metrics_grp_cat", ["grp", "cat"])):
        def run(spark, sf, by=by):
            return ev.error_metrics(fc.unpivot_methods(baselines(spark, sf), t.KEYS), by)
        query(name, _metrics("blong4", ", ".join(by)))(run)


_register_metrics()


def model_long(predicted):
    return predicted.filter("is_backtest").withColumnRenamed("model", "method")


_MODEL = "(SELECT *, model AS method FROM pred4 WHERE is_backtest) pm"


@query("model_metrics", _metrics(_MODEL))
def model_metrics(spark, sf):
    return ev.error_metrics(model_long(predictions(spark, sf)))


def _register_model_metrics() -> None:
    for name, by in (("model_metrics_grp", ["grp"]), ("model_metrics_cat", ["cat"]), ("model_metrics_grp_cat", ["grp", "cat"])):
        def run(spark, sf, by=by):
            return ev.error_metrics(model_long(predictions(spark, sf)), by)
        query(name, _metrics(_MODEL, ", ".join(by)))(run)


_register_model_metrics()


_LEVELS = [[], ["grp"], ["cat"], ["grp", "cat"]]


def _level_sql() -> str:
    parts = []
    for level in _LEVELS:
        outs = ", ".join(d if d in level else f"NULL AS {d}" for d in ("grp", "cat"))
        bits = sum(b for d, b in (("grp", 2), ("cat", 1)) if d not in level)
        cols = "predictions, backtest_rows, coverage_pct, events, all_events, mae, rmse, wmae"
        parts.append(f"SELECT method, {outs}, CAST({bits} AS BIGINT) AS level_id, {cols} FROM ({_metrics('blong4', ', '.join(level))})")
    return "\nUNION ALL\n".join(parts)


@query("metrics_grouping_sets", _level_sql())
def metrics_grouping_sets(spark, sf):
    return ev.metric_levels(fc.unpivot_methods(baselines(spark, sf), t.KEYS), ["grp", "cat"], _LEVELS)


@query("join_methods_cross", """SELECT g.grp, m.method, s.predictions, s.mae FROM (SELECT DISTINCT grp FROM blong4) g
  JOIN (SELECT unnest(['previous_week', 'trailing_4_week_mean', 'no_such_method']) AS method) m ON true
  LEFT JOIN (SELECT method, grp, count(*) AS predictions, round(round(avg(abs(predicted - actual)), 10), 4) AS mae FROM blong4
    WHERE predicted IS NOT NULL AND actual IS NOT NULL GROUP BY method, grp) s ON s.grp = g.grp AND s.method = m.method""")
def join_methods_cross(spark, sf):
    long = materialize(fc.unpivot_methods(baselines(spark, sf), t.KEYS))
    stats = long.filter("predicted IS NOT NULL AND actual IS NOT NULL").groupBy("method", "grp").agg(
        F.count(F.lit(1)).alias("predictions"), sround(F.avg(F.abs(F.col("predicted") - F.col("actual"))), 4).alias("mae"))
    return ev.methods_for_groups(long.select("grp").distinct(), stats, ["previous_week", "trailing_4_week_mean", "no_such_method"], ["grp"])


def _capture(source: str) -> str:
    return f"""SELECT method, count(*) AS weeks, round(avg(k), 2) AS avg_k, CAST(sum(te) AS BIGINT) AS top_events, CAST(sum(ce) AS BIGINT) AS captured_events,
  round(sum(ce) * 1.0 / nullif(sum(te), 0), 4) AS capture_rate FROM (
  SELECT method, week, max(k) AS k, sum(actual) FILTER (WHERE ar <= k) AS te, coalesce(sum(actual) FILTER (WHERE ar <= k AND pr <= k), 0) AS ce FROM (
    SELECT *, greatest(1, CAST(ceil(count(*) OVER (PARTITION BY method, week) * 0.1) AS BIGINT)) AS k,
      row_number() OVER (PARTITION BY method, week ORDER BY actual DESC, {_K4}) AS ar,
      row_number() OVER (PARTITION BY method, week ORDER BY predicted DESC, {_K4}) AS pr
    FROM {source} WHERE actual IS NOT NULL AND predicted IS NOT NULL) GROUP BY method, week) GROUP BY method"""


@query("top_k_capture", _capture("blong4"))
def top_k_capture(spark, sf):
    return ev.top_k_capture(fc.unpivot_methods(baselines(spark, sf), t.KEYS), t.KEYS)


@query("top_k_capture_model", _capture(_MODEL))
def top_k_capture_model(spark, sf):
    return ev.top_k_capture(model_long(predictions(spark, sf)), t.KEYS)


@query("best_baseline", f"SELECT * FROM ({_metrics('blong4')}) ORDER BY mae, wmae, coverage_pct DESC, method LIMIT 1")
def best_baseline(spark, sf):
    return ev.best_method(ev.error_metrics(fc.unpivot_methods(baselines(spark, sf), t.KEYS)))


# The baseline that wins the backtest.
_WON = f"(SELECT method FROM ({_metrics('blong4')}) ORDER BY mae, wmae, coverage_pct DESC, method LIMIT 1)"


def _hardest(by: str, low: int, source: str, where: str) -> str:
    return f"""SELECT {by}, count(*) AS predictions, CAST(sum(actual) AS BIGINT) AS events, round(round(avg(abs(predicted - actual)), 10), 4) AS mae,
  round(round(sqrt(avg((predicted - actual) ** 2)), 10), 4) AS rmse FROM {source} WHERE {where} AND predicted IS NOT NULL AND actual IS NOT NULL
  GROUP BY {by} HAVING sum(actual) >= {low} ORDER BY mae DESC, rmse DESC, events DESC, {by} LIMIT 15"""


def _register_hardest() -> None:
    for name, by, low in (("hardest_segments_2", ["grp", "cat"], 50), ("hardest_segments_3", ["grp", "area", "cat"], 10)):
        def run(spark, sf, by=by, low=low):
            long = materialize(fc.unpivot_methods(baselines(spark, sf), t.KEYS))
            won = ev.best_method(ev.error_metrics(long)).select("method").scalar()
            return ev.hardest_segments(long.filter(F.col("method") == won), by, low)

        def run_model(spark, sf, by=by, low=low):
            return ev.hardest_segments(model_long(predictions(spark, sf)), by, low)
        query(name, _hardest(", ".join(by), low, "blong4", f"method = {_WON}"))(run)
        query(f"model_{name}", _hardest(", ".join(by), low, _MODEL, "is_backtest"))(run_model)


_register_hardest()

_FEATS = [f"lag_{n}" for n in (1, 2, 4, 8, 52)] + [f"trailing_{s}_{n}" for n in (4, 8) for s in ("mean", "std", "min", "max")]


@query("lag_features_full", f"SELECT week, {_K4}, actual, year, month_no, iso_week, quarter, week_index, prior_weeks, prior_total, is_backtest, is_next_week, {_SEG}, round(prior_mean, 6) AS prior_mean, "
       + ", ".join(f"round({c}, 6) AS {c}" for c in _FEATS) + " FROM feat4")
def lag_features_full(spark, sf):
    return features(spark, sf)[1].withColumns({c: dround(c, 6) for c in [*_FEATS, "prior_mean"]})


@query("fit_grid", "SELECT * FROM grid4")
def fit_grid(spark, sf):
    return fitted(spark, sf)[1]


@query("fit_best", "SELECT * FROM best4")
def fit_best(spark, sf):
    return fc.fit_best(fitted(spark, sf)[1])


@query("lag_ensemble_predict", "SELECT * FROM pred4")
def lag_ensemble_predict(spark, sf):
    return predictions(spark, sf)


@query("next_week_forecast", f"SELECT week, {_K4}, predicted, model FROM future4")
def next_week_forecast(spark, sf):
    return fc.next_week(predictions(spark, sf)).select("week", *t.KEYS, "predicted", "model")


def _compare(source: str) -> str:
    pick = lambda m, n: f"max({m}) FILTER (WHERE method = '{n}')"
    return "\nUNION ALL\n".join(
        f"""SELECT '{m}' AS metric, {pick(m, 'lag_ensemble')} AS challenger, {pick(m, 'trailing_8_week_mean')} AS reference,
  round({pick(m, 'lag_ensemble')} - {pick(m, 'trailing_8_week_mean')}, 4) AS delta, {pick(m, 'lag_ensemble')} < {pick(m, 'trailing_8_week_mean')} AS beats FROM ({source})"""
        for m in ("mae", "rmse", "wmae"))


_MATCHED = """(SELECT p.week, p.actual, 'lag_ensemble' AS method, p.predicted FROM pred4 p JOIN blong4 b ON p.week = b.week AND p.grp = b.grp AND p.area = b.area AND p.cat = b.cat AND p.cls = b.cls
  WHERE p.is_backtest AND b.method = 'trailing_8_week_mean' AND b.predicted IS NOT NULL
UNION ALL SELECT week, actual, method, predicted FROM blong4 WHERE method = 'trailing_8_week_mean' AND predicted IS NOT NULL) mm"""


def _both_models(spark, sf):
    weekly, dates, dense_rows = panel(spark, sf)
    rows = materialize(fc.ml_features(dense_rows, t.KEYS, dates).filter(F.col("week") >= F.lit(dates.validation_start)))
    best = fc.fit_best(fc.fit_grid(rows, dates.validation_start, dates.validation_end))
    model = model_long(fc.predict(rows, best, t.KEYS))
    base = fc.unpivot_methods(fc.baseline_forecasts(dense_rows, t.KEYS, dates), t.KEYS).filter("method = 'trailing_8_week_mean'")
    return model.select("week", *t.KEYS, "actual", "method", "predicted"), base


@query("compare_models_matched", _compare(_metrics(_MATCHED)))
def compare_models_matched(spark, sf):
    model, base = _both_models(spark, sf)
    long = ev.matched_predictions(model, base, t.KEYS, ("lag_ensemble", "trailing_8_week_mean"))
    return ev.compare_models(ev.error_metrics(long), "lag_ensemble", "trailing_8_week_mean")


@query("compare_models_unmatched", _compare(_metrics(_MODEL) + " UNION ALL " + _metrics("blong4", "", "method = 'trailing_8_week_mean'")))
def compare_models_unmatched(spark, sf):
    model, base = _both_models(spark, sf)
    return ev.compare_models(ev.error_metrics(model.unionByName(base)), "lag_ensemble", "trailing_8_week_mean")


def _spread(spark, sf):
    weekly, dates, dense_rows = panel(spark, sf)
    return weekly, dates, fc.baseline_forecasts(dense_rows, t.KEYS, dates)


_NEXT = "blines4 WHERE is_next_week"


@query("baseline_reconcile", f"""SELECT 'published' AS name, count(*) AS matched_keys, CAST(0 AS BIGINT) AS only_published, CAST(0 AS BIGINT) AS only_derived,
  CAST(0 AS BIGINT) AS value_mismatches FROM {_NEXT}
UNION ALL SELECT 'damaged', count(*) FILTER (WHERE area <> '3'), count(*) FILTER (WHERE area = '4'), count(*) FILTER (WHERE area = '3'),
  count(*) FILTER (WHERE area <> '3' AND cls = 'F' AND trailing_8_week_mean IS NOT NULL) FROM {_NEXT}""")
def baseline_reconcile(spark, sf):
    """Of the published baseline; and of a copy without one area, with another one twice under two names, and with other values in a class."""
    weekly, dates, lines = _spread(spark, sf)
    published = fc.next_week(lines).select("week", *t.KEYS, F.col("trailing_8_week_mean").alias("baseline"))
    derived = fc.derive_baseline(weekly, t.KEYS, dates.forecast, "trailing_8_week_mean")
    damaged = published.filter("area <> '3'").withColumn("baseline", F.col("baseline") + F.when(F.col("cls") == "F", 1.0).otherwise(0.0))
    damaged = damaged.unionByName(published.filter("area = '4'").withColumn("area", F.lit("no such area")))
    parts = [q.compare_values(rows, derived, ["week", *t.KEYS], "baseline", "derived_baseline").select(F.lit(name).alias("name"), "*")
             for name, rows in (("published", published), ("damaged", damaged))]
    return parts[0].unionByName(parts[1])


@query("join_full_outer_keys", f"""SELECT coalesce(a.grp, b.grp) AS grp, coalesce(a.area, b.area) AS area, a.predicted IS NOT NULL AS has_late, b.n IS NOT NULL AS has_early
  FROM (SELECT grp, area, count(*) AS predicted FROM weekly4 WHERE week >= DATE '2001-06-01' GROUP BY grp, area) a
  FULL OUTER JOIN (SELECT grp, area, count(*) AS n FROM weekly4 WHERE week < DATE '1995-06-01' GROUP BY grp, area) b ON a.grp = b.grp AND a.area = b.area""")
def join_full_outer_keys(spark, sf):
    w = t.weekly(spark, sf)
    late = w.filter("week >= DATE '2001-06-01'").groupBy("grp", "area").agg(F.count(F.lit(1)).alias("a"))
    early = w.filter("week < DATE '1995-06-01'").groupBy("grp", "area").agg(F.count(F.lit(1)).alias("b"))
    both = late.join(early, ["grp", "area"], "full_outer")
    return both.select("grp", "area", F.col("a").isNotNull().alias("has_late"), F.col("b").isNotNull().alias("has_early"))


@query("join_predictions_left", "SELECT f.week, f.grp, f.cat, f.actual, p.predicted AS expected_model FROM afeat2 f LEFT JOIN (SELECT * FROM pred2 WHERE is_backtest AND actual IS NOT NULL) p ON f.week = p.week AND f.grp = p.grp AND f.cat = p.cat")
def join_predictions_left(spark, sf):
    from queries.signals import scoring_inputs
    rows, model = scoring_inputs(spark, sf)
    return rows.select("week", *t.KEYS2, "actual").join(model, ["week", *t.KEYS2], "left")


@query("safe_predictions", "SELECT week, grp, cat, predicted AS expected_model FROM pred2 WHERE is_backtest AND actual IS NOT NULL")
def safe_predictions(spark, sf):
    from segpanel.operators.anomaly import safe_predictions as safe
    return safe(predictions(spark, sf, t.KEYS2), t.KEYS2)
