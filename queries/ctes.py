"""Oracle side: named common table expressions and the WITH clause that a query needs."""

from __future__ import annotations

import re

from queries.shared import EVENT_EXPRS, RAW_EXPRS, duck_dialect

NULLS = "('', '(NULL)', 'NULL', 'N/A', 'NA', 'NAN', 'NONE')"
IN_BOX = "x BETWEEN -74.27 AND -73.65 AND y BETWEEN 40.48 AND 40.93"
VALID = f"coalesce({IN_BOX}, false) AND NOT flag_missing_xy AND NOT flag_zero_xy AND NOT flag_outside_xy"

CTES: dict[str, str] = {}


def norm(c: str) -> str:
    return rf"CASE WHEN upper(trim({c})) IN {NULLS} THEN NULL ELSE regexp_replace(trim({c}), '\s+', ' ', 'g') END"


def cell(c: str, size: float = 0.1) -> str:
    return f"round(floor({c} / {size}::DOUBLE) * {size}::DOUBLE + {size}::DOUBLE / 2, 5)"


CTES["base"] = """
SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS odate, c_acctbal AS acct, o_totalprice AS price,
       r_name AS region, n_nationkey AS nation, o_orderpriority AS priority, o_orderstatus AS status
FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""

CTES["raw"] = "SELECT " + ", ".join(f"{duck_dialect(e)} AS {n}" for n, e in RAW_EXPRS.items()) + " FROM base"

CTES["prepared"] = "SELECT " + ", ".join(
    f"{'upper(' + norm(c) + ')' if c in ('grp_text', 'cat_text', 'cls_text') else norm(c)} AS {c}" for c in RAW_EXPRS
) + " FROM raw"

CTES["typed"] = """
SELECT event_id,
  CAST(try_strptime(start_date_text, '%m/%d/%Y') AS DATE) AS start_day,
  CAST(try_strptime(end_date_text, '%m/%d/%Y') AS DATE) AS end_day,
  CAST(try_strptime(report_date_text, '%m/%d/%Y') AS DATE) AS report_day,
  try_strptime(start_date_text || ' ' || start_time_text, '%m/%d/%Y %H:%M:%S') AS start_ts,
  try_strptime(end_date_text || ' ' || end_time_text, '%m/%d/%Y %H:%M:%S') AS end_ts,
  start_time_text AS start_time,
  CASE WHEN grp_text IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST') THEN grp_text END AS grp,
  try_cast(area_text AS INTEGER) AS area, cat_text AS cat,
  CASE WHEN cls_text IN ('F', 'O', 'P') THEN cls_text END AS cls, cls_text AS cls_raw,
  try_cast(x_text AS DOUBLE) AS x, try_cast(y_text AS DOUBLE) AS y
FROM prepared"""

CTES["clean"] = f"""
SELECT *, start_day IS NULL AS flag_missing_start,
  coalesce(start_day < DATE '1995-02-01', false) AS flag_old_start,
  coalesce(start_day > DATE '2001-07-31', false) AS flag_future_start,
  coalesce(end_day > DATE '2001-07-31', false) AS flag_future_end,
  CASE WHEN start_ts IS NOT NULL AND end_ts IS NOT NULL THEN end_ts < start_ts
       ELSE coalesce(end_day < start_day, false) END AS flag_end_before_start,
  coalesce(report_day < start_day, false) AS flag_report_before_start,
  grp IS NULL AS flag_missing_grp, area IS NULL AS flag_missing_area, cat IS NULL AS flag_missing_cat,
  (x IS NULL OR y IS NULL) AS flag_missing_xy,
  (coalesce(x = 0, false) OR coalesce(y = 0, false)) AS flag_zero_xy,
  (x IS NOT NULL AND y IS NOT NULL AND NOT ({IN_BOX})) AS flag_outside_xy,
  (cls_raw IS NULL OR cls_raw NOT IN ('F', 'O', 'P')) AS flag_invalid_cls,
  coalesce(start_day BETWEEN DATE '1995-02-01' AND DATE '2001-07-31', false) AS is_eligible
FROM typed"""

CTES["ev"] = f"""
SELECT *, day BETWEEN DATE '1995-02-01' AND DATE '2001-07-31' AS is_eligible,
  (x IS NULL OR y IS NULL) AS flag_missing_xy, (coalesce(x = 0, false) OR coalesce(y = 0, false)) AS flag_zero_xy,
  (x IS NOT NULL AND y IS NOT NULL AND NOT ({IN_BOX})) AS flag_outside_xy
FROM (SELECT {", ".join(f"{duck_dialect(e)} AS {n}" for n, e in EVENT_EXPRS.items())} FROM base)"""

CTES["ok"] = "SELECT * FROM ev WHERE is_eligible"
CTES["points"] = f"SELECT * FROM ok WHERE {VALID}"


def _filled(keys: list[str]) -> str:
    return ", ".join(f"coalesce({k}, 'UNKNOWN') AS {k}" for k in keys)


def _panel_family(suffix: str, keys: list[str]) -> None:
    """Weekly table, panel, baselines, features, fit, predictions and anomaly scores for a grain."""
    k, on = ", ".join(keys), " AND ".join(f"s.{c} = w.{c}" for c in keys)
    on_p = " AND ".join(f"f.{c} = p.{c}" for c in keys)
    w = f"(PARTITION BY {k} ORDER BY week"

    def prior(fn: str, n: int | None) -> str:
        low = "UNBOUNDED" if n is None else str(n)
        return f"{fn} OVER {w} ROWS BETWEEN {low} PRECEDING AND 1 PRECEDING)"

    CTES[f"weekly{suffix}"] = f"""
SELECT CAST(date_trunc('week', day) AS DATE) AS week, {_filled(keys)}, count(*) AS n
FROM ok GROUP BY ALL"""
    CTES[f"monthly{suffix}"] = f"""
SELECT CAST(date_trunc('month', day) AS DATE) AS month, {_filled(keys)}, count(*) AS n
FROM ok GROUP BY ALL"""
    CTES[f"dates{suffix}"] = f"""
SELECT *, greatest(first, bt_end - 357) AS bt_start, greatest(first, bt_end - 357) - 7 AS val_end,
  greatest(first, greatest(first, bt_end - 357) - 7 - 357) AS val_start
FROM (SELECT min(week) AS first, max(week) AS last, max(week) + 7 AS forecast,
        CASE WHEN max(week) - 7 < min(week) THEN max(week) ELSE max(week) - 7 END AS bt_end FROM weekly{suffix})"""
    CTES[f"seg{suffix}"] = f"""
SELECT {k}, min(week) AS first_week, max(week) AS last_week, count(*) AS observed_weeks, CAST(sum(n) AS BIGINT) AS total
FROM weekly{suffix} GROUP BY {k}"""
    CTES[f"cal{suffix}"] = f"""
SELECT CAST(unnest(generate_series(first, forecast, INTERVAL 7 DAY)) AS DATE) AS week FROM dates{suffix}"""
    CTES[f"panel{suffix}"] = f"""
SELECT c.week, {", ".join("s." + c for c in keys)}, CASE WHEN c.week <= d.last THEN coalesce(w.n, 0)::DOUBLE END AS n,
  s.first_week, s.last_week, s.observed_weeks, s.total
FROM seg{suffix} s JOIN cal{suffix} c ON c.week >= s.first_week CROSS JOIN dates{suffix} d
LEFT JOIN weekly{suffix} w ON w.week = c.week AND {on}"""
    CTES[f"blines{suffix}"] = f"""
SELECT p.*, week BETWEEN bt_start AND bt_end AS is_backtest, week = forecast AS is_next_week FROM (
 SELECT week, {k}, CAST(n AS BIGINT) AS actual, lag(n, 1) OVER {w}) AS previous_week,
  lag(n, 52) OVER {w}) AS previous_year_same_week,
  CASE WHEN {prior("count(n)", 4)} = 4 THEN {prior("avg(n)", 4)} END AS trailing_4_week_mean,
  CASE WHEN {prior("count(n)", 8)} = 8 THEN {prior("avg(n)", 8)} END AS trailing_8_week_mean,
  first_week, last_week, observed_weeks, total FROM panel{suffix}) p, dates{suffix}
WHERE week BETWEEN bt_start AND bt_end OR week = forecast"""
    CTES[f"blong{suffix}"] = "\nUNION ALL\n".join(
        f"SELECT week, {k}, actual, '{m}' AS method, {m} AS predicted FROM blines{suffix} WHERE is_backtest"
        for m in ("previous_week", "previous_year_same_week", "trailing_4_week_mean", "trailing_8_week_mean"))
    raw_cols = [f"lag(n, {n}) OVER {w}) AS lag_{n}" for n in (1, 2, 4, 8, 52)]
    for n in (4, 8):
        raw_cols += [f"{prior(fn + '(n)', n)} AS trailing_{nm}_{n}" for nm, fn in
                     (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"))]
    names = [c.split(" AS ")[-1] for c in raw_cols]
    imputed = ", ".join(
        f"coalesce({c}, 0)::DOUBLE AS {c}" if "_std_" in c else f"coalesce({c}, pm, 0)::DOUBLE AS {c}" for c in names)
    CTES[f"feat{suffix}"] = f"""
SELECT week, {k}, CAST(n AS BIGINT) AS actual, extract(year FROM week)::DOUBLE AS year,
  extract(month FROM week)::DOUBLE AS month_no, extract(week FROM week)::DOUBLE AS iso_week,
  extract(quarter FROM week)::DOUBLE AS quarter, date_diff('week', d.first, week)::DOUBLE AS week_index,
  {imputed}, pc AS prior_weeks, coalesce(pt, 0)::DOUBLE AS prior_total, coalesce(pm, 0)::DOUBLE AS prior_mean,
  week BETWEEN bt_start AND bt_end AS is_backtest, week = forecast AS is_next_week,
  first_week, last_week, observed_weeks, total
FROM (SELECT *, {", ".join(raw_cols)}, {prior("count(n)", None)} AS pc, {prior("sum(n)", None)} AS pt,
  {prior("avg(n)", None)} AS pm FROM panel{suffix}), dates{suffix} d"""
    # Equal inputs are counted before they meet the parameters, so the oracle stays quick.
    CTES[f"grid{suffix}"] = f"""
WITH i AS (SELECT actual, trailing_mean_8 AS m8, trailing_mean_4 AS m4, lag_1 AS l1, lag_52 AS l52, count(*) AS k
  FROM feat{suffix} f, dates{suffix} d WHERE f.week BETWEEN d.val_start AND d.val_end AND f.actual IS NOT NULL GROUP BY ALL),
e AS (SELECT k, actual, g.*, greatest(0.0::DOUBLE, g.shrink::DOUBLE * (m8 + g.alpha::DOUBLE * (m4 - m8) + g.beta::DOUBLE * (l1 - m4)
    + g.gamma::DOUBLE * (l52 - m8))) - actual AS d FROM i, params g)
SELECT alpha::DOUBLE AS alpha, beta::DOUBLE AS beta, gamma::DOUBLE AS gamma, shrink::DOUBLE AS shrink, CAST(sum(k) AS BIGINT) AS rows,
  CAST(sum(k * actual) AS BIGINT) AS events, round(round(sum(k * abs(d)) / sum(k), 10), 5) AS mae, round(round(sqrt(sum(k * d * d) / sum(k)), 10), 5) AS rmse,
  round(round(sum(k * abs(d) * actual) / nullif(sum(k * actual), 0), 10), 5) AS wmae
FROM e GROUP BY alpha, beta, gamma, shrink"""
    CTES[f"best{suffix}"] = f"""
SELECT * FROM grid{suffix} ORDER BY rmse, mae, coalesce(wmae, 1e18), abs(shrink - 1.0), abs(alpha), abs(beta), abs(gamma),
  alpha, beta, gamma, shrink LIMIT 1"""
    CTES[f"pred{suffix}"] = f"""
SELECT f.week, {", ".join("f." + c for c in keys)}, f.actual, round(greatest(0.0::DOUBLE, b.shrink * (trailing_mean_8
    + b.alpha * (trailing_mean_4 - trailing_mean_8) + b.beta * (lag_1 - trailing_mean_4)
    + b.gamma * (lag_52 - trailing_mean_8))), 6) AS predicted, 'lag_ensemble' AS model, is_backtest, is_next_week,
  first_week, last_week, observed_weeks, total
FROM feat{suffix} f, best{suffix} b WHERE is_backtest OR is_next_week"""
    CTES[f"afeat{suffix}"] = f"""
SELECT *, CASE WHEN weeks_long > 0 THEN list_median(list_transform(v, lambda x: abs(x - median_long))) END AS mad_long FROM (
SELECT week, {k}, CAST(n AS BIGINT) AS actual, first_week, last_week, observed_weeks, total,
  {prior("count(n)", 8)} AS weeks_short, {prior("count(n)", 13)} AS weeks_base, {prior("count(n)", 26)} AS weeks_long,
  {prior("sum(n)", 13)} AS total_base, {prior("sum(n)", 26)} AS total_long,
  {prior("count(CASE WHEN n > 0 THEN 1 END)", 13)} AS nonzero_weeks,
  {prior("avg(n)", 8)} AS mean_short, {prior("avg(n)", 13)} AS mean_base, {prior("avg(n)", 26)} AS mean_long,
  {prior("stddev_pop(n)", 13)} AS std_base, {prior("median(n)", 26)} AS median_long, {prior("list(n)", 26)} AS v
FROM panel{suffix} p, dates{suffix} d WHERE week <= CASE WHEN d.last - 7 < d.first THEN d.last ELSE d.last - 7 END)"""
    CTES[f"ascore{suffix}"] = f"""
WITH j AS (
  SELECT f.week, {", ".join("f." + c for c in keys)}, f.actual, f.first_week, f.last_week, f.observed_weeks, f.total,
    p.predicted AS xm, p.predicted IS NOT NULL AS has_model,
    CASE WHEN weeks_base >= 13 THEN mean_base END AS xh, CASE WHEN weeks_short = 8 THEN mean_short END AS m8,
    CASE WHEN weeks_long = 26 THEN mean_long END AS m26, CASE WHEN weeks_base >= 13 THEN std_base END AS sd,
    CASE WHEN weeks_long = 26 THEN median_long END AS med, CASE WHEN weeks_long = 26 THEN mad_long END AS mad,
    weeks_base, weeks_long, nonzero_weeks, coalesce(total_base, 0)::BIGINT AS total_base, coalesce(total_long, 0)::BIGINT AS total_long
  FROM afeat{suffix} f LEFT JOIN (SELECT * FROM pred{suffix} WHERE is_backtest AND actual IS NOT NULL) p ON f.week = p.week AND {on_p}
), m AS (
  SELECT *, coalesce(xm, xh) AS xe, actual - coalesce(xm, xh) AS re, actual - xh AS rh, actual - xm AS rm,
    CASE WHEN m8 > 0 THEN round((actual - m8) * 100.0 / m8, 4) END AS pct_vs_short,
    CASE WHEN sd > 0 THEN round((actual - xh) / sd, 4) END AS z,
    CASE WHEN mad > 0 THEN round((actual - med) / (1.4826::DOUBLE * mad), 4) END AS robust_z,
    round((actual - xm) / greatest(sqrt(xm + 1), 1), 4) AS model_scaled,
    weeks_base >= 13 AS is_evaluable, weeks_base >= 13 AND total_base >= 13 AND actual >= 4 AS passes_volume
  FROM j
), fl AS (
  SELECT *, coalesce(passes_volume AND rh >= 3 AND (coalesce(z >= 2, false) OR coalesce(robust_z >= 3, false) OR coalesce(pct_vs_short >= 75, false)), false) AS is_history_anomaly,
    coalesce(has_model AND passes_volume AND rm >= 3 AND (coalesce(model_scaled >= 2.5, false) OR coalesce(xm > 0 AND actual >= xm * 1.75::DOUBLE, false)), false) AS is_model_anomaly
  FROM m
), sc AS (
  SELECT *, is_history_anomaly OR is_model_anomaly AS is_anomaly,
    CASE WHEN is_history_anomaly OR is_model_anomaly THEN round(
      0.45::DOUBLE * greatest(coalesce(z, 0), 0) + 0.20::DOUBLE * greatest(coalesce(robust_z, 0), 0)
      + 0.15::DOUBLE * least(greatest(coalesce(pct_vs_short, 0) / 100.0, 0), 5)
      + 0.15::DOUBLE * least(greatest(coalesce(rh, 0) / greatest(sqrt(coalesce(xh, 0) + 1), 1), 0), 8)
      + 0.05::DOUBLE * least(greatest(coalesce(model_scaled, 0), 0), 8), 4) ELSE 0.0::DOUBLE END AS score,
    greatest(coalesce(rh, -1e9), coalesce(rm, -1e9)) AS reach
  FROM fl
)
SELECT week, {k}, actual, first_week, last_week, observed_weeks, total, has_model,
  round(xe, 6) AS expected, CASE WHEN has_model THEN 'model' WHEN xh IS NOT NULL THEN 'trailing_mean' END AS expected_source,
  round(xh, 6) AS expected_history, round(xm, 6) AS expected_model, round(re, 6) AS residual, round(rh, 6) AS residual_history,
  round(rm, 6) AS residual_model, round(m8, 6) AS mean_short, round(xh, 6) AS mean_base, round(m26, 6) AS mean_long,
  round(sd, 6) AS std_base, round(med, 6) AS median_long, round(mad, 6) AS mad_long, weeks_base, weeks_long, nonzero_weeks,
  total_base, total_long, pct_vs_short, z, robust_z, model_scaled, is_evaluable, passes_volume, is_history_anomaly,
  is_model_anomaly, is_anomaly, score,
  CASE WHEN NOT is_anomaly THEN 'none'
    WHEN actual >= 10 AND reach >= 8 AND (coalesce(z >= 4.5, false) OR coalesce(robust_z >= 6, false) OR coalesce(model_scaled >= 6, false) OR score >= 4.5) THEN 'critical'
    WHEN reach >= 6 AND (coalesce(z >= 3.5, false) OR coalesce(robust_z >= 5, false) OR coalesce(model_scaled >= 4.5, false) OR coalesce(pct_vs_short >= 200, false) OR score >= 3.5) THEN 'high'
    WHEN reach >= 4 AND (coalesce(z >= 2.75, false) OR coalesce(robust_z >= 4, false) OR coalesce(model_scaled >= 3.5, false) OR coalesce(pct_vs_short >= 125, false) OR score >= 2.5) THEN 'medium'
    ELSE 'low' END AS severity
FROM sc"""
    CTES[f"anoms{suffix}"] = f"""
SELECT *, row_number() OVER (ORDER BY score DESC, actual DESC, week DESC, {k}) AS rank_overall,
  row_number() OVER (PARTITION BY week ORDER BY score DESC, actual DESC, {k}) AS rank_in_week
FROM ascore{suffix} WHERE is_anomaly"""


CTES["params"] = """
SELECT a / 100.0 AS alpha, b / 100.0 AS beta, g / 100.0 AS gamma, s / 100.0 AS shrink
FROM range(-10, 51, 5) t1(a), range(-10, 11, 5) t2(b), range(-5, 6, 5) t3(g), range(95, 106, 5) t4(s)"""

_panel_family("4", ["grp", "area", "cat", "cls"])
_panel_family("2", ["grp", "cat"])

CTES["bins"] = f"""
SELECT day, {_filled(["grp", "area", "cat", "cls"])}, x, y, flag_missing_xy, flag_zero_xy, flag_outside_xy, count(*) AS weight
FROM ok GROUP BY ALL"""
CTES["hend"] = "SELECT CASE WHEN max(day) - 1 < min(day) THEN max(day) ELSE max(day) - 1 END AS send FROM bins"
CTES["hbins"] = f"""
SELECT b.*, send, date_diff('day', day, send) AS age, ({VALID}) AS ok_xy,
  CASE WHEN {VALID} THEN {cell('x')} END AS cell_x, CASE WHEN {VALID} THEN {cell('y')} END AS cell_y
FROM bins b, hend WHERE day <= send"""


def _window_sums(cond: str = "true") -> str:
    spans = (("recent_7", "age < 7"), ("recent_30", "age < 30"), ("recent_90", "age < 90"), ("baseline", "age BETWEEN 90 AND 454"))
    return ", ".join(f"CAST(coalesce(sum(weight) FILTER (WHERE {s} AND {cond}), 0) AS BIGINT) AS {n}" for n, s in spans)


CTES["hcent"] = """
SELECT grp, area, round(sum(x * weight) / sum(weight), 6) AS map_x, round(sum(y * weight) / sum(weight), 6) AS map_y,
  CAST(sum(weight) AS BIGINT) AS centroid_weight
FROM hbins WHERE ok_xy AND area <> 'UNKNOWN' GROUP BY grp, area"""
CTES["harea"] = f"""
SELECT 'area' AS grain, c.grp, c.area, NULL::DOUBLE AS cell_x, NULL::DOUBLE AS cell_y, cat, cls, map_x, map_y,
  recent_7, recent_30, recent_90, baseline, valid_events, snapshot_day
FROM (SELECT grp, area, cat, cls, {_window_sums()}, max(send) AS snapshot_day,
        CAST(coalesce(sum(weight) FILTER (WHERE age < 30 AND ok_xy), 0) AS BIGINT) AS valid_events
      FROM hbins GROUP BY grp, area, cat, cls) c
LEFT JOIN hcent p ON c.grp = p.grp AND c.area = p.area WHERE recent_90 > 0 OR baseline > 0"""
CTES["hgrid"] = f"""
WITH g AS (SELECT cell_x, cell_y, cat, cls, {_window_sums()}, max(send) AS snapshot_day FROM hbins WHERE ok_xy AND age <= 454
           GROUP BY cell_x, cell_y, cat, cls),
d AS (SELECT cell_x, cell_y, cat, cls, grp, row_number() OVER (PARTITION BY cell_x, cell_y, cat, cls ORDER BY sum(weight) DESC, grp) AS rn
      FROM hbins WHERE ok_xy AND age <= 454 GROUP BY cell_x, cell_y, cat, cls, grp)
SELECT 'grid' AS grain, coalesce(d.grp, 'UNKNOWN') AS grp, NULL::VARCHAR AS area, g.cell_x, g.cell_y, g.cat, g.cls,
  g.cell_x AS map_x, g.cell_y AS map_y, recent_7, recent_30, recent_90, baseline, recent_30 AS valid_events, snapshot_day
FROM g LEFT JOIN d ON g.cell_x = d.cell_x AND g.cell_y = d.cell_y AND g.cat = d.cat AND g.cls = d.cls AND rn = 1
WHERE recent_90 > 0 OR baseline > 0"""
CTES["htot"] = f"""
SELECT 'area' AS grain, CAST(coalesce(sum(weight) FILTER (WHERE age < 30), 0) AS BIGINT) AS recent_total,
  CAST(coalesce(sum(weight) FILTER (WHERE age BETWEEN 90 AND 454), 0) AS BIGINT) AS baseline_total FROM hbins
UNION ALL
SELECT 'grid', CAST(coalesce(sum(weight) FILTER (WHERE age < 30), 0) AS BIGINT),
  CAST(coalesce(sum(weight) FILTER (WHERE age BETWEEN 90 AND 454), 0) AS BIGINT) FROM hbins WHERE ok_xy"""
CTES["hboth"] = "SELECT * FROM harea UNION ALL SELECT * FROM hgrid"
CTES["hscore"] = """
WITH a AS (
  SELECT b.*, t.recent_total, t.baseline_total, round(baseline * 30.0::DOUBLE / 365.0::DOUBLE, 6) AS expected, 30 AS recent_days, 365 AS baseline_days
  FROM hboth b JOIN htot t USING (grain)
), m AS (
  SELECT *, CASE WHEN recent_total > 0 THEN round(recent_30 * 100.0 / recent_total, 6) ELSE 0.0 END::DOUBLE AS recent_share,
    CASE WHEN baseline_total > 0 THEN round(baseline * 100.0 / baseline_total, 6) ELSE 0.0 END::DOUBLE AS baseline_share,
    CASE WHEN expected > 0 THEN round(recent_30 / expected, 6) END AS ratio,
    CASE WHEN expected > 0 THEN round((recent_30 / expected - 1) * 100.0, 6) END AS lift_pct,
    round(recent_7 * 0.50::DOUBLE + greatest(recent_30 - recent_7, 0) * 0.35::DOUBLE + greatest(recent_90 - recent_30, 0) * 0.15::DOUBLE, 6) AS recency_count,
    CASE WHEN recent_30 > 0 THEN round(valid_events * 100.0 / recent_30, 6) ELSE 0.0 END::DOUBLE AS coverage_pct
  FROM a
), s AS (
  SELECT *, round(recent_share - baseline_share, 6) AS share_change,
    round(100.0::DOUBLE * least(ln(1 + recent_30) / ln(11), 1), 4) AS density_score,
    round(100.0::DOUBLE * least(greatest((coalesce(ratio, 0) - 1) / 2, 0), 1), 4) AS lift_score,
    round(100.0::DOUBLE * least(greatest((CASE WHEN baseline_share > 0 THEN recent_share / baseline_share ELSE 0 END - 1) / 2, 0), 1), 4) AS share_score,
    round(100.0::DOUBLE * least(ln(1 + recency_count) / ln(11), 1), 4) AS recency_score,
    round(least(greatest(coverage_pct, 0), 100), 4) AS quality_score,
    recent_30 >= 2 AND baseline >= 2 AND expected > 0 AS passes_volume
  FROM m
), c AS (
  SELECT *, round(0.35::DOUBLE * density_score + 0.25::DOUBLE * lift_score + 0.20::DOUBLE * share_score
    + 0.15::DOUBLE * recency_score + 0.05::DOUBLE * quality_score, 4) AS score FROM s
), f AS (
  SELECT *, passes_volume AND coalesce(ratio, 0) >= 1.25 AND share_change > 0 AND score >= 20 AS is_hotspot FROM c
)
SELECT *, CASE WHEN NOT is_hotspot THEN 'none' WHEN score >= 85 AND ratio >= 3 AND recent_30 >= 4 THEN 'critical'
  WHEN score >= 65 AND ratio >= 2 AND recent_30 >= 3 THEN 'high' WHEN score >= 45 AND ratio >= 1.5 THEN 'medium' ELSE 'low' END AS severity
FROM f"""
CTES["hots"] = """
SELECT *, row_number() OVER (ORDER BY score DESC, recent_30 DESC, ratio DESC NULLS LAST, grain, grp, area, cell_y, cell_x, cat, cls) AS rank_overall,
  row_number() OVER (PARTITION BY grain ORDER BY score DESC, recent_30 DESC, ratio DESC NULLS LAST, grp, area, cell_y, cell_x, cat, cls) AS rank_in_grain
FROM hscore WHERE is_hotspot"""
CTES["canon"] = """
SELECT area, grp AS canonical_grp, canonical_events FROM (
  SELECT area, grp, CAST(sum(n) AS BIGINT) AS canonical_events, row_number() OVER (PARTITION BY area ORDER BY sum(n) DESC, grp) AS rn
  FROM weekly4 WHERE area <> 'UNKNOWN' GROUP BY area, grp) WHERE rn = 1"""
CTES["future4"] = "SELECT * FROM pred4 WHERE is_next_week"
CTES["changes4"] = """
SELECT f.week, f.grp, f.area, f.cat, f.cls, f.predicted, b.trailing_8_week_mean AS baseline,
  round(f.predicted - b.trailing_8_week_mean, 6) AS change,
  round(CASE WHEN b.trailing_8_week_mean > 0 THEN (f.predicted - b.trailing_8_week_mean) / b.trailing_8_week_mean * 100.0::DOUBLE END, 6) AS change_pct
FROM future4 f LEFT JOIN blines4 b ON f.week = b.week AND f.grp = b.grp AND f.area = b.area AND f.cat = b.cat AND f.cls = b.cls"""
CTES["tagged4"] = """
SELECT c.*, m.canonical_grp, CASE WHEN c.grp = 'UNKNOWN' OR c.area = 'UNKNOWN' OR NOT regexp_full_match(c.area, '[1-9][0-9]{0,2}')
    OR m.canonical_grp IS NULL THEN 'unmappable' WHEN c.grp <> m.canonical_grp THEN 'mismatch' END AS withheld_reason,
  CASE WHEN regexp_full_match(c.area, '[1-9][0-9]{0,2}') THEN 'area:' || c.area END AS location_key
FROM changes4 c LEFT JOIN canon m ON c.area = m.area"""
CTES["pub4"] = "SELECT * FROM tagged4 WHERE withheld_reason IS NULL"
CTES["psum4"] = """
SELECT *, round(published_rows * 100.0 / nullif(source_rows, 0), 4) AS row_coverage_pct,
  round(CASE WHEN source_total > 0 THEN predicted_total * 100.0 / source_total END, 4) AS volume_coverage_pct FROM (
SELECT count(*) AS source_rows, count(*) FILTER (WHERE withheld_reason IS NULL) AS published_rows,
  count(withheld_reason) AS withheld_rows, count(*) FILTER (WHERE withheld_reason = 'unmappable') AS withheld_unmappable,
  count(*) FILTER (WHERE withheld_reason = 'mismatch') AS withheld_mismatch, round(sum(predicted), 6) AS source_total,
  round(coalesce(sum(predicted) FILTER (WHERE withheld_reason IS NULL), 0), 6) AS predicted_total,
  round(coalesce(sum(predicted) FILTER (WHERE withheld_reason IS NOT NULL), 0), 6) AS withheld_total,
  count(*) FILTER (WHERE withheld_reason IS NULL AND predicted = 0) AS zero_rows,
  count(*) FILTER (WHERE withheld_reason IS NULL AND cat = 'UNKNOWN') AS unknown_cat_rows,
  count(DISTINCT area) FILTER (WHERE withheld_reason IS NULL) AS published_areas FROM tagged4)"""
CTES["areas4"] = """
SELECT location_key, area, grp, round(p, 6) AS predicted, round(fb, 6) AS baseline, round(p - fb, 6) AS change,
  round(CASE WHEN fb > 0 THEN (p - fb) / fb * 100.0::DOUBLE END, 4) AS change_pct, baseline_rows, total_rows,
  CASE WHEN fb IS NULL THEN 'unavailable' WHEN abs(p - fb) <= 1e-6 THEN 'approximately equal' WHEN p > fb THEN 'above' ELSE 'below' END AS direction,
  CAST(area AS INTEGER) AS area_no
FROM (SELECT location_key, area, grp, sum(predicted) AS p, CASE WHEN count(baseline) = count(*) THEN sum(baseline) END AS fb,
        count(baseline) AS baseline_rows, count(*) AS total_rows FROM pub4 GROUP BY location_key, area, grp)"""
CTES["ship"] = """
SELECT o_orderdate AS start_ts, l_shipdate AS end_ts, l_returnflag AS flag, l_linestatus AS status, o_orderpriority AS cat
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
CTES["docs"] = "SELECT d.doc_id, lang, source, n_chars, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


def _needed(text: str, found: list[str]) -> None:
    for name in CTES:
        if name in found or not re.search(rf"(?:FROM|JOIN|,)\s+{name}\b", text):
            continue
        _needed(CTES[name], found)
        if name not in found:
            found.append(name)


def with_clause(select: str) -> str:
    """Prefix a SELECT with the CTEs it uses, in dependency order."""
    found: list[str] = []
    _needed(select, found)
    if not found:
        return select
    # What several tables read is computed once, whatever the engine thinks of it.
    text = " ".join([select, *(CTES[n] for n in found)])
    once = {n: "" if len(re.findall(rf"\b{n}\b", text)) == 1 else "MATERIALIZED " for n in found}
    parts = ",\n".join(f"{n} AS {once[n]}({CTES[n]})" for n in found)
    return f"WITH {parts}\n{select}"
