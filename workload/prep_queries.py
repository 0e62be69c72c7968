"""Preparation operators: deduplication, imputation, outliers, class balance, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from millwright.operators import balance as bl
from millwright.operators import clean as cl
from millwright.operators import impute as im
from millwright.operators import outliers as ol
from millwright.schemas import RAW_SIGNALS
from workload.gold_queries import _split
from workload.registry import query, r, rounded
from workload.views import table, view, with_views

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_KEY = "l_orderkey, l_linenumber"
DOUBLES = RAW_SIGNALS[:4]


def _telemetry(spark, sf):
    return view(spark, sf, "telemetry_v")


def _lines(spark, sf):
    return table(spark, sf, "lineitem")


# ---- deduplication

COPIED = "(SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_linenumber <= 2)"


@query(f"SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, {', '.join(r(c) for c in LINE)} FROM {COPIED}")
def dedup_exact_rows(spark, sf):
    lines = _lines(spark, sf)
    rows = cl.dedup_rows(lines.unionByName(lines.filter("l_linenumber <= 2")))
    return rounded(rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", *LINE))


@query(f"SELECT l_orderkey, l_linenumber, {r('l_quantity')} FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem) WHERE k = 1")
def dedup_business_key(spark, sf):
    rows = _lines(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    first = cl.dedup_key(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"])
    return rounded(first.select("l_orderkey", "l_linenumber", "l_quantity"))


@query(with_views(f"SELECT upper(trim(machine_id)) AS machine_id_std, timestamp, {', '.join(r(f'avg({c})', c) for c in RAW_SIGNALS)} FROM telemetry_v GROUP BY 1, 2", "telemetry_v"))
def dedup_mean_per_key(spark, sf):
    rows = _telemetry(spark, sf).withColumn("machine_id_std", F.upper(F.trim("machine_id")))
    return rounded(cl.dedup_mean(rows, ["machine_id_std", "timestamp"], RAW_SIGNALS))


NEAR_SQL = """SELECT incident_id, previous_id, CAST(round((epoch_us(incident_at) - epoch_us(previous_at)) / 1000000.0E0, 3) AS DOUBLE) + 0.0E0 AS gap_seconds FROM (
SELECT *, lag(incident_id) OVER w AS previous_id, lag(incident_at) OVER w AS previous_at FROM incidents_v
WINDOW w AS (PARTITION BY machine_id_std ORDER BY incident_at, incident_id)) WHERE epoch_us(incident_at) - epoch_us(previous_at) <= 3600000000"""


@query(with_views(NEAR_SQL, "incidents_v"))
def near_duplicates_in_time(spark, sf):
    from millwright.operators.near import near_in_time

    found = near_in_time(view(spark, sf, "incidents_v"), ["machine_id_std"], "incident_at", "incident_id", 3600)
    return found.select("incident_id", "previous_id", (F.round("gap_seconds", 3) + 0.0).alias("gap_seconds"))


# ---- imputation

@query(with_views("SELECT row_seq FROM telemetry_v WHERE CASE WHEN temperature_c IS NULL THEN 0 ELSE 1 END + CASE WHEN voltage_mean_v IS NULL THEN 0 ELSE 1 END + 3 >= 5", "telemetry_v"))
def drop_sparse_rows(spark, sf):
    return im.drop_sparse_rows(_telemetry(spark, sf), 5, RAW_SIGNALS).select("row_seq")


@query(with_views("SELECT incident_id, coalesce(comment, 'unknown') AS comment FROM incidents_v", "incidents_v"))
def impute_constant(spark, sf):
    return im.fill_constants(view(spark, sf, "incidents_v").select("incident_id", "comment"), {"comment": "unknown"})


@query(with_views("SELECT incident_id, CASE WHEN coalesce(comment, '') ILIKE '%ENT 2%' THEN 1 ELSE type_vibration END AS type_vibration FROM incidents_v", "incidents_v"))
def impute_rule_from_comment(spark, sf):
    rows = im.flag_from_comment(view(spark, sf, "incidents_v"), {"ENT 2": "type_vibration"})
    return rows.select("incident_id", "type_vibration")


def _statistic_sql(fn, train="row_seq % 3 <> 0"):
    fits = ", ".join(f"{fn.format(c)} AS {c}" for c in DOUBLES)
    cells = ", ".join(f"{r(f'coalesce(t.{c}, f.{c})', c)}, t.{c} IS NULL AS {c}_was_imputed" for c in DOUBLES)
    return with_views(f", f AS MATERIALIZED (SELECT {fits} FROM telemetry_v WHERE {train}) SELECT row_seq, {cells} FROM telemetry_v t, f", "telemetry_v")


@query(_statistic_sql("avg({})"))
def impute_train_mean(spark, sf):
    done = im.impute_statistic(_telemetry(spark, sf), DOUBLES, "mean", F.col("row_seq") % 3 != 0, mark=True)
    return rounded(done.select("row_seq", *DOUBLES, *[f"{c}_was_imputed" for c in DOUBLES]))


@query(_statistic_sql("quantile_cont({}, 0.5)"))
def impute_train_median(spark, sf):
    done = im.impute_statistic(_telemetry(spark, sf), DOUBLES, "median", F.col("row_seq") % 3 != 0, mark=True)
    return rounded(done.select("row_seq", *DOUBLES, *[f"{c}_was_imputed" for c in DOUBLES]))


@query(_statistic_sql("quantile_cont({}, 0.5)", "true"))
def impute_median(spark, sf):
    done = im.impute_statistic(_telemetry(spark, sf), DOUBLES, "median", mark=True)
    return rounded(done.select("row_seq", *DOUBLES, *[f"{c}_was_imputed" for c in DOUBLES]))


COMPARED = ["temp_mean_1h", "voltage_mean_1h"]
MASKED = "substr(md5(concat(machine_id_std, ':', CAST(h AS VARCHAR))), 1, 1) IN ('0', '1')"
WIN = "(PARTITION BY machine_id_std ORDER BY window_start ROWS BETWEEN"


def _error_sql(c):
    lv, nv = f"last_value({c} IGNORE NULLS) OVER {WIN} UNBOUNDED PRECEDING AND CURRENT ROW)", f"first_value({c} IGNORE NULLS) OVER {WIN} CURRENT ROW AND UNBOUNDED FOLLOWING)"
    at = f"CASE WHEN {c} IS NOT NULL THEN h END"
    lh, nh = f"last_value({at} IGNORE NULLS) OVER {WIN} UNBOUNDED PRECEDING AND CURRENT ROW)", f"first_value({at} IGNORE NULLS) OVER {WIN} CURRENT ROW AND UNBOUNDED FOLLOWING)"
    value = f"coalesce({lv} + ({nv} - {lv}) / ({nh} - {lh}) * (h - {lh}), {lv}, {nv}, (SELECT quantile_cont({c}, 0.5) FROM masked WHERE split_set = 'train'))"
    median = f"(SELECT quantile_cont({c}, 0.5) FROM masked WHERE split_set = 'train')"
    return (f"SELECT '{c}' AS signal, 'interpolation' AS strategy, {r('avg(abs(v - t))', 'mean_abs_error')}, count(t) AS n_masked FROM (SELECT {value} AS v, true_{c} AS t FROM masked) WHERE t IS NOT NULL "
            f"UNION ALL SELECT '{c}', 'median', {r(f'avg(abs({median} - true_{c}))', 'mean_abs_error')}, count(true_{c}) FROM masked")


_ONE, _TWO = COMPARED
_FIT = """, f{k} AS MATERIALIZED (SELECT regr_slope(y, b) FILTER (y IS NOT NULL) AS ys, regr_intercept(y, b) FILTER (y IS NOT NULL) AS yi,
 regr_slope(z, a) FILTER (z IS NOT NULL) AS zs, regr_intercept(z, a) FILTER (z IS NOT NULL) AS zi FROM g{j} WHERE split_set = 'train'),
g{k} AS MATERIALIZED (SELECT split_set, y, z, ty, tz, coalesce(y, yi + ys * b) AS a, coalesce(z, zi + zs * a) AS b FROM g{j}, f{k})"""
COMPARISON = f""", masked AS MATERIALIZED (SELECT machine_id_std, window_start, h, split_set,
 {', '.join(f"CASE WHEN NOT ({MASKED} AND split_set = 'train') THEN {c} END AS {c}, CASE WHEN {MASKED} AND split_set = 'train' THEN {c} END AS true_{c}" for c in COMPARED)} FROM split),
mid AS MATERIALIZED (SELECT quantile_cont({_ONE}, 0.5) AS m1, quantile_cont({_TWO}, 0.5) AS m2 FROM masked WHERE split_set = 'train'),
g0 AS MATERIALIZED (SELECT split_set, {_ONE} AS y, {_TWO} AS z, true_{_ONE} AS ty, true_{_TWO} AS tz, coalesce({_ONE}, m1) AS a, coalesce({_TWO}, m2) AS b FROM masked, mid)
{_FIT.format(j=0, k=1)}{_FIT.format(j=1, k=2)}, compared AS MATERIALIZED (
{' UNION ALL '.join(_error_sql(c) for c in COMPARED)}
UNION ALL SELECT '{_ONE}', 'regression', {r('avg(abs(a - ty))', 'mean_abs_error')}, count(ty) FROM g2
UNION ALL SELECT '{_TWO}', 'regression', {r('avg(abs(b - tz))', 'mean_abs_error')}, count(tz) FROM g2)
"""


def _comparison(spark, sf):
    from millwright.functions.columns import epoch_hour

    code = F.md5(F.concat("machine_id_std", F.lit(":"), epoch_hour(F.col("window_start")).cast("string")))
    grid = _split(spark, sf).select("machine_id_std", "window_start", "split_set", *COMPARED)
    return im.compare_strategies(grid, COMPARED, F.substring(code, 1, 1).isin("0", "1"))


@query(with_views(COMPARISON + "SELECT * FROM compared", "split"))
def imputation_comparison(spark, sf):
    return rounded(_comparison(spark, sf))


@query(with_views(COMPARISON + "SELECT signal, arg_min(strategy, (mean_abs_error, strategy)) AS strategy, min(mean_abs_error) AS mean_abs_error FROM compared GROUP BY signal", "split"))
def imputation_best_strategy(spark, sf):
    return im.best_strategy(rounded(_comparison(spark, sf)))


def _between_sql(c, median):
    """A gap's straight line, the nearest value at the ends, the median where a machine has none."""
    at = f"CASE WHEN {c} IS NOT NULL THEN h END"
    (lv, nv), (lh, nh) = ((f"last_value({x} IGNORE NULLS) OVER {WIN} UNBOUNDED PRECEDING AND CURRENT ROW)",
                           f"first_value({x} IGNORE NULLS) OVER {WIN} CURRENT ROW AND UNBOUNDED FOLLOWING)") for x in (c, at))
    return f"coalesce({c}, {lv} + ({nv} - {lv}) / ({nh} - {lh}) * (h - {lh}), {lv}, {nv}, {median})"


CHOSEN = {"temp_mean_1h": "interpolation", "voltage_mean_1h": "median"}
_MEDIAN_OF = "(SELECT quantile_cont({0}, 0.5) FROM split WHERE split_set = 'train')"


@query(with_views("SELECT machine_id_std, window_start, split_set, " + r(_between_sql(_ONE, _MEDIAN_OF.format(_ONE)), _ONE) + ", "
                  + r(f"coalesce({_TWO}, {_MEDIAN_OF.format(_TWO)})", _TWO) + " FROM split", "split"))
def impute_by_chosen_strategy(spark, sf):
    """Each signal filled by the strategy chosen for it."""
    grid = _split(spark, sf).select("machine_id_std", "window_start", "split_set", *CHOSEN)
    return rounded(im.impute_by_strategy(grid, CHOSEN))


# ---- outliers

Z_SQL = ", ".join(
    f"{r(f'({c} - avg({c}) OVER ()) / nullif(stddev_samp({c}) OVER (), 0)', f'{c}_z')}, coalesce(abs(({c} - avg({c}) OVER ()) / nullif(stddev_samp({c}) OVER (), 0)) > 3, false) AS {c}_is_outlier"
    for c in LINE)


@query(f"SELECT {LINE_KEY}, {Z_SQL} FROM lineitem")
def outlier_zscore(spark, sf):
    done = ol.flag_zscore(_lines(spark, sf), LINE)
    return rounded(done.select("l_orderkey", "l_linenumber", *[n for c in LINE for n in (f"{c}_z", f"{c}_is_outlier")]))


TEMP_FLAGS = ", ".join(f"coalesce(abs(({c} - avg({c}) OVER ()) / nullif(stddev_samp({c}) OVER (), 0)) > 1.5, false) AS {c}_is_outlier" for c in DOUBLES)
FLAGS = [f"{c}_is_outlier" for c in DOUBLES]


@query(with_views(f", z AS MATERIALIZED (SELECT machine_id, {TEMP_FLAGS} FROM telemetry_v) " + " UNION ALL ".join(
    f"SELECT '{f}' AS flag, count(*) FILTER ({f}) AS outliers, {r(f'count(*) FILTER ({f}) / count(*)', 'share')} FROM z" for f in FLAGS), "telemetry_v"))
def outlier_summary(spark, sf):
    return rounded(ol.outlier_summary(ol.flag_zscore(_telemetry(spark, sf), DOUBLES, 1.5), FLAGS))


@query(with_views(f", z AS MATERIALIZED (SELECT machine_id, {TEMP_FLAGS} FROM telemetry_v) SELECT machine_id, "
                  + ", ".join(f"count(*) FILTER ({f}) AS {f}" for f in FLAGS) + " FROM z GROUP BY 1", "telemetry_v"))
def outliers_per_machine(spark, sf):
    return ol.outliers_per_group(ol.flag_zscore(_telemetry(spark, sf), DOUBLES, 1.5), FLAGS, ["machine_id"])


def _fence(c, part=""):
    q1, q3 = f"quantile_cont({c}, 0.25)", f"quantile_cont({c}, 0.75)"
    return r(f"{q1} - 1.5E0 * ({q3} - {q1})", f"{c}_low") + ", " + r(f"{q3} + 1.5E0 * ({q3} - {q1})", f"{c}_high")


@query("SELECT " + ", ".join(_fence(c) for c in LINE) + " FROM lineitem")
def iqr_fences(spark, sf):
    return rounded(ol.iqr_fences(_lines(spark, sf), LINE))


@query("SELECT l_returnflag, " + ", ".join(_fence(c) for c in LINE) + " FROM lineitem GROUP BY 1")
def iqr_fences_per_group(spark, sf):
    return rounded(ol.iqr_fences(_lines(spark, sf), LINE, ["l_returnflag"]))


@query(f""", f AS MATERIALIZED (SELECT {', '.join(f'quantile_cont({c}, 0.25) - 1.5E0 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS {c}_lo, quantile_cont({c}, 0.75) + 1.5E0 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) AS {c}_hi' for c in LINE)} FROM lineitem)
SELECT {LINE_KEY}, {', '.join(f'{c} < {c}_lo OR {c} > {c}_hi AS {c}_is_iqr_outlier' for c in LINE)} FROM lineitem, f""".replace(", f AS", "WITH f AS", 1))
def outlier_iqr(spark, sf):
    done = ol.flag_iqr(_lines(spark, sf), LINE)
    return done.select("l_orderkey", "l_linenumber", *[f"{c}_is_iqr_outlier" for c in LINE])


ROBUST_SQL = f"""WITH m AS MATERIALIZED (SELECT {', '.join(f'quantile_cont({c}, 0.5) AS {c}_m' for c in LINE)} FROM lineitem),
d AS MATERIALIZED (SELECT {', '.join(f'quantile_cont(abs({c} - {c}_m), 0.5) AS {c}_d' for c in LINE)} FROM lineitem, m)
SELECT {LINE_KEY}, {', '.join(r(f'0.6745E0 * ({c} - {c}_m) / nullif({c}_d, 0)', f'{c}_robust_z') + f', coalesce(abs(0.6745E0 * ({c} - {c}_m) / nullif({c}_d, 0)) > 3.5, false) AS {c}_is_robust_outlier, {c}_d = 0 AS {c}_mad_is_zero' for c in LINE)} FROM lineitem, m, d"""


@query(ROBUST_SQL)
def outlier_robust_z(spark, sf):
    done = ol.flag_robust_z(_lines(spark, sf), LINE)
    names = [f"{c}_{n}" for c in LINE for n in ("robust_z", "is_robust_outlier", "mad_is_zero")]
    return rounded(done.select("l_orderkey", "l_linenumber", *names))


@query("""WITH s AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS d, quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders),
f AS (SELECT o_orderkey, abs((o_totalprice - m) / d) > 1.5 AS z, o_totalprice < a - 0.2E0 * (b - a) OR o_totalprice > b + 0.2E0 * (b - a) AS q FROM orders, s)
SELECT o_orderkey, CASE WHEN z AND q THEN 'high' ELSE 'review' END AS priority FROM f WHERE z OR q""")
def outlier_method_comparison(spark, sf):
    rows = ol.flag_zscore(table(spark, sf, "orders"), ["o_totalprice"], 1.5)
    rows = ol.flag_iqr(rows, ["o_totalprice"], k=0.2)
    return ol.compare_methods(rows, "o_totalprice_is_outlier", "o_totalprice_is_iqr_outlier").select("o_orderkey", "priority")


STAT_SQL = "count({c}) AS n, count(*) FILTER ({c} IS NULL) AS nulls, " + ", ".join(
    r(f"{fn}({{c}})", n) for fn, n in (("avg", "mean"), ("stddev_samp", "std"), ("min", "min"), ("max", "max")))
CELSIUS = "CASE WHEN temperature_c > 80 THEN (temperature_c - 32.0E0) * 5.0E0 / 9.0E0 ELSE temperature_c END"


@query(with_views(f", a AS (SELECT {CELSIUS} AS t FROM telemetry_v) SELECT 'temperature_c' AS \"column\", {STAT_SQL.format(c='temperature_c')}, 'before' AS stage FROM telemetry_v "
                  f"UNION ALL SELECT 'temperature_c', {STAT_SQL.format(c='t')}, 'after' FROM a", "telemetry_v"))
def correction_before_after(spark, sf):
    from millwright.functions.columns import celsius

    raw = _telemetry(spark, sf)
    return rounded(ol.before_after(raw, raw.withColumn("temperature_c", celsius(F.col("temperature_c"))), ["temperature_c"]))


@query(with_views(f"SELECT row_seq, {r('temperature_c', 'old_value')}, {r(CELSIUS, 'new_value')} FROM telemetry_v WHERE temperature_c > 80", "telemetry_v"))
def correction_log(spark, sf):
    from millwright.functions.columns import celsius

    raw = _telemetry(spark, sf)
    fixed = ol.correct(raw, "temperature_c", celsius(F.col("temperature_c")))
    return rounded(ol.correction_log(fixed, ["row_seq"], "temperature_c"))


# ---- class balance

def _labelled(spark, sf):
    return table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")


LABELLED = "lab AS MATERIALIZED (SELECT l.*, d.n_chars FROM labels l JOIN documents d USING (doc_id))"
RANKED = (LABELLED + ", rk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY md5(concat('42:', CAST(doc_id AS VARCHAR))), doc_id) AS k, "
          "count(*) OVER (PARTITION BY toxic) AS n FROM lab)")


@query(f"WITH {LABELLED} SELECT toxic, count(*) AS n, {r('count(*) / (SELECT count(*) FROM lab)', 'share')} FROM lab GROUP BY 1")
def class_counts(spark, sf):
    return rounded(bl.class_counts(_labelled(spark, sf), "toxic"))


@query(f"WITH {LABELLED} SELECT doc_id, toxic, {r('(SELECT count(*) FROM lab) / ((SELECT count(DISTINCT toxic) FROM lab) * CAST(count(*) OVER (PARTITION BY toxic) AS DOUBLE))', 'weight')} FROM lab")
def class_weights(spark, sf):
    return rounded(bl.with_class_weight(_labelled(spark, sf), "toxic").select("doc_id", "toxic", "weight"))


@query(f"WITH {RANKED} SELECT doc_id, toxic, quality, n_chars FROM rk WHERE k <= (SELECT min(n) FROM rk)")
def downsample_majority(spark, sf):
    return bl.downsample(_labelled(spark, sf), "toxic", "doc_id").select("doc_id", "toxic", "quality", "n_chars")


@query(f"WITH {RANKED} SELECT doc_id, toxic, CAST(unnest(generate_series(0, m // n + CASE WHEN k <= m % n THEN 1 ELSE 0 END - 1)) AS BIGINT) AS copy FROM rk, (SELECT max(n) AS m FROM rk)")
def oversample_minority(spark, sf):
    return bl.oversample(_labelled(spark, sf), "toxic", "doc_id").select("doc_id", "toxic", "copy")


@query(f"WITH {RANKED} SELECT doc_id, toxic, CASE WHEN k <= floor(n * 0.2E0 + 0.5E0) THEN 'test' ELSE 'train' END AS part FROM rk")
def stratified_split(spark, sf):
    return bl.stratified_split(_labelled(spark, sf), "toxic", "doc_id").select("doc_id", "toxic", "part")


@query(f"WITH {RANKED} SELECT doc_id, toxic, quality, n_chars FROM rk WHERE toxic = 1 OR k <= (SELECT min(n) FROM rk)")
def concat_balanced_classes(spark, sf):
    rows = _labelled(spark, sf)
    fewer = bl.downsample(rows, "toxic", "doc_id").filter("toxic = 0")
    return bl.concat_classes([fewer, rows.filter("toxic = 1")]).select("doc_id", "toxic", "quality", "n_chars")


CONFUSION = """WITH c AS (SELECT count(*) FILTER (toxic = 1 AND quality = 0) AS tp, count(*) FILTER (toxic <> 1 AND quality = 0) AS fp,
 count(*) FILTER (toxic = 1 AND quality <> 0) AS fn, count(*) FILTER (toxic <> 1 AND quality <> 0) AS tn FROM labels) """


@query(CONFUSION + f"SELECT tp, fp, fn, tn, {r('(tp + tn) / (tp + fp + fn + tn)', 'accuracy')}, {r('tp / (tp + fp)', 'precision')}, {r('tp / (tp + fn)', 'recall')}, {r('2 * tp / (2 * tp + fp + fn)', 'f1')} FROM c")
def confusion_metrics(spark, sf):
    rows = table(spark, sf, "labels").withColumn("predicted", (F.col("quality") == 0).cast("int"))
    return rounded(bl.confusion_metrics(rows, "toxic", "predicted"))


@query(f"""WITH {LABELLED}, s AS (SELECT n_chars AS x, count(*) FILTER (toxic = 1) AS p, count(*) FILTER (toxic <> 1) AS n FROM lab GROUP BY 1),
c AS (SELECT p, n, sum(p) OVER (ORDER BY x DESC) AS tp, sum(n) OVER (ORDER BY x DESC) AS fp FROM s)
SELECT {r('sum(n * (tp - p / 2.0E0)) / (CAST(sum(p) AS DOUBLE) * sum(n))', 'roc_auc')}, {r('sum(p * tp / (tp + fp)) / sum(p)', 'average_precision')} FROM c""")
def ranking_metrics(spark, sf):
    return rounded(bl.ranking_metrics(_labelled(spark, sf), "toxic", "n_chars"))


REGRESSION = """, m AS MATERIALIZED (SELECT quantile_cont(voltage_mean_v, 0.5) AS v, quantile_cont(temperature_c, 0.5) AS t FROM telemetry_v),
r0 AS MATERIALIZED (SELECT row_seq, temperature_c AS y, voltage_mean_v AS z, coalesce(temperature_c, t) AS a, coalesce(voltage_mean_v, v) AS b FROM telemetry_v, m),"""
ROUND = """
f{k} AS MATERIALIZED (SELECT regr_slope(y, b) FILTER (y IS NOT NULL) AS ys, regr_intercept(y, b) FILTER (y IS NOT NULL) AS yi,
 regr_slope(z, a) FILTER (z IS NOT NULL) AS zs, regr_intercept(z, a) FILTER (z IS NOT NULL) AS zi FROM r{j}),
r{k} AS MATERIALIZED (SELECT row_seq, y, z, coalesce(y, yi + ys * b) AS a, coalesce(z, zi + zs * a) AS b FROM r{j}, f{k})"""
REGRESSION += ROUND.format(j=0, k=1) + "," + ROUND.format(j=1, k=2)
REGRESSION += f" SELECT row_seq, {r('a', 'temperature_c')}, {r('b', 'voltage_mean_v')} FROM r2"


@query(with_views(REGRESSION, "telemetry_v"))
def impute_regression(spark, sf):
    done = im.impute_regression(_telemetry(spark, sf), ["temperature_c", "voltage_mean_v"], rounds=2)
    return rounded(done.select("row_seq", "temperature_c", "voltage_mean_v"))


@query(with_views("""SELECT incident_id, previous_id, levenshtein(comment, previous_text) AS text_distance FROM (
SELECT *, lag(incident_id) OVER w AS previous_id, lag(incident_at) OVER w AS previous_at, lag(comment) OVER w AS previous_text FROM incidents_v
WINDOW w AS (PARTITION BY machine_id_std ORDER BY incident_at, incident_id)) WHERE epoch_us(incident_at) - epoch_us(previous_at) <= 86400000000""", "incidents_v"))
def near_duplicates_by_text(spark, sf):
    from millwright.operators.near import near_in_time

    found = near_in_time(view(spark, sf, "incidents_v"), ["machine_id_std"], "incident_at", "incident_id", 86_400, "comment")
    return found.select("incident_id", "previous_id", F.col("text_distance").cast("long").alias("text_distance"))


def _knn_sql(target):
    others = [c for c in DOUBLES if c != target]
    fits = ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in others)
    scaled = ", ".join(f"coalesce({c}, m_{c}) / s_{c} AS z_{c}" for c in others)
    distance = " + ".join(f"(q.z_{c} - d.z_{c}) * (q.z_{c} - d.z_{c})" for c in others)
    return (f"SELECT row_seq, avg({target}) AS guess FROM (SELECT q.row_seq, d.{target}, row_number() OVER (PARTITION BY q.row_seq ORDER BY round({distance}, 9), d.row_seq) AS k "
            f"FROM (SELECT row_seq, {scaled} FROM telemetry_v, (SELECT {fits} FROM telemetry_v WHERE row_seq % 3 <> 0) WHERE {target} IS NULL) q, "
            f"(SELECT row_seq, {target}, {scaled} FROM telemetry_v, (SELECT {fits} FROM telemetry_v WHERE row_seq % 3 <> 0) WHERE {target} IS NOT NULL AND row_seq % 3 <> 0) d) WHERE k <= 5 GROUP BY 1")


KNN_FILLED = ["temperature_c", "voltage_mean_v"]


@query(with_views(f", {', '.join(f'g_{c} AS ({_knn_sql(c)})' for c in KNN_FILLED)} SELECT t.row_seq, {', '.join(r(f'coalesce(t.{c}, g_{c}.guess)', c) for c in KNN_FILLED)} "
                  f"FROM telemetry_v t {' '.join(f'LEFT JOIN g_{c} ON g_{c}.row_seq = t.row_seq' for c in KNN_FILLED)}", "telemetry_v"))
def impute_knn(spark, sf):
    done = im.impute_knn(_telemetry(spark, sf), KNN_FILLED, "row_seq", 5, F.col("row_seq") % 3 != 0, features=DOUBLES)
    return rounded(done.select("row_seq", *KNN_FILLED))


def _hex(text, first, digits):
    return f"CAST('0x' || substr(md5({text}), {first}, {digits}) AS BIGINT)"


@query(f"WITH {RANKED}, sizes AS (SELECT toxic, max(n) AS n, (SELECT max(n) FROM rk) AS m FROM rk GROUP BY 1), "
       f"draws AS (SELECT toxic, n, unnest(range(m)) AS draw FROM sizes WHERE n < m) "
       f"SELECT doc_id, rk.toxic, draw FROM draws d JOIN rk ON rk.toxic = d.toxic AND rk.k = {_hex("concat('42:', d.toxic, ':', draw)", 1, 15)} % d.n + 1 "
       f"UNION ALL SELECT doc_id, toxic, NULL FROM rk WHERE n = (SELECT max(n) FROM rk)")
def oversample_with_replacement(spark, sf):
    return bl.oversample_with_replacement(_labelled(spark, sf), "toxic", "doc_id").select("doc_id", "toxic", "draw")


SMOTE_SQL = f"""WITH {LABELLED.replace("JOIN documents d USING (doc_id)", "JOIN documents d USING (doc_id) WHERE doc_id % 5 <> 0")},
rk AS (SELECT *, row_number() OVER (PARTITION BY toxic ORDER BY md5(concat('42:', CAST(doc_id AS VARCHAR))), doc_id) AS k, count(*) OVER (PARTITION BY toxic) AS n FROM lab),
todo AS (SELECT *, (m - n) // n + CASE WHEN k <= (m - n) % n THEN 1 ELSE 0 END AS copies FROM rk, (SELECT max(n) AS m FROM rk) WHERE n < m),
near AS (SELECT a.doc_id, b.doc_id AS other, b.n_chars AS nc, b.quality AS nq,
  row_number() OVER (PARTITION BY a.doc_id ORDER BY round(CAST((a.n_chars - b.n_chars) * (a.n_chars - b.n_chars) + (a.quality - b.quality) * (a.quality - b.quality) AS DOUBLE), 9), b.doc_id) AS p
  FROM rk a JOIN rk b ON a.toxic = b.toxic AND a.doc_id <> b.doc_id WHERE a.n < (SELECT max(n) FROM rk)),
made AS (SELECT t.*, unnest(range(copies)) AS copy FROM todo t),
drawn AS (SELECT *, {_hex("concat('42:', doc_id, ':', copy)", 1, 8)} % least(5, n - 1) + 1 AS p, {_hex("concat('42:', doc_id, ':', copy)", 9, 8)} / 4294967296.0E0 AS u FROM made)
SELECT toxic, d.doc_id, other AS neighbour, copy, {r('n_chars + u * (nc - n_chars)', 'n_chars')}, {r('quality + u * (nq - quality)', 'quality')}
FROM drawn d JOIN near USING (doc_id, p)"""


@query(SMOTE_SQL)
def smote_minority(spark, sf):
    train = _labelled(spark, sf).where("doc_id % 5 <> 0").withColumn("part", F.lit("train"))
    return rounded(bl.smote(train, "toxic", "doc_id", ["n_chars", "quality"], split="part"))


NEAR_TEXT_SQL = """, texts AS (SELECT machine_id_std, lower(comment) AS text, min(incident_id) AS id FROM incidents_v WHERE comment IS NOT NULL AND machine_id_std IS NOT NULL GROUP BY 1, 2),
grams AS (SELECT *, list_distinct(list_transform(range(1, greatest(length(text) - 2, 1) + 1), lambda i: substr(text, i, 3))) AS g FROM texts)
SELECT a.machine_id_std, a.id AS representative, b.id AS other, """ + r(
    "len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)))", "similarity") + """
FROM grams a JOIN grams b ON a.machine_id_std = b.machine_id_std AND a.id < b.id
WHERE len(list_intersect(a.g, b.g)) >= 0.8 * (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)))"""


@query(with_views(NEAR_TEXT_SQL, "incidents_v"))
def near_duplicates_by_shingles(spark, sf):
    from millwright.operators.near import near_in_text

    return rounded(near_in_text(view(spark, sf, "incidents_v"), ["machine_id_std"], "incident_id", "comment"))


@query(with_views("SELECT i.incident_id, m.representative FROM incidents_v i JOIN (SELECT machine_id_std, lower(comment) AS text, min(incident_id) AS representative FROM incidents_v "
                  "WHERE comment IS NOT NULL GROUP BY 1, 2) m ON m.machine_id_std = i.machine_id_std AND m.text = lower(i.comment)", "incidents_v"))
def comment_classes(spark, sf):
    from millwright.operators.near import text_classes

    return text_classes(view(spark, sf, "incidents_v"), ["machine_id_std"], "incident_id", "comment").select("incident_id", "representative")
