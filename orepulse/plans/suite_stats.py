"""Statistics, rankings, series, outliers, trends and thresholds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orepulse.operators import insights, stats
from orepulse.plans.suite import Suite, half_up
from orepulse.sources.tables import fleet_sql, fleet_view, table

suite = Suite()


def _describe_sql(source: str, columns: list[str]) -> str:
    parts = [
        f"SELECT '{c}' AS \"column\", COUNT({c}) AS count, ROUND(AVG({c}), 3) AS mean, ROUND(STDDEV_SAMP({c}), 3) AS std, "
        f"ROUND(MIN({c}), 3) AS min, ROUND(QUANTILE_CONT({c}, 0.25), 3) AS p25, ROUND(QUANTILE_CONT({c}, 0.5), 3) AS p50, "
        f"ROUND(QUANTILE_CONT({c}, 0.75), 3) AS p75, ROUND(MAX({c}), 3) AS max, ROUND(SKEWNESS({c}), 3) AS skewness, "
        f"ROUND(KURTOSIS({c}), 3) AS kurtosis FROM {source}"
        for c in columns
    ]
    return " UNION ALL ".join(parts)


_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
suite.add(
    "stats_describe_lineitem",
    lambda spark, sf: stats.describe_columns(table(spark, sf, "lineitem"), _LINE),
    _describe_sql("lineitem", _LINE),
)
suite.add(
    "stats_describe_lineitem_bracketed",
    lambda spark, sf: stats.describe_columns(table(spark, sf, "lineitem"), _LINE, bounded_rows=0),
    _describe_sql("lineitem", _LINE),
)
suite.add(
    "stats_describe_events",
    lambda spark, sf: stats.describe_columns(table(spark, sf, "events"), ["value"]),
    _describe_sql("events", ["value"]),
)


def _corr_sql(columns: list[str]) -> str:
    holes = "(SELECT * REPLACE (CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_tax END AS l_tax) FROM lineitem)"
    parts = []
    for a in columns:
        for b in columns:
            r = "1.0" if a == b else f"ROUND(CORR({a}, {b}), 3)"
            parts.append(f"SELECT '{a}' AS left_column, '{b}' AS right_column, CAST({r} AS DOUBLE) AS r FROM {holes}" + (" LIMIT 1" if a == b else ""))
    return " UNION ALL ".join(f"({p})" for p in parts)


def _with_holes(spark, sf):
    return table(spark, sf, "lineitem").withColumn("l_tax", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_tax")))


suite.add(
    "stats_correlation_lineitem", lambda spark, sf: stats.correlation_matrix(_with_holes(spark, sf), _LINE), _corr_sql(_LINE)
)


def _exact(how: str, c: str) -> str:
    if how in ("mean", "sum"):
        return f"CAST({'AVG' if how == 'mean' else 'SUM'}(CAST({c} AS DECIMAL(18,4))) AS DOUBLE)"
    return f"CAST({how.upper()}({c}) AS DOUBLE)"


for _how in ("mean", "sum", "max", "min", "count"):
    for _asc in (False, True):
        _dir = "ASC" if _asc else "DESC"
        suite.add(
            f"rank_suppliers_{_how}{'_ascending' if _asc else ''}",
            lambda spark, sf, h=_how, a=_asc: stats.rank_entities(
                table(spark, sf, "lineitem"), "l_extendedprice", "l_suppkey", agg=h, ascending=a
            ),
            f"WITH m AS (SELECT CAST(l_suppkey AS VARCHAR) AS entity, ROUND({_exact(_how, 'l_extendedprice')}, 3) AS value "
            "FROM lineitem GROUP BY l_suppkey) "
            f"SELECT ROW_NUMBER() OVER (ORDER BY value {_dir}, entity) AS rank, entity, value FROM m ORDER BY value {_dir}, entity LIMIT 10",
        )

suite.add(
    "performance_summary_suppliers",
    lambda spark, sf: stats.fleet_performance_summary(table(spark, sf, "lineitem"), "l_quantity", "l_suppkey"),
    f"WITH m AS (SELECT CAST(l_suppkey AS VARCHAR) AS entity, ROUND({_exact('mean', 'l_quantity')}, 3) AS value FROM lineitem "
    "GROUP BY l_suppkey), r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY value DESC, entity) AS t, "
    "ROW_NUMBER() OVER (ORDER BY value, entity) AS b, ROUND(AVG(value) OVER (), 3) AS fleet_average, "
    "ROUND(STDDEV_SAMP(value) OVER (), 3) AS fleet_std FROM m) "
    "SELECT 'top' AS side, t AS position, entity, value, fleet_average, fleet_std FROM r WHERE t <= 5 UNION ALL "
    "SELECT 'bottom', b, entity, value, fleet_average, fleet_std FROM r WHERE b <= 5",
)

_TRUNC = {"D": ("day", "1 day"), "W": ("week", "7 days"), "ME": ("month", "1 month"), "QE": ("quarter", "3 months")}
_LABEL = {
    "D": "CAST(s AS DATE)",
    "W": "CAST(s + INTERVAL 6 DAY AS DATE)",
    "ME": "CAST(s + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE)",
    "QE": "CAST(s + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE)",
}


def series_sql(source: str, date: str, value: str, freq: str, how: str, group: str | None = None) -> str:
    unit, step = _TRUNC[freq]
    key, on = (f"CAST({group} AS VARCHAR) AS group_value, ", "p.group_value = a.group_value AND ") if group else ("", "")
    keys = "group_value, " if group else ""
    by = "GROUP BY group_value" if group else ""
    value_out = f"COALESCE(a.v, 0.0)" if how in ("sum", "count") else "a.v"
    return (
        f"WITH a AS (SELECT {key}CAST(DATE_TRUNC('{unit}', {date}) AS DATE) AS s, {half_up(_exact(how, value))} AS v FROM {source} "
        f"WHERE {date} IS NOT NULL GROUP BY ALL), "
        f"p AS (SELECT {keys}CAST(UNNEST(GENERATE_SERIES(MIN(s), MAX(s), INTERVAL {step})) AS DATE) AS s FROM a {by}) "
        f"SELECT {'p.group_value, ' if group else ''}{_LABEL[freq].replace('s ', 'p.s ').replace('(s', '(p.s')} AS period_end, "
        f"{value_out} AS {value} FROM p LEFT JOIN a ON {on}p.s = a.s"
    )


for _freq, _name in (("D", "daily"), ("W", "weekly"), ("ME", "monthly"), ("QE", "quarterly")):
    for _how in ("mean", "sum"):
        suite.add(
            f"ts_{_name}_orders_{_how}",
            lambda spark, sf, f=_freq, h=_how: stats.time_series(
                table(spark, sf, "orders"), "o_orderdate", ["o_totalprice"], freq=f, agg=h
            ),
            series_sql("orders", "o_orderdate", "o_totalprice", _freq, _how),
        )
suite.add(
    "ts_daily_events_by_user",
    lambda spark, sf: stats.time_series(table(spark, sf, "events"), "ts", ["value"], freq="D", agg="sum", group_by="user_id"),
    series_sql("events", "ts", "value", "D", "sum", "user_id"),
)
suite.add(
    "ts_weekly_events_by_type",
    lambda spark, sf: stats.time_series(table(spark, sf, "events"), "ts", ["value"], freq="W", agg="mean", group_by="event_type"),
    series_sql("events", "ts", "value", "W", "mean", "event_type"),
)


def outlier_sql(source: str, c: str, method: str, k: float) -> str:
    bounds = (
        f"SELECT QUANTILE_CONT({c}, 0.25) - {k} * (QUANTILE_CONT({c}, 0.75) - QUANTILE_CONT({c}, 0.25)) AS lo, "
        f"QUANTILE_CONT({c}, 0.75) + {k} * (QUANTILE_CONT({c}, 0.75) - QUANTILE_CONT({c}, 0.25)) AS hi FROM {source}"
        if method == "iqr"
        else f"SELECT AVG({c}) - {k} * STDDEV_SAMP({c}) AS lo, AVG({c}) + {k} * STDDEV_SAMP({c}) AS hi FROM {source}"
    )
    return (
        f"WITH b AS ({bounds}), c AS (SELECT COUNT(*) FILTER (WHERE {c} < (SELECT lo FROM b) OR {c} > (SELECT hi FROM b)) AS n, "
        f"COUNT(*) AS total FROM {source}) SELECT '{c}' AS \"column\", '{method}' AS method, CAST({k} AS DOUBLE) AS threshold, "
        "n AS outlier_count, total AS total_rows, ROUND(n / total * 100, 1) AS outlier_pct, "
        "ROUND((SELECT lo FROM b), 3) AS lower_bound, ROUND((SELECT hi FROM b), 3) AS upper_bound FROM c"
    )


for _src, _col, _method, _k in (
    ("events", "value", "iqr", 1.5), ("lineitem", "l_extendedprice", "iqr", 0.5), ("events", "value", "zscore", 3.0),
    ("lineitem", "l_extendedprice", "zscore", 1.5),
):
    suite.add(
        f"outliers_{_method}_{_src}",
        lambda spark, sf, s=_src, c=_col, m=_method, k=_k: insights.detect_outliers(table(spark, sf, s), c, method=m, threshold=k),
        outlier_sql(_src, _col, _method, _k),
    )
suite.add(
    "outlier_samples_events",
    lambda spark, sf: insights.outlier_samples(table(spark, sf, "events"), "value", ["event_id"], entity="user_id"),
    "WITH b AS (SELECT QUANTILE_CONT(value, 0.25) AS q1, QUANTILE_CONT(value, 0.75) AS q3 FROM events) "
    "SELECT event_id, user_id, value FROM events, b WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) "
    "ORDER BY event_id LIMIT 20",
)


def trend_sql(source: str, date: str, value: str, freq: str, group: str | None = None) -> str:
    unit = _TRUNC[freq][0]
    key = f"CAST({group} AS VARCHAR) AS group_value, " if group else ""
    keys, part, by = ("group_value, ", "PARTITION BY group_value ", "GROUP BY group_value ") if group else ("", "", "")
    return (
        f"WITH a AS (SELECT {key}DATE_TRUNC('{unit}', {date}) AS s, CAST(AVG(CAST({value} AS DECIMAL(18,4))) AS DOUBLE) AS y FROM {source} "
        f"WHERE {date} IS NOT NULL AND {value} IS NOT NULL GROUP BY ALL), "
        f"n AS (SELECT *, CAST(ROW_NUMBER() OVER ({part}ORDER BY s) - 1 AS DOUBLE) AS x FROM a), "
        f"f AS (SELECT {keys}COUNT(*) AS periods, REGR_SLOPE(y, x) AS slope, "
        "CASE WHEN MIN(y) = MAX(y) THEN 0.0 ELSE REGR_R2(y, x) END AS r2, ARG_MIN(y, s) AS first, ARG_MAX(y, s) AS last "
        f"FROM n {by}HAVING COUNT(*) >= 3), "
        "g AS (SELECT *, CASE WHEN first = 0 THEN 0.0 ELSE (last - first) / ABS(first) * 100 END AS pct FROM f) "
        f"SELECT {keys}'{value}' AS value_column, '{freq}' AS freq, periods, ROUND(slope, 4) AS slope_per_period, "
        "ROUND(r2, 3) AS r_squared, ROUND(pct, 1) AS pct_change_first_to_last, "
        "CASE WHEN ABS(pct) < 5 OR r2 < 0.3 THEN 'stable' WHEN slope > 0 THEN 'increasing' ELSE 'decreasing' END AS direction FROM g"
    )


suite.add(
    "trend_daily_events",
    lambda spark, sf: insights.detect_trend(table(spark, sf, "events"), "ts", "value", freq="D"),
    trend_sql("events", "ts", "value", "D"),
)
suite.add(
    "trend_weekly_events_by_type",
    lambda spark, sf: insights.detect_trend(table(spark, sf, "events"), "ts", "value", freq="W", group_by="event_type"),
    trend_sql("events", "ts", "value", "W", "event_type"),
)
suite.add(
    "trend_monthly_orders",
    lambda spark, sf: insights.detect_trend(table(spark, sf, "orders"), "o_orderdate", "o_totalprice", freq="ME"),
    trend_sql("orders", "o_orderdate", "o_totalprice", "ME"),
)

RULES = (
    {"column": "l_quantity", "operator": ">", "threshold": 45, "label": "heavy load"},
    {"column": "l_discount", "operator": "<=", "threshold": 0.01, "label": "low discount"},
    {"column": "l_tax", "operator": "==", "threshold": 0.08, "label": "top tax"},
    {"column": "l_extendedprice", "operator": "<", "threshold": 1500, "label": "cheap"},
    {"column": "l_quantity", "operator": ">=", "threshold": 50, "label": "full load"},
    {"column": "no_such_column", "operator": ">", "threshold": 1, "label": "bad column"},
    {"column": "l_quantity", "operator": "~", "threshold": 1, "label": "bad operator"},
)
_GOOD = [r for r in RULES if r["column"] != "no_such_column" and r["operator"] != "~"]


def _rule_sql(r) -> str:
    return f"{r['column']} {'=' if r['operator'] == '==' else r['operator']} {r['threshold']}"


suite.add(
    "thresholds_lineitem",
    lambda spark, sf: insights.check_thresholds(table(spark, sf, "lineitem"), RULES),
    " UNION ALL ".join(
        f"SELECT '{r['label']}' AS rule, COUNT(*) FILTER (WHERE {_rule_sql(r)}) AS breach_count, "
        f"ROUND(COUNT(*) FILTER (WHERE {_rule_sql(r)}) / COUNT(*) * 100, 1) AS breach_pct, CAST(NULL AS VARCHAR) AS error FROM lineitem"
        for r in _GOOD
    )
    + " UNION ALL SELECT 'bad column', NULL, NULL, 'Column ''no_such_column'' not found'"
    + " UNION ALL SELECT 'bad operator', NULL, NULL, 'Unknown operator ''~'''",
)
suite.add(
    "threshold_samples_lineitem",
    lambda spark, sf: insights.threshold_samples(table(spark, sf, "lineitem"), RULES),
    " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{r['label']}' AS rule, ROW_NUMBER() OVER (ORDER BY {r['column']}) AS position, "
        f"{r['column']} AS value FROM lineitem WHERE {_rule_sql(r)}) WHERE position <= 10"
        for r in _GOOD
    ),
)


@suite.query(
    "rank_top_bottom_per_client",
    f"WITH fv AS ({fleet_sql(['client_id', 'equipment_id', 'payload_tonnes'])}), m AS (SELECT client_id, equipment_id, "
    f"ROUND({_exact('mean', 'payload_tonnes')}, 3) AS value FROM fv GROUP BY ALL), r AS (SELECT *, "
    "ROW_NUMBER() OVER (PARTITION BY client_id ORDER BY value DESC, equipment_id) AS t, "
    "ROW_NUMBER() OVER (PARTITION BY client_id ORDER BY value, equipment_id) AS b FROM m) "
    "SELECT client_id, 'top' AS side, t AS position, equipment_id, value FROM r WHERE t <= 3 UNION ALL "
    "SELECT client_id, 'bottom', b, equipment_id, value FROM r WHERE b <= 3",
)
def _per_client(spark, sf):
    means = fleet_view(spark, sf).groupBy("client_id", "equipment_id").agg(
        F.round(stats.aggregate("payload_tonnes", "mean"), 3).alias("value")
    )
    return stats.ends_per_group(means, "client_id", "equipment_id", "value")


@suite.query(
    "first_last_change_by_type",
    "SELECT event_type, ARG_MIN(value, (ts, event_id)) AS first, ARG_MAX(value, (ts, event_id)) AS last, "
    "ROUND((ARG_MAX(value, (ts, event_id)) - ARG_MIN(value, (ts, event_id))) / ABS(ARG_MIN(value, (ts, event_id))) * 100, 1) AS pct_change "
    "FROM events GROUP BY event_type",
)
def _first_last(spark, sf):
    return stats.first_last_change(table(spark, sf, "events"), "event_type", "value", ["ts", "event_id"])
