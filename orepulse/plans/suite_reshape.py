"""Reshaping, row quality and schema queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orepulse.functions.numbers import exact_sum
from orepulse.operators import quality, reshape, schema
from orepulse.operators.kpi import REGISTRY
from orepulse.operators.scans import ordered_scan
from orepulse.plans.suite import Suite, half_up
from orepulse.session import drop_cut
from orepulse.sources.tables import FLEET_ORDER, fleet_sql, fleet_view, table

suite = Suite()
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
LINE_SQL_ORDER = ", ".join(LINE_KEY)

# ---- headers, filters, recipes --------------------------------------------------------------


@suite.query("reshape_header_normalisation", "SELECT r_regionkey AS region_key, r_name AS region_name FROM region")
def _headers(spark, sf):
    return reshape.normalise_headers(table(spark, sf, "region").toDF(" Region Key", "Region Name "))


@suite.query(
    "reshape_canonical_rename",
    "SELECT l_suppkey AS equipment_id, l_quantity AS payload_tonnes, l_tax FROM lineitem",
)
def _canonical(spark, sf):
    raw = table(spark, sf, "lineitem").select("l_suppkey", "l_quantity", "l_tax")
    return reshape.canonical_rename(raw, {"l_suppkey": "equipment_id", "l_quantity": "payload_tonnes", "missing": "rpm"})


@suite.query(
    "reshape_exclude_rows_keeps_nulls",
    "WITH t AS (SELECT NULLIF(l_returnflag, 'N') AS flag, l_quantity FROM lineitem) "
    "SELECT flag, COUNT(*) AS n, CAST(SUM(l_quantity) AS DOUBLE) AS quantity FROM t WHERE NOT COALESCE(flag = 'R', FALSE) GROUP BY flag",
)
def _exclude(spark, sf):
    t = table(spark, sf, "lineitem").select(F.expr("nullif(l_returnflag, 'N')").alias("flag"), "l_quantity")
    kept = reshape.filter_rows(t, "flag = 'R'")
    return kept.groupBy("flag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


@suite.query("reshape_rename_drop", "SELECT l_quantity AS tonnes, l_orderkey FROM lineitem")
def _rename_drop(spark, sf):
    t = table(spark, sf, "lineitem").select("l_quantity", "l_orderkey", "l_tax")
    return reshape.drop_columns(reshape.rename_columns(t, {"l_quantity": "tonnes", "gone": "x"}), ["l_tax", "gone"])


def indexed_lineitem(spark, sf, *columns: str) -> DataFrame:
    return reshape.with_row_index(table(spark, sf, "lineitem").select(*LINE_KEY, *columns), LINE_KEY)


INDEXED_SQL = f"SELECT *, ROW_NUMBER() OVER (ORDER BY {LINE_SQL_ORDER}) - 1 AS row_idx FROM lineitem"

suite.add(
    "reshape_row_index",
    lambda spark, sf: indexed_lineitem(spark, sf),
    f"SELECT {LINE_SQL_ORDER}, row_idx FROM ({INDEXED_SQL})",
)
suite.add(
    "reshape_row_index_per_supplier",
    lambda spark, sf: reshape.with_row_index(table(spark, sf, "lineitem").select(*LINE_KEY), LINE_KEY, keys=["l_suppkey"]),
    f"SELECT {LINE_SQL_ORDER}, ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY {LINE_SQL_ORDER}) - 1 AS row_idx FROM lineitem",
)
suite.add(
    "reshape_skip_rows",
    lambda spark, sf: reshape.skip_rows(indexed_lineitem(spark, sf), 1000),
    f"SELECT {LINE_SQL_ORDER}, row_idx FROM ({INDEXED_SQL}) WHERE row_idx >= 1000",
)


@suite.query(
    "reshape_set_header_row",
    "SELECT CAST(c_custkey AS VARCHAR) AS customer, c_name AS label, row_idx FROM (SELECT c_custkey, c_name, "
    "ROW_NUMBER() OVER (ORDER BY c_custkey) + 1 AS row_idx FROM customer)",
)
def _set_header(spark, sf):
    return reshape.set_header_row(_customer_lines(spark, sf), 1)


def _customer_lines(spark, sf) -> DataFrame:
    """The customer table as a headerless sheet with two heading rows on top."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_custkey").cast("string").alias("_c0"), F.col("c_name").alias("_c1"))
    heads = spark.sql("SELECT -2L AS k, 'key' AS _c0, 'full' AS _c1 UNION ALL SELECT -1L, 'customer', 'label'")
    return reshape.with_row_index(c.unionByName(heads), ["k"]).drop("k")


@suite.query(
    "reshape_combine_header_rows",
    "SELECT CAST(c_custkey AS VARCHAR) AS key_customer, c_name AS full_label, row_idx FROM (SELECT c_custkey, c_name, "
    "ROW_NUMBER() OVER (ORDER BY c_custkey) + 1 AS row_idx FROM customer)",
)
def _combine_header(spark, sf):
    return reshape.combine_header_rows(_customer_lines(spark, sf), [0, 1])




@suite.query(
    "reshape_transpose_orders_by_priority",
    "WITH a AS (SELECT o_orderpriority AS p, COUNT(*) AS n, CAST(MAX(o_totalprice) AS DOUBLE) AS top FROM orders GROUP BY 1) "
    + " UNION ALL ".join(
        f"SELECT '{f}' AS field, "
        + ", ".join(
            f"MAX(CASE WHEN p = '{p}' THEN CAST({f} AS VARCHAR) END) AS \"{p}\""
            for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
        )
        + " FROM a"
        for f in ("n", "top")
    ),
)
def _transpose(spark, sf):
    summary = table(spark, sf, "orders").groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top")
    )
    return reshape.transpose(summary, "o_orderpriority")


_TYPES = ["click", "error", "purchase", "signup", "view"]
_EVENT_DAY = "SELECT event_id, user_id, event_type, value, CAST(ts AS DATE) AS day FROM events"


@suite.query(
    "reshape_pivot_segments",
    f"WITH e AS ({_EVENT_DAY}) SELECT user_id, day, "
    + ", ".join(f"ARG_MIN(value, event_id) FILTER (WHERE event_type = '{t}') AS {t}" for t in _TYPES)
    + " FROM e WHERE value IS NOT NULL GROUP BY user_id, day",
)
def _pivot(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", F.to_date("ts").alias("day"))
    return reshape.pivot_segments(e, "event_type", "value", ["user_id", "day"], "event_id")


@suite.query(
    "reshape_eav_pivot",
    "SELECT user_id, " + ", ".join(f"ARG_MIN(value, event_id) FILTER (WHERE event_type = '{t}') AS {t}" for t in _TYPES)
    + " FROM events WHERE value IS NOT NULL GROUP BY user_id",
)
def _eav(spark, sf):
    e = table(spark, sf, "events").select(
        "user_id", F.col("event_type").alias("_field"), F.col("value").alias("_value"), F.col("event_id").alias("row_idx")
    )
    return reshape.eav_pivot(e, ["user_id"])


@suite.query(
    "reshape_melt",
    " UNION ALL ".join(
        f"SELECT {LINE_SQL_ORDER}, '{c}' AS metric, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE {c} END AS reading FROM lineitem"
        for c in ("l_quantity", "l_discount", "l_tax")
    ),
)
def _melt(spark, sf):
    cols = ("l_quantity", "l_discount", "l_tax")
    t = table(spark, sf, "lineitem").select(*LINE_KEY, *[F.when(F.col("l_orderkey") % 7 != 0, F.col(c)).alias(c) for c in cols])
    return reshape.melt(t, LINE_KEY, cols, "metric", "reading")


_HOLES = "CASE WHEN event_id % 3 = 0 THEN value END"


@suite.query(
    "reshape_fill_forward",
    f"SELECT event_id, LAST_VALUE({_HOLES} IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) "
    "AS reading FROM events",
)
def _ffill(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.expr(_HOLES).alias("reading"))
    return reshape.fill_forward(e, "reading", "event_id")


@suite.query(
    "reshape_fill_forward_per_user",
    f"SELECT user_id, event_id, LAST_VALUE({_HOLES} IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reading FROM events",
)
def _ffill_user(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", F.expr(_HOLES).alias("reading"))
    return reshape.fill_forward(e, "reading", "event_id", ["user_id"])


_RECIPE = [
    {"operation": "filter_rows", "params": {"exclude": "l_returnflag = 'R'"}},
    {"operation": "polish_chrome", "params": {}},
    {"operation": "rename_columns", "params": {"mapping": {"l_quantity": "tonnes"}}},
    {"operation": "melt", "params": {"id_vars": ["l_orderkey"], "value_vars": ["no_such_column"]}},
    {"operation": "drop_columns", "params": {"columns": ["l_returnflag"]}},
]


def _recipe(spark, sf):
    return reshape.run_recipe(table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_returnflag"), _RECIPE)


suite.add(
    "reshape_recipe",
    lambda spark, sf: _recipe(spark, sf)[0],
    "SELECT l_orderkey, l_quantity AS tonnes FROM lineitem WHERE l_returnflag <> 'R'",
)
suite.add(
    "reshape_recipe_report",
    lambda spark, sf: _recipe(spark, sf)[0].agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.inline(F.array(*[F.struct(F.lit(r["operation"]).alias("operation"), F.lit(r["status"]).alias("status")) for r in _recipe(spark, sf)[1]]))
    ),
    "SELECT (SELECT COUNT(*) FROM lineitem WHERE l_returnflag <> 'R') AS rows, operation, status FROM (VALUES ('filter_rows', 'applied'), "
    "('polish_chrome', 'skipped'), ('rename_columns', 'applied'), ('melt', 'failed'), ('drop_columns', 'applied')) AS v(operation, status)",
)


@suite.query(
    "reshape_date_coercion",
    "WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'not a date' ELSE STRFTIME(o_orderdate, '%Y-%m-%d') END AS order_date "
    "FROM orders) SELECT o_orderkey, STRFTIME(TRY_CAST(order_date AS TIMESTAMP), '%Y-%m-%d') AS day FROM t",
)
def _dates(spark, sf):
    text = F.when(F.col("o_orderkey") % 11 == 0, "not a date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    t = table(spark, sf, "orders").select("o_orderkey", text.alias("order_date"))
    return reshape.coerce_dates(t).select("o_orderkey", F.date_format("order_date", "yyyy-MM-dd").alias("day"))


@suite.query(
    "reshape_number_coercion",
    "SELECT event_id, TRY_CAST(CASE WHEN event_id % 13 = 0 THEN 'n/a' ELSE REGEXP_EXTRACT(props, '[0-9]+') END AS DOUBLE) AS k FROM events",
)
def _numbers(spark, sf):
    text = F.when(F.col("event_id") % 13 == 0, "n/a").otherwise(F.regexp_extract("props", "[0-9]+", 0))
    return reshape.coerce_numbers(table(spark, sf, "events").select("event_id", text.alias("k")), ["k"])


_CORNERS = {"fl": "front_left", "fr": "front_right", "rl": "rear_left", "rr": "rear_right"}


@suite.query(
    "reshape_tyre_pressures",
    f"WITH fv AS ({fleet_sql(['cycle_id', *FLEET_ORDER, *[f'tire_pressure_{c}_psi' for c in _CORNERS]])}) "
    + " UNION ALL ".join(
        f"SELECT {', '.join(FLEET_ORDER)}, '{v}' AS tire_position, tire_pressure_{k}_psi AS pressure_psi FROM fv" for k, v in _CORNERS.items()
    ),
)
def _tyres(spark, sf):
    return reshape.tyre_pressures_long(fleet_view(spark, sf), FLEET_ORDER)


@suite.query(
    "reshape_chart_series",
    "WITH a AS (SELECT event_type, CAST(ts AS DATE) AS day, CAST(SUM(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS v FROM events GROUP BY 1, 2) "
    "SELECT day, " + ", ".join(f"MAX(CASE WHEN event_type = '{t}' THEN v END) AS {t}_value" for t in _TYPES) + " FROM a GROUP BY day",
)
def _chart_series(spark, sf):
    daily = table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(
        exact_sum("value").alias("value")
    )
    return reshape.chart_series(daily, "event_type", "day", ["value"])


@suite.query("reshape_drop_export_columns", "SELECT event_id, value FROM events")
def _mechanics(spark, sf):
    e = table(spark, sf, "events").select("event_id", "value", F.lit("mean").alias("result"), F.lit(0).alias("table"), F.col("ts").alias("_start"))
    return reshape.drop_ignorable(e)


# ---- ordered scans --------------------------------------------------------------------------

_HOURS = ["equipment_id", "load_start_time", *FLEET_ORDER, "operating_hours"]
_HOUR_ORDER = ["load_start_time", *FLEET_ORDER]
_HOURS_SQL = (
    f"WITH fv AS ({fleet_sql(_HOURS)}), h AS (SELECT *, CAST(SUM(CAST(operating_hours AS DECIMAL(18,4))) OVER (PARTITION BY equipment_id "
    f"ORDER BY {', '.join(_HOUR_ORDER)} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS engine_hours FROM fv) "
)


def engine_hours(spark, sf, keep_blocks: bool = False) -> DataFrame:
    """The fleet view with a running hour meter per equipment."""
    rows = fleet_view(spark, sf).select(*_HOURS)
    hours = F.col("operating_hours").cast("DECIMAL(18,4)")
    metered = ordered_scan(rows, ["equipment_id"], _HOUR_ORDER, sums={"engine_hours": hours}, keep_blocks=keep_blocks)
    return metered.withColumn("engine_hours", F.col("engine_hours").cast("double"))


suite.add(
    "window_engine_hours",
    lambda spark, sf: engine_hours(spark, sf).select("equipment_id", *FLEET_ORDER, "engine_hours"),
    _HOURS_SQL + f"SELECT equipment_id, {', '.join(FLEET_ORDER)}, engine_hours FROM h",
)


def counter_difference(spark, sf) -> DataFrame:
    metered = engine_hours(spark, sf, keep_blocks=True)
    scanned = ordered_scan(metered, ["equipment_id"], _HOUR_ORDER, previous={"before": "engine_hours"})
    drop_cut(metered)  # the second scan has blocks of its own
    return scanned.select("equipment_id", *FLEET_ORDER, (F.col("engine_hours") - F.col("before")).alias("interval_hours"))


suite.add(
    "window_counter_difference",
    counter_difference,
    _HOURS_SQL + f"SELECT equipment_id, {', '.join(FLEET_ORDER)}, engine_hours - LAG(engine_hours) OVER (PARTITION BY equipment_id "
    f"ORDER BY {', '.join(_HOUR_ORDER)}) AS interval_hours FROM h",
)


@suite.query(
    "window_cumulative_tonnes_per_shift",
    f"WITH fv AS ({fleet_sql(['equipment_id', 'shift', 'dump_time', 'payload_tonnes', *FLEET_ORDER])}) SELECT {', '.join(FLEET_ORDER)}, shift, "
    f"CAST(SUM(CAST(payload_tonnes AS DECIMAL(18,4))) OVER (PARTITION BY shift ORDER BY dump_time, {', '.join(FLEET_ORDER)} "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS cumulative_tonnes FROM fv",
)
def _cumulative(spark, sf):
    fv = fleet_view(spark, sf).select(*FLEET_ORDER, "shift", "dump_time", "payload_tonnes")
    scanned = ordered_scan(fv, ["shift"], ["dump_time", *FLEET_ORDER], sums={"t": F.col("payload_tonnes").cast("DECIMAL(18,4)")})
    return scanned.select(*FLEET_ORDER, "shift", F.col("t").cast("double").alias("cumulative_tonnes"))


@suite.query(
    "window_event_duration",
    f"WITH fv AS ({fleet_sql(['load_start_time', 'dump_time', *FLEET_ORDER])}) SELECT {', '.join(FLEET_ORDER)}, "
    "CAST(EPOCH_US(dump_time) - EPOCH_US(load_start_time) AS BIGINT) AS duration_us FROM fv",
)
def _duration(spark, sf):
    fv = fleet_view(spark, sf)
    return fv.select(*FLEET_ORDER, reshape.duration_us("load_start_time", "dump_time").alias("duration_us"))


@suite.query(
    "window_keep_first_dedup",
    "SELECT source, lang, doc_id, n_chars FROM documents QUALIFY ROW_NUMBER() OVER (PARTITION BY source, lang ORDER BY doc_id) = 1",
)
def _dedup(spark, sf):
    return reshape.keep_first(table(spark, sf, "documents").select("source", "lang", "doc_id", "n_chars"), ["source", "lang"], ["doc_id"])


# ---- profiles and row quality ---------------------------------------------------------------


def _profile_sql(source: str, columns: dict[str, str]) -> str:
    parts = []
    for c, kind in columns.items():
        number, date = kind in ("integer", "float"), kind == "datetime"
        shown = f"'{kind}'"
        if kind == "string":
            shown = f"CASE WHEN COUNT(DISTINCT {c}) / COUNT({c}) < 0.05 THEN 'categorical' ELSE 'string' END"
        parts.append(
            f"SELECT '{c}' AS \"column\", {shown} AS type, COUNT(*) - COUNT({c}) AS null_count, "
            f"ROUND((COUNT(*) - COUNT({c})) / COUNT(*) * 100, 1) AS null_pct, "
            + (f"ROUND(MIN({c}), 3)::DOUBLE AS min, ROUND(MAX({c}), 3)::DOUBLE AS max, ROUND(AVG({c}), 3) AS mean, " if number
               else "NULL::DOUBLE AS min, NULL::DOUBLE AS max, NULL::DOUBLE AS mean, ")
            + (f"STRFTIME(MIN({c}), '%Y-%m-%d %H:%M:%S') AS date_min, STRFTIME(MAX({c}), '%Y-%m-%d %H:%M:%S') AS date_max " if date
               else "NULL AS date_min, NULL AS date_max ")
            + f"FROM {source}"
        )
    return " UNION ALL ".join(parts)


_PROFILED = {
    "l_orderkey": "integer", "l_quantity": "float", "l_extendedprice": "float", "l_returnflag": "string", "l_linestatus": "string",
    "l_shipdate": "datetime",
}
suite.add(
    "profile_lineitem",
    lambda spark, sf: quality.column_profile(table(spark, sf, "lineitem").select(*_PROFILED)),
    _profile_sql("lineitem", _PROFILED),
)
_ORDERED = {"o_orderkey": "integer", "o_totalprice": "float", "o_orderpriority": "string", "o_orderdate": "datetime"}
suite.add(
    "profile_orders",
    lambda spark, sf: quality.column_profile(table(spark, sf, "orders").select(*_ORDERED)),
    _profile_sql("orders", _ORDERED),
)
suite.add(
    "profile_top_values",
    lambda spark, sf: quality.top_values(table(spark, sf, "orders"), ["o_orderpriority", "o_orderstatus"]),
    "WITH c AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", {c} AS value, COUNT(*) AS n FROM orders GROUP BY {c}" for c in ("o_orderpriority", "o_orderstatus")
    ) + "), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY \"column\" ORDER BY n DESC, value) AS position FROM c) "
    "SELECT \"column\", position, value, n FROM r WHERE position <= 5",
)
_GAPPY = "SELECT CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE l_tax END AS l_tax, CASE WHEN l_orderkey % 20 = 0 THEN NULL ELSE l_discount END AS l_discount, l_quantity FROM lineitem"
suite.add(
    "quality_null_report",
    lambda spark, sf: quality.data_quality_report(
        table(spark, sf, "lineitem").select(
            F.when(F.col("l_orderkey") % 4 != 0, F.col("l_tax")).alias("l_tax"),
            F.when(F.col("l_orderkey") % 20 != 0, F.col("l_discount")).alias("l_discount"), "l_quantity",
        )
    ),
    f"WITH g AS ({_GAPPY}), n AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", COUNT(*) - COUNT({c}) AS null_count, ROUND((COUNT(*) - COUNT({c})) / COUNT(*) * 100, 1) AS null_pct FROM g"
        for c in ("l_tax", "l_discount", "l_quantity")
    ) + ") SELECT * FROM n WHERE null_pct > 10",
)

# A raw text sheet made from lineitem, with separator rows, repeated headers and text in a number column.
_CELLS = {
    "l_orderkey": "CAST(l_orderkey AS STRING)",
    "quantity": "CASE WHEN k % 83 = 0 THEN 'abc' WHEN k % 61 = 0 THEN 'N/A' ELSE CAST(l_quantity AS STRING) END",
    "l_returnflag": "l_returnflag",
    "discount": "CAST(l_discount AS STRING)",
    "ship_date": "CAST(CAST(l_shipdate AS DATE) AS STRING)",
}


def _cell(name: str, expr: str) -> str:
    return f"CASE WHEN k % 97 = 0 THEN NULL WHEN k % 89 = 0 THEN '{name}' ELSE {expr} END AS {name}"


_KEYED = "l_orderkey + l_linenumber * 3 + l_partkey AS k"
DIRTY_SQL = (
    f"SELECT ROW_NUMBER() OVER (ORDER BY {LINE_SQL_ORDER}) - 1 AS row_idx, {', '.join(_cell(n, e) for n, e in _CELLS.items())} "
    f"FROM (SELECT *, {_KEYED} FROM lineitem)"
)


def dirty_sheet(spark, sf) -> DataFrame:
    raw = table(spark, sf, "lineitem").selectExpr("*", _KEYED)
    cells = raw.selectExpr(*[f"{c} AS key_{c}" for c in LINE_KEY], *[_cell(n, e) for n, e in _CELLS.items()])
    return reshape.with_row_index(cells, [f"key_{c}" for c in LINE_KEY]).drop(*[f"key_{c}" for c in LINE_KEY])


_NAMES = list(_CELLS)
_FILLED = " + ".join(f"CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END" for c in _NAMES)
_BLANKS = " + ".join(f"CASE WHEN {c} IS NULL OR TRIM({c}) = '' THEN 1 ELSE 0 END" for c in _NAMES)
_HEADERY = " + ".join(
    f"CASE WHEN REGEXP_MATCHES(TRIM({c}), '^[a-zA-Z][a-zA-Z0-9_]{{1,60}}$') THEN 1 ELSE 0 END" for c in _NAMES
)
_BAD = "TRY_CAST(TRIM({c}) AS DOUBLE) IS NULL AND {c} IS NOT NULL AND LOWER(TRIM({c})) NOT IN ('nan','null','none','na','n/a','')"
_BREAK = "COALESCE(" + ", ".join(
    f"CASE WHEN {_BAD.format(c=c)} THEN 'Numeric column ''{c}'' contains string value ''' || {c} || '''' END" for c in ("quantity", "discount")
) + ")"
ANOMALY_SQL = (
    f"WITH d AS ({DIRTY_SQL}), a AS (SELECT row_idx, CASE WHEN ({_BLANKS}) / 5.0 >= 0.8 THEN 'separator_row' "
    f"WHEN ({_FILLED}) > 0 AND ({_HEADERY}) / ({_FILLED}) >= 0.5 THEN 'embedded_header' WHEN {_BREAK} IS NOT NULL THEN 'type_break' END AS anomaly_type, "
    f"CASE WHEN ({_BLANKS}) / 5.0 >= 0.8 THEN 'at least 80% of values are null or empty' "
    f"WHEN ({_FILLED}) > 0 AND ({_HEADERY}) / ({_FILLED}) >= 0.5 THEN 'at least 50% of values match column-name patterns' ELSE {_BREAK} END AS detail "
    "FROM d WHERE row_idx >= 1) "
)
_anomalies = lambda spark, sf: quality.row_anomalies(dirty_sheet(spark, sf), "row_idx", ["quantity", "discount"])
suite.add("quality_row_anomalies", _anomalies, ANOMALY_SQL + "SELECT * FROM a WHERE anomaly_type IS NOT NULL")
suite.add(
    "quality_anomaly_counts",
    lambda spark, sf: _anomalies(spark, sf).groupBy("anomaly_type").agg(F.count(F.lit(1)).alias("n")),
    ANOMALY_SQL + "SELECT anomaly_type, COUNT(*) AS n FROM a WHERE anomaly_type IS NOT NULL GROUP BY anomaly_type",
)
suite.add(
    "quality_anomaly_sample",
    lambda spark, sf: quality.anomaly_sample(_anomalies(spark, sf), "row_idx"),
    ANOMALY_SQL + "SELECT * FROM a WHERE anomaly_type IS NOT NULL ORDER BY row_idx LIMIT 100",
)


@suite.query(
    "quality_column_count_shift",
    "SELECT event_id AS row_idx, 'column_count_shift' AS anomaly_type, 'Expected 3 columns, got 4' AS detail FROM events WHERE event_id % 50 = 0",
)
def _shift(spark, sf):
    e = table(spark, sf, "events")
    line = F.concat_ws(",", "event_id", "event_type", "value", F.when(F.col("event_id") % 50 == 0, "extra"))
    lines = e.select(F.col("event_id").alias("row_idx"), line.alias("line"))
    return quality.column_count_shift(lines, "line", "row_idx", 3)


def _streamed_sql(source: str, columns: list[str]) -> str:
    parts = []
    for c in columns:
        x = f"NULLIF(TRIM({c}), '')"
        votes = f"COUNT(TRY_CAST({x} AS DOUBLE)) / COUNT({x})"
        named = any(f in c for f in reshape.DATE_FRAGMENTS)
        kind = "'datetime'" if named else (
            f"CASE WHEN COUNT({x}) = 0 THEN 'string' WHEN {votes} >= 0.9 AND NOT BOOL_OR(CONTAINS({x}, '.')) THEN 'integer' "
            f"WHEN {votes} >= 0.9 THEN 'float' WHEN LEAST(COUNT(DISTINCT {x}), 1000) / COUNT({x}) < 0.05 THEN 'categorical' ELSE 'string' END"
        )
        mean = f"CAST(SUM(TRY_CAST({x} AS DECIMAL(20,4))) AS DOUBLE) / COUNT(TRY_CAST({x} AS DOUBLE))"
        parts.append(
            f"SELECT '{c}' AS \"column\", {kind} AS inferred_type, COUNT(*) - COUNT({x}) AS null_count, COUNT(*) AS total_count, "
            f"ROUND(MIN(TRY_CAST({x} AS DOUBLE)), 4) AS min_val, ROUND(MAX(TRY_CAST({x} AS DOUBLE)), 4) AS max_val, "
            f"{half_up(f'CASE WHEN COUNT(TRY_CAST({x} AS DOUBLE)) > 0 THEN {mean} END', 4)} AS mean, "
            f"LEAST(COUNT(DISTINCT {x}), 1000) AS cardinality, COUNT(DISTINCT {x}) > 1000 AS cardinality_capped FROM {source}"
        )
    return " UNION ALL ".join(parts)


suite.add(
    "profile_streamed_sheet",
    lambda spark, sf: quality.streaming_profile(dirty_sheet(spark, sf), "row_idx"),
    f"WITH d AS ({DIRTY_SQL}) " + _streamed_sql("d", _NAMES),
)
suite.add(
    "profile_sample_values",
    lambda spark, sf: quality.sample_values(dirty_sheet(spark, sf), _NAMES, "row_idx"),
    f"WITH d AS ({DIRTY_SQL}), l AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", TRIM({c}) AS value, MIN(row_idx) AS first_row FROM d WHERE TRIM({c}) <> '' GROUP BY 2" for c in _NAMES
    ) + "), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY \"column\" ORDER BY first_row, value) AS position FROM l) "
    "SELECT \"column\", position, value, first_row FROM r WHERE position <= 10",
)
suite.add(
    "profile_text",
    lambda spark, sf: quality.profile_text(
        quality.streaming_profile(dirty_sheet(spark, sf), "row_idx"), quality.sample_values(dirty_sheet(spark, sf), _NAMES, "row_idx")
    ),
    f"WITH d AS ({DIRTY_SQL}), p AS ({_streamed_sql('d', _NAMES)}), l AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", TRIM({c}) AS value, MIN(row_idx) AS first_row FROM d WHERE TRIM({c}) <> '' GROUP BY 2" for c in _NAMES
    ) + "), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY \"column\" ORDER BY first_row, value) AS position FROM l), "
    "s AS (SELECT \"column\", '[' || STRING_AGG('''' || value || '''', ', ' ORDER BY position) FILTER (WHERE position <= 2) || ']' AS two, "
    "'[' || STRING_AGG('''' || value || '''', ', ' ORDER BY position) FILTER (WHERE position <= 5) || ']' AS five FROM r GROUP BY 1) "
    "SELECT p.\"column\", '  ' || RPAD(p.\"column\", 40, ' ') || ' [' || inferred_type || ']  ' || CASE WHEN inferred_type IN ('float', 'integer') "
    "THEN PRINTF('mean=%.4f  min=%.4f  max=%.4f  null=%.1f%%', mean, min_val, max_val, null_count / total_count * 100) "
    "WHEN inferred_type = 'datetime' THEN 'sample=' || two || PRINTF('  null=%.1f%%', null_count / total_count * 100) "
    "ELSE 'cardinality=' || cardinality || CASE WHEN cardinality_capped THEN '+' ELSE '' END || '  sample=' || five || "
    "PRINTF('  null=%.1f%%', null_count / total_count * 100) END AS line FROM p LEFT JOIN s ON s.\"column\" = p.\"column\"",
)
suite.add(
    "preview_head",
    lambda spark, sf: quality.head_rows(indexed_lineitem(spark, sf, "l_quantity"), "row_idx"),
    f"SELECT {LINE_SQL_ORDER}, l_quantity, row_idx FROM ({INDEXED_SQL}) WHERE row_idx < 50",
)
suite.add(
    "preview_tail",
    lambda spark, sf: quality.tail_rows(indexed_lineitem(spark, sf, "l_quantity"), "row_idx"),
    f"SELECT {LINE_SQL_ORDER}, l_quantity, row_idx FROM ({INDEXED_SQL}) ORDER BY row_idx DESC LIMIT 20",
)
suite.add(
    "preview_first_rows",
    lambda spark, sf: table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(3),
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 3",
)


def _masked_sql(column: str) -> str:
    text = column
    for _, pattern, tag in quality.MASKS:
        text = f"REGEXP_REPLACE({text}, '{pattern}', '{tag}', 'g')"
    return text


suite.add(
    "quality_mask_identifiers",
    lambda spark, sf: quality.mask_identifiers(table(spark, sf, "documents").select("doc_id", F.col("text").alias("masked")), "masked"),
    f"SELECT doc_id, {_masked_sql('text')} AS masked FROM documents",
)
suite.add(
    "quality_mask_counts",
    lambda spark, sf: quality.mask_counts(table(spark, sf, "documents"), "text"),
    " UNION ALL ".join(
        f"SELECT '{tag}' AS kind, COUNT(*) FILTER (WHERE LEN(REGEXP_EXTRACT_ALL(text, '{p}')) > 0) AS rows_hit, "
        f"CAST(SUM(LEN(REGEXP_EXTRACT_ALL(text, '{p}'))) AS BIGINT) AS hits FROM documents"
        for _, p, tag in quality.MASKS
    ),
)
suite.add(
    "quality_peer_graph_overlap",
    lambda spark, sf: quality.peer_graph_share(table(spark, sf, "lineitem"), "l_partkey", "l_suppkey"),
    "WITH a AS (SELECT DISTINCT l_partkey AS v FROM lineitem), b AS (SELECT DISTINCT l_suppkey AS v FROM lineitem) "
    "SELECT (SELECT COUNT(*) FROM a) AS left_values, (SELECT COUNT(*) FROM b) AS right_values, COUNT(*) AS shared_values, "
    "ROUND(COUNT(*) / LEAST((SELECT COUNT(*) FROM a), (SELECT COUNT(*) FROM b)), 3) AS overlap FROM a JOIN b USING (v)",
)

# ---- headers each equipment reports, under the names its tenant uses -------------------------

# position | fleet column that must be non-zero | header of tenant C1 | of C2 | of C3
_VENDOR = """
0 | scheduled_hours | truck_id | Equipment ID | vehicle_id
1 | dust_readings | timestamp | Time Stamp | time-stamp
2 | payload_tonnes | tonnage | payload_tonnes | tire_position
3 | fuel_litres | fuel_volume_l | Fuel Litres | temperature_c
4 | cycle_time_min | cycle_duration_min | rpm | pressure_psi
5 | on_time_services | load_start_time | temperature | wear_pct
6 | co2_grams | result | _start | table
7 | speed_kph | speed_kph | pressure | vendor_speed
8 | failure_count | dump_time | failure_count | temp
9 | pre_shift_checks_done | fault_code | engine_on_hours | load_start_time
"""
_VENDOR_ROWS = [[p.strip() for p in line.split("|")] for line in _VENDOR.strip().splitlines()]
_VENDOR_COLUMNS = [r[1] for r in _VENDOR_ROWS]


def vendor_headers(spark, sf) -> DataFrame:
    fv = fleet_view(spark, sf)
    flags = fv.groupBy(F.concat_ws("/", "client_id", "equipment_id").alias("source_file"), "client_id").agg(
        *[F.max(F.col(c) != 0).alias(c) for c in _VENDOR_COLUMNS]
    )
    cells = []
    for position, column, c1, c2, c3 in _VENDOR_ROWS:
        name = F.when(F.col("client_id") == "C1", c1).when(F.col("client_id") == "C2", c2).otherwise(c3)
        cells.append(F.struct(F.lit(int(position)).alias("ordinal"), name.alias("column_name"), F.col(column).alias("used")))
    return flags.select("source_file", F.inline(F.array(*cells))).filter("used").drop("used")


VENDOR_SQL = (
    f"fv AS ({fleet_sql(['client_id', 'equipment_id', *_VENDOR_COLUMNS])}), headers AS ("
    + " UNION ALL ".join(
        f"SELECT client_id || '/' || equipment_id AS source_file, {p} AS ordinal, "
        f"CASE client_id WHEN 'C1' THEN '{c1}' WHEN 'C2' THEN '{c2}' ELSE '{c3}' END AS column_name "
        f"FROM fv GROUP BY client_id, equipment_id HAVING MAX({c}) <> 0"
        for p, c, c1, c2, c3 in _VENDOR_ROWS
    )
    + ")"
)
_KEY = "REGEXP_REPLACE(LOWER({}), '[^a-z0-9]', '', 'g')"
_ROWS = schema.core_vocabulary_rows()


def _values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" for v in r) + ")" for r in rows) + ")"


RECONCILE_SQL = (
    f"WITH {VENDOR_SQL}, voc(canonical, dtype, role, domain, unit) AS {_values([(r[0], r[1], r[2], r[3], r[6]) for r in _ROWS])}, "
    f"strong0(alias, canonical, domain) AS {_values([(a, r[0], r[3]) for r in _ROWS for a in r[4]])}, "
    f"weak0(alias, canonical, domain) AS {_values([(a, r[0], r[3]) for r in _ROWS for a in r[5]])}, "
    f"strong AS (SELECT DISTINCT {_KEY.format('alias')} AS key, canonical, domain FROM strong0), "
    f"weak AS (SELECT DISTINCT {_KEY.format('alias')} AS key, canonical, domain FROM weak0), "
    f"h AS (SELECT *, {_KEY.format('column_name')} AS key, {_KEY.format('column_name')} IN ('result', 'table', 'start', 'stop', 'unnamed0', '') AS ignored FROM headers), "
    f"own AS (SELECT {_KEY.format('canonical')} AS key, canonical, domain FROM voc WHERE {_KEY.format('canonical')} NOT IN (SELECT key FROM weak)), "
    "one AS (SELECT key, MIN(canonical) AS canonical, MIN(domain) AS domain FROM strong GROUP BY key HAVING COUNT(*) = 1), "
    "spec AS (SELECT h.*, COALESCE(o.canonical, s.canonical) AS canonical, COALESCE(o.domain, s.domain) AS domain, "
    "CASE WHEN o.key IS NOT NULL THEN 'name' WHEN s.key IS NOT NULL THEN 'strong' END AS tier FROM h LEFT JOIN own o ON o.key = h.key AND NOT h.ignored "
    "LEFT JOIN one s ON s.key = h.key AND NOT h.ignored AND o.key IS NULL), "
    "hits AS (SELECT source_file, domain, COUNT(*) AS n FROM spec WHERE canonical IS NOT NULL GROUP BY ALL), "
    "active AS (SELECT source_file, domain FROM hits UNION SELECT source_file, 'shared' FROM h), "
    "act AS (SELECT source_file, STRING_AGG(domain, ',' ORDER BY domain) AS active_domains FROM active GROUP BY source_file), "
    "cand AS (SELECT s.source_file, s.ordinal, w.canonical, w.domain, COALESCE(n, 0) AS n FROM spec s JOIN weak w ON w.key = s.key "
    "JOIN active a ON a.source_file = s.source_file AND a.domain = w.domain LEFT JOIN hits ON hits.source_file = s.source_file AND hits.domain = w.domain "
    "WHERE s.canonical IS NULL AND NOT s.ignored AND NOT EXISTS (SELECT 1 FROM spec x WHERE x.source_file = s.source_file AND x.canonical = w.canonical)), "
    "pick AS (SELECT source_file, ordinal, ARG_MAX(canonical, n) AS canonical, COUNT(*) AS k FROM cand GROUP BY ALL), "
    "won AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source_file, canonical ORDER BY ordinal) AS turn FROM pick), "
    "res AS (SELECT s.source_file, s.ordinal, s.column_name, COALESCE(s.canonical, w.canonical) AS canonical, "
    "CASE WHEN s.canonical IS NOT NULL THEN s.tier WHEN w.canonical IS NOT NULL THEN 'weak' END AS tier, s.ignored FROM spec s "
    "LEFT JOIN won w ON w.source_file = s.source_file AND w.ordinal = s.ordinal AND w.turn = 1), "
    "out AS (SELECT r.source_file, r.ordinal, r.column_name, CASE WHEN ignored THEN 'ignored' WHEN r.canonical IS NOT NULL THEN 'resolved' ELSE 'unknown' END AS status, "
    "r.tier, r.canonical, v.domain, v.role, v.dtype, v.unit AS expected_unit, active_domains FROM res r LEFT JOIN voc v ON v.canonical = r.canonical "
    "JOIN act ON act.source_file = r.source_file) "
)


def reconciled(spark, sf) -> DataFrame:
    return schema.reconcile(vendor_headers(spark, sf), schema.vocabulary(spark))


suite.add("schema_reconcile", lambda spark, sf: reconciled(spark, sf).drop("candidates"), RECONCILE_SQL + "SELECT * FROM out")
suite.add(
    "schema_unit_text",
    lambda spark, sf: reconciled(spark, sf).filter("status = 'resolved'").select(
        "source_file", "canonical", schema.unit_text(F.col("expected_unit")).alias("unit")
    ),
    RECONCILE_SQL + "SELECT source_file, canonical, COALESCE(expected_unit, 'missing') AS unit FROM out WHERE status = 'resolved'",
)
_MANIFEST_SQL = RECONCILE_SQL + (
    ", man AS (SELECT a.source_file, v.canonical, v.domain, CASE WHEN EXISTS (SELECT 1 FROM out o WHERE o.source_file = a.source_file "
    "AND o.canonical = v.canonical) THEN 'present' ELSE 'absent' END AS presence, EXISTS (SELECT 1 FROM active x WHERE x.source_file = a.source_file "
    "AND x.domain = v.domain) AS in_active_domain FROM act a, voc v) "
)
_manifest = lambda spark, sf: schema.presence_manifest(reconciled(spark, sf), schema.vocabulary(spark))
suite.add("schema_presence_manifest", _manifest, _MANIFEST_SQL + "SELECT * FROM man")
suite.add(
    "schema_absent_in_active_domains",
    lambda spark, sf: schema.absent_in_scope(_manifest(spark, sf)),
    _MANIFEST_SQL + "SELECT source_file, canonical, domain FROM man WHERE presence = 'absent' AND in_active_domain",
)


def intake_signals(spark, sf) -> DataFrame:
    """Row counts, header matches and constant columns per file."""
    fv = fleet_view(spark, sf).withColumn("source_file", F.concat_ws("/", "client_id", "equipment_id"))
    rows = fv.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("row_count"),
        (F.lit(0) + sum([(F.min(c) == F.max(c)).cast("int") for c in _VENDOR_COLUMNS])).alias("constant_columns"),
    )
    matched = reconciled(spark, sf).groupBy("source_file").agg(
        F.count_if(F.col("status") == "resolved").alias("matched_columns"),
        F.count_if(F.col("status") != "ignored").alias("candidate_columns"),
        F.count(F.lit(1)).alias("column_count"),
    )
    return rows.join(matched, "source_file").withColumn("peer_graph", F.lit(False))


_INTAKE_SQL = RECONCILE_SQL + (
    ", m AS (SELECT source_file, COUNT(*) FILTER (WHERE status = 'resolved') AS hit, COUNT(*) FILTER (WHERE status <> 'ignored') AS cand FROM out GROUP BY 1), "
    "v AS (SELECT source_file, CASE WHEN hit / GREATEST(cand, 1) >= 0.6 THEN 'accept' ELSE 'quarantine' END AS verdict, "
    "ROUND(hit / GREATEST(cand, 1), 2) AS confidence, CASE WHEN hit / GREATEST(cand, 1) >= 0.6 THEN 'headers match canonical fields' "
    "WHEN hit > 0 THEN 'header match below the accept threshold' ELSE 'no recognised header' END AS reason FROM m) "
)
suite.add("quality_intake_verdict", lambda spark, sf: quality.intake_verdict(intake_signals(spark, sf)), _INTAKE_SQL + "SELECT * FROM v")
suite.add(
    "quality_prefix_routing",
    lambda spark, sf: quality.intake_verdict(intake_signals(spark, sf)).select(
        "source_file", F.when(F.col("verdict") == "accept", "approved").when(F.col("verdict") == "reject", "rejected").otherwise("quarantine").alias("prefix")
    ).groupBy("prefix").agg(F.count(F.lit(1)).alias("files")),
    _INTAKE_SQL + "SELECT CASE verdict WHEN 'accept' THEN 'approved' ELSE verdict END AS prefix, COUNT(*) AS files FROM v GROUP BY 1",
)

_CLASS_SQL = (
    "CASE WHEN REGEXP_MATCHES(column_name, '(_id|_code|_num|_no)$') THEN 'entity' WHEN column_name IN ('timestamp', 'time-stamp', 'Time Stamp', "
    "'load_start_time', 'dump_time') THEN 'datetime' ELSE 'metric' END"
)


def _typed_headers(spark, sf) -> DataFrame:
    dates = ["timestamp", "time-stamp", "Time Stamp", "load_start_time", "dump_time"]
    kind = F.when(F.col("column_name").isin(*dates), "datetime").otherwise("float")
    return vendor_headers(spark, sf).select("source_file", F.col("column_name").alias("column"), kind.alias("type"))


suite.add(
    "schema_classification",
    lambda spark, sf: schema.classify_columns(_typed_headers(spark, sf)).groupBy("source_file", "classification").agg(
        F.array_join(F.array_sort(F.collect_set("column")), ",").alias("columns")
    ),
    f"WITH {VENDOR_SQL} SELECT source_file, {_CLASS_SQL} AS classification, STRING_AGG(DISTINCT column_name, ',' ORDER BY column_name) AS columns "
    "FROM headers GROUP BY ALL",
)


@suite.query(
    "schema_column_roles",
    RECONCILE_SQL + "SELECT source_file, column_name AS \"column\", COALESCE(role, CASE WHEN REGEXP_MATCHES(column_name, '(_id|_code|_num|_no)$') "
    "THEN 'entity' ELSE 'metric' END) AS role FROM out WHERE status <> 'ignored'",
)
def _roles(spark, sf):
    known = reconciled(spark, sf).filter("status <> 'ignored'").select(
        "source_file", F.col("column_name").alias("column"), F.col("role").alias("canonical_role"),
        F.lit(None).cast("string").alias("classified_role"), F.lit("float").alias("type"),
    )
    return schema.column_roles(known).select("source_file", "column", "role")


@suite.query(
    "schema_timestamp_pairs",
    f"WITH {VENDOR_SQL} SELECT s.source_file, s.column_name AS start_column, e.column_name AS end_column FROM headers s JOIN headers e "
    "ON e.source_file = s.source_file WHERE s.column_name IN ('timestamp', 'time-stamp', 'Time Stamp', 'load_start_time', 'dump_time') AND e.column_name IN "
    "('timestamp', 'time-stamp', 'Time Stamp', 'load_start_time', 'dump_time') AND s.column_name <> e.column_name AND "
    f"REGEXP_MATCHES(s.column_name, '{'|'.join(schema.START_WORDS)}') AND REGEXP_MATCHES(e.column_name, '{'|'.join(schema.END_WORDS)}')",
)
def _pairs(spark, sf):
    dated = _typed_headers(spark, sf).filter("type = 'datetime'").select("source_file", F.col("column").alias("column_name"))
    return schema.timestamp_pairs(dated)


def _section_case(column: str) -> str:
    whens = " ".join(
        f"WHEN REGEXP_MATCHES(LOWER({column}), '{'|'.join(f)}') THEN '{s}'" for s, f in schema.SECTION_FRAGMENTS.items()
    )
    return f"CASE {whens} END"


suite.add(
    "schema_column_sections",
    lambda spark, sf: vendor_headers(spark, sf).select("source_file", "column_name", schema.column_section(F.col("column_name")).alias("section")),
    f"WITH {VENDOR_SQL} SELECT source_file, column_name, {_section_case('column_name')} AS section FROM headers",
)

KPI_ALIASES = {
    "payload_tonnes": ("tonnage",), "fuel_litres": ("fuel_volume_l",), "cycle_time_min": ("cycle_duration_min",), "operating_hours": ("engine_hours",),
}
_VARIABLES = sorted({c for k in REGISTRY.values() for c in k.required})
_KNOWN = [(v, a, str(int(v != a))) for v in _VARIABLES for a in [v, *KPI_ALIASES.get(v, [])]]


@suite.query(
    "schema_map_kpi_variables",
    f"WITH {VENDOR_SQL}, k0(variable, alias, is_alias) AS {_values(_KNOWN)}, k AS (SELECT *, {_KEY.format('alias')} AS akey FROM k0), "
    f"c AS (SELECT source_file, column_name, variable, MIN(LEVENSHTEIN({_KEY.format('column_name')}, akey) * 10 + CAST(is_alias AS INT)) AS cost FROM headers, k "
    f"WHERE LEVENSHTEIN({_KEY.format('column_name')}, akey) <= 2 GROUP BY ALL), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source_file, column_name "
    "ORDER BY cost, variable) AS a, ROW_NUMBER() OVER (PARTITION BY source_file, variable ORDER BY cost, column_name) AS b FROM c) "
    "SELECT source_file, variable, column_name, CASE WHEN cost < 10 THEN 'alias' ELSE 'similar' END AS match FROM r WHERE a = 1 AND b = 1",
)
def _map_variables(spark, sf):
    offered = vendor_headers(spark, sf).select("source_file", "column_name", F.lit(True).alias("is_numeric"))
    return schema.map_kpi_variables(offered, KPI_ALIASES)


@suite.query(
    "schema_direct_kpi_columns",
    f"WITH fv AS ({fleet_sql(['client_id', 'equipment_id', 'idle_hours'])}) SELECT client_id || '/' || equipment_id AS source_file, "
    "'Idle Rate' AS column_name, 'idle_rate' AS kpi FROM fv GROUP BY ALL HAVING MAX(idle_hours) <> 0",
)
def _direct_columns(spark, sf):
    flags = fleet_view(spark, sf).groupBy(F.concat_ws("/", "client_id", "equipment_id").alias("source_file")).agg(F.max("idle_hours").alias("h"))
    offered = flags.select("source_file", F.explode(F.when(F.col("h") != 0, F.array(F.lit("Idle Rate"), F.lit("mystery"))).otherwise(F.array(F.lit("mystery")))).alias("column_name"))
    return schema.direct_kpi_columns(offered)


def facts(spark, sf) -> DataFrame:
    """Per file: entity, date and metric columns, computable KPIs, date pairs and size."""
    classified = schema.classify_columns(_typed_headers(spark, sf))
    pick = lambda kind: F.array_sort(F.collect_set(F.when(F.col("classification") == kind, F.col("column"))))
    per_file = classified.groupBy("source_file").agg(
        pick("entity").alias("entities"), pick("datetime").alias("dates"), pick("metric").alias("metrics"), F.count(F.lit(1)).alias("column_count")
    )
    dated = classified.filter("type = 'datetime'").select("source_file", F.col("column").alias("column_name"))
    pairs = schema.timestamp_pairs(dated).groupBy("source_file").agg(F.array_sort(F.collect_list(F.struct("start_column", "end_column"))).alias("pairs"))
    sizes = fleet_view(spark, sf).groupBy(F.concat_ws("/", "client_id", "equipment_id").alias("source_file")).agg(F.count(F.lit(1)).alias("row_count"))
    empty_pairs = F.expr("CAST(array() AS array<struct<start_column: string, end_column: string>>)")
    return per_file.join(sizes, "source_file").join(pairs, "source_file", "left").select(
        "source_file", "entities", "dates", "metrics", "column_count", "row_count", F.coalesce("pairs", empty_pairs).alias("pairs"),
        F.array(F.lit("fuel_efficiency"), F.lit("idle_rate")).alias("kpis"),
    )


_FACTS_SQL = (
    f"WITH {VENDOR_SQL}, c AS (SELECT DISTINCT source_file, column_name, {_CLASS_SQL} AS kind FROM headers), f AS (SELECT source_file, "
    "MIN(column_name) FILTER (WHERE kind = 'entity') AS e1, MIN(column_name) FILTER (WHERE kind = 'metric') AS m1, MIN(column_name) FILTER (WHERE kind = 'datetime') AS d1, "
    "STRING_AGG(column_name, ', ' ORDER BY column_name) FILTER (WHERE kind = 'entity') AS es, STRING_AGG(column_name, ', ' ORDER BY column_name) FILTER (WHERE kind = 'metric') AS ms, "
    "STRING_AGG(column_name, ', ' ORDER BY column_name) FILTER (WHERE kind = 'datetime') AS ds, COUNT(*) AS n FROM c GROUP BY source_file), "
    "z AS (SELECT client_id || '/' || equipment_id AS source_file, COUNT(*) AS row_count FROM fv GROUP BY 1) "
)
suite.add(
    "schema_recommendations",
    lambda spark, sf: schema.recommendations(facts(spark, sf)).filter("recommendation NOT LIKE 'Measure the time%'").select("source_file", "recommendation"),
    _FACTS_SQL + "SELECT * FROM (SELECT source_file, 'Ready to compute: fuel_efficiency, idle_rate.' AS recommendation FROM f UNION ALL "
    "SELECT source_file, 'Order ' || e1 || ' by ' || m1 || ' and look at both ends.' FROM f UNION ALL "
    "SELECT source_file, 'Follow ' || m1 || ' along ' || d1 || ', weekly or monthly, for its direction.' FROM f UNION ALL "
    "SELECT source_file, 'Check ' || m1 || ' for extreme values' || COALESCE(' within each ' || e1, '') || '.' FROM f) WHERE recommendation IS NOT NULL",
)
suite.add(
    "schema_summary_text",
    lambda spark, sf: schema.summary_text(facts(spark, sf)),
    _FACTS_SQL + "SELECT f.source_file, CONCAT_WS(' ', '''' || f.source_file || ''' — ' || row_count || ' rows, ' || n || ' columns.', "
    "'Identifiers: ' || es || '.', 'Times: ' || ds || '.', 'Measures: ' || ms || '.', "
    "'KPIs at hand: fuel_efficiency, idle_rate.') AS summary FROM f JOIN z ON z.source_file = f.source_file",
)
