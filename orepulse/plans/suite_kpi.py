"""KPI queries: every KPI whole and per equipment, and the engine's options."""

from __future__ import annotations

from pyspark.sql import functions as F

from orepulse.operators.kpi import (
    REGISTRY,
    SECTION_KPIS,
    assess_feasibility,
    calculate_kpi,
    rollup_kpis,
)
from orepulse.operators.schema import kpi_section_column
from orepulse.plans.suite import Suite
from orepulse.sources.tables import fleet_sql, fleet_view

suite = Suite()


def sql_total(column: str) -> str:
    return f"COALESCE(CAST(SUM(CAST({column} AS DECIMAL(18,4))) AS DOUBLE), 0.0)"


def sql_divide(top: str, bottom: str, scale: str = "1") -> str:
    return f"CASE WHEN ABS({bottom}) > 1e-9 THEN ROUND({top} / {bottom} * {scale}, 3) ELSE 0.0 END"


def kpi_sql(name: str) -> str:
    """SQL text of a KPI's aggregate."""
    kpi = REGISTRY[name]
    t = [sql_total(c) for c in kpi.required]
    special = {
        "mean_cycle_time": "ROUND(CAST(AVG(CAST(cycle_time_min AS DECIMAL(18,4))) AS DOUBLE), 2)",
        "total_tonnes_moved": f"ROUND({t[0]}, 1)",
        "payload_accuracy": (
            "ROUND(AVG(ABS(payload_tonnes - target_payload_tonnes) / NULLIF(target_payload_tonnes, 0)) * 100, 1)"
        ),
    }
    if name in special:
        return special[name]
    if name in ("mean_time_between_failures", "mean_time_to_repair"):
        return sql_divide(t[0], f"GREATEST({t[1]}, 1.0)")
    if name in ("dust_compliance_rate", "speed_compliance_rate"):
        return sql_divide(f"({t[0]} - {t[1]})", t[0], "100")
    if name == "carbon_intensity":
        return sql_divide(f"({t[0]} / 1000)", t[1])
    scale = kpi.formula.rsplit("* ", 1)[1] if ") *" in kpi.formula else "1"
    return sql_divide(t[0], t[1], scale)


def _columns(names: list[str]) -> list[str]:
    return list(dict.fromkeys(c for n in names for c in REGISTRY[n].required))


def long_sql(names: list[str], group: str | None = None, where: str = "") -> str:
    columns = ([group] if group else []) + [c for c in _columns(names) if c != group]
    extra = ["shift", "payload_tonnes"] if where else []
    inner = fleet_sql(list(dict.fromkeys(columns + extra)))
    key = f"CAST({group} AS VARCHAR) AS group_value, " if group else ""
    tail = f" GROUP BY {group}" if group else ""
    wide = f"SELECT {key}{', '.join(f'{kpi_sql(n)} AS {n}' for n in names)} FROM fv {where}{tail}"
    shown = "group_value, " if group else ""
    parts = [
        f"SELECT {shown}'{n}' AS kpi, {n} AS value, '{REGISTRY[n].unit}' AS unit, 'computed' AS status FROM wide" for n in names
    ]
    return f"WITH fv AS ({inner}), wide AS ({wide}) {' UNION ALL '.join(parts)}"


def _register_each() -> None:
    for name in REGISTRY:
        suite.add(
            f"kpi_{name}",
            lambda spark, sf, n=name: calculate_kpi(fleet_view(spark, sf), [n]).drop("error"),
            long_sql([name]),
        )
        suite.add(
            f"kpi_{name}_by_equipment",
            lambda spark, sf, n=name: calculate_kpi(fleet_view(spark, sf), [n], group_by="equipment_id").drop("error"),
            long_sql([name], "equipment_id"),
        )


_register_each()
ALL = list(REGISTRY)

suite.add("kpi_all", lambda spark, sf: calculate_kpi(fleet_view(spark, sf)).drop("error"), long_sql(ALL))
suite.add(
    "kpi_all_by_client",
    lambda spark, sf: calculate_kpi(fleet_view(spark, sf), group_by="client_id").drop("error"),
    long_sql(ALL, "client_id"),
)
suite.add(
    "kpi_flagship",
    lambda spark, sf: calculate_kpi(
        fleet_view(spark, sf), ["fuel_efficiency", "idle_rate", "total_tonnes_moved"], group_by="equipment_id"
    ).drop("error"),
    long_sql(["fuel_efficiency", "idle_rate", "total_tonnes_moved"], "equipment_id"),
)
suite.add(
    "kpi_filter_expr",
    lambda spark, sf: calculate_kpi(
        fleet_view(spark, sf), ["fuel_efficiency", "overload_rate"],
        filter_expr="shift = 'Day' AND payload_tonnes > 10", group_by="equipment_id",
    ).drop("error"),
    long_sql(["fuel_efficiency", "overload_rate"], "equipment_id", "WHERE shift = 'Day' AND payload_tonnes > 10"),
)


@suite.query(
    "kpi_filter_keeps_nulls",
    "WITH fv AS (SELECT NULLIF(l_returnflag, 'N') AS flag, l_quantity FROM lineitem) "
    "SELECT COALESCE(flag, '-') AS flag, COUNT(*) AS n FROM fv WHERE flag IS DISTINCT FROM 'R' GROUP BY flag",
)
def _filter_keeps_nulls(spark, sf):
    from orepulse.sources.tables import table

    fv = table(spark, sf, "lineitem").select(F.expr("nullif(l_returnflag, 'N')").alias("flag"))
    kept = fv.filter("NOT (flag <=> 'R')")
    return kept.groupBy("flag").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("flag", F.lit("-")).alias("flag"), "n")


@suite.query(
    "kpi_errors",
    f"WITH fv AS ({fleet_sql(['distance_km', 'fuel_litres'])}) "
    f"SELECT 'fuel_efficiency' AS kpi, {kpi_sql('fuel_efficiency')} AS value, 'computed' AS status, CAST(NULL AS VARCHAR) AS error "
    "FROM fv UNION ALL SELECT 'idle_rate', NULL, 'error', 'Missing columns: engine_on_hours, idle_hours' "
    "UNION ALL SELECT 'no_such_kpi', NULL, 'error', 'Unknown KPI ''no_such_kpi'''",
)
def _errors(spark, sf):
    fv = fleet_view(spark, sf).drop("engine_on_hours", "idle_hours")
    return calculate_kpi(fv, ["fuel_efficiency", "idle_rate", "no_such_kpi"]).drop("unit")


@suite.query(
    "kpi_variable_rename",
    f"WITH fv AS ({fleet_sql(['equipment_id', 'distance_km', 'total_cost'])}) "
    f"SELECT equipment_id AS group_value, {kpi_sql('cost_per_km')} AS value FROM fv GROUP BY equipment_id",
)
def _rename(spark, sf):
    fv = fleet_view(spark, sf).withColumnsRenamed({"distance_km": "km", "total_cost": "spend"})
    mapped = calculate_kpi(
        fv, ["cost_per_km"], group_by="equipment_id", column_mapping={"distance_km": "km", "total_cost": "spend", "fuel_litres": "gone"}
    )
    return mapped.select("group_value", "value")


@suite.query(
    "kpi_direct_column",
    "SELECT 'fuel_efficiency' AS kpi, ROUND(AVG(l_discount), 3) AS value FROM lineitem UNION ALL "
    f"SELECT 'total_tonnes_moved', ROUND({sql_total('l_quantity')}, 3) FROM lineitem",
)
def _direct(spark, sf):
    from orepulse.sources.tables import table

    held = calculate_kpi(
        table(spark, sf, "lineitem"), ["fuel_efficiency", "total_tonnes_moved"],
        direct_columns={"fuel_efficiency": "l_discount", "total_tonnes_moved": "l_quantity"}, direct_totals=True,
    )
    return held.select("kpi", "value")


_LEVELS = ["fuel_efficiency", "total_tonnes_moved"]


@suite.query(
    "kpi_rollup_client_equipment",
    f"WITH fv AS ({fleet_sql(['client_id', 'equipment_id', *_columns(_LEVELS)])}), wide AS ("
    f"SELECT client_id, equipment_id, GROUPING(client_id, equipment_id) AS level, "
    f"{', '.join(f'{kpi_sql(n)} AS {n}' for n in _LEVELS)} FROM fv GROUP BY ROLLUP (client_id, equipment_id)) "
    + " UNION ALL ".join(
        f"SELECT CAST(level AS BIGINT) AS level, client_id, equipment_id, '{n}' AS kpi, {n} AS value FROM wide" for n in _LEVELS
    ),
)
def _rollup(spark, sf):
    rolled = rollup_kpis(fleet_view(spark, sf), _LEVELS, ["client_id", "equipment_id"])
    return rolled.withColumn("level", F.col("level").cast("bigint"))


def reported_columns(spark, sf, columns: list[str]):
    """Headers each equipment reports: the columns with any non-zero value."""
    flags = fleet_view(spark, sf).groupBy(F.col("equipment_id").alias("source_file")).agg(
        *[F.max(F.col(c) != 0).alias(c) for c in columns]
    )
    return flags.unpivot(["source_file"], columns, "column_name", "reported").filter("reported").drop("reported")


_REPORTED = [
    "distance_km", "fuel_litres", "idle_hours", "engine_on_hours", "on_time_services", "total_scheduled_services",
    "pre_shift_checks_done", "pre_shift_checks_due", "idle_co2_grams", "co2_grams", "payload_tonnes", "operating_hours",
]


def reported_sql(columns: list[str]) -> str:
    """CTE bodies ``fv`` and ``headers`` of the same."""
    union = " UNION ALL ".join(
        f"SELECT equipment_id AS source_file, '{c}' AS column_name FROM fv GROUP BY equipment_id HAVING MAX({c}) <> 0" for c in columns
    )
    return f"fv AS ({fleet_sql(['equipment_id', *columns])}), headers AS ({union})"


_REQUIRED = ", ".join(f"('{k.name}', '{c}')" for k in REGISTRY.values() for c in k.required)


@suite.query(
    "kpi_feasibility",
    f"WITH {reported_sql(_REPORTED)}, required(kpi, column_name) AS (VALUES {_REQUIRED}), "
    "every AS (SELECT f.source_file, r.kpi, r.column_name FROM (SELECT DISTINCT source_file FROM headers) f, required r) "
    "SELECT e.source_file, e.kpi, COUNT(h.column_name) = COUNT(*) AS feasible, "
    "COALESCE(STRING_AGG(CASE WHEN h.column_name IS NULL THEN e.column_name END, ',' ORDER BY e.column_name), '') AS missing_columns "
    "FROM every e LEFT JOIN headers h ON h.source_file = e.source_file AND h.column_name = e.column_name "
    "GROUP BY e.source_file, e.kpi",
)
def _feasibility(spark, sf):
    return assess_feasibility(reported_columns(spark, sf, _REPORTED))


_SECTIONS = ", ".join(f"('{n}', '{s}')" for s, names in SECTION_KPIS.items() for n in names)


@suite.query(
    "kpi_section_values",
    f"WITH long AS ({long_sql(ALL, 'client_id')}), sections(kpi, section) AS (VALUES {_SECTIONS}) "
    "SELECT group_value AS client_id, section, l.kpi, value, unit FROM long l JOIN sections s ON s.kpi = l.kpi",
)
def _section_values(spark, sf):
    computed = calculate_kpi(fleet_view(spark, sf), group_by="client_id")
    placed = computed.withColumn("section", kpi_section_column(F.col("kpi"))).filter("section IS NOT NULL")
    return placed.select(F.col("group_value").alias("client_id"), "section", "kpi", "value", "unit")
