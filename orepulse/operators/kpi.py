"""The KPI registry and its one-pass engine."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def total(column: str) -> str:
    """Null-skipping sum as SQL; 0 when there is nothing to add."""
    return f"coalesce(sum(CAST(`{column}` AS DOUBLE)), 0.0D)"


def safe_divide(numerator: str, denominator: str, scale: float = 1) -> str:
    """``numerator / denominator * scale`` to 3 decimals, 0.0 on a vanishing denominator, as SQL."""
    return (
        f"CASE WHEN abs({denominator}) > 1e-9 THEN round({numerator} / {denominator} * {scale:g}, 3) ELSE 0.0D END"
    )


@dataclass(frozen=True)
class Kpi:
    name: str
    unit: str
    description: str
    formula: str
    required: tuple[str, ...]
    aggregate: str | Callable[[], Column]
    """SQL aggregate expression, or a function giving an aggregate column (a grouped pandas UDF for example)."""

    def column(self) -> Column:
        return F.expr(self.aggregate) if isinstance(self.aggregate, str) else self.aggregate()


REGISTRY: dict[str, Kpi] = {}


def register(kpi: Kpi) -> Kpi:
    """Add a KPI; any aggregate ``Column`` over ``required`` columns will do."""
    REGISTRY[kpi.name] = kpi
    return kpi


# Name, numerator total, denominator total, scale, unit, description.
_RATIOS = (
    ("fuel_efficiency", "distance_km", "fuel_litres", 1, "km/L", "Distance driven per litre of fuel"),
    ("vehicle_utilization", "active_hours", "scheduled_hours", 100, "%", "Share of scheduled hours spent active"),
    ("fleet_availability", "available_hours", "scheduled_hours", 100, "%", "Share of scheduled hours available"),
    ("haul_truck_productivity", "payload_tonnes", "operating_hours", 1, "t/hr", "Payload hauled per operating hour"),
    ("payload_utilization", "payload_tonnes", "target_payload_tonnes", 100, "%", "Payload against target payload"),
    ("fuel_consumption_rate", "fuel_litres", "operating_hours", 1, "L/hr", "Fuel burnt per operating hour"),
    ("cost_per_km", "total_cost", "distance_km", 1, "$/km", "Operating cost per kilometre"),
    ("idle_rate", "idle_hours", "engine_on_hours", 100, "%", "Share of engine hours spent idling"),
    ("on_time_delivery", "on_time_deliveries", "total_deliveries", 100, "%", "Deliveries made on time"),
    ("unplanned_downtime_rate", "downtime_hours", "scheduled_hours", 100, "%", "Scheduled hours lost to downtime"),
    ("planned_maintenance_compliance", "pm_completed", "pm_scheduled", 100, "%", "Planned maintenance carried out"),
    ("maintenance_compliance", "on_time_services", "total_scheduled_services", 100, "%", "Services done on time"),
    ("oil_sample_compliance", "oil_samples_taken", "oil_samples_due", 100, "%", "Due oil samples taken"),
    ("fatigue_event_rate", "fatigue_events", "operating_hours", 1000, "events/1000hr", "Fatigue events per 1000 operating hours"),
    ("speeding_rate", "speed_violations", "distance_km", 100, "violations/100km", "Speed violations per 100 km"),
    ("seatbelt_compliance", "seatbelt_compliant_time", "engine_on_hours", 100, "%", "Engine hours with the seatbelt on"),
    ("near_miss_rate", "near_misses", "operating_hours", 1000, "events/1000hr", "Near misses per 1000 operating hours"),
    ("unsafe_behaviour_rate", "unsafe_events", "operating_hours", 1000, "events/1000hr", "Unsafe acts per 1000 operating hours"),
    ("co2_per_km", "co2_grams", "distance_km", 1, "g/km", "CO2 emitted per kilometre"),
    ("water_intensity", "water_litres", "tonnes_moved", 1, "L/t", "Water used per tonne moved"),
    ("idle_emission_contribution", "idle_co2_grams", "co2_grams", 100, "%", "Share of CO2 emitted while idling"),
    ("tonnes_per_hour", "payload_tonnes", "operating_hours", 1, "t/hr", "Tonnes hauled per operating hour"),
    ("tonnes_per_litre", "payload_tonnes", "fuel_litres", 1, "t/L", "Tonnes hauled per litre of fuel"),
    ("overload_rate", "overloaded_loads", "load_count", 100, "%", "Loads above the rated payload"),
    ("mean_haul_distance", "haul_distance_km", "trip_count", 1, "km", "Distance per haul"),
    ("route_deviation_rate", "route_deviations", "trip_count", 100, "events/100 trips", "Route deviations per 100 trips"),
    ("geofence_violation_rate", "geofence_violations", "trip_count", 100, "events/100 trips", "Geofence violations per 100 trips"),
    ("queue_time_ratio", "queue_time_min", "cycle_time_min", 100, "%", "Share of the cycle spent queueing"),
    ("pre_shift_inspection_rate", "pre_shift_checks_done", "pre_shift_checks_due", 100, "%", "Pre-shift checks carried out"),
    ("license_compliance_rate", "operators_licensed", "operators_total", 100, "%", "Operators holding a licence"),
    ("training_completion_rate", "training_completed_count", "training_required_count", 100, "%", "Required training completed"),
    ("incident_reporting_rate", "incidents_reported", "incidents_total", 100, "%", "Incidents that were reported"),
    ("work_order_backlog_ratio", "open_work_orders", "target_work_orders", 1, "ratio", "Open work orders against target"),
    ("pm_schedule_adherence", "pm_completed", "pm_scheduled", 100, "%", "Adherence to the maintenance schedule"),
    ("defect_capture_rate", "work_orders_created", "defects_raised", 100, "%", "Defects turned into work orders"),
    ("parts_availability_rate", "parts_available", "parts_required", 100, "%", "Required parts on hand"),
    ("prediction_accuracy", "correct_predictions", "total_predictions", 100, "%", "Predictions that were right"),
    ("anomaly_detection_precision", "anomalies_confirmed", "anomalies_detected", 100, "%", "Detected anomalies confirmed"),
    ("recommendation_adoption_rate", "recommendations_adopted", "recommendations_total", 100, "%", "Recommendations adopted"),
)


def _register_ratio(name: str, top: str, bottom: str, scale: float, unit: str, description: str) -> None:
    factor = "" if scale == 1 else f" * {scale:g}"
    register(
        Kpi(
            name,
            unit,
            description,
            f"sum({top}) / sum({bottom}){factor}",
            (top, bottom),
            safe_divide(total(top), total(bottom), scale),
        )
    )


def _register_all() -> None:
    for ratio in _RATIOS:
        _register_ratio(*ratio)

    def per_failure(top: str) -> str:
        return safe_divide(total(top), f"greatest({total('failure_count')}, 1.0D)")

    def share_without(whole: str, part: str) -> str:
        return safe_divide(f"({total(whole)} - {total(part)})", total(whole), 100)

    mean_cycle = "round(avg(CAST(cycle_time_min AS DOUBLE)), 2)"
    accuracy = (
        "round(avg(abs(payload_tonnes - target_payload_tonnes) / nullif(CAST(target_payload_tonnes AS DOUBLE), 0.0D)) * 100, 1)"
    )

    specials = [
        Kpi("mean_cycle_time", "min", "Mean haul cycle time", "mean(cycle_time_min)", ("cycle_time_min",), mean_cycle),
        Kpi(
            "mean_time_between_failures",
            "hr",
            "Operating hours per failure",
            "sum(operating_hours) / max(sum(failure_count), 1)",
            ("operating_hours", "failure_count"),
            per_failure("operating_hours"),
        ),
        Kpi(
            "mean_time_to_repair",
            "hr",
            "Repair hours per failure",
            "sum(repair_time_hours) / max(sum(failure_count), 1)",
            ("repair_time_hours", "failure_count"),
            per_failure("repair_time_hours"),
        ),
        Kpi(
            "carbon_intensity",
            "kg CO₂/t",
            "CO2 emitted per tonne moved",
            "sum(co2_grams) / 1000 / sum(tonnes_moved)",
            ("co2_grams", "tonnes_moved"),
            safe_divide(f"({total('co2_grams')} / 1000)", total("tonnes_moved")),
        ),
        Kpi(
            "dust_compliance_rate",
            "%",
            "Dust readings within the threshold",
            "(sum(dust_readings) - sum(dust_threshold_breaches)) / sum(dust_readings) * 100",
            ("dust_readings", "dust_threshold_breaches"),
            share_without("dust_readings", "dust_threshold_breaches"),
        ),
        Kpi(
            "total_tonnes_moved",
            "t",
            "Tonnes hauled",
            "sum(payload_tonnes)",
            ("payload_tonnes",),
            f"round({total('payload_tonnes')}, 1)",
        ),
        Kpi(
            "payload_accuracy",
            "%",
            "Mean deviation of payload from target",
            "mean(abs(payload_tonnes - target_payload_tonnes) / target_payload_tonnes) * 100",
            ("payload_tonnes", "target_payload_tonnes"),
            accuracy,
        ),
        Kpi(
            "speed_compliance_rate",
            "%",
            "Engine hours within the speed limit",
            "(sum(engine_on_hours) - sum(speeding_hours)) / sum(engine_on_hours) * 100",
            ("engine_on_hours", "speeding_hours"),
            share_without("engine_on_hours", "speeding_hours"),
        ),
    ]
    for kpi in specials:
        register(kpi)


_register_all()

# The dashboard section of each KPI, sections in display order.
SECTION_KPIS = {
    "fleet": (
        "fleet_availability", "vehicle_utilization", "mean_cycle_time", "idle_rate", "on_time_delivery",
    ),
    "maintenance": (
        "mean_time_between_failures", "mean_time_to_repair", "unplanned_downtime_rate", "planned_maintenance_compliance", "maintenance_compliance",
        "oil_sample_compliance", "work_order_backlog_ratio", "pm_schedule_adherence", "defect_capture_rate", "parts_availability_rate",
    ),
    "kpis": (
        "pre_shift_inspection_rate", "license_compliance_rate", "training_completion_rate", "incident_reporting_rate", "prediction_accuracy",
        "anomaly_detection_precision", "recommendation_adoption_rate",
    ),
    "load_and_tonnage": (
        "total_tonnes_moved", "tonnes_per_hour", "haul_truck_productivity", "payload_utilization", "tonnes_per_litre", "overload_rate",
        "payload_accuracy",
    ),
    "fuel": (
        "fuel_efficiency", "fuel_consumption_rate", "cost_per_km", "co2_per_km", "carbon_intensity", "dust_compliance_rate", "water_intensity",
        "idle_emission_contribution",
    ),
    "gps_location": (
        "mean_haul_distance", "speed_compliance_rate", "route_deviation_rate", "geofence_violation_rate", "queue_time_ratio",
    ),
    "safety": (
        "fatigue_event_rate", "speeding_rate", "seatbelt_compliance", "near_miss_rate", "unsafe_behaviour_rate",
    ),
}


def kpi_section(kpi: str) -> str | None:
    return next((s for s, names in SECTION_KPIS.items() if kpi in names), None)


def rename_variables(df: DataFrame, mapping: Mapping[str, str] | None) -> DataFrame:
    """Rename ``{variable: actual column}`` where the actual column exists and differs."""
    renames = {a: v for v, a in (mapping or {}).items() if a and a != v and a in df.columns}
    return df.withColumnsRenamed(renames) if renames else df


def feasible_kpis(columns: Sequence[str], names: Sequence[str] | None = None) -> list[str]:
    have = set(columns)
    return [n for n in (names or REGISTRY) if n in REGISTRY and have.issuperset(REGISTRY[n].required)]



def calculate_kpi(
    df: DataFrame,
    names: Sequence[str] = ("*",),
    *,
    filter_expr: str | None = None,
    column_mapping: Mapping[str, str] | None = None,
    group_by: str | Sequence[str] | None = None,
    direct_columns: Mapping[str, str] | None = None,
    direct_totals: bool = False,
) -> DataFrame:
    """Long table of KPI values from one aggregation over ``df``.

    Unknown names and KPIs with missing columns become error rows while the others are still computed.
    ``group_by`` adds ``group_value`` (several columns: one output column each); null keys are dropped.
    ``direct_columns`` maps a KPI to a column that already holds it: its mean is taken, or its total
    for total-type KPIs when ``direct_totals``. An empty input gives error rows, never zeros.
    """
    df = rename_variables(df, column_mapping)
    if filter_expr:
        df = df.filter(F.expr(filter_expr))
    wanted = list(REGISTRY) if list(names) == ["*"] else list(dict.fromkeys(names))
    groups = [] if group_by is None else [group_by] if isinstance(group_by, str) else list(group_by)
    labels = ["group_value"] if len(groups) == 1 else groups

    computed: list[tuple[str, Column, str]] = []
    failed: list[tuple[str, str, str]] = []
    for name in wanted:
        direct = (direct_columns or {}).get(name)
        kpi = REGISTRY.get(name)
        if direct and direct in df.columns:
            value = total(direct) if direct_totals and name.startswith("total_") else f"avg(CAST(`{direct}` AS DOUBLE))"
            computed.append((name, F.expr(f"round({value}, 3)"), kpi.unit if kpi else ""))
        elif kpi is None:
            failed.append((name, "", f"Unknown KPI '{name}'"))
        else:
            missing = sorted(c for c in kpi.required if c not in df.columns)
            if missing:
                failed.append((name, kpi.unit, f"Missing columns: {', '.join(missing)}"))
            else:
                computed.append((name, kpi.column(), kpi.unit))

    keys = [F.col(g).cast("string").alias(label) for g, label in zip(groups, labels)]
    for g in groups:
        df = df.filter(F.col(g).isNotNull())
    measures = [c.alias(f"_k{i}") for i, (_, c, _) in enumerate(computed)] + [F.expr("count(1) AS _rows")]
    wide = df.groupBy(*keys).agg(*measures) if groups else df.agg(*measures)

    cell = "named_struct('kpi', {}, 'value', {}, 'unit', {}, 'status', {}, 'error', {})"
    cells = [
        cell.format(
            _text(n), f"CASE WHEN _rows > 0 THEN _k{i} END", _text(u), "if(_rows > 0, 'computed', 'error')",
            "if(_rows > 0, CAST(NULL AS STRING), 'No rows match the filter')",
        )
        for i, (n, _, u) in enumerate(computed)
    ]
    cells += [cell.format(_text(n), "CAST(NULL AS DOUBLE)", _text(u), "'error'", _text(problem)) for n, u, problem in failed]
    return wide.selectExpr(*(labels if groups else []), f"inline(array({', '.join(cells)}))")


def _text(value: str) -> str:
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def rollup_kpis(df: DataFrame, names: Sequence[str], levels: Sequence[str]) -> DataFrame:
    """KPIs at every level of a hierarchy (for example tenant, then equipment) in a single pass."""
    names = list(names)
    wide = df.rollup(*levels).agg(
        F.grouping_id().alias("level"), *[REGISTRY[n].column().alias(f"_k{i}") for i, n in enumerate(names)]
    )
    cells = [F.struct(F.lit(n).alias("kpi"), F.col(f"_k{i}").alias("value")) for i, n in enumerate(names)]
    return wide.select("level", *levels, F.inline(F.array(*cells)))


def kpi_catalogue(spark: SparkSession) -> DataFrame:
    rows = [(k.name, k.description, k.unit, k.formula, kpi_section(k.name)) for k in REGISTRY.values()]
    return spark.createDataFrame(rows, "kpi string, description string, unit string, formula string, section string")


def assess_feasibility(headers: DataFrame) -> DataFrame:
    """Which KPIs the columns of each file allow, and the sorted missing columns of the others.

    ``headers`` has ``(source_file, column_name)``. One set of names per file meets the registry's
    fixed requirements row by row, so nothing is joined.
    """
    have = headers.groupBy("source_file").agg(F.collect_set("column_name").alias("have"))
    cells = []
    for kpi in REGISTRY.values():
        missing = F.array_sort(F.array_except(F.array(*[F.lit(c) for c in dict.fromkeys(kpi.required)]), "have"))
        cells.append(F.struct(F.lit(kpi.name).alias("kpi"), missing.alias("missing")))
    return have.select("source_file", F.inline(F.array(*cells))).select(
        "source_file", "kpi", (F.size("missing") == 0).alias("feasible"), F.array_join("missing", ",").alias("missing_columns")
    )
