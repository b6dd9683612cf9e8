"""Readers of the parquet tables and the fleet view over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# How each fleet-view column is computed from lineitem l, orders o and part p.
FLEET_KEYS = {
    "cycle_id": "CAST(l.l_orderkey * 10 + l.l_linenumber AS BIGINT)",
    "order_key": "l.l_orderkey",
    "line_number": "l.l_linenumber",
    "part_key": "l.l_partkey",
    "supp_key": "l.l_suppkey",
    "equipment_id": "CONCAT('TRK-', CAST(l.l_suppkey AS STRING))",
    "client_id": "CONCAT('C', CAST(l.l_suppkey % 3 + 1 AS STRING))",
    "shift": "CASE WHEN l.l_linestatus = 'O' THEN 'Day' ELSE 'Night' END",
    "equipment_type": "p.p_type",
    "load_start_time": "o.o_orderdate",
    "dump_time": "l.l_shipdate",
}
FLEET_MEASURES = {
    "payload_tonnes": "l.l_quantity",
    "target_payload_tonnes": "p.p_size",
    "tonnes_moved": "l.l_quantity",
    "total_cost": "l.l_extendedprice",
    "distance_km": "p.p_size + l.l_linenumber",
    "fuel_litres": "l.l_quantity * 2 + l.l_linenumber",
    "scheduled_hours": "24",
    "active_hours": "l.l_partkey % 20",
    "available_hours": "12 + l.l_partkey % 12",
    "operating_hours": "1 + l.l_orderkey % 12",
    "engine_on_hours": "2 + l.l_orderkey % 12",
    "idle_hours": "l.l_suppkey % 3",
    "cycle_time_min": "20 + l.l_partkey % 50",
    "queue_time_min": "l.l_partkey % 15",
    "total_deliveries": "1 + l.l_linenumber",
    "on_time_deliveries": "l.l_linenumber",
    "failure_count": "CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END",
    "repair_time_hours": "CASE WHEN l.l_returnflag = 'R' THEN l.l_linenumber ELSE 0 END",
    "downtime_hours": "CASE WHEN l.l_returnflag = 'R' THEN l.l_linenumber * 2 ELSE 0 END",
    "pm_scheduled": "2",
    "pm_completed": "1 + l.l_suppkey % 2",
    "total_scheduled_services": "3",
    "on_time_services": "l.l_suppkey % 4",
    "oil_samples_due": "1",
    "oil_samples_taken": "l.l_orderkey % 2",
    "fatigue_events": "CASE WHEN l.l_orderkey % 17 = 0 THEN 1 ELSE 0 END",
    "speed_violations": "CASE WHEN l.l_orderkey % 5 = 0 THEN 1 ELSE 0 END",
    "speeding_hours": "CASE WHEN l.l_orderkey % 5 = 0 THEN 1 ELSE 0 END",
    "seatbelt_compliant_time": "1 + l.l_orderkey % 12",
    "near_misses": "CASE WHEN l.l_orderkey % 23 = 0 THEN 1 ELSE 0 END",
    "unsafe_events": "CASE WHEN l.l_orderkey % 29 = 0 THEN 1 ELSE 0 END",
    "co2_grams": "(l.l_quantity * 2 + l.l_linenumber) * 2680",
    "idle_co2_grams": "(l.l_suppkey % 3) * 1000",
    "dust_readings": "10",
    "dust_threshold_breaches": "l.l_partkey % 4",
    "water_litres": "l.l_quantity * 3",
    "load_count": "1",
    "overloaded_loads": "CASE WHEN l.l_quantity > p.p_size THEN 1 ELSE 0 END",
    "haul_distance_km": "p.p_size + l.l_linenumber",
    "trip_count": "1",
    "route_deviations": "CASE WHEN l.l_partkey % 11 = 0 THEN 1 ELSE 0 END",
    "geofence_violations": "CASE WHEN l.l_partkey % 13 = 0 THEN 1 ELSE 0 END",
    "pre_shift_checks_due": "1",
    "pre_shift_checks_done": "CASE WHEN l.l_suppkey % 9 <> 0 THEN 1 ELSE 0 END",
    "operators_total": "10",
    "operators_licensed": "8 + l.l_suppkey % 3",
    "training_required_count": "5",
    "training_completed_count": "3 + l.l_suppkey % 3",
    "incidents_total": "4",
    "incidents_reported": "2 + l.l_partkey % 3",
    "target_work_orders": "4",
    "open_work_orders": "l.l_partkey % 6",
    "defects_raised": "3",
    "work_orders_created": "l.l_partkey % 4",
    "parts_required": "5",
    "parts_available": "l.l_partkey % 6",
    "total_predictions": "10",
    "correct_predictions": "6 + l.l_orderkey % 5",
    "anomalies_detected": "4",
    "anomalies_confirmed": "l.l_orderkey % 5",
    "recommendations_total": "3",
    "recommendations_adopted": "l.l_orderkey % 4",
    "speed_kph": "l.l_linenumber * 5",
    "gps_x": "l.l_partkey % 100",
    "gps_y": "l.l_orderkey % 100",
    "failure_probability": "l.l_discount * 10",
    "tire_pressure_fl_psi": "90 + l.l_partkey % 10",
    "tire_pressure_fr_psi": "91 + l.l_partkey % 10",
    "tire_pressure_rl_psi": "92 + l.l_partkey % 10",
    "tire_pressure_rr_psi": "93 + l.l_partkey % 10",
}
FLEET_ORDER = ["order_key", "line_number", "part_key", "supp_key", "total_cost"]


def _fleet_expressions(columns: list[str] | None = None) -> dict[str, str]:
    everything = {**FLEET_KEYS, **{k: f"CAST({e} AS DOUBLE)" for k, e in FLEET_MEASURES.items()}}
    return everything if columns is None else {c: everything[c] for c in columns}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fleet_view(spark: SparkSession, folder: str) -> DataFrame:
    """One row per haul cycle. Unused columns are pruned down to the scans by Catalyst."""
    line = table(spark, folder, "lineitem").alias("l")
    orders = table(spark, folder, "orders").alias("o")
    part = table(spark, folder, "part").alias("p")
    joined = line.join(orders, F.col("o.o_orderkey") == F.col("l.l_orderkey")).join(
        part, F.col("p.p_partkey") == F.col("l.l_partkey")
    )
    return joined.selectExpr(*[f"{e} AS {name}" for name, e in _fleet_expressions().items()])


def fleet_sql(columns: list[str] | None = None) -> str:
    """The same view as ANSI SQL text, for oracle queries (``WITH fv AS (...)``)."""
    selected = ", ".join(f"{e} AS {name}" for name, e in _fleet_expressions(columns).items())
    return (
        f"SELECT {selected} FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey "
        "JOIN part p ON p.p_partkey = l.l_partkey"
    )
