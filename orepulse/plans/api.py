"""Row projections and counters behind the fleet screens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orepulse.functions.numbers import EXACT, exact_mean, exact_sum, lossless
from orepulse.operators.scans import ordered_scan

# Default pit zones (id, name, type, x, y, width, height).
PIT_ZONES = (
    ("z1", "Pit A", "pit", 10.0, 10.0, 30.0, 25.0),
    ("z2", "Dump B", "dump", 70.0, 15.0, 20.0, 20.0),
    ("z3", "Workshop", "workshop", 45.0, 60.0, 15.0, 15.0),
    ("z4", "Fuel Bay", "fuel-bay", 75.0, 60.0, 10.0, 10.0),
    ("z5", "Haul Road", "haul-road", 40.0, 35.0, 5.0, 30.0),
)


def number(df: DataFrame, *names: str, default: float = 0.0) -> Column:
    """First of the named columns that exists and holds a number."""
    found = [F.expr(f"try_cast(`{n}` AS DOUBLE)") for n in names if n in df.columns]
    return F.coalesce(*found, F.lit(float(default)))


def words(df: DataFrame, *names: str, default: str | Column = "") -> Column:
    found = [F.col(n).cast("string") for n in names if n in df.columns]
    return F.coalesce(*found, F.lit(default) if isinstance(default, str) else default)


def asset_type(df: DataFrame) -> Column:
    kind = F.lower(words(df, "asset_type", "equipment_type"))
    return (
        F.when(kind.contains("excavat"), "excavator")
        .when(kind.contains("loader"), "loader")
        .when(kind.contains("dozer"), "dozer")
        .otherwise("haul-truck")
    )


def fleet_status(df: DataFrame) -> Column:
    return (
        F.when(number(df, "idle_hours") > number(df, "active_hours", default=1), "idle")
        .when(number(df, "failure_count") > 0, "maintenance")
        .otherwise("active")
    )


def gps_status(df: DataFrame) -> Column:
    return F.when(number(df, "speed_kph") > 5, "moving").when(number(df, "idle_hours") > 2, "parked").otherwise("idle")


def _asset(df: DataFrame, row: str) -> tuple[Column, Column]:
    index = F.col(row).cast("string")
    return (
        words(df, "asset_id", "truck_id", "equipment_id", default=index),
        words(df, "asset_name", "truck_name", default=F.concat(F.lit("Truck-"), index)),
    )


def fleet_assets(df: DataFrame, row: str) -> DataFrame:
    ident, name = _asset(df, row)
    return df.select(
        F.col(row),
        ident.alias("id"),
        name.alias("name"),
        asset_type(df).alias("type"),
        fleet_status(df).alias("status"),
        words(df, "zone", "location", default="Pit A").alias("location"),
        number(df, "engine_on_hours", "operating_hours").alias("engineHours"),
        number(df, "fuel_level_pct", default=50).alias("fuelLevel"),
        number(df, "speed_kph").alias("speedKph"),
        number(df, "payload_tonnes").alias("loadTonnes"),
        number(df, "cycle_count", "completed_cycles").cast("bigint").alias("cyclesCompleted"),
        number(df, "fuel_consumption_lph").alias("fuelConsumptionLPH"),
    )


def fuel_records(df: DataFrame, row: str) -> DataFrame:
    ident, name = _asset(df, row)
    fuel = number(df, "fuel_litres", "fuel_used_litres")
    tonnes = F.greatest(number(df, "payload_tonnes", default=1), F.lit(0.1))
    return df.select(
        F.col(row),
        ident.alias("assetId"),
        name.alias("assetName"),
        fuel.alias("fuelUsedLitres"),
        F.round(fuel / tonnes, 2).alias("fuelEfficiencyLPT"),
        number(df, "fuel_consumption_lph").alias("avgConsumptionLPH"),
    )


def maintenance_items(df: DataFrame, row: str) -> DataFrame:
    ident, name = _asset(df, row)
    risk = number(df, "failure_probability")
    return df.select(
        F.col(row),
        F.concat(F.lit("M-"), ident).alias("id"),
        ident.alias("assetId"),
        name.alias("assetName"),
        F.when(risk > 0.7, "overdue").otherwise("scheduled").alias("status"),
        F.when(risk > 0.7, "critical").otherwise("medium").alias("priority"),
        number(df, "repair_time_hours", default=4).alias("estimatedHours"),
        F.round(risk, 2).alias("failureProbability"),
        number(df, "time_to_failure_hours", default=200).alias("timeToFailureHours"),
    )


def work_orders(df: DataFrame, row: str) -> DataFrame:
    ident, _ = _asset(df, row)
    title = words(df, "asset_name", default=F.concat(F.lit("Asset-"), F.col(row).cast("string")))
    return df.select(
        F.col(row),
        F.format_string("WO-%04d", F.col(row) + 1).alias("id"),
        F.concat(F.lit("M-"), ident).alias("maintenanceId"),
        ident.alias("assetId"),
        F.concat(F.lit("WO - "), title).alias("title"),
        F.lit("open").alias("status"),
    )


def gps_assets(df: DataFrame, row: str, *, invent_missing: bool = False) -> DataFrame:
    """Positions; without coordinates they are null, or a stable hash place when ``invent_missing``."""
    ident, name = _asset(df, row)

    def place(seed: Column, *names: str) -> Column:
        found = [F.expr(f"try_cast(`{n}` AS DOUBLE)") for n in names if n in df.columns]
        hashed = (F.pmod(F.xxhash64(seed), F.lit(80)) + 10).cast("double") if invent_missing else F.lit(None).cast("double")
        return F.coalesce(*found, hashed)

    return df.select(
        F.col(row),
        ident.alias("id"),
        name.alias("assetName"),
        asset_type(df).alias("assetType"),
        place(ident, "gps_x", "longitude").alias("x"),
        place(name, "gps_y", "latitude").alias("y"),
        number(df, "speed_kph").alias("speed"),
        number(df, "heading_deg").alias("heading"),
        gps_status(df).alias("status"),
    )


def kpi_health(value: Column, target: Column) -> Column:
    ratio = value / target
    return (
        F.when(target.isNull() | (target <= 0), "healthy")
        .when(ratio >= 0.9, "healthy")
        .when(ratio >= 0.7, "warning")
        .otherwise("critical")
    )


def list_filter(df: DataFrame, *, name: str | None = None, contains: str | None = None, **equals: str | None) -> DataFrame:
    """Equality filters (``all`` or None means no filter) and a case-insensitive name search."""
    for column, value in equals.items():
        if value is not None and value != "all":
            df = df.filter(F.col(column) == value)
    if name and contains:
        df = df.filter(F.lower(name).contains(contains.lower()))
    return df


def page_of(df: DataFrame, order: Sequence[str], page: int, size: int = 10) -> DataFrame:
    """One page (1-based). Only the rows up to the page's end are ever sorted together."""
    columns = [F.col(c) for c in order]
    return df.orderBy(*columns).offset((page - 1) * size).limit(size)


def page_count(df: DataFrame, size: int = 10) -> DataFrame:
    return df.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / size)).cast("bigint").alias("total_pages"))


def with_pages(df: DataFrame, order: Sequence[str], size: int = 10) -> DataFrame:
    """Page number of every row, for exporting a whole list."""
    return ordered_scan(df, [], order, row_index="_i").withColumn("page", F.floor(F.col("_i") / size) + 1).drop("_i")


def zone_occupancy(df: DataFrame, x: str = "gps_x", y: str = "gps_y", zones: Sequence[tuple] = PIT_ZONES) -> DataFrame:
    """Positions per zone rectangle. Zones are a short list, tested row by row, so nothing is joined."""
    tests = [
        F.when(
            (F.col(x) >= zx) & (F.col(x) <= zx + w) & (F.col(y) >= zy) & (F.col(y) <= zy + h),
            F.struct(F.lit(zid).alias("zone_id"), F.lit(name).alias("zone")),
        )
        for zid, name, _, zx, zy, w, h in zones
    ]
    inside = df.select(F.explode(F.array_compact(F.array(*tests))).alias("z"))
    return inside.groupBy("z.zone_id", "z.zone").agg(F.count(F.lit(1)).alias("positions"))


def hourly_trend(df: DataFrame, moment: str, value: str) -> DataFrame:
    """Mean per hour, one decimal, labelled by hour."""
    hour = F.date_trunc("hour", F.col(moment))
    return df.groupBy(hour.alias("bucket")).agg(
        F.round(exact_mean(value), 1).alias("consumption")
    ).select(F.date_format("bucket", "yyyy-MM-dd HH").alias("hour_key"), F.date_format("bucket", "dd HH':00'").alias("hour"), "consumption")


def status_breakdown(df: DataFrame, status: str) -> DataFrame:
    """Count and rounded percentage per status."""
    counts = df.groupBy(F.col(status).alias("status")).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(F.sum("n")).scalar()
    return counts.select("status", "n", F.round(F.col("n") / whole * 100, 0).cast("bigint").alias("pct"))


def shift_summary(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tonnage per shift against target, finished and delayed cycles."""
    return df.groupBy(*keys).agg(
        F.round(exact_sum("payload_tonnes"), 3).alias("total_tonnes"),
        F.round(exact_sum("target_payload_tonnes"), 3).alias("target_tonnes"),
        F.count(F.lit(1)).alias("completed_cycles"),
        F.round(exact_mean("cycle_time_min"), 3).alias("mean_cycle_min"),
        F.count_if(F.col("queue_time_min") > 10).alias("delayed_cycles"),
    )


def alert_counters(df: DataFrame, status: str, severity: str) -> DataFrame:
    active = F.col(status) != "resolved"
    return df.agg(
        F.count_if(active).alias("active_alerts"),
        F.count_if(active & (F.col(severity) == "critical")).alias("critical_alerts"),
    )


def run_log_status(logs: DataFrame, request: str, message: str, moment: str) -> DataFrame:
    """Status of every request from its messages: timeout, error, ok or unknown."""
    has = lambda text: F.bool_or(F.col(message).contains(text))
    payload = F.when(F.col(message).contains("sections_indexed"), F.regexp_extract(message, r"(?s)\{.*", 0))
    read = lambda path: F.max(F.get_json_object(payload, path))
    millis = F.expr(f"try_cast(nullif(regexp_extract({message}, 'Duration: ([0-9.]+) ms', 1), '') AS DOUBLE)")
    facts = logs.groupBy(request).agg(
        F.min(moment).alias("started"),
        has("Task timed out").alias("timeout"),
        (has("[ERROR]") | has("No sections extracted")).alias("failed"),
        has("Skipping non-PDF object").alias("skipped"),
        has("REPORT RequestId").alias("reported"),
        read("$.file_key").alias("file_key"),
        read("$.sections_indexed").cast("bigint").alias("sections"),
        read("$.total_pages").cast("bigint").alias("pages"),
        F.round(F.max(millis) / 1000, 3).alias("duration_s"),
    )
    status = (
        F.when(F.col("timeout"), "timeout")
        .when(F.col("failed"), "error")
        .when(F.col("file_key").isNotNull() | F.col("skipped"), "ok")
        .when(F.col("reported"), "unknown")
        .otherwise("ok")
    )
    return facts.select(request, "started", status.alias("status"), "file_key", "sections", "pages", "duration_s")


def page_counters(df: DataFrame, amount: str, risk: str, *, overdue: float = 0.7, critical: float = 0.9) -> DataFrame:
    """Total and mean of an amount, and how many rows lie above the two risk levels."""
    return df.agg(
        exact_sum(amount).alias("total_litres"), F.round(F.avg(amount), 3).alias("average_litres"),
        F.count_if(F.col(risk) > overdue).alias("overdue"), F.count_if(F.col(risk) > critical).alias("critical"),
    )


def stage_summary(stages: DataFrame, run: str) -> DataFrame:
    """Whether every stage of a run succeeded or was skipped, the failed ones, and the total time."""
    fine = F.col("success") | F.col("skipped")
    return stages.groupBy(run).agg(
        F.bool_and(fine).alias("overall_success"),
        F.array_join(F.array_sort(F.collect_set(F.when(~fine, F.col("stage")))), ",").alias("failed_stages"),
        F.round(exact_sum("duration_s"), 1).alias("duration_s"),
    )


def recent_runs(runs: DataFrame, run: str, started: str, stopped: str, n: int = 10) -> DataFrame:
    """The ``n`` most recent runs with their duration as text."""
    seconds = F.unix_timestamp(stopped) - F.unix_timestamp(started)
    text = F.when(F.col(stopped).isNull(), "running").otherwise(
        F.format_string("%dm %ds", F.floor(seconds / 60), seconds % 60)
    )
    return runs.orderBy(F.desc(started), F.desc(run)).limit(n).select(
        run, F.date_format(started, "yyyy-MM-dd HH:mm:ss").alias("started"), text.alias("duration")
    )


def daily_rolling_mean(df: DataFrame, key: str, moment: str, value: str, days: int = 7) -> DataFrame:
    """Mean over the last ``days`` days per key, from daily sums and counts rather than raw rows."""
    daily = df.groupBy(key, F.to_date(moment).alias("day")).agg(
        F.sum(F.col(value).try_cast(EXACT)).alias("s"), F.sum(F.col(value).cast("double")).alias("d"), lossless(value).alias("fine"), F.count(value).alias("n")
    )
    number_of_day = F.datediff("day", F.lit("1970-01-01"))
    frame = Window.partitionBy(key).orderBy(number_of_day).rangeBetween(-(days - 1), 0)
    total = F.when(F.bool_and("fine").over(frame), F.sum("s").over(frame).cast("double")).otherwise(F.sum("d").over(frame))
    return daily.select(
        key, "day", F.round(F.try_divide(total, F.sum("n").over(frame)), 3).alias("rolling_mean")
    )
