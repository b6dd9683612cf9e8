"""Retrieval, screens, dashboard, ledger and file queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orepulse.functions import text as fx
from orepulse.operators import retrieval
from orepulse.operators.kpi import REGISTRY, SECTION_KPIS
from orepulse.operators.reshape import with_row_index
from orepulse.plans import api, dashboard
from orepulse.plans.suite import Suite, half_up
from orepulse.plans.suite_kpi import kpi_sql, long_sql
from orepulse.plans.suite_stats import trend_sql
from orepulse.plans.suite_reshape import _section_case
from orepulse.sources import ledger as books
from orepulse.sources import sinks
from orepulse.sources.files import canonical_json, client_signature, union_files
from orepulse.sources.tables import FLEET_ORDER, fleet_sql, fleet_view, table
from orepulse.streaming import jobs

suite = Suite()

# ---- retrieval: vectors belong to an index (vec_id % 3) and a tenant (label); one query per tenant ----


def tenant_vectors(spark, sf) -> DataFrame:
    index = F.element_at(F.array(*[F.lit(i) for i in retrieval.INDEX_ORDER]), (F.col("vec_id") % 3 + 1).cast("int"))
    return table(spark, sf, "embeddings").select(
        "vec_id", "embedding", "label", index.alias("index"), F.concat(F.lit("C"), F.col("label").cast("string")).alias("client_id"),
    )


def tenant_queries(spark, sf) -> DataFrame:
    """The mean vector of each tenant as its question."""
    cells = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = cells.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("x"))
    return means.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias("query_vector")
    ).select(F.col("label").cast("bigint").alias("query_id"), F.concat(F.lit("C"), F.col("label").cast("string")).alias("client_id"), "query_vector")


_Q = """qc AS (SELECT label, i, ROUND(AVG(CAST(x AS DOUBLE)), 9) AS x FROM (SELECT label, UNNEST(embedding) AS x, GENERATE_SUBSCRIPTS(embedding, 1) AS i FROM embeddings) GROUP BY ALL),
    q AS (SELECT CAST(label AS BIGINT) AS query_id, 'C' || label AS client_id, LIST(x ORDER BY i) AS qv FROM qc GROUP BY label),
    v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, ['regulatory', 'telemetry', 'analysis'][CAST(vec_id % 3 + 1 AS INT)] AS index, 'C' || label AS client_id FROM embeddings),
    s AS (SELECT query_id, q.client_id AS q_client, vec_id, index, v.client_id, ROUND(LIST_DOT_PRODUCT(e, qv) / (SQRT(LIST_DOT_PRODUCT(e, e)) * SQRT(LIST_DOT_PRODUCT(qv, qv))), 9) AS score FROM q, v)"""


def _topk(where: str, k: int) -> str:
    return (
        f"SELECT query_id, q_client AS client_id, vec_id, index, score, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE {where} "
        f"QUALIFY rank <= {k}"
    )


_OUT = "SELECT query_id, vec_id, ROUND(score, 6) AS score, rank FROM"


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


suite.add(
    "retrieve_exact_knn",
    lambda spark, sf: _rounded(retrieval.nearest(tenant_vectors(spark, sf), tenant_queries(spark, sf), 10)),
    f"WITH {_Q} {_OUT} ({_topk('TRUE', 10)})",
)
suite.add(
    "retrieve_exact_knn_blocked",
    lambda spark, sf: _rounded(
        retrieval.nearest(tenant_vectors(spark, sf), tenant_queries(spark, sf), 10, max_queries=4, rows_per_block=200)
    ),
    f"WITH {_Q} {_OUT} ({_topk('TRUE', 10)})",
)
suite.add(
    "retrieve_filtered_knn",
    lambda spark, sf: _rounded(
        retrieval.nearest(tenant_vectors(spark, sf), tenant_queries(spark, sf), 5, scope=("client_id", "client_id"))
    ),
    f"WITH {_Q} {_OUT} ({_topk('client_id = q_client', 5)})",
)


def three_indexes(spark, sf) -> DataFrame:
    """Regulatory hits are shared, telemetry and analysis hits stay inside the tenant."""
    vectors, queries = tenant_vectors(spark, sf), tenant_queries(spark, sf)
    scope = ("client_id", "client_id")
    wanted = {"regulatory": (retrieval.REGULATORY_K, None), "telemetry": (retrieval.TELEMETRY_K, scope), "analysis": (retrieval.ANALYSIS_K, scope)}
    parts = []
    for index, (k, inside) in wanted.items():
        hits = retrieval.nearest(vectors.filter(F.col("index") == index), queries, k, scope=inside)
        parts.append(hits.withColumn("index", F.lit(index)))
    return union_files(parts)


_THREE = (
    f"t AS ({_topk(chr(105) + 'ndex = ' + repr('regulatory'), 4)} UNION ALL {_topk('index = ' + repr('telemetry') + ' AND client_id = q_client', 4)} "
    f"UNION ALL {_topk('index = ' + repr('analysis') + ' AND client_id = q_client', 10)})"
)
suite.add(
    "retrieve_three_indexes",
    lambda spark, sf: three_indexes(spark, sf).select("query_id", "index", "vec_id", F.round("score", 6).alias("score"), "rank"),
    f"WITH {_Q}, {_THREE} SELECT query_id, index, vec_id, ROUND(score, 6) AS score, rank FROM t",
)


def analysis_children(spark, sf) -> DataFrame:
    """Analysis vectors as findings of four sections per tenant."""
    v = tenant_vectors(spark, sf).filter("index = 'analysis'")
    return v.select("vec_id", "client_id", F.concat("client_id", F.lit(":s"), (F.col("vec_id") % 4).cast("string")).alias("parent_id"), F.lit("child").alias("chunk_level"))


def collapsed(spark, sf) -> DataFrame:
    children = analysis_children(spark, sf)
    parents = children.select("parent_id", "client_id").distinct().select(
        "parent_id", "client_id", F.element_at(F.split("parent_id", ":"), 2).alias("section"), F.concat(F.lit("Section "), "parent_id").alias("text")
    )
    hits = three_indexes(spark, sf).filter("index = 'analysis'").withColumn("client_id", F.concat(F.lit("C"), F.col("query_id").cast("string")))
    return retrieval.collapse_to_parents(hits, children, parents)


_PARENTS = "p AS (SELECT query_id, client_id || ':s' || (vec_id % 4) AS parent_id, MAX(score) AS score FROM t WHERE index = 'analysis' GROUP BY ALL)"
suite.add(
    "retrieve_parent_collapse",
    lambda spark, sf: collapsed(spark, sf).select("query_id", "parent_id", "section", "text", F.round("score", 6).alias("score")),
    f"WITH {_Q}, {_THREE}, {_PARENTS} SELECT query_id, parent_id, SPLIT_PART(parent_id, ':', 2) AS section, 'Section ' || parent_id AS text, ROUND(score, 6) AS score FROM p",
)


def fused(spark, sf) -> DataFrame:
    flat = three_indexes(spark, sf).filter("index <> 'analysis'").select(
        "query_id", "index", F.concat(F.lit("doc "), (F.col("vec_id") % 50).cast("string")).alias("locator"), "score"
    )
    analysis = collapsed(spark, sf).select("query_id", F.lit("analysis").alias("index"), F.concat(F.lit("analysis:"), "section").alias("locator"), "score")
    return retrieval.fuse_ranks(flat.unionByName(analysis))


_FUSED = f"""{_Q}, {_THREE}, {_PARENTS}, h AS (SELECT query_id, index, 'doc ' || (vec_id % 50) AS locator, score FROM t WHERE index <> 'analysis'
    UNION ALL SELECT query_id, 'analysis', 'analysis:' || SPLIT_PART(parent_id, ':', 2), score FROM p), u AS (SELECT query_id, index, locator, MAX(score) AS score FROM h GROUP BY ALL),
    r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id, index ORDER BY score DESC, locator) - 1 AS index_rank FROM u),
    f AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY 1.0 / (60 + index_rank) DESC, LIST_POSITION(['regulatory', 'telemetry', 'analysis'], index), index_rank) AS position FROM r)"""
suite.add(
    "retrieve_rank_fusion",
    lambda spark, sf: fused(spark, sf).withColumn("score", F.round("score", 6)),
    f"WITH {_FUSED} SELECT query_id, position, index, locator, ROUND(score, 6) AS score, index_rank, ROUND(1.0 / (60 + index_rank), 6)::DOUBLE AS rrf FROM f WHERE position <= 4",
)
suite.add(
    "retrieve_context_blocks",
    lambda spark, sf: fused(spark, sf).select(
        "query_id", "position",
        retrieval.context_block(F.col("position"), F.col("locator"), F.concat(F.lit("text of "), "locator"), F.when(F.col("index") == "analysis", F.to_json(F.struct("locator")))).alias("block"),
    ),
    f"""WITH {_FUSED} SELECT query_id, position, '[' || position || '] (source: ' || locator || ')' || chr(10) || 'text of ' || locator
    || CASE WHEN index = 'analysis' THEN chr(10) || 'Exact values (verbatim): {{"locator":"' || locator || '"}}' ELSE '' END AS block FROM f WHERE position <= 4""",
)
suite.add(
    "retrieve_score_merge",
    lambda spark, sf: retrieval.merge_by_score(
        three_indexes(spark, sf).select("query_id", (F.col("vec_id") % 40).alias("id"), "score"), 5
    ).withColumn("score", F.round("score", 6)),
    f"WITH {_Q}, {_THREE}, m AS (SELECT query_id, vec_id % 40 AS id, MAX(score) AS score FROM t GROUP BY ALL), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS position FROM m) "
    "SELECT query_id, id, ROUND(score, 6) AS score, position FROM r WHERE position <= 5",
)


@suite.query(
    "retrieve_similarity_to_base",
    f"WITH {_Q} SELECT vec_id, ROUND(sim, 6) AS similarity, ROUND(1 - ROUND(sim, 6), 6) AS distance FROM (SELECT vec_id, LIST_COSINE_SIMILARITY(e, (SELECT qv FROM q WHERE query_id = 0)) AS sim FROM v)",
)
def _to_base(spark, sf):
    base = tenant_queries(spark, sf).filter("query_id = 0").first()["query_vector"]
    similarity = F.round(fx.cosine(F.col("embedding"), F.array(*[F.lit(x) for x in base])), 6)
    scored = table(spark, sf, "embeddings").select("vec_id", similarity.alias("similarity"))
    return scored.withColumn("distance", F.round(fx.distance_to_similarity(F.col("similarity")), 6))


suite.add(
    "retrieve_vector_guard",
    lambda spark, sf: retrieval.split_by_dimension(
        table(spark, sf, "embeddings").withColumn("embedding", F.when(F.col("vec_id") % 9 == 0, F.slice("embedding", 1, 10)).when(F.col("vec_id") % 11 > 0, F.col("embedding"))), "embedding", 64
    )[1].select("vec_id"),
    "SELECT vec_id FROM embeddings WHERE vec_id % 9 = 0 OR vec_id % 11 = 0",
)
suite.add(
    "retrieve_evaluation_matrix",
    lambda spark, sf: three_indexes(spark, sf).groupBy("query_id").agg(
        *[F.count_if(F.col("index") == i).alias(f"{i}_hits") for i in retrieval.INDEX_ORDER]
    ),
    f"WITH {_Q}, {_THREE} SELECT query_id, " + ", ".join(f"COUNT(*) FILTER (WHERE index = '{i}') AS {i}_hits" for i in retrieval.INDEX_ORDER) + " FROM t GROUP BY 1",
)
_TENANTS = "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'C12/' || source ELSE 'C' || (doc_id % 3 + 1) || '/' || source END AS source_file FROM documents"
suite.add(
    "retrieve_tenant_scope",
    lambda spark, sf: table(spark, sf, "documents").selectExpr("doc_id", "CASE WHEN doc_id % 5 = 0 THEN 'C12/' || source ELSE 'C' || (doc_id % 3 + 1) || '/' || source END AS source_file")
    .select("doc_id", F.explode(F.array(F.lit("C1"), F.lit("C12"), F.lit("../C1"), F.lit(""))).alias("client"), "source_file")
    .filter(retrieval.in_tenant_scope(F.col("source_file"), F.col("client"))).select("doc_id", "client"),
    f"SELECT doc_id, client FROM ({_TENANTS}), (VALUES ('C1'), ('C12')) AS c(client) WHERE STARTS_WITH(source_file, client || '/')",
)
suite.add(
    "retrieve_client_id_validation",
    lambda spark, sf: table(spark, sf, "documents").select(
        "doc_id", retrieval.client_from_request(F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit(" c"), F.col("doc_id").cast("string"), F.lit(" "))).when(F.col("doc_id") % 4 == 1, F.lit("../x")).when(F.col("doc_id") % 4 == 2, F.repeat(F.lit("a"), F.lit(65)))).alias("client")
    ),
    "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'C' || doc_id END AS client FROM documents",
)
suite.add(
    "retrieve_hashed_terms",
    lambda spark, sf: retrieval.hashed_terms(table(spark, sf, "documents"), "doc_id", "text", 256).select("doc_id", "slot", F.round("weight", 6).alias("weight")),
    r"""WITH w AS (SELECT doc_id, UNNEST(REGEXP_SPLIT_TO_ARRAY(LOWER(text), '[^\p{L}\p{N}]+')) AS term FROM documents),
    c AS (SELECT doc_id, CAST(('0x' || SUBSTRING(MD5(term), 1, 6)) AS BIGINT) % 256 AS slot, COUNT(*) AS tf FROM w WHERE term <> '' GROUP BY ALL)
    SELECT doc_id, slot, ROUND(tf / SQRT(SUM(tf * tf) OVER (PARTITION BY doc_id)), 6) AS weight FROM c""",
)


@suite.query("retrieve_embedded_documents")
def _embedded(spark, sf):
    vectors = retrieval.embed(table(spark, sf, "documents"), "doc_id", "text", dimension=256)
    return retrieval.split_by_dimension(vectors, "embedding", 256)[0]


@suite.query("retrieve_clustered_knn_recall")
def _clustered(spark, sf):
    """Share of the exact ten nearest found when only a third of the lists is searched."""
    listed, centres = retrieval.cluster_lists(tenant_vectors(spark, sf), "embedding", 9)
    queries = tenant_queries(spark, sf)
    exact = retrieval.nearest(tenant_vectors(spark, sf), queries, 10).select("query_id", "vec_id")
    near = retrieval.nearest_in_lists(listed, centres, queries, 10, probes=3).select("query_id", "vec_id", F.lit(1).alias("found"))
    return exact.join(near, ["query_id", "vec_id"], "left").groupBy("query_id").agg(F.round(F.count("found") / F.count(F.lit(1)), 3).alias("recall"))


# ---- screens --------------------------------------------------------------------------------


_SCREEN = (
    "equipment_id", "equipment_type", "idle_hours", "active_hours", "failure_count", "engine_on_hours", "speed_kph", "payload_tonnes",
    "fuel_litres", "failure_probability", "repair_time_hours", "gps_x", "gps_y",
)


def numbered_fleet(spark, sf) -> DataFrame:
    return with_row_index(fleet_view(spark, sf).select(*FLEET_ORDER, *_SCREEN), FLEET_ORDER, name="row_no")


def _numbered_sql(*columns: str) -> str:
    order = ", ".join(FLEET_ORDER)
    return f"fv AS (SELECT *, ROW_NUMBER() OVER (ORDER BY {order}) - 1 AS row_no FROM ({fleet_sql(list(dict.fromkeys([*FLEET_ORDER, *columns])))}))"


_TYPE = "CASE WHEN LOWER(equipment_type) LIKE '%excavat%' THEN 'excavator' WHEN LOWER(equipment_type) LIKE '%loader%' THEN 'loader' WHEN LOWER(equipment_type) LIKE '%dozer%' THEN 'dozer' ELSE 'haul-truck' END"
_STATUS = "CASE WHEN idle_hours > active_hours THEN 'idle' WHEN failure_count > 0 THEN 'maintenance' ELSE 'active' END"
_GPS = "CASE WHEN speed_kph > 5 THEN 'moving' WHEN idle_hours > 2 THEN 'parked' ELSE 'idle' END"
suite.add(
    "screen_fleet_assets",
    lambda spark, sf: api.fleet_assets(numbered_fleet(spark, sf), "row_no"),
    f"WITH {_numbered_sql('equipment_id', 'equipment_type', 'idle_hours', 'active_hours', 'failure_count', 'engine_on_hours', 'speed_kph', 'payload_tonnes')} SELECT row_no, equipment_id AS id, 'Truck-' || row_no AS name, {_TYPE} AS type, {_STATUS} AS status, 'Pit A' AS location, "
    "engine_on_hours AS \"engineHours\", 50.0::DOUBLE AS \"fuelLevel\", speed_kph AS \"speedKph\", payload_tonnes AS \"loadTonnes\", 0::BIGINT AS \"cyclesCompleted\", 0.0::DOUBLE AS \"fuelConsumptionLPH\" FROM fv",
)
suite.add(
    "screen_fuel_records",
    lambda spark, sf: api.fuel_records(numbered_fleet(spark, sf), "row_no"),
    f"WITH {_numbered_sql('equipment_id', 'fuel_litres', 'payload_tonnes')} SELECT row_no, equipment_id AS \"assetId\", 'Truck-' || row_no AS \"assetName\", fuel_litres AS \"fuelUsedLitres\", "
    f"{half_up('fuel_litres / GREATEST(payload_tonnes, 0.1)', 2)} AS \"fuelEfficiencyLPT\", 0.0::DOUBLE AS \"avgConsumptionLPH\" FROM fv",
)
suite.add(
    "screen_maintenance_items",
    lambda spark, sf: api.maintenance_items(numbered_fleet(spark, sf), "row_no"),
    f"WITH {_numbered_sql('equipment_id', 'failure_probability', 'repair_time_hours')} SELECT row_no, 'M-' || equipment_id AS id, equipment_id AS \"assetId\", 'Truck-' || row_no AS \"assetName\", "
    "CASE WHEN failure_probability > 0.7 THEN 'overdue' ELSE 'scheduled' END AS status, CASE WHEN failure_probability > 0.7 THEN 'critical' ELSE 'medium' END AS priority, repair_time_hours AS \"estimatedHours\", "
    "ROUND(failure_probability, 2) AS \"failureProbability\", 200.0::DOUBLE AS \"timeToFailureHours\" FROM fv",
)
suite.add(
    "screen_work_orders",
    lambda spark, sf: api.work_orders(numbered_fleet(spark, sf), "row_no"),
    f"WITH {_numbered_sql('equipment_id')} SELECT row_no, PRINTF('WO-%04d', row_no + 1) AS id, 'M-' || equipment_id AS \"maintenanceId\", equipment_id AS \"assetId\", 'WO - Asset-' || row_no AS title, 'open' AS status FROM fv",
)
suite.add(
    "screen_gps_assets",
    lambda spark, sf: api.gps_assets(numbered_fleet(spark, sf), "row_no"),
    f"WITH {_numbered_sql('equipment_id', 'equipment_type', 'gps_x', 'gps_y', 'speed_kph', 'idle_hours')} SELECT row_no, equipment_id AS id, 'Truck-' || row_no AS \"assetName\", {_TYPE} AS \"assetType\", gps_x AS x, gps_y AS y, speed_kph AS speed, "
    f"0.0::DOUBLE AS heading, {_GPS} AS status FROM fv",
)
suite.add(
    "screen_zone_occupancy",
    lambda spark, sf: api.zone_occupancy(fleet_view(spark, sf)),
    f"WITH fv AS ({fleet_sql(['gps_x', 'gps_y'])}), z(zone_id, zone, x, y, w, h) AS (VALUES " + ", ".join(f"('{z[0]}', '{z[1]}', {z[3]}, {z[4]}, {z[5]}, {z[6]})" for z in api.PIT_ZONES)
    + ") SELECT zone_id, zone, COUNT(*) AS positions FROM fv JOIN z ON gps_x BETWEEN x AND x + w AND gps_y BETWEEN y AND y + h GROUP BY ALL",
)
_TARGETS = {"fuel_efficiency": 0.6, "vehicle_utilization": 60.0, "idle_rate": 10.0, "on_time_delivery": 90.0}


@suite.query(
    "screen_kpi_health",
    f"WITH l AS ({long_sql(list(_TARGETS))}) SELECT kpi, value, CASE WHEN value / target >= 0.9 THEN 'healthy' WHEN value / target >= 0.7 THEN 'warning' ELSE 'critical' END AS status "
    f"FROM l JOIN (VALUES {', '.join(f'({n!r}, {t})' for n, t in _TARGETS.items())}) AS t(kpi, target) USING (kpi)",
)
def _health(spark, sf):
    from orepulse.operators.kpi import calculate_kpi

    target = F.create_map(*[F.lit(x) for n, t in _TARGETS.items() for x in (n, t)])
    values = calculate_kpi(fleet_view(spark, sf), list(_TARGETS))
    return values.select("kpi", "value", api.kpi_health(F.col("value"), F.try_element_at(target, F.col("kpi"))).alias("status"))


suite.add(
    "screen_list_filters",
    lambda spark, sf: api.list_filter(api.maintenance_items(numbered_fleet(spark, sf), "row_no"), status="overdue", priority="all", name="assetId", contains="trk-1").select("row_no", "assetId"),
    f"WITH {_numbered_sql('equipment_id', 'failure_probability')} SELECT row_no, equipment_id AS \"assetId\" FROM fv WHERE failure_probability > 0.7 AND LOWER(equipment_id) LIKE '%trk-1%'",
)
suite.add(
    "screen_page",
    lambda spark, sf: api.page_of(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 7),
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 60",
)
suite.add("screen_page_count", lambda spark, sf: api.page_count(table(spark, sf, "orders")), "SELECT CAST(GREATEST(1, CEIL(COUNT(*) / 10)) AS BIGINT) AS total_pages FROM orders")
suite.add(
    "screen_all_pages",
    lambda spark, sf: api.with_pages(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"]),
    "SELECT o_orderkey, (ROW_NUMBER() OVER (ORDER BY o_orderkey) - 1) // 10 + 1 AS page FROM orders",
)
suite.add(
    "screen_row_cap",
    lambda spark, sf: fleet_view(spark, sf).select(*FLEET_ORDER, "payload_tonnes").orderBy(*FLEET_ORDER).limit(500),
    f"WITH fv AS ({fleet_sql([*FLEET_ORDER, 'payload_tonnes'])}) SELECT * FROM fv ORDER BY {', '.join(FLEET_ORDER)} LIMIT 500",
)
suite.add(
    "screen_hourly_trend",
    lambda spark, sf: api.hourly_trend(table(spark, sf, "events"), "ts", "value"),
    f"SELECT STRFTIME(h, '%Y-%m-%d %H') AS hour_key, STRFTIME(h, '%d %H:00') AS hour, {half_up('AVG(CAST(value AS DECIMAL(18,4)))', 1)} AS consumption FROM (SELECT DATE_TRUNC('hour', ts) AS h, value FROM events) GROUP BY h",
)


@suite.query(
    "screen_status_breakdown",
    f"WITH fv AS ({fleet_sql(['idle_hours', 'active_hours', 'failure_count'])}), n AS (SELECT {_STATUS} AS status, COUNT(*) AS n FROM fv GROUP BY 1) SELECT status, n, CAST(ROUND(n / SUM(n) OVER () * 100, 0) AS BIGINT) AS pct FROM n",
)
def _breakdown(spark, sf):
    fv = fleet_view(spark, sf)
    return api.status_breakdown(fv.select(api.fleet_status(fv).alias("status")), "status")


@suite.query(
    "screen_counters",
    f"WITH fv AS ({fleet_sql(['failure_probability', 'fuel_litres'])}) SELECT CAST(SUM(CAST(fuel_litres AS DECIMAL(18,4))) AS DOUBLE) AS total_litres, {half_up('AVG(fuel_litres)')} AS average_litres, "
    "COUNT(*) FILTER (WHERE failure_probability > 0.7) AS overdue, COUNT(*) FILTER (WHERE failure_probability > 0.9) AS critical FROM fv",
)
def _counters(spark, sf):
    return api.page_counters(fleet_view(spark, sf), "fuel_litres", "failure_probability")


_ALERTS = "SELECT CASE WHEN event_type = 'view' THEN 'resolved' ELSE 'open' END AS status, CASE WHEN event_type = 'error' THEN 'critical' ELSE 'info' END AS severity FROM events"


@suite.query("screen_alert_counters", f"SELECT COUNT(*) FILTER (WHERE status <> 'resolved') AS active_alerts, COUNT(*) FILTER (WHERE status <> 'resolved' AND severity = 'critical') AS critical_alerts FROM ({_ALERTS})")
def _alerts(spark, sf):
    e = table(spark, sf, "events").selectExpr("CASE WHEN event_type = 'view' THEN 'resolved' ELSE 'open' END AS status", "CASE WHEN event_type = 'error' THEN 'critical' ELSE 'info' END AS severity")
    return api.alert_counters(e, "status", "severity")


@suite.query(
    "screen_shift_tonnage",
    f"WITH fv AS ({fleet_sql(['shift', 'dump_time', 'payload_tonnes', 'target_payload_tonnes', 'cycle_time_min', 'queue_time_min'])}) SELECT shift, STRFTIME(dump_time, '%Y-%m') AS month, ROUND(SUM(payload_tonnes), 3) AS total_tonnes, "
    f"ROUND(SUM(target_payload_tonnes), 3) AS target_tonnes, COUNT(*) AS completed_cycles, {half_up('AVG(cycle_time_min)')} AS mean_cycle_min, COUNT(*) FILTER (WHERE queue_time_min > 10) AS delayed_cycles FROM fv GROUP BY ALL",
)
def _shifts(spark, sf):
    return api.shift_summary(fleet_view(spark, sf).withColumn("month", F.date_format("dump_time", "yyyy-MM")), ["shift", "month"])


_LOG = (
    "SELECT user_id, ts, CASE WHEN event_type = 'error' AND event_id % 17 = 0 THEN 'Task timed out after 900 s' WHEN event_type = 'error' AND event_id % 5 = 0 THEN '[ERROR] extraction failed' "
    "WHEN event_type = 'signup' THEN 'REPORT RequestId: r Duration: ' || (event_id % 9000) || '.5 ms' "
    "WHEN event_type = 'purchase' AND user_id % 4 = 0 THEN 'done {\"file_key\": \"f' || user_id || '\", \"sections_indexed\": ' || (event_id % 50) || ', \"total_pages\": 7}' ELSE 'working' END AS message FROM events"
)


@suite.query(
    "screen_run_log_status",
    f"""WITH l AS ({_LOG}), a AS (SELECT user_id, MIN(ts) AS started, BOOL_OR(CONTAINS(message, 'Task timed out')) AS t, BOOL_OR(CONTAINS(message, '[ERROR]')) AS e, BOOL_OR(CONTAINS(message, 'REPORT RequestId')) AS r,
    MAX(CASE WHEN CONTAINS(message, 'sections_indexed') THEN 'f' || user_id END) AS file_key, MAX(REGEXP_EXTRACT(message, 'sections_indexed": ([0-9]+)', 1)) AS sections,
    MAX(TRY_CAST(NULLIF(REGEXP_EXTRACT(message, 'Duration: ([0-9.]+) ms', 1), '') AS DOUBLE)) AS ms FROM l GROUP BY user_id)
    SELECT user_id, STRFTIME(started, '%Y-%m-%d %H:%M:%S') AS started, CASE WHEN t THEN 'timeout' WHEN e THEN 'error' WHEN file_key IS NOT NULL THEN 'ok' WHEN r THEN 'unknown' ELSE 'ok' END AS status, file_key,
    CASE WHEN file_key IS NOT NULL THEN 7::BIGINT END AS pages, {half_up('ms / 1000')} AS duration_s FROM a""",
)
def _run_log(spark, sf):
    e = table(spark, sf, "events")
    e.createOrReplaceTempView("orepulse_log_events")
    logs = spark.sql(_LOG.replace("FROM events", "FROM orepulse_log_events"))
    return api.run_log_status(logs, "user_id", "message", "ts").withColumn("started", F.date_format("started", "yyyy-MM-dd HH:mm:ss")).drop("sections")


_STAGES = "SELECT user_id AS run, event_type AS stage, event_id % 7 <> 0 AS success, event_id % 14 = 0 AS skipped, value AS duration_s FROM events"


@suite.query(
    "screen_stage_summary",
    f"WITH s AS ({_STAGES}) SELECT run, BOOL_AND(success OR skipped) AS overall_success, COALESCE(STRING_AGG(DISTINCT stage, ',' ORDER BY stage) FILTER (WHERE NOT (success OR skipped)), '') AS failed_stages, "
    f"{half_up('SUM(CAST(duration_s AS DECIMAL(18,4)))', 1)} AS duration_s FROM s GROUP BY run",
)
def _stages(spark, sf):
    stages = table(spark, sf, "events").selectExpr("user_id AS run", "event_type AS stage", "event_id % 7 <> 0 AS success", "event_id % 14 = 0 AS skipped", "value AS duration_s")
    return api.stage_summary(stages, "run")


@suite.query(
    "screen_recent_runs",
    f"WITH fv AS ({fleet_sql(['load_start_time', 'dump_time', *FLEET_ORDER])}), r AS (SELECT order_key, MAX(load_start_time) AS a, MAX(dump_time) AS b FROM fv GROUP BY 1) SELECT order_key, STRFTIME(a, '%Y-%m-%d %H:%M:%S') AS started, "
    "((EPOCH(b) - EPOCH(a))::BIGINT // 60) || 'm ' || ((EPOCH(b) - EPOCH(a))::BIGINT % 60) || 's' AS duration FROM r ORDER BY a DESC, order_key DESC LIMIT 10",
)
def _recent(spark, sf):
    runs = fleet_view(spark, sf).groupBy("order_key").agg(F.max(F.col("load_start_time").cast("timestamp")).alias("a"), F.max(F.col("dump_time").cast("timestamp")).alias("b"))
    return api.recent_runs(runs, "order_key", "a", "b")


suite.add(
    "window_seven_day_burn",
    lambda spark, sf: api.daily_rolling_mean(table(spark, sf, "events"), "user_id", "ts", "value"),
    "WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, SUM(CAST(value AS DECIMAL(18,4))) AS s, COUNT(value) AS n FROM events GROUP BY ALL) SELECT user_id, day, "
    + half_up("CAST(SUM(s) OVER w AS DOUBLE) / SUM(n) OVER w") + " AS rolling_mean FROM d WINDOW w AS (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)",
)

# ---- dashboard ------------------------------------------------------------------------------

METRICS = ("payload_tonnes", "fuel_litres", "distance_km", "repair_time_hours", "cycle_time_min")


def tenant_fleet(spark, sf) -> DataFrame:
    """The fleet view as each tenant's two shift files."""
    return fleet_view(spark, sf).withColumn("source_file", F.concat("client_id", F.lit("/"), F.lower("shift"), F.lit(".csv")))


def tenant_files(spark, sf) -> DataFrame:
    rows = tenant_fleet(spark, sf).groupBy("client_id", "source_file").agg(F.count(F.lit(1)).alias("row_count"))
    return rows.select("client_id", "source_file", F.lit("ok").alias("status"), "row_count", F.lit(72).alias("column_count"))


_FILES_SQL = f"fv AS ({fleet_sql()}), tf AS (SELECT *, client_id || '/' || LOWER(shift) || '.csv' AS source_file FROM fv)"
suite.add(
    "dashboard_overview",
    lambda spark, sf: dashboard.overview(tenant_files(spark, sf)).withColumn("files", F.array_join(F.transform("files", lambda f: f["source_file"]), ",")),
    f"WITH {_FILES_SQL}, n AS (SELECT client_id, source_file, COUNT(*) AS n FROM tf GROUP BY ALL) SELECT client_id, CAST(SUM(n) AS BIGINT) AS total_rows, COUNT(*) AS file_count, 0::BIGINT AS failed_files, STRING_AGG(source_file, ',' ORDER BY source_file) AS files FROM n GROUP BY 1",
)
_ALL = list(REGISTRY)
_MERGED = (
    f"{_FILES_SQL}, w AS (SELECT client_id, source_file, {', '.join(f'{kpi_sql(n)} AS {n}' for n in _ALL)} FROM tf GROUP BY ALL), k AS ("
    + " UNION ALL ".join(f"SELECT client_id, source_file, '{n}' AS kpi, {n} AS value, '{REGISTRY[n].unit}' AS unit FROM w" for n in _ALL)
    + "), m AS (SELECT client_id, kpi, ARG_MAX(value, source_file) AS value, MAX(unit) AS unit, MIN(source_file) AS position FROM k GROUP BY ALL)"
)
suite.add(
    "dashboard_kpi_merge",
    lambda spark, sf: dashboard.merge_files(dashboard.kpi_findings(tenant_fleet(spark, sf), "source_file"), "source_file").drop("status", "error"),
    f"WITH {_MERGED} SELECT client_id, kpi, position, value, unit FROM m",
)
_SECTION_OF = "CASE " + " ".join(f"WHEN kpi IN ({', '.join(repr(n) for n in names)}) THEN '{s}'" for s, names in SECTION_KPIS.items()) + " END"
suite.add(
    "dashboard_section_counts",
    lambda spark, sf: dashboard.section_counts(dashboard.merge_files(dashboard.kpi_findings(tenant_fleet(spark, sf), "source_file"), "source_file")),
    f"WITH {_MERGED} SELECT client_id, {_SECTION_OF} AS section, COUNT(*) AS kpi_count FROM m GROUP BY ALL",
)
_STAT_ONE = "SELECT client_id, '{m}' AS metric, COUNT({m}) AS n, " + half_up("AVG({m})") + " AS mean, " + half_up("STDDEV_SAMP({m})") + " AS std, ROUND(MIN({m}), 3) AS min, ROUND(MAX({m}), 3) AS max FROM tf GROUP BY client_id"
_STAT_SQL = " UNION ALL ".join(_STAT_ONE.format(m=m) for m in METRICS)
_OUT_ONE = (
    "SELECT t.client_id, '{m}' AS metric, ROUND(MAX(lo), 3) AS lower_bound, ROUND(MAX(hi), 3) AS upper_bound, COUNT(*) FILTER (WHERE {m} < lo OR {m} > hi) AS outlier_count, "
    "ROUND(COUNT(*) FILTER (WHERE {m} < lo OR {m} > hi) / COUNT(*) * 100, 1) AS outlier_pct FROM tf t JOIN (SELECT client_id, QUANTILE_CONT({m}, 0.25) - 1.5 * (QUANTILE_CONT({m}, 0.75) - QUANTILE_CONT({m}, 0.25)) AS lo, "
    "QUANTILE_CONT({m}, 0.75) + 1.5 * (QUANTILE_CONT({m}, 0.75) - QUANTILE_CONT({m}, 0.25)) AS hi FROM tf GROUP BY 1) b ON b.client_id = t.client_id GROUP BY t.client_id"
)
_OUT_SQL = " UNION ALL ".join(_OUT_ONE.format(m=m) for m in METRICS)
_TREND_SQL = " UNION ALL ".join(
    f"SELECT group_value AS client_id, value_column AS metric, periods, slope_per_period AS slope, r_squared, pct_change_first_to_last AS pct_change, direction FROM ({trend_sql('tf', 'load_start_time', m, 'W', 'client_id')})" for m in METRICS
)
_RANK_SQL = (
    "SELECT client_id, 'payload_tonnes' AS metric, ROW_NUMBER() OVER (PARTITION BY client_id ORDER BY value DESC, entity) AS rank, entity, value FROM (SELECT client_id, equipment_id AS entity, "
    "ROUND(CAST(AVG(CAST(payload_tonnes AS DECIMAL(18,4))) AS DOUBLE), 3) AS value FROM tf GROUP BY ALL) QUALIFY rank <= 10"
)
for _name, _fn, _sql in (
    ("dashboard_statistics", lambda spark, sf: dashboard.tenant_statistics(tenant_fleet(spark, sf), METRICS), _STAT_SQL),
    ("dashboard_outliers", lambda spark, sf: dashboard.tenant_outliers(tenant_fleet(spark, sf), METRICS), _OUT_SQL),
    ("dashboard_trends", lambda spark, sf: dashboard.tenant_trends(tenant_fleet(spark, sf), "load_start_time", METRICS), _TREND_SQL),
    ("dashboard_rankings", lambda spark, sf: dashboard.tenant_rankings(tenant_fleet(spark, sf), "equipment_id", "payload_tonnes"), _RANK_SQL),
):
    suite.add(_name, _fn, f"WITH {_FILES_SQL} {_sql}")


def found(spark, sf) -> DataFrame:
    return dashboard.findings(tenant_fleet(spark, sf), "source_file", "load_start_time", "equipment_id", METRICS)


_D3 = "CAST(CAST({} AS DECIMAL(20,3)) AS VARCHAR)"
_FOUND_SQL = f"""{_MERGED}, st AS ({_STAT_SQL}), ou AS ({_OUT_SQL}), tr AS ({_TREND_SQL}), rk AS ({_RANK_SQL}),
    fd AS (SELECT client_id, {_SECTION_OF} AS section, 'kpi' AS kind, kpi AS name, 'KPI ' || kpi || ' = ' || {_D3.format('value')} || ' ' || unit AS text FROM m UNION ALL
    SELECT client_id, {_section_case('metric')}, 'outlier', metric, outlier_count || ' outliers in ' || metric || ' (iqr)' FROM ou UNION ALL
    SELECT client_id, {_section_case('metric')}, 'trend', metric, 'trend of ' || metric || ': ' || direction || ' (r²=' || {_D3.format('r_squared')} || ', slope=' || CAST(CAST(slope AS DECIMAL(20,4)) AS VARCHAR) || ')' FROM tr UNION ALL
    SELECT client_id, {_section_case('metric')}, 'stat', metric, 'statistics for ' || metric || ': mean=' || {_D3.format('mean')} || ', min=' || {_D3.format('min')} || ', max=' || {_D3.format('max')} FROM st UNION ALL
    SELECT client_id, {_section_case('metric')}, 'ranking', metric, 'top equipment_id by ' || metric || ': ' || STRING_AGG(entity || '=' || {_D3.format('value')}, ', ' ORDER BY rank) FROM rk WHERE rank <= 5 GROUP BY client_id, metric)"""
suite.add("dashboard_findings", lambda spark, sf: found(spark, sf).drop("brief"), f"WITH {_FOUND_SQL} SELECT * FROM fd WHERE section IS NOT NULL")


def report_rows(spark, sf) -> DataFrame:
    return dashboard.report_texts(found(spark, sf), dashboard.overview(tenant_files(spark, sf)), "2024-01-31")


suite.add(
    "dashboard_child_texts",
    lambda spark, sf: report_rows(spark, sf).filter("chunk_level = 'child'").select("parent_id", "client_id", "section", "kind", "text"),
    f"WITH {_FOUND_SQL} SELECT client_id || ':' || section AS parent_id, client_id, section, kind, client_id || ' ' || section || ' — ' || text AS text FROM fd WHERE section IS NOT NULL",
)
_BRIEF = """, br AS (SELECT client_id, section, kind, name, CASE kind WHEN 'kpi' THEN SUBSTRING(text, 5) WHEN 'outlier' THEN REPLACE(REPLACE(text, ' outliers in ', ' in '), ' (iqr)', '')
    WHEN 'trend' THEN REGEXP_REPLACE(REPLACE(REPLACE(text, 'trend of ', ''), ': ', ' '), ', slope=.*$', ')') WHEN 'ranking' THEN 'Top' || SUBSTRING(text, 4) || '.' END AS brief FROM fd WHERE section IS NOT NULL),
    fl AS (SELECT client_id, STRING_AGG(source_file, ', ' ORDER BY source_file) AS sources, COUNT(*) AS files, SUM(n) AS total FROM (SELECT client_id, source_file, COUNT(*) AS n FROM tf GROUP BY ALL) GROUP BY 1),
    ls AS (SELECT client_id, section, STRING_AGG(brief, '; ' ORDER BY name) FILTER (WHERE kind = 'kpi') AS k, STRING_AGG(brief, '; ' ORDER BY name) FILTER (WHERE kind = 'trend') AS t,
    STRING_AGG(brief, '; ' ORDER BY name) FILTER (WHERE kind = 'outlier') AS o, STRING_AGG(brief, chr(10) ORDER BY name) FILTER (WHERE kind = 'ranking') AS r FROM br GROUP BY ALL)"""
suite.add(
    "dashboard_parent_rows",
    lambda spark, sf: report_rows(spark, sf).filter("chunk_level = 'parent'").select("parent_id", "text"),
    f"""WITH {_FOUND_SQL}{_BRIEF} SELECT client_id || ':' || section AS parent_id, CONCAT_WS(chr(10), 'Client ' || client_id || ' — ' || section || ' section (computed 2024-01-31, from ' || sources || ').',
    'KPIs: ' || k || '.', 'Trends: ' || t || '.', 'Outliers: ' || o || '.', r) AS text FROM ls JOIN fl USING (client_id)
    UNION ALL SELECT client_id || ':overview', 'Client ' || client_id || ' — overview (computed 2024-01-31). Files: ' || files || ', total rows: ' || CAST(total AS BIGINT) || '. KPIs computed: ' || c || '.'
    FROM fl JOIN (SELECT client_id, COUNT(*) AS c FROM br WHERE kind = 'kpi' GROUP BY 1) USING (client_id)""",
)


@suite.query("dashboard_report")
def _report(spark, sf):
    return dashboard.tenant_report(tenant_fleet(spark, sf), tenant_files(spark, sf), "source_file", "load_start_time", "equipment_id", METRICS)


@suite.query(
    "chart_specs",
    "SELECT lang, 'PieChart' AS kind, COUNT(*) AS n FROM documents GROUP BY lang",
)
def _charts(spark, sf):
    counts = table(spark, sf, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    per_lang = counts.groupBy("lang").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("d"))
    pie = dashboard.pie_chart(F.lit("Sources"), F.transform("d", lambda x: x["source"]), F.transform("d", lambda x: x["n"]))
    return per_lang.select("lang", F.get_json_object(F.to_json(pie), "$.chart_type").alias("kind"), "n")


# ---- ledger, files, sinks -------------------------------------------------------------------

_BOOK = """SELECT doc_id AS seq, 'C' || (CAST(SUBSTRING(source, 4) AS BIGINT) % 3 + 1) AS client_id, source AS source_file, 'sig' || (doc_id // 200) AS content_signature,
    'v' || (doc_id % 2 + 1) AS pipeline_version, CASE WHEN doc_id % 7 = 0 THEN 'error' ELSE 'indexed' END AS status FROM documents"""
_NOW = "SELECT DISTINCT 'C' || (CAST(SUBSTRING(source, 4) AS BIGINT) % 3 + 1) AS client_id, source AS source_file, CASE WHEN source IN ('src1', 'src2') THEN 'new' ELSE 'sig4' END AS signature FROM documents UNION ALL SELECT 'C9', 'fresh.csv', 'sig4'"


def _book(spark, sf) -> DataFrame:
    table(spark, sf, "documents").createOrReplaceTempView("orepulse_documents")
    return spark.sql(_BOOK.replace("//", "div").replace("FROM documents", "FROM orepulse_documents"))


def _now(spark, sf) -> DataFrame:
    table(spark, sf, "documents").createOrReplaceTempView("orepulse_documents")
    return spark.sql(_NOW.replace("FROM documents", "FROM orepulse_documents"))


_LATEST_SQL = f"b AS ({_BOOK}), l AS (SELECT client_id, source_file, ARG_MAX(content_signature, seq) AS content_signature, ARG_MAX(pipeline_version, seq) AS pipeline_version, ARG_MAX(status, seq) AS status FROM b GROUP BY ALL)"
suite.add("ledger_latest_state", lambda spark, sf: books.latest_states(_book(spark, sf)), f"WITH {_LATEST_SQL} SELECT * FROM l")
_STALE_SQL = (
    f"{_LATEST_SQL}, n AS ({_NOW}), s AS (SELECT n.client_id, n.source_file, n.signature, CASE WHEN l.source_file IS NULL THEN 'absent' WHEN content_signature <> signature THEN 'changed' "
    "WHEN pipeline_version <> 'v2' THEN 'version' WHEN status <> 'indexed' THEN 'status' END AS reason FROM n LEFT JOIN l USING (client_id, source_file))"
)
suite.add("ledger_stale_files", lambda spark, sf: books.stale_files(_now(spark, sf), _book(spark, sf), "v2"), f"WITH {_STALE_SQL} SELECT * FROM s")
suite.add(
    "ledger_stale_clients",
    lambda spark, sf: books.stale_clients(_now(spark, sf), _book(spark, sf), "v2"),
    f"WITH {_STALE_SQL} SELECT client_id, BOOL_OR(reason IS NOT NULL) AS stale, COUNT(reason) AS stale_files FROM s GROUP BY 1",
)
suite.add(
    "ledger_client_signature",
    lambda spark, sf: client_signature(_now(spark, sf).withColumnRenamed("source_file", "path")),
    f"WITH n AS ({_NOW}) SELECT client_id, STRING_AGG(source_file || '=' || signature, ';' ORDER BY source_file || '=' || signature) AS signature FROM n GROUP BY 1",
)


@suite.query(
    "sink_replace_by_key",
    "SELECT doc_id, source, 'old' AS version FROM documents WHERE source NOT IN ('src1', 'src5') UNION ALL SELECT doc_id, source, 'new' FROM documents WHERE source IN ('src1', 'src5')",
)
def _replace(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    fresh = d.filter(F.col("source").isin("src1", "src5")).withColumn("version", F.lit("new"))
    return sinks.replace_by_key(d.withColumn("version", F.lit("old")), fresh, ["source"])


suite.add(
    "sink_index_counts",
    lambda spark, sf: sinks.index_counts({n: table(spark, sf, n) for n in ("documents", "embeddings", "pages")}),
    " UNION ALL ".join(f"SELECT '{n}' AS index, COUNT(*) AS documents FROM {n}" for n in ("documents", "embeddings", "pages")),
)
suite.add(
    "sink_vectors_per_source",
    lambda spark, sf: sinks.vectors_per_source(table(spark, sf, "documents").withColumn("source", F.when(F.col("doc_id") % 10 > 0, F.col("source"))), "source"),
    "SELECT COALESCE(CASE WHEN doc_id % 10 > 0 THEN source END, 'unknown') AS source, COUNT(*) AS vectors FROM documents GROUP BY 1",
)
suite.add(
    "sink_sources_without_labels",
    lambda spark, sf: table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left_anti").groupBy("source").agg(F.count(F.lit(1)).alias("documents")),
    "SELECT source, COUNT(*) AS documents FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1",
)
suite.add(
    "source_canonical_json",
    lambda spark, sf: canonical_json(table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus")).alias("status"), F.col("o_orderdate").cast("timestamp").alias("at"))),
    """SELECT '{"o_orderkey":' || o_orderkey || ',"status":' || CASE WHEN o_orderkey % 3 > 0 THEN '"' || o_orderstatus || '"' ELSE 'null' END || ',"at":"' || STRFTIME(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '"}' AS value FROM orders""",
)
suite.add(
    "source_union_files",
    lambda spark, sf: union_files([
        table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.lit("C1/customers.csv").alias("source_file")),
        table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("label"), F.lit("C1/suppliers.csv").alias("source_file")),
    ]),
    "SELECT c_custkey AS id, c_acctbal AS balance, 'C1/customers.csv' AS source_file, NULL::VARCHAR AS label FROM customer UNION ALL SELECT s_suppkey, NULL, 'C1/suppliers.csv', s_name FROM supplier",
)
suite.add(
    "source_tenants",
    lambda spark, sf: table(spark, sf, "pages").select(F.regexp_extract("url", "://([^/]+)/", 1).alias("client_id")).distinct(),
    "SELECT DISTINCT REGEXP_EXTRACT(url, '://([^/]+)/', 1) AS client_id FROM pages",
)

# ---- live forms run on a batch --------------------------------------------------------------

_LIVE_RULES = ({"column": "value", "operator": ">", "threshold": 100, "label": "high value", "severity": "critical"}, {"column": "value", "operator": "<", "threshold": 1, "label": "low value"})
suite.add(
    "live_threshold_alerts",
    lambda spark, sf: jobs.threshold_alerts(table(spark, sf, "events").select("event_id", "value"), _LIVE_RULES),
    "SELECT event_id, value, 'high value' AS rule, 'critical' AS severity, value AS measured FROM events WHERE value > 100 UNION ALL SELECT event_id, value, 'low value', 'warning', value FROM events WHERE value < 1",
)


def _live(spark, sf) -> DataFrame:
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


suite.add(
    "live_hourly_mean",
    lambda spark, sf: jobs.hourly_mean_stream(_live(spark, sf), "ts", "value").withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH")),
    f"SELECT STRFTIME(DATE_TRUNC('hour', ts), '%Y-%m-%d %H') AS hour, {half_up('AVG(CAST(value AS DECIMAL(18,4)))')} AS mean_value, COUNT(*) AS n FROM events GROUP BY 1",
)
suite.add(
    "live_sliding_mean",
    lambda spark, sf: jobs.sliding_mean_stream(_live(spark, sf), "ts", "value", ["event_type"]).select(F.date_format("from", "yyyy-MM-dd").alias("from"), "event_type", "mean_value", "n"),
    f"WITH d AS (SELECT *, UNNEST(GENERATE_SERIES(0, 6)) AS back FROM events) SELECT STRFTIME(CAST(ts AS DATE) - back::INT, '%Y-%m-%d') AS \"from\", event_type, {half_up('AVG(CAST(value AS DECIMAL(18,4)))')} AS mean_value, COUNT(*) AS n FROM d GROUP BY ALL",
)
suite.add(
    "live_sessions",
    lambda spark, sf: jobs.activity_sessions(_live(spark, sf), "ts", "user_id", gap="6 hours").select("user_id", F.date_format("from", "yyyy-MM-dd HH:mm:ss").alias("from"), "events"),
    "WITH g AS (SELECT *, CASE WHEN ts - LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, SUM(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) "
    "SELECT user_id, STRFTIME(MIN(ts), '%Y-%m-%d %H:%M:%S') AS \"from\", COUNT(*) AS events FROM s GROUP BY user_id, k",
)
