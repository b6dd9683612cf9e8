"""Queries of the vectorisation, analysis and retrieval jobs, of split CSV files and of stored vector indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orepulse.operators import documents, retrieval
from orepulse.operators.reshape import uncovered_columns
from orepulse.operators.vector_index import build_index, learn_index, search_index
from orepulse.plans import dashboard, incremental, retrieve, vectorise
from orepulse.plans.stages import Source
from orepulse.plans.suite import Suite
from orepulse.plans.suite_reshape import _masked_sql
from orepulse.plans.suite_service import _FILES_SQL, _FOUND_SQL, _OUT, _Q, _topk, METRICS, tenant_files, tenant_fleet, tenant_queries, tenant_vectors
from orepulse.plans.suite_text import _BODY, _CHUNK_DOC_SQL, _DOC_FACTS, _NUMBERED, _RULEBOOK_SQL, _strip, layout_blocks, pieces_sql, rulebook, telemetry
from orepulse.session import shared_path
from orepulse.sources.snapshots import read_current, replace_keys
from orepulse.sources.split_csv import read_csv
from orepulse.sources.tables import table

suite = Suite()

# ---- telemetry vectorisation ----------------------------------------------------------------


def _telemetry_job(spark, sf) -> tuple[vectorise.JobResult, str]:
    folder = shared_path(spark)
    rows = telemetry(spark, sf)
    done = vectorise.vectorise_telemetry(
        spark, f"{folder}/job", f"{folder}/index", Source(sf, lambda: rows), date="ts", order=["event_id"], entities=["equipment_id"],
        metrics=["fuel_litres", "vibration"], categories=["event_type"], dimension=64, markers=False,
    )
    if not done.success:
        raise RuntimeError(done.stages[-1].error)
    return done, f"{folder}/index"


@suite.query(
    "vectorise_telemetry_texts",
    f"SELECT source_file AS source, chunk_index, chunk_id, {_masked_sql('text')} AS text, 64 AS dimension FROM ({_CHUNK_DOC_SQL})",
)
def _telemetry_texts(spark, sf):
    _, index = _telemetry_job(spark, sf)
    return read_current(spark, index).select("source", "chunk_index", "chunk_id", "text", F.size("embedding").alias("dimension"))


@suite.query(
    "vectorise_telemetry_counts",
    f"""WITH d AS (SELECT source_file, COUNT(*) AS chunks FROM ({_CHUNK_DOC_SQL}) GROUP BY 1),
    r AS (SELECT 'C' || (user_id % 3 + 1) || '/sensors/events.csv' AS source_file, COUNT(*) AS row_count FROM events GROUP BY 1)
    SELECT source_file, row_count, chunks, chunks AS embedded, chunks AS indexed, 0::BIGINT AS failed FROM r JOIN d USING (source_file)""",
)
def _telemetry_counts(spark, sf):
    done, _ = _telemetry_job(spark, sf)
    return spark.read.parquet(done.path("index")).select("source_file", "row_count", "chunks", "embedded", "indexed", "failed")


# ---- document vectorisation -----------------------------------------------------------------


def document_facts(spark, sf) -> DataFrame:
    d, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    return d.join(labels, "doc_id", "left").select(
        "doc_id", F.col("n_chars").cast("double").alias("avg_chars"), F.expr("n_chars div 100").alias("page_count"),
        F.when(F.col("source") == "src3", "Safety_Code").when(F.col("source") == "src4", "scanned_form").alias("doc_type_tag"),
        F.when(F.col("quality") == 1, "complex_legal").when(F.col("quality") == 0, "simple").alias("model_class"),
        F.when(F.col("toxic") == 1, 0.5).otherwise(0.9).alias("model_confidence"), F.col("n_chars").cast("bigint").alias("file_bytes"),
    )


def document_texts(spark, sf) -> DataFrame:
    return rulebook(spark, sf).select("doc_id", "text")


def _document_job(spark, sf) -> tuple[vectorise.JobResult, str]:
    folder = shared_path(spark)
    facts, texts, blocks = document_facts(spark, sf), document_texts(spark, sf), layout_blocks(spark, sf)
    done = vectorise.vectorise_documents(
        spark, f"{folder}/job", f"{folder}/index", Source(sf, lambda: facts), Source(sf, lambda: blocks), Source(sf, lambda: texts), doc="doc_id", dimension=64,
    )
    if not done.success:
        raise RuntimeError(done.stages[-1].error)
    return done, f"{folder}/index"


_CLASS_SQL = f"""f AS ({_DOC_FACTS}), g AS (SELECT *, avg_chars < 200 AND avg_chars > 0 AS scanned, page_count > 40 AND avg_chars < 600 AS sparse,
    LOWER(COALESCE(tag, '')) = 'safety_code' AS complex, LOWER(COALESCE(tag, '')) = 'scanned_form' AS easy FROM f),
    cls AS (SELECT doc_id, page_count, CASE WHEN scanned OR sparse THEN 'simple' WHEN complex THEN 'complex_legal' WHEN easy THEN 'simple'
    WHEN model_class IS NULL OR model_confidence < 0.7 THEN 'complex_legal' ELSE model_class END AS doc_class FROM g)"""
# Layout sections of the simple documents, sections between headings of the others.
_SECTIONS_SQL = rf"""{_CLASS_SQL}, l AS (SELECT doc_id, UNNEST(STRING_SPLIT(text, chr(10))) AS line, GENERATE_SUBSCRIPTS(STRING_SPLIT(text, chr(10)), 1) - 1 AS i
      FROM documents JOIN cls USING (doc_id) WHERE doc_class = 'simple'),
    b AS (SELECT doc_id, i // 3 AS c, COALESCE(STRING_AGG(line, ' ' ORDER BY i) FILTER (WHERE line <> ''), '') AS t, STRING_AGG('| ' || TRIM(line) || ' |', chr(10) ORDER BY i) AS rows_ FROM l GROUP BY ALL),
    k AS (SELECT *, CASE WHEN c % 5 = 2 THEN 'H' WHEN c % 7 = 3 THEN 'T' ELSE 'X' END AS kind, c // 10 + 1 AS page FROM b),
    s AS (SELECT *, SUM(CASE WHEN kind = 'H' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY c) AS section_no FROM k),
    layout AS (SELECT doc_id, section_no, COALESCE(MAX(CASE WHEN kind = 'H' THEN COALESCE(NULLIF(t, ''), 'untitled') END), 'untitled-0') AS title,
      {_strip("COALESCE(STRING_AGG(CASE WHEN kind = 'X' AND LENGTH(" + _strip('t') + ") > 2 THEN t END, chr(10) ORDER BY c), '')")} AS text,
      COALESCE(STRING_AGG(CASE WHEN kind = 'T' THEN rows_ || chr(10) END, chr(10) ORDER BY c), '') AS tables,
      COALESCE(MIN(CASE WHEN kind = 'H' THEN page END), 1) AS page_start, MAX(page) AS page_end, 'layout' AS method FROM s GROUP BY doc_id, section_no),
    {_RULEBOOK_SQL}, rl AS (SELECT doc_id, (line_no - 1) // 40 + 1 AS page, line_no, {_strip('line')} AS line FROM
      (SELECT doc_id, UNNEST(STRING_SPLIT(text, chr(10))) AS line, GENERATE_SUBSCRIPTS(STRING_SPLIT(text, chr(10)), 1) AS line_no FROM rule JOIN cls USING (doc_id) WHERE doc_class <> 'simple')),
    rh AS (SELECT *, (REGEXP_MATCHES(line, '{_NUMBERED}') AND LENGTH(line) <= 200) OR (LENGTH(line) <= 100 AND REGEXP_MATCHES(REGEXP_REPLACE(line, '[^\p{{L}}]', '', 'g'), '^\p{{Lu}}{{3,}}$')) AS heading FROM rl),
    rs AS (SELECT *, SUM(CASE WHEN heading THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS section_no FROM rh),
    headed AS (SELECT doc_id, section_no, MAX(CASE WHEN heading THEN line END) AS title, {_strip("COALESCE(STRING_AGG(CASE WHEN NOT heading THEN line END, chr(10) ORDER BY line_no), '')")} AS text,
      '' AS tables, MIN(page) AS page_start, MAX(page) AS page_end, CASE WHEN MAX(page_count) > 95 THEN 'text_batch' ELSE 'text_single' END AS method FROM rs JOIN cls USING (doc_id) GROUP BY doc_id, section_no),
    sec AS (SELECT * FROM layout UNION ALL SELECT * FROM headed)"""
_RECORDS_SQL = f"""{_SECTIONS_SQL}, cb AS (SELECT doc_id, section_no, LEFT({_strip(r"REGEXP_REPLACE(NFC_NORMALIZE(COALESCE(title, '')), '\s+', ' ', 'g')")}, 200) AS title, {_BODY} AS clean, tables, page_start, page_end, method FROM sec),
    ct AS (SELECT * EXCLUDE (clean), CASE WHEN LENGTH({_strip('tables')}) > 0 THEN clean || chr(10) || chr(10) || tables ELSE clean END AS body FROM cb),
    cp AS (SELECT *, CASE WHEN LENGTH(body) < 50 THEN [] ELSE {pieces_sql('body', 8000, 200)} END AS parts FROM ct),
    co AS (SELECT *, LEN(parts) AS n, SUM(LEN(parts)) OVER (PARTITION BY doc_id ORDER BY section_no) - LEN(parts) AS first FROM cp),
    rec AS (SELECT doc_id, section_no, title AS base, n, CAST(first AS BIGINT) AS first, page_start, page_end, method, GENERATE_SUBSCRIPTS(parts, 1) - 1 AS part, UNNEST(parts) AS body FROM co)"""


@suite.query(
    "vectorise_documents_records",
    f"""WITH {_RECORDS_SQL} SELECT doc_id AS source, PRINTF('%s-s%04d', CAST(doc_id AS VARCHAR), first + part) AS section_id, CASE WHEN base = '' THEN 'untitled-' || first ELSE base END
    || CASE WHEN n > 1 THEN ' (part ' || (part + 1) || ' of ' || n || ')' ELSE '' END AS title, {_masked_sql('body')} AS body, CAST(page_start AS BIGINT) AS page_start,
    CAST(page_end AS BIGINT) AS page_end, method AS extraction_method FROM rec""",
)
def _document_records(spark, sf):
    _, index = _document_job(spark, sf)
    return read_current(spark, index).select("source", "section_id", "title", "body", "page_start", "page_end", "extraction_method")


@suite.query(
    "vectorise_documents_counts",
    f"""WITH {_RECORDS_SQL}, e AS (SELECT doc_id, COUNT(*) AS extracted FROM sec GROUP BY 1), n AS (SELECT doc_id, COUNT(*) AS n FROM rec GROUP BY 1)
    SELECT cls.doc_id, doc_class, COALESCE(extracted, 0) AS extracted, COALESCE(n, 0) AS normalised, COALESCE(n, 0) AS embedded, COALESCE(n, 0) AS indexed, 0::BIGINT AS failed
    FROM cls LEFT JOIN e USING (doc_id) LEFT JOIN n USING (doc_id)""",
)
def _document_counts(spark, sf):
    done, _ = _document_job(spark, sf)
    return spark.read.parquet(done.path("index")).select("doc_id", "doc_class", "extracted", "normalised", "embedded", "indexed", "failed")


def nested_blocks(spark, sf) -> DataFrame:
    """Words below lines below groups below lists: every line a group of its words, every ten lines a list, on pages of three lists."""
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    words = lines.select("doc_id", "i", F.posexplode(F.split("line", r"\s+")).alias("w", "word"))
    group, inner, line, top = F.floor(F.col("i") / 10), F.format_string("G%06d", "i"), F.format_string("N%06d", "i"), F.col("i").cast("double")
    page = F.floor(group / 3) + 1
    none, no_text = F.array().cast("array<string>"), F.lit(None).cast("string")

    def rows(frame, ident, kind, text, kids):
        return frame.select("doc_id", ident.alias("block_id"), kind.alias("block_type"), page.alias("page"), top.alias("top"), F.lit(0.0).alias("left_pos"), text.alias("text"), kids.alias("child_ids"))

    word_id = F.format_string("W%06d.%05d", "i", "w")
    leaf = rows(words, word_id, F.lit("WORD"), F.col("word"), none)
    def ids(n):
        return F.transform(F.sequence(F.lit(0), n - 1), lambda w: F.format_string("W%06d.%05d", "i", w))

    sizes = lines.select("doc_id", "i", F.size(F.split("line", r"\s+")).alias("n"))  # a line has at least one word, if an empty one
    per_line = sizes.groupBy("doc_id", "i").agg(F.collect_list("n").alias("n"))
    per_line = per_line.select("doc_id", "i", F.array_sort(F.flatten(F.transform("n", ids))).alias("kids"))
    low = rows(per_line, line, F.lit("GROUP"), no_text, F.col("kids"))
    high = rows(per_line, inner, F.lit("GROUP"), no_text, F.array(line))
    lists = lines.groupBy("doc_id", group.alias("g")).agg(F.min("i").alias("i"), F.array_sort(F.collect_list(inner)).alias("kids"))
    kind = F.when(F.col("g") % 4 == 1, "LAYOUT_SECTION_HEADER").when(F.col("g") % 4 == 2, "LAYOUT_FIGURE").otherwise("LAYOUT_LIST")
    return leaf.unionByName(low).unionByName(high).unionByName(rows(lists, F.format_string("B%06d", "g"), kind, no_text, F.col("kids")))


@suite.query(
    "doc_nested_layout_sections",
    rf"""WITH l AS (SELECT doc_id, UNNEST(STRING_SPLIT(text, chr(10))) AS line, GENERATE_SUBSCRIPTS(STRING_SPLIT(text, chr(10)), 1) - 1 AS i FROM documents),
    w AS (SELECT doc_id, i, UNNEST(REGEXP_SPLIT_TO_ARRAY(line, '\s+')) AS word, GENERATE_SUBSCRIPTS(REGEXP_SPLIT_TO_ARRAY(line, '\s+'), 1) AS p FROM l),
    b AS (SELECT doc_id, i // 10 AS g, COALESCE(STRING_AGG(word, ' ' ORDER BY i, p) FILTER (WHERE word <> ''), '') AS t FROM w GROUP BY ALL),
    s AS (SELECT *, g // 3 + 1 AS page, SUM(CASE WHEN g % 4 = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY g) AS section_no FROM b)
    SELECT doc_id, CAST(section_no AS BIGINT) AS section_no, COALESCE(MAX(CASE WHEN g % 4 = 1 THEN COALESCE(NULLIF(t, ''), 'untitled') END), 'untitled-0') AS title,
    {_strip("COALESCE(STRING_AGG(CASE WHEN g % 4 <> 1 AND LENGTH(" + _strip('t') + ") > 2 THEN t END, chr(10) ORDER BY g), '')")} AS body,
    CAST(COALESCE(MIN(CASE WHEN g % 4 = 1 THEN page END), 1) AS BIGINT) AS page_start, CAST(MAX(page) AS BIGINT) AS page_end FROM s GROUP BY doc_id, section_no""",
)
def _nested(spark, sf):
    return documents.layout_sections(nested_blocks(spark, sf), "doc_id").select("doc_id", "section_no", "title", "body", "page_start", "page_end")


# ---- analysis index -------------------------------------------------------------------------


@suite.query(
    "analysis_index_children",
    f"WITH {_FOUND_SQL} SELECT client_id || ':' || section AS parent_id, client_id, section, kind, client_id || ' ' || section || ' — ' || text AS text, 32 AS dimension FROM fd WHERE section IS NOT NULL",
)
def _analysis_children(spark, sf):
    folder = shared_path(spark)
    files = tenant_files(spark, sf).select("client_id", "source_file", F.lit("s1").alias("signature"))
    fleet = tenant_fleet(spark, sf)
    incremental.ingest_analysis(
        spark, files, f"{folder}/ledger", f"{folder}/states", f"{folder}/index", lambda wanted: fleet.join(wanted, "source_file", "left_semi").select(*_analysed(fleet)),
        version="v1", processed_at="2024-01-31", source="source_file", date="load_start_time", entity="equipment_id", metrics=METRICS, dimension=32,
    )
    rows = read_current(spark, f"{folder}/index").filter("chunk_level = 'child'")
    return rows.select("parent_id", "client_id", "section", "kind", "text", F.size("embedding").alias("dimension"))


def _analysed(fleet: DataFrame) -> list[str]:
    """The columns that the analysis reads."""
    wanted = {"client_id", "source_file", "load_start_time", "equipment_id", *METRICS, *(c for n in dashboard.feasible_kpis(fleet.columns) for c in dashboard.REGISTRY[n].required)}
    return [c for c in fleet.columns if c in wanted]


_STATE_ONE = (
    "SELECT client_id, '{m}' AS metric, COUNT({m}) AS n, ROUND(MIN({m}), 3) AS min, ROUND(QUANTILE_CONT({m}, 0.25), 3) AS p25, ROUND(QUANTILE_CONT({m}, 0.5), 3) AS median, "
    "ROUND(QUANTILE_CONT({m}, 0.75), 3) AS p75, ROUND(MAX({m}), 3) AS max FROM tf GROUP BY client_id"
)


@suite.query("analysis_state_statistics", f"WITH {_FILES_SQL} " + " UNION ALL ".join(_STATE_ONE.format(m=m) for m in METRICS))
def _state_statistics(spark, sf):
    fleet = tenant_fleet(spark, sf)
    states, path = fleet.select(*_analysed(fleet)), shared_path(spark)
    replace_keys(incremental.file_states(states, "source_file", "load_start_time", "equipment_id", METRICS), path, "source_file")
    blocks = incremental.merged_blocks(read_current(spark, path), METRICS)
    return blocks["statistics"].select("client_id", "metric", "n", "min", "p25", "median", "p75", "max")


# ---- split CSV files ------------------------------------------------------------------------


@suite.query("source_split_csv", "SELECT doc_id, text, lang, CAST(n_chars AS BIGINT) AS n_chars FROM documents")
def _split_csv(spark, sf):
    """All documents, written as CSV with their line breaks inside quotes and read back by several tasks per file."""
    path = shared_path(spark)
    rows = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("say \"x\",\n"), "text").alias("text"), "lang", F.col("n_chars").cast("bigint").alias("n_chars"))
    rows.coalesce(2).write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    back = read_csv(spark, path, schema="doc_id bigint, text string, lang string, n_chars bigint")
    return back.select("doc_id", F.expr("substring(text, 10)").alias("text"), "lang", "n_chars")


# ---- stored vector index and package retrieval ----------------------------------------------


def _stored_index(spark, sf):
    path, vectors = shared_path(spark), tenant_vectors(spark, sf)
    model = learn_index(vectors, 12, parts=8)
    build_index(vectors, model, path, scope="client_id")
    return path, model


@suite.query("retrieve_stored_index_all_lists", f"WITH {_Q} {_OUT} ({_topk('client_id = q_client', 8)})")
def _all_lists(spark, sf):
    path, model = _stored_index(spark, sf)
    found = search_index(spark, path, model, tenant_queries(spark, sf), 8, probes=12, scope="client_id")
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@suite.query("retrieve_stored_index_recall", "SELECT TRUE AS enough, COUNT(DISTINCT label) AS queries FROM embeddings")
def _recall(spark, sf):
    """Whether ten of twelve lists and a short list of codes find nine tenths of the exact neighbours; the vectors have no clusters."""
    path, model = _stored_index(spark, sf)
    queries = tenant_queries(spark, sf)
    exact = retrieval.nearest(tenant_vectors(spark, sf), queries, 10, scope=("client_id", "client_id")).select("query_id", "vec_id")
    near = search_index(spark, path, model, queries, 10, probes=10, candidates=60, scope="client_id").select("query_id", "vec_id", F.lit(1).alias("found"))
    return exact.join(near, ["query_id", "vec_id"], "left").agg((F.count("found") >= 0.9 * F.count(F.lit(1))).alias("enough"), F.countDistinct("query_id").alias("queries"))


def tenant_indexes(spark, sf) -> dict:
    """The three indexes over the embeddings: pages of laws, chunks of telemetry files, findings and sections of analyses."""
    v = tenant_vectors(spark, sf).withColumn("row_id", F.col("vec_id"))
    text = lambda kind: F.concat(F.lit(f"{kind} "), F.col("vec_id").cast("string"))
    regulatory = v.filter("index = 'regulatory'").select(
        "row_id", F.concat(F.lit("law"), (F.col("vec_id") % 50).cast("string"), F.lit(".pdf")).alias("source"), F.lit("Rule").alias("title"), text("body").alias("body"),
        (F.col("vec_id") % 7 + 1).alias("page_start"), (F.col("vec_id") % 7 + 2).alias("page_end"), "embedding",
    )
    chunks = v.filter("index = 'telemetry'").select("row_id", F.concat("client_id", F.lit("/a.csv")).alias("source"), F.col("vec_id").alias("chunk_index"), text("chunk").alias("text"), "embedding")
    section = F.concat(F.lit("s"), (F.col("vec_id") % 4).cast("string"))
    children = v.filter("index = 'analysis'").select(
        "row_id", "client_id", F.lit("child").alias("chunk_level"), F.concat("client_id", F.lit(":"), section).alias("parent_id"), section.alias("section"), text("finding").alias("text"), "embedding"
    )
    parents = children.select("client_id", F.lit("parent").alias("chunk_level"), "parent_id", "section").distinct().select(
        "*", F.concat(F.lit("all of "), "parent_id").alias("text"), F.lit("a.csv").alias("sources"), F.to_json(F.struct("section")).alias("key_findings")
    )
    return {"regulatory": lambda: regulatory, "telemetry": lambda: chunks, "analysis": lambda: children.unionByName(parents, allowMissingColumns=True)}


_HITS_SQL = f"""{_Q}, t AS ({_topk("index = 'regulatory'", 4)} UNION ALL {_topk("index = 'telemetry' AND client_id = q_client", 4)} UNION ALL {_topk("index = 'analysis' AND client_id = q_client", 10)}),
    h AS (SELECT query_id, index, 'law' || (vec_id % 50) || '.pdf p.' || (vec_id % 7 + 1) || '-' || (vec_id % 7 + 2) AS locator, score, 'Rule' || chr(10) || 'body ' || vec_id AS text, NULL::VARCHAR AS findings FROM t WHERE index = 'regulatory'
    UNION ALL SELECT query_id, index, client_id || '/a.csv chunk ' || vec_id, score, 'chunk ' || vec_id, NULL FROM t WHERE index = 'telemetry'
    UNION ALL SELECT query_id, 'analysis', 'analysis:s' || (vec_id % 4) || ' (a.csv)', MAX(score), 'all of ' || client_id || ':s' || (vec_id % 4), '{{"section":"s' || (vec_id % 4) || '"}}' FROM t WHERE index = 'analysis' GROUP BY query_id, client_id, vec_id % 4)"""


@suite.query("retrieve_all_indexes", f"WITH {_HITS_SQL} SELECT query_id, index, locator, ROUND(score, 6) AS score, text, findings FROM h")
def _all_indexes(spark, sf):
    return retrieve.retrieve(tenant_indexes(spark, sf), tenant_queries(spark, sf)).hits.withColumn("score", F.round("score", 6))


@suite.query(
    "retrieve_evaluation_by_model",
    f"""WITH {_HITS_SQL}, a AS (SELECT q.query_id, 'C' || (q.query_id % 3) AS client_id, m.model, COUNT(h.locator) AS documents, COUNT(*) FILTER (WHERE h.index = 'regulatory') AS r,
      COUNT(*) FILTER (WHERE h.index = 'telemetry') AS t, COUNT(*) FILTER (WHERE h.index = 'analysis') AS s FROM q JOIN h USING (query_id), (VALUES ('small'), ('large')) AS m(model) GROUP BY ALL)
    SELECT client_id, model, query_id, 1::BIGINT AS answers, 0::BIGINT AS failed, documents, r AS regulatory_hits, t AS telemetry_hits, s AS analysis_hits,
    CAST(LENGTH(model) + documents AS BIGINT) AS answer_chars, ROUND(documents / 4.0, 3)::DOUBLE AS mean_seconds, (documents / 4.0)::DOUBLE AS max_seconds FROM a""",
)
def _evaluation(spark, sf):
    hits = retrieve.retrieve(tenant_indexes(spark, sf), tenant_queries(spark, sf)).hits
    answered = hits.groupBy("query_id").agg(F.collect_list(F.struct("index", "locator")).alias("documents"))
    answers = answered.select("query_id", "documents", F.concat(F.lit("C"), (F.col("query_id") % 3).cast("string")).alias("client_id"), F.explode(F.array(F.lit("small"), F.lit("large"))).alias("model"))
    filled = answers.withColumn("answer", F.concat("model", F.repeat(F.lit("x"), F.size("documents")))).withColumn("seconds", F.size("documents") / 4.0)
    return retrieve.evaluation_matrix(filled.withColumn("error", F.lit(None).cast("string")))


# ---- columns not yet covered ----------------------------------------------------------------

suite.add(
    "schema_uncovered_metrics",
    lambda spark, sf: uncovered_columns(
        table(spark, sf, "events").select(F.col("event_type").alias("file"), F.concat(F.lit("user_"), (F.col("user_id") % 40).cast("string")).alias("column")),
        table(spark, sf, "events").filter("value > 50").select(F.col("event_type").alias("file"), F.concat(F.lit("user_"), (F.col("user_id") % 40).cast("string")).alias("column")),
        "file", "column",
    ),
    "SELECT DISTINCT event_type AS file, 'user_' || (user_id % 40) AS \"column\" FROM events EXCEPT SELECT event_type, 'user_' || (user_id % 40) FROM events WHERE value > 50",
)
