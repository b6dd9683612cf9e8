"""Document, text-chunk and telemetry-chunk queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orepulse.functions import text as fx
from orepulse.operators import chunking, documents
from orepulse.operators.quality import mask_identifiers
from orepulse.operators.retrieval import text_preview
from orepulse.operators.scans import trailing_rows
from orepulse.plans.suite import Suite, half_up
from orepulse.sources.tables import table

suite = Suite()

_STRIP = r"REGEXP_REPLACE({}, '^\s+|\s+$', '', 'g')"


def _strip(x: str) -> str:
    return _STRIP.format(x)


# ---- scalar functions -----------------------------------------------------------------------

_NAME = "'Vendor (' || source || ') Report_' || doc_id || '.final.PDF'"


@suite.query(
    "fn_names_and_slugs",
    rf"""WITH n AS (SELECT doc_id, {_NAME} AS name, 'C' || doc_id % 3 || '/' || source || '/' || {_NAME} AS path FROM documents)
    SELECT doc_id, REGEXP_REPLACE(LOWER(name), '[^a-z0-9]', '', 'g') AS name_key,
    TRIM(REGEXP_REPLACE(REGEXP_REPLACE(LOWER(REGEXP_REPLACE(name, '\.[^.]*$', '')), '[^a-z0-9-]', '-', 'g'), '-{{2,}}', '-', 'g'), '-') AS slug,
    {_strip(r"REGEXP_REPLACE(REGEXP_REPLACE(LOWER(REGEXP_REPLACE(name, '\.[^.]*$', '')), '[^a-zA-Z0-9\s\-()\[\]]', '-', 'g'), '\s+', ' ', 'g')")} AS vector_key,
    REGEXP_EXTRACT(path, '([^/]+)/[^/]*$', 1) AS folder, REGEXP_REPLACE(REGEXP_EXTRACT(path, '[^/]*$'), '\.[^.]*$', '') AS stem,
    PRINTF('%s/%s__chunk_%05d', 'f', 's', doc_id) AS chunk_id, PRINTF('%s-s%04d', 'b', doc_id) AS section_id,
    ENDS_WITH(LOWER(name), '.pdf') AS is_pdf FROM n""",
)
def _names(spark, sf):
    from orepulse.operators.schema import name_key

    d = table(spark, sf, "documents").selectExpr("doc_id", f"{_NAME} AS name", f"'C' || doc_id % 3 || '/' || source || '/' || {_NAME} AS path")
    name, path = F.col("name"), F.col("path")
    return d.select(
        "doc_id", name_key(name).alias("name_key"), fx.file_slug(name).alias("slug"), fx.vector_key(name).alias("vector_key"),
        fx.parent_folder(path).alias("folder"), fx.file_stem(path).alias("stem"),
        fx.chunk_id(F.lit("f"), F.lit("s"), F.col("doc_id")).alias("chunk_id"), fx.section_id(F.lit("b"), F.col("doc_id")).alias("section_id"),
        F.lower(name).endswith(".pdf").alias("is_pdf"),
    )


@suite.query(
    "fn_labels_and_times",
    """SELECT event_id, UPPER(event_type[1]) || event_type[2:] || ' Count' AS label,
    CASE WHEN event_id < 60 THEN event_id || 'm ago' WHEN event_id < 1440 THEN (event_id // 60) || 'h ago' ELSE (event_id // 1440) || 'd ago' END AS ago,
    CASE WHEN event_id < 60 THEN event_id || 'm' WHEN event_id % 60 > 0 THEN (event_id // 60) || 'h ' || (event_id % 60) || 'm' ELSE (event_id // 60) || 'h' END AS took,
    STRFTIME(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN MICROSECOND(ts) % 1000000 = 0 THEN '' ELSE STRFTIME(ts, '.%f') END AS iso FROM events""",
)
def _labels(spark, sf):
    e = table(spark, sf, "events")
    return e.select(
        "event_id", fx.title_label(F.concat("event_type", F.lit("_count"))).alias("label"), fx.relative_time(F.col("event_id")).alias("ago"),
        fx.duration_text(F.col("event_id")).alias("took"), fx.iso_timestamp(F.col("ts")).alias("iso"),
    )


@suite.query(
    "fn_number_texts",
    f"""SELECT event_id, FORMAT('{{:,}}', CAST(ROUND(value * 1000) AS BIGINT)) AS thousands, PRINTF('%.1f%%', {half_up('value', 1)}) AS percent,
    CASE WHEN event_id % 3 = 0 THEN event_type ELSE CAST({half_up('value', 2)} AS VARCHAR) END AS shown, LEFT(REPEAT(event_type || ' ', 80), 300) AS preview FROM events""",
)
def _number_texts(spark, sf):
    e = table(spark, sf, "events")
    mixed = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(F.col("value").cast("string"))
    return e.select(
        "event_id", fx.thousands_text(F.col("value") * 1000).alias("thousands"), fx.percent_text(F.col("value")).alias("percent"), fx.rounded_or_same(mixed, 2).alias("shown"),
        text_preview(F.repeat(F.concat("event_type", F.lit(" ")), F.lit(80))).alias("preview"),
    )


@suite.query(
    "fn_clean_title_and_body",
    rf"""SELECT doc_id, LEFT({_strip(r"REGEXP_REPLACE(NFC_NORMALIZE(text), '\s+', ' ', 'g')")}, 200) AS title,
    {_strip(r"REGEXP_REPLACE(REGEXP_REPLACE(REGEXP_REPLACE(NFC_NORMALIZE(text), '(?m)^\s*\d{1,4}\s*$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]{2,}', ' ', 'g')")} AS body FROM documents""",
)
def _clean(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", fx.clean_title(F.col("text")).alias("title"), fx.clean_body(F.col("text")).alias("body"))


@suite.query(
    "fn_json_from_text",
    """SELECT event_id, props AS fenced, props AS braces, '[' || event_id || ', 2]' AS list, 'answer' AS plain, 'kept' AS shown FROM events""",
)
def _json(spark, sf):
    e = table(spark, sf, "events")
    return e.select(
        "event_id",
        fx.json_from_text(F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n``` {not this}"))).alias("fenced"),
        fx.json_from_text(F.concat(F.lit("Here is "), "props", F.lit(" as asked {x"))).alias("braces"),
        fx.json_array_from_text(F.concat(F.lit("rows: ["), "event_id", F.lit(", 2] end"))).alias("list"),
        fx.json_from_text(F.lit("answer")).alias("plain"),
        fx.without_thoughts(F.lit("<think>a\nb</think> kept ")).alias("shown"),
    )


@suite.query(
    "fn_vector_casts",
    "SELECT vec_id, CAST(LIST_SUM(LIST_TRANSFORM(embedding, lambda x: CAST(ROUND(CAST(x AS DOUBLE) * 127) AS INT))) AS BIGINT) AS quantised_sum, LEN(embedding) AS n FROM embeddings",
)
def _vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    back = fx.widen(fx.quantise(F.transform("embedding", lambda x: x.cast("double"))))
    return e.select("vec_id", F.aggregate(back, F.lit(0.0), lambda a, x: a + x).cast("bigint").alias("quantised_sum"), F.size(back).cast("bigint").alias("n"))


@suite.query(
    "fn_url_decoded_keys",
    "SELECT page_id, 'C1/manual ' || page_id || '.pdf' AS object_key, 'manual ' || page_id || '.pdf' AS file_name, TRUE AS is_pdf FROM pages",
)
def _keys(spark, sf):
    from orepulse.sources.files import object_key_parts

    key = F.concat(F.lit("C1%2Fmanual+"), F.col("page_id").cast("string"), F.lit(".pdf"))
    return table(spark, sf, "pages").select("page_id", *[c.alias(n) for n, c in object_key_parts(key).items()])


# ---- documents ------------------------------------------------------------------------------

_DOC_FACTS = (
    "SELECT d.doc_id, CAST(n_chars AS DOUBLE) AS avg_chars, CAST(n_chars // 100 AS BIGINT) AS page_count, CASE WHEN source = 'src3' THEN 'Safety_Code' WHEN source = 'src4' THEN 'scanned_form' END AS tag, "
    "CASE WHEN quality = 1 THEN 'complex_legal' WHEN quality = 0 THEN 'simple' END AS model_class, CASE WHEN toxic = 1 THEN 0.5 ELSE 0.9 END AS model_confidence "
    "FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id"
)


@suite.query(
    "doc_classification",
    f"""WITH f AS ({_DOC_FACTS}), g AS (SELECT *, avg_chars < 200 AND avg_chars > 0 AS scanned, page_count > 40 AND avg_chars < 600 AS sparse,
    LOWER(COALESCE(tag, '')) = 'safety_code' AS complex, LOWER(COALESCE(tag, '')) = 'scanned_form' AS easy FROM f)
    SELECT doc_id, CASE WHEN scanned OR sparse THEN 'simple' WHEN complex THEN 'complex_legal' WHEN easy THEN 'simple'
    WHEN model_class IS NULL OR model_confidence < 0.7 THEN 'complex_legal' ELSE model_class END AS doc_class,
    CAST(CASE WHEN scanned THEN 0.95 WHEN sparse THEN 0.85 WHEN complex OR easy THEN 0.99 ELSE model_confidence END AS DOUBLE) AS confidence,
    CASE WHEN scanned OR sparse THEN 'heuristic' WHEN complex OR easy THEN 'tag' ELSE 'model' END AS signal FROM g""",
)
def _classify(spark, sf):
    d, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    facts = d.join(labels, "doc_id", "left").select(
        "doc_id", F.col("n_chars").cast("double").alias("avg_chars"), F.expr("n_chars div 100").alias("page_count"),
        F.when(F.col("source") == "src3", "Safety_Code").when(F.col("source") == "src4", "scanned_form").alias("doc_type_tag"),
        F.when(F.col("quality") == 1, "complex_legal").when(F.col("quality") == 0, "simple").alias("model_class"),
        F.when(F.col("toxic") == 1, 0.5).otherwise(0.9).alias("model_confidence"),
    )
    return documents.classify_documents(facts).select("doc_id", "doc_class", "confidence", "signal")


suite.add(
    "doc_route_by_size",
    lambda spark, sf: table(spark, sf, "documents").select(
        "doc_id", documents.route_by_size(F.col("n_chars") / 100, F.col("n_chars") / 1000).alias("route")
    ),
    "SELECT doc_id, CASE WHEN n_chars / 100 > 95 OR n_chars / 1000 > 18.0 THEN 'batch' ELSE 'single' END AS route FROM documents",
)

# Documents with a numbered heading before every tenth line and shouted first words, as rulebooks have.


def rulebook(spark, sf) -> DataFrame:
    lined = F.transform(
        F.split("text", "\n", -1),
        lambda line, i: F.when(i % 10 == 0, F.concat(F.lit("Section "), i.cast("string"), F.lit(".1 Scope\n"), line))
        .when(i % 10 == 5, F.concat(F.lit("HAUL ROAD RULES\n"), line))
        .otherwise(line),
    )
    return table(spark, sf, "documents").select("doc_id", "source", F.array_join(lined, "\n").alias("text"))


_RULEBOOK_SQL = """rule AS (SELECT doc_id, source, ARRAY_TO_STRING(LIST_TRANSFORM(STRING_SPLIT(text, chr(10)), lambda line, i: CASE WHEN (i - 1) % 10 = 0
    THEN 'Section ' || (i - 1) || '.1 Scope' || chr(10) || line WHEN (i - 1) % 10 = 5 THEN 'HAUL ROAD RULES' || chr(10) || line ELSE line END), chr(10)) AS text FROM documents)"""
_LINES_SQL = _RULEBOOK_SQL + rf""", li AS (SELECT doc_id, CAST((line_no - 1) // 40 + 1 AS BIGINT) AS page, {_strip('line')} AS line FROM
    (SELECT doc_id, UNNEST(STRING_SPLIT(text, chr(10))) AS line, GENERATE_SUBSCRIPTS(STRING_SPLIT(text, chr(10)), 1) AS line_no FROM rule))"""
_NUMBERED = r"(?i)^(?:part|division|section|schedule|chapter|appendix|regulation|clause|article)[\s\x{00A0}]+[\dA-Z][\w.\-]*"
_HEADINGS_SQL = _LINES_SQL + rf""", hd AS (SELECT doc_id, page, line AS title, 'numbering' AS method FROM li WHERE REGEXP_MATCHES(line, '{_NUMBERED}') AND LENGTH(line) <= 200
    UNION ALL SELECT doc_id, page, line, 'all_caps' FROM li WHERE LENGTH(line) <= 100 AND REGEXP_MATCHES(REGEXP_REPLACE(line, '[^\p{{L}}]', '', 'g'), '^\p{{Lu}}{{3,}}$'))"""


def _headings(spark, sf) -> DataFrame:
    return documents.heading_lines(documents.text_lines(rulebook(spark, sf), "doc_id", "text"), "doc_id")


suite.add(
    "doc_headings",
    lambda spark, sf: _headings(spark, sf).groupBy("doc_id", "page", "title", "method").agg(F.count(F.lit(1)).alias("n")),
    f"WITH {_HEADINGS_SQL} SELECT doc_id, page, title, method, COUNT(*) AS n FROM hd GROUP BY ALL",
)
suite.add(
    "doc_distinct_boundaries",
    lambda spark, sf: documents.distinct_boundaries(_headings(spark, sf), "doc_id"),
    f"""WITH {_HEADINGS_SQL}, r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id, page, LOWER(LEFT(title, 60)) ORDER BY title,
    CASE method WHEN 'numbering' THEN 1 ELSE 2 END) AS rn FROM hd) SELECT doc_id, page, title, method FROM r WHERE rn = 1""",
)


def printed_words(spark, sf) -> DataFrame:
    """Words of the documents laid out ten to a line and thirty lines to a page; every ninth line in bigger, bolder print."""
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", r"\s+")).alias("pos", "text")).filter("text <> ''")
    line = F.floor(F.col("pos") / 10)
    return d.select(
        "doc_id", (F.floor(line / 30) + 1).alias("page"), ((line % 30) * 12.0).alias("top"), (F.col("pos") % 10 * 50.0).alias("x0"),
        F.when(line % 9 == 4, 16.0).otherwise(10.0 + (F.col("doc_id") % 3)).alias("size"),
        F.when(line % 18 == 4, "Arial-Bold").otherwise("Arial").alias("fontname"), "text",
    )


suite.add(
    "doc_font_size_headings",
    lambda spark, sf: documents.font_size_headings(printed_words(spark, sf), "doc_id"),
    r"""WITH w AS (SELECT doc_id, pos - 1 AS pos, t FROM (SELECT doc_id, UNNEST(REGEXP_SPLIT_TO_ARRAY(text, '\s+')) AS t,
    GENERATE_SUBSCRIPTS(REGEXP_SPLIT_TO_ARRAY(text, '\s+'), 1) AS pos FROM documents) WHERE t <> ''),
    p AS (SELECT *, pos // 10 AS line, pos // 10 // 30 + 1 AS page, CASE WHEN pos // 10 % 9 = 4 THEN 16.0 ELSE 10.0 + doc_id % 3 END AS size FROM w),
    m AS (SELECT doc_id, QUANTILE_CONT(CAST(size AS DOUBLE), 0.5) AS median FROM p GROUP BY doc_id),
    l AS (SELECT doc_id, page, line, AVG(size) AS avg_size, STRING_AGG(t, ' ' ORDER BY pos) AS title, line % 18 = 4 AS bold FROM p GROUP BY ALL)
    SELECT doc_id, CAST(page AS BIGINT) AS page, title, 'font_size' AS method FROM l JOIN m USING (doc_id) WHERE avg_size >= median + 2 AND LENGTH(title) BETWEEN 3 AND 200
    AND (bold OR (LENGTH(title) <= 100 AND REGEXP_MATCHES(REGEXP_REPLACE(title, '[^\p{L}]', '', 'g'), '^\p{Lu}{3,}$')))""",
)


def layout_blocks(spark, sf) -> DataFrame:
    """A layout graph over document lines: three lines to a container; some containers are headers, some tables of cells."""
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    c = F.floor(F.col("i") / 3)
    kind = F.when(c % 5 == 2, "LAYOUT_SECTION_HEADER").when(c % 7 == 3, "TABLE").otherwise("LAYOUT_TEXT")
    placed = lines.withColumns({"c": c, "kind": kind})
    nothing = F.array().cast("array<string>")
    page, top = (F.floor(F.col("c") / 10) + 1), (F.col("c") % 10).cast("double")

    def block(ident, btype, text, children, left=0.0):
        return [
            "doc_id", ident.alias("block_id"), F.lit(btype).alias("block_type") if isinstance(btype, str) else btype.alias("block_type"),
            page.alias("page"), top.alias("top"), F.lit(left).alias("left_pos"), text.alias("text"), children.alias("child_ids"),
        ]

    line_id, cell_id = F.format_string("L%06d", "i"), F.format_string("X%06d", "i")
    leaf = placed.select(*block(line_id, "LINE", F.col("line"), nothing))
    cells = placed.filter("kind = 'TABLE'").select(*block(cell_id, "CELL", F.lit(None).cast("string"), F.array(line_id)))
    groups = placed.groupBy("doc_id", "c", "kind").agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") == "TABLE", cell_id).otherwise(line_id))).alias("kids")
    )
    containers = groups.select(*block(F.format_string("B%06d", "c"), F.col("kind"), F.lit(None).cast("string"), F.col("kids")))
    return leaf.unionByName(cells).unionByName(containers)


suite.add(
    "doc_block_texts",
    lambda spark, sf: documents.block_texts(layout_blocks(spark, sf), "doc_id").filter("block_id LIKE 'B%' AND resolved <> ''"),
    """WITH l AS (SELECT doc_id, UNNEST(STRING_SPLIT(text, chr(10))) AS line, GENERATE_SUBSCRIPTS(STRING_SPLIT(text, chr(10)), 1) - 1 AS i FROM documents)
    SELECT doc_id, PRINTF('B%06d', i // 3) AS block_id, STRING_AGG(line, ' ' ORDER BY i) AS resolved FROM l WHERE line <> '' GROUP BY doc_id, i // 3""",
)
suite.add(
    "doc_layout_sections",
    lambda spark, sf: documents.layout_sections(layout_blocks(spark, sf), "doc_id").withColumn("tables", documents.tables_text(F.col("tables"))),
    rf"""WITH l AS (SELECT doc_id, UNNEST(STRING_SPLIT(text, chr(10))) AS line, GENERATE_SUBSCRIPTS(STRING_SPLIT(text, chr(10)), 1) - 1 AS i FROM documents),
    b AS (SELECT doc_id, i // 3 AS c, COALESCE(STRING_AGG(line, ' ' ORDER BY i) FILTER (WHERE line <> ''), '') AS t, STRING_AGG('| ' || TRIM(line) || ' |', chr(10) ORDER BY i) AS rows_ FROM l GROUP BY ALL),
    k AS (SELECT *, CASE WHEN c % 5 = 2 THEN 'H' WHEN c % 7 = 3 THEN 'T' ELSE 'X' END AS kind, c // 10 + 1 AS page FROM b),
    s AS (SELECT *, SUM(CASE WHEN kind = 'H' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY c) AS section_no FROM k)
    SELECT doc_id, COALESCE(STRING_AGG(CASE WHEN kind = 'T' THEN rows_ || chr(10) END, chr(10) ORDER BY c), '') AS tables, CAST(section_no AS BIGINT) AS section_no, COALESCE(MAX(CASE WHEN kind = 'H' THEN COALESCE(NULLIF(t, ''), 'untitled') END), 'untitled-0') AS title,
    {_strip("COALESCE(STRING_AGG(CASE WHEN kind = 'X' AND LENGTH(" + _strip('t') + ") > 2 THEN t END, chr(10) ORDER BY c), '')")} AS body,
    COUNT(*) FILTER (WHERE kind = 'T') AS table_count, CAST(COALESCE(MIN(CASE WHEN kind = 'H' THEN page END), 1) AS BIGINT) AS page_start, CAST(MAX(page) AS BIGINT) AS page_end
    FROM s GROUP BY doc_id, section_no""",
)


@suite.query(
    "doc_table_text",
    """WITH c AS (SELECT user_id, event_type, hour(ts) % 3 AS r, ROUND(MAX(value), 2) AS v FROM events GROUP BY ALL),
    l AS (SELECT user_id, event_type, r, '| ' || STRING_AGG(w, ' | ' ORDER BY k) || ' |' AS line FROM (SELECT user_id, event_type, r, 1 AS k, 'row ' || r AS w FROM c UNION ALL
    SELECT user_id, event_type, r, 2, CAST(v AS VARCHAR) FROM c) GROUP BY ALL), t AS (SELECT user_id, event_type, STRING_AGG(line, chr(10) ORDER BY r) || chr(10) AS t FROM l GROUP BY ALL)
    SELECT user_id, STRING_AGG(t, chr(10) ORDER BY event_type) AS tables_text FROM t GROUP BY user_id""",
)
def _table_text(spark, sf):
    c = table(spark, sf, "events").groupBy("user_id", F.col("event_type").alias("table_no"), (F.hour("ts") % 3).alias("row_index")).agg(F.round(F.max("value"), 2).alias("v"))
    pair = F.array(
        F.struct(F.lit(1).alias("col_index"), F.concat(F.lit("row "), F.col("row_index").cast("string")).alias("text")),
        F.struct(F.lit(2).alias("col_index"), F.col("v").cast("string").alias("text")),
    )
    return documents.table_text(c.select("user_id", "table_no", "row_index", F.inline(pair)), ["user_id"])


_PIECES = """CASE WHEN LENGTH({t}) <= {m} THEN [{t}] ELSE LIST_TRANSFORM(RANGE(0, CASE WHEN (LENGTH({t}) - 1) // {s} > 0 AND LENGTH({t}) - ((LENGTH({t}) - 1) // {s}) * {s} <= {o}
    THEN (LENGTH({t}) - 1) // {s} ELSE (LENGTH({t}) - 1) // {s} + 1 END), lambda i: SUBSTRING({t}, CAST(i * {s} + 1 AS BIGINT), {m})) END"""


def pieces_sql(text: str, size: int, overlap: int) -> str:
    return _PIECES.format(t=text, m=size, s=size - overlap, o=overlap)


for _size, _overlap in ((6000, 100), (500, 50)):
    suite.add(
        f"text_chunk_length_{_size}",
        lambda spark, sf, m=_size, o=_overlap: documents.chunk_text(
            table(spark, sf, "documents").select("doc_id", "text"), "text", max_chars=m, overlap=o
        ),
        f"WITH p AS (SELECT doc_id, {pieces_sql('text', _size, _overlap)} AS parts FROM documents) "
        "SELECT doc_id, CAST(GENERATE_SUBSCRIPTS(parts, 1) - 1 AS INT) AS chunk_no, UNNEST(parts) AS chunk FROM p",
    )

_HTML = [
    ("(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", "' '"), ("(?i)<h[1-6][^>]*>", "chr(10) || '# '"),
    ("(?i)</h[1-6]>|</p>|<br[^>]*>|</li>", "chr(10)"), ("(?s)<[^>]*>", "' '"),
]


def html_sql(column: str) -> str:
    text = column
    for pattern, by in _HTML:
        text = f"REGEXP_REPLACE({text}, '{pattern}', {by}, 'g')"
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&quot;", '"'), ("&amp;", "&")):
        text = f"REPLACE({text}, '{entity}', '{char}')"
    return _strip(f"REGEXP_REPLACE({text}, '[ \\t]+', ' ', 'g')")


suite.add(
    "source_html_text",
    lambda spark, sf: table(spark, sf, "pages").select("page_id", fx.html_text(F.col("html")).alias("text")),
    f"SELECT page_id, {html_sql('html')} AS text FROM pages",
)
_SECTION = r"(?m)(^#{1,6}\s+.+$|^[A-Z][^\n]{0,80}\n[-=]{3,})"
suite.add(
    "text_chunk_section",
    lambda spark, sf: documents.chunk_text(
        table(spark, sf, "pages").select("page_id", fx.html_text(F.col("html")).alias("text")), "text", strategy="section", max_chars=1500
    ),
    f"""WITH t AS (SELECT page_id, {html_sql('html')} AS text FROM pages),
    s AS (SELECT page_id, text, LIST_FILTER(LIST_TRANSFORM(STRING_SPLIT(REGEXP_REPLACE(text, '{_SECTION}', chr(1) || chr(2) || '\\1', 'g'), chr(1) || chr(2)), lambda x: {_strip('x')}), lambda x: LENGTH(x) > 0) AS secs FROM t),
    p AS (SELECT page_id, CASE WHEN REGEXP_MATCHES(text, '{_SECTION}') THEN FLATTEN(LIST_TRANSFORM(secs, lambda x: {pieces_sql('x', 1500, 0)})) ELSE {pieces_sql('text', 1500, 0)} END AS parts FROM s)
    SELECT page_id, CAST(GENERATE_SUBSCRIPTS(parts, 1) - 1 AS INT) AS chunk_no, UNNEST(parts) AS chunk FROM p""",
)


@suite.query(
    "text_group_pages",
    """WITH l AS (SELECT doc_id, (i - 1) // 20 + 1 AS page, STRING_AGG(line, chr(10) ORDER BY i) AS t FROM (SELECT doc_id, UNNEST(STRING_SPLIT(text, chr(10))) AS line,
    GENERATE_SUBSCRIPTS(STRING_SPLIT(text, chr(10)), 1) AS i FROM documents) GROUP BY ALL)
    SELECT doc_id, CAST((page - 1) // 2 AS BIGINT) AS page_group, CAST(MIN(page) AS BIGINT) AS first_page, CAST(MAX(page) AS BIGINT) AS last_page, STRING_AGG(t, chr(10) ORDER BY page) AS text FROM l GROUP BY doc_id, (page - 1) // 2""",
)
def _pages(spark, sf):
    lines = F.split("text", "\n", -1)
    count = F.ceil(F.size(lines) / 20).cast("int")
    page = F.transform(F.sequence(F.lit(1), count), lambda p: F.struct(p.cast("bigint").alias("page"), F.array_join(F.slice(lines, (p - 1) * 20 + 1, F.lit(20)), "\n").alias("text")))
    return documents.group_pages(table(spark, sf, "documents").select("doc_id", F.inline(page)), "doc_id", "page", "text")


_BODY = _strip(r"REGEXP_REPLACE(REGEXP_REPLACE(REGEXP_REPLACE(NFC_NORMALIZE(text), '(?m)^\s*\d{1,4}\s*$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]{2,}', ' ', 'g')")
suite.add(
    "doc_normalise_sections",
    lambda spark, sf: documents.normalise_sections(
        table(spark, sf, "documents").withColumn("title", F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit(" Rule\n"), F.col("doc_id").cast("string")))),
        "source", "doc_id", "title", "text",
    ),
    f"""WITH b AS (SELECT source, doc_id, CASE WHEN doc_id % 4 > 0 THEN 'Rule ' || doc_id ELSE '' END AS title, {_BODY} AS body FROM documents),
    p AS (SELECT *, CASE WHEN LENGTH(body) < 50 THEN [] ELSE {pieces_sql('body', 8000, 200)} END AS parts FROM b),
    o AS (SELECT *, LEN(parts) AS n, SUM(LEN(parts)) OVER (PARTITION BY source ORDER BY doc_id) - LEN(parts) AS first FROM p),
    x AS (SELECT source, doc_id, title, n, CAST(first AS BIGINT) AS first, GENERATE_SUBSCRIPTS(parts, 1) - 1 AS part, UNNEST(parts) AS body FROM o)
    SELECT source, doc_id, PRINTF('%s-s%04d', source, first + part) AS section_id, CASE WHEN title = '' THEN 'untitled-' || first ELSE title END
    || CASE WHEN n > 1 THEN ' (part ' || (part + 1) || ' of ' || n || ')' ELSE '' END AS title, body, part = 0 AS carries_tables FROM x""",
)
suite.add(
    "doc_previous_context",
    lambda spark, sf: documents.with_previous_context(table(spark, sf, "documents"), "source", "doc_id", "lang", "text"),
    "SELECT source, doc_id, lang, LAG(lang) OVER w AS previous_title, LAG(LEFT(text, 300)) OVER w AS previous_start FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)",
)
suite.add(
    "doc_pack_batches",
    lambda spark, sf: documents.pack_batches(
        table(spark, sf, "documents").select(
            F.col("source"), (F.col("doc_id") + 1).alias("page"), (F.col("n_chars") / 1000).alias("megabytes"), (F.col("doc_id") % 3 == 0).alias("starts_section")
        ),
        "source", max_pages=10, max_mb=15.0,
    ).withColumn("size_mb", F.round("size_mb", 6)),
    """WITH RECURSIVE p AS (SELECT source, doc_id + 1 AS page, n_chars / 1000 AS mb, doc_id % 3 = 0 AS starts, ROW_NUMBER() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
    w AS (SELECT *, LIST(mb) OVER f AS mbs, LIST(starts) OVER f AS ss, LIST(page) OVER f AS ps FROM p WINDOW f AS (PARTITION BY source ORDER BY i ROWS BETWEEN CURRENT ROW AND 10 FOLLOWING)),
    k AS (SELECT *, LIST_MAX([1] || LIST_FILTER(RANGE(2, LEAST(LEN(mbs), 10) + 1), lambda j: LIST_SUM(mbs[1:j]) <= 15.0)) AS fit FROM w),
    c AS (SELECT *, CASE WHEN LEN(mbs) > fit THEN COALESCE(LIST_MAX(LIST_FILTER(RANGE(1, fit + 1), lambda j: ss[j + 1])), fit) ELSE fit END AS n FROM k),
    b AS (SELECT source, i, n, 0 AS batch_index, page, ps, mbs FROM c WHERE i = 1 UNION ALL SELECT c.source, c.i, c.n, batch_index + 1, c.page, c.ps, c.mbs FROM b JOIN c ON c.source = b.source AND c.i = b.i + b.n)
    SELECT source, CAST(batch_index AS BIGINT) AS batch_index, CAST(page AS BIGINT) AS page_start, CAST(ps[n] AS BIGINT) AS page_end, ROUND(LIST_SUM(mbs[1:n]), 6) AS size_mb FROM b""",
)

# ---- telemetry chunks -----------------------------------------------------------------------


def telemetry(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        F.concat(F.lit("C"), (F.col("user_id") % 3 + 1).cast("string"), F.lit("/sensors/events.csv")).alias("source_file"),
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("TRK-"), F.col("user_id").cast("string")).alias("equipment_id"), "event_type",
        F.col("value").alias("fuel_litres"), F.get_json_object("props", "$.k").cast("double").alias("vibration"),
    )


_TEL = (
    "tel AS (SELECT 'C' || (user_id % 3 + 1) || '/sensors/events.csv' AS source_file, event_id, ts, 'TRK-' || user_id AS equipment_id, event_type, value AS fuel_litres, "
    "CAST(JSON_EXTRACT_STRING(props, '$.k') AS DOUBLE) AS vibration FROM events)"
)


def window_chunks_sql(max_rows: int, overlap: int, split: bool = True) -> str:
    sub = f"(rn - 1) // {max_rows}" if split else "0"
    keep = "" if split else f"WHERE rn <= {max_rows}"
    return f"""{_TEL}, t0 AS (SELECT source_file, MIN(ts) AS t0 FROM tel GROUP BY 1), win AS (SELECT tel.*, (EPOCH_US(ts) - EPOCH_US(t0)) // (7 * 86400000000) AS win FROM tel JOIN t0 USING (source_file)),
    rk AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source_file, win ORDER BY ts, event_id) AS rn FROM win), kept AS (SELECT *, {sub} AS sub FROM rk {keep}),
    g AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source_file ORDER BY win, rn) - 1 AS g, DENSE_RANK() OVER (PARTITION BY source_file ORDER BY win, sub) - 1 AS c FROM kept),
    bd AS (SELECT source_file, c AS chunk_index, MIN(g) AS lo, MAX(g) AS hi FROM g GROUP BY ALL),
    chunk AS (SELECT g.source_file, event_id, ts, equipment_id, event_type, fuel_litres, vibration, chunk_index, g - GREATEST(lo - {overlap}, 0) AS position FROM g JOIN bd ON bd.source_file = g.source_file
    AND g.g BETWEEN GREATEST(lo - {overlap}, 0) AND hi)"""


_chunks = lambda spark, sf, **o: chunking.time_window_chunks(telemetry(spark, sf), "source_file", "ts", ["event_id"], **o)
_MEMBERS = "SELECT source_file, event_id, CAST(chunk_index AS BIGINT) AS chunk_index, CAST(position AS BIGINT) AS position FROM chunk"
for _name, _opts in (
    ("chunk_time_window", {"max_rows": 500, "overlap": 50}), ("chunk_time_window_no_overlap", {"max_rows": 200, "overlap": 0}),
    ("chunk_time_window_wide_overlap", {"max_rows": 20, "overlap": 45}),
):
    suite.add(
        _name, lambda spark, sf, o=_opts: _chunks(spark, sf, **o).select("source_file", "event_id", "chunk_index", "position"),
        f"WITH {window_chunks_sql(**_opts)} {_MEMBERS}",
    )
suite.add(
    "chunk_time_window_split",
    lambda spark, sf: _chunks(spark, sf, max_rows=300, overlap=30).select("source_file", "event_id", "chunk_index", "position"),
    f"WITH {window_chunks_sql(300, 30)} {_MEMBERS}",
)
suite.add(
    "chunk_dropped_rows",
    lambda spark, sf: chunking.dropped_by_cap(telemetry(spark, sf), "source_file", "ts"),
    f"WITH {window_chunks_sql(500, 50)}, n AS (SELECT source_file, win, COUNT(*) AS n FROM win GROUP BY ALL) "
    ", k AS (SELECT source_file, COUNT(DISTINCT event_id) AS kept FROM chunk GROUP BY 1) "
    "SELECT n.source_file, CAST(SUM(n) AS BIGINT) AS rows, CAST(SUM(n) - MAX(kept) AS BIGINT) AS dropped_rows FROM n JOIN k USING (source_file) GROUP BY 1",
)
suite.add(
    "chunk_row_count",
    lambda spark, sf: chunking.row_count_chunks(telemetry(spark, sf), "source_file", ["event_id"], size=200, overlap=20).select(
        "source_file", "event_id", "chunk_index", "position"
    ),
    f"""WITH {_TEL}, i AS (SELECT source_file, event_id, ROW_NUMBER() OVER (PARTITION BY source_file ORDER BY event_id) - 1 AS i FROM tel),
    e AS (SELECT source_file, event_id, i, UNNEST(RANGE(GREATEST(0, CAST(CEIL((i - 199) / 180) AS BIGINT)), i // 180 + 1)) AS chunk_index FROM i)
    SELECT source_file, event_id, chunk_index, i - chunk_index * 180 AS position FROM e""",
)
suite.add(
    "chunk_row_count_small_size",
    lambda spark, sf: chunking.row_count_chunks(telemetry(spark, sf), "source_file", ["event_id"], size=40, overlap=50).groupBy("source_file", "chunk_index").agg(F.count(F.lit(1)).alias("n")),
    f"""WITH {_TEL}, i AS (SELECT source_file, event_id, ROW_NUMBER() OVER (PARTITION BY source_file ORDER BY event_id) - 1 AS i FROM tel),
    e AS (SELECT source_file, UNNEST(RANGE(GREATEST(0, CAST(CEIL((i - 39) / 30) AS BIGINT)), i // 30 + 1)) AS chunk_index FROM i)
    SELECT source_file, chunk_index, COUNT(*) AS n FROM e GROUP BY ALL""",
)
_CHUNKED = window_chunks_sql(500, 50)
suite.add(
    "chunk_row_ranges",
    lambda spark, sf: chunking.row_ranges(_chunks(spark, sf), "source_file"),
    f"WITH {_CHUNKED}, n AS (SELECT source_file, CAST(chunk_index AS BIGINT) AS chunk_index, COUNT(*) AS row_count FROM chunk GROUP BY ALL) SELECT source_file, chunk_index, row_count, "
    "CAST(SUM(row_count) OVER w - row_count AS BIGINT) AS row_start, CAST(SUM(row_count) OVER w AS BIGINT) AS row_end FROM n WINDOW w AS (PARTITION BY source_file ORDER BY chunk_index)",
)
_METRICS = ("fuel_litres", "vibration")


def _metric_sql(source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT source_file, CAST(chunk_index AS BIGINT) AS chunk_index, {i} AS metric_no, '{m}' AS metric, '{'sum' if chunking.adds_up(m) else 'mean'}' AS kind, COUNT({m}) AS n, "
        f"{half_up(f'SUM(CAST({m} AS DECIMAL(18,4)))')} AS total, {half_up(f'AVG(CAST({m} AS DECIMAL(18,4)))')} AS mean, ROUND(MIN({m}), 3) AS min, ROUND(MAX({m}), 3) AS max "
        f"FROM {source} GROUP BY ALL"
        for i, m in enumerate(_METRICS)
    )


suite.add(
    "chunk_metric_summaries",
    lambda spark, sf: chunking.metric_summaries(_chunks(spark, sf), "source_file", _METRICS),
    f"WITH {_CHUNKED} {_metric_sql('chunk')}",
)


def _outlier_rows_sql(m: str) -> str:
    return f"""SELECT source_file, chunk_index, '{m}' AS metric, ROW_NUMBER() OVER (PARTITION BY source_file, chunk_index ORDER BY position) AS example_no, {m} AS value, ts AS moment
    FROM (SELECT chunk.*, q1, q3, n FROM chunk JOIN (SELECT source_file, chunk_index, QUANTILE_CONT({m}, 0.25) AS q1, QUANTILE_CONT({m}, 0.75) AS q3, COUNT({m}) AS n FROM chunk GROUP BY ALL) q USING (source_file, chunk_index))
    WHERE n >= 4 AND q3 <> q1 AND ({m} > q3 + 1.5 * (q3 - q1) OR {m} < q1 - 1.5 * (q3 - q1))"""


suite.add(
    "chunk_outliers",
    lambda spark, sf: chunking.chunk_outliers(_chunks(spark, sf), "source_file", "fuel_litres", "ts").select(
        "source_file", "chunk_index", "example_no", "value", "shown"
    ),
    f"WITH {_CHUNKED} SELECT source_file, CAST(chunk_index AS BIGINT) AS chunk_index, example_no, value, example_no <= 3 AS shown FROM ({_outlier_rows_sql('fuel_litres')})",
)
suite.add(
    "chunk_category_counts",
    lambda spark, sf: chunking.category_counts(_chunks(spark, sf), "source_file", ["event_type"]),
    f"WITH {_CHUNKED}, n AS (SELECT source_file, CAST(chunk_index AS BIGINT) AS chunk_index, 'event_type' AS category, event_type AS value, COUNT(*) AS n FROM chunk GROUP BY ALL), "
    "r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source_file, chunk_index ORDER BY n DESC, value) AS place FROM n) SELECT * FROM r WHERE place <= 5",
)
_SNAP = (
    "sn AS (SELECT source_file, CAST(chunk_index AS BIGINT) AS chunk_index, equipment_id AS value, MIN(position) AS first FROM chunk GROUP BY ALL), "
    "sr AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source_file, chunk_index ORDER BY first, value) AS place, COUNT(*) OVER (PARTITION BY source_file, chunk_index) AS d FROM sn)"
)
suite.add(
    "chunk_entity_snapshot",
    lambda spark, sf: chunking.entity_snapshot(_chunks(spark, sf), "source_file", ["equipment_id"]).withColumn("values", F.array_join("values", ",")),
    f"WITH {_CHUNKED}, {_SNAP} SELECT source_file, chunk_index, 'equipment_id' AS entity, MAX(d) AS distinct_values, STRING_AGG(value, ',' ORDER BY place) FILTER (WHERE place <= 5) AS values FROM sr GROUP BY ALL",
)


def _documents_of_chunks(spark, sf) -> DataFrame:
    return chunking.chunk_documents(
        _chunks(spark, sf), "source_file", date="ts", entities=["equipment_id"], metrics=list(_METRICS), categories=["event_type"]
    )


def _num(x: str) -> str:
    return f"REGEXP_REPLACE(REGEXP_REPLACE(PRINTF('%.3f', {x}), '0+$', ''), '[.]$', '.0')"


_ISO = "STRFTIME({0}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN MICROSECOND({0}) % 1000000 = 0 THEN '' ELSE STRFTIME({0}, '.%f') END"
_CHUNK_DOC_SQL = f"""WITH {_CHUNKED}, {_SNAP}, ms AS ({_metric_sql('chunk')}),
    ol AS ({' UNION ALL '.join(_outlier_rows_sql(m) for m in _METRICS)}),
    oc AS (SELECT source_file, CAST(chunk_index AS BIGINT) AS chunk_index, metric, COUNT(*) AS k FROM ol GROUP BY ALL),
    ent AS (SELECT source_file, chunk_index, CASE WHEN MAX(d) = 1 THEN 'equipment_id=' || MAX(value) WHEN MAX(d) <= 5 THEN 'equipment_id=[' || STRING_AGG(value, ', ' ORDER BY place) || ']'
      ELSE 'equipment_id (' || MAX(d) || ' entities)' END AS t FROM sr GROUP BY ALL),
    ml AS (SELECT ms.source_file, ms.chunk_index, STRING_AGG('  ' || ms.metric || CASE WHEN kind = 'sum' THEN ': total=' || {_num('total')} || ', mean=' || {_num('mean')} || ', max=' || {_num('max')}
      ELSE ': mean=' || {_num('mean')} || ', min=' || {_num('min')} || ', max=' || {_num('max')} END || COALESCE('  [' || k || ' outlier(s)]', ''), chr(10) ORDER BY metric_no) AS t
      FROM ms LEFT JOIN oc ON oc.source_file = ms.source_file AND oc.chunk_index = ms.chunk_index AND oc.metric = ms.metric GROUP BY ALL),
    cn AS (SELECT source_file, CAST(chunk_index AS BIGINT) AS chunk_index, event_type AS v, COUNT(*) AS n FROM chunk GROUP BY ALL),
    cr AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source_file, chunk_index ORDER BY n DESC, v) AS p FROM cn),
    cl AS (SELECT source_file, chunk_index, '  event_type: ' || STRING_AGG(v || ':' || n, ', ' ORDER BY p) AS t FROM cr WHERE p <= 5 GROUP BY ALL),
    nt AS (SELECT source_file, CAST(chunk_index AS BIGINT) AS chunk_index, STRING_AGG('  ' || metric || '=' || {_num('ROUND(value, 3)')} || ' at ' || {_ISO.format('moment')}, chr(10) ORDER BY CASE metric WHEN 'fuel_litres' THEN 0 ELSE 1 END, example_no) AS t
      FROM ol WHERE example_no <= 3 GROUP BY ALL),
    hd AS (SELECT source_file, CAST(chunk_index AS BIGINT) AS chunk_index, COUNT(*) AS n, MIN(ts) AS a, MAX(ts) AS b FROM chunk GROUP BY ALL)
    SELECT hd.source_file, hd.chunk_index, PRINTF('sensors/events__chunk_%05d', hd.chunk_index) AS chunk_id,
    CONCAT_WS(chr(10) || chr(10), 'Mining telemetry from ' || hd.source_file || '. time ' || {_ISO.format('a')} || ' to ' || {_ISO.format('b')} || '. ' || ent.t || '. ' || n || ' records.',
    'Measurements:' || chr(10) || ml.t, 'Categories:' || chr(10) || cl.t, 'Outliers detected:' || chr(10) || nt.t) AS text
    FROM hd JOIN ent USING (source_file, chunk_index) JOIN ml USING (source_file, chunk_index) JOIN cl USING (source_file, chunk_index) LEFT JOIN nt USING (source_file, chunk_index)"""
suite.add("chunk_text", lambda spark, sf: _documents_of_chunks(spark, sf).drop("metadata"), _CHUNK_DOC_SQL)
suite.add(
    "chunk_metadata",
    lambda spark, sf: _documents_of_chunks(spark, sf).select(
        "chunk_id", F.col("source_file"), F.col("metadata.row_count").alias("row_count"), F.col("metadata.row_range")[0].alias("row_start"),
        F.col("metadata.row_range")[1].alias("row_end"), F.col("metadata.date_range.start").alias("date_start"),
        F.array_join(F.col("metadata.entity_values")["equipment_id"], ",").alias("entities"), F.array_join("metadata.column_list", ",").alias("columns"),
    ),
    f"""WITH {_CHUNKED}, {_SNAP}, n AS (SELECT source_file, CAST(chunk_index AS BIGINT) AS chunk_index, COUNT(*) AS row_count, MIN(ts) AS a FROM chunk GROUP BY ALL),
    e AS (SELECT source_file, chunk_index, STRING_AGG(value, ',' ORDER BY place) FILTER (WHERE place <= 5) AS entities FROM sr GROUP BY ALL)
    SELECT PRINTF('sensors/events__chunk_%05d', chunk_index) AS chunk_id, source_file, row_count, CAST(SUM(row_count) OVER w - row_count AS BIGINT) AS row_start, CAST(SUM(row_count) OVER w AS BIGINT) AS row_end,
    {_ISO.format('a')} AS date_start, entities, 'event_id,ts,equipment_id,event_type,fuel_litres,vibration' AS columns FROM n JOIN e USING (source_file, chunk_index) WINDOW w AS (PARTITION BY source_file ORDER BY chunk_index)""",
)
suite.add(
    "chunk_text_masked",
    lambda spark, sf: mask_identifiers(_documents_of_chunks(spark, sf), "text").select("source_file", "chunk_index", F.length("text").cast("bigint").alias("n_chars")),
    f"SELECT source_file, chunk_index, LENGTH(text) AS n_chars FROM ({_CHUNK_DOC_SQL})",
)


@suite.query(
    "window_conversation_memory",
    "SELECT conv_id, turn, STRING_AGG(UPPER(role), ',') OVER w AS roles, COUNT(*) OVER w AS messages, CAST(SUM(LENGTH(text)) OVER w AS BIGINT) AS chars FROM conversations "
    "WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)",
)
def _memory(spark, sf):
    from orepulse.operators.scans import ordered_scan

    turns = ordered_scan(table(spark, sf, "conversations").select("conv_id", "turn", "role", F.length("text").alias("n")), ["conv_id"], ["turn"], row_index="i")
    framed = trailing_rows(
        turns, ["conv_id"], "i", 6, {"r": F.collect_list(F.upper("role")), "messages": F.count(F.lit(1)), "chars": F.sum("n")}, bucket_rows=64
    )
    return framed.select("conv_id", "turn", F.array_join("r", ",").alias("roles"), "messages", "chars")
