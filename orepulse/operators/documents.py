"""Document classification, headings, sections and text chunks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orepulse.functions.text import clean_body, clean_title, file_slug, section_id, strip
from orepulse.operators.scans import ordered_scan
from orepulse.session import checkpoint_cut, release_shuffles, settled

# Classification limits and the document-type tags that decide a class.
MIN_PAGE_CHARS = 200
MANY_PAGES = 40
MODEL_CONFIDENCE = 0.7
COMPLEX_TAGS = ("legal_complex", "mining_regulation", "environmental_act", "safety_code", "regulatory_document")
SIMPLE_TAGS = ("simple_forms", "scanned_form", "standard_template", "low_complexity")

# Routing and section limits.
SINGLE_CALL_PAGES, SINGLE_CALL_MB = 95, 18.0
BATCH_PAGES, BATCH_MB = 95, 15.0
MIN_BODY, MAX_BODY, BODY_OVERLAP = 50, 8000, 200

# Heading patterns.
NUMBERED_HEADING = (
    r"(?i)^(?:part|division|section|schedule|chapter|appendix|regulation|clause|article)[\s\x{00A0}]+[\dA-Z][\w.\-]*"
)
SECTION_HEADING = r"(?m)(^#{1,6}\s+.+$|^[A-Z][^\n]{0,80}\n[-=]{3,})"


def classify_documents(df: DataFrame) -> DataFrame:
    """Three-signal cascade over ``avg_chars, page_count, doc_type_tag, model_class, model_confidence``."""
    tag = F.lower(F.coalesce("doc_type_tag", F.lit("")))
    scanned = (F.col("avg_chars") < MIN_PAGE_CHARS) & (F.col("avg_chars") > 0)
    sparse = (F.col("page_count") > MANY_PAGES) & (F.col("avg_chars") < MIN_PAGE_CHARS * 3)
    unsure = F.col("model_class").isNull() | (F.coalesce("model_confidence", F.lit(0.0)) < MODEL_CONFIDENCE)
    doc_class = (
        F.when(scanned | sparse, "simple")
        .when(tag.isin(*COMPLEX_TAGS), "complex_legal")
        .when(tag.isin(*SIMPLE_TAGS), "simple")
        .when(unsure, "complex_legal")
        .otherwise(F.col("model_class"))
    )
    confidence = (
        F.when(scanned, 0.95).when(sparse, 0.85).when(tag.isin(*COMPLEX_TAGS, *SIMPLE_TAGS), 0.99)
        .otherwise(F.coalesce("model_confidence", F.lit(0.0)))
    )
    signal = F.when(scanned | sparse, "heuristic").when(tag.isin(*COMPLEX_TAGS, *SIMPLE_TAGS), "tag").otherwise("model")
    return df.withColumns({"doc_class": doc_class, "confidence": confidence, "signal": signal})


def route_by_size(pages: Column, megabytes: Column) -> Column:
    return F.when((pages > SINGLE_CALL_PAGES) | (megabytes > SINGLE_CALL_MB), "batch").otherwise("single")


def text_lines(df: DataFrame, doc: str, text: str, lines_per_page: int = 40) -> DataFrame:
    """``(doc, page, line_no, line)``, trimmed, numbered from 0; pages are 1-based."""
    rows = df.select(doc, F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "line"))
    return rows.select(
        doc, (F.floor(F.col("line_no") / lines_per_page) + 1).alias("page"), "line_no", strip(F.col("line")).alias("line")
    )


def is_numbered_heading(line: Column) -> Column:
    return line.rlike(NUMBERED_HEADING) & (F.length(line) <= 200)


def is_all_caps_heading(line: Column) -> Column:
    letters = F.regexp_replace(line, r"[^\p{L}]", "")
    return (F.length(line) <= 100) & letters.rlike(r"^\p{Lu}{3,}$")


def heading_lines(lines: DataFrame, doc: str) -> DataFrame:
    """Numbered and all-caps headings as ``(doc, page, title, method)``."""
    found = F.array_compact(
        F.array(
            F.when(is_numbered_heading(F.col("line")), "numbering"), F.when(is_all_caps_heading(F.col("line")), "all_caps")
        )
    )
    return lines.select(doc, "page", F.col("line").alias("title"), F.explode(found).alias("method"))


def font_size_headings(words: DataFrame, doc: str) -> DataFrame:
    """Headings by print size from ``(doc, page, top, x0, size, fontname, text)``.

    The median size of a document comes from its counted sizes; words are cut into lines inside a page.
    """
    sizes = words.filter("size > 0").groupBy(doc, "size").agg(F.count(F.lit(1)).alias("n"))
    median = sizes.groupBy(doc).agg(F.percentile("size", 0.5, F.col("n")).alias("median"))
    reading = Window.partitionBy(doc, "page").orderBy("top", "x0", "text")
    jump = F.coalesce(F.abs(F.col("top") - F.lag("top").over(reading)) >= 3, F.lit(True))
    lines = (
        words.withColumn("_new", jump.cast("int"))
        .withColumn("_line", F.sum("_new").over(reading.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(doc, "page", "_line")
        .agg(
            F.avg(F.when(F.col("size") > 0, F.col("size"))).alias("avg_size"),
            F.array_sort(F.collect_list(F.struct("top", "x0", "text"))).alias("w"),
            F.bool_or(F.lower("fontname").rlike("bold|bd")).alias("bold"),
        )
        .withColumn("title", strip(F.array_join(F.transform("w", lambda x: x["text"]), " ")))
    )
    big = lines.join(median, doc).filter(F.col("avg_size") >= F.col("median") + 2)
    shown = F.length("title").between(3, 200) & (F.col("bold") | is_all_caps_heading(F.col("title")))
    return big.filter(shown).select(doc, "page", "title", F.lit("font_size").alias("method"))


def distinct_boundaries(headings: DataFrame, doc: str) -> DataFrame:
    """First heading per page and first 60 letters, in title order; print size beats numbering beats capitals."""
    rank = F.when(F.col("method") == "font_size", 0).when(F.col("method") == "numbering", 1).otherwise(2)
    best = F.min(F.struct(F.col("title"), rank.alias("rank"), F.col("method")))
    return (
        headings.groupBy(doc, "page", F.lower(F.left("title", F.lit(60))).alias("_key"))
        .agg(best.alias("b"))
        .select(doc, "page", F.col("b.title").alias("title"), F.col("b.method").alias("method"))
    )


MOST_LEVELS = 64  # links from a block up to its outermost container; more are a cycle


# Layout block types that open a section, hold a table, a cell of one, or text.
HEADER_TYPES = ("LAYOUT_SECTION_HEADER",)
TABLE_TYPES = ("TABLE",)
CELL_TYPES = ("CELL", "MERGED_CELL")
TEXT_TYPES = ("LAYOUT_TEXT", "LAYOUT_LIST", "LAYOUT_FIGURE", "LAYOUT_HEADER", "LAYOUT_FOOTER", "LAYOUT_PAGE_NUMBER")
KEPT_TYPES = (*HEADER_TYPES, *TABLE_TYPES, *TEXT_TYPES)
MOST_LINKS = 200_000_000  # links from containers to what they hold that are followed at a time; more are taken in groups of documents
MIN_PART = 2  # texts of up to so many characters are page numbers and specks

def _below(holders: DataFrame, leaves: DataFrame, doc: str) -> tuple[DataFrame, DataFrame]:
    """Texts below containers, as ``doc, at, kept, shown, cell, text, lines`` where ``text`` is all there is, and with a ``path`` where it is a part.

    ``holders`` are the blocks without a text: a container that has one speaks for what lies below it. ``leaves``: ``doc, block_id,
    block_type, text``. The texts directly in a container that holds no other containers are joined to one, so what goes up level by level
    is text and no longer a row per word. ``path`` are the places that lead down to a part, ``lines`` the ids of its LINE blocks; ``kept``,
    ``shown`` (kept or a line) and ``cell`` tell the kind of the container. One round per level, each a join on (document, block), so a
    document of many blocks is spread over the tasks.
    """
    line, nothing = F.when(F.col("block_type") == "LINE", F.col("block_id")), F.lit(None).cast("string")
    kinds = {"kept": F.col("block_type").isin(*KEPT_TYPES), "shown": F.col("block_type").isin(*KEPT_TYPES, "LINE"), "cell": F.col("block_type").isin(*CELL_TYPES)}
    texts = leaves.select(doc, F.col("block_id").alias("child"), "text", line.alias("line"), F.lit(False).alias("holds"))
    known = holders.select(doc, F.col("block_id").alias("child"), nothing.alias("text"), nothing.alias("line"), F.lit(True).alias("holds")).distinct()
    links = holders.select(doc, F.col("block_id").alias("parent"), *[c.alias(n) for n, c in kinds.items()], F.posexplode("child_ids").alias("pos", "child"))
    inside = F.struct("pos", "text", "line", F.when(F.col("holds"), F.col("child")).alias("holder"))
    direct = links.join(texts.unionByName(known), [doc, "child"]).groupBy(doc, "parent").agg(
        F.array_sort(F.collect_list(inside)).alias("inside"), *[F.coalesce(F.max(n), F.lit(False)).alias(n) for n in kinds]
    )
    # Where an id stands for several containers, their texts may have to be mixed: there every text stays on its own.
    twice = checkpoint_cut(holders.filter(F.size("child_ids") > 0).groupBy(doc, "block_id").count().filter("count > 1").select(doc).distinct())
    mixed = F.lit(False)
    if not twice.isEmpty():
        direct, mixed = direct.join(twice.withColumn("twice", F.lit(True)), doc, "left"), F.col("twice").isNotNull()
    own, held = F.filter("inside", lambda x: x["holder"].isNull()), F.filter("inside", lambda x: x["holder"].isNotNull())
    found = direct.select(
        doc, "parent", *kinds, own.alias("own"), F.transform(held, lambda x: F.struct(x["pos"].alias("pos"), x["holder"].alias("child"))).alias("held"), mixed.alias("mixed")
    )
    one = F.struct(F.array(F.get("own", F.lit(0))["pos"]).alias("path"), F.array_join("own.text", " ").alias("text"), F.array_compact("own.line").alias("lines"))
    each = F.transform("own", lambda x: F.struct(F.array(x["pos"]).alias("path"), x["text"].alias("text"), F.array_compact(F.array(x["line"])).alias("lines")))
    whole = (F.size("held") == 0) & (F.size("own") > 0) & ~F.col("mixed")
    direct = checkpoint_cut(found.select(doc, "parent", *kinds, "held", whole.alias("whole"), F.when(whole, F.array(one)).otherwise(each).alias("parts")), codec="zstd")
    release_shuffles(direct.sparkSession)
    up = direct.select(doc, "parent", *kinds, F.inline("held"))
    level = direct.select(doc, F.col("parent").alias("at"), *kinds, "whole", F.inline("parts"))
    complete, parts = level.filter("whole").drop("whole", "path"), level.filter("NOT whole").drop("whole")
    level = level.drop("whole", *kinds)
    for _ in range(MOST_LEVELS):
        more = level.withColumnRenamed("at", "child").join(up, [doc, "child"])
        level = checkpoint_cut(more.select(doc, F.col("parent").alias("at"), *kinds, F.concat(F.array("pos"), "path").alias("path"), "text", "lines"))
        if level.isEmpty():
            return complete, parts
        parts, level = parts.unionByName(level), level.drop(*kinds)
    raise ValueError(f"blocks lie more than {MOST_LEVELS} deep, or in a cycle")


def _joined_texts(complete: DataFrame, parts: DataFrame, doc: str) -> DataFrame:
    texts = F.array_sort(F.collect_list(F.struct("path", "text")))
    ordered = parts.groupBy(doc, F.col("at").alias("block_id")).agg(texts.alias("parts"), F.max("shown").alias("shown"), F.max("cell").alias("cell"))
    joined = ordered.select(doc, "block_id", F.array_join("parts.text", " ").alias("resolved"), "shown", "cell")
    return complete.select(doc, F.col("at").alias("block_id"), F.col("text").alias("resolved"), "shown", "cell").unionByName(checkpoint_cut(joined))


def block_texts(blocks: DataFrame, doc: str) -> DataFrame:
    """Text of every layout block, from its own text or from the texts below it in child order, however deep.

    ``blocks``: ``doc, block_id, block_type, page, top, left_pos, text, child_ids``. Containers without any text have no row.
    """
    own = blocks.filter("text IS NOT NULL").select(doc, "block_id", F.col("text").alias("resolved"))
    return own.unionByName(_joined_texts(*_below(blocks.filter("text IS NULL"), blocks.filter("text <> ''"), doc), doc).drop("shown", "cell"))


CELLS = "array<struct<row_index:int,col_index:int,text:string>>"


def layout_sections(blocks: DataFrame, doc: str) -> DataFrame:
    """Sections between header blocks, in reading order: ``doc, section_no, title, body, tables, table_count, page_start, page_end``.

    ``blocks`` as for :func:`block_texts`; table cells may have ``row_index`` and ``col_index`` (without them every cell is a row). The
    body joins the texts of text blocks, lists, figures, page headers and footers, and of lines that lie in no block kept here. Each
    table is its cells, in the section it stands in. Section numbers are a running count of headers, taken with the block-wise scan so
    that one large document does not sit in one task.

    Of many blocks groups of whole documents are worked on one after the other, and what a group needs on disk goes when its sections
    are written.
    """
    spark, links = blocks.sparkSession, F.sum(F.size("child_ids")).alias("n")
    groups = -(-(blocks.filter(F.size("child_ids") > 0).agg(links).first()["n"] or 0) // MOST_LINKS)
    if groups <= 1:
        return settled(spark, lambda: _sections_of(blocks, doc))
    own = F.pmod(F.xxhash64(doc), F.lit(groups))
    return reduce(DataFrame.unionByName, [settled(spark, lambda g=g: _sections_of(blocks.filter(own == g), doc)) for g in range(groups)])


def _sections_of(blocks: DataFrame, doc: str) -> DataFrame:
    line = F.col("block_type") == "LINE"
    main = line | F.col("block_type").isin(*KEPT_TYPES, *CELL_TYPES)
    # All but the words, and without the texts of lines: read several times below.
    far = F.coalesce(line & (F.col("text") != ""), F.lit(False))
    few = blocks.filter(F.col("text").isNull() | main | (F.size("child_ids") > 0))
    few = checkpoint_cut(few.withColumns({"text": F.when(~far, F.col("text")), "far": far, "holds": F.col("text").isNull()}))
    kept = few.filter(F.col("block_type").isin(*KEPT_TYPES))
    complete, parts = _below(few.filter("holds"), blocks.filter("text <> ''"), doc)
    lines = complete.filter("kept").select(doc, "lines").unionByName(parts.filter("kept").select(doc, "lines"))
    children = few.filter("NOT holds").select(doc, F.explode("child_ids").alias("block_id"))  # these are spoken for
    held = lines.select(doc, F.explode("lines").alias("block_id")).unionByName(children)
    columns = [doc, "block_id", "block_type", "page", "top", "left_pos"]
    loose = checkpoint_cut(few.filter(line).select(*columns, "text", "far").join(held, [doc, "block_id"], "left_anti"))

    # Texts of what is placed and of cells; several texts of one id are told apart by their number.
    given = few.filter(F.col("block_type").isin(*KEPT_TYPES, *CELL_TYPES)).select(doc, "block_id", "text").unionByName(loose.filter("NOT far").select(doc, "block_id", "text"))
    apart = loose.filter("far").select(doc, "block_id").distinct()
    if not apart.isEmpty():
        given = given.unionByName(blocks.filter(line & (F.col("text") != "")).select(doc, "block_id", "text").join(apart, [doc, "block_id"], "left_semi"))
    number = F.row_number().over(Window.partitionBy(doc, "block_id").orderBy("text"))
    own = checkpoint_cut(given.filter("text IS NOT NULL").select(doc, "block_id", F.col("text").alias("resolved"), number.alias("text_no")))
    below = _joined_texts(complete.filter("shown OR cell"), parts.filter("shown OR cell"), doc).withColumn("text_no", F.lit(0))
    known = own.withColumns({"shown": F.lit(True), "cell": F.lit(True)}).unionByName(below)
    texts, cell_texts = [known.filter(c).drop("shown", "cell") for c in ("shown", "cell")]

    numbered = [F.col(c).cast("int") if c in blocks.columns else F.lit(None).cast("int") for c in ("row_index", "col_index")]
    cells = few.filter(F.col("block_type").isin(*CELL_TYPES)).select(doc, F.col("block_id").alias("cell"), numbered[0].alias("r"), numbered[1].alias("c"))
    inside = few.filter(F.col("block_type").isin(*TABLE_TYPES)).select(doc, "block_id", F.posexplode("child_ids").alias("pos", "cell"))
    cell = F.struct(F.coalesce("r", "pos").alias("row_index"), F.coalesce("c", F.lit(0)).alias("col_index"), F.coalesce("resolved", F.lit("")).alias("text"))
    tables = (
        inside.join(cells, [doc, "cell"])
        .join(cell_texts.withColumnRenamed("block_id", "cell"), [doc, "cell"], "left")
        .groupBy(doc, "block_id")
        .agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    )

    # Places are put in order without their texts; these come to the sections afterwards.
    header = F.col("block_type").isin(*HEADER_TYPES)
    placed = kept.select(*columns).unionByName(loose.select(*columns)).join(texts.drop("resolved"), [doc, "block_id"], "left")
    order = ["page", "top", "left_pos", "block_id"]
    scanned = ordered_scan(placed, [doc], [*order, "text_no"], sums={"section_no": header.cast("int")})
    release_shuffles(blocks.sparkSession)
    scanned = scanned.join(tables, [doc, "block_id"], "left").join(texts, [doc, "block_id", "text_no"], "left")
    place = [F.col(c) for c in ("page", "top", "left_pos", "block_id")]
    table = F.col("block_type").isin(*TABLE_TYPES)
    body = ~header & ~table & (F.length(strip(F.coalesce("resolved", F.lit("")))) > MIN_PART)
    sections = scanned.groupBy(doc, "section_no").agg(
        F.max(F.when(header, F.coalesce(F.nullif("resolved", F.lit("")), F.lit("untitled")))).alias("title"),
        F.array_sort(F.collect_list(F.when(body, F.struct(*place, "resolved")))).alias("parts"),
        F.array_sort(F.collect_list(F.when(table, F.struct(*place, F.coalesce("cells", F.array().cast(CELLS)).alias("cells"))))).alias("tables"),
        F.coalesce(F.min(F.when(header, F.col("page"))), F.lit(1)).alias("page_start"),
        F.max("page").alias("page_end"),
    )
    return sections.select(
        doc,
        "section_no",
        F.coalesce("title", F.lit("untitled-0")).alias("title"),
        strip(F.array_join(F.transform("parts", lambda p: p["resolved"]), "\n")).alias("body"),
        F.transform("tables", lambda t: F.struct(t["cells"].alias("cells"))).alias("tables"),
        F.size("tables").cast("bigint").alias("table_count"),
        F.col("page_start").cast("bigint").alias("page_start"),
        F.col("page_end").cast("bigint").alias("page_end"),
    )


def tables_text(tables: Column) -> Column:
    """Pipe rows of an array of tables (``cells`` with ``row_index, col_index, text``), a blank line after each table."""

    def row(cells: Column, number: Column) -> Column:
        own = F.array_sort(F.filter(cells, lambda c: c["row_index"] == number))  # by column
        return F.concat(F.lit("| "), F.array_join(F.transform(own, lambda c: F.trim(c["text"])), " | "), F.lit(" |"))

    def lines(table: Column) -> Column:
        cells = table["cells"]
        numbers = F.array_sort(F.array_distinct(F.transform(cells, lambda c: c["row_index"])))
        return F.concat(F.transform(numbers, lambda n: row(cells, n)), F.array(F.lit("")))

    return F.array_join(F.flatten(F.transform(F.coalesce(tables, F.array().cast(f"array<struct<cells:{CELLS}>>")), lines)), "\n")


def table_text(cells: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, table_no, row_index, col_index, text)`` to pipe rows, a blank line after each table."""
    rows = (
        cells.groupBy(*keys, "table_no", "row_index")
        .agg(F.array_sort(F.collect_list(F.struct("col_index", F.trim("text").alias("text")))).alias("c"))
        .withColumn(
            "line", F.concat(F.lit("| "), F.array_join(F.transform("c", lambda x: x["text"]), " | "), F.lit(" |"))
        )
    )
    tables = rows.groupBy(*keys, "table_no").agg(F.array_sort(F.collect_list(F.struct("row_index", "line"))).alias("r"))
    tables = tables.withColumn("t", F.concat(F.array_join(F.transform("r", lambda x: x["line"]), "\n"), F.lit("\n")))
    return tables.groupBy(*keys).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("table_no", "t"))), lambda x: x["t"]), "\n"
        ).alias("tables_text")
    )


def length_pieces(text: Column, max_chars: int, overlap: int) -> Column:
    """Array of windows of ``max_chars`` advancing by ``max_chars - overlap``.

    A last piece that is nothing but overlap is dropped; a text that fits stays whole.
    """
    if overlap >= max_chars:
        raise ValueError(f"overlap ({overlap}) must be smaller than max_chars ({max_chars})")
    step = max_chars - overlap
    size = F.length(text)
    last_start = F.floor((size - 1) / step) * step
    repeats = (last_start > 0) & (size - last_start <= overlap)
    end = F.when(repeats, last_start - step).otherwise(last_start)
    starts = F.sequence(F.lit(0).cast("bigint"), F.greatest(end, F.lit(0).cast("bigint")), F.lit(step).cast("bigint"))
    pieces = F.transform(starts, lambda s: F.substring(text, s.cast("int") + 1, F.lit(max_chars)))
    return F.when(size <= max_chars, F.array(text)).otherwise(pieces)


_MARK = "\u0001\u0002"


def section_pieces(text: Column, max_chars: int) -> Column:
    """Array of trimmed sections starting at Markdown or underlined headings; long ones cut by length."""
    marked = F.regexp_replace(text, SECTION_HEADING, _MARK + "$1")
    sections = F.filter(F.transform(F.split(marked, _MARK, -1), strip), lambda s: F.length(s) > 0)
    cut = F.flatten(F.transform(sections, lambda s: length_pieces(s, max_chars, 0)))
    return F.when(text.rlike(SECTION_HEADING), cut).otherwise(length_pieces(text, max_chars, 0))


def chunk_text(
    df: DataFrame, text: str, *, strategy: str = "length", max_chars: int = 6000, overlap: int = 100
) -> DataFrame:
    """One row per chunk with ``chunk_no`` and ``chunk``; other columns are kept."""
    if strategy == "length":
        pieces = length_pieces(F.col(text), max_chars, overlap)
    elif strategy == "section":
        pieces = section_pieces(F.col(text), max_chars)
    else:
        raise ValueError(f"Unsupported chunk strategy '{strategy}'; use length or section")
    others = [c for c in df.columns if c != text]
    return df.select(*others, F.posexplode(pieces).alias("chunk_no", "chunk"))


def group_pages(df: DataFrame, doc: str, page: str, text: str, pages_per_chunk: int = 2) -> DataFrame:
    """Join every ``pages_per_chunk`` pages (1-based) of a document."""
    group = F.floor((F.col(page) - 1) / pages_per_chunk).alias("page_group")
    return (
        df.groupBy(doc, group)
        .agg(
            F.min(page).alias("first_page"),
            F.max(page).alias("last_page"),
            F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.col(text).alias("t")))).alias("pages"),
        )
        .select(
            doc, "page_group", "first_page", "last_page",
            F.array_join(F.transform("pages", lambda x: x["t"]), "\n").alias("text"),
        )
    )


def normalise_sections(
    df: DataFrame, source: str, order: str, title: str, body: str, tables: str | None = None, *, keep: Sequence[str] = (),
    first_part: Sequence[str] = (),
) -> DataFrame:
    """Clean sections, drop short ones, split long ones and number what is emitted per source.

    ``tables`` is the column of table text that goes below the body. Columns in ``keep`` go with every part, those in ``first_part`` with
    the first part of a section only. Cleaned texts are written once: the part counts (a number per section, all that goes through the
    running sum) and the parts themselves both read them.
    """
    text = clean_body(F.coalesce(body, F.lit("")))
    more = [*keep, *first_part]
    cleaned = df.select(source, order, clean_title(F.coalesce(title, F.lit(""))).alias("_title"), text.alias("_body"), *more,
                        *([tables] if tables and tables not in more else []))
    if tables:
        has_table = F.length(strip(F.coalesce(tables, F.lit("")))) > 0
        cleaned = cleaned.withColumn(
            "_body", F.when(has_table, F.concat("_body", F.lit("\n\n"), tables)).otherwise(F.col("_body"))
        )
    cleaned = checkpoint_cut(cleaned.select(source, order, "_title", "_body", *more))
    pieces = length_pieces(F.col("_body"), MAX_BODY, BODY_OVERLAP)
    cleaned = cleaned.withColumn("_parts", F.when(F.length("_body") < MIN_BODY, F.array().cast("array<string>")).otherwise(pieces))
    counts = cleaned.select(source, order, F.size("_parts").alias("_n"))
    numbered = ordered_scan(counts, [source], [order], sums={"_upto": F.col("_n").cast("bigint")})
    offsets = numbered.select(source, order, (F.col("_upto") - F.col("_n")).alias("_first"), F.col("_n").alias("_total"))
    parts = cleaned.filter(F.size("_parts") > 0).join(offsets, [source, order])
    exploded = parts.select("*", F.posexplode("_parts").alias("_part", "_text"))
    number = F.col("_first") + F.col("_part")
    base = F.when(F.col("_title") == "", F.concat(F.lit("untitled-"), F.col("_first").cast("string"))).otherwise(F.col("_title"))
    full = F.when(F.col("_total") > 1, F.format_string("%s (part %d of %d)", base, F.col("_part") + 1, F.col("_total"))).otherwise(base)
    return exploded.select(
        source,
        order,
        section_id(file_slug(F.regexp_extract(source, "[^/]*$", 0)), number).alias("section_id"),
        full.alias("title"),
        F.col("_text").alias("body"),
        (F.col("_part") == 0).alias("carries_tables"),
        *keep,
        *[F.when(F.col("_part") == 0, F.col(c)).alias(c) for c in first_part],
    )


RECORD_VERSION = "1.0"


def section_records(sections: DataFrame, source: str, order: str, *, documents: DataFrame | None = None) -> DataFrame:
    """The full record of every section: id, title, body, pages, method, batch, tables, citations and what is known of its document.

    ``sections``: ``source, order, title, body, page_start, page_end`` and, where the extraction has them, ``extraction_method``,
    ``batch_index``, ``tables`` and ``citations``. Tables are part of the body as text, too; tables and citations stay with the first
    part of a split section. ``documents``: ``source, doc_class, file_bytes, total_pages``.
    """
    given = {
        "extraction_method": F.lit("layout"), "batch_index": F.lit(0).cast("bigint"), "tables": F.array().cast(f"array<struct<cells:{CELLS}>>"),
        "citations": F.array().cast("array<string>"),
    }
    full = sections.withColumns({c: default for c, default in given.items() if c not in sections.columns})
    full = full.withColumns({"tables": F.coalesce("tables", given["tables"]), "_tables_text": tables_text(F.col("tables"))})
    rows = normalise_sections(
        full, source, order, "title", "body", "_tables_text", keep=("page_start", "page_end", "extraction_method", "batch_index"),
        first_part=("tables", "citations"),
    )
    rows = rows.withColumns({c: F.coalesce(c, given[c]) for c in ("tables", "citations")})
    if documents is not None:
        rows = rows.join(documents.select(source, "doc_class", "file_bytes", "total_pages"), source, "left")
    else:
        rows = rows.withColumns({"doc_class": F.lit("simple"), "file_bytes": F.lit(None).cast("bigint"), "total_pages": F.lit(None).cast("bigint")})
    known = F.struct(F.col(source).alias("source"), "doc_class", "file_bytes", "total_pages", F.lit(RECORD_VERSION).alias("schema_version"))
    return rows.select(
        source, order, "section_id", "title", "body", "page_start", "page_end", "extraction_method", "batch_index", "tables", "citations",
        known.alias("metadata"),
    )


def heading_sections(lines: DataFrame, doc: str) -> DataFrame:
    """Sections of plain text between its headings: ``doc, section_no, title, body, page_start, page_end``.

    ``lines``: ``doc, page, line_no, line`` as :func:`text_lines` gives them. What stands before the first heading is a section without
    a title; documents without headings are one section.
    """
    heading = is_numbered_heading(F.col("line")) | is_all_caps_heading(F.col("line"))
    marked = lines.withColumn("_heading", F.coalesce(heading, F.lit(False)))
    scanned = ordered_scan(marked.select(doc, "page", "line_no", "line", "_heading"), [doc], ["line_no"], sums={"section_no": F.col("_heading").cast("int")})
    return scanned.groupBy(doc, "section_no").agg(
        F.max(F.when(F.col("_heading"), F.col("line"))).alias("title"),
        F.array_sort(F.collect_list(F.when(~F.col("_heading"), F.struct("line_no", "line")))).alias("parts"),
        F.min("page").cast("bigint").alias("page_start"),
        F.max("page").cast("bigint").alias("page_end"),
    ).select(doc, "section_no", "title", strip(F.array_join(F.transform("parts", lambda p: p["line"]), "\n")).alias("body"), "page_start", "page_end")


def pack_batches(
    pages: DataFrame, doc: str, *, max_pages: int = BATCH_PAGES, max_mb: float = BATCH_MB, bucket_rows: int = 4096
) -> DataFrame:
    """Greedy batches of consecutive pages, cut before a section start where one lies within the limits.

    ``pages``: ``doc, page, megabytes, starts_section``; the result is ``doc, batch_index, page_start, page_end, size_mb``. Where a batch
    would end that starts at a page depends only on the next ``max_pages`` pages, so it is found for every page at once, in buckets of
    positions. The batches that are really taken are the pages reached from the first one: pointers are doubled and followed from the
    longest jump to the shortest, so a document of n batches takes log n joins and no task sees a whole document.
    """
    rows = pages.select(doc, "page", F.coalesce("megabytes", F.lit(0.0)).cast("double").alias("megabytes"), F.coalesce("starts_section", F.lit(False)).alias("starts_section"))
    size = max(bucket_rows, max_pages + 1)
    bucket = F.floor(F.col("_i") / size)
    ahead = (F.col("_i") % size < max_pages) & (bucket > 0)  # the first pages of a bucket are also seen from the one before
    spread = ordered_scan(rows, [doc], ["page"], row_index="_i").withColumn("_b", F.explode(F.when(ahead, F.array(bucket, bucket - 1)).otherwise(F.array(bucket))))
    frame = Window.partitionBy(doc, "_b").orderBy("_i").rowsBetween(0, max_pages)
    seen = spread.withColumn("f", F.collect_list(F.struct("page", "megabytes", "starts_section")).over(frame)).filter(F.col("_b") == bucket)

    start = F.struct(F.get("f", F.lit(0))["megabytes"].alias("total"), F.lit(1).alias("n"), F.lit(True).alias("open"))

    def take(acc: Column, x: Column) -> Column:
        fits = acc["open"] & (acc["total"] + x["megabytes"] <= max_mb)
        return F.struct(
            F.when(fits, acc["total"] + x["megabytes"]).otherwise(acc["total"]).alias("total"),
            F.when(fits, acc["n"] + 1).otherwise(acc["n"]).alias("n"), fits.alias("open"),
        )

    fitting = seen.withColumn("n", F.aggregate(F.slice("f", 2, max_pages - 1), start, take)["n"])
    starts = F.filter(F.sequence(F.lit(1), F.col("n")), lambda c: F.get(F.col("f"), c)["starts_section"])
    ended = fitting.withColumn("n", F.when(F.size("f") > F.col("n"), F.coalesce(F.array_max(starts), F.col("n"))).otherwise(F.col("n")))
    total = F.aggregate(F.slice("f", F.lit(1), F.col("n")), F.lit(0.0), lambda acc, x: acc + x["megabytes"])
    steps = checkpoint_cut(
        ended.select(
            doc, F.col("_i").alias("at"), F.col("page").alias("page_start"), F.get("f", F.col("n") - 1)["page"].alias("page_end"), total.alias("size_mb"),
            F.when(F.size("f") > F.col("n"), F.col("_i") + F.col("n")).alias("to"),
        )
    )
    jumps = [steps.filter("to IS NOT NULL").select(doc, "at", "to")]
    while True:
        onward = jumps[-1].select(doc, F.col("at").alias("to"), F.col("to").alias("far"))
        longer = checkpoint_cut(jumps[-1].join(onward, [doc, "to"]).select(doc, "at", F.col("far").alias("to")))
        if longer.isEmpty():
            break
        jumps.append(longer)
    reached = steps.filter("at = 0").select(doc, "at", F.lit(0).cast("bigint").alias("batch_index"))
    for power in range(len(jumps) - 1, -1, -1):
        more = reached.join(jumps[power], [doc, "at"]).select(doc, F.col("to").alias("at"), (F.col("batch_index") + (1 << power)).alias("batch_index"))
        reached = checkpoint_cut(reached.unionByName(more))
    return reached.join(steps, [doc, "at"]).select(
        doc, "batch_index", F.col("page_start").cast("bigint").alias("page_start"), F.col("page_end").cast("bigint").alias("page_end"), "size_mb"
    )


def with_previous_context(sections: DataFrame, doc: str, order: str, title: str, body: str, chars: int = 300) -> DataFrame:
    """Title and first characters of the section before, in document order."""
    known = sections.withColumn("_ctx", F.struct(F.col(title).alias("title"), F.left(body, F.lit(chars)).alias("body")))
    scanned = ordered_scan(known.select(doc, order, title, "_ctx"), [doc], [order], previous={"_before": "_ctx"})
    return scanned.select(
        doc, order, title, F.col("_before.title").alias("previous_title"), F.col("_before.body").alias("previous_start")
    )
