"""Vectorisation jobs: telemetry files and documents to masked, embedded and indexed texts, in stages that are not repeated."""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orepulse.operators import chunking, documents
from orepulse.operators.quality import intake_verdict, mask_identifiers
from orepulse.operators.reshape import coerce_dates, run_recipe
from orepulse.operators.retrieval import embed, fits_dimension
from orepulse.operators.schema import absent_in_scope, presence_manifest, reconcile, vocabulary
from orepulse.plans.stages import JobResult, Source, Stage, run_stages
from orepulse.session import checkpoint_cut
from orepulse.sources.ledger import append_ledger, read_ledger, stale_files
from orepulse.sources.snapshots import read_current, replace_keys

CODE = "3"  # raise it when the stages compute something else
DIMENSION = 1024
Embedder = Callable[[Column], Column]


def files_signature(files: DataFrame, *signed: str) -> str:
    """One stamp for a set of files (and their ``signed`` columns): order does not matter, and no list of files is gathered."""
    row = files.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.xxhash64(F.lit(i), *signed).cast("decimal(38,0)")).alias(f"s{i}") for i in range(2)]).first()
    return f"{row['n']}-{row['s0']}-{row['s1']}"


# ---- telemetry ------------------------------------------------------------------------------


def inspect_sources(raw: DataFrame, source: str, fields: DataFrame, accept_share: float = 0.6) -> DataFrame:
    """One row per source: its size, verdict, recognised and unknown columns, absent fields and active domains.

    A column belongs to a source that has values in it. All sources are counted in one pass.
    """
    columns = [c for c in raw.columns if c != source]
    counts = [F.count(F.lit(1)).alias("row_count")]
    for i, c in enumerate(columns):
        counts += [F.count(c).alias(f"n{i}"), (F.min(c).eqNullSafe(F.max(c))).alias(f"same{i}")]
    cells = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column_name"), F.col(f"n{i}").alias("n"), F.col(f"same{i}").alias("constant")) for i, c in enumerate(columns)])
    counted = raw.groupBy(F.col(source).alias("source_file")).agg(*counts).select("source_file", "row_count", F.filter(cells, lambda c: c["n"] > 0).alias("cells"))
    headers = counted.select("source_file", F.inline("cells")).select("source_file", "ordinal", "column_name")
    resolved = reconcile(headers, fields)
    matched = resolved.groupBy("source_file").agg(
        F.count_if(F.col("status") == "resolved").alias("matched_columns"), F.count_if(F.col("status") != "ignored").alias("candidate_columns"),
        F.array_sort(F.collect_list(F.when(F.col("status").isin("unknown", "ambiguous"), F.col("column_name")))).alias("unmapped_columns"),
        F.split(F.max("active_domains"), ",").alias("active_domains"),
    )
    absent = absent_in_scope(presence_manifest(resolved, fields)).groupBy("source_file").agg(F.array_sort(F.collect_list("canonical")).alias("missing_fields"))
    signals = counted.join(matched, "source_file", "left").select(
        "source_file", "row_count", F.size("cells").alias("column_count"), F.coalesce("matched_columns", F.lit(0)).alias("matched_columns"),
        F.coalesce("candidate_columns", F.lit(0)).alias("candidate_columns"), F.size(F.filter("cells", lambda c: c["constant"])).alias("constant_columns"),
        F.lit(False).alias("peer_graph"),
    )
    none = F.array().cast("array<string>")
    return (
        signals.join(intake_verdict(signals, accept_share), "source_file")
        .join(matched.select("source_file", "unmapped_columns", "active_domains"), "source_file", "left")
        .join(absent, "source_file", "left")
        .withColumns({c: F.coalesce(c, none) for c in ("unmapped_columns", "active_domains", "missing_fields")})
        .drop("peer_graph")
    )


def vectorise_telemetry(
    spark: SparkSession, folder: str, index: str, raw: Source, *, source: str = "source_file", date: str, order: Sequence[str], entities: Sequence[str],
    metrics: Sequence[str], categories: Sequence[str], recipe: Sequence[Mapping] = (), fields: DataFrame | None = None,
    verdicts: Sequence[str] = ("accept", "quarantine"), strategy: str = "time_window", window_days: int = 7, max_rows: int = 500, overlap: int = 50,
    markers: bool = True, dimension: int = DIMENSION, embedder: Embedder | None = None, embedder_name: str = "hashed terms",
    force: bool | Collection[str] = False, only: Collection[str] | None = None,
) -> JobResult:
    """Telemetry rows of any number of files to chunk texts with vectors in ``index``.

    Stages below ``folder``: ``schema`` inspects and judges every source, ``canonical`` applies the recipe and parses dates of the sources
    with one of ``verdicts``, ``chunks`` cuts them and writes texts with identifiers masked, ``vectors`` embeds these and marks vectors
    that cannot be used, and ``index`` replaces the sources' chunks in the index, a snapshot table by source. The last result has, per
    source, ``row_count, verdict, chunks, embedded, indexed, failed``. Stages with a result for the same input, settings and code are not
    run; a source that lost all its chunks loses them in the index, too.
    """
    fields = vocabulary(spark) if fields is None else fields
    steps = [dict(s) for s in recipe]

    def canonical(rows: DataFrame, schema: DataFrame) -> DataFrame:
        taken = schema.filter(F.col("verdict").isin(*verdicts)).select(F.col("source_file").alias(source))
        kept, _ = run_recipe(rows.join(taken, source, "left_semi"), steps)
        return coerce_dates(kept, [date] if dict(kept.dtypes)[date] == "string" else [])

    def chunks(rows: DataFrame, schema: DataFrame) -> DataFrame:
        if strategy == "time_window":
            cut = chunking.time_window_chunks(rows, source, date, order, window_days=window_days, max_rows=max_rows, overlap=overlap)
        elif strategy == "row_count":
            cut = chunking.row_count_chunks(rows, source, order, size=max_rows, overlap=overlap)
        else:
            raise ValueError(f"Unsupported chunk strategy '{strategy}'; use time_window or row_count")
        notes = schema.select(F.col("source_file").alias(source), "missing_fields", "unmapped_columns", "active_domains") if markers else None
        made = chunking.chunk_documents(cut, source, date=date, entities=entities, metrics=metrics, categories=categories, markers=notes)
        return mask_identifiers(made, "text")

    def vectors(made: DataFrame) -> DataFrame:
        return _with_vectors(made, "chunk_id", "text", dimension, embedder, keys=[source, "chunk_index"])

    def indexed(made: DataFrame, schema: DataFrame) -> DataFrame:
        usable = made.filter("usable").select(F.col(source).alias("source"), "chunk_index", "chunk_id", "text", "metadata", "embedding")
        replace_keys(usable, index, "source", clear=schema.select(F.col("source_file").alias("source")))
        stored = read_current(spark, index).groupBy(F.col("source").alias(source)).agg(F.count(F.lit(1)).alias("indexed"))
        counted = made.groupBy(source).agg(F.count(F.lit(1)).alias("chunks"), F.count("embedding").alias("embedded"), F.count_if(~F.col("usable")).alias("failed"))
        base = schema.select(F.col("source_file").alias(source), "row_count", "verdict")
        return base.join(counted, source, "left").join(stored, source, "left").na.fill(0, ["chunks", "embedded", "failed", "indexed"])

    cutting = {"strategy": strategy, "window_days": window_days, "max_rows": max_rows, "overlap": overlap, "markers": markers}
    shape = {"date": date, "order": list(order), "entities": list(entities), "metrics": list(metrics), "categories": list(categories)}
    stages = [
        Stage("schema", lambda rows: inspect_sources(rows, source, fields), ("raw",), CODE),
        Stage("canonical", canonical, ("raw", "schema"), CODE, {"recipe": steps, "verdicts": list(verdicts), "date": date}),
        Stage("chunks", chunks, ("canonical", "schema"), CODE, {**cutting, **shape}),
        Stage("vectors", vectors, ("chunks",), CODE, {"dimension": dimension, "embedder": embedder_name}),
        Stage("index", indexed, ("vectors", "schema"), CODE, {"index": index}),
    ]
    return run_stages(spark, folder, {"raw": raw}, stages, force=force, only=only)


def _with_vectors(made: DataFrame, key: str, text: str, dimension: int, embedder: Embedder | None, keys: Sequence[str]) -> DataFrame:
    """``made`` with ``embedding`` and ``usable``; texts that an embedder gives no vector of the right length are not usable."""
    numbered = made.withColumn("_key", F.xxhash64(*keys, key))
    vectors = embed(numbered.select("_key", text), "_key", text, dimension=dimension, embedder=embedder)
    return numbered.join(vectors, "_key", "left").withColumn("usable", fits_dimension("embedding", dimension)).drop("_key")


def vectorise_stale_files(
    spark: SparkSession, files: DataFrame, ledger: str, folder: str, index: str, read: Callable[[DataFrame], DataFrame], *, version: str = CODE,
    force: bool = False, **options,
) -> DataFrame:
    """Vectorise the telemetry files that the ledger does not know as done: ``client_id, source_file, reason, action``.

    ``files``: ``client_id, source_file, signature``; ``read`` gives the rows of those it is asked for. Without stale files nothing is
    read. A run that dies leaves the ledger as it was, and the next one takes up its finished stages; the ledger gets its records only
    when the index holds the files' chunks. A failed run is recorded as ``failed``.
    """
    judged = stale_files(files, read_ledger(spark, ledger), version)
    reason = F.coalesce("reason", F.lit("forced")) if force else F.col("reason")
    judged = checkpoint_cut(judged.withColumn("reason", reason))  # decided once: the ledger changes below
    stale = judged.filter("reason IS NOT NULL")
    if stale.isEmpty():
        return judged.withColumn("action", F.lit("skipped")).drop("signature")
    raw = Source(files_signature(stale, "source_file", "signature"), lambda: read(stale.select("source_file")))
    done = vectorise_telemetry(spark, folder, index, raw, force=force, **options)
    status = "indexed" if done.success else "failed"
    last = read_ledger(spark, ledger).agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    append_ledger(
        stale.select(
            F.lit(last + 1).cast("bigint").alias("seq"), "client_id", "source_file", F.col("signature").alias("content_signature"),
            F.lit(version).alias("pipeline_version"), F.lit(status).alias("status"),
        ),
        ledger,
    )
    return judged.withColumn("action", F.when(F.col("reason").isNull(), "skipped").otherwise(status)).drop("signature")


# ---- documents ------------------------------------------------------------------------------


def extract_sections(blocks: DataFrame, texts: DataFrame, facts: DataFrame, doc: str, *, lines_per_page: int = 40) -> DataFrame:
    """Sections of all documents with their ``extraction_method`` and ``batch_index``.

    Documents classified as simple come from their layout blocks (``layout``), the others from their text, cut at headings: as a whole
    (``text_single``) or, where they are too long for that, in batches of pages (``text_batch``), a section being in the batch that its
    first page is in. ``facts``: ``doc, doc_class, route``.
    """
    simple = facts.filter("doc_class = 'simple'").select(doc)
    layout = documents.layout_sections(blocks.join(simple, doc, "left_semi"), doc).select(
        doc, "section_no", "title", "body", "tables", "page_start", "page_end", F.lit("layout").alias("extraction_method"), F.lit(0).cast("bigint").alias("batch_index")
    )
    lines = checkpoint_cut(documents.text_lines(texts.join(facts.filter("doc_class <> 'simple'").select(doc), doc, "left_semi"), doc, "text", lines_per_page))
    sections = documents.heading_sections(lines, doc)
    heading = documents.is_numbered_heading(F.col("line")) | documents.is_all_caps_heading(F.col("line"))
    pages = lines.join(facts.filter("route = 'batch'").select(doc), doc, "left_semi").groupBy(doc, F.col("page").cast("bigint").alias("page")).agg(
        (F.sum(F.length("line") + 1) / 1e6).alias("megabytes"), F.bool_or(heading).alias("starts_section")
    )
    batches = documents.pack_batches(pages, doc).select(doc, "batch_index", F.explode(F.sequence("page_start", "page_end")).alias("page_start"))
    read = sections.join(batches, [doc, "page_start"], "left")
    method = F.when(F.col("batch_index").isNull(), "text_single").otherwise("text_batch")
    return layout.unionByName(
        read.select(
            doc, "section_no", "title", "body", F.array().cast(f"array<struct<cells:{documents.CELLS}>>").alias("tables"), "page_start", "page_end",
            method.alias("extraction_method"), F.coalesce("batch_index", F.lit(0).cast("bigint")).alias("batch_index"),
        )
    )


def vectorise_documents(
    spark: SparkSession, folder: str, index: str, facts: Source, blocks: Source, texts: Source, *, doc: str = "source", dimension: int = DIMENSION,
    embedder: Embedder | None = None, embedder_name: str = "hashed terms", lines_per_page: int = 40, force: bool | Collection[str] = False,
    only: Collection[str] | None = None,
) -> JobResult:
    """Documents to masked section records with vectors in ``index``, a snapshot table by document.

    ``facts``: ``doc, avg_chars, page_count, doc_type_tag, model_class, model_confidence, file_bytes``; ``blocks`` as for
    ``layout_sections``; ``texts``: ``doc, text``. Stages: ``classified`` (class and route), ``sections``, ``records`` (cleaned, split,
    numbered, with all their fields, identifiers masked), ``vectors`` and ``index``. The last result has, per document, its class, route,
    pages, batches and ``extracted, normalised, embedded, indexed, failed``. Stages with a result for the same input are not run.
    """

    def classified(given: DataFrame) -> DataFrame:
        route = documents.route_by_size(F.col("page_count"), F.col("file_bytes") / 1e6)
        return documents.classify_documents(given).select(
            doc, "doc_class", "confidence", "signal", route.alias("route"), "file_bytes", F.col("page_count").cast("bigint").alias("total_pages")
        )

    def sections(kinds: DataFrame, layout: DataFrame, plain: DataFrame) -> DataFrame:
        return extract_sections(layout, plain, kinds, doc, lines_per_page=lines_per_page)

    def records(found: DataFrame, kinds: DataFrame) -> DataFrame:
        return mask_identifiers(documents.section_records(found, doc, "section_no", documents=kinds), "body")

    def vectors(made: DataFrame) -> DataFrame:
        return _with_vectors(made, "section_id", "body", dimension, embedder, keys=[doc])

    def indexed(made: DataFrame, found: DataFrame, kinds: DataFrame) -> DataFrame:
        replace_keys(made.filter("usable").drop("usable", "section_no").withColumnRenamed(doc, "source"), index, "source", clear=kinds.select(F.col(doc).alias("source")))
        stored = read_current(spark, index).groupBy(F.col("source").alias(doc)).agg(F.count(F.lit(1)).alias("indexed"))
        extracted = found.groupBy(doc).agg(F.count(F.lit(1)).alias("extracted"), F.countDistinct("batch_index").alias("batches"))
        counted = made.groupBy(doc).agg(F.count(F.lit(1)).alias("normalised"), F.count("embedding").alias("embedded"), F.count_if(~F.col("usable")).alias("failed"))
        base = kinds.select(doc, "doc_class", "signal", "route", "total_pages")
        joined = base.join(extracted, doc, "left").join(counted, doc, "left").join(stored, doc, "left")
        return joined.na.fill(0, ["extracted", "batches", "normalised", "embedded", "failed", "indexed"])

    stages = [
        Stage("classified", classified, ("facts",), CODE),
        Stage("sections", sections, ("classified", "blocks", "texts"), CODE, {"lines_per_page": lines_per_page}),
        Stage("records", records, ("sections", "classified"), CODE),
        Stage("vectors", vectors, ("records",), CODE, {"dimension": dimension, "embedder": embedder_name}),
        Stage("index", indexed, ("vectors", "sections", "classified"), CODE, {"index": index}),
    ]
    return run_stages(spark, folder, {"facts": facts, "blocks": blocks, "texts": texts}, stages, force=force, only=only)
