"""Retrieval over the regulatory, telemetry and analysis indexes: one scan, tenant scope, parents, fusion and context."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orepulse.operators.retrieval import (
    ANALYSIS_K, FUSED_HITS, INDEX_ORDER, REGULATORY_K, TELEMETRY_K, context_block, fuse_ranks, in_tenant_scope, locator, nearest, text_preview, valid_client,
)
from orepulse.session import checkpoint_cut

HITS_OF = {"regulatory": REGULATORY_K, "telemetry": TELEMETRY_K, "analysis": ANALYSIS_K}
COLUMNS = {
    "regulatory": ("source", "title", "body", "page_start", "page_end", "embedding"),
    "telemetry": ("source", "chunk_index", "text", "embedding"),
    "analysis": ("client_id", "chunk_level", "parent_id", "section", "text", "embedding"),
}
EVERYONE = "*"  # no tenant id holds this character


@dataclass
class Retrieval:
    """``hits``: ``query_id, index, locator, score, text, findings``; ``errors``: why an index could not be searched."""

    hits: DataFrame
    errors: dict[str, str]


def open_indexes(indexes: Mapping[str, Callable[[], DataFrame]]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """The indexes that can be opened and have the columns of their kind, and the errors of the others."""
    opened, errors = {}, {}
    for name, read in indexes.items():
        try:
            frame = read()
            missing = [c for c in COLUMNS[name] if c not in frame.columns]
            if missing:
                raise ValueError(f"columns missing: {', '.join(missing)}")
            opened[name] = frame
        except Exception as error:  # noqa: BLE001 - the other indexes are searched all the same
            errors[name] = f"{type(error).__name__}: {str(error).splitlines()[0]}"
    return opened, errors


def _row_text(index: str):
    return F.trim(F.concat_ws("\n", "title", "body")) if index == "regulatory" else F.col("text")


def row_id(index: str, rows: DataFrame):
    """A 64-bit id of a row: its own ``row_id`` if it has one, apart from those of other indexes, or else a digest of what it holds."""
    if "row_id" in rows.columns:
        return F.col("row_id").cast("bigint") * len(INDEX_ORDER) + INDEX_ORDER.index(index)
    return F.xxhash64(F.lit(index), *[c for c in rows.columns if c != "embedding"])


def search_all(opened: Mapping[str, DataFrame], queries: DataFrame, hits_of: Mapping[str, int] = HITS_OF, scan: Callable[..., DataFrame] = nearest) -> DataFrame:
    """Best rows of every index per query, in one scan: ``query_id, client_id, index, row_id, score, rank`` and the rows' columns.

    ``queries``: ``query_id, client_id, query_vector``. Regulatory rows are open to all. Telemetry rows belong to the tenant whose id is
    the first segment of their source, analysis rows to their tenant; a query without a valid tenant id searches regulatory rows only.
    Equal scores go by ``row_id``, which an index may have as a column.
    Every hit's tenant is compared again with the query's after the search.
    """
    parts = []
    for name, frame in opened.items():
        rows = frame.filter("chunk_level = 'child'") if name == "analysis" else frame
        owner = {"regulatory": F.lit(EVERYONE), "telemetry": F.regexp_extract("source", "^([^/]+)/", 1), "analysis": F.col("client_id")}[name]
        source = F.concat(F.col("client_id"), F.lit("/")) if name == "analysis" else F.col("source")
        parts.append(
            rows.select(
                F.lit(name).alias("index"), row_id(name, rows).alias("row_id"),
                F.concat_ws("|", F.lit(name), owner).alias("scope"), "embedding", source.alias("source"), F.col("parent_id" if name == "analysis" else "source").alias("parent_id"),
                (F.lit("") if name == "analysis" else locator(name)).alias("locator"), (F.lit(None).cast("string") if name == "analysis" else _row_text(name)).alias("text"),
            )
        )
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    wanted = F.array(*[F.struct(F.lit(n).alias("index"), F.lit(i).cast("bigint").alias("no"), F.lit(hits_of[n]).alias("k")) for i, n in enumerate(INDEX_ORDER) if n in opened])
    routes = queries.select("query_id", "client_id", "query_vector", F.inline(wanted)).withColumn(
        "scope", F.concat_ws("|", "index", F.when(F.col("index") == "regulatory", EVERYONE).when(valid_client(F.col("client_id")), F.col("client_id")).otherwise("")),
    ).withColumn("route", F.xxhash64("query_id", "no"))
    found = scan(table, routes, max(hits_of[n] for n in opened), vector_id="row_id", query_id="route", scope=("scope", "scope"))
    placed = found.join(routes.select("route", "query_id", "client_id", "index", "k"), "route").filter(F.col("rank") <= F.col("k"))
    rows = placed.join(table.drop("embedding", "scope", "index"), "row_id")
    own = (F.col("index") == "regulatory") | in_tenant_scope(F.col("source"), F.col("client_id"))
    return rows.filter(own).select("query_id", "client_id", "index", "row_id", "score", "rank", "source", "parent_id", "locator", "text")


def retrieve(
    indexes: Mapping[str, Callable[[], DataFrame]], queries: DataFrame, *, hits_of: Mapping[str, int] = HITS_OF, scan: Callable[..., DataFrame] = nearest
) -> Retrieval:
    """Hits of every query (``query_id, client_id, query_vector``) in all ``indexes`` that can be searched.

    ``indexes`` maps ``regulatory``, ``telemetry`` and ``analysis`` to functions that open them; one that fails is named in ``errors`` and
    the others are searched without it. Analysis hits are findings; they are replaced by the section they belong to, with the best score
    of its findings, its text, files and exact values. ``scan`` is the search itself, exact unless another with the same arguments is given.
    """
    opened, errors = open_indexes(indexes)
    if not opened:
        raise RuntimeError(f"no index can be searched: {errors}")
    found = checkpoint_cut(search_all(opened, queries, hits_of, scan))
    flat = found.filter("index <> 'analysis'").select("query_id", "index", "locator", "score", "text", F.lit(None).cast("string").alias("findings"))
    if "analysis" in opened:
        parents = opened["analysis"].filter("chunk_level = 'parent'")
        sources = F.col("sources") if "sources" in parents.columns else F.lit("")
        findings = F.col("key_findings") if "key_findings" in parents.columns else F.lit(None).cast("string")
        parents = parents.select("client_id", "parent_id", locator("analysis", {"section": F.col("section"), "sources": sources}).alias("locator"), "text", findings.alias("findings"))
        best = found.filter("index = 'analysis' AND parent_id IS NOT NULL").groupBy("query_id", "client_id", "parent_id").agg(F.max("score").alias("score"))
        flat = flat.unionByName(best.join(parents, ["client_id", "parent_id"]).select("query_id", F.lit("analysis").alias("index"), "locator", "score", "text", "findings"))
    return Retrieval(flat, errors)


def context_of(hits: DataFrame, top: int = FUSED_HITS) -> DataFrame:
    """``query_id, position, index, locator, score, preview, block``: the fused hits with their previews and context entries."""
    order = Window.partitionBy("query_id", "index", "locator").orderBy(F.desc("score"), F.asc("text"))
    once = hits.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n", "score")
    ranked = fuse_ranks(hits.select("query_id", "index", "locator", "score"), top=top).join(once, ["query_id", "index", "locator"])
    return ranked.select(
        "query_id", "position", "index", "locator", F.round("score", 6).alias("score"), text_preview(F.col("text")).alias("preview"),
        context_block(F.col("position"), F.col("locator"), F.col("text"), F.col("findings")).alias("block"),
    )


def evaluation_matrix(answers: DataFrame) -> DataFrame:
    """Per client, model and query: documents and hits per index, characters of the answer, and seconds.

    ``answers``: one row per answer with ``client_id, model, query_id, answer, seconds, error`` and ``documents``, an array of structs with
    ``index``. An answer with an error has no documents and no characters. Latency is the mean of the answers, three decimals.
    """
    good = F.col("error").isNull()

    def hits(index: str):
        own = F.filter("documents", lambda d: d["index"] == index)
        return F.sum(F.when(good, F.coalesce(F.size(own), F.lit(0))).otherwise(0)).cast("bigint").alias(f"{index}_hits")

    return answers.groupBy("client_id", "model", "query_id").agg(
        F.count(F.lit(1)).alias("answers"), F.count_if(~good).alias("failed"), F.sum(F.when(good, F.coalesce(F.size("documents"), F.lit(0))).otherwise(0)).cast("bigint").alias("documents"), *[hits(i) for i in INDEX_ORDER],
        F.coalesce(F.sum(F.when(good, F.length("answer"))), F.lit(0)).cast("bigint").alias("answer_chars"), F.round(F.avg("seconds"), 3).alias("mean_seconds"), F.max("seconds").alias("max_seconds"),
    )
