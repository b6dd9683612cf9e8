"""Vectorisation of telemetry and documents, analysis from stored states, retrieval over stored indexes."""

import json
import os
import random
import uuid
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orepulse import session
from orepulse.operators import documents, retrieval
from orepulse.operators.vector_index import build_index, learn_index, search_index
from orepulse.plans import dashboard, incremental, retrieve, vectorise
from orepulse.plans.stages import Source, Stage, run_stages
from orepulse.plans.suite_service import METRICS, tenant_files, tenant_fleet, tenant_queries, tenant_vectors
from orepulse.plans.suite_text import _documents_of_chunks, layout_blocks, telemetry
from orepulse.session import checkpoint_cut, settled
from orepulse.sources.ledger import read_ledger
from orepulse.sources.snapshots import latest_version, read_current

TELEMETRY = {
    "date": "ts", "order": ["event_id"], "entities": ["equipment_id"], "metrics": ["fuel_litres", "vibration"], "categories": ["event_type"], "dimension": 64,
    "markers": False,
}


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)


# ---- telemetry ------------------------------------------------------------------------------


def test_telemetry_ends_in_the_index_and_is_not_repeated(spark, small, tmp_path):
    folder, index = str(tmp_path / "job"), str(tmp_path / "index")
    reads = []

    def read():
        reads.append(1)
        return telemetry(spark, small)

    done = vectorise.vectorise_telemetry(spark, folder, index, Source("v1", read), **TELEMETRY)
    assert done.success, done.stages[-1].error
    assert done.made == ["schema", "canonical", "chunks", "vectors", "index"]
    stored = read_current(spark, index)
    expected = _documents_of_chunks(spark, small)
    assert rows(stored, "source", "chunk_index", "chunk_id", "text") == rows(expected.withColumnRenamed("source_file", "source"), "source", "chunk_index", "chunk_id", "text")
    assert stored.filter("size(embedding) <> 64").count() == 0
    counted = spark.read.parquet(done.path("index")).collect()
    assert sum(r.indexed for r in counted) == expected.count() and all(r.failed == 0 and r.embedded == r.chunks == r.indexed for r in counted)
    assert sum(r.row_count for r in counted) == telemetry(spark, small).count()
    reads.clear()
    version = latest_version(spark, index)
    again = vectorise.vectorise_telemetry(spark, folder, index, Source("v1", read), **TELEMETRY)
    assert again.made == [] and not reads and latest_version(spark, index) == version
    wider = vectorise.vectorise_telemetry(spark, folder, index, Source("v1", read), **{**TELEMETRY, "max_rows": 100})
    assert wider.made == ["chunks", "vectors", "index"] and not [1 for s in wider.stages if s.status == "failed"]


def test_a_source_that_loses_its_rows_leaves_the_index(spark, small, tmp_path):
    folder, index = str(tmp_path / "job"), str(tmp_path / "index")
    rows_ = telemetry(spark, small)
    vectorise.vectorise_telemetry(spark, folder, index, Source("1", lambda: rows_), **TELEMETRY)
    undated = rows_.withColumn("ts", F.when(~F.col("source_file").startswith("C1"), F.col("ts")))
    vectorise.vectorise_telemetry(spark, folder, index, Source("2", lambda: undated), **TELEMETRY)
    assert {r.source for r in read_current(spark, index).select("source").distinct().collect()} == {"C2/sensors/events.csv", "C3/sensors/events.csv"}


def test_embedder_failures_are_counted(spark, small, tmp_path):
    def short(text):
        return F.when(F.length(text) % 2 == 0, F.array_repeat(F.lit(0.5), 64)).otherwise(F.array(F.lit(1.0)))

    done = vectorise.vectorise_telemetry(
        spark, str(tmp_path / "job"), str(tmp_path / "index"), Source("1", lambda: telemetry(spark, small)), embedder=short, embedder_name="short",
        strategy="row_count", **TELEMETRY,
    )
    counted = spark.read.parquet(done.path("index")).agg(F.sum("chunks"), F.sum("failed"), F.sum("indexed")).first()
    assert counted[1] > 0 and counted[0] == counted[1] + counted[2] == read_current(spark, str(tmp_path / "index")).count() + counted[1]


def test_stale_files_only_and_a_crash_resumes(spark, small, tmp_path, monkeypatch):
    ledger, folder, index = (str(tmp_path / n) for n in ("ledger", "job", "index"))
    everything = telemetry(spark, small)
    files = everything.select("source_file").distinct().select(F.substring_index("source_file", "/", 1).alias("client_id"), "source_file", F.lit("s1").alias("signature"))
    asked = []

    def read(wanted):
        asked.append(rows(wanted))
        return everything.join(wanted, "source_file", "left_semi")

    run = lambda f=files: vectorise.vectorise_stale_files(spark, f, ledger, folder, index, read, **TELEMETRY)
    with monkeypatch.context() as patch:
        def dies(*_, **__):
            raise KeyboardInterrupt

        patch.setattr(vectorise, "replace_keys", dies)
        with pytest.raises(KeyboardInterrupt):
            run()
    assert read_ledger(spark, ledger).count() == 0 and latest_version(spark, index) == 0
    asked.clear()
    assert {r.action for r in run().collect()} == {"indexed"} and not asked  # all stages but the last were there
    assert {r.action for r in run().collect()} == {"skipped"} and not asked
    changed = files.withColumn("signature", F.when(F.col("client_id") == "C2", "s2").otherwise(F.col("signature")))
    result = {r.client_id: (r.reason, r.action) for r in run(changed).collect()}
    assert result == {"C1": (None, "skipped"), "C2": ("changed", "indexed"), "C3": (None, "skipped")}
    assert asked == [[("C2/sensors/events.csv",)]]
    assert read_current(spark, index).select("source").distinct().count() == 3


# ---- documents ------------------------------------------------------------------------------


def block(ident, kind, top, text=None, kids=(), page=1, row=None, col=None):
    return ("d", ident, kind, page, float(top), 0.0, text, list(kids), row, col)


BLOCKS = "doc string, block_id string, block_type string, page int, top double, left_pos double, text string, child_ids array<string>, row_index int, col_index int"


def deep_blocks(spark):
    return spark.createDataFrame(
        [
            block("p", "PAGE", 0, kids=["h", "t", "f", "tab", "list", "o"]),
            block("o", "LINE", 0.5, "stray line"), block("ti", "LAYOUT_TITLE", 0.7, kids=["til"]), block("til", "LINE", 0.7, "Big Title"),
            block("h", "LAYOUT_SECTION_HEADER", 1, kids=["hl"]), block("hl", "LINE", 1, "Part 1 Scope", kids=["w1"]), block("w1", "WORD", 1, "Part"),
            block("t", "LAYOUT_TEXT", 2, kids=["l2", "l1"]), block("l1", "LINE", 2, "second"), block("l2", "LINE", 2, "first", kids=["w2"]), block("w2", "WORD", 2, "word"),
            block("f", "LAYOUT_FIGURE", 3, kids=["g"]), block("g", "GROUP", 3, kids=["gg"]), block("gg", "GROUP", 3, kids=["fl"]), block("fl", "LINE", 3, "figure words"),
            block("list", "LAYOUT_LIST", 4, kids=["li1", "li2"]), block("li1", "LAYOUT_TEXT", 4, kids=["ll1"]), block("ll1", "LINE", 4, "item a"),
            block("li2", "LAYOUT_TEXT", 4.5, kids=["ll2"]), block("ll2", "LINE", 4.5, "item b"), block("n", "LAYOUT_PAGE_NUMBER", 9, kids=["nl"]), block("nl", "LINE", 9, "12"),
            block("tab", "TABLE", 5, kids=["c11", "c12", "c21", "m"]), block("c11", "CELL", 5, kids=["x1"], row=1, col=1), block("x1", "WORD", 5, "km"),
            block("c12", "CELL", 5, kids=["x2", "x3"], row=1, col=2), block("x2", "WORD", 5, "per"), block("x3", "WORD", 5, "hour"), block("c21", "CELL", 5, row=2, col=1),
            block("m", "MERGED_CELL", 5, kids=["x4"], row=2, col=2), block("x4", "WORD", 5, " 7 "), block("foot", "LAYOUT_FOOTER", 6, kids=["fo"], page=2), block("fo", "LINE", 6, "footer", page=2),
            block("h2", "LAYOUT_SECTION_HEADER", 7, page=2),
        ],
        BLOCKS,
    )


def test_blocks_at_any_depth(spark):
    found = dict(rows(documents.block_texts(deep_blocks(spark), "doc"), "block_id", "resolved"))
    assert found["h"] == "Part 1 Scope" and found["hl"] == "Part 1 Scope" and found["t"] == "first second" and found["f"] == found["gg"] == "figure words"
    assert found["list"] == "item a item b" and found["tab"] == "km per hour  7 " and "c21" not in found
    assert found["p"] == "Part 1 Scope first second figure words km per hour  7  item a item b stray line"
    loop = spark.createDataFrame([block("a", "GROUP", 1, kids=["b", "l"]), block("b", "GROUP", 1, kids=["a"]), block("l", "LINE", 1, "x")], BLOCKS)
    with pytest.raises(ValueError, match="cycle"):
        documents.block_texts(loop, "doc").collect()


@pytest.fixture
def cuts(tmp_path, monkeypatch):
    """How many tables lie in a checkpoint folder that only one test uses."""
    os.mkdir(f"{tmp_path}/cuts")
    monkeypatch.setattr(session, "shared_path", lambda spark: f"{tmp_path}/cuts/orepulse-{uuid.uuid4().hex}")
    return lambda: len(os.listdir(f"{tmp_path}/cuts"))


def test_groups_of_documents_give_the_same_sections_and_leave_nothing(spark, monkeypatch, cuts):
    one = deep_blocks(spark)
    blocks = reduce(DataFrame.unionByName, [one.withColumn("doc", F.lit(name).cast("string")) for name in ("d", "e", "f", None)])
    text = lambda df: sorted(str(r) for r in df.collect())
    whole = documents.layout_sections(blocks, "doc")
    assert cuts() == 1  # the sections; what they were made from is deleted
    monkeypatch.setattr(documents, "MOST_LINKS", 40)
    parts = documents.layout_sections(blocks, "doc")
    assert cuts() > 2 and text(parts) == text(whole) and len(text(whole)) >= 9


def test_a_stage_leaves_only_its_result(spark, tmp_path, cuts):
    source = Source("s", lambda: checkpoint_cut(spark.range(5).withColumn("x", F.col("id") * 2)))
    stages = [
        Stage("one", lambda given: checkpoint_cut(given.filter("id > 1")), ("given",)),
        Stage("two", lambda first, given: settled(spark, lambda: checkpoint_cut(first).join(checkpoint_cut(given), ["id", "x"])), ("one", "given")),
    ]
    done = run_stages(spark, f"{tmp_path}/job", {"given": source}, stages)
    assert done.success and sorted(r["x"] for r in spark.read.parquet(done.path("two")).collect()) == [4, 6, 8]
    assert cuts() == 1  # what the source read for both stages


def test_layout_sections_hold_everything(spark):
    first, second, third = documents.layout_sections(deep_blocks(spark), "doc").orderBy("section_no").collect()
    assert first.title == "untitled-0" and first.body == "stray line\nBig Title" and first.page_start == 1
    assert second.title == "Part 1 Scope" and second.body.split("\n") == ["first second", "figure words", "item a", "item a item b", "item b", "footer"]
    assert second.page_start == 1 and second.page_end == 2 and second.table_count == 1
    assert [tuple(c) for c in second.tables[0].cells] == [(1, 1, "km"), (1, 2, "per hour"), (2, 1, ""), (2, 2, " 7 ")]
    assert third.title == "untitled" and third.body == "" and third.table_count == 0
    text = spark.createDataFrame([(second.tables,), ([],), (None,)], f"tables array<struct<cells:{documents.CELLS}>>").select(documents.tables_text(F.col("tables")))
    assert [r[0] for r in text.collect()] == ["| km | per hour |\n|  | 7 |\n", "", ""]


def test_words_go_up_as_one_text_per_line(spark, monkeypatch):
    """What is written down between the rounds is a row per container, not one per word."""
    columns = "doc string, block_id string, block_type string, page bigint, top double, left_pos double, text string, child_ids array<string>"
    rows_ = [("d", f"W{i:03d}", "WORD", 1, 0.0, 0.0, f"w{i}", []) for i in range(300)]
    rows_ += [("d", f"N{n}", "GROUP", 1, 0.0, 0.0, None, [f"W{n * 100 + i:03d}" for i in range(100)]) for n in range(3)]
    rows_ += [("d", "B", "LAYOUT_TEXT", 1, 0.0, 0.0, None, ["N0", "W000", "N1", "N2"])]
    blocks, written = spark.createDataFrame(rows_, columns), []
    cut = documents.checkpoint_cut

    def counted(df, *args, **kwargs):
        done = cut(df, *args, **kwargs)
        written.append(done.count())
        return done

    monkeypatch.setattr(documents, "checkpoint_cut", counted)
    found = documents.layout_sections(blocks, "doc").collect()
    words = [f"w{i}" for i in range(300)]
    assert [r.body for r in found] == [" ".join([*words[:100], "w0", *words[100:]])]
    assert sum(written) < 30


def test_repeated_containers_mix_their_texts(spark):
    """Two containers of one id: their texts follow by place, as every other text does."""
    columns = "doc string, block_id string, block_type string, page bigint, top double, left_pos double, text string, child_ids array<string>"
    leaf = [("d", i, "LINE", 1, 0.0, 0.0, t, []) for i, t in (("a", "one"), ("b", "two"), ("c", "three"), ("e", "four"), ("e", "five"))]
    twice = [("d", "G", "GROUP", 1, 0.0, 0.0, None, ["a", "b"]), ("d", "G", "GROUP", 1, 0.0, 0.0, None, ["c", "e"])]
    top = [("d", "T", "LAYOUT_TEXT", 1, 0.0, 0.0, None, ["G"]), ("f", "T", "LAYOUT_TEXT", 1, 0.0, 0.0, None, ["G"])]
    found = {(r.doc, r.block_id): r.resolved for r in documents.block_texts(spark.createDataFrame([*leaf, *twice, *top], columns), "doc").collect()}
    assert found["d", "T"] == found["d", "G"] == "one three five four two"
    assert ("f", "T") not in found


def test_section_records(spark):
    sections = documents.layout_sections(deep_blocks(spark), "doc").withColumn("body", F.when(F.col("section_no") == 1, F.concat("body", F.repeat(F.lit(" more words"), 900))).otherwise(F.col("body")))
    known = spark.createDataFrame([("d", "simple", 1234, 2)], "doc string, doc_class string, file_bytes long, total_pages long")
    found = documents.section_records(sections, "doc", "section_no", documents=known).orderBy("section_id").collect()
    assert [r.section_id for r in found] == ["d-s0000", "d-s0001"] and found[0].title == "Part 1 Scope (part 1 of 2)"
    assert found[0].tables and not found[1].tables and found[0].citations == [] and found[1].page_end == 2 and found[1].body.endswith("| km | per hour |\n|  | 7 |\n")
    assert found[0].metadata.file_bytes == 1234 and found[0].metadata.schema_version == "1.0" and found[0].extraction_method == "layout" and found[0].batch_index == 0


def packed(pages, max_pages, max_mb):
    """The sequential rule."""
    out, at = [], 0
    while at < len(pages):
        end, total = at, pages[at][1]
        while end + 1 < len(pages) and end + 1 - at < max_pages and total + pages[end + 1][1] <= max_mb:
            end += 1
            total += pages[end][1]
        if end < len(pages) - 1:
            cuts = [c for c in range(at + 1, end + 2) if pages[c][2]]
            end = cuts[-1] - 1 if cuts else end
        out.append((len(out), pages[at][0], pages[end][0]))
        at = end + 1
    return out


def test_batches_of_long_documents(spark):
    rng = random.Random(4)
    made = {d: [(p, rng.choice([0.5, 1.0, 4.0, 30.0]), rng.random() < 0.2) for p in range(1, n + 1)] for d, n in (("a", 900), ("b", 1), ("c", 37), ("d", 130))}
    pages = spark.createDataFrame([(d, *p) for d, ps in made.items() for p in ps], "doc string, page bigint, megabytes double, starts_section boolean")
    for most, mb in ((7, 15.0), (1, 15.0), (95, 60.0)):
        got = rows(documents.pack_batches(pages, "doc", max_pages=most, max_mb=mb, bucket_rows=64), "doc", "batch_index", "page_start", "page_end")
        assert got == sorted(((d, *b) for d, ps in made.items() for b in packed(ps, most, mb)), key=repr)


def test_documents_end_in_the_index(spark, small, tmp_path):
    from orepulse.plans.suite_jobs import document_facts, document_texts

    folder, index = str(tmp_path / "job"), str(tmp_path / "index")
    facts, texts = document_facts(spark, small), document_texts(spark, small)
    given = {"facts": Source("1", lambda: facts), "blocks": Source("1", lambda: layout_blocks(spark, small)), "texts": Source("1", lambda: texts)}
    done = vectorise.vectorise_documents(spark, folder, index, **given, doc="doc_id", dimension=32)
    assert done.success, done.stages[-1].error
    counted = spark.read.parquet(done.path("index"))
    assert counted.count() == facts.count() and counted.filter("indexed <> normalised OR failed > 0 OR embedded <> normalised").count() == 0
    assert {r.doc_class for r in counted.collect()} == {"simple", "complex_legal"}
    stored = read_current(spark, index)
    assert {r.extraction_method for r in stored.select("extraction_method").distinct().collect()} == {"layout", "text_single", "text_batch"}
    assert vectorise.vectorise_documents(spark, folder, index, **given, doc="doc_id", dimension=32).made == []


# ---- analysis from states -------------------------------------------------------------------

ANALYSIS = {"source": "source_file", "date": "load_start_time", "entity": "equipment_id", "metrics": list(METRICS)}


def test_states_give_the_same_results_as_the_rows(spark, small):
    fleet = dashboard.analysis_table(tenant_fleet(spark, small), "source_file", "load_start_time", "equipment_id", METRICS)
    blocks = incremental.merged_blocks(incremental.file_states(fleet, "source_file", "load_start_time", "equipment_id", METRICS), METRICS)
    pairs = {
        "statistics": dashboard.tenant_statistics(fleet, METRICS), "outliers": dashboard.tenant_outliers(fleet, METRICS),
        "trends": dashboard.tenant_trends(fleet, "load_start_time", METRICS), "rankings": dashboard.tenant_rankings(fleet, "equipment_id", METRICS[0]),
        "kpis": dashboard.merge_files(dashboard.kpi_findings(fleet, "source_file"), "source_file"),
    }
    for name, direct in pairs.items():
        assert rows(blocks[name], *direct.columns) == rows(direct), name


def test_one_changed_file_is_read_alone(spark, small, tmp_path):
    states, index, ledger = (str(tmp_path / n) for n in ("states", "index", "ledger"))
    fleet = tenant_fleet(spark, small)
    files = tenant_files(spark, small).select("client_id", "source_file", F.lit("s1").alias("signature"))
    asked, kept = [], {"rows": fleet}

    def read(wanted):
        names = rows(wanted)
        asked.append(names)
        return kept["rows"].filter(F.col("source_file").isin([n for n, in names]))

    def run(f):
        return {r.client_id: (r.action, r.indexed) for r in incremental.ingest_analysis(spark, f, ledger, states, index, read, version="v1", processed_at="2024-01-31", dimension=16, **ANALYSIS).collect()}

    first = run(files)
    assert {a for a, _ in first.values()} == {"indexed"} and len(asked[0]) == files.count()
    expected = dashboard.report_texts(dashboard.findings(fleet, "source_file", "load_start_time", "equipment_id", METRICS), dashboard.overview(tenant_files(spark, small)), "2024-01-31")
    assert rows(read_current(spark, index), "chunk_level", "parent_id", "client_id", "section", "kind", "text") == rows(expected, "chunk_level", "parent_id", "client_id", "section", "kind", "text")
    assert read_current(spark, index).filter("(chunk_level = 'child') <> (embedding IS NOT NULL)").count() == 0
    asked.clear()
    assert {a for a, _ in run(files).values()} == {"skipped"} and not asked
    name, client = files.select("source_file", "client_id").orderBy("source_file").first()
    kept["rows"] = fleet.withColumn("payload_tonnes", F.when(F.col("source_file") == name, F.col("payload_tonnes") * 2).otherwise(F.col("payload_tonnes")))
    changed = files.withColumn("signature", F.when(F.col("source_file") == name, "s2").otherwise(F.col("signature")))
    second = run(changed)
    assert asked == [[(name,)]] and {c for c, (a, _) in second.items() if a == "indexed"} == {client}
    whole = incremental.merged_blocks(incremental.file_states(kept["rows"], "source_file", "load_start_time", "equipment_id", METRICS), METRICS)
    merged = incremental.merged_blocks(read_current(spark, states), METRICS)
    assert rows(incremental.report_of(merged, "equipment_id")) == rows(incremental.report_of(whole, "equipment_id"))
    gone = changed.filter(F.col("source_file") != name)
    run(gone.withColumn("signature", F.when(F.col("client_id") == client, "s3").otherwise(F.col("signature"))))
    assert read_current(spark, states).filter(F.col("source_file") == name).count() == 0


def test_report_has_all_blocks(spark, small):
    fleet = dashboard.analysis_table(tenant_fleet(spark, small), "source_file", "load_start_time", "equipment_id", METRICS).withColumn(
        "repair_time_hours", F.when(F.hash("payload_tonnes") % 2 == 0, F.col("repair_time_hours"))
    )
    blocks = incremental.merged_blocks(incremental.file_states(fleet, "source_file", "load_start_time", "equipment_id", METRICS), METRICS)
    failed = spark.createDataFrame([("C1", "C1/broken.csv", "not a table"), ("C9", "C9/broken.csv", "empty")], "client_id string, source_file string, error string")
    reports = {r.client_id: json.loads(r.report) for r in incremental.report_of(blocks, "equipment_id", failed=failed).collect()}
    head = reports["C1"]["overview"]
    assert head["failed_files"] == 1 and head["file_count"] == len(head["files"]) and {f.get("error") for f in head["files"]} == {None, "not a table"}
    assert {q["column"] for q in head["data_quality"]} == {"repair_time_hours"} and all(q["null_pct"] > 10 for q in head["data_quality"])
    assert reports["C9"]["overview"]["total_rows"] == 0 and reports["C9"]["overview"]["failed_files"] == 1
    sections = {s["section"]: s for s in reports["C1"]["sections"]}
    stats = [m for s in sections.values() for m in s["statistics"]]
    assert {m["metric"] for m in stats} == set(METRICS) and all(m["min"] <= m["p25"] <= m["median"] <= m["p75"] <= m["max"] for m in stats)
    assert all({"lower_bound", "upper_bound"} <= set(o) for s in sections.values() for o in s["outliers"])
    charts = [json.loads(c) for s in sections.values() for c in s["charts"]]
    assert sorted({c["chart_type"] for c in charts}) == ["BarChart", "KPICards", "LineChart"] and sum(c["chart_type"] == "LineChart" for c in charts) == len(METRICS)
    assert all(len(m["data"]) >= 3 for s in sections.values() for m in s["series"])


# ---- vector index and retrieval -------------------------------------------------------------


def test_stored_index(spark, small, tmp_path):
    path, vectors, queries = str(tmp_path / "index"), tenant_vectors(spark, small), tenant_queries(spark, small)
    model = learn_index(vectors, 9, parts=8)
    build_index(vectors, model, path, scope="client_id")
    exact = retrieval.nearest(vectors, queries, 10, scope=("client_id", "client_id"))
    whole = search_index(spark, path, model, queries, 10, probes=9, scope="client_id")
    assert rows(whole, "query_id", "rank", "vec_id") == rows(exact, "query_id", "rank", "vec_id")
    some = search_index(spark, path, model, queries, 10, probes=8, candidates=40, scope="client_id")
    found = set(rows(some, "query_id", "vec_id")) & set(rows(exact, "query_id", "vec_id"))
    assert len(found) >= 0.9 * exact.count()
    blocked = search_index(spark, path, model, queries, 10, probes=8, candidates=40, scope="client_id", most_queries=3)
    assert rows(blocked) == rows(some)


def test_only_probed_folders_are_read(spark, small, tmp_path):
    path, vectors = str(tmp_path / "index"), tenant_vectors(spark, small)
    queries = tenant_queries(spark, small).filter("client_id = 'C1'")
    model = learn_index(vectors, 9, parts=8)
    build_index(vectors, model, path, scope="client_id")
    plan = search_index(spark, path, model, queries, 5, probes=2, candidates=20, scope="client_id")
    from orepulse.operators.vector_index import probed_lists

    wanted = {f"scope={r.scope}/list_id={r.list_id}" for r in probed_lists(queries, model, 2, scope="client_id").collect()}
    opened = {"/".join(f.split("/")[-3:-1]) for f in plan.inputFiles()}
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(scope" in text.replace("isnotnull(scope), ", "").replace("PartitionFilters: [isnotnull", "PartitionFilters: [(scope") and plan.count() == 5
    selected = spark.read.schema("vec_id bigint, scope string, list_id int").parquet(path).select(F.input_file_name().alias("f"), "scope", "list_id").distinct().count()
    assert len(wanted) == 2 and selected > 2
    files = _files_read(plan)
    assert 0 < files <= selected * len(wanted) / 9 + 2 * len(wanted) and opened


def _files_read(frame):
    """Files that the scans of an executed plan took, by their own metric."""
    frame.collect()
    total = []

    def walk(node):
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if "QueryStage" in name:
            return walk(node.plan())
        if name.startswith("Scan parquet"):
            total.append(node.metrics().apply("numFiles").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(frame._jdf.queryExecution().executedPlan())
    return max(total)


def test_unusable_vectors_lose_no_hit(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [float("inf"), 1.0]), (4, [float("nan"), 1.0]), (5, [0.0, 0.0]), (6, None), (7, [1.0]), (8, [])], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [float("inf"), 0.0]), (3, [0.0, 0.0]), (4, [0.0, 2.0])], "query_id long, query_vector array<double>")
    for more in ({}, {"max_queries": 1, "rows_per_block": 1}):
        assert rows(retrieval.nearest(vectors, queries, 2, **more), "query_id", "vec_id") == [(1, 1), (1, 2), (4, 1), (4, 2)]
    good, bad = retrieval.split_by_dimension(vectors, "embedding", 2)
    assert rows(good, "vec_id") == [(1,), (2,), (5,)] and bad.count() == 5


def test_many_ties_and_scopes(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-1, 2, (500, 3)).astype(float)
    vectors = spark.createDataFrame([(i, [float(x) for x in v], f"s{i % 4}") for i, v in enumerate(base)], "vec_id long, embedding array<double>, s string").repartition(3)
    asked = [(i, [float(x) for x in base[i * 7]], f"s{i % 5}") for i in range(20)]
    queries = spark.createDataFrame(asked, "query_id long, query_vector array<double>, s string")
    want = []
    norm = np.linalg.norm(base, axis=1)
    for q, v, s in asked:
        if not any(v):
            continue
        own = [i for i in range(500) if norm[i] > 0 and f"s{i % 4}" == s]
        score = {i: round(float(base[i] @ np.array(v) / norm[i] / np.linalg.norm(v)), 9) for i in own}
        want += [(q, i) for i in sorted(own, key=lambda i: (-score[i], i))[:6]]
    for more in ({}, {"max_queries": 3, "rows_per_block": 40}):
        assert rows(retrieval.nearest(vectors, queries, 6, scope=("s", "s"), **more), "query_id", "vec_id") == sorted(want, key=repr)


def indexes(spark, small):
    v = tenant_vectors(spark, small)
    regulatory = v.filter("index = 'regulatory'").select(
        F.concat(F.lit("law"), (F.col("vec_id") % 20).cast("string"), F.lit(".pdf")).alias("source"), F.lit("Title").alias("title"), F.concat(F.lit("body "), "vec_id").alias("body"),
        F.lit(1).alias("page_start"), (F.col("vec_id") % 3 + 1).alias("page_end"), "embedding",
    )
    telemetry_ = v.filter("index = 'telemetry'").select(F.concat("client_id", F.lit("/a.csv")).alias("source"), F.col("vec_id").alias("chunk_index"), F.concat(F.lit("chunk "), "vec_id").alias("text"), "embedding")
    children = v.filter("index = 'analysis'").select("client_id", F.lit("child").alias("chunk_level"), F.concat("client_id", F.lit(":s"), (F.col("vec_id") % 4).cast("string")).alias("parent_id"),
                                                     F.concat(F.lit("s"), (F.col("vec_id") % 4).cast("string")).alias("section"), F.concat(F.lit("finding "), "vec_id").alias("text"), "embedding")
    parents = children.select("client_id", F.lit("parent").alias("chunk_level"), "parent_id", "section").distinct().select(
        "*", F.concat(F.lit("all of "), "parent_id").alias("text"), F.lit(None).cast("array<float>").alias("embedding"), F.lit("a.csv").alias("sources"), F.to_json(F.struct("section")).alias("key_findings"))
    return {"regulatory": lambda: regulatory, "telemetry": lambda: telemetry_, "analysis": lambda: children.unionByName(parents, allowMissingColumns=True)}


def test_retrieval_isolates_tenants_and_failures(spark, small):
    opened, queries = indexes(spark, small), tenant_queries(spark, small)
    odd = queries.filter("query_id < 2").select((F.col("query_id") + 1000).alias("query_id"), F.when(F.col("query_id") % 2 == 0, F.lit("../C1")).alias("client_id"), "query_vector")
    found = retrieve.retrieve(opened, queries.unionByName(odd))
    hits = found.hits.collect()
    assert found.errors == {}
    tenant = {r.query_id: r.client_id for r in queries.collect()}
    assert all(h["index"] == "regulatory" for h in hits if h.query_id >= 1000) and {h.query_id for h in hits if h.query_id >= 1000}
    for h in hits:
        if h["index"] == "telemetry":
            assert h.locator.startswith(f"{tenant[h.query_id]}/a.csv chunk ")
        elif h["index"] == "analysis":
            assert h.text.startswith(f"all of {tenant[h.query_id]}:") and h.locator.startswith("analysis:s") and h.locator.endswith(" (a.csv)") and json.loads(h.findings)
        else:
            assert h.locator.startswith("law") and " p.1-" in h.locator and h.text.startswith("Title\nbody ")
    broken = {**opened, "telemetry": lambda: spark.read.parquet("/nowhere/at/all"), "analysis": lambda: spark.range(1)}
    alone = retrieve.retrieve(broken, queries)
    assert set(alone.errors) == {"telemetry", "analysis"} and {h["index"] for h in alone.hits.collect()} == {"regulatory"}
    with pytest.raises(RuntimeError):
        retrieve.retrieve({"telemetry": broken["telemetry"]}, queries)
    context = retrieve.context_of(found.hits).collect()
    assert all(c.block.startswith(f"[{c.position}] (source: {c.locator})\n") and len(c.preview) <= 300 for c in context)
    assert max(c.position for c in context) == 4


def test_evaluation_matrix(spark):
    docs = "array<struct<index:string>>"
    answers = spark.createDataFrame(
        [("C1", "m", 1, "abc", 1.5, None, [("telemetry",), ("analysis",), ("analysis",)]), ("C1", "m", 1, None, 9.0, "timeout", [("telemetry",)]), ("C2", "m", 1, "", 0.5, None, None)],
        f"client_id string, model string, query_id long, answer string, seconds double, error string, documents {docs}",
    )
    got = {r.client_id: r for r in retrieve.evaluation_matrix(answers).collect()}
    assert (got["C1"].answers, got["C1"].failed, got["C1"].documents, got["C1"].telemetry_hits, got["C1"].analysis_hits, got["C1"].regulatory_hits) == (2, 1, 3, 1, 2, 0)
    assert (got["C1"].answer_chars, got["C1"].mean_seconds, got["C1"].max_seconds, got["C2"].documents) == (3, 5.25, 9.0, 0)


def test_vectors_are_made_once(spark):
    """Whether a vector can be used is read off the vector itself, not from a second run of the embedder."""
    made = spark.createDataFrame([("a", "s1", "ore haul"), ("a", "s2", None), ("b", "s1", "pit")], "doc string, section_id string, body string")
    half = lambda t: F.when(t == "pit", F.array(F.lit(1.0))).when(t.isNotNull(), F.array(F.lit(1.0), F.lit(2.0)))
    found = vectorise._with_vectors(made, "section_id", "body", 2, half, keys=["doc"])
    assert {(r.doc, r.section_id): r.usable for r in found.collect()} == {("a", "s1"): True, ("a", "s2"): False, ("b", "s1"): False}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1
