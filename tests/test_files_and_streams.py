"""Sources, sinks, ledger and streaming jobs on small folders."""

import datetime as dt
import os

from pyspark.sql import functions as F

from orepulse.sources import files, ledger, sinks
from orepulse.sources.tables import table
from orepulse.streaming import jobs


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*(columns or df.columns)).collect())


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_csv_listing_and_loading(spark, tmp_path):
    root = str(tmp_path)
    write(f"{root}/C1/fuel.csv", "# exported\nTruck ID,Event Time,Fuel Litres\nT1,2024-01-02 03:04:05,5.5\nT2,bad,7\n")
    write(f"{root}/C1/deep/cycles.CSV", "Truck ID,Tonnes\nT1,90\n")
    write(f"{root}/C2/fuel.csv", "Truck ID\nT9\n")
    write(f"{root}/C2/notes.txt", "x")
    listed = files.list_files(spark, root)
    assert rows(listed, "path") == [("C1/deep/cycles.CSV",), ("C1/fuel.csv",), ("C2/fuel.csv",)]
    assert rows(files.discover_tenants(listed)) == [("C1",), ("C2",)]
    assert rows(files.list_folder(spark, root, "C1")) == [("C1/deep/cycles.CSV",), ("C1/fuel.csv",)]
    before = dict(rows(files.client_signature(listed)))
    write(f"{root}/C2/fuel.csv", "Truck ID\nT9\nT10\n")
    after = dict(rows(files.client_signature(files.list_files(spark, root))))
    assert before["C1"] == after["C1"] and before["C2"] != after["C2"]

    fuel = files.load_csv(spark, f"{root}/C1/fuel.csv", comment="#")
    assert fuel.columns == ["truck_id", "event_time", "fuel_litres"]
    assert rows(fuel, "truck_id", "event_time")[0] == ("T1", dt.datetime(2024, 1, 2, 3, 4, 5)) and rows(fuel)[1][1] is None
    both = files.load_tenant(spark, root, "C1", {"deep/cycles.CSV": "`Truck ID` string, Tonnes double", "fuel.csv": "`Truck ID` string, `Event Time` string, `Fuel Litres` double"})
    assert set(both.columns) == {"truck_id", "tonnes", "event_time", "fuel_litres", "source_file"}


def test_canonical_round_trip(spark, small, tmp_path):
    orders = table(spark, small, "orders").select("o_orderkey", F.when(F.col("o_orderkey") > 5, F.col("o_orderstatus")).alias("s"))
    for as_json in (True, False):
        path = str(tmp_path / f"c{as_json}")
        files.write_canonical(orders, path, as_json=as_json)
        back = files.read_canonical(spark, path, "o_orderkey bigint, s string", as_json=as_json)
        assert rows(back.na.fill("-")) == rows(orders.na.fill("-"))


def test_chunk_lines_round_trip(spark, small, tmp_path):
    from orepulse.plans.suite_text import _documents_of_chunks

    docs = _documents_of_chunks(spark, small).select("chunk_id", "text", "metadata")
    path = str(tmp_path / "chunks")
    docs.write.json(path)
    write(f"{path}/more.json", "\nnot json\n")
    back = files.read_chunks(spark, path)
    assert rows(back, "chunk_id", "text") == rows(docs, "chunk_id", "text")
    assert back.filter("metadata.row_count IS NULL").count() == 0


def test_replace_touches_only_its_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    sinks.overwrite_keys(first, path, "k")
    kept = os.listdir(f"{path}/k=b")
    sinks.overwrite_keys(spark.createDataFrame([("a", 9)], "k string, v int"), path, "k")
    assert rows(spark.read.parquet(path), "k", "v") == [("a", 9), ("b", 3)] and os.listdir(f"{path}/k=b") == kept


def test_counted_write(spark, tmp_path):
    df = spark.range(10).withColumn("v", F.when(F.col("id") > 2, 1))
    counts = sinks.write_counted(df, lambda d: d.write.parquet(str(tmp_path / "w")), "v IS NOT NULL")
    assert counts == {"indexed": 7, "failed": 3} and spark.read.parquet(str(tmp_path / "w")).count() == 7


def test_reports_are_written_per_tenant(spark, tmp_path):
    sinks.write_reports(spark.createDataFrame([("C1", "{}"), ("C2", "{}")], "client_id string, report string"), str(tmp_path / "r"))
    assert sorted(d for d in os.listdir(tmp_path / "r") if "=" in d) == ["client_id=C1", "client_id=C2"]


def test_ledger_truth_table(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert ledger.read_ledger(spark, path).count() == 0
    records = [
        (1, "C1", "same", "s1", "v1", "indexed"), (2, "C1", "changed", "old", "v1", "indexed"), (3, "C2", "version", "s1", "v0", "indexed"),
        (4, "C3", "status", "s1", "v1", "error"), (5, "C4", "healed", "s1", "v1", "error"), (6, "C4", "healed", "s1", "v1", "indexed"),
    ]
    ledger.append_ledger(spark.createDataFrame(records, ledger.LEDGER_SCHEMA), path)
    write(f"{path}/broken.json", "{not json\n\n")
    book = ledger.read_ledger(spark, path)
    now = spark.createDataFrame(
        [("C1", "same", "s1"), ("C1", "changed", "s1"), ("C2", "version", "s1"), ("C3", "status", "s1"), ("C4", "healed", "s1"), ("C5", "absent", "s1")],
        "client_id string, source_file string, signature string",
    )
    assert dict(rows(ledger.stale_files(now, book, "v1"), "source_file", "reason")) == {
        "same": None, "changed": "changed", "version": "version", "status": "status", "healed": None, "absent": "absent",
    }
    assert dict(rows(ledger.stale_clients(now, book, "v1"), "client_id", "stale")) == {"C1": True, "C2": True, "C3": True, "C4": False, "C5": True}
    assert ledger.stale_clients(now, book, "v1", force=True).filter("stale").count() == 5


def event_files(spark, small, folder, parts=2):
    events = table(spark, small, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartitionByRange(parts, "ts").sortWithinPartitions("ts").write.mode("append").parquet(folder)
    return events, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def test_incremental_ingest_is_idempotent(spark, small, tmp_path):
    source, target, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    events, schema = event_files(spark, small, source)
    for _ in range(2):
        jobs.ingest_new_files(jobs.file_stream(spark, source, schema), target, check).awaitTermination()
        assert spark.read.parquet(target).count() == events.count()
    event_files(spark, small, source, 1)
    jobs.ingest_new_files(jobs.file_stream(spark, source, schema), target, check).awaitTermination()
    assert spark.read.parquet(target).count() == 2 * events.count()


def test_replace_stream_writes_ledger_after_success(spark, small, tmp_path):
    source, target, check, book = (str(tmp_path / n) for n in ("in", "out", "check", "book"))
    documents = table(spark, small, "documents").select("doc_id", "source")
    documents.write.parquet(source)

    def records(batch, batch_id):
        return batch.select(
            F.lit(batch_id).cast("bigint").alias("seq"), F.lit("C1").alias("client_id"), F.col("source").alias("source_file"), F.lit("s").alias("content_signature"),
            F.lit("v1").alias("pipeline_version"), F.lit("indexed").alias("status"),
        ).distinct()

    stream = jobs.file_stream(spark, source, "doc_id bigint, source string")
    jobs.replace_by_key_stream(stream, target, "source", check, ledger=book, records=records).awaitTermination()
    assert rows(spark.read.parquet(target), "doc_id", "source") == rows(documents, "doc_id", "source")
    assert ledger.latest_states(ledger.read_ledger(spark, book)).count() == documents.select("source").distinct().count()


def drain(frame, name, mode="append"):
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return frame.sparkSession.table(name)


def test_streamed_aggregates_equal_the_batch(spark, small, tmp_path):
    source = str(tmp_path / "in")
    events, schema = event_files(spark, small, source)
    live = lambda: jobs.file_stream(spark, source, schema)
    hourly = drain(jobs.hourly_mean_stream(live(), "ts", "value"), "hourly", "complete")
    assert rows(hourly) == rows(jobs.hourly_mean_stream(events, "ts", "value"))
    sliding = drain(jobs.sliding_mean_stream(live(), "ts", "value", ["event_type"]), "sliding", "complete")
    assert rows(sliding) == rows(jobs.sliding_mean_stream(events, "ts", "value", ["event_type"]))
    sessions = drain(jobs.activity_sessions(live(), "ts", "user_id", gap="2 hours"), "sessions", "complete")
    assert rows(sessions) == rows(jobs.activity_sessions(events, "ts", "user_id", gap="2 hours"))
    rules = ({"column": "value", "operator": ">", "threshold": 100, "label": "high"},)
    alerts = drain(jobs.threshold_alerts(live().select("event_id", "value"), rules), "alerts")
    assert rows(alerts) == rows(jobs.threshold_alerts(events.select("event_id", "value"), rules))


def test_repeated_events_are_dropped_within_the_watermark(spark, small, tmp_path):
    source = str(tmp_path / "in")
    events, schema = event_files(spark, small, source, 1)
    event_files(spark, small, source, 1)
    once = drain(jobs.without_late_duplicates(jobs.file_stream(spark, source, schema), "ts", ["event_id"], lateness="60 days"), "once")
    assert once.count() == events.count()
