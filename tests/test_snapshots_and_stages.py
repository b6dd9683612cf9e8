"""Tables replaced by key in one step, and jobs that resume."""

import os

import pytest
from pyspark.sql import functions as F

from orepulse.plans.stages import Source, Stage, run_stages
from orepulse.sources import snapshots
from orepulse.sources.snapshots import clean_up, commit_runs, latest_version, read_current, replace_keys, stage_rows, staged_runs


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def frame(spark, *given):
    return spark.createDataFrame(list(given), "k string, v int")


def test_replace_is_one_step(spark, tmp_path):
    path = str(tmp_path / "t")
    assert latest_version(spark, path) == 0
    assert replace_keys(frame(spark, ("a", 1), ("a", 2), ("b", 3), (None, 4)), path, "k") == 1
    before = read_current(spark, path)
    assert replace_keys(frame(spark, ("a", 9)), path, "k") == 2
    assert rows(read_current(spark, path)) == rows(frame(spark, ("a", 9), ("b", 3), (None, 4)))
    assert rows(before) == rows(read_current(spark, path, 1))  # a reader that began before sees what it began with
    replace_keys(frame(spark, (None, 5)), path, "k", clear=spark.createDataFrame([("b",)], "k string"))
    assert rows(read_current(spark, path)) == rows(frame(spark, ("a", 9), (None, 5)))
    with pytest.raises(ValueError):
        replace_keys(frame(spark, ("a", 9)), path, "v")
    with pytest.raises(ValueError):
        replace_keys(frame(spark, ("a", 9)).withColumn("w", F.lit(1)), path, "k")


def test_a_writer_that_dies_leaves_the_old_rows(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    replace_keys(frame(spark, ("a", 1), ("b", 2)), path, "k")
    stage_rows(frame(spark, ("a", 7)), path, "k", "dead")  # rows are complete, but the writer died before the switch
    assert rows(read_current(spark, path)) == [("a", 1), ("b", 2)] and "dead" in staged_runs(spark, path)
    os.makedirs(f"{path}/versions/v=000000002")  # and another one while it wrote the new version
    with open(f"{path}/versions/v=000000002/part-0.parquet", "wb") as half:
        half.write(b"PAR1")
    assert latest_version(spark, path) == 1 and rows(read_current(spark, path)) == [("a", 1), ("b", 2)]
    assert commit_runs(spark, path, ["dead"]) == 2
    assert rows(read_current(spark, path)) == [("a", 7), ("b", 2)]


def test_large_versions_are_joined_by_a_shuffle(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    replace_keys(frame(spark, *[(str(i), i) for i in range(50)]), path, "k")
    replace_keys(frame(spark, *[(str(i), -i) for i in range(0, 50, 3)]), path, "k")
    expected = rows(read_current(spark, path))
    monkeypatch.setattr(snapshots, "MOST_BROADCAST", 5)
    assert rows(read_current(spark, path)) == expected and len(expected) == 50


def test_clean_up_keeps_what_is_read(spark, tmp_path):
    path = str(tmp_path / "t")
    for i in range(4):
        replace_keys(frame(spark, ("a", i), (f"only{i}", i)), path, "k")
    stage_rows(frame(spark, ("z", 1)), path, "k", "waiting")
    expected = rows(read_current(spark, path))
    assert clean_up(spark, path, keep=1) == []  # every run still holds one key
    replace_keys(frame(spark, *[(f"only{i}", 9) for i in range(4)], ("a", 9)), path, "k")
    assert len(clean_up(spark, path, keep=1)) == 4 and rows(read_current(spark, path)) != expected
    assert len(rows(read_current(spark, path))) == 5 and "waiting" in staged_runs(spark, path)


def chain(spark, log, broken=()):
    def work(name, add):
        def run(*given):
            log.append(name)
            if name in broken:
                raise RuntimeError(f"{name} broke")
            return given[0].withColumn("v", F.col("v") + add)

        return run

    return [
        Stage("one", work("one", 1), ("source",)), Stage("two", work("two", 10), ("one",), settings={"add": 10}),
        Stage("three", work("three", 100), ("two", "one")),
    ]


def source(spark, log, signature="s1"):
    def read():
        log.append("read")
        return spark.createDataFrame([("a", 0), ("b", 0)], "k string, v int")

    return {"source": Source(signature, read)}


def test_stages_are_not_repeated(spark, tmp_path):
    log, folder = [], str(tmp_path / "job")
    done = run_stages(spark, folder, source(spark, log), chain(spark, log))
    assert done.success and done.made == ["one", "two", "three"] and log == ["read", "one", "two", "three"]
    assert rows(spark.read.parquet(done.path("three"))) == [("a", 111), ("b", 111)] and done.rows("three") == 2
    log.clear()
    again = run_stages(spark, folder, source(spark, log), chain(spark, log))
    assert log == [] and again.made == [] and again.path("three") == done.path("three") and again.rows("two") == 2
    forced = run_stages(spark, folder, source(spark, log), chain(spark, log), force=["two"])
    assert log == ["two", "three"] and forced.made == ["two", "three"] and forced.path("two") != done.path("two")
    log.clear()
    changed = chain(spark, log)
    changed[1] = Stage("two", changed[1].work, ("one",), settings={"add": 11})
    assert run_stages(spark, folder, source(spark, log), changed).made == ["two", "three"]
    log.clear()
    assert run_stages(spark, folder, source(spark, log, "s2"), chain(spark, log)).made == ["one", "two", "three"]
    log.clear()
    assert run_stages(spark, folder, source(spark, log, "s2"), chain(spark, log), force=True, only=["three"]).made == ["three"] and log == ["three"]
    missing = run_stages(spark, folder, source(spark, log, "s3"), chain(spark, log), only=["three"])
    assert not missing.success and "no result" in missing.stages[-1].error


def test_a_job_resumes_where_it_died(spark, tmp_path, monkeypatch):
    log, folder = [], str(tmp_path / "job")
    failed = run_stages(spark, folder, source(spark, log), chain(spark, log, broken=("two",)))
    assert not failed.success and [s.status for s in failed.stages] == ["made", "failed"] and "two broke" in failed.stages[-1].error
    log.clear()
    assert run_stages(spark, folder, source(spark, log), chain(spark, log)).made == ["two", "three"] and log == ["two", "three"]

    from orepulse.plans import stages

    def dies(*_):
        raise KeyboardInterrupt

    log.clear()
    monkeypatch.setattr(stages, "put_record", dies)  # rows of "one" are written, its record is not
    with pytest.raises(KeyboardInterrupt):
        run_stages(spark, folder, source(spark, log, "s2"), chain(spark, log))
    monkeypatch.undo()
    log.clear()
    assert run_stages(spark, folder, source(spark, log, "s2"), chain(spark, log)).made == ["one", "two", "three"]


def test_a_stream_replaces_keys_in_one_step(spark, tmp_path, monkeypatch):
    from orepulse.sources.ledger import LEDGER_SCHEMA, read_ledger
    from orepulse.streaming import jobs

    source, target, check, ledger = (str(tmp_path / n) for n in ("in", "table", "check", "ledger"))

    def arrive(*given):
        frame(spark, *given).coalesce(1).write.mode("append").parquet(source)

    def records(done):
        keys = done.groupBy("k").agg(F.sum("v").alias("s"))
        return keys.selectExpr("s AS seq", "'C1' AS client_id", "k AS source_file", "'x' AS content_signature", "'v1' AS pipeline_version", "'indexed' AS status").select(*[c.split()[0] for c in LEDGER_SCHEMA.split(", ")])

    def run():
        stream = jobs.file_stream(spark, source, "k string, v int", per_trigger=1)
        return jobs.refresh_keys(stream, target, "k", check, ledger=ledger, records=records)

    arrive(("a", 1)), arrive(("a", 2), ("b", 3)), arrive(("c", 4))
    assert len(run()) == 3 and latest_version(spark, target) == 1  # three batches, one step
    assert rows(read_current(spark, target)) == [("a", 1), ("a", 2), ("b", 3), ("c", 4)]
    assert run() == [] and latest_version(spark, target) == 1 and read_ledger(spark, ledger).count() == 3
    arrive(("a", 10))
    with monkeypatch.context() as patch:
        def dies(*_, **__):
            raise KeyboardInterrupt

        patch.setattr(snapshots, "commit_runs", dies)  # between the staged rows and the switch
        with pytest.raises(KeyboardInterrupt):
            run()
    assert rows(read_current(spark, target))[:2] == [("a", 1), ("a", 2)]
    arrive(("a", 20), ("d", 5))
    assert len(run()) == 2 and rows(read_current(spark, target)) == [("a", 10), ("a", 20), ("b", 3), ("c", 4), ("d", 5)]
    assert rows(read_ledger(spark, ledger).filter("source_file = 'a'").select("seq")) == [(3,), (30,)]
