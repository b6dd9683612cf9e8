"""CSV files read by several tasks against Spark's reader with one task per file."""

import os
import random

import pytest

from orepulse.sources.split_csv import CORRUPT, ends_quoted, line_states, block_states, read_csv, records_of


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="") as f:
        f.write(text)


def test_line_ends():
    for line, quoted, after in [
        ("a,b", False, False), ('"a,b', False, True), ('a,"b', False, True), ('a,"b""', False, True), ('a,"b"""', False, False), ('x"y,z', False, False),
        ("a,b", True, True), ('a",b', True, False), ('a"",b', True, True), ('a","b', True, True), ('a","b"', True, False), ("", True, True), ("", False, False),
        ('"a"b"c,d', False, False), ('"a"b,"c', False, True), ('5" pipe,"6', False, True), (',,"', False, True), ('""', False, False), ('"",""""', False, False),
    ]:
        assert ends_quoted(line, quoted) == after, (line, quoted)


def field(rng):
    kind = rng.randrange(7)
    words = ["ore", "haul", "é漢", "5.2", "x y", ""]
    if kind < 3:
        return rng.choice(words)
    inside = "".join(rng.choice(["a", ",", '""', "\n", "\n\n", "#", "b c", "é", "\n# not a comment\n"]) for _ in range(rng.randrange(6)))
    return f'"{inside}"'


@pytest.mark.parametrize("size", ["400", "4m"])
def test_equals_the_one_task_reader(spark, tmp_path, size):
    rng = random.Random(5)
    for name in ("a", "b"):
        lines = ["id,first note,second"] + [f"{i},{field(rng)},{field(rng)}" for i in range(150)]
        write(f"{tmp_path}/in/{name}.csv", "\n".join(lines) + rng.choice(["", "\n"]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        schema = "id int, first_note string, second string"
        mine = read_csv(spark, f"{tmp_path}/in", schema=schema).cache()
        blocks = records_of(spark, f"{tmp_path}/in").select("file").distinct().count()
        one = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(schema).csv(f"{tmp_path}/in")
        assert blocks == 2 and mine.filter(f"{CORRUPT} IS NOT NULL").count() == 0
        key = lambda df: sorted(map(tuple, df.select("id", "first_note", "second").collect()), key=repr)
        assert key(mine) == key(one) and mine.count() == 300
        named = read_csv(spark, f"{tmp_path}/in")
        assert named.columns == ["id", "first_note", "second", CORRUPT, "source_file"] and named.count() == 300
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_blocks_of_one_file_are_several(spark, tmp_path):
    write(f"{tmp_path}/in/a.csv", "id,t\n" + "".join(f'{i},"{"line" * 5}\n{"x" * 30}"\n' for i in range(60)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        from pyspark.sql import functions as F

        lines = spark.read.option("lineSep", "\n").text(f"{tmp_path}/in").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
        found = block_states(line_states(lines).drop("line")).orderBy("block").collect()
        assert len(found) > 20 and {r.quoted for r in found} == {True, False} and found[0].before == 0
        assert read_csv(spark, f"{tmp_path}/in").filter("t LIKE '%\n%'").count() == 60
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_corrupt_records_are_kept(spark, tmp_path):
    text = '# exported\nId,Value,Note\r\n1,2.5,"two\r\nlines"\r\n\r\n# note, "with quote\n2,bad,x\n3,1.5\n4,1,a,b\n5,6.5,"never closed\nto the end\n'
    write(f"{tmp_path}/in/a.csv", text)
    schema = "id int, value double, note string"
    found = {r.id if r.whole is None else r.id: r for r in read_csv(spark, f"{tmp_path}/in", schema=schema, comment="#").selectExpr("*", "CAST(NULL AS BOOLEAN) AS whole").collect()}
    rows = read_csv(spark, f"{tmp_path}/in", schema=schema, comment="#").collect()
    assert len(rows) == 5 and found[1].note == "two\r\nlines" and found[1][CORRUPT] is None
    bad = {r[CORRUPT] for r in rows if r[CORRUPT] is not None}
    assert bad == {"2,bad,x", "3,1.5", "4,1,a,b", '5,6.5,"never closed\nto the end\n'} or bad == {"2,bad,x", "3,1.5", "4,1,a,b", '5,6.5,"never closed\nto the end'}
    loose = [r[CORRUPT] for r in read_csv(spark, f"{tmp_path}/in", schema=schema, comment="#", most_lines=1).collect() if r[CORRUPT] is not None]
    assert '5,6.5,"never closed' in loose and "to the end" in loose
    write(f"{tmp_path}/none/a.csv", "\n\n")
    assert read_csv(spark, f"{tmp_path}/none").count() == 0


def test_records_within_a_block_are_not_shuffled(spark, tmp_path):
    """Only the records at block borders are gathered by their number; the others are put together where they are read."""
    write(f"{tmp_path}/in/a.csv", "id,t\n" + "".join(f'{i},"line\n\n{"x" * (i % 40)}\r\nend"\r\n' for i in range(400)) + '400,"left open\nto the end\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        records = records_of(spark, f"{tmp_path}/in")
        plan = records._jdf.queryExecution().optimizedPlan().toString()
        assert "line_states" not in plan and "MapInArrow" not in plan  # read from what was written once
        got = {r.record_no: (r.record, r.whole) for r in records.collect()}
        want = {i + 2: (f'{i},"line\n\n{"x" * (i % 40)}\r\nend"', True) for i in range(400)} | {1: ("id,t", True)}
        last = got.pop(402)
        assert got == want and last[0].startswith('400,"left open\nto the end') and not last[1]
        for most in (3, 4):
            whole = [r for r in records_of(spark, f"{tmp_path}/in", most_lines=most).collect() if r.whole]
            assert len(whole) == (1 if most == 3 else 401)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
