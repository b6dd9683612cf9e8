"""CSV files with quoted line breaks, read by many tasks per file.

Whether a line begins a record depends on the quotes before it. Each block of a file works out both cases at once: what holds if the block
begins inside a quoted field, and what if it does not. The blocks' outcomes are combined in file order (a block either fixes the state, keeps
it or turns it round), which gives every line its state and its record. Lines of records that span several are then put together, all
others are parsed where they are.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orepulse.operators.reshape import header_name
from orepulse.session import checkpoint_cut

MOST_LINES = 100_000  # lines of one record; a longer one has lost its closing quote and is given line by line as corrupt
CORRUPT = "_corrupt_record"


def ends_quoted(line: str, quoted: bool, separator: str = ",") -> bool:
    """Whether the end of a line lies inside a quoted field; ``quoted`` says whether its start does.

    A quote opens a field only where the field begins and is closed by a quote that is not doubled; after that the field goes on, as it
    is, to its separator.
    """
    at = 0
    while True:
        if quoted:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('"', at + 1):
                at += 2
                continue
            quoted = False
        elif line.startswith('"', at):
            quoted, at = True, at + 1
            continue
        at = line.find(separator, at)
        if at < 0:
            return False
        at += len(separator)


def line_states(lines: DataFrame, separator: str = ",", comment: str | None = None) -> DataFrame:
    """``file, block, line_no, line`` of every line, and for both states at the start of its block: whether it starts inside a quoted
    field (``in0, in1``), whether it ends inside one (``out0, out1``) and how many records began in the block up to it (``rec0, rec1``).

    ``lines``: ``file, block, line`` in the order of the file within a task. Comment lines and blank lines between records begin none.
    """

    names = ("line_no", "in0", "in1", "out0", "out1", "rec0", "rec1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, number, states, records = None, 0, (False, True), (0, 0)
        for batch in batches:
            files, blocks, texts = batch.column("file").to_pylist(), batch.column("block").to_pylist(), batch.column("line")
            plain = pc.invert(pc.match_substring(texts, '"'))
            if comment is not None:
                plain = pc.and_(plain, pc.invert(pc.starts_with(texts, comment)))
            plain = plain.to_numpy(zero_copy_only=False)
            filled = pc.greater(pc.utf8_length(pc.utf8_trim_whitespace(texts)), 0).to_numpy(zero_copy_only=False)
            n = len(batch)
            borders = [i for i in range(1, n) if files[i] != files[i - 1] or blocks[i] != blocks[i - 1]]
            marked = deque(np.flatnonzero(~plain).tolist())
            rows = {c: np.zeros(n, np.int64 if c in ("line_no", "rec0", "rec1") else bool) for c in names}
            for first, stop in zip([0, *borders], [*borders, n]):
                if (files[first], blocks[first]) != place:
                    place, number, states, records = (files[first], blocks[first]), 0, (False, True), (0, 0)
                at = first
                while at < stop:  # runs of lines without quotes, and one line with quotes after each
                    some = marked[0] if marked else stop
                    end = min(some, stop)
                    if end > at:
                        upto = np.cumsum(filled[at:end])
                        for case in (0, 1):
                            rows[f"in{case}"][at:end] = rows[f"out{case}"][at:end] = states[case]
                            rows[f"rec{case}"][at:end] = records[case] + (0 if states[case] else upto)
                        records = tuple(int(rows[f"rec{case}"][end - 1]) for case in (0, 1))
                        at = end
                    if at < stop:
                        text, after, counted = texts[at].as_py(), [], []
                        for case in (0, 1):
                            skipped = not states[case] and (not filled[at] or (comment is not None and text.startswith(comment)))
                            after.append(states[case] if skipped else ends_quoted(text, states[case], separator))
                            counted.append(records[case] + (not states[case] and not skipped))
                            rows[f"in{case}"][at], rows[f"out{case}"][at], rows[f"rec{case}"][at] = states[case], after[case], counted[case]
                        states, records, at = tuple(after), tuple(counted), at + 1
                    while marked and marked[0] < at:
                        marked.popleft()
                rows["line_no"][first:stop] = number + np.arange(stop - first)
                number += stop - first
            columns = [batch.column(c) for c in ("file", "block", "line")] + [pa.array(rows[c]) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names=["file", "block", "line", *names])

    made = "file string, block bigint, line string, line_no bigint, in0 boolean, in1 boolean, out0 boolean, out1 boolean, rec0 bigint, rec1 bigint"
    return lines.mapInArrow(run, made)


def block_states(states: DataFrame) -> DataFrame:
    """``file, block, quoted, before``: per block whether it starts inside a quoted field and how many records began before it."""
    last = [F.max_by(c, "line_no").alias(c) for c in ("out0", "out1")] + [F.max(c).alias(c) for c in ("rec0", "rec1")]  # counts only grow
    ends = states.groupBy("file", "block").agg(*last)
    order = Window.partitionBy("file").orderBy("block")  # one row per block of a file
    fixed, turned = F.col("out0") == F.col("out1"), F.col("out0") & ~F.col("out1")
    turns = ends.withColumn("turns", F.sum(turned.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    odd = F.col("turns") % 2 == 1
    seen = turns.withColumn("base", F.when(fixed, F.col("out0") != odd))
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.last("base", ignorenulls=True).over(upto), F.lit(False))
    odd_before = F.coalesce(F.lag("turns").over(order), F.lit(0)) % 2 == 1
    known = seen.withColumn("quoted", base != odd_before)
    begun = F.when(F.col("quoted"), F.col("rec1")).otherwise(F.col("rec0"))
    return known.withColumn("before", F.coalesce(F.sum(begun).over(upto), F.lit(0))).select("file", "block", "quoted", "before")


def joined_lines(placed: DataFrame, most_lines: int = MOST_LINES) -> DataFrame:
    """Records that lie within one block as ``file, record_no, record`` rows, and the lines of all others with ``piece`` true.

    ``placed``: ``file, block, line_no, line, starts_in, ends_in, record_no`` in the order of the file within a task. A task holds the lines
    of one record, at most ``most_lines``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, open_piece = None, [], False  # held: lines of a record that began in this block; open_piece: its lines go out one by one

        def rows(file, block, found):
            numbers, texts, ends, line_nos, pieces = map(list, zip(*found)) if found else ([],) * 5
            n = len(numbers)
            made = [pa.array([file] * n, pa.string()), pa.array([block] * n, pa.int64()), pa.array(line_nos, pa.int64()), pa.array(numbers, pa.int64())]
            made += [pa.array(texts, pa.string()), pa.array(ends, pa.bool_()), pa.array(pieces, pa.bool_())]
            return pa.RecordBatch.from_arrays(made, names=["file", "block", "line_no", "record_no", "record", "ends_in", "piece"])

        def loose():
            return [(*line, True) for line in held]

        for batch in batches:
            files, blocks = batch.column("file").to_pylist(), batch.column("block").to_pylist()
            n = len(batch)
            borders = [i for i in range(1, n) if files[i] != files[i - 1] or blocks[i] != blocks[i - 1]]
            for first, stop in zip([0, *borders], [*borders, n]):
                if (files[first], blocks[first]) != place:
                    if held:
                        yield rows(*place, loose())
                    place, held, open_piece = (files[first], blocks[first]), [], True  # what the block begins with may have begun before it
                part = batch.slice(first, stop - first)
                columns = [part.column(c).to_pylist() for c in ("record_no", "line", "ends_in", "line_no", "starts_in")]
                found = []
                for number, text, ends, line_no, starts in zip(*columns):
                    line = (number, text, ends, line_no)
                    if not starts:
                        held, open_piece = [], False
                        if not ends:
                            found.append((*line, False))
                            continue
                    if open_piece:
                        found.append((*line, True))
                        continue
                    held.append(line)
                    if len(held) > most_lines:
                        found += loose()
                        held, open_piece = [], True
                    elif not ends:
                        found.append((number, "\n".join(x[1] for x in held), False, line_no, False))
                        held = []
                yield rows(*place, found)
        if held:
            yield rows(*place, loose())

    return placed.mapInArrow(run, "file string, block bigint, line_no bigint, record_no bigint, record string, ends_in boolean, piece boolean")


def records_of(spark: SparkSession, path: str, separator: str = ",", comment: str | None = None, most_lines: int = MOST_LINES) -> DataFrame:
    """``file, record_no, record, whole`` of the CSV files below ``path``, in any number of tasks per file; numbers start at 1 per file.

    ``whole`` is false for the lines of a record that never ends within ``most_lines``. The files are read twice: for the state at the start
    of every block (one row per block, sent to the tasks), and for the records. Only records that cross a block border, or have too many
    lines, are shuffled.
    """
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line")
    )
    states = line_states(lines, separator, comment)
    blocks = block_states(states.drop("line")).select(F.col("file").alias("f"), F.col("block").alias("b"), "quoted", "before")
    here = states.join(F.broadcast(blocks), (F.col("file") == F.col("f")) & (F.col("block") == F.col("b")), "left")  # keeps the order of the lines
    known = F.when(F.col("quoted").isNull(), F.raise_error(F.lit("the files changed while they were read"))).otherwise(F.col("quoted"))
    pick = lambda name: F.when(known, F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    placed = here.select(
        "file", "block", "line_no", "line", pick("in").alias("starts_in"), pick("out").alias("ends_in"), (F.col("before") + pick("rec")).alias("record_no")
    )
    blank = ~F.col("starts_in") & ((F.trim("line") == "") | (F.trim("line") == "\r"))
    if comment:
        blank = blank | (~F.col("starts_in") & F.col("line").startswith(comment))
    found = checkpoint_cut(joined_lines(placed.filter(~blank), most_lines), codec="zstd")
    ended = lambda text: F.regexp_replace(text, "\r$", "").alias("record")
    inside = found.filter("NOT piece").select("file", "record_no", ended("record"), F.lit(True).alias("whole"))
    parts = found.filter("piece").withColumnRenamed("record", "line")
    sizes = parts.groupBy("file", "record_no").agg(F.count(F.lit(1)).alias("n"))
    sized = parts.join(sizes, ["file", "record_no"])
    joined = sized.filter(F.col("n") <= most_lines).groupBy("file", "record_no").agg(F.array_sort(F.collect_list(F.struct("block", "line_no", "line", "ends_in"))).alias("l"))
    whole = ~F.element_at("l", -1)["ends_in"]
    text = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    joined = joined.select("file", "record_no", ended(text), whole.alias("whole"))
    loose = sized.filter(F.col("n") > most_lines).select("file", "record_no", F.col("line").alias("record"), F.lit(False).alias("whole"))
    return inside.unionByName(joined).unionByName(loose)


def read_csv(
    spark: SparkSession, path: str, *, schema: T.StructType | str | None = None, separator: str = ",", comment: str | None = None,
    most_lines: int = MOST_LINES,
) -> DataFrame:
    """CSV with a header row per file, quoted line breaks allowed: the columns, ``_corrupt_record`` and ``source_file``.

    All files share the columns of the first one unless ``schema`` names them; without it all columns are text. A record that does not fit
    the schema (too many or too few fields, a value of another type, a quote that is never closed) is kept as it is in
    ``_corrupt_record``. Within a file the header is the first record that is neither blank nor a comment.
    """
    records = records_of(spark, path, separator, comment, most_lines)
    options = {"sep": separator, "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "multiLine": "true"}
    if schema is None:
        first = records.filter("record_no = 1").orderBy("file").first()
        if first is None:
            return spark.createDataFrame([], f"{CORRUPT} string, source_file string")
        line = spark.createDataFrame([(first["record"],)], "record string")
        wide = ", ".join(f"c{i} string" for i in range(first["record"].count(separator) + 1))
        cells = line.select(F.from_csv("record", wide, {k: v for k, v in options.items() if k != "columnNameOfCorruptRecord"}).alias("c")).first()["c"]
        named = [header_name(str(n)) for n in cells if n is not None]
        schema = T.StructType([T.StructField(n, T.StringType()) for n in named])
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    body = records.filter("record_no > 1")
    parsed = body.select("file", "record", "whole", F.from_csv("record", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in full), options).alias("c"))
    cells = [F.when(F.col("whole"), F.col(f"c.{f.name}")).alias(f.name) for f in schema.fields]
    corrupt = F.when(F.col("whole"), F.col(f"c.{CORRUPT}")).otherwise(F.col("record")).alias(CORRUPT)
    return parsed.select(*cells, corrupt, F.col("file").alias("source_file"))
