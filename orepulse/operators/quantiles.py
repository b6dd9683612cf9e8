"""Exact linear-interpolation quantiles of whole columns without gathering a column in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orepulse.operators.scans import ordered_scan

BOUNDED_ROWS = 2_000_000
"""Up to this many rows the built-in exact percentile is used: its value map cannot outgrow this."""

SKETCH_ACCURACY = 10_000
BRACKET_ROWS = 1_000_000


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    *,
    bounded_rows: int = BOUNDED_ROWS,
    accuracy: int = SKETCH_ACCURACY,
    bracket_rows: int = BRACKET_ROWS,
) -> dict[str, list[float | None]]:
    """``{column: [quantile per prob]}``; nulls are skipped, an all-null column gives ``None``.

    Small inputs (counted first) take the built-in ``percentile``. Larger ones take a mergeable sketch
    to bracket the wanted ranks, then count and sort only what lies inside the brackets. Only a few
    numbers per column ever reach the driver.
    """
    values = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])
    if values.count() <= bounded_rows:
        wanted = F.array(*[F.lit(float(p)) for p in probs])
        row = values.agg(*[F.percentile(f"v{i}", wanted).alias(f"q{i}") for i in range(len(columns))]).first()
        return {c: list(row[f"q{i}"] or [None] * len(probs)) for i, c in enumerate(columns)}

    edges = [max(0.0, min(1.0, p + side * 3 / accuracy)) for p in probs for side in (-1, 1)]
    sketch = [F.percentile_approx(f"v{i}", edges, accuracy).alias(f"e{i}") for i in range(len(columns))]
    first = values.agg(*[F.count(f"v{i}").alias(f"n{i}") for i in range(len(columns))], *sketch).first()
    slots, proposed = [], []
    for i in range(len(columns)):
        for j, p in enumerate(probs):
            n = first[f"n{i}"]
            if n:
                slots.append({"col": i, "prob": j, "at": float(p) * (n - 1), "low": -math.inf, "high": math.inf, "below": 0, "rows": n})
                proposed.append((first[f"e{i}"][2 * j], first[f"e{i}"][2 * j + 1]))
    _narrow(values, slots, proposed, accuracy, bracket_rows)
    picked = _pick(values, slots)
    result: dict[str, list[float | None]] = {c: [None] * len(probs) for c in columns}
    for slot_id, slot in enumerate(slots):
        lower, upper = picked[slot_id]
        result[columns[slot["col"]]][slot["prob"]] = lower + (upper - lower) * (slot["at"] - math.floor(slot["at"]))
    return result


def _inside(slot: dict):
    value = F.col(f"v{slot['col']}")
    return value.isNotNull() & (value >= F.lit(slot["low"])) & (value <= F.lit(slot["high"]))


def _narrow(
    values: DataFrame, slots: list[dict], proposed: list[tuple[float, float]], accuracy: int, bracket_rows: int
) -> None:
    """Shrink each slot's [low, high] around its ranks until it holds few rows or a single value.

    A sketch proposes the next bracket and exact counts confirm it, so a bracket always holds its ranks.
    """
    pending = list(slots)
    while pending:
        tried = [{**slot, "low": low, "high": high} for slot, (low, high) in zip(pending, proposed)]
        check = values.agg(
            *[F.count_if(F.col(f"v{t['col']}") < F.lit(t["low"])).alias(f"b{k}") for k, t in enumerate(tried)],
            *[F.count_if(_inside(t)).alias(f"c{k}") for k, t in enumerate(tried)],
        ).first()
        wide = []
        for k, (slot, t) in enumerate(zip(pending, tried)):
            below, rows = check[f"b{k}"], check[f"c{k}"]
            holds = below <= math.floor(slot["at"]) and math.ceil(slot["at"]) < below + rows
            if holds and rows < slot["rows"]:
                slot.update(low=t["low"], high=t["high"], below=below, rows=rows)
                if rows > bracket_rows and slot["low"] < slot["high"]:
                    wide.append(slot)
        pending = wide
        if pending:
            sketches = []
            for k, slot in enumerate(pending):
                share = (slot["at"] - slot["below"]) / max(slot["rows"] - 1, 1)
                edges = [max(0.0, share - 3 / accuracy), min(1.0, share + 3 / accuracy)]
                inside = F.when(_inside(slot), F.col(f"v{slot['col']}"))
                sketches.append(F.percentile_approx(inside, edges, accuracy).alias(f"e{k}"))
            row = values.agg(*sketches).first()
            proposed = [tuple(row[f"e{k}"]) for k in range(len(pending))]


def _pick(values: DataFrame, slots: list[dict]) -> dict[int, tuple[float, float]]:
    """The values at floor and ceiling rank of every slot, from the counted values inside its bracket."""
    if not slots:
        return {}
    tagged = F.array(
        *[
            F.when(_inside(s), F.struct(F.lit(k).alias("slot"), F.col(f"v{s['col']}").alias("value")))
            for k, s in enumerate(slots)
        ]
    )
    counted = (
        values.filter(reduce(lambda a, b: a | b, [_inside(s) for s in slots]))
        .select(F.explode(F.array_compact(tagged)).alias("t"))
        .groupBy("t.slot", "t.value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    upto = F.sum("n").over(Window.partitionBy("slot").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    wanted_low, wanted_high = F.lit(None), F.lit(None)
    for k, s in enumerate(slots):
        wanted_low = F.when(F.col("slot") == k, F.lit(math.floor(s["at"]) - s["below"])).otherwise(wanted_low)
        wanted_high = F.when(F.col("slot") == k, F.lit(math.ceil(s["at"]) - s["below"])).otherwise(wanted_high)
    ranked = counted.withColumn("upto", upto).withColumns({"lo": wanted_low, "hi": wanted_high})
    rows = (
        ranked.groupBy("slot")
        .agg(
            F.min(F.when(F.col("upto") > F.col("lo"), F.col("value"))).alias("lower"),
            F.min(F.when(F.col("upto") > F.col("hi"), F.col("value"))).alias("upper"),
        )
        .collect()
    )
    return {r["slot"]: (r["lower"], r["upper"]) for r in rows}


def grouped_quantiles(
    counted: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], *, bounded_rows: int = BOUNDED_ROWS
) -> DataFrame:
    """``keys`` and an array ``q`` of exact quantiles, from counted values ``(keys, value, n)`` without nulls.

    Few counted rows (checked) take the built-in percentile with frequencies. Otherwise running counts
    come from the block-wise scan, so a group with most of the values is spread over many tasks.
    """
    if counted.count() <= bounded_rows:
        wanted = F.array(*[F.lit(float(p)) for p in probs])
        return counted.groupBy(*keys).agg(F.percentile(value, wanted, F.col("n")).alias("q"))
    totals = counted.groupBy(*keys).agg(F.sum("n").alias("_total"))
    running = ordered_scan(counted.select(*keys, value, "n"), keys, [value], sums={"_upto": F.col("n")}).join(totals, list(keys))
    picks = []
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("_total") - 1)
        picks += [
            F.min(F.when(F.col("_upto") > F.floor(at), F.col(value))).alias(f"_lo{i}"),
            F.min(F.when(F.col("_upto") > F.ceil(at), F.col(value))).alias(f"_hi{i}"),
        ]
    ranked = running.groupBy(*keys, "_total").agg(*picks)
    cells = []
    for i, p in enumerate(probs):
        at = F.lit(float(p)) * (F.col("_total") - 1)
        cells.append(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * (at - F.floor(at)))
    return ranked.select(*keys, F.array(*cells).alias("q"))
