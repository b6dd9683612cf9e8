"""Resumable jobs: stages that keep what they made and are not run again for the same input.

A stage is named work over the results of earlier stages or sources. Its key is a digest of its name, its version, its settings and the
keys of what it reads, so a new file, a new setting or new code gives a new key, here and in all later stages. A result counts when the
record beside it is written, after its rows are complete; a job that died resumes at its first stage without a record.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Collection, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from orepulse.session import passing_cuts
from orepulse.sources.folders import get_record, names_in, put_record


@dataclass(frozen=True)
class Stage:
    """``work`` gets the frames of ``needs`` in their order and returns a frame."""

    name: str
    work: Callable[..., DataFrame]
    needs: tuple[str, ...]
    version: str = "1"
    settings: Mapping = field(default_factory=dict)


@dataclass(frozen=True)
class Source:
    """Input of a job; ``signature`` changes when its rows do, and ``read`` is called only if a stage has to run."""

    signature: str
    read: Callable[[], DataFrame]


@dataclass
class StageResult:
    name: str
    status: str  # "made", "kept" or "failed"
    key: str
    path: str | None = None
    rows: int | None = None
    seconds: float = 0.0
    error: str | None = None


@dataclass
class JobResult:
    stages: list[StageResult]

    @property
    def success(self) -> bool:
        return all(s.status != "failed" for s in self.stages)

    @property
    def made(self) -> list[str]:
        return [s.name for s in self.stages if s.status == "made"]

    def path(self, name: str) -> str:
        return next(s.path for s in self.stages if s.name == name)

    def rows(self, name: str) -> int:
        return next(s.rows for s in self.stages if s.name == name)


def digest(*parts: object) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:24]


def kept_result(spark: SparkSession, folder: str, key: str) -> dict | None:
    """The newest record of a stage's result, if it has one."""
    records = [n for n in names_in(spark, folder) if n.startswith(key) and n.endswith(".json")]
    return get_record(spark, f"{folder}/{records[-1]}") if records else None


def run_stages(
    spark: SparkSession, folder: str, sources: Mapping[str, Source], stages: Sequence[Stage], *, force: bool | Collection[str] = False,
    only: Collection[str] | None = None,
) -> JobResult:
    """Run what has no result yet, below ``folder``, and say what was made and what was kept.

    ``force`` makes all stages (or the named ones) anew, and with them all that read their results; ``only`` leaves the other stages as
    they are, which must then have results if one of these reads them. A failed stage ends the job; its error is in the result.
    """
    keys = {name: digest("source", name, s.signature) for name, s in sources.items()}
    results: dict[str, StageResult] = {}
    renewed: set[str] = set()
    opened: dict[str, DataFrame] = {}

    def frame(name: str) -> DataFrame:
        if name in sources:
            if name not in opened:
                opened[name] = sources[name].read()
            return opened[name]
        if results[name].path is None:
            raise ValueError(f"stage '{name}' has no result")
        return spark.read.parquet(results[name].path)

    for stage in stages:
        key = keys[stage.name] = digest(stage.name, stage.version, dict(stage.settings), [keys[n] for n in stage.needs])
        place = f"{folder}/{stage.name}"
        kept = kept_result(spark, place, key)
        wanted = only is None or stage.name in only
        forced = wanted and ((force if isinstance(force, bool) else stage.name in force) or any(n in renewed for n in stage.needs))
        if (kept and not forced) or not wanted:
            results[stage.name] = StageResult(stage.name, "kept", key, kept and kept["path"], kept and kept["rows"])
            continue
        began = time.time()
        attempt = sum(n.startswith(key) and n.endswith(".json") for n in names_in(spark, place))
        path = f"{place}/{key}-{attempt:06d}"
        counted = Observation()
        try:
            given = [frame(n) for n in stage.needs]  # what is read for later stages too is read outside of this one
            with passing_cuts(spark):
                rows = stage.work(*given).observe(counted, F.count(F.lit(1)).alias("rows"))
                rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
            made = {"path": path, "rows": counted.get["rows"], "needs": {n: keys[n] for n in stage.needs}, "version": stage.version, "settings": dict(stage.settings)}
            put_record(spark, f"{path}.json", made)
        except Exception as error:  # noqa: BLE001 - the job's result names it
            results[stage.name] = StageResult(stage.name, "failed", key, seconds=time.time() - began, error=f"{type(error).__name__}: {error}")
            break
        renewed.add(stage.name)
        results[stage.name] = StageResult(stage.name, "made", key, path, made["rows"], time.time() - began)
    return JobResult(list(results.values()))
