"""Folders of finished work in any store that Spark can open: listing, small marker files, removal."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


def _store(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names directly below a folder, sorted; a missing folder has none."""
    store, place = _store(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(place)) if store.exists(place) else []


def is_there(spark: SparkSession, path: str) -> bool:
    store, place = _store(spark, path)
    return store.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    store, place = _store(spark, path)
    store.delete(place, True)


def put_record(spark: SparkSession, path: str, record: dict) -> None:
    """Write a small JSON file that is either there as a whole or not at all; an existing one is an error."""
    store, place = _store(spark, path)
    aside = place.suffix(".writing")
    out = store.create(aside, True)
    out.write(bytearray(json.dumps(record, sort_keys=True).encode()))
    out.close()
    if store.exists(place) or not store.rename(aside, place):
        raise FileExistsError(path)


def get_record(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])
