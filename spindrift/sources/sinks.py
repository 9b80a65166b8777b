"""Sinks: tables that appear whole or not at all, know what they were made from, and can be resumed.

A published table is a folder of Parquet parts and one small marker file, ``CURRENT``, that names the parts that count, their rows
and the provenance. A part is written beside the others, read again and compared in rows and columns before the marker is
renamed into place; readers go by the marker, so a lost driver or executor leaves the table as it was. Parts that no marker names are
leftovers of broken attempts; the next publication deletes them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MARKER = "CURRENT"


class ProvenanceError(ValueError):
    """The folder holds a table made from other inputs, or a frozen one."""


def _fs(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path


def marker(spark: SparkSession, folder: str) -> dict | None:
    """What the marker of a published table says; null if there is none."""
    fs, path = _fs(spark, folder)
    at = path(f"{folder}/{MARKER}")
    if not fs.exists(at):
        return None
    lines = spark.read.option("wholetext", True).text(f"{folder}/{MARKER}").collect()
    return json.loads(lines[0].value)


def _commit(spark: SparkSession, folder: str, content: dict) -> None:
    fs, path = _fs(spark, folder)
    staged = path(f"{folder}/.{MARKER}-{uuid.uuid4().hex}")
    out = fs.create(staged, True)
    out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(staged.toUri(), spark._jsc.hadoopConfiguration())
    overwrite = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = overwrite
    context.rename(staged, path(f"{folder}/{MARKER}"), options)
    for s in fs.listStatus(path(folder)):
        name = s.getPath().getName()
        if s.isDirectory() and name.startswith("part-") and name not in {p["name"] for p in content["parts"]}:
            fs.delete(s.getPath(), True)


def _staged(df: DataFrame, folder: str) -> dict:
    """Write a part and check it: as many rows as were written, and the same columns."""
    spark, name = df.sparkSession, f"part-{uuid.uuid4().hex}"
    df.write.parquet(f"{folder}/{name}")
    back = spark.read.parquet(f"{folder}/{name}")
    if [(f.name, f.dataType) for f in back.schema] != [(f.name, f.dataType) for f in df.schema]:
        raise OSError(f"{folder}/{name} was not written as it is: {back.schema.simpleString()}")
    return {"name": name, "rows": back.count()}


def publish(df: DataFrame, folder: str, provenance: dict, force: bool = False, frozen: bool = False) -> DataFrame:
    """Replace the table in ``folder`` by ``df`` and give it back as read.

    A table of other provenance is only replaced with ``force``, a frozen one never; the error names what changed."""
    spark = df.sparkSession
    now = marker(spark, folder)
    if now is not None:
        changed = sorted(k for k in {*now["provenance"], *provenance} if now["provenance"].get(k) != provenance.get(k))
        if now["frozen"]:
            raise ProvenanceError(f"{folder} is frozen")
        if changed and not force:
            raise ProvenanceError(f"{folder} was made from other inputs: " + "; ".join(f"{k}: {now['provenance'].get(k)!r} -> {provenance.get(k)!r}" for k in changed))
    _commit(spark, folder, {"parts": [_staged(df, folder)], "provenance": provenance, "frozen": frozen, "schema": df.schema.json()})
    return read_published(spark, folder)


def read_published(spark: SparkSession, folder: str) -> DataFrame:
    """The table that the marker names; raises if there is none or a part has lost rows."""
    from pyspark.sql.types import StructType

    now = marker(spark, folder)
    if now is None:
        raise FileNotFoundError(f"{folder} holds no published table")
    schema = StructType.fromJson(json.loads(now["schema"]))
    return spark.read.schema(schema).parquet(*(f"{folder}/{p['name']}" for p in now["parts"]))


def validate(spark: SparkSession, folder: str) -> bool:
    """Whether a published table is there with all the rows that its marker promises."""
    now = marker(spark, folder)
    return now is not None and all(spark.read.parquet(f"{folder}/{p['name']}").count() == p["rows"] for p in now["parts"])


def resume(todo: DataFrame, folder: str, keys: list[str], work: Callable[[DataFrame], DataFrame], provenance: dict) -> DataFrame:
    """``work`` of the rows of ``todo`` whose keys the published table lacks, appended as one part; the whole table.

    The first call publishes all; a call after a break, or with more rows, computes what is missing, by an anti-join on the keys;
    one with nothing to do writes nothing. Other provenance raises."""
    spark = todo.sparkSession
    now = marker(spark, folder)
    if now is None:
        return publish(work(todo), folder, provenance)
    if now["provenance"] != provenance:
        raise ProvenanceError(f"{folder} was made from other inputs: {now['provenance']} -> {provenance}")
    left = todo.join(read_published(spark, folder).select(*keys).distinct(), keys, "left_anti")
    if left.limit(1).count():
        _commit(spark, folder, {**now, "parts": [*now["parts"], _staged(work(left), folder)]})
    return read_published(spark, folder)
