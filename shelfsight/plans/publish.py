"""All outputs of a run, published together.

A run writes each output to a folder of its own and ends with a manifest (one
line per output: name, folder, rows, columns). Readers start from the pointer
file, which names the newest complete run and is replaced in one rename, so
they see all outputs of a run or none of them: a run that fails on the way, or
whose executors are lost for good, leaves the former run in place.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsight.plans.execution import drop_tables
from shelfsight.sources import writers as wr

POINTER = "CURRENT"


class Unpublished(LookupError):
    """The folder holds no published run."""


def _fs(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop
    p = hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file: written beside it, then renamed over it."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop
    fs, target = _fs(spark, path)
    _, draft = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    replace = spark.sparkContext._gateway.new_array(hadoop.fs.Options.Rename, 1)
    replace[0] = hadoop.fs.Options.Rename.OVERWRITE
    context = hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(draft, target, replace)


def _get(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    return "\n".join(r[0] for r in spark.read.text(path).collect())


def publish(spark: SparkSession, out_dir: str, outputs: dict[str, DataFrame], *, partition_by: dict[str, list[str]] | None = None,
            keep: int = 2) -> str:
    """Write ``outputs`` as Parquet and make them the current run of
    ``out_dir``; returns its name. The run before it stays (``keep`` runs in
    all), for readers that already opened it."""
    out_dir = out_dir.rstrip("/")
    run = uuid.uuid4().hex
    entries = []
    for name, df in outputs.items():
        path = f"{out_dir}/runs/{run}/{name}"
        wr.write_parquet(df, path, partition_by=(partition_by or {}).get(name))
        rows = spark.read.schema(df.schema).parquet(path).agg(F.count(F.lit(1))).first()[0]
        entries.append({"name": name, "path": f"runs/{run}/{name}", "rows": rows, "schema": df.schema.jsonValue()})
    before = [m["run"] for m in _history(spark, out_dir)]
    runs = [run, *before][:keep]
    manifests = [{"run": run, "outputs": entries}, *[m for m in _history(spark, out_dir) if m["run"] in runs]]
    _put(spark, f"{out_dir}/{POINTER}", json.dumps(manifests))
    drop_tables(spark, [f"{out_dir}/runs/{r}" for r in before if r not in runs])
    return run


def _history(spark: SparkSession, out_dir: str) -> list[dict]:
    text = _get(spark, f"{out_dir}/{POINTER}")
    return json.loads(text) if text else []


def published(spark: SparkSession, out_dir: str) -> dict[str, DataFrame]:
    """The outputs of the current run by name."""
    from pyspark.sql.types import StructType
    out_dir = out_dir.rstrip("/")
    history = _history(spark, out_dir)
    if not history:
        raise Unpublished(out_dir)
    return {o["name"]: spark.read.schema(StructType.fromJson(o["schema"])).parquet(f"{out_dir}/{o['path']}")
            for o in history[0]["outputs"]}


def contents(spark: SparkSession, out_dir: str) -> DataFrame:
    """(list, n_rows, n_items) of the current run: rows as the manifest has
    them, distinct materials as counted in the folders."""
    history = _history(spark, out_dir.rstrip("/"))
    rows = {o["name"]: o["rows"] for o in history[0]["outputs"]} if history else {}
    parts = [df.agg(F.count_distinct("MatID").alias("n_items")).select(
        F.lit(name).alias("list"), F.lit(rows[name]).cast("long").alias("n_rows"), "n_items")
        for name, df in published(spark, out_dir).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
