"""Databases as folders of Parquet or CSV files, as catalogs, and back."""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def clean_names(stems: list[str]) -> dict[str, str]:
    """Table names of file stems: a prefix that half of them share goes, and a suffix like _table; a clash keeps the stem."""
    prefix = stems[0].split("_")[0] + "_" if len(stems) > 2 and "_" in stems[0] else ""
    if prefix and sum(s.startswith(prefix) for s in stems) * 2 < len(stems):
        prefix = ""
    short = {s: re.sub(r"(_dataset|_data|_table)$", "", s.removeprefix(prefix)) or s for s in stems}
    often = Counter(short.values())
    return {s: n if often[n] == 1 else s for s, n in short.items()}


def _files(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, by Spark's own file systems: object stores work too."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return sorted(f.getPath().getName() for f in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path))


def load_folder(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Every .csv and .parquet of a folder by clean table name; CSV types come from all rows."""
    names = [n for n in _files(spark, folder) if re.search(r"\.(csv|parquet)$", n)]
    tables = clean_names([n.rsplit(".", 1)[0] for n in names])
    found = {}
    for name in names:
        path, stem = f"{folder}/{name}", name.rsplit(".", 1)[0]
        found[tables[stem]] = spark.read.parquet(path) if name.endswith(".parquet") else spark.read.csv(path, header=True, inferSchema=True)
    return found


def load_catalog(spark: SparkSession, database: str | None = None) -> dict[str, DataFrame]:
    """Every table of a catalog database, and temporary views."""
    return {t.name: spark.table(t.name if t.isTemporary else f"{database or spark.catalog.currentDatabase()}.{t.name}") for t in spark.catalog.listTables(database)}


def load_declared(spark: SparkSession, spec: dict[str, dict[str, Any]], folder: str) -> dict[str, DataFrame]:
    """Tables of a manifest: name -> {path (default <name>.parquet), ...}."""
    return {name: spark.read.parquet(f"{folder}/{entry.get('path', name + '.parquet')}") for name, entry in spec.items()}


def write_database(tables: dict[str, DataFrame], folder: str, manifest: dict[str, dict[str, Any]], columns: dict[str, list[str]]) -> dict[str, dict[str, Any]]:
    """Each table to Parquet with its allowed columns only; key, time and links are always kept. Returns the manifest written."""
    out = {}
    for name, df in tables.items():
        entry = manifest.get(name, {})
        always = [entry.get("pkey"), entry.get("time_col"), *entry.get("fkeys", {})]
        keep = [c for c in df.columns if c in columns.get(name, df.columns) or c in always]
        df.select(keep).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        out[name] = entry | {"path": f"{name}.parquet", "columns": keep}
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps(out),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")
    return out


def read_manifest(spark: SparkSession, folder: str) -> dict[str, dict[str, Any]]:
    return json.loads(spark.read.text(f"{folder}/manifest").first()[0])


def run_slug(entity: str, op: str, horizon_days: int, *parts: Any) -> str:
    """The name of a run: what it is about, and a digest of all that decides its result."""
    digest = hashlib.sha1(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:10]
    return f"{entity}-{op}-{horizon_days}d-{digest}"


def stored_predictions(spark: SparkSession, folder: str, slug: str, make) -> DataFrame:
    """The run's predictions, made and written unless a finished write of the same run is there."""
    path = f"{folder}/{slug}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
