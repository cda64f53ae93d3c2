"""Immutable snapshots of a table with an atomically swapped pointer, and plain readers and writers.

A write makes new folders and then renames a small pointer file onto the old one; readers resolve the pointer once and
so see one whole state.  The pointer names the folder of every bucket, so that a merge reads and writes the buckets of
its batch only.  One writer at a time; older folders stay until ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

POINTER = "CURRENT"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None where there is none."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written beside its place and renamed onto it."""
    at, name = path.rsplit("/", 1)
    fs, tmp = _fs(spark, f"{at}/.{name}-{uuid.uuid4().hex}")
    stream = fs.create(tmp, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    jvm = spark._jvm.org.apache.hadoop.fs
    context = jvm.FileContext.getFileContext(tmp.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
    options[0] = jvm.Options.Rename.OVERWRITE
    context.rename(tmp, _fs(spark, path)[1], options)


class Snapshots:
    def __init__(self, spark: SparkSession, root: str, bucket_by: str | None = None, buckets: int = 8):
        self.spark, self.root, self.bucket_by, self.buckets = spark, root.rstrip("/"), bucket_by, buckets

    def current(self) -> str | None:
        """The pointer: schema and folder of every bucket."""
        return read_text(self.spark, f"{self.root}/{POINTER}")

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("__bucket", F.pmod(F.xxhash64(self.bucket_by), F.lit(self.buckets)).cast("int") if self.bucket_by else F.lit(0))

    def _read(self, pointer: str, only: set[int] | None = None) -> DataFrame:
        held = json.loads(pointer)
        folders = [f"{self.root}/{f}" for b, f in sorted(held["folders"].items()) if only is None or int(b) in only]
        schema = StructType.fromJson(held["schema"])
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame | None:
        pointer = self.current()
        return None if pointer is None else self._read(pointer)

    def _write(self, df: DataFrame, kept: dict[str, str]) -> str:
        name = f"v-{uuid.uuid4().hex}"
        # a large bucket is written by several tasks
        self._bucketed(df).hint("rebalance", "__bucket").write.partitionBy("__bucket").parquet(f"{self.root}/{name}")
        fs, p = _fs(self.spark, f"{self.root}/{name}")
        made = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
        folders = kept | {f.split("=")[1]: f"{name}/{f}" for f in made if f.startswith("__bucket=")}
        replace_text(self.spark, f"{self.root}/{POINTER}", json.dumps({"schema": df.schema.jsonValue(), "folders": folders}))
        return name

    def write(self, df: DataFrame) -> str:
        """A new snapshot becomes the current one; the old one is still whole if this fails on the way."""
        return self._write(df, {})

    def merge(self, batch: DataFrame, rule: Callable[[DataFrame | None, DataFrame], DataFrame]) -> str:
        """``rule(current or None, batch)`` gives the next state of the batch's buckets; rows of others are neither read nor written.

        With ``bucket_by`` the rule must look at rows of equal values of that column only.
        """
        pointer = self.current()
        if pointer is None:
            return self.write(rule(None, batch))
        touched = {r["__bucket"] for r in self._bucketed(batch).select("__bucket").distinct().collect()}
        kept = {b: f for b, f in json.loads(pointer)["folders"].items() if int(b) not in touched}
        return self._write(rule(self._read(pointer, touched), batch), kept)

    def vacuum(self) -> int:
        """Remove every folder that the pointer does not name; how many went."""
        keep = set(json.loads(self.current() or '{"folders": {}}')["folders"].values())
        fs, root = _fs(self.spark, self.root)
        gone = 0
        for s in fs.listStatus(root):
            version = s.getPath().getName()
            if version.startswith("v-"):
                parts = [p.getPath() for p in fs.listStatus(s.getPath()) if p.isDirectory()]
                left = [p for p in parts if f"{version}/{p.getName()}" in keep]
                for p in parts if left else [s.getPath()]:
                    if p not in left:
                        fs.delete(p, True)
                        gone += 1
        return gone


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """path, text, reason: files decoded as UTF-8 without a byte order mark and NULs; undecodable ones have a reason and no text."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(path).select("path", "content")
    text = F.try_validate_utf8(F.col("content").cast("string")) if hasattr(F, "try_validate_utf8") else F.decode("content", "UTF-8")
    clean = F.replace(F.regexp_replace(text, "^\\ufeff", ""), F.lit("\u0000"), F.lit(""))
    return raw.select("path", clean.alias("text"), F.when(text.isNull(), "invalid").alias("reason"))


def turns_to_json(turns: DataFrame) -> DataFrame:
    """key, line: one JSON line per turn under its session, as a list store keeps them."""
    fields = [c for c in ("session_id", "scope", "turn_n", "user_input", "response", "feedback", "goal", "goal_status", "sentiment", "domains", "pii_types", "created_at") if c in turns.columns]
    return turns.select(F.concat_ws(":", F.lit("turns"), "scope", "session_id").alias("key"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("line"))


def turns_from_json(lines: DataFrame, schema: str) -> DataFrame:
    return lines.select(F.from_json("line", schema).alias("t")).where(F.col("t").isNotNull()).select("t.*")
