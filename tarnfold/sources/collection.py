"""Collections as snapshots of Parquet, synchronised by content hash, and the stored embedding cache."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import storage

#: Columns of a point that searches filter by; rows are sorted and Bloom filters written for them.
KEYS = ("symbol_type", "directory", "file_path", "class_name")
#: What a hit shows where a stored point lacks a column.
DEFAULTS = {"file_path": "", "language": "", "symbol_type": "", "symbol_name": "", "class_name": "", "directory": "", "docstring": "", "text": "", "start_line": 0, "end_line": 0, "strategy": ""}


def actions(current: DataFrame, existing: DataFrame) -> DataFrame:
    """(point_id, action): upsert (new or changed), unchanged or delete. Of repeated ids in current the last counts."""
    now = current.groupBy("point_id").agg(F.max_by("content_hash", "position").alias("_now"))
    was = existing.select("point_id", F.col("content_hash").alias("_was"))
    action = F.when(F.col("_now").isNull(), "delete").when(F.col("_now").eqNullSafe(F.col("_was")), "unchanged").otherwise("upsert")
    return now.join(was, "point_id", "full_outer").select("point_id", action.alias("action"))


def report(found: DataFrame) -> DataFrame:
    """One row: chunks, upserted, unchanged, deleted, points."""
    n = lambda *kinds: F.count(F.when(F.col("action").isin(*kinds), 1))
    return found.agg(n("upsert", "unchanged").alias("chunks"), n("upsert").alias("upserted"), n("unchanged").alias("unchanged"), n("delete").alias("deleted"), n("upsert", "unchanged").alias("points"))


def report_text(row) -> str:
    """A sync report as one line."""
    return f"{row.chunks} chunks: {row.upserted} written, {row.unchanged} as before, {row.deleted} removed; {row.points} points"


def as_hits(points: DataFrame) -> DataFrame:
    """Stored points with a default for each column of a hit that they lack or hold as null."""
    there = set(points.columns)
    return points.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in there else F.lit(v) for c, v in DEFAULTS.items()})


class Folder:
    """A folder on whatever store Spark knows."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}".rstrip("/"))

    def names(self, name: str = "") -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self.path(name))) if self.fs.exists(self.path(name)) else []

    def delete(self, name: str = "") -> None:
        self.fs.delete(self.path(name), True)


class Collection(Folder):
    """Snapshots, and numbered pointers to them of which the last counts.

    A pointer is written beside its place and renamed, so readers see the old one or the new one whole. A snapshot
    and the one before it stay, for readers that have begun; older ones go.
    """

    def pointers(self) -> list[str]:
        return [n for n in self.names("pointers") if n.isdigit()]

    def pointer(self) -> dict | None:
        found = self.pointers()
        return json.loads(self.spark.read.text(f"{self.folder}/pointers/{found[-1]}").first()[0]) if found else None

    def exists(self) -> bool:
        return bool(self.pointers())

    def dim(self) -> int | None:
        found = self.pointer()
        return found and found["dim"]

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{self.pointer()['snapshot']}")

    def count(self) -> int:
        return self.read().count() if self.exists() else 0

    def drop(self) -> None:
        self.delete()

    def write(self, points: DataFrame, dim: int) -> None:
        name, older = f"snapshot-{uuid.uuid4().hex}", self.pointers()
        keys = [k for k in KEYS if k in points.columns]
        writer = points.repartition("language", F.pmod(F.xxhash64("point_id"), F.lit(self.spark.sparkContext.defaultParallelism))).sortWithinPartitions("language", *keys).write.partitionBy("language")
        for k in keys:
            writer = writer.option(f"parquet.bloom.filter.enabled#{k}", "true")
        writer.parquet(f"{self.folder}/{name}")
        number = f"{int(older[-1]) + 1 if older else 1:012}"
        beside = self.path(f"pointers/new-{uuid.uuid4().hex}")
        out = self.fs.create(beside, False)
        out.write(json.dumps({"snapshot": name, "dim": dim}).encode())
        out.close()
        if self.fs.exists(self.path(f"pointers/{number}")) or not self.fs.rename(beside, self.path(f"pointers/{number}")):
            raise RuntimeError(f"another writer has made pointer {number}")
        kept = {name}
        for n in older[-1:]:
            kept.add(json.loads(self.spark.read.text(f"{self.folder}/pointers/{n}").first()[0])["snapshot"])
        for n in older[:-1]:
            self.delete(f"pointers/{n}")
        for n in self.names():
            if n.startswith("snapshot-") and n not in kept:
                self.delete(n)

    def sync(self, chunks: DataFrame, embed) -> DataFrame:
        """Brings the collection up to chunks (point_id, content_hash, position, language, embed_text, ...).

        Only new and changed chunks are embedded, once; unchanged points keep their old payload.
        Returns the report. An empty sync of a collection that does not exist is an error.
        """
        old = self.pointer()
        if old is None and chunks.isEmpty():
            raise ValueError("nothing to index and no collection")
        last = Window.partitionBy("point_id").orderBy(F.desc("position"))
        now = chunks.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
        before = self.read() if old else None
        found = storage.stored(actions(chunks, before if old else now.select("point_id", "content_hash").limit(0)), "sync-actions")
        changed = now.join(found.where("action = 'upsert'").select("point_id"), "point_id", "left_semi")
        fresh = storage.stored(embed(changed), "sync-embedded")
        sizes = [r[0] for r in fresh.select(F.size("vector")).distinct().limit(2).collect()]
        dim = sizes[0] if sizes else old["dim"]
        if len(sizes) > 1 or (old and old["dim"] != dim):
            raise ValueError(f"vectors of {sizes} places in a collection of {old and old['dim']}")
        kept = before.join(found.where("action = 'unchanged'").select("point_id"), "point_id", "left_semi").select(*fresh.columns) if old else None
        self.write(kept.unionByName(fresh) if kept is not None else fresh, dim)
        return report(found)


class EmbeddingCache(Folder):
    """Vectors by model and key, as 32-bit floats in a folder a model. Each put appends; of a key the last put counts."""

    def read(self, model: str) -> DataFrame:
        """(key, vector) of a model."""
        folder = self.of(model)
        if not self.fs.exists(self.path(folder)):
            return self.spark.createDataFrame([], "key string, vector array<float>")
        rows = self.spark.read.schema("key string, vector array<float>, put long").parquet(f"{self.folder}/{folder}/*")
        return rows.groupBy("key").agg(F.max_by("vector", "put").alias("vector"))

    @staticmethod
    def of(model: str) -> str:
        return "model=" + model.encode().hex()

    def put(self, model: str, rows: DataFrame, dim: int | None = None) -> None:
        """rows (key, vector); vectors of other than `dim` places are an error."""
        rows = storage.stored(rows.select("key", F.col("vector").cast("array<float>").alias("vector")), "cache-put")
        sizes = [r[0] for r in rows.select(F.size("vector")).distinct().limit(2).collect()]
        if len(sizes) > 1 or (sizes and dim is not None and sizes[0] != dim):
            raise ValueError(f"vectors of {sizes} places, not {dim}")
        number = max((int(n.split("-")[0]) for n in self.names(self.of(model))), default=0) + 1
        rows.withColumn("put", F.lit(number).cast("long")).write.parquet(f"{self.folder}/{self.of(model)}/{number:012}-{uuid.uuid4().hex}")

    def count(self, model: str | None = None) -> int:
        if model is not None:
            return self.read(model).count()
        return sum(self.count(bytes.fromhex(n.partition("=")[2]).decode()) for n in self.names() if n.startswith("model="))

    def clear(self, model: str | None = None) -> None:
        for n in self.names() if model is None else [self.of(model)]:
            self.delete(n)

    def embed(self, model: str, texts: DataFrame, encode, bypass: bool = False) -> tuple[DataFrame, dict[str, int]]:
        """texts (id, key, text) -> (id, vector) and counters (hits, misses, encoded): each missing key is encoded once, and kept.

        encode: (key, text) -> (key, vector). With `bypass` the cache is neither read nor written.
        """
        if bypass:
            new = storage.stored(encode(texts.dropDuplicates(["key"]).select("key", "text")), "cache-bypass")
            return texts.join(new, "key").select("id", "vector"), {"hits": 0, "misses": texts.count(), "encoded": new.count()}
        found, new = cached_embedding(texts, self.read(model), encode)
        new = storage.stored(new, "cache-new")
        self.put(model, new)
        missed = texts.join(new.select("key"), "key", "left_semi").count()
        every = self.read(model)
        return texts.join(every, "key").select("id", "vector"), {"hits": texts.count() - missed, "misses": missed, "encoded": new.count()}


def cached_embedding(texts: DataFrame, cache: DataFrame, encode) -> tuple[DataFrame, DataFrame]:
    """texts (id, key, text), cache (key, vector) -> (id, vector) and the new cache rows: each missing key is encoded once."""
    missing = texts.join(cache.select("key"), "key", "left_anti").dropDuplicates(["key"]).select("key", "text")
    new = encode(missing).select("key", F.col("vector").cast("array<float>").alias("vector"))
    every = cache.select("key", F.col("vector").cast("array<float>").alias("vector")).unionByName(new)
    return texts.join(every, "key").select("id", "vector"), new
