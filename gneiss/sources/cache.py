"""A keyed cache in Parquet that several writers may add to at once, with eviction of what was used least recently.

Rows (key, value, bytes, accessed) stand in parts that are never changed. A
version is a manifest that lists its parts; a writer adds its rows as a part,
less the keys that the newest version has, and then claims the next version's
name, which only one can. Who loses looks at what the winner added and tries
again, so no version ever holds a key twice. Readers see one whole version.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

from gneiss.plans.ordering import running_total
from gneiss.session import shuffle_partitions
from gneiss.staging import drop, stage

SCHEMA = "key string, value long, bytes long, accessed long"
#: Tries of a commit; versions whose parts are kept for readers; parts from which an append writes all of them anew.
TRIES, KEPT, PARTS = 50, 2, 64


class Cache:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark._jvm
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def versions(self) -> list[int]:
        where = self.path("versions")
        if not self.fs.exists(where):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(where)]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())

    def manifest(self, version: int) -> dict:
        """What a version lists; one that is just being written is waited for."""
        for _ in range(100):
            stream = self.fs.open(self.path(f"versions/v{version:09}"))
            text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            if text.endswith("\n"):
                return json.loads(text)
            time.sleep(0.05)
        raise OSError(f"version {version} was never finished")

    def newest(self) -> tuple[int, dict]:
        found = self.versions()
        return (found[-1], self.manifest(found[-1])) if found else (0, {"parts": [], "touches": []})

    def claim(self, version: int, manifest: dict) -> bool:
        """Makes a version, unless another has made it before."""
        data = bytearray(json.dumps(manifest).encode() + b"\n")
        final = self.path(f"versions/v{version:09}")
        self.fs.mkdirs(self.path("versions"))
        local = self.fs.getScheme() == "file"
        made = self.path(f"versions/.{uuid.uuid4().hex}") if local else final
        try:
            out = self.fs.create(made, False)
            out.write(data)
            out.close()
            if local:  # a local create is no atomic claim, a link is
                file = lambda p: self.jvm.java.io.File(p.toUri().getPath()).toPath()
                self.jvm.java.nio.file.Files.createLink(file(final), file(made))
            return True
        except Py4JJavaError as e:
            if "AlreadyExists" not in e.java_exception.getClass().getName():
                raise
            return False
        finally:
            if local:
                self.fs.delete(made, False)

    def parts(self, names: list[str], schema: str = SCHEMA) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/parts/{n}" for n in names])

    def write(self, rows: DataFrame) -> str:
        name = uuid.uuid4().hex
        rows.write.option("compression", "zstd").parquet(f"{self.root}/parts/{name}")
        return name

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(f"parts/{name}"), True)

    def entries(self, manifest: dict | None = None) -> DataFrame:
        """(key, value, bytes, accessed) of the newest version, or of one; accessed is the last time of all."""
        manifest = manifest or self.newest()[1]
        rows = self.parts(manifest["parts"])
        if not manifest["touches"]:
            return rows
        touched = self.parts(manifest["touches"], "key string, accessed long").groupBy("key").agg(F.max("accessed").alias("touched"))
        return rows.join(touched, "key", "left").select("key", "value", "bytes", F.greatest("accessed", "touched").alias("accessed"))

    def add(self, rows: DataFrame, now: int) -> int:
        """Adds rows (key, value, bytes) under keys that the cache lacks, of equal keys the least value; returns how many.

        The rows are computed once, whatever other writers do meanwhile.
        """
        named = rows.groupBy("key").agg(F.min(F.struct("value", "bytes")).alias("x")).select("key", "x.value", "x.bytes", F.lit(now).cast("long").alias("accessed"))
        part, base = self.write(named), 0
        seen: list[str] = []
        for _ in range(TRIES):
            base, manifest = self.newest()
            more = [p for p in manifest["parts"] if p not in seen]
            if more:  # only what others have added since is looked at
                left = self.write(self.parts([part]).join(self.parts(more).select("key"), "key", "left_anti").select("key", "value", "bytes", "accessed"))
                self.remove(part)
                part, seen = left, manifest["parts"]
            count = self.parts([part]).count()
            if not count:
                self.remove(part)
                return 0
            if self.claim(base + 1, {**manifest, "parts": [*manifest["parts"], part]}):
                if len(manifest["parts"]) + len(manifest["touches"]) >= PARTS:
                    self.compact()
                return count
        raise OSError("too many writers at once")

    def touch(self, keys: DataFrame, now: int) -> None:
        """Notes that keys were used; those that the cache lacks do not matter."""
        part = self.write(keys.select("key").distinct().withColumn("accessed", F.lit(now).cast("long")))
        for _ in range(TRIES):
            base, manifest = self.newest()
            if self.claim(base + 1, {**manifest, "touches": [*manifest["touches"], part]}):
                return
        raise OSError("too many writers at once")

    def compact(self) -> None:
        self.prune(1 << 62, 1 << 62)

    def prune(self, max_entries: int, max_bytes: int, dry_run: bool = False) -> dict:
        """Drops entries, the least recently used first and then by key, until both bounds hold, and writes the rest as one part.

        What stays of an entry and all used after it is a running total over
        ranges of (accessed, key); only the ranges' totals meet in one place.
        Returns entries and bytes before and after. Parts that the last versions
        do not list are deleted.
        """
        for _ in range(TRIES):
            base, manifest = self.newest()
            rows = self.entries(manifest).repartitionByRange(shuffle_partitions(self.spark), F.desc("accessed"), F.desc("key"))
            placed = stage(rows.withColumns({"slot": F.spark_partition_id(), "one": F.lit(1).cast("long")}), "cache-order")
            order = [F.desc("accessed"), F.desc("key")]
            upto = running_total(running_total(placed, "slot", order, "one", "n"), "slot", order, "bytes", "size")
            kept = upto.filter((F.col("n") + F.col("one") <= max_entries) & (F.col("size") + F.col("bytes") <= max_bytes)).select("key", "value", "bytes", "accessed")
            count = lambda t: tuple(t.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first())
            before = count(placed)
            if dry_run:
                after = count(kept)
                drop(placed)
                return {"entries_before": before[0], "bytes_before": before[1], "entries": after[0], "bytes": after[1]}
            part = self.write(kept)
            drop(placed)
            if self.claim(base + 1, {"parts": [part], "touches": []}):
                after = count(self.parts([part]))
                self.clean()
                return {"entries_before": before[0], "bytes_before": before[1], "entries": after[0], "bytes": after[1]}
            self.remove(part)
        raise OSError("too many writers at once")

    def clean(self) -> None:
        """Deletes versions but the last ones, and the parts that only those listed."""
        versions = self.versions()
        listed = lambda vs: {p for v in vs for m in [self.manifest(v)] for p in (*m["parts"], *m["touches"])}
        kept = listed(versions[-KEPT:])
        for name in listed(versions[:-KEPT]) - kept:
            self.remove(name)
        for v in versions[:-KEPT]:
            self.fs.delete(self.path(f"versions/v{v:09}"), False)


def cached_counts(texts: DataFrame, root: str, count, now: int, *about: object) -> DataFrame:
    """(content, tokens) of texts (content hash, text): counts that a cache has under the same hash and facts, others computed and added.

    about is all that a count depends on besides the text, such as the
    tokenizer, the size limit and the mode.
    """
    cache = Cache(texts.sparkSession, root)
    facts = F.concat_ws("\0", *[F.lit(str(a)) for a in about], "content")
    keyed = texts.select(F.sha2(facts, 256).alias("key"), "content", "text")
    held = cache.entries().select("key")
    fresh = keyed.join(held, "key", "left_anti").groupBy("key").agg(F.first("text").alias("text"))
    added = cache.add(fresh.select("key", count(F.col("text")).cast("long").alias("value"), F.lit(72).cast("long").alias("bytes")), now)
    if added == 0:
        cache.touch(keyed, now)
    return keyed.select("key", "content").distinct().join(cache.entries().select("key", F.col("value").alias("tokens")), "key").select("content", "tokens")
