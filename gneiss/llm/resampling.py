"""Importance resampling towards a target distribution, by tries of the words met in a partition.

A task keeps the features it meets (runs of words) as paths of bytes in a trie.
A node holds the state of the CRC-32 of its path, so the bucket of a feature is
known where its path ends, and how often it ended there. The totals by bucket
of all tasks give each bucket its gain; a second pass walks the same paths with
the gains attached to the nodes, and a document's weight is the sum of what its
features end at.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gneiss.llm.arrow import give_back
from gneiss.plans.ordering import global_rank
from gneiss.staging import drop, stage

#: Buckets that features are hashed to.
BUCKETS = 10_000
#: Bytes of text worked on at once; features walked at once.
ROOM, WALKED = 4 << 20, 1 << 15
#: Nodes of a trie; one that is full gives its totals and starts anew. Longer features are not kept as paths.
NODES, LONGEST = 1 << 20, 64

#: By byte: what it counts as in a word, in lower case, or 0.
FOLDED = np.array([b if b >= 0x80 or chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" else b + 32 if 65 <= b <= 90 else 0 for b in range(256)], np.uint8)


def crc_table() -> np.ndarray:
    """The step of CRC-32 (reversed polynomial EDB88320) for each low byte of its state."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


STEP = crc_table()


def blocks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, bounds of the rows among them) of runs of rows of about ROOM bytes; nulls are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + ROOM, side="right")) - 1)
        yield at, data[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
        at = to


def features(data: np.ndarray, bounds: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with words one space apart, starts, ends and rows of the features, words by row)."""
    data = FOLDED[data]
    inside = data > 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(data))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    rows = np.searchsorted(bounds, starts, side="right") - 1
    words = np.bincount(rows, minlength=len(bounds) - 1)
    if longest > 1:
        gap = ends[ends < len(data)]
        gap = gap[~inside[gap]]
        data[gap] = 32
        moved = np.concatenate([[0], np.cumsum(data > 0)])
        data, starts, ends = data[data > 0], moved[starts], moved[ends]
    runs = [(starts, ends, rows)]
    for more in range(1, longest):
        own = rows[more:] == rows[:-more]
        runs.append((starts[:-more][own], ends[more:][own], rows[more:][own]))
    return data, *map(np.concatenate, zip(*runs, strict=True)), words


class Trie:
    """Features as paths of bytes; by node: state (of the CRC), count, and gain where the gains are known.

    The edges, (node, byte) to node, stand in one table that is searched for
    many features at a time.
    """

    def __init__(self, buckets: int = BUCKETS, gains: np.ndarray | None = None, nodes: int = NODES):
        self.buckets, self.gains, self.room = buckets, gains, nodes
        self.mask = (1 << (2 * nodes - 1).bit_length()) - 1
        self.totals = np.zeros(buckets, np.int64)
        self.clear()

    def clear(self) -> None:
        self.n = 1
        self.edge, self.child = np.zeros(self.mask + 1, np.int64), np.zeros(self.mask + 1, np.int32)
        self.state, self.count = np.zeros(self.room, np.uint32), np.zeros(self.room, np.int64)
        self.state[0] = 0xFFFFFFFF
        self.gain = np.zeros(self.room, np.int64)

    def bucket(self, state: np.ndarray) -> np.ndarray:
        return (state ^ np.uint32(0xFFFFFFFF)) % np.uint32(self.buckets)

    def flush(self) -> np.ndarray:
        """The totals by bucket of all that was counted."""
        at = np.flatnonzero(self.count)
        np.add.at(self.totals, self.bucket(self.state[at]), self.count[at])
        self.count[at] = 0
        return self.totals

    def place(self, edges: np.ndarray) -> np.ndarray:
        return ((edges.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)).astype(np.int64) & self.mask

    def follow(self, edges: np.ndarray) -> np.ndarray:
        """The nodes that edges lead to, made where there are none."""
        place, found = self.place(edges), np.zeros(len(edges), np.int32)
        left, missing = np.arange(len(edges)), []
        while len(left):
            met = self.edge[place[left]]
            hit, free = met == edges[left], met == 0
            found[left[hit]] = self.child[place[left[hit]]]
            missing.append(left[free])
            left = left[~hit & ~free]
            place[left] = (place[left] + 1) & self.mask
        missing = np.concatenate(missing) if missing else left
        if len(missing):
            new, back = np.unique(edges[missing], return_inverse=True)
            nodes = np.arange(self.n, self.n + len(new), dtype=np.int32)
            before = self.state[(new - 1) >> 8]
            state = STEP[(before ^ (new - 1).astype(np.uint32)) & np.uint32(255)] ^ (before >> np.uint32(8))
            self.state[nodes] = state
            if self.gains is not None:
                self.gain[nodes] = self.gains[self.bucket(state)]
            self.n += len(new)
            place, left = self.place(new), np.arange(len(new))
            while len(left):
                free = left[self.edge[place[left]] == 0]
                self.edge[place[free]] = new[free]
                won = self.edge[place[left]] == new[left]
                self.child[place[left[won]]] = nodes[left[won]]
                left = left[~won]
                place[left] = (place[left] + 1) & self.mask
            found[missing] = nodes[back]
        return found

    def walk(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The gain of each feature, 0 where gains are not known; counts them all."""
        out = np.zeros(len(starts), np.int64)
        sizes = ends - starts
        for i in np.flatnonzero(sizes > LONGEST):
            bucket = zlib.crc32(data[starts[i] : ends[i]]) % self.buckets
            self.totals[bucket] += 1
            out[i] = 0 if self.gains is None else self.gains[bucket]
        short = np.flatnonzero(sizes <= LONGEST)
        upto = np.concatenate([[0], np.cumsum(sizes[short])])
        at = 0
        while at < len(short):
            to = min(max(at + 1, int(np.searchsorted(upto, upto[at] + self.room // 4, side="right")) - 1), at + WALKED)
            if self.n + upto[to] - upto[at] > self.room:
                self.flush()
                self.clear()
            own = short[at:to]
            out[own] = self.ended(data, starts[own], sizes[own])
            at = to
        return out

    def ended(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        order = np.argsort(sizes.astype(np.uint8), kind="stable")[::-1]
        starts, sizes = starts[order], sizes[order]
        node = np.zeros(len(starts), np.int32)
        longer = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), side="left")
        for k, m in enumerate(longer):
            node[:m] = self.follow((node[:m].astype(np.int64) << 8) + data[starts[:m] + k] + 1)
        self.count[: self.n] += np.bincount(node, minlength=self.n)
        out = np.empty(len(node), np.int64)
        out[order] = self.gain[node]
        return out


def bucket_totals(docs: DataFrame, text: str = "text", longest: int = 1, buckets: int = BUCKETS) -> list[int]:
    """How many features of all texts fall into each bucket; one number a bucket reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(buckets)
        for b in batches:
            for _, data, bounds in blocks(b.column(0)):
                data, starts, ends, _, _ = features(data, bounds, longest)
                trie.walk(data, starts, ends)
        totals = trie.flush()
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(totals[at])], names=["bucket", "n"])
        del trie
        give_back()

    out = [0] * buckets
    for r in docs.select(docs[text].cast("string")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: list[int], target: list[int]) -> list[int]:
    """A thousand times the logarithm of how much likelier each bucket is in the target, rounded down; one is added to every bucket."""
    s, t, k = sum(source), sum(target), len(source)
    return [math.floor(1000 * math.log((float(b) + 1) * (s + k) / ((float(a) + 1) * (t + k)))) for a, b in zip(source, target, strict=True)]


def weigh(docs: DataFrame, gains: list[int], keep: tuple[str, ...] = ("doc_id",), text: str = "text", longest: int = 1) -> DataFrame:
    """The kept columns of every row, then n_words, n_features and weight, the sum of its features' gains (none: 0)."""
    names = [f"c{i}" for i in range(len(keep))]
    source = docs.select(*[docs[c] for c in keep], docs[text].cast("string")).toDF(*names, "t")
    schema = ", ".join([*(f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, keep, strict=True)), "n_words long, n_features long, weight long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(len(gains), np.array(gains, np.int64))
        for b in batches:
            for at, data, bounds in blocks(b.column(len(keep))):
                data, starts, ends, rows, words = features(data, bounds, longest)
                n = len(bounds) - 1
                got = trie.walk(data, starts, ends)
                weight = np.zeros(n, np.int64)
                np.add.at(weight, rows, got)
                yield pa.RecordBatch.from_arrays([*(c.slice(at, n) for c in b.columns[: len(keep)]), pa.array(words), pa.array(np.bincount(rows, minlength=n)), pa.array(weight)], names=[*names, "n_words", "n_features", "weight"])
        del trie
        give_back()

    return source.mapInArrow(run, schema).toDF(*keep, "n_words", "n_features", "weight")


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = 10, longest: int = 1, buckets: int = BUCKETS, seed: int = 2024, least: int = 20) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs; rank numbers those drawn, and is null for the others.

    Words are runs of digits, letters (A-Z in lower case) and characters beyond
    ASCII; features are runs of 1 to longest of them. score is the weight plus
    Gumbel noise from a hash of the id, so the highest scores are a draw without
    replacement by weight and reruns agree. Of the rows with least words or more,
    percent in a hundred are drawn, rounded down; ties go to the smaller id, null
    ids last, and equal rows are drawn one by one. Null texts are empty; an empty
    table gives an empty result, an empty target one with no gains but the
    smoothing's.
    """
    gains = bucket_gains(bucket_totals(docs, text, longest, buckets), bucket_totals(target, target_text, longest, buckets))
    rows = weigh(docs, gains, (doc_id,), text, longest).toDF("doc_id", "n_words", "n_features", "weight")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = rows.withColumns({"score": F.col("weight") + noise, "least": F.col("n_words") >= least, "own": F.monotonically_increasing_id()})
    scored = stage(rows.drop("n_words"), "scored")
    drawn = percent * scored.filter("least").count() // 100
    order = [F.col("least").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight"), F.col("own")]
    ranked = global_rank(scored, order)
    rank = F.when(F.col("position") <= drawn, F.col("position")).cast("long").alias("rank")
    drop(scored)
    return ranked.select(F.col("doc_id").alias(doc_id), "n_features", "weight", "score", rank)
