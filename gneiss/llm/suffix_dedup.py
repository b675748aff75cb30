"""Removal of repeated byte strings, by suffix arrays of shards that hold all places of a string.

Every string of LENGTH bytes contains an anchor: the place of the smallest hash
among its runs of GRAM bytes, which depends on the string alone. Places whose
anchors, and all strings around them that these stand for (their context), are
equal form a class; of a class all but the first place are copies. Anchors with
more than one class are left: their first contexts go to shards by the anchor,
so two places of a string meet in one shard, and the shard's suffix array, built
by external induced sorting, brings equal strings of LENGTH bytes together. All
strings but those at the first of their places are copies; the bytes they cover
go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from gneiss.llm.arrow import give_back
from gneiss.llm.induced_sorting import Store, suffix_array
from gneiss.llm.resampling import blocks
from gneiss.session import shuffle_partitions
from gneiss.staging import stage

#: Bytes of the strings that are looked for, and of the runs whose hashes choose anchors.
LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1
#: Bytes of a text worked on at once, and of texts whose anchors one task compares by itself.
PIECE, TOGETHER = 1 << 17, 16 << 20
#: Bytes of texts whose anchors meet in a partition, and of contexts in a shard.
SLOT, SHARD = 32 << 20, 3 << 20
#: Classes from which an anchor's contexts are dealt out by their own bytes, in so many kinds.
MANY, KINDS = 64, 4
#: Bytes of a shard's arrays that stay in memory.
ROOM = 256 << 20

MASK = (1 << 64) - 1
_RNG = np.random.default_rng(20240613)
#: Random odd numbers: for each byte, and to multiply by, of two hashes.
TABLES = _RNG.integers(0, MASK, (2, 256), np.uint64, True) | np.uint64(1)
BASES = [int(b) | 1 for b in _RNG.integers(1 << 62, MASK, 2, np.uint64)]


def powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


class Hasher:
    """Polynomial hashes of 64 bits of any run of bytes of a piece."""

    def __init__(self, which: int, n: int = PIECE + 2 * LENGTH):
        self.table = TABLES[which]
        self.up, self.down = powers(BASES[which], n), powers(pow(BASES[which], -1, 1 << 64), n)

    def read(self, data: np.ndarray) -> None:
        if len(data) > len(self.up):
            raise ValueError("piece too long")
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.table[data] * self.up[: len(data)], dtype=np.uint64)])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))

    def runs(self, size: int) -> np.ndarray:
        """32 bits for each run of size bytes, 1 at least."""
        n = len(self.sums) - size
        return np.maximum((((self.sums[size:] - self.sums[:n]) * self.down[:n]) >> np.uint64(32)).astype(np.uint32), np.uint32(1))


def sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """The best of each run of width entries, from those of half the width."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = best(x[:-step], x[step:])
        have += step
    return x


def anchors(data: np.ndarray, bounds: np.ndarray, hashers: tuple[Hasher, Hasher]) -> tuple[np.ndarray, ...]:
    """(hash, context hash, place, strings before the place, strings) of the anchors of texts that bounds part.

    An anchor stands for the strings that start in a run of places of which it
    is the last but so many; its context is all that they cover.
    """
    if len(data) < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    for h in hashers:
        h.read(data)
    grams = hashers[0].runs(GRAM)
    edge = np.zeros(SPAN - 1, np.uint32)
    least = np.concatenate([edge, sliding(grams, SPAN, np.minimum), edge])
    for b in bounds[1:-1]:  # no string crosses texts
        least[SPAN - 1 + max(0, b - LENGTH + 1) : SPAN - 1 + b] = 0
    at = np.flatnonzero(grams == sliding(least, SPAN, np.maximum))
    own = least[at[:, None] + np.arange(SPAN)] == grams[at][:, None]
    first, last = own.argmax(axis=1), SPAN - 1 - own[:, ::-1].argmax(axis=1)
    low = at - (SPAN - 1) + first
    context = hashers[1].of(low, low + (last - first) + LENGTH) ^ mixed((SPAN - 1 - first).astype(np.uint64) + np.uint64(1 << 32))
    return hashers[0].of(at, at + GRAM), context, at, SPAN - 1 - first, last - first + 1


#: An anchor: document, place of its first string, hash, hash of its context, strings before its place, strings.
ANCHOR = np.dtype([("none", "u1"), ("id", "i8"), ("key", "i8"), ("start", "i8"), ("hash", "u8"), ("context", "u8"), ("back", "u1"), ("n", "u1")])
#: Strings not yet judged: their first place, how many, the anchor's hash, where it stands, and whether it has many classes.
OPEN = np.dtype([("start", "i8"), ("n", "i4"), ("hash", "u8"), ("back", "u1"), ("many", "u1")])
RUN = np.dtype([("start", "i8"), ("end", "i8")])
#: A context in a shard: document, first place, strings.
CONTEXT = np.dtype([("none", "u1"), ("id", "i8"), ("key", "i8"), ("start", "i8"), ("n", "i4")])


def pack(rows: np.ndarray) -> bytes:
    """Rows by columns, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(rows[c]).tobytes() for c in rows.dtype.names))


def unpack(data: bytes, kind: np.dtype) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    out, at = np.empty(len(raw) // sum(kind[c].itemsize for c in kind.names), kind), 0
    for c in kind.names:
        size = len(out) * kind[c].itemsize
        out[c] = np.frombuffer(raw[at : at + size], kind[c])
        at += size
    return out


def pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, bounds, rows, offsets): texts of LENGTH bytes or more, those longer than PIECE cut so that every string is whole in a part."""
    for at, data, bounds in blocks(texts):
        held, rows, offsets, size = [], [], [], 0
        for i in np.flatnonzero(np.diff(bounds) >= LENGTH):
            a, b = int(bounds[i]), int(bounds[i + 1])
            for c in range(a, b - LENGTH + 1, PIECE):
                part = data[c : min(b, c + PIECE + LENGTH - 1)]
                if size + len(part) > PIECE + LENGTH and held:
                    yield np.concatenate(held), np.cumsum([0, *map(len, held)]), np.array(rows), np.array(offsets)
                    held, rows, offsets, size = [], [], [], 0
                held.append(part)
                rows.append(at + i)
                offsets.append(c - a)
                size += len(part)
        if held:
            yield np.concatenate(held), np.cumsum([0, *map(len, held)]), np.array(rows), np.array(offsets)


def parted(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors by hash, context and place, each with: starts a hash, starts a class, is at a later place than its class's first."""
    rows = rows[np.argsort(rows["hash"])]
    new = np.ones(len(rows), bool)
    new[1:] = rows["hash"][1:] != rows["hash"][:-1]
    shared = np.flatnonzero(~(new & np.append(new[1:], True)))  # the others are alone
    own = rows[shared]
    rows[shared] = own[np.lexsort((own["start"], own["key"], own["id"], own["none"], own["context"], own["hash"]))]
    cls = new.copy()
    cls[1:] |= rows["context"][1:] != rows["context"][:-1]
    lead = rows[np.flatnonzero(cls)[np.cumsum(cls) - 1]] if len(rows) else rows
    later = np.zeros(len(rows), bool)
    for c in ("none", "id", "key", "start"):
        later |= rows[c] != lead[c]
    return rows, new, cls, later


def by_document(rows: np.ndarray, fields: dict[str, np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    """A row for each document: slot -1, doc_id, key and the packed entries of fields[name] where given."""
    for name, entries in fields.items():
        order = np.lexsort((entries["start"], rows[name]["key"], rows[name]["id"], rows[name]["none"]))
        own, entries = rows[name][order], entries[order]
        if not len(own):
            continue
        new = np.ones(len(own), bool)
        new[1:] = (own["none"][1:] != own["none"][:-1]) | (own["id"][1:] != own["id"][:-1]) | (own["key"][1:] != own["key"][:-1])
        cuts = np.flatnonzero(new)
        data = [entries[a:b].tobytes() for a, b in zip(cuts, [*cuts[1:], len(own)], strict=True)]
        cols = {
            "slot": pa.array(np.full(len(cuts), -1, np.int32)),
            "doc_id": pa.array(own["id"][cuts], pa.int64(), mask=own["none"][cuts] > 0),
            "key": pa.array(own["key"][cuts]),
            "runs": pa.array(data if name == "runs" else [None] * len(cuts), pa.binary()),
            "open": pa.array(data if name == "open" else [None] * len(cuts), pa.binary()),
        }
        for at in range(0, len(cuts), 4096):
            yield pa.RecordBatch.from_arrays([cols[n].slice(at, 4096) for n in names], names=names)


def joined_runs(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Runs of bytes, those that meet or overlap as one."""
    out = np.empty(0, RUN)
    if len(start):
        order = np.argsort(start, kind="stable")
        start, end = start[order], np.maximum.accumulate(end[order])
        new = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
        out = np.empty(len(new), RUN)
        out["start"], out["end"] = start[new], end[np.concatenate([new[1:] - 1, [len(end) - 1]])]
    return out


def copies_of(rows: np.ndarray) -> np.ndarray:
    runs = np.empty(len(rows), RUN)
    runs["start"], runs["end"] = rows["start"], rows["start"] + (rows["n"].astype(np.int64) + LENGTH - 1)
    return runs


def anchor_table(docs: DataFrame, slots: int) -> DataFrame:
    """Packed anchors by slot, only the first of each class a task meets; the strings of the others, as runs of their documents (slot -1)."""
    names = ["slot", "doc_id", "key", "runs", "blob"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashers, held, size = (Hasher(0), Hasher(1)), [], 0
        for b in batches:
            ids, keys = b.column(0), b.column(1).to_numpy()
            none, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            for data, bounds, rows, offsets in pieces(b.column(2)):
                h, context, at, back, n = anchors(data, bounds, hashers)
                piece = np.searchsorted(bounds, at, side="right") - 1
                own = np.empty(len(at), ANCHOR)
                row = rows[piece]
                own["none"], own["id"], own["key"] = none[row], ids[row], keys[row]
                own["start"] = at - back - bounds[piece] + offsets[piece]
                own["hash"], own["context"], own["back"], own["n"] = h, context, back, n
                held.append(own)
                size += len(data)
                if size >= TOGETHER:
                    yield from given(np.concatenate(held))
                    held, size = [], 0
        if held:
            yield from given(np.concatenate(held))
        del hashers, held
        give_back()

    def given(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows, _, first, later = parted(rows)
        if later.any():
            for b in by_document({"runs": rows[later]}, {"runs": copies_of(rows[later])}, ["slot", "doc_id", "key", "runs"]):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.nulls(b.num_rows, pa.binary())], names=names)
        rows = rows[first]
        slot = (rows["hash"] % np.uint64(slots)).astype(np.int32)
        order = np.lexsort((rows["start"], rows["key"], rows["id"], slot))
        rows, slot = rows[order], slot[order]
        cuts = np.flatnonzero(np.diff(slot, prepend=-1))
        for at in range(0, len(cuts), 64):
            part = cuts[at : at + 64]
            ends = [*cuts[at + 1 : at + 65], len(rows)][: len(part)]
            blobs = [pack(rows[a:b]) for a, b in zip(part, ends, strict=True)]
            none = pa.nulls(len(part), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(slot[part]), none, none, pa.nulls(len(part), pa.binary()), pa.array(blobs, pa.binary())], names=names)

    return docs.mapInArrow(run, "slot int, doc_id long, key long, runs binary, blob binary")


def classes(table: DataFrame, slots: int) -> DataFrame:
    """(doc_id, key, runs, open): by document, the strings that are copies within a class, and those whose anchor has several classes."""
    names = ["doc_id", "key", "runs", "open"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: list[np.ndarray] = []
        for b in batches:
            done = b.filter(b.column(4).is_null())
            if done.num_rows:
                yield pa.RecordBatch.from_arrays([done.column(1), done.column(2), done.column(3), pa.nulls(done.num_rows, pa.binary())], names=names)
            blobs += [unpack(x, ANCHOR) for x in b.column(4).drop_null().to_pylist()]
        if not blobs:
            return
        rows = np.concatenate(blobs)
        blobs.clear()
        met = np.sort(rows["hash"])
        met = np.unique(met[1:][met[1:] == met[:-1]])
        place = np.minimum(np.searchsorted(met, rows["hash"]), max(0, len(met) - 1))
        rows = rows[met[place] == rows["hash"]] if len(met) else rows[:0]
        rows, new, first, later = parted(rows)
        group = np.cumsum(new) - 1
        n = np.bincount(group[first], minlength=int(new.sum()))
        own = first & (n[group] > 1)
        left = np.empty(int(own.sum()), OPEN)
        for c in ("start", "n", "hash", "back"):
            left[c] = rows[c][own]
        left["many"] = n[group][own] > MANY
        fields = {"runs": copies_of(rows[later]), "open": left}
        yield from by_document({"runs": rows[later], "open": rows[own]}, fields, names)
        del rows
        give_back()

    # runs found in one task need no slot: they are dealt out by their document
    slot = F.when(F.col("slot") < 0, F.pmod(F.xxhash64("doc_id", "key"), F.lit(slots)).cast("int")).otherwise(F.col("slot"))
    return table.repartitionById(slots, slot).mapInArrow(run, "doc_id long, key long, runs binary, open binary")


def context_table(docs: DataFrame, shards: int) -> DataFrame:
    """(shard, rows, bytes): the contexts still open, of docs (doc_id, key, text, open), packed by shard.

    An anchor with many classes is not kept together: its strings are dealt out
    by the bytes that all strings with the anchor in one of KINDS stretches
    share, so equal strings still meet.
    """
    edges = np.linspace(0, SPAN, KINDS + 1).astype(int)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size, seen = 0, set()
        for b in batches:
            for doc, key, text, left in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (doc, key) in seen:  # equal rows count as one
                    continue
                seen.add((doc, key))
                data = text.encode()
                for part in left:
                    for start, n, h, back, many in np.frombuffer(part, OPEN).tolist():
                        if not many:
                            spans = [(h % shards, start, n)]
                        else:
                            spans = []
                            place = start + back
                            for low, high in zip(edges[:-1], edges[1:] - 1, strict=True):
                                a, z = max(start, place - high), min(start + n - 1, place - low)
                                if a <= z:
                                    core = hashlib.blake2b(data[place - low : place - high + LENGTH] + low.tobytes(), digest_size=8)
                                    spans.append((int.from_bytes(core.digest()) % shards, a, z - a + 1))
                        for shard, a, k in spans:
                            held.setdefault(shard, []).append(((doc is None, doc or 0, key, a, k), data[a : a + k + LENGTH - 1]))
                            size += k + LENGTH
                if size >= TOGETHER:
                    yield from given(held)
                    held, size, seen = {}, 0, set()
        if held:
            yield from given(held)
        give_back()

    def given(held: dict[int, list]) -> Iterator[pa.RecordBatch]:
        pressed = zstandard.ZstdCompressor(level=1).compress
        for shard, own in held.items():
            rows, data = np.array([r for r, _ in own], CONTEXT), b"".join(x for _, x in own)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([pack(rows)], pa.binary()), pa.array([pressed(data)], pa.binary())], names=["shard", "rows", "bytes"])

    return docs.select("doc_id", "key", "text", "open").mapInArrow(run, "shard int, rows binary, bytes binary")


def sorted_shards(contexts: DataFrame, shards: int, room: int = ROOM) -> DataFrame:
    """(doc_id, key, runs, open): by document, the strings that stand earlier in the contexts of their shard; open is null."""
    names = ["doc_id", "key", "runs", "open"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, parts = [], []
        for b in batches:
            rows += [unpack(x, CONTEXT) for x in b.column(1).to_pylist()]
            parts += [np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8) for x in b.column(2).to_pylist()]
        if rows:
            found = repeats(np.concatenate(rows), parts, room)
            own = np.empty(len(found), CONTEXT)
            for c in ("none", "id", "key"):
                own[c] = found[c]
            runs = np.empty(len(found), RUN)
            runs["start"], runs["end"] = found["start"], found["start"] + (found["n"] + LENGTH - 1)
            yield from by_document({"runs": own}, {"runs": runs}, names)
        del rows, parts
        give_back()

    return contexts.repartitionById(shards, "shard").mapInArrow(run, "doc_id long, key long, runs binary, open binary")


def repeats(rows: np.ndarray, parts: list[np.ndarray], room: int) -> np.ndarray:
    """Of contexts and their bytes, the runs of strings that stand at an earlier place too, as contexts."""
    sizes = rows["n"].astype(np.int64) + LENGTH - 1
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    store = Store(room)
    text = store.array(int(starts[-1]) + 1, np.uint16)
    text[:] = 1
    text[-1] = 0
    at = done = 0
    for part in parts:  # bytes follow one another, contexts are parted by 1
        ends = np.cumsum(sizes[at:])
        k = int(np.searchsorted(ends, len(part))) + 1
        own = np.repeat(np.arange(at, at + k), sizes[at : at + k])
        text[done + np.arange(len(part)) + (own - at)] = part.astype(np.uint16) + 2
        done += len(part) + k
        at += k
    parts.clear()
    order = np.lexsort((rows["key"], rows["id"], rows["none"]))
    new = np.zeros(len(rows), np.int64)
    for c in ("none", "id", "key"):
        new[1:] |= rows[c][order][1:] != rows[c][order][:-1]
    doc = np.empty(len(rows), np.int64)
    doc[order] = np.cumsum(new)
    width = int(rows["start"].max()) + SPAN + 1
    array = suffix_array(text, 257, store, depth=LENGTH)
    before, same = None, np.arange(LENGTH)
    whole: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a in range(0, len(array), 1 << 16):
        p = np.asarray(array[a : a + (1 << 16)])
        c = np.searchsorted(starts, p, side="right") - 1
        keep = (p < starts[-1]) & (p - starts[c] < rows["n"][np.minimum(c, len(rows) - 1)])
        p, c = p[keep], c[keep]
        if not len(p):
            continue
        line = text[p[:, None] + same]
        new = np.ones(len(p), bool)
        new[1:] = (line[1:] != line[:-1]).any(axis=1)
        if before is not None:
            new[0] = (line[0] != before).any()
        before = line[-1].copy()
        whole.append((p, doc[c] * width + rows["start"][c] + p - starts[c], new))
    if not whole:
        store.close()
        return rows[:0]
    p, place, new = map(np.concatenate, zip(*whole, strict=True))
    cuts = np.flatnonzero(new)
    later = place > np.repeat(np.minimum.reduceat(place, cuts), np.diff([*cuts, len(place)]))
    p = np.sort(p[later])
    store.close()
    if not len(p):
        return rows[:0]
    c = np.searchsorted(starts, p, side="right") - 1
    first = np.flatnonzero(np.concatenate([[True], (np.diff(p) != 1) | (np.diff(c) != 0)]))
    out = rows[c[first]].copy()
    out["start"] += p[first] - starts[c[first]]
    out["n"] = np.diff([*first, len(p)])
    return out


def repeated_strings(docs: DataFrame) -> DataFrame:
    """(doc_id, key, runs): for each document of docs (doc_id, key, text) with copies, the bytes they cover, as arrays of packed runs."""
    spark = docs.sparkSession
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    slots = max(shuffle_partitions(spark), -(-total // SLOT))
    found = stage(classes(anchor_table(docs, slots), slots), "string-classes")
    left = found.filter("open is not null").groupBy("doc_id", "key").agg(F.collect_list("open").alias("open"))
    entries = found.agg(F.coalesce(F.sum(F.octet_length("open")), F.lit(0))).first()[0] // OPEN.itemsize
    shards = max(shuffle_partitions(spark), -(-entries * (LENGTH + SPAN // 2) // SHARD))
    match = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key"))
    contexts = docs.join(left.withColumnsRenamed({"doc_id": "of", "key": "of_key"}), match)
    runs = stage(sorted_shards(context_table(contexts, shards), shards), "string-repeats")
    every = found.filter("runs is not null").unionByName(runs)
    return every.groupBy("doc_id", "key").agg(F.collect_list("runs").alias("runs"))


def dedup_strings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ("doc_id",), kept: bool = True) -> DataFrame:
    """The kept columns of every row, n_bytes, n_removed, n_spans, spans (starts and ends of what is removed), kept_sha256 and kept_bytes.

    Removed is every byte that a string of LENGTH bytes covers which also starts
    earlier: in a document with a smaller doc_id (an integer; null ids last), or
    in the same document before. Of different texts with the same doc_id the one
    with the smaller hash comes first; rows equal in both count as one document
    and are treated alike. Strings never cross documents. Null and empty texts
    stay as they are, with nothing removed; an empty table gives an empty result.
    Equality of contexts is that of two hashes of 64 bits together. kept_bytes
    is null unless kept is true; cut characters may not be valid UTF-8.
    """
    names = [f"c{i}" for i in range(len(keep))]
    source = docs.select(docs[doc_id].cast("long"), F.coalesce(docs[text].cast("string"), F.lit("")), *[docs[c] for c in keep]).toDF("doc_id", "text", *names)
    source = source.withColumn("key", F.xxhash64("text"))
    found = repeated_strings(source.select("doc_id", "key", "text")).withColumnsRenamed({"doc_id": "of", "key": "of_key"})
    match = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key"))
    rows = source.join(found, match, "left").select(*names, "text", "runs")
    out = ["n_bytes", "n_removed", "n_spans", "spans", "kept_sha256", "kept_bytes"]
    pair = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                found: list[list] = [[] for _ in out]
                for text, runs in zip(part.column(len(names)).to_pylist(), part.column(len(names) + 1).to_pylist(), strict=True):
                    data = text.encode()
                    gone = np.frombuffer(b"".join(runs or []), RUN)
                    gone = joined_runs(gone["start"], gone["end"])
                    left = b"".join(data[a:b] for a, b in zip([0, *gone["end"].tolist()], [*gone["start"].tolist(), len(data)], strict=True))
                    for o, v in zip(found, (len(data), len(data) - len(left), len(gone), [x for r in gone.tolist() for x in r], hashlib.sha256(left).hexdigest(), left if kept else None), strict=True):
                        o.append(v)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pair, pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], *map(pa.array, found, kinds)], names=[*names, *out])
        give_back()

    schema = ", ".join([*(f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, keep, strict=True)), "n_bytes long, n_removed long, n_spans long, spans array<long>, kept_sha256 string, kept_bytes binary"])
    return rows.mapInArrow(run, schema).toDF(*keep, *out)
