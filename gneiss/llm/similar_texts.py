"""Groups of documents whose sets of word shingles have a Jaccard similarity of at least a bound, without a miss.

SimHash comes first: each set has a fingerprint, and fingerprints of few
differing bits are looked for by the operator of gneiss.llm.simhash. What is
found is compared on the whole sets. At a similarity of 0.8 fingerprints differ
in more bits than can be looked for, so a second search completes the links.

Sets are ordered by one order of all shingles, frequent ones last. If two sets
have similarity t or more, each shares with the other at least ceil(t * n) of
its n shingles, so their first n - ceil(t * n) + 1 have one in common. What
shares such a shingle is a candidate and is compared on the whole sets. The
order decides the work alone, never the result; its frequencies are a sample's.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gneiss.llm.arrow import ROWS, map_texts, numbered
from gneiss.llm.simhash import MOST_BITS, byte_counts, links, majority, plan_search
from gneiss.plans.components import connected_components
from gneiss.plans.joins import spread_join
from gneiss.staging import drop, stage

#: Five-word shingles and similarity 0.8, as near-duplicate stages of training data take them.
WORDS, SIMILARITY = 5, 0.8
#: Documents sampled for the frequencies, and frequent shingles sent to all tasks.
SAMPLE, FREQUENT = 4_096, 65_536
#: 64-bit words of parities that a candidate pair is tried on before its sets are read.
LONGS = 16
#: Words of coarse parities that pairs of an open shingle are tried on while they are joined.
COARSE = 4
#: Rows up to which a table of hashes (8 to 24 bytes each) is broadcast; larger ones are shuffled.
FEW = 2_000_000


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """XXH64 hashes of the distinct shingles, ascending; a shorter text is one shingle."""
    found = text.encode().lower().split()
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), 42)], np.uint64).view(np.int64)
    grams = {b" ".join(found[i : i + words]) for i in range(len(found) - words + 1)}
    return np.unique(np.array(list(map(xxhash.xxh64_intdigest, grams)), np.uint64).view(np.int64))


def parities(shingles: np.ndarray, longs: int = LONGS) -> np.ndarray:
    """64 * longs bits: which of as many parts of the shingles have an odd number of members.

    Two sets that differ in d shingles differ in at most d of these bits. The
    halves of twice as many longs, put together by exclusive or, give the same.
    """
    counts = np.bincount((shingles.view(np.uint64) >> np.uint64(20)).astype(np.int64) % (64 * longs), minlength=64 * longs)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def longs_for(n: int) -> int:
    """Longs of a sharp parity: a power of two with four bits or more for each of n shingles."""
    return 1 << max(0, (n - 1) // 16).bit_length()


def set_print(shingles: np.ndarray) -> int:
    """The SimHash of a set's shingles, as a signed long."""
    return int(np.uint64(majority(byte_counts(shingles), len(shingles))).view(np.int64))


def set_id(shingles: np.ndarray) -> int:
    """A hash of the whole set, as a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), 11)).view(np.int64))


def long_lists(values: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(list(map(len, values)), dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(values) if values else np.zeros(0, np.int64)))


def shingle_sets(docs: DataFrame, words: int, similarity: float, last: np.ndarray) -> DataFrame:
    """For every row of docs (doc_id, key, text) what finds and tries its candidates: sid, fp, n, odd, sharp and firsts.

    sid is the hash of its shingle set, fp its SimHash, n its size, odd and sharp its
    parities and firsts the first shingles in the common order. The sets
    themselves, larger than the texts, are made again for candidates alone.
    """
    by_value = np.argsort(last)
    ordered = last[by_value]

    def first(shingles: np.ndarray) -> np.ndarray:
        n = len(shingles)
        rank = np.full(n, -1, np.int64)
        if len(ordered):
            place = np.minimum(np.searchsorted(ordered, shingles), len(ordered) - 1)
            hit = ordered[place] == shingles
            rank[hit] = by_value[place[hit]]
        return shingles[np.argsort(rank, kind="stable")[: n - ceil(similarity * n - 1e-9) + 1]]

    def factory():
        def work(texts: list[str]) -> list:
            sets = [shingle_set(t, words) for t in texts]
            return [
                pa.array(list(map(set_id, sets)), pa.int64()),
                pa.array(list(map(set_print, sets)), pa.int64()),
                pa.array(list(map(len, sets)), pa.int32()),
                long_lists([parities(s) for s in sets]),
                long_lists([parities(s, longs_for(len(s))) for s in sets]),
                long_lists(list(map(first, sets))),
            ]

        return work

    lists = T.ArrayType(T.LongType())
    return map_texts(docs, "text", ["doc_id", "key"], [("sid", T.LongType()), ("fp", T.LongType()), ("n", T.IntegerType()), ("odd", lists), ("sharp", lists), ("firsts", lists)], factory)


def whole_sets(docs: DataFrame, keep: list[str], words: int) -> DataFrame:
    """The kept columns of docs and the shingles of its texts."""

    def factory():
        return lambda texts: [long_lists([shingle_set(t, words) for t in texts])]

    return map_texts(docs, "text", keep, [("shingles", T.ArrayType(T.LongType()))], factory)


def frequent(docs: DataFrame, words: int) -> np.ndarray:
    """Shingles that several sampled documents have, the most frequent last; at most FREQUENT."""
    share = min(1.0, SAMPLE / max(docs.count(), 1))
    sample = docs.filter(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < share * 1_000_000).dropDuplicates(["key"])
    found = whole_sets(sample, ["key"], words).select(F.explode("shingles").alias("s"))
    rows = found.groupBy("s").count().filter("count > 2").orderBy(F.desc("count"), "s").limit(FREQUENT).collect()
    return np.array([r["s"] for r in reversed(rows)], np.int64)


def row_hash() -> Column:
    """Tells rows with equal texts apart by their doc_id, null or not."""
    return F.xxhash64("doc_id", "key").alias("row")


def doublings(similarity: float) -> int:
    """How many times one sharp parity may be doubled against another's when their sets' sizes are similar enough."""
    return ceil(log2(1 / similarity)) + 1


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of sids whose whole sets are similar enough; the sets are made from one text of docs for each candidate."""
    bits = sets.select("sid", "odd", "n").dropDuplicates(["sid"])
    tried = pairs.distinct().join(bits.toDF("a", "x", "nx"), "a").join(bits.toDF("b", "y", "ny"), "b")
    differ = F.expr("aggregate(zip_with(x, y, (p, q) -> bit_count(p ^ q)), 0, (s, d) -> s + d)")
    tried = tried.filter(F.least("nx", "ny") >= F.greatest("nx", "ny") * similarity - 1e-9).filter(differ <= (F.col("nx") + F.col("ny")) * ((1 - similarity) / (1 + similarity)) + 1e-6)
    rough = stage(tried.select("a", "b", "nx", "ny"), "rough-candidates")
    ids = stage(rough.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), "rough-ids")
    fine = sets.select("sid", "sharp").join(F.broadcast(ids) if ids.count() <= FEW else ids, "sid", "left_semi").dropDuplicates(["sid"])
    tried = rough.join(fine.toDF("a", "x"), "a").join(fine.toDF("b", "y"), "b")
    for one, other in (("x", "y"), ("y", "x")):  # sizes this close differ by one doubling at most, unless the bound is low
        half = F.expr(f"zip_with(slice({one}, 1, size({one}) div 2), slice({one}, size({one}) div 2 + 1, size({one}) div 2), (p, q) -> p ^ q)")
        for _ in range(doublings(similarity)):
            tried = tried.withColumn(one, F.when(F.size(one) > F.size(other), half).otherwise(F.col(one)))
    tried = tried.filter(differ <= (F.col("nx") + F.col("ny")) * ((1 - similarity) / (1 + similarity)) + 1e-6)
    pairs = stage(tried.select("a", "b"), "candidates")
    drop(rough)
    ids = stage(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), "candidate-ids")
    chosen = sets.select("sid", "key", row_hash()).join(F.broadcast(ids) if ids.count() <= FEW else ids, "sid", "left_semi")
    chosen = stage(chosen.groupBy("sid").agg(F.min(F.struct("row", "key")).alias("of")).select("sid", "of.*"), "candidate-rows")
    texts = docs.withColumn("row", row_hash()).join(F.broadcast(chosen) if chosen.count() <= FEW else chosen, ["row", "key"])
    own = stage(whole_sets(texts, ["sid"], words).groupBy("sid").agg(F.first("shingles").alias("shingles")), "candidate-sets")
    both = pairs.join(own.select(F.col("sid").alias("a"), F.col("shingles").alias("x")), "a").join(own.select(F.col("sid").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    edges = stage(both.filter(shared / (F.size("x") + F.size("y") - shared) >= similarity).select("a", "b"), "similar")
    drop(own)
    drop(pairs)
    return edges


def print_pairs(sets: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """Pairs (a, b) of sids that SimHash finds.

    Of the sets with one fingerprint each is paired with the smallest; the
    smallest of fingerprints at most most bits apart are paired along spanning
    forests, which connect what all such pairs connect.
    """
    rows = stage(sets.select("fp", "sid").distinct(), "prints")
    reps = stage(rows.groupBy("fp").agg(F.min("sid").alias("least"), F.count("*").alias("rows")), "print-heads")
    n, total, largest = reps.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.max("rows"), F.lit(0))).first()
    same = spread_join(rows, reps, ["fp"], "rows", total, largest).filter("sid <> least").select(F.col("least").alias("a"), F.col("sid").alias("b"))
    if n < 2:
        return same
    near = stage(links(reps.select("fp"), plan_search(reps, n, most), most).toDF("x", "y"), "print-links")
    for end, name in (("x", "a"), ("y", "b")):
        near = near.join(reps.select(F.col("fp").alias(end), F.col("least").alias(name)), end)
    return same.unionByName(near.select("a", "b"))


def labelled(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """rows with c, the smallest sid that edges connect theirs with."""
    label = connected_components(edges).select(F.col("node").alias("sid"), "component")
    return rows.join(F.broadcast(label) if label.count() <= FEW else label, "sid", "left").withColumn("c", F.coalesce("component", "sid")).drop("component")


def open_pairs(apart: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of sids of different components c that share a first shingle s of apart and may be similar enough.

    What their sizes or coarse parities rule out never leaves the join.
    """
    folded = [F.lit(0).cast("long") for _ in range(COARSE)]
    for i in range(LONGS):
        folded[i % COARSE] = folded[i % COARSE].bitwiseXOR(F.col("odd")[i])
    bits = [f"p{i}" for i in range(COARSE)]
    facts = sets.select("sid", "n", *[x.alias(name) for x, name in zip(folded, bits, strict=True)]).dropDuplicates(["sid"])
    wide = apart.select("s", "sid", "c").join(facts, "sid")
    x, y = (wide.select("s", *[F.col(k).alias(f"{k}_{i}") for k in ("sid", "c", "n", *bits)]) for i in (1, 2))
    differ = sum((F.bit_count(F.col(f"{k}_1").bitwiseXOR(F.col(f"{k}_2"))) for k in bits), F.lit(0))
    near = F.least("n_1", "n_2") >= F.greatest("n_1", "n_2") * similarity - 1e-9
    near &= differ <= (F.col("n_1") + F.col("n_2")) * ((1 - similarity) / (1 + similarity)) + 1e-6
    both = x.join(y, "s").filter((F.col("sid_1") < F.col("sid_2")) & (F.col("c_1") != F.col("c_2")) & near)
    return both.select(F.col("sid_1").alias("a"), F.col("sid_2").alias("b"))


def similar_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, key (the text's hash) and head, equal for what similarities of at least the bound connect, for every row of docs.

    SimHash's pairs are compared first. Of the sets that share a first shingle
    and that these links leave apart, each is compared with the smallest next;
    only shingles whose sets are still apart then are compared in pairs.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("key", F.xxhash64("text"))
    sets = stage(shingle_sets(source, words, similarity, frequent(source, words)), "shingle-sets")
    printed = verified(print_pairs(sets), sets, source, words, similarity)
    firsts = labelled(sets.select("sid", "firsts"), printed).select("sid", "c", F.explode("firsts").alias("s"))
    groups = firsts.groupBy("s").agg(F.min(F.struct("c", "sid")).alias("least"), F.max("c").alias("most"), F.count("*").alias("rows")).filter("least.c <> most")
    groups = stage(groups.select("s", F.col("least.c").alias("low"), F.col("least.sid").alias("least"), "rows"), "shared-shingles")
    total, largest = groups.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.max("rows"), F.lit(0))).first()
    shared = stage(spread_join(firsts, groups, ["s"], "rows", total, largest).drop("rows"), "shared")
    drop(groups)
    first = verified(shared.filter("c <> low").select(F.col("least").alias("a"), F.col("sid").alias("b")), sets, source, words, similarity)
    first = stage(printed.unionByName(first), "first-links")
    drop(printed)
    rest = stage(labelled(shared.select("s", "sid"), first), "labelled")
    drop(shared)
    groups = stage(rest.groupBy("s").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("rows")).filter("low <> high").select("s", "rows"), "open-shingles")
    total, largest = groups.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.max("rows"), F.lit(0))).first()
    apart = stage(spread_join(rest, groups, ["s"], "rows", total, largest).drop("rows").distinct(), "apart")
    drop(rest)
    drop(groups)
    pairs = open_pairs(apart, sets, similarity)
    edges = stage(first.unionByName(verified(pairs, sets, source, words, similarity)), "links")
    nodes = connected_components(edges)
    drop(apart)
    drop(first)
    drop(edges)
    found = stage(sets.select("doc_id", "key", "sid"), "sids")
    drop(sets)
    return found.join(nodes.withColumnRenamed("node", "sid"), "sid", "left").select("doc_id", "key", F.coalesce("component", "sid").alias("head"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each group of near-duplicates: the smallest doc_id, then the smallest hash of the text.

    Columns stay as they are, whatever their names. Of rows that agree in doc_id
    and text one stays, whichever; null ids come after all others. Null and
    empty texts, and those of white space alone, are copies of each other. An
    empty table gives an empty result.
    """
    rows = numbered(docs)
    own, body = (rows.columns[docs.columns.index(c)] for c in (doc_id, text))
    rows = rows.withColumns({"id": F.coalesce(own, F.lit((1 << 63) - 1)), "key": F.xxhash64(body)})
    found = stage(similar_groups(rows, "id", body, words, similarity).withColumnRenamed("doc_id", "id").groupBy("id", "key", "head").agg(F.count("*").alias("copies")), "heads")
    groups = stage(found.groupBy("head").agg(F.min(F.struct("id", "key")).alias("first"), F.count("*").alias("n")).filter("n > 1"), "groups")
    total, largest = groups.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    gone = stage(spread_join(found, groups, ["head"], "n", total, largest).filter("struct(id, key) <> first").select("id", "key"), "gone")
    kept = rows.join(F.broadcast(gone) if gone.count() <= FEW else gone, ["id", "key"], "left_anti")
    again = found.filter("copies > 1").select("id", "key")
    if not again.isEmpty():
        one = kept.join(again, ["id", "key"], "left_semi").dropDuplicates(["id", "key"])
        kept = kept.join(again, ["id", "key"], "left_anti").unionByName(one)
    return kept.drop("id", "key").toDF(*docs.columns)
