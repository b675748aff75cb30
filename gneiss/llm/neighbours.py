"""Approximate nearest neighbours by balanced posting lists.

Vectors are put into posting lists around centroids; one near a boundary goes
into several. Centroids are found through an in-memory graph. A query reads the
lists whose centroids are not much farther than its nearest one, by a ratio of
distances that is calibrated on a sample to reach the recall asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gneiss.staging import stage

#: Vectors (and bytes) of the sample that centroids and the ratio are fitted on; vectors of a list; lists at most.
SAMPLE, SAMPLE_BYTES, LIST, LISTS = 65_536, 32 << 20, 128, 4096
#: Lists a vector is put into at most, and how much farther than the nearest they may be.
COPIES, BOUNDARY = 4, 1.10
#: Edges of a centroid in the graph; queries the ratio is calibrated on; recall it aims at.
DEGREE, TRIALS, AIM = 24, 512, 0.985
#: Vectors (and their bytes) and queries that one task compares at once.
BLOCK, BLOCK_BYTES, QUERIES_AT_ONCE = 16_384, 16 << 20, 512


def unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(scale > 0, scale, 1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def balanced_centroids(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """k or more unit centroids; clusters of more than twice the mean size are split until none is left."""
    k = max(1, min(k, len(x)))
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = nearest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        filled = np.abs(sums).sum(axis=1) > 1e-12
        c = np.where(filled[:, None], unit(np.where(filled[:, None], sums, 1.0)), x[rng.integers(0, len(x), len(c))])
    most = max(8, 2 * len(x) // k)
    for _ in range(20):
        own = nearest(x, c)
        sizes = np.bincount(own, minlength=len(c))
        large = np.flatnonzero(sizes > most)
        if not len(large):
            break
        extra = []
        for i in large:
            members = x[own == i]
            a, b = members[rng.integers(0, len(members))], members[rng.integers(0, len(members))]
            for _ in range(4):
                side = members @ a > members @ b
                if side.all() or not side.any():
                    break
                a, b = unit(members[side].sum(axis=0)[None])[0], unit(members[~side].sum(axis=0)[None])[0]
            c[i] = a
            extra.append(b)
        c = np.vstack([c, extra])
    sizes = np.bincount(nearest(x, c), minlength=len(c))
    return c[sizes > 0] if (sizes > 0).any() else c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([(x[i : i + 4096] @ c.T).argmax(axis=1) for i in range(0, len(x), 4096)])


@dataclass
class Index:
    """Centroids, the graph over them, how many are looked at for each vector, and the ratio for queries."""

    centroids: np.ndarray
    graph: np.ndarray
    entry: np.ndarray
    reach: int
    ratio: float

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of about the ef nearest centroids of each row, by best-first search of the graph."""
        k, n = len(self.centroids), len(q)
        ef = min(ef, k)
        if ef * 3 >= k:  # most of the graph would be visited
            sims = q @ self.centroids.T
            ids = np.argsort(-sims, axis=1, kind="stable")[:, :ef]
            return ids, np.sqrt(np.maximum(2 - 2 * np.take_along_axis(sims, ids, 1), 0))
        seen = np.zeros((n, k + 1), bool)
        seen[:, k] = True
        rows = np.arange(n)[:, None]
        ids = np.broadcast_to(self.entry[:ef], (n, min(ef, len(self.entry)))).copy()
        seen[rows, ids] = True
        sims = q @ self.centroids[ids[0]].T
        open_ = np.ones(ids.shape, bool)
        while True:
            rank = np.where(open_, sims, -np.inf)
            pick = np.argpartition(-rank, min(3, rank.shape[1] - 1), axis=1)[:, :4]
            live = np.take_along_axis(rank, pick, 1) > -np.inf
            if not live.any():
                break
            np.put_along_axis(open_, pick, False, 1)
            found = self.graph[np.take_along_axis(ids, pick, 1)]
            found = np.where(live[:, :, None], found, k).reshape(n, -1)
            found.sort(axis=1)
            found[:, 1:][found[:, 1:] == found[:, :-1]] = k
            fresh = ~seen[rows, found]
            seen[rows, found] = True
            values = np.full(found.shape, -np.inf)
            r, c = np.nonzero(fresh)
            values[r, c] = np.einsum("ij,ij->i", q[r], self.centroids[found[r, c]])
            ids = np.hstack([ids, found])
            sims = np.hstack([sims, values])
            open_ = np.hstack([open_, fresh])
            if sims.shape[1] > ef:
                top = np.argpartition(-sims, ef - 1, axis=1)[:, :ef]
                ids, sims, open_ = (np.take_along_axis(a, top, 1) for a in (ids, sims, open_))
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
        return ids, np.sqrt(np.maximum(2 - 2 * np.maximum(sims, -1), 0))

    def homes(self, x: np.ndarray) -> list[np.ndarray]:
        """The lists of each vector: the nearest, and others that are hardly farther and not behind one chosen before."""
        out = []
        for at in range(0, len(x), 1024):
            for row, d in zip(*self.search(x[at : at + 1024], 4 * COPIES), strict=True):
                own = [row[0]]
                for i, far in zip(row[1:], d[1:], strict=True):
                    if len(own) == COPIES or far > BOUNDARY * d[0] + 1e-9:
                        break
                    if (2 - 2 * self.centroids[own] @ self.centroids[i] > far * far * 0.25).all():
                        own.append(i)
                out.append(np.array(own))
        return out

    def lists(self, q: np.ndarray, sizes: np.ndarray, least: int) -> list[np.ndarray]:
        """The lists that each query reads: those within the ratio, and the next ones until they hold least entries.

        sizes are those of all lists; empty ones are passed over.
        """
        ids, dist = self.search(q, self.reach)
        out = []
        for i, (row, d) in enumerate(zip(ids, dist, strict=True)):
            near = int((d <= self.ratio * d[0] + 1e-9).sum())
            held = sizes[row].cumsum()
            if held[-1] < least:  # the lists in reach hold too little
                row = np.argsort(-(self.centroids @ q[i]), kind="stable")
                held = sizes[row].cumsum()
            row = row[: max(near, int(np.searchsorted(held, min(least, held[-1]))) + 1)]
            out.append(row[sizes[row] > 0])
        return out


def fit(sample: np.ndarray, n: int, k_nearest: int, seed: int = 7) -> Index:
    """Fits centroids, graph and ratio on a bounded sample of n vectors."""
    rng = np.random.default_rng(seed)
    x = unit(sample)
    c = balanced_centroids(x, int(min(LISTS, max(1, n // LIST), max(1, len(x) // 16))), rng)
    k = len(c)
    degree = min(DEGREE, k - 1) if k > 1 else 0
    near = np.argsort(-(c @ c.T), axis=1)[:, 1 : degree + 1] if degree else np.zeros((k, 1), int)
    graph = np.hstack([near, rng.integers(0, k, (k, 4))]) if degree else near  # a few far links keep it connected
    index = Index(c, np.vstack([graph, np.full((1, graph.shape[1]), k)]), rng.choice(k, min(16, k), replace=False), k, np.inf)
    homes = index.homes(x)
    tried = rng.choice(len(x), min(TRIALS, len(x)), replace=False)
    q, top = x[tried], []
    for at in range(0, len(q), 16):  # a few rows of distances to the whole sample at once
        sims = q[at : at + 16] @ x.T
        sims[np.arange(len(sims)), tried[at : at + 16]] = -np.inf
        some = np.argpartition(-sims, min(k_nearest, sims.shape[1]) - 1, axis=1)[:, :k_nearest]
        top += [row[s[row] > -np.inf] for row, s in zip(some, sims, strict=True)]
    dist = np.sqrt(np.maximum(2 - 2 * (q @ c.T), 0))
    need = [min(dist[i, homes[j]]) / max(dist[i].min(), 1e-9) for i, row in enumerate(top) for j in row]
    index.ratio = float(max(1.0, np.quantile(need, AIM))) if need else 1.0
    wide = (dist <= index.ratio * dist.min(axis=1, keepdims=True)).sum(axis=1)
    index.reach = int(max(8, np.quantile(wide, 0.99) * 1.1)) if len(wide) else 8
    return index


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, x) of the vectors that take part: finite, not zero, without nulls, of the most common length."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("x")).filter("vec_id is not null and x is not null and size(x) > 0")
    rows = rows.filter("forall(x, v -> v is not null and not isnan(v) and abs(v) < double('infinity')) and exists(x, v -> v <> 0)")
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("x") == (common["d"] if common else 0))


def matrix(column: pa.ListArray) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))


def nearest_neighbours(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", every: int = 50, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found by cosine, ties to the smaller id.

    Queries are the rows whose id is divisible by every; all other rows are
    candidates. Null ids, and vectors that are null, zero, hold null or
    non-finite components or differ in length from most, take no part. Equal
    vectors are indexed once, with the k + 1 smallest ids of their rows, which are
    all that can be among the k nearest of anything; so a very common vector
    costs one entry. Rows repeated with the same id count once. An empty table
    gives an empty result. Lists are packed into blocks of bounded size and a
    query is sent to a block once; scores are taken on the original vectors.
    """
    spark = vectors.sparkSession
    rows = stage(usable(vectors, vec_id, embedding).distinct(), "vectors")
    first = Window.partitionBy("x").orderBy("vec_id")
    groups = rows.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1)
    groups = stage(groups.groupBy("x").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "distinct-vectors")
    n = groups.count()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not n:
        return empty
    dim = groups.select(F.size("x").alias("d")).first()["d"]
    size = min(SAMPLE, max(64, SAMPLE_BYTES // (8 * dim)))
    share = F.pmod(F.xxhash64("x"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, size / n))
    sampled = groups.filter(share).select("x").toArrow().column("x").combine_chunks()
    sample = matrix(sampled if len(sampled) else groups.select("x").limit(64).toArrow().column("x").combine_chunks())
    index = fit(sample, n, k)
    shared = spark.sparkContext.broadcast(index)

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                homes = own.homes(unit(matrix(part.column(0))))
                take = pa.array(np.repeat(np.arange(part.num_rows), list(map(len, homes))))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(homes), pa.int32()), part.column(0).take(take), part.column(1).take(take)], names=["list", "x", "ids"])

    lists = stage(groups.select("x", "ids").mapInArrow(postings, "list int, x array<double>, ids array<long>"), "postings")
    counts = {r["list"]: r["count"] for r in lists.groupBy("list").count().collect()}  # one row a list
    room = max(64, min(BLOCK, BLOCK_BYTES // (8 * dim)))
    blocks, pieces, filled, block = [], {}, 0, 0
    for i in sorted(counts):
        pieces[i] = max(1, -(-counts[i] // room))
        if filled and (filled + counts[i] > room or pieces[i] > 1):
            block, filled = block + 1, 0
        blocks += [(i, p, block + p) for p in range(pieces[i])]
        filled += counts[i] if pieces[i] == 1 else room
        block += pieces[i] - 1
    where = F.broadcast(spark.createDataFrame(blocks, "list int, piece int, block int"))
    many = F.broadcast(spark.createDataFrame(list(pieces.items()), "list int, pieces int"))
    held = lists.join(many, "list").withColumn("piece", F.pmod(F.xxhash64("x"), F.col("pieces")).cast("int")).join(where, ["list", "piece"])

    sizes = np.zeros(len(index.centroids), np.int64)
    for i, c in counts.items():
        sizes[i] = c
    enough = (k + 2) * COPIES  # a vector stands in COPIES lists at most, and one may be the query itself

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                found = own.lists(unit(matrix(part.column(1))), sizes, enough)
                ends = pa.array(np.concatenate([[0], np.cumsum(list(map(len, found)))]), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found), pa.int32()))], names=["query_id", "q", "lists"])

    queries = rows.filter(F.col("vec_id") % every == 0).select("vec_id", "x").mapInArrow(asked, "query_id long, q array<double>, lists array<int>")
    queries = stage(queries.withColumn("at", F.xxhash64("q")), "queries")
    hits = queries.select("query_id", "at", F.explode("lists").alias("list")).join(where, "list")
    hits = hits.groupBy("query_id", "at", "block").agg(F.collect_set("list").alias("lists"))
    sent = hits.join(queries.select("query_id", "at", "q"), ["query_id", "at"])
    sent = stage(sent.select("block", F.pmod(F.xxhash64("query_id"), F.lit(1 << 20)).alias("h"), "query_id", "q", "lists"), "sent")
    crowd = {r["block"]: r["count"] for r in sent.groupBy("block").count().collect()}  # one row a block
    turns = [(b, -(-c // (8 * QUERIES_AT_ONCE))) for b, c in crowd.items()]
    turn = F.broadcast(spark.createDataFrame(turns, "block int, turns int"))
    left = held.join(turn, "block").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).select("block", "turn", "list", "x", "ids")
    right = sent.join(turn, "block").withColumn("turn", (F.col("h") % F.col("turns")).cast("int")).select("block", "turn", "query_id", "q", "lists")

    def compare(a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if a.num_rows and b.num_rows:
            x = matrix(a.column("x").combine_chunks())
            xu, owner, ids = unit(x), a.column("list").to_numpy(), a.column("ids").to_pylist()
            smallest = np.array([i[0] for i in ids])
            spots = {int(i): np.flatnonzero(owner == i) for i in np.unique(owner)}
            for at in range(0, b.num_rows, QUERIES_AT_ONCE):
                part = b.slice(at, QUERIES_AT_ONCE)
                q, names = matrix(part.column("q").combine_chunks()), part.column("query_id").to_pylist()
                qu = unit(q)
                near = np.full((len(q), len(x)), -np.inf)
                readers: dict[int, list[int]] = {}
                for i, wanted in enumerate(part.column("lists").to_pylist()):
                    for w in wanted:
                        readers.setdefault(w, []).append(i)
                for w, who in readers.items():
                    if w in spots:
                        near[np.ix_(who, spots[w])] = qu[who] @ xu[spots[w]].T
                for i, name in enumerate(names):
                    row = near[i]
                    want = min((k + 1) * COPIES + 8, len(row))
                    edge = np.partition(row, len(row) - want)[len(row) - want]
                    pick = np.flatnonzero((row >= edge - 1e-12) & (row > -np.inf))
                    y, z = x[pick], q[i]
                    score = (y * z).sum(axis=1) / (np.sqrt((y * y).sum(axis=1)) * np.sqrt((z * z).sum()))
                    got: dict[int, float] = {}
                    for j in np.lexsort((smallest[pick], -score)):
                        for v in ids[pick[j]]:
                            if v != name and v not in got:
                                got[v] = float(score[j])
                        if len(got) >= k and score[j] < sorted(got.values(), reverse=True)[k - 1]:
                            break
                    best = sorted(got.items(), key=lambda t: (-t[1], t[0]))[:k]
                    out += [(name, v, s) for v, s in best]
        cols = list(zip(*out, strict=True)) if out else [[], [], []]
        return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["query_id", "vec_id", "score"])

    found = left.groupBy("block", "turn").cogroup(right.groupBy("block", "turn")).applyInArrow(compare, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
