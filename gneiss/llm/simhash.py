"""SimHash near-duplicates: fingerprints, and the links between them by a generalised pigeonhole search.

The 64 bits are split into groups of correlated bits. If two fingerprints
differ in at most t bits and the thresholds t_i of the groups satisfy
sum(t_i + 1) = t + 1, some group differs in at most t_i bits (a group with
t_i = -1 is not searched). Thresholds need not be equal: dynamic programming
picks those with the fewest estimated candidates, from counts over all
fingerprints. Each group is probed with the values within t_i bits, and what
shares a value is verified on the whole fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from gneiss.llm.arrow import map_texts
from gneiss.plans.components import connected_components
from gneiss.session import shuffle_partitions
from gneiss.staging import drop, stage

BITS = 64
#: 4-word shingles and at most 4 differing bits, as the near-duplicate contract sets them.
WORDS, MOST_BITS = 4, 4
#: Rows of one probed value that one task compares; larger values are split into blocks of half as many.
HOT = 8192
#: Relative cost of shuffling a probe against verifying a candidate pair.
PROBE_COST = 100.0
#: [256, 8]: the bits of each byte.
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
OFFSETS = np.arange(8, dtype=np.int64) * 256
PLACES = np.uint64(1) << np.arange(64, dtype=np.uint64)


def majority(counts: np.ndarray, total: int) -> int:
    """The bits that are set in over half of total hashes; counts has how often each of their eight bytes has each value."""
    ones = np.einsum("kv,vb->kb", counts.reshape(8, 256), BYTE_BITS).ravel()
    return int(PLACES[2 * ones > total].sum(dtype=np.uint64))


def byte_counts(hashes: np.ndarray) -> np.ndarray:
    return np.bincount((hashes.view(np.uint8).reshape(-1, 8) + OFFSETS).ravel(), minlength=2048)


def fingerprint(text: str, words: int = WORDS) -> int:
    """A bit is 1 if more than half of the shingles' XXH64 hashes (seed 42) have it; no words: 0."""
    found = text.encode().lower().split()  # bytes: A-Z and the six ASCII white-space characters only
    n = len(found)
    if not n:
        return 0
    joined, hashed = b" ".join(found), xxhash.xxh64_intdigest
    if n <= words:
        return hashed(joined, 42)
    ends = list(accumulate(map(len, found), lambda a, b: a + b + 1))
    starts = [0, *[e + 1 for e in ends[: n - words]]]
    counts = np.zeros(2048, np.int64)
    total = n - words + 1
    for at in range(0, total, 65536):
        h = np.array([hashed(joined[a:b], 42) for a, b in zip(starts[at : at + 65536], ends[at + words - 1 : at + words - 1 + 65536], strict=False)], dtype="<u8")
        counts += byte_counts(h)
    return majority(counts, total)


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and fp, the fingerprint as a signed long."""

    def factory():
        return lambda texts: [pa.array(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))]

    return map_texts(docs, text, list(keep), [("fp", T.LongType())], factory)


def bit_counts(reps: DataFrame) -> np.ndarray:
    """[64, 64]: fingerprints that have both bits set, over all rows; 4,096 sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        for b in batches:
            v = b.column(0).to_numpy().view(np.uint8).reshape(-1, 8)
            for at in range(0, len(v), 65536):
                x = np.unpackbits(v[at : at + 65536], axis=1, bitorder="little").astype(np.float32)
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS)), pa.array(total.ravel().astype(np.int64))], names=["k", "n"])

    out = np.zeros(BITS * BITS)
    for k, n in reps.select("fp").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n")).collect():
        out[k] = n
    return out.reshape(BITS, BITS)


def group_bits(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """m groups of bits of about equal size; a group starts at the strongest pair left and takes what correlates with it most."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, -1)
    left, groups = set(range(BITS)), []
    for k in range(m):
        size = (BITS - sum(map(len, groups))) // (m - k)
        idx = sorted(left)
        sub = corr[np.ix_(idx, idx)]
        a, b = divmod(int(sub.argmax()), len(idx))
        own = [idx[a], idx[b]] if size > 1 else [idx[a]]
        while len(own) < size:
            rest = sorted(left - set(own))
            own.append(rest[int(corr[np.ix_(rest, own)].mean(axis=1).argmax())])
        left -= set(own)
        groups.append(sorted(own))
    return groups


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def mask_of(bits: list[int] | tuple[int, ...]) -> int:
    return signed(sum(1 << b for b in bits))


def literal(x: int) -> str:
    return f"{x}L" if x > -(1 << 63) else "(-9223372036854775807L - 1L)"


def equal_pairs(reps: DataFrame, masks: list[int]) -> dict[int, int]:
    """For each mask, the pairs of fingerprints that agree on its bits, counted over all rows."""
    values = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(masks)])).alias("s")
    sums = reps.select(values).groupBy("s.i", "s.v").count().groupBy("i").agg(F.sum(F.expr("cast(count as double) * (count - 1) / 2")))
    return {i: int(x) for i, x in sums.collect()}


def allocate(groups: list[list[int]], pairs: list[float], agree: np.ndarray, n: int, most: int) -> tuple[float, list[int]]:
    """The thresholds of least estimated cost with sum(t + 1) = most + 1, by dynamic programming over the groups."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for bits, same in zip(groups, pairs, strict=True):
        odds = (1 - agree[bits]) / agree[bits]
        ways = np.zeros(most + 1)
        ways[0] = 1
        for o in odds:
            ways[1:] += ways[:-1] * o
        costs = {-1: 0.0}
        for t in range(most + 1):
            if t <= len(bits):
                probes = 1 + sum(comb(len(bits), d) for d in range(1, t + 1)) / 2
                floor = n * n / 2 / 2.0 ** len(bits)
                costs[t] = PROBE_COST * n * probes + max(same, floor) * ways[: t + 1].sum()
        after: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, ts) in best.items():
            for t, c in costs.items():
                if (u := used + t + 1) <= most + 1 and (u not in after or cost + c < after[u][0]):
                    after[u] = (cost + c, [*ts, t])
        best = after
    return best.get(most + 1, (float("inf"), []))


def plan_search(reps: DataFrame, n: int, most: int = MOST_BITS) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each group that is searched: the cheapest of two to five groups under the estimates."""
    both = bit_counts(reps)
    p = np.diag(both) / max(n, 1)
    agree = np.clip(p * p + (1 - p) * (1 - p), 0.5, 1 - 1e-6)
    options = [group_bits(both, n, m) for m in range(2, most + 2)]
    found = equal_pairs(reps, [mask_of(g) for o in options for g in o])
    plans, k = [], 0
    for groups in options:
        cost, ts = allocate(groups, [found.get(k + i, 0) for i in range(len(groups))], agree, n, most)
        k += len(groups)
        plans.append((cost, [(g, t) for g, t in zip(groups, ts, strict=False) if t >= 0]))
    return min(plans, key=lambda x: x[0])[1]


def probes(reps: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """(i, v, fp, own): a row for each value that fp is looked up by in group i; own marks its own value.

    Of two fingerprints that differ in a set of bits, one has a 0 in the lowest
    of them, so only that one probes the other's value.
    """
    rows = []
    for i, (bits, t) in enumerate(plan):
        value = f"(fp & {literal(mask_of(bits))})"
        rows.append(f"array(named_struct('i', {i}, 'v', {value}, 'own', true))")
        flips = [c for d in range(1, t + 1) for c in combinations(bits, d)]
        if flips:
            array = ", ".join(f"named_struct('d', {literal(mask_of(c))}, 'low', {literal(mask_of(c[:1]))})" for c in flips)
            rows.append(f"transform(filter(array({array}), f -> (fp & f.low) = 0), f -> named_struct('i', {i}, 'v', {value} ^ f.d, 'own', false))")
    return reps.select("fp", F.explode(F.expr(f"concat({', '.join(rows)})")).alias("s")).select("s.i", "s.v", "fp", "s.own")


def small_links(fp: np.ndarray, own: np.ndarray, group: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of verified links within groups of adjacent rows, comparing each row with the d-th after it."""
    left, right = [], []
    at, d = np.arange(len(fp) - 1), 1
    while len(at := at[at + d < len(fp)]):
        at = at[group[at] == group[at + d]]
        hit = at[(own[at] | own[at + d]) & (np.bitwise_count(fp[at] ^ fp[at + d]) <= most)]
        left.append(hit)
        right.append(hit + d)
        d += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, int), np.empty(0, int))


def settle(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row number reachable over the links, for every row."""
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        while (nxt := label[label]).tobytes() != label.tobytes():
            label = nxt
        differ = label[a] != label[b]
        a, b = a[differ], b[differ]
    return label


def link_rows(fp: np.ndarray, own: np.ndarray, key: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (fp, fp) of the verified links among rows with equal keys; at most one edge a row."""
    change = np.zeros(len(fp), bool)
    for k in key:
        change[1:] |= k[1:] != k[:-1]
    group = change.cumsum()
    sizes = np.bincount(group)
    big = sizes[group] > 64
    label = np.arange(len(fp))
    rest = np.flatnonzero(~big)
    a, b = small_links(fp[rest], own[rest], group[rest], most)
    label = settle(label, rest[a], rest[b])
    for g in np.flatnonzero(sizes > 64):
        start = int(np.searchsorted(group, g))
        f, o = fp[start : start + sizes[g]], own[start : start + sizes[g]]
        data = np.flatnonzero(o)
        for at in range(0, len(f), 256):
            near = np.bitwise_count(f[at : at + 256, None] ^ f[data][None, :]) <= most
            x, y = np.nonzero(near)
            label = settle(label, x + at + start, data[y] + start)
    linked = np.flatnonzero(label != np.arange(len(fp)))
    return fp[linked], fp[label[linked]]


def linked(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Edges (a, b) between the fingerprints of rows with equal keys that differ in at most most bits."""
    n = shuffle_partitions(rows.sparkSession)
    schema = "a long, b long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts)
            a, b = link_rows(t["fp"].to_numpy().view(np.uint64), t["own"].to_numpy(), [t[k].to_numpy() for k in keys], most)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = [batch.column(batch.schema.get_field_index(k)).to_numpy() for k in keys]
            differ = np.zeros(batch.num_rows, bool)
            for v in last:
                differ |= v != v[-1]
            cut = int(np.flatnonzero(differ)[-1]) + 1 if differ.any() else 0
            if cut:
                yield done([*held, batch.slice(0, cut)])
                held = []
            elif held and any(held[-1].column(held[-1].schema.get_field_index(k))[-1].as_py() != v[0] for k, v in zip(keys, last, strict=True)):
                yield done(held)
                held = []
            held.append(batch.slice(cut))
        if held:
            yield done(held)

    placed = rows.repartition(n, *keys).sortWithinPartitions(*keys, "fp")
    return placed.select(*keys, "fp", "own").mapInArrow(run, schema).distinct()


def links(reps: DataFrame, plan: list[tuple[list[int], int]], most: int = MOST_BITS) -> DataFrame:
    """Edges (a, b) that connect exactly what the links of at most most bits connect.

    Rows of one value are compared in one task. Values with more than HOT rows
    are split into blocks, and each pair of blocks is a task of its own; every
    task returns a spanning forest, never all pairs.
    """
    rows = probes(reps, plan)
    hot = stage(rows.groupBy("i", "v").count().filter(F.col("count") > HOT), "hot")
    if hot.isEmpty():
        return linked(rows, ["i", "v"], most)
    half = HOT // 2
    cold = linked(rows.join(hot.select("i", "v"), ["i", "v"], "left_anti"), ["i", "v"], most)
    blocks = F.expr(f"cast(ceil(count / {half}.0) as int)")
    split = rows.join(hot.withColumn("n", blocks), ["i", "v"]).withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    pairs = split.select("i", "v", "fp", "own", "mine", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other"))
    pairs = pairs.select("i", "v", "fp", "own", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"))
    return cold.unionByName(linked(pairs, ["i", "v", "x", "y"], most))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = MOST_BITS) -> DataFrame:
    """doc_id, key, fp (signed long), component_id and head for every row of docs.

    component_id is the smallest doc_id reachable over links of at most most
    differing bits; head is the smallest fingerprint of the component and key
    the text's hash. Texts without words have the fingerprint zero and link like
    any other. Rows with a null doc_id take part; a component of nulls alone has
    a null id. Repeated rows are returned as often as they come. Documents with
    equal fingerprints are reduced to one before anything is linked, so a
    large group of copies costs one row; an empty table gives an empty result.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    prints = stage(fingerprints(source.withColumn("key", F.xxhash64("text")), keep=("doc_id", "key")), "fingerprints")
    reps = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    n = reps.count()
    if n < 2:
        final = reps.select("fp", F.col("rep").alias("component_id"), F.col("fp").alias("head"))
    else:
        edges = stage(links(reps, plan_search(reps, n, most), most), "links")
        nodes = connected_components(edges)
        members = nodes.join(reps, F.col("node") == F.col("fp")).select("fp", "component", "rep")
        least = members.groupBy("component").agg(F.min("rep").alias("least"))
        found = members.join(least, "component").select("fp", "least", "component")
        final = reps.join(found, "fp", "left").select("fp", F.when(F.col("component").isNull(), F.col("rep")).otherwise(F.col("least")).alias("component_id"), F.coalesce("component", "fp").alias("head"))
        final = stage(final, "heads")
        drop(edges)
    return prints.join(final, "fp").select("doc_id", "key", "fp", "component_id", "head")
