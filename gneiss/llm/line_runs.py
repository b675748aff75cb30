"""Line dedup by a suffix array over the sequences of line ids.

All documents' lines form one sequence in doc_id order; a suffix ends with its
document. The suffix array is built by distributed prefix doubling, two steps
to a round: a position's rank among prefixes of h lines and the ranks h, 2h and
3h lines further on give its rank among prefixes of 4h lines, until ranks no
longer split. The longest common prefix of neighbours comes from the round that
parted them. In the
array, the intervals with a common prefix are the places of a repeated run; for
each position the longest prefix that an earlier place shares is found by one
walk over the array each way, in blocks that hand on what is still open. What
is long enough in words and stands earlier too is a later copy, and goes.

Before that, documents with the same lines are reduced to the first of them,
and a line that stands at one place only ends a suffix, as no repeated run can
hold it; what is left of such cuts with too few words takes no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F, types as T

from gneiss.llm.arrow import map_texts, numbered
from gneiss.plans.joins import spread_join
from gneiss.plans.ordering import place_by_bounds, running_total
from gneiss.session import shuffle_partitions
from gneiss.staging import drop, stage

#: Words from which a repeated run is deleted.
MIN_WORDS = 50
#: Ranks put together in a round, so many prefixes of h lines in a row.
STEPS = 4
#: Neighbouring suffixes that one task walks over.
BLOCK = 1 << 16
#: Stands for a common prefix without end.
OPEN = (1 << 31) - 1
LAST_ID = (1 << 63) - 1


def lines_of(text: str) -> tuple[list[int], list[int], list[int]]:
    """(id, number, words) of each line with a word; lines that differ in white space alone have equal ids."""
    ids, at, words = [], [], []
    for i, line in enumerate(text.split("\n")):
        own = line.encode().split()
        if own:
            ids.append(xxhash.xxh64_intdigest(b" ".join(own), 7))
            at.append(i)
            words.append(len(own))
    return ids, at, words


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, key (the text's hash), seq (the lines' hash), n (lines), total (words), ids, at and words of every row of docs (doc_id, text)."""

    def lists(values: list[list[int]], kind: pa.DataType) -> pa.ListArray:
        ends = np.concatenate([[0], np.cumsum(list(map(len, values)), dtype=np.int64)]) if values else np.zeros(1)
        flat = np.concatenate([np.array(v, np.uint64) for v in values]) if values else np.zeros(0, np.uint64)
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.view(np.int64)).cast(kind))

    def factory():
        def work(texts: list[str]) -> list:
            rows = list(map(lines_of, texts))
            seqs = np.array([xxhash.xxh64_intdigest(np.array(r[0], np.uint64).tobytes(), 9) for r in rows], np.uint64).view(np.int64)
            totals = [sum(r[2]) for r in rows]
            return [pa.array(seqs), [len(r[0]) for r in rows], totals, lists([r[0] for r in rows], pa.int64()), lists([r[1] for r in rows], pa.int32()), lists([r[2] for r in rows], pa.int32())]

        return work

    longs, ints = T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType())
    fields = [("seq", T.LongType()), ("n", T.LongType()), ("total", T.LongType()), ("ids", longs), ("at", ints), ("words", ints)]
    return map_texts(docs.withColumn("key", F.xxhash64("text")), "text", ["doc_id", "key"], fields, factory)


def counted(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, int, int, int]:
    """(keys and c, rows, distinct keys, rows of the most frequent), the table staged in ranges of the keys."""
    groups = rows.groupBy(*keys).agg(F.count("*").alias("c")).repartitionByRange(shuffle_partitions(rows.sparkSession), *keys)
    groups = stage(groups.withColumn("slot", F.spark_partition_id()), "ranks")
    total, distinct, largest = groups.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.max("c"), F.lit(0))).first()
    return groups, total, distinct, largest


def active_lines(bodies: DataFrame, min_words: int) -> DataFrame:
    """A row for each position that can lie in a repeated run.

    pos, start (of its document), seg and end (bounds of the repeated lines in a
    row around it), id, before (the id ahead of it in its segment), words, at.
    """
    repeated = stage(bodies.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("c")).filter("c > 1"), "repeated")
    total, largest = repeated.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.max("c"), F.lit(0))).first()
    rows = bodies.select("start", F.posexplode(F.arrays_zip("ids", "at", "words")).alias("i", "x"))
    rows = rows.select("start", (F.col("start") + F.col("i")).alias("pos"), F.col("x.ids").alias("id"), F.col("x.at").alias("at"), F.col("x.words").alias("words"))
    rows = spread_join(rows, repeated, ["id"], "c", total, largest).drop("c")
    along = Window.partitionBy("start").orderBy("pos")
    rows = rows.withColumn("g", F.col("pos") - F.row_number().over(along))
    whole = Window.partitionBy("start", "g")
    rows = rows.withColumns({"seg": F.min("pos").over(whole), "end": F.max("pos").over(whole) + 1, "all": F.sum("words").over(whole), "before": F.lag("id").over(Window.partitionBy("start", "g").orderBy("pos"))})
    return stage(rows.filter(F.col("all") >= min_words).select("pos", "start", "seg", "end", "id", "before", "words", "at"), "active")


def suffix_ranks(active: DataFrame) -> DataFrame:
    """pos, seg, end, rank (suffixes smaller than its own, ends counting as smallest) and level.

    level is the number of lines h whose round gave the position its rank: it
    and the suffix before it agree in h lines, and not in STEPS times as many.
    """
    groups, total, distinct, largest = counted(active, ["id"])
    ranks = running_total(groups, "slot", [F.col("id")], "c", "rank").select("id", F.col("rank").cast("long").alias("rank"), "c")
    rows = spread_join(active.select("pos", "seg", "end", "id"), ranks, ["id"], "c", total, largest)
    rows = stage(rows.select("pos", "seg", "end", "rank", F.lit(0).alias("level")), "doubled")
    drop(groups)
    h, before = 1, 0
    while distinct > before and distinct < total:
        along = Window.partitionBy("seg").orderBy("pos")
        further = {f"next{k}": F.coalesce(F.lead("rank", k * h).over(along), F.lit(-1)) for k in range(1, STEPS)}
        keys = ["rank", *further]
        tuples = stage(rows.withColumns(further), "tuples")
        before = distinct
        groups, total, distinct, largest = counted(tuples, keys)
        if distinct > before:
            ranks = running_total(groups, "slot", [F.col(k) for k in keys], "c", "own").select(*keys, F.col("own").cast("long").alias("own"), "c")
            moved = spread_join(tuples, ranks, keys, "c", total, largest)
            level = F.when(F.col("own") != F.col("rank"), h).otherwise(F.col("level"))
            after = stage(moved.select("pos", "seg", "end", F.col("own").alias("rank"), level.alias("level")), "doubled")
            drop(rows)
            rows = after
        drop(groups)
        drop(tuples)
        h *= STEPS
    return rows


def suffix_array(active: DataFrame, ranks: DataFrame) -> DataFrame:
    """(idx, pos, lcp): all suffixes in order, equal ones by position, with the lines each shares with the one before it.

    A suffix whose own line before it equals that of its neighbour shares one
    line less than the suffix one line earlier does with its own neighbour, so
    only the others are compared, and these from level lines on.
    """
    placed = ranks.join(active.select("pos", "before"), "pos").repartitionByRange(shuffle_partitions(ranks.sparkSession), "rank", "pos")
    placed = stage(placed.withColumns({"slot": F.spark_partition_id(), "one": F.lit(1)}), "sorted")
    array = running_total(placed, "slot", [F.col("rank"), F.col("pos")], "one", "idx").withColumn("idx", F.col("idx").cast("long"))
    array = stage(array.select("idx", "pos", "seg", "end", "rank", "level", "before"), "suffixes")
    last = array.select((F.col("idx") + 1).alias("idx"), *[F.col(c).alias(f"q_{c}") for c in ("pos", "seg", "end", "rank", "before")])
    rows = array.join(last, "idx", "left")
    alone = F.col("q_pos").isNull() | F.col("before").isNull() | F.col("q_before").isNull() | (F.col("before") != F.col("q_before"))
    tied = F.col("q_rank") == F.col("rank")
    known = F.when(~alone, F.lit(None)).when(tied, F.col("end") - F.col("pos")).when(F.col("q_pos").isNull() | (F.col("level") == 0), F.lit(0))
    rows = stage(rows.withColumns({"alone": alone, "lcp": known}).drop("rank", "q_rank", "before", "q_before"), "neighbours")
    segments = active.groupBy("seg").agg(F.sort_array(F.collect_list(F.struct("pos", "id"))).alias("x")).select("seg", F.col("x.id").alias("ids"))
    segments = stage(segments, "segments")
    part = lambda s, p: F.slice("ids", (F.col(p) - F.col(s) + F.col("level") + 1).cast("int"), F.col("level") * (STEPS - 1))
    compared = rows.filter("alone and lcp is null").join(segments, "seg").select("pos", "level", "q_pos", "q_seg", part("seg", "pos").alias("x"))
    compared = compared.join(segments.withColumnRenamed("seg", "q_seg"), "q_seg").select("pos", "level", "x", part("q_seg", "q_pos").alias("y"))
    differ = F.expr("array_position(zip_with(x, y, (a, b) -> not (a <=> b)), true)")
    compared = compared.select("pos", (F.col("level") + F.when(differ > 0, differ - 1).otherwise(F.size("x"))).alias("found"))
    rows = rows.join(compared, "pos", "left").withColumn("until", F.when(F.col("alone"), F.coalesce("found", "lcp") + F.col("pos")))
    along = Window.partitionBy("seg").orderBy("pos")
    shared = F.last("until", ignorenulls=True).over(along) - F.col("pos")
    return stage(rows.select("idx", "pos", F.greatest(shared, F.lit(0)).cast("int").alias("lcp")), "suffix-array")


Stack = list[tuple[int, int]]


def walk(pos: list[int], link: list[int], stack: Stack) -> list[int]:
    """For each suffix in turn, the longest prefix shared with an earlier place passed so far, 0 for none.

    link[i] is what suffix i shares with the one walked over before it. stack
    holds places that may still be met, later ones above earlier ones, each with
    what it shares with the one below; it is left as the walk ends.
    """
    out = []
    for p, low in zip(pos, link, strict=True):
        while stack and stack[-1][0] > p:
            low = min(low, stack.pop()[1])
        if not low:
            stack.clear()
        out.append(low if stack else 0)
        stack.append((p, low))
    return out


def joined(below: Stack, above: Stack, link: int) -> Stack:
    """The stack after a block that alone leaves above, walked over after below; link is what connects the two."""
    (p, low), *rest = above
    low, below = min(low, link), list(below)
    while below and below[-1][0] > p:
        low = min(low, below.pop()[1])
    return [*(below if low else []), (p, low), *rest]


def longest_earlier(array: DataFrame) -> DataFrame:
    """(pos, n): the longest prefix, in lines, that each suffix shares with one at an earlier place.

    The array is walked over in blocks, forwards and backwards. What a block
    leaves open is handed on in a pass over one row a block; a stack has at most
    as many entries as the lines that two neighbouring suffixes share.
    """
    blocks = array.withColumn("block", F.expr(f"idx div {BLOCK}"))
    schema = "block long, head int, up_pos array<long>, up_link array<int>, down_pos array<long>, down_link array<int>"

    def turned(link: list[int], after: int) -> list[int]:
        return [after, *link[:0:-1]]

    def summary(t: pa.Table) -> pa.Table:
        t = t.sort_by("idx")
        pos, link, up, down = t["pos"].to_pylist(), t["lcp"].to_pylist(), [], []
        walk(pos, link, up)
        walk(pos[::-1], turned(link, OPEN), down)
        cols = [[t["block"][0].as_py()], [link[0]], [[p for p, _ in up]], [[n for _, n in up]], [[p for p, _ in down]], [[n for _, n in down]]]
        kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["block", "head", "up_pos", "up_link", "down_pos", "down_link"])

    ends = stage(blocks.groupBy("block").applyInArrow(summary, schema), "block-ends")

    def handed_on(name: str, forwards: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: Stack = []
            link = 0
            for b in batches:
                rows = []
                for r in b.to_pylist():
                    own = list(zip(r[f"{name}_pos"], r[f"{name}_link"], strict=True))
                    rows.append((r["block"], [p for p, _ in held], [n for _, n in held], link))
                    held = joined(held, own, r["head"] if forwards else link)
                    link = r["head"]
                cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
                kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["block", "p", "l", "after"])

        order = F.col("block").asc() if forwards else F.col("block").desc()
        one = ends.repartition(1).sortWithinPartitions(order)
        return one.mapInArrow(run, "block long, p array<long>, l array<int>, after int")

    up, down = handed_on("up", True), handed_on("down", False)
    handed = up.drop("after").join(down.withColumnsRenamed({"p": "dp", "l": "dl"}), "block")

    def settle(rows: pa.Table, hand: pa.Table) -> pa.Table:
        rows = rows.sort_by("idx")
        pos, link = rows["pos"].to_pylist(), rows["lcp"].to_pylist()
        h = hand.to_pylist()[0]
        left = walk(pos, link, list(zip(h["p"], h["l"], strict=True)))
        right = walk(pos[::-1], turned(link, h["after"]), list(zip(h["dp"], h["dl"], strict=True)))[::-1]
        best = np.maximum(np.array(left, np.int32), np.array(right, np.int32))
        some = np.flatnonzero(best)
        return pa.table([rows["pos"].combine_chunks().take(pa.array(some)), pa.array(best[some])], names=["pos", "n"])

    return blocks.groupBy("block").cogroup(handed.groupBy("block")).applyInArrow(settle, "pos long, n int")


def later_copies(active: DataFrame, found: DataFrame, min_words: int) -> DataFrame:
    """(start, runs): each document's runs (s, e, words) that stand earlier too, those that share a line as one."""
    rows = active.join(found, "pos", "left").groupBy("seg").agg(F.first("start").alias("start"), F.sort_array(F.collect_list(F.struct("pos", "words", "at", F.coalesce("n", F.lit(0)).alias("n")))).alias("x"))
    rows = rows.filter("exists(x, y -> y.n > 0)").select("start", F.col("x.words").alias("words"), F.col("x.at").alias("at"), F.col("x.n").alias("n"))
    run = pa.struct([("s", pa.int32()), ("e", pa.int32()), ("words", pa.int64())])

    def merged(words: np.ndarray, at: np.ndarray, n: np.ndarray) -> list[dict]:
        before = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
        s = np.arange(len(n))
        e = s + n
        s = s[before[e] - before[s] >= min_words]
        if not len(s):
            return []
        e = np.maximum.accumulate(e[s])
        new = np.flatnonzero(np.concatenate([[True], s[1:] >= e[:-1]]))
        a, b = s[new], e[np.concatenate([new[1:] - 1, [len(e) - 1]])]
        return [{"s": int(at[i]), "e": int(at[j - 1]) + 1, "words": int(before[j] - before[i])} for i, j in zip(a, b, strict=True)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            runs = [merged(*(np.array(b.column(c)[i].values) for c in (1, 2, 3))) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(runs, pa.list_(run))], names=["start", "runs"])

    kind = "array<struct<s: int, e: int, words: long>>"
    runs = rows.mapInArrow(work, f"start long, runs {kind}").filter("size(runs) > 0")
    return runs.groupBy("start").agg(F.sort_array(F.flatten(F.collect_list("runs"))).alias("runs"))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, key, runs): for each document with later copies, its runs (s, e, words), line numbers with the end exclusive.

    Repeated runs that share a line are given as one.
    """
    lines = stage(line_table(docs).withColumn("rid", F.monotonically_increasing_id()), "lines")
    order = F.coalesce("doc_id", F.lit(LAST_ID)).alias("order")
    ends = [F.element_at("at", 1).alias("s"), (F.element_at("at", -1) + 1).alias("e")]
    narrow = lines.filter("n > 0").select(order, "doc_id", "key", "rid", "seq", "n", "total", *ends)
    narrow = narrow.groupBy("order", "key").agg(*[F.min(c).alias(c) for c in ("doc_id", "rid", "seq", "n", "total", "s", "e")])
    placed = place_by_bounds(narrow, "order", tie=F.col("key")).withColumns({"slot": F.spark_partition_id(), "room": F.col("n") + 1})
    placed = stage(placed, "placed")
    starts = running_total(placed, "slot", [F.col("order"), F.col("key")], "room", "start").withColumn("start", F.col("start").cast("long"))
    starts = stage(starts.drop("slot", "room"), "starts")
    first = stage(starts.groupBy("seq").agg(F.min_by("rid", "start").alias("rid"), F.min("start").alias("start")).select("rid", "start"), "first-of-each")
    whole = starts.join(first.select("rid"), "rid", "left_anti").filter(F.col("total") >= min_words)
    whole = whole.select("doc_id", "key", F.array(F.struct("s", "e", F.col("total").alias("words"))).alias("runs"))
    bodies = stage(lines.select("rid", "ids", "at", "words").join(first.hint("merge"), "rid").drop("rid"), "bodies")
    drop(lines)
    active = active_lines(bodies, min_words)
    drop(bodies)
    found = longest_earlier(suffix_array(active, suffix_ranks(active)))
    runs = later_copies(active, found, min_words).join(starts.select("doc_id", "key", "start"), "start").select("doc_id", "key", "runs")
    return stage(runs.unionByName(whole), "runs")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Every row of docs, its text without later copies of repeated runs, and what was taken out.

    All columns of docs, whatever their names, then two at the end: __runs
    (array of (s, e, words), null where nothing is taken out) and __kept (the
    text left). A run is deleted wherever it stands but at its first place, in
    the order of doc_id, null ids last; rows with the same doc_id follow in the
    order of their texts' hashes, and rows equal in both count as one copy and
    are treated alike. Lines without words belong to no run, and go only between
    deleted lines. Null and empty texts stay as they are. An empty table gives
    an empty result. A run never crosses documents; a line's first place is
    never deleted.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    runs = repeated_runs(source, min_words).select(F.col("doc_id").alias("of"), F.col("key").alias("of_key"), "runs")
    rows = numbered(docs)
    own, body = (rows.columns[docs.columns.index(c)] for c in (doc_id, text))
    rows = rows.withColumn("key", F.xxhash64(F.coalesce(body, F.lit(""))))
    rows = rows.join(runs.hint("merge"), F.col(own).eqNullSafe(F.col("of")) & (F.col("key") == F.col("of_key")), "left").drop("key", "of", "of_key")
    left = f"array_join(filter(split({body}, '\\n', -1), (l, i) -> not exists(runs, r -> i >= r.s and i < r.e)), '\\n')"
    return rows.withColumn("kept", F.expr(f"case when runs is null then {body} else {left} end")).toDF(*docs.columns, "__runs", "__kept")


def dedup_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, removed_lines, runs (start:end line numbers, the end exclusive) and the text left."""
    rows = dedup_lines(docs.select("doc_id", "text"))
    inside = "filter(sequence(0, size(split(text, '\\n', -1)) - 1), i -> exists(__runs, r -> i >= r.s and i < r.e))"
    return rows.select(
        "doc_id",
        F.expr("coalesce(size(split(text, '\\n', -1)), 0)").cast("long").alias("n_lines"),
        F.expr(f"case when __runs is null then 0 else size({inside}) end").cast("long").alias("removed_lines"),
        F.expr("coalesce(array_join(transform(__runs, r -> concat_ws(':', r.s, r.e)), ','), '')").alias("runs"),
        F.coalesce("__kept", F.lit("")).alias("text"),
    )
