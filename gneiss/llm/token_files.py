"""Token ids as Parquet list columns that can be read selectively.

Files hold documents in ascending id order, a range of ids in each file. The
ids are dictionary-encoded 32-bit lists; row groups and pages are kept small
and the column and offset indexes are written, so a reader can take the
lengths alone, or the ids of a few documents.
"""

from __future__ import annotations

import string
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from gneiss.llm.arrow import map_texts
from gneiss.plans.ordering import place_by_bounds, running_total
from gneiss.staging import staged_path

#: Writer settings: bytes of a row group and of a page, rows of a page at most, and the dictionary's bytes.
LAYOUT = {
    "parquet.block.size": str(64 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "1000",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(2 << 20),
    "parquet.page.write-checksum.enabled": "true",
    "compression": "zstd",
}
#: Distinct words whose ids a worker remembers in each of two generations; a word that does not come back is forgotten.
REMEMBERED = 300_000
#: Characters that the pre-tokenizer never joins to a letter before them.
MARKS = string.punctuation


class Unsafe(Exception):
    """White space stands next to white space, so the text is not cut there."""


class WordTokenizer:
    """Whole-text ids from a byte-level BPE tokenizer, remembered word by word.

    The pre-tokenizer always cuts before a space that follows a character other
    than white space, and on both sides of a line feed between two such
    characters, and never looks back over those cuts, so the ids of a text are
    those of its words (each with the space before it) in a row. A word of
    letters and closing marks is cut between the two by the same pre-tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        #: A byte-level vocabulary writes visible Latin-1 bytes as themselves and the others, in order, as 256 and up.
        visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in visible]
        self.byte_chars = [chr(b if b in visible else 256 + hidden.index(b)) for b in range(256)]
        self.blank = self.byte_chars[32]
        #: Ids of a space and a word, and of what starts a line or closes a word; a generation that is full makes way.
        self.words: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}
        self.old_bare: dict[str, bytes] = {}
        self.cut = regex.compile(r"(?<=[^\s\x1c-\x1f\x85])(?= )")
        self.line_feed = self.direct("\n")

    def pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def direct(self, text: str) -> bytes:
        return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def piece(self, text: str, space: str) -> bytes:
        """The ids of a text that the pre-tokenizer leaves whole: merged directly, without offsets."""
        if not text.isascii():
            text = "".join([self.byte_chars[b] for b in text.encode()])
        return self.pack([t.id for t in self.merge(space + text)])

    def look(self, word: str) -> bytes:
        """The ids of a space and a word."""
        if word in self.old_words:
            found = self.old_words[word]
        elif not word or word[-1].isspace():
            raise Unsafe
        else:
            head = word.rstrip(MARKS)
            if not head.isalpha() or not head.isascii() and max(head) >= "\u0530":  # letters in every version of Unicode
                found = self.direct(" " + word)
            elif len(head) < len(word):
                tail = word[len(head) :]
                found = (self.words.get(head) or self.look(head)) + (self.bare.get(tail) or self.look_bare(tail))
            else:
                found = self.piece(word, self.blank)
        if len(word) < 64:
            self.words[word] = found
        return found

    def look_bare(self, word: str) -> bytes:
        """The ids of a word after a line feed, or of closing marks."""
        if word in self.old_bare:
            found = self.old_bare[word]
        elif not word or word[0].isspace() or word[-1].isspace():
            raise Unsafe
        else:
            head = word.rstrip(MARKS)
            if head and (not head.isalpha() or not head.isascii() and max(head) >= "\u0530"):
                found = self.direct(word)
            elif head and len(head) < len(word):
                tail = word[len(head) :]
                found = self.piece(head, "") + (self.bare.get(tail) or self.look_bare(tail))
            else:
                found = self.piece(word, "") if head else self.direct(word)
        if len(word) < 64:
            self.bare[word] = found
        return found

    def age(self) -> None:
        """Lets go of what a generation has not met again."""
        if len(self.words) > REMEMBERED:
            self.words, self.old_words = {}, self.words
        if len(self.bare) > REMEMBERED // 4:
            self.bare, self.old_bare = {}, self.bare

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        self.age()
        get, look, bare, look_bare = self.words.get, self.look, self.bare.get, self.look_bare
        lines = []
        try:
            for line in text.split("\n"):
                first, *words = line.split(" ")
                ids = [get(w) or look(w) for w in words]
                lines.append((bare(first) or look_bare(first)) + b"".join(ids))
            return self.line_feed.join(lines)
        except Unsafe:
            return b"".join(map(self.direct, self.cut.split(text)))


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def tokenize(docs: DataFrame, path: str, end_id: int = 0, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and ids array<int>, each document's ids with end_id behind them."""

    def factory():
        words = tokenizer(path)
        end = end_id.to_bytes(4, "little")

        def work(texts: list[str]) -> list[list]:
            parts = [words.encode(t) + end for t in texts]
            ends = [0, *chain.from_iterable([len(p) // 4] for p in parts)]
            for i in range(1, len(ends)):
                ends[i] += ends[i - 1]
            flat = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(parts))])
            return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)]

        return work

    return map_texts(docs, text, list(keep), [("ids", T.ArrayType(T.IntegerType()))], factory)


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes doc_id, part, n_tokens and ids of every document to folder, in ascending doc_id order.

    part numbers the ranges of ids, nulls first; inside a part documents are
    sorted by doc_id, then by their texts' hash, so repeated rows are kept and
    reruns agree. Null texts count as empty and consist of the end id. Columns
    other than the two named are not read.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    placed = place_by_bounds(source, "doc_id", source=source.select("doc_id"), tie=F.xxhash64("text"))
    placed = placed.withColumn("part", F.spark_partition_id()).withColumn("tie", F.xxhash64("text")).sortWithinPartitions("doc_id", "tie")
    rows = tokenize(placed, path, end_id, keep=("doc_id", "part", "tie"))
    rows.select("doc_id", "part", "tie", F.size("ids").cast("long").alias("n_tokens"), "ids").write.options(**LAYOUT).parquet(folder)


TOKEN_SCHEMA = "doc_id long, part int, tie long, n_tokens long, ids array<int>"


def read_lengths(spark, folder: str) -> DataFrame:
    """doc_id, part, tie, n_tokens and start of every document; reads no ids."""
    rows = spark.read.schema(TOKEN_SCHEMA).parquet(folder).select("doc_id", "part", "tie", "n_tokens")
    return running_total(rows, "part", [F.col("doc_id").asc_nulls_first(), F.col("tie")], "n_tokens", "start")


def checksums(rows: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns and the CRC-32 of each row's ids as little-endian unsigned 32-bit integers."""
    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField("n_ids", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(keep))
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            sums = [zlib.crc32(memoryview(flat[a:b])) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(at[1:] - at[:-1], pa.int64()), pa.array(sums, pa.int64())], names=schema.names)

    return rows.select(*keep, "ids").mapInArrow(run, schema)


def token_digest(docs: DataFrame, path: str, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Writes the token files of docs and returns what a reader finds in them.

    doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of
    every row. An empty table gives an empty result; rows with the same doc_id
    follow each other in the order of their texts' hashes.
    """
    spark = docs.sparkSession
    folder = folder or staged_path(spark, "tokens")
    write_token_files(docs, folder, path, end_id)
    sums = checksums(spark.read.schema(TOKEN_SCHEMA).parquet(folder), ["doc_id", "part", "tie"])
    lengths = spark.read.schema(TOKEN_SCHEMA).parquet(folder).select("part", F.col("n_tokens").alias("n_ids"))
    rows = running_total(sums, "part", [F.col("doc_id").asc_nulls_first(), F.col("tie")], "n_ids", "start", lengths)
    return rows.select("doc_id", F.col("start").cast("long").alias("start"), F.col("n_ids").alias("n_tokens"), "ids_crc32")
