"""From raw documents to token ids: quality rules, line dedup, near-dedup, source mixing, SentencePiece.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gneiss.llm.line_runs import dedup_lines
from gneiss.llm.mixing import mixed_documents
from gneiss.llm.quality import quality_rules
from gneiss.llm.queries import PIECE_BPE, vocabulary
from gneiss.llm.sentencepieces import encode_decode
from gneiss.llm.similar_texts import one_of_each
from gneiss.staging import stage


def with_text(docs: DataFrame, rows: DataFrame, text: str) -> DataFrame:
    """The columns of docs, the first of rows in that order, with another column of rows as text, and n_chars counted anew."""
    columns = []
    for name, field in zip(rows.columns, docs.schema, strict=False):
        if field.name == "text":
            columns.append(F.col(text).alias("text"))
        elif field.name == "n_chars":
            columns.append(F.length(text).cast(field.dataType).alias("n_chars"))
        else:
            columns.append(F.col(name).alias(field.name))
    return rows.select(*columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their failing lines; null and empty texts do not pass, repeated rows fare alike."""
    named = docs.toDF(*[f"__{i}" for i in range(len(docs.columns))])
    text = named.columns[docs.columns.index("text")]
    found = quality_rules(named, text, keep=tuple(named.columns)).filter("kept").select(*named.columns, F.col("cleaned_text").alias("__cleaned"))
    return with_text(docs, found, "__cleaned")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated runs of lines; those with no word left go.

    The first copy is that of the smallest doc_id, null ids last; texts that had
    no word before stay.
    """
    named = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    own, text = (named.columns[docs.columns.index(c)] for c in ("doc_id", "text"))
    found = dedup_lines(named, own, text).filter("__runs is null or __kept rlike '[^\\\\x20\\\\x09-\\\\x0D]'").drop("__runs")
    return with_text(docs, found, "__kept")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that similarities of 0.8 or more on five-word shingles connect: the smallest doc_id, null ids last."""
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in the order of training; those of size 0 are not taken, ties go by doc_id's hash."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, repeated ones too, and hashes of the ids and of the text decoded from them; a null text has the end id alone."""
    found = encode_decode(docs, vocabulary(PIECE_BPE), full=True)
    return found.select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("quality rules", quality), ("line dedup", lines), ("near-dedup", near_duplicates), ("source mixing", mixing), ("sentencepiece", tokens)]

#: SQL has no such hashes, tokenizers or suffix arrays; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents; what a stage returns is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage(docs, name.replace(" ", "-"))
    return docs
