"""The corpus pipeline: quality rules, line dedup, n-gram Jaccard join, mixing to target weights, BPE coding.

Each stage takes the documents that the one before kept and returns a DataFrame; all but the last return the columns of
documents. run() applies them to the documents table; between stages the rows are written as Parquet in the shared
folder and read again, so a lost executor costs one stage's tasks at most; what a stage wrote for itself goes when its rows
are written. Stages take texts whole, however long, and any columns beside those of documents, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.llm import bpe, line_dedup, mixing, ngram_join, quality
from docengine.llm.common import documents, free
from docengine.llm.queries import tokenizer_path
from docengine.sources.scratch import folder, scope

#: SQL cannot express compression ratios or BPE; tests hold the stages against plain Python.
ORACLE_SQL = None


def _aside(docs: DataFrame, name: str) -> tuple[DataFrame, list]:
    """docs with a column of that name out of an operator's way, and the columns that put it back."""
    (there,) = free(docs, name)
    renamed = docs.withColumnRenamed(name, there)
    return renamed, [F.col(f"`{there}`").alias(c) if c == name else F.col(f"`{c}`") for c in docs.columns]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts have too few words and go. Rows are judged alone, so repeated rows, ties and nulls in other columns
    change nothing. An empty table stays empty.
    """
    return quality.passing(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier document has; one that has nothing but such lines goes.

    n_chars follows the text. A document that loses nothing stays as it is, also without any word or with a null text. Of
    repeated lines the one of the smallest doc_id stays, rows without an id coming last; equal rows keep the same lines. An
    empty table stays empty.
    """
    rows, columns = _aside(docs, "line_dedup")
    deduped = line_dedup.dedup(rows)
    gone = F.col("line_dedup.n_exact") + F.col("line_dedup.n_near")
    left = deduped.where((gone == 0) | (gone < F.col("line_dedup.n_lines")))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(gone > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return left.select(*columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id.

    Rows that share that id all stay; rows without an id stay if no row of their group has one. Null and empty texts are in
    no group. An empty table stays empty.
    """
    rows, columns = _aside(docs, "ngram_join")
    component = F.col("ngram_join.component")
    return ngram_join.join(rows).where(component.isNull() | component.eqNullSafe(F.col("doc_id"))).select(*columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's share of the mix asks for.

    Rows without a source are one source; rows that share an id are taken equally often. A source without words gives
    nothing. An empty table stays empty.
    """
    return mixing.mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and the token ids of each document of the mix, a row for each of its copies; none for null and empty texts."""
    return bpe.encode(docs, tokenizer_path(), keep=["doc_id", "source"]).withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", one_of_near_copies),
    ("mixing sources", mix_sources),
    ("BPE encoding", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        path = folder(spark)
        with scope(spark):
            kept = stage(spark, docs, sf_dir)
            kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
