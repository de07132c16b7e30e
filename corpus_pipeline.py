"""A corpus pipeline of five stages over ``documents``. Each stage is (name, function of (spark, docs, sf_dir)); all but the last return documents."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from emberlens.llm import bpe, jaccard, line_dedup, mixing, quality
from emberlens.llm.queries import pattern, ranks_file
from emberlens.shared import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near copies share 80 percent or more of their runs of five words.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (score of 0.5 or more). It learns from the labels' training part; without labels it accepts all.

    Null and empty texts have the score of an empty text. Equal texts are kept or dropped alike, repeated rows and null ids stay rows of
    their own, an empty table stays empty. Columns beside those of documents are dropped, whatever their names: so in every stage.
    """
    rows = quality.training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    net = quality.train([t for t, _ in rows], [q for _, q in rows])
    return quality.score_documents(docs.select(*COLUMNS), net).where("quality_score >= 0.5").drop("quality_score")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier document or line has, short ones included where they are the same. A document that lost lines and has none left that isn't empty goes.

    Earlier: by doc_id, then line number; null ids come last, rows of one doc_id are one document. Null and empty texts and empty lines stay. n_chars
    is counted anew where lines went. Texts are read whole, however long; an empty table stays empty.
    """
    out = line_dedup.dedup_lines(docs.select(*COLUMNS), exact_chars=1)
    lines = F.transform(F.split("text", "\n"), lambda x: F.length(F.trim(x)))
    out = out.where((F.col("dedup_removed") == 0) | (F.array_max(lines) > 0))
    return out.withColumn("n_chars", F.when(F.col("dedup_removed") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicate documents the one with the smallest id.

    Documents without words are in no group and stay, as do rows with a null id; repeated rows of the id that stays are all kept. An empty table stays empty.
    """
    gone = materialize(jaccard.near_classes(docs, words=NEAR_WORDS, percent=NEAR_PERCENT).where("doc_id <> component_id").select("doc_id").distinct(), "near-copies")
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, in the order of the run (files by name, rows in them); what is beyond its source's target is not in it.

    Null sources are one source, null texts have no words, repeated rows are documents of their own, an empty table gives an empty run.
    """
    return mixing.lay_out(mixing.plan_mix(docs.select(*COLUMNS))).select(*COLUMNS)


def in_order(docs: DataFrame) -> DataFrame:
    """Documents and run_position: a row's place, from 0, in the order of the names of the files that it was read from and of the rows in them; rows that come
    from no file stand in the order of their partitions. Only numbers of rows (one for each file or partition) are brought together."""
    try:
        placed = docs.select(*COLUMNS, F.col("_metadata.file_name").alias("run_part"), F.col("_metadata.row_index").alias("run_row"))
    except AnalysisException:  # no table of files
        row = F.monotonically_increasing_id()
        placed = docs.select(*COLUMNS, F.format_string("%010d", F.shiftright(row, 33)).alias("run_part"), row.bitwiseAND(F.lit((1 << 33) - 1)).alias("run_row"))
    before = W.orderBy("run_part").rowsBetween(W.unboundedPreceding, -1)  # a row for each file
    parts = placed.groupBy("run_part").agg(F.count(F.lit(1)).alias("n")).select("run_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("run_start"))
    return placed.join(F.broadcast(parts), "run_part").select(*COLUMNS, (F.col("run_start") + F.col("run_row")).alias("run_position"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of each row's token ids, the digest of the decoded text, and run_position, the row's place in the run: a row for each row, repeated ones too.

    A null text is an empty one, with 0 tokens; texts are encoded whole; an empty table gives no rows.
    """
    return bpe.round_trip(in_order(docs), ranks_file(), pattern(), ["run_position"])


STAGES = [
    ("quality_classifier", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", one_of_each_group),
    ("mix_sources", mix_sources),
    ("bpe", encode),
]
#: The classifier, the near-duplicate classes and BPE are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
