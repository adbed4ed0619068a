"""Corpus pipeline: toxicity, line dedup, near duplicates, mixing, packing.

Each stage works on all that the one before it kept. All but the last return the columns of
documents: doc_id, text, lang, source, n_chars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thalweg.llm import common, lines, mixing, near, packing, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the toxicity model scores below its threshold."""
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep=COLUMNS[1:])
    return scored.where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated long lines; documents stay, with what is left of their text and its length."""
    out = lines.dedup(docs, keep=COLUMNS[2:4])
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the least id, of each class of five-word shingles at 80 percent.

    Rows that repeat an id are one document, of which the first row by text and the other columns stays.
    Rows with null ids, and documents without words, are classes of their own.
    """
    classes = near.similar_classes(docs, 5, 80).where("doc_id is not null and component_id <> doc_id").select("doc_id").distinct()
    kept = common.keyed(docs, *COLUMNS).join(classes, "doc_id", "left_anti").select(*COLUMNS)
    twice = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if not twice.limit(1).count():
        return kept
    again = kept.join(twice, "doc_id", "left_semi")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(*COLUMNS[1:]))
    return kept.join(twice, "doc_id", "left_anti").unionByName(again.withColumn("_n", first).where("_n = 1").drop("_n"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the budget mix takes it: none, once, twice or three times.

    Rows of equal id, text and source share what the mix takes of them, the first ones the odd copies.
    """
    plan = mixing.mix(docs).groupBy("doc_id", "text_hash", "source").agg(F.sum("copies").alias("all"), F.count("*").alias("rows"))
    rows = common.keyed(docs, *COLUMNS).withColumn("text_hash", mixing.text_hash("text")).alias("d")
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"p.{c}")) for c in ("doc_id", "text_hash", "source")]
    both = rows.join(plan.where("all > 0").alias("p"), same[0] & same[1] & same[2])
    place = F.row_number().over(Window.partitionBy("d.doc_id", "d.text_hash", "d.source").orderBy("d.lang", "d.n_chars"))
    copies = F.floor(F.col("p.all") / F.col("p.rows")) + (F.when(F.col("p.rows") > 1, F.col("_place")).otherwise(1) <= F.col("p.all") % F.col("p.rows")).cast("long")
    both = both.withColumn("_place", place).withColumn("_copies", copies.cast("int")).where("_copies > 0")
    return both.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*[f"d.{c}" for c in COLUMNS])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all that is left into sequences of 4096 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near copies", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Tokens, trained scores and fitted budgets are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each one's result written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
