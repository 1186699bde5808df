"""A corpus, stage by stage: each stage works on all that the one before kept, written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweave.llm import langid, minhash, mixing, pieces, pii
from geoweave.llm.common import forget, stored, table
from geoweave.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the learned languages go: those without any letter, and those whose n-grams the model does
    not know. A missing language becomes the predicted one. The score is not asked: short texts score low."""
    model = langid.train(docs)
    told = langid.predict(docs.select(*COLUMNS), model, keep=COLUMNS, known=True)
    return told.where("lang_pred <> 'und' AND known").withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the text with the smallest id stays, as one row, if its rows repeat. One id with
    different texts is as many documents; rows without an id come last, in the order of their texts' hashes."""
    digest = F.coalesce(F.unhex(F.md5("text")), F.lit(b""))
    # what decisions go by: never null, in the order in which a document stands for its copies
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), digest.alias("digest"))
    keyed = docs.select(*COLUMNS, key.alias("key"))
    found = minhash.near_duplicates(keyed, id_col="key", words=5, percent=80)
    go = found.where(~F.col("kept")).select("key").distinct()
    rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
    one = keyed.join(go, "key", "left_anti").groupBy("key").agg(F.min(F.struct(*rest, "doc_id", "text")).alias("row"))
    return one.select(*(F.col(f"row.{c}").alias(c) for c in COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span is replaced by its kind; n_chars follows."""
    found = pii.find(docs.select(*COLUMNS))
    clean = F.when(F.size("pii") > 0, pii.masked("text", "pii")).otherwise(F.col("text"))
    return found.withColumn("clean", clean).select("doc_id", F.col("clean").alias("text"), "lang", "source", F.length("clean").cast("long").alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each repetition that the mix takes of a document."""
    mixed = mixing.repeated(mixing.mix(docs, keep=("text", "lang", "source")))
    return mixed.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.digests(pieces.encode_decode(docs, tokenizer_path("piece_bpe_32k.model")))


STAGES = [("language_id", language), ("minhash_dedup", near_duplicates), ("pii", personal_data), ("mixing", mixture), ("sentencepiece", encoding)]
#: The stages' models, hashes and token ids are not SQL's to make.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written to the shared folder; those that it has read go as soon as they are."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
