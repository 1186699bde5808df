"""The queries of the training-data operators, with the parameters they run in production with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweave.llm import hosts, imatch, langid, minhash, mixing, packing, pieces, pii, sql, topk, toxicity
from geoweave.llm.common import crc_mod, table

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(pieces.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model")))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=5, percent=85)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.find(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, length=2048, pad=50256)


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), crc_mod("doc_id", 5) == 0
    model = toxicity.train(docs.where(~held), table(spark, sf_dir, "labels").where(~held))
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), crc_mod("doc_id", 4) == 2
    model = langid.train(docs.where(~held))
    return langid.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op9_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes are what a page's own url says: that a rule blocks it, or that its host's name has a word of spam."""
    return hosts.judge(table(spark, sf_dir, "pages").select("page_id", "url"), None, RULES)


def op10_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return imatch.with_next(docs, imatch.lexicon(docs))


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op3_pii: all but the added spans."""
    return op3_pii(spark, sf_dir).drop("spans")


def imatch_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op10_imatch: the edited texts."""
    return op10_imatch(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_minhash, op3_pii, op4_mixing, op5_packing, op6_topk, op7_toxicity, op8_langid, op9_hosts, op10_imatch, pii_base, imatch_edits)}

ORACLES = {"pii_base": sql.PII_BASE, "imatch_edits": sql.EDITS, "op2_minhash": sql.MINHASH, "op4_mixing": sql.MIXING, "op6_topk": sql.TOPK, "op9_hosts": sql.hosts(RULES)}
