"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseforge.llm import best_fit, bpe, decontaminate, html_text, interactions, langid, packing, pii, quality, secrets, simhash, substrings

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op3_packing(spark, sf_dir):
    pieces = packing.pack_documents(read(spark, sf_dir), vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "window", "step_group")


@query
def op8_token_counts(spark, sf_dir):
    return bpe.token_counts(read(spark, sf_dir), vocabulary())


@query
def op2_quality(spark, sf_dir):
    found = quality.rules(read(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op4_secrets(spark, sf_dir):
    return secrets.digest(read(spark, sf_dir), path=secrets.ledger_folder(spark))


@query
def op1_pii(spark, sf_dir):
    return pii.digest(read(spark, sf_dir))


@query
def op7_simhash(spark, sf_dir):
    return simhash.digest(read(spark, sf_dir))


@query
def op10_decontaminate(spark, sf_dir):
    return decontaminate.contaminated(read(spark, sf_dir), read(spark, sf_dir, "benchmark"))


@query
def op5_language(spark, sf_dir):
    return langid.identify(read(spark, sf_dir))


@query
def op9_html_text(spark, sf_dir):
    return html_text.extract(read(spark, sf_dir, "pages"))


@query
def op6_substrings(spark, sf_dir):
    return substrings.digest(read(spark, sf_dir))


@query
def op11_filter_audit(spark, sf_dir):
    return interactions.audit(read(spark, sf_dir), read(spark, sf_dir, "labels"))


ORACLES["op11_filter_audit"] = interactions.SQL


@query
def op12_best_fit(spark, sf_dir):
    pieces = best_fit.pack_documents(read(spark, sf_dir), vocabulary("byte_bpe_50k.json"))
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset", "doc_tokens")
