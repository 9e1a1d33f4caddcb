"""The registered queries of the operators. Each is thin: it reads a whole table, applies an operator, names columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit, scores

    docs = table(spark, sf_dir, "documents")
    return scores(docs, fit(docs, table(spark, sf_dir, "labels")))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import sniffed, stored

    return sniffed(stored(table(spark, sf_dir, "documents")))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(table(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import classes

    return classes(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import report

    return report(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import removed

    return removed(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive, captures, histories

    return histories(captures(archive(table(spark, sf_dir, "pages")))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "captured_at")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encoded

    return encoded(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokens import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .extract import extracted

    return extracted(table(spark, sf_dir, "pages"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .audit import audit

    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .codes import compressed

    return compressed(table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from .oracles import SQL

    return dict(SQL)
