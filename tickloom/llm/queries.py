"""Queries of this subpackage's operators over the tables of a folder, and the same in DuckDB where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import bpe, langid, licenses, media, minhash, mixing, rnnlm, secrets, simhash, tokenfile
from tickloom.llm.common import documents


def op1_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.digest(documents(spark, sf_dir))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(documents(spark, sf_dir))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(documents(spark, sf_dir))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(documents(spark, sf_dir))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(documents(spark, sf_dir))


def op7_gru_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rnnlm.digest(documents(spark, sf_dir))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(licenses.with_path(documents(spark, sf_dir)))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(documents(spark, sf_dir), k=2, percent=80)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(documents(spark, sf_dir))


def queries() -> dict:
    return {
        "op1_token_planes": op1_token_planes, "op2_secrets": op2_secrets, "op3_media": op3_media, "op4_simhash": op4_simhash, "op5_mixing": op5_mixing,
        "op6_language": op6_language, "op7_gru_lm": op7_gru_lm, "op8_licenses": op8_licenses, "op9_minhash": op9_minhash, "op10_bpe": op10_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_secrets": secrets.SQL.replace("{docs}", "documents"), "op5_mixing": mixing.SQL.replace("{docs}", "documents"), "op8_licenses": licenses.SQL.replace("{docs}", "documents"), "op9_minhash": minhash.SQL.replace("{docs}", "documents").replace("{k}", "2")}
