"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnlake.llm import decontamination, digest, filter_audit, html_blocks, license_scan, packing, pii_crf, pitman_yor, quality_rules, resampling, secret_scan, simhash_dedup, source_mixing


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


QUERIES = {
    "op1_simhash_dedup": lambda spark, d: simhash_dedup.op1(_documents(spark, d)),
    "op2_source_mixing": lambda spark, d: source_mixing.op2(_documents(spark, d)),
    "op3_pii_crf": lambda spark, d: pii_crf.op3(_documents(spark, d)),
    "op4_license_scan": lambda spark, d: license_scan.op4(_documents(spark, d)),
    "op5_digest": lambda spark, d: digest.op5(_documents(spark, d)),
    "op6_secret_scan": lambda spark, d: secret_scan.op6(_documents(spark, d)),
    "op7_packing": lambda spark, d: packing.op7(_documents(spark, d)),
    "op8_quality_rules": lambda spark, d: quality_rules.op8(_documents(spark, d)),
    "op9_html_blocks": lambda spark, d: html_blocks.op9(spark.read.parquet(f"{d}/pages.parquet")),
    "op10_pitman_yor": lambda spark, d: pitman_yor.op10(_documents(spark, d)),
    "op11_filter_audit": lambda spark, d: filter_audit.op11(_documents(spark, d), spark.read.parquet(f"{d}/labels.parquet")),
    "op12_decontamination": lambda spark, d: decontamination.op12(_documents(spark, d), spark.read.parquet(f"{d}/benchmark.parquet")),
    "op13_resampling": lambda spark, d: resampling.op13(_documents(spark, d), spark.read.parquet(f"{d}/benchmark.parquet")),
}

ORACLE_SQL: dict[str, str] = {
    "op2_source_mixing": source_mixing.ORACLE_SQL,
    "op4_license_scan": license_scan.ORACLE_SQL,
    "op8_quality_rules": quality_rules.ORACLE_SQL,
    "op11_filter_audit": filter_audit.ORACLE_SQL,
    "op12_decontamination": decontamination.ORACLE_SQL,
    "op13_resampling": resampling.ORACLE_SQL,
}
