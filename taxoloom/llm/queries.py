"""One registered query for each operator, over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .byte_repeats import byte_repeats_digest
from .collocations import collocations
from .decontaminate import contamination_digest
from .exact_dedup import exact_owners
from .html_text import extract_text
from .language_id import predict_languages
from .license_scan import scan_licenses
from .lm_score import score_texts
from .near_dedup import near_components
from .source_mix import mix_sources
from .substring_dedup import repeats_digest
from .token_align import align_tokens
from .url_filter import judge_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def register(f):
        QUERIES[name] = f
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_lm_score")
def op1(spark, sf_dir):
    return score_texts(table(spark, sf_dir, "documents"))


@query("op2_language_id")
def op2(spark, sf_dir):
    return predict_languages(table(spark, sf_dir, "documents"))


@query("op3_html_text")
def op3(spark, sf_dir):
    return extract_text(table(spark, sf_dir, "pages"))


@query("op4_near_dedup")
def op4(spark, sf_dir):
    return near_components(table(spark, sf_dir, "documents"), percent=85)


@query("op5_substring_dedup")
def op5(spark, sf_dir):
    return repeats_digest(table(spark, sf_dir, "documents"))


@query("op6_license_scan")
def op6(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents"))


@query("op7_decontaminate")
def op7(spark, sf_dir):
    return contamination_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_source_mix")
def op8(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents"))


@query("op9_url_filter")
def op9(spark, sf_dir):
    return judge_urls(table(spark, sf_dir, "pages"))


@query("op10_exact_dedup")
def op10(spark, sf_dir):
    return exact_owners(table(spark, sf_dir, "documents"))


@query("op11_byte_repeats")
def op11(spark, sf_dir):
    return byte_repeats_digest(table(spark, sf_dir, "documents"))


@query("op12_collocations")
def op12(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


@query("op13_token_align")
def op13(spark, sf_dir):
    return align_tokens(table(spark, sf_dir, "documents"))
