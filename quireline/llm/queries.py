"""One registered query for each training-data operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, decontaminate, hmm, langid, line_templates, mixing, ngram_join, secrets, url_rules, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.url_filter(spark, _table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"), _table(spark, sf_dir, "documents"))


@_query
def op2_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.language_model(spark, _table(spark, sf_dir, "documents"))


@_query
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(spark, _table(spark, sf_dir, "documents"))


@_query
def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(_table(spark, sf_dir, "documents"))


@_query
def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


@_query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(spark, _table(spark, sf_dir, "documents"))


@_query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(spark, _table(spark, sf_dir, "pages"))


@_query
def op10_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.line_dedup(_table(spark, sf_dir, "documents"))


ORACLES["op3_decontaminate"] = r"""
with d as (select distinct doc_id, text from documents),
dw as (select doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') w from d),
ds as (select distinct doc_id, array_to_string(w[i + 1 : i + 5], ' ') s from (select doc_id, w, unnest(range(greatest(len(w) - 5, 0) + 1)) i from dw where len(w) > 0)),
bw as (select item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') w from benchmark),
bs as (select distinct item_id, array_to_string(w[i + 1 : i + 5], ' ') s from (select item_id, w, unnest(range(greatest(len(w) - 5, 0) + 1)) i from bw where len(w) > 0)),
bn as (select item_id, count(*) n_item from bs group by item_id)
select doc_id, item_id, any_value(n_item) n_item, count(*) n_shared, count(*) / any_value(n_item) containment
from ds join bs using (s) join bn using (item_id) group by doc_id, item_id having count(*) * 100 >= any_value(n_item) * 80
"""
