"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fingerprint, jaccard_join, license_scan, line_dedup, mixing, packing, suffix_dedup, toxicity, url_filter, vp_search


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_vp_search": vp_search.op1_vp_search,
        "op2_fingerprint": fingerprint.op2_fingerprint,
        "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
        "op4_line_dedup": line_dedup.op4_line_dedup,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_retrieval_packing": packing.op6_retrieval_packing,
        "op7_url_filter": url_filter.op7_url_filter,
        "op8_jaccard_join": jaccard_join.op8_jaccard_join,
        "op9_source_mix": mixing.op9_source_mix,
        "op10_license_scan": license_scan.op10_license_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_line_dedup": line_dedup.oracle_sql(),
        "op7_url_filter": url_filter.oracle_sql(),
        "op8_jaccard_join": jaccard_join.oracle_sql(),
        "op9_source_mix": mixing.oracle_sql(),
        "op10_license_scan": license_scan.oracle_sql(),
    }
