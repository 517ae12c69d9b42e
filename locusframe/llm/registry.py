"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import html_text, kmeans, licenses, media, merkle, near_dup, ordinal, packing, perplexity, pieces, secrets, sharding, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (ordinal.op1_ordinal_quality, perplexity.op5_perplexity_rules, near_dup.op2_setsketch_groups, packing.op3_cost_balanced_packing, sharding.op4_slot_shards, secrets.op7_secret_scan, media.op8_telephony_audio, pieces.op6_offset_pieces, html_text.op9_main_text, warc.op10_capture_index, licenses.op11_diagonal_licenses, merkle.op12_merkle_manifest, kmeans.op13_exponion_clusters)}


def oracle_sql() -> dict[str, str]:
    return {"op11_diagonal_licenses": licenses.OP11_SQL, "op12_merkle_manifest": merkle.OP12_SQL, "op13_exponion_clusters": kmeans.OP13_SQL}
