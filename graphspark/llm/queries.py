"""The corpus queries: name to (spark, sf_dir) -> DataFrame, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe_codec, divergence, kd_sharding, late_sessions, line_quality, media, packing, secret_scan, simhash, surrogates, token_store, toxicity, word_table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": simhash.op1_simhash,
        "op2_media": media.op2_media,
        "op3_secret_scan": secret_scan.op3_secret_scan,
        "op4_line_quality": line_quality.op4_line_quality,
        "op5_kd_sharding": kd_sharding.op5_kd_sharding,
        "op6_byte_bpe": bpe_codec.op6_byte_bpe,
        "op7_token_store": token_store.op7_token_store,
        "op8_surrogates": surrogates.op8_surrogates,
        "op9_packing": packing.op9_packing,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_word_table": word_table.op11_word_table,
        "op12_divergence": divergence.op12_divergence,
        "op13_late_sessions": late_sessions.op13_late_sessions,
    }


def oracle_sql() -> dict[str, str]:
    return {"op12_divergence": divergence.ORACLE_SQL}
