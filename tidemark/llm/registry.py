"""Queries of the corpus operators, by name, and the DuckDB SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import fingerprints, gif, langid, mixing, packing, pii, quotes, repeats, secrets, simhash

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    repeats.op1_lpf_repeats,
    fingerprints.op2_invertible_sketch,
    pii.op3_bilstm_crf_pii,
    simhash.op4_simhash_pigeonhole,
    mixing.op5_hypergeometric_mix,
    gif.op6_gif_media,
    secrets.op7_blob_ledger_secrets,
    quotes.op8_quotation_links,
    packing.op9_sum_of_squares_packing,
    langid.op10_byte_cnn_language,
)}

ORACLES: dict[str, str] = {"op8_quotation_links": quotes.OP8_SQL}
