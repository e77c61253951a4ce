"""The queries of the text operators and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op1_warc, op2_lattice_lm, op3_language, op4_decontaminate, op5_html_text, op6_suffix_array, op7_substring_dedup, op8_packing, op9_simhash, op10_exact_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_index": op1_warc.op1_warc_index,
    "op2_lattice_likelihood": op2_lattice_lm.op2_lattice_likelihood,
    "op3_language_id": op3_language.op3_language_id,
    "op4_decontamination": op4_decontaminate.op4_decontamination,
    "op5_html_text": op5_html_text.op5_html_text,
    "op6_suffix_array_dedup": op6_suffix_array.op6_suffix_array_dedup,
    "op7_substring_dedup": op7_substring_dedup.op7_substring_dedup,
    "op8_length_buckets": op8_packing.op8_length_buckets,
    "op9_simhash_near_dedup": op9_simhash.op9_simhash_near_dedup,
    "op10_exact_dedup": op10_exact_dedup.op10_exact_dedup,
}
ORACLE_SQL: dict[str, str] = {
    "op1_warc_index": op1_warc.ORACLE,
    "op6_suffix_array_dedup": op6_suffix_array.ORACLE,
    "op7_substring_dedup": op7_substring_dedup.ORACLE,
    "op8_length_buckets": op8_packing.ORACLE,
    "op10_exact_dedup": op10_exact_dedup.ORACLE,
}
