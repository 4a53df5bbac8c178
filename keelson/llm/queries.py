"""Driver queries of the training-data operators, with production parameters over whole tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keelson.llm import ann, decontaminate, line_dedup, near_dedup, packing, pii, quality, substring_dedup, token_output, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_cross_polytope_ann": ann.op1,
        "op2_subword_quality": quality.op2,
        "op3_rans_tokens": token_output.op3,
        "op4_url_vocabulary": url_filter.op4,
        "op5_winnow_lines": line_dedup.op5,
        "op6_disclosure_pii": pii.op6,
        "op7_bestfit_pack": packing.op7,
        "op8_suffix_tree_dedup": substring_dedup.op8,
        "op9_suffix_array_decontam": decontaminate.op9,
        "op10_odd_sketch_neardup": near_dedup.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_url_vocabulary": url_filter.ORACLE_SQL,
        "op5_winnow_lines": line_dedup.sql(),
        "op8_suffix_tree_dedup": substring_dedup.ORACLE_SQL,
        "op9_suffix_array_decontam": decontaminate.ORACLE_SQL,
        "op10_odd_sketch_neardup": near_dedup.ORACLE_SQL,
    }
