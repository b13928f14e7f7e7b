"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import ann, dac, decontaminate, html, jaccard, langid, packing, pii, suffix_dedup, urlfilter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_html_text": html.op2_html_text,
    "op3_url_filter": urlfilter.op3_url_filter,
    "op4_pii": pii.op4_pii,
    "op5_neighbours": ann.op5_neighbours,
    "op6_language": langid.op6_language,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_pack": packing.op8_pack,
    "op9_jaccard": jaccard.op9_jaccard,
    "op10_token_files": dac.op10_token_files,
}

SQL: dict[str, str] = {
    "op3_url_filter": urlfilter.OP3_SQL,
    "op7_decontaminate": decontaminate.OP7_SQL,
    "op9_jaccard": jaccard.OP9_SQL,
}
