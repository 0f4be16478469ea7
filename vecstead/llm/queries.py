"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vecstead.llm import decontaminate, html_text, language_id, lm_score, media, packing, phrases, quality, simhash, toxicity, url_filter, vector_codes, vector_links

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": language_id.query,
    "op2_lm_score": lm_score.query,
    "op3_simhash": simhash.query,
    "op4_html_text": html_text.query,
    "op5_media": media.query,
    "op6_url_filter": url_filter.query,
    "op7_decontaminate": decontaminate.query,
    "op8_toxicity": toxicity.query,
    "op9_packing": packing.query,
    "op10_quality": quality.query,
    "op11_vector_codes": vector_codes.query,
    "op12_phrases": phrases.query,
    "op13_vector_links": vector_links.query,
    "media_clips": media.clips_query,
}
ORACLES: dict[str, str] = {"op6_url_filter": url_filter.ORACLE, "op11_vector_codes": vector_codes.ORACLE, "op12_phrases": phrases.ORACLE, "op13_vector_links": vector_links.ORACLE}
