"""Queries and SQL of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from maskwerk.llm import archives, conversations, fingerprints, lexical, licenses, ngrams, oracles, packing, quality, secrets, sentencepieces, sharding, suffixes, webpages


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": sharding.op1_sharding,
        "op2_secret_scans": secrets.op2_secret_scans,
        "op3_packing": packing.op3_packing,
        "op4_fingerprints": fingerprints.op4_fingerprints,
        "op5_license_scans": licenses.op5_license_scans,
        "op6_html_extraction": webpages.op6_html_extraction,
        "op7_sentencepiece": sentencepieces.op7_sentencepiece,
        "op8_quality_rules": quality.op8_quality_rules,
        "op9_suffix_dedup": suffixes.op9_suffix_dedup,
        "op10_ngram_join": ngrams.op10_ngram_join,
        "op11_warc": archives.op11_warc,
        "op12_conversation_repair": conversations.op12_conversation_repair,
        "op13_lexical_search": lexical.op13_lexical_search,
    }


oracle_sql = oracles.oracle_sql
