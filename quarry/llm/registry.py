"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import chat_format, collocations, decontaminate, kd_shards, media_chunks, ngram_join, pii, rule_ensemble, spelling, substring_dedup, url_rules, warc
from quarry.llm.byte_bpe import op10_byte_bpe


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query by name, with corpus_pipeline.run as `pipeline`."""
    return {
        "op1_warc": warc.op1_warc,
        "op2_decontaminate": decontaminate.op2_decontaminate,
        "op3_kd_shards": kd_shards.op3_kd_shards,
        "op4_rule_ensemble": rule_ensemble.op4_rule_ensemble,
        "op5_substring_dedup": substring_dedup.op5_substring_dedup,
        "op6_chat_format": chat_format.op6_chat_format,
        "op7_pii": pii.op7_pii,
        "op8_media_chunks": media_chunks.op8_media_chunks,
        "op9_ngram_join": ngram_join.op9_ngram_join,
        "op10_byte_bpe": op10_byte_bpe,
        "op11_collocations": collocations.op11_collocations,
        "op12_spelling": spelling.op12_spelling,
        "op13_url_rules": url_rules.op13_url_rules,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    return {"op1_warc": warc.SQL, "op11_collocations": collocations.SQL, "op13_url_rules": url_rules.SQL}
