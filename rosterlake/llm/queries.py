"""Queries of this subpackage by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from . import byte_bpe, collocations, filter_audit, flac, mixing, ngram_join, packing, quality_rules, sharding, substring_dedup, token_files, url_filters, warc

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_byte_bpe": byte_bpe.op2_byte_bpe,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_mixing": mixing.op4_mixing,
    "op5_token_files": token_files.op5_token_files,
    "op6_flac_media": flac.op6_flac_media,
    "op7_ngram_join": ngram_join.op7_ngram_join,
    "op8_warc": warc.op8_warc,
    "op9_url_filters": url_filters.op9_url_filters,
    "op10_sharding": sharding.op10_sharding,
    "op11_collocations": collocations.op11_collocations,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_packing": packing.op13_packing,
}

ORACLES: dict[str, str] = {"op1_substring_dedup": substring_dedup.OP1_SQL, "op7_ngram_join": ngram_join.OP7_SQL, "op8_warc": warc.OP8_SQL, "op9_url_filters": url_filters.OP9_SQL, "op11_collocations": collocations.OP11_SQL, "op12_filter_audit": filter_audit.OP12_SQL}
