"""Registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from . import (bpe_transducer, chat_examples, collocations, conversation_repair, exact_dedup, genetic_packing, language_zstd, ngram_join,
               quality_gam, site_templates, spot_signatures, toxic_passages, vector_shards)

QUERIES = {
    "op1_spot_signatures": spot_signatures.op1_spot_signatures,
    "op2_site_templates": site_templates.op2_site_templates,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_toxic_passages": toxic_passages.op4_toxic_passages,
    "op5_quality_gam": quality_gam.op5_quality_gam,
    "op6_vector_shards": vector_shards.op6_vector_shards,
    "op7_ngram_join": ngram_join.op7_ngram_join,
    "op8_bpe_transducer": bpe_transducer.op8_bpe_transducer,
    "op9_language_zstd": language_zstd.op9_language_zstd,
    "op10_genetic_packing": genetic_packing.op10_genetic_packing,
    "op11_conversation_repair": conversation_repair.op11_conversation_repair,
    "op12_chat_examples": chat_examples.op12_chat_examples,
    "op13_collocations": collocations.op13_collocations,
}

ORACLE_SQL = {
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op11_conversation_repair": conversation_repair.ORACLE,
    "op12_chat_examples": chat_examples.ORACLE,
    "op13_collocations": collocations.ORACLE,
}
