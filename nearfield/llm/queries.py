"""The queries of this subpackage, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from nearfield.llm import decontam, embeddings, hpylm, html_text, langid, minhash, mixing, quality, toxicity, warc

QUERIES = {
    "op1_language_model": hpylm.op1_language_model,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_language_id": langid.op3_language_id,
    "op4_near_duplicates": minhash.op4_near_duplicates,
    "op5_html_text": html_text.op5_html_text,
    "op6_quality": quality.op6_quality,
    "op7_merkle_audit": warc.op7_merkle_audit,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_decontamination": decontam.op9_decontamination,
    "op10_embedding_links": embeddings.op10_embedding_links,
}

ORACLE_SQL: dict[str, str] = {
    "op2_mix_sources": mixing.ORACLE_SQL,
    "op7_merkle_audit": warc.ORACLE_SQL,
    "op10_embedding_links": embeddings.ORACLE_SQL,
}
