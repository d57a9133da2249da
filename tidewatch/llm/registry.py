"""Queries of this subpackage, for the driver's contract."""

from __future__ import annotations

from tidewatch.llm import queries as q

QUERIES = {f.__name__: f for f in (q.op1_language_id, q.op2_simhash_near_dedup, q.op3_benchmark_decontamination, q.op4_line_dedup, q.op5_pii, q.op6_chat_formatting, q.op7_sentencepiece, q.op8_url_filters, q.op9_quality_rules, q.op10_secret_scans, q.op11_embedding_whitening, q.op12_phrase_collocations, q.op13_source_mix)}
ORACLES = {"op6_chat_formatting": q.OP6_SQL, "op8_url_filters": q.OP8_SQL, "op3_benchmark_decontamination": q.OP3_SQL, "op4_line_dedup": q.OP4_SQL, "op12_phrase_collocations": q.OP12_SQL, "op13_source_mix": q.OP13_SQL}
