"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from corpusops.llm import (
    arc_to_warc,
    exact_dedup,
    kd_shards,
    minhash_dedup,
    multiset_print,
    packed_ids,
    quality_pu,
    rank_bpe,
    source_mix,
    stable_ann,
    term_at_a_time,
    token_counts,
    token_links,
)

QUERIES = {
    "op1_quality_pu": quality_pu.op1_quality_pu,
    "op2_minhash_dedup": minhash_dedup.op2_minhash_dedup,
    "op3_stable_ann": stable_ann.op3_stable_ann,
    "op4_source_mix": source_mix.op4_source_mix,
    "op5_arc_to_warc": arc_to_warc.op5_arc_to_warc,
    "op6_kd_shards": kd_shards.op6_kd_shards,
    "op7_packed_ids": packed_ids.op7_packed_ids,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_rank_bpe": rank_bpe.op9_rank_bpe,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_multiset_print": multiset_print.op11_multiset_print,
    "op12_token_links": token_links.op12_token_links,
    "op13_term_at_a_time": term_at_a_time.op13_term_at_a_time,
}

ORACLE = {
    "op2_minhash_dedup": minhash_dedup.ORACLE,
    "op4_source_mix": source_mix.ORACLE,
    "op5_arc_to_warc": arc_to_warc.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
    "op13_term_at_a_time": term_at_a_time.ORACLE,
}
