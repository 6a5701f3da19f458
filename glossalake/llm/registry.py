"""The subpackage's queries and their SQL."""

from __future__ import annotations

from . import encoding, exact_dedup, graph_ann, lm, mixing, quality, sharding, simhash, toxicity, urls

QUERIES = {
    "op1_importance_resampling": quality.op1_importance_resampling,
    "op2_shard_by_bytes": sharding.op2_shard_by_bytes,
    "op3_attention": lm.op3_attention,
    "op4_content_sort": exact_dedup.op4_content_sort,
    "op5_redirect_equivalence": urls.op5_redirect_equivalence,
    "op6_pattern_grammar": toxicity.op6_pattern_grammar,
    "op7_pruned_graph": graph_ann.op7_pruned_graph,
    "op8_fair_queue": mixing.op8_fair_queue,
    "op9_deletion_variants": simhash.op9_deletion_variants,
    "op10_streaming_viterbi": encoding.op10_streaming_viterbi,
}

#: Queries without an entry are held against brute force in tests/llm.
ORACLE_SQL = {
    "op4_content_sort": exact_dedup.OP4_SQL,
    "op5_redirect_equivalence": urls.OP5_SQL,
    "op8_fair_queue": mixing.OP8_SQL,
}
