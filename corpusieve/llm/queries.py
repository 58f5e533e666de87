"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from corpusieve.llm import anisotropic, audit, balltree, bpe, chat, chosenpath, fingerprints, langid, packing, quality, repeats, shards, tokenfiles

QUERIES = {
    "op1_quality": quality.op1_query,
    "op2_language": langid.op2_query,
    "op3_fingerprints": fingerprints.op3_query,
    "op4_nearest": anisotropic.op4_query,
    "op5_shards": shards.op5_query,
    "op6_jaccard_join": chosenpath.op6_query,
    "op7_chat": chat.op7_query,
    "op8_bpe": bpe.op8_query,
    "op9_token_files": tokenfiles.op9_query,
    "op10_packing": packing.op10_query,
    "op11_repeats": repeats.op11_query,
    "op12_filter_audit": audit.op12_query,
    "op13_ball_tree": balltree.op13_query,
}

#: Queries without SQL are tested against brute force, round trips or held-out rows.
ORACLES = {"op5_shards": shards.OP5_SQL, "op6_jaccard_join": chosenpath.OP6_SQL, "op7_chat": chat.OP7_SQL, "op11_repeats": repeats.OP11_SQL, "op12_filter_audit": audit.OP12_SQL, "op13_ball_tree": balltree.OP13_SQL}
