"""Queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat, divergence, language, media, mixing, near_dup, packing, pii, repair, sentencepiece_codec, suffix_dedup, token_files, topk_search

QUERIES = {
    "op1_sentencepiece": sentencepiece_codec.op1_sentencepiece,
    "op2_media_columns": media.op2_media_columns,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_near_dup": near_dup.op4_near_dup,
    "op5_chat_format": chat.op5_chat_format,
    "op6_pii": pii.op6_pii,
    "op7_token_files": token_files.op7_token_files,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_topk_search": topk_search.op9_topk_search,
    "op10_language": language.op10_language,
    "op11_mixing": mixing.op11_mixing,
    "op12_repair": repair.op12_repair,
    "op13_divergence": divergence.op13_divergence,
}
ORACLES = {"op5_chat_format": chat.OP5_SQL, "op9_topk_search": topk_search.OP9_SQL, "op11_mixing": mixing.OP11_SQL, "op12_repair": repair.OP12_SQL, "op13_divergence": divergence.OP13_SQL}
