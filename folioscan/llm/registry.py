"""The queries of the training-data operators and their SQL, by name."""

from __future__ import annotations

from . import ann, chat, decontam, language_id, lm_scoring, mixing, ngram_join, sharding, stages, token_files, toxicity


def queries() -> dict:
    return {
        "op1_lm_scoring": lm_scoring.op1_lm_scoring,
        "op2_token_files": token_files.op2_token_files,
        "op3_language_id": language_id.op3_language_id,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_chat": chat.op5_chat,
        "op6_mixing": mixing.op6_mixing,
        "op7_ann": ann.op7_ann,
        "op8_decontamination": decontam.op8_decontamination,
        "op9_ngram_join": ngram_join.op9_ngram_join,
        "op10_sharding": sharding.op10_sharding,
        "pipeline": stages.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_chat": chat.oracle(),
        "op6_mixing": mixing.oracle(),
        "op7_ann": ann.oracle(),
        "op10_sharding": sharding.oracle(),
    }
