"""Queries of the training-data operators, with SQL where it can express them."""

from __future__ import annotations

from matchloom.llm import (
    exact_dedup,
    mixing,
    ngram_join,
    packing,
    pseudo_likelihood,
    quality_rules,
    quality_zstd,
    secrets_grammar,
    token_orc,
    toxicity_pu,
)


def queries() -> dict:
    return {
        "op1_quality_zstd": quality_zstd.op1_quality_zstd,
        "op2_token_orc": token_orc.op2_token_orc,
        "op3_exact_dedup": exact_dedup.op3_exact_dedup,
        "op4_ngram_join": ngram_join.op4_ngram_join,
        "op5_packing": packing.op5_packing,
        "op6_mixing": mixing.op6_mixing,
        "op7_quality_rules": quality_rules.op7_quality_rules,
        "op8_pseudo_likelihood": pseudo_likelihood.op8_pseudo_likelihood,
        "op9_secret_scan": secrets_grammar.op9_secret_scan,
        "op10_toxicity_pu": toxicity_pu.op10_toxicity_pu,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": exact_dedup.SQL, "op6_mixing": mixing.SQL, "op7_quality_rules": quality_rules.SQL}
