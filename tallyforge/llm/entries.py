"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from tallyforge.llm import embeddings, grades, language, mixing, packing, pages, phrases, pii, repeats, rules, simhash, store, toxicity

QUERIES = {
    "op1_grades": grades.op1,
    "op2_quality_rules": rules.op2,
    "rules_ablation": rules.rule_ablation,
    "op3_packing": packing.op3,
    "op4_mixing": mixing.op4,
    "op5_store": store.op5,
    "op6_pii": pii.op6,
    "op7_simhash": simhash.op7,
    "op8_language": language.op8,
    "op9_embeddings": embeddings.op9,
    "op10_pages": pages.op10,
    "op11_toxicity": toxicity.op11,
    "op12_phrases": phrases.op12,
    "op13_repeats": repeats.op13,
}

SQL = {
    "op2_quality_rules": rules.OP2_SQL,
    "rules_ablation": rules.ABLATION_SQL,
    "op4_mixing": mixing.OP4_SQL,
    "op12_phrases": phrases.OP12_SQL,
}
