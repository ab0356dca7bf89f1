"""Queries of the corpus operators and, where SQL can express them, their oracle SQL."""

from __future__ import annotations

from . import decontamination, near_dedup, packing, phrases, quality_rules, secrets, sharding, token_files, token_rollup, url_filter


def queries():
    return {
        "op1_packed_token_files": token_files.query,
        "op2_token_rollup": token_rollup.query,
        "op3_ring_shards": sharding.query,
        "op4_guess_cost_secrets": secrets.query,
        "op5_phrase_automata": phrases.query,
        "op6_best_fit_packing": packing.query,
        "op7_winnowing_decontamination": decontamination.query,
        "op8_odd_sketch_near_dedup": near_dedup.query,
        "op9_rule_ledger": quality_rules.query,
        "op10_url_words": url_filter.query,
        "rule_ablation": quality_rules.ablation_query,
    }


def oracle_sql():
    return {
        "op5_phrase_automata": phrases.ORACLE_SQL,
        "op7_winnowing_decontamination": decontamination.ORACLE_SQL,
        "op8_odd_sketch_near_dedup": near_dedup.ORACLE_SQL,
        "op9_rule_ledger": quality_rules.ORACLE_SQL,
        "rule_ablation": quality_rules.ABLATION_SQL,
    }
