"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe_trie, embed_dedup, exact_dedup, exact_topk, hard_negatives, minhash, mixing, periodic_runs, quality, suffix_dedup, token_counts, toxicity, warc


def queries():
    return {
        "op1_suffix_dedup": suffix_dedup.op1,
        "op2_token_counts": token_counts.op2,
        "op3_bpe_codec": bpe_trie.op3,
        "op4_toxicity": toxicity.op4,
        "op5_warc": warc.op5,
        "op6_mixing": mixing.op6,
        "op7_quality": quality.op7,
        "op8_embedding_dedup": embed_dedup.op8,
        "op9_minhash": minhash.op9,
        "op10_exact_dedup": exact_dedup.op10,
        "op11_hard_negatives": hard_negatives.op11,
        "op12_exact_topk": exact_topk.op12,
        "op13_periodic_runs": periodic_runs.op13,
    }


def oracle_sql():
    return {
        "op5_warc": warc.OP5_SQL,
        "op6_mixing": mixing.OP6_SQL,
        "op10_exact_dedup": exact_dedup.OP10_SQL,
        "op11_hard_negatives": hard_negatives.OP11_SQL,
        "op12_exact_topk": exact_topk.OP12_SQL,
    }
