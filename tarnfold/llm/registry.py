"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, divergence, fingerprints, jaccard_join, mixing, ppm, sharding, toxicity, url_reputation, warc


def queries() -> dict:
    return {
        "op1_host_reputation": url_reputation.op1_host_reputation,
        "op2_bottom_k": fingerprints.op2_bottom_k,
        "op3_salvaged_warc": warc.op3_salvaged_warc,
        "op4_trie_bpe": bpe.op4_trie_bpe,
        "op5_hypergeometric_shards": sharding.op5_hypergeometric_shards,
        "op6_divergence": divergence.op6_divergence,
        "op7_convolution": toxicity.op7_convolution,
        "op8_token_group_matrix": jaccard_join.op8_token_group_matrix,
        "op9_temperature": mixing.op9_temperature,
        "op10_ppm": ppm.op10_ppm,
    }


def oracle_sql() -> dict:
    return {"op1_host_reputation": url_reputation.SQL, "op3_salvaged_warc": warc.SQL, "op6_divergence": divergence.SQL}
