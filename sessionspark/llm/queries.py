"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontamination, kdtree, langid, merkle, mixing, quotations, repeats, sharding, simhash, tokenfile, trie, turnrepair, unigram


def queries() -> dict:
    return {
        "op1_winnowing": decontamination.op1_winnowing,
        "op2_merkle_fixity": merkle.op2_merkle_fixity,
        "op3_splitting_tree": mixing.op3_splitting_tree,
        "op4_language_crf": langid.op4_language_crf,
        "op5_quotation_links": quotations.op5_quotation_links,
        "op6_kd_trees": kdtree.op6_kd_trees,
        "op7_simhash_tiles": simhash.op7_simhash_tiles,
        "op8_feistel_shards": sharding.op8_feistel_shards,
        "op9_zstd_token_file": tokenfile.op9_zstd_token_file,
        "op10_unigram_viterbi": unigram.op10_unigram_viterbi,
        "op11_turn_repair": turnrepair.op11_turn_repair,
        "op12_prefix_trie": trie.op12_prefix_trie,
        "op13_substring_dedup": repeats.op13_substring_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_winnowing": decontamination.ORACLE, "op2_merkle_fixity": merkle.ORACLE, "op5_quotation_links": quotations.ORACLE, "op6_kd_trees": kdtree.ORACLE, "op12_prefix_trie": trie.ORACLE, "op13_substring_dedup": repeats.ORACLE}
