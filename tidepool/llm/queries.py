"""The registered queries of this subpackage, with SQL where SQL can express them."""

from tidepool.llm import alignment, bpe, caps, exact_dedup, language, lexical, licenses, neighbours, packing, secrets, sharding, simhash, toxicity

QUERIES = {
    "op1_histogram_shards": sharding.op1_histogram_shards,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_hyperdimensional_language": language.op3_hyperdimensional_language,
    "op4_digest_index": exact_dedup.op4_digest_index,
    "op5_speculative_bpe": bpe.op5_speculative_bpe,
    "op6_trigram_secrets": secrets.op6_trigram_secrets,
    "op7_license_templates": licenses.op7_license_templates,
    "op8_counterfactual_toxicity": toxicity.op8_counterfactual_toxicity,
    "op9_kmeans_tree": neighbours.op9_kmeans_tree,
    "op10_ball_simhash": simhash.op10_ball_simhash,
    "op11_pair_bound_search": lexical.op11_pair_bound_search,
    "op12_shared_cut_alignment": alignment.op12_shared_cut_alignment,
    "op13_cap_near_vectors": caps.op13_cap_near_vectors,
}

ORACLE_SQL = {
    "op4_digest_index": exact_dedup.SQL,
    "op6_trigram_secrets": secrets.SQL,
    "op7_license_templates": licenses.SQL,
    "op11_pair_bound_search": lexical.SQL,
    "op13_cap_near_vectors": caps.SQL,
}
