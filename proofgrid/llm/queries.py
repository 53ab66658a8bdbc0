"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import byte_bpe, chat_quotes, collocations, hmm_scoring, media_tiff, near_dups, packing, quality_rules, sort_means, source_mix, token_counts, toxicity, url_filters

QUERIES = {
    "op1_token_rollup": token_counts.op1_token_rollup,
    "op2_byte_bpe": byte_bpe.op2_byte_bpe,
    "op3_repetition_coverage": quality_rules.op3_repetition_coverage,
    "op4_noisy_channel": toxicity.op4_noisy_channel,
    "op5_grouping_genetic_packing": packing.op5_grouping_genetic_packing,
    "op6_prob_min_hash": near_dups.op6_prob_min_hash,
    "op7_tiff": media_tiff.op7_tiff,
    "op8_quotation_linking": chat_quotes.op8_quotation_linking,
    "op9_hidden_markov": hmm_scoring.op9_hidden_markov,
    "op10_host_reputation": url_filters.op10_host_reputation,
    "op11_source_mix": source_mix.op11_source_mix,
    "op12_sort_means": sort_means.op12_sort_means,
    "op13_collocations": collocations.op13_collocations,
}
SQL = {"op10_host_reputation": url_filters.SQL, "op11_source_mix": source_mix.SQL, "op12_sort_means": sort_means.SQL, "op13_collocations": collocations.SQL}
