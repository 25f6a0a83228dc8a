"""The queries of this subpackage, and DuckDB's SQL where it can express them."""

from substrata.llm import decontam, fingerprints, html_extract, line_dedup, lm_score, mixing, ngram_join, quality, sharding, warc

QUERIES = {
    "op1_line_crf": quality.op1_line_crf,
    "op2_host_paths": html_extract.op2_host_paths,
    "op3_masked_window_lm": lm_score.op3_masked_window_lm,
    "op4_scaled_sketch": fingerprints.op4_scaled_sketch,
    "op5_suffix_automaton": decontam.op5_suffix_automaton,
    "op6_bernoulli_mixing": mixing.op6_bernoulli_mixing,
    "op7_window_line_dedup": line_dedup.op7_window_line_dedup,
    "op8_chunked_warc": warc.op8_chunked_warc,
    "op9_ngram_join": ngram_join.op9_ngram_join,
    "op10_tree_sharding": sharding.op10_tree_sharding,
}
ORACLES = {
    "op5_suffix_automaton": decontam.ORACLE,
    "op6_bernoulli_mixing": mixing.oracle(),
    "op7_window_line_dedup": line_dedup.ORACLE,
    "op8_chunked_warc": warc.ORACLE,
    "op9_ngram_join": ngram_join.ORACLE,
    "op10_tree_sharding": sharding.oracle(sharding.Topology.even(16)),
}
