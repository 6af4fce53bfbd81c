"""Queries of this subpackage, by name."""

from . import centroids, cross_polytope, fill_middle, jaccard_join, length_buckets, main_text, mixing, pii, quality_rules, token_files, toxicity, url_rules, warc

QUERIES = {
    "op1_token_counts": token_files.op1_token_counts,
    "op2_cross_polytope": cross_polytope.op2_cross_polytope,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_length_buckets": length_buckets.op4_length_buckets,
    "op5_pii": pii.op5_pii,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_jaccard_join": jaccard_join.op7_jaccard_join,
    "op8_mixing": mixing.op8_mixing,
    "op9_main_text": main_text.op9_main_text,
    "op10_url_rules": url_rules.op10_url_rules,
    "op11_fill_middle": fill_middle.op11_fill_middle,
    "op12_elkan": centroids.op12_elkan,
    "op13_warc": warc.op13_warc,
}

ORACLE_SQL: dict[str, str] = {
    "op7_jaccard_join": jaccard_join.ORACLE_SQL,
    "op11_fill_middle": fill_middle.ORACLE_SQL,
    "op12_elkan": centroids.ORACLE_SQL,
    "op13_warc": warc.ORACLE_SQL,
}
