"""The registered queries of this subpackage and their SQL twins.

op2, op4, op6 and op8 have no twin: SQL can't express the tokenizer, the packing,
the network and the models. Their tests hold them against brute
force, round trips and held-out labels.
"""

from __future__ import annotations

from visitcast.llm import decontaminate, fill_middle, importance, line_dedup, minhash, quality_classifier, quality_rules, secrets, sentencepiece_codec, sharding, substring_dedup, url_filter, warc

QUERIES = {
    "op1_minhash_near_dedup": minhash.op1_minhash_near_dedup,
    "op2_sentencepiece": sentencepiece_codec.op2_sentencepiece,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_best_fit_sharding": sharding.op4_best_fit_sharding,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_attention_quality": quality_classifier.op6_attention_quality,
    "op7_benchmark_decontamination": decontaminate.op7_benchmark_decontamination,
    "op8_secret_scan": secrets.op8_secret_scan,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_warc_revisits": warc.op10_warc_revisits,
    "op11_importance_resampling": importance.op11_importance_resampling,
    "op12_fill_in_middle": fill_middle.op12_fill_in_middle,
    "op13_substring_dedup": substring_dedup.op13_substring_dedup,
}

ORACLE_SQL = {
    "op1_minhash_near_dedup": minhash.ORACLE_SQL,
    "op3_line_dedup": line_dedup.ORACLE_SQL,
    "op5_url_filter": url_filter.ORACLE_SQL,
    "op7_benchmark_decontamination": decontaminate.ORACLE_SQL,
    "op9_quality_rules": quality_rules.ORACLE_SQL,
    "op10_warc_revisits": warc.ORACLE_SQL,
    "op11_importance_resampling": importance.ORACLE_SQL,
    "op12_fill_in_middle": fill_middle.ORACLE_SQL,
    "op13_substring_dedup": substring_dedup.ORACLE_SQL,
}
