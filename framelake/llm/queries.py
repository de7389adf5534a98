"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from framelake.llm import bpe, exact_dedup, line_dedup, mixing, near_dedup, quality_rules, ranking, secret_scan, sharding, simhash, source_audit, suffix_dedup, vector_codes


def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_line_dedup": line_dedup.op1,
    "op2_pairwise_ranking": ranking.op2,
    "op3_secret_scan": secret_scan.op3,
    "op4_near_dedup": near_dedup.op4,
    "op5_sharding": sharding.op5,
    "op6_quality_rules": quality_rules.op6,
    "op7_mixing": mixing.op7,
    "op8_exact_dedup": exact_dedup.op8,
    "op9_bpe": bpe.op9,
    "op10_suffix_dedup": suffix_dedup.op10,
    "op11_simhash": simhash.op11,
    "op12_vector_codes": vector_codes.op12,
    "op13_source_audit": source_audit.op13,
}

SQL = {
    "op1_line_dedup": line_dedup.OP1_SQL,
    "op5_sharding": sharding.OP5_SQL,
    "op8_exact_dedup": exact_dedup.OP8_SQL,
    "op12_vector_codes": vector_codes.OP12_SQL,
    "op13_source_audit": source_audit.OP13_SQL,
}
