"""Operators of a training-data pipeline over large text corpora; QUERIES and ORACLES register them."""

from clinprep.llm import alignment, bpe, decontamination, exact, lines, negatives, packing, quality, sharding, simhash, topk, toxicity, urls

QUERIES = {
    "op1_exact_topk": topk.op1_exact_topk,
    "op2_simhash_near_dedup": simhash.op2_simhash_near_dedup,
    "op3_line_dedup": lines.op3_line_dedup,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_url_filter": urls.op5_url_filter,
    "op6_bpe": bpe.op6_bpe,
    "op7_quality_classifier": quality.op7_quality_classifier,
    "op8_kd_sharding": sharding.op8_kd_sharding,
    "op9_packing": packing.op9_packing,
    "op10_exact_dedup": exact.op10_exact_dedup,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_alignment": alignment.op12_alignment,
    "op13_decontamination": decontamination.op13_decontamination,
}

ORACLES = {
    "op1_exact_topk": topk.ORACLE,
    "op3_line_dedup": lines.ORACLE,
    "op10_exact_dedup": exact.ORACLE,
    "op11_hard_negatives": negatives.ORACLE,
    "op13_decontamination": decontamination.ORACLE,
}
