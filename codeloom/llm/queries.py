"""Registered corpus queries and the SQL that gives the same rows."""

from __future__ import annotations

from codeloom.llm import centroids, decontaminate, extraction, jaccard, language, language_model, mtree, packing, quality, sharding, spelling, toxicity, warc

QUERIES = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_lm_scoring": language_model.op3_lm_scoring,
    "op4_ngram_jaccard": jaccard.op4_ngram_jaccard,
    "op5_sharding": sharding.op5_sharding,
    "op6_language": language.op6_language,
    "op7_topk": mtree.op7_topk,
    "op8_warc": warc.op8_warc,
    "op9_packing": packing.op9_packing,
    "op10_quality": quality.op10_quality,
    "op11_spelling": spelling.op11_spelling,
    "op12_centroids": centroids.op12_centroids,
    "op13_html_extraction": extraction.op13_html_extraction,
}

ORACLES: dict[str, str] = {
    "op1_decontamination": decontaminate.ORACLE,
    "op4_ngram_jaccard": jaccard.ORACLE,
    "op5_sharding": sharding.ORACLE,
    "op7_topk": mtree.ORACLE,
    "op8_warc": warc.ORACLE,
    "op11_spelling": spelling.ORACLE,
    "op12_centroids": centroids.ORACLE,
}
