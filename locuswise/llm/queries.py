"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from locuswise.llm import exact_dedup, html_extract, merkle, mixing, mixture_packing, near_dedup, packing, pii, quality, spelling, toxicity, urls, warc

QUERIES = {
    "op1_quality": quality.query,
    "op2_near_dedup": near_dedup.query,
    "op3_personal_data": pii.query,
    "op4_main_text": html_extract.query,
    "op5_mix_sources": mixing.query,
    "op6_url_filter": urls.query,
    "op7_warc_derivatives": warc.query,
    "op8_exact_dedup": exact_dedup.query,
    "op9_pack_sequences": packing.query,
    "op10_toxicity": toxicity.query,
    "op11_merkle_manifest": merkle.query,
    "op12_spelling_variants": spelling.query,
    "op13_mixture_packing": mixture_packing.query,
}

ORACLES = {
    "op5_mix_sources": mixing.SQL,
    "op8_exact_dedup": exact_dedup.SQL,
    "op11_merkle_manifest": merkle.SQL,
    "op12_spelling_variants": spelling.SQL,
}
