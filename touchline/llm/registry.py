"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bytebpe, fingerprints, jaccard, language, maintext, neighbours, packing, passages, quality, repeats

QUERIES = {
    "op1_fingerprints": fingerprints.query,
    "op2_best_fit_packing": packing.query,
    "op3_byte_bpe": bytebpe.query,
    "op4_quality": quality.query,
    "op5_suffix_repeats": repeats.query,
    "op6_jaccard": jaccard.query,
    "op7_main_text": maintext.query,
    "op8_language_model": language.query,
    "op9_passages": passages.query,
    "op10_vantage_neighbours": neighbours.query,
}

ORACLES: dict[str, str] = {}
