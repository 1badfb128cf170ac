"""The queries and SQL of this subpackage, by name."""

from __future__ import annotations

from . import imatch, langid, lattice_lm, line_spread, mixing, quality_crf, sentence_spans, simhash_cover, suffix_dedup, tiling

QUERIES = {
    "op1_quality_crf": quality_crf.op1_quality_crf,
    "op2_imatch": imatch.op2_imatch,
    "op3_mix_sources": mixing.op3_mix_sources,
    "op4_lattice_lm": lattice_lm.op4_lattice_lm,
    "op5_simhash_cover": simhash_cover.op5_simhash_cover,
    "op6_language_id": langid.op6_language_id,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_sentence_spans": sentence_spans.op8_sentence_spans,
    "op9_string_tiling": tiling.op9_string_tiling,
    "op10_line_spread": line_spread.op10_line_spread,
}
ORACLES = {
    "op3_mix_sources": mixing.OP3_SQL,
    "op10_line_spread": line_spread.OP10_SQL,
}
