"""Queries of this package by name, and their SQL where SQL can state them."""

from __future__ import annotations

from factorloom.llm.bpe import op4_bpe
from factorloom.llm.flac import op2_flac_media
from factorloom.llm.html_text import op1_main_text
from factorloom.llm.mixing import OP5_SQL, op5_mixing
from factorloom.llm.periodic_runs import OP12_SQL, op12_periodic_runs
from factorloom.llm.phrases import OP13_SQL, op13_collocations
from factorloom.llm.pii import op9_pii_spans
from factorloom.llm.quality import op8_quality
from factorloom.llm.repeats import op7_repeats
from factorloom.llm.simhash import op10_simhash
from factorloom.llm.topk import OP6_SQL, op6_topk
from factorloom.llm.toxicity import op3_toxicity
from factorloom.llm.url_filter import OP11_SQL, op11_url_filter

QUERIES = {
    "op1_main_text": op1_main_text,
    "op2_flac_media": op2_flac_media,
    "op3_toxicity": op3_toxicity,
    "op4_bpe": op4_bpe,
    "op5_mixing": op5_mixing,
    "op6_topk": op6_topk,
    "op7_repeats": op7_repeats,
    "op8_quality": op8_quality,
    "op9_pii_spans": op9_pii_spans,
    "op10_simhash": op10_simhash,
    "op11_url_filter": op11_url_filter,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_collocations": op13_collocations,
}

ORACLES: dict[str, str] = {
    "op5_mixing": OP5_SQL,
    "op6_topk": OP6_SQL,
    "op11_url_filter": OP11_SQL,
    "op12_periodic_runs": OP12_SQL,
    "op13_collocations": OP13_SQL,
}
