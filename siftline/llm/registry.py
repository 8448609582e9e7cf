"""Queries and SQL of the corpus operators."""

from __future__ import annotations

from siftline.llm.decontaminate import op10_decontaminate
from siftline.llm.line_dedup import op4_line_dedup
from siftline.llm.near_dup import op2_order_minhash
from siftline.llm.ngram_scoring import op5_lm_scoring
from siftline.llm.periodic_runs import op11_periodic_runs
from siftline.llm.phrase_mining import OP13_SQL, op13_phrase_mining
from siftline.llm.quality_crf import op6_quality_classifier
from siftline.llm.sentencepiece_stream import op9_sentencepiece
from siftline.llm.substring_dedup import op1_substring_dedup
from siftline.llm.token_counts import op3_token_counts
from siftline.llm.topk_search import OP7_SQL, op7_topk_search
from siftline.llm.toxicity import op8_toxicity
from siftline.llm.warc_zip import OP12_SQL, op12_warc_zip

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_order_minhash": op2_order_minhash,
    "op3_token_counts": op3_token_counts,
    "op4_line_dedup": op4_line_dedup,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_topk_search": op7_topk_search,
    "op8_toxicity": op8_toxicity,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_decontaminate": op10_decontaminate,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_warc_zip": op12_warc_zip,
    "op13_phrase_mining": op13_phrase_mining,
}

SQL = {
    "op7_topk_search": OP7_SQL,
    "op12_warc_zip": OP12_SQL,
    "op13_phrase_mining": OP13_SQL,
}
