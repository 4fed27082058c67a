"""The registered queries of the corpus operators, and their SQL where it can express them."""

from __future__ import annotations

from tidewater.llm.ann import op5_nearest_neighbours
from tidewater.llm.decontaminate import OP9_SQL, op9_benchmark_decontamination
from tidewater.llm.hmm import op4_hmm_language_model
from tidewater.llm.langid import op8_language_id
from tidewater.llm.licences import OP2_SQL, op2_licence_scan
from tidewater.llm.line_dedup import op3_line_dedup
from tidewater.llm.ngram_join import OP7_SQL, op7_ngram_jaccard_join
from tidewater.llm.pieces import op10_sentencepiece
from tidewater.llm.secrets import OP1_SQL, op1_secret_scan
from tidewater.llm.wrappers import op6_html_extraction

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_licence_scan": op2_licence_scan,
    "op3_line_dedup": op3_line_dedup,
    "op4_hmm_language_model": op4_hmm_language_model,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_html_extraction": op6_html_extraction,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_language_id": op8_language_id,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_sentencepiece": op10_sentencepiece,
}

SQL: dict[str, str] = {
    "op1_secret_scan": OP1_SQL,
    "op2_licence_scan": OP2_SQL,
    "op7_ngram_jaccard_join": OP7_SQL,
    "op9_benchmark_decontamination": OP9_SQL,
}
