"""Queries of the training-data operators, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folio.llm import exact_dedup, lines, search
from folio.llm.chat import op1_chat_windows
from folio.llm.exact_dedup import op3_exact_dedup
from folio.llm.jaccard import op6_jaccard_join
from folio.llm.lines import op2_site_lines
from folio.llm.lm import op10_backoff_lm
from folio.llm.packing import op7_best_fit_packing
from folio.llm.quality import op8_quality_votes
from folio.llm.search import op4_pivot_search
from folio.llm.sentence import op9_sentence_pieces
from folio.llm.wavelet import op5_token_shards

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_windows": op1_chat_windows,
    "op2_site_lines": op2_site_lines,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_pivot_search": op4_pivot_search,
    "op5_token_shards": op5_token_shards,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_quality_votes": op8_quality_votes,
    "op9_sentence_pieces": op9_sentence_pieces,
    "op10_backoff_lm": op10_backoff_lm,
}
ORACLES: dict[str, str] = {"op2_site_lines": lines.ORACLE, "op3_exact_dedup": exact_dedup.ORACLE, "op4_pivot_search": search.ORACLE}
