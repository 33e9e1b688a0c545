"""The queries of this subpackage and, where DuckDB can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagelattice.llm.bpe import op3_bpe
from pagelattice.llm.decontaminate import op9_decontaminate
from pagelattice.llm.html_text import op4_html_text
from pagelattice.llm.jaccard_join import op7_jaccard
from pagelattice.llm.language_id import op2_language
from pagelattice.llm.nearest import op8_nearest
from pagelattice.llm.oracles import ORACLE
from pagelattice.llm.quality import op10_quality
from pagelattice.llm.secret_scan import op6_secrets
from pagelattice.llm.substring_dedup import op1_substring_dedup
from pagelattice.llm.suffix_dedup import op5_suffix_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_language": op2_language,
    "op3_bpe": op3_bpe,
    "op4_html_text": op4_html_text,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_secrets": op6_secrets,
    "op7_jaccard": op7_jaccard,
    "op8_nearest": op8_nearest,
    "op9_decontaminate": op9_decontaminate,
    "op10_quality": op10_quality,
}

__all__ = ["ORACLE", "QUERIES"]
