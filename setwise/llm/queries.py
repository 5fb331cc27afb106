"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from setwise.llm.decontamination import op6_decontamination
from setwise.llm.language_id import op10_language_id
from setwise.llm.language_model import op8_lm_scoring
from setwise.llm.licenses import SQL as LICENSE_SQL
from setwise.llm.licenses import op3_license_scans
from setwise.llm.near_dedup import op5_minhash_near_dedup
from setwise.llm.pii import op4_pii
from setwise.llm.quality import op7_quality_rules
from setwise.llm.sentence_pieces import op9_sentence_pieces
from setwise.llm.token_counts import op1_token_counts
from setwise.llm.toxicity import op2_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_token_counts, op2_toxicity, op3_license_scans, op4_pii, op5_minhash_near_dedup, op6_decontamination, op7_quality_rules, op8_lm_scoring, op9_sentence_pieces, op10_language_id)
}
SQL: dict[str, str] = {"op3_license_scans": LICENSE_SQL}
