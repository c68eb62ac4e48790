"""The registered queries of the training-data operators and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clearbrook.llm.chat import OP4_SQL, op4_chat_formatting
from clearbrook.llm.decontaminate import OP5_SQL, op5_decontamination
from clearbrook.llm.langid import op3_language_id
from clearbrook.llm.neighbours import OP11_SQL, op11_neighbours
from clearbrook.llm.phrases import OP12_SQL, op12_phrases
from clearbrook.llm.pieces import op6_sentencepiece
from clearbrook.llm.pii import op9_pii
from clearbrook.llm.quality import OP7_SQL, op7_quality_rules
from clearbrook.llm.runs import op13_periodic_runs
from clearbrook.llm.sharding import op1_sharding
from clearbrook.llm.simhash import op2_simhash
from clearbrook.llm.toxicity import op10_toxicity
from clearbrook.llm.urls import OP8_SQL, op8_url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_simhash": op2_simhash,
    "op3_language_id": op3_language_id,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_decontamination": op5_decontamination,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_quality_rules": op7_quality_rules,
    "op8_url_filters": op8_url_filters,
    "op9_pii": op9_pii,
    "op10_toxicity": op10_toxicity,
    "op11_neighbours": op11_neighbours,
    "op12_phrases": op12_phrases,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL = {
    "op4_chat_formatting": OP4_SQL,
    "op5_decontamination": OP5_SQL,
    "op7_quality_rules": OP7_SQL,
    "op8_url_filters": OP8_SQL,
    "op11_neighbours": OP11_SQL,
    "op12_phrases": OP12_SQL,
}
