"""Registry of this subpackage: the queries, and DuckDB SQL where SQL expresses them."""

from __future__ import annotations

import corpus_pipeline
from spanlake.llm import (ann, conversations, decontaminate, importance, jaccard, langid, maxent, mixing, pii, quality,
                          suffixes, urlfilter, warc)

QUERIES = {
    "op1_repeats": suffixes.op1_repeats,
    "op2_language": langid.op2_language,
    "op3_nearest": ann.op3_nearest,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op5_urls": urlfilter.op5_urls,
    "op6_maxent": maxent.op6_maxent,
    "op7_pii": pii.op7_pii,
    "op8_warc": warc.op8_warc,
    "op9_jaccard": jaccard.op9_jaccard,
    "op10_mix": mixing.op10_mix,
    "op11_quality": quality.op11_quality,
    "op12_importance": importance.op12_importance,
    "op13_conversations": conversations.op13_conversations,
    "pipeline": corpus_pipeline.run,
}

SQL: dict[str, str] = {
    "op4_decontaminate": decontaminate.SQL,
    "op8_warc": warc.SQL,
    "op12_importance": importance.SQL,
    "op13_conversations": conversations.SQL,
}
