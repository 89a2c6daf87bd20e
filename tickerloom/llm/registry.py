"""Queries of the operators in this subpackage and their SQL counterparts."""

from __future__ import annotations

import corpus_pipeline
from tickerloom.llm import language, mixing, nearest, neardup, packing, quality, secrets, toxicity, transport, wrapper


def queries():
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_nearest": nearest.op2_nearest,
        "op3_language": language.op3_language,
        "op4_quality": quality.op4_quality,
        "op5_wrapper": wrapper.op5_wrapper,
        "op6_packing": packing.op6_packing,
        "op7_mixing": mixing.op7_mixing,
        "op8_transport": transport.op8_transport,
        "op9_secrets": secrets.op9_secrets,
        "op10_neardup": neardup.op10_neardup,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql():
    """What SQL can say; the others are tested against brute force, round trips or held-out accuracy."""
    found = {"op2_nearest": nearest.SQL, "op7_mixing": mixing.SQL, "op10_neardup": neardup.SQL}
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
