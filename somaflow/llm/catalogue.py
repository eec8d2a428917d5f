"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

import corpus_pipeline
from somaflow.llm import op10_toxicity, op11_alignment, op12_clusters, op13_minhash, op1_mixing, op2_tokens, op3_decontamination, op4_simhash, op5_warc, op6_neighbours, op7_licenses, op8_repeats, op9_pii


def queries() -> dict:
    return {
        "op1_mixing": op1_mixing.query,
        "op2_tokens": op2_tokens.query,
        "op3_decontamination": op3_decontamination.query,
        "op4_simhash": op4_simhash.query,
        "op5_warc": op5_warc.query,
        "op6_neighbours": op6_neighbours.query,
        "op7_licenses": op7_licenses.query,
        "op8_repeats": op8_repeats.query,
        "op9_pii": op9_pii.query,
        "op10_toxicity": op10_toxicity.query,
        "op11_alignment": op11_alignment.query,
        "op12_clusters": op12_clusters.query,
        "op13_minhash": op13_minhash.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mixing": op1_mixing.ORACLE,
        "op3_decontamination": op3_decontamination.ORACLE,
        "op5_warc": op5_warc.ORACLE,
        "op12_clusters": op12_clusters.ORACLE,
    }
