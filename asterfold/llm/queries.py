"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from asterfold.llm import bitplane_clusters, decontam, fill_middle, hostrules, langid, minhash, packing, secrets, sentence_spans, simhash, token_counts, token_files, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": secrets.op1_secret_scan,
        "op2_token_files": token_files.op2_token_files,
        "op3_token_counts": token_counts.op3_token_counts,
        "op4_decontamination": decontam.op4_decontamination,
        "op5_best_fit_packing": packing.op5_best_fit_packing,
        "op6_sentence_spans": sentence_spans.op6_sentence_spans,
        "op7_language_id": langid.op7_language_id,
        "op8_simhash": simhash.op8_simhash,
        "op9_host_rules": hostrules.op9_host_rules,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_minhash": minhash.op11_minhash,
        "op12_bitplane_clusters": bitplane_clusters.op12_bitplane_clusters,
        "op13_fill_in_middle": fill_middle.op13_fill_in_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_secret_scan": secrets.SQL, "op9_host_rules": hostrules.SQL, "op12_bitplane_clusters": bitplane_clusters.sql(), "op13_fill_in_middle": fill_middle.SQL}
