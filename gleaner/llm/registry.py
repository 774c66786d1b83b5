"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, centroids, counting, jaccard, katz, media, mixing, packing, pii, snapshots, topk, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_interleaved_media": media.query,
    "op2_weak_pii": pii.query,
    "op3_zip_warc": warc.query,
    "op4_water_filling_mix": mixing.query,
    "op5_katz_backoff": katz.query,
    "op6_jaccard_groups": jaccard.query,
    "op7_compression_toxicity": toxicity.query,
    "op8_edit_aware_counts": counting.query,
    "op9_vector_best_fit": packing.query,
    "op10_segment_topk": topk.query,
    "op11_fuse_snapshots": snapshots.query,
    "op12_vantage_centroids": centroids.query,
    "op13_token_alignment": alignment.query,
}

SQL: dict[str, str] = {
    "op4_water_filling_mix": mixing.ORACLE,
    "op6_jaccard_groups": jaccard.ORACLE,
    "op10_segment_topk": topk.ORACLE,
    "op11_fuse_snapshots": snapshots.ORACLE,
    "op12_vantage_centroids": centroids.ORACLE,
}
