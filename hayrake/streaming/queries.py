"""Answering queries that arrive as a stream against a fixed corpus.

Each micro-batch is one set-oriented plan; the sink is written with the batch number, so a batch that is
repeated after a failure replaces its own rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.lexical import bm25_scores
from ..operators.pool import stable_topk


def answer_stream(queries: DataFrame, q_key: str, q_terms: str, docs: DataFrame, key: str, terms: str, path: str, checkpoint: str, k: int = 50):
    """Start a streaming query that writes the BM25 top k of each arriving query under ``path``."""

    def answer(batch: DataFrame, number: int) -> None:
        best = stable_topk(bm25_scores(docs, key, terms, batch, q_key, q_terms), k, q_key, key)
        best.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
