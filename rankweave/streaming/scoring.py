"""An extension: scoring a stream of instances with static weights and codes.

Each micro-batch is an ordinary plan (joins and a ranked window within the batch), so no state
is kept between batches and late data needs no watermark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.ranking import beam_search


def score_stream(entries: DataFrame, chain: Sequence[tuple[DataFrame, DataFrame | None]], path: str, checkpoint: str, post: str = "l3-hinge", beam: int = 10, k: int = 10, **trigger) -> StreamingQuery:
    """Streams (i, j, v) entries, an instance's all in one batch, to ranked labels in Parquet."""

    def batch(df: DataFrame, number: int) -> None:
        # a folder for each batch: a batch that is run again replaces its own rows
        beam_search(df, chain, post, beam, k).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return entries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
