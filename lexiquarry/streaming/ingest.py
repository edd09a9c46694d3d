"""Documents that arrive as a stream are analyzed batch by batch and appended to a stored index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lexiquarry.functions.analysis import Filter, tokenize
from lexiquarry.operators import index as ix


def ingest(stream: DataFrame, path: str, checkpoint: str, analyze: Filter = tokenize, available_now: bool = True) -> StreamingQuery:
    """Write postings and lengths of ``stream(doc_id, title, content)`` under ``path``.

    A batch writes a folder of its own name, and overwrites it when it is run
    again after a failure, so each document is indexed once. A document that is
    sent again replaces its earlier form when the index is loaded: the latest
    batch counts, and in a batch the row that ``upsert`` would take.
    """

    def write(batch: DataFrame, number: int) -> None:
        nothing = ix.clear(ix.build(batch, analyze))
        made = ix.upsert(nothing, batch, analyze)
        for name in ("documents", "postings", "doc_stats"):
            getattr(made, name).write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
