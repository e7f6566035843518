"""A stream of documents becomes an index, one segment by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.index import Writer


def append(stream: DataFrame, writer: Writer, checkpoint: str, name: str = "stream", once: bool = False) -> StreamingQuery:
    """Start to add the batches of ``stream``; one that is repeated after a failure is added once.

    The manifest has the number of the stream's last batch, so it and the segment
    appear together. Of streams that write to one index at the same time one
    fails and takes up its batch when it is started again. ``once`` stops when what is there now has been added.
    """

    def add(batch: DataFrame, number: int) -> None:
        writer.add(batch, batch=(name, number))

    out = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out).start()
