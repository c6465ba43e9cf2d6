"""Time slices as a stream: new files of raw cells become slices of a cube, each batch laid over what is there, once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from terracell.cube import Cube
from terracell.grid import GridSpec
from terracell.sources.store import history, write


def ingest(spark: SparkSession, directory: str, schema: StructType | str, grid: GridSpec, time: str, target: str, checkpoint: str, transform: Callable[[Cube], Cube] = lambda c: c, chunk: tuple[int, int] = (2048, 2048)) -> StreamingQuery:
    """Starts a query that takes each new Parquet file below directory once, applies transform, and adds its cells to their slices.

    A slice may come in any number of batches: cells of later ones replace those of the same place, others stay.
    Each commit notes its stream (the checkpoint folder) and batch, and a batch whose note is there is not written
    again, so a replay after a failure changes nothing. The query stops when all files that are there have been taken.
    """

    def batch(rows: DataFrame, number: int) -> None:
        note = {"stream": checkpoint, "batch": number}
        if not rows.isEmpty() and all(r["note"] != note for r in history(rows.sparkSession, target)):
            write(transform(Cube(rows, grid, time)), target, chunk, mode="add", note=note)

    stream = spark.readStream.schema(schema).parquet(directory)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
