"""Files as they arrive: each is complete in one row, so streams keep no state but the digests of what they have seen."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..convert import Options, convert

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, glob: str = "*.pdf", late: str = "30 days", once: bool = True) -> DataFrame:
    """Files of a folder as they arrive; with `once` each content once within the watermark, whatever its paths, else every path."""
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", glob).load(folder)
    marked = files.withColumn("sha256", F.sha2("content", 256))
    return marked.withWatermark("modificationTime", late).dropDuplicatesWithinWatermark(["sha256"]) if once else marked


def convert_stream(spark: SparkSession, folder: str, sink: Callable[[DataFrame, int], None], checkpoint: str, options: Options = Options(), once: bool = True, every_path: bool = False) -> StreamingQuery:  # noqa: B008
    """Convert arriving files and hand each batch of results to a sink; `every_path`: a content that comes by two paths, twice."""
    results = convert(arriving(spark, folder, once=not every_path), options=options)
    writer = results.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if once else writer.start()
