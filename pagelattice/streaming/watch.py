"""A folder of images as a stream (an extension): the same stateless stages on new files.

Files are independent, so no state store or watermark is needed; each micro-batch is an
ordinary DataFrame and lands in a sink that a checkpoint makes exactly-once by batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagelattice.plans.stages import Kernel, map_images
from pagelattice.schemas import IMAGE_ROWS, to_struct
from pagelattice.sources import codecs
from pagelattice.sources.images import IMAGE_TYPE

FILES = "path string, modificationTime timestamp, length long, content binary"


def image_stream(spark: SparkSession, folder: str, pattern: str = "*.png", files_per_batch: int = 64) -> DataFrame:
    """(image_id, image) of files as they arrive."""
    import pyarrow as pa

    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).load(folder)

    def run(batches):
        for batch in batches:
            rows = [to_struct(codecs.decode(d), p) for p, d in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, IMAGE_TYPE)], ["image_id", "image"])

    return files.select(F.xxhash64("path").alias("image_id"), "path", "content").mapInArrow(run, IMAGE_ROWS)


def watch(spark: SparkSession, folder: str, out: str, checkpoint: str, *kernels: Kernel, pattern: str = "*.png", each: Callable[[DataFrame, int], None] | None = None, once: bool = True) -> StreamingQuery:
    """Runs the kernels on every new image and appends the results to Parquet, or hands each batch to ``each``.

    ``once`` takes what is there and stops; otherwise the query goes on.
    """
    writer = map_images(image_stream(spark, folder, pattern), *kernels).writeStream.option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")
    if each is not None:
        return writer.foreachBatch(each).start()
    return writer.format("parquet").option("path", out).start()
