"""Scans and sinks of image files, a Python data source of VLIB rasters, and ordered configurations."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from pagelattice.kernels.filters import to_gray
from pagelattice.schemas import IMAGE_ROWS, to_array, to_struct
from pagelattice.sources import codecs


def list_files(spark: SparkSession, path: str, pattern: str = "*", hidden: bool = False) -> DataFrame:
    """(path, name, length) of the files of a folder in order of path; dot files only if ``hidden``. No file is opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", F.substring_index("path", "/", -1).alias("name"), "length")
    return (files if hidden else files.where(~F.col("name").startswith("."))).orderBy("path")


def read_images(spark: SparkSession, path: str, pattern: str = "*", gray: bool = False) -> DataFrame:
    """(image_id, image) of a folder or file: PNG, PGM, PPM and VLIB by our codecs, in the tasks that read them.

    ``image_id`` is a hash of the path; a file that can't be decoded raises, with its path.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(F.xxhash64("path").alias("image_id"), "path", "content")

    def run(batches):
        for batch in batches:
            rows = []
            for p, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                try:
                    a = codecs.decode(data)
                except Exception as e:
                    raise ValueError(f"{p}: {e}") from e
                rows.append(to_struct(to_gray(a) if gray else a, p))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, IMAGE_TYPE)], ["image_id", "image"])

    return files.mapInArrow(run, IMAGE_ROWS)


IMAGE_TYPE = pa.struct([("origin", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("nChannels", pa.int32()), ("mode", pa.int32()), ("data", pa.binary())])


def read_builtin(spark: SparkSession, path: str) -> DataFrame:
    """The same through Spark's own image source (JPEG, PNG, BMP and GIF through the JVM)."""
    return spark.read.format("image").option("dropInvalid", True).load(path).select(F.xxhash64("image.origin").alias("image_id"), "image")


class VlibPartition(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class VlibReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        names = [self.path] if os.path.isfile(self.path) else sorted(os.path.join(self.path, n) for n in os.listdir(self.path) if n.endswith(".vlib"))
        return [VlibPartition(n) for n in names]

    def read(self, partition) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            a = codecs.read_vlib(f.read())
        s = to_struct(a, partition.path)
        yield (os.path.basename(partition.path), s["height"], s["width"], s["data"])


class VlibWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator) -> WriterCommitMessage:
        os.makedirs(self.path, exist_ok=True)
        for r in iterator:
            a = to_array({"height": r["height"], "width": r["width"], "nChannels": 1, "mode": 0, "data": bytes(r["data"])})
            with open(os.path.join(self.path, r["name"]), "wb") as f:
                f.write(codecs.write_vlib(a))
        return WriterCommitMessage()


class VlibSource(DataSource):
    """``spark.read.format("vlib").load(folder)``: one file is one partition; the folder must be one that all executors mount."""

    @classmethod
    def name(cls) -> str:
        return "vlib"

    def schema(self) -> str:
        return "name string, height int, width int, data binary"

    def reader(self, schema) -> DataSourceReader:
        return VlibReader(self.options["path"])

    def writer(self, schema, overwrite) -> DataSourceWriter:
        return VlibWriter(self.options["path"])


def write_images(images: DataFrame, path: str) -> None:
    """Images as Parquet, the primary sink: partitioned writes, any store Spark writes to."""
    images.write.mode("overwrite").parquet(path)


def export_images(images: DataFrame, folder: str) -> None:
    """One PNG for each image under its origin's name, in a folder that all executors mount."""

    def save(rows):
        os.makedirs(folder, exist_ok=True)
        for r in rows:
            name = os.path.splitext(os.path.basename(r["image"]["origin"] or str(r["image_id"])))[0] + ".png"
            with open(os.path.join(folder, name), "wb") as f:
                f.write(codecs.write_png(to_array(r["image"].asDict())))

    images.foreachPartition(save)


def write_texts(texts: DataFrame, path: str) -> None:
    """(image_id, text) as Parquet."""
    texts.write.mode("overwrite").parquet(path)


class Config:
    """Ordered key = value pairs; keys may repeat. Reading stops at the first line without an equals sign."""

    def __init__(self, pairs: list[tuple[str, str]]):
        self.pairs = list(pairs)

    @classmethod
    def parse(cls, text: str) -> Config:
        pairs = []
        for line in text.splitlines():
            key, sign, value = line.partition("=")
            if not sign:
                break
            pairs.append((key, value))
        return cls(pairs)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Config:
        rows = spark.read.text(path, wholetext=True).collect()
        return cls.parse("".join(r["value"] for r in rows))

    def get(self, key: str, default: str = "") -> str:
        return next((v for k, v in self.pairs if k == key), default)

    def take(self, key: str, default: str = "") -> str:
        """The first value of a key, which is removed."""
        for n, (k, v) in enumerate(self.pairs):
            if k == key:
                del self.pairs[n]
                return v
        return default

    def __len__(self) -> int:
        return len(self.pairs)

    def __getitem__(self, n: int) -> tuple[str, str]:
        return self.pairs[n]
