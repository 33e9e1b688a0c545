"""Helpers that several operators share: shared-folder tables, Arrow buffers, vectorised text hashing."""

from __future__ import annotations

import atexit
import gc
import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of text that one numpy step handles; a longer document is handled alone.
SLICE_BYTES = 1 << 20


#: Rows of an Arrow batch: texts are long, and a batch is held on both sides of the pipe to a worker.
BATCH_ROWS = 2500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":  # nobody has chosen another number
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is named and all run on one machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = jvm_dir.get() if jvm_dir.isDefined() else None
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="pagelattice-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone; the shared folder's owner cleans it
        pass


class Written:
    """A table written to the shared folder, which cuts lineage; ``drop()`` or the end of the session removes it."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/pagelattice-{uuid.uuid4().hex}"
        schema = df.schema
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(schema).parquet(self.path)
        atexit.register(_drop, self.spark, self.path)

    def drop(self) -> None:
        _drop(self.spark, self.path)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps whose result is written: it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, pa.scalar(b"" if pa.types.is_binary(column.type) else "", column.type))
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes at most, or one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: spreads every input bit over the 64 output bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class Roller:
    """Hashes of any range of a uint64 sequence from prefix sums of a polynomial modulo 2**64.

    The base is odd and so has an inverse; equal ranges get equal hashes wherever they stand.
    """

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self._pow = self._inv = np.ones(1, U64)

    def _grow(self, n: int) -> None:
        if len(self._pow) < n:
            n = 1 << (n - 1).bit_length()
            for name, b in (("_pow", self.base), ("_inv", self.inverse)):
                steps = np.full(n, b, U64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self._grow(len(values) + 1)
        out = np.zeros(len(values) + 1, U64)
        np.cumsum(values * self._pow[: len(values)], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self._inv[start])

    def grams(self, prefix: np.ndarray, k: int) -> np.ndarray:
        """The hashes of all ranges of k values."""
        n = max(0, len(prefix) - k)
        return mix((prefix[k:] - prefix[:n]) * self._inv[:n])


# bases are 3 modulo 8: their powers of powers of two stay as far from 1 as they can
BYTES_1 = Roller(0x9E3779B97F4A7C13)
BYTES_2 = Roller(0xD6E8FEB86659FD93)
WORDS_1 = Roller(0xA0761D6478BD642B)
WORDS_2 = Roller(0xE7037ED1A0B428DB)
WORDS_3 = Roller(0x8EBC6AF09C88C6E3)


def byte_values(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two values for each place, of the eight bytes that begin there; of a range, those that lie in it are summed.

    Mixing eight bytes before the linear sum keeps texts with regular differences apart.
    """
    eights = loads(data)
    return mix(eights + _LANES[0][1]), mix(eights + _LANES[1][1])


#: A range of n bytes, 8 at least, holds n - EIGHT values.
EIGHT = 7

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each document and the total) of the maximal runs of bytes not ``outside``."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~outside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    here, before = inside[1:].astype(bool), inside[:-1].astype(bool)
    starts = np.flatnonzero(here & (~before | edge))
    ends = np.flatnonzero(before & (~here | edge))
    return starts, ends, np.searchsorted(starts, offsets)


#: Words longer than this are hashed one by one.
LONG_WORD = 128
_TAIL = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], U64)
_LANES = ((U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)), (U64(0x165667B19E3779F9), U64(0xD6E8FEB86659FD93)))


def loads(data: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at each byte as one number; zeros follow the last byte."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data),), "<u8", padded, strides=(1,))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lanes: int = 2) -> tuple[np.ndarray, ...]:
    """Independent 64-bit hashes of each word: its length, then eight bytes after another, each mixed in by a bijection."""
    size = ends - starts
    eights = loads(data)
    seeds = [mix(size.astype(U64) * a + b) for a, b in _LANES[:lanes]]
    long = np.flatnonzero(size > LONG_WORD)
    live = np.arange(len(size)) if not len(long) else np.flatnonzero(size <= LONG_WORD)
    done = 0
    while len(live):
        left = size[live] - done
        value = eights[starts[live] + done] & _TAIL[np.minimum(left, 8)]
        for h, (a, b) in zip(seeds, _LANES):
            h[live] = mix((h[live] ^ value) * a + b)
        done += 8
        live = live[left > 8]
    for k in long.tolist():
        made = hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=16).digest()
        for h, v in zip(seeds, np.frombuffer(made, U64)):
            h[k] = v
    return tuple(seeds)


def ids_of(column: pa.Array) -> np.ndarray:
    """An integer column as int64; nulls, which a caller tells apart, are 0 rather than turn the column to floats."""
    return pc.fill_null(column, 0).to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def fresh(taken, *names: str) -> list[str]:
    """Column names that ``taken`` does not have, whatever the case."""
    taken = {t.lower() for t in taken}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def ddl(df: DataFrame, *more: str) -> str:
    return ", ".join([*(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in df.schema), *more])


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def text_key():
    """Tells rows of one doc_id with different texts apart."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")
