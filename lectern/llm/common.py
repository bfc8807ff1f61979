"""Pieces that several corpus operators share: shared-folder tables, word hashing, Arrow row mapping.

Hashes are 64 bits wide throughout; two different values that share one are treated as equal.
"""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE_CLASS = r"[^\x20\x09-\x0D]+"
U64 = np.uint64
GOLD = U64(0x9E3779B97F4A7C15)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a session in one JVM (tests) gets a temporary
    folder for its life; on a cluster, whose executors couldn't read that, it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="lectern-"))
    return base.rstrip("/")


_OWN: dict[str, str] = {}


def spare(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of our own that no column of df has, whatever its columns are called."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: With this setting Spark deletes a query's shuffle files as the query ends, and not once the driver happens to collect its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends, lost executors cost nothing, and what was shuffled
    for it goes at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lectern-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        writer = df.write
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by materialize, once all that was made from them is in tables of its own."""
    for df in tables:
        files = df.inputFiles()
        if files:
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            while "=" in folder.getName():  # of a column that the table is partitioned by
                folder = folder.getParent()
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def keep_where(df: DataFrame, condition: Column) -> DataFrame:
    """Filter behind a barrier: Catalyst doesn't push the condition into the projection that makes its columns, where deep
    expressions would be copied into it and evaluated twice."""
    (row,) = spare(df, "__row")
    return df.withColumn(row, F.monotonically_increasing_id()).where(condition & (F.col(row) >= 0)).drop(row)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(col: str | Column, modulus: int) -> Column:
    """crc32 of the value as text, modulo; a null value counts as empty text."""
    col = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % modulus


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher on a copy of an uint64 array."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def trim() -> None:
    """Give memory that a worker holds from earlier tasks back to the system; workers are used again."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        return


def _words_table() -> tuple[np.ndarray, np.ndarray]:
    space = np.zeros(256, bool)
    space[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
    return space, mix(np.arange(1, 257, dtype=U64) * GOLD)


_SPACE, _BYTE = _words_table()
_POWERS: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]
_STEP = U64(0x5851F42D4C957F2D)
_BACK = U64(pow(0x5851F42D4C957F2D, -1, 1 << 64))


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased words of all texts, and the number of words of each.

    Words are runs without \\x20 and \\x09-\\x0D, only A-Z are lower-cased. A word's hash is a polynomial of its bytes modulo 2**64,
    taken from running sums, so that a block of texts is hashed at once.
    """
    data = b"\n".join(t or b"" for t in texts).lower()
    n = len(data)
    if len(_POWERS[0]) <= n:
        for k, step in enumerate((_STEP, _BACK)):
            grown = np.full(n + n // 8 + 1, step, U64)
            grown[0] = 1
            _POWERS[k] = np.multiply.accumulate(grown)
    raw = np.frombuffer(data, np.uint8)
    gap = np.ones(n + 2, bool)
    gap[1:-1] = _SPACE[raw]
    starts = np.flatnonzero(gap[:-2] & ~gap[1:-1])
    ends = np.flatnonzero(~gap[1:-1] & gap[2:]) + 1
    sums = np.zeros(n + 1, U64)
    np.multiply(_BYTE[raw], _POWERS[0][:n], out=sums[1:])
    np.cumsum(sums, out=sums)
    hashes = mix((sums[ends] - sums[starts]) * _POWERS[1][starts] + (ends - starts).astype(U64) * GOLD)
    bounds = np.cumsum(np.fromiter((len(t) + 1 if t else 1 for t in texts), np.int64, len(texts)))
    upto = np.searchsorted(starts, bounds)
    return hashes, np.diff(upto, prepend=0)


def sliced(batch: pa.RecordBatch, column: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose text column has about `most` bytes each, so that a worker's memory doesn't follow the batch."""
    if not batch.num_rows:
        return
    data = batch.column(column)
    if not pa.types.is_string(data.type):
        yield batch
        return
    ends = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


#: Bytes of an Arrow batch between the JVM and Python, unless the session has a setting of its own.
BATCH_BYTES = "4m"


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow over batches of bounded bytes. Spark's own bound is 64 MB, which a task holds several times over: in the JVM's
    direct memory, which grows by doubling, and in the worker. Plans read the bound when they run, so that it stays in the
    session where it was left at Spark's default; a value that the caller chose is kept."""
    conf = df.sparkSession.conf
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name, None) in (None, "67108864b", "67108864", "64m", "64MB"):
        conf.set(name, BATCH_BYTES)
    return df.mapInArrow(fn, schema)


def binary_values(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a text column; other types are read as their text."""
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type)):
        column = column.cast(pa.string())
    return column.cast(pa.binary()).to_pylist() if not pa.types.is_binary(column.type) else column.to_pylist()


def map_texts(
    df: DataFrame,
    text_col: str,
    fn: Callable[[list[bytes | None]], Sequence],
    fields: T.StructType,
    keep: Sequence[str] | None = None,
    out: str | None = None,
) -> DataFrame:
    """Apply fn to the texts of each Arrow batch and append its columns to the kept ones.

    keep: columns handed through (None: all). out: if given, the new columns are one struct of that name.
    A kept column that has the name of a new one gives way to it.
    """
    new_names = {out} if out else set(fields.fieldNames())
    names = [c for c in (df.columns if keep is None else keep) if c not in new_names]
    schema = T.StructType([df.schema[c] for c in names] + ([T.StructField(out, fields)] if out else fields.fields))
    arrow = to_arrow(fields)
    width = len(names)
    # a kept text goes to Python once
    at = names.index(text_col) if text_col in names and isinstance(df.schema[text_col].dataType, T.StringType) else width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()
        for batch in (part for whole in batches for part in sliced(whole, at)):
            made = [pa.array(v, type=f.type) if not isinstance(v, (pa.Array, pa.ChunkedArray)) else v for v, f in zip(fn(binary_values(batch.column(at))), arrow)]
            cols = list(batch.columns[:width])
            if out:
                yield pa.RecordBatch.from_arrays([*cols, pa.StructArray.from_arrays(made, fields=list(arrow))], names=[*names, out])
            else:
                yield pa.RecordBatch.from_arrays([*cols, *made], names=[*names, *fields.fieldNames()])
        batch = made = cols = None
        trim()

    source = df.select(*[df[c] for c in names], *([df[text_col].cast("string").alias(spare(df, "__text")[0])] if at == width else []))
    return arrow_map(source, run, schema)


def to_arrow(fields: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(fields)


def merged_counters(rows: DataFrame, keys: Callable[[pa.RecordBatch], np.ndarray], bits: int, flags: bool = False) -> np.ndarray:
    """Counters of a fixed size, 2**bits of them, over 64-bit keys: each task fills its own and sends them in segments that are added up.

    The size does not depend on the input, so that the result is safe to hold on the driver and to broadcast.
    flags: only tells whether a counter was met (a Bloom filter with one hash).
    """
    shift = U64(64 - bits)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.uint8 if flags else np.int32)
        for batch in (part for whole in batches for part in sliced(whole, 0)):
            k = (keys(batch) >> shift).astype(np.int64)
            if flags:
                total[k] = 1
            elif len(k):
                np.add.at(total, k, 1)
        yield from pack_counters(total, ["segment", "data"])
        trim()

    return unpacked_counters(arrow_map(rows, fill, "segment int, data binary"), bits, flags)


SEGMENT_BITS = 16


def pack_counters(total: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Counters in packed segments; other columns of `names` are null."""
    width = min(len(total), 1 << SEGMENT_BITS)
    parts = [zlib.compress(total[at : at + width].tobytes(), 1) for at in range(0, len(total), width)]
    given = {"segment": pa.array(range(len(parts)), pa.int32()), "data": pa.array(parts, pa.binary())}
    yield pa.RecordBatch.from_arrays([given.get(n, pa.nulls(len(parts), pa.int64())) for n in names], names=names)


def unpacked_counters(packed: DataFrame, bits: int, flags: bool = False) -> np.ndarray:
    """The sum of all tasks' packed counters (or their flags together), on the driver: its size is fixed."""
    kind = np.uint8 if flags else np.int32

    def add(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for part in parts:
            for data in part.column(part.schema.get_field_index("data")).to_pylist():
                counts = np.frombuffer(zlib.decompress(data), kind).astype(np.int64)
                total = counts if total is None else total + counts
        data = zlib.compress(np.minimum(total, np.iinfo(kind).max).astype(kind).tobytes(), 1)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([data], pa.binary())], names=["segment", "data"])

    result = np.zeros(1 << bits, kind)
    for row in packed.groupBy("segment").applyInArrow(add, "segment int, data binary").collect():
        part = np.frombuffer(zlib.decompress(bytes(row.data)), kind)
        result[row.segment * len(part) : (row.segment + 1) * len(part)] = part
    return result
