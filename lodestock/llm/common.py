"""What the operators of this subpackage share: scratch tables, files, joins that survive a hot key."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_OWN: dict[str, str] = {}

#: Bytes of an Arrow batch between the JVM and Python; both sides, and each stage of a chain, hold a few.
BATCH = 4 << 20
#: Rows of a part (see part_of), as a power of two.
PART_BITS = 11
_BATCH_KEY, _UNSET = "spark.sql.execution.arrow.maxBytesPerBatch", str((64 << 20) - 1)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name in the folder that driver and executors share.

    ``spark.checkpoint.dir`` names that folder. Only where it is unset and driver and tasks are one process
    (tests) a folder of our own is made, and removed when the driver ends. What a session wrote is removed by
    clear_scratch.
    """
    return f"{_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _root(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if "root" not in _OWN:
            _OWN["root"] = tempfile.mkdtemp(prefix="lodestock-")
            atexit.register(shutil.rmtree, _OWN["root"], ignore_errors=True)
        root = "file://" + _OWN["root"]
    return f"{root.rstrip('/')}/lodestock/{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove all tables and files that this application has written to the shared folder; DataFrames that read them end with it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(_root(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def saved(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """df, written as a table in the shared folder and read again: its lineage ends there."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return what this Python worker has freed to the system: workers are kept and used again, and so would be all that one task needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def mapped(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """df.mapInArrow with batches of BATCH bytes, after which a worker gives memory back.

    The size of batches is a setting of the session; where the session has set one, that holds.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH_KEY, _UNSET) == _UNSET:
        conf.set(_BATCH_KEY, BATCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before them as it takes for df to have none of them."""
    mark = "_"
    while {(mark + n).lower() for n in names} & {c.lower() for c in df.columns}:
        mark += "_"
    return [mark + n for n in names]


def put_file(uri: str, data: bytes) -> None:
    """Write one file of the shared folder from a task.

    Written under another name and moved, so that a lost executor leaves no half file; a task that
    runs again writes the same bytes under the same name.
    """
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path.rpartition('/')[0]}/_{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, path)


def with_row(docs: DataFrame, name: str, row: str = "row") -> DataFrame:
    """docs as a table of the shared folder, with a number that names each row. What is written is not computed anew, so the numbers stay."""
    return saved(docs.withColumn(row, F.monotonically_increasing_id()), name, "zstd")


def part_of(row: Column) -> Column:
    """The part of with_row's table that a row is in: PART_ROWS rows that follow each other in one task's output."""
    return F.shiftleft(F.shiftright(row, 33), 33 - PART_BITS).bitwiseOR(F.shiftright(row.bitwiseAND(F.lit((1 << 33) - 1)), PART_BITS))


def write_parts(rows: DataFrame, path: str, cols: tuple[str, ...]) -> int:
    """Write each part's rows (column part, and cols as sorted little-endian longs) to a file of its own; how many tasks wrote any."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        now = None

        def flush() -> None:
            put_file(f"{path}/{now:016x}", np.concatenate(held, 1).astype("<i8").tobytes())

        for batch in batches:
            parts = np.asarray(batch.column(0))
            values = np.stack([np.asarray(batch.column(1 + k)) for k in range(len(cols))])
            for part in np.unique(parts).tolist():
                if part != now and held:
                    flush()
                    held = []
                now = part
                held.append(values[:, parts == part])
        if held:
            flush()
        yield pa.RecordBatch.from_pydict({"n": pa.array([int(now is not None)], pa.int64())})

    spread = rows.select("part", *cols).repartition(shuffle_parts(rows.sparkSession), "part").sortWithinPartitions("part", *cols)
    return saved(mapped(spread, write, "n long"), "part-files").filter("n > 0").count()


def read_part(path: str, part: int, cols: int) -> np.ndarray:
    """What write_parts wrote of a part: an array with a row for each of cols."""
    data = get_file(f"{path}/{part:016x}")
    return np.frombuffer(data or b"", "<i8").reshape(cols, -1)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column in a row and the len + 1 offsets of its values; null is empty."""
    col = batch.column(batch.schema.get_field_index(name))
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def strings(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The values of a string column; null is empty."""
    col = batch.column(batch.schema.get_field_index(name))
    return (col.fill_null("") if col.null_count else col).to_pylist()


def sliced(batches: Iterable[pa.RecordBatch], name: str = "text", most: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """Batches in which the values of a string or binary column take about `most` bytes at most (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(name))
        col = col.cast(pa.large_binary())
        off = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
        if off[-1] - off[0] <= most:
            yield batch
            continue
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def gathered(batches: Iterable[pa.RecordBatch], name: str = "text", least: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches put together until a string column takes `least` bytes; longer ones are sliced."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in sliced(batches, name, least):
        held.append(batch)
        size += batch.column(batch.schema.get_field_index(name)).nbytes
        if size >= least:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def heavy_keys(counts: DataFrame, key: str, n: str, total: int, share: float = 1e-3) -> DataFrame:
    """Rows of `counts` (one a key) whose key holds over `share` of `total` rows: 1 / share rows at most."""
    return counts.filter(F.col(n) > F.lit(max(1.0, total * share)))


def join_skewed(rows: DataFrame, facts: DataFrame, key: str, n: str, total: int, how: str = "inner", share: float = 1e-3) -> DataFrame:
    """rows joined to facts (one row a key, `n` = how many rows have that key), whatever share a key has.

    The facts of keys with over `share` of all rows - at most 1 / share of them, by arithmetic - are
    broadcast, so the rows of hot keys stay where they are; the others are shuffled, and no group
    of theirs can pass that share. A null key joins nothing.
    """
    hot = F.broadcast(heavy_keys(facts, key, n, total, share).withColumn("_hot", F.lit(True)))
    facts_cols = [c for c in facts.columns if c != key]
    marked = rows.join(hot, key, "left")
    on_hot = marked.filter(F.col("_hot")).drop("_hot")
    rest = marked.filter(F.col("_hot").isNull()).drop("_hot", *facts_cols)
    cold = facts.filter(F.col(n) <= F.lit(max(1.0, total * share)))
    return on_hot.unionByName(rest.join(cold, key, how))


def get_file(uri: str) -> bytes | None:
    """A file that put_file wrote, or None if there is none."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if store.get_file_info(path).type == fs.FileType.NotFound:
        return None
    with store.open_input_stream(path) as data:
        return data.read()
