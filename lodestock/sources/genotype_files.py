"""Genotype files as long tables (id, marker, dosage).

All reading goes through Spark's own readers, so files may lie in any store Spark knows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the binary format: its first bytes, and the dosage of each two-bit code (3 bits set: missing).
BED_MAGIC = b"\x6c\x1b\x01"
BED_CODES = (2, None, 1, 0)


def _table(spark: SparkSession, path: str, width: int) -> list[list[str]]:
    """A small text table on the driver (samples or markers); a line of another width is an error that names it."""
    rows = [line.split() for line in b"\n".join(bytes(r.content) for r in spark.read.format("binaryFile").load(path).collect()).decode().splitlines() if line.strip()]
    for k, row in enumerate(rows):
        if len(row) != width:
            raise ValueError(f"{path}, line {k + 1}: {len(row)} fields, not {width}")
    return rows


def sample_ids(rows: list[list[str]], id: str = "iid") -> list[str]:
    """IIDs, or FID_IID; an IID in two families is an error unless families are part of it."""
    names = [r[1] if id == "iid" else f"{r[0]}_{r[1]}" for r in rows]
    if len(set(names)) < len(names):
        twice = sorted({n for n in names if names.count(n) > 1})
        raise ValueError(f"ids that are not unique: {twice[:3]} (families {sorted({r[0] for r, n in zip(rows, names, strict=True) if n in twice})[:4]})")
    return names


def read_plink(spark: SparkSession, prefix: str, id: str = "iid", markers_a_task: int = 1000) -> tuple[DataFrame, DataFrame]:
    """((id, marker, dosage), map) of .bed/.bim/.fam, the dosage being that of the first allele.

    The file is marker-major: it is cut into ranges of markers, and each range is decoded from its bytes in a task.
    """
    ids = sample_ids(_table(spark, f"{prefix}.fam", 6), id)
    marks = _table(spark, f"{prefix}.bim", 6)
    names, stride = [m[1] for m in marks], -(-len(ids) // 4)
    lookup = np.array([[5 if BED_CODES[b >> s & 3] is None else BED_CODES[b >> s & 3] for s in (0, 2, 4, 6)] for b in range(256)], np.int8)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data = content.as_buffer()
                if bytes(data[:3]) != BED_MAGIC:
                    raise ValueError("no marker-major genotype file")
                if len(data) != 3 + stride * len(names):
                    raise ValueError(f"the file has {len(data)} bytes; {3 + stride * len(names)} were expected")
                for k in range(0, len(names), markers_a_task):
                    end = min(len(names), k + markers_a_task)
                    yield pa.RecordBatch.from_pydict({"first": pa.array([k], pa.int64()), "bytes": pa.array([bytes(data[3 + k * stride : 3 + end * stride])], pa.binary())})

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes = lookup[np.frombuffer(raw, np.uint8)].reshape(-1, stride * 4)[:, : len(ids)]
                for k, row in enumerate(codes):
                    yield pa.RecordBatch.from_pydict({"id": pa.array(ids), "marker": pa.array([names[first + k]] * len(ids)), "dosage": pa.array(row, pa.int8(), mask=row == 5)})

    files = spark.read.format("binaryFile").load(f"{prefix}.bed").select("content")
    parts = files.mapInArrow(cut, "first long, bytes binary").repartition(max(1, len(names) // markers_a_task))
    made = [(m[0], m[1], float(m[2]), float(m[3]), m[4], m[5]) for m in marks]
    return parts.mapInArrow(decode, "id string, marker string, dosage byte"), spark.createDataFrame(made, "chr string, snp string, cm double, pos double, a1 string, a2 string")


def write_plink(ids: list[str], names: list[str], dosages: np.ndarray) -> tuple[bytes, str, str]:
    """(.bed, .bim, .fam) of animals x markers, missing as 5: the inverse of read_plink, for exchange and tests."""
    code = np.array([3, 2, 0, 0, 0, 1], np.uint8)[dosages.T]
    full = np.zeros((len(names), -(-len(ids) // 4) * 4), np.uint8)
    full[:, : len(ids)] = code
    packed = full.reshape(len(names), -1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    return BED_MAGIC + packed.astype(np.uint8).tobytes(), "".join(f"1\t{n}\t0\t{k + 1}\tA\tB\n" for k, n in enumerate(names)), "".join(f"f\t{i}\t0\t0\t0\t-9\n" for i in ids)


def read_plink_raw(spark: SparkSession, path: str) -> DataFrame:
    """(id, marker, dosage) of the text form: six columns, then one a marker named NAME_ALLELE, NA for missing. Any other code is an error, as is a line of another width."""
    wide = spark.read.option("sep", " ").option("header", True).option("mode", "FAILFAST").csv(path)
    names = wide.columns[6:]
    if not names:
        raise ValueError(f"{path}: {len(wide.columns)} columns, and no marker")

    def code(n: str) -> Column:
        text = F.trim(F.col(f"`{n}`"))
        bad = F.raise_error(F.concat(F.lit(f"genotype code at {n}: "), F.coalesce(text, F.lit("none")), F.lit(" of "), F.col("IID"))).cast("byte")
        return F.when(text.isin("0", "1", "2"), text.cast("byte")).when(text == "NA", F.lit(None).cast("byte")).otherwise(bad)

    cells = F.array(*[F.struct(F.lit(n.rpartition("_")[0] or n).alias("marker"), code(n).alias("dosage")) for n in names])
    return wide.select(F.col("IID").alias("id"), F.inline(cells))


def read_snp_lines(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """(id, marker, dosage) of lines `id genotypes`, a digit a marker, 5 for missing. ids: keep those of its column id.

    A line that is not two fields, and lines of another number of markers than the longest, are errors that
    show the line: one pass over the text before the cells are made.
    """
    line = spark.read.text(path).filter(F.trim("value") != "")
    fields = F.split(F.trim("value"), r"\s+")
    rows = line.select("value", F.size(fields).alias("n"), fields[0].alias("id"), F.when(F.size(fields) == 2, fields[1]).alias("g"))
    seen = rows.agg(F.min(F.when(F.col("n") != 2, F.col("value"))).alias("bad"), F.max(F.length("g")).alias("most"), F.min(F.struct(F.length("g"), "value")).alias("least")).first()
    if seen.bad is not None:
        raise ValueError(f"{path}: a line is not an id and its genotypes: {seen.bad[:60]!r}")
    if seen.most is not None and seen.least[0] != seen.most:
        raise ValueError(f"{path}: {seen.least[0]} markers where other lines have {seen.most}: {seen.least[1][:60]!r}")
    rows = rows.select("id", "g")
    if ids is not None:
        rows = rows.join(ids.select(F.col("id").cast("string").alias("id")), "id", "left_semi")
    cells = rows.select("id", F.posexplode(F.split("g", "")).alias("at", "d")).filter("d <> ''")
    checked = F.when(F.col("d").isin("0", "1", "2", "5"), F.col("d").cast("byte")).otherwise(F.raise_error(F.concat(F.lit("genotype code "), "d")).cast("byte"))
    return cells.select("id", (F.col("at") + 1).cast("string").alias("marker"), F.nullif(checked, F.lit(5).cast("byte")).alias("dosage"))
