"""Shared pieces of the training-data operators: reading tables, Arrow mapping, cutting lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: The word of all contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts handed to a Python function at once hold about this many characters, however long single texts are.
CHUNK_CHARS = 4_000_000

ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(column: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(column, _UPPER, _LOWER)


def crc_remainder(column: Column, mod: int) -> Column:
    """crc32 of the id written as decimal text, mod; null ids count as remainder -1."""
    return F.coalesce(F.crc32(column.cast("string")) % mod, F.lit(-1).cast("long"))


def ascii_lower_text(text: str) -> str:
    """Lower-cases A-Z alone, keeping offsets; fast for pure ASCII."""
    return text.lower() if text.isascii() else text.translate(ASCII_LOWER)


def map_arrow(df: DataFrame, fn: Callable, schema: str, text_column: str | None = "text") -> DataFrame:
    """fn(dict of column lists) -> dict of column lists, over slices of about CHUNK_CHARS characters; state that must span slices belongs to fold_arrow."""
    ddl = StructType.fromDDL(schema)
    names = list(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(ddl)
        for piece in slices(batches, names, text_column):
            out = fn(piece)
            if len(out[ddl[0].name]):
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, ddl)


def fold_arrow(df: DataFrame, fn: Callable, schema: str, text_column: str | None = "text", chars: int = CHUNK_CHARS) -> DataFrame:
    """fn(iterator of dicts of column lists) -> iterator of dicts of column lists; one call for each partition."""
    ddl = StructType.fromDDL(schema)
    names = list(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(ddl)
        for out in fn(slices(batches, names, text_column, chars)):
            if len(out[ddl[0].name]):
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, ddl)


def map_batches(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """fn(iterator of record batches) -> iterator of dicts of column lists or arrays, for numbers that numpy reads as they lie; one call for each partition."""
    ddl = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(ddl)
        for out in fn(b for b in batches if b.num_rows):
            if len(out[ddl[0].name]):
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, ddl)


def slices(batches: Iterator[pa.RecordBatch], names: list[str], text_column: str | None, chars: int = CHUNK_CHARS) -> Iterator[dict[str, list]]:
    """Batches cut so that each piece holds about so many characters of text; no row is cut or left out."""
    for batch in batches:
        n = batch.num_rows
        if not text_column:
            if n:
                yield {c: batch.column(i).to_pylist() for i, c in enumerate(names)}
            continue
        at = names.index(text_column)
        start = 0
        lengths = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_pylist()
        size = 0
        for row in range(n):
            size += lengths[row]
            if size >= chars or row == n - 1:
                part = batch.slice(start, row + 1 - start)
                yield {c: part.column(i).to_pylist() for i, c in enumerate(names)}
                start, size = row + 1, 0


#: A dense table in blocks, each of them compressed bytes; part tells the tasks' tables apart.
BLOCKS = "block int, part long, counts binary"
#: Tables of one block that are merged at once.
MERGED = 64


def _packed(block: np.ndarray) -> bytes:
    return block.nbytes.to_bytes(8, "little") + pa.compress(block.tobytes(), codec="zstd", asbytes=True)


def _unpacked(packed: bytes, dtype) -> np.ndarray:
    return np.frombuffer(pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True), dtype=dtype)


def blocks_of(table: np.ndarray, blocks: int) -> dict:
    """Rows of BLOCKS from a task's table."""
    from pyspark import TaskContext

    pieces = np.ascontiguousarray(table).reshape(blocks, -1)
    return {"block": list(range(blocks)), "part": [TaskContext.get().partitionId()] * blocks, "counts": list(map(_packed, pieces))}


def merged_blocks(partial: DataFrame, blocks: int | list[int], size: int, merge: np.ufunc, dtype=np.int64, last: Callable | None = None, last_dtype=None) -> np.ndarray:
    """All tasks' tables merged by an operation that doesn't depend on order, MERGED blocks at once, in as many levels as that takes.

    blocks: the number of equal blocks, or the sizes of all. last is applied to each merged block. What reaches the
    driver has the size of one table.
    """

    def fold(rows):
        import pandas as pd

        total = None
        for c in rows["counts"]:
            one = _unpacked(c, dtype)
            total = one.copy() if total is None else merge(total, one, out=total)
        return pd.DataFrame({"block": rows["block"][:1], "part": rows["part"][:1] // MERGED, "counts": [_packed(total)]})

    def finish(rows):
        out = fold(rows)
        if last:
            out["counts"] = [_packed(last(_unpacked(out["counts"][0], dtype)))]
        return out

    parts = partial.rdd.getNumPartitions()
    while parts > MERGED:
        partial = partial.groupBy("block", F.floor(F.col("part") / F.lit(MERGED)).alias("p")).applyInPandas(fold, BLOCKS)
        parts = -(-parts // MERGED)
    sizes = blocks if isinstance(blocks, list) else [size // blocks] * blocks
    shrink = 2 if last_dtype is not None else 1  # entries are made of two counts each
    starts = np.cumsum([0, *sizes]) // shrink
    out = np.zeros(starts[-1], dtype=last_dtype or dtype)
    merged = partial.groupBy("block").applyInPandas(finish, BLOCKS).select("block", "counts").toArrow()
    for b, c in zip(merged.column("block"), merged.column("counts"), strict=True):
        i = b.as_py()
        out[starts[i] : starts[i + 1]] = _unpacked(c.as_py(), out.dtype)
    return out


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares; a fresh local one only where a local session names none, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="annalist-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def settle(df: DataFrame, name: str = "table", partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Writes the rows as Parquet into the shared folder and reads them back: lineage ends there, and a lost executor costs a re-read."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/annalist/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def drop_settled(df: DataFrame) -> None:
    """Removes a table that settle() wrote once nothing reads it any more."""
    path = getattr(df, "_settled_at", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def small_enough_to_broadcast(df: DataFrame, most_rows: int) -> bool:
    """Whether a settled or cheap table holds at most so many rows."""
    return df.limit(most_rows + 1).count() <= most_rows
