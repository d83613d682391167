"""Exact duplicates by two passes over a Bloom filter.

Pass one builds a Bloom filter whose cells say "hit once" or "hit at least twice"; a key can only be
repeated if all its cells were hit twice.  Pass two lets rows whose key fails that test pass straight
through and shuffles the others, so unique rows never cross the network.  The filter's size is fixed by
``max_filter_bits`` whatever the input: a fuller filter lets more unique rows into the shuffle but cannot
change a result.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import small_batches
from weft.plans.runtime import fresh, materialize

CELLS_PER_KEY = 16
HASHES = 4
CHUNK_BITS = 18
MAX_FILTER_BITS = 1 << 28
HOT_GROUPS = 1000


def text_key(text: Column) -> Column:
    """SHA-256 of the text in UTF-8 with A-Z lowered; null counts as empty."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.unhex(F.sha2(lowered.cast("binary"), 256))


def _cells(keys: list[bytes], n_cells: int) -> np.ndarray:
    """Cell numbers of each key, one row per key: slices of the digest, so no further hashing is needed."""
    lanes = np.frombuffer(b"".join(keys), dtype="<u8").reshape(-1, 4)[:, :HASHES]
    return (lanes & np.uint64(n_cells - 1)).astype(np.int64)


def _task_cells(n_cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            if not keys:
                continue
            cells = _cells(keys, n_cells)
            cells.sort(axis=1)
            again = np.zeros(cells.shape, dtype=bool)  # a key that hits one cell by two hashes hits it once
            again[:, 1:] = cells[:, 1:] == cells[:, :-1]
            cell, hits = np.unique(cells[~again], return_counts=True)
            chunk, start = np.unique(cell >> CHUNK_BITS, return_index=True)
            coded = ((cell & ((1 << CHUNK_BITS) - 1)) | ((hits > 1).astype(np.int64) << 31)).astype("<u4")
            parts = np.split(coded, start[1:])
            yield pa.RecordBatch.from_arrays(
                [pa.array(chunk, pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["chunk", "cells"]
            )

    return run


def _merge_chunks(batches: Iterator[pa.RecordBatch], least: int = 2) -> Iterator[pa.RecordBatch]:
    """Rows sorted by chunk: one pass, one chunk in memory.  Gives the cells hit once or more, or twice or more."""
    size, now, once, twice = 1 << CHUNK_BITS, None, None, None

    def done() -> pa.RecordBatch:
        bits = zlib.compress(np.packbits(once if least == 1 else twice, bitorder="little").tobytes(), 1)
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([bits], pa.binary())], ["chunk", "bits"])

    for batch in batches:
        for chunk, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if chunk != now:
                if now is not None:
                    yield done()
                now, once, twice = chunk, np.zeros(size, bool), np.zeros(size, bool)
            coded = np.frombuffer(cells, dtype="<u4")
            cell = coded & np.uint32((1 << CHUNK_BITS) - 1)
            twice[cell[(coded >> np.uint32(31)).astype(bool) | once[cell]]] = True
            once[cell] = True
    if now is not None:
        yield done()


def repeated_filter(keys: DataFrame, n_rows: int, max_filter_bits: int = MAX_FILTER_BITS, least: int = 2) -> tuple[np.ndarray, int]:
    """Bitmap of cells hit at least ``least`` times (1 or 2) over ``keys`` (one binary column) and its number of cells."""
    n_cells = min(max_filter_bits, 1 << max(CHUNK_BITS, (n_rows * CELLS_PER_KEY - 1).bit_length()))
    parts = keys.mapInArrow(_task_cells(n_cells), "chunk int, cells binary")
    merged = (
        parts.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(lambda batches: _merge_chunks(batches, least), "chunk int, bits binary")
    )
    bitmap = np.zeros(n_cells // 8, np.uint8)
    step = (1 << CHUNK_BITS) // 8
    for row in merged.collect():  # at most max_filter_bits / 8 bytes in all
        bitmap[row.chunk * step : (row.chunk + 1) * step] = np.frombuffer(zlib.decompress(row.bits), np.uint8)
    return bitmap, n_cells


def _maybe_repeated(spark, bitmap: np.ndarray, n_cells: int):
    shared = spark.sparkContext.broadcast(zlib.compress(bitmap.tobytes(), 1))
    cache: dict[str, np.ndarray] = {}

    @F.pandas_udf("boolean")
    def test(keys: pd.Series) -> pd.Series:
        if "bits" not in cache:
            cache["bits"] = np.frombuffer(zlib.decompress(shared.value), np.uint8)
        if not len(keys):
            return pd.Series([], dtype=bool)
        cells = _cells(list(keys), n_cells)
        return pd.Series(((cache["bits"][cells >> 3] >> (cells & 7).astype(np.uint8)) & 1).all(axis=1))

    return test


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """One row per row of ``df``: id, ``key`` (SHA-256), ``keep_id``, ``group_size``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.  ``keep_id`` is the largest id
    of the group.  A null id loses to any other; where a whole group has null ids, ``keep_id`` is null.  Rows that
    share both id and text share one verdict.  An empty table gives no rows; other columns are not read.
    """
    spark = small_batches(df).sparkSession
    keys = materialize(df.select(F.col(id_col).alias("id"), text_key(F.col(f"`{text_col}`")).alias("key")), "keys")
    n_rows = keys.count()
    bitmap, n_cells = repeated_filter(keys.select("key"), max(1, n_rows), max_filter_bits)
    flagged = keys.withColumn("maybe", _maybe_repeated(spark, bitmap, n_cells)("key"))
    alone = flagged.where(~F.col("maybe")).select("id", "key", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    maybe = flagged.where("maybe").select("id", "key")
    groups = materialize(maybe.groupBy("key").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    hot = groups.where(F.col("group_size") > n_rows // HOT_GROUPS)  # fewer than HOT_GROUPS: their rows stay where they are
    near = maybe.join(F.broadcast(hot), "key")
    far = maybe.join(F.broadcast(hot.select("key")), "key", "left_anti").join(groups, "key")
    both = near.unionByName(far).select("id", "key", "keep_id", "group_size")
    return alone.unionByName(both)


def drop_exact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """Rows of ``df``, all columns, without exact duplicates: of equal texts the row with the largest id stays.

    Unique rows are not shuffled.  Of rows with equal text and equal id (or only null ids) one stays.
    """
    spark, taken = small_batches(df).sparkSession, df
    names = []
    for name in ("_key", "_maybe", "_keep", "_again", "_hot"):
        names.append(fresh(taken, name))
        taken = taken.withColumn(names[-1], F.lit(0))
    key, maybe, keep, again, hot = names
    ident = F.col(f"`{id_col}`")
    keys = materialize(df.select(text_key(F.col(f"`{text_col}`")).alias("key")), "keys")
    n_rows = keys.count()
    bitmap, n_cells = repeated_filter(keys, max(1, n_rows), max_filter_bits)
    test = _maybe_repeated(spark, bitmap, n_cells)
    flagged = df.withColumn(key, text_key(F.col(f"`{text_col}`"))).withColumn(maybe, test(F.col(key)))
    columns = [F.col(f"`{c}`") for c in df.columns]
    alone = flagged.where(~F.col(maybe)).select(*columns)
    rows = flagged.where(F.col(maybe)).drop(maybe)
    groups = materialize(rows.groupBy(key).agg(F.max(ident).alias(keep), F.count(F.lit(1)).alias(hot)), "groups")
    large = groups.where(F.col(hot) > n_rows // HOT_GROUPS)  # fewer than HOT_GROUPS: their rows go before anything is shuffled
    rows = rows.join(F.broadcast(large), key, "left").where(F.col(hot).isNull() | ident.eqNullSafe(F.col(keep))).drop(keep, hot)
    stay = groups.select(F.col(key).alias(again), keep)
    one = rows.join(stay, (F.col(key) == F.col(again)) & ident.eqNullSafe(F.col(keep)), "left_semi")
    return alone.unionByName(one.dropDuplicates([key]).select(*columns))


def drop_ids(df: DataFrame, dropped: DataFrame, id_col: str = "doc_id", max_filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """Rows of ``df``, all columns, whose id is not in ``dropped(id)``.  Only rows that a Bloom filter of the dropped ids
    may hold are shuffled.  A null id is never dropped."""

    def key(c):
        return F.unhex(F.sha2(c.cast("string"), 256))

    name = fresh(df, "_maybe")
    bitmap, n_cells = repeated_filter(dropped.where("id IS NOT NULL").select(key(F.col("id"))), max(1, dropped.count()), max_filter_bits, least=1)
    test = _maybe_repeated(df.sparkSession, bitmap, n_cells)
    flagged = df.withColumn(name, test(F.coalesce(key(F.col(f"`{id_col}`")), F.unhex(F.sha2(F.lit(""), 256)))) & F.col(f"`{id_col}`").isNotNull())
    stay = flagged.where(~F.col(name)).drop(name)
    other = fresh(flagged, "_id")
    gone = dropped.select(F.col("id").alias(other))
    return stay.unionByName(flagged.where(F.col(name)).drop(name).join(gone, F.col(f"`{id_col}`") == F.col(other), "left_anti"))


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Group and verdict of every row of ``documents``, null text as empty; rows that share id and text share a verdict, and a
    null id loses to any other."""
    from weft.llm.common import table

    out = exact_groups(table(spark, sf_dir, "documents"))
    return out.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("key")).alias("text_sha256"),
    )


OP8_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
