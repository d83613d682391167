"""Shared pieces of the text operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH_BYTES = 8 << 20


def small_batches(df: DataFrame, most: int = BATCH_BYTES) -> DataFrame:
    """Make the session hand Python at most ``most`` bytes of rows at a time (it may allow less), so that a worker's memory
    follows the longest text and not 64 MB of them, copied a few times over."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(key)
    size = int(now[:-1]) if now.endswith("b") and now[:-1].isdigit() else int(now) if now.lstrip("-").isdigit() else -1
    if not 0 < size <= most:
        conf.set(key, str(most))
    return df


def utf8(text: str | None) -> bytes:
    """UTF-8 of a text; null counts as empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def words(data: bytes) -> list[bytes]:
    """Maximal runs without space and U+0009 to U+000D: what ``bytes.split`` splits at, and no other byte of UTF-8."""
    return data.split()


def worker_cache(name: str) -> dict:
    """A dictionary that lives as long as the Python process: tasks that reuse a worker find what earlier ones left."""
    import sys
    import types

    store = sys.modules.setdefault("_weft_worker_cache", types.ModuleType("_weft_worker_cache")).__dict__
    store.setdefault("touched", set()).add(name)
    return store.setdefault("caches", {}).setdefault(name, {})


def begin_task(make):
    """Set a task up by ``make()``, and drop what tasks of other operators left in this worker."""
    import sys

    import pyarrow as pa

    worker_cache("")
    store = sys.modules["_weft_worker_cache"].__dict__
    store["touched"].clear()
    f = make()
    for name in set(store["caches"]) - store["touched"]:
        del store["caches"][name]
    pa.default_memory_pool().release_unused()
    return f


def per_text(df: DataFrame, id_col: str, text_col: str, make, schema: str) -> DataFrame:
    """Map (id, text) rows to rows of ``schema``: ``make()`` runs once a task and returns ``f(text) -> iterable of tuples``.

    The id comes first in each output row.  Batches are cut by the bytes they hold (``spark.sql.execution.arrow.maxBytesPerBatch``)
    and output is flushed every few thousand rows, so memory follows the longest text and not the table.
    """
    from pyspark.sql import functions as F

    small_batches(df)
    names = [part.split()[0] for part in schema.split(",")][1:]
    kind = df.schema[id_col].dataType.simpleString()
    out_schema = f"{schema.split(',')[0].split()[0]} {kind}, " + ",".join(schema.split(",")[1:])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        target, f = to_arrow_schema(parsed), begin_task(make)
        for batch in batches:
            ids, rows, texts = [], [], batch.column(1)
            for i, one in enumerate(batch.column(0).to_pylist()):
                for row in f(texts[i].as_py()):
                    ids.append(one)
                    rows.append(row)
                if len(rows) >= 4096:
                    yield build(pa, target, ids, rows)
                    ids, rows = [], []
            if rows:
                yield build(pa, target, ids, rows)

    def build(pa, target, ids, rows):
        columns = [ids, *map(list, zip(*rows, strict=True))] if names else [ids]
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, target, strict=True)], schema=target)

    from pyspark.sql.types import _parse_datatype_string

    parsed = _parse_datatype_string(out_schema)
    return df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, parsed)


def keep_texts(df: DataFrame, text_col: str, make) -> DataFrame:
    """Rows of ``df``, all columns, whose text passes: ``make()`` runs once a task and returns ``f(text) -> bool``.  Nothing is shuffled."""
    small_batches(df)
    at = [c.lower() for c in df.columns].index(text_col.lower())

    def run(batches):
        import pyarrow as pa

        test = begin_task(make)
        for batch in batches:
            yield batch.filter(pa.array([bool(test(t.as_py())) for t in batch.column(at)], pa.bool_()))

    return df.mapInArrow(run, df.schema)
