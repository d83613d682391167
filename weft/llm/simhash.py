"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints of 64 bits are cut into five blocks.  Two that differ in at most three bits agree on at least two whole
blocks, so each fingerprint is filed under its ten pairs of blocks and compared only within such a file.  Files come
out as runs of a sorted shuffle; a run yields a spanning forest of its links, never all its pairs.  The few runs too
long for that are refiled under thirteen of sixteen blocks, where no file can exceed 4,096 fingerprints.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import per_text, utf8
from weft.llm.exact_dedup import drop_ids
from weft.operators.components import star_components
from weft.plans.runtime import materialize, release

SHINGLE = 3
SEED = 42
DISTANCE = 3
LONGEST_RUN = 4096


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """SimHash of the text as a signed 64-bit integer; zero where there is no word.

    A-Z are lowered; shingles are ``width`` words joined by one space, repeats included; fewer words make one shingle.
    A bit is set where over half the XXH64 values have it.
    """
    import xxhash

    words = utf8(text).lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    width = min(width, len(words))
    starts = np.concatenate(([0], ends[: len(words) - width]))
    stops = ends[width - 1 :] - 1
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for every row, over the whole text."""

    def make() -> Callable[[str | None], Iterable[tuple]]:
        return lambda text: [(fingerprint(text),)]

    return per_text(df, id_col, text_col, make, "doc_id long, fp long")


def block_masks(blocks: int, keep: int) -> list[int]:
    """Masks, as signed integers, of every choice of ``keep`` among ``blocks`` blocks of 64 bits."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    one = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [m - (1 << 64) if (m := sum(c)) >= 1 << 63 else m for c in combinations(one, keep)]


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count((x ^ y).view(np.uint64))  # of a negative integer it would count the bits of its absolute value


def _forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links within the distance that join the run's fingerprints as far as all its links do, each joined once."""
    out, left = [], fps
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            x = frontier.pop()
            near = _apart(left, x) <= DISTANCE
            if near.any():
                found = left[near]
                out += [(int(x), int(y)) for y in found]
                frontier += list(found)
                left = left[~near]
    return out


def _links(longest: int):
    """Runs of a partition sorted by (file, key, fp): rows (a, b) of links, or (fp, null) for members of longer runs."""

    def out(a: list[int], b: list[int | None]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64))
        over = None  # key of a run whose first members have gone out already

        def settle(files, keys, fps, last: bool):
            nonlocal over
            border = np.flatnonzero((files[1:] != files[:-1]) | (keys[1:] != keys[:-1])) + 1
            starts, stops = np.concatenate(([0], border)), np.concatenate((border, [len(fps)]))
            whole = len(starts) if last else len(starts) - 1
            size = stops - starts
            a: list[int] = []
            b: list[int | None] = []
            two = starts[:whole][size[:whole] == 2]
            if over is not None and whole and size[0] == 2 and (int(files[0]), int(keys[0])) == over:
                two = two[two != 0]
            x, y = fps[two], fps[two + 1]
            near = _apart(x, y) <= DISTANCE
            a += x[near].tolist()
            b += y[near].tolist()
            for i in np.flatnonzero(size >= 2) if over is None else range(len(starts)):
                members, name = fps[starts[i] : stops[i]], (int(files[starts[i]]), int(keys[starts[i]]))
                if name == over or size[i] > longest:
                    a += members.tolist()
                    b += [None] * len(members)
                    over = name if i >= whole or i == len(starts) - 1 else None
                    if i >= whole:
                        return out(a, b), len(fps)
                elif i < whole and size[i] > 2:
                    links = _forest(members)
                    a += [p for p, _ in links]
                    b += [q for _, q in links]
            return out(a, b), int(stops[whole - 1]) if whole else 0

        for batch in batches:
            now = [np.concatenate((h, batch.column(k).to_numpy())) for k, h in enumerate(held)]
            if not len(now[0]):
                continue
            made, used = settle(*now, last=False)
            held = tuple(x[used:] for x in now)
            if made.num_rows:
                yield made
        if len(held[0]):
            made, _ = settle(*held, last=True)
            if made.num_rows:
                yield made

    return run


def _filed(fps: DataFrame, masks: list[int], longest: int) -> DataFrame:
    """``fps(fp)``, distinct, under each mask; links and members of over-long runs as rows (a, b)."""
    files = F.array(*[F.struct(F.lit(i).alias("file"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(masks)])
    rows = fps.select(F.explode(files).alias("f"), "fp").select("f.file", "f.key", "fp")
    parted = rows.repartition("file", "key").sortWithinPartitions("file", "key")
    return parted.mapInArrow(_links(longest), "a long, b long")


def links(fps: DataFrame, longest: int = LONGEST_RUN) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fps(fp)``: enough to connect whatever differs in three bits or fewer.

    ``longest`` only moves work between the two filings; refiled runs always fit.
    """
    first = materialize(_filed(fps, block_masks(5, 2), longest), "links")
    hot = first.where("b IS NULL").select(F.col("a").alias("fp")).distinct()
    if hot.isEmpty():
        return first
    again = _filed(hot, block_masks(16, 13), LONGEST_RUN)
    return first.where("b IS NOT NULL").unionByName(again)


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: ``doc_id``, ``fp`` (long) and ``component_id``, the smallest id reachable by links.

    Null and empty texts have fingerprint zero and link like any other.  Repeated rows share a fingerprint; null ids
    never name a component unless no member has an id.  An empty table gives no rows; other columns are not read.
    """
    docs = materialize(fingerprints(df, id_col, text_col), "fps")
    fps = materialize(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "fp")
    found = star_components(links(fps.select("fp"))).withColumnRenamed("node", "fp")
    labelled = materialize(fps.join(found, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("c")), "named")
    named = labelled.groupBy("c").agg(F.min("least").alias("component_id"))
    by_fp = labelled.join(named, "c").select("fp", "component_id")
    release(fps)
    return docs.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def drop_near(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``df``, all columns, of which each group of near-duplicates keeps the row with the smallest id.

    Rows without an id stay.  Rows that share the id that stays all stay.
    """
    groups = near_groups(df, id_col, text_col).where("doc_id IS NOT NULL AND doc_id <> component_id")
    return drop_ids(df, materialize(groups.select(F.col("doc_id").alias("id")).distinct(), "dropped"), id_col)


def op10_simhash(spark, sf_dir: str) -> DataFrame:
    from weft.llm.common import table

    out = near_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
