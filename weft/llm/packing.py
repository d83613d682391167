"""Best-fit packing by minimum bin slack.

Bins are filled one after another.  For each, a subset-sum table (one bit per fill, built by shifts over the lengths
still available) finds the fullest feasible combination, which is then removed.  Only the histogram of lengths enters
that search: a combination stays the fullest one as long as its members last, so it is used for as many bins as it
can fill and the search is repeated a bounded number of times, however many pieces there are.  Pieces then find their
place by rank among pieces of equal length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.llm.common import per_text, utf8, worker_cache
from weft.plans.runtime import materialize

CAPACITY = 2048
ROWS_PER_BUCKET = 50_000
WORDS_REMEMBERED = 600_000


def fullest(counts: list[int], capacity: int) -> list[tuple[int, int]]:
    """(length, how many) of the fullest combination of available lengths; of equally full ones, that with the longest lengths.

    ``counts[l]`` pieces of length l are available.
    """
    lengths = [n for n in range(1, capacity + 1) if counts[n]]
    reach, below = 1, []
    mask = (1 << (capacity + 1)) - 1
    for n in lengths:
        below.append(reach)
        left, step = min(counts[n], capacity // n), 1
        while left > 0:  # copies in powers of two
            take = min(step, left)
            reach |= (reach << (take * n)) & mask
            left, step = left - take, step * 2
    rest = reach.bit_length() - 1
    out = []
    for n, lower in zip(reversed(lengths), reversed(below), strict=True):
        for k in range(min(counts[n], rest // n), -1, -1):
            if lower >> (rest - k * n) & 1:
                break
        if k:
            out.append((n, k))
            rest -= k * n
        if not rest:
            break
    return out


def plan(counts: list[int], capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """Combinations and the number of bins each fills, in the order in which minimum bin slack finds them."""
    counts, out = list(counts), []
    while any(counts):
        combo = fullest(counts, capacity)
        times = min(counts[n] // k for n, k in combo)
        for n, k in combo:
            counts[n] -= k * times
        out.append((combo, times))
    return out


class Places:
    """Where the r-th piece of each length goes, as arrays searched by (length, rank)."""

    def __init__(self, combos: list[tuple[list[tuple[int, int]], int]]):
        used: dict[int, int] = {}
        rows, first = [], 0
        for combo, times in combos:
            offset = 0
            for n, k in combo:
                rows.append((n, used.get(n, 0), k, first, offset))
                used[n] = used.get(n, 0) + k * times
                offset += n * k
            first += times
        rows.sort()
        self.length, self.base, self.each, self.first, self.offset = (np.array(x, np.int64) for x in (zip(*rows, strict=True) if rows else [()] * 5))

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of each piece."""
        at = np.searchsorted(self._key(self.length, self.base), self._key(length, rank), side="right") - 1
        k = rank - self.base[at]
        return self.first[at] + k // self.each[at], self.offset[at] + (k % self.each[at]) * length

    @staticmethod
    def _key(length: np.ndarray, rank: np.ndarray) -> np.ndarray:
        return (length << np.int64(48)) | rank


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; needs ``doc_id``, ``piece`` and ``length`` (1 to ``capacity``).

    Ranks are taken within buckets of each length, so a length that many pieces share is spread over tasks.  Buckets
    number about one per 50,000 rows.  Equal pieces (same id and number) are told apart by nothing but their place.
    A null id is ranked like any other.  What reaches the driver has at most ``capacity`` rows.
    """
    spark = pieces.sparkSession
    bucket = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(max(1, pieces.count() // ROWS_PER_BUCKET)))
    parted = pieces.withColumn("_bucket", bucket)
    each = materialize(parted.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n")), "lengths")
    counts = [0] * (capacity + 1)
    for row in each.groupBy("length").agg(F.sum("_n").alias("n")).collect():
        if not 1 <= row.length <= capacity:
            raise ValueError(f"a piece has length {row.length}")
        counts[row.length] = row.n
    places = spark.sparkContext.broadcast(vars(Places(plan(counts, capacity))))  # plain arrays: workers need no copy of this package
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = each.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long"))).drop("_n")
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece")
    ranked = parted.withColumn("_rank", F.row_number().over(within) - 1).join(starts, ["length", "_bucket"])

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        found = Places.__new__(Places)
        vars(found).update(places.value)
        sequence, offset = found.find(length.to_numpy(np.int64), rank.to_numpy(np.int64))
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    out = ranked.withColumn("_at", place("length", F.col("_rank") + F.col("_before")))
    return out.select(*pieces.columns, "_at.sequence_id", "_at.offset")


def cut(ids: np.ndarray, capacity: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32 of its ids) of a document's ids."""
    return [(k, a, len(x := ids[a : a + capacity]), zlib.crc32(x.tobytes())) for k, a in enumerate(range(0, len(ids), capacity))]


_TAIL = re.compile(rb"(.*[a-z])([,.;:!?]+)", re.DOTALL)


def word_encoder(path: str, remembered: int = WORDS_REMEMBERED) -> Callable[[str | None], np.ndarray]:
    """Ids of a text by the ``tokenizers`` file at ``path``, with no special tokens added; where the text itself holds the
    string of one, the library gives its id, and so does this.

    The text is cut at these strings first.  The tokenizer lowers case, drops white space and never joins what stands on
    its two sides, so the ids of what is between are those of its words one after another; nor does it join a letter with
    a following stop.  Words met before are looked
    up; at most ``remembered`` of them are kept, then all are dropped.  New words of letters alone go to the tokenizer
    in one string, whose ids part after each that ends a word.
    """
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already use all cores
    from tokenizers import Tokenizer

    store = worker_cache(f"tokenizer {path}")
    if "encoder" not in store:
        encoder = store["encoder"] = Tokenizer.from_file(path)
        encoder.encode_special_tokens = True  # for words, which hold none any more
        store["words"] = {}
        added = encoder.get_added_tokens_decoder()
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("a special token is not a plain string")
        store["special"] = {t.content.encode(): np.array([i], "<u4").tobytes() for i, t in added.items()}
        store["cut"] = re.compile(b"(" + b"|".join(sorted(map(re.escape, store["special"]), key=len, reverse=True)) + b")") if added else None
        store["ends"] = np.array([(encoder.id_to_token(i) or "").endswith("</w>") for i in range(encoder.get_vocab_size())])
    encoder, known, ends, special, cut_at = (store[x] for x in ("encoder", "words", "ends", "special", "cut"))

    def look_up(new: list[bytes]) -> None:
        plain, other = [], []
        for w in new:
            (plain if w.isalpha() or w.decode("utf-8", "surrogatepass").isalpha() else other).append(w)
        for at in range(0, len(plain), 1 << 14):
            some = plain[at : at + (1 << 14)]
            ids = np.array(encoder.encode(b" ".join(some).decode("utf-8", "surrogatepass"), add_special_tokens=False).ids, "<u4")
            stops = np.flatnonzero(ends[ids]) + 1
            if len(stops) != len(some):
                other += some
                continue
            data, stop = ids.tobytes(), (4 * stops).tolist()
            known.update(zip(some, [data[a:b] for a, b in zip([0, *stop], stop, strict=False)], strict=True))
        for at in range(0, len(other), 1 << 14):
            some = other[at : at + (1 << 14)]
            found = encoder.encode_batch_fast([w.decode("utf-8", "surrogatepass") for w in some], add_special_tokens=False)
            known.update(zip(some, [np.array(e.ids, "<u4").tobytes() for e in found], strict=True))

    def encode(text: str | None) -> np.ndarray:
        data = utf8(text)
        if cut_at is not None and len(parts := cut_at.split(data)) > 1:
            return np.frombuffer(b"".join(special[x] if k % 2 else plain(x) for k, x in enumerate(parts)), "<u4")
        return np.frombuffer(plain(data), "<u4")

    def plain(data: bytes) -> bytes:
        words = data.lower().split()
        missing = [w for w in set(words) if w not in known]
        if missing:
            if len(known) + len(missing) > remembered:
                known.clear()
                missing = list(set(words))
            tails = {w: m.groups() for w in missing if (m := _TAIL.fullmatch(w))}
            parts = {x for w in missing for x in tails.get(w, (w,))}
            look_up([x for x in parts if x not in known])
            known.update({w: known[a] + known[b] for w, (a, b) in tails.items()})
        return b"".join(map(known.__getitem__, words))

    return encode


def pieces_of(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents: a document is its ids and then id 0; only one longer than ``capacity`` is cut.

    Null text counts as empty and gives one piece of length 1.
    """

    def make() -> Callable[[str | None], Iterable[tuple]]:
        encode = word_encoder(tokenizer)
        end = np.zeros(1, "<u4")
        return lambda text: cut(np.concatenate((encode(text), end)), capacity)

    return per_text(df, id_col, text_col, make, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: ``doc_id piece start length ids_crc32 sequence_id offset``.

    Repeated rows are packed once each.  An empty table gives no rows.  Other columns are not read.
    """
    return pack(materialize(pieces_of(df, tokenizer, id_col, text_col, capacity), "pieces"), capacity)


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Pieces of every row of ``documents`` and their places in sequences of 2,048 tokens: null text as empty (one piece with
    id 0 alone), repeated rows and null ids packed once each."""
    import public_tokenizers

    from weft.llm.common import table

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
