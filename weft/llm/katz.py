"""Katz backoff language model over words, of any order (three by default).

The model of order n has one level of n-grams for each k from 1 to n.  Counts up to five are discounted by Good-Turing;
P(w | h) is the discounted count of (h, w) over the size of h where (h, w) was seen, else alpha(h) P(w | h without its
first word), and one level below the words the mass left for unknown ones.  alpha makes every context sum to exactly
one: the share that h has left, over what the level below gives to the words not seen after h.

Words are numbers: those of up to seven bytes by these, longer ones by a 62-bit hash, all below zero; the most frequent ones
(a fixed number, broadcast) have their rank instead.  An n-gram of frequent words is named by their numbers side by side, any
other by a 63-bit hash below zero; so two long words, or two n-grams with rare words, of equal hash would count as one.  n-grams are dealt to buckets by their context,
so a bucket holds whole contexts; contexts with a large share of all tokens (their number is bounded, so they are
broadcast) are dealt by the whole n-gram instead and their sums are added up afterwards.  What is shuffled are blocks:
the distinct n-grams of a million tokens that fall in one bucket, as sorted numbers, compressed; a block has one n-gram at
least.  Tables of the model, partitioned by bucket: ``grams/order=k`` (n-grams and counts) and ``contexts/order=k`` (size and
alpha of contexts).

Scoring asks level by level: tokens whose n-gram the level has are done, the others take the context's alpha along to
the level below.  Every bucket answers the blocks sent to it, and answers go back to the batch of texts that asked.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Collection, Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import count, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import begin_task, small_batches, utf8
from weft.plans.runtime import delete, materialize, new_path, release, write_once

ORDER = 3
FREQUENT_WORDS = 500_000
DISCOUNTED = 5
PARTS = 8
SLICES = 4
TOKENS_AT_ONCE = 1 << 20
TOKENS_PER_BUCKET = 1 << 20
HOT_SHARE = 1 / 100_000  # of all tokens: at most 100,000 contexts of a level have more
LEAST_HOT = 1 << 17



def discounts(counts_of_counts: dict[int, int], top: int = DISCOUNTED) -> list[float]:
    """Good-Turing factors for counts 1 to ``top``, by Katz's formula, which leaves larger counts as they are.

    Raw counts of counts are used where they give factors in (0, 1).  Where they do not (copies of texts make twos more
    frequent than ones allow), they are smoothed by a line through their logarithms, and if that line falls too slowly
    for a discount, a count of one is halved.  The model is normalised whatever the factors are.
    """
    n = [float(counts_of_counts.get(r, 0)) for r in range(top + 2)]

    def katz(n: list[float]) -> list[float] | None:
        if not all(n[1:]) or (rest := (top + 1) * n[top + 1] / n[1]) == 1:
            return None
        d = [((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) for r in range(1, top + 1)]
        return d if all(0 < x < 1 for x in d) else None

    if (d := katz(n)) is not None:
        return d
    points = [(math.log(r), math.log(x)) for r, x in enumerate(n) if r and x]
    if len(points) > 1:
        slope, at = np.polyfit(*zip(*points, strict=True), 1)
        if slope < -1 and (d := katz([0.0] + [math.exp(at + slope * math.log(r)) for r in range(1, top + 2)])) is not None:
            return d
    return [0.5] + [1.0] * (top - 1)


def discounted(counts: np.ndarray, d: list[float]) -> np.ndarray:
    """Counts times their factors."""
    factors = np.array([1.0, *d, 1.0])
    return counts * factors[np.minimum(counts, len(d) + 1)]


SHORT = 7  # bytes of a word that fit a number together with its length


def word_number(word: bytes) -> int:
    """Number of a word, below zero.  A short word's bytes give it, so that no other has the same; of longer ones it is a
    62-bit hash, below those of short ones."""
    return -1 - (len(word) << 56 | int.from_bytes(word, "little")) if len(word) <= SHORT else int(long_numbers([word])[0])


def long_numbers(words: Collection[bytes]) -> np.ndarray:
    """Numbers of words that are not short."""
    import xxhash

    h = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(42)), np.uint64, len(words)).view(np.int64)
    return (-1 << 62) - (h & ((1 << 62) - 1))


def split_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Words of texts (A-Z lower-cased): places where each begins and how many bytes it has in the joined texts, which come
    last, and how many words each text has.  Words are what ``bytes.split`` gives."""
    joined = b"\n".join([b"", *texts, b" " * 8]).lower()
    blank = _BLANK[np.frombuffer(joined, np.uint8)]
    edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    at, length = edges[::2], edges[1::2] - edges[::2]
    begins = np.cumsum([1, *(len(text) + 1 for text in texts)])
    return at, length, np.diff(np.searchsorted(at, begins)), joined


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def short_keys(at: np.ndarray, length: np.ndarray, joined: bytes) -> np.ndarray:
    """A number from 0 on of each word of at most ``SHORT`` bytes: its bytes, least first, and above them its length.  It is -1
    for others."""
    eight = np.ndarray(len(joined) - 7, "<i8", joined, strides=(1,))
    size = np.minimum(length, SHORT)
    return np.where(length <= SHORT, eight[at] & ((np.int64(1) << 8 * size) - 1) | size << 56, -1)


def looked_up(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """What :func:`word_number` gives for the frequent words, in order, and their places."""
    numbers = np.array([word_number(w) for w in words], np.int64)
    order = np.argsort(numbers)
    return numbers[order], order


# -- n-grams as numbers ---------------------------------------------------------------------------------------------


def packed(columns: np.ndarray) -> bytes:
    """Columns of 64-bit numbers (one a row of the array) as compressed planes of bytes, least byte first, after a byte that
    says how many planes: of whole numbers as many as the largest takes, with its sign; 0 stands for floats, which take 8."""
    import zstandard

    columns = np.atleast_2d(np.ascontiguousarray(columns))
    kind = 0
    if columns.dtype == np.int64:
        kind = max(int(columns.max()), ~int(columns.min())).bit_length() // 8 + 1 if columns.size else 1
    elif columns.dtype != np.float64:
        raise TypeError(f"cannot pack {columns.dtype}")
    parts = columns.view(np.uint8).reshape(*columns.shape, 8)
    planes = np.empty((len(columns), kind or 8, columns.shape[1]), np.uint8)
    for i in range(planes.shape[1]):
        planes[:, i] = parts[:, :, i]
    return bytes([kind]) + zstandard.ZstdCompressor(level=1).compress(planes)


def unpacked(data: bytes, columns: int = 1) -> np.ndarray:
    """Columns packed so; one column as a plain array."""
    import zstandard

    kind, content = data[0], zstandard.ZstdDecompressor().decompress(memoryview(data)[1:])
    planes = np.frombuffer(content, np.uint8).reshape(columns, kind or 8, -1)
    parts = np.zeros((columns, planes.shape[2], 8), np.uint8)
    for i in range(planes.shape[1]):
        parts[:, :, i - planes.shape[1]] = planes[:, i]  # the highest plane has the sign
    out = parts.view(np.int64 if kind else np.float64).reshape(columns, -1)
    if 0 < kind < 8:
        out >>= 64 - 8 * kind
    return out[0] if columns == 1 else out


def rising(x: np.ndarray) -> bytes:
    """Sorted numbers, packed by their steps."""
    return packed(np.diff(x, prepend=0))


def risen(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data))


def distinct(x: np.ndarray) -> np.ndarray:
    """Each number once, in order: by sorting, as ``np.unique`` without places takes a hash table, some eighty times slower."""
    x = np.sort(x)
    return x[_new(x)]


def grouped(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each number once, in order, a place where it stands, and which of them each number is."""
    order = np.argsort(x)
    ordered = x[order]
    new = _new(ordered)
    which = np.empty(len(x), np.int64)
    which[order] = np.cumsum(new) - 1
    return ordered[new], order[new], which


def _new(ordered: np.ndarray) -> np.ndarray:
    out = np.ones(len(ordered), bool)
    out[1:] = ordered[1:] != ordered[:-1]
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each number."""
    h = x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(27))


def named(ids: np.ndarray, bits: int) -> np.ndarray:
    """Names of n-grams (columns of word numbers): the numbers side by side where each fits ``bits`` bits, else a 63-bit hash
    below zero."""
    plain = ((ids >= 0) & (ids < 1 << bits)).all(axis=0)
    out = np.zeros(ids.shape[1], np.int64)
    for column in ids:
        out = out << bits | np.where(plain, column, 0)
    if not plain.all():
        h = np.zeros(len(plain) - int(plain.sum()), np.int64)
        for column in ids[:, ~plain]:
            h = mixed(h ^ mixed(column).view(np.int64)).view(np.int64)
        out[~plain] = -1 - (h & 0x7FFFFFFFFFFFFFFF)
    return out


@dataclass
class Grams:
    """Distinct k-grams in order of their names, those named by a hash first; of these it has the words too."""

    plain: np.ndarray
    wide: np.ndarray  # (k, how many)
    bits: int

    def __post_init__(self) -> None:
        self.k = len(self.wide)
        self.wide_names = named(self.wide, self.bits)

    def __len__(self) -> int:
        return len(self.plain) + len(self.wide_names)

    def names(self) -> np.ndarray:
        return np.concatenate((self.wide_names, self.plain))

    def contexts(self) -> np.ndarray:
        """Name of each one's words but the last; of a single word zero."""
        return np.concatenate((_shorter(self.wide[:-1], self.bits), self.plain >> self.bits if self.k > 1 else self.plain * 0))


def _shorter(ids: np.ndarray, bits: int) -> np.ndarray:
    return named(ids, bits) if len(ids) else np.zeros(ids.shape[1], np.int64)


def summed(plain: list[np.ndarray], wide: list[np.ndarray], n_plain: list[np.ndarray], n_wide: list[np.ndarray], bits: int) -> tuple[Grams, np.ndarray, np.ndarray]:
    """n-grams of several lists, each once, and the sums of their counts: of the plain ones and of the others."""
    x, n = np.concatenate(plain), np.concatenate(n_plain)
    order = np.argsort(x)
    x, n = x[order], n[order]
    new = np.flatnonzero(_new(x))
    ids, m = np.concatenate(wide, axis=1), np.concatenate(n_wide)
    _, first, which = grouped(named(ids, bits))
    total = np.zeros(len(first), np.int64)
    np.add.at(total, which, m)
    return Grams(x[new], ids[:, first], bits), np.add.reduceat(n, new) if len(new) else n, total


def place(known: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Place of each name among the sorted ``known``, or -1."""
    if not len(known):
        return np.full(len(names), -1)
    at = np.minimum(np.searchsorted(known, names), len(known) - 1)
    return np.where(known[at] == names, at, -1)


def bucket_of(names: np.ndarray, contexts: np.ndarray, hot: np.ndarray | None, buckets: int) -> np.ndarray:
    """Bucket of each n-gram: by its context, or by its own name if the context is hot (None: all are)."""
    key = names if hot is None else np.where(place(hot, contexts) >= 0, names, contexts) if len(hot) else contexts
    return ((mixed(key) >> np.uint64(16)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)


def dealt(bucket: np.ndarray, wide: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]:
    """Order by bucket of n-grams of which the first ``wide`` are named by a hash, and for each bucket its places among these
    and among the others."""
    one, two = (np.argsort(x, kind="stable") for x in (bucket[:wide], bucket[wide:]))
    found = np.flatnonzero(np.bincount(bucket)) if len(bucket) else bucket[:0]
    cuts = [[np.searchsorted(x[o], found, side) for side in ("left", "right")] for x, o in ((bucket[:wide], one), (bucket[wide:], two))]
    parts = [(int(b), one[lo:hi], two[at:end]) for b, lo, hi, at, end in zip(found, *cuts[0], *cuts[1], strict=True)]
    return np.concatenate([np.zeros(0, np.int64), *[x for _, a, b in parts for x in (a, b + wide)]]), parts


def in_order(values: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Values given bucket after bucket, in the order of what was dealt."""
    out = np.empty_like(values)
    out[order] = values
    return out


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}


# -- texts as numbers -----------------------------------------------------------------------------------------------


class Tokens:
    """Token numbers of a batch of texts, each text's words and its end, as places in ``words`` (sorted, the begin last)."""

    def __init__(self, words: np.ndarray, local: np.ndarray, sizes: np.ndarray, chosen: np.ndarray | None = None, learns: np.ndarray | None = None):
        self.words, self.local, self.sizes = words, local, sizes
        self.learns = np.ones(len(sizes), np.int64) if learns is None else learns
        self.text = np.repeat(np.arange(len(sizes)), sizes)
        self.place = np.arange(len(local)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.chosen = np.arange(len(local)) if chosen is None else chosen

    def ids(self) -> np.ndarray:
        return self.words[self.local]

    def grams(self, k: int, bits: int) -> tuple[Grams, np.ndarray, np.ndarray]:
        """Distinct k-grams that end at the chosen tokens, which one ends at each of these, and their counts in texts that are
        learned from."""
        begin, width = len(self.words) - 1, len(self.words).bit_length()
        key, spare, ids = None, 63, None

        def window(back: int) -> np.ndarray:
            if len(self.chosen) == len(self.local):  # all are
                out = np.roll(self.local, back)
                out[self.place < back] = begin
                return out
            inside = self.place[self.chosen] >= back
            return np.where(inside, self.local[np.where(inside, self.chosen - back, 0)], begin)

        def split(found: np.ndarray, columns: int) -> np.ndarray:
            return np.stack([self.words[(found >> width * (columns - 1 - j)) & ((1 << width) - 1)] for j in range(columns)])

        columns = 0
        for back in range(k - 1, -1, -1):
            if key is None:
                key, columns, spare = window(back).astype(np.int64), 1, 63 - width
                continue
            if spare < width:  # name what there is by its rank, which has fewer bits
                found, key = np.unique(key, return_inverse=True)
                head = split(found, columns) if ids is None else np.concatenate((ids[:, found >> width * (columns - 1)], split(found, columns - 1)))
                ids, columns, spare = head, 1, 63 - len(found).bit_length()
            key, columns, spare = key.astype(np.int64) << width | window(back), columns + 1, spare - width
        found, which, n = np.unique(key, return_inverse=True, return_counts=True)
        if not self.learns.all():
            n = np.bincount(which, self.learns[self.text[self.chosen]], len(found))
        words = split(found, columns) if ids is None else np.concatenate((ids[:, found >> width * (columns - 1)], split(found, columns - 1)))
        names = named(words, bits)
        order = np.concatenate((np.flatnonzero(names < 0), np.flatnonzero(names >= 0)))
        wide = int((names < 0).sum())
        order[:wide] = order[:wide][np.argsort(names[order[:wide]], kind="stable")]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return Grams(names[order[wide:]], words[:, order[:wide]], bits), back[which], n[order].astype(np.int64)


_CODED = "sizes binary, learns binary, words binary, tokens binary, sums binary, left binary, lacking binary"


def _tokens(row: dict) -> Tokens:
    left = None if row.get("left") is None else risen(row["left"])
    learns = None if row.get("learns") is None else unpacked(row["learns"])
    return Tokens(risen(row["words"]), unpacked(row["tokens"]), unpacked(row["sizes"]), left, learns)


def read(df: DataFrame, id_col: str | None, text_col: str, learns: Column | None = None) -> DataFrame:
    """Texts, about ``TOKENS_AT_ONCE`` tokens a row: ``who keys sizes learns tokens``, tokens as places in the row's own words from
    1 on (an end is 0), ``known``, their numbers by :func:`word_number` in order, of which the first are of the ``long`` words,
    and ``times``, how often each occurs in texts that are learned from.  A text is never cut, so a row is as long as the longest text at least.  ``learns`` tells
    which texts are learned from (all)."""
    keys = F.lit(None).cast("int").alias("key") if id_col is None else F.col(f"`{id_col}`").alias("key")
    learning = F.lit(True) if learns is None else F.coalesce(learns, F.lit(False))
    rows = small_batches(df).select(keys, F.col(f"`{text_col}`").alias("text"), learning.alias("learns"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"who long, keys array<{kind}>, sizes binary, learns binary, tokens binary, known binary, long binary, times binary"
    target, at_once, keyed = _arrow(schema), TOKENS_AT_ONCE, id_col is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        def empty() -> tuple:
            return defaultdict(count().__next__), [], [], [], []

        who, size = TaskContext.get().partitionId() << 33, 0
        number, words, keys, sizes, flags = empty()

        def row() -> pa.RecordBatch:
            lengths, learned = np.concatenate(sizes), np.array(flags, np.int64)
            names, own = long_numbers(number), np.concatenate(words)
            other = own < 0
            own = -1 - own
            own[other] = names[own[other]]
            known, _, which = grouped(own)
            tokens, is_word = np.zeros(size, np.int64), np.ones(size, bool)
            is_word[np.cumsum(lengths) - 1] = False
            tokens[is_word] = which + 1
            times = np.bincount(tokens[np.repeat(learned > 0, lengths)], minlength=len(known) + 1)[1:].astype(np.int64)
            long = zstandard.ZstdCompressor(level=1).compress(b" ".join(map(list(number).__getitem__, grouped(names)[1].tolist())))
            one = {"who": who, "keys": keys if keyed else None, "sizes": packed(lengths), "learns": packed(learned)}
            return _batch([one | {"tokens": packed(tokens), "known": rising(known), "long": long, "times": packed(times)}], target)

        for batch in batches:
            own_keys, own_flags = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            at, length, n, joined = split_words([utf8(text.as_py()) for text in batch.column(1)])
            found = short_keys(at, length, joined)
            upto, tokens = np.cumsum(n), np.cumsum(n + 1)
            first = 0
            while first < len(n):
                word, token = (int(x[first - 1]) if first else 0 for x in (upto, tokens))
                last = min(int(np.searchsorted(tokens, token + at_once - size)), len(n) - 1)
                own = found[word : upto[last]]
                long = np.flatnonzero(own < 0)
                begins = at[word + long]
                pieces = map(joined.__getitem__, map(slice, begins.tolist(), (begins + length[word + long]).tolist()))
                own[long] = -1 - np.fromiter(map(number.__getitem__, pieces), np.int64, len(long))
                words.append(own.copy())
                keys += own_keys[first : last + 1]
                sizes.append(n[first : last + 1] + 1)
                flags += own_flags[first : last + 1]
                size += int(tokens[last]) - token
                if size >= at_once:
                    yield row()
                    who, size = who + 1, 0
                    number, words, keys, sizes, flags = empty()
                first = last + 1
        if size:
            yield row()

    return rows.mapInArrow(run, schema)


def _long(row: dict) -> list[bytes]:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(row["long"]).split()


def counted_words(rows: DataFrame) -> DataFrame:
    """``number word c`` of the words that are learned from, of rows as :func:`read` gives them; a short word is null, as its
    number tells it."""
    at_once = TOKENS_AT_ONCE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(numbers: np.ndarray, words: pa.Array, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(numbers), words, pa.array(n)], ["number", "word", "n"]).filter(pa.array(n > 0))

        def shorts() -> pa.RecordBatch:
            numbers, _, which = grouped(np.concatenate(short))
            sums = np.bincount(which, np.concatenate(n), len(numbers)).astype(np.int64)
            return found(numbers, pa.nulls(len(numbers), pa.binary()), sums)

        short, n = [], []
        for row in _rows(batches):
            known, times, long = risen(row["known"]), unpacked(row["times"]), _long(row)
            yield found(known[: len(long)], pa.array(long, pa.binary()), times[: len(long)])
            short.append(known[len(long) :])
            n.append(times[len(long) :])
            if sum(map(len, n)) > 2 * at_once:
                yield shorts()
                short, n = [], []
        if n:
            yield shorts()

    return rows.select("known", "long", "times").mapInArrow(run, "number long, word binary, n long").groupBy("number", "word").agg(F.sum("n").alias("c"))


def coded(rows: DataFrame, words) -> DataFrame:
    """Rows as :func:`read` gives them with tokens as numbers of the model whose frequent words ``words`` broadcasts (see
    :func:`looked_up`): ``who keys sizes learns words tokens`` and room for what is found out."""
    schema = f"who long, keys {rows.schema['keys'].dataType.simpleString()}, {_CODED}"
    target = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, places = begin_task(lambda: words.value)
        end = len(places)
        for row in _rows(batches):
            own = risen(row["known"])
            at = place(frequent, own)
            own[at >= 0] = places[at[at >= 0]]
            ids, _, which = grouped(np.append(end, own))
            one = {c: row[c] for c in ("who", "keys", "sizes", "learns")}
            yield _batch([one | {"words": rising(np.append(ids, end + 1)), "tokens": packed(which[unpacked(row["tokens"])])}], target)

    return rows.select("who", "keys", "sizes", "learns", "tokens", "known").mapInArrow(run, schema)


# -- counting -------------------------------------------------------------------------------------------------------

_BLOCK = "bucket int, plain binary, wide binary, n_plain binary, n_wide binary"


_SUMMED = f"{_BLOCK}, ladder array<long>, often binary, kind int, who long, value binary"


def _merged(blocks: DataFrame, k: int, bits: int, often: int, hot: np.ndarray | None = None) -> DataFrame:
    """Sum the blocks of each bucket: a block a bucket (kind 0), and with it ladder (how many n-grams have counts 1, 2, ...) and
    often (names of those with ``often`` or more).  Blocks are summed as they come, so that a bucket takes the memory of
    its n-grams.

    With ``hot``, every block is answered as well (kind 1): of each of its names the count, and of its context the size
    times 32 and a bit for each count up to five that occurs after it; 0 where the context does not occur, and -1 - i for
    the hot context i, whose sums are not known here.  Names that are only asked for have the count 0.
    """
    target, limit = _arrow(_SUMMED), 2 * TOKENS_PER_BUCKET
    shared = blocks.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, now, lists, waiting, asked = shared.value, None, None, 0, []

        def done() -> Iterator[pa.RecordBatch]:
            asked_for, n, m = summed(*lists, bits)
            names, every, grams = asked_for.names(), np.concatenate((m, n)), asked_for
            if not every.all():
                grams, n, m = Grams(grams.plain[n > 0], grams.wide[:, m > 0], bits), n[n > 0], m[m > 0]
            ladder = np.bincount(np.minimum(every, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[1 : DISCOUNTED + 2]
            found = {"bucket": now, "plain": rising(grams.plain), "wide": packed(grams.wide), "n_plain": packed(n), "n_wide": packed(m)}
            yield _batch([found | {"ladder": ladder.tolist(), "often": packed(names[every >= often]), "kind": 0}], target)
            if not asked:
                return
            contexts, of = np.unique(asked_for.contexts(), return_inverse=True)
            size = np.bincount(of, every, len(contexts)).astype(np.int64) * 32
            for r in range(1, DISCOUNTED + 1):
                has = np.zeros(len(contexts), np.int64)
                has[of[every == r]] = 1 << (r - 1)
                size += has
            spread = place(hot, contexts)
            about = np.where(spread >= 0, -1 - spread, size)[of]
            for who, own in asked:
                at = np.searchsorted(names, own)  # all are there, if only with the count 0
                yield _batch([{"bucket": now, "kind": 1, "who": who, "value": packed(np.stack((every[at], about[at])))}], target)

        for row in _rows(batches):
            if row["bucket"] != now:
                if now is not None:
                    yield from done()
                now, lists, waiting, asked = row["bucket"], ([], [], [], []), 0, []
            new = (risen(row["plain"]), unpacked(row["wide"], k).reshape(k, -1), unpacked(row["n_plain"]), unpacked(row["n_wide"]))
            for x, one in zip(lists, new, strict=True):
                x.append(one)
            if hot is not None:
                asked.append((row["who"], Grams(new[0], new[1], bits).names()))
            waiting += len(new[2]) + len(new[3])
            if waiting > limit:
                grams, n, m = summed(*lists, bits)
                lists, waiting = ([grams.plain], [grams.wide], [n], [m]), 0
        if now is not None:
            yield from done()

    return blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, _SUMMED)


def _blocks(grams: Grams, n: np.ndarray, hot: np.ndarray | None, buckets: int) -> list[dict]:
    wide = len(grams.wide_names)
    _, parts = dealt(bucket_of(grams.names(), grams.contexts(), hot, buckets), wide)
    return [{"bucket": b, "plain": rising(grams.plain[p]), "wide": packed(grams.wide[:, w]), "n_plain": packed(n[wide:][p]), "n_wide": packed(n[:wide][w])} for b, w, p in parts]


def _counted(tokens: DataFrame, k: int, bits: int, hot: np.ndarray, buckets: int, ask: bool = False) -> DataFrame:
    """Blocks of the k-grams of coded texts that are learned from; with ``ask`` also, with count 0, of the others."""
    schema = f"who long, {_BLOCK}"
    target, shared = _arrow(schema), tokens.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            own = _tokens(row)
            if not ask:
                own.chosen = np.flatnonzero(own.learns[own.text])
            grams, _, n = own.grams(k, bits)
            yield _batch([{"who": row["who"]} | x for x in _blocks(grams, n, shared.value, buckets)], target)

    return tokens.select("who", "sizes", "learns", "words", "tokens").mapInArrow(run, schema)


def _rare_blocks(words: DataFrame, bits: int, buckets: int) -> DataFrame:
    """Blocks of ``words(number, c)``."""
    target = _arrow(_BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                none = np.zeros(0, np.int64)
                grams, _, n = summed([none], [batch.column(0).to_numpy()[None]], [none], [batch.column(1).to_numpy()], bits)
                yield _batch(_blocks(grams, n, None, buckets), target)

    return words.select("number", "c").mapInArrow(run, _BLOCK)


# -- the model ------------------------------------------------------------------------------------------------------


@dataclass
class Model:
    path: str
    order: int
    words: list[bytes]  # frequent words, most frequent first: their numbers are their places
    counts: np.ndarray  # of the frequent words, then of the end
    total: int
    distinct: int
    buckets: int
    scale: float
    unknown: float  # probability of the class of unknown words
    d: dict[int, list[float]] = field(default_factory=dict)
    hot: dict[int, np.ndarray | None] = field(default_factory=lambda: {1: None})  # names of the contexts dealt by the whole n-gram
    sums: dict[int, np.ndarray] = field(default_factory=dict)  # their size and alpha

    @property
    def bits(self) -> int:
        return 63 // self.order

    @property
    def begin(self) -> int:
        return len(self.words) + 1

    def grams(self, spark: SparkSession, k: int) -> DataFrame:
        """Blocks of the n-grams of order k, one a bucket: see :class:`Grams`, and their counts."""
        return spark.read.schema(f"{_BLOCK}, kind int, part int").parquet(f"{self.path}/grams/order={k}").where("kind = 0").drop("kind")

    def contexts(self, spark: SparkSession, k: int) -> DataFrame:
        """``bucket sums``: size and alpha of each context of the bucket's n-grams that is not hot, in order of their names."""
        return spark.read.schema("bucket int, sums binary, part int").parquet(f"{self.path}/contexts/order={k}")


def _save(df: DataFrame, path: str, *by: str) -> None:
    write_once(df.withColumn("part", F.col("bucket") % PARTS).write.partitionBy(*by, "part"), path)


def _own_contexts(grams: Grams, hot: np.ndarray) -> np.ndarray:
    found = distinct(grams.contexts())
    return found[place(hot, found) < 0]


_ASKED = "bucket int, who long, plain binary, wide binary"


def answers(asked: DataFrame, model: Model, k: int) -> DataFrame:
    """Answers ``who bucket value`` to blocks ``bucket who plain wide`` at level k, in the order of the names asked: plain
    ones, and before them the others with their contexts' names.

    A value is the count and, above level 1, the size of the context if the n-gram was seen, else the context's alpha, which
    is 1 where the context was never seen.  Counts and sizes take far fewer bytes than probabilities.
    """
    spark = asked.sparkSession
    rows = model.grams(spark, k).drop("part").withColumn("kind", F.lit(0))
    if k > 1:
        rows = rows.unionByName(model.contexts(spark, k).drop("part").withColumn("kind", F.lit(1)), allowMissingColumns=True)
    rows = rows.unionByName(asked.withColumn("kind", F.lit(2)), allowMissingColumns=True)
    shared = spark.sparkContext.broadcast((model.hot.get(k), model.sums.get(k)))
    schema, bits = "who long, bucket int, value binary", model.bits
    target = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, hot_sums = shared.value
        now, names, n, contexts, sums = None, None, None, None, None
        for row in _rows(batches):
            if row["bucket"] != now:
                now, names, contexts, n, sums = row["bucket"], np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((2, 0))
            if row["kind"] == 0:
                grams = Grams(risen(row["plain"]), unpacked(row["wide"], k).reshape(k, -1), bits)
                names, n = grams.names(), np.concatenate((unpacked(row["n_wide"]), unpacked(row["n_plain"])))
                contexts = _own_contexts(grams, hot) if k > 1 else contexts
            elif row["kind"] == 1:
                sums = unpacked(row["sums"], 2)
            else:
                plain, (wide, of_wide) = risen(row["plain"]), unpacked(row["wide"], 2)
                at = place(names, np.concatenate((wide, plain)))
                found = at >= 0
                value = np.zeros(len(at), np.int64)
                value[found] = n[at[found]]
                if k > 1:
                    context = np.concatenate((of_wide, plain >> bits))
                    size, alpha = np.ones(len(at)), np.ones(len(at))
                    for known, known_sums in ((contexts, sums), (hot, hot_sums)):
                        where = place(known, context)
                        has = where >= 0
                        size[has], alpha[has] = known_sums[0, where[has]], known_sums[1, where[has]]
                    size = np.where(found, size, alpha)
                else:
                    size = np.zeros(len(at), np.int64)
                yield _batch([{"who": row["who"], "bucket": now, "value": packed(np.stack((value, size)))}], target)

    parted = rows.select("bucket", "kind", "who", "plain", "wide", "n_plain", "n_wide", *(["sums"] if k > 1 else []))
    return parted.repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(run, schema)


def alphas(asked: DataFrame, model: Model, k: int, parts: list[int]) -> DataFrame:
    """Answers ``who bucket value`` to blocks ``bucket who plain`` of sorted names of contexts of order k that occur and are not
    hot: their alphas.  Of asked blocks and the model's only the buckets of ``parts`` are read."""
    spark, bits, hot = asked.sparkSession, model.bits, model.hot[k]
    rows = model.grams(spark, k).where(F.col("part").isin(parts)).drop("part").withColumn("kind", F.lit(0))
    rows = rows.unionByName(model.contexts(spark, k).where(F.col("part").isin(parts)).drop("part").withColumn("kind", F.lit(1)), allowMissingColumns=True)
    rows = rows.unionByName(asked.where((F.col("bucket") % PARTS).isin(parts)).withColumn("kind", F.lit(2)), allowMissingColumns=True)
    schema, shared = "who long, bucket int, value binary", spark.sparkContext.broadcast(hot)
    target = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts, alpha = None, None
        for row in _rows(batches):
            if row["kind"] == 0:
                contexts = _own_contexts(_grams(row, k, bits), shared.value)
            elif row["kind"] == 1:
                alpha = unpacked(row["sums"], 2)[1]
            else:
                yield _batch([{"who": row["who"], "bucket": row["bucket"], "value": packed(alpha[place(contexts, risen(row["plain"]))])}], target)

    parted = rows.select("bucket", "kind", "who", "plain", "wide", "sums").repartition("bucket").sortWithinPartitions("bucket", "kind")
    return parted.mapInArrow(run, schema)


def answered(base: DataFrame, got: DataFrame, handle: Callable[[], Callable], schema: str, columns: int = 1) -> DataFrame:
    """Rows ``handle()(row, values)`` for each row of ``base(who, ...)`` and the answers to it, bucket after bucket; the values
    may have several columns."""
    both = base.withColumn("bucket", F.lit(-1)).unionByName(got, allowMissingColumns=True)
    target = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, own, values, none = handle(), None, [], np.zeros((columns, 0) if columns > 1 else 0)
        for row in _rows(batches):
            if row["bucket"] >= 0:
                values.append(unpacked(row["value"], columns))
                continue
            if own is not None:
                yield _batch(one(own, np.concatenate([none, *values], axis=-1)), target)
            own, values = row, []
        if own is not None:
            yield _batch(one(own, np.concatenate([none, *values], axis=-1)), target)

    return both.repartition("who").sortWithinPartitions("who", "bucket").mapInArrow(run, schema)


def _ask(base: DataFrame, wanted: Callable[[], Callable], hot: np.ndarray | None, buckets: int) -> DataFrame:
    """Blocks of what ``wanted()(row)`` gives for each row of ``base(who, ...)``: sorted names, the contexts' names."""
    target, shared = _arrow(_ASKED), base.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = wanted()
        for row in _rows(batches):
            names, contexts = one(row)
            wide = int(np.searchsorted(names, 0))
            _, parts = dealt(bucket_of(names, contexts, shared.value, buckets), wide)
            both, plain = np.stack((names[:wide], contexts[:wide])), names[wide:]
            yield _batch([{"bucket": b, "who": row["who"], "plain": rising(plain[p]), "wide": packed(both[:, w])} for b, w, p in parts], target)

    return base.mapInArrow(run, _ASKED)


def _asked_order(names: np.ndarray, contexts: np.ndarray, hot: np.ndarray | None, buckets: int) -> np.ndarray:
    return dealt(bucket_of(names, contexts, hot, buckets), int(np.searchsorted(names, 0)))[0]


def _suffixes(grams: Grams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What n-grams ask of the level below: names of their last k - 1 words, each once, these names' contexts, and which is
    whose.  Of single words only rare ones are asked for; the place of others is past the end."""
    bits, k = grams.bits, grams.k
    tail, shorter = _shorter(grams.wide[1:], bits), _shorter(grams.wide[1:-1], bits)
    if k == 2:
        rare = grams.wide[1] < 0
        names, _, which = grouped(tail[rare])
        out = np.full(len(grams), len(names))
        out[np.flatnonzero(rare)] = which
        return names, np.zeros(len(names), np.int64), out
    plain = grams.plain & ((1 << bits * (k - 1)) - 1)
    names, first, which = grouped(np.concatenate((tail, plain)))
    return names, np.concatenate((shorter, plain >> bits))[first], which


def _grams(row: dict, k: int, bits: int) -> Grams:
    return Grams(risen(row["plain"]), unpacked(row["wide"], k).reshape(k, -1), bits)


def train(texts: DataFrame, order: int = ORDER, frequent_words: int = FREQUENT_WORDS, text_col: str = "text", hot_tokens: int | None = None) -> Model:
    """Fit on all rows of ``texts``; null text counts as empty (its end still counts).  Other columns are not read.

    An empty table gives a model without words, for which every token is unknown and has probability one.
    Contexts of ``hot_tokens`` tokens or more (by default a share of all) are spread over buckets.
    """
    return _fit(texts, None, order, frequent_words, None, text_col, hot_tokens)[0]


def _fit(docs: DataFrame, learns: Column | None, order: int, frequent_words: int, id_col: str | None, text_col: str, hot_tokens: int | None) -> tuple[Model, DataFrame | None]:
    """A model of the rows for which ``learns`` holds (null: all).  If it is given, also all rows as numbers, with the answers
    to them at the highest level written next to its n-grams."""
    spark = small_batches(docs).sparkSession
    path = new_path(spark, "katz")
    texts = docs if learns is None else docs.where(learns)

    rows = materialize(read(docs, id_col, text_col, learns), "read")
    words = materialize(counted_words(rows), "words")
    ends = texts.count()
    ladder = words.groupBy(F.least("c", F.lit(1_000_000)).alias("c")).agg(F.count(F.lit(1)).alias("k"), F.sum("c").alias("s")).orderBy(F.desc("c")).collect()
    total, distinct = ends + sum(r.s for r in ladder), bool(ends) + sum(r.k for r in ladder)
    kept, least = 0, 1 << 62
    for r in ladder:
        if (kept := kept + r.k) > frequent_words:
            break
        least = r.c
    top = words.where(F.col("c") >= least).orderBy(F.desc("c"), "number", "word").toArrow()
    both = zip(top["number"].to_pylist(), top["word"].to_pylist(), strict=True)
    frequent = [((-1 - number) & ((1 << 56) - 1)).to_bytes(SHORT, "little")[: (-1 - number) >> 56] if word is None else word for number, word in both]
    counts = np.append(top["c"].to_numpy(), ends).astype(np.int64)
    del top
    of_counts = {r.c: r.k for r in ladder if r.c <= DISCOUNTED + 1}
    if 0 < ends <= DISCOUNTED + 1:
        of_counts[ends] = of_counts.get(ends, 0) + 1
    d1 = discounts(of_counts)
    lost = sum(of_counts.get(r, 0) * r * (1 - x) for r, x in enumerate(d1, 1))
    scale = 1.0 if lost > 0 else total / (total + 1)  # something must be left for unknown words
    unknown = 1 - scale * (total - lost) / total if total else 1.0
    hot_limit = hot_tokens or max(LEAST_HOT, int(total * HOT_SHARE))
    model = Model(path, order, frequent, counts, total, distinct, max(1, -(-total // TOKENS_PER_BUCKET)), scale / max(1, total), unknown, {1: d1})
    buckets, bits = model.buckets, model.bits
    rare = _merged(_rare_blocks(words.where(F.col("c") < least), bits, buckets), 1, bits, hot_limit)
    _save(rare, f"{path}/grams/order=1", "kind")
    release(words)
    if order < 2 and learns is None:
        release(rows)
        return model, None
    shared = spark.sparkContext.broadcast(looked_up(frequent))
    tokens = materialize(coded(rows, shared), "tokens")
    release(rows)
    often = named(np.flatnonzero(counts[:-1] >= hot_limit)[None], bits)
    for k in range(2, order + 1):
        if ends >= hot_limit:
            often = np.append(often, named(np.full((k - 1, 1), model.begin), bits))
        model.hot[k] = np.sort(often)
        ask = learns is not None and k == order
        blocks = _counted(tokens, k, bits, model.hot[k], buckets, ask)
        _save(_merged(blocks, k, bits, hot_limit, model.hot[k] if ask else None), f"{path}/grams/order={k}", "kind")
        counted = spark.read.schema("ladder array<long>, often binary, kind int").parquet(f"{path}/grams/order={k}").where("kind = 0")
        steps = [F.sum(F.get("ladder", F.lit(r - 1))).alias(f"n{r}") for r in range(1, DISCOUNTED + 2)]
        model.d[k] = discounts({r: x or 0 for r, x in enumerate(counted.agg(*steps).first(), 1)})
        rows = counted.select("often").collect()  # n-grams of hot_limit tokens or more: a bounded number
        often = np.concatenate([np.zeros(0, np.int64), *[unpacked(r.often) for r in rows]])
        _contexts(spark, model, k)
    if learns is None:
        release(tokens)
        return model, None
    return model, tokens


def _contexts(spark: SparkSession, model: Model, k: int) -> None:
    """Sizes and alphas of the contexts of order k, from its n-grams and the level below."""
    bits, buckets, hot, lower = model.bits, model.buckets, model.hot[k], model.hot[k - 1]
    base = model.grams(spark, k).withColumn("who", F.col("bucket").cast("long")).drop("bucket")

    def wanted():
        return lambda row: _suffixes(_grams(row, k, bits))[:2]

    got = materialize(answers(_ask(base, wanted, lower, buckets), model, k - 1), "answers")
    shared = spark.sparkContext.broadcast((hot, lower, model.counts, model.d[1], model.d[k - 1], model.d[k], model.scale))
    schema = "bucket int, sums binary, hot binary, parts binary"

    def handle():
        hot, lower, counts, d1, below, d, scale = shared.value

        def one(row: dict, value: np.ndarray) -> list[dict]:
            grams = _grams(row, k, bits)
            n = np.concatenate((unpacked(row["n_wide"]), unpacked(row["n_plain"])))
            names, contexts, which = _suffixes(grams)
            times, size = in_order(value.T, _asked_order(names, contexts, lower, buckets)).T
            if k == 2:
                last = np.concatenate((grams.wide[1], grams.plain & ((1 << bits) - 1)))
                count = np.where(last >= 0, counts[np.maximum(last, 0)], np.append(times, 0.0)[which].astype(np.int64))
                low = discounted(count, d1) * scale
            else:
                low = (discounted(times.astype(np.int64), below) / size)[which]
            found, of = np.unique(grams.contexts(), return_inverse=True)
            sums = np.stack([np.bincount(of, x, len(found)).astype(np.float64) for x in (n, discounted(n, d), low)])
            spread = place(hot, found) >= 0
            return [{"bucket": row["who"], "sums": packed(_weights(sums[:, ~spread])), "hot": packed(found[spread]), "parts": packed(sums[:, spread])}]

        return one

    def some(i: int) -> DataFrame:
        parts = list(range(PARTS))[i::SLICES]
        return answered(base.where(F.col("part").isin(parts)).drop("part"), got.where((F.col("who") % PARTS).isin(parts)), handle, schema, 2)

    pieces = [materialize(some(i), "contexts") for i in range(SLICES)]
    found = reduce(DataFrame.unionByName, pieces)
    release(got)
    _save(found.select("bucket", "sums"), f"{model.path}/contexts/order={k}")
    sums = np.zeros((3, len(hot)))
    if len(hot):
        for r in found.select("hot", "parts").toLocalIterator():  # one bucket's part of a bounded number of contexts at a time
            np.add.at(sums.T, place(hot, unpacked(r.hot)), unpacked(r.parts, 3).T)
    model.sums[k] = _weights(sums)
    release(*pieces)


def _weights(sums: np.ndarray) -> np.ndarray:
    """Size and alpha of contexts from (count, discounted count, lower mass of the words seen).  A context without a
    discounted count would leave nothing for other words: it is made one event longer."""
    n, kept, low = sums
    size = np.where(kept >= n - 1e-9, n + 1, n)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.stack((size, (1 - kept / size) / (1 - low)))


# -- scoring --------------------------------------------------------------------------------------------------------


def _by_text(tokens: Tokens, values: np.ndarray) -> np.ndarray:
    """Sums of the chosen tokens' values for each text (of no values, bincount would give integers)."""
    return np.bincount(tokens.text[tokens.chosen], values, len(tokens.sizes)).astype(np.float64)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id n_tokens n_known base_score score`` for every row of ``docs``.

    score: log10 of the product over tokens (words, then one end) of the model's probability of each after the words
    before it.  base_score: the same of (c + 1) / (N + V + 1), c the token's count in training, N all counts, V the
    distinct tokens.  Null text counts as empty: one token.  Every row is scored alone: rows with equal or null ids have a
    row each, an empty table none.  Other columns are not read.
    """
    words = small_batches(docs).sparkSession.sparkContext.broadcast(looked_up(model.words))
    state = materialize(coded(read(docs, id_col, text_col), words), "coded")
    return _scored([state], model, model.order)


def train_and_score(
    docs: DataFrame, learns: Column, order: int = ORDER, frequent_words: int = FREQUENT_WORDS, id_col: str = "doc_id", text_col: str = "text", hot_tokens: int | None = None
) -> tuple[Model, DataFrame]:
    """The model that :func:`train` fits on the rows for which ``learns`` holds, and what :func:`score` gives for all rows, which
    are read as words and counted only once: at the highest level, counting answers what is asked of it."""
    model, state = _fit(docs, learns, order, frequent_words, id_col, text_col, hot_tokens)
    if order < 2 or not model.total:
        return model, _scored([state], model, model.order)
    spark, k, bits, buckets = docs.sparkSession, order, model.bits, model.buckets
    path = f"{model.path}/grams/order={k}"
    got = spark.read.schema("bucket int, who long, value binary, kind int").parquet(path).where("kind = 1").drop("kind")
    kind = state.schema["keys"].dataType.simpleString()
    schema = f"who long, keys {kind}, {_CODED}"
    shared = spark.sparkContext.broadcast((model.hot[k], model.sums[k], model.d[k]))

    def first():
        hot, hot_sums, d = shared.value

        def one(row: dict, value: np.ndarray) -> list[dict]:
            tokens = _tokens(row)
            grams, which, _ = tokens.grams(k, bits)
            count, about = in_order(value.T, _asked_order(grams.names(), grams.contexts(), hot, buckets)).T.astype(np.int64)
            size, mask, spread = about // 32, about % 32, about < 0
            discounts_some = np.zeros(len(mask), bool)
            for r, factor in enumerate(d):
                if factor < 1:
                    discounts_some |= mask >> r & 1 == 1
            size = size + ~discounts_some
            factor = np.ones(len(size))
            factor[spread] = hot_sums[1, -1 - about[spread]]
            size[spread] = hot_sums[0, -1 - about[spread]]
            seen = count > 0
            factor[seen] = discounted(count[seen], d) / size[seen]
            lacking = ~seen & (about > 0)  # alpha is still to be asked for
            sums = _by_text(tokens, np.log10(factor[which]))
            left = ~seen[which]
            return [{c: row[c] for c in _KEPT} | {"sums": packed(sums), "left": rising(tokens.chosen[left]), "lacking": rising(tokens.chosen[lacking[which]])}]

        return one

    parts = [materialize(answered(_slice(state, i), _slice(got, i), first, schema, 2), "coded") for i in range(SLICES)]
    release(state)
    delete(spark, f"{path}/kind=1")
    state = reduce(DataFrame.unionByName, parts)

    def lacking(row: dict) -> tuple[Tokens, np.ndarray, np.ndarray]:
        tokens = _tokens(row)
        tokens.chosen = risen(row["lacking"])
        grams, which, _ = tokens.grams(k, bits)
        contexts, _, of = grouped(grams.contexts())
        return tokens, contexts, of[which]

    def bucket(contexts: np.ndarray) -> np.ndarray:
        return bucket_of(contexts, contexts, contexts[:0], buckets)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            _, contexts, _ = lacking(row)
            _, parts = dealt(bucket(contexts), 0)
            yield _batch([{"bucket": b, "who": row["who"], "plain": rising(contexts[p])} for b, _, p in parts], asked_target)

    def last():
        def one(row: dict, value: np.ndarray) -> list[dict]:
            tokens, contexts, of = lacking(row)
            value = in_order(value, dealt(bucket(contexts), 0)[0])
            sums = unpacked(row["sums"]) + _by_text(tokens, np.log10(value[of]))
            return [{c: row[c] for c in _KEPT} | {"sums": packed(sums), "left": row["left"]}]

        return one

    asked_schema = "bucket int, who long, plain binary"
    asked_target = _arrow(asked_schema)
    asked = materialize(state.mapInArrow(ask, asked_schema), "asked")
    got = [materialize(alphas(asked, model, k, list(range(PARTS))[i::SLICES]), "alphas") for i in range(SLICES)]
    release(asked)
    every, after = reduce(DataFrame.unionByName, got), []
    for i, part in enumerate(parts):
        after.append(materialize(answered(part, _slice(every, i), last, schema), "coded"))
        release(part)
    release(*got)
    return model, _scored(after, model, k - 1)


_KEPT = ("who", "keys", "sizes", "learns", "words", "tokens")


def _slice(rows: DataFrame, i: int) -> DataFrame:
    """The rows of every ``SLICES``-th batch of texts or so, and the answers to them, by ``who``."""
    return rows.where(F.pmod(F.xxhash64("who"), F.lit(SLICES)) == i)


def _scored(parts: list[DataFrame], model: Model, highest: int) -> DataFrame:
    """Scores of coded texts, in one table or in their slices, of which the levels above ``highest`` have been asked already."""
    state = reduce(DataFrame.unionByName, parts)
    spark, bits, buckets = state.sparkSession, model.bits, model.buckets
    kind = state.schema["keys"].dataType.simpleString()
    for k in range(highest if model.total else 1, 1, -1):
        shared = spark.sparkContext.broadcast((model.hot[k], model.d[k]))

        def wanted(k=k):
            def one(row: dict) -> tuple[np.ndarray, np.ndarray]:
                grams, _, _ = _tokens(row).grams(k, bits)
                return grams.names(), grams.contexts()

            return one

        def handle(k=k, shared=shared):
            hot, d = shared.value

            def one(row: dict, value: np.ndarray) -> list[dict]:
                tokens = _tokens(row)
                grams, which, _ = tokens.grams(k, bits)
                times, about = in_order(value.T, _asked_order(grams.names(), grams.contexts(), hot, buckets))[which].T
                sums = _by_text(tokens, np.log10(np.where(times > 0, discounted(times.astype(np.int64), d) / about, about)))
                if row["sums"] is not None:
                    sums += unpacked(row["sums"])
                return [{c: row[c] for c in _KEPT} | {"sums": packed(sums), "left": rising(tokens.chosen[times == 0])}]

            return one

        got = materialize(answers(_ask(state, wanted, model.hot[k], buckets), model, k), "answers")
        after = []
        for i in range(SLICES):
            base = parts[i] if len(parts) > 1 else _slice(parts[0], i)
            after.append(materialize(answered(base, _slice(got, i), handle, f"who long, keys {kind}, {_CODED}", 2), "coded"))
            if len(parts) > 1:
                release(base)
        release(got, *parts)
        parts, state = after, reduce(DataFrame.unionByName, after)

    def rare():
        def one(row: dict) -> tuple[np.ndarray, np.ndarray]:
            ids = risen(row["words"])
            names = np.sort(named(ids[None, ids < 0], bits))
            return names, names * 0

        return one

    shared = spark.sparkContext.broadcast((model.counts, model.d[1], model.scale, model.unknown))
    per_token = math.log10(model.total + (model.distinct + 1))

    def last():
        counts, d1, scale, unknown = shared.value

        def one(row: dict, value: np.ndarray) -> list[dict]:
            tokens = _tokens(row)
            ids = tokens.words
            names = named(ids[None, ids < 0], bits)
            by_name = np.argsort(names, kind="stable")
            of_word = counts[np.clip(ids, 0, len(counts) - 1)]
            of_word[np.flatnonzero(ids < 0)[by_name]] = in_order(value[0], _asked_order(names[by_name], names * 0, None, buckets))
            c = of_word[tokens.local]
            n = len(tokens.sizes)
            left = c[tokens.chosen]
            p = np.where(left > 0, discounted(left, d1) * scale, unknown)
            scores = _by_text(tokens, np.log10(p))
            if row["sums"] is not None:
                scores += unpacked(row["sums"])
            known = np.bincount(tokens.text[c > 0], minlength=n)
            base = np.bincount(tokens.text, np.log10(c + 1.0) - per_token, n)
            return [
                {"doc_id": key, "n_tokens": size, "n_known": k, "base_score": b, "score": s}
                for key, size, k, b, s in zip(row["keys"], tokens.sizes.tolist(), known.tolist(), base.tolist(), scores.tolist(), strict=True)
            ]

        return one

    schema = f"doc_id {kind[len('array<') : -1]}, n_tokens long, n_known long, base_score double, score double"
    return answered(state, answers(_ask(state, rare, None, buckets), model, 1), last, schema, 2)


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2


def op9_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trigram model of the training documents (those whose crc32 of the id as text, modulo 7, is not 2; a null id trains
    too) and its score of every document: one row per row of ``documents``, null text as empty."""
    from weft.llm.common import table

    docs = table(spark, sf_dir, "documents")
    out_of_training = F.coalesce(held_out(), F.lit(False))
    model, out = train_and_score(docs, ~out_of_training)
    return out.select("doc_id", out_of_training.alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
