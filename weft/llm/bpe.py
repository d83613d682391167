"""Byte-level BPE, encoded by ranked merges in Spark higher-order functions.

A merge joins two neighbouring pieces whose bytes together are a token; the lowest rank goes first, the leftmost of
equal ones.  Pieces are token numbers, so the rank map is keyed by pairs of them; it enters the plan as three literal
arrays that form a perfect hash table, and one lookup costs the same for any vocabulary.  The fold runs once for each
frequent distinct word (that dictionary has a fixed number of entries and is broadcast) and once per document for each
distinct word outside it; long words are folded window by window.  Decoding concatenates the tokens' bytes.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import begin_task, small_batches, worker_cache
from weft.plans.runtime import materialize

DICTIONARY = 500_000
WINDOW = 64
BATCH_BYTES = 2 << 20  # words leave Python as eight bytes for each of theirs


@dataclass(frozen=True)
class Vocabulary:
    """Token bytes by id, and merges as a perfect hash table of powers of two.

    The pair (a, b) has key ``a << 16 | b`` and slot ``spread(key, slot factor) ^ move[spread(key, bucket factor)]``;
    the slot holds ``key << 16 | merged id`` if the pair merges.
    """

    tokens: tuple[bytes, ...]
    entries: np.ndarray
    move: np.ndarray
    factors: tuple[int, int]


def spread(key, factor: int, size: int):
    """Bits of ``key * factor``: no product overflows, as keys have 32 bits and factors 30."""
    return (key * factor >> 26) & (size - 1)


def load_ranks(path: str) -> list[bytes]:
    """Tokens of a ``.tiktoken`` file (base64 and rank on each line) in order of rank; ranks must be 0, 1, 2, ..."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    tokens = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in tokens] != list(range(len(tokens))) or len(tokens) >= 1 << 16:
        raise ValueError("ranks must count up from 0 and fit 16 bits")
    if not all(bytes([b]) in ranks for b in range(256)):
        raise ValueError("a byte has no token")
    return tokens


def vocabulary(tokens: list[bytes]) -> Vocabulary:
    ids = {t: i for i, t in enumerate(tokens)}
    pairs = {ids[t[:k]] << 16 | ids[t[k:]]: i for i, t in enumerate(tokens) for k in range(1, len(t)) if t[:k] in ids and t[k:] in ids}
    key, merged = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int64)
    size = 1 << max(4, (len(key) * 6 // 5).bit_length())  # at most five sixths full
    draw = np.random.default_rng(0)
    for _ in range(200):
        factors = tuple(int(x) | 1 for x in draw.integers(1 << 29, 1 << 30, 2))
        if (move := _moves(spread(key, factors[0], size // 8), spread(key, factors[1], size), size)) is not None:
            break
    else:
        raise RuntimeError("no hash function without collisions was found")
    at = spread(key, factors[1], size) ^ move[spread(key, factors[0], size // 8)]
    entries = np.full(size, -1, np.int64)
    entries[at] = key << 16 | merged
    return Vocabulary(tuple(tokens), entries, move, factors)


def _moves(bucket: np.ndarray, home: np.ndarray, size: int) -> np.ndarray | None:
    """For each bucket a displacement that puts its keys on free slots, the fullest buckets first; None if two keys of a
    bucket have one home."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(size // 8 + 1))
    move, free, tries = np.zeros(size // 8, np.int64), np.ones(size, bool), np.arange(64)
    for b in np.argsort(cuts[:-1] - cuts[1:], kind="stable"):
        own = home[order[cuts[b] : cuts[b + 1]]]
        if len(np.unique(own)) < len(own):
            return None
        for first in range(0, size, len(tries)):
            fits = free[own ^ (first + tries)[:, None]].all(axis=1)
            if fits.any():
                move[b] = first + int(np.argmax(fits))
                break
        else:
            return None
        free[own ^ move[b]] = False
    return move


def byte_ids(vocab: Vocabulary) -> np.ndarray:
    """Token id of each single byte."""
    ids = {t: i for i, t in enumerate(vocab.tokens)}
    return np.array([ids[bytes([b])] for b in range(256)], np.int64)


def _literal(values: np.ndarray) -> Column:
    """A literal array: the expression has no inputs, so the optimizer evaluates it once."""
    return F.split(F.lit(",".join(map(str, values.tolist()))), ",").cast("array<bigint>")


def byte_array(word: Column, vocab: Vocabulary) -> Column:
    """The word's UTF-8 bytes as ids of single-byte tokens."""
    first = _literal(byte_ids(vocab))
    chars = F.split(F.decode(F.encode(word, "UTF-8"), "ISO-8859-1"), "")
    return F.transform(F.filter(chars, lambda c: c != ""), lambda c: F.get(first, F.ascii(c)))


def rank_map(vocab: Vocabulary) -> Column:
    """The rank map as one literal: hash table, its displacements, and the length of each token.  It is named once in a plan
    and handed on as a variable, since every task reads each literal of its plan number by number."""
    length = np.array([len(t) for t in vocab.tokens], np.int64)
    return F.struct(_literal(vocab.entries).alias("entries"), _literal(vocab.move).alias("move"), _literal(length).alias("length"))


def fold(pieces: Column, vocab: Vocabulary, ranks: Column) -> Column:
    """Token ids of bytes given as ids of single bytes (array<bigint>): ranked merges, one a step.

    The state has one number for each piece: the rank its merge with the next piece would have, where it starts, and its
    token.  The least number is the leftmost merge of lowest rank; a step makes it and looks up the two pairs it creates.
    """
    none, rank_at, start_at = 1 << 16, 46, 16  # starts have 30 bits

    def bits(key: Column, factor: int, size: int) -> Column:
        return F.shiftright(key * factor, 26).bitwiseAND(size - 1).cast("int")

    def rank_of(key: Column) -> Column:
        moved = F.get(ranks.move, bits(key, vocab.factors[0], len(vocab.move))).cast("int")
        slot = bits(key, vocab.factors[1], len(vocab.entries)).bitwiseXOR(moved)
        entry = F.get(ranks.entries, slot)
        return F.when(F.shiftright(entry, 16) == key, entry.bitwiseAND(0xFFFF)).otherwise(F.lit(none).cast("bigint"))

    def piece(key: Column, rest: Column) -> Column:
        return F.shiftleft(rank_of(key), rank_at).bitwiseOR(rest)

    def token(x: Column) -> Column:
        return x.bitwiseAND(0xFFFF)

    def step(state: Column, _: Column) -> Column:
        def merged(j: Column) -> Column:  # j counts from 1
            here, before, after = F.get(state, j - 1), F.get(state, j - 2), F.get(state, j + 1)
            rank = F.shiftright(here, rank_at)
            right, left = rank * 65536 + token(after), token(before) * 65536 + rank
            own = here.bitwiseAND(((1 << rank_at) - 1) ^ 0xFFFF).bitwiseOR(rank)
            two = F.zip_with(
                F.when(j > 1, F.array(left, right)).otherwise(F.array(right)),
                F.when(j > 1, F.array(before.bitwiseAND((1 << rank_at) - 1), own)).otherwise(F.array(own)),
                piece,
            )
            ahead, behind = F.slice(state, 1, F.greatest(j - 2, F.lit(0))), F.slice(state, j + 2, F.size(state))
            return F.when(rank < none, F.concat(ahead, two, behind)).otherwise(state)

        place = F.array_position(state, F.array_min(state)).cast("int")
        return F.get(F.transform(F.array(place), merged), 0)

    begin = F.zip_with(pieces, F.slice(pieces, 2, F.size(pieces)), lambda a, b: piece(a * 65536 + b, a))
    begin = F.transform(begin, lambda x, i: x.bitwiseOR(F.shiftleft(i.cast("bigint"), start_at)))
    rounds = F.when(F.size(pieces) > 1, F.sequence(F.lit(2), F.size(pieces))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(rounds, begin, step, lambda s: F.transform(s, token))


def encoded_words(words: Column, vocab: Vocabulary, window: int = WINDOW) -> Column:
    """Token ids of each word of an array; a word is an array of ids of single bytes."""
    return F.get(F.transform(F.array(rank_map(vocab)), lambda ranks: F.transform(words, lambda w: encoded_word(w, vocab, ranks, window))), 0)


def encoded_word(pieces: Column, vocab: Vocabulary, ranks: Column, window: int = WINDOW) -> Column:
    """Token ids of a word of any length given as ids of single bytes, in time linear in its length but for rare cases.

    Windows of the word are folded one after another.  Each begins where a token of the one before begins, past its
    middle, and must find that token again.  Tokens on either side of it then follow each other in a true encoding, and
    ids of which every two neighbours do are the encoding of the whole.  If a window does not find the token, all begins
    again with windows twice as long, in the end with the whole word as one.
    """
    n = F.size(pieces)
    nested = F.array().cast("array<array<bigint>>")

    def state(done: Column, at: Column, size: Column, first: Column, ended: bool) -> Column:
        return F.struct(done.alias("done"), at.cast("int").alias("at"), size.cast("int").alias("size"), first.cast("bigint").alias("first"), F.lit(ended).alias("ended"))

    def step(s: Column, _: Column) -> Column:
        def found(e: Column) -> Column:
            def cut(c: Column) -> Column:  # c.n tokens begin in the first half, the next one at c.at
                again = state(nested, F.lit(0), s.size * 2, F.lit(None), False)
                on = state(F.concat(s.done, F.array(F.slice(e, 1, c.n))), s.at + c.at, s.size, F.get(e, c.n), False)
                return F.when(c.n < F.size(e), on).otherwise(again)

            def count(c: Column, t: Column) -> Column:
                inside = c.at < F.shiftright(s.size, 1)
                return F.struct((c.n + F.when(inside, 1).otherwise(0)).alias("n"), (c.at + F.when(inside, F.get(ranks.length, t.cast("int")).cast("int")).otherwise(0)).alias("at"))

            half = F.aggregate(e, F.struct(F.lit(0).alias("n"), F.lit(0).alias("at")), count)
            return (
                F.when(F.get(e, 0) != s.first, state(nested, F.lit(0), s.size * 2, F.lit(None), False))
                .when(s.at + s.size >= n, state(F.concat(s.done, F.array(e)), s.at, s.size, F.lit(None), True))
                .otherwise(F.get(F.transform(F.array(half), cut), 0))
            )

        return F.when(s.ended, s).otherwise(F.get(F.transform(F.array(fold(F.slice(pieces, s.at + 1, s.size), vocab, ranks)), found), 0))

    # windows of size s take 2 n / s + 2 steps at most, and s doubles from ``window`` until it covers the word
    steps = F.when(n <= window, F.lit(1)).otherwise((4 * n / window).cast("int") + 72)
    out = F.aggregate(F.sequence(F.lit(1), steps), state(nested, F.lit(0), F.lit(window), F.lit(None), False), step, lambda s: F.flatten(s.done))
    return out


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids one after another, and where each begins (with the end of the last)."""
    at = np.zeros(len(lists) + 1, np.int64)
    np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False), out=at[1:])
    return lists.flatten().to_numpy(zero_copy_only=False).astype("<u4"), at


def gather(flat: np.ndarray, at: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The slices ``flat[at[w]:at[w + 1]]`` for each w of ``which``, concatenated."""
    size = at[which + 1] - at[which]
    total = int(size.sum())
    if not total:
        return flat[:0]
    ends = np.cumsum(size)
    return flat[np.repeat(at[which] - (ends - size), size) + np.arange(total)]


def java_pattern(pattern: str) -> str:
    """The pattern for Java, with Unicode classes and white space."""
    return "(?U)" + pattern


def dictionary(texts: DataFrame, vocab: Vocabulary, pattern: str, size: int = DICTIONARY) -> pa.Table:
    """``word`` and ``ids`` of the most frequent words of ``texts(text)``: all with a count over a limit set so that at most
    ``size`` remain, whatever the table."""
    found = F.expr("regexp_extract_all(text, _p, 0)")
    words = texts.select("text", F.lit(java_pattern(pattern)).alias("_p")).select(F.explode(found).alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counts = materialize(counts, "words")
    ladder = counts.groupBy(F.least("n", F.lit(100_000)).alias("n")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("n")).collect()
    total, least = 0, None
    for row in ladder:
        if total + row.k > size:
            break
        total, least = total + row.k, row.n
    kept = counts.where(F.col("n") >= (least or 1 << 62)).select("word", byte_array(F.col("word"), vocab).alias("pieces")).repartition("word")
    return kept.select("word", F.get(encoded_words(F.array("pieces"), vocab), 0).alias("ids")).toArrow()


def encode(df: DataFrame, vocab: Vocabulary, pattern: str, id_col: str = "doc_id", text_col: str = "text", dictionary_size: int = DICTIONARY, decoded: bool = False) -> DataFrame:
    """``doc_id`` and ``ids`` (little-endian unsigned 32-bit integers in a binary) for every row of ``df``; with ``decoded`` also
    ``bytes``, what :func:`decode` gives for these ids, in the same pass.

    Null text counts as empty and has no ids.  Whole texts are encoded, every row alone, repeated rows and null ids
    included; an empty table gives no rows; other columns are not read.
    """
    spark = small_batches(df, BATCH_BYTES).sparkSession
    known = dictionary(df.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")), vocab, pattern, dictionary_size).combine_chunks()
    flat, at = _flat(known["ids"].combine_chunks())
    entries = spark.sparkContext.broadcast(known["word"].combine_chunks())
    coded = spark.sparkContext.broadcast((flat, at))
    tokens = spark.sparkContext.broadcast(vocab.tokens if decoded else ())
    singles = spark.sparkContext.broadcast(byte_ids(vocab))
    kind, run = df.schema[id_col].dataType.simpleString(), uuid.uuid4().hex

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words as numbers: an entry of the dictionary, or below zero one of the document's own words."""
        import regex

        store = begin_task(lambda: worker_cache("bpe words"))
        if store.get("run") != run:
            store.clear()
            store["run"] = run
            store["number"] = {w: i for i, w in enumerate(entries.value.to_pylist())}
        number, findall, first = store["number"], regex.compile(pattern).findall, singles.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                codes, rest, per_text = [], [], [0]
                for text in part.column(1):
                    words = findall(text.as_py() or "")
                    own = list(map(number.get, words))
                    if None in own:
                        extra: dict[str, int] = {}
                        for w in {w for w, i in zip(words, own, strict=True) if i is None}:
                            extra[w] = per_text[-1] - len(rest) - 1
                            rest.append(w.encode("utf-8", "surrogatepass"))
                        own = [extra[w] if i is None else i for w, i in zip(words, own, strict=True)]
                    codes.append(np.array(own, "<i4").tobytes())
                    per_text.append(len(rest))
                ends = np.zeros(len(rest) + 1, np.int32)
                np.cumsum([len(b) for b in rest], out=ends[1:])
                pieces = pa.ListArray.from_arrays(pa.array(ends), pa.array(first[np.frombuffer(b"".join(rest), np.uint8)]))
                own_words = pa.ListArray.from_arrays(pa.array(per_text, pa.int32()), pieces)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(codes, pa.binary()), own_words], ["doc_id", "codes", "words"])
            pa.default_memory_pool().release_unused()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, at = coded.value
        for batch in batches:
            words = batch.column(2)
            own, own_at = _flat(words.flatten())
            every, ends, base = np.concatenate((flat, own)), np.concatenate((at, own_at[1:] + len(flat))), len(at) - 1
            first = np.concatenate(([0], np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False))))
            out = []
            for i, codes in enumerate(batch.column(1)):
                code = np.frombuffer(codes.as_py(), "<i4").astype(np.int64)
                out.append(gather(every, ends, np.where(code >= 0, code, base + first[i] - code - 1)).tobytes())
            columns = [batch.column(0), pa.array(out, pa.binary())]
            if decoded:
                columns.append(pa.array([joined(x, tokens.value) for x in out], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "bytes"][: len(columns)])

    words = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    parted = words.mapInArrow(split, f"doc_id {kind}, codes binary, words array<array<bigint>>")
    folded = parted.select("doc_id", "codes", encoded_words(F.col("words"), vocab).alias("words"))
    return folded.mapInArrow(join, f"doc_id {kind}, ids binary" + ", bytes binary" * decoded)


def joined(ids: bytes, tokens: tuple[bytes, ...]) -> bytes:
    """The bytes of tokens, one after another."""
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def decode(encoded: DataFrame, vocab: Vocabulary) -> DataFrame:
    """``encoded(doc_id, ids)`` with ``bytes``: the tokens' bytes one after another.  An unknown id raises."""
    tokens = encoded.sparkSession.sparkContext.broadcast(vocab.tokens)
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [joined(x.as_py(), tokens.value) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], ["doc_id", "ids", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids binary, bytes binary")


def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Ids of every row of ``documents`` and their bytes again: a row for each row, null text as empty (no ids)."""
    import public_tokenizers

    from weft.llm.common import table

    vocab = vocabulary(load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    return encode(table(spark, sf_dir, "documents"), vocab, public_tokenizers.PATTERN, decoded=True).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )


