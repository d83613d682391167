"""Language identification by rank-order profiles.

A profile lists the most frequent letter n-grams of a language, most frequent first.  A text gets a profile of its
own; its distance to a language is the sum over its n-grams of how far each is out of place there, and the nearest
language wins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weft.llm.common import keep_texts, per_text, small_batches, worker_cache

UNKNOWN = "und"
MAX_N = 3  # three code points of 21 bits fit one 64-bit integer, so n-grams are counted without hashing
PROFILE = 400
MAX_LANGUAGES = 1000
_PIECE = 1 << 20
BORDER = 1  # no letter has this code point


def _letters() -> np.ndarray:
    """For each code point: itself lower-cased if it is a letter or combining mark, 1 otherwise (a word border)."""
    import unicodedata

    out = np.full(0x110000, BORDER, np.int64)
    for cp in range(0x110000):
        kind = unicodedata.category(ch := chr(cp))
        if kind[0] == "L" or (kind[0] == "M" and cp > 0x7F):
            low = ch.lower()
            out[cp] = ord(low) if len(low) == 1 else cp
    return out


def _codes(text: str) -> np.ndarray:
    tables = worker_cache("letters")
    if "all" not in tables:
        tables["all"] = _letters()
    return tables["all"][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """n-grams (packed code points, a border at each end of a word) of orders 1 to 3, and how often each occurs.

    Works through the whole text in pieces that overlap, so memory is bounded for texts of any length.
    """
    grams, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not text:
        return grams, counts
    for at in range(0, len(text), _PIECE):
        lead = min(at, 2)  # the two characters before the piece start its first n-grams
        c = _codes(text[at - lead : at + _PIECE])
        if at == 0:
            c, lead = np.concatenate(([BORDER], c)), 1
        if at + _PIECE >= len(text):
            c = np.concatenate((c, [BORDER]))
        two, three = (c[:-1] << 21) | c[1:], (c[:-2] << 42) | (c[1:-1] << 21) | c[2:]
        a, b, d = c[lead:], two[max(lead - 1, 0) :], three[max(lead - 2, 0) :]
        # a border counts at the ends of an n-gram only, and never alone or twice
        a = a[a != BORDER]
        b = b[b != (BORDER << 21 | BORDER)]
        d = d[(d >> 21) & 0x1FFFFF != BORDER]
        g, n = np.unique(np.concatenate((a, b, d)), return_counts=True)
        if not len(grams):
            grams, counts = g, n
        else:
            grams, back = np.unique(np.concatenate((grams, g)), return_inverse=True)
            counts = np.bincount(back, np.concatenate((counts, n))).astype(np.int64)
    return grams, counts


def _has_letter(grams: np.ndarray) -> bool:
    """Whether a letter is among the n-grams of one character; marks without any letter are no text."""
    import unicodedata

    return any(unicodedata.category(chr(g))[0] == "L" for g in grams[: np.searchsorted(grams, 1 << 21)].tolist() if g != BORDER)


def top(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent n-grams, most frequent first, ties by packed value."""
    return grams[np.lexsort((grams, -counts))[:size]]


class Profiles:
    """Profiles of all languages in arrays: for each known n-gram its rank in each language (``size`` where absent)."""

    def __init__(self, ranked: dict[str, list[int]], size: int = PROFILE):
        self.langs, self.size = sorted(ranked), size
        self.grams = np.array(sorted({g for x in ranked.values() for g in x}), dtype=np.int64)
        self.ranks = np.full((len(self.grams), len(self.langs)), size, dtype=np.int64)
        for j, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.grams, ranked[lang]), j] = np.arange(len(ranked[lang]))

    def nearest(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin).

        score: 1 - distance / largest possible distance.  margin: how far the next language is behind, from 0 to 1.
        """
        grams, counts = ngram_counts(text)
        if not self.langs or not _has_letter(grams):
            return UNKNOWN, 0.0, 0.0
        mine = top(grams, counts, self.size)
        at = np.searchsorted(self.grams, mine)
        known = at < len(self.grams)
        known[known] = self.grams[at[known]] == mine[known]
        place = np.arange(len(mine))
        away = np.abs(self.ranks[at[known]] - place[known, None])
        away = np.where(self.ranks[at[known]] == self.size, self.size, away)
        distance = away.sum(axis=0) + self.size * int((~known).sum())
        order = np.argsort(distance, kind="stable")
        best = int(distance[order[0]])
        behind = (int(distance[order[1]]) - best) / max(1, int(distance[order[1]])) if len(order) > 1 else 1.0
        return self.langs[order[0]], 1.0 - best / (self.size * len(mine)), behind


def _restored(state: dict) -> Profiles:
    out = Profiles.__new__(Profiles)
    vars(out).update(state)
    return out


def fit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE, max_languages: int = MAX_LANGUAGES) -> Profiles:
    """Profiles from all rows of ``df`` with text and language.

    Counts are summed within each task first, so what is shuffled is one row per task, language and n-gram.  The
    driver receives ``size`` n-grams for each of at most ``max_languages`` languages; more languages raise an error.
    """

    def counted(batches):
        import pyarrow as pa

        for batch in batches:
            gathered: dict[str, list] = {}
            texts, langs = batch.column(0), batch.column(1).to_pylist()
            for i, lang in enumerate(langs):
                gathered.setdefault(lang, []).append(ngram_counts(texts[i].as_py()))
            for lang, parts in gathered.items():
                grams, back = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
                n = np.bincount(back, np.concatenate([c for _, c in parts]), minlength=len(grams)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n)], ["lang", "gram", "n"])

    small_batches(df)
    rows = df.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("_t"), F.col(lang_col).alias("_l"))
    counts = rows.mapInArrow(counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size)
    ranked: dict[str, list[tuple[int, int]]] = {}
    for row in best.limit(size * max_languages + 1).toLocalIterator():
        ranked.setdefault(row.lang, []).append((row.place, row.gram))
        if len(ranked) > max_languages:
            raise ValueError(f"more than {max_languages} languages")
    return Profiles({lang: [g for _, g in sorted(x)] for lang, x in ranked.items()}, size)


def predict(df: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id as ``doc_id``, ``lang_pred``, ``score`` and ``margin`` (both 0 to 1).

    ``und`` with score 0 where the text is null, has no letter, or there is no profile.  Ties go to the language first
    in order.  The whole text counts; every row is judged alone, repeated rows and null ids included; other columns
    are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(vars(profiles))  # plain arrays: workers need no copy of this package

    def make() -> Callable[[str | None], Iterable[tuple]]:
        worker_cache("letters")
        own = _restored(shared.value)
        return lambda text: [own.nearest(text)]

    return per_text(df, id_col, text_col, make, "doc_id long, lang_pred string, score double, margin double")


def keep_known(df: DataFrame, profiles: Profiles, text_col: str = "text", least_score: float = 0.42) -> DataFrame:
    """Rows of ``df``, all columns, whose text is in one of the languages: neither ``und`` nor further than prose from all."""
    shared = df.sparkSession.sparkContext.broadcast(vars(profiles))  # plain arrays: workers need no copy of this package

    def make() -> Callable[[str | None], bool]:
        worker_cache("letters")
        own = _restored(shared.value)

        def test(text: str | None) -> bool:
            lang, score, _ = own.nearest(text)
            return lang != UNKNOWN and score >= least_score

        return test

    return keep_texts(df, text_col, make)


def in_training(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2, F.lit(True))


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every row of ``documents``, learned from those whose crc32 of the id as text, modulo 4, is not 2 (a null
    id learns too); null texts and texts without a letter are ``und``, and each row gets a row."""
    from weft.llm.common import table

    docs = table(spark, sf_dir, "documents")
    out = predict(docs, fit(docs.where(in_training())))
    return out.select("doc_id", (~in_training()).alias("held_out"), "lang_pred", "score", "margin")


