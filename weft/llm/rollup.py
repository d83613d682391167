"""Token counts in a delta-maintained rollup.

Totals by source, language and tokenizer version are additive, so a batch of changes is kept as the sum of its signed
deltas: +count for an insert, -count for a delete, new minus old for a revised count.  A batch costs what it holds,
whatever the totals cover.  Each commit is a folder named after its batch that appears by one rename; a batch whose
folder is there is not applied again, so a batch repeated after a lost driver or executor changes nothing.  Commits are
folded into a base now and then, after which only an empty folder tells that the batch was applied.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import begin_task, small_batches, worker_cache
from weft.plans.runtime import materialize, new_path

GROUP = ["source", "lang", "version"]
_DELTA = "source string, lang string, version string, n_docs long, n_tokens long"
COMPACT_AT = 32
WORDS_REMEMBERED = 400_000


class Rollup:
    """Totals of documents and tokens by source, language and tokenizer version, kept below ``path``; one writer at a time.

    ``commits`` has a folder of deltas for each batch not yet settled, fewer than ``COMPACT_AT`` of them; ``base`` has the
    totals of all others, with the names of the batches it was the last to take in; ``applied`` has an empty folder for
    each batch in the base.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for part in ("commits", "base", "applied"):
            self._fs.mkdirs(self._at(f"{self.path}/{part}"))
        self._settle()

    def _list(self, part: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._at(f"{self.path}/{part}")))

    def has(self, batch_id: str) -> bool:
        """Whether a batch is in the totals."""
        return any(self._fs.exists(self._at(f"{self.path}/{part}/{batch_id}")) for part in ("commits", "applied"))

    def applied(self) -> set[str]:
        """Ids of all batches in the totals."""
        return set(self._list("commits")) | set(self._list("applied"))

    def _base(self) -> tuple[str | None, set[str]]:
        """Folder of the last base, and the batches that it was the last to take in."""
        last = self._list("base")[-1:]
        if not last:
            return None, set()
        folder = f"{self.path}/base/{last[0]}"
        return folder, {r.batch for r in self.spark.read.schema("batch string").parquet(f"{folder}/batches").collect()}

    def totals(self) -> DataFrame:
        """``source lang version n_docs n_tokens``; a group whose documents have all gone is absent.

        Sums the last base and the commits that are not in it.
        """
        base, taken = self._base()
        paths = [f"{base}/totals"] * (base is not None) + [f"{self.path}/commits/{x}" for x in self._list("commits") if x not in taken]
        if not paths:
            return self.spark.createDataFrame([], _DELTA)
        rows = self.spark.read.schema(_DELTA).parquet(*paths)
        return _summed(rows.select(*GROUP, "n_docs", "n_tokens"))

    def apply(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply ``changes(source, lang, version, op, n_tokens, old_tokens)``; False if the batch was applied before.

        op ``insert`` adds a document of n_tokens, ``delete`` takes one away, ``revise`` replaces old_tokens by n_tokens.
        Each row counts, equal rows too.  A null source, language or version is a group of its own; a null count is 0;
        any other op raises.  Other columns are ignored.  An empty batch is recorded as applied.
        """
        if not batch_id or "/" in batch_id or batch_id.startswith((".", "_")):
            raise ValueError("a batch id is a non-empty name without '/' that begins neither with '.' nor with '_'")
        if self.has(batch_id):
            return False
        sign = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0)
        sign = F.coalesce(sign, F.raise_error(F.concat(F.lit("unknown op "), F.coalesce("op", F.lit("null")))).cast("int"))
        new, old = F.coalesce("n_tokens", F.lit(0)).cast("long"), F.coalesce("old_tokens", F.lit(0)).cast("long")
        signed = F.when(F.col("op") == "revise", new - old).otherwise(F.col("n_docs") * new)
        rows = changes.select(*GROUP, "op", "n_tokens", "old_tokens", sign.cast("long").alias("n_docs"))
        temporary = f"{self.path}/_next"
        self._fs.delete(self._at(temporary), True)
        _summed(rows.select(*GROUP, "n_docs", signed.alias("n_tokens"))).write.parquet(temporary)
        self._rename(temporary, f"{self.path}/commits/{batch_id}")
        if len(self._list("commits")) >= COMPACT_AT:
            self.compact()
        return True

    def compact(self) -> None:
        """Fold all commits into a new base, so that reading the totals opens few files."""
        self._settle()
        names = self._list("commits")
        if not names:
            return
        temporary = f"{self.path}/_base"
        self._fs.delete(self._at(temporary), True)
        self.totals().write.parquet(f"{temporary}/totals")
        self.spark.createDataFrame([(x,) for x in names], "batch string").coalesce(1).write.parquet(f"{temporary}/batches")
        last = self._list("base")[-1:]
        self._rename(temporary, f"{self.path}/base/{int(last[0]) + 1 if last else 0:012d}")
        self._settle()

    def _settle(self) -> None:
        """Finish a compaction, also one that was broken off: mark its batches as applied, then drop their commits."""
        _, taken = self._base()
        for name in taken & set(self._list("commits")):
            self._fs.mkdirs(self._at(f"{self.path}/applied/{name}"))
            self._fs.delete(self._at(f"{self.path}/commits/{name}"), True)
        for old in self._list("base")[:-1]:
            self._fs.delete(self._at(f"{self.path}/base/{old}"), True)

    def _rename(self, source: str, target: str) -> None:
        if not self._fs.rename(self._at(source), self._at(target)):
            raise RuntimeError(f"could not commit {target}")


def _summed(rows: DataFrame) -> DataFrame:
    out = rows.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    return out.where("n_docs <> 0 OR n_tokens <> 0")


def counted(df: DataFrame, counters: dict[str, Column], op: str, old: dict[str, Column] | None = None, source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """Changes for :meth:`Rollup.apply`: one row per row of ``df`` and tokenizer version, counts read off ``df`` in one pass."""
    each = F.array(*[F.struct(F.lit(v).alias("version"), c.cast("long").alias("n_tokens"), (old[v] if old else F.lit(0)).cast("long").alias("old_tokens")) for v, c in counters.items()])
    rows = df.select(F.col(source_col).alias("source"), F.col(lang_col).alias("lang"), F.explode(each).alias("c"))
    return rows.select("source", "lang", "c.version", F.lit(op).alias("op"), "c.n_tokens", "c.old_tokens")


def rank_counter(path: str, pattern: str, remembered: int = WORDS_REMEMBERED) -> Callable[[str], int]:
    """How many tokens a text has by the ranks in a ``.tiktoken`` file: words met before are looked up; at most ``remembered``
    of them are kept, then all are dropped."""
    import base64

    import regex
    import tiktoken

    store = worker_cache(f"counts {path}")
    if "encode" not in store:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        store["encode"] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        store["known"] = {}
    encode, known, findall = store["encode"], store["known"], regex.compile(pattern).findall

    def count(text: str) -> int:
        words = findall(text)
        missing = {w for w in words if w not in known}
        if missing:
            if len(known) + len(missing) > remembered:
                known.clear()
                missing = set(words)
            known.update({w: len(encode(w)) for w in missing})
        return sum(map(known.__getitem__, words))

    return count


def library_counter(path: str) -> Callable[[str], int]:
    """How many tokens a text has by a ``tokenizers`` file, without special tokens added."""
    from weft.llm.packing import word_encoder

    encode = word_encoder(path)
    return lambda text: len(encode(text))


def token_counts(df: DataFrame, counters: dict[str, Callable[[], Callable[[str], int]]], source_col: str = "source", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """``source lang n_words n_chars`` and a count for each counter, under its name, for every row of ``df``; null text counts as
    empty.  Words are runs without white space.  Other columns are not read."""
    names = list(counters)
    schema = "source string, lang string, n_words long, n_chars long, " + ", ".join(f"`{x}` long" for x in names)
    rows = small_batches(df).select(F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = begin_task(lambda: [make() for make in counters.values()])
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column(2)]
            found = [[len(t.encode("utf-8", "surrogatepass").split()) for t in texts], [len(t) for t in texts], *[[one(t) for t in texts] for one in count]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(x, pa.int64()) for x in found]], ["source", "lang", "n_words", "n_chars", *names])

    return rows.mapInArrow(run, schema)


def op6_token_rollup(spark, sf_dir: str) -> DataFrame:
    """Totals of all ``documents`` by source, language and tokenizer version; versions are files of public tokenizers.

    All documents are inserted with counts guessed from their length, every count is then revised by tokenizing, documents
    under 50 words are deleted and inserted again; one batch is sent twice.  Null text counts as empty; a null source or
    language is a group of its own; an empty table gives no rows.
    """
    import public_tokenizers

    from weft.llm.common import table

    ranks, library, pattern = "byte_bpe_50k.tiktoken", "word_bpe_49k.json", public_tokenizers.PATTERN
    paths = {x: public_tokenizers.path(x) for x in (ranks, library)}
    counters = {"a": lambda: rank_counter(paths[ranks], pattern), "b": lambda: library_counter(paths[library])}
    counts = materialize(token_counts(table(spark, sf_dir, "documents"), counters), "counts")
    exact = {ranks: F.col("a"), library: F.col("b")}
    guess = dict.fromkeys(exact, (F.col("n_chars") / 4).cast("long"))
    rollup = Rollup(spark, new_path(spark, "rollup"))
    rollup.apply("load", counted(counts, guess, "insert"))
    rollup.apply("tokenized", counted(counts, exact, "revise", old=guess))
    short = counts.where("n_words < 50")
    rollup.apply("short", counted(short, exact, "delete"))
    rollup.apply("tokenized", counted(counts, exact, "revise", old=guess))
    rollup.apply("short-again", counted(short, exact, "insert"))
    return rollup.totals()
