"""Each operator against brute force on small tables with nulls, empty and long texts, repeats and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from weft.llm import bpe, exact_dedup, html_text, katz, langid, packing, quality, rollup, simhash, warc

WORDS = "the of and to house river stone light carry under over green small window morning paper".split()
DOCS = "doc_id long, text string, lang string, _key string, _maybe int, _keep int, _k int, _again int, _hot int, _dropped_id int, _id int"
CLASH = (1, 2, 3, 4, 5, 6)


def prose(seed, n):
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + draw.choice(["", "", "ly", "ing", ",", "."]) for _ in range(n))


def rich(seed, n):
    draw = random.Random(seed)
    return " ".join("".join(draw.choices("etaoinshrdlu", k=draw.randint(2, 8))) for _ in range(n))


def corpus():
    base = prose(1, 120)
    near = base.replace("house", "horse", 1)
    texts = [None, "", "   ", base, base.upper(), base, near, prose(2, 80), prose(3, 4000), "Été à l'œuvre 漢字 🙂", "x" * 3000, "A", prose(4, 300) * 3]
    rows = [(i, t, "en", "k", 1, *CLASH) for i, t in enumerate(texts)]
    return [*rows, rows[3], (None, "no id", None, None, None, *CLASH), (None, base, None, None, None, *CLASH)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_exact_groups(docs, none, monkeypatch):
    groups = {}
    for i, t, *_ in corpus():
        groups.setdefault(lower(t), []).append(i)
    want = sorted((str(i), str(max((x for x in groups[lower(t)] if x is not None), default=None)), len(groups[lower(t)])) for i, t, *_ in corpus())
    for bits in (exact_dedup.MAX_FILTER_BITS, 1 << exact_dedup.CHUNK_BITS):
        got = exact_dedup.exact_groups(docs, max_filter_bits=bits).collect()
        assert sorted((str(r.id), str(r.keep_id), r.group_size) for r in got) == want
    for hot in (1000, 2):  # groups of over 1/1000, or half, of the rows are not shuffled
        monkeypatch.setattr(exact_dedup, "HOT_GROUPS", hot)
        got = exact_dedup.exact_groups(docs).collect()
        assert sorted((str(r.id), str(r.keep_id), r.group_size) for r in got) == want
        kept = exact_dedup.drop_exact(docs)
        assert kept.columns == docs.columns
        assert sorted(lower(r.text) for r in kept.collect()) == sorted(groups)
        assert {(r.doc_id, lower(r.text)) for r in kept.collect()} == {(max((x for x in ids if x is not None), default=None), t) for t, ids in groups.items()}
    assert exact_dedup.exact_groups(none).count() == 0 and exact_dedup.drop_exact(none).count() == 0


def brute_fingerprint(text):
    import xxhash

    w = words(lower(text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs, none):
    rows = corpus()
    fps = [brute_fingerprint(t) for _, t, *_ in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = group[a], group[b]
                group = [y if g == x else g for g in group]
    least = {g: min((r[0] for r, k in zip(rows, group, strict=True) if k == g and r[0] is not None), default=None) for g in group}
    want = sorted((str(r[0]), f, str(least[g])) for r, f, g in zip(rows, fps, group, strict=True))
    got = simhash.near_groups(docs).collect()
    assert sorted((str(r.doc_id), r.fp % (1 << 64), str(r.component_id)) for r in got) == want
    kept = simhash.drop_near(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == sorted(r[0] for r, g in zip(rows, group, strict=True) if r[0] is not None and r[0] == least[g])
    assert simhash.near_groups(none).count() == 0


def test_simhash_runs_longer_than_a_bucket(spark):
    draw = random.Random(5)
    centre = draw.getrandbits(64)
    fps = sorted({centre ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 3))) for _ in range(200)} | {draw.getrandbits(64) for _ in range(50)})
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), longest=8).collect()
    parent = {x: x for x in signed}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in found:
        assert ((r.a ^ r.b) % (1 << 64)).bit_count() <= 3
        parent[top(r.a)] = top(r.b)
    for a, x in zip(signed, fps, strict=True):
        for b, y in zip(signed, fps, strict=True):
            assert (x ^ y).bit_count() > 3 or top(a) == top(b)


def test_quality(docs, none):
    for text in [t for _, t, *_ in corpus()] + ["a b c a b c\n\na b\na b\n \n", "# $ % & | < > *"]:
        w = words(text)
        seen = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in (text or "").split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))
        assert quality.base_counts((text or "").encode()) == want
    import zstandard

    compress = zstandard.ZstdCompressor(level=3).compress
    bands = quality.Bands()
    noise = bytes(random.Random(0).choices(range(33, 127), k=9000)).decode()
    assert quality.compression(prose(9, 900).encode(), bands, compress)[0] < 0.5
    assert not quality.compression(b"spam eggs " * 900, bands, compress)[2]
    assert not quality.compression(noise.encode(), bands, compress)[2]
    assert quality.chunk_spans(9000, 4096) == [(0, 4096), (4096, 9000)] and quality.chunk_spans(0, 4096) == [(0, 0)]
    out = quality.judge(docs).collect()
    assert len(out) == len(corpus()) and all(r.base_failed and not r.kept for r in out if r.n_words < 50)
    assert quality.judge(none).count() == 0
    assert quality.keep_good(docs).columns == docs.columns


def test_bands_reject_what_the_base_rule_passes(spark):
    clean = {n: rich(1, n).split() for n in (150, 300, 600)}
    junk = {n: w[: n * 4 // 5] + w[: n // 5] for n, w in clean.items()}
    rows = [(n, " ".join(w)) for n, w in clean.items()] + [(-n, " ".join(w)) for n, w in junk.items()]
    out = quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 6 and not any(r.base_failed for r in out)
    assert all(r.kept == (r.doc_id > 0) for r in out)


def test_language(spark, docs, none):
    en = "the quick brown fox and the lazy dog went with the others to the river".split()
    fr = "le renard brun et le chien paresseux avec les autres dans la rivière très tôt".split()
    draw = random.Random(0)
    rows = [(i, " ".join(draw.choices(en if i % 2 else fr, k=30)), "en" if i % 2 else "fr") for i in range(40)]
    profiles = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert profiles.langs == ["en", "fr"]
    counts = Counter()
    for _, t, lang in rows:
        if lang == "en":
            for w in t.split():
                p = f" {w} "
                counts.update(p[i : i + n] for n in (1, 2, 3) for i in range(len(p) - n + 1) if p[i : i + n].strip() and p[i : i + n] != " ")
    grams, n = langid.ngram_counts(" ".join(t for _, t, lang in rows if lang == "en"))
    unpack = lambda g: "".join(chr(g >> s & 0x1FFFFF) if (g >> s & 0x1FFFFF) > 1 else " " for s in (42, 21, 0) if g >> s)
    got = Counter({unpack(int(g)): int(k) for g, k in zip(grams, n, strict=True)})
    assert got == counts
    assert all(profiles.nearest(t)[0] == lang for _, t, lang in rows)
    assert profiles.nearest(None) == ("und", 0.0, 0.0) and profiles.nearest("12 !?")[0] == "und"
    out = langid.predict(docs, profiles).collect()
    assert len(out) == len(corpus()) and all(0 <= r.score <= 1 for r in out)
    assert profiles.nearest("\u0301")[0] == "und" and profiles.nearest("\u0301 12 \u0301e")[0] != "und"
    empty = langid.fit(none)
    assert empty.nearest("text")[0] == "und" and langid.predict(none, empty).count() == 0


def test_language_pieces_agree(monkeypatch):
    text = prose(7, 400) + " Été"
    whole = dict(zip(*langid.ngram_counts(text), strict=True))
    monkeypatch.setattr(langid, "_PIECE", 37)
    assert dict(zip(*langid.ngram_counts(text), strict=True)) == whole


def test_packing(docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    encode = packing.word_encoder(path, remembered=50)
    special = ["hello <|endoftext|> world", "<|startoftext|><|endoftext|>x<|ENDOFTEXT|>", "a<|endoftext|>.", "<|endoftext", "e<|startoftext|>\u0301"]
    for t in [t for _, t, *_ in corpus()] + special:
        assert encode(t).tolist() == plain.encode(t or "", add_special_tokens=False).ids
    out = packing.pack_documents(docs, path, capacity=256).toPandas()
    want = Counter()
    for i, t, *_ in corpus():
        ids = np.array([*encode(t), 0], "<u4")
        want.update((str(i), k, a, len(ids[a : a + 256]), zlib.crc32(ids[a : a + 256].tobytes())) for k, a in enumerate(range(0, len(ids), 256)))
    got = Counter((str(None if i != i else int(i)), *x) for i, *x in out[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False))
    assert got == want
    for _, rows in out.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert rows.offset.tolist() == [0, *rows.length.cumsum().tolist()[:-1]] and rows.length.sum() <= 256
    assert packing.pack_documents(none, path).count() == 0


def test_fullest_combination():
    draw = random.Random(3)
    for _ in range(60):
        counts = [0] + [draw.choice([0, 0, 1, 2]) for _ in range(16)]
        if not any(counts):
            continue
        items = [n for n, k in enumerate(counts) for _ in range(k)]
        sums = {0}
        for n in items:
            sums |= {s + n for s in sums if s + n <= 16}
        combo = packing.fullest(counts, 16)
        assert sum(n * k for n, k in combo) == max(sums) and all(k <= counts[n] for n, k in combo)


@pytest.fixture(scope="module")
def vocab():
    return bpe.vocabulary(bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))


def test_bpe(spark, docs, none, vocab):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(vocab.tokens)}, special_tokens={})
    for size in (0, 20):
        encoded = bpe.decode(bpe.encode(docs, vocab, public_tokenizers.PATTERN, dictionary_size=size), vocab).collect()
        got = sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist(), bytes(r.bytes)) for r in encoded)
        assert got == sorted((str(i), library.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in corpus())
    assert bpe.encode(none, vocab, public_tokenizers.PATTERN).count() == 0
    draw = random.Random(4)
    long = ["x" * 700, "-" * 1000, "漢字" * 300, "é" * 133, "=" * 77 + "-" * 50, "".join(draw.choices("abcdefgXYZ", k=900))]
    long += ["".join(draw.choices(["the", "ing", "tion", "ement", "ab", "é"], k=k)) for k in (1, 10, 50, 100)]
    rows = spark.createDataFrame([(w,) for w in long], "word string").select("word", bpe.byte_array(F.col("word"), vocab).alias("p"))
    for window in (4, 64):  # windows of 4 bytes fail to find their first token now and then, and all begins again
        for r in rows.select("word", F.get(bpe.encoded_words(F.array("p"), vocab, window), 0).alias("ids")).collect():
            assert r.ids == library._encode_single_piece(r.word.encode())


def test_bpe_query(spark, tmp_path):
    import tiktoken

    from weft.llm.queries import QUERIES

    tokens = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    spark.createDataFrame(corpus(), DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for i, t, *_ in corpus():
        ids = library.encode_ordinary(t or "")
        want.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    out = QUERIES["op3_byte_bpe"](spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out) == sorted(want)


def test_html_blocks():
    page = '<html><head><title>t</title></head><body><nav>Menu</nav><div class="side-bar sidebar">Side</div><script>var a="</p><p>no";</script><article><header><h1>A &amp; B</h1></header><p>One<b>two</b>  three<p>Four<div id=comments>Hi</div></article><footer>Foot</footer>'
    found = html_text.blocks(page)
    assert [b.text for b in found if b.marked and not b.dropped] == ["A & B", "Onetwo three", "Four"]
    assert html_text.main_texts([found])[0][0] == "A & B Onetwo three Four"
    assert html_text.blocks("") == [] and html_text.blocks("<p>a < b & c</p><p") == html_text.blocks("<p>a < b & c</p><p")


def test_html_classes():
    text = lambda page: html_text.main_texts([html_text.blocks(page)])[0][0]
    assert text('<body class="single no-sidebar"><article><p>one</p></article></body>') == "one"
    assert text('<main><div class="social-science"><p>one</p></div><div class="social-links">two</div></main>') == "one"
    assert text('<article><div class="entry-header"><h1>title</h1></div><p>one</p><div class="comments-area">two</div></article>') == "title one"
    assert text('<div class="entry-header">title</div><div class="site-header">no</div><p>one</p><div id="cookie_notice">two</div>') == "title one"
    assert text('<article class="comment related"><p>one</p><div class="ad">two</div><ul class="share-buttons"><li>x</ul></article>') == "one"
    assert text("<article><p>a <b>x</b> < 3 <a href='<>'>y</a></p><form>no</form></article>") == "a x < 3 y"
    assert text("<p>one<!-- <p>no --><script>a</p></script x>two") == "one two"


def test_html_of_unclosed_tags_takes_linear_time():
    import time

    for part in ("<a x ", "<a x='", '<a "x\' ', "<!", "<!-", "<script></script", "<div>", "</ul>", "<div></ul>", "<p class=", "&#", "<"):
        took = []
        for n in (4000, 32000):
            began = time.perf_counter()
            html_text.blocks("<ul>" + part * n)
            took.append(time.perf_counter() - began)
        assert took[1] < 0.3 + 24 * took[0], part


def test_host_boilerplate():
    menu = "about us our team all the news contact privacy terms"
    pages = [html_text.blocks(f"<div>{menu}</div><p>w{k} {prose(k, 30)}</p>") for k in range(4)]
    for text, gone in html_text.main_texts(pages):
        assert gone == len(menu.split()) and text.startswith("w")
    draw = random.Random(2)
    for _ in range(20):
        stream = np.array(draw.choices(range(3), k=60))
        page = np.sort(np.array(draw.choices(range(4), k=60)))
        outside = np.array(draw.choices([True, True, True, False], k=60))
        runs = {}
        for i in range(60 - 2):
            if page[i] == page[i + 2]:
                runs.setdefault(tuple(stream[i : i + 3]), []).append(i)
        want = np.zeros(60, bool)
        for at in runs.values():
            if len({page[i] for i in at if outside[i : i + 3].all()}) >= 2:
                for i in at:
                    want[i : i + 3] = True
        assert (html_text.repeated(stream, page, outside, 3, 2) == want).all()


def test_extract_rows(spark):
    rows = [(1, "http://a/x", None), (2, None, ""), (3, "http://a/y", "<p>text"), (3, "http://a/y", "<p>text"), (None, "bad", "<main>é</main>")]
    out = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), pages_per_shard=2).collect()
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in out) == [("1", "", 0), ("2", "", 0), ("3", "text", 4), ("3", "text", 4), ("None", "é", 1)]


def test_given_pages_against_their_articles():
    import html

    import pyarrow.parquet as pq

    pages = [r["html"] or "" for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()]
    for page in pages:
        article = re.search(r"<article\b.*?>(.*)</article>", page, re.DOTALL)[1]
        parts = (" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", article))
        assert html_text.main_texts([html_text.blocks(page)])[0][0] == " ".join(x for x in parts if x)


def test_pages_query(spark, tmp_path):
    from weft.llm.queries import QUERIES

    schema = "page_id long, url string, html string, host string, row long, more int"
    body = "".join(f"<p>{rich(k, 30)}</p>" for k in range(400))
    rows = [(k, f"http://a/{k}", f"<nav>m</nav><article><h1>t &amp; {k}</h1>{body if k == 3 else ''}<p>x  y</p></article><footer>f</footer>", "h", 1, 2) for k in range(5)]
    rows += [rows[0], (None, None, None, None, None, None), (7, "http://b", "", "h", 1, 2)]
    for folder, some in (("full", rows), ("none", [])):
        spark.createDataFrame(some, schema).write.parquet(str(tmp_path / folder / "pages.parquet"))
    out = QUERIES["op4_html_text"](spark, str(tmp_path / "full")).collect()
    whole = " ".join(rich(k, 30) for k in range(400))
    want = [(str(k), f"t & {k} {whole + ' ' if k == 3 else ''}x y") for k in (0, 0, 1, 2, 3, 4)] + [("None", ""), ("7", "")]
    assert sorted((str(r.page_id), r.text) for r in out) == sorted(want) and all(r.n_chars == len(r.text) for r in out)
    assert QUERIES["op4_html_text"](spark, str(tmp_path / "none")).count() == 0
    assert QUERIES["op5_warc_round_trip"](spark, str(tmp_path / "none")).count() == 0
    assert QUERIES["op5_warc_round_trip"](spark, str(tmp_path / "full")).count() == len(rows)


def test_boilerplate_over_shards(spark):
    passage = "read more of our stories in the morning letter"
    rows = [(i, f"http://{'AB'[i % 2]}/{i}", f"<div>{rich(i, 20)}</div><p>{passage if i in (0, 7, 14, 20, 22, 38) else 'x'}</p>") for i in range(40)]
    rows += [(40, "http://a/40", f"<article>{passage}</article>"), (41, "http://c/1", passage), (42, "http://c/2", passage), (43, None, None)]
    rows += rows[30:31]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    hosts = {}
    for k, (_, url, _) in enumerate(rows):
        hosts.setdefault(re.sub("^http://(.)/.*", r"\1", (url or "").lower()), []).append(k)
    want = []
    for own in hosts.values():
        texts = html_text.main_texts([html_text.blocks(rows[k][2] or "") for k in own])
        want += [(str(rows[k][0]), *t) for k, t in zip(own, texts, strict=True)]
    for size, frequent in ((2, 100), (1024, 100), (3, 0), (3, 1)):
        out = html_text.extract(table, size, frequent).collect()
        assert sorted((str(r.page_id), r.text, r.n_repeated) for r in out) == sorted(want)
    assert {i for i, text, n in want if n} == {"0", "14", "20", "22", "38", "40"}


def test_warc(spark, tmp_path):
    long = "é" * 5000 + "\r\n\r\nWARC/1.1\r\n"
    rows = [(5, "http://a/1", "x" * 200), (3, "http://a/2", "x" * 200), (9, None, "short"), (8, "http://b/ c\r\n", "short"), (7, "u", None), (6, "v", long), (6, "v", long), (2, "w", long + "!"), (None, "n", "y" * 150)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    warc.write_warc(pages, str(tmp_path / "w"), segment_bytes=1000, records_per_file=4)
    out = warc.read_warc(spark, str(tmp_path / "w")).collect()
    got = sorted((str(r.page_id), r.record_type, str(r.refers_to), r.payload_bytes, r.payload_digest) for r in out)
    want = sorted((str(i), "revisit" if i == 5 else "response", "3" if i == 5 else "None", len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest()) for i, _, h in rows)
    assert got == want
    assert {bytes(r.payload).decode() for r in out if r.page_id == 6} == {long}
    data = b"abc" * 9000
    assert warc.unchunked(warc.chunked(data)) == data and warc.unchunked(b"3;x=1\r\nabc\r\n0\r\nT: v\r\n\r\n") == b"abc"
    for bad in (b"", b"5\r\nabc\r\n0\r\n\r\n", b"3\r\nabc\r\n", b"0\r\n\r\nx"):
        with pytest.raises(ValueError):
            warc.unchunked(bad)
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"))


def test_rollup(spark, tmp_path, monkeypatch):
    schema = "source string, lang string, version string, op string, n_tokens long, old_tokens long, n_docs int"
    state = rollup.Rollup(spark, "file://" + str(tmp_path / "r"))
    assert state.totals().count() == 0
    load = spark.createDataFrame([("a", "en", "v1", "insert", 5, None, 0), ("a", "en", "v1", "insert", 5, None, 0), (None, None, "v1", "insert", None, None, 0)], schema)
    assert state.apply("load", load) and not state.apply("load", load)
    monkeypatch.setattr(rollup, "COMPACT_AT", 2)
    assert state.apply("fix", spark.createDataFrame([("a", "en", "v1", "revise", 9, 5, 0), ("a", "en", "v1", "delete", 5, None, 0)], schema))
    read = lambda s: sorted((str(r.source), r.n_docs, r.n_tokens) for r in s.totals().collect())
    assert read(state) == [("None", 1, 0), ("a", 1, 9)]
    assert state.apply("empty", spark.createDataFrame([], schema))
    assert not state.apply("load", load) and len(state._list("commits")) < 2 and len(state._list("base")) == 1
    # a driver lost after a new base appeared and before its commits were dropped
    monkeypatch.setattr(rollup.Rollup, "_settle", lambda self: None)
    state.apply("late", spark.createDataFrame([("b", "en", "v1", "insert", 7, None, 0)], schema))
    state.compact()
    assert "late" in state._list("commits") and read(state) == [("None", 1, 0), ("a", 1, 9), ("b", 1, 7)]
    monkeypatch.undo()
    state = rollup.Rollup(spark, "file://" + str(tmp_path / "r"))
    assert state._list("commits") == [] and not state.apply("late", load)
    assert state.apply("gone", spark.createDataFrame([("b", "en", "v1", "delete", 7, None, 0)], schema))
    again = rollup.Rollup(spark, "file://" + str(tmp_path / "r"))
    assert read(again) == read(state) and again.applied() == {"load", "fix", "empty", "late", "gone"}
    with pytest.raises(Exception, match="unknown op"):
        state.apply("bad", spark.createDataFrame([("a", "en", "v1", "upsert", 1, None, 0)], schema))


def test_rollup_query(spark, tmp_path):
    import tiktoken
    from tokenizers import Tokenizer

    from weft.llm.queries import QUERIES

    tokens = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ranks = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [(i, t, lang, f"s{(i or 0) % 2}" if i != 4 else None, 1) for i, t, lang, *_ in corpus()]
    for folder, some in (("full", rows), ("none", [])):
        spark.createDataFrame(some, "doc_id long, text string, lang string, source string, n_words int").repartition(2).write.parquet(str(tmp_path / folder / "documents.parquet"))
    want = Counter()
    for _, t, lang, source, _ in rows:
        for version, n in (("byte_bpe_50k.tiktoken", len(ranks.encode_ordinary(t or ""))), ("word_bpe_49k.json", len(library.encode(t or "", add_special_tokens=False).ids))):
            want[source, lang, version, "docs"] += 1
            want[source, lang, version, "tokens"] += n
    out = QUERIES["op6_token_rollup"](spark, str(tmp_path / "full")).collect()
    got = {(r.source, r.lang, r.version, k): n for r in out for k, n in (("docs", r.n_docs), ("tokens", r.n_tokens))}
    assert got == dict(want) and len(out) == len(want) // 2
    assert QUERIES["op6_token_rollup"](spark, str(tmp_path / "none")).count() == 0
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    count = rollup.rank_counter(path, public_tokenizers.PATTERN, remembered=5)
    assert [count(t or "") for _, t, *_ in rows] == [len(ranks.encode_ordinary(t or "")) for _, t, *_ in rows]


def brute_katz(train, order):
    """p(h, w) of a Katz model of the token lists ``train``, and its counts of words."""
    counts = {k: Counter() for k in range(1, order + 1)}
    for s in train:
        padded = ["<s>"] * (order - 1) + s
        for i in range(order - 1, len(padded)):
            for k in counts:
                counts[k][tuple(padded[i - k + 1 : i + 1])] += 1
    total = sum(counts[1].values())
    cut = {k: (lambda c, d=katz.discounts(Counter(counts[k].values())): c * d[c - 1] if c <= len(d) else c) for k in counts}
    unknown = 1 - sum(cut[1](c) for c in counts[1].values()) / total
    size, alpha = {}, {}

    def p(h, w):
        if not h:
            return cut[1](counts[1][(w,)]) / total if (w,) in counts[1] else unknown
        if (*h, w) in counts[len(h) + 1]:
            return cut[len(h) + 1](counts[len(h) + 1][(*h, w)]) / size[h]
        return alpha.get(h, 1) * p(h[1:], w)

    for k in range(2, order + 1):
        after = {}
        for g, c in counts[k].items():
            after.setdefault(g[:-1], []).append((g[-1], c))
        for h, seen in after.items():
            kept = sum(cut[k](c) for _, c in seen)
            size[h] = sum(c for _, c in seen)
            size[h] += kept >= size[h] - 1e-9
            alpha[h] = (1 - kept / size[h]) / (1 - sum(p(h[1:], w) for w, _ in seen))
    return p, counts[1], total


def test_katz(spark, docs, none, monkeypatch):
    train = [t for _, t, *_ in corpus()][3:9] + [None]
    rows = spark.createDataFrame([(t,) for t in train], "text string").repartition(2)
    seqs = [[*words(lower(t)), "</s>"] for t in train]
    monkeypatch.setattr(katz, "TOKENS_PER_BUCKET", 300)
    monkeypatch.setattr(katz, "TOKENS_AT_ONCE", 200)
    everyone = spark.createDataFrame([(None, t, 1) for t in train] + [(i, t, 0) for i, t, *_ in corpus()], "doc_id long, text string, learns int").repartition(3)
    for order, hot, frequent in ((3, 2, 6), (2, 5, 0), (4, None, 400)):
        p, uni, total = brute_katz(seqs, order)
        vocabulary = [w for (w,) in uni]
        for h in [(), ("<s>",) * (order - 1), ("nowhere",) * (order - 1), *[tuple(["<s>", *s][i : i + order - 1]) for s in seqs[:2] for i in range(len(s) - order)]]:
            assert sum(p(h[: order - 1], w) for w in [*vocabulary, "never seen"]) == pytest.approx(1, abs=1e-9)

        def expected(i, t, order=order, p=p, uni=uni, total=total):
            s = [*words(lower(t)), "</s>"]
            padded = ["<s>"] * (order - 1) + s
            score = sum(math.log10(p(tuple(padded[k : k + order - 1]), w)) for k, w in enumerate(s))
            base = sum(math.log10((uni[w,] + 1) / (total + len(uni) + 1)) for w in s)
            return (str(i), len(s), sum((w,) in uni for w in s), round(base, 5), round(score, 5))

        def seen(out):
            return Counter((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 5), round(r.score, 5)) for r in out.collect())

        want = Counter(expected(i, t) for i, t, *_ in corpus())
        if order != 2:
            model = katz.train(rows, order=order, frequent_words=frequent, hot_tokens=hot)
            assert (model.total, model.distinct) == (total, len(uni)) and model.buckets > 5
            assert hot is None or len(model.hot[order]) > 0  # some contexts are spread
            assert seen(katz.score(docs, model)) == want
        if order != 4:
            model, out = katz.train_and_score(everyone, F.col("learns") == 1, order=order, frequent_words=frequent, hot_tokens=hot)
            assert (model.total, model.distinct) == (total, len(uni))
            assert seen(out) == want + Counter(expected(None, t) for t in train)
    assert katz.score(none, model).count() == 0
    empty = katz.train(none)
    assert [(r.n_tokens, r.n_known, r.score) for r in katz.score(docs.where("doc_id = 4"), empty).collect()] == [(121, 0, 0.0)]


def test_katz_grams_and_packing():
    draw = np.random.default_rng(0)
    for words, k, bits in ((np.arange(-3, 9), 3, 21), (np.arange(-3, 9), 4, 3), (np.append(np.arange(-5, 1 << 20), 1 << 21), 4, 15), (np.arange(-2, 5), 1, 3)):
        sizes = np.array([1, 5, 2, 40, 300])
        local = draw.integers(0, min(len(words) - 1, 8), sizes.sum())
        chosen = np.sort(draw.choice(len(local), 100, replace=False))
        grams, which, n = katz.Tokens(words, local, sizes, chosen).grams(k, bits)
        ids = np.concatenate((grams.wide, np.stack([(grams.plain >> bits * (k - 1 - j)) & ((1 << bits) - 1) for j in range(k)])), axis=1)
        want, at = [], 0
        for size in sizes:
            one = [words[-1]] * (k - 1) + words[local[at : at + size]].tolist()
            want += [tuple(one[i : i + k]) for i in range(size) if at + i in set(chosen.tolist())]
            at += size
        assert [tuple(ids[:, i].tolist()) for i in which] == [tuple(map(int, g)) for g in want]
        assert n.tolist() == [Counter(which.tolist())[i] for i in range(len(grams))]
        names = grams.names()
        assert (np.diff(names) > 0).all() and (names == katz.named(ids, bits)).all()
        if k > 1:
            assert (grams.contexts() == katz.named(ids[:-1], bits)).all()
        assert (katz.risen(katz.rising(names)) == names).all()
        bucket = katz.bucket_of(names, grams.contexts(), names[:0], 7)
        order, parts = katz.dealt(bucket, len(grams.wide_names))
        assert sorted(order.tolist()) == list(range(len(grams))) and (np.diff(bucket[order].astype(int)) >= 0).all()
        assert (katz.in_order(names[order], order) == names).all()


def test_katz_keeps_tables_small(spark, monkeypatch):
    """Numbers take the bytes they need, and no shuffle that brings answers back holds the n-grams or texts of a level at once."""
    for x in ([0], [127, -128], [128], [-129, 5], [1 << 20], [-(1 << 63), (1 << 63) - 1], []):
        assert katz.unpacked(katz.packed(np.array(x, np.int64))).tolist() == x
    both = np.array([[0.5, -1e300], [np.pi, 0]])
    assert (katz.unpacked(katz.packed(both), 2) == both).all()
    assert [katz.packed(np.array([x]))[0] for x in (1, 1 << 7, 1 << 40, 0.5)] == [1, 2, 6, 0]
    x = np.random.default_rng(1).integers(-9, 9, 100)
    (names, at, which), (want, places) = katz.grouped(x), np.unique(x, return_inverse=True)
    assert (katz.distinct(x) == want).all() and (names == want).all() and (which == places).all() and (x[at] == want).all()
    monkeypatch.setattr(katz, "TOKENS_PER_BUCKET", 50)
    monkeypatch.setattr(katz, "TOKENS_AT_ONCE", 20)
    sizes, answered = [], katz.answered

    def counted(base, *more):
        sizes.append(base.count())
        return answered(base, *more)

    monkeypatch.setattr(katz, "answered", counted)
    rows = spark.createDataFrame([(k, rich(k, 40)) for k in range(40)], "doc_id long, text string")
    _, out = katz.train_and_score(rows, F.col("doc_id") % 7 != 2)
    assert out.count() == 40 and sizes[-1] >= 20  # the last level's shuffle holds all texts; nothing is written after it
    assert max(sizes[:-1]) < sizes[-1]


def test_katz_words_and_their_numbers():
    texts = [b"", b"A b\x00 b  c\x0b\x1fd", "żółć ΑΒΓ Ünï İx".encode(), b"\x85x abcdefg abcdefgh abcdefghi \t", b"   ", b"z\x00 z\x00\x00 \xa0"]
    for some in ([], texts[:1], texts):
        at, length, n, joined = katz.split_words(some)
        found = [joined[i : i + j] for i, j in zip(at.tolist(), length.tolist())]
        assert found == [w for t in some for w in t.lower().split()] and n.tolist() == [len(t.split()) for t in some]
        keys = katz.short_keys(at, length, joined).tolist()
        assert keys == [-1 - katz.word_number(w) if len(w) <= katz.SHORT else -1 for w in found]
    numbers = {w: katz.word_number(w) for w in found + [b"", b"\x00", b"\x00\x00", b"\xff" * 7, b"\xff" * 8, b"long" * 3]}
    assert len(set(numbers.values())) == len(numbers) and all(-(1 << 63) <= x < 0 for x in numbers.values())
    assert all((x <= -(1 << 62)) == (len(w) > katz.SHORT) for w, x in numbers.items())


def test_katz_query(spark, tmp_path):
    from weft.llm.queries import QUERIES

    texts = [rich(k, 40) for k in range(12)] + [None, "", rich(1, 40)]
    rows = [(k if k < 14 else 1, t, 1, "x") for k, t in enumerate(texts)] + [(None, rich(2, 40), 1, "x")]
    schema = "doc_id long, text string, score int, `key` string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "a" / "documents.parquet"))
    out = QUERIES["op9_katz_backoff"](spark, str(tmp_path / "a")).collect()
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(14)}
    train = [[*words(lower(t)), "</s>"] for i, t, *_ in rows if not held.get(i, False)]
    p, uni, total = brute_katz(train, 3)
    want = []
    for i, t, *_ in rows:
        s = ["<s>", "<s>", *words(lower(t)), "</s>"]
        want.append((str(i), held.get(i, False), len(s) - 2, total, sum(math.log10(p(tuple(s[k - 2 : k]), s[k])) for k in range(2, len(s)))))
    assert len(out) == len(rows) and any(held.values())
    for r, w in zip(sorted(out, key=lambda r: (str(r.doc_id), r.score)), sorted(want, key=lambda w: (w[0], w[-1])), strict=True):
        assert (str(r.doc_id), r.held_out, r.n_tokens, r.train_tokens) == w[:4] and r.score == pytest.approx(w[4], abs=1e-6)
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "b" / "documents.parquet"))
    assert QUERIES["op9_katz_backoff"](spark, str(tmp_path / "b")).count() == 0


def test_queries_give_what_the_contracts_say(spark, tmp_path):
    """op1, op2, op7, op8 and op10 through their queries, on nulls, repeats, clashing names and an empty table."""
    from tokenizers import Tokenizer

    from weft.llm.queries import QUERIES

    full, empty = str(tmp_path / "full"), str(tmp_path / "empty")
    rows = corpus()
    for folder, some in ((full, rows), (empty, [])):
        spark.createDataFrame(some, DOCS).coalesce(2).write.parquet(f"{folder}/documents.parquet")
    for name in ("op1_language_id", "op2_best_fit_packing", "op3_byte_bpe", "op7_quality_bands", "op8_exact_dedup", "op10_simhash"):
        assert QUERIES[name](spark, empty).count() == 0
    out = QUERIES["op1_language_id"](spark, full).collect()
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 == 2 for r in rows]
    assert sorted((str(r.doc_id), r.held_out) for r in out) == sorted((str(r[0]), h) for r, h in zip(rows, held, strict=True))
    profiles = langid.fit(spark.createDataFrame([r for r, h in zip(rows, held, strict=True) if not h], DOCS))
    assert sorted((str(r.doc_id), r.lang_pred, r.score) for r in out) == sorted((str(i), *profiles.nearest(t)[:2]) for i, t, *_ in rows)
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, t, *_ in rows:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.update((str(i), k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes())) for k, a in enumerate(range(0, len(ids), 2048)))
    out = QUERIES["op2_best_fit_packing"](spark, full).collect()
    assert Counter((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    places = {}
    for r in out:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(o == sum(n for p, n in x if p < o) for x in places.values() for o, _ in x) and all(sum(n for _, n in x) <= 2048 for x in places.values())
    out = QUERIES["op7_quality_bands"](spark, full).collect()
    want = []
    import zstandard

    compress = zstandard.ZstdCompressor(level=quality.Bands().level).compress
    for i, t, *_ in rows:
        counts = quality.base_counts((t or "").encode())
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        want.append((str(i), *counts, failed, not failed and quality.compression((t or "").encode(), quality.Bands(), compress)[2]))
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in out) == sorted(want)
    out = QUERIES["op8_exact_dedup"](spark, full).collect()
    assert sorted((str(r.doc_id), r.text_sha256) for r in out) == sorted((str(i), hashlib.sha256(lower(t).encode()).hexdigest()) for i, t, *_ in rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in out)
    out = QUERIES["op10_simhash"](spark, full).collect()
    assert sorted((str(r.doc_id), r.fingerprint) for r in out) == sorted((str(i), f"{brute_fingerprint(t):016x}") for i, t, *_ in rows)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    base = [rich(k, 400) for k in range(6)]
    texts = [*base, base[0], base[1].replace(" ", " q ", 1), "too short", None, "spam eggs " * 400]
    rows = [(i, t, "en", "s", len(t or ""), *CLASH) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _keep int, _k int, _again int, _hot int, _dropped_id int, _id int").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    good = [r for r in rows if len(words(r[1])) >= 50 and "spam" not in r[1]]
    last = {lower(r[1]): r[0] for r in good}
    left = [r for r in good if last[lower(r[1])] == r[0]]
    fps = {r[0]: brute_fingerprint(r[1]) for r in left}
    want = {i for i in fps if not any(j < i and (fps[i] ^ fps[j]).bit_count() <= 3 for j in fps)}
    assert {r.doc_id for r in out} == want
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
