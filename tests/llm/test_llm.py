"""Corpus operators against brute force, round trips and held-out labels."""

import collections
import hashlib
import json
import os
import re
import zlib

import duckdb
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tessella.llm import catalog, decontaminate, html_text, lines, near_duplicates, nearest, quality, sentencepiece_codec, sharding, toxicity, warc

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, "en", (sources or ["s"] * len(texts))[i], None if t is None else len(t)) for i, t in enumerate(texts)], DOCS)


def words(n, start=0):
    return " ".join(f"w{start + i}x" for i in range(n))


@needs_tables
@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.sql(catalog.SQL[name])
    assert sorted(want.columns) == cols
    assert sorted(map(repr, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(repr, con.sql(f"SELECT {', '.join(cols)} FROM want").fetchall()))


# Line dedup


def test_lines_keep_one_holder_and_odd_rows(spark):
    line = "a line on very many sites"
    texts = [f"own words of page {i} and some more\n{line}\n" for i in range(9)] + [None, "", "\n\n", "short line", "x " * 30_000]
    df = docs(spark, texts, [f"s{i}" for i in range(9)] + ["s1", None, "s2", "s3", "s4"])
    out = {r.doc_id: r for r in lines.drop_boilerplate(df.withColumn("kept", F.lit(1)).withColumn("a", F.lit(2))).collect()}
    assert out[0].text == texts[0] and all(out[i].text == f"own words of page {i} and some more\n" and out[i].lines_removed == 1 for i in range(1, 9))
    assert [out[i].text for i in range(9, 14)] == texts[9:] and out[3].kept == 1 and out[3].a == 2
    assert lines.drop_boilerplate(df.limit(0)).count() == 0


def test_short_carriers_and_copies_lose_the_line_too(spark):
    line = "a line of fifty words, say, on very many sites"
    df = docs(spark, [f"own {i}\n{line}" for i in range(10)] + [line] * 4, [f"s{i}" for i in range(14)])
    out = [r.text for r in lines.drop_boilerplate(df).orderBy("doc_id").collect()]
    assert out == [f"own 0\n{line}"] + [f"own {i}" for i in range(1, 10)] + [""] * 4


def test_repeated_ids_are_one_holder(spark):
    df = docs(spark, ["a line on very many sites"] * 12, [f"s{i}" for i in range(12)]).withColumn("doc_id", F.col("doc_id") % 2)
    assert sorted((r.doc_id, r.lines_removed) for r in lines.drop_boilerplate(df).collect()) == [(0, 0)] * 6 + [(1, 1)] * 6


def test_spread_below_the_threshold_stays(spark):
    df = docs(spark, ["a line on seven sites only"] * 30, [f"s{i % 7}" for i in range(30)])
    assert {r.lines_removed for r in lines.drop_boilerplate(df).collect()} == {0}


# SentencePiece


@pytest.fixture(scope="module")
def model():
    return open(sentencepiece_codec.MODEL, "rb").read()


ODD = ["", " ", "hello  world", " a\nb\t c ", "日本語 テキスト 🎉🎉", "a\r\nb", "\x00z", "x" * 300, "aaaa    bbbb", " x", "Don't—stop…  it's 3.14% of 1,000!!"]


@needs_tables
def test_pieces_equal_the_library(model):
    codec, library = sentencepiece_codec.Codec(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    texts = ODD + [t for t, in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet'").fetchall()]
    for t in texts:
        assert codec.encode(t).tolist() == library.encode(t)
        assert codec.decode(codec.encode(t).tolist()) == t


def test_unigram_kind_finds_the_best_sum(model):
    at = model.find(bytes([0x18, 2, 0x20]))  # the trainer's kind: 2 is BPE, 1 is unigram
    codec = sentencepiece_codec.Codec(model[: at + 1] + b"\x01" + model[at + 2 :])
    assert codec.kind == sentencepiece_codec.UNIGRAM
    for t in ["internationalisation", "unbelievable", "the", "counterexamples", "banana"]:
        marked = "▁" + t
        best = [0.0] + [-np.inf] * len(marked)
        for j in range(1, len(marked) + 1):
            for i in range(j):
                if marked[i:j] in codec.ids:
                    best[j] = max(best[j], best[i] + codec.scores[codec.ids[marked[i:j]]])
        assert np.isclose(sum(codec.scores[i] for i in codec.encode(t)), best[-1]) and codec.decode(codec.encode(t).tolist()) == t


MIXED = ["a▁b ▁▁c▁", "  two  blanks ", "x,y;「z」 a”. «b»,", "naïve café,Ελλάδα-мир 한국어.no", "é1²½ a_b\tc\u00a0d", "क्षि, а́б ०१", "if x:\n" + " " * 17 + "y" + " " * 40, "a" * 500 + "!" * 70, "\x7f~`^_[a]{B}"]


def test_pairs_are_told_without_merging_anew(model, monkeypatch):
    codec, library = sentencepiece_codec.Codec(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    rng = np.random.default_rng(2)
    standing = [e[1] for e in codec.automaton.values()]
    short = [i for i in standing if len(codec.pieces[i]) < 4]
    pairs = [(int(rng.choice(standing)), int(rng.choice(short))) for _ in range(3000)] + [(int(i), int(j)) for i, j in rng.choice(short, (6000, 2))]
    pairs += [(i, i) for i in standing[::7]] + [(i, x) for i in short[::20] for x in codec.unranked]
    told = {}
    for i, j in pairs:
        two = [codec.pieces[i], codec.pieces[j]]
        told[i, j] = codec.apart(i, j)
        assert told[i, j] == (codec.merged("".join(two)) == two)
    assert 100 < sum(told.values()) < len(told) - 100
    monkeypatch.setattr(codec, "merged", None)  # words and signs need no merging
    for t in ["internationalisation, unbelievable! (3.14)", "Don't stop; naïve café"]:
        assert codec.encode(t).tolist() == library.encode(t)


def test_mixed_texts_and_small_caches_equal_the_library(model, monkeypatch):
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    want = [library.encode(t) for t in MIXED + ODD]
    monkeypatch.setattr(sentencepiece_codec, "SEGMENTS", 3)
    monkeypatch.setattr(sentencepiece_codec, "PAIRS", 50)
    codec = sentencepiece_codec.Codec(model)
    for _ in range(2):
        assert [codec.encode(t).tolist() for t in MIXED + ODD] == want
        assert codec.pairs <= 50 and len(codec.cache) <= 3 and sum(len(e[3]) for e in codec.automaton.values()) <= 50


def test_codec_rows(spark, model):
    out = sentencepiece_codec.coded(docs(spark, [None, "", "two words"]), model).orderBy("doc_id").collect()
    assert out[0].ids is None and out[0].round_trip is None and out[1].ids == [] and out[1].round_trip and out[2].n_tokens == len(out[2].ids) > 0


# Nearest neighbours


def test_nearest_exact_scores_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[40:80] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] + [1.0] * 7), (1060, [None] + [1.0] * 7), (1080, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = collections.defaultdict(list)
    for r in nearest.nearest(df, lambda i: i % 20 == 0).orderBy("query_id", "rank").collect():
        out[r.query_id].append((r.vec_id, r.score))
    assert sorted(out) == list(range(0, 300, 20))
    y = x.astype(float)
    for q, found in out.items():
        s = y @ y[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(300), -np.round(s, 12)))[:20]
        assert [v for v, _ in found] == best.tolist() and np.allclose([c for _, c in found], s[best])
    assert nearest.nearest(df.limit(0), lambda i: i % 20 == 0).count() == 0


def test_nearest_answers_dont_depend_on_the_layout(spark):
    x = np.random.default_rng(1).normal(size=(1500, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = [sorted(map(tuple, nearest.nearest(df.repartition(n), lambda i: i % 50 == 0, k=10, rerank=0.05, least=20).collect())) for n in (1, 16)]
    assert found[0] == found[1] and len(found[0]) == 300
    want = {(q, int(v)) for q in range(0, 1500, 50) for v in [i for i in np.argsort(-(x @ x[q])) if i != q][:10]}
    assert len(want & {(q, v) for q, _, v, _ in found[0]}) >= 0.9 * len(want)


def test_nearest_of_an_id_with_two_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>").withColumn("ids", F.lit(1))
    out = [tuple(r) for r in nearest.nearest(df, lambda i: i == 0, k=5).orderBy("rank").collect()]
    assert out == [(0, 1, 1, 1.0), (0, 2, 2, 0.5), (0, 3, 1, 0.0)]


# WARC


def test_archives_round_trip(spark):
    big, page = "p" * 150_000, "<html>" + "same " * 50 + "</html>"
    rows = [(1, "http://a/", page), (2, "http://b/\nx", page), (3, None, None), (4, "u", ""), (5, "u", "tiny"), (6, "u", "tiny"), (7, "u", big), (8, "é", "é" * 60), (None, "u", page)]
    out = {r.page_id: r for r in warc.archived(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert len(out) == 9
    for i, _, h in rows:
        assert (out[i].payload_bytes, out[i].payload_digest) == (len((h or "").encode()), sha(h))
    assert (out[2].record_type, out[2].refers_to, out[None].refers_to) == ("revisit", 1, 1)
    assert all(out[i].record_type == "response" and out[i].refers_to is None for i in (1, 3, 4, 5, 6, 7, 8))
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_archive_form():
    d = warc.train_dictionary([b"abc" * 10])
    c = __import__("zstandard").ZstdCompressor(dict_data=__import__("zstandard").ZstdCompressionDict(d))
    records = [warc.page_record("1", "http://x/", b"hello", "00", None), warc.page_record("2", "http://y/", b"hello", "00", "1")]
    assert list(warc.frames(warc.preamble(d) + b"".join(map(c.compress, records)))) == records
    assert warc.parsed(records[1])[0]["warc-refers-to"] == "<urn:page:1>"


# HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="has-sidebar"><header>Site</header><nav><ul><li><a href=x>A</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div class="wrap with-sidebar"><article class=post><header><h1>Title &amp; {0}</h1></header><p>Hello <b>big
 world<br>line&nbsp;two <span class="ad">buy</span>tail <button>Share</button>end<p>Second &lt;p&gt; &#233; {0}<ul><li>one {0}<li>two {0}</ul><p>Read our fixed appeal.</p><form><label>Search</label></form>
<div class="ad">AD</div><aside>side</aside><section class="comments"><article class=comment><p>reader</p></article></section><table><tr><td>a{0}<td>b{0}</table></article></div><aside class=sidebar>S</aside><footer>F</footer></body></html>"""


def extracted(spark, pages):
    rows = [(i, f"http://h.example/{i}", page) for i, page in enumerate(pages)]
    return [r.text for r in html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def test_marked_article_is_kept_whole(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.format(f"n{i}")) for i in range(40)] + [(100, None, None), (101, "odd", ""), (102, "http://z/", "<p>plain</p>no tags <div>x"), (103, "http://z/", "<" * 5000), (3, "http://h.example/3", PAGE.format("n3")), (None, None, "<p>no id")]
    found = html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))).collect()
    out = {r.page_id: r for r in found}
    assert out[7].text == "Title & n7\nHello big world line two tail end\nSecond <p> é n7\none n7\ntwo n7\nRead our fixed appeal.\nan7\nbn7"
    assert out[100].text == "" and out[101].n_chars == 0 and out[102].text == "plain\nno tags\nx" and len(found) == 46 and out[None].text == "no id"
    assert html_text.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_template_decides_what_an_unmarked_page_holds(spark):
    shell = "<html><body><div><b>The site of everything</b></div><div><ul>{1}</ul></div><div><h1>Title {0}</h1><p>Body of page {0}</p><p>More {0}</p></div><div>Our terms hold</div></body></html>"
    pages = [shell.format(f"n{i}", "".join(f"<li><a href=/{k}>see {i * k}</a></li>" for k in range(3 + i % 4))) for i in range(8)]
    want = [f"Title n{i}\nBody of page n{i}\nMore n{i}" for i in range(8)]
    assert extracted(spark, pages) == want
    alone = [html_text.main_text(p, None) for p in pages]
    assert all("Our terms hold" in a and "see" in a and a != w for a, w in zip(alone, want))


def test_equal_pages_keep_their_text(spark):
    page = "<html><body><article><h1>One</h1><p>The whole text.</p></article></body></html>"
    assert set(extracted(spark, [page] * 12)) == {"One\nThe whole text."}
    assert set(extracted(spark, [page.replace("article", "div")] * 12)) == {"One\nThe whole text."}
    few = [f"<html><body><p>fixed</p><!-- {i} --></body></html>" for i in range(6)]
    assert set(extracted(spark, few)) == {"fixed"}


def test_classes_by_brute_force(spark):
    rng = np.random.default_rng(3)
    pages = [("a" if i % 3 else "b", "<html><body><div>Top</div>" + "".join(f"<p>{'same' if rng.random() < 0.6 else f'own {i} {k}'}</p>" for k in range(rng.integers(1, 4))) + "<ul><li>x</ul><i>foot</i></body></html>") for i in range(24)]
    got = {r.host: {tuple(c) for c in r.template} for r in html_text.templates(spark.createDataFrame(pages + pages[:9], "host string, html string")).collect()}
    for host in "ab":
        seqs = [[h for h, *_ in html_text.tokens(p)] for p in dict.fromkeys(p for h, p in pages if h == host)]
        classes = collections.defaultdict(set)
        for t in {t for x in seqs for t in x}:
            vector = tuple(x.count(t) for x in seqs)
            if sum(map(bool, vector)) >= len(seqs) / 2 + 1:
                classes[vector].add(t)
        assert {frozenset(c) for c in got[host]} == {frozenset(c) for c in classes.values()}
        assert all([x.index(t) for t in c] == sorted(x.index(t) for t in c) for c in got[host] for x in seqs if set(c) <= set(x) and len({x.count(t) for t in c} | {1}) == 1)


def test_copies_of_a_page_are_no_template(spark):
    shell = "<html><body><h4>Menu of the site</h4>{}<h5>Foot of the site</h5></body></html>"
    pages = [shell.format(f"<p>article number {i} alone</p>") for i in range(12)] + [shell.format("<p>the one article that was copied</p>")] * 60
    rows = [(i, f"http://h.example/{i}", page) for i, page in enumerate(pages)]
    out = {r.page_id: r.text for r in html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[3] == "article number 3 alone" and {out[i] for i in range(12, 72)} == {"the one article that was copied"}


def test_valid_classes_come_in_order_and_nest():
    assert html_text.valid_tokens([1, 5, 2, 1, 6, 2], [[1, 2], [5, 6]]) == {0, 2, 3, 5}
    assert html_text.valid_tokens([2, 1], [[1, 2]]) == set()
    assert html_text.valid_tokens([1, 7, 8, 2], [[1, 2], [7, 8]]) == {0, 1, 2, 3}


# Near duplicates


def test_near_duplicates_by_brute_force(spark):
    rng = np.random.default_rng(5)
    base = [rng.integers(0, 4000, rng.integers(20, 200)).tolist() for _ in range(25)]
    made = []
    for b in base:
        made.append(b)
        for _ in range(rng.integers(0, 5)):
            c = list(b)
            for _ in range(rng.integers(0, 4)):
                c[rng.integers(len(c))] = int(rng.integers(4000))
            made.append(c)
    texts = [" ".join(f"t{w}" for w in m) for m in made] + [None, None, "", "", "one two", "one two", "one three", "!!", words(20_000)]
    got = {r.doc_id: r.class_id for r in near_duplicates.near_duplicates(docs(spark, texts).withColumn("key", F.lit(0))).collect()}
    hashes = near_duplicates.WordHashes()
    k = [near_duplicates.kmers(t, hashes) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if texts[i] == texts[j] or near_duplicates.alignment_similarity(k[j], k[i]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    assert got == dict(enumerate(root))


def test_large_group_of_near_copies_and_a_common_passage(spark):
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for i in range(150):
        c = list(base)
        c[rng.integers(120)] = f"e{i}"
        texts.append(" ".join(c))
    texts += [words(60) + " " + " ".join(f"u{i}y{j}" for j in range(70)) for i in range(150)]
    got = [r.class_id for r in near_duplicates.near_duplicates(docs(spark, texts)).orderBy("doc_id").collect()]
    assert set(got[:150]) == {0} and got[150:] == list(range(150, 300))


def test_short_texts_meet(spark):
    texts = []
    for n in (8, 9, 10, 13, 16, 19, 24):  # a text, and it without its last word or with another one
        for i in range(150):
            text = [f"n{n}t{i}w{k}" for k in range(n)]
            texts += [" ".join(text), " ".join(text[:-1] if n < 13 else text[:-1] + ["end"])]
    hashes = near_duplicates.WordHashes()
    k = [near_duplicates.kmers(t, hashes) for t in texts]
    alike = [bool(near_duplicates.alignment_similarity(k[i], k[i ^ 1])) for i in range(len(texts))]
    got = [r.class_id for r in near_duplicates.near_duplicates(docs(spark, texts)).orderBy("doc_id").collect()]
    assert got == [i - i % 2 if alike[i] else i for i in range(len(texts))] and sum(alike) >= 1500


def test_large_classes_joined_by_one_link(spark):
    texts, size = [], 100
    for g in range(4):
        one = [f"g{g}w{i}" for i in range(100)]
        other = one[:10] + [f"g{g}v{i}" for i in range(11)] + one[21:]
        bridge = one[:10] + other[10:15] + one[15:]
        edited = lambda b, i: " ".join(b[: 45 + i % 50] + [f"g{g}e{i}"] + b[46 + i % 50 :])
        texts += [edited(one, i) for i in range(size)] + [" ".join(one), " ".join(bridge)]
        texts += [edited(other, size + i) for i in range(size)] + [" ".join(other)]
    got = [r.class_id for r in near_duplicates.near_duplicates(docs(spark, texts)).orderBy("doc_id").collect()]
    each = 2 * size + 3
    assert got == [i // each * each for i in range(4 * each)]


def test_banded_alignment_is_the_common_subsequence():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a, b = rng.integers(0, 6, rng.integers(1, 40)).tolist(), rng.integers(0, 6, rng.integers(1, 40)).tolist()
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        assert near_duplicates.aligned(a, b, 50) == t[-1, -1]
        assert near_duplicates.aligned(a, b, 3) <= t[-1, -1]


# Classifiers


@needs_tables
@pytest.mark.parametrize("name, label, least", [("op10_quality", "quality", 0.9), ("op7_toxicity", "toxic", 0.6)])
def test_held_out_ranking(spark, name, label, least):
    sf = "/root/testdata/sf0.01"
    truth = dict(duckdb.sql(f"SELECT doc_id, {label} FROM '{sf}/labels.parquet'").fetchall())
    rows = catalog.QUERIES[name](spark, sf).collect()
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    pos, neg = ([s for s, y in held if y == v] for v in (1, 0))
    assert np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg]) > least


def test_classifiers_on_odd_tables(spark):
    df = docs(spark, [None, "", "x " * 50_000, "usual text"]).withColumn("n_chars", F.lit(None).cast("long"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.scored(df, quality.train(df, none), df.columns).collect()} == {0.5}
    assert {r.score for r in toxicity.scored(df, toxicity.train(df, none)).collect()} == {0.5}
    assert toxicity.scored(df.limit(0), toxicity.Toxicity(toxicity.Lexicon({}))).count() == 0


def test_factorisation_identity():
    rng = np.random.default_rng(2)
    m = quality.FactorisationMachine(0.1, rng.normal(size=quality.WIDTH), rng.normal(size=(quality.WIDTH, quality.FACTORS)) * 0.1)
    ids, x = np.array([3, 7, 11]), np.array([0.5, 1.0, 2.0])
    z = 0.1 + m.weights[ids] @ x + sum(m.factors[ids[i]] @ m.factors[ids[j]] * x[i] * x[j] for i in range(3) for j in range(i))
    assert np.isclose(m.score(ids, x), 1 / (1 + np.exp(-z)))


def test_segments_are_maximal():
    lexicon = toxicity.Lexicon({"good": 2.0, "bad": -1.0})
    found, n = toxicity.segments("good x good bad bad bad good", lexicon)
    assert n == 7 and [(a, b) for a, b, _ in found] == [(0, 2), (6, 6)] and np.isclose(found[0][2], 4 - toxicity.DRIFT)
    assert toxicity.segments(None, lexicon) == ([], 0)


def test_segments_by_brute_force():
    rng = np.random.default_rng(8)
    lexicon = toxicity.Lexicon({"p": 1.0, "q": 2.5, "m": -1.5, "n": -0.7})
    for _ in range(150):
        found = rng.choice(list("pqmnxyz"), rng.integers(1, 40)).tolist()
        score = [lexicon.get(w, -toxicity.DRIFT) for w in found]

        def best(a, b):
            """Maximal segments of a stretch: the best one, shortest first, then those to either side of it."""
            sums = [(sum(score[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)]
            top = max(sums, default=(0,), key=lambda x: (round(x[0], 9), *x[1:3]) if len(x) > 1 else x)
            if top[0] <= 1e-9:
                return []
            i, j = top[3:]
            return [*best(a, i), (i, j - 1, round(top[0], 6)), *best(j, b)]

        assert [(a, b, round(s, 6)) for a, b, s in toxicity.segments(" ".join(found), lexicon)[0]] == best(0, len(found))


def test_near_copies_count_once_in_the_lexicon(spark):
    texts = [" ".join(["vile"] * (i % 2) + [f"d{i}w{j}" for j in range(30)]) for i in range(400)] + ["vileness copied word for word many times over"] * 50
    df = docs(spark, texts)
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(i, 1) for i in range(400, 450)], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    assert set(model.lexicon) == {"vile"} and model.lexicon["vile"] > 0
    out = {r.doc_id: r for r in toxicity.scored(df, model).collect()}
    assert all((out[i].score >= 0.3) == bool(i % 2) for i in range(400))


# Sharding


def test_shards_are_balanced_contiguous_and_gapless(spark):
    texts = [f"text {i} " * (i % 50) for i in range(2000)] + ["copy"] * 900 + [None] * 60 + ["same words"] * 5 + ["z" * 3000]
    df = docs(spark, texts)
    out = sharding.byte_shards(df).collect()
    assert len(out) == len(texts)
    size, slots, shard_of = collections.Counter(), collections.defaultdict(list), {}
    for r in out:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        shard_of[r.doc_id] = r.shard
    target = sum(size.values()) / 16
    assert sorted(size) == list(range(16)) and max(abs(v - target) for v in size.values()) < 0.02 * target + 3001
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert len({shard_of[i] for i in range(2960, 2965)}) == 1
    assert sharding.byte_shards(df.limit(0)).count() == 0


# Decontamination


def test_contamination_by_brute_force(spark):
    rng = np.random.default_rng(4)
    items = [[f"i{k}q{j}" for j in range(int(rng.integers(12, 60)))] for k in range(12)]
    texts = []
    for i in range(60):
        w = [f"d{i}x{j}" for j in range(120)]
        item = list(items[i % 12])
        kind = i % 5
        if kind == 1:
            item[int(rng.integers(len(item)))] = "changed"
        if kind == 2:
            del item[int(rng.integers(len(item)))]
        if kind == 3:
            item = item[: len(item) // 2]
        if kind != 4:
            w[40:40] = item
        texts.append(" ".join(w).title())
    texts += [None, "", "one two three", " ".join(items[3])]
    bench = spark.createDataFrame([(k, " ".join(v)) for k, v in enumerate(items)] + [(90, None), (91, "too short")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contamination(docs(spark, texts), bench).collect()}
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    want = {}
    for d, t in enumerate(texts):
        w = re.findall(r"\w+", (t or "").lower())
        for k, item in enumerate(items):
            n, b = min(len(item), len(w)), collections.Counter(grams(item))
            for s in range(len(w) - n + 1) if n >= 5 else ():
                a = collections.Counter(grams(w[s : s + n]))
                both = sum((a & b).values())
                sim = both / (sum(a.values()) + sum(b.values()) - both)
                if sim >= 0.8:
                    want[d, k] = max(want.get((d, k), 0), sim)
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}
    assert decontaminate.contamination(docs(spark, texts).limit(0), bench).count() == 0


# Pipeline


def keyed(rows, *columns):
    return sorted((tuple(repr(r[c]) for c in columns) for r in rows))


def test_pipeline_keeps_odd_rows_and_clashing_columns(spark, tmp_path):
    import corpus_pipeline

    texts = [f"plain words of document {i} " + " ".join(f"d{i}w{j}" for j in range(30)) for i in range(30)] + [None, "", "x " * 20_000, "!!"]
    df = docs(spark, texts, [f"s{i % 12}" for i in range(len(texts))])
    df = df.unionByName(df.where("doc_id in (3, 5)")).unionByName(spark.createDataFrame([(3, "another text of the same id " + words(40), "en", "s1", 9), (None, "no id " + words(30, 900), "en", None, None)], DOCS))
    for c in ("score", "lines_removed", "class_id", "id", "key", "text_col", "count", "ids"):
        df = df.withColumn(c, F.lit(c))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, words(25, 2)), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    stages, frame = dict(corpus_pipeline.STAGES), spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert keyed(stages["quality"](spark, frame, str(tmp_path)).collect(), *frame.columns) == keyed(frame.collect(), *frame.columns)
    assert keyed(stages["lines"](spark, frame, str(tmp_path)).collect(), *frame.columns) == keyed(frame.collect(), *frame.columns)
    near = stages["near_duplicates"](spark, frame, str(tmp_path))
    want = {(i, t) for i, t in enumerate(texts)} | {(3, "another text of the same id " + words(40)), (None, "no id " + words(30, 900))}
    assert near.columns == frame.columns and {(r.doc_id, r.text) for r in near.collect()} == want and near.count() == len(want)
    clean = stages["decontamination"](spark, frame, str(tmp_path)).collect()
    assert {r.doc_id for r in clean} == {None, *range(len(texts))} - {3}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == {None, *range(len(texts))} - {3}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame.limit(0), str(tmp_path)).count() == 0, name


def test_pipeline_stages_by_plain_versions(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(12)
    line, item = "this boilerplate line is on very many sites", words(30, 5000)
    texts = [f"own {i} " + " ".join(f"v{i}x{j}" for j in range(rng.integers(30, 90))) + (f"\n{line}" if i % 2 else "") for i in range(40)]
    texts += [texts[3].replace("x4 ", "y4 "), texts[6], "before " + item + " after " + words(20, 7000)]
    frame = docs(spark, texts, [f"s{i % 11}" for i in range(len(texts))])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    lines_out = stages["lines"](spark, frame, str(tmp_path)).orderBy("doc_id").collect()
    plain = [t if i <= 1 else t.replace(f"\n{line}", "") for i, t in enumerate(texts)]
    assert [r.text for r in lines_out] == plain and [r.n_chars for r in lines_out] == list(map(len, plain))
    hashes = near_duplicates.WordHashes()
    k = [near_duplicates.kmers(t, hashes) for t in texts]
    copies = {i for i in range(len(texts)) for j in range(i) if near_duplicates.alignment_similarity(k[j], k[i])}
    assert copies >= {40, 41} and {r.doc_id for r in stages["near_duplicates"](spark, frame, str(tmp_path)).collect()} == set(range(len(texts))) - copies
    assert {r.doc_id for r in stages["decontamination"](spark, frame, str(tmp_path)).collect()} == set(range(42))
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    assert {r.doc_id: r.ids for r in stages["sentencepiece"](spark, frame, str(tmp_path)).collect()} == {i: library.encode(t) for i, t in enumerate(texts)}


@needs_tables
def test_pipeline_stages(spark):
    import corpus_pipeline

    frame = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id for r in frame.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, SF)
        if name != "sentencepiece":
            assert out.columns == frame.columns
        after = {r.doc_id for r in out.select("doc_id").collect()}
        assert after and after <= before
        frame, before = out, after
    assert "ids" in frame.columns and json.dumps(sorted(frame.columns))
