"""The training-data operators against plain Python and against the SQL that expresses them, on small texts with odd cases."""

from __future__ import annotations

import hashlib
import json
import random
import zlib

import numpy as np
import pytest
from conftest import DATA, same_rows
from pyspark.sql import functions as F

from quarry.llm import bpe, decontaminate, langid, mainhtml, minhash, quality, repeats, substring, suffixdedup, topk
from quarry.llm.graph import components
from quarry.llm.queries import ORACLE_SQL, QUERIES

DOC = "doc_id long, text string, lang string, source string, n_chars long, kept string, body string"


def documents(spark, texts):
    """Rows with nulls beside them and columns whose names the operators use inside."""
    rows = [(i, t, None, "s", None if t is None else len(t), "own", "own") for i, t in texts]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def odd(spark):
    """Copies, near copies, shared passages, repetition, ties, nulls, empty and long texts."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base, long = text(70), text(200), text(6000)
    near = base.split()
    texts = [(1, base), (2, base), (3, None), (4, ""), (5, "  \n\t "), (6, "one"), (7, "one two"), (8, "One  two"), (9, text(30) + " " + passage + " " + text(20))]
    texts += [(10, text(15) + "\n" + passage), (11, long), (12, long[:20000] + " " + text(40)), (13, "ab " * 300), (14, "x " + "ab " * 200), (15, "a" * 500), (16, "b" + "a" * 300)]
    for i in range(20, 40):
        copy = list(near)
        copy[i] = "changed" + str(i)
        texts.append((i, " ".join(copy)))
    texts += [(50, "ÀÉ straße 中文 " * 40), (51, "ÀÉ straße 中文 " * 41), (1, base), (None, base), (None, text(60)), (60, passage)]
    rng.shuffle(texts)
    return texts


@pytest.fixture
def small_batches(monkeypatch):
    monkeypatch.setattr(repeats, "BATCH_BYTES", 3000)


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (9, 9), (7, 3), *[(100, i) for i in range(101, 160)], (159, 4)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys((1, 2, 3, 7), 1), **dict.fromkeys((4, 5, *range(100, 160)), 4)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, DATA), duck.sql(ORACLE_SQL[name]))


# decontamination


def brute_marks(text, items, window=13):
    words = decontaminate.words_of(text.encode() if text is not None else None)
    marks, found = bytearray(len(words)), set()
    for name, item in items:
        w = decontaminate.words_of((item or "").encode())
        for piece in [w[i : i + window] for i in range(len(w) - window + 1)] if len(w) >= window else [w] if w else []:
            for at in range(len(words) - len(piece) + 1):
                if words[at : at + len(piece)] == piece:
                    marks[at : at + len(piece)] = b"\x01" * len(piece)
                    found.add(name)
    return marks, found


def brute_hits(text, items, window=13):
    marks, found = brute_marks(text, items, window)
    return len(marks), sum(marks), sorted(str(n) for n in found if n is not None)


@pytest.mark.parametrize("block_words", [400_000, 60])
def test_decontaminate(spark, odd, block_words):
    passage = next(t for i, t in odd if i == 60)
    items = [(1, passage), (10, passage.upper()[:200]), (2, "one two"), (3, "two"), (4, None), (5, ""), (None, "ab ab"), (6, "never seen words"), (7, "a " * 20)]
    docs, bench = documents(spark, odd), spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.benchmark_hits(docs, bench, block_words=block_words).collect()
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, list(r.items)) for r in rows)
    assert got == sorted((str(i), *brute_hits(t, items)) for i, t in odd)
    clean = decontaminate.decontaminate(docs, bench, block_words=block_words)
    assert clean.columns == docs.columns
    expected = sorted(str(i) for i, t in odd if not (lambda n, h, _: h > 0 and 20 * h >= n)(*brute_hits(t, items)))
    assert sorted(str(r.doc_id) for r in clean.collect()) == expected
    assert decontaminate.benchmark_hits(docs.limit(0), bench).count() == 0
    assert decontaminate.benchmark_hits(docs, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


# near duplicates


def brute_near(texts, width=3, similar=85):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().translate(minhash._LOWER).split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}
    ids = [i for i in sets if i is not None and sets[i]]
    changed = True
    links = [(a, b) for a in ids for b in ids if a < b and 100 * len(sets[a] & sets[b]) >= similar * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            least = min(root[a], root[b])
            changed |= root[a] != least or root[b] != least
            root[a] = root[b] = least
    return {i: (len(sets[i]), root[i]) for i in sets if i is not None}


@pytest.mark.parametrize("block", [512, 4])
def test_near_duplicates(spark, odd, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = minhash.near_duplicates(documents(spark, odd)).collect()
    assert len(rows) == len(odd)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None} == brute_near(odd)
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows if r.doc_id is not None)


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(documents(spark, [])).count() == 0
    assert minhash.near_duplicates(documents(spark, [(1, None), (2, "")])).where("kept").count() == 2


# substrings


def brute_windows(texts, unit, width):
    least: dict = {}
    key = lambda i: float("inf") if i is None else i
    for i, t in texts:
        x = unit(t)
        for s in range(len(x) - width + 1):
            w = tuple(x[s : s + width])
            least[w] = min(key(i), least.get(w, float("inf")))
    out = []
    for i, t in texts:
        x = unit(t)
        gone = [False] * len(x)
        for s in range(len(x) - width + 1):
            if least[tuple(x[s : s + width])] < key(i):
                gone[s : s + width] = [True] * width
        out.append((i, x, gone))
    return out


def test_substring(spark, odd, small_batches):
    rows = substring.removed_words(documents(spark, odd)).collect()
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in rows)
    expected = brute_windows(odd, lambda t: (t or "").encode().split(), 50)
    assert got == sorted((str(i), len(x), sum(g), b" ".join(w for w, y in zip(x, g) if not y).decode()) for i, x, g in expected)
    assert substring.removed_words(documents(spark, [])).count() == 0


def test_dedup_substrings_keeps_columns(spark, odd):
    docs = documents(spark, odd)
    out = substring.dedup_substrings(docs)
    assert out.columns == docs.columns and out.count() == len(odd)
    assert out.where("doc_id = 5").first().text == "  \n\t "
    assert {r.kept for r in out.collect()} == {"own"}


@pytest.mark.parametrize("least", [1, 4, 50])
def test_longest_previous_factors(least):
    rng = np.random.default_rng(6)
    for _ in range(30):
        text = rng.integers(97, 99, size=90).astype(np.uint8)
        if rng.random() < 0.3:
            text[:] = 97
        starts = np.sort(rng.choice(41, size=20, replace=False))
        ids = rng.integers(0, 6, size=20)
        order, common = suffixdedup.suffix_order(text, starts, ids)
        suffix = [bytes(text[a : a + 50]) for a in starts]
        assert [suffix[i] for i in order] == sorted(suffix)
        shared = lambda a, b: next((k for k in range(50) if a[k] != b[k]), 50)
        assert [0, *[shared(suffix[i], suffix[j]) for i, j in zip(order, order[1:])]] == common.tolist()
        expected = [max((shared(a, b) for b, other in zip(suffix, ids) if other < own), default=0) for a, own in zip(suffix, ids)]
        found = suffixdedup.longest_previous(order, common, ids, least).tolist()
        assert all(f == e or (f < least and e < least) for f, e in zip(found, expected))


@pytest.mark.parametrize("heavy", [1 << 16, 8])
def test_suffix(spark, odd, small_batches, monkeypatch, heavy):
    monkeypatch.setattr(suffixdedup, "HEAVY", heavy)
    rows = suffixdedup.removed_bytes(documents(spark, odd)).collect()
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows)
    expected = []
    for i, x, g in brute_windows(odd, lambda t: (t or "").encode(), 50):
        spans = sum(y and not z for y, z in zip(g, [False, *g]))
        expected.append((str(i), len(x), sum(g), spans, bytes(c for c, y in zip(x, g) if not y)))
    assert got == sorted(expected)
    assert suffixdedup.removed_bytes(documents(spark, [])).count() == 0


# main text


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="ad">Buy this now, it is cheap.</div>
<article><header><h1>Caf&eacute; &amp; bar</h1></header><p>First <b>bold</b>&nbsp;words,<br>and more of them here.<p>Second   one
 with a <a href="x">link</a> in it.<ul><li>item one</li><li>item two</li></ul><div class="newsletter-signup">Subscribe!</div></article>
<div class="sidebar">Side text that is long enough to look like an article to some.</div><section id="comments"><p>I disagree.</p></section>
<form><label>Name</label></form><div role="alert">We use cookies.</div><footer>&copy; us</footer></body></html>"""


def test_main_text():
    assert mainhtml.main_text(PAGE) == "Café & bar\nFirst bold words, and more of them here.\nSecond one with a link in it.\nitem one\nitem two"
    assert [mainhtml.main_text(x) for x in (None, "", "<p></p>", "plain", "<p>a<!-- b", "<p title='x>a")][:4] == ["", "", "", "plain"]
    assert mainhtml.main_text("<div>" * 5000 + "deep") == "deep"
    body = "".join(f"<p>{'word ' * 30}{i}</p>" for i in range(5))
    assert mainhtml.main_text(f"<body><div class=menu>x y z</div><div><h2>Head line of it</h2><div>{body}</div></div></body>").count("\n") == 5


def plain_sums(page):
    """Density sums by a second, recursive way: a list of (tag, density, sum) of the nodes that are not left out."""
    import math

    root, nodes = mainhtml.parse(page)
    mainhtml.weigh(nodes)  # for what is left out
    bare = lambda s: len("".join(s.split()))
    kids = lambda n: [c for c in n.parts if not isinstance(c, str) and not c.out]
    below = lambda n: [d for c in kids(n) for d in (c, *below(c))]
    text = lambda n: sum(bare(c) for c in n.parts if isinstance(c, str))
    linked = lambda n: any(up.tag == "a" for up in chain(n))
    chain = lambda n: [n, *chain(n.parent)] if n.parent is not None else [n]
    chars = lambda n: sum(map(text, (n, *below(n))))
    in_links = lambda n: sum(text(d) for d in (n, *below(n)) if linked(d))
    body = next((n for n in nodes if n.tag == "body"), root)
    ratio = in_links(body) / max(1, chars(body))

    def density(c, t, lc, lt):
        if not c:
            return 0
        base = max(2, math.log(c * lc / max(1, c - lc) + ratio * c + math.e))
        return c / max(1, t) * math.log(max(1, c * max(1, t) / (max(1, lc) * max(1, lt))), base)

    of = lambda n: density(chars(n), len(below(n)), in_links(n), sum(d.tag == "a" for d in below(n)))
    out = []
    for n in nodes:
        if not n.out:
            own = density(text(n), 1, text(n) * linked(n), int(linked(n)))
            out.append((n, of(n), own + sum(map(of, kids(n)))))
    return out


PROSE = " ".join(f"Sentence number {i} of this text says something at some length." for i in range(12))


def test_density_sums(spark):
    pages = [r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").where("html is not null").orderBy("page_id").limit(12).collect()]
    pages += [PAGE, f"<body><div>{PROSE}<a href=x>link one</a></div><ul><li><a>a</a><li><a>bb</a></ul></body>", "only text", "<p>a<p>b</p></div></x>"]
    for page in pages:
        sums = plain_sums(page[:20000])
        for node, density, total in sums:
            assert np.isclose(node.density, density) and np.isclose(node.total, total)
        best = max(total for _, _, total in sums)
        _, nodes = mainhtml.parse(page[:20000])
        mainhtml.weigh(nodes)
        assert np.isclose(mainhtml.centre_of(nodes).total, best)


def test_nothing_of_the_centre_is_lost():
    links = "".join(f"<li><a href=/{i}>Reference {i}</a></li>" for i in range(3))
    table = '<div class="share-price-table"><table><tr><td>12.5</td><td>13.5</td></tr></table></div>'
    found = '<div class="search-results-text">Four results were found.</div>'
    body = f"<h1>Head</h1><p>{PROSE}</p>{table}<p>{PROSE}</p>{found}<ul>{links}</ul>"
    expected = ["Head", PROSE, "12.5 13.5", PROSE, "Four results were found.", "Reference 0", "Reference 1", "Reference 2"]
    menu = "<nav><ul>" + links + "</ul></nav>"
    for page in (
        f"<body>{menu}<article>{body}</article><footer>Us</footer></body>",
        f'<body>{menu}<div id="content">{body}</div><div class="site-footer">Us</div></body>',
        f'<body><div class="page-with-sidebar"><form>{menu}<main>{body}</main></form></div></body>',
        f'<body>{menu}{body}<div class="post-comments-list"><p>I disagree with all of it.</p></div></body>',
    ):
        assert mainhtml.main_text(page).split("\n") == expected


def test_pages_without_article_markup():
    """Density finds the text; a list of links and a short unmarked notice beside it stay out, a second section comes in."""
    links = "".join(f"<li><a href=/{i}>Other page {i}</a></li>" for i in range(20))
    sections = f"<div><h2>One</h2><p>{PROSE}</p><p>{PROSE}</p></div><div><h2>Two</h2><p>{PROSE}</p></div>"
    page = f"<body><div><ul>{links}</ul></div><div><h1>Title</h1><div>{sections}</div></div><div><span>Top</span></div></body>"
    assert mainhtml.main_text(page).split("\n") == ["Title", "One", PROSE, PROSE, "Two", PROSE]
    assert mainhtml.main_text(f"<div>{PROSE}<br><br>{PROSE}</div><div><a href=x>back</a></div>") == f"{PROSE} {PROSE}"


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", "")], "page_id long, url string, html string")
    rows = mainhtml.extract(pages).collect()
    assert sorted(r.n_chars for r in rows) == sorted([0, 0, *[len(mainhtml.main_text(PAGE))] * 2])
    assert mainhtml.extract(pages.limit(0)).count() == 0
    clashing = pages.selectExpr("*", "'own' as id", "'own' as text", "'own' as n_chars")
    assert mainhtml.extract(clashing).columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(r.text for r in mainhtml.extract(clashing).collect()) == sorted(r.text for r in rows)


def test_deep_and_long_pages():
    assert mainhtml.main_text("<div>" * 30000 + "deep" + "</b></p></x>" * 30000) == "deep"
    assert mainhtml.main_text("<b>" * 20000 + "".join(f"<p>{i} x" for i in range(3000))).count("\n") == 2999
    assert len(mainhtml.main_text(f"<p>{PROSE * 2000}</p>")) == len(PROSE * 2000)


# top k


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 30)
    monkeypatch.setattr(topk, "HOME", 40)
    monkeypatch.setattr(topk, "QUERIES", 3)
    monkeypatch.setattr(topk, "BLOCK", 4)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6).round(1)], 0) for i in range(160)]
    rows += [(200, None, 0), (201, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (202, [float("nan")] * 6, 0), (203, [float("inf")] * 6, 0), (None, [1.0] * 6, 0), (220, [1.0], 0), (240, [], 0), rows[20], rows[33]]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score long"), F.col("vec_id") % 20 == 0, k=7).collect()
    ints = {i: tuple(int(np.floor(64 * x)) for x in v) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    expected = []
    for q in (i for i in ints if i % 20 == 0):
        scores = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q)
        expected += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:7])]
    assert sorted(tuple(r) for r in found) == sorted(expected)
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).count() == 0


def brute_top(rows, k):
    clamp = lambda x: max(-(2**63), min(2**63 - 1, x))
    ints = sorted({(i, tuple(clamp(int(np.floor(64.0 * x))) for x in v)) for i, v in rows})
    out = []
    for q, a in (r for r in ints if r[0] % 20 == 0):
        scores = sorted((-clamp(sum(x * y for x, y in zip(a, v))), i) for i, v in ints if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("largest", [1e6, 1e7, 1e16, 1e30])
def test_top_k_of_large_components(spark, monkeypatch, largest):
    """Sums beyond doubles, beyond 64 bits, and components beyond 64 bits."""
    monkeypatch.setattr(topk, "HOME", 30)
    monkeypatch.setattr(topk, "BLOCK", 4)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.uniform(-largest, largest, size=64)]) for i in range(60)]
    found = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    assert sorted(tuple(r) for r in found) == brute_top(rows, 20)
    assert len(found) == 60


@pytest.mark.parametrize("chain", [1, 64])
def test_top_k_of_equal_vectors(spark, monkeypatch, chain):
    for name, value in (("HOME", 50), ("CANDIDATES", 16), ("BLOCK", 4), ("QUERIES", 3), ("CHAIN", chain)):
        monkeypatch.setattr(topk, name, value)
    same = [(i, [0.5, -0.25, 1.0]) for i in range(300)] + [(i, [0.0, 0.0, 0.0]) for i in range(300, 340)] + [(i, [-1.0, 0.5, 3.0 * i]) for i in range(340, 362)]
    docs = spark.createDataFrame([(i, v, "x", "y") for i, v in same], "vec_id long, embedding array<double>, vector string, part string")
    found = topk.top_k(docs, F.col("vec_id") % 20 == 0, k=7).collect()
    assert sorted(tuple(r) for r in found) == brute_top(same, 7)


def test_top_k_of_split_joins(spark):
    """Adaptive execution may split a chain over many tasks: their answers are merged before they become floors."""
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=40)]) for i in range(600)]
    skew = "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.adaptive.skewJoin.skewedPartitionFactor", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.autoBroadcastJoinThreshold"
    try:
        for name, value in zip(skew, ("1k", "1.01", "1k", "-1")):
            spark.conf.set(name, value)
        docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(40)
        found = topk.top_k(docs, F.col("vec_id") % 20 == 0, k=5).collect()
    finally:
        for name in skew:
            spark.conf.unset(name)
    assert sorted(tuple(r) for r in found) == brute_top(rows, 5)


# language, quality


def test_langid(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = QUERIES["op8_langid"](spark, DATA).join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in held]) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_langid_odd_texts(spark):
    train = spark.createDataFrame([("der die und das nicht", "de"), ("the and of that with", "en"), ("zzz", None)], "text string, lang string")
    docs = documents(spark, [(1, None), (2, ""), (3, "123 !!"), (4, "the and that"), (5, "UND das"), (None, "with")])
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, langid.learn(train)).collect()}
    assert got == {1: "und", 2: "und", 3: "und", 4: "en", 5: "de", None: "en"}
    nothing = langid.learn(train.limit(0))
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}
    assert langid.predict(docs.limit(0), nothing).count() == 0


def test_quality_held_out(spark):
    path = DATA.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{path}/labels.parquet").select("doc_id", "quality").distinct()
    rows = QUERIES["op9_quality"](spark, path).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    assert np.mean([a > b for a in good for b in bad]) >= 0.95
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.9


def test_quality_odd_texts(spark, odd):
    docs = documents(spark, odd)
    labels = spark.createDataFrame([(1, 1), (1, None), (9, 1), (13, 0), (999, 1), (None, 1)], "doc_id long, quality int")
    rows = quality.score(docs, quality.learn(docs, labels)).collect()
    assert len(rows) == len(odd) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.score(docs, quality.learn(docs, labels.limit(0))).collect()} == {0.5}
    assert quality.score(docs.limit(0), quality.learn(docs, labels)).count() == 0
    assert {r.score for r in quality.score(docs, quality.learn(docs.limit(0), labels)).collect()} == {0.5}
    clashing = docs.withColumn("key", F.lit("own")).withColumn("id", F.lit("own")).withColumn("score", F.lit("own"))
    assert quality.score(clashing, quality.learn(clashing, labels)).count() == len(odd)


def test_quality_samples_hold_an_id_once(spark):
    docs = spark.createDataFrame([(7, f"copy {i}") for i in range(1000)] + [(i, f"text {i}") for i in range(8, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1)] * 1000 + [(8, 1), (9, 0), (None, 1)], "doc_id long, quality int")
    rows = quality.samples(docs, labels).groupBy("key", "id").count().collect()
    assert {r["count"] for r in rows} == {1}
    assert sorted(r.id for r in rows if r.key == 1) == [7, 8] and len(rows) == 2 + 53
    assert quality.samples(docs, labels, positives=1, unlabelled=10).count() == 11


def test_quality_risk_and_prior():
    """The risk against sums written out, its slope against differences, the decision against all cuts, and the prior of known mixtures."""
    rng = np.random.default_rng(4)
    p, u, prior = rng.normal(1, 1, 40), rng.normal(0, 1, 60), 0.4
    loss = lambda z: np.log(1 + np.exp(-z))
    first, second = quality.non_negative_risk(p, u, prior)
    assert np.isclose(first, prior * sum(map(loss, p)) / 40)
    assert np.isclose(second, sum(loss(-z) for z in u) / 60 - prior * sum(loss(-z) for z in p) / 40)
    zero_one = lambda c: prior * np.mean(p < c) + max(0, np.mean(u >= c) - prior * np.mean(p >= c))
    assert np.isclose(zero_one(quality.decision(p, u, prior)), min(map(zero_one, p)))

    texts = lambda n, words: [" ".join(rng.choice(words, size=30)).encode() for _ in range(n)]
    good, bad = [f"good{i}" for i in range(200)], [f"bad{i}" for i in range(200)]
    hashes = quality._Hashes()
    positive = quality.Rows.of(texts(600, good), hashes)
    for share in (0.3, 0.8):
        mixed = quality.Rows.of(texts(int(1500 * share), good) + texts(1500 - int(1500 * share), bad), hashes)
        edges = np.quantile(mixed.style, np.linspace(0, 1, quality.BINS + 1)[1:-1], axis=0).T
        assert abs(quality.estimate_prior(quality.design(edges, positive), quality.design(edges, mixed)) - share) < 0.06
        model = quality.fit(positive, mixed)
        found = model.score(quality.Rows.of(texts(100, good) + texts(100, bad), hashes)) >= quality.THRESHOLD
        assert found[:100].mean() > 0.95 and found[100:].mean() < 0.05


# BPE


def test_bpe_equals_the_library(spark, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_vocab())
    rng = random.Random(3)
    alphabet = "abcdefgh'stTHE  \n\t!?1290éÉßΣσς̸́İ中文字ﬁ😀\x1c\x85\xa0 ½²"
    texts = [t for _, t in odd] + ["a<|endoftext|>b <|startoftext|>", "<|endoftext|", "𖺰𛟴x"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(800)]
    texts += ["".join(chr(rng.choice([rng.randint(1, 0x250), rng.randint(1, 0xD7FF), rng.randint(0xE000, 0x1FFFF)])) for _ in range(25)) for _ in range(300)]
    docs = documents(spark, list(enumerate(texts)))
    got = {r.doc_id: r for r in bpe.encode(docs, bpe.default_vocab()).collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(got[i].ids), "<u4").tolist() == ids
        assert got[i].decoded == library.decode(ids, skip_special_tokens=False)
        assert got[i].n_tokens == len(ids)
    again = bpe.decode(bpe.encode(docs, bpe.default_vocab()).withColumnRenamed("decoded", "first"), bpe.default_vocab())
    assert again.where("first <> decoded").count() == 0
    assert bpe.encode(docs.limit(0), bpe.default_vocab()).count() == 0


def test_bpe_words_against_plain_merging():
    coder = bpe.TrieBPE(json.load(open(bpe.default_vocab(), encoding="utf-8")))
    rng = random.Random(5)
    words = {coder._word("".join(rng.choice("abcdeinorst") for _ in range(rng.randint(1, 14)))) for _ in range(2000)}
    for word, tokens in coder.encode_words(words).items():
        assert tokens == coder.merged(word)


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    lettered = [(i, t) for i, t in texts if t is not None and any(c.isalpha() for c in t)]
    near = brute_near(lettered, width=5, similar=80)  # the rule of near-duplicate stages
    first = [(i, t) for i, t in lettered if near[i][1] == i]
    cut = [(i, " ".join(w.decode() for w, y in zip(x, g) if not y) if any(g) else t) for (i, t), (_, x, g) in zip(first, brute_windows(first, lambda t: t.encode().split(), 50))]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    clean = []
    for i, t in cut:
        marks, _ = brute_marks(t, items)
        if not (sum(marks) > 0 and 20 * sum(marks) >= len(marks)):
            spans = [s for s in decontaminate.spans_of(marks) if s[1] - s[0] >= 13]
            clean.append((i, decontaminate.without_spans(t.encode(), spans).decode()))
    rows = pipeline.run(spark, DATA).collect()
    assert sorted(r.doc_id for r in rows) == sorted(i for i, _ in clean)
    coder = bpe.TrieBPE(json.load(open(bpe.default_vocab(), encoding="utf-8")), bpe.newer_characters(bpe.default_vocab()))
    coded = {i: x for (i, _), x in zip(clean, coder.encode([t for _, t in clean]))}
    assert all(bytes(r.ids) == coded[r.doc_id][0] and r.decoded_sha256 == hashlib.sha256(coded[r.doc_id][1]).hexdigest() for r in rows)
    assert [name for name, _ in pipeline.STAGES] == ["language", "near_duplicates", "substrings", "benchmarks", "tokens"]
