"""Language, toxicity, personal data, HTML, decontamination, top-k."""

import html
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quadrille.llm import decontaminate, htmltext, langid, pii, topk, toxicity

# ---- language ----


def test_gradient_is_that_of_the_loss():
    net = langid.Reader(3, seed=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(97, 110, (4, 5)), np.array([0, 1, 2, 1])
    x[2, 3:] = langid.PAD
    loss = lambda: -sum(np.log(p[np.arange(4), y])[x[:, t] != langid.PAD].sum() for t, p in net.labels(x)) / (x != langid.PAD).sum()
    grad = net.gradient(x, y)
    for k in net.p:
        for _ in range(3):
            at = tuple(rng.integers(0, s) for s in net.p[k].shape)
            if k == "E":
                at = (int(x[0, 0]), at[1])
            old, step = net.p[k][at], 1e-3
            net.p[k][at] = old + step
            up = loss()
            net.p[k][at] = old - step
            down = loss()
            net.p[k][at] = old
            assert abs((up - down) / (2 * step) - grad[k][at]) < 2e-3, k


def test_language_on_held_out_documents(spark, sf_dir):
    from quadrille.llm import queries

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "n_chars")
    out = queries.op8_language(spark, sf_dir)
    rows = out.join(docs, "doc_id").filter("held_out").collect()
    right = [r.lang == r.lang_pred for r in rows]
    assert out.count() == docs.count() and np.mean(right) > 0.9
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark, documents, edges, nothing):
    train = documents([(i, t, "s", lang) for i, (t, lang) in enumerate([("der und die das nicht", "de"), ("the and of that with", "en")] * 20)])
    langs, net = langid.fit(train, steps=60)
    got = {r.doc_id: r for r in langid.predict(edges, langs, net).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and got[4].lang_pred in langs
    assert langid.predict(documents([(1, "12 34 !?")]), langs, net).first().lang_pred == "und"
    assert langid.predict(nothing, langs, net).count() == 0
    none, nil = langid.fit(nothing)
    assert none == [] and langid.predict(edges, none, nil).filter("lang_pred <> 'und'").count() == 0


GERMAN, ENGLISH = "der und die das nicht ein mit sich auf ", "the and of that with was for this from "


@pytest.fixture(scope="module")
def learned(documents):
    return langid.fit(documents([(i, t[i % 30 :] + t, "s", lang) for i in range(40) for t, lang in ((GERMAN, "de"), (ENGLISH, "en"))]), steps=150)


def test_pooling_is_the_mean_of_all_positions(learned):
    _, net = learned
    texts = [b"der und", b"", "straße the".encode() * 9, (ENGLISH * 30).encode()[:1000]]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    got = langid.sums(net, data, offsets)
    for text, have in zip(texts, got, strict=True):
        want = np.zeros(2)
        for s in range(0, len(text), langid.STRIDE):  # one window at a time, without pads
            a, b = max(0, s - langid.CONTEXT), min(len(text), s + langid.STRIDE + langid.CONTEXT)
            b = min(b, s + -(-min(len(text) - s, langid.STRIDE) // langid.STEP) * langid.STEP + langid.CONTEXT)
            of = dict(net.labels(np.frombuffer(text[a:b], np.uint8).astype(np.int64)[None]))
            want += sum((of[t][0] for t in of if s <= a + t < s + langid.STRIDE), np.zeros(2))
        assert np.allclose(have, want, atol=1e-2)
        assert abs(have.sum() - len(text)) < 0.05


def test_state_goes_on_across_words(learned):
    _, net = learned
    x = np.frombuffer(b"the and xq", np.uint8).astype(np.int64)[None]
    y = np.frombuffer(b"der und xq", np.uint8).astype(np.int64)[None]
    last = [dict(net.labels(v))[9][0] for v in (x, y)]
    assert np.abs(last[0] - last[1]).max() > 0.01


def test_texts_without_spaces_and_long_words(documents, learned):
    langs, net = learned
    rows = [(1, GERMAN.replace(" ", "") * 40), (2, ENGLISH.replace(" ", "") * 40), (3, "undnicht" * 12), (4, "thisfromthat" * 5), (5, "ü")]
    got = {r.doc_id: r for r in langid.predict(documents(rows), langs, net).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3, 4)] == ["de", "en", "de", "en"] and got[5].lang_pred in langs


def test_results_do_not_depend_on_the_batch(documents, learned):
    langs, net = learned
    texts = [(i, " ".join(f"the{j}und" for j in range(i * 7))) for i in range(1, 40)]
    a = {r.doc_id: r.score for r in langid.predict(documents(texts), langs, net).collect()}
    b = {r.doc_id: r.score for r in langid.predict(documents(texts[::-1]).repartition(7), langs, net).collect()}
    assert all(abs(a[k] - b[k]) < 1e-5 for k in a)


def test_sample_is_bounded_and_reads_no_other_columns(spark):
    docs = spark.createDataFrame([(i, "word " * 4000, f"l{i % 5}", 1, "x", "y", 2) for i in range(50)], "doc_id long, text string, lang string, _id long, _lang string, _known string, at int")
    rows = langid.sample(docs, docs=3, langs=2).collect()
    assert len({r.lang for r in rows}) == 2 and len({r.doc_id for r in rows}) == 6 and len(rows) <= 6 * langid.SAMPLE_WINDOWS and max(r["at"] for r in rows) > 18_000


def test_every_language_is_sampled_within_the_bound_of_rows(spark):
    docs = spark.createDataFrame([(i, f"w{i} word", f"l{i % 90}") for i in range(900)], "doc_id long, text string, lang string")
    per = Counter(r.lang for r in langid.sample(docs).select("lang", "doc_id").distinct().collect())
    assert len(per) == 90 and set(per.values()) == {10}
    few = Counter(r.lang for r in langid.sample(docs, rows=200).select("lang", "doc_id").distinct().collect())
    assert len(few) == 90 and set(few.values()) == {2}
    assert set(Counter(r.lang for r in langid.sample(docs, rows=5).collect()).values()) == {1}


def test_shares_of_languages_of_billions_of_documents(spark):
    n = 5_000_000_000
    rows = spark.createDataFrame([(0, n), (1030, n), (1031, n), (2**31 - 1, n), (2**31 - 1, 2400), (2**31 - 1, 2401)], "h long, n long")
    got = [r[0] for r in rows.select(langid.within_share(F.col("h"), F.col("n"), F.lit(2400))).collect()]
    assert got == [True, True, False, False, True, False]


# ---- toxicity ----


def test_noisy_or_learns_sentences_from_documents(spark, documents):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(400):
        sentences = [" ".join(rng.choice(words, 8)) for _ in range(6)]
        if i % 4 == 0:
            sentences[i % 6] += " scoundrel"
        rows.append((i, ". ".join(sentences) + "."))
        labels.append((i, int(i % 4 == 0)))
    docs = documents(rows)
    weights = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = toxicity.score(docs, weights).collect()
    assert all((r.score >= 0.3) == (r.doc_id % 4 == 0) for r in got)
    assert all(r.worst == r.doc_id % 6 for r in got if r.doc_id % 4 == 0)
    kept = toxicity.clean(docs, weights)
    assert kept.columns == docs.columns and kept.count() == 300


def test_toxicity_sample_is_taken_in_the_tasks(spark):
    from pyspark.sql import functions as F
    from pyspark.sql.window import Window

    labels = spark.range(9000).selectExpr("id doc_id", "cast(id % 3 = 0 as int) toxic")
    out = toxicity.sampled(labels, 2500)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("TakeOrderedAndProject") >= 2
    first = F.row_number().over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id"))
    want = labels.withColumn("n", first).filter("n <= 2500").select("doc_id", "toxic").collect()
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want))


def test_toxicity_edges(spark, documents, edges, nothing):
    weights = toxicity.train(edges, spark.createDataFrame([(4, 1), (5, 0), (7, None), (None, 1)], "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(edges, weights).collect()}
    assert got[1].score == got[2].score == got[3].score == 0 and got[1].worst is None
    assert toxicity.score(nothing, weights).count() == 0 and toxicity.clean(nothing, weights).count() == 0
    assert toxicity.clean(edges.filter("doc_id < 4"), weights).count() == 3


# ---- personal data ----

KINDS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(int(c) * 2, 10)) if k % 2 else int(c) for k, c in enumerate(digits[::-1])) % 10 == 0


def brute_spans(text):
    out = []
    for kind, pattern in KINDS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")[:4]) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda x: (x[1], list(KINDS).index(x[0])))


def test_base_spans_are_those_of_the_patterns():
    rng = np.random.default_rng(2)
    pieces = ["a", "b.c", "@", "@@", ".", "-", "+", " ", "1", "12", "255", "256", "0", "4111 1111 1111 1111", "+31 (20) 123-4567", "x@y.org", "1.2.3.4", "1.2.3.4.5", "é", "ab@c", "+", "%", "\n", "..", "00001"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces, rng.integers(1, 14)))
        base = [x for x in [(s["kind"], s["start"], s["end"]) for s in pii.find(text)] if x[0] in pii.BASE]
        assert base == brute_spans(text), text


def test_linear_in_hostile_texts():
    for text in ("a" * 300_000 + "@", "a@" * 100_000, "1" * 300_000, "1." * 100_000, "+" * 100_000, "+1" + ")" * 300_000, "1 " * 150_000, "a1" * 200_000, "1" * 200_000 + "a", "1-" * 150_000):
        pii.find(text)


def test_further_kinds_need_checksum_or_context():
    kinds = lambda t: [s["kind"] for s in pii.find(t)]
    assert kinds("IBAN GB82 WEST 1234 5698 7654 32 ok") == ["iban"] and kinds("IBAN GB83 WEST 1234 5698 7654 32") == []
    assert kinds("my ssn is 123-45-6789") == ["ssn"] and kinds("part 123-45-6789") == []
    assert kinds('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"') == ["secret"] and kinds("commit 04dbebab91ab85687d33eeaaf9ac699e1188f962") == []
    assert kinds("my password: abcdefghijklmnopqr") == [] and kinds("API key 12345678901234567890") == []
    assert pii.score("call me +31201234567", "phone", 8, 20) > pii.score("xx +31201234567", "phone", 3, 15)


def test_pii_edges(spark, edges, nothing):
    got = {r.doc_id: r for r in pii.digest(pii.find_pii(edges)).collect()}
    assert got[1].spans == "" and got[1].n_email == 0 and got[1].base_sha256 == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert pii.digest(pii.find_pii(nothing)).count() == 0


# ---- HTML ----

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><p>Site name and motto, all of it.</p></header><nav><ul><li><a href="/">Home</a></li><li><a>News</a></li></ul></nav>
<div class="cookie-notice">We use cookies &amp; more. Accept, please.</div>
<article><h1>A   title</h1><p>First &amp; best paragraph,\n with <b>bold</b> text, and commas.<p>Second one<br>goes on, at length, here.</p>
<aside>See also, this, and that.</aside><form>Name <input> please, now.</form><p>Short.</p></article>
<div id="comments"><p>I think this is a long comment, by a reader, with commas.</p></div>
<div class="ad">Buy now, all of it, today.</div><footer>&copy; someone</footer></body></html>"""


def test_main_text():
    weights = htmltext.learn([PAGE] * 3)
    assert htmltext.main_text(PAGE, weights) == "A title\nFirst & best paragraph, with bold text, and commas.\nSecond one goes on, at length, here.\nShort."


def test_learns_without_named_containers():
    weights = htmltext.learn([PAGE] * 20)
    plain = "<div><a href=x>Home</a></div><div><a href=x>News</a></div>" + "<div><p>" + "</p><p>".join(f"Long paragraph number {i}, with words, and more words, to read. It ends here." * 3 for i in range(5)) + "</p></div><div><a>Imprint</a></div>"
    text = htmltext.main_text(plain, weights)
    assert text.count("\n") == 4 and "Home" not in text and "Imprint" not in text


LONG = "One long paragraph, with words, and more of them, to read. " * 4


def test_names_do_not_decide_alone():
    weights = htmltext.learn([PAGE] * 20)
    text = lambda h: htmltext.main_text(h, weights).split("\n")
    assert text(f'<div class="has-sidebar"><article><p>{LONG}<p>Short.</article></div>') == [LONG.strip(), "Short."]
    assert text(f'<article><p>{LONG}</p><div class="share-price widget">The price rose, by two percent.</div><p>{LONG}</p></article>') == [LONG.strip(), "The price rose, by two percent.", LONG.strip()]
    assert text(f'<article><p>{LONG}</p><div class="ad">{LONG}</div><p>{LONG}</p></article>') == [LONG.strip()] * 2
    assert text(f'<main><p>{LONG}</p><section id="comments"><article class="comment"><p>{LONG}</p></article></section></main>') == [LONG.strip()]
    assert text(f'<div id="main-nav"><p>{LONG}</p></div><div class="post-header"><h1>Title</h1></div><article><p>{LONG}</p></article>')[-1] == LONG.strip()


def test_void_and_unclosed_elements_drop_nothing_else():
    weights = htmltext.learn([PAGE] * 20)
    for odd in ("<svg width=1 />", '<iframe src="x"/>', "<button>", "<select>", "<object data=x>", "<title>", "<noscript>"):
        assert htmltext.main_text(f"<article><p>{LONG}</p>{odd}<p>After {LONG}</p></article>", weights).endswith("After " + LONG.strip())
    assert "Share" not in htmltext.main_text(f"<article><p>{LONG}<button>Share</button> it</p></article>", weights)
    for hostile in ("<button>" * 20000, "<svg " * 20000, '<button "' * 5000, "<title><" * 9000):
        htmltext.blocks(hostile)


def test_cut_decides_where_evidence_is_weak(sf_dir):
    """Without any tags or names that tell: words of the article found, and blocks where the cut overrules the classifier."""
    pages = pq.read_table(f"{sf_dir.replace('0.001', '0.01')}/pages.parquet").column("html").to_pylist()
    weights = htmltext.learn(pages[:100])
    right = found = wanted = overruled = 0
    for page in pages[100:]:
        bare = re.sub(r"\s(class|id|role)=(\"[^\"]*\"|\S+?)(?=[\s>])", "", re.sub(r"<(/?)(nav|article|footer|aside|main|header)\b[^>]*>", r"<\1div>", page))
        got = Counter(htmltext.main_text(bare, weights).split())
        want = Counter(html.unescape(re.sub(r"<[^>]*>", " ", re.search(r"<article>(.*)</article>", page, re.S)[1])).split())
        right, found, wanted = right + sum((got & want).values()), found + sum(got.values()), wanted + sum(want.values())
        gain, edges = htmltext.graph_of(htmltext.blocks(bare), weights)
        overruled += sum((g > 0) != keep for g, keep in zip(gain, htmltext.content_side(gain, edges)))
    assert right / found > 0.97 and right / wanted > 0.97 and overruled > 0


def brute_cut(gain, edges):
    best = None
    for mask in range(1 << len(gain)):
        keep = [mask >> i & 1 for i in range(len(gain))]
        cost = sum(max(g, 0) for g, k in zip(gain, keep) if not k) + sum(max(-g, 0) for g, k in zip(gain, keep) if k) + sum(c for a, b, c in edges if keep[a] != keep[b])
        best = cost if best is None else min(best, cost)
    return best


def test_minimum_cut():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 9))
        gain = rng.normal(0, 2, n).tolist()
        edges = [(int(a), int(b), float(c)) for a, b, c in zip(rng.integers(0, n, 12), rng.integers(0, n, 12), rng.random(12)) if a != b]
        keep = htmltext.content_side(gain, edges)
        cost = sum(max(g, 0) for g, k in zip(gain, keep) if not k) + sum(max(-g, 0) for g, k in zip(gain, keep) if k) + sum(c for a, b, c in edges if keep[a] != keep[b])
        assert abs(cost - brute_cut(gain, edges)) < 1e-6


def test_html_edges(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<p>plain, simple text without any container. It has, however, commas."), (3, None, "<p>plain, simple text without any container. It has, however, commas."), (4, "u", "<" * 5000 + '<a "' * 500), (None, "u", "<script>x")]
    pages = spark.createDataFrame([(*r, "c", 7, "x") for r in rows], "page_id long, url string, html string, text string, _id long, _html string")
    got = htmltext.extract(pages).collect()
    assert len(got) == 6 and [r.text for r in got if r.page_id in (1, 2)] == ["", ""]
    assert htmltext.extract(pages.limit(0)).count() == 0


# ---- decontamination ----

ITEM = "Anna buys 12 apples and 7 pears for 45 dollars in Paris, then walks 3 miles home with Peter before noon."
FILLER = " ".join(f"word{i}" for i in range(300))


def test_leaks(spark, documents):
    bench = spark.createDataFrame([(1, ITEM), (2, "Short one"), (3, None), (4, "the quick brown fox jumps over the lazy dog again and again")], "item_id long, text string")
    other = ITEM.replace("12", "15").replace("7 pears", "9 pears").replace("Paris", "Rome").replace("Peter", "John").replace("Anna", "Maria")
    muddled = "Anna buys 12 apples. Many people and 7 pears for sale. It costs 45 dollars in Oslo. He walks 3 miles home."
    docs = documents([
        (1, f"{FILLER} {ITEM} {FILLER}"), (2, f"{FILLER} {ITEM.lower()} {FILLER}"), (3, f"{FILLER}\n{other}\n{FILLER}"), (4, FILLER), (5, muddled),
        (6, f"{FILLER} {ITEM.replace('apples', 'plums')}"), (7, None), (8, ""), (9, "1 2 3 4 5 6 7 8 9 10 11 12 13"), (10, "the quick brown fox " + FILLER),
    ])
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (6, 1)}
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [4, 5, 7, 8, 9, 10]


def test_slots_must_be_consistent(spark, documents):
    item = "Add 5 to 9 then take 5 from the sum and add 5 once more to what is left of 9 today"
    fair, unfair = item.replace("5", "4").replace("9", "8"), "Add 1 to 2 then take 3 from the sum and add 4 once more to what is left of 6 today"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontaminate.leaks(documents([(1, fair), (2, unfair)]), bench).collect()
    assert [r.doc_id for r in got] == [1]


def test_short_items_are_matched_as_a_whole(spark, documents):
    items = spark.createDataFrame([(1, "Alpha beta gamma"), (2, "one"), (3, "mix 12 with 30 kg")], "item_id long, text string")
    rows = [(1, "alpha, BETA gamma!"), (2, "alpha beta gamma delta"), (3, "one"), (4, "mix 5 with 7 kg"), (5, "mix 5 with 7 kg now")]
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.leaks(documents(rows), items).collect()) == [(1, 1), (4, 3), (5, 3)]


def test_items_dense_in_numbers_and_full_filters(spark, documents, monkeypatch):
    item = "Compute the sum of 12 + 45 - 33 + 9 x 2 and then write 14 and 70 down"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    other = item.replace("12", "81").replace("45", "17").replace("33", "26").replace("14", "55").replace("70", "64")
    rows = [(1, f"{FILLER} {other} {FILLER}"), (2, f"{FILLER} write 14 and 70 down {FILLER}"), (3, FILLER)]
    want = sorted(map(tuple, decontaminate.leaks(documents(rows), items).collect()))
    assert [w[0] for w in want] == [1]
    monkeypatch.setattr(decontaminate, "FILTER_BITS", 64)  # lets all pass
    assert sorted(map(tuple, decontaminate.leaks(documents(rows), items).collect())) == want


def test_leaks_edges(spark, edges, nothing):
    bench = spark.createDataFrame([(1, "same text here same text here")], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.leaks(edges, bench).collect()} == {5, 6}
    assert decontaminate.leaks(nothing, bench).count() == 0 and decontaminate.leaks(edges, bench.limit(0)).count() == 0
    assert decontaminate.clean(edges, bench).count() == 6


# ---- top-k ----


@pytest.mark.parametrize("hot", [0, 400])
def test_topk_is_exact(spark, hot):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 0.2, (900, 12)).astype(np.float32)
    x[:hot] = x[0]
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(2000, None), (2001, [1.0, None]), (2002, [float("nan")] * 12), (2003, [float("inf")] * 12)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = topk.quantised(table)
    got = topk.search(v, v.filter("vec_id % 30 = 0"), k=5).collect()
    q = np.floor(256 * x.astype(np.float64)).astype(np.int64)
    want = []
    for i in range(0, 900, 30):
        s = q @ q[i]
        order = sorted((j for j in range(900) if j != i), key=lambda j: (-s[j], j))[:5]
        want += [(i, r + 1, j, int(s[j])) for r, j in enumerate(order)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_topk_edges(spark):
    table = spark.createDataFrame([(0, [0.5, 0.5]), (50, [0.1, 0.2])], "vec_id long, embedding array<float>")
    v = topk.quantised(table)
    assert sorted((r.query_id, r.vec_id) for r in topk.search(v, v, k=5).collect()) == [(0, 50), (50, 0)]
    assert topk.search(v.limit(0), v.limit(0), k=5).count() == 0 and topk.search(v, v.limit(0), k=5).count() == 0


def exact_best(ids, q, asked, k):
    q = [[int(c) for c in row] for row in q]
    out = []
    for i in asked:
        scores = {j: sum(a * b for a, b in zip(q[i], q[n], strict=True)) for n, j in enumerate(ids) if j != ids[i]}
        out += [(ids[i], r + 1, j, scores[j]) for r, j in enumerate(sorted(scores, key=lambda j: (-scores[j], j))[:k])]
    return sorted(out)


@pytest.mark.parametrize("scale", [0.3, 1e3, 1e6])
def test_topk_in_many_parts_and_blocks(spark, monkeypatch, scale):
    monkeypatch.setattr(topk, "SLICE", 16)
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(m, 0.2, (60, 6)) for m in (-2, 0, 3)]) * scale
    x[100:130] = x[100]
    table = spark.createDataFrame([(7 * i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    v = topk.quantised(table)
    got = topk.search(v, v.filter("vec_id % 3 = 0"), k=4, pivots=5, part=20, block=10).collect()
    q = np.floor(256 * x).astype(np.int64)
    assert sorted(map(tuple, got)) == exact_best([7 * i for i in range(180)], q, [i for i in range(180) if 7 * i % 3 == 0], 4)


def test_topk_leaves_out_what_the_bound_excludes():
    rng = np.random.default_rng(13)
    centre = rng.normal(0, 60, 8)
    x = np.concatenate([np.rint(centre + rng.normal(0, s, (500, 8))).astype(np.int64) for s in (3, 200)])
    most = float((x * x).sum(1).max())
    place = topk.lifted(centre[None], most)
    far = topk.distances(topk.lifted(x.astype(float), most), place)[:, 0]
    by = np.argsort(far, kind="stable")
    q = np.rint(x[:40] * 2)
    own = topk.distances(np.concatenate([q.astype(float), np.zeros((40, 1))], axis=1), place)[:, 0]
    kth = np.sort(q @ x.T, axis=1)[:, -5].astype(float)
    scores, ids, taken = topk.walked(x[by], by, far[by], q, np.full(40, -5), own, (q * q).sum(1).astype(float), kth, 5, most)
    assert taken < 40 * 1000 and (np.sort(q @ x.T, axis=1)[:, :-6:-1] == scores).all()


def test_topk_of_odd_vectors(spark):
    rows = [(1, [0.5, 0.25]), (1, [0.5, 0.25]), (2, [0.75, 0.5]), (2, [0.25, 0.5]), (3, [1e30, 0.0]), (4, [1.0]), (5, []), (6, [-0.5, 1.0]), (None, [0.5, 0.5]), (7, [9e5, -9e5])]
    v = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    held = {r.vec_id: list(r.v) for r in v.collect()}
    assert v.count() == 4 and held == {1: [128, 64], 2: [64, 128], 6: [-128, 256], 7: [230400000, -230400000]}
    got = sorted(map(tuple, topk.search(v, v, k=2).collect()))
    ids = sorted(held)
    assert got == exact_best(ids, np.array([held[i] for i in ids], object), range(4), 2)
