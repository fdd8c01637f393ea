import tracemalloc

import numpy as np
import public_tokenizers as P

from vidweave.llm import html_extraction as H
from vidweave.llm import piece_memo, quality_classifier, quality_rules, toxicity

from .conftest import HOSTILE


def test_base_measures(spark, hostile):
    rows = [(20, "a b c a b c a b c", "en"), (21, "x\ny\nx\n \n ", "de"), (22, "#a *b <c>", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in quality_rules.apply_rules(df, P.path("piece_bpe_32k.model")).collect()}
    assert (got[20]["n_words"], got[20]["n_repeat_words"], got[20]["word_chars"]) == (9, 9, 9)
    assert (got[21]["n_dup_lines"], got[22]["n_symbols"], got[22]["kept"]) == (1, 4, False)
    out = {r["doc_id"]: r for r in quality_rules.apply_rules(hostile, P.path("piece_bpe_32k.model")).collect()}
    assert len(out) == 10 and out[1]["n_words"] == 0 and out[1]["base_failed"] and out[7]["n_repeat_words"] == 30_000
    assert quality_rules.kept_rows(hostile, P.path("piece_bpe_32k.model")).columns == hostile.columns


BPE = (P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
STEMS = ["Haus", "Weg", "Zeit", "Arbeit", "Wasser", "Donaudampfschifffahrt", "und", "der", "ist", "klein", "gehen", "Abend", "Stadt", "sehr", "nicht"]


def clean_texts(n, seed=3):
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice(STEMS) + str(rng.integers(0, 60)) for _ in range(80)) for _ in range(n)]


def test_measures_by_brute_force(spark):
    """Each measure of the query against the libraries, on whole texts, one longer than two spans of tokens."""
    import math
    from collections import Counter

    import sentencepiece

    from vidweave.llm.bpe_codec import encoding

    sp, enc = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")), encoding(*BPE)
    texts = ["one two three", " ".join(clean_texts(5)), "漢字 かな\tx\U0001f600y", "", "a" * 3000, *clean_texts(4)]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in quality_rules.measure(df, P.path("piece_bpe_32k.model"), BPE).collect()}
    for i, text in enumerate(texts):
        ws = text.split()
        ids, chars = [k for w in ws for k in sp.encode(w)], sum(map(len, ws))
        entropies = 0.0
        for at in range(0, len(ids), 256):
            part = ids[at : at + 256]
            h = -sum(c / len(part) * math.log2(c / len(part)) for c in Counter(part).values())
            entropies += h / max(1.0, math.log2(len(part))) * len(part)
        n, m = len(ids), sum(len(enc.encode_ordinary(" " + w)) for w in ws)
        want = (chars / n, sum(map(sp.is_byte, ids)) / n, entropies / n, chars / m) if n else (0.0,) * 4
        assert np.allclose([got[i][c] for c in quality_rules.MEASURES], want), (i, want)


def test_bands_hold_with_copies_and_at_every_size(spark):
    """Exact and near copies reject no clean text, and few texts are judged by the same rule as many."""
    copy = " ".join(f"{w} {k}" for k, w in enumerate(STEMS * 6))
    clean = clean_texts(40)
    near = [f"{copy} {a} {b}" for a in STEMS for b in ("Haus", "und", "sehr")]
    df = spark.createDataFrame([(i, t, "de") for i, t in enumerate([copy] * 300 + clean + near)], "doc_id long, text string, lang string")
    measured = quality_rules.stored(quality_rules.measure(df, P.path("piece_bpe_32k.model"), BPE), "t")
    for part in (measured, measured.where("doc_id BETWEEN 290 AND 339"), measured.where("doc_id < 302"), measured.where("doc_id >= 338"), measured.limit(0)):
        assert quality_rules.judge(part, quality_rules.fit_bands(part)).where("NOT base_failed AND NOT kept").count() == 0
    assert quality_rules.fit_bands(measured) == quality_rules.fit_bands(measured.where("doc_id >= 299"))
    assert measured.where("NOT base_failed").count() == 385


def test_bands_alone_catch_junk(spark):
    """Junk that the base rules keep is rejected by the bands of the clean texts around it; no clean text goes."""
    import base64
    import string

    rng = np.random.default_rng(8)
    letters = np.array(list(string.ascii_lowercase))
    junk = {
        "mash": " ".join("".join(rng.choice(letters, 7)) for _ in range(150)),
        "numbered": " ".join(f"spam{k}" for k in range(300)),
        "base64": " ".join(base64.b64encode(rng.bytes(30)).decode() for _ in range(60)),
        "hex": " ".join(rng.bytes(16).hex() for _ in range(80)),
        "emoji": " ".join(chr(0x1F600 + int(k)) * 4 for k in rng.integers(0, 60, 120)),
    }
    rows = [(k, " ".join(x.rstrip("0123456789") + "." * (j % 9 == 8) for j, x in enumerate(t.split())), "de") for k, t in enumerate(clean_texts(200, 9))]
    rows += [(1000 + k, t, "de") for k, t in enumerate(junk.values())]
    out = quality_rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string"), P.path("piece_bpe_32k.model"), BPE).collect()
    caught = {list(junk)[r["doc_id"] - 1000] for r in out if r["doc_id"] >= 1000 and not r["base_failed"] and not r["kept"]}
    assert caught == set(junk), set(junk) - caught
    assert all(r["kept"] or r["base_failed"] for r in out if r["doc_id"] < 1000) and sum(r["kept"] for r in out) > 150


def test_script_counts_every_letter():
    assert quality_rules.script_of("a漢" * 2001 + "漢") == "other" and quality_rules.script_of("a漢" * 2001 + "a") == "latin"
    assert quality_rules.script_of("ab漢漢" * 1000 + "漢" * 3) == "other"


def test_repeat_words_by_brute_force():
    rng = np.random.default_rng(2)
    for n in (0, 2, 3, 4, 50):
        x = rng.integers(0, 4, n)
        wins = [tuple(x[k : k + 3]) for k in range(max(0, n - 2))]
        covered = {k + j for k, w in enumerate(wins) if wins.count(w) > 1 for j in range(3)}
        assert quality_rules.repeat_words(x) == len(covered)


def test_em_finds_good_labellers():
    rng = np.random.default_rng(4)
    truth = rng.random(4000) < 0.8
    patterns = np.full((4000, 3), quality_classifier.ABSTAIN)
    for j, right in enumerate((0.95, 0.9, 0.6)):
        vote = np.where(rng.random(4000) < right, truth, ~truth)
        patterns[:, j] = np.where(vote, quality_classifier.GOOD, quality_classifier.BAD)
    posterior, accuracy, _ = quality_classifier.em(patterns, np.ones(4000), trust=0.8)
    assert accuracy[0] > accuracy[2] and ((posterior > 0.5) == truth).mean() > 0.92


def test_variety_of_whole_texts():
    rng = np.random.default_rng(5)
    for n, kinds in ((0, 1), (1, 1), (399, 9), (400, 300), (401, 300), (1000, 500), (1500, 40)):
        ws = [b"%d" % k for k in rng.integers(0, kinds, n)]
        shares = [len(set(ws[k : k + 400])) / max(1, min(n, 400)) for k in range(max(1, n - 399))]
        assert np.allclose(quality_classifier.varieties(ws), (np.mean(shares), min(shares)))
    good = " ".join(f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" + "." * (k % 10 == 9) for k in range(400))
    low = " ".join(str(rng.choice(["so", "it", "goes", "on", "and", "off", "again."])) for _ in range(3000))
    at = quality_classifier.LABELLERS.index
    for text in (good + " " + low, low + " " + good):
        v = quality_classifier.votes(quality_classifier.shape(text))
        assert (v[at("variety")], v[at("prose")]) == (quality_classifier.BAD, quality_classifier.ABSTAIN)
    v = quality_classifier.votes(quality_classifier.shape(good))
    assert (v[at("variety")], v[at("prose")]) == (quality_classifier.ABSTAIN, quality_classifier.GOOD)


def test_classifier_on_hostile_texts(spark, hostile):
    assert quality_classifier.classify(hostile).count() == len(HOSTILE)
    assert quality_classifier.kept_rows(hostile).columns == hostile.columns
    assert quality_classifier.classify(hostile.limit(0)).count() == 0


def test_nnpu_finds_the_positive_feature():
    rng = np.random.default_rng(1)
    rows = [np.array([0, rng.integers(2, 40)]) for _ in range(200)] + [np.array([0, rng.integers(2, 40)]) if k < 60 else np.array([1, rng.integers(2, 40)]) for k in range(600)]
    w, bias = toxicity.nnpu(rows, np.arange(800) < 200, 40, 0.1)
    assert w[0] + bias > 0 > w[1] + bias


def test_toxicity_without_labels(spark, hostile):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = toxicity.classify(hostile, labels).collect()
    assert len(rows) == 10 and all(r["score"] < 0.01 and r["predicted"] == 0 for r in rows)


def test_html(spark):
    page = "<html><head><title>T</title><script>x<p></script></head><body><div class=menu><a href=/>Home</a></div><article><h1>Title &amp; more</h1><p>First  text,\n of it.<p>Second<br>line.</article><div id=comments><p>I like it a lot, really.</p></div><footer>&copy; x</footer></body></html>"
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "<p>unclosed <b>")], "page_id long, url string, html string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in H.extract(df).collect()}
    assert got[1][0] == "Title & more\nFirst text, of it.\nSecond line."
    assert got[2] == ("", 0) and got[3] == ("", 0)


def test_broken_markup():
    """Tags that are left open lose no page."""
    model = H.default_model()
    body = "<body><div class=menu><a href=/>Home</a></div><article><h1>A title here</h1><p>First sentence of it, quite long. And more.</p>{}<p>Second part of the text, also long enough.</p></article><footer>&copy; me</footer>"
    want = "A title here\nFirst sentence of it, quite long. And more.\nSecond part of the text, also long enough."
    for head in ("<head><title>T</title></head>", "<head><title>T</title>", "<head><meta charset=x><link href=y><script>a<b</script>", "", "<title>T</title>"):
        for middle in ("", "<hr>", "<svg><path>", "<!-- x -->"):
            assert H.main_text([H.parse(f"<html>{head}{body.format(middle)}")], model) == [want], (head, middle)
    tree = H.parse("<p>one<hr>two<select><option>x<p>three")
    assert [t for _, t in tree.runs] == ["one", "two", "three"]
    deep = H.parse("<div>" * 3000 + "text")
    assert len(H.Forest([deep]).levels) == 3000


#: Hand-labelled pages of other layouts and wordings than the model was fitted to: (html, main text).
PAGES = [
    ("""<!doctype html><html lang=en><head><meta charset=utf-8><title>Tea</title><style>p{color:red}</style></head><body id=top>
<div id="masthead"><span>Leaf &amp; Cup</span> <a href="/a">Shop</a> | <a href="/b">Visit</a></div>
<main role=main><h1>How to brew green tea</h1><p>Heat the water to eighty degrees, not more. Boiling water makes it bitter.</p><ul><li>Two grams of leaves for a cup.</li><li>Two minutes of waiting.</li></ul><p>Pour it slowly, and drink it while it is warm.</p></main>
<div class="related-posts"><h4>Read next</h4><a href="/c">Black tea</a> <a href="/d">White tea</a></div><div class="site-footer">Leaf &amp; Cup, 12 Mill Road</div></body></html>""",
     "How to brew green tea\nHeat the water to eighty degrees, not more. Boiling water makes it bitter.\nTwo grams of leaves for a cup.\nTwo minutes of waiting.\nPour it slowly, and drink it while it is warm."),
    ("""<html><body><nav><ul><li><a href=1>News</a><li><a href=2>Sport</a></ul></nav><div class=cookie-banner><p>We use cookies. Accept them, or read more.</p><button>OK</button></div>
<div class="story"><h1>Bridge opens after ten years</h1><p>The new bridge over the river opened on Monday. Hundreds of people walked across it.</p><blockquote><p>We waited a long time for this, said the mayor.</p></blockquote><div class="advert"><p>Buy two, get one free, this week only!</p></div><p>Cars may use it from next week, the council said.</p></div>
<section class=comments><h3>Comments</h3><div class=comment><p>Great news, I was there too.</p></div><div class=comment><p>Too late and too dear, if you ask me.</p></div></section><footer><p>All rights reserved. Imprint and terms.</p></footer></body></html>""",
     "Bridge opens after ten years\nThe new bridge over the river opened on Monday. Hundreds of people walked across it.\nWe waited a long time for this, said the mayor.\nCars may use it from next week, the council said."),
    ("""<html><body><div class=wrapper><header class=site-header><div class=logo>Notes</div></header><div class=content><h2>On walking</h2><p>I walk each morning, whatever the weather is. It clears the head.</p><p>Rain is no reason to stay in; a coat will do.</p></div><aside class=sidebar><h3>About me</h3><p>I write here now and then.</p></aside></div><div class=footer>Made by hand</div></body></html>""",
     "On walking\nI walk each morning, whatever the weather is. It clears the head.\nRain is no reason to stay in; a coat will do."),
    ("""<html><body><form class=search><input name=q><button>Go</button></form><article><header><h1>Bread in five steps</h1></header><p>Mix flour, water, salt and yeast, and let the dough rest for a night.</p><table><tr><td>Flour</td><td>500 g</td></tr><tr><td>Water</td><td>350 g</td></tr></table><p>Bake it hot, with steam, for forty minutes.</p></article><div class=newsletter><p>Get a recipe each week by mail.</p></div></body></html>""",
     "Bread in five steps\nMix flour, water, salt and yeast, and let the dough rest for a night.\nFlour\n500 g\nWater\n350 g\nBake it hot, with steam, for forty minutes."),
]


def test_hand_labelled_pages():
    """F1 over the lines of pages that the model was not fitted to."""
    got = H.main_text([H.parse(p) for p, _ in PAGES], H.default_model())
    hit = sum(len(set(g.split("\n")) & set(w.split("\n"))) for g, (_, w) in zip(got, PAGES, strict=True))
    given, wanted = sum(len(set(g.split("\n"))) for g in got), sum(len(set(w.split("\n"))) for _, w in PAGES)
    assert 2 * hit / (given + wanted) >= 0.95, got


def test_null_ids_stay_exact(spark):
    big = 9007199254740993  # no float holds it
    text = "\n".join(t for _, t in PAGES)
    df = spark.createDataFrame([(None, text, "en", None), (big, text, "en", big), (None, None, None, 1)], "doc_id long, text string, lang string, n_chars long")
    labels = spark.createDataFrame([(big, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    for out in (quality_rules.apply_rules(df, P.path("piece_bpe_32k.model")), quality_classifier.classify(df), toxicity.classify(df, labels)):
        assert sorted(str(r["doc_id"]) for r in out.collect()) == [str(big), "None", "None"]
    kept = quality_rules.kept_rows(df, P.path("piece_bpe_32k.model")).collect()
    assert {(r["doc_id"], r["n_chars"]) for r in kept} == {(None, None), (big, big)}
    assert {r["n_chars"] for r in quality_classifier.kept_rows(df, threshold=1e-9).collect()} >= {None, big}
    pages = spark.createDataFrame([(None, "u", "<p>x"), (big, "v", None)], "page_id long, url string, html string")
    assert sorted(str(r["page_id"]) for r in H.extract(pages).collect()) == [str(big), "None"]


def test_classifier_and_toxicity_against_labels(spark):
    """Held-out labels of the given tables."""
    import os

    import pytest

    d = "/root/testdata/sf0.01"
    if not os.path.exists(d):
        pytest.skip("no given tables")
    docs, labels = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("documents", "labels"))
    got = quality_classifier.classify(docs).join(labels, "doc_id").select("kept", "quality").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.97 and got[got.quality == 0].kept.mean() < 0.1
    got = toxicity.classify(docs, labels).join(labels, "doc_id").where("held_out").select("score", "predicted", "toxic").toPandas()
    a, b = got[got.toxic == 1].score.to_numpy(), got[got.toxic == 0].score.to_numpy()
    assert (a[:, None] > b[None]).mean() > 0.85 and got[got.toxic == 0].predicted.mean() < 0.05 and got[got.toxic == 1].predicted.mean() > 0.4


def test_marginals_by_enumeration():
    tree, rng = H.parse("<div><p>a</p><ul><li>b</li></ul></div>"), np.random.default_rng(0)
    f = H.Forest([tree])
    w, pair = rng.normal(size=H.N_UNARY), rng.normal(size=(H.N_KINDS, 2, 2))
    n, score, total, content = len(tree.tags), f.x @ w, 0.0, np.zeros(len(tree.tags))
    for code in range(1 << n):
        y = [(code >> k) & 1 for k in range(n)]
        p = np.exp(sum(score[k] * y[k] for k in range(n)) + sum(pair[f.kind[k], y[f.parent[k]], y[k]] for k in range(1, n)))
        total += p
        content += p * np.array(y)
    assert np.allclose(f.marginals(w, pair)[0], content / total)


def test_toxicity_draws_texts_not_rows(spark):
    """A third of all rows under one id, labelled toxic: the sample holds one text of it, and all are judged right."""
    rows = [(i, f"calm words here number {i}") for i in range(300)] + [(1000 + i, f"vile slur here number {i}") for i in range(60)] + [(1000, f"vile slur again {i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 1000)) for i, _ in rows[:360]], "doc_id long, toxic int")
    seen = []
    keep = toxicity._features
    toxicity._features = lambda df, *a: (seen.append(df), keep(df, *a))[1]
    try:
        few = toxicity.classify(docs, labels, most_positives=20, most_unlabelled=50).count()
    finally:
        toxicity._features = keep
    assert seen[0].count() <= 70 and few == len(rows)
    got = toxicity.classify(docs, labels).collect()
    assert all(r["predicted"] == int(r["doc_id"] >= 1000) for r in got if r["held_out"])


def test_linear_fit_needs_little_beside_its_rows():
    """Rows are taken one by one and kept as 16-bit places: well below what whole rows and their products would take."""
    rng = np.random.default_rng(5)
    n, size = 1500, 800

    def rows():
        for k in range(n):
            at = rng.choice(quality_classifier.BUCKETS // 2, size, replace=False) + (k % 2) * quality_classifier.BUCKETS // 2
            yield at, np.full(size, 0.01), float(k % 2)

    tracemalloc.start()
    w, _ = quality_classifier.fit_linear(rows(), steps=3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * n * size and w[: quality_classifier.BUCKETS // 2].max() <= 0 <= w[quality_classifier.BUCKETS // 2 :].min()
    assert not quality_classifier.fit_linear([])[0].any()


def test_memo_is_given_up():
    piece_memo.held(("some", "memo"), dict)
    piece_memo.release()
    assert not piece_memo._slot
