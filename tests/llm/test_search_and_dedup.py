import itertools
import random
import re

import numpy as np

from vidweave.llm import line_dedup, ngram_join, partenum, shingles, vector_topk
from vidweave.llm.components import connected_components


def sets_of(rows, width):
    out = {}
    for i, t in rows:
        w = [x.decode().lower() if x.isascii() else x for x in (t or "").encode().split()]
        out[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    return out


def brute(rows, width, percent):
    sets, comp = sets_of(rows, width), {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and comp[a] != comp[b] and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    low, high = sorted((comp[a], comp[b]))
                    comp = {k: low if v == high else v for k, v in comp.items()}
                    changed = True
    return {i: (len(sets[i]), comp[i]) for i in sets}


def near_copies(seed=1, groups=12, each=7):
    rng, rows = random.Random(seed), [(1000, None), (1001, ""), (1002, "one two"), (1003, "ONE two"), (1004, "a b c d")]
    for _ in range(groups):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.choice((6, 12, 40, 90, 300)))]
        for _ in range(each):
            copy = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, 4))):
                copy[rng.randrange(len(copy))] = f"n{rng.randint(0, 999)}"
            rows.append((len(rows), " ".join(copy)))
    return rows


def test_join_equals_brute_force(spark):
    rows = near_copies()
    for width, percent in ((4, 85), (5, 80)):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r[0]: (r[1], r[2]) for r in ngram_join.join(df, width, percent, block_sets=8, block_features=400).collect()}
        assert got == brute(rows, width, percent)


def test_join_of_hostile_and_empty_tables(spark, hostile):
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join(hostile, 4, 85).collect()}
    assert got[1] == 1 and got[2] == 2 and got[5] == 4 and len(got) == 10
    assert ngram_join.join(hostile.limit(0), 4, 85).count() == 0


def test_signatures_are_shared_by_all_links():
    """Pairs at the edge of a link, of equal and of different sizes, in all shapes of the scheme."""
    rng, met, shapes = np.random.default_rng(5), 0, set()
    for percent in (80, 85, 95):
        for n in (*range(1, 60), 200, 477, 900, 3000):
            for share in (0, 50, 100):  # of the differing features that b has
                a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
                d = partenum.difference(percent, 2 * n)
                gone, new = d - d * share // 100, d * share // 100
                b = np.unique(np.concatenate([a[gone:], rng.integers(0, 1 << 62, new).astype(np.uint64)]))
                if len(b) and ngram_join.linked(a, b, percent) and not np.array_equal(a, b):
                    sigs, ends = partenum.signatures(np.concatenate([a, b]), np.array([len(a), len(a) + len(b)]), percent)
                    assert np.intersect1d(sigs[: ends[0]], sigs[ends[0] :]).size
                    met += 1
        shapes |= {(s.k2, s.n2) for i in range(25) if (s := partenum.scheme(percent, i))}
    assert met > 200 and all(k2 >= 1 and n2 - k2 >= 2 for k2, n2 in shapes)


def test_subsets_are_enumerated_at_every_size():
    """Every instance that a set of any size takes part in enumerates subsets, and keeps no more than it has."""
    for percent in (80, 85):
        for size in (*range(1, 400), *(int(400 * 1.3**k) for k in range(24))):
            part = partenum.takes_part(percent, size)
            assert bool(part) == (partenum.difference(percent, size + size * 100 // percent) > 0)
            for instance, kept in part:
                s = partenum.scheme(percent, instance)
                assert s.k2 >= 1 and len(s.subsets[0]) >= 2 and len(s.subsets) >= 3 and kept <= s.n1 * len(s.subsets)


def test_spoilt_signatures_by_enumeration():
    """The counting bound against all ways to hit cells."""
    for n1, k2, n2 in ((1, 1, 3), (2, 1, 3), (2, 2, 4), (3, 0, 1), (2, 1, 2), (1, 3, 6), (2, 1, 4)):
        bound = partenum._spoilt(n1, k2, n2, 4)
        for d in range(5):
            worst = 0
            for hit in itertools.product(range(n1 * n2), repeat=d):
                spoilt = sum(any(p * n2 + c in hit for c in subset) for p in range(n1) for subset in itertools.combinations(range(n2), n2 - k2))
                worst = max(worst, spoilt)
            assert worst <= bound[d]


def test_word_hashes_do_not_depend_on_blocks(monkeypatch):
    raw = "Ab ab\tAB  über x".encode() + b"y" * 300 + b" z\n" + b"w" * 64 + b" q" + b"v" * 63
    want, places = shingles.word_hashes(raw)
    monkeypatch.setattr(shingles, "_BLOCK", 64)
    shingles._tables.cache_clear()
    got, at = shingles.word_hashes(raw)
    shingles._tables.cache_clear()
    words = raw.split()
    assert places.tolist() == at.tolist() == [m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    assert want[0] == want[1] == want[2] and len(set(want.tolist())) == len({w.lower() for w in words})
    short = [k for k, w in enumerate(words) if len(w) < 64]
    assert (want[short] == got[short]).all() and len(set(got.tolist())) == len(set(want.tolist()))


def test_join_with_shared_and_null_ids(spark):
    """Two texts of one id, one of which another document links with; rows without an id."""
    base = [f"w{k}" for k in range(60)]
    other, near = [f"v{k}" for k in range(60)], [f"v{k}" for k in range(59)] + ["x"]
    rows = [(5, " ".join(base)), (5, " ".join(other)), (8, " ".join(near)), (9, " ".join(base)), (None, " ".join(near)), (None, "alone"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r[0], r[1], r[2]) for r in ngram_join.join(df, 4, 85).collect()), key=str)
    assert got == sorted([(5, 57, 5), (5, 57, 5), (8, 57, 5), (9, 57, 5), (None, 57, 5), (None, 1, None), (None, 0, None)], key=str)
    kept = ngram_join.one_of_each(df, width=4, percent=85).select("doc_id").collect()
    assert sorted([r[0] for r in kept if r[0] is not None]) == [5, 5] and len(kept) == 5


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (300, 200), (7, 7)]
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 300: 100}


def test_line_dedup(spark, hostile):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\n\nb\nc\ny"), (3, "s\nt"), (4, "s\nt"), (5, None), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.dedup_lines(df).collect()}
    assert got == {1: ("a\nb\nc\nd", 4, 0), 2: ("x\n\ny", 6, 3), 3: ("s\nt", 2, 0), 4: ("", 2, 2), 5: (None, 0, 0), 6: ("", 1, 0)}
    shared = [(7, "p\nq\nr"), (7, "p\nq\nr"), (7, "k\nl\nm"), (None, "k\nl\nm"), (None, "k\nl\nm"), (8, "z\np\nq\nr")]
    out = line_dedup.dedup_lines(spark.createDataFrame(shared, "doc_id long, text string")).collect()
    texts = sorted(((r["doc_id"], r["text"]) for r in out), key=str)
    assert texts == sorted([(7, "p\nq\nr"), (7, ""), (7, ""), (None, "k\nl\nm"), (None, ""), (8, "z")], key=str)
    out = line_dedup.dedup_lines(hostile)
    assert out.count() == 10 and set(out.columns) == {*hostile.columns, "n_lines"}
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    vectors = {i: rng.normal(0, 0.3, 24).tolist() for i in range(300)}
    vectors.update({i: vectors[3] for i in range(300, 320)})
    vectors.update({400: None, 401: [], 402: [float("nan")] * 24, 450: [0.5], 403: [None] * 24})
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    got = {(r[0], r[1]): (r[2], r[3]) for r in vector_topk.top_k(df, "vec_id % 50 = 0", 5, query_rows=3, candidate_rows=64).collect()}
    ints = {i: np.floor(256 * np.array(v)).astype(int) for i, v in vectors.items() if v and all(x is not None and np.isfinite(x) for x in v)}
    want = {}
    for q in (i for i in ints if i % 50 == 0):
        scores = sorted((-int(np.dot(ints[q][: len(ints[c])], ints[c][: len(ints[q])])), c) for c in ints if c != q)[:5]
        want.update({(q, k + 1): (c, -s) for k, (s, c) in enumerate(scores)})
    assert got == want
    assert vector_topk.top_k(df.limit(0), "vec_id % 50 = 0").count() == 0


def test_top_k_of_repeated_ids(spark):
    """Two query rows of one id, equal or not, have ranks of their own and are candidates of each other."""
    rows = [(50, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [0.0, 2.0]), (1, [1.0, 1.0]), (2, [0.5, 0.0]), (2, [0.5, 0.0])] + [(7, [0.0, 0.25])] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(tuple(r) for r in vector_topk.top_k(df, "vec_id = 50", 4, query_rows=2, candidate_rows=2).collect())
    want = []
    for q, (i, v) in enumerate(rows[:3]):
        scores = sorted((-int(sum(256 * a * 256 * b for a, b in zip(v, w, strict=True))), c) for at, (c, w) in enumerate(rows) if at != q)
        want += [(i, n + 1, c, -s) for n, (s, c) in enumerate(scores[:4])]
    assert got == sorted(want)


def test_top_k_of_large_components(spark):
    """Products beyond what doubles and 32 bits hold are exact; what does not fit raises."""
    rows = [(0, [1e7, 3.0]), (1, [1e7 + 1, -5.0]), (2, [-1e7, 7.0]), (3, [1e7, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ints = {i: [int(256 * x) for x in v] for i, v in rows}
    want = sorted(((-sum(a * b for a, b in zip(ints[0], ints[i], strict=True)), i) for i in (1, 2, 3)))
    got = [(-r["score"], r["vec_id"]) for r in vector_topk.top_k(df, "vec_id = 0", 5).orderBy("rank").collect()]
    assert got == want and abs(want[0][0]) > 1 << 53 - 2
    import pytest

    with pytest.raises(ValueError, match="64 bits"):
        vector_topk.search_block(np.array([[1 << 40, 0]]), np.array([[1 << 40], [0]]), np.array([1]), np.array([0]), 1)


def test_bounds_drop_candidates():
    """With mass in few dimensions, and a k-th best known from before, work is spared and nothing lost."""
    rng = np.random.default_rng(2)
    scale = np.concatenate([np.full(16, 300), np.full(48, 5)])
    c = np.floor(rng.normal(0, 1, (2000, 64)) * scale).astype(np.int64)
    q, ids = c[:20], np.arange(2000)
    rows, floors, spared = vector_topk.search_block(q, c.T, ids, ids[:20], 5)
    scores = q @ c.T
    scores[np.arange(20), np.arange(20)] = -(1 << 60)
    want = [(k, int(i), int(scores[k, i])) for k in range(20) for i in np.lexsort((ids, -scores[k]))[:5]]
    assert rows == want and spared > 0.4 * 20 * 2000 * 64
    again, _, more = vector_topk.search_block(q, c.T, ids, ids[:20], 5, floors=floors)
    assert again == want and more >= spared


def test_chosen_documents_pass_one_python_step(spark):
    """Documents are chosen by bitmap in the step that cuts them: two Python steps in one task would need two workers a core."""
    docs = spark.createDataFrame([(k, f"{k} some words of text") for k in range(200)] + [(None, "x y z")], "doc_id long, text string")
    bits = ngram_join._bits(docs.where("doc_id % 50 = 0").select("doc_id"), "doc_id", 1 << 20)
    out = ngram_join._sets(docs, 4, lambda ids, features, ends: {"doc_id": ids}, "doc_id long", bits, 1 << 20)
    assert sorted(r[0] for r in out.collect()) == [0, 50, 100, 150]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan


def test_top_k_sends_no_blocks_through_the_driver(spark):
    """The copies of the query blocks are shuffled, however small Spark takes them to be."""
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(100)], "vec_id long, embedding array<double>")
    found = vector_topk.top_k(df, "vec_id % 50 = 0", 5, query_rows=1, candidate_rows=10)
    assert found.count() == 10
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin \[c#", plan) and not re.search(r"BroadcastHashJoin \[c#", plan)
