"""Power-of-two packing, subvector k-means and the Merkle manifest against plain Python."""

import hashlib
import math
import zlib
from itertools import product

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vidweave.llm import length_buckets, merkle_manifest, queries, subvector_kmeans

from .conftest import HOSTILE


def test_decompose_into_powers_of_two():
    totals = np.array([1, 2, 3, 1023, 1024, 1025, 5000, 7])
    owner, length = length_buckets.decompose(totals, 1024)
    assert np.bincount(owner, length).tolist() == totals.tolist()
    assert all(n & (n - 1) == 0 and n <= 1024 for n in length.tolist())
    for k, n in enumerate(totals.tolist()):  # the fewest pieces, longest first
        own = length[owner == k].tolist()
        assert own == sorted(own, reverse=True) and len(own) == n // 1024 + (n % 1024).bit_count()


def test_length_buckets_round_trip(spark, hostile):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    many = hostile.unionByName(hostile.where("doc_id = 9")).repartition(3)
    rows = length_buckets.pack_documents(many, P.path("byte_bpe_50k.json"), capacity=256, batch_tokens=512).collect()
    assert len({r["sequence_id"] for r in rows}) == len(rows) and {r["offset"] for r in rows} == {0}
    by_batch = {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] == 1 << r["bucket"] and r["length"] <= 256
        by_batch.setdefault(r["batch_id"], []).append(r["length"])
    assert all(len(set(x)) == 1 and (sum(x) <= 512 or len(x) == 1) for x in by_batch.values())
    for i, text in HOSTILE:
        want = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["start"])
        assert {r["doc_tokens"] for r in own} == {len(want)}
        copies = 2 if i == 9 else 1
        assert sum(r["length"] for r in own) == copies * len(want)
        for r in own:
            assert np.frombuffer(r["ids"], "<u4").tolist() == want[r["start"] : r["start"] + r["length"]]
    crc = many.limit(0).sparkSession.createDataFrame([(bytearray(np.array([5, 70000], "<u4").tobytes()),)], "ids binary").select(F.crc32("ids")).first()[0]
    assert crc == zlib.crc32(np.array([5, 70000], "<u4").tobytes())
    assert length_buckets.pack_documents(many.limit(0), P.path("byte_bpe_50k.json")).count() == 0
    nameless = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    assert {r["doc_id"] for r in length_buckets.pack_documents(nameless, P.path("byte_bpe_50k.json")).collect()} == {None}
    with pytest.raises(ValueError, match="power of two"):
        length_buckets.pack_documents(many, P.path("byte_bpe_50k.json"), capacity=1000)


def plain_kmeans(rows, k, rounds, dims, seed=3):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in kept]
        centroids = [[sum(x) // len(x) for x in zip(*mine, strict=True)] if (mine := [v for (_, v), m in zip(kept, of, strict=True) if m == n]) else c for n, c in enumerate(centroids)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    total = {n: sum(d for _, m, d in found if m == n) for n in range(k)}
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, n, d, total[n], sum(total.values()), name[n]) for i, n, d in found]


def by_text(rows):
    return sorted(map(str, map(tuple, rows)))


def test_subvector_kmeans(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).round(2).tolist()) for i in range(90)]
    rows += [(200 + i, [0.5, -0.5, 0.25, 0.0]) for i in range(60)]  # a hot vector
    rows += [(7, [9.0, 9.0, 9.0, 9.0]), (7, [9.0, 9.0, 9.0, 9.0]), (None, [1.0, 2.0, 3.0, 4.0])]  # repeated and missing ids
    rows += [(300, None), (301, []), (302, [1.0] * 3), (303, [1.0, None, 1.0, 1.0]), (304, [math.nan] * 4), (305, [math.inf, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster string").repartition(3)
    for chunk_rows in (7, 50):
        got = subvector_kmeans.cluster(df, k=3, rounds=4, dims=4, chunk_rows=chunk_rows).collect()
        assert by_text(got) == by_text(plain_kmeans(rows, 3, 4, 4))
    few = df.where("vec_id = 7 OR vec_id IS NULL")
    assert by_text(subvector_kmeans.cluster(few, k=8, rounds=2, dims=4).collect()) == by_text(plain_kmeans([r for r in rows if r[0] in (7, None)], 8, 2, 4))
    assert subvector_kmeans.cluster(df.limit(0), dims=4).count() == 0
    with pytest.raises(Exception, match="beyond"):
        subvector_kmeans.cluster(spark.createDataFrame([(1, [1e9] * 4)], "vec_id long, embedding array<double>"), dims=4).count()


def test_dictionaries_are_lossless_and_fit_the_chunk():
    rng = np.random.default_rng(6)
    varied, hot = rng.integers(-50, 50, (300, 8)), np.tile(rng.integers(-50, 50, (3, 8)), (100, 1))
    for matrix, widest in ((varied, 1), (hot, 8)):
        width, entries, codes = subvector_kmeans.narrowest_cost(matrix, (8, 2, 1))
        assert width == widest
        back = np.concatenate([e[c] for e, c in zip(entries, codes, strict=True)], 1)
        assert (back == matrix).all() and all(len(np.unique(e, axis=0)) == len(e) for e in entries)
        centroids = rng.integers(-50, 50, (4, 8))
        want = ((matrix[:, None] - centroids) ** 2).sum(2)
        assert (subvector_kmeans.distances(entries, codes, centroids) == want).all()
        nearest = want.argmin(1)
        sums = np.array([matrix[nearest == n].sum(0) for n in range(4)])
        assert (subvector_kmeans.cluster_sums(entries, codes, nearest, 4) == sums).all()


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return H(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in row])


def plain_tree(leaves, fan=3):
    """The root, and each leaf's siblings level by level as (left, right)."""
    steps, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        runs = [level[i : i + fan] for i in range(0, len(level), fan)]
        for k, i in enumerate(at):
            run = runs[i // fan]
            steps[k].append((run[: i % fan], run[i % fan + 1 :]))
        at, level = [i // fan for i in at], [H(*r) for r in runs]
    return level[0], steps


def plain_proofs(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
        shown = plain_leaf((*r[:4], r[4].replace("\n", "") if even and r[4] is not None else r[4]))
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, plain_leaf(r), shown, r[0]))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [(sorted(groups[s]), *plain_tree([x[2] for x in sorted(groups[s])])) for s in order]
    root, tops = plain_tree([sub for _, sub, _ in trees])
    for (leaves, sub, steps), top in zip(trees, tops, strict=True):
        for (_, _, leaf, shown, i), own in zip(leaves, steps, strict=True):
            folded = shown
            for left, right in (*own, *top):
                folded = H(*left, folded, *right)
            yield i, leaf, sub, root, H(*[x for left, right in (*own, *top) for x in (*left, *right)]), folded, folded == root


def test_merkle_proofs(spark, tmp_path):
    rows = [(i, "hot", "en", 3, f"line {i}\nnext") for i in range(40)]
    rows += [(i, s, None if i % 2 else "de", i, t) for i, (s, t) in enumerate(product(["Ä", "a", "B", None, ""], ["x", None, "", "a\nb", "é漢"]), 100)]
    rows += [(500, "alone", None, None, "only\n"), (None, "hot", "en", 1, "no id\n"), (None, None, None, None, None)]
    rows += [(7, "hot", "en", 3, "again\n\n")] * 3  # repeated rows
    df = spark.createDataFrame([(*r, "clash", 5) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, index int").repartition(4)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    want = by_text(plain_proofs(rows))
    assert by_text(queries.op13_merkle_manifest(spark, str(tmp_path)).collect()) == want
    for height in (1, 2):  # several tiers of small blocks
        even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
        shown = [*map(F.col, ("doc_id", "source", "lang", "n_chars")), F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))]
        assert by_text(merkle_manifest.prove(df, presented=shown, height=height).collect()) == want
    assert merkle_manifest.prove(df.limit(0)).count() == 0
    one = merkle_manifest.prove(df.where("doc_id = 500")).first()
    assert one["leaf"] == one["subroot"] == one["root"] and one["verified"] and one["proof_sha256"] == H()


def test_multiproof_is_least():
    """The coordinates listed are those that no leaf of the run can derive and that some leaf needs."""
    for size, first, last in ((1, 0, 0), (10, 0, 9), (10, 3, 4), (28, 9, 17), (100, 40, 77)):
        derived, needed = set(), set()
        level, n, a, b = 0, size, first, last
        while n > 1:
            derived |= {(level, i) for i in range(a, b + 1)}
            needed |= {(level, i) for p in range(a // 3, b // 3 + 1) for i in range(3 * p, min(3 * p + 3, n))}
            level, n, a, b = level + 1, -(-n // 3), a // 3, b // 3
        assert set(merkle_manifest.missing(first, last, size)) == needed - derived


def test_bucket_texts_look_up_distinct_pieces_only(monkeypatch):
    """What length_buckets and token_files ask of the memo: a text that repeats its words costs as many look-ups as it has words."""
    from vidweave.llm import piece_memo

    asked, numbers = [], piece_memo.PieceMemo.numbers
    monkeypatch.setattr(piece_memo.PieceMemo, "numbers", lambda self, pieces, times=None: asked.append(len(pieces)) or numbers(self, pieces, times))
    memo = piece_memo.PieceMemo(lambda new: piece_memo.joined([[len(p)] for p in new]))
    (ids,) = memo.spaced_id_lists(["one two three\n" * 999 + "one two"])
    assert asked == [4] and ids.tolist() == [3, 4, 6, 1] * 999 + [3, 4]
