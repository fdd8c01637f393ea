import base64
import hashlib
import io
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from vidweave.llm import best_fit_packing, bpe_codec, piece_memo, token_files

from .conftest import HOSTILE

TEXTS = [t or "" for _, t in HOSTILE] + ["It's a test, isn't it?\nNew line. 12 34", " lead", "trail ", "a\nb\n", "a \nb", "x\x1cy \x85 z"]


def tokenizer(name):
    t = Tokenizer.from_file(P.path(name))
    t.encode_special_tokens = True
    return t


FORMS = ["Word, word. WORD; (word)... it's. IT'S! 'sx. a.b, Ünde. ÜNDE, J\u030c. j\u030c, \u0130. ΣΑΣ. σας, 12. x1, é. -. !?, Kelvin \u212a. ﬁ, \u1e9e.", "a\u0301, A\u0301. 漢字. ж, Ж. \U0001f642! x\u200d, end."]


@pytest.mark.parametrize(("name", "cut", "mark", "lower"), [("byte_bpe_50k.json", piece_memo.spaced_pieces, "\n", False), ("word_bpe_49k.json", piece_memo.words, " \x01 ", True)])
def test_pieces_give_the_same_ids(name, cut, mark, lower):
    memo, direct = piece_memo._library_memo(P.path(name), mark, lower, 4, 20, 30), tokenizer(name)
    for _ in range(2):  # the small memo forgets in between
        for texts in (TEXTS[:5], TEXTS[5:], ["a \x01 b", "c"], FORMS):
            got = memo.id_lists([cut(t) for t in texts])
            for text, ids in zip(texts, got, strict=True):
                assert ids.tolist() == direct.encode(text, add_special_tokens=False).ids, text[:50]


def test_codec(spark, hostile):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r for r in bpe_codec.digests(hostile, path, P.PATTERN, longest=40).collect()}
    for i, text in HOSTILE:
        ids = enc.encode_ordinary(text or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_frames_round_trip_and_checksum():
    out = io.BytesIO()
    w = token_files.FrameWriter(out)
    docs = {5: np.arange(4, dtype="<u4"), 6: np.zeros(0, "<u4"), 9: np.arange(1000, dtype="<u4")}
    for i, ids in docs.items():
        w.add(i, ids)
    w.finish()
    raw = out.getvalue()
    r = token_files.FrameReader(io.BytesIO(raw), len(raw))
    assert {i: x.tolist() for i, x in r.documents()} == {i: x.tolist() for i, x in docs.items()}
    assert [i for i, _ in r.documents([9, 77])] == [9]
    entry = r.entries.copy()
    entry["check"][2] ^= 1
    r.entries = entry
    with pytest.raises(ValueError, match="checksum"):
        r.frame(2)


def test_files(spark, hostile):
    manifest = token_files.write_files(hostile, P.path("byte_bpe_50k.json"), 2, file_bytes=200)
    t, start, rows = tokenizer("byte_bpe_50k.json"), 0, {}
    for i, text in HOSTILE:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        rows[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r[0]: tuple(r)[1:] for r in token_files.read_files(manifest).collect()} == rows
    assert [r[0] for r in token_files.read_files(manifest, [4, 99]).collect()] == [4]
    assert token_files.read_files(token_files.write_files(hostile.limit(0), P.path("byte_bpe_50k.json"), 2)).count() == 0


def test_packing(spark, hostile):
    got = best_fit_packing.pack_documents(hostile, P.path("word_bpe_49k.json"), capacity=64, block_items=50, fan=4).toPandas()
    t = tokenizer("word_bpe_49k.json")
    want = set()
    for i, text in HOSTILE:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want |= {(i, k // 64, k, len(ids[k : k + 64]), zlib.crc32(ids[k : k + 64].tobytes())) for k in range(0, len(ids), 64)}
    assert set(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
    ordered = got.sort_values(["sequence_id", "offset"])
    groups = ordered.groupby("sequence_id").length
    assert groups.sum().max() <= 64 and (ordered.offset == groups.cumsum() - ordered.length).all()
    assert best_fit_packing.pack_documents(hostile.limit(0), P.path("word_bpe_49k.json")).count() == 0


def random_packing(lengths, capacity, rng):
    bins = np.zeros(len(lengths), np.int64)
    best_fit_packing.best_fit(lengths.tolist(), rng.permutation(len(lengths)).tolist(), bins, [], 0, capacity)
    return bins


def triplets(rng, n):
    """Lengths that fill n bins only if the right three meet."""
    a, b = rng.integers(700, 800, n), rng.integers(600, 700, n)
    return np.concatenate([a, b, 2048 - a - b])


def test_crossing_injects_whole_bins():
    rng = np.random.default_rng(3)
    for lengths in (rng.integers(1, 2048, 300), triplets(rng, 60)):
        a, b = random_packing(lengths, 2048, rng), random_packing(lengths, 2048, rng)
        for _ in range(5):
            child, injected = best_fit_packing.crossed(a, b, lengths, 2048, rng)
            assert len(child) == len(lengths) and np.bincount(child, lengths).max() <= 2048  # each item once
            for of in np.unique(b[injected]):  # a bin of b came in whole
                assert injected[b == of].all() and len(np.unique(child[b == of])) == 1
            fill = np.bincount(b, lengths)
            assert injected.any() and fill[np.unique(b[injected])].min() >= np.median(fill)


def test_evolution_beats_its_parents_and_best_fit():
    rng = np.random.default_rng(4)
    lengths = triplets(rng, 150)
    parents = [random_packing(lengths, 2048, rng) for _ in range(2)]
    bins, children = best_fit_packing.evolve(lengths, 2048, [1], parents, 3, 12)
    decreasing = np.zeros(len(lengths), np.int64)
    best_fit_packing.best_fit(lengths.tolist(), np.argsort(-lengths, kind="stable").tolist(), decreasing, [], 0, 2048)
    assert children >= 2 and bins.max() < min(p.max() for p in parents) and bins.max() < decreasing.max()
    assert np.bincount(bins, lengths).max() <= 2048


def test_genetic_packing_is_near_the_bound():
    lengths = np.random.default_rng(3).integers(1, 2047, 800)
    one, _ = best_fit_packing.evolve(lengths, 2048, [1], [], 3, 8)
    bins, _ = best_fit_packing.evolve(lengths, 2048, [2], [one], 3, 8)
    assert np.bincount(bins, lengths).max() <= 2048 and bins.max() <= one.max()
    assert bins.max() + 1 <= -(-lengths.sum() // 2048) * 1.015 + 1


BIG = 9007199254740993  # no float holds it


def test_null_ids(spark):
    """Rows without an id keep their place, and large ids beside them stay exact."""
    df = spark.createDataFrame([(None, "some words here."), (BIG, "other words"), (None, None), (5, "more")], "doc_id long, text string")
    order = lambda rows: sorted(rows, key=lambda x: (x is not None, x or 0))
    ids = order([None, None, 5, BIG])
    path = P.path("byte_bpe_multi_50k.tiktoken")
    assert order(r["doc_id"] for r in bpe_codec.digests(df, path, P.PATTERN).collect()) == ids
    back = token_files.read_files(token_files.write_files(df, P.path("byte_bpe_50k.json"), 2)).collect()
    assert order(r["doc_id"] for r in back) == ids and sorted(r["start"] for r in back)[0] == 0
    packed = best_fit_packing.pack_documents(df, P.path("word_bpe_49k.json")).collect()
    assert order(r["doc_id"] for r in packed) == ids and len({r["sequence_id"] for r in packed}) == 1
    assert all(r["crossovers"] > 0 and r["elites_moved"] > 0 for r in packed)


def test_distinct_pieces_are_looked_up_once():
    """Texts cut in Arrow give the ids of the tokenizer, with odd white space, empty texts and the mark itself, too."""
    direct, rng = tokenizer("byte_bpe_50k.json"), np.random.default_rng(6)
    memo = piece_memo._library_memo(P.path("byte_bpe_50k.json"), "\n", False, 4, 60, 90)
    odd = ["".join(rng.choice(list("abé \n\t\u3000."), n)) for n in rng.integers(0, 20, 400)]
    for texts in (TEXTS, odd, ["", ""], [], ["a\0b c", "d"], FORMS, TEXTS):
        for text, ids in zip(texts, memo.spaced_id_lists(texts), strict=True):
            assert ids.tolist() == direct.encode(text, add_special_tokens=False).ids, text[:50]
    pieces, which, counts = piece_memo.distinct_pieces(["so it is so", "", "it is\nso"])
    assert pieces == ["so", " it", " is", " so", "", "it", "\n"] and counts.tolist() == [4, 1, 4]
    assert [pieces[k] for k in which] == ["so", " it", " is", " so", "", "it", " is", "\n", "so"]
