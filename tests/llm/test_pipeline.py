"""The stages of the corpus pipeline against plain Python, on texts made for each decision."""

import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import corpus_pipeline

from .test_search_and_dedup import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "river stone garden letter window market silver bridge winter morning travel paper simple mother island answer camera doctor engine flower".split()


def prose(seed, n=90):
    rng = np.random.default_rng(seed)
    words = [f"{WORDS[i]}" if k % 3 else f"{WORDS[i]}{WORDS[(i + k) % 20]}" for k, i in enumerate(rng.integers(0, 20, n).tolist())]
    return "\n".join(" ".join(words[k : k + 9]).capitalize() + "." for k in range(0, n, 9))


def rows():
    clean = [prose(k) for k in range(12)]
    near = clean[3].replace("\n", " ").split()
    near[-1] = "changed"
    texts = [*clean, None, "", "too short", "spam " * 200, "x# $ % & * | < > " * 40, clean[0], " ".join(near), "Intro line here now.\n" + "\n".join(clean[5].split("\n")[:4]) + "\n" + prose(50)]
    return [(k, t, "en", "src", len(t or "")) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage was given and what it gave, as {name: (rows in, rows out)}."""
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows(), SCHEMA).write.parquet(f"{d}/documents.parquet")
    out, docs = {}, spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        made = corpus_pipeline.stored(stage(spark, docs, d), name)
        out[name] = (docs.collect(), made.collect())
        docs = made
    out["run"] = (None, corpus_pipeline.run(spark, d).collect())
    return out


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "line_dedup", "ngram_join", "best_fit_packing"]
    for name in list(stages)[:4]:
        assert all(set(r.asDict()) == {"doc_id", "text", "lang", "source", "n_chars"} for r in stages[name][1])


def test_rejections(stages):
    """The base rules by count; clean documents pass both quality stages; what stays is unchanged."""
    given, kept = stages["quality_rules"]
    want = set()
    for r in given:
        w = (r["text"] or "").split()
        wins = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        covered = {k + j for k, x in enumerate(wins) if wins.count(x) > 1 for j in range(3)}
        if len(w) >= 50 and 100 * len(covered) <= 50 * len(w):
            want.add(r["doc_id"])
    assert {r["doc_id"] for r in kept} <= want and {r["doc_id"] for r in kept} >= {*range(12), 17, 18, 19}
    given, kept = stages["quality_classifier"]
    assert {tuple(r) for r in kept} <= {tuple(r) for r in given} and {r["doc_id"] for r in kept} >= {*range(12), 17, 18, 19}


def test_lines_go_once(stages):
    given, kept = stages["line_dedup"]
    seen, want = set(), {}
    for r in sorted(given, key=lambda r: r["doc_id"]):
        lines = r["text"].split("\n")
        at = [k for k, x in enumerate(lines) if x.strip()]
        wins = [at[k : k + 3] for k in range(max(1, len(at) - 2))]
        gone = set()
        for win in wins:
            key = tuple(lines[k].strip() for k in win)
            gone |= set(win) if key in seen else set()
            seen.add(key)
        want[r["doc_id"]] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    assert {r["doc_id"]: r["text"] for r in kept} == want and want[17] == "" and want[19].startswith("Intro line")
    assert all(r["n_chars"] == len(r["text"]) for r in kept)


def test_one_of_each_group_stays(stages):
    given, kept = stages["ngram_join"]
    found = brute([(r["doc_id"], r["text"]) for r in given], 5, 80)
    assert {r["doc_id"] for r in kept} == {i for i, (_, c) in found.items() if c == i} and 18 not in {r["doc_id"] for r in kept}


def test_packed_pieces(stages):
    given, kept = stages["best_fit_packing"]
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    want = set()
    for r in given:
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        want |= {(r["doc_id"], k // 2048, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)}
    pieces = lambda out: {(r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in out}
    assert pieces(kept) == want == pieces(stages["run"][1]) and len(kept) == len(want)


def test_hostile_tables(spark, hostile, tmp_path):
    """Null and odd texts, rows without an id, and an empty table go through all stages."""
    docs = hostile.selectExpr("doc_id", "text", "lang", "source", "n_chars").union(spark.createDataFrame([(None, prose(1), None, None, None)], SCHEMA))
    for k, df in enumerate((docs, docs.limit(0))):
        df.write.parquet(str(tmp_path / f"{k}" / "documents.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / f"{k}")).collect()
        assert [r["doc_id"] for r in out] == ([None] if k == 0 else [])
