"""Queries that take all rows and whole lines of the given tables, against plain Python on a small fixture."""

import hashlib
import re

import pytest

from vidweave.plans import registry

LINES = ["Der schöne Weg führt über die Brücke.", "Der schone Weg führt, über die Bruecke!", "word " * 30 + "end", "word " * 29 + "an end", "año ÉTÉ straße", "漢字 and kana，。", "漢字 und Kana,.", "x" * 61 + "a", "x" * 61 + "b"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    rows = [(1, "\n".join(LINES), "de", "src1", 9), (2, "\n".join(reversed(LINES)), None, "src2", 9), (3, "one line", "en", "src3", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return path


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def cer(h, r):
    h, r = (re.sub(r"[ \t\n\x0b\f\r]+", "", x).translate(str.maketrans("，。", ",.")).lower() for x in (h, r))
    return min(1.0, distance(h, r) / len(r))


def pairs():
    return [(doc, k, ls[k], ls[k + 1]) for doc, ls in ((1, LINES), (2, LINES[::-1])) for k in range(len(ls) - 1)]


def test_error_rates_and_reports_take_whole_lines(spark, folder):
    got = {(r["video_id"], r["segment_index"]): r["cer"] for r in registry.queries()["f2_cer"](spark, folder).collect()}
    assert got == {(v, k): pytest.approx(cer(a, o), abs=1e-6) for v, k, a, o in pairs()}
    for r in registry.queries()["f4_fusion_report"](spark, folder).collect():
        own = [(k, a, o) for v, k, a, o in pairs() if v == r["video_id"]]
        seen = [x for x in own if x[0] % 3]
        rates, fused = [cer(a, o) for _, a, o in seen], [0.0 if k % 2 == 0 else cer(a, o) for k, a, o in seen]
        assert (r["sampled"], r["hits"], r["replacements"]) == (len(own), len(seen), sum(k % 2 == 0 for k, _, _ in seen))
        assert (r["cer"], r["fused_cer"]) == (pytest.approx(sum(rates) / len(rates), abs=6e-5), pytest.approx(sum(fused) / len(fused), abs=6e-5))


def test_fusions_keep_whole_lines(spark, folder):
    f3 = {(r["video_id"], r["segment_index"]): {r["conservative"], r["strong_visual"], r["low_confidence"]} for r in registry.queries()["f3_fuse_text"](spark, folder).collect()}
    assert f3.keys() == {(v, k) for v, k, _, _ in pairs()} and all(f3[v, k] <= {md5(a.strip()), md5(o.strip())} for v, k, a, o in pairs())
    put = {(v, k): o for v, k, _, o in pairs() if k % 4 == 0}
    lines = {(v, k): x for v, ls in ((1, LINES), (2, LINES[::-1]), (3, ["one line"])) for k, x in enumerate(ls)}
    got = {r["id"]: (r["applied"], r["content_md5"]) for r in registry.queries()["f5_apply_fusion"](spark, folder).collect()}
    assert got == {v * 100000 + k: ((v, k) in put, md5(put.get((v, k), x))) for (v, k), x in lines.items()}


def test_every_language_is_processed(spark, folder, tmp_path):
    texts = {1: ("de", "Die Erthe  a.b ERTH ſ"), 2: (None, "tierra erth A.B"), 3: ("en", "earth Erth"), 4: ("fr", "été")}
    spark.createDataFrame([(k, t, lang, "src1", 9) for k, (lang, t) in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["text_md5"] for r in registry.queries()["b7_apply_glossary"](spark, str(tmp_path)).collect()}
    plain = lambda t: re.sub(r"(?i)a\.b", "AB", re.sub("(?i)erth", "Erth$1", re.sub(" +", " ", t)))
    assert got == {k: md5(plain(t)) for k, (_, t) in texts.items()}
    rows = registry.queries()["a2_parse_asr_json"](spark, folder).collect()
    want = {(v, "unknown", k, k * 1000, k * 1000 + (900 if k % 2 == 0 else 1)) for v, n in ((1, len(LINES)), (2, len(LINES)), (3, 1)) for k in range(n)}
    assert len(rows) == len(want) and {tuple(r[c] for c in ("video_id", "language", "segment_index", "start_ms", "end_ms")) for r in rows} == want


def test_fusion_gates(spark):
    from pyspark.sql import functions as F

    from vidweave.operators import quality as Q

    rows = [
        ("", "a seen line", 0.90, "", "", ""), ("", "a seen line", 0.95, "", "a seen line", ""), ("", "a seen line", 0.97, "", "a seen line", "a seen line"), ("", "a seen line", 0.99, "a seen line", "a seen line", "a seen line"),
        ("", "short", 0.99, "", "short", "short"), ("", "1234567890", 0.99, "1234567890", "", ""), ("a spoken line", "Ã Â å æ ç è é ð line", 0.99, "a spoken line", "a spoken line", "a spoken line"),
        ("open code code now", "open claudecode now please, everyone of you in this room", 0.90, "open Claude Code now",) + ("open Claude Code now",) * 2,
    ]
    df = spark.createDataFrame(rows, "a string, o string, c double, conservative string, strong_visual string, low_confidence string")
    got = df.select("*", *[Q.fuse_text(F.col("a"), F.col("o"), F.col("c"), m).alias(f"got_{m.lower()}") for m in Q.FUSION_MODES]).collect()
    for r in got:
        assert tuple(r)[6:] == tuple(r)[3:6], r
    wrong = "今天我们学习".encode().decode("latin-1")
    fused = spark.createDataFrame([(wrong, "", 0.99), ("", wrong, 0.99), (wrong, "今天我们学", 0.5), (None, None, None)], "a string, o string, c double")
    assert [r[0] for r in fused.select(Q.fuse_text(F.col("a"), F.col("o"), F.col("c"), "STRONG_VISUAL")).collect()] == ["今天我们学习", "今天我们学习", "今天我们学习", ""]
    one = spark.createDataFrame([("這個句子很長很好", "这個句子很長很好", 0.97)], "a string, o string, c double")
    assert one.select(Q.fuse_text(F.col("a"), F.col("o"), F.col("c"), "LOW_CONFIDENCE", traditional="這"), Q.fuse_text(F.col("a"), F.col("o"), F.col("c"), "LOW_CONFIDENCE")).first()[:] == ("这個句子很長很好", "這個句子很長很好")
