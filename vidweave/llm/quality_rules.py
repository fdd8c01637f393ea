"""Quality rules by tokeniser fertility.

Public vocabularies measure the words of a text. One with byte fallback gives characters a token, the share of tokens
that are fallen-back bytes, and the entropy of the tokens: Shannon's over every `SPAN` tokens in a row, divided by that of
as many distinct ones, and the mean of these, so that a text's length leaves it as it is. A byte-level one (optional)
gives characters a token of its own, as text that looks usual to one vocabulary need not to another.

A text is rejected if a measure lies outside the band of its language, or of its script where the language has none.
Bands are fitted to the whole table, both ways: the middle three quarters of all distinct texts that pass the base
rules, and a margin on each side (bytes: above only, entropy: below only) of `width` times their spread. The spread has a floor
(`MEASURES`), so copies and near copies cannot close a band; up to about three quarters of a language's texts may
be copies of one text before its quantiles follow it. The margin grows where less is known: for a
short text by the square root of 1 + `SHORT` / words, for a band of few texts by 1 + `PRIOR` / texts. The base rules
reject texts of few words and texts in which repeated three-word windows cover most words.

The measures are written once to the shared folder, as the bands need all of them; they are a few numbers
a row, and so is what is shuffled to count each text once. Only the bands (at most one row for each of LANGUAGES and
script) reach the driver.

Words are runs without ASCII white space and are encoded one by one, so a measure does not depend on
where a text is cut, and a worker encodes each distinct word once (piece_memo).

Defined results: a null text counts as empty; an empty text has no words, measures of 0 and fails the
base rules. Whole texts are measured, whatever their length. Rows are independent, so repeated rows and
hot sources change nothing; a null language uses the script's band; a null id stays null; an empty table gives an empty result;
columns other than the named ones are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_codec import encode, encoding
from .common import slices, stored
from .piece_memo import PieceMemo, held, joined, words

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, chars_per_token double, byte_share double, token_entropy double, bpe_chars_per_token double, band string, text_hash long"
_ARROW = [*[pa.int64()] * 5, pa.bool_(), *[pa.float64()] * 4, pa.string()]
_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"

#: Languages with bands of their own; other texts are judged by script ("latin", "other").
LANGUAGES = ("en", "de", "es", "fr")

#: By measure: whether its band is bounded below, above, and the least spread that a margin is taken from.
MEASURES: dict[str, tuple[bool, bool, float]] = {
    "chars_per_token": (True, True, 0.1),
    "byte_share": (False, True, 0.02),
    "token_entropy": (True, False, 0.02),
    "bpe_chars_per_token": (True, True, 0.1),
}
SPAN, SHORT, PRIOR = 256, 100, 30


class Band(NamedTuple):
    low: float
    high: float
    margin: float


def vocabulary_memo(model_file: str, bpe: tuple[str, str] | None = None, most: int = 180_000) -> tuple[PieceMemo, np.ndarray]:
    """The worker's memo over the words of a sentencepiece vocabulary, and which of its ids are bytes. A word's ids end
    with a negative number: how many tokens it has in the byte-level vocabulary (rank file, pattern), after a space."""
    return held(("vocabulary", model_file, bpe, most), lambda: _vocabulary_memo(model_file, bpe, most))


def _vocabulary_memo(model_file: str, bpe: tuple[str, str] | None, most: int) -> tuple[PieceMemo, np.ndarray]:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
    is_byte = np.array([sp.is_byte(i) for i in range(sp.get_piece_size())])
    enc = encoding.__wrapped__(*bpe) if bpe else None  # goes with the memo

    def ids(ws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        texts = [w.decode() for w in ws]
        lists = sp.encode(texts, num_threads=1)
        if bpe:
            for text, held_ids in zip(texts, lists, strict=True):
                held_ids.append(-len(encode(" " + text, enc)))
        return joined(lists)

    return PieceMemo(ids, most), is_byte


def token_entropy(ids: np.ndarray) -> float:
    """The mean over every SPAN ids in a row (the last ones may be fewer, and weigh less) of their entropy over
    that of as many distinct ids."""
    n = len(ids)
    sizes = np.full(-(-n // SPAN), SPAN)
    sizes[-1] = n - SPAN * (len(sizes) - 1)
    keys, counts = np.unique(np.arange(n) // SPAN << 32 | ids, return_counts=True)
    of = keys >> 32
    share = counts / sizes[of]
    entropy = np.bincount(of, weights=-share * np.log2(share), minlength=len(sizes))
    return float((entropy / np.maximum(1.0, np.log2(sizes)) * sizes).sum() / n)


def repeat_words(numbers: np.ndarray) -> int:
    """Words covered by windows of three that occur twice or more; words are given by number."""
    if len(numbers) < 4:
        return 0
    _, dense = np.unique(numbers, return_inverse=True)
    keys = (dense[:-2] << 42) | (dense[1:-1] << 21) | dense[2:] if dense.max() < 1 << 21 else np.unique(np.stack([dense[:-2], dense[1:-1], dense[2:]], 1), axis=0, return_inverse=True)[1].ravel()
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    start = counts[inverse] > 1
    if not start.any():
        return 0
    cover = np.zeros(len(numbers), bool)
    for k in range(3):
        cover[k : k + len(start)] |= start
    return int(cover.sum())


def script_of(text: str) -> str:
    """latin where most letters are in the Latin blocks below U+0250, else other."""
    letters = {c: n for c, n in Counter(text).items() if c.isalpha()}
    return "latin" if sum(n for c, n in letters.items() if c < "ɐ") * 2 >= sum(letters.values()) else "other"


def measure(df: DataFrame, model_file: str, bpe: tuple[str, str] | None = None, min_words: int = 50, most_repeated_percent: int = 50, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang", carry: tuple[str, ...] = ()) -> DataFrame:
    """The base measures and the fertility measures of every row, after the columns named in `carry`. Without `bpe` (a
    rank file and the pattern that cuts words), bpe_chars_per_token is null and has no band."""

    schema = ", ".join([*(f"carried_{c} {df.schema[c].dataType.simpleString()}" for c in carry), SCHEMA])
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, is_byte = vocabulary_memo(model_file, bpe)
        for batch in batches:
            texts = [t or "" for t in batch.column("_text").to_pylist()]
            langs = batch.column("_lang").to_pylist()
            for start, end in slices(map(len, texts)):
                rows = []
                memo.begin()
                split = [words(t) for t in texts[start:end]]
                numbers = [memo.numbers(w) for w in split]
                memo.settle()
                for text, ws, nums, lang in zip(texts[start:end], split, numbers, langs[start:end], strict=True):
                    raw = text.encode()
                    n, chars = len(ws), len(text) - (len(raw) - len(raw.translate(None, _SPACE)))
                    lines = [x for x in raw.split(b"\n") if x.strip(_SPACE)]
                    repeated = repeat_words(nums)
                    failed = n < min_words or 100 * repeated > most_repeated_percent * n
                    ids = memo.ids(nums)
                    per_token = share = entropy = 0.0
                    bpe_per_token = 0.0 if bpe else None
                    if bpe and len(ids):
                        bpe_per_token, ids = chars / -int(ids[ids < 0].sum(dtype=np.int64)), ids[ids >= 0]
                    if len(ids):
                        per_token, share, entropy = chars / len(ids), float(is_byte[ids].mean()), token_entropy(ids)
                    band = lang if lang in LANGUAGES else script_of(text)
                    rows.append((n, chars, len(raw) - len(raw.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeated, failed, per_token, share, entropy, bpe_per_token, band))
                part = batch.slice(start, end - start)
                carried = [part.column("_text" if c == text_col else c) for c in carry]
                measures = [pa.array(x, _ARROW[k]) for k, x in enumerate(zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays([*carried, part.column("_id"), *measures, part.column("_hash")], names=[*(f"carried_{c}" for c in carry), *names])

    others = [F.col(c) for c in carry if c != text_col]
    texts = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang"), F.xxhash64(text_col).alias("_hash"), *others)
    return texts.mapInArrow(run, schema)


def fit_bands(measured: DataFrame, width: float = 2.5) -> dict[str, dict[str, Band]]:
    """By language or script and measure: the octiles around the middle of the distinct texts that pass the base rules,
    and the margin of a long text. Texts of one hash and equal measures count once."""
    texts = measured.where("NOT base_failed").select("band", "text_hash", *MEASURES).distinct()
    octiles = [F.percentile_approx(c, F.array(F.lit(0.125), F.lit(0.875)), F.lit(10_000)).alias(c) for c in MEASURES]
    bands: dict[str, dict[str, Band]] = {}
    for r in texts.groupBy("band").agg(F.count(F.lit(1)).alias("n"), *octiles).collect():
        bands[r["band"]] = {c: Band(*r[c], width * max(r[c][1] - r[c][0], least) * (1 + PRIOR / r["n"])) for c, (_, _, least) in MEASURES.items() if r[c]}
    return bands


def judge(measured: DataFrame, bands: dict[str, dict[str, Band]]) -> DataFrame:
    """measured with the verdict `kept`."""
    slack, inside = F.sqrt(1 + SHORT / F.greatest(F.col("n_words"), F.lit(1))), F.lit(False)
    for name, measures in bands.items():
        fits = F.col("band") == name
        for c, (low, high, margin) in measures.items():
            below, above, _ = MEASURES[c]
            if below:
                fits = fits & (F.col(c) >= low - slack * margin)
            if above:
                fits = fits & (F.col(c) <= high + slack * margin)
        inside = inside | fits
    return measured.drop("text_hash").withColumn("kept", ~F.col("base_failed") & inside)


def apply_rules(df: DataFrame, model_file: str, bpe: tuple[str, str] | None = None, width: float = 2.5, **measure_args) -> DataFrame:
    """Every row's measures and verdict, by bands fitted to all rows."""
    measured = stored(measure(df, model_file, bpe, **measure_args), "quality-measures")
    return judge(measured, fit_bands(measured, width))


def kept_rows(df: DataFrame, model_file: str, bpe: tuple[str, str] | None = None, width: float = 2.5) -> DataFrame:
    """The rows of df that pass, with df's columns; no text is shuffled."""
    measured = stored(measure(df, model_file, bpe, carry=tuple(df.columns)), "quality-measures")
    return judge(measured, fit_bands(measured, width)).where("kept").select([F.col(f"carried_{c}").alias(c) for c in df.columns])
