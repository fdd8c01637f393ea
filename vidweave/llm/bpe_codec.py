"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut before they reach the encoder, only where the splitting pattern is bound to end a
match: before a single ASCII space that stands between two characters which are not white space. A
match holds a space only as its first character or inside a run of white space, so no match can cross
such a place, and the ids of the parts joined are the ids of the whole.

Defined results: a null text counts as empty; an empty text has no ids, the hash of no bytes, and
decodes to no bytes. A null id stays null. Rows are independent, so repeated rows, ties and hot sources change nothing; an
empty table gives an empty result; columns other than the two named ones are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string"
_SAFE = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(maxsize=4)
def encoding(rank_path: str, pattern: str):
    """The tiktoken encoding of a rank file, without special tokens; one for each Python worker."""
    import tiktoken

    with open(rank_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, longest: int) -> Iterator[str]:
    """text in parts of about `longest` characters, cut at safe places only; a part without a safe
    place runs on to the next one."""
    start = 0
    while len(text) - start > longest:
        cut = _SAFE.search(text, start + longest)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def encode(text: str, enc, longest: int = 65_536) -> list[int]:
    if len(text) <= longest:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for part in safe_parts(text, longest):
        ids += enc.encode_ordinary(part)
    return ids


def decode(ids: list[int], enc) -> bytes:
    """The bytes of the ids, joined as they are: no character decoding, so nothing is replaced."""
    return enc.decode_bytes(ids)


def digests(df: DataFrame, rank_path: str, pattern: str, text_col: str = "text", id_col: str = "doc_id", longest: int = 65_536) -> DataFrame:
    """Each text encoded and decoded again: the number of ids and the hashes of ids and bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, sha = encoding(rank_path, pattern), hashlib.sha256
        for pdf in batches:
            n, of_ids, of_bytes = [], [], []
            for text in pdf["text"]:
                ids = encode(text, enc, longest)
                n.append(len(ids))
                of_ids.append(sha(",".join(map(str, ids)).encode()).hexdigest())
                of_bytes.append(sha(decode(ids, enc)).hexdigest())
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": n, "ids_sha256": of_ids, "decoded_sha256": of_bytes})

    # ids go as text: pandas would turn whole numbers with nulls among them into floats
    texts = df.select(F.col(id_col).cast("long").cast("string").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInPandas(run, SCHEMA).withColumn("doc_id", F.col("doc_id").cast("long"))
