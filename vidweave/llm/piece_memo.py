"""Token ids by text piece: each distinct piece is encoded once in a worker, then looked up.

Tokenizers split a text at white space before they merge, so a text's ids are the ids of its pieces
joined, as long as it is cut only where no token can cross. Natural text repeats its words, so a worker
encodes a small share of all pieces. When a memo holds too many pieces it forgets the rarer ones, so its
memory is bounded. A worker keeps its memos from task to task.
"""

from __future__ import annotations

import ctypes
import gc
import os
import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RARE = re.compile("[\x1c-\x1f]")
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")


_slot: dict = {}


def held(key: tuple, make: Callable):
    """What make() gives, kept in this worker from task to task until another key is asked for: a worker that
    runs one operator after another holds the memo of one of them only."""
    if key not in _slot:
        release()
        _slot[key] = make()
    return _slot[key]


def release() -> None:
    """Gives up the memo that this worker holds, and its memory. Operators without a memo call it, as a worker
    that ran another one before still has that one's."""
    if _slot:
        _slot.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's; others give memory back by themselves
        if trim:
            trim(0)


class _Index(dict):
    """Numbers keys in the order they come; keeps the new ones."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list = []

    def __missing__(self, key):
        n = self[key] = len(self)
        self.new.append(key)
        return n


class PieceMemo:
    """encode_many takes a list of pieces and gives the number of ids of each, where they start, and all
    ids in one array."""

    def __init__(self, encode_many: Callable[[list], tuple[np.ndarray, np.ndarray, np.ndarray]], most: int = 300_000) -> None:
        self._encode_many, self._most = encode_many, most
        self._clear()

    def _clear(self) -> None:
        self._index = _Index()
        self.lengths = np.zeros(0, np.int64)
        self._starts = np.zeros(0, np.int64)
        self._flat = np.zeros(0, np.int32)
        self._seen = np.zeros(0, np.int64)

    def begin(self) -> None:
        """Numbers given out before may be void from here on."""
        if self._index.new or len(self._index) <= self._most:
            return
        keep = np.sort(np.argpartition(-self._seen, self._most // 3)[: self._most // 3])
        pieces, flat, lengths = list(self._index), self.ids(keep), self.lengths[keep]
        self._clear()
        for k in keep.tolist():
            self._index[pieces[k]]
        self._index.new = []
        self.lengths, self._flat = lengths, flat
        self._starts = np.cumsum(lengths) - lengths
        self._seen = np.zeros(len(keep), np.int64)

    def numbers(self, pieces: list, times: np.ndarray | None = None) -> np.ndarray:
        """The pieces' numbers. times: how often each occurs, if not once."""
        out = np.fromiter(map(self._index.__getitem__, pieces), np.int64, len(pieces))
        known = out < len(self._seen)
        self._seen += np.bincount(out[known], None if times is None else times[known], len(self._seen)).astype(np.int64)
        return out

    def settle(self) -> None:
        """Encodes the pieces that are new."""
        if not self._index.new:
            return
        lengths, starts, flat = self._encode_many(self._index.new)
        self._starts = np.concatenate([self._starts, len(self._flat) + starts])
        self.lengths = np.concatenate([self.lengths, lengths])
        self._flat = np.concatenate([self._flat, flat])
        self._seen = np.concatenate([self._seen, np.ones(len(lengths), np.int64)])
        self._index.new = []

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of the pieces, joined."""
        lengths = self.lengths[numbers]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self._flat[np.repeat(self._starts[numbers] - (ends - lengths), lengths) + np.arange(total)]

    def id_lists(self, piece_lists: list[list]) -> list[np.ndarray]:
        """The ids of each list of pieces, all looked up at once."""
        self.begin()
        numbers = self.numbers(list(chain.from_iterable(piece_lists)))
        self.settle()
        return self._split(numbers, np.fromiter(map(len, piece_lists), np.int64, len(piece_lists)))

    def spaced_id_lists(self, texts: list[str]) -> list[np.ndarray]:
        """id_lists of the spaced_pieces of each text; only distinct pieces become Python strings and are looked up."""
        if any(_MARK in t for t in texts):
            return self.id_lists([spaced_pieces(t) for t in texts])
        pieces, which, counts = distinct_pieces(texts)
        self.begin()
        numbers = self.numbers(pieces, np.bincount(which, minlength=len(pieces)))[which]
        self.settle()
        return self._split(numbers, counts)

    def _split(self, numbers: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
        """The ids of runs of pieces, of so many pieces each."""
        ends = np.cumsum(self.lengths[numbers])
        return np.split(self.ids(numbers), np.append(0, ends)[np.cumsum(counts)[:-1]])[: len(counts)]


def words(text: str) -> list[bytes]:
    """The text's runs without ASCII white space, as UTF-8."""
    return text.encode().split()


def spaced_pieces(text: str) -> list[str]:
    """The text cut where no match of the byte-level splitting pattern can cross: before each single
    space, and around each single line feed, between two characters that are not white space. Where a
    text has other white space, it is cut before single spaces and line feeds only."""
    out: list[str] = []
    for line in text.split("\n"):
        ws = line.split()
        if not ws or " ".join(ws) != line:
            return _CUT.split(text) if text else []
        out.append(ws[0])
        out += [" " + w for w in ws[1:]]
        out.append("\n")
    out.pop()
    return out


_MARK = "\0"
_ODD = ("  ", "\n\n", " \n", "\n ", *"\t\x0b\x0c\r\x1c\x1d\x1e\x1f")
_ODD_WIDE = (*_ODD, *(c for c in map(chr, range(0x80, 0x3001)) if c.isspace()))


def marked(text: str) -> str:
    """The spaced_pieces of a text without _MARK, joined by it."""
    if text and text[0] not in " \n" and text[-1] not in " \n" and not any(c in text for c in (_ODD if text.isascii() else _ODD_WIDE)):
        return text.replace("\n", f"{_MARK}\n{_MARK}").replace(" ", f"{_MARK} ")
    return _MARK.join(spaced_pieces(text))


def distinct_pieces(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The distinct spaced_pieces of texts without _MARK, which of them each piece of each text is, and how many
    pieces each text has (one empty piece, if it is empty)."""
    lists = pc.split_pattern(pa.array(map(marked, texts), pa.large_string()), _MARK)
    coded = lists.values.dictionary_encode()
    one = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary)
    pieces = pc.binary_join(one, pa.scalar(_MARK, pa.large_string()))[0].as_py().split(_MARK)
    return pieces, coded.indices.to_numpy(), np.diff(lists.offsets.to_numpy())


def joined(lists: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Id lists as what a PieceMemo wants."""
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    return lengths, np.cumsum(lengths) - lengths, np.fromiter((i for ids in lists for i in ids), np.int32, int(lengths.sum()))


def library_memo(file: str, mark: str, lower: bool = False, pack: int = 512, most: int = 300_000, most_cores: int = 500_000) -> PieceMemo:
    """The worker's memo over a tokenizer of the tokenizers library, see _library_memo."""
    return held(("library", file, mark, lower, pack, most, most_cores), lambda: _library_memo(file, mark, lower, pack, most, most_cores))


def core_and_tail(piece: str, lower: bool) -> tuple[str, str]:
    """A piece cut before its closing punctuation, if that follows a letter, where the splitting patterns of word
    and byte-level tokenizers always end a match. With `lower` (for tokenizers that lower-case their input), ASCII
    pieces are lower-cased, so that the forms of a word are one core."""
    if lower and piece.isascii():
        piece = piece.lower()
    core = piece.rstrip(".,;:?!")
    last = core[-1:]  # of a script that all versions of the libraries' tables hold; a dotted capital I becomes letter and mark
    return (core, piece[len(core) :]) if last.isalpha() and last < "\u0530" and last != "\u0130" else (piece, "")


def _library_memo(file: str, mark: str, lower: bool, pack: int, most: int, most_cores: int) -> PieceMemo:
    """A memo over a tokenizer of the tokenizers library; special tokens' strings are plain text. Pieces (str, or
    UTF-8 bytes) that are new are cut into core and tail, which have a memo of their own, as most new pieces are
    known cores. New cores are encoded many at a time with `mark` between them, a string that the tokenizer always
    makes one id of its own; cores that hold its character themselves are encoded alone."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(file)
    tokenizer.encode_special_tokens = True
    (mark_id,) = tokenizer.encode(mark, add_special_tokens=False).ids
    char = mark.strip(" ")

    def ids_of(texts: list[str]) -> list:
        return [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_cores(pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        alone = [k for k, p in enumerate(pieces) if not p or char in p]
        rest = [k for k, p in enumerate(pieces) if p and char not in p]
        packs = [rest[k : k + pack] for k in range(0, len(rest), pack)]
        lengths, order, flats = np.zeros(len(pieces), np.int64), [], []
        for of, ids in zip(packs, ids_of([mark.join([pieces[k] for k in of]) for of in packs]), strict=True):
            array = np.array(ids, np.int32)
            marks = array == mark_id
            at = np.flatnonzero(marks)
            if len(at) == len(of) - 1:
                lengths[of] = np.diff(np.concatenate([[-1], at, [len(array)]])) - 1
                flats.append(array[~marks])
                order += of
            else:
                alone += of
        for k, ids in zip(alone, ids_of([pieces[k] for k in alone]), strict=True):
            lengths[k] = len(ids)
            flats.append(np.array(ids, np.int32))
            order.append(k)
        starts = np.zeros(len(pieces), np.int64)
        starts[order] = np.cumsum(lengths[order]) - lengths[order]
        return lengths, starts, np.concatenate(flats) if flats else np.zeros(0, np.int32)

    cores = PieceMemo(encode_cores, most_cores)

    def encode_many(pieces: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cores.begin()
        cut = (core_and_tail(p.decode() if isinstance(p, bytes) else p, lower) for p in pieces)
        numbers = cores.numbers(list(chain.from_iterable(cut)))
        cores.settle()
        lengths = cores.lengths[numbers].reshape(-1, 2).sum(1)
        return lengths, np.cumsum(lengths) - lengths, cores.ids(numbers)

    return PieceMemo(encode_many, most)
