"""Whole-text encoding by cached chunks.

A text is cut where no tokenizer rule can look across the cut, each distinct chunk is encoded once
per worker, and a document's ids are its chunks' ids joined. The cuts depend on the pattern:

* byte-level patterns start a new match at a lone space or newline between two other characters,
  because a space occurs only at the start of a match and a white-space run of length one is never
  split further;
* the word vocabulary drops white space, so every run of it is a cut.

The cache has two generations of at most ``CACHE`` chunks, so its memory is bounded while chunks
that recur stay in it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Chunks per cache generation and characters beyond which a chunk isn't kept.
CACHE, LONGEST = 400_000, 64
#: White space other than a lone space or newline between two other characters.
ODD = "[\\t\\x0b-\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]|[ \\n][ \\n]|^[ \\n]|[ \\n]$"
_INNER = re.compile(r"(?<=\S)(?= \S)")


class TwoGenerations:
    """Chunk -> encoded bytes; ``encode_missing`` maps a list of chunks to a list of values."""

    def __init__(self, encode_missing, size: int = CACHE):
        self.encode_missing, self.size = encode_missing, size
        self.young: dict = {}
        self.old: dict = {}

    def load(self, pieces: list[str]) -> list[bytes]:
        """The value of every chunk of ``pieces``, which are distinct."""
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        values = list(map(young.get, pieces))
        absent = [i for i, v in enumerate(values) if v is None]
        missing = []
        for i in absent:
            x = pieces[i]
            if (v := old.get(x)) is None:
                missing.append(i)
            else:
                values[i] = young[x] = v
        for i, v in zip(missing, self.encode_missing([pieces[i] for i in missing]), strict=True):
            values[i] = v
            if len(pieces[i]) <= LONGEST:
                young[pieces[i]] = v
        return values


def byte_level_pieces(text: str) -> list[str]:
    """Chunks of any text: the first has a newline put before it; the others stand for themselves
    with a space before them, or start with a space or newline of their own."""
    cut = _INNER.split(text)
    return ["\n" + cut[0], *(x[1:] if plain(x[1:]) else x for x in cut[1:])]


def plain(piece: str) -> bool:
    """Whether the piece stands for itself with a space before it."""
    return bool(piece) and not piece[0].isspace() and len(piece.split()) == 1 and not piece[-1].isspace()


def _piece_lists(texts: pa.Array, kind: str) -> pa.Array:
    """A list of chunks per text; null is empty, and an empty text has one chunk at most."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if kind == "words":
        pieces = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        return pieces
    odd = pc.match_substring_regex(texts, ODD)
    lined = pc.replace_substring(pc.binary_join_element_wise(*(pa.scalar(x, pa.large_string()) if isinstance(x, str) else x for x in ("\n", texts, ""))), "\n", " \n")
    pieces = pc.split_pattern(pc.utf8_slice_codeunits(lined, 1), " ")
    if not pc.any(odd).as_py():
        return pieces
    own = [byte_level_pieces(x) if o else None for x, o in zip(texts.to_pylist(), odd.to_pylist(), strict=True)]
    return pc.if_else(odd, pa.array(own, pieces.type), pieces)


def encode_texts(texts: pa.Array, kind: str, cache: TwoGenerations) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, flat ids, n + 1 offsets) by runs of rows; with ``bytes`` each text's ids
    come after one for the newline put before it. Each distinct chunk of a run is looked up once; the
    rest is array work."""
    for lo, hi in _slices(texts):
        lists = _piece_lists(texts.slice(lo, hi - lo), kind)
        coded = lists.flatten().dictionary_encode()
        values = pa.array(cache.load(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary())
        made = values.take(coded.indices)
        _, ends, data = made.buffers()
        ends = np.frombuffer(ends, np.int64)[made.offset : made.offset + len(made) + 1] >> 2 if len(made) else np.zeros(1, np.int64)
        at = ends[np.asarray(lists.offsets) - lists.offsets[0].as_py()]
        ids = np.frombuffer(data, "<u4", count=int(at[-1])) if at[-1] else np.zeros(0, "<u4")
        yield lo, hi, ids, at


def _slices(texts: pa.Array, most: int = 4_000_000):
    """Runs of rows of about ``most`` bytes."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    lo = total = 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)
