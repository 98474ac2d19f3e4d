"""The tokenizers library behind the chunk cache: texts to little-endian 32-bit ids."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from seepkit.llm.chunks import TwoGenerations, encode_texts, plain
from seepkit.llm.workers import cache

#: Missing chunks joined into one call of the library.
JOIN = 1_000
_ENCODERS = cache("encoders")


def encoder(path: str, kind: str, special_as_text: bool = False) -> TextEncoder:
    """One encoder per worker process, file and kind, until a task of another operator needs the memory."""
    key = (path, kind, special_as_text)
    if key not in _ENCODERS:
        _ENCODERS[key] = TextEncoder(*key)
    return _ENCODERS[key]


def largest_id(path: str) -> int:
    """The largest id that a tokenizer file can give."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values(), default=0)


class TextEncoder:
    """kind: ``bytes`` (byte-level pattern that keeps white space) or ``words`` (drops it).

    A special token's string in a text gives that token's id, as the library does by default;
    ``special_as_text`` encodes it like any other text.
    """

    def __init__(self, path: str, kind: str, special_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = special_as_text
        self.kind = kind
        self.mark = "\n" if kind == "bytes" else " \x02 "
        self.mark_ids = self._ids(self.mark)
        if len(self.mark_ids) != 1:
            self.mark_ids = None
        self.cache = TwoGenerations(self._missing)

    def _ids(self, text: str) -> np.ndarray:
        return np.asarray(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _joined(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that hold no mark, a few thousand to a call, cut at the mark's id."""
        out: list[bytes] = []
        for i in range(0, len(texts), JOIN):
            some = texts[i : i + JOIN]
            ids = self._ids(self.mark.join(some))
            cuts = np.flatnonzero(ids == self.mark_ids[0])
            if len(cuts) != len(some) - 1:
                out += [self._ids(x).tobytes() for x in some]
                continue
            raw, edges = ids.tobytes(), [-4, *(cuts * 4).tolist(), len(ids) * 4]
            out += [raw[a + 4 : b] for a, b in zip(edges, edges[1:], strict=False)]
        return out

    def _missing(self, pieces: list[str]) -> list[bytes]:
        made: dict[str, bytes] = {}
        if self.mark_ids is not None and self.kind == "words":
            simple = [x for x in pieces if x.isprintable() and x and not x.isspace()]
            made.update(zip(simple, self._joined(simple), strict=True))
        elif self.mark_ids is not None:
            spaced = [x for x in pieces if x.isprintable() and " " not in x and x or plain(x)]
            made.update(zip(spaced, self._joined([" " + x for x in spaced]), strict=True))
            lines = [x for x in pieces if x[:1] == "\n" and plain(x[1:])]
            head = self.mark_ids.tobytes()
            made.update((x, head + ids) for x, ids in zip(lines, self._joined([x[1:] for x in lines]), strict=True))
        if len(made) < len(pieces):
            for x in pieces:
                if x in made:
                    continue
                if self.kind == "bytes" and x[:1] == "\n":  # the newline is ours
                    made[x] = self.mark_ids.tobytes() + self._ids(x[1:]).tobytes()
                else:
                    made[x] = self._ids(x).tobytes() if x else b""
        return [made[x] for x in pieces]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Each text's ids as unsigned 32-bit integers; none for null or empty."""
        first = int(self.kind == "bytes")
        return [ids[a + first : b] for _, _, ids, at in encode_texts(texts, self.kind, self.cache) for a, b in zip(at, at[1:], strict=False)]

    def encode_ended(self, texts: pa.Array, end_id: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, last row + 1, flat ids, n + 1 offsets) by runs of rows, ``end_id`` behind each text."""
        for lo, hi, ids, at in encode_texts(texts, self.kind, self.cache):
            if self.kind == "bytes":  # the newlines' places, but the first, are the ends of the texts before
                out = np.append(ids[1:], np.uint32(end_id))
                out[at[1:] - 1] = end_id
                yield lo, hi, out, at
            else:
                yield lo, hi, np.insert(ids, at[1:], end_id), at + np.arange(len(at))
