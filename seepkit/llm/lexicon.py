"""Byte-level BPE by a lexicon: a minimal acyclic transducer of frequent words, exact merges for the rest.

A word is what stands between lone spaces, with the space before it (see ``chunks``). Words are counted
over all texts; the most frequent ones are compiled with their ids:

* the automaton is minimal (states with equal futures are one) and acyclic; its arcs carry numbers that
  add up to the word's place among all words in byte order;
* a flat table gives the ids at that place.

The compiled file lies in the shared folder and is memory-mapped by the workers, which walk it for all
distinct words of a run of texts at once. What it doesn't accept is split into pre-tokens; those that
are words of the lexicon are looked up too, the others are merged, again many at once.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seepkit.llm.chunks import _piece_lists, _slices, plain
from seepkit.llm.staging import delete, file_system, new_path

#: Words in a lexicon, at most: the most frequent; and the bytes of the longest. Others are merged.
WORDS, LONGEST = 1 << 18, 48
#: Bytes of text that are encoded at a time; widest rows of the merging in blocks.
RUN, WIDE = 4_000_000, 64
#: No merge: above every rank.
NONE = np.iinfo(np.int32).max
_MODELS: dict = {}
_LEXICONS: dict = {}


class Automaton:
    """Minimal acyclic automaton of byte strings that come in ascending order, none twice.

    The path of the last word is still open; a state is closed, that is, replaced by an equal one if
    there is any, once a later word has left it.
    """

    def __init__(self, words: list[bytes]):
        self.arcs: list[dict[int, int]] = [{}]
        self.final = [False]
        self.equal: dict[tuple, int] = {}
        free: list[int] = []
        path, last = [0], b""
        for word in words:
            same = 0
            for a, b in zip(last, word, strict=False):
                if a != b:
                    break
                same += 1
            self._close(path, last, same, free)
            for byte in word[same:]:
                if free:
                    state = free.pop()
                    self.arcs[state], self.final[state] = {}, False
                else:
                    state = len(self.arcs)
                    self.arcs.append({})
                    self.final.append(False)
                self.arcs[path[-1]][byte] = state
                path.append(state)
            self.final[path[-1]] = True
            last = word
        self._close(path, last, 0, free)

    def _close(self, path: list[int], word: bytes, depth: int, free: list[int]) -> None:
        while len(path) > depth + 1:
            state = path.pop()
            future = (self.final[state], *self.arcs[state].items())
            known = self.equal.setdefault(future, state)
            if known != state:
                self.arcs[path[-1]][word[len(path) - 1]] = known
                free.append(state)

    def compiled(self) -> dict[str, np.ndarray]:
        """Arcs sorted by (state, byte): ``keys`` = state << 8 | byte, ``targets`` and ``adds``; a bit a state
        for ``final``."""
        number, order = {0: 0}, [0]
        for state in order:  # states that can be reached, by first sight
            for to in self.arcs[state].values():
                if to not in number:
                    number[to] = len(order)
                    order.append(to)
        words: dict[int, int] = {}  # words from a state on; states close after those they lead to
        stack = [0]
        while stack:
            state = stack[-1]
            missing = [to for to in self.arcs[state].values() if to not in words]
            if missing:
                stack += missing
            else:
                words[state] = self.final[state] + sum(words[to] for to in self.arcs[state].values())
                stack.pop()
        keys, targets, adds = [], [], []
        for state in order:
            before = int(self.final[state])
            for byte, to in self.arcs[state].items():
                keys.append(number[state] << 8 | byte)
                targets.append(number[to])
                adds.append(before)
                before += words[to]
        made = {k: np.asarray(v, np.uint32) for k, v in (("keys", keys), ("targets", targets), ("adds", adds))}
        return made | {"final": np.asarray([self.final[s] for s in order], np.uint8)}


class Lexicon:
    """The compiled arrays, by memory map where the file is local."""

    FIELDS = (("keys", np.uint32), ("targets", np.uint32), ("adds", np.uint32), ("final", np.uint8), ("ends", np.uint32), ("ids", np.uint32))

    def __init__(self, path: str | None):
        sizes = [0] * len(self.FIELDS)
        if path:
            from pyarrow.fs import LocalFileSystem

            fs, inner = file_system(path)
            if isinstance(fs, LocalFileSystem):
                raw = np.memmap(inner, np.uint8, mode="r")
            else:
                with fs.open_input_file(inner) as f:
                    raw = np.frombuffer(f.read(), np.uint8)
            at = 8 * len(self.FIELDS)
            sizes = raw[:at].view(np.int64).tolist()
        for (name, kind), size in zip(self.FIELDS, sizes, strict=True):
            width = size * np.dtype(kind).itemsize
            setattr(self, name, raw[at : at + width].view(kind) if size else np.zeros(0, kind))
            if path:
                at += -(-width // 8) * 8

    @classmethod
    def write(cls, path: str, arrays: dict[str, np.ndarray]) -> None:
        fs, inner = file_system(path)
        fs.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(inner) as out:
            out.write(np.asarray([len(arrays[n]) for n, _ in cls.FIELDS], np.int64).tobytes())
            for name, kind in cls.FIELDS:
                raw = arrays[name].astype(kind).tobytes()
                out.write(raw + b"\0" * (-len(raw) % 8))

    def places(self, words: pa.Array, spaced: np.ndarray) -> np.ndarray:
        """Each word's place in the lexicon, or -1. ``spaced`` words have a space before their bytes."""
        n = len(words)
        out = np.full(n, -1, np.int64)
        if not len(self.keys) or not n:
            return out
        _, ends, data = words.buffers()
        ends = np.frombuffer(ends, np.int64)[words.offset : words.offset + n + 1]
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
        sizes = np.diff(ends)
        who = np.flatnonzero(sizes <= LONGEST)
        who = who[np.argsort(sizes[who], kind="stable")]
        state, place = np.zeros(len(who), np.uint32), np.zeros(len(who), np.int64)
        who, state, place = self._step(who, state, place, np.full(len(who), 32, np.uint8), spaced[who])
        k = 0
        while len(who):
            ended = int(np.searchsorted(sizes[who], k, "right"))
            if ended:
                good = self.final[state[:ended]] > 0
                out[who[:ended][good]] = place[:ended][good]
                who, state, place = who[ended:], state[ended:], place[ended:]
            who, state, place = self._step(who, state, place, data[ends[who] + k], None)
            k += 1
        return out

    def _step(self, who: np.ndarray, state: np.ndarray, place: np.ndarray, byte: np.ndarray, only: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Follow one arc each; words without one drop out."""
        wanted = state << np.uint32(8) | byte
        arc = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        found = self.keys[arc] == wanted
        to, add = self.targets[arc], self.adds[arc]
        if only is not None:
            found |= ~only
            to, add = np.where(only, to, state), np.where(only, add, 0)
        return who[found], to[found], place[found] + add[found]


class Merges:
    """A byte-level BPE model from its file: pre-tokens, merges, tables for decoding."""

    #: The pattern of the byte-level pre-tokenizer (fixed).
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model, before = made["model"], made["pre_tokenizer"] or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        odd += [k for k in ("normalizer", "post_processor") if made.get(k)]
        odd += [k for t in made["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized") if t[k]]
        if odd or model["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or (made["decoder"] or {}).get("type") != "ByteLevel":
            raise ValueError(f"{path} isn't a plain byte-level BPE: {odd}")
        # the byte-level alphabet: printable bytes stand for themselves, others for U+0100 and on, in order
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in set(own)]
        of_char = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}
        vocab = model["vocab"]
        self.byte = np.zeros(256, np.int32)
        for c, b in of_char.items():
            self.byte[b] = vocab[c]
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        keys = np.asarray([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        self.ranked = np.asarray([vocab[a + b] for a, b in pairs], np.int32)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.added = {t["content"]: t["id"] for t in made["added_tokens"]}
        self.added_ids = {c: np.asarray([i], "<u4") for c, i in self.added.items()}
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.find = regex.compile(self.PATTERN).findall

        def raw(token: str) -> bytes:
            return bytes(map(of_char.__getitem__, token)) if all(c in of_char for c in token) else token.encode()

        table = {i: raw(t) for t, i in vocab.items()} | {i: raw(t) for t, i in self.added.items()}
        size = max(table) + 1
        self.table = pa.array([table.get(i, b"") for i in range(size)], pa.large_binary())
        self.digits = pa.array([b"%d," % i for i in range(size)], pa.large_binary())

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge; NONE where there is none or an end is -1."""
        wanted = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where((self.keys[at] == wanted) & (b >= 0), self.ranks[at], NONE)

    def merge_block(self, ids: np.ndarray) -> np.ndarray:
        """Rows of byte ids, filled up with -1: in every round each row's pair of least rank, the leftmost of
        these, becomes one, until no row has a pair."""
        n, w = ids.shape
        ids = np.concatenate([ids, np.full((n, 1), -1, np.int32)], 1)
        out, rows = ids.copy(), np.arange(n)
        ranks = self.rank(ids[:, :-1], ids[:, 1:])
        places = np.arange(w)
        while len(rows):
            at = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), at]
            live = best < NONE
            out[rows[~live]] = ids[~live]
            rows, ids, ranks, at, best = rows[live], ids[live], ranks[live], at[live], best[live]
            every = np.arange(len(rows))
            ids[every, at] = self.ranked[best]
            ids[:, :-1] = np.take_along_axis(ids, places + (places > at[:, None]), 1)
            ranks = np.take_along_axis(ranks, np.minimum(places + (places > at[:, None]), w - 1), 1)
            ranks[:, -1] = NONE
            ranks[every, at] = self.rank(ids[every, at], ids[every, at + 1])
            left = at > 0
            ranks[every[left], at[left] - 1] = self.rank(ids[every[left], at[left] - 1], ids[every[left], at[left]])
        return out[:, :w]

    def merge_long(self, word: bytes) -> np.ndarray:
        """The same for one long word: a heap of (rank, place) over a linked list."""
        ids = self.byte[np.frombuffer(word, np.uint8)]
        first = self.rank(ids[:-1], ids[1:])
        heap = [(int(first[i]), int(i)) for i in np.flatnonzero(first < NONE)]
        heapq.heapify(heap)
        of_pair = self.pairs()
        ids, n = ids.tolist(), len(ids)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        while heap:
            rank, i = heapq.heappop(heap)
            j = right[i]
            if ids[i] < 0 or j >= n or of_pair.get(ids[i] << 32 | ids[j]) != rank:
                continue  # merged meanwhile
            ids[i], ids[j] = int(self.ranked[rank]), -1
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b < n and (r := of_pair.get(ids[a] << 32 | ids[b])) is not None:
                    heapq.heappush(heap, (r, a))
        return np.asarray([x for x in ids if x >= 0], np.int32)

    def pairs(self) -> dict[int, int]:
        if not hasattr(self, "_pairs"):
            self._pairs = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        return self._pairs

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of pre-tokens and n + 1 offsets, by blocks of like widths."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        counts, parts = np.zeros(len(words), np.int64), []
        starts = np.concatenate([[0], np.cumsum(sizes)])
        data = np.frombuffer(b"".join(words), np.uint8)
        below = 0
        for width in (1, 4, 8, 16, 32, WIDE):
            rows = np.flatnonzero((sizes > below) & (sizes <= width))
            below = width
            for lo in range(0, len(rows), 1 << 16):
                some = rows[lo : lo + (1 << 16)]
                place = starts[some][:, None] + np.arange(width)
                inside = np.arange(width) < sizes[some][:, None]
                block = np.where(inside, self.byte[data[np.where(inside, place, 0)]], -1)
                if width > 1:
                    block = self.merge_block(block)
                counts[some] = (block >= 0).sum(1)
                parts.append((some, block))
        for i in np.flatnonzero(sizes > WIDE).tolist():
            made = self.merge_long(words[i])
            counts[i] = len(made)
            parts.append((np.asarray([i]), made[None]))
        at = np.concatenate([[0], np.cumsum(counts)])
        flat = np.zeros(int(at[-1]), np.uint32)
        for some, block in parts:
            kept = block >= 0
            row, col = np.nonzero(kept)
            flat[at[some][row] + col] = block[kept]
        return flat, at


def model(path: str) -> Merges:
    if path not in _MODELS:
        _MODELS[path] = Merges(path)
    return _MODELS[path]


def lexicon(path: str) -> Lexicon:
    if path not in _LEXICONS:
        _LEXICONS.clear()
        _LEXICONS[path] = Lexicon(path)
    return _LEXICONS[path]


def _split(m: Merges, text: str) -> list[str | int]:
    """Pre-tokens of a text, and the ids of special strings in it."""
    parts = m.special.split(text) if m.special else [text]
    return [x for i, part in enumerate(parts) for x in ([m.added[part]] if i % 2 else m.find(part))]


def split_words(m: Merges, words: list[str]) -> tuple[list[str | int], np.ndarray]:
    """Flat pre-tokens (or ids of special strings) of words, and n + 1 offsets. Words with white space only
    in front go through the pattern together, a carriage return between them."""
    joined = [i for i, x in enumerate(words) if plain(x[1:]) and not (m.special and m.special.search(x))]
    counts = np.zeros(len(words), np.int64)
    pieces: list = [None] * len(words)
    together = m.find("\r".join([words[i] for i in joined]))
    cuts = [-1, *(k for k, x in enumerate(together) if x == "\r"), len(together)]
    for i, (a, b) in zip(joined, pairwise(cuts), strict=False):
        pieces[i] = together[a + 1 : b]
    for i, x in enumerate(words):
        if pieces[i] is None:  # a newline in front was put there and is a match of its own
            pieces[i] = ["\n", *_split(m, x[1:])] if x[:1] == "\n" else _split(m, x)
        counts[i] = len(pieces[i])
    return [p for some in pieces for p in some], np.concatenate([[0], np.cumsum(counts)])


class Encoder:
    """Whole texts to ids: one look-up a distinct word, merges for unseen ones."""

    def __init__(self, model: Merges, lexicon: Lexicon):
        self.model, self.lexicon = model, lexicon

    def _known(self, words: pa.Array, spaced: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each word: start and number of its ids in the lexicon's table, and whether it is there."""
        place = self.lexicon.places(words, spaced)
        there = place >= 0
        start = np.zeros(len(place), np.int64)
        size = np.zeros(len(place), np.int64)
        if there.any():
            at = place[there]
            start[there] = self.lexicon.ends[at]
            size[there] = self.lexicon.ends[at + 1] - self.lexicon.ends[at]
        return start, size, there

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of distinct words and n + 1 offsets. Words that don't begin with a space or newline have a
        space before them; the empty one has no ids."""
        heads = pc.binary_slice(words, 0, 1)
        spaced = np.asarray(pc.invert(pc.is_in(heads, pa.array([b" ", b"\n", b""], pa.large_binary()))))
        start, size, there = self._known(words, spaced)
        empty = np.asarray(pc.equal(pc.binary_length(words), 0))
        todo = np.flatnonzero(~there & ~empty)
        unseen = [" " + x if s else x for x, s in zip(words.take(pa.array(todo)).cast(pa.large_string()).to_pylist(), spaced[todo].tolist(), strict=True)]
        flat, at = self._unseen(unseen)
        size[todo] = np.diff(at)
        start[todo] = at[:-1]
        ends = np.concatenate([[0], np.cumsum(size)])
        out = np.zeros(int(ends[-1]), np.uint32)
        for rows, source in ((np.flatnonzero(there), self.lexicon.ids), (todo, flat)):
            if len(rows):
                n = size[rows]
                within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                out[np.repeat(ends[rows], n) + within] = source[np.repeat(start[rows], n) + within]
        return out, ends

    def _unseen(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        pieces, at = split_words(self.model, words)
        if not pieces:
            return np.zeros(0, np.uint32), at
        place: dict = {}
        coded = np.fromiter((place.setdefault(p, len(place)) for p in pieces), np.int64, len(pieces))
        distinct = list(place)
        flat, ends = self._pieces(distinct)
        n = np.diff(ends)[coded]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        total = np.concatenate([[0], np.cumsum(n)])
        return flat[np.repeat(ends[coded], n) + within], total[at]

    def _pieces(self, pieces: list[str | int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pre-tokens: by the lexicon, by merges, or as they are."""
        raw = [b"" if isinstance(p, int) else p.encode("utf-8", "replace") for p in pieces]
        start, size, there = self._known(pa.array(raw, pa.large_binary()), np.zeros(len(raw), bool))
        # a word's newline in front is a match of its own, a pre-token's isn't
        there &= np.fromiter((x[:1] != b"\n" for x in raw), bool, len(raw))
        todo = np.flatnonzero(~there)
        flat, at = self.model.merged([raw[i] for i in todo])
        own = [None] * len(pieces)
        for i in np.flatnonzero(there).tolist():
            own[i] = self.lexicon.ids[start[i] : start[i] + size[i]]
        for i, a, b in zip(todo.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
            own[i] = np.asarray([pieces[i]], np.uint32) if isinstance(pieces[i], int) else flat[a:b]
        return np.concatenate(own), np.concatenate([[0], np.cumsum(np.fromiter(map(len, own), np.int64, len(own)))])

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, last row + 1, flat ids, n + 1 offsets) by runs of rows; null and empty texts have none."""
        for lo, hi in _slices(texts, RUN):
            lists = _piece_lists(texts.slice(lo, hi - lo), "bytes")
            coded = lists.flatten().dictionary_encode()
            flat, ends = self.words(coded.dictionary.cast(pa.large_binary()))
            made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer((ends * 4).astype(np.int64)), pa.py_buffer(flat)]).take(coded.indices)
            _, bounds, data = made.buffers()
            bounds = np.frombuffer(bounds, np.int64)[made.offset : made.offset + len(made) + 1] >> 2 if len(made) else np.zeros(1, np.int64)
            at = bounds[np.asarray(lists.offsets) - lists.offsets[0].as_py()]
            ids = np.frombuffer(data, "<u4", count=int(at[-1])) if at[-1] else np.zeros(0, "<u4")
            # each text starts with the id of a newline that was put before it
            yield lo, hi, np.delete(ids, at[:-1]), at - np.arange(len(at))

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids' tokens; ids that aren't in the vocabulary have none."""
        ids = ids[(ids >= 0) & (ids < len(self.model.table))]
        return joined(self.model.table, ids)[0].tobytes()


def joined(table: pa.Array, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The ids' entries one behind the other, and n + 1 offsets."""
    made = table.take(pa.array(ids.astype(np.int64)))
    if not len(made):
        return memoryview(b""), np.zeros(1, np.int64)
    _, ends, data = made.buffers()
    ends = np.frombuffer(ends, np.int64)[made.offset : made.offset + len(made) + 1]
    return memoryview(data if data is not None else b"").cast("B")[ends[0] : ends[-1]], ends - ends[0]


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word (binary) and n: how often it stands in all texts; words over ``LONGEST`` bytes are left out, as no
    lexicon holds them. Counted by batch before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in _slices(batch.column(0), 2 * RUN):
                seen = pc.value_counts(_piece_lists(batch.column(0).slice(lo, hi - lo), "bytes").flatten())
                words, n = seen.field(0).cast(pa.large_binary()), seen.field(1)
                size = pc.binary_length(words)
                some = pc.and_(pc.greater(size, 0), pc.less(size, LONGEST))
                words, n = words.filter(some), n.filter(some)
                own = pc.is_in(pc.binary_slice(words, 0, 1), pa.array([b" ", b"\n"], pa.large_binary()))
                space = pa.scalar(b" ", pa.large_binary())
                words = pc.if_else(own, words, pc.binary_join_element_wise(space, words, pa.scalar(b"", pa.large_binary())))
                yield pa.RecordBatch.from_arrays([words.cast(pa.binary()), n.cast(pa.int64())], ["word", "n"])

    return docs.select(F.col(text).cast("string")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, path: str, text: str = "text", words: int = WORDS) -> str:
    """Compile the ``words`` most frequent words that occur twice or more (ties: least bytes) into a file of
    the shared folder; returns its path. The driver gets these words alone, at most ``words`` of at most
    ``LONGEST`` bytes. Null and empty texts hold no words; without words the lexicon is empty."""
    top = word_counts(docs, text).filter("n >= 2").orderBy(F.desc("n"), "word").limit(words)
    found = sorted(r for r in top.select("word").toArrow().column(0).to_pylist())
    m = model(path)
    flat, ends = Encoder(m, Lexicon(None))._unseen([x.decode() for x in found])
    made = f"{new_path(docs.sparkSession, 'lexicon')}/words"
    Lexicon.write(made, Automaton(found).compiled() | {"ends": ends, "ids": flat})
    return made


def drop_lexicon(spark, path: str) -> None:
    delete(spark, path.rsplit("/", 1)[0])


def encode_documents(docs: DataFrame, path: str, words: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and ``ids`` (array of int) of every whole text, with the lexicon ``words``; null and empty texts
    have no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, ids, at in Encoder(model(path), lexicon(words)).encode(batch.column(1)):
                made = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), made], [key, "ids"])

    return docs.select(key, F.col(text).cast("string")).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, ids array<int>")


def decode_documents(tokens: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key and ``text`` of each row's ids; null ids are an empty text, bytes that aren't UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = Encoder(model(path), Lexicon(None))
            made = [e.decode(np.asarray(x or [], np.int64)).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], [key, "text"])

    return tokens.select(key, ids).mapInArrow(run, f"{key} {tokens.schema[key].dataType.simpleString()}, text string")


def round_trip_digest(docs: DataFrame, path: str, words: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: texts to ids and back, digested in place.

    Every row gets a row: null and empty texts have no ids and the digests of nothing, repeated rows
    repeat, a null doc_id stays null, texts of any length are encoded whole, other columns are ignored, an
    empty table gives no rows. ``words``: the lexicon's path. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = model(path)
            for lo, hi, ids, at in Encoder(m, lexicon(words)).encode(batch.column(1)):
                (digits, d), (data, b) = joined(m.digits, ids), joined(m.table, ids)
                of_ids, of_text = [], []
                for i, j in pairwise(at.tolist()):
                    of_ids.append(hashlib.sha256(digits[d[i] : max(d[i], d[j] - 1)]).hexdigest())
                    raw = data[b[i] : b[j]]
                    of_text.append(hashlib.sha256(str(raw, "utf-8", "replace").encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(at)), pa.array(of_ids), pa.array(of_text)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
