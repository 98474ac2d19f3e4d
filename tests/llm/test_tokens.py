import base64
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from seepkit.llm.byte_bpe import PerfectHash, bpe_digest, coder, decode_documents, encode_documents, read_ranks
from seepkit.llm.packing import cut, cuts, pack, plan, ranks
from seepkit.llm.token_files import FlatFile, manifest, read_shard, token_file_digest, write_tokens
from seepkit.llm.tokens import encoder

KINDS = {"bytes": "byte_bpe_50k.json", "words": "word_bpe_49k.json"}
ODD = ["", " ", "\n", "a\n\nb", "  a  b ", "a \n b", "\tx y", "foo.\nBar's 's", "ΑΣ Σ.", "e ́x á", "\x02 a\x02b \x02", "x\x1cy", "<|endoftext|> a", "a\r\nb\n", "İ ǅ ﬁ", "a b\u0085c", "x" * 3000 + " y", "日本 語\n漢", "🙂 🙂🙂\n🙂", "Word###, word.\nWORD!!", "x İ.", "İ, İİ; aİ. İ́.", "a\u0301. b\u0307, İ\u0307:", "x<|endoftext|>y <|startoftext|>.\n<|endoftext|>", "a  <|endoftext|>  b", "<|endoftext|>"]
ALPHABET = st.sampled_from([*"ab \n\t'sé́1#Σ\x02\x1c,.Sİ\u0307ǅ", "<|endoftext|>", "<|startoftext|>"])
TEXTS = st.lists(st.lists(ALPHABET, max_size=40).map("".join), max_size=20)


def library(kind):
    return Tokenizer.from_file(P.path(KINDS[kind]))


@pytest.mark.parametrize("kind", KINDS)
@settings(max_examples=30, deadline=None)
@given(texts=TEXTS)
def test_chunks_equal_whole_texts(kind, texts):
    t = library(kind)
    for some in (texts, ODD):
        got = [x.tolist() for x in encoder(P.path(KINDS[kind]), kind).encode(pa.array(some, pa.string()))]
        assert got == [t.encode(x, add_special_tokens=False).ids for x in some]


def test_special_strings_as_text():
    t = library("bytes")
    t.encode_special_tokens = True
    text = "x<|endoftext|>y <|endoftext|>"
    assert encoder(P.path(KINDS["bytes"]), "bytes", special_as_text=True).encode(pa.array([text]))[0].tolist() == t.encode(text).ids


@pytest.mark.parametrize("kind", KINDS)
def test_ends_stand_behind_each_text(kind):
    e = encoder(P.path(KINDS[kind]), kind)
    for some in (["a b", None, "", "c.\nd", ""], ["", ""], [None], []):
        found = list(e.encode_ended(pa.array(some, pa.string()), 7))
        got = [ids[a:b].tolist() for _, _, ids, at in found for a, b in zip(at, at[1:], strict=False)]
        assert got == [[*x.tolist(), 7] for x in e.encode(pa.array(some, pa.string()))]
        assert sum(hi - lo for lo, hi, *_ in found) == len(some)


def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=30, deadline=None)
@given(texts=TEXTS)
def test_bpe_equals_tiktoken(texts):
    c, t = coder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN), tik()
    for some in (texts, [*ODD, "abc" * 20000]):
        for x, ids in zip(some, c.encode(pa.array(some, pa.string())), strict=True):
            assert ids.tolist() == t.encode_ordinary(x)
            assert c.decode(ids.tolist()) == x.encode()


def test_perfect_hash_is_minimal():
    keys = list(read_ranks(P.path("byte_bpe_50k.tiktoken")))[:5000]
    h = PerfectHash(keys)
    assert sorted(h.slots) == list(range(len(keys)))
    assert all(keys[h.slot(k)] == k for k in keys)
    assert PerfectHash([]).slot(b"x") in (-1, 0)


ROWS = [(3, "b c", "x"), (1, None, "x"), (2, "", "y"), (None, "a b", None), (3, "b c", "x"), (7, "w " * 5000, "z"), *((i, t, "q") for i, t in enumerate(ODD, 100))]
SCHEMA = "doc_id long, text string, ids string"


def test_token_files(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    path = write_tokens(df, P.path(KINDS["words"]), "words", 1)
    got = sorted(token_file_digest(spark, path).collect(), key=lambda r: r.start)
    t, start = library("words"), 0
    want = []
    for k, x, _ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*(t.encode(x, add_special_tokens=False).ids if x else []), 1]
        want.append((k, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want
    m = manifest(path)
    assert m["tokens"] == start
    assert m["ids"] == "<u2"
    assert sum(1 for s in m["shards"] for _ in read_shard(path, s["shard"], m["ids"])) == len(ROWS)


def test_ids_are_as_wide_as_the_vocabulary_needs(spark, tmp_path):
    wide = Tokenizer.from_str('{"version": "1.0", "truncation": null, "padding": null, "added_tokens": [], "normalizer": null, "pre_tokenizer": {"type": "Whitespace"}, "post_processor": null, "decoder": null, "model": {"type": "WordLevel", "vocab": {"a": 3, "b": 70000, "[UNK]": 0}, "unk_token": "[UNK]"}}')
    wide.save(str(tmp_path / "wide.json"))
    path = write_tokens(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), str(tmp_path / "wide.json"), "words", 1, shards=2)
    m = manifest(path)
    assert m["ids"] == "<u4"
    assert [x.tolist() for s in m["shards"] for _, _, x in read_shard(path, s["shard"], m["ids"])] == [[3, 70000, 1]]


def test_ranged_reads_equal_mapped_ones(tmp_path):
    from pyarrow.fs import LocalFileSystem, SubTreeFileSystem

    np.arange(100, dtype="<u2").tofile(tmp_path / "x")
    one, two = FlatFile(LocalFileSystem(), str(tmp_path / "x"), "<u2"), FlatFile(SubTreeFileSystem(str(tmp_path), LocalFileSystem()), "x", "<u2")
    assert two.file is not None
    for a, b in ((0, 100), (3, 7), (5, 5), (90, 200)):
        assert one[a:b].tolist() == two[a:b].tolist() == list(range(a, min(b, 100)))


def test_token_files_of_nothing(spark):
    path = write_tokens(spark.createDataFrame([], SCHEMA), P.path(KINDS["words"]), "words", 1)
    assert token_file_digest(spark, path).count() == 0


def test_bpe_of_rows(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    path = P.path("byte_bpe_50k.tiktoken")
    back = decode_documents(encode_documents(df, path, P.PATTERN), path, P.PATTERN).collect()
    assert sorted((r.doc_id or -1, bytes(r.bytes)) for r in back) == sorted((k or -1, (x or "").encode()) for k, x, _ in ROWS)
    assert bpe_digest(df, path, P.PATTERN).count() == len(ROWS)
    assert bpe_digest(df.limit(0), path, P.PATTERN).count() == 0


@pytest.mark.parametrize("capacity", [16, 100])
@pytest.mark.parametrize("n", [0, 1, 5, 400, 5000])
def test_plans_use_every_piece_once(capacity, n):
    r = random.Random(n)
    hist: dict = {}
    for _ in range(n):
        k = r.choice([1, 2, 3, capacity, r.randint(1, capacity), capacity // 2])
        hist[k] = hist.get(k, 0) + 1
    used: dict = {}
    made = plan(hist, capacity)
    for lengths, k in made:
        assert sum(lengths) <= capacity
        for x in lengths:
            used[x] = used.get(x, 0) + k
    assert used == hist
    bound = -(-sum(a * b for a, b in hist.items()) // capacity)
    assert sum(k for _, k in made) <= 1.15 * bound + 2


def test_flat_cuts_and_ranks():
    r = np.random.default_rng(5)
    n = r.integers(1, 60, 300)
    who, piece, start, length = cuts(n, 16)
    assert list(zip(who.tolist(), piece.tolist(), start.tolist(), length.tolist(), strict=True)) == [(i, j, a, k) for i, x in enumerate(n.tolist()) for j, (a, k) in enumerate(cut(x, 16))]
    seen, count, want = np.zeros(17, np.int64), {}, []
    for k in length.tolist():
        want.append(count.get(k, 0))
        count[k] = want[-1] + 1
    assert [*ranks(length[:200], seen).tolist(), *ranks(length[200:], seen).tolist()] == want
    assert ranks(length[:0], seen).tolist() == []


def test_cuts():
    assert cut(5, 8) == [(0, 5)]
    assert cut(16, 8) == [(0, 8), (8, 8)]
    assert cut(17, 8) == [(0, 1), (1, 8), (9, 8)]


def test_packing(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = pack(df, P.path(KINDS["bytes"]), 0, 64, with_ids=True).collect()
    t = library("bytes")
    want = []
    for k, x, _ in ROWS:
        ids = [*(t.encode(x, add_special_tokens=False).ids if x else []), 0]
        for i, (a, n) in enumerate(cut(len(ids), 64)):
            raw = np.asarray(ids[a : a + n], "<u4").tobytes()
            want.append((k or -1, i, a, n, zlib.crc32(raw), raw))
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids)) for r in got) == sorted(want)
    by: dict = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 64
    assert pack(df.limit(0), P.path(KINDS["bytes"]), 0, 64).count() == 0
