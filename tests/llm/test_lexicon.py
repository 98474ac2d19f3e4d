import hashlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from seepkit.llm.lexicon import WIDE, Automaton, Encoder, Lexicon, build_lexicon, decode_documents, drop_lexicon, encode_documents, model, round_trip_digest, word_counts

PATH = P.path("byte_bpe_50k.json")
ODD = ["", " ", "\n", "\n\n", "a\n\nb", "  a  b ", "a \n b", "\tx y", "foo.\nBar's 's", "ΑΣ Σ.", "x\x1cy", "<|endoftext|> a", "a\r\nb\n", "İ ǅ ﬁ", "a b\u0085c", "x" * 3000 + " y", "日本 語\n漢", "🙂 🙂🙂\n🙂", "x<|endoftext|>y <|startoftext|>.\n<|endoftext|>", "a  <|endoftext|>  b", "<|endoftext|>", "the\rhat \r\n x", "the theater's then, theme"]
WORDS = st.text(st.sampled_from("ab"), max_size=7)
TEXTS = st.lists(st.lists(st.sampled_from([*"ab \n\t'sé1#Σ\x1c,.\r", "the", " then", "<|endoftext|>"]), max_size=30).map("".join), max_size=12)


def library():
    return Tokenizer.from_file(PATH)


def accepted(made, word):
    """The place of a word by one arc after the other, None if it isn't accepted."""
    state, place = 0, 0
    for byte in word:
        arc = np.flatnonzero(made["keys"] == (state << 8 | byte))
        if not len(arc):
            return None
        state, place = int(made["targets"][arc[0]]), place + int(made["adds"][arc[0]])
    return place if made["final"][state] else None


def futures(made):
    """What each state accepts, as a set."""
    found = {}

    def of(s):
        if s not in found:
            mine = {b""} if made["final"][s] else set()
            for i in np.flatnonzero(made["keys"] >> 8 == s):
                mine |= {bytes([made["keys"][i] & 255]) + x for x in of(int(made["targets"][i]))}
            found[s] = frozenset(mine)
        return found[s]

    of(0)
    return found


@settings(max_examples=60, deadline=None)
@given(words=st.sets(WORDS, max_size=40))
def test_automaton_is_minimal_and_numbers_its_words(words):
    words = sorted(w.encode() for w in words)
    made = Automaton(words).compiled()
    assert [accepted(made, w) for w in words] == list(range(len(words)))
    assert all(accepted(made, w + b"c") is None for w in words)
    states = futures(made)
    assert len(states) == len(made["final"]) == len(set(states.values()))
    assert states[0] == frozenset(words)


def stored(words, tmp_path):
    m = model(PATH)
    found = sorted({w.encode() for w in words})
    flat, ends = Encoder(m, Lexicon(None))._unseen([w.decode() for w in found])
    path = str(tmp_path / "words")
    Lexicon.write(path, Automaton(found).compiled() | {"ends": ends, "ids": flat})
    return Lexicon(path)


def ids_of(encoder, texts):
    return [ids[a:b].tolist() for _, _, ids, at in encoder.encode(pa.array(texts, pa.string())) for a, b in zip(at, at[1:], strict=False)]


@pytest.fixture(scope="module")
def encoders(tmp_path_factory):
    known = [" the", " then", " theater's", " a", "\nb", " b,", ",", "\n\n", " 日本", "  a"]
    return [Encoder(model(PATH), Lexicon(None)), Encoder(model(PATH), stored(known, tmp_path_factory.mktemp("lexicon")))]


@settings(max_examples=60, deadline=None)
@given(texts=TEXTS)
def test_ids_equal_the_library(encoders, texts):
    t = library()
    for some in (texts, ODD):
        want = [x.ids for x in t.encode_batch(some, add_special_tokens=False)]
        for e in encoders:
            assert ids_of(e, some) == want
            assert [e.decode(np.asarray(x)).decode("utf-8", "replace") for x in want] == [t.decode(x, skip_special_tokens=False) for x in want]


def test_a_letter_from_every_part_of_unicode(encoders):
    some = [f"a{chr(c)}b {chr(c)}1" for c in range(0, 0x110000, 37) if not 0xD800 <= c < 0xE000]
    assert ids_of(encoders[1], some) == [x.ids for x in library().encode_batch(some, add_special_tokens=False)]


def test_long_words_merge_as_short_ones_do():
    m, r = model(PATH), np.random.default_rng(3)
    words = [bytes(r.choice(list(b"thean erings"), n)) for n in (*range(1, WIDE + 1), 5 * WIDE)]
    flat, at = m.merged(words)
    for w, a, b in zip(words, at, at[1:], strict=False):
        assert flat[a:b].tolist() == m.merge_long(w).tolist()
    assert library().encode("a" * 20_000, add_special_tokens=False).ids == m.merged([b"a" * 20_000])[0].tolist()


def test_parts_of_characters_decode_as_in_the_library(encoders):
    t = library()
    ids = t.encode("é🙂日", add_special_tokens=False).ids
    for some in ([ids[0]], ids[1:], ids[::-1], [*ids, 10**6]):
        got = encoders[0].decode(np.asarray(some)).decode("utf-8", "replace")
        assert got == t.decode([x for x in some if x < 50257], skip_special_tokens=False)


ROWS = [(3, "the then the", "x"), (1, None, "x"), (2, "", "y"), (None, "the b", None), (3, "the then the", "x"), (7, "then w " * 5000, "z"), *((i, t, "q") for i, t in enumerate(ODD, 100))]
SCHEMA = "doc_id long, text string, ids string"


def test_round_trip_of_rows(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    words = build_lexicon(df, PATH, words=4)
    t, want = library(), []
    for k, x, _ in ROWS:
        ids = t.encode(x or "", add_special_tokens=False).ids
        text = t.decode(ids, skip_special_tokens=False)
        want.append((k or -1, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted((r[0] or -1, *r[1:]) for r in round_trip_digest(df, PATH, words).collect()) == sorted(want)
    back = decode_documents(encode_documents(df, PATH, words), PATH).collect()
    assert sorted((r.doc_id or -1, r.text) for r in back) == sorted((k or -1, x or "") for k, x, _ in ROWS)
    assert round_trip_digest(df.limit(0), PATH, words).count() == 0
    drop_lexicon(spark, words)


def test_counts_and_lexicons_of_odd_tables(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = {bytes(r.word): r.n for r in word_counts(df).collect()}
    assert got[b" then"] == 2 + 4999  # the first of the long text stands behind a newline
    assert got[b"\nthen"] == 1
    for some in (df.limit(0), spark.createDataFrame([(1, None, ""), (2, "", "")], SCHEMA)):
        words = build_lexicon(some, PATH)
        assert round_trip_digest(some, PATH, words).count() == some.count()
