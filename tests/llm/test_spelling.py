import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seepkit.llm import spelling
from seepkit.llm.spelling import Trie, runs, spelling_variants, word_counts, write_shards


def distance_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


WORDS = st.text(st.sampled_from("abé"), max_size=6).map(lambda w: w.encode("latin-1"))


@settings(max_examples=150, deadline=None)
@given(words=st.sets(WORDS, max_size=60), asked=st.lists(WORDS, max_size=10))
def test_automata_find_all_words_at_distance_one(words, asked):
    words = sorted(words)
    trie = Trie(words, [1] * len(words))
    for w in [*asked, *words]:
        got = trie.near(w)
        assert sorted(got) == [i for i, x in enumerate(words) if distance_one(w, x)]


def test_shards_are_read_as_written(tmp_path):
    words = sorted({bytes(random.Random(i).choices(b"ab\xe9", k=i % 9)) for i in range(300)})
    Trie(words, list(range(len(words)))).write(str(tmp_path / "a"))
    one, two = Trie(words, list(range(len(words)))), Trie.read(str(tmp_path / "a"))
    assert vars(one) == vars(two)
    assert Trie([], []).near(b"abc") == []
    long = b"a" * 50_000
    assert Trie([long, long + b"b"], [1, 1]).near(long) == [1]


def test_runs():
    text = "ÀBc×D÷é İx naïve-Ω9straßeŸ ſtop ª"
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    assert [w.decode("latin-1") for w in runs(text)] == [w.translate(low) for w in re.findall("[A-Za-zÀ-ÿ]+", text)]


def brute(rows):
    low, counts = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)}), Counter()
    for k, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(low)
            h = zlib.crc32(f"{'' if k is None else k}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: [x for x in words if distance_one(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return out


def drawn(seed):
    r = random.Random(seed)
    base = ["receive", "separate", "déjàvue", "aaaaaa", "straßen"]
    words = []
    for b in base:
        w = b
        for n in (900, 150, 25, 5):
            words += [w, w.capitalize()] * (n // 2) + [w] * (n % 2)
            i = r.randrange(len(w))
            w = r.choice([w[:i] + "x" + w[i:], w[:i] + w[i + 1 :], w[:i] + "y" + w[i + 1 :]])
    words += ["".join(r.choices("abcé", k=r.randint(5, 8))) for _ in range(6000)]
    r.shuffle(words)
    return [(r.choice([*range(300), None]), r.choice([" ", "-", "\n", "Ω"]).join(words[i : i + 20])) for i in range(0, len(words), 20)] + [(5, None), (6, ""), (7, "of it"), (8, "receive " * 40_000)]


@pytest.mark.parametrize(("shard", "walkers"), [(100_000, 50_000), (40, 7)])
def test_variants_equal_loops(spark, monkeypatch, shard, walkers):
    monkeypatch.setattr(spelling, "SHARD", shard)
    monkeypatch.setattr(spelling, "WALKERS", walkers)
    monkeypatch.setattr(spelling, "COUNTED", 500)
    rows = drawn(1)
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, n long, word string").repartition(5)
    got = spelling_variants(df).collect()
    assert len(got) == len({r.word for r in got})
    want = brute(rows)
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want
    assert max(len({root for _, f, root, *_ in want if f}), 1) >= 5


def test_odd_tables(spark):
    schema = "doc_id long, text string"
    for rows in ([], [(1, None), (None, ""), (2, "ab cd")]):
        assert spelling_variants(spark.createDataFrame(rows, schema)).count() == 0
    same = [(3, "orange orange")] * 3 + [(None, "orange")] * 2
    got = spelling_variants(spark.createDataFrame(same, schema)).collect()
    assert [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got] == [("orange", None, "orange", 8, 0, None)]
    assert [(r.word, r.n) for r in word_counts(spark.createDataFrame(same, schema)).collect()] == [(b"orange", 8)]


def test_shards_hold_every_word_once(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(spelling, "SHARD", 7)
    words = sorted({f"w{i * i % 997}".encode() for i in range(100)})
    df = spark.createDataFrame([(w, 5) for w in words], "word binary, n long").repartition(4)
    tries = [Trie.read(p) for p in write_shards(df, str(tmp_path / "tries"))]
    assert [w for t in tries for w in t.words] == words
    assert all(len(t.words) <= 7 for t in tries)
