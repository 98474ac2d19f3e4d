import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from seepkit.llm import near
from seepkit.llm.near import near_duplicates, one_of_each, verify
from seepkit.llm.substrings import crossing, factors, substring_digest, winnow, without_duplicates
from seepkit.llm.words import long_grams, lowered, word_hashes

FOLD = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
SCHEMA = "doc_id long, text string, n string, component_id int, tokens int"


def words(r, n, size=400):
    return ["w%d" % r.randrange(size) for _ in range(n)]


def shingle_set(text):
    w = (text or "").translate(FOLD).encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = {k: shingle_set(t) for k, t in rows}
    up = {k: k for k in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {(k, len(sets[k]), find(k)) for k in keys}


def corpus(seed, sizes, copies=4):
    r = random.Random(seed)
    texts = [None, "", "  ", "One", "one", "a b c", "A B C", "ÂÉ b", "âé b", "the same five words here", "THE same five words here"]
    shared = words(r, 60, 10**6)
    for n in sizes:
        base = words(r, n, 10**6)
        texts.append(" ".join(base))
        for _ in range(copies):
            w = list(base)
            for _ in range(r.randint(0, max(1, n // 40))):
                w[r.randrange(len(w))] = "z%d" % r.randrange(10**6)
            texts.append(" \n".join(w))
        texts.append(" ".join(base[: n // 2] + shared + base[n // 2 :]))
        texts.append(" ".join(shared + words(r, n, 10**6)))
    return list(enumerate(texts))


def joined(spark, rows):
    df = spark.createDataFrame([(k, t, "x", 1, 2) for k, t in rows], SCHEMA)
    return {(r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df).collect()}


@pytest.mark.parametrize(("seed", "sizes", "often"), [(1, [8, 10, 20, 30, 50, 63, 64, 70, 80], (2, 5)), (2, [65, 90, 250, 256, 300, 1000, 1030, 1300, 2500, 5000], (64,)), (3, [65, 90, 250, 256, 300, 1000, 1300, 5000], (1,))])
def test_join_equals_all_pairs(spark, monkeypatch, seed, sizes, often):
    """With small thresholds nearly all tokens are combined, in sets of every size."""
    monkeypatch.setattr(near, "OFTEN", often)
    rows = corpus(seed, sizes)
    assert joined(spark, rows) == brute_components(rows)


def test_small_sets_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(near, "OFTEN", (1, 3))
    r = random.Random(6)
    base = words(r, 24)
    rows = [(i, " ".join(base[r.randint(0, 6) :][: r.randint(1, 18)])) for i in range(300)]
    assert joined(spark, rows) == brute_components(rows)


@pytest.mark.parametrize("often", [(64,), (2, 5)])
def test_full_samples_always_give_the_cover(often):
    """Whatever the frequencies, a set with all its tokens has the signatures that it needs, of every size."""
    r = np.random.default_rng(3)
    for n in [*range(4, 70), 103, 127, 128, 205, 255, 256, 410, 900, 3277, 5000]:
        h = np.sort(r.integers(-(2**62), 2**62, n))
        for df in (np.full(n, 10**6), r.integers(2, 100, n)):
            for x in near.levels(n):
                v = near.Level(x, near.FULL, 80, 1 + len(often))
                made = near.signatures(df, h, near.tau(n) + 1, n, x, v.groups, often)
                assert made is not None
                if often == (64,):  # in proportion to the set
                    assert 0 < len(made) <= 2 * n


def test_pairs_share_signatures_whatever_they_lack():
    """Two sets that lack as many tokens as they may, chosen against them, still meet."""
    r = np.random.default_rng(4)
    for n in (5, 9, 12, 40, 100, 300):
        h = np.sort(r.choice(2**40, 2 * n, replace=False)).astype(np.int64)
        df = dict(zip(h.tolist(), r.integers(2, 200, 2 * n).tolist(), strict=True))
        a = h[r.permutation(2 * n)[:n]]
        rare = sorted(a.tolist(), key=lambda t: (df[t], t))
        b = np.asarray(rare[near.tau(n) :])  # without its rarest tokens
        if 100 * len(b) < 80 * n:
            continue
        (x,) = set(near.levels(len(a))) & {int(len(a)).bit_length() - 1}
        v = near.Level(x, near.FULL, 80, 2)
        one, two = (near.signatures(np.asarray([df[t] for t in y.tolist()]), y, near.tau(len(y)) + 1, len(y), x, v.groups, (64,)) for y in (a, b))
        assert len(np.intersect1d(one, two))


def test_weak_levels_run_again_in_full(spark):
    rows = corpus(4, [100, 120, 300])
    df = spark.createDataFrame([(k, t, "x", 1, 2) for k, t in rows], SCHEMA)
    found = near.Classes(df, shares=((0, 1.0), (64, 0.21)))
    labelled = found.rows.join(found.labels, ["d1", "d2"], "left").filter("n > 0").collect()
    assert {(r.id, r.n, r.comp) for r in labelled} == {x for x in brute_components(rows) if x[1]}


def test_blocks_of_a_family_meet(spark, monkeypatch):
    monkeypatch.setattr(near, "ROWS", 5)
    monkeypatch.setattr(near, "HEADS", 2)
    rows = corpus(5, [100, 110], copies=12)
    # a chain: each text is near the next ones only
    r = random.Random(2)
    chain = words(r, 200, 10**6)
    rows += [(1000 + i, " ".join(chain[4 * i : 4 * i + 80])) for i in range(30)]
    assert joined(spark, rows) == brute_components(rows)


def test_links_come_through_signatures(spark, monkeypatch):
    monkeypatch.setattr(near, "signatures", lambda *x: np.zeros(0, np.int64))
    rows = corpus(7, [30, 100])
    equal = brute_components(rows)
    assert joined(spark, rows) != equal


def test_join_of_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e f", "", 0, 0), (1, "a b c d e f", "", 0, 0), (1, "a b c d e f", "", 0, 0), (2, "A b c d e f", "", 0, 0)], SCHEMA)
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in near_duplicates(df).collect())[1:] == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]
    assert sorted(r.doc_id or 0 for r in one_of_each(df).collect()) == [0, 1]
    assert one_of_each(df).columns == df.columns
    assert near_duplicates(df.limit(0)).count() == 0


def test_null_ids_before_their_copies(spark):
    base = [f"w{i}" for i in range(60)]
    one, near_one, other = " ".join(base), " ".join([*base[:-1], "z"]), " ".join(f"v{i}" for i in range(60))
    rows = [(None, one), (None, other), (1, one), (2, one), (3, near_one), (4, other), (5, other)]
    df = spark.createDataFrame([(k, t, "", 0, 0) for k, t in rows], SCHEMA).coalesce(1)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(df).collect()]
    assert {x for x in got if x[0] is not None} == brute_components([x for x in rows if x[0] is not None])
    assert sorted(r.doc_id for r in one_of_each(df).collect() if r.doc_id is not None) == [1, 4]


def test_ids_that_repeat_with_other_texts(spark):
    base = [f"w{i}" for i in range(60)]
    one, near_one, other = " ".join(base), " ".join([*base[:-1], "z"]), " ".join(f"v{i}" for i in range(60))
    df = spark.createDataFrame([(k, t, "", 0, 0) for k, t in [(1, one), (1, other), (2, near_one), (3, other), (1, one)]], SCHEMA)
    assert {(r.doc_id, r.component_id) for r in near_duplicates(df).collect()} == {(1, 1), (2, 1), (3, 1)}
    assert sorted(r.text for r in one_of_each(df).collect()) == sorted([one, other])


def test_verify_takes_candidates_across_sides_only():
    s = np.arange(10)
    some, none = np.array([5]), np.array([], np.int64)
    assert verify([1, 2, 3], [s] * 3, [some] * 3, [False] * 3) == [(1, 2), (1, 3)]
    assert {frozenset(x) for x in verify([1, 2, 3], [s] * 3, [some] * 3, [False, False, True])} == {frozenset((1, 3)), frozenset((2, 3))}
    assert verify([1, 2], [s] * 2, [some, none], [False] * 2) == []
    assert verify([1, 2], [s] * 2, [some] * 2, [False] * 2, [7, 7]) == []
    assert verify([1, 2], [s, s[:8]], [some] * 2, [False] * 2) == [(2, 1)]
    assert verify([1, 2], [s, s[:7]], [some] * 2, [False] * 2) == []


def test_only_ascii_letters_are_folded():
    assert lowered(pa.array(["ÂB", None, "", "É Z"])).to_pylist() == ["Âb", "", "", "É z"]


def brute_removed(rows, window=35):
    split = [(k, (t or "").encode().split()) for k, t in rows]
    seen = Counter(tuple(w[i : i + window]) for _, w in split for i in range(len(w) - window + 1))
    out = []
    for k, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((k or 0, len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out)


def passages(seed):
    r = random.Random(seed)
    shared = [words(r, n, 10**6) for n in (34, 35, 36, 50, 90)]
    rows = [(1, None), (2, ""), (3, " ".join(words(r, 34, 10**6))), (4, " ".join(["x"] * 36)), (5, " ".join(["y"] * 34)), (6, "q " * 200)]
    for i in range(10, 40):
        parts = [words(r, r.randint(0, 60), 10**6)]
        for _ in range(r.randint(0, 3)):
            parts += [r.choice(shared), words(r, r.randint(0, 40), 10**6)]
        rows.append((i, r.choice([" ", "\n", " \t"]).join(w for p in parts for w in p)))
    # a window that begins in one source and ends in another occurs in two places
    a, b = words(r, 40, 10**6), words(r, 40, 10**6)
    rows += [(50, " ".join(a)), (51, " ".join(b)), (52, " ".join(a + b)), (53, " ".join(a[20:] + b[:20]))]
    return rows + [rows[8], rows[12], (None, rows[12][1])]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_removed_words_equal_brute_force(spark, seed):
    rows = passages(seed)
    df = spark.createDataFrame([(k, t, "x", 1, 2) for k, t in rows], SCHEMA)
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in substring_digest(df).collect())
    assert got == [x[:4] for x in brute_removed(rows)]
    cut = without_duplicates(df)
    assert cut.columns == df.columns
    assert sorted((r.doc_id or 0, b" ".join((r.text or "").encode().split())) for r in cut.collect()) == sorted((x[0], x[4]) for x in brute_removed(rows))


def test_removal_of_nothing(spark):
    assert substring_digest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_equal_windows_pick_equal_anchors():
    r = random.Random(9)
    w = words(r, 300, 50)
    h, _ = word_hashes(pa.array([" ".join(w)]))
    place, g = winnow(h)
    prints = long_grams(h, 35)
    picked: dict = {}
    for i, p in enumerate(place):
        assert i <= p <= i + 27
        assert g[p] == g[i : i + 28].min()
        picked.setdefault(prints[i], set()).add((p - i, g[p]))
    assert all(len(x) == 1 for x in picked.values())


def test_factors_grow_along_their_source():
    a = np.array
    assert factors(a([1, 2, 3, 9]), a([5, 5, 5, 5]), a([7, 8, 9, 15]), 4) == [(1, 6, 5, 7), (9, 4, 5, 15)]
    # another block, and another place of the same block, end a factor; parsing goes on behind it
    assert factors(a([1, 2, 3, 6]), a([5, 6, 6, 6]), a([7, 0, 1, 4]), 4) == [(1, 4, 5, 7), (6, 4, 6, 4)]
    assert factors(a([1, 2, 3]), a([5, 5, 5]), a([7, 8, 0]), 4) == [(1, 5, 5, 7)]
    assert factors(a([], int), a([], int), a([], int)) == []


def test_windows_over_a_factors_end_are_found():
    starts = np.array([1, 2, 3, 9, 20])
    made = factors(starts, np.array([5, 6, 6, 6, 6]), np.array([7, 0, 1, 4, 15]), 4)
    assert made == [(1, 4, 5, 7), (9, 4, 6, 4), (20, 4, 6, 15)]
    assert crossing(starts, made, 4) == [(2, 7)]


@pytest.mark.parametrize("part", ["factors", "crossing"])
def test_spans_are_made_of_factors_and_crossing_windows(monkeypatch, part):
    """Without either, repeated words stay: the spans come from the parse."""
    from seepkit.llm import substrings

    r = random.Random(8)
    a, b = words(r, 40, 10**6), words(r, 40, 10**6)
    rows = [(1, " ".join([*a, "x"])), (2, " ".join(["y", *b])), (3, " ".join(a[20:] + b[:20])), (4, " ".join(["z", *a, *b[:20], "q"])), (5, " ".join(["u", *a, *b[:20], "r"]))]
    docs = [(k, t.split()) for k, t in rows]
    seen, index = Counter(), {}
    for k, w in docs:
        for i in range(len(w) - 34):
            seen[tuple(w[i : i + 35])] += 1
            index.setdefault(tuple(w[i : i + 35]), (k, i))

    def removed():
        out = {}
        for k, w in docs:
            starts = [i for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1]
            sources = [index[tuple(w[i : i + 35])] for i in starts]
            lists = pa.array([[{"p": p, "block": u, "place": q} for p, (u, q) in zip(starts, sources, strict=True)]], pa.list_(pa.struct([("p", pa.int32()), ("block", pa.int64()), ("place", pa.int32())])))
            (batch,) = substrings._spans([pa.RecordBatch.from_arrays([pa.array([k]), lists], ["uid", "found"])])
            out[k] = sum(batch["b"][0].as_py()) - sum(batch["a"][0].as_py())
        return out

    want = {x[0]: x[2] for x in brute_removed(rows)}
    assert removed() == want
    monkeypatch.setattr(substrings, part, lambda *x: [])
    assert removed() != want
