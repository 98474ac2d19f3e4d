import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seepkit.llm.packing import cut
from seepkit.llm.quality import fit_votes
from seepkit.llm.staging import materialize
from seepkit.llm.toxicity import fit_chain, word_buckets


def test_stages(spark):
    import corpus_pipeline as c

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in c.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf), "test")
        assert docs.columns == columns, name
        assert 0 < docs.count() <= before
        before = docs.count()
    packed = c.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


CLASHES = {"kept": "string", "m": "int", "quality": "double", "is_toxic": "string", "p_toxic": "string", "base_failed": "int", "__h": "int", "__new": "string", "__tag": "string", "__t": "string", "k1": "int", "row": "int", "i": "int", "x": "int", "id": "int", "a.b c": "int"}


def odd_documents(spark):
    """Nulls in every column, empty, long and repeated texts, and columns with names that operators use."""
    r = random.Random(3)
    words = lambda n: " ".join("".join(r.choice("aeioustrnl") for _ in range(r.randint(3, 8))) for _ in range(n))
    texts = [words(60) for _ in range(6)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(10, texts[0] + " more"), (11, None), (12, ""), (13, " \n "), (14, words(30_000)), (0, texts[0]), (None, texts[1]), (None, None), (15, "two words"), (2, texts[3])]
    made = [(k, t, "en", "s", 5, *(None if kind != "int" else j + len(t or "") for j, kind in enumerate(CLASHES.values()))) for k, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` {k}" for c, k in CLASHES.items())
    made.append((16, texts[5], None, None, None, *[None] * len(CLASHES)))
    return spark.createDataFrame(made, schema)


def test_stages_of_odd_tables(spark, tmp_path):
    import corpus_pipeline as c

    spark.createDataFrame([(1, 1, 0), (2, 1, 1), (None, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd_documents(spark)
    own = [x for x in docs.columns if x not in ("text", "n_chars")]
    key = lambda row: tuple(str(row[x]) for x in own)
    before = Counter(map(key, docs.collect()))
    kept = {}
    for name, stage in c.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns, name
        assert [t for _, t in got.dtypes] == [t for _, t in docs.dtypes], name
        rows = got.collect()
        assert not Counter(map(key, rows)) - before, name  # the other columns are passed on as they are
        kept[name] = Counter((x.doc_id, x.text) for x in rows)
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    all_rows = Counter((x.doc_id, x.text) for x in docs.collect())
    assert not any(not (t or "").strip() or t == "two words" for _, t in kept["quality rules"])
    single = kept["n-gram Jaccard join"]
    assert single[None, None] == 1
    assert single[11, None] == single[12, ""] == single[13, " \n "] == 1
    assert (10, next(t for k, t in all_rows if k == 10)) not in single
    assert sum(kept["substring dedup"].values()) == sum(all_rows.values())
    packed = c.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert Counter(x.doc_id for x in packed if x.piece == 0) == Counter(x.doc_id for x in docs.collect())
    assert c.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_queries_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))


def brute_quality(rows):
    from test_models import brute_base

    def vote(x, good, bad):
        return 1 if x <= good else 0 if x > bad else None

    judged = []
    for k, t in rows:
        n, chars, symbols, same_lines, repeated = brute_base(t)
        w = t.split()
        lines = [x for x in t.split("\n") if x.strip()]
        def shares(items):
            blocks = [items] if len(items) <= 400 else [items[min(i, len(items) - 400) :][:400] for i in range(0, len(items), 400)]
            return sum(len(set(b)) for b in blocks) / max(sum(map(len, blocks)), 1)

        length = chars / max(n, 1)
        votes = (
            vote(symbols / max(n, 1), 0.05, 0.3),
            vote(sum(any(c in x for c in "#*$%&|<>") for x in w) / max(n, 1), 0.05, 0.2),
            vote(len(re.findall("[A-ZÀ-ÖØ-Þ]{3,}", t)) / max(n, 1), 0.1, 0.3),
            vote(t.count("!") / max(n, 1), 0.05, 0.2),
            vote(same_lines / max(len(lines), 1), 0.1, 0.3),
            vote(-shares(w), -0.45, -0.3),
            vote(-shares(list(itertools.pairwise(w))), -0.65, -0.5),
            vote(sum(len(x) > 15 for x in w) / max(n, 1), 0.1, 0.3),
            1 if 3 <= length <= 9 else 0 if length < 2 or length > 14 else None,
        )
        judged.append((k, t, votes, n < 20 or 100 * repeated > 30 * n))
    model = fit_votes(sorted(Counter(v for _, _, v, failed in judged if not failed).items(), key=str), [[0, 1], [2, 3], [4, 5, 6], [7, 8]])
    return [(k, t) for k, t, v, failed in judged if not failed and model.posterior(v)[0] >= 0.5]


def brute_one_of_each(rows):
    from test_duplicates import brute_components

    named = sorted({(k, t) for k, t in rows if k is not None})
    best = {comp for _, _, comp in brute_components(named)}
    return [x for x in named if x[0] in best] + [x for x in rows if x[0] is None]


def brute_cut(rows, window=35):
    split = [t.split() for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (k, t), w in zip(rows, split, strict=True):
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        at = [m.span() for m in re.finditer(r"\S+", t)]
        runs = []
        for j in range(len(w)):
            if j not in gone:
                runs[-1:] = [(runs[-1][0], j)] if runs and runs[-1][1] == j - 1 else [*runs[-1:], (j, j)]
        out.append((k, "\n".join(t[at[a][0] : at[b][1]] for a, b in runs) if gone else t))
    return out


def brute_toxic(spark, rows, labels):
    known = dict(rows)
    hashed = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("h", F.xxhash64("doc_id", F.lit(7))).orderBy("h").collect()
    targets = {"poor": np.array([x.quality == 0 for x in hashed]), "toxic": np.array([x.toxic == 1 for x in hashed])}
    chain = fit_chain([word_buckets(known[x.doc_id]) for x in hashed], targets, np.array([x.h % 4 for x in hashed]))
    return [(k, t) for k, t in rows if chain.predict([word_buckets(t)])[0, 1] < 0.5]


def fixture():
    r = random.Random(12)
    names = ["".join(r.choice("aeioustrnlmdpc") for _ in range(r.randint(4, 7))) for _ in range(4000)]
    words = lambda n: [r.choice(names) for _ in range(n)]
    passage = words(50)
    rows = [(i, " ".join(words(r.randint(40, 120)))) for i in range(60)]
    rows += [(100 + i, " ".join(words(30) + ["vile", "slurry", "hateful"] + words(30))) for i in range(40)]
    rows += [(200 + i, " ".join(w + r.choice(["", " #", " $$"]) for w in words(50))) for i in range(5)]
    rows += [(210, " ".join(words(10))), (211, "a b c d e f g h i j " * 10), (212, ""), (213, " ".join(words(3000)))]
    for i in range(6):  # near copies of document i, and the passage in documents of their own
        w = rows[i][1].split()
        w[len(w) // 2] = "changed"
        rows += [(300 + i, " \n".join(w)), (320 + i, " ".join(words(40)) + "\n" + " ".join(passage) + "  " + " ".join(words(30)))]
    salad = words(60)
    rows += [(340, " ".join(r.choice(salad) for _ in range(900))), (50, rows[50][1]), (None, rows[51][1]), (None, " ".join(words(60)))]
    return rows, [(k, int(k < 200), int(100 <= k < 140)) for k, _ in rows[:105]]


def test_run_equals_brute_force_chain(spark, tmp_path):
    import corpus_pipeline as c

    rows, labels = fixture()
    spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    clean = brute_toxic(spark, rows, labels)
    good = brute_quality(clean)
    single = brute_one_of_each(good)
    left = brute_cut(single)
    assert len(rows) > len(clean) > len(good) > len(single) > 50
    assert sum(map(len, (t for _, t in left))) < sum(map(len, (t for _, t in single)))

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for k, t in left:
        ids = [*(library.encode(t, add_special_tokens=False).ids if t else []), 0]
        want += [(k or -1, i, a, n, zlib.crc32(np.asarray(ids[a : a + n], "<u4").tobytes())) for i, (a, n) in enumerate(cut(len(ids), 2048))]
    got = c.run(spark, str(tmp_path)).collect()
    assert sorted((x.doc_id or -1, x.piece, x.start, x.length, x.ids_crc32) for x in got) == sorted(want)
    by: dict = {}
    for x in got:
        by.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for places in by.values():
        ends = [0, *(a + n for a, n in sorted(places))]
        assert [a for a, _ in sorted(places)] == ends[:-1]
        assert ends[-1] <= 2048
    assert len(by) <= 1.15 * -(-sum(x[3] for x in want) // 2048) + 2
