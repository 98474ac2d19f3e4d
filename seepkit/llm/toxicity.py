"""Toxicity by a classifier chain of linear models over hashed words.

The chain predicts categories in a given order. Model j reads the text's words and the
probabilities that models 1..j-1 gave; in training those are out-of-fold, from models that did not
see the document, so that later models meet earlier ones as they will be when they predict.

Features are the distinct lower-cased words (letters only) hashed to ``BUCKETS``; a category's model
keeps the ``KEPT`` buckets most associated with it. Training uses at most ``SAMPLE`` labelled documents,
those with the smallest hashes of their ids, and all their words: counts of buckets are aggregated,
the models' buckets are chosen from them, and the driver gets those buckets of each document alone.
The fitted weights, of fixed size, are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seepkit.llm.names import folded, named, unfolded
from seepkit.llm.staging import discard, materialize
from seepkit.llm.words import slices
from seepkit.llm.workers import tidy

#: Hashed features, features kept by category, documents learned from, folds, ridge penalty.
BUCKETS, KEPT, SAMPLE, FOLDS, RIDGE = 1 << 18, 256, 30_000, 4, 1e-2
#: Least documents and least share of odds that make a bucket a candidate.
LEAST = 3
WORDS = 200_000
_BUCKET: dict[str, int] = {}
_STRIP = "".join(chr(i) for i in range(33, 127) if not chr(i).isalpha())


def _bucket(word: str) -> int:
    """A word's bucket, -1 if there is nothing to it but marks and digits."""
    core = word.strip(_STRIP).casefold()
    return xxhash.xxh3_64_intdigest(core) % BUCKETS if core else -1


def bucket_lists(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct buckets of each text's words, flat, and n + 1 offsets. A distinct word is hashed once."""
    lists = pc.utf8_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    coded = lists.flatten().dictionary_encode()
    if len(_BUCKET) > WORDS:
        _BUCKET.clear()
    words = coded.dictionary.to_pylist()
    found = list(map(_BUCKET.get, words))
    for i, b in enumerate(found):
        if b is None:
            found[i] = _bucket(words[i])
            if len(words[i]) <= 40:
                _BUCKET[words[i]] = found[i]
    of_word = np.asarray(found, np.int64)[coded.indices.to_numpy(zero_copy_only=False)] if words else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
    pairs = np.unique((row * BUCKETS + of_word)[of_word >= 0])
    return (pairs % BUCKETS).astype(np.int32), np.searchsorted(pairs, np.arange(len(lists) + 1) * BUCKETS)


def word_buckets(text: str | None) -> np.ndarray:
    """Sorted distinct buckets of a text's words."""
    return bucket_lists(pa.array([text], pa.string()))[0]


class Chain:
    """weights[j]: bias, weights of the earlier probabilities (as log-odds), {bucket: weight}."""

    def __init__(self, categories: list[str]):
        self.categories = categories
        self.models: list[tuple[float, np.ndarray, np.ndarray]] = []

    def predict(self, rows: list[np.ndarray]) -> np.ndarray:
        return self.predict_flat(np.concatenate([*rows, np.zeros(0, np.int32)]), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64))

    def predict_flat(self, flat: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Probabilities of rows given by flat buckets and n + 1 offsets."""
        out = np.zeros((len(at) - 1, len(self.categories)))
        flat = np.append(flat, 0)  # one more, so that reduceat has a last place
        full = np.diff(at) > 0
        for j, (bias, earlier, weights) in enumerate(self.models):
            z = np.where(full, np.add.reduceat(weights[flat], at[:-1]), 0.0) if len(out) else np.zeros(0)
            out[:, j] = _sigmoid(z + bias + _odds(out[:, :j]) @ earlier)
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p)) / 4


def _design(rows: list[np.ndarray], chosen: np.ndarray) -> np.ndarray:
    """Dense matrix of the chosen buckets' presence."""
    place = np.full(BUCKETS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    x = np.zeros((len(rows), len(chosen)), np.float32)
    for i, r in enumerate(rows):
        p = place[r]
        x[i, p[p >= 0]] = 1
    return x


def _choose(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Buckets with the largest signed root of the likelihood-ratio statistic for y = 1."""
    pos = np.bincount(np.concatenate([np.zeros(0, np.int32), *[r for r, t in zip(rows, y, strict=True) if t]]), minlength=BUCKETS)
    all_ = np.bincount(np.concatenate([np.zeros(0, np.int32), *rows]), minlength=BUCKETS)
    return _best(pos, all_, int(y.sum()), len(y))


def _best(pos: np.ndarray, all_: np.ndarray, k: int, n: int) -> np.ndarray:
    """As ``_choose``, from documents of the category by bucket, all documents by bucket, and their numbers."""
    k = max(1, k)
    a, b = (pos + 0.1) / (k + 0.2), (all_ - pos + 0.1) / (n - k + 0.2)
    gain = pos * np.log(a / b)
    gain[(pos < LEAST) | (a < 3 * b)] = 0  # only marks of the category: what marks its absence is mere topic
    best = np.argsort(-gain, kind="stable")[:KEPT]
    return np.sort(best[gain[best] > 4])


def _fit_linear(x: np.ndarray, y: np.ndarray, steps: int = 25) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the last weight is the bias."""
    x = np.concatenate([x.astype(np.float64), np.ones((len(x), 1))], 1)
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], RIDGE * max(1, len(x)) / 100)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = _sigmoid(x @ w)
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-5:
            break
    return w


def fit_chain(rows: list[np.ndarray], targets: dict[str, np.ndarray], folds: np.ndarray) -> Chain:
    """One model per category in order; a category without both outcomes gets its base rate."""
    chain = Chain(list(targets))
    earlier = np.zeros((len(rows), 0))
    for y in targets.values():
        y = np.asarray(y, bool)
        weights, oof = np.zeros(BUCKETS), np.full(len(y), float(np.mean(y)) if len(y) else 0.0)
        if len(y) and 0 < y.sum() < len(y):
            extra = _odds(earlier)
            for f in range(FOLDS):
                a, b = np.flatnonzero(folds != f), np.flatnonzero(folds == f)
                if not len(b) or not 0 < y[a].sum() < len(a):
                    continue
                chosen = _choose([rows[i] for i in a], y[a])
                w = _fit_linear(np.concatenate([_design([rows[i] for i in a], chosen), extra[a]], 1), y[a])
                oof[b] = _sigmoid(np.concatenate([_design([rows[i] for i in b], chosen), extra[b]], 1) @ w[:-1] + w[-1])
            chosen = _choose(rows, y)
            w = _fit_linear(np.concatenate([_design(rows, chosen), extra], 1), y)
            weights[chosen] = w[: len(chosen)]
            chain.models.append((float(w[-1]), w[len(chosen) : -1], weights))
        else:
            base = float(np.clip(oof.mean() if len(oof) else 0.0, 1e-3, 1 - 1e-3))
            chain.models.append((float(np.log(base / (1 - base))), np.zeros(earlier.shape[1]), weights))
        earlier = np.concatenate([earlier, oof[:, None]], 1)
    return chain


def _bucket_counts(sample: DataFrame, marks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Documents of the sample (text, fold, marks) by fold and bucket, and of each category: arrays (FOLDS, BUCKETS
    + 1) and (categories, FOLDS, BUCKETS + 1), whose last place counts all documents. The driver gets a row
    a bucket and fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(0)):
                some = batch.slice(lo, hi - lo)
                flat, at = bucket_lists(some.column(0))
                flat, row = np.append(flat, np.full(len(some), BUCKETS)), np.append(np.repeat(np.arange(len(some)), np.diff(at)), np.arange(len(some)))
                places, back = np.unique(some.column(1).to_numpy().astype(np.int64)[row] * (BUCKETS + 1) + flat, return_inverse=True)
                counts = [np.bincount(back, w, len(places)).astype(np.int64) for w in (None, *(some.column(m).to_numpy().astype(float)[row] for m in marks))]
                yield pa.RecordBatch.from_arrays([pa.array(places), *map(pa.array, counts)], ["place", "n", *marks])

    counted = sample.mapInArrow(tidy(run), "place long, n long, " + ", ".join(f"{m} long" for m in marks))
    table = counted.groupBy("place").agg(*(F.sum(c).alias(c) for c in ("n", *marks))).toArrow()
    out = np.zeros((1 + len(marks), FOLDS * (BUCKETS + 1)), np.int64)
    for i, c in enumerate(("n", *marks)):
        out[i, table["place"].to_numpy()] = table[c].to_numpy()
    out = out.reshape(1 + len(marks), FOLDS, BUCKETS + 1)
    return out[0], out[1:]


def _candidates(every: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Buckets that any model of the chain chooses: for each category, on all folds and on all but one."""
    found = [np.zeros(0, np.int64)]
    for pos in of:
        for out in (None, *range(FOLDS)):
            some = [f for f in range(FOLDS) if f != out]
            a, p = every[some].sum(0), pos[some].sum(0)
            if 0 < p[-1] < a[-1]:
                found.append(_best(p[:-1], a[:-1], int(p[-1]), int(a[-1])))
    return np.unique(np.concatenate(found))


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], key: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Chain:
    """Fit on labelled documents; ``categories``: name -> Column of 0/1 over ``labels``, in chain order.

    An id counts once: a category holds if any of its labels says so, and of several texts that with the
    least hash is read, whole. The driver gets ``sample`` rows of the models' own buckets at most.
    """
    marks = [f"y{j}" for j in range(len(categories))]
    marked = labels.filter(named(key).isNotNull()).select(named(key).alias("k"), *(c.cast("int").alias(m) for m, c in zip(marks, categories.values(), strict=True))).dropna()
    once = marked.groupBy("k").agg(*(F.max(m).alias(m) for m in marks))
    chosen = once.withColumn("h", F.xxhash64("k", F.lit(7))).orderBy("h", "k").limit(sample)
    # the sample has a fixed bound (rows of a few integers), which makes it safe to broadcast
    texts = docs.select(named(key).alias("k"), named(text).cast("string").alias("t")).join(F.broadcast(chosen), "k")
    read = materialize(texts.groupBy("k", "h", *marks).agg(F.min_by("t", F.xxhash64("t")).alias("t")).select("t", F.pmod("h", F.lit(FOLDS)).alias("fold"), "h", *marks), "labelled")
    wanted = np.zeros(BUCKETS, bool)
    wanted[_candidates(*_bucket_counts(read, marks))] = True

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(0)):
                flat, at = bucket_lists(batch.column(0).slice(lo, hi - lo))
                kept = wanted[flat]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept)])[at].astype(np.int32)), pa.array(flat[kept]))
                yield pa.RecordBatch.from_arrays([lists, *batch.slice(lo, hi - lo).columns[1:]], ["b", *batch.schema.names[1:]])

    table = read.mapInArrow(tidy(own), "b array<int>, fold long, h long, " + ", ".join(f"{m} int" for m in marks)).toArrow()
    discard(read)
    order = np.argsort(table["h"].to_numpy(), kind="stable")
    lists = table["b"].combine_chunks()
    at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    rows = [flat[at[i] : at[i + 1]] for i in order]
    return fit_chain(rows, {c: table[m].to_numpy()[order] for c, m in zip(categories, marks, strict=True)}, table["fold"].to_numpy()[order])


def _scored(docs: DataFrame, chain: Chain, text: str) -> DataFrame:
    """A folded table with p0, p1, ... of the chain's categories."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p{j}" for j in range(len(chain.categories))]
    source = folded(docs, text)
    schema = source.select("*", *(F.lit(0.0).alias(n) for n in names)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.string())
            for lo, hi in slices(texts):
                some = batch.slice(lo, hi - lo)
                p = shared.value.predict_flat(*bucket_lists(texts.slice(lo, hi - lo)))
                yield pa.RecordBatch.from_arrays([*some.columns, *(pa.array(p[:, j]) for j in range(len(names)))], [*some.schema.names, *names])

    return source.mapInArrow(tidy(run), schema)


def score(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``p_<category>`` for each of the chain; columns with such names are
    replaced.

    Null and empty texts have no words: they get what the biases say. Repeated rows score alike. An
    empty table gives an empty result.
    """
    made, names = _scored(docs, chain, text), [f"p_{c}" for c in chain.categories]
    return made.select(*unfolded(made, docs.columns, text, *names), *(made[f"p{j}"].alias(n) for j, n in enumerate(names)))


def default_categories() -> dict[str, Column]:
    """The chain over the labels at hand: poor text first, then toxic text."""
    return {"poor": F.col("quality") == 0, "toxic": F.col("toxic") == 1}


def toxic_scores(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """All columns of ``docs``, p_poor, p_toxic and ``is_toxic`` (p_toxic >= least); columns with these
    names are replaced.

    Null and empty texts get what the biases say; a null doc_id is scored but not learned from, as are
    rows without a label or with a null one; rows that repeat score alike, and an id is learned from
    once, however often it is labelled or occurs; without labels of both kinds a category has its base rate; an empty table gives none.
    """
    chain = train(docs, labels, default_categories())
    scored = score(docs.drop(*(c for c in docs.columns if c.lower() == "is_toxic")), chain)
    return scored.withColumn("is_toxic", F.col("p_toxic") >= least)


def without_toxic(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``toxic_scores`` doesn't call toxic, with all their columns, whatever
    the names; otherwise as there."""
    chain = train(docs, labels, default_categories())
    made = _scored(docs, chain, "text").filter(F.col(f"p{chain.categories.index('toxic')}") < least)
    return made.select(*unfolded(made, docs.columns, "text"))
