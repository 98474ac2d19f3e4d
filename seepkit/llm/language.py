"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts become arrays of code points; n-grams of 1 to 3 characters of the lower-cased letters, words
framed by spaces, are hashed to ``BUCKETS`` features. Training sums counts per language and feature
in every task; the matrix of log probabilities (features x languages, a size fixed by parameters and
the number of languages) is broadcast, and a batch is scored as one sparse product in numpy.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Features, smoothing of counts, and labelled documents a language that are learned from (those
#: with the smallest hash of their id).
BUCKETS, SMOOTHING, PER_LANGUAGE = 1 << 15, 0.5, 4_000
UNKNOWN = "und"


def held_out(key: str = "doc_id"):
    """crc32(id as text) mod 3 = 1."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature of each n-gram, first n-gram of each text, letters of each text).

    A text is framed by spaces of its own, and n-grams that would pass its end are left out.
    """
    lower = pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string())).to_pylist()
    if not lower:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = np.frombuffer((" " + "  ".join(lower) + " ").encode("utf-32-le", "replace"), np.uint32)
    starts = np.cumsum([0] + [len(x) + 2 for x in lower[:-1]])
    letter = LETTER[code]
    n_letters = np.add.reduceat(letter.astype(np.int64), starts)
    c = np.where(letter, code, 32).astype(np.uint32)
    keep = (c != 32) | np.concatenate([[True], c[:-1] != 32])  # one space between words
    keep[starts] = True
    at = np.concatenate([[0], np.cumsum(keep)])[np.append(starts, len(code))]
    c = c[keep] * np.uint32(0x9E3779B1)
    two = (c[:-1] ^ (c[1:] * np.uint32(5)) + np.uint32(0x7F4A7C15)) * np.uint32(0x85EBCA6B)
    two = np.concatenate([two, c[-1:]])
    three = (two[:-1] ^ (c[1:] * np.uint32(0x27D4EB2F) >> np.uint32(3)) * np.uint32(3)) * np.uint32(0xC2B2AE35)
    three[:-1] ^= c[2:] * np.uint32(0x165667B1)
    three = np.concatenate([three, c[-1:]])
    within = np.ones((len(c), 3), bool)  # n characters from each place lie in one text
    last = at[1:] - 1
    within[last, 1:] = False
    within[last[np.diff(at) > 1] - 1, 2] = False
    bits = np.uint32(32 - BUCKETS.bit_length() + 1)
    gram = np.stack([c >> bits, two >> bits, three >> bits], 1)[within]
    first = np.concatenate([[0], np.cumsum(within.sum(1))])[at[:-1]]
    return gram.astype(np.int32), first, n_letters


#: Whether a code point is a letter.
LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def train(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """(languages, float32 matrix of log probabilities, its last row the log priors)."""
    known = labelled.filter(F.col(lang).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(lang).count().collect()}
    order = F.xxhash64(F.col(key).cast("string"))
    share = F.create_map(*(x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, per_language / n))))) if sizes else None
    if not sizes:
        return [], np.zeros((BUCKETS + 1, 0), np.float32)
    sample = known.filter((order.bitwiseAND(0xFFFFF)) < F.element_at(share, F.col(lang)) * 0x100000)
    names = sorted(sizes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), BUCKETS), np.int64)
        for batch in batches:
            for lo in range(0, len(batch), 500):
                some = batch.slice(lo, 500)
                gram, at, _ = features(some.column(0))
                who = np.asarray([names.index(x) for x in some.column(1).to_pylist()])
                each = np.repeat(who, np.diff(np.append(at, len(gram))))
                total += np.bincount(each * BUCKETS + gram, minlength=total.size).reshape(total.shape)
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["l", "f", "n"])

    counted = sample.select(F.col(text).cast("string"), lang).mapInArrow(count, "l int, f int, n long").groupBy("l", "f").agg(F.sum("n").alias("n")).toPandas()
    total = np.full((BUCKETS, len(names)), SMOOTHING)
    total[counted["f"], counted["l"]] += counted["n"]
    priors = np.log([sizes[k] / sum(sizes.values()) for k in names])
    return names, np.concatenate([np.log(total / total.sum(0)), priors[None]]).astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text") -> DataFrame:
    """All columns of ``docs`` with lang_pred and score.

    ``und`` with score 0 where the text is null, has no letter or nothing was learned; else the
    likeliest language (ties to the first in order of names) and its posterior probability.
    """
    names, matrix = model
    shared = docs.sparkSession.sparkContext.broadcast(matrix)
    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = shared.value
        for batch in batches:
            langs, scores = [], []
            for lo, hi in slices(batch.column(place)):
                gram, at, letters = features(batch.column(place).slice(lo, hi - lo))
                totals = np.stack([np.add.reduceat(logs[:-1, j].take(gram), at) for j in range(len(names))], 1).astype(np.float64) if names else np.zeros((hi - lo, 0))
                totals += logs[-1]
                for row, n in zip(totals, letters, strict=True):
                    if not n or not names:
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    best = int(row.argmax())
                    langs.append(names[best])
                    scores.append(float(1 / np.exp(row - row[best]).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def slices(texts: pa.Array, most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes."""
    lo = total = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if total and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(texts):
        yield lo, len(texts)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, learned from those not held out.

    Repeated rows are predicted alike; null ids hash as null and so are neither held out nor learned
    from; columns besides doc_id, text and lang are ignored; the prediction sees the text alone.
    """
    out = F.coalesce(held_out(), F.lit(False))
    model = train(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    rows = docs.select(F.col("doc_id").cast("long"), out.alias("held_out"), F.col("text").cast("string"))
    return predict(rows, model).drop("text")
