"""Quality rules by weak supervision: rules vote or abstain, EM weighs them, a posterior decides.

Every rule is a Column that votes 1 (good), 0 (bad) or null (abstains). Votes of all documents are
counted per vote pattern - at most 3^rules rows reach the driver, whatever the corpus - and
expectation-maximisation on those counts estimates, without labels, the share of good documents, the
shares of documents that are bad in one of a few ways, and each rule's accuracies. The posterior
probability of quality of a document is then a Column expression of its votes: no Python touches a row.

A bad document is mostly bad in one way, so rules come in groups that look for the same kind of bad
document by different measures. Within a kind their evidence multiplies, good votes included; votes of
other groups' rules come out as among good documents. So a rule's accuracy shows in whether its group
agrees with it: bad votes that the others contradict are learned to be false alarms, however many, and
those that the others share are learned to be a kind, however few. Priors stand for a fixed number of
votes and fade as the corpus grows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seepkit.llm.names import folded, unfolded
from seepkit.llm.staging import materialize

#: ASCII white space, the separators of words.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Words in a block of which variety is measured: a share of distinct words means the same at one length only.
#: A long word has more code points than ``LONG``.
SPAN, LONG = 400, 15
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _joined(h: Column, step: int, size: Column) -> Column:
    """Hashes of each place's with that ``step`` further on; there are ``size``."""
    return F.zip_with(F.slice(h, 1, F.greatest(size, F.lit(0))), F.slice(h, 1 + step, F.greatest(size, F.lit(0))), lambda a, b: F.xxhash64(a, b))


def _windows(pairs: Column, n: Column) -> Column:
    """64-bit hashes of the windows of eight words, from those of pairs: fours, eights."""
    return _joined(_joined(pairs, 2, n - 3), 4, n - 7)


def _distinct(words: Column, n: Column) -> Column:
    """Distinct words, summed over blocks of SPAN words (the last ends with the text; a shorter text is one block)."""
    starts = F.sequence(F.lit(0), F.ceil(n / SPAN).cast("int") - 1)
    each = F.aggregate(starts, F.lit(0), lambda s, i: s + F.size(F.array_distinct(F.slice(words, F.least(i * SPAN + 1, n - (SPAN - 1)), SPAN))))
    return F.when(n <= SPAN, F.size(F.array_distinct(words))).otherwise(each)


def _without(text: Column, characters: str) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit(x), F.lit("")), characters, text)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and, in a struct ``m``, the counts that the rules read.

    Null texts count as having no words. Windows are compared by a 64-bit hash within one document. A
    column named ``m`` is replaced; other names can't clash.
    """
    made = _measured(folded(docs, text))
    return made.select(*unfolded(made, docs.columns, text, "m"), "m")


def _measured(docs: DataFrame) -> DataFrame:
    """``row``, ``text`` and ``m`` of a folded table."""
    step = docs.withColumn("__t", F.coalesce(F.col("text").cast("string"), F.lit("")))
    spaced = reduce(lambda c, x: F.replace(c, F.lit(x), F.lit(" ")), SPACE[1:], F.col("__t"))
    step = step.withColumn("__w", F.filter(F.split(spaced, " "), lambda w: w != ""))
    step = step.withColumn("__n", F.size("__w"))
    step = step.withColumn("__q", _joined(F.transform("__w", lambda w: F.xxhash64(w)), 1, F.col("__n") - 1))
    step = step.withColumn("__h", F.when(F.col("__n") >= 2 * WINDOW - 7, _windows(F.col("__q"), F.col("__n"))))
    # windows that occur twice are rare: only then are their places looked for
    step = step.withColumn("__r", F.coalesce(F.size("__h") - F.size(F.array_distinct("__h")), F.lit(0)))
    placed = F.array_sort(F.zip_with("__h", F.sequence(F.lit(0), F.size("__h") - 1), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step = step.withColumn("__p", F.when(F.col("__r") > 0, placed))
    # sorted by hash, equal windows are neighbours
    k = F.size("__p")
    same_next = F.zip_with(F.slice("__p", 1, k - 1), F.slice("__p", 2, k - 1), lambda a, b: a["h"] == b["h"])
    step = step.withColumn("__s", F.when(F.col("__r") > 0, same_next))
    marked = F.zip_with("__p", F.zip_with(F.array_append("__s", F.lit(False)), F.array_insert("__s", 1, F.lit(False)), lambda a, b: a | b), lambda p, s: F.when(s, p["i"]))
    step = step.withColumn("__i", F.when(F.col("__r") > 0, F.array_sort(F.array_compact(marked))))
    m = F.size("__i")
    # a window covers eight words, or as many as lie before the next
    covered = F.aggregate(F.zip_with(F.slice("__i", 1, m - 1), F.slice("__i", 2, m - 1), lambda a, b: F.least(b - a, F.lit(WINDOW))), F.lit(WINDOW), lambda s, x: s + x)
    step = step.withColumn("__l", F.filter(F.split("__t", "\n"), lambda x: _without(x, SPACE[:2] + SPACE[3:]) != ""))
    found = {
        "n_words": F.col("__n"),
        "word_chars": F.length(_without(F.col("__t"), SPACE)),
        "n_symbols": F.length("__t") - F.length(_without(F.col("__t"), SYMBOLS)),
        "n_dup_lines": F.size("__l") - F.size(F.array_distinct("__l")),
        "n_repeat_words": F.when(F.col("__r") > 0, covered).otherwise(0),
        "n_lines": F.size("__l"),
        "n_distinct": _distinct(F.col("__w"), F.col("__n")),
        "n_pairs": F.when(F.col("__n") > 1, _distinct(F.col("__q"), F.col("__n") - 1)).otherwise(0),
        "n_marked": F.regexp_count("__t", F.lit(f"[{SYMBOLS}][^ \\t\\n\\x0B\\f\\r]*")),
        "n_long": F.size(F.filter("__w", lambda w: F.length(w) > LONG)),
        "n_capitals": F.regexp_count("__t", F.lit("[A-ZÀ-ÖØ-Þ]{3,}")),
        "n_shouts": F.length("__t") - F.length(_without(F.col("__t"), "!")),
    }
    found = {k: c.cast("long") for k, c in found.items()}
    # the row's number in the struct keeps the optimizer from copying these expressions into filters
    step = step.withColumn("m", F.struct(*(c.alias(k) for k, c in found.items()), F.monotonically_increasing_id().alias("row")))
    return step.select("row", "text", "m")


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])


def _vote(value: Column, good_below: float, bad_above: float) -> Column:
    return F.when(value <= good_below, 1).when(value > bad_above, 0)


def rules(m: Column) -> dict[str, Column]:
    """The rules: each votes 1, 0 or null. Thresholds are shares of words or characters."""
    n, chars = F.greatest(m["n_words"], F.lit(1)), F.greatest(m["word_chars"], F.lit(1))
    length = chars / n
    in_blocks = lambda k: F.when(k <= SPAN, k).otherwise(F.ceil(k / SPAN) * SPAN)
    return {
        "symbols": _vote(m["n_symbols"] / n, 0.05, 0.3),
        "marked": _vote(m["n_marked"] / n, 0.05, 0.2),
        "capitals": _vote(m["n_capitals"] / n, 0.1, 0.3),
        "shouts": _vote(m["n_shouts"] / n, 0.05, 0.2),
        "lines": _vote(m["n_dup_lines"] / F.greatest(m["n_lines"], F.lit(1)), 0.1, 0.3),
        "variety": _vote(-m["n_distinct"] / in_blocks(n), -0.45, -0.3),
        "pairs": _vote(-m["n_pairs"] / in_blocks(F.greatest(n - 1, F.lit(1))), -0.65, -0.5),
        "long_words": _vote(m["n_long"] / n, 0.1, 0.3),
        "word_length": F.when((length >= 3) & (length <= 9), 1).when((length < 2) | (length > 14), 0),
    }


#: Rules that look for the same kind of bad document.
GROUPS = (("symbols", "marked"), ("capitals", "shouts"), ("lines", "variety", "pairs"), ("long_words", "word_length"))
#: Where EM starts, and its priors: the share of bad documents, P(bad vote | not that kind) and P(good vote | that
#: kind). ALARMS and KINDS: the votes that the priors of the second and of the others stand for.
BAD, ALARM, MISS, ALARMS, KINDS = 0.2, 0.002, 0.1, 1000.0, 20.0


class Votes:
    """good: share of good documents; kinds[g]: share of documents that are bad as group g's rules look for; of
    each rule j, alarm[j]: P(bad vote | not its group's kind), miss[j]: P(good vote | that kind)."""

    def __init__(self, groups: list[list[int]]):
        self.groups = groups
        rules = sum(map(len, groups))
        self.good, self.kinds = 1 - BAD, [BAD / max(1, len(groups))] * len(groups)
        self.alarm, self.miss = [ALARM] * rules, [MISS] * rules

    def odds(self, j: int, vote: int | None) -> float:
        """How much likelier than a good document one of rule j's kind casts its vote."""
        return 1.0 if vote is None else self.miss[j] / (1 - self.alarm[j]) if vote else (1 - self.miss[j]) / self.alarm[j]

    def posterior(self, votes: tuple) -> list[float]:
        """Probabilities: good, then bad of each kind."""
        odds = [1.0, *(math.prod((self.odds(j, votes[j]) for j in g), start=share / self.good) for g, share in zip(self.groups, self.kinds, strict=True))]
        return [x / sum(odds) for x in odds]

    def quality(self, votes: list[Column]) -> Column:
        """The first of them, of votes in columns."""
        each = [F.when(v == 1, self.odds(j, 1)).when(v == 0, self.odds(j, 0)).otherwise(1.0) for j, v in enumerate(votes)]
        kinds = [reduce(lambda a, b: a * b, (each[j] for j in g), F.lit(share / self.good)) for g, share in zip(self.groups, self.kinds, strict=True)]
        return 1 / reduce(lambda a, b: a + b, kinds, F.lit(1.0))


def fit_votes(counts: list[tuple[tuple, int]], groups: list[list[int]], rounds: int = 500, still: float = 1e-9) -> Votes:
    """EM on (vote pattern, documents), until no estimate moves by more than ``still``."""
    model, total, k = Votes(groups), sum(c for _, c in counts), sum(map(len, groups))
    for _ in range(rounds if total else 0):
        kinds = [0.0] * len(groups)
        cast, alarms, misses, of_kind = ([0.0] * k for _ in range(4))
        for votes, c in counts:
            p = model.posterior(votes)
            for g, members in enumerate(groups):
                mine = c * p[1 + g]
                kinds[g] += mine
                for j in members:
                    if votes[j] is not None:
                        cast[j] += c - mine
                        alarms[j] += (c - mine) * (1 - votes[j])
                        of_kind[j] += mine
                        misses[j] += mine * votes[j]
        before = [model.good, *model.kinds, *model.alarm, *model.miss]
        model.kinds = [(x + KINDS * BAD / len(groups)) / (total + KINDS) for x in kinds]
        model.good = 1 - sum(model.kinds)
        model.alarm = [(x + ALARMS * ALARM) / (n + ALARMS) for x, n in zip(alarms, cast, strict=True)]
        model.miss = [(x + KINDS * MISS) / (n + KINDS) for x, n in zip(misses, of_kind, strict=True)]
        if max(abs(a - b) for a, b in zip(before, [model.good, *model.kinds, *model.alarm, *model.miss], strict=True)) < still:
            break
    return model


def voted(measured: DataFrame) -> DataFrame:
    """Documents by vote pattern, of those that pass the base rules."""
    votes = rules(F.col("m"))
    return measured.filter(~base_failed(F.col("m"))).select(*(c.cast("int").alias(k) for k, c in votes.items())).groupBy(*votes).agg(F.count("*").alias("c"))


def _scored(docs: DataFrame, text: str, least: float, with_text: bool) -> DataFrame:
    """A folded table (without its text, unless asked for) with m, base_failed, quality and kept."""
    measured = _measured(folded(docs, text))
    # written, so that the measures are taken once, for the votes and for the verdicts
    measured = materialize(measured if with_text else measured.drop("text"), "measures")
    names = list(rules(F.col("m")))
    groups = [[names.index(r) for r in g] for g in GROUPS]
    model = fit_votes(sorted(((tuple(r[k] for k in names), r["c"]) for r in voted(measured).collect()), key=str), groups)
    scored = measured.withColumn("base_failed", base_failed(F.col("m")))
    scored = scored.withColumn("quality", model.quality(list(rules(F.col("m")).values())))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))


def score(docs: DataFrame, text: str = "text", least: float = 0.5, with_text: bool = True) -> DataFrame:
    """All columns of ``docs`` with struct ``m``, ``base_failed``, ``quality`` (posterior) and ``kept``.

    Null and empty texts have no words and so fail the base rules; repeated rows are judged alike;
    an empty table gives an empty result; columns that have the names of the four are replaced, others
    are passed on. ``with_text=False`` leaves the text out.
    """
    made = _scored(docs, text, least, with_text)
    columns = docs.columns if with_text else [c for c in docs.columns if c != text]
    return made.select(*unfolded(made, columns, text, *SCORES), *SCORES)


def good_documents(docs: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns, whatever the names.

    Null, empty and short texts go; repeated rows stay or go together; an empty table stays empty.
    """
    made = _scored(docs, text, least, True).filter("kept")
    return made.select(*unfolded(made, docs.columns, text))


SCORES = ("m", "base_failed", "quality", "kept")
