"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree.

Three boosters give each node the odds of being wholly article, wholly something else, or mixed.
Decoding maximises the sum of log probabilities over consistent labellings: below an all-article
node everything is article, below an all-other node nothing is, and only a mixed node's children
choose for themselves. One pass up and one down find the maximum.

The boosters are trained here, on pages that a seeded generator lays out with known truth: layouts
with and without semantic elements, adverts, notices, forms and comments beside and within the
article, unclosed tags, wrappers in any number.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seepkit.llm.boosting import Booster
from seepkit.llm.html_tree import features, measure, parse, walk

#: Pages that the boosters learn from, and the generator's seed.
PAGES, SEED = 600, 2024
MARK = ""  # in generated pages, before text that belongs to the article


@cache
def _vocabulary() -> list[str]:
    r = random.Random(SEED)
    return ["".join(r.choices("aeioustrnlmdpc", k=r.randint(2, 9))) for _ in range(4_000)]


def _words(r: random.Random, n: int) -> str:
    return " ".join(r.choices(_vocabulary(), k=n))


def _sentence(r: random.Random, low: int = 4, high: int = 22) -> str:
    return _words(r, r.randint(low, high)).capitalize() + r.choice(["."] * 6 + ["?", "!", ""])


def _attribute(r: random.Random, names: str) -> str:
    name = r.choice(names.split())
    name = r.choice([name, name, f"{name}-{r.choice(['box', 'wrap', 'area', 'inner', '1'])}", f"site-{name}", f"{name} {_words(r, 1)}"])
    return f' {r.choice(["class", "class", "id"])}="{name}"'


def _links(r: random.Random, low: int, high: int) -> str:
    items = "".join(f'<li><a href="/{_words(r, 1)}">{_words(r, r.randint(1, 3))}</a></li>' for _ in range(r.randint(low, high)))
    return r.choice([f"<ul>{items}</ul>", items.replace("<li>", "").replace("</li>", " | "), f"<ul>{items}</ul>"])


def _side(r: random.Random, kind: str) -> str:
    """A part of a page that isn't article."""
    text = lambda n: " ".join(_sentence(r) for _ in range(r.randint(1, n)))
    tag, names, body = {
        "menu": ("nav", "nav menu navbar breadcrumb navigation", _links(r, 3, 12)),
        "header": ("header", "header masthead topbar banner", f"<h2>{_words(r, 2)}</h2>" * r.randint(0, 1) + r.choice([_links(r, 2, 6), text(1), f"<p>{text(1)}</p>"])),
        "footer": ("footer", "footer copyright legal bottom", r.choice([f"&copy; {_words(r, 1)}.com &middot; {text(2)}", _links(r, 2, 8) + f"<p>{text(1)}</p>", f"<p>{text(2)}</p>"])),
        "side": ("aside", "sidebar side widget rail related", r.choice([f"<h3>{_words(r, 2)}</h3>" + _links(r, 3, 9), f"<p>{text(3)}</p>" * r.randint(1, 3), f"<h3>{_words(r, 2)}</h3><p>{text(2)}</p>"])),
        "advert": ("div", "ad ads advert sponsor promo advertisement", r.choice([text(2), f"<p>{text(2)}</p>", f'<a href="/x">{text(1)}</a>'])),
        "notice": ("div", "notice cookie consent alert newsletter gdpr", r.choice([f"<p>{text(2)}</p>", text(2), f"{text(1)}<button>OK</button>"])),
        "form": ("form", "form search login signup subscribe", f"<label>{_words(r, 1)}</label><input name=q><p>{text(1)}</p>" * r.randint(1, 2) + "<button>Go</button>"),
        "comments": ("section", "comments comment replies discussion", f"<h3>{_words(r, 1)}</h3>" * r.randint(0, 1) + "".join(f'<{t}{_attribute(r, "comment reply")}>{r.choice(["", f"<b>{_words(r, 1)}</b> "])}<p>{text(4)}</p></{t}>' for t in [r.choice(["div", "li", "article"])] for _ in range(r.randint(1, 6)))),
        "share": ("div", "share social related recommended", _links(r, 2, 6)),
    }[kind]
    if tag != "div" and r.random() < 0.5:
        return f"<{tag}{_attribute(r, names) if r.random() < 0.4 or tag == 'section' else ''}>{body}</{tag}>"
    tag = r.choice(["div", "div", "section", "aside" if kind in ("advert", "side", "share", "notice") else "div"])
    return f"<{tag}{_attribute(r, names)}>{body}</{tag}>"


def _article(r: random.Random) -> str:
    parts = []
    if r.random() < 0.8:
        parts.append(f"<h1>{MARK}{_words(r, r.randint(2, 9))}</h1>")
    for _ in range(r.choice([1, 2, 2, 3, 3, 5, 8, 12, 20])):
        text = MARK + (" ".join(_sentence(r) for _ in range(r.choice([1, 1, 2, 4, 8, 15]))) if r.random() < 0.85 else _words(r, r.randint(1, 4)) + ".")
        if r.random() < 0.15:
            text = text.replace(" ", "&amp;&amp; ", 3)
        if r.random() < 0.15:
            text = text.replace(" ", f' <a href="/{_words(r, 1)}">x</a> ', 1)
        parts.append(r.choice([f"<p>{text}</p>"] * 6 + [f"<p><b>{text}<br>", f"<p>{text}", f"<h2>{text[:40]}</h2>", f"<blockquote><p>{text}</p></blockquote>", f"<ul><li>{text}</li><li>{MARK}{_sentence(r)}</li></ul>", f"<div>{text}</div>", f"<pre>{text}</pre>", f"<table><tr><td>{text}</td><td>{MARK}{_words(r, 2)}</td></tr></table>"]))
    if r.random() < 0.25:  # lists of links that the article itself has: sources, reports, contents
        items = [f"<li>{r.choice(['', '', _words(r, 1) + ' '])}<a href=\"/{_words(r, 1)}\">{MARK}{_words(r, r.randint(2, 7)).capitalize()}</a></li>" for _ in range(r.choice([1, 1, 2, 3, 4, 7]))]
        items = [x.replace("<li>", f"<li>{MARK}") for x in items]
        parts.insert(r.randint(1, len(parts)), f"<{r.choice(['ul', 'ul', 'ol'])}>{''.join(items)}</ul>")
    for kind in ("advert", "share", "notice", "form", "comments", "side", "footer"):
        if r.random() < 0.12:
            parts.insert(r.randint(1, len(parts)) if kind not in ("comments", "share", "footer") else len(parts), _side(r, kind))
    body = "".join(parts)
    k = r.random()
    if k < 0.4:
        return f"<article>{body}</article>"
    if k < 0.55:
        return f"<main>{r.choice(['', '<div>'])}{body}</main>"
    if k < 0.77:
        return f"<div{_attribute(r, 'article content post entry story main')}>{body}</div>"
    if k < 0.93:
        tag = r.choice(["div", "div", "section"])
        return f"<{tag}>{body}</{tag}>"
    return body


def made_page(r: random.Random) -> str:
    before = [_side(r, k) for k in r.sample(["header", "menu", "advert", "notice", "form", "side"], r.randint(0, 4))]
    after = [_side(r, k) for k in r.sample(["comments", "side", "advert", "share", "form", "notice"], r.randint(0, 3))]
    if r.random() < 0.85:
        after.append(_side(r, "footer"))
    middle = _article(r) if r.random() < 0.97 else ""
    if r.random() < 0.3:
        middle = f"<div{_attribute(r, 'wrapper page container layout row')}>{middle}{after.pop(0) if after else ''}</div>"
    if r.random() < 0.25:  # wrappers without names, a few or very many
        k = r.choice([1, 2, 3, 5, 30, 150])
        tag = r.choice(["div", "div", "section", "span><div", "center"])
        middle = f"<{tag}>" * k + middle + "".join(f"</{t}>" for t in reversed(tag.split("><"))) * k
    return f"<!DOCTYPE html><html><head><title>{_words(r, 3)}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{''.join(before)}<!-- x -->{middle}{''.join(after)}</body></html>"


@cache
def model() -> tuple[Booster, Booster, Booster]:
    """Boosters for: all article, all other, mixed. Trained once a process, in seconds."""
    r = random.Random(SEED)
    rows, labels = [], []
    for _ in range(PAGES):
        nodes = walk(parse(made_page(r)))
        share: dict[int, tuple[int, int]] = {}
        for x in reversed(nodes):
            mine = [share[id(k)] for k in x.children]
            yes, no = sum(a for a, _ in mine), sum(b for _, b in mine)
            if x.own is not None:
                yes, no = (1, 0) if MARK in x.own else (0, 1)
                x.own = x.own.replace(MARK, "")
            share[id(x)] = (yes, no)
        measure(nodes)
        for x, row in zip(nodes, features(nodes), strict=True):
            yes, no = share[id(x)]
            if yes + no:
                rows.append(row)
                labels.append(0 if not no else 1 if not yes else 2)
    x, y = np.asarray(rows, np.float32), np.asarray(labels)
    return tuple(Booster().fit(x, y == k) for k in range(3))


def decode(nodes: list, log_p: np.ndarray) -> None:
    """Set each leaf's ``state`` to True (article) or False, by the best consistent labelling."""
    at = {id(x): i for i, x in enumerate(nodes)}
    best = log_p.copy()
    for i in range(len(nodes) - 1, -1, -1):
        x = nodes[i]
        if x.own is not None:
            best[i, 2] = -np.inf
        elif not x.chars:
            best[i] = 0.0
        else:
            kids = [at[id(k)] for k in x.children if k.chars]
            best[i, 0] += best[kids, 0].sum()
            best[i, 1] += best[kids, 1].sum()
            best[i, 2] += best[kids].max(1).sum()
    chosen = [2] * len(nodes)
    for i, x in enumerate(nodes):
        above = chosen[at[id(x.parent)]] if x.parent is not None else 2
        chosen[i] = above if above < 2 else int(best[i].argmax())
        if x.own is not None:
            x.state = chosen[i] == 0


def extract_batch(pages: list[str | None], boosters: tuple) -> list[str]:
    trees = [walk(parse(h)) if h else [] for h in pages]
    rows = []
    for nodes in trees:
        if nodes:
            measure(nodes)
            rows += features(nodes)
    out, at = [], 0
    if rows:
        x = np.asarray(rows, np.float32)
        z = np.stack([b.margin(x) for b in boosters], 1)
        log_p = z - np.logaddexp.reduce(z, 1, keepdims=True)
    for nodes in trees:
        if nodes:
            decode(nodes, log_p[at : at + len(nodes)])
            at += len(nodes)
        out.append("\n".join(x.own for x in nodes if x.own is not None and x.state))
    return out


def extract(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """All columns of ``pages`` but ``html``, with the main text.

    Null and empty pages, and pages without an article, give an empty text. Repeated rows give
    equal texts; a column named ``text`` is replaced. Nothing is shuffled.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model())
    kept = [c for c in pages.columns if c not in (html, text)]
    source = pages.select(*kept, F.col(html).cast("string"))
    schema = source.drop(html).withColumn(text, F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 200):
                some = batch.slice(lo, 200)
                made = extract_batch(some.column(len(kept)).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array(made, pa.string())], [*kept, text])

    return source.mapInArrow(run, schema)
