"""Keyword-stuffed and link-list pages.

A hidden Markov model labels every line of a page: prose, code, data (logs, tables, images, references) or one of the
listing states links, tags, menu (keyword lists, product entries, repeated phrases) and stuffed (sentences made of
the same keywords over and over). A page is flagged when more
than a set share of its characters lies in listing lines.

The observations are structural (separators, links, hash tags, digits, how often the words occur in the page), so the
model has no word list and no language. It is fitted here: lines of a bounded seeded sample whose class is
unmistakable are labelled by strict rules, and the emission and transition tables are then re-estimated by Viterbi
training on all lines of the sample. Every line of every page is then labelled.

Beside the sample a few made-up pages of every kind are fitted, so that the labels don't depend on how many pages of a
kind a corpus holds.

Defined results: null, empty and blank texts are no cases; text is used whole (of a notebook's JSON: all its strings).
"""

from __future__ import annotations

import json
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamroute.llm.line_features import FEATURES, line_features
from streamroute.session import spread

STATES = ["prose", "code", "data", "links", "tags", "menu", "stuffed"]
PROSE, CODE, DATA, LINKS, TAGS, MENU, STUFFED = range(7)
LISTING = [LINKS, TAGS, MENU, STUFFED]

#: Pages of the sample the model is fitted on (a fixed bound, whatever the corpus' size).
SAMPLE_PAGES = 3000
#: Share of a page's characters in listing lines from which it is flagged.
MOST = 0.5
#: Rounds of Viterbi training after the rules' labels.
ROUNDS = 1
#: Characters of the sample in all, and of a page that may be in it (it is fitted in one task).
SAMPLE_CHARS, PAGE_CHARS = 30_000_000, 50_000
#: Made-up pages of each kind that are fitted beside the sample, so that no kind is unknown where a corpus lacks it.
EXAMPLES = 4
#: Characters labelled at once.
BLOCK = 1_000_000


def observe(f: np.ndarray) -> np.ndarray:
    """Discrete observations of lines: one column a factor."""
    x = dict(zip(FEATURES, f.T))
    chars, words = np.maximum(1, x["chars"]), np.maximum(1, x["words"])
    cut = lambda v, edges: np.searchsorted(np.array(edges), v, side="right")
    share_links = x["in_links"] / chars
    outside = np.where(x["out_words"] >= 1, np.where(x["out_words"] / np.maximum(1, x["links"]) > 8, 3, 2), np.where(x["out_digits"] >= 1, 1, 0))
    link = np.where(x["links"] > 0, 1 + 4 * cut(share_links, [0.35, 0.75]) + outside, 0)
    tags = np.where(x["tags"] > 0, 1 + cut(chars / np.maximum(1, x["tags"]), [50]), 0)
    listed = cut((x["seps"] + x["bars"]) / words, [0.02, 0.1, 0.2, 0.4])
    length = cut(x["words"], [1, 4, 9, 16])
    stops = np.minimum(2, x["stops"]).astype(int)
    worn = 9 * cut(x["repeat"], [0.8, 1.5, 2.2, 2.7, 3.2, 4.0]) + cut(x["often"], [0.006, 0.012, 0.017, 0.022, 0.03, 0.05, 0.1, 0.2])
    digits = cut(x["digits"] / chars, [0.01, 0.05, 0.12, 0.25, 0.4])
    code = cut((x["code"] + x["brackets"]) / chars, [0.005, 0.03, 0.06, 0.1, 0.16])
    quotes = cut(x["quotes"] / chars, [0.005, 0.03, 0.06])
    letters = cut(x["letters"] / chars, [0.3, 0.55, 0.75, 0.88])
    alike = cut(x["alike"], [2, 4, 8])
    run = cut(chars / np.maximum(1, x["tokens"]), [4.5, 7, 20])
    bars = np.minimum(2, x["bars"]).astype(int)
    marks = np.minimum(2, x["marks"]).astype(int)
    return np.column_stack([link, tags, 15 * listed + 3 * length + stops, worn, digits, code, quotes, letters, alike, run, bars, marks]).astype(np.int64)


SIZES = [13, 3, 75, 63, 6, 6, 4, 5, 4, 4, 3, 3]


def unmistakable(f: np.ndarray) -> np.ndarray:
    """Labels of lines whose class is beyond doubt, -1 for the others."""
    x = dict(zip(FEATURES, f.T))
    chars, words = np.maximum(1, x["chars"]), np.maximum(1, x["words"])
    letters, digits, signs = x["letters"] / chars, x["digits"] / chars, (x["code"] + x["brackets"] + x["quotes"]) / chars
    items = x["seps"] + x["bars"] + 1
    links = np.maximum(1, x["links"])
    none = x["links"] == 0
    once = x["alike"] < 6
    plainly = (x["code"] + x["brackets"]) / chars < 0.08
    worn = (x["repeat"] >= 1.5) & (x["often"] >= 0.01)
    rules = [
        (DATA, (x["alike"] >= 6) & (digits >= 0.03) & (x["bars"] == 0)),
        (DATA, ~none & (x["out_words"] == 0) & (x["out_digits"] >= 3)),
        (DATA, ~none & (x["out_words"] >= 9 * links) & (x["stops"] >= 1)),
        (DATA, none & (digits >= 0.4)),
        (DATA, none & (x["tokens"] <= 2) & (chars >= 60)),
        (TAGS, (x["tags"] >= 3) & (chars / np.maximum(1, x["tags"]) < 45)),
        (LINKS, ~none & (x["in_links"] / chars > 0.9) & (x["out_digits"] == 0) & (chars >= 40)),
        (LINKS, ~none & (x["out_words"] <= 7 * links) & (x["out_words"] >= 1) & (x["stops"] <= links) & (x["marks"] + x["quotes"] >= links)),
        (MENU, none & (x["bars"] >= 2) & (words >= 4) & once & (letters > 0.35) & worn),
        (MENU, none & (items >= 4) & (x["words"] >= 8) & (words / items <= 7) & worn & (letters > 0.55) & plainly & (x["stops"] == 0) & once & (digits < 0.2)),
        (STUFFED, none & (x["often"] >= 0.022) & (x["repeat"] >= 2.7) & (letters > 0.8) & (x["words"] >= 9) & (x["stops"] >= 1) & plainly & (x["quotes"] <= 2) & once),
        (MENU, none & (x["often"] >= 0.06) & (x["repeat"] >= 3.5) & (letters > 0.6) & (x["words"] >= 12) & plainly & (x["quotes"] <= 2) & once),
        (MENU, none & (x["words"] >= 16) & (x["stops"] + x["seps"] == 0) & (x["repeat"] >= 1.5) & (x["often"] >= 0.012) & (letters > 0.9) & plainly & (x["quotes"] <= 2) & once),
        (CODE, none & (signs >= 0.14) & (digits < 0.3) & (items < 4) & (x["bars"] == 0)),
        (PROSE, none & (letters >= 0.72) & (x["stops"] >= 1) & (x["often"] < 0.019) & (x["words"] >= 4) & (signs < 0.12)),
        (PROSE, none & (letters >= 0.6) & (x["words"] >= 2) & (x["words"] <= 9) & (x["seps"] + x["bars"] == 0) & (x["often"] < 0.02) & (signs < 0.06)),
    ]
    out = np.full(len(f), -1)
    for state, mask in rules:
        out[(out < 0) & mask] = state
    return out


class LineModel:
    """Start, transition and emission tables (logarithms)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: list[np.ndarray]):
        self.start, self.move, self.emit = start, move, emit

    def dumps(self) -> str:
        return json.dumps({"start": self.start.tolist(), "move": self.move.tolist(), "emit": [e.tolist() for e in self.emit]})

    @staticmethod
    def loads(text: str) -> LineModel:
        d = json.loads(text)
        return LineModel(np.array(d["start"]), np.array(d["move"]), [np.array(e) for e in d["emit"]])

    @staticmethod
    def count(doc: np.ndarray, obs: np.ndarray, label: np.ndarray) -> LineModel:
        """Tables from labelled lines; unlabelled ones (-1) are passed over. Laplace-smoothed."""
        k = len(STATES)
        known = label >= 0
        emit = []
        for j, size in enumerate(SIZES):
            table = np.bincount(label[known] * size + obs[known, j], minlength=k * size).reshape(k, size) + 1.0
            emit.append(np.log(table / table.sum(1, keepdims=True)))
        pair = (doc[1:] == doc[:-1]) & known[1:] & known[:-1]
        move = np.bincount(label[:-1][pair] * k + label[1:][pair], minlength=k * k).reshape(k, k) + 2.0
        first = np.concatenate([[True], doc[1:] != doc[:-1]]) & known
        start = np.bincount(label[first], minlength=k) + 2.0
        return LineModel(np.log(start / start.sum()), np.log(move / move.sum(1, keepdims=True)), emit)

    def viterbi(self, doc: np.ndarray, obs: np.ndarray) -> np.ndarray:
        """Most likely labels; all pages of a block advance together, a line a step."""
        if not len(doc):
            return np.empty(0, np.int64)
        k = len(STATES)
        score = sum(e[:, obs[:, j]] for j, e in enumerate(self.emit)).T
        begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        length = np.diff(np.concatenate([begin, [len(doc)]]))
        order = np.argsort(-length, kind="stable")
        begin, length = begin[order], length[order]
        back = np.zeros((len(doc), k), np.int8)
        best = self.start + score[begin]
        live = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")  # pages with at least so many lines
        ends = np.empty((len(begin), k))
        for t in range(1, int(length[0])):
            n = live[t]
            ends[n : len(best)] = best[n:]
            best = best[:n]
            via = best[:, :, None] + self.move[None]
            at = begin[:n] + t
            back[at] = via.argmax(1)
            best = via.max(1) + score[at]
        ends[: len(best)] = best
        label = np.empty(len(doc), np.int64)
        now = ends.argmax(1)
        for t in range(int(length[0]) - 1, -1, -1):
            n = live[t]
            at = begin[:n] + t
            label[at] = now[:n]
            if t:
                now[:n] = back[at, now[:n]]
        return label


def blocks(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, document of each line, features of each line) for runs of texts of bounded size."""
    i = 0
    while i < len(texts):
        j, chars = i, 0
        while j < len(texts) and (j == i or chars + len(texts[j]) <= BLOCK):
            chars += len(texts[j])
            j += 1
        doc, f = line_features(texts[i:j])
        yield i, doc, f
        i = j


def examples(n: int = EXAMPLES, seed: int = 5) -> list[tuple[str, int]]:
    """n made-up pages of each kind of line, from syllables, with the state of their lines. They are few beside a corpus'
    own lines."""
    r = random.Random(seed)
    syllable = [c + v + e for c in "bdfgklmnprstv" for v in "aeiou" for e in ("", "n", "r")]
    word = lambda: "".join(r.choice(syllable) for _ in range(r.randint(1, 4)))
    pages = []
    for i in range(n):
        rare, some, few = ([word() for _ in range(k)] for k in (400, 24, 8))
        term = lambda: " ".join(r.sample(few, r.randint(2, 3)))
        # words of sentences are as uneven as in any language
        say = lambda ws, k: " ".join(ws[int(len(ws) * r.random() ** (2 if ws is rare else 1))] for _ in range(k)).capitalize() + "."
        kinds = [
            (PROSE, lambda: " ".join(say(rare, r.randint(7, 14)) for _ in range(3))),
            (CODE, lambda: f"{word()}_{word()} = {word()}.{word()}({word()}[{r.randrange(9)}], {word()}={r.randrange(99)})"),
            (DATA, lambda: "  ".join(f"{r.uniform(0, 900):.3f}" for _ in range(6))),
            (DATA, lambda: f"[{r.randrange(99)}] {word().title()}, {word().title()} ({r.randrange(1950, 2025)}). {say(rare, r.randint(6, 12))} https://{word()}.example/{word()}/{r.randrange(9999)}"),
            (DATA, lambda: f"{r.randrange(24):02d}:{r.randrange(60):02d} {few[0]} {few[1]} {r.randrange(99)} {few[2]} {r.uniform(0, 9):.2f} s"),
            (LINKS, lambda: f"- [{term()}](https://{word()}.example/{'-'.join(r.sample(few, 2))})"),
            (LINKS, lambda: f"https://{word()}.example/{'-'.join(r.sample(few, 2))}/{r.choice(few)}?{r.choice(few)}={r.randrange(999)}"),
            (TAGS, lambda: " ".join("#" + "_".join(r.sample(few, 2)) for _ in range(8))),
            (MENU, lambda: ", ".join(term() for _ in range(10))),
            (MENU, lambda: " ".join(term() for _ in range(14))),
            (MENU, lambda: " ".join(" ".join(r.sample(some, 3)) for _ in range(12))),
            (MENU, lambda: "[" + ", ".join(f"'{term()}'" for _ in range(4)) + "],"),
            (MENU, lambda: " ".join(f"{few[0]} {few[1]} {len(few[2]) * 37}" for _ in range(14))),
            (MENU, lambda: f"{term()} {term()} | {word().upper()}-{r.randrange(999)} | {term()} | {r.randrange(400)}.99"),
            (STUFFED, lambda: " ".join(say(few, r.randint(7, 12)) for _ in range(3))),
        ]
        # short runs of phrases without signs, over vocabularies of several sizes
        pages += [("\n".join(" ".join(r.choice(rare[:k]) for _ in range(36)) for _ in range(5)), MENU) for k in (12, 18, 26, 36)]
        # honest pages are of any length, and in long ones every word comes back
        pages += [("\n".join(line() for _ in range(14 * 3**i if state < LINKS else 14)), state) for state, line in kinds]
    return pages


def fit(texts: list[str], rounds: int = ROUNDS) -> LineModel:
    """Rules' labels first, then Viterbi training over all lines, those of the examples included."""
    made = examples()
    texts = [*(t for t, _ in made), *texts]
    parts = [(i + doc, f) for i, doc, f in blocks(texts)]
    doc, f = (np.concatenate(x) for x in zip(*parts))
    obs = observe(f)
    sure = np.where(doc < len(made), np.array([state for _, state in made])[np.minimum(doc, len(made) - 1)], unmistakable(f))
    model = LineModel.count(doc, obs, sure)
    for _ in range(rounds):
        label = model.viterbi(doc, obs)
        model = LineModel.count(doc, obs, np.where(sure >= 0, sure, label))
    return model


def shares(texts: list[str], model: LineModel) -> np.ndarray:
    """Per text the characters in lines of each state; row sums are all its characters but space."""
    out = np.zeros((len(texts), len(STATES)))
    for i, doc, f in blocks(texts):
        if len(doc):
            label = model.viterbi(doc, observe(f))
            np.add.at(out, (i + doc, label), f[:, FEATURES.index("chars")])
    return out


def fit_on(docs: DataFrame, text: str = "text", key: str = "doc_id", pages: int = SAMPLE_PAGES, seed: int = 9) -> LineModel:
    """A model fitted on at most `pages` pages of at most PAGE_CHARS characters, those with the smallest seeded hash of
    their key, and of these on as many as have SAMPLE_CHARS characters; fitted in one task, only the tables come back.
    The bounds hold for fitting alone: every page is labelled, whole."""
    h = F.xxhash64(F.lit(seed), F.col(key))
    # the hash bound lets about twice as many pages through as are taken, however large the corpus is, so that the
    # tasks don't each send `pages` texts to the one that sorts them
    part = min(1.0, 2.0 * pages / max(1, docs.count()))
    sample = docs.select(key, text, h.alias("__h")).where(F.col("__h") <= F.lit(int(-(2**63) + part * (2**64 - 1)) if part < 1 else 2**63 - 1))
    sample = sample.where((F.trim(text) != "") & (F.length(text) <= PAGE_CHARS)).orderBy("__h", key).limit(pages)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = pdf.sort_values(["__h", key])[text]
        return pd.DataFrame({"model": [fit(texts[texts.str.len().cumsum() <= SAMPLE_CHARS].tolist()).dumps()]})

    got = sample.groupBy(F.lit(1).alias("one")).applyInPandas(run, "model string").collect()
    return LineModel.loads(got[0]["model"]) if got else fit([])


def label_pages(docs: DataFrame, model: LineModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, characters per state and the listing share of every page (0 for null and blank texts)."""
    from pyspark.sql import types as T

    slim = spread(docs.select(key, text))
    schema = T.StructType([slim.schema[key], *[T.StructField(f"n_{s}", T.LongType(), False) for s in STATES], T.StructField("listing", T.DoubleType(), False)])
    tables = model.dumps()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = LineModel.loads(tables)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = shares(texts, m)
            total = n.sum(1)
            part = np.divide(n[:, LISTING].sum(1), total, out=np.zeros(len(n)), where=total > 0)
            cols = [pa.array(n[:, i].astype(np.int64)) for i in range(len(STATES))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols, pa.array(part)], names=[key, *[f"n_{s}" for s in STATES], "listing"])

    return slim.mapInArrow(run, schema)


def flagged(labels: DataFrame, most: float = MOST) -> DataFrame:
    return labels.where(F.col("listing") > most)
