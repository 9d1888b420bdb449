import json
import random

import numpy as np
import pytest

from streamroute.llm import line_features as lf
from streamroute.llm import spam

_R = random.Random(0)
#: A vocabulary of the size a page of prose draws from.
WORDS = ["".join(_R.choice(["ba", "lo", "mi", "ste", "ran", "ou", "ke", "vir", "an", "tol"]) for _ in range(_R.randrange(1, 5))) for _ in range(500)]
TOPICS, EXTRA = ["garden hose", "phone case", "yoga mat"], ["buy", "cheap", "best", "price", "online", "reviews", "coupon"]


def sentence(r):
    w = [r.choice(WORDS) for _ in range(r.randrange(8, 16))]
    return " ".join(w).capitalize() + ". "


def prose(r, n=12):
    return "\n".join("".join(sentence(r) for _ in range(3)) for _ in range(n))


def code(r):
    return "\n".join(f"df['{r.choice(WORDS)}'] = model.fit(x[{r.randrange(9)}], lo={r.randrange(99)})" for _ in range(12))


def log(r):
    return "\n".join(f"INFO worker {i % 4} finished chunk {i} in {r.randrange(1000, 3000)} ms" for i in range(40))


def table(r):
    return "\n".join("  ".join(f"{r.uniform(0, 900):.3f}" for _ in range(5)) for _ in range(25))


def references(r):
    return "\n".join(f"- Reed & Umber ({r.randrange(1990, 2020)}): {sentence(r)} https://blog.example/{r.choice(WORDS)}/{r.choice(WORDS)}-{r.randrange(999)}" for _ in range(8))


def phrase(r):
    return f"{r.choice(EXTRA)} {r.choice(TOPICS)} {r.choice(EXTRA)}"


def keywords(r):
    return ", ".join(phrase(r) for _ in range(60))


def links(r):
    return "\n".join(f"- [{phrase(r)}](https://shop.example/{phrase(r).replace(' ', '_')})" for _ in range(30))


def urls(r):
    return "\n".join(f"http://shop{r.randrange(9)}.example/{phrase(r).replace(' ', '-')}?id={r.randrange(9999)}" for _ in range(30))


def tags(r):
    return " ".join("#" + phrase(r).replace(" ", "_") for _ in range(40))


def products(r):
    return "\n".join(f"Velkor {r.choice(TOPICS)} T{r.randrange(999)} | SKU {r.randrange(99999)} | in stock | {r.randrange(400)}.99" for _ in range(30))


def stuffed(r):
    return "garden hose " * 200


def stuffed_sentences(r):
    forms = ["Buy {} here, {} and {}. ", "Looking for {}? Our {} is the {} you want. ", "Order {} now: {}, {}. "]
    return "".join(r.choice(forms).format(phrase(r), phrase(r), phrase(r)) for _ in range(25))


HONEST, SPAM = [prose, code, log, table, references], [keywords, links, urls, tags, products, stuffed, stuffed_sentences]


def pages(n, seed):
    """(text, is spam): held-out style pages made of honest parts, or of listings with a little prose."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        if i % 4 == 0:
            out.append((r.choice(SPAM)(r) + "\n" + sentence(r), True))
        else:
            parts = [f(r) for f in r.sample(HONEST, 3)]
            if r.random() < 0.3:  # a short list in an honest page
                parts += [prose(r, 20), "\n".join(f"#{r.choice(WORDS)}_{r.choice(WORDS)}" for _ in range(3))]
            out.append(("\n".join(parts), False))
    return out


@pytest.fixture(scope="module")
def model():
    return spam.fit([t for t, _ in pages(600, 1)])


def test_held_out_pages(model):
    held = pages(400, 2)
    n = spam.shares([t for t, _ in held], model)
    flagged = n[:, spam.LISTING].sum(1) / n.sum(1) > spam.MOST
    truth = np.array([s for _, s in held])
    assert (flagged & ~truth).sum() <= 2 and (~flagged & truth).sum() <= 4


def test_viterbi_against_brute_force():
    from itertools import product

    rng = np.random.default_rng(3)
    k = len(spam.STATES)
    m = spam.LineModel(np.log(rng.dirichlet(np.ones(k))), np.log(rng.dirichlet(np.ones(k), k)), [np.log(rng.dirichlet(np.ones(s), k)) for s in spam.SIZES])
    doc = np.array([0, 0, 0, 0, 2, 2, 5])
    obs = np.column_stack([rng.integers(0, s, len(doc)) for s in spam.SIZES])
    got = m.viterbi(doc, obs)
    e = sum(t[:, obs[:, j]] for j, t in enumerate(m.emit)).T
    for d in (0, 2, 5):
        at = np.flatnonzero(doc == d)
        score = lambda p: m.start[p[0]] + sum(e[i, s] for i, s in zip(at, p)) + sum(m.move[a, b] for a, b in zip(p, p[1:]))
        best = max(product(range(k), repeat=len(at)), key=score)
        assert tuple(got[at]) == best
    assert spam.LineModel.loads(m.dumps()).viterbi(doc, obs).tolist() == got.tolist()


def test_features_of_one_document_dont_depend_on_its_neighbours():
    r = random.Random(5)
    texts = [f(r) for f in HONEST + SPAM] + ["é́​x", "日本語 の 文。", "\r\n\r\n", "x" * 5000]
    d, f = lf.line_features(texts)
    for i, t in enumerate(texts):
        _, alone = lf.line_features([t])
        assert np.allclose(f[d == i], alone)


def test_notebook_json_is_read_as_all_its_texts():
    assert lf.plain('{"cells":[{"cell_type": "text", "source": "a\\nb"}, {"source": "c \\"d\\""}]}') == 'a\nb\nc "d"'
    whole = {"metadata": {"title": "T"}, "cells": [{"cell_type": "code", "source": ["x\n", "y"], "outputs": [{"output_type": "stream", "name": "stdout", "text": ["o1\n", "o2"]}, {"data": {"text/plain": "p"}}]}]}
    for text in (json.dumps(whole), " \n" + json.dumps(whole, indent=2), "\ufeff" + json.dumps(whole)):
        assert lf.plain(text).split() == ["T", "x", "y", "o1", "o2", "p"]
    assert lf.plain('{"cells":[{"source": "a\\nb"}, {"source": "cut o') == "a\nb\ncut o"
    assert lf.plain('{"cells":[{"source": "bad \\q x"}]}') == "bad \\q x"
    for text in ('{"cells": broken', "x", "", '{"a": "b"}', 'see {"cells": [1]}'):
        assert lf.plain(text) == text


def test_spam_in_any_cell_and_form_of_a_notebook(model):
    r = random.Random(8)
    for make in (keywords, links, tags, products):
        listing = make(r)
        for source, output, lead in ((listing, [], ""), (listing.splitlines(True), [], " \n"), ("x = 1", listing, ""), ("x = 1", listing.splitlines(True), "\t")):
            cells = [{"cell_type": "markdown", "source": sentence(r)}, {"cell_type": "code", "source": source, "outputs": [{"output_type": "stream", "name": "stdout", "text": output}]}]
            n = spam.shares([lead + json.dumps({"metadata": {}, "cells": cells})], model)[0]
            assert n[spam.LISTING].sum() / n.sum() > spam.MOST


@pytest.mark.parametrize("n_spam", [0, 1, 3])
def test_kinds_that_a_corpus_hardly_holds_are_known(n_spam):
    r = random.Random(12 + n_spam)
    corpus = [f(r) for f in HONEST * 8] + [f(r) for f in SPAM for _ in range(n_spam)]
    m = spam.fit(corpus)
    n = spam.shares([f(r) for f in SPAM for _ in range(4)], m)
    assert (n[:, spam.LISTING].sum(1) / n.sum(1) > spam.MOST).sum() >= 26
    n = spam.shares([f(r) for f in HONEST for _ in range(4)], m)
    assert not (n[:, spam.LISTING].sum(1) / n.sum(1) > spam.MOST).any()


def test_pages_in_spark_with_nulls_blanks_and_long_texts(spark):
    r = random.Random(6)
    made = [(i, t, "clash", 1) for i, (t, _) in enumerate(pages(80, 4))]
    rows = made + [(900, None, None, None), (901, "", "", 1), (902, " \n\t", "", 1), (903, keywords(r) * 300, "", 1), (904, prose(r, 3000), "", 1), (None, "x", None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, listing string, n_prose int")
    m = spam.fit_on(df, pages=60)
    got = {x["doc_id"]: x for x in spam.label_pages(df, m).collect()}
    assert len(got) == len(rows)
    assert [got[i]["listing"] for i in (900, 901, 902)] == [0.0, 0.0, 0.0] and got[903]["listing"] > 0.9 and got[904]["listing"] < 0.1
    assert spam.label_pages(df.limit(0), m).count() == 0
    assert spam.fit_on(df.limit(0)).move.shape == (len(spam.STATES),) * 2
    again = spam.fit_on(df.repartition(5), pages=60)
    assert again.dumps() == m.dumps()
