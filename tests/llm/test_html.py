"""Minimum-cut extraction on whole pages whose article is known, and its defined cases."""

import random
import time

import pytest
from pyspark.sql import functions as F

from tieout.llm import htmltext

WORDS = "the river rose over night and took part of old bridge with it so that people on both banks had to wait for boats".split()


def _sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def _page(rng, named):
    """A page and its article; unless ``named``, no class or element tells what is what."""
    paras = [_sentence(rng, rng.randint(12, 60)) for _ in range(rng.randint(3, 8))]
    short = "Figure " + str(rng.randint(1, 9))
    body = [f"<h1>{paras[0][:30].strip()}</h1>", *(f"<p>{p}</p>" for p in paras[:2]), f"<div>{short}</div>", *(f"<p>{p}" for p in paras[2:])]
    menu = "".join(f"<li><a href=/{k}>{w}</a></li>" for k, w in enumerate(rng.sample(WORDS, 6)))
    foot = "<div><a href=/a>About</a> <a href=/b>Contact</a></div>"
    if named:
        page = f"<header><h2>Gazette</h2></header><nav><ul>{menu}</ul></nav><article>{''.join(body)}</article><section class='comments'><p>{_sentence(rng, 50)}</p></section><footer>{foot}</footer>"
    else:
        page = f"<div class=q1><ul>{menu}</ul></div><div class=q2>{''.join(body)}</div><div class=q3>{foot}</div>"
    return f"<html><body>{page}</body></html>", "\n".join([paras[0][:30].strip(), *paras[:2], short, *paras[2:]])


@pytest.mark.parametrize("named", [True, False])
def test_known_articles(named):
    rng = random.Random(7)
    for _ in range(60):
        page, article = _page(rng, named)
        assert htmltext.main_text(page) == article


def test_the_cut_turns_labels_over():
    """The captions of the unnamed pages count as boilerplate by themselves; their neighbours keep them."""
    rng, turned = random.Random(7), 0
    for _ in range(60):
        blocks, up = htmltext.blocks_of(_page(rng, False)[0])
        score = [htmltext.evidence(b) for b in blocks]
        keep = htmltext.minimum_cut(score, htmltext.smoothness(blocks, up))
        turned += sum((s >= 0) != k for s, k in zip(score, keep))
    assert turned >= 60


def test_a_weak_name_does_not_throw_prose_away():
    prose = "Other findings were reported last year by two groups, and they agree with these in all that matters here."
    page = f"<article><h1>Of rivers</h1><p>{prose}</p><div class='related-findings'><p>{prose}</p></div></article><div class='related'><ul><li><a href=x>Of lakes</a><li><a href=y>Of seas</a></ul></div>"
    assert htmltext.main_text(page) == f"Of rivers\n{prose}\n{prose}"


def test_cost_is_linear_in_nesting():
    took = []
    for n in (4_000, 32_000):
        began = time.perf_counter()
        assert isinstance(htmltext.main_text("<div>x" * n), str)
        assert isinstance(htmltext.main_text("<div><p>x</b>" * n + "</li>" * n), str)
        took.append(time.perf_counter() - began)
    assert took[1] < 40 * max(took[0], 0.02)


def test_defined_cases(spark):
    page, article = _page(random.Random(1), True)
    very_long = "<article>" + "".join(f"<p>Paragraph {k} of a very long page.</p>" for k in range(20_000)) + "</article>"
    rows = [(1, page, "x", 5), (1, page, "x", 5), (None, None, None, None), (2, "", "x", 6), (3, "<p", "x", 7), (4, very_long, "x", 8)]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string, n_chars int")
    got = htmltext.extract(pages)
    assert got.columns == ["page_id", "n_chars", "text"]
    texts = sorted((r.page_id or 0, r.text) for r in got.collect())
    assert texts[:4] == [(0, ""), (1, article), (1, article), (2, "")] and texts[4][0] == 3
    assert texts[5][1].count("\n") == 19_999
    assert htmltext.extract(pages.where(F.lit(False))).count() == 0
