"""What the minimum cut decides on pages, against brute force and on pages that reading or names alone label wrong."""

import itertools

import numpy as np
import pytest

from sievework.llm import html_mincut as h

#: As fitted: what is linked, short or has a copyright sign reads as boilerplate.
WEIGHTS = np.array([0.5, 0.3, 2.0, -8.0, 0.5, 0.3, -5.0, 0.0, 0.0, -1.5])
T = "Some text of a paragraph that goes on, with a comma. And on it goes."
LINKS = "<ul>" + "".join(f"<li><a href=x>Story {k}</a></li>" for k in range(6)) + "</ul>"


def labelled(page, weights=WEIGHTS):
    blocks = h.blocks_of(page)
    return {b.text: k for b, k in zip(blocks, h.labels(blocks, weights), strict=True)}, {b.text: o >= 0 for b, o in zip(blocks, h.costs(blocks, weights), strict=True)}


def test_names_reach_blocks_through_edges_only():
    keep, reads = labelled(f"<article><h1>Head</h1><p>{T}</p></article><div class=ad>Buy this now, it is the best of all. You will be glad.</div>")
    assert keep == {"Head": True, T: True, "Buy this now, it is the best of all. You will be glad.": False}
    assert reads["Head"] is False and reads["Buy this now, it is the best of all. You will be glad."] is True  # both wrong without the cut


def test_what_reads_unlike_its_region_is_cut_off():
    keep, _ = labelled(f"<article><p>{T}</p>{LINKS}<p>{T} End.</p></article>")
    assert keep == {T: True, f"{T} End.": True} | {f"Story {k}": False for k in range(6)}
    keep, _ = labelled(f"<article><p>{T}</p><ul>" + "".join(f"<li>{k} eggs</li>" for k in range(9)) + "</ul></article>")
    assert all(keep.values())
    keep, reads = labelled(f"<article><p>{T}</p><p><a href=x>See this other page</a></p><p>{T} End.</p></article>")
    assert all(keep.values()) and not reads["See this other page"]


def test_pages_without_names():
    keep, reads = labelled(f"<body><div>{LINKS}</div><div><p>{T}</p><p>Yes.</p><p>{T} End.</p></div><div><p>© 2024</p></div></body>")
    assert keep == {T: True, "Yes.": True, f"{T} End.": True, "© 2024": False} | {f"Story {k}": False for k in range(6)}
    assert not reads["Yes."]


def test_names_may_be_outvoted():
    page = "<form id=f><div class=header><a href=x>Home</a></div><div>" + "".join(f"<p>{k}. {T}</p>" for k in range(7)) + "</div><label>Mail</label></form>"
    keep, _ = labelled(page)
    assert keep == {"Home": False, "Mail": False} | {f"{k}. {T}": True for k in range(7)}
    keep, _ = labelled(f"<article><p>{T}</p></article><section id=comments>" + "".join(f"<div><div><p>{k}. {T}</p><p>{k}: {T}</p></div></div>" for k in range(20)) + "</section>")
    assert [t for t, k in keep.items() if k] == [T]


def test_headers_of_posts_and_formulas_stay():
    keep, _ = labelled(f"<div class=post><div class=post-header><h1>Title</h1></div><p>We prove that <math><mi>x</mi>=<mn>2</mn></math> holds.</p><noscript><p>For those without.</p></noscript><svg><title>t</title><text>a chart</text></svg><aside>{T}</aside></div>")
    assert keep == {"Title": True, "We prove that x=2 holds.": True, "For those without.": True, "a chart": True, T: False}


@pytest.mark.parametrize("seed", range(30))
def test_cut_of_a_page_is_minimal(seed):
    rng = np.random.default_rng(seed)
    names = ["p", "div", "article", "nav", "section class=ad", "div class=content", "form", "ul", "li", "header"]
    page = ""
    for _ in range(8):
        page += rng.choice([f"<{rng.choice(names)}>", "</div>", "</article>", "</ul>"]) + rng.choice(["", "Word.", f"<a href=x>{T[:20]}</a>", T])
    blocks = h.blocks_of(page)
    if not blocks:
        return
    unary, edges = h.graph(blocks, h.costs(blocks, WEIGHTS))
    assert len(unary) <= 18
    labels = np.array(list(itertools.product([False, True], repeat=len(unary))))
    energy = -(labels * np.array(unary)).sum(axis=1)
    for i, j, w in edges:
        energy = energy + w * (labels[:, i] != labels[:, j])
    mine = h.min_cut(unary, edges)
    assert energy[int("".join("1" if x else "0" for x in mine), 2)] <= energy.min() + 1e-6


def test_long_and_deep_pages():
    many = "<article>" + "".join(f"<p>{k}. {T}</p>" for k in range(30_000)) + "</article>"
    assert h.extract(many, WEIGHTS).count("\n\n") == 29_999
    assert len(h.extract("<div><p>" + T * 80_000, WEIGHTS)) == len(T) * 80_000  # 5 MB in one block
    assert h.extract("<div>" * 20_000 + T, WEIGHTS) == T
    assert h.extract("<p" * 50_000, WEIGHTS) == h.extract("", WEIGHTS) == ""
