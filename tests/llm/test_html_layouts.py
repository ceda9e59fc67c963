"""Main text of pages whose layout the labeller was not fitted to: forms over the page, tables, odd names, no tags at all."""

import numpy as np
import pytest
from conftest import SF

from votemill.llm import html_text

P = "The river rose overnight and the bridge was closed to traffic. Engineers will inspect it in the morning."
Q = "Residents were asked to use the northern road. Buses run every twenty minutes until further notice."
ARTICLE, WANT = f"<h1>Bridge closed</h1><p>{P}</p><p>{Q}</p>", f"Bridge closed\n{P}\n{Q}"
PAGES = {
    "form around a container": (f"<html><body><form action='/x' id='aspnetForm'><div class='content'>{ARTICLE}</div></form></body></html>", WANT),
    "form around an article": (f"<html><body><form method=post><input type=hidden name=v><div class='menu'><a href='/'>Home</a></div><article>{ARTICLE}</article><div class='footer'>Imprint</div></form></body></html>", WANT),
    "no tags": (f"{P} {Q}", f"{P} {Q}"),
    "header in the article": (f"<html><body><article><header><h1>Bridge closed</h1></header><p>{P}</p><p>{Q}</p></article></body></html>", WANT),
    "comments and legal line": (f"<html><body><article>{ARTICLE}</article><div id='disqus_thread'><div class='reply'><p>I drove there yesterday and it was fine.</p></div><div class='reply'><p>Thanks for the update!</p></div></div><div id='legal'>All rights reserved. Reproduction prohibited.</div></body></html>", WANT),
    "menu in a table": (f"<html><body><table><tr><td><a href='/'>Home</a></td><td>Maps</td></tr></table><div class='content'>{ARTICLE}</div></body></html>", WANT),
    "columns": (f"<html><body><table><tr><td><p>Home</p><p>Maps</p></td><td>{ARTICLE}</td></tr></table></body></html>", WANT),
    "button in a paragraph": (f"<html><body><article><p>Press the <button>key</button> on the left side of the door to get in, then wait.</p><p>{Q}</p></article></body></html>", f"Press the on the left side of the door to get in, then wait.\n{Q}"),
    "nothing but paragraphs": (ARTICLE, WANT),
    "login before the article": (f"<html><body><form class='login'><label>Name</label><input><label>Password</label></form><main><p>{P}</p><p>{Q}</p></main></body></html>", f"{P}\n{Q}"),
}
#: Names that the poured layouts do not have: how the main part opens, and what stands around it.
FAMILIES = [
    ("<div class='story-text'>", ["<div class='masthead'>", "<div class='colophon'>"]),
    ("<article class='longread'>", ["<div class='skyscraper'>", "<div class='jump-links'>"]),
    ("<main class='page'>", ["<ul class='crumbs'>", "<div class='sitemap'>"]),
    ("<div class='content story'>", ["<nav class='top'>", "<footer class='site'>"]),
    ("<section id='content'>", ["<aside class='teasers'>", "<div class='menu mega'>"]),
]


@pytest.fixture(scope="module")
def html_pages(spark):
    return [r["html"] for r in spark.read.parquet(f"{SF.rsplit('/', 1)[0]}/sf0.01/pages.parquet").orderBy("page_id").collect() if r["html"]]


@pytest.fixture(scope="module")
def labeller(html_pages):
    return html_text.train(html_pages[: html_text.TRAIN_PAGES])


@pytest.mark.parametrize("name", sorted(PAGES))
def test_layouts(labeller, name):
    page, want = PAGES[name]
    assert html_text.extract(labeller, [page]) == [want]


def test_families_that_were_held_out(labeller, html_pages):
    """Blocks of pages with names of their own: nearly all are labelled as they were built."""
    rng = np.random.default_rng(4)
    texts = [n.text for p in html_pages[:60] for n in html_text.blocks(p) if len(n.text.split()) > 12]
    right = total = 0
    for opened, others in FAMILIES:
        for _ in range(12):
            marks, page = {}, []
            for place in range(3):
                if place == 1:
                    page.append(opened)
                    items = [(t, True) for t in rng.choice(texts, int(rng.integers(2, 7)))]
                else:
                    page.append(others[place // 2])
                    items = [(" ".join(t.split()[: int(rng.integers(1, 4))]), False) for t in rng.choice(texts, int(rng.integers(1, 5)))]
                for t, main in items:
                    marks[f"zq{len(marks)}"] = main
                    page.append(f"<p>zq{len(marks) - 1} {t}</p>" if main else f"<a href='/'>zq{len(marks) - 1} {t}</a><br>" if place else f"<li><a href='/'>zq{len(marks) - 1} {t}</a></li>")
                page.append(html_text.closing((opened if place == 1 else others[place // 2]).replace("'", '"')))
            found = html_text.extract(labeller, ["<html><body>" + "".join(page) + "</body></html>"])[0].split()
            right += sum((m in found) == main for m, main in marks.items())
            total += len(marks)
    assert right >= 0.95 * total


def test_weak_labels_look_inside_the_article():
    page = html_text.blocks("<form><p>a</p><article><header><h1>b</h1></header><p>c</p><aside>d</aside><footer>e</footer></article></form>")
    assert html_text.weak_labels(page).tolist() == [0, 1, 1, 0, 0]
