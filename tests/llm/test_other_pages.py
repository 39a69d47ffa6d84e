"""Main text of pages by a grammar that shares nothing with the maker of the training pages."""

import numpy as np
import pytest

from meterlake.llm import htmltext

WORDS = (
    "the a of market river report city council decided that new school budget water people said Monday after long talks with its neighbours about costs and "
    "repairs which nobody had planned for last winter although engineers warned them"
).split()


class Pages:
    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)

    def sentence(self, low=4, high=18, stop="."):
        return " ".join(self.rng.choice(WORDS, self.rng.integers(low, high))).capitalize() + stop

    def text(self, most=4):
        return " ".join(self.sentence() for _ in range(self.rng.integers(1, most + 1)))

    def article(self):
        """The html of an article, and how many blocks it has."""
        html, n = (f"<h1>{self.sentence(3, 9, '')}</h1>", 1) if self.rng.random() < 0.8 else ("", 0)
        for _ in range(self.rng.integers(3, 12)):
            some, more = (self.paragraph, self.paragraph, self.cells, self.lines, self.figure, self.terms, self.linked, self.short)[self.rng.integers(8)]()
            html, n = html + some, n + more
        return html, n

    def paragraph(self):
        return f"<p>{self.text()}</p>", 1

    def cells(self):
        rows = [[self.text(1) for _ in range(self.rng.integers(2, 4))] for _ in range(self.rng.integers(2, 5))]
        return "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in row) + "</tr>" for row in rows) + "</table>", sum(map(len, rows))

    def lines(self):
        return f"<pre>{self.sentence()}\n{self.sentence()}</pre>", 1

    def figure(self):
        return f'<figure><img src="x.png"><figcaption>{self.text(2)}</figcaption></figure>', 1

    def terms(self):
        n = self.rng.integers(1, 4)
        return "<dl>" + "".join(f"<dt>{self.sentence(1, 3, '')}</dt><dd>{self.text(2)}</dd>" for _ in range(n)) + "</dl>", 2 * n

    def linked(self):
        return "<p>" + " ".join(f'<a href="/{k}">{self.sentence(3, 7, "")}</a>' for k in range(self.rng.integers(2, 6))) + f" {self.sentence(2, 6)}</p>", 1

    def short(self):
        n = self.rng.integers(4, 20)
        return "".join(f"<p>{self.sentence(2, 6)}</p>" for _ in range(n)), n

    def page(self, layout):
        """A page, and whether each of its blocks is main text."""
        html, n = self.article()
        m = self.rng.integers(3, 9)
        menu = "<ul>" + "".join(f'<li><a href="/{k}">{self.sentence(1, 3, "")}</a></li>' for k in range(m)) + "</ul>"
        name = self.rng.choice(["content", "article-body"])
        body = {
            "table": f"<table><tr><td>{menu}</td><td>{html}</td></tr></table>",
            "named table": f'<table class="layout"><tr><td class="menu">{menu}<td class="{name}">{html}</table>',
            "article": f"<nav>{menu}</nav><article>{html}</article>",
            "div": f'<div id="nav">{menu}</div><div class="content">{html}</div>',
            "plain": f"<div>{menu}</div><div>{html}</div>",
        }[layout]
        foot = f"<div class='bottom'>Copyright 2021 {self.sentence(2, 6)}</div>"
        return f"<html><head><title>{self.sentence(2, 5, '')}</title></head><body>{body}{foot}</body></html>", [False] * (m + 1) + [True] * n + [False]


@pytest.mark.parametrize("layout", ["table", "named table", "article", "div", "plain"])
def test_blocks_of_other_pages(layout):
    maker = Pages(9)
    pages = [maker.page(layout) for _ in range(80)]
    found = [htmltext.blocks(html) for html, _ in pages]
    assert [len(b) for b in found] == [len(want) for _, want in pages]
    got = htmltext.production_labeller().label(found)
    right = np.concatenate([g == np.array(want) for g, (_, want) in zip(got, pages)])
    assert right.mean() >= 0.95 and all(g.any() for g in got)


def test_an_article_in_a_layout_table_is_whole():
    cells = "".join(f"<tr><td>Row {k} of the table says something in full.</td><td>And so does the cell beside it.</td></tr>" for k in range(3))
    html = (
        "<html><body><table><tr><td><a href='/'>Home</a><br><a href='/n'>News</a></td><td><h1>A bridge is mended</h1><p>The bridge over the river was closed for a year.</p>"
        f"<table>{cells}</table><pre>It opened on Monday, said the mayor.</pre><figure><figcaption>The bridge, seen from the town hall.</figcaption></figure>"
        "<p><a href='/a'>The first report</a> and <a href='/b'>the second report on the works</a> tell more.</p></td></tr></table><div class='footer'>Copyright 2020</div></body></html>"
    )
    page = htmltext.blocks(html)
    text = [b.text for b, ok in zip(page, htmltext.production_labeller().label([page])[0]) if ok]
    assert [b.text for b in page][1:-1] == text


def test_repeated_rows_and_clashing_columns(spark):
    html = Pages(3).page("article")[0]
    rows = [(1, "u", html, "x", "y"), (1, "u", html, "x", "y"), (2, None, None, "x", "y"), (None, "u", "", "x", "y"), (3, "u", "no markup at all", "x", "y")]
    got = htmltext.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars string")).collect()
    assert len(got) == 5
    mine = [r for r in got if r.page_id == 1]
    assert mine[0] == mine[1] and mine[0].n_chars == len(mine[0].text) > 100
    assert all(r.text == "" and r.n_chars == 0 for r in got if r.page_id in (None, 2))
