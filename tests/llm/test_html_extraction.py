from __future__ import annotations

import time

import numpy as np
from rubato.llm import html_extraction as h
from rubato.llm.page_templates import training_pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p><p>no";</script></head><body>
<header><div class="logo">My Site</div></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<div class="cookie-banner">We use cookies to improve your experience.</div>
<article><h1>Big &amp; small news</h1><p>First paragraph, with <b>bold</b> text&nbsp;and a <a href="/x">link</a>.
It goes on for a while, telling of many things.<div class="ad">Buy now, free shipping!</div><p>Second&#33; paragraph<br>of the story.</article>
<section class="comments"><div class="comment"><p>I liked this story very much.</p></div></section>
<form><input name=q><button>Search</button></form><footer>&copy; 2020 All rights reserved</footer></body></html>"""


def test_blocks_and_references():
    blocks = h.blocks_of(PAGE)
    texts = [b.text for b in blocks]
    assert "First paragraph, with bold text and a link. It goes on for a while, telling of many things." in texts
    assert "Second! paragraph of the story." in texts and not any("var t" in t or t == "T" for t in texts)
    menu = next(b for b in blocks if b.text == "Home")
    assert menu.link_chars == 4
    assert [b.text for b in h.blocks_of('a < b <p title="x > y">c</p><!-- d --><x')] == ["a < b", "c"]
    assert h.blocks_of("") == [] and h.blocks_of("<script>x") == []


def test_empty_foreign_elements_and_deep_markup():
    assert [b.text for b in h.blocks_of('<p>a<svg width="1"/>b<p>c<math/>d<svg>x</svg>e<p>f<svg class=y/>x</svg>g')] == ["ab", "cdxe", "fxg"]
    deep = h.blocks_of("<div>" * 250 + "in" + "</div>" * 249 + "<p>out</p></div><p>after</p>")
    flat = h.blocks_of("<div><p>out</p></div><p>after</p>")
    assert [b.text for b in deep] == ["in", "out", "after"]
    assert [(b.path, b.depth) for b in deep[1:]] == [(b.path, b.depth) for b in flat]


def test_article_is_found():
    text = h.main_texts(h.trained_labeller(), [PAGE, None, "", "<p>"])
    assert text[1:] == ["", "", ""]
    assert text[0].split("\n\n") == [
        "Big & small news",
        "First paragraph, with bold text and a link. It goes on for a while, telling of many things.",
        "Second! paragraph of the story.",
    ]


def test_accuracy_on_sites_not_trained_on():
    model = h.trained_labeller()
    right = total = 0
    for site in training_pages(150, 12345):
        blocks = h.blocks_of(site.html)
        truth = np.array([b.text in site.main for b in blocks])
        right += int(((h.label_pages(model, [blocks])[0] >= 0.5) == truth).sum())
        total += len(truth)
    assert right / total > 0.98


def test_gradients_are_right():
    rng = np.random.default_rng(1)
    m = h.fresh_labeller()
    pages = [h.blocks_of(s.html)[:6] for s in training_pages(3, 8)]
    x = h.Pages.of(pages)
    y = rng.integers(0, 2, int(x.lengths.sum())).astype(float)
    loss = lambda: float(-np.mean(np.log(np.where(y == 1, p := h.forward(m, x)[0], 1 - p))))
    grads = h.gradients(m, x, y)
    for name in ("wx", "wh", "out", "skip", "b", "paths", "words"):
        value = getattr(m, name)
        for at in np.argsort(-np.abs(grads[name]).ravel())[:3]:
            i = np.unravel_index(at, value.shape)
            old = value[i]
            value[i] = old + 1e-5
            up = loss()
            value[i] = old - 1e-5
            down = loss()
            value[i] = old
            assert abs((up - down) / 2e-5 - grads[name][i]) < 1e-6


def test_query_against_the_article_element(spark, small_dir):
    rows = {r.page_id: r for r in h.op8_html_extraction(spark, small_dir).collect()}
    pages = spark.read.parquet(f"{small_dir}/pages.parquet").collect()
    same = 0
    for p in pages:
        inner = p.html[p.html.index("<article>") : p.html.index("</article>")]
        want = "\n\n".join(b.text for b in h.blocks_of(inner))
        same += rows[p.page_id].text == want
        assert rows[p.page_id].n_chars == len(rows[p.page_id].text) and rows[p.page_id].url == p.url
    assert same >= 0.98 * len(pages)


def test_odd_tables(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    rows = [(None, None, None, "x", "y"), (1, "u", "", "x", "y"), (1, "u", PAGE, "x", "y"), (1, "u", PAGE, "x", "y"), (2, "v", "<div>" * 5000 + "deep" + "<b>" * 9000, "x", "y"), (3, "w", '<a "' * 20_000, None, None)]
    found = h.extract_main_text(spark.createDataFrame(rows, schema)).collect()
    assert len(found) == len(rows) and all(r.text is not None for r in found)
    assert h.extract_main_text(spark.createDataFrame([], schema)).count() == 0


def test_nothing_is_capped_or_dropped_by_name():
    for n in (10, 5000, 200_000):
        assert [b.text for b in h.blocks_of(f'<p data-a="{"y" * n}>z">hello</p><p title=\'{">" * n}\' class=b>there</p>')] == ["hello", "there"]
    assert [b.text for b in h.blocks_of("<p>Let <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac></math> be y</p>")] == ["Let x=12 be y"]
    assert [b.text for b in h.blocks_of("<p>An <svg viewBox='0 0 1 1'><g><path d='M0'/><text>icon</text></g></svg> here</p><p>next</p>")] == ["An icon here", "next"]
    assert [b.text for b in h.blocks_of("<p>see <object data=x>the figure</object><noscript>, or not</noscript></p>")] == ["see", "the figure", ", or not"]
    # an element that is never closed ends where a paragraph begins, or with the element around it
    assert [b.text for b in h.blocks_of("<div><svg><g>a<p>b</p></div><section><math>c</section><p>d")] == ["a", "b", "c", "d"]
    assert [b.text for b in h.blocks_of("<p>a <math><mi>x</mi></p><p>b</p>")] == ["a x", "b"]


def test_blocks_equal_a_plain_parser():
    """Block texts of small random pages, against a parser that keeps its open elements in a plain list."""
    rng = np.random.default_rng(3)
    names, words = ["div", "p", "b", "span", "li", "ul", "section", "td"], ["one", "two &amp; three", "x", " "]
    for _ in range(300):
        page, want, line, opened = "", [], "", []

        def end():
            nonlocal line
            want.extend([" ".join(line.split())] if line.strip() else [])
            line = ""

        for _ in range(rng.integers(1, 25)):
            kind = rng.integers(0, 3)
            if kind == 0:
                word = words[rng.integers(0, len(words))]
                page, line = page + word, line + word.replace("&amp;", "&")
            elif kind == 1:
                name, quote = names[rng.integers(0, len(names))], "'\""[rng.integers(0, 2)]
                page += f"<{name} a={quote}{'<>'[rng.integers(0, 2)] * rng.integers(0, 6000)}{quote}>"
                opened.append(name)
                if name not in ("b", "span"):
                    end()
            elif opened:
                name = opened.pop()
                page += f"</{name}>"
                if name not in ("b", "span"):
                    end()
        end()
        assert [b.text for b in h.blocks_of(page)] == want


def test_odd_quotes_cost_no_more_than_the_page():
    for page in ("<a x=\">\" " * 50_000, '<a x="' * 50_000, "<a x='\"> " * 50_000, '<p class="' + "y" * 300_000 + ">text"):
        began = time.time()
        h.blocks_of(page)
        assert time.time() - began < 5


def test_open_inline_elements_cost_no_more_than_the_page():
    """Each end tag finds its element at once, however many are open above it."""
    n = 100_000
    began = time.time()
    found = h.blocks_of("<p>" + "<i>" * n + "<b>" * n + "</i>" * n + "text</p><p>next")
    assert [b.text for b in found] == ["text", "next"] and time.time() - began < 4
