"""Prose that looks like furniture, furniture that looks like prose, broken pages, and generated pages without ``article``."""

import random
import time

import pytest

from tallyweir.llm.htmltext import main_text

LONG = "Some long text here of the article, which goes on for a while."
PAGES = [
    (f'<article><h1>T</h1><div class="share"><p>The share price fell. It had been high for a long time before that day.</p></div><p>{LONG}</p></article>', f"T\nThe share price fell. It had been high for a long time before that day.\n{LONG}"),
    (f"<article><h1>T</h1><p>{LONG}</p><p><a href=1>One link with words</a> and <a href=2>another link with words</a></p></article>", f"T\n{LONG}\nOne link with words and another link with words"),
    (f"<article><h1>T</h1><p>{LONG}</p><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></article>", f"T\n{LONG}"),
    (f'<body><div class=post><h1>T</h1><p>{LONG}</p></div><div id="commentlist"><p>{LONG} {LONG} {LONG}</p></div></body>', f"T\n{LONG}"),
    (f'<article><p>{LONG}</p><div class="share-buttons">Share this</div></article>', LONG),
    (f"<header><h1>Site</h1></header><article><header class=entry-header><h1>Title</h1></header><p>{LONG}</p></article>", f"Title\n{LONG}"),
    ("<p>one<!-- never ends <p>two", "one never ends\ntwo"), ("<p>a &amp; b <b", "a & b <b"), ("<p>x</p><!--> y <p>z</p>", "x\ny\nz"), ("<p>x</p><!-- <p>c</p> --><p>z</p>", "x\nz"),
]


@pytest.mark.parametrize("html, text", PAGES)
def test_pages(html, text):
    assert main_text(html) == text


@pytest.mark.parametrize("broken", ["<a ", "<!-- -", "<![ ", "</a ", '<a b="', "<a b='x", "<? ", "<!doctype "])
def test_ends_that_never_come_take_no_quadratic_time(broken):
    took = []
    for n in (8_000, 64_000):
        start = time.time()
        main_text("<p>text</p>" + broken * n)
        main_text("<p>text</p>" + broken * n + ">x")
        took.append(time.time() - start)
    assert took[1] < 20 * took[0] + 1


def generated(seed):
    """(page without an article element, its text): an article among menus, sidebars, comments and notices of many shapes."""
    rng = random.Random(seed)
    words = [rng.choice("bcdfglmnprst") + rng.choice("aeiou") + rng.choice("bcdfglmnprst") + rng.choice(["", "er", "ing", "ed"]) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    links = lambda n: "".join(f"<li><a href='/{k}'>{rng.choice(words)}</a></li>" for k in range(n))
    blocks, body = [prose(rng.randint(3, 8))], []
    body.append(f"<h1>{blocks[0]}</h1>")
    for _ in range(rng.randint(4, 12)):
        kind = rng.random()
        if kind < 0.15:
            blocks.append(prose(4))
            body.append(f"<h2>{blocks[-1]}</h2>")
        elif kind < 0.3:
            a, b = prose(15), prose(12)
            blocks.append(f"{a} {b}")
            body.append(f"<p>{a} <a href=/x>{b}</a></p>")
        elif kind < 0.4:
            items = [prose(9) for _ in range(3)]
            blocks += items
            body.append("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>")
        else:
            blocks.append(prose(rng.randint(25, 80)))
            body.append(f"<p>{blocks[-1]}</p>")
    inner = "\n".join(body)
    for _ in range(rng.randint(0, 2)):
        inner = f"<div class={rng.choice(['content', 'post', 'entry', 'text'])}>{inner}</div>"
    page = [f"<nav><ul>{links(8)}</ul></nav>" if rng.random() < 0.5 else f"<div class=menu><ul>{links(8)}</ul></div>", f"<div id=main>{inner}</div>"]
    if rng.random() < 0.6:
        page.append(f"<div class=sidebar><h3>{rng.choice(words)}</h3><ul>{links(6)}</ul></div>")
    if rng.random() < 0.5:
        page.append("<div id=comments>" + "".join(f"<div class=comment><p>{prose(12)}</p></div>" for _ in range(4)) + "</div>")
    if rng.random() < 0.5:
        page.append(f"<div class=cookie-notice>{prose(12)}</div>")
    page.append(f"<footer>{prose(6)}<ul>{links(4)}</ul></footer>")
    return "<html><head><title>t</title></head><body>" + "\n".join(page) + "</body></html>", "\n".join(blocks)


def test_generated_pages_without_article():
    exact = [main_text(html) == text for html, text in map(generated, range(400))]
    print("exact pages of 400:", sum(exact))
    assert sum(exact) >= 380
