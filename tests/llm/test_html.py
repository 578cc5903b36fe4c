"""Main text of pages whose article is known, and of pages that are hardly pages."""

from __future__ import annotations

import random
import time

import pytest

from cairnfield.llm import html

PARAGRAPH = "Paragraph {} of the article has a good number of words in it, so that it counts as content."
MENU = "<nav><a href='/'>Home</a><a href='/about'>About us</a></nav>"


def page(body: str) -> str:
    return f"<html><head><title>T</title></head><body>{MENU}{body}<footer>Imprint</footer></body></html>"


def paragraphs(n: int, start: int = 0) -> str:
    return "".join(f"<p>{PARAGRAPH.format(start + k)}</p>" for k in range(n))


def expected(n: int) -> str:
    return "\n".join(PARAGRAPH.format(k) for k in range(n))


@pytest.mark.parametrize(
    ("body", "n"),
    [
        (f"<div>{paragraphs(6)}</div><div>{paragraphs(3, 6)}</div>", 9),
        (f"<section>{paragraphs(2)}</section><div><a href='/x'>More to read</a></div><section>{paragraphs(2, 2)}</section>", 4),
        (f"<div class='content with-sidebar'>{paragraphs(6)}</div><div>unrelated</div>", 6),
        (f"<div class='has-sidebar'><article>{paragraphs(6)}</article><div class='sidebar'>Side</div></div>", 6),
        (f"<div class='sidebar-left'>{paragraphs(6)}<div class='ad'>Buy</div></div>", 6),
        (f"<div class='post'>{paragraphs(3)}</div><div class='comments'>{paragraphs(9, 50)}</div>", 3),
        (f"<form id='whole-page'><div>{paragraphs(3)}</div><div class='sidebar'>Side</div></form>", 3),
        (f"<article>{paragraphs(3)}<form><label>Mail</label></form><div class='comments'><article class='comment'>{paragraphs(4, 50)}</article></div></article>", 3),
        (f"<main><article>{paragraphs(3)}</article><div>{paragraphs(2, 3)}</div><div><a href='/x'>More</a></div></main>", 5),
        (f"<article>{paragraphs(1)}</article><article>{paragraphs(1, 1)}</article><article>{paragraphs(1, 2)}</article>", 3),
        (paragraphs(3), 3),
    ],
)
def test_known_articles(body, n):
    assert html.main_text(page(body)) == expected(n)


def test_title_beside_the_paragraphs_stays():
    assert html.main_text(page(f"<h1>Title</h1>{paragraphs(3)}<p>End.</p>")) == "Title\n" + expected(3) + "\nEnd."


@pytest.mark.parametrize("broken", ["<p>a</p><![foo[ x", "<![x]>", "<![", "<!", "<!-", "</", "<!DOCTYPE html [<!ENTITY a 'b'>]><p>a", "&#xffffffff;", "<a b='"])
def test_malformed_declarations(broken):
    assert isinstance(html.main_text(broken), str)
    assert expected(3) in html.main_text(f"<article><![if x]>{paragraphs(3)}<![endif]></article>")


def test_random_pieces_never_raise():
    rng = random.Random(1)
    pieces = ["<div class='ad'>", "<article>", "</article>", "<p>", "</p>", "<![", "]]>", "<!--", "-->", "<!", "<?", "</div>", "<", "&amp", "&#", "some words ", "<script>", "</script>", "<td>", "<li>", "<a href='", "'>", "</a>", "<form>", "</form>", "\x00", "<main>", "</main>", "<header>", "<h1>", "<body>", "<table>"]
    for _ in range(4000):
        text = html.main_text("".join(rng.choices(pieces, k=rng.randint(1, 40))))
        assert not any(line != " ".join(line.split()) or not line for line in text.split("\n")) or not text


def test_generated_pages_give_their_article():
    rng = random.Random(2)
    for _ in range(200):
        lines, body = [], []
        for k in range(rng.randint(2, 12)):
            words = " ".join(rng.choices("several plain words make up this article here".split(), k=rng.randint(4, 60))) + f" {k}"
            lines.append(words + " & more")
            body.append(f"<{(tag := rng.choice(['p', 'li', 'blockquote', 'h2']))}>{words}\n  &amp;  more</{tag}>")
        noise = ["<div class='ad'>Buy <b>now</b></div>", "<aside>Side words</aside>", "<div id='newsletter-signup'>Join us</div>", "<script>x='<p>no</p>'</script>", "<!-- <p>no</p> -->"]
        for part in rng.choices(noise, k=3):
            body.insert(rng.randint(0, len(body)), part)
        assert html.main_text(page(f"<article>{''.join(body)}</article><div class='comments'>No</div>")).split("\n") == lines


def test_time_is_linear_in_depth():
    def took(n: int) -> float:
        began = time.perf_counter()
        html.main_text("<div>" * n + "words" + "<p>a</p>" * n)
        return time.perf_counter() - began

    took(1000)
    assert took(32_000) < 40 * max(took(4000), 0.02)
