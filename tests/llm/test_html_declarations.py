"""Declarations that the page parser of the standard library stops at."""

import random

import pytest

from tallyweir.llm.htmltext import main_text


@pytest.mark.parametrize("stray", ["<![endif-x]>", "<![>", "<![ y>", "<![endif]-->", "<![if !IE]>", "<![if x>", "<![CDATA[x>", "<![1]>"])
def test_text_after_a_stray_declaration_stays(stray):
    found = main_text(f"<article><p>one</p>{stray}<p>two</p><p>three]]></article>")
    assert found.split("\n")[0] == "one" and found.split("\n")[-2:] == ["two", "three]]>"]


def test_declaration_that_never_ends():
    found = main_text("<article><p>one</p><![ two")
    assert found.startswith("one") and found.endswith("two")
    assert main_text("x <![ y <p>b</p>") == "x b"  # the comment ends at the tag's own >


def test_no_page_stops_the_parser():
    rng = random.Random(5)
    parts = ["<![", "<!", "<!-", "<!--", "-->", "]]>", "]>", ">", "<", "</", "<p>", "</p>", "<a href='", "'", '"', "if", "endif", "CDATA[", "<?", "&", "&#", "x", " ", "<!DOCTYPE", "<script>", "</script>", "é", "\0", "="]
    for _ in range(20_000):
        assert isinstance(main_text("".join(rng.choices(parts, k=rng.randint(1, 14)))), str)
