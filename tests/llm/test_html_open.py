"""op9: end tags count however many elements were left open before them."""

import pytest

from talkframe.llm import html_text

OPEN = {"b": "<b>x", "font": "<font size=1>x", "cells": "<tr><th>x<td>y", "terms": "<dt>x<dd>y"}


@pytest.mark.parametrize("name", sorted(OPEN))
@pytest.mark.parametrize("holder", ["nav", "aside", "form", "div class='menu'"])
def test_unclosed_in_furniture(name, holder):
    page = f"<body><{holder}>{OPEN[name] * 100}</{holder.split()[0]}><article><p>The text.</p></article></body>"
    assert html_text.main_text(page) == "The text."


def test_unclosed_in_article():
    assert html_text.main_text(f"<body><article><p>The text.{'<b>' * 100}</article><div>After it</div></body>") == "The text."


def test_cells_close_each_other():
    row = "<tr><td class=promo>Buy<th>Head<td>Cell"
    assert html_text.main_text(f"<article><table>{row * 2}</table><dl><dt class=ad>Ad<dd>Term</dl></article>") == "Head\n\nCell\n\nHead\n\nCell\n\nTerm"
    assert html_text.main_text("<article><ul><li class=menu>No<li>Yes<ul><li>Inner</ul></ul></article>") == "Yes\n\nInner"
