"""Sentences around comments, displays and footnotes that are longer than any fixed look-around."""

from __future__ import annotations

import pytest

from telemill.llm import sentences

COMMENT = "% a comment of far more than two dozen characters\n"


@pytest.mark.parametrize("text, want", [
    (f"We use tools, e.g. {COMMENT}hammers and saws. They work.", 2),
    (f"We use tools, etc. {COMMENT}and more of them. They work.", 2),
    ("这是第一句。\\footnote{a footnote of far more than two dozen characters}这是第二句。", 2),
])
def test_long_gaps(text, want):
    found = sentences.sentences(text)
    assert len(found) == want, [text[a:b] for a, b in found]
