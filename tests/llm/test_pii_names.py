"""Addresses with an at or a spaced @ before a plain domain."""

import pytest

from larkspur.llm import pii


@pytest.mark.parametrize("said", ["jane.doe at example.com", "jane.doe @ example.com", "jane_doe AT mail.example.co.uk", "jane7 @example.com", "jane.doe@ EXAMPLE.ORG"])
def test_at_before_a_plain_domain(said):
    text = f"Write to {said}. Or call."
    assert pii.find(text) == [("email", 9, 9 + len(said), said, False)]


@pytest.mark.parametrize("text", ["look at example.com", "see us @ example.com", "built in 2019 at example.com", "version 1.2 at example.com", "jane_doe at home.Then we", "jane.doe at home", "at example.com", "@ example.com", "End. At example.com", "x" * 50 + " @" * 5000, "a.b" + " " * 200_000 + "at"])
def test_words_before_a_website_stay(text):
    assert pii.find(text) == []
