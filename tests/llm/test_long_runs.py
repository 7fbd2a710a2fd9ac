"""Texts of a megabyte without a break take a moment, and short ones keep their answers."""

import random
import re
import time

import pytest

from conform.llm import pii, toxicity

MB = 1 << 20


def in_a_moment(f, *args):
    """Linear work on a megabyte; work that grows with the square would take hours."""
    start = time.time()
    f(*args)
    assert time.time() - start < 10


@pytest.mark.parametrize("text", ["7" * MB, "7." * (MB // 2), "a" * MB + " (at) x dot y dot", "a." * (MB // 2) + " dot (at)", "1.2.3." * (MB // 6)])
def test_personal_data_in_long_runs(text):
    in_a_moment(pii.candidates, text)


def test_ip_matches_are_those_of_the_plain_pattern():
    plain, rng = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), random.Random(1)
    for _ in range(20_000):
        text = "".join(rng.choices("12.. a", k=rng.randint(0, 24)))
        assert [m.span() for m in pii._IP.finditer(text)] == [m.span() for m in plain.finditer(text)], text


@pytest.mark.parametrize("token", ["a" * MB, "ab" * (MB // 2), "-" * MB + "a", "." * MB, "ab" * 9000 + "!!" + "x" * 9000])
def test_odd_words_in_long_runs(token):
    in_a_moment(toxicity._odd, toxicity._trim(token))


def test_odd_words_are_those_of_the_plain_pattern():
    odd = re.compile(r"[^\W\d_]*(?:[0-9@$!|+€.\-_*~'])[^\s]*[^\W\d_]|([^\W\d_])\1\1")
    trim, rng = re.compile(r"^[^\w$@!|+€]+|[^\w]+$"), random.Random(2)
    for _ in range(20_000):
        token = "".join(rng.choices("aab1!-_€.,é", k=rng.randint(0, 9)))
        assert toxicity._trim(token) == trim.sub("", token) and toxicity._odd(token) == bool(odd.search(token)), token
