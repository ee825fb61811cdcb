"""Where sentences end, against a loop over characters, and in time that grows with the length."""

import random
import time

import pytest

from termwright.llm.substring import _SENTENCE

MARKS = ".!?…"


def by_loop(line):
    out, at = [], 0
    while at < len(line):
        if line[at].isspace():
            at += 1
            continue
        end = at + 1
        while end < len(line) and not (line[end].isspace() and line[end - 1] in MARKS and end - 1 > at):
            end += 1
        out.append((at, end))
        at = end
    return out


@pytest.mark.parametrize("seed", range(5))
def test_sentences_are_those_of_a_loop(seed):
    draw = random.Random(seed)
    for _ in range(4000):
        line = "".join(draw.choice("ab.!?… \t é") for _ in range(draw.randrange(14)))
        assert [m.span() for m in _SENTENCE.finditer(line)] == by_loop(line), repr(line)
        start, end = sorted(draw.randrange(len(line) + 1) for _ in range(2))
        assert [(a - start, b - start) for a, b in (m.span() for m in _SENTENCE.finditer(line, start, end))] == by_loop(line[start:end])


@pytest.mark.parametrize("piece", [".", "a.", ". ", "…!", "word "])
def test_long_lines_take_little_time(piece):
    line = piece * 200_000
    start = time.time()
    assert sum(m.end() - m.start() for m in _SENTENCE.finditer(line)) > 0
    assert time.time() - start < 1
