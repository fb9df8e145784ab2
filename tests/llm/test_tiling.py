"""Greedy string tiles against a plain search, and on repeated words."""

import random
import time

from opslens.llm import tiling


def plain(a, b, least):
    """The longest match of unmarked words, first in a, then in b, again and again."""
    free_a, free_b, found = [True] * len(a), [True] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return sorted(found)
        free_a[i:i + n] = free_b[j:j + n] = [False] * n
        found.append((i, j, n))


def test_tiles_equal_a_plain_search():
    r = random.Random(5)
    for case in range(300):
        words = r.choice([1, 2, 3, 8])
        a, b = ([r.randrange(words) for _ in range(r.randrange(0, 40))] for _ in range(2))
        if case % 3 == 0 and len(b) > 6:
            a[3:3] = b[2:] + b[:4]
        least = r.randrange(1, 5)
        got, want = tiling.tiles(a, b, least), plain(a, b, least)
        assert sorted(n for _, _, n in got) == sorted(n for _, _, n in want)
        assert all(a[i:i + n] == b[j:j + n] for i, j, n in got)
        assert sorted(got) == want


def test_repeated_words_end_soon():
    began = time.monotonic()
    assert tiling.tiles([1] * 100_000, [1] * 300, 4) == [(0, 0, 300)]
    assert sum(n for *_, n in tiling.tiles([1, 2] * 5_000, ([1, 2] * 40 + [3]) * 4, 4)) == 4 * 80
    assert time.monotonic() - began < 30
