"""Alignments with kept rows against whole matrices, and what a long one takes."""

import random
import tracemalloc

import numpy as np
import pytest
from spinel.operators import align


def whole(a, b, gap_open, gap_extend):
    """All three matrices, cell by cell."""
    m, n = len(a), len(b)
    x, y = align.codes(a), align.codes(b)
    s = np.full((3, m + 1, n + 1), align.LOW)
    s[0, 0, 0] = 0
    for i in range(m + 1):
        for j in range(n + 1):
            if i and j:
                s[0, i, j] = s[:, i - 1, j - 1].max() + align.SCORES[x[i - 1]][y[j - 1]]
            if j:
                s[1, i, j] = max(s[0, i, j - 1] + gap_open, s[1, i, j - 1] + gap_extend)
            if i:
                s[2, i, j] = max(s[0, i - 1, j] + gap_open, s[2, i - 1, j] + gap_extend)
    return float(s[:, m, n].max())


def value(p, q, gap_open, gap_extend):
    """What an alignment scores, and whether a gap follows the other one."""
    total, last = 0.0, 0
    for c, d, k in zip(p, q, [0 if c is not None and d is not None else 1 if c is None else 2 for c, d in zip(p, q, strict=True)], strict=True):
        total += align.SCORES[align.codes(c)[0]][align.codes(d)[0]] if k == 0 else gap_extend if k == last else gap_open
        assert k == 0 or last in (0, k)
        last = k
    return total


@pytest.mark.parametrize("gaps", [(-15.0, 0.0), (-10.0, -1.0), (-2.0, -0.5)])
def test_scores_and_strings(gaps):
    rng = random.Random(int(gaps[0]))
    for _ in range(60):
        a = "".join(rng.choice("ACDRX") for _ in range(rng.randint(0, 18)))
        b = "".join(c for c in a if rng.random() > 0.3) + "".join(rng.choice("ACW") for _ in range(rng.randint(0, 6)))
        p, q, score = align.global_align(a, b, *gaps)
        assert p.replace("-", "") == a and q.replace("-", "") == b and len(p) == len(q)
        assert abs(score - whole(a, b, *gaps)) < 1e-9
        marks = [[None if c == "-" else c for c in z] for z in (p, q)]
        assert abs(value(*marks, *gaps) - score) < 1e-9


def test_kept_rows_are_the_rows():
    x, y = align.codes("ACDEFGHIKL" * 5), align.codes("ACDFGHWWIKL" * 4)
    rows = align._Rows(x, y, -10.0, -1.0)
    plain = [rows.kept[0]]
    for i in range(1, len(x) + 1):
        plain.append(rows.next(plain[-1], i))
    assert all((rows[i] == plain[i]).all() for i in range(len(x), -1, -1)) and (rows.last == plain[-1]).all()


def test_long_strings_take_little_memory():
    rng = random.Random(7)
    a = "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(4000))
    b = "".join(c for c in a if rng.random() > 0.1)
    tracemalloc.start()
    p, q, _ = align.global_align(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert p.replace("-", "") == a and q.replace("-", "") == b and peak < 40_000_000
