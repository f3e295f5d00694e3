"""Alignments side by side against the alignment of one pair."""

import random

from spinel.operators import align


def _pairs(n, most, letters):
    rng = random.Random(11)
    return [tuple("".join(rng.choice(letters) for _ in range(rng.randrange(most))) for _ in range(2)) for _ in range(n)]


def test_batches_are_single_alignments(monkeypatch):
    for letters, gaps in (("AC", (-15.0, 0.0)), ("ACW-*x", (-10.0, -1.0)), ("ARNDCQEG", (-3.0, -0.7)), ("AL", (0.0, 0.0))):
        pairs = _pairs(400, 14, letters) + [None]
        want = [align.global_align(*p, *gaps) if p else None for p in pairs]
        assert align.align_all(pairs, *gaps) == want
        monkeypatch.setattr(align, "BATCH_SCORES", 900)
        assert align.align_all(pairs, *gaps) == want
        monkeypatch.undo()


def test_equal_pairs_are_aligned_once_and_short_ones_together(monkeypatch):
    alone, batches = [], []
    one, many = align.global_align, align._batch_align
    monkeypatch.setattr(align, "global_align", lambda *a: alone.append(a) or one(*a))
    monkeypatch.setattr(align, "_batch_align", lambda p, *g: batches.append(len(p)) or many(p, *g))
    align.align_all([("ACDEF", "ACEF"), ("AC", "A")] * 5000)
    assert alone == [] and sum(batches) == 2


def test_rows_carried_together_are_single_rows():
    rng = random.Random(3)
    rows = []
    for _ in range(200):
        n = rng.randrange(1, 15)
        rows.append(tuple("".join(rng.choice(x) for _ in range(k)) for x, k in (("ACD", rng.randrange(1, 12)), ("ACD-", n), ("ACD-", n), ("ACD", rng.randrange(1, 12)))))
    assert align.transitive_all(rows + rows) == [align.transitive(*r) for r in rows] * 2
