import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import packing
from quarry.llm.bpe import default_path, encoder

DOCS = "doc_id long, text string, rank string, length int, piece int"


def best_fit(lengths, size):
    """Best-fit decreasing on single pieces: the number of sequences."""
    rooms = []
    for x in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= x]
        rooms.append(size) if not fit else None
        r = min(fit) if fit else size
        rooms.remove(r)
        rooms.append(r - x)
    return len(rooms)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_plan_is_whole_and_no_worse_than_best_fit_on_pieces(lengths):
    counts = Counter(lengths)
    filled, ranks = defaultdict(list), defaultdict(list)
    for length, rank, n, first, offset in packing.plan(counts, 64):
        for k in range(n):
            filled[first + k].append((offset, length))
            ranks[length].append(rank + k)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(filled) <= best_fit(lengths, 64)


def check(rows, got, size):
    enc = encoder(default_path())
    want = {}
    for i, t in rows:
        ids = [*enc.library.encode(t or "", add_special_tokens=False).ids, 0]
        want.setdefault(i, []).append(ids)
    docs = defaultdict(list)
    for r in got:
        docs[r.doc_id].append(r)
    for i, parts in docs.items():
        parts.sort(key=lambda r: (r.piece, r.sequence_id))
        n = len(want[i])
        for k, r in enumerate(parts):
            ids = want[i][k % n][r.start : r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        total = len(want[i][0])
        assert sum(r.length for r in parts) == n * total
        assert {r.piece for r in parts} == set(range(max(1, -(-total // size))))
        assert all(r.length == size for r in parts if r.piece > 0)
    rooms = defaultdict(list)
    for r in got:
        rooms[r.sequence_id].append((r.offset, r.length))
    for parts in rooms.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    assert len(rooms) <= best_fit([r.length for r in got], size)


def test_pack_against_the_library(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choice(["alpha", "beta", "é", "xyzzy"]) for _ in range(rnd.choice([3, 3, 3, rnd.randint(0, 200)])))) for i in range(700)]
    rows += [(2000, None), (2001, ""), (2002, "word " * 1000), (2003, "a" * 64), (5, rows[5][1])]
    got = packing.pack(spark.createDataFrame([(i, t, "r", 1, 2) for i, t in rows], DOCS), size=64).collect()
    check(rows, got, 64)
    seqs = packing.packed_sequences(spark.createDataFrame([(i, t, "r", 1, 2) for i, t in rows[:90]], DOCS), size=64).collect()
    assert sum(len(s.ids) for s in seqs) == sum(len(encoder(default_path()).library.encode(t).ids) + 1 for _, t in rows[:90]) and max(len(s.ids) for s in seqs) <= 64


@pytest.mark.parametrize("rows", [[], [(None, None)], [(1, "x"), (1, "x")]])
def test_small_tables(spark, rows):
    got = packing.pack(spark.createDataFrame([(i, t, "r", 1, 2) for i, t in rows], DOCS)).collect()
    assert len(got) == len(rows)
