"""Hard negatives against a plain ranking of all pairs."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chunkloom.llm import hard_negatives as H


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 90), st.integers(1, 90), st.integers(1, 90), st.integers(0, 2**32))
def test_strassen_is_exact(m, k, n, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(-(2**28), 2**28, (m, k)), rng.integers(-(2**28), 2**28, (k, n))
    assert (H.strassen(a, b) == a @ b).all()


def test_scores_pad_and_refuse():
    assert H.scores(np.array([[1, 2, 3]]), np.array([[4, 5], [6, 7]])).tolist() == [[14, 20]]
    assert H.scores(np.zeros((2, 0), np.int64), np.array([[4, 5]])).tolist() == [[0], [0]]
    with pytest.raises(OverflowError):
        H.scores(np.array([[2**32]]), np.array([[2**31]]))


def test_heaps_in_any_order():
    rng = np.random.default_rng(5)
    score, allowed = rng.integers(-3, 4, (6, 40)), rng.random((6, 40)) < 0.4
    ids = np.arange(40) * 3
    heaps = H.Heaps(6, 4)
    for part in (slice(30, 40), slice(0, 3), slice(3, 30)):
        heaps.merge(0, 6, score[:, part], ids[part], allowed[:, part])
    for q in range(6):
        want = sorted((-int(s), int(i)) for s, i, ok in zip(score[q], ids, allowed[q]) if ok)[:4]
        got = [(-int(s), int(i)) for s, i in zip(heaps.score[q], heaps.id[q]) if i != H.NONE]
        assert got == want


def brute(rows):
    """rows: vec_id -> (label, integers)."""
    out = set()
    for a in sorted(i for i in rows if i % 100 == 0):
        score = {i: sum(x * y for x, y in zip(rows[a][1], v)) for i, (_, v) in rows.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if rows[i][0] == rows[a][0]][:5]:
            held = [i for i in order if rows[i][0] != rows[a][0] and 30 * score[p] <= 100 * score[i] <= 90 * score[p]]
            out |= {(a, p, r + 1, i, score[p], score[i]) for r, i in enumerate(held[:10])}
    return out


@pytest.mark.parametrize("chunk", [32 << 20, 64])
def test_as_brute_force(spark, tmp_path, monkeypatch, chunk):
    """Ties, repeated rows, unusable rows, unequal lengths, other columns; anchors in one chunk and in many."""
    monkeypatch.setattr(H, "CHUNK_BYTES", chunk)
    rng = np.random.default_rng(7)
    data = [(int(i), int(rng.integers(0, 3)), [float(x) for x in rng.integers(-4, 5, 6) / 8]) for i in range(0, 420)]
    data += [data[100], data[7], (1000, 1, [0.5]), (1001, 1, []), (1100, 2, [1.0] * 9), (-200, 0, [0.25, -0.125])]
    bad = [(1200, None, [1.0]), (1300, 1, None), (1400, 1, [1.0, None]), (1500, 1, [math.nan]), (1600, 1, [math.inf]), (None, 1, [1.0])]
    schema = "vec_id long, label int, embedding array<float>, rank string, own string, score string"
    spark.createDataFrame([(*r, "a", "b", "c") for r in data + bad], schema).write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = {i: ((y + 1) % 10 if i % 7 == 0 else y, [math.floor(256 * x) for x in v]) for i, y, v in data}
    got = H.query(spark, str(tmp_path)).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute(rows) and len(got) > 100


def test_nothing_to_mine(spark):
    rows = spark.createDataFrame([(100, 1, [1]), (200, 2, [1])], "vec_id long, label long, v array<long>")
    assert H.mine(rows, rows).collect() == [] and H.mine(rows.where("1 = 0"), rows).columns == H.mine(rows, rows).columns
    assert H.mine(rows.where("1 = 0"), rows).collect() == []
