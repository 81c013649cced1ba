"""Removal of repeated passages against a plain look-up of every window."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chunkloom.llm import common
from chunkloom.llm import passages as P

SCHEMA = "doc_id long, text string, d long, t int, k long, u long, at int, w int, n long, first long, found string, spans string"


def brute(rows, length):
    words = [re.findall("[^\x20\x09-\x0d]+", x or "") for _, x in rows]
    first = {}
    for (d, _), own in zip(rows, words):
        for i in range(len(own) - length + 1):
            if d is not None:
                key = tuple(own[i : i + length])
                first[key] = min(first.get(key, d), d)
    out = []
    for (d, _), own in zip(rows, words):
        gone = {j for i in range(len(own) - length + 1) if d is not None and first[tuple(own[i : i + length])] < d for j in range(i, i + length)}
        kept = " ".join(w for j, w in enumerate(own) if j not in gone)
        out.append((d, len(own), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=30, max_size=120), st.integers(0, 4), st.integers(8, 20))
def test_equal_windows_have_equal_owners(tail, shift, length):
    """Whatever stands around it, a window is owned by the same name at the same place, with the same reach."""
    words = [b"a", b"b", b"c", b"d"]
    own = [[words[i] for i in x] for x in (tail, tail[shift:] + [0, 1, 1, 2], [3, 3, 0] + tail[: len(tail) - shift])]
    seen = {}
    for text in own:
        sequence = P.Sequence()
        sequence.add(1, 1, 0, text)
        names, walls, _, _ = sequence.take()
        symbols = P.recompress(names, walls, 3)
        assert (np.diff(symbols.low) >= 0).all() and (np.diff(symbols.high) >= 0).all()
        windows = P._window_starts(walls, length)
        for i, o in zip(windows, P.owners(symbols, windows, length)):
            state = None if o < 0 else (int(symbols.name[o]), int(symbols.low[o] - i), int(symbols.high[o] - i))
            assert seen.setdefault(tuple(text[i - 1 : i - 1 + length]), state) == state


def texts(rng, n, length):
    """Prose of many and of few words, copies with edits, runs, periods, shared passages around the length, very short and odd texts."""
    pool = [f"w{i}" for i in range(400)]
    shared = [[str(x) for x in rng.choice(pool, length + d)] for d in (-1, 0, 1, 5, 40)]
    rows = []
    for i in range(n):
        kind, size = i % 9, int(rng.integers(1, 5 * length))
        if kind < 3:
            words = [str(x) for x in rng.choice(pool, size)]
        elif kind == 3:
            words = [str(x) for x in rng.choice(["a", "b"], size, p=[0.9, 0.1])]
        elif kind == 4:
            words = (["spam"] * size if i % 2 else ["x", "y", "z"] * (size // 3)) + ["end"] * int(rng.integers(0, 3))
        elif kind == 5 and rows:
            words = (rows[int(rng.integers(len(rows)))][1] or "").split()
            for _ in range(int(rng.integers(0, 3))):
                if words:
                    words[int(rng.integers(len(words)))] = "edit"
        else:
            words = [str(x) for x in rng.choice(pool, size // 2)]
        if kind in (2, 6, 7):
            at = int(rng.integers(0, len(words) + 1))
            words = words[:at] + shared[int(rng.integers(len(shared)))] + words[at:]
        rows.append((i, [" ", "\n", " \t\x0b "][i % 3].join(words)))
    rng.shuffle(rows)
    rows = [(int(i), str(x)) for i, x in rows]
    extra = [(None, rows[0][1]), (None, rows[0][1]), (n, None), (n + 1, ""), (n + 2, " \n"), rows[1], (rows[2][0], rows[3][1]), (n + 3, "é\u0085b c " * length), (n + 4, "é\u0085b c " * length)]
    return rows + extra


@pytest.mark.parametrize("length, rounds, small", [(50, 7, False), (8, 2, False), (8, 3, True), (3, 0, True), (1, 1, False)])
def test_as_brute_force(spark, monkeypatch, length, rounds, small):
    if small:
        for module, name, value in ((P, "PIECE_WORDS", 40), (P, "PIECE_BYTES", 90), (P, "KNOWN_WORDS", 7), (P, "BROADCAST_BYTES", -1), (common, "SPLIT_ROWS", 4)):
            monkeypatch.setattr(module, name, value)
    rows = texts(np.random.default_rng(length * 10 + rounds), 150, length)
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6, 7, 8, "f", "s") for r in rows], SCHEMA).repartition(5)
    got = P.remove_passages(docs, length, rounds).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    want = brute(rows, length)
    assert sorted((tuple(r) for r in got), key=str) == want and sum(r[2] for r in want) > 200


def test_kept_text_and_spans(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "x a b c y  z")], "doc_id long, text string")
    got = P.remove_passages(docs, 3).where("doc_id = 2").first()
    assert got.kept_text == "x y z" and [tuple(s) for s in got.spans] == [(1, 4)] and got.n_removed == 3
    assert P.remove_passages(docs.where("1 = 0")).collect() == []


def test_large_groups_are_dealt(spark):
    """One passage in a third of 6,000 texts: the rows of one class meet in many tasks, with the result unchanged."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, passage if i % 3 == 0 else f"own {i} " * 30) for i in range(6000)]
    got = {r.doc_id: r.n_removed for r in P.remove_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 60 if i % 3 == 0 and i else 0 for i, _ in rows}
    groups = spark.createDataFrame([(1, 10_000, "x"), (2, 5, "y")], "k long, n long, v string")
    members = spark.range(10_005).selectExpr("id as at", "if(id < 10000, 1, 2) as k")
    joined = common.join_split(members, groups, ["k"], ["at"], 10_005)
    assert joined.groupBy("v").count().collect() and sorted((r.v, r["count"]) for r in joined.groupBy("v").count().collect()) == [("x", 10_000), ("y", 5)]
