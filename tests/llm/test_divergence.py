"""The divergence audit against a plain computation over all terms."""

import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chunkloom.llm import divergence as D

SCHEMA = "doc_id long, text string, lang string, source string, n long, term string, value string, rank int, block int, v int"


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40) | st.text(alphabet="aZé×日\u0000 \u007f'1 \n", max_size=40))
def test_terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    assert [t.decode() for t in D.terms_of(text)] == re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), max_size=60), st.integers(1, 5))
def test_band(points, k):
    first, second = (np.array([p[i] for p in points], np.int64) for i in (0, 1))
    third = np.random.default_rng(len(points)).permutation(len(points))
    want = {i for i in range(len(points)) if sum(first[j] >= first[i] and second[j] <= second[i] and third[j] < third[i] for j in range(len(points))) < k}
    assert set(D.band(first, second, third, k).tolist()) == want


def brute(rows, least_docs, top):
    groups, docs, counts = set(), {}, {}
    for text, lang, source in rows:
        lang, source, terms = lang or "", source or "", [t.decode() for t in D.terms_of(text)]
        groups.add((lang, source))
        docs.setdefault(lang, Counter()).update(set(terms))
        for g in ((lang, source), (lang,)):
            counts.setdefault(g, Counter()).update(terms)
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs[lang].items() if n >= least_docs)
        p = {}
        for g in [(lang,), *(g for g in groups if g[0] == lang)]:
            total = sum(counts[g][t] for t in kept)
            p[g] = {t: 1 + 10**9 * (counts[g][t] + 2) // (total + 2 * len(kept)) for t in kept}
        apart = lambda a, b, t: (p[a][t] - p[b][t]) ** 2 // (p[a][t] + p[b][t])
        for g in (g for g in groups if g[0] == lang):
            pairs = [(-sum(apart(g, o, t) for t in kept), o[1].encode()) for o in groups if o[0] == lang and o != g]
            terms = [(-apart(g, (lang,), t), t.encode()) for t in kept if counts[g][t] and p[g][t] > p[lang,][t]]
            out |= {(*g, "pair", i.decode(), -v, r + 1) for r, (v, i) in enumerate(sorted(pairs))}
            out |= {(*g, "term", i.decode(), -v, r + 1) for r, (v, i) in enumerate(sorted(terms)[:top])}
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    words = ["the", "Über", "日本", "x", "of", *(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120))]
    out = []
    for i in range(400):
        picked = rng.choice(len(words), int(rng.integers(0, 30)), p=(w := 1 / (1 + np.arange(len(words)))) / w.sum())
        out.append((" ".join(words[(j * (1 + i % 3)) % len(words)] for j in picked), ["en", None, "", "de"][i % 4], [None, "s1", "S2", "é", "hot", "hot", "hot"][i % 7]))
    out += [(None, "fr", "a"), ("", "fr", "b"), ("1 2 3", "fr", None), ("long words " * 30_000, "en", "hot"), out[5], out[5]]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_as_brute_force(spark, rows, monkeypatch, small):
    """Once as it is, once with every block, hold and hint at its smallest."""
    if small:
        for name, value in (("SOURCE_BLOCK", 2), ("BLOCK_COUNTS", 50), ("HELD_TERMS", 40), ("WAITING", 8), ("HELD_POINTS", 20), ("BROADCAST_GROUPS", -1), ("MERGES", 3)):
            monkeypatch.setattr(D, name, value)
    docs = spark.createDataFrame([(i, *r, 1, "t", "v", 2, 3, 4) for i, r in enumerate(rows)], SCHEMA).repartition(5)
    got = D.audit(docs, 5, 4).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute(rows, 5, 4)


def test_empty_table_and_large_counts(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert D.audit(docs).collect() == []
    n, total, v = 7 * 10**12, 9 * 10**13, 12_345
    got = spark.createDataFrame([(n, total, v)], "n long, total long, v long").select(D.share("n", "total").alias("p")).first().p
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * v)
