"""Leaks whose parts lie apart or are short, against a rule written out on plain strings."""

import random
import re

from chunkloom.llm import decontamination

DATA = "/root/testdata/sf0.001"


def plain(text):
    return re.sub(r"[^a-z0-9\u0080-\U0010ffff]+", " ", text.lower()).split()


def share(part, text):
    """Share of the part's runs of five words (all of its words, if fewer) that stand in the text."""
    n = min(5, len(part))
    runs = {" ".join(part[i : i + n]) for i in range(len(part) - n + 1)}
    line = f" {' '.join(text)} "
    return sum(f" {r} " in line for r in runs) / len(runs)


def parts(text):
    end = re.search(r"\n|[.?!](?=\s|$)|$", text).end()
    return plain(text[:end]), plain(text[end:])


def leaks(items, text):
    found = set()
    for i, item in items:
        q, a = parts(item)
        own = share(q + a, plain(text))
        if own >= 0.8 or q and a and len(q + a) >= 5 and min(share(q, plain(text)), share(a, plain(text))) >= 0.8:
            found.add(i)
    return found


def benchmark(spark):
    return [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]


def test_question_far_from_answer(spark):
    items = [(i, x) for i, x in benchmark(spark) if min(map(len, parts(x))) >= 5]
    between = " ".join(f"other{j}" for j in range(200))
    texts = [f"{' '.join(parts(x)[0])} {between} {' '.join(parts(x)[1])}" for _, x in items]
    got = decontamination.Index(items).matches(texts)
    for k, (i, _) in enumerate(items):
        assert i in leaks(items, texts[k])
        assert {g[1] for g in got if g[0] == k} == leaks(items, texts[k])
    assert all(g[2] > 0 for g in got)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")
    assert decontamination.clean(rows, table).count() == 0 and decontamination.search(rows, table).count() == len(got)


def test_runs_scattered_over_the_text(spark):
    """Runs of an item in any order, each among 100 other words: no passage holds much of it."""
    items, rng = [(i, x) for i, x in benchmark(spark) if len(plain(x)) >= 30], random.Random(1)
    for i, x in items[:6]:
        words = plain(x)
        runs = [words[j : j + 5] for j in range(len(words) - 4)]
        rng.shuffle(runs)
        text = " ".join(" ".join(r) + " " + " ".join(f"w{rng.random()}" for _ in range(100)) for r in runs[: -(-len(runs) * 9 // 10)])
        assert i in leaks(items, text)
        assert {g[1] for g in decontamination.Index(items).matches([text])} == leaks(items, text)


def test_short_question_or_answer():
    items = [
        (1, "Which river runs through the old town of Prague today?\nThe Vltava"), (2, "Define entropy.\nA measure of how much disorder a closed system holds at one time"),
        (3, "Who wrote it?\nJane Austen did"), (4, "blue whale song"), (5, "Is it so? Yes."),
    ]
    texts = [
        "Question: which river runs through the old town of Prague today? Answer: the Vltava.", "which river runs through the old town of Prague today? Answer: the Elbe, not Vltava the",
        "Entropy. To define entropy. Answer: a measure of how much disorder a closed system holds at one time", "who wrote it? Answer: Jane Austen did", "who wrote it? Jane did, Austen did",
        "we heard the blue whale song at night", "blue song whale", "it is so, yes", "is it so yes", "blue whale song", "", "blue whale songs",
    ]
    got = decontamination.Index(items).matches(texts)
    assert [{g[1] for g in got if g[0] == k} for k in range(len(texts))] == [leaks(items, x) for x in texts]
    assert [leaks(items, x) for x in texts] == [{1}, set(), {2}, {3}, set(), {4}, set(), set(), {5}, {4}, set(), set()]
    assert all(g[2] > 0 for g in got)


def test_short_parts_of_the_benchmark(spark):
    """Given items with a short question or answer, its parts with other words between them, beside the given texts."""
    items = benchmark(spark)
    own = [x for _, x in items if 0 < min(map(len, parts(x))) < 5]
    texts = [f"on {' '.join(parts(x)[0])} answer {' '.join(f'so{j}' for j in range(120))} {' '.join(parts(x)[1])}" for x in own]
    texts += [r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(60).collect()]
    got = decontamination.Index(items).matches(texts)
    assert own and [{g[1] for g in got if g[0] == k} for k in range(len(texts))] == [leaks(items, x) for x in texts]
