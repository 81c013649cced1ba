"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. Its evidence is a handful of measures (case, symbols, separators, repetition, length) in
quantile bins, its own and those of the lines before and after; neighbouring labels share a transition. Forward-backward
marginals, weighted by line length, are gathered into a document's share of good text, which a two-weight logistic link
turns into the probability of label 1. Both are fitted on a bounded sample of labelled documents.

Defined results: null and empty texts are one empty line and get that line's score; blank lines count as lines; labels
that are null are not learnt from; without any usable label every score is 0.5; null doc_id counts as not held out for
scoring; repeated rows get equal scores; very long texts are scored whole, line by line; an empty table gives an empty result
(and, where nothing labelled is left to learn from, scores of 0.5); other columns are ignored.
"""

from __future__ import annotations

import zlib
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm.common import documents, filter_rows, map_rows, table, texts_of

#: Labelled documents that the field is fitted on, those with the smallest hashes of doc_id.
SAMPLE_DOCS = 12_000
#: Lines of each of them that the fit uses (60 bytes a line; scoring reads whole texts), taken in stretches of LINE_STRETCH from all over the text.
SAMPLE_LINES, LINE_STRETCH = 200, 20
BINS = 8
KEEP = 0.3
MEASURES = 13

_ALL = bytes(range(256))
_NOT = {name: bytes(b for b in _ALL if b not in chars) for name, chars in {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "stop": b".,;:", "shout": b"!?", "symbol": b"#$%&*@^~=+<>{}[]\\/_", "bar": b"|", "high": bytes(range(128, 256))}.items()}


def measures(line: str) -> list[float]:
    """Numbers that describe one line."""
    raw = line.encode("utf-8", "surrogatepass")
    n = max(len(raw), 1)
    words = line.split()
    w = max(len(words), 1)
    share = {k: len(raw.translate(None, cut)) / n for k, cut in _NOT.items()}
    letters = share["upper"] + share["lower"] + share["high"]
    return [
        np.log1p(len(raw)), share["upper"] / max(letters, 1e-9), share["digit"], share["stop"], share["shout"], share["symbol"], len(raw.translate(None, _NOT["bar"])) / w,
        len(set(words)) / w, sum(map(eq, words, words[1:])) / w, letters, len(raw) / w, float(raw[-1:] in (b".", b"!", b"?")), np.log1p(w),
    ]


def lines_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Measures and lengths of the lines of a text."""
    lines = text.split("\n")
    return np.array([measures(x) for x in lines], np.float32), np.array([len(x) for x in lines], np.float32)


def sampled_lines(n: int, seed: int) -> np.ndarray:
    """The lines of a text of n lines that the fit uses: all, or stretches of neighbours, one from each equal part of the text, at a place that the seed gives."""
    if n <= SAMPLE_LINES:
        return np.arange(n)
    parts = SAMPLE_LINES // LINE_STRETCH
    edges = np.arange(parts + 1) * n // parts
    room = np.diff(edges) - LINE_STRETCH + 1
    first = edges[:-1] + (np.arange(1, parts + 1) * 2654435761 + seed) % room
    return (first[:, None] + np.arange(LINE_STRETCH)).ravel()


class LineField:
    """Binary linear-chain field; weights: measure bins of the line before, the line itself and the line after, and transitions."""

    def __init__(self):
        self.cuts = np.zeros((MEASURES, BINS - 1), np.float32)
        self.weights = np.zeros((3, MEASURES, BINS + 1))
        self.chain = np.zeros((2, 2))
        self.link = np.zeros(3)
        self.fitted = False

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(self.cuts[k], x[:, k], "right") for k in range(MEASURES)], 1)

    def evidence(self, bins: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Bins of the line before, itself, after; BINS stands for no line."""
        last = np.r_[first[1:], True]
        before, after = np.roll(bins, 1, 0), np.roll(bins, -1, 0)
        before[first], after[last] = BINS, BINS
        return np.stack([before, bins, after], 1)

    def potential(self, evidence: np.ndarray) -> np.ndarray:
        """Log-potential of good against bad for every line."""
        return self.weights[np.arange(3)[:, None], np.arange(MEASURES), evidence].sum((1, 2))

    def marginals(self, potential: np.ndarray, sizes: np.ndarray):
        """Probability of good for every line, and expected transitions, by forward-backward over all documents side by side."""
        starts = np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        depth = int(sizes[0]) if len(sizes) else 0
        live = np.searchsorted(-sizes, -np.arange(depth), "left")  # documents longer than each position
        node = np.exp(np.stack([np.zeros_like(potential), np.clip(potential, -40, 40)], 1))
        node /= node.sum(1, keepdims=True)
        pair = np.exp(self.chain)
        ahead, back = np.ones_like(node), np.ones_like(node)
        for t in range(depth):
            at = starts[: live[t]] + t
            a = node[at] if t == 0 else node[at] * (ahead[at - 1] @ pair)
            ahead[at] = a / a.sum(1, keepdims=True)
        for t in range(depth - 2, -1, -1):
            at = starts[: live[t + 1]] + t
            b = (node[at + 1] * back[at + 1]) @ pair.T
            back[at] = b / b.sum(1, keepdims=True)
        good = ahead * back
        good /= good.sum(1, keepdims=True)
        has_next = np.ones(len(potential), bool)
        has_next[starts + sizes - 1] = False
        i = np.flatnonzero(has_next)
        joint = ahead[i][:, :, None] * pair * (node[i + 1] * back[i + 1])[:, None, :]
        joint = (joint / np.maximum(joint.sum((1, 2), keepdims=True), 1e-300)).sum(0)
        return good[:, 1], joint

    def gathered(self, good: np.ndarray, lengths: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of each document: 1, the length-weighted mean of good, and of log-odds of good."""
        starts = np.cumsum(sizes) - sizes
        weight = lengths + 1
        total = np.add.reduceat(weight, starts)
        odds = np.clip(np.log(good + 1e-6) - np.log(1 - good + 1e-6), -8, 8)
        return np.stack([np.ones(len(sizes)), np.add.reduceat(good * weight, starts) / total, np.add.reduceat(odds * weight, starts) / total / 4], 1)

    def fit(self, x: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, labels: np.ndarray, steps: int = 80) -> LineField:
        """Lines start with their document's label; gradient steps alternate with one relabelling of the good-looking lines of bad documents."""
        self.cuts = np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T.astype(np.float32)
        first = np.zeros(len(x), bool)
        first[np.cumsum(sizes) - sizes] = True
        evidence = self.evidence(self.bins(x), first)
        gold = np.repeat(labels, sizes).astype(float)
        doc_bad = gold == 0
        past = [np.ones_like(self.weights), np.ones_like(self.chain)]
        inner = np.flatnonzero(~first)
        for step in range(steps):
            good, joint = self.marginals(self.potential(evidence), sizes)
            if step == steps // 2:  # what looks good in a bad document is taken as good, unless all of it does
                looks = (good > 0.5) & doc_bad
                share = np.add.reduceat(looks.astype(float) * (lengths + 1), np.cumsum(sizes) - sizes) / np.add.reduceat(lengths + 1, np.cumsum(sizes) - sizes)
                gold = np.where(looks & (np.repeat(share, sizes) < 0.8), 1.0, gold)
            miss = gold - good
            grad = np.zeros_like(self.weights)
            for side in range(3):
                for k in range(MEASURES):
                    grad[side, k] = np.bincount(evidence[:, side, k], miss, BINS + 1)
            both = np.stack([1 - gold, gold], 1)
            chain = np.einsum("ia,ib->ab", both[inner - 1], both[inner]) - joint
            for w, g, p in zip((self.weights, self.chain), (grad - 0.5 * self.weights, chain - 0.5 * self.chain), past):
                p += g * g
                w += 0.3 * g / np.sqrt(p)
        good, _ = self.marginals(self.potential(evidence), sizes)
        self.link = _logistic(self.gathered(good, lengths, sizes), labels)
        self.fitted = True
        return self

    def scores(self, x: np.ndarray, lengths: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(sizes), 0.5)
        first = np.zeros(len(x), bool)
        first[np.cumsum(sizes) - sizes] = True
        good, _ = self.marginals(self.potential(self.evidence(self.bins(x), first)), sizes)
        return 1 / (1 + np.exp(-(self.gathered(good, lengths, sizes) @ self.link)))


def _logistic(z: np.ndarray, y: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Newton's method with a little shrinkage."""
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(w)), z.T @ (y - p) - 1e-2 * w)
    return w


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> LineField:
    """docs(doc_id, text), labels(doc_id, quality) -> field fitted on at most `sample_docs` labelled documents, whose lines are measured by Spark."""
    chosen = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)

    def work():
        def step(batch):
            rows = [(*lines_of(t), zlib.crc32(t.encode("utf-8", "surrogatepass"))) for t in texts_of(batch)]
            rows = [(x[used], n[used]) for x, n, seed in rows for used in [sampled_lines(len(n), seed)]]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array([x.tobytes() for x, _ in rows], pa.binary()), pa.array([n.tobytes() for _, n in rows], pa.binary())], ["doc_id", "quality", "x", "n"])

        return step

    one = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.max("text").alias("text"))  # of several texts under one doc_id the largest
    found = map_rows(one, work, "doc_id long, quality int, x binary, n binary").collect()  # at most sample_docs rows
    found = [r for r in sorted(found, key=lambda r: r.doc_id)]
    field = LineField()
    if len({r.quality for r in found}) < 2:
        return field
    x = [np.frombuffer(r.x, np.float32).reshape(-1, MEASURES) for r in found]
    return field.fit(np.concatenate(x), np.concatenate([np.frombuffer(r.n, np.float32) for r in found]), np.array([len(v) for v in x]), np.array([r.quality for r in found], float))


def score(docs: DataFrame, field: LineField) -> DataFrame:
    """docs(doc_id, text) -> doc_id, score."""
    shared = docs.sparkSession.sparkContext.broadcast(field)  # a few hundred weights

    def work():
        field = shared.value

        def step(batch):
            rows = [lines_of(t) for t in texts_of(batch)]
            if not rows:
                return None
            s = field.scores(np.concatenate([x for x, _ in rows]), np.concatenate([n for _, n in rows]), np.array([len(x) for x, _ in rows]))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

        return step

    return map_rows(docs.select("doc_id", "text"), work, "doc_id long, score double")


def keep_good(docs: DataFrame, field: LineField, least: float = KEEP) -> DataFrame:
    """The rows of docs (all columns) whose text scores at least `least`."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def work():
        field = shared.value

        def step(batch):
            rows = [lines_of(t) for t in texts_of(batch)]
            if not rows:
                return []
            return (field.scores(np.concatenate([x for x, _ in rows]), np.concatenate([n for _, n in rows]), np.array([len(x) for x, _ in rows])) >= least).tolist()

        return step

    return filter_rows(docs, work)


def held_out():
    """Rows kept for testing: crc32 of doc_id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    field = train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return score(docs, field).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))
