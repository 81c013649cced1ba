"""Personal data: exact base patterns plus a skip-chain conditional random field.

Base patterns find e-mail addresses, IPv4 addresses, payment card numbers and phone numbers. A conditional random field
over white-space tokens learns their labels from token shapes and neighbours; equal or similar distant tokens of a document
are linked, share potentials, and agree by loopy message passing. It is fitted on a bounded sample of documents, each of them
twice: as it is, and with its base matches rewritten so that no base pattern takes them (country code dropped, other
separators, a spelled-out @) and everyday numbers (dates, times, amounts) strewn in as counter-examples. What the field
learns is therefore the shape and company of personal data, not the patterns. Tokens labelled with enough certainty that no
base span covers add spans; base spans always stay.

Defined results: null and empty texts hold no spans (digest of the empty string, spans ''); null doc_id is carried along;
very long texts are read whole in linear time; repeated rows give repeated results; an empty table gives an empty result,
and a sample without base matches a field that adds nothing; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm.common import documents, map_rows, sha_hex, texts_of

KINDS = ("email", "ip", "card", "phone")
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
#: Documents with a digit or an @ that the field is fitted on, those with the smallest hashes of doc_id and text.
SAMPLE_DOCS = 600
#: Tokens of each of them that the fit uses: windows of WINDOW on both sides of telling tokens, from all over the text.
SAMPLE_TOKENS, WINDOW = 240, 4
#: Certainty from which a token adds a span.
CERTAIN = 0.8
ROUNDS = 8

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
TOKEN = re.compile(r"\S+")


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(d * 2 - 9 * (d > 4) for d in values[1::2])) % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, free := domain.end()))
        at = text.find("@", max(at + 1, free))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of all base matches, by start and then kind."""
    found = [(s, e, 0) for s, e in _emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((*m.span(), 1))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((*m.span(), 2))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(c.isdecimal() for c in m[0]) <= 15:
                    found.append((*m.span(), 3))
    return sorted(found, key=lambda x: (x[0], x[2]))


AT, DOT = re.compile(r"[\[(](?:at|@)[\])]", re.I), re.compile(r"[\[(](?:dot|\.)[\])]", re.I)
EDGES = ".,;:!?%*#$&|\"'"


def plain(token: str) -> str:
    """The token with a bracketed at or dot as the character it stands for."""
    return DOT.sub(".", AT.sub("@", token)) if "(" in token or "[" in token else token


def telling(token: str) -> bool:
    """Whether a token can be part of personal data: it has a digit or an @."""
    return bool(DIGIT.search(token)) or "@" in token


def _shape(token: str) -> str:
    """Runs of digits by their length, runs of letters as one a, other characters as they are, without marks at the ends."""
    short = re.sub(r"[0-9]+", lambda m: f"9{min(len(m[0]), 20)}", token[:80].strip(EDGES))
    return re.sub(r"[^\W\d_]+", "a", short)


N_FEATURES = 9


def _features(tokens: list[str]) -> list[list[str]]:
    """Of each token: its shape, its neighbours' shapes, its digits, check digit, dots and parts; of words, only their neighbours."""
    tokens = [plain(t) for t in tokens]
    special = [telling(t) for t in tokens]
    shapes = ["^", *(_shape(t) if s else "w" for t, s in zip(tokens, special)), "$"]
    out = []
    for i, token in enumerate(tokens):
        before, shape, after = shapes[i : i + 3]
        if not special[i]:
            out.append(["w", "w<" + before, "w>" + after])
            continue
        bare = token.strip(EDGES)
        digits = re.sub(r"[^0-9]", "", bare)
        n = min(len(digits), 20)
        marks = re.sub(r"[\w]+", "", bare[:80])
        pieces = re.split(r"[^0-9]+", bare.strip("()+")) if digits else []
        out.append([
            shape, "loose " + re.sub(r"9\d+", "9", shape), "<" + before + " " + marks, ">" + after + " " + marks, f"digits {n} {marks}", f"luhn {n >= 14 and luhn(digits)} {n}",
            f"at {'@' in bare} {bare.count('.') > 0}", f"octets {len(pieces) == 4 and all(p and int(p[:4]) <= 255 for p in pieces)}", f"pieces {' '.join(str(min(len(p), 9)) for p in pieces[:6])}",
        ])
    return out


def _links(tokens: list[str]) -> np.ndarray:
    """Each telling token and its last equal or similar one before it: the same letters and digits (case and separators apart), or the same last seven digits."""
    last: dict[str, int] = {}
    pairs = set()
    for i, token in enumerate(tokens):
        if not telling(plain(token)):
            continue
        core = re.sub(r"[\W_]+", "", token).lower()
        digits = re.sub(r"[^0-9]", "", core)
        for key in (core if len(core) >= 5 else "", "#" + digits[-7:] if len(digits) >= 7 else ""):
            if key:
                if key in last:
                    pairs.add((last[key], i))
                last[key] = i
    return np.array(sorted(pairs), np.int64).reshape(-1, 2)


def _gather(places: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of values by place, n of them."""
    return np.stack([np.bincount(places, v, n) for v in values.T], 1)


class Field:
    """Log-linear field with node features, chain transitions and a shared potential on skip links."""

    def __init__(self, names: dict[str, int]):
        n = len(KINDS) + 1
        self.names, self.node, self.chain, self.skip = names, np.zeros((len(names) + 1, n)), np.zeros((n, n)), np.zeros((n, n))

    def graph(self, documents_tokens: list[list[str]]):
        rows, chain, skip, at = [], [], [], 0
        other = len(self.names)
        for tokens in documents_tokens:
            rows += [[self.names.get(f, other) for f in fs] + [other] * (N_FEATURES - len(fs)) for fs in _features(tokens)]
            chain.append(np.stack([np.arange(at, at + len(tokens) - 1), np.arange(at + 1, at + len(tokens))], 1).reshape(-1, 2))
            skip.append(_links(tokens) + at)
            at += len(tokens)
        return np.array(rows, np.int64).reshape(-1, N_FEATURES), np.concatenate(chain), np.concatenate(skip)

    def marginals(self, rows: np.ndarray, chain: np.ndarray, skip: np.ndarray, rounds: int = ROUNDS):
        """Loopy sum-product with all messages renewed in every round: node beliefs and beliefs of chain and skip links."""
        score = self.node[rows].sum(1)
        unary = np.exp(score - score.max(1, keepdims=True))
        sides = []
        for pairs, pair in ((chain, np.exp(self.chain)), (skip, np.exp(self.skip))):
            sides.append([pairs, pair, np.ones((len(pairs), unary.shape[1])), np.ones((len(pairs), unary.shape[1]))])
        for _ in range(rounds):
            log = np.log(unary)
            for pairs, _, ahead, back in sides:
                log += _gather(pairs[:, 1], np.log(ahead), len(log)) + _gather(pairs[:, 0], np.log(back), len(log))
            belief = np.exp(log - log.max(1, keepdims=True))
            for side in sides:
                pairs, pair, ahead, back = side
                a = (belief[pairs[:, 0]] / back) @ pair
                b = (belief[pairs[:, 1]] / ahead) @ pair.T
                side[2], side[3] = a / a.sum(1, keepdims=True) + 1e-12, b / b.sum(1, keepdims=True) + 1e-12
        log = np.log(unary)
        for pairs, _, ahead, back in sides:
            log += _gather(pairs[:, 1], np.log(ahead), len(log)) + _gather(pairs[:, 0], np.log(back), len(log))
        belief = np.exp(log - log.max(1, keepdims=True))
        joint = []
        for pairs, pair, ahead, back in sides:
            p = (belief[pairs[:, 0]] / back)[:, :, None] * pair * (belief[pairs[:, 1]] / ahead)[:, None, :]
            joint.append(p / p.sum((1, 2), keepdims=True))
        return belief / belief.sum(1, keepdims=True), joint

    def fit(self, documents_tokens: list[list[str]], labels: np.ndarray, steps: int = 40) -> Field:
        """Gradient ascent with per-weight step sizes on the (approximate) log-likelihood."""
        rows, chain, skip = self.graph(documents_tokens)
        n = self.chain.shape[0]
        gold = np.eye(n)[labels]
        want_chain = np.einsum("ia,ib->ab", gold[chain[:, 0]], gold[chain[:, 1]])
        want_skip = np.einsum("ia,ib->ab", gold[skip[:, 0]], gold[skip[:, 1]])
        past = [np.full_like(w, 1.0) for w in (self.node, self.chain, self.skip)]
        for _ in range(steps):
            belief, joint = self.marginals(rows, chain, skip, 3)
            node = _gather(rows.ravel(), np.repeat(gold - belief, rows.shape[1], 0), len(self.node))
            for w, g, p in zip((self.node, self.chain, self.skip), (node, want_chain - joint[0].sum(0), want_skip - joint[1].sum(0)), past):
                g -= 0.02 * w
                p += g * g
                w += 0.5 * g / np.sqrt(p)
        return self


def _tokens(text: str):
    found = [(m.start(), m.end()) for m in TOKEN.finditer(text)]
    return found, [text[s:e] for s, e in found]


def _token_labels(places: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> np.ndarray:
    labels = np.zeros(len(places), np.int64)
    starts = np.array([p[0] for p in places])
    for s, e, kind in spans:
        for i in range(max(0, int(np.searchsorted(starts, s, "right")) - 1), len(places)):
            if places[i][0] >= e:
                break
            if places[i][1] > s:
                labels[i] = kind + 1
    return labels


# How the rewritten copies write personal data past the patterns, and numbers that are none.
REWRITES = {
    "email": (("@", "[at]"), ("@", " (at) "), ("@", "(at)", ".", "[dot]"), ("@", " [at] ", ".", "(dot)")),
    "ip": ((".", "[.]"), (".", "(dot)"), (".", "-")),
    "card": ((4, "."), (4, "_"), (4, "/")),
    "phone": ("(3) 3-4", "1 (3) 3-4", "3-3-4", "3.3.4", "(3)3-4", "001 3 3 4"),
}
DECOYS = ("{y}-{m:02}-{d:02}", "{d}.{m}.{y}", "{m}/{d}/{y}", "{d}:{m:02}", "{d},{n:03}", "{y}", "v{m}.{d}.{n}", "{d}%", "{n}-{y}", "{d}.{m:02}", "no. {n}", "{n}{y}", "{y}-{n}", "({d})", "{n}{y}{n}{d}")


def _rewritten(kind: str, found: str, rng: np.random.Generator) -> str:
    """A base match as one of the rewrites of its kind writes it."""
    way = REWRITES[kind][rng.integers(len(REWRITES[kind]))]
    if kind == "card":
        digits = re.sub(r"[^0-9]", "", found)
        return way[1].join(digits[i : i + way[0]] for i in range(0, len(digits), way[0]))
    if kind == "phone":
        digits = re.sub(r"[^0-9]", "", found)[-10:]
        parts = iter((digits[:3], digits[3:6], digits[6:]))
        return re.sub(r"(?<!\d)[34](?!\d)", lambda _: next(parts), way)
    name, at, domain = found.partition("@") if kind == "email" else (found, "", "")
    if kind == "ip":
        return name.replace(*way)
    return name + way[1] + (domain.replace(*way[2:]) if way[2:] else domain)


def rewrite(text: str, spans: list[tuple[int, int, int]], rng: np.random.Generator, decoys: int = 6) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with every base span rewritten and everyday numbers put between its words, and the spans at their new places."""
    cuts = [m.start() for m in re.finditer(r"(?<=\s)(?=\S)", text)]
    puts = sorted((cuts[k], DECOYS[rng.integers(len(DECOYS))].format(y=rng.integers(1900, 2040), m=rng.integers(1, 13), d=rng.integers(1, 32), n=rng.integers(100, 999)) + " ", -1) for k in rng.integers(0, len(cuts), min(decoys, len(cuts)))) if cuts else []
    changes = [(s, e, _rewritten(KINDS[k], text[s:e], rng), k) for s, e, k in spans] + [(at, at, put, k) for at, put, k in puts]
    out, kept, at, n = [], [], 0, 0
    for s, e, new, k in sorted(changes, key=lambda c: c[:2]):
        if s < at:
            continue
        out += [text[at:s], new]
        n += s - at
        if k >= 0:
            kept.append((n, n + len(new), k))
        n, at = n + len(new), e
    return "".join([*out, text[at:]]), kept


def _windows(tokens: list[str], most: int) -> np.ndarray:
    """Places of the tokens within WINDOW of a telling one; where they are more than `most`, those around telling ones from all over the text, evenly."""
    at = np.array([i for i, t in enumerate(tokens) if telling(plain(t))], np.int64)

    def around(at: np.ndarray) -> np.ndarray:
        near = np.zeros(len(tokens) + 2 * WINDOW, bool)
        for i in range(2 * WINDOW + 1):
            near[at + i] = True
        return np.flatnonzero(near[WINDOW : WINDOW + len(tokens)])

    kept = around(at)
    return kept if len(kept) <= most else around(at[np.linspace(0, len(at) - 1, most // (2 * WINDOW + 1)).astype(np.int64)])


def examples(text: str, most: int = SAMPLE_TOKENS) -> list[tuple[list[str], list[int]]]:
    """Training examples (tokens, labels) of a text: its windows as they are, and rewritten ones."""
    base = base_spans(text)
    out = []
    for version, spans in ((text, base), rewrite(text, base, np.random.default_rng(len(text)))):
        places, tokens = _tokens(version)
        kept = _windows(tokens, most)
        if len(kept):
            labels = _token_labels(places, spans)
            out.append(([tokens[i][:100] for i in kept], labels[kept].tolist()))
    return out


def fit_field(sets: list[tuple[list[str], list[int]]]) -> Field:
    """Field fitted on examples (tokens, labels); features seen fewer than three times count as one."""
    counts: dict[str, int] = {}
    for tokens, _ in sets:
        for fs in _features(tokens):
            for f in fs:
                counts[f] = counts.get(f, 0) + 1
    field = Field({f: i for i, f in enumerate(sorted(f for f, n in counts.items() if n >= 3))})
    labels = np.concatenate([np.array(y, np.int64) for _, y in sets]) if sets else np.zeros(0, np.int64)
    return field.fit([t for t, _ in sets], labels) if labels.any() else field


def added_spans(text: str, base: list[tuple[int, int, int]], field: Field) -> list[tuple[int, int, int]]:
    """Spans of tokens that the field is certain of and no base span touches; neighbours of one kind form one span, marks at its ends left out."""
    places, tokens = _tokens(text)
    shown = [telling(plain(t)) for t in tokens]
    if not any(shown):
        return []
    covered = _token_labels(places, base) > 0
    belief, _ = field.marginals(*field.graph([tokens]))
    best = belief[:, 1:].argmax(1) + 1
    sure = (belief[np.arange(len(best)), best] >= CERTAIN) & ~covered
    out: list[tuple[int, int, int]] = []
    at = -2
    for i in np.flatnonzero(sure):
        if i == at + 1 and out[-1][2] == best[i] - 1:
            out[-1] = (out[-1][0], places[i][1], out[-1][2])
        else:
            out.append((*places[i], int(best[i]) - 1))
        at = i
    trimmed = [(s + len(x) - len(x.lstrip(EDGES)), e - len(x) + len(x.rstrip(EDGES)), k) for s, e, k in out for x in [text[s:e]]]
    return [(s, e, k) for s, e, k in trimmed if s < e and telling(plain(text[s:e]))]


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], x[2], x[1])))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Field:
    """Field fitted on the driver on at most sample_docs documents, 2 * SAMPLE_TOKENS tokens of up to 100 characters of each."""
    hinted = docs.where("text like '%@%' or rlike(text, '[0-9]')").select(F.xxhash64("doc_id", "text").alias("h"), "text")
    last = hinted.select("h").orderBy("h").limit(sample_docs).agg(F.max("h")).first()[0]
    if last is None:
        return fit_field([])

    def work():
        def step(batch):
            found = [(h, [{"tokens": t, "labels": y} for t, y in examples(text or "")]) for h, text in zip(batch.column("h").to_pylist(), batch.column("text").to_pylist())]
            kind = pa.list_(pa.struct([("tokens", pa.list_(pa.string())), ("labels", pa.list_(pa.int32()))]))
            return pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.int64()), pa.array([x for _, x in found], kind)], ["h", "found"])

        return step

    sampled = map_rows(hinted.where(F.col("h") <= last), work, "h long, found array<struct<tokens:array<string>,labels:array<int>>>")
    rows = sampled.dropDuplicates(["h"]).orderBy("h").limit(sample_docs).collect()  # repeated rows of one hash count once
    return fit_field([(list(x.tokens), list(x.labels)) for r in rows for x in r.found])


def find_private_data(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """docs(doc_id, text) -> counts of base matches, digest of the base spans, all spans (code points, end exclusive), number of those that the field added."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, sample_docs))  # some ten thousand weights at any corpus size

    def work():
        field = shared.value

        def step(batch):
            rows = [[] for _ in range(7)]
            for text in texts_of(batch):
                spans = base_spans(text)
                for k in range(4):
                    rows[k].append(sum(x[2] == k for x in spans))
                rows[4].append(sha_hex(_joined(spans).encode()))
                more = added_spans(text, spans, field) if DIGIT.search(text) or "@" in text or AT.search(text) else []
                rows[5].append(_joined(spans + more))
                rows[6].append(len(more))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(r, t) for r, t in zip(rows, types))], names)

        return step

    return map_rows(docs.select("doc_id", "text"), work, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_private_data(documents(spark, sf_dir))
