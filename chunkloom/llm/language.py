"""Language of a text from hyperdimensional profiles.

Every letter of every script has a random vector of signs, drawn from its code point; a trigram's vector binds (multiplies) its
letters' vectors, each permuted by its place; a document bundles (adds) its trigrams' vectors; a language's prototype bundles the unit vectors of its
labelled documents. A document takes the language whose prototype, freed of what all languages share, has the largest
cosine with it.

Defined results: null text and text without letters give `und` with score 0; null lang is never learnt from; a null
doc_id counts as not held out; ties go to the first language in code order; very long texts are read whole; repeated rows get
equal results; other columns are ignored; an empty table gives an empty result, and without any labelled document every text
is `und`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm.common import documents, map_rows, texts_of

DIMENSIONS = 1024
SEED = 20240229
#: Trigrams of the gap between words and a-z are looked up in a table; those with other letters are bound as they come.
PLAIN = 27
#: Other letters whose vectors a worker remembers.
REMEMBERED = 20_000
#: Sharpness of the softmax over cosines that gives the score.
SHARPNESS = 24.0
QUANTUM = 1 << 20


def letters_below(limit: int) -> np.ndarray:
    """For every code point: 0 if it is no letter, 1-26 for a-z in any case, else 26 + the code point of its lower-case form."""
    out = np.zeros(limit, np.int64)
    for cp in range(limit):
        c = chr(cp)
        if c.isalpha():
            low = ord(c.lower()[0])
            out[cp] = low - 96 if 97 <= low <= 122 else 26 + low
    return out


def letter_vector(letter: int) -> np.ndarray:
    """The signs of a letter, from the seed and the letter alone."""
    return np.random.default_rng((SEED, letter)).choice(np.array([-1, 1], np.int8), DIMENSIONS)


def bound(letters: np.ndarray, trigrams: np.ndarray) -> np.ndarray:
    """Vectors of trigrams (rows of places in `letters`): product of the letters' vectors, permuted by 0, 1 and 2 places."""
    a, b, c = (np.roll(letters, k, axis=1)[trigrams[:, k]] for k in range(3))
    return a * b * c


class Letters:
    """Letters of texts and the vectors of their trigrams, held by a worker process."""

    def __init__(self):
        self.low = letters_below(1 << 16)
        self.held: dict[int, np.ndarray] = {}
        plain = np.stack([letter_vector(k) for k in range(PLAIN)])
        self.table = bound(plain, np.stack(np.unravel_index(np.arange(PLAIN**3), (PLAIN,) * 3), 1))

    def of(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        s = self.low[np.minimum(points, 0xFFFF)]
        for cp in np.unique(points[points > 0xFFFF]).tolist():
            c = chr(cp)
            s[points == cp] = 26 + ord(c.lower()[0]) if c.isalpha() else 0
        return s

    def vectors(self, letters: np.ndarray) -> np.ndarray:
        if len(self.held) > REMEMBERED:
            self.held.clear()
        for k in letters.tolist():
            if k not in self.held:
                self.held[k] = letter_vector(k)
        return np.stack([self.held[k] for k in letters.tolist()])


_LETTERS: list[Letters] = []


def bundle(text: str) -> np.ndarray | None:
    """Sum of the text's trigram vectors, or None if it has no letters."""
    if not _LETTERS:
        _LETTERS.append(Letters())  # built once in a worker process: fixed in size, from the seed
    held = _LETTERS[0]
    s = held.of(text)
    s = s[np.flatnonzero((s > 0) | np.r_[True, s[:-1] > 0])] if len(s) else s  # gaps of any length are one gap
    s = np.concatenate(([0], s, [0]))
    own = s[1:-1] > 0
    a, b, c = s[:-2][own], s[1:-1][own], s[2:][own]
    if not len(b):
        return None
    plain = (a < PLAIN) & (b < PLAIN) & (c < PLAIN)
    counts = np.bincount(((a * PLAIN + b) * PLAIN + c)[plain], minlength=1)
    known = np.flatnonzero(counts)
    total = counts[known].astype(np.float32) @ held.table[known].astype(np.float32)
    if not plain.all():
        codes, n = np.unique((a << 42 | b << 21 | c)[~plain], return_counts=True)
        letters, place = np.unique(np.concatenate([codes >> 42, codes >> 21 & 0x1FFFFF, codes & 0x1FFFFF]), return_inverse=True)
        vectors, place = held.vectors(letters), place.reshape(3, -1).T
        for at in range(0, len(codes), 4096):
            total = total + n[at : at + 4096].astype(np.float32) @ bound(vectors, place[at : at + 4096]).astype(np.float32)
    return total


def prototypes(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """labelled(text, lang) -> languages and their centred unit prototypes. Each task bundles its documents; Spark adds the bundles."""

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(texts_of(batch), batch.column("lang").to_pylist()):
                v = bundle(text)
                if v is not None:
                    norm = float(np.sqrt(v @ v))
                    if norm:
                        add = np.rint(v * (QUANTUM / norm)).astype(np.int64)  # whole numbers: any order of addition gives the same sum
                        sums[lang] = sums[lang] + add if lang in sums else add
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], ["lang", "v"])

    parts = labelled.select("text", "lang").where("text is not null and lang is not null").mapInArrow(run, "lang string, v array<long>")
    rows = parts.select("lang", F.posexplode("v").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x")).collect()  # languages x DIMENSIONS
    langs = sorted({r.lang for r in rows})
    table = np.zeros((len(langs), DIMENSIONS))
    for r in rows:
        table[langs.index(r.lang), r["at"]] = r.x
    table /= np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-12)
    if len(langs) > 1:
        table -= table.mean(0)
        table /= np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-12)
    return langs, table


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """docs(doc_id, text) -> doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x DIMENSIONS numbers

    def work():
        langs, table = shared.value
        mean_free = table.astype(np.float32)

        def step(batch):
            names, scores = [], []
            for text in texts_of(batch):
                v = bundle(text) if langs else None
                if v is None:
                    names.append("und")
                    scores.append(0.0)
                    continue
                cosines = mean_free @ v / max(float(np.sqrt(v @ v)), 1e-12)
                e = np.exp(SHARPNESS * (cosines - cosines.max()))
                best = int(cosines.argmax())
                names.append(langs[best])
                scores.append(float(e[best] / e.sum()))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

        return step

    return map_rows(docs.select("doc_id", "text"), work, "doc_id long, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    found = identify(docs, prototypes(docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
