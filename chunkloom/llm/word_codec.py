"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

The corpus' frequent words are compiled, with their id sequences as outputs, into a minimal automaton that shares
suffixes; a word's output is addressed by its number, the sum of the path counts along its arcs. The automaton is a flat
file in the shared folder, given to each executor once and memory-mapped by its tasks. Words outside it are merged
exactly.

Defined results: null and empty texts have no ids (the digest of zero bytes) and decode to the empty text; null doc_id is
carried along; other columns are ignored; repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import unicodedata
from collections import Counter
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm.bpe import Merger, Splitter, expect, special_tokens
from chunkloom.llm.common import documents, map_rows, materialise, sha_hex, share_bytes, texts_of

#: Fixed by the vocabulary's format: the pre-tokens of word-end vocabularies; what lies between them is dropped.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|{L}+|{N}|{O}+"
# The normalizer and pre-tokenizer of the files that this module reads; others are refused.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary"
LEXICON_WORDS = 1 << 17
REMEMBERED = 200_000


class Words:
    """Text -> pre-tokens and special tokens of a word-end vocabulary."""

    def __init__(self, spec: str):
        self.special = special_tokens(spec)
        self.find = Splitter(SPLIT)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def of(self, text: str) -> list[str]:
        """Pre-tokens; a special token appears as itself with a leading NUL, which no pre-token can start with after it."""
        if self.cut is None or "<|" not in text or not self.cut.search(text):
            return self.find(normal(text))
        out: list[str] = []
        for part in self.cut.split(text):
            out += ["\0" + part] if part in self.special else self.find(normal(part))
        return out


def normal(text: str) -> str:
    """Canonical composition, then lower case letter by letter (a final sigma gets no special form)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


def build_lexicon(words: dict[str, list[int]]) -> bytes:
    """Minimal acyclic automaton of the words (UTF-8), as flat arrays: arc keys state<<8|byte, arc targets, arc counts, finals, output offsets, outputs."""
    ordered = sorted((w.encode(), w) for w in words)
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def freeze(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path: list[list] = [[False, []]]
    prior = b""
    for raw, _ in ordered:
        common = next((i for i, (a, b) in enumerate(zip(prior, raw)) if a != b), min(len(prior), len(raw)))
        for at in range(len(prior), common, -1):
            done = freeze(path.pop())
            path[-1][1].append((prior[at - 1], done))
        path += [[False, []] for _ in raw[common:]]
        path[-1][0] = True
        prior = raw
    for at in range(len(prior), 0, -1):
        done = freeze(path.pop())
        path[-1][1].append((prior[at - 1], done))
    root = freeze(path.pop())
    reach = np.zeros(len(states), np.int64)
    keys, to, skip = [], [], []
    for number, (final, arcs) in enumerate(states):  # targets always precede their source
        passed = int(final)
        for byte, target in arcs:
            keys.append(number << 8 | byte)
            to.append(target)
            skip.append(passed)
            passed += int(reach[target])
        reach[number] = passed
    outputs = [words[w] for _, w in ordered]
    offsets = np.cumsum([0, *map(len, outputs)])
    flat = [np.asarray(x, np.int64) for x in (keys, to, skip, [f for f, _ in states], offsets, [i for o in outputs for i in o])]
    head = np.array([root, *map(len, flat)], np.int64)
    return b"".join(x.tobytes() for x in (head, *flat))


class Lexicon:
    """A memory-mapped automaton; looks many words up at once, one byte level after another."""

    def __init__(self, path: str):
        data = np.memmap(path, np.int64, "r")
        self.root, sizes, at, parts = int(data[0]), data[1:7], 7, []
        for n in map(int, sizes):
            parts.append(data[at : at + n])
            at += n
        self.keys, self.to, self.skip, self.final, self.offsets, self.outputs = parts

    def look_up(self, words: list[str]) -> list[np.ndarray | None]:
        """Ids of each word, or None for words outside the lexicon."""
        if not words or not len(self.keys):
            return [None] * len(words)
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        start = np.cumsum(length) - length
        data = np.frombuffer(b"".join(raw), np.uint8)
        state, number = np.full(len(raw), self.root), np.zeros(len(raw), np.int64)
        live = np.flatnonzero(length > 0)
        state[length == 0] = -1
        level = 0
        while len(live):
            key = state[live] << 8 | data[start[live] + level]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[arc] == key
            state[live[~found]] = -1
            live, arc = live[found], arc[found]
            state[live] = self.to[arc]
            number[live] += self.skip[arc]
            level += 1
            live = live[length[live] > level]
        known = state >= 0
        known[known] = self.final[state[known]] > 0
        return [self.outputs[self.offsets[k] : self.offsets[k + 1]] if ok else None for ok, k in zip(known.tolist(), number.tolist())]


class Codes(dict):
    """Word -> (id bytes, name bytes) within a worker: lexicon first, exact merging for the rest."""

    def __init__(self, lexicon: Lexicon, merger: Merger, special: dict[str, int]):
        super().__init__()
        self.lexicon, self.merger, self.special = lexicon, merger, special
        self.names = [b""] * (max([*merger.vocab.values(), *special.values()]) + 1)
        for name, number in (merger.vocab | special).items():
            self.names[number] = name.encode()

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self]
        if len(self) + len(new) > REMEMBERED:
            self.clear()
            new = list(words)
        for word, ids in zip(new, self.lexicon.look_up(new)):
            if ids is None:
                ids = [self.special[word[1:]]] if word[:1] == "\0" and word[1:] in self.special else self.merger.ids(word)
            else:
                ids = ids.tolist()
            self[word] = pack(f"<{len(ids)}I", *ids), b" ".join([self.names[i] for i in ids])


def frequent_words(docs: DataFrame, spec: str, limit: int = LEXICON_WORDS) -> list[str]:
    """The most frequent pre-tokens of all texts, whole classes of equal frequency (eighths of a doubling) up to `limit`; counted per batch first, then by Spark."""

    def work():
        words = Words(spec)

        def step(batch):
            seen: Counter[str] = Counter()
            for t in texts_of(batch):
                seen.update(words.of(t))
            kept = {w: n for w, n in seen.items() if n > 0 and len(w) <= 64}
            return pa.RecordBatch.from_arrays([pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.int64())], ["word", "n"])

        return step

    counts = map_rows(docs.select("text"), work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    counts = materialise(counts.withColumn("class", F.floor(8 * F.log2("n")).cast("int")), "words")
    least, total = 0, 0
    for r in sorted(counts.groupBy("class").count().collect(), key=lambda r: -r["class"]):  # at most 8 classes for each doubling
        total += r["count"]
        if total > limit:
            least = r["class"] + 1
            break
    return [r.word for r in counts.where(F.col("class") >= least).select("word").collect()]  # at most `limit` words


#: One lexicon a worker process, with what it has learnt; another corpus' lexicon replaces it.
_HELD: dict[str, tuple[Words, Codes]] = {}


def _worker(file: str, spec: str) -> tuple[Words, Codes]:
    if file not in _HELD:
        _HELD.clear()
        words = Words(spec)
        _HELD[file] = words, Codes(Lexicon(SparkFiles.get(file)), Merger(spec), words.special)
    return _HELD[file]


def _portions(texts: list[str], chars: int = 1 << 20):
    """The texts in runs of about so many characters."""
    run, size = [], 0
    for text in texts:
        run.append(text)
        size += len(text)
        if size >= chars:
            yield run
            run, size = [], 0
    if run:
        yield run


def encode(docs: DataFrame, vocabulary: str, lexicon_words: int = LEXICON_WORDS, keep_ids: bool = True) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_tokens, ids_sha256, decoded_sha256 and, if wanted, ids (little-endian unsigned 32-bit)."""
    with open(vocabulary, encoding="utf-8") as f:
        spec = f.read()
    expect(spec, normalizer=NORMALIZER, pre_tokenizer=PRE_TOKENIZER)
    spark, merger = docs.sparkSession, Merger(spec)
    words = [w for w in frequent_words(docs, spec, lexicon_words) if w[:1] != "\0"]
    file = share_bytes(spark, build_lexicon({w: merger.ids(w) for w in words}), "lexicon")
    shared = spark.sparkContext.broadcast(spec)  # one vocabulary file: under 2 MB at any corpus size

    def work():
        words, codes = _worker(file, shared.value)

        def step(batch):
            rows = [], [], [], []
            for texts in _portions(texts_of(batch)):
                own = [words.of(t) for t in texts]
                codes.learn(set().union(*own))
                for ws in own:
                    found = [codes[w] for w in ws]
                    ids = b"".join([f[0] for f in found])
                    rows[0].append(len(ids) // 4)
                    rows[1].append(sha_hex(ids))
                    rows[2].append(sha_hex(b" ".join([f[1] for f in found if f[1]])))
                    rows[3].append(ids if keep_ids else None)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.string()), pa.array(rows[3], pa.binary())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])

        return step

    return map_rows(docs.select("doc_id", "text"), work, SCHEMA)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """encoded(doc_id, ids) -> doc_id, text: token names joined by one space, as the vocabulary without a decoder reads; null ids give the empty text."""
    with open(vocabulary, encoding="utf-8") as f:
        spec = f.read()
    names = {i: t for t, i in (json.loads(spec)["model"]["vocab"] | special_tokens(spec)).items()}
    shared = encoded.sparkSession.sparkContext.broadcast(names)

    def work():
        names = shared.value

        def step(batch):
            texts = [" ".join(names.get(i, "") for i in np.frombuffer(x or b"", "<u4").tolist()) for x in batch.column("ids").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

        return step

    return map_rows(encoded.select("doc_id", "ids"), work, "doc_id long, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False).drop("ids")
