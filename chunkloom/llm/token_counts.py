"""Token counts with a whole-token shortcut.

Offline, each vocabulary string is put through the merges; those that come out as one token are proven to be whole
tokens. A pre-token found among them counts one; only the rest is merged (and remembered within a task).

Defined results: a null or empty text has 0 bytes and 0 tokens; null doc_id is carried along; other columns are ignored;
repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from chunkloom.llm.bpe import Merger, Splitter, byte_alphabet, expect, special_tokens
from chunkloom.llm.common import documents, map_rows, texts_of

#: Fixed by the vocabulary's format: how byte-level vocabularies split text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?{O}+|{W}+(?!\P{{White_Space}})|{W}+"
# The pre-tokenizer of the files that this module reads; others are refused.
PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
REMEMBERED = 300_000


def whole_tokens(spec: str) -> frozenset[str]:
    """Vocabulary strings that encode alone as exactly their own token."""
    expect(spec, normalizer=None, pre_tokenizer=PRE_TOKENIZER)
    merger, back = Merger(spec), {c: b for b, c in enumerate(byte_alphabet())}
    proven = set()
    for token, number in merger.vocab.items():
        try:
            word = bytes(back[c] for c in token).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        if merger.ids(word) == [number]:
            proven.add(word)
    return frozenset(proven)


class Counts(dict):
    """Pre-token -> number of tokens; unknown ones are merged once and remembered up to a bound."""

    def __init__(self, whole: frozenset[str], merger: Merger):
        super().__init__(dict.fromkeys(whole, 1))
        self.whole, self.merger = whole, merger

    def __missing__(self, word: str) -> int:
        n = len(self.merger.ids(word))
        if len(self) >= len(self.whole) + REMEMBERED:
            self.clear()
            self.update(dict.fromkeys(self.whole, 1))
        if len(word) <= 256:
            self[word] = n
        return n


#: One table of counts a worker process; another vocabulary's replaces it.
_HELD: dict[int, Counts] = {}


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_tokens, over_limit, by the byte-level vocabulary file `vocabulary` (read on the driver)."""
    with open(vocabulary, encoding="utf-8") as f:
        spec = f.read()
    shared = docs.sparkSession.sparkContext.broadcast((spec, whole_tokens(spec)))  # one vocabulary file: a few MB at any corpus size

    def work():
        spec, whole = shared.value
        key = hash(spec)
        if key not in _HELD:
            _HELD.clear()
            _HELD[key] = Counts(whole, Merger(spec))
        counts = _HELD[key]
        find, special = Splitter(SPLIT), special_tokens(spec)
        cut = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

        def tokens(text: str) -> int:
            if cut is None or not cut.search(text):
                return sum(map(counts.__getitem__, find(text)))
            return sum(sum(map(counts.__getitem__, find(part))) for part in cut.split(text)) + len(cut.findall(text))

        def step(batch):
            texts = texts_of(batch)
            n = [tokens(t) for t in texts]
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t) if t.isascii() else len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

        return step

    return map_rows(docs.select("doc_id", "text"), work, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
