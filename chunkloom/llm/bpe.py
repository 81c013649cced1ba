"""Byte-pair merging by rank, exactly as a published vocabulary file defines it."""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import lru_cache

import regex
from tokenizers import Regex, pre_tokenizers

WHITE = r"\p{White_Space}"
NEVER = 1 << 62
#: Ids and ranks are packed into 17 bits each.
MOST_IDS = 1 << 17


class Splitter:
    """Pre-tokens of a text by a pattern over letters {L}, numbers {N}, others {O} and white space {W}.

    Characters newer than the library's own character tables are neither letters nor numbers there; a text that holds
    one is split with a pattern that says so.
    """

    def __init__(self, template: str):
        self.template = template
        self.find = regex.compile(template.format(L=r"\p{L}", N=r"\p{N}", O=rf"[^{WHITE}\p{{L}}\p{{N}}]", W=WHITE)).findall
        self.held = lru_cache(64)(self._without)

    def _without(self, odd: str):
        own = "".join(f"\\U{ord(c):08x}" for c in odd)
        return regex.compile(self.template.format(L=rf"[\p{{L}}--[{own}]]", N=rf"[\p{{N}}--[{own}]]", O=rf"[[^{WHITE}\p{{L}}\p{{N}}]||[{own}]]", W=WHITE), regex.V1).findall

    def __call__(self, text: str) -> list[str]:
        if text.isascii():
            return self.find(text)
        odd = "".join(sorted(c for c in set(text) if c > "\u0557" and _odd(c)))
        return self.held(odd)(text) if odd else self.find(text)


@lru_cache(1 << 16)
def _odd(c: str) -> bool:
    """Whether `regex` takes a character for a letter or number and the library doesn't; only characters unknown to Python's tables can differ."""
    if unicodedata.category(c) != "Cn" or not regex.match(r"[\p{L}\p{N}]", c):
        return False
    return bool(pre_tokenizers.Split(Regex(r"[\p{L}\p{N}]"), "removed").pre_tokenize_str(c))


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 bytes are themselves, the rest follow from code point 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    own = set(plain)
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Merger:
    """Merges the symbols of one word in rank order (lowest rank first, leftmost among equals)."""

    def __init__(self, spec: str):
        model = json.loads(spec)["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        if model.get("type") != "BPE" or odd:
            raise ValueError(f"not a plain byte-pair model: {model.get('type')} {odd}")
        self.vocab: dict[str, int] = model["vocab"]
        if max(len(self.vocab), max(self.vocab.values(), default=0) + 1, len(model["merges"])) > MOST_IDS:
            raise ValueError(f"ids and ranks are packed into {MOST_IDS - 1} at most")
        self.suffix: str = model.get("end_of_word_suffix") or ""
        pairs = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])
        v = self.vocab
        #: left id << 17 | right id -> rank << 17 | merged id: the smallest value is the next merge.
        self.merges = {v[a] << 17 | v[b]: rank << 17 | v[a + b] for rank, (a, b) in enumerate(pairs)}
        alphabet = byte_alphabet()
        self.first = [v.get(c) for c in alphabet]
        self.last = [v.get(c + self.suffix) for c in alphabet]

    def ids(self, word: str) -> list[int]:
        """Token ids of one pre-token."""
        raw = word.encode("utf-8", "surrogatepass")
        if not raw:
            return []
        ids = [self.first[b] for b in raw[:-1]]
        ids.append(self.last[raw[-1]])
        ids = [i for i in ids if i is not None]
        return self._short(ids) if len(ids) <= 48 else self._long(ids)

    def _short(self, ids: list[int]) -> list[int]:
        get = self.merges.get
        due = [get(a << 17 | b, NEVER) for a, b in zip(ids, ids[1:])]
        while due:
            best = min(due)
            if best == NEVER:
                break
            i = due.index(best)
            ids[i : i + 2] = [best & 0x1FFFF]
            del due[i]
            if i:
                due[i - 1] = get(ids[i - 1] << 17 | ids[i], NEVER)
            if i < len(due):
                due[i] = get(ids[i] << 17 | ids[i + 1], NEVER)
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list, n log n for words of any length."""
        get, n = self.merges.get, len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(m, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (m := get(a << 17 | b, NEVER)) < NEVER]
        heapq.heapify(heap)

        def offer(i: int, j: int) -> None:
            m = get(ids[i] << 17 | ids[j], NEVER)
            if m < NEVER:
                heapq.heappush(heap, (m, i, ids[i], ids[j]))

        while heap:
            merge, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = merge & 0x1FFFF, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                offer(i, k)
            if before[i] >= 0:
                offer(before[i], i)
        return [x for x in ids if x >= 0]


def special_tokens(spec: str) -> dict[str, int]:
    """Added tokens of a vocabulary file. They are taken as they stand in the text; files that ask for more are refused."""
    added = json.loads(spec).get("added_tokens", [])
    if any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError("added tokens that match single words, strip or are normalised are not supported")
    return {t["content"]: t["id"] for t in added}


def expect(spec: str, **parts) -> None:
    """Refuses a vocabulary file whose parts (normalizer, pre_tokenizer ...) aren't those that the caller's code is written for."""
    held = json.loads(spec)
    for name, wanted in parts.items():
        if held.get(name) != wanted:
            raise ValueError(f"the file's {name} is not the expected one: {held.get(name)}")
