"""Operators against brute force, the tokenizers' own library, or held-out labels."""

import hashlib
import re
import struct
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chunkloom.llm import bpe, components, decontamination, exact_dedup, fuse_filter, language, near_dedup, page_text, private_data, quality, repeats, token_counts, word_codec

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_padding()
    t.no_truncation()
    return t


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="ab éÉß'sS12._<|endoftext|>\u0085 \n", max_size=60))
def test_tokens_of_any_text(text):
    words, merger = held(public_tokenizers.path("word_bpe_49k.json"))
    ids = [i for w in words.of(text) for i in ([words.special[w[1:]]] if w[:1] == "\0" and w[1:] in words.special else merger.ids(w))]
    assert ids == library_of("word_bpe_49k.json").encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="ab éÉß'sS12._\u0085\u001c \n\t", max_size=60))
def test_pre_tokens_of_any_text(text):
    merger = held(public_tokenizers.path("byte_bpe_50k.json"))[1]
    ids = [i for w in bpe.Splitter(token_counts.SPLIT)(text) for i in merger.ids(w)]
    assert ids == library_of("byte_bpe_50k.json").encode(text, add_special_tokens=False).ids


_HELD = {}


def held(path):
    if path not in _HELD:
        spec = open(path, encoding="utf-8").read()
        _HELD[path] = word_codec.Words(spec), bpe.Merger(spec)
    return _HELD[path]


def library_of(name):
    return _HELD.setdefault("lib " + name, library(name))


def test_long_words_merge_alike():
    merger = held(public_tokenizers.path("word_bpe_49k.json"))[1]
    word = "internationalisation" * 40
    first = [merger.first[b] for b in word.encode()[:-1]] + [merger.last[word.encode()[-1]]]
    assert merger._long(list(first)) == merger._short(list(first)) == library_of("word_bpe_49k.json").encode(word, add_special_tokens=False).ids


def test_encode_as_the_library(docs, texts):
    t = library("word_bpe_49k.json")
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = word_codec.encode(docs, path).cache()
    back = {r.doc_id: r.text for r in word_codec.decode(rows, path).collect()}
    for r in rows.collect():
        ids = t.encode(texts[r.doc_id], add_special_tokens=False).ids
        decoded = t.decode(ids, skip_special_tokens=False)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest() and back[r.doc_id] == decoded


def test_counts_as_the_library(docs, texts):
    t = library("byte_bpe_50k.json")
    for r in token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).collect():
        assert (r.n_tokens, r.n_bytes) == (len(t.encode(texts[r.doc_id], add_special_tokens=False).ids), len(texts[r.doc_id].encode()))


def test_lexicon_shares_suffixes(tmp_path):
    words = {"talking": [1], "walking": [2, 3], "walk": [4], "talk": [], "é": [9]}
    path = tmp_path / "lexicon"
    path.write_bytes(word_codec.build_lexicon(words))
    lexicon = word_codec.Lexicon(str(path))
    assert [None if x is None else list(x) for x in lexicon.look_up(["talking", "walking", "walk", "talk", "é", "wal", "walkings", ""])] == [[1], [2, 3], [4], [], [9], None, None, None]
    assert len(lexicon.final) < 12


@pytest.mark.parametrize("n", [0, 1, 3, 50, 5000])
def test_fuse_filter(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 1 << 63, n).astype(np.uint64)
    data = fuse_filter.build(keys)
    assert fuse_filter.probe(data, keys).all() and fuse_filter.probe(data, rng.integers(0, 1 << 63, 20_000).astype(np.uint64)).mean() < 0.01


def test_exact_groups(docs, texts):
    groups = {}
    for i, x in texts.items():
        groups.setdefault(x.encode().lower(), []).append(i)
    for r in exact_dedup.deduplicate(docs).collect():
        own = groups[texts[r.doc_id].encode().lower()]
        assert (r.keep_id, r.group_size, r.kept) == (max(own), len(own), r.doc_id == max(own))


def test_digest_clash_is_found_by_bytes(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "B")], "doc_id long, text string")
    digest = bytearray(hashlib.sha256(b"a").digest())
    members = spark.createDataFrame([(1, digest, 3, 3), (2, digest, 3, 3), (3, digest, 3, 3)], "doc_id long, digest binary, keep_id long, group_size long")
    assert exact_dedup._byte_checked(docs, members).where("not same").count() == 1


def test_clashing_digests_change_nothing(spark):
    """From end to end: with a digest that hardly tells texts apart, groups are those of the texts themselves."""

    def weak_digest(data):
        return hashlib.sha256(str(len(data) // 3).encode()).digest()

    rng = np.random.default_rng(3)
    rows = [(i, "".join(rng.choice(list("abAB"), int(rng.integers(0, 9))))) for i in range(300)] + [(400, None), (401, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    own = {}
    for i, x in rows:
        own.setdefault((x or "").lower(), []).append(i)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.deduplicate(docs, digest=weak_digest).collect()}
    assert got == {i: (max(g), len(g), i == max(g)) for i, x in rows for g in [own[(x or "").lower()]]}


def brute_components(texts, k):
    sets = {i: near_dedup.shingle_set(near_dedup.words_of(x), k) for i, x in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sorted(sets):
        for j in sorted(sets):
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sets, {i: find(i) for i in sets}


@pytest.mark.parametrize("k", [2, 5])
def test_near_components(docs, texts, k):
    sets, want = brute_components(texts, k)
    got = near_dedup.link(docs, k).collect()
    assert {r.doc_id: r.component_id for r in got} == want and all(r.n_shingles == len(sets[r.doc_id]) for r in got)


def test_chain_of_near_copies(spark):
    """A long chain whose ends are unlike, and texts near each other without being linked."""
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[: 200 - 6 * i] + [f"x{j}" for j in range(6 * i)])) for i in range(12)]
    rows += [(100 + i, " ".join(base[:150] + [f"y{i}_{j}" for j in range(50)])) for i in range(40)]
    texts = dict(rows)
    want = brute_components(texts, 2)[1]
    assert {r.doc_id: r.component_id for r in near_dedup.link(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()} == want


def test_blocks_meet_once_and_only_where_needed(spark):
    """Every two classes of one cluster that may be linked meet in exactly one task; those of one large component never."""
    rng = np.random.default_rng(8)
    rows = [(i % 2, i, 5 if i < 60 else 100 + i, int(rng.integers(10, 30))) for i in range(120)]
    own = spark.createDataFrame(rows, "cluster long, rep long, component long, n_shingles long")
    tasks = {}
    for r in near_dedup._met_blocks(own, 80, block=8).collect():
        tasks.setdefault((r.cluster, r.low, r.high), []).append((r.rep, r.first))
    met = Counter()
    for (_, low, high), held in tasks.items():
        left, right = [x for x, f in held if f], [x for x, f in held if not f]
        met.update({(min(a, b), max(a, b)) for a in left for b in (left if low == high else right) if a != b})
    size, component = {r[1]: r[3] for r in rows}, {r[1]: r[2] for r in rows}
    assert max(met.values()) == 1
    for a in size:
        for b in size:
            if a < b and a % 2 == b % 2 and component[a] != component[b] and min(size[a], size[b]) >= 0.8 * max(size[a], size[b]):
                assert met[a, b] == 1
    large = [x for x in size if component[x] == 5]
    assert sum(met[a, b] for a in large for b in large) < 0.35 * len(large) ** 2


def test_two_texts_under_one_id(spark):
    """Rows that share a doc_id but not a text give the same result in any order and partitioning."""
    rows = [(1, "a b c d e f g h i j"), (1, "k l m n o p q r s t"), (2, "k l m n o p q r s t"), (3, "a b c d e f g h i j")]
    got = [sorted(near_dedup.link(spark.createDataFrame(x, "doc_id long, text string").repartition(n), 2).collect()) for x, n in ((rows, 1), (rows[::-1], 4))]
    assert got[0] == got[1]


@pytest.fixture
def never_broadcast(spark, monkeypatch):
    """No side is small enough to be broadcast, by the operators' own bounds or by Spark's."""
    from chunkloom.llm import common

    for module, name in ((near_dedup, "BROADCAST_ROWS"), (exact_dedup, "BROADCAST_ROWS"), (repeats, "BROADCAST_BYTES"), (common, "BROADCAST_IDS")):
        monkeypatch.setattr(module, name, -1)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_near_components_without_broadcast(docs, texts, never_broadcast):
    assert {r.doc_id: r.component_id for r in near_dedup.link(docs, 2).collect()} == brute_components(texts, 2)[1]


def test_exact_groups_without_broadcast(docs, texts, never_broadcast):
    test_exact_groups(docs, texts)


def test_repeats_without_broadcast(spark, docs, texts, never_broadcast):
    test_repeats(spark, docs, texts, 400)


def test_without_ids_by_shuffle(spark, docs, never_broadcast):
    from chunkloom.llm.common import without

    left = without(docs, docs.where("doc_id % 3 = 0").select("doc_id"))
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {r.doc_id for r in docs.where("doc_id % 3 <> 0").collect()}


def test_items_in_shards(spark, docs, monkeypatch):
    items = spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text")
    whole = sorted(decontamination.search(docs, items).collect())
    monkeypatch.setattr(decontamination, "SHARD_ITEMS", 7)
    cut = sorted(decontamination.search(docs, items).collect())
    assert [(r.doc_id, r.item_id) for r in cut] == [(r.doc_id, r.item_id) for r in whole] and whole


def test_pairs_by_products():
    rng = np.random.default_rng(3)
    left, right = ([np.unique(rng.integers(0, 60, rng.integers(0, 50)).astype(np.uint64)) for _ in range(30)] for _ in range(2))
    want = [[100 * len(set(a) & set(b)) >= 50 * len(set(a) | set(b)) for b in right] for a in left]
    assert near_dedup.similar_pairs(left, right, 50).tolist() == want


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, j) for j in range(101, 160)] + [(7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[j] for j in range(100, 160)} == {100}


def test_leaks(spark, docs, texts):
    items = spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()
    index = decontamination.Index([(r.item_id, r.text) for r in items])
    want = set()
    for i, x in texts.items():
        own = decontamination.shingles(decontamination.words_of(x))
        for r, (whole, question, answer, _) in zip(items, index.parts):
            share = [len(p & own) / len(p) if p else 1 for p in (whole, question, answer)]
            if share[0] >= 0.8 or min(share[1:]) >= 0.8:
                want.add((i, r.item_id))
    got = decontamination.search(docs, spark.createDataFrame(items)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and want
    planted = "IN PASSING: " + items[3].text.upper().replace(" ", "\n") + " and on"
    assert [r.item_id for r in decontamination.search(spark.createDataFrame([(1, planted)], "doc_id long, text string"), spark.createDataFrame(items)).collect()] == [items[3].item_id]


@pytest.mark.parametrize("length", [32, 50, 400])
def test_repeats(spark, docs, texts, length):
    rows = sorted(texts.items())[:40] if length < 400 else sorted(texts.items())
    rows += [(10_000, "ab" * 300), (10_001, rows[0][1][:450] + "é"), (10_002, "")]
    repeats_as_counted(spark, rows, length)


def test_repeats_on_both_sides_of_the_length(spark):
    """Passages of 51 to 80 words, from 300 to 500 bytes, in three otherwise different texts each: those of 400 bytes go whole, shorter ones stay whole."""
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9)))
    passages = [" ".join(word() for _ in range(51 + i % 30)) for i in range(60)] + [" " * k + "x" * (400 - k) for k in (0, 1)] + ["y" * 399]
    rows = [(100 * i + j, " ".join(word() for _ in range(40)) + f" {j}" + p + f"{j} " + " ".join(word() for _ in range(40))) for i, p in enumerate(passages) for j in range(3)]
    got = repeats_as_counted(spark, rows, 400)
    sizes = [len(p.encode()) for p in passages]
    assert min(sizes) < 400 < max(sizes)
    for i, n in enumerate(sizes):
        assert all((got[100 * i + j].n_removed >= n) == (n >= 400) and (n >= 400 or got[100 * i + j].n_removed == 0) for j in range(3))


def test_repeats_are_listed_by_maximal_spans(spark, monkeypatch):
    """Two copies of a long text have one span each, so their list stays small enough for a broadcast, however many runs it came from."""
    rng = np.random.default_rng(3)
    text = "".join(rng.choice(list("abcdefgh "), 60_000))
    monkeypatch.setattr(repeats, "BROADCAST_BYTES", 2_000)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = repeats.remove_repeats(spark.createDataFrame([(1, text), (2, text + "!"), (3, "alone")], "doc_id long, text string"))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert {r.doc_id: (r.n_removed, r.n_spans) for r in got.collect()} == {1: (60_000, 1), 2: (60_000, 1), 3: (0, 0)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_only_listed_texts_are_marked(spark, monkeypatch):
    """The filter misses no listed text, null and repeated keys included, and marks few others; full, it marks all."""
    texts = spark.range(4_000).select(F.col("id").alias("d"), F.xxhash64("id").alias("t"), F.col("id").cast("string").alias("text"))
    listed = texts.where("d % 40 = 0").select("d", "t").unionByName(texts.where("d = 40").select("d", "t"))
    marked = {r.d for r in repeats._maybe_listed(texts, listed).where("listed").collect()}
    assert marked >= set(range(0, 4_000, 40)) and len(marked) < 110
    monkeypatch.setattr(repeats, "FILTER_WORDS", 1)
    assert repeats._maybe_listed(texts, texts).where("listed").count() == 4_000


def repeats_as_counted(spark, rows, length):
    """Rows of the operator by doc_id, held against counts of all strings."""
    data = {i: x.encode() for i, x in rows}
    starts = Counter(b[i : i + length] for b in data.values() for i in range(len(b) - length + 1))
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length).collect()
    for r in got:
        b = data[r.doc_id]
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if starts[b[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(b), int(gone.sum()), runs)
        assert r.kept_sha256 == hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()
    return {r.doc_id: r for r in got}


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(x):
    out = []
    for kind, (name, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, x):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": name == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(digits) <= 19 and private_data.luhn(digits), "phone": 10 <= len(digits) <= 15}[name]
            if good:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], s[2]))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab@..112-+%( é", max_size=50) | st.from_regex(r"(\+?[0-9]{1,16}[ .-]){0,6}", fullmatch=True))
def test_base_spans(text):
    assert private_data.base_spans(text) == plain_spans(text)


def test_luhn():
    assert private_data.luhn("4111111111111111") and not private_data.luhn("4111111111111112")


def test_private_data(docs, texts):
    for r in private_data.find_private_data(docs).collect():
        base = plain_spans(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[2] == k for s in base) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(private_data._joined(base).encode()).hexdigest()
        assert set(filter(None, private_data._joined(base).split(","))) <= set(r.spans.split(","))


def spoken(rng, n):
    """Texts with personal data among other words and numbers."""
    words = "the of and to in that is was for on are with as his they be at one have this".split()
    for i in range(n):
        own = [f"name{i % 17}.{i}@mail{i % 7}.example.com", f"{rng.integers(1, 255)}.{rng.integers(1, 255)}.{rng.integers(1, 255)}.7", f"+1 ({rng.integers(200, 999)}) 555-{rng.integers(1000, 9999)}", "4111 1111 1111 1111"][i % 4]
        text = rng.choice(words, 40).tolist()
        yield " ".join([*text[:20], own, *text[20:], f"version {i % 9}.{i % 7}", str(rng.integers(10**15, 10**16))])


def test_field_finds_what_patterns_miss():
    """Rewritten personal data of texts that the field has not seen, beside everyday numbers."""
    rng = np.random.default_rng(5)
    texts = list(spoken(rng, 400))
    field = private_data.fit_field([e for x in texts[:300] for e in private_data.examples(x)])
    found = wanted = added = 0
    for x in texts[300:]:
        new, gold = private_data.rewrite(x, private_data.base_spans(x), rng)
        more = private_data.added_spans(new, private_data.base_spans(new), field)
        wanted, added = wanted + len(gold), added + len(more)
        found += sum(any(s < e2 and e > s2 and k == k2 for s2, e2, k2 in more) for s, e, k in gold)
    assert wanted >= 100 and found / wanted > 0.9 and found / added > 0.9


def test_field_adds_nothing_to_plain_numbers():
    rng = np.random.default_rng(6)
    field = private_data.fit_field([e for x in spoken(rng, 300) for e in private_data.examples(x)])
    for x in ("On 2024-05-06 at 10:45 we paid 1,250 for 3 of 12 items, 15% off", "GPL version 3. and Apache 2.0 of 1999", "just words", "", "see pages 12-15 and 1.2.3"):
        assert private_data.added_spans(x, private_data.base_spans(x), field) == []
    said = "call (743) 555-3824 now"
    assert private_data.added_spans(said, private_data.base_spans(said), field) == [(5, 19, 3)]


def test_added_spans_of_a_table(spark):
    """Through the operator: base columns are those of the patterns, and n_added counts what spans hold beyond them."""
    rng = np.random.default_rng(7)
    rows = list(enumerate(spoken(rng, 200)))
    rows.append((999, "ring (743) 555-3824 or write to name3.41[at]mail6.example.com on Monday"))
    got = {r.doc_id: r for r in private_data.find_private_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, x in rows:
        base = plain_spans(x)
        assert got[i].base_sha256 == hashlib.sha256(private_data._joined(base).encode()).hexdigest()
        assert got[i].n_added == len(list(filter(None, got[i].spans.split(",")))) - len(base)
    assert got[999].n_phone == got[999].n_email == 0 and got[999].spans == "phone:5:19,email:32:61"


def test_messages_are_exact_without_loops():
    """Beliefs of a chain with one skip link over two tokens only equal those of enumeration."""
    field, rng = private_data.Field({"a": 0}), np.random.default_rng(2)
    field.node, field.chain, field.skip = rng.normal(size=(2, 5)), rng.normal(size=(5, 5)), rng.normal(size=(5, 5))
    rows = np.array([[0] + [1] * 8, [1] * 9, [0] * 9])
    chain, skip = np.array([[0, 1]]), np.array([[1, 2]])
    belief, joint = field.marginals(rows, chain, skip, 6)
    score = field.node[rows].sum(1)
    p = np.exp(score[0][:, None, None] + score[1][None, :, None] + score[2][None, None, :] + field.chain[:, :, None] + field.skip[None, :, :])
    p /= p.sum()
    assert np.allclose(belief, [p.sum((1, 2)), p.sum((0, 2)), p.sum((0, 1))], atol=1e-6) and np.allclose(joint[0][0], p.sum(2), atol=1e-6) and np.allclose(joint[1][0], p.sum(0), atol=1e-6)


def test_equal_tokens_are_linked():
    assert private_data._links("a 555-3824 b (743)555-3824 c 555.3824 d x@y.example x@y.EXAMPLE".split()).tolist() == [[1, 3], [1, 5], [3, 5], [7, 8]]


def test_marginals_are_exact_on_a_chain():
    field, rng = quality.LineField(), np.random.default_rng(1)
    field.chain = rng.normal(size=(2, 2))
    potential, sizes = rng.normal(size=7), np.array([4, 3])
    good, joint = field.marginals(potential, sizes)
    at = 0
    for n in sizes:
        weight = {}
        for bits in range(1 << n):
            y = [bits >> k & 1 for k in range(n)]
            weight[tuple(y)] = np.exp(sum(potential[at + k] * y[k] for k in range(n)) + sum(field.chain[a, b] for a, b in zip(y, y[1:])))
        total = sum(weight.values())
        assert np.allclose(good[at : at + n], [sum(w for y, w in weight.items() if y[k]) / total for k in range(n)])
        at += n
    assert np.isclose(joint.sum(), 5)


def test_quality_and_language_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    got = quality.query(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.9
    got = language.query(spark, d).join(spark.read.parquet(f"{d}/documents.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.97


def test_page_text_is_the_article(spark):
    import html

    rows = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    got = {r.page_id: r.text for r in page_text.query(spark, DATA).collect()}
    for r in rows:
        parts = [re.sub(r"\s+", " ", html.unescape(x)).strip() for x in re.split("<[^>]*>", r.html.partition("<article>")[2].partition("</article>")[0])]
        assert got[r.page_id] == "\n".join(filter(None, parts))


def brute_pages(rows):
    """Text of pages without an article: blocks of which runs of WINDOW words that stand on two unlike pages of the host cover less than half."""
    w = page_text.WINDOW
    parsed = {i: (page_text._host(url), [t for _, t in page_text.blocks(page)]) for i, url, page in rows}
    held = {}
    for host, own in parsed.values():
        words = " ".join(own).split()
        for at in range(len(words) - w + 1):
            held.setdefault((host, tuple(words[at : at + w])), set()).add("\n".join(own))
    out = {}
    for i, (host, own) in parsed.items():
        words = " ".join(own).split()
        covered = [False] * len(words)
        for at in range(len(words) - w + 1):
            if len(held[host, tuple(words[at : at + w])]) > 1:
                covered[at : at + w] = [True] * w
        kept, at = [], 0
        for block in own:
            n = len(block.split())
            if 2 * sum(covered[at : at + n]) < n:
                kept.append(block)
            at += n
        out[i] = "\n".join(kept)
    return out


def test_repeats_of_hosts_against_brute_force(spark):
    """The given pages with every element but p made a plain div: nothing but repeats decides."""
    rows = [(r.page_id, r.url, re.sub(r"<(/?)(?:article|nav|footer|ul|li|h1|div)[^>]*>", r"<\1div>", r.html)) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    rows += [(10_000 + i, "http://one.example.org/x", f"<div>{'again and ' * (i + 3)}</div><div>page {i} speaks of nothing that others say so far at all</div>") for i in range(5)]
    want = brute_pages(rows)
    for parts in (page_text.PART_PAGES, 1):
        page_text.PART_PAGES, before = parts, page_text.PART_PAGES
        got = page_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
        page_text.PART_PAGES = before
        assert {r.page_id: r.text for r in got} == want
    assert any(len(want[i]) < 0.99 * len("\n".join(t for _, t in page_text.blocks(page))) for i, _, page in rows)


def test_suffix_array():
    tokens = np.array([3, 1, 2, 1, 2, 1, 3, 1, 2, 9])
    order, common = page_text.suffix_array(tokens, 8)
    want = sorted(range(10), key=lambda i: tokens[i : i + 8].tolist())
    assert order.tolist() == want
    lcp = [0] + [next((k for k in range(8) if a + k >= 10 or b + k >= 10 or tokens[a + k] != tokens[b + k]), 8) for a, b in zip(want, want[1:])]
    assert common.tolist() == lcp


def plain_bundle(text):
    """Sum of the bound letter vectors of all trigrams, one by one."""
    low = [ord(c.lower()[0]) if c.isalpha() else 0 for c in text]
    s = [0]
    for x in low:
        x = x - 96 if 97 <= x <= 122 else 26 + x if x else 0
        if x or s[-1]:
            s.append(x)
    s = [0, *s[1:], 0] if s[-1] else [*s, 0]
    total = np.zeros(language.DIMENSIONS)
    for a, b, c in zip(s, s[1:], s[2:]):
        if b:
            total += language.letter_vector(a) * np.roll(language.letter_vector(b), 1).astype(int) * np.roll(language.letter_vector(c), 2)
    return total


@pytest.mark.parametrize("text", ["The cat, the DOG", "é\u00e8\u00f1 ßx", "  привет мир ", "γεια σου", "日本語 text 𐐀𐐨", "a"])
def test_bundles(text):
    assert np.array_equal(language.bundle(text), plain_bundle(text))


def test_languages_of_other_scripts(spark):
    """Two languages of one script, and of two scripts, none of them with a letter of a-z."""
    words = {"ru": "это не так как было все что они еще нет".split(), "uk": "це не так як було все що вони ще немає їх".split(), "el": "και το να είναι με για που δεν από".split(), "ja": "これ それ です ます から まで ない ある".split()}
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(words[k], 30)), k) for i, k in enumerate(list(words) * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.identify(docs.where("doc_id >= 60"), language.prototypes(docs.where("doc_id < 60"))).collect()
    assert np.mean([r.lang_pred == rows[r.doc_id][2] for r in got]) > 0.95


def test_retrieval_is_complete():
    """Every piece that reaches its share of its full score in a passage is retrieved, whatever the blocks and pivots pass over."""
    rng = np.random.default_rng(4)
    word = [f"w{int(x)}" for x in rng.zipf(1.3, 20_000) if x < 3000]
    items = [(i, " ".join(rng.choice(word, rng.integers(3, 150)))) for i in range(400)]
    index = decontamination.Index(items)
    assert len(index.least) > 5
    texts = [" ".join([*rng.choice(word, 60), *items[k][1].split()[: 20 + k % 80], *rng.choice(word, 90)]) for k in range(0, 400, 9)]
    flat = index.numbered([decontamination.words_of(x) for x in texts])
    want = {}
    for t, f in enumerate(flat):
        for at in range(0, len(f), decontamination.PIECE):
            own = set(f[at : at + 2 * decontamination.PIECE].tolist()) - {-1}
            for p in range(len(index.owner)):
                score = sum(x for k, x in zip(index.own_terms[p].tolist(), index.own_impacts[p].tolist()) if k in own and k >= 0)
                if score >= index.threshold[p]:
                    key = (t, int(index.owner[p]))
                    want[key] = max(want.get(key, 0), score)
    got = index.retrieve(flat)
    assert got.keys() == want.keys() and want and all(np.isclose(got[k], want[k]) for k in want)


def test_search_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "the cat sat on the mat today"), (3, "the cat sat on the mat today"), (3, "the cat sat on the mat today")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "the cat sat on the mat today", "x"), (8, None, "x"), (9, "", "x"), (None, "no such words at all here", "x")], "item_id long, text string, doc_id string")
    assert sorted((str(r.doc_id), r.item_id) for r in decontamination.search(docs, items).collect()) == [("3", 7), ("3", 7), ("None", 7)]
    assert decontamination.search(docs.where("1 = 0"), items).collect() == [] and decontamination.search(docs, items.where("1 = 0")).collect() == []
    assert decontamination.clean(docs, items.where("1 = 0")).count() == 5


def test_vocabularies_that_are_refused():
    import json

    word = json.loads(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    for change in ({"normalizer": None}, {"pre_tokenizer": {"type": "Whitespace"}}, {"added_tokens": [{"content": "x", "id": 1, "lstrip": True}]}):
        with pytest.raises(ValueError):
            bpe.expect(json.dumps(word | change), normalizer=word_codec.NORMALIZER, pre_tokenizer=word_codec.PRE_TOKENIZER)
            bpe.special_tokens(json.dumps(word | change))
    for change in ({"dropout": 0.1}, {"vocab": word["model"]["vocab"] | {"zz": 1 << 17}}, {"type": "Unigram"}):
        with pytest.raises(ValueError):
            bpe.Merger(json.dumps(word | {"model": word["model"] | change}))
    with pytest.raises(ValueError):
        token_counts.whole_tokens(json.dumps(word))


def test_decode_of_nulls(spark):
    rows = spark.createDataFrame([(1, None), (None, b"")], "doc_id long, ids binary")
    assert sorted((str(r.doc_id), r.text) for r in word_codec.decode(rows, public_tokenizers.path("word_bpe_49k.json")).collect()) == [("1", ""), ("None", "")]


def test_scratch_tables_go(spark):
    import os

    from chunkloom.llm import common

    root = common.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(root))
    with common.scratch():
        kept, gone = (common.materialise(spark.range(3), n) for n in ("kept-table", "gone-table"))
        with common.scratch():
            inner = common.outlive(common.materialise(spark.range(4), "inner-table"))
        common.outlive(kept)
        assert gone.count() + inner.count() == 7
    assert {n.split("-")[0] for n in set(os.listdir(root)) - before} == {"kept"} and kept.count() == 3


def test_hot_group_is_compared_in_parts(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SALT_ROWS", 7)
    rows = [(i, "Same text") for i in range(100)] + [(200, "other"), (201, "OTHER"), (202, "alone"), (None, "same TEXT")]
    got = exact_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.keep_id, r.group_size) for r in got} == {(99, 101), (201, 2), (202, 1)} and sum(r.kept for r in got) == 3
