"""Every operator on nulls, empty and long texts, repeated rows, ties, clashing columns and empty tables."""

import public_tokenizers
import pytest

from chunkloom.llm import decontamination, exact_dedup, language, near_dedup, page_text, private_data, quality, repeats, token_counts, word_codec

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, d long, t string, bucket int, rep string, component string, class string, word string, spans string, row int"
LONG = "lorem ipsum dolor sit amet " * 20_000
ROWS = [
    (1, None, "en", None), (2, "", None, "s"), (3, " \n\t ", "en", "s"), (4, LONG, "en", "s"), (5, LONG, None, "s"), (6, "The cat sat on the mat and looked at the dog.", "en", "s"),
    (6, "The cat sat on the mat and looked at the dog.", "en", "s"), (7, "THE CAT sat on the mat and looked at the dog.", "en", "s"), (None, "The cat sat on the mat and looked at the dog.", None, None),
    (8, "x", "fr", "s"), (9, "é\u0000<|endoftext|>日本語 +1 (555) 123-4567 a@b.co", "fr", "s"), (10, "a" * 30_000, "de", "s"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, x, lang, s, 0, "x", 1, "y", 2, "z", "c", "k", "w", "p", 3) for i, x, lang, s in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (6, 1, 0), (8, 0, None), (10, 0, 0), (1, None, None), (None, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")


def operators(spark, labels):
    items = spark.createDataFrame([(1, "the cat sat on the mat and looked at the dog"), (2, None), (3, ""), (4, "x")], "item_id long, text string")
    byte, word = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
    return {
        "language": lambda x: language.identify(x, language.prototypes(x)), "exact": exact_dedup.deduplicate, "encode": lambda x: word_codec.encode(x, word), "near": lambda x: near_dedup.link(x, 2),
        "private": private_data.find_private_data, "quality": lambda x: quality.score(x, quality.train(x, labels)), "counts": lambda x: token_counts.count_tokens(x, byte), "repeats": repeats.remove_repeats,
        "clean": lambda x: decontamination.clean(x, items), "good": lambda x: quality.keep_good(x, quality.train(x, labels)),
    }


@pytest.mark.parametrize("name", ["language", "exact", "encode", "near", "private", "quality", "counts", "repeats"])
def test_one_row_each(spark, docs, labels, name):
    got = operators(spark, labels)[name](docs).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", ["language", "exact", "encode", "near", "private", "quality", "counts", "repeats", "clean", "good"])
def test_empty_table(spark, docs, labels, name):
    assert operators(spark, labels)[name](docs.where("1 = 0")).collect() == []


def test_exact(docs):
    got = {(r.doc_id, r.kept): r for r in exact_dedup.deduplicate(docs).collect()}
    assert got[7, True].group_size == 4 and got[6, False].keep_id == 7 and got[None, False].keep_id == 7
    assert got[2, True].keep_id == 2 and got[1, False].group_size == 2 and got[5, True].group_size == 2


def test_near(docs):
    got = {r.doc_id: r for r in near_dedup.link(docs, 2).collect()}
    assert got[1].n_shingles == got[3].n_shingles == 0 and got[1].kept and got[3].component_id == 3
    assert got[7].component_id == 6 and not got[7].kept and got[None].component_id == 6
    assert got[5].component_id == 4 and got[8].n_shingles == 1


def test_clean_keeps_columns(spark, docs, labels):
    got = operators(spark, labels)["clean"](docs)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [1, 2, 3, 4, 5, 9, 10]


def test_languages(docs):
    got = {r.doc_id: r for r in language.identify(docs, language.prototypes(docs)).collect()}
    assert got[1].lang_pred == got[2].lang_pred == "und" and got[2].score == 0 and got[6].lang_pred == "en"


def test_no_labels(spark, docs, labels):
    assert {r.score for r in quality.score(docs, quality.train(docs, labels.where("1 = 0"))).collect()} == {0.5}


def test_pages(spark):
    rows = [(1, "http://a.b/1", None), (None, None, "<p>x"), (2, "u", ""), (2, "u", "<article><p>a  b<p>c &amp; d<nav>no</nav></article><aside>no</aside>"), (3, "http://a.b/2", "<div class='menu'>no</div><article>" + "w " * 50_000 + "</article>")]
    got = page_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in got) == [("1", 0), ("2", 0), ("2", 9), ("3", 99_999), ("None", 1)]
    assert {r.text for r in got if r.page_id == 2} == {"", "a b\nc & d"}


def test_pages_without_article(spark):
    note = "All rights are reserved by the owners of this site"
    rows = [(i, f"http://h.x/{i}", f"<p>Own words of page {i} told here only by page {i * 7}</p><p>{note}</p>") for i in range(4)]
    got = page_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(note not in r.text and f"page {r.page_id} told" in r.text for r in got)


def test_pages_of_no_rows_or_odd_columns(spark):
    schema = "page_id long, url string, html string, host string, stream int, open int, row int, mirror string, text string, n_chars string"
    rows = [(1, None, "<p>one two</p>", "h", 1, 2, 3, "m", "t", "n"), (1, None, None, "h", 1, 2, 3, "m", "t", "n"), (None, "u", "<article>x</article>", None, None, None, None, None, None, None)]
    pages = spark.createDataFrame(rows, schema)
    assert page_text.extract(pages.where("1 = 0")).collect() == []
    got = page_text.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and sorted((str(r.page_id), r.text) for r in got.collect()) == [("1", ""), ("1", "one two"), ("None", "x")]


def test_class_words_alone_drop_nothing():
    page = '<article><h1>T</h1><p class="related-work">A</p><p class="comment">B</p><div class="social"><p>C</p></div><div class="comments"><p>D</p></div><section id="ad-box">E</section></article><div class="ad">F</div>'
    assert page_text.blocks(page) == [("main", "T"), ("main", "A"), ("doubtful", "B"), ("doubtful", "C"), ("dropped", "D"), ("dropped", "E"), ("dropped", "F")]


def test_mirrored_pages_keep_their_text(spark):
    body = "<p>The very same long text stands on two pages of this one host word for word</p>"
    rows = [(1, "http://h.x/a", body), (2, "http://h.x/b", body), (3, "http://h.x/c", "<p>something else</p>")]
    got = page_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r.n_chars for r in got) == [14, 74, 74]


def test_repeats_are_sought_on_pages_with_an_article(spark):
    """Every page goes through the repeated runs of its host, whether or not structure leaves a block open; a menu of one page only is no repeat."""
    note = "all rights are reserved by the owners of this site"
    rows = [(i, f"http://h.x/{i}", f"<nav>own menu of page {i} with as many as ten words {i}</nav><article><p>Body {i}</p></article><footer>{note}</footer>") for i in range(3)]
    rows += [(7, "http://other.x/", f"<article><p>Body 7</p></article><footer>{note}</footer>"), (8, "http://h.x/8", f"<nav>menu</nav><p>own words of page eight stand here alone</p><p>{note}</p>")]
    rows += [(9, "http://h.x/9", f'<article><p>Body 9</p><p class="notice">{note}</p><p class="notice">short</p></article>')]
    got = {r.page_id: (r.text, r.n_repeated) for r in page_text.extract_counted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: ("Body 0", 10), 1: ("Body 1", 10), 2: ("Body 2", 10), 7: ("Body 7", 0), 8: ("own words of page eight stand here alone", 10), 9: ("Body 9\nshort", 10)}


def test_streams_hold_whole_pages(spark):
    """Pages with the same menu and notice but other articles are distinct pages of their host, and what stands in one page's article repeats in another page's notice."""
    menu, note = "home news sport culture travel science weather archive", "all rights are reserved by the owners of this site"
    said = "the long sentence of page one is quoted word for word"
    rows = [(i, f"http://h.x/{i}", f'<nav>{menu}</nav><article><p>Body {i}</p><p class="notice">{note}</p></article><footer>{note}</footer>') for i in range(3)]
    rows += [(10, "http://q.x/10", f"<article><p>{said}</p></article>"), (11, "http://q.x/11", f'<article><p>Body 11</p><p class="related">{said}</p></article>')]
    rows += [(12, "http://z.x/12", f'<article><p>Body 12</p><p class="related">{said}</p></article>')]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {**{i: (f"Body {i}", 28) for i in range(3)}, 10: (said, 0), 11: ("Body 11", 11), 12: (f"Body 12\n{said}", 0)}
    before = page_text.SHARED_WINDOWS
    for shared in (before, -1):  # shared with all tasks, and joined with the pages by shuffle
        page_text.SHARED_WINDOWS = shared
        got = {r.page_id: (r.text, r.n_repeated) for r in page_text.extract_counted(pages).collect()}
        page_text.SHARED_WINDOWS = before
        assert got == want


def test_inline_elements_stay_in_their_block():
    page = '<article><p>Hello <span class="notice">x</span> there</p><p>See <a class="comment" href="#">this</a> and <b class="social">that</b>.</p><p>Energy <math><mi>E</mi></math> is <object data="a">kept</object></p></article>'
    assert page_text.blocks(page) == [("main", "Hello x there"), ("main", "See this and that."), ("main", "Energy E is kept")]


def test_places_that_do_not_fit_are_refused(monkeypatch):
    import numpy as np

    monkeypatch.setattr(repeats, "_PLACE", np.uint64(63))
    assert len(repeats.samples(repeats.grams(np.arange(70, dtype=np.uint8)), 5, 4)) == 5
    with pytest.raises(ValueError):
        repeats.samples(repeats.grams(np.arange(90, dtype=np.uint8)), 5, 4)


def test_lines_of_the_fit_come_from_the_whole_text():
    assert quality.sampled_lines(150, 7).tolist() == list(range(150))
    for n in (201, 1000, 12_345):
        got = quality.sampled_lines(n, n * 31)
        assert len(got) == len(set(got.tolist())) == 200 and got.min() < n / 10 and got.max() >= 0.9 * n and got.max() < n


def test_tokens_of_the_fit_come_from_the_whole_text():
    words = [f"+49 30 {i:07d}" if i % 3 == 0 else "word" for i in range(900)]
    tokens = private_data._tokens(" ".join(words))[1]
    got = private_data._windows(tokens, 240)
    assert 100 < len(got) <= 240 and got.min() < 50 and got.max() > len(tokens) - 50
    few = private_data._windows(["word"] * 30 + ["a@b.co"] + ["word"] * 30, 240)
    assert few.tolist() == list(range(26, 35))
