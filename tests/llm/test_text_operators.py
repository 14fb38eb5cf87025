"""Encoding, language, main text and benchmark passages against brute force."""

import hashlib
import random
import struct
import time
import zlib

import public_tokenizers
import pytest
import tiktoken

from patchloom.llm import byte_bpe, decontaminate, language, main_text

from .conftest import SF_DIR

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def exact():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})


def test_bpe_equals_tiktoken(exact):
    own = byte_bpe.Codec(PATH, PATTERN)
    rng = random.Random(3)
    letters = " \n\t\r  ab1'.sé日\x1c ſ"
    texts = ["", " ", "a  b", "a\n \nb", "x 's 're", "<|endoftext|>", "é" * 3000, "a" * 5000]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    for text in texts:
        ids = own.encode(text)
        assert ids == exact.encode_ordinary(text), repr(text)
        assert own.decode(ids) == text.encode()


def test_bpe_every_piece_is_its_own_encoding():
    own = byte_bpe.Codec(PATH, PATTERN)
    mapped = ["".join(own.letters[b] for b in piece) for piece in own.pieces]
    assert own.model.encode(mapped) == [[k] for k in range(len(mapped))]


def test_bpe_query(spark, exact, rows, documents):
    docs = documents((1, "Hello  world\n"), (2, None), (3, ""), (1, "Hello  world\n"), (None, "x"))
    def want(text):
        ids = exact.encode_ordinary(text)
        return (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    got = rows(byte_bpe.digests(docs, PATH, PATTERN))
    assert got == sorted([(1, *want("Hello  world\n")), (2, *want("")), (3, *want("")), (1, *want("Hello  world\n")), (None, *want("x"))], key=repr)
    assert rows(byte_bpe.digests(docs.limit(0), PATH, PATTERN)) == []


def test_bpe_table(spark, exact):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    want = {r["doc_id"]: hashlib.sha256(struct.pack(f"<{len(i)}I", *i)).hexdigest() for r in docs.collect() for i in [exact.encode_ordinary(r["text"] or "")]}
    assert {r["doc_id"]: r["ids_sha256"] for r in byte_bpe.digests(docs, PATH, PATTERN).collect()} == want


def brute_phrases(sample, text):
    count, at = 0, 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in sample:
            n += 1
        count, at = count + 1, at + n
    return count


def test_phrases_equal_brute_force():
    rng = random.Random(1)
    sample = "".join(rng.choice("abc ") for _ in range(300))
    automaton = language.SuffixAutomaton(sample)
    for _ in range(300):
        text = "".join(rng.choice("abcd ") for _ in range(rng.randint(1, 30)))
        assert automaton.phrases(text) == brute_phrases(sample, text), text


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r["doc_id"]: r for r in language.identify(docs).collect()}
    given = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert set(found) == set(given)
    held = [d for d in given if zlib.crc32(str(d).encode()) % 4 == 2]
    assert held and all(found[d]["held_out"] == (d in set(held)) for d in given)
    assert sum(found[d]["lang_pred"] == given[d] for d in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_language_odd_rows(spark, documents):
    docs = documents((1, "the old house and the sea", "en"), (5, "das alte Haus und die See", "de"), (2, None, "en"), (3, "", None),
                     (4, "123 !?", "en"), (None, "the house", None), (1, "the old house and the sea", "en"))
    got = {(r["doc_id"], r["lang_pred"], r["score"] > 0) for r in language.identify(docs).collect()}
    assert {(2, "und", False), (3, "und", False), (4, "und", False)} <= got
    assert language.identify(docs.limit(0)).collect() == []
    unlabelled = documents((1, "some words", None))
    assert [r["lang_pred"] for r in language.identify(unlabelled).collect()] == ["und"]


def test_language_of_numerals_and_repeated_ids(spark, documents):
    docs = documents((1, "½ ² ① Ⅷ", "en"), (2, "the old house and the sea", "en"), *[(5, f"das alte Haus {k}", "de") for k in range(40)])
    assert {r["lang_pred"] for r in language.identify(docs).filter("doc_id = 1").collect()} == {"und"}
    known = language.samples(docs, "text", "lang", "doc_id")
    assert known["de"].split() == ["das", "alte", "haus"]


def test_language_labels_are_no_input(spark, documents):
    train = documents((1, "the old house and the sea of the north", "en"), (5, "das alte Haus und die See im Norden", "de"))
    known = language.samples(train, "text", "lang", "doc_id")
    ask = documents((7, "das Haus", "en"), (8, "the house", "de"))
    assert [r["lang_pred"] for r in language.predict(ask, known).orderBy("doc_id").collect()] == ["de", "en"]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=1>Home</a></li></ul></nav><!-- ad --><div class="ad">Buy now</div>
<div class="cookie-notice">We use cookies</div><main><article><h1>Head &amp; more</h1><p><b>Bold</b> words,
 new   line<br>after.<p>Second &#233;t&eacute;<div class="ad">Ad inside the text</div><aside>Related</aside>
<form><label>Mail</label><input></form><ul><li>one</li><li>two</li></ul></article>
<section id="comments"><p>Nice article, thanks for all of these words here</p></section></main><footer>&copy; c</footer></body></html>"""


def test_main_text_of_a_page():
    assert main_text.main_text(PAGE) == "Head & more\nBold words, new line after.\nSecond été\none\ntwo"
    assert main_text.main_text(None) == main_text.main_text("") == main_text.main_text("<p></p>") == ""


def brute_cut(gains, edges):
    best = None
    for code in range(1 << len(gains)):
        on = [code >> k & 1 for k in range(len(gains))]
        cost = sum(g * (not x) if g > 0 else -g * x for g, x in zip(gains, on)) + sum(w for a, b, w in edges if on[a] != on[b])
        best = cost if best is None or cost < best - 1e-9 else best
    return best


def test_cut_is_minimal():
    rng = random.Random(2)
    for _ in range(150):
        n = rng.randint(1, 8)
        gains = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.uniform(0, 2)) for _ in range(rng.randint(0, 12))]
        edges = [e for e in edges if e[0] != e[1]]
        on = main_text.minimum_cut(gains, edges)
        cost = sum(g * (not x) if g > 0 else -g * x for g, x in zip(gains, on)) + sum(w for a, b, w in edges if on[a] != on[b])
        assert abs(cost - brute_cut(gains, edges)) < 1e-6


def test_main_text_rows(spark, rows):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "y"), (None, "u", "", None)], "page_id long, url string, html string, text string")
    got = rows(main_text.extract(pages).select("page_id", "n_chars"))
    assert got == sorted([(1, len(main_text.main_text(PAGE))), (2, 0), (None, 0)], key=repr)
    assert rows(main_text.extract(pages.limit(0))) == []


def edit_distance_inside(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_benchmark_hits_equal_brute_force():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeiostnr") for _ in range(rng.randint(2, 8)))
    items = [" ".join(word() for _ in range(rng.randint(8, 25))) for _ in range(6)]
    index = decontaminate.Index([(k, t.encode()) for k, t in enumerate(items)], decontaminate.Q, decontaminate.BUDGET)
    for trial in range(60):
        text = bytearray(rng.choice(items).encode())
        for _ in range(rng.randint(0, 14)):
            at = rng.randrange(len(text))
            rng.choice([lambda: text.__delitem__(at), lambda: text.insert(at, 120), lambda: text.__setitem__(at, 121)])()
        whole = " ".join(word() for _ in range(20)).encode() + b" " + bytes(text) + b" " + " ".join(word() for _ in range(20)).encode()
        got = {h[0] for h in index.hits([b"", whole])[1]}
        want = {k for k, t in enumerate(items) if edit_distance_inside(t.encode(), whole) <= index.most[k]}
        assert got == want, trial


def test_benchmark_rows(spark, rows, documents):
    item = "The quick brown fox jumps over the lazy dog and runs away from the old mill"
    benchmark = spark.createDataFrame([(7, item), (8, None), (9, "x"), (10, "")], "item_id long, text string")
    docs = documents((1, f"before  {item.upper()} after"), (2, "nothing here"), (3, None), (4, ""), (1, f"before  {item.upper()} after"))
    assert rows(decontaminate.find(docs, benchmark), "doc_id", "item_id", "edits") == [(1, 7, 0), (1, 7, 0)]
    assert rows(decontaminate.clean(docs, benchmark), "doc_id", "key") == [(2, "kept"), (3, "kept"), (4, "kept")]
    assert rows(decontaminate.find(docs, benchmark.limit(0))) == []
    assert decontaminate.clean(docs, benchmark.limit(0)).count() == 5


def test_short_benchmark_items_are_looked_up(spark, rows, documents):
    benchmark = spark.createDataFrame([(1, "short one"), (2, "Yes"), (3, "one here"), (4, "Yes"), (5, "été")], "item_id long, text string")
    docs = documents((1, "a short  ONE here"), (2, "yes, yes."), (3, "yesterday a short onerous thing"), (4, "l'été dernier"), (5, "étés"))
    got = rows(decontaminate.find(docs, benchmark), "doc_id", "item_id", "start", "edits")
    assert got == sorted([(1, 1, 2, 0), (1, 3, 8, 0), (2, 2, 0, 0), (2, 2, 5, 0), (2, 4, 0, 0), (2, 4, 5, 0), (4, 5, 2, 0)], key=repr)
    assert rows(decontaminate.clean(docs, benchmark), "doc_id") == [(3,), (5,)]


def test_benchmark_blocks_find_the_same(spark, rows, monkeypatch):
    docs, benchmark = (spark.read.parquet(f"{SF_DIR}/{n}.parquet") for n in ("documents", "benchmark"))
    whole = rows(decontaminate.find(docs, benchmark))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 3000)
    assert whole and rows(decontaminate.find(docs, benchmark)) == whole


@pytest.mark.parametrize("page, text", [
    ("<article class='post tags-news'><p>Some words of an article</p></article>", "Some words of an article"),
    ("<div class='main-content comments-open no-sidebar'><p>Some words</p></div>", "Some words"),
    ("<div class='main-content'><p>Some words</p><div id='article-comments'><p>Nice words of a reader</p></div></div>", "Some words"),
    ("<div><p>Some words here</p><ul class='comment-list'><li>Nice words of a reader</li></ul></div>", "Some words here"),
    ("<ul class=menu><li><a href=x>Home</a></li></ul><p>short text</p>", "short text"),
    ("<p>Some long enough words of a text here</p><p>All rights reserved 2024.</p>", "Some long enough words of a text here"),
    ("<p title='a > b' data-x=\"<b>\">One</p><p class=\"open>Two</p><p>Three</p>", "One\nTwo\nThree"),
    ("<p>One<script>x = '<p>no'</script> two<!-- <p>no --> three</p><br/><style>p {}", "One two three"),
    ("<p>1 < 2 and <3</p>", "1 < 2 and <3"),
])
def test_main_text_of_odd_pages(page, text):
    assert main_text.main_text(page) == text


def test_main_text_takes_time_in_proportion():
    start = time.process_time()
    main_text.main_text('<a "' * 250_000)
    main_text.main_text('<a "' * 250_000 + '">')
    main_text.main_text("<!x" * 300_000)
    main_text.main_text("<div>" * 50_000 + "</section>" * 50_000)
    assert time.process_time() - start < 10
    rng = random.Random(5)
    start = time.process_time()
    main_text.main_text("".join(rng.choice(["<div>a b</div>", "<p>a</p>", "<h2>c d</h2>", "<ul><li>a</li></ul>"]) for _ in range(50_000)))
    gains = [rng.uniform(-1, 1) for _ in range(20_000)]
    main_text.minimum_cut(gains, [(k, k + 1, 0.6) for k in range(19_999)] + [(k, k + 3, 0.6) for k in range(19_997)])
    assert time.process_time() - start < 20
