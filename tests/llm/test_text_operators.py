from __future__ import annotations

import random

import brute
import pytest
from pyspark.sql import functions as F

from storelens.llm import decontaminate, html_region, language, licences, ngram_join, pieces, quality
from storelens.llm.registry import QUERIES, tokenizer_path

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def docs_of(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in docs_of(spark).collect()}


def made_up(seed: int, n: int, length: int = 40) -> str:
    drawn = random.Random(seed)
    return " ".join("w" + str(drawn.randrange(n)) for _ in range(length))


# --- operator 1


def near_rows():
    """Copies, near copies, chains, short and empty texts, and pairs on both sides of the threshold."""
    rows, base = [], made_up(1, 10**6, 60).split()
    rows += [(10, " ".join(base)), (11, " ".join(base).upper()), (12, "\t".join(base))]
    for k in range(20):  # each changes one word, so two of them are farther from each other than from the base
        rows.append((100 + k, " ".join(base[: k * 3] + [f"x{k}"] + base[k * 3 + 1 :])))
    chain = made_up(2, 10**6, 80).split()
    for k in range(6):
        rows.append((200 + k, " ".join(chain[k : 60 + k])))
    for k, cut in enumerate(range(1, 14)):
        rows.append((300 + k, " ".join(made_up(3, 10**6, 100).split()[:-cut])))
    rows += [(1, ""), (2, None), (3, "  \n\t "), (4, "one"), (5, "ONE"), (6, "one two"), (7, "one  two"), (8, "two one")]
    rows += [(9, "a b c d"), (9, "a b c d"), (13, "é É"), (14, "É É")]
    rows += [(400 + k, made_up(k, 50, 30)) for k in range(30)]
    return rows


@pytest.mark.parametrize("words, num, den", [(3, 90, 100), (5, 80, 100), (2, 50, 100)])
def test_groups_equal_brute_force(spark, words, num, den):
    rows = near_rows()
    found = ngram_join.similar_groups(
        spark.createDataFrame(rows, DOCS).repartition(3), ngram_join.Rule(words, num, den)
    ).collect()
    assert len(found) == len(rows)
    wanted = brute.jaccard_groups(dict(rows), words, num, den)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == wanted


def test_groups_without_leaders_are_the_same(spark, monkeypatch):
    """Block lists and derived answers alone find every link."""
    nothing = ngram_join.leader_pairs
    monkeypatch.setattr(ngram_join, "leader_pairs", lambda classes, rule: nothing(classes, rule).limit(0))
    rows = near_rows()
    found = ngram_join.similar_groups(spark.createDataFrame(rows, DOCS), ngram_join.Rule(3, 90, 100)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute.jaccard_groups(dict(rows), 3, 90, 100)


def test_groups_of_nothing_and_of_rows_without_id(spark):
    assert ngram_join.similar_groups(spark.createDataFrame([], DOCS)).collect() == []
    found = ngram_join.similar_groups(spark.createDataFrame([(None, "a b c"), (None, None), (5, "a b c")], DOCS)).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in found) == [(0, 0, 0), (0, 1, 5), (5, 1, 5)]


def test_near_rows_without_an_id_link(spark):
    words = [f"w{i}" for i in range(60)]
    near, far = " ".join(words), " ".join(reversed(words))
    rows = [(None, near), (5, near + " x"), (9, near + " y"), (None, far), (None, far + " z"), (7, "other words entirely")]
    frame = spark.createDataFrame(rows, DOCS).withColumnRenamed("doc_id", "name")
    found = ngram_join.similar_groups(frame, ngram_join.Rule(3, 90, 100), key="name").collect()
    assert sorted((str(r["name"]), str(r["component_id"])) for r in found) == [("5", "5"), ("7", "7"), ("9", "5"), ("None", "5"), ("None", "None"), ("None", "None")]


def test_one_of_each_tells_texts_of_one_id_apart(spark):
    words = [f"w{i}" for i in range(60)]
    near, far = " ".join(words), " ".join(reversed(words))
    rows = [(1, near), (1, near + " x"), (1, near), (2, near + " y"), (2, far), (3, far), (1, ""), (1, ""), (4, None)]
    kept = ngram_join.one_of_each(spark.createDataFrame(rows, DOCS), ngram_join.Rule(3, 90, 100)).collect()
    # One of the two near texts under id 1 stays; id 2 keeps the text that heads its group and loses the copy.
    assert sorted((r["doc_id"], (r["text"] or "")[:3]) for r in kept) == [(1, ""), (1, "w0 "), (2, "w59"), (4, "")]


def test_one_of_each_keeps_columns_and_clean_rows(spark):
    frame = spark.createDataFrame(near_rows(), DOCS).withColumn("n", F.lit(1)).withColumn("name", F.lit("x"))
    kept = ngram_join.one_of_each(frame, ngram_join.Rule(3, 90, 100))
    assert kept.columns == ["doc_id", "text", "n", "name"]
    wanted = brute.jaccard_groups(dict(near_rows()), 3, 90, 100)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (_, c) in wanted.items() if c == i)


# --- operator 2


def test_region_is_the_article(spark):
    found = {r["page_id"]: r["text"] for r in QUERIES["op2_html_text"](spark, SMALL).collect()}
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    assert len(found) == len(pages)
    import html
    import re

    for page in pages:
        article = re.search(r"<article>(.*?)</article>", page["html"], re.S).group(1)
        plain = re.sub(r"</?b>", "", article)
        assert found[page["page_id"]] == " ".join(html.unescape(re.sub(r"<[^>]+>", "\n", plain)).split())


PAGE = (
    "<html><head><title>t</title></head><body><header>Site head</header><div class='menu'><a href=x>m1</a></div>"
    "<aside>side bar</aside><article><h1>Ti &amp; tle</h1><p>One <b>two</b>three <a href=y>link</a> &lt;b&gt;.</p>"
    "<p>{}</p><section class='comments'><p>nice post</p></section><form>sub <input></form></article>"
    "<div id='comments'><p>reader words {}</p></div><footer>f</footer></body></html>"
)


def test_boilerplate_goes_and_odd_pages_are_read():
    weights = html_region.Weights([])
    page = PAGE.format("word " * 30, "c " * 50)
    wanted = "Ti & tle One twothree link <b>. " + " ".join(["word"] * 30)
    assert html_region.main_text(page, weights) == wanted
    assert html_region.main_text(page.replace("article", "div"), weights) == wanted
    for odd, text in ((None, ""), ("", ""), ("plain  text", "plain text"), ("<p>a<p>b<br>c<script>x<y", "a b c"), ("<a title=\"x>y", "y"), ("a < b", "a < b"), ("<p>&am</p>", "&am")):
        assert html_region.main_text(odd, weights) == text


def test_dropped_elements_within_the_content_are_bridged():
    """The learned weights of an advert cost more than the paragraphs around it score."""
    learned = "<body><div class='ad'>buy these very cheap things here now</div><article><p>some words</p></article></body>"
    counts = html_region.Counter()
    for _ in range(500):
        html_region.count_page(learned, counts)
    weights = html_region.Weights([(*k, n) for k, n in counts.items()])
    assert weights.of_tag("div.ad") > 20
    dropped = (
        "<div class='ad'>buy these very cheap things here now</div>", "<div class='notice'>please note <b>this</b></div>",
        "<aside><p>beside</p></aside>", "<form>your <input> name</form>", "<section class='comments'>" + "<p>nice <i>post</i> indeed</p>" * 200 + "</section>",
    )
    for odd in (*dropped, "".join(dropped)):
        page = f"<body><div class='ad'>x y</div><article><h1>Head line</h1><p>First words here.</p>{odd}<p>Last ones.</p></article><footer>f</footer></body>"
        assert html_region.main_text(page, weights) == html_region.main_text(page, html_region.Weights([])) == "Head line First words here. Last ones."


def test_anchors_within_the_content_are_text():
    weights = html_region.Weights([])
    page = (
        "<body><div id='social-links'>s</div><article><h2 id='related-work'>Related work</h2><p id='notice-period'>Four weeks.</p><p id='notice'>One more.</p>"
        "<section id='social-policy'><p>Of the state.</p></section><div class='share-price'>Ten.</div>"
        "<div class='related-posts'>a</div><div id='share'>b</div><section class='x comments-2'>c</section><p class='ad'>d</p><ul class='social_links'><li>e</ul><div hidden>f</div></article></body>"
    )
    assert html_region.main_text(page, weights) == "Related work Four weeks. One more. Of the state. Ten."


def test_headings_and_capital_ends_are_read():
    weights = html_region.Weights([])
    assert html_region.main_text("<body><h1>Title</h1><p>long text here now</p></body>", weights) == "Title long text here now"
    page = "<p>\u0130stanbul first</p><SCRIPT>x</SCRIPT><p>second paragraph</p>"
    assert html_region.main_text(page, weights) == "\u0130stanbul first second paragraph"


def test_adverts_of_a_learned_class_go_within_the_content():
    learned = "<div class=taboola>ten words of an advert that nobody wants to read</div><article><p>text</p><div class=figure>b</div></article><div class=figure>b</div>"
    counts = html_region.Counter()
    for _ in range(500):
        html_region.count_page(learned, counts)
    page = "<article><p>First.</p><div class=taboola>Buy</div><div class=figure>Second.</div><p>Third.</p></article>"
    html_region.count_page(page, counts)
    weights = html_region.Weights([(*k, n) for k, n in counts.items()])
    assert html_region.main_text(page, weights) == "First. Second. Third."


def counted_plainly(page):
    """The counts of a page by walking up from each token."""
    counts, found = html_region.Counter(), list(html_region.placed(page))
    up = lambda x: [] if x is None else [x, *up(x.around)]
    marked = lambda x: any(html_region.name_of(e.kind) in html_region.CONTENT for e in up(x))
    if any(marked(x) for _, _, x in found):
        for what, value, x in found:
            if what != "text":
                counts[x.kind if x else value, "tag", marked(x.around if x else None)] += 1
            elif value.split():
                for kind in {e.kind for e in up(x)}:
                    counts[kind, "word", marked(x)] += len(value.split())
    return counts


def test_counts_of_pages_equal_walking_up(spark):
    pages = [r[0] for r in spark.read.parquet(f"{SMALL}/pages.parquet").select("html").limit(40).collect()]
    odd = ["", "a", "<div><div>a b<p>c<div>d</div></div><article>e<div>f</div><p>g<p>h</article></span>i</div>j<br>k", "</p><main><li>a<li>b<li><ul><li>c</main>"]
    for page in [*pages, *odd]:
        counts = html_region.Counter()
        html_region.count_page(page, counts)
        assert counts == counted_plainly(page)


def test_deep_and_long_pages():
    weights = html_region.Weights([])
    n = 100_000
    for tag in ("div", "b", "p", "ul><li"):
        page = f"<article>{f'<{tag}>' * n}fifty words {'</div>' * n}</article><nav>out</nav>"
        assert html_region.main_text(page, weights) == "fifty words"
        counts = html_region.Counter()
        html_region.count_page(page, counts)
        assert counts["article", "word", True] == 2
    long = "<nav>menu</nav><article>" + "<p>one two</p>" * n + "</article>"
    assert html_region.main_text(long, weights) == " ".join(["one two"] * n)


def test_pages_without_an_article_and_clashing_names(spark):
    rows = [(i, "<html><body><nav><a href=x>home</a></nav><h1>Head</h1><p>some words of text here</p><footer>f</footer></body></html>", "kept") for i in range(6)]
    rows += [(0, rows[0][1], "kept"), (9, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string").withColumn("text_kept", F.lit(1))
    found = html_region.extract(pages, html_region.fit(pages), ["page_id", "text", "text_kept"])
    assert found.columns == ["page_id", "text_kept_kept", "text_kept", "text"]
    assert sorted(tuple(r)[::3] for r in found.collect()) == sorted([*[(i, "Head some words of text here") for i in (0, 0, 1, 2, 3, 4, 5)], (9, "")])


def test_pages_of_nothing(spark):
    pages = spark.createDataFrame([], "page_id long, html string, text string")
    assert html_region.extract(pages, html_region.fit(pages), ["page_id"]).collect() == []


# --- operator 3


def test_languages_of_held_out_texts(spark):
    found = QUERIES["op3_language_id"](spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id"
    ).where("held_out and lang is not null").collect()
    assert len(found) > 100
    assert sum(r["lang"] == r["lang_pred"] for r in found) / len(found) > 0.98


def test_language_edge_cases(spark):
    rows = [(i, t, x) for i, (t, x) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 20)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(train)
    odd = [(1, None), (2, ""), (3, "123 !?"), (4, "THE dog"), (5, "hundekatze"), (6, "漢字"), (7, "the " * 50_000)]
    found = {r["doc_id"]: r for r in language.predict(spark.createDataFrame(odd, DOCS), model, ["doc_id"]).collect()}
    assert [found[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3
    assert (found[4]["lang_pred"], found[5]["lang_pred"], found[7]["lang_pred"]) == ("en", "de", "en")
    assert found[6]["lang_pred"] in ("de", "en") and 0.4 < found[6]["score"] < 0.6
    empty = language.fit(train.limit(0))
    assert [tuple(r) for r in language.predict(spark.createDataFrame([(1, "the")], DOCS), empty, ["doc_id"]).collect()] == [(1, "und", 0.0)]
    assert language.predict(spark.createDataFrame([], DOCS), model, ["doc_id"]).collect() == []


def test_unseen_words_back_off_to_shorter_grams():
    import numpy as np

    model = language.LanguageModel(["a", "b"], {"known": 0}, {"^ab": 1, "c": 2}, np.array([[-1.0, -2], [-3, -4], [-5, -6]]))
    scorer = language.Scorer(model)
    assert scorer.backoff("abc").tolist() == [-8, -10]
    assert scorer.predict(["known", "zzz"])[0] == ["a", "a"]


# --- operator 4


def test_quality_of_held_out_texts(spark):
    folder = "/root/testdata/sf0.01"
    found = QUERIES["op4_quality"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in found) / len(found) > 0.93


def test_messages_equal_enumeration():
    import itertools

    import numpy as np

    drawn = np.random.default_rng(1)
    scores, pairs = drawn.normal(size=(1, 5)), drawn.normal(size=(2, 2))
    weight = np.zeros((5, 2))
    for labels in itertools.product((0, 1), repeat=5):
        total = sum(scores[0, t] for t in range(5) if labels[t]) + sum(pairs[a, b] for a, b in zip(labels, labels[1:]))
        for t in range(5):
            weight[t, labels[t]] += np.exp(total)
    forward, back = quality.messages(scores, np.ones((1, 5), bool), pairs)
    assert quality._good(forward + back)[0] == pytest.approx(weight[:, 1] / weight.sum(1))


def test_what_makes_a_long_document_bad_is_learned_wherever_it_stands(spark):
    clean, junk = "The river runs past the old town.\n", "$$ ## 12 %% $$ @@\n"
    rows = [(i, clean * 60 + (junk * 200 if i % 2 else "")) for i in range(40)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i, _ in rows], "doc_id long, quality int")
    field = quality.fit(spark.createDataFrame(rows, DOCS), labels)
    found = quality.score(spark.createDataFrame([(1, clean * 9), (2, junk * 9)], DOCS), field, ["doc_id"])
    scores = {r["doc_id"]: r["score"] for r in found.collect()}
    assert scores[1] > 0.5 and scores[2] < 0.1


def test_quality_edge_cases(spark):
    field = quality.fit(spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int"))
    odd = [(1, None), (2, ""), (3, " \n "), (4, "some words"), (5, "a\n" * 3000), (6, "\x00 \x1c"), (6, "\x00 \x1c")]
    found = sorted(tuple(r) for r in quality.score(spark.createDataFrame(odd, DOCS), field, ["doc_id"]).collect())
    assert found == [(1, 0.0), (2, 0.0), (3, 0.0), (4, 0.5), (5, 0.5), (6, 0.5), (6, 0.5)]
    lines = quality.labelled_lines(spark.createDataFrame([(1, "a\n\nbc")], DOCS), field, ["doc_id"]).first()["lines"]
    assert [(x["line"], x["n_chars"]) for x in lines] == [(0, 1), (1, 2)]


# --- operator 5


def leak_rows():
    items = [(1, " ".join(f"q{i}" for i in range(14))), (2, "short one here"), (3, None), (4, "!!"), (21, "Short, ONE here"), (None, "x y z")]
    long = " ".join(f"q{i}" for i in range(14))
    docs = [
        (1, f"intro {long.upper()} outro"), (2, " ".join(long.split()[:9])), (3, "a short-one; here b short one here"), (4, None), (5, ""),
        (6, " ".join(long.split()[:10]) + " x " + " ".join(long.split()[4:])), (7, "clean words only " * 30), (7, "clean words only " * 30), (8, "x y z"),
    ]
    return items, docs


@pytest.mark.parametrize("bound", [decontaminate.BENCHMARK_BYTES, -1])
def test_hits_equal_brute_force_by_broadcast_and_by_join(spark, bound):
    items, rows = leak_rows()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_hits(spark.createDataFrame(rows, DOCS), benchmark, ["doc_id"], max_bytes=bound).collect()
    assert len(found) == len(rows)
    for r in found:
        n, places, ids = brute.hits(dict(rows)[r["doc_id"]], [x for x in items if x[0] is not None])
        got = [k for s in r["spans"] for k in range(s["start"], s["end"])]
        assert (r["n_words"], got, r["items"]) == (n, places, ids), r["doc_id"]


def test_removal_of_documents_and_of_spans(spark):
    items, rows = leak_rows()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(rows, DOCS).withColumn("spans", F.lit(1)).withColumn("n_chars", F.lit(0).cast("long"))
    whole = decontaminate.decontaminated(docs, benchmark)
    assert whole.columns == docs.columns
    assert sorted(r["doc_id"] for r in whole.collect()) == [2, 4, 5, 7, 7, 8]
    cut = {r["doc_id"]: r for r in decontaminate.decontaminated(docs, benchmark, remove="spans").collect()}
    assert cut[1]["text"] == "intro  outro" and cut[1]["n_chars"] == 12
    assert cut[3]["text"] == "a  b " and cut[7]["text"] == "clean words only " * 30 and cut[4]["text"] is None
    nothing = decontaminate.find_hits(docs, benchmark.limit(0), ["doc_id"]).collect()
    assert all(r["spans"] == [] for r in nothing) and len(nothing) == len(rows)
    assert decontaminate.find_hits(docs.limit(0), benchmark, ["doc_id"]).collect() == []


# --- operator 6

ODD_TEXTS = [
    "a\tb  c\xa0d", " x", "▁x", "x ", "  ", "", None, "   a   b   ", "▁▁ ▁", "\x00", "a\x00 b", "\n \n", "é 漢字 😀", "<0x0A>",
    "<s> hi </s>", "<unk> a", "a  ", "x" * 5000 + " " * 9 + "y", "same same same",
]


def test_pieces_equal_the_library(spark, texts):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = list(enumerate(ODD_TEXTS)) + [(i + 1000, t) for i, t in texts.items()]
    model = pieces.model_bytes(path)
    encoded = pieces.encode(spark.createDataFrame(rows, DOCS), model, ["doc_id"])
    back = {r["doc_id"]: r["decoded"] for r in pieces.decode(encoded.drop("decoded"), model, ["doc_id"]).collect()}
    for r in encoded.collect():
        ids = library.encode(dict(rows)[r["doc_id"]] or "")
        assert r["ids"] == ids and r["decoded"] == back[r["doc_id"]] == library.decode(ids)
    digest = {r["doc_id"]: r for r in pieces.digests(encoded).collect()}
    assert digest[0]["ids_sha256"] == brute.sha(",".join(map(str, library.encode(ODD_TEXTS[0]))))
    assert pieces.encode(spark.createDataFrame([], DOCS), model, ["doc_id"]).collect() == []


def test_a_full_table_gives_the_same(monkeypatch):
    monkeypatch.setattr(pieces, "TABLE_CHUNKS", 5)
    table = pieces.ChunkTable(pieces.model_bytes(tokenizer_path("piece_bpe_32k.model")))
    for text in ODD_TEXTS + [made_up(5, 1000, 100)]:
        ids, decoded = table.encode([text or ""])
        assert list(memoryview(ids[0]).cast("i")) == table.processor.encode(text or "")
        assert decoded[0] == table.processor.decode(table.processor.encode(text or ""))


# --- operator 10


def licence_rows():
    sentence = "This work is licensed under the GNU General Public License, version 3."
    return [
        (1, "The MIT License and the mit-license; MIT LICENSE."), (2, sentence + " " + "word " * 40 + sentence), (3, None), (4, ""), (5, "mit"),
        (6, "Licensed under the Apache Public License, version 2.0"), (7, "apache license mit license general public license"),
        (8, "general public"), (9, "all rights reserved " * 3), (9, "all rights reserved " * 3), (10, "é mit license É"), (11, "w " * 20_000 + "mit license"),
        (12, "licensed under the very own apache license version 2 0"), (13, "public license general"),
    ]


@pytest.mark.parametrize("text, label, score", [
    ("all rights x all rights", "", 2 / 3), ("all rights " * 3000, "", 2 / 3), ("rights reserved all rights", "all-rights-reserved", 1.0),
    ("all rights reserved " * 3000, "all-rights-reserved", 1.0), ("licensed under cc by nc 4 0 licensed under cc", "cc-by-nc-4.0", 1.0),
    ("licensed under cc by xx 4 0", "", 6 / 7), ("licensed under cc by sa 4 0 and licensed under cc by nc 4 0", "cc-by-nc-4.0,cc-by-sa-4.0", 1.0),
    ("under cc by nc under cc by nc", "", 4 / 7), ("rights", "", 0.0),
])
def test_a_template_word_counts_once(spark, text, label, score):
    found = licences.scan(spark.createDataFrame([(1, text)], DOCS), ["doc_id"]).first()
    assert (found["labels"], found["n_base"]) == (label, 0) and abs(found["score"] - score) < 1e-12


def test_licences_equal_brute_force(spark, texts):
    rows = licence_rows() + [(i + 1000, t) for i, t in texts.items()]
    found = licences.scan(spark.createDataFrame(rows, DOCS).withColumn("label", F.lit(1)), ["doc_id", "label"]).collect()
    assert len(found) == len(rows)
    labels = {r["doc_id"]: r["labels"] for r in found}
    for r in found:
        n, places = brute.phrase_places(dict(rows)[r["doc_id"]], licences.PHRASES)
        starts = [i for i, _ in places]
        wanted = (n, len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == wanted, r["doc_id"]
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) | {""}
        assert 0 <= r["score"] <= 1
    assert labels[2] == "gpl,gpl-3.0" and labels[9] == "all-rights-reserved" and labels[6] == "apache-2.0"
    assert labels[12] == "apache,apache-2.0" and labels[3] == labels[8] == labels[11 - 6] == ""
    assert licences.scan(spark.createDataFrame([], DOCS), ["doc_id"]).collect() == []
