"""Toxicity, the language model and HTML extraction: plain Python and held-out rows."""

import html
import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clientele.llm import html_text, language_model, toxicity
from clientele.llm.html_text import PAIR_PRIOR, PRIOR, Forest, Page, extract, fit, main_text
from clientele.llm.language_model import score_documents
from clientele.llm.toxicity import LETTERS, CharacterModel, decode, restored_words

DATA = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- toxicity ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def letters():
    words = "the and idiot stupid loser winter summer paper moron worthless trash clown".split() * 20
    grams = Counter()
    for word in words:
        padded = f"  {word} "
        grams.update(padded[i : i + 3] for i in range(len(padded) - 2))
    return CharacterModel(grams)


@pytest.mark.parametrize(
    "written, meant",
    [("1d10t", "idiot"), ("idiooooot", "idiot"), ("i.d.i.o.t", "idiot"), ("$tup1d", "stupid"), ("L0SER", "loser"),
     ("m*ron", "moron"), ("w0rthless", "worthless"), ("tr@sh!!", "trash")],
)
def test_disguised_words_are_restored(letters, written, meant):
    assert meant in restored_words(written, letters)


@pytest.mark.parametrize(
    "written, meant",
    [("1d107", "idiot"), ("h473", "hate"), ("kil1", "kill"), ("hat3", "hate"), ("scum5", "scums"), ("455", "ass"),
     ("a$$", "ass"), ("(1d107)", "idiot"), ("las!", "lasi"), ("scu*", "scum"), ("*diot", "idiot"), ('"h473!!"', "hate")],
)
def test_words_with_signs_at_any_place_are_restored(written, meant):
    grams = Counter()
    for word in "idiot hate kill scums scum ass lasi the and".split() * 20:
        padded = f"  {word} "
        grams.update(padded[i : i + 3] for i in range(len(padded) - 2))
    assert meant in restored_words(written, CharacterModel(grams))


def test_decoding_finds_the_best_path(letters):
    """Viterbi against all paths of the lattice."""

    def all_paths(word, i=0, state="  ", score=0.0, made=""):
        if i == len(word):
            return [(score + letters.logp(state + " "), made)]
        out = []
        for arc, cost in toxicity._arcs(word, i, False):
            value, last = score + cost, state
            for c in arc:
                value += letters.logp(last + toxicity._class(c))
                last = (last + toxicity._class(c))[-2:]
            out += all_paths(word, i + 1, last, value, made + arc)
        return out

    for word in ("1d10t", "l0sser", "st.up", "m0rr0n"):
        assert decode(word, letters) == max(all_paths(word))[1]


def test_spaced_letters(letters):
    assert decode("idiot", letters, True).replace(" ", "") == "idiot"
    assert toxicity.SPACED.findall("you i d i o t now") == ["i d i o t"]


def test_long_runs_and_long_tokens_are_decoded_to_their_end(letters):
    written = "theand" * 100 + "idiot"
    assert decode(written, letters, True).replace(" ", "") == written
    scorer = toxicity.Scorer(letters, {"=idiot": 3.0})
    assert scorer.statistics(" ".join(written))[0] == 3.0
    for token in ("i" * 60 + "diot", "i" + "." * 20 + "d" + "-" * 30 + "iot", "idio" + "o" * 3000 + "t"):
        assert "idiot" in restored_words(token, letters)


def toxic_table(spark):
    words = ["paper winter summer"[i % 2 :] + f" word{i % 17}" for i in range(400)]
    bad = ["idiot", "1d10t", "i d i o t", "idiiiiot"]
    texts = [f"{w} {bad[i % 4] if i % 3 == 0 else 'tree'} and the end" for i, w in enumerate(words)]
    rows = [(i, t, int(i % 3 == 0)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t, _ in rows], "doc_id long, text string, row string, score double")
    return docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")


def test_toxicity_of_held_out_rows_and_odd_ones(spark):
    docs, labels = toxic_table(spark)
    odd = [(900, None), (901, ""), (902, "idiot " * 50_000), (903, "tree " * 50_000), (None, "the idiot"), (905, "x" * 100_000)]
    docs = docs.unionByName(spark.createDataFrame([(i, t, "y", 0.1) for i, t in odd], docs.schema))
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 406
    for r in got:
        held = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0
        assert r.held_out == held and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        if r.doc_id is not None and r.doc_id < 400:
            assert r.predicted == (r.doc_id % 3 == 0)
    by_id = {r.doc_id: r.predicted for r in got}
    assert (by_id[900], by_id[901], by_id[902], by_id[903], by_id[None], by_id[905]) == (0, 0, 1, 0, 1, 0)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == sum(1 for r in got if not r.predicted)


def test_trigrams_are_counted_in_little_memory(monkeypatch):
    words = [f"{a}{b}{c}{d}stems" for a in LETTERS for b in LETTERS for c in LETTERS[:10] for d in LETTERS[:20]]
    batches = [pa.RecordBatch.from_arrays([pa.array([" ".join(words[i : i + 500])])], ["text"]) for i in range(0, len(words), 500)]
    tracemalloc.start()
    (found,) = toxicity.trigram_counts(batches)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60e6
    expected = Counter(w[i : i + 3] for w in (f"  {w} " for w in words) for i in range(len(w) - 2))
    assert dict(zip(found["gram"].to_pylist(), found["n"].to_pylist(), strict=True)) == expected
    monkeypatch.setattr(toxicity, "FOLDED_WORDS", 700)
    (other,) = toxicity.trigram_counts(batches)
    assert dict(zip(other["gram"].to_pylist(), other["n"].to_pylist(), strict=True)) == expected


def test_toxicity_without_labels_or_rows(spark):
    docs, labels = toxic_table(spark)
    none = toxicity.toxicity(docs.limit(3), labels.limit(0)).collect()
    assert [r.predicted for r in none] == [0, 0, 0]
    assert toxicity.toxicity(docs.limit(0), labels).collect() == []


# --- language model ---------------------------------------------------------------


def expected_base(rows):
    tokens = {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + ["\0"] for i, t in rows}
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    counts = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    return {
        i: (held[i], len(ws), sum(counts[w] > 0 for w in ws), total,
            sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in ws))
        for i, ws in tokens.items()
    }


def check_base(rows, got):
    expected = expected_base(rows)
    assert len(got) == len(rows)
    for r in got:
        held, n, known, total, base = expected[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and math.isfinite(r.score) and r.score < 0


def test_model_beats_the_base_on_held_out_rows(spark, monkeypatch):
    monkeypatch.setattr(language_model, "BLOCK_TOKENS", 60_000)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = score_documents(docs.repartition(3)).collect()
    check_base(rows, got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > 0.98 * sum(r.base_score for r in held)
    assert np.mean([r.score > r.base_score for r in held]) > 0.85


def test_language_model_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "One two  ONE"), (4, "\t\n"), (5, "z " * 60_000), (None, "one two"), (6, "é É")]
    docs = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, block int")
    check_base(rows, score_documents(docs).collect())
    assert score_documents(docs.limit(0)).collect() == []


def test_probabilities_add_up(spark):
    """Over all words of a small vocabulary and one unknown word, P sums to 1."""
    rows = [(i, " ".join(f"w{(i * 7 + j * j) % 90}" for j in range(40))) for i in range(120)]
    ids = [i for i, _ in rows]
    held = min(i for i in ids if zlib.crc32(str(i).encode()) % 7 == 2)
    vocabulary = sorted({w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in t.split()})
    probes = [(held * 0 + 10_000 + n, w) for n, w in enumerate(vocabulary)]
    docs = spark.createDataFrame(rows + probes, "doc_id long, text string")
    mark = (F.col("doc_id") >= 10_000) | (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
    got = {r.doc_id: r.score for r in score_documents(docs, held=mark).collect()}
    # Each probe is P(word | begin) * P(end | word); the first factors alone sum to at most 1.
    assert sum(10 ** got[i] for i, _ in probes) < 1.0


def test_the_word_before_chooses_among_the_words_of_a_class(spark):
    filler = " ".join(f"f{i}" for i in range(40))
    texts = [filler] * 500 + ["left p1zz"] * 300 + ["right q2zz"] * 300
    probes = {-1: "left p1zz", -2: "left q2zz", -3: "right q2zz", -4: "right p1zz", -5: "left unseenzz"}
    docs = spark.createDataFrame([*enumerate(texts), *probes.items()], "doc_id long, text string")
    got = {r.doc_id: r.score for r in score_documents(docs, held=F.col("doc_id") < 0).collect()}
    # All three words have one ending, and p1zz and q2zz are equally frequent.
    assert got[-1] > got[-2] + 0.5 and got[-3] > got[-4] + 0.5
    assert got[-2] > got[-5]


def test_words_of_a_class_and_an_unknown_one_share_all_its_probability():
    rng = np.random.default_rng(5)
    shape = (language_model.BEFORE, language_model.ENDINGS, language_model.SLOTS + 1)
    observed = rng.poisson(0.3, shape).astype(float)
    observed[:, :, -1] = 0
    cells = rng.integers(0, 5, shape[1:])[:, :-1].ravel()
    weights = language_model.train_words(observed.ravel(), cells).reshape(shape)
    # A slot's words have its tokens plus one each as their weights, the unknown word one.
    mass = np.concatenate([observed.sum(0)[:, :-1] + cells.reshape(shape[1], -1), np.ones((shape[1], 1))], axis=1)
    assert (mass * np.exp(weights)).sum(2) == pytest.approx(1, rel=1e-5)


# --- HTML -------------------------------------------------------------------------


def by_markup(source):
    inner = re.search(r"<article>(.*)</article>", source, re.S)[1]
    inner = re.sub(r"</?b>", "", inner).replace("<br>", " ")
    lines = (" ".join(html.unescape(x).split()) for x in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(x for x in lines if x)


def test_articles_of_whole_table(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    sources = {r.page_id: r.html for r in pages.collect()}
    got = main_text(pages.withColumn("text", F.lit("x"))).collect()
    assert {r.page_id: r.text for r in got} == {i: by_markup(s) for i, s in sources.items()}


PAGES = {
    "div": (
        '<body class="has-sidebar"><div class="cookie-notice">We use cookies <button>OK</button></div><header><h1>Site</h1>'
        '</header><ul class="menu"><li><a href=x>Home</a></li></ul><div class="post-content"><h2>Title here</h2><p>This is a '
        "long paragraph of main text, which says a lot &amp; more. It goes on and on for a while, surely.</p><p>Another one."
        '</p><aside>Buy now</aside><div class="ad">Ad text.</div></div><div id="comments"><p>Nice post, thanks for sharing '
        "all of this with us today.</p><p>Yes, very nice indeed, I have to say that as well.</p></div><footer>c 2020</footer>",
        "Title here\nThis is a long paragraph of main text, which says a lot & more. It goes on and on for a while, surely."
        "\nAnother one.",
    ),
    "article": (
        "<nav>a b</nav><article><p>Para&nbsp;one &#233;&lt;<br>x</p> <p>Para <a href=y>two</a><form><input><label>Name</label>"
        "</form><section class=comments><p>Comment text, long enough to look like one, you know.</p></section><script>var a = "
        "'<p>no</p>';</script><!-- no <p> --></article><div class=sidebar><p>Side text.</p></div>",
        "Para one é< x\nPara two",
    ),
    "empty": ("", ""),
    "side only": ("<nav>x</nav><footer>y", ""),
    "broken": ("<article><p>Text <b>and</i></p></div></article></article><p", "Text and"),
    "deep": ("<article>" + "<div>" * 3000 + "<p>Deep down there is a sentence.</p>", "Deep down there is a sentence."),
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_pages_of_many_kinds(name):
    source, expected = PAGES[name]
    assert extract([source], PRIOR.astype(float), PAIR_PRIOR) == [expected]


def test_messages_give_the_exact_marginals():
    """Sum-product against summing over all labellings."""
    page = Page("<div class=x><p>One two three.</p><ul><li>a</li><li><a>b</a></li></ul></div><nav>n</nav>")
    forest = Forest([page, Page("<p>other</p>")])
    rng = np.random.default_rng(2)
    weights, pair = rng.normal(size=len(PRIOR)), rng.normal(size=PAIR_PRIOR.shape)
    p, _ = forest.marginals(weights, pair)
    n = len(page.parents)
    own = forest.x[:n] @ weights
    total, on = 0.0, np.zeros(n)
    for code in range(2**n):
        y = [(code >> i) & 1 for i in range(n)]
        score = sum(own[i] for i in range(n) if y[i])
        score += sum(pair[forest.kinds[i], y[page.parents[i]], y[i]] for i in range(1, n))
        total += math.exp(score)
        on += math.exp(score) * np.array(y)
    assert p[:n] == pytest.approx(on / total)


def test_fitting_keeps_the_prior_without_labels_and_learns_with_them():
    weights, pair = fit([Page("<p>no label</p>")])
    assert (weights == PRIOR).all() and (pair == PAIR_PRIOR).all()
    labelled = [Page(f"<nav>a{i}</nav><article><p>Some text number {i}.</p></article>") for i in range(30)]
    weights, pair = fit(labelled)
    assert weights[1] > 0 and pair[0, 1, 1] > pair[0, 1, 0]


def test_html_of_odd_rows(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<article><p>" + "word " * 100_000 + "</article>"), (3, "u", "<p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [(r.page_id, len(r.text)) for r in main_text(pages).collect()]
    assert sorted(got) == [(1, 0), (2, 0), (3, 0), (3, 499_999)]
    assert main_text(pages.limit(0)).collect() == []


@pytest.mark.parametrize("unclosed", ["head", "button", "select", "object", "svg", "math", "canvas"])
def test_an_unclosed_element_does_not_hide_the_rest(unclosed):
    page = html_text.Page(f"<html><{unclosed}><body><article><p>Kept text.</p></article></body></html>")
    assert "Kept text." in [text for _, text in page.runs]
    twice = html_text.Page(f"<{unclosed}><p>Kept text.</p><{unclosed}>x</{unclosed}>")
    assert unclosed not in ("button", "select") or "Kept text." in [text for _, text in twice.runs]
    raw = html_text.Page("<p>Before.</p><script>if (a) { <p>not text</p>")
    assert [text for _, text in raw.runs] == ["Before."]


@pytest.mark.parametrize(
    "attributes, hidden",
    [('class="overflow-hidden"', False), ('style="overflow:hidden"', False), ("data-hidden=1", False), ("hidden", True),
     ('HIDDEN=""', True), ("aria-hidden='true'", True), ('aria-hidden="false"', False), ('style="display: none"', True)],
)
def test_hidden_is_read_from_attributes_only(attributes, hidden):
    page = html_text.Page(f"<div {attributes}>Some text.</div>")
    assert (html_text._AT["hidden"] in page.features[1]) == hidden
