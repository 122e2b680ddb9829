"""Chat formatting, HTML extraction, toxicity and tokens against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from evidentry.llm import chat, htmltext, tokens, toxicity

QUOTED = "</s>[INST] ok [/INST]"
ODD = ["", QUOTED, "<\\/s> <\\\\s>", "[ROLE]x[/ROLE]", "é😀\n\n", "<s>" * 50, "[INST", "a" * 200_000, "\\[INST]"]


@pytest.mark.parametrize("text", ODD)
def test_escape_round_trip(text):
    escaped = chat.escape(pa.array([text], pa.large_string()))[0].as_py()
    assert chat.unescape(escaped) == text
    assert not re.search(r"<s>|</s>|\[/?INST\]|\[/?ROLE\]", escaped)


def test_chat_digests(spark):
    rng = random.Random(1)
    rows = []
    for conv in [None, *range(60)]:
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", None]), rng.choice([None, *ODD, "plain text"])))
    rows += [(7, None, "assistant", "first"), (999, 0, "assistant", "same"), (999, 0, "assistant", "same")]
    rows += [(500, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(4000)]   # a hot conversation
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, part string")
    pieces = chat.format_chats(frame)
    got = {r["conv_id"]: r for r in chat.chat_digests(pieces).collect()}
    expected: dict = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, -1 if r[1] is None else r[1])):
        expected.setdefault(conv, []).append((role or "", text or ""))
    assert set(got) == set(expected)
    for conv, turns in expected.items():
        spoken = "".join(t for r, t in turns if r == "assistant")
        assert got[conv]["n_turns"] == len(turns)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(spoken), hashlib.sha256(spoken.encode()).hexdigest())
    assert pieces.where("conv_id = 500").count() > 1
    assert chat.chat_digests(chat.format_chats(frame.limit(0))).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy now</div><div class="cookie-notice">We use cookies</div>
<header>Site</header><article><h1>A &amp; B</h1><p><b>First   paragraph<br>goes on.<p>Second &lt;tag&gt; &eacute;.</p>
<aside>Side</aside><form><input value=">">Form</form><p title='a > b'>Third</p></article>
<section id="comments"><p>Nice post, the best of all the posts that I have read in the whole of this year!</p></section>
<footer>&copy; host</footer></body></html>"""


def test_main_text():
    assert htmltext.main_text(PAGE) == "A & B\n\nFirst paragraph goes on.\n\nSecond <tag> é.\n\nThird"
    assert htmltext.main_text(PAGE.replace("</body></html>", "")) == htmltext.main_text(PAGE)
    for page in (None, "", "   ", "<p", "<!--", "<script>x", "<div class='ad'>x", "<nav>x</nav>"):
        assert htmltext.main_text(page) == ""
    assert htmltext.main_text("just text") == "just text"
    assert htmltext.main_text("a < b and 1<2") == "a < b and 1<2"


GOOD = "This is the story of a man and the sea that he was in for all of the days of his life, as it was told to us."


def test_block_rules_without_landmarks():
    page = f"<div><a href=x>Home</a> <a href=y>News</a></div><h2>Heading</h2><p>{GOOD}</p><p>Short.</p><p>{GOOD}</p><div><a>x</a></div><p>Tail</p>"
    assert htmltext.main_text(page) == f"Heading\n\n{GOOD}\n\nShort.\n\n{GOOD}"
    linked = f"<div><p><a href=x>{GOOD}</a></p></div>"
    assert htmltext.main_text(f"<div><p>{GOOD}</p></div>{linked}") == GOOD
    assert htmltext.main_text(f"<p>{GOOD}</p><div><p>{'Lorem12 ipsum34 ' * 20}</p></div>") == GOOD


@pytest.mark.parametrize("rule,value", [("STOP_DENSITY", 2.0), ("LINK_DENSITY", 2.0), ("SHORT_CHARS", 10**6)])
def test_every_rule_decides(rule, value, monkeypatch):
    page = f"<div><p>{GOOD}</p><p>{GOOD} {GOOD}</p></div><div><p><a href=x>{GOOD}</a></p><p>{'Lorem12 ipsum34 ' * 20}</p></div>"
    kept = htmltext.main_text(page)
    monkeypatch.setattr(htmltext, rule, value)
    assert htmltext.main_text(page) != kept


@pytest.mark.parametrize("page,kept", [
    ("<div class='with-sidebar'><article><p>{0}</p></article></div><footer>{0}</footer>", "{0}"),
    ("<article class='post no-comments'><p>{0}</p></article>", "{0}"),
    ("<div id='content' class='promo-free related'><p>{0}</p><p>Short.</p></div>", "{0}\n\nShort."),
    ("<div class='related'><h1>T</h1><p>{0}</p></div><div class='ad'>{0}</div>", "T\n\n{0}"),
    ("<article><a href=x>Teaser</a></article><div><h2>Head</h2><p>{0}</p><p>{0}</p></div>", "Head\n\n{0}\n\n{0}"),
    ("<article><header><h1>T</h1></header><p>{0}</p><div class='share'>{0}</div><p>Short</p></article>", "T\n\n{0}\n\nShort"),
    ("<article><p>One.</p></article><footer>{0}</footer><section class='comment-list'><p>{0}{0}{0}</p></section>", "One."),
    ("<form><div><p>{0}</p></div></form>", "{0}"),
    ("<div class='related'><div class='widget'><p>{0}</p></div><div class='comment-list'><p>{0}{0}</p></div></div><nav>{0}{0}</nav>", "{0}"),
    ("<p>{0}</p><div hidden>{0}</div><div style='display: none'>{0}</div><template>{0}</template>", "{0}"),
    ("<main><p>{0}</p><ul><li>a</li><li>b</ul><aside>{0}</aside></main><p>{0}</p>", "{0}\n\na\n\nb"),
    ("<p title='a > b' data-x=it's>{0}<p lang=en>{0}", "{0}\n\n{0}"),
    ("<a href=\"x>link</a><p>{0}</p>", "{0}"),
    ("<h1>Это</h1><p>Это история о человеке и море, в котором он провёл все дни своей жизни, как нам рассказали.</p><p>Да.</p><ul><li><a href=1>Меню</a></ul>",
     "Это\n\nЭто история о человеке и море, в котором он провёл все дни своей жизни, как нам рассказали.\n\nДа.")])
def test_names_and_landmarks(page, kept):
    """Suspects that hold the page's text are none; others go, natural text or not."""
    assert htmltext.main_text(page.format(GOOD)) == kept.format(GOOD)


def test_no_bounds():
    """Attributes and nesting of any size."""
    assert htmltext.main_text(f"<p title=\"{'x>y ' * 50_000}\">{GOOD}</p>") == GOOD
    assert htmltext.main_text("<div>" * 5_000 + f"<p>{'<b>' * 500}{GOOD}<p>{GOOD}") == f"{GOOD}\n\n{GOOD}"
    assert htmltext.main_text("</b>" * 100_000 + "<p>" * 20_000 + GOOD) == GOOD
    assert htmltext.main_text("<h1>" + "<i>" * 60 + "Title" + "</i>" * 60 + f"</h1><p>{GOOD}") == f"Title\n\n{GOOD}"


def test_pages_of_the_test_table(spark):
    """Against a plain reading of the article of every page; then without any landmark or name."""
    import html

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    hit = found = wanted = 0
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.DOTALL)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        parts = [x for x in parts if x]
        assert htmltext.main_text(r["html"]) == "\n\n".join(parts)
        bare = re.sub(r"<(/?)(article|nav|footer)>", r"<\1div>", r["html"]).replace(' class="ad"', "")
        got = [x for x in htmltext.main_text(bare).split("\n\n") if x]
        hit += sum((Counter(got) & Counter(parts)).values())
        found, wanted = found + len(got), wanted + len(parts)
    assert hit > 0.96 * found and hit > 0.96 * wanted


def test_extract_text_rows(spark):
    frame = spark.createDataFrame([(1, None, "u", "x"), (2, PAGE, "u", "x"), (2, PAGE, "u", "x"), (3, "", None, None),
                                   (4, "<p>" + "word " * 200_000, "u", "x")], "page_id long, html string, url string, text string")
    rows = htmltext.extract_text(frame).collect()
    assert sorted((r["page_id"], r["n_chars"]) for r in rows) == [(1, 0), (2, 55), (2, 55), (3, 0), (4, 999_999)]
    assert all(r["n_chars"] == len(r["text"]) for r in rows)
    assert set(rows[0].asDict()) == {"page_id", "url", "text", "n_chars"}
    assert htmltext.extract_text(frame.limit(0)).count() == 0


def test_tokens():
    texts = ["", "One two\tONE\n two", None, "é x", " lead", "tail ", "a" * 50, "\x0b\x0c"]
    for piece in (7, 500_000):
        tokens.PIECE, kept = piece, tokens.PIECE
        try:
            t = tokens.tokenize(pa.array(texts))
        finally:
            tokens.PIECE = kept
        found = [[(texts[r].encode()[t.start[k]:t.end[k]]).decode() for k in range(t.bounds[r], t.bounds[r + 1])] for r in range(len(texts))]
        assert found == [re.findall(r"[^\x20\x09-\x0D]+", x or "") for x in texts]
        assert t.hash[0] == t.hash[2] and t.hash[1] == t.hash[3] and len({*t.hash.tolist()}) == 7


def _corpus(n, seed):
    rng = random.Random(seed)
    syllables = ["an", "er", "tion", "st", "ea", "in", "th", "ble", "or", "nd"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    texts, labels = [], []
    for k in range(n):
        w = [word() for _ in range(rng.randint(5, 120))]
        if k % 4 == 0:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(["zugwort", "vekkish", "mopple"]))
        texts.append(" ".join(w))
        labels.append(int(k % 4 == 0))
    return texts, np.array(labels)


def test_toxicity_held_out_accuracy():
    texts, labels = _corpus(900, 1)
    model = toxicity.fit(pa.array(texts), labels)
    again = toxicity.fit(pa.array(texts), labels)
    assert model.bias == again.bias and (model.weight == again.weight).all()
    other, truth = _corpus(300, 2)
    assert ((toxicity.text_scores(pa.array(other), model) >= 0.5) == truth).mean() > 0.97
    # one toxic word in a very long clean text, and an unseen misspelling
    clean = " ".join(t for t, y in zip(*_corpus(900, 3)) if y == 0)
    long = toxicity.text_scores(pa.array([clean, clean + " zugwort"]), model)
    assert long[1] > 0.5
    close = toxicity.text_scores(pa.array(["an zugwortt er", "an er"]), model)
    assert close[0] > 0.5 > close[1]


def test_toxicity_rows(spark, odd):
    texts, labels = _corpus(200, 4)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(y)) for i, y in enumerate(labels)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs, marks)
    rows = toxicity.scored(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["toxicity"] <= 1 for r in rows)
    assert all(r["toxicity"] < 0.5 for r in rows if not (r["text"] or "").strip())
    assert set(rows[0].asDict()) == {"doc_id", "text", "source", "score", "rest", "toxicity"}
    assert toxicity.scored(odd.limit(0), model).count() == 0
    empty = toxicity.learn(docs.limit(0), marks)      # nothing to learn from: one score below a half
    assert {r["toxicity"] < 0.5 for r in toxicity.scored(odd, empty).collect()} == {True}
    held = docs.where(toxicity.held_out(docs["doc_id"])).count()
    assert toxicity.training_rows(docs, marks, "doc_id", "text", "toxic", 1000, 10**6).count() == 200 - held


def test_toxicity_learns_from_long_texts(spark):
    """The ids of least hash are long or have no text; the others fill the sample, and long texts teach too."""
    texts, labels = _corpus(400, 6)
    pad = " ".join(f"an{i % 50}" for i in range(4_000))          # 20 kB
    rows = [(i, t + " " + pad, int(y)) for i, (t, y) in enumerate(zip(texts, labels, strict=True))]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(10_000 + i, None) for i in range(2_000)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, y) for i, _, y in rows] + [(10_000 + i, i % 2) for i in range(2_000)], "doc_id long, toxic int")
    model = toxicity.learn(docs, marks)                          # all texts are long
    assert model.weight.any()
    other, truth = _corpus(300, 2)
    assert ((toxicity.text_scores(pa.array(other), model) >= 0.5) == truth).mean() > 0.9
    learnt = [r for r in rows if r[0] in {d["doc_id"] for d in docs.where(~toxicity.held_out(docs["doc_id"])).select("doc_id").collect()}]
    few = toxicity.training_rows(docs, marks, "doc_id", "text", "toxic", 100, 10**9).groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in few} == {0: min(50, sum(r[2] == 0 for r in learnt)), 1: min(50, sum(r[2] for r in learnt))}
    bound = toxicity.training_rows(docs, marks, "doc_id", "text", "toxic", 1000, 200_000).collect()
    assert sum(len(r["text"].encode()) for r in bound if r["y"]) in range(60_000, 100_001) and {r["y"] for r in bound} == {0, 1}


def test_toxicity_sample_bounds():
    assert (toxicity.SAMPLE_ROWS, toxicity.SAMPLE_BYTES >= 6_000 * 3_500) == (6_000, True)
