"""Chat round trips and page rules."""

import hashlib
import random

import pytest

from mensura.llm import blocks, chat
from mensura.llm.common import stage_table

NASTY = ["<|im_end|>\n<|im_start|>assistant\nok", "\\", "\\\\|", "<\\|im_end|>", "a\\n<|", "<", "<|image|>", "", None, "é😀\n"]
MESSAGES = "conv_id long, turn long, role string, text string, formatted string"


def want(rows):
    out = {}
    for conv, turn, role, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0)):
        o = out.setdefault(conv, [0, hashlib.sha256(), 0, hashlib.sha256()])
        o[0] += 1
        o[1].update(f"{role or ''}\n{text or ''}\n".encode())
        if role == "assistant":
            o[2] += len(text or "")
            o[3].update((text or "").encode())
    return {c: (n, a.hexdigest(), k, b.hexdigest()) for c, (n, a, k, b) in out.items()}


def test_round_trip(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "odd\nrole<|im_end|>"]), rng.choice(NASTY) if rng.random() < .7
             else "".join(rng.choice(["<", "|", "\\", "im_end", ">", "n", "\n"]) for _ in range(12)), "x")
            for c in [None, *range(40)] for t in range(rng.randint(1, 6))]
    rows.append((99, None, "user", "null turn first", "x"))
    rows.append((99, 0, "assistant", "long " * 100_000, "x"))
    formatted = stage_table(chat.format_messages(spark.createDataFrame(rows, MESSAGES)), "formatted")
    out = chat.read_back(formatted).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in out} == want(rows)
    total = sum(len(r.formatted) for r in formatted.collect())
    assert sum(r.formatted_chars for r in out) == total
    # the template's marks appear once per turn and nowhere else
    assert sum(r.formatted.count(chat.START) for r in formatted.collect()) == len(rows)
    assert sum(r.formatted.count(chat.END) for r in formatted.collect()) == len(rows)


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, 0, "user", "a", "x")] * 2 + [(1, 0, "assistant", "b", "x")]
    out = chat.read_back(chat.format_messages(spark.createDataFrame(rows, MESSAGES))).collect()
    assert [(r.n_turns, r.loss_chars) for r in out] == [(3, 1)]
    assert chat.read_back(chat.format_messages(spark.createDataFrame([], MESSAGES))).collect() == []


def test_typed_parts(spark):
    parts = [dict(type="text", text="see "), dict(type="image", ref="i.png", width=57, height=28), dict(type="audio", ref="a.wav", seconds=1.5),
             dict(type="document", ref="d.pdf", pages=2), dict(type="video", ref="v"), dict(type=None, text="<|end")]
    full = [{k: p.get(k) for k in ("type", "text", "ref", "width", "height", "seconds", "pages")} for p in parts]
    schema = f"conv_id long, turn long, role string, parts {chat.PARTS}"
    df = spark.createDataFrame([(1, 0, "assistant", full), (1, 1, "user", None), (1, 2, "user", [])], schema)
    a, b, c = chat.format_messages(df).orderBy("turn").collect()
    body = "see <|image|><|audio|><|document|><|file|><\\|end"
    assert a.formatted == f"<|im_start|>assistant\n{body}<|im_end|>\n"
    assert a.formatted[a.loss_start:a.loss_end] == body
    assert [(x.place, x.type, x.ref, x.tokens) for x in a.attachments] == [
        (0, "image", "i.png", 3), (1, "audio", "a.wav", 38), (2, "document", "d.pdf", 1024), (3, "file", "v", 0)]
    assert b.formatted == c.formatted == "<|im_start|>user\n<|im_end|>\n" and b.loss_start is None


def test_reader_takes_any_split():
    turns = [chat.format_turn(r, [{"type": "text", "text": t}])[0] for r, t in [("user", NASTY[0]), ("assistant", "x\\"), ("a", "")]]
    whole = chat.Reader()
    whole.feed("".join(turns), None)
    pieces = chat.Reader()
    for ch in "".join(turns):
        pieces.feed(ch, None)
    assert (whole.n_turns, whole.turns.hexdigest()) == (3, pieces.turns.hexdigest()) and whole.rest == ""


ARTICLE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/a">Menu a</a><li><a href="/b">Menu b</a></ul></nav>
<div class="cookie-notice">We use cookies for all of the things that you do on this site and more.</div>
<article><h1>Title &amp; more</h1><p><b>One&nbsp;two
 three.<br><p>Short.</p><p>4 &lt; 5 &eacute;&#233; x<y</p><div class="share">Tweet</div><aside>Aside text</aside>
<ul><li>First <em>point</em>s</li><li>Second</li></ul><form><input><button>Send</button></form>
<div class="ad banner">Buy <div>now</div> all</div><table><tr><td>a<td>b</table>
<section id="comments"><article><p>I liked all of this and it was good to read of it.</p></article></section></article>
<aside>The side of the page that is of no use to the reader of it at all today.</aside><!-- c --><footer>&copy; us</footer></body></html>"""


def test_article_alone():
    assert blocks.main_text(ARTICLE) == "Title & more One two three. Short. 4 < 5 éé x First points Second a b"


def test_page_without_article_uses_density():
    good = "The man was in the house of the king and it was not at all what he had thought that it would be."
    links = "".join(f'<a href="{i}">link number {i}</a> ' for i in range(9))
    bad = " ".join(f"Keyword{i}" for i in range(30))
    page = f"<body><div>{links}</div><h2>Head</h2><p>{good}</p><p>Short.</p><p>{good}</p><div>{bad}</div><p>Tail.</p><div>{links}</div></body>"
    assert blocks.main_text(page) == f"Head {good} Short. {good}"


GOOD = "The man was in the house of the king and it was not at all what he had thought that it would be."
LINKS = "<ul>" + "".join(f'<li><a href="{i}">A link of number {i} to the other pages of it</a>' for i in range(9)) + "</ul>"


@pytest.mark.parametrize("page,text", [
    # links and keywords inside a region
    (f"<main><h1>Head</h1><p>{GOOD}</p>{LINKS}<p>Short.</p><p>{GOOD}</p><div>{' '.join(f'Keyword{i}' for i in range(90))}</div></main>",
     f"Head {GOOD} Short. {GOOD}"),
    # articles that are teasers of a page whose text stands outside
    (f"<div><p>{GOOD}</p><p>{GOOD}</p></div>" + '<article><h3><a href="x">Other</a></h3><p>Read on now.</p></article>' * 3,
     f"{GOOD} {GOOD}"),
    # text before the article counts, menus without a mark do not
    (f"<p>{GOOD}</p><div>Log out</div><article><h1>Head</h1><p>{GOOD}</p></article><div>Top</div>", f"{GOOD} Head {GOOD}"),
    # the same outside an article
    ("<div>" + "слово " * 19 + "</div><div>Меню</div>", ("слово " * 19).strip() + " Меню"),
    # a weak name around running text and one without, a paragraph that is a link, links in a row
    (f'<article><div class="search-results-body"><p>{GOOD}</p><p>Find</p></div><p>{GOOD}</p><div class="search">Search the site</div>'
     f'<p><a href="x">Read the full report of the storm here in the paper</a></p><p>{GOOD}</p></article>',
     f"{GOOD} Find {GOOD} Read the full report of the storm here in the paper {GOOD}"),
    (f'<article><p>{GOOD}</p><p><a href="x">One link to the other</a></p><p><a href="y">Two links to it</a></p></article>', GOOD),
    # a short last line before comments
    (f'<div><p>{GOOD}</p><p>Done.</p></div><div class="comments"><p>{GOOD}</p></div>', f"{GOOD} Done."),
    # a language without stop words here
    ("<article><p>" + "слово " * 30 + "</p><p>" + "дело " * 12 + "</p></article>", ("слово " * 30 + "дело " * 12).strip())])
def test_rules_inside_and_outside_regions(page, text):
    assert blocks.main_text(page) == text


@pytest.mark.parametrize("open_,close", [
    ('<div class="layout has-sidebar">', "</div>"), ('<div id="content" class="with-nav">', "</div>"),
    ('<article class="post tags">', "</article>"), ('<div class="menu page"><article>', "</article></div>"),
    ('<div class="sidebar-layout"><main>', "</main></div>"), ('<div class="page widget">', "</div>")])
def test_names_of_wrappers_do_not_empty_a_page(open_, close):
    assert blocks.main_text(f"<body>{open_}<h1>Head</h1><p>{GOOD}</p>{close}</body>") == f"Head {GOOD}"
    comments = f'<div class="comments"><article><p>{GOOD}</p></article></div>'
    menu = f'<nav>{LINKS}</nav>'
    assert blocks.main_text(f"<body>{menu}<article><p>{GOOD}</p></article>{comments}</body>") == GOOD


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("plain  text", "plain text"), ("<p>a<p>b", "a b"), ("<script>x", ""), ("<!-- x", ""), ("<b>a</b>b", "ab"),
    ("a<br>b", "a b"), ("<p hidden>x</p><p>y", "y"), ("<nav>m</nav><p>only this</p>", "only this"), ("<", "<"), ("a &amp &zz; b", "a & &zz; b")])
def test_odd_pages(page, text):
    assert blocks.main_text(page) == text


def test_deep_and_broken_pages_end():
    blocks.main_text("<div>" * 20_000 + "x" + "</div>" * 20_000)
    blocks.main_text('<a "' * 20_000)
    assert blocks.main_text("<p>" + "the word " * 200_000).count("word") == 200_000


def test_extract_rows(spark):
    rows = [(1, "u", ARTICLE, "t"), (1, "u", ARTICLE, "t"), (None, None, None, None), (3, "v", "", "x")]
    out = blocks.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(out) == 4 and all(r.n_chars == len(r.text) for r in out)
    assert blocks.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
