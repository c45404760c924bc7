"""Pages with known main text."""

import re
from collections import Counter

import pyarrow.parquet as pq
import pytest

from tracewright.llm import html_text
from tracewright.llm.html_text import extract, main_text, op6_main_text

LONG = "The story of the day is that the council has voted for the new bridge, and it was not close at all in the end, which is what many of the people in the town had hoped for since the old bridge was shut in the spring of last year."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>", ""),
        ("<html><body><nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p>One\n two&nbsp;<b>th</b>ree<br>four.</article><footer>&copy; me</footer>", "A & B\n\nOne two three four."),
        ("<article><p>x</p><div class='comments'><p>nice post of the day</p></div><aside>y</aside><form>z</form><p>w</p></article>", "x\n\nw"),
        (f"<div class=menu>The menu of the site is here for the user and it is long enough to be of note, is it not so</div><h2>Title</h2><p>{LONG}</p><p>Short end.</p><p><a href=q>Read more of this</a></p>", f"Title\n\n{LONG}\n\nShort end."),
        ("<div class='page no-sidebar'><article>kept</article></div>", "kept"),
        ("<script>if (a<b) document.write('<p>no</p>')</script><main><p title='a>b'>yes</p><style>p{}</style></main>", "yes"),
        ("<article><p>a < b and c > d</p><!-- <p>no</p> --><p>&lt;b&gt;</p></article>", "a < b and c > d\n\n<b>"),
        (f"<div id=header><p>{LONG}</p></div><div class='post-content'><h2>T</h2><p>$$ ## 11</p><p class=share-links>Share</p></div><p>{LONG}</p><div class=cookie-notice>{LONG}</div>", "T\n\n$$ ## 11"),
        (f"<div class=comments><div class=content>{LONG}</div></div><table><tr><td>{LONG}</table>", LONG),
        ("<main><p>one<br><br>two</p><pre>x\n  y</pre></main>", "one\n\ntwo\n\nx y"),
    ],
)
def test_pages(page, text):
    assert main_text(page) == text


RUSSIAN = "Городской совет проголосовал за строительство нового моста через реку, и решение далось депутатам совсем не просто. Многие жители города давно ждали этого, потому что старый мост был закрыт весной прошлого года, а объезд занимал больше часа."
POLISH = "Rada miasta przegłosowała budowę nowego mostu przez rzekę, choć decyzja wcale nie była łatwa. Wielu mieszkańców czekało długo, ponieważ stary most zamknięto wiosną ubiegłego roku, objazd zajmował ponad godzinę dziennie każdemu kierowcy."
MORE = "It was said by the council that the work on it is to begin in the first days of May and that it will be done by the end of the year, at a cost that is not yet known to all of those who will have to pay for it in the years to come."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<body><div class='search'><article>The only one.</article></div></body>", "The only one."),
        (f"<body><div class='ad-free-story'><p>{LONG}</p><p>{MORE}</p></div></body>", f"{LONG}\n\n{MORE}"),
        (f"<main><p>{LONG}</p><section id='related-work'><h2>Related work</h2><p>{MORE}</p></section></main>", f"{LONG}\n\nRelated work\n\n{MORE}"),
        (f"<article><p>{LONG}</p><section class='share-price'><p>{MORE}</p></section></article>", f"{LONG}\n\n{MORE}"),
        (f"<p>{RUSSIAN}</p><p>{RUSSIAN}</p><footer>The terms of the site are to be read by all of you</footer>", f"{RUSSIAN}\n\n{RUSSIAN}"),
        (f"<p>{POLISH}</p><p>{POLISH}</p>", f"{POLISH}\n\n{POLISH}"),
        ("<article><p>We have <math><mi>x</mi><annotation>x</annotation></math> and <button>press</button> here, as was said.</p><button>Like</button></article>", "We have x and press here, as was said."),
        (f"<p>{LONG}</p><pre>{'for i in range(10): print(i) ' * 12}</pre><p>{MORE}</p>", f"{LONG}\n\n{('for i in range(10): print(i) ' * 12).strip()}\n\n{MORE}"),
        (f"<article><p>{LONG}</p><h2>References</h2><ol><li><a href=x>Of bridges</a></li><li><a href=y>Of towns</a></li></ol></article>", f"{LONG}\n\nReferences\n\nOf bridges\n\nOf towns"),
        (f"<p>The sign © is {MORE}</p><p>© 2024 the town</p>", f"The sign © is {MORE}"),
        (f"<form action=x><main><p>{LONG}</p></main><input></form>", LONG),
        (f"<div class=sidebar-layout><main><p>{LONG}</p></main></div>", LONG),
        # names that stay what they are
        (f"<div class=ad-container><p>{LONG}</p></div><article><p>{MORE}</p></article>", MORE),
        (f"<article><p>{MORE}</p></article><div class=related-posts><article><p>{LONG}</p></article></div>", MORE),
        (f"<article><p>{MORE}</p></article><div id=comments><article class=comment><p>{LONG}</p></article></div><article class=comment>{LONG}</article>", MORE),
        (f"<article><p>{MORE}</p><div class=share-links>Send it</div><div class=related-now>Short one</div></article><div class=search><article>Teaser</article></div>", MORE),
    ],
)
def test_names_are_weights(page, text):
    assert main_text(page) == text


def test_text_beside_teasers():
    teaser = "<article><h3><a href=q>The next story</a></h3><p>What is to come of it.</p></article>"
    page = f"<div class=menu>Menu</div><div><h1>Title</h1><p>{LONG}</p><p>It was said by the council.</p><p>{LONG}</p></div>{teaser}{teaser}<p>Of the day</p><footer>{LONG}</footer>"
    assert main_text(page).startswith(f"Title\n\n{LONG}\n\nIt was said by the council.\n\n{LONG}")
    assert "Menu" not in main_text(page) and not main_text(page).endswith((LONG, "Of the day"))
    many = "".join(f"<p>{LONG}</p>" for _ in range(5))
    assert main_text(f"{many}<div class=post><p>Read on.</p></div>") == "\n\n".join([LONG] * 5 + ["Read on."])


def test_broken_markup_ends():
    for page in ("<" * 20_000, "<a '" * 5_000, "<div>" * 20_000 + "x", "<!--" * 10_000, "</p>" * 10_000, "<li>" * 20_000 + "x", "<div class=share-price>" * 5_000 + "x", "<form><article>" * 5_000 + "x", "<script>" * 100, "&#xfffffff;&bogus;" * 100):
        main_text(f"<article>{page}")


def test_table_keeps_rows_and_other_columns(spark):
    frame = spark.createDataFrame([(1, "u", None, 5, "t"), (1, "u", "<article>a</article>", 6, None), (1, "u", "<article>a</article>", 6, None)], "page_id long, url string, html string, n_chars int, text string")
    assert sorted(map(tuple, extract(frame).collect())) == [(1, "u", "", 0), (1, "u", "a", 1), (1, "u", "a", 1)]
    assert extract(frame.limit(0)).count() == 0


def test_articles_of_the_test_table(spark):
    import html

    sf = "/root/testdata/sf0.001"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in op6_main_text(spark, sf).collect():
        article = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", p))).split()) for p in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_blocks_decide_without_tags_and_names():
    """The given pages with all structural tags made div and names removed, against what their tags say."""
    tags = re.compile(r"<(/?)(article|nav|header|footer|aside|main|section|form|figure|dialog|menu)\b", re.I)
    names = re.compile(r"""\s(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
    both = wanted = given = 0
    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist():
        want, got = (Counter(x for x in html_text.main_text(p).split("\n\n") if x) for p in (page, names.sub("", tags.sub(r"<\1div", page))))
        both, wanted, given = both + (want & got).total(), wanted + want.total(), given + got.total()
    assert both >= 0.9 * wanted and both >= 0.95 * given


def test_pages_of_many_megabytes():
    text = "The text of the article is of a length that is known to all of us. " * 20
    page = f"<div><a href=x>home</a></div><article>{f'<p>{text}</p>' * 4000}</article><footer>end</footer>"
    assert html_text.main_text(page) == "\n\n".join([text.strip()] * 4000)
