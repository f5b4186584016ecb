"""WARC round trips and main texts."""

import hashlib
import math
import time
import zlib

import numpy as np
import pytest

from echolens.llm import pagetext, warc
from echolens.llm.common import fresh_folder

SMALL = "/root/testdata/sf0.001"


def _pages(spark, rows):
    return spark.createDataFrame([(*row, "x", 5) for row in rows], "page_id long, url string, html string, digest string, offset int")


LARGE = "<p>" + "ä" * 700 + "</p>"
ROWS = [(1, "http://a", LARGE), (2, None, LARGE), (3, "http://b\nc", LARGE), (4, "u", "small"), (5, "u", "small"), (6, "u", None),
        (7, "u", ""), (3, "again", LARGE), (None, "n", LARGE), (8, "u", "x" * 300_000)]


def test_archives_round_trip(spark):
    folder = fresh_folder(spark, "warc-test")
    index = warc.write(_pages(spark, ROWS), folder)
    got = {(r.page_id, r.url): r for r in warc.read(index, folder).collect()}
    assert len(got) == len(ROWS)
    for page_id, url, html in ROWS:
        row, body = got[page_id, url and url.replace("\n", "%0A")], (html or "").encode()
        copy = html == LARGE and page_id != 3
        assert row.payload_bytes == len(body) and row.digest == hashlib.sha1(body).hexdigest()
        assert (row.record_type, row.refers_to) == (("revisit", 3) if copy else ("response", None))
        assert row.payload is None if copy else bytes(row.payload) == body


def test_some_records_by_index(spark):
    folder = fresh_folder(spark, "warc-test")
    index = warc.write(_pages(spark, ROWS), folder).where("page_id in (4, 8)")
    assert sorted(r.page_id for r in warc.read(index, folder).collect()) == [4, 8]
    empty = fresh_folder(spark, "warc-test")
    assert warc.read(warc.write(_pages(spark, ROWS).limit(0), empty), empty).count() == 0


def test_members_are_records_of_their_own():
    raw = warc.record(1, "http://a", None, hashlib.sha1(b"abc").hexdigest(), 3, b"abc", "2024-01-01T00:00:00Z")
    assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\nabc\r\n\r\n") and warc.parse(raw)["payload"] == b"abc"
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"\r\n\r\nabc", b"\r\n\r\nabd"))
    assert zlib.crc32(raw)


def test_ranges_are_joined_in_order():
    places = [("a", 0, 10), ("a", 10, 10), ("a", 100, 5), ("a", 10_000, 5), ("b", 0, 5)]
    assert [len(g) for g in warc.ranges(places, gap=100, most=1000)] == [3, 1, 1]
    assert [len(g) for g in warc.ranges(places, gap=100, most=15)] == [1, 1, 1, 1, 1]


ARTICLE = "<h1>A title</h1><p>First, a <b>bold</b> claim &amp; more.<p>Second  one;\n here.</p><ul><li>Item</li></ul>"
TEXT = "A title First, a bold claim & more. Second one; here. Item"


@pytest.mark.parametrize("page", [
    f"<html><head><title>t</title></head><body><nav>Menu, menu.</nav><article>{ARTICLE}</article><footer>End.</footer>",
    f"<body><div class='site-header'>Hi, you.</div><main>{ARTICLE}</main><aside>See, also: this.</aside></body>",
    f"<body><div id=cookie-notice><p>We use, and like, cookies.</p></div><div role='main'>{ARTICLE}</div>",
    f"<body><article>{ARTICLE}<div class=comments><p>I, for one, differ.</p></div></article><script>a('</p>')</script>",
    f"<body><form><p>Sign up, now.</p></form><article>{ARTICLE}<style>p{{}}</style></article><div hidden>No, no.</div>",
    f"<body><header>Top</header><div class='advert'><p>Buy, buy!</p></div><div class='story'>{ARTICLE}</div>",
])
def test_main_text(page):
    assert pagetext.main_text(page) == TEXT


def test_paths_of_links_weigh_nothing():
    page = "<body><div class=x><a href=1>One, two</a></div><div class=y><p>" + "Words, and words. " * 9 + "</p></div>"
    assert pagetext.main_text(page) == ("Words, and words. " * 9).strip()


def test_odd_pages(spark):
    rows = pagetext.extract(_pages(spark, [(1, "u", None), (2, "u", ""), (3, "u", "<p>un<b>closed"), (4, "u", "<p a='>"),
                                           (5, "u", "<nav>only"), (6, "u", "a &lt; b <!-- c"), (6, "u", "a &lt; b <!-- c")])).collect()
    assert [r.text for r in sorted(rows, key=lambda r: r.page_id)] == ["", "", "unclosed", "", "", "a < b", "a < b"]
    assert pagetext.main_text("<p>" + "deep <div>" * 5000 + "text, here.")


LONG_TEXT = "Words, and words. " * 9


@pytest.mark.parametrize(("page", "text"), [
    (f"<body><div class=x><p>{LONG_TEXT}<p>{LONG_TEXT}<p>{LONG_TEXT}</div><article><p>One teaser.</p></article>",
     LONG_TEXT * 3 + "One teaser."),
    (f"<body><form><nav>Menu, menu.</nav><div><p>{LONG_TEXT}<p>{LONG_TEXT}</div><footer>End.</footer></form>", LONG_TEXT * 2),
    (f"<body><div class='page with-sidebar'><p>{LONG_TEXT}<p>{LONG_TEXT}</div><p class=advert>Buy, buy!</p>", LONG_TEXT * 2),
    (f"<body><article><p>{LONG_TEXT}<p>{LONG_TEXT}</article><div class=comments>" + "<p>I, for one, differ." * 90 + "</div>",
     LONG_TEXT * 2),
    (f"<body><article><p>{LONG_TEXT * 9}<p>{LONG_TEXT * 9}" + "<div><i>x</i></div>" * 9 + "</article>", LONG_TEXT * 18 + "x x"),
])
def test_ratios_decide_in_and_beside_articles(page, text):
    assert pagetext.main_text(page) == text.strip()


@pytest.mark.parametrize("page, kept", [
    ('<article><p title="5" tall">One is first, yes.</p><p title="6" wide">Two is next, so.</p></article>', "One is first, yes. Two is next, so."),
    ("<article><p>See <a href=/it's>this</a> text, a long one, and <a href=/he's>that</a> too. Fine.</p></article>",
     "See this text, a long one, and that too. Fine."),
    ('<article><p title="a > b">Signs in quotes, kept apart.</p></article>', "Signs in quotes, kept apart."),
    ('<article><p>Intro, with commas, and so on.</p><section id="discussion"><p>We discuss it, at length. It holds.</p></section>'
     '<div class="related-work"><p>Others found it, too. See below.</p></div><p class="notice-of-intent">We go on, of course.</p>'
     '<ul class="menu"><li>Soup, fresh.</li><li>Fish, grilled.</li></ul><p class="social-reform">Reform came late, as told.</p></article>',
     "Intro, with commas, and so on. We discuss it, at length. It holds. Others found it, too. See below. We go on, of course. "
     "Soup, fresh. Fish, grilled. Reform came late, as told."),
    ('<div class="post-comment-count main-content"><p>The text is long, and it goes on, and on.</p></div><div class="x"><p>More, too.</p></div>',
     "The text is long, and it goes on, and on. More, too."),
    ('<article><p>The text of an article, which is long. Yes.</p><div class="user-comments"><p>I disagree, sir. Really.</p></div>'
     '<ul class="menu"><li><a href=x>Home page</a></li><li><a href=y>About us</a></li></ul></article>',
     "The text of an article, which is long. Yes."),
])
def test_names_are_soft_and_quotes_follow_equals(page, kept):
    assert pagetext.main_text(page) == kept


def test_deep_nesting_costs_no_more():
    started = time.process_time()
    for page in ("<div>a" * 20_000, "<div>a" * 20_000 + "</x>" * 20_000, "<div class=menu>a" * 20_000):
        pagetext.main_text(page)
    assert time.process_time() - started < 6


def _brute_scores(page):
    """Ratios, smoothing and fusion by whole tag paths, block by block."""
    tags, at, named = {0: ()}, 0, {number: key for key, number in page.paths.items()}
    for number in range(1, len(page.parents)):
        parent, tag = named[number]
        tags[number] = (*tags[parent], tag)
    paths = [tags[b.path] for b in page.blocks]
    weight, _ = pagetext.weights(page)
    own = [max(len(b.text) - b.linked, 0) for b in page.blocks]
    marks = [sum(c in ".,;:!?¿¡。，、；：！？" for c in b.text) for b in page.blocks]
    n = range(len(paths))
    ratios = []
    for i in n:
        same = [j for j in n if paths[j] == paths[i] and weight[j] == weight[i]]
        ratios.append(sum(own[j] + 8.0 * marks[j] * (own[j] > 0) for j in same) / len(same))
    smooth = []
    for i in n:
        near = [(math.exp(-0.5 * (j - i) ** 2) * weight[j], ratios[j] * weight[j]) for j in n if abs(i - j) <= 2]
        smooth.append(sum(k * v for k, v in near) / sum(math.exp(-0.5 * (j - i) ** 2) * weight[j] for j in n if abs(i - j) <= 2))
    fused = []
    for i in n:
        container, mass, length = paths[i][:-1], 0.0, 0.0
        for j in n:
            times = (paths[j][:-1] == container) + (paths[j][:-1][:-1] == container)
            mass += times * smooth[j] * len(page.blocks[j].text) * weight[j]
            length += times * len(page.blocks[j].text) * weight[j]
        fused.append(math.sqrt(smooth[i] * mass / length))
    return ratios, smooth, fused


def test_ratios_against_brute_force(spark):
    rows = spark.read.parquet(f"{SMALL}/pages.parquet").limit(25).collect()
    for row in rows:
        page = pagetext.parsed(row.html or "")
        if not page.blocks:
            continue
        weight, _ = pagetext.weights(page)
        ratios = pagetext.path_ratios(page.blocks, weight)
        assert len(page.blocks) == len(ratios)
        want = _brute_scores(page)
        assert np.allclose(ratios, want[0])
        smooth = pagetext.smoothed(ratios * weight, weight)
        assert np.allclose(smooth, [sum(math.exp(-0.5 * (j - i) ** 2) * ratios[j] * weight[j] ** 2 for j in range(len(ratios)) if abs(i - j) <= 2)
                                    / sum(math.exp(-0.5 * (j - i) ** 2) * weight[j] for j in range(len(ratios)) if abs(i - j) <= 2)
                                    for i in range(len(ratios))])
        assert np.allclose(pagetext.fused(page, smooth, weight), want[2])


def test_read_back_is_dealt_by_bytes(spark, monkeypatch):
    rows = [(i, "u", "x%d " % i * 3000) for i in range(200)]
    folder = fresh_folder(spark, "warc")
    index = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), folder)
    size = index.agg({"length": "sum"}).first()[0]
    monkeypatch.setattr(warc, "SHARE", size // 7)
    read = warc.read(index, folder)
    assert read.rdd.getNumPartitions() >= 7 and read.count() == 200
