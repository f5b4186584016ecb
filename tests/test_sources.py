"""Normalisers on landed files, trees and pages."""

import json
import random

import pytest
from pyspark.sql import functions as F

from echolens.functions.text import RelevanceRules
from echolens.operators import plan
from echolens.schemas import MESSAGES
from echolens.sources import docs, github, hackernews, landing, reddit
from echolens.sources.html import extract_pages, parse_page

from conftest import START, plan_of


@pytest.fixture
def land(spark, tmp_path):
    def write(kind, *records):
        path = tmp_path / f"{kind}.json"
        path.write_text("\n".join(json.dumps(record) for record in records))
        return landing.read_landed(spark, str(path), kind)

    return write


def test_github_issues(land):
    issue = {
        "owner": "o", "repo": "r", "number": 1, "title": "T", "body": None, "user": {"login": "u"},
        "html_url": "h", "created_at": "2024-01-01T02:00:00+02:00", "state": "open",
        "labels": [{"name": "Question"}, {"name": "Bug"}], "reactions": {"+1": 2, "url": "x"},
    }
    rows = land("github_issues", issue, {**issue, "number": 2, "pull_request": {"url": "p"}}, {**issue, "number": 3, "labels": []})
    found = {r.source_id: r for r in github.issues(rows, START).collect()}
    assert set(found) == {"o_r_issue_1", "o_r_issue_3"}
    row = found["o_r_issue_1"]
    assert (row.id, row.content, row.content_type, row.created_at) == ("github:o_r_issue_1", "T\n\n", "bug_report", START)
    assert json.loads(row.metadata) == {
        "repo": "o/r", "type": "issue", "number": 1, "state": "open", "labels": ["question", "bug"],
        "reactions": {"+1": 2, "url": "x"},
    }
    assert found["o_r_issue_3"].content_type == "discussion"


def test_every_normaliser_gives_the_message_schema(land):
    made = [
        github.issue_comments(land("github_issue_comments", {"owner": "o", "repo": "r", "issue_number": 1, "id": 2})),
        github.discussions(land("github_discussions", {"owner": "o", "repo": "r", "number": 1, "title": "t"})),
        reddit.posts(land("reddit_posts", {"id": "x", "title": "Why not"})),
        hackernews.stories(land("hn_stories", {"objectID": "1", "title": "t"})),
    ]
    for frame in made:
        assert frame.schema == MESSAGES or [f.dataType for f in frame.schema] == [f.dataType for f in MESSAGES]
        assert frame.columns == MESSAGES.names and frame.count() == 1
    assert made[2].first().content_type == "question"
    assert json.loads(made[2].first().metadata)["flair"] is None


def test_atom_files(spark, tmp_path):
    feed = """<feed xmlns="http://www.w3.org/2005/Atom"><title>feed</title>{}</feed>"""
    entry = (
        '<entry><title>{}</title><link href="{}"/><content type="html">&lt;p&gt;acme.com&lt;/p&gt;</content>'
        "<updated>2024-01-01T00:00:00+00:00</updated><author><name>n</name></author><id>{}</id></entry>"
    )
    for name, entries in {
        "one": [("Can I", "l", "t3_a"), ("B", "https://x/comments/bb/t", "urn:b"), ("C", "l", "urn:c")],
        "two": [("Can I", "l", "t3_a")],
    }.items():
        folder = tmp_path / f"subreddit={name}"
        folder.mkdir()
        (folder / "feed.xml").write_text(feed.format("".join(entry.format(*e) for e in entries)))
    entries = landing.read_atom(spark, str(tmp_path))
    assert reddit.atom_entries(entries).count() == 4
    rows = {r.title: r for r in reddit.atom_posts(entries, RelevanceRules.for_brand("acme"), START).collect()}
    assert (rows["Can I"].id, rows["Can I"].content_type) == ("reddit:post_a", "question")
    assert json.loads(rows["Can I"].metadata) == {"subreddit": "one", "via": "rss"}
    assert rows["B"].source_id == "post_bb" and rows["B"].created_at == START
    assert rows["C"].source_id.lstrip("post_").lstrip("-").isdigit()
    assert rows["C"].content == "C\n\nacme.com"


def _walk(items, story, depth_limit, story_kids, comment_kids):
    found = []

    def visit(number, depth):
        item = items.get(number)
        if depth > depth_limit or item is None or item.get("deleted") or item.get("dead"):
            return
        found.append((story, number, depth))
        for kid in (item.get("kids") or [])[:comment_kids]:
            visit(kid, depth + 1)

    for kid in (items.get(story, {}).get("kids") or [])[:story_kids]:
        visit(kid, 0)
    return found


def test_comment_tree_against_recursion(spark, land):
    rng = random.Random(7)
    items = {n: {"id": n, "kids": []} for n in range(300)}
    for n in range(3, 300):
        parent = rng.choice([0, 1, rng.randrange(n)])
        items[n]["parent"] = parent
        items[parent]["kids"].append(n)
        if rng.random() < 0.1:
            items[n][rng.choice(["deleted", "dead"])] = True
    items[1]["kids"].append(999)
    for n in rng.sample(range(3, 300), 10):
        del items[n]
    frame = land("hn_items", *items.values())
    stories = spark.createDataFrame([(0,), (1,), (2,), (777,)], "story_id long")
    tree = hackernews.comment_tree(stories, frame, 3, 50, 4)
    expected = [hit for story in (0, 1, 2) for hit in _walk(items, story, 3, 50, 4)]
    assert sorted((r.story_id, r.id, r.depth) for r in tree.collect()) == sorted(expected)
    assert len(expected) > 60


def test_comment_tree_of_any_depth(spark, land):
    items = {n: {"id": n, "kids": [n + 1], "parent": n - 1} for n in range(9)}
    items[9] = {"id": 9, "parent": 8, "kids": [5]}  # leads in a circle
    items[20] = {"id": 20, "kids": [21]}
    items[21] = {"id": 21, "parent": 20, "dead": True, "kids": [22]}
    items[22] = {"id": 22, "parent": 21}
    frame = land("hn_items", *items.values())
    stories = spark.createDataFrame([(0,), (20,), (777,)], "story_id long")
    tree = hackernews.comment_tree(stories, frame)
    assert sorted((r.story_id, r.id, r.depth) for r in tree.collect()) == [(0, n, n - 1) for n in range(1, 10)]


def _above(shown, text):
    """The operators above the plan's lines that hold ``text``."""
    lines = shown.splitlines()
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    for at, line in enumerate(lines):
        if text in line:
            left = depth[at]
            for over in reversed(range(at)):
                if depth[over] < left:
                    left = depth[over]
                    yield lines[over].lstrip(" :+-").split(" ")[0]


def test_texts_of_items_stored_in_lots_stay_where_they_are(spark, land, monkeypatch):
    monkeypatch.setattr(plan, "_LOT_BITS", 3)
    items = {n: {"id": n, "kids": [], "text": f"text {n}"} for n in range(200)}
    for n in range(2, 200):
        items[n]["parent"] = n // 3 if n % 7 else n % 2
        items[items[n]["parent"]]["kids"].append(n)
    items[20]["dead"] = True
    frame = land("hn_items", *items.values(), {"text": "no id"}).repartition(4)
    stories = spark.createDataFrame([(0,), (1,), (777,)], "story_id long")
    stored = plan.stored_in_lots(frame)
    assert stored.count() == 201 and stored.select("_lot", "_place").distinct().count() == 201 and stored.agg(F.max("_place")).first()[0] == 7
    tree, plain = hackernews.comment_tree(stories, stored), hackernews.comment_tree(stories, frame)
    assert tree.columns == plain.columns and sorted(tree.collect()) == sorted(plain.collect()) and plain.count() > 100
    above = list(_above(plan_of(tree), "text:string"))
    assert above and not {"Exchange", "Sort", "BroadcastExchange"} & set(above)
    assert "Exchange" in set(_above(plan_of(tree), "struct<id:bigint,_lot"))


def test_long_chain_takes_few_rounds(spark, land, monkeypatch):
    items = [{"id": n, "kids": [n + 1], "parent": n - 1} for n in range(1001)]
    rounds = []
    monkeypatch.setattr(hackernews, "materialised", lambda rows, kept=hackernews.materialised: rounds.append(1) or kept(rows))
    tree = hackernews.comment_tree(spark.createDataFrame([(0,)], "story_id long"), land("hn_items", *items)).select("id", "depth")
    assert sorted(tuple(r) for r in tree.collect()) == [(n, n - 1) for n in range(1, 1001)]
    assert len(rounds) <= 12


def test_dead_ancestors_circles_and_shared_kids(spark, land):
    frame = land(
        "hn_items", {"id": 1, "kids": [2, 3, 2]}, {"id": 2, "parent": 1, "kids": [4]}, {"id": 3, "parent": 1, "dead": True, "kids": [5]},
        {"id": 4, "parent": 2, "kids": [6]}, {"id": 5, "parent": 3, "kids": [7]}, {"id": 6, "parent": 4}, {"id": 7, "parent": 5},
        {"id": 10, "parent": 11, "kids": [11, 12]}, {"id": 11, "parent": 10, "kids": [10]}, {"id": 12, "parent": 10},
        {"id": 20, "kids": [4, 21]}, {"id": 21, "parent": 99},
    )
    stories = spark.createDataFrame([(1,), (1,), (20,)], "story_id long")
    tree = hackernews.comment_tree(stories, frame)
    assert sorted((r.story_id, r.id, r.depth) for r in tree.collect()) == [(1, 2, 0), (1, 4, 1), (1, 6, 2), (20, 21, 0)]
    assert hackernews.comment_tree(stories.limit(0), frame).isEmpty()


def _expected_docstring(content, path, most=None):
    lines = content.split("\n")[:most]
    opened = next((i for i, line in enumerate(lines) if line.strip().startswith('"""')), None)
    parts = []
    if opened is not None:
        first = lines[opened].strip()
        if first.endswith('"""') and len(first) > 3:
            parts.append(first[3:-3].strip())
        else:
            text = [first[3:]]
            for line in lines[opened + 1 :]:
                if line.strip().endswith('"""'):
                    text.append(line.strip()[:-3])
                    break
                text.append(line)
            parts.append("\n".join(text).strip())
    if "import acme" in content or "from acme" in content:
        parts.append(f"\n\n--- Code Example: {path} ---\n\n{content}")
    return "\n".join(parts) if parts else None


def test_python_doc_against_python(spark):
    pieces = ['"""', '"""Doc."""', '  """Start', "text", 'end"""', "import acme", '""""', '""""""', "", "x = 1", "\t"]
    rng = random.Random(3)
    files = ["\n".join(rng.choices(pieces, k=rng.randrange(1, 8))) for _ in range(200)]
    files += ["x\n" * 49 + '"""in\nout"""', "x\n" * 50 + '"""late"""', '"""open\n' + "y\n" * 80]
    rows = spark.createDataFrame([(i, f) for i, f in enumerate(files)], "i int, c string")
    for most in (None, 50):
        doc = docs.python_doc(F.col("c"), F.lit("a.py"), "acme", most)
        got = rows.select("i", doc.alias("d")).orderBy("i").collect()
        assert [r.d for r in got] == [_expected_docstring(f, "a.py", most) for f in files]


def test_damaged_lines_are_rejected(spark):
    lines = ['{"owner": "o", "repo": "r", "number": 1, "title": "t"}', '{"owner": "o", "repo": "r"', "", "no json", None]
    raw = spark.createDataFrame([(line, i) for i, line in enumerate(lines)], "value string, n int")
    made = github.issues(landing.parse_landed(raw, "github_issues"))
    assert [r.id for r in made.collect()] == ["github:o_r_issue_1"]
    assert sorted(r.n for r in landing.rejects(raw, "github_issues").collect()) == [1, 2, 3, 4]
    assert reddit.posts(landing.parse_landed(raw, "reddit_posts")).count() == 0


def test_links_with_any_quotes(spark):
    markup = """<a href="/blog/it's-here">a</a> <a class='x>y' href='/blog/say-"hi"'>b</a> <a href=/blog/bare>c</a>
        <a href="/blog/a&#38;b&amp;c">d</a> <a data-href="/blog/no">e</a>"""
    pages = spark.createDataFrame([("https://x.com/", markup)], "url string, html string")
    found = {r.link for r in docs.page_links(pages).collect()}
    assert found == {"https://x.com" + p for p in ("/blog/it's-here", '/blog/say-"hi"', "/blog/bare", "/blog/a&b&c")}


def test_doc_files_cut_per_repo(spark):
    paths = ["README.md", "a/test_x.py", "a/x.py", "y.py", "b/__init__.py", "n/Readme.TXT", "c/z.py", "short/readme.md"]
    rows = spark.createDataFrame(
        [("o", repo, i, p, "s" if "short" in p else "c" * 100) for repo in ("r1", "r2") for i, p in enumerate(paths)],
        "owner string, repo string, position long, path string, content string",
    )
    assert {r.path for r in docs.doc_files(rows).collect()} == {"README.md", "a/x.py", "n/Readme.TXT", "c/z.py"}
    assert docs.doc_files(rows, 2).count() == 4


PIECES = [
    "<p>", "</p>", "text one", " a &amp;lt; b ", "&nbsp;", "&copy;", "&amp", "<br>", "<nav>menu</nav>", "<!-- c -->",
    "<script>var a='</p>';</script>", "<b>", "</b>", "<footer>f</footer>", "\n", "x < y", '<a title="a>b">l</a>',
    "<div class='content'>inner</div>", "&#39;", "<style>p{}</style>",
]


def test_both_page_readers_agree(spark):
    rng = random.Random(11)
    pages = [
        f"<html><head><title>T</title></head><body><h1>Head {''.join(rng.choices(['a', '<i>b</i>', '&amp;'], k=2))}</h1>"
        f"<article>{''.join(rng.choices(PIECES, k=rng.randrange(1, 9)))}</article></body></html>"
        for _ in range(400)
    ]
    rows = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    got = [(r.title, r.content) for r in extract_pages(rows).orderBy("i").collect()]
    assert got == [parse_page(page) for page in pages]


@pytest.mark.parametrize(
    "html, expected",
    [
        ("<title>T</title><main>a<nav>n</nav>b</main>", ("T", "a\nb")),
        ("<body><div class='x content'>a<div>b</div>c</div>d</body>", (None, "a\nb\nc")),
        ("<body><p role='main'>a</p>d<h1> x <b>y</b></h1></body>", ("xy", "a")),
        ("<body>only<footer>f</footer></body>", (None, "only")),
        ("<article>a<article>b</article>c</article><main>m</main>", (None, "a\nb\nc")),
        ("<p>no body</p>", (None, None)),
    ],
)
def test_page_content_element(spark, html, expected):
    rows = spark.createDataFrame([(html,)], "html string")
    assert tuple(extract_pages(rows).first()) == expected == parse_page(html)


def test_page_urls(spark):
    rows = [
        ("https://h/docs/guide/a.png", False), ("https://h/docs/guide/x?q=1", True), ("/docs/x", True),
        ("https://other/docs/x", False), ("https://h/blog/x", False), ("https://h/docs/x#top", False), ("https://h/docs/x#", True),
    ]
    frame = spark.createDataFrame(rows, "url string, expected boolean")
    assert frame.where(docs.crawlable(F.col("url"), "h") != F.col("expected")).count() == 0
    page = f"<body>{'a' * 100}</body>"
    pages = spark.createDataFrame([("https://h/", page), ("https://h/blog/b/c/", page), ("https://h/x", "<body>s</body>")], "url string, html string")
    found = {r.url: r for r in docs.page_messages(pages, as_of=START).collect()}
    assert {u: r.id for u, r in found.items()} == {"https://h/": "docs:index", "https://h/blog/b/c/": "docs:blog_b_c"}
    assert json.loads(found["https://h/blog/b/c/"].metadata)["section"] == "b"
    assert found["https://h/"].source == "blog"


def test_links(spark):
    from urllib.parse import urljoin

    hrefs = ["/blog/a", "https://o/blog/b", "//o/blog/c", "x/blog/d", "../blog/e", "/blog/./f", "?p=/blog/g", "/blog/", "/about", "#/blog/h"]
    html = "".join(f'<a class="k" href="{h}">t</a>' for h in hrefs) + '<!-- <a href="/blog/no">x</a> --><a href="/blog/a">again</a>'
    for base in ("https://h/blog", "https://h/docs/page?x=1", "https://h"):
        pages = spark.createDataFrame([(base, html)], "url string, html string")
        expected = {urljoin(base, h) for h in hrefs if "/blog/" in h and h != "/blog/"}
        assert {r.link for r in docs.page_links(pages).collect()} == expected
