import random
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from echolens.functions import text

WORDS = st.lists(
    st.sampled_from(
        ["How to ", "the ", "Using ", "a ", "x", " ", "\n", "\n\n\n\n", "  ", "<b>", "&amp;lt;", "&nbsp;", "?", "Run ",
         "getting started with ", "é", "\xa0", "\u2003", "working with ", "Ann", "deploy", "<", ">"]
    ),
    max_size=8,
).map("".join)


def _apply(spark, function, values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [row[1] for row in sorted(rows.select("i", function(F.col("t"))).collect())]


def _expected_question(title):
    title = title.strip()
    low = title.lower()
    rules = [
        (len(title) < 5, lambda: None),
        (title[-1:] == "?", lambda: title),
        (re.match("how to|getting started", low),
         lambda: "How do I " + low.replace("how to ", "").replace("getting started with ", "get started with ") + "?"),
        (re.match("using|working with", low),
         lambda: "How do I " + low.replace("using ", "use ").replace("working with ", "work with ") + "?"),
        (re.match("create|build|deploy|run|install|configure", low), lambda: f"How do I {low}?"),
        (re.match("the|a |an ", low), lambda: f"What is {low}?"),
    ]
    return next((make() for applies, make in rules if applies), f"What is {title} in Acme?")


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(WORDS, min_size=40, max_size=40))
def test_text_functions_against_python(spark, values):
    assert _apply(spark, lambda c: text.title_to_question(c, "Acme"), values) == [
        _expected_question(v) for v in values
    ]
    assert _apply(spark, text.strip, values) == [v.strip() for v in values]
    assert _apply(spark, text.clean_content, values) == [
        re.sub("<[^>]+>", "", re.sub(" {2,}", " ", re.sub("\n{3,}", "\n\n", v))).strip() for v in values
    ]
    previews = [v.strip() if len(v.strip()) <= 5 else v.strip()[:5].rstrip() + "..." for v in values]
    assert _apply(spark, lambda c: text.preview_text(c, 5), values) == previews


def test_entities_are_decoded_ampersand_first(spark):
    assert _apply(spark, text.strip_html, ["<p>a &amp;lt; b</p>&nbsp;", None, ""]) == ["a < b", "", ""]


def test_relevance_stages(spark):
    rules = text.RelevanceRules.for_brand("Acme")
    posts = {
        "Try ACME.com for multiacme": True,
        "a multiacme model, acme deploy-free": True,
        "a multiacme model on acme serverless": True,
        "multiacme and acme in a container": False,
        "acme in a container": True,
        "acme rocks": False,
        "acmes in a container": False,
    }
    judge = lambda c: text.is_relevant(c, F.lit(""), rules)
    assert _apply(spark, judge, list(posts)) == list(posts.values())


def test_display_helpers(spark):
    row = spark.createDataFrame([("", "c" * 200, "javascript:x", "hacker_news")], "t string, c string, u string, s string")
    shown = row.select(
        text.display_title(F.col("t"), F.col("c")), text.safe_url(F.col("u")), text.source_label(F.col("s"))
    ).first()
    assert tuple(shown) == ("c" * 140, "#", "Hacker News")


def test_keywords_are_looked_for_around_the_brand(spark):
    from echolens.functions import text as T

    far = "z" * 200
    words = ["acme", f"{far} acme.com", f"acme {far} labs", f"{far}multiacme{far}", f"acme labs{far}acme", f"just acme {far} container",
             f"@acme{far}", "multi acme", f"acmeacme.run{far}", f"{far}pip install acme", f"{far} acme", "container", "", None]
    texts = [(a, b) for a in words for b in words]
    rules = T.RelevanceRules.for_brand("Acme")

    def expected(title, content):
        text = f"{title or ''} {content or ''}".lower()
        if any(word in text for word in rules.strong):
            return True
        if any(word in text for word in rules.false_positive):
            return False
        return " acme " in f" {text} " and any(word in text for word in rules.context)

    rows = spark.createDataFrame(texts, "t string, c string")
    found = rows.select("t", "c", T.is_relevant(F.col("t"), F.col("c"), rules).alias("r")).collect()
    assert [row.r for row in found] == [expected(row.t, row.c) for row in found]
    loose = T.RelevanceRules("aa", ("aab", "far"), ("xaa",), ("ctx",))  # overlapping brands, a keyword without the brand
    cases = {"aaab": True, f"{far}aaab": True, f"{far} far {far}": True, "xaaa": False, f"aaa aa {far} ctx": True, "aaa ctx": False}
    rows = spark.createDataFrame(list(cases.items()), "c string, want boolean")
    assert rows.where(T.is_relevant(F.lit(None).cast("string"), F.col("c"), loose) != F.col("want")).isEmpty()
    cut = rows.select(T.around(F.lit(f"{far}acme{far}acme"), "acme", 5)).first()[0]
    assert cut == "zzzzz\0zzzzzacmezzzzz\0zzzzzacme"


def test_entities_are_decoded_in_order_and_at_ampersands_only(spark):
    rng = random.Random(3)
    parts = ["&", "amp;", "lt;", "gt;", "&amp;", "&lt;", "&quot;", "#39;", "&nbsp;", "é", "a", " ", "\n", "\\", "$1", ";", "&AMP;"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(2000)] + [None, "", "&", "&amp;amp;lt;", "&&amp;lt;"]

    def in_order(value):
        for entity, char in text.ENTITIES:
            value = value and value.replace(entity, char)
        return value

    rows = spark.createDataFrame([(value,) for value in texts], "t string").select("t", text.decoded(F.col("t")).alias("d"))
    assert [r.d for r in rows.collect()] == [in_order(value) for value in texts]
    # No entity is looked for in the whole text.
    assert "replace(replace(" not in rows.select(text.strip_html(F.col("t")))._jdf.queryExecution().analyzed().toString()
