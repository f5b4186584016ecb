"""The library's input tables, derived from the given Parquet tables.

Every derivation covers all rows and whole texts of its tables.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echolens.functions.text import contains_any
from echolens.operators.plan import perhaps_among
from echolens.schemas import TOPICS, as_messages

AS_OF = date(2024, 1, 31)
BRAND = "acme"
EMBEDDED_LETTERS = "aeinorst"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table whose texts are costly to process, spread over the cores.

    A table of many files comes in enough splits and stays as it is; one small file is one split,
    which would leave all its texts to one task.
    """
    rows = table(spark, folder, name)
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() * 2 <= cores else rows


def _pick(index: Column, values: tuple[str, ...]) -> Column:
    """Value at ``index`` of a constant array; a long CASE would make methods too large to compile."""
    return F.get(F.array(*[F.lit(value) for value in values]), index.cast("int"))


def _id(number: Column) -> Column:
    return F.concat(F.lit("ev:"), number.cast("string"))


def events(spark: SparkSession, folder: str, text: bool = True) -> DataFrame:
    """Events with the number ``k`` of their props, a source and, if asked for, a document's text."""
    rows = table(spark, folder, "events").withColumns(
        {
            "k": F.get_json_object("props", "$.k").cast("int"),
            "src": _pick(
                F.col("user_id") % 7,
                ("github", "hackernews", "reddit", "twitter", "slack", "docs", "blog"),
            ),
        }
    )
    if not text:
        return rows
    documents = table(spark, folder, "documents")
    number = documents.agg(F.count("*")).scalar()
    # Both sides grow with the data, so the join shuffles: a broadcast would not hold at scale.
    texts = documents.select("doc_id", "text").hint("merge")
    return rows.withColumn("doc_id", F.col("event_id") % number).join(texts, "doc_id", "left")


def messages(spark: SparkSession, folder: str, text: bool = True) -> DataFrame:
    """One message per event. Without ``text`` the content is NULL and documents are not read."""
    rows = events(spark, folder, text)
    number, k, kind = F.col("event_id"), F.col("k"), F.col("event_type")
    thread = F.when(number % 5 != 0, _id(number - number % 5))
    second = _pick((k * 3 + 1) % 14, TOPICS)
    return as_messages(
        rows,
        id=_id(number),
        source=F.col("src"),
        source_id=number,
        content=F.coalesce("text", F.lit("")) if text else F.lit(None),
        title=F.when(number % 4 != 0, F.concat_ws(" ", kind, k.cast("string"))),
        author=F.concat(F.lit("user"), F.col("user_id").cast("string")),
        url=F.when(number % 11 == 0, "ftp://example.com/x").otherwise(
            F.concat(F.lit("https://example.com/m/"), number.cast("string"))
        ),
        parent_id=thread,
        thread_id=thread,
        created_at=F.col("ts"),
        fetched_at=F.col("ts"),
        processed_at=F.when(kind != "click", F.col("ts")),
        metadata=F.concat(
            F.lit('{"num_comments": '), k.cast("string"), F.lit(', "points": '),
            F.floor("value").cast("string"), F.lit("}"),
        ),
        sentiment_simple=F.when(kind == "error", "negative")
        .when(kind == "purchase", "positive")
        .when(kind.isin("signup", "view"), "neutral"),
        sentiment_rich=F.when((kind == "error") & (k < 50), "frustration")
        .when(kind == "error", "complaint")
        .when((kind == "view") & (k < 30), "confusion")
        .when(kind == "purchase", "delight")
        .when(kind != "click", "neutral"),
        content_type=F.when(kind == "error", "bug_report")
        .when(kind == "view", "question")
        .when(kind == "signup", "feature_request")
        .when(kind == "purchase", "praise"),
        topics=F.when(k >= 95, F.lit(None))
        .when(k % 5 == 0, "[]")
        .when(k % 7 == 0, '["other"]')
        .otherwise(
            F.concat(F.lit('["'), _pick(k % 14, TOPICS), F.lit('","'), second, F.lit('"]'))
        ),
        embedding_id=F.when(number % 3 != 0, _id(number)),
    )


def ingestion_state(spark: SparkSession, folder: str) -> DataFrame:
    """State of every source but one: fetched ten days before its newest message."""
    rows = messages(spark, folder, text=False).where(F.col("source") != "twitter")
    return rows.groupBy("source").agg(
        (F.max("created_at") - F.expr("interval 10 days")).alias("last_fetched_at"),
        F.max("source_id").alias("last_item_id"),
        F.lit(None).cast("string").alias("cursor"),
        F.lit('{"pages": "3"}').alias("metadata"),
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    number = documents.agg(F.count("*")).scalar()
    vec = F.col("vec_id")
    rows = table(spark, folder, "embeddings").withColumn("doc_id", (vec % number).cast(documents.schema["doc_id"].dataType))
    texts = perhaps_among(documents.select("doc_id", "text"), rows, "doc_id")  # only those that a vector asks for move
    rows = rows.join(texts, "doc_id", "left")
    return rows.select(
        F.concat(F.lit("vec:"), vec.cast("string")).alias("id"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.col("embedding").alias("vector"),
        _pick(
            F.col("label") % 7, ("docs", "blog", "github", "hackernews", "reddit", "twitter", "slack")
        ).alias("source"),
        F.timestamp_add("HOUR", vec, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("created_at"),
        F.when(vec % 3 != 0, F.concat(F.lit("https://example.com/v/"), vec.cast("string"))).alias("url"),
        F.struct(F.concat(F.lit("vector "), vec.cast("string")).alias("title")).alias("metadata"),
    )


def vector_queries(spark: SparkSession, folder: str) -> DataFrame:
    """The benchmark questions' vectors as queries."""
    return questions(spark, folder).select(F.col("question_id").alias("query_id"), "vector")


def damaged_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A landed issue for each event; every tenth line is cut short."""
    number = F.col("event_id").cast("string")
    whole = F.concat(F.lit('{"owner": "o", "repo": "r", "number": '), number, F.lit(', "title": "t"}'))
    cut = F.concat(F.lit('{"number": '), number)
    return table(spark, folder, "events").select(F.when(F.col("event_id") % 10 == 0, cut).otherwise(whole).alias("value"))


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark texts as questions, each with one of the given vectors."""
    given = table(spark, folder, "embeddings")
    number = given.agg(F.count("*")).scalar()
    asked = table(spark, folder, "benchmark").withColumn("vec_id", F.col("item_id") % number)
    return asked.join(given, "vec_id").select(
        F.col("item_id").cast("string").alias("question_id"),
        F.col("text").alias("question"),
        F.col("embedding").alias("vector"),
    )


def threads(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as messages; half of the user turns ask something."""
    rows = table(spark, folder, "conversations")
    conv, turn = F.col("conv_id").cast("string"), F.col("turn")
    user = F.col("role") == "user"
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    text = F.col("text")
    return as_messages(
        rows,
        id=F.concat_ws(":", F.lit("conv"), conv, turn.cast("string")),
        source=F.lit("slack"),
        source_id=F.concat_ws(":", conv, turn.cast("string")),
        content=F.when(
            user & (F.col("conv_id") % 2 == 0), F.concat(F.lit("How "), text, F.lit("?"))
        ).otherwise(text),
        thread_id=F.when(turn > 0, F.concat(F.lit("conv:"), conv, F.lit(":0"))),
        created_at=F.timestamp_add("MINUTE", turn, start),
        fetched_at=start,
        content_type=F.when(user & (F.col("conv_id") % 3 == 0), "question"),
    )


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as knowledge messages; headers are set into every second long one."""
    rows = text_table(spark, folder, "documents")
    text, doc = F.col("text"), F.col("doc_id")

    def heading(lead: str, start: int) -> Column:
        words = F.replace(F.substring(text, start, 20), F.lit("\n"), F.lit(" "))
        return F.concat(F.lit("\n" + lead), words, F.lit("\n"))

    with_headers = F.concat(
        F.lit("Intro"), heading("## How to ", 1), F.substring(text, 21, 300),
        heading("# Using ", 321), F.substr(text, F.lit(341)),
    )
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return as_messages(
        rows,
        id=F.concat(F.lit("doc:"), doc.cast("string")),
        source=F.when(doc % 3 == 0, "blog").otherwise("docs"),
        source_id=doc,
        content=F.when((doc % 2 == 0) & (F.length(text) > 600), with_headers).otherwise(text),
        title=_pick(
            doc % 5, ("Getting started with jobs", "The runtime", "Volumes", "Deploy an app", "Tiny")
        ),
        created_at=F.timestamp_add("MINUTE", doc, start),
        fetched_at=start,
        content_type=F.lit("documentation"),
    )


def _second(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _epoch_seconds() -> Column:
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))


def _landed(rows: DataFrame, **fields: Column) -> DataFrame:
    return rows.select(F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])).alias("value"))


def _login() -> Column:
    return F.struct(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("login"))


def _repo() -> Column:
    return F.concat(F.lit("repo"), (F.col("event_id") % 3).cast("string"))


def _web(path: str) -> Column:
    return F.concat(F.lit("https://example.com/" + path), F.col("event_id").cast("string"))


def _names(*names: str) -> Column:
    return F.array(*[F.struct(F.lit(name).alias("name")) for name in names])


def _headline() -> Column:
    return F.concat_ws(" ", F.col("event_type"), F.col("k").cast("string"))


def github_issues(spark: SparkSession, folder: str) -> DataFrame:
    """One landed issue line per event; some are pull requests, some have no body or reactions."""
    number, kind = F.col("event_id"), F.col("event_type")
    return _landed(
        events(spark, folder),
        owner=F.lit(BRAND),
        repo=_repo(),
        number=number,
        title=_headline(),
        body=F.when(number % 5 != 0, F.col("text")),
        user=_login(),
        html_url=_web("i/"),
        created_at=_second("ts"),
        updated_at=_second("ts"),
        state=F.when(number % 2 == 0, "open").otherwise("closed"),
        labels=F.when(kind == "error", _names("Bug", "P1"))
        .when(kind == "signup", _names("Enhancement"))
        .when(kind == "view", _names("Help-Wanted"))
        .when(kind == "click", _names("Question", "bug-report"))
        .otherwise(_names("misc")),
        reactions=F.when(number % 4 != 0, F.struct(F.col("k").alias("total_count"))),
        comments=F.col("k"),
        pull_request=F.when(number % 13 == 0, F.struct(_web("p/").alias("url"))),
    )


def github_issue_comments(spark: SparkSession, folder: str) -> DataFrame:
    return _landed(
        events(spark, folder),
        owner=F.lit(BRAND),
        repo=_repo(),
        issue_number=F.col("event_id") - F.col("event_id") % 5,
        id=F.col("event_id"),
        body=F.when(F.col("event_id") % 6 != 0, F.col("text")),
        user=_login(),
        html_url=_web("c/"),
        created_at=_second("ts"),
    )


def github_discussions(spark: SparkSession, folder: str) -> DataFrame:
    """One discussion per event with two comments."""
    kind = F.col("event_type")

    def comment(name: str, body: Column) -> Column:
        return F.struct(
            F.concat(F.lit("DC_" + name), F.col("event_id").cast("string")).alias("id"),
            body.alias("body"),
            _login().alias("author"),
            _second("ts").alias("createdAt"),
            _web("dc/").alias("url"),
        )

    return _landed(
        events(spark, folder),
        owner=F.lit(BRAND),
        repo=_repo(),
        number=F.col("event_id"),
        title=_headline(),
        body=F.col("text"),
        author=_login(),
        url=_web("d/"),
        createdAt=_second("ts"),
        updatedAt=_second("ts"),
        category=F.when(
            kind != "click",
            F.struct(
                F.when(kind == "error", "Q&A")
                .when(kind == "view", "Open questions")
                .when(kind == "signup", "Ideas")
                .otherwise("Announcements")
                .alias("name")
            ),
        ),
        comments=F.struct(
            F.array(comment("a", F.col("text")), comment("b", _headline())).alias("nodes")
        ),
    )


def hn_stories(spark: SparkSession, folder: str) -> DataFrame:
    """Search hits; every third story is found by two search terms."""
    number = F.col("event_id")
    rows = events(spark, folder)
    found = F.when(number % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return _landed(
        rows.withColumn("term", F.explode(found)),
        objectID=number.cast("string"),
        title=_headline(),
        story_text=F.when(number % 2 == 1, F.col("text")),
        author=_login()["login"],
        url=F.when(number % 7 == 0, "").when(number % 7 != 1, _web("s/")),
        created_at_i=_epoch_seconds(),
        points=F.floor("value"),
        num_comments=F.when(number % 9 != 0, F.col("k")),
    )


def hn_items(spark: SparkSession, folder: str) -> DataFrame:
    """Stories of forty items each, a binary tree of comments; some are deleted or dead."""
    number = F.col("event_id")
    local = number % 40
    root = number - local
    kids = F.filter(
        F.transform(F.array(local * 2 + 1, local * 2 + 2), lambda j: F.when(j < 40, root + j)),
        lambda kid: kid.isNotNull(),
    )
    return _landed(
        events(spark, folder),
        id=number,
        text=F.when(number % 8 != 0, F.col("text")),
        by=_login()["login"],
        parent=F.when(local > 0, root + F.floor((local - 1) / 2)),
        time=_epoch_seconds(),
        kids=F.when(F.size(kids) > 0, kids),
        deleted=F.when((local > 0) & (number % 23 == 0), True),
        dead=F.when((local > 0) & (F.col("k") == 7), True),
    )


def hn_story_ids(items: DataFrame) -> DataFrame:
    return items.where(F.col("parent").isNull()).select(F.col("id").alias("story_id"))


def reddit_posts(spark: SparkSession, folder: str) -> DataFrame:
    number = F.col("event_id")
    return _landed(
        events(spark, folder),
        id=F.concat(F.lit("p"), number.cast("string")),
        title=F.when(number % 6 == 0, F.concat(_headline(), F.lit("?")))
        .when(number % 6 == 1, F.concat(F.lit("Show "), _headline()))
        .otherwise(_headline()),
        selftext=F.when(number % 3 == 0, "").otherwise(F.col("text")),
        author=_login()["login"],
        permalink=F.concat(F.lit("/r/x/comments/p"), number.cast("string")),
        created_utc=_epoch_seconds().cast("double"),
        subreddit=F.concat(F.lit("sub"), (F.col("user_id") % 9).cast("string")),
        score=F.when(number % 10 != 0, F.col("k") - 20),
        num_comments=F.col("k"),
        link_flair_text=F.when(number % 4 == 0, "Help"),
    )


def reddit_comments(spark: SparkSession, folder: str) -> DataFrame:
    """One listing per event with two comments; some comments were removed."""
    number = F.col("event_id")

    def comment(name: str, body: Column) -> Column:
        return F.struct(
            F.struct(
                F.concat(F.lit(name), number.cast("string")).alias("id"),
                body.alias("body"),
                _login()["login"].alias("author"),
                F.concat(F.lit("/c/" + name), number.cast("string")).alias("permalink"),
                _epoch_seconds().cast("double").alias("created_utc"),
                F.lit("sub").alias("subreddit"),
                F.col("k").alias("score"),
            ).alias("data")
        )

    return _landed(
        events(spark, folder),
        post_id=F.concat(F.lit("p"), number.cast("string")),
        children=F.array(
            comment("a", F.col("text")), comment("b", F.when(number % 2 == 0, _headline()).otherwise(""))
        ),
    )


def atom_feed(spark: SparkSession, folder: str) -> DataFrame:
    """Feed entries as XML text: brand mentions of every kind, some entries without a title."""
    number = F.col("event_id")

    def escaped(text: Column) -> Column:
        # Most texts have none of these, which is found sooner than each is replaced.
        escapes = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;"))
        changed = text
        for char, entity in escapes:
            changed = F.replace(changed, F.lit(char), F.lit(entity))
        return F.when(contains_any(text, tuple(char for char, _ in escapes)), changed).otherwise(text)

    lead = _pick(
        number % 5,
        (
            f"pip install {BRAND} ",
            f"a multi{BRAND} thing ",
            f"we run {BRAND} in a container ",
            f"just {BRAND} alone ",
            f"using {BRAND} and {BRAND}.com, ",
        ),
    )
    lead = F.concat(F.lit("<p>"), lead, F.lit("&amp; <b>more</b> &lt;x&gt;</p>"))
    body = F.concat(escaped(lead), escaped(F.col("text")))
    title = F.when(number % 4 == 0, F.concat(F.lit("Can I "), _headline())).otherwise(_headline())
    entry = F.when(number % 3 == 0, F.concat(F.lit("t3_e"), number.cast("string"))).otherwise(
        F.concat(F.lit("urn:"), number.cast("string"))
    )
    xml = F.concat(
        F.lit('<entry xmlns="http://www.w3.org/2005/Atom">'),
        F.when(number % 17 == 0, "").otherwise(F.concat(F.lit("<title>"), title, F.lit("</title>"))),
        F.lit('<link href="https://example.com/r/x/comments/c'), number.cast("string"), F.lit('/t/"/>'),
        F.lit('<content type="html">'), body, F.lit("</content>"),
        F.lit("<updated>"), F.when(number % 12 == 0, "soon").otherwise(_second("ts")), F.lit("</updated>"),
        F.lit("<author><name>"), _login()["login"], F.lit("</name></author>"),
        F.lit("<id>"), entry, F.lit("</id></entry>"),
    )
    feed = F.concat(F.lit("sub"), (F.col("user_id") % 9).cast("string"))
    return events(spark, folder).select(feed.alias("subreddit"), xml.alias("value"))


def repo_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files of one repository per language: readmes, examples, tests and others."""
    doc = F.col("doc_id")
    number = doc.cast("string")
    kind = doc % 8
    path = (
        F.when(kind == 0, F.concat(F.lit("d"), number, F.lit("/README.md")))
        .when(kind == 1, F.concat(F.lit("examples/e"), number, F.lit(".py")))
        .when(kind == 2, F.concat(F.lit("tests/Test_"), number, F.lit(".py")))
        .when(kind == 3, F.concat(F.lit("pkg"), number, F.lit("/__init__.py")))
        .when(kind == 4, F.concat(F.lit("setup"), number, F.lit(".py")))
        .when(kind == 5, F.concat(F.lit("a/b"), number, F.lit("/readme.txt")))
        .when(kind == 6, F.concat(F.lit("src/m"), number, F.lit(".py")))
        .otherwise(F.concat(F.lit("img"), number, F.lit(".png")))
    )
    body = F.col("text")
    content = (
        F.when(
            kind == 1,
            F.concat(F.lit('#!x\n  """Example '), number, F.lit('.\n\n  More.\n  """\nimport acme\n'), body),
        )
        .when(kind == 6, F.concat(F.lit('"""Module '), number, F.lit('."""\n'), body))
        .otherwise(body)
    )
    return text_table(spark, folder, "documents").select(
        F.lit(BRAND).alias("owner"),
        F.col("lang").alias("repo"),
        doc.alias("position"),
        path.alias("path"),
        content.alias("content"),
    )


def responses(spark: SparkSession, folder: str) -> DataFrame:
    """Model answers in every shape: fenced, bare, partial, broken."""
    rows = messages(spark, folder, text=False)
    number = F.col("source_id").cast("bigint")
    good = F.concat(
        F.lit('{"sentiment_simple": "'), F.coalesce("sentiment_simple", F.lit("neutral")),
        F.lit('", "sentiment_rich": "'), F.coalesce("sentiment_rich", F.lit("curiosity")),
        F.lit('", "content_type": "'), F.coalesce("content_type", F.lit("announcement")),
        F.lit('", "topics": '), F.coalesce("topics", F.lit("[]")), F.lit("}"),
    )
    shape = number % 7
    response = (
        F.when(shape == 0, F.concat(F.lit("Sure:\n```json\n"), good, F.lit("\n```\nDone.")))
        .when(shape == 1, F.concat(F.lit("```\n"), good, F.lit("\n```")))
        .when(shape == 2, F.concat(F.lit("  "), good, F.lit("\n")))
        .when(shape == 3, '{"sentiment_simple": "positive", "content_type": null}')
        .when(shape == 4, F.concat(good, F.lit(" and more")))
        .when(shape == 5, "I cannot tell.")
        .otherwise('["positive"]')
    )
    return rows.select("id", response.alias("response"))


def refetched(stored: DataFrame) -> DataFrame:
    """A batch of later messages, each fetched twice, the second time with another title."""
    late = stored.where(F.col("created_at") >= F.lit("2024-01-10").cast("timestamp_ntz"))
    again = F.explode(F.array(F.lit(0), F.lit(1)))
    return (
        late.withColumn("copy", again)
        .withColumn("fetched_at", F.timestamp_add("HOUR", F.col("copy"), F.col("fetched_at")))
        .withColumn("title", F.when(F.col("copy") == 1, "changed").otherwise(F.col("title")))
        .drop("copy")
    )


def analysis_delta(stored: DataFrame) -> DataFrame:
    """New labels for unlabelled messages, embedding pointers for others, and unknown ids."""
    number = F.col("source_id").cast("bigint")
    unlabelled = F.col("sentiment_simple").isNull()
    known = stored.select(
        F.when(number % 29 == 0, F.concat(F.lit("zz:"), "id")).otherwise(F.col("id")).alias("id"),
        F.when(unlabelled, "positive").alias("sentiment_simple"),
        F.when(unlabelled & (number % 2 == 0), "gratitude").alias("sentiment_rich"),
        F.lit(None).cast("string").alias("content_type"),
        F.when(unlabelled & (number % 3 == 0), F.array().cast("array<string>"))
        .when(unlabelled & (number % 3 == 1), F.array(F.lit("pricing"), F.lit("images")))
        .alias("topics"),
        F.when(F.col("embedding_id").isNull(), F.col("id")).alias("embedding_id"),
    )
    return known


def load_letter_embedder():
    """A stand-in model: counts of frequent letters."""

    def embed(texts: list[str]) -> list[list[float]]:
        return [[float(text.count(letter)) for letter in EMBEDDED_LETTERS] for text in texts]

    return embed


def load_length_classifier():
    """A stand-in model that labels by prompt length and fails on some prompts."""

    def answer(prompts: list[list[dict[str, str]]]) -> list[str]:
        answers = []
        for prompt in prompts:
            size = len(prompt[-1]["content"])
            if size % 11 == 0:
                raise ValueError("no answer")
            label = ("positive", "negative", "neutral")[size % 3]
            answers.append(f'```json\n{{"sentiment_simple": "{label}", "topics": ["pricing"]}}\n```')
        return answers

    return answer


