"""The registered queries in plain SQL, over the same tables, for comparison in another engine."""

from __future__ import annotations

# Fixed values, written out here so that a wrong one in the library does not pass: the brand and the product of the queries,
# the letters that the stand-in model counts, white space, topics, prompts and the words of the relevance rules.
BRAND, PRODUCT = "acme", "Acme"
EMBEDDED_LETTERS = "aeinorst"
_WS = (
    "'\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000'"
)
TOPICS = (
    "gpu_availability", "pricing", "performance", "documentation", "ease_of_use", "reliability", "support", "functions",
    "volumes", "secrets", "images", "scheduling", "web_endpoints", "other",
)
_HEAD = (
    "You answer questions about Acme. Use the excerpts from its documentation and community below where they apply, show "
    "code where it helps, keep to the point, and say when you are not sure.\n\nContext:\n"
)
_TAIL = "\n"
_INSTRUCTION = (
    "You are a support assistant for Acme. Answer correctly and briefly, show code where it helps, and say so when you do "
    "not know."
)
_STRONG = (
    "acme.com", "acme labs", "acme cloud", "acme serverless", "acme.run", "acme deploy", "@acme", "acme.function", "acme.app",
    "acme.cls", "acme.volume", "acme.image", "pip install acme",
)
_FALSE_FRIENDS = (
    "multiacme", "multi-acme", "acme dialog", "acme window", "acme popup", "acme verb", "biacme", "uniacme", "interacme",
)
_CONTEXT = ("serverless", "gpu cloud", "deploy", "container", "python cloud", "inference api")

_NULL = "cast(null as varchar)"
_NOW = "timestamp '2024-01-31 00:00:00'"
_VOICE = "source not in ('docs', 'blog')"
_FRICTION = "sentiment_rich in ('frustration', 'confusion', 'complaint')"


def _case(expression: str, values: tuple[str, ...]) -> str:
    whens = " ".join(f"when {i} then '{value}'" for i, value in enumerate(values))
    return f"case {expression} {whens} end"


def _since(days: int) -> str:
    return f"created_at >= timestamp '2024-01-31 00:00:00' - interval {days} day"


_BASE = f"""
with recursive size as (select count(*) as n from documents),
e as (
  select ev.*, d.text, cast(replace(replace(props, '{{"k": ', ''), '}}', '') as int) as k,
    {_case("user_id % 7", ("github", "hackernews", "reddit", "twitter", "slack", "docs", "blog"))} as src
  from events ev left join documents d on d.doc_id = ev.event_id % (select n from size)),
messages as (
  select
    concat('ev:', event_id) as id, src as source, cast(event_id as varchar) as source_id,
    coalesce(text, '') as content,
    case when event_id % 4 <> 0 then concat(event_type, ' ', k) end as title,
    concat('user', user_id) as author,
    case when event_id % 11 = 0 then 'ftp://example.com/x'
         else concat('https://example.com/m/', event_id) end as url,
    case when event_id % 5 <> 0 then concat('ev:', event_id - event_id % 5) end as parent_id,
    case when event_id % 5 <> 0 then concat('ev:', event_id - event_id % 5) end as thread_id,
    ts as created_at, ts as fetched_at,
    case when event_type <> 'click' then ts end as processed_at,
    concat('{{"num_comments": ', k, ', "points": ', cast(floor(value) as bigint), '}}') as metadata,
    case event_type when 'error' then 'negative' when 'purchase' then 'positive'
                    when 'signup' then 'neutral' when 'view' then 'neutral' end as sentiment_simple,
    case when event_type = 'error' and k < 50 then 'frustration'
         when event_type = 'error' then 'complaint'
         when event_type = 'view' and k < 30 then 'confusion'
         when event_type = 'purchase' then 'delight'
         when event_type <> 'click' then 'neutral' end as sentiment_rich,
    case event_type when 'error' then 'bug_report' when 'view' then 'question'
                    when 'signup' then 'feature_request' when 'purchase' then 'praise' end as content_type,
    case when k >= 95 then null when k % 5 = 0 then '[]' when k % 7 = 0 then '["other"]'
         else concat('["', {_case("k % 14", TOPICS)}, '","', {_case("(k * 3 + 1) % 14", TOPICS)}, '"]') end as topics,
    case when event_id % 3 <> 0 then concat('ev:', event_id) end as embedding_id
  from e),
mentions as (
  select * exclude (topics), unnest(string_split(replace(replace(topics, '["', ''), '"]', ''), '","')) as topic
  from messages where topics <> '[]'),
state as (
  select source, max(created_at) - interval 10 day as last_fetched_at, max(source_id) as last_item_id,
    {_NULL} as cursor, '{{"pages": "3"}}' as metadata
  from messages where source <> 'twitter' group by source),
stored as (
  select concat('vec:', vec_id) as id, coalesce(d.text, '') as text, cast(embedding as double[]) as vector,
    {_case("label % 7", ("docs", "blog", "github", "hackernews", "reddit", "twitter", "slack"))} as source,
    timestamp '2024-01-01' + to_hours(vec_id) as created_at,
    case when vec_id % 3 <> 0 then concat('https://example.com/v/', vec_id) end as url
  from embeddings left join documents d on d.doc_id = vec_id % (select n from size)),
questions as (
  select cast(item_id as varchar) as question_id, text as question, cast(embedding as double[]) as vector
  from benchmark join embeddings on vec_id = item_id % (select count(*) from embeddings)),
queries as (select question_id as query_id, vector from questions),
threads as (
  select concat('conv:', conv_id, ':', turn) as id, 'slack' as source,
    coalesce(case when turn > 0 then concat('conv:', conv_id, ':0') end, concat('conv:', conv_id, ':', turn)) as thread,
    turn, case when role = 'user' and conv_id % 2 = 0 then concat('How ', text, '?') else text end as content,
    case when role = 'user' and conv_id % 3 = 0 then 'question' end as content_type
  from conversations),
docm as (
  select concat('doc:', doc_id) as id,
    {_case("doc_id % 5", ("Getting started with jobs", "The runtime", "Volumes", "Deploy an app", "Tiny"))} as title,
    case when doc_id % 2 = 0 and length(text) > 600 then
      concat('Intro', chr(10), '## How to ', replace(substr(text, 1, 20), chr(10), ' '), chr(10),
             substr(text, 21, 300), chr(10), '# Using ', replace(substr(text, 321, 20), chr(10), ' '), chr(10),
             substr(text, 341))
    else text end as content
  from documents)
"""

_COLUMNS = (
    "id", "source", "source_id", "content", "title", "author", "url", "parent_id", "thread_id", "created_at",
    "fetched_at", "processed_at", "metadata", "sentiment_simple", "sentiment_rich", "content_type", "topics",
    "embedding_id",
)


def _normalised(rows: str, source: str, **columns: str) -> str:
    """Message rows from SQL expressions; columns not given are NULL."""
    given = {
        "source": f"'{source}'", "fetched_at": _NOW, "topics": "'[]'",
        "processed_at": "cast(null as timestamp)", **columns,
    }
    given.setdefault("id", f"concat('{source}:', {given['source_id']})")
    return "select " + ", ".join(f"{given.get(name, _NULL)} as {name}" for name in _COLUMNS) + f" from {rows}"


def _strip_html(text: str) -> str:
    text = f"regexp_replace({text}, '<[^>]+>', '', 'g')"
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " ")):
        text = f"replace({text}, '{entity}', '{char}')"
    return f"trim({text}, {_WS})"


def _clean(text: str) -> str:
    newlines = f"regexp_replace({text}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
    spaces = f"regexp_replace({newlines}, ' {{2,}}', ' ', 'g')"
    return f"trim(regexp_replace({spaces}, '<[^>]+>', '', 'g'), {_WS})"


def _question(title: str) -> str:
    t = f"trim({title}, {_WS})"
    low = f"lower({t})"
    verbs = " or ".join(
        f"starts_with({low}, '{verb}')" for verb in ("create", "build", "deploy", "run", "install", "configure")
    )
    return f"""case when length({t}) < 5 then null
      when ends_with({t}, '?') then {t}
      when starts_with({low}, 'how to') or starts_with({low}, 'getting started') then
        concat('How do I ', replace(replace({low}, 'how to ', ''), 'getting started with ', 'get started with '), '?')
      when starts_with({low}, 'using') or starts_with({low}, 'working with') then
        concat('How do I ', replace(replace({low}, 'using ', 'use '), 'working with ', 'work with '), '?')
      when {verbs} then concat('How do I ', {low}, '?')
      when starts_with({low}, 'the') or starts_with({low}, 'a ') or starts_with({low}, 'an ')
        then concat('What is ', {low}, '?')
      else concat('What is ', {t}, ' in {PRODUCT}?') end"""


_INTS = """
  cast(regexp_extract(metadata, '"num_comments": (-?[0-9]+)', 1) as int) as comments,
  cast(regexp_extract(metadata, '"points": (-?[0-9]+)', 1) as int) as points"""


def _score(sentiment: str) -> str:
    return f"""(case {sentiment} when 'negative' then 4.0::double when 'neutral' then 1.0 else 0.0 end
      + case when {_FRICTION} then 2.0 else 0.0 end
      + case content_type when 'bug_report' then 3.0 when 'feature_request' then 2.0 when 'question' then 1.0 else 0.0 end
      + least(comments / 5.0::double, 3.0) + least(points / 20.0::double, 3.0))"""


_RECENCY = f"greatest(0.0, 2.0 - greatest((epoch_us({_NOW}) - epoch_us(created_at)) / 86400000000.0::double, 0.0) / 7.0)"
_IMPACT = f"round({_score('sentiment_simple')} + {_RECENCY}, 2)"
_EXPLORER_IMPACT = "round(" + _score("coalesce(sentiment_simple, 'neutral')") + ", 2)"
_HAS_REPLY = (
    "exists (select 1 from messages r where r.parent_id = m.id)"
    " or exists (select 1 from messages r where r.thread_id = m.id)"
)


def _counters(*extra: str) -> str:
    columns = [
        *extra,
        *[f"count(*) filter (where sentiment_simple = '{s}') as {s}" for s in ("positive", "negative", "neutral")],
        *[
            f"count(*) filter (where content_type = '{kind}') as {name}"
            for kind, name in (("bug_report", "bug_reports"), ("feature_request", "feature_requests"), ("question", "questions"))
        ],
    ]
    return ", ".join(columns)


_DAILY = "cast(created_at as date) as date"
_BY_SENTIMENT = ", ".join(
    f"count(*) filter (where sentiment_simple = '{s}') as {s}" for s in ("positive", "negative", "neutral")
)
_DAILY_METRICS = f"""select {_DAILY}, source, count(*) as total_messages,
  cast(count(*) filter (where sentiment_simple = 'positive') as int) as positive_count,
  cast(count(*) filter (where sentiment_simple = 'negative') as int) as negative_count,
  cast(count(*) filter (where sentiment_simple = 'neutral') as int) as neutral_count,
  cast(count(*) filter (where sentiment_rich = 'frustration') as int) as frustration_count,
  cast(count(*) filter (where sentiment_rich = 'confusion') as int) as confusion_count,
  cast(count(*) filter (where sentiment_rich = 'delight') as int) as delight_count,
  cast(count(*) filter (where sentiment_rich = 'gratitude') as int) as gratitude_count,
  cast(count(*) filter (where content_type = 'question') as int) as questions_count,
  cast(count(*) filter (where content_type = 'bug_report') as int) as bug_reports_count,
  cast(count(*) filter (where content_type = 'feature_request') as int) as feature_requests_count,
  {_NULL} as top_topics
from {{rows}} where processed_at is not null group by 1, 2"""

_HIGH = f"""
, newest as (
  select *, {_INTS} from messages
  where {_VOICE} and {_since(30)} and (sentiment_simple <> 'neutral' or sentiment_simple is null)),
high as (
  select *, {_IMPACT} as impact_score from newest order by impact_score desc, created_at desc, id limit {{limit}})
"""


def _explore(where: str, after: str = "true") -> str:
    """The explorer's SQL: what messages it takes, and what it filters by the columns it makes."""
    return f""", page as (
      select *, {_INTS} from messages where {where}),
    shown as (
      select id, source, content, author, created_at, coalesce(sentiment_simple, 'neutral') as sentiment,
        sentiment_rich, coalesce(content_type, 'discussion') as content_type, topics, metadata, url, title,
        {_EXPLORER_IMPACT} as impact_score, ({_HAS_REPLY}) as has_reply
      from page m)
    select * from shown where {after}"""


_UNANSWERED = "(content_type = 'question' and not has_reply)"


def _nearest(k: int, measure: str, where: str = "true") -> str:
    return f""", pairs as (
      select query_id, s.id, {measure} as distance from queries q, stored s where {where}),
    ranked as (
      select query_id, id, distance, row_number() over (partition by query_id order by distance, id) as rank from pairs)
    select query_id, cast(rank as int) as rank, id, round({{distance}}, 6) + 0.0 as distance
    from ranked where rank <= {k}"""


_L2 = "list_distance(q.vector, s.vector)"
_TOP = _nearest(10, _L2).format(distance="distance * distance")
_HITS = f""", pairs as (
  select question_id, question, s.id, {_L2} as gap, s.text, s.source, s.url from questions q, stored s),
hits as (
  select *, row_number() over (partition by question_id order by gap, id) as rank from pairs
  qualify rank <= 5),
contexts as (
  select question_id, any_value(question) as question, string_agg(concat('[', rank, '] Source: ', source,
      case when url is not null then concat(chr(10), 'URL: ', url) else '' end, chr(10), text),
    concat(chr(10), chr(10), '---', chr(10), chr(10)) order by rank) as context
  from hits group by question_id)
"""
_LETTERS = ", ".join(
    f"cast(length({{text}}) - length(replace({{text}}, '{c}', '')) as float) as n_{c}" for c in EMBEDDED_LETTERS
)
_LETTER_VECTOR = "[" + ", ".join(
    f"cast(length({{text}}) - length(replace({{text}}, '{c}', '')) as double)" for c in EMBEDDED_LETTERS
) + "]"
_UNIT = "list_transform({v}, lambda x: x / sqrt(list_sum(list_transform({v}, lambda y: y * y))))"

_QUESTION_WORDS = ("how", "why", "what", "when", "where", "can i", "is it possible")
_QA = f"""
, candidates as (select * from threads where length(content) > 100),
first as (
  select *, count(*) over (partition by thread) as size,
    row_number() over (partition by thread order by turn, id) as position
  from candidates),
opening as (
  select * from first where position = 1 and size >= 2
    and (coalesce(content_type = 'question', false) or content like '%?%'
      or {" or ".join(f"lower(content) like '%{word}%'" for word in _QUESTION_WORDS)})),
answers as (
  select *, row_number() over (partition by thread order by turn, id) as answer from first
  where position > 1 and length(content) >= 100 and length(content) - length(replace(content, '?', '')) <= 2),
qa as (
  select concat('thread:', o.thread) as example_id, o.source,
    {_clean("o.content")} as input, {_clean("a.content")} as output
  from opening o join answers a on a.thread = o.thread and a.answer = 1)
"""
_SPACE = "[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_DOCS = f"""
, long as (select * from docm where length(content) >= 200),
found as (
  select *, regexp_extract_all(content, '\\n(#{{1,3}}{_SPACE}+[^\\n]+)', 1) as headers,
    regexp_split_to_array(content, '\\n#{{1,3}}{_SPACE}+') as parts
  from long),
numbered as (select *, unnest(range(1, len(headers) + 1)) as position from found),
sections as (
  select id, cast(position as int) as position,
    trim(ltrim(trim(headers[position], {_WS}), '#'), {_WS}) as header, trim(parts[position + 1], {_WS}) as text
  from numbered),
docs as (
  select concat(id, '#', position) as example_id, 'docs' as source, {_question("header")} as input,
    {_clean("text")} as output
  from sections where length(text) >= 100
  union all
  select concat(id, '#0'), 'docs', {_question("title")}, {_clean("content")}
  from found where len(headers) = 0)
"""
_EXAMPLES = _DOCS + _QA + ", examples as (select * from docs where input is not null union all select * from qa)\n"

_REFETCHED = """
, kept as (select * from messages where created_at < timestamp '2024-01-20'),
fresh as (
  select * from messages where created_at >= timestamp '2024-01-10' and id not in (select id from kept))
"""
_SECOND = "date_trunc('second', ts)"
_REPO = f"concat('{BRAND}_repo', event_id % 3"
_HEADLINE = "concat(event_type, ' ', k)"
_TREE = """
, items as (
  select event_id as id, event_id - event_id % 40 as story_id, event_id % 40 as j,
    case when event_id % 40 > 0 then event_id - event_id % 40 + (event_id % 40 - 1) // 2 end as parent,
    event_id % 40 > 0 and (event_id % 23 = 0 or k = 7) as gone,
    case when event_id % 8 <> 0 then text end as text, concat('user', user_id) as author, ts
  from e),
tree as (
  select i.story_id, i.id, i.parent, 0 as depth from items i where i.parent = i.story_id and not i.gone
  union all
  select i.story_id, i.id, i.parent, t.depth + 1 from tree t join items i on i.parent = t.id
  where not i.gone)
"""
_FEED = f"""
, feed as (
  select *, concat('sub', user_id % 9) as subreddit,
    case when event_id % 3 = 0 then concat('t3_e', event_id) else concat('urn:', event_id) end as entry_id,
    case when event_id % 4 = 0 then concat('Can I ', {_HEADLINE}) else {_HEADLINE} end as title,
    concat('https://example.com/r/x/comments/c', event_id, '/t/') as link,
    concat('<p>', case event_id % 5 when 0 then 'pip install {BRAND} ' when 1 then 'a multi{BRAND} thing '
        when 2 then 'we run {BRAND} in a container ' when 3 then 'just {BRAND} alone '
        else 'using {BRAND} and {BRAND}.com, ' end,
      '&amp; <b>more</b> &lt;x&gt;</p>', text) as html
  from e where event_id % 17 <> 0)
"""


def _relevant(content: str) -> str:
    def any_of(words: tuple[str, ...]) -> str:
        return "(" + " or ".join(f"contains(body, '{word}')" for word in words) + ")"

    return f"""(select case when {any_of(_STRONG)} then true when {any_of(_FALSE_FRIENDS)} then false
      else contains(concat(' ', body, ' '), ' {BRAND} ') and {any_of(_CONTEXT)} end
      from (select lower(concat(title, ' ', {content})) as body))"""


_FILES = f"""
, files as (
  select lang as repo, doc_id as position, doc_id % 8 as kind,
    case doc_id % 8 when 0 then concat('d', doc_id, '/README.md') when 1 then concat('examples/e', doc_id, '.py')
      when 2 then concat('tests/Test_', doc_id, '.py') when 3 then concat('pkg', doc_id, '/__init__.py')
      when 4 then concat('setup', doc_id, '.py') when 5 then concat('a/b', doc_id, '/readme.txt')
      when 6 then concat('src/m', doc_id, '.py') else concat('img', doc_id, '.png') end as path,
    case doc_id % 8 when 1 then concat('#!x', chr(10), '  \"\"\"Example ', doc_id, '.', chr(10), chr(10), '  More.', chr(10),
        '  \"\"\"', chr(10), 'import {BRAND}', chr(10), text)
      when 6 then concat('\"\"\"Module ', doc_id, '.\"\"\"', chr(10), text) else text end as content
  from documents),
kept as (
  select * from (
    select * from files where kind in (0, 1, 5, 6))
  where length(content) >= 100),
extracted as (
  select *, case kind
      when 1 then concat('Example ', position, '.', chr(10), chr(10), '  More.', chr(10), chr(10), chr(10),
        '--- Code Example: ', path, ' ---', chr(10), chr(10), content)
      when 6 then concat('Module ', position, '.') end as doc
  from files)
"""
_PAGE_PATH = "regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)"


def _page_text(markup: str, glue: str) -> str:
    nodes = f"regexp_split_to_array({markup}, '</?[A-Za-z!][^>]*>')"
    decoded = "regexp_replace(replace(x, '&quot;', '\"'), '&amp;?', '&', 'g')"
    return f"list_aggregate(list_filter(list_transform({nodes}, lambda x: trim({decoded}, {_WS})), lambda x: x <> ''), 'string_agg', {glue})"


_PAGES = f"""
, markup as (
  select page_id, url, regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', '', 'g') as html
  from pages),
texts as (
  select page_id, url, coalesce({_page_text("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)", "''")}, '') as title,
    {_page_text("regexp_extract(html, '(?is)<article[^>]*>(.*)</article>', 1)", "chr(10)")} as content
  from markup)
"""

_UPDATED = """
, fields as (
  select *, cast(source_id as bigint) as n, sentiment_simple is null as bare, cast(source_id as bigint) % 29 <> 0 as hit
  from messages)
"""
_UPDATE = f"""select id, source, source_id, content, title, author, url, parent_id, thread_id, created_at, fetched_at,
  case when hit and bare then {_NOW} else processed_at end as processed_at, metadata,
  case when hit and bare then 'positive' else sentiment_simple end as sentiment_simple,
  case when hit and bare and n % 2 = 0 then 'gratitude' else sentiment_rich end as sentiment_rich, content_type,
  case when hit and bare and n % 3 = 0 then '[]' when hit and bare and n % 3 = 1 then '["pricing","images"]'
       when hit then coalesce(topics, '[]') else topics end as topics,
  case when hit then coalesce(embedding_id, id) else embedding_id end as embedding_id
from fields"""

_PROMPT_LENGTH = "(length(content) + length('Analyze this message:') + 2)"
_LABEL = f"case {_PROMPT_LENGTH} % 3 when 0 then 'positive' when 1 then 'negative' else 'neutral' end"
_QUEUE = f"""
, queue as (
  select id, {_LABEL} as label from (
    select * from messages where sentiment_simple is null and {_VOICE})
  where {_PROMPT_LENGTH} % 11 <> 0),
labelled as (
  select m.* exclude (sentiment_simple, sentiment_rich, content_type, processed_at),
    coalesce(label, sentiment_simple) as sentiment_simple,
    case when label is not null then 'neutral' else sentiment_rich end as sentiment_rich,
    case when label is not null then 'discussion' else content_type end as content_type,
    case when label is not null then {_NOW} else processed_at end as processed_at
  from messages m left join queue using (id))
"""


def _unanswered(days: int, voice: bool) -> str:
    return f"""from messages m where content_type = 'question' and {_since(days)}
      and {_VOICE if voice else "true"} and not ({_HAS_REPLY})"""


# Columns and types of the tables.
_TABLE_COLUMNS = {
    "messages": """id string, source string, source_id string, content string, title string, author string, url string,
        parent_id string, thread_id string, created_at timestamp_ntz, fetched_at timestamp_ntz, processed_at timestamp_ntz,
        metadata string, sentiment_simple string, sentiment_rich string, content_type string, topics string, embedding_id string""",
    "ingestion_state": "source string, last_fetched_at timestamp_ntz, last_item_id string, cursor string, metadata string",
    "embeddings": """id string, text string, vector array<float>, source string, created_at timestamp_ntz, url string,
        metadata struct<title:string>""",
}
_CATALOG = ", ".join(
    f"('{table}', {position}, '{column.split()[0]}', '{column.split()[1]}')"
    for table, columns in _TABLE_COLUMNS.items()
    for position, column in enumerate(columns.split(","), 1)
)

_CELL_HITS = f""", units as (
          select label, {_UNIT.format(v="cast(embedding as double[])")} as u from embeddings),
        means as (select label, i, avg(u[i]) as m from units, (select unnest(range(1, 65)) as i) group by all),
        centres as (select label, list(m order by i) as c from means group by label),
        celled as (
          select id, vector, arg_min(label, list_distance(u, c)) as cell
          from (select id, vector, {_UNIT.format(v="vector")} as u from stored), centres group by id, vector),
        probed as (
          select query_id, vector, label from (select query_id, vector, {_UNIT.format(v="vector")} as u from queries), centres
          qualify row_number() over (partition by query_id order by list_distance(u, c), label) <= 4),
        pairs as (
          select query_id, id, 1.0 - list_cosine_similarity(p.vector, s.vector) as distance
          from probed p join celled s on s.cell = p.label),
        ranked as (
          select *, row_number() over (partition by query_id order by distance, id) as rank from pairs qualify rank <= 10)
        select query_id, cast(rank as int) as rank, id, round(distance, 6) + 0.0 as distance from ranked"""
_UPSERTED = """select id, text, source, created_at, cast(vector[1] as float) as first from stored
        where source not in ('docs', 'blog') union all
        select id, text, 'slack', created_at + interval 1 day, cast(vector[len(vector)] as float) from stored
        where source in ('docs', 'blog')"""
_BODIES = {
    "voice_stats": f"select {_counters('count(*) as total_messages')} from messages where {_VOICE}",
    "positive_pct": f"""select round(100.0 * count(*) filter (where sentiment_simple = 'positive') / count(*), 6)
        as positive_pct from messages where {_VOICE}""",
    "new_bug_reports": f"""select count(*) as new_bug_reports from messages
        where {_VOICE} and content_type = 'bug_report' and {_since(7)}""",
    "summary_stats": f"""select {_counters('count(*) as total_messages', 'count(distinct source) as sources')}
        from messages where {_since(7)}""",
    "sentiment_over_time": f"""select {_DAILY}, sentiment_simple, count(*) as count from messages
        where {_since(30)} group by 1, 2""",
    "sentiment_over_time_source": f"""select {_DAILY}, sentiment_simple, count(*) as count from messages
        where {_since(7)} and source = 'github' group by 1, 2""",
    "sentiment_daily": f"select {_DAILY}, {_BY_SENTIMENT} from messages where {_since(30)} group by 1",
    "sentiment_moving_avg": f""", daily as (
        select {_DAILY}, {_BY_SENTIMENT} from messages where {_VOICE} and {_since(30)} group by 1)
        select date, {", ".join(f"round(avg({s}) over w, 6) as {s}" for s in ("positive", "negative", "neutral"))}
        from daily window w as (order by date rows between 2 preceding and current row)""",
    "topic_distribution": f"""select topic, count(*) as count from mentions where {_since(7)}
        group by 1 order by 2 desc, 1 limit 20""",
    "topic_distribution_source": f"""select topic, count(*) as count from mentions
        where {_since(30)} and source = 'reddit' group by 1 order by 2 desc, 1 limit 20""",
    "top_topics": f"""select topic, count(*) as count from mentions where {_VOICE}
        group by 1 order by 2 desc, 1 limit 10""",
    "topic_counts": "select topic, count(*) as count from mentions group by 1",
    "negative_by_topic": """select topic, count(*) as negative_count from mentions
        where sentiment_simple = 'negative' group by 1""",
    "pain_points": f"""select topic, count(*) as mentions,
          count(*) filter (where sentiment_simple = 'negative') as negative_mentions,
          count(*) filter (where {_FRICTION}) as friction_mentions
        from mentions where {_VOICE} and {_since(30)} group by 1
        order by negative_mentions + friction_mentions desc, mentions desc, topic limit 8""",
    "source_counts": f"select source, count(*) as count from messages where {_VOICE} group by 1",
    "by_source": "select source, count(*) as count from messages group by 1",
    "total_messages": "select count(*) as total from messages",
    "by_sentiment": """select sentiment_simple, count(*) as count from messages
        where sentiment_simple is not null group by 1""",
    "sentiment_coverage": """select coalesce(sentiment_simple, 'unlabeled') as sentiment, count(*) as count
        from messages group by 1""",
    "corpus_split": f"""select count(*) filter (where not ({_VOICE})) as knowledge_messages,
          count(*) filter (where {_VOICE}) as voice_messages from messages""",
    "processing_snapshot": f"""select count(*) as total_messages, count(*) filter (where {_VOICE}) as voice_messages,
          count(*) filter (where not ({_VOICE})) as knowledge_messages,
          count(*) filter (where processed_at is not null) as processed,
          count(*) filter (where embedding_id is not null) as embedded,
          count(*) filter (where embedding_id is null) as pending_embeddings,
          count(*) filter (where sentiment_simple is null) as pending_sentiment from messages""",
    "daily_metrics": _DAILY_METRICS.format(rows="messages"),
    "source_freshness": """select source, count(*) as total, max(created_at) as latest_message_at,
          any_value(last_fetched_at) as last_fetched_at
        from messages left join (select source, last_fetched_at from state) using (source) group by 1""",
    "get_messages": """select * from messages where source = 'github' and created_at >= timestamp '2024-01-10'
          and created_at <= timestamp '2024-01-25' and sentiment_simple = 'negative'
        order by created_at desc, id limit 50 offset 20""",
    "limit_per_run": "select * from messages order by created_at desc, id limit 200",
    "sample_rows": "select id, title from messages order by id limit 5",
    "facets": """select distinct 'source' as facet, source as value from messages
        union all select distinct 'sentiment_simple', sentiment_simple from messages where sentiment_simple is not null
        union all select distinct 'content_type', content_type from messages where content_type is not null""",
    "facet_topics": "select distinct topic from mentions",
    "recent_voice": f"""select id, title, source, sentiment_simple, created_at from messages
        where {_VOICE} and title is not null order by created_at desc, id limit 6""",
    "recent_negative": f"""select id, title, source, sentiment_simple, created_at from messages
        where sentiment_simple = 'negative' and {_since(7)} order by created_at desc, id limit 20""",
    "recent_questions": f"""select id, title, source, created_at, url from messages
        where content_type = 'question' and {_since(30)} order by created_at desc, id limit 20""",
    "uncategorized": f"""select id, title, content, source, created_at, sentiment_simple, url from messages
        where {_VOICE} and {_since(7)} and (topics is null or topics = '[]' or topics like '%"other"%')
        order by created_at desc, id limit 20""",
    "uncategorized_cards": f"""select id,
          substr(coalesce(nullif(title, ''), substr(content, 1, 100)), 1, 120) as title, source, created_at,
          coalesce(sentiment_simple, 'unknown') as sentiment_simple,
          case when url like 'http://%' or url like 'https://%' then url else '#' end as url
        from messages
        where {_VOICE} and {_since(30)} and (topics is null or topics = '[]' or topics like '%"other"%')
        order by created_at desc, id limit 20""",
    "preview": f"""select id,
          case when length(trim(content, {_WS})) > 220
               then concat(rtrim(substr(trim(content, {_WS}), 1, 220), {_WS}), '...')
               else trim(content, {_WS}) end as preview,
          concat(upper(substr(source, 1, 1)), substr(source, 2)) as source_label,
          case when url like 'http://%' or url like 'https://%' then url else '#' end as safe_url
        from messages""",
    "high_impact": _HIGH.format(limit=8) + """select id, title, content, source, created_at, sentiment_simple,
          sentiment_rich, content_type, metadata, url, impact_score from high""",
    "high_impact_cards": _HIGH.format(limit=6) + """select id, substr(coalesce(title, content), 1, 140) as title,
          source, created_at, coalesce(sentiment_simple, 'unknown') as sentiment_simple,
          case when url like 'http%' then url else '#' end as url, impact_score from high""",
    "impact_score_shredded": f"select id, {_IMPACT} as impact_score from (select *, {_INTS} from messages)",
    "impact_score_explorer_shredded": f"select id, {_EXPLORER_IMPACT} as impact_score from (select *, {_INTS} from messages)",
    "impact_score": f"select id, {_IMPACT} as impact_score from (select *, {_INTS} from messages)",
    "impact_score_explorer": f"select id, {_EXPLORER_IMPACT} as impact_score from (select *, {_INTS} from messages)",
    "explore": _explore(
        f"{_VOICE} and {_since(7)} and (lower(content) like '%re%' or lower(coalesce(title, '')) like '%re%')"
    ),
    "explore_filtered": _explore(
        "source in ('docs', 'github') and sentiment_simple in ('negative', 'neutral') "
        "and content_type in ('question', 'bug_report')"
    ),
    "explore_topic": _explore(f"{_VOICE} and {_since(30)}", """topics like '%"pricing"%' or topics like '%"images"%'"""),
    "explore_triage": _explore(
        _VOICE, f"content_type in ('bug_report', 'feature_request') or {_UNANSWERED} or impact_score >= 6.0"
    ),
    "explore_unanswered": _explore(f"{_VOICE} and {_since(30)}", _UNANSWERED),
    "explore_sorted": _explore(f"{_VOICE} and {_since(7)}"),
    "explore_impact": _explore(_VOICE, "impact_score >= 6.0"),
    "unanswered_questions": f"""select id, title, source, created_at, url {_unanswered(30, False)}
        order by created_at desc, id limit 50""",
    "stored_unanswered": f"""select id, title, source, created_at, url {_unanswered(30, False)}
        order by created_at desc, id limit 50""",
    "stored_has_reply": f"select id, ({_HAS_REPLY}) as has_reply from messages m",
    "unanswered_voice": f"select id, title, source, created_at, url {_unanswered(30, True)}",
    "unanswered_count": f"select count(*) as unanswered_questions {_unanswered(7, True)}",
    "has_reply": f"select id, ({_HAS_REPLY}) as has_reply from messages m",
    "since_filter": """select id, source, created_at
        from messages left join (select source, last_fetched_at from state) using (source)
        where last_fetched_at is null or created_at >= last_fetched_at""",
    "insert_if_absent": _REFETCHED + """select * from kept union all
        select * replace (coalesce(topics, '[]') as topics) from fresh""",
    "stored_insert": _REFETCHED + """select * from kept union all
        select * replace (coalesce(topics, '[]') as topics) from fresh""",
    "rollup_after_changes": _UPDATED + _DAILY_METRICS.format(rows=f"(select * from ({_UPDATE}) where source <> 'github')"),
    "stored_merge": _UPDATED + _UPDATE,
    "stored_queues": _UPDATED + f"""select 'embedding' as queue, id from ({_UPDATE}) where embedding_id is null
        union all select 'sentiment', id from ({_UPDATE}) where sentiment_simple is null and {_VOICE}""",
    "stored_reset": _UPDATED + f"select * replace ({_NULL} as embedding_id) from ({_UPDATE})",
    "stored_clear_source": _UPDATED + f"""select * from ({_UPDATE}) where source <> 'github' union all
        select * replace (coalesce(topics, '[]') as topics) from messages where source = 'github'""",
    "new_message_count": _REFETCHED + "select count(*) as new_messages from fresh",
    "ingest_state_after": f"""select * from state where source <> 'github' union all
        select 'github', {_NOW}, arg_max(id, row(made_at, id)), {_NULL}, concat('{{"inserted":', count(*), '}}')
        from (select {_REPO}, '_issue_', event_id) as id, {_SECOND} as made_at from e where event_id % 13 <> 0)
        where made_at >= (select last_fetched_at from state where source = 'github')""",
    "saved_lines": _EXAMPLES + "select count(*) as lines from examples",
    "landed_rejects": """select concat('{"number": ', event_id) as value from events where event_id % 10 = 0""",
    "replace_by_key": f"""select * from state where source <> 'github' union all
        select source, max(created_at), {_NULL}, 'next', '{{}}' from messages
        where source in ('github', 'twitter') group by source""",
    "ingestion_state": "select * replace ('3' as metadata) from state where source = 'reddit'",
    "update_analysis": _UPDATED + _UPDATE,
    "embedding_queue": "select * from messages where embedding_id is null",
    "sentiment_queue": f"""select * from messages where sentiment_simple is null and {_VOICE}""",
    "reset_embeddings": f"select * replace ({_NULL} as embedding_id) from messages",
    "clear_source": "select * from messages where source <> 'github'",
    "cleared_counts": """select 'messages' as table_name, count(*) as deleted from messages where source = 'github'
        union all select 'ingestion_state', count(*) from state where source = 'github'
        union all select 'vectors', count(*) from stored where source = 'github'""",
    "norm_github_issues": _normalised(
        "e where event_id % 13 <> 0", "github",
        source_id=f"{_REPO}, '_issue_', event_id)",
        content=f"concat({_HEADLINE}, chr(10), chr(10), case when event_id % 5 <> 0 then text else '' end)",
        title=_HEADLINE, author="concat('user', user_id)", url="concat('https://example.com/i/', event_id)",
        created_at=_SECOND,
        content_type="""case event_type when 'error' then 'bug_report' when 'signup' then 'feature_request'
            when 'view' then 'question' when 'click' then 'bug_report' else 'discussion' end""",
        metadata=f"""concat('{{"repo":"{BRAND}/repo', event_id % 3, '","type":"issue","number":', event_id,
            ',"state":"', case when event_id % 2 = 0 then 'open' else 'closed' end, '","labels":',
            case event_type when 'error' then '["bug","p1"]' when 'signup' then '["enhancement"]'
              when 'view' then '["help-wanted"]' when 'click' then '["question","bug-report"]' else '["misc"]' end,
            ',"reactions":', case when event_id % 4 <> 0 then concat('{{"total_count":', k, '}}') else '{{}}' end, '}}')""",
    ),
    "norm_github_comments": _normalised(
        "e", "github",
        source_id=f"{_REPO}, '_issue_', event_id - event_id % 5, '_comment_', event_id)",
        content="case when event_id % 6 <> 0 then text else '' end",
        author="concat('user', user_id)", url="concat('https://example.com/c/', event_id)",
        parent_id=f"concat('github:', {_REPO}, '_issue_', event_id - event_id % 5))",
        thread_id=f"concat('github:', {_REPO}, '_issue_', event_id - event_id % 5))",
        created_at=_SECOND,
        metadata=f"""concat('{{"repo":"{BRAND}/repo', event_id % 3, '","type":"issue_comment","issue_number":',
            event_id - event_id % 5, '}}')""",
    ),
    "norm_github_discussions": _normalised(
        "e", "github",
        source_id=f"{_REPO}, '_discussion_', event_id)",
        content=f"concat({_HEADLINE}, chr(10), chr(10), text)", title=_HEADLINE,
        author="concat('user', user_id)", url="concat('https://example.com/d/', event_id)", created_at=_SECOND,
        content_type="""case event_type when 'error' then 'question' when 'view' then 'question'
            when 'signup' then 'feature_request' when 'click' then 'discussion' else 'announcement' end""",
        metadata=f"""concat('{{"repo":"{BRAND}/repo', event_id % 3, '","type":"discussion","number":', event_id,
            ',"category":"', case event_type when 'error' then 'q&a' when 'view' then 'open questions'
              when 'signup' then 'ideas' when 'click' then '' else 'announcements' end, '"}}')""",
    ),
    "norm_github_discussion_comments": _normalised(
        "e, (values ('a'), ('b')) as c(part)", "github",
        source_id=f"{_REPO}, '_discussion_', event_id, '_comment_DC_', part, event_id)",
        content=f"case part when 'a' then text else {_HEADLINE} end",
        author="concat('user', user_id)", url="concat('https://example.com/dc/', event_id)",
        parent_id=f"concat('github:', {_REPO}, '_discussion_', event_id))",
        thread_id=f"concat('github:', {_REPO}, '_discussion_', event_id))",
        created_at=_SECOND,
        metadata=f"""concat('{{"repo":"{BRAND}/repo', event_id % 3,
            '","type":"discussion_comment","discussion_number":', event_id, '}}')""",
    ),
    "norm_hn_stories": _normalised(
        "e", "hackernews",
        source_id="concat('story_', event_id)",
        content=f"case when event_id % 2 = 1 and text <> '' then concat({_HEADLINE}, chr(10), chr(10), text) else {_HEADLINE} end",
        title=_HEADLINE, author="concat('user', user_id)",
        url="""case when event_id % 7 in (0, 1) then concat('https://news.ycombinator.com/item?id=', event_id)
            else concat('https://example.com/s/', event_id) end""",
        created_at=_SECOND, content_type="'discussion'",
        metadata="""concat('{"points":', cast(floor(value) as bigint), ',"num_comments":',
            case when event_id % 9 <> 0 then k else 0 end,
            ',"hn_url":"https://news.ycombinator.com/item?id=', event_id, '"}')""",
    ),
    "hn_comment_tree": _TREE + "select story_id, id, parent, cast(depth as int) as depth from tree",
    "norm_hn_comments": _TREE + _normalised(
        "(select t.*, i.text, i.author, i.ts from tree t join items i using (id))", "hackernews",
        source_id="concat('comment_', id)", content="coalesce(text, '')", author="author",
        url="concat('https://news.ycombinator.com/item?id=', id)",
        parent_id="""case when parent <> story_id and parent <> 0 then concat('hackernews:comment_', parent)
            else concat('hackernews:story_', story_id) end""",
        thread_id="concat('hackernews:story_', story_id)", created_at=_SECOND,
        metadata="concat('{\"story_id\":', story_id, '}')",
    ),
    "norm_reddit_posts": _normalised(
        f"""(select *, case event_id % 6 when 0 then concat({_HEADLINE}, '?') when 1 then concat('Show ', {_HEADLINE})
            else {_HEADLINE} end as headline from e)""", "reddit",
        source_id="concat('post_p', event_id)",
        content="case when event_id % 3 = 0 or text = '' then headline else concat(headline, chr(10), chr(10), text) end",
        title="headline", author="concat('user', user_id)",
        url="concat('https://reddit.com/r/x/comments/p', event_id)", created_at=_SECOND,
        content_type="case when event_id % 6 in (0, 1) then 'question' else 'discussion' end",
        metadata="""concat('{"subreddit":"sub', user_id % 9, '","score":', case when event_id % 10 <> 0 then k - 20 else 0 end,
            ',"num_comments":', k, ',"upvote_ratio":0.0,"flair":', case when event_id % 4 = 0 then '"Help"' else 'null' end, '}')""",
    ),
    "norm_reddit_comments": _normalised(
        "e, (values ('a'), ('b')) as c(part) where (part = 'a' and text <> '') or (part = 'b' and event_id % 2 = 0)",
        "reddit",
        source_id="concat('comment_', part, event_id)",
        content=f"case part when 'a' then text else {_HEADLINE} end", author="concat('user', user_id)",
        url="concat('https://reddit.com/c/', part, event_id)",
        parent_id="concat('reddit:post_p', event_id)", thread_id="concat('reddit:post_p', event_id)",
        created_at=_SECOND,
        metadata="""concat('{"subreddit":"sub","score":', k, ',"post_id":"p', event_id, '"}')""",
    ),
    "norm_atom_entries": _FEED + f"""select subreddit, entry_id, title, link, trim(html, {_WS}) as content,
          case when event_id % 12 = 0 then 'soon' else strftime({_SECOND}, '%Y-%m-%dT%H:%M:%SZ') end as updated,
          concat('user', user_id) as author from feed""",
    "relevance_filter": _FEED + f"select entry_id, {_relevant('html')} as relevant from feed",
    "norm_atom": _FEED + _normalised(
        f"""(select *, {_strip_html("html")} as stripped from feed where {_relevant(_strip_html("html"))})""", "reddit",
        source_id="case when event_id % 3 = 0 then concat('post_e', event_id) else concat('post_c', event_id) end",
        content="concat(title, chr(10), chr(10), stripped)", title="title", author="concat('user', user_id)", url="link",
        created_at=f"case when event_id % 12 = 0 then {_NOW} else {_SECOND} end",
        content_type="case when event_id % 4 = 0 then 'question' else 'discussion' end",
        metadata="""concat('{"subreddit":"', subreddit, '","via":"rss"}')""",
    ),
    "strip_html": f"select page_id, {_strip_html('html')} as stripped from pages",
    "doc_file_filter": _FILES + "select repo, position, path from kept",
    "python_doc_extract": _FILES + "select position, doc as content from extracted where ends_with(path, '.py')",
    "doc_file_to_message": _FILES + _normalised(
        """(select k.*, coalesce(x.doc, k.content) as body from kept k join extracted x using (repo, position))""", "docs",
        source_id=f"concat('github_{BRAND}_', repo, '_', replace(path, '/', '_'))", content="body",
        title="regexp_extract(path, '[^/]*$')",
        url=f"concat('https://github.com/{BRAND}/', repo, '/blob/main/', path)", created_at=_NOW,
        content_type="'documentation'",
        metadata=f"""concat('{{"repo":"{BRAND}/', repo, '","path":"', path, '","type":"github_file"}}')""",
    ),
    "page_extract": _PAGES + "select page_id, title, content from texts where length(content) >= 100",
    "page_to_message": _PAGES + _normalised(
        "texts where length(content) >= 100", "blog",
        id=f"concat('docs:', coalesce(nullif(replace(trim({_PAGE_PATH}, '/'), '/', '_'), ''), 'index'))",
        source_id=f"coalesce(nullif(replace(trim({_PAGE_PATH}, '/'), '/', '_'), ''), 'index')",
        content="content", title="title", url="url", created_at=_NOW, content_type="'documentation'",
        metadata=f"""concat('{{"is_docs":false,"section":',
            case when len(string_split({_PAGE_PATH}, '/')) > 2 then concat('"', string_split({_PAGE_PATH}, '/')[3], '"')
                 else 'null' end, '}}')""",
    ),
    "extract_links": """, links as (
        select regexp_extract(url, '^https?://[^/?#]*') as origin, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as href
        from pages)
        select distinct concat(origin, replace(href, '&amp;', '&')) as link from links where href like '%/%' and href <> '/'""",
    "crawlable_url": f"""select page_id, regexp_extract(url, '^https?://([^/?#]*)', 1) = 'blog.tionsh.example.com'
          and starts_with({_PAGE_PATH}, '/en') and not regexp_matches(url, '#.')
          and not regexp_matches({_PAGE_PATH}, '[.](png|jpg|gif|pdf|zip)$') as crawlable from pages""",
    "vector_topk": _TOP,
    "vector_topk_blocked": _TOP,
    "vector_topk_filtered": _nearest(
        5, _L2, "s.source = 'github' and s.created_at >= timestamp '2024-01-10'"
    ).format(distance="distance * distance"),
    "cosine_topk": _nearest(10, "1.0 - list_cosine_similarity(q.vector, s.vector)").format(distance="distance"),
    "cell_topk": _CELL_HITS,
    "ivf_topk": _CELL_HITS,
    "upsert_vectors": _UPSERTED,
    "stored_upsert": _UPSERTED,
    "vector_counts": "select source, count(*) as count from stored group by 1",
    "vector_by_id": "select id, text, source, created_at, url from stored where id = 'vec:7'",
    "rag_retrieve": _HITS + """select question_id, cast(rank as int) as rank, id,
          round(gap * gap, 6) + 0.0 as distance, text, source, url from hits""",
    "rag_context": _HITS + "select question_id, context from contexts",
    "rag_sources": _HITS + """select question_id, true as used_rag,
          string_agg(concat(source, '|', coalesce(url, ''), '|', text), chr(10) order by rank) as sources
        from hits group by 1""",
    "rag_prompts": _HITS + f"""select question_id,
          concat('system|', '{_HEAD}', context, '{_TAIL}', chr(10), 'user|', question) as messages
        from contexts""",
    "embed_batch": f"""select id, content as text, source, created_at, url, title,
          {_LETTERS.format(text="content")} from messages""",
    "search_text": f""", asked as (
          select question_id as query_id, {_LETTER_VECTOR.format(text="question")} as vector from questions),
        kept as (select id, {_LETTER_VECTOR.format(text="content")} as vector from messages),
        pairs as (select query_id, s.id, {_L2} as distance from asked q, kept s),
        ranked as (
          select *, row_number() over (partition by query_id order by distance, id) as rank from pairs qualify rank <= 5)
        select query_id, cast(rank as int) as rank, id, round(distance * distance, 6) + 0.0 as distance from ranked""",
    "sentiment_prompts": """select id, concat('system|Classify.', chr(10), 'user|Analyze this message:', chr(10), chr(10),
          content) as prompt from messages""",
    "classify": f"""select id, case when {_PROMPT_LENGTH} % 11 = 0 then 'neutral' else {_LABEL} end as sentiment_simple,
          'neutral' as sentiment_rich, 'discussion' as content_type,
          case when {_PROMPT_LENGTH} % 11 = 0 then '' else 'pricing' end as topics from messages""",
    "classify_skip": f"""select id, {_LABEL} as sentiment_simple, 'neutral' as sentiment_rich,
          'discussion' as content_type, 'pricing' as topics from messages where {_PROMPT_LENGTH} % 11 <> 0""",
    "parse_responses": """select id,
          case when n % 7 < 3 then coalesce(sentiment_simple, 'neutral') when n % 7 = 3 then 'positive' else 'neutral' end
            as sentiment_simple,
          case when n % 7 < 3 then coalesce(sentiment_rich, 'curiosity') else 'neutral' end as sentiment_rich,
          case when n % 7 < 3 then coalesce(content_type, 'announcement') else 'discussion' end as content_type,
          case when n % 7 < 3 and topics <> '[]'
               then replace(replace(replace(topics, '["', ''), '"]', ''), '","', ',') else '' end as topics
        from (select *, cast(source_id as bigint) as n from messages)""",
    "embedding_job": """, queue as (
          select id from messages where embedding_id is null)
        select m.* replace (
            coalesce(m.embedding_id, q.id) as embedding_id,
            case when q.id is not null then coalesce(topics, '[]') else topics end as topics)
        from messages m left join queue q on q.id = m.id""",
    "sentiment_job": _QUEUE + _DAILY_METRICS.format(rows="labelled"),
    "doc_sections": _DOCS + "select * from sections where length(text) >= 100",
    "doc_examples": _DOCS + "select * from docs where input is not null",
    "title_to_question": f"""select doc_id, {_question("title")} as question from (
          select doc_id, concat(case doc_id % 7 when 0 then '' when 1 then 'How to ' when 2 then 'Using '
              when 3 then 'Deploy ' when 4 then 'The ' when 5 then 'Getting started with ' else 'working with ' end,
            split_part(text, chr(10), 1), case when doc_id % 11 = 0 then '?' else '' end) as title
          from documents)""",
    "clean_content": f"""select doc_id, {_clean("spaced")} as content from (
          select doc_id, replace(replace(text, '. ', '.   <b>'), chr(10), repeat(chr(10), 4)) as spaced from documents)""",
    "qa_pairs": _QA + "select * from qa",
    "chat_examples": _EXAMPLES + f"""select example_id, concat('system|', '{_INSTRUCTION}', chr(10),
          case when input <> '' then concat('user|', input, chr(10)) else '' end, 'assistant|', output) as messages
        from examples""",
    "train_val_split": _EXAMPLES + """select example_id, case when row_number() over (order by
            md5(concat('42:', example_id)), example_id) <= floor(0.9 * (select count(*) from examples))
          then 'train' else 'val' end as split from examples""",
    "safe_query": """select cast(created_at as date) as day, count(*) as n from messages group by 1
        having count(*) > 10""",
    "describe_tables": f"""select * from (values {_CATALOG}) as c(table_name, position, column_name, data_type)
        join (select 'messages' as table_name, count(*) as row_count from messages union all
              select 'ingestion_state', count(*) from state union all
              select 'embeddings', count(*) from stored) using (table_name)""",
}


def all_sql() -> dict[str, str]:
    """SQL per query name. The approximate search has none."""
    return {name: _BASE + body for name, body in _BODIES.items()}
