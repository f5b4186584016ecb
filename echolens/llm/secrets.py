"""Secret scans over a trigram inverted index, with DataFrame functions only.

A rule is a regular expression. From its syntax tree follows a Boolean query over trigrams: what a text must hold for the
rule to match at all, as alternatives of trigrams that all have to occur. The index has one row (``gram``, ``row_key``) for
each text and each trigram that some rule asks for; postings of other trigrams would never be read and would outweigh the
texts. A rule's alternatives are intersected by counting their trigrams for each key, and only texts that come out are
matched with the rule. A rule without mandatory trigrams, such as a run of hexadecimal digits, is matched with every text.

Trigrams are of lower-cased ASCII characters, so that one index serves rules of either case: lower-casing maps each ASCII
character to one ASCII character and keeps neighbours together. It can only add candidates, which the rule then rejects.
The key of a row is a hash of its id and its text. Equal keys can also only add candidates; no result is taken over from
another row.

Matches of a rule are those of its expression, leftmost and not overlapping; those whose ``group`` has fewer than ``least``
code points are dropped afterwards and still use up their text. Spans are in code points, the end exclusive. The index adds
no spans to those of the rules and loses none.

A null text is empty and has no spans; texts of any length are matched whole. Rows are told apart nowhere, so null and
repeated ids and repeated rows keep their rows, each with its own result. An empty table gives no rows. Columns of ``docs``
named like the new ones are replaced; those named like working columns (leading ``__``) must not exist.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product
from re import _constants as op
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echolens.llm.common import cut, stored

#: Keys of candidates beyond which they are joined by shuffle instead of broadcast (24 bytes each).
BROADCAST_KEYS = 2_000_000
#: Sets of strings that the analysis follows; larger ones are cut to what is known so far.
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a Java expression, and the group whose length must be at least ``least`` code points."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The kinds of the contract, in its order. Runs of 24 and more are the runs whose length is 24 or more.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)

Query = frozenset[frozenset[str]]  # alternatives of trigrams that must all occur
ALWAYS: Query = frozenset([frozenset()])


def _simple(alternatives) -> Query:
    """Without alternatives that ask for more than another does."""
    kept = set(alternatives)
    return frozenset(a for a in kept if not any(b < a for b in kept))


def _both(a: Query, b: Query) -> Query:
    return _simple(x | y for x in a for y in b)


def _grams_of(strings) -> Query:
    """What a text holds that contains one of the strings."""
    def grams(text: str) -> frozenset[str]:
        text = text.lower()
        return frozenset(text[i:i + 3] for i in range(len(text) - 2) if text[i:i + 3].isascii())

    return _simple(grams(s) for s in strings)


def _members(items) -> list[str] | None:
    """The characters of a class, None if they are not few and plain."""
    chars: list[str] = []
    for kind, value in items:
        if kind is op.LITERAL:
            chars.append(chr(value))
        elif kind is op.RANGE and value[1] - value[0] < MOST_STRINGS:
            chars += [chr(c) for c in range(value[0], value[1] + 1)]
        else:
            return None
    return chars if len(chars) <= MOST_STRINGS else None


def _analysed(tree) -> tuple[list[str] | None, Query]:
    """The finite set of strings that a sequence matches, or None, and the query that every match meets."""
    known, query, finite = [""], ALWAYS, True

    def flush() -> None:
        nonlocal known, query, finite
        query, known, finite = _both(query, _grams_of(known)), [""], False

    for kind, value in tree:
        strings: list[str] | None = None
        needed = ALWAYS
        if kind is op.LITERAL:
            strings = [chr(value)]
        elif kind is op.IN:
            strings = _members(value)
        elif kind is op.SUBPATTERN:
            strings, needed = _analysed(value[3])
        elif kind is op.BRANCH:
            parts = [_analysed(branch) for branch in value[1]]
            if all(part[0] is not None for part in parts):
                strings = [s for part in parts for s in part[0]]
            else:
                needed = _simple(a for part in parts for a in _both(part[1], _grams_of(part[0] or [""])))
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            least, most, inner = value
            one, of_one = _analysed(inner)
            if most == 1 and one is not None:
                strings = [*one, ""] if least == 0 else one
            elif least:  # whatever is asked once
                needed = _both(of_one, _grams_of(one or [""]))
        elif kind is op.AT:
            strings = [""]
        if strings is None:
            flush()
            query = _both(query, needed)
        elif len(known) * len(strings) > MOST_STRINGS:
            flush()
            known = strings
        else:
            known = [a + b for a, b in product(known, strings)]
    if finite:
        return known, ALWAYS
    return None, _both(query, _grams_of(known))


def trigram_query(pattern: str) -> Query:
    """Alternatives of trigrams, one of which every text with a match holds; ``ALWAYS`` if nothing is mandatory."""
    strings, query = _analysed(_parser.parse(pattern))
    query = query if strings is None else _grams_of(strings)
    return ALWAYS if frozenset() in query else query


def row_key() -> Column:
    return F.xxhash64("doc_id", "text")


def build_index(docs: DataFrame, grams: Sequence[str]) -> DataFrame:
    """Postings of the given trigrams: ``gram`` and the ``row_key`` of each text that holds it, once."""
    low = docs.select(row_key().alias("row_key"), F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(gram)), F.lit(gram)) for gram in grams]))
    return low.select("row_key", F.explode(held).alias("gram")).distinct()


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """``row_key`` and ``kinds``, the rules whose query the postings of the key meet."""
    asked = [(kind, i, gram, len(grams)) for kind, query in queries.items()
             for i, grams in enumerate(sorted(query, key=sorted)) for gram in sorted(grams)]
    terms = index.sparkSession.createDataFrame(asked, "kind string, clause int, gram string, needed int")
    met = index.join(F.broadcast(terms), "gram").groupBy("row_key", "kind", "clause").agg(  # terms: as many as rules ask for
        F.count("*").alias("n"), F.first("needed").alias("needed")
    )
    return met.where("n = needed").groupBy("row_key").agg(F.collect_set("kind").alias("kinds"))


def _prefix_sums(values: Column, base: Column) -> Column:
    """Running totals of an array of numbers, each with ``base`` added."""
    start = F.struct(base.alias("total"), F.array().cast("array<long>").alias("sums"))

    def step(so_far: Column, x: Column) -> Column:
        total = so_far["total"] + x
        return F.struct(total.alias("total"), F.concat(so_far["sums"], F.array(total)).alias("sums"))

    return F.aggregate(values, start, step, lambda so_far: so_far["sums"])


def _located(rows: DataFrame, rule: Rule, order: int, wanted: Column) -> DataFrame:
    """``rows`` with ``__found_<order>``: the rule's spans in ``__text``, empty unless ``wanted``.

    What lies between the matches comes from a split by the same expression, so a span starts where the lengths before
    it end. Lengths are summed in blocks of the square root of their number: appending to one array would copy it each time.
    """
    pattern, text = F.lit(rule.pattern), F.col("__text")
    none = F.array().cast("array<string>")
    found = wanted & F.regexp_like(text, pattern)
    parts = F.struct(
        F.when(found, F.regexp_extract_all(text, pattern, F.lit(0))).otherwise(none).alias("__hits"),
        F.when(found, F.split(text, rule.pattern, -1)).otherwise(none).alias("__gaps"),
        (F.when(found, F.regexp_extract_all(text, pattern, F.lit(rule.group))).otherwise(none) if rule.group else none).alias("__values"),
    )
    rows = rows.select("*", F.inline(F.array(parts)))  # a generator: the matches are not computed again in each lambda
    steps = F.zip_with(F.slice("__gaps", F.lit(1), F.size("__hits")), "__hits", lambda gap, hit: (F.length(gap) + F.length(hit)).cast("long"))
    sizes = F.transform("__hits", lambda hit: F.length(hit).cast("long"))
    long_enough = F.transform(F.col("__values") if rule.group else F.col("__hits"), lambda value: F.length(value) >= rule.least)
    width = F.greatest(F.ceil(F.sqrt(F.size("__hits"))), F.lit(1)).cast("int")
    rows = rows.select(
        *[c for c in rows.columns if c not in ("__hits", "__gaps", "__values")],
        F.inline(F.array(F.struct(steps.alias("__steps"), sizes.alias("__sizes"), long_enough.alias("__counts"), width.alias("__width")))),
    )
    blocks = F.when(F.size("__steps") > 0, F.transform(
        F.sequence(F.lit(0), F.floor((F.size("__steps") - 1) / F.col("__width")).cast("int")),
        lambda b: F.slice("__steps", b * F.col("__width") + 1, F.col("__width")),
    )).otherwise(F.array().cast("array<array<long>>"))
    rows = rows.select(*rows.columns, F.inline(F.array(F.struct(blocks.alias("__blocks")))))
    totals = F.transform("__blocks", lambda block: F.aggregate(block, F.lit(0).cast("long"), lambda a, b: a + b))
    before = F.concat(F.array(F.lit(0).cast("long")), _prefix_sums(totals, F.lit(0).cast("long")))
    rows = rows.select(*rows.columns, F.inline(F.array(F.struct(before.alias("__before")))))
    ends = F.flatten(F.zip_with("__blocks", F.slice("__before", F.lit(1), F.size("__blocks")), _prefix_sums))
    spans = F.filter(
        F.transform(F.arrays_zip(ends.alias("end"), "__sizes", "__counts"), lambda x: F.when(x["__counts"], F.struct(
            (x["end"] - x["__sizes"]).alias("start"), F.lit(order).alias("rule"), x["end"].alias("end"), F.lit(rule.kind).alias("kind"),
        ))),
        lambda span: span.isNotNull(),
    )
    working = ("__steps", "__sizes", "__counts", "__width", "__blocks", "__before")
    return rows.select(*[c for c in rows.columns if c not in working], spans.alias(f"__found_{order}"))


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs`` with ``found``: all spans (start, rule, end, kind) of all rules, by start, then by the order of ``rules``."""
    queries = {rule.kind: trigram_query(rule.pattern) for rule in rules}
    asked = {kind: query for kind, query in queries.items() if query != ALWAYS}
    grams = sorted({gram for query in asked.values() for grams in query for gram in grams})
    kept = [name for name in docs.columns if name != "found"]
    rows = docs.select(*[F.col(f"`{name}`") for name in kept])
    rows = rows.select("*", row_key().alias("__key"), F.coalesce(F.col("text"), F.lit("")).alias("__text"))
    if asked:
        index = stored(build_index(docs.select("doc_id", "text"), grams), "trigrams")
        keys = cut(candidates(index, asked).withColumnsRenamed({"row_key": "__of", "kinds": "__kinds"}))
        keys = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
        rows = rows.join(keys, F.col("__key") == F.col("__of"), "left").drop("__of")
    else:
        rows = rows.withColumn("__kinds", F.array().cast("array<string>"))
    for order, rule in enumerate(rules):
        wanted = F.lit(True) if rule.kind not in asked else F.coalesce(F.array_contains("__kinds", rule.kind), F.lit(False))
        rows = _located(rows, rule, order, wanted)
    found = F.array_sort(F.concat(*[F.col(f"__found_{order}") for order in range(len(rules))]))
    return rows.select(*[F.col(f"`{name}`") for name in kept], found.alias("found"))


def span_text(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
