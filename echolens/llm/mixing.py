"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Every source has a weight; together the sources share the words of the whole table. A source's target stops at
``epochs`` times its size, and what it cannot take goes to the others by weight until none is above its cap.

A source with target t and size s repeats every document floor(t / s) times. The words still missing are one more
repetition of the documents that come first by a seeded hash of their ids; the last of them is repeated in part, so that the taken words
meet the rounded target. Where that is a group of rows of one id, each row takes its share of the missing words, rounded
down.

Sizes count words, runs of other characters than white space; a null or empty text has none and takes none. A null
source is a source of its own, the last. A null id hashes like the text "null". Repeated rows are documents of their
own. Columns named like the new ones are replaced. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echolens.llm.common import cut, stored

WORD = r"[^\x20\x09-\x0D]+"
#: Plans of more sources are joined by shuffle instead of broadcast.
BROADCAST_SOURCES = 50_000
_DIGITS = 3  # hexadecimal digits of the hash that one histogram resolves


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))


def source_weights(totals: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``totals`` with the weights of ``cycle`` dealt to the sources in code point order, null last."""
    ranked = totals.orderBy(F.col("source").asc_nulls_last()).rdd.zipWithIndex()  # a global rank without one task
    rows = ranked.map(lambda pair: (*pair[0], cycle[pair[1] % len(cycle)]))
    return totals.sparkSession.createDataFrame(rows, totals.schema.add("weight", "long"))


def fill(sources: DataFrame, epochs: int) -> tuple[DataFrame, int]:
    """``sources`` with the ``target`` of each; the number of sources. Only sums reach the driver."""
    cap = F.col("source_size") * epochs
    first = sources.agg(F.count("*"), F.sum("source_size"), F.sum("weight")).first()
    count, words, weight = first[0], first[1] or 0, first[2] or 1
    capped, free, held = 0, weight, -1
    while True:
        level = (F.col("weight") * F.lit(words - capped)).cast("double") / F.lit(float(free))
        full = level >= cap
        now = sources.agg(F.count_if(full), F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        if now[0] == held or not now[2]:
            break
        held, capped, free = now[0], now[1] or 0, now[2]
    return sources.withColumn("target", F.when(full, cap.cast("double")).otherwise(level)), count


def _boundary(sizes: DataFrame, needs: DataFrame, prefix: Column) -> DataFrame:
    """For each source, the hash prefix within which the missing words run out, and what is missing there."""
    sums = sizes.groupBy("source", prefix.alias("prefix")).agg(F.sum("size").alias("words"))
    reached = F.sum("words").over(Window.partitionBy("source").orderBy("prefix"))
    same = F.col("n.source").eqNullSafe(F.col("s.source"))
    found = sums.withColumn("reached", reached).alias("s").join(needs.alias("n"), same)
    found = found.where((F.col("reached") >= F.col("missing")) & (F.col("reached") - F.col("words") < F.col("missing")))
    left = F.col("missing") - F.col("reached") + F.col("words")
    return found.select("n.source", "prefix", left.alias("missing"), "words")


def _within(sizes: DataFrame, found: DataFrame, digits: int) -> DataFrame:
    same = F.col("d.source").eqNullSafe(F.col("f.source"))
    inside = F.substring("key", 1, digits) == F.col("prefix")
    return sizes.alias("d").join(found.alias("f"), same & inside).select("d.source", "d.key", "d.size")


def plan(docs: DataFrame, epochs: int = 3, seed: int = 1, cycle: tuple[int, ...] = (1, 2, 3)) -> tuple[DataFrame, int]:
    """Per source: size, target, whole repetitions, and the hash up to which one more is taken; number of sources.

    Histograms over prefixes of the hash locate that point, so that no source's documents are ever ordered in one
    task: a window holds at most 4096 sums of a source.
    """
    sizes = docs.select("source", n_words(F.col("text")).alias("size"), order_key(F.col("doc_id"), seed).alias("key"))
    sizes = stored(sizes, "mixing-sizes")
    totals = cut(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    sources, count = fill(cut(source_weights(totals, cycle)), epochs)
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(epochs), F.floor(F.col("target") / F.col("source_size"))))
    sources = sources.withColumn("whole", F.coalesce(whole, F.lit(0)).cast("long"))
    missing = F.round("target").cast("long") - F.col("whole") * F.col("source_size")
    sources = cut(sources.withColumn("missing", F.greatest(missing, F.lit(0))))
    needs = sources.where("missing > 0").select("source", "missing")
    inside = sizes.where("size > 0")
    first = cut(_boundary(inside, needs, F.substring("key", 1, _DIGITS)))
    inside = _within(inside, first, _DIGITS)
    second = cut(_boundary(inside, first.select("source", "missing"), F.substring("key", 1, 2 * _DIGITS)))
    inside = _within(inside, second, 2 * _DIGITS)
    last = _boundary(inside, second.select("source", "missing"), F.col("key"))
    last = last.select(F.col("source").alias("of"), F.col("prefix").alias("last_key"), F.col("missing").alias("left"), "words")
    joined = sources.join(last, F.col("source").eqNullSafe(F.col("of")), "left")
    return cut(joined.select("source", "source_size", "target", "whole", "last_key", "left", "words")), count


def mix(docs: DataFrame, epochs: int = 3, seed: int = 1, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``taken`` (words, repeats counted), and what makes them up:
    ``whole`` repetitions of all its words and ``part``, the words of one repetition more (``size`` if it is whole)."""
    made, count = plan(docs, epochs, seed, cycle)
    names = ("size", "source_size", "target", "taken", "whole", "part")
    kept = [name for name in docs.columns if name.lower() not in names]
    columns = [F.col(f"d.`{name}`") for name in kept]
    rows = docs.select(*[F.col(f"`{name}`") for name in kept])
    rows = rows.withColumns({"__size": n_words(F.col("text")), "__key": order_key(F.col("doc_id"), seed)}).alias("d")
    made = (F.broadcast(made) if count <= BROADCAST_SOURCES else made).alias("p")
    joined = rows.join(made, F.col("d.source").eqNullSafe(F.col("p.source")))
    size, key = F.col("d.__size"), F.col("d.__key")
    share = F.floor(size.cast("decimal(19,0)") * F.col("p.left") / F.col("p.words")).cast("long")
    part = F.when(key < F.col("p.last_key"), size).when(key == F.col("p.last_key"), share).otherwise(0)
    return joined.select(
        *columns, size.alias("size"), F.col("p.source_size"), F.col("p.target"),
        (F.col("p.whole") * size + part).alias("taken"), F.col("p.whole"), part.alias("part"),
    )


def repeated(mixed: DataFrame) -> DataFrame:
    """One row for each repetition in ``mixed``; a repetition in part keeps its first ``part`` words, a whole one the text.

    A text without words is repeated as often as the whole repetitions of its source say.
    """
    part, size = F.col("part"), F.col("size")
    count = (F.col("whole") + (part > 0).cast("long")).cast("int")
    rows = mixed.withColumn("__n", count).where("__n > 0")
    rows = rows.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    in_part = (part > 0) & (part < size) & (F.col("__i") == F.col("__n"))
    words = F.slice(F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0)), F.lit(1), part.cast("int"))
    rows = rows.withColumn("text", F.when(in_part, F.array_join(words, " ")).otherwise(F.col("text")))
    return rows.drop("__n", "__i")
