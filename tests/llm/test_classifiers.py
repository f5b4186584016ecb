"""Toxicity, quality and language: held-out accuracy on the given tables, brute force on words, odd rows."""

import itertools
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from echolens.llm import language, quality, queries, toxicity
from echolens.llm.common import in_fold, labelled_sample

FOLDER = "/root/testdata/sf0.01"
PIECES = queries.tokenizer_file("piece_bpe_32k.model")


def _held_out(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def test_fold_is_crc32_of_the_id_as_text(spark):
    rows = spark.range(50).select("id", in_fold(F.col("id"), 5, 0).alias("f")).collect()
    assert all(row.f == (_held_out(row.id, 5) == 0) for row in rows)
    assert spark.sql("select cast(null as bigint) id").select(in_fold(F.col("id"), 5, 0)).first()[0] is False


@pytest.mark.parametrize("query, label, least", [("op1_toxicity", "toxic", 0.9), ("op6_quality", "quality", 0.85)])
def test_held_out_accuracy(spark, query, label, least):
    got = getattr(queries, query)(spark, FOLDER).toPandas()
    docs = pd.read_parquet(f"{FOLDER}/documents.parquet")
    assert sorted(got["doc_id"]) == sorted(docs["doc_id"])
    assert ((got["score"] >= 0) & (got["score"] <= 1)).all()
    truth = pd.read_parquet(f"{FOLDER}/labels.parquet")
    both = got[got["held_out"]].merge(truth, on="doc_id")
    assert (both["predicted"] == both[label]).mean() >= least


@pytest.mark.parametrize("query, label, least", [
    ("op1_toxicity", "toxic", {0: (0.95, 0.93), 1: (0.55, 0.7)}), ("op6_quality", "quality", {0: (0.8, 0.88), 1: (0.97, 0.95)})
])
def test_both_classes_held_out(spark, query, label, least):
    """Recall and precision of each class: always the larger class would have none of the other."""
    folder = "/root/testdata/sf0.1"
    got = getattr(queries, query)(spark, folder).toPandas()
    both = got[got["held_out"]].merge(pd.read_parquet(f"{folder}/labels.parquet"), on="doc_id")
    for value, (recall, precision) in least.items():
        assert (both.loc[both[label] == value, "predicted"] == value).mean() >= recall
        assert (both.loc[both["predicted"] == value, label] == value).mean() >= precision


def test_toxicity_of_unseen_misspellings():
    rng = np.random.default_rng(1)
    clean = [" ".join(rng.choice(["river", "stone", "cloud", "meadow", "winter", "basket"], 30)) for _ in range(60)]
    toxic = [text + " horridness horrider" for text in clean]
    model = toxicity.train(clean + toxic, np.array([0] * 60 + [1] * 60), epochs=30)
    unseen = model.scores(["river stone horridnes cloud", "river stone windmill cloud"])
    assert unseen[0] > 0.5 > unseen[1]


def test_subwords_of_a_word():
    ids, owner = toxicity.subwords(["ab", "", "Ab, ab"])
    assert sorted(ids[owner == 0].tolist()) == sorted(set(ids[owner == 2].tolist())) * 1
    assert (owner == 1).sum() == 0 and (owner == 2).sum() == 2 * (owner == 0).sum()


def test_quality_indicators_are_distinct():
    text = "The cat, the hat!! 12 | 345"
    found = quality.indicators(text)
    assert len(found) == len(set(found.tolist()))
    flat = " ".join(text.split()).translate(str.maketrans("123456789", "0" * 9))
    grams = {flat[i:i + n] for n in range(1, 5) for i in range(len(flat) - n + 1)}
    assert len(grams) - 3 <= len(found) <= len(grams)


def test_dual_coordinate_descent_separates():
    bags = [np.array([0, 2]), np.array([0, 3]), np.array([1, 2]), np.array([1, 3])]
    signs = np.array([1.0, 1.0, -1.0, -1.0])
    weights, bias = quality.dual_coordinate_descent(bags, np.ones(4), signs, np.ones(4), 200, 1)
    assert all(np.sign(weights[bag].sum() / np.sqrt(2) + bias) == sign for bag, sign in zip(bags, signs))


@pytest.mark.parametrize("operator, label", [(toxicity, "toxic"), (quality, "quality")])
def test_odd_rows(spark, odd, operator, label):
    labels = spark.createDataFrame(
        [(i, i % 2, i % 2) for i in (1, 2, 4, 5, 6, 7, 8, 9)] + [(4, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int"
    )
    scored = operator.score(odd, operator.fit(odd, labels))
    rows = scored.collect()
    assert len(rows) == odd.count() and all(0 <= row.score <= 1 for row in rows)
    assert len({row.score for row in rows if row.text == "one two three four five"}) == 1
    assert len({row.score for row in rows if row.doc_id in (1, 2)}) == 1
    assert operator.score(odd.limit(0), operator.fit(odd.limit(0), labels.limit(0))).count() == 0


def test_forward_sums_all_segmentations():
    pieces = ["a", "b", "ab", "aba", "▁a", "▁", "ba"]
    rng = np.random.default_rng(2)
    chances = np.vstack([rng.random((len(pieces), 2)), np.zeros((1, 2))])
    table = language.PieceTable(sorted(pieces))
    for word in ("abab", "aab", "bba", "xab"):
        text, want = "▁" + word, np.zeros(2)
        for cuts in itertools.product([0, 1], repeat=len(text) - 1):
            parts, start = [], 0
            for i, c in enumerate((*cuts, 1), 1):
                if c:
                    parts.append(text[start:i])
                    start = i
            chance = np.ones(2)
            for part in parts:
                known = sorted(pieces).index(part) if part in pieces else None
                chance = chance * (chances[known] if known is not None else 1e-9 if len(part) == 1 else 0)
            want += chance
        assert np.allclose(language.log_chances([word], table, chances)[0], np.log(want))


def test_long_words_and_pieces_count_whole():
    pieces = sorted(["▁", "a", "b", "ab", "▁a", "abbaabbaabba"])
    chances = np.vstack([np.random.default_rng(3).random((len(pieces), 2)) / 9, np.zeros((1, 2))])
    word = "abba" * 300 + "xx"
    text, sums = "▁" + word, [[0.0, 0.0]]
    for end in range(1, len(text) + 1):  # in logarithms, piece by piece
        ways = [sums[end - len(p)] + np.log(chances[i]) for i, p in enumerate(pieces) if text[:end].endswith(p)]
        sums.append(np.logaddexp.reduce(ways) if ways else sums[end - 1] + np.log(1e-9))
    table = language.PieceTable(pieces)
    assert np.allclose(language.log_chances([word], table, chances)[0], sums[-1])
    counts = language.expected_counts(language.lattice([word], table), chances, np.ones((1, 2)))
    lengths = np.array([len(p) for p in pieces])
    assert np.allclose(lengths @ counts[:-1], len(text) - 2)  # every character but the unknown ones, once
    model = language.train(["c" * 30 + "a" * 9, "c" * 30 + "b" * 9], ["x", "y"], ["▁", "a", "b", "c"])
    assert model.predict(["a", "b"])[0] == ["x", "y"]
    assert any(len(p) > 8 for p in language.vocabulary(queries.tokenizer_file("piece_bpe_32k.model")))


def test_languages_held_out(spark):
    got = queries.op10_language(spark, FOLDER).toPandas()
    docs = pd.read_parquet(f"{FOLDER}/documents.parquet")
    both = got[got["held_out"]].merge(docs, on="doc_id")
    assert len(got) == len(docs) and (both["lang_pred"] == both["lang"]).mean() > 0.98


def test_language_odd_rows(spark, odd):
    path = queries.tokenizer_file("piece_bpe_32k.model")
    rows = language.predict(odd, language.fit(odd, path)).collect()
    assert len(rows) == odd.count()
    by_id = {row.doc_id: (row.lang_pred, row.score) for row in rows}
    assert by_id[1] == by_id[2] == by_id[3] == ("und", 0.0)
    assert by_id[4] == by_id[6] and by_id[4][0] == "en" and 0 <= by_id[4][1] <= 1
    assert by_id[10][0] == "en"
    nothing = language.predict(odd, language.fit(odd.limit(0), path)).select("lang_pred").distinct().collect()
    assert [row.lang_pred for row in nothing] == ["und"]


def test_letterless_texts_have_no_language(spark):
    docs = spark.createDataFrame([(i, "the cat and the dog", "en") for i in range(9)], "doc_id long, text string, lang string")
    model = language.fit(docs, PIECES)
    texts = ["½ ² ①", "Ⅷ ⅷ", "12 345", "日本", "x½y"]
    got = {r["text"]: r["lang_pred"] for r in language.predict(spark.createDataFrame([(t,) for t in texts], "text string"), model).collect()}
    assert got == {"½ ² ①": "und", "Ⅷ ⅷ": "und", "12 345": "und", "日本": "en", "x½y": "en"}
    assert language.words_of("x½y Ⅷa ab") == ["x", "y", "a", "ab"]


def test_every_language_is_learned(spark):
    rows = [(i, "".join(chr(97 + (i // 4 * 7 + k * k) % 26) for k in range(5)), f"l{i // 4:03d}") for i in range(2400)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), PIECES, per_language=4)
    assert model.languages == sorted({row[2] for row in rows if zlib.crc32(str(row[0]).encode()) % 4 != 2}) and len(model.languages) > 590


def test_repeated_ids_give_one_text_each(spark):
    rows = [(7, f"text {i}", "en") for i in range(300)] + [(i, "le chat", "fr") for i in range(20)] + [(8, "zwei", "de"), (8, "eins", "de")]
    learned = []
    before, language.train = language.train, lambda texts, langs, pieces: learned.append(sorted(zip(langs, texts)))
    try:
        for parts in (1, 3):
            language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(parts), PIECES, per_language=5)
    finally:
        language.train = before
    assert learned[0] == learned[1]
    assert [t for lang, t in learned[0] if lang == "en"] in ([], ["text 0"]) and [t for lang, t in learned[0] if lang == "de"] in ([], ["eins"])
    assert len([t for lang, t in learned[0] if lang == "fr"]) == 5
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, y int")
    found = labelled_sample(docs, labels, "y", {1: 9}, 5)
    assert found["text"].tolist() == [t for i, t in ((1, "a"), (2, "c")) if zlib.crc32(str(i).encode()) % 5]


@pytest.mark.parametrize("fit, most", [
    (lambda texts, y: toxicity.train(texts, y, epochs=1, most_epochs=1), 10.5), (lambda texts, y: quality.train(texts, y, 0.5), 14.5),
])
def test_training_holds_narrow_bags(fit, most):
    """Bytes that grow with the sample, for each distinct n-gram of a text: the whole sample's stay in the driver's memory."""
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 3000)) for _ in range(600)]
    kind = toxicity if most < 12 else quality
    grams = [len(np.unique(kind.subwords([t])[0] if kind is toxicity else kind.indicators(t))) for t in texts]

    def peak(n):
        tracemalloc.start()
        fit(texts[:n], np.arange(n) % 2)
        found = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return found

    assert (peak(600) - peak(200)) / sum(grams[200:]) < most
