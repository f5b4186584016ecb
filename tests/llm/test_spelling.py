"""Spelling variants against brute force."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from echolens.llm import spelling

LETTERS = "abcé"


def _one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(a == b[:i] + b[i + 1:] for i in range(len(b)))


def _brute_words(rows, shortest=5, least=3, modulus=97):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda x: x[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % modulus == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}


def _brute(vocabulary, times=2):
    near = {w: [v for v in vocabulary if _one_edit(w, v)] for w in vocabulary}
    best = {w: min(vs, key=lambda v: (-vocabulary[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if vocabulary[v] >= times * vocabulary[w]}
    out = set()
    for w, n in vocabulary.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), vocabulary.get(form.get(w))))
    return out


def _texts(rng, number, length=400):
    """Frequent and rare words of a small alphabet, some of them changed in a letter or two."""
    base = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(3, 9))) for _ in range(150)]

    def word():
        chars = list(base[int(150 * rng.random() ** 3)])
        while rng.random() < 0.3:
            chars[rng.randrange(len(chars))] = rng.choice(["", "a", "b", "cc"])
        return "".join(chars) + "X" * (not chars)

    return [" ".join(word() for _ in range(length)) for _ in range(number)]


@pytest.mark.parametrize("most", (6, 512))
def test_variants(spark, most):
    rng = random.Random(7)
    rows = [(i, text) for i, text in enumerate(_texts(rng, 12))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    vocabulary = spelling.words(frame, least=2, modulus=5)
    want = _brute_words(rows, least=2, modulus=5)
    assert {tuple(r) for r in vocabulary.collect()} == set(want.items())
    near = {r["word"]: r["n_near"] for r in spelling.near_words(vocabulary, most=most).collect()}
    assert near == {w: c for w in want if (c := sum(_one_edit(w, v) for v in want))}
    got = {tuple(r) for r in spelling.variants(frame, least=2, modulus=5).collect()}
    assert got == _brute(want)
    assert any(form and form != root for _, form, root, *_ in got)


def test_chains_of_forms(spark):
    counts = {"banana": 1, "bananas": 2, "bananasx": 4, "bananaxx": 8, "banaraxx": 16}
    forms = spark.createDataFrame(list(zip(list(counts), list(counts)[1:])), "word string, form string")
    assert {r["root"] for r in spelling.roots(forms).collect()} == {"banaraxx"}


def test_hot_cell_is_cut(spark):
    rng = random.Random(3)
    texts = sorted({"prefix" + "".join(rng.choice(LETTERS) for _ in range(6)) for _ in range(900)})
    vocabulary = spark.createDataFrame([(w, 3) for w in texts], "word string, n long")
    cells = spelling.cells(vocabulary, most=40)
    sizes = cells.where("e - s > 1").groupBy("m", "s", "e", "head", "tail").count()
    assert sizes.where("count > 40").isEmpty()
    near = {r["word"]: r["n_near"] for r in spelling.near_words(vocabulary, most=40).collect()}
    assert near == {w: c for w in texts if (c := sum(_one_edit(w, v) for v in texts))}


def test_scan_skips_ranges():
    words = sorted("".join(x) for x in itertools.product("abcdefgh", repeat=4))
    a, b = spelling.near_pairs(words, np.zeros(len(words), int), np.full(len(words), 4), 0)
    assert len(a) == len(words) * 4 * 7
    assert all(_one_edit(words[i], words[j]) for i, j in zip(a[:500], b[:500]))


def test_odd(spark, odd):
    want = _brute(_brute_words([(r["doc_id"], r["text"]) for r in odd.collect()]))
    assert {tuple(r) for r in spelling.variants(odd).collect()} == want
    assert spelling.variants(odd.limit(0)).count() == 0


def test_very_long_words(spark):
    word = "ab" * 20_000
    rows = [(i, f"{word} {word}x {word[:-1]}") for i in range(4)]
    got = {r["word"]: r["n_near"] for r in spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), modulus=10**9).collect()}
    assert got == {word: 2, word + "x": 1, word[:-1]: 1}
