"""Mixing and packing: brute force, exact round trips, odd rows."""

import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from echolens.llm import mixing, packing, queries, tokens
from tests.llm.conftest import SMALL

PATH = queries.tokenizer_file("word_bpe_49k.json")


def _targets(sizes, epochs=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        rest = total - sum(epochs * sizes[s] for s in full)
        target = {s: epochs * sizes[s] if s in full else rest * weight[s] / sum(weight[f] for f in free) for s in names}
        over = {s for s in free if target[s] >= epochs * sizes[s]}
        if not over:
            return target
        full |= over


def test_targets_and_takes(spark, documents):
    rows = [(i, "w " * (i % 7 + 1), "en", "abcd"[i % 11 % 4]) for i in range(300)]
    rows += [(900 + i, "w " * 400, "en", "e") for i in range(10)] + [(999, "w w", "en", None), (998, "", "en", "empty")]
    docs = documents(*rows)
    got = mixing.mix(docs).collect()
    size, taken = defaultdict(int), defaultdict(int)
    for row in got:
        size[row.source] += row["size"]
        taken[row.source] += row.taken
        assert 0 <= row.taken <= 3 * row["size"] and row["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", row.text))
    want = _targets(size)
    for row in got:
        assert row.target == pytest.approx(want[row.source]) and row.source_size == size[row.source]
    assert all(abs(taken[s] - want[s]) <= 1 for s in size)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)


def test_repetitions_take_what_the_mix_says(spark, documents):
    docs = documents(*[(i, f"a{i} b c  d\n e", "en", "xy"[i % 5 == 0]) for i in range(40)])
    mixed = mixing.mix(docs)
    want = {r.doc_id: r.taken for r in mixed.collect()}
    got = defaultdict(int)
    for row in mixing.repeated(mixed).collect():
        got[row.doc_id] += len(row.text.split())
    assert {k: v for k, v in want.items() if v} == dict(got)


def test_mixing_odd_rows(spark, odd):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.taken == 0 for r in rows if r.doc_id in (1, 2, 3))
    assert mixing.mix(odd.limit(0)).count() == 0
    assert mixing.mix(odd.where("doc_id < 4")).count() == 3  # no word at all


def _check(pieces, docs, length):
    library = Tokenizer.from_file(PATH)
    want = defaultdict(list)
    for row in docs.collect():
        want[row.doc_id].append([*library.encode(row.text or "", add_special_tokens=False).ids, 1])
    documents_, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(bytes(p.ids), "<u4")
        assert len(ids) == p.length and zlib.crc32(p.ids) == p.ids_crc32
        documents_[p.doc_id].append((p.start, ids.tolist()))
        sequences[p.sequence_id].append((p.offset, p.length))
    for doc_id, copies in want.items():
        assert sum(len(ids) for _, ids in documents_[doc_id]) == sum(map(len, copies))
        if len(copies) == 1:
            assert sum((ids for _, ids in sorted(documents_[doc_id])), []) == copies[0]
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == length or at & (at - 1) == 0
    return sequences


def test_packing_is_exact(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    pieces = packing.pack(docs, PATH).collect()
    sequences = _check(pieces, docs, packing.LENGTH)
    assert sum(sum(n for _, n in parts) == 2048 for parts in sequences.values()) > len(sequences) / 3


def test_packing_odd_rows(spark, odd):
    _check(packing.pack(odd, PATH, 64).collect(), odd, 64)
    assert packing.pack(odd.limit(0), PATH).count() == 0


def test_ids_equal_the_library():
    library, own = Tokenizer.from_file(PATH), tokens.WordTokenizer(PATH, most_runs=20)
    texts = ["", "ΑΣ Σ ΣΑΣ İstanbul ǅ it's I'LL we'd 12 3½ ²x ① Ⅷ é", "a<|endoftext|>b", "\x00\x1f\x85 x\x00z​ a\x1cb,c", "日本 עברית 😀👍🏽"]
    texts += [" ".join(f"word{i}" for i in range(100))]
    for text in texts:
        assert np.frombuffer(own.ids(text), own.dtype).tolist() == library.encode(text, add_special_tokens=False).ids


def test_hilbert_keys_walk_from_cell_to_cell():
    side = 1 << 3
    cells = np.stack(np.meshgrid(*[np.arange(side)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    keys = packing.hilbert_keys((cells + 0.5) / side, 3)
    assert sorted(keys.tolist()) == list(range(side ** 3))
    steps = np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1)
    assert (steps == 1).all()
