"""Vector search, near vectors and the n-gram join against brute force."""

import random

import numpy as np
import pytest

from echolens.llm import components, mtree, nearvec, ngramjoin


def _vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "c") for i, v in rows],
                                 "vec_id long, embedding array<float>, score string")


ODD = [(1, None), (2, []), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [0.0, 0.0]),
       (7, [1.0, 0.0]), (8, [1.0, 0.0]), (8, [1.0, 0.0]), (50, [0.9, 0.1]), (100, [1.0, 0.5, 0.2]), (150, [2.0, 0.0])]


def _brute_top(rows, queries, k):
    out = set()
    for q, x in queries:
        near = sorted((-int(x @ y), i) for i, y in rows if i != q)[:k]
        out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(near, 1)}
    return out


def test_top_products(spark):
    rng = np.random.default_rng(4)
    values = rng.integers(-9, 10, (700, 6))
    values[100:160] = values[100]
    rows = [(i, values[i]) for i in range(700)]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, vector array<long>")
    queries = frame.where("vec_id % 50 = 0")
    got = mtree.top_k(frame, queries, 5, most_rows=200, least_rows=100, query_rows=6)
    want = _brute_top(rows, [(i, v) for i, v in rows if i % 50 == 0], 5)
    assert {tuple(row) for row in got.collect()} == want


def test_tree_spares_distances():
    rng = np.random.default_rng(5)
    centers = rng.standard_normal((20, 8)) * 50
    points = np.round((centers[rng.integers(0, 20, 4000)] + rng.standard_normal((4000, 8))) * 16)
    root, work = mtree.build(points, np.arange(4000)), mtree.Work()
    got = mtree.search(root, points[0], points[17], 17, 5, work)
    want = sorted((-int(points[17] @ p), i) for i, p in enumerate(points) if i != 17)[:5]
    assert got == [(i, -s) for s, i in want]
    assert work.computed < 2000 and work.spared > 0


def test_queries_walk_together_and_spare_distances():
    rng = np.random.default_rng(6)
    centers = rng.standard_normal((30, 16)) * 40
    points = np.round((centers[rng.integers(0, 30, 6000)] + rng.standard_normal((6000, 16))) * 16)
    points[1000:3000] = points[1000]  # a third are copies
    ids = rng.permutation(6000)
    queries, work = rng.choice(6000, 80, replace=False), mtree.Work()
    walk = mtree.Walk(points[queries], ids[queries], np.full(80, -np.inf), 5, work)
    mtree.go_through(mtree.build(points, ids), points[0], walk)
    for q, best in zip(queries, walk.best):
        scores = points @ points[q]
        want = sorted((-float(x), int(i)) for x, i in zip(scores, ids) if i != ids[q])[:5]
        assert best == want
    assert work.computed < 80 * 6000 / 5 and work.spared > 0


def test_null_ids_and_large_ids(spark):
    big = 2**53 + 1
    rows = [(None, [5, 5]), (big, [3, 4]), (big + 2, [4, 4]), (100, [1, 1]), (50, [2, 0]), (7, [1, 2, 3]), (150, [1, 1, 1]), (None, [9])]
    frame = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    got = {tuple(r) for r in mtree.top_k(frame, frame.where("vec_id % 50 = 0"), 2).collect()}
    assert got == {(100, 1, big + 2, 8), (100, 2, big, 7), (50, 1, big + 2, 8), (50, 2, big, 6), (150, 1, 7, 6)}
    assert mtree.top_k(frame.where("vec_id is null"), frame, 2).count() == 0


def test_subtrees_are_pruned(spark):
    rng = np.random.default_rng(9)
    centers = rng.standard_normal((12, 8)) * 60
    points = np.round((centers[rng.integers(0, 12, 1500)] + rng.standard_normal((1500, 8))) * 8).astype(int)
    frame = spark.createDataFrame([(i, [int(x) for x in p]) for i, p in enumerate(points)], "vec_id long, vector array<long>")
    got = mtree.top_k(frame, frame.where("vec_id % 50 = 0"), 5, most_rows=40, least_rows=60, query_rows=7)
    assert {tuple(r) for r in got.collect()} == _brute_top(list(enumerate(points)), [(i, points[i]) for i in range(0, 1500, 50)], 5)
    upper = mtree.Upper.of([[int(x) for x in c * 8] for c in centers])
    rows = mtree.dealt(frame.withColumn("dim", mtree.F.size("vector")), upper).toPandas()
    stats = {int(s): (g["away"].max(), g["length"].max()) for s, g in rows.groupby("subtree")}
    floors = [(i, [int(x) for x in points[i]], 8, int(rows["subtree"][i]), float(np.sort(points @ points[i])[-7])) for i in range(0, 1500, 50)]
    onward = spark.createDataFrame(floors, "vec_id long, vector array<long>, dim int, subtree long, floor double")
    assert mtree._routed(onward, upper, stats).count() < 30 * 11 / 2


def test_top_products_odd(spark):
    frame = _vectors(spark, ODD)
    vectors = frame.where(mtree.usable(frame.embedding)).select("vec_id", mtree.scaled(frame.embedding).alias("vector"))
    got = {tuple(r) for r in mtree.top_k(vectors, vectors.where("vec_id % 50 = 0"), 2).collect()}
    assert got == {(50, 1, 150, 230 * 512), (50, 2, 7, 230 * 256), (150, 1, 7, 512 * 256), (150, 2, 8, 512 * 256)}
    assert mtree.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_near_vectors(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((300, 16))
    hot = base[0] + 0.15 * rng.standard_normal((150, 16))
    pairs = base[200:260] + 0.05 * rng.standard_normal((60, 16))
    values = np.float32(np.vstack([base, hot, pairs, base[5:8], base[5:6]]))
    got = nearvec.near_duplicates(_vectors(spark, list(enumerate(values))), window=16, block=40).toPandas().set_index("vec_id")
    unit = values.astype(float) / np.linalg.norm(values.astype(float), axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    n = got.loc[range(len(values)), "n_links"].to_numpy()
    assert (n <= linked.sum(axis=1)).all() and n.sum() >= 0.97 * linked.sum()
    assert (got["kept"] == (got.index == got["component_id"])).all()


def test_near_vectors_across_tasks(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((150, 16))
    values = np.float32(np.vstack([base, base + 0.1 * rng.standard_normal((150, 16))]))
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before, got = [spark.conf.get(name) for name in names], []
    try:
        spark.conf.set(names[1], "false")
        for parts in ("1", "7", "60"):  # 60 parts hold fewer vectors than a window
            spark.conf.set(names[0], parts)
            rows = nearvec.near_duplicates(_vectors(spark, list(enumerate(values))), passes=1, window=8).collect()
            got.append(sorted((r.vec_id, r.n_links, r.component_id) for r in rows))
    finally:
        for name, value in zip(names, before):
            spark.conf.set(name, value)
    assert got[0] == got[1] == got[2] and sum(n > 0 for _, n, _ in got[0]) > 60


def test_passes_grow_with_the_vectors():
    assert [nearvec.passes_for(n, 0.9, 32) for n in (0, 1, 2000)] == [24] * 3
    rng = np.random.default_rng(9)
    values = rng.standard_normal((200_000, 64))
    other = rng.standard_normal((1000, 64))
    values[:1000] /= np.linalg.norm(values[:1000], axis=1, keepdims=True)
    other -= (other * values[:1000]).sum(axis=1, keepdims=True) * values[:1000]
    cosine = 0.9
    values[1000:2000] = cosine * values[:1000] + (1 - cosine**2) ** 0.5 * other / np.linalg.norm(other, axis=1, keepdims=True)
    found, passes = np.zeros(1000, bool), nearvec.passes_for(len(values), 0.9, 32)
    for seed in range(passes):
        place = np.empty(len(values), int)
        place[np.argsort(nearvec.sort_keys(values, 1, 40, seed)[:, 0])] = np.arange(len(values))
        found |= np.abs(place[:1000] - place[1000:2000]) <= 32
    assert passes > 24 and found.mean() >= 0.99


def test_border_members_of_dense_groups(spark):
    """Vectors near one direction, some at the border that link with few of them, and others far away: nothing is missed."""
    rng = np.random.default_rng(12)
    dim, head = 32, np.zeros(32)
    head[0] = 1

    def around(cosine, number):
        side = rng.standard_normal((number, dim))
        side[:, 0] = 0
        side /= np.linalg.norm(side, axis=1, keepdims=True)
        cosine = np.broadcast_to(cosine, (number,))[:, None]
        return cosine * head + np.sqrt(1 - cosine**2) * side

    values = np.float32(np.vstack([around(rng.uniform(0.97, 0.999, 700), 700), around(0.885, 100), rng.standard_normal((700, dim))]))
    unit = values.astype(float) / np.linalg.norm(values.astype(float), axis=1, keepdims=True)
    want = unit @ unit.T >= 0.9
    np.fill_diagonal(want, False)
    got = nearvec.near_duplicates(_vectors(spark, list(enumerate(values)))).toPandas().set_index("vec_id").loc[range(len(values))]
    assert (want[700:800].sum(axis=1) > 0).sum() > 40 and (got["n_links"].to_numpy() == want.sum(axis=1)).all()
    roots = np.arange(len(values))
    for _ in range(20):
        roots = np.minimum(roots, np.where(want, roots[None, :], len(values)).min(axis=1))
    assert (got["component_id"].to_numpy() == roots).all()


def test_one_cosine_for_a_pair():
    rng = np.random.default_rng(3)
    a = nearvec._unit(rng.standard_normal((300, 24)))
    threshold = float(nearvec._cosines(a[:1], a[1:2])[0])
    assert nearvec.linked(a, a, threshold)[0, 1] and nearvec.linked(a[1:2], a, threshold)[0, 0]
    assert not nearvec.linked(a, a, np.nextafter(threshold, 2))[0, 1]


def test_near_vectors_odd(spark):
    rows = nearvec.near_duplicates(_vectors(spark, ODD)).collect()
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in rows)
    alone = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 100)]
    group = [(7, 4, 7, True), (8, 4, 7, False), (8, 4, 7, False), (50, 4, 7, False), (150, 4, 7, False)]
    assert got == sorted(alone + group)
    assert nearvec.near_duplicates(_vectors(spark, ODD).limit(0)).count() == 0


def test_components(spark):
    rnd = random.Random(7)
    links = [(i, i + 1) for i in range(200)] + [(rnd.randint(300, 900), rnd.randint(300, 900)) for _ in range(400)] + [(5, 5)]
    up = {}

    def find(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    frame = spark.createDataFrame(links + [(None, 3)], "a long, b long")
    got = {r.node: r.root for r in components.components(frame).collect()}
    assert got == {x: find(x) for link in links if link[0] != link[1] for x in link}


def _shingles(text, n):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + n]) for i in range(max(len(words) - n + 1, 1))} if words else set()


def _brute_join(rows, n, percent):
    sets = [_shingles(text, n) for _, text in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[find(i)] = find(j)
    smallest = {}
    for i, (doc_id, _) in enumerate(rows):
        smallest.setdefault(find(i), []).append(doc_id)
    return sorted((doc_id, len(sets[i]), min(smallest[find(i)])) for i, (doc_id, _) in enumerate(rows))


def _near_copies(rnd, count, words, edits):
    base = [f"w{rnd.randint(0, 400)}" for _ in range(words)]
    for _ in range(count):
        copy = base[:]
        for _ in range(rnd.randint(0, edits)):
            copy[rnd.randrange(len(copy))] = f"e{rnd.randint(0, 10 ** 6)}"
        yield " ".join(copy)


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80)])
def test_ngram_join(spark, n, percent, monkeypatch):
    monkeypatch.setattr(ngramjoin, "BLOCK", 8)
    monkeypatch.setattr(ngramjoin, "PAGE", 2)
    rnd = random.Random(n)
    texts = [" ".join(f"r{rnd.randint(0, 50)}" for _ in range(rnd.randint(0, 40))) for _ in range(60)]
    for words, edits in ((12, 1), (60, 3), (200, 6), (800, 30), (3000, 90)):
        texts += _near_copies(rnd, 12, words, edits)
    passage = " ".join(f"p{i}" for i in range(40))
    texts += [f"{passage} tail{i} {' '.join(f't{i}x{k}' for k in range(rnd.randint(0, 12)))}" for i in range(30)]
    rows = list(enumerate(texts))
    rnd.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in ngramjoin.join(frame, ngramjoin.Rule(n, percent)).collect())
    assert got == _brute_join(rows, n, percent)


def test_every_link_shares_a_cell():
    rule = ngramjoin.Rule()
    for seed in range(400):
        rng = np.random.default_rng(seed)
        a = np.unique(rng.integers(0, 2 ** 64, int(np.exp(rng.uniform(0, 8))) + 1, dtype=np.uint64))
        k = int(rng.integers(0, rule.most_different(len(a)) + 1))
        gone = int(rng.integers(0, min(k, len(a) - 1) + 1))
        b = np.delete(a, rng.choice(len(a), gone, replace=False))
        b = np.unique(np.r_[b, rng.integers(0, 2 ** 64, k - gone, dtype=np.uint64)])
        overlap = len(np.intersect1d(a, b))
        if 100 * overlap >= 85 * (len(a) + len(b) - overlap):
            keys, many = ngramjoin.cell_keys(np.r_[a, b], np.array([len(a), len(b)]), rule)
            assert set(keys[:many[0]]) & set(keys[many[0]:])


def test_sets_of_a_class_seldom_meet_in_empty_runs():
    rule, rng = ngramjoin.Rule(5, 80), np.random.default_rng(3)
    for n in (8, 40, 320, 395, 590):  # small for the classes that they are in
        sets = [np.unique(rng.integers(0, 2 ** 64, n, dtype=np.uint64)) for _ in range(200)]
        keys, many = ngramjoin.cell_keys(np.concatenate(sets), np.array([len(x) for x in sets]), rule)
        met = np.unique(keys, return_counts=True)[1]
        assert (met * (met - 1) // 2).sum() < 200 * 199 // 2 / 4  # pairs of sets with nothing in common that meet in a cell
    for seed in range(300):  # sets that link, also in empty runs only
        rng = np.random.default_rng(seed)
        a = np.unique(rng.integers(0, 2 ** 64, int(rng.integers(1, 60)), dtype=np.uint64))
        b = np.unique(np.r_[a, rng.integers(0, 2 ** 64, rule.most_different(int(len(a) * 1.25)), dtype=np.uint64)])
        if 100 * len(a) >= 80 * len(b):
            keys, many = ngramjoin.cell_keys(np.r_[a, b], np.array([len(a), len(b)]), rule)
            assert set(keys[:many[0]]) & set(keys[many[0]:])


def test_tree_matches_are_all_that_the_bound_passes():
    rng = np.random.default_rng(8)
    points = rng.integers(0, 4, (120, ngramjoin.GROUPS)).astype(np.uint32)
    points[60:] = np.maximum(points[:60].astype(int) - (rng.random((60, ngramjoin.GROUPS)) < 0.05), 0)
    sizes, rule = points.sum(axis=1).astype(np.int64), ngramjoin.Rule()
    got = {frozenset((int(a), int(b))) for x, y in ngramjoin.tree_matches(points, sizes, rule) for a, b in zip(x, y)}
    low = np.minimum(points[:, None], points[None]).sum(axis=2)
    need = rule.least_overlap(sizes[:, None], sizes[None])
    assert got == {frozenset((int(a), int(b))) for a, b in zip(*np.nonzero(low >= need)) if a != b}


def test_ngram_join_odd(spark, odd):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngramjoin.join(odd).collect()), key=str)
    want = [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 2, 4), (5, 2, 4), (6, 2, 4), (6, 2, 4), (None, 3, None), (8, 19_997, 8),
            (9, 1, 9), (10, 1, 10)]
    assert got == sorted(want, key=str)
    assert ngramjoin.join(odd.limit(0)).count() == 0
