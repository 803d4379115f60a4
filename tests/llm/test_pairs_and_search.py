"""The n-gram join, components and top-k search against plain loops."""

import random

import numpy as np
import pytest

from weft.llm import hot_lists, ngram_join, topk
from weft.llm.components import connected_components

DOCS = "doc_id bigint, text string, component_id string, n string"


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def components(rows, spec):
    """The smallest id that each row reaches, by comparing all pairs."""
    sets = [shingles(t, spec.width) for _, t in rows]
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None or not sets[i] or not sets[j]:
                continue
            both = len(sets[i] & sets[j])
            if spec.den * both >= spec.num * (len(sets[i]) + len(sets[j]) - both):
                top[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i)) if d is not None else None) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def run(spark, rows, spec):
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS)
    return sorted((tuple(r) for r in ngram_join.ngram_components(frame, spec).collect()), key=repr)


def near_copies(seed, groups=6, size=12, words=60, edits=4):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    out = []
    shared = [rng.choice(vocabulary) for _ in range(25)]
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(0, edits)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                copy = shared + copy
            out.append(" ".join(copy))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("spec", [ngram_join.JoinSpec(), ngram_join.JoinSpec(width=5, num=80), ngram_join.JoinSpec(width=2, num=60, most_matches=3, sketch_cells=1 << 14)])
def test_components_are_those_of_all_pairs(spark, spec):
    texts = near_copies(spec.width) + [None, "", "  \n", "one", "ONE", "one two", "one Two", "É é", "é É"] + ["same text of some words"] * 5
    rows = list(enumerate(texts)) + [(None, texts[0]), (None, None), (0, texts[0]), (1, "another text for this id"), (200, "x " * 3000)]
    assert run(spark, rows, spec) == components(rows, spec)


def test_one_chain_and_one_hub(spark):
    # neighbours link, the ends don't
    words = [f"w{i}" for i in range(130)]
    rows = [(i, " ".join(words[i : i + 100])) for i in range(0, 30, 2)]
    spec = ngram_join.JoinSpec()
    found = run(spark, rows, spec)
    assert found == components(rows, spec) and {r[2] for r in found} == {0}


def test_empty_table(spark):
    assert run(spark, [], ngram_join.JoinSpec()) == []


def group_of_copies(seed, size, words, edits):
    """Copies of one text, which isn't among them, each with so many words replaced at random places."""
    rng = random.Random(seed)
    base, out = [f"b{i}" for i in range(words)], []
    for k in range(size):
        copy = list(base)
        for at in rng.sample(range(words), edits(rng)):
            copy[at] = f"r{k}x{at}"
        out.append(" ".join(copy))
    return out


def rows_by_step(monkeypatch):
    """The rows of every step that is materialised, by its label."""
    made = {}

    def counted(module, plain):
        def step(df, label):
            out = plain(df, label)
            made[label] = max(made.get(label, 0), out.count())
            return out

        monkeypatch.setattr(module, "materialise", step)

    for module in (ngram_join, hot_lists):
        counted(module, module.materialise)
    return made


@pytest.mark.parametrize(("size", "words", "edits"), [(100, 200, lambda r: 3), (200, 200, lambda r: 3), (400, 200, lambda r: 3), (150, 60, lambda r: 1), (150, 45, lambda r: r.randint(0, 2))])
def test_groups_of_near_copies_do_not_make_pairs(spark, monkeypatch, size, words, edits):
    made = rows_by_step(monkeypatch)
    rows = list(enumerate(group_of_copies(size, size, words, edits)))
    spec = ngram_join.JoinSpec(width=5, num=80)
    assert run(spark, rows, spec) == components(rows, spec)
    for step in ("met", "sharing", "pairs", "hot-pairs"):
        assert made.get(step, 0) <= 16 * size, (step, made)


def test_blocks_of_long_lists(spark, monkeypatch):
    """Long lists in many small blocks, with prefixes of different lengths, give the components of all pairs."""
    texts = group_of_copies(1, 60, 50, lambda r: r.randint(0, 2)) + group_of_copies(2, 40, 90, lambda r: 2) + near_copies(3)
    for settings in ({"block_rows": 7}, {"block_tokens": 300, "partners_per_match": 40}, {"small_list": 2, "partners_per_match": 1000}):
        rows = list(enumerate(texts))
        spec = ngram_join.JoinSpec(**({"width": 5, "num": 80, "small_list": 4} | settings))
        assert run(spark, rows, spec) == components(rows, spec)


@pytest.mark.parametrize("settings", [{}, {"small_list": 4, "block_rows": 9}])
def test_all_links_and_their_numbers(spark, settings):
    spec = ngram_join.JoinSpec(width=5, num=80, **settings)
    texts = group_of_copies(1, 50, 50, lambda r: r.randint(0, 2)) + near_copies(3) + [None, "", "one", "one", "one two three four five six"] * 2
    rows = list(enumerate(texts)) + [(None, texts[0]), (3, texts[3]), (4, "another text")]
    sets = [shingles(t, 5) for _, t in rows]
    alike = lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b)
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], DOCS)
    members, pairs = ngram_join.ngram_links(frame, spec)
    got = sorted(((r.doc_id, r.n_shingles, r.n_links) for r in members.collect()), key=repr)
    assert got == sorted(((i, len(s), sum(alike(s, o) for (j, _), o in zip(rows, sets) if j is not None) - 1 if i is not None and s else None) for (i, _), s in zip(rows, sets)), key=repr)
    kinds = {frozenset(s) for (i, _), s in zip(rows, sets) if i is not None and s}
    assert pairs.count() == pairs.distinct().count() == sum(alike(a, b) for a in kinds for b in kinds if a != b) // 2


def test_shared_tokens_and_forest():
    rng = np.random.RandomState(7)
    sets = [np.unique(rng.randint(0, 60, rng.randint(0, 40))).astype(np.uint64) << np.uint64(40) for _ in range(30)]
    got = hot_lists.shared_tokens(sets[:12], sets[12:])
    assert (got == [[len(np.intersect1d(a, b)) for b in sets[12:]] for a in sets[:12]]).all()
    a, b = rng.randint(0, 40, 30), rng.randint(0, 40, 30)
    a, b = a[a != b], b[a != b]
    label, chosen = hot_lists.spanning(a, b, 40)
    assert (label[a] == label[b]).all() and len(chosen) == 40 - len(set(label.tolist()))
    assert (hot_lists.spanning(a[chosen], b[chosen], 40)[0] == label).all()


def test_prefixes_share_enough():
    """Any two sets at the threshold share as many listed shingles as the smaller demand of the two."""
    rng, spec = np.random.RandomState(3), ngram_join.JoinSpec(width=3, num=80)
    counts = rng.randint(1, 1000, 1 << 14).astype(np.int32)
    for _ in range(200):
        a = np.unique(rng.randint(0, 1 << 62, rng.randint(5, 80)).astype(np.uint64))
        swap = rng.randint(0, max(1, len(a) // 10) + 1)
        b = np.unique(np.concatenate([a[swap:], rng.randint(0, 1 << 62, swap).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if spec.den * both < spec.num * (len(a) + len(b) - both):
            continue
        (p, m, _), (q, n, _) = ngram_join.prefix(a, counts, spec), ngram_join.prefix(b, counts, spec)
        least = min(m, n)
        need = -(-spec.num * (len(a) + len(b)) // (spec.num + spec.den))
        assert len(np.intersect1d(p[: len(a) - need + least], q[: len(b) - need + least])) >= least


def test_connected_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 260)] + [(5, 5), (None, 1)]
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    frame = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.node: r.component for r in connected_components(frame, "a", "b").collect()}
    assert got == {x: find(x) for x in top}
    assert connected_components(frame.where("a < 0"), "a", "b").count() == 0


def plain_top(rows, spec):
    good = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in good), default=0)
    most = (1 << 31) - 1
    ints = [(i, [max(-most, min(most, int(np.floor(np.float64(x) * spec.scale)))) for x in v] + [0] * (width - len(v))) for i, v in good]
    out = []
    for i, q in ints:
        if i % spec.every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, x)), j) for j, x in ints if j != i)[: spec.k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored)]
    return sorted(out)


@pytest.mark.parametrize("spec", [topk.TopKSpec(), topk.TopKSpec(k=5, every=3, pivots=4, annulus_rows=16, group_rows=40, block_queries=10, steps=32)])
def test_top_k_is_that_of_all_pairs(spark, spec):
    rng = np.random.RandomState(12)
    rows = [(i, [float(x) for x in rng.normal(size=6).astype(np.float32)]) for i in range(180)]
    rows += [(i, [0.5, 0.25, 0.0, 0.0, 0.0, 0.0]) for i in range(180, 260)]  # copies of one vector
    rows += [(260, None), (261, [1.0, None]), (262, [float("nan")] * 6), (263, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (264, [1.0, 2.0]), (265, []), (20, [9.0] * 6), (266, [0.0] * 6)]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id bigint, embedding array<float>, score int, pivot int")
    assert sorted(tuple(r) for r in topk.top_k(frame, spec).collect()) == plain_top(rows, spec)


def test_top_k_of_few_and_of_large_values(spark):
    spec = topk.TopKSpec(k=20, every=1, scale=1)
    for rows in ([], [(0, [1.0])], [(0, [1.0]), (1, [2.0])], [(i, [float(i) * 1e7, -3e7]) for i in range(30)], [(i, [0.0, 0.0]) for i in range(30)]):
        frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
        assert sorted(tuple(r) for r in topk.top_k(frame, spec).collect()) == plain_top(rows, spec)


def test_bounds_never_cut_a_score():
    """The bound of any run of distances is at least every score inside it."""
    rng = np.random.RandomState(13)
    x = np.floor(rng.normal(size=(300, 8)) * 64)
    most = float((x * x).sum(1).max())
    centre = topk.choose_pivots(topk.lifted(x, most), 8)
    away = topk.distances(topk.lifted(x, most), centre)
    q = x[:20]
    d, length = topk.distances(np.concatenate([q, np.zeros((20, 1))], 1), centre), (q * q).sum(1)
    for p in range(len(centre)):
        mine = away[:, p].argsort()[:50]
        groups = topk.Groups(np.array([p]), away[mine, p].min(keepdims=True), away[mine, p].max(keepdims=True), np.array([50]))
        assert ((q @ x[mine].T).max(1) <= topk.upper_bound(length, groups.gaps(d)[:, 0], most)).all()


def test_groups_hold_every_step_once():
    rng = np.random.RandomState(14)
    hist = [(p, s, int(rng.choice([1, 5, 30, 400]))) for p in range(4) for s in sorted(rng.choice(50, 20, replace=False).tolist())]
    groups, runs = topk.cut_groups(hist, 0.5, 100)
    assert groups.rows.max() <= 100 and groups.rows.sum() == sum(n for *_, n in hist)
    for p, s, _ in hist:
        (_, a, b, first, parts), = [r for r in runs if r[0] == p and r[1] <= s <= r[2]]
        for g in range(first, first + parts):
            assert groups.pivot[g] == p and groups.low[g] <= s * 0.5 and (s + 1) * 0.5 <= groups.high[g]


def test_clustered_vectors_leave_most_rows_unread(spark):
    """Few dimensions and clusters: the search stops long before all rows, and the answer is that of all pairs."""
    rng = np.random.RandomState(15)
    angle = rng.choice(24, 6000) * (2 * np.pi / 24) + rng.normal(0, 0.01, 6000)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(np.stack([np.cos(angle), np.sin(angle)], 1) * 20)]
    spec = topk.TopKSpec(k=10, every=50, pivots=24, annulus_rows=32, group_rows=128, block_queries=16)
    found, scored = topk.search_counted(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), spec)
    got = sorted(tuple(r) for r in found.collect())
    x = np.floor(np.array([v for _, v in rows]) * spec.scale).astype(np.int64)
    for q in range(0, 6000, 50):
        score = x @ x[q]
        order = np.lexsort((np.arange(6000), -score))
        wanted = [(q, r + 1, int(v), int(score[v])) for r, v in enumerate([v for v in order if v != q][:10])]
        assert got[q // 50 * 10 : q // 50 * 10 + 10] == wanted
    assert 0 < scored.value < 0.1 * 120 * 6000
