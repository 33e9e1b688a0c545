"""The Jaccard join and its components against brute force."""

import random
import re

import numpy as np
import pytest

from pagelattice.llm import components, jaccard_join
from tests.llm.cases import docs, save, twins


def brute(rows, width, percent):
    sets = []
    for d, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    out = {}
    for i in range(len(rows)):
        out[i] = len(sets[i]), min(rows[j][0] for j in range(len(rows)) if find(j) == find(i))
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["the", "of"] * 40
    rows = [(0, None), (1, ""), (2, " \n"), (3, "One"), (4, "one"), (5, "one two"), (6, "ONE  two"), (7, "a " * 20_000), (8, "a " * 300)]
    for d in range(9, 60):
        rows.append((d, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 120)))))
    for d in range(60, 260):
        base = rng.choice(rows[9:60])[1].split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            base[rng.randrange(len(base))] = rng.choice(words)
        rows.append((d, " ".join(base + [rng.choice(words)] * rng.choice([0, 0, 1, 3]))))
    hub = [rng.choice(words) for _ in range(400)]
    for d in range(260, 340):
        near = list(hub)
        for _ in range(rng.randrange(1, 8)):
            near[rng.randrange(400)] = f"x{d}"
        rows.append((d, " ".join(near)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("width,percent,chunk", [(3, 90, jaccard_join.CHUNK), (5, 80, 6)])
def test_components_match_brute_force(spark, width, percent, chunk):
    rows = corpus(width)
    want = {rows[i][0]: x for i, x in brute(rows, width, percent).items()}
    found = jaccard_join.jaccard_components(docs(spark, rows), width, percent, chunk).collect()
    assert len(found) == len(rows)
    bad = [(r, want[r.doc_id]) for r in found if (r.n_shingles, r.component_id) != want[r.doc_id]]
    assert not bad, (len(bad), bad[:3])


def test_query_empty_null_and_repeated(spark, tmp_path):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, "a b c d"), (None, "z z z z"), (3, "x y z q"), (3, "other words are here")]
    save(docs(spark, rows), tmp_path)
    found = sorted(map(tuple, jaccard_join.op7_jaccard(spark, str(tmp_path)).collect()), key=str)
    assert found == sorted([(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 2, 1), (None, 1, None), (3, 2, 3), (3, 2, 3)], key=str)
    assert jaccard_join.jaccard_components(docs(spark, [])).count() == 0


def test_bounds_never_lose_a_link():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.05], rng.integers(0, 1 << 63, 2, dtype=np.uint64)]))
        common = len(np.intersect1d(a, b))
        if 100 * common < 80 * (len(a) + len(b) - common):
            continue
        pa_, pb = (jaccard_join.prefix_length(len(x), 80) for x in (a, b))
        shared = np.intersect1d(a[:pa_], b[:pb])
        assert len(shared)
        pos = np.array([np.searchsorted(a, shared[0]), np.searchsorted(b, shared[0])])
        maps = np.frombuffer(jaccard_join.parity_map(a) + jaccard_join.parity_map(b), np.uint64).reshape(2, -1)
        assert (jaccard_join.apart(np.array([len(a), len(b)]), pos, maps, np.array([0]), np.array([1]), 80) <= 1).all()


def test_wide_maps_bound_the_difference():
    rng = np.random.default_rng(5)
    for _ in range(30):
        a = np.unique(rng.integers(0, 1 << 63, int(rng.integers(800, 6000)), dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > rng.random()], rng.integers(0, 1 << 63, 900, dtype=np.uint64)]))
        found = jaccard_join.wide_apart(jaccard_join.wide_map(a), jaccard_join.wide_map(b))
        assert found <= len(np.setxor1d(a, b))
    assert jaccard_join.wide_map(a[:100]) is None


def test_connected_components(spark):
    rng = random.Random(2)
    path = [(i, i + 1) for i in range(500, 700)]
    edges = path + [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(900, 900)]
    rng.shuffle(edges)
    label = {x: x for e in edges for x in e if e[0] != e[1]}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    table = spark.createDataFrame(edges, "u long, v long").repartition(7)
    for one_task in (components.TASK_EDGES, 70):  # in one task, and in seven whose stars meet
        found = components.connected_components(table, task_edges=one_task).collect()
        assert {r.node: r.label for r in found} == label and len(found) == len(label)


def test_words_that_polynomials_confuse_are_not_linked(spark):
    a, b = twins()
    rows = [(1, f"one {a} two three"), (2, f"one {b} two three"), (3, f"One {a} two  three")]
    found = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs(spark, rows)).collect()}
    assert found == {1: 1, 2: 2, 3: 1}


def test_reachable_entries_are_those_that_size_and_position_allow():
    rng = np.random.default_rng(8)
    for _ in range(40):
        m = int(rng.integers(2, 60))
        n = np.sort(rng.integers(1, 40, m))
        pos = np.array([rng.integers(0, jaccard_join.prefix_length(int(x), 80)) for x in n])
        by = np.lexsort((pos, n))
        n, pos = n[by].astype(np.int64), pos[by].astype(np.int64)
        starts = np.flatnonzero(np.diff(n, prepend=-1))
        for i in range(m):
            got = set(jaccard_join.reachable(i, n, pos, (n << 32) + pos, n[starts], starts, 80).tolist())
            need = jaccard_join.least_common(n[i] + n, 80)
            want = {j for j in range(m) if min(n[i], n[j]) >= need[j] and n[i] - pos[i] >= need[j] and n[j] - pos[j] >= need[j]}
            assert want <= got
            assert all(n[j] - pos[j] >= need[j] for j in got)


def test_identity_and_joined_apart(spark):
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 50, 6, dtype=np.uint64)) for _ in range(3000)]
    names = {tuple(s.tolist()): jaccard_join.identity(s) for s in sets}
    assert len({x[0] for x in names.values()}) == len({x[1] for x in names.values()}) == len(names)
    left = spark.createDataFrame([(0, i) for i in range(300)] + [(k, 1000 + k) for k in range(1, 9)], "k long, x long")
    right = spark.createDataFrame([(k, k * 10) for k in range(8)], "k long, y long")
    hot = spark.createDataFrame([(0,)], "k long")
    got = [tuple(r) for r in components.joined_apart(left, right, ["k"], "x", hot, "left").collect()]
    assert len(got) == 308
    assert {(k, x): y for k, x, y in got} == {**{(0, i): 0 for i in range(300)}, **{(k, 1000 + k): k * 10 if k < 8 else None for k in range(1, 9)}}
