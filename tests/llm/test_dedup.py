"""Substring dedup by words and by bytes against brute force."""

import hashlib
import random
import re

import numpy as np

from pagelattice.llm import seeds, substring_dedup, suffix_dedup
from tests.llm.cases import docs, save, twins


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = ["a", "bb", "cé", "ddd", "the", "of"] + [f"w{i}" for i in range(300)]
    phrase = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    shared = [phrase(k) for k in (10, 30, 49, 50, 51, 70, 200, 55)]
    out = [(0, None), (1, ""), (2, "  \n\t "), (3, "tick " * 3000), (4, "tick " * 200), (5, "x")]
    for d in range(6, n):
        words = phrase(rng.randrange(60))
        for _ in range(rng.randrange(4)):
            part = list(rng.choice(shared))
            if rng.random() < 0.3:
                part[rng.randrange(len(part))] = "odd"
            cut = rng.randrange(len(part)) if rng.random() < 0.3 else 0
            words += part[cut:] + phrase(rng.randrange(40))
        out.append((d, rng.choice([" ", "\n", "  "]).join(words)))
    out += [(n + k, out[20 + k][1]) for k in range(5)]
    return out + [(n + 10, f"{out[30][1]} tail {k}") for k in range(1)] + [(30, out[30][1])]


def brute_words(rows, width=50):
    first, words = {}, {}
    for d, t in rows:
        words[d] = w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            first[key] = min(d, first.get(key, d))
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i : i + width])] < d:
                gone[i : i + width] = [True] * width
        out[d] = len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest()
    return out


def brute_bytes(rows, width=100):
    seen, out = {}, {}
    for d, t in sorted(set(rows), key=lambda r: r[0]):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - width + 1):
            if seen.setdefault(raw[i : i + width], (d, i)) != (d, i):
                gone[i : i + width] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1)
        out[d] = len(raw), int(gone.sum()), len(edges), hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()
    return out


def test_anchors_are_leftmost_minima():
    rng = np.random.default_rng(1)
    for per in (1, 2, 5, 26):
        grams = rng.integers(0, 6, 400).astype(np.uint64) << np.uint64(40)
        got = seeds.anchors(grams, per)
        assert got.tolist() == [i + int(np.argmin(grams[i : i + per])) for i in range(len(grams) - per + 1)]


def test_words_match_brute_force(spark, tmp_path):
    for seed in (1, 2):
        rows = corpus(seed)
        save(docs(spark, rows), tmp_path)
        found = substring_dedup.op1_substring_dedup(spark, str(tmp_path)).collect()
        want = brute_words(rows)
        assert len(found) == len(rows)
        assert all((r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id] for r in found)


def test_bytes_match_brute_force(spark, tmp_path):
    for seed, block in ((3, 1 << 20), (4, 2000)):
        rows = corpus(seed)
        rows.append((900, "é" * 500))
        rows.append((901, "xy" + "é" * 130 + "ab" * 400))
        found = suffix_dedup.digest(docs(spark, rows), block_bytes=block).collect()
        want = brute_bytes(rows)
        assert len(found) == len(rows)
        bad = [r for r in found if (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) != want[r.doc_id]]
        assert not bad, (bad[0], want[bad[0].doc_id])
    save(docs(spark, rows), tmp_path)
    assert suffix_dedup.op5_suffix_dedup(spark, str(tmp_path)).count() == len(rows)


def test_common_lines_and_passages(spark):
    """One line and one passage in most documents, with other text around them: wide anchors."""
    rng = random.Random(21)
    line = " ".join(f"line{k}" for k in range(30))
    passage = " ".join(f"pass{k}" for k in range(60))
    word = lambda: f"w{rng.randrange(10**6)}"
    rows = []
    for d in range(150):
        parts = [word() for _ in range(rng.randrange(1, 30))] + [line] + [word() for _ in range(rng.randrange(1, 30))]
        if d % 3:
            parts += [passage] + [word() for _ in range(rng.randrange(3))]
        rows.append((d, " ".join(parts)))
    rows += [(200 + k, rows[4][1]) for k in range(40)]
    want = brute_words(rows)
    found = substring_dedup.digest(docs(spark, rows).repartition(3)).collect()
    assert all((r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id] for r in found) and len(found) == len(rows)
    want = brute_bytes(rows)
    for block in (1 << 20, 3000):
        found = suffix_dedup.digest(docs(spark, rows).repartition(3), block_bytes=block).collect()
        assert all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id] for r in found) and len(found) == len(rows)


def test_run_length_index_statistics():
    rng = random.Random(9)
    for _ in range(60):
        pieces = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 30))) for _ in range(rng.randrange(1, 8))]
        index = suffix_dedup.RunLengthIndex(pieces)
        where = {}
        for width in (1, 3, 6):
            seen, want = set(), []
            for p in pieces:
                for i in range(len(p) + 1):
                    s = p[i : i + width]
                    want.append(len(s) == width and s in seen)
                    if len(s) == width:
                        seen.add(s)
            assert index.repeats(width).tolist() == want, (pieces, width, where)
        match, length = index.matching_statistics()
        assert (match[length > 0] >= 0).all()
        assert index.runs <= len(index.text)


def test_null_ids_and_empty(spark):
    rows = [(None, "w " * 80), (None, "w " * 80), (7, "w " * 80)]
    for f in (substring_dedup.digest, suffix_dedup.digest):
        assert f(docs(spark, [])).count() == 0
        assert len(f(docs(spark, rows)).collect()) == 3
    assert {r.n_removed for r in substring_dedup.digest(docs(spark, rows)).collect()} == {0}


def test_large_ids_beside_null_ids(spark):
    """Ids beyond 2**53, one apart, in one batch with a row without id."""
    rng = random.Random(31)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    base = 2**53
    rows = [(base, text), (base + 1, text + " more words"), (None, "no id " * 40), (base + 2, " ".join(f"v{rng.randrange(10**6)}" for _ in range(60)) + " " + text)]
    for f, brute in ((substring_dedup.digest, brute_words), (suffix_dedup.digest, brute_bytes)):
        want = brute([r for r in rows if r[0] is not None])
        found = {r.doc_id: tuple(r)[1:] for r in f(docs(spark, rows).coalesce(1)).collect()}
        assert all(found[i] == want[i] for i in want) and len(found) == 4
        assert found[base + 1][1] > 0 and found[base + 2][1] > 0


def test_words_that_polynomials_confuse(spark):
    a, b = twins()
    filler = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join([*filler[:30], a, *filler[30:]])), (2, " ".join([*filler[:30], b, *filler[30:]])), (3, " ".join([*filler[:30], a, *filler[30:]]))]
    want = brute_words(rows)
    assert {r.doc_id: tuple(r)[1:] for r in substring_dedup.digest(docs(spark, rows)).collect()} == want and want[2][1] == 0
    rows = [(1, a + "x" * 50), (2, b + "x" * 50), (3, b + "y" * 50)]
    want = brute_bytes(rows)
    assert {r.doc_id: tuple(r)[1:] for r in suffix_dedup.digest(docs(spark, rows)).collect()} == want


def test_word_hashes_tell_words_apart():
    from pagelattice.llm.common import word_hashes

    rng = random.Random(4)
    words = list({bytes(rng.choice(b"ab") for _ in range(rng.choice([1, 2, 7, 8, 9, 15, 16, 17, 127, 128, 129, 300]))) for _ in range(3000)}) + [t.encode() for t in twins()]
    data = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    for h in word_hashes(data, starts, ends):
        assert len(np.unique(h)) == len(words)
    again = np.frombuffer(b"zz" + b"  ".join(words), np.uint8)
    ends2 = np.cumsum([len(w) + 2 for w in words])
    assert all((x == y).all() for x, y in zip(word_hashes(data, starts, ends), word_hashes(again, ends2 - [len(w) for w in words], ends2)))
