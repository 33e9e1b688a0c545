"""Language ID, quality, nearest neighbours and extraction: held-out accuracy, brute force and awkward cases."""

import math
import random
from collections import Counter, defaultdict

import numpy as np

from pagelattice.llm import language_id, quality
from tests.llm.cases import docs, save

SYLLABLES = {"en": ["the", "ing", "tion", "er", "wh", "sh"], "es": ["ción", "ñ", "que", "ado", "rr", "os"], "de": ["sch", "ung", "ein", "ü", "ß", "keit"]}


def prose(rng, lang, words):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(words))


def test_language_held_out(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, prose(rng, lang, rng.randrange(5, 60)), lang) for i, lang in enumerate(rng.choice(list(SYLLABLES)) for _ in range(300))]
    rows += [(1000, None, "en"), (1001, "123 !!", "en"), (1002, "", None), (None, prose(rng, "de", 30), "xx"), (1003, "語" * 9000, None)]
    save(docs(spark, rows), tmp_path)
    found = {r.doc_id: r for r in language_id.op2_language(spark, str(tmp_path)).collect()}
    assert len(found) == len(rows)
    held = [r for r in found.values() if r.held_out and r.doc_id is not None and r.doc_id < 1000]
    lang = {r[0]: r[2] for r in rows}
    assert len(held) > 30 and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all((found[i].lang_pred, found[i].score) == ("und", 0.0) for i in (1000, 1001, 1002))
    assert found[None].held_out is False and all(0 <= r.score <= 1 and r.lang_pred in (*SYLLABLES, "und") for r in found.values())
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found.values() if r.doc_id is not None)


def test_profiles_equal_direct_bundling():
    texts = ["Ab, c", "é9é", ""]
    vector = lambda c: language_id.letter_vector(c, 64, 5).astype(int) if c else np.ones(64, int)
    for text, made in zip(texts, language_id.profiles(texts, 64, 5)):
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        want = np.zeros(64, int)
        for w in words:
            s = [0, *map(ord, w), 0]
            for i in range(len(s) - 2):
                bound = np.ones(64, int)
                for k, c in enumerate(s[i : i + 3]):
                    bound = bound * np.roll(language_id.letter_vector(c, 64, 5).astype(int), 2 - k)
                want += bound
        assert np.allclose(made, want), text
    assert vector(0).sum() == 64


def test_language_without_training(spark, tmp_path):
    save(docs(spark, [(1, "hello", None)]), tmp_path)
    assert [r.lang_pred for r in language_id.op2_language(spark, str(tmp_path)).collect()] == ["und"]
    save(docs(spark, []), tmp_path)
    assert language_id.op2_language(spark, str(tmp_path)).count() == 0


def kneser_ney(texts, order, size, alphabet):
    """A direct, recursive modified Kneser-Ney model: returns p(symbol | symbols before)."""
    counts = [None] * (order + 1)
    counts[order] = Counter()
    for t in texts:
        codes, _ = quality.fold([t])
        s = [0] * (order - 1) + alphabet.numbers(codes).tolist()
        for i in range(order - 1, len(s)):
            counts[order][tuple(s[i - order + 1 : i + 1])] += 1
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cuts, by_context = [None] * (order + 1), [None] * (order + 1)
    for k in range(1, order + 1):
        n = Counter(counts[k].values())
        if n[1] and n[2]:
            y = n[1] / (n[1] + 2 * n[2])
            raw = 1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 2.0
            cuts[k] = [min(max(d, 0.05), j - 0.05) for d, j in zip(raw, (1, 2, 3))]
        else:
            cuts[k] = [0.5] * 3
        by_context[k] = defaultdict(list)
        for g, c in counts[k].items():
            by_context[k][g[:-1]].append(c)

    def p(g):
        k = len(g)
        if not k:
            return 1 / size
        seen = by_context[k].get(g[:-1])
        if not seen:
            return p(g[1:])
        cut = lambda c: cuts[k][min(c, 3) - 1]
        c = counts[k].get(g, 0)
        return (max(c - cut(c), 0) if c else 0) / sum(seen) + sum(map(cut, seen)) / sum(seen) * p(g[1:])

    return p


def test_quality_model_matches_direct_kneser_ney(spark):
    rng = random.Random(6)
    texts = [prose(rng, "es", rng.randrange(1, 30)) for _ in range(40)]
    order, size = 3, 16
    model = quality.train(docs(spark, list(enumerate(texts))), order, size)
    p = kneser_ney(texts, order, size, model.alphabet)
    for t in texts[:5] + ["zzz ??", "The %%%", "x"]:
        codes, _ = quality.fold([t])
        s = [0] * (order - 1) + model.alphabet.numbers(codes).tolist()
        want = sum(math.log(p(tuple(s[i - order + 1 : i + 1]))) for i in range(order - 1, len(s)))
        n, total = model.score([t])
        assert n[0] == len(codes) and abs(total[0] - want) < 1e-3 * max(1, abs(want))
    context = model.logs.astype(float).reshape(-1, size)
    assert np.allclose(np.exp(context).sum(1), 1, atol=1e-2)


def test_quality_keeps_clean_rejects_junk(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, prose(rng, lang, rng.randrange(8, 80)), lang) for i, lang in enumerate(rng.choice(list(SYLLABLES)) for _ in range(300))]
    junk = [(1000 + i, " ".join(rng.choice(["%%%", "###", "x9$", "|", "&&&"]) for _ in range(40)), "en") for i in range(20)]
    odd = [(2000, None, "en"), (2001, "", "en"), (2002, " \n", None), (2003, prose(rng, "en", 9000), None), (None, prose(rng, "en", 30), "en")]
    save(docs(spark, rows + junk + odd), tmp_path)
    save(spark.createDataFrame([(i, 1, 0) for i in range(0, 300, 2)] + [(1, None, None), (3, 0, 1), (None, 1, 0), (0, 1, 0)], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    found = {r.doc_id: r for r in quality.op10_quality(spark, str(tmp_path)).collect()}
    assert len(found) == len(rows + junk + odd)
    assert all(found[i].keep for i in range(300)) and not any(found[1000 + i].keep for i in range(20))
    assert not found[2000].keep and not found[2001].keep and not found[2002].keep and found[2003].keep and found[None].keep
    assert found[2000].perplexity is None


def test_quality_reads_the_texts_twice(spark):
    """Once for the alphabet, once for the counts of all orders."""
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    texts = docs(spark, [(i, f"text {i} of some words") for i in range(30)]).select("text").mapInArrow(run, "text string")
    assert quality.train(texts).levels is not None
    assert seen.value == 60


def test_quality_of_many_scripts_sent_or_joined(spark):
    rng = random.Random(9)
    greek, han = [chr(c) for c in range(0x3B1, 0x3C9)], [chr(c) for c in range(0x4E00, 0x4E00 + 600)]
    texts = ["".join(rng.choice(letters[k % 7 :: 7]) for k in range(60)) for letters in (greek, han) for _ in range(40)]
    junk = ["".join(rng.choice(han) for _ in range(60)) for _ in range(5)] + ["".join(map(chr, range(0xAC00, 0xAC00 + 60)))]
    data = docs(spark, [(i, t, None) for i, t in enumerate(texts + junk + ["", None])])
    model = quality.train(data.where("doc_id < 80"))
    assert len(model.alphabet.points) > 500 and model.size == len(model.alphabet.points) + 2
    p = kneser_ney(texts, quality.ORDER, model.size, model.alphabet)
    for t in [texts[0], texts[-1], junk[0], junk[-1]]:
        codes, _ = quality.fold([t])
        s = [0] * 3 + model.alphabet.numbers(codes).tolist()
        want = sum(math.log(p(tuple(s[i - 3 : i + 1]))) for i in range(3, len(s)))
        assert abs(model.score([t])[1][0] - want) < 1e-3 * abs(want)
    sent = {r.doc_id: r for r in quality.scored(data, model).collect()}
    assert min(sent[80 + i]["perplexity"] for i in range(6)) > 3 * max(sent[i]["perplexity"] for i in range(80))
    bad = data.where("doc_id >= 80 and doc_id < 85").select("text")
    model, large = (quality.train(data.where("doc_id < 80"), most_sent=n, toxic=bad) for n in (None, 0))
    sent = {r.doc_id: r for r in quality.scored(data, model).collect()}
    assert large.levels is None
    joined = {r.doc_id: r for r in quality.scored(data, large).collect()}
    assert sent.keys() == joined.keys()
    for i, r in sent.items():
        assert r["n_symbols"] == joined[i]["n_symbols"] and (r["perplexity"] is None) == (joined[i]["perplexity"] is None)
        assert r["perplexity"] is None or all(abs(r[x] - joined[i][x]) < 1e-4 * max(1, abs(r[x])) for x in quality.FIGURES)


def test_quality_rejects_toxic_words_and_repeats_in_clean_text(spark, tmp_path):
    rng = random.Random(10)
    prose_of = lambda n: " ".join("".join(rng.choice("bdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(2, 5))) for _ in range(n))
    insults = ["kwyjibo", "fnordix", "quuxly"]
    insulting = lambda: f"{prose_of(60)} {rng.choice(insults)} {prose_of(60)}"
    clean = [prose_of(rng.randrange(60, 150)) for _ in range(300)]
    bad = [insulting() for _ in range(90)]
    word = prose_of(1)
    again = [f"{prose_of(50)} {' '.join([w] * 30)} {prose_of(50)}" for w in (word, *(prose_of(1) for _ in range(9)))]
    rows = [(i, t, "en") for i, t in enumerate(clean)] + [(1000 + i, t, "en") for i, t in enumerate(bad)] + [(2000 + i, t, "en") for i, t in enumerate(again)]
    save(docs(spark, rows), tmp_path)
    labels = [(i, 1, 0) for i in range(0, 300, 2)] + [(1000 + i, 1, 1) for i in range(40)]
    save(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), tmp_path, "labels")
    keep = {r.doc_id: r.keep for r in quality.op10_quality(spark, str(tmp_path)).collect()}
    assert sum(keep[i] for i in range(300)) >= 297
    assert not any(keep[1000 + i] for i in range(90))
    assert not any(keep[2000 + i] for i in range(10))


def test_quality_without_labels(spark, tmp_path):
    save(docs(spark, [(1, "abc"), (2, None)]), tmp_path)
    save(spark.createDataFrame([], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    assert {r.doc_id: r.keep for r in quality.op10_quality(spark, str(tmp_path)).collect()} == {1: True, 2: False}
    save(docs(spark, []), tmp_path)
    assert quality.op10_quality(spark, str(tmp_path)).count() == 0


def nearest_brute(rows, k=10):
    out = {}
    good = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    for q, x in good.items():
        if q % 100 == 0:
            out[q] = sorted((math.sqrt(((x - y) ** 2).sum()), i) for i, y in good.items() if i != q)[:k]
    return out


def test_nearest_exact_on_small_and_recall_on_larger(spark, tmp_path):
    from pagelattice.llm import nearest

    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[0][1]) for i in range(60)]  # copies: ties go to the smaller id
    rows += [(2000, None), (2100, [0.0] * 8), (2200, [float("nan")] + [1.0] * 7), (2300, [float("inf")] * 8), (2400, [None] + [1.0] * 7), (2500, [1.0] * 3), (None, [1.0] * 8), (100, rows[100][1])]
    schema = "vec_id long, embedding array<float>, label int, v string"
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    save(spark.createDataFrame([(i, v, 0, "clash") for i, v in rows], schema), tmp_path, "embeddings")
    found = {}
    for r in nearest.op8_nearest(spark, str(tmp_path)).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    want = nearest_brute(rows)
    assert set(found) == set(want)
    hits = 0
    for q, near in want.items():
        got = sorted(found[q])
        assert [r for r, _, _ in got] == list(range(1, 11))
        assert [s for _, s, _ in got] == sorted(s for _, s, _ in got)
        hits += len({i for _, i in near} & {i for _, _, i in got})
    assert hits >= 0.9 * 10 * len(want)
    assert [i for _, _, i in sorted(found[0])] == list(range(1000, 1010))


def test_nearest_few_and_none(spark, tmp_path):
    from pagelattice.llm import nearest

    schema = "vec_id long, embedding array<float>"
    save(spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.5]), (2, [3.0, 1.0])], schema), tmp_path, "embeddings")
    got = nearest.op8_nearest(spark, str(tmp_path)).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 2)] and got[0].score == 0.5
    save(spark.createDataFrame([], schema), tmp_path, "embeddings")
    assert nearest.op8_nearest(spark, str(tmp_path)).count() == 0


def test_hilbert_neighbours_are_adjacent_cells():
    from pagelattice.llm import nearest

    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
        keys = nearest.hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        steps = np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1)
        assert (steps == 1).all()


def test_nearest_recall_in_64_dimensions(spark):
    from pagelattice.llm import nearest

    rng = np.random.default_rng(12)
    v = rng.normal(size=(5000, 64))
    v = (v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32)
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(4)
    found = nearest.search(table, table.where("vec_id % 100 = 0")).collect()
    exact = v.astype(float)
    hits = 0
    for q in range(0, 5000, 100):
        far = np.sqrt(((exact - exact[q]) ** 2).sum(1))
        far[q] = np.inf
        want = set(np.lexsort((np.arange(5000), far))[:10].tolist())
        mine = [r for r in found if r.query_id == q]
        assert sorted(r["rank"] for r in mine) == list(range(1, 11)) and all(abs(r.score - far[r.vec_id]) < 1e-12 for r in mine)
        hits += len(want & {r.vec_id for r in mine})
    assert hits >= 0.9 * 500, hits


def test_rounded_vectors_stay_within_half_a_step():
    from pagelattice.llm import nearest

    v = np.concatenate([np.random.default_rng(1).normal(size=(50, 8)) * 10.0 ** np.arange(-25, 25)[:, None], [[1e-310] * 8]])
    scale, small = nearest.rounded(v)
    assert (np.abs(small * scale[:, None] - v) <= scale[:, None] * 0.5000001).all()
