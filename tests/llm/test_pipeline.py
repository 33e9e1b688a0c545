"""The pipeline: every stage's decision takes effect and clean documents pass unchanged."""

import hashlib
import random

from pyspark.sql import functions as F

import corpus_pipeline
from pagelattice.llm import bpe
from tests.llm.cases import CLASHING, docs, save
from tests.llm.test_models import prose


def fixture(spark, path):
    rng = random.Random(12)
    rows = [(i, prose(rng, lang, rng.randrange(20, 80)), lang) for i, lang in enumerate(rng.choice(["en", "es", "de"]) for _ in range(200))]
    item = prose(random.Random(77), "de", 14)
    near = rows[5][1].split()
    near[-1] = "changed"
    extra = [
        (300, " ".join(rng.choice(["%%%", "###", "$$$"]) for _ in range(50)), "en"),  # junk
        (301, rows[3][1], rows[3][2]),  # exact copy
        (302, " ".join(near), rows[5][2]),  # near copy
        (303, rows[7][1] + " " + item + " " + rows[8][1][:60], rows[7][2]),  # benchmark passage
        (305, rows[10][1] + ' token = "abcdefgh12" ' + prose(rng, "en", 40), "en"),  # secret
        (306, None, None),
        (None, prose(rng, "en", 30), "en"),
    ]
    save(docs(spark, rows + extra), path)
    save(spark.createDataFrame([(i, 1, 0) for i in range(0, 200, 2)] + [(300, 0, 0)], "doc_id long, quality int, toxic int"), path, "labels")
    save(spark.createDataFrame([(0, item)], "item_id long, text string"), path, "benchmark")
    return rows, extra, item


def test_stages(spark, tmp_path):
    rows, extra, item = fixture(spark, tmp_path)
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    now, texts = table, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == table.columns, name
        texts.append({r.doc_id: r.text for r in now.collect()})
    quality, near, clean, secret = texts
    assert 300 not in quality and 306 not in quality and {0, 5, 199, 303, 305, None} <= set(quality)
    assert 301 not in near and 302 not in near and {3, 5, 305, None} <= set(near)
    assert item in near[303] and item not in clean[303] and clean[303].startswith(rows[7][1])
    assert "abcdefgh12" not in secret[305]
    assert all(secret[i] == rows[i][1] for i in range(200) if i in secret) and sum(i in secret for i in range(200)) >= 198
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == set(secret)
    v = bpe.vocabulary(bpe.default_path())
    for i in (0, 303, 305):
        assert out[i].ids_sha256 == hashlib.sha256(",".join(map(str, v.encode(secret[i]))).encode()).hexdigest()
        assert out[i].decoded_sha256 == hashlib.sha256(secret[i].encode()).hexdigest()


def test_empty(spark, tmp_path):
    save(docs(spark, []), tmp_path)
    save(spark.createDataFrame([], "doc_id long, quality int, toxic int"), tmp_path, "labels")
    save(spark.createDataFrame([], "item_id long, text string"), tmp_path, "benchmark")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_repeated_ids_and_clashing_names(spark, tmp_path):
    """A row goes by its own text: one doc_id may hold a copy and a text of its own. Extra columns pass every stage as they are."""
    rows, extra, item = fixture(spark, tmp_path)
    rng = random.Random(13)
    own = prose(rng, "es", 70)
    table = spark.read.parquet(f"{tmp_path}/documents.parquet").union(docs(spark, [(5000, rows[3][1]), (5000, own, "es")]))
    for name in CLASHING:
        table = table.withColumn(name, F.concat(F.lit(name), F.col("doc_id").cast("string")))
    now = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == table.columns, name
        if name == "near_duplicates":
            assert [r.text for r in now.where("doc_id = 5000").collect()] == [own]
    assert all(r[name] == f"{name}{r.doc_id}" for r in now.where("doc_id is not null").collect() for name in CLASHING)
    assert corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).count() == now.count()
