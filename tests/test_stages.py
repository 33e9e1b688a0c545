"""Sources, sinks, stages, pipelines, the command line and the stream."""

import numpy as np
import pytest

from pagelattice import cli
from pagelattice.kernels import pages, text
from pagelattice.plans import stages
from pagelattice.schemas import IMAGE_ROWS, to_array, to_struct
from pagelattice.sources import codecs, images
from pagelattice.streaming import watch


@pytest.fixture()
def folder(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    for k, lines in enumerate((["HELLO SUN", "PART 12"], ["RICE AND OIL"])):
        (d / f"p{k}.png").write_bytes(codecs.write_png(text.render(lines)))
    (d / ".hidden.png").write_bytes(b"no")
    return d


def rows(spark, *arrays):
    return spark.createDataFrame([(k, to_struct(a, f"a{k}")) for k, a in enumerate(arrays)] + [(99, None)], IMAGE_ROWS)


def test_scan_and_listing(spark, folder):
    listed = images.list_files(spark, str(folder), "*.png")
    assert [r.name for r in listed.collect()] == ["p0.png", "p1.png"]
    read = images.read_images(spark, str(folder), "p*.png").collect()
    assert sorted(r.image.height for r in read) == sorted([text.render(["A", "B"]).shape[0], text.render(["A"]).shape[0]])
    ours = {r.image.origin[-6:]: to_array(r.image.asDict()) for r in read}
    jvm = {r.image.origin[-6:]: to_array(r.image.asDict()) for r in images.read_builtin(spark, f"{folder}/p*.png").collect()}
    assert all((ours[k] == jvm[k]).all() for k in ours) and set(ours) == set(jvm)
    (folder / "bad.png").write_bytes(b"broken")
    with pytest.raises(Exception, match="bad.png"):
        images.read_images(spark, str(folder), "bad.png").collect()


def test_sinks(spark, folder, tmp_path):
    df = images.read_images(spark, str(folder), "p*.png")
    images.export_images(df, str(tmp_path / "out"))
    assert (codecs.read_png((tmp_path / "out" / "p0.png").read_bytes()) == text.render(["HELLO SUN", "PART 12"])).all()
    images.write_images(df, str(tmp_path / "pq"))
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 2
    images.write_texts(stages.text_of(df), str(tmp_path / "txt"))
    assert {r.text for r in spark.read.parquet(str(tmp_path / "txt")).collect()} == {"HELLO SUN\nPART 12", "RICE AND OIL"} or spark.read.parquet(str(tmp_path / "txt")).count() == 2


def test_vlib_source(spark, tmp_path):
    spark.dataSource.register(images.VlibSource)
    a = np.arange(12, dtype=np.uint8).reshape(3, 4)
    df = spark.createDataFrame([("x.vlib", 3, 4, a.tobytes())], "name string, height int, width int, data binary")
    df.write.format("vlib").option("path", str(tmp_path / "v")).mode("append").save()
    got = spark.read.format("vlib").option("path", str(tmp_path / "v")).load().collect()
    assert [(r.name, r.height, r.width, bytes(r.data)) for r in got] == [("x.vlib", 3, 4, a.tobytes())]


def test_config():
    c = images.Config.parse("seg=s\na=1\na=2\nx=y=z\nbroken\nlate=1")
    assert len(c) == 4 and c.get("a") == "1" and c.get("none") == "" and c[3] == ("x", "y=z")
    assert c.take("a") == "1" and c.take("a") == "2" and c.take("a") == ""


def test_steps_fuse_and_keep_nulls_out(spark):
    page = text.render(["STONE"])
    df = rows(spark, page, np.repeat(page[..., None], 3, 2))
    out = stages.map_images(df, stages.step("gray"), stages.step("binarize"), stages.step("denoise"))
    assert out._jdf.queryExecution().toString().count("MapInArrow") <= 8
    got = out.collect()
    assert len(got) == 2 and all(set(np.unique(to_array(r.image.asDict()))) <= {0, 255} for r in got)
    with pytest.raises(KeyError, match="unknown step"):
        stages.step("sharpen")
    assert (to_array(got[0].image.asDict()) == pages.salt_pepper_denoise(pages.binarize(page))).all()


def test_partitions_do_not_matter(spark):
    df = rows(spark, *[text.render([w]) for w in ("SUN", "RAIN", "COLD", "HEAT")])
    one, many = (sorted((r.image_id, bytes(r.image.data)) for r in stages.map_images(df.repartition(n), stages.step("cca")).collect()) for n in (1, 4))
    assert one == many


def test_pipeline_and_cli(spark, folder, tmp_path):
    (tmp_path / "c.conf").write_text("border=b\ndenoise=dn\nbinarize=bin\n")
    out = cli.main(["-d", "-i", f"{folder}/p*.png", "-c", str(tmp_path / "c.conf"), "-o", str(tmp_path / "o")])
    assert set(out) == {"b", "dn", "bin", "text"}
    assert spark.read.parquet(out["bin"]).count() == 2 and spark.read.parquet(out["text"]).count() == 2
    pieces = stages.process_images(images.read_images(spark, str(folder), "p*.png"))
    assert pieces.select("image_id").distinct().count() == 2


def test_stacking(spark):
    a, b = np.zeros((2, 3), np.uint8), np.full((1, 5), 9, np.uint8)
    df = spark.createDataFrame([(1, 1, to_struct(b)), (1, 0, to_struct(a))], "image_id long, piece int, " + IMAGE_ROWS.split(", ", 1)[1])
    whole = to_array(stages.stacked(df).first().image.asDict())
    assert whole.tolist() == [[0, 0, 0, 255, 255], [0, 0, 0, 255, 255], [9, 9, 9, 9, 9]]


def test_watch(spark, folder, tmp_path):
    q = watch.watch(spark, str(folder), str(tmp_path / "o"), str(tmp_path / "cp"), stages.step("binarize"), pattern="p*.png")
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "o")).count() == 2


def test_schema_checks():
    with pytest.raises(ValueError):
        to_array({"height": 2, "width": 2, "nChannels": 3, "mode": 0, "data": b"1234"})
    with pytest.raises(ValueError):
        to_array({"height": 2, "width": 2, "nChannels": 1, "mode": 0, "data": b"123"})
