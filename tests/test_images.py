"""Codecs, the bundle source, tools, column functions and aggregates against hand-made values and numpy."""

import struct
import subprocess
import sys
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenframe import tools
from lumenframe.codecs import exif, jpeg, matrix, netpbm, payloads, png
from lumenframe.functions import pixels as px
from lumenframe.functions import text as tx
from lumenframe.operators import aggregates as ag
from lumenframe.operators import ordering
from lumenframe.plans import catalog
from lumenframe.schema import STORAGE_FORMATS, enum_value, valid
from lumenframe.sources import bundle, files

RAMP = np.arange(18, dtype=np.uint8).reshape(2, 3, 3)


def test_codecs_round_trip_and_refuse_damage():
    for codec in (png, netpbm):
        assert (codec.decode(codec.encode(RAMP)) == RAMP).all()
        assert codec.read_header(codec.encode(RAMP)) == (3, 2, 3)
    broken = bytearray(png.encode(RAMP))
    broken[20] ^= 1
    with pytest.raises(ValueError):
        png.decode(bytes(broken))
    assert jpeg.read_header(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x07\x00\x09\x03" + bytes(9)) == (9, 7, 3)
    assert jpeg.read_header(b"nothing") is None
    m = np.arange(6, dtype=np.float32).reshape(2, 3)
    assert matrix.encode(m)[:12] == struct.pack(">iii", 5, 2, 3) and (matrix.decode(matrix.encode(m)) == m).all()


def test_bundle_import_lookup_splits_and_export(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(5):
        (folder / f"{i}.{'png' if i % 2 else 'ppm'}").write_bytes((png if i % 2 else netpbm).encode(RAMP + i))
    (folder / "bad.png").write_bytes(b"bad")
    out = str(tmp_path / "bundle")
    tools.import_images(spark, str(folder), out)
    images = tools.load(spark, out)
    rows = images.orderBy("image_index").collect()
    assert [r["meta"]["filename"] for r in rows] == ["0.ppm", "1.png", "2.ppm", "3.png", "4.ppm"]
    assert [(r["width"], r["height"], r["bands"]) for r in rows] == [(3, 2, 3)] * 5
    assert tools.info(images, 3).collect()[0]["meta"]["filename"] == "3.png" and not tools.info(images, 9).collect()
    first = bundle.bundles(out)[0]
    assert len(bundle.offsets(first, 1)) == 1
    assert open(first, "rb").read(24) == struct.pack(">IqqI", 0x81911B18, 0, 0, 0)
    reader = bundle.BundleReader(out, {"numPartitions": "2"})
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 5
    tools.extract(images, 1, str(tmp_path / "one.ppm"))
    assert (netpbm.decode((tmp_path / "one.ppm").read_bytes()) == RAMP + 1).all()
    with pytest.raises(Exception):
        tools.import_images(spark, str(folder) + "/none", out)


def test_column_functions(spark):
    df = spark.createDataFrame([(x,) for x in (-10, -1, 0, 100, 255, 256, 348394)], "v int")
    assert [r[0] for r in df.select(px.clamp_byte(F.col("v"))).collect()] == [0, 0, 0, 100, 255, 255, 255]
    one = spark.createDataFrame([([0.5, 0.2, 0.1, 1.0, 0.0, 0.0], b"\x00\x0f\xab", 2, 1, 3, -5)], "p array<double>, b binary, width int, height int, bands int, n int")
    r = one.select(
        px.to_byte(F.lit(0.5)).alias("half"), px.rgb_to_lum(F.col("p")).alias("lum"), px.rgb_to_lum(F.col("p"), True).alias("red"), px.crop(F.col("p"), F.col("width"), F.col("height"), F.col("bands"), 1, 0, 1, 1).alias("crop"),
        px.equals(F.col("p"), px.add_scalar(F.col("p"), 0.1), 0.11).alias("same"), tx.byte_dump(F.col("b"), 2).alias("dump"), tx.bytes_to_int(tx.int_to_bytes(F.col("n"))).alias("n"), tx.raster_string(F.col("p")).alias("s"),
    ).first()
    assert r["half"] == 127 and r["lum"] == pytest.approx([0.279, 0.3]) and r["red"] == [0.5, 1.0] and r["crop"] == [1.0, 0.0, 0.0]
    assert r["same"] and r["dump"] == "0x00 0x0F" and r["n"] == -5 and r["s"] == "FloatImage: 2 x 1 x 3 [(0.50 0.20 0.10) (1.00 0.00 0.00)]"


def test_patches_covariance_and_components(spark):
    rng = np.random.default_rng(1)
    arrays = [rng.random((9, 7)) for _ in range(3)]
    rows = [(2, 7, 9, 1, a.ravel().tolist()) for a in arrays] + [(0, 7, 9, 1, arrays[0].ravel().tolist()), (2, 7, 9, 1, None)]
    images = spark.createDataFrame(rows, "color_space int, width int, height int, bands int, pixels array<double>")
    mean = np.array([r["v"] for r in ag.mean_patch(images, 3, 2).orderBy("pos").collect()])
    assert mean == pytest.approx(np.mean([ag.patches(a, 3, 2).mean(axis=0) for a in arrays], axis=0))
    found = {(r["i"], r["j"]): r["v"] for r in ag.covariance(images, mean, 3, 2, 1.0).collect()}
    w = ag.gaussian(3, 1.0).ravel()
    want = sum(p.T @ p for p in ((ag.patches(a, 3, 2) - mean) * w for a in arrays))
    assert np.array([[found[i, j] for j in range(9)] for i in range(9)]) == pytest.approx(want)
    values, vectors = ag.principal_components(want, 4)
    assert want @ vectors[0] == pytest.approx(values[0] * vectors[0])
    with pytest.raises(ValueError):
        ag.patches(np.zeros((2, 9)), 3, 2)


def test_order_without_one_task(spark):
    df = spark.range(0, 50, numPartitions=5).select((F.col("id") * 7 % 50).alias("k"), F.lit("kept").alias("_part"), F.lit("kept").alias("_lf_one"))
    assert ordering.indexed(df, ["k"]).filter("_part = 'kept' and _lf_one = 'kept'").count() == 50
    got = ordering.splits(ordering.indexed(df, ["k"]), "image_index", 4, 50)
    assert sorted((r["k"], r["image_index"]) for r in got.collect()) == [(i, i) for i in range(50)]
    assert sorted(r["count"] for r in got.groupBy("split").count().collect()) == [12, 12, 13, 13]


def photo(h=93, w=131):
    y, x = np.mgrid[:h, :w]
    return np.clip(np.stack([(x * 1.5 + y) % 256, 128 + 100 * np.sin(x / 9) * np.cos(y / 7), (y * 2) % 256], 2), 0, 255).astype(np.uint8)


def psnr(a, b):
    return 10 * np.log10(255**2 / max(1e-9, ((a.astype(float) - b) ** 2).mean()))


@pytest.mark.parametrize("pixels", [photo(), photo(1, 1), photo(8, 8), photo(17, 40), np.full((9, 9, 3), 77, np.uint8)])
def test_jpeg_round_trip(pixels):
    data = jpeg.encode(pixels)
    assert jpeg.read_header(data) == (pixels.shape[1], pixels.shape[0], 3) and psnr(jpeg.decode(data), pixels) > 30


def test_jpeg_refuses_what_it_cannot_read():
    data = jpeg.encode(photo())
    for bad in (b"", b"no image", data[:40], data[: len(data) // 2][:400]):
        assert files.pixels_of(bad, 1) is None
    with pytest.raises(ValueError):
        jpeg.encode(photo()[:, :, :1])
    assert files.pixels_of(data, 9) is None


def test_jpeg_agrees_with_the_virtual_machines_codec(spark, tmp_path):
    io, file = spark._jvm.javax.imageio, spark._jvm.java.io.File

    def read(path):
        image = io.ImageIO.read(file(str(path)))
        w, h = image.getWidth(), image.getHeight()
        rgb = np.array(list(image.getRGB(0, 0, w, h, None, 0, w)), np.int64)
        return np.stack([rgb >> 16 & 255, rgb >> 8 & 255, rgb & 255], 1).reshape(h, w, 3)

    (tmp_path / "own.jpg").write_bytes(jpeg.encode(photo()))
    assert abs(read(tmp_path / "own.jpg") - jpeg.decode((tmp_path / "own.jpg").read_bytes()).astype(int)).max() <= 3
    (tmp_path / "a.png").write_bytes(png.encode(photo()))
    source = io.ImageIO.read(file(str(tmp_path / "a.png")))
    for progressive in (False, True):  # with chrominance at half size
        path = tmp_path / f"{progressive}.jpg"
        writer = io.ImageIO.getImageWritersByFormatName("jpeg").next()
        how = writer.getDefaultWriteParam()
        if progressive:
            how.setProgressiveMode(1)
        out = io.ImageIO.createImageOutputStream(file(str(path)))
        writer.setOutput(out)
        writer.write(None, io.IIOImage(source, None, None), how)
        out.close()
        assert abs(read(path) - jpeg.decode(path.read_bytes()).astype(int)).max() <= 4


def test_png_filters_agree_with_a_plain_loop():
    rng = np.random.default_rng(5)
    lines, kinds = rng.integers(0, 256, (11, 7, 3), dtype=np.uint8), rng.integers(0, 5, 11).astype(np.uint8)
    want = np.zeros((11, 7, 3), int)
    for y in range(11):
        for x in range(7):
            for c in range(3):
                a = want[y, x - 1, c] if x else 0
                b = want[y - 1, x, c] if y else 0
                d = want[y - 1, x - 1, c] if x and y else 0
                paeth = min((abs(b - d), 0, a), (abs(a - d), 1, b), (abs(a + b - 2 * d), 2, d))[2]
                want[y, x, c] = (int(lines[y, x, c]) + [0, a, b, (a + b) // 2, paeth][kinds[y]]) % 256
    assert (png._unfiltered(kinds, lines).reshape(11, 7, 3) == want).all()


def test_exif():
    tagged = lambda t: (d := jpeg.encode(photo(8, 8)))[:2] + exif.block(t) + d[2:]
    assert exif.read(tagged({0x0110: "Canon PowerShot S500", 0x010F: "abc"}), 1) == {"Model": "Canon PowerShot S500", "Make": "abc"}
    assert exif.read(jpeg.encode(photo(8, 8)), 1) == {} and exif.read(png.encode(photo(8, 8)), 2) == {} and exif.parse(b"MM") == {}
    little = b"II*\0\x08\0\0\0\x02\0" + struct.pack("<HHIHH", 0x0112, 3, 1, 6, 0) + struct.pack("<HHII", 0x8769, 4, 1, 38) + bytes(4) + b"\x01\0" + struct.pack("<HHII", 0x829A, 5, 1, 56) + bytes(4) + struct.pack("<II", 1, 60)
    assert exif.parse(little) == {"Orientation": "6", "Exposure Time": "1/60"}
    assert exif.parse(little[:30]) == {"Orientation": "6"}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("mixed")
    for i, model in enumerate(["One", "Two", None]):
        d = jpeg.encode(photo(20, 30 + i))
        (at / f"{i}.jpg").write_bytes(d[:2] + exif.block({0x0110: model}) + d[2:] if model else d)
    (at / "3.png").write_bytes(png.encode(photo(20, 33)))
    (at / "4.ppm").write_bytes(netpbm.encode(photo(20, 34)))
    (at / "5.jpg").write_bytes(jpeg.encode(photo(20, 35))[:300])  # a header and no image
    return at


def test_bundle_of_all_formats(spark, folder, tmp_path):
    out = str(tmp_path / "all")
    tools.import_images(spark, str(folder), out)
    images = tools.load(spark, out)
    assert sorted((r["image_index"], r["width"]) for r in images.collect()) == [(i, 30 + i) for i in range(6)]
    assert sorted(r["line"] for r in tools.dump(images).collect())[0].startswith("30x20\t(") and [r["line"][-5:] for r in tools.dump(images).orderBy("image_index").limit(3).collect()] == ["  One", "  Two", " null"]
    pixels = {r["image_index"]: r["pixels"] for r in files.decoded(images, "byte").collect()}
    assert bytes(pixels[3]) == photo(20, 33).tobytes() and bytes(pixels[4]) == photo(20, 34).tobytes() and pixels[5] is None
    assert all(psnr(np.frombuffer(pixels[i], np.uint8).reshape(20, 30 + i, 3), photo(20, 30 + i)) > 30 for i in range(3))
    floats = files.decoded(images.filter("image_index = 3"), "float").first()["pixels"]
    assert np.array(floats)[7] == pytest.approx(((photo(20, 33).ravel()[7] / 255 + 0.055) / 1.055) ** 2.4, rel=1e-4)
    assert files.decoded(images, "raw") is images
    with pytest.raises(ValueError):
        files.decoded(images, "other")
    with pytest.raises(Exception, match="no decoder"):
        files.decoded(images.withColumn("storage_format", F.lit(7))).collect()
    assert [r["Model"] for r in tools.info(images, 1, exif_key="Model").collect()] == ["Two"]
    kept = ag.cull(tools.with_exif(images), ag.model_culler("Two", 20)).collect()
    assert [r["image_index"] for r in kept] == [1]
    assert [r["image_index"] for r in tools.by_format(images).collect()] == [0, 1, 2, 5, 3, 4]
    done = tools.to_jpeg(images, str(tmp_path / "out")).collect()
    assert sorted(r["name"] for r in done) == ["0", "1", "2", "3", "4"] and all(r["written"] for r in done)
    assert psnr(jpeg.decode((tmp_path / "out" / "4.jpg").read_bytes()), photo(20, 34)) > 30
    tools.extract(images, 0, str(tmp_path / "x.png"))
    assert psnr(png.decode((tmp_path / "x.png").read_bytes()), photo(20, 30)) > 30
    with pytest.raises(ValueError):
        tools.extract(images, 5, str(tmp_path / "y.png"))
    tools.write_dump(images, str(tmp_path / "dump"))
    assert (sum(x.read_text().count("\n") for x in (tmp_path / "dump").glob("part-*"))) == 6
    both = tools.merge(spark, str(tmp_path / "twice"), out, out)
    assert sum(len(bundle.offsets(b)) for b in both) == 12


def test_bundle_reader_looks_at_headers_first(spark, folder, tmp_path):
    out = str(tmp_path / "all")
    tools.import_images(spark, str(folder), out)
    slim = tools.load(spark, out, payload="false")
    assert all(r["payload"] is None for r in slim.collect()) and [r["width"] for r in slim.filter("width > 32").orderBy("width").collect()] == [33, 34, 35]
    assert [r["image_index"] for r in tools.load(spark, out, where="image_index = 4").collect()] == [4] and not tools.load(spark, out, where="image_index = 9").collect()
    assert tools.load(spark, out, where="width > 31 and storage_format = 1").count() == 2
    with pytest.raises(Exception, match="where"):
        tools.load(spark, out, where="meta = 1").count()
    reader = bundle.BundleReader(out, {"payload": "false", "where": "width >= 34"})
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 2
    one = str(tmp_path / "one")
    tools.load(spark, out).coalesce(1).write.format("imagebundle").mode("append").save(one)
    ends = bundle.offsets(bundle.bundles(one)[0]).tolist()
    count = lambda **o: tools.load(spark, one, **o).count()
    assert count(start=str(ends[0])) == 5 and count(start=str(ends[0]), end=str(ends[2])) == 3 and count(end=str(ends[1] - 1)) == 2
    assert count(splitBytes="1") == 6 and [r["image_index"] for r in tools.load(spark, one, splitBytes="1").orderBy("image_index").collect()] == list(range(6))


def test_downloads_matrices_and_pairs(spark, tmp_path):
    data = {f"http://a/{i}.png": ("image/png", png.encode(photo(4, 4 + i))) for i in range(5)} | {"http://a/t": ("text/html", b"x")}

    def fetch(url):
        if url not in data:
            raise OSError(url)
        return data[url]

    urls = spark.createDataFrame([(u,) for u in [*data, "http://gone"]], "url string")
    assert tools.download_to(spark, urls, fetch, str(tmp_path / "d"), 2) == 5
    line = "\t".join(["7"] + ["x"] * 13 + ["http://a/2.png"] + ["x"] * 7 + ["0"])
    (tmp_path / "list-1-a").write_text(line + "\n" + line[:-1] + "1\n" + "short\tline\n")
    listed = files.photo_list(spark, str(tmp_path / "list-1-a"))
    assert listed.count() == files.images_named(str(tmp_path / "list-1-a")) == 1
    got = tools.download(listed, fetch, 1).collect()
    assert [(r["width"], r["meta"]["col_000"], r["meta"]["source"]) for r in got] == [(6, "7", "http://a/2.png")]
    m = np.arange(12, dtype=np.float32).reshape(3, 4)
    (tmp_path / "m").write_bytes(matrix.encode(m))
    (tmp_path / "bad").write_bytes(b"xy")
    rows = {r["path"].rpartition("/")[2]: r for r in files.matrices(spark, str(tmp_path / "[mb]*")).collect() if r["path"].rpartition("/")[2] in ("m", "bad")}
    assert (rows["m"]["type"], rows["m"]["rows"], rows["m"]["cols"]) == (5, 3, 4) and rows["m"]["data"] == list(range(12)) and rows["bad"]["rows"] is None
    pairs = spark.createDataFrame([(b"k", b"v"), (None, b"w")], "key binary, value binary").coalesce(1)
    assert tools.write_pairs(pairs, str(tmp_path / "p"), False) == 1 and next((tmp_path / "p").iterdir()).read_bytes() == b"kvw"
    rng = np.random.default_rng(3)
    images = spark.createDataFrame([(2, 8, 8, 1, rng.random(64).tolist()) for _ in range(5)], "color_space int, width int, height int, bands int, pixels array<double>").repartition(3)
    tools.covariance_files(images, str(tmp_path / "c"), 4, 2, 1.0)
    mean, cov = (matrix.decode((tmp_path / "c" / x).read_bytes()) for x in ("mean", "covariance"))
    gray = [np.array(r["pixels"]).reshape(8, 8) for r in images.collect()]
    w = ag.gaussian(4, 1.0).ravel()
    want = sum(((ag.patches(g, 4, 2) - mean.ravel()) * w).T @ ((ag.patches(g, 4, 2) - mean.ravel()) * w) for g in gray)
    assert cov == pytest.approx(want, abs=1e-4)
    tools.show_mean(str(tmp_path / "c" / "mean"), str(tmp_path / "mean.png"))
    shown = png.decode((tmp_path / "mean.png").read_bytes())
    assert shown.shape == (4, 4, 3) and shown.max() == 255 and shown.reshape(-1, 3).argmax(axis=0)[0] == mean.argmax()
    tools.show_components(str(tmp_path / "c" / "covariance"), str(tmp_path / "c.png"), 7, 5)
    sheet = png.decode((tmp_path / "c.png").read_bytes())
    first = ag.principal_components(cov.astype(float), 1)[1][0]
    assert sheet.shape == (8, 20, 3) and sheet[:4, :4, 0].argmax() == first.argmax() and not sheet[4:, 8:].any()
    with pytest.raises(ValueError):
        (tmp_path / "odd").write_bytes(matrix.encode(np.zeros((3, 3), np.float32)))
        tools.show_components(str(tmp_path / "odd"), str(tmp_path / "x.png"))


def test_shapes_must_agree(spark):
    df = spark.createDataFrame([(2, 3, 1, 2, [1.0] * 6, (3, 2, 1, 2)), (2, 3, 1, 2, [1.0] * 6, (2, 3, 1, 2))], "width int, height int, bands int, color_space int, p array<double>, o struct<width: int, height: int, bands: int, color_space: int>")
    shapes = px.shape(), px.shape(F.col("o"))
    assert [r[0] for r in df.select(px.equals(F.col("p"), F.col("p"), 0.0, shapes)).collect()] == [False, True]
    for f in (px.add, px.multiply):
        assert df.filter("o.width = 2").select(f(F.col("p"), F.col("p"), shapes)).count() == 1
        with pytest.raises(Exception, match="differ"):
            df.select(f(F.col("p"), F.col("p"), shapes)).collect()
    typed = df.limit(1).select(px.array_to_bytes(F.col("p"), "double").alias("b")).select(F.octet_length("b").alias("n"), px.bytes_to_array(F.col("b"), "double").alias("a")).first()
    assert typed["n"] == 48 and typed["a"] == [1.0] * 6
    with pytest.raises(Exception):
        df.select(px.bytes_to_array(F.lit(b"abc"), "int")).collect()


def test_lists_names_and_small_functions(spark, tmp_path):
    (tmp_path / "urls").write_text(" http://a/1.png \n\nhttp://a/2.jpg\n")
    assert [r["url"] for r in files.url_list(spark, str(tmp_path / "urls")).collect()] == ["http://a/1.png", "http://a/2.jpg"]
    for bad in ("/a/list", "list-x-1"):
        with pytest.raises(ValueError):
            files.images_named(bad)
    one = spark.range(1).select(
        px.from_byte(F.lit(51)).alias("f"), px.blank(F.lit(3)).alias("z"), enum_value(F.lit("PNG"), STORAGE_FORMATS).alias("e"), tx.byte_at(F.lit(b"\x01\xff"), F.lit(1)).alias("b"),
        px.linear_to_srgb(px.srgb_to_linear(F.lit(200))).alias("s"), tx.suffix(F.lit("a.b/c.JPG")).alias("x"), tx.base_name(F.lit("a.b/c.JPG")).alias("n"),
    ).first()
    assert one["f"] == pytest.approx(0.2) and one["z"] == [0, 0, 0] and one["e"] == 2 and one["b"] == 255 and abs(one["s"] - 200) <= 1 and one["x"] == "jpg" and one["n"] == "c.JPG"
    for wrong in (px.blank(F.lit(-1)), enum_value(F.lit("GIF"), STORAGE_FORMATS), px.type_size(F.lit(9))):
        with pytest.raises(Exception):
            spark.range(1).select(wrong).collect()
    odd = spark.createDataFrame([(0, 4, 3, [1.0])], "width int, height int, bands int, p array<double>")
    with pytest.raises(Exception, match="matrix"):
        odd.select(px.to_matrix(F.col("p"), 4)).collect()
    assert odd.filter(valid()).count() == 0


def test_images_in_user_functions(spark):
    """Rows to one value for each group, and a row to several, by Spark's own user functions."""
    import pandas as pd

    images = spark.createDataFrame([(i % 2, [float(i)] * 4) for i in range(6)], "storage_format int, pixels array<double>")

    @F.pandas_udf("array<double>")
    def mean_image(v: pd.Series) -> list:
        return np.mean(np.stack(v.to_list()), axis=0).tolist()

    assert sorted((r["storage_format"], r["m"]) for r in images.groupBy("storage_format").agg(mean_image("pixels").alias("m")).collect()) == [(0, [2.0] * 4), (1, [3.0] * 4)]

    @F.udtf(returnType="pos: int, v: double")
    class Pixels:
        def eval(self, pixels):
            yield from enumerate(pixels)

    spark.udtf.register("pixels_of_row", Pixels)
    images.createOrReplaceTempView("images_of_rows")
    assert spark.sql("SELECT count(*) AS n, sum(v) AS s FROM images_of_rows, LATERAL pixels_of_row(pixels)").first() == (24, 60.0)


def test_every_query_runs_and_agrees_with_its_sql(spark, sf_dir):
    import duckdb

    from lumenframe.plans import catalog

    con = duckdb.connect()
    for t in ("orders", "lineitem", "events", "documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, query in catalog.QUERIES.items():
        rows = query(spark, sf_dir)
        if sql := catalog.ORACLE_SQL.get(name):
            want = con.execute(sql)
            columns = [c[0] for c in want.description]
            assert sorted(columns) == sorted(rows.columns), name
            assert sorted(map(repr, map(tuple, rows.select(*columns).collect()))) == sorted(map(repr, want.fetchall())), name
        else:
            assert rows.count() > 0


def test_decoding_holds_one_piece_and_no_pandas(monkeypatch):
    data = [png.encode(photo(8, 8 + i)) for i in range(6)]
    batch = [(pa.array([*data, b"x", None], pa.binary()), pa.array([2] * 8))]
    monkeypatch.setattr(payloads, "PIECE", 2 * 8 * 8 * 3)
    for f, size in ((files.decode_bytes, 1), (files.decode, 4)):
        pieces = list(f.func(iter(batch)))
        assert [len(p) for p in pieces] == ([2, 2, 2, 2] if size == 1 else [1] * 6 + [2])
        sizes = [x and len(x) for p in pieces for x in p.to_pylist()]
        assert sizes == [8 * (8 + i) * 3 for i in range(6)] + [None, None]
    tracemalloc.start()
    jpeg.decode(jpeg.encode(photo(8, 8)))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 4e6  # four tables of 65,536 places
    code = "import sys; from lumenframe.codecs import payloads as p; import numpy as np; p.binary([b'a', None]); p.binary([]); p.floats([np.ones(2, np.float32), None]); p.texts([{'a': 'b'}, {}]); assert 'pandas' not in sys.modules"
    subprocess.run([sys.executable, "-c", code], check=True)


def test_columns_from_buffers():
    for made in (payloads.binary([b"ab", None, b""]), payloads.binary([]), payloads.floats([np.ones(2, np.float32), None, np.zeros(0, np.float32)]), payloads.floats([]), payloads.texts([{"a": "ü", "b": ""}, {}]), payloads.texts([])):
        made.validate(full=True)
    assert payloads.binary([b"ab", None, b""]).to_pylist() == [b"ab", None, b""]
    assert payloads.floats([np.ones(2, np.float32), None]).to_pylist() == [[1.0, 1.0], None]
    assert payloads.texts([{"a": "ü", "b": ""}, {}]).to_pylist() == [[("a", "ü"), ("b", "")], []]
    lists = pa.array([[9.0], [1.0, 2.0], [], [3.0]], pa.list_(pa.float64())).slice(1)
    assert payloads.numbers(lists.values, np.float64).tolist() == [9, 1, 2, 3] and payloads.numbers(lists.offsets, np.int32).tolist() == [1, 3, 3, 4]
    assert np.isnan(payloads.numbers(pa.array([1.0, None]), np.float64)).tolist() == [False, True] and not len(payloads.numbers(pa.array([], pa.int32()), np.int32))


@pytest.mark.parametrize("name", ["decode_jpeg", "decode_linear", "decode_lossless", "cull_model", "dump_models"])
def test_a_task_has_two_python_workers(spark, sf_dir, name):
    plan = catalog.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EvalPython") == 2
