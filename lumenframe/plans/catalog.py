"""Registered queries and their SQL twins, each over whole tables."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import pixels as px
from ..functions import text as tx
from ..operators import aggregates as ag
from ..operators import ordering as od
from ..schema import RAW, STORAGE_FORMATS, enum_name
from ..sources import bundle, files
from ..storage import shared_dir
from .views import BYTES_SQL, HEADERS_SQL, LONG_SQL, encoded, headers, pixels, rasters, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _r(x: Column, name: str, places: int = 4) -> Column:
    """Rounded; 0.0 is added so that -0.0 becomes 0.0."""
    return (F.round(x, places) + 0.0).alias(name)


_AVG = "SELECT round(avg(r), 4) + 0.0 AS avg_r, round(avg(g), 4) + 0.0 AS avg_g, round(avg(b), 4) + 0.0 AS avg_b, count(*) AS images FROM (SELECT avg(l_quantity / 50) AS r, avg(l_discount) AS g, avg(l_tax) AS b FROM {} GROUP BY l_orderkey)"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(_r(F.col(f"avg_{c}"), f"avg_{c}") for c in "rgb"), "images")


@_query(_AVG.format("lineitem"))
def avg_pixel_color(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(ag.average_color(pixels(spark, sf)))


@_query(_AVG.format("lineitem JOIN orders ON l_orderkey = o_orderkey WHERE NOT (o_totalprice > 300000)"))
def avg_pixel_color_culled(spark: SparkSession, sf: str) -> DataFrame:
    kept = ag.cull(table(spark, sf, "orders"), F.col("o_totalprice") > 300000).select(F.col("o_orderkey").alias("image_index"))
    return _rounded(ag.average_color(pixels(spark, sf).join(kept, "image_index", "left_semi")))


@_query(f"WITH {HEADERS_SQL} SELECT image_index, width, height FROM h WHERE NOT (source = '1-URGENT' OR width > 3200)")
def cull_width_source(spark: SparkSession, sf: str) -> DataFrame:
    return ag.cull(headers(spark, sf), (F.col("meta")["source"] == "1-URGENT") | (F.col("width") > 3200)).select("image_index", "width", "height")


@_query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE NOT coalesce(CAST(json_extract_string(props, '$.k') AS INTEGER) > 50, false)")
def cull_meta_json(spark: SparkSession, sf: str) -> DataFrame:
    meta = F.from_json("props", "map<string,string>")
    return ag.cull(table(spark, sf, "events").select("event_id", meta["k"].cast("int").alias("k")), F.col("k") > 50)


@_query(f"WITH {HEADERS_SQL} SELECT image_index, storage_format, color_space, width, height, bands FROM h")
def header_projection(spark: SparkSession, sf: str) -> DataFrame:
    return headers(spark, sf).drop("meta")


@_query(f"WITH {HEADERS_SQL} SELECT image_index, printf('%dx%d', width, height) || chr(9) || '(' || source || ')' || chr(9) || '  null' AS line FROM h")
def dump_lines(spark: SparkSession, sf: str) -> DataFrame:
    return headers(spark, sf).select("image_index", tx.dump_line(F.col("meta")["source"], F.lit(None).cast("string")).alias("line"))


@_query(f"""WITH {HEADERS_SQL} SELECT image_index, printf('ImageHeader: (%s RGB) %d x %d x %d meta: ', CASE storage_format WHEN 1 THEN 'JPEG' WHEN 2 THEN 'PNG' ELSE 'PPM' END,
 width, height, bands) || '{{"source":"' || source || '"}}' AS line FROM h""")
def header_strings(spark: SparkSession, sf: str) -> DataFrame:
    return headers(spark, sf).select("image_index", tx.header_string().alias("line"))


@_query("SELECT count(*) AS images FROM orders")
def image_count(spark: SparkSession, sf: str) -> DataFrame:
    return headers(spark, sf).agg(F.count("*").alias("images"))


@_query(f"WITH {HEADERS_SQL} SELECT CASE storage_format WHEN 1 THEN 'JPEG' WHEN 2 THEN 'PNG' ELSE 'PPM' END AS format, count(*) AS images, sum(CAST(width AS BIGINT) * height)::BIGINT AS area FROM h GROUP BY 1")
def group_by_format(spark: SparkSession, sf: str) -> DataFrame:
    named = headers(spark, sf).withColumn("format", enum_name(F.col("storage_format"), STORAGE_FORMATS))
    return named.groupBy("format").agg(F.count("*").alias("images"), F.sum(F.col("width").cast("long") * F.col("height")).alias("area"))


def _long(df: DataFrame, values: Column) -> DataFrame:
    return df.select("image_index", F.posexplode(values).alias("pos", "v")).select("image_index", "pos", _r(F.col("v"), "v"))


def _long_sql(value: str) -> str:
    return f"WITH {LONG_SQL} SELECT image_index, pos, round({value}, 4) + 0.0 AS v FROM e"


@_query(f"WITH {LONG_SQL} SELECT pos, round(sum(v), 4) + 0.0 AS v FROM e GROUP BY pos")
def image_sum(spark: SparkSession, sf: str) -> DataFrame:
    return rasters(spark, sf).select(F.posexplode("pixels").alias("pos", "v")).groupBy("pos").agg(_r(F.sum("v"), "v"))


@_query(_long_sql("v + (v * 0.5 + 0.25)"))
def image_add(spark: SparkSession, sf: str) -> DataFrame:
    return _long(rasters(spark, sf), px.add(F.col("pixels"), px.add_scalar(px.scale(F.col("pixels"), 0.5), 0.25), (px.shape(), px.shape())))


@_query(_long_sql("v * (v * 0.5)"))
def image_multiply(spark: SparkSession, sf: str) -> DataFrame:
    return _long(rasters(spark, sf), px.multiply(F.col("pixels"), px.scale(F.col("pixels"), 0.5), (px.shape(), px.shape())))


@_query(_long_sql("v * 1.5"))
def image_scale(spark: SparkSession, sf: str) -> DataFrame:
    return _long(rasters(spark, sf), px.scale(F.col("pixels"), 1.5))


@_query(f"""WITH {LONG_SQL} SELECT image_index, CAST((pos // 8 - 1) * 4 + pos % 8 - 2 AS INTEGER) AS pos, round(v, 4) + 0.0 AS v FROM e
 WHERE pos // 8 BETWEEN 1 AND 5 AND pos % 8 BETWEEN 2 AND 5""")
def crop(spark: SparkSession, sf: str) -> DataFrame:
    return _long(rasters(spark, sf), px.crop(F.col("pixels"), F.col("width"), F.col("height"), F.col("bands"), 2, 1, 4, 5))


@_query("SELECT l_orderkey AS image_index, l_linenumber AS pos, round(0.30 * (l_quantity / 50) + 0.59 * l_discount + 0.11 * l_tax, 6) + 0.0 AS lum, round(l_quantity / 50, 4) + 0.0 AS compat, round(0.299 * (l_quantity / 50) + 0.587 * l_discount + 0.114 * l_tax, 6) + 0.0 AS gray FROM lineitem")
def rgb_to_lum(spark: SparkSession, sf: str) -> DataFrame:
    rgb = [F.col(c) for c in "rgb"]
    return pixels(spark, sf).select("image_index", "pos", _r(px.luminance(*rgb), "lum", 6), _r(px.luminance(*rgb, compat=True), "compat"), _r(px.gray(*rgb), "gray", 6))


@_query("""SELECT l_orderkey AS image_index, l_linenumber AS pos, CAST(floor(greatest(0, least(255, l_quantity / 50 * 255))) AS INTEGER) AS byte,
 round(CASE WHEN l_quantity / 255.0 <= 0.04045 THEN l_quantity / 255.0 / 12.92 ELSE pow((l_quantity / 255.0 + 0.055) / 1.055, 2.4) END, 4) + 0.0 AS linear,
 round(greatest(0, least(255, l_extendedprice / 255.0)), 4) + 0.0 AS clamped FROM lineitem""")
def pixel_conversions(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem")
    q = F.col("l_quantity")
    return line.select(F.col("l_orderkey").alias("image_index"), F.col("l_linenumber").alias("pos"), px.to_byte(q / 50).alias("byte"),
        _r(px.srgb_to_linear(q), "linear"), _r(px.clamp(F.col("l_extendedprice") / 255.0, 0.0, 255.0), "clamped"))


@_query("""WITH x AS (SELECT l_orderkey AS image_index, l_linenumber AS pos, (CAST(floor(greatest(0, least(2047, l_discount * 2047 - 0.5))) AS INTEGER) + 0.5) / 2047.0 AS l FROM lineitem)
SELECT image_index, pos, CAST(floor(greatest(0, least(255, 255 * CAST(CASE WHEN l <= 0.0031308 THEN l * 12.92 ELSE 1.055 * pow(l, 1 / 2.4) - 0.055 END AS DOUBLE)))) AS INTEGER) AS srgb FROM x""")
def srgb_compress(spark: SparkSession, sf: str) -> DataFrame:
    return pixels(spark, sf).select("image_index", "pos", px.linear_to_srgb(F.col("g")).alias("srgb"))


@_query(f"WITH {LONG_SQL} SELECT image_index, max(abs(v - v * 1.01)) <= 0.003 AS same, round(10 * log10(1.0 / avg((v - v * 1.01) * (v - v * 1.01))), 4) + 0.0 AS psnr FROM e GROUP BY 1")
def equals_and_psnr(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("pixels")
    other = px.scale(p, 1.01)
    return rasters(spark, sf).select("image_index", px.equals(p, other, 0.003, (px.shape(), px.shape())).alias("same"), _r(px.psnr(p, other, 1.0), "psnr"))


@_query(f"WITH {LONG_SQL} SELECT CAST(pos AS BIGINT) AS pos, round(avg(v), 4) + 0.0 AS v FROM e GROUP BY pos")
def mean_patch(spark: SparkSession, sf: str) -> DataFrame:
    return ag.mean_patch(rasters(spark, sf), 8, 1).select("pos", _r(F.col("v"), "v"))


def _mean(spark: SparkSession, sf: str) -> np.ndarray:
    """64 numbers, however many images."""
    return np.array([r["v"] for r in ag.mean_patch(rasters(spark, sf), 8, 1).orderBy("pos").collect()])


@_query(f"""WITH {LONG_SQL}, m AS (SELECT pos, avg(v) AS m FROM e GROUP BY pos), c AS (SELECT image_index, pos, v - m AS v FROM e JOIN m USING (pos))
SELECT a.pos AS i, b.pos AS j, round(sum(a.v * b.v), 4) + 0.0 AS v FROM c a JOIN c b USING (image_index) GROUP BY 1, 2""")
def covariance(spark: SparkSession, sf: str) -> DataFrame:
    found = ag.covariance(rasters(spark, sf), _mean(spark, sf), 8, 1, None)
    return found.select("i", "j", _r(F.col("v"), "v"))


_PATCHES = f"""WITH {LONG_SQL}, p AS (SELECT image_index, CAST(i * 3 + j AS INTEGER) AS patch, CAST((pos // 8 - 4 * j // 3) * 4 + pos % 8 - 4 * i // 3 AS INTEGER) AS cell, v
  FROM e, range(3) a(i), range(3) b(j) WHERE pos // 8 - 4 * j // 3 BETWEEN 0 AND 3 AND pos % 8 - 4 * i // 3 BETWEEN 0 AND 3),
m AS (SELECT cell, avg(v) AS m FROM p GROUP BY cell),
u AS (SELECT cell, exp(-((cell // 4 - 2) * (cell // 4 - 2) + (cell % 4 - 2) * (cell % 4 - 2)) / 8.0) AS u FROM m), w AS (SELECT cell, u / (SELECT sqrt(sum(u * u)) FROM u) AS w FROM u),
c AS (SELECT image_index, patch, cell, (v - m) * w AS v FROM p JOIN m USING (cell) JOIN w USING (cell))
SELECT a.cell AS i, b.cell AS j, round(sum(a.v * b.v), 3) + 0.0 AS v FROM c a JOIN c b USING (image_index, patch) GROUP BY 1, 2"""


@_query(_PATCHES)
def covariance_weighted(spark: SparkSession, sf: str) -> DataFrame:
    """A grid of 3 x 3 patches of 4 x 4 pixels an image, under Gaussian weights."""
    mean = np.array([r["v"] for r in ag.mean_patch(rasters(spark, sf), 4, 3).orderBy("pos").collect()])
    found = ag.covariance(rasters(spark, sf), mean, 4, 3, 2.0)
    return found.select("i", "j", _r(F.col("v"), "v", 3))


@_query()
def principal_components(spark: SparkSession, sf: str) -> DataFrame:
    matrix = np.zeros((64, 64))
    for r in ag.covariance_rows(rasters(spark, sf), _mean(spark, sf), 8, 1, ag.SIGMA).collect():  # 64 rows, however many images
        matrix[r["i"]] = np.frombuffer(r["row"], np.float64)
    values, vectors = ag.principal_components(matrix, 15)
    return spark.createDataFrame([(k, float(v), w.tolist()) for k, (v, w) in enumerate(zip(values, vectors))], "component int, value double, vector array<double>")


@_query("""WITH g AS (SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, exp(-((i - 32) * (i - 32) + (j - 32) * (j - 32)) / 200.0) AS w FROM range(64) a(i), range(64) b(j))
SELECT i, j, round(w / (SELECT sqrt(sum(w * w)) FROM g), 6) + 0.0 AS w FROM g""")
def gaussian_weights(spark: SparkSession, sf: str) -> DataFrame:
    i, j = F.floor(F.col("id") / 64), F.col("id") % 64
    w = F.exp(-((i - 32) * (i - 32) + (j - 32) * (j - 32)) / 200.0)
    g = spark.range(64 * 64).select(i.alias("i"), j.alias("j"), w.alias("w"))
    norm = g.agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return g.crossJoin(F.broadcast(norm)).select("i", "j", (F.round(F.col("w") / F.col("norm"), 6) + 0.0).alias("w"))


@_query(f"""WITH {HEADERS_SQL} SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, count(*) AS images, sum((width - 64) * i // 10)::BIGINT AS x, sum((height - 64) * j // 10)::BIGINT AS y
FROM h, range(10) a(i), range(10) b(j) WHERE width >= 64 AND height >= 64 GROUP BY 1, 2""")
def patch_grid(spark: SparkSession, sf: str) -> DataFrame:
    big = headers(spark, sf).filter("width >= 64 and height >= 64").groupBy("width", "height").agg(F.count("*").alias("n"))  # 100 cells a size, not an image
    grid = big.select("*", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("j"))
    at = lambda size, k: F.floor((F.col(size) - 64) * F.col(k) / 10) * F.col("n")
    return grid.groupBy("i", "j").agg(F.sum("n").alias("images"), F.sum(at("width", "i")).alias("x"), F.sum(at("height", "j")).alias("y"))


@_query("SELECT doc_id, sha1(text) AS digest, array_to_string(list_transform(range(1, 40, 2), lambda i: regexp_replace(substr(sha1(text), i, 2), '^0', '')), '') AS compat FROM documents")
def image_digest(spark: SparkSession, sf: str) -> DataFrame:
    data = F.col("text").cast("binary")
    return table(spark, sf, "documents").select("doc_id", tx.digest(data).alias("digest"), tx.digest(data, compat=True).alias("compat"))


@_query("SELECT doc_id, trim(regexp_replace(substr(hex(encode(text)), 1, 20), '(..)', '0x\\1 ', 'g')) AS bytes, printf('%08X', doc_id) AS id_hex FROM documents")
def byte_dump(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.byte_dump(F.col("text").cast("binary"), 10).alias("bytes"), F.hex(tx.int_to_bytes(F.col("doc_id"))).alias("id_hex"))


@_query("SELECT page_id, url, row_number() OVER (ORDER BY url, page_id) - 1 AS image_index FROM pages")
def order_import(spark: SparkSession, sf: str) -> DataFrame:
    return od.indexed(table(spark, sf, "pages").select("page_id", "url"), ["url", "page_id"])


@_query("SELECT page_id, url, image_index FROM (SELECT page_id, url, row_number() OVER (ORDER BY url, page_id) - 1 AS image_index FROM pages) WHERE image_index = 7")
def ordinal_lookup(spark: SparkSession, sf: str) -> DataFrame:
    first = table(spark, sf, "pages").select("page_id", "url").orderBy("url", "page_id").limit(8)  # partial top-k, then 8 rows
    return first.withColumn("image_index", F.row_number().over(Window.orderBy("url", "page_id")).cast("long") - 1).filter("image_index = 7")


@_query("SELECT page_id, sum(12 + 24 + 2 + octet_length(encode(html))) OVER (ORDER BY page_id)::BIGINT AS end_offset FROM pages")
def end_offsets(spark: SparkSession, sf: str) -> DataFrame:
    sizes = table(spark, sf, "pages").select("page_id", (F.octet_length("html") + 38).cast("long").alias("size"))
    return od.running(sizes, ["page_id"], end_offset="size").drop("size")


@_query("SELECT page_id, CAST(ntile(7) OVER (ORDER BY page_id) AS INTEGER) AS split, CAST(least((row_number() OVER (ORDER BY page_id) - 1) // (((SELECT count(*) FROM pages) + 9) // 10), 9) AS INTEGER) AS node FROM pages")
def split_and_schedule(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id")
    n = pages.count()
    placed = od.indexed(pages, ["page_id"])
    return od.schedule(od.splits(placed, "image_index", 7, n), "image_index", 10, n).drop("image_index")


@_query(f"WITH {HEADERS_SQL} SELECT 0 AS bundle, image_index, width, height FROM h UNION ALL SELECT 1, vec_id, 8, 8 FROM embeddings")
def append_union(spark: SparkSession, sf: str) -> DataFrame:
    one = headers(spark, sf).select(F.lit(0).alias("bundle"), "image_index", "width", "height")
    return one.unionByName(rasters(spark, sf).select(F.lit(1).alias("bundle"), "image_index", "width", "height"))


@_query(r"SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS base, lower(regexp_extract(regexp_extract(url, '([^/]*)$', 1), '\.([^.]*)$', 1)) AS suffix FROM pages")
def basename_suffix(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", tx.base_name(F.col("url")).alias("base"), tx.suffix(F.col("url")).alias("suffix"))


@_query("""SELECT doc_id, '{"lang":"' || lang || '","source":"' || source || '","kind":"text"}' AS meta, lang AS found FROM documents""")
def metadata_json(spark: SparkSession, sf: str) -> DataFrame:
    meta = F.map_concat(F.create_map(F.lit("lang"), "lang", F.lit("source"), "source"), F.create_map(F.lit("kind"), F.lit("text")))
    return table(spark, sf, "documents").select("doc_id", meta.alias("m")).select("doc_id", F.to_json("m").alias("meta"), F.col("m")["lang"].alias("found"))


@_query("SELECT source, sum(length(text) - length(replace(text, chr(10), '')) + 1)::BIGINT AS lines, count(*) AS files FROM documents GROUP BY source")
def lines_by_source(spark: SparkSession, sf: str) -> DataFrame:
    lines = F.length("text") - F.length(F.regexp_replace("text", "\n", "")) + 1
    return table(spark, sf, "documents").groupBy("source").agg(F.sum(lines).alias("lines"), F.count("*").alias("files"))


@_query("""SELECT CAST(t AS INTEGER) AS t, CAST(b AS INTEGER) AS b, CAST(CASE WHEN b BETWEEN 1 AND 4 THEN [0, 2, 3, 4, 5, 6][t + 1] + 8 * (b - 1) ELSE -1 END AS INTEGER) AS code,
 CAST([1, 2, 2, 4, 4, 8][t + 1] AS INTEGER) AS size FROM range(6) a(t), range(6) c(b)""")
def matrix_types(spark: SparkSession, sf: str) -> DataFrame:
    t, b = F.floor(F.col("id") / 6).cast("int"), (F.col("id") % 6).cast("int")
    return spark.range(36).select(t.alias("t"), b.alias("b")).select("t", "b", px.matrix_type(F.col("t"), F.col("b")).alias("code"), px.type_size(F.col("t")).alias("size"))


@_query(f"WITH {BYTES_SQL} SELECT image_index, pos, v FROM p WHERE format IN (2, 3)")
def decode_lossless(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels of PNG and PPM payloads, encoded from embeddings and decoded again."""
    images = files.decoded(encoded(spark, sf).filter("storage_format in (2, 3)"), "byte")
    at = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("pos")
    return images.select("image_index", "pixels", at).select("image_index", "pos", tx.byte_at(F.col("pixels"), F.col("pos") * 3).alias("v"))


@_query(f"WITH {BYTES_SQL} SELECT image_index, 8 AS width, 8 AS height, true AS close FROM p WHERE format = 1 GROUP BY 1")
def decode_jpeg(spark: SparkSession, sf: str) -> DataFrame:
    """Whether decoded JPEG payloads are within 30 dB of what was encoded."""
    images = encoded(spark, sf).filter("storage_format = 1").withColumn("wide", F.transform(F.sequence(F.lit(0), F.lit(191)), lambda i: tx.byte_at(F.col("truth"), i).cast("double")))
    images = files.decoded(images, "byte").withColumn("read", F.transform(F.sequence(F.lit(0), F.lit(191)), lambda i: tx.byte_at(F.col("pixels"), i).cast("double")))
    return images.select("image_index", "width", "height", (F.coalesce(px.psnr(F.col("wide"), F.col("read")), F.lit(99.0)) >= 30).alias("close"))


@_query(f"""WITH {BYTES_SQL}, l AS (SELECT CASE WHEN v / 255.0 <= 0.04045 THEN v / 255.0 / 12.92 ELSE pow((v / 255.0 + 0.055) / 1.055, 2.4) END AS l, image_index FROM p WHERE format = 2)
SELECT image_index, round(avg(l), 4) + 0.0 AS mean FROM l GROUP BY 1""")
def decode_linear(spark: SparkSession, sf: str) -> DataFrame:
    images = files.decoded(encoded(spark, sf).filter("storage_format = 2"), "float")
    mean = F.aggregate(F.col("pixels").cast("array<double>"), F.lit(0.0), lambda s, x: s + x) / F.size("pixels")
    return images.select("image_index", _r(mean, "mean"))


def stored(spark: SparkSession, sf: str) -> str:
    """A bundle of the encoded images, in the order of their ids, in the shared folder, which must be a mounted one."""
    bundle.register(spark)
    rows = encoded(spark, sf).repartitionByRange(8, "image_index").sortWithinPartitions("image_index").select(*RAW.fieldNames())
    out = f"{shared_dir(spark).removeprefix('file://')}/lumenframe/bundle-{uuid.uuid4().hex}"
    rows.write.format("imagebundle").mode("append").save(out)
    return out


@_query("SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS BIGINT) AS image_index, CAST(1 + label % 3 AS INTEGER) AS storage_format, CAST(vec_id AS VARCHAR) AS source FROM embeddings QUALIFY storage_format = 2")
def bundle_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Headers of one format from a bundle; the reader passes over the other images and all payloads."""
    rows = spark.read.format("imagebundle").option("payload", "false").option("where", "storage_format = 2").load(stored(spark, sf))
    return rows.select("image_index", "storage_format", F.col("meta")["source"].alias("source"))


@_query(f"WITH {BYTES_SQL}, q AS (SELECT dense_rank() OVER (ORDER BY image_index) - 1 AS k, pos, v FROM p) SELECT CAST(k AS BIGINT) AS image_index, CAST(sum(v) AS BIGINT) AS total FROM q WHERE k = 5 GROUP BY 1")
def bundle_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The sixth image of a bundle by its place; it is a PNG or PPM, or its JPEG's pixels are those of the table within rounding."""
    rows = spark.read.format("imagebundle").option("where", "image_index = 5").load(stored(spark, sf))
    cells = files.decoded(rows, "byte").select("image_index", "pixels", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("pos"))
    return cells.groupBy("image_index").agg(F.sum(tx.byte_at(F.col("pixels"), F.col("pos") * 3)).alias("total"))


@_query("""SELECT vec_id AS image_index, '8x8' || chr(9) || '(' || vec_id || ')' || chr(9) || '  ' || CASE WHEN label % 3 = 0 THEN 'Camera ' || label ELSE 'null' END AS line FROM embeddings""")
def dump_models(spark: SparkSession, sf: str) -> DataFrame:
    """Dump lines with the camera's model, read from the payloads' EXIF tags."""
    rows = encoded(spark, sf).withColumn("exif", files.exif("payload", "storage_format"))
    return rows.select("image_index", tx.dump_line(F.col("meta")["source"], F.col("exif")["Model"]).alias("line"))


@_query("SELECT vec_id AS image_index, label FROM embeddings WHERE label % 3 = 0 AND label >= 6")
def cull_model(spark: SparkSession, sf: str) -> DataFrame:
    """Images kept by an EXIF-aware cull: those whose model is a camera of number 6 or more."""
    rows = encoded(spark, sf).withColumn("exif", files.exif("payload", "storage_format"))
    number = F.regexp_extract(F.coalesce(F.col("exif")["Model"], F.lit("")), "Camera (\\d+)", 1)
    return ag.cull(rows, (number == "") | (number.try_cast("int") < 6)).select("image_index", "label")


@_query("SELECT vec_id AS image_index, 5 AS type, 8 AS rows, 8 AS cols, CAST(unnest(range(64)) AS INTEGER) AS pos, round(CAST(unnest(embedding) AS DOUBLE), 4) + 0.0 AS v FROM embeddings")
def image_to_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Images as matrices of floats, by way of their bytes."""
    data = px.bytes_to_array(px.array_to_bytes(F.col("pixels"), "float"), "float")
    rows = rasters(spark, sf).select("image_index", px.to_matrix(data, 4).alias("m"))
    return rows.select("image_index", "m.type", "m.rows", "m.cols", F.posexplode("m.data").alias("pos", "v")).withColumn("v", _r(F.col("v").cast("double"), "v"))


@_query(f"WITH {HEADERS_SQL} SELECT storage_format, image_index, row_number() OVER (ORDER BY storage_format, image_index) - 1 AS place FROM h")
def order_by_format(spark: SparkSession, sf: str) -> DataFrame:
    return od.indexed(headers(spark, sf).select("storage_format", "image_index"), ["storage_format", "image_index"], "place")


@_query("SELECT doc_id, printf('RawImage: %d x 1 x 3 [', n_chars) || trim(regexp_replace(substr(hex(encode(text)), 1, 20), '(..)', '0x\\1 ', 'g')) || ']' AS line FROM documents")
def raw_strings(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", "text", F.col("n_chars").alias("width"), F.lit(1).alias("height"), F.lit(3).alias("bands"))
    return rows.select("doc_id", tx.raw_string(F.col("text").cast("binary")).alias("line"))
