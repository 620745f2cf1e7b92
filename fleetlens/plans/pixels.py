"""Per-pixel jobs. The pictures are the bytes of every document, sixteen gray pixels wide, in the form in
which the image source delivers decoded files."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.operators import images as I
from fleetlens.plans.registry import query, relation

WIDTH = 16


def pictures(t) -> DataFrame:
    """Every thirteenth document is a file that could not be decoded."""
    data = F.encode("text", "UTF-8")
    height = F.ceil(F.octet_length(data) / WIDTH).cast("int")
    padded = F.rpad(data, height * WIDTH, F.unhex(F.lit("00")))
    broken = F.col("doc_id") % 13 == 0
    origin = F.concat(F.lit("file:/photos/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("_0.jpg"))
    bad = F.lit(-1)
    return t.documents.select(
        F.struct(
            origin.alias("origin"), F.when(broken, bad).otherwise(height).alias("height"),
            F.when(broken, bad).otherwise(WIDTH).alias("width"), F.when(broken, bad).otherwise(1).alias("nChannels"),
            F.when(broken, bad).otherwise(0).alias("mode"), F.when(broken, F.unhex(F.lit(""))).otherwise(padded).alias("data"),
        ).alias("image"),
        F.octet_length(data).cast("long").alias("file_size"),
    )


# The same metrics from one row per byte; a gray picture has no saturation.
relation("r_bytes", """
SELECT doc_id, source, len, h, CAST(i // 16 AS INT) AS r, CAST(i % 16 AS INT) AS c,
  CASE WHEN i < len THEN CAST(concat('0x', substr(digits, CAST(2 * i + 1 AS BIGINT), 2)) AS INT) ELSE 0 END AS v
FROM (SELECT doc_id, source, digits, len, h, unnest(range(h * 16)) AS i FROM (
  SELECT doc_id, source, hex(encode(text)) AS digits, strlen(text) AS len, CAST(ceil(strlen(text) / 16) AS BIGINT) AS h FROM documents WHERE doc_id % 13 <> 0) s) u""")
relation("r_laplace", """
SELECT *, coalesce(up, down, v) + coalesce(down, up, v) + coalesce(CASE WHEN c > 0 THEN prior END, next) + coalesce(CASE WHEN c < 15 THEN next END, prior) - 4 * v AS lap
FROM (SELECT *, lag(v, 16) OVER w AS up, lead(v, 16) OVER w AS down, lag(v) OVER w AS prior, lead(v) OVER w AS next
  FROM r_bytes WINDOW w AS (PARTITION BY doc_id ORDER BY r, c)) s""")


@query("i01_image_metrics", """
SELECT concat('file:/photos/', source, '/', doc_id, '_0.jpg') AS path, any_value(len) AS file_size, 16 AS width, any_value(h) AS height,
  CAST(printf('%.3f', 16 / any_value(h)) AS DOUBLE) AS aspect_ratio, CAST(printf('%.1f', var_pop(lap)) AS DOUBLE) AS sharpness,
  CAST(printf('%.1f', sum(v) / count(*)) AS DOUBLE) AS brightness, CAST(printf('%.1f', stddev_pop(v)) AS DOUBLE) AS contrast, 0 AS saturation,
  CAST(printf('%.2f', count_if(v > 240) / count(*) * 100) AS DOUBLE) AS overexp_pct, CAST(printf('%.2f', count_if(v < 15) / count(*) * 100) AS DOUBLE) AS underexp_pct,
  source AS plate, concat(doc_id, '_0.jpg') AS filename, 'exterior_legacy' AS view
FROM r_laplace GROUP BY doc_id, source""")
def _(t):
    return I.with_names(I.split_errors(I.image_metrics(pictures(t)))[0]).drop("phash", "error")


# The hash from sums over pixels: area weights of each height, cosines, and bits above the median.
relation("r_cosines", """
SELECT CAST(k AS INT) AS k, CAST(i AS INT) AS i, cos(pi() * k * (2 * i + 1) / 128) AS x FROM range(16) a(k), range(64) b(i)""")
relation("r_heights", "SELECT DISTINCT h FROM r_bytes UNION SELECT 16")
relation("r_resize", """
SELECT h, k, r, sum(x * part) * 64 / h AS x FROM (
  SELECT h, CAST(r AS INT) AS r, i, least((i + 1) * CAST(h AS DOUBLE) / 64, r + 1) - greatest(i * CAST(h AS DOUBLE) / 64, r) AS part
  FROM (SELECT h, i, unnest(range(CAST(floor(i * h / 64) AS BIGINT), least(CAST(ceil((i + 1) * h / 64) AS BIGINT), h))) AS r FROM r_heights, range(64) t(i)) s) o
JOIN r_cosines USING (i) WHERE part > 1e-12 GROUP BY h, k, r""")
relation("r_rows", "SELECT doc_id, source, b.h, b.r, w.k AS l, sum(v * x) AS x FROM r_bytes b JOIN (SELECT k, r AS c, x FROM r_resize WHERE h = 16) w ON b.c = w.c GROUP BY ALL")
relation("r_low", "SELECT doc_id, source, w.k, l, round(sum(g.x * w.x), 6) AS x FROM r_rows g JOIN r_resize w ON g.h = w.h AND g.r = w.r GROUP BY ALL")


@query("i02_perceptual_hash", """
SELECT concat('file:/photos/', source, '/', doc_id, '_0.jpg') AS path, string_agg(digit, '' ORDER BY place) AS phash FROM (
  SELECT doc_id, source, (k * 16 + l) // 4 AS place, substr('0123456789abcdef', CAST(1 + sum(CASE WHEN x > mid THEN 1 << CAST(3 - l % 4 AS INT) ELSE 0 END) AS INT), 1) AS digit
  FROM (SELECT *, median(x) OVER (PARTITION BY doc_id) AS mid FROM r_low) b GROUP BY ALL) d
GROUP BY doc_id, source""")
def _(t):
    return I.split_errors(I.image_metrics(pictures(t)))[0].select("path", "phash")


@query("i03_decode_errors", """
SELECT count(*) AS n_images, count_if(doc_id % 13 <> 0) AS n_ok, count_if(doc_id % 13 = 0) AS n_errors FROM documents""")
def _(t):
    return I.error_counts(I.decode_errors(pictures(t)))


@query("i04_dimensions", """
SELECT concat('file:/photos/', source, '/', doc_id, '_0.jpg') AS path, CASE WHEN doc_id % 13 = 0 THEN 0 ELSE 16 END AS width,
  CASE WHEN doc_id % 13 = 0 THEN 0 ELSE CAST(ceil(strlen(text) / 16) AS INT) END AS height FROM documents""")
def _(t):
    return I.dimensions(pictures(t))
