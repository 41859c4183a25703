"""Queries of the operators on pixels. An embedding is an 8 x 8 gray image; three in a row are a colour image's channels, nine a frame of 24 x 24. Lines of an order are regions of the image of its number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pixels, portrait
from .registry import query, read


def _images(spark: SparkSession, sf: str) -> DataFrame:
    gray = F.transform("embedding", lambda c: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + 256 * c.cast("double")))).cast("long"))
    return read(spark, sf, "embeddings").select("vec_id", gray.alias("pixels"), F.lit(8).alias("width"))


_IMAGES = "i AS (SELECT vec_id, list_transform(embedding, lambda c: cast(greatest(0, least(255, floor(128 + 256 * cast(c AS DOUBLE)))) AS BIGINT)) AS p FROM embeddings)"


def _regions(spark: SparkSession, sf: str) -> DataFrame:
    part = {"x": "l_discount * 8", "y": "l_tax * 10", "w": "l_quantity / 100", "h": "0.5D"}
    return read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("vec_id"), "l_linenumber", F.struct(*(F.expr(e).cast("double").alias(n) for n, e in part.items())).alias("box"))


@query(f"""WITH {_IMAGES}, px AS (SELECT vec_id, k % 8 AS x, k // 8 AS y, p[k + 1] AS v, k % 8 BETWEEN 1 AND 6 AND k // 8 BETWEEN 1 AND 6 AS inner_, p[k + 2] - p[k] AS dx, p[k + 9] - p[k - 7] AS dy, 4 * p[k + 1] - p[k] - p[k + 2] - p[k - 7] - p[k + 9] AS l FROM i, range(64) t(k)),
r AS (SELECT row_number() OVER () AS n, l_orderkey AS vec_id, l_linenumber, floor(l_discount * 8 * 8) AS x0, floor(l_tax * 10 * 8) AS y0, least(ceil((l_discount * 8 + l_quantity / 100) * 8), 8) AS x1, least(ceil((l_tax * 10 + 0.5) * 8), 8) AS y1 FROM lineitem),
s AS (SELECT n, any_value(r.vec_id) AS vec_id, any_value(l_linenumber) AS l_linenumber, nullif(count(v), 0) AS k, avg(v) AS mean, avg(v * v) - avg(v) * avg(v) AS var, avg(l * l) FILTER (inner_) AS lap, avg(dx * dx) FILTER (inner_) AS gx, avg(dy * dy) FILTER (inner_) AS gy FROM r LEFT JOIN px ON px.vec_id = r.vec_id AND x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY n),
f AS (SELECT vec_id, l_linenumber, k AS pixels, round(mean, 6) AS mean, if(var IS NULL, NULL, sqrt(greatest(var, 0)) / 255) AS c, lap / nullif(var, 0) AS d, lap / nullif((gx + gy) / 4, 0) AS u, greatest(gx, gy) / nullif(least(gx, gy), 0) AS a FROM s)
SELECT vec_id, l_linenumber, pixels, mean, round(c, 6) AS contrast, round(d, 6) AS detail, round(u, 6) AS curvature, round(a, 6) AS anisotropy,
  CASE WHEN pixels IS NULL OR pixels < 16 OR d IS NULL THEN 'insufficient' WHEN c < 0.02 THEN 'insufficient' WHEN d < 0.35 AND coalesce(u, 0) < 0.5 THEN 'severe_blur' WHEN d >= 1.2 AND coalesce(u, 0) >= 1.5 THEN 'clear' ELSE 'uncertain' END AS state FROM f""")
def region_measurement(spark: SparkSession, sf: str) -> DataFrame:
    found = pixels.measured(_images(spark, sf), _regions(spark, sf), "vec_id")
    rounded = (F.round(f"figures.{c}", 6).alias(c) for c in ("mean", "contrast", "detail", "curvature", "anisotropy"))
    return found.select("vec_id", "l_linenumber", "figures.pixels", *rounded, "state.state")


def _part_faces(spark: SparkSession, sf: str) -> DataFrame:
    """One face a line of an order, on the colour image of the order's number."""
    least = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("photo"), "l_linenumber").agg(F.min("l_discount").alias("d"), F.min("l_tax").alias("t"), F.min("l_quantity").alias("q"))
    part = {"x": "d * 5", "y": "t * 5", "w": "0.2D + q / 100", "h": "0.3D"}
    return least.select("photo", "l_linenumber", F.struct(*(F.expr(e).cast("double").alias(n) for n, e in part.items())).alias("box"))


def _colour_images(spark: SparkSession, sf: str) -> DataFrame:
    """Three vectors in a row, pixel by pixel."""
    bands = _images(spark, sf).groupBy(F.floor(F.col("vec_id") / 3).alias("photo")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "pixels"))).alias("b"))
    each = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.transform("b", lambda s: F.get(s["pixels"], i))))
    return bands.where(F.size("b") == 3).select("photo", each.alias("rgb"), F.lit(8).alias("width"))


_AROUND = "(VALUES ('face', 0.5, 0.0, 1.0, 1.0, 0.25), ('head', 0.70, -0.28, 1.40, 1.58, 0.35), ('upper_body', 1.25, 0.78, 2.50, 3.15, 0.47)) v(kind, l, dn, sw, sh, weight)"


@query(f"""WITH {_IMAGES}, g AS (SELECT vec_id // 3 AS photo, list(p ORDER BY vec_id) AS b FROM i GROUP BY 1 HAVING count(*) = 3),
f AS (SELECT l_orderkey AS photo, l_linenumber AS face, min(l_discount) * 5::DOUBLE AS x, min(l_tax) * 5::DOUBLE AS y, 0.2::DOUBLE + min(l_quantity) / 100 AS w, 0.3::DOUBLE AS h FROM lineitem GROUP BY 1, 2),
k AS (SELECT photo, face, kind, weight::DOUBLE AS weight, x + w / 2 - l::DOUBLE * w AS ax, y + dn::DOUBLE * h AS ay, sw::DOUBLE * w AS aw, sh::DOUBLE * h AS ah FROM f JOIN g USING (photo) CROSS JOIN {_AROUND}),
u AS (SELECT photo, face, kind, weight, greatest(ax, 0) AS x0, greatest(ay, 0) AS y0, greatest(ax, 0) + (least(ax + aw, 1) - greatest(ax, 0)) AS x1, greatest(ay, 0) + (least(ay + ah, 1) - greatest(ay, 0)) AS y1 FROM k WHERE least(ax + aw, 1) - greatest(ax, 0) > 1e-5 AND least(ay + ah, 1) - greatest(ay, 0) > 1e-5),
q AS (SELECT photo, face, kind, weight, cast(floor(x0 * 8) AS BIGINT) AS x0, cast(floor(y0 * 8) AS BIGINT) AS y0, cast(least(ceil(x1 * 8), 8) AS BIGINT) AS x1, cast(least(ceil(y1 * 8), 8) AS BIGINT) AS y1 FROM u),
r AS (SELECT *, round_even((x1 - x0) * 0.08::DOUBLE, 0) AS tx, round_even((y1 - y0) * 0.05::DOUBLE, 0) AS ty FROM q WHERE x1 - x0 >= 2 AND y1 - y0 >= 2),
t AS (SELECT *, if(x1 - x0 - 2 * tx >= 2 AND y1 - y0 - 2 * ty >= 2, tx, 0) AS cx, if(x1 - x0 - 2 * tx >= 2 AND y1 - y0 - 2 * ty >= 2, ty, 0) AS cy FROM r),
px AS (SELECT photo, face, kind, weight, x, y, x0 + cx AS xa, x1 - cx AS xb, y0 + cy AS ya, y1 - cy AS yb, b[1][8 * y + x + 1] AS r, b[2][8 * y + x + 1] AS g, b[3][8 * y + x + 1] AS bl FROM t JOIN g USING (photo), range(8) a(x), range(8) c(y) WHERE x >= x0 AND x < x1 AND y >= y0 AND y < y1),
py AS (SELECT *, greatest(r, g, bl) AS mx, greatest(r, g, bl) - least(r, g, bl) AS sp, (299 * r + 587 * g + 114 * bl) / 1000 AS gray, x >= xa AND x < xb AND y >= ya AND y < yb AS trimmed FROM px),
fl AS (SELECT photo, face, max(sp) FILTER (kind <> 'face') <= 2 AS achromatic FROM py GROUP BY 1, 2),
lo AS (SELECT photo, face, bool_and(sd < 2) AS flat FROM (SELECT photo, face, kind, stddev_pop(gray) AS sd FROM py WHERE kind <> 'face' GROUP BY 1, 2, 3) GROUP BY 1, 2),
tr AS (SELECT * FROM py WHERE trimmed),
gr AS (SELECT a.*, e.gray - w.gray AS gx, s.gray - n.gray AS gy FROM tr a JOIN tr e ON e.photo = a.photo AND e.face = a.face AND e.kind = a.kind AND e.y = a.y AND e.x = least(a.x + 1, a.xb - 1) JOIN tr w ON w.photo = a.photo AND w.face = a.face AND w.kind = a.kind AND w.y = a.y AND w.x = greatest(a.x - 1, a.xa)
  JOIN tr s ON s.photo = a.photo AND s.face = a.face AND s.kind = a.kind AND s.x = a.x AND s.y = least(a.y + 1, a.yb - 1) JOIN tr n ON n.photo = a.photo AND n.face = a.face AND n.kind = a.kind AND n.x = a.x AND n.y = greatest(a.y - 1, a.ya)),
bins AS (SELECT photo, face, kind, weight, 'colour' AS what, (CASE WHEN sp = 0 THEN 0 ELSE (CASE WHEN mx = r THEN (((g - bl) % (6 * sp)) + 6 * sp) % (6 * sp) WHEN mx = g THEN bl - r + 2 * sp ELSE r - g + 4 * sp END) * 12 // (6 * sp) END) * 5 + least(sp * 5 // greatest(mx, 1), 4) AS bin, 1.0::DOUBLE AS m FROM gr
  UNION ALL SELECT photo, face, kind, weight, 'level', least(cast(floor(gray * 8 / 256) AS BIGINT), 7), 1.0 FROM gr
  UNION ALL SELECT photo, face, kind, weight, 'octant', CASE WHEN gy > 0 OR gy = 0 AND gx >= 0 THEN if(gx > 0, if(abs(gy) >= abs(gx), 1, 0), if(abs(gy) >= abs(gx), 2, 3)) WHEN gx < 0 THEN if(abs(gy) >= abs(gx), 5, 4) ELSE if(abs(gy) >= abs(gx), 6, 7) END, sqrt(gx * gx + gy * gy) FROM gr),
sm AS (SELECT photo, face, kind, any_value(weight) AS weight, what, bin, sum(m) AS m FROM bins GROUP BY photo, face, kind, what, bin), d AS (SELECT *, m / greatest(sum(m) OVER (PARTITION BY photo, face, kind, what), 1e-6) AS share FROM sm),
ref AS (SELECT photo, min(face) AS ref FROM f GROUP BY 1), parts AS (SELECT photo, face, kind, any_value(weight) AS weight, sqrt(sum(share * share) FILTER (what <> 'colour')) AS len FROM d GROUP BY 1, 2, 3),
pr AS (SELECT a.photo, a.face, a.kind, sum(least(a.share, b.share)) FILTER (a.what = 'colour') AS shared, sum(a.share * b.share) FILTER (a.what <> 'colour') AS dot FROM d a JOIN ref USING (photo) JOIN d b ON b.photo = a.photo AND b.face = ref AND b.kind = a.kind AND b.what = a.what AND b.bin = a.bin GROUP BY 1, 2, 3),
lk AS (SELECT p.photo, p.face, p.weight, least(greatest(0.68 * coalesce(shared, 0) + 0.32 * least(greatest(if(p.len * o.len > 1e-8, coalesce(dot, 0) / (p.len * o.len), 0), 0), 1), 0), 1) AS v FROM parts p JOIN ref USING (photo) JOIN parts o ON o.photo = p.photo AND o.face = ref AND o.kind = p.kind LEFT JOIN pr b ON b.photo = p.photo AND b.face = p.face AND b.kind = p.kind),
sc AS (SELECT photo, face, round(sum(v * weight) / sum(weight), 6) AS score FROM lk GROUP BY 1, 2)
SELECT photo, face, coalesce(score, 0) AS score, concat_ws(',', if(achromatic, 'achromatic', NULL), if(coalesce(flat, true), 'low_texture', NULL)) AS flags FROM f JOIN g USING (photo) LEFT JOIN sc USING (photo, face) LEFT JOIN fl USING (photo, face) LEFT JOIN lo USING (photo, face)""")
def reference_likeness(spark: SparkSession, sf: str) -> DataFrame:
    """Each face of a photo against the photo's first."""
    photos = _colour_images(spark, sf)
    faces = _part_faces(spark, sf).join(photos.select("photo"), "photo", "left_semi").withColumnRenamed("l_linenumber", "face_id")
    built = pixels.references(photos, faces, "photo", least=2)
    first = built.groupBy("photo").agg(F.min_by(F.struct(*pixels.AROUND), "face_id").alias("_ref"))
    score = pixels.appearance({k: F.col(k) for k in pixels.AROUND}, {k: F.col(f"_ref.{k}") for k in pixels.AROUND})
    return built.join(first, "photo").select("photo", F.col("face_id").alias("face"), F.round(score, 6).alias("score"), F.array_join("flags", ",").alias("flags"))


def _frames(spark: SparkSession, sf: str) -> DataFrame:
    """Nine vectors in a row, three by three, and the middle one of the frame before as template: twice itself at most, and half."""
    tiles = _images(spark, sf).groupBy(F.floor(F.col("vec_id") / 9).alias("frame")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "pixels"))).alias("b")).where(F.size("b") == 9)
    at = lambda i: F.get(F.get(F.col("b"), (F.floor(i / 192) * 3 + F.floor(i % 24 / 8)).cast("int"))["pixels"], (F.floor(i / 24) % 8 * 8 + i % 8).cast("int"))
    frames = tiles.select("frame", F.transform(F.sequence(F.lit(0), F.lit(575)), at).alias("pixels"), F.lit(24).alias("width"))
    middle = tiles.select((F.col("frame") + 1).alias("frame"), F.get(F.col("b"), 4)["pixels"].alias("template"), F.lit(8).alias("template_width"))
    return frames.join(middle, "frame").withColumn("box", F.struct(F.lit(8 / 24).alias("w"), F.lit(8 / 24).alias("h")))


def _edges(n: int) -> str:
    """SQL for the lengths of the central differences of the list v, n x n."""
    at = lambda x, y: f"v[greatest(0, least({n - 1}, {y})) * {n} + greatest(0, least({n - 1}, {x})) + 1]"
    x, y = f"k % {n}", f"k // {n}"
    return f"list_transform(range({n * n}), lambda k: sqrt(({at(x + ' + 1', y)} - {at(x + ' - 1', y)}) ** 2 + ({at(x, y + ' + 1')} - {at(x, y + ' - 1')}) ** 2))"


def _response(size: int) -> str:
    """SQL for the response of a template of 8 x 8 at the size 4, 8 or 16, at every offset."""
    at = lambda c, x, y: f"t.{c}[8 * ({y}) + {x} + 1]"
    x, y = f"k % {size}", f"k // {size}"
    cell = lambda c: f"({' + '.join(at(c, f'2 * ({x}) + {i}', f'2 * ({y}) + {j}') for i in (0, 1) for j in (0, 1))}) / 4" if size == 4 else at(c, x, y) if size == 8 else at(c, f"({x}) // 2", f"({y}) // 2")
    fit = lambda a, b: f"((list_inner_product({a}, {b}) / {size * size} - list_avg({a}) * list_avg({b})) / nullif(list_aggregate({a}, 'stddev_pop') * list_aggregate({b}, 'stddev_pop'), 0))"
    part = lambda c: f"list_transform(range({size * size}), lambda k: i.{c}[(oy + {y}) * 24 + ox + {x} + 1]) AS i{c}, list_transform(range({size * size}), lambda k: {cell(c)}) AS t{c}"
    return f"SELECT frame, {size} AS size, ox, oy, round(0.42 * {fit('iv', 'tv')} + 0.58 * {fit('ie', 'te')}, 9) AS s FROM (SELECT frame, ox, oy, {part('v')}, {part('e')} FROM im i JOIN tp t USING (frame), range({25 - size}) p(ox), range({25 - size}) q(oy))"


@query(f"""WITH {_IMAGES}, g AS (SELECT vec_id // 9 AS frame, list(p ORDER BY vec_id) AS b FROM i GROUP BY 1 HAVING count(*) = 9),
i0 AS (SELECT frame, list_transform(range(576), lambda k: cast(b[3 * (k // 192) + k % 24 // 8 + 1][8 * (k // 24 % 8) + k % 8 + 1] AS DOUBLE)) AS v FROM g), t0 AS (SELECT frame + 1 AS frame, list_transform(b[5], lambda c: cast(c AS DOUBLE)) AS v FROM g),
im AS MATERIALIZED (SELECT frame, v, {_edges(24)} AS e FROM i0), tp AS MATERIALIZED (SELECT frame, v, {_edges(8)} AS e FROM t0),
s AS MATERIALIZED ({" UNION ALL ".join(map(_response, (4, 8, 16)))}), o AS (SELECT *, row_number() OVER (PARTITION BY frame, size ORDER BY s DESC NULLS LAST, oy, ox) AS r FROM s)
SELECT frame, size / 8 AS scale, round(s, 6) AS score, round(ox / 24, 6) AS x, round(oy / 24, 6) AS y FROM o WHERE r = 1 AND s >= 0.42""")
def template_peaks(spark: SparkSession, sf: str) -> DataFrame:
    """The best place of each size."""
    found = pixels.template_peaks(_frames(spark, sf), scales=(0.5, 1.0, 2.0), least=(4, 4)).where("nth = 0")
    return found.select("frame", "scale", F.round("score", 6).alias("score"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query()
def template_anchors(spark: SparkSession, sf: str) -> DataFrame:
    """Both of a frame's best places, whatever their size."""
    return pixels.anchors(pixels.template_peaks(_frames(spark, sf), scales=(0.5, 1.0, 2.0), least=(4, 4)), ["frame"])


_PART_HASH = "list_sum(list_transform(range(64), lambda j: if(p[8 * (y0 + (2 * (j // 8) + 1) * (y1 - y0) // 16) + x0 + (2 * (j % 8 + 1) + 1) * (x1 - x0) // 18 + 1] > p[8 * (y0 + (2 * (j // 8) + 1) * (y1 - y0) // 16) + x0 + (2 * (j % 8) + 1) * (x1 - x0) // 18 + 1], cast(1 AS HUGEINT) << (63 - cast(j AS INTEGER)), 0)))"


@query(f"""WITH {_IMAGES}, l AS (SELECT l_orderkey AS vec_id, l_linenumber, min(l_discount) AS d, min(l_tax) AS t, min(l_quantity) AS q, max(l_returnflag) AS f FROM lineitem GROUP BY 1, 2),
r AS (SELECT vec_id, l_linenumber, f = 'R' OR l_linenumber = 7 OR vec_id % 10 = 0 AS recomputed, cast(floor(d * 8 * 8) AS BIGINT) AS x0, cast(floor((t * 10 + if(f = 'R', 0.05, 0)::DOUBLE) * 8) AS BIGINT) AS y0, cast(least(ceil((d * 8 + q / 100) * 8), 8) AS BIGINT) AS x1, cast(least(ceil((t * 10 + if(f = 'R', 0.05, 0)::DOUBLE + 0.5) * 8), 8) AS BIGINT) AS y1 FROM l),
h AS (SELECT r.vec_id, l_linenumber, recomputed, p, x0, y0, x1, y1, {_PART_HASH} AS u FROM r JOIN i USING (vec_id))
SELECT vec_id, l_linenumber, recomputed, if(x0 < x1 AND y0 < y1, cast(if(u >= cast(9223372036854775808 AS HUGEINT), u - cast(18446744073709551616 AS HUGEINT), u) AS BIGINT), NULL) AS hash FROM h""")
def refreshed_region_features(spark: SparkSession, sf: str) -> DataFrame:
    """Features of a first state, then those of a second, in which returned lines have moved, the seventh line is new and every tenth image has changed."""
    images = _images(spark, sf)
    lines = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("vec_id"), "l_linenumber").agg(F.min("l_discount").alias("d"), F.min("l_tax").alias("t"), F.min("l_quantity").alias("q"), F.max("l_returnflag").alias("f")).join(images.select("vec_id"), "vec_id", "left_semi")
    box = lambda moved: F.struct(F.expr("d * 8").alias("x"), F.expr(f"t * 10 + {moved}").alias("y"), F.expr("q / 100").alias("w"), F.lit(0.5).alias("h"))
    before = images.withColumn("pixels", F.when(F.col("vec_id") % 10 == 0, F.reverse("pixels")).otherwise(F.col("pixels")))
    stored = pixels.region_features(before, lines.where("l_linenumber <> 7").withColumn("box", box("0D")), None, "vec_id", "l_linenumber")
    now = lines.withColumn("box", box("if(f = 'R', 0.05D, 0D)"))
    return pixels.region_features(images, now, stored, "vec_id", "l_linenumber").select("vec_id", "l_linenumber", "recomputed", "hash")


def _fit(n: int) -> str:
    """SQL for the n-th fit: centred sums over a pair's inliers, then who fits."""
    return f"""c{n} AS (SELECT part, avg(sx) AS mx, avg(sy) AS my, avg(tx) AS mu, avg(ty) AS mv FROM m{n} WHERE i GROUP BY part),
f{n} AS (SELECT part, any_value(mx) AS mx, any_value(my) AS my, any_value(mu) AS mu, any_value(mv) AS mv, sum((sx - mx) * (tx - mu) + (sy - my) * (ty - mv)) / nullif(sum((sx - mx) ** 2 + (sy - my) ** 2), 0) AS a, sum((sx - mx) * (ty - mv) - (sy - my) * (tx - mu)) / nullif(sum((sx - mx) ** 2 + (sy - my) ** 2), 0) AS b FROM m{n} JOIN c{n} USING (part) WHERE i GROUP BY part),
m{n + 1} AS MATERIALIZED (SELECT m.part, sx, sy, tx, ty, votes, f.a, f.b, mu - f.a * mx + f.b * my AS p, mv - f.b * mx - f.a * my AS q, coalesce((f.a * (sx - mx) - f.b * (sy - my) + mu - tx) ** 2 + (f.b * (sx - mx) + f.a * (sy - my) + mv - ty) ** 2 <= 9, false) AS i FROM m{n} m LEFT JOIN f{n} f USING (part))"""


def _hull_sql(x: str, y: str, name: str) -> str:
    """SQL for the hull of a part's inliers: the sides that leave no point outside, each as long as it can be."""
    return f"""{name}p AS MATERIALIZED (SELECT DISTINCT part, {x} AS x, {y} AS y FROM m3 WHERE i),
{name} AS (SELECT part, abs(sum(p.x * q.y - q.x * p.y)) / 2 AS area FROM {name}p p JOIN {name}p q USING (part) WHERE (p.x <> q.x OR p.y <> q.y) AND NOT EXISTS (SELECT 1 FROM {name}p o WHERE o.part = p.part AND ((q.x - p.x) * (o.y - p.y) < (q.y - p.y) * (o.x - p.x) OR ((q.x - p.x) * (o.y - p.y) = (q.y - p.y) * (o.x - p.x) AND (o.x - p.x) * (o.x - q.x) + (o.y - p.y) * (o.y - q.y) > 0))) GROUP BY part)"""


_NOISY = "list_transform(range(64), lambda k: least(255, p[k + 1] + if((k * 7 + part) % 3 = 0, part % 5 * 16, 0)))"
_SSIM = "list_avg(list_transform(range(4), lambda g: (2 * list_avg(l[16 * g + 1:16 * g + 16]) * list_avg(r[16 * g + 1:16 * g + 16]) + 6.5025) / (list_avg(l[16 * g + 1:16 * g + 16]) ** 2 + list_avg(r[16 * g + 1:16 * g + 16]) ** 2 + 6.5025) * (2 * (list_inner_product(l[16 * g + 1:16 * g + 16], r[16 * g + 1:16 * g + 16]) / 16 - list_avg(l[16 * g + 1:16 * g + 16]) * list_avg(r[16 * g + 1:16 * g + 16])) + 58.5225) / (list_aggregate(l[16 * g + 1:16 * g + 16], 'var_pop') + list_aggregate(r[16 * g + 1:16 * g + 16], 'var_pop') + 58.5225)))"


@query(f"""WITH {_IMAGES}, l AS (SELECT l_partkey AS part, l_orderkey * 10 + l_linenumber AS point, min(l_quantity) AS q, min(l_extendedprice) AS e, min(l_suppkey) AS s, min(l_returnflag) AS f FROM lineitem GROUP BY 1, 2),
k AS (SELECT part, point, s, f = 'A' AND part % 3 = 0 AS odd, q / 50 * 640 AS x, e % 1000 / 1000 * 480 AS y, list_transform([1, 9, 17, 25], lambda j: cast('0x' || substring(md5(cast(point AS VARCHAR)), j, 8) AS BIGINT)) AS w, list_transform([1, 9, 17, 25], lambda j: cast('0x' || substring(md5('r' || point), j, 8) AS BIGINT)) AS v FROM l),
r AS (SELECT part, point, if(odd, 640 - x, x + part % 21 - 10 + s % 3 - 1) AS tx, if(odd, 480 - y, y + part % 13 - 6 + s % 2) AS ty, if(s % 5 = 0, v, [xor(w[1], 1), w[2], w[3], w[4]]) AS w FROM k),
d AS (SELECT part, a.point AS i, b.point AS j, x AS sx, y AS sy, tx, ty, bit_count(xor(a.w[1], b.w[1])) + bit_count(xor(a.w[2], b.w[2])) + bit_count(xor(a.w[3], b.w[3])) + bit_count(xor(a.w[4], b.w[4])) AS n FROM k a JOIN r b USING (part)),
n AS (SELECT *, row_number() OVER z AS g, lead(n) OVER z AS nxt FROM d WINDOW z AS (PARTITION BY part, i ORDER BY n, j)), u AS (SELECT * FROM n WHERE g = 1 AND n < 0.78 * nxt QUALIFY row_number() OVER (PARTITION BY part, j ORDER BY n, i) = 1),
vt AS (SELECT part, floor((tx - sx) / 20) - ox AS dx, floor((ty - sy) / 20) - oy AS dy, count(*) AS votes FROM u, range(2) a(ox), range(2) b(oy) GROUP BY ALL), pk AS (SELECT * FROM vt QUALIFY row_number() OVER (PARTITION BY part ORDER BY votes DESC, dx, dy) = 1),
m0 AS MATERIALIZED (SELECT part, sx, sy, tx, ty, votes, floor((tx - sx) / 20) - dx IN (0, 1) AND floor((ty - sy) / 20) - dy IN (0, 1) AS i FROM u JOIN pk USING (part)), {_fit(0)}, {_fit(1)}, {_fit(2)},
{_hull_sql("sx", "sy", "hs")}, {_hull_sql("tx", "ty", "ht")},
al AS (SELECT part, count(*) AS matches, count(*) FILTER (i) AS inliers, any_value(votes) AS votes, any_value(a) AS a, any_value(b) AS b, any_value(p) AS p, any_value(q) AS q, max(sx) FILTER (i) - min(sx) FILTER (i) AS wx, max(sy) FILTER (i) - min(sy) FILTER (i) AS wy, max(tx) FILTER (i) - min(tx) FILTER (i) AS vx, max(ty) FILTER (i) - min(ty) FILTER (i) AS vy FROM m3 GROUP BY part),
pc AS (SELECT p_partkey AS part, p AS l, {_NOISY.replace("part", "p_partkey")} AS r FROM part JOIN i ON vec_id = p_partkey % 500),
mv AS (SELECT al.*, sqrt(a * a + b * b) AS scale, abs(degrees(atan2(b * 640 / 480, a))) AS rotation, greatest(abs((a * 320 - b * 240 + p) / 640 - 0.5), abs((b * 320 + a * 240 + q) / 480 - 0.5)) AS translation FROM al),
gr AS (SELECT part, r[8 * y + x + 1] AS rv, x, y, l, floor((a * ((x + 0.5) / 8 - p / 640) + b * 480 / 640 * ((y + 0.5) / 8 - q / 480)) / (a * a + b * b) * 8) AS j, floor((a * ((y + 0.5) / 8 - q / 480) - b * 640 / 480 * ((x + 0.5) / 8 - p / 640)) / (a * a + b * b) * 8) AS i FROM pc JOIN mv USING (part), range(8) g(x), range(8) h(y) WHERE a IS NOT NULL),
bg AS (SELECT part, count(*) FILTER (ok) / 64 AS coverage, avg(abs(l[8 * cast(i AS BIGINT) + cast(j AS BIGINT) + 1] - rv)) FILTER (ok) / 255 AS difference FROM (SELECT *, i BETWEEN 0 AND 7 AND j BETWEEN 0 AND 6 AND x < 7 AS ok FROM gr) GROUP BY part),
pe AS (SELECT part, {_SSIM} AS ssim, list_sum(list_transform(range(8), lambda b: least(len(list_filter(l, lambda v: v // 32 = b)), len(list_filter(r, lambda v: v // 32 = b))))) / 64 AS shared FROM pc)
SELECT part, coalesce(matches, 0) AS matches, coalesce(inliers, 0) AS inliers, round(scale, 6) AS scale, round(rotation, 6) AS rotation, round(translation, 6) AS translation, round(coverage, 6) AS coverage,
 CASE WHEN NOT part % 7 * 0.013 + part % 4 * 0.005 <= 0.06 THEN 'face_moved' WHEN NOT (0.2 + part % 4 * 0.01) * 0.2 / (0.2 * 0.2) <= 1.25 THEN 'face_resized' WHEN part % 11 > 8 THEN 'face_hash' WHEN NOT ssim + 1e-6 >= 0.65 THEN 'face_structure' WHEN NOT shared >= 0.55 THEN 'face_colour' WHEN part % 17 > 10 THEN 'context_hash'
  WHEN NOT coalesce(matches >= 12, false) THEN 'few_matches' WHEN inliers < 12 THEN 'few_inliers' WHEN inliers / matches < 0.55 THEN 'low_share' WHEN NOT (wx / 640 >= 0.12 AND wy / 480 >= 0.12 AND hs.area / 307200 >= 0.03 AND vx / 640 >= 0.12 AND vy / 480 >= 0.12 AND ht.area / 307200 >= 0.03) THEN 'not_spread'
  WHEN NOT (scale BETWEEN 0.94 AND 1.06 AND rotation <= 3 AND translation <= 0.06) THEN 'frame_moved' WHEN coverage < 0.12 THEN 'little_background' WHEN NOT coalesce(difference <= 0.04, false) THEN 'other_background' END AS reason
FROM pe LEFT JOIN mv USING (part) LEFT JOIN bg USING (part) LEFT JOIN hs USING (part) LEFT JOIN ht USING (part)""")
def pose_compatible(spark: SparkSession, sf: str) -> DataFrame:
    """A part is a photo beside one that was taken after it; its lines are keypoints, a third of which may have moved by themselves."""
    lines = read(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("part"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("point")).agg(F.min("l_quantity").alias("q"), F.min("l_extendedprice").alias("e"), F.min("l_suppkey").alias("s"), F.min("l_returnflag").alias("f"))
    words = lambda text: F.array(*(F.conv(F.substring(F.md5(text), j, 8), 16, 10).cast("long") for j in (1, 9, 17, 25)))
    w = lines.selectExpr("part", "point", "s", "f = 'A' and part % 3 = 0 as odd", "q / 50 * 640 as x", "e % 1000 / 1000 * 480 as y").withColumn("w", words(F.col("point").cast("string")))
    moved = F.expr("if(odd, 640 - x, x + part % 21 - 10 + s % 3 - 1)"), F.expr("if(odd, 480 - y, y + part % 13 - 6 + s % 2)")
    bits = F.when(F.col("s") % 5 == 0, words(F.concat(F.lit("r"), F.col("point").cast("string")))).otherwise(F.expr("array(w[0] ^ 1, w[1], w[2], w[3])"))
    points = w.select(F.col("part").alias("photo"), "point", "x", "y", F.col("w").alias("bits")).unionByName(w.select((-1 - F.col("part")).alias("photo"), "point", moved[0].alias("x"), moved[1].alias("y"), bits.alias("bits")))
    parts = read(spark, sf, "part").select(F.col("p_partkey").alias("left"), (-1 - F.col("p_partkey")).alias("right"))
    size = (F.lit(640.0), F.lit(480.0))
    found = portrait.aligned(portrait.matches(parts, points)).drop("right")
    noisy = F.transform("pixels", lambda v, k: F.least(F.lit(255), v + F.when((k * 7 + F.col("left")) % 3 == 0, F.col("left") % 5 * 16).otherwise(0)))
    images = _images(spark, sf).select(F.col("vec_id").alias("_v"), "pixels")
    rows = parts.join(images, F.col("left") % 500 == F.col("_v")).withColumn("noisy", noisy).join(found, "left", "left")
    fit = {c: F.col(c) for c in ("matches", "inliers", "a", "b", "p", "q", "source", "target")}
    rows = rows.withColumn("moved", portrait.movement(fit, size, size)).withColumn("mask", F.transform("pixels", lambda v, k: (k % 8 < 7).cast("long")))
    rows = rows.withColumn("behind", portrait.background(F.col("pixels"), F.col("mask"), F.col("noisy"), F.col("mask"), F.lit(8), F.when(F.col("a").isNotNull(), portrait.unit_map(fit, size, size))))
    part = F.col("left")
    box = lambda x, w: F.struct(x.alias("x"), F.lit(0.3).alias("y"), w.alias("w"), F.lit(0.2).alias("h"))
    blocks = lambda c: F.array(*(F.slice(c, 16 * g + 1, 16) for g in range(4)))
    levels = lambda c: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda b: F.size(F.filter(c, lambda v: F.floor(v / 32) == b)).cast("double"))
    flipped = lambda n: F.expr(f"shiftleft(1L, cast(left % {n} as int)) - 1")
    one = {"face": box(F.lit(0.4), F.lit(0.2)), "face_hash": F.lit(0).cast("long"), "face_blocks": blocks("pixels"), "face_colour": levels("pixels"), "context_hash": F.lit(0).cast("long"), "context_colour": levels("pixels")}
    two = {"face": box(0.4 + part % 7 * 0.013, 0.2 + part % 4 * 0.01), "face_hash": flipped(11), "face_blocks": blocks("noisy"), "face_colour": levels("noisy"), "context_hash": flipped(17), "context_colour": levels("noisy")}
    gates = portrait.compatible(portrait.same_person(one, two, portrait.STANDARD), portrait.same_scene(fit, F.col("moved"), F.col("behind"), size, size, portrait.STANDARD))
    rounded = (F.round(f"moved.{c}", 6).alias(c) for c in ("scale", "rotation", "translation"))
    return rows.select(part.alias("part"), F.coalesce("matches", F.lit(0)).alias("matches"), F.coalesce("inliers", F.lit(0)).alias("inliers"), *rounded, F.round("behind.coverage", 6).alias("coverage"), gates["reason"].alias("reason"))
