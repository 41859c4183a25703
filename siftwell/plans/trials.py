"""Queries of trials, scenes and validated replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import scenes, trials
from .registry import query, read


@query("""WITH d AS (SELECT lang, doc_id, source AS c, n_chars // 500 AS t FROM documents WHERE n_chars IS NOT NULL),
p AS (SELECT a.lang, coalesce(a.c = b.c, false) AS together, a.t = b.t AS same FROM d a JOIN d b ON a.lang IS NOT DISTINCT FROM b.lang AND a.doc_id < b.doc_id),
n AS (SELECT lang, count(*) AS pairs, count(*) FILTER (together AND same) AS tp, count(*) FILTER (together AND NOT same) AS fp, count(*) FILTER (same AND NOT together) AS fn, count(*) FILTER (NOT same AND NOT together) AS tn FROM p GROUP BY lang)
SELECT l.lang, coalesce(pairs, 0) AS pairs, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, coalesce(tn, 0) AS tn, round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / nullif(tp + fn, 0), 9) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) AS f1
FROM (SELECT DISTINCT lang FROM d) l LEFT JOIN n ON n.lang IS NOT DISTINCT FROM l.lang""")
def pairwise_cluster_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Sources as a clustering of documents of about one length, by language."""
    docs = read(spark, sf, "documents").select("lang", "source", F.floor(F.col("n_chars") / 500).alias("size"))
    out = trials.pair_scores(docs, ["lang"], "source", "size")
    return out.select("lang", *(F.col(c).cast("long").alias(c) for c in ("pairs", "tp", "fp", "fn", "tn")), *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


def _trial(spark: SparkSession, sf: str) -> DataFrame:
    """Labels as people; a label of 7 has lost its references."""
    rows = trials.gallery_split(read(spark, sf, "embeddings").select("vec_id", "label", "embedding"), "label", "vec_id", 3, 11)
    return trials.recognised(rows.where("part = 'probe' or label <> 7"), "label", "vec_id", "embedding")


_TRIAL = """WITH o AS (SELECT vec_id, label, list_transform(embedding, lambda c: cast(c AS DOUBLE)) AS v, row_number() OVER (PARTITION BY label ORDER BY sha256('11:' || vec_id), vec_id) AS n FROM embeddings),
s AS (SELECT p.vec_id, p.label, g.label AS subject, max(round(list_inner_product(p.v, g.v) / sqrt(list_inner_product(p.v, p.v) * list_inner_product(g.v, g.v)), 9)) AS score FROM o p JOIN o g ON p.n > 3 AND g.n <= 3 AND g.label <> 7 GROUP BY ALL),
t AS (SELECT vec_id, label, max(score) FILTER (subject = label) AS own, arg_max(subject, (score, -subject)) FILTER (subject <> label) AS other, max(score) FILTER (subject <> label) AS other_score FROM s GROUP BY ALL),
r AS (SELECT t.*, if(own IS NULL, NULL, 1 + (SELECT count(*) FROM s WHERE s.vec_id = t.vec_id AND subject <> s.label AND score > own)) AS rank FROM t) """


@query(_TRIAL + "SELECT vec_id, label, round(own, 6) AS own, other, round(other_score, 6) AS other_score, rank FROM r")
def recognition_trial(spark: SparkSession, sf: str) -> DataFrame:
    return _trial(spark, sf).select("vec_id", "label", F.round("own", 6).alias("own"), "other", F.round("other_score", 6).alias("other_score"), "rank")


@query(_TRIAL + "SELECT count(*) AS probes, count(*) FILTER (rank <= 1) AS top1, count(*) FILTER (rank <= 2) AS top2, count(*) FILTER (rank <= 3) AS top3, count(*) FILTER (rank <= 4) AS top4, count(*) FILTER (rank IS NULL) AS unranked FROM r")
def recognition_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return trials.top_ranks(_trial(spark, sf))


@query(_TRIAL + """SELECT round(cast(-1 + b * 0.05 AS DOUBLE), 9) AS threshold, count(*) FILTER (greatest(own, other_score) >= e) AS accepted, count(*) FILTER (own >= other_score AND own >= e) AS correct, count(*) FILTER (other_score >= e) AS "false", count(*) FILTER (own IS NULL OR own < e) AS missed
FROM (SELECT b, if(b = 0, -2, -1 + b * 0.05) AS e FROM range(40) q(b)) CROSS JOIN r GROUP BY b""")
def recognition_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return trials.swept(_trial(spark, sf), 40).withColumn("threshold", F.round("threshold", 9))


@query("""WITH w AS (SELECT source, doc_id, unnest(string_split(text, ' ')) AS c FROM documents), t AS (SELECT source, doc_id, c, count(*) AS m FROM w WHERE source IS NOT NULL GROUP BY ALL), h AS (SELECT *, round(m / sum(m) OVER (PARTITION BY source, doc_id), 12) AS s FROM t),
k AS (SELECT source, doc_id, list({'c': c, 's': s} ORDER BY c) AS h FROM h GROUP BY ALL), e AS (SELECT source, h, min(doc_id) AS k FROM k GROUP BY ALL), o AS (SELECT a.source, a.doc_id AS a, b.doc_id AS b, sum(least(a.s, b.s)) AS overlap FROM h a JOIN h b ON a.source = b.source AND a.c = b.c AND a.doc_id < b.doc_id WHERE a.doc_id IN (SELECT k FROM e) AND b.doc_id IN (SELECT k FROM e) GROUP BY ALL)
SELECT source, a, b, round(overlap, 6) AS overlap FROM o WHERE overlap + 1e-9 >= 0.64 UNION ALL SELECT source, k, doc_id, 1 FROM k JOIN e USING (source, h) WHERE k <> doc_id""")
def histogram_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of a source as photos, their words as cells."""
    words = scenes.worded(read(spark, sf, "documents").where("source is not null"), "doc_id", "text", ["source"])
    return scenes.shared_histograms(words, 0.64, ["source"]).withColumn("overlap", F.round("overlap", 6))


@query("""WITH w AS (SELECT source, doc_id, unnest(string_split(text, ' ')) AS c FROM documents), t AS (SELECT source, doc_id, c, count(*) AS m FROM w WHERE source IS NOT NULL GROUP BY ALL), h AS (SELECT *, round(m / sum(m) OVER (PARTITION BY source, doc_id), 12) AS s FROM t),
k AS (SELECT source, doc_id, list({'c': c, 's': s} ORDER BY c) AS h FROM h GROUP BY ALL), e AS (SELECT source, h, min(doc_id) AS k FROM k GROUP BY ALL), o AS (SELECT a.source, a.doc_id AS a, b.doc_id AS b, sum(least(a.s, b.s)) AS overlap FROM h a JOIN h b ON a.source = b.source AND a.c = b.c AND a.doc_id < b.doc_id WHERE a.doc_id IN (SELECT k FROM e) AND b.doc_id IN (SELECT k FROM e) GROUP BY ALL),
p AS (SELECT a, b, overlap FROM o WHERE overlap + 1e-9 >= 0.64 UNION ALL SELECT k, doc_id, 1 FROM k JOIN e USING (source, h) WHERE k <> doc_id),
q AS (SELECT a, b, round(overlap, 6) AS v, coalesce(x.lang = y.lang, false) AS people, x.lang IS NULL OR y.lang IS NULL AS blind, greatest(x.n_chars, y.n_chars) / least(x.n_chars, y.n_chars) AS ratio, x.n_chars > y.n_chars AS more FROM p JOIN documents x ON x.doc_id = a JOIN documents y ON y.doc_id = b)
SELECT a, b, v AS overlap, CASE WHEN ratio > 2 THEN false WHEN NOT people AND NOT blind THEN false WHEN ratio <= 1.08 THEN people OR blind AND v >= 0.8 ELSE people AND v >= if(more, 0.8, 0.7) AND (NOT more OR blind) OR blind AND v >= 0.8 END AS accepted FROM q""")
def burst_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """What two documents share, and whether that makes them one burst: lengths stand for the camera, languages for who is seen."""
    from ..operators import decisions

    docs = read(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    side = lambda k: docs.select(F.col("doc_id").alias(k), F.col("lang").alias(f"_l{k}"), F.col("n_chars").alias(f"_n{k}"))
    found = histogram_overlaps(spark, sf).join(side("a"), "a").join(side("b"), "b")
    ratio, people, blind = F.greatest("_na", "_nb") / F.least("_na", "_nb"), F.coalesce(F.col("_la") == F.col("_lb"), F.lit(False)), F.col("_la").isNull() | F.col("_lb").isNull()
    seen = F.when(ratio > 2, "different").when(ratio <= 1.08, "same").otherwise("unknown")
    got = decisions.same_burst(seen, F.lit(False), F.lit(False), ~people & ~blind, people, blind, F.lit(False), F.col("overlap"), F.col("_na") > F.col("_nb"))
    return found.select("a", "b", "overlap", got.alias("accepted"))


_STRUCTURE = """WITH RECURSIVE h AS (SELECT vec_id, label % 3 AS r, list_transform(embedding, lambda c: cast(c AS DOUBLE)) AS v FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_sum(list_transform(range(64), lambda k: if((a.v[k + 1] > 0) = (b.v[k + 1] > 0), 0, 1))) AS distance, a.v AS x, b.v AS y FROM h a JOIN h b ON a.vec_id < b.vec_id AND abs(a.r - b.r) <= 1),
s AS (SELECT a, b, cast(distance AS INTEGER) AS distance, list_avg(list_transform(range(8), lambda g: (2 * list_avg(x[8 * g + 1:8 * g + 8]) * list_avg(y[8 * g + 1:8 * g + 8]) + 0.0001) / (list_avg(x[8 * g + 1:8 * g + 8]) ** 2 + list_avg(y[8 * g + 1:8 * g + 8]) ** 2 + 0.0001) * (2 * (list_inner_product(x[8 * g + 1:8 * g + 8], y[8 * g + 1:8 * g + 8]) / 8 - list_avg(x[8 * g + 1:8 * g + 8]) * list_avg(y[8 * g + 1:8 * g + 8])) + 0.0009) / (list_aggregate(x[8 * g + 1:8 * g + 8], 'var_pop') + list_aggregate(y[8 * g + 1:8 * g + 8], 'var_pop') + 0.0009))) AS score FROM p WHERE distance <= 22),
l AS MATERIALIZED (SELECT a, b, distance, round(score, 6) AS score FROM s WHERE score >= 0.15) """


def _structures(spark: SparkSession, sf: str) -> DataFrame:
    blocks = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", 8 * i + 1, 8))
    return read(spark, sf, "embeddings").select("vec_id", vectors.sign_hash(F.col("embedding")).alias("hash"), blocks.alias("blocks"), (1 + F.col("label") % 3 * 0.1).alias("aspect"))


@query(_STRUCTURE + "SELECT a, b, distance, score FROM l")
def structure_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Hashes within 22 bits, shapes within 1.15, then structure; the vectors hold no copies."""
    links, _ = scenes.verified_pairs(_structures(spark, sf), "vec_id", "hash", "blocks", "aspect", 22, 0.15, 1.15)
    return links.withColumn("score", F.round("score", 6))


@query(_STRUCTURE + """, o AS MATERIALIZED (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) AS n, coalesce(m, []) AS m FROM h LEFT JOIN (SELECT b, list(a) AS m FROM l GROUP BY b) ON b = vec_id),
w AS (SELECT cast(0 AS BIGINT) AS n, cast([] AS BIGINT[]) AS reps UNION ALL SELECT o.n, if(list_has_any(reps, m), reps, list_append(reps, id)) FROM w JOIN o ON o.n = w.n + 1), f AS (SELECT unnest(reps) AS rep FROM (SELECT reps FROM w ORDER BY n DESC LIMIT 1)),
g AS (SELECT b, arg_min(a, (distance, a)) AS rep FROM l JOIN f ON rep = a WHERE b NOT IN (SELECT rep FROM f) GROUP BY b)
SELECT vec_id, coalesce(rep, vec_id) AS representative FROM h LEFT JOIN g ON b = vec_id""")
def structure_groups(spark: SparkSession, sf: str) -> DataFrame:
    return scenes.grouped(_structures(spark, sf), "vec_id", "hash", "blocks", "aspect", 22, 0.15, 1.15).select("vec_id", "representative")


@query("""WITH a AS (SELECT user_id, bool_and(value < 200) AS q FROM events GROUP BY 1), s AS (SELECT user_id, event_id, event_type, ts, q, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events JOIN a USING (user_id))
SELECT event_id, user_id, if(q, 'b' || sum(if(p IS NULL OR ts - p > INTERVAL 12 HOUR, 1, 0)) OVER (PARTITION BY user_id ORDER BY ts, event_id), event_type) AS "group" FROM s""")
def dispatched_engines(spark: SparkSession, sf: str) -> DataFrame:
    """Users of small values only are cut at gaps, all others grouped by what the events are."""
    from pyspark.sql import Window

    rows = read(spark, sf, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "value")
    w = Window.partitionBy("user_id").orderBy("t", "event_id")

    def gaps(part: DataFrame) -> DataFrame:
        new = F.coalesce(F.col("t") - F.lag("t").over(w) > 12 * 3_600_000_000, F.lit(True)).cast("int")
        return part.withColumn("_n", new).select("event_id", "user_id", F.concat(F.lit("b"), F.sum("_n").over(w)).alias("group"))

    kinds = lambda part: part.select("event_id", "user_id", F.col("event_type").alias("group"))
    return scenes.dispatched(rows, "user_id", F.col("value") < 200, gaps, kinds)


_PART_TEXT = """'{{"part":"p' {c} cast(l_linenumber % 5 as {s}) {c} '","visibility":"' {c} CASE l_returnflag WHEN 'A' THEN 'visible' WHEN 'N' THEN 'not_visible' ELSE 'unknown' END {c} '","severity":"' {c} CASE WHEN l_tax > 0.075 THEN 'blurry' WHEN l_linestatus = 'F' THEN 'clear' ELSE 'uncertain' END
 {c} '","sufficient":' {c} CASE WHEN l_discount > 0.095 THEN '"yes"' WHEN l_discount > 0.045 THEN 'true' ELSE 'false' END {c} CASE WHEN l_quantity = 50 THEN '' WHEN l_quantity > 47 THEN ',"reason":"  "' ELSE ',"reason":"seen"' END {c} CASE WHEN l_quantity = 1 THEN ',"more":null' ELSE '' END {c} '}}'"""
_REPLY_TEXT = """'{{' {c} CASE WHEN l_orderkey % 13 = 0 THEN '' ELSE '"version":2,' END {c} '"order":' {c} cast(l_orderkey as {s}) {c} ',"digest":"' {c} CASE WHEN l_orderkey % 11 = 0 THEN 'old' ELSE 'd' {c} cast(l_orderkey as {s}) END {c} '","parts":[' {c} parts {c} ']' {c} CASE WHEN l_orderkey % 17 = 0 THEN ',"note":[1]' ELSE '' END {c} CASE WHEN l_orderkey % 19 = 0 THEN '' ELSE '}}' END"""


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "lineitem")


@query(f"""WITH t AS (SELECT l_orderkey, {_PART_TEXT.format(c="||", s="VARCHAR")} AS p FROM lineitem), o AS (SELECT l_orderkey, string_agg(p, ',' ORDER BY p) AS parts FROM t GROUP BY 1), r AS (SELECT l_orderkey, {_REPLY_TEXT.format(c="||", s="VARCHAR")} AS text FROM o),
j AS (SELECT l_orderkey, json(text) AS v FROM r WHERE json_valid(text)), e AS (SELECT l_orderkey, i, json_extract(v, '$.parts[' || i || ']') AS p FROM (SELECT l_orderkey, v, unnest(range(cast(json_array_length(json_extract(v, '$.parts')) AS BIGINT))) AS i FROM j)),
k AS (SELECT *, '$.parts[' || i || ']' AS pos, json_extract_string(p, '$.part') AS part, json_extract_string(p, '$.visibility') AS vis, json_extract_string(p, '$.severity') AS sev, json_extract_string(p, '$.reason') AS reason, json_type(json_extract(p, '$.sufficient')) AS kind, json_extract(p, '$.sufficient') = 'true' AS suf FROM e)
SELECT l_orderkey, '$' AS path, 'invalid' AS fault FROM r WHERE NOT json_valid(text) UNION ALL SELECT l_orderkey, '$.version', 'missing' FROM j WHERE json_extract(v, '$.version') IS NULL UNION ALL SELECT l_orderkey, '$.digest', 'differs' FROM j WHERE json_extract_string(v, '$.digest') <> 'd' || l_orderkey UNION ALL SELECT l_orderkey, '$.note', 'unexpected' FROM j WHERE json_extract(v, '$.note') IS NOT NULL
UNION ALL SELECT l_orderkey, '$.parts', 'too_long' FROM j WHERE json_array_length(json_extract(v, '$.parts')) > 6 UNION ALL SELECT l_orderkey, pos || '.severity', 'not_one_of' FROM k WHERE sev NOT IN ('clear', 'uncertain') UNION ALL SELECT l_orderkey, pos || '.sufficient', 'not_flag' FROM k WHERE kind <> 'BOOLEAN' UNION ALL SELECT l_orderkey, pos || '.reason', 'missing' FROM k WHERE reason IS NULL
UNION ALL SELECT l_orderkey, pos || '.reason', 'too_short' FROM k WHERE trim(reason) = '' UNION ALL SELECT l_orderkey, pos || '.more', 'unexpected' FROM k WHERE json_extract(p, '$.more') IS NOT NULL UNION ALL SELECT l_orderkey, pos, 'unseen_but_told' FROM k WHERE kind = 'BOOLEAN' AND vis <> 'visible' AND (sev <> 'uncertain' OR suf)
UNION ALL SELECT l_orderkey, pos, 'sufficient_but_uncertain' FROM k WHERE kind = 'BOOLEAN' AND vis = 'visible' AND suf = (sev = 'uncertain') UNION ALL SELECT l_orderkey, pos || '.part', 'repeated' FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, part ORDER BY i) AS n FROM k) WHERE n > 1""")
def reply_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Replies made of an order's lines, with faults of every kind."""
    from ..operators.protocol import Rule, checked

    parts = _lines(spark, sf).select("l_orderkey", F.expr(_PART_TEXT.format(c="||", s="string")).alias("p")).groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list("p")), ",").alias("parts"))
    replies = parts.select("l_orderkey", F.expr(_REPLY_TEXT.format(c="||", s="string")).alias("text"))
    told = lambda get: (get("visibility", "string") == "visible") | ((get("severity", "string") == "uncertain") & ~get("sufficient", "boolean"))
    sure = lambda get: (get("visibility", "string") != "visible") | (get("sufficient", "boolean") != (get("severity", "string") == "uncertain"))
    # a flag that isn't one is told as that, and by no check
    flagged = lambda check: lambda get: F.when(get("sufficient", "string").isin("true", "false"), check(get))
    part = Rule("object", {
        "part": Rule("text", least=1), "visibility": Rule("choice", choices=("visible", "not_visible", "unknown")), "severity": Rule("choice", choices=("clear", "uncertain")), "sufficient": Rule("flag"), "reason": Rule("text", least=1, most=160),
    }, checks={"unseen_but_told": flagged(told), "sufficient_but_uncertain": flagged(sure)})
    reply = Rule("object", {
        "version": Rule("number", least=2, most=2, whole=True), "order": Rule("echo", same=F.col("l_orderkey")), "digest": Rule("echo", same=F.concat(F.lit("d"), F.col("l_orderkey").cast("string"))), "parts": Rule("array", items=part, least=1, most=6, unique="part"),
    })
    return checked(replies, ["l_orderkey"], "text", reply)


_JSON_LINE = """'{"below":null,"l_linenumber":' || l_linenumber || ',"l_orderkey":' || l_orderkey || ',"state":{"flag":"' || l_returnflag || '","part":' || part || '}}'"""


@query(f"""WITH l AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS part, min(l_returnflag) AS l_returnflag, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2), d AS (SELECT *, sha256({_JSON_LINE}) AS d FROM l),
o AS (SELECT l_orderkey, sha256('{{"below":' || to_json(list(d ORDER BY l_linenumber)) || ',"l_orderkey":' || l_orderkey || ',"total":' || count(*) || '}}') AS d FROM d GROUP BY 1),
t AS (SELECT l_orderkey, l_linenumber, sha256({_JSON_LINE.replace("part ||", "if(q = 50, part + 1, part) ||")}) AS now, if(q = 49, 'forged', d) AS stored FROM d),
s AS (SELECT l_orderkey, sha256('{{"below":' || to_json(list(stored ORDER BY l_linenumber)) || ',"l_orderkey":' || l_orderkey || ',"total":' || count(*) || '}}') AS now FROM t GROUP BY 1)
SELECT t.l_orderkey, t.l_linenumber, CASE WHEN t.l_orderkey % 29 = 0 THEN '0_missing' WHEN s.now <> o.d THEN '0_changed' WHEN t.now <> t.stored THEN '1_changed' ELSE 'ok' END AS status FROM t JOIN s USING (l_orderkey) JOIN o USING (l_orderkey)""")
def evidence_recheck(spark: SparkSession, sf: str) -> DataFrame:
    """Digests are stored along order and line; then some lines' fields change, others' digests, and some orders are lost."""
    from ..operators.protocol import canonical_digest, rechecked

    lines = _lines(spark, sf).groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"), F.min("l_returnflag").alias("flag"), F.max("l_quantity").alias("q"))
    lines = lines.withColumn("state", F.struct("part", "flag")).withColumn("below", F.lit(None).cast("array<string>"))
    lines = lines.withColumn("stored", canonical_digest(lines, ["l_orderkey", "l_linenumber", "state", "below"]))
    orders = lines.groupBy("l_orderkey").agg(F.count("*").alias("total"), F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "stored"))), lambda s: s["stored"]).alias("below"))
    orders = orders.withColumn("stored", canonical_digest(orders, ["l_orderkey", "total", "below"])).drop("below").where("l_orderkey % 29 <> 0")
    changed = lines.drop("below").withColumn("state", F.struct(F.expr("if(q = 50, part + 1, part)").alias("part"), "flag")).withColumn("stored", F.expr("if(q = 49, 'forged', stored)"))
    return rechecked([(orders, ["l_orderkey"], ["total"], "stored"), (changed, ["l_orderkey", "l_linenumber"], ["state"], "stored")])


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey % 12 <> 0 AS known, l_linenumber % 7 AS mode, 4000 + l_suppkey % 7 AS w, 3000 AS h, cast(l_quantity AS INTEGER) * 82 - 50 AS x, cast(floor(l_extendedprice) AS INTEGER) % 3200 AS y, if(l_returnflag = 'R', NULL, cast(l_tax * 100 AS INTEGER) * 100) AS bw, if(l_linestatus = 'O', 0, 1) AS ok FROM lineitem),
r AS (SELECT *, CASE WHEN NOT known THEN 'unsupported_or_unknown_camera' WHEN mode NOT IN (2, 3, 4) THEN 'focus_mode_not_supported' WHEN x < 0 OR x >= w OR y >= h THEN 'focus_location_outside_frame' WHEN abs(2 * x - w) <= 1 AND abs(2 * y - h) <= 1 THEN 'camera_center_fallback_ambiguous'
  WHEN bw IS NOT NULL AND (ok = 0 OR bw = 0) THEN 'invalid_or_ambiguous_focus_frame' WHEN bw IS NOT NULL AND (x / w - bw / w / 2 < 0 OR y / h - 400 / h / 2 < 0 OR x / w + bw / w / 2 > 1 OR y / h + 400 / h / 2 > 1) THEN 'area_extends_outside_frame' ELSE 'playback_location_geometry_only' END AS reason FROM l)
SELECT l_orderkey, l_linenumber, reason, if(reason LIKE 'playback%', round(x / w, 6), NULL) AS x, if(reason LIKE 'playback%', round(y / h, 6), NULL) AS y, if(reason LIKE 'playback%', round(bw / w, 6), NULL) AS width FROM r""")
def focus_markers(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as the tags of one maker's photos."""
    from ..functions import markers

    lines = _lines(spark, sf).selectExpr("*", "4000 + l_suppkey % 7 as w", "cast(l_quantity as int) * 82 - 50 as x", "cast(floor(l_extendedprice) as int) % 3200 as y", "if(l_returnflag = 'R', null, cast(round(l_tax * 100) as int) * 100) as bw", "if(l_linestatus = 'O', 0, 1) as ok")
    given = F.expr("""map_filter(map('IFD0:Make', 'SONY ', 'IFD0:Model', if(l_partkey % 12 = 0, 'ILCE-7', 'ILCE-6600'), 'Sony:FocusMode', cast(l_linenumber % 7 as string), 'Sony:FocusLocation', concat_ws(' ', w, 3000, x, y), 'Sony:FocusFrameSize', bw || ' 400 ' || ok), (k, v) -> v is not null)""")
    found = lines.select("l_orderkey", "l_linenumber", markers.let({"tags": given}, lambda g: markers.sony(g["tags"])).alias("m"))
    point = F.get(F.col("m.points"), F.lit(0))
    return found.select("l_orderkey", "l_linenumber", "m.reason", F.round(point["x"], 6).alias("x"), F.round(point["y"], 6).alias("y"), F.round(point["w"], 6).alias("width"))
