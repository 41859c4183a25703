"""Validation of replies fault by fault, digests along a chain, evidence of confirmed regions."""

import json
import random

from pyspark.sql import functions as F

from siftwell.operators.protocol import Rule, canonical_digest, checked, mapped_evidence, rechecked

PART = Rule("object", {"part": Rule("choice", choices=("face", "body")), "sure": Rule("flag")}, {"note": Rule("text", least=1, most=5)})


def reply():  # columns need a session
    return Rule("object", {"id": Rule("echo", same=F.col("id")), "score": Rule("number", least=0, most=5, whole=True), "parts": Rule("array", items=PART, least=1, most=2, unique="part")}, checks={"high_but_unsure": lambda get: (get("score", "double") < 4) | get("parts[0].sure", "boolean")})


def faults(spark, *texts):
    rows = spark.createDataFrame([(i, "a", t) for i, t in enumerate(texts)], "n int, id string, text string")
    got = [[] for _ in texts]
    for r in checked(rows, ["n"], "text", reply()).collect():
        got[r["n"]].append((r["path"], r["fault"]))
    return [sorted(g) for g in got]


def test_every_fault_has_its_path(spark):
    good = {"id": "a", "score": 3, "parts": [{"part": "face", "sure": True}]}
    cases = [
        (good, []), (good | {"parts": [{"part": "face", "sure": True, "note": " ok "}]}, []), (good | {"score": 3.0}, []), (good | {"id": "b"}, [("$.id", "differs")]), (good | {"id": None}, [("$.id", "not_echo")]), (good | {"score": 2.5}, [("$.score", "not_whole")]),
        (good | {"score": True}, [("$.score", "not_number")]), (good | {"score": 9}, [("$.score", "above")]), (good | {"score": -1, "x": 1, "y": {}}, [("$.score", "below"), ("$.x", "unexpected"), ("$.y", "unexpected")]), (good | {"parts": []}, [("$.parts", "too_short")]), (good | {"parts": {}}, [("$.parts", "not_array")]),
        (good | {"parts": [{"part": "face", "sure": True}, {"part": "face", "sure": "true"}, 7]}, [("$.parts", "too_long"), ("$.parts[1].part", "repeated"), ("$.parts[1].sure", "not_flag"), ("$.parts[2]", "not_object")]),
        (good | {"parts": [{"part": "hand", "note": "   ", "more": None}]}, [("$.parts[0].more", "unexpected"), ("$.parts[0].note", "too_short"), ("$.parts[0].part", "not_one_of"), ("$.parts[0].sure", "missing")]),
        (good | {"parts": [{"part": "face", "sure": False}], "score": 5}, [("$", "high_but_unsure")]), ({}, [("$.id", "missing"), ("$.parts", "missing"), ("$.score", "missing")]), ([], [("$", "not_object")]), ("x", [("$", "not_object")]), (None, [("$", "not_object")]),
    ]
    assert faults(spark, *(json.dumps(c) for c, _ in cases)) == [sorted(w) for _, w in cases]


def test_texts_that_are_no_json(spark):
    assert faults(spark, None, "", "{", '{"id":"a","id":"a"}', "NaN") == [[("$", "invalid")]] * 5


def test_a_text_is_parsed_once_and_an_object_taken_apart_once(spark):
    rows = spark.createDataFrame([(1, "a", "{}")], "n int, id string, text string")
    plan = checked(rows, ["n"], "text", reply())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1 and plan.count("MapType(StringType,VariantType") == 2  # the reply, its parts


def test_faults_in_arrays_of_arrays_and_in_objects_of_objects(spark):
    inner = Rule("object", {"v": Rule("number", most=3)}, unique=None)
    rule = Rule("object", {"rows": Rule("array", items=Rule("array", items=inner, most=2)), "at": Rule("object", {"x": Rule("flag")})}, {"tags": Rule("array", items=Rule("text", least=1), least=1)})
    texts = ['{"rows":[[{"v":1},{"v":9}],[],[7,{},null]],"at":{"x":true}}', '{"rows":[5],"at":{"x":1,"y":2},"tags":["a"," "]}', '{"rows":[],"at":null,"tags":[]}', '{"rows":[],"at":{"x":false}}']
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    got = sorted((r["n"], r["path"], r["fault"]) for r in checked(rows, ["n"], "text", rule).collect())
    assert got == sorted([
        (0, "$.rows[0][1].v", "above"), (0, "$.rows[2]", "too_long"), (0, "$.rows[2][0]", "not_object"), (0, "$.rows[2][1].v", "missing"), (0, "$.rows[2][2]", "not_object"),
        (1, "$.rows[0]", "not_array"), (1, "$.at.x", "not_flag"), (1, "$.at.y", "unexpected"), (1, "$.tags[1]", "too_short"), (2, "$.at", "not_object"), (2, "$.tags", "too_short"),
    ])


def test_digests_do_not_depend_on_the_order_of_fields(spark):
    a = spark.createDataFrame([((1, ("x", None)), [(1, 2)])], "s struct<b:int,a:struct<d:string,c:string>>, l array<struct<q:int,p:int>>")
    b = spark.createDataFrame([([(2, 1)], ((None, "x"), 1))], "l array<struct<p:int,q:int>>, s struct<a:struct<c:string,d:string>,b:int>")
    digest = lambda df: df.select(canonical_digest(df, df.columns).alias("d")).first()["d"]
    assert digest(a) == digest(b)
    assert digest(a) != digest(a.withColumn("s", F.col("s").withField("b", F.lit(None).cast("int"))))


def test_a_change_shows_where_it_was_made(spark):
    parts = spark.createDataFrame([(p, f, k, p * 10 + f) for p in range(6) for f in range(2) for k in "ab"], "photo int, face int, part string, v int").withColumn("below", F.lit(None).cast("array<string>"))
    parts = parts.withColumn("digest", canonical_digest(parts, ["photo", "face", "part", "v", "below"]))

    def above(rows, key):
        rest = [c for c in ("photo", "face", "part") if c in rows.columns and c not in key]
        out = rows.groupBy(*key).agg(F.transform(F.sort_array(F.collect_list(F.struct(*rest, "digest"))), lambda s: s["digest"]).alias("below")).withColumn("w", F.lit(1))
        return out.withColumn("digest", canonical_digest(out, [*key, "w", "below"]))

    faces, parts = above(parts, ["photo", "face"]), parts.drop("below")
    photos, faces = above(faces, ["photo"]).drop("below"), faces.drop("below")
    parts = parts.withColumn("v", F.expr("if(photo = 1 and face = 0 and part = 'a', 99, v)")).withColumn("digest", F.expr("if(photo = 2 and face = 1 and part = 'b', 'x', digest)"))
    faces = faces.withColumn("w", F.expr("if(photo = 3 and face = 0, 2, w)")).where("photo <> 4")
    photos = photos.withColumn("digest", F.expr("if(photo = 5, null, digest)"))
    got = {(r["photo"], r["face"], r["part"]): r["status"] for r in rechecked([(photos, ["photo"], ["w"], "digest"), (faces, ["photo", "face"], ["w"], "digest"), (parts, ["photo", "face", "part"], ["v"], "digest")]).collect()}
    odd = {(1, 0, "a"): "2_changed", (2, 1, "a"): "1_changed", (2, 1, "b"): "1_changed", (3, 0, "a"): "1_changed", (3, 0, "b"): "1_changed"}
    want = {k: "ok" for k in got} | odd | {(4, f, k): "0_changed" for f in (0, 1) for k in "ab"} | {(5, f, k): "0_changed" for f in (0, 1) for k in "ab"}
    assert got == want and len(got) == 24


def test_confirmed_regions_take_their_evidence(spark):
    rng = random.Random(1)
    spots = [(x / 10, 0.1, 0.2, 0.3) for x in range(4)]
    regions, faces, bodies = [], [], []
    for p in range(200):
        regions += [(p, f"{k}{i}", k, s) for k in ("face", "body") for i, s in enumerate(spots) if rng.random() < 0.4]
        faces += [(p, rng.choice(spots), rng.choice([None, 0, 1, 2]), rng.choice(["clear", "severe", None]), rng.choice([None, "clear"])) for _ in range(rng.randrange(3))]
        bodies += [(p, rng.choice(spots), rng.choice([None, 1, 2]), rng.choice(["head", "near"]), rng.choice(["clear", "severe"])) for _ in range(rng.randrange(3))]
    want = []
    for p in range(200):
        fs, bs, used = [f for f in faces if f[0] == p], [b for b in bodies if b[0] == p], set()
        for _, r, _, s in (x for x in regions if x[0] == p and x[2] == "face"):
            mine = [f for f in fs if f[1] == s]
            face = mine[0] if len(mine) == 1 else None
            want.append((p, r, "face", (face[3] or "uncertain") if face else "uncertain", None if face else "several_records" if mine else "no_record"))
            who = face[2] if face else None
            tied = [b for b in bs if who and sum(f[2] == who for f in fs) == 1 and b[2] == who]
            if len(tied) == 1 and tied[0][3] == "head":
                used.add(tied[0][1])
                want.append((p, r, "body", tied[0][4], None))
            elif tied:
                want.append((p, r, "body", "uncertain", "association_unresolved"))
            else:
                own = face[4] if face else None
                want.append((p, r, "body", own or "unassessed", None if own else "body_missing"))
        for _, r, _, s in (x for x in regions if x[0] == p and x[2] == "body" and x[3] not in used):
            mine = [b for b in bs if b[1] == s]
            want += [(p, r, "body", mine[0][4] if len(mine) == 1 else "uncertain", None if len(mine) == 1 else "several_records" if mine else "no_record"), (p, r, "face", "unassessed", "face_missing")]
    box = "struct<x:double,y:double,w:double,h:double>"
    got = mapped_evidence(spark.createDataFrame(regions, f"photo int, region string, kind string, box {box}"), spark.createDataFrame(faces, f"photo int, box {box}, participant int, state string, body string"), spark.createDataFrame(bodies, f"photo int, box {box}, participant int, association string, state string"), "photo")
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want))
