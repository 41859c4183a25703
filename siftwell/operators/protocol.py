"""Exact validation of replies, fault by fault, and evidence whose digests are made again along a chain."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

FAULTS = "array<struct<path:string,fault:string>>"


@dataclass(frozen=True)
class Rule:
    """What a value must be. kind: object, array, text, choice, flag, number, echo.

    fields and optional: an object's keys, all others are faults. items: an array's. least, most: of a text's length (trimmed), an array's size or a number. choices: of a text. whole: a number
    without fraction. unique: the key of an array's objects that must not repeat. same: the column that a value must repeat as text. checks: named conditions over an object's values, of a function that
    reads a key as a type; one that can't be told is no fault, as the fault behind it is told already.
    """

    kind: str
    fields: dict[str, Rule] = field(default_factory=dict)
    optional: dict[str, Rule] = field(default_factory=dict)
    items: Rule | None = None
    choices: Sequence[str] = ()
    least: float | None = None
    most: float | None = None
    whole: bool = False
    unique: str | None = None
    same: Column | None = None
    checks: dict[str, Callable[[Callable[[str, str], Column]], Column]] = field(default_factory=dict)


_NUMBERS = ("BIGINT", "DOUBLE", "FLOAT")
_TYPE = {"text": ("STRING",), "choice": ("STRING",), "flag": ("BOOLEAN",), "number": _NUMBERS, "echo": ("STRING", "BOOLEAN", *_NUMBERS)}


def _is(value: Column, kind: str) -> Column:
    """Whether a variant is a leaf of that kind."""
    type_ = F.schema_of_variant(value)
    found = type_.isin(*_TYPE[kind])
    return found | type_.startswith("DECIMAL") if kind in ("number", "echo") else found


def _join(parts: list[Column]) -> Column:
    none = F.array().cast(FAULTS)
    return F.concat(none, *(F.coalesce(p, none) for p in parts)) if parts else none


def _one(when: Column, name: str, at: Column) -> Column:
    return F.when(when, F.array(F.struct(at.alias("path"), F.lit(name).alias("fault"))))


class _Level:
    """The values of one depth of arrays: columns that are bound once a row, stage by stage, as what is bound later reads what was bound before."""

    def __init__(self, depth: int):
        self.name, self.stages, self.below, self.nodes = f"_l{depth}", {}, [], []

    def bind(self, stage: int, value: Column) -> Column:
        name = f"{self.name}_{sum(map(len, self.stages.values()))}"
        self.stages.setdefault(stage, {})[name] = value
        return F.col(name)

    def faults(self, value: Column, rule: Rule, path: Column, stage: int = 0) -> Column:
        """Those of a bound value that isn't null, in the order of the rule; an array's items become nodes of the level below."""
        bad = F.array(F.struct(path.alias("path"), F.lit(f"not_{rule.kind}").alias("fault"))).cast(FAULTS)
        if rule.kind in ("object", "array"):
            kind, parts = ("map<string,variant>", self._object) if rule.kind == "object" else ("array<variant>", self._array)
            found = self.bind(stage, F.try_variant_get(value, "$", kind))
            return F.when(found.isNull(), bad).otherwise(_join(parts(value, found, rule, path, stage + 1)))
        right: list[Column] = []
        if rule.kind == "number":
            number = self.bind(stage, F.try_variant_get(value, "$", "double"))
            right += [_one(number < rule.least, "below", path)] if rule.least is not None else []
            right += [_one(number > rule.most, "above", path)] if rule.most is not None else []
            right += [_one(number != F.floor(number), "not_whole", path)] if rule.whole else []
        elif rule.kind != "flag":
            text = self.bind(stage, F.try_variant_get(value, "$", "string"))
            right += [_one(F.length(F.trim(text)) < rule.least, "too_short", path)] if rule.least is not None else []
            right += [_one(F.length(F.trim(text)) > rule.most, "too_long", path)] if rule.most is not None else []
            right += [_one(~text.isin(*rule.choices), "not_one_of", path)] if rule.choices else []
            right += [_one(~text.eqNullSafe(rule.same.cast("string")), "differs", path)] if rule.same is not None else []
        return F.when(~self.bind(stage, _is(value, rule.kind)), bad).otherwise(_join(right))

    def _object(self, value: Column, found: Column, rule: Rule, path: Column, stage: int) -> list[Column]:
        out, held = [], []
        for key, of in {**rule.fields, **rule.optional}.items():
            at, child = F.concat(path, F.lit(f".{key}")), self.bind(stage, F.try_element_at(found, F.lit(key)))
            held.append(child.isNotNull().cast("int"))
            out += [_one(child.isNull(), "missing", at)] if key in rule.fields else []
            out.append(F.when(child.isNotNull(), self.faults(child, of, at, stage + 1)))
        keys = [*rule.fields, *rule.optional]
        extra = F.array_sort(F.filter(F.map_keys(found), lambda k: ~k.isin(*keys)))
        more = F.transform(extra, lambda k: F.struct(F.concat(path, F.lit("."), k).alias("path"), F.lit("unexpected").alias("fault")))
        out.append(F.when(F.size(found) > sum(held, F.lit(0)), more))
        read: dict[tuple[str, str], Column] = {}

        def get(key: str, type_: str) -> Column:
            if (key, type_) not in read:
                read[key, type_] = self.bind(stage, F.try_variant_get(value, f"$.{key}", type_))
            return read[key, type_]

        return out + [_one(~F.coalesce(check(get), F.lit(True)), name, path) for name, check in rule.checks.items()]

    def _array(self, value: Column, found: Column, rule: Rule, path: Column, stage: int) -> list[Column]:
        out = [_one(F.size(found) < rule.least, "too_short", path)] if rule.least is not None else []
        out += [_one(F.size(found) > rule.most, "too_long", path)] if rule.most is not None else []
        name = lambda i: F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
        if rule.items is not None:
            of = len(self.below)
            self.below.append(rule.items)
            self.nodes.append(F.transform(found, lambda v, i: F.struct(F.lit(of).alias("of"), name(i).alias("path"), v.alias("value"), F.lit(None).cast(FAULTS).alias("told"))))
        if rule.unique is not None:
            names = self.bind(stage, F.transform(found, lambda v: F.try_variant_get(v, f"$.{rule.unique}", "string")))
            spot = lambda i: F.struct(F.concat(name(i), F.lit(f".{rule.unique}")).alias("path"), F.lit("repeated").alias("fault"))
            again = F.array_compact(F.transform(names, lambda n, i: F.when(n.isNotNull() & F.array_contains(F.slice(names, F.lit(1), i), n), spot(i))))
            out.append(F.when(F.size(F.array_distinct(names)) < F.size(names), again))
        return out


def checked(rows: DataFrame, key: list[str], text: str, rule: Rule) -> DataFrame:
    """(key, path, fault): every fault of every reply's text, a row each and none stops the others; a reply without any has no row.

    Faults: not_<kind>, missing, unexpected, too_short, too_long, not_one_of, below, above, not_whole, differs, repeated, and the names of checks. A text that is no JSON is invalid, as is one in which a key
    stands twice in an object. A text is parsed once and an object taken apart once: an array's items become rows, so that each rule is columns over a row and not a function in a function.
    (explode_outer: for explode, Spark pushes a filter on the array's size down to the text, and makes all of it a second time.)
    """
    depth, rules = 0, [rule]
    nodes = rows.select("*", F.lit(0).alias("_of"), F.lit("$").alias("_path"), F.try_parse_json(F.col(text)).alias("_value"), F.lit(None).cast(FAULTS).alias("_told"))
    while rules:
        level = _Level(depth)
        of, path, value, told = (F.col(c) for c in ("_of", "_path", "_value", "_told"))
        invalid = F.array(F.struct(path.alias("path"), F.lit("invalid").alias("fault"))).cast(FAULTS)
        found = F.when(told.isNotNull(), told).when(value.isNull(), invalid)
        for i, r in enumerate(rules):
            mine = level.bind(0, F.when(of == i, value)) if len(rules) > 1 else value
            found = found.when(of == i, level.faults(mine, r, path, 1))
        for _, columns in sorted(level.stages.items()):
            nodes = nodes.select("*", *(c.alias(n) for n, c in columns.items()))
        kept = [c for c in rows.columns if c != text or c in key]
        if level.below:
            own = F.array(F.struct(F.lit(-1).alias("of"), path.alias("path"), F.lit(None).cast("variant").alias("value"), found.alias("told")))
            none = F.array().cast("array<struct<of:int,path:string,value:variant,told:" + FAULTS + ">>")
            nodes = nodes.select(*kept, F.concat(own, *(F.coalesce(n, none) for n in level.nodes)).alias("_a")).select(*kept, F.explode_outer("_a").alias("_n"))
            nodes = nodes.select(*kept, *(F.col(f"_n.{c}").alias(f"_{c}") for c in ("of", "path", "value", "told")))
        else:
            nodes = nodes.select(*key, found.alias("_f"))
        depth, rules = depth + 1, level.below
    return nodes.select(*key, F.explode_outer("_f").alias("_f")).where("_f is not null").select(*key, "_f.path", "_f.fault")


def canonical(value: Column, kind: DataType) -> Column:
    """value with the fields of all its structs in order of name, however deep, so that its JSON doesn't depend on how it was built."""
    if isinstance(kind, StructType):
        return F.when(value.isNotNull(), F.struct(*(canonical(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name))))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda v: canonical(v, kind.elementType))
    return value


def canonical_digest(rows: DataFrame, columns: list[str]) -> Column:
    """SHA-256 of the JSON of columns in order of name, nulls told; their structs in order of name too."""
    kinds = {c: rows.schema[c].dataType for c in columns}
    return F.sha2(F.to_json(F.struct(*(canonical(F.col(c), kinds[c]).alias(c) for c in sorted(columns))), {"ignoreNullFields": "false"}), 256)


def rechecked(levels: list[tuple[DataFrame, list[str], list[str], str]]) -> DataFrame:
    """(keys of the lowest level, status): evidence whose digests are made again from the lowest level up.

    levels, from the top down: (rows, key, fields, digest): a level's key begins with the key of the one above, its stored digest is of its own fields and, under `below`, of the stored digests of its rows below in
    order of key. status names, from the top, the first level whose digest is not what its fields and the digests below give (`<n>_changed`, n from 0), or a level without row
    (`<n>_missing`); else ok. A tampered row thus shows at its own level, and at the one above only if its stored digest was changed with it. Digests below a row are made part by part, as
    a list in one row: a photo's faces, a face's parts.
    """
    states: list[DataFrame] = []
    below = None
    for rows, key, fields, digest in reversed(levels):
        held = rows.withColumn("below", F.lit(None).cast("array<string>")) if below is None else rows.join(below, key, "left")
        made = canonical_digest(held, [*key, *fields, "below"])
        n = len(levels) - 1 - len(states)
        states.append(held.select(*key, F.coalesce(made == F.col(digest), F.lit(False)).alias(f"_ok{n}")))
        if n:
            above = levels[n - 1][1]
            rest = [c for c in key if c not in above]
            below = rows.groupBy(*above).agg(F.transform(F.sort_array(F.collect_list(F.struct(*rest, F.col(digest).alias("_d")))), lambda s: s["_d"]).alias("below"))
    states.reverse()
    out = states[-1]
    for n in range(len(states) - 2, -1, -1):
        out = out.join(states[n], levels[n][1], "left")
    status = F.lit("ok")
    for n in range(len(states) - 1, -1, -1):
        ok = F.col(f"_ok{n}")
        status = F.when(ok.isNull(), f"{n}_missing").when(~ok, f"{n}_changed").otherwise(status)
    return out.select(*levels[-1][1], status.alias("status"))


def mapped_evidence(regions: DataFrame, faces: DataFrame, bodies: DataFrame, photo: str, enabled: Column | None = None) -> DataFrame:
    """(photo, region, part, state, reason): what the confirmed regions (photo, region, kind, box) have as evidence in faces (photo, box, participant, state, body) and bodies (photo, box, participant, association, state).

    A region takes the one record of exactly its box. A face's body is the one that names its participant, if no other face does and it was tied by the head; a body named so is used up, and else the face's
    own measurement (the state `body`, null if none) counts while `enabled`; two bodies leave it unresolved. A body region that no face has used stands for itself, its face unassessed. Boxes are compared as
    they are printed with six decimals.
    """
    spot = lambda b: F.concat_ws(",", *(F.format_string("%.6f", F.col(b)[c].cast("double")) for c in "xywh"))
    f = faces.withColumn("_at", spot("box"))
    b = bodies.withColumn("_at", spot("box"))
    unique = faces.where(F.col("participant") > 0).groupBy(F.col(photo).alias("_p"), F.col("participant").alias("_who")).agg(F.count("*").alias("_n")).where("_n = 1").select("_p", "_who")
    tied = b.where(F.col("participant").isNotNull()).groupBy(F.col(photo).alias("_p"), F.col("participant").alias("_who")).agg(F.count("*").alias("_bodies"), F.first("association").alias("_how"), F.first("state").alias("_body_state"), F.first("_at").alias("_body_at"))
    known = tied.join(unique, ["_p", "_who"])
    single = f.groupBy(F.col(photo).alias("_fp"), F.col("_at").alias("_fat")).agg(F.count("*").alias("_faces"), F.first("participant").alias("_participant"), F.first("state").alias("_face_state"), F.first("body").alias("_own"))
    asked = regions.withColumn("_rat", spot("box"))
    chosen = asked.where("kind = 'face'").join(single, (F.col(photo) == F.col("_fp")) & (F.col("_rat") == F.col("_fat")), "left")
    one = F.coalesce(F.col("_faces") == 1, F.lit(False))
    chosen = chosen.withColumn("_who2", F.when(one, F.col("_participant"))).join(known, (F.col(photo) == F.col("_p")) & (F.col("_who2") == F.col("_who")), "left")
    on = F.lit(True) if enabled is None else enabled
    takes = F.coalesce((F.col("_bodies") == 1) & (F.col("_how") == "head"), F.lit(False))
    face_part = F.struct(F.lit("face").alias("part"), F.when(one, F.coalesce("_face_state", F.lit("uncertain"))).otherwise("uncertain").alias("state"), F.when(~one, F.when(F.col("_faces") > 1, "several_records").otherwise("no_record")).alias("reason"))
    body_state = F.when(takes, F.col("_body_state")).when(F.col("_bodies").isNotNull(), "uncertain").when(one & F.col("_own").isNotNull(), F.col("_own")).otherwise("unassessed")
    body_reason = F.when(takes, F.lit(None).cast("string")).when(F.col("_bodies").isNotNull(), "association_unresolved").when(one & F.col("_own").isNotNull(), F.lit(None).cast("string")).otherwise("body_missing")
    parts = F.when(on, F.array(face_part, F.struct(F.lit("body").alias("part"), body_state.alias("state"), body_reason.alias("reason")))).otherwise(F.array(face_part))
    people = chosen.select(photo, "region", F.explode(parts).alias("_x")).select(photo, "region", "_x.*")
    used = chosen.where(takes & on).select(F.col(photo).alias("_up"), F.col("_body_at").alias("_uat")).distinct()
    alone = asked.where("kind = 'body'").join(used, (F.col(photo) == F.col("_up")) & (F.col("_rat") == F.col("_uat")), "left_anti")
    record = b.groupBy(F.col(photo).alias("_bp"), F.col("_at").alias("_bat")).agg(F.count("*").alias("_records"), F.first("state").alias("_state"))
    mine = alone.join(record, (F.col(photo) == F.col("_bp")) & (F.col("_rat") == F.col("_bat")), "left")
    only = F.coalesce(F.col("_records") == 1, F.lit(False))
    body_part = F.struct(F.lit("body").alias("part"), F.when(only, F.coalesce("_state", F.lit("uncertain"))).otherwise("uncertain").alias("state"), F.when(~only, F.when(F.col("_records") > 1, "several_records").otherwise("no_record")).alias("reason"))
    no_face = F.struct(F.lit("face").alias("part"), F.lit("unassessed").alias("state"), F.lit("face_missing").alias("reason"))
    return people.unionByName(mine.select(photo, "region", F.explode(F.array(body_part, no_face)).alias("_x")).select(photo, "region", "_x.*"))
