"""Personal data by weak supervision, with DataFrame functions only.

Patterns propose spans. Four labelers vote for or against each: the base rule (or none), a gazetteer that the corpus itself
fills, the words before it, and its shape. Expectation-maximisation over the counts of vote patterns, a table of at most
4 x 81 rows, estimates how far to trust each labeler; the spans' posteriors then train a classifier over their features, which
decides on the spans that no base rule covers: written-out addresses and numbers, national forms. Base spans always stay.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, unwrapped, wrapped, written

KINDS = ("email", "ip", "card", "phone")
#: Base patterns. Possessive forms of the contract's, with the same leftmost matches: what follows a repeated class never
#: begins with one of its characters, and a match can only begin where such a run begins or the last match ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
_DIGIT = f"(?:{'|'.join(_WORDS)}|oh)"
_HOST = r"[A-Za-z0-9-]{1,63}"
#: What the method may add, as (kind, pattern): addresses written out, IPv6, numbers in national form and in words.
WIDER = (
    ("email", rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}\x20?[(\[]at[)\]]\x20?{_HOST}(?:\x20?(?:\.|[(\[]dot[)\]])\x20?{_HOST}){{1,8}}"),
    ("email", rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]{{1,64}}(?:\x20dot\x20[A-Za-z0-9_%+-]{{1,64}}){{0,4}}\x20at\x20{_HOST}(?:\x20dot\x20{_HOST}){{1,8}}"),
    ("ip", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    ("phone", r"(?<![0-9+-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])"),
    ("phone", rf"(?<![A-Za-z])(?:{_DIGIT}[\x20-]){{6,14}}{_DIGIT}(?![A-Za-z-])"),
)
#: Cheap tests that a text with a match of a pattern passes.
HINT = {"email": "instr(text, '@') > 0", "ip": r"text rlike '[0-9]\\.[0-9]'", "card": "text rlike '[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]'", "phone": "instr(text, '+') > 0"}
WIDER_HINT = (r"instr(text, 'at)') > 0 or instr(text, 'at]') > 0", "instr(text, ' dot ') > 0", "text rlike '[0-9A-Fa-f]:[0-9A-Fa-f]'", r"text rlike '[0-9][ .-][0-9]{3}[ .-][0-9]{4}'", rf"text rlike '[ -]{_DIGIT}[ -]{_DIGIT}[ -]'")
#: Cues in the words before a span.
FOR = r"(?i)(mail|contact|write|tel|phone|call|fax|mobile|cell|card|visa|master|amex|credit|debit|payment|host|server|address|login|reach|\bip\b)"
AGAINST = r"(?i)(version|release|isbn|issn|doi|sku|serial|order|invoice|section|chapter|figure|table|part|item|\bv|\bno)[\x20.:#]*$"
LABELERS = ("v_rule", "v_gazetteer", "v_context", "v_shape")
#: Posterior that an added span needs, characters of context, rounds of estimation.
ACCEPT, CONTEXT, ROUNDS = 0.9, 24, 60
#: Features of its kind that a span has.
OWN = 6
#: Keys of the gazetteer at most (the best supported), different base spans that support a key at least.
GAZETTEER, SUPPORT = 1000, 2
_FAR = (1 << 31) - 1
SPAN = "array<struct<start: int, end: int, value: string, left: string, right: string>>"


def _bind(value: Column, f) -> Column:
    return F.element_at(F.transform(F.array(value), f), 1)


def _running(values: Column, f) -> Column:
    """values combined by f from the first up to each one, in steps that double their reach: work of n log n, whatever n."""
    back = lambda j: F.call_function("shiftleft", F.lit(1), j.cast("int"))
    step = lambda acc, j: F.transform(acc, lambda x, i: F.when(i < back(j), x).otherwise(f(x, F.get(acc, i - back(j)))))
    steps = F.sequence(F.lit(0), F.length(F.bin(F.size(values).cast("long"))))
    return F.when(F.size(values) < 2, values).otherwise(F.aggregate(steps, values, step))


def _matches(text: Column, pattern: str, hint: str) -> Column:
    """Leftmost matches with positions in code points, the text before each (back to the match before it) and the character after it."""

    def placed(both: Column) -> Column:
        m, gaps = both["m"], both["gaps"]
        ends = _running(F.zip_with(F.slice(gaps, 1, F.size(m)), m, lambda g, x: F.length(g) + F.length(x)), lambda x, y: x + y)
        one = lambda end: lambda x, i: F.struct((F.get(end, i) - F.length(x)).alias("start"), F.get(end, i).alias("end"), x.alias("value"), F.substring(F.get(gaps, i), -CONTEXT, CONTEXT).alias("left"), F.substring(F.get(gaps, i + 1), 1, 1).alias("right"))
        return _bind(ends, lambda end: F.transform(m, one(end)))

    found = _bind(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("gaps")), placed)
    return F.when(F.expr(hint), found).otherwise(F.expr(f"cast(array() as {SPAN})"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _spelled(value: Column) -> Column:
    """The digits of a number in words."""
    out = F.regexp_replace(value, "oh", "0")
    for d, word in enumerate(_WORDS):
        out = F.regexp_replace(out, word, str(d))
    return _digits(out)


def _luhn(digits: Column) -> Column:
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, twice(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


def _base_ok(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: _bind(F.regexp_replace(p, "^0+(?=.)", ""), lambda q: (F.length(q) <= 3) & (q.cast("int") <= 255)))
    if kind == "card":
        return _bind(_digits(value), lambda d: F.length(d).between(14, 19) & _luhn(F.substring(d, 1, 19)))
    return F.length(_digits(value)).between(10, 15)


def _key(kind: str, value: Column, digits: Column) -> Column:
    """What of a span the gazetteer lists: an address's ending, an IP's first part, a card's issuer, a number's area."""
    if kind == "email":
        return F.regexp_extract(F.lower(value), r"([a-z]+)$", 1)
    if kind == "ip":
        return F.regexp_extract(value, "^([0-9A-Fa-f]+)", 1)
    return F.substring(digits, 1, 2) if kind == "card" else F.substring(digits, -10, 3)


def _described(kind: int, rule: Column) -> Column:
    """From a match (a SPAN) to a span with its rule's vote (1 kept, -1 failed, 0 none), its key, its votes and its features."""

    def of(s: Column, d: Column) -> Column:
        value, name = s["value"], KINDS[kind]
        distinct = F.size(F.array_distinct(F.split(d, "")))
        if name == "email":
            shape = F.when(F.length(value) <= 64, 1).otherwise(-1)
        else:
            shape = F.when(distinct >= 4, 1).when(distinct <= 2, -1).otherwise(0)
        cue = F.when(s["left"].rlike(AGAINST), -1).when(s["left"].rlike(FOR), 1).otherwise(0)
        side = lambda x, at: F.when(x == "", 0).when(x.rlike(at % "[A-Za-z0-9_]"), 1).when(x.rlike(at % r"\s"), 2).otherwise(3)
        own = {"length": F.least(F.length(value), F.lit(40)), "digits": F.least(F.length(d), F.lit(20)), "distinct": F.least(distinct, F.lit(10)), "after": side(s["right"], "^%s"), "before": side(s["left"], "%s$"), "rule": rule}
        features = [F.concat(F.lit(f"{kind}:{f}:"), v.cast("string")) for f, v in own.items()] + [F.concat(F.lit("*:cue:"), cue.cast("string"))]
        return F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), (rule > 0).alias("base"), F.concat(F.lit(f"{kind}:"), _key(name, value, d)).alias("key"), F.xxhash64(value).alias("value"), rule.alias("rule"), cue.alias("cue"), shape.alias("shape"), F.array(*features).alias("features"))

    digits = lambda v: F.when(v.rlike("[a-z]"), _spelled(v)).otherwise(_digits(v)) if KINDS[kind] == "phone" else _digits(v)
    return lambda s: _bind(digits(s["value"]), lambda d: of(s, d))


def proposals(text: str = "text") -> Column:
    """All proposed spans of the column `text`, in order: base matches (base says whether their rule holds), and wider ones that meet no base span and no failed number.

    Whether a wider one meets one is told by the greatest end before it and the least start after it.
    """
    ruled = lambda kind, name: lambda s: _bind(F.when(_base_ok(name, s["value"]), 1).otherwise(-1), lambda r: _described(kind, r)(s))
    base = F.concat(*(F.transform(_matches(F.col(text), p, HINT[name]), ruled(k, name)) for k, (name, p) in enumerate(BASE.items())))
    wider = F.concat(*(F.transform(_matches(F.col(text), p, hint), _described(KINDS.index(name), F.lit(0))) for (name, p), hint in zip(WIDER, WIDER_HINT, strict=True)))

    def clear(order: Column) -> Column:
        taken = lambda s: (s["rule"] == 1) | ((s["rule"] == -1) & (s["kind"] == KINDS.index("phone")))
        upto = _running(F.transform(order, lambda s: F.when(taken(s), s["end"]).otherwise(0)), F.greatest)
        after = _running(F.reverse(F.transform(order, lambda s: F.when(taken(s), s["start"]).otherwise(_FAR))), F.least)
        free = lambda b: lambda s, i: (s["rule"] != 0) | ((F.coalesce(F.get(b["upto"], i - 1), F.lit(0)) <= s["start"]) & (F.coalesce(F.get(b["after"], F.size(order) - 2 - i), F.lit(_FAR)) >= s["end"]))
        return _bind(F.struct(upto.alias("upto"), after.alias("after")), lambda b: F.filter(order, free(b)))

    return _bind(F.struct(base.alias("b"), wider.alias("w")), lambda x: F.when(F.size(x["w"]) == 0, F.sort_array(x["b"])).otherwise(_bind(F.sort_array(F.concat(x["b"], x["w"])), clear)))


def proposed(docs: DataFrame, *carry: str) -> DataFrame:
    """carry columns and `spans`. Texts are read whole; a null one is empty."""
    return docs.select(*carry, F.coalesce("text", F.lit("")).alias("text")).withColumn("spans", proposals()).drop("text")


def gazetteer(found: DataFrame, most: int = GAZETTEER, support: int = SUPPORT) -> list[str]:
    """The keys that at least `support` different base spans of the corpus have; of more than `most` the best supported (equal ones: by name)."""
    spans = found.where(F.size("spans") > 0).select(F.explode("spans").alias("s")).where("s.base").select("s.key", "s.value").distinct()
    rows = spans.groupBy("key").count().where(F.col("count") >= support).orderBy(F.desc("count"), "key").limit(most).collect()
    return sorted(r.key for r in rows)


def judged(known: list[str], spans: Column) -> Column:
    """spans with `votes` (of LABELERS: 1, -1, or 0) and with the gazetteer's vote among their features."""
    listed = F.from_json(F.lit(json.dumps(known)), "array<string>")
    vote = lambda s: F.when(F.array_contains(listed, s["key"]), 1).otherwise(-1)
    return F.transform(spans, lambda s: _bind(vote(s), lambda v: s.withField("votes", F.array(s["rule"], v, s["cue"], s["shape"])).withField("features", F.concat(s["features"], F.array(F.concat(F.lit("*:known:"), v.cast("string")))))))


def reliabilities(patterns: list[tuple[int, tuple[int, ...], int]], rounds: int = ROUNDS) -> dict[tuple[int, tuple[int, ...]], float]:
    """Posterior of each (kind, votes) pattern from its counts, by expectation-maximisation.

    Each labeler has, for true and for false spans, a distribution over its two votes, and abstaining tells nothing; each kind
    has a prior. Starts from the share of votes in favour; counts are smoothed by one. No patterns: no posteriors.
    """
    post = {(k, v): (1 + sum(x > 0 for x in v)) / (2 + sum(x != 0 for x in v)) for k, v, _ in patterns}
    for _ in range(rounds):
        prior, table = {}, {}
        for kind in {k for k, _, _ in patterns}:
            own = [(post[k, v], n) for k, v, n in patterns if k == kind]
            prior[kind] = (1 + sum(p * n for p, n in own)) / (2 + sum(n for _, n in own))
        for j in range(len(LABELERS)):
            for y in (0, 1):
                weight = {x: 1.0 for x in (-1, 1)}
                for k, v, n in patterns:
                    if v[j]:
                        weight[v[j]] += n * (post[k, v] if y else 1 - post[k, v])
                total = sum(weight.values())
                table[j, y] = {x: w / total for x, w in weight.items()}
        for k, v, _ in patterns:
            logit = math.log(prior[k] / (1 - prior[k])) + sum(math.log(table[j, 1][x] / table[j, 0][x]) for j, x in enumerate(v) if x)
            post[k, v] = 1 / (1 + math.exp(-max(-30, min(30, logit))))
    return post


def train(found: DataFrame, known: list[str]) -> dict[str, float]:
    """Weights of the span classifier: the log odds of each kind ("0:"), and of each feature those that it adds to the odds of its kind (of all spans, for "*").

    The features of a kind describe one form and depend on each other, so they count as one: each by its share of OWN.
    The vote table (324 rows at most) and the feature table (a few hundred) are all that reaches the driver;
    both are summed on the executors first. No spans: no weights.
    """
    spans = found.where(F.size("spans") > 0).select(F.explode(judged(known, F.col("spans"))).alias("s")).select("s.*")
    counts = spans.groupBy("kind", "votes").count().collect()
    post = reliabilities(sorted((k, tuple(v), n) for k, v, n in counts))
    if not post:
        return {}
    name = F.concat_ws(":", F.col("kind").cast("string"), F.array_join(F.transform("votes", lambda x: x.cast("string")), ","))
    known_post = F.from_json(F.lit(json.dumps({f"{k}:{','.join(map(str, v))}": p for (k, v), p in post.items()})), "map<string,double>")
    rows = spans.withColumn("p", F.element_at(known_post, name)).select("p", F.explode(F.concat("features", F.array(F.concat(F.col("kind").cast("string"), F.lit(":")), F.lit("*:")))).alias("f"))
    sums = {f: (a, n) for f, a, n in rows.groupBy("f").agg(F.sum("p"), F.count("*")).collect()}
    odds = lambda f: math.log((sums[f][0] + 1) / (sums[f][1] - sums[f][0] + 1))
    return {f: odds(f) if len(f) == 2 else (odds(f) - odds(f[:2])) / (1 if f[0] == "*" else OWN) for f in sorted(sums) if f != "*:"}


def accepted(weights: dict[str, float], spans: Column, accept: float = ACCEPT) -> Column:
    """The judged spans that stay, in order: base ones, and those without a rule to which the classifier gives `accept` or more.

    A match that its base rule has failed (a number off its check digit) teaches, but never stays.
    """
    order = lambda kept: F.sort_array(F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["base"].alias("base"))))
    if not weights:
        return order(F.filter(spans, lambda s: s["base"]))
    known = F.from_json(F.lit(json.dumps(weights)), "map<string,double>")
    of = lambda f: F.coalesce(F.element_at(known, f), F.lit(0.0))
    score = lambda s: F.aggregate(s["features"], of(F.concat(s["kind"].cast("string"), F.lit(":"))), lambda a, f: a + of(f))
    return order(F.filter(spans, lambda s: s["base"] | ((s["rule"] == 0) & (score(s) >= math.log(accept / (1 - accept))))))


def settled(found: DataFrame, taught: DataFrame | None = None) -> DataFrame:
    """found (proposed(), written) with `spans` those that stay; the gazetteer and the classifier come from `taught`, or from found itself."""
    taught = found if taught is None else taught
    known = gazetteer(taught)
    return found.withColumn("spans", accepted(train(taught, known), judged(known, F.col("spans"))))


def _printed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def detect(docs: DataFrame) -> DataFrame:
    """The columns of op5 for docs (doc_id, text), a row per row; other columns are not read.

    A null or empty text has no spans. Long texts count whole, and work grows with n log n of their matches. Repeated rows stay, and equal texts get equal spans. Spans of one
    start come in the order of KINDS. No rows: no result.
    """
    got = settled(written(proposed(docs, "doc_id"), "pii"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long")
    return got.select("doc_id", *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)), F.sha2(_printed(base), 256).alias("base_sha256"), _printed(F.col("spans")).alias("spans"))


#: Spans of a text beyond which its pieces are cut from its characters as an array: Spark finds the nth character of a string by counting.
_MANY = 16


def cleaned(text: Column, spans: Column) -> Column:
    """text with every span's characters replaced by its kind in brackets; of overlapping spans the first names the whole."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def cut(x: Column) -> Column:
        s, upto = x["s"], x["upto"]  # upto: the end of all spans up to each
        opens = lambda i: (i == 0) | (F.get(s, i)["start"] >= F.coalesce(F.get(upto, i - 1), F.lit(0)))
        before = lambda i: F.coalesce(F.get(upto, i - 1), F.lit(0))
        whole = lambda piece: F.concat(F.array_join(F.transform(s, lambda y, i: F.when(opens(i), F.concat(piece(before(i), y["start"]), F.get(names, y["kind"]))).otherwise("")), ""), piece(F.element_at(upto, -1), F.length(text)))
        short = lambda a, b: F.substring(text, a + 1, b - a)
        long = lambda c: lambda a, b: F.array_join(F.slice(c, a + 1, F.greatest(b - a, F.lit(0))), "")
        return F.when(F.size(s) <= _MANY, whole(short)).otherwise(_bind(F.split(text, ""), lambda c: whole(long(c))))

    return F.when(F.size(spans) == 0, text).otherwise(_bind(F.struct(spans.alias("s"), _running(F.transform(spans, lambda y: y["end"]), F.greatest).alias("upto")), cut))


def redact(docs: DataFrame) -> DataFrame:
    """docs with the spans of every text replaced (cleaned()); n_chars, if there is one, follows.

    A null text stays null and texts without spans stay as they are; repeated rows stay, columns keep their names and
    order. Rows are written once with their proposals, and read again for the classifier and the result.
    """
    found = written(proposed(wrapped(docs).withColumn("text", F.col("row.text")), "row"), "pii")
    text = F.when(F.col("row.text").isNotNull(), cleaned(F.col("row.text"), F.col("spans")))
    return unwrapped(settled(found).withColumn("clean", text), docs.columns, text=F.col("clean"), n_chars=F.length("clean").cast("long"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with personal data replaced; no document goes."""
    return redact(docs)


def op5_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in the whole of `documents`: see detect()."""
    return detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
