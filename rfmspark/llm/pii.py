"""Operator 2 [native]: personal data by rules plus weak supervision, in DataFrame expressions only.

Base spans (email, ip, card, phone) come from fixed patterns and checks. Beyond them, candidate
spans (mixed letter-digit tokens and grouped numbers that no base span touches) get votes from
labelers of three sorts: patterns on the span, a gazetteer of naming words before it, and its
context. Expectation-maximisation over the counts of vote patterns (at most 3^labelers rows)
estimates each labeler's reliabilities and the patterns' posteriors; with these as soft labels a
span classifier (one log-odds weight per feature value, counted over all candidates) is trained and
decides which candidates are added. Base spans always stay.

The patterns are written with possessive repeats and look-behinds so that each text is scanned in
linear time; they match what the plain patterns match. Offsets are code points, end exclusive.
Defined results: null and empty texts have no spans; very long texts are scanned whole; repeated
rows each get a result; without candidates nothing is added; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from rfmspark.llm.common import setup

# The base kinds in their order, then the added ones.
KINDS = ("email", "ip", "card", "phone", "secret", "number")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
IP_PARTS = r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})(?:\.|$)){4}$"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9](?:[\x20().-]*+[0-9]){8,14}+(?![\x20().-]*+[0-9])"
TOKEN = r"(?<![A-Za-z0-9_+/.-])(?=[A-Za-z_+/.-]*+[0-9])(?=[0-9_+/.-]*+[A-Za-z])[A-Za-z0-9_+/.-]{8,}+"
NUMBER = r"(?<![0-9])(?<![0-9][\x20().+-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{2,4}[\x20.-][0-9]{2,4}(?:[\x20.-][0-9]{2,4}){0,2}+(?![\x20.-]?[0-9])"
CONTEXT = 24
SECRET_WORDS = r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|api|key|auth|bearer|credential|login)\W{0,4}$"
PERSON_WORDS = r"(?i)\b(phone|tel|call|fax|mobile|cell|contact|account|iban|ssn|passport|licen[cs]e|id|no)\b\W{0,4}$"
SPAN = "array<struct<start:bigint,rank:int,kind:string,end:bigint,hit:string>>"
EM_ROUNDS = 50


def _found(text: Column, pattern: str, kind: str, hint: Column) -> Column:
    """Spans of all matches: the pieces between them and the matches, laid end to end."""
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    start = F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast(SPAN).alias("out"))

    def lay(acc, part):
        at = acc["pos"] + F.length(part["piece"])
        end = at + F.length(part["hit"])
        span = F.struct(at.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), part["hit"].alias("hit"))
        return F.when(part["hit"].isNull(), acc).otherwise(F.struct(end.alias("pos"), F.concat(acc["out"], F.array(span)).alias("out")))

    return F.when(hint, F.aggregate(parts, start, lay)["out"]).otherwise(F.array().cast(SPAN))


def _luhn(hit: Column) -> Column:
    digits = F.lpad(F.regexp_replace(hit, r"[\x20-]", ""), 19, "0")
    total = F.lit(0)
    for i in range(1, 20):  # the 19th is the check digit; every second from it counts double
        d = F.substring(digits, i, 1).cast("int")
        total = total + (d if i % 2 else 2 * d - F.when(d > 4, 9).otherwise(0))
    return total % 10 == 0


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` (text without nulls) with the arrays base and maybe (candidates clear of base spans)."""
    t = F.col("text")
    digit = t.rlike("[0-9]")
    base = docs.withColumns({
        "email": _found(t, EMAIL, "email", t.contains("@")), "ip": _found(t, IP, "ip", t.rlike(r"[0-9]\.[0-9]")),
        "card": _found(t, CARD, "card", digit), "phone": _found(t, PHONE, "phone", t.contains("+")),
        "token": _found(t, TOKEN, "secret", digit), "number": _found(t, NUMBER, "number", digit)})
    base = base.withColumns({"ip": F.filter("ip", lambda s: s["hit"].rlike(IP_PARTS)), "card": F.filter("card", lambda s: _luhn(s["hit"]))})
    base = base.withColumn("base", F.array_sort(F.concat("email", "ip", "card", "phone")))
    clear = F.filter(F.concat("token", "number"), lambda c: ~F.exists("base", lambda b: (c["start"] < b["end"]) & (b["start"] < c["end"])))
    return base.withColumn("maybe", F.array_sort(clear)).drop("token", "number")


def _examined(c: Column) -> Column:
    """A candidate with its labelers' votes (1 private, 0 not, - no opinion) and its features."""
    hit, before = c["hit"], F.substring(F.col("text"), F.greatest(c["start"] - CONTEXT + 1, F.lit(1)).cast("int"), F.least(c["start"], F.lit(CONTEXT)).cast("int"))
    n = F.length(hit)
    hexed, mixed = hit.rlike("^(?=.*[0-9])(?=.*[a-f])[0-9a-f]{16,}$"), hit.rlike("[0-9]") & hit.rlike("[a-z]") & hit.rlike("[A-Z]")
    vote = lambda yes, no: F.when(yes, "1").when(no, "0").otherwise("-")
    votes = [
        vote(hexed | hit.rlike("^AKIA[0-9A-Z]{16}$"), hit.rlike("^[A-Za-z]+[0-9]{1,4}$")),  # pattern of the span
        vote(before.rlike(SECRET_WORDS) | before.rlike(PERSON_WORDS), ~before.rlike(r"[=:\"']\s*$")),  # gazetteer before it
        vote(before.rlike(r"[=:]\s*[\"']?$"), before.rlike(r"[a-z,]\s$")),  # context: something is assigned
        vote((n >= 16) & hit.rlike("[0-9].*[A-Za-z].*[0-9]"), n < 12),  # length and mixture
        vote(hit.rlike(r"^\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}$"), hit.rlike(r"^[0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{1,4}$") | hit.rlike("[a-z]{4}")),
    ]
    traits = F.array(
        F.concat(F.lit("kind="), c["kind"]), F.concat(F.lit("size="), F.least(F.floor(n / 4), F.lit(12)).cast("string")),
        F.concat(F.lit("hex="), hexed.cast("string")), F.concat(F.lit("mixed="), mixed.cast("string")),
        F.concat(F.lit("upper="), hit.rlike("^[A-Z0-9]+$").cast("string")), F.concat(F.lit("named="), (before.rlike(SECRET_WORDS) | before.rlike(PERSON_WORDS)).cast("string")),
        F.concat(F.lit("sign="), F.regexp_extract(before, r"([=:\"'.,(]?)\s*$", 1)),
        F.concat(F.lit("digits="), F.least(F.floor(F.length(F.regexp_replace(hit, "[^0-9]", "")) * 5 / n), F.lit(5)).cast("string")))
    return F.struct(c["start"].alias("start"), c["rank"].alias("rank"), c["kind"].alias("kind"), c["end"].alias("end"), F.concat(*votes).alias("votes"), traits.alias("traits"))


def reliabilities(patterns: dict[str, int]) -> tuple[dict[str, float], list[tuple[float, float]]]:
    """Posterior of each vote pattern, and each labeler's (share of 1 among private, share of 1 among the rest), by EM."""
    if not patterns:
        return {}, []
    m, total = len(next(iter(patterns))), sum(patterns.values())
    post = {p: (p.count("1") + 0.5) / (p.count("1") + p.count("0") + 1.0) for p in patterns}  # majority to begin with
    rates: list[tuple[float, float]] = []
    for _ in range(EM_ROUNDS):
        prior = (sum(n * post[p] for p, n in patterns.items()) + 1) / (total + 2)
        rates = []
        for j in range(m):
            yes, no = [1.0, 1.0], [1.0, 1.0]  # smoothed counts of votes 0 and 1
            for p, n in patterns.items():
                if p[j] != "-":
                    yes[p[j] == "1"] += n * post[p]
                    no[p[j] == "1"] += n * (1 - post[p])
            rates.append((yes[1] / sum(yes), no[1] / sum(no)))
        for p in patterns:
            odds = math.log(prior / (1 - prior))
            for v, (a, b) in zip(p, rates):
                odds += math.log(a / b) if v == "1" else math.log((1 - a) / (1 - b)) if v == "0" else 0.0
            post[p] = 1 / (1 + math.exp(-max(-35.0, min(35.0, odds))))
    return post, rates


def _lookup(table: dict[str, float], key: Column, default: float) -> Column:
    if not table:
        return F.lit(default)
    return F.coalesce(F.create_map(*[F.lit(x) for kv in sorted(table.items()) for x in kv])[key], F.lit(default))


def train(found: DataFrame) -> tuple[dict[str, float], float]:
    """Log-odds weight of each feature value, and the prior's, from all candidates."""
    seen = found.select("text", F.explode("maybe").alias("c")).select(_examined(F.col("c")).alias("c")) \
        .groupBy("c.votes", "c.traits").agg(F.count(F.lit(1)).alias("n")).checkpoint()  # as many rows as there are combinations of fixed values
    patterns = {r["votes"]: r["n"] for r in seen.groupBy("votes").agg(F.sum("n").alias("n")).collect()}
    post, _ = reliabilities(patterns)
    soft = seen.withColumn("p", _lookup(post, F.col("votes"), 0.5))
    sums = soft.select(F.explode(F.concat("traits", F.array(F.lit("all")))).alias("trait"), "n", "p") \
        .groupBy("trait").agg(F.sum(F.col("n") * F.col("p")).alias("yes"), F.sum("n").alias("n")).collect()
    counts = {r["trait"]: (r["yes"], r["n"] - r["yes"]) for r in sums}
    yes, no = counts.pop("all", (0.0, 0.0))
    weights = {t: math.log((a + 0.5) / (yes + 1)) - math.log((b + 0.5) / (no + 1)) for t, (a, b) in counts.items()}
    return weights, math.log((yes + 1) / (no + 1))


def find(docs: DataFrame) -> DataFrame:
    """``docs`` with the arrays base and added, and the base arrays by kind; null texts become empty."""
    setup(docs.sparkSession)
    found = base_spans(docs.withColumn("text", F.coalesce("text", F.lit(""))))
    weights, prior = train(found)
    odds = lambda c: F.aggregate(F.transform(c["traits"], lambda t: _lookup(weights, t, 0.0)), F.lit(prior), lambda a, x: a + x)
    plain = lambda c: F.struct(*[c[k].alias(k) for k in ("start", "rank", "kind", "end")])
    judged = found.withColumn("seen", F.transform("maybe", _examined))
    return judged.withColumns({"base": F.transform("base", plain), "added": F.transform(F.filter("seen", lambda c: odds(c) > 0), plain)}).drop("seen", "maybe")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans, and all spans as text."""
    r = find(docs.select("doc_id", "text"))
    return r.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:4]], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
                    _joined(F.array_sort(F.concat("base", "added"))).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets (of overlapping spans the first); other columns stay."""
    r = find(docs.select(F.struct("*").alias("row"), "text"))  # the row apart, so that no column of it can clash
    spans = F.array_sort(F.concat("base", "added"))
    start = F.struct(F.lit(0).cast("long").alias("pos"), F.lit("").alias("out"))

    def lay(acc, s):
        gap = F.substring(F.col("text"), (acc["pos"] + 1).cast("int"), (s["start"] - acc["pos"]).cast("int"))
        return F.when(s["start"] < acc["pos"], F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), acc["out"].alias("out"))) \
            .otherwise(F.struct(s["end"].alias("pos"), F.concat(acc["out"], gap, F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("out")))

    done = F.aggregate(spans, start, lay)
    text = F.when(F.size(spans) == 0, F.col("text")).otherwise(F.concat(done["out"], F.substring(F.col("text"), (done["pos"] + 1).cast("int"), F.length("text"))))
    return r.withColumn("text", text).select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
