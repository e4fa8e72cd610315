"""Personal data by weak supervision, with DataFrame functions only.

Patterns propose spans: the base kinds (email, ip, card, phone: always reported) and further
kinds, which the method decides. Labelers of three sorts vote on each span for, against or not at
all: patterns of the value, gazetteers, and context before the span. Expectation-maximisation
over the counts of vote patterns (a table whose size is bounded by the number of labelers)
estimates how reliable each labeler is, and a logistic span classifier is trained on its
probabilities and compiled to one column expression. Spans it accepts are added where they
overlap no base span.

Positions are code points, ends exclusive. Null and empty texts have no spans. Repeated rows come
out repeated. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from optionlake.sources.stages import StageTables

BASE = ("email", "ip", "card", "phone")
# Possessive loops and look-behinds give the same leftmost matches as the plain forms, without
# deep recursion and without scanning a run again from each of its characters.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "secret": r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{24,}(?![A-Za-z0-9_])",
    "local_phone": r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9])",
    "number": r"(?<![0-9.+-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A cheap condition without which a text has no span of the kind.
HINTS = {"email": "@", "ip": "[0-9][.][0-9]", "card": "[0-9](?:[ -]?[0-9]){13}", "phone": "[+][0-9]",
         "secret": "[A-Za-z_][0-9]|[0-9][A-Za-z_]", "local_phone": "[0-9]{3}[.-][0-9]{4}",
         "number": "[0-9]-[0-9]{2}-[0-9]"}
KINDS = tuple(PATTERNS)
_DIGITS = "regexp_replace(value, '[^0-9]', '')"
_LUHN = (f"pmod(aggregate(sequence(1, length({_DIGITS})), 0, (s, i) -> s + if(i % 2 = 1, "
         f"cast(substring({_DIGITS}, -i, 1) as int), int(2 * cast(substring({_DIGITS}, -i, 1) as int)"
         f" / 10) + 2 * cast(substring({_DIGITS}, -i, 1) as int) % 10)), 10) = 0")
_OCTETS = r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:[.]|$)){4}$"
VALID = {
    "ip": f"value rlike r'{_OCTETS}'",
    "card": f"if(length({_DIGITS}) between 14 and 19, {_LUHN}, false)",
    "phone": f"length({_DIGITS}) between 10 and 15",
}
#: Votes in SQL over kind, value and before (the characters before the span): 1, -1 or 0.
LABELERS = {
    # patterns
    "form": "case when kind in ('email', 'phone', 'ip', 'card') then 1 "
            "when kind = 'secret' then if(value rlike '[0-9]' and value rlike '[A-Za-z]', 1, -1) "
            "else 1 end",
    "spread": "case when kind = 'secret' then if(size(array_distinct(split(value, ''))) >= 10, 1, -1) "
              "when kind in ('number', 'local_phone', 'card', 'phone') then "
              "if(size(array_distinct(split(value, ''))) >= 5, 1, -1) else 0 end",
    "alphabet": "case when kind = 'secret' then if(value rlike '^[0-9a-f]+$|^[0-9A-F]+$|[a-z][A-Z0-9]', "
                "1, -1) else 0 end",
    # gazetteers
    "domains": "case when kind <> 'email' then 0 when lower(value) rlike "
               "'[.](com|org|net|edu|gov|io|de|fr|es|uk|info)$' then 1 else -1 end",
    "prefixes": "case when kind = 'card' then if(value rlike '^(4|5[1-5]|2[2-7]|3[47]|6)', 1, -1) "
                "when kind = 'phone' then if(value rlike '^[+](1|2[07]|3[0-9]|4[0-9]|5[0-9]|6|7|8|9)', "
                "1, -1) when kind = 'number' then if(value rlike '^(000|666|9)', -1, 1) else 0 end",
    "networks": "case when kind <> 'ip' then 0 when value rlike '^(0|127|255)[.]' then -1 else 1 end",
    # context
    "words": "case when lower(before) rlike "
             "'(mail|phone|tel|call|contact|card|visa|address|token|key|secret|password|ssn)' "
             "then 1 else 0 end",
    "assigned": "case when kind in ('secret', 'number') then if(before rlike '[=:][ ]*[\"\\']?$', 1, -1) "
                "else 0 end",
}


def _spans(kind: str) -> Column:
    """Array of (start, end, kind, value, before) of one kind: matches and what lies between."""
    pattern = F.lit(PATTERNS[kind])
    between = F.split("text", PATTERNS[kind], -1)
    parts = F.arrays_zip(F.regexp_extract_all("text", pattern, F.lit(0)).alias("m"), between.alias("g"))
    none = F.array().cast("array<struct<start:int,end:int,kind:string,value:string,before:string>>")

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["g"])
        end = start + F.length(part["m"])
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"),
                        part["m"].alias("value"), F.right(part["g"], F.lit(24)).alias("before"))
        return F.struct(F.coalesce(end, start).alias("at"),
                        F.when(part["m"].isNull(), state["out"])
                        .otherwise(F.concat(state["out"], F.array(span))).alias("out"))

    found = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("out")), step)["out"]
    return F.when(F.col("text").rlike(HINTS[kind]), found).otherwise(none)


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, start, end, kind, value, before) of all proposed spans, checks passed."""
    hint = F.lit(False)
    for kind in KINDS:
        hint = hint | F.col("text").rlike(HINTS[kind])
    rows = docs.filter(hint).select("doc_id", F.xxhash64("text").alias("text_key"), F.explode(
        F.concat(*(_spans(k) for k in KINDS))).alias("span")).select("doc_id", "text_key", "span.*")
    valid = F.lit(True)
    for kind, check in VALID.items():
        valid = F.when(F.col("kind") == kind, F.expr(check)).otherwise(valid)
    return rows.filter(valid).distinct()


def reliabilities(patterns: list[tuple], rounds: int = 50) -> tuple[list[float], list[list[dict]]]:
    """EM over (votes, count) patterns: P(personal) of each, and P(vote | truth) of each labeler."""
    m = len(patterns[0][0]) if patterns else 0
    p = [1 / (1 + math.exp(-sum(votes))) for votes, _ in patterns]
    rates: list[list[dict]] = []
    for _ in range(rounds):
        rates = []
        for truth in (0, 1):
            weight = [(x if truth else 1 - x) * n for x, (_, n) in zip(p, patterns, strict=True)]
            total = sum(weight)
            rates.append([{v: (sum(w for w, (votes, _) in zip(weight, patterns, strict=True)
                                   if votes[k] == v) + 1) / (total + 3)
                           for v in (-1, 0, 1)} for k in range(m)])
        n_all = sum(n for _, n in patterns)
        prior = (sum(x * n for x, (_, n) in zip(p, patterns, strict=True)) + 1) / (n_all + 2)
        p = []
        for votes, _ in patterns:
            log_odds = math.log(prior / (1 - prior)) + sum(
                math.log(rates[1][k][v] / rates[0][k][v]) for k, v in enumerate(votes))
            p.append(1 / (1 + math.exp(-max(-50.0, min(50.0, log_odds)))))
    return p, rates


def span_classifier(spark: SparkSession, voted: DataFrame) -> Column:
    """The probability that a span is personal, as an expression over kind and the votes."""
    names = list(LABELERS)
    table = voted.groupBy("kind", *names).agg(F.count("*").alias("n")).orderBy("kind", *names).collect()
    if not table:
        return F.lit(1.0)
    p, _ = reliabilities([(tuple(r[k] for k in names), r.n) for r in table])

    def features(row) -> list[float]:
        return [float(row.kind == k) for k in KINDS] + [float(row[k]) for k in names]

    rows = [(Vectors.dense(features(r)), label, r.n * weight) for r, x in zip(table, p, strict=True)
            for label, weight in ((1.0, x), (0.0, 1 - x)) if weight > 0]
    model = LogisticRegression(regParam=0.001, maxIter=40, weightCol="weight").fit(
        spark.createDataFrame(rows, ["features", "label", "weight"]).coalesce(1))
    weights = model.coefficients.toArray().tolist()
    total = F.lit(float(model.intercept))
    for kind, w in zip(KINDS, weights, strict=False):
        total = total + F.when(F.col("kind") == kind, w).otherwise(0.0)
    for name, w in zip(names, weights[len(KINDS):], strict=True):
        total = total + F.col(name) * F.lit(w)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def personal_data(spark: SparkSession, docs: DataFrame, accept: float = 0.5) -> DataFrame:
    """Per row: doc_id and spans, an array of (start, kind_order, kind, end, base, probability)."""
    stages = StageTables(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
    found = stages.get("candidates", lambda: candidates(rows))
    voted = found.select("doc_id", "text_key", "start", "end", "kind",
                         *(F.expr(v).alias(k) for k, v in LABELERS.items()))
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    is_base = F.col("kind").isin(*BASE)
    judged = voted.withColumn("probability", span_classifier(spark, voted)).filter(
        is_base | (F.col("probability") >= accept))
    spans = judged.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct(
        "start", order.alias("kind_order"), "kind", "end", is_base.alias("base"),
        "probability"))).alias("spans"))
    spans = spans.withColumn("spans", F.expr(
        "filter(spans, s -> s.base or not exists(spans, o -> o.base and o.start < s.end "
        "and s.start < o.end))"))
    keyed = rows.select("doc_id", F.xxhash64("text").alias("text_key"))
    same = keyed["doc_id"].eqNullSafe(spans["doc_id"]) & (keyed["text_key"] == spans["text_key"])
    empty = F.array().cast("array<struct<start:int,kind_order:int,kind:string,end:int,base:boolean,"
                           "probability:double>>")
    return keyed.join(spans, same, "left").select(
        keyed["doc_id"], F.coalesce("spans", empty).alias("spans"))
