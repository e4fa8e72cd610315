"""Quality rules as a ledger: each rule is evaluated once, its failures are bits of one integer.

The ledger keeps the measurements and the failure bits of every document. A policy is a versioned
set of rules; it is applied to the bits, without another look at the texts. Ablations (how many
documents a rule alone rejects, or how many come back without it) are aggregates over the bits.

Null texts are empty: they have no words and fail the base. Repeated rows come out repeated.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from optionlake.llm.measures import COUNTS, with_measures


@dataclass(frozen=True)
class Rule:
    """``fails`` is a boolean SQL expression over the measurements."""

    name: str
    fails: str


#: The order gives the bits; new rules go to the end, so stored ledgers stay valid.
RULES: tuple[Rule, ...] = (
    Rule("too_few_words", "n_words < 20"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "n_dup_lines >= 2 AND 10 * n_dup_lines > 3 * n_lines"),
    Rule("word_length", "word_chars > 12 * n_words OR word_chars < 2 * n_words"),
    Rule("capitals", "2 * n_upper > n_upper + n_lower AND n_upper > 20"),
    Rule("few_distinct_words", "n_words >= 50 AND 10 * n_distinct_words < n_words"),
    Rule("digits", "3 * n_digits > word_chars"),
    Rule("marks", "5 * n_marks > n_words"),
)
BASE = ("too_few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]


POLICIES = {p.version: p for p in (
    Policy("1-base", BASE),
    Policy("2-full", tuple(r.name for r in RULES)),
)}


def bits_of(names: Sequence[str], rules: Sequence[Rule] = RULES) -> int:
    """The mask of the named rules."""
    at = {r.name: i for i, r in enumerate(rules)}
    return sum(1 << at[name] for name in set(names))


def ledger(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id, the measurements, and ``failures``: bit i is set if rule i fails."""
    if len(rules) > 62:
        raise ValueError("at most 62 rules fit the mask")
    measured = with_measures(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    failures: Column = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        failures = failures.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(F.lit(0))
                                      .cast("long"))
    return measured.select("doc_id", *COUNTS, failures.alias("failures"))


def apply_policy(rows: DataFrame, policy: Policy, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The ledger with ``kept``: no rule of the policy fails."""
    mask = F.lit(bits_of(policy.rules, rules)).cast("long")
    return rows.withColumn("policy", F.lit(policy.version)).withColumn(
        "kept", F.col("failures").bitwiseAND(mask) == 0)


def ablations(rows: DataFrame, policies: Mapping[str, Policy] = POLICIES,
              rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per policy and rule: documents it fails, those it alone rejects, those kept without it.

    The ledger is first counted by its distinct bit sets (at most 2**rules of them, in practice
    few), with partial sums before the shuffle; the policies then see only those counts.
    """
    sets = rows.groupBy("failures").agg(F.count("*").alias("n"))
    cases = [(p.version, bits_of(p.rules, rules), name, bits_of([name], rules))
             for p in policies.values() for name in p.rules]
    cases = F.explode(F.array(*(F.struct(
        F.lit(v).alias("policy"), F.lit(m).cast("long").alias("mask"), F.lit(name).alias("rule"),
        F.lit(bit).cast("long").alias("bit")) for v, m, name, bit in cases)))
    hit = F.col("failures").bitwiseAND(F.col("mask"))
    return sets.select("failures", "n", cases.alias("case")).select("failures", "n", "case.*").groupBy(
        "policy", "rule").agg(
            F.sum(F.when(hit.bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("failing"),
            F.sum(F.when(hit == F.col("bit"), F.col("n")).otherwise(0)).alias("rejected_alone"),
            F.sum(F.when((hit == 0) | (hit == F.col("bit")), F.col("n")).otherwise(0))
            .alias("kept_without"))


def judged(docs: DataFrame, policy: Policy = POLICIES["2-full"]) -> DataFrame:
    """The ledger under a policy, with the verdict of the base rules beside it."""
    base = F.lit(bits_of(BASE)).cast("long")
    rows = apply_policy(ledger(docs), policy).withColumn(
        "base_failed", F.col("failures").bitwiseAND(base) != 0)
    return rows.withColumn("kept", F.col("kept") & ~F.col("base_failed"))
