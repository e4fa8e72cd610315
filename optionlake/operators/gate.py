"""Contracts that hold a stage write: counters observed in the pass that writes the table.

A gate adds aggregates to the write (``DataFrame.observe``), so nothing is scanned or shuffled for
it. Row rules count violating rows. Equal coverage needs no grouping either: the keys of a member
(a model, say) are summed up as count, exclusive or and sum of a 64-bit hash. Members with the same
keys agree in all three whatever the order of rows; others differ but for a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from optionlake.operators.contracts import ContractError

_PARTS = ("rows", "xor", "sum")


@dataclass(frozen=True)
class KeySet:
    """The keys of the rows that meet ``member``; every row without one."""

    keys: tuple[str, ...]
    member: Column | None = None


@dataclass(frozen=True)
class Gate:
    """What a stage must meet before later stages read it.

    ``violations``: conditions no row may meet. ``key_sets``: summaries to take; those named in
    ``alike`` must be equal, and each of ``expected`` equal to the summary of an earlier stage.
    """

    stage: str
    violations: Mapping[str, Column] = field(default_factory=dict)
    key_sets: Mapping[str, KeySet] = field(default_factory=dict)
    alike: Sequence[str] = ()
    expected: Mapping[str, tuple] = field(default_factory=dict)

    def columns(self) -> list[Column]:
        found = [F.count_if(F.coalesce(c, F.lit(True))).alias(f"violation {k}")
                 for k, c in self.violations.items()]
        for name, keys in self.key_sets.items():
            value = F.xxhash64(*keys.keys)
            if keys.member is not None:
                value = F.when(keys.member, value)
            made = F.count(value), F.bit_xor(value), F.sum(value.cast("decimal(20,0)"))
            found += [c.alias(f"{part} {name}") for part, c in zip(_PARTS, made, strict=True)]
        return found

    def judge(self, found: Mapping[str, object]) -> None:
        """Raises with every broken contract; an empty table has no violations."""
        problems = [f"{k}: {n} rows" for k in self.violations
                    if (n := found.get(f"violation {k}") or 0)]
        sums = {k: summary(found, k) for k in self.key_sets}
        if len({sums[k] for k in self.alike}) > 1:
            problems.append("keys differ between " + ", ".join(
                f"{k} ({sums[k][0]} rows)" for k in self.alike))
        problems += [f"keys of {k} differ from the earlier stage: {sums[k][0]} rows, {want[0]} expected"
                     for k, want in self.expected.items() if sums[k] != want]
        if problems:
            raise ContractError(f"{self.stage}: " + "; ".join(problems))


def summary(found: Mapping[str, object], name: str) -> tuple:
    """The observed (rows, xor, sum) of a key set."""
    return tuple(int(found.get(f"{part} {name}") or 0) for part in _PARTS)
