"""Allow and deny rules over the columns of any table.

A rule reads `a & b || c`: clauses joined by `||`, terms joined by `&`. A term is
`field=value` or a bare alias that names one field only.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.session import bounded


TERM = re.compile(r"\s*(?P<sign>\|\||&)|\s*(?P<term>[^&|()!]+)")


@dataclass(frozen=True)
class Rule:
    """Alternative clauses, each a set of (field, value) equalities in field order."""

    clauses: tuple[tuple[tuple[str, object], ...], ...]

    @property
    def text(self) -> str:
        """The rule in canonical form."""
        return "||".join("&".join(str(value) for _, value in clause) for clause in self.clauses)

    @property
    def column(self) -> Column:
        """The rule as one predicate, so that it runs inside the scan's filter."""
        held = [reduce(and_, (F.col(f).eqNullSafe(F.lit(v)) for f, v in clause)) for clause in self.clauses]
        return reduce(or_, held)


def folded(value: object) -> str:
    """Spelling without case, blanks and signs."""
    return "".join(filter(str.isalnum, str(value).lower()))


class Vocabulary:
    """What rules may say: per field its values with aliases; percent fields take 0..100.

    All of it is one table of meanings: (field or None for a bare term, spelling) to the
    equalities it can stand for.
    """

    def __init__(self, values: Mapping[str, Mapping[object, Sequence[str]]], field_aliases: Mapping[str, str] | None = None,
                 percent_fields: Sequence[str] = ()):
        self.order = list(dict.fromkeys([*values, *percent_fields]))
        self.names = {folded(spelling): field for spelling, field in [*zip(self.order, self.order), *(field_aliases or {}).items()]}
        spelled = [(field, value, folded(s)) for field, known in values.items() for value, aliases in known.items() for s in (value, *aliases)]
        spelled += [(field, number, str(number)) for field in percent_fields for number in range(101)]
        self.meanings: dict[tuple[str | None, str], set[tuple[str, object]]] = defaultdict(set)
        for field, value, spelling in spelled:
            self.meanings[field, spelling].add((field, value))
            if field not in percent_fields:
                self.meanings[None, spelling].add((field, value))
        for number in range(101 if percent_fields else 0):  # a bare number is the first percentage
            self.meanings[None, str(number)] = {(percent_fields[0], number)}

    def term(self, text: str) -> tuple[str, object]:
        """Field and value of one term."""
        name, equals, spelling = text.rpartition("=")
        field = self.names.get(folded(name)) if equals else None
        if equals and field is None:
            raise ValueError(f"unknown field: {name.strip()!r}")
        found = self.meanings.get((field, folded(spelling)), set())
        if len(found) != 1:
            raise ValueError(f"{'ambiguous' if found else 'unknown'} term: {text!r}")
        return next(iter(found))

    def rule(self, text: str) -> Rule:
        """One rule from its text: terms and signs must alternate, and a clause must not contradict itself."""
        clauses: list[dict[str, object]] = [{}]
        at, before = 0, "sign"
        while at < len(text.rstrip()):
            found = TERM.match(text, at)
            kind = found.lastgroup if found else "nothing"
            if kind == before or kind == "nothing" or not found[kind].strip():
                raise ValueError(f"unsupported syntax at {text[at:]!r} in {text!r}")
            if found[kind] == "||":
                clauses.append({})
            elif kind == "term":
                field, value = self.term(found[kind].strip())
                if clauses[-1].setdefault(field, value) != value:
                    raise ValueError(f"contradictory {field} in {text!r}")
            at, before = found.end(), kind
        if before == "sign":
            raise ValueError(f"a term is missing at the end of {text!r}")
        return Rule(tuple(tuple(sorted(clause.items(), key=lambda item: self.order.index(item[0]))) for clause in clauses))


def _either(rules: Sequence[Rule]) -> Column:
    return reduce(or_, [r.column for r in rules])


def apply_rules(df: DataFrame, allow: Sequence[Rule] = (), deny: Sequence[Rule] = ()) -> DataFrame:
    """Rows some allow rule matches (all rows without one) and no deny rule matches."""
    kept = df.filter(_either(allow)) if allow else df
    return kept.filter(~_either(deny)) if deny else kept


def rule_matches(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows each rule matches, from one pass."""
    row = df.agg(*[F.count_if(r.column).alias(f"r{i}") for i, r in enumerate(rules)])
    entries = F.array(*[F.struct(F.lit(i + 1).alias("rule"), F.lit(r.text).alias("text"), F.col(f"r{i}").alias("matches"))
                        for i, r in enumerate(rules)])
    return row.select(F.explode(entries).alias("e")).select("e.*")


def rule_table(rules: Sequence[Rule], df: DataFrame) -> DataFrame:
    """Rules as rows (rule, clause, terms, field, value), for sets too large for one predicate."""
    rows = [(i + 1, j + 1, len(clause), f, str(v)) for i, r in enumerate(rules) for j, clause in enumerate(r.clauses) for f, v in clause]
    return df.sparkSession.createDataFrame(rows, "rule int, clause int, terms int, field string, value string")


def match_rule_table(df: DataFrame, key: str, fields: Sequence[str], rules: DataFrame) -> DataFrame:
    """(key, rule) pairs that match: a clause holds when all its terms do. `key` is unique.

    Terms meet rows by equality on (field, value); a rule set of checked size is broadcast.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("c")
    hits = df.select(key, cells).select(key, "c.field", "c.value").join(bounded(rules), ["field", "value"])
    full = hits.groupBy(key, "rule", "clause").agg(F.count(F.lit(1)).alias("met"), F.first("terms").alias("terms"))
    return full.filter("met = terms").select(key, "rule").distinct()
