"""Triple patterns: select, where, optional groups, distinct, order, limit, offset."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Pattern = tuple[str, str, str]


@dataclass(frozen=True)
class Query:
    """A pattern query over ``triples(s, p, o)``; terms that start with ``?`` are variables.

    Patterns are joined on the variables they share, the rarest first, as counted
    in one pass (``counted``). Predicates named by ``single`` have one value a
    subject: patterns of one subject with such predicates are gathered by a single
    aggregation instead of a join each. Each call of ``optional`` adds a group that
    is there as a whole or not at all. Parts that share no variable combine freely:
    a part of which nothing is selected only has to be there, if rows are distinct.
    """

    variables: tuple[str, ...] = ()
    patterns: tuple[Pattern, ...] = ()
    optionals: tuple[tuple[Pattern, ...], ...] = ()
    singles: frozenset[str] = frozenset()
    only_distinct: bool = False
    orders: tuple[str, ...] = ()
    most: int | None = None
    skip: int = 0

    def find(self, *variables: str) -> Query:
        return replace(self, variables=variables)

    def where(self, *patterns: Pattern) -> Query:
        return replace(self, patterns=self.patterns + patterns)

    def optional(self, *patterns: Pattern) -> Query:
        return replace(self, optionals=(*self.optionals, patterns))

    def single(self, *predicates: str) -> Query:
        return replace(self, singles=self.singles | set(predicates))

    def distinct(self) -> Query:
        return replace(self, only_distinct=True)

    def order_by(self, *variables: str) -> Query:
        return replace(self, orders=variables)

    def limit(self, n: int) -> Query:
        return replace(self, most=n)

    def offset(self, n: int) -> Query:
        return replace(self, skip=n)

    def execute(self, triples: DataFrame, counted: bool = True) -> DataFrame:
        if not self.patterns:
            raise ValueError("a query needs a pattern")
        wanted = [v.lstrip("?") for v in self.variables]
        groups = (self.patterns, *self.optionals)
        later = {v for g in self.optionals for p in g for v in _variables(p)}
        sizes = _sizes(triples, [p for g in groups for p in g]) if counted else {}
        parts = self._parts(triples, self.patterns, sizes)
        out, needed = None, {*wanted, *later} if wanted else None
        for part in sorted(parts, key=lambda df: needed is not None and not needed & set(df.columns)):
            if out is not None and needed is not None and self.only_distinct and not needed & set(part.columns):
                part = part.limit(1).select(F.lit(1).alias("_there"))  # nothing of it is asked for: one row tells whether it is there
            # No shared variable is left between parts: their combinations are what the query asks for.
            out = part if out is None else out.crossJoin(part)
        for group in self.optionals:
            found = self._parts(triples, group, sizes)
            if len(found) > 1:
                raise ValueError(f"an optional group falls apart: {group}")
            shared = [c for c in found[0].columns if c in out.columns]
            if not shared:
                raise ValueError(f"an optional group shares no variable: {group}")
            out = out.join(found[0], shared, "left")
        out = out.select(*wanted) if wanted else out.drop("_there")
        out = out.distinct() if self.only_distinct else out
        out = out.orderBy(*(o.lstrip("?") for o in self.orders)) if self.orders else out
        out = out.offset(self.skip) if self.skip else out
        return out.limit(self.most) if self.most is not None else out

    def _parts(self, triples: DataFrame, patterns: tuple[Pattern, ...], sizes: dict[Pattern, int]) -> list[DataFrame]:
        """The joined patterns, one table for each set of patterns that hang together."""
        stars: dict[str, list[Pattern]] = {}
        for p in patterns:
            if p[0].startswith("?") and p[1] in self.singles and p[0] != p[2]:
                stars.setdefault(p[0], []).append(p)
        gathered = {p: s for s, ps in stars.items() if len(ps) > 1 and len({p[2] for p in ps if p[2].startswith("?")}) == sum(p[2].startswith("?") for p in ps) for p in ps}
        units: list[tuple[int, DataFrame]] = [(sizes.get(p, 0), _scan(triples, p)) for p in patterns if p not in gathered]
        for subject in dict.fromkeys(gathered.values()):
            mine = stars[subject]
            units.append((min(sizes.get(p, 0) for p in mine), _star(triples, mine)))
        units.sort(key=lambda u: u[0])
        parts = []
        while units:
            _, out = units.pop(0)
            while True:
                at = next((i for i, (_, rows) in enumerate(units) if set(rows.columns) & set(out.columns)), None)
                if at is None:
                    break
                _, rows = units.pop(at)
                out = out.join(rows, [c for c in rows.columns if c in out.columns])
            parts.append(out)
        return parts


def _variables(pattern: Pattern) -> list[str]:
    return [t[1:] for t in pattern if t.startswith("?")]


def _holds(pattern: Pattern) -> Column:
    """Whether a triple fits the constants of a pattern."""
    out = F.lit(True)
    for column, term in zip(("s", "p", "o"), pattern):
        if not term.startswith("?"):
            out = out & (F.col(column) == term)
    return out


def _sizes(triples: DataFrame, patterns: list[Pattern]) -> dict[Pattern, int]:
    """How many triples fit each pattern, in one pass; nothing is counted for a single pattern."""
    if len(patterns) < 2:
        return {}
    row = triples.agg(*(F.count_if(_holds(p)).alias(f"n{i}") for i, p in enumerate(patterns))).first()
    return dict(zip(patterns, row))


def _star(triples: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """Patterns of one subject whose predicates have one value each, by one aggregation."""
    rows = triples.where(F.col("p").isin(*{p[1] for p in patterns}))
    found = rows.groupBy("s").agg(*(F.max(F.when(_holds(p), F.col("o"))).alias(f"o{i}") for i, p in enumerate(patterns)))
    for i in range(len(patterns)):
        found = found.where(F.col(f"o{i}").isNotNull())
    return found.select(F.col("s").alias(patterns[0][0][1:]), *(F.col(f"o{i}").alias(p[2][1:]) for i, p in enumerate(patterns) if p[2].startswith("?")))


def _scan(triples: DataFrame, pattern: Pattern) -> DataFrame:
    rows, names = triples.where(_holds(pattern)), {}
    for column, term in zip(("s", "p", "o"), pattern):
        if term.startswith("?"):
            if term[1:] in names:
                rows = rows.where(F.col(column) == F.col(names[term[1:]]))
            else:
                names[term[1:]] = column
    return rows.select(*(F.col(c).alias(n) for n, c in names.items()))
