"""From planned releases to Spark jobs: one fused aggregation for all that is asked of the same rows and keys."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import functions as F

from hushframe.operators.ranks import ask
from hushframe.plans.frame import Aggregate, Noisy
from hushframe.privacy import Ledger, PrivacyError

#: Combinations of declared keys that are released at once on the driver.
MAX_KEYS = 100_000


def dense_keys(frame) -> list[tuple]:
    """All combinations of the declared categories, whether they occur or not."""
    size = 1
    for k in frame.keys:
        size *= len(k.categories)
    if size > MAX_KEYS:
        raise PrivacyError(f"{size} partitions are more than the {MAX_KEYS} that one release may have")
    return list(product(*[k.categories for k in frame.keys]))


def _leaves(aggregates: Sequence[Aggregate]) -> list[Aggregate]:
    return [x for a in aggregates for x in (_leaves(a.parts) if a.parts else [a])]


class _Rows:
    """Aggregates of one row set and its keys, however their frames were derived: all their columns in one DataFrame, each frame's steps taken once."""

    def __init__(self, members: list[tuple[int, Aggregate]]):
        self.members, self.frame = members, members[0][1].frame
        ways = {tuple(map(id, a.frame.steps)): a.frame for _, a in members}
        df = self.frame.base
        if len(ways) == 1:
            for s in self.frame.steps:
                df = s.apply(df)
            self.mark = dict.fromkeys(ways, "")
        else:
            own = df.columns
            df = df.withColumns({f"__base_{c}": F.col(f"`{c}`") for c in own})
            self.mark = {way: f"__{i}_" for i, way in enumerate(ways)}
            for way, f in ways.items():
                for s in f.steps:
                    df = s.apply(df)
                names = {*own, *(n for s in f.steps for n in s.sets)} & set(df.columns)
                df = df.withColumns({self.mark[way] + n: F.col(f"`{n}`") for n in names}).withColumns({c: F.col(f"`__base_{c}`") for c in own})
        self.df, self.keys = df, [k.name for k in self.frame.keys]
        if self.keys:
            declared = F.lit(True)
            for k in self.frame.keys:  # an undeclared key must not show
                declared = declared & F.col(k.name).isin(list(k.categories))
            self.df = df.where(declared)
        self.every = dense_keys(self.frame)

    def column(self, a: Aggregate):
        mark = self.mark[tuple(map(id, a.frame.steps))]
        return lambda name: F.col(f"`{mark}{name}`")

    def fused(self, out: list[dict]) -> None:
        """One aggregation for all expressions."""
        exprs, at = [], {}
        for i, a in self.members:
            if made := a.exprs(self.column(a)):
                at[i] = (a, len(exprs), len(exprs) + len(made))
                exprs += made
        if not at:
            return
        named = [e.alias(f"a{k}") for k, e in enumerate(exprs)]
        rows = {tuple(r[k] for k in self.keys): r for r in self.df.groupBy(*self.keys).agg(*named).collect()} if self.keys else {(): self.df.agg(*named).first()}
        for i, (a, low, high) in at.items():
            for key in self.every:
                r = rows.get(key)
                out[i][key] = a.finish([None] * (high - low) if r is None else [r[f"a{k}"] for k in range(low, high)])

    def counted(self, out: list[dict]) -> None:
        """One aggregation for all counts of values: rows of each value (as text), by key and expression."""
        groups = [(i, a, g(self.column(a))) for i, a in self.members for g in a.grouped]
        if not groups:
            return
        pairs = [F.struct(F.lit(k).alias("i"), g.cast("string").alias("g")) for k, (_, _, g) in enumerate(groups)]
        one = self.df.select(*self.keys, (F.explode(F.array(*pairs)) if len(pairs) > 1 else pairs[0]).alias("v")).select(*self.keys, "v.i", "v.g")
        counts: dict[tuple, dict] = {}
        for r in one.groupBy(*self.keys, "i", "g").agg(F.count(F.lit(1)).alias("n")).collect():  # a row a key and declared value
            counts.setdefault((tuple(r[k] for k in self.keys), r["i"]), {})[r["g"]] = r["n"]
        of: dict[int, list[int]] = {}
        for k, (i, _, _) in enumerate(groups):
            of.setdefault(i, []).append(k)
        for i, ks in of.items():
            a = groups[ks[0]][1]
            for key in self.every:
                out[i][key] = a.finish([counts.get((key, k), {}) for k in ks])

    def ordered(self, out: list[dict]) -> None:
        """Shared rounds for all that is asked of sorted values."""
        columns: dict[tuple, int] = {}
        orders, whose = [], []
        for i, a in self.members:
            for o in a.orders:
                at = columns.setdefault((self.mark[tuple(map(id, a.frame.steps))] + o.column, o.bounds), len(columns))
                orders.append((at, o.ask))
                whose.append((i, a))
        if not orders:
            return
        found = ask(self.df, list(columns), self.keys, self.every, orders)
        of: dict[int, list[dict]] = {}
        for (i, _), values in zip(whose, found):
            of.setdefault(i, []).append(values)
        for i, a in dict(whose).items():
            for key in self.every:
                out[i][key] = a.finish([v[key] for v in of[i]])


def _row_set(a: Aggregate) -> tuple:
    """What aggregates that go in one job share."""
    f = a.frame
    keys = tuple(k.name for k in f.keys)
    own = id(f.df) if any(s.sets & set(keys) for s in f.steps) else 0
    return f.identity, id(f.base), keys, own


def evaluate(aggregates: Sequence[Aggregate]) -> list[dict[tuple, list]]:
    """The exact values of aggregates, by key. They stay on the driver; callers add noise."""
    leaves = _leaves(aggregates)
    out: list[dict] = [{} for _ in leaves]
    jobs: dict[tuple, list[tuple[int, Aggregate]]] = {}
    for i, a in enumerate(leaves):
        if a.direct is not None:
            out[i] = a.direct()
        else:
            jobs.setdefault(_row_set(a), []).append((i, a))
    for members in jobs.values():
        rows = _Rows(members)
        rows.fused(out)
        rows.counted(out)
        rows.ordered(out)
    done = iter(out)

    def put(a: Aggregate) -> dict[tuple, list]:
        return {(): a.finish([x for p in a.parts for x in put(p)[()]])} if a.parts else next(done)

    return [put(a) for a in aggregates]


def release(noisy: Sequence[Noisy], ledger: Ledger | None = None, submission: int = 0, name: str | None = None) -> list:
    """Draws each release once. Without keys: a value; with keys: a dict by key. The ledger is charged (under name, or each statistic's own) before anything runs."""
    if ledger is not None:
        ledger.spend_all([(name or x.name, x.charge[1], x.charge[0]) for x in noisy], submission)
    parts = [p for x in noisy for p in x.parts]
    exact = iter(evaluate([a for a, _ in parts]))
    out = []
    for x in noisy:
        values = [(next(exact), draw) for _, draw in x.parts]
        keys = list(values[0][0])
        done = {key: x.combine([draw(v[key]) for v, draw in values]) for key in keys}
        out.append(done[()] if keys == [()] else done)
    return out
