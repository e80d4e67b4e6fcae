"""Private frames: a lazy DataFrame together with what is known, without looking at it, about its rows and columns."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame

from hushframe.privacy import EVERY, Charge, Definition, Path, PrivacyError, Usage, common, sequential

_identities = itertools.count(1)
_partitions = itertools.count(1)
KINDS = {"double": "float", "float": "float", "bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "string": "string", "boolean": "bool"}
TYPES = {"float": "double", "int": "long", "string": "string", "bool": "boolean"}


@dataclass(frozen=True)
class Props:
    """What is known of a column."""

    kind: str
    nullable: bool = True
    lower: float | None = None
    upper: float | None = None
    categories: tuple | None = None

    @property
    def bounds(self) -> tuple[float, float]:
        if self.lower is None or self.upper is None:
            raise PrivacyError("lower and upper must be known; clamp the column first")
        return self.lower, self.upper


@dataclass(frozen=True)
class Key:
    """A partition by a column's declared categories; columns of one partition share its number."""

    name: str
    categories: tuple
    partition: int = field(default_factory=lambda: next(_partitions))


@dataclass(frozen=True)
class Step:
    """How columns are made of those before, row by row, and which of them it sets."""

    apply: Callable[[DataFrame], DataFrame]
    sets: frozenset[str]


@dataclass(frozen=True)
class PrivateFrame:
    """Rows nobody may look at. Every operation that changes the rows mints a new identity; only frames of one identity are aligned."""

    df: DataFrame = field(repr=False)
    props: dict[str, Props]
    definition: Definition = Definition()
    n: int | None = None
    stability: int = 1
    sample: float = 1.0
    not_empty: bool = True
    keys: tuple[Key, ...] = ()
    identity: int = field(default_factory=lambda: next(_identities))
    public: bool = False
    rows: DataFrame | None = field(default=None, repr=False)  # what df was derived from, row by row; none: df itself
    steps: tuple[Step, ...] = field(default=(), repr=False)  # from there to df
    path: Path = ()  # of which parts of the data the rows are

    @property
    def reach(self) -> Path:
        """Where a release is paid: at each of the frame's parts."""
        return self.path + tuple((p, EVERY) for p in dict.fromkeys(k.partition for k in self.keys))

    @property
    def base(self) -> DataFrame:
        return self.df if self.rows is None else self.rows

    def __getattr__(self, name: str) -> Callable:
        from hushframe.plans.registry import OPERATORS

        if name.startswith("_") or name not in OPERATORS:
            raise AttributeError(name)
        return lambda *a, **k: OPERATORS[name](self, *a, **k)

    def same_rows(self, df: DataFrame, props: dict[str, Props]) -> PrivateFrame:
        """A choice among the frame's columns."""
        return replace(self, df=df, props=props, rows=self.base)

    def derive(self, exprs: dict[str, Column], props: dict[str, Props]) -> PrivateFrame:
        """The frame with columns that are made of its own, row by row."""
        return replace(self, df=self.df.withColumns(exprs), props=props, rows=self.base, steps=(*self.steps, Step(lambda df: df.withColumns(exprs), frozenset(exprs))))

    def new_rows(self, df: DataFrame, **changes) -> PrivateFrame:
        return replace(self, df=df, identity=next(_identities), rows=None, steps=(), **changes)

    def of(self, name: str) -> Props:
        if name not in self.props:
            raise PrivacyError(f"there is no column {name}")
        return self.props[name]

    def numeric(self, names: Sequence[str], what: str, null: bool = False, empty: bool = True) -> list[Props]:
        """The properties of columns that an aggregate needs: numbers, without nulls, not empty."""
        out = [self.of(n) for n in names]
        for n, p in zip(names, out):
            if p.kind not in ("float", "int"):
                raise PrivacyError(f"{what}: {n} is not numeric")
            if p.nullable and not null:
                raise PrivacyError(f"{what}: {n} may contain missing values; impute it first")
        if not empty and not self.not_empty:
            raise PrivacyError(f"{what}: the data may be empty; resize it first")
        return out


@dataclass(frozen=True)
class Order:
    """What is asked of a column's sorted values: a generator gets the first cells of values that aren't missing, asks for cells to be narrowed, and returns."""

    column: str
    bounds: tuple[float, float] | None
    ask: Callable[[list], object] = field(repr=False)
    exact: bool = True  # whether it needs cells that begin and end at values


@dataclass(frozen=True)
class Aggregate:
    """Exact statistics that are not yet private: expressions for one fused aggregation, and what they prove.

    Most are expressions (a function of how a column is named). Others are orders (see Order), counts of the values of an
    expression (grouped), parts (aggregates of several row sets, one after the other), or run by themselves (direct).
    """

    frame: PrivateFrame = field(repr=False)
    name: str
    exprs: Callable[[Callable[[str], Column]], list[Column]] = field(repr=False)
    finish: Callable[[list], list] = field(repr=False)
    sensitivity: Callable[[int], list[float]] = field(repr=False)  # by norm
    kind: str = "float"
    lower: list[float | None] | None = None
    upper: list[float | None] | None = None
    direct: Callable[[], dict] | None = field(default=None, repr=False)
    columns: tuple[str, ...] = ()
    candidates: tuple | None = None
    orders: tuple[Order, ...] = field(default=(), repr=False)
    grouped: tuple[Callable[[Callable[[str], Column]], Column], ...] = field(default=(), repr=False)
    parts: tuple[Aggregate, ...] = field(default=(), repr=False)
    joint: bool = False  # whether a sensitivity is that of all values together

    @property
    def n(self) -> int | None:
        return self.frame.n

    @property
    def width(self) -> int:
        return len(self.lower or self.columns)

    def multiply(self, by: float | Sequence[float]) -> Aggregate:
        from hushframe.operators.affine import scaled

        return scaled(self, by)

    def divide(self, by: float | Sequence[float]) -> Aggregate:
        return self.multiply([1 / b for b in by] if isinstance(by, (list, tuple)) else 1 / by)

    def negative(self) -> Aggregate:
        return self.multiply(-1)

    def add(self, by: float | Sequence[float]) -> Aggregate:
        from hushframe.operators.affine import shifted

        return shifted(self, by)

    def subtract(self, by: float | Sequence[float]) -> Aggregate:
        return self.add([-b for b in by] if isinstance(by, (list, tuple)) else -by)

    def mix(self, rows: Sequence[Sequence[float]]) -> Aggregate:
        from hushframe.operators.affine import mixed

        return mixed(self, rows)


@dataclass
class Noisy:
    """A planned release: exact statistics, the noise for each, and how results are put together afterwards."""

    name: str
    parts: list[tuple[Aggregate, Callable[[list], list]]]
    usages: list[Usage]
    combine: Callable[[list], object] = lambda values: values[0]
    mechanism: str = ""
    arguments: dict = field(default_factory=dict)

    @property
    def frame(self) -> PrivateFrame:
        return self.parts[0][0].frame

    @property
    def usage(self) -> Usage:
        """What an individual pays; parts of a partition are paid in parallel, by declaration once."""
        return sequential(self.usages)

    @property
    def charge(self) -> Charge:
        """What is paid, and by whom: individuals of the rows that all of it reads."""
        return common(a.frame.reach for a, _ in self.parts), self.usage
