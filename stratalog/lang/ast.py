"""Program trees."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Const:
    value: str | int


@dataclass(frozen=True)
class Wildcard:
    pass


Term = Var | Const | Wildcard


@dataclass(frozen=True)
class Decl:
    name: str
    columns: tuple[tuple[str, str], ...]  #: (name, ``symbol`` or ``number``)
    where: str = ""


@dataclass(frozen=True)
class Atom:
    rel: str
    terms: tuple[Term, ...]
    where: str = ""

    @property
    def vars(self) -> set[str]:
        return {t.name for t in self.terms if isinstance(t, Var)}


@dataclass(frozen=True)
class Negated:
    atom: Atom


@dataclass(frozen=True)
class Constraint:
    left: Term
    op: str  #: > < >= <= !=
    right: Term
    where: str = ""


@dataclass(frozen=True)
class Rule:
    head: Atom
    body: tuple[Atom | Negated | Constraint, ...]

    @property
    def positive(self) -> list[Atom]:
        return [x for x in self.body if isinstance(x, Atom)]

    @property
    def negative(self) -> list[Atom]:
        return [x.atom for x in self.body if isinstance(x, Negated)]

    @property
    def constraints(self) -> list[Constraint]:
        return [x for x in self.body if isinstance(x, Constraint)]


@dataclass(frozen=True)
class Fact:
    rel: str
    values: tuple[str | int, ...]
    where: str = ""


@dataclass(frozen=True)
class Aggregate:
    kind: str  #: count sum min max
    result: Decl
    source: Atom


@dataclass
class Program:
    decls: dict[str, Decl] = field(default_factory=dict)
    inputs: set[str] = field(default_factory=set)
    outputs: list[str] = field(default_factory=list)
    rules: list[Rule] = field(default_factory=list)
    facts: list[Fact] = field(default_factory=list)
    aggregates: list[Aggregate] = field(default_factory=list)
