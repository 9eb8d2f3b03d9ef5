"""The rule language: text to checked programs and strata. No Spark here."""

from .ast import Aggregate, Atom, Const, Constraint, Decl, Fact, Negated, Program, Rule, Var, Wildcard
from .errors import DatalogError
from .parser import merge, parse
from .stratify import stratify

__all__ = ["Aggregate", "Atom", "Const", "Constraint", "DatalogError", "Decl", "Fact", "Negated", "Program", "Rule", "Var", "Wildcard", "merge", "parse", "stratify"]
