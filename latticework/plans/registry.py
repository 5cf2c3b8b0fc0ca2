"""Traits, facts, named expressions and rules by name: what a rule may read beside a row's own fields."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from latticework.plans.errors import DerivedField, ReachRefused, TraitShadowed, UnknownExpression, UnknownFact, UnknownTrait
from latticework.plans.evidence import Expr
from latticework.plans.relation import EVIDENCE, PROJECT, Relation
from latticework.plans.rules import Rule

#: What a provider gives: a table of anchor, value, confidence, one row for each anchor.
Provider = Callable[[object], DataFrame]


@dataclass
class Registry:
    """Names are global to one registry. A provider of traits is replaced by a later one of the same owner, not by another's."""

    traits: dict[str, tuple[str, Provider]] = field(default_factory=dict)
    facts: dict[str, Callable[..., DataFrame]] = field(default_factory=dict)
    expressions: dict[str, Callable[[], Expr]] = field(default_factory=dict)
    rules: dict[str, Callable[[object], Rule]] = field(default_factory=dict)

    def register_trait(self, name: str, provider: Provider, owner: str = "user") -> None:
        if name in self.traits and self.traits[name][0] != owner:
            raise TraitShadowed(f"the trait {name!r} is {self.traits[name][0]}'s", trait=name)
        self.traits[name] = owner, provider

    def trait(self, name: str, relation: Callable[[object], Relation], e: Expr, owner: str = "expression") -> None:
        """An expression over a relation as a trait. It may read the rows' own fields only, not what was looked up elsewhere."""

        def provider(corpus) -> DataFrame:
            r = relation(corpus)
            if r.reach(e) == PROJECT:
                raise ReachRefused(f"the trait {name!r} reads more than its row's file", trait=name, reads=list(e.reads))
            r = r.with_field("_trait", e)
            return r.df.select(r.anchor[0], "_trait", EVIDENCE)

        self.register_trait(name, provider, owner)

    def with_trait(self, relation: Relation, name: str, corpus, as_: str | None = None, key: str | None = None) -> Relation:
        """Fields of a trait's value and confidence, about the row itself or about what another field names."""
        if name not in self.traits:
            raise UnknownTrait(f"no trait {name!r}; there are: {', '.join(sorted(self.traits))}", trait=name)
        out = self._looked_up(relation, as_ or name.replace("-", "_"), key, self.traits[name][1](corpus))
        return out

    def register_fact(self, name: str, compute: Callable[..., DataFrame]) -> None:
        self.facts[name] = compute

    def with_fact(self, relation: Relation, name: str, corpus, as_: str | None = None, key: str | None = None, **parameters) -> Relation:
        if name not in self.facts:
            raise UnknownFact(f"no fact {name!r}; there are: {', '.join(sorted(self.facts))}", fact=name)
        return self._looked_up(relation, as_ or name.replace("-", "_"), key, self.facts[name](corpus, **parameters))

    def fact_source(self, name: str, corpus, anchor: str, *fields: str, **parameters) -> Relation:
        """A relation of a fact's own rows: its fields and no others; nothing is followed from it."""
        if name not in self.facts:
            raise UnknownFact(f"no fact {name!r}; there are: {', '.join(sorted(self.facts))}", fact=name)
        return Relation.of(self.facts[name](corpus, **parameters).select(anchor, *(f for f in fields if f != anchor)), anchor)

    @staticmethod
    def _looked_up(relation: Relation, name: str, key: str | None, found: DataFrame) -> Relation:
        if name in relation.fields:
            raise DerivedField(f"the field {name!r} is there already", field=name)
        sure = found.columns[2] if len(found.columns) > 2 else None
        return relation.with_lookup(name, key or relation.anchor[0], found, sure)

    def expression(self, name: str) -> Expr:
        if name not in self.expressions:
            raise UnknownExpression(f"no expression {name!r}; there are: {', '.join(sorted(self.expressions))}", expression=name)
        return self.expressions[name]()

    def register_rule(self, name: str, build: Callable[[object], Rule]) -> None:
        self.rules[name] = build

    def findings(self, corpus, *names: str) -> DataFrame:
        """The findings of the rules of these names, of all without any, as one bag."""
        out = None
        for n in names or sorted(self.rules):
            if n not in self.rules:
                raise UnknownExpression(f"no rule {n!r}; there are: {', '.join(sorted(self.rules))}", rule=n)
            rows = self.rules[n](corpus).findings()
            out = rows if out is None else out.unionByName(rows)
        return out
