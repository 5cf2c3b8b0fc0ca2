"""What can be wrong with a query before any row is read, and with the search for one thing. Each has a code."""

from __future__ import annotations


class AuthoringError(ValueError):
    """A query that can't be right whatever the rows are."""

    code = "dsl-error"

    def __init__(self, message: str, **details) -> None:
        super().__init__(message)
        self.details = details

    def as_fields(self) -> dict:
        return {"code": self.code, "message": str(self), **self.details}


class UnknownField(AuthoringError):
    code = "unknown-field"


class UnknownTrait(AuthoringError):
    code = "unknown-trait"


class UnknownFact(AuthoringError):
    code = "unknown-fact"


class DerivedField(AuthoringError):
    code = "derived-field"


class UnknownUniverse(AuthoringError):
    code = "unknown-universe"


class UnknownFollow(AuthoringError):
    code = "unknown-follow"


class UnknownExpression(AuthoringError):
    code = "unknown-expression"


class OpaquePredicate(AuthoringError):
    code = "opaque-predicate"


class ReachRefused(AuthoringError):
    code = "reach-refused"


class TraitShadowed(AuthoringError):
    code = "trait-shadowed"


class UnplannableMutation(AuthoringError):
    code = "unplannable-mutation"


class MutationPrecondition(AuthoringError):
    code = "mutation-precondition"


class AnchorError(AuthoringError):
    code = "anchor-error"


class UnresolvedAnchor(AnchorError):
    code = "unresolved-anchor"


class AmbiguousAnchor(AnchorError):
    code = "ambiguous-anchor"
