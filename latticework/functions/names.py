"""Algebra of dotted identifiers `module.path:Scope.chain:local$N`, naming conventions and visibility, as column functions."""

from __future__ import annotations

from keyword import kwlist

from pyspark.sql import Column
from pyspark.sql import functions as F

from latticework.functions.glob import glob_to_regex

UNRESOLVED, BUILTINS = "<unresolved>.", "<builtins>."


def module_of(symbol: Column) -> Column:
    return F.substring_index(symbol, ":", 1)


def leaf_name(symbol: Column) -> Column:
    """The last name: behind the last dot, then behind the last colon; of an unresolved attribute, the attribute."""
    plain = F.substring_index(F.substring_index(symbol, ".", -1), ":", -1)
    return F.when(symbol.startswith(UNRESOLVED), F.substring(symbol, len(UNRESOLVED) + 1, 1 << 20)).otherwise(plain)


def strip_shadow(symbol: Column) -> Column:
    return F.regexp_replace(symbol, r"\$\d+$", "")


def shadow_suffix(symbol: Column) -> Column:
    return F.nullif(F.regexp_extract(symbol, r"\$(\d+)$", 1), F.lit("")).cast("int")


def is_builtin(symbol: Column) -> Column:
    return symbol.startswith(BUILTINS)


def is_unresolved_attribute(symbol: Column) -> Column:
    return symbol.startswith(UNRESOLVED)


def affects(symbol: Column, prefix: Column) -> Column:
    """The prefix itself, or something inside it: what follows begins with a dot or a colon."""
    follows = F.substr(symbol, F.length(prefix) + 1, F.lit(1))
    return (symbol == prefix) | (symbol.startswith(prefix) & follows.isin(".", ":"))


def visibility(name: Column) -> Column:
    """dunder, private, protected or public, by the underscores."""
    dunder = name.startswith("__") & name.endswith("__") & (F.length(name) > 4)
    return F.when(dunder, "dunder").when(name.startswith("__"), "private").when(name.startswith("_"), "protected").otherwise("public")


def module_path(path: Column) -> Column:
    """src/pkg/mod.py -> pkg.mod; a package's __init__.py is the package."""
    bare = F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"^(?:src|lib)/", "")
    return F.replace(F.regexp_replace(bare, r"(?:^|/)__init__$", ""), F.lit("/"), F.lit("."))


def snake_case(name: Column) -> Column:
    """Words apart by one underscore, also where there were several signs between them."""
    apart = F.regexp_replace(F.regexp_replace(name, r"([A-Z]+)([A-Z][a-z])", "$1_$2"), r"([a-z0-9])([A-Z])", "$1_$2")
    return F.lower(F.regexp_replace(apart, r"[-_\s#.]+", "_"))


def pascal_case(name: Column) -> Column:
    """Only the first letter of each part changes."""
    parts = F.filter(F.split(name, r"[_\-\s#.]+"), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substr(p, F.lit(2)))), "")


def conforms(name: Column, kind: Column) -> Column:
    """Classes are PascalCase, constants UPPER_CASE, the rest snake_case."""
    pattern = F.when(kind == "class", r"^[A-Z][A-Za-z0-9]*$").when(kind == "constant", r"^[A-Z][A-Z0-9_]*$").otherwise(r"^[a-z][a-z0-9_]*$")
    return F.regexp_like(name, pattern)


def bare_type(raw: Column) -> Column:
    """Optional[a.B] , Union[B, C], B | C and B[int] all give B."""
    inner = F.regexp_replace(F.trim(raw), r"^(?:typing\.)?(?:Optional|Union)\[(.*)\]$", "$1")
    first = F.regexp_extract(inner, r"^\s*([^\[,|\s]+)", 1)
    return F.substring_index(first, ".", -1)


def package_under(module: Column, root: Column) -> Column:
    """The first name below the root, NULL outside it or at it."""
    below = F.substr(module, F.length(root) + 2)
    return F.when(module.startswith(F.concat(root, F.lit("."))), F.substring_index(below, ".", 1))


def replace_leaf(symbol: Column, new: Column) -> Column:
    """The identifier with another last name; what is before it stays."""
    return F.concat(F.regexp_replace(symbol, r"[^.:]*$", ""), new)


def forward_names(annotation: Column) -> Column:
    """Names that stand inside quotes in an annotation, in order, each once."""
    quoted = F.regexp_extract_all(annotation, F.lit(r"""(["'])(.*?)\1"""), F.lit(2))
    return F.array_distinct(F.flatten(F.transform(quoted, lambda q: F.regexp_extract_all(q, F.lit(r"([A-Za-z_]\w*)"), F.lit(1)))))


def decorated_by(decorators: Column, *globs: str) -> Column:
    """Whether any decorator, whole or up to its bracket, matches any of the globs."""
    pattern = "|".join(f"(?:{glob_to_regex(g)})" for g in globs)
    return F.coalesce(F.exists(decorators, lambda d: d.rlike(pattern) | F.substring_index(d, "(", 1).rlike(pattern)), F.lit(False))


def is_identifier(name: Column) -> Column:
    """Whether Python takes it as a name: letters, digits and underscores, no digit first, no keyword."""
    return F.coalesce(name.rlike(r"^[\p{L}_][\p{L}\p{N}_]*$") & ~name.isin(*kwlist), F.lit(False))
