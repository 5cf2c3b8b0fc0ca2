"""Parameters that a docstring documents, in the sphinx, google or numpy style, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def style(docstring: Column) -> Column:
    """sphinx, google, numpy, or NULL for a docstring without parameters."""
    sphinx = docstring.rlike(r"(?m)^\s*:param\s")
    google = docstring.rlike(r"(?m)^\s*(?:Args|Arguments):\s*$")
    numpy = docstring.rlike(r"(?m)^\s*Parameters\s*\n\s*-{3,}\s*$")
    return F.when(sphinx, "sphinx").when(numpy, "numpy").when(google, "google")


def documented(docstring: Column) -> Column:
    """Names in order; a section ends at a blank line followed by a line that isn't indented, or at the next heading."""
    sphinx = F.regexp_extract_all(docstring, F.lit(r"(?m)^\s*:param\s+(?:[\w\[\], .]+\s)?\*{0,2}(\w+)\s*:"), F.lit(1))
    google_part = F.regexp_extract(docstring, r"(?ms)^\s*(?:Args|Arguments):\s*$\n(.*?)(?:^\s*(?:Returns|Return|Raises|Yields|Examples?|Notes?|Attributes):|\z)", 1)
    indent = F.regexp_extract(google_part, r"^([ \t]*)\S", 1)
    google = F.transform(
        F.filter(F.split(google_part, "\n"), lambda x: F.regexp_extract(x, r"^([ \t]*)\S", 1).eqNullSafe(indent) & x.rlike(r"^\s*\*{0,2}\w+\s*(?:\([^)]*\))?\s*:")),
        lambda x: F.regexp_extract(x, r"^\s*\*{0,2}(\w+)", 1),
    )
    numpy_part = F.regexp_extract(docstring, r"(?ms)^\s*Parameters\s*\n\s*-{3,}\s*\n(.*?)(?:^\s*\w+\s*\n\s*-{3,}|\z)", 1)
    edge = F.regexp_extract(numpy_part, r"^([ \t]*)\S", 1)
    numpy = F.transform(
        F.filter(F.split(numpy_part, "\n"), lambda x: F.regexp_extract(x, r"^([ \t]*)\S", 1).eqNullSafe(edge) & x.rlike(r"^\s*\*{0,2}\w+\s*(?::.*)?$")),
        lambda x: F.regexp_extract(x, r"^\s*\*{0,2}(\w+)", 1),
    )
    found = style(docstring)
    return F.when(found == "sphinx", sphinx).when(found == "google", google).when(found == "numpy", numpy).otherwise(F.array().cast("array<string>"))
