"""Shell globs as Java regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_column(pattern: Column) -> Column:
    """glob_to_regex for patterns that are a column: first the classes are set apart, then all other signs are read."""
    parts = F.regexp_extract_all(pattern, F.lit(r"(?s)(\[!?\]?[^\]]*\]|.)"), F.lit(1))

    def read(part: Column) -> Column:
        inside = F.substr(part, F.lit(2), F.length(part) - 2)
        negated = inside.startswith("!")
        body = F.regexp_replace(F.when(negated, F.substr(inside, F.lit(2))).otherwise(inside), r"([\\\[\^&])", r"\\$1")
        class_ = F.concat(F.when(negated, F.lit("[^")).otherwise(F.lit("[")), body, F.lit("]"))
        return F.when(part == "*", F.lit(".*")).when(part == "?", F.lit(".")).when(F.length(part) > 1, class_).otherwise(F.regexp_replace(part, r"([^A-Za-z0-9_\s])", r"\\$1"))

    return F.concat(F.lit(r"(?s)\A"), F.array_join(F.transform(parts, read), ""), F.lit(r"\z"))


def glob_to_regex(pattern: str) -> str:
    """The whole string must match: * any characters, ? one, [..] a class, [!..] its complement."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2 if pattern[i + 1 : i + 2] in ("!", "]") else i + 1) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("^", "\\^").replace("&", "\\&")
            out.append(f"[^{body[1:]}]" if body.startswith("!") else f"[{body}]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return r"(?s)\A" + "".join(out) + r"\z"
