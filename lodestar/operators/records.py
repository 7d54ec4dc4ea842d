"""Delimited text records against a schema: valid rows, and failures with the first broken field.

A schema becomes regular expressions. One anchored pattern accepts a whole valid row; only rows it refuses go through
the patterns of growing field prefixes, the first of which to fail names the broken field. All of it runs inside the
JVM. Quantifiers are possessive, so neither length nor the number of quotes costs backtracking or stack.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space other than the tab, and all white space (as in Unicode, with the ASCII separators).
BLANK = "\n-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACES = "\t" + BLANK

REASONS = ("empty", "quoting", "columns", "value")


@dataclass(frozen=True)
class Field:
    """A column of the record. `plain` matches its values when written without quotes, `quoted` what may stand
    between quotes, where a quote is written twice."""

    name: str
    plain: str
    quoted: str


def integer_at_most(limit: int) -> str:
    """A pattern for ASCII digits, with leading zeros or not, of a value from 0 to `limit`."""
    digits = str(limit)
    parts = [f"[0-9]{{1,{len(digits) - 1}}}"] if len(digits) > 1 else []
    for i, d in enumerate(digits):
        rest = len(digits) - i - 1
        if int(d) > 0:
            parts.append(f"{digits[:i]}[0-{int(d) - 1}]" + (f"[0-9]{{{rest}}}" if rest else ""))
    return f"0*(?:{'|'.join([*parts, digits])})"


def integer_field(name: str, limit: int) -> Field:
    return Field(name, integer_at_most(limit), integer_at_most(limit))


def text_field(name: str) -> Field:
    """Any text that is not blank."""
    bare = rf"[^\"{SPACES}][^\t]*+|[{BLANK}]++[^{SPACES}][^\t]*+"
    inner = rf"[{SPACES}]*+(?:[^\"{SPACES}]|\"\")[^\"]*+(?:\"\"[^\"]*+)*+"
    return Field(name, bare, inner)


#: Any field, whatever its value: quoted to its closing quote, or free of tabs and not beginning with a quote.
ANY_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^"\t][^\t]*+|)'


def field_pattern(field: Field) -> str:
    return rf'(?:"(?:{field.quoted})"|(?:{field.plain}))'


def row_pattern(fields: Sequence[Field]) -> str:
    """The whole valid row, anchored."""
    return r"(?s)\A" + r"\t".join(field_pattern(f) for f in fields) + r"\z"


def prefix_patterns(fields: Sequence[Field]) -> list[str]:
    """Pattern k accepts a row whose first k + 1 fields are valid, whatever follows."""
    return [r"(?s)\A" + r"\t".join(field_pattern(f) for f in fields[: k + 1]) + r"(?:\t|\z)" for k in range(len(fields))]


def remainder_patterns(fields: Sequence[Field], k: int) -> tuple[str, str]:
    """For rows whose first k fields are valid, and not the next: whether all that follows these is well quoted, and
    whether it makes up the number of fields."""
    head = r"\t".join(field_pattern(f) for f in fields[:k]) or ANY_FIELD
    return rf"(?s)\A{head}(?:\t{ANY_FIELD})*+\z", rf"(?s)\A{head}(?:\t{ANY_FIELD}){{{len(fields) - max(k, 1)}}}\z"


def _value(line: Column, k: int) -> Column:
    raw = F.regexp_extract(line, rf"(?s)\A(?:{ANY_FIELD}\t){{{k}}}({ANY_FIELD})(?:\t|\z)", 1)
    inner = F.regexp_replace(F.regexp_extract(raw, r'(?s)\A"(.*)"\z', 1), '""', '"')
    return F.when(raw.startswith('"'), inner).otherwise(raw)


def parse_records(df: DataFrame, line: str, fields: Sequence[Field]) -> DataFrame:
    """`df` with columns named as the fields, and `reason`, `broken_field`.

    Valid rows have their values (quotes removed, doubled quotes single again), null reason and null broken_field.
    Others have null values and the first reason that holds: `empty` (null or only white space), `quoting` (a quoted
    field is not closed or something other than a tab follows), `columns` (wrong number of fields), `value` (a
    field's value is not of its kind). broken_field is the name of the first field that is not valid where it should
    stand, or null if only surplus fields follow. Columns of `df` named as an output column are replaced. Repeated
    rows stay; an empty table gives an empty result.
    """
    text = F.col(line)
    checked = df.withColumn("_ok", F.coalesce(text.rlike(row_pattern(fields)), F.lit(False)))
    at = F.when(F.col("_ok"), F.lit(None).cast("int"))
    for k, pattern in enumerate(prefix_patterns(fields)):
        at = at.when(~F.coalesce(text.rlike(pattern), F.lit(False)), F.lit(k))
    checked = checked.withColumn("_at", F.when(~F.col("_ok"), F.coalesce(at, F.lit(len(fields)))))  # the first broken field
    reason = F.when(F.col("_ok"), F.lit(None).cast("string")).when(text.isNull() | text.rlike(rf"\A[{SPACES}]*+\z"), F.lit("empty"))
    for k in range(len(fields) + 1):  # only what stands from the broken field on is judged
        quoted, counted = remainder_patterns(fields, k)
        why = F.when(~text.rlike(quoted), F.lit("quoting")).when(~text.rlike(counted), F.lit("columns")).otherwise(F.lit("value"))
        reason = reason.when(F.col("_at") == k, why)
    names = F.array(*[F.lit(f.name) for f in fields])
    broken = F.when(F.col("_at") < len(fields), F.get(names, F.col("_at")))
    values = {f.name: F.when(F.col("_ok"), _value(text, k)) for k, f in enumerate(fields)}
    extra = {"reason": reason, "broken_field": broken}
    renamed = checked.withColumns({f"_new_{n}": c for n, c in (values | extra).items()})
    kept = [c for c in df.columns if c not in values | extra]
    return renamed.select(*kept, *[F.col(f"_new_{n}").alias(n) for n in values | extra])


#: The raw collection: pid and text.
COLLECTION = (integer_field("pid", 2147483647), text_field("text"))
