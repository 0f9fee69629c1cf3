"""Attribute scalars: an equality token and a printed text.

Values compare as dynamically typed scalars do: True equals 1 and 1.0, no number equals a string,
and a missing value equals a null one. ``n:1`` is the token of True, 1 and 1.0, ``s:open`` that of
the string open, NULL that of null. Booleans print as True and False.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bool_token(c: Column) -> Column:
    return F.when(c, "n:1").when(~c, "n:0")


def bool_text(c: Column) -> Column:
    return F.when(c, "True").when(~c, "False")


def string_token(c: Column) -> Column:
    return F.concat(F.lit("s:"), c)


def number_text(c: Column) -> Column:
    """A number as text, whole numbers without a decimal point."""
    return F.when(c == F.floor(c), c.cast("long").cast("string")).otherwise(c.cast("string"))


def literal_token(value: str | float | bool | None) -> str | None:
    """The token of a Python scalar."""
    if value is None:
        return None
    if isinstance(value, str):
        return f"s:{value}"
    number = float(value)
    return f"n:{int(number)}" if number == int(number) else f"n:{number!r}"


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.transform(F.array(x), f)[0]


def literal(c: Column) -> Column:
    """A struct (token, text, error) of a scalar written as text.

    true, false and null in any case, JSON numbers and quoted strings are what they say; open, closed
    and anything else are strings as they stand. A JSON array or object is an error.
    """
    return let(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), lambda x: let(F.lower(x), lambda low: _literal(x, low)))


def _literal(x: Column, low: Column) -> Column:
    number = F.when(x.rlike(r"^-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?$"), x.try_cast("double"))
    quoted = F.when(x.rlike(r'^".*"$'), F.get_json_object(F.concat(F.lit('{"v":'), x, F.lit("}")), "$.v"))
    word = F.when(low.isin("open", "closed"), low).otherwise(F.coalesce(quoted, x))
    truth = F.when(low == "true", 1).when(low == "false", 0)

    def read(n: Column) -> Column:
        whole = n == F.floor(n)
        digits = F.when(whole, n.cast("long").cast("string")).otherwise(n.cast("string"))
        token = F.when(truth.isNotNull(), F.concat(F.lit("n:"), truth.cast("string"))).when(n.isNotNull(), F.concat(F.lit("n:"), digits)).otherwise(F.concat(F.lit("s:"), word))
        printed = F.when(truth == 1, "True").when(truth == 0, "False").when(n.isNotNull(), F.when(x.rlike(r"^-?\d+$"), x).when(whole, F.concat(digits, F.lit(".0"))).otherwise(digits)).otherwise(word)
        container = x.rlike(r"^[\[{]") & F.try_parse_json(x).isNotNull()
        nothing = container | (low == "null")
        return F.struct(
            F.when(~nothing, token).alias("token"),
            F.when(low == "null", "None").when(~container, printed).alias("text"),
            F.when(container, "container").alias("error"),
        )

    return let(number, read)
