"""Scalars of JSON records: from a VARIANT, which keeps a value's type, to token and text, and back to JSON.

true, "true", 1 and 1.0 are four values. Tokens compare them as dynamic languages do (true, 1 and 1.0
are equal, see tokens), texts print them apart. A VARIANT holds 1 as an integer and 1.0 as a decimal.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tokens import let


def quoted(c: Column) -> Column:
    """A string as a JSON string."""
    listed = F.to_json(F.array(c))
    return F.when(c.isNull(), "null").otherwise(F.substring(listed, F.lit(2), F.length(listed) - 2))


def ascii_json(json: Column) -> Column:
    """JSON text with every character beyond ASCII as \\u and four digits, in two halves beyond the basic plane."""

    def escape(n: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n.cast("long"))), 4, "0"))

    def char(c: Column) -> Column:
        n = F.ascii(c)
        return F.when(n < 128, c).when(n < 0x10000, escape(n)).otherwise(F.concat(escape(F.shiftright(n - 0x10000, 10) + 0xD800), escape((n - 0x10000) % 1024 + 0xDC00)))

    return F.when(json.rlike(r"^[\x00-\x7f]*$"), json).otherwise(F.array_join(F.transform(F.split(json, ""), char), ""))


def float_text(c: Column) -> Column:
    """A double as the shortest text that reads back as it, with a point or an exponent of two digits or more; whole numbers end in .0."""

    def plain(x: Column) -> Column:
        digits = F.rtrim(x.try_cast("decimal(38,21)").cast("string"), F.lit("0"))
        return F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)

    def scientific(x: Column) -> Column:
        text = x.cast("string")
        power = F.substring_index(text, "E", -1).try_cast("int")
        mantissa = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", "")
        return F.concat(mantissa, F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), F.lit("0")))

    def text(x: Column) -> Column:
        size = F.abs(x)
        return (
            F.when(F.isnan(x), "nan").when(x == F.lit(float("inf")), "inf").when(x == F.lit(float("-inf")), "-inf")
            .when((size == 0) | ((size >= 1e-4) & (size < 1e16)), plain(x)).otherwise(scientific(x))
        )

    return let(c.cast("double"), text)


def scalar(v: Column) -> Column:
    """A struct (token, text) of a VARIANT; both null for null. An array or object has its JSON as text and a token of its own kind.

    A negative zero prints as 0.0.
    """

    def read(kind: Column) -> Column:
        # An integer beyond 64 bits is held as a decimal without places, as a float with whole value is within them.
        number = F.try_variant_get(v, "$", "decimal(38,0)")
        wide = kind.rlike(r"^DECIMAL\(\d+,0\)$") & (F.abs(number) > F.lit(2**63 - 1).cast("decimal(38,0)"))
        whole = (kind == "BIGINT") | wide
        real = F.try_variant_get(v, "$", "double")
        whole_real = (real == F.rint(real)) & (F.abs(real) < 1e38)
        digits = F.when(whole, number.cast("string")).when(whole_real, real.try_cast("decimal(38,0)").cast("string")).otherwise(float_text(real))
        truth = F.try_variant_get(v, "$", "boolean")
        string = F.try_variant_get(v, "$", "string")
        held = F.to_json(v)
        is_number = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
        token = (
            F.when(kind == "BOOLEAN", F.when(truth, "n:1").otherwise("n:0")).when(kind == "STRING", F.concat(F.lit("s:"), string))
            .when(is_number, F.concat(F.lit("n:"), digits)).when(kind != "VOID", F.concat(F.lit("j:"), held))
        )
        text = (
            F.when(kind == "BOOLEAN", F.when(truth, "True").otherwise("False")).when(kind == "STRING", string)
            .when(whole, digits).when(is_number, float_text(real)).when(kind != "VOID", held)
        )
        return F.named_struct(F.lit("token"), token, F.lit("text"), text)

    return let(F.coalesce(F.schema_of_variant(v), F.lit("VOID")), read)


def scalar_json(token: Column, text: Column) -> Column:
    """The JSON of a scalar given by token and text, the inverse of scalar."""
    return F.when(token.isNull(), "null").when(token.startswith("s:"), quoted(F.substring(token, 3, 1 << 30))).when(token.startswith("n:") & text.isin("True", "False"), F.lower(text)).otherwise(text)
