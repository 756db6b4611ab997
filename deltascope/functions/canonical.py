"""Canonical text of values: the equality that diffs, keys and fingerprints use.

A value is its type's tag, a colon and a fixed notation, so 1, '1' and 1.00 are
three different values; NULL is 'N:' and equal to itself. Everything downstream
of a snapshot works on these texts.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL = "N:"
#: Types whose canonical text is that of their parts.
NESTED = (T.ArrayType, T.MapType, T.StructType)
#: The tag of a value in a VARIANT, by the name of its type that Spark shows; objects and arrays have V.
VARIANT_TAGS = {"BIGINT": "I", "DECIMAL": "M", "DOUBLE": "F", "FLOAT": "F", "BOOLEAN": "L", "STRING": "T", "TIMESTAMP": "D", "TIMESTAMP_NTZ": "D", "DATE": "J", "BINARY": "B", "VOID": "N"}


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Unicode NFC. There is no such function in Spark; columns that are pure ASCII never come here."""
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def canonical(column: Column, kind: T.DataType, normalise: bool = False) -> Column:
    text = column.cast("string")
    if isinstance(kind, T.BooleanType):
        body = F.when(column, "L:1").otherwise("L:0")
    elif isinstance(kind, T.IntegralType):
        body = F.concat(F.lit("I:"), text)
    elif isinstance(kind, T.DecimalType):
        body = F.concat(F.lit("M:"), text)
    elif isinstance(kind, T.FractionalType):
        body = F.concat(F.lit("F:"), text)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        whole = F.date_trunc("second", column) == column
        body = F.concat(F.lit("D:"), F.when(whole, F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")))
    elif isinstance(kind, T.DateType):
        body = F.concat(F.lit("J:"), text)
    elif isinstance(kind, T.BinaryType):
        body = F.concat(F.lit("B:"), F.sha2(column, 256))
    elif isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        body = F.concat(F.lit("T:"), nfc(text) if normalise else text)
    elif isinstance(kind, T.VariantType):
        body = _variant(column, normalise)
    elif isinstance(kind, NESTED):
        body = nfc(_nested(column, kind)) if normalise else _nested(column, kind)
    else:
        raise TypeError(f"no canonical text for {kind.simpleString()}")
    return F.when(column.isNull(), NULL).otherwise(body)


def _variant_tag(column: Column) -> Column:
    tags = F.create_map(*[F.lit(x) for pair in VARIANT_TAGS.items() for x in pair])
    return F.coalesce(tags[F.regexp_extract(F.schema_of_variant(column), "^[A-Z_]+", 0)], F.lit("V"))


def _variant(column: Column, normalise: bool) -> Column:
    """The text that a column of the value's own type would have, so 1 and '1' differ; a JSON null is NULL. Objects and arrays: V, their types and their JSON. Spark keeps a decimal without trailing zeros here."""
    shown, mark = F.schema_of_variant(column), _variant_tag(column)
    text = F.when(shown != "BINARY", column.cast("string"))  # bytes are no text, and a Python function sees every row
    text = nfc(text) if normalise else text
    own = lambda kind: canonical(F.try_variant_get(column, "$", kind.simpleString()), kind)
    return (
        F.when(shown == "VOID", NULL).when(shown == "BOOLEAN", own(T.BooleanType())).when(shown == "BINARY", own(T.BinaryType())).when(shown == "TIMESTAMP", own(T.TimestampType()))
        .when(shown == "TIMESTAMP_NTZ", own(T.TimestampNTZType())).when(mark == "V", F.concat(F.lit("V:"), shown, F.lit(":"), text)).otherwise(F.concat(mark, F.lit(":"), text))
    )


def observed_tag(column: Column, kind: T.DataType) -> Column:
    """The tag of a value's canonical text, without making the text."""
    if isinstance(kind, T.VariantType):
        return F.when(column.isNull(), "N").otherwise(_variant_tag(column))
    tags = ((T.BooleanType, "L"), (T.IntegralType, "I"), (T.DecimalType, "M"), (T.FractionalType, "F"), (T.TimestampType, "D"), (T.TimestampNTZType, "D"), (T.DateType, "J"), (T.BinaryType, "B"), (T.ArrayType, "A"), (T.StructType, "S"), (T.MapType, "K"))
    return F.when(column.isNull(), "N").otherwise(next((t for cls, t in tags if isinstance(kind, cls)), "T"))


def _listed(texts: Column) -> Column:
    """An array of texts as one, so that different arrays have different texts: commas and backslashes in a part are marked."""
    return F.array_join(F.transform(texts, lambda t: F.replace(F.replace(t, F.lit("\\"), F.lit("\\\\")), F.lit(","), F.lit("\\,"))), ",")


def _nested(column: Column, kind: T.DataType) -> Column:
    """A: elements in order; S: fields in order; K: keys, in the order of their texts, each with its value."""
    if isinstance(kind, T.ArrayType):
        return F.concat(F.lit("A:"), _listed(F.transform(column, lambda x: canonical(x, kind.elementType))))
    if isinstance(kind, T.StructType):
        return F.concat(F.lit("S:"), _listed(F.array(*[canonical(column.getField(f.name), f.dataType) for f in kind])))
    pair = lambda e: F.struct(canonical(e["key"], kind.keyType).alias("k"), canonical(e["value"], kind.valueType).alias("v"))
    return F.concat(F.lit("K:"), _listed(F.flatten(F.transform(F.array_sort(F.transform(F.map_entries(column), pair)), lambda p: F.array(p["k"], p["v"])))))


def row_fingerprint(texts: list[Column]) -> Column:
    """SHA-256 over the length-prefixed canonical texts, in column order."""
    parts = [p for t in texts for p in (F.octet_length(t).cast("string"), F.lit(":"), t)]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _stripped(text: Column) -> Column:
    """Decimal notation without needless zeros and minus."""
    return F.regexp_replace(F.regexp_replace(text, r"\.0*$|(\.[0-9]*[1-9])0+$", "$1"), "^-0$", "0")


def exact_number(text: Column) -> Column:
    """The text of a number of any type, so that equal numbers have equal texts: plain notation where a decimal can hold it, else (beyond any decimal) as it is."""
    exponent = F.regexp_extract(text, r"E(-?[0-9]+)$", 1).try_cast("int")
    wide = lambda kind: text.try_cast(kind).cast("string")
    plain = F.when(exponent.between(0, 19), wide("decimal(38,18)")).when(exponent.between(20, 37), wide("decimal(38,0)")).when(exponent.between(-21, -1), wide("decimal(38,37)"))
    return _stripped(F.when(text.contains("E"), F.coalesce(plain, text)).otherwise(text))


def has_text(kind: T.DataType) -> bool:
    """Whether texts that may need NFC are in it."""
    if isinstance(kind, T.ArrayType):
        return has_text(kind.elementType)
    if isinstance(kind, T.MapType):
        return has_text(kind.keyType) or has_text(kind.valueType)
    return any(has_text(f.dataType) for f in kind) if isinstance(kind, T.StructType) else isinstance(kind, (T.StringType, T.VariantType))


def family(kind: T.DataType) -> str | None:
    """Types that profiling compares with each other."""
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)):
        return "text"
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    if isinstance(kind, (*NESTED, T.VariantType)):
        return "nested"
    return "binary" if isinstance(kind, T.BinaryType) else None


def family_key(column: Column, kind: T.DataType, normalise: bool = False) -> Column:
    """A text that is equal for equal values of a family, and never longer than a digest."""
    which = family(kind)
    if isinstance(kind, T.IntegralType):
        return column.cast("string")
    if isinstance(kind, T.DecimalType) and kind.scale <= 6:  # never in scientific notation
        text = column.cast("string")
        return F.rtrim(F.rtrim(text, F.lit("0")), F.lit(".")) if kind.scale else text
    if which == "number":
        return exact_number(column.cast("string"))
    if which == "date":
        return F.date_format(column.cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    if which == "binary":
        return F.sha2(column, 256)
    if which == "nested":
        return F.when(observed_tag(column, kind) != "N", F.sha2(canonical(column, kind, normalise).cast("binary"), 256))
    if which == "boolean":
        return column.cast("string")
    text = nfc(column.cast("string")) if normalise else column.cast("string")
    return F.when(F.length(text) > 64, F.concat(F.lit("#"), F.sha2(text.cast("binary"), 256))).otherwise(text)


# Views of a canonical text


def tag(text: Column) -> Column:
    return F.substring(text, 1, 1)


def body(text: Column) -> Column:
    return text.substr(F.lit(3), F.length(text))


def number(text: Column) -> Column:
    """The numeric view: integers, decimals and finite floats; never booleans or text, nor numbers that DECIMAL(38,10) doesn't hold exactly."""
    value = body(text).try_cast("decimal(38,10)")
    finer = F.coalesce(*[body(text).try_cast(kind).cast("string") for kind in ("decimal(38,37)", "decimal(38,18)", "decimal(38,10)")])
    short = body(text).rlike(r"^-?[0-9]{1,28}(\.[0-9]{1,10})?$")  # held exactly as it is
    return F.when(tag(text) == "I", value).when(tag(text).isin("M", "F") & (short | (_stripped(value.cast("string")) == _stripped(finer))), value)


def integer(text: Column) -> Column:
    return F.when(tag(text) == "I", body(text).try_cast("decimal(38,0)"))


def moment(text: Column) -> Column:
    return F.when(tag(text) == "D", F.to_timestamp_ntz(body(text)))


def day(text: Column) -> Column:
    return F.when(tag(text) == "J", body(text).try_cast("date")).when(tag(text) == "D", F.to_date(F.to_timestamp_ntz(body(text))))


def plain(amount: Column) -> Column:
    """Fixed notation without trailing zeros."""
    text = amount.cast("decimal(38,10)").cast("string")
    return F.when(text.contains("."), F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)
