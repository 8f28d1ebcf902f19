"""Blank-aware picking and number parsing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accepted number forms after blanks are removed and comma became a dot.
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
NUMBER_PREFIX = r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"

Fields = dict[str, tuple[Column, T.DataType]]


def fields_of(df: DataFrame) -> Fields:
    """Top-level columns by name with their types."""
    return {f.name: (F.col(f.name), f.dataType) for f in df.schema.fields}


def struct_fields(item: Column, struct: T.StructType) -> Fields:
    """Members of a struct column by name with their types."""
    return {f.name: (item[f.name], f.dataType) for f in struct.fields}


# Every character that counts as white space at the ends of a text.
WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.btrim(c, F.lit(WHITE))


def in_order(t: Column, *words: str) -> Column:
    """Do the words occur one after the other within a line? Linear, where ``a.*b.*c`` backtracks."""

    def follow(line: Column) -> Column:
        rest = line
        for w in words[:-1]:
            rest = F.try_element_at(F.split(rest, w, 2), F.lit(2))
        return F.coalesce(rest.contains(words[-1]), F.lit(False))

    known = t.contains(words[0])
    for w in words[1:]:
        known = known & t.contains(w)
    return known & F.exists(F.split(t, "\n"), follow)


def clean_text(c: Column) -> Column:
    """Trimmed text; null when nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def has_value(c: Column, kind: T.DataType) -> Column:
    """Not null, not blank, not empty; zero and false do count."""
    if isinstance(kind, T.StringType):
        return c.isNotNull() & (strip(c) != "")
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return c.isNotNull() & (F.size(c) > 0)
    return c.isNotNull()


def _coalesce(parts: list[Column], empty: str) -> Column:
    if not parts:
        return F.lit(None).cast(empty)
    return parts[0] if len(parts) == 1 else F.coalesce(*parts)


def as_text(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")


def first_text(fields: Fields, *names: str) -> Column:
    """Cleaned text of the first alias that carries a value."""
    parts = []
    for n in names:
        if n in fields:
            c, kind = fields[n]
            parts.append(clean_text(as_text(c, kind)) if isinstance(kind, T.StringType)
                         else F.when(has_value(c, kind), as_text(c, kind)))
    return _coalesce(parts, "string")


def first_number(fields: Fields, *names: str) -> Column:
    """Number in the first alias that carries a value; null when that one does not parse."""
    picked = [(n, *fields[n]) for n in names if n in fields]
    if picked and all(isinstance(k, T.NumericType) for _, _, k in picked):
        return _coalesce([c.cast("double") for _, c, _ in picked], "double")
    parts = []
    for _, c, kind in picked:
        text = c.cast("int").cast("string") if isinstance(kind, T.BooleanType) else as_text(c, kind)
        parts.append(F.when(has_value(c, kind), text))
    return to_number(_coalesce(parts, "string"))


def first_parsed_number(fields: Fields, *names: str) -> Column:
    """First alias that parses as a number (keeps probing after a bad one)."""
    parts = []
    for n in names:
        if n in fields:
            c, kind = fields[n]
            if isinstance(kind, T.NumericType):
                parts.append(c.cast("double"))
            elif isinstance(kind, T.BooleanType):
                parts.append(c.cast("int").cast("double"))
            else:
                parts.append(to_number(as_text(c, kind)))
    return _coalesce(parts, "double")


def to_number(c: Column) -> Column:
    """``"1 290,50"`` -> 1290.5; anything that is not wholly a number -> null."""
    t = F.replace(F.replace(strip(c.cast("string")), F.lit(" "), F.lit("")), F.lit(","), F.lit("."))
    return F.regexp_extract(t, NUMBER, 0).try_cast("double")


def to_whole(c: Column) -> Column:
    """Number truncated towards zero."""
    return F.regexp_extract(strip(c.cast("string")), NUMBER, 0).try_cast("double").cast("bigint")


def to_number_lenient(c: Column) -> Column:
    """Leading number of the text (``"12abc"`` -> 12), first comma read as a dot."""
    t = F.regexp_replace(c.cast("string"), r"\s+", "")
    t = F.regexp_replace(t, r"^([^,]*),", "$1.")
    return F.regexp_extract(t, NUMBER_PREFIX, 0).try_cast("double")


def let(c: Column, fn) -> Column:
    """Evaluate ``c`` once and use it many times inside ``fn``.

    A column used n times in an expression is n copies in the plan; this binds it as the variable
    of a one-element array. For heavy text expressions only, as it leaves generated code.
    """
    return F.element_at(F.transform(F.array(c), fn), 1)


def any_of(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds) if conds else F.lit(False)


def contains_any(c: Column, phrases) -> Column:
    """Plain substring test against a fixed list."""
    return any_of([c.contains(p) for p in phrases])


def count_hits(c: Column, phrases) -> Column:
    """How many phrases of a fixed list occur in the text."""
    return reduce(lambda a, b: a + b, [c.contains(p).cast("int") for p in phrases])


def ratio(num: Column, den: Column, default: float | None = 0.0) -> Column:
    """``num / den`` with a fallback where there is nothing to divide by."""
    out = F.try_divide(num.cast("double"), den.cast("double"))
    return out if default is None else F.coalesce(out, F.lit(float(default)))


def percent(num: Column, den: Column) -> Column:
    return ratio(num * 100.0, den)


def steady_sum(c: Column, digits: int = 2) -> Column:
    """Sum settled to fixed digits, so that the order of partial sums cannot show."""
    return F.round(F.sum(c), digits)


def steady_mean(c: Column, digits: int = 2) -> Column:
    """Mean over a settled sum; null for no values."""
    return F.try_divide(F.round(F.sum(c), digits), F.count(c))


def half_up(c: Column, digits: int) -> Column:
    """Round half up on the double itself."""
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / F.lit(scale)
