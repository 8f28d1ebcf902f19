"""Variation labels: type, confidence, display name, sort keys, validation, prices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalogwatch.functions import goods
from catalogwatch.functions.values import NUMBER, half_up, let, strip

# Label keywords per variation type; on equal counts the earlier type wins.
LABEL_KEYWORDS = {
    "size": ("размер", "size", "разм", "s/m/l", "xs", "s", "m", "l", "xl", "xxl", "размеры", "sizes", "объем", "volume", "вес", "weight"),
    "color": ("цвет", "color", "colour", "красный", "red", "синий", "blue", "зеленый", "green", "черный", "black", "белый", "white",
              "желтый", "yellow", "оранжевый", "orange", "фиолетовый", "purple"),
    "model": ("модель", "model", "стиль", "style", "тип", "type", "вариант", "variant", "серия", "series", "линейка", "line"),
}
# Value patterns per variation type.
VALUE_PATTERNS = {
    "size": (
        r"\b\d+(?:\.\d+)?\s*(?:x|×|by|\*)\s*\d+(?:\.\d+)?",
        r"\b\d+(?:\.\d+)?\s*(?:ml|l|kg|g|oz|lb|cm|mm|inch)",
        r"\b(?:xs|s|m|l|xl|xxl|xxxl|2xl|3xl|4xl)\b",
        r"\b\d+(?:\.\d+)?(?:\s*-\s*\d+(?:\.\d+)?)?\b",
    ),
    "color": (
        r"\b(?:red|blue|green|black|white|yellow|orange|purple|pink|brown|gray|grey|silver|gold)\b",
        r"\b(?:красный|синий|зеленый|черный|белый|желтый|оранжевый|фиолетовый|розовый|коричневый|серый|серебряный|золотой)\b",
    ),
    "model": (
        r"\b(?:model|style|type|variant|series|edition|version)\b",
        r"\b(?:модель|стиль|тип|вариант|серия|издание|версия)\b",
    ),
}
CATEGORIES = {"size": "dimension", "color": "appearance", "model": "variant"}
TYPE_ORDER = {"size": 1, "color": 2, "model": 3}
LETTER_SIZES = {"XS": 1, "S": 2, "M": 3, "L": 4, "XL": 5, "XXL": 6, "XXXL": 7}
DEFAULT_SORT = 999
UNKNOWN = "unknown"
# Option attributes probed for a price; deltas add to the base price.
PRICE_ATTRIBUTES = (
    "data-price", "data-price-value", "data-option-price", "data-price-modifier", "data-price-plus", "data-price-diff", "data-special",
    "data-value",
)
DELTA_ATTRIBUTES = ("data-price", "data-price-modifier", "data-price-plus", "data-price-diff")
STOCK_ATTRIBUTES = ("data-quantity", "data-stock", "data-option-stock", "data-qty", "data-remains", "data-count", "data-opt-quantity")


def _pick(c: Column, table: dict, default) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out.otherwise(F.lit(default))


def _total(parts: list[Column]) -> Column:
    return sum(parts[1:], parts[0])


def label_type(label: Column) -> Column:
    """``struct(type, confidence)`` from the label text alone."""

    def read(t: Column) -> Column:
        tokens = F.split(F.regexp_replace(t, "[^a-z0-9а-яё]+", " "), " ")

        def hits(w: str) -> Column:
            return (t.contains(w) if len(w) > 2 else F.array_contains(tokens, w)).cast("int")

        counts = F.array(*[_total([hits(w) for w in words]) for words in LABEL_KEYWORDS.values()])

        def judge(n: Column) -> Column:
            top = F.array_max(n)
            kind = F.when((t == "") | (top == 0), UNKNOWN)
            for i, name in enumerate(LABEL_KEYWORDS):
                kind = kind.when(n[i] == top, name)
            sure = F.when((t == "") | (top == 0), 0.0).otherwise(F.least(top / F.size(F.split(t, r"\s+")), F.lit(1.0)))
            return F.struct(kind.alias("type"), sure.alias("confidence"))

        return let(counts, judge)

    return let(F.coalesce(strip(F.lower(label)), F.lit("")), read)


def variation_type(label: Column, value: Column) -> Column:
    """``struct(type, confidence, category)`` from label and value together."""

    def value_counts(v: Column) -> Column:
        return F.array(*[_total([v.rlike("(?U)" + p).cast("int") for p in ps]) for ps in VALUE_PATTERNS.values()])

    def judge(x: Column) -> Column:
        kind, sure, n = x["label"]["type"], x["label"]["confidence"], x["n"]
        size, color, model = n[0], n[1], n[2]
        backed = ((kind == "size") & (size > 0)) | ((kind == "color") & (color > 0)) | ((kind == "model") & (model > 0))
        raised = F.when(backed, F.least(sure + 0.2, F.lit(1.0))).otherwise(sure)
        guess = (
            F.when((size > color) & (size > model), "size").when(color > model, "color").when(model > 0, "model").otherwise(UNKNOWN)
        )
        weak = raised < 0.3
        final = F.when(weak, guess).otherwise(kind)
        return F.struct(
            final.alias("type"),
            F.when(~weak, raised).when(guess == UNKNOWN, 0.0).otherwise(0.4).alias("confidence"),
            _pick(final, CATEGORIES, "other").alias("category"),
        )

    v = let(strip(F.lower(F.coalesce(value, F.lit("")))), value_counts)
    return let(F.struct(label_type(label).alias("label"), v.alias("n")), judge)


def title_case(c: Column) -> Column:
    """A capital after every non-letter, small letters elsewhere."""

    def letters(chars: Column) -> Column:
        def one(ch: Column, i: Column) -> Column:
            after = F.coalesce(F.try_element_at(chars, i), F.lit(" "))
            return F.when((i == 0) | ~after.rlike(r"\p{L}"), F.upper(ch)).otherwise(ch)

        return F.array_join(F.transform(chars, one), "")

    return F.element_at(F.transform(F.array(F.split(F.lower(c), "")), letters), 1)


def display_name(kind: Column, value: Column) -> Column:
    size = F.regexp_replace(F.upper(value), r"\s+", "")
    shaped = F.when(size.rlike(r"^\d+(?:\.\d+)?(?:X\d+(?:\.\d+)?)?$"), F.replace(size, F.lit("X"), F.lit(" × "))).otherwise(size)
    return (
        F.when(F.coalesce(value, F.lit("")) == "", "Unknown")
        .when(kind == "size", shaped)
        .when(kind == "color", title_case(strip(value)))
        .otherwise(strip(value))
    )


def sort_keys(kind: Column, value: Column, sort_order: Column | None = None) -> list[Column]:
    """Order of variations: type, own order, natural size or text."""
    own = F.coalesce(sort_order, F.lit(DEFAULT_SORT)) if sort_order is not None else F.lit(DEFAULT_SORT)
    number = F.nullif(F.regexp_extract(value, r"\d+(?:\.\d+)?", 0), F.lit("")).try_cast("double")
    size = F.coalesce(number, _pick(F.upper(value), LETTER_SIZES, 99).cast("double"))
    return [
        _pick(kind, TYPE_ORDER, 4),
        own,
        F.when(kind == "size", size).otherwise(0.0),
        F.when(kind == "size", "").otherwise(F.lower(value)),
    ]


def validated(price: Column, stock: Column, in_stock: Column) -> dict[str, Column]:
    """Cleaned price, stock and flag; ``keep`` is false for a negative price."""
    p = F.coalesce(F.when(strip(price).rlike(NUMBER), strip(price).try_cast("double")), F.lit(0.0))
    whole = F.when(strip(stock).rlike(r"^[+-]?\d+$"), strip(stock).try_cast("int"))
    s = F.when(stock.isNull(), F.lit(None)).otherwise(F.coalesce(whole, goods.parse_stock(stock), F.lit(0))).cast("int")
    return {"keep": p >= 0, "price": p, "stock": s, "in_stock": F.coalesce(in_stock, s.isNull() | (s > 0))}


def option_price(attrs: Column, text: Column, base: Column) -> Column:
    """Price of an option: first priced attribute (deltas add to the base), else its text, else the base."""
    parts = []
    for name in PRICE_ATTRIBUTES:
        n = goods.clean_price(F.try_element_at(attrs, F.lit(name)))
        parts += [base + n, n] if name in DELTA_ATTRIBUTES else [n]
    shown = goods.clean_price(text)
    return F.coalesce(*parts, F.nullif(shown, F.lit(0.0)), base, shown)


def option_stock(attrs: Column, text: Column, base: Column) -> Column:
    """Stock of an option: first readable attribute, else its text, else the base."""
    parts = [goods.parse_stock(F.try_element_at(attrs, F.lit(n))) for n in STOCK_ATTRIBUTES]
    return F.coalesce(*parts, goods.parse_stock(text), base)


CURRENCY_SIGNS = {"RUB": "₽", "USD": "$", "EUR": "€", "GBP": "£"}


def money_text(amount: Column, currency: str = "RUB") -> Column:
    return F.when(amount.isNull(), "N/A").otherwise(F.concat(F.format_number(amount, 2), F.lit(" " + CURRENCY_SIGNS.get(currency, currency))))


def price_range_text(low: Column, high: Column, currency: str = "RUB") -> Column:
    a, b = money_text(low, currency), money_text(high, currency)
    return F.when(low.eqNullSafe(high), a).otherwise(F.concat(a, F.lit(" - "), b))


def stock_text(base: Column, total: Column, count: Column) -> Column:
    """Stock line: own stock plus that of ``count`` variations summing to ``total``."""
    everything = F.coalesce(base, F.lit(0)) + F.coalesce(total, F.lit(0))
    mean = half_up(everything / (count + 1), 1)
    return F.when(F.coalesce(count, F.lit(0)) == 0, F.format_string("Total Stock: %s", everything)).otherwise(
        F.format_string("Total: %s, Avg: %.1f", everything, mean)
    )


