"""Pages -> one row per page with its elements as columns; everything else works on those columns."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalogwatch.functions.values import strip
from catalogwatch.operators import literals
from catalogwatch.session import spread

ELEMENT = "struct<tag:string,attrs:map<string,string>,first:int,upto:int>"
PARSED_DDL = (
    f"elements array<{ELEMENT}>, strings array<string>, scripts array<struct<type:string,body:string,listings:array<string>>>, "
    "text_words int, top_word int"
)
# Parsed pages are large, so far fewer leave at once than come in.
ROWS = 256
# Elements that never have content.
VOID = frozenset("area base br col embed hr img input keygen link meta param source track wbr".split())
# Attributes that hold a payload.
PAYLOADS = frozenset(("data-product", "data-variants", "data-product_variations"))


class _Elements(HTMLParser):
    """Start tags in document order, each with the range of text pieces it encloses."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements: list[list] = []
        self.open: list[int] = []
        self.strings: list[str] = []
        self.scripts: list[tuple[str | None, str]] = []

    def handle_starttag(self, tag, attrs):
        at = len(self.strings)
        self.elements.append([tag, [(k, literals.to_json(v) if v and k in PAYLOADS else v or "") for k, v in dict(attrs).items()], at, at])
        if tag not in VOID:
            self.open.append(len(self.elements) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.elements[self.open[depth]][0] == tag:
                for i in self.open[depth:]:
                    self.elements[i][3] = len(self.strings)
                del self.open[depth:]
                return

    def handle_data(self, data):
        inner = self.elements[self.open[-1]] if self.open else None
        if inner and inner[0] == "script":
            self.scripts.append((dict(inner[1]).get("type"), data))
        elif not inner or inner[0] not in ("style", "template"):
            self.strings.append(data)

    def finish(self):
        self.close()
        for i in self.open:
            self.elements[i][3] = len(self.strings)


def _parse(html: str | None):
    p = _Elements()
    p.feed(html or "")
    p.finish()
    words = "".join(s.strip() for s in p.strings).lower().split()
    top = max(Counter(words).values(), default=0)
    elements = [{"tag": t, "attrs": a, "first": i, "upto": j} for t, a, i, j in p.elements]
    scripts = [{"type": t, "body": b, "listings": literals.listings(b)} for t, b in p.scripts]
    return elements, p.strings, scripts, len(words), top


def _arrow_fields() -> list[pa.Field]:
    element = pa.struct(
        [("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("first", pa.int32()), ("upto", pa.int32())]
    )
    script = pa.struct([("type", pa.string()), ("body", pa.string()), ("listings", pa.list_(pa.string()))])
    kinds = {
        "elements": pa.list_(element), "strings": pa.list_(pa.string()), "scripts": pa.list_(script),
        "text_words": pa.int32(), "top_word": pa.int32(),
    }
    return [pa.field(n, k) for n, k in kinds.items()]


def parse_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """One pass over the page text in Arrow batches; any number of users downstream. Nothing moves unless cores would be idle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = _arrow_fields()
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                rows = [_parse(h) for h in batch.column(html).to_pylist()]
                parsed = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(fields)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, *parsed], schema=pa.schema([*batch.schema, *fields])
                )

    schema = T.StructType(pages.schema.fields + T.StructType.fromDDL(PARSED_DDL).fields)
    return spread(pages).mapInArrow(run, schema)


# --- column helpers over a parsed page ------------------------------------------------------------


def every(*tags: str) -> Column:
    return F.filter("elements", lambda e: e["tag"].isin(*tags))


def has(*tags: str) -> Column:
    return F.exists("elements", lambda e: e["tag"].isin(*tags))


def count(*tags: str) -> Column:
    return F.size(every(*tags))


def attr(e: Column, name: str) -> Column:
    return F.try_element_at(e["attrs"], F.lit(name))


def raw_text(e: Column) -> Column:
    """Text below an element as written."""
    return F.array_join(F.slice("strings", e["first"] + 1, e["upto"] - e["first"]), "")


def trimmed(c: Column) -> Column:
    return strip(c)


def tight_text(e: Column) -> Column:
    """Text below an element, its pieces stripped and joined without a separator."""
    return F.array_join(F.transform(F.slice("strings", e["first"] + 1, e["upto"] - e["first"]), trimmed), "")


def page_text() -> Column:
    """All text of the page, pieces stripped and joined."""
    return F.array_join(F.transform("strings", trimmed), "")


def first_of(items: Column) -> Column:
    return F.try_element_at(items, F.lit(1))


def first_text_of(*tags: str) -> Column:
    e = first_of(every(*tags))
    return F.nullif(trimmed(raw_text(e)), F.lit(""))


def meta(name: str, key: str = "name") -> Column:
    """Content of the first meta tag of that name."""
    hit = F.filter("elements", lambda e: (e["tag"] == "meta") & (F.lower(attr(e, key)) == name))
    return F.nullif(trimmed(attr(first_of(hit), "content")), F.lit(""))


def class_text(e: Column) -> Column:
    return F.coalesce(attr(e, "class"), F.lit(""))
