"""HTML pages as flat element rows, and look-ups in key/value tables on them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tickloom.operators.spread import deal

# Tags left out, and tags that never hold anything.
SKIPPED_TAGS = frozenset(["html", "head", "link", "meta", "br"])
CHILDLESS_TAGS = frozenset(["input", "img"])

_BLANKS = " \t\n\r\x0b\x0c"
# Tags whose content is, or in some versions of the parser is, no markup.
_RAW_TAGS = frozenset(
    ["script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"])
# What precedes the first tag; a plain tag with the text behind it; an attribute of one.
_HEAD = re.compile(r"[^<]*(?:<!doctype[^<>]*>[^<]*)?", re.I)
_PLAIN = re.compile(
    r"<(/?)([a-zA-Z][a-zA-Z0-9]*)"
    r"((?:[ \t\n\r\f]+[a-zA-Z][a-zA-Z0-9_:-]*(?:=(?:\"[^\"<>]*\"|'[^'<>]*'|[a-zA-Z0-9_.:#-]+))?)*)[ \t\n\r\f]*>([^<]*)")
_ATTRIBUTE = re.compile(r"([a-zA-Z][a-zA-Z0-9_:-]*)(?:(=)(?:\"([^\"]*)\"|'([^']*)'|([a-zA-Z0-9_.:#-]+)))?")
# What stands between a tag's end and the next tag.
_BETWEEN = re.compile(r">([^<]*)")
# Shapes of pages that a task keeps, and the characters of one.
_SHAPES, _SHAPE_SIZE = 256, 1 << 14
# Elements gathered, over pages, before they are sent to Spark.
_ROWS_PER_BATCH = 8192


class _Elements(HTMLParser):
    """Collects [parent, depth, tag, data, attributes] in document order.

    Each piece of text replaces the data of the innermost open element. An end tag
    closes that element only if the names agree.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.rows: list[list] = []
        self.open: list[int] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SKIPPED_TAGS:
            return
        parent = self.open[-1] if self.open else None
        self.rows.append([parent, len(self.open), tag, None, list(dict(attrs).items())])
        if tag not in CHILDLESS_TAGS:
            self.open.append(len(self.rows) - 1)

    def handle_endtag(self, tag: str) -> None:
        if self.open and self.rows[self.open[-1]][2] == tag:
            self.open.pop()

    def handle_data(self, data: str) -> None:
        if self.open:
            self.rows[self.open[-1]][3] = data.strip(_BLANKS).replace("\n", "")


def _attributes(text: str) -> list[tuple[str, str | None]]:
    found = {}
    for name, given, *values in _ATTRIBUTE.findall(text):
        found[name.lower()] = "".join(values) if given else None
    return list(found.items())


class _Shape(NamedTuple):
    """Elements by column, without their data: what all pages share that differ in their texts only."""

    elem_id: list[int]
    parent_id: list[int | None]
    depth: list[int]
    tag: list[str]
    attributes: list[list]
    balanced: bool
    texts: list[int]  # for each text, which of the elements it is the data of, or -1


def _shape(rows: list[list], balanced: bool, texts: list[int], tags: frozenset[str]) -> _Shape:
    kept = [n for n, r in enumerate(rows) if not tags or r[2] in tags]
    place = {n: k for k, n in enumerate(kept)}
    columns = ([rows[n][c] for n in kept] for c in (0, 1, 2, 4))
    return _Shape(kept, *columns, balanced, [place.get(n, -1) for n in texts])


def _plain_shape(tagged: str, tags: frozenset[str]) -> _Shape | None:
    """The shape of a page given without its texts; None where a ``<`` begins no plain tag, so no page is read in part."""
    tokens = _PLAIN.findall(tagged)
    if len(tokens) != tagged.count("<"):
        return None
    rows: list[list] = []
    open_: list[int] = []
    texts: list[int] = []
    for end, tag, attributes, _ in tokens:
        tag = tag.lower()
        if end:
            if attributes:
                return None
            if open_ and rows[open_[-1]][2] == tag:
                open_.pop()
        elif tag in _RAW_TAGS:
            return None
        elif tag not in SKIPPED_TAGS:
            rows.append([open_[-1] if open_ else None, len(open_), tag, None, _attributes(attributes) if attributes else []])
            if tag not in CHILDLESS_TAGS:
                open_.append(len(rows) - 1)
        texts.append(open_[-1] if open_ else -1)
    return _shape(rows, not open_, texts, tags)


class _Pages:
    """Reads pages as (shape, data of its elements), with the elements of ``tags`` only, if there are any.

    A page of plain tags and text is cut at its tags. What remains without the texts is the same for most pages that one program
    makes, so its shape is worked out once; plain tags hold no ``>``, so the cuts are those of the tags. Other pages go to the parser.
    """

    def __init__(self, tags: frozenset[str] = frozenset()):
        self.tags = tags
        self.shapes: dict[str, _Shape | None] = {}

    def plain(self, html: str) -> tuple[_Shape, list[str | None]] | None:
        if "&" in html:
            return None
        parts = _BETWEEN.split(html[_HEAD.match(html).end() :])
        tagged = ">".join(parts[::2])
        if tagged in self.shapes:
            shape = self.shapes[tagged]
        else:
            shape = _plain_shape(tagged, self.tags)
            if len(tagged) <= _SHAPE_SIZE:
                if len(self.shapes) == _SHAPES:
                    self.shapes.clear()
                self.shapes[tagged] = shape
        if shape is None:
            return None
        data: list[str | None] = [None] * len(shape.tag)
        for text, n in zip(parts[1::2], shape.texts):
            if n >= 0 and text:
                data[n] = text.strip(_BLANKS).replace("\n", "")
        return shape, data

    def read(self, html: str) -> tuple[_Shape, list[str | None]]:
        found = self.plain(html)
        if found is None:
            parser = _Elements()
            parser.feed(html)  # not closed: an unfinished tag at the end is no element
            shape = _shape(parser.rows, not parser.open, [], self.tags)
            found = shape, [parser.rows[n][3] for n in shape.elem_id]
        return found


def _elements(shape: _Shape, data: list[str | None]) -> list[list]:
    return [list(e) for e in zip(shape.parent_id, shape.depth, shape.tag, data, shape.attributes)]


def _plain_elements(html: str) -> tuple[list[list], bool] | None:
    """What the parser finds on a page of plain tags and text; None for any other page."""
    found = _Pages().plain(html)
    return found and (_elements(*found), found[0].balanced)


def _page_elements(html: str) -> tuple[list[list], bool]:
    shape, data = _Pages().read(html)
    return _elements(shape, data), shape.balanced


def _parse_batches(schema: pa.Schema, tags: frozenset[str]):
    def batch_of(columns: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages = _Pages(tags)
        columns: dict[str, list] = {name: [] for name in schema.names}
        held = 0
        for batch in batches:
            for page_id, html in zip(*(column.to_pylist() for column in batch.columns)):
                if html is None:
                    continue
                shape, data = pages.read(html)
                n = len(data)
                found = {**shape._asdict(), "page_id": [page_id] * n, "data": data, "balanced": [shape.balanced] * n}
                for name, values in columns.items():
                    values += found[name]
                held += n
                if held >= _ROWS_PER_BATCH:
                    yield batch_of(columns)
                    columns, held = {name: [] for name in schema.names}, 0
        if held:
            yield batch_of(columns)

    return parse


def html_elements(
    pages: DataFrame,
    id_col: str = "page_id",
    html_col: str = "html",
    tags: tuple[str, ...] = (),
    columns: tuple[str, ...] = (),
) -> DataFrame:
    """Element rows (page_id, elem_id, parent_id, depth, tag, data, attributes, balanced).

    elem_id counts in document order, parent_id is NULL for outermost elements.
    ``balanced`` is FALSE for pages that leave tags open.
    With ``tags`` only elements of those leave the parser, with ``columns`` only these.

    Pages are dealt out evenly before they are parsed: parsing takes several times as long as moving
    them, and files, or pages made from a few rows, seldom hold as much HTML as a task should.
    """
    kind = pages.schema[id_col].dataType
    schema = T.StructType(
        [
            T.StructField("page_id", kind),
            T.StructField("elem_id", T.IntegerType()),
            T.StructField("parent_id", T.IntegerType()),
            T.StructField("depth", T.IntegerType()),
            T.StructField("tag", T.StringType()),
            T.StructField("data", T.StringType()),
            T.StructField("attributes", T.MapType(T.StringType(), T.StringType())),
            T.StructField("balanced", T.BooleanType()),
        ]
    )
    if columns:
        schema = T.StructType([schema[name] for name in columns])
    return deal(pages.select(id_col, html_col)).mapInArrow(_parse_batches(to_arrow_schema(schema), frozenset(tags)), schema)


def page_values(
    pages: DataFrame, keys: dict[str, str], id_col: str = "page_id", html_col: str = "html"
) -> DataFrame:
    """(id, one column per name): what :func:`html_values_for` finds, one row for every page that has HTML.

    A page is whole inside one task, so the values are taken where it is parsed and nothing is shuffled;
    NULL where a page lacks a key. A NULL value and a missing key are told apart by ``found``, the names of the keys present.
    """
    schema = T.StructType(
        [
            T.StructField(id_col, pages.schema[id_col].dataType),
            *[T.StructField(name, T.StringType()) for name in keys],
            T.StructField("found", T.ArrayType(T.StringType())),
        ]
    )
    arrow = to_arrow_schema(schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read_page = _Pages().read
        for batch in batches:
            rows = []
            for page_id, html in zip(*(column.to_pylist() for column in batch.columns)):
                if html is not None:
                    shape, data = read_page(html)
                    values = _values_in(shape.parent_id, data, keys)
                    rows.append((page_id, *[values.get(name) for name in keys], list(values)))
            columns = zip(*rows) if rows else [[] for _ in arrow]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return deal(pages.select(id_col, html_col)).mapInArrow(read, schema)


def _values_in(parents: list[int | None], data: list[str | None], keys: dict[str, str]) -> dict[str, str | None]:
    children: dict[int, list] = {}
    for parent, text in zip(parents, data):
        if parent is not None:
            children.setdefault(parent, []).append(text)
    found = {}
    for name, key in keys.items():
        first = min((p for p, texts in children.items() if key in texts), default=None)
        if first is not None:
            found[name] = next((t for t in children[first] if t != key), None)
    return found


def html_values_for(elements: DataFrame, keys: dict[str, str]) -> DataFrame:
    """(page_id, one column per name): the values beside the given key texts.

    For a key, the first element with a direct child of that text is taken, and its
    first child of another text (NULL data counts as another) is the value. All keys
    are found in one pass: children shrink to one row per parent, then to one per page.
    """
    data = F.col("data")
    hits, values = [], []
    for name, key in keys.items():
        other = F.when(~data.eqNullSafe(F.lit(key)), F.struct("elem_id", "data"))
        hits.append(F.max(data.eqNullSafe(F.lit(key))).alias(f"hit_{name}"))
        hits.append(F.min(other).alias(f"other_{name}"))
        first = F.when(
            F.col(f"hit_{name}"),
            F.struct("parent_id", F.col(f"other_{name}.data").alias("value")),
        )
        values.append(F.min(first).alias(name))
    per_parent = (
        elements.filter("parent_id IS NOT NULL").groupBy("page_id", "parent_id").agg(*hits)
    )
    found = per_parent.filter(" OR ".join(f"hit_{name}" for name in keys))
    return found.groupBy("page_id").agg(*values).select(
        "page_id", *[F.col(f"{name}.value").alias(name) for name in keys]
    )


def html_value_for(elements: DataFrame, key: str) -> DataFrame:
    """(page_id, value) for the pages that have the key."""
    return html_values_for(elements, {"value": key})


def link_apps_to_jobs(
    apps: DataFrame,
    pages: DataFrame,
    app_key: str = "spark.app.id",
    job_key: str = "spark.tickloom.jobId",
    html_col: str = "html",
) -> DataFrame:
    """(app_id, sparkid, jobid) for each running app that has an environment page.

    ``pages`` holds one page per app, in the columns app_id and the HTML text.
    """
    wanted = pages.join(
        apps.filter(~F.col("completed")).select("app_id").distinct(), "app_id", "left_semi"
    )
    return page_values(wanted, {"sparkid": app_key, "jobid": job_key}, "app_id", html_col).drop("found")
