"""Elements of pages as columns: every page is read once, and its fields are selected from the elements."""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.markup import Reader, clean

NODE = "struct<tag: string, classes: array<string>, depth: int, nr: int, last: int, href: string, text: string, inner: string>"
_KINDS = [("tag", pa.string()), ("classes", pa.list_(pa.string())), ("depth", pa.int32()), ("nr", pa.int32()),
          ("last", pa.int32()), ("href", pa.string()), ("text", pa.string()), ("inner", pa.string())]
ROWS = 64                      # pages whose elements are held at once


def _lists(groups: list[list[list]]) -> pa.Array:
    """One list of elements for each group."""
    flat = [n for g in groups for n in g]
    offsets = [0]
    for g in groups:
        offsets.append(offsets[-1] + len(g))
    columns = list(zip(*flat)) if flat else [()] * len(_KINDS)
    structs = pa.StructArray.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, _KINDS)], [n for n, _ in _KINDS])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs)


def _within(nodes: list[list], root: list) -> list[list]:
    """The elements inside root, numbered from its own place."""
    first = root[3] + 1
    return [[*n[:3], n[3] - first, n[4] - first, *n[5:]] for n in nodes[first:root[4] + 1]]


def _emit(boxes: list[str], leaves: list[str], root: str | None, whole: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader([*boxes, *([root] if root else [])], leaves)
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            row, pos, groups, texts = [], [], [], []
            for k, page in enumerate(batch.column("_html").to_pylist()):
                nodes, pieces = reader.read(page or "")
                if root is None:
                    row.append(k)
                    groups.append(nodes)
                    texts.append(clean(pieces, " ") if whole else "")
                    continue
                name = root.removeprefix(".")
                roots = [n for n in nodes if (name in n[1] if root[0] == "." else n[0] == name)]
                row += [k] * len(roots)
                pos += range(1, len(roots) + 1)
                groups += [_within(nodes, n) for n in roots]
            out = [batch.column("_row").take(pa.array(row, pa.int64())), _lists(groups)]
            names = ["_row", "nodes"]
            if root is not None:
                out, names = [*out, pa.array(pos, pa.int32())], [*names, "pos"]
            elif whole:
                out, names = [*out, pa.array(texts, pa.string())], [*names, whole]
            yield pa.RecordBatch.from_arrays(out, names)
    return run


def _read(pages: DataFrame, html: str, boxes: list[str], leaves: list[str], root: str | None, whole: str | None,
          more: list[T.StructField]) -> DataFrame:
    others = [c for c in pages.columns if c != html]
    packed = pages.select(F.struct(*others).alias("_row"), F.col(html).alias("_html"))
    node = T.StructField("nodes", T._parse_datatype_string(f"array<{NODE}>"))
    schema = T.StructType([packed.schema["_row"], node, *more])
    read = packed.mapInArrow(_emit(boxes, leaves, root, whole), schema)
    return read.select("_row.*", *(f.name for f in more), "nodes")


def elements(pages: DataFrame, boxes: list[str], leaves: list[str], html: str = "html", whole: str | None = None) -> DataFrame:
    """The other columns of pages and nodes, the wanted elements of the page in order. `whole` names a further column
    for the text of the page, tags as blanks. A null page has no elements."""
    return _read(pages, html, boxes, leaves, None, whole, [T.StructField(whole, T.StringType())] if whole else [])


def records(pages: DataFrame, root: str, leaves: list[str], html: str = "html") -> DataFrame:
    """One row for each element `root` of a page: the page's other columns, pos (from 1) and the nodes within it."""
    return _read(pages, html, [], leaves, root, None, [T.StructField("pos", T.IntegerType())])


def having(nodes: Column, *, tag: str | None = None, of: str | None = None, within: Column | None = None) -> Column:
    """The elements of a tag, of a class, inside another element (none, where that is null)."""
    def wanted(n: Column) -> Column:
        test = F.lit(True)
        if tag is not None:
            test = test & (n["tag"] == tag)
        if of is not None:
            test = test & F.array_contains(n["classes"], of)
        if within is not None:
            test = test & (n["nr"] > within["nr"]) & (n["nr"] <= within["last"])
        return test
    return F.filter(nodes, wanted)


def first(nodes: Column) -> Column:
    return F.get(nodes, F.lit(0))
