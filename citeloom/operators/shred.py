"""Nested documents (JSON or XML) shredded into columns with repetition and definition levels, and put together again
as flat tables, one for each repeated ancestor, that keep the links between parents and children.

Every field counts as optional and repeated: a lone value is a list of one, null and a missing field are an empty list.
So documents in which a field holds now an object, now a list of objects have one form. A list that is an element of a
list is an instance of its own, with its elements below it under the name []; so lists of lists have a level each. The
repetition level of an entry is the depth of the field that repeats with it (0 for a document's first entry), its definition
level is the number of fields of its path that are there.
"""

from __future__ import annotations

import json
import xml.etree.ElementTree as ElementTree
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.session import materialise, ship

#: The path of an XML element's attribute ends in @name, that of text beside child elements in #text.
INNER = "[]"
LEVELS = "array<struct<path:string,reps:array<int>,defs:array<int>,vals:array<string>>>"


def _xml(element: ElementTree.Element) -> object:
    text = element.text or ""
    out: dict[str, list] = {}
    for name, value in element.attrib.items():
        out.setdefault("@" + name.rpartition("}")[2], []).append(value)
    for child in element:
        if isinstance(child.tag, str):
            out.setdefault(child.tag.rpartition("}")[2], []).append(_xml(child))
    if not out:
        return text
    if text.strip():
        out["#text"] = [text]
    return out


def parse_document(text: str | None) -> object | None:
    """The document as nested dicts, lists and scalars, XML below its root's name; None if it is null or not readable."""
    if not text or not text.strip():
        return None
    try:
        if text.lstrip().startswith("<"):
            root = ElementTree.fromstring(text.lstrip())
            return {root.tag.rpartition("}")[2]: [_xml(root)]}
        return json.loads(text)
    except (ValueError, ElementTree.ParseError, RecursionError):
        return None


def _list(value: object) -> list:
    if value is None:
        return []
    if isinstance(value, list):
        return [{INNER: x} if isinstance(x, list) else x for x in value if x is not None]
    return [value]


def _scalar(value: object) -> str:
    return value if isinstance(value, str) else json.dumps(value)


@dataclass
class _Field:
    leaf: bool = False
    fields: dict[str, _Field] = field(default_factory=dict)


def _outline(values: list, into: _Field) -> None:
    for value in values:
        if isinstance(value, dict):
            for name, inner in value.items():
                _outline(_list(inner), into.fields.setdefault(name, _Field()))
        else:
            into.leaf = True


def shred_document(document: object) -> dict[tuple[str, ...], tuple[list[int], list[int], list[str | None]]]:
    """path -> (repetition levels, definition levels, values): a column for each leaf path of the document.

    A field that holds scalars in one place and objects in another has a column of its own beside those of its fields.
    A path has an entry for each instance of its parent, with a null value where the field is missing there, so that
    the columns of one ancestor run in step.
    """
    columns: dict[tuple[str, ...], tuple[list[int], list[int], list[str | None]]] = {}

    def put(path: tuple[str, ...], rep: int, defined: int, value: str | None) -> None:
        reps, defs, values = columns.setdefault(path, ([], [], []))
        reps.append(rep)
        defs.append(defined)
        values.append(value)

    def absent(outline: _Field, path: tuple[str, ...], rep: int, defined: int) -> None:
        if outline.leaf:
            put(path, rep, defined, None)
        for name, inner in outline.fields.items():
            absent(inner, (*path, name), rep, defined)

    def write(outline: _Field, path: tuple[str, ...], values: list, rep: int) -> None:
        depth = len(path)
        if not values:
            absent(outline, path, rep, depth - 1)
        for i, value in enumerate(values):
            here, group = (depth if i else rep), isinstance(value, dict)
            if outline.leaf:
                put(path, here, depth, None if group else _scalar(value))
            for name, inner in outline.fields.items():
                if group:
                    write(inner, (*path, name), _list(value.get(name)), here)
                else:
                    absent(inner, (*path, name), here, depth)

    roots = [x for x in _list(document) if isinstance(x, dict)]
    outline = _Field()
    _outline(roots, outline)
    for i, root in enumerate(roots):
        for name, inner in outline.fields.items():
            # Several roots in one text are documents of one list: the level 0 starts each.
            write(inner, (name,), _list(root.get(name)), 0 if i == 0 else 1)
    return columns


def rebuild_document(columns: dict[tuple[str, ...], tuple[list[int], list[int], list[str | None]]]) -> list[dict]:
    """The instances of the top fields from their columns, as nested dicts of lists of texts: the way back, for checks."""
    out: list[dict] = []
    for path, (reps, defs, values) in columns.items():
        top: dict = {}
        at: list[int] = [-1] * (len(path) + 1)
        for rep, defined, value in zip(reps, defs, values, strict=True):
            level = max(rep, 1)
            at[level] += 1
            at[level + 1 :] = [0] * (len(path) - level)
            node = top
            for depth in range(1, defined + 1):
                items = node.setdefault(path[depth - 1], [])
                while len(items) <= at[depth]:
                    items.append({})
                if depth == defined == len(path):
                    if value is not None:
                        items[at[depth]] = value
                else:
                    node = items[at[depth]]
                    if not isinstance(node, dict):
                        break
        out.append(top)
    return out


def shred_levels(df: DataFrame, payload: str, out: str = "levels", readable: str = "readable") -> DataFrame:
    """df without payload, with the shredded columns of each document (LEVELS) and whether it could be read.

    Null, empty, blank and broken payloads give an empty list and readable = false; a document without leaves gives an
    empty list and true. Repeated rows stay repeated. Columns named out and readable are replaced. Documents are shredded
    where they are, without a shuffle.
    """
    ship(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name not in (payload, out, readable)]
    schema = T.StructType([*kept, *T._parse_datatype_string(f"{out} {LEVELS}, {readable} boolean").fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            levels, good = [], []
            for text in batch["__payload"]:
                document = parse_document(text)
                try:
                    columns = shred_document(document) if document is not None else {}
                except RecursionError:
                    document, columns = None, {}
                levels.append([{"path": ".".join(path), "reps": r, "defs": d, "vals": v} for path, (r, d, v) in columns.items()])
                good.append(document is not None)
            yield batch.drop(columns="__payload").assign(**{out: levels, readable: good})

    return df.select(*(F.col(f"`{f.name}`") for f in kept), F.col(payload).cast("string").alias("__payload")).mapInPandas(run, schema)


@dataclass(frozen=True)
class Link:
    """A flat table of parents and children below a repeated ancestor.

    ancestor: path of the instances within which parent and child belong together. parent, child: leaf paths below it.
    root, key: path of the instances that carry the record's key, and the leaf path of the key.
    """

    table: str
    root: str
    key: str
    ancestor: str
    parent: str | None
    child: str


def _ordinals(reps: list[int], depth: int) -> list[int]:
    """Of each entry the number of the ancestor instance at this depth: a new one begins where the level is not deeper."""
    out, n = [], -1
    for rep in reps:
        n += rep <= depth
        out.append(n)
    return out


def _depth(path: str) -> int:
    return path.count(".") + 1


def _shared_depth(a: str, b: str) -> int:
    """The number of fields that both paths begin with, the last ones left out: those are the values, no instances."""
    n = 0
    for x, y in zip(a.split(".")[:-1], b.split(".")[:-1], strict=False):
        if x != y:
            break
        n += 1
    return n


@dataclass(frozen=True)
class FlatTable:
    """A flat table of the instances of a repeated field.

    path: the field whose instances are the rows. parent: the path of the table they link to, above path, or None for the
    document. values: name -> leaf path below path; the first value of the instance counts, null where it has none.
    """

    name: str
    path: str
    parent: str | None
    values: dict[str, str] = field(default_factory=dict, hash=False)


def table_rows(levels: list[dict], tables: tuple[FlatTable, ...]) -> list[tuple[str, int, int | None, dict[str, str | None]]]:
    """(table, number, number of the parent row, values) from the level sequences.

    Instances are numbered from 0 through the document in the order of the level sequences. All columns below a field run in
    step with its instances, so any of them gives the same numbers; a number that is missing is an instance that is not
    there, of which a column only says so.
    """
    columns = {c["path"]: (list(c["reps"]), list(c["defs"]), list(c["vals"])) for c in levels}
    out: list[tuple[str, int, int | None, dict[str, str | None]]] = []
    for table in tables:
        depth, above = _depth(table.path), _depth(table.parent) if table.parent is not None else 0
        rows: dict[int, tuple[int | None, dict[str, str | None]]] = {}
        for path, (reps, defs, _) in columns.items():
            if path == table.path or path.startswith(table.path + "."):
                for n, parent, defined in zip(_ordinals(reps, depth), _ordinals(reps, above), defs, strict=True):
                    if defined >= depth and n not in rows:
                        rows[n] = (parent if table.parent is not None else None, dict.fromkeys(table.values))
        for name, path in table.values.items():
            if path in columns:
                reps, _, values = columns[path]
                for n, value in zip(_ordinals(reps, depth), values, strict=True):
                    if value is not None and rows[n][1][name] is None:
                        rows[n][1][name] = value
        out += [(table.name, n, *rows[n]) for n in sorted(rows)]
    return out


def flat_tables(shredded: DataFrame, tables: tuple[FlatTable, ...], keep: list[str], levels: str = "levels") -> dict[str, DataFrame]:
    """name -> keep, row_no, parent_no and the values of each table: the related flat tables of the documents.

    (keep, parent_no) of a table is (keep, row_no) of the table it links to. Documents are put together where they are,
    without a shuffle, once for all tables, whose rows are written to the shared folder; those that could not be read give no row, and a table none of whose fields occurs is empty. Names of
    values must not be those of keep.
    """
    ship(shredded.sparkSession)
    kept = [shredded.schema[c] for c in keep]
    schema = T.StructType([*kept, *T._parse_datatype_string("rows array<struct<table:string,row_no:int,parent_no:int,vals:map<string,string>>>").fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [[{"table": t, "row_no": n, "parent_no": p, "vals": v} for t, n, p, v in table_rows(list(document), tables)] for document in batch[levels]]
            yield batch.drop(columns=levels).assign(rows=rows)

    every = materialise(shredded.select(*keep, levels).mapInPandas(run, schema).select(*keep, F.explode("rows").alias("__r")))
    names = {table.name: table.values for table in tables}
    return {name: every.filter(F.col("__r.table") == name).select(*keep, F.col("__r.row_no").alias("row_no"), F.col("__r.parent_no").alias("parent_no"), *(F.col("__r.vals")[v].alias(v) for v in values)) for name, values in names.items()}


def link_rows(levels: list[dict], links: tuple[Link, ...]) -> list[tuple]:
    """(table, key, root instance, ancestor instance, position, parent value, child value) from the level sequences.

    A parent without name has a null value. A child is paired with the parent values of the deepest instance that the two
    paths have in common, which is the ancestor's or lies below it; where that holds several, with each of them.
    """
    columns = {c["path"]: (list(c["reps"]), list(c["defs"]), list(c["vals"])) for c in levels}
    out: list[tuple] = []
    for link in links:
        if link.key not in columns or link.child not in columns:
            continue
        reps, _, values = columns[link.key]
        keys: dict[int, str] = {}
        for n, value in zip(_ordinals(reps, _depth(link.root)), values, strict=True):
            if value is not None:
                keys.setdefault(n, value)
        depth = _depth(link.ancestor)
        shared = max(depth, _shared_depth(link.parent, link.child)) if link.parent is not None else depth
        parents: dict[int, list[str]] = {}
        if link.parent is not None and link.parent in columns:
            reps, _, values = columns[link.parent]
            for n, value in zip(_ordinals(reps, shared), values, strict=True):
                if value is not None:
                    parents.setdefault(n, []).append(value)
        reps, defs, values = columns[link.child]
        roots = _ordinals(reps, _depth(link.root))
        for position, (root, n, common, defined, value) in enumerate(zip(roots, _ordinals(reps, depth), _ordinals(reps, shared), defs, values, strict=True)):
            if defined >= depth and value is not None and root in keys:
                for parent in parents.get(common) or [None]:
                    out.append((link.table, keys[root], root, n, position, parent, value))
    return out


def assemble_links(shredded: DataFrame, links: tuple[Link, ...], keep: list[str], levels: str = "levels") -> DataFrame:
    """keep, key, root_no, rows: for each record and each of its root instances the rows of all linked tables.

    rows is an array of (table, ancestor_no, position, parent, child). A root instance with a key but no row gives an
    empty array, so that an empty later delivery replaces an earlier one. Values are as delivered.
    """
    ship(shredded.sparkSession)
    kept = [shredded.schema[c] for c in keep]
    schema = T.StructType([*kept, *T._parse_datatype_string("key string, root_no int, rows array<struct<table:string,ancestor_no:int,position:int,parent:string,child:string>>").fields])
    key_links = tuple({link.root: Link("", link.root, link.key, link.root, None, link.key) for link in links}.values())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for row in batch.itertuples(index=False, name=None):
                document = list(row[-1])
                found: dict[tuple[str, int], list[dict]] = {(key, root): [] for _, key, root, *_ in link_rows(document, key_links)}
                for table, key, root, n, position, parent, child in link_rows(document, links):
                    found.setdefault((key, root), []).append({"table": table, "ancestor_no": n, "position": position, "parent": parent, "child": child})
                out += [(*row[:-1], key, root, rows) for (key, root), rows in found.items()]
            yield pd.DataFrame(out, columns=schema.names)

    return shredded.select(*keep, levels).mapInPandas(run, schema)


def latest_rows(assembled: DataFrame, order: list[str]) -> DataFrame:
    """key, table, ancestor_no, position, parent, child of each key's latest delivery only.

    order: the columns by which deliveries are compared, the last to decide a tie; a null is earlier than any value.
    Keys are trimmed; a null, blank or literal NULL key gives no row. Each delivery travels once, as one row.
    """
    key = F.trim(F.regexp_replace("key", r"^[\s ]+|[\s ]+$", ""))
    one = assembled.withColumn("key", key).filter("key != '' and upper(key) != 'NULL'").groupBy("key").agg(F.max_by("rows", F.struct(*order, "root_no")).alias("rows"))
    return one.select("key", F.explode("rows").alias("r")).select("key", "r.table", "r.ancestor_no", "r.position", "r.parent", "r.child")
