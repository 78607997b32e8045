from __future__ import annotations

import json
from datetime import datetime

from hypothesis import given, settings
from hypothesis import strategies as st

from citeloom.operators.shred import FlatTable, Link, assemble_links, flat_tables, latest_rows, parse_document, rebuild_document, shred_document, shred_levels, table_rows
from citeloom.plans.problems import study_links, study_tables

names = st.sampled_from(["a", "b", "c", "d"])
scalars = st.one_of(st.text(max_size=4), st.integers(-3, 3), st.booleans())
documents = st.recursive(scalars, lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(names, x, max_size=3), st.none()), max_leaves=12)


def lists(value):
    """The form in which every field is a list and every scalar a text, without empty branches."""
    if value is None:
        return []
    if isinstance(value, list):
        return [y for x in value for y in (([{"[]": lists(x)}] if lists(x) else [{}]) if isinstance(x, list) else lists(x))]
    if isinstance(value, dict):
        return [{k: lists(v) for k, v in value.items() if lists(v)}]
    return [value if isinstance(value, str) else json.dumps(value)]


def leaves(node, path=()):
    if isinstance(node, dict):
        for k, v in node.items():
            for i, x in enumerate(v):
                yield from leaves(x, (*path, (k, i)))
    elif node is not None:
        yield path, node


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(names, documents, max_size=3))
def test_levels_give_back_every_leaf_at_its_place(document):
    columns = shred_document(document)
    got = {x for part in rebuild_document(columns) for x in leaves(part)}
    assert got == {x for x in leaves(lists(document)[0] if lists(document) else {})}
    for path, (reps, defs, values) in columns.items():
        assert reps[0] == 0
        assert all(0 <= r <= len(path) and 0 <= d <= len(path) for r, d in zip(reps, defs, strict=True))
        assert all((v is None) or d == len(path) for d, v in zip(defs, values, strict=True))


def test_levels_of_the_classic_case():
    document = {"name": [{"language": [{"code": "en-us", "country": "us"}, {"code": "en"}], "url": "A"}, {"url": "B"}, {"language": [{"code": "en-gb", "country": "gb"}]}]}
    columns = shred_document(document)
    assert columns[("name", "language", "code")] == ([0, 2, 1, 1], [3, 3, 1, 3], ["en-us", "en", None, "en-gb"])
    assert columns[("name", "language", "country")] == ([0, 2, 1, 1], [3, 2, 1, 3], ["us", None, None, "gb"])
    assert columns[("name", "url")] == ([0, 1, 1], [2, 2, 1], ["A", "B", None])


def test_unreadable_documents():
    assert parse_document(None) is None
    for text in ("", "  ", "{", "<a>", "{'a': 1}", "<a></b>", "[" * 100_000):
        assert parse_document(text) is None
    assert parse_document("<x:a xmlns:x='u'><b k='1'>t<c/></b></x:a>") == {"a": [{"b": [{"@k": ["1"], "c": [""], "#text": ["t"]}]}]}


LINK = (Link("t", "s", "s.id", "s.i", "s.i.n", "s.i.l"),)


def test_tables_keep_their_links(spark, rows):
    at = datetime(2020, 1, 1)
    docs = [
        (1, at, json.dumps({"s": {"id": " K1 ", "i": [{"n": "A", "l": ["x", "y"]}, {"n": None, "l": "z"}, {"n": "B", "l": None}]}}), "c"),
        (2, datetime(2021, 1, 1), "broken{", "c"),
        (3, None, json.dumps({"s": {"id": "K1"}}), "c"),
        (4, at, json.dumps({"s": [{"id": "K2", "i": {"n": "A", "l": "q"}}, {"id": "K3", "i": {"n": "A", "l": "r"}}]}), "c"),
        (5, at, None, "c"),
        (6, at, json.dumps({"s": {"id": "NULL", "i": {"n": "A", "l": "q"}}}), "c"),
    ]
    df = spark.createDataFrame(docs, "record_id long, at timestamp, payload string, levels string")
    shredded = shred_levels(df, "payload")
    assert rows(shredded.select("record_id", "readable")) == [(1, True), (2, False), (3, True), (4, True), (5, False), (6, True)]
    found = latest_rows(assemble_links(shredded, LINK, ["record_id", "at"]), ["at", "record_id"])
    got = rows(found.select("key", "table", "ancestor_no", "parent", "child"))
    assert got == sorted([("K1", "t", 0, "A", "x"), ("K1", "t", 0, "A", "y"), ("K1", "t", 1, None, "z"), ("K2", "t", 0, "A", "q"), ("K3", "t", 1, "A", "r")], key=repr)


def test_an_empty_later_delivery_replaces(spark, rows):
    docs = [(1, datetime(2020, 1, 1), json.dumps({"s": {"id": "K", "i": {"n": "A", "l": "q"}}})), (2, datetime(2021, 1, 1), json.dumps({"s": {"id": "K", "i": []}}))]
    df = spark.createDataFrame(docs, "record_id long, at timestamp, payload string")
    assert rows(latest_rows(assemble_links(shred_levels(df, "payload"), LINK, ["record_id", "at"]), ["at", "record_id"])) == []
    assert rows(latest_rows(assemble_links(shred_levels(df.limit(0), "payload"), LINK, ["record_id", "at"]), ["at", "record_id"])) == []


def test_layouts_cover_both_directions_of_labels():
    tables = {(x.root, x.table.split("#")[0]) for x in study_links()}
    assert {r for r, _ in tables} == {"clinical_study", "batch.studies", "study", "clinical_study_v3"}
    assert all((r, t) in tables for r in ("clinical_study", "study", "clinical_study_v3") for t in ("ct_interventions", "ct_intervention_arm_group_labels", "ct_location_investigators"))


def test_lists_of_lists_keep_their_levels():
    """[[1, 2], [3]] is not [1, 2, 3], nor [[1], [2, 3]]; empty and null elements are none."""
    shapes = [[[1, 2], [3]], [1, 2, 3], [[1], [2, 3]], [[[1], [2]], [[3]]]]
    shredded = [shred_document({"a": x}) for x in shapes]
    assert all(x != y for i, x in enumerate(shredded) for y in shredded[:i])
    assert shredded[0] == {("a", "[]"): ([0, 2, 1], [2, 2, 2], ["1", "2", "3"])}
    assert shred_document({"a": [[1], None, []]}) == {("a", "[]"): ([0, 1], [2, 1], ["1", None])}


DOCS = [
    {"s": [{"id": "x", "i": [{"n": "a", "l": ["p", "q"]}, {"l": "r"}], "o": {"v": [{"w": "z"}, {}]}}, {"i": {"n": "b"}}]},
    {"s": {"id": "y"}}, {"t": 1}, {"s": []}, {"s": [{"id": "k", "i": []}, {"id": "m", "i": [{"n": None}, {"n": "c", "l": None}]}]},
]
TABLES = (
    FlatTable("study", "s", None, {"id": "s.id"}), FlatTable("item", "s.i", "s", {"n": "s.i.n"}), FlatTable("label", "s.i.l", "s.i", {"l": "s.i.l"}), FlatTable("view", "s.o.v", "s", {"w": "s.o.v.w"}),
)


def listed(x):
    return [] if x is None else x if isinstance(x, list) else [x]


def walked(document):
    """The rows by walking the document: (table, the row's value, the parent's value) in order."""
    out = []
    for s in listed(document.get("s")):
        out.append(("study", s.get("id"), None))
        for i in listed(s.get("i")):
            out.append(("item", i.get("n"), s.get("id")))
            out += [("label", label, i.get("n")) for label in listed(i.get("l"))]
        for o in listed(s.get("o")):
            out += [("view", v.get("w"), s.get("id")) for v in listed(o.get("v")) if v]
    return sorted(out, key=repr)


def test_flat_tables_against_a_walk(spark):
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(DOCS)] + [(90, None), (91, "{broken")], "rec int, payload string")
    tables = {n: t.collect() for n, t in flat_tables(shred_levels(df, "payload"), TABLES, ["rec"]).items()}
    assert set(tables) == {"study", "item", "label", "view"}
    value = {(n, r["rec"], r["row_no"]): r[3] for n, rows in tables.items() for r in rows}
    above = {"study": None, "item": "study", "label": "item", "view": "study"}
    for rec, document in enumerate(DOCS):
        got = [(n, r[3], value[(above[n], rec, r["parent_no"])] if above[n] else None) for n, rows in tables.items() for r in rows if r["rec"] == rec and not (n == "view" and r[3] is None)]
        assert sorted(got, key=repr) == walked(document), rec
    assert not any(r["rec"] > 80 for rows in tables.values() for r in rows)
    assert table_rows([], TABLES) == []


def flat(document):
    levels = [{"path": ".".join(path), "reps": r, "defs": d, "vals": v} for path, (r, d, v) in shred_document(document).items()]
    return [(table, row, parent, *values.values()) for table, row, parent, values in table_rows(levels, study_tables())]


def test_every_layout_has_its_flat_tables():
    held, paths = {leaf for t in study_tables() for leaf in t.values.values()}, {t.path for t in study_tables()}
    assert {leaf for link in study_links() for leaf in (link.key, link.parent, link.child) if leaf} <= held
    assert all(t.parent is None or t.parent in paths for t in study_tables())
    third = {"study": {"protocol": {
        "identification": {"nct_id": "N3"}, "arms_interventions": {"arm_groups": [{"arm_group_label": "A"}], "interventions": [{"intervention_name": "x"}, {"intervention_name": "y", "arm_group_labels": [{"arm_group_label": "A", "seq": 0}]}]},
        "contacts_locations": {"locations": [{"place": {"city": "c"}, "investigators": []}, {"facility": {"name": "f"}, "investigators": {"name": {"investigator_last_name": "l"}}}]},
    }}}
    assert flat(third) == [
        ("studies_3", 0, None, "N3"), ("arm_groups_3", 0, 0, "A"), ("interventions_3", 0, 0, "x"), ("interventions_3", 1, 0, "y"), ("labels_3", 1, 1, "A"),
        ("locations_3", 0, 0, None), ("locations_3", 1, 0, "f"), ("investigators_3", 1, 1, "l"),
    ]
    fourth = {"clinical_study_v3": {
        "nct_id": "N4", "design": {"arm_groups": [{"arm_group_label": "A"}, {"arm_group_label": "B", "interventions": [{"intervention_name": "x"}]}], "unassigned_interventions": [{"intervention_name": "y"}]},
        "sites": [{"facility": {"name": "f"}, "staff": {"investigators": [{"last_name": "k"}, {"last_name": "l"}]}}],
    }}
    assert flat(fourth) == [
        ("studies_4", 0, None, "N4"), ("arm_groups_4", 0, 0, "A"), ("arm_groups_4", 1, 0, "B"), ("interventions_4", 1, 1, "x"), ("unassigned_interventions_4", 0, 0, "y"),
        ("locations_4", 0, 0, "f"), ("investigators_4", 0, 0, "k"), ("investigators_4", 1, 0, "l"),
    ]
