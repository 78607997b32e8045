"""Load semantics, scalar functions, sources and streams."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from citeloom.functions import scalars as C
from citeloom.operators import relational as R
from citeloom.sources import io
from citeloom.sources.xmlrows import TableSpec, parse_xml, read_xml, shred, upsert_documents
from citeloom.streaming import feed


def test_upsert_family(spark, rows):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    delta = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 1)], "k long, v string, seq int")
    assert rows(R.upsert(base, delta, ["k"], "seq")) == [(1, "a"), (2, "y"), (3, "z")]
    assert rows(R.insert_ignore(base, delta.filter("seq = 1"), ["k"])) == [(1, "a"), (2, "b"), (3, "z")]
    s = base.withColumn("status", F.lit("current"))
    assert rows(R.expire_and_upsert(s, delta.filter("seq = 2"), ["k"])) == [(1, "a", "expired"), (2, "y", "current")]
    assert rows(R.exists_flag(base, delta, ["k"], "seen").select("k", "seen")) == [(1, False), (2, True)]
    assert rows(R.upsert(base, delta.limit(0), ["k"], "seq")) == [(1, "a"), (2, "b")]


FEED = [
    ("o1", "A", "a", "2000-01-01", 1, "self"),
    ("o2", "A", "B", None, 2, "no_valid_dating"),
    ("o3", "A", "B", "2999-01-01", 3, "no_valid_dating"),
    ("o4", "A", "B", "2000-01-01", 4, "main"),
    ("o4", "A", "B", "2000-01-01", 5, "exact_repeat"),
    ("o4", "A", "B", "2001-01-01", 6, "duplicate"),
    ("o5", "b", "a", "2000-01-01", 7, "looping"),
    ("o6", "a", "b", "2000-01-01", 8, "parallel"),
    ("o7", "C", "B", "2000-01-01", 9, "main"),
]


def test_triage(spark):
    df = spark.createDataFrame([r[:5] for r in FEED], "oci string, citing string, cited string, creation string, seq int")
    assert {r["seq"]: r["route"] for r in R.triage_citations(df).collect()} == {r[4]: r[5] for r in FEED}


def test_fuzzy_against_brute_force(spark):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
            row = new
        return row[-1]

    a = ["naltrexone", "nalterxone", "x", "", "ab", "imatinib", "abc"]
    b = ["naltrexon", "imatanib", "imatinab", "abcd", "y", "b"]
    got = {r["a"]: (r["b"], r["distance"]) for r in R.fuzzy_match(spark.createDataFrame([(x,) for x in a], "a string"), spark.createDataFrame([(x,) for x in b], "b string"), "a", "b", 1).collect()}
    want = {x: min(((distance(x, y), y) for y in b if distance(x, y) <= 1), default=None) for x in a}
    assert got == {x: (w[1], w[0]) for x, w in want.items() if w}


def test_scalars(spark):
    df = spark.createDataFrame([("-P1Y2M3D", "2020-02", "12p.", "1701;1702"), ("P3D", "2020-13-01", "xii", "17"), (None, None, None, None)], "i string, d string, p string, c string")
    got = df.select(C.iso_interval(F.col("i")).alias("i"), C.extract_year(F.col("d")), C.extract_month(F.col("d")), C.iso_date(F.col("d")), C.page_count(F.col("p")), C.class_code(F.col("c"))).collect()
    assert [tuple(r["i"]) if r["i"] else None for r in got] == [(-14, -3, 0.0), (0, 3, 0.0), None]
    assert [tuple(r[1:]) for r in got] == [(2020, 2, None, 12, "1701"), (2020, 13, None, None, None), (None,) * 5]
    times = spark.createDataFrame([("PT1H2M3.5S",), ("-P1DT2M",), ("P",), ("P1DT",), ("PT",), ("P2M",)], "i string").select(C.iso_interval(F.col("i")).alias("i")).collect()
    assert [tuple(r["i"]) if r["i"] else None for r in times] == [(0, 0, 3723.5), (0, -1, -120.0), None, None, None, (2, 0, 0.0)]
    dates = spark.createDataFrame([(2020, 0, 0), (2020, 2, 30), (None, 1, 1), (2020, None, 5)], "y int, m int, d int")
    assert [str(r[0]) for r in dates.select(C.try_parse(F.col("y"), F.col("m"), F.col("d"))).collect()] == ["2020-01-01", "None", "None", "2020-01-05"]


def test_files(spark, rows, tmp_path):
    df = spark.createDataFrame([(1, "a,b", None), (2, "", "x")], "k long, v string, w string")
    io.write_delimited(df, str(tmp_path / "csv"), sep="~")
    back = io.read_delimited(spark, str(tmp_path / "csv"), "k long, v string, w string", sep="~", null="NA")
    assert back.filter("w is null").count() == 1
    (tmp_path / "e.tsv").write_text("1\t2\n2\t3\n")
    assert rows(io.read_edges(spark, str(tmp_path / "e.tsv"))) == [(1, 2), (2, 3)]
    (tmp_path / "p.csv").write_bytes(b'a,b,c\n"x, y",caf\xe9,1\n')
    assert rows(io.read_columns(spark, str(tmp_path / "p.csv"), ["a", "b"])) == [("x y", "café")]
    (tmp_path / "c.txt").write_text("5 6 7\n1 9\n")
    assert rows(io.read_clustering(spark, str(tmp_path / "c.txt"), "lines")) == [(1, 1), (1, 9), (5, 5), (5, 6), (5, 7)]
    e = spark.createDataFrame([(10, 20), (20, 30)], "citing long, cited long")
    io.export_metis(e, str(tmp_path / "metis"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "metis/body")).collect()) == ["1 3", "2", "2"]
    io.export_graph(e.select(F.col("citing").alias("node")), e, str(tmp_path / "graph"))
    assert spark.read.option("header", True).csv(str(tmp_path / "graph/edges")).columns == [":START_ID", ":END_ID", ":TYPE"]
    docs = spark.createDataFrame([(1, "see 10.1000/xyz-1 and doi:10.1234/ab.c"), (2, None)], "k long, t string")
    assert rows(io.extract_dois(docs, "k", "t")) == [(1, "10.1000/xyz-1"), (1, "10.1234/ab.c")]


XML = "<item><id>7</id><head><author seq='1'><name>Ann</name></author><author seq='2'><name>Bo</name></author></head><ref><to>8</to></ref><ref><to>7</to></ref><ref><to>8</to></ref></item>"
SCHEMA = "id long, head struct<author:array<struct<_seq:int,name:string>>>, ref array<struct<to:long>>"
SPEC = {
    "publications": TableSpec("", {"pub": "id"}, ("pub",)),
    "authors": TableSpec("head.author", {"pub": "id", "place": "pos", "name": "r.name"}),
    "references": TableSpec("ref", {"pub": "id", "ref": "r.to"}, ("pub", "ref"), where="r.to <> id"),
}


def test_xml_shredding(spark, rows, tmp_path):
    (tmp_path / "d.xml").write_text(f"<root>{XML}</root>")
    for docs in (read_xml(spark, str(tmp_path / "d.xml"), "item", SCHEMA), parse_xml(spark.createDataFrame([(XML,), (None,)], "x string"), "x", SCHEMA).select("doc.*").filter("id is not null")):
        out = shred(docs, SPEC)
        assert rows(out["publications"]) == [(7,)]
        assert rows(out["authors"]) == [(7, 1, "Ann"), (7, 2, "Bo")]
        assert rows(out["references"]) == [(7, 8)]
        assert list(shred(docs, SPEC, ["authors"])) == ["authors"]


def test_streams(spark, rows, tmp_path):
    more = [("o7", "X", "Y", "2000-01-01", 10, "duplicate"), ("o8", "B", "A", "2000-01-01", 11, "looping"), ("o5", "b", "a", "2000-01-01", 12, "exact_repeat")]
    df = spark.createDataFrame([r[:5] for r in FEED + more], "oci string, citing string, cited string, creation string, seq int").coalesce(1)
    assert {r["seq"]: r["route"] for r in R.triage_citations(df).collect()} == {r[4]: r[5] for r in FEED + more}
    df.filter("seq <= 5").write.parquet(str(tmp_path / "in"))
    df.filter("seq > 5").write.mode("append").parquet(str(tmp_path / "in"))

    def routed(source, name):
        out = str(tmp_path / name)
        q = source.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-cp").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.parquet(out)

    first = routed(feed.route_ids(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))), "first")
    first.filter("route is null").coalesce(1).write.parquet(str(tmp_path / "passed"))
    second = routed(feed.route_pairs(spark.readStream.schema(first.schema).parquet(str(tmp_path / "passed"))), "second")
    got = first.filter("route is not null").select("seq", "route").unionByName(second.select("seq", "route"))
    assert {r["seq"]: r["route"] for r in got.collect()} == {r[4]: r[5] for r in FEED + more}
    seq = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k long, v string, seq int").coalesce(1)
    seq.write.parquet(str(tmp_path / "in2"))
    spark.createDataFrame([(2, "d", 3), (3, "e", 1)], seq.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in2"))
    q = feed.upsert_stream(spark.readStream.schema(seq.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in2")), str(tmp_path / "out"), ["k"], "seq", str(tmp_path / "cp2"))
    q.awaitTermination()
    assert rows(feed.read_upserted(spark, str(tmp_path / "out"))) == [(1, "b", 2), (2, "d", 3), (3, "e", 1)]
    events = spark.createDataFrame([("2020-01-01 00:10:00", "x"), ("2020-01-01 00:20:00", "x"), ("2020-01-01 02:00:00", "y")], "t string, kind string").select(F.to_timestamp("t").alias("t"), "kind").coalesce(1)
    events.write.parquet(str(tmp_path / "in3"))
    counts = feed.windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in3")), "t", ["kind"])
    q = counts.writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["kind"], r["n"]) for r in spark.table("counted").collect()) == [("x", 2), ("y", 1)]


def test_tables(spark, rows):
    spark.sql("DROP TABLE IF EXISTS swap_me")
    io.save_table(spark.createDataFrame([(1,), (2,)], "k long"), "swap_me")
    io.replace_table(spark, "swap_me", lambda d: d.filter("k = 2"))
    assert rows(spark.table("swap_me")) == [(2,)]
    spark.sql("DROP TABLE swap_me")


def test_label_files_and_plain_upserts(spark, rows, tmp_path):
    (tmp_path / "labels.txt").write_text("5\n7\n\n5\n")
    assert rows(io.read_clustering(spark, str(tmp_path / "labels.txt"), "labels")) == [(5, 1), (5, 4), (7, 2)]
    base, delta = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (2, "d"), (2, "d"), (3, None)], "k int, v string")
    assert rows(R.upsert(base, delta, ["k"])) == [(1, "a"), (2, "d"), (3, None)]


def test_tiles_and_numbers(spark, rows):
    df = spark.createDataFrame([(i * 7 % 23,) for i in range(23)], "x int")
    assert dict(rows(R.numbered(df, ["x"], "n"))) == {i: i + 1 for i in range(23)}
    for n in (1, 4, 23, 40):
        want = dict(rows(df.select("x", F.ntile(n).over(Window.orderBy("x")))))
        assert dict(rows(R.tiles(df, ["x"], n, "t"))) == want


def test_ids_flags_and_text_join(spark, rows):
    df = spark.createDataFrame([(1, "a b  a"), (2, None), (3, ""), (None, "z")], "o int, ids string")
    assert rows(R.explode_ids(df, "o", "ids", "x:")) == [("x:1", "a"), ("x:1", "b")]
    grants = spark.createDataFrame([(1, "R01DA1"), (1, "R01CA1"), (2, "R01CA2")], "k int, number string")
    keys = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    assert rows(R.support_flags(keys, "k", grants, "number", "DA", "da", "other")) == [(1, True, True), (2, False, True), (3, False, False)]
    texts = spark.createDataFrame([(1, "A Trial of Plain-Words"), (2, "plain trial"), (3, None)], "id int, t string")
    phrases = spark.createDataFrame([("plain words",), ("trial",), ("!!",), (None,)], "p string")
    assert rows(R.text_join(texts, "t", phrases, "p").select("id", "p")) == [(1, "plain words"), (1, "trial"), (2, "trial")]


def test_shared_folder_is_named_on_a_cluster(spark, monkeypatch):
    from citeloom import session

    class Cluster:
        class sparkContext:
            master = "spark://host:7077"

        class conf:
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(RuntimeError):
        session.shared_folder(Cluster)


def test_core_stands_without_the_llm_subpackage():
    """In a process in which citeloom.llm cannot be imported, the core's queries are there."""
    import subprocess
    import sys
    from pathlib import Path

    code = "import sys; sys.modules['citeloom.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p3_found' in q and 'p6_found' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent)


def test_views_memberships_and_loads_of_documents(spark, rows, tmp_path):
    spark.sql("DROP TABLE IF EXISTS mv_base")
    spark.createDataFrame([(1, "a'b")], "k int, v string").write.saveAsTable("mv_base")
    io.materialized_view(spark, "mv_kept", "SELECT k, v FROM mv_base WHERE v <> 'x\\'y'")
    spark.createDataFrame([(2, "c")], "k int, v string").write.insertInto("mv_base")
    assert rows(spark.table("mv_kept")) == [(1, "a'b")]
    for _ in range(2):
        io.refresh_view(spark, "mv_kept")
        assert rows(spark.table("mv_kept")) == [(1, "a'b"), (2, "c")]
    for name in ("mv_kept", "mv_base"):
        spark.sql(f"DROP TABLE {name}")
    m = spark.createDataFrame([(1, 5, 0.25), (1, 4, 0.75), (2, 5, 0.0), (3, 5, 1.0)], "node long, cluster_no long, p double")
    io.write_memberships(m, str(tmp_path / "m"))
    assert rows(io.read_memberships(spark, str(tmp_path / "m"), 0.5)) == [(1, 4, 0.75), (3, 5, 1.0)]
    assert [(r["node"], [tuple(x) for x in r["memberships"]]) for r in io.membership_matrix(m).orderBy("node").collect()] == [(1, [(4, 0.75), (5, 0.25)]), (3, [(5, 1.0)])]
    spec = {"orders": TableSpec("", {"id": "id", "v": "v"}, ("id",)), "lines": TableSpec("line", {"id": "id", "part": "r._part"})}

    def read(texts):
        return parse_xml(spark.createDataFrame([(t,) for t in texts], "x string"), "x", "id long, v string, line array<struct<_part:long>>").select("doc.*")

    first = upsert_documents({}, read(["<o><id>1</id><v>a</v><line part='7'/></o>", "<o><id>2</id><v>b</v></o>"]), spec)
    second = upsert_documents(first, read(["<o><id>2</id><v>c</v><line part='8'/></o>", "<o><id>3</id></o>"]), spec)
    assert rows(second["orders"]) == sorted([(1, "a"), (2, "c"), (3, None)], key=repr) and rows(second["lines"]) == [(1, 7), (2, 8)]
