import datetime

from pyspark.sql import functions as F

from quillmesh.cobol import lineage as ln
from quillmesh.operators import journal as jo


def test_log_is_read_as_it_was_written(spark, tmp_path):
    at = datetime.datetime(2026, 3, 1, 10, 5, 59)
    for k in range(3):
        jo.append_log(spark.createDataFrame([(at, "write", f"p{k}.md", "two\nlines | and a bar")], "time timestamp, operation string, page string, summary string"), f"{tmp_path}/log")
    text = "\n".join(sorted(r.value for r in spark.read.text(f"{tmp_path}/log").collect()))
    head = "# Log\n\n| Time | Operation | Page | Summary |\n|------|---|---|---|\n"
    logs = spark.createDataFrame([("log.md", head + text + "\n| t | op | short |\n| only | two |\n"), ("none.md", None), ("empty.md", "")], "path string, text string")
    got = [(r.time, r.operation, r.page, r.summary) for r in jo.log_entries(logs).orderBy("pos").collect()]
    assert got == [(f"2026-03-01 10:05 UTC", "write", f"p{k}.md", "two lines   and a bar") for k in range(3)] + [("t", "op", "—", "short")]
    assert [r.page for r in jo.log_tail(jo.log_entries(logs), 2).orderBy("pos").collect()] == ["p2.md", "—"]


def test_templates_and_stale_artifacts(spark):
    files = spark.createDataFrame([("t/person.md", "---\ndescription: \"A person\"\n---\nx"), ("t/bare.md", "text"), ("t/x.txt", "no")], "path string, text string")
    assert sorted((r.name, r.description) for r in jo.templates(files).collect()) == [("bare", "bare"), ("person", "A person")]
    old = spark.createDataFrame([("a",), ("b",), (None,)], "path string")
    assert [r.path for r in jo.stale_artifacts(old, spark.createDataFrame([("a",), ("a",)], "path string")).collect()] == ["b"]


def test_evidence(spark):
    found = spark.createDataFrame([(2,), (0,)], "n long").select("n", jo.deterministic_evidence(F.col("n") > 0, F.concat(F.col("n").cast("string"), F.lit(" found")), F.lit("none"), F.array(F.lit("a.cbl"))).alias("e"))
    assert [(r.e.confidence, r.e.abstain, r.e.rationale) for r in found.orderBy("n").collect()] == [("absent", True, "none"), ("strong", False, "2 found")]


def test_lineage_query_by_every_part_of_one_end(spark):
    rows = spark.createDataFrame(
        [("deterministic", "strong", None, "BK.REC.A", "P1,P2", "A"), ("inferred-high", "strong", "P1", "BK.REC.A.1", "P3", "BZ.R.A"), ("call-bound", "weak", "P1", "REC.A", "P4", "R.B"), ("db2", "strong", "P1", "T.X COL V1", "P2", "V2")],
        "family string, confidence string, left_program string, left_field string, right_program string, right_field string",
    )
    ask = lambda **k: sorted(r.family for r in ln.lineage_query(rows, **k).collect())
    assert ask(field="a") == ["call-bound", "deterministic", "inferred-high"] and ask(field=".*") == [] and ask(copybook="bz") == ["inferred-high"]
    assert ask(copybook="BK", program="P3") == [] and ask(copybook="BZ", program="p3", field="A") == ["inferred-high"]
    assert ask(qualified="REC.A") == ["call-bound", "deterministic"] and ask(table="t.x") == ["db2"] and ask(table="T.X", program="P2") == [] and len(ask()) == 4
    assert [r.family for r in ln.in_order(rows).collect()] == ["call-bound", "db2", "deterministic", "inferred-high"]


def test_edges_lookup_and_exclusions(spark):
    flows = spark.createDataFrame([("A", "B"), ("A", "C"), ("AB", "B")], "src string, dst string")
    assert ln.dataflow_edges(flows, "a").count() == 2 and ln.dataflow_edges(flows, "A", "b").count() == 1 and ln.dataflow_edges(flows).count() == 3
    procs = spark.createDataFrame([("f", "MAIN", "section"), ("f", "main", "paragraph"), ("f", "X", "paragraph")], "file string, name string, kind string")
    want = spark.createDataFrame([("f", "Main", None), ("f", "main", "Section"), ("f", "x", None), ("g", "x", None)], "file string, name string, kind string")
    got = {(r.file, r.name, r.kind): (r.found, r.ambiguous) for r in ln.procedure_lookup(procs, want).collect()}
    assert got == {("f", "Main", None): (None, True), ("f", "main", "Section"): ("section", False), ("f", "x", None): ("paragraph", False), ("g", "x", None): (None, False)}
    left = spark.createDataFrame([("call", "b", 2), ("call", "a", 2), ("call", "c", 9), ("call", "d", 1), ("db2", "z", 0)], "family string, kind string, n long")
    assert [tuple(r) for r in ln.top_exclusions(left).collect()] == [("call", 14, "c (9), a (2), b (2)")]
