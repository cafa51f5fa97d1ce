import pytest

from quillmesh.cobol import facts as ft
from quillmesh.cobol import lineage as ln
from quillmesh.cobol.reading import column_bindings, logical_lines, read_source, sql_tables
from quillmesh.session import cut

HEAD = "       IDENTIFICATION DIVISION.\n       PROGRAM-ID. {0}.\n       DATA DIVISION.\n"


def program(name, data="", body="           GOBACK.", linkage=""):
    lines = HEAD.format(name) + "       WORKING-STORAGE SECTION.\n" + data
    return lines + ("       LINKAGE SECTION.\n" + linkage if linkage else "") + "       PROCEDURE DIVISION.\n       MAIN SECTION.\n       START-UP.\n" + body + "\n"


def item(level, name, rest=""):
    return f"       {level:02d}  {name} {rest}".rstrip() + ".\n"


def record(name, *fields):
    return item(1, name) + "".join(item(5, f, r) for f, r in fields)


@pytest.fixture(scope="module")
def load(spark):
    def run(**files):
        rows = [(k.replace("__", ".").replace("_", "-"), v) for k, v in files.items()]
        return cut(ft.facts(spark.createDataFrame(rows, "file string, text string")))

    return run


def keys(all_, family):
    return sorted(r.key for r in ln.keys_of(all_).where(f"family = '{family}'").collect())


def names(text, fact, file="X.cbl"):
    return [f[3] for f in read_source(file, text) if f[0] == fact]


def test_layout():
    assert logical_lines("000100 MOVE A TO B.\n000200*comment\n000300-    REST\n000400D DEBUG\n\n") == (True, [(1, "MOVE A TO B.REST")])
    fixed, lines = logical_lines("compute a = b. *> note\ndisplay 'x'\n      * old comment\n")
    assert not fixed and [t.strip() for _, t in lines] == ["compute a = b.", "display 'x'"]
    assert read_source("X.cbl", "") and read_source("X.cbl", None) == []


def test_data_hierarchy():
    text = program("P", item(1, "REC") + item(5, "GRP") + item(10, "A", "PIC 9(5)V99 COMP-3 VALUE ZERO") + item(88, "OK", "VALUE 1") + item(5, "B", "PIC X(3) OCCURS 4 TIMES") + item(77, "C", "PIC X") + item(1, "FILLER", "REDEFINES REC PIC X"))
    got = {f[3]: f for f in read_source("P.cbl", text) if f[0] == "data"}
    assert got["A"][5]["qualified"] == "REC.GRP.A" and got["A"][5]["picture"] == "9(5)V99" and got["A"][5]["usage"] == "COMP-3"
    assert got["OK"][4] == "REC.GRP.A" and got["B"][5]["occurs"] == "4" and got["B"][6] == ["GRP"] and got["C"][4] is None and got["FILLER"][5]["redefines"] == "REC"
    assert got["REC"][5]["group"] == "true" and got["REC"][5]["children"] == "2"


def test_statements():
    body = "           MOVE 'SUBA' TO WS-P WS-Q.\n           CALL WS-P USING BY REFERENCE A B.\n           PERFORM LOOP-X THRU LOOP-Z.\n           ADD A TO B GIVING C.\n           STRING A DELIMITED BY SPACE INTO D.\n       LOOP-X.\n           EXEC CICS LINK PROGRAM('SRV') END-EXEC.\n           READ F INTO E."
    facts = read_source("P.cbl", program("P", body=body))
    assert [(f[3], f[5]["literal"]) for f in facts if f[0] == "assign" and "literal" in f[5]] == [("WS-P", "SUBA"), ("WS-Q", "SUBA")]
    call = next(f for f in facts if f[0] == "call")
    assert (call[3], call[5]["kind"], call[6]) == ("WS-P", "identifier", ["A", "B"])
    assert next(f for f in facts if f[0] == "perform")[5]["thru"] == "LOOP-Z"
    flow = {(f[3], f[5]["to"], f[5]["via"]) for f in facts if f[0] == "flow"}
    assert {("A", "B", "ADD"), ("A", "C", "ADD"), ("A", "D", "STRING")} <= flow and ("SPACE", "D", "STRING") not in flow
    assert next(f for f in facts if f[0] == "cics")[5]["program"] == "SRV" and names(program("P", body=body), "paragraph") == ["START-UP", "LOOP-X"]


def test_sql_parts():
    assert sql_tables("EXEC SQL INSERT INTO A . B (X) SELECT Y FROM C JOIN D ON E END-EXEC") == ["A.B", "C", "D"]
    assert column_bindings("SELECT", "SELECT F(A, B), C INTO :H1, : H2 FROM T") == [("C", "H2")]
    assert column_bindings("INSERT", "INSERT INTO T (A, B) VALUES (:X, NULL)") == [("A", "X")] and column_bindings("INSERT", "INSERT INTO T (A) VALUES (:X, :Y)") == []
    assert column_bindings("UPDATE", "UPDATE T SET A = :X, B = B + 1 WHERE C = :Z") == [("A", "X")]


def test_shared_copybook_and_inferred_pairs(load):
    a = record("CUST-REC", ("CUST-ID", "PIC X(10)"), ("CUST-NAME", "PIC X(30)"), ("CUST-ZIP", "PIC 9(5)"))
    b = record("CLI-REC", ("CUST-ID", "PIC X(10)"), ("CUST-NAME", "PIC X(30)"), ("CUST-TEL", "PIC X(15)"))
    copy = "       COPY {0}.\n"
    all_ = load(CUSTREC__cpy=a, CLIREC__cpy=b, ORDA__cbl=program("ORDA", copy.format("CUSTREC")), ORDB__cbl=program("ORDB", copy.format("custrec")), CLIA__cbl=program("CLIA", copy.format("CLIREC")))
    assert keys(all_, "deterministic") == [f"{f}|CUSTREC|ORDA,ORDB|deterministic" for f in ("CUST-ID", "CUST-NAME", "CUST-REC", "CUST-ZIP")]
    assert keys(all_, "inferredHigh") == ["CUST-ID|CLIREC,CUSTREC", "CUST-NAME|CLIREC,CUSTREC"]
    assert keys(all_, "inferredAmbiguous") == keys(all_, "inferredSemantic") == []
    assert ln.lineage_query(ln.lineage_rows(all_), "CUST-ID", "CLIA").count() == 1


def test_replacing(load):
    a = record("USR-REC", ("USR-PK", "PIC X(8)"), ("COMMON-ID", "PIC X(10)"), ("COMMON-NAME", "PIC X(30)"))
    b = record("PRD-REC", ("SKU", "PIC X(8)"), ("COMMON-ID", "PIC X(10)"), ("COMMON-NAME", "PIC X(30)"))
    u, p = "       COPY UTPL REPLACING USR-PK BY ENTITY-PK.\n", "       COPY PTPL REPLACING ==SKU== BY ==ENTITY-PK==.\n"
    all_ = load(UTPL__cpy=a, PTPL__cpy=b, UA__cbl=program("UA", u), UB__cbl=program("UB", u), PA__cbl=program("PA", p), PB__cbl=program("PB", p))
    det = keys(all_, "deterministic")
    assert "ENTITY-PK|UTPL|UA,UB|deterministic-via-replacing" in det and "ENTITY-PK|PTPL|PA,PB|deterministic-via-replacing" in det and len(det) == 8
    assert keys(all_, "inferredHigh") == ["COMMON-ID|PTPL,UTPL", "COMMON-NAME|PTPL,UTPL"]


def test_gates_of_inferred_pairs(load):
    shape = lambda n, f, pic="PIC X(4) COMP", s=("S1", "S2"): item(1, n) + item(5, "G") + "".join(item(10, x, pic) for x in (f, *s))
    copy = lambda n: program(f"P{n}", f"       COPY {n}.\n")
    all_ = load(AA__cpy=shape("RA", "OLD"), BB__cpy=shape("RB", "NEW"), PA__cbl=copy("AA"), PB__cbl=copy("BB"))
    # S1 of one side and NEW of the other share only one sibling
    assert keys(all_, "inferredSemantic") == ["OLD|AA,BB"]
    high = keys(all_, "inferredHigh")
    assert high == ["S1|AA,BB", "S2|AA,BB"]
    other = load(AA__cpy=shape("RA", "F", "PIC X(4)", ()), BB__cpy=shape("RB", "F", "PIC X(5)", ()), PA__cbl=copy("AA"), PB__cbl=copy("BB"))
    assert keys(other, "inferredHigh") == []


def test_semantic_pair(load):
    make = lambda n, f: item(1, n) + item(5, "G") + item(10, f, "PIC 9(4) COMP") + item(10, "S1", "PIC X") + item(10, "S2", "PIC XX")
    all_ = load(AA__cpy=make("RA", "OLD"), BB__cpy=make("RB", "NEW"), PA__cbl=program("PA", "       COPY AA.\n"), PB__cbl=program("PB", "       COPY BB.\n"))
    assert keys(all_, "inferredSemantic") == ["OLD|AA,BB"]


def test_call_boundaries(load):
    data = record("WS-REC", ("WS-ID", "PIC X(3)"), ("WS-NM", "PIC X(9)")) + item(1, "WS-P", "PIC X(8) VALUE 'SUB'") + item(1, "WS-S", "PIC X")
    body = "           CALL WS-P USING WS-REC.\n           CALL 'MQGET' USING WS-S.\n           CALL 'NOPE' USING WS-S.\n           CALL WS-S USING WS-S.\n           CALL 'SUB' USING WS-REC WS-S.\n           CALL 'SUB' USING WS-ID.\n           CALL 'SUB' USING WS-S."
    sub = program("SUB", linkage=record("LK-REC", ("LK-ID", "PIC X(3)"), ("LK-OTHER", "PIC X(9)"), ("LK-MORE", "PIC X")))
    entries, trouble = ln.call_boundaries(load(MAIN__cbl=program("MAIN", data, body), SUB__cbl=sub))
    got = sorted((r.caller_qualified, r.callee_qualified, r.confidence, r.shape) for r in entries.collect())
    assert got == [("WS-REC", "LK-REC", "deterministic", "both-group"), ("WS-REC.WS-ID", "LK-REC.LK-ID", "deterministic", "scalar-match"), ("WS-REC.WS-NM", "LK-REC.LK-OTHER", "high", "scalar-match")]
    assert sorted(r.kind for r in trouble.collect()) == ["arity-mismatch", "caller-arg-not-top-level", "dynamic-call", "shape-mismatch", "system-call", "unresolved-callee"]


def test_db2(load):
    sql = "           EXEC SQL\n             {0}\n           END-EXEC."
    w = program("WR", item(1, "W-ID", "PIC X(3)") + item(1, "W-NM", "PIC X(9)"), sql.format("INSERT INTO CUST (ID, NAME) VALUES (:W-ID, :W-NM)"))
    r = program("RD", item(1, "R-ID", "PIC X(3)"), sql.format("SELECT ID, NAME INTO :R-ID, :R-GONE FROM CUST") + "\n" + sql.format("DECLARE C1 CURSOR FOR SELECT X FROM OTHER"))
    pairs, columns, trouble = ln.db2_lineage(load(WR__cbl=w, RD__cbl=r))
    assert [(p.table, p.writer, p.reader) for p in pairs.collect()] == [("CUST", "WR", "RD")]
    assert [(c.column, c.writer_variable, c.reader_variable) for c in columns.collect()] == [("ID", "W-ID", "R-ID")]
    assert {(t.kind, t.detail) for t in trouble.collect()} == {("host-var-unresolved", "R-GONE"), ("non-classifiable-op", "DECLARE")}


def test_graph_and_flow(load):
    body = "           CALL 'SUB' USING A.\n           PERFORM WORK.\n       WORK SECTION.\n       W1.\n           PERFORM W2.\n       W2.\n           EXIT."
    all_ = load(MAIN__cbl=program("MAIN", "       COPY CPY1.\n" + item(1, "A", "PIC X"), body), CPY1__cpy=item(1, "Z", "PIC X"))
    v, e = ln.knowledge_graph(all_)
    assert {(r.id, r.resolved) for r in v.collect()} == {("program:MAIN", True), ("program:SUB", False), ("copybook:CPY1", True)}
    assert {(r.src, r.dst, r.kind) for r in e.collect()} == {("program:MAIN", "program:SUB", "CALLS"), ("program:MAIN", "copybook:CPY1", "COPIES")}
    assert {("START-UP", "W1"), ("START-UP", "W2"), ("W1", "W2")} <= {(r.src, r.dst) for r in ln.procedure_flow(all_, "MAIN.cbl").collect()}
    assert [r.file for r in ln.empty_copybooks(load(EE__cpy="      * nothing\n", FF__cpy=item(1, "Z", "PIC X"))).collect()] == ["EE.cpy"]


def test_overview_and_diagnostics(load):
    from quillmesh.operators import graph as gr

    all_ = load(MAIN__cbl=program("MAIN", item(1, "A", "PIC X"), "           CALL 'GONE' USING A.\n           CALL WS-X USING A."), SUB__cbl=program("SUB"))
    v, e = ln.knowledge_graph(all_)
    assert {(r.topic, r.name, r.n) for r in gr.overview(v, e).collect()} >= {("vertices", "program resolved", 2), ("vertices", "program unresolved", 2), ("edges", "CALLS", 2), ("confidence", "deterministic", 1)}
    kinds = {r.kind: r.n for r in ln.diagnostics(all_).collect()}
    assert kinds["unresolved-callee"] == kinds["dynamic-call"] == 1 and kinds["self-loop"] == 0 and len(kinds) == 12
    assert {r.family: (r.indexed, r.yielding) for r in ln.coverage(all_).collect()}["call-bound"] == (1, 0)


def test_sql_tables_over_all_rows_and_forms(spark, tmp_path):
    from quillmesh.plans import code

    spark.createDataFrame([(k, "Brand#1", k) for k in (6, 7, 14)], "p_partkey long, p_brand string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = {(r.p_partkey, r.form): r.tables for r in code.sql_table_names_all(spark, str(tmp_path)).collect()}
    assert len(got) == 3 * len(code.SQL_FORMS)
    assert [got[7, i] for i in range(6)] == [["BRAND_1", "T7"], ["BRAND_1", "T7"], ["S.BRAND_1", "T7"], ["BRAND_1"], ["S.BRAND_1"], []]
