import io
import json
import threading
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from quillmesh import plugins
from quillmesh.cobol import evaluation as ev
from quillmesh.cobol import facts as ft
from quillmesh.operators import package as pk
from quillmesh.sources import pages as src
from quillmesh.streaming import streams as st


@pytest.fixture
def wiki(tmp_path):
    for name, text in {
        "a.md": "---\ntitle: Alpha\ntype: concept\ntags: [x, 1]\nsources: one\ncreated: 2024-01-02\nowner: team\n---\nSee [[b|Bee]] and [[c/d]].\n",
        "c/b.md": "no front matter [[a]]", "c/broken.md": "---\ntitle: [oops\n---\nbody", ".hidden.md": "x", ".git/x.md": "x", "note.txt": "x",
    }.items():
        p = tmp_path / "wiki" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return str(tmp_path / "wiki")


def test_read_and_write_pages(spark, wiki, tmp_path):
    got = {r.path: r for r in src.read_pages(spark, wiki).collect()}
    assert sorted(got) == ["a.md", "c/b.md", "c/broken.md"]
    a = got["a.md"]
    assert (a.title, a.type, a.tags, a.sources, a.created, a.links, a.frontmatter["owner"]) == ("Alpha", "concept", ["x", "1"], [], "2024-01-02", ["b", "c/d"], "team")
    assert got["c/b.md"].title == "b" and got["c/broken.md"].content.startswith("---")
    out = str(tmp_path / "out")
    assert src.write_pages(src.read_pages(spark, wiki), out) == 3
    again = {r.path: r for r in src.read_pages(spark, out).collect()}
    assert again["a.md"].tags == a.tags and again["a.md"].content.strip() == a.content.strip() and again["c/b.md"].title == "b"


def test_paths_are_guarded(tmp_path):
    for bad in ("../x", "/etc/passwd", "a/../../x", "a\0b"):
        with pytest.raises(ValueError):
            src.safe_path(str(tmp_path), bad)
    assert src.safe_path(str(tmp_path), "a/../b.md").name == "b.md"
    assert src.allowed_source(str(tmp_path / "x"), [str(tmp_path)]) and not src.allowed_source("/etc", [str(tmp_path)])


def test_raw_list(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_bytes(b"x")
    (tmp_path / "d" / "a.txt.meta.yaml").write_text("sha256: abc\nsize: 7\nsourceUrl: https://h\n")
    (tmp_path / "b.pdf").write_bytes(b"yy")
    got = {r.path: r for r in src.raw_list(spark, str(tmp_path)).collect()}
    assert got["d/a.txt"].sha256 == "abc" and got["d/a.txt"].size == 7 and not got["b.pdf"].has_meta and got["b.pdf"].mime_type == "application/pdf" and got["b.pdf"].size == 2
    assert src.count_files(spark, str(tmp_path)) == 2


def test_event_log(spark, tmp_path):
    now = 1_706_572_800_000_000
    lines = ['{"timestamp":"2024-01-29T00:00:00Z","kind":"a"}', "not json", '{"kind":"b"}', '{"timestamp":"2023-12-30T23:59:59.999Z","kind":"old"}', '{"timestamp":"2023-12-31T00:00:00.000Z","kind":"edge"}', ""]
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    assert sorted(r.kind for r in src.read_events(spark, str(tmp_path / "log.jsonl"), now).collect()) == ["a", "edge"]


def zipped(**files):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for k, v in files.items():
            z.writestr(k.replace("__", "/"), v)
    return data.getvalue()


def test_office_formats(spark):
    w, s = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"', 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    docx = zipped(**{"word/document.xml": f"<w:document {w}><w:p><w:t>one</w:t><w:tab/><w:t>two</w:t></w:p><w:p><w:t>three</w:t></w:p></w:document>"})
    rels = '<R xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></R>'
    book = f'<workbook {s} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>'
    sheet = f'<worksheet {s}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>3</v></c></row><row><c r="A2" t="inlineStr"><is><t>q,"x"</t></is></c></row></sheetData></worksheet>'
    xlsx = zipped(**{"xl/workbook.xml": book, "xl/_rels/workbook.xml.rels": rels, "xl/worksheets/sheet1.xml": sheet, "xl/sharedStrings.xml": f"<sst {s}><si><t>head</t></si></sst>"})
    pptx = zipped(**{"ppt/slides/slide10.xml": "<a><b>ten</b></a>", "ppt/slides/slide2.xml": "<a>two  <c/>x</a>", "ppt/slides/slide3.xml": "<a/>"})
    rows = [("a.docx", docx), ("b.xlsx", xlsx), ("c.pptx", pptx), ("d.html", b"<p>x</p>"), ("e.pdf", b"%PDF"), ("f.docx", b"broken")]
    got = src.extract(spark.createDataFrame([(a, bytearray(b)) for a, b in rows], "path string, content binary")).orderBy("file", "seg_no").collect()
    text = {(r.file, r.seg_no): r.text for r in got}
    assert text["a.docx", 1] == "one\ttwo\n\nthree" and text["b.xlsx", 1] == 'head,,3\n"q,""x"""' and text["c.pptx", 1] == "two x" and text["c.pptx", 2] == "ten" and text["d.html", 1] == "x"
    assert {r.file for r in got if r.error} == {"e.pdf", "f.docx"} and next(r for r in got if r.file == "b.xlsx").column_headers == "head,,3"
    assert [r.text for r in src.extract(spark.createDataFrame([("e.pdf", bytearray(b"x"))], "path string, content binary"), lambda d: ["p1", "p2"]).collect()] == ["p1", "p2"]


def test_urls(spark):
    df = spark.createDataFrame([("https://arxiv.org/abs/2401.00001v2",), ("https://w.example/wiki/spaces/ENG/pages/123/Title",), ("https://j.example/browse/ab-12",), (None,)], "u string")
    r = df.select(src.arxiv_pdf(F.col("u")).alias("a"), src.confluence_parts(F.col("u")).alias("c"), src.jira_parts(F.col("u")).alias("j")).collect()
    assert r[0].a == "https://arxiv.org/pdf/2401.00001v2.pdf" and tuple(r[1].c) == ("w.example", "ENG", "123") and r[2].j.issue == "AB-12" and r[3].a is None
    assert src.adf_text({"type": "doc", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "a"}, {"type": "hardBreak"}, {"type": "text", "text": "b"}]}]}) == "a\nb\n"


def test_settings(tmp_path):
    (tmp_path / "quillmesh.yaml").write_text("stale_days: 9\nextra_system_callees: [A]\n")
    (tmp_path / "quillmesh.local.yaml").write_text("extra_system_callees: [B]\n")
    s = src.load_settings(str(tmp_path), {"QUILLMESH_REJECT_UNSUPPORTED": "yes"})
    assert (s.stale_days, s.extra_system_callees, s.reject_unsupported) == (9, ("A", "B"), True)
    assert src.load_settings(str(tmp_path), {}, stale_days=3).stale_days == 3


EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def events(spark, n=200):
    return spark.range(n).selectExpr("id event_id", "timestamp_seconds(1704067200 + id * 7200) ts", "id % 7 user_id", "if(id % 3 = 0, 'error', 'view') event_type", "1.0D value", "'{}' props")


def test_stream_equals_batch(spark, tmp_path):
    folder = str(tmp_path / "ev")
    events(spark).write.parquet(folder)
    stream = st.event_stream(spark, folder, EVENTS)
    q = st.weekly_counts(stream).writeStream.format("memory").queryName("weekly").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("weekly").collect())) == sorted(map(tuple, st.weekly_counts(events(spark)).collect()))
    q = st.transitions(stream, "user_id", "error").writeStream.format("memory").queryName("turns").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    from quillmesh.operators.telemetry import transitions

    want = transitions(events(spark), "user_id", F.col("event_type") == "error")
    assert sorted(r.event_id for r in spark.table("turns").collect()) == sorted(r.event_id for r in want.collect())
    q = st.retained(stream.union(stream)).writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("once").count() == 200


def test_watch_pages(spark, wiki, tmp_path):
    seen = []
    q = st.watch_pages(spark, wiki, lambda df, i: seen.append(df.count()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sum(seen) >= 3


def test_pack_stream(spark):
    df = spark.createDataFrame([(5,), (5,), (1,), (20,), (3,)], "n_lines int").coalesce(1)
    assert [tuple(r) for r in st.pack_stream(df, 10).collect()] == [(1, 2, 10), (2, 1, 1), (3, 1, 20), (4, 1, 3)]


def test_admission():
    gate, log, peak = st.Admission(readers=2, timeout=5), [], []

    def reader():
        with gate.read():
            peak.append(gate.reading)
            assert not gate.writing
            time.sleep(0.02)

    def writer():
        with gate.write():
            assert gate.reading == 0
            log.append("w")

    threads = [threading.Thread(target=f) for f in (reader, reader, writer, reader, reader, writer)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert max(peak) <= 2 and log == ["w", "w"]
    slow = st.Admission(timeout=0.01)
    with slow.write(), pytest.raises(TimeoutError), slow.read():
        pass


def test_batch_isolates_errors():
    got = st.run_batch([("a", lambda: 1), ("b", lambda: 1 / 0), ("c", lambda: 3)])
    assert [r["ok"] for r in got] == [True, False, True]
    with pytest.raises(ValueError):
        st.run_batch([("x", int)] * 51)


GOOD = {
    "format": "kb-package", "format_version": "0.1", "name": "pay.roll-1", "version": "1", "license": "MIT", "owner": "team", "created_at": "2026-06-20", "description": "",
    "source_policy": {"raw_immutable": True, "require_sha256": True}, "wiki_policy": {"require_sources_for_grounded_pages": True, "allow_synthesis_pages": False, "stale_after_days": 90},
    "evidence_policy": {"allow_unsupported_pages": "warn", "require_abstain_signal": True}, "metadata": {"anything": [1]},
}


def faults(**changed):
    return sorted(i[1] for i in pk.manifest_issues({k: v for k, v in (GOOD | changed).items() if v is not ...}, "kb-package"))


def test_manifest():
    import datetime

    assert faults() == faults(format_version=0.1, created_at=datetime.date(2026, 6, 20), generator={"name": "x", "version": "1"}) == faults(created_at="2026-06-20T10:00:00Z", metadata=...) == []
    assert pk.manifest_issues(None)[0][2] == "manifest is missing" and pk.manifest_issues([1])[0][2] == "manifest is no mapping"
    assert faults(zzz=1, owner=..., license=" ", format="other", format_version=1, name="-bad name", created_at="20 June", description=3) == ["created_at", "description", "format", "format_version", "license", "name", "owner", "zzz"]
    assert faults(source_policy={"raw_immutable": False, "require_sha256": "yes", "x": 1}) == ["source_policy.raw_immutable", "source_policy.require_sha256", "source_policy.x"]
    assert faults(wiki_policy={"require_sources_for_grounded_pages": 1, "stale_after_days": 0}) == ["wiki_policy.allow_synthesis_pages", "wiki_policy.require_sources_for_grounded_pages", "wiki_policy.stale_after_days"]
    assert faults(evidence_policy={"allow_unsupported_pages": "maybe", "require_abstain_signal": None}) == ["evidence_policy.allow_unsupported_pages", "evidence_policy.require_abstain_signal"]
    assert faults(generator=[], source_policy=..., wiki_policy=None, metadata=[]) == ["generator", "metadata", "source_policy", "wiki_policy"]


def test_conformance(spark):
    counts = spark.createDataFrame([(3, 0, 2, 1)], "unsupported long, broken_links long, raws_without_hash long, stale long")
    for level, severity in (("allow", "info"), ("warn", "warning"), ("reject", "error")):
        got = {r.kind: r.severity for r in pk.conformance(counts, GOOD | {"evidence_policy": {"allow_unsupported_pages": level}}).collect()}
        assert got == {"unsupported": severity, "raws_without_hash": "error", "stale": "info"}


def test_evaluation_and_plugins(spark):
    copy = "       IDENTIFICATION DIVISION.\n       PROGRAM-ID. {0}.\n       DATA DIVISION.\n       WORKING-STORAGE SECTION.\n       COPY BK.\n       PROCEDURE DIVISION.\n       S1.\n           GOBACK.\n"
    rows = [("BK.cpy", "       01  R.\n           05  A PIC X.\n"), ("P1.cbl", copy.format("P1")), ("P2.cbl", copy.format("P2")), ("x.java", "class X")]
    by = plugins.facts(spark.createDataFrame(rows, "file string, text string"))
    assert plugins.languages() == ["cobol"] and plugins.language_of("A.CPY").name == "cobol" and plugins.language_of("x.java") is None
    all_ = by["cobol"]
    entry = lambda f: {"fieldName": f, "copybooks": ["BK"], "programs": ["P2", "P1"], "linkage": "deterministic"}
    manifest = {"version": 1, "deterministic": [entry("R"), entry("A")], "inferredHigh": []}
    got = {r.family: r for r in ev.evaluate(spark, all_, manifest).collect()}
    assert got["all"].f1 == 1.0 and got["deterministic"].tp == 2 and "100.0%" in ev.report([got["all"]])
    with pytest.raises(ValueError):
        ev.expected_keys({"deterministic": [entry("R"), entry("R")]})
    assert json.dumps(ev.mermaid([("a", "b", "k")])) and '"a" -> "b"' in ev.dot([("a", "b", "k")])
    assert ft.summary(all_).count() == 3


def test_ingest(spark, tmp_path):
    from quillmesh.sources.ingest import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# A\n" + "x\n" * 30 + "# B\ny")
    (tmp_path / "in" / "b.html").write_text("<p>hello</p>")
    (tmp_path / "in" / "c.docx").write_text("no zip")
    (tmp_path / "in" / "d.bin").write_bytes(b"\0")
    got = ingest(spark, str(tmp_path / "in"), spark.createDataFrame([("t/b.html",)], "path string"), "t", [str(tmp_path)], None, 50, 10)
    assert sorted(r.path for r in got.added.collect()) == ["t/a.md", "t/c.docx", "t/d.bin"] and [r.path for r in got.known.collect()] == ["t/b.html"]
    assert [(r.file, r.stage) for r in got.errors.collect()] == [("t/c.docx", "extract")]
    assert sorted({r.file for r in got.chunks.collect()}) == ["t/a.md", "t/b.html"] and got.chunks.where("file = 't/a.md'").count() == 5
    assert got.packs.count() == got.chunks.count()
    with pytest.raises(ValueError):
        ingest(spark, "/etc", spark.createDataFrame([], "path string"), "t", [str(tmp_path)])


def test_embed(spark):
    from quillmesh.operators.search import embed

    df = spark.createDataFrame([("p", "T", ["x"], "abc"), ("q", None, None, None)], "path string, title string, tags array<string>, content string")
    got = {r.path: r.embedding for r in embed(df, lambda ts: [[float(len(t)), 0.0] for t in ts], "m").collect()}
    assert got["p"] == [1.0, 0.0] and got["q"] == [0.0, 0.0]
