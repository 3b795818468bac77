"""Containers built in the tests, read, masked and read again; gold sets; sessions."""

import io
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from maskwright.operators import manual
from maskwright.plans.engine import Engine
from maskwright.schema import InvalidInput, NotFound
from maskwright.sources import documents as d
from maskwright.sources import office, pdf

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
REL = '<Relationship Id="{}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/{}" Target="{}"/>'


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def para(*runs):
    return "<w:p>" + "".join(f'<w:r><w:rPr><w:b/></w:rPr><w:t xml:space="preserve">{r}</w:t></w:r>' for r in runs) + "</w:p>"


def docx():
    rows = "".join("<w:tr>" + "".join(f"<w:tc>{para(f'行{r}列{c}')}</w:tc>" for c in range(3)) + "</w:tr>" for r in range(12))
    body = para("担当は山田", "太郎です") + para(" ") + f"<w:tbl>{rows}</w:tbl>" + para("連絡先 1.2.", "3.4") + "<w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/><w:t>c</w:t></w:r></w:p>"
    body += '<w:sectPr><w:headerReference w:type="default" r:id="h1"/><w:footerReference w:type="first" r:id="h1"/></w:sectPr>'
    return zipped({
        "_rels/.rels": RELS.format(REL.format("r1", "officeDocument", "word/document.xml")),
        "word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>",
        "word/_rels/document.xml.rels": RELS.format(REL.format("h1", "header", "header1.xml")),
        "word/header1.xml": f"<w:hdr {W}>{para('見出し 山田太郎')}</w:hdr>",
        "word/media/x.bin": "kept",
    })


P = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def frame(*paragraphs):
    return "".join("<a:p>" + "".join(f"<a:r><a:t>{r}</a:t></a:r>" for r in p) + "</a:p>" for p in paragraphs)


def pptx():
    shape = f"<p:sp><p:txBody>{frame(('電話 090-1234', '-5678'), ('二行目',))}</p:txBody></p:sp>"
    table = f"<p:graphicFrame><a:graphic><a:graphicData><a:tbl><a:tr><a:tc><a:txBody>{frame(('1.2.3.4',))}</a:txBody></a:tc></a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame>"
    group = f"<p:grpSp><p:pic/><p:sp><p:txBody>{frame(('組の中',))}</p:txBody></p:sp></p:grpSp>"
    slide = f"<p:sld {P}><p:cSld><p:spTree>{shape}{table}{group}</p:spTree></p:cSld></p:sld>"
    notes = f"<p:notes {P}><p:cSld><p:spTree><p:sp><p:txBody>{frame(('覚え書き',))}</p:txBody></p:sp></p:spTree></p:cSld></p:notes>"
    return zipped({
        "_rels/.rels": RELS.format(REL.format("r1", "officeDocument", "ppt/presentation.xml")),
        "ppt/presentation.xml": f'<p:presentation {P}><p:sldIdLst><p:sldId id="256" r:id="s1"/></p:sldIdLst></p:presentation>',
        "ppt/_rels/presentation.xml.rels": RELS.format(REL.format("s1", "slide", "slides/slide1.xml")),
        "ppt/slides/slide1.xml": slide,
        "ppt/slides/_rels/slide1.xml.rels": RELS.format(REL.format("n1", "notesSlide", "../notesSlides/n1.xml")),
        "ppt/notesSlides/n1.xml": notes,
    })


def pdf_file(content, compressed=True):
    data = zlib.compress(content) if compressed else content
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R >>"]
    objects.append(b"<< /Length %d %s>>\nstream\n%s\nendstream" % (len(data), b"/Filter /FlateDecode " * compressed, data))
    out, places = b"%PDF-1.4\n", []
    for i, o in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, o)
    xref = len(out)
    out += b"xref\n0 5\n0000000000 65535 f \n" + b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + b"trailer << /Size 5 /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF" % xref


CONTENT = b"BT /F1 12 Tf 72 712 Td (mail taro@example.jp \\(x\\)) Tj [(19) -20 <322E302E322E31> ( )] TJ (   ) Tj ET\nBI /W 1 ID \x00(Tj) EI\n(1.2.3.4) Tj"


def test_docx():
    blocks = dict(office.read_docx(docx()))
    assert blocks["doc:p:0"] == "担当は山田太郎です" and "doc:p:1" not in blocks
    assert blocks["doc:t:0:r:11:c:2:p:0"] == "行11列2" and blocks["doc:p:3"] == "a\tb\nc"
    assert [b for b in blocks if b.startswith("section")] == ["section:0:header:p:0"]
    masked = office.rewrite_docx(docx(), lambda block, text: text.replace("山田太郎", "████") if "山田太郎" in text else None)
    again = dict(office.read_docx(masked))
    assert again == blocks | {"doc:p:0": "担当は████です", "section:0:header:p:0": "見出し ████"}
    with zipfile.ZipFile(io.BytesIO(masked)) as z:
        assert z.read("word/media/x.bin") == b"kept" and "山田".encode() not in z.read("word/document.xml") and b"<w:b" in z.read("word/document.xml")


def test_docx_tabs_and_breaks_survive():
    masked = office.rewrite_docx(docx(), lambda block, text: text.replace("b", "*") if block == "doc:p:3" else None)
    assert dict(office.read_docx(masked))["doc:p:3"] == "a\t*\nc"


def test_pptx():
    blocks = dict(office.read_pptx(pptx()))
    assert blocks == {"slide:0:shape:0:text": "電話 090-1234-5678\n二行目", "slide:0:shape:1:r:0:c:0": "1.2.3.4", "slide:0:shape:2:shape:1:text": "組の中", "slide:0:notes:shape:0:text": "覚え書き"}
    masked = office.rewrite_pptx(pptx(), lambda block, text: text.replace("090-1234-5678", "*" * 13).replace("二", "*") if block.endswith("0:text") else None)
    assert dict(office.read_pptx(masked))["slide:0:shape:0:text"] == "電話 *************\n*行目"


@pytest.mark.parametrize("compressed", [True, False])
def test_pdf(compressed):
    data = pdf_file(CONTENT, compressed)
    blocks = pdf.read_pdf(data)
    assert blocks == [("pdf:0:3:0", "mail taro@example.jp (x)"), ("pdf:0:4:0", "19"), ("pdf:0:4:2", "2.0.2.1"), ("pdf:0:8:0", "1.2.3.4")]
    masked = pdf.rewrite_pdf(data, lambda block, text: text.replace("taro@example.jp", "*" * 15) if block == "pdf:0:3:0" else None)
    assert dict(pdf.read_pdf(masked))["pdf:0:3:0"] == "mail *************** (x)"
    assert b"taro@example.jp" not in masked and len(pdf.read_pdf(masked)) == 4


def test_pdf_object_streams_and_utf16():
    content = b"<feff" + "山田".encode("utf-16-be").hex().encode() + b"> Tj"
    inner = b"1 0 2 33 << /Type /Catalog /Pages 2 0 R >>  << /Type /Pages /Kids [3 0 R] /Count 1 >>"
    first = inner.index(b"<<")
    body = inner[:first].replace(b"33", b"%d" % (inner.index(b"<< /Type /Pages ") - first)) + inner[first:]
    first = body.index(b"<<")
    packed = zlib.compress(body)
    data = b"%PDF-1.5\n5 0 obj << /Type /ObjStm /N 2 /First " + b"%d" % first + b" /Length %d /Filter /FlateDecode >> stream\n" % len(packed) + packed + b"\nendstream endobj\n"
    data += b"3 0 obj << /Type /Page /Contents [4 0 R] >> endobj\n4 0 obj << /Length 999 >> stream\n" + content + b"\nendstream endobj\n"
    data += b"6 0 obj << /Type /XRef /Root 1 0 R /Length 0 >> stream\n\nendstream endobj\n"
    assert pdf.read_pdf(data) == [("pdf:0:0:0", "山田")]
    assert pdf.read_pdf(pdf.rewrite_pdf(data, lambda b, t: "**")) == [("pdf:0:0:0", "**")]


@pytest.fixture
def folder(tmp_path):
    files = {"a.DOCX": docx(), "b.pptx": pptx(), "c.pdf": pdf_file(CONTENT), "d.txt": b"x", "e.pdf": b"", "f.docx": b"no zip", "g.pdf": b"%PDF-1.4 nothing"}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    return str(tmp_path)


def test_documents_end_to_end(spark, folder):
    files = d.read_files(spark, folder)
    blocks = d.blocks(files).persist()
    problems = {r["path"].rsplit("/", 1)[1]: r["problem"] for r in blocks.where("problem is not null").collect()}
    assert set(problems) == {"d.txt", "f.docx", "g.pdf"} and problems["d.txt"] == "unsupported format"  # Spark leaves empty files out itself
    found = Engine(dictionary=(("山田太郎", "CUSTOM"),)).findings(blocks.where("problem is null"), keep=("path",))
    got = {(r["path"].rsplit("/", 1)[1], r["text"]) for r in found.collect()}
    assert {("a.DOCX", "山田太郎"), ("a.DOCX", "1.2.3.4"), ("b.pptx", "090-1234-5678"), ("b.pptx", "1.2.3.4"), ("c.pdf", "taro@example.jp"), ("c.pdf", "1.2.3.4")} <= got
    masked = {r["name"]: bytes(r["content"]) for r in d.masked_files(files.where("extension in ('.docx', '.pptx', '.pdf') and length > 100"), found).collect()}
    assert set(masked) == {"masked_a.DOCX", "masked_b.pptx", "masked_c.pdf"}
    assert dict(office.read_docx(masked["masked_a.DOCX"]))["doc:p:0"] == "担当は████です"
    assert dict(office.read_pptx(masked["masked_b.pptx"]))["slide:0:shape:1:r:0:c:0"] == "█" * 7
    assert dict(pdf.read_pdf(masked["masked_c.pdf"]))["pdf:0:8:0"] == "*" * 7
    blocks.unpersist()


def test_file_checks(spark):
    rows = [("x/a.pdf", 0, b""), ("x/A.PDF", 26 * 2**20, b""), ("x/b.doc", 0, b""), ("x.pdf/c", 1, b""), ("x/d.docx", 1, b"")]
    got = d.checked_files(spark.createDataFrame(rows, "path string, length long, content binary")).collect()
    assert [r["problem"] for r in got] == ["empty", "too large", "unsupported format", "unsupported format", None]


GOOD = '{"id":"1","text":"山田です","entities":[{"entity_type":"PERSON","start":0,"end":2,"text":"山田"}]}'


def test_gold_lines(spark, tmp_path):
    path = tmp_path / "g.jsonl"
    path.write_text(f"# note\n\n{GOOD}\n" + GOOD.replace('"1"', '"2"') + "\n", encoding="utf-8")
    rows = d.read_gold(spark, str(path)).orderBy("id").collect()
    assert [r["id"] for r in rows] == ["1", "2"] and rows[0]["split"] == "test" and rows[0]["tags"] == []


@pytest.mark.parametrize("bad", [GOOD.replace('"end":2', '"end":9'), GOOD.replace('"text":"山田"}', '"text":"x"}'), GOOD.replace("}]", '},{"entity_type":"PERSON","start":0,"end":2,"text":"山田"}]'), "{", '{"id":"1"}', GOOD.replace('{"id"', '{"split":"x","id"')])
def test_gold_faults(spark, tmp_path, bad):
    path = tmp_path / "g.jsonl"
    path.write_text(f"# note\n{bad}\n", encoding="utf-8")
    with pytest.raises(InvalidInput, match=":2: "):
        d.read_gold(spark, str(path))


def test_gold_sets_that_are_not_sets(spark, tmp_path):
    path = tmp_path / "g.jsonl"
    path.write_text(f"{GOOD}\n{GOOD}\n", encoding="utf-8")
    with pytest.raises(InvalidInput, match="duplicate"):
        d.read_gold(spark, str(path))
    path.write_text("# nothing\n", encoding="utf-8")
    with pytest.raises(InvalidInput, match="no samples"):
        d.read_gold(spark, str(path))


def test_sessions(spark, tmp_path):
    sessions = d.Sessions(spark, str(tmp_path))
    session = sessions.new_id()
    blocks = spark.createDataFrame([("a", "1.2.3.4 秘密")], "block_id string, text string")
    sessions.save(session, blocks, Engine().findings(blocks))
    blocks, found = sessions.load(session)
    added = manual.add(blocks, found, manual.Selection("a", 8, 10, "CUSTOM"))
    sessions.replace(session, found.unionByName(added.findings))
    blocks, found = d.Sessions(spark, str(tmp_path)).load(session)
    assert sorted(r["text"] for r in found.collect()) == ["1.2.3.4", "秘密"]
    (own,) = found.where(F.col("source") == "manual-selection").collect()
    assert manual.remove(found, own["id"]).count() == 1
    for wrong in ("x", "0" * 32, "../" + "0" * 29):
        with pytest.raises(NotFound):
            d.Sessions(spark, str(tmp_path)).load(wrong)


def test_report(tmp_path):
    path = tmp_path / "r.json"
    assert d.write_report({"a": "山"}, str(path)) == path.read_text(encoding="utf-8") == '{\n  "a": "山"\n}\n'


def test_workbench(spark, folder, tmp_path):
    from maskwright.plans.workbench import Workbench
    from maskwright.schema import MaskwrightError, Unsupported

    bench = Workbench(spark, str(tmp_path / "work"))
    assert bench.info()["status"] == "ok" and bench.entities().count() == 15
    bench.dictionary.create("極秘案件", "CUSTOM")
    text = "極秘案件の連絡先はtaro@example.jp"
    found = bench.analyze_text(text)
    ids = [r["id"] for r in found.collect()]
    assert bench.mask_text(text, found, ids, "entity_label") == "[ユーザー定義]の連絡先は[メールアドレス]"
    assert bench.mask_text(text, found, []) == text
    path = f"{folder}/a.DOCX"
    session = bench.analyze_document(path)
    assert {r["text"] for r in bench.load(session)[1].collect()} == {"1.2.3.4"}
    added = bench.add_finding(session, manual.Selection("doc:p:0", 3, 7, "PERSON", "all", True))
    assert added.dictionary_status == "created" and added.findings.count() == 2
    found = bench.load(session)[1].collect()
    assert [r["block_id"] for r in found] == sorted(r["block_id"] for r in found) and len(found) == 3
    name, data = bench.mask_document(session, path, [r["id"] for r in found] + ["unknown"])
    assert name == "masked_a.DOCX" and dict(office.read_docx(data))["section:0:header:p:0"] == "見出し ████"
    own = next(r["id"] for r in found if r["source"] == "manual-selection")
    bench.remove_finding(session, own)
    assert bench.load(session)[1].count() == 2
    with pytest.raises(MaskwrightError):
        bench.remove_finding(session, next(r["id"] for r in found if r["source"] != "manual-selection"))
    with pytest.raises(Unsupported):
        bench.analyze_document(f"{folder}/d.txt")
    with pytest.raises(InvalidInput):
        bench.analyze_document(f"{folder}/g.pdf")


def test_benchmark_run(spark, tmp_path):
    from maskwright import datagen
    from maskwright.plans import benchmark

    path, out = str(tmp_path / "gold.jsonl"), str(tmp_path / "report.json")
    datagen.main(["--output", path, "--manifest", str(tmp_path / "m.json")])
    gates = ["--fail-under-recall", "0.95", "--fail-under-core-zero-miss-rate", "0.95", "--fail-under-hard-negative-pass-rate", "1.0"]
    assert benchmark.main(["--dataset", path, "--output", out, *gates]) == 0
    assert benchmark.main(["--dataset", path, "--output", out, "--fail-under-recall", "0.99"]) == 1
    import json

    report = json.loads(open(out, encoding="utf-8").read())
    assert report["exact"]["micro"]["tp"] == 1015 and report["metadata"]["dataset_split"] == ["test"] and report["slices"]["hard_negative"]["sample_count"] == 150
    assert benchmark.run(spark, path, Engine(entities=("URL",)))["exact"]["per_entity"]["URL"]["recall"] == 1.0
