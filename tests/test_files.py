"""Parsers, ingest, store and facade on files made here."""

import io
import zipfile

import pytest

from folioscan.functions import a1
from folioscan.operators import chunk, schemas
from folioscan.operators.store import Store
from folioscan.session import Engine
from folioscan.sources import ingest, parsers, registry

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
REL = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
TYPE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def zipped(files: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def docx() -> bytes:
    par = lambda t, style="": f"<w:p>{f'<w:pPr><w:pStyle w:val=\"{style}\"/></w:pPr>' if style else ''}<w:r><w:t>{t}</w:t></w:r></w:p>"
    row = lambda *c: "<w:tr>" + "".join(f"<w:tc>{par(x)}</w:tc>" for x in c) + "</w:tr>"
    body = par("Introduction", "H1") + par("Vendor Name: Acme Corp") + par("Total: $1,080.00") + par("Data Section", "H2") + f"<w:tbl>{row('Item', 'Quantity')}{row('Bolt', '7')}</w:tbl>" + par("Conclusion", "H2") + par("Done.")
    style = lambda i, n: f'<w:style w:styleId="{i}"><w:name w:val="{n}"/></w:style>'
    return zipped({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/styles.xml": f"<w:styles {W}>{style('H1', 'heading 1')}{style('H2', 'heading 2')}</w:styles>"})


def xlsx() -> bytes:
    cells = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><v>5</v></c></row><row r="2" hidden="1"><c r="A2" t="inlineStr"><is><t>x</t></is></c><c r="B2"><f>B1*2</f><v>10</v></c></row>'
    return zipped({
        "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="Sums" sheetId="1" r:id="r1"/><sheet name="Gone" sheetId="2" state="hidden" r:id="r2"/></sheets><definedNames><definedName name="Rate">Sums!$B$1</definedName></definedNames></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships {REL}><Relationship Id="r1" Type="{TYPE}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="{TYPE}/worksheet" Target="worksheets/sheet2.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {S}><si><t>total</t></si></sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData>{cells}</sheetData><mergeCells><mergeCell ref="A1:A2"/></mergeCells></worksheet>',
        "xl/worksheets/sheet2.xml": f"<worksheet {S}><sheetData/></worksheet>",
    })


def pptx() -> bytes:
    shape = lambda t, ph="": f"<p:sp><p:nvSpPr><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>"
    slide = lambda x: f"<p:sld {P}><p:cSld><p:spTree>{x}</p:spTree></p:cSld></p:sld>"
    return zipped({
        "ppt/presentation.xml": f'<p:presentation {P}><p:sldIdLst><p:sldId id="256" r:id="r1"/></p:sldIdLst><p:sldSz cx="9144000" cy="6858000"/></p:presentation>',
        "ppt/_rels/presentation.xml.rels": f'<Relationships {REL}><Relationship Id="r1" Type="{TYPE}/slide" Target="slides/slide1.xml"/></Relationships>',
        "ppt/slides/slide1.xml": slide(shape("Agenda", '<p:ph type="title"/>') + shape("First point")),
        "ppt/slides/_rels/slide1.xml.rels": f'<Relationships {REL}><Relationship Id="n1" Type="{TYPE}/notesSlide" Target="../notesSlides/notesSlide1.xml"/></Relationships>',
        "ppt/notesSlides/notesSlide1.xml": slide(shape("Remember", '<p:ph type="body"/>')),
    })


RTF = rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}\b Introduction\b0\par Caf\'e9 \u8364?5\par\par Total: $500.00\par}"


def test_csv():
    found = parsers.parse_csv(b"Name,Age\nAlice,29\nBob\n", "people.csv")
    assert found["tables"][0]["row_count"] == 3 and found["tables"][0]["column_count"] == 2
    assert found["sheets"][0]["used_range"] == "A1:B3"
    assert [c["value"] for c in found["table_cells"]] == ["Name", "Age", "Alice", "29", "Bob"]
    assert parsers.parse_csv(b"a;b\n1;2\n", "s.csv")["tables"][0]["column_count"] == 2
    assert parsers.parse_csv("José,São Paulo\n".encode("latin-1"), "l.csv")["table_cells"][0]["value"] == "José"
    assert parsers.parse_csv(b"", "e.csv")["parse_warnings"][0]["code"] == "EMPTY_CSV"


def test_rtf():
    assert [b["text"] for b in parsers.parse_rtf(RTF, "a.rtf")["text_blocks"]] == ["Introduction", "Café €5", "Total: $500.00"]


def test_xlsx():
    found = parsers.parse_xlsx(xlsx(), "a.xlsx")
    assert [(c["source_cell_ref"], c["value"]) for c in found["table_cells"]] == [("A1", "total"), ("B1", "5"), ("A2", "x"), ("B2", "10")]
    assert found["formulas"] == [{"sheet_name": "Sums", "cell_address": "B2", "formula_text": "=B1*2", "calculated_value": "10"}]
    assert found["named_ranges"] == {"Rate": "Sums!$B$1"}
    assert {w["code"] for w in found["parse_warnings"]} == {"HIDDEN_ROWS", "HIDDEN_SHEET"}


def test_pptx():
    assert [(b["text"], b["block_type"]) for b in parsers.parse_pptx(pptx(), "a.pptx")["text_blocks"]] == [("Agenda", "heading"), ("First point", "paragraph"), ("Remember", "footnote")]


def test_broken_and_unknown_files_are_rows():
    assert registry.parse("xlsx", b"junk", "a")["errors"]
    assert registry.parse("text", b"x", "a")["errors"] == ["No parser available for file type: text"]
    registry.register("text", lambda data, name: parsers.empty(text_blocks=[{"page_number": 1, "text": data.decode()}]))
    assert registry.parse("text", b"x", "a")["text_blocks"][0]["text"] == "x"
    del registry.PARSERS["text"]


def test_addresses():
    assert a1.parse_cell("$B$12") == (12, 2) and a1.parse_cell("12B") is None
    assert a1.parse_range("A1:C10") == (1, 1, 10, 3) and a1.parse_range("A1") is None


def test_folder_to_answers(spark, tmp_path):
    files = tmp_path / "in"
    files.mkdir()
    for name, data in (("a.docx", docx()), ("b.xlsx", xlsx()), ("c.csv", b"product,revenue\nWidget,5\n"), ("d.rtf", RTF), ("e.pptx", pptx()), ("f.pdf", b"no")):
        (files / name).write_bytes(data)
    engine = Engine(spark, Store(spark, str(tmp_path / "store"), 4))
    assert tuple(engine.upload(str(files)).first()) == (6, 5, 1)
    ids = {r["filename"]: r["document_id"] for r in engine.tables["documents"].collect()}
    sections = {r["title"]: r for r in engine.tables["sections"].where(f"document_id = '{ids['a.docx']}'").collect()}
    assert sections["Conclusion"]["parent_section_id"] == sections["Introduction"]["section_id"] is not None or sections["Conclusion"]["heading_level"] == 1
    assert engine.search_corpus("widget").first()["citation"] == "sheet 'Sheet1', cell R1C0"
    md = engine.to_markdown([ids["a.docx"]]).first()["markdown"]
    assert md.startswith("# a.docx\n") and "| Bolt | 7 |" in md and "## Introduction" in md
    fields = engine.extract("invoice", [ids["a.docx"]])
    values = {r["field_path"]: r["value_str"] for r in fields.collect()}
    assert values["vendor_name"] == "Acme Corp" and values["total"] == "$1,080.00"
    rules = {r["rule_name"] for r in engine.validate(fields).collect()}
    assert "required_field_null" in rules
    cell = engine.read_range("Sums", "A1:B2", [ids["b.xlsx"]]).where("address = 'B2'").first()
    assert cell["formula"] == "=B1*2" and cell["is_hidden"]
    assert engine.inspect_formula("Sums", "b2").first()["referenced_cells"] == ["B1"]
    assert engine.profile([ids["e.pptx"]]).first()["likely_document_types"] == ["presentation"]
    assert engine.chunk(chunk.Chunking("table_only")).count() == 3
    for bad in (chunk.Chunking("nothing"),):
        with pytest.raises(ValueError):
            engine.chunk(bad)
    with pytest.raises(ValueError):
        engine.export(fields, "xml")
    auto = {(r["document_id"], r["schema_id"]) for r in engine.extract().collect()}
    assert (ids["b.xlsx"], "financial_model") in auto or (ids["a.docx"], "table") in auto
    table = {r["field_path"]: r for r in engine.extract("data_table", [ids["c.csv"]]).collect()}
    assert table["columns"]["value_list"] == ["product:string", "revenue:integer"] and table["row_count"]["value_num"] == 1
    assert table["rows"]["value_list"] == ['{"product":"Widget","revenue":"5"}']
    book = {r["field_path"]: r for r in engine.extract("invoice", [ids["b.xlsx"]]).collect()}
    assert len(book) == 12 and book["total"]["value_num"] == 5 and book["total"]["confidence"] == 0.8
    assert book["vendor_name"]["value_kind"] == "null" and book["vendor_name"]["confidence"] == 0 and book["vendor_name"]["citation"] is None
    assert engine.validate(engine.extract("invoice", [ids["b.xlsx"]])).where("rule_name = 'required_field_null' and field = 'vendor_name'").count() == 1
    kept = {r["schema_id"]: r["extraction_id"] for r in engine.save_extraction(engine.extract("invoice", [ids["a.docx"]])).collect()}
    kept |= {r["schema_id"]: r["extraction_id"] for r in engine.save_extraction(engine.extract("contract", [ids["a.docx"]])).collect()}
    engine.save_extraction(engine.extract("invoice", [ids["a.docx"], ids["b.xlsx"]]))
    assert engine.list_extractions(ids["a.docx"]).count() == 2 and engine.list_extractions().count() == 3
    again = engine.get_extraction(kept["invoice"])
    assert {r["field_path"]: r["value_str"] for r in again.collect()} == values and set(again.columns) == set(fields.columns)
    assert {r["rule_name"] for r in engine.validate_extraction(kept["invoice"]).collect()} == rules
    assert "Acme Corp" in engine.export_extraction(kept["invoice"], "csv").first()["content"]
    with pytest.raises(KeyError):
        engine.get_extraction("none")
    chunks = engine.chunk(ids=[ids["a.docx"]]).collect()
    assert any(r["section_path"] for r in chunks) and all(c["snippet"] == r["text"][:100] for r in chunks for c in r["citations"])
    assert {c["sheet_name"] for r in engine.chunk(chunk.Chunking("table_only"), [ids["c.csv"]]).collect() for c in r["citations"]} == {"Sheet1"}
    store = engine.store
    assert store.load("documents", ids["c.csv"]).count() == 1
    assert store.delete("documents", ids["c.csv"]) and not store.delete("documents", ids["c.csv"])
    assert store.ids().count() == 5


def test_json_schema_round_trip():
    made = schemas.Registry().from_json_schema({"title": "T", "properties": {"n": {"type": "integer", "minimum": 1}, "d": {"type": "string", "format": "date"}}, "required": ["n"]})
    assert schemas.to_json_schema(made)["properties"] == {"n": {"type": "integer", "minimum": 1}, "d": {"type": "string", "format": "date"}}


def test_stream(spark, tmp_path):
    from folioscan.streaming.ingest import watch

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_bytes(b"a,b\n1,2\n")
    store = Store(spark, str(tmp_path / "store"), 2)
    for _ in range(2):
        watch(spark, str(tmp_path / "in"), store, str(tmp_path / "cp"), once=True).awaitTermination(120)
    assert store.load("table_cells").count() == 4
    assert Engine(spark, store).open().to_markdown().count() == 1


def plain_text(data, name):
    return parsers.empty(text_blocks=[{"page_number": 1, "text": data.decode()}])


def test_registered_parsers_reach_the_workers(spark, monkeypatch):
    registry.register("text", plain_text)
    try:
        found = ingest.elements(ingest.from_bytes(spark, {"a.txt": b"hello"}))
        assert found.where("kind = 'text_blocks'").count() == 1
    finally:
        del registry.PARSERS["text"]
    monkeypatch.setattr(registry, "MAX_BYTES", 3)
    found = ingest.elements(ingest.from_bytes(spark, {"a.csv": b"a,b\n", "b.csv": b"a\n"}))
    assert found.where("kind = 'documents' and data like '%larger than%'").count() == 1 and found.where("kind = 'table_cells'").select("document_id").distinct().count() == 1


def test_bytes(spark):
    with pytest.raises(ValueError):
        ingest.from_bytes(spark, {"../a.csv": b""})
    assert ingest.elements(ingest.from_bytes(spark, {"a.csv": b"a,b\n"})).where("kind = 'table_cells'").count() == 2
