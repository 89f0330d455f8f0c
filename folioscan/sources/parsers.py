"""File bytes to elements, with the standard library alone. A parser returns a dict of lists of dicts, one list for each table of the model."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

CSV_ROWS = 100_000
SNIFFED = 8192


def empty(**given) -> dict:
    return {"pages": [], "text_blocks": [], "tables": [], "table_cells": [], "sheets": [], "formulas": [], "figures": [], "parse_warnings": [], "metadata": {}, "named_ranges": {}, "external_links": [], "errors": []} | given


def letters(n: int) -> str:
    out = ""
    while n > 0:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out or "A"


def decode(data: bytes) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def parse_csv(data: bytes, name: str) -> dict:
    """One sheet with one table; the header is row 0; ragged rows stay; at most 100,000 rows with a warning."""
    out, text = empty(), decode(data)
    try:
        dialect = csv.Sniffer().sniff(text[:SNIFFED])
    except csv.Error:
        dialect = csv.excel
    rows = []
    for row in csv.reader(io.StringIO(text, newline=""), dialect):
        if len(rows) == CSV_ROWS:
            out["parse_warnings"].append({"code": "TRUNCATED", "message": f"Only the first {CSV_ROWS} rows were read"})
            break
        rows.append(row)
    if not rows:
        out["parse_warnings"].append({"code": "EMPTY_CSV", "message": "The file has no rows"})
        return out
    width = max(map(len, rows))
    stem = re.sub(r"\.[^.]*$", "", name.rsplit("/", 1)[-1])
    out["tables"].append({"title": stem, "sheet_name": "Sheet1", "row_count": len(rows), "column_count": width, "confidence": 1.0})
    out["sheets"].append({"name": "Sheet1", "index": 0, "is_visible": True, "used_range": f"A1:{letters(width)}{len(rows)}", "row_count": len(rows), "column_count": width})
    out["table_cells"] = [{"table": 0, "row_index": r, "column_index": k, "value": v, "data_type": "string"} for r, row in enumerate(rows) for k, v in enumerate(row)]
    return out


# Office files: zip archives of XML. Tags are compared without their namespaces.


def _tag(e) -> str:
    return e.tag.rpartition("}")[2]


def _attr(e, name: str, default: str | None = None) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), default)


def _all(e, name: str) -> Iterator:
    return (x for x in e.iter() if _tag(x) == name)


def _child(e, name: str):
    return next((x for x in e if _tag(x) == name), None) if e is not None else None


def _xml(z: zipfile.ZipFile, path: str):
    return ElementTree.fromstring(z.read(path)) if path in z.namelist() else None


def _core(z: zipfile.ZipFile) -> dict[str, str]:
    root = _xml(z, "docProps/core.xml")
    names = {"title": "title", "subject": "subject", "creator": "author"}
    return {names[_tag(e)]: e.text for e in root if _tag(e) in names and e.text} if root is not None else {}


def _relations(z: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    folder, _, file = part.rpartition("/")
    root = _xml(z, f"{folder}/_rels/{file}.rels")
    out = {}
    for e in root if root is not None else ():
        target = e.get("Target", "")
        path = target.lstrip("/") if target.startswith("/") else f"{folder}/{target}"
        while "/../" in path:
            path = re.sub(r"[^/]+/\.\./", "", path, count=1)
        out[e.get("Id", "")] = (path, e.get("Type", "").rpartition("/")[2])
    return out


def _number(text: str) -> str:
    try:
        x = float(text)
    except ValueError:
        return text
    return str(int(x)) if x.is_integer() and "." not in text and "e" not in text.lower() else str(x)


def parse_xlsx(data: bytes, name: str) -> dict:
    """All sheets with cells, formulas and cached values, hidden parts, merged ranges, comments, named ranges and external links."""
    out = empty()
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        book, rels = _xml(z, "xl/workbook.xml"), _relations(z, "xl/workbook.xml")
        root = _xml(z, "xl/sharedStrings.xml")
        shared = ["".join(t.text or "" for t in _all(si, "t")) for si in root] if root is not None else []
        out["named_ranges"] = {_attr(d, "name"): d.text or "" for d in _all(book, "definedName")}
        out["external_links"] = sorted(p for p, kind in rels.values() if kind == "externalLink")
        out["metadata"] = _core(z) | {"has_macros": str("xl/vbaProject.bin" in z.namelist()).lower()}
        if out["external_links"]:
            out["parse_warnings"].append({"code": "EXTERNAL_LINKS", "message": f"Workbook has {len(out['external_links'])} external links"})
        for index, s in enumerate(_all(book, "sheet")):
            title, path = _attr(s, "name"), rels[_attr(s, "id")][0]
            _sheet(out, z, path, index, title, _attr(s, "state", "visible") == "visible", shared)
    return out


def _sheet(out: dict, z: zipfile.ZipFile, path: str, index: int, title: str, visible: bool, shared: list[str]) -> None:
    root = _xml(z, path)
    comments = []
    for part, kind in _relations(z, path).values():
        if kind == "comments" and (notes := _xml(z, part)) is not None:
            authors = [a.text or "" for a in _all(notes, "author")]
            comments += [{"cell": _attr(c, "ref"), "author": authors[int(_attr(c, "authorId", "0"))] if authors else "", "text": "".join(t.text or "" for t in _all(c, "t"))} for c in _all(notes, "comment")]
    hidden_rows = [int(_attr(r, "r")) for r in _all(root, "row") if _attr(r, "hidden") in ("1", "true") and _attr(r, "r")]
    hidden_cols = [k for c in _all(root, "col") if _attr(c, "hidden") in ("1", "true") for k in range(int(_attr(c, "min")), int(_attr(c, "max")) + 1)]
    cells, top, wide = [], 0, 0
    table = len(out["tables"])
    for c in _all(root, "c"):
        ref = _attr(c, "r") or ""
        m = re.match(r"([A-Z]+)(\d+)$", ref)
        if not m:
            continue
        row, col = int(m[2]), 0
        for ch in m[1]:
            col = col * 26 + ord(ch) - 64
        kind, v, f = _attr(c, "t", "n"), _child(c, "v"), _child(c, "f")
        if kind == "inlineStr":
            value = "".join(t.text or "" for t in _all(c, "t"))
        elif v is None or v.text is None:
            value = None
        elif kind == "s":
            value = shared[int(v.text)]
        elif kind == "b":
            value = str(v.text == "1")
        else:
            value = _number(v.text) if kind == "n" else v.text
        formula = "=" + (f.text or "") if f is not None and f.text else None
        if value is None and formula is None:
            continue
        cells.append({"table": table, "row_index": row - 1, "column_index": col - 1, "value": formula if value is None else value, "data_type": kind, "source_cell_ref": ref})
        top, wide = max(top, row), max(wide, col)
        if formula:
            out["formulas"].append({"sheet_name": title, "cell_address": ref, "formula_text": formula, "calculated_value": value})
    for code, some, what in (("HIDDEN_SHEET", not visible, f"Sheet '{title}' is hidden"), ("HIDDEN_ROWS", hidden_rows, f"Sheet '{title}' has {len(hidden_rows)} hidden rows"), ("HIDDEN_COLUMNS", hidden_cols, f"Sheet '{title}' has {len(hidden_cols)} hidden columns")):
        if some:
            out["parse_warnings"].append({"code": code, "message": what, "sheet": title})
    used = f"A1:{letters(wide)}{top}" if cells else None
    merged = [_attr(m, "ref") for m in _all(root, "mergeCell")]
    out["sheets"].append({"name": title, "index": index, "is_visible": visible, "used_range": used, "row_count": top, "column_count": wide, "merged_cells": merged, "hidden_rows": hidden_rows, "hidden_columns": hidden_cols, "comments": comments})
    if cells:
        out["tables"].append({"title": title, "sheet_name": title, "row_count": top, "column_count": wide, "confidence": 1.0})
        out["table_cells"] += cells


def _grid(out: dict, rows: list[list[str]], page: int, title: str) -> None:
    table = len(out["tables"])
    out["tables"].append({"title": title, "page_number": page, "row_count": len(rows), "column_count": max(map(len, rows), default=0), "confidence": 1.0})
    out["table_cells"] += [{"table": table, "row_index": r, "column_index": k, "value": v, "data_type": "string"} for r, row in enumerate(rows) for k, v in enumerate(row)]


def parse_docx(data: bytes, name: str) -> dict:
    """Paragraphs and tables of the body on page 1; heading styles give the sizes that make sections."""
    out = empty()
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body, styles = _child(_xml(z, "word/document.xml"), "body"), _xml(z, "word/styles.xml")
        names = {_attr(s, "styleId"): _attr(_child(s, "name"), "val", "") for s in _all(styles, "style") if _child(s, "name") is not None} if styles is not None else {}
        out["metadata"] = _core(z)
        text = lambda p: "".join("\t" if _tag(x) == "tab" else "\n" if _tag(x) == "br" else x.text or "" for x in p.iter() if _tag(x) in ("t", "tab", "br"))
        for e in body:
            if _tag(e) == "p" and (t := text(e).strip()):
                style = _child(_child(e, "pPr"), "pStyle")
                style = names.get(_attr(style, "val", ""), _attr(style, "val", "")).lower() if style is not None else ""
                kind, size = "paragraph", 12.0
                if m := re.match(r"heading ?(\d)", style):
                    kind, size = "heading", float(max(24 - 3 * (int(m[1]) - 1), 12))
                elif style in ("title", "subtitle"):
                    kind, size = "heading", 28.0 if style == "title" else 20.0
                elif style.startswith("list"):
                    kind = "list_item"
                out["text_blocks"].append({"page_number": 1, "text": t, "block_type": kind, "font_size": size, "confidence": 1.0})
            elif _tag(e) == "tbl":
                rows = [["\n".join(text(p) for p in c if _tag(p) == "p").strip() for c in r if _tag(c) == "tc"] for r in e if _tag(r) == "tr"]
                _grid(out, rows, 1, f"Table {len(out['tables']) + 1}")
        out["figures"] = [{"page_number": None, "figure_type": "image"} for _, kind in _relations(z, "word/document.xml").values() if kind == "image"]
    out["pages"].append({"page_number": 1, "width": 612.0, "height": 792.0})
    if not out["text_blocks"] and not out["tables"]:
        out["parse_warnings"].append({"code": "EMPTY_DOCUMENT", "message": "The document has no content"})
    return out


def parse_pptx(data: bytes, name: str) -> dict:
    """Slides as pages: title shapes as headings, other paragraphs, tables, notes as footnotes."""
    out = empty()
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        deck, rels = _xml(z, "ppt/presentation.xml"), _relations(z, "ppt/presentation.xml")
        size = next(_all(deck, "sldSz"), None)
        wide, high = (int(_attr(size, k)) / 12700 if size is not None else d for k, d in (("cx", 720.0), ("cy", 540.0)))
        out["metadata"] = _core(z)
        lines = lambda e: [t for p in _all(e, "p") if (t := "".join(x.text or "" for x in _all(p, "t")).strip())]
        for n, s in enumerate(_all(deck, "sldId"), 1):
            path = rels[next(v for k, v in s.attrib.items() if k.endswith("}id"))][0]
            out["pages"].append({"page_number": n, "width": wide, "height": high})
            block = lambda t, kind, font: out["text_blocks"].append({"page_number": n, "text": t, "block_type": kind, "font_size": font, "confidence": 1.0})  # noqa: B023, E731
            tree = next(_all(_xml(z, path), "spTree"))
            for shape in tree:
                if _tag(shape) == "sp":
                    place = next(_all(shape, "ph"), None)
                    title = place is not None and _attr(place, "type") in ("title", "ctrTitle")
                    for t in lines(shape):
                        block(t, *(("heading", 24.0) if title else ("paragraph", 12.0)))
                elif _tag(shape) == "graphicFrame" and (tbl := next(_all(shape, "tbl"), None)) is not None:
                    _grid(out, [["\n".join(lines(c)) for c in r if _tag(c) == "tc"] for r in tbl if _tag(r) == "tr"], n, f"Table on Slide {n}")
                elif _tag(shape) == "pic":
                    out["figures"].append({"page_number": n, "figure_type": "image"})
            for part, kind in _relations(z, path).values():
                if kind == "notesSlide":
                    for shape in _all(_xml(z, part), "sp"):
                        place = next(_all(shape, "ph"), None)
                        if place is not None and _attr(place, "type") == "body":
                            for t in lines(shape):
                                block(t, "footnote", 10.0)
    if not out["text_blocks"] and not out["tables"]:
        out["parse_warnings"].append({"code": "EMPTY_DOCUMENT", "message": "The presentation has no content"})
    return out


_RTF = re.compile(r"\\([a-z]{1,32})(-?\d{1,10})?[ ]?|\\'([0-9a-fA-F]{2})|\\([^a-z])|([{}])|[\r\n]+|(.)", re.IGNORECASE | re.DOTALL)
# Control words whose groups hold no text, and control words that are characters.
RTF_SILENT = frozenset("fonttbl colortbl stylesheet info pict header footer headerl headerr footerl footerr generator listtable listoverridetable rsidtbl themedata datastore xmlnstbl latentstyles object fldinst".split())
RTF_CHARS = {"par": "\n", "line": "\n", "sect": "\n", "page": "\n", "row": "\n", "tab": "\t", "cell": "\t", "emdash": "—", "endash": "–", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”"}


def rtf_text(text: str) -> str:
    """Plain text of an RTF document."""
    stack, silent, skip, uc, out = [], False, 0, 1, []
    for word, arg, hexed, char, brace, plain in _RTF.findall(text):
        if brace == "{":
            stack.append((silent, uc))
        elif brace == "}":
            silent, uc = stack.pop() if stack else (False, 1)
        elif char == "*":
            silent = True
        elif word:
            if word in RTF_SILENT:
                silent = True
            elif silent:
                continue
            elif word == "uc":
                uc = int(arg or 1)
            elif word == "u" and arg:
                out.append(chr(int(arg) % 65536))
                skip = uc
            elif word in RTF_CHARS:
                out.append(RTF_CHARS[word])
        elif silent:
            continue
        elif hexed or plain:
            if skip:
                skip -= 1
            else:
                out.append(bytes([int(hexed, 16)]).decode("cp1252", "replace") if hexed else plain)
        elif char in "\\{}":
            out.append(char)
        elif char == "~":
            out.append(" ")
    return "".join(out)


def parse_rtf(data: bytes, name: str) -> dict:
    """Non-blank lines as paragraphs on page 1."""
    out = empty()
    lines = [t for x in rtf_text(decode(data)).split("\n") if (t := x.strip())]
    out["pages"].append({"page_number": 1, "width": 612.0, "height": 792.0})
    out["text_blocks"] = [{"page_number": 1, "text": t, "block_type": "paragraph", "font_size": 12.0, "confidence": 0.8} for t in lines]
    out["metadata"] = {"paragraph_count": str(len(lines)), "char_count": str(sum(map(len, lines)))}
    if not lines:
        out["parse_warnings"].append({"code": "EMPTY_DOCUMENT", "message": "The document has no text"})
    return out
