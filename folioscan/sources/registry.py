"""File types and parsers: detection as Column functions, dispatch by type, new parsers by registration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema
from . import parsers

MAX_BYTES = 500 * 1024 * 1024
PARSERS: dict[str, Callable[[bytes, str], dict]] = {"csv": parsers.parse_csv, "xlsx": parsers.parse_xlsx, "docx": parsers.parse_docx, "pptx": parsers.parse_pptx, "rtf": parsers.parse_rtf}


def register(file_type: str, parser: Callable[[bytes, str], dict]) -> None:
    """Adds a parser or replaces the one of a type, for reads that start from now on; it travels to the workers with the read."""
    PARSERS[file_type] = parser


def _mapped(c: Column, pairs: dict[str, str], default: str) -> Column:
    out = F.lit(default)
    for k, v in reversed(pairs.items()):
        out = F.when(c == k, v).otherwise(out)
    return out


def file_type(path: Column) -> Column:
    return _mapped(F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)), schema.FILE_TYPES, "unknown")


def mime_type(kind: Column) -> Column:
    return _mapped(kind, schema.MIME_TYPES, "application/octet-stream")


def parse(kind: str, data: bytes | None, name: str, known: dict[str, Callable[[bytes, str], dict]] | None = None) -> dict:
    """Elements of one file by the parsers known (None: those registered here); failures are data: {"errors": [...]}. data None: too large to be read."""
    if data is None or len(data) > MAX_BYTES:
        return parsers.empty(errors=[f"file is larger than {MAX_BYTES} bytes"])
    parser = (PARSERS if known is None else known).get(kind)
    if parser is None:
        reason = {"xls": "xlrd is not installed", "pdf": "PyMuPDF is not installed"}.get(kind, f"No parser available for file type: {kind}")
        return parsers.empty(errors=[reason])
    try:
        return parser(data, name)
    except Exception as e:  # a broken file is a row, not a failed job
        return parsers.empty(errors=[f"{type(e).__name__}: {e}"])
