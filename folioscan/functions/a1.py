"""A1 addresses as Column functions: parsing, ranges, membership and the inverse."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_CELL = r"^\s*\$?([A-Za-z]+)\$?(\d+)\s*$"


def column_number(letters: Column) -> Column:
    """Base 26, A = 1."""
    return F.aggregate(F.split(F.upper(letters), ""), F.lit(0), lambda acc, x: acc * 26 + F.ascii(x) - 64)


def row_of(address: Column) -> Column:
    """1-based row; null for what is no cell address."""
    return F.regexp_extract(F.replace(address, F.lit("$"), F.lit("")), _CELL, 2).try_cast("int")


def col_of(address: Column) -> Column:
    """1-based column; null for what is no cell address."""
    letters = F.regexp_extract(F.replace(address, F.lit("$"), F.lit("")), _CELL, 1)
    return F.when(letters != "", column_number(letters))


def column_letters(number: Column) -> Column:
    """The inverse of column_number for 1 .. 18,278; numbers below 1 give A."""
    n = F.greatest(number, F.lit(1)) - 1
    letter = lambda k: F.chr(65 + k % 26)
    two, three = F.floor(n / 26) - 1, F.floor((F.floor(n / 26) - 1) / 26) - 1
    return F.concat(F.when(n >= 702, letter(three)).otherwise(""), F.when(n >= 26, letter(F.when(n >= 26, two).otherwise(0))).otherwise(""), letter(n))


def address(row: Column, col: Column) -> Column:
    return F.concat(column_letters(col), row.cast("string"))


def parse_cell(text: str) -> tuple[int, int] | None:
    """(row, column), 1-based, of one address on the driver."""
    m = re.match(r"^([A-Z]+)(\d+)$", text.strip().replace("$", ""), re.IGNORECASE)
    if not m:
        return None
    col = 0
    for c in m[1].upper():
        col = col * 26 + ord(c) - 64
    return int(m[2]), col


def parse_range(text: str) -> tuple[int, int, int, int] | None:
    """(first row, first column, last row, last column) of "A1:C10"; corners are taken as given."""
    ends = text.split(":")
    if len(ends) != 2:
        return None
    a, b = parse_cell(ends[0]), parse_cell(ends[1])
    return (*a, *b) if a and b else None


def in_range(row: Column, col: Column, box: tuple[int, int, int, int]) -> Column:
    return row.between(box[0], box[2]) & col.between(box[1], box[3])
