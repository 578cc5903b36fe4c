"""Text and identifier functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utf16_text(raw: Column) -> Column:
    """UTF-16 little-endian bytes up to the first NUL, as text; surrogate pairs become one character."""
    return F.substring_index(F.decode(raw, "UTF-16LE"), "\x00", 1)


def uuid_text(raw: Column) -> Column:
    """16 bytes, the first three groups little-endian, as lower-case hyphenated text."""
    digits = F.lower(F.hex(raw))

    def turned(at: int, size: int) -> Column:
        return F.concat(*(F.substring(digits, 2 * k + 1, 2) for k in reversed(range(at, at + size))))

    return F.concat_ws("-", turned(0, 4), turned(4, 2), turned(6, 2), F.substring(digits, 17, 4), F.substring(digits, 21, 12))


def quoted(value: Column) -> Column:
    """A string literal of SQL."""
    return F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'"))


def canonical_path(path: Column) -> Column:
    """Slashes forward and single, one in front, none at the end."""
    clean = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+", "/")
    clean = F.regexp_replace(clean, "/$", "")
    return F.when(clean.startswith("/"), clean).otherwise(F.concat(F.lit("/"), clean))


def parent_path(path: Column) -> Column:
    """The path without its last part; `/` for a part of the root."""
    parent = F.regexp_replace(canonical_path(path), "/[^/]*$", "")
    return F.when(parent == "", "/").otherwise(parent)


def leaf_name(path: Column) -> Column:
    return F.substring_index(canonical_path(path), "/", -1)


def tag_text(xml: Column, tag: str) -> Column:
    """Trimmed text of the first element of the name, empty if there is none."""
    return F.trim(F.regexp_extract(xml, f"(?s)<{tag}>(.*?)</{tag}>", 1))


def tag_blocks(xml: Column, tag: str) -> Column:
    """All elements of the name, outermost text included."""
    return F.regexp_extract_all(xml, F.lit(f"(?s)<{tag}[ >].*?</{tag}>"), F.lit(0))


def attribute_text(xml: Column, name: str) -> Column:
    return F.regexp_extract(xml, f"""{name}=["']([^"']*)["']""", 1)


#: Cells are counted from here on, so that their numbers are positive.
CELL_BASE = 1 << 29


def cell_id(coordinate: Column, resolution: float) -> Column:
    """Number of the grid cell that a coordinate lies in."""
    return F.greatest(F.lit(0), F.least(F.lit((1 << 31) - 1), F.floor(coordinate / resolution) + CELL_BASE)).cast("long")


def grid_to_real(grid: Column, origin: float, scale: float) -> Column:
    return grid / scale + origin


def real_to_grid(real: Column, origin: float, scale: float) -> Column:
    return F.round((real - origin) * scale).cast("long")
