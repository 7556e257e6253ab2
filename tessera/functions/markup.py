"""SVG, JSON, glTF and mesh text made shorter without a change of what they show.

SVG and JSON are trees; each file is parsed by the standard library within an
Arrow function. Texts of lines are Column expressions.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from xml.parsers import expat
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.sources.rasters import UNREADABLE
from tessera.sources.writers import glb_of

#: Elements without effect, colour attributes, versions that say nothing, keys that a viewer does not need (fixed values).
METADATA = ("metadata", "title", "desc")
COLORS = ("fill", "stroke", "stop-color", "flood-color", "color", "lighting-color", "solid-color")
VERSIONS = ("1.0", "1.1", "1.2")
EXTRA_KEYS = ("extras", "name", "copyright", "generator")
#: Up to this quality attributes go that are no part of the image.
AGGRESSIVE = 60


# ---- SVG ----


def _local(name: str) -> str:
    return name.rpartition(":")[2]


def short_color(value: str) -> str:
    """#rrggbb with equal pairs becomes #rgb, in lower case; anything else stays as it is."""
    v = value.strip()
    if len(v) != 7 or v[0] != "#":
        return value
    low = v.lower()
    return f"#{low[1]}{low[3]}{low[5]}" if low[1] == low[2] and low[3] == low[4] and low[5] == low[6] else value


def prune_svg(data: bytes, quality: int = 80, preserve: bool = False) -> bytes:
    """Without comments, elements of metadata with all they hold, and text that is only white space; without declarations unless `preserve`.

    Colours are shortened. At a quality of AGGRESSIVE or less the version goes.
    Text and attribute values are escaped anew. Raises ValueError for what is
    no well-formed XML.
    """
    out: list[str] = []
    skipped, opened = 0, False  # depth within skipped elements; a start tag that still lacks its end
    parser = expat.ParserCreate()
    parser.ordered_attributes, parser.buffer_text = True, True

    def close() -> None:
        nonlocal opened
        if opened:
            out.append(">")
            opened = False

    def start(name: str, attributes: list[str]) -> None:
        nonlocal skipped, opened
        if skipped or _local(name) in METADATA:
            skipped += 1
            return
        close()
        pairs = [(k, short_color(v) if _local(k) in COLORS else v) for k, v in zip(attributes[::2], attributes[1::2], strict=True)]
        kept = [(k, v) for k, v in pairs if not (quality <= AGGRESSIVE and _local(k) == "version" and v in VERSIONS)]
        out.append(f"<{name}{''.join(f' {k}={quoteattr(v)}' for k, v in kept)}")
        opened = True

    def end(name: str) -> None:
        nonlocal skipped, opened
        if skipped:
            skipped -= 1
        elif opened:
            out.append("/>")
            opened = False
        else:
            out.append(f"</{name}>")

    def characters(value: str) -> None:
        if not skipped and value.strip():
            close()
            out.append(escape(value))

    def declared(version: str, encoding: str | None, standalone: int) -> None:
        out.append(f'<?xml version="{version}"{f" encoding={quoteattr(encoding)}" if encoding else ""}?>')

    def instruction(target: str, value: str) -> None:
        if not skipped:
            close()
            out.append(f"<?{target} {value}?>")

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, characters
    if preserve:
        parser.XmlDeclHandler, parser.ProcessingInstructionHandler = declared, instruction
    try:
        parser.Parse(data, True)
    except expat.ExpatError as e:
        raise ValueError(str(e)) from e
    return "".join(out).encode("utf-8")


# ---- JSON ----


def prune_json(value: object, aggressive: bool) -> object:
    """Members that are null or empty go, from the top down, so that a parent that loses all its members stays; EXTRA_KEYS at any level where `aggressive`."""
    if isinstance(value, dict):
        return {k: prune_json(v, aggressive) for k, v in value.items() if not (v is None or v == "" or v == [] or v == {}) and not (aggressive and k in EXTRA_KEYS)}
    if isinstance(value, list):
        return [prune_json(v, aggressive) for v in value]
    return value


def compact_json(data: bytes, aggressive: bool) -> bytes:
    return json.dumps(prune_json(json.loads(data), aggressive), separators=(",", ":"), ensure_ascii=False).encode("utf-8")


def prune_glb(data: bytes, aggressive: bool) -> bytes:
    """The JSON chunk pruned, the first binary chunk as it is, no others; lengths and padding made right."""
    if data[:4] != b"glTF":
        raise ValueError("no GLB")
    at, found = 12, {}
    while at + 8 <= len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        found.setdefault(data[at + 4 : at + 8], data[at + 8 : at + 8 + n])
        at += 8 + n
    return glb_of(compact_json(found[b"JSON"], aggressive), found.get(b"BIN\0"))


def _each(change: Callable[[bytes], bytes]) -> Callable[[Column], Column]:
    """A change of whole files as a Column function; a file that it can't read gives null."""

    def one(data: bytes | None) -> bytes | None:
        try:
            return None if data is None else change(bytes(data))
        except UNREADABLE:
            return None

    @F.pandas_udf("binary")
    def run(column: pd.Series) -> pd.Series:
        return column.map(one)

    return run


def pruned_svg(content: Column, quality: int = 80, preserve: bool = False) -> Column:
    return _each(lambda d: prune_svg(d, quality, preserve))(content)


def pruned_gltf(content: Column, aggressive: bool = True) -> Column:
    return _each(lambda d: compact_json(d, aggressive))(content)


def pruned_glb(content: Column, aggressive: bool = True) -> Column:
    return _each(lambda d: prune_glb(d, aggressive))(content)


# ---- lines ----


def _lines(s: Column) -> Column:
    return F.split(F.replace(s, F.lit("\r"), F.lit("")), "\n")


def _trim(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def _rounded(word: Column, tolerance: float) -> Column:
    number = word.try_cast("double")
    return F.when(number.isNull(), word).otherwise(text.shorten_number(number, tolerance))


def slim_ply(s: Column, tolerance: float = 1e-6) -> Column:
    """ASCII PLY without comment lines; numbers of vertices rounded to the tolerance and written short."""
    lines = F.filter(_lines(s), lambda x: ~_trim(x).startswith("#"))
    count = F.coalesce(F.nullif(F.regexp_extract(s, r"(?m)^element vertex (\d+)", 1), F.lit("")).cast("int"), F.lit(0))
    vertex = lambda x: F.array_join(F.transform(F.split(_trim(x), r"\s+"), lambda w: _rounded(w, tolerance)), " ")

    def slim(t: Column) -> Column:
        return F.array_join(F.transform(t["lines"], lambda x, i: F.when((t["first"] > 0) & (i >= t["first"]) & (i < t["first"] + t["count"]), vertex(x)).otherwise(x)), "\n")

    # What a lambda names from outside is evaluated anew for each line, so each of these is bound as a lambda's own first.
    placed = F.transform(F.array(lines), lambda x: F.struct(x.alias("lines"), F.array_position(F.transform(x, _trim), F.lit("end_header")).alias("first"), count.alias("count")))
    return F.element_at(F.transform(placed, slim), 1)


def slim_stl(s: Column, digits: int = 6) -> Column:
    """ASCII STL without blank lines and indents; vertices and normals at so many decimals."""

    def line(x: Column) -> Column:
        words = F.split(_trim(x), r"\s+")
        numbers = F.transform(words, lambda w: F.when(w.try_cast("double").isNull(), w).otherwise(text.fixed_precision(w.try_cast("double"), digits)))
        return F.when(_trim(x).rlike("^(vertex|facet normal) "), F.array_join(numbers, " ")).otherwise(_trim(x))

    return F.array_join(F.transform(F.filter(_lines(s), lambda x: _trim(x) != ""), line), "\n")


def slim_fbx(s: Column) -> Column:
    """ASCII FBX without blank lines and comments, but those that name the format or its maker; blanks squeezed, none around commas of numbers."""
    kept = F.filter(_lines(s), lambda x: (_trim(x) != "") & (~_trim(x).startswith(";") | F.contains(x, F.lit("FBX")) | F.contains(x, F.lit("Creator"))))

    def line(x: Column) -> Column:
        short = F.when(F.contains(x, F.lit(",")) & x.rlike("[.0-9]"), F.regexp_replace(_trim(x), r"\s*,\s*", ",")).otherwise(F.regexp_replace(_trim(x), r"\s+", " "))
        return F.when(_trim(x).startswith(";"), x).otherwise(short)

    return F.array_join(F.transform(kept, line), "\n")


def slim_obj(s: Column) -> Column:
    """OBJ without comments, blank lines, and repeated blanks."""
    kept = F.filter(_lines(s), lambda x: (_trim(x) != "") & ~_trim(x).startswith("#"))
    return F.array_join(F.transform(kept, lambda x: F.regexp_replace(_trim(x), r"\s+", " ")), "\n")


def svg_dims(text: Column, default: int = 100) -> tuple[Column, Column]:
    """Whole width and height of the first svg element, by its attributes, else by its viewBox, else the default; comments don't count."""
    root = F.regexp_extract(F.regexp_replace(text, r"(?s)<!--.*?-->", ""), r"<(?:[A-Za-z]+:)?svg(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>", 0)

    def of(name: str, place: int) -> Column:
        own = F.regexp_extract(root, rf"\s{name}\s*=\s*[\"']\s*([0-9]+)(?:\.[0-9]+)?(?:px)?\s*[\"']", 1).try_cast("long")
        box = F.get(F.split(F.regexp_extract(root, r"\sviewBox\s*=\s*[\"']\s*([-0-9. ,]+)", 1), r"[ ,]+"), F.lit(place)).try_cast("double").cast("long")
        return F.coalesce(own, box, F.lit(default).cast("long"))

    return of("width", 2), of("height", 3)
