"""Format detection on the bytes of a file, as Column expressions on its first and last bytes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Leading bytes of the formats (fixed values).
PNG_MAGIC = "89504E470D0A1A0A"
TGA_FOOTER = "TRUEVISION-XFILE"
FBX_SIGNATURE = "4B617964617261204642582042696E6172792020001A00"


def head(content: Column, n: int) -> Column:
    """Hex of the first n bytes: comparisons then read no more of the file."""
    return F.hex(F.substring(content, 1, n))


def byte(content: Column, at: int | Column) -> Column:
    """The byte at a position from 0, as a long; null beyond the end."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.nullif(F.hex(F.substring(content, at + 1, F.lit(1))), F.lit("")), 16, 10).cast("long")


def little(content: Column, at: int, n: int) -> Column:
    """Little-endian number of n bytes."""
    return reduce(lambda a, b: a + b, (byte(content, at + k) * (1 << (8 * k)) for k in range(n)))


def big(content: Column, at: int, n: int) -> Column:
    return F.conv(F.nullif(F.hex(F.substring(content, at + 1, n)), F.lit("")), 16, 10).cast("long")


def as_text(content: Column, n: int | None = None) -> Column:
    """The bytes (the first n) as text, one character a byte: markers in ASCII can be looked for in any file."""
    return F.decode(content if n is None else F.substring(content, 1, n), "ISO-8859-1")


def is_png(c: Column) -> Column:
    return head(c, 8) == PNG_MAGIC


def is_jpeg(c: Column) -> Column:
    return head(c, 3) == "FFD8FF"


def is_webp(c: Column) -> Column:
    return (head(c, 4) == "52494646") & (F.substring(head(c, 12), 17, 8) == "57454250")


def is_gif(c: Column) -> Column:
    return head(c, 6).isin("474946383761", "474946383961")


def is_bmp(c: Column) -> Column:
    return head(c, 2) == "424D"


def is_tiff(c: Column) -> Column:
    return head(c, 4).isin("49492A00", "4D4D002A")


def is_ico(c: Column) -> Column:
    return head(c, 4) == "00000100"


def is_svg(c: Column) -> Column:
    """Text that opens with <svg, or with a declaration or doctype before an <svg."""
    start, whole = F.ltrim(as_text(c, 256)), as_text(c)
    opens = start.startswith("<svg") | ((start.startswith("<?xml") | start.startswith("<!DOCTYPE")) & F.contains(whole, F.lit("<svg")))
    return opens & F.is_valid_utf8(c.cast("string"))


def is_tga(c: Column) -> Column:
    """A footer, or a header with a known image type, colour-map flag and depth, a size, and no ftyp box."""
    footer = (F.length(c) >= 26) & (F.hex(F.substring(c, F.length(c) - 17, F.lit(16))) == F.hex(F.lit(TGA_FOOTER)))
    header = (
        (F.length(c) >= 18) & (byte(c, 1) <= 1) & byte(c, 2).isin(0, 1, 2, 3, 9, 10, 11) & (little(c, 12, 2) > 0) & (little(c, 14, 2) > 0) & byte(c, 16).isin(8, 15, 16, 24, 32)
    )
    return F.coalesce(footer | (header & (F.hex(F.substring(c, 5, 4)) != F.hex(F.lit("ftyp")))), F.lit(False))


def is_glb(c: Column) -> Column:
    return head(c, 4) == "676C5446"


def is_gltf(c: Column) -> Column:
    start = as_text(c, 1024)
    return F.contains(start, F.lit("{")) & F.contains(start, F.lit('"asset"')) & F.contains(start, F.lit('"version"'))


def is_stl(c: Column) -> Column:
    return F.coalesce((head(c, 6) == F.hex(F.lit("solid "))) | ((F.length(c) >= 84) & (F.length(c) == 84 + 50 * little(c, 80, 4))), F.lit(False))


def is_ply(c: Column) -> Column:
    return (head(c, 4) == "706C790A") | (head(c, 5) == "706C790D0A")


def is_fbx(c: Column) -> Column:
    start = as_text(c, 32)
    return start.startswith("Kaydara FBX Binary") | start.startswith("Autodesk FBX") | start.startswith("; FBX ")


def is_obj(c: Column) -> Column:
    """A line among the first 512 bytes that states a vertex, normal, texture coordinate or face."""
    return as_text(c, 512).rlike(r"(?m)^(v|vn|vt|f) [-0-9+.]")


IMAGES = (("Png", is_png), ("Jpeg", is_jpeg), ("WebP", is_webp), ("Gif", is_gif), ("Bmp", is_bmp), ("Tiff", is_tiff), ("Svg", is_svg), ("Ico", is_ico), ("Tga", is_tga))
MESHES = (("Glb", is_glb), ("Gltf", is_gltf), ("Stl", is_stl), ("Ply", is_ply), ("Fbx", is_fbx), ("Obj", is_obj))


def _first(c: Column, tests: tuple) -> Column:
    return reduce(lambda rest, test: F.when(test[1](c), test[0]).otherwise(rest), reversed(tests), F.lit(None).cast("string"))


def detect_image(content: Column) -> Column:
    """Name of the image format; null if none, or for fewer than eight bytes."""
    return F.when(F.length(content) >= 8, _first(content, IMAGES))


def detect_mesh(content: Column) -> Column:
    return F.when(F.length(content) >= 8, _first(content, MESHES))


def detect_format(content: Column) -> Column:
    """image:Name, mesh:Name or unknown; images are tried first."""
    image, mesh = detect_image(content), detect_mesh(content)
    return F.coalesce(F.concat(F.lit("image:"), image), F.concat(F.lit("mesh:"), mesh), F.lit("unknown"))


# ---- stricter rules: what a loader takes, and what a validator asks for ----


def valid_text(c: Column) -> Column:
    """The bytes as text; null if they are no valid UTF-8."""
    return F.when(F.is_valid_utf8(c.cast("string")), c.cast("string"))


def _lines(c: Column, first: int) -> Column:
    return F.slice(F.split(valid_text(c), "\n"), 1, first)


def is_tga_plain(c: Column) -> Column:
    """As is_tga, but of any depth, and whatever stands in bytes 4 to 7."""
    footer = (F.length(c) >= 26) & (F.hex(F.substring(c, F.length(c) - 25, F.lit(16))) == F.hex(F.lit(TGA_FOOTER)))
    header = (F.length(c) >= 18) & (byte(c, 1) <= 1) & byte(c, 2).isin(0, 1, 2, 3, 9, 10, 11) & (little(c, 12, 2) > 0) & (little(c, 14, 2) > 0)
    return F.coalesce(footer | header, F.lit(False))


def is_svg_plain(c: Column) -> Column:
    """Text that opens with <svg, or with an XML declaration before an <svg."""
    start = F.ltrim(valid_text(c))
    return F.coalesce(start.startswith("<svg") | (start.startswith("<?xml") & F.contains(start, F.lit("<svg"))), F.lit(False))


def is_tiff_plain(c: Column) -> Column:
    return head(c, 4).isin("49492A00", "4D4D002A")


IMAGES_PLAIN = (("Png", is_png), ("Jpeg", is_jpeg), ("WebP", is_webp), ("Gif", is_gif), ("Bmp", is_bmp), ("Tiff", is_tiff_plain), ("Svg", is_svg_plain), ("Ico", is_ico), ("Tga", is_tga_plain))


def loads_obj(c: Column) -> Column:
    """One of the first ten lines is a comment, vertex, normal, coordinate, face, object or group."""
    return F.coalesce(F.exists(_lines(c, 10), lambda x: x.rlike(r"^\s*(#|v|vn|vt|f|o|g) ")), F.lit(False))


def loads_gltf(c: Column) -> Column:
    t = valid_text(c)
    return F.coalesce(F.ltrim(t).startswith("{") & F.contains(t, F.lit('"asset"')) & F.contains(t, F.lit('"version"')) & (F.contains(t, F.lit('"meshes"')) | F.contains(t, F.lit('"scenes"'))), F.lit(False))


def loads_stl(c: Column) -> Column:
    """Text that opens with solid in any case, or as many bytes as the count claims and no more than a hundred over."""
    size = 84 + 50 * little(c, 80, 4)
    return F.coalesce(F.lower(F.trim(F.split(valid_text(c), "\n")[0])).startswith("solid"), F.lit(False)) | F.coalesce((F.length(c) >= 84) & (F.length(c) >= size) & (F.length(c) <= size + 100), F.lit(False))


def loads_ply(c: Column) -> Column:
    return F.coalesce(as_text(c, 100).rlike(r"(?i)^\s*ply\s*(\n|$)"), F.lit(False))


def loads_fbx(c: Column) -> Column:
    start = as_text(c, 100)
    return (F.length(c) >= 23) & ((head(c, 23) == FBX_SIGNATURE) | F.contains(start, F.lit("; FBX ")) | F.contains(start, F.lit("FBX version")))


def loads_glb(c: Column) -> Column:
    return is_glb(c) & (F.length(c) >= 12)


MESHES_LOADED = (("Obj", loads_obj), ("Gltf", loads_gltf), ("Glb", loads_glb), ("Stl", loads_stl), ("Ply", loads_ply), ("Fbx", loads_fbx))


def detect_image_plain(content: Column) -> Column:
    """As detect_image, by simpler rules for SVG and TGA."""
    return F.when(F.length(content) >= 8, _first(content, IMAGES_PLAIN))


def detect_mesh_loaded(content: Column) -> Column:
    """The format that a loader takes, text formats first; null if none, or for fewer than four bytes."""
    return F.when(F.length(content) >= 4, _first(content, MESHES_LOADED))


def valid_obj(c: Column) -> Column:
    """Text with a vertex among its first thousand lines."""
    return F.coalesce(F.exists(_lines(c, 1000), lambda x: x.rlike(r"^\s*v ")), F.lit(False))


def valid_gltf(c: Column) -> Column:
    t = F.trim(valid_text(c))
    return F.coalesce(t.startswith("{") & t.endswith("}") & F.contains(t, F.lit('"asset"')), F.lit(False))


def valid_stl(c: Column) -> Column:
    """At least 84 bytes; text must say endsolid somewhere, binary must hold what its count claims."""
    whole = F.lower(valid_text(c))
    binary = F.coalesce(F.length(c) >= 84 + 50 * little(c, 80, 4), F.lit(False))
    return (F.length(c) >= 84) & F.when(F.coalesce(F.ltrim(whole).startswith("solid"), F.lit(False)), F.contains(whole, F.lit("endsolid"))).otherwise(binary)


def valid_ply(c: Column) -> Column:
    """A header that opens with ply and names its format in the ten lines after; the body is not looked at."""
    lines = F.split(as_text(c, 4096), "\n")
    return F.coalesce(F.lower(F.trim(F.regexp_replace(lines[0], "\r", ""))) == "ply", F.lit(False)) & F.exists(F.slice(lines, 2, 10), lambda x: F.ltrim(x).startswith("format "))


def sound_ply(c: Column) -> Column:
    """Opens with ply and ends its header; text must name its format."""
    t, whole = valid_text(c), as_text(c)
    text = t.startswith("ply") & F.contains(t, F.lit("format")) & F.contains(t, F.lit("end_header"))
    return F.when(F.contains(as_text(c, 500), F.lit("format binary")), whole.startswith("ply") & F.contains(whole, F.lit("end_header"))).otherwise(F.coalesce(text, F.lit(False)))


def sound_stl(c: Column) -> Column:
    """Text with facets and vertices, or exactly as many bytes as the count claims."""
    t = valid_text(c)
    text = F.coalesce(F.contains(t, F.lit("facet normal")) & F.contains(t, F.lit("vertex")), F.lit(False))
    binary = F.coalesce((F.length(c) >= 84) & (F.length(c) == 84 + 50 * little(c, 80, 4)), F.lit(False))
    return (F.length(c) >= 15) & F.when(head(c, 6) == "736F6C696420", text).otherwise(binary)


def sound_fbx(c: Column) -> Column:
    """The binary signature, or text that names objects or models."""
    t = valid_text(c)
    text = t.startswith("; FBX ") & (F.contains(t, F.lit("Objects:")) | F.contains(t, F.lit("Model:")))
    return (F.length(c) >= 23) & ((head(c, 23) == FBX_SIGNATURE) | F.coalesce(text, F.lit(False)))
