"""Text, markup, JSON and number formatting, and hashes, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(s: Column) -> Column:
    """Lines without carriage returns, indents, ends and repeated blanks, and without blanks around commas; no blanks at the end."""
    s = F.replace(s, F.lit("\r"), F.lit(""))
    s = F.regexp_replace(s, r"[ \t]+", " ")
    s = F.regexp_replace(s, r" *, *", ",")
    s = F.regexp_replace(s, r"(?m)^ +| +$", "")
    return F.rtrim(s, F.lit(" \t\n\x0b\x0c\r"))


def squeeze(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"[ \t\n\x0B\f\r]+", " "))


def strip_comments(s: Column) -> Column:
    """Without lines that are blank or begin with #."""
    return F.array_join(F.filter(F.split(s, "\n"), lambda x: (F.trim(x) != "") & ~F.ltrim(x).startswith("#")), "\n")


def shorten_number(x: Column, tolerance: float | None = None) -> Column:
    """At most six decimals, without zeros at the end, rounded to the tolerance first."""
    x = x if tolerance is None else F.round(x / tolerance) * tolerance + F.lit(0.0)
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", x), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def fixed_precision(x: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", x)


def shorten_hex(s: Column) -> Column:
    """#rrggbb with equal pairs becomes #rgb, in lower case."""
    return F.regexp_replace(F.lower(s), r"#([0-9a-f])\1([0-9a-f])\2([0-9a-f])\3(?![0-9a-f])", "#$1$2$3")


def strip_markup_comments(s: Column) -> Column:
    return F.regexp_replace(s, r"(?s)<!--.*?-->", "")


def minify_markup(s: Column) -> Column:
    """Without comments; blanks outside quotes collapse, and go between tags and around = < >."""
    s = F.regexp_replace(strip_markup_comments(s), r"""("[^"]*"|'[^']*')|[ \t\r\n]+""", r"$1 ")
    s = F.regexp_replace(s, r"""("[^"]*"|'[^']*')|[ ]+""", r"$1 ")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r" ?([<>=]) ?", "$1"), r" +", " "))


def prune_flat_json(s: Column, drop: tuple[str, ...] = ()) -> Column:
    """A flat object without empty values and without the dropped keys."""
    kept = F.map_filter(F.from_json(s, "map<string,string>"), lambda k, v: v.isNotNull() & (v != "") & (v != "[]") & (v != "{}") & ~k.isin(*drop) if drop else v.isNotNull() & (v != "") & (v != "[]") & (v != "{}"))
    return F.to_json(kept)


def human_bytes(n: Column) -> Column:
    def of(unit: int, name: str) -> Column:
        return F.concat(F.format_string("%.1f", F.round(n / float(unit), 1)), F.lit(f" {name}"))

    return F.when(n < 1 << 10, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, of(1 << 10, "KB")).when(n < 1 << 30, of(1 << 20, "MB")).otherwise(of(1 << 30, "GB"))
