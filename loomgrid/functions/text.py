"""Scalar expressions on strings, code points, bits and binary headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of characters in slugs.
NAMED = {
    "č": "c_hacek", "ç": "c_cedilla", "ḑ": "d_cedilla", "ļ": "l_cedilla", "ň": "n_hacek", "ř": "r_hacek", "š": "s_hacek",
    "ţ": "t_cedilla", "ż": "z_dot", "ž": "z_hacek", "'": "apostrophe", '"': "dquote", "¿": "iquest",
}

#: Accents of stressed vowels.
STRESSED = {"a": "á", "e": "é", "i": "í", "o": "ó", "u": "ú", "ä": "â", "ë": "ê", "ö": "ô", "ü": "û"}

#: Classes of a block of 128 code points by their last offset.
OFFSET_CLASSES = (
    (0x03, "punctuation"), (0x0D, "number"), (0x11, "tenthPower"), (0x29, "primary"), (0x2F, "secondary"), (0x36, "tertiary"),
    (0x4D, "consonantal"), (0x4F, "placeholder"), (0x70, "diacritic"), (0x7E, "unassigned"), (0x7F, "grid"),
)


def slug(text: Column) -> Column:
    """Letters, digits and underscores stay; named characters get their name, others u and their hex code point."""
    names = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])
    one = lambda c: F.when(c.rlike("^[A-Za-z0-9_]$"), c).otherwise(F.coalesce(F.try_element_at(names, c), F.concat(F.lit("u"), F.lower(F.hex(F.ascii(c))))))
    return F.array_join(F.transform(F.split(text, ""), one), "")


def offset_class(offset: Column) -> Column:
    """Class of an offset into the block; outside it `external`."""
    out = F.when((offset < 0) | (offset > 0x7F), "external")
    for last, name in OFFSET_CLASSES:
        out = out.when(offset <= last, name)
    return out


def stable_id(offset: Column) -> Column:
    """Class name in capitals and the two-digit offset."""
    return F.concat_ws("_", F.upper(offset_class(offset)), F.lpad(offset.cast("string"), 2, "0"))


def code_point_label(offset: Column) -> Column:
    return F.concat(F.lit("U+"), F.lpad(F.hex(offset), 5, "0"))


def bits(number: Column, count: int) -> Column:
    """Bits of a number, the most significant first."""
    return F.transform(F.sequence(F.lit(count - 1), F.lit(0)), lambda k: F.expr("0") + F.pmod(F.floor(number / F.pow(F.lit(2), k)), F.lit(2)).cast("int"))


def from_bits(array: Column) -> Column:
    """The number that bits stand for; 0 reads as null."""
    return F.nullif(F.aggregate(array, F.lit(0), lambda acc, b: acc * 2 + b), F.lit(0))


def bounded_number(text: Column, low: float, high: float) -> Column:
    """The number in a string if it is one and within bounds, else null."""
    n = text.try_cast("double")
    return F.when(n.between(low, high), n)


def data_url(text: Column) -> Column:
    """The bytes of a base64 data URL, with or without its head."""
    return F.unbase64(F.regexp_replace(text, "^data:[^,]*base64,", ""))


def image_format(data: Column) -> Column:
    """Kind of an image by its first bytes."""
    head = F.hex(F.substring(data, 1, 4))
    return F.when(head.startswith("FFD8FF"), "jpeg").when(head == "89504E47", "png").otherwise("unknown")


def add_attribute(markup: Column, tag: str, attribute: str, name: str) -> tuple[Column, Column]:
    """Markup with the attribute on every such tag that lacks it, and patched, already_fixed or no_tag."""
    pattern = f"(<{tag}\\b)(?![^>]*{name}=)"
    fixed = F.when(F.contains(markup, F.lit(attribute)), "already_fixed").when(~markup.rlike(pattern), "no_tag").otherwise("patched")
    return F.when(fixed == "patched", F.regexp_replace(markup, pattern, f"$1 {attribute}")).otherwise(markup), fixed


def drop_lines(text: Column, pattern: str) -> Column:
    """Text without the lines that match; a comma that then ends the line before a closing bracket goes too."""
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda line: ~line.rlike(pattern)), "\n")
    return F.regexp_replace(kept, r",([ \t\r]*\n[ \t]*[}\]])", "$1")


def matching_lines(text: Column, pattern: str) -> Column:
    """The number of lines that match."""
    return F.size(F.filter(F.split(text, "\n"), lambda line: line.rlike(pattern)))


def read_bits(cells: Column, paper: Column, share: float) -> Column:
    """Bits of grey cells: 1 where a cell is darker than that share of the lightest cell of the paper beside them."""
    return F.transform(cells, lambda v: (v < share * F.array_max(paper)).cast("int"))


def stress_accent(text: Column) -> Column:
    """Vowels with the accent of a stressed syllable."""
    return F.translate(text, "".join(STRESSED), "".join(STRESSED.values()))
