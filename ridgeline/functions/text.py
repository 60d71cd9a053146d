"""Text as Column expressions: tagged heights, licences, hosts, request keys, text widths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ridgeline.functions.geodesy import num

METRES_PER_FOOT = 0.3048
# Widths of characters in em, by class.
THIN, WIDE, CAPITAL, DIGIT = "iljtfI.,:;'`!|()[]{}- ", "mwMW@%", "ABCDEFGHJKLNOPQRSTUVXYZ", "0123456789"
THIN_EM, WIDE_EM, CAPITAL_EM, DIGIT_EM, OTHER_EM = 0.28, 0.87, 0.68, 0.556, 0.55


def trimmed(x: Column) -> Column:
    """Without white space at both ends (not spaces only)."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def feet_to_metres(feet: Column) -> Column:
    """To the millimetre, halves up."""
    return F.floor(feet * num(METRES_PER_FOOT) * num(1000) + num(0.5)) / num(1000)


#: What units of a height tag mean; no unit is the tag's own.
METRE, FOOT = ("m", "meter", "meters", "metre", "metres"), ("ft", "foot", "feet")


def _measure(x: Column) -> tuple[Column, Column]:
    """Number and unit of a measure: the letters at its end are the unit, what stands before them must be one plain number.

    A comma or space between a digit and a group of three digits parts thousands.
    """
    clean = trimmed(x)
    unit = F.regexp_extract(clean, "[A-Za-z]*$", 0)
    body = F.regexp_replace(F.substr(clean, F.lit(1), F.length(clean) - F.length(unit)), r"\s+$", "")
    body = F.regexp_replace(body, r"(?<=\d)[,\s](?=\d{3}(?!\d))", "")
    return F.when(body.rlike(r"^[+-]?\d+(\.\d+)?$"), body.try_cast("double")), F.lower(unit)


def ele_metres(x: Column) -> Column:
    """Height in metres of a tag such as '4,808 m' or '14505 ft'; null for anything else."""
    number, unit = _measure(x)
    return F.when(unit.isin(*FOOT), feet_to_metres(number)).when(unit.isin("", *METRE), number)


def tagged_height(ele: Column, ele_ft: Column) -> Column:
    """Metres of the height tag, or else of the one in feet."""
    number, unit = _measure(ele_ft)
    return F.coalesce(ele_metres(ele), feet_to_metres(F.when(unit.isin("", *FOOT), number)))


def text_width_em(x: Column) -> Column:
    """Estimated width of a text: the sum of its characters' widths."""

    def count(chars: str) -> Column:
        return F.length(x) - F.length(F.translate(x, chars, ""))

    thin, wide, capital, digit = count(THIN), count(WIDE), count(CAPITAL), count(DIGIT)
    return thin * num(THIN_EM) + wide * num(WIDE_EM) + capital * num(CAPITAL_EM) + digit * num(DIGIT_EM) + (F.length(x) - thin - wide - capital - digit) * num(OTHER_EM)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))


def fnv1a_32(x: Column) -> Column:
    """FNV-1a hash of a text of code points below 65536, as eight hexadecimal digits."""
    codes = F.transform(F.split(x, ""), lambda c: F.ascii(c).cast("long"))
    folded = F.aggregate(codes, F.lit(0x811C9DC5).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(0x01000193)).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.lpad(F.lower(F.hex(folded)), 8, "0")


def canonical_query(url: Column) -> Column:
    """The URL with its parameters sorted by name, then value, and without fragment."""
    bare = F.regexp_extract(url, r"^[^#]*", 0)
    query = F.when(bare.contains("?"), F.concat(F.lit("?"), F.concat_ws("&", F.array_sort(F.split(F.substring_index(bare, "?", -1), "&"))))).otherwise("")
    return F.concat(F.substring_index(bare, "?", 1), query)
