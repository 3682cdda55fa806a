"""Scalar functions of the physical encoding, as Spark expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the format: largest numbers of one, two and three bytes; the first byte has 6 bits of the number.
LIMITS = (0x3F, 0x3FFF, 0x3FFFFF)
LARGEST = 0x3FFFFFFF


def varint_extra(v: Column) -> Column:
    """Bytes after the first one: 0 to 3."""
    return reduce(lambda rest, k: F.when(v <= LIMITS[k], k).otherwise(rest), (2, 1, 0), F.lit(3))


def varint_hex(v: Column) -> Column:
    """The encoding in hexadecimal: two bits of length and the lowest six, then eight at a time; null beyond 30 bits."""
    extra = varint_extra(v)
    byte = lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")
    first = byte(v.bitwiseAND(F.lit(0x3F)) + extra * 64)
    more = [F.when(extra > k, byte(F.shiftright(v, 6 + 8 * k).bitwiseAND(F.lit(0xFF)))).otherwise("") for k in range(3)]
    return F.when((v >= 0) & (v <= LARGEST), F.concat(first, *more))


def varint_value(encoded: Column) -> Column:
    """The number of an encoding in hexadecimal that begins the string; null if it is cut short."""
    byte = lambda k: F.conv(F.substring(encoded, 2 * k + 1, 2), 16, 10).cast("long")
    extra = F.shiftright(byte(0), 6)
    value = byte(0).bitwiseAND(F.lit(0x3F))
    for k in range(3):
        value = value + F.when(extra > k, F.shiftleft(byte(k + 1), 6 + 8 * k)).otherwise(F.lit(0).cast("long"))
    return F.when(F.length(encoded) >= 2 * (extra + 1), value)


def varint_rest(encoded: Column) -> Column:
    """What follows the first number of an encoding."""
    extra = F.shiftright(F.conv(F.substring(encoded, 1, 2), 16, 10).cast("long"), 6)
    return F.substr(encoded, (2 * extra + 3).cast("int"))


def common_prefix_len(a: Column, b: Column) -> Column:
    """Length of the longest common beginning of two strings."""
    n = F.least(F.length(a), F.length(b))
    each = F.filter(F.sequence(F.lit(1), n), lambda k: F.substring(a, k, F.lit(1)) != F.substring(b, k, F.lit(1)))
    return F.when(n == 0, 0).when(F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n), n).otherwise(F.element_at(each, 1) - 1)


def expand_iri(term: Column, prefixes: dict[str, str]) -> Column:
    """Variables stay, `a` is rdf:type, known prefixes are replaced, all else stays."""
    from loomgraph.model import RDF_TYPE

    out = term
    for prefix, value in prefixes.items():
        out = F.when(term.startswith(f"{prefix}:"), F.concat(F.lit(value), F.substr(term, F.lit(len(prefix) + 2)))).otherwise(out)
    return F.when(term.startswith("?"), term).when(term == "a", RDF_TYPE).otherwise(out)


def xml_text(text: Column) -> Column:
    """Text with the five characters of XML escaped."""
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text
