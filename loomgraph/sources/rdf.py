"""RDF files to statements and back.

Only statements whose subject and object are IRIs are kept; others can be
counted by kind. N-Triples and N-Quads are read line by line with Spark
expressions and are splittable; RDF/XML, Turtle and TriG files are parsed whole,
one task for a file, so large ones should come as N-Triples. Graph names are
dropped.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.model import RDF_TYPE

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XML = "{http://www.w3.org/XML/1998/namespace}"
FORMATS = ("ntriples", "nquads", "turtle", "trig", "rdfxml")
_STATEMENT = r"^\s*(<[^>]*>|_:\S+)\s*(<[^>]*>)\s*(<[^>]*>|_:[^\s.]+|\"(?:[^\"\\]|\\.)*\"(?:@[A-Za-z0-9\-]+|\^\^<[^>]*>)?)"
_END = r"\s*\.\s*(?:#.*)?$"
_LINE, _QUAD = _STATEMENT + _END, _STATEMENT + r"(?:\s*(?:<[^>]*>|_:[^\s.]+))?" + _END
_UNICODE = r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})"


def read(spark: SparkSession, paths: str | list[str], form: str = "rdfxml", pattern: str | None = None) -> DataFrame:
    """(s, p, o) of files or directories; pattern keeps files by name, as `*.owl`."""
    every = statements(spark, paths, form, pattern)
    return every.where("s_kind = 'iri' AND o_kind = 'iri'").select("s", "p", "o")


def statements(spark: SparkSession, paths: str | list[str], form: str = "rdfxml", pattern: str | None = None, skip_malformed: bool = False) -> DataFrame:
    """(s, p, o, s_kind, o_kind) of all statements; kinds are iri, blank and literal.

    Malformed lines give none; a malformed file that is parsed whole fails the
    job, or gives none with skip_malformed.
    """
    if form not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    options = {"pathGlobFilter": pattern} if pattern else {}
    if form in ("ntriples", "nquads"):
        return parse_lines(spark.read.options(**options).text(paths), form == "nquads")
    parse = {"rdfxml": parse_rdfxml, "turtle": parse_turtle, "trig": parse_trig}[form]

    def of_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    found = list(parse(bytes(content).decode("utf-8-sig"), path))
                except (ValueError, ET.ParseError):
                    if not skip_malformed:
                        raise
                    continue
                yield pd.DataFrame(found, columns=["s", "p", "o", "s_kind", "o_kind"])

    files = spark.read.format("binaryFile").options(**options).load(paths).select("path", "content")
    return files.mapInPandas(of_files, "s string, p string, o string, s_kind string, o_kind string")


def by_kind(every: DataFrame) -> DataFrame:
    """Number of statements by the kinds of subject and object: what is kept and what is dropped."""
    return every.groupBy("s_kind", "o_kind").agg(F.count(F.lit(1)).alias("n"))


def line_kinds(lines: DataFrame, graphs: bool = False) -> DataFrame:
    """(kind, n): how many lines in the column value are a statement, blank (or a comment), or malformed."""
    kind = F.when(F.col("value").rlike(_QUAD if graphs else _LINE), "statement").when(F.col("value").rlike(r"^\s*(?:#.*)?$"), "blank").otherwise("malformed")
    return lines.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def parse_lines(lines: DataFrame, graphs: bool = False) -> DataFrame:
    """Statements of N-Triples lines (graphs: N-Quads) in the column value; comments, blank and malformed lines give none.

    Lines of IRIs with single blanks between them, as lines() writes them, are cut
    at their `>`; all others are matched with the whole form.
    """
    form = _QUAD if graphs else _LINE
    # rand() keeps the planner from moving conditions below this projection, where each use would cut the line again
    lines = lines.select("value", F.when(F.floor(F.rand(0)) == 0, F.split("value", ">", 5 if graphs else 4)).alias("__cut"))
    cut = lambda k: F.get("__cut", F.lit(k))
    end = cut(3) == " ."
    if graphs:
        end = (end & cut(4).isNull()) | (cut(3).startswith(" <") & (cut(4) == " ."))
    simple = F.coalesce(cut(0).startswith("<") & cut(1).startswith(" <") & cut(2).startswith(" <") & end, F.lit(False))
    kind = lambda c: F.when(c.startswith("<"), "iri").when(c.startswith("_:"), "blank").otherwise("literal")
    plain = lambda c: F.when(c.startswith("<"), _unescaped(F.substr(c, F.lit(2), F.length(c) - 2))).otherwise(c)
    matched = lambda k: F.when(simple, F.concat(F.ltrim(cut(k - 1)), F.lit(">"))).otherwise(F.regexp_extract("value", form, k))
    parts = lines.where(simple | F.col("value").rlike(form)).select(*[matched(k).alias(c) for k, c in ((1, "s"), (2, "p"), (3, "o"))])
    return parts.select(*[plain(F.col(c)).alias(c) for c in "spo"], kind(F.col("s")).alias("s_kind"), kind(F.col("o")).alias("o_kind"))


def _unescaped(text: Column) -> Column:
    """Without the numeric escapes that IRIs may have."""

    def one(out: Column, code: Column) -> Column:
        number = F.conv(F.regexp_replace(code, r"\\[uU]", ""), 16, 10).cast("int")
        # a code point's UTF-16 form, decoded
        high, low = F.floor((number - 0x10000) / 0x400) + 0xD800, (number - 0x10000) % 0x400 + 0xDC00
        units = F.when(number < 0x10000, F.lpad(F.hex(number), 4, "0")).otherwise(F.concat(F.hex(high.cast("long")), F.hex(low)))
        return F.replace(out, code, F.decode(F.unhex(units), "UTF-16BE"))

    codes = F.regexp_extract_all(text, F.lit(_UNICODE), F.lit(0))
    return F.when(text.contains("\\"), F.aggregate(codes, text, one)).otherwise(text)


def lines(triples: DataFrame) -> DataFrame:
    """N-Triples lines of statements: column value."""
    marks = r'[<>"{}|^`\\\x00-\x20]'
    safe = lambda c: F.coalesce(F.when(F.col(c).rlike(marks), F.regexp_replace(F.col(c), marks, "_")).otherwise(F.col(c)), F.lit("null"))
    return triples.select(F.concat(F.lit("<"), safe("s"), F.lit("> <"), safe("p"), F.lit("> <"), safe("o"), F.lit("> .")).alias("value"))


def write_ntriples(triples: DataFrame, path: str, mode: str = "error") -> None:
    lines(triples).write.mode(mode).text(path)


def parse_rdfxml(text: str, base: str = "") -> Iterator[tuple[str, str, str, str, str]]:
    """Statements of an RDF/XML document: typed nodes, property elements and attributes, nesting, parse types."""
    blanks = iter(range(1, 1 << 62))
    name = lambda tag: tag[1:].replace("}", "", 1) if tag.startswith("{") else tag

    def identity(e: ET.Element, base: str) -> tuple[str, str]:
        if (about := e.get(f"{{{RDF}}}about")) is not None:
            return urljoin(base, about), "iri"
        if (own := e.get(f"{{{RDF}}}ID")) is not None:
            return f"{base}#{own}", "iri"
        return f"_:{e.get(f'{{{RDF}}}nodeID') or f'b{next(blanks)}'}", "blank"

    def node(e: ET.Element, base: str, found: list) -> tuple[str, str]:
        base = e.get(f"{XML}base", base)
        s, kind = identity(e, base)
        if name(e.tag) != f"{RDF}Description":
            found.append((s, RDF_TYPE, name(e.tag), kind, "iri"))
        for key, value in e.attrib.items():
            if name(key) == RDF_TYPE:
                found.append((s, RDF_TYPE, urljoin(base, value), kind, "iri"))
            elif key.startswith("{") and not key.startswith((f"{{{RDF}}}", XML)):
                found.append((s, name(key), value, kind, "literal"))
        count = 0
        for edge in e:
            p = name(edge.tag)
            if p == f"{RDF}li":
                count += 1
                p = f"{RDF}_{count}"
            inner = edge.get(f"{XML}base", base)
            parse_type = edge.get(f"{{{RDF}}}parseType")
            if (o := edge.get(f"{{{RDF}}}resource")) is not None:
                found.append((s, p, urljoin(inner, o), kind, "iri"))
            elif (o := edge.get(f"{{{RDF}}}nodeID")) is not None:
                found.append((s, p, f"_:{o}", kind, "blank"))
            elif parse_type == "Resource":
                o = f"_:b{next(blanks)}"
                found.append((s, p, o, kind, "blank"))
                holder = ET.Element(f"{{{RDF}}}Description", {f"{{{RDF}}}nodeID": o[2:]})
                holder.extend(list(edge))
                node(holder, inner, found)
            elif parse_type == "Collection":
                rest, rest_kind = (f"_:b{next(blanks)}", "blank") if len(edge) else (f"{RDF}nil", "iri")
                found.append((s, p, rest, kind, rest_kind))
                for k, item in enumerate(edge):
                    o, o_kind = node(item, inner, found)
                    found.append((rest, f"{RDF}first", o, "blank", o_kind))
                    after, after_kind = (f"_:b{next(blanks)}", "blank") if k + 1 < len(edge) else (f"{RDF}nil", "iri")
                    found.append((rest, f"{RDF}rest", after, "blank", after_kind))
                    rest = after
            elif parse_type is None and len(edge):
                for item in edge:
                    o, o_kind = node(item, inner, found)
                    found.append((s, p, o, kind, o_kind))
            else:
                found.append((s, p, "".join(edge.itertext()), kind, "literal"))
        return s, kind

    top, found = ET.fromstring(text), []
    base = top.get(f"{XML}base", base)
    for e in top if name(top.tag) == f"{RDF}RDF" else [top]:
        node(e, base, found)
    yield from found


_TURTLE = re.compile(
    r"""\s+|\#[^\n]*|(?P<iri><[^>\n]*>)
    |(?P<string>\"{3}(?:[^"\\]|\\.|"(?!""))*\"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*'{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<directive>@prefix|@base|PREFIX\b|BASE\b)|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<blank>_:\w[\w\-]*)
    |(?P<number>[+-]?(?:\d+\.\d+|\.\d+|\d+)(?:[eE][+-]?\d+)?)
    |(?P<name>(?:[^\W\d][\w\-.]*)?:(?:(?:[\w\-:%]|\\.)(?:(?:[\w\-:%.]|\\.)*(?:[\w\-:%]|\\.))?)?)
    |(?P<word>[A-Za-z]+)|(?P<mark>\^\^|[.;,\[\](){}])""",
    re.VERBOSE,
)


def parse_trig(text: str, base: str = "") -> Iterator[tuple[str, str, str, str, str]]:
    """Statements of a TriG document: those of all its graphs."""
    return parse_turtle(text, base, graphs=True)


def parse_turtle(text: str, base: str = "", graphs: bool = False) -> Iterator[tuple[str, str, str, str, str]]:
    """Statements of a Turtle document: prefixes, lists of predicates and objects, blank nodes, collections."""
    tokens, at = [], 0
    while at < len(text):
        found = _TURTLE.match(text, at)
        if not found:
            raise ValueError(f"unexpected character {text[at]!r} at {at}")
        if found.lastgroup:
            tokens.append((found.lastgroup, found[0]))
        at = found.end()
    tokens.append(("end", ""))
    prefixes: dict[str, str] = {}
    place, blanks, out = 0, iter(range(1, 1 << 62)), []

    def take(kind: str | None = None, value: str | None = None) -> str | None:
        nonlocal place
        k, v = tokens[place]
        if (kind is None or k == kind) and (value is None or v == value):
            place += 1
            return v
        return None

    def resolved(iri: str) -> str:
        iri = re.sub(_UNICODE, lambda m: chr(int(m[1] or m[2], 16)), iri[1:-1])
        return urljoin(base, iri) if base else iri

    def term() -> tuple[str, str]:
        kind, value = tokens[place]
        if kind == "iri":
            return resolved(take()), "iri"
        if kind == "name":
            take()
            prefix, _, local = value.partition(":")
            if prefix not in prefixes:
                raise ValueError(f"unknown prefix in {value}")
            return prefixes[prefix] + re.sub(r"\\(.)", r"\1", local), "iri"
        if kind == "blank":
            return take(), "blank"
        if kind == "string":
            take()
            if not take("lang") and take("mark", "^^"):
                term()
            return value, "literal"
        if kind == "number" or value in ("true", "false"):
            return take(), "literal"
        if take("mark", "["):
            own = f"_:b{next(blanks)}"
            if not take("mark", "]"):
                pairs(own, "blank")
                if not take("mark", "]"):
                    raise ValueError("expected ]")
            return own, "blank"
        if take("mark", "("):
            items = []
            while not take("mark", ")"):
                items.append(term())
            head, head_kind = f"{RDF}nil", "iri"
            for o, o_kind in reversed(items):
                own = f"_:b{next(blanks)}"
                out.append((own, f"{RDF}first", o, "blank", o_kind))
                out.append((own, f"{RDF}rest", head, "blank", head_kind))
                head, head_kind = own, "blank"
            return head, head_kind
        raise ValueError(f"unexpected {value!r}")

    def pairs(s: str, kind: str) -> None:
        while True:
            p = RDF_TYPE if take("word", "a") else term()[0]
            while True:
                o, o_kind = term()
                out.append((s, p, o, kind, o_kind))
                if not take("mark", ","):
                    break
            if not take("mark", ";"):
                return
            while take("mark", ";"):
                pass
            if tokens[place][1] in (".", "]", "}"):
                return

    while tokens[place][0] != "end":
        if tokens[place][0] == "directive":
            word = take()
            if word.lower().endswith("prefix"):
                prefix = take("name")
                prefixes[prefix[:-1]] = resolved(take("iri"))
            else:
                base = resolved(take("iri"))
            take("mark", ".")
            continue
        if graphs and (take("mark", "{") or take("mark", "}")):
            continue
        if graphs and tokens[place][1].upper() == "GRAPH" and take("word"):
            term()
            continue
        anonymous = tokens[place] == ("mark", "[")
        s, kind = term()
        if graphs and take("mark", "{"):
            continue
        if not (anonymous and tokens[place] == ("mark", ".")):
            pairs(s, kind)
        if not take("mark", ".") and not (graphs and tokens[place] == ("mark", "}")):
            raise ValueError(f"expected a full stop, found {tokens[place][1]!r}")
    yield from out
