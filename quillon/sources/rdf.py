"""RDF files other than N-Triples: Turtle and RDF/XML, whole files in tasks, triples out.

A file is one row, since prefixes, nested nodes and lists reach over all of it;
many files are read side by side.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Namespaces and names of the two syntaxes.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
XML = "{http://www.w3.org/XML/1998/namespace}"
TOKEN = re.compile(
    r'''(?P<space>\s+|\#[^\n]*)|<(?P<iri>[^<>"{}|^`\\\s]*)>|(?P<text>"""(?:[^"\\]|\\.|"(?!""))*"""|\'\'\'(?:[^'\\]|\\.|'(?!''))*\'\'\'|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<number>[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?(?![\w:]))|(?P<word>@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^|_:[\w.-]*\w|[\w-]*(?:\.[\w-]+)*:(?:[\w:%-]|\\.|\.(?=[\w:%\\.-]))*|[A-Za-z]+)|(?P<mark>[\[\]();,.])''',
    re.X | re.S,
)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}

Triple = tuple[str, str, str]


def resolve(base: str, iri: str) -> str:
    """An IRI against a base; an empty fragment stays."""
    if not base or re.match(r"[A-Za-z][\w+.-]*:", iri):
        return iri
    return base.split("#")[0] + iri if iri.startswith("#") else urljoin(base, iri)


def _unescape(text: str) -> str:
    one = lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else ESCAPES.get(m[1], m[1])
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", one, text, flags=re.S)


class Turtle:
    """One Turtle document; ``triples`` are (subject, predicate, object), literals as their text."""

    def __init__(self, text: str, base: str = ""):
        self.tokens, at = [], 0
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise ValueError(f"cannot read Turtle at {text[at : at + 30]!r}")
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at, self.base, self.prefixes, self.blanks = 0, base, {}, 0
        self.triples: list[Triple] = []
        while self.at < len(self.tokens):
            self.statement()

    def next(self, *marks: str) -> tuple[str, str]:
        if self.at == len(self.tokens):
            raise ValueError("Turtle ends within a statement")
        kind, text = self.tokens[self.at]
        if marks and (kind != "mark" or text not in marks):
            raise ValueError(f"Turtle has {text!r} where {' or '.join(marks)} belongs")
        self.at += 1
        return kind, text

    def peek(self, mark: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at] == ("mark", mark)

    def blank(self) -> str:
        self.blanks += 1
        return f"_:b{self.blanks}"

    def statement(self) -> None:
        kind, text = self.tokens[self.at]
        if kind == "word" and text.lstrip("@").lower() in ("prefix", "base"):
            self.at += 1
            name = self.next()[1][:-1] if text.lstrip("@").lower() == "prefix" else None
            iri = resolve(self.base, self.next()[1])
            if name is None:
                self.base = iri
            else:
                self.prefixes[name] = iri
            if text[0] == "@":
                self.next(".")
            return
        nested = self.peek("[")
        subject = self.node()
        if not (nested and self.peek(".")):
            self.properties(subject)
        self.next(".")

    def properties(self, subject: str) -> None:
        while True:
            predicate = self.node()
            while True:
                self.triples.append((subject, predicate, self.node()))
                if not self.peek(","):
                    break
                self.at += 1
            if not self.peek(";"):
                return
            while self.peek(";"):
                self.at += 1
            if self.peek(".") or self.peek("]"):
                return

    def node(self) -> str:
        kind, text = self.next()
        if kind == "iri":
            return resolve(self.base, _unescape(text))
        if kind == "text":
            quote = 3 if text[:3] in ('"""', "\'\'\'") and len(text) >= 6 else 1
            if self.at < len(self.tokens) and self.tokens[self.at][0] == "word" and self.tokens[self.at][1][0] in "@^":
                self.at += 1
                if self.tokens[self.at - 1][1] == "^^":
                    self.node()
            return _unescape(text[quote:-quote])
        if kind == "number":
            return text
        if kind == "mark" and text == "[":
            own = self.blank()
            if not self.peek("]"):
                self.properties(own)
            self.next("]")
            return own
        if kind == "mark" and text == "(":
            items = []
            while not self.peek(")"):
                items.append(self.node())
            self.at += 1
            return self.listed(items)
        if kind == "word" and text == "a":
            return RDF + "type"
        if kind == "word" and text in ("true", "false"):
            return text
        if kind == "word" and text.startswith("_:"):
            return text
        if kind == "word" and ":" in text:
            prefix, local = text.split(":", 1)
            if prefix in self.prefixes:
                return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        raise ValueError(f"Turtle has {text!r} where a node belongs")

    def listed(self, items: list[str]) -> str:
        head = RDF + "nil"
        for item in reversed(items):
            own = self.blank()
            self.triples += [(own, RDF + "first", item), (own, RDF + "rest", head)]
            head = own
        return head


class RdfXml:
    """One RDF/XML document; ``triples`` as those of Turtle."""

    def __init__(self, text: str, base: str = ""):
        self.triples: list[Triple] = []
        self.blanks = 0
        root = ET.fromstring(text)
        base = root.get(XML + "base", base)
        for child in root if root.tag == f"{{{RDF}}}RDF" else [root]:
            self.node(child, base)

    def blank(self) -> str:
        self.blanks += 1
        return f"_:b{self.blanks}"

    @staticmethod
    def name(tag: str) -> str:
        return tag[1:].replace("}", "", 1) if tag[0] == "{" else tag

    def node(self, e: ET.Element, base: str) -> str:
        at, base = (lambda key: e.get(f"{{{RDF}}}{key}")), e.get(XML + "base", base)
        if at("about") is not None:
            own = resolve(base, at("about"))
        elif at("ID") is not None:
            own = f"{base.split('#')[0]}#{at('ID')}"
        else:
            own = f"_:{at('nodeID')}" if at("nodeID") else self.blank()
        if e.tag != f"{{{RDF}}}Description":
            self.triples.append((own, RDF + "type", self.name(e.tag)))
        for key, value in e.attrib.items():
            if not key.startswith((f"{{{RDF}}}", XML)):
                self.triples.append((own, self.name(key), value))
            elif key == f"{{{RDF}}}type":
                self.triples.append((own, RDF + "type", value))
        for p in e:
            self.triples.append((own, self.name(p.tag), self.value(p, p.get(XML + "base", base))))
        return own

    def value(self, p: ET.Element, base: str) -> str:
        at = lambda key: p.get(f"{{{RDF}}}{key}")
        if at("resource") is not None:
            return resolve(base, at("resource"))
        if at("nodeID"):
            return f"_:{at('nodeID')}"
        if at("parseType") == "Collection":
            head = RDF + "nil"
            for item in reversed([self.node(c, base) for c in p]):
                own = self.blank()
                self.triples += [(own, RDF + "first", item), (own, RDF + "rest", head)]
                head = own
            return head
        if at("parseType") == "Resource":
            own = self.blank()
            for c in p:
                self.triples.append((own, self.name(c.tag), self.value(c, base)))
            return own
        if at("parseType") == "Literal":
            return (p.text or "") + "".join(ET.tostring(c, encoding="unicode") for c in p)
        return self.node(p[0], base) if len(p) else p.text or ""


def _read(spark: SparkSession, path: str, parse: Callable[[str], list[Triple]]) -> DataFrame:
    """s, p, o of whole files. Blank nodes carry their file's hash, so those of two files stay apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = lambda x: f"_:{file}-{x[2:]}" if x.startswith("_:") else x  # noqa: B023, E731
                made = [(own(s), p, own(o)) for s, p, o in parse(text)]
                for low in range(0, len(made), 50_000):
                    columns = zip(*made[low : low + 50_000])
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["s", "p", "o"])

    files = spark.read.text(path, wholetext=True).select(F.hex(F.xxhash64(F.col("_metadata.file_path"))).alias("file"), "value")
    return files.mapInArrow(run, "s string, p string, o string").distinct()


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """s, p, o of Turtle files; literals are their text."""
    return _read(spark, path, lambda text: Turtle(text).triples)


def read_rdf_xml(spark: SparkSession, path: str) -> DataFrame:
    """s, p, o of RDF/XML files (.owl, .rdf); literals are their text."""
    return _read(spark, path, lambda text: RdfXml(text).triples)
