"""Turtle files (RDF) to triples. Files are the unit of work, as prefixes hold for a whole file; each is read once, token by token."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUBCLASS = "http://www.w3.org/2000/01/rdf-schema#subClassOf"
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
# How names of classes and sets begin.
NAMES = ("Ifc", "Pset_", "Qto_")

_LONG = r'"""(?:[^"\\]|\\.|"(?!""))*"""|' + r"'''(?:[^'\\]|\\.|'(?!''))*'''"
_SHORT = r'"(?:[^"\\\n]|\\.)*"|' + r"'(?:[^'\\\n]|\\.)*'"
_TOKEN = re.compile(rf"#[^\n]*|<[^<>\s]*>|(?:{_LONG}|{_SHORT})(?:@[A-Za-z-]+|\^\^(?:<[^<>\s]*>|[^\s;,\[\]()]*[^\s;,\[\]().]))?|[\[\]();,]|\.(?=\s|#|$)|(?:\\.|[^\s;,\[\]()\"'<>#.\\]|\.(?!\s|#|$)|(?<=\S)#)+", re.DOTALL)
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.DOTALL)
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def _unescaped(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else _PLAIN.get(m[1], m[1]), text)


def triples_of(text: str):
    """(subject, predicate, object, is_text) of a file. Lists of predicates (;) and objects (,), prefixes, bases, blank nodes and texts of all kinds are known; collections are left out."""
    prefixes, base, blanks = {}, "", 0
    subject = predicate = None
    outer: list = []  # subjects and predicates around open brackets
    skipped = 0  # open parentheses
    words = (m[0] for m in _TOKEN.finditer(text) if not m[0].startswith("#"))

    def name(word: str) -> str:
        if word.startswith("<"):
            iri = _unescaped(word[1:-1])
            return iri if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", iri) else base + iri
        head, colon, tail = word.partition(":")
        return prefixes[head] + re.sub(r"\\(.)", r"\1", tail) if colon and head in prefixes else word

    for word in words:
        if word.lower() in ("@prefix", "prefix"):
            short = next(words, ":").partition(":")[0]
            prefixes[short] = name(next(words, "<>"))
            subject = predicate = None
        elif word.lower() in ("@base", "base"):
            base = name(next(words, "<>"))
        elif word == "(":
            skipped += 1
        elif word == ")":
            skipped = max(0, skipped - 1)
        elif skipped:
            continue
        elif word == ".":
            subject, predicate, outer = None, None, []
        elif word == ";":
            predicate = None
        elif word == ",":
            continue
        elif word == "]":
            if outer:
                subject, predicate = outer.pop()
        elif word == "[":
            blanks += 1
            node = f"_:b{blanks}"
            if subject is not None and predicate is not None:
                yield subject, predicate, node, False
                outer.append((subject, predicate))
            else:
                outer.append((node, None))
            subject, predicate = node, None
        elif subject is None:
            subject = name(word)
        elif predicate is None:
            predicate = TYPE if word == "a" else name(word)
        elif word[0] in "\"'":
            mark = word[:3] if word[:3] in ('"""', "'''") else word[0]
            yield subject, predicate, _unescaped(word[len(mark) : word.rindex(mark)]), True
        else:
            yield subject, predicate, name(word), False


def triples(spark: SparkSession, *paths: str) -> DataFrame:
    """(subject, predicate, object, is_text) of Turtle files."""

    def run(batches):
        for batch in batches:
            for text in batch.column("value").to_pylist():
                rows = list(triples_of(text))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.bool_() if k == 3 else pa.string()) for k in range(4)], names=["subject", "predicate", "object", "is_text"])

    files = spark.read.text(list(paths), wholetext=True)
    return files.mapInArrow(run, "subject string, predicate string, object string, is_text boolean")


def hierarchy(spark: SparkSession, *paths: str) -> DataFrame:
    """(child, parent) of classes and sets that files say are subclasses of one another, by the last parts of their names; others go."""
    local = lambda c: F.regexp_extract(c, r"([^#/]*)$", 1)
    rows = triples(spark, *paths).where((F.col("predicate") == SUBCLASS) & ~F.col("is_text")).select(local("subject").alias("child"), local("object").alias("parent"))
    known = lambda c: F.substring(c, 1, 3).isin("Ifc") | F.col(c).startswith(NAMES[1]) | F.col(c).startswith(NAMES[2])
    return rows.where(known("child") & known("parent") & (F.col("child") != F.col("parent"))).distinct()
