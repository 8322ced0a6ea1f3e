"""Licence scans: an Aho-Corasick automaton over normalised words finds identifier tags, notice phrases and identifiers that
stand alone; expressions behind a tag are parsed by a shunting yard and evaluated, so that a choice (OR) and a sum of duties
(AND) stay apart."""

from __future__ import annotations

import re
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, word_bytes

# Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
# Notice phrases that the method adds, their labels.
NOTICES = {
    "academic free license": "afl",
    "affero general public license": "agpl",
    "artistic license": "artistic",
    "boost software license": "bsl-1.0",
    "bsd license": "bsd",
    "cc0 1 0 universal": "public-domain",
    "cecill free software license": "cecill",
    "common development and distribution license": "cddl",
    "common public license": "cpl",
    "creative commons attribution": "cc-by",
    "creative commons zero": "public-domain",
    "do what the fuck you want to public license": "wtfpl",
    "eclipse public license": "epl",
    "educational community license": "ecl",
    "european union public licence": "eupl",
    "free documentation license": "gfdl",
    "free for any purpose with or without fee": "isc",
    "isc license": "isc",
    "lesser general public license": "lgpl",
    "library general public license": "lgpl",
    "microsoft public license": "ms-pl",
    "microsoft reciprocal license": "ms-rl",
    "mozilla public license": "mpl",
    "open database license": "odbl",
    "open font license": "ofl",
    "open software license": "osl",
    "permission is hereby granted free of charge": "mit",
    "permission to use copy modify and or distribute this software": "isc",
    "postgresql license": "postgresql",
    "python software foundation license": "psf",
    "redistribution and use in source and binary forms": "bsd",
    "released into the public domain": "public-domain",
    "server side public license": "sspl",
    "the unlicense": "public-domain",
    "this is free and unencumbered software": "public-domain",
    "universal permissive license": "upl",
    "zlib license": "zlib",
}
# Label -> how much it binds (0 free to 3 network copyleft) and the identifiers of its family.
IDENTIFIERS: dict[str, tuple[int, str]] = {
    "0bsd": (0, "0BSD"),
    "afl": (0, "AFL-1.1 AFL-1.2 AFL-2.0 AFL-2.1 AFL-3.0"),
    "agpl": (3, "AGPL-1.0-only AGPL-1.0-or-later AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later"),
    "apache": (0, "Apache-1.0 Apache-1.1 Apache-2.0"),
    "apsl": (1, "APSL-1.0 APSL-1.1 APSL-1.2 APSL-2.0"),
    "artistic": (0, "Artistic-1.0 Artistic-1.0-Perl Artistic-1.0-cl8 Artistic-2.0"),
    "blueoak": (0, "BlueOak-1.0.0"),
    "bsd": (0, "BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-2-Clause-Views BSD-3-Clause BSD-3-Clause-Attribution BSD-3-Clause-Clear BSD-3-Clause-LBNL BSD-4-Clause BSD-4-Clause-UC BSD-Protection BSD-Source-Code"),
    "bsl-1.0": (0, "BSL-1.0"),
    "busl": (2, "BUSL-1.1"),
    "cc-by": (0, "CC-BY-1.0 CC-BY-2.0 CC-BY-2.5 CC-BY-3.0 CC-BY-4.0"),
    "cc-by-nc": (2, "CC-BY-NC-1.0 CC-BY-NC-2.0 CC-BY-NC-2.5 CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0"),
    "cc-by-nd": (2, "CC-BY-ND-1.0 CC-BY-ND-2.0 CC-BY-ND-2.5 CC-BY-ND-3.0 CC-BY-ND-4.0"),
    "cc-by-sa": (2, "CC-BY-SA-1.0 CC-BY-SA-2.0 CC-BY-SA-2.5 CC-BY-SA-3.0 CC-BY-SA-4.0"),
    "cddl": (1, "CDDL-1.0 CDDL-1.1"),
    "cecill": (2, "CECILL-1.0 CECILL-1.1 CECILL-2.0 CECILL-2.1 CECILL-B CECILL-C"),
    "cpl": (1, "CPL-1.0"),
    "ecl": (0, "ECL-1.0 ECL-2.0"),
    "epl": (1, "EPL-1.0 EPL-2.0"),
    "eupl": (2, "EUPL-1.0 EUPL-1.1 EUPL-1.2"),
    "gfdl": (2, "GFDL-1.1-only GFDL-1.1-or-later GFDL-1.2-only GFDL-1.2-or-later GFDL-1.3-only GFDL-1.3-or-later"),
    "gpl": (2, "GPL-1.0 GPL-1.0-only GPL-1.0-or-later GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later"),
    "ipl": (1, "IPL-1.0"),
    "isc": (0, "ISC"),
    "lgpl": (1, "LGPL-2.0 LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later"),
    "lppl": (0, "LPPL-1.0 LPPL-1.1 LPPL-1.2 LPPL-1.3a LPPL-1.3c"),
    "mit": (0, "MIT MIT-0 MIT-CMU MIT-Modern-Variant MIT-advertising MIT-enna MIT-feh"),
    "mpl": (1, "MPL-1.0 MPL-1.1 MPL-2.0 MPL-2.0-no-copyleft-exception"),
    "ms-pl": (0, "MS-PL"),
    "ms-rl": (1, "MS-RL"),
    "ncsa": (0, "NCSA"),
    "odbl": (2, "ODbL-1.0"),
    "ofl": (1, "OFL-1.0 OFL-1.1"),
    "openssl": (0, "OpenSSL"),
    "osl": (2, "OSL-1.0 OSL-1.1 OSL-2.0 OSL-2.1 OSL-3.0"),
    "postgresql": (0, "PostgreSQL"),
    "psf": (0, "PSF-2.0 Python-2.0 Python-2.0.1"),
    "public-domain": (0, "CC0-1.0 Unlicense PDDL-1.0"),
    "sspl": (3, "SSPL-1.0"),
    "upl": (0, "UPL-1.0"),
    "w3c": (0, "W3C W3C-19980720 W3C-20150513"),
    "wtfpl": (0, "WTFPL"),
    "zlib": (0, "Zlib zlib-acknowledgement"),
    "zpl": (0, "ZPL-1.1 ZPL-2.0 ZPL-2.1"),
}
#: How much an identifier binds that is well formed but not known.
UNKNOWN_BINDS = 1
TAG = "spdx license identifier"
_TAG = re.compile(r"SPDX-License-Identifier[ \t]*:?[ \t]*([A-Za-z0-9.+() \t-]+)", re.I | re.A)
_PART = re.compile(r"[()]|[A-Za-z0-9.+-]+")
_WELL_FORMED = re.compile(r"(?=.*[0-9-])[A-Za-z0-9][A-Za-z0-9.-]{2,}\+?", re.A)
_BINDS = {"or": 1, "and": 2, "with": 3}


class ExpressionError(ValueError):
    """An expression that does not parse."""


def to_postfix(expression: str) -> list[str]:
    """Shunting yard: WITH binds more than AND, AND more than OR; operators in either case, to the left."""
    out: list[str] = []
    stack: list[str] = []
    operand = False
    for part in _PART.findall(expression):
        low = part.lower()
        if part == "(":
            if operand:
                raise ExpressionError(expression)
            stack.append(part)
        elif part == ")":
            if not operand:
                raise ExpressionError(expression)
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                raise ExpressionError(expression)
            stack.pop()
        elif low in _BINDS:
            if not operand:
                raise ExpressionError(expression)
            while stack and stack[-1] != "(" and _BINDS[stack[-1]] >= _BINDS[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = False
        else:
            if operand:
                raise ExpressionError(expression)
            out.append(part)
            operand = True
    if not operand or "(" in stack:
        raise ExpressionError(expression)
    return out + stack[::-1]


@cache
def _known() -> dict[str, tuple[str, int]]:
    return {x.lower(): (label, binds) for label, (binds, names) in IDENTIFIERS.items() for x in names.split()}


def family(identifier: str) -> tuple[str, int] | None:
    """Label and strength of a licence identifier. Versions and variants that are not listed go by the longest beginning that is
    a label (GPL-9.9 is gpl); others that look like an identifier (with a digit or a hyphen) are labels of their own."""
    low = identifier.lower().rstrip("+")
    if low in _known():
        return _known()[low]
    begins = [k for k in IDENTIFIERS if low == k or low.startswith(k + "-")]
    if begins:
        label = max(begins, key=len)
        return label, IDENTIFIERS[label][0]
    return (low, UNKNOWN_BINDS) if _WELL_FORMED.fullmatch(identifier) else None


def evaluate(expression: str) -> tuple[set[str], int]:
    """Labels of the expression and how much it binds: OR leaves the choice of the freer side, AND takes the stricter
    one, WITH an exception frees by one step. Raises ExpressionError for what does not parse or names nothing known."""
    return evaluated(to_postfix(expression), expression)[:2]


def evaluated(postfix: list[str], expression: str = "") -> tuple[set[str], int, str]:
    """Labels, strength and the expression over labels with all its brackets, in linear work."""
    stack: list[tuple[set[str], int, list]] = []
    for part in postfix:
        if part == "with":
            exception = stack.pop()[2]
            labels, bound, said = stack.pop()
            stack.append((labels, max(bound - 1, 0), [said, " WITH ", exception]))
        elif part in ("and", "or"):
            (b, y, right), (a, x, left) = stack.pop(), stack.pop()
            more, less = (a, b) if len(a) >= len(b) else (b, a)
            more |= less
            stack.append((more, max(x, y) if part == "and" else min(x, y), ["(", left, f" {part.upper()} ", right, ")"]))
        else:
            known = family(part)
            stack.append(({known[0]}, known[1], [known[0]]) if known else (set(), 0, [part.lower()]))
    labels, bound, said = stack[-1]
    if not labels:
        raise ExpressionError(expression)
    return labels, bound, _flat(said)


def _flat(said: list) -> str:
    """The text of nested lists, however deep."""
    out, left = [], [said]
    while left:
        x = left.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            left.extend(reversed(x))
    return "".join(out)


def longest_expression(text: str) -> tuple[set[str], int] | None:
    """Labels and strength of longest_evaluated()."""
    found = longest_evaluated(text)
    return found and found[:2]


def longest_evaluated(text: str) -> tuple[set[str], int, str] | None:
    """Of the text behind a tag, the longest leading part that is an expression, as evaluated() has it. One pass finds it: it ends where an operand
    was last seen and no bracket was open, before the first part that fits no more. Shorter ones name nothing that it doesn't."""
    end = opened = 0
    operand = False
    for m in _PART.finditer(text):
        part = m[0]
        if operand != (part == ")" or part.lower() in _BINDS):
            break
        if part == "(":
            opened += 1
        elif part == ")":
            if not opened:
                break
            opened -= 1
        else:
            operand = not operand
        if operand and not opened:
            end = m.end()
    try:
        return evaluated(to_postfix(text[:end]))
    except ExpressionError:
        return None


@cache
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    # identifiers of several words only: MIT or Zlib alone are words like others
    lone = {b" ".join(word_bytes(x)).decode(): label for x, (label, _) in _known().items() if b" " in b" ".join(word_bytes(x))}
    for kind, phrases in (("base", BASE), ("identifier", lone), ("notice", NOTICES), ("tag", {TAG: ""})):
        for phrase, label in phrases.items():
            found.add_word(f" {phrase} ", (kind, label, len(phrase) + 2))
    found.make_automaton()
    return found


def scan(text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, bound and expression (null without one; of several
    tags the strictest bound and the first expression)."""
    words = word_bytes(text)
    joined = " " + b" ".join(words).decode("utf-8", "surrogatepass") + " "
    starts: list[int] = []
    base: set[str] = set()
    more: set[str] = set()
    doubt, bound, said, tagged = 1.0, None, None, False
    for end, (kind, label, length) in _automaton().iter(joined):
        if kind == "base":
            starts.append(end - length + 1)
            base.add(label)
            doubt *= 0.4
        elif kind in ("notice", "identifier"):
            more.add(label)
            doubt *= 0.2 if kind == "notice" else 0.5
        elif not tagged:
            tagged = True  # one pass over the text finds all tags
            for m in _TAG.finditer(text or ""):
                if known := longest_evaluated(m[1]):
                    more |= known[0]
                    bound, said = max(bound or 0, known[1]), said or known[2]
                    doubt *= 0.05
    at = [joined.count(" ", 0, x) for x in (min(starts), max(starts))] if starts else [None, None]
    return len(words), len(starts), *at, ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 - doubt, bound, said


_NAMES = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "bound", "expression"]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.string()]


def licenses(documents: DataFrame) -> DataFrame:
    """A row for each row of documents: doc_id and what scan() finds. Null and empty texts have no words, no labels and
    score 0; repeated rows each get their row."""

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [scan(t) for t in batch.column(1).to_pylist()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_NAMES)
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True))], names=["doc_id", *_NAMES])

    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return mapped(docs, of, "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, bound bigint, expression string")


def op5_licenses(spark, sf_dir: str) -> DataFrame:
    """licenses() of all documents: nulls, empty and long texts, repeated rows and empty tables as there."""
    return licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
