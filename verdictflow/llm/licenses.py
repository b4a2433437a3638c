"""License scans: an Aho-Corasick automaton finds identifier tags and notice phrases, a shunting-yard
parser evaluates the and/or/with expressions behind tags.

A text is seen twice: as its lower-cased words joined by single blanks, in which notice phrases stand
consecutively, and - only where the automaton found the tag's words - as it is, for the expression.

Defined results: a null or empty text has no words, no labels and a score of 0; an expression that
cannot be parsed gives the labels of the identifiers that were read before the fault; repeated rows
and ids are judged row by row; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, table, texts_of

#: The base phrases of the scan and their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notice phrases beyond the base, as words, and the identifier each one stands for.
NOTICES = {
    "apache license version 2 0": "apache-2.0",
    "apache software license": "apache",
    "boost software license": "bsl-1.0",
    "creative commons attribution": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by nc nd": "cc-by-nc-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc0 1 0 universal": "cc0-1.0",
    "eclipse public license": "epl",
    "affero general public license": "agpl",
    "lesser general public license": "lgpl",
    "general public license version 2": "gpl-2.0",
    "general public license version 3": "gpl-3.0",
    "isc license": "isc",
    "licensed under the apache license": "apache",
    "mit license": "mit",
    "mozilla public license": "mpl",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "released into the public domain": "public-domain",
    "the unlicense": "unlicense",
}
TAG = "spdx license identifier"

#: bytes -> lower-cased word bytes; whatever is no word character becomes a blank.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
_TAG_LINE = re.compile(r"spdx-license-identifier\s*:\s*([^\n\r]*)", re.I)
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.:-]*\+?")
_BINDS = {"or": 1, "and": 2, "with": 3}


@dataclass
class Expression:
    """A parsed licence expression: its text in postfix form, identifiers and exceptions, and whether
    one licence alone suffices (no `and`)."""

    postfix: list[str] = field(default_factory=list)
    licences: list[str] = field(default_factory=list)
    exceptions: list[str] = field(default_factory=list)
    valid: bool = False

    def allows(self, allowed: set[str]) -> bool:
        """Whether some choice within the expression needs only licences in allowed."""
        stack: list[bool] = []
        for x in self.postfix:
            if x in _BINDS:
                b, a = stack.pop(), stack.pop()
                stack.append(a or b if x == "or" else a and b if x == "and" else a)
            else:
                stack.append(x in allowed)
        return self.valid and stack == [True]


def parse(text: str) -> Expression:
    """Shunting-yard over identifiers, parentheses and the operators or < and < with.

    Reading stops at the first token that cannot follow (a comment end, prose after the expression);
    what stands before it counts if it is a whole expression."""
    out, ops, found = [], [], Expression()
    operand, depth = False, 0
    for m in _TOKEN.finditer(text):
        t = m[0].lower()
        if t in _BINDS:
            if not operand:
                break
            while ops and ops[-1] != "(" and _BINDS[ops[-1]] >= _BINDS[t]:
                out.append(ops.pop())
            ops.append(t)
            operand = False
        elif t == "(":
            if operand:
                break
            ops.append(t)
            depth += 1
        elif t == ")":
            if not operand or not depth:
                break
            while ops[-1] != "(":
                out.append(ops.pop())
            ops.pop()
            depth -= 1
        else:
            if operand:
                break
            (found.exceptions if ops and ops[-1] == "with" else found.licences).append(t)
            out.append(t)
            operand = True
    found.valid = operand and not depth
    while ops:
        out.append(ops.pop())
    found.postfix = out if found.valid else []
    return found


def automaton():
    """Phrases between blanks -> (phrase, words, base label, other label); the tag is one of them."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase in {*BASE_PHRASES, *NOTICES, TAG}:
        a.add_word(f" {phrase} ", (phrase, len(phrase) + 2, BASE_PHRASES.get(phrase), NOTICES.get(phrase)))
    a.make_automaton()
    return a


def scan_text(text: str, phrases) -> dict:
    words = text.encode("utf-8", "replace").translate(_WORDS).split()
    # one char a byte: all phrases are ASCII, and positions only serve to count blanks
    line = f" {b' '.join(words).decode('latin-1')} "
    base, labels, starts, n, tagged, weak = set(), set(), [], 0, False, 0
    for end, (phrase, size, own, other) in phrases.iter(line):
        if own:
            base.add(own)
            starts.append(end + 1 - size)
            n += 1
        if other:
            labels.add(other)
            weak += 1
        tagged |= phrase == TAG
    expressions = [parse(m[1]) for m in _TAG_LINE.finditer(text)] if tagged else []
    for e in expressions:
        labels.update(e.licences)
        labels.update(e.exceptions)
    word = lambda at: line.count(" ", 0, at)
    strength = [0.95] * sum(e.valid for e in expressions) + [0.6] * min(weak, 3) + [0.5] * min(n, 3)
    miss = 1.0
    for x in strength:
        miss *= 1 - x
    return {
        "n_words": len(words), "n_base": n, "first_word": word(min(starts)) if n else None, "last_word": word(max(starts)) if n else None,
        "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | labels)), "score": 1 - miss if strength else 0.0,
        "expressions": "; ".join(" ".join(e.postfix) for e in expressions if e.valid),
    }


FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions string"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document, a narrow map. first_word and last_word are the word numbers of the first
    and last base place; expressions are the tags' expressions in postfix form."""
    names = [x.split()[0] for x in FIELDS.split(", ")]

    def make():
        phrases = automaton()

        def step(batch):
            found = [scan_text(t, phrases) for t in texts_of(batch)]
            yield {"doc_id": batch.column("doc_id")} | {k: [x[k] for x in found] for k in names}

        return step

    kind = dict(docs.dtypes)[id_col]
    return arrow_map(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), f"doc_id {kind}, {FIELDS}", make)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
