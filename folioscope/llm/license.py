"""Licence scans: Aho-Corasick over the words of a text, and a shunting-yard reader of licence expressions.

One automaton finds notice phrases and identifier tags as words that stand consecutively.  What follows a found tag and a
colon on its line is read as an expression of identifiers with ``and``, ``or``, ``with`` and parentheses, put into postfix order by the
shunting-yard method and evaluated to its labels and to whether it can be met by permissive licences alone.

Defined results: null and empty texts have no words, no places, null first and last word, empty labels and score 0;
malformed expressions add no labels; repeated rows are scanned each; very long texts are scanned whole, one at a time; an
empty table gives no rows; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.shared import column

#: Phrases that every scan looks for, with their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Further notices.
NOTICES = {
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd 2 clause license": "bsd-2-clause",
    "bsd 3 clause license": "bsd-3-clause",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc0 1 0 universal": "cc0",
    "all rights reserved": "all-rights-reserved",
}

#: The tag before an expression, labels of identifiers that have one, and the permissive licences.
TAG = "spdx license identifier"
KNOWN = {"mit": "mit", "apache-2.0": "apache-2", "cc-by-nc-4.0": "cc-by-nc", "gpl-2.0-only": "gpl", "gpl-3.0-only": "gpl", "gpl-2.0-or-later": "gpl", "gpl-3.0-or-later": "gpl", "mpl-2.0": "mpl"}
PERMISSIVE = {"mit", "apache-2", "bsd-2-clause", "bsd-3-clause", "isc", "cc0", "zlib", "0bsd", "unlicense"}
RANK = {"or": 1, "and": 2, "with": 3}

#: What follows a tag's words: a colon and the expression, up to the end of the line.
TAGGED = re.compile(rb"[ \t]*:[ \t]*([^\r\n]*)")
PLACE = re.compile(rb"[^ ]+")
TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:-]+|\S")

#: Bytes that stand for white space between words, and the small letters.
_TO_WORDS = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def automaton(phrases: dict[str, tuple[str, str]]) -> ahocorasick.Automaton:
    """Finds phrases as whole words in a text that has one space around each word."""
    found = ahocorasick.Automaton()
    for phrase, (kind, label) in phrases.items():
        found.add_word(f" {phrase} ", (len(phrase) + 1, kind, label))
    found.make_automaton()
    return found


PHRASES = {k: ("base", v) for k, v in BASE.items()} | {k: ("notice", v) for k, v in NOTICES.items()} | {TAG: ("tag", "")}


def postfix(expression: str) -> list[str] | None:
    """Operands and operators in postfix order; None if malformed."""
    out: list[str] = []
    waiting: list[str] = []
    operand = False  # whether the last thing was one
    for token in TOKEN.findall(expression):
        small = token.lower()
        if small in RANK:
            if not operand:
                return None
            while waiting and waiting[-1] != "(" and RANK[waiting[-1]] >= RANK[small]:
                out.append(waiting.pop())
            waiting.append(small)
            operand = False
        elif token == "(":
            if operand:
                return None
            waiting.append(token)
        elif token == ")":
            if not operand:
                return None
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                return None
            waiting.pop()
        elif operand or not re.fullmatch(r"[a-z0-9.+:-]+", small):
            if operand and "(" not in waiting:
                break  # the expression has ended; the rest of the line is prose or a comment's end
            return None
        else:
            out.append(small)
            operand = True
    while waiting:
        if waiting[-1] == "(":
            return None
        out.append(waiting.pop())
    return out if operand else None


def evaluate(expression: str) -> tuple[set[str], bool] | None:
    """Labels that an expression names, and whether permissive licences alone can meet it; None if malformed."""
    order = postfix(expression)
    if not order:
        return None
    stack: list[tuple[set[str], bool]] = []
    for x in order:
        if x in RANK:
            (b, free_b), (a, free_a) = stack.pop(), stack.pop()
            # "with" names an exception, which is no licence
            stack.append((a, free_a) if x == "with" else (a | b, free_a or free_b) if x == "or" else (a | b, free_a and free_b))
        else:
            label = KNOWN.get(x, x)
            stack.append(({label}, label in PERMISSIVE))
    return stack[0]


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, permissive boolean"


def scan(text: str | None, found: ahocorasick.Automaton) -> tuple:
    data = (text or "").encode("utf-8", "surrogatepass")
    spaced = data.translate(_TO_WORDS)
    words = spaced.split()
    line = f" {b' '.join(words).decode('latin-1')} "
    base, labels, places, tagged = set(), set(), [], []
    at, spaces, n_found = 0, 0, 0
    for end, (length, kind, label) in found.iter(line):
        start = end - length
        if start >= at:
            spaces += line.count(" ", at, start + 1)
            at = start + 1
            index = spaces - 1
        else:
            index = spaces - 1 - line.count(" ", start + 1, at)
        if kind == "base":
            places.append(index)
            base.add(label)
        elif kind == "notice":
            labels.add(label)
        else:
            tagged.append(index)
        n_found += kind != "tag"
    free = None
    if tagged:
        ends = [m.end() for m in PLACE.finditer(spaced)]
        for index in tagged:
            m = TAGGED.match(data, ends[index + TAG.count(" ")])
            if m and (verdict := evaluate(m[1].decode("utf-8", "replace"))):
                labels |= verdict[0]
                free = verdict[1] if free is None else free and verdict[1]
                n_found += 1
    return (
        len(words), len(places), min(places, default=None), max(places, default=None),
        ",".join(sorted(base)), ",".join(sorted(base | labels)), 1 - 0.5**n_found, free,
    )


def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    found = automaton(PHRASES)
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for texts in batches:
        out = pd.DataFrame([scan(x, found) for x in texts], columns=names)
        yield out.astype({"n_words": "int64", "n_base": "int64", "first_word": "Int64", "last_word": "Int64", "score": "float64", "permissive": "boolean"})


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, counts and places of base phrases, labels, score (1 - 2^-places) and permissive.

    ``permissive`` is null where no expression was read.
    """
    license_scan = F.pandas_udf(scanned, SCHEMA).asNondeterministic()
    return docs.select(F.struct(column(id_col).alias(id_col)).alias("row"), license_scan(column(text_col)).alias("scan")).select("row.*", "scan.*")
