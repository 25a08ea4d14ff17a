"""Licence scans: Aho-Corasick over words, shunting-yard over licence expressions."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases whose places are counted, and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Notice phrases that only add labels.
NOTICES = {
    "permission is hereby granted free of charge": "mit",
    "licensed under the apache license": "apache",
    "redistribution and use in source and binary forms": "bsd",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "creative commons attribution": "cc-by",
    "released into the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
TAG = "spdx license identifier"
#: Licences that a policy may treat as free to use; an expression is evaluated against them.
PERMISSIVE = frozenset({"mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "zlib", "cc0-1.0", "unlicense", "cc-by-4.0"})
#: Names that the base phrases give to licences with another identifier.
SAME = {"apache-2.0": "apache-2"}

_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_TOKEN = re.compile(r"[ \t]*(\(|\)|[a-z0-9][a-z0-9.+:-]*)")
_LEAD = re.compile(r"[ \t:=\"']*")
_BINDS = {"or": 1, "and": 2, "with": 3}


def _postfix(text: str, at: int, end: int) -> tuple[list[str], int, bool]:
    """(postfix, where reading stopped, whether an operand came last) of the expression at ``at``."""
    out: list[str] = []
    stack: list[str] = []
    operand, open_, good = True, 0, at
    while m := _TOKEN.match(text, at, end):
        token = m[1]
        if operand and token == "(":
            stack.append(token)
            open_ += 1
        elif operand and token not in _BINDS and token != ")":
            out.append(token.rstrip(".:-"))
            operand = False
        elif not operand and token == ")" and open_:
            while (top := stack.pop()) != "(":
                out.append(top)
            open_ -= 1
        elif not operand and token in _BINDS:
            while stack and stack[-1] != "(" and _BINDS[stack[-1]] >= _BINDS[token]:
                out.append(stack.pop())
            stack.append(token)
            operand = True
        else:
            break
        at = m.end()
        if not operand:
            good = at
    return out + [x for x in reversed(stack) if x != "("], good, not operand


def read_expression(text: str, at: int, end: int) -> tuple[list[str], int]:
    """The longest licence expression at ``at`` in postfix order ([] if none), and where it ends; ``text`` is lower-case.

    A shunting-yard over identifiers, parentheses and the operators with, and, or (binding in that
    order). Reading stops at ``end`` or where no expression continues; a dangling operator or an
    unclosed parenthesis at the end is dropped. Time is linear in what is read.
    """
    out, good, whole = _postfix(text, at, end)
    if whole or good == at:
        return (out if whole else []), good
    return _postfix(text, at, good)[0], good


def to_postfix(text: str) -> list[str]:
    return read_expression(text, 0, len(text))[0]


def evaluate(postfix: list[str], allowed: frozenset[str] = PERMISSIVE) -> bool | None:
    """Whether the expression can be met with ``allowed`` licences alone; None for no expression."""
    stack: list[bool] = []
    for token in postfix:
        if token in _BINDS:
            right, left = stack.pop(), stack.pop()
            # An exception only widens what its licence grants.
            stack.append(left if token == "with" else left and right if token == "and" else left or right)
        else:
            stack.append(token in allowed)
    return stack[0] if stack else None


def licences(postfix: list[str]) -> set[str]:
    """The licences an expression names, without the exceptions."""
    stack: list[set[str]] = []
    for token in postfix:
        if token in _BINDS:
            right, left = stack.pop(), stack.pop()
            if token != "with":  # the smaller set joins the larger
                left, right = sorted((left, right), key=len, reverse=True)
                left |= right
            stack.append(left)
        else:
            stack.append({SAME.get(token, token)})
    return stack[0] if stack else set()


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, phrases in (("base", BASE), ("notice", NOTICES), ("tag", {TAG: ""})):
        for phrase, label in phrases.items():
            found.add_word(f" {phrase} ", (kind, phrase, label))
    found.make_automaton()
    return found


def scan(text: str | None, machine: ahocorasick.Automaton) -> dict:
    """What one text holds: counts, first and last place, labels, expressions' verdict, score.

    Each part takes time linear in the text: places come from the words' offsets, and a tag inside
    an expression that was already read is part of that expression.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = [w for w in raw.translate(_FOLD).split(b" ") if w]
    places: list[int] = []
    tags: list[int] = []
    base: set[str] = set()
    labels: set[str] = set()
    verdicts: list[bool] = []
    extra = 0
    found = list(machine.iter(f" {b' '.join(words).decode('latin-1')} "))
    begins = np.cumsum([0] + [len(w) + 1 for w in words[:-1]]) if found else None
    for end, (kind, phrase, label) in found:
        start = int(np.searchsorted(begins, end - len(phrase) - 1))
        if kind == "base":
            places.append(start)
            base.add(label)
        elif kind == "notice":
            labels.add(label)
            extra += 1
        else:
            tags.append(start)
    if tags:
        folded = raw.lower().decode("latin-1")  # as many characters as bytes
        ends = [m.end() for m in _WORD.finditer(raw)]
        breaks = [m.start() for m in re.finditer(rb"\n", raw)] + [len(raw)]
        read = 0
        for start in tags:
            # The tag's third word ends where the expression starts.
            at = ends[start + 2]
            if at < read:
                continue
            stop = breaks[bisect.bisect_left(breaks, at)]
            postfix, read = read_expression(folded, _LEAD.match(folded, at, stop).end(), stop)
            if postfix:
                labels |= licences(postfix)
                verdicts.append(bool(evaluate(postfix)))
                extra += 1
    return {
        "n_words": len(words),
        "n_base": len(places),
        "first_word": min(places, default=None),
        "last_word": max(places, default=None),
        "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(base | labels)),
        "score": 1.0 - 0.5 ** min(len(places) + extra, 50),
        "permissive": all(verdicts) if verdicts else None,
    }


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, permissive boolean"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document: base phrases' places, labels, score, and whether its tags' expressions are permissive.

    Null and empty texts give zero counts, null places and empty labels; repeated rows and null ids
    are scanned row by row; an empty table gives no rows; other columns are ignored. The score is
    1 - 2^-k for k places of any kind.
    """

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = automaton()
        for batch in batches:
            rows = pd.DataFrame([scan(t, machine) for t in batch["text"]], columns=[c.split()[0] for c in SCHEMA.split(", ")[1:]])
            rows = rows.astype({"first_word": "Int64", "last_word": "Int64", "permissive": "boolean"})
            rows.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield rows

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(kernel, SCHEMA)
