"""The classic query syntax for full-text search, compiled to a boolean Column and a set of terms for scoring.

Supported: terms, ``"phrases"~slop``, ``field:``, presence ``field:*``, wildcards ``* ?``, fuzzy ``term~n``, ``/regex/``, ranges
``[a TO b] {a TO b}``, ``AND OR NOT && || !``, ``+ -`` and ``^boost``. Everything is compared in lower case: terms, wildcards, fuzzy terms and phrases with a
slop with the words of a field (letters, digits and underscores), plain phrases and regular expressions with any part of it, ranges with the whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"""\s*(?:(?P<op>\(|\)|&&|\|\||\+|-(?=\S)|!|\^[0-9.]+)|(?P<field>\w[\w.]*):|(?P<phrase>"(?:[^"\\]|\\.)*"(?:~\d+)?)|(?P<regex>/(?:[^/\\]|\\.)*/)
    |(?P<range>[\[{]\s*\S+\s+TO\s+[^\s\]}]+\s*[\]}])|(?P<term>(?:\\.|[^\s()"^:\\])+))""",
    re.X,
)


class LuceneError(ValueError):
    pass


@dataclass
class Node:
    """``kind``: term, phrase, wildcard, fuzzy, regex, range, exists, or bool with ``(occur, node)`` clauses."""

    kind: str
    field: str | None = None
    text: str = ""
    number: float = 0
    clauses: tuple = ()
    boost: float = 1.0


def parse(query: str, default_field: str | None = None) -> Node:
    found, at = [], 0
    while at < len(query.rstrip()):
        m = TOKEN.match(query, at)
        if not m:
            raise LuceneError(f"cannot read the query at {at}: {query[at : at + 10]!r}")
        found.append((m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    node, k = _clauses(found, 0, default_field)
    if k < len(found):
        raise LuceneError("unbalanced parenthesis")
    return node


def _clauses(toks: list, k: int, field: str | None) -> tuple[Node, int]:
    clauses: list[tuple[str, Node]] = []
    occur, joined = "should", None
    while k < len(toks):
        kind, text = toks[k]
        if (kind, text) == ("op", ")"):
            break
        upper = text.upper() if kind == "term" else text
        if upper in ("AND", "&&"):
            if clauses and clauses[-1][0] == "should":
                clauses[-1] = ("must", clauses[-1][1])
            joined, k = "must", k + 1
            continue
        if upper in ("OR", "||"):
            joined, k = "should", k + 1
            continue
        if upper in ("NOT", "!", "-") and (kind == "op" or kind == "term"):
            occur, k = "not", k + 1
            continue
        if (kind, text) == ("op", "+"):
            occur, k = "must", k + 1
            continue
        node, k = _atom(toks, k, field)
        if k < len(toks) and toks[k][0] == "op" and toks[k][1].startswith("^"):
            node.boost = float(toks[k][1][1:])
            k += 1
        clauses.append((occur if occur != "should" else joined or "should", node))
        occur, joined = "should", None
    return Node("bool", clauses=tuple(clauses)), k


def _atom(toks: list, k: int, field: str | None) -> tuple[Node, int]:
    kind, text = toks[k]
    if kind == "field":
        if k + 1 >= len(toks):
            raise LuceneError("a field needs a value")
        if toks[k + 1] == ("term", "*"):
            return Node("exists", text), k + 2
        return _atom(toks, k + 1, text)
    if (kind, text) == ("op", "("):
        node, k = _clauses(toks, k + 1, field)
        if k >= len(toks):
            raise LuceneError("unbalanced parenthesis")
        return node, k + 1
    if kind == "phrase":
        body, _, slop = text.rpartition('"')
        return Node("phrase", field, body[1:], float(slop[1:] or 0) if slop else 0), k + 1
    if kind == "regex":
        return Node("regex", field, text[1:-1]), k + 1
    if kind == "range":
        return Node("range", field, text), k + 1
    if kind == "term":
        fuzzy = re.fullmatch(r"(.+)~(\d*\.?\d*)", text)
        if fuzzy:
            n = float(fuzzy[2] or 2)
            return Node("fuzzy", field, fuzzy[1], n if n >= 1 else 2), k + 1
        return Node("wildcard" if re.search(r"(?<!\\)[*?]", text) else "term", field, text), k + 1
    raise LuceneError(f"unexpected {text!r}")


def _words(c: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(c.cast("string"), F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda t: t != "")


def _plain(text: str) -> list[str]:
    return [t.lower() for t in re.findall(r"\w+", re.sub(r"\\(.)", r"\1", text))]


def _slop(words: Column, terms: list[str], slop: int) -> Column:
    """Whether the terms follow each other with at most ``slop`` other words between, each as early as possible after the one before.

    The words are bound to a lambda variable first, so that they are split once and not for every start.
    """
    if slop == 0:
        return F.contains(F.concat(F.lit(" "), F.concat_ws(" ", words), F.lit(" ")), F.lit(f" {' '.join(terms)} "))

    def found(w: Column) -> Column:
        def starts_at(i: Column) -> Column:
            at, ok = i, F.get(w, i) == terms[0]
            for t in terms[1:]:
                step = F.array_position(F.slice(w, at + 2, slop + 1), t).cast("int")
                ok = ok & (step > 0)
                at = at + step
            return F.coalesce(ok & (at - i <= len(terms) - 1 + slop), F.lit(False))

        return F.exists(F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0))), starts_at)

    return F.exists(F.array(words), found)


def condition(node: Node, fields: dict[str, Column]) -> Column:
    """The query as a boolean Column, never null. A node without a field matches in any of ``fields``; unknown fields match nothing."""
    if node.kind == "bool":
        must = [condition(n, fields) for o, n in node.clauses if o == "must"]
        should = [condition(n, fields) for o, n in node.clauses if o == "should"]
        banned = [condition(n, fields) for o, n in node.clauses if o == "not"]
        out = F.lit(True)
        for x in must:
            out = out & x
        if should and not must:
            some = F.lit(False)
            for x in should:
                some = some | x
            out = out & some
        for x in banned:
            out = out & ~x
        return out if must or should or banned else F.lit(False)
    cols = [fields[node.field]] if node.field in fields else [] if node.field else list(fields.values())
    out = F.lit(False)
    for c in cols:
        out = out | F.coalesce(_leaf(node, c), F.lit(False))
    return out


def _leaf(node: Node, c: Column) -> Column:
    words = _words(c)
    if node.kind == "exists":
        return c.isNotNull() & (c.cast("string") != "")
    text = F.lower(c.cast("string"))
    if node.kind == "phrase" and not node.number:
        return F.contains(text, F.lit(re.sub(r"\\(.)", r"\1", node.text).lower())) if node.text else F.lit(False)
    if node.kind in ("term", "phrase"):
        terms = _plain(node.text)
        if not terms:
            return F.lit(False)
        if len(terms) == 1:
            return F.array_contains(words, terms[0])
        return _slop(words, terms, int(node.number) if node.kind == "phrase" else 0)
    if node.kind == "wildcard":
        p = "".join({"*": ".*", "?": "."}.get(ch, re.escape(ch)) for ch in re.sub(r"\\(.)", r"\1", node.text.lower()))
        return F.exists(words, lambda w: w.rlike(f"\\A{p}\\z"))
    if node.kind == "fuzzy":
        return F.exists(words, lambda w: F.levenshtein(w, F.lit(node.text.lower())) <= int(node.number))
    if node.kind == "regex":
        return text.rlike(f"(?i){node.text}")
    low, high = re.match(r"[\[{]\s*(\S+)\s+TO\s+([^\s\]}]+)", node.text).groups()
    inc_low, inc_high = node.text[0] == "[", node.text[-1] == "]"
    number = all(v == "*" or re.fullmatch(r"[-+]?\d+(\.\d+)?", v) for v in (low, high))
    x = c.try_cast("double") if number else F.lower(c.cast("string"))
    out = x.isNotNull()
    for v, inclusive, below in ((low, inc_low, True), (high, inc_high, False)):
        if v != "*":
            k = F.lit(float(v)) if number else F.lit(v.lower())
            out = out & ((x >= k if inclusive else x > k) if below else (x <= k if inclusive else x < k))
    return out


def score(node: Node, fields: dict[str, Column]) -> Column:
    """The query's own score: 1 for each clause that matches, times its boost, summed over the clauses that are not excluded; null without a match."""
    found = condition(node, fields)
    if node.kind != "bool":
        return F.when(found, F.lit(float(node.boost)))
    total = F.lit(0.0)
    for occur, n in node.clauses:
        if occur != "not":
            total = total + F.coalesce(score(n, fields), F.lit(0.0))
    return F.when(found, total * F.lit(float(node.boost)))


def positive_text(node: Node) -> str:
    """The words of all clauses that are not excluded, for scoring."""
    if node.kind == "bool":
        return " ".join(positive_text(n) for o, n in node.clauses if o != "not")
    return node.text if node.kind in ("term", "phrase", "fuzzy") else re.sub(r"[*?]", " ", node.text) if node.kind == "wildcard" else ""
