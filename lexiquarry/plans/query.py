"""Query strings: normalisation, routing and their plan."""

from __future__ import annotations

import re
from dataclasses import dataclass

import regex

#: What the tokenizer calls a word.
_WORD = regex.compile(r"(?V1)[[\p{L}\p{Nd}]&&[\x00-\uFFFF]]+")


@dataclass(frozen=True)
class Plan:
    #: exact, phrase, boolean or prefix
    kind: str
    text: str


def first_word(term: str) -> str:
    """The analyzer's first token, or the term in lower case if it has none."""
    found = _WORD.search(term.lower())
    return found.group() if found else term.lower()


def normalize(query: str) -> str:
    """Each operand or word becomes its first token. A trailing * is kept, a trailing # dropped."""
    if not query.strip():
        return query
    prefix = query.endswith("*")
    q = query[:-1] if query.endswith(("*", "#")) else query
    ops = re.findall(r"&&|\|\|", q)
    if ops:
        parts = [first_word(p.strip()) for p in re.split(r"&&|\|\|", q) if p.strip()]
        out = ""
        for k, p in enumerate(parts):
            out += p
            if k < len(ops):
                out += f" {ops[k]} "
        out += "".join(f" {o} " for o in ops[len(parts) :])
        q = out.strip() if len(ops) <= len(parts) else out.rstrip()
    elif " " in q:
        q = " ".join(first_word(w) for w in q.split(" ") if w)
    else:
        q = first_word(q)
    return q + "*" if prefix else q


def route(query: str) -> Plan:
    """* at the end: documents by prefix, whatever else the query holds. Otherwise boolean, phrase or exact."""
    if query.endswith("*"):
        return Plan("prefix", normalize(query.rstrip("*")))
    q = normalize(query)
    if "&&" in q or "||" in q:
        return Plan("boolean", q)
    return Plan("phrase" if " " in q else "exact", q)


def label(query: str) -> str:
    """The kind shown to a user."""
    if query.endswith("*"):
        return "Prefix"
    if query.endswith("#"):
        return "Ranked"
    return {"boolean": "Boolean", "phrase": "Phrase", "exact": "Exact"}[route(query).kind]
