"""Secrets in texts: patterns, and literals that reach a sensitive name through assignments.

Every ``=`` and ``:`` of a text may assign: the lexer reads the name before it (bare, quoted, dotted or in brackets) and the value
after it: quoted strings of common languages, joined pieces, a bare configuration value, or a reference to another name (``x``,
``$x``, ``${x}``, ``{{ x }}``, ``%(x)s``). Elements ``<name>value</name>`` and options ``--name value`` are pairs too. Constants are
propagated: a reference takes the last assignment of its name before it, or the first one after it, so that a literal scores by
every name it flows into. The score is the name's sensitivity times the strength of the literal (length, entropy, kinds of
characters); place-holders, paths, addresses and calls score nothing. Literals of ``LEAST`` or more are found as kind ``literal``.

The scan is one narrow pass: whole texts, no shuffle; the work grows with a text's length, and each assignment is visited once.

Defined results: null text counts as empty and has no findings; offsets are code points, ends exclusive; matches of one pattern do
not overlap, spans of different kinds may; findings go by start, then kind in the order of ``KINDS``; repeated rows give repeated
results; an empty table gives none. Only the named columns are read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, steps

KINDS = ("assign", "access", "hex", "literal")
LEAST = 0.5

# The base patterns
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Words of a name and how sensitive they make it.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "passcode": 0.9, "pass": 0.7, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "creds": 0.9, "auth": 0.7, "authorization": 0.7, "bearer": 0.8, "salt": 0.6,
}
#: A key is sensitive after one of these words.
KEY_KINDS = {"api", "access", "secret", "private", "encryption", "signing", "master", "auth", "account", "storage", "ssh", "session", "client"}
#: A name that ends so speaks about a secret, but does not hold one.
HARMLESS = {
    "id", "name", "file", "filename", "path", "dir", "url", "uri", "host", "length", "len", "size", "count", "max", "min", "type", "field", "label", "hint",
    "header", "expiry", "expires", "ttl", "policy", "prompt", "placeholder", "regex", "pattern", "format", "column", "error", "message", "required",
    "enabled", "timeout", "index", "help", "title", "class", "style",
}
PLACEHOLDER = re.compile(
    r"(?i).*(?:change.?me|example|placeholder|your[_ -]|dummy|redacted|insert[_ -]|todo).*|(.)\1*|[x*.•-]+|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\)s|true|false|none|null|nil|undefined"
    r"|password|passwd|secret|token|\w+://\S*|\.{0,2}/\S*|[a-z]:\\.*|[^\s@]+@[^\s@]+\.\w+|(?-i:[A-Z]+_[A-Z_]+)", re.S
)

PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
QUOTED = re.compile(
    r"""[A-Za-z@$]{0,2}(?:\"{3}(?P<a>.*?)\"{3}|'{3}(?P<b>.*?)'{3}|"(?P<c>(?:[^"\\\n]|\\.)*)"|'(?P<d>(?:[^'\\\n]|\\.)*)'|`(?P<e>(?:[^`\\\n]|\\.)*)`)""", re.S
)
REFERENCE = re.compile(r"""\$\{\s*(?:env[:.])?([\w.-]+)(?::?-[^}\n]*)?\}|\{\{\s*([\w.]+)\s*\}\}|%\(([\w.]+)\)s|\$?([A-Za-z_][\w.]*)(?![\w.(\["'+/=-])""")
BARE = re.compile(r"""[^\s,;"'`(){}\[\]<>|]+""")
OPENING = re.compile(r"[ \t]*(?:\([ \t\n]*)?")
JOINT = re.compile(r"""[ \t]*(?:\\?\n[ \t]*)?(?:\+|\.\.?|&)[ \t]*(?:\\?\n[ \t]*)?(?=["'`A-Za-z_$])|[ \t]*(?:\\?\n[ \t]*)?(?=["'][^"'\n])""")
ANNOTATED = re.compile(r"[ \t]*[A-Za-z_][\w.\[\], |]*?[ \t]*=(?![=>])")
ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*)(?:[ \t][^<>\n]*)?>([^<>]*)</\1[ \t]*>")
OPTION = re.compile(r"(?<!\S)--?([A-Za-z][\w-]+)[ \t]+([^\s-]\S*)")
OPERATOR = re.compile(r"[=:]")


@lru_cache(maxsize=1 << 16)
def name_score(name: str) -> float:
    """How sensitive a name is, from 0 to 1."""
    parts = [p.lower() for p in PARTS.findall(name)]
    best = max((SENSITIVE.get(p.removesuffix("s"), SENSITIVE.get(p, 0.0)) for p in parts), default=0.0)
    if any(b in ("key", "keys") and a in KEY_KINDS for a, b in zip(parts, parts[1:], strict=False)):
        best = 1.0
    return best * (0.2 if parts and (parts[-1] in HARMLESS or "public" in parts) else 1.0)


def strength(value: str) -> float:
    """How much a literal looks like a secret, from 0 to 1."""
    value = value.strip()
    n = len(value)
    if n < 6 or PLACEHOLDER.fullmatch(value):
        return 0.0
    counts = Counter(value)
    entropy = -sum(c / n * log2(c / n) for c in counts.values())
    kinds = sum(any(test(c) for c in counts) for test in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    score = 0.4 * min(1.0, n / 16) + 0.4 * min(1.0, entropy / 3.5) + 0.2 * (kinds > 1)
    return score * (0.5 if kinds == 1 and not value.isdigit() else 1.0) * (0.3 if " " in value else 1.0)


def _name_before(text: str, at: int) -> str:
    """The name that ends before an operator; empty if there is none."""
    while at and text[at - 1] in " \t":
        at -= 1
    if at and text[at - 1] == "]":
        at -= 1
    quote = text[at - 1] if at and text[at - 1] in "\"'`" else ""
    end = at = at - len(quote)
    while at and (text[at - 1].isalnum() or text[at - 1] in "_$.-"):
        at -= 1
    if quote and not (at and text[at - 1] == quote):
        return ""
    return text[at:end]


class Bare:
    """Ends of bare values; a run of their characters is read once, however many operators it holds."""

    def __init__(self, text: str):
        self.text, self.until = text, 0

    def end(self, at: int) -> int:
        """The end of the bare value that begins here; the same place if there is none, or a bracket or quote follows it."""
        if at >= self.until:
            m = BARE.match(self.text, at)
            self.until = m.end() if m else at
        return at if self.text[self.until : self.until + 1] in ("(", "[", '"', "'", "`") else self.until


def _value(text: str, at: int, bare: Bare) -> tuple[list[tuple[int, int]], list[str], int]:
    """Spans of the literal pieces, and the references, of the value that begins here, and where the last of them ends."""
    at = OPENING.match(text, at).end()
    literals, names = [], []
    while True:
        if m := QUOTED.match(text, at):
            literals.append(m.span(m.lastgroup))
            at = m.end()
        elif (m := REFERENCE.match(text, at)) and not (m.lastindex == 4 and not literals and not names and bare.end(at) > m.end()):
            names.append(m[m.lastindex])
            if not literals and len(names) == 1 and bare.end(at) == m.end() and any(c.isdigit() for c in m[0]):
                literals.append(m.span())  # a bare value with digits, unless the name is assigned somewhere
            at = m.end()
        else:
            if not literals and not names and (end := bare.end(at)) > at:
                literals.append((at, end))
                at = end
            return literals, names, at
        if not (joint := JOINT.match(text, at)):
            return literals, names, at
        at = joint.end()


def pairs(text: str) -> list[tuple[str, list[tuple[int, int]], list[str]]]:
    """(name, spans of literals, references) of every assignment, in order."""
    found, bare, done = [], Bare(text), 0
    for m in OPERATOR.finditer(text):
        at, end = m.span()
        if at < done:  # inside a value
            continue
        after = text[end : end + 1]
        if m[0] == "=":
            if after == "=" or text[at - 1 : at] in ("=", "!", "<", ">"):
                continue
            end += after == ">"
            while at and text[at - 1] in ":+?|":
                at -= 1
        elif after in ("=", ":", "/") or text[at - 1 : at] == ":":
            continue
        elif note := ANNOTATED.match(text, end):
            end = note.end()
        if name := _name_before(text, at):
            *value, done = _value(text, end, bare)
            found.append((at, name, *value))
    for tagged, wanted in ((ELEMENT, "</"), (OPTION, "-")):
        if wanted in text:
            found += [(m.start(), m[1], [m.span(2)], []) for m in tagged.finditer(text)]
    found.sort(key=lambda x: x[0])
    return [x[1:] for x in found]


def literals(text: str) -> dict[tuple[int, int], tuple[float, str]]:
    """Score and name of the literals that reach a sensitive name."""
    every = pairs(text)
    scores = [name_score(name) for name, _, _ in every]
    if not any(scores):
        return {}
    places: dict[str, list[int]] = {}
    for i, (name, _, _) in enumerate(every):
        places.setdefault(name, []).append(i)
    found: dict[tuple[int, int], tuple[float, str]] = {}
    seen: set[int] = set()
    # from the most sensitive name on, so that each assignment is visited once
    for i in sorted((i for i, s in enumerate(scores) if s > 0), key=lambda i: -scores[i]):
        open_ = [i]
        while open_:
            j = open_.pop()
            if j in seen:
                continue
            seen.add(j)
            spans, names = every[j][1:]
            known = [n for n in names if n in places and places[n] != [j]]
            if not (known and len(names) == len(spans) == 1 and text[slice(*spans[0])] == names[0]):  # else a name, not a value
                score = scores[i] * strength("".join(text[a:b] for a, b in spans))
                if score >= LEAST:
                    found |= {s: (score, every[i][0]) for s in spans if s not in found and s[1] > s[0]}
            for n in known:
                before = bisect_left(places[n], j)
                open_.append(places[n][before - 1] if before else places[n][0] if places[n][0] != j else places[n][-1])
    return found


def findings(text: str) -> list[tuple[str, int, int, str | None, float]]:
    """kind, start, end, target name and score (1 for the base patterns) of what a text holds."""
    out = [("assign", *m.span(), m[1], 1.0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if ":" in text or "=" in text else []
    out += [("access", *m.span(), None, 1.0) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    out += [("hex", *m.span(), None, 1.0) for m in HEX.finditer(text)]
    out += [("literal", a, b, name, score) for (a, b), (score, name) in literals(text).items()]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


FINDING = "array<struct<kind:string,start:int,end:int,target:string,score:double>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the findings of every document, one row for each row."""
    part = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("target", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, 1):
            found = [[dict(zip(part.names, x, strict=True)) for x in findings(t or "")] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(part))], ["doc_id", "findings"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, findings {FINDING}")


def spans(found: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end of the findings of these kinds, joined by commas."""
    mine = F.filter(found, lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(mine, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans, n_literal and max_score."""
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long")
    literal = F.filter("findings", lambda x: x["kind"] == "literal")
    return scan(docs, id_col, text_col).select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(spans(F.col("findings"), KINDS[:3]).cast("binary"), 256).alias("base_sha256"),
        spans(F.col("findings")).alias("spans"), count("literal").alias("n_literal"), F.array_max(F.transform(literal, lambda x: x["score"])).alias("max_score"),
    )


def redact(docs: DataFrame, mark: str = "[secret]", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, with a mark in place of every finding; findings that overlap become one mark."""

    def clean(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            at, kept = 0, []
            for _, a, b, *_ in findings(text or ""):
                if a >= at:
                    kept += [text[at:a], mark]
                at = max(at, b)
            out.append(text if not kept else "".join([*kept, text[at:]]))
        return pa.array(out, pa.string())

    name = fresh(docs.columns, "_clean")
    cleaned = docs.withColumn(name, F.arrow_udf(clean, "string")(F.col(text_col)))
    return cleaned.select(*[F.col(name).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
