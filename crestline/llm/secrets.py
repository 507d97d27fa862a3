"""Secret scans: patterns for known shapes, and assignment-aware lexing for what only its name gives away.

The lexer reads a text as source or configuration: at each ``=``, ``:``, ``:=`` or ``=>`` it takes the
name on the left and what stands on the right: a quoted literal, literals joined by ``+``, a bare word, or
another name. A type between ``:`` and ``=`` is stepped over, so what follows belongs to the name before it.
A name that was given a literal earlier in the text is a constant, and a name assigned from
it has its literal. A literal is scored by its target's name and by its own look; one that reaches
``THRESHOLD`` becomes a span of kind ``literal`` unless it touches a span of the patterns.

Texts are screened first by expressions that every finding must match, so most are never lexed.

Cases: a null text is an empty one, without findings; a null doc_id is carried; repeated rows give a row
each; an empty table gives an empty result; other columns are not read. Positions are code points.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "literal")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_ASSIGNED, MIN_ACCESS = 12, 18

#: Words of a target's name, and how much each says about its value.
NAME_WEIGHTS = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "bearer": 0.8, "auth": 0.6, "private": 0.6, "access": 0.4, "api": 0.4, "key": 0.4, "signing": 0.4, "encryption": 0.4}
#: Values that stand in for a secret.
PLACEHOLDERS = re.compile(r"example|changeme|change_me|placeholder|your[_-]|dummy|redacted|x{4,}|\*{3,}|todo|none|null|true|false|undefined|\$\{|\{\{|<", re.IGNORECASE)
THRESHOLD = 1.5
MIN_LITERAL = 8

_OPERATOR = re.compile(r":=|=>|[=:]")
_NAME = re.compile(r"([A-Za-z_][A-Za-z0-9_.-]*)[\"']?\]?[ \t]*$")
_VALUE = re.compile(r"""[ \t]*(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|([A-Za-z0-9+/_.=$-]+))""")
#: A type after a name's colon, and the = of the assignment after it.
_TYPE = re.compile(r"""[ \t]*&?(?:'static[ \t]+)?[A-Za-z_][A-Za-z0-9_.]*(?:[\[<(][^=:\n"'{}]{0,80}[\]>)]|\[\])?(?:[ \t]*\|[ \t]*[A-Za-z_][A-Za-z0-9_.]*){0,8}[?!]?(?:[ \t]+=|=(?=[ \t]*["']))(?![=>])""")
_PLUS = re.compile(r"[ \t]*\+(?=[ \t]*[\"'])")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: A weighted word, which a name may hold in two parts, at the end of what stands left of an operator.
_SCREEN = rf"""(?i)({"|".join("[._-]*".join(w) for w in NAME_WEIGHTS)})[A-Za-z0-9_.-]*["']?\]?[ \t]*\n?[=:]|AKIA[A-Z0-9]"""
_SCREEN_HEX = "[0-9a-f]{16}"

SCANNED = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def name_score(name: str) -> float:
    """The weights of a name's words, at most 1.2."""
    words = [w.lower() for w in _WORDS.findall(name.rpartition(".")[2] or name)]
    joined = {a + b for a, b in zip(words[:-1], words[1:], strict=True)}
    return min(1.2, sum(NAME_WEIGHTS.get(w, 0.0) for w in {*words, *joined}))


def value_score(value: str) -> float:
    """From 0 to 1.2 by length, spread of characters and digits; 0 for stand-ins and prose."""
    n = len(value)
    if n < MIN_LITERAL or " " in value or PLACEHOLDERS.search(value):
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    classes = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    if classes < 2 or not re.search("[0-9]", value):
        return 0.0
    return min(1.2, 0.15 * entropy + 0.1 * classes + 0.01 * min(n, 40))


def name_before(text: str, end: int) -> str | None:
    """The whole name that stands before ``end``; the window grows while a name may begin before it."""
    width = 64
    while True:
        begin = max(0, end - width)
        found = _NAME.search(text[begin:end])
        if begin and (found.start() == 0 if found else not text[begin:end].strip(" \t\n\"']")):
            width *= 4
            continue
        return found and found[1]


def name_literal_pairs(text: str) -> Iterator[tuple[str, str, list[tuple[int, int]]]]:
    """Names, their literals and the spans these come from, constants propagated."""
    known: dict[str, tuple[str, list[tuple[int, int]]]] = {}
    typed = -1
    for m in _OPERATOR.finditer(text):
        name, at = name_before(text, m.start()), m.end()
        if not name:
            continue
        of_type = m.start() == typed
        if m[0] == ":" and (annotated := _TYPE.match(text, at)):
            at = annotated.end()
            typed = at - 1
        value, spans = "", []
        while got := _VALUE.match(text, at):
            group = got.lastindex
            if group == 3 and (spans or got[3] in known):
                value, spans = known[got[3]] if not spans else (value, spans)
                break
            value += got[group]
            spans.append(got.span(group))
            at = got.end()
            if group == 3 or not (plus := _PLUS.match(text, at)):
                break
            at = plus.end()
        if spans:
            if not of_type:  # a type is no constant
                known[name] = (value, spans)
            yield name, value, spans


def scan_text(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Spans (start, kind, end) of the patterns, and those with what the lexer adds; both in order."""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGNED]
    base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    base += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base.sort()
    added = set()
    for name, value, spans in name_literal_pairs(text):
        if (named := name_score(name)) and named + value_score(value) >= THRESHOLD and value_score(value):
            added.update((a, 3, b) for a, b in spans if b > a)
    starts, reach = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max))
    apart = [x for x in added if not (k := bisect_left(starts, x[2])) or reach[k - 1] <= x[0]]
    return base, sorted(base + apart)


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _suspects(texts: pa.Array) -> pa.Array:
    return pc.or_(pc.match_substring_regex(texts, _SCREEN), pc.match_substring_regex(texts, _SCREEN_HEX))


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, counts by pattern, a digest of the patterns' spans, and all spans."""
    empty = hashlib.sha256(b"").hexdigest()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            counts, digests, spans = [[0] * n for _ in range(3)], [empty] * n, [""] * n
            for i in pc.indices_nonzero(_suspects(batch.column(1))).to_pylist():
                base, every = scan_text(batch.column(1)[i].as_py())
                for _, kind, _ in base:
                    counts[kind][i] += 1
                digests[i], spans[i] = hashlib.sha256(spell(base).encode()).hexdigest(), spell(every)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=[x.split()[0] for x in SCANNED.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(scan, SCANNED)


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The documents with each secret replaced by ``mark`` and n_chars counted again; other rows unchanged."""
    names = docs.columns
    at = names.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pc.fill_null(_suspects(batch.column(at)), False)
            texts = None
            for i in pc.indices_nonzero(found).to_pylist():
                text = batch.column(at)[i].as_py()
                _, spans = scan_text(text)
                if not spans:
                    continue
                texts = texts or batch.column(at).to_pylist()
                out, last = [], 0
                for a, _, b in spans:
                    if a >= last:
                        out += [text[last:a], mark]
                    last = max(last, b)
                texts[i] = "".join([*out, text[last:]])
            if texts is not None:
                columns = list(batch.columns)
                columns[at] = pa.array(texts, batch.column(at).type)
                if "n_chars" in names:
                    k = names.index("n_chars")
                    columns[k] = pc.if_else(pc.is_null(columns[at]), columns[k], pc.utf8_length(columns[at]).cast(columns[k].type))
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield batch

    return docs.mapInArrow(clean, docs.schema)
