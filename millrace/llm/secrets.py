"""Operator 8: secret scan over a trigram inverted index.

Each rule's pattern is turned into a Boolean query over trigrams that any match must contain. A task indexes a block of
documents at once: one pass over their bytes gives, for every trigram that some rule asks for, the posting list of the
documents that have it. A rule's query intersects and unites those lists; only the documents that remain are searched
with the pattern itself. A rule whose pattern demands no trigram is searched in every document.

Rules for odd input: null texts count as empty and have no spans; texts are scanned whole; every row is scanned on its
own, so ties and repeated rows each get their result; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm import common
from millrace.sources.tables import shipped

#: A trigram query: None asks nothing, a string is one trigram, ("and" | "or", parts) combines.
Query = None | str | tuple
#: A class of more letters than this counts as any letter.
MAX_CLASS = 6
MAX_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose group ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The rules in the order that ties of a start go by. The first three are the base rules.
RULES = (
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
BASE = ("assign", "access", "hex")


def both(op: str, parts: Iterable[Query]) -> Query:
    """Combine queries; asking nothing is neutral in an "and" and wins an "or"."""
    parts = list(dict.fromkeys(parts))
    if op == "or" and (None in parts or not parts):
        return None
    parts = [p for p in parts if p is not None]
    if len(parts) < 2:
        return parts[0] if parts else None
    return (op, tuple(sorted(parts, key=repr)))


def trigrams(text: str) -> Query:
    """All trigrams of a string that a match contains."""
    return both("and", (text[i : i + 3] for i in range(len(text) - 2)))


def trigram_query(pattern: str) -> Query:
    """The trigrams, in lower case, that every match of a pattern contains.

    Walks the parsed pattern and keeps the set of strings that the part read so far can end with, as long as that set is
    small; where it gets large, what the strings demand goes into the query and the walk starts anew.
    """
    from re import _parser as parser

    def letters(items) -> set[str] | None:
        found: set[str] = set()
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                found.add(chr(arg).lower())
            elif name == "RANGE" and arg[1] - arg[0] < 2 * MAX_CLASS:
                found |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
            else:
                return None
        return found if len(found) <= MAX_CLASS else None

    def demand(strings: set[str] | None) -> Query:
        return both("or", (trigrams(s) for s in strings)) if strings else None

    def cross(a: set[str], b: set[str]) -> set[str]:
        return {x + y for x in a for y in b}

    def walk(items) -> tuple[set[str] | None, Query]:
        """The exact strings of a sequence, or None and its query."""
        tail: set[str] = {""}
        exact, asked = True, []
        for op, arg in items:
            name, part = str(op), None
            if name == "LITERAL":
                part = {chr(arg).lower()}
            elif name == "IN":
                part = letters(arg)
            elif name == "AT":
                part = {""}
            elif name == "SUBPATTERN":
                part, query = walk(arg[3])
                asked.append(query)
            elif name == "BRANCH":
                found = [walk(b) for b in arg[1]]
                if all(s is not None for s, _ in found):
                    part = set().union(*(s for s, _ in found))
                else:
                    asked.append(both("or", (q if s is None else demand(s) for s, q in found)))
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                low, high, inner = arg
                strings, query = walk(inner)
                if strings is not None and high == 1:
                    part = strings | ({""} if low == 0 else set())
                elif low:
                    once = demand(strings) if strings is not None else query
                    asked.append(once)
            if part is not None and len(tail) * len(part) <= MAX_STRINGS:
                tail = cross(tail, part)
            else:
                asked.append(demand(tail))
                asked.append(demand(part))
                tail, exact = {""}, False
        if exact:
            return tail, None
        return None, both("and", [*asked, demand(tail)])

    strings, query = walk(parser.parse(pattern))
    return demand(strings) if strings is not None else query


def wanted(query: Query) -> set[str]:
    """The trigrams of a query."""
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(wanted, query[1]))


class BlockIndex:
    """Posting lists over one block of texts, of the trigrams that are asked for; letters A-Z count as a-z."""

    def __init__(self, codes: np.ndarray, names: list[str]):
        self.codes, self.names = codes, names
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32

    def postings(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        """Rows with each trigram, ascending."""
        data = self.lower[np.frombuffer(b"\n\n".join(texts), np.uint8)].astype(np.uint32)
        if len(data) < 3:
            return {}
        ids = self.codes[(data[:-2] << 16) | (data[1:-1] << 8) | data[2:]]
        hits = np.flatnonzero(ids)
        starts = np.cumsum([0] + [len(t) + 2 for t in texts[:-1]])
        pairs = np.unique(ids[hits].astype(np.int64) * len(texts) + np.searchsorted(starts, hits, side="right") - 1)
        which, rows = np.divmod(pairs, len(texts))
        cuts = np.searchsorted(which, np.arange(1, len(self.names) + 2))
        return {name: rows[cuts[i] : cuts[i + 1]] for i, name in enumerate(self.names)}


def index_for(queries: Iterable[Query]) -> BlockIndex:
    """An index of the queries' trigrams; a trigram of non-ASCII letters can't be asked for and is left out."""
    names = sorted(t for t in set().union(*map(wanted, queries)) if t.isascii())
    codes = np.zeros(1 << 24, np.uint8 if len(names) < 255 else np.uint16)
    for i, name in enumerate(names):
        a, b, c = name.encode()
        codes[a << 16 | b << 8 | c] = i + 1
    return BlockIndex(codes, names)


def candidates(query: Query, postings: dict[str, np.ndarray], rows: int) -> np.ndarray:
    """The rows that a query leaves."""
    if query is None:
        return np.arange(rows)
    if isinstance(query, str):
        return postings.get(query, np.arange(0)) if query.isascii() else np.arange(rows)
    parts = [candidates(q, postings, rows) for q in query[1]]
    out = parts[0]
    for p in parts[1:]:
        out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
    return out


def scan_block(texts: list[str], rules: tuple[Rule, ...] = RULES, index: BlockIndex | None = None, queries: list[Query] | None = None) -> list[list[tuple[int, int, int]]]:
    """For each text its spans (start, number of the rule, end) in code points, sorted."""
    queries = queries or [trigram_query(r.pattern) for r in rules]
    index = index or index_for(queries)
    postings = index.postings([t.encode() for t in texts])
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for number, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        pattern = re.compile(rule.pattern)
        for row in candidates(query, postings, len(texts)).tolist():
            for m in pattern.finditer(texts[row]):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    out[row].append((m.start(), number, m.end()))
    return [sorted(spans) for spans in out]


@shipped
def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and the array of spans (kind, start, end) of each whole text, by start, then in the rules' order."""
    kinds = [r.kind for r in rules]
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("spans", span)])

    def run(batches):
        queries = [trigram_query(r.pattern) for r in rules]
        index = index_for(queries)
        for b in common.slices(batches):
            found = scan_block(common.texts_of(b), rules, index, queries)
            yield common.to_batch(schema, [b.column("doc_id"), [[{"kind": kinds[k], "start": s, "end": e} for s, k, e in f] for f in found]])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


@shipped
def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of every rule replaced by ``mark`` (overlapping spans by one) and n_chars, if there is one, set anew."""
    names = docs.columns

    def run(batches):
        queries = [trigram_query(r.pattern) for r in rules]
        index = index_for(queries)
        for b in common.slices(batches):
            texts = b.column("text").to_pylist()
            out = []
            for text, spans in zip(texts, scan_block([t or "" for t in texts], rules, index, queries), strict=True):
                parts, at = [], 0
                for s, _, e in spans:
                    if s >= at:
                        parts += [text[at:s], mark]
                    at = max(at, e)
                out.append("".join([*parts, text[at:]]) if spans else text)
            columns = {n: b.column(n) for n in names} | {"text": pa.array(out, b.column("text").type)}
            if "n_chars" in names:
                changed = [len(t) if t is not None and t is not old else n for t, old, n in zip(out, texts, b.column("n_chars").to_pylist(), strict=True)]
                columns["n_chars"] = pa.array(changed, b.column("n_chars").type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return docs.mapInArrow(run, docs.schema)


def digest(scanned: DataFrame) -> DataFrame:
    """The query's columns from the spans: counts by base kind, the base spans' digest, all spans as one string."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches):
        for b in common.slices(batches):
            rows = []
            for spans in b.column("spans").to_pylist():
                shown = [(s["kind"], f"{s['kind']}:{s['start']}:{s['end']}") for s in spans]
                base = ",".join(x for k, x in shown if k in BASE)
                rows.append((*(sum(k == kind for k, _ in shown) for kind in BASE), hashlib.sha256(base.encode()).hexdigest(), ",".join(x for _, x in shown)))
            yield common.to_batch(schema, [b.column("doc_id"), *map(list, zip(*rows, strict=True))])

    return scanned.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
