"""Secret scanning through a trigram inverted index.

For each rule's regular expression a Boolean query over trigrams is derived that
every text with a match satisfies. Texts are indexed in blocks (an Arrow batch
each): a block's postings map each trigram that some query mentions to the texts
that hold it. Evaluating the queries by intersecting and uniting postings leaves
candidates, and only these are verified with the expression. A rule without
mandatory trigrams (long hexadecimal runs, say) scans all texts of the block.

At scale: indexing, querying and verifying happen where a block is read. Nothing
is shuffled, memory is that of a block, and copies cost what other texts cost.

Defined cases: a null text counts as empty and has no spans; spans are counted in
code points, end exclusive; rules find leftmost non-overlapping matches on their
own, so spans of two rules may overlap; null ids and repeated rows are kept.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import arrow_texts, small_batches, text_or_empty

try:  # the parser moved in Python 3.11
    from re import _constants as sre, _parser as sre_parse
except ImportError:  # pragma: no cover
    import sre_constants as sre, sre_parse


@dataclass(frozen=True)
class Rule:
    """kind, expression, and how many characters a match, or one of its groups, must have."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    flags: int = 0
    query: object = field(default=None, compare=False)


ASCII_CASELESS = re.ASCII | re.IGNORECASE

BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, ASCII_CASELESS),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
#: A private key up to its END line; where there is none (before another BEGIN or END), up to the end of its headers and base64 lines.
#: Line ends may be white space, or a backslash and n or r.
PRIVATE_KEY = (
    r"-----BEGIN ((?:[A-Z]+ ){0,3})PRIVATE KEY-----"
    r"(?:[^-]*+(?:-(?!----(?:BEGIN|END) )[^-]*+)*+-----END \1PRIVATE KEY-----"
    r"|(?:\s*(?:Proc-Type|DEK-Info):[^\n]*)*+(?:(?:(?:\s|\\[nr])*+[A-Za-z0-9+/]{16,}+={0,2})++(?:(?:\s|\\[nr])++(?:[A-Za-z0-9+/]{1,15}={1,2}|[A-Za-z0-9+/]{2,15}(?=[\x20\t\r]*(?:\n|\Z))))?)?)"
)
#: Public formats of credentials beyond the base kinds. None has a greatest length, and none goes back over what it took.
EXTRA_RULES = (
    Rule("private_key", PRIVATE_KEY),
    Rule("forge_token", r"\bgh[pousr]_[A-Za-z0-9]{36,}+", 0, 0, re.ASCII),
    Rule("chat_token", r"\bxox[abprs]-[A-Za-z0-9-]{10,}+", 0, 0, re.ASCII),
    Rule("cloud_key", r"\bAIza[0-9A-Za-z_-]{35,}+", 0, 0, re.ASCII),
    Rule("payment_key", r"\b[sr]k_(?:live|test)_[0-9A-Za-z]{16,}+", 0, 0, re.ASCII),
    Rule("web_token", r"\beyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+", 0, 0, re.ASCII),
    Rule("url_login", r"(?:(?<![A-Za-z0-9+.-])[A-Za-z0-9+.-]++)?://[^\s/:@]++:[^\s/:@]{3,}+@", 0, 0, re.ASCII),
)
RULES = BASE_RULES + EXTRA_RULES

# --- from an expression to a Boolean query over trigrams ---------------------------------
# A query is ALL (no condition), or ("and", frozenset of queries), ("or", frozenset of queries), or a trigram in bytes.

ALL = True
#: An expression's set of possible strings is spelled out only up to this size.
MOST_STRINGS = 64


def q_and(a, b):
    if a is ALL:
        return b
    if b is ALL or a == b:
        return a
    parts = set()
    for q in (a, b):
        parts |= q[1] if isinstance(q, tuple) and q[0] == "and" else {q}
    return ("and", frozenset(parts))


def q_or(a, b):
    if a is ALL or b is ALL:
        return ALL
    if a == b:
        return a
    parts = set()
    for q in (a, b):
        parts |= q[1] if isinstance(q, tuple) and q[0] == "or" else {q}
    return ("or", frozenset(parts))


def _of_string(s: bytes):
    q = ALL
    for i in range(len(s) - 2):
        q = q_and(q, s[i : i + 3])
    return q


def _of_strings(strings: frozenset[bytes]):
    """Every one of these strings may be the one that occurs."""
    found = [_of_string(s) for s in strings]
    q = found[0] if found else ALL
    for x in found[1:]:
        q = q_or(q, x)
    return q


@dataclass
class _Info:
    """What is known of a part of an expression: all strings it can match, if few, and a query that each match satisfies."""

    exact: frozenset[bytes] | None
    match: object = ALL

    def flushed(self):
        return self.match if self.exact is None else q_and(self.match, _of_strings(self.exact))


def _fold(c: int) -> bytes:
    return chr(c).encode().lower()


def _info(nodes) -> _Info:
    """Of a sequence: neighbouring exact parts are multiplied out, others contribute their own queries."""
    match, run = ALL, frozenset([b""])
    whole = True
    for op, arg in nodes:
        part = _node(op, arg)
        if part.exact is not None and len(part.exact) * len(run) <= MOST_STRINGS:
            match = q_and(match, part.match)
            run = frozenset(a + b for a in run for b in part.exact)
            continue
        match, whole = q_and(match, _of_strings(run)), False
        if part.exact is not None:
            run, match = part.exact, q_and(match, part.match)
        else:
            run, match = frozenset([b""]), q_and(match, part.match)
    return _Info(run, match) if whole else _Info(None, q_and(match, _of_strings(run)))


def _node(op, arg) -> _Info:
    if op is sre.LITERAL:
        return _Info(frozenset([_fold(arg)]))
    if op is sre.IN:
        chars = [a for o, a in arg if o is sre.LITERAL]
        if len(chars) == len(arg) and len(chars) <= 8:
            return _Info(frozenset(map(_fold, chars)))
        return _Info(None)
    if op is sre.SUBPATTERN:
        return _info(arg[3])
    if op is sre.BRANCH:
        parts = [_info(x) for x in arg[1]]
        if all(p.exact is not None and p.match is ALL for p in parts) and sum(len(p.exact) for p in parts) <= MOST_STRINGS:
            return _Info(frozenset().union(*(p.exact for p in parts)))
        q = parts[0].flushed()
        for p in parts[1:]:
            q = q_or(q, p.flushed())
        return _Info(None, q)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT, getattr(sre, "POSSESSIVE_REPEAT", None)):
        low, high, body = arg
        inner = _info(body)
        if inner.exact is not None and inner.match is ALL and high is not sre.MAXREPEAT and high <= 3:
            strings, power = set(), frozenset([b""])
            for n in range(int(high) + 1):
                if n >= low:
                    strings |= power
                power = frozenset(a + b for a in power for b in inner.exact)
                if len(power) > MOST_STRINGS:
                    break
            else:
                if len(strings) <= MOST_STRINGS:
                    return _Info(frozenset(strings))
        return _Info(None, inner.flushed() if low >= 1 else ALL)
    if op is sre.AT:  # anchors and word boundaries take no room
        return _Info(frozenset([b""]))
    return _Info(None)  # classes, references, look-arounds: nothing is claimed


def trigram_query(pattern: str, flags: int = 0):
    """A condition on the lower-cased (A-Z) trigrams of a text's UTF-8 bytes that every match implies."""
    if flags & re.IGNORECASE and not flags & re.ASCII:
        return ALL  # other letters may match then
    return _info(sre_parse.parse(pattern, flags)).flushed()


def trigrams_of(query) -> set[bytes]:
    if query is ALL:
        return set()
    if isinstance(query, bytes):
        return {query}
    return set().union(*(trigrams_of(q) for q in query[1]))


# --- a block's index ----------------------------------------------------------------------

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


class BlockIndex:
    """Postings of the wanted trigrams over the texts of a block."""

    def __init__(self, texts: Sequence[bytes], wanted: dict[bytes, int], table: np.ndarray, piece: int = 1 << 19):
        self.n = len(texts)
        hits: list[np.ndarray] = []
        joined = np.frombuffer(b"\x00\x00".join(texts) + b"\x00\x00", dtype=np.uint8)
        ends = np.cumsum(np.fromiter((len(t) + 2 for t in texts), dtype=np.int64, count=self.n))
        for a in range(0, max(0, len(joined) - 2), piece):
            part = _FOLD[joined[a : a + piece + 2]].astype(np.uint32)
            codes = (part[:-2] << 16) | (part[1:-1] << 8) | part[2:]
            found = table[codes]
            at = np.nonzero(found)[0]
            hits.append(np.unique((found[at].astype(np.int64) << 40) | np.searchsorted(ends, at + a, side="right")))
        both = np.unique(np.concatenate(hits)) if hits else np.empty(0, np.int64)
        gram, doc = both >> 40, both & ((1 << 40) - 1)
        cuts = np.searchsorted(gram, np.arange(1, len(wanted) + 2))
        self.postings = {t: doc[cuts[k - 1] : cuts[k]] for t, k in wanted.items()}

    def candidates(self, query) -> np.ndarray:
        if query is ALL:
            return np.arange(self.n)
        if isinstance(query, bytes):
            return self.postings[query]
        found = sorted((self.candidates(q) for q in query[1]), key=len)
        out = found[0]
        for x in found[1:]:
            out = np.intersect1d(out, x, assume_unique=True) if query[0] == "and" else np.union1d(out, x)
        return out


class Scanner:
    def __init__(self, rules: Sequence[Rule] = RULES):
        self.rules = [(r, re.compile(r.pattern, r.flags), trigram_query(r.pattern, r.flags)) for r in rules]
        grams = sorted(set().union(*(trigrams_of(q) for _, _, q in self.rules)))
        self.wanted = {t: i + 1 for i, t in enumerate(grams)}
        if len(grams) > 65_000:
            raise ValueError("too many trigrams for one scanner: split the rules")
        self.table = np.zeros(1 << 24, dtype=np.uint16)
        for t, i in self.wanted.items():
            self.table[(t[0] << 16) | (t[1] << 8) | t[2]] = i

    def scan(self, texts: Sequence[str]) -> list[list[tuple[int, int, int]]]:
        """For each text its spans (start, rule's place in the list, end), sorted."""
        index = BlockIndex([t.encode("utf-8", "surrogatepass") for t in texts], self.wanted, self.table)
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (rule, expression, query) in enumerate(self.rules):
            for i in index.candidates(query).tolist():
                for m in expression.finditer(texts[i]):
                    start, end = m.span(rule.group)
                    if end - start >= rule.least:
                        out[i].append((m.start(), k, m.end()))
        for spans in out:
            spans.sort()
        return out


def find_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id and secrets: array of (kind, start, end), by start, then by the rules' order."""
    rules = tuple(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in small_batches(batches, 1):
            spans = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in found] for found in scanner.scan(arrow_texts(batch, 1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, shape)], names=["doc_id", "secrets"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, "doc_id long, secrets array<struct<kind:string,start:long,end:long>>")


def _per_text(docs: DataFrame, rules: tuple[Rule, ...], schema: str, change: Callable[[str, list], str]) -> DataFrame:
    where = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in small_batches(batches, where):
            texts = batch.column(where).to_pylist()
            found = scanner.scan([t or "" for t in texts])
            new = [t if t is None or not s else change(t, s) for t, s in zip(texts, found)]
            columns = [pa.array(new, pa.string()) if i == where else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, schema)


def redact(docs: DataFrame, rules: Sequence[Rule] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns; each maximal stretch of overlapping spans becomes ``mark``, and n_chars, if there, follows the text."""

    def change(text: str, spans: list[tuple[int, int, int]]) -> str:
        out, at = [], 0
        merged: list[list[int]] = []
        for a, _, b in spans:
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        for a, b in merged:
            out += [text[at:a], mark]
            at = b
        return "".join(out) + text[at:]

    out = _per_text(docs, tuple(rules), docs.schema, change)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
    return out


def secrets_report(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Counts and digests of what ``find_secrets`` finds, a row for each document."""
    found = find_secrets(docs, rules)
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("secrets", lambda s: s["kind"].isin([r.kind for r in BASE_RULES]))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(r.kind) for r in BASE_RULES), F.sha2(F.encode(said(base), "UTF-8"), 256).alias("base_sha256"), said(F.col("secrets")).alias("spans"))
