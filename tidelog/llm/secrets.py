"""Secret scans with multipart credential linking.

Base spans (fixed patterns): assignments of a value to a secret-like name, access identifiers, long hex runs. The linker adds
weak candidates: names of accounts, opaque mixed-case tokens and endpoints mean nothing alone, so each is reported only if
the parts that complete it lie within its scope (the interval of `scope` code points around it). Parts are kept as sorted
intervals per class and joined by bisection, so a text of n parts takes O(n log n); no pattern starts twice in one run of letters.

    weak token    needs an identifier (access or account)
    account name  needs a secret that is not weak itself, or a weak token and an endpoint
    endpoint      needs an identifier and a secret

A secret never overlaps the identifier that it completes: an access identifier that is the value of an assignment is one part, not two.

Defined results: a null text is an empty one and has no spans; offsets are code points, ends exclusive; repeated rows and equal
ids are scanned row by row; an empty table gives an empty result. Whole texts are scanned.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.textops import streamed

#: The kinds in their order.
KINDS = ("assign", "access", "hex", "token", "account", "endpoint")
#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: The weak parts.
OPAQUE = re.compile(r"[A-Za-z0-9+/_-]{20,}")
ACCOUNT = re.compile(r"""(?:access_?key(?:_?id)?|client_?id|user(?:_?name)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@+-]{3,}""", re.IGNORECASE | re.ASCII)
URL = re.compile(r"""(?<![A-Za-z0-9+.-])[0-9+.-]*+([A-Za-z][A-Za-z0-9+.-]*+://[^\s"'<>]++)""", re.ASCII)
ADDRESS = re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?::\d++)?(?![\d.])", re.ASCII)

Span = tuple[int, int]


class Intervals:
    """Sorted, disjoint intervals that answer which of them lie within the scope of another one, apart from it."""

    def __init__(self, spans: list[Span], scope: int):
        self.spans, self.scope = sorted(spans), scope
        self.starts, self.ends = [s for s, _ in self.spans], [e for _, e in self.spans]

    def near(self, span: Span) -> Span | None:
        """The nearest one that does not overlap the span; of two as near the earlier."""
        left, right = bisect_right(self.ends, span[0]) - 1, bisect_left(self.starts, span[1])
        found = [self.spans[i] for i in (left, right) if 0 <= i < len(self.spans)]
        found = [x for x in found if x[0] < span[1] + self.scope and x[1] > span[0] - self.scope]
        return min(found, key=lambda x: max(x[0] - span[1], span[0] - x[1]), default=None)

    def ends_of(self, span: Span) -> set[Span]:
        """The first and the last one in the scope, overlapping ones included."""
        lo, hi = bisect_right(self.ends, span[0] - self.scope), bisect_left(self.starts, span[1] + self.scope)
        return {self.spans[lo], self.spans[hi - 1]} if lo < hi else set()


def _complete(span: Span, ids: Intervals, secrets: tuple[Intervals, ...]) -> bool:
    """Whether an identifier and a secret that do not overlap are in the scope: if the outermost ones of disjoint intervals all overlap, so do those between."""
    return any(a[1] <= b[0] or b[1] <= a[0] for s in secrets for a in ids.ends_of(span) for b in s.ends_of(span))


def _mixed(word: str) -> bool:
    return not (word.isalpha() or word.islower() or word.isupper()) and any(map(str.isdigit, word)) and any(map(str.islower, word)) and any(map(str.isupper, word))


def _apart(spans: list[Span], taken: list[Span]) -> list[Span]:
    """Those of the sorted spans that overlap none of the taken ones."""
    taken, out, i = sorted(taken), [], 0
    for s, e in sorted(spans):
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        if not any(t[0] < e and t[1] > s for t in taken[i : i + 2]):
            out.append((s, e))
    return out


def find(text: str, scope: int = 200) -> tuple[dict[str, list[Span]], list[tuple[Span, Span, Span | None]]]:
    """Spans of each kind, and credentials: (identifier, secret, endpoint if any)."""
    named = "=" in text or ":" in text
    assign = [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if named else []
    access = [m.span() for m in ACCESS.finditer(text)]
    runs = [m.span() for m in OPAQUE.finditer(text)]
    hexes = [m.span() for m in HEX.finditer(text)] if runs else []
    out: dict[str, list[Span]] = {"assign": assign, "access": access, "hex": hexes}
    base = [*assign, *access, *hexes]
    tokens = _apart([x for x in runs if _mixed(text[x[0] : x[1]])], base)
    if not base and not tokens:
        return out, []
    accounts = _apart([m.span() for m in ACCOUNT.finditer(text)], [*base, *tokens]) if named else []
    urls = [m.span(1) for m in URL.finditer(text)] if "://" in text else []
    endpoints = _apart([*urls, *_apart([m.span() for m in ADDRESS.finditer(text)], urls)], [*base, *tokens, *accounts])
    strong_ids, all_ids = Intervals(access, scope), Intervals([*access, *accounts], scope)
    strong = Intervals(_merged([*assign, *hexes]), scope)
    weak, places = Intervals(tokens, scope), Intervals(endpoints, scope)
    secret = lambda x: strong.near(x) or weak.near(x)
    out["token"] = [x for x in tokens if strong_ids.near(x) or all_ids.near(x)]
    out["account"] = [x for x in accounts if strong.near(x) or (weak.near(x) and places.near(x))]
    out["endpoint"] = [x for x in endpoints if _complete(x, all_ids, (strong, weak))]
    linked = [(x, s, places.near(x)) for x in [*access, *out["account"]] if (s := secret(x))]
    return out, sorted(linked, key=lambda x: x[0])


def _merged(spans: list[Span]) -> list[Span]:
    out: list[Span] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def listed(spans: dict[str, list[Span]], kinds: tuple[str, ...] = KINDS) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind in its order, then end."""
    rank = {k: i for i, k in enumerate(KINDS)}
    return sorted(((k, s, e) for k in kinds for s, e in spans.get(k, [])), key=lambda x: (x[1], rank[x[0]], x[2]))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_LINK = pa.struct([(n, pa.int64()) for n in ("id_start", "id_end", "secret_start", "secret_end", "endpoint_start", "endpoint_end")])
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans array<struct<kind:string,start:long,end:long>>, credentials array<struct<id_start:long,id_end:long,secret_start:long,secret_end:long,endpoint_start:long,endpoint_end:long>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 200) -> DataFrame:
    """One row per document: counts of base spans, their digest, all spans, linked credentials."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                yield _scanned(part, scope)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(streamed(run), SCHEMA)


def _scanned(part: pa.RecordBatch, scope: int) -> pa.RecordBatch:
    counts, digests, spans, links = [], [], [], []
    for text in part.column(1).to_pylist():
        kinds, found = find(text or "", scope)
        counts.append([len(kinds[k]) for k in KINDS[:3]])
        digests.append(hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in listed(kinds, KINDS[:3])).encode()).hexdigest())
        spans.append([{"kind": k, "start": s, "end": e} for k, s, e in listed(kinds)])
        links.append([dict(zip(("id_start", "id_end", "secret_start", "secret_end", "endpoint_start", "endpoint_end"), (*a, *b, *(c or (None, None))), strict=True)) for a, b, c in found])
    columns = [part.column(0), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(3)), pa.array(digests, pa.string()), pa.array(spans, pa.list_(_SPAN)), pa.array(links, pa.list_(_LINK))]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "credentials"])


def joined(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact_text(text: str, mark: str = "[secret]", scope: int = 200) -> str:
    """The text with every reported span but endpoints replaced by the mark."""
    kinds, _ = find(text, scope)
    spans = _merged([x for k in KINDS if k != "endpoint" for x in kinds.get(k, [])])
    if not spans:
        return text
    out, at = [], 0
    for s, e in spans:
        out += [text[at:s], mark]
        at = e
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", chars_col: str | None = None, mark: str = "[secret]", scope: int = 200) -> DataFrame:
    """All rows and columns, the secrets in text_col masked (and chars_col, if named, set to the new length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                at = part.schema.get_field_index(text_col)
                texts = [None if t is None else redact_text(t, mark, scope) for t in part.column(at).to_pylist()]
                part = part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))
                if chars_col:
                    c = part.schema.get_field_index(chars_col)
                    kept = [n if t is None else len(t) for t, n in zip(texts, part.column(c).to_pylist(), strict=True)]
                    part = part.set_column(c, part.schema.field(c), pa.array(kept, part.schema.field(c).type))
                yield part

    return docs.mapInArrow(streamed(run), docs.schema)
