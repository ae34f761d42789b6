"""Column functions on text: claims, tokens, similarity, markup."""

from __future__ import annotations

import re
from hashlib import sha256
from html import escape

import pyarrow as pa
from pyspark.sql import Column, functions as F

# Where a response is cut into claims.
CONJUNCTIONS = ("and", "but", "however", "although", "though", "while", "whereas", "because", "so", "yet", "or", "nor")
TOKEN = r"[A-Za-z0-9]+(?:'[A-Za-z0-9]+)?"  # apostrophes inside a word stay
# White space as Unicode has it.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# The look-ahead only passes over places where none of the four can begin.
CLAIM_CUT = re.compile(rf"(?i)(?=[{SPACE};:\-—])(?:(?<=[.!?])[{SPACE}]+|[{SPACE}]*[;:][{SPACE}]*|[{SPACE}]+(?:{'|'.join(CONJUNCTIONS)})[{SPACE}]+|[{SPACE}]*(?:--|—)[{SPACE}]*)")
TEXTS = 256  # whose claims are held as Python's objects at once
PLAIN_TOKEN = r"[a-z0-9]+"
# The colours of labels.
LABEL_COLOURS = {"supported": "#d7f5e8", "contradicted": "#ffe0e0", "unknown": "#fff0ce"}
OTHER_COLOUR = "#e8eef5"


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(text, F.lit(SPACE))


def is_blank(text: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return F.coalesce(strip(text) == "", F.lit(True))


def claims(text: Column) -> Column:
    """The claims of a response, in order, as structs of text and half-open code-point offsets.

    Parts are found again from where the one before ended, so the offsets are
    those of a forward search.  A text is passed over once: Spark's ``locate``
    counts code points from the text's beginning for every part.
    """
    return F.arrow_udf(_claims, "array<struct<claim_text:string,claim_start:int,claim_end:int>>")(text)


_CLAIM = pa.struct([("claim_text", pa.string()), ("claim_start", pa.int32()), ("claim_end", pa.int32())])


def _cut(texts: list[bytes | None]) -> pa.Array:
    words, starts, ends, edges = [], [], [], [0]
    for raw in texts:
        text, at = raw.decode("utf-8", "replace") if raw is not None else "", 0
        for part in CLAIM_CUT.split(text):
            if part := part.strip(SPACE):
                start = text.find(part, at)
                at = start + len(part)
                words.append(part)
                starts.append(start)
                ends.append(at)
        edges.append(len(words))
    values = pa.StructArray.from_arrays([pa.array(words, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], fields=list(_CLAIM))
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), values, type=pa.list_(_CLAIM), mask=pa.array([raw is None for raw in texts]))


def _claims(text: pa.Array) -> pa.Array:
    raw = text.cast(pa.large_binary())
    parts = [_cut(raw.slice(k, TEXTS).to_pylist()) for k in range(0, len(raw), TEXTS)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(_CLAIM))


def tokens(text: Column) -> Column:
    """Lower-case word tokens, apostrophes kept inside."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower)  # of ASCII alone: no other letter becomes one


def plain_tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(PLAIN_TOKEN), F.lit(0))


def jaccard(left: Column, right: Column) -> Column:
    """Share of two token arrays' distinct tokens that both have; 0 if either is empty."""
    both = F.size(F.array_intersect(left, right))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), 0.0).otherwise(both / F.size(F.array_union(left, right)))


def escape_html(text: Column) -> Column:
    """``& < > " '`` as character references."""
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def three(x: Column) -> Column:
    """A number below 1000 with three decimals, rounded half-even on the binary value."""
    return F.format_number(x, 3)


def two(x: Column) -> Column:
    return F.format_number(x, 2)


def percent(x: Column) -> Column:
    """One decimal and a percent sign, or a dash for null."""
    return F.coalesce(F.concat(F.format_number(x * 100, 1), F.lit("%")), F.lit("—"))


def span(text: Column, start: Column, end: Column) -> Column:
    """The code points from ``start`` to ``end``."""
    return F.substring(text, start + 1, end - start)


def highlight(text: Column, claim: Column, start: Column, end: Column, label: Column) -> Column:
    """The response with one claim marked, or null where the span is not the claim's."""
    colour = F.coalesce(*(F.when(label == k, v) for k, v in LABEL_COLOURS.items()), F.lit(OTHER_COLOUR))
    valid = (start >= 0) & (start < end) & (end <= F.length(text)) & (span(text, start, end) == claim)
    return F.when(
        valid,
        F.concat(
            escape_html(span(text, F.lit(0), start)), F.lit('<mark style="background:'), colour, F.lit(';padding:.12rem .22rem;border-radius:.25rem">'),
            escape_html(span(text, start, end)), F.lit("</mark>"), escape_html(span(text, end, F.length(text))),
        ),
    )


def highlight_digests(text: Column, claims: Column) -> Column:
    """Of each claim of a response its id and the SHA-256 of :func:`highlight`'s UTF-8, which is not made.

    ``claims`` are structs of ``claim_id, claim_text, claim_start, claim_end,
    label``.  The response is escaped once and what stands before a claim is
    hashed once for all; only what follows it is hashed for each.
    """
    return F.arrow_udf(_digests, "array<struct<claim_id:string,html_sha256:string>>")(text, claims)


def _digests(text: pa.Array, claims: pa.Array) -> pa.Array:
    ids, found, edges = [], [], [0]
    for whole, line in zip(text, claims):  # one response at a time
        own = line.as_py()
        ids += (c["claim_id"] for c in own)
        found += digests(whole.as_py(), own)
        edges.append(len(ids))
    values = pa.StructArray.from_arrays([pa.array(ids, pa.string()), pa.array(found, pa.string())], names=["claim_id", "html_sha256"])
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), values)


def digests(text: str, claims: list[dict]) -> list[str | None]:
    """The digests of a response's claims, in their order; null where a span is not the claim's."""
    out: list[str | None] = [None] * len(claims)
    valid = [k for k, c in enumerate(claims) if 0 <= c["claim_start"] < c["claim_end"] <= len(text) and text[c["claim_start"] : c["claim_end"]] == c["claim_text"]]
    edges = sorted({0, len(text), *(claims[k][e] for k in valid for e in ("claim_start", "claim_end"))})
    pieces = [escape(text[a:b]).encode() for a, b in zip(edges, edges[1:])]
    at, total = {0: 0}, 0  # where each edge lies in the escaped bytes
    for edge, piece in zip(edges[1:], pieces):
        total += len(piece)
        at[edge] = total
    html, before, done = memoryview(b"".join(pieces)), sha256(), 0
    for k in sorted(valid, key=lambda k: claims[k]["claim_start"]):
        start, end = at[claims[k]["claim_start"]], at[claims[k]["claim_end"]]
        before.update(html[done:start])
        done, own = start, before.copy()
        own.update(f'<mark style="background:{LABEL_COLOURS.get(claims[k]["label"], OTHER_COLOUR)};padding:.12rem .22rem;border-radius:.25rem">'.encode())
        own.update(html[start:end])
        own.update(b"</mark>")
        own.update(html[end:])
        out[k] = own.hexdigest()
    return out
