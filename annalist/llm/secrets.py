"""Secret scans with a recursive decoding worklist.

A text is scanned, then every encoded region in it (percent escapes, Unicode and hex escapes, base64 of UTF-8 or UTF-16,
and gzip, zlib or bzip2 data inside base64, wrapped or not) is unwrapped into a new layer, which is scanned and searched for regions in turn, until no new
layer appears. The finds of a layer are remembered by its content and mapped to every place where it occurs; a layer
inside itself is not unwrapped again, which ends cycles. Each character of a layer carries the span of the text around it
that it came from, so finds map back to original offsets.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm.common import map_arrow, table

KINDS = ("assign", "access", "hex")
#: A compressed layer of more than twice so many bytes is scanned in pieces that overlap by so many; plain text is scanned whole.
PIECE = 1 << 24

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
# A text without any of these holds no assignment.
_ASSIGN_CUES = re.compile(r"passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)
# Regions of percent escapes and of others: an escape, what may stand between escapes, and the region from its first escape on.
_PERCENT = re.compile(r"%[0-9A-Fa-f]{2}")
_PERCENT_PLAIN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._~+/=:&?@!$'()*,;-")
_PERCENT_REGION = re.compile(r"(?:%[0-9A-Fa-f]{2}[A-Za-z0-9._~+/=:&?@!$'()*,;-]*+)+")
_ESCAPE_PLAIN = frozenset(map(chr, range(0x21, 0x7F))) - {"\\"}
_ESCAPE_REGION = re.compile(r"(?:(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\U000[0-9A-Fa-f]{5}|&#[0-9]{2,6};|&#x[0-9A-Fa-f]{2,6};)[\x21-\x5b\x5d-\x7e]*+)+")
_ESCAPE = re.compile(r"\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|\\U000([0-9A-Fa-f]{5})|&#([0-9]{2,6});|&#x([0-9A-Fa-f]{2,6});")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]{16,}+)*(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]++)?")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+")
#: How base64 of gzip, zlib and bzip2 data begins.
_PACKED = ("H4s", "eAF", "eAE", "eF4", "eF5", "eJw", "eJx", "eJy", "eJz", "eNo", "eNp", "eNq", "eNr", "Qlpo")
_PACKED_AT = re.compile("(?=" + "|".join(_PACKED) + ")")
_UNDECODED = re.compile("[\udc80-\udcff]")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the plain patterns, leftmost and non-overlapping for each kind."""
    found = []
    if _ASSIGN_CUES.search(text):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m.group(1)) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return found


def _unpack(raw: bytes) -> Iterator[bytes]:
    """The content of gzip, zlib or bzip2 data, member after member, in parts of at most PIECE bytes; up to any damage."""
    while raw:
        if raw[:2] == b"\x1f\x8b" or (raw[:1] == b"\x78" and raw[1:2] in (b"\x01", b"\x5e", b"\x9c", b"\xda")):
            pack = zlib.decompressobj(wbits=47)
        elif raw[:3] == b"BZh":
            pack = bz2.BZ2Decompressor()
        else:
            return
        fed = raw
        try:
            while not pack.eof:
                out = pack.decompress(fed, PIECE)
                fed = getattr(pack, "unconsumed_tail", b"")
                if out:
                    yield out
                elif not fed and not pack.eof:  # it ends before its end
                    return
        except (zlib.error, OSError, ValueError):
            return
        raw = pack.unused_data


def _pieces(parts: Iterator[bytes]) -> Iterator[bytes]:
    """The parts put together, in pieces of two PIECEs, each beginning with the last PIECE of the one before it."""
    held, fresh = bytearray(), False
    for part in parts:
        held += part
        fresh = True
        if len(held) >= 2 * PIECE:
            yield bytes(held)
            del held[:-PIECE]
            fresh = False
    if fresh:
        yield bytes(held)


class _Whole:
    """The same span for every character."""

    def __init__(self, span: tuple[int, int]):
        self.span = span

    def __getitem__(self, i: int) -> tuple[int, int]:
        return self.span


def _layers_of_bytes(raw: bytes, spans: list[tuple[int, int]] | _Whole) -> Iterator[tuple[str, list[tuple[int, int]] | _Whole]]:
    """UTF-8 text, a replacement for each byte that is none, with the source span of each character; and UTF-16 if there are zeros as in it.

    spans: one for each byte.
    """
    text = raw.decode("utf-8", "surrogateescape")
    of = spans
    if not isinstance(spans, _Whole) and len(text) != len(raw):
        of, at = [], 0
        for c in text:
            n = len(c.encode("utf-8", "surrogateescape"))
            of.append((spans[at][0], spans[at + n - 1][1]))
            at += n
    yield _UNDECODED.sub("\ufffd", text), of
    zeros = raw.count(0)
    if len(raw) >= 8 and 4 * zeros >= len(raw):
        first = int(2 * raw[::2].count(0) > zeros)  # each zero with the letter before it, whichever of the two is high
        pairs = raw[first : first + (len(raw) - first) // 2 * 2]
        wide = pairs.decode("utf-16-le", "replace")
        if 2 * len(wide) == len(pairs):  # no letters of two pairs, so offsets are plain
            yield wide, spans if isinstance(spans, _Whole) else [(spans[first + 2 * i][0], spans[first + 2 * i + 1][1]) for i in range(len(wide))]


def _regions(text: str, escape: re.Pattern, plain: frozenset, region: re.Pattern) -> Iterator[tuple[int, int]]:
    """Runs around escapes, found from the escapes outwards, so that time is linear in the text."""
    at = 0
    while m := escape.search(text, at):
        start = m.start()
        while start > at and text[start - 1] in plain:
            start -= 1
        at = region.match(text, m.start()).end()
        yield start, at


def _wrapped(text: str) -> Iterator[list[tuple[int, int]]]:
    """Lines (start, end) of base64 that is wrapped: lines of one length, the first perhaps cut by what is before it, and a shorter last one."""
    for block in _WRAPPED.finditer(text):
        lines = [m.span() for m in _LINE.finditer(text, block.start(), block.end())]
        sizes = [b - a for a, b in lines]
        n = len(lines)
        for k in range(n - 1):
            if k and sizes[k] == sizes[k - 1] and not text.startswith(_PACKED, lines[k][0]):
                continue
            j = k + 1
            while j < n and sizes[j] == sizes[k + 1] >= sizes[k]:
                j += 1
            if j < n and sizes[j] < sizes[j - 1]:
                j += 1
            if j > k + 1:
                yield lines[k:j]


def _of_base64(body: str, at, place) -> Iterator[tuple[str, list[tuple[int, int]] | _Whole]]:
    """Layers of base64 without padding; at[i]: where its character i is in the text."""
    try:
        raw = base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return
    parts = _unpack(raw)
    if (first := next(parts, None)) is not None:
        whole = _Whole((place(at[0])[0], place(at[-1])[1]))
        for piece in _pieces(chain([first], parts)):
            yield from _layers_of_bytes(piece, whole)
    else:
        yield from _layers_of_bytes(raw, [(place(at[i * 4 // 3])[0], place(at[min(len(body) - 1, (i * 4 + 7) // 3)])[1]) for i in range(len(raw))])


def _of_run(body: str, at, place) -> Iterator[tuple[str, list[tuple[int, int]] | _Whole]]:
    """Layers of a run of base64 characters, which may begin before what is encoded, as in a path: at each quarter, and where packed data begins."""
    starts = set(range(min(4, len(body)))) if any(map(body.__contains__, "/-_+")) else {0}
    starts.update(m.start() for m in _PACKED_AT.finditer(body))
    for i in sorted(starts):
        rest = len(body) - i
        if rest >= 8:
            yield from _of_base64(body[i : len(body) - (rest % 4 == 1)], at[i:], place)


def _decoded(text: str, place) -> Iterator[tuple[str, list[tuple[int, int]] | _Whole]]:
    """Layers unwrapped from the regions of a text; place(i): the original span of its character i."""
    if "%" in text:
        for start, end in _regions(text, _PERCENT, _PERCENT_PLAIN, _PERCENT_REGION):
            raw, spans, i = bytearray(), [], start
            while i < end:
                if text[i] == "%":
                    raw.append(int(text[i + 1 : i + 3], 16))
                    spans.append((place(i)[0], place(i + 2)[1]))
                    i += 3
                else:
                    raw += text[i].encode()
                    spans.append(place(i))
                    i += 1
            yield from _layers_of_bytes(bytes(raw), spans)
    if "\\" in text or "&#" in text:
        for start, end in _regions(text, _ESCAPE, _ESCAPE_PLAIN, _ESCAPE_REGION):
            out, spans, i = [], [], start
            for e in _ESCAPE.finditer(text, start, end):
                for j in range(i, e.start()):
                    out.append(text[j])
                    spans.append(place(j))
                u, x, wide, dec, hexa = e.groups()
                code = int(dec) if dec else int(u or x or wide or hexa, 16)
                if code < 0x110000 and not 0xD800 <= code < 0xE000:
                    out.append(chr(code))
                    spans.append((place(e.start())[0], place(e.end() - 1)[1]))
                i = e.end()
            for j in range(i, end):
                out.append(text[j])
                spans.append(place(j))
            yield "".join(out), spans
    for m in _BASE64.finditer(text):
        body = m.group().rstrip("=")
        if body.isalpha() and (body.islower() or body[1:].islower()):  # a long word
            continue
        yield from _of_run(body, range(m.start(), m.end()), place)
    if "\n" in text:
        for lines in _wrapped(text):
            at = [i for a, b in lines for i in range(a, b)]
            body = "".join(text[a:b] for a, b in lines)
            yield from _of_base64(body[: len(body) - (len(body) % 4 == 1)], at, place)


def _key(layer: str) -> str | bytes:
    return layer if len(layer) < 4096 else hashlib.blake2b(layer.encode("utf-8", "surrogatepass"), digest_size=32).digest()


class _Open:
    """A layer being unwrapped: its key, the layers in it yet to be taken, its finds in its own offsets, and the outermost layer at which a cycle was cut."""

    def __init__(self, layer: str, depth: int):
        self.layer, self.key, self.depth, self.cut = layer, _key(layer), depth, depth
        self.inner = _decoded(layer, lambda i: (i, i + 1))
        self.found = set(base_spans(layer))
        self.spans: list[tuple[int, int]] | _Whole = []  # of the inner layer at work

    def add(self, found: set[tuple[str, int, int]]) -> None:
        self.found.update((k, self.spans[a][0], self.spans[b - 1][1]) for k, a, b in found)


def all_spans(text: str) -> list[tuple[str, int, int]]:
    """Plain finds and those of decoded layers, in original offsets, by start and kind, each once."""
    known: dict[str | bytes, set[tuple[str, int, int]]] = {}  # finds of a layer in its own offsets, for each place it occurs at
    stack = [_Open(text, 0)]
    opened = {stack[0].key: 0}
    while True:
        top = stack[-1]
        inner, top.spans = next(top.inner, (None, []))
        if inner is None:
            stack.pop()
            del opened[top.key]
            if top.cut >= top.depth:  # not cut short by a layer around it
                known[top.key] = top.found
            if not stack:
                return sorted(top.found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
            stack[-1].add(top.found)
            stack[-1].cut = min(stack[-1].cut, top.cut)
        elif inner != top.layer:
            key = _key(inner)
            if key in known:
                top.add(known[key])
            elif key in opened:  # a cycle: its own finds, not unwrapped again
                top.add(set(base_spans(inner)))
                top.cut = min(top.cut, opened[key])
            else:
                stack.append(_Open(inner, len(stack)))
                opened[key] = len(stack) - 1


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, base, found: arrays of (kind, start, end), plain finds and all finds, by start and kind.

    docs: doc_id, text. A null text is empty; a text without finds gives empty arrays; repeated rows stay.
    """

    def run(part: dict) -> dict:
        base, found = [], []
        for text in part["text"]:
            text = text or ""
            order = sorted(base_spans(text), key=lambda x: (x[1], KINDS.index(x[0])))
            base.append([{"kind": k, "start": a, "end": b} for k, a, b in order])
            found.append([{"kind": k, "start": a, "end": b} for k, a, b in all_spans(text)])
        return {"doc_id": part["doc_id"], "base": base, "found": found}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    span = "array<struct<kind:string,start:long,end:long>>"
    return map_arrow(rows, run, f"doc_id long, base {span}, found {span}")


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every found span, merged where they touch, replaced by the mark; null stays null."""
    if not text or not (spans := all_spans(text)):
        return text
    out, at = [], 0
    merged: list[list[int]] = []
    for _, a, b in sorted(spans, key=lambda x: x[1]):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for a, b in merged:
        out += [text[at:a], mark]
        at = b
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with secrets of text replaced; n_chars, where there, is counted anew; other columns stay as they are."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def clean(texts):
        return texts.map(redact)

    out = docs.withColumn("text", clean(F.col("text").cast("string")))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))

    def joined(column: str):
        return F.array_join(F.transform(column, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(count, KINDS),
        F.sha2(joined("base"), 256).alias("base_sha256"),
        joined("found").alias("spans"),
    )
