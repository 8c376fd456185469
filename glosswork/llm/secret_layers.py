"""Secret scans through layers of encoding.

A text is scanned as it is; then a worklist takes its encoded parts off one layer
at a time and scans each result again, until nothing is left to unwrap: lines
with percent escapes, lines with Unicode escapes (\\uXXXX, \\u{X}, \\UXXXXXXXX,
\\xXX, &#N;), runs of base64 (standard or URL-safe), and gzip, zlib, bz2 or xz
data that base64 or percent escapes hold. Every layer carries, for each of its
characters, the place in the document that it came from, so a finding of any
depth is a span of the document. A layer that was seen at the same place isn't
taken again, which ends cycles (data that unpacks to itself) as well as the same
layer reached by two orders of unwrapping. Chains such as %2525 and doubled
backslashes are one layer.

Work is linear: the layers of a text hold at most DEPTH times its characters and
SPARE more, and unpacking stops there. What isn't opened for that reason (nothing
but bombs and texts made to nest) is counted in n_unopened; higher arguments open it.

Defined cases: null text counts as empty and has no spans; a span found in
several layers is listed once; escapes that give no UTF-8 count as Latin-1, half a
surrogate pair as U+FFFD; a broken stream gives what came before its fault;
repeated rows give repeated rows; an empty table gives no rows; other columns
are not looked at.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from array import array

from pyspark.sql import DataFrame

from glosswork.llm.common import ROOT, table, text_of

DEPTH, SPARE = 16, 1 << 26
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: What each keyword of ASSIGN begins with; a text without any has no match.
KEYS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

PERCENT = re.compile(r"(?:%(?:25)*[0-9A-Fa-f]{2})+")
PERCENT_ONE = re.compile(r"%(?:25)*([0-9A-Fa-f]{2})")
ESCAPE = re.compile(r"\\+(?:u([0-9A-Fa-f]{4})|u\{([0-9A-Fa-f]{1,6})\}|U([0-9A-Fa-f]{8})|x([0-9A-Fa-f]{2}))|&#(?:[xX]([0-9A-Fa-f]{1,6})|([0-9]{1,7}));")
#: Runs of base64 and what stands for + and / in them.
BASE64 = ((re.compile(r"[A-Za-z0-9+/]{16,}={0,2}"), b"+/"), (re.compile(r"[A-Za-z0-9_-]{16,}={0,2}"), b"-_"))
UNPRINTED = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
#: First bytes of compressed data and what unpacks it.
PACKED = (
    (b"\x1f\x8b\x08", lambda: zlib.decompressobj(31)),
    (b"\x78\x01", zlib.decompressobj),
    (b"\x78\x5e", zlib.decompressobj),
    (b"\x78\x9c", zlib.decompressobj),
    (b"\x78\xda", zlib.decompressobj),
    (b"BZh", bz2.BZ2Decompressor),
    (b"\xfd7zXZ\x00", lzma.LZMADecompressor),
)


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the secrets that stand in the text as it is."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYS):
        found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Layer:
    """Decoded text and, for each of its characters, where in the document it begins and ends."""

    def __init__(self, text="", starts=None, ends=None):
        self.text = text
        self.starts = array("q") if starts is None else starts
        self.ends = array("q") if ends is None else ends

    def part(self, a: int, b: int) -> Layer:
        return Layer(self.text[a:b], self.starts[a:b], self.ends[a:b])

    def replaced(self, pieces) -> Layer:
        """pieces: (a, b, characters with their own ranges in [a, b)) in order; the rest stays."""
        texts, starts, ends, at = [], array("q"), array("q"), 0
        for a, b, decoded in pieces:
            texts.append(self.text[at:a])
            starts.extend(self.starts[at:a])
            ends.extend(self.ends[at:a])
            for char, i, j in decoded:
                texts.append(char)
                starts.append(self.starts[i])
                ends.append(self.ends[j - 1])
            at = b
        texts.append(self.text[at:])
        starts.extend(self.starts[at:])
        ends.extend(self.ends[at:])
        return Layer("".join(texts), starts, ends)


def _characters(data: bytes, begin, end):
    """(character, first, last place) of bytes; byte i stands from begin(i) to end(i + 1)."""
    try:
        text = data.decode()
    except UnicodeDecodeError:
        text = data.decode("latin-1")
    wide, at = len(text) < len(data), 0
    for char in text:
        size = len(char.encode()) if wide else 1
        yield char, begin(at), end(at + size)
        at += size


def _packed(data: bytes):
    return next((maker for mark, maker in PACKED if data.startswith(mark)), None)


def _unpacked(data: bytes, room: int) -> tuple[bytes, bool]:
    """The bytes that data holds, streams one after another, and whether they fitted in room."""
    out = b""
    while maker := _packed(data):
        unpacker, before = maker(), len(out)
        try:
            out += unpacker.decompress(data, room + 1 - before)
        except (zlib.error, OSError, EOFError, lzma.LZMAError):
            break
        if len(out) > room:
            return out, False
        if not unpacker.eof:
            break
        data = unpacker.unused_data
    return out, True


class Worklist:
    """All layers of one text, scanned as they come."""

    def __init__(self, text: str, depth: int = DEPTH, spare: int = SPARE):
        self.room = depth * len(text) + spare
        self.spans, self.layers, self.unopened, self.seen, self.todo = set(), 0, 0, set(), []
        self.todo.append(Layer(text, range(len(text)), range(1, len(text) + 1)))
        while self.todo:
            self.unwrap(self.todo.pop())

    def add(self, layer: Layer) -> None:
        if not layer.text:
            return
        key = (layer.starts[0], layer.ends[-1], hashlib.sha256(layer.text.encode("utf-8", "surrogatepass")).digest())
        if key in self.seen:
            return
        if len(layer.text) > self.room:
            self.unopened += 1
            return
        self.seen.add(key)
        self.room -= len(layer.text)
        self.layers += 1
        self.spans.update((layer.starts[a], kind, layer.ends[b - 1]) for a, kind, b in scan(layer.text))
        self.todo.append(layer)

    def add_bytes(self, data: bytes, layer: Layer, a: int, b: int, begin, end) -> None:
        """A layer of bytes that stand in layer from a to b. What packed bytes hold stands at all of a to b."""
        seen = set()
        while _packed(data):
            if data in seen:
                return
            seen.add(data)
            data, whole = _unpacked(data, self.room)
            if not whole:
                self.unopened += 1
                return
        try:
            if UNPRINTED.search(data.decode()):
                return
        except UnicodeDecodeError:
            return
        if seen:
            n = len(data.decode())
            self.add(Layer(data.decode(), array("q", [layer.starts[a]]) * n, array("q", [layer.ends[b - 1]]) * n))
        else:
            self.add(layer.part(a, b).replaced([(0, b - a, _characters(data, begin, end))]))

    def unwrap(self, layer: Layer) -> None:
        text = layer.text
        for pattern, decoded in ((PERCENT, self.percent), (ESCAPE, self.escapes)):
            at = 0
            while m := pattern.search(text, at):
                a, b = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
                at = len(text) if b < 0 else b
                line = layer.part(a, at)
                self.add(line.replaced(decoded(line)))
        done = set()
        for pattern, others in BASE64:
            for m in pattern.finditer(text):
                if m.span() in done:
                    continue
                done.add(m.span())
                run = m[0].rstrip("=")
                run = run[: len(run) - (len(run) % 4 == 1)]
                data = base64.b64decode(run + "=" * (-len(run) % 4), others)
                # Six bits a character: byte i begins in character 8 i / 6, and i bytes end with the (8 i / 6)th, rounded up.
                self.add_bytes(data, layer, *m.span(), lambda i: 4 * i // 3, lambda i: (4 * i + 2) // 3)

    def percent(self, line: Layer):
        for m in PERCENT.finditer(line.text):
            ones = list(PERCENT_ONE.finditer(m[0]))
            data = bytes(int(x[1], 16) for x in ones)
            places = [m.start() + x.start() for x in ones] + [m.end()]
            if _packed(data):
                self.add_bytes(data, line, *m.span(), None, None)
            yield *m.span(), _characters(data, places.__getitem__, places.__getitem__)

    def escapes(self, line: Layer):
        found = list(ESCAPE.finditer(line.text))
        codes = [int(m[6]) if m[6] else int(next(g for g in m.groups() if g), 16) for m in found]
        skip = False
        for i, (m, code) in enumerate(zip(found, codes, strict=True)):
            if skip:
                skip = False
                continue
            end = m.end()
            if 0xD800 <= code < 0xDC00 and i + 1 < len(found) and found[i + 1].start() == end and 0xDC00 <= codes[i + 1] < 0xE000:
                code = 0x10000 + ((code - 0xD800) << 10) + codes[i + 1] - 0xDC00
                end, skip = found[i + 1].end(), True
            char = "\ufffd" if code > 0x10FFFF or 0xD800 <= code < 0xE000 else chr(code)
            yield m.start(), end, [(char, m.start(), end)]


def listed(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


OUT = "doc_id long, n_assign long, n_access long, n_hex long, base string, spans string, n_layers long, n_unopened long"


def find_secrets(docs: DataFrame, depth: int = DEPTH, spare: int = SPARE) -> DataFrame:
    """One row per row of docs: doc_id, counts and list of the base spans, list of all
    spans, the layers that were scanned and those left unopened."""
    root = ROOT

    def run(batches):
        import sys

        import pyarrow as pa

        if root not in sys.path:
            sys.path.append(root)
        from glosswork.llm.secret_layers import Worklist, listed, scan

        schema = pa.schema([(name, pa.int64() if kind == "long" else pa.string()) for name, kind in (x.split() for x in OUT.split(", "))])
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                base, deep = scan(text), Worklist(text, depth, spare)
                kinds = [kind for _, kind, _ in base]
                rows.append((doc_id, *(kinds.count(k) for k in range(3)), listed(base), listed(deep.spans.union(base)), deep.layers, deep.unopened))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return text_of(docs).mapInArrow(run, OUT)


def query(spark, sf_dir):
    from pyspark.sql import functions as F

    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_layers", "n_unopened")
