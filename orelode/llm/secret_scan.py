"""Secret scans with a recursive decoding worklist.

A text is the first layer. Each layer is scanned for secrets and for encoded runs: percent escapes, backslash escapes,
numeric character references, base64, and, where base64 or escapes give bytes of a compressed stream, what these hold,
however often they are compressed. Bytes that hold UTF-16 are read as such too. Every run that decodes is a new layer on
the worklist, which remembers in which characters of the first layer it lies; layers that were met before (by their
content and origin) end a cycle. Bytes that are no text become replacement characters, which are in no secret. A secret
in a layer counts where the layer lies: escapes map character by character, base64 and compressed layers as a whole. The
list ends when no layer is new.
"""

from __future__ import annotations

import base64
import bisect
import codecs
import hashlib
import re
import zlib
from collections import Counter, deque
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orelode.llm.runtime import Sink, column, task, values

#: The patterns of the base: fixed values, with the least length of each match (of group 2 for assign).
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs are taken whole, so this finds the runs of 32 or more
LEAST = {"assign": 8, "access": 16, "hex": 32}

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPES = re.compile(r"(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\U[0-9A-Fa-f]{8})+")
REFERENCES = re.compile(r"(?:&#(?:[0-9]{1,7}|[xX][0-9A-Fa-f]{1,6});)+")
REFERENCE = re.compile(r"&#(?:([0-9]+)|[xX]([0-9A-Fa-f]+));")
#: Runs that escapes make bytes of, from an escape on (printable characters before it belong to them too), and what each
#: of their units stands for.
OCTETS = {"%": re.compile(r"%[0-9A-Fa-f]{2}[!-~]*"), "\\x": re.compile(r"\\x[0-9A-Fa-f]{2}(?:[!-~]|(?<=[!-~])\x20(?=[!-~]))*")}
UNITS = {"%": re.compile(r"%([0-9A-Fa-f]{2})|(.)"), "\\x": re.compile(r"\\x([0-9A-Fa-f]{2})|\\([abfnrtv0\\'\"])|(.)")}
NAMED = {"a": 7, "b": 8, "f": 12, "n": 10, "r": 13, "t": 9, "v": 11, "0": 0, "\\": 92, "'": 39, '"': 34}
#: How compressed streams with a mark begin: gzip, and zlib with the usual window.
MARKED = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")
ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2})|U([0-9A-Fa-f]{8}))")
RUN, PAD, BREAKS = re.compile(r"[A-Za-z0-9+/_-]{16,}"), re.compile("={0,2}"), re.compile("[/_-]")
#: A base64 block's next line, with nothing else in it but closing marks, and a short line before.
NEXT = re.compile(r"""\r?\n[ \t]*([A-Za-z0-9+/_-]+)(?=={0,2}[ \t]*(?:["'<,;)\]}]|\r?\n|\Z))""")
BEFORE = re.compile(r"([A-Za-z0-9+/_-]+)\r?\n[ \t]*\Z")
BAD, CODES = re.compile("[\udc80-\udcff]"), str.maketrans("-_", "+/")
KEYWORD = re.compile(r"passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)
#: Bytes of a compressed layer that are held at once; a larger one is inflated again, in pieces, and scanned by parts.
INFLATED, PIECE = 64 << 20, 8 << 20
#: Bytes of a stream that are fed at once, and characters of the line before a run that can belong to it.
FED, RUN_BEFORE = 16 << 10, 18
#: Where a text can be cut: a blank between words, or two characters beyond ASCII. No pattern, escape, reference or encoded
#: run has either within it.
CUT = re.compile(r"""[A-Za-z0-9]\x20(?=[A-Za-z0-9])|[^\x00-\x7f](?=[^\x00-\x7f])""")
#: Four ASCII characters in UTF-16, in either order.
PAIRS = re.compile(rb"(?:[\x20-\x7e]\x00){4}")
SCANNED = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("base", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))])
SPANS = "array<struct<kind:string,start:int,end:int>>"

Span = tuple[int, int, int]
Source = Callable[[], Iterator[bytes]]


def scan(text: str) -> list[Span]:
    """(start, rank of kind, end) of the base patterns' matches."""
    out = []
    if KEYWORD.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


class Layer:
    """A decoded text; ``starts[i]`` and ``ends[i]`` say where its i-th character lies in the first layer.

    ``part`` says that it is one of the parts of a text that isn't held as a whole.
    """

    def __init__(self, text: str, starts=None, ends=None, at: tuple[int, int] | None = None, part: bool = False):
        self.text, self.starts, self.ends, self.at, self.part = text, starts, ends, at, part

    def key(self) -> tuple:
        return self.text if len(self.text) < 100 else hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), self.at

    def place(self, a: int, b: int) -> tuple[int, int]:
        if self.at:
            return self.at
        return (a, b) if self.starts is None else (int(self.starts[a]), int(self.ends[b - 1]))


def parts(source: Source, kind: str = "utf-8") -> Iterator[tuple[str, bool]]:
    """The bytes as text, and whether it is only a part; parts end where no match of a pattern can go on."""
    decoder, held, size, cut = codecs.getincrementaldecoder(kind)("replace"), [], 0, False
    for piece in source():
        held.append(decoder.decode(piece))
        size += len(held[-1])
        if size > INFLATED:
            text, width, at, low = "".join(held), 1 << 10, 0, size
            while not at and low:
                low = max(0, size - width)
                at = max((m.end() for m in CUT.finditer(text, low)), default=0)
                width *= 8
            if at:
                yield text[:at], True
                cut = True
            held, size = [text[at:]], len(text) - at
    held.append(decoder.decode(b"", True))
    yield "".join(held), cut


def pieces(source: Source, bits: int, ends: list[int]) -> Iterator[bytes]:
    """What one stream after another holds; an error if the first of them is broken or ends early. ``ends``: their ends."""
    d, whole, fed = zlib.decompressobj(bits), False, 0
    for rest in source():
        fed += len(rest)
        while rest:
            try:
                out = d.decompress(rest, PIECE)
            except zlib.error:
                if whole:
                    return
                raise
            if out:
                yield out
            rest = d.unconsumed_tail
            if d.eof:
                ends.append(fed - len(d.unused_data))
                if bits < 0:
                    return
                rest, whole = d.unused_data.lstrip(b"\0"), True
                d = zlib.decompressobj(bits)
            elif not rest and len(out) == PIECE:
                while out := d.decompress(b"", PIECE):
                    yield out
    if not whole:
        raise zlib.error("no end")


def inflated(source: Source) -> tuple[Source, bytes, int, bool] | None:
    """The bytes of a complete gzip, zlib or raw deflate stream, their digest, its end, and whether it is a raw one."""
    head = bytes(next(source(), b"")[:8])
    if len(head) < 8:
        return None
    bits = 31 if head[:2] == b"\x1f\x8b" else 15 if head[0] & 15 == 8 and (head[0] << 8 | head[1]) % 31 == 0 else -15
    held, size, digest, ends = [], 0, hashlib.blake2b(digest_size=16), []
    try:
        for piece in pieces(source, bits, ends):
            size += len(piece)
            digest.update(piece)
            if size <= INFLATED:
                held.append(piece)
            else:
                held.clear()
    except zlib.error:
        return None
    if not size:
        return None
    if size > INFLATED:
        return lambda: pieces(source, bits, []), digest.digest(), ends[-1], bits < 0
    out = b"".join(held)
    return lambda: iter((out,)), digest.digest(), ends[-1], bits < 0


def opened(source: Source) -> Iterator[tuple[str, bool]]:
    """Texts that bytes hold, by themselves or compressed any number of times, and whether each is only a part."""
    seen = set()
    while True:
        yield from parts(source)
        for kind in wide(source):
            yield from parts(source, kind)
        found = inflated(source)
        if not found or found[1] in seen or found[3] and found[2] < sum(map(len, source())):
            return
        source = found[0]
        seen.add(found[1])


def unescaped(text: str, escapes: list[tuple[int, int, list[tuple[str, int, int]]]]) -> tuple[str, np.ndarray, np.ndarray]:
    """The text with the given runs replaced, and where each of its characters came from."""
    parts, starts, ends, at = [], [], [], 0
    for a, b, chars in [*escapes, (len(text), len(text), [])]:
        parts += [text[at:a], "".join(c for c, _, _ in chars)]
        plain = np.arange(at, a)
        starts += [plain, np.array([x for _, x, _ in chars], np.int64)]
        ends += [plain + 1, np.array([y for _, _, y in chars], np.int64)]
        at = b
    return "".join(parts), np.concatenate(starts), np.concatenate(ends)


def percent_runs(text: str) -> list:
    out = []
    for m in PERCENT.finditer(text):
        raw, chars, at = bytes.fromhex(m[0].replace("%", "")), [], m.start()
        for c in raw.decode("utf-8", "surrogateescape"):
            n = 3 if "\udc80" <= c <= "\udcff" else 3 * len(c.encode())
            chars.append(("\ufffd" if "\udc80" <= c <= "\udcff" else c, at, at + n))
            at += n
        out.append((m.start(), m.end(), chars))
    return out


def reference_runs(text: str) -> list:
    out = []
    for m in REFERENCES.finditer(text):
        codes = [(int(e[1] or e[2], 10 if e[1] else 16), m.start() + e.start(), m.start() + e.end()) for e in REFERENCE.finditer(m[0])]
        out.append((m.start(), m.end(), [(chr(c) if 0 < c < 0x110000 and not 0xD800 <= c < 0xE000 else "\ufffd", x, y) for c, x, y in codes]))
    return out


def octet_layers(layer: Layer, sign: str) -> Iterator[Layer]:
    """What compressed streams hold whose bytes are escaped, wholly or where they aren't printable."""
    text, at = layer.text, 0
    while m := OCTETS[sign].search(text, at):
        left = m.start()
        while left > at and "!" <= text[left - 1] <= "~":
            left -= 1
        at, raw, starts = m.end(), bytearray(), []
        for u in UNITS[sign].finditer(text, left, at):
            starts.append(u.start())
            raw.append(int(u[1], 16) if u[1] else ord(u[2]) if sign == "%" else NAMED[u[2]] if u[2] else ord(u[3]))
        starts.append(m.end())
        view, done = memoryview(bytes(raw)), 0
        first = bisect.bisect_left(starts, m.start())
        for i in sorted({first, 0, *(x.start() for x in MARKED.finditer(view))}):
            if i < done or not (found := inflated(chunks(view[i:]))):
                continue
            if found[3] and found[2] < len(view) - i:
                continue  # raw deflate has no mark: it must fill the run and hold text
            done = i + found[2]
            for new, part in opened(found[0]):
                yield Layer(new, at=layer.place(starts[i], starts[done]), part=part)


def escape_runs(text: str) -> list:
    out = []
    for m in ESCAPES.finditer(text):
        chars, high = [], None
        for e in ESCAPE.finditer(m[0]):
            code, x, y = int(e[1] or e[2] or e[3], 16), m.start() + e.start(), m.start() + e.end()
            if high and 0xDC00 <= code < 0xE000:
                chars[-1] = (chr(0x10000 + (high - 0xD800) * 0x400 + code - 0xDC00), chars[-1][1], y)
                high = None
                continue
            high = code if 0xD800 <= code < 0xDC00 else None
            chars.append((chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "�", x, y))
        out.append((m.start(), m.end(), chars))
    return out


def base64_runs(text: str) -> Iterator[tuple[list[tuple[int, int]], int]]:
    """The lines of each base64 run, and where it ends with its padding."""
    at = 0
    while m := RUN.search(text, at):
        lines = [m.span()]
        low = max(at, text.rfind("\n", 0, m.start()) - RUN_BEFORE) if "\n" in text[at : m.start()] else m.start()
        if low < m.start() and not text[text.rfind("\n", 0, m.start()) + 1 : m.start()].strip(" \t") and (before := BEFORE.search(text[low : m.start()])):
            lines.insert(0, (low + before.start(1), low + before.end(1)))
        while n := NEXT.match(text, lines[-1][1]):
            lines.append(n.span(1))
        at = PAD.match(text, lines[-1][1]).end()
        yield lines, at


class Run(Layer):
    """A base64 run decoded from the first of ``starts`` on; a byte that is no text is a lone surrogate.

    ``starts`` and ``stops`` are where base64 can begin and end in the run. What is no text before or after a secret
    isn't part of its place, if such bytes are many.
    """

    def __init__(self, raw: bytes, starts: list[int], stops: list[int], whole: Callable[[int, int], tuple[int, int]]):
        super().__init__(raw.decode("utf-8", "surrogateescape"), at=whole(starts[0], stops[-1]))
        self.from_, self.to, self.whole = starts, stops, whole

    def byte(self, i: int) -> int:
        return len(self.text[:i].encode("utf-8", "surrogateescape"))

    def garbage(self, a: int, b: int) -> bool:
        return 8 * len(BAD.findall(self.text, a, b)) >= b - a > 0

    def place(self, a: int, b: int) -> tuple[int, int]:
        text, first = self.text, self.from_[0]
        left = max((m.end() for m in BAD.finditer(text, 0, a)), default=0)
        after = BAD.search(text, b)
        begin, end = self.from_[0], self.to[-1]
        if left:
            low, high = self.byte(left), self.byte(a)
            i = bisect.bisect_left(self.from_, first + -(-low * 4 // 3))
            if i < len(self.from_) and (self.from_[i] - first) // 4 * 3 <= high and self.garbage(0, left):
                begin = self.from_[i]
        if after:
            least, most = first + -(-self.byte(b) * 4 // 3), first + -(-self.byte(after.start()) * 4 // 3)
            i = bisect.bisect_right(self.to, most) - 1
            if i >= 0 and self.to[i] >= least and self.garbage(after.start(), len(text)):
                end = self.to[i]
        return self.whole(begin, end)


def one_script(head: bytes) -> bool:
    """Whether every other byte is mostly one of three, as in UTF-16 text of an alphabet."""
    return len(head) > 7 and any(4 * sum(n for _, n in Counter(head[k::2]).most_common(3)) > 3 * len(head[k::2]) for k in (0, 1))


def wide(source: Source) -> list[str]:
    """The kinds of UTF-16 in which the bytes, read from their start, hold ASCII characters in a row anywhere.

    What can match is ASCII, so text of any script counts where it holds some; and bytes of both orders are read as both.
    """
    kinds, at, tail = [], 0, b""
    for piece in source():
        data = tail + bytes(piece)
        if b"\0" in data:
            for m in PAIRS.finditer(data):
                kind = "utf-16-be" if (at - len(tail) + m.start()) & 1 else "utf-16-le"
                if kind not in kinds:
                    kinds.append(kind)
                if len(kinds) == 2:
                    return kinds
        at += len(piece)
        tail = data[-7:]
    return kinds


def packed(layer: Layer, lines: list[tuple[int, int]], end: int) -> Iterator[Layer]:
    """Layers that a base64 run holds, by itself or compressed.

    Raw deflate has no mark and no checksum, and other bytes often are a short stream: it must end where base64 can. What
    is in it then counts by its matches alone, however it begins.
    """
    bare = "".join(layer.text[a:b] for a, b in lines).translate(CODES)
    heads = [0, *accumulate(b - a for a, b in lines)]
    marks = [heads[i] + m.start() - a for i, (a, b) in enumerate(lines) for m in BREAKS.finditer(layer.text, a, b)]
    places, breaks = set(heads), set(marks)
    starts, stops = sorted({*heads[:-1], *(m + 1 for m in marks)} - {heads[-1]}), sorted({*heads[1:], *marks})

    def whole(s: int, e: int) -> tuple[int, int]:
        i, j = bisect.bisect_right(heads, s) - 1, bisect.bisect_left(heads, e) - 1
        return layer.place(lines[i][0] + s - heads[i], end if e == heads[-1] else lines[j][0] + e - heads[j])

    for phase in range(4):
        own = [s for s in starts if s % 4 == phase]
        if not own:
            continue
        token = bare[own[0] :]
        token = token[:-1] if len(token) % 4 == 1 else token
        raw = base64.b64decode(token + "=" * (-len(token) % 4))
        if raw:
            yield Run(raw, own, stops, whole)
            if kinds := wide(lambda raw=raw: iter((raw,))):
                first = PAIRS.search(raw).start()
                s = next((s for s in own if (s - own[0]) // 4 * 3 <= first and one_script(raw[(s - own[0]) // 4 * 3 :][:64])), own[0])
                i = (s - own[0]) // 4 * 3
                for kind in wide(lambda raw=raw, i=i: iter((raw[i:],))) or kinds:
                    yield Layer(raw[i:].decode(kind, "replace"), at=whole(s, stops[-1]))
        view = memoryview(raw)
        for s in own:
            if s not in places and s in breaks:
                continue  # no text, gzip or zlib begins with these characters
            source = chunks(view[(s - own[0]) // 4 * 3 :])
            if found := inflated(source):
                stop = stops[min(bisect.bisect_left(stops, s + -(-found[2] * 4 // 3)), len(stops) - 1)]
                if found[3] and (stop - s) * 3 // 4 != found[2]:
                    continue
                for new, part in opened(found[0]):
                    yield Layer(new, at=whole(s, stop), part=part)


def chunks(view: memoryview) -> Source:
    return lambda: (view[i : i + FED] for i in range(0, len(view), FED))


def inner(layer: Layer) -> Iterator[Layer]:
    """The layers that lie directly in this one."""
    text = layer.text
    for has, runs in (("%", percent_runs), ("\\", escape_runs), ("&#", reference_runs)):
        if has in text and (found := runs(text)):
            new, starts, ends = unescaped(text, found)
            if layer.at:
                yield Layer(new, at=layer.at)
            elif layer.starts is not None:
                yield Layer(new, layer.starts[starts], layer.ends[ends - 1])
            else:
                yield Layer(new, starts, ends)
    for sign in OCTETS:
        if sign in text:
            yield from octet_layers(layer, sign)
    for lines, end in base64_runs(text):
        yield from packed(layer, lines, end)


def explore(layer: Layer, seen: set, found: set[Span]) -> None:
    """Adds what the layers below this one hold; parts are done with one by one."""
    work = deque([layer])
    while work:
        for new in inner(work.popleft()):
            key = new.key()
            if key in seen:
                continue
            seen.add(key)
            for a, kind, b in scan(new.text):
                x, y = new.place(a, b)
                found.add((x, kind, y))
            if new.part:
                explore(new, seen, found)
            else:
                work.append(new)


def spans(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and these with what the layers add."""
    base, first = scan(text), Layer(text)
    found = set(base)
    explore(first, {first.key()}, found)
    return base, added(base, found)


def added(base: list[Span], found: set[Span]) -> list[Span]:
    """Base spans and the others, but for those that lie in a base span of their kind."""
    own = {k: sorted((a, b) for a, kind, b in base if kind == k) for k in range(3)}

    def covered(span: Span) -> bool:
        a, kind, b = span
        i = bisect.bisect_right(own[kind], (a, 1 << 62)) - 1
        return i >= 0 and own[kind][i][1] >= b

    kept = set(base)
    return sorted(kept | {s for s in found if s in kept or not covered(s)})


def merged(found: list[Span]) -> list[tuple[int, int, list[str]]]:
    """Overlapping spans as one, with their kinds."""
    out = []
    for a, kind, b in found:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), out[-1][2] + [KINDS[kind]] * (KINDS[kind] not in out[-1][2]))
        else:
            out.append((a, b, [KINDS[kind]]))
    return out


def redacted(text: str, found: list[Span]) -> str:
    parts, at = [], 0
    for a, b, kinds in merged(found):
        parts += [text[at:a], f"[{'+'.join(kinds)}]"]
        at = b
    return "".join([*parts, text[at:]])


def structs(found: list[Span]) -> list[dict]:
    return [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in found]


def scan_batches(batches):
    sink = Sink(SCANNED)
    for batch in batches:
        for doc, text in zip(column(batch, "doc_id"), values(batch, "text"), strict=True):
            base, found = spans(text or "")
            if sink.add((doc, None, structs(base), structs(found)), 64 + 80 * len(found)):
                yield from sink.flush()
    yield from sink.flush()


def secret_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, base, spans`` for each row: arrays of (kind, start, end) by start, then kind, in code points, end exclusive.

    ``base`` has the matches in the text itself, ``spans`` also those in its decoded layers, where they lie in the text.
    A decoded match that lies in a match of its kind in the text itself adds nothing to it. A null text counts as empty
    and has none. Repeated rows and null keys stay; other columns go; an empty table gives an empty one.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(task(__name__, "scan_batches"), f"doc_id long, text string, base {SPANS}, spans {SPANS}").drop("text")


def redact_batches(batches, text: str, length: str | None):
    for batch in batches:
        new = [None if t is None else redacted(t, spans(t)[1]) for t in values(batch, text)]
        names = batch.schema.names
        out = batch.set_column(names.index(text), batch.schema.field(text), pa.array(new, batch.schema.field(text).type))
        if length:
            out = out.set_column(names.index(length), batch.schema.field(length), pa.array([n if t is None else len(t) for t, n in zip(new, column(batch, length), strict=True)], batch.schema.field(length).type))
        yield out


def redact(docs: DataFrame, text: str = "text", length: str | None = None) -> DataFrame:
    """``docs`` with each span replaced by its kinds in brackets, and with column ``length`` set to the new length.

    Overlapping spans are replaced as one. Null texts stay null; all other columns and rows stay as they are.
    """
    return docs.mapInArrow(task(__name__, "redact_batches", text=text, length=length), docs.schema)
