"""Media columns by signature sniffing.

An Aho-Corasick automaton locates the magic bytes of all known formats in one pass; a validator of each format then
confirms its structure and gives its length. The format found at offset 0 corrects a declared type; valid media further
in are carved out. `store` puts bytes losslessly into an 8-bit mono WAV, `restore` sniffs and validates it and carves
the samples back.

Defined cases: null media are empty, of type `application/octet-stream`; truncated or merely look-alike media are not
confirmed; of overlapping finds the first, then the longest, wins; rows are independent, repeated ones too; an empty
table gives an empty one. `text_media` takes null text as empty and ignores other columns; `sniff_media` carries them
along except those that an output replaces.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import without

UNKNOWN = "application/octet-stream"


def _png(b: memoryview, at: int, known: dict) -> int:
    i = at + 8
    first = True
    while i + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, i)
        if i + 12 + n > len(b) or first != (kind == b"IHDR") or (first and n != 13):
            return 0
        if zlib.crc32(b[i + 4 : i + 8 + n]) != struct.unpack_from(">I", b, i + 8 + n)[0]:
            return 0
        i += 12 + n
        first = False
        if kind == b"IEND":
            return i - at
    return 0


def _riff(form: bytes, needed: bytes) -> Callable:
    def check(b: memoryview, at: int, known: dict) -> int:
        if len(b) < at + 12 or bytes(b[at + 8 : at + 12]) != form:
            return 0
        end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
        if end > len(b):
            return 0
        i, seen = at + 12, False
        while i + 8 <= end:
            kind, n = struct.unpack_from("<4sI", b, i)
            if i + 8 + n > end:
                return 0
            seen |= kind[: len(needed)] == needed
            i += 8 + n + n % 2
        return end - at if seen and i >= end else 0

    return check


def _gif(b: memoryview, at: int, known: dict) -> int:
    """known: where walks from a place in these bytes have ended, so that no place is walked from twice."""
    if len(b) < at + 13:
        return 0

    def blocks(i: int) -> int:
        passed = []
        while i < len(b) and b[i] and (i, "sub") not in known:
            passed.append((i, "sub"))
            i += 1 + b[i]
        end = known.get((i, "sub"), i + 1)
        known.update(dict.fromkeys(passed, end))
        return end

    i, passed, end = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 128 else 0), [], 0
    while i < len(b):
        if (end := known.get((i, "gif"), -1)) >= 0:
            break
        passed.append((i, "gif"))
        end = 0
        if b[i] == 0x3B:
            end = i + 1
            break
        if b[i] == 0x21:
            i = blocks(i + 2)
        elif b[i] == 0x2C and i + 10 <= len(b):
            i = blocks(i + 11 + (3 << (b[i + 9] & 7) + 1 if b[i + 9] & 128 else 0))
        else:
            break
    known.update(dict.fromkeys(passed, end))
    return end - at if end else 0


def _jpeg(b: memoryview, at: int, known: dict) -> int:
    i = at + 2
    framed = False
    while i + 4 <= len(b) and b[i] == 0xFF:
        kind = b[i + 1]
        if kind == 0xD9:
            return i + 2 - at if framed else 0
        n = struct.unpack_from(">H", b, i + 2)[0]
        if n < 2 or i + 2 + n > len(b):
            return 0
        framed |= 0xC0 <= kind <= 0xC2
        i += 2 + n
        if kind == 0xDA:
            raw = b.obj
            while (i := raw.find(b"\xff", i)) >= 0 and i + 1 < len(raw) and (raw[i + 1] == 0 or 0xD0 <= raw[i + 1] <= 0xD7):
                i += 2
            if i < 0:
                return 0
    return i + 2 - at if framed and i + 2 <= len(b) and b[i] == 0xFF and b[i + 1] == 0xD9 else 0


def _bmp(b: memoryview, at: int, known: dict) -> int:
    if len(b) < at + 54:
        return 0
    size, zero, start, head, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    row = (abs(width) * bits + 31) // 32 * 4
    fine = not zero and head in (40, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and start >= 14 + head and size >= start + row * abs(height) and width > 0
    return size if fine and at + size <= len(b) else 0


def _flac(b: memoryview, at: int, known: dict) -> int:
    """Metadata only: frames have no length of their own, so the rest belongs to it."""
    i = at + 4
    if len(b) < i + 38 or b[i] & 127 or int.from_bytes(b[i + 1 : i + 4], "big") != 34:
        return 0
    while i + 4 <= len(b):
        last, n = b[i] & 128, int.from_bytes(b[i + 1 : i + 4], "big")
        i += 4 + n
        if last:
            return len(b) - at if i + 2 <= len(b) and b[i] == 0xFF and b[i + 1] & 0xFC == 0xF8 else 0
    return 0


def _mp4(b: memoryview, at: int, known: dict) -> int:
    """From the length before `ftyp`: boxes as far as they hold."""
    i, kinds = at, set()
    while i + 8 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, i)
        if n < 8 or i + n > len(b) or not kind.isalnum():
            break
        kinds.add(kind)
        i += n
    return i - at if kinds & {b"moov", b"mdat", b"meta"} and b"ftyp" in kinds else 0


def _pdf(b: memoryview, at: int, known: dict) -> int:
    """To its last end mark before another header: updates append to a file, marks of their own included."""
    raw = b.obj
    if raw[at + 5 : at + 8] not in (b"1.0", b"1.1", b"1.2", b"1.3", b"1.4", b"1.5", b"1.6", b"1.7", b"2.0"):
        return 0
    stop = raw.find(b"%PDF-", at + 5)
    end = raw.rfind(b"%%EOF", at, stop if stop >= 0 else len(raw))
    return end + 5 - at if end > 0 and raw.find(b"startxref", at, end) > 0 else 0


#: Public signatures (fixed values): magic bytes, how far they stand from the start, type, validator.
FORMATS: list[tuple[bytes, int, str, Callable]] = [
    (b"\x89PNG\r\n\x1a\n", 0, "image/png", _png),
    (b"GIF87a", 0, "image/gif", _gif),
    (b"GIF89a", 0, "image/gif", _gif),
    (b"\xff\xd8\xff", 0, "image/jpeg", _jpeg),
    (b"BM", 0, "image/bmp", _bmp),
    (b"RIFF", 0, "audio/wav", _riff(b"WAVE", b"data")),
    (b"RIFF", 0, "image/webp", _riff(b"WEBP", b"VP8")),
    (b"RIFF", 0, "video/avi", _riff(b"AVI ", b"LIST")),
    (b"fLaC", 0, "audio/flac", _flac),
    (b"ftyp", 4, "video/mp4", _mp4),
    (b"%PDF-", 0, "application/pdf", _pdf),
]
_AUTOMATON = None


def automaton():
    global _AUTOMATON
    if _AUTOMATON is None:
        made = ahocorasick.Automaton()
        by: dict = {}
        for magic, back, kind, check in FORMATS:
            by.setdefault(magic.decode("latin-1"), []).append((len(magic) + back - 1, kind, check))
        for magic, found in by.items():
            made.add_word(magic, found)
        made.make_automaton()
        _AUTOMATON = made
    return _AUTOMATON


def sniff(media: bytes) -> list[tuple[int, int, str]]:
    """(offset, length, type) of the confirmed media, embedded ones included, in order."""
    view, known, out = memoryview(media), {}, []
    for end, formats in automaton().iter(media.decode("latin-1")):
        for back, kind, check in formats:
            at = end - back
            if at >= 0 and (n := check(view, at, known)):
                out.append((at, n, kind))
    return sorted(out, key=lambda x: (x[0], -x[1], x[2]))


def corrected(media: bytes, declared: str | None = None) -> str:
    """The confirmed type of what starts at offset 0, or the declared one if no format contradicts it."""
    return next((kind for at, _, kind in sniff(media) if not at), declared if declared and declared not in {f[2] for f in FORMATS} else UNKNOWN)


def carve(media: bytes) -> list[tuple[int, str, bytes]]:
    """Embedded media (not the one at offset 0): (offset, type, bytes), without overlaps among them."""
    out, end = [], 0
    for at, n, kind in sniff(media):
        if at and at >= end:
            out.append((at, kind, media[at : at + n]))
            end = at + n
    return out


def store(payload: bytes, rate: int = 8000) -> bytes:
    """An 8-bit mono WAV whose samples are the payload."""
    pad = len(payload) % 2
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * pad


def restore(media: bytes) -> tuple[bytes, str]:
    """(samples, feature) of a stored WAV, found by its signature and chunks; the feature says what it holds."""
    finds = sniff(media)
    if not any(at == 0 and kind == "audio/wav" for at, _, kind in finds):
        raise ValueError("no valid WAV")
    i, end, data, spec = 12, 8 + struct.unpack_from("<I", media, 4)[0], b"", None
    while i + 8 <= end:
        kind, n = struct.unpack_from("<4sI", media, i)
        if kind == b"fmt ":
            spec = struct.unpack_from("<HHIIHH", media, i + 8)
        elif kind == b"data":
            data = media[i + 8 : i + 8 + n]
        i += 8 + n + n % 2
    samples = np.frombuffer(data, np.uint8).astype(np.int64)
    inside = [kind for at, _, kind in finds if at]
    feature = f"audio/wav;rate={spec[2]};bits={spec[5]};samples={len(samples)};mean={samples.mean():.4f};crossings={int(np.count_nonzero(np.diff(samples >= 128)))};embedded={','.join(inside) or '-'}"
    return data, feature


def _media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rb in batches:
        cols: list = [[] for _ in range(7)]
        for t in rb.column(1):
            text = (t.as_py() or "").encode()
            media = store(text + b"\0" * (-len(text) % 64 or (0 if text else 64)))
            back, feature = restore(media)
            for c, v in zip(cols, (len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature), strict=True):
                c.append(v)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([rb.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each whole text as audio samples, reads the stored bytes back and describes them."""
    kept = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return kept.mapInArrow(_media, f"doc_id {kept.schema.fields[0].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def sniff_media(df: DataFrame, media_col: str, declared_col: str | None = None) -> DataFrame:
    """df with media_type (corrected) and embedded: array of (offset, length, type, sha256) of what can be carved."""
    df = without(df, "media_type", "embedded")
    names = df.columns
    at, said = names.index(media_col), names.index(declared_col) if declared_col else None

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("sha256", pa.string())]))
        for rb in batches:
            media = [m or b"" for m in rb.column(at).to_pylist()]
            declared = rb.column(said).to_pylist() if said is not None else [None] * len(media)
            found = [[{"offset": o, "length": len(m), "type": t, "sha256": hashlib.sha256(m).hexdigest()} for o, t, m in carve(x)] for x in media]
            yield pa.RecordBatch.from_arrays([*rb.columns, pa.array([corrected(m, d) for m, d in zip(media, declared, strict=True)], pa.string()), pa.array(found, kind)], [*names, "media_type", "embedded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(rows, f"{fields}, media_type string, embedded array<struct<offset: bigint, length: bigint, type: string, sha256: string>>")
