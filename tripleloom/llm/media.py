"""Media columns: signature sniffing.

An Aho-Corasick automaton finds the magic bytes of known formats anywhere in a
value, and the end marks of two of them; a validator of the format walks its
structure from there and tells the length.  A valid format at the start corrects
the declared type, valid formats further on, inside of others too, are embedded
media: they are told by their offsets, and carved out from there.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that are turned into Python objects at a time.
FEW_ROWS = 64
UNIT = 192

#: Magic bytes and where they stand in their format.
SIGNATURES = {
    b"\x89PNG\r\n\x1a\n": ("image/png", 0),
    b"\xff\xd8\xff": ("image/jpeg", 0),
    b"GIF87a": ("image/gif", 0),
    b"GIF89a": ("image/gif", 0),
    b"BM": ("image/bmp", 0),
    b"WAVEfmt ": ("audio/wav", 8),
    b"WEBPVP8": ("image/webp", 8),
    b"fLaC\x00\x00\x00\x22": ("audio/flac", 0),
    b"OggS\x00": ("audio/ogg", 0),
    b"PK\x03\x04": ("application/zip", 0),
    b"%PDF-": ("application/pdf", 0),
}


#: Marks that end a format, or stand before its end.
MARKS = (b"PK\x05\x06", b"%%EOF", b"startxref")


class Ends:
    """The places of each of MARKS in a value, in order."""

    def __init__(self):
        self.at: dict[bytes, list[int]] = {m: [] for m in MARKS}

    def first(self, mark: bytes, start: int) -> int:
        """The first place from ``start`` on, -1 if there is none."""
        k = bisect_left(self.at[mark], start)
        return self.at[mark][k] if k < len(self.at[mark]) else -1

    def last(self, mark: bytes, start: int, end: int) -> int:
        """The last place from ``start`` on before ``end``, -1 if there is none."""
        k = bisect_left(self.at[mark], end) - 1
        return self.at[mark][k] if k >= 0 and self.at[mark][k] >= start else -1


def _png(b: bytes, at: int) -> int:
    p = at + 8
    while p + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, p)
        if p + 12 + n > len(b) or p == at + 8 and n != 13 or zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0] or p == at + 8 and kind != b"IHDR":
            return 0
        p += 12 + n
        if kind == b"IEND":
            return p - at
    return 0


def _walked(step, state, memo: dict) -> int:
    """Where a walk from ``state`` ends, 0 if it fails.  ``step`` gives the next state, or the end as a number; walks that
    meet go on alike, so ``memo`` has each state walked once for all starts."""
    path = []
    while not isinstance(state, int):
        if state in memo:
            state = memo[state]
            break
        path.append(state)
        state = step(*state)
    for s in path:
        memo[s] = state
    return state


def _jpeg(b: bytes, at: int, memo: dict) -> int:
    def step(p: int, scanned: bool):
        if p + 4 > len(b):
            return p + 2 if scanned and b[p : p + 2] == b"\xff\xd9" else 0
        if b[p] != 0xFF:
            return 0
        marker = b[p + 1]
        if marker == 0xD9:
            return p + 2 if scanned else 0
        if marker == 0xFF or 0xD0 <= marker <= 0xD8:
            return p + (1 if marker == 0xFF else 2), scanned
        p += 2 + struct.unpack_from(">H", b, p + 2)[0]
        if marker != 0xDA:
            return p, scanned
        while p + 1 < len(b) and not (b[p] == 0xFF and b[p + 1] != 0 and not 0xD0 <= b[p + 1] <= 0xD7):  # entropy-coded bytes up to the next marker
            p = b.find(b"\xff", p + (b[p] == 0xFF))
            if p < 0:
                return 0
        return p, True

    return max(_walked(step, (at + 2, False), memo) - at, 0)


def _gif(b: bytes, at: int, memo: dict) -> int:
    def step(p: int, inside: bool):
        if p >= len(b):
            return 0
        if inside:  # a chain of blocks, each with its length
            return (p + b[p] + 1, True) if b[p] else (p + 1, False)
        if b[p] == 0x3B:
            return p + 1
        if b[p] == 0x21:
            return p + 2, True
        if b[p] == 0x2C and p + 10 < len(b):
            return p + 11 + (3 << (b[p + 9] & 7) + 1 if b[p + 9] & 0x80 else 0), True
        return 0

    if at + 13 > len(b):
        return 0
    start = at + 13 + (3 << (b[at + 10] & 7) + 1 if b[at + 10] & 0x80 else 0)
    return max(_walked(step, (start, False), memo) - at, 0)


def _bmp(b: bytes, at: int) -> int:
    if at + 54 > len(b):
        return 0
    size, zero, start, header, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    row = (abs(width) * bits + 31) // 32 * 4
    good = zero == 0 and header in (40, 52, 56, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and width > 0 and height and start >= 14 + header
    return size if good and start + row * abs(height) <= size <= len(b) - at else 0


def _riff(b: bytes, at: int) -> int:
    if at < 0 or b[at : at + 4] != b"RIFF":
        return 0
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    p = at + 12
    while p + 8 <= min(end, len(b)):
        n = struct.unpack_from("<I", b, p + 4)[0]
        p += 8 + n + (n & 1)
    return end - at if p == end <= len(b) else 0


def _flac(b: bytes, at: int, until: int) -> int:
    """Up to the next stream, or the end of the value: frames can't be walked without decoding them."""
    p, last = at + 4, False
    while not last and p + 4 <= until:
        last, n = bool(b[p] & 0x80), int.from_bytes(b[p + 1 : p + 4], "big")
        p += 4 + n
    return until - at if last and p + 2 <= until and b[p] == 0xFF and b[p + 1] & 0xFC == 0xF8 else 0


def _ogg(b: bytes, at: int) -> int:
    p, last = at, False
    while not last and b[p : p + 4] == b"OggS" and p + 27 <= len(b) and p + 27 + b[p + 26] <= len(b):
        last = bool(b[p + 5] & 4)
        p += 27 + b[p + 26] + sum(b[p + 27 : p + 27 + b[p + 26]])
    return p - at if last and p <= len(b) else 0


def _zip(b: bytes, at: int, ends: Ends) -> int:
    end = ends.first(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(b):
        return 0
    size, offset, note = struct.unpack_from("<IIH", b, end + 12)
    whole = offset + size == end - at and (not size or b[at + offset : at + offset + 4] == b"PK\x01\x02")
    return end + 22 + note - at if whole and end + 22 + note <= len(b) else 0


def _pdf(at: int, until: int, ends: Ends) -> int:
    """Up to the last end mark before the next document: a file that was saved
    again, or that is made for the web, has several."""
    end = ends.last(b"%%EOF", at, until)
    return end + 5 - at if end > 0 and ends.last(b"startxref", at, end) > 0 else 0


VALIDATORS = {"image/png": _png, "image/bmp": _bmp, "audio/wav": _riff, "image/webp": _riff, "audio/ogg": _ogg}
WALKED = {"image/jpeg": _jpeg, "image/gif": _gif}


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for magic, (kind, before) in SIGNATURES.items():
        out.add_word(magic.decode("latin-1"), (kind, before, len(magic)))
    for mark in MARKS:
        out.add_word(mark.decode("latin-1"), (mark, 0, len(mark)))
    out.make_automaton()
    return out


def located(value: bytes, signs: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """``(offset, length, type)`` of valid media by offset, those inside of others too."""
    ends, hits, again = Ends(), [], {"application/pdf": [], "audio/flac": []}
    for end, (kind, before, n) in signs.iter(value.decode("latin-1")):
        at = end + 1 - n - before
        if isinstance(kind, bytes):
            ends.at[kind].append(at)
        else:
            hits.append((at, kind))
            if kind in again:
                again[kind].append(at)
    out: list[tuple[int, int, str]] = []
    memo: dict[str, dict] = {k: {} for k in WALKED}
    for at, kind in sorted(hits):
        if kind == "application/zip":
            length = _zip(value, at, ends)
        elif kind in again:  # up to the next of its kind at most
            k = bisect_left(again[kind], at + 1)
            until = again[kind][k] if k < len(again[kind]) else len(value)
            length = _pdf(at, until, ends) if kind == "application/pdf" else _flac(value, at, until)
        elif kind in WALKED:
            length = WALKED[kind](value, at, memo[kind])
        else:
            length = VALIDATORS[kind](value, at)
        if length:
            out.append((at, length, kind))
    return out


def sniff(values: DataFrame, id_col: str = "id", bytes_col: str = "media", declared_col: str = "declared") -> DataFrame:
    """One row per input row: id, the bytes, ``type`` (of valid media at the start, else
    ``application/octet-stream``), ``length`` (of those; else 0), ``corrected``
    (the type isn't the declared one), ``embedded`` (array of offset, length
    and type of valid media further on; :func:`carved` cuts them out).

    A null value counts as empty: it is an octet stream of length 0.  A null
    declaration is corrected by any type.  Very long values are walked whole, and what is
    found is told by offsets, three values each.  JPEG and GIF walks that meet are walked once.
    Of two formats at one place the first by name is the type.  Repeated rows
    are treated alike, other columns are ignored, no rows give no rows.
    """
    kind = values.schema[id_col].dataType.simpleString()
    parts = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string())]))

    def run(batches):
        signs = automaton()
        for batch in batches:
            for start in range(0, batch.num_rows, FEW_ROWS):
                rows: dict[str, list] = {"type": [], "length": [], "corrected": [], "embedded": []}
                for value, declared in zip(batch.column(1).slice(start, FEW_ROWS).to_pylist(), batch.column(2).slice(start, FEW_ROWS).to_pylist(), strict=True):
                    found = located(value or b"", signs)
                    whole = found[0] if found and found[0][0] == 0 else (0, 0, "application/octet-stream")
                    rows["type"].append(whole[2])
                    rows["length"].append(whole[1])
                    rows["corrected"].append(whole[2] != declared)
                    rows["embedded"].append([{"offset": a, "length": n, "type": t} for a, n, t in found if a])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, FEW_ROWS), batch.column(1).slice(start, FEW_ROWS), pa.array(rows["type"]), pa.array(rows["length"], pa.int64()), pa.array(rows["corrected"]), pa.array(rows["embedded"], parts)], [id_col, bytes_col, "type", "length", "corrected", "embedded"])

    schema = f"`{id_col}` {kind}, `{bytes_col}` binary, type string, length long, corrected boolean, embedded array<struct<offset:long,length:long,type:string>>"
    return values.select(F.col(id_col), F.col(bytes_col).cast("binary"), F.col(declared_col).cast("string")).mapInArrow(run, schema)


def cut_out(media: Column, offset: Column, length: Column) -> Column:
    """The bytes of one medium."""
    return F.substring(media, (offset + 1).cast("int"), length.cast("int"))


def carved(sniffed: DataFrame, id_col: str = "id", bytes_col: str = "media") -> DataFrame:
    """A row for each embedded medium of :func:`sniff`: id, offset, length, type, ``bytes``.

    Each is cut out in a row of its own, so media inside of media never stand in one value together.
    """
    rows = sniffed.select(id_col, bytes_col, F.explode("embedded").alias("e"))
    return rows.select(id_col, "e.*", cut_out(F.col(bytes_col), F.col("e.offset"), F.col("e.length")).alias("bytes"))


def payload_of(text: Column) -> Column:
    """UTF-8 bytes with blanks up to a positive multiple of UNIT; null is empty."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    length = F.greatest(F.ceil(F.octet_length(raw) / UNIT), F.lit(1)) * UNIT
    return F.rpad(raw, length.cast("int"), F.lit(b" "))


def _little(n: Column, size: int) -> Column:
    """A number as ``size`` bytes, least first."""
    return F.concat(*[F.unhex(F.lpad(F.hex(F.shiftright(n, 8 * k).bitwiseAND(F.lit(255))), 2, "0")) for k in range(size)])


def as_wav(payload: Column, rate: int = 8000) -> Column:
    """The payload as the 8-bit samples of a mono RIFF/WAVE file (an even number of bytes)."""
    n = F.octet_length(payload)
    fmt = F.lit(b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data")
    return F.concat(F.lit(b"RIFF"), _little(n + 36, 4), fmt, _little(n, 4), payload)


def as_bmp(payload: Column) -> Column:
    """The payload as the 8-bit pixels of a grey BMP image, UNIT pixels wide, its first row at the top."""
    n = F.octet_length(payload)
    palette = F.lit(b"".join(bytes((k, k, k, 0)) for k in range(256)))
    rows = (n / UNIT).cast("int")
    return F.concat(F.lit(b"BM"), _little(n + 1078, 4), F.lit(struct.pack("<II", 0, 1078) + struct.pack("<Ii", 40, UNIT)), _little(-rows, 4), F.lit(struct.pack("<HHIIiiII", 1, 8, 0, 0, 2835, 2835, 256, 256)), palette, payload)


def bmp_pixels(media: Column) -> Column:
    """The pixels of an image that :func:`as_bmp` made."""
    return F.substring(media, F.lit(1079), F.octet_length(media) - 1078)


def wav_samples(media: Column) -> Column:
    """The samples of a file that :func:`as_wav` made, by the length in its header."""
    length = sum((F.conv(F.hex(F.substring(media, 41 + k, 1)), 16, 10).cast("long") * (1 << 8 * k) for k in range(4)), F.lit(0))
    return F.substring(media, F.lit(45), length.cast("int"))


def level_features(samples: DataFrame, id_cols: list[str], bytes_col: str) -> DataFrame:
    """The given columns and ``levels``: mean, root mean square and sign changes of 8-bit samples around 128, as text.

    Null and empty samples have the levels ``0.000000:0.000000:0``.
    """
    kept = samples.select(*id_cols, bytes_col)
    schema = T.StructType([*kept.schema.fields, T.StructField("levels", T.StringType())])
    names = schema.fieldNames()

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, FEW_ROWS):
                part, levels = batch.slice(start, FEW_ROWS), []
                for value in part.column(len(names) - 2).to_pylist():
                    x = np.frombuffer(value or b"", np.uint8).astype(np.int64) - 128
                    n = max(len(x), 1)
                    levels.append(f"{x.sum() / n:.6f}:{(int((x * x).sum()) / n) ** 0.5:.6f}:{int(((x[1:] < 0) != (x[:-1] < 0)).sum())}")
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(levels, pa.string())], names)

    return kept.mapInArrow(run, schema)
