"""Media columns: TIFF.

`decode` walks the chain of image directories of a file and undoes strips or tiles, PackBits, LZW or deflate, and the
horizontal predictor; `pages` gives one row per page of a binary column. `encode` writes 8-bit greyscale pages. No
page is skipped: a file that cannot be read gives one row whose `error` says why.

Defined cases: a null or empty file gives one row with `error` "empty"; a directory that points back at an earlier one
ends the walk with an error row after the pages before it; equal files give equal rows; an empty table gives no rows.
Very long texts are one page of as many rows as they need, and an image whose header asks for more than the file's
bytes can hold is an error row too.
Extra columns of the input are carried unless they bear a name of the result, which then wins.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the TIFF 6.0 format: bytes of a field type, tags, compression schemes.
FIELD_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8}
FIELD_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 13: "I", 16: "Q", 17: "q", 18: "Q"}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR, TILE_W, TILE_H, TILE_AT, TILE_BYTES, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 339
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
#: Bytes that one stored byte can come to at most, by scheme; LZW codes have 9 bits or more and stand for 4096 bytes or fewer.
EXPANDS = {NONE: 1, PACKBITS: 64, LZW: 4096, DEFLATE: 1032, OLD_DEFLATE: 1032}


class TiffError(ValueError):
    """A file, directory, strip or tile that does not hold what it says."""


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < size:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def pack_bits(row: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(row):
        j = i + 1
        while j < len(row) and j - i < 128 and row[j] == row[i]:
            j += 1
        if j - i > 1:
            out += bytes((257 - (j - i), row[i]))
        else:
            while j < len(row) and j - i < 128 and (j + 1 >= len(row) or row[j] != row[j + 1]):
                j += 1
            out += bytes((j - i - 1,)) + row[i:j]
        i = j
    return bytes(out)


def un_lzw(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, most significant first; the width grows one code early, as the format has it."""
    table: list[bytes] = []
    out, bits, held, width, last, i = bytearray(), 0, 0, 9, None, 0
    while len(out) < size:
        while held < width:
            if i >= len(data):
                return bytes(out)
            bits, held, i = (bits << 8 | data[i]) & 0xFFFFFF, held + 8, i + 1
        code = bits >> (held - width) & ((1 << width) - 1)
        held -= width
        if code == 256:
            table, width, last = [bytes((b,)) for b in range(256)] + [b"", b""], 9, None
            continue
        if code == 257:
            break
        if not table or code > len(table) or (code == len(table) and last is None):
            raise TiffError("an LZW code that is not in the table")
        word = table[code] if code < len(table) else last + last[:1]
        out += word
        if last is not None:
            table.append(last + word[:1])
        last = word
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def lzw(data: bytes) -> bytes:
    out, bits, held = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal bits, held
        bits, held = bits << width | code, held + width
        while held >= 8:
            out.append(bits >> (held - 8) & 255)
            held -= 8
        bits &= (1 << held) - 1

    table, width, word = {bytes((b,)): b for b in range(256)}, 9, b""
    put(256, 9)
    following = 258
    for b in data:
        longer = word + bytes((b,))
        if longer in table:
            word = longer
            continue
        put(table[word], width)
        table[longer] = following
        following += 1
        width = 9 if following < 512 else 10 if following < 1024 else 11 if following < 2048 else 12
        if following == 4094:
            put(256, width)
            table, width, following = {bytes((b,)): b for b in range(256)}, 9, 258
        word = bytes((b,))
    if word:
        put(table[word], width)
        following += 1
        width = 9 if following < 512 else 10 if following < 1024 else 11 if following < 2048 else 12
    put(257, width)
    if held:
        out.append(bits << (8 - held) & 255)
    return bytes(out)


def _directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    if len(data) < 8 or data[:2] not in (b"II", b"MM"):
        raise TiffError("no TIFF header")
    e = "<" if data[:2] == b"II" else ">"
    magic = struct.unpack_from(e + "H", data, 2)[0]
    if magic not in (42, 43):
        raise TiffError("no TIFF header")
    big = magic == 43
    word, entry, count_code = ("Q", 20, "Q") if big else ("I", 12, "H")
    at = struct.unpack_from(e + word, data, 8 if big else 4)[0]
    seen = set()
    try:
        while at:
            if at in seen:
                raise TiffError("the directories form a ring")
            seen.add(at)
            n = struct.unpack_from(e + count_code, data, at)[0]
            at += 8 if big else 2
            tags = {}
            for k in range(n):
                tag, kind, count = struct.unpack_from(e + "HH" + word, data, at + k * entry)
                size, where = FIELD_BYTES.get(kind, 1) * count, at + k * entry + (12 if big else 8)
                if size > (8 if big else 4):
                    where = struct.unpack_from(e + word, data, where)[0]
                if where + size > len(data):
                    raise TiffError("a field lies outside the file")
                tags[tag] = struct.unpack_from(f"{e}{count}{FIELD_CODES[kind]}", data, where) if kind in FIELD_CODES else (data[where : where + size],)
            yield e, tags
            at = struct.unpack_from(e + word, data, at + n * entry)[0]
    except struct.error as x:
        raise TiffError("a directory lies outside the file") from x


def _block(data: bytes, scheme: int, size: int) -> bytes:
    if scheme == NONE:
        out = data
    elif scheme == PACKBITS:
        out = unpack_bits(data, size)
    elif scheme == LZW:
        out = un_lzw(data, size)
    else:
        try:
            out = zlib.decompressobj().decompress(data, size)
        except zlib.error as x:
            raise TiffError("a deflate stream is broken") from x
    if len(out) < size:
        raise TiffError("a strip or tile is too short")
    return out[:size]


def _image(data: bytes, e: str, tags: dict[int, tuple]) -> np.ndarray:
    one = lambda tag, default=None: tags[tag][0] if tag in tags else default
    w, h, samples, bits = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), tags.get(BITS, (1,))
    if not w or not h:
        raise TiffError("a page without width or height")
    if len(set(bits)) > 1 or bits[0] not in (1, 2, 4, 8, 16, 32, 64):
        raise TiffError(f"{bits} bits a sample are not known")
    bits, planar, tiled = bits[0], one(PLANAR, 1) == 2 and samples > 1, TILE_AT in tags
    tw, th = (one(TILE_W), one(TILE_H)) if tiled else (w, min(one(ROWS_PER_STRIP, h), h))
    places, sizes = tags.get(TILE_AT if tiled else STRIP_AT), tags.get(TILE_BYTES if tiled else STRIP_BYTES)
    if not tw or not th or places is None or sizes is None or len(places) != len(sizes):
        raise TiffError("a page without strips or tiles")
    if one(COMPRESSION, 1) not in EXPANDS:
        raise TiffError(f"compression {one(COMPRESSION, 1)} is not known")
    if w * h * samples * bits > 8 * len(data) * EXPANDS[one(COMPRESSION, 1)] or tiled and tw * th > w * h + (tw + th) * 4096:
        raise TiffError("a page larger than its file can hold")
    here = 1 if planar else samples
    kind = np.dtype({1: "u1", 2: "u1", 4: "u1", 8: "u1", 16: e + "u2", 32: e + ("f4" if one(FORMAT) == 3 else "u4"), 64: e + ("f8" if one(FORMAT) == 3 else "u8")}[bits])
    out = np.zeros((h, w, samples), kind.newbyteorder("="))
    across, down = -(-w // tw), -(-h // th)
    if len(places) < across * down * (samples if planar else 1):
        raise TiffError("strips or tiles are missing")
    for k in range(across * down * (samples if planar else 1)):
        plane, spot = divmod(k, across * down)
        y, x = spot // across * th, spot % across * tw
        rows = th if tiled else min(th, h - y)
        row_bytes = -(-tw * here * bits // 8)
        raw = _block(data[places[k] : places[k] + sizes[k]], one(COMPRESSION, 1), rows * row_bytes)
        if bits < 8:
            grid = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(rows, row_bytes), axis=1).reshape(rows, -1, bits)
            block = (grid * (1 << np.arange(bits - 1, -1, -1))).sum(2).astype(np.uint8)[:, : tw * here].reshape(rows, tw, here)
        else:
            block = np.frombuffer(raw, kind).reshape(rows, tw, here).astype(kind.newbyteorder("="))
        predictor = one(PREDICTOR, 1)
        if predictor == 2 and block.dtype.kind == "u" and bits >= 8:
            block = np.cumsum(block, axis=1, dtype=block.dtype)
        elif predictor != 1:
            raise TiffError(f"predictor {predictor} is not known for these samples")
        part = block[: h - y, : w - x]
        out[y : y + part.shape[0], x : x + part.shape[1], plane : plane + 1 if planar else samples] = part
    return out


def decode(data: bytes) -> Iterator[tuple[dict[int, tuple], np.ndarray]]:
    """(tags, rows x columns x samples) of each page."""
    for e, tags in _directories(data):
        yield tags, _image(data, e, tags)


def encode(images: list[np.ndarray], scheme: int = DEFLATE, predictor: int = 1, rows_per_strip: int | None = None, tile: tuple[int, int] | None = None, order: str = "<", level: int = 1) -> bytes:
    """8-bit images (rows x columns [x samples]) as pages of one file."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for image in images:
        a = image if image.ndim == 3 else image[:, :, None]
        h, w, samples = a.shape
        blocks = []
        if tile:
            th, tw = tile
            for y in range(0, h, th):
                for x in range(0, w, tw):
                    block = np.zeros((th, tw, samples), np.uint8)
                    part = a[y : y + th, x : x + tw]
                    block[: part.shape[0], : part.shape[1]] = part
                    blocks.append(block)
        else:
            step = rows_per_strip or h
            blocks = [a[y : y + step] for y in range(0, h, step)]
        places, sizes = [], []
        for block in blocks:
            if predictor == 2:
                block = np.diff(block, axis=1, prepend=np.zeros((block.shape[0], 1, samples), np.uint8))
            raw = block.tobytes()
            if scheme == DEFLATE:
                raw = zlib.compress(raw, level)
            elif scheme == LZW:
                raw = lzw(raw)
            elif scheme == PACKBITS:
                width = block.shape[1] * samples
                raw = b"".join(pack_bits(raw[i : i + width]) for i in range(0, len(raw), width))
            places.append(len(out))
            sizes.append(len(raw))
            out += raw + b"\0" * (len(raw) % 2)
        fields = {WIDTH: (4, [w]), HEIGHT: (4, [h]), BITS: (3, [8] * samples), COMPRESSION: (3, [scheme]), PHOTOMETRIC: (3, [2 if samples == 3 else 1]), SAMPLES: (3, [samples]), PLANAR: (3, [1]), PREDICTOR: (3, [predictor])}
        fields |= {TILE_W: (4, [tile[1]]), TILE_H: (4, [tile[0]]), TILE_AT: (4, places), TILE_BYTES: (4, sizes)} if tile else {STRIP_AT: (4, places), ROWS_PER_STRIP: (4, [rows_per_strip or h]), STRIP_BYTES: (4, sizes)}
        entries = b""
        for tag, (kind, values) in sorted(fields.items()):
            value = struct.pack(f"{order}{len(values)}{FIELD_CODES[kind]}", *values)
            if len(value) > 4:
                spot = len(out)
                out += value + b"\0" * (len(value) % 2)
                value = struct.pack(order + "I", spot)
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + value.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        link = len(out) + 2 + len(entries)
        out += struct.pack(order + "H", len(fields)) + entries + struct.pack(order + "I", 0)
    return bytes(out)


PAGE = "page int, width int, height int, samples int, bits int, compression int, predictor int, tiled boolean, pixels binary, mean double, deviation double, entropy double, error string"


def features(a: np.ndarray) -> tuple[float, float, float]:
    """Mean, standard deviation and entropy in bits of 256 equal classes of the sample values."""
    flat = a.reshape(-1)
    if flat.dtype != np.uint8:
        low, high = float(flat.min()), float(flat.max())
        flat = np.zeros(len(flat), np.uint8) if low == high else ((flat.astype(float) - low) * (255 / (high - low))).astype(np.uint8)
    counts = np.bincount(flat, minlength=256)
    p = counts[counts > 0] / len(flat)
    mean = float(counts @ np.arange(256)) / len(flat)
    return mean, float(counts @ (np.arange(256) - mean) ** 2 / len(flat)) ** 0.5, float(-(p * np.log2(p)).sum())


def page_rows(data: bytes | None) -> Iterator[tuple]:
    n = 0
    try:
        if not data:
            raise TiffError("empty")
        for tags, a in decode(data):
            yield (n, a.shape[1], a.shape[0], a.shape[2], tags.get(BITS, (1,))[0], tags.get(COMPRESSION, (1,))[0], tags.get(PREDICTOR, (1,))[0], TILE_AT in tags, a.tobytes(), *features(a), None)
            n += 1
    except (ValueError, IndexError, OverflowError, MemoryError, struct.error) as x:  # TiffError is a ValueError
        yield (n, *[None] * 11, str(x) or type(x).__name__)


def pages(df: DataFrame, media: str, keep: list[str]) -> DataFrame:
    """One row per page of the TIFF files in column `media`, with the columns `keep`."""
    names = [c.split()[0] for c in PAGE.split(", ")]
    keep = [c for c in keep if c not in names]
    schema = T.StructType([df.schema[c] for c in keep] + T._parse_datatype_string(PAGE).fields)
    source = df.select(*[F.col(c) for c in keep], F.col(media).alias("__media"))

    def run(batches):
        kinds = None
        for batch in batches:
            kinds = kinds or [pa.int32()] * 7 + [pa.bool_(), pa.binary()] + [pa.float64()] * 3 + [pa.string()]
            media_col, at, rows, held = batch.column(len(keep)), [], [], 0
            for i in range(batch.num_rows):
                for row in page_rows(media_col[i].as_py()):
                    at.append(i)
                    rows.append(row)
                    held += len(row[8] or b"")
                if rows and (held > 1 << 24 or i == batch.num_rows - 1):
                    taken = batch.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([*taken.columns[: len(keep)], *(pa.array(list(c), k) for c, k in zip(zip(*rows), kinds))], names=[*keep, *names])
                    at, rows, held = [], [], 0

    return source.mapInArrow(run, schema)


def with_media(df: DataFrame, text: str = "text", name: str = "media", width: int = 64, scheme: int = DEFLATE, predictor: int = 1) -> DataFrame:
    """df with its text as a one-page 8-bit TIFF of `width` columns: the UTF-8 bytes (null: none), then zeros up to a
    positive multiple of `width`."""
    schema = T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, T.BinaryType())])
    kept = [f.name for f in schema.fields[:-1]]

    def run(batches):
        for batch in batches:
            col, made = batch.column(batch.schema.get_field_index(text)), []
            for s in col:
                raw = (s.as_py() or "").encode()
                raw += b"\0" * (width if not raw else -len(raw) % width)
                made.append(encode([np.frombuffer(raw, np.uint8).reshape(-1, width)], scheme, predictor))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(made, pa.binary())], names=[*kept, name])

    return df.mapInArrow(run, schema)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(media: DataFrame, width: int = 64) -> DataFrame:
    """Of (doc_id, n_bytes, media): what the decoded page and the stored bytes come to; for a page that cannot be read
    its payload's columns are null and the feature says why."""
    page = pages(media.withColumn("stored", F.col("media")), "media", ["doc_id", "n_bytes", "stored"])

    def run(batches):
        for b in batches:
            c = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            rows = []
            for i in range(b.num_rows):
                raw, stored = c["pixels"][i].as_py(), c["stored"][i].as_py()
                if raw is None:
                    kept = (None, None) if stored is None else (len(stored), hashlib.sha256(stored).hexdigest())
                    rows.append((None, None, None, *kept, f"error: {c['error'][i]}"))
                    continue
                rows.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-width:]), len(stored), hashlib.sha256(stored).hexdigest(), f"{c['width'][i]}x{c['height'][i]} mean={c['mean'][i].as_py():.4f} sd={c['deviation'][i].as_py():.4f} entropy={c['entropy'][i].as_py():.4f}"))
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([c["doc_id"], c["n_bytes"], *(pa.array(list(x), k) for x, k in zip(cols, [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]))], names=[x.split()[0] for x in DIGEST.split(", ")])

    return page.mapInArrow(run, DIGEST)
