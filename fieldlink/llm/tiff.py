"""Operator 8: media columns, TIFF.

read() walks a file's image directories, decodes each strip or tile (none,
PackBits, LZW, deflate), undoes the horizontal predictor and gives one row per
page. It reads 1, 2, 4, 8 and 16 bits a sample, samples side by side or in planes, of
either byte order. write() makes such files from payloads: 8-bit grey pages 64 samples
wide, PAGE_ROWS high but for the last.

Payload: a text's UTF-8 bytes with zeros appended up to a positive multiple of
64; a null text is empty, so one row of zeros. Codec, predictor and whether pages
have strips or tiles depend on the payload's crc32 alone, so texts of all lengths meet
all of them, and equal texts give equal files.

A file that is not TIFF, is cut short or claims sizes that it can't hold gives the
pages before the fault and a row with the error, without samples; sizes are held
against the file before memory is taken for them. Repeated rows each get a row, an
empty table none. Further columns pass through; one that is named like a result comes
back as doc_<name>.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructType, _parse_datatype_string

from . import common

WIDTH = 64
#: TIFF tags and compression numbers (fixed values).
TAGS = {"width": 256, "height": 257, "bits": 258, "compression": 259, "photometric": 262, "offsets": 273, "samples": 277, "rows": 278, "counts": 279, "planar": 284, "predictor": 317, "tile_width": 322, "tile_height": 323, "tile_offsets": 324, "tile_counts": 325}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: Type number: (bytes, struct code).
TYPES = {1: (1, "B"), 2: (1, "B"), 3: (2, "H"), 4: (4, "I"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i")}


def packbits_decode(data: bytes, size: int) -> bytes:
    out, at, end = bytearray(), 0, len(data)
    while at < end and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out[:size])


def packbits_encode(data: bytes) -> bytes:
    """Runs of three or more bytes as runs, all else as literals."""
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return b""
    edges = np.concatenate([[0], np.flatnonzero(np.diff(a)) + 1, [len(a)]])
    long = np.flatnonzero(np.diff(edges) >= 3)
    out, at = bytearray(), 0

    def literal(until: int) -> None:
        nonlocal at
        while at < until:
            n = min(128, until - at)
            out.append(n - 1)
            out.extend(data[at : at + n])
            at += n

    for i in long.tolist():
        start, end = int(edges[i]), int(edges[i + 1])
        literal(start)
        while at < end:
            n = min(128, end - at)
            if n == 1:
                out.extend((0, data[at]))
            else:
                out.extend((257 - n, data[at]))
            at += n
    literal(len(a))
    return bytes(out)


def _widths(n: int, early: int) -> np.ndarray:
    """Bits of the codes after a clear code: the table has 258 entries, then one more for each code, and codes widen `early` entries before it is full."""
    return np.clip(np.floor(np.log2(258 + np.arange(n) + early)).astype(np.int64) + 1, 9, 12)


#: The most codes between two clear codes: the table ends at 4094 entries.
RUN = 4096 - 258
READ_WIDTHS = _widths(RUN + 2, 0)
READ_ENDS = np.cumsum(READ_WIDTHS)


def lzw_decode(data: bytes, size: int) -> bytes:
    """TIFF's LZW: most significant bit first, codes widen one code early. Codes between clear codes are cut out by numpy at once; the table grows by a step a code."""
    raw, at, out, length = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.uint32), 0, [], 0
    bits, start = 8 * len(data), [bytes([i]) for i in range(256)] + [b"", b""]
    while length < size:
        # the first code after a clear code makes no entry, so the reader's table is one behind the writer's
        ends = at + READ_ENDS
        n = int(np.searchsorted(ends, bits, "right"))
        if not n:
            break
        place, width = ends[:n] - READ_WIDTHS[:n], READ_WIDTHS[:n]
        byte = place >> 3
        window = raw[byte] << 16 | raw[byte + 1] << 8 | raw[byte + 2]
        codes = (window >> (24 - (place & 7) - width).astype(np.uint32)) & ((1 << width) - 1).astype(np.uint32)
        stops = np.flatnonzero((codes == 256) | (codes == 257))
        stop = int(stops[0]) if len(stops) else n
        table, last = start.copy(), None
        for code in codes[:stop].tolist():
            if last is None:
                entry = table[code]
            else:
                if code > len(table):
                    raise ValueError("an LZW code beyond the table")
                entry = table[code] if code < len(table) else last + last[:1]
                table.append(last + entry[:1])
            out.append(entry)
            length += len(entry)
            last = entry
            if length >= size:
                break
        if not len(stops) or codes[stop] == 257:
            break
        at = int(ends[stop])
    return b"".join(out)[:size]


def lzw_encode(data: bytes) -> bytes:
    codes, runs, table, following, prefix = [256], [], {}, 258, -1
    get = table.get
    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        key = prefix << 8 | byte
        code = get(key)
        if code is not None:
            prefix = code
            continue
        codes.append(prefix)
        table[key] = following
        following += 1
        if following == 4094:
            codes.append(256)
            runs.append(codes)
            codes, table, following = [], {}, 258
            get = table.get
        prefix = byte
    if prefix >= 0:
        codes.append(prefix)
    codes.append(257)
    runs.append(codes)
    spread = []
    for i, run in enumerate(runs):
        # the first run begins with a clear code of 9 bits; each code but it counts as an entry of the writer's table
        width = _widths(len(run), 0) if i else np.concatenate([[9], _widths(len(run) - 1, 0)])
        spread.append((np.array(run, np.int64), width))
    values, width = np.concatenate([v for v, _ in spread]), np.concatenate([w for _, w in spread])
    bits = (values[:, None] >> (width[:, None] - 1 - np.arange(12))) & 1
    return np.packbits(bits.astype(np.uint8)[np.arange(12) < width[:, None]]).tobytes()


def decompress(data: bytes, compression: int, size: int) -> bytes:
    """At most `size` bytes of a strip or tile."""
    if compression == NONE:
        return data[:size]
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size) if size else b""
    if compression == PACKBITS:
        return packbits_decode(data, size)
    if compression == LZW:
        return lzw_decode(data, size)
    raise ValueError(f"compression {compression}")


def compress(data: bytes, compression: int) -> bytes:
    if compression == DEFLATE:
        return zlib.compress(data, 6)
    return {NONE: bytes, PACKBITS: packbits_encode, LZW: lzw_encode}[compression](data)


def directories(data: bytes):
    """(byte order, tags) of each image directory in the order of their links."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("directories form a circle")
        seen.add(at)
        tags, (n,) = {}, struct.unpack_from(order + "H", data, at)
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if kind in TYPES:
                size, code = TYPES[kind]
                if size * count > len(data):
                    raise ValueError("a tag is longer than the file")
                place = at + 10 + 12 * i if size * count <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
                tags[tag] = struct.unpack_from(f"{order}{count}{code}", data, place)
        yield order, tags
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


#: The most bytes that a byte of a file can stand for, by compression: a run of 128 from two bytes; 4,096 from an LZW code of 9 bits; 1,032 by deflate's format.
EXPANSION = {NONE: 1, PACKBITS: 64, LZW: 3641, DEFLATE: 1032, OLD_DEFLATE: 1032}


def _samples(raw: bytes, rows: int, wide: int, samples: int, bits: int, order: str) -> np.ndarray:
    """Rows of whole bytes as (rows, wide, samples)."""
    if bits < 8:
        line = -(-wide * samples * bits // 8)
        flat = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(rows, line), axis=1)[:, : wide * samples * bits].reshape(rows, wide, samples, bits)
        return (flat << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(3, dtype=np.uint8)
    kind = np.dtype(np.uint8) if bits == 8 else np.dtype(f"{order}u2")
    return np.frombuffer(raw, kind).reshape(rows, wide, samples).astype(kind.newbyteorder("="))


def page(data: bytes, tags: dict, order: str = "<") -> np.ndarray:
    """The samples of a page as (height, width, samples): 8 bits each, or 16 if stored so. ValueError if the file can't hold what it claims."""
    get = lambda name, default=None: tags.get(TAGS[name], (default,))[0]
    width, height, samples, compression, predictor = get("width"), get("height"), get("samples", 1), get("compression", NONE), get("predictor", 1)
    depths = set(tags.get(TAGS["bits"], (1,)))
    bits = max(depths)
    if len(depths) != 1 or bits not in (1, 2, 4, 8, 16) or get("planar", 1) not in (1, 2) or predictor not in (1, 2) or (predictor == 2 and bits < 8):
        raise ValueError("samples of 1, 2, 4, 8 or 16 bits, with no or the horizontal predictor, are read")
    if compression not in EXPANSION:
        raise ValueError(f"compression {compression}")
    tiled = TAGS["tile_offsets"] in tags
    wide, high = (get("tile_width"), get("tile_height")) if tiled else (width, min(get("rows", height) or height, height))
    if min(width, height, samples, wide, high) < 1:
        raise ValueError("a width, height or number of samples of 0")
    places, sizes = (tags[TAGS[x]] for x in (("tile_offsets", "tile_counts") if tiled else ("offsets", "counts")))
    planes, each = (samples, 1) if get("planar", 1) == 2 else (1, samples)
    across, down = -(-width // wide), -(-height // high)
    if len(places) != planes * across * down or len(sizes) != len(places):
        raise ValueError(f"{len(places)} strips or tiles for {planes * across * down} places")
    line = -(-wide * each * bits // 8)
    needs = lambda k: (high if tiled else min(high, height - k // across % down * high)) * line
    for k, (place, size) in enumerate(zip(places, sizes)):
        if place + size > len(data) or size * EXPANSION[compression] < needs(k):
            raise ValueError("a strip or tile is cut short")
    out = np.zeros((height, width, samples), np.uint8 if bits <= 8 else np.uint16)
    for k, (place, size) in enumerate(zip(places, sizes)):
        plane, at = divmod(k, across * down)
        top, left = at // across * high, at % across * wide
        raw = decompress(data[place : place + size], compression, needs(k))
        if len(raw) < needs(k):
            raise ValueError("a strip or tile is cut short")
        block = _samples(raw, needs(k) // line, wide, each, bits, order)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=block.dtype)
        out[top : top + high, left : left + wide, plane : plane + each] = block[: height - top, : width - left]
    return out


def tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, rows: int = 1024, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """A file of 8-bit pages (height, width, samples), in strips of `rows` or in tiles (height, width)."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for p in pages:
        height, width, samples = p.shape
        if tile:
            high, wide = tile
            blocks = [np.pad(b, ((0, high - b.shape[0]), (0, wide - b.shape[1]), (0, 0))) for y in range(0, height, high) for x in range(0, width, wide) for b in [p[y : y + high, x : x + wide]]]
        else:
            blocks = [p[y : y + rows] for y in range(0, height, rows)]
        places, sizes = [], []
        for b in blocks:
            if predictor == 2:
                b = np.concatenate([b[:, :1], np.diff(b, axis=1)], axis=1)
            raw = compress(np.ascontiguousarray(b).tobytes(), compression)
            places.append(len(out))
            sizes.append(len(raw))
            out += raw + b"\0" * (len(raw) % 2)
        own = {"width": (4, [width]), "height": (4, [height]), "bits": (3, [8] * samples), "compression": (3, [compression]), "photometric": (3, [1 if samples < 3 else 2]), "samples": (3, [samples]), "planar": (3, [1]), "predictor": (3, [predictor])}
        own |= {"tile_width": (4, [tile[1]]), "tile_height": (4, [tile[0]]), "tile_offsets": (4, places), "tile_counts": (4, sizes)} if tile else {"rows": (4, [rows]), "offsets": (4, places), "counts": (4, sizes)}
        entries = bytearray()
        for name, (kind, values) in sorted(own.items(), key=lambda x: TAGS[x[0]]):
            size, code = TYPES[kind]
            raw = struct.pack(f"{order}{len(values)}{code}", *values)
            if len(raw) > 4:
                at, raw_ = len(out), raw
                out += raw_ + b"\0" * (len(raw_) % 2)
                raw = struct.pack(order + "I", at)
            entries += struct.pack(order + "HHI", TAGS[name], kind, len(values)) + raw.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(own)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def padded(raw: bytes) -> bytes:
    """A payload: raw and zeros up to a positive multiple of WIDTH."""
    return raw + b"\0" * (max(1, -(-len(raw) // WIDTH)) * WIDTH - len(raw))


#: How a payload is stored, by its crc32: (compression, predictor, tile).
FORMS = [(DEFLATE, 2, None), (LZW, 1, None), (PACKBITS, 1, (16, 64)), (DEFLATE, 1, (64, 32)), (LZW, 2, (32, 64)), (NONE, 2, None)]
PAGE_ROWS = 512


def media_of(payload: bytes, page_rows: int = PAGE_ROWS, forms: list = FORMS) -> bytes:
    """The file for a payload: pages of `page_rows` rows, in the form that the payload's crc32 picks."""
    whole = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, 1)
    compression, predictor, tile = forms[zlib.crc32(payload) % len(forms)]
    return tiff([whole[i : i + page_rows] for i in range(0, len(whole), page_rows)], compression, predictor, rows=128, tile=tile)


def _feature(samples: np.ndarray) -> str:
    """Mean, spread, row change and an 8-bin histogram of a page, as text."""
    flat = samples.reshape(-1)
    n, low = len(flat), flat >> (5 if flat.dtype == np.uint8 else 13)
    total = int(np.add.reduce(flat, dtype=np.int64))
    square = int(np.einsum("i,i->", flat, flat, dtype=np.int64))
    change = int(np.abs(np.diff(samples.astype(np.int32), axis=1)).sum(dtype=np.int64)) if samples.shape[1] > 1 else 0
    counts = np.bincount(low, minlength=8)
    return f"{total / n:.4f};{(square / n - (total / n) ** 2) ** 0.5:.4f};{change / n:.4f};" + ",".join(map(str, counts.tolist()))


PAGE = "page int, width int, height int, samples int, compression int, predictor int, pixels binary, feature string, error string"


def read_pages(media: bytes | None) -> list[dict]:
    """Pages of a file as dicts of PAGE's fields; on an error, what was read before and a last row with the error."""
    out: list[dict] = []
    try:
        for n, (order, tags) in enumerate(directories(media or b"")):
            p = page(media, tags, order)
            get = lambda name: int(tags.get(TAGS[name], (1,))[0])  # noqa: B023,E731
            out.append({"page": n, "width": p.shape[1], "height": p.shape[0], "samples": p.shape[2], "compression": get("compression"), "predictor": get("predictor"), "pixels": p.tobytes(), "feature": _feature(p), "error": None})
        if not out:
            raise ValueError("no image directory")
    except (ValueError, KeyError, TypeError, IndexError, OverflowError, struct.error, zlib.error) as e:
        out.append({"page": len(out), "error": f"{type(e).__name__}: {e}"[:200]})
    return out


def write(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, with n_bytes (of the text) and `media` (its file)."""
    rest = common.cleared(docs.drop(text), ("n_bytes", "media"))
    schema, n = rest.schema, len(rest.columns)

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, "_text"):
                texts = [(t or "").encode("utf-8") for t in part.column("_text").to_pylist()]
                media = [media_of(padded(t)) for t in texts]
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(list(map(len, texts)), pa.int64()), pa.array(media, pa.binary())], names=[*schema.names, "n_bytes", "media"])

    given = docs.select(*(F.col(f"`{c}`").alias(new) for c, new in zip(docs.drop(text).columns, schema.names)), F.col(f"`{text}`").alias("_text"))
    return given.mapInArrow(run, StructType([*schema]).add("n_bytes", LongType()).add("media", BinaryType()))


def pages(files: DataFrame, media: str = "media") -> DataFrame:
    """files with `pages`: an array of a struct for each page."""
    kind = ArrayType(_parse_datatype_string(PAGE))
    own = common.cleared(files, ["pages"] if media != "pages" else [])
    schema = own.schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = to_arrow_type(kind)
        for batch in batches:
            # a stored byte may hold a thousand samples, so rows leave by what they decode to
            made, start, size = [], 0, 0
            for i, stored in enumerate(batch.column(media)):
                made.append(read_pages(stored.as_py()))
                size += sum(len(p.get("pixels", b"")) for p in made[-1])
                if size >= common.SLICE_BYTES or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*batch.slice(start, len(made)).columns, pa.array(made, type=arrow)], names=[*schema.names, "pages"])
                    made, start, size = [], i + 1, 0

    return own.mapInArrow(run, StructType([*schema]).add("pages", kind))


def read(files: DataFrame, media: str = "media") -> DataFrame:
    """One row per page: the columns of files but the media, and PAGE's fields. A file without a page gives a row with its error."""
    opened = pages(files, media)
    fields = [f.name for f in _parse_datatype_string(PAGE)]
    rest = common.cleared(opened.drop(media, "pages"), fields).columns
    kept = [F.col(f"`{c}`").alias(new) for c, new in zip(opened.drop(media, "pages").columns, rest)]
    return opened.select(*kept, F.inline("pages"))
