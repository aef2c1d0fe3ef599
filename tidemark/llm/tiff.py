"""TIFF as a media column: writing pages, and reading them back as rows.

The reader follows the chain of image directories, undoes PackBits, LZW or
deflate on strips or tiles, then the predictor, and gives each page's
samples. The writer makes the same forms.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import ship

#: Fixed values of the format: compressions, predictors, tags and the sizes of field types.
PLAIN, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
HORIZONTAL, FLOATING = 2, 3
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 284, 317, 322, 323, 324, 325
FIELD = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 16: "Q"}

CLEAR, END = 256, 257
#: Bytes that one stored byte gives at most; the last strip of a page may be shorter than the others.
MOST = {PLAIN: 2, LZW: 8192, DEFLATE: 2064, OLD_DEFLATE: 2064, PACKBITS: 128}


class TiffError(ValueError):
    """What makes a file unreadable."""


def unpackbits(data: bytes, size: int) -> bytes:
    out, at, made = [], 0, 0
    while at < len(data) and made < size:
        n = data[at]
        at += 1
        if n < 128:
            part = data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            part = data[at : at + 1] * (257 - n)
            at += 1
        else:
            continue
        out.append(part)
        made += len(part)
    return b"".join(out)


_RUN = re.compile(rb"(.)\1{2,127}", re.DOTALL)


def packbits(row: bytes) -> bytes:
    out, at = [], 0

    def literal(part: bytes) -> None:
        for k in range(0, len(part), 128):
            piece = part[k : k + 128]
            out.append(bytes((len(piece) - 1,)) + piece)

    for run in _RUN.finditer(row):
        literal(row[at : run.start()])
        out.append(bytes((257 - len(run[0]), run[0][0])))
        at = run.end()
    literal(row[at:])
    return b"".join(out)


def unlzw(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, high bits first, one bit wider one code early."""
    out, made, table, last = [], 0, [], None
    bits = width = held = 0
    width = 9
    first = [bytes((b,)) for b in range(256)] + [b"", b""]
    table = first.copy()
    for byte in data:
        held = held << 8 | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == CLEAR:
            table, width, last = first.copy(), 9, None
            continue
        if code == END or made >= size:
            break
        if last is None:
            if code >= CLEAR:
                raise TiffError("LZW starts with an unknown code")
            entry = table[code]
        else:
            if code < len(table):
                entry = table[code]
            elif code == len(table):
                entry = last + last[:1]
            else:
                raise TiffError("unknown LZW code")
            table.append(last + entry[:1])
        out.append(entry)
        made += len(entry)
        last = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


def lzw(data: bytes) -> bytes:
    out, held, bits, width, following = bytearray(), 0, 0, 9, 258
    table = {bytes((b,)): b for b in range(256)}
    codes: list[tuple[int, int]] = [(CLEAR, 9)]
    word = b""
    for k in range(len(data)):
        longer = word + data[k : k + 1]
        if longer in table:
            word = longer
            continue
        codes.append((table[word], width))
        table[longer] = following
        following += 1
        word = data[k : k + 1]
        width = 9 if following < 512 else 10 if following < 1024 else 11 if following < 2048 else 12
        if following >= 4094:
            codes.append((CLEAR, width))
            table = {bytes((b,)): b for b in range(256)}
            following, width = 258, 9
    if word:
        codes.append((table[word], width))
        following += 1
        width = 9 if following < 512 else 10 if following < 1024 else 11 if following < 2048 else 12
    codes.append((END, width))
    for code, size in codes:
        held = held << size | code
        bits += size
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def _expand(data: bytes, compression: int, size: int) -> bytes:
    if compression == PLAIN:
        out = data
    elif compression in (DEFLATE, OLD_DEFLATE):
        try:
            out = zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise TiffError(f"deflate: {e}") from e
    elif compression == PACKBITS:
        out = unpackbits(data, size)
    elif compression == LZW:
        out = unlzw(data, size)
    else:
        raise TiffError(f"compression {compression}")
    if len(out) < size:
        raise TiffError(f"a segment has {len(out)} of {size} bytes")
    return out[:size]


def _unpredict(data: bytes, shape: tuple[int, int, int], kind: np.dtype, predictor: int) -> np.ndarray:
    rows, columns, samples = shape
    if predictor == FLOATING:
        size = kind.itemsize
        planes = np.cumsum(np.frombuffer(data, np.uint8).reshape(rows, columns * samples * size // samples, samples), axis=1, dtype=np.uint8)
        planes = planes.reshape(rows, size, columns * samples)  # most significant bytes first
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(shape).astype(kind.newbyteorder("="))
    out = np.frombuffer(data, kind).reshape(shape).astype(kind.newbyteorder("="))
    return np.cumsum(out, axis=1, dtype=out.dtype) if predictor == HORIZONTAL else out


@dataclass
class Page:
    number: int
    width: int
    height: int
    samples: int
    bits: int
    compression: int
    predictor: int
    pixels: bytes  #: rows from the top, samples of a pixel together, in the machine's little-endian order


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple] | TiffError, int]:
    """A directory's tags, or why they can't be read, and the place of the next one."""
    try:
        (count,) = struct.unpack_from(order + "H", data, at)
        (after,) = struct.unpack_from(order + "I", data, at + 2 + 12 * count)
        tags = {}
        for k in range(count):
            place = at + 2 + 12 * k
            tag, kind, n = struct.unpack_from(order + "HHI", data, place)
            if kind not in FIELD:
                continue
            form = f"{order}{n}{FIELD[kind]}"
            size = struct.calcsize(form)
            where = place + 8 if size <= 4 else struct.unpack_from(order + "I", data, place + 8)[0]
            if where + size > len(data):
                return TiffError(f"tag {tag} lies outside the file"), after
            tags[tag] = struct.unpack_from(form, data, where)
    except struct.error as e:
        raise TiffError(f"a directory is cut off: {e}") from e
    return tags, after


def read_each(data: bytes) -> Iterator[Page | TiffError]:
    """The pages of a file in the order of its directories; in place of one that can't be read, why."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise TiffError("not a TIFF file")
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen: set[int] = set()
    while at:
        if at in seen:
            raise TiffError("the directories form a ring")
        seen.add(at)
        tags, at = _directory(data, at, order)
        try:
            page = tags if isinstance(tags, TiffError) else _page(data, tags, order, len(seen) - 1)
        except TiffError as e:
            page = e
        except (ValueError, TypeError, IndexError, OverflowError, MemoryError, struct.error, zlib.error) as e:
            page = TiffError(f"a page is damaged: {e}")
        yield page


def read_pages(data: bytes) -> Iterator[Page]:
    """The pages of a file in the order of its directories, up to one that can't be read."""
    for page in read_each(data):
        if isinstance(page, TiffError):
            raise page
        yield page


def _page(data: bytes, tags: dict[int, tuple], order: str, number: int) -> Page:
    one = lambda tag, default=None: tags[tag][0] if tag in tags else default
    width, height, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    bits, compression, predictor = one(BITS, 1), one(COMPRESSION, PLAIN), one(PREDICTOR, 1)
    numbers = [v for tag in (WIDTH, HEIGHT, SAMPLES, TILE_WIDTH, TILE_HEIGHT, ROWS_PER_STRIP) for v in tags.get(tag, ())]
    if not width or not height or not samples or not all(isinstance(v, int) and v > 0 for v in numbers):
        raise TiffError("a page has no size")
    if bits not in (8, 16, 32) or len(set(tags.get(BITS, (8,)))) > 1 or predictor not in (1, HORIZONTAL, FLOATING):
        raise TiffError(f"{bits} bits a sample, predictor {predictor}")
    kind = np.dtype(f"{order}u{bits // 8}")
    separate = one(PLANAR, 1) == 2
    depth, planes = (1, samples) if separate else (samples, 1)
    if TILE_WIDTH in tags:
        across, down = one(TILE_WIDTH), one(TILE_HEIGHT)
        offsets, sizes = tags.get(TILE_OFFSETS, ()), tags.get(TILE_BYTES, ())
    else:
        across, down = width, min(one(ROWS_PER_STRIP, height), height)
        offsets, sizes = tags.get(STRIP_OFFSETS, ()), tags.get(STRIP_BYTES, ())
    if not across or not down:
        raise TiffError("segments have no size")
    columns, rows = -(-width // across), -(-height // down)
    if len(offsets) != columns * rows * planes or len(sizes) != len(offsets):
        raise TiffError(f"{len(offsets)} segments, not {columns * rows * planes}")
    if not all(isinstance(v, int) and v >= 0 for v in (*offsets, *sizes)):
        raise TiffError("a segment has no place")
    if any(begin + size > len(data) for begin, size in zip(offsets, sizes, strict=True)):
        raise TiffError("a segment lies outside the file")
    if columns * rows * planes * down * across * depth * bits // 8 > sum(sizes) * MOST.get(compression, 1):
        raise TiffError("the segments are too short for the page")
    image = np.empty((height, width, samples), kind.newbyteorder("="))
    for k, (begin, size) in enumerate(zip(offsets, sizes, strict=True)):
        plane, place = divmod(k, columns * rows)
        y, x = place // columns * down, place % columns * across
        tall = down if TILE_WIDTH in tags else min(down, height - y)
        raw = _expand(data[begin : begin + size], compression, tall * across * depth * bits // 8)
        part = _unpredict(raw, (tall, across, depth), kind, predictor)
        target = image[y : y + down, x : x + across, plane : plane + 1] if separate else image[y : y + down, x : x + across]
        target[...] = part[: target.shape[0], : target.shape[1]]
    return Page(number, width, height, samples, bits, compression, predictor, image.astype(image.dtype.newbyteorder("<"), copy=False).tobytes())


def write_pages(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = HORIZONTAL, strip_rows: int = 64, tile: tuple[int, int] | None = None, order: str = "<", level: int = 1) -> bytes:
    """A file of unsigned integer pages, each (height, width, samples); ``tile``: (height, width) of tiles."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for image in pages:
        height, width, samples = image.shape
        kind = image.dtype.newbyteorder(order)
        down, across = tile or (min(strip_rows, height), width)
        offsets, sizes = [], []
        for y in range(0, height, down):
            for x in range(0, width, across):
                part = image[y : y + down, x : x + across]
                if tile:
                    part = np.pad(part, ((0, down - part.shape[0]), (0, across - part.shape[1]), (0, 0)), mode="edge")
                if predictor == HORIZONTAL:
                    part = np.diff(part, axis=1, prepend=part[:, :1] * 0)
                rows = np.ascontiguousarray(part.astype(kind))
                raw = rows.tobytes()
                if compression == DEFLATE:
                    raw = zlib.compress(raw, level)
                elif compression == PACKBITS:
                    raw = b"".join(packbits(row.tobytes()) for row in rows)
                elif compression == LZW:
                    raw = lzw(raw)
                offsets.append(len(out))
                sizes.append(len(raw))
                out += raw + b"\0" * (len(raw) % 2)
        fields = [(WIDTH, "I", [width]), (HEIGHT, "I", [height]), (BITS, "H", [8 * image.dtype.itemsize] * samples), (COMPRESSION, "H", [compression]), (PHOTOMETRIC, "H", [2 if samples == 3 else 1])]
        if not tile:
            fields += [(STRIP_OFFSETS, "I", offsets)]
        fields += [(SAMPLES, "H", [samples])]
        if not tile:
            fields += [(ROWS_PER_STRIP, "I", [down]), (STRIP_BYTES, "I", sizes)]
        fields += [(PLANAR, "H", [1]), (PREDICTOR, "H", [predictor])]
        if tile:
            fields += [(TILE_WIDTH, "I", [across]), (TILE_HEIGHT, "I", [down]), (TILE_OFFSETS, "I", offsets), (TILE_BYTES, "I", sizes)]
        entries = []
        for tag, form, values in fields:
            value = struct.pack(f"{order}{len(values)}{form}", *values)
            if len(value) > 4:
                at = len(out)
                out += value + b"\0" * (len(value) % 2)
                value = struct.pack(order + "I", at)
            entries.append(struct.pack(order + "HHI", tag, 3 if form == "H" else 4, len(values)) + value.ljust(4, b"\0"))
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


PAGE_FIELDS = "page int, width int, height int, samples int, bits int, compression int, predictor int, pixels binary, error string"


def tiff_pages(df: DataFrame, content_col: str = "media") -> DataFrame:
    """One row per page of each file in ``content_col``, beside all other columns of the row.

    A narrow pass, in the order of rows and pages. New columns: ``page`` (from
    0), ``width``, ``height``, ``samples``, ``bits``, ``compression``,
    ``predictor``, ``pixels`` (rows from the top, samples of a pixel together,
    little-endian) and ``error``; a column of ``df`` with one of these names
    gives way. A page that can't be read gives a row whose ``error`` says why,
    and so does, behind the pages read so far, a file whose directories can't
    be followed; a null file gives one such row with the error "null", an
    empty table nothing, repeated rows each their pages.
    """
    ship(df.sparkSession)
    new = [f.split()[0] for f in PAGE_FIELDS.split(", ")]
    kept = [c for c in df.columns if c != content_col and c not in new]
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{content_col}`").cast("binary").alias("pixels"))
    fields = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept] + [PAGE_FIELDS])

    def read(batches):
        for batch in batches:
            kinds = [pa.int32()] * 7 + [pa.binary(), pa.string()]
            index: list[int] = []
            rows: list[tuple] = []
            held = 0

            def flush(batch=batch, kinds=kinds):
                columns = [batch.column(k).take(pa.array(index, pa.int64())) for k in range(len(kept))]
                columns += [pa.array(list(c), kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
                return pa.RecordBatch.from_arrays(columns, kept + new)

            for k, content in enumerate(batch.column(len(kept))):
                data, number = content.as_py(), 0
                try:
                    if data is None:
                        raise TiffError("null")
                    for p in read_each(data):
                        index.append(k)
                        number += 1
                        if isinstance(p, TiffError):
                            rows.append((number - 1, None, None, None, None, None, None, None, str(p)))
                            continue
                        rows.append((p.number, p.width, p.height, p.samples, p.bits, p.compression, p.predictor, p.pixels, None))
                        held += len(p.pixels)
                        if held > 1 << 23:
                            yield flush()
                            index, rows, held = [], [], 0
                except TiffError as e:
                    index.append(k)
                    rows.append((number, None, None, None, None, None, None, None, str(e)))
            if rows:
                yield flush()

    return source.mapInArrow(read, fields)


#: Bytes of a payload's row: 192 pixels of three samples.
ROW = 576
#: Rows of a page at most, so that a reader holds at most 576 KB of samples.
PAGE_ROWS = 1024


def payload_of(text: bytes) -> bytes:
    return text + b"\xff" * (-len(text) % ROW or (ROW if not text else 0))


def store(payload: bytes) -> bytes:
    """The payload as a TIFF file of 8-bit RGB rows; its own bytes choose between the forms the reader knows."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, ROW // 3, 3)
    pages = [image[k : k + PAGE_ROWS] for k in range(0, len(image), PAGE_ROWS)]
    form = zlib.crc32(payload) % 16
    if form == 0:
        return write_pages(pages, PACKBITS, 1, order=">")
    if form == 1:
        return write_pages(pages, LZW, HORIZONTAL)
    if form == 2:
        return write_pages(pages, DEFLATE, HORIZONTAL, tile=(16, 64))
    return write_pages(pages, DEFLATE, HORIZONTAL)


def media_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): every text as a TIFF file; null counts as empty."""

    def write(batches):
        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.string()), "").cast(pa.binary())
            step = 512
            for k in range(0, len(texts), step):
                part = texts.slice(k, step)
                files = pa.array([store(payload_of(t.as_py())) for t in part], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, step), pc.binary_length(part).cast(pa.int64()), files], ["id", "n_bytes", "media"])

    ship(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(write, "id long, n_bytes long, media binary")


def media_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row the digests of its text's stored form and of what is read back from it.

    The text (null: empty) and bytes 255 up to a positive multiple of 576 are
    stored losslessly as TIFF, read by ``tiff_pages``, and its pages' samples,
    which follow each other in the stream, are digested page by page: no
    shuffle, and no more than a page beside the file in memory.
    ``feature`` holds the pages, the mean, the deviation and the entropy of
    the samples. Equal texts give equal values, repeated rows each a row, an
    empty table none; a null id stays null.
    """
    files = media_of(df, id_col, text_col).select("id", "n_bytes", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")

    def digest(batches):
        names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        own = None

        def finish(o):
            seen = o["seen"]
            n = int(seen.sum())
            mean = float(seen @ np.arange(256)) / n
            spread = (max(0.0, float(seen @ np.arange(256) ** 2) / n - mean**2)) ** 0.5
            share = seen[seen > 0] / n
            feature = f"pages={o['pages']};mean={mean:.6f};std={spread:.6f};entropy={float(-(share * np.log2(share)).sum()) + 0.0:.6f}"
            return (o["id"], o["n_bytes"], n, o["sha"].hexdigest(), zlib.crc32(o["tail"]), o["media_bytes"], o["media_sha256"], feature)

        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if r["error"] is not None:
                    raise TiffError(r["error"])
                if r["page"] == 0:
                    if own is not None:
                        done.append(finish(own))
                    own = {k: r[k] for k in ("id", "n_bytes", "media_bytes", "media_sha256")} | {"sha": hashlib.sha256(), "tail": b"", "pages": 0, "seen": np.zeros(256, np.int64)}
                own["sha"].update(r["pixels"])
                own["tail"] = (own["tail"] + r["pixels"][-32:])[-32:]
                own["pages"] += 1
                own["seen"] += np.bincount(np.frombuffer(r["pixels"], np.uint8), minlength=256)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*done, strict=True), kinds, strict=True)], names)
        if own is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(finish(own), kinds, strict=True)], names)

    out = tiff_pages(files).mapInArrow(digest, "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return out.withColumnRenamed("id", id_col)
