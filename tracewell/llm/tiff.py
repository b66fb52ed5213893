"""Media columns: TIFF files read to one row for each page, and written.

The reader walks the chain of image directories of a classic or big TIFF of either byte order,
decodes strips or tiles stored plain or by PackBits, LZW or deflate, undoes horizontal and
floating-point predictors, and puts tiles and planes together. Sizes that a file states are checked
against a bound before anything is allocated.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracewell.llm._text import bounded_batches, slices, tidy

#: Fixed values of the TIFF 6.0 format: tags, bytes of the field types, kinds of compression.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 317, 322, 323, 324, 325, 339
TYPE_CODES = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
PAGE_BYTES = 256 << 20  # the most that a decoded page, a strip or a tile may take, so that a task's memory is bounded


class TiffError(ValueError):
    """A file that is no TIFF, is cut short, or uses what this reader doesn't."""


def unpack_bits(data: bytes, most: int | None = None) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and (most is None or len(out) < most):
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, at, literal = bytearray(), 0, bytearray()

    def flush():
        for k in range(0, len(literal), 128):
            part = literal[k : k + 128]
            out.append(len(part) - 1)
            out.extend(part)
        literal.clear()

    while at < len(data):
        run = 1
        while run < 128 and at + run < len(data) and data[at + run] == data[at]:
            run += 1
        if run > 2:
            flush()
            out += bytes((257 - run, data[at]))
        else:
            literal += data[at : at + run]
        at += run
    flush()
    return bytes(out)


def unpack_lzw(data: bytes, most: int | None = None) -> bytes:
    """Most significant bits first, 9 to 12 bits a code, widened one code early; 256 clears, 257 ends."""
    out, made, table, width, held, bits = [], 0, [], 9, 0, 0
    base, before = [bytes([i]) for i in range(256)] + [b"", b""], b""
    table = list(base)
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, before = list(base), 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and before:
            entry = before + before[:1]
        else:
            raise TiffError("a code beyond the LZW table")
        out.append(entry)
        made += len(entry)
        if most is not None and made >= most:
            break
        if before and len(table) < 4096:
            table.append(before + entry[:1])
        before = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


def pack_lzw(data: bytes) -> bytes:
    codes: list[tuple[int, int]] = []
    table, width = {bytes([i]): i for i in range(256)}, 9
    codes.append((256, 9))
    held = b""
    size = 258
    for i in range(len(data)):
        longer = held + data[i : i + 1]
        if longer in table:
            held = longer
            continue
        codes.append((table[held], width))
        table[longer] = size
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        if size == 4094:
            codes.append((256, width))
            table, size, width = {bytes([j]): j for j in range(256)}, 258, 9
        held = data[i : i + 1]
    if held:
        codes.append((table[held], width))
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    codes.append((257, width))
    out, value, bits = bytearray(), 0, 0
    for code, wide in codes:
        value, bits = value << wide | code, bits + wide
        while bits >= 8:
            bits -= 8
            out.append(value >> bits)
            value &= (1 << bits) - 1
    if bits:
        out.append(value << (8 - bits) & 255)
    return bytes(out)


def _inflate(data: bytes, most: int) -> bytes:
    try:
        return zlib.decompressobj().decompress(data, max(most, 1))
    except zlib.error as e:
        raise TiffError(f"deflate: {e}") from e


def _decode(data: bytes, kind: int, size: int) -> bytes:
    if kind == PLAIN:
        out = data
    elif kind == LZW:
        out = unpack_lzw(data, size)
    elif kind in (DEFLATE, OLD_DEFLATE):
        out = _inflate(data, size)
    elif kind == PACKBITS:
        out = unpack_bits(data, size)
    else:
        raise TiffError(f"compression {kind}")
    if len(out) < size:
        raise TiffError("a strip or tile is cut short")
    return out[:size]


class _File:
    def __init__(self, data: bytes):
        self.data = data
        marks = {b"II": "<", b"MM": ">"}
        if len(data) < 8 or data[:2] not in marks:
            raise TiffError("no TIFF")
        self.order = marks[data[:2]]
        version = self.read("H", 2)[0]
        if version == 42:
            self.big, self.first = False, self.read("I", 4)[0]
        elif version == 43 and len(data) >= 16:
            self.big, self.first = True, self.read("Q", 8)[0]
        else:
            raise TiffError("no TIFF")

    def read(self, code: str, at: int, n: int = 1) -> tuple:
        if at < 0 or at + n * struct.calcsize(f"={code}") > len(self.data):
            raise TiffError("the file is cut short")
        return struct.unpack_from(f"{self.order}{n}{code}", self.data, at)

    def directories(self) -> Iterator[dict[int, tuple]]:
        at, seen = self.first, set()
        word, entry, inner = ("Q", 20, 8) if self.big else ("I", 12, 4)
        while at:
            if at in seen:
                raise TiffError("the directories form a circle")
            seen.add(at)
            n = self.read("Q" if self.big else "H", at)[0]
            begin = at + (8 if self.big else 2)
            if begin + n * entry > len(self.data):
                raise TiffError("the file is cut short")
            tags: dict[int, tuple | TiffError] = {}
            for k in range(n):
                here = begin + k * entry
                tag, kind = self.read("H", here, 2)
                count = self.read(word, here + 4)[0]
                value_at = here + 4 + inner
                if kind in (5, 10):  # rationals: two numbers
                    code, count = "Ii"[kind == 10], count * 2
                elif kind in TYPE_CODES:
                    code = TYPE_CODES[kind]
                else:
                    continue
                if count * struct.calcsize(f"={code}") > inner:
                    value_at = self.read("Q" if self.big else "I", value_at)[0]
                try:
                    tags[tag] = self.read(code, value_at, count)
                except TiffError as e:  # tells of the page, not of those after it
                    tags[tag] = e
            yield tags
            at = self.read(word, begin + n * entry)[0]


def _undo(raw: bytes, rows: int, columns: int, samples: int, kind: np.dtype, predictor: int) -> np.ndarray:
    if predictor == 3:
        if kind.kind != "f":
            raise TiffError("predictor 3 without floating-point samples")
        size = kind.itemsize
        planes = np.frombuffer(raw, np.uint8).reshape(rows, size * columns, samples)
        planes = np.cumsum(planes, axis=1, dtype=np.uint8).reshape(rows, size, columns * samples)
        native = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">f{size}")
        return native.reshape(rows, columns, samples).astype(kind.newbyteorder("="))
    values = np.frombuffer(raw, kind).reshape(rows, columns, samples)
    values = values.astype(kind.newbyteorder("="))
    if predictor == 2:
        if kind.kind == "f":
            raise TiffError("predictor 2 with floating-point samples")
        return np.cumsum(values, axis=1, dtype=values.dtype)
    if predictor not in (0, 1):
        raise TiffError(f"predictor {predictor}")
    return values


def _one_bit(raw: bytes, rows: int, columns: int, bits: int) -> np.ndarray:
    cells = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(rows, -1), axis=1).reshape(rows, -1, bits)
    weight = 1 << np.arange(bits - 1, -1, -1)
    return (cells @ weight).astype(np.uint8)[:, :columns]


def _numbers(tags: dict[int, tuple], tag: int, *otherwise: int) -> tuple[int, ...]:
    """The whole numbers of a field, at least one, none negative; without `otherwise` the field must be there."""
    found = tags.get(tag, otherwise)
    if isinstance(found, TiffError):
        raise found
    if not found or not all(isinstance(x, int) and x >= 0 for x in found):
        raise TiffError(f"field {tag} is missing or no whole number")
    return found


def _page(file: _File, tags: dict[int, tuple], page_bytes: int) -> np.ndarray:
    one = lambda tag, *otherwise: _numbers(tags, tag, *otherwise)[0]
    width, height, samples, bits = one(WIDTH), one(HEIGHT), one(SAMPLES, 1), one(BITS, 1)
    if len(set(_numbers(tags, BITS, 1))) > 1 or len(set(_numbers(tags, SAMPLE_FORMAT, 1))) > 1:
        raise TiffError("samples of different kinds")
    form = {1: "u", 2: "i", 3: "f"}.get(one(SAMPLE_FORMAT, 1), "u")
    if bits not in (1, 2, 4, 8, 16, 32, 64) or not 1 <= samples <= 1024 or (form == "f" and bits < 16):
        raise TiffError(f"{samples} samples of {bits} bits")
    if not width or not height or width * height * samples * max(bits // 8, 1) > page_bytes:
        raise TiffError(f"{width} x {height} pixels")
    kind = np.dtype(f"{file.order}{form}{max(bits // 8, 1)}")
    compression, predictor = one(COMPRESSION, 1), one(PREDICTOR, 1)
    planar = one(PLANAR, 1) == 2 and samples > 1
    inner = 1 if planar else samples
    tiled = TILE_OFFSETS in tags
    if tiled:
        tall, wide = one(TILE_HEIGHT), one(TILE_WIDTH)
        offsets, sizes = _numbers(tags, TILE_OFFSETS), _numbers(tags, TILE_BYTES)
    else:
        tall, wide = min(one(ROWS_PER_STRIP, height), height), width
        offsets, sizes = _numbers(tags, STRIP_OFFSETS), _numbers(tags, STRIP_BYTES)
    line = -(-wide * inner * bits // 8)
    if not tall or not wide or tall * wide * inner * kind.itemsize > page_bytes:
        raise TiffError("a strip or tile without a size")
    across, down = -(-width // wide), -(-height // tall)
    if len(offsets) < across * down * (samples if planar else 1) or len(sizes) < len(offsets):
        raise TiffError("strips or tiles are missing")
    out = np.zeros((height, width, samples), kind.newbyteorder("="))
    for number in range(across * down * (samples if planar else 1)):
        plane, place = divmod(number, across * down)
        top, left = place // across * tall, place % across * wide
        rows = tall if tiled else min(tall, height - top)
        if offsets[number] + sizes[number] > len(file.data):
            raise TiffError("the file is cut short")
        raw = _decode(file.data[offsets[number] : offsets[number] + sizes[number]], compression, rows * line)
        if bits < 8:
            block = _one_bit(raw, rows, wide * inner, bits).reshape(rows, wide, inner)
        else:
            block = _undo(raw, rows, wide, inner, kind, predictor)
        block = block[: height - top, : width - left]
        into = slice(plane, plane + 1) if planar else slice(None)
        out[top : top + block.shape[0], left : left + block.shape[1], into] = block
    return out


def read_pages(data: bytes, page_bytes: int = PAGE_BYTES) -> list[np.ndarray]:
    """Every page as (height, width, samples)."""
    file = _File(data)
    return [_page(file, tags, page_bytes) for tags in file.directories()]


def write_pages(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, rows_per_strip: int = 256, tile: int = 0, order: str = "<", level: int = 1) -> bytes:
    """A classic TIFF of pages (height, width, samples) of unsigned integers; tile: the side of square tiles, else strips."""
    out = bytearray(b"II*\0\0\0\0\0" if order == "<" else b"MM\0*\0\0\0\0")
    link = 4
    pack = {PLAIN: bytes, LZW: pack_lzw, PACKBITS: pack_bits, DEFLATE: lambda x: zlib.compress(x, level)}[compression]
    for page in pages:
        height, width, samples = page.shape
        blocks = []
        if tile:
            for top in range(0, height, tile):
                for left in range(0, width, tile):
                    whole = np.zeros((tile, tile, samples), page.dtype)
                    part = page[top : top + tile, left : left + tile]
                    whole[: part.shape[0], : part.shape[1]] = part
                    blocks.append(whole)
        else:
            blocks = [page[top : top + rows_per_strip] for top in range(0, height, rows_per_strip)]
        offsets, sizes = [], []
        for block in blocks:
            if predictor == 2:
                block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1)
            raw = pack(block.astype(page.dtype.newbyteorder(order)).tobytes())
            offsets.append(len(out))
            sizes.append(len(raw))
            out += raw + b"\0" * (len(raw) % 2)
        tags = {WIDTH: ("I", [width]), HEIGHT: ("I", [height]), BITS: ("H", [page.dtype.itemsize * 8] * samples), COMPRESSION: ("H", [compression]), PHOTOMETRIC: ("H", [1 if samples < 3 else 2]), SAMPLES: ("H", [samples]), PLANAR: ("H", [1])}
        if predictor != 1:
            tags[PREDICTOR] = ("H", [predictor])
        if tile:
            tags |= {TILE_WIDTH: ("I", [tile]), TILE_HEIGHT: ("I", [tile]), TILE_OFFSETS: ("I", offsets), TILE_BYTES: ("I", sizes)}
        else:
            tags |= {STRIP_OFFSETS: ("I", offsets), ROWS_PER_STRIP: ("I", [rows_per_strip]), STRIP_BYTES: ("I", sizes)}
        entries, values = b"", {}
        for tag in sorted(tags):
            code, numbers = tags[tag]
            raw = struct.pack(f"{order}{len(numbers)}{code}", *numbers)
            if len(raw) > 4:
                values[tag] = len(out)
                out += raw
                raw = struct.pack(f"{order}I", values[tag])
            entries += struct.pack(f"{order}HHI", tag, 3 if code == "H" else 4, len(numbers)) + raw.ljust(4, b"\0")
        out += b"\0" * (len(out) % 2)
        struct.pack_into(f"{order}I", out, link, len(out))
        out += struct.pack(f"{order}H", len(tags)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


@tidy
def _read_batches(batches, media: str, page_bytes: int):
    for batch in batches:
        rows, number, width, height, samples, kind, data, error = [], [], [], [], [], [], [], []

        def add(row, n, page, problem):
            rows.append(row)  # noqa: B023
            number.append(n)  # noqa: B023
            shape = page.shape if page is not None else (None,) * 3
            height.append(shape[0]), width.append(shape[1]), samples.append(shape[2])  # noqa: B023
            kind.append(page.dtype.name if page is not None else None)  # noqa: B023
            data.append(page.tobytes() if page is not None else None)  # noqa: B023
            error.append(problem)  # noqa: B023

        def made():
            names = [n for n in batch.schema.names if n != media]  # noqa: B023
            kept = [batch.column(n).take(pa.array(rows, pa.int64())) for n in names]  # noqa: B023
            whole = [pa.array(x, pa.int32()) for x in (number, width, height, samples)]  # noqa: B023
            rest = [pa.array(kind, pa.string()), pa.array(data, pa.binary()), pa.array(error, pa.string())]  # noqa: B023
            out = pa.RecordBatch.from_arrays([*kept, *whole, *rest], [*names, "page", "width", "height", "samples", "kind", "pixels", "error"])
            for x in (rows, number, width, height, samples, kind, data, error):  # noqa: B023
                x.clear()
            return out

        held = 0
        for row, value in enumerate(batch.column(media)):
            value = value.as_py()
            if value is None:
                continue
            n = 0
            try:
                file = _File(value)
                for tags in file.directories():
                    try:
                        page, problem = _page(file, tags, page_bytes), None
                    except TiffError as e:  # the next directory's place is known
                        page, problem = None, str(e)
                    add(row, n, page, problem)
                    n, held = n + 1, held + (page.nbytes if page is not None else 0)
                    if held > 8 << 20:
                        yield made()
                        held = 0
            except TiffError as e:
                add(row, n, None, str(e))
        yield made()


def tiff_pages(df: DataFrame, media: str = "media", page_bytes: int = PAGE_BYTES) -> DataFrame:
    """One row for each page of the TIFF files in a binary column, with all other columns.

    Adds page (from 0), width, height, samples, kind (of the samples), pixels (row by row, machine
    order) and error. A page that can't be read gives a row with its error, and the pages after it
    follow. A file that is no TIFF, or whose chain of directories is broken, gives its pages up to there
    and then one row with the error; a null gives none. Fields that are missing, of a wrong type or
    without values, and a page of more than `page_bytes` decoded bytes, are such errors: no file ends
    a task. Rows are independent; repeated rows repeat. A column of `df` with the name of an added one
    must be renamed first, else ValueError.
    """
    added = {"page": "int", "width": "int", "height": "int", "samples": "int", "kind": "string", "pixels": "binary", "error": "string"}
    if clash := added.keys() & {c.lower() for c in df.columns}:
        raise ValueError(f"columns {sorted(clash)} would clash")
    bounded_batches(df.sparkSession, 256)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != media)
    return df.mapInArrow(partial(_read_batches, media=media, page_bytes=page_bytes), ", ".join([kept, *(f"{a} {b}" for a, b in added.items())]))


PIXELS = 576


def text_image(text: bytes, across: int = PIXELS) -> np.ndarray:
    """UTF-8 bytes as rows of 8-bit samples, filled up with 255."""
    rows = max(1, -(-len(text) // across))
    return np.frombuffer(text.ljust(rows * across, b"\xff"), np.uint8).reshape(rows, across, 1)


def features(page: np.ndarray) -> str:
    """Mean, spread, median and entropy in bits of the samples, and a 16-digit fingerprint of a small grey picture."""
    count = np.bincount(page.ravel(), minlength=256)
    n = page.size
    share = count[count > 0] / n
    values = np.arange(256)
    mean = float((count * values).sum() / n)
    spread = float(np.sqrt(max(0.0, (count * values**2).sum() / n - mean**2)))
    median = int(np.searchsorted(np.cumsum(count), (n + 1) // 2))
    columns = page[:, :, 0].sum(axis=0, dtype=np.int64).reshape(64, -1).sum(axis=1) if page.shape[1] % 64 == 0 else np.zeros(64, np.int64)
    bits = int("".join("1" if x else "0" for x in columns * 64 > columns.sum()), 2)
    return f"mean={mean:.3f};spread={spread:.3f};median={median};entropy={-float((share * np.log2(share)).sum()):.3f};shape={bits:016x}"


@tidy
def _store_batches(batches, rows_per_page: int):
    for batch in batches:
        for part, texts in slices(batch, "text"):
            out = []
            for text in texts.to_pylist():
                raw = text.encode()
                image = text_image(raw)
                pages = [image[at : at + rows_per_page] for at in range(0, len(image), rows_per_page)]
                out.append((len(raw), write_pages(pages, DEFLATE, 1, 64)))
            arrays = [part.column("doc_id"), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "media"])


def store_texts(docs: DataFrame, rows_per_page: int = 4096) -> DataFrame:
    """doc_id, n_bytes and `media`: each whole text as a TIFF of 576 samples across, a page for every `rows_per_page` rows.

    A null text counts as empty, which is one row of samples 255. Repeated rows repeat; null ids are
    kept; other columns are left out.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(partial(_store_batches, rows_per_page=rows_per_page), f"doc_id {kind}, n_bytes long, media binary")


@tidy
def _digest_batches(batches):
    for batch in batches:
        rows = []
        for media in batch.column("media").to_pylist():
            pages = read_pages(media)
            image = np.concatenate(pages) if len(pages) > 1 else pages[0]
            payload = image.tobytes()
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(image)))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        arrays = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *arrays], ["doc_id", "n_bytes", *names])


def media_digests(stored: DataFrame) -> DataFrame:
    """Digests and a feature of each stored text's samples as its TIFF's pages give them back."""
    kind = stored.schema["doc_id"].dataType.simpleString()
    return stored.mapInArrow(_digest_batches, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
