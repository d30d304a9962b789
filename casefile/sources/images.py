"""Properties of images: segments of JPEG files and directories of TIFF (EXIF, GPS), in either byte order."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casefile import params
from casefile.sources.batches import batched
from casefile.sources.office import document_date

# Sizes of TIFF types, and tags by directory.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
FORMATS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
TAGS = {0x010F: "make", 0x0110: "model", 0x0131: "software", 0x0132: "modified", 0x013B: "author", 0x9003: "taken", 0x9004: "digitised", 0x0112: "orientation", 0xA002: "width", 0xA003: "height"}
GPS_TAGS = {1: "south_north", 2: "latitude", 3: "west_east", 4: "longitude"}
EXIF_AT, GPS_AT = 0x8769, 0x8825
#: Values of one entry and directories of one file at most; more is a broken file.
MOST_VALUES, MOST_DIRECTORIES = 1 << 16, 64


class Broken(ValueError):
    """A file that is not what it says; says why."""


def directory(data: bytes, at: int, order: str) -> tuple[dict[int, object], int]:
    """(values by tag, place of the next directory)."""
    if not 0 < at <= len(data) - 2:
        raise Broken(f"a directory at byte {at} of {len(data)}")
    count = struct.unpack_from(order + "H", data, at)[0]
    if at + 2 + 12 * count > len(data):
        raise Broken(f"a directory of {count} entries beyond the end")
    found: dict[int, object] = {}
    for i in range(count):
        tag, kind, n, raw = struct.unpack_from(order + "HHI4s", data, at + 2 + 12 * i)
        size = SIZES.get(kind, 0) * n
        if not size or n > MOST_VALUES:
            continue
        start = at + 10 + 12 * i if size <= 4 else struct.unpack(order + "I", raw)[0]
        if start + size > len(data):
            raise Broken(f"a value of tag {tag} beyond the end")
        part = data[start : start + size]
        if kind == 2:
            found[tag] = part.split(b"\x00")[0].decode("utf-8", "replace").strip()
        elif kind in FORMATS:
            values = struct.unpack(f"{order}{n}{FORMATS[kind]}", part)
            found[tag] = values[0] if n == 1 else values
        elif kind in (5, 10):
            pairs = struct.unpack(f"{order}{2 * n}{'I' if kind == 5 else 'i'}", part)
            found[tag] = tuple(a / b if b else None for a, b in zip(pairs[::2], pairs[1::2], strict=True))
    after = at + 2 + 12 * count
    return found, struct.unpack_from(order + "I", data, after)[0] if after + 4 <= len(data) else 0


def degrees(parts: object, direction: object) -> float | None:
    if not isinstance(parts, tuple) or len(parts) != 3 or None in parts:
        return None
    value = parts[0] + parts[1] / 60 + parts[2] / 3600
    return round(-value if str(direction).upper() in ("S", "W") else value, 6)


def tiff(data: bytes) -> dict[str, object]:
    """Fields of the first directory and the EXIF and GPS directories that it names; each directory is read once."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise Broken("no TIFF header")
    todo, seen, out = [(struct.unpack_from(order + "I", data, 4)[0], TAGS)], set(), {}
    while todo:
        at, tags = todo.pop()
        if at in seen:
            raise Broken(f"a directory at byte {at} that leads back to itself")
        seen.add(at)
        if len(seen) > MOST_DIRECTORIES:
            raise Broken("too many directories")
        found, after = directory(data, at, order)
        if tags is TAGS:
            for tag, names in ((EXIF_AT, TAGS), (GPS_AT, GPS_TAGS)):
                if isinstance(found.get(tag), int):
                    todo.append((found[tag], names))
        out = {tags[t]: v for t, v in found.items() if t in tags} | out
        if after:
            todo.insert(0, (after, {}))  # a thumbnail's: its place only
    out["latitude"], out["longitude"] = degrees(out.get("latitude"), out.pop("south_north", "N")), degrees(out.get("longitude"), out.pop("west_east", "E"))
    return out


def jpeg(data: bytes) -> dict[str, object]:
    """Size from the frame's segment, fields from the EXIF segment; segments are walked by their lengths."""
    out: dict[str, object] = {}
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise Broken(f"no segment at byte {at}")
        marker = data[at + 1]
        if marker == 0xFF or 0xD0 <= marker <= 0xD8 or marker == 0x01:  # filling, or a marker without a length
            at += 1 if marker == 0xFF else 2
            continue
        if marker in (0xDA, 0xD9):  # the picture itself, or the end
            return out
        size = struct.unpack_from(">H", data, at + 2)[0]
        if size < 2 or at + 2 + size > len(data):
            raise Broken(f"a segment of {size} bytes beyond the end")
        body = data[at + 4 : at + 2 + size]
        if marker == 0xE1 and body[:6] == b"Exif\x00\x00":
            out = tiff(body[6:]) | out
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and len(body) >= 5:
            out["height"], out["width"] = struct.unpack_from(">HH", body, 1)
        at += 2 + size
    raise Broken("no picture behind the segments")


def png(data: bytes) -> dict[str, object]:
    """Size, text chunks and an EXIF chunk."""
    out: dict[str, object] = {}
    at = 8
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if len(body) < size:
            raise Broken(f"a chunk of {size} bytes beyond the end")
        if kind == b"IHDR" and size >= 8:
            out["width"], out["height"] = struct.unpack_from(">II", body)
        elif kind == b"tEXt":
            name, _, value = body.partition(b"\x00")
            field = {b"Software": "software", b"Author": "author", b"Creation Time": "taken"}.get(name)
            if field:
                out[field] = value.decode("latin-1")
        elif kind == b"eXIf":
            out = tiff(body) | out
        elif kind == b"IEND":
            return out
        at += 12 + size
    raise Broken("no end of the picture")


def inspect(data: bytes) -> dict[str, object]:
    """Fields of an image with its kind; ``Broken`` for what is none."""
    for start, kind, read in ((b"\xff\xd8", "JPEG", jpeg), (b"\x89PNG\r\n\x1a\n", "PNG", png), (b"II*\x00", "TIFF", tiff), (b"MM\x00*", "TIFF", tiff)):
        if data.startswith(start):
            return {"kind": kind} | read(data)
    raise Broken("no image")


TEXTS, NUMBERS = ("kind", "make", "model", "software", "author", "taken", "digitised", "modified"), ("width", "height", "orientation")


def properties(files: DataFrame) -> DataFrame:
    """path, kind, make, model, software, author, taken, digitised, modified, width, height, orientation, latitude, longitude, edited, error of images (path, content).

    edited: the software is one for editing. A file that is broken or no image has an ``error`` and what was read before it is left out.
    """
    schema = ["path string", *(f"{n} string" for n in TEXTS), *(f"{n} long" for n in NUMBERS), "latitude double", "longitude double", "error string"]
    kinds = [pa.string(), *[pa.string()] * len(TEXTS), *[pa.int64()] * len(NUMBERS), pa.float64(), pa.float64(), pa.string()]
    names = [s.split(" ")[0] for s in schema]

    def one(data: bytes | None) -> dict[str, object]:
        try:
            found = inspect(data or b"")
        except (Broken, struct.error) as e:
            return {"error": str(e)}
        fits = lambda n, v: isinstance(v, str) if n in TEXTS else isinstance(v, int) if n in NUMBERS else isinstance(v, float)
        return {n: v for n, v in found.items() if n in names and fits(n, v)}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list[object]]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                row = {"path": path.as_py()} | one(content.as_py())
                yield [row.get(n) for n in names]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched(rows(batches), names, kinds)

    out = files.select("path", "content").mapInArrow(work, ", ".join(schema))
    colon = lambda c: F.regexp_replace(c, r"^(\d{4}):(\d{2}):(\d{2}) ", "$1-$2-$3 ")
    out = out.withColumns({c: colon(F.col(c)) for c in ("taken", "digitised", "modified")})
    edited = F.exists(F.array(*(F.lit(n) for n, _ in params.SOFTWARE_PENALTIES)), lambda n: F.contains(F.lower(F.coalesce("software", F.lit(""))), n))
    return out.withColumns({c: document_date(c) for c in ("taken", "digitised", "modified")}).withColumn("edited", edited)
