"""Tags of photos from their bytes: a walk over the directories of a TIFF structure that ends whatever the bytes say."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entries read of a file, directories below each other, values of an entry, at most.
ENTRIES, DEPTH, VALUES = 2048, 5, 8192
#: Fixed values of the format: bytes and codes of the types of values; 5 and 10 are fractions.
SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4}
CODES = {1: "B", 3: "H", 4: "I", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I"}
#: Entries that lead to a directory, and the one that holds a maker's own.
POINTERS, MAKER = {0x8769: "ExifIFD", 0x8825: "GPS", 0x014A: "SubIFD"}, 0x927C
#: How a maker's block begins, where its directory is, and whether offsets in it count from the block.
MAKERS = (("Nikon", b"Nikon\x00\x02", 10, True), ("Sony", b"SONY", 12, False), ("Panasonic", b"Panasonic\x00", 12, False))
#: Names of entries, by directory.
NAMES = {
    "IFD0": {0x0100: "ImageWidth", 0x0101: "ImageHeight", 0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation", 0x0132: "ModifyDate"},
    "ExifIFD": {0x9003: "DateTimeOriginal", 0x9004: "CreateDate", 0x9291: "SubSecTimeOriginal", 0xA002: "ExifImageWidth", 0xA003: "ExifImageHeight", 0xA404: "DigitalZoomRatio"},
    "Sony": {0x201B: "FocusMode", 0x2027: "FocusLocation", 0x2037: "FocusFrameSize"},
    "Panasonic": {0x0007: "FocusMode", 0x000F: "AFAreaMode", 0x004D: "AFPointPosition", 0x00DE: "AFAreaSize"},
}
#: Canon's block of settings and the place of the focus mode in it; its block of points, whose arrays are as long as its count says.
CANON_SETTINGS, CANON_FOCUS, CANON_POINTS = 0x0001, 7, 0x0026
CANON_HEAD = ("AFAreaMode", "NumAFPoints", "ValidAFPoints", "CanonImageWidth", "CanonImageHeight", "AFImageWidth", "AFImageHeight")
CANON_ARRAYS = ("AFAreaWidths", "AFAreaHeights", "AFAreaXPositions", "AFAreaYPositions")


def _values(data: bytes, order: str, kind: int, count: int, at: int) -> list | str | None:
    """What an entry holds; null for a type that isn't known or bytes that aren't there."""
    if kind not in SIZES or not 0 < count <= VALUES or at < 0 or at + count * SIZES[kind] > len(data):
        return None
    if kind == 2:
        return data[at : at + count].split(b"\0")[0].decode("latin-1")
    if kind in (5, 10):
        pairs = struct.unpack_from(f"{order}{2 * count}{'I' if kind == 5 else 'i'}", data, at)
        return [a / b if b else None for a, b in zip(pairs[::2], pairs[1::2], strict=True)]
    return list(struct.unpack_from(f"{order}{count}{CODES[kind]}", data, at))


def _canon(number: int, values: list, out: dict[str, str]) -> None:
    """Tags of Canon's two blocks of short numbers."""
    if number == CANON_SETTINGS and len(values) > CANON_FOCUS:
        out["Canon:FocusMode"] = str(values[CANON_FOCUS])
    elif number == CANON_POINTS and len(values) > len(CANON_HEAD):
        out |= {f"Canon:{n}": str(v) for n, v in zip(CANON_HEAD, values[1:], strict=False)}
        n, at = values[2], 1 + len(CANON_HEAD)
        if n > VALUES or at + 4 * n + 2 * -(-n // 16) > len(values):
            return  # arrays that are cut off are none
        for name in CANON_ARRAYS:
            out[f"Canon:{name}"] = " ".join(str(v - 65536 if v > 32767 else v) for v in values[at : at + n])
            at += n
        for name in ("AFPointsInFocus", "AFPointsSelected"):
            out[f"Canon:{name}"] = " ".join(map(str, values[at : at + -(-n // 16)]))
            at += -(-n // 16)


def walk(data: bytes | None) -> dict[str, str] | None:
    """{`directory:name`: text} of a TIFF file or an EXIF block; null for what is neither.

    Entries of no known name have their number in hexadecimal. Every directory is read once, wherever it is named again, ENTRIES entries of the file in all and directories
    DEPTH deep; an entry whose bytes aren't all there is left out. Numbers stand with a space between.
    """
    if data is None:
        return None
    start = data.find(b"Exif\0\0", 0, 64)
    base = start + 6 if start >= 0 else 0
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[base : base + 2]))
    if order is None or len(data) < base + 8 or struct.unpack_from(order + "H", data, base + 2)[0] != 42:
        return None
    out: dict[str, str] = {}
    seen: set[int] = set()
    waiting = [("IFD0", base, order, base + struct.unpack_from(order + "I", data, base + 4)[0], 0)]
    read = 0
    while waiting:
        group, base, order, at, depth = waiting.pop(0)
        if at in seen or depth > DEPTH or at < 0 or at + 2 > len(data):
            continue
        seen.add(at)
        n = struct.unpack_from(order + "H", data, at)[0]
        for i in range(n):
            entry = at + 2 + 12 * i
            if read >= ENTRIES or entry + 12 > len(data):
                break
            read += 1
            number, kind, count = struct.unpack_from(order + "HHI", data, entry)
            size = SIZES.get(kind, 0) * count
            place = entry + 8 if size <= 4 else base + struct.unpack_from(order + "I", data, entry + 8)[0]
            values = _values(data, order, kind, count, place)
            if values is None:
                continue
            if number in POINTERS and isinstance(values, list):
                waiting += [(POINTERS[number], base, order, base + int(v), depth + 1) for v in values[:8]]
            elif number == MAKER and group == "ExifIFD":
                maker = next((m for m in MAKERS if data.startswith(m[1], place)), None)
                if maker and maker[3]:  # a structure of its own
                    own = place + maker[2]
                    inner = {b"II": "<", b"MM": ">"}.get(bytes(data[own : own + 2]))
                    if inner and own + 8 <= len(data):
                        waiting.append((maker[0], own, inner, own + struct.unpack_from(inner + "I", data, own + 4)[0], depth + 1))
                elif maker:
                    waiting.append((maker[0], base, order, place + maker[2], depth + 1))
                elif out.get("IFD0:Make") == "Canon":
                    waiting.append(("Canon", base, order, place, depth + 1))
            elif group == "Canon" and number in (CANON_SETTINGS, CANON_POINTS) and kind == 3:
                _canon(number, values, out)
            else:
                if group == "Sony" and NAMES["Sony"].get(number) == "FocusFrameSize" and kind == 7 and len(values) == 6:
                    values = list(struct.unpack_from(order + "3H", data, place))  # written as bytes
                name = NAMES.get(group, {}).get(number, f"0x{number:04x}")
                out.setdefault(f"{group}:{name}", values if isinstance(values, str) else " ".join("" if v is None else f"{v:g}" if isinstance(v, float) else str(v) for v in values))
    return out


def tags(content: Column) -> Column:
    """A map of tags of a file's bytes: see walk()."""

    @F.arrow_udf("map<string,string>")
    def read(content: pa.Array) -> pa.Array:
        found = (walk(c.as_py()) for c in content)
        return pa.array([None if f is None else list(f.items()) for f in found], pa.map_(pa.string(), pa.string()))

    return read(content)
