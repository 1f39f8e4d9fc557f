"""EXIF tags of JPEG and PNG files as names and texts."""

from __future__ import annotations

import struct

from . import jpeg, png

_NAMES = {
    0x010E: "Image Description", 0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation", 0x011A: "X Resolution", 0x011B: "Y Resolution", 0x0128: "Resolution Unit", 0x0131: "Software",
    0x0132: "Date/Time", 0x013B: "Artist", 0x0213: "YCbCr Positioning", 0x8298: "Copyright", 0x829A: "Exposure Time", 0x829D: "F-Number", 0x8822: "Exposure Program",
    0x8827: "ISO Speed Ratings", 0x9003: "Date/Time Original", 0x9004: "Date/Time Digitized", 0x9201: "Shutter Speed Value", 0x9202: "Aperture Value", 0x9204: "Exposure Bias Value",
    0x9205: "Max Aperture Value", 0x9207: "Metering Mode", 0x9209: "Flash", 0x920A: "Focal Length", 0xA001: "Color Space", 0xA002: "Exif Image Width", 0xA003: "Exif Image Height",
    0xA402: "Exposure Mode", 0xA403: "White Balance Mode", 0xA406: "Scene Capture Type", 0xA433: "Lens Make", 0xA434: "Lens Model",
}
_GPS = {0: "GPS Version ID", 1: "GPS Latitude Ref", 2: "GPS Latitude", 3: "GPS Longitude Ref", 4: "GPS Longitude", 5: "GPS Altitude Ref", 6: "GPS Altitude", 7: "GPS Time-Stamp", 29: "GPS Date Stamp"}
_KINDS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}


def _value(data: bytes, order: str, kind: int, n: int, at: int) -> str:
    if kind in (2, 7):
        return data[at : at + n].split(b"\0")[0].decode("utf-8", "replace").strip()
    if kind in (5, 10):
        parts = struct.unpack_from(f"{order}{2 * n}{'I' if kind == 5 else 'i'}", data, at)
        return " ".join(f"{a}/{b}" if b != 1 else str(a) for a, b in zip(parts[::2], parts[1::2]))
    return " ".join(map(str, struct.unpack_from(f"{order}{n}{_KINDS[kind]}", data, at)))


def parse(data: bytes) -> dict[str, str]:
    """Tags of a TIFF block with its sub-directories; what can't be read is left out, and of tags met twice the later counts."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or len(data) < 8 or struct.unpack_from(f"{order}H", data, 2)[0] != 42:
        return {}
    found: dict[str, str] = {}
    ahead, seen = [(struct.unpack_from(f"{order}I", data, 4)[0], _NAMES)], set()
    while ahead:
        at, names = ahead.pop(0)
        if at in seen or not 0 < at <= len(data) - 2:
            continue
        seen.add(at)
        for i in range(struct.unpack_from(f"{order}H", data, at)[0]):
            entry = at + 2 + 12 * i
            if entry + 12 > len(data):
                break
            tag, kind, n = struct.unpack_from(f"{order}HHI", data, entry)
            size = _BYTES.get(kind, 0) * n
            where = entry + 8 if size <= 4 else struct.unpack_from(f"{order}I", data, entry + 8)[0]
            if not size or where + size > len(data):
                continue
            if tag in (0x8769, 0x8825):
                ahead.append((struct.unpack_from(f"{order}I", data, where)[0], _GPS if tag == 0x8825 else _NAMES))
            else:
                found[names.get(tag, f"Unknown tag (0x{tag:04x})")] = _value(data, order, kind, n, where)
    return found


def read(data: bytes, storage_format: int) -> dict[str, str]:
    """Tags of a JPEG (1) or PNG (2); another format, or a file without any, has none."""
    if storage_format == 1:
        for kind, at, end in jpeg.segments(data):
            if kind == 0xE1 and data[at : at + 6] == b"Exif\0\0":
                return parse(data[at + 6 : end])
    if storage_format == 2:
        for kind, body in png.chunks(data):
            if kind == b"eXIf":
                return parse(body)
    return {}


def block(tags: dict[int, str]) -> bytes:
    """A JPEG segment that holds texts by the number of their tag."""
    items = sorted((t, v.encode() + b"\0") for t, v in tags.items())
    head, rest, at = struct.pack(">2sHIH", b"MM", 42, 8, len(items)), b"", 14 + 12 * len(items)
    for tag, v in items:
        head += struct.pack(">HHI", tag, 2, len(v)) + (v.ljust(4, b"\0") if len(v) <= 4 else struct.pack(">I", at + len(rest)))
        rest += v if len(v) > 4 else b""
    body = b"Exif\0\0" + head + bytes(4) + rest
    return b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body
