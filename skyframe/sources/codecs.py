"""Codecs of image files. An image is (channels, rows, columns), float32; headers are lists of 80-character cards."""

from __future__ import annotations

import re
import struct

import numpy as np

BLOCK = 2880


def card(key: str, value, comment: str = "") -> str:
    if isinstance(value, bool):
        text = f"{'T' if value else 'F':>20}"
    elif isinstance(value, int):
        text = f"{value:>20}"
    elif isinstance(value, float):
        text = f"{value:>20.12E}"
    else:
        text = f"'{str(value).replace(chr(39), chr(39) * 2):<8}'"
    return f"{key:<8}= {text}{' / ' + comment if comment else ''}"[:80].ljust(80)


def card_value(text: str):
    """The value of a card: bool, int, float or text; None without one."""
    if text[8:10] != "= ":
        return None
    body = text[10:].strip()
    if body.startswith("'"):
        m = re.match(r"'((?:[^']|'')*)'", body)
        return m[1].replace("''", "'").rstrip() if m else None
    body = body.split("/")[0].strip()
    if body in ("T", "F"):
        return body == "T"
    try:
        return int(body)
    except ValueError:
        try:
            return float(body.replace("D", "E"))
        except ValueError:
            return None


def fits_header(data: bytes) -> tuple[list[str], int]:
    """Cards up to END, and where the data begins."""
    cards = []
    for at in range(0, len(data) - 79, 80):
        c = data[at : at + 80].decode("latin-1")
        if c.startswith("END") and c[3:].strip() == "":
            return cards, (at // BLOCK + 1) * BLOCK
        cards.append(c)
    raise ValueError("no END card")


def read_fits(data: bytes, pixels: bool = True) -> tuple[list[str], np.ndarray | None]:
    """The first image. Not-a-number in float images takes the largest value so far; three bytes a pixel (NAXIS1 = 3)
    become three channels."""
    cards, at = fits_header(data)
    head = {c[:8].strip(): card_value(c) for c in cards}
    if head.get("SIMPLE") is not True:
        raise ValueError("not a FITS file")
    if not pixels:
        return cards, None
    shape = [int(head[f"NAXIS{i}"]) for i in range(int(head["NAXIS"]), 0, -1)]
    kind = {8: "u1", 16: ">i2", 32: ">i4", -32: ">f4", -64: ">f8"}[head["BITPIX"]]
    n = int(np.prod(shape))
    raw = np.frombuffer(data, kind, n, at).astype(np.float64).reshape(shape)
    if head["BITPIX"] < 0 and np.isnan(raw).any():
        flat = raw.ravel()
        top = np.maximum.accumulate(np.where(np.isnan(flat), 0.0, flat))
        raw = np.where(np.isnan(flat), top, flat).reshape(shape)
    raw = raw * float(head.get("BSCALE") or 1) + float(head.get("BZERO") or 0)
    if raw.ndim == 3 and shape[-1] == 3 and head["BITPIX"] == 8:
        raw = np.moveaxis(raw, -1, 0)
    return cards, (raw if raw.ndim == 3 else raw.reshape(1, *raw.shape[-2:])).astype(np.float32)


STRUCTURAL = ("SIMPLE", "BITPIX", "NAXIS", "NAXIS1", "NAXIS2", "NAXIS3", "EXTEND", "BZERO", "BSCALE", "END")


def write_fits(img: np.ndarray, cards: list[str] = (), bits: int = -32) -> bytes:
    c, h, w = img.shape
    head = [card("SIMPLE", True), card("BITPIX", bits), card("NAXIS", 3 if c > 1 else 2), card("NAXIS1", w), card("NAXIS2", h)]
    head += [card("NAXIS3", c)] if c > 1 else []
    head += [card("BZERO", 32768), card("BSCALE", 1)] if bits == 16 else []
    head += [x.ljust(80)[:80] for x in cards if x[:8].strip() not in STRUCTURAL]
    text = "".join([*head, "END".ljust(80)])
    v = np.floor(img.astype(np.float64) + 0.5)
    body = {8: lambda: np.clip(v, 0, 255).astype("u1"), 16: lambda: (np.clip(v, 0, 65535) - 32768).astype(">i2"), -32: lambda: img.astype(">f4")}[bits]().tobytes()
    pad = lambda b, fill: b + fill * (-len(b) % BLOCK)
    return pad(text.encode("latin-1"), b" ") + pad(body, b"\0")


def with_cards(data: bytes, cards: list[str]) -> bytes:
    """The same data under a new header, of whatever length; structural cards stay."""
    old, at = fits_header(data)
    kept = [x for x in old if x[:8].strip() in STRUCTURAL]
    text = "".join([*kept, *(x.ljust(80)[:80] for x in cards if x[:8].strip() not in STRUCTURAL), "END".ljust(80)]).encode("latin-1")
    return text + b" " * (-len(text) % BLOCK) + data[at:]


def read_pnm(data: bytes) -> tuple[dict[str, str], np.ndarray]:
    """P5, P6, Pf and PF; comments of the form # KEY=value are metadata."""
    meta, fields, at = {}, [], 2
    kind = data[:2].decode("latin-1")
    while len(fields) < 3:
        if data[at : at + 1] == b"#":
            end = data.index(b"\n", at)
            if m := re.match(r"#\s*(\w[\w-]*)\s*[=:]\s*(.*)", data[at:end].decode("latin-1")):
                meta[m[1].upper()] = m[2].strip()
            at = end + 1
        elif data[at : at + 1].isspace():
            at += 1
        else:
            end = next(i for i in range(at, len(data)) if data[i : i + 1].isspace())
            fields.append(data[at:end].decode())
            at = end
    at += 1
    w, h, top = int(fields[0]), int(fields[1]), float(fields[2])
    c = 3 if kind in ("P6", "PF") else 1
    if kind in ("PF", "Pf"):
        v = np.frombuffer(data, "<f4" if top < 0 else ">f4", w * h * c, at).reshape(h, w, c)[::-1]
    else:
        v = np.frombuffer(data, ">u2" if top > 255 else "u1", w * h * c, at).reshape(h, w, c)
    return meta, np.moveaxis(v, -1, 0).astype(np.float32)


def write_pnm(img: np.ndarray) -> bytes:
    """16 bits, one or three channels."""
    c, h, w = img.shape
    v = np.clip(np.floor(img.astype(np.float64) + 0.5), 0, 65535).astype(">u2")
    return f"P{6 if c == 3 else 5}\n{w} {h}\n65535\n".encode() + np.moveaxis(v, 0, -1).tobytes()


def read_xisf(data: bytes) -> tuple[dict[str, str], np.ndarray]:
    """Monolithic, uncompressed, attached; floats are scaled to 65535; FITS keywords are the metadata."""
    import xml.etree.ElementTree as ET

    if data[:8] != b"XISF0100":
        raise ValueError("not an XISF file")
    root = ET.fromstring(data[16 : 16 + struct.unpack_from("<I", data, 8)[0]].rstrip(b"\0"))
    tag = lambda e: e.tag.split("}")[-1]
    image = next(e for e in root.iter() if tag(e) == "Image")
    if "compression" in image.attrib:
        raise ValueError("compressed XISF is not read")
    w, h, c = map(int, image.attrib["geometry"].split(":"))
    where, at, _ = image.attrib["location"].split(":")
    if where != "attachment":
        raise ValueError("only attached data is read")
    kind, scale = {"UInt8": ("u1", 1.0), "UInt16": ("<u2", 1.0), "UInt32": ("<u4", 1 / 65535), "Float32": ("<f4", 65535.0), "Float64": ("<f8", 65535.0)}[image.attrib["sampleFormat"]]
    v = np.frombuffer(data, kind, w * h * c, int(at)).reshape(c, h, w)[:, ::-1].astype(np.float64) * scale
    return {e.attrib["name"]: e.attrib.get("value", "").strip("'") for e in image.iter() if tag(e) == "FITSKeyword"}, v.astype(np.float32)


def write_tiff(img: np.ndarray, bits: int = 16, description: str = "") -> bytes:
    """One strip, uncompressed: 16 bits or float of 32, grey or RGB."""
    c, h, w = img.shape
    v = np.clip(np.floor(img.astype(np.float64) + 0.5), 0, 65535).astype("<u2") if bits == 16 else img.astype("<f4")
    body = np.moveaxis(v, 0, -1).tobytes()
    text = description.encode("latin-1") + b"\0"
    per, kind = struct.pack(f"<{c}H", *[bits] * c), struct.pack(f"<{c}H", *[1 if bits == 16 else 3] * c)
    entries, extra, n = [], b"", 12
    at = 8 + 2 + 12 * n + 4

    def add(tag: int, kind_: int, count: int, value: int | bytes) -> None:
        nonlocal extra
        if isinstance(value, bytes):
            size = len(value)
            if size > 4:
                entries.append(struct.pack("<HHII", tag, kind_, count, at + len(extra)))
                extra += value + b"\0" * (size % 2)
                return
            entries.append(struct.pack("<HHI", tag, kind_, count) + value.ljust(4, b"\0"))
        else:
            entries.append(struct.pack("<HHI", tag, kind_, count) + (struct.pack("<HH", value, 0) if kind_ == 3 else struct.pack("<I", value)))

    add(256, 4, 1, w)
    add(257, 4, 1, h)
    add(258, 3, c, per)
    add(259, 3, 1, 1)
    add(262, 3, 1, 2 if c == 3 else 1)
    add(270, 2, len(text), text)
    place = len(entries)
    add(273, 4, 1, 0)
    add(277, 3, 1, c)
    add(278, 4, 1, h)
    add(279, 4, 1, len(body))
    add(284, 3, 1, 1)
    add(339, 3, c, kind)
    entries[place] = struct.pack("<HHII", 273, 4, 1, at + len(extra))
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", n) + b"".join(entries) + struct.pack("<I", 0) + extra + body


def read_tiff(data: bytes) -> np.ndarray:
    """Uncompressed, whole pixels, of 8, 16 or 32 bits; 8 bits are scaled by 256."""
    e = "<" if data[:2] == b"II" else ">"
    at = struct.unpack_from(e + "I", data, 4)[0]
    tags = {}
    for i in range(struct.unpack_from(e + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(e + "HHI", data, at + 2 + 12 * i)
        code, size = {1: ("B", 1), 2: ("B", 1), 3: ("H", 2), 4: ("I", 4)}.get(kind, ("I", 4))
        p = at + 10 + 12 * i
        p = p if n * size <= 4 else struct.unpack_from(e + "I", data, p)[0]
        tags[tag] = struct.unpack_from(f"{e}{n}{code}", data, p)
    if tags.get(259, (1,))[0] != 1:
        raise ValueError("compressed TIFF is not read")
    w, h, c, bits = tags[256][0], tags[257][0], tags.get(277, (1,))[0], tags[258][0]
    body = b"".join(data[o : o + n] for o, n in zip(tags[273], tags[279], strict=True))
    kind = "f4" if tags.get(339, (1,))[0] == 3 else f"u{bits // 8}"
    v = np.frombuffer(body, e + kind, w * h * c).reshape(h, w, c).astype(np.float32)
    return np.moveaxis(v * (256 if bits == 8 else 1), -1, 0)


def rice_encode(v: np.ndarray, k: int) -> bytes | None:
    """Unary quotient, then k bits, of whole numbers from 0; None if it isn't smaller than 2 bytes each."""
    v = np.asarray(v, np.int64)
    q = v >> k
    if int((q + 1 + k).sum()) >= 16 * len(v):
        return None
    bits = np.zeros(int((q + 1 + k).sum()), np.uint8)
    end = np.cumsum(q + 1 + k)
    start = end - (q + 1 + k)
    marks = np.zeros(len(bits) + 1, np.int64)
    np.add.at(marks, start, 1)
    np.add.at(marks, start + q, -1)
    bits[:] = np.cumsum(marks[:-1]) > 0
    for b in range(k):
        bits[start + q + 1 + b] = (v >> (k - 1 - b)) & 1
    return np.packbits(bits).tobytes()


def rice_decode(data: bytes, k: int, n: int) -> np.ndarray:
    bits, at, out = np.unpackbits(np.frombuffer(data, np.uint8)), 0, np.zeros(n, np.int64)
    for i in range(n):
        q = 0
        while bits[at]:
            q, at = q + 1, at + 1
        at += 1
        low = 0
        for b in bits[at : at + k]:
            low = low << 1 | int(b)
        out[i], at = q << k | low, at + k
    return out


RA_UNIT, DEC_UNIT = 2 * np.pi / (2**24 - 1), np.pi / 2 / (2**23 - 1)


def read_tile(data: bytes) -> np.ndarray:
    """Star tile: rows of ra, dec (radians), magnitude and BP - RP (NaN where the tile has none). 110 bytes of description,
    the last of them the record's size; a record of right ascension 0xFFFFFF sets magnitude and high declination byte."""
    size = data[109]
    rec = np.frombuffer(data, np.uint8, (len(data) - 110) // size * size, 110).reshape(-1, size).astype(np.int64)
    ra = rec[:, 0] | rec[:, 1] << 8 | rec[:, 2] << 16
    head = ra == 0xFFFFFF
    at = np.maximum.accumulate(np.where(head, np.arange(len(rec)), -1))
    ok = ~head & (at >= 0)
    high = rec[at[ok], 3] - 128
    dec = (high << 16) + (rec[ok, 4] << 8) + rec[ok, 3]
    colour = rec[ok, 5].astype(np.int8) / 10.0 if size == 6 else np.full(ok.sum(), np.nan)
    return np.stack([ra[ok] * RA_UNIT, dec * DEC_UNIT, (rec[at[ok], 4] - 16) / 10.0, colour], 1)


def write_tile(stars: np.ndarray, description: str = "stars") -> bytes:
    """stars: rows of ra, dec, magnitude, BP - RP; sorted by magnitude and high byte."""
    ra, dec = np.floor(stars[:, 0] / RA_UNIT + 0.5).astype(int), np.floor(stars[:, 1] / DEC_UNIT + 0.5).astype(int)
    mag = np.floor(stars[:, 2] * 10 + 0.5).astype(int)
    out, last = bytearray(description.encode()[:109].ljust(109)) + bytes([6]), None
    for i in np.lexsort((dec >> 16, mag)):
        group = (int(mag[i]), int(dec[i] >> 16))
        if group != last:
            out += bytes([255, 255, 255, group[1] + 128, group[0] + 16, 0])
            last = group
        out += bytes([ra[i] & 255, ra[i] >> 8 & 255, ra[i] >> 16, dec[i] & 255, dec[i] >> 8 & 255, int(np.floor(stars[i, 3] * 10 + 0.5)) & 255])
    return bytes(out)


def result_ini(solution: dict | None, command: str, width: int, height: int, error: int = 0, warning: str = "") -> str:
    """The solver's result file."""
    errors = {2: "Not enough stars.", 16: "Error reading image file.", 32: "No star database found.", 33: "Error reading star database."}
    lines = ["PLTSOLVD=T", *(f"{k}={v:e}" for k, v in solution.items())] if solution else ["PLTSOLVD=F"]
    lines += [f"CMDLINE={command}", f"DIMENSIONS={width} x {height}"]
    lines += [f"ERROR={errors[error]}"] if error in errors else []
    lines += [f"WARNING={warning}"] if warning else []
    return "\n".join(lines) + "\n"


def wcs_sidecar(cards: list[str]) -> bytes:
    text = "".join(x.ljust(80)[:80] for x in [*cards, "END"]).encode("latin-1")
    return text + b" " * (-len(text) % BLOCK)
