"""Baseline JPEG in numpy: marker parsing, Huffman decoding of scans, DC-only luminance thumbnails and their hashes.

The decoder runs all restart segments of a batch of frames in lockstep: one numpy step decodes the next block of every
segment, so the cost a block is a few vector operations however short the images are. A thumbnail pixel is a block's
dequantised DC coefficient: its mean luminance.

A payload of bytes is stored without loss in the format's own unit: one byte is the quantised DC coefficient of one
8x8 block of a grey frame 64 blocks wide (quantiser 8, so the thumbnail pixel is the byte), a block row is a restart
segment, and payloads of more than 8191 rows take several frames, one after the other. A comment segment keeps the
payload's length before padding.

Defined results: null text is empty and has one row of zero bytes; very long texts take as many frames as they need; a
null or damaged image (among them one whose scan is too short for the size it claims) gives null features and costs the
others nothing; repeated rows each have a result; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photowarden.llm import common

WIDE = 64
MAX_ROWS = 8191
#: Block rows handled at once: bounds the memory of a task.
ROWS_AT_ONCE = 8192

# Fixed values of the standard: luminance DC code lengths (table K.3), symbols 0 to 11.
DC_COUNTS = bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0])
DC_SYMBOLS = bytes(range(12))
# An AC table of one code: end of block.
AC_COUNTS = bytes([1] + [0] * 15)
AC_SYMBOLS = bytes([0])
# Fixed values of the standard: zigzag-ordered quantisers here are all 8, so any order is the same.
QUANT = bytes([8] * 64)


def huffman_codes(counts: bytes, symbols: bytes) -> dict[int, tuple[int, int]]:
    """Symbol to (code, length), canonical."""
    codes, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            codes[symbols[k]] = (code, length)
            code += 1
            k += 1
        code <<= 1
    return codes


def huffman_lookup(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """By the next 16 bits: the symbol, and its code's length (0: no such code)."""
    symbol, length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    for s, (code, n) in huffman_codes(counts, symbols).items():
        at = code << (16 - n)
        symbol[at : at + (1 << (16 - n))] = s
        length[at : at + (1 << (16 - n))] = n
    return symbol, length


def _dc_words() -> tuple[np.ndarray, np.ndarray]:
    """By difference + 255: the bits of DC code, extra bits and end of block, and their number."""
    codes = huffman_codes(DC_COUNTS, DC_SYMBOLS)
    (eob, eob_n), words, sizes = huffman_codes(AC_COUNTS, AC_SYMBOLS)[0], [], []
    for d in range(-255, 256):
        cat = abs(d).bit_length()
        code, n = codes[cat]
        extra = d if d >= 0 else d + (1 << cat) - 1
        words.append((((code << cat) | extra) << eob_n) | eob)
        sizes.append(n + cat + eob_n)
    return np.array(words, np.int64), np.array(sizes, np.int64)


_WORDS, _SIZES = _dc_words()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def frame_header(rows: int, comment: bytes) -> bytes:
    return b"".join((
        b"\xff\xd8", _segment(0xFE, comment), _segment(0xDB, b"\0" + QUANT),
        _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, WIDE * 8, 1) + bytes([1, 0x11, 0])),
        _segment(0xC4, b"\0" + DC_COUNTS + DC_SYMBOLS), _segment(0xC4, b"\x10" + AC_COUNTS + AC_SYMBOLS),
        _segment(0xDD, struct.pack(">H", WIDE)), _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])),
    ))


def encode_rows(rows: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """Entropy-coded scans of frames; rows: all their bytes, 64 a row; ends: each frame's end in rows."""
    q = rows.astype(np.int64) - 128
    diff = q.copy()
    diff[:, 1:] -= q[:, :-1]
    diff += 255
    size = _SIZES[diff]
    word = _WORDS[diff]
    in_row = np.cumsum(size, axis=1)
    bits = in_row[:, -1]
    n_bytes = (bits + 7) >> 3
    first = np.cumsum(n_bytes) - n_bytes
    at = (in_row - size + (first << 3)[:, None]).ravel()
    word = (word << (24 - (at & 7).reshape(word.shape) - size)).ravel()  # at most 7 + 15 bits
    at >>= 3
    total = int(n_bytes.sum())
    out = np.zeros(total + 3, np.int64)
    for k, shift in enumerate((16, 8, 0)):
        got = np.bincount(at, weights=(word >> shift) & 255, minlength=total)
        out[k : k + len(got)] += got.astype(np.int64)
    last = first + n_bytes - 1
    out[last] += (1 << ((-bits) & 7)) - 1  # filled with ones
    out = out[:total].astype(np.uint8)
    wide = 1 + (out == 255)
    within = np.ones(len(rows), bool)
    within[ends - 1] = False
    wide[last[within]] += 2  # a restart marker follows
    place = np.cumsum(wide) - wide
    final = np.zeros(int(wide.sum()), np.uint8)
    final[place] = out  # stuffed zeros stay
    begins = np.concatenate(([0], ends[:-1]))
    number = np.arange(len(rows)) - np.repeat(begins, ends - begins)
    mark = place[last[within]] + wide[last[within]] - 2
    final[mark] = 255
    final[mark + 1] = 0xD0 + number[within] % 8
    stops = place[last[ends - 1]] + wide[last[ends - 1]]
    starts = np.concatenate(([0], stops[:-1]))
    return [final[a:b].tobytes() for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]


def store_payloads(payloads: list[bytes], lengths: list[int]) -> list[bytes]:
    """Each payload (a positive multiple of 64 bytes) as JPEG frames; lengths: before padding, kept as a comment."""
    frames = [(k, p[a : a + MAX_ROWS * WIDE]) for k, p in enumerate(payloads) for a in range(0, len(p), MAX_ROWS * WIDE)]
    parts: list[list[bytes]] = [[] for _ in payloads]
    k = 0
    while k < len(frames):
        end, total = k, 0
        while end < len(frames) and (end == k or total + len(frames[end][1]) <= ROWS_AT_ONCE * WIDE):
            total += len(frames[end][1])
            end += 1
        rows = np.frombuffer(b"".join(f for _, f in frames[k:end]), np.uint8).reshape(-1, WIDE)
        ends = np.cumsum([len(f) // WIDE for _, f in frames[k:end]])
        for (owner, f), scan in zip(frames[k:end], encode_rows(rows, ends), strict=True):
            parts[owner] += [frame_header(len(f) // WIDE, b"bytes=%d" % lengths[owner]), scan, b"\xff\xd9"]
        k = end
    return [b"".join(p) for p in parts]


_SCAN_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]")


class Frame:
    """The parsed markers of one baseline frame, and where its luminance is coded.

    A scan has all components interleaved, or each component has a scan of its own; of those only the first component's
    is read. A size that the scan's bytes cannot hold is damage.
    """

    __slots__ = ("ac", "at", "comment", "components", "dc", "end", "height", "layout", "quant", "restart", "scan", "scan_end", "width")

    def __init__(self, data: bytes, at: int = 0):
        if data[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        self.comment, self.restart, self.quant, self.dc, self.ac, self.components = b"", 0, {}, {}, {}, []
        self.layout: list = []
        at += 2
        while True:
            if data[at] != 0xFF:
                raise ValueError("no marker")
            kind = data[at + 1]
            if kind == 0xFF:
                at += 1
                continue
            if kind == 0xD9:
                break
            (n,) = struct.unpack_from(">H", data, at + 2)
            body = data[at + 4 : at + 2 + n]
            at += 2 + n
            if kind == 0xDB:
                while body:
                    wide = 2 if body[0] >> 4 else 1
                    self.quant[body[0] & 15] = int.from_bytes(body[1 : 1 + wide], "big")  # of the DC coefficient
                    body = body[1 + 64 * wide :]
            elif kind == 0xC4:
                while body:
                    n_symbols = sum(body[1:17])
                    (self.ac if body[0] >> 4 else self.dc)[body[0] & 15] = (body[1:17], body[17 : 17 + n_symbols])
                    body = body[17 + n_symbols :]
            elif kind == 0xC0:
                _, self.height, self.width, n_parts = struct.unpack_from(">BHHB", body)
                self.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n_parts)]
            elif 0xC1 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not baseline")
            elif kind == 0xDD:
                (self.restart,) = struct.unpack(">H", body)
            elif kind == 0xFE:
                self.comment = body
            elif kind == 0xDA:
                tables = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
                at = self._scan(data, at, tables)
        self.end = at
        if not self.layout:
            raise ValueError("no scan of luminance")

    def _scan(self, data: bytes, at: int, tables: dict[int, tuple[int, int]]) -> int:
        end = _SCAN_END.search(data, at)
        if end is None:
            raise ValueError("no end of scan")
        if not self.components or not self.width or not self.height or self.components[0][3] not in self.quant:
            raise ValueError("a scan without frame or quantiser")
        every = len(tables) == len(self.components)
        if not every and len(tables) != 1:
            raise ValueError("some components interleaved")
        if self.components[0][0] in tables and not self.layout:
            single = len(tables) == 1
            # blocks of an MCU in order: component, DC table, AC table
            self.layout = [(k, self.dc[tables[c][0]], self.ac[tables[c][1]]) for k, (c, h, v, _) in enumerate(self.components) if c in tables for _ in range(1 if single else h * v)]
            self.scan, self.scan_end = at, end.start()
            across, down, _, _ = self.grid()
            if across * down * len(self.layout) * 2 > (self.scan_end - self.scan) * 8:  # two codes a block
                raise ValueError("more blocks than bits")
        return end.start()

    def grid(self) -> tuple[int, int, int, int]:
        """MCUs across and down, luminance blocks across and down an MCU."""
        wide, high = max(c[1] for c in self.components), max(c[2] for c in self.components)
        _, h, v, _ = self.components[0]
        if len(self.layout) == 1:  # of the luminance alone
            return -(-self.width * h // (8 * wide)), -(-self.height * v // (8 * high)), 1, 1
        return -(-self.width // (8 * wide)), -(-self.height // (8 * high)), h, v

    def key(self) -> tuple:
        return self.restart, tuple(self.layout)


def parse_frames(data: bytes) -> list[Frame]:
    frames, at = [], 0
    while at < len(data):
        frames.append(Frame(data, at))
        at = frames[-1].end + 2
    return frames


def decode_dc(scans: list[bytes], n_mcus: list[int], restart: int, layout: list) -> list[np.ndarray]:
    """The quantised luminance DC coefficients of each scan, in order of MCU and block; all have one layout."""
    raw = np.frombuffer(b"".join(scans), np.uint8)
    ends = np.cumsum([len(s) for s in scans])
    begins = ends - [len(s) for s in scans]
    ff = np.flatnonzero(raw[:-1] == 255)
    after = raw[ff + 1]
    keep = np.ones(len(raw), bool)
    keep[ff[after == 0] + 1] = False
    marks = ff[(after >= 0xD0) & (after <= 0xD7)]
    keep[marks] = False
    keep[marks + 1] = False
    starts = np.sort(np.concatenate((begins, marks + 2)))
    where = np.concatenate(([0], np.cumsum(keep)))
    owner = np.searchsorted(ends, starts, side="right")
    per = np.array(n_mcus)
    step = np.arange(len(starts)) - np.searchsorted(starts, begins)[owner]
    interval = restart or int(per.max())
    lengths = np.minimum(interval, per[owner] - step * interval)
    if (lengths <= 0).any() or len(starts) != int(-(-per // interval).sum()):
        raise ValueError("restart markers don't match the size")
    packed = np.concatenate((raw[keep], np.zeros(8, np.uint8))).astype(np.int64)
    window = (packed[:-3] << 24) | (packed[1:-2] << 16) | (packed[2:-1] << 8) | packed[3:]
    pos = where[starts] << 3
    limit = len(window) - 1
    tables = {}
    for _, dc, ac in layout:
        for t in (dc, ac):
            tables.setdefault(t, huffman_lookup(*t))
    n_luma = sum(k == 0 for k, _, _ in layout)
    out = np.zeros((len(starts), int(lengths.max()), n_luma), np.int64)
    pred = np.zeros((len({k for k, _, _ in layout}), len(starts)), np.int64)
    same = lengths.min() == lengths.max()

    def bits(at: np.ndarray) -> np.ndarray:
        return (window[np.minimum(at >> 3, limit)] << (at & 7)) & 0xFFFFFFFF

    for m in range(int(lengths.max())):
        lanes = slice(None) if same else np.flatnonzero(lengths > m)
        p = pos[lanes]
        luma = 0
        for part, dc, ac in layout:
            symbol, length = tables[dc]
            look = bits(p)
            top = look >> 16
            cat, n = symbol[top], length[top]
            if not n.all():
                raise ValueError("no such code")
            extra = (look >> (32 - n - cat)) & ((1 << cat) - 1)  # code and extra bits: at most 16 + 11, of 25 valid; codes of this length are never both
            extra -= np.where((cat > 0) & (extra < (1 << np.maximum(cat - 1, 0))), (1 << cat) - 1, 0)
            p = p + n + cat
            pred[part, lanes] += extra
            if part == 0:
                out[lanes, m, luma] = pred[part, lanes]
                luma += 1
            symbol, length = tables[ac]
            todo, seen = np.arange(len(p)), np.ones(len(p), np.int64)
            while len(todo):
                look = bits(p[todo]) >> 16
                s, n = symbol[look], length[look]
                if not n.all():
                    raise ValueError("no such code")
                p[todo] += n + (s & 15)
                seen[todo] += (s >> 4) + 1
                todo = todo[(s != 0) & (seen[todo] < 64)]
        pos[lanes] = p
    flat = [out[k, :n].reshape(-1) for k, n in enumerate(lengths.tolist())] if not same else None
    first = np.searchsorted(owner, np.arange(len(scans) + 1))
    return [np.concatenate(flat[a:b]) if flat else out[a:b].reshape(-1) for a, b in zip(first[:-1], first[1:], strict=True)]


def thumbnails(images: list[bytes | None]) -> list[list[tuple[Frame, np.ndarray]] | None]:
    """For each image its frames with their DC-only luminance thumbnails (uint8, rows by columns); None if damaged."""
    parsed: list[list[Frame] | None] = []
    for data in images:
        try:
            parsed.append(parse_frames(data) if data else None)
        except (ValueError, IndexError, KeyError, AttributeError, ZeroDivisionError, struct.error):
            parsed.append(None)
    found: dict[tuple[int, int], np.ndarray] = {}
    groups: dict[tuple, list[tuple[int, int]]] = {}
    for k, frames in enumerate(parsed):
        for i, f in enumerate(frames or ()):
            groups.setdefault(f.key(), []).append((k, i))
    for (restart, layout), members in groups.items():
        while members:
            some, blocks = [], 0
            while members and (not some or blocks < ROWS_AT_ONCE * WIDE):
                k, i = members.pop()
                across, down, *_ = parsed[k][i].grid()
                blocks += across * down * len(layout)
                some.append((k, i))
            for one in _decoded(images, parsed, some, restart, list(layout)):
                found |= one
    out: list[list[tuple[Frame, np.ndarray]] | None] = []
    for k, frames in enumerate(parsed):
        whole = frames is not None and all((k, i) in found for i in range(len(frames)))
        out.append([(f, found[k, i]) for i, f in enumerate(frames)] if whole else None)
    return out


def _decoded(images, parsed, some, restart, layout):
    frames = [parsed[k][i] for k, i in some]
    scans = [images[k][f.scan : f.scan_end] for (k, _), f in zip(some, frames, strict=True)]
    sizes = [f.grid()[0] * f.grid()[1] for f in frames]
    try:
        planes = decode_dc(scans, sizes, restart, layout)
    except (ValueError, IndexError):
        if len(some) > 1:  # a damaged one must not cost the others
            for one in some:
                yield from _decoded(images, parsed, [one], restart, layout)
        return
    for where, f, dc in zip(some, frames, planes, strict=True):
        across, down, h, v = f.grid()
        pixels = dc.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
        pixels = pixels * f.quant[f.components[0][3]] // 8 + 128
        yield {where: np.clip(pixels, 0, 255).astype(np.uint8)[: -(-f.height // 8), : -(-f.width // 8)]}


def thumbnail_hash(pixels: np.ndarray) -> str:
    """64 bits in hex: whether each cell of an 8x8 grid of means is above the whole mean."""
    h, w = pixels.shape
    rows, cols = np.arange(8) * h // 8, np.arange(8) * w // 8
    if h >= 8 and w >= 8:
        sums = np.add.reduceat(np.add.reduceat(pixels.astype(np.int64), rows, axis=0), cols, axis=1)
        area = np.outer(np.diff(np.append(rows, h)), np.diff(np.append(cols, w)))
        cells = sums / area
    else:
        cells = pixels[np.ix_(rows, cols)].astype(float)
    return np.packbits(cells.ravel() > cells.mean()).tobytes().hex()


def store_text(docs: DataFrame) -> DataFrame:
    """doc_id, media: each text's UTF-8 bytes, padded with zeros to a positive multiple of 64, as JPEG."""
    common.prepare(docs.sparkSession)

    def run(batches):
        for batch in common.slices(batches):
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            payloads = [b + bytes(-len(b) % WIDE if b else WIDE) for b in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(store_payloads(payloads, [len(b) for b in raw]), pa.binary())], ["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, media binary")


_LENGTH = re.compile(rb"bytes=(\d{1,18})")
_FEATURES = {
    "doc_id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(),
    "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "width": pa.int32(), "height": pa.int32(), "frames": pa.int32(),
}


def read_media(stored: DataFrame) -> DataFrame:
    """Decode doc_id, media: dimensions, thumbnail hash, and digests of the payload that the thumbnails hold."""
    common.prepare(stored.sparkSession)

    def run(batches):
        for batch in common.slices(batches):
            docs, media = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = []
            for doc, data, frames in zip(docs, media, thumbnails(media), strict=True):
                size, sha = (len(data), hashlib.sha256(data).hexdigest()) if data is not None else (None, None)
                if not frames:
                    rows.append((doc, None, None, None, None, size, sha, None, None, None, None))
                    continue
                payload = b"".join(p.tobytes() for _, p in frames)
                said = _LENGTH.fullmatch(frames[0][0].comment)
                n = int(said[1]) if said else len(payload)
                wide, high = frames[0][0].width, sum(f.height for f, _ in frames)
                pixels = frames[0][1] if len(frames) == 1 else np.concatenate([p for _, p in frames])
                feature = f"{wide}x{high}:{thumbnail_hash(pixels)}"
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDE:]), size, sha, feature, wide, high, len(frames)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _FEATURES.values(), strict=True)], list(_FEATURES))

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int, frames int"
    return stored.select(F.col("doc_id").cast("long"), F.col("media")).mapInArrow(run, schema)
