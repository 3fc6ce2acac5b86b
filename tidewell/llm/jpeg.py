"""Operator 6: baseline JPEG columns with DC-only luminance thumbnails.

``thumbnails`` reads baseline JPEG images: it parses the markers, Huffman-decodes the scans and keeps each luminance
block's DC coefficient, so a thumbnail has one sample for each block of 8 x 8. Restart intervals are decoded in
lockstep by numpy, all intervals of a batch at once.

``media_columns`` stores texts as such images: a sample of the thumbnail, hence a block of the image, for each byte.
The quantiser of the DC coefficient is 8, so byte b is stored as DC b - 128 and comes back exactly.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, needs, utf8

UNIT = 576
ROW = 24
#: Rows of blocks in an image: the largest multiple of 24 that 16 bits of pixels allow.
FRAME_ROWS = 8184
#: Payload bytes that are worked on at a time.
SLAB = 3 << 17
#: Codes of the usual luminance DC table for the categories 0 to 8 (fixed values): counts by length, then symbols.
DC_COUNTS = bytes([0, 1, 5, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0])
DC_SYMBOLS = bytes(range(9))
#: No AC coefficient is ever coded: end of block is the only symbol.
AC_COUNTS = bytes([1] + [0] * 15)
AC_SYMBOLS = bytes([0])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(rows: int) -> bytes:
    return b"".join(
        [
            b"\xff\xd8",
            _segment(0xDB, b"\0" + bytes([8] * 64)),
            _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, ROW * 8, 1) + bytes([1, 0x11, 0])),
            _segment(0xC4, b"\x00" + DC_COUNTS + DC_SYMBOLS),
            _segment(0xC4, b"\x10" + AC_COUNTS + AC_SYMBOLS),
            _segment(0xDD, struct.pack(">H", ROW)),
            _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
        ]
    )


def canonical_codes(counts: bytes, symbols: bytes) -> list[tuple[int, int, int]]:
    """(symbol, code, length) in order of the code."""
    out, code, k = [], 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out.append((symbols[k], code, length))
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _difference_codes() -> tuple[np.ndarray, np.ndarray]:
    """For each difference of DC values from -255 to 255 (at index 255 + it): the code with its extra bits and the end
    of block (a single 0), and the number of bits."""
    codes = {s: (c, n) for s, c, n in canonical_codes(DC_COUNTS, DC_SYMBOLS)}
    value, length = np.zeros(511, np.uint64), np.zeros(511, np.uint8)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = codes[size]
        value[255 + d] = ((code << size) | (d if d >= 0 else d + (1 << size) - 1)) << 1
        length[255 + d] = n + size + 1
    return value, length


_VALUE, _BITS = _difference_codes()
#: 32-bit words that a row of codes can take: 24 codes of at most 15 bits.
_WORDS = 12


def encode_frames(payloads: list[bytes]) -> list[bytes]:
    """A JPEG file for each payload: a multiple of 24 rows of 24 bytes, at most FRAME_ROWS rows. All rows of all
    payloads are coded in lockstep, one column after another."""
    rows_of = np.array([len(p) // ROW for p in payloads])
    level = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, ROW).T.astype(np.int16)
    n = level.shape[1]
    words, used = np.zeros((n, _WORDS), ">u4"), np.zeros(n, np.int64)
    pending, bits = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    previous = np.full(n, 128, np.int16)
    for column in level:
        index = column - previous + 255
        previous = column
        size = _BITS[index]
        pending = (pending << size) | _VALUE[index]
        bits += size
        if len(full := np.flatnonzero(bits >= 32)):
            bits[full] -= np.uint64(32)
            words[full, used[full]] = (pending[full] >> bits[full]) & np.uint64(0xFFFFFFFF)
            used[full] += 1
    spare = np.uint64(32) - bits
    words[np.arange(n), used] = ((pending << spare) | ((np.uint64(1) << spare) - np.uint64(1))) & np.uint64(0xFFFFFFFF)  # 1s fill the last byte
    row_bytes = 4 * used + ((bits + np.uint64(7)) >> np.uint64(3)).astype(np.int64)
    frame_first = np.cumsum(rows_of) - rows_of
    number = np.arange(n) - np.repeat(frame_first, rows_of)
    # each row: a restart marker (not in front of an image's first row), then its bytes, each 255 among them followed by 0
    matrix = np.empty((n, 2 + 4 * _WORDS), np.uint8)
    matrix[:, 0], matrix[:, 1], matrix[:, 2:] = 255, 0xD0 + (number - 1) % 8, words.view(np.uint8).reshape(n, -1)
    valid = np.arange(-2, 4 * _WORDS)[None, :] < row_bytes[:, None]
    valid[frame_first, :2] = False
    stuffed = (matrix == 255) & valid
    stuffed[:, :2] = False
    ends = np.cumsum(valid.sum(1) + stuffed.sum(1))[frame_first + rows_of - 1].tolist()
    blob = np.insert(matrix[valid], np.flatnonzero(stuffed[valid]) + 1, 0).tobytes()
    return [_header(int(k)) + blob[x:y] + b"\xff\xd9" for k, x, y in zip(rows_of, [0, *ends[:-1]], ends, strict=True)]


# --- reading


@dataclass
class Frame:
    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantiser
    quantisers: dict[int, int] = field(default_factory=dict)  # table -> step of the DC coefficient
    dc: dict[int, tuple[bytes, bytes]] = field(default_factory=dict)
    ac: dict[int, tuple[bytes, bytes]] = field(default_factory=dict)
    tables: list[tuple[int, int]] = field(default_factory=list)  # of each component in the scan
    interval: int = 0
    data: np.ndarray | None = None
    starts: np.ndarray | None = None

    @property
    def mcus(self) -> tuple[int, int]:
        h, v = (max(c[k] for c in self.components) for k in (1, 2))
        if len(self.components) == 1:
            h = v = 1
        return -(-self.height // (8 * v)), -(-self.width // (8 * h))

    @property
    def layout(self) -> list[tuple[int, int, int]]:
        """(component, row, column) of each block in an MCU."""
        if len(self.components) == 1:
            return [(0, 0, 0)]
        return [(c, y, x) for c, (_, h, v, _) in enumerate(self.components) for y in range(v) for x in range(h)]

    def key(self) -> tuple:
        return (tuple(self.tables), tuple(sorted(self.dc.items())), tuple(sorted(self.ac.items())), tuple(self.layout))


def parse(file: bytes) -> Frame:
    """Markers up to the scan, and the scan's bytes without stuffing and restart markers. Baseline, one scan."""
    if file[:2] != b"\xff\xd8":
        raise ValueError("no start of image")
    f, at = Frame(), 2
    while True:
        while file[at] == 0xFF and file[at + 1] == 0xFF:
            at += 1
        if file[at] != 0xFF:
            raise ValueError("no marker where one is due")
        marker = file[at + 1]
        (n,) = struct.unpack_from(">H", file, at + 2)
        body, at = file[at + 4 : at + 2 + n], at + 2 + n
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                f.quantisers[body[k] & 15] = int.from_bytes(body[k + 1 : k + 2 + wide], "big")
                k += 1 + 64 * (1 + wide)
        elif marker == 0xC0:
            precision, f.height, f.width, count = struct.unpack_from(">BHHB", body)
            if precision != 8:
                raise ValueError("8-bit samples only")
            f.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(count)]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("baseline images only")
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                counts = body[k + 1 : k + 17]
                (f.ac if body[k] >> 4 else f.dc)[body[k] & 15] = (counts, body[k + 17 : k + 17 + sum(counts)])
                k += 17 + sum(counts)
        elif marker == 0xDD:
            (f.interval,) = struct.unpack(">H", body)
        elif marker == 0xDA:
            if body[0] != len(f.components):
                raise ValueError("one scan of all components only")
            chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            f.tables = [(chosen[c[0]] >> 4, chosen[c[0]] & 15) for c in f.components]
            break
    scan = np.frombuffer(file, np.uint8)[at:]
    ff = np.flatnonzero(scan[:-1] == 255)
    following = scan[ff + 1]
    restart = (following >= 0xD0) & (following <= 0xD7)
    other = ff[~restart & (following != 0)]
    end = int(other[0]) if len(other) else len(scan)
    restarts = ff[restart & (ff < end)]
    gone = np.sort(np.concatenate([ff[(following == 0) & (ff < end)] + 1, restarts, restarts + 1]))
    keep = np.ones(end, bool)
    keep[gone] = False
    f.data = scan[:end][keep]
    f.starts = np.concatenate([[0], restarts - np.searchsorted(gone, restarts)])
    return f


_LOOKUPS: dict[tuple[bytes, bytes], np.ndarray] = {}


def _lookup(table: tuple[bytes, bytes]) -> np.ndarray:
    """Code length * 256 + symbol for every 16 bits that may come next (0: no code)."""
    if table not in _LOOKUPS:
        found = np.zeros(1 << 16, np.uint64)
        for s, code, n in canonical_codes(*table):
            found[code << (16 - n) : (code + 1) << (16 - n)] = n * 256 + s
        _LOOKUPS[table] = found
    return _LOOKUPS[table]


def decode_dc(frames: list[Frame]) -> list[np.ndarray]:
    """The luminance thumbnail of each frame; all frames must have the same key()."""
    head = frames[0]
    blocks = head.layout
    luma = [b for b, (c, _, _) in enumerate(blocks) if c == 0]
    counts, bases, at = [], [], 0
    for f in frames:
        rows, columns = f.mcus
        interval = f.interval or rows * columns
        lanes = -(-rows * columns // interval)
        if len(f.starts) < lanes:
            raise ValueError("restart intervals are missing")
        counts.append(np.minimum(interval, rows * columns - interval * np.arange(lanes)))
        bases.append(f.starts[:lanes] + at)
        at += len(f.data)
    data = np.concatenate([f.data for f in frames] + [np.full(16, 255, np.uint8)]).astype(np.uint64)
    word = data[:-7]
    for k in range(1, 8):
        word = (word << np.uint64(8)) | data[k : len(data) - 7 + k]
    position = np.concatenate(bases).astype(np.uint64) * np.uint64(8)
    left = np.concatenate(counts)
    limit, most = np.uint64((len(word) - 1) * 8), int(left.max())
    values = np.zeros((len(luma), most, len(left)), np.int16)
    previous = [np.zeros(len(left), np.int64) for _ in head.components]
    order = None if int(left.min()) == most else np.argsort(-left, kind="stable")
    if order is not None:
        position, left = position[order], left[order]
        bound = np.searchsorted(-left, -np.arange(most), "left")  # lanes that still have an MCU m
    seven, three, top, one = (np.uint64(x) for x in (7, 3, 48, 1))
    tables = [(_lookup(head.dc[d]), _lookup(head.ac[a])) for d, a in head.tables]

    for m in range(most):
        live = len(position) if order is None else int(bound[m])
        p = position[:live]
        for b, (c, _, _) in enumerate(blocks):
            dc, ac = tables[c]
            w = word[p >> three] << (p & seven)  # at least 57 bits: two codes and the extra bits of the first
            found = dc[w >> top]
            length, size = found >> np.uint64(8), found & np.uint64(255)
            w <<= length
            extra = ((w >> one) >> (np.uint64(63) - size)).astype(np.int64)
            w <<= size
            half = (one << size).astype(np.int64)
            previous[c][:live] += extra - np.where(extra * 2 < half, half - 1, 0) * (size > 0)
            if c == 0:
                values[luma.index(b), m, :live] = previous[c][:live]
            following = ac[w >> top]
            if not (length.all() and following.all()):
                raise ValueError("a code that the table lacks")
            p = p + length + size + (following >> np.uint64(8))
            run = following & np.uint64(255)
            if run.any():  # AC coefficients: skip them, lane by lane in lockstep
                k, busy = np.ones(live, np.uint64), np.flatnonzero(run)
                while len(busy):
                    r = run[busy]
                    p[busy] += r & np.uint64(15)
                    k[busy] += (r >> np.uint64(4)) + one
                    busy = busy[k[busy] < 64]
                    if (p[busy] > limit).any():
                        raise ValueError("the scan ends early")
                    following = ac[(word[p[busy] >> three] << (p[busy] & seven)) >> top]
                    if not following.all():
                        raise ValueError("a code that the table lacks")
                    p[busy] += following >> np.uint64(8)
                    run[busy] = following & np.uint64(255)
                    busy = busy[run[busy] != 0]
            if (p > limit).any():
                raise ValueError("the scan ends early")
        position[:live] = p
    values = values.transpose(2, 1, 0)
    if order is not None:
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        values = values[back]
    out, lane = [], 0
    h, v = (head.components[0][1], head.components[0][2]) if len(head.components) > 1 else (1, 1)
    for f, n in zip(frames, counts, strict=True):
        rows, columns = f.mcus
        own = values[lane : lane + len(n)]
        lane += len(n)
        flat = own.reshape(-1, len(luma)) if (n == most).all() else np.concatenate([own[i, :x] for i, x in enumerate(n)])
        grid = flat.reshape(rows, columns, v, h).transpose(0, 2, 1, 3).reshape(rows * v, columns * h)
        step = f.quantisers[f.components[0][3]]
        sample = np.clip((grid.astype(np.int32) * step + 4) // 8 + 128, 0, 255).astype(np.uint8)
        tall, wide = max(c[2] for c in f.components), max(c[1] for c in f.components)
        keep_rows = -(-f.height * v // (8 * tall)) if len(f.components) > 1 else -(-f.height // 8)
        keep_columns = -(-f.width * h // (8 * wide)) if len(f.components) > 1 else -(-f.width // 8)
        out.append(sample[:keep_rows, :keep_columns])
    return out


def read_thumbnails(files: list[bytes]) -> list[tuple[Frame, np.ndarray]]:
    frames = [parse(x) for x in files]
    groups: dict[tuple, list[int]] = {}
    for i, f in enumerate(frames):
        groups.setdefault(f.key(), []).append(i)
    out: list = [None] * len(files)
    for members in groups.values():
        for i, t in zip(members, decode_dc([frames[i] for i in members]), strict=True):
            out[i] = (frames[i], t)
    return out


def average_hash(thumbnail: np.ndarray) -> str:
    """64 bits in hex: which cells of an 8 x 8 grid over the thumbnail are brighter than their mean."""
    height, width = thumbnail.shape
    if height % 8 == 0 and width % 8 == 0:
        cells = thumbnail.reshape(8, height // 8, width).sum(1, dtype=np.int64).reshape(8, 8, width // 8).sum(2)
    else:
        rows, columns = ((np.arange(8) * n) // 8 for n in thumbnail.shape)
        sums = np.add.reduceat(np.add.reduceat(thumbnail.astype(np.int64), rows, 0), columns, 1)
        cells = sums / (np.maximum(1, np.diff(rows, append=height))[:, None] * np.maximum(1, np.diff(columns, append=width))[None, :])
    return np.packbits(cells > cells.mean()).tobytes().hex()


def thumbnails(images: DataFrame, column: str = "image") -> DataFrame:
    """``images`` with width, height, thumbnail (binary, row by row), thumbnail_hash (hex) of its JPEG column.

    Nulls and files that aren't baseline JPEG give nulls there.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple] = []
        for file in batch.column(column).to_pylist():
            try:
                ((f, t),) = read_thumbnails([file]) if file else [(None, None)]
                rows.append((f.width, f.height, t.tobytes(), average_hash(t)) if f else (None,) * 4)
            except (ValueError, KeyError, IndexError, struct.error):
                rows.append((None,) * 4)
        added = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.string()))]
        return pa.RecordBatch.from_arrays([*[batch.column(c) for c in batch.schema.names], *added], [*batch.schema.names, "width", "height", "thumbnail", "thumbnail_hash"])

    fields = ", ".join(f"`{c}` {t}" for c, t in images.dtypes)
    return map_batches(images, run, f"{fields}, width int, height int, thumbnail binary, thumbnail_hash string")


class _Document:
    def __init__(self, n_bytes: int):
        self.n_bytes, self.payload_bytes, self.media_bytes, self.frames, self.height = n_bytes, 0, 0, 0, 0
        self.payload_sha, self.media_sha, self.tail, self.hashes, self.media = hashlib.sha256(), hashlib.sha256(), b"", hashlib.sha256(), []


def payload_of(text: bytes) -> bytes:
    return text + b"\xff" * (-len(text) % UNIT if text else UNIT)


def media_columns(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """Each text (null: empty) as JPEG images, read back: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature, and with ``keep_media`` the files themselves.

    Texts over one image's bounds become several, one behind the other. Equal texts give equal values; repeated rows
    are stored each. Other columns are left out.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = utf8(batch.column("text"))
        found = [_Document(len(t)) for t in texts]
        slab: list[tuple[int, bytes]] = []

        def flush() -> None:
            files = encode_frames([p for _, p in slab])
            for (i, _), file, (frame, thumb) in zip(slab, files, read_thumbnails(files), strict=True):
                d, back = found[i], thumb.tobytes()
                d.payload_bytes += len(back)
                d.media_bytes += len(file)
                d.frames += 1
                d.height += frame.height
                d.payload_sha.update(back)
                d.media_sha.update(file)
                d.tail = back[-32:]
                d.hashes.update(average_hash(thumb).encode())
                if keep_media:
                    d.media.append(file)
            slab.clear()

        held = 0
        for i, t in enumerate(texts):
            payload = payload_of(t)
            for at in range(0, len(payload), FRAME_ROWS * ROW):
                part = payload[at : at + FRAME_ROWS * ROW]
                if slab and held + len(part) > SLAB:
                    flush()
                    held = 0
                slab.append((i, part))
                held += len(part)
        if slab:
            flush()
        columns = [
            batch.column("doc_id"),
            pa.array([d.n_bytes for d in found], pa.int64()),
            pa.array([d.payload_bytes for d in found], pa.int64()),
            pa.array([d.payload_sha.hexdigest() for d in found]),
            pa.array([zlib.crc32(d.tail) for d in found], pa.int64()),
            pa.array([d.media_bytes for d in found], pa.int64()),
            pa.array([d.media_sha.hexdigest() for d in found]),
            pa.array([f"jpeg:{d.frames}:{ROW * 8}x{d.height}:{d.hashes.hexdigest()[:16]}" for d in found]),
        ]
        if keep_media:
            columns.append(pa.array([b"".join(d.media) for d in found], pa.binary()))
        return pa.RecordBatch.from_arrays(columns, names + ["media"] * keep_media)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_batches(needs(docs, "doc_id", "text"), run, schema + ", media binary" * keep_media)
