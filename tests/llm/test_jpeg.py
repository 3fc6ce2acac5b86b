import hashlib
import random
import zlib

import numpy as np
import pytest

from tidewell.llm.jpeg import average_hash, canonical_codes, encode_frames, media_columns, parse, payload_of, read_thumbnails, thumbnails


def encode_slowly(width, height, sampling, interval, seed):
    """A baseline JPEG with random coefficients and its luminance thumbnail, written bit by bit."""
    r = random.Random(seed)
    import struct

    many = len(sampling) > 1
    h, v = (max(s[0] for s in sampling), max(s[1] for s in sampling)) if many else (1, 1)
    rows, columns = -(-height // (8 * v)), -(-width // (8 * h))
    dc_table = (bytes([0, 0, 0, 0, 12] + [0] * 11), bytes(range(12)))
    ac_symbols = bytes([0x00, 0xF0] + [run * 16 + size for run in range(16) for size in range(1, 11)])
    ac_table = (bytes([0] * 7 + [162] + [0] * 8), ac_symbols)
    dc_codes, ac_codes = ({s: (c, n) for s, c, n in canonical_codes(*t)} for t in (dc_table, ac_table))
    step = 5
    grid = np.zeros((rows * (sampling[0][1] if many else 1), columns * (sampling[0][0] if many else 1)), int)
    body, bits, last = bytearray(), "", [0] * len(sampling)

    def value(x, size):
        return format(x if x >= 0 else x + (1 << size) - 1, f"0{size}b") if size else ""

    def flush():
        nonlocal bits
        bits += "1" * (-len(bits) % 8)
        for k in range(0, len(bits), 8):
            b = int(bits[k : k + 8], 2)
            body.append(b)
            if b == 255:
                body.append(0)
        bits = ""

    count = 0
    for y in range(rows):
        for x in range(columns):
            if interval and count and count % interval == 0:
                flush()
                body.extend([255, 0xD0 + (count // interval - 1) % 8])
                last = [0] * len(sampling)
            count += 1
            for c, (sh, sv) in enumerate(sampling):
                for by in range(sv if many else 1):
                    for bx in range(sh if many else 1):
                        dc = r.randrange(-200, 200)
                        if c == 0:
                            grid[y * (sv if many else 1) + by, x * (sh if many else 1) + bx] = dc
                        d, last[c] = dc - last[c], dc
                        size = abs(d).bit_length()
                        code, n = dc_codes[size]
                        bits += format(code, f"0{n}b") + value(d, size)
                        k = 1
                        while k < 64 and r.random() < 0.6:
                            run = r.choice([0, 0, 1, 5, 16])
                            if k + run > 63:
                                break
                            if run == 16:
                                code, n = ac_codes[0xF0]
                                bits += format(code, f"0{n}b")
                                k += 16
                                continue
                            a = r.choice([-300, -7, -1, 1, 3, 90])
                            size = abs(a).bit_length()
                            code, n = ac_codes[run * 16 + size]
                            bits += format(code, f"0{n}b") + value(a, size)
                            k += run + 1
                        if k < 64:
                            code, n = ac_codes[0]
                            bits += format(code, f"0{n}b")
    flush()
    segment = lambda m, b: struct.pack(">BBH", 255, m, len(b) + 2) + b
    head = b"\xff\xd8" + segment(0xE0, b"JFIF\0") + segment(0xDB, b"\0" + bytes([step] * 64))
    head += segment(0xC0, struct.pack(">BHHB", 8, height, width, len(sampling)) + b"".join(bytes([i + 1, sh * 16 + sv, 0]) for i, (sh, sv) in enumerate(sampling)))
    head += segment(0xC4, b"\x00" + b"".join(dc_table)) + segment(0xC4, b"\x10" + b"".join(ac_table))
    if interval:
        head += segment(0xDD, struct.pack(">H", interval))
    head += segment(0xDA, bytes([len(sampling)]) + b"".join(bytes([i + 1, 0]) for i in range(len(sampling))) + bytes([0, 63, 0]))
    luma_h, luma_w = (-(-height * sampling[0][1] // (8 * v)), -(-width * sampling[0][0] // (8 * h))) if many else (-(-height // 8), -(-width // 8))
    return head + bytes(body) + b"\xff\xd9", np.clip((grid[:luma_h, :luma_w] * step + 4) // 8 + 128, 0, 255)


@pytest.mark.parametrize("seed", range(12))
def test_any_baseline_image(seed):
    r = random.Random(seed)
    sampling = r.choice([[(1, 1)], [(2, 2)], [(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)]])
    file, want = encode_slowly(r.randrange(1, 120), r.randrange(1, 90), sampling, r.choice([0, 1, 3]), seed)
    ((_, got),) = read_thumbnails([file])
    assert got.tolist() == want.tolist()


@pytest.mark.parametrize("seed", range(5))
def test_round_trip(seed):
    r = random.Random(seed)
    payloads = [payload_of(bytes(r.choice([0, 255, r.randrange(256)]) for _ in range(r.choice([0, 1, 575, 576, 577, 5000])))) for _ in range(9)]
    files = encode_frames(payloads)
    assert files == [encode_frames([p])[0] for p in payloads]
    for p, (frame, thumb) in zip(payloads, read_thumbnails(files), strict=True):
        assert thumb.tobytes() == p and (frame.width, frame.height) == (192, len(p) // 3)


def test_damaged_files_are_refused():
    (file,) = encode_frames([payload_of(b"abc")])
    with pytest.raises(ValueError):
        read_thumbnails([file[: len(file) // 2]])
    with pytest.raises(ValueError):
        parse(b"GIF89a")


def test_rows(spark, awkward):
    rows = media_columns(awkward, keep_media=True).collect()
    texts = sorted((r.text or "").encode() for r in awkward.collect())
    assert len(rows) == len(texts)
    want = sorted((len(t), len(p := payload_of(t)), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])) for t in texts)
    assert sorted((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == want
    for r in rows:
        assert (len(r.media), hashlib.sha256(r.media).hexdigest()) == (r.media_bytes, r.media_sha256)
    same = [(r.media_sha256, r.feature) for r in rows if r.doc_id == 7]
    assert len(same) == 2 and same[0] == same[1]
    assert media_columns(awkward.limit(0)).count() == 0


def test_thumbnail_columns(spark):
    file, want = encode_slowly(50, 40, [(1, 1)], 0, 3)
    rows = thumbnails(spark.createDataFrame([(1, bytearray(file)), (2, bytearray(b"no")), (3, None)], "id long, image binary")).orderBy("id").collect()
    assert bytes(rows[0].thumbnail) == want.astype("uint8").tobytes() and rows[0].thumbnail_hash == average_hash(want.astype("uint8"))
    assert rows[1].thumbnail is None and rows[2].width is None
