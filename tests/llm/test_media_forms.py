import hashlib
import math
import zlib

import numpy as np
from helpers import rows, table
from test_media_mix_chat import _filtered

from lodestone.llm import media


def _png(raw):
    """The stored form by the rules of the format, a sample at a time."""
    rows = [raw[i : i + 64] for i in range(0, len(raw), 64)]
    lines = b""
    for y, row in enumerate(rows):
        above = rows[y - 1] if y else bytes(64)
        ways = [bytes(row), bytes((v - (row[x - 1] if x else 0)) % 256 for x, v in enumerate(row)), bytes((v - u) % 256 for v, u in zip(row, above))]
        cost = [sum(min(v, 256 - v) for v in way) for way in ways]
        kind = cost.index(min(cost))
        lines += bytes([kind]) + ways[kind]
    part = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    head = (64).to_bytes(4, "big") + len(rows).to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(lines, 6)) + part(b"IEND", b"")


def _hash(raw):
    grid = [raw[i : i + 64] for i in range(0, len(raw), 64)]
    cut = lambda n: [(i * n // 32, max((i + 1) * n // 32, i * n // 32 + 1)) for i in range(32)]
    tall = [[sum(grid[y][x] for y in range(a, b)) * 1000 // (b - a) for x in range(64)] for a, b in cut(len(grid))]
    small = [[sum(row[x] for x in range(a, b)) * 1000 // (b - a) for a, b in cut(64)] for row in tall]
    wave = [[math.cos(math.pi * (2 * i + 1) * k / 64) for i in range(32)] for k in range(8)]
    low = [round(sum(wave[u][y] * wave[v][x] * small[y][x] for y in range(32) for x in range(32)), 3) for u in range(8) for v in range(8)]
    middle = sorted(low[1:])[31]
    return f"{int(''.join('1' if x > middle else '0' for x in low), 2):016x}"


def test_stored_form_and_feature_against_plain_forms(spark):
    data = [r for r in rows() if len(r[1] or "") < 3000]
    got = media.media_features(media.to_media(table(spark, data))).collect()
    want = []
    for r in data:
        raw = (r[1] or "").encode()
        raw = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        png = _png(raw)
        want.append((repr(r[0]), len(png), hashlib.sha256(png).hexdigest(), _hash(raw)))
    got = sorted((repr(g.doc_id), g.media_bytes, g.media_sha256, g.feature) for g in got)
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)]
    # values that all but equal the median may fall on either side of it
    apart = [bin(int(g[3], 16) ^ int(w[3], 16)).count("1") for g, w in zip(got, sorted(want))]
    assert max(apart) <= 1 and apart.count(0) >= len(apart) - 2


def test_bands_and_filters_of_large_images(monkeypatch):
    rng = np.random.default_rng(3)
    samples = rng.integers(0, 256, (301, 64), dtype=np.uint8)
    whole = media.encode_png(samples)
    monkeypatch.setattr(media, "_BAND", 50)
    assert media.encode_png(samples) == whole and (media.decode_png(whole) == samples).all()
    for kinds in ([3] * 301, [4] * 301, rng.integers(0, 5, 301)):
        assert (media.unfilter(_filtered(samples, kinds)) == samples).all()
