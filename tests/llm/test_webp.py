import hashlib
import zlib

import numpy as np
import pytest

from cairnflow.llm import webp as W

RNG = np.random.default_rng(11)


def picture(h, w, colors=None, alpha=False):
    x = RNG.integers(0, 256, (h, w, 3)) if colors is None else RNG.integers(0, 256, (colors, 3))[RNG.integers(0, colors, (h, w))]
    x = (x // 7 + np.add.outer(np.arange(h), np.arange(w))[:, :, None]) % 256 if colors is None else x
    a = RNG.integers(0, 256, (h, w)) if alpha else np.full((h, w), 255)
    return W._joined(a, *np.moveaxis(x, 2, 0))


def test_code_lengths_are_complete_and_bounded():
    for counts in ([1, 1], [5, 0, 1], [2**k for k in range(30)], RNG.integers(0, 9, 280).tolist(), [1] * 256):
        n = W.code_lengths(np.array(counts))
        assert (2.0 ** -n[n > 0].astype(float)).sum() == 1 and n.max() <= 15
        assert [bool(x) for x in n] == [c > 0 for c in counts]


@pytest.mark.parametrize("shape", [(1, 1), (1, 7), (9, 1), (5, 6), (40, 33)])
@pytest.mark.parametrize("kind", ["plain", "alpha", "cache", "subtract", "cross", "all", "palette2", "palette4", "palette16", "palette200", "one"])
def test_round_trips(shape, kind):
    h, w = shape
    colors = int(kind[7:]) if kind.startswith("palette") else 1 if kind == "one" else 30 if kind == "cache" else None
    argb = picture(h, w, colors, kind == "alpha")
    size = 3
    planes = (-(-h // 8), -(-w // 8))
    modes, elements = RNG.integers(0, 14, planes), RNG.integers(0, 1 << 24, planes).astype(np.uint32) | np.uint32(0xFF000000)
    use = {
        "subtract": [(W.SUBTRACT,)],
        "cross": [(W.CROSS, size, elements)],
        "all": [(W.PREDICT, size, modes), (W.CROSS, size, elements), (W.SUBTRACT,)],
    }.get(kind, [(W.PALETTE,)] if kind.startswith("palette") else [])
    data = W.encode(argb, transforms=use, cache_bits=6 if kind == "cache" else 0)
    back, size = W.decode(data)
    assert (back == argb).all() and size == len(data)


@pytest.mark.parametrize("mode", range(14))
def test_each_predictor(mode):
    argb = picture(12, 19, None, True)
    data = W.encode(argb, transforms=[(W.PREDICT, 2, np.full((3, 5), mode))])
    assert (W.decode(data)[0] == argb).all()


@pytest.mark.parametrize("cache_bits", [0, 4])
def test_copies_by_short_and_long_distances(cache_bits):
    line = picture(1, 4000, 40).ravel()
    copies, w = [], 100
    for at, n, code in ((300, 50, 1), (400, 3, 2), (500, 120, 35), (900, 700, 120 + 850), (2000, 1900, 120 + 1999)):
        d = W._distance(code, w)
        for i in range(n):
            line[at + i] = line[at + i - d]
        copies.append((at, n, code))
    argb = line.reshape(40, w)
    assert (W.decode(W.encode(argb, cache_bits=cache_bits, copies=copies))[0] == argb).all()


def test_fast_and_slow_readers_agree(monkeypatch):
    texts = [b"", b"a", b"abc" * 300, bytes(range(256)) * 9, RNG.integers(0, 256, 90_000).astype(np.uint8).tobytes(), b"\xff" * 5000, ("Ein längerer Text, é. " * 700).encode()]
    media = [W.store(W.padded(t)) for t in texts]
    for t, m in zip(texts, media, strict=True):
        assert W.restore(m).tobytes() == W.padded(t)
    monkeypatch.setattr(W, "_tokens", lambda *a: None)
    for t, m in zip(texts, media, strict=True):
        assert W.restore(m).tobytes() == W.padded(t)


def test_several_groups_of_codes():
    out = W.BitWriter()
    for value, bits in ((7, 14), (3, 14), (0, 1), (0, 3), (0, 1), (0, 1), (1, 1), (0, 3)):  # 8 x 4, no transform, no cache, groups by 4 x 4
        out.put(value, bits)
    W._put_image(out, W._joined(255, 0, np.array([0, 1]), 0), 2, main=False)
    for green in ((5, 9), (70, 80)):
        for code in (green, (0,), (0,), (255,), (0,)):
            lengths = np.zeros(280, np.int64)
            lengths[list(code)] = 1
            W._put_code(out, lengths)
    want = np.array([[5, 9, 9, 5, 70, 80, 80, 80]] * 4)
    body = out.put_all(np.tile([0, 1, 1, 0, 0, 1, 1, 1], 4), np.ones(32, np.int64))
    data = b"\x2f" + body
    chunk = b"VP8L" + len(data).to_bytes(4, "little") + data + b"\0" * (len(data) & 1)
    back, _ = W.decode(b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk)
    assert ((back >> 8 & 255) == want).all()


def test_large_texts_span_files(monkeypatch):
    monkeypatch.setattr(W, "MOST_ROWS", 3)
    data = RNG.integers(0, 99, 576 * 8).astype(np.uint8).tobytes()
    assert W.restore(W.store(data)).tobytes() == data


def test_facts(spark):
    rows = [(1, "Text é", 1, "x"), (2, None, None, None), (None, "", 1, "x"), (3, "long words here " * 40000, 1, None), (3, "Text é", 2, None), (4, "x" * 576, 1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes int, media string")
    got = W.media_facts(W.with_media(docs)).collect()
    media = {t or "": W.store(W.padded((t or "").encode())) for _, t, *_ in rows}
    want = []
    for i, t, *_ in rows:
        data = W.padded((t or "").encode())
        want.append((i, len((t or "").encode()), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), len(media[t or ""]), hashlib.sha256(media[t or ""]).hexdigest()))
    assert sorted(map(str, (tuple(r)[:7] for r in got))) == sorted(map(str, want))
    assert len({r.feature for r in got if r.payload_sha256 == got[0].payload_sha256}) == 1
    assert W.media_facts(W.with_media(docs.filter("false"))).collect() == []


def test_content_chooses_transforms_and_copies():
    text = ("Repeated passages lie far apart. " + "".join(RNG.choice(list("abcdefghijklmnopqrstuvwxyz .,"), 3000))) * 3
    plain, lines = W.padded(text.encode()), np.tile(RNG.integers(0, 256, 576), (40, 1)).astype(np.uint8)
    ramp = ((np.arange(576 * 30) // 3) % 256).astype(np.uint8)
    few = RNG.integers(0, 9, 576 * 20).astype(np.uint8)
    for data, kind in ((plain, None), (lines.tobytes(), W.PREDICT), (ramp.tobytes(), W.PREDICT), (few.tobytes(), W.PALETTE)):
        use = W.chosen(np.frombuffer(data, np.uint8).reshape(-1, 576))
        assert [t[0] for t in use] == ([] if kind is None else [kind])
        media = W.store(data)
        assert W.restore(media).tobytes() == data
        assert len(media) < 0.75 * len(data)
    copies = W.found_copies(np.frombuffer(plain, np.uint8))
    assert max(code for *_, code in copies) == len(text) // 3 + len(W.NEAR) and sum(n for _, n, _ in copies) > len(plain) // 2
    assert len(W.store(plain)) < len(W.encode(np.uint32(0xFF000000) | np.frombuffer(plain, np.uint8).reshape(-1, 576).astype(np.uint32) << np.uint32(8))) * 0.6


def test_stream_written_by_hand():
    """A 4 x 1 image bit by bit: cross-colour and subtract-green transforms, a colour cache and a copy, with simple codes."""
    bits: list[tuple[int, int]] = [(3, 14), (0, 14), (1, 1), (0, 3)]  # width and height less 1, alpha, version
    bits += [(1, 1), (W.SUBTRACT, 2)]
    bits += [(1, 1), (W.CROSS, 2), (0, 3)]  # blocks of 4 x 4: one element
    bits += [(0, 1)]  # its image has no cache
    for symbol in (0, 32, 0, 255):  # green, red, blue and alpha of the element: simple codes of one symbol of 8 bits; red_to_blue 32
        bits += [(1, 1), (0, 1), (1, 1), (symbol, 8)]
    bits += [(1, 1), (0, 1), (0, 1), (0, 1)]  # distance code: symbol 0
    bits += [(0, 1)]  # no more transforms
    bits += [(1, 1), (1, 4), (0, 1)]  # colour cache of 2 entries, no meta codes
    # green: a literal (7), a copy of length 1 (256 + 0) and both cache symbols (280, 281), of 2 bits each
    lengths = np.zeros(282, np.int64)
    lengths[[7, 256, 280, 281]] = 2
    out = W.BitWriter()
    for value, n in bits:
        out.put(value, n)
    W._put_code(out, lengths)
    for symbol in (10, 20, 200):
        for value, n in ((1, 1), (0, 1), (1, 1), (symbol, 8)):
            out.put(value, n)
    for value in (1, 0, 0, 1):  # distance: one symbol of 1 bit, symbol 1: the pixel to the left
        out.put(value, 1)
    pixel = 200 << 24 | 10 << 16 | 7 << 8 | 20
    slot = (pixel * 0x1E35A7BD & 0xFFFFFFFF) >> 31
    codes = W.canonical(lengths)
    tokens = [7, 256, 280 + slot, 256]
    data = b"\x2f" + out.put_all(np.array([codes[t] for t in tokens]), np.full(4, 2))
    chunk = b"VP8L" + len(data).to_bytes(4, "little") + data + b"\0" * (len(data) & 1)
    got, _ = W.decode(b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk)
    red, green = 10, 7
    blue = 20 + (32 * red >> 5)  # cross-colour first, as it was written last; then green is added
    assert got.tolist() == [[200 << 24 | (red + green) << 16 | green << 8 | (blue + green)] * 4]


def test_copies_of_short_distance_are_written_at_once(monkeypatch):
    line = np.zeros(5000, np.uint32)
    line[:7] = np.arange(1, 8)
    monkeypatch.setattr(np, "resize", None)  # it joins one part for each repetition
    for at, n, distance in ((7, 1, 1), (8, 3000, 1), (3008, 100, 3), (3108, 50, 50), (3158, 40, 700), (3198, 1800, 7)):
        want = line.tolist()
        for i in range(at, at + n):
            want[i] = want[i - distance]
        W._copy(line, at, n, distance)
        assert line.tolist() == want


def test_grey_and_coloured_pixels_among_copies():
    grey = np.uint32(0xFF000000) | RNG.integers(0, 256, 3000).astype(np.uint32) << np.uint32(8)
    coloured = grey.copy()
    coloured[100] ^= np.uint32(0x010203)
    one = np.full(3000, 0xFF000700, np.uint32)
    for line in (grey, coloured, one):
        line[1000:1900], line[2000:2500] = line[:900], line[1999]
        data = W.encode(line.reshape(30, 100), copies=[(1000, 900, 120 + 1000), (2000, 500, 2)])
        assert (W.decode(data)[0].ravel() == line).all()
