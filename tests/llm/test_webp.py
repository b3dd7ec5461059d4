"""The lossless WebP codec: every part of the format, round trip and a known file."""

import base64

import numpy as np
import pytest

from quintet.llm import webp

SHAPES = [(1, 1), (3, 5), (17, 33), (40, 19)]
PLAIN = [{}, {"green": True}, {"cross": (200, 30, 77)}, {"cross": (200, 30, 77), "green": True}, {"cache_bits": 4}, {"copies": True}, {"cache_bits": 10, "copies": True}]
PREDICTED = [{"predictor": m, "tile": 2 + m % 3} for m in range(14)] + [{"predictor": 11, "cross": (5, 250, 128), "green": True, "cache_bits": 3, "copies": True}]
INDEXED = [{"palette": True}, {"palette": True, "copies": True, "predictor": 5}]


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("colours", [1, 2, 3, 7, 20, 200, None])
def test_round_trip(shape, colours):
    r = np.random.default_rng(0)
    pixels = r.integers(0, 2**32, shape, dtype=np.uint32)
    if colours:
        pixels = r.integers(0, 2**32, colours, dtype=np.uint32)[r.integers(0, colours, shape)]
    for how in PLAIN + PREDICTED + (INDEXED if colours else []):
        assert (webp.decode(webp.encode(pixels, **how)) == pixels).all(), how


def greys():
    r = np.random.default_rng(6)
    line = bytes(r.integers(32, 120, 90, dtype=np.uint8)) + b"\n"
    text = b"".join(line if i % 3 else bytes(r.integers(97, 123, int(r.integers(1, 200)), dtype=np.uint8)) + b"\n" for i in range(120))
    yield np.frombuffer(text + b" " * (-len(text) % 192), np.uint8).reshape(-1, 192)  # lines that come again
    yield np.full((5, 192), 32, np.uint8)
    yield np.zeros((1, 1), np.uint8)
    yield np.frombuffer((b"0101 " * 400)[: 192 * 10], np.uint8).reshape(10, 192)  # few values
    yield (np.arange(192 * 30) // 7 % 256).astype(np.uint8).reshape(30, 192)  # ramps: the left neighbour
    yield np.tile(r.integers(0, 256, 192, dtype=np.uint8), (40, 1))  # equal rows: the upper one
    yield r.integers(0, 256, (300, 192), dtype=np.uint8)
    yield np.frombuffer(b"a" * 5000 + bytes(r.integers(0, 256, 760, dtype=np.uint8)), np.uint8).reshape(-1, 192)  # a run beyond one copy
    for n in (1, 2, 3, 4, 5, 16, 17):
        yield r.integers(0, n, (9, 13), dtype=np.uint8) * 13


def test_grey_images_decode_alike_both_ways(monkeypatch):
    used = set()
    for grey in greys():
        raw = webp.encode_grey(grey)
        assert raw == webp.encode_grey(grey.copy())
        want = grey.astype(np.uint32) * np.uint32(0x010101) | np.uint32(webp.ALPHA)
        assert (webp.decode(raw) == want).all()
        with monkeypatch.context() as m:
            m.setattr(webp, "QUICK", False)
            m.setattr(webp, "walk", None)
            assert (webp.decode(raw) == want).all()
        bits = webp.Bits(raw[21:])
        bits.read(32)
        used.add((bits.read(2) if bits.read(1) else None, len(webp.repeats(grey.tobytes(), True)) > 0))
    assert {k for k, _ in used} == {webp.PALETTE, webp.PREDICTOR, webp.GREEN} and (webp.GREEN, True) in used
    lined = next(greys())
    assert len(webp.encode_grey(lined)) < 0.6 * len(webp.encode(lined.astype(np.uint32) * np.uint32(0x010101) | np.uint32(webp.ALPHA), green=True))


def test_copies_of_the_general_encoder_decode_quickly(monkeypatch):
    """Streams of encode(copies=True) in which only green varies take the vectorised way, too."""
    r = np.random.default_rng(2)
    for shape in ((1, 40), (30, 31), (200, 192)):
        pixels = np.uint32(webp.ALPHA) | r.integers(0, 3, shape).astype(np.uint32) << np.uint32(8)
        for how in ({"copies": True}, {"copies": True, "predictor": 1}, {"copies": True, "predictor": 2}, {"predictor": 1}, {"predictor": 2}):
            raw = webp.encode(pixels, **how)
            quick = webp.decode(raw)
            with monkeypatch.context() as m:
                m.setattr(webp, "QUICK", False)
                assert (webp.decode(raw) == pixels).all() and (quick == pixels).all()


def test_known_file():
    raw = base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")
    assert webp.decode(raw).shape == (1, 1)


def test_meta_prefix_codes():
    """Two groups of codes, chosen by tiles of an entropy image."""
    out = webp.Out()
    width = height = 8
    for value, n in ((width - 1, 14), (height - 1, 14), (0, 1), (0, 3), (0, 1), (0, 1), (1, 1), (0, 3)):
        out.put(value, n)
    groups = np.array([0, 1, 1, 0], np.uint32)
    webp.put_pixels(out, groups << np.uint32(8) | np.uint32(webp.ALPHA), 2, False)
    for green in (5, 200):
        for size, symbol in ((280, green), (256, 1), (256, 2), (256, 255), (40, 0)):
            webp.put_code(out, [int(s == symbol) for s in range(size)])
    data = b"\x2f" + out.done()
    data += b"\0" * (len(data) & 1)
    raw = b"RIFF" + (12 + len(data)).to_bytes(4, "little") + b"WEBPVP8L" + len(data).to_bytes(4, "little") + data
    got = webp.decode(raw) >> np.uint32(8) & np.uint32(255)
    assert got[0, 0] == 5 and got[0, 4] == 200 and got[4, 0] == 200 and got[7, 7] == 5


def test_distance_codes_are_ordered_by_distance():
    assert len(set(webp.NEAR)) == 120 and [x * x + y * y for x, y in webp.NEAR] == sorted(x * x + y * y for x, y in webp.NEAR)


def test_damaged_files_are_refused():
    good = webp.encode(np.arange(64, dtype=np.uint32).reshape(8, 8))
    with pytest.raises(ValueError, match="not a lossless"):
        webp.decode(b"x" + good[1:])
    with pytest.raises(ValueError):
        webp.decode(good[:16] + (10).to_bytes(4, "little") + good[20:30])


def test_code_lengths_are_limited():
    for counts in ([1] * 280, [2**k for k in range(40)], [1, 1], [5, 0, 0, 1]):
        lengths = [n for n in webp.lengths_for(counts, 12) if n]
        assert max(lengths) <= 12 and sum(2.0**-n for n in lengths) == 1
