import hashlib
import os
import random
import struct

import numpy as np
import pytest

from gridloom.llm import jpeg, media


@pytest.mark.parametrize("n", [1, 2, 5, 6, 7, 24, 25, 100, 700])
def test_round_trip(n):
    payload = os.urandom(64 * n)
    assert jpeg.payload_of(jpeg.decode(jpeg.encode_payload(payload))) == payload


def test_round_trip_of_extremes():
    for payload in (b"\0" * 64, b"\xff" * 640, bytes(range(256)) * 3):
        assert jpeg.payload_of(jpeg.decode(jpeg.encode_payload(payload))) == payload
    for bad in (b"", b"x" * 63):
        with pytest.raises(ValueError):
            jpeg.encode_payload(bad)


@pytest.mark.parametrize("payload", [os.urandom(64 * 31), b"ab\0c" * 16 * 50, (b"\0" * 64 + b"x" * 64 + b"\0" * 31 + b"y") * 64, b"\0" * 64 * 400, b"The text. " * 64 + b"\0" * 64])
def test_both_ways_of_decoding_agree(monkeypatch, payload):
    data = jpeg.encode_payload(payload)
    assert jpeg.payload_of(jpeg.decode(data)) == payload
    quick = jpeg.decode(data)
    monkeypatch.setattr(jpeg.Scan, "_decode_at_once", lambda *a: False)
    slow = jpeg.decode(data)
    for a, b in zip(quick.components, slow.components):
        assert np.array_equal(a.blocks, b.blocks)


class Writer:
    """A plain progressive encoder with a complete Huffman table, for files that have runs of all kinds."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in range(n - 1, -1, -1)]

    def symbol(self, s):
        self.put(s, 9)  # all 256 symbols have codes of 9 bits, in order

    def number(self, v):
        size = abs(v).bit_length()
        self.put(v if v >= 0 else v + (1 << size) - 1, size)

    def bytes(self):
        bits = self.bits + [1] * (-len(self.bits) % 8)
        return np.packbits(np.array(bits, np.uint8)).tobytes().replace(b"\xff", b"\xff\0")


def shifted(v, low):
    return int(abs(v) >> low) * (1 if v >= 0 else -1)


def ac_first(blocks, first, last, low):
    w, run = Writer(), 0

    def ends():
        nonlocal run
        if run:
            n = run.bit_length() - 1
            w.symbol(n << 4)
            w.put(run - (1 << n), n)
            run = 0

    for block in blocks:
        zeros = 0
        for k in range(first, last + 1):
            v = shifted(block[k], low)
            if not v:
                zeros += 1
                continue
            ends()
            while zeros > 15:
                w.symbol(0xF0)
                zeros -= 16
            w.symbol(zeros << 4 | abs(v).bit_length())
            w.number(v)
            zeros = 0
        if zeros:
            run += 1
    ends()
    return w.bytes()


def ac_refine(blocks, first, last, low):
    w = Writer()
    for block in blocks:
        zeros, held = 0, []
        new_at = [k for k in range(first, last + 1) if abs(shifted(block[k], low)) == 1]
        final = new_at[-1] if new_at else -1
        for k in range(first, final + 1):
            v = abs(shifted(block[k], low))
            if v > 1:
                held.append(v & 1)
            elif v == 1:
                w.symbol(zeros << 4 | 1)
                w.put(block[k] > 0, 1)
                for b in held:
                    w.put(b, 1)
                zeros, held = 0, []
            else:
                if zeros == 15:
                    w.symbol(0xF0)
                    for b in held:
                        w.put(b, 1)
                    zeros, held = 0, []
                    continue
                zeros += 1
        rest = [abs(shifted(block[k], low)) & 1 for k in range(max(final + 1, first), last + 1) if abs(shifted(block[k], low)) > 1]
        if final < last:
            w.symbol(0)
            for b in rest:
                w.put(b, 1)
    return w.bytes()


def progressive_file(blocks, across, down):
    """A grey file of the given coefficients (zigzag) in five scans."""
    seg = lambda m, b: struct.pack(">BBH", 0xFF, m, len(b) + 2) + b
    out = [b"\xff\xd8", seg(0xDB, b"\0" + bytes(range(1, 65)))]
    out.append(seg(0xC2, struct.pack(">BHHB", 8, 8 * down, 8 * across, 1) + b"\1\x11\0"))
    counts = bytes([0] * 8 + [256 - 1] + [0] * 7)  # 255 codes of 9 bits; symbol 255 is never used
    for kind in (0, 1):
        out.append(seg(0xC4, bytes([kind << 4]) + counts + bytes(range(255))))
    scan = lambda ss, se, ah, al, data: seg(0xDA, bytes([1, 1, 0, ss, se, ah << 4 | al])) + data
    w, before = Writer(), 0
    for block in blocks:
        v = int(block[0]) >> 1
        w.symbol(abs(v - before).bit_length())
        w.number(v - before)
        before = v
    out.append(scan(0, 0, 0, 1, w.bytes()))
    out.append(scan(1, 20, 0, 1, ac_first(blocks, 1, 20, 1)))
    out.append(scan(21, 63, 0, 1, ac_first(blocks, 21, 63, 1)))
    w = Writer()
    for block in blocks:
        w.put(int(block[0]) & 1, 1)
    out.append(scan(0, 0, 1, 0, w.bytes()))
    out.append(scan(1, 63, 1, 0, ac_refine(blocks, 1, 63, 0)))
    return b"".join(out) + b"\xff\xd9"


@pytest.mark.parametrize("density", [0.0, 0.05, 0.4, 1.0])
def test_any_progressive_file(density):
    rng = np.random.default_rng(int(density * 100))
    blocks = rng.integers(-40, 41, (12, 64)) * (rng.random((12, 64)) < density)
    frame = jpeg.decode(progressive_file(blocks, 4, 3))
    assert np.array_equal(frame.components[0].blocks, blocks)
    # the inverse transform against its definition
    natural = np.zeros((12, 64))
    natural[:, jpeg.ZIGZAG] = blocks * np.arange(1, 65)
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    c = np.where(k == 0, np.sqrt(0.5), 1.0) / 2 * np.cos((2 * x + 1) * k * np.pi / 16)
    expected = np.clip(np.einsum("nuv,ux,vy->nxy", natural.reshape(-1, 8, 8), c, c) + 128, 0, 255)
    got = frame.planes()[0].reshape(3, 8, 4, 8).swapaxes(1, 2).reshape(12, 8, 8)
    assert np.abs(got - expected).max() <= 0.51 and frame.rgb().shape == (24, 32, 3)


def test_colour_and_sampling():
    frame = jpeg.decode(jpeg.encode_payload(bytes(64)))
    for c, level in zip(frame.components, (400, 80, -160)):
        c.blocks[:] = 0
        c.blocks[:, 0] = level  # samples of 128 + level / 8
    rgb = frame.rgb()
    y, cb, cr = 178, 138, 108
    expected = [y + 1.402 * (cr - 128), y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), y + 1.772 * (cb - 128)]
    assert rgb.shape == (16, 16, 3) and np.abs(rgb.reshape(-1, 3) - expected).max() <= 1


def test_long_scans_go_through_several_chunks():
    payload = os.urandom(64 * 7000) + b"\0" * 64 * 40_000 + b"z" * 64 * 3000
    frame = jpeg.decode(jpeg.encode_payload(payload))
    assert jpeg.payload_of(frame) == payload


def test_bands_and_features(monkeypatch):
    frame = jpeg.decode(jpeg.encode_payload(os.urandom(64 * 333)))
    whole, told = frame.rgb(), jpeg.features(frame.rgb())
    monkeypatch.setattr(jpeg, "BAND_BLOCKS", 7)
    assert np.array_equal(frame.rgb(), whole) and np.allclose(jpeg.features(whole), told)
    x = whole.reshape(-1, 3).astype(float)
    green = whole[:, :, 1].astype(int)
    expected = [*np.column_stack([x.mean(axis=0), x.std(axis=0)]).ravel(), np.abs(np.diff(green, axis=1)).sum() / len(x), np.abs(np.diff(green, axis=0)).sum() / len(x)]
    assert np.allclose(told, expected)


def test_damaged_files():
    data = jpeg.encode_payload(os.urandom(640))
    for bad in (b"", b"nothing", data[:-2], data[:200]):
        with pytest.raises((ValueError, EOFError)):
            jpeg.decode(bad)


def test_columns(docs_of):
    texts = [None, "", "a", "ä" * 31 + "xx", "é" * 1000, "x" * 200_000, "same", "same"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (3, "again")]
    random.Random(1).shuffle(rows)
    got = media.decode_media(media.store_texts(docs_of(rows))).collect()
    assert len(got) == len(rows)
    for (doc_id, text), r in zip(rows, got):
        n, payload = media.padded(text)
        assert (r["doc_id"], r["n_bytes"], bytes(r["payload"])) == (doc_id, n, payload)
        assert len(payload) % 64 == 0 and len(payload) >= 64 and len(r["rgb"]) == 3 * r["height"] * r["width"]
    same = [hashlib.sha256(r["media"] + r["rgb"]).hexdigest() for (_, t), r in zip(rows, got) if t == "same"]
    assert same[0] == same[1]
    assert media.decode_media(media.store_texts(docs_of([]))).count() == 0
    assert media.store_texts(docs_of([(1, "t", b"m")], "doc_id long, text string, media binary")).columns == ["doc_id", "n_bytes", "media"]


def test_store_codes_by_the_payloads_own_symbols(monkeypatch):
    """Codes of several lengths, other ones for other texts, and coefficients that only a refinement makes known; all of it read at once."""
    texts = [b"It was the best of times, it was the worst of times. " * 12, "Größe und Übermaß, 終わり。".encode() * 20]
    payloads = [t.ljust(-(-len(t) // 64) * 64, b"\0") for t in texts]
    tables, added = set(), 0
    monkeypatch.setattr(jpeg.Scan, "_decode_units", lambda *a: pytest.fail("not read at once"))
    refine = jpeg.Scan._refined_at_once

    def watched(self, data, ix):
        nonlocal added
        before = np.count_nonzero(self.parts[0][0].blocks)
        done = refine(self, data, ix)
        tables.add((self.parts[0][2].counts, self.parts[0][2].symbols))
        added += np.count_nonzero(self.parts[0][0].blocks) - before
        return done

    monkeypatch.setattr(jpeg.Scan, "_refined_at_once", watched)
    for payload in payloads:
        assert jpeg.payload_of(jpeg.decode(jpeg.encode_payload(payload))) == payload
    near = 0
    for payload in payloads:
        data = np.frombuffer(payload, np.uint8).astype(int)
        near += np.count_nonzero(np.abs(data.reshape(-1, 64)[:, 1:] - np.sort(data)[(len(data) - 1) // 2]) == 1)
    assert len(tables) == 2 and added == near > 0
    assert all(sum(n > 0 for n in counts) > 1 for counts, _ in tables)


def test_features_against_an_independent_transform():
    """The tensor of a stored text, recomputed by the definition of the transform, repetition of chroma and the colour equations."""
    payload = (b"A text that is stored and read back, in colour. " * 40)[: 64 * 24]
    frame = jpeg.decode(jpeg.encode_payload(payload))
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    c = np.where(k == 0, np.sqrt(0.5), 1.0) / 2 * np.cos((2 * x + 1) * k * np.pi / 16)
    planes = []
    for part in frame.components:
        natural = np.zeros(part.blocks.shape)
        natural[:, jpeg.ZIGZAG] = part.blocks
        samples = np.einsum("nuv,ux,vy->nxy", natural.reshape(-1, 8, 8), c, c) + 128
        planes.append(np.clip(np.rint(samples), 0, 255).reshape(part.high, part.wide, 8, 8).swapaxes(1, 2).reshape(part.high * 8, part.wide * 8))
    y, cb, cr = planes[0], *(p.repeat(2, axis=0).repeat(2, axis=1) - 128 for p in planes[1:])
    rgb = np.clip(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2), 0, 255)
    got = frame.rgb()
    assert np.abs(rgb[: got.shape[0], : got.shape[1]] - got).max() <= 2
    means = rgb[: got.shape[0], : got.shape[1]].mean(axis=(0, 1))
    assert np.allclose([jpeg.features(got)[i] for i in (0, 2, 4)], means, atol=0.6)
