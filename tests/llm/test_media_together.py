"""Files that are coded and decoded many at a time, against one by one."""

import os
import random

import numpy as np
import pytest

from gridloom.llm import jpeg, media

from .test_media import progressive_file


def payloads_of_all_kinds():
    rng = random.Random(5)
    words = "It was the best of times, it was the worst; größer, 終わり。 0123 \n".split(" ")
    texts = ["", "a", "x" * 5000, "same " * 90, "same " * 90] + [" ".join(rng.choices(words, k=rng.randrange(1, 900))) for _ in range(120)]
    odd = [b"\xff" * 640, bytes(range(256)) * 3, os.urandom(64 * 100), b"ab\0c" * 800, (b"\0" * 64 + b"x" * 64 + b"\0" * 31 + b"y") * 64]
    odd += [bytes([k]) * 64 for k in range(0, 256, 51)] + [b"\0" * 64 * 300, b"\x7f\x80" * 32 * 7, b"\x7e\x80" * 32 * 40]
    return [media.padded(t)[1] for t in texts] + odd


def assert_same(frame, expected):
    assert (frame.height, frame.width, frame.comments) == (expected.height, expected.width, expected.comments)
    for a, b in zip(frame.components, expected.components, strict=True):
        assert np.array_equal(a.blocks, b.blocks)


@pytest.mark.parametrize("limit", [1, 50, 1 << 12])
def test_together_as_one_by_one(monkeypatch, limit):
    monkeypatch.setattr(jpeg, "TOGETHER_BLOCKS", limit)
    payloads = payloads_of_all_kinds()
    files = list(jpeg.encode_each(payloads))
    assert files == [jpeg.encode_payload(p) for p in payloads] == jpeg.encode_payloads(payloads)
    frames = list(jpeg.decode_each(files))
    assert [jpeg.payload_of(f) for f in frames] == payloads
    for frame, file in zip(frames, files):
        assert_same(frame, jpeg.decode(file))
    for frame, (same, rgb) in zip(frames, jpeg.with_tensors(frames), strict=True):
        assert same is frame and np.array_equal(rgb, frame.rgb())


def test_small_files_share_the_work(monkeypatch):
    """A step of coding or decoding is made once for hundreds of files, not once for each."""
    payloads = [media.padded(f"Text {k}, which has words of its own. " * (1 + k % 7))[1] for k in range(300)]
    calls = dict.fromkeys(("_symbols_of", "_packed", "_refined", "_words", "_samples"), 0)

    def counted(name, function):
        def call(*args):
            calls[name] += 1
            return function(*args)

        return call

    for name in calls:
        monkeypatch.setattr(jpeg, name, counted(name, getattr(jpeg, name)))
    files = list(jpeg.encode_each(payloads))
    frames = list(jpeg.decode_each(files))
    assert [jpeg.payload_of(f) for f, _ in jpeg.with_tensors(frames)] == payloads
    assert 0 < max(calls.values()) <= 40 and min(calls.values()) > 0, calls


def scans_with_restarts(file, units):
    """The file with a restart interval longer than its scans, which leaves all codes in their place."""
    at = file.index(b"\xff\xda")
    return file[:at] + b"\xff\xdd\0\4" + units.to_bytes(2, "big") + file[at:]


def test_foreign_files_among_stored_ones():
    rng = np.random.default_rng(3)
    stored = jpeg.encode_payload(b"A stored text. " * 64)
    files = [stored]
    for density in (0.0, 0.1, 0.5, 1.0):
        blocks = rng.integers(-40, 41, (12, 64)) * (rng.random((12, 64)) < density)
        files += [progressive_file(blocks, 4, 3), scans_with_restarts(progressive_file(blocks, 4, 3), 500), stored]
    cropped = bytearray(progressive_file(blocks, 4, 3))
    at = cropped.index(b"\xff\xc2")
    cropped[at + 5 : at + 9] = (21).to_bytes(2, "big") + (27).to_bytes(2, "big")
    files += [bytes(cropped), scans_with_restarts(stored, 500)]
    frames = list(jpeg.decode_each(files))
    for frame, file in zip(frames, files, strict=True):
        assert_same(frame, jpeg.decode(file))
    for frame, (_, rgb) in zip(frames, jpeg.with_tensors(frames), strict=True):
        assert np.array_equal(rgb, frame.rgb())
    assert frames[-2].rgb().shape == (21, 27, 3)


def test_a_damaged_file_among_others():
    """It is an error exactly if it is one by itself."""
    rng, raised = random.Random(11), 0
    good = jpeg.encode_payload(rng.randbytes(640))
    bad = [good[:k] + b"\xff\xd9" for k in range(len(good) // 3, len(good) - 2, 97)]
    for _ in range(100):
        file = bytearray(good)
        file[rng.randrange(200, len(file))] = rng.randrange(255)
        bad.append(bytes(file))
    for file in bad:
        try:
            alone = jpeg.decode(file)
        except (ValueError, EOFError):
            raised += 1
            with pytest.raises((ValueError, EOFError)):
                list(jpeg.decode_each([good, file, good]))
        else:
            assert_same(list(jpeg.decode_each([good, file, good]))[1], alone)
    assert raised > 5


def test_none_and_bad_payloads():
    assert list(jpeg.decode_each([])) == list(jpeg.encode_each([])) == list(jpeg.with_tensors([])) == []
    with pytest.raises(ValueError):
        list(jpeg.encode_each([b"\0" * 64, b"x"]))
