"""Code streams of the GIF store: whole sections are decoded at once, to what a plain loop gives."""

import random

import numpy as np
import pytest

from fieldloom.llm import gif


def plain(codes, clear=256):
    """Samples of codes without clear and stop marks."""
    strings, out, last = [bytes([i]) for i in range(clear)] + [b"", b""], [], None
    for code in codes:
        s = strings[code] if code < len(strings) else last + last[:1]
        if last is not None and len(strings) < 4096:
            strings.append(last + s[:1])
        out.append(s)
        last = s
    return b"".join(out)


def packed(codes):
    """A stream that begins with a clear code and ends without a stop code."""
    bits, at = 256, 9
    for code, width in zip(codes, gif._widths(0, len(codes), 8)):
        bits, at = bits | code << at, at + int(width)
    return bits.to_bytes(-(-at // 8), "little")


def test_a_long_section_over_a_full_table_equals_a_plain_loop():
    rng = random.Random(5)
    codes = [97] + [rng.choice([97, 98, min(257 + k, 4095), rng.randrange(258, 258 + min(k, 3838)) if k > 1 else 97])
        for k in range(1, 9000)]
    whole = plain(codes)
    for limit in (1, 1000, len(whole), len(whole) + 9):
        assert gif.lzw_decode(packed(codes), 8, limit).tobytes() == whole[:limit]


def test_strings_of_earlier_and_of_the_same_codes_are_copied():
    """Codes that arrive in pieces give the samples of one piece; a code past the table is an error."""
    codes = np.array([97, 258, 259, 98, 260, 262, 259, 263])
    section = gif._Section(256)
    for piece in (codes[:1], codes[1:4], codes[4:]):
        section.add(piece, 10**6)
    assert section.samples.tobytes() == plain(codes.tolist())
    with pytest.raises(ValueError):
        section.add(np.array([268]), 10**6)


def test_codes_are_an_array_and_texts_come_back():
    for text in (b"a" * 64, b"ab" * 40_000, bytes(range(256)) * 256, np.random.default_rng(2).bytes(64 * 700)):
        codes = gif.lzw_codes(text)
        assert isinstance(codes, np.ndarray) and codes[0] == 256 and codes[-1] == 257
        assert gif.lzw_decode(gif.lzw_encode(text), 8, len(text)).tobytes() == text
        assert gif.read_back(gif.encode(text))[0] == text
