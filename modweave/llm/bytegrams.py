"""4-byte grams of texts, with three line ends before each text as its first context."""

from __future__ import annotations

import numpy as np

ORDER = 3
PAD = b"\n" * ORDER


def codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The gram of every byte (first byte highest), text after text, and the bytes of each text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(PAD + PAD.join(texts), np.uint8).astype(np.uint32)
    out = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    ok = np.ones(len(out), bool)
    ends = np.cumsum(sizes + ORDER)[:-1]
    for k in range(1, ORDER + 1):
        ok[ends - k] = False  # grams that end in the next text's padding
    return out[ok], sizes
