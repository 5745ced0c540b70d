"""Words of many texts at once, as 64-bit hashes, by numpy over their bytes."""

from __future__ import annotations

import numpy as np

_BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = 1 << 20

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_WORD[128:] = True
_VALUE = np.random.default_rng(12).integers(1, 1 << 63, 256, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    k = 1
    with np.errstate(over="ignore"):
        while k < n:
            m = min(k, n - k)
            out[k : k + m] = out[:m] * np.uint64(pow(base, k, 1 << 64))
            k += m
    return out


def finish(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def spans_hashed(raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One hash for each span of bytes, of a polynomial in them: spans of a step's length or longer are hashed one by one."""
    out, b = np.empty(len(start), np.uint64), np.frombuffer(raw, np.uint8)
    if not hasattr(spans_hashed, "up"):
        spans_hashed.up, spans_hashed.down = _powers(_BASE, _STEP), _powers(_INVERSE, _STEP)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(start):
            lo = int(start[i])
            j = max(i + 1, int(np.searchsorted(end, lo + _STEP - 1, "right")))
            hi = int(end[j - 1])
            if hi - lo >= _STEP:  # one span as long as a step
                h = 0
                for x in _VALUE[b[lo:hi]].tolist()[::-1]:
                    h = (h * _BASE + x) & 0xFFFFFFFFFFFFFFFF
                out[i] = h
            else:
                p = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUE[b[lo:hi]] * spans_hashed.up[: hi - lo], dtype=np.uint64)))
                out[i:j] = (p[end[i:j] - lo] - p[start[i:j] - lo]) * spans_hashed.down[start[i:j] - lo]
            i = j
    return finish(out ^ (end - start).astype(np.uint64))


class Hasher:
    """Hashes words of lower-cased texts. A word is a run of ASCII letters and digits and of
    characters beyond ASCII but for the spaces and marks of Latin-1 and general punctuation."""

    def __init__(self) -> None:
        self.up = _powers(_BASE, _STEP)
        self.down = _powers(_INVERSE, _STEP)

    def text(self, raw: bytes) -> np.ndarray:
        """Hashes of the words of one text, in order."""
        b = np.frombuffer(raw, np.uint8)
        word = _WORD[b]
        if len(b) > 1 and b.max() >= 0xC2:
            two = (b[:-1] == 0xC2) & (b[1:] < 0xC0) & (b[1:] != 0xAA) & (b[1:] != 0xB5) & (b[1:] != 0xBA)
            word[:-1][two] = False
            word[1:][two] = False
            if len(b) > 2:
                three = (b[:-2] == 0xE2) & ((b[1:-1] == 0x80) | (b[1:-1] == 0x81))
                for k in range(3):
                    word[k : len(b) - 2 + k][three] = False
        edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).astype(np.int8)))
        start, end = edge[::2], edge[1::2]
        if not len(start):
            return np.empty(0, np.uint64)
        out = np.empty(len(start), np.uint64)
        with np.errstate(over="ignore"):
            for lo in range(0, len(b), _STEP // 2):  # words that start in this half step
                i, j = np.searchsorted(start, [lo, lo + _STEP // 2])
                if i == j:
                    continue
                top = int(end[j - 1])
                if top - lo > _STEP:  # one word as long as a step: by Horner's rule on its own
                    if i < j - 1:
                        out[i : j - 1] = self._piece(b, lo, int(end[j - 2]), start[i : j - 1], end[i : j - 1])
                    h = 0
                    for x in _VALUE[b[start[j - 1] : top]].tolist()[::-1]:
                        h = (h * _BASE + x) & 0xFFFFFFFFFFFFFFFF
                    out[j - 1] = h
                else:
                    out[i:j] = self._piece(b, lo, top, start[i:j], end[i:j])
        return finish(out ^ (end - start).astype(np.uint64))

    def _piece(self, b: np.ndarray, lo: int, hi: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        p = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUE[b[lo:hi]] * self.up[: hi - lo], dtype=np.uint64)))
        return (p[end - lo] - p[start - lo]) * self.down[start - lo]

    def many(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of all texts, and where each text's words begin (one more at the end).

        Short texts are joined, since a call costs more than they do."""
        hashes: list = [None] * len(texts)
        group: list[int] = []
        raws: list[bytes] = []
        held = 0

        def flush() -> None:
            nonlocal group, raws, held
            if not group:
                return
            # A byte that no text can hold marks a border; its hash is found at once.
            joined = b" \xff ".join(raws)
            h = self.text(joined)
            cut = np.flatnonzero(h == self._border)
            for i, part in zip(group, np.split(h, cut)):
                hashes[i] = part[1:] if i != group[0] else part
            group, raws, held = [], [], 0

        for i, text in enumerate(texts):
            raw = (text or "").lower().encode("utf-8", "surrogatepass")
            if len(raw) > _STEP // 4:
                hashes[i] = self.text(raw)
                continue
            group.append(i)
            raws.append(raw)
            held += len(raw) + 3
            if held > _STEP // 3:
                flush()
        flush()
        at = np.concatenate(([0], np.cumsum([len(h) for h in hashes]))).astype(np.int64)
        return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), at

    @property
    def _border(self) -> np.uint64:
        if not hasattr(self, "_b"):
            self._b = self.text(b"\xff")[0]
        return self._b
