import random
import zlib

import numpy as np
import pytest

from lumenframe.sources import png


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_round_trip(n):
    p = np.random.default_rng(n).integers(0, 256, (7, 5, n)).astype(np.uint8)
    got = png.decode(png.encode(p, [("Title", "a"), ("Title", "é")]))
    assert (got[..., :3] == (p[..., :1] if n < 3 else p[..., :3])).all()
    assert (got[..., 3] == (p[..., -1] if n in (2, 4) else 255)).all()
    assert png.texts(png.encode(p, [("Title", "a"), ("Title", "é")])) == [("Title", "a"), ("Title", "é")]


@pytest.mark.parametrize("kind", range(5))
def test_filters(kind):
    p = np.random.default_rng(0).integers(0, 256, (6, 12)).astype(int)
    rows = []
    for y in range(6):
        row = [kind]
        for i in range(12):
            a, b, c = (p[y, i - 3] if i >= 3 else 0), (p[y - 1, i] if y else 0), (p[y - 1, i - 3] if y and i >= 3 else 0)
            e = a + b - c
            paeth = min((a, b, c), key=lambda v: abs(e - v))
            row.append((p[y, i] - [0, a, b, (a + b) // 2, paeth][kind]) % 256)
        rows.append(bytes(row))
    assert (png._unfilter(b"".join(rows), 6, 12, 3) == p).all()


def test_hostile_bytes(spark):
    raw = png.encode(np.zeros((4, 4, 3), np.uint8))
    r = random.Random(1)
    bad = [raw[:k] for k in range(0, len(raw), 5)] + [bytes(b if r.random() > 0.05 else r.randrange(256) for b in raw) for _ in range(40)] + [None, b"", zlib.compress(b"x")]
    d = spark.createDataFrame([(i, b) for i, b in enumerate([raw, *bad])], "path long, content binary")
    got = png.decode_rows(d).orderBy("id").collect()
    assert len(got) == len(bad) + 1 and got[0].error is None and len(got[0].data) == 64
    assert all(g.error for g in got[-3:])
    assert png.probe(d).where("id = 0").first()[1:4] == (4, 4, 3)
    assert png.text_rows(d).where("id = 0").first().texts == []
    with pytest.raises(ValueError):
        png.encode(np.zeros((1, 1, 1), np.uint8), [(" key", "v")])
