"""Windows and colours against plain loops over pixels."""

import math

import numpy as np
import pytest

from keepsake.operators import pixels


def pictures(spark, sizes, seed=1):
    rng = np.random.default_rng(seed)
    arrays = [rng.integers(0, 256, (h, w, 3), dtype=np.uint8) for w, h in sizes]
    arrays[0][:] = 90  # nothing to see
    rows = [(k, a.shape[1], a.shape[0], a.tobytes()) for k, a in enumerate(arrays)] + [(900, 2, 2, None), (901, 2, 2, b"abc"), (902, 0, 0, b"")]
    return arrays, spark.createDataFrame([(i, w, h, None if p is None else bytearray(p), "x") for i, w, h, p in rows], "id long, width int, height int, pixels binary, x string").repartition(3)


def plain_window(a, width, height):
    h, w = a.shape[:2]
    light = lambda p: 0.299 * p[0] + 0.587 * p[1] + 0.114 * p[2]
    grid = [[abs(light(a[y][x]) - light(a[y][min(x + 1, w - 1)])) + abs(light(a[y][x]) - light(a[min(y + 1, h - 1)][x])) + 0.35 * float(int(max(a[y][x])) - int(min(a[y][x]))) for x in range(w)] for y in range(h)]
    total, ratio = sum(map(sum, grid)), width / height
    if abs(w / h - ratio) < 1e-6:
        return 0, 0, w, h
    cut = (math.floor(h * ratio + 0.5), h) if w / h > ratio else (w, math.floor(w / ratio + 0.5))
    if not (0 < cut[0] < w or 0 < cut[1] < h) or 0 in cut:
        return 0, 0, w, h
    most = max(w - cut[0], h - cut[1])
    best = None
    for at in dict.fromkeys([*range(0, most + 1, max(1, most // 64)), most // 2, most]):
        x, y = (at, 0) if w / h > ratio else (0, at)
        inside = sum(grid[v][u] for v in range(y, y + cut[1]) for u in range(x, x + cut[0]))
        score = (inside / total if total > 0 else 0) - abs((x + cut[0] / 2) / w - 0.5) * 0.18 - abs((y + cut[1] / 2) / h - (0.5 if w / h > ratio else 0.42)) * 0.28
        if best is None or score > best[0] + 1e-12:
            best = (score, x, y)
    return best[1], best[2], *cut


@pytest.mark.parametrize(("width", "height"), [(480, 800), (3, 2), (1, 1)])
def test_windows(spark, width, height):
    arrays, df = pictures(spark, [(20, 10), (20, 10), (9, 14), (9, 14), (7, 7), (1, 1), (130, 3), (3, 140)])
    got = {r.id: tuple(r)[1:] for r in pixels.crop_windows(df, width, height).collect()}
    assert got == {k: plain_window(a, width, height) for k, a in enumerate(arrays)}


def plain_places(a, shares, serpentine, boost):
    """Error diffusion pixel by pixel and colour by colour."""
    palette = pixels.SIX_COLOURS
    lab = {k: pixels.to_lab(np.array(c)) for k, c in enumerate(palette) if c}
    h, w = a.shape[:2]
    left = [[[float(v) for v in pixels.boosted(a[y, x], boost)] for x in range(w)] for y in range(h)]
    out = bytearray(w * h)
    for y in range(h):
        ahead = -1 if serpentine and y % 2 else 1
        for x in range(w)[::ahead]:
            mine = pixels.to_lab(np.array([int(v) for v in left[y][x]]))
            k = min(lab, key=lambda k: (sum((mine - lab[k]) ** 2), k))
            out[y * w + x] = k
            error = [v - c for v, c in zip(left[y][x], palette[k], strict=True)]
            for (dx, dy), share in shares.items():
                u, v = x + ahead * dx, y + dy
                if 0 <= u < w and v < h:
                    left[v][u] = [min(255.0, max(0.0, p + e * share)) for p, e in zip(left[v][u], error, strict=True)]
    return bytes(out)


@pytest.mark.parametrize(("mode", "shares", "serpentine", "boost"), [("atkinson", pixels.ATKINSON, False, 1.8), ("floyd_steinberg", pixels.FLOYD_STEINBERG, True, 1.4), ("direct", {}, False, 1.0)])
def test_diffusion(spark, mode, shares, serpentine, boost):
    arrays, df = pictures(spark, [(6, 5), (6, 5), (5, 4), (1, 3), (7, 1)], seed=3)
    got = {r.id: r for r in pixels.quantised(df, mode).collect()}
    assert got.keys() == set(range(5))
    for k, a in enumerate(arrays):
        if mode != "direct":
            assert bytes(got[k].places) == plain_places(a, shares, serpentine, boost)
        assert (got[k].width, got[k].height) == (a.shape[1], a.shape[0]) and 4 not in got[k].places
        whole = bytes(got[k].places) + b"\0" * (len(got[k].places) % 2)
        assert bytes(got[k].packed) == bytes(p << 4 | q for p, q in zip(whole[::2], whole[1::2], strict=True))


def test_colours_of_the_palette_stay(spark):
    a = np.array([[c for c in pixels.SIX_COLOURS if c]], dtype=np.uint8)
    assert pixels.in_colours(a[None], pixels.Palette(pixels.SIX_COLOURS), "direct").tolist() == [[[0, 1, 2, 3, 5, 6]]]
    grey = np.full((1, 8, 8, 3), 128, dtype=np.uint8)
    for mode in ("ordered", "blue_noise", "atkinson", "floyd_steinberg"):
        assert set(np.unique(pixels.in_colours(grey, pixels.Palette(((0, 0, 0), (255, 255, 255))), mode))) <= {0, 1}
    with pytest.raises(ValueError):
        pixels.in_colours(grey, pixels.Palette(pixels.SIX_COLOURS), "other")
    assert pixels.quantised(spark.createDataFrame([], "id long, width int, height int, pixels binary")).count() == 0


def test_published_colour_differences():
    pairs = [((50, 2.6772, -79.7751), (50, 0, -82.7485), 2.0425), ((50, 3.1571, -77.2803), (50, 0, -82.7485), 2.8615), ((50, -1.3802, -84.2814), (50, 0, -82.7485), 1.0), ((50, 2.5, 0), (73, 25, -18), 27.1492), ((50, 2.5, 0), (61, -5, 29), 22.8977), ((50, 2.5, 0), (56, -27, -3), 31.9030), ((50, 2.5, 0), (58, 24, 15), 19.4535)]
    a, b, want = (np.array(x, dtype=float) for x in zip(*pairs, strict=True))
    assert np.allclose(pixels.colour_difference(a, b), want, atol=1e-4) and np.allclose(pixels.colour_difference(b, a), want, atol=1e-4)


def test_thresholds_are_spread():
    t = pixels.spread_thresholds()
    assert np.bincount(t.ravel(), minlength=256).max() <= 5 and t[0, 0] == 0
    assert np.abs(np.diff(t.astype(int), axis=1)).mean() > 70
