"""Queries that take whole texts, against brute force on small tables."""

import math
import random

import numpy as np
import pytest

from lectern.operators import audio
from lectern.plans import queries


@pytest.fixture(scope="module")
def turns(spark, tmp_path_factory):
    """(folder, [(conv_id, turn, text)]): turns of none to 150 words, some with loops far from the start."""
    rng = random.Random(3)
    rows = [(0, 0, ""), (0, 1, "one two"), (0, 2, " ".join(f"word{chr(97 + i % 26)}" for i in range(70)) + " so it goes" * 6 + " and ends")]
    rows += [(c, t, " ".join(rng.choice(["alpha", "beta", "gamma.", "delta,", "it's", "Pi!"]) for _ in range(rng.choice([1, 5, 70, 150])))) for c in range(1, 5) for t in range(6)]
    where = str(tmp_path_factory.mktemp("turns"))
    spark.createDataFrame(rows, "conv_id long, turn long, text string").coalesce(2).write.parquet(f"{where}/conversations.parquet")
    return where, rows


def tokens(text):
    return [w for w in text.lower().replace(".", " ").replace(",", " ").replace("!", " ").split() if w]


def edits(a, b):
    """(substitutions, deletions, insertions) by the full table."""
    row = [(k, 0, k, 0) for k in range(len(a) + 1)]
    for y in b:
        new = [(row[0][0] + 1, row[0][1], row[0][2], row[0][3] + 1)]
        for k, x in enumerate(a, 1):
            diag, left, up = row[k - 1], new[k - 1], row[k]
            c, by = min((diag[0], 0), (left[0], 1), (up[0], 2))
            s, d, i = (diag, left, up)[by][1:]
            new.append(diag if x == y else (c + 1, s + (by == 0), d + (by == 1), i + (by == 2)))
        row = new
    return row[-1][1:]


def test_word_errors_of_whole_turns(spark, turns):
    where, rows = turns
    got = {(r.conv_id, r.turn): (r.substitutions, r.deletions, r.insertions, r.reference_length) for r in queries.QUERIES["v03_word_errors"](spark, where).collect()}
    want = {}
    for c, t, text in rows:
        ref = tokens(text)
        bad = [i for i in range(len(ref)) if (i + t) % 7 == 3]
        want[c, t] = (*edits(ref, ["zzz" if i in bad else w for i, w in enumerate(ref) if t % 2 or i not in bad]), len(ref))
    assert got == want and max(v[3] for v in want.values()) == 150


def test_repetition_of_whole_turns(spark, turns):
    where, rows = turns
    got = {(r.conv_id, r.turn): r.repetition for r in queries.QUERIES["v06_repetition"](spark, where).collect()}
    want = {}
    for c, t, text in rows:
        w = tokens(text)
        w += w[-3:] * ((c + t) % 6)
        worst = 0
        for i in range(len(w) - 2):
            n = 1
            while w[i + 3 * n : i + 3 * n + 3] == w[i : i + 3]:
                n += 1
            worst = max(worst, n)
        want[c, t] = round((worst - 2) / 3, 9) if len(w) >= 9 and worst >= 3 else 0.0
    assert got == want and got[0, 2] > 0


def by_definition(x):
    """The denoiser's output, each sample from its definition."""
    (b0, b1, b2), (_, a1, a2) = audio._coefficients()
    y = []
    for i in range(len(x)):
        at = lambda v, k: v[i - k] if i >= k else 0.0  # noqa: B023, E731
        y.append(b0 * x[i] + b1 * at(x, 1) + b2 * at(x, 2) - a1 * at(y, 1) - a2 * at(y, 2))
    y = [max(-1.0, min(1.0, v)) for v in y]
    mean = lambda v: [sum(v[max(0, i - 264) : i + 265]) / 529 for i in range(len(v))]
    envelope = mean([abs(v) for v in y])
    low = sorted(envelope)
    place = 0.1 * (len(low) - 1)
    floor = low[int(place)] + (low[min(int(place) + 1, len(low) - 1)] - low[int(place)]) * (place % 1)
    gate = max(3 * floor, max(map(abs, y)) * 1e-4)
    gain = mean([0.06 + 0.94 * min(1.0, e / gate) ** 2 for e in envelope])
    return [max(-1.0, min(1.0, v * g)) for v, g in zip(y, gain, strict=True)]


def test_every_vector_is_denoised(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(64)]) for i in range(23)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(2).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r for r in queries.QUERIES["d02_denoise"](spark, str(tmp_path)).collect()}
    assert set(got) == set(range(23))
    for i, x in rows:
        want = by_definition([float(v) for v in np.array(x, np.float32)] * 20)
        assert got[i].n == 1280 and got[i].peak == pytest.approx(max(want)) and got[i].energy == pytest.approx(sum(v * v for v in want))


def test_denoise_hiss_and_speech():
    """Hiss goes down by more than 0.6, speech stays above 0.8; silence and NaN give finite samples."""
    rng = np.random.default_rng(0)
    n = audio.RATE // 2
    x = np.concatenate([rng.normal(0, 0.01, n), 0.5 * np.sin(2 * np.pi * 220 * np.arange(n) / audio.RATE)])
    y = audio.denoised(x)
    level = lambda v: float(np.sqrt(np.mean(v**2)))
    assert len(y) == len(x) and np.isfinite(y).all() and np.abs(y).max() <= 1
    assert level(y[:n]) < 0.6 * level(x[:n]) and level(y[n:]) > 0.8 * level(x[n:])
    assert not audio.denoised(np.zeros(2000)).any() and not len(audio.denoised([]))


def test_resampling():
    t = np.arange(44_100) / 44_100
    tone = np.sin(2 * np.pi * 440 * t)
    y = audio.resampled(tone, 44_100, 16_000)
    assert len(y) == 16_000
    assert np.abs(y - np.sin(2 * np.pi * 440 * np.arange(16_000) / 16_000))[200:-200].max() < 0.01
    assert np.abs(audio.resampled(np.sin(2 * np.pi * 12_000 * t), 44_100, 16_000))[200:-200].max() < 0.05
    assert audio.resampled(tone, 16_000, 16_000) is tone and len(audio.resampled(tone[:1], 8_000, 16_000)) == 2
    # by the sum itself
    x = np.random.default_rng(1).normal(size=50)
    base = 160 * 0.99
    width = math.ceil(6 * 441 / base)
    for i, got in enumerate(audio.resampled(x, 44_100, 16_000)):
        first = 441 * (i // 160)
        want = 0.0
        for j in range(first - width, first + width + 441):
            u = max(-6.0, min(6.0, ((j - first) / 441 - (i % 160) / 160) * base))
            want += (x[j] if 0 <= j < 50 else 0.0) * np.sinc(u) * math.cos(u * math.pi / 12) ** 2 * base / 441
        assert got == pytest.approx(want)
