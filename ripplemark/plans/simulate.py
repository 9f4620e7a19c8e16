"""Signals with known truth, and measures of how well it is recovered."""

from __future__ import annotations

import itertools
import math

import numpy as np

from ripplemark.plans.kernels import STEP, Library, sampled


def ar1_noise(scans: int, rho: float, variance: float, rng: np.random.Generator, features: int = 1) -> np.ndarray:
    """Stationary AR(1) noise with a variance."""
    e = rng.normal(size=(scans, features)) * math.sqrt(variance)
    for i in range(1, scans):
        e[i] = rho * e[i - 1] + math.sqrt(1 - rho * rho) * e[i]
    return e


def phase_surrogate(values: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Noise with the spectrum of the values and random phases."""
    f = np.fft.rfft(values - values.mean())
    phase = np.exp(2j * np.pi * rng.random(len(f)))
    phase[0] = 1
    if len(values) % 2 == 0:
        phase[-1] = 1
    return np.fft.irfft(f * phase, len(values))


def synthesise(onsets, lengths, heights, times, parameters, step: float = 0.005) -> np.ndarray:
    """Direct convolution of boxes with a kernel on a fine grid, unit-peak responses times heights."""
    k = sampled(parameters, step)
    start = float(min(onsets))
    grid = np.zeros(int((max(times) - start) / step) + len(k) + 2)
    out = np.zeros(len(times))
    for o, length, h in zip(onsets, lengths, heights, strict=True):
        box = np.zeros_like(grid)
        a = int(round((o - start) / step))
        box[a : a + max(1, int(round(length / step)))] = 1
        full = np.convolve(box, k)[: len(grid)]
        out += h * np.interp(times, start + step * np.arange(len(grid)), full / full.max(), left=0.0)
    return out


def recovery(candidate, truth) -> dict[str, float]:
    """Correlation and peak time error of two kernels' curves."""
    a, b = sampled(candidate, STEP), sampled(truth, STEP)
    n = max(len(a), len(b))
    a, b = np.pad(a, (0, n - len(a))), np.pad(b, (0, n - len(b)))
    return {"r": float(np.corrcoef(a, b)[0, 1]), "peak_error": float((a.argmax() - b.argmax()) * STEP)}


def library_floor(truth, library: Library) -> float:
    """Best correlation that a library allows."""
    return max(recovery(p, truth)["r"] for p in library.parameters)


def half_splits(runs: list[int], seed: int, most: int) -> list[tuple[tuple[int, ...], tuple[int, ...]]]:
    """Distinct partitions of runs in two halves (sizes differ by one at most), in random order."""
    runs = sorted(runs)
    k = len(runs) // 2
    found = []
    for half in itertools.combinations(runs, k):
        if 2 * k == len(runs) and runs[0] not in half:
            continue
        found.append((half, tuple(r for r in runs if r not in half)))
    order = np.random.default_rng(seed).permutation(len(found))
    return [found[i] for i in order[:most]]
