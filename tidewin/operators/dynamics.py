"""Noise, resampling and oscillator studies over signals: each row's grid is computed where the row is."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.identity import seed_for
from .features import per_batch

TRIAL = "model string, drive string, noise_intensity double, substeps int, trial int, seed string, snr_db double, events int, intervals int, cv double, coherence double, valid boolean, reason string, clipped_fraction double"


def _arrays(contexts: list[list[float] | None]) -> list[np.ndarray | None]:
    return [None if x is None else np.array(x, float) for x in contexts]


def oscillator_trials(rows: DataFrame, keep: list[str], samples: str, identity: str, sfreq: float, levels: tuple[float, ...], trials: int, substeps: tuple[int, ...] = (1,), seed: int = 42) -> DataFrame:
    """Trials of both oscillators, with and without the signal's characteristic component as drive, at each noise
    level. One trial uses the same innovations for all levels and drives, so levels compare within a trial."""

    def study(contexts: list[list[float]], names: list[str]) -> Iterator[tuple[int, dict]]:
        drives, frequency = K.characteristic_components(np.array(contexts, float), sfreq)
        for model, steps in product(("bistable", "fitzhugh"), substeps):
            seeds = [[seed_for(seed, n, model, t, steps) for t in range(trials)] for n in names]
            noise = np.array([[K.innovations(s, (drives.shape[1] - 1) * steps) for s in mine] for mine in seeds])
            for (label, u), level in product((("component", drives), ("none", 0 * drives)), levels):
                paths, clipped = (K.bistable if model == "bistable" else K.fitzhugh)(u[:, None, :], sfreq, noise, level, substeps=steps)
                flat = paths.reshape(-1, paths.shape[-1])
                if model == "bistable":
                    measures = K.regularities([K.transitions(p, sfreq) for p in flat], sfreq)
                else:
                    measures = K.regularities([K.peak_events(p, sfreq) for p in flat], sfreq, least=3, ddof=0, shortest=0.2)
                snr = K.target_ratios(flat, sfreq, np.repeat(frequency, trials)).tolist()
                for k, (i, t) in enumerate(product(range(len(names)), range(trials))):
                    yield i, {"model": model, "drive": label, "noise_intensity": level, "substeps": steps, "trial": t, "seed": str(seeds[i][t]), "snr_db": snr[k], "clipped_fraction": float(clipped[i, t]), **measures[k]}

    return per_batch(rows, keep, [samples, identity], study, TRIAL)


def perturbation(rows: DataFrame, keep: list[str], samples: str, identity: str, sfreq: float, conditions: tuple[str, ...] = K.CONDITIONS, trials: int = 1, seed: int = 42) -> DataFrame:
    """Each signal under each condition, with what it keeps of the original: rmse, rmse over deviation, correlation."""

    def study(contexts: list[list[float]], names: list[str]) -> Iterator[tuple[int, dict]]:
        for i, condition, t, signal, changed in _changed(contexts, names, sfreq, conditions, trials, seed):
            yield i, {"condition": condition, "trial": t, **K.preservation(signal, changed)}

    return per_batch(rows, keep, [samples, identity], study, "condition string, trial int, rmse double, normalized_rmse double, correlation double")


def _changed(contexts: list[list[float]], names: list[str], sfreq: float, conditions: tuple[str, ...], trials: int, seed: int, **how) -> Iterator[tuple[int, str, int, np.ndarray, np.ndarray]]:
    """(row, condition, trial, signal, changed signal) of each signal under each condition, signals of a length at once."""
    by_size: dict[int, list[int]] = {}
    for i, x in enumerate(contexts):
        by_size.setdefault(len(x), []).append(i)
    for at in by_size.values():
        signals = np.array([contexts[i] for i in at], float)
        for condition in conditions:
            for t in range(trials if condition.startswith(("noise_", "sr_")) else 1):
                rngs = [np.random.default_rng(seed_for(seed, names[i], t)) for i in at]
                for i, signal, changed in zip(at, signals, K.all_perturbed(signals, sfreq, condition, rngs, **how), strict=True):
                    yield i, condition, t, signal, changed


def perturbed_signals(rows: DataFrame, keep: list[str], samples: str, identity: str, sfreq: float, conditions: tuple[str, ...] = K.CONDITIONS, trials: int = 1, seed: int = 42, **how) -> DataFrame:
    """keep, condition, trial and the changed signal itself (`samples`), for what comes after: features and scores."""

    def study(contexts: list[list[float]], names: list[str]) -> Iterator[tuple[int, dict]]:
        for i, condition, t, _, changed in _changed(contexts, names, sfreq, conditions, trials, seed, **how):
            yield i, {"condition": condition, "trial": t, "samples": changed}

    return per_batch(rows, keep, [samples, identity], study, "condition string, trial int, samples array<double>")


def context_measurements(rows: DataFrame, keep: list[str], samples: str, seed: int = 42) -> DataFrame:
    """The sr and cr measurement of each context (`samples` NULL: unusable context)."""
    schema = "sr_value double, cr_value double, sr_reason string, cr_reason string, frequency double, clipped double, bistable_events int, peak_events int"
    return per_batch(rows, keep, [samples], lambda x: enumerate(K.measurements(_arrays(x), seed)), schema)


def record_measurements(contexts: DataFrame, keys: list[str], samples: str = "samples", seed: int = 42) -> DataFrame:
    """`context_measurements` of a table that holds the keys, the reason and the samples and nothing else: labels can't
    enter. A context whose reason is not ok is reported with it and not measured."""
    if set(contexts.columns) != {*keys, "context_reason", samples}:
        raise ValueError("only keys, context_reason and samples are accepted")
    usable = contexts.withColumn(samples, F.when(F.col("context_reason") == "ok", F.col(samples)))
    out = context_measurements(usable, [*keys, "context_reason"], samples, seed)
    bad = F.col("context_reason") != "ok"
    return out.withColumns({r: F.when(bad, F.col("context_reason")).otherwise(F.col(r)) for r in ("sr_reason", "cr_reason")})


def replicated_means(rows: DataFrame, keep: list[str], samples: str, seeds: tuple[int, ...]) -> DataFrame:
    return per_batch(rows, keep, [samples], lambda x: enumerate(K.sr_means(_arrays(x), list(seeds))), "value double, missing int, reason string, valid_trials int", 64)


def controls(rows: DataFrame, keep: list[str], frequency: str, seeds: tuple[int, ...]) -> DataFrame:
    """The measurement without a drive at each row's frequency, for each seed."""

    def study(frequencies: list[float | None]) -> Iterator[tuple[int, dict]]:
        for s in seeds:
            yield from ((i, {"seed": s, **found}) for i, found in enumerate(K.controls(frequencies, s)))

    return per_batch(rows, keep, [frequency], study, "seed int, sr_value double, cr_value double, sr_reason string, cr_reason string, peak_events int")


def dose_trials(rows: DataFrame, keep: list[str], samples: str, scales: tuple[float, ...], doses: tuple[float, ...], seeds: tuple[int, ...]) -> DataFrame:
    """Regularity of the FitzHugh-Nagumo peaks for each input scale, noise dose and seed."""

    def study(contexts: list[list[float]]) -> Iterator[tuple[int, dict]]:
        drives, _ = K.characteristic_components(np.array(contexts, float), K.RATE)
        for d, s, seed in product(doses, scales, seeds):
            yield from ((i, {"scale": s, "dose": d, "seed": seed, **found}) for i, found in enumerate(K.cr_trials(drives, s, d, seed)))

    return per_batch(rows, keep, [samples], study, "scale double, dose double, seed int, value double, reason string, missing int, events int, intervals int, clipped double")
