"""Starting topics: a distributed truncated SVD turned non-negative.

The dominant right singular vectors come from subspace iteration, one pass
over the rows per step, until the leading values are steady. Perturbation
samples begin at the vectors of the full corpus, which are close to their own,
and iterate just as far.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame

from .passes import accumulate, chunks

OVERSAMPLE = 10
SAMPLE_OVERSAMPLE = 3
MOST_STEPS = 100
STEADY = 1e-4
TINY = 1e-6


@dataclass(frozen=True)
class Spectrum:
    """Leading singular values and right vectors (terms x p) of one set of rows."""

    values: np.ndarray
    vectors: np.ndarray
    documents: float
    entry_sum: float
    square_sum: float
    steps: int = 0
    steady: bool = False


def _member_weights(inside: np.ndarray, sample: int) -> np.ndarray | float:
    return 1.0 if sample < 0 else inside[:, sample].astype(float)[:, None]


def _subspace_step(rows: DataFrame, bases: list[np.ndarray], samples: list[int]) -> list[tuple[Spectrum, np.ndarray]]:
    terms = bases[0].shape[0]
    broadcast = rows.sparkSession.sparkContext.broadcast((bases, samples))

    def block_stats(dense: np.ndarray, inside: np.ndarray) -> list[np.ndarray]:
        bases, samples = broadcast.value
        image = dense @ np.hstack(bases)
        row_sum, row_square = dense.sum(axis=1), np.einsum("ij,ij->i", dense, dense)
        widths = np.cumsum([0] + [b.shape[1] for b in bases])
        masked = image.copy()
        heads = []
        for f, sample in enumerate(samples):
            part = slice(widths[f], widths[f + 1])
            keep = _member_weights(inside, sample)
            masked[:, part] *= keep
            flag = np.ones(len(dense)) if sample < 0 else keep[:, 0]
            heads.append(np.array([flag.sum(), flag @ row_sum, flag @ row_square]))
        back = masked.T @ dense
        out = []
        for f in range(len(samples)):
            part = slice(widths[f], widths[f + 1])
            gram = masked[:, part].T @ masked[:, part]
            out.append(np.concatenate([heads[f], gram.ravel(), back[part].ravel()]))
        return out

    widths = [basis.shape[1] for basis in bases]
    stats = accumulate(rows, terms, [3 + p * p + p * terms for p in widths], block_stats)
    broadcast.destroy()
    found = []
    for basis, flat in zip(bases, stats):
        p = basis.shape[1]
        head, gram, back = flat[:3], flat[3 : 3 + p * p].reshape(p, p), flat[3 + p * p :].reshape(p, terms)
        squares, turn = np.linalg.eigh((gram + gram.T) / 2)
        order = np.argsort(squares)[::-1]
        values = np.sqrt(np.maximum(squares[order], 0.0))
        spectrum = Spectrum(values, basis @ turn[:, order], *(float(x) for x in head))
        following, _ = np.linalg.qr((turn[:, order].T @ back).T)
        found.append((spectrum, following))
    return found


def full_spectrum(rows: DataFrame, terms: int, topics: int, seed: int) -> Spectrum:
    width = min(topics + OVERSAMPLE, terms)
    basis, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((terms, width)))
    before = np.zeros(topics)
    for step in range(1, MOST_STEPS + 1):
        (spectrum, basis), = _subspace_step(rows, [basis], [-1])
        steady = _settled(spectrum.values, before, topics)
        if steady:
            break
        before = spectrum.values[:topics]
    return replace(spectrum, steps=step, steady=steady)


def _settled(values: np.ndarray, before: np.ndarray, topics: int) -> bool:
    return bool(np.abs(values[:topics] - before).max() <= STEADY * max(values[0], TINY))


def sample_spectra(rows: DataFrame, full: Spectrum, topics: list[int]) -> list[Spectrum]:
    """One spectrum per sample flag; ``topics[i]`` belongs to flag ``i``."""
    flags = list(range(len(topics)))
    bases = [full.vectors[:, : k + SAMPLE_OVERSAMPLE] for k in topics]
    spectra: dict[int, Spectrum] = {}
    for part in chunks([basis.nbytes for basis in bases]):
        open_ = {f: (bases[f], np.zeros(topics[f])) for f in flags[part]}
        for step in range(1, MOST_STEPS + 1):
            found = _subspace_step(rows, [basis for basis, _ in open_.values()], list(open_))
            following = {}
            for f, (spectrum, basis) in zip(open_, found):
                steady = _settled(spectrum.values, open_[f][1], topics[f])
                spectra[f] = replace(spectrum, steps=step, steady=steady)
                if not steady:
                    following[f] = basis, spectrum.values[: topics[f]]
            open_ = following
            if not open_:
                break
    return [spectra[f] for f in flags]


def _side_masses(rows: DataFrame, vectors: list[np.ndarray], samples: list[int]) -> list[np.ndarray]:
    """Squared length of the positive, then the negative part of each document-side vector."""
    broadcast = rows.sparkSession.sparkContext.broadcast((vectors, samples))

    def block_stats(dense: np.ndarray, inside: np.ndarray) -> list[np.ndarray]:
        vectors, samples = broadcast.value
        image = dense @ np.hstack(vectors)
        widths = np.cumsum([0] + [v.shape[1] for v in vectors])
        out = []
        for f, sample in enumerate(samples):
            part = image[:, widths[f] : widths[f + 1]] * _member_weights(inside, sample)
            out.append(np.concatenate([(np.maximum(part, 0) ** 2).sum(axis=0), (np.minimum(part, 0) ** 2).sum(axis=0)]))
        return out

    lengths = [2 * v.shape[1] for v in vectors]
    sides = accumulate(rows, vectors[0].shape[0], lengths, block_stats)
    broadcast.destroy()
    return sides


def starting_topics(
    rows: DataFrame, spectra: list[Spectrum], topics: list[int], samples: list[int]
) -> list[np.ndarray]:
    """Non-negative topic-term rows per fit; cells left at zero get the mean entry.

    Of each singular pair the heavier sign is kept, judged on both its document
    and its term side; the document side takes one more pass.
    """
    vectors = [s.vectors[:, :k] for s, k in zip(spectra, topics)]
    sides: list[np.ndarray] = []
    for part in chunks([v.nbytes for v in vectors]):
        sides += _side_masses(rows, vectors[part], samples[part])
    starts = []
    for spectrum, right, k, side in zip(spectra, vectors, topics, sides):
        scale = np.maximum(spectrum.values[:k], TINY)
        left_up, left_down = np.sqrt(side[:k]) / scale, np.sqrt(side[k:]) / scale
        begin = np.zeros((k, len(right)))
        begin[0] = np.sqrt(scale[0]) * np.abs(right[:, 0])
        for j in range(1, k):
            up, down = np.maximum(right[:, j], 0), np.maximum(-right[:, j], 0)
            mass_up, mass_down = left_up[j] * np.linalg.norm(up), left_down[j] * np.linalg.norm(down)
            side_kept, mass = (up, mass_up) if mass_up > mass_down else (down, mass_down)
            begin[j] = np.sqrt(scale[j] * mass) * side_kept / max(np.linalg.norm(side_kept), TINY)
        begin[begin < TINY] = spectrum.entry_sum / (spectrum.documents * len(right))
        starts.append(begin)
    return starts
