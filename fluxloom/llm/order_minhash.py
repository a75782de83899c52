"""Order MinHash of a text, and the banded alignment that settles a candidate pair; numpy on the texts of a batch.

The k-mers of a text are its windows of ``k`` words (one window of all words, if there are fewer). Equal k-mers are told
apart by their occurrence number. For each of ``tables`` seeds the ``length`` k-mers with the least hashes are taken in the
order of the text, and hashed together: a band. Texts with a band in common are candidates.

The similarity of two texts is l / (m + n - l), where m and n are their numbers of k-mers and l is the length of
their longest common subsequence of k-mers: the Jaccard similarity of k-mers, as far as their order agrees.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd

from fluxloom.llm.common import WORD

_word = re.compile(WORD)
_mix_a, _mix_b, _mix_c = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@dataclass(frozen=True)
class Sketch:
    k: int = 5
    tables: int = 16
    length: int = 5
    seed: int = 7
    threshold: float = 0.8
    short: int = 40  # k-mers up to which a text's pairs are found without bands


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    with np.errstate(over="ignore"):
        x = x + _mix_a
        x = (x ^ (x >> np.uint64(30))) * _mix_b
        x = (x ^ (x >> np.uint64(27))) * _mix_c
        return x ^ (x >> np.uint64(31))


def kmers(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of k words of all texts, in order, and the number of windows of each text."""
    words = [_word.findall(text) if text else [] for text in texts]
    counts = np.array([len(own) for own in words], np.int64)
    if not counts.sum():
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    flat = np.empty(int(counts.sum()), object)
    flat[:] = [w for own in words for w in own]
    hashes = pd.util.hash_array(flat, categorize=False)
    ends = np.repeat(np.cumsum(counts), counts)  # where the text of a word ends
    size = np.repeat(counts, counts)
    found = mix(np.minimum(size, k).astype(np.uint64))
    place = np.arange(len(hashes))
    for j in range(k):
        at = place + j
        found = np.where(at < ends, mix(found ^ hashes[np.minimum(at, len(hashes) - 1)]), found)
    first = place == ends - size
    windows = first | (place + k <= ends)
    return found[windows], np.where(counts > 0, np.maximum(counts - k + 1, 1), 0)


def occurrences(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Number of equal hashes of the same owner before each one."""
    order = np.lexsort((hashes, owner))
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    place = np.arange(len(hashes))
    found = np.empty(len(hashes), np.int64)
    found[order] = place - np.maximum.accumulate(np.where(first, place, 0))
    return found


def numbered(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Hashes of k-mers and their occurrence numbers: different within a text."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return mix(hashes ^ mix(occurrences(hashes, owner).astype(np.uint64)))


def parities(labelled: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """1,024 bits per text: a bit tells whether an odd number of numbered k-mers falls on it.

    A k-mer that only one of two texts has flips one bit, so their bits differ in no more places than their k-mers do:
    a bound that rules out pairs before they are aligned.
    """
    owner = np.repeat(np.arange(len(counts)), counts)
    cells = np.bincount(owner * 1024 + (labelled >> np.uint64(54)).astype(np.int64), minlength=len(counts) * 1024)
    return np.packbits((cells & 1).astype(np.uint8)).view(np.int64).reshape(len(counts), 16)


def bands(labelled: np.ndarray, counts: np.ndarray, sketch: Sketch) -> np.ndarray:
    """One row of hashes per text, a hash per table. Rows of texts without words mean nothing."""
    out = np.zeros((len(counts), sketch.tables), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    starts = (np.cumsum(counts) - counts)[full]
    owner = np.repeat(np.arange(len(full)), counts[full])
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    for t in range(sketch.tables):
        drawn = mix(labelled ^ np.uint64((sketch.seed << 32) + 7919 * t))
        chosen = np.zeros(len(drawn), bool)
        for _ in range(sketch.length):
            least = np.minimum.reduceat(drawn, starts)[owner]
            chosen |= (drawn == least) & (least != none)
            drawn = np.where(chosen, none, drawn)
        at = np.flatnonzero(chosen)  # in the order of the text
        band = np.full(len(full), mix(np.full(1, t, np.uint64))[0])
        rank = np.arange(len(at)) - np.searchsorted(owner[at], owner[at])
        for r in range(sketch.length):
            here = at[rank == r]
            band[owner[here]] = mix(band[owner[here]] ^ labelled[here])
        out[full, t] = band
    return out


def least_common(m: int, n: int, threshold: float) -> int:
    """The common length from which the similarity reaches the threshold."""
    need = int(threshold * (m + n) / (1 + threshold))
    while need < (1 << 62) and need < threshold * (m + n - need) - 1e-9:
        need += 1
    return need


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the common multiset: no common subsequence is longer."""
    values_a, counts_a = np.unique(a, return_counts=True)
    values_b, counts_b = np.unique(b, return_counts=True)
    _, at_a, at_b = np.intersect1d(values_a, values_b, assume_unique=True, return_indices=True)
    return int(np.minimum(counts_a[at_a], counts_b[at_b]).sum())


def common(a: np.ndarray, b: np.ndarray, need: int) -> int:
    """Length of the longest common subsequence if it is ``need`` or more; else some smaller number.

    Equal ends are matched first: some longest subsequence does so. What is left is aligned row by row inside the
    band of offsets that a subsequence of the needed length cannot leave.
    """
    limit = min(len(a), len(b))
    unlike = np.flatnonzero(a[:limit] != b[:limit])
    head = int(unlike[0]) if len(unlike) else limit
    a, b = a[head:], b[head:]
    limit = min(len(a), len(b))
    unlike = np.flatnonzero(a[len(a) - limit :][::-1] != b[len(b) - limit :][::-1])
    tail = int(unlike[0]) if len(unlike) else limit
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    need -= head + tail
    if not len(a) or not len(b):
        return head + tail
    if min(len(a), len(b)) < need:
        return 0
    need = max(need, 0)
    # A match (i, j) of such a subsequence skips at most len - need items of either side.
    below, above = len(a) - need, len(b) - need
    width = below + above + 1
    padded = np.zeros(len(b) + 2 * width, b.dtype)
    padded[width : width + len(b)] = b
    inside = np.zeros(len(padded), bool)
    inside[width : width + len(b)] = True
    # best[w]: longest in a[:i] and b[:j], where j = i + w - below.
    best = np.zeros(width + 1, np.int32)
    for i, value in enumerate(a):
        start = i - below + width
        hit = (padded[start : start + width] == value) & inside[start : start + width]
        # From row i to i + 1 the same column j stands one place to the left.
        step = best[:width] + hit
        np.maximum(step, best[1:], out=step)
        np.maximum.accumulate(step, out=step)
        best[:width] = step
        best[width] = step[-1]
    return head + tail + int(best[:width][min(width - 1, max(0, len(b) - len(a) + below))])


def similar(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[bool, int]:
    """Whether two texts reach the threshold, and a bound: k-mers that are surely not common (exact if they do)."""
    m, n = len(a), len(b)
    if not m or not n:
        return m == n, 0 if m == n else m + n
    need = least_common(m, n, threshold)
    most = min(m, n)
    if most >= need:
        most = shared(a, b)
    if most >= need:
        found = common(a, b, need)
        if found >= need:
            return True, m + n - 2 * found
        most = min(most, need - 1)
    return False, m + n - 2 * most
