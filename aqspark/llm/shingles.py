"""Weighted word shingles of many texts at once, in numpy."""

import numpy as np

SIZE = 5
# document frequencies are kept per hash bucket, so that their table has a fixed size
BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
PART = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, "uint64")
    out[0] = 1
    return np.cumprod(out, dtype="uint64")


_UP, _DOWN = _powers(_BASE, PART + 1), _powers(_INVERSE, PART + 1)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Place and hash of every word (digits, a-z, characters beyond ASCII) of a lower-case text."""
    places, hashes, start = [], [], 0
    while start < len(data):
        stop = min(start + PART, len(data))
        if stop < len(data):
            # end the part behind a space, if it has one: a word without end is cut in the middle
            stop = max(data.rfind(b" ", start, stop) + 1, 0) or stop
            stop = stop if stop > start else min(start + PART, len(data))
        raw = np.frombuffer(data, "uint8", stop - start, start)
        inside = np.r_[False, _WORD[raw], False]
        first = np.flatnonzero(inside[1:] & ~inside[:-1])
        last = np.flatnonzero(~inside[1:] & inside[:-1])
        with np.errstate(over="ignore"):
            total = np.r_[np.uint64(0), np.cumsum((raw.astype("uint64") + np.uint64(1)) * _UP[:len(raw)], dtype="uint64")]
            hashes.append(mixed((total[last] - total[first]) * _DOWN[first]))
        places.append(first + start)
        start = stop
    if not places:
        return np.empty(0, "int64"), np.empty(0, "uint64")
    return np.concatenate(places), np.concatenate(hashes)


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of lower-case texts: hashes (ascending within a text), how often each
    occurs, and how many every text has. A text of one to four words has one shingle of all its words."""
    data = b" ".join(texts)
    place, word = word_hashes(data)
    sizes = np.fromiter(map(len, texts), "int64", len(texts))
    begins = np.cumsum(sizes + 1) - sizes - 1
    at = np.r_[np.searchsorted(place, begins), len(word)]
    with np.errstate(over="ignore"):
        rolled = word[:max(len(word) - SIZE + 1, 0)].copy()
        factor = np.uint64(_BASE)
        for k in range(1, SIZE):
            rolled += word[k:len(word) - SIZE + 1 + k] * factor
            factor = np.uint64(int(factor) * _BASE % (1 << 64))
        rolled = mixed(rolled)
    hashes, counts, n = [], [], np.zeros(len(texts), "int64")
    for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        if b - a >= SIZE:
            own, often = np.unique(rolled[a:b - SIZE + 1], return_counts=True)
        elif b > a:
            whole = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for h in word[a:b]:
                    whole = (whole ^ h) * np.uint64(_BASE)
            own, often = mixed(np.array([whole])), np.array([1])
        else:
            continue
        hashes.append(own)
        counts.append(often)
        n[i] = len(own)
    if not hashes:
        return np.empty(0, "uint64"), np.empty(0, "int64"), n
    return np.concatenate(hashes), np.concatenate(counts), n


def buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype("int64")


def weighted_jaccard(a, wa, b, wb) -> float:
    """Of two sets of ascending hashes with their weights."""
    if not len(a) or not len(b):
        return 0.0
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    same = a[at] == b
    common = np.minimum(wa[at[same]], wb[same]).sum()
    return float(common / (wa.sum() + wb.sum() - common))


class ConsistentSampler:
    """Improved consistent weighted sampling.

    Sample k of a weighted set is the shingle with the smallest ln(a) = ln(c) - r (t - beta) - r, where
    t = floor(ln(w) / r + beta) and r, c ~ Gamma(2, 1), beta ~ U(0, 1) belong to the shingle and to k. Two sets agree in
    a sample with the probability of their weighted Jaccard similarity. The random numbers come from a fixed table
    at a place hashed from shingle and k; equal ln(a) are told apart by the shingle's hash.
    """

    TABLE_BITS = 16

    def __init__(self, samples: int, seed: int = 7):
        random = np.random.default_rng(seed)
        size = 1 << self.TABLE_BITS
        self.r = random.gamma(2.0, 1.0, size).astype("float32")
        self.per_r = (1 / self.r).astype("float32")
        self.beta = random.random(size).astype("float32")
        # what is left of ln(a) when t = 0
        self.rest = (np.log(random.gamma(2.0, 1.0, size)) + self.r * (self.beta - 1)).astype("float32")
        self.odd = random.integers(0, 1 << 63, samples, dtype="uint64") * np.uint64(2) + np.uint64(1)

    def samples(self, hashes, weights, n) -> np.ndarray:
        """A row of samples (64-bit) for each text that has shingles, in order."""
        begins = (np.cumsum(n) - n)[n > 0]
        out = np.empty((len(begins), len(self.odd)), "uint64")
        log_w = np.log(weights).astype("float32")
        tag = hashes & np.uint64(0xFFFFFFFF)
        shift = np.uint64(64 - self.TABLE_BITS)
        with np.errstate(over="ignore"):
            for k, odd in enumerate(self.odd):
                at = ((hashes * odd) >> shift).astype("int64")
                t = np.floor(log_w * self.per_r[at] + self.beta[at])
                log_a = self.rest[at] - self.r[at] * t
                bits = log_a.view("uint32")
                # floats in the order of unsigned integers
                order = bits ^ (np.uint32(0x80000000) | (bits.view("int32") >> 31).view("uint32"))
                out[:, k] = np.minimum.reduceat((order.astype("uint64") << np.uint64(32)) | tag, begins)
        return out


def band_hashes(samples: np.ndarray, rows: int) -> np.ndarray:
    """One hash for every ``rows`` consecutive samples, different from band to band."""
    bands = samples.shape[1] // rows
    out = np.empty((len(samples), bands), "uint64")
    with np.errstate(over="ignore"):
        for band in range(bands):
            h = np.full(len(samples), band + 1, "uint64")
            for k in range(band * rows, band * rows + rows):
                h = mixed(h * np.uint64(_BASE) ^ samples[:, k])
            out[:, band] = h
    return out
