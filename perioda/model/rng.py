"""Random streams of R's default generators: Mersenne Twister, inversion, rejection sampling."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np

BIG = 134217728  # 2**27: inversion joins two uniforms


class RStream:
    def __init__(self, seed: int) -> None:
        seed &= 0xFFFFFFFF
        for _ in range(50):
            seed = (69069 * seed + 1) & 0xFFFFFFFF
        words = []
        for _ in range(625):
            seed = (69069 * seed + 1) & 0xFFFFFFFF
            words.append(seed)
        self.twister = np.random.MT19937()
        self.twister.state = {"bit_generator": "MT19937", "state": {"key": np.array(words[1:], dtype=np.uint32), "pos": 624}}

    def unit(self, n: int) -> np.ndarray:
        u = self.twister.random_raw(n).astype(float) * 2.3283064365386963e-10
        tiny = 0.5 * 2.328306437080797e-10
        return np.clip(u, tiny, 1 - tiny)

    def uniform(self, lo: float, hi: float, shape: tuple[int, int]) -> np.ndarray:
        """Filled column by column."""
        return (lo + (hi - lo) * self.unit(shape[0] * shape[1])).reshape(shape, order="F")

    def normal(self, mean: float, sd: float, shape: tuple[int, int]) -> np.ndarray:
        u = self.unit(2 * shape[0] * shape[1]).reshape(-1, 2)
        p = (np.floor(BIG * u[:, 0]) + u[:, 1]) / BIG
        inverse = NormalDist().inv_cdf
        return (mean + sd * np.array([inverse(x) for x in p])).reshape(shape, order="F")

    def index(self, n: int) -> int:
        """Whole number below n, by rejection of random bits taken 16 at a time."""
        bits = max(1, (n - 1).bit_length()) if n > 1 else 0
        while True:
            v = 0
            for _ in range(0, bits, 16):
                v = 65536 * v + int(np.floor(self.unit(1)[0] * 65536))
            v &= (1 << bits) - 1
            if v < n:
                return v

    def sample(self, n: int, size: int) -> list[int]:
        """size of 1..n without replacement."""
        pool, out = list(range(1, n + 1)), []
        for _ in range(size):
            j = self.index(n)
            out.append(pool[j])
            n -= 1
            pool[j] = pool[n]
        return out
