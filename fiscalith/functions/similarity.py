"""String similarity from 0 to 100 by insertions and deletions, and its token and partial variants."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np


@lru_cache(maxsize=1 << 10)
def _places(s: str) -> dict[str, int]:
    """Where each character is, a bit a place."""
    places: dict[str, int] = {}
    for i, ch in enumerate(s):
        places[ch] = places.get(ch, 0) | 1 << i
    return places


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit per character of ``a``, which had better be the one that comes again."""
    at = _places(a).get
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & at(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the common subsequence over the total length; 100 for two empty strings."""
    n = len(a) + len(b)
    return 100.0 if not n else 200.0 * common_subsequence(a, b) / n


@lru_cache(maxsize=1 << 16)
def tokens_of(s: str) -> tuple[str, frozenset[str]]:
    words = s.split()
    return " ".join(sorted(words)), frozenset(words)


@lru_cache(maxsize=1 << 16)
def distinct_of(s: str) -> str:
    """The words of ``s`` in order of the alphabet, once each."""
    return " ".join(sorted(tokens_of(s)[1]))


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(tokens_of(a)[0], tokens_of(b)[0])


def token_set_ratio(a: str, b: str) -> float:
    """The best of the common words against either side's words; 100 if one side's words are all in the other's."""
    left, right = tokens_of(a)[1], tokens_of(b)[1]
    if not left or not right:
        return 0.0
    common, only_a, only_b = left & right, left - right, right - left
    if common and (not only_a or not only_b):
        return 100.0
    base = " ".join(sorted(common))
    rest_a, rest_b = " ".join(sorted(only_a)), " ".join(sorted(only_b))
    gap = bool(base)
    size = len(base) + gap
    total = 2 * size + len(rest_a) + len(rest_b)
    best = 200.0 * (size + common_subsequence(rest_a, rest_b)) / total if total else 0.0
    if base:
        for rest in (rest_a, rest_b):
            best = max(best, 200.0 * len(base) / (2 * len(base) + gap + len(rest)))
    return best


def partial_ratio(a: str, b: str, least: float = 0.0) -> float:
    """The best ratio of the shorter string against windows of its length, also those that run over an end of the longer.

    A result below ``least`` may come out smaller still: windows whose characters in common cannot reach it are not compared.
    """
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    n, best, places = len(a), 0.0, _places(a)
    full = (1 << n) - 1
    hits = [places.get(ch, 0) for ch in b]
    # What the window has too few of, and how many characters it has in common with the shorter string.
    missing, common = _characters(a).copy(), 0
    for start in range(1 - n, len(b)):
        end = start + n
        if end <= len(b) and hits[end - 1]:
            common += missing[b[end - 1]] > 0
            missing[b[end - 1]] -= 1
        if start > 0 and hits[start - 1]:
            missing[b[start - 1]] += 1
            common -= missing[b[start - 1]] > 0
        lo, hi = max(0, start), min(len(b), end)
        bound = 200.0 * common / (n + hi - lo)
        if bound > best and bound >= least:
            row = full
            for places_of in hits[lo:hi]:
                hit = row & places_of
                row = ((row + hit) | (row - hit)) & full
            best = max(best, 200.0 * (n - row.bit_count()) / (n + hi - lo))
            if best == 100.0:
                break
    return best


@lru_cache(maxsize=1 << 16)
def _characters(s: str) -> dict[str, int]:
    return dict(Counter(s))


def partial_bound(a: str, b: str) -> float:
    """What ``partial_ratio`` cannot exceed, from the characters that the two have in common."""
    if len(a) > len(b):
        a, b = b, a
    other, common = _characters(b).get, 0
    for ch, n in _characters(a).items():
        m = other(ch, 0)
        common += n if n < m else m
    return 200.0 * common / (len(a) + common) if a else 100.0


def partial_token_ratio(a: str, b: str, least: float = 0.0) -> float:
    left, right = tokens_of(a)[1], tokens_of(b)[1]
    if left & right:
        return 100.0
    in_order, distinct = (tokens_of(a)[0], tokens_of(b)[0]), (distinct_of(a), distinct_of(b))
    best = partial_ratio(*in_order, least)
    return best if distinct == in_order else max(best, partial_ratio(*distinct, max(best, least)))


def weighted_ratio(a: str, b: str, least: float = 0.0) -> float:
    """The whole, token and, for strings of very unequal length, partial ratios, the latter at a discount.

    A result below ``least`` may come out smaller still: comparisons that cannot reach it are left out.
    """
    if not a or not b:
        return 0.0
    shorter = min(len(a), len(b))
    longer = max(len(a), len(b)) / shorter
    common = common_subsequence(a, b)
    best = 200.0 * common / (len(a) + len(b))
    if longer < 1.5:
        return max(best, 0.95 * max(token_sort_ratio(a, b), token_set_ratio(a, b)))
    scale = 0.9 if longer <= 8 else 0.6
    share = tokens_of(a)[1] & tokens_of(b)[1]
    bound = scale * 200.0 * common / (shorter + common)  # no window has a longer common subsequence
    if share:
        best = max(best, 95.0 * scale)
    elif 95.0 * scale > max(best, least - _SLACK):
        in_order, distinct = (tokens_of(a)[0], tokens_of(b)[0]), (distinct_of(a), distinct_of(b))
        most = partial_bound(*in_order) if distinct == in_order else max(partial_bound(*in_order), partial_bound(*distinct))
        if 0.95 * scale * most > max(best, least - _SLACK):
            best = max(best, 0.95 * scale * partial_token_ratio(a, b, max(best, least) / (0.95 * scale) - _SLACK))
    return max(best, scale * partial_ratio(a, b, max(best, least) / scale - _SLACK)) if bound > max(best, least - _SLACK) else best


#: Bins that characters are counted in; characters that share one only make the bounds wider.
_BINS = 64
#: More than what the order of floating point operations can change.
_SLACK = 1e-9
#: Texts compared before those that the scores kept by then rule out are taken from the rest.
_STEP = 64


def _counts(texts: Sequence[str]) -> np.ndarray:
    """How many characters of each bin the texts have."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    return np.bincount(owner * _BINS + (codes & (_BINS - 1)), minlength=len(texts) * _BINS).reshape(-1, _BINS).astype(np.int32)


class Candidates:
    """Texts to be compared with many queries: for each query, what their scores cannot exceed, for all of them at once.

    A text has an id, or several in ascending order, and is compared once for all of them.
    """

    def __init__(self, ids: Sequence[int] | Sequence[Sequence[int]], texts: Sequence[str]):
        every = [[i] if isinstance(i, int) else i for i in ids]
        order = sorted(range(len(every)), key=every.__getitem__)
        self.all_ids, self.texts = [every[i] for i in order], [texts[i] for i in order]
        self.ids = np.array([at[0] for at in self.all_ids], dtype=np.int64)
        parts = [tokens_of(t) for t in self.texts]
        self.length = np.array([len(t) for t in self.texts])
        self.sorted_length = np.array([len(joined) for joined, _ in parts])
        self.n_tokens = np.array([len(words) for _, words in parts])
        self.distinct_length = np.array([sum(map(len, words)) + len(words) - 1 for _, words in parts])
        self.counts = np.ascontiguousarray(_counts(self.texts).T)
        where: dict[str, list[int]] = {}
        for i, (_, words) in enumerate(parts):
            for w in words:
                where.setdefault(w, []).append(i)
        self.where = {w: np.array(at) for w, at in where.items()}

    def common(self, query: str) -> np.ndarray:
        """At least how many characters each text has in common with the query, in whatever order."""
        total = np.zeros(len(self.texts), dtype=np.int32)
        own = _counts([query])[0]
        for b in np.flatnonzero(own):
            total += np.minimum(self.counts[b], own[b])
        return total

    def shared(self, words: frozenset[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many of ``words`` each text has, and their length."""
        n, length = np.zeros(len(self.texts), dtype=np.int64), np.zeros(len(self.texts), dtype=np.int64)
        for w in words:
            at = self.where.get(w)
            if at is not None:
                n[at] += 1
                length[at] += len(w)
        return n, length

    def set_limits(self, query: str, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """What ``token_set_ratio`` is at least, and at most."""
        words = tokens_of(query)[1]
        if not words:
            return np.zeros(len(self.texts)), np.zeros(len(self.texts))
        common = self.common(query) if common is None else common
        n, length = self.shared(words)
        some = n > 0
        base = np.where(some, length + n - 1, 0)
        size = np.where(some, base + 1, 0)
        own = sum(map(len, words)) + len(words) - 1
        rest_a, rest_b = np.maximum(own - size, 0), np.maximum(self.distinct_length - size, 0)
        left = np.minimum(np.minimum(rest_a, rest_b), np.maximum(common - length, 0))
        total = np.maximum(2 * size + rest_a + rest_b, 1)
        sure = np.where(some, 200.0 * base / np.maximum(2 * base + 1 + np.minimum(rest_a, rest_b), 1), 0.0)
        least, most = np.maximum(sure, 200.0 * size / total), np.maximum(sure, 200.0 * (size + left) / total)
        whole = some & ((n == len(words)) | (n == self.n_tokens))
        for limit in (least, most):
            limit[whole] = 100.0
            limit[self.n_tokens == 0] = 0.0
        return least, most

    def set_bounds(self, query: str) -> np.ndarray:
        """Bounds of ``token_set_ratio``."""
        return self.set_limits(query)[1]

    def weighted_limits(self, query: str) -> tuple[np.ndarray, np.ndarray]:
        """What ``weighted_ratio`` is at least, and at most."""
        if not query:
            return np.zeros(len(self.texts)), np.zeros(len(self.texts))
        common = self.common(query)
        some = self.length > 0
        short, long = np.minimum(self.length, len(query)), np.maximum(self.length, len(query))
        whole = 200.0 * common / (self.length + len(query))
        in_order = 200.0 * np.minimum(common, len(tokens_of(query)[0])) / np.maximum(self.sorted_length + len(tokens_of(query)[0]), 1)
        sure, by_set = self.set_limits(query, common)
        near = np.maximum(whole, 0.95 * np.maximum(np.minimum(in_order, 100.0), by_set))
        scale = np.where(long <= 8 * short, 0.9, 0.6)
        partial = np.minimum(200.0 * common / np.maximum(short + common, 1), 100.0)
        fewest = np.minimum(self.distinct_length, len(distinct_of(query)))
        both = np.minimum(common, np.maximum(fewest, 0))
        partial_words = np.maximum(partial, np.minimum(200.0 * both / np.maximum(fewest + both, 1), 100.0))
        share = self.shared(tokens_of(query)[1])[0] > 0
        words = np.where(share, 95.0 * scale, 0.95 * scale * partial_words)
        far = np.maximum(whole, np.maximum(words, scale * partial))
        is_near = long < 1.5 * short
        least = np.where(is_near, 0.95 * sure, np.where(share, 95.0 * scale, 0.0))
        return np.where(some, least, 0.0), np.where(some, np.where(is_near, near, far), 0.0)

    def weighted_bounds(self, query: str) -> np.ndarray:
        """Bounds of ``weighted_ratio``."""
        return self.weighted_limits(query)[1]

    def best(
        self, bounds: np.ndarray, score: Callable[..., float], cutoff: float, keep: int, so_far: list[tuple[float, int]], told: bool = False,
        sure: np.ndarray | None = None,
    ) -> None:
        """Puts the ids of the ``keep`` highest scores from ``cutoff`` on, of equal ones the smaller ids, into the heap ``so_far`` of (score, -id).

        Texts are compared in the order of their bounds, until no bound is above the least score kept. With ``told``, ``score`` is
        called with a second argument: a score below it need not be exact, because it is not kept. ``sure`` are scores that the texts have at
        least; if ``keep`` texts have one from ``cutoff`` on, those that cannot reach it are not compared.
        """
        if sure is not None and len(sure) >= keep and len(so_far) < keep:
            known = np.partition(sure, len(sure) - keep)[len(sure) - keep] - _SLACK
            start = max(cutoff, known)
        else:
            start = cutoff
        rest = None
        while rest is None or len(rest):
            full = len(so_far) >= keep
            least = max(start, so_far[0][0]) if full else start
            among = slice(None) if rest is None else rest
            open_ = bounds[among] >= least - _SLACK
            if full:  # a score equal to the least one kept counts with a smaller id only
                open_ &= (bounds[among] > least + _SLACK) | (self.ids[among] < -so_far[0][1])
            if rest is None:
                rest = np.flatnonzero(open_)
                rest = rest[np.argsort(-bounds[rest], kind="stable")]
            else:
                rest = rest[open_]
            for i in rest[:_STEP].tolist():
                full = len(so_far) >= keep
                if full and bounds[i] < so_far[0][0] - _SLACK:
                    return
                s = score(self.texts[i], max(start, so_far[0][0]) if full else start) if told else score(self.texts[i])
                if s < cutoff:
                    continue
                for each in self.all_ids[i]:
                    entry = (s, -each)
                    if len(so_far) < keep:
                        heapq.heappush(so_far, entry)
                    elif entry > so_far[0]:
                        heapq.heapreplace(so_far, entry)
                    else:
                        break
            rest = rest[_STEP:]
