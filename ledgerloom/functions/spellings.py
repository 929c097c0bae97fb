"""Spellings of pages told apart by edits: many distances at once, in numpy within a task."""

from __future__ import annotations

import numpy as np

#: Signs of a word that the bits of a number hold, and classes by which signs are counted.
WORD, CLASSES = 64, 16


def _signs(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The signs of each text down its column, as numbers from 1 (0: behind its end); the lengths."""
    size = np.array([len(t) for t in texts], np.int64)
    every = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    number = np.unique(every, return_inverse=True)[1] + 1
    out = np.zeros((int(size.max(initial=0)), len(texts)), np.min_scalar_type(int(number.max(initial=0))))
    out[np.arange(len(every)) - np.repeat(np.cumsum(size) - size, size), np.repeat(np.arange(len(texts)), size)] = number
    return out, size


def edits(signs: np.ndarray, size: np.ndarray, texts: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Levenshtein's distance of each of ``texts`` from its head (places): Myers' bit vectors, rows of the table for long heads."""
    out = np.where(size[texts] == 0, size[heads], size[texts])  # right where either is empty
    for h in np.unique(heads[size[heads] > WORD]).tolist():
        own = np.flatnonzero(heads == h)
        out[own] = _long(signs[: size[h], h], signs[:, texts[own]], size[texts[own]])
    short = np.flatnonzero((size[heads] > 0) & (size[heads] <= WORD) & (size[texts] > 0))
    if not len(short):
        return out
    texts, (distinct, which) = texts[short], np.unique(heads[short], return_inverse=True)
    length, m, own = size[texts], size[distinct], signs[:, distinct]
    read = signs[: int(length.max())].take(texts, axis=1)
    width = int(max(read.max(), own.max())) + 1
    bits = np.uint32 if m.max() <= 32 else np.uint64
    at, one = np.zeros((len(distinct), width), bits), bits(1)
    sign, rows = np.nonzero(np.arange(int(m.max()))[:, None] < m)
    np.bitwise_or.at(at, (rows, own[sign, rows]), one << sign.astype(bits))
    same = at[0][read] if len(distinct) == 1 else at.ravel()[read + (which * width).astype(np.int32)]
    more, fewer = np.full(len(texts), ~bits(0)), np.zeros(len(texts), bits)
    last_more, last_fewer = more.copy(), fewer.copy()
    across, up, down, kept = (np.empty_like(more) for _ in range(4))
    ends = set(np.unique(length).tolist())
    for j in range(len(same)):
        np.bitwise_and(same[j], more, across)
        across += more
        across ^= more
        across |= same[j]
        np.bitwise_or(across, more, up)
        np.invert(up, up)
        up |= fewer
        np.bitwise_and(more, across, down)
        np.bitwise_or(same[j], fewer, kept)
        up <<= one
        up |= one
        down <<= one
        np.bitwise_or(kept, up, more)
        np.invert(more, more)
        more |= down
        np.bitwise_and(up, kept, fewer)
        if j + 1 in ends:
            ended = length == j + 1
            np.copyto(last_more, more, where=ended)
            np.copyto(last_fewer, fewer, where=ended)
    # down the last column each bit is a step of one: more or fewer edits with one sign more of the head
    head = (~bits(0) >> (8 * one.nbytes - m).astype(bits))[which]
    out[short] = length + np.bitwise_count(last_more & head) - np.bitwise_count(last_fewer & head).astype(np.int64)
    return out


def _long(head: np.ndarray, signs: np.ndarray, size: np.ndarray) -> np.ndarray:
    steps = np.arange(len(head) + 1)[:, None]
    row, out = np.repeat(steps, len(size), 1), np.full(len(size), len(head))
    for j in range(len(signs)):
        best = np.minimum(row + 1, np.concatenate((row[:1] + 1, row[:-1] + (head[:, None] != signs[j]))))
        row = np.minimum.accumulate(best - steps, 0) + steps
        out = np.where(size == j + 1, row[-1], out)
    return out


def first_near(texts: list[str], page: np.ndarray, share: float, least: int) -> np.ndarray:
    """The place of each text's head. In order, a text joins the first head of its page at most max(least, share of the
    longer one's length) edits away, else it is one. ``page``: numbers, those of a page beside each other.

    Taken head by head, all pages at once: the first text of a page without one is the next, and all near it that have
    none join it. Texts whose counts of signs differ by more than the bound are told apart without a distance.
    """
    signs, size = _signs(texts)
    counts = np.stack([(signs % CLASSES == c).sum(0) - (signs == 0).sum(0) * (c == 0) for c in range(CLASSES)]).astype(np.min_scalar_type(-int(size.max(initial=0)) - 1))
    counts = counts[counts.any(1)]
    head, left = np.zeros(len(texts), np.int64), np.arange(len(texts))
    while len(left):
        # of what is left only: its pages, lengths and counts are cut down with it
        opens = np.flatnonzero(np.concatenate(([True], page[1:] != page[:-1])))
        each = np.diff(np.append(opens, len(left)))
        h = np.repeat(left[opens], each)
        own = size[left]
        bound = np.maximum(least, np.floor(np.maximum(own, np.repeat(own[opens], each)) * share)).astype(np.int64)
        more, apart = np.zeros(len(left), np.int64), own - np.repeat(own[opens], each)
        for c in counts:
            more += np.maximum(c - (c[0] if len(opens) == 1 else np.repeat(c[opens], each)), 0)
        may = np.flatnonzero(np.maximum(more, more - apart) <= bound)
        near = may[edits(signs, size, left[may], h[may]) <= bound[may]]
        head[left[near]] = h[near]
        rest = np.ones(len(left), bool)
        rest[near] = False
        left, page, counts = left[rest], page[rest], counts[:, rest]
    return head
