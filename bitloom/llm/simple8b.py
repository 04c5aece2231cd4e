"""Simple-8b word-aligned coding of unsigned integers, coded and decoded with numpy.

A 64-bit word has a 4-bit selector in its top bits. Selectors 1 to 14 pack ``COUNTS[s]`` values of
``WIDTHS[s]`` bits; selector 15 is a run of 120 zeros; selector 0 is the escape: the next word holds
one value of any size. Values are cut into blocks of ``BLOCK``; no word crosses a block, and the
word offset of each block is kept, so blocks are coded and decoded side by side.
"""

from __future__ import annotations

import numpy as np

#: Fixed values of the format: values per word and their bits, by selector.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 120], np.int64)
WIDTHS = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0], np.int64)
BLOCK = 1024


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(uint64 words, word offset of each block of BLOCK values)."""
    v = np.asarray(values).astype(np.uint64)
    n = len(v)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    bits = np.zeros((blocks, BLOCK), np.int8)
    bits.reshape(-1)[:n] = _bit_lengths(v)
    # most values of a word from each position on; past a block's end nothing needs to fit, as the
    # number of values is known, so the last word of a block may hold fewer than it has room for
    choice = np.where(bits <= 60, 14, 0).astype(np.uint8)
    widest = bits.copy()
    by_count = {int(c): k for k, c in enumerate(COUNTS) if k and c > 1}
    for c in range(2, 61):
        np.maximum(widest[:, : BLOCK - c + 1], bits[:, c - 1 :], out=widest[:, : BLOCK - c + 1])
        if c in by_count:
            if int(widest.min()) > WIDTHS[by_count[c]]:
                break
            choice[widest <= WIDTHS[by_count[c]]] = by_count[c]
    if not widest.all():
        run = widest.copy()
        np.maximum(run[:, :-60], widest[:, 60:], out=run[:, :-60])
        choice[run == 0] = 15
    choice = choice.reshape(-1)[:n]
    left = np.minimum(BLOCK - np.arange(n) % BLOCK, n - np.arange(n))
    take = np.minimum(left, COUNTS[choice])
    # all blocks step from word to word together
    pos = np.arange(0, n, BLOCK)
    end = np.minimum(pos + BLOCK, n)
    at, sel, owner = [], [], []
    own = np.arange(blocks)
    while len(pos):
        s = choice[pos]
        at.append(pos)
        sel.append(s)
        owner.append(own)
        pos = pos + take[pos]
        keep = pos < end
        pos, end, own = pos[keep], end[keep], own[keep]
    at, sel, owner = np.concatenate(at), np.concatenate(sel), np.concatenate(owner)
    order = np.argsort(at, kind="stable")
    at, sel, owner = at[order], sel[order], owner[order]
    width = 1 + (sel == 0)  # an escape has a word after it
    place = np.cumsum(width) - width
    words = np.zeros(int(width.sum()), np.uint64)
    padded = np.concatenate([v, np.zeros(120, np.uint64)])
    words[place] = sel.astype(np.uint64) << np.uint64(60)
    for s in np.unique(sel).tolist():
        rows = np.flatnonzero(sel == s)
        if s == 0:
            words[place[rows] + 1] = v[at[rows]]
            continue
        if s == 15:
            continue
        word, n_taken = words[place[rows]], take[at[rows]]
        for k in range(int(COUNTS[s])):
            part = padded[at[rows] + k] << np.uint64(k * int(WIDTHS[s]))
            word |= np.where(k < n_taken, part, np.uint64(0))
        words[place[rows]] = word
    return words, place[np.searchsorted(owner, np.arange(blocks))]


_SMALL = np.array([i.bit_length() for i in range(65536)], np.int8)


def _bit_lengths(v: np.ndarray) -> np.ndarray:
    if int(v.max()) < 65536:
        return _SMALL[v.astype(np.uint16)]
    bits = np.zeros(len(v), np.int8)
    for shift in (0, 16, 32, 48):
        part = _SMALL[((v >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)]
        np.copyto(bits, part + np.int8(shift), where=part > 0)
    return bits


def decode(words: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values of whole blocks that follow each other; inverse of :func:`encode`."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    words = np.asarray(words, np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    # the word after an escape is a value; an escaped value may look like an escape, so these are found in order
    zero = np.flatnonzero(sel == 0)
    raw = np.zeros(len(words), bool)
    if len(zero):
        last = -2
        for i in zero.tolist():
            if i == last + 1:
                continue
            last = i
            raw[i + 1] = True
    head = np.flatnonzero(~raw)
    s = sel[head]
    count = COUNTS[s]
    # words at the end of a block may be short
    begin = _begins(count, n)
    stop = np.append(begin[1:], n)
    for k in np.unique(s).tolist():
        rows = np.flatnonzero(s == k)
        if k == 15:
            continue
        if k == 0:
            out[begin[rows]] = words[head[rows] + 1]
            continue
        w = words[head[rows]]
        mask = np.uint64((1 << int(WIDTHS[k])) - 1)
        for j in range(int(COUNTS[k])):
            at = begin[rows] + j
            good = at < stop[rows]
            out[at[good]] = (w[good] >> np.uint64(j * int(WIDTHS[k]))) & mask
    return out


def _begins(count: np.ndarray, n: int) -> np.ndarray:
    """First value of each word: full words follow each other, and the first word over a block's end starts the next block."""
    begin = np.empty(len(count), np.int64)
    at = i = 0
    sums = np.concatenate(([0], np.cumsum(count)))
    while i < len(count):
        # words i..j-1 fill the block that ends at ``limit``
        limit = min((at // BLOCK + 1) * BLOCK, n)
        j = int(np.searchsorted(sums, sums[i] + limit - at, side="left"))
        begin[i:j] = at + sums[i:j] - sums[i]
        at, i = limit, j
    return begin
