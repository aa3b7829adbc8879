"""Distances and ends of many pairs at once: one numpy lane a pair, 64 query rows a word.

The same recurrence as kernel.columns, in blocks that hand horizontal differences
down to the next (Myers 1999). Pairs are put together by their number of words.
"""

from __future__ import annotations

import numpy as np

ONE = np.uint64(1)
TOP = np.uint64(63)
BOTTOM = ONE << TOP

#: Cells of the score table, and match words, that one group may hold.
CELLS, MASK_WORDS = 16_000_000, 4_000_000

#: The width of the first band that global distances are looked for in.
FIRST_BAND = 128


def encode(sequences: list, equal: dict) -> tuple[list[np.ndarray], int, np.ndarray]:
    """Sequences as small codes, the number of codes, and which codes match which."""
    if all(isinstance(s, str) for s in sequences):
        raw = [np.frombuffer(s.encode("utf-32-le"), "<u4") for s in sequences]
        names = lambda c: chr(int(c))
    elif all(isinstance(s, bytes) for s in sequences):
        raw = [np.frombuffer(s, np.uint8) for s in sequences]
        names = int
    else:
        index: dict = {}
        raw = [np.array([index.setdefault(x, len(index)) for x in s], np.uint32) for s in sequences]
        back = list(index)
        names = lambda c: back[int(c)]
    seen, codes = np.unique(np.concatenate(raw) if raw else np.zeros(0, np.uint32), return_inverse=True)
    parts = np.split(codes.astype(np.int32), np.cumsum([len(r) for r in raw])[:-1])
    match = np.eye(len(seen), dtype=bool)
    if equal:
        of = {names(c): i for i, c in enumerate(seen)}
        for a, others in equal.items():
            for b in others:
                if a in of and b in of:
                    match[of[a], of[b]] = match[of[b], of[a]] = True
    return parts, len(seen), match


def masks(queries: list[np.ndarray], words: int, n_codes: int, match: np.ndarray, plain: bool) -> np.ndarray:
    """Match words (codes x words x lanes)."""
    lanes = len(queries)
    q = np.full((lanes, words * 64), -1, np.int32)
    for i, s in enumerate(queries):
        q[i, : len(s)] = s
    out = np.empty((n_codes, words, lanes), np.uint64)
    for code in range(n_codes):
        hit = q == code if plain else np.isin(q, np.flatnonzero(match[code]))
        out[code] = np.packbits(hit, axis=1, bitorder="little").view("<u8").T
    return out


def _group(queries, targets, n_codes, match, plain, mode, keep=None):
    """(distance, ends) for pairs whose queries have one number of words; longest targets first.
    keep: two tables (columns x words x lanes) for the rows of each column that are one more than the
    row above, and one more than the column before."""
    words = -(-max(len(q) for q in queries) // 64)
    lanes = len(queries)
    size = np.array([len(t) for t in targets])
    peq = masks(queries, words, n_codes, match, plain)
    length = np.array([len(q) for q in queries])
    last = ONE << ((length - 1) % 64).astype(np.uint64)
    plus = np.full((words, lanes), np.uint64(0xFFFFFFFFFFFFFFFF))
    minus = np.zeros((words, lanes), np.uint64)
    score = length.astype(np.int32)
    steps = int(size[0])
    text = np.zeros((steps, lanes), np.int32)
    for i, t in enumerate(targets):
        text[: len(t), i] = t
    table = np.empty((steps, lanes), np.int32) if mode != "NW" else None
    final = score.copy()
    alive = np.searchsorted(-size, -np.arange(steps), side="left")
    lane = np.arange(lanes)
    carry_in = np.uint64(0 if mode == "HW" else 1)
    for j in range(steps):
        k = int(alive[j])
        code, at = text[j, :k], lane[:k]
        hp_in = np.full(k, carry_in)
        hm_in = np.zeros(k, np.uint64)
        for w in range(words):
            p, m = plus[w, :k], minus[w, :k]
            eq = peq[code, w, at]
            x = eq | m
            eq |= hm_in
            d = (((eq & p) + p) ^ p) | eq
            hp = m | ~(d | p)
            hm = p & d
            if w == words - 1:
                bit = last[:k]
                score[:k] += ((hp & bit) != 0).view(np.int8)
                score[:k] -= ((hm & bit) != 0).view(np.int8)
            if keep:
                keep[1][j, w, :k] = hp
            hp_out, hm_out = hp >> TOP, hm >> TOP
            hp = (hp << ONE) | hp_in
            hm = (hm << ONE) | hm_in
            plus[w, :k] = hm | ~(x | hp)
            if keep:
                keep[0][j, w, :k] = plus[w, :k]
            minus[w, :k] = hp & x
            hp_in, hm_in = hp_out, hm_out
        if table is not None:
            table[j, :k] = score[:k]
        else:
            done = size[:k] == j + 1
            final[:k][done] = score[:k][done]
    if mode == "NW":
        return [(int(d), [int(n) - 1]) for d, n in zip(final, size, strict=True)]
    out = []
    for i in range(lanes):
        own = table[: size[i], i]
        best = own.min()
        out.append((int(best), np.flatnonzero(own == best).tolist()))
    return out


def search(queries: list, targets: list, mode: str, equal: dict) -> list[tuple[int, list[int]]]:
    """(distance, ends) of each pair of non-empty sequences."""
    n = len(queries)
    parts, n_codes, match = encode([*queries, *targets], equal)
    q, t = parts[:n], parts[n:]
    words = np.array([-(-len(x) // 64) for x in q])
    order = sorted(range(n), key=lambda i: (words[i], -len(t[i])))
    out: list = [None] * n
    i = 0
    while i < n:
        w, longest = words[order[i]], len(t[order[i]])
        most = max(1, min(CELLS // max(1, longest), MASK_WORDS // max(1, int(w) * n_codes), 4096))
        group = [k for k in order[i : i + most] if words[k] == w]
        for k, got in zip(group, _group([q[k] for k in group], [t[k] for k in group], n_codes, match, not equal, mode), strict=True):
            out[k] = got
        i += len(group)
    return out


#: Words of stored columns that a lot of paths may hold.
PATH_WORDS = 4_000_000


def paths(queries: list, targets: list, equal: dict) -> list[bytes]:
    """The global path of each pair of non-empty sequences, all going back from the end together;
    an insertion is preferred to a deletion, and that to a diagonal."""
    n = len(queries)
    parts, n_codes, match = encode([*queries, *targets], equal)
    q, t = parts[:n], parts[n:]
    words = np.array([-(-len(x) // 64) for x in q])
    order = sorted(range(n), key=lambda i: (words[i], -len(t[i])))
    out: list = [b""] * n
    i = 0
    while i < n:
        w, longest = int(words[order[i]]), len(t[order[i]])
        most = max(1, min(PATH_WORDS // (w * longest), MASK_WORDS // (w * n_codes), 4096))
        group = [k for k in order[i : i + most] if words[k] == w]
        i += len(group)
        keep = [np.zeros((longest, w, len(group)), np.uint64) for _ in range(2)]
        own_q, own_t = [q[k] for k in group], [t[k] for k in group]
        _group(own_q, own_t, n_codes, match, not equal, "NW", keep)
        for k, path in zip(group, _back(own_q, own_t, match, *keep), strict=True):
            out[k] = path
    return out


def _back(queries, targets, match, plus, raised) -> list[bytes]:
    n = len(queries)
    size, reach = (np.array([len(x) for x in xs]) for xs in (queries, targets))
    symbols = [np.zeros((n, int(m.max())), np.int32) for m in (size, reach)]
    for table, xs in zip(symbols, (queries, targets), strict=True):
        for r, x in enumerate(xs):
            table[r, : len(x)] = x
    ops = np.empty((int((size + reach).max()), n), np.uint8)
    i, j, lane = size.copy(), reach.copy(), np.arange(n)
    a, b, steps = i, j, np.zeros(n, np.int64)
    while len(lane):
        row, column = a - 1, b - 1
        word, bit = row >> 6, (row & 63).astype(np.uint64)
        up = (plus[column, word, lane] >> bit) & ONE != 0
        left = (raised[column, word, lane] >> bit) & ONE != 0
        same = match[symbols[0][lane, row], symbols[1][lane, column]]
        op = np.where(up, 1, np.where(left, 2, np.where(same, 0, 3))).astype(np.uint8)
        ops[steps[lane], lane] = op
        steps[lane] += 1
        a, b = a - (op != 2), b - (op != 1)
        i[lane], j[lane] = a, b
        on = (a > 0) & (b > 0)
        lane, a, b = lane[on], a[on], b[on]
    ops = np.ascontiguousarray(ops.T)
    return [b"\2" * int(j[r]) + b"\1" * int(i[r]) + ops[r, : steps[r]][::-1].tobytes() for r in range(n)]


def _fill(data: np.ndarray, start: np.ndarray, size: np.ndarray, width: int, empty: int, kind) -> np.ndarray:
    """Rows of a packed table side by side, short ones filled up."""
    out = np.full((len(size), width), empty, kind)
    out[np.arange(width) < size[:, None]] = data[np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]
    return out


def distances(q: np.ndarray, q_at: np.ndarray, t: np.ndarray, t_at: np.ndarray, mode: str, match: dict | None = None, k: int = -1) -> np.ndarray:
    """Distances of packed pairs: symbols (small non-negative integers) of all
    queries one after another and their offsets, likewise the targets. match:
    symbol -> others that equal it. k: what is over it (if it isn't negative) may
    come out as any larger number. Pairs with an empty side follow the rule for those."""
    q_size, t_size = np.diff(q_at), np.diff(t_at)
    out = np.where(mode == "NW", np.maximum(q_size, t_size), q_size).astype(np.int32)
    top = int(max(q.max(initial=0), t.max(initial=0))) + 1
    seen = np.zeros(top, bool)
    seen[q] = seen[t] = True
    symbols = np.flatnonzero(seen)
    code_of = np.zeros(top, np.int32)
    code_of[symbols] = np.arange(len(symbols))
    n_codes = len(symbols)
    qc, tc = code_of[q].astype(np.int16 if n_codes < 30_000 else np.int32), code_of[t]
    same = [[c] for c in range(n_codes)]
    for a, others in (match or {}).items():
        for b in others:
            if a < top and b < top and seen[a] and seen[b]:
                same[code_of[a]].append(int(code_of[b]))
    full = (q_size > 0) & (t_size > 0)
    if k >= 0 and mode == "NW":
        gap = np.abs(q_size - t_size)
        out = np.where(full & (gap > k), gap, out).astype(np.int32)
        full &= gap <= k
    full = np.flatnonzero(full)
    words = -(-q_size // 64)
    order = full[np.lexsort((-t_size[full], words[full]))]
    i, guess = 0, FIRST_BAND
    while i < len(order):
        w = int(words[order[i]])
        longest = int(t_size[order[i]])
        most = max(1, min(LANES // min(w, 16), CELLS // longest, MASK_WORDS // (w * n_codes)))
        lot = order[i : i + most]
        lot = lot[(words[lot] == w) & ((t_size[lot] >= 0.8 * longest) | (np.arange(len(lot)) < 64))]
        i += len(lot)
        sweep = lambda own, bound, w=w: _sweep(qc, q_at[own], q_size[own], tc, t_at[own], t_size[own], w, n_codes, same, mode, bound)
        if mode != "NW":
            out[lot] = sweep(lot, k)
            continue
        # bands of growing width, the first as wide as the lots before would have had it
        left, band = lot, guess if k < 0 else min(guess, max(k, 1))
        while len(left) and band < 64 * (w - 2):
            far = np.abs(t_size[left] - q_size[left]) > band
            own = left[~far]
            d = sweep(own, band) if len(own) else np.zeros(0, np.int32)
            out[own] = d
            if 0 <= k <= band:
                left = left[:0]
            else:
                left = np.concatenate([left[far], own[d > band]])
                left = left[np.argsort(-t_size[left], kind="stable")]
                band *= 2
        if len(left):
            out[left] = sweep(left, -1)
        guess = max(FIRST_BAND, int(np.quantile(out[lot], 0.95)) * 9 // 8)
    return out


#: Lanes that are swept side by side at most, and columns between changes of the blocks in use.
LANES, TILE, BOUNDED_TILE = 8192, 128, 64

_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _sweep(q, q_at, q_size, t, t_at, t_size, words, n_codes, same, mode, bound):
    """Distances of pairs whose queries have one number of words, longest targets first.

    The words of all lanes go forward together, each a column behind the one above it, so that
    a step is one numpy operation on (words x lanes) and no word waits for another's carry.
    Columns go by in tiles. Before a tile the blocks in use are chosen. NW: those that
    a path of cost `bound` can pass; what lies above is taken for growing by one a column, what lies
    below for one more than its neighbour: a result up to the bound is right, a larger one
    only tells that the distance is larger. SHW, HW: those from the first one to the last that
    can still lead to a score of the least one found so far, or the bound, in any lane."""
    n = len(q_size)
    rows = _fill(q, q_at, q_size, words * 64, -1, q.dtype)
    peq = np.empty((n_codes, words, n), np.uint64)
    for c in range(n_codes):
        hit = rows == c if len(same[c]) == 1 else np.isin(rows, same[c])
        peq[c] = np.packbits(hit, axis=1, bitorder="little").view("<u8").T
    peq = peq.reshape(-1)
    steps, width = int(t_size[0]), words * n
    # columns from last to first: the words of a step then read one stretch of it
    text = np.ascontiguousarray(_fill(t, t_at, t_size, steps, 0, np.int32).T[::-1]).astype(np.int64).reshape(-1) * width
    lane = np.arange(width)
    last = ONE << ((q_size - 1) % 64).astype(np.uint64)
    inside = last | (last - ONE)  # the query's rows in its last word
    rest = (q_size - 64 * (words - 1)).astype(np.int32)
    plus, minus = np.full(width, _ALL), np.zeros(width, np.uint64)
    carry = [[np.zeros(width + n, np.uint64), np.zeros(width + n, np.uint64)] for _ in range(2)]
    low, high = 0, 1
    score = np.full(n, 64, np.int32) if words > 1 else q_size.astype(np.int32)  # of the lowest row in use
    best = np.full(n, np.iinfo(np.int32).max, np.int32)
    limit = np.minimum(q_size, bound if bound >= 0 else q_size).astype(np.int32)
    alive = np.searchsorted(-t_size, -np.arange(steps + 1), side="left").tolist()  # lanes with a column j
    buffers = [np.empty(width, np.uint64) for _ in range(4)]
    index = np.empty(width, np.int64)
    banded = mode == "NW" and bound >= 0
    # a path that is e off the diagonal has cost e and must come back to the gap of the lengths
    up, down = (int((bound + sign * (t_size - q_size)).max()) // 2 for sign in (1, -1))
    tile = TILE if banded else BOUNDED_TILE if mode != "NW" and words > 2 else steps
    need = 1 + (int(limit.max()) + tile) // 64 if mode != "NW" and words > 2 else words
    for a in range(0, steps, tile):
        b = min(steps, a + tile)
        if banded:
            low = max(low, max(0, a - up) // 64)
            need = -(-(b + down) // 64)
        need = min(words, max(need, low + 1))
        if need > high:  # new words: each row one more than that above
            plus[high * n : need * n], minus[high * n : need * n] = _ALL, 0
            score += 64 * (need - high) if need < words else 64 * (need - 1 - high) + rest
            high = need
        for one, two in carry:
            one[low * n : (low + 1) * n], two[low * n : (low + 1) * n] = 0 if mode == "HW" and not low else 1, 0
        used, mask = high - low, last if high == words else BOTTOM
        for s in range(b - a + used - 1):
            top, end = (low + max(0, s - (b - a) + 1)) * n, (low + min(used - 1, s) + 1) * n
            size = end - top
            at = (steps - 1 - a - s) * n + top - low * n
            x, y, z, hp = (f[:size] for f in buffers)
            p, m = plus[top:end], minus[top:end]
            (hp_in, hm_in), (hp_out, hm_out) = carry
            np.add(text[at : at + size], lane[top:end], out=index[:size])
            eq = peq.take(index[:size])
            np.bitwise_or(eq, m, out=x)
            eq |= hm_in[top:end]
            np.bitwise_and(eq, p, out=z)
            z += p
            z ^= p
            z |= eq
            np.bitwise_or(z, p, out=hp)
            np.invert(hp, out=hp)
            hp |= m
            np.bitwise_and(p, z, out=y)  # horizontal -1
            j = a + s - used + 1
            if j >= a:
                score += ((hp[size - n :] & mask) != 0).view(np.int8)
                score -= ((y[size - n :] & mask) != 0).view(np.int8)
                if high == words:
                    k = alive[j]
                    if mode != "NW":
                        np.minimum(best[:k], score[:k], out=best[:k])
                    elif alive[j + 1] < k:
                        best[alive[j + 1] : k] = score[alive[j + 1] : k]
            np.right_shift(hp, TOP, out=hp_out[top + n : end + n])
            np.right_shift(y, TOP, out=hm_out[top + n : end + n])
            hp <<= ONE
            hp |= hp_in[top:end]
            y <<= ONE
            y |= hm_in[top:end]
            np.bitwise_or(x, hp, out=z)
            np.invert(z, out=z)
            np.bitwise_or(y, z, out=p)
            np.bitwise_and(hp, x, out=m)
            carry.reverse()
        if b == steps or not (banded or mode != "NW" and words > 2):
            continue
        # what the rows of each word are at least, from the scores at its ends
        own = slice(low * n, high * n)
        p, m = plus[own].reshape(used, n), minus[own].reshape(used, n)
        if high == words:
            p, m = p.copy(), m.copy()
            p[-1] &= inside
            m[-1] &= inside
        step = np.bitwise_count(p).astype(np.int32) - np.bitwise_count(m).astype(np.int32)
        under = score - np.cumsum(step[::-1], axis=0)[::-1]  # the score above each word
        open_ = (2 * under + step - 64 <= 2 * (bound if banded else np.minimum(limit, best))).any(axis=1)
        if banded:
            if not open_.any():
                break
            continue
        if not open_.any():
            break
        need = low + int(np.flatnonzero(open_)[-1]) + 2 + tile // 64
        if need < high:
            score = (under + step)[need - 1 - low]
            high = need
    return best
