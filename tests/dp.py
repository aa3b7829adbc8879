"""Plain dynamic programming, the yardstick of the alignment tests."""


def table(q, t, mode, equal=lambda a, b: a == b):
    d = [[0] * (len(t) + 1) for _ in range(len(q) + 1)]
    for i in range(len(q) + 1):
        d[i][0] = i
    for j in range(1, len(t) + 1):
        d[0][j] = 0 if mode == "HW" else j
    for i in range(1, len(q) + 1):
        for j in range(1, len(t) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (not equal(q[i - 1], t[j - 1])))
    return d


def search(q, t, mode, equal=lambda a, b: a == b):
    """(distance, ends) of two non-empty sequences, without the end before the target."""
    last = table(q, t, mode, equal)[len(q)]
    if mode == "NW":
        return last[-1], [len(t) - 1]
    best = min(last[1:])
    return best, [j - 1 for j in range(1, len(t) + 1) if last[j] == best]


def path(q, t, equal=lambda a, b: a == b):
    """Back from the end: insertion before deletion before diagonal."""
    d, i, j, out = table(q, t, "NW", equal), len(q), len(t), []
    while i or j:
        if i and d[i - 1][j] + 1 == d[i][j]:
            out.append(1)
            i -= 1
        elif j and d[i][j - 1] + 1 == d[i][j]:
            out.append(2)
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append(0 if d[i][j] == d[i + 1][j + 1] else 3)
    return bytes(out[::-1])
