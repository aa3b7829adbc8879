"""Renderings of alignments: CIGAR, three-line form, blocks of fifty columns."""

from __future__ import annotations

import re
from itertools import groupby

# Letters of the operations 0 to 3 in each format.
LETTERS = {"extended": "=IDX", "standard": "MIDM"}


def cigar(path: bytes | None, kind: str = "extended") -> str | None:
    """Run lengths and letters; None for no path, an unknown kind or a foreign code."""
    if path is None or kind not in LETTERS or any(op > 3 for op in path):
        return None
    return "".join(f"{len(list(run))}{letter}" for letter, run in groupby(LETTERS[kind][op] for op in path))


def nice(locations, cigar_text: str | None, query, target, gap: str = "-") -> tuple[str, str, str]:
    """(query, match and target row) of an extended CIGAR. locations: (start, end)
    pairs, the first is used; a start of None is 0. Raises ValueError where there
    is no alignment to show or an operation is unknown."""
    if not locations:
        raise ValueError("the alignment has no locations")
    if not cigar_text:
        raise ValueError("the alignment has no CIGAR; ask for task='path'")
    if not re.fullmatch(r"(?:\d+[=XID])+", cigar_text):
        raise ValueError(f"unknown operation in CIGAR {cigar_text!r}")
    t, q = locations[0][0] or 0, 0
    rows: tuple[list, list, list] = ([], [], [])
    text = lambda s: s if isinstance(s, str) else s.decode("latin-1") if isinstance(s, bytes) else "".join(map(str, s))
    for n, op in re.findall(r"(\d+)(.)", cigar_text):
        n = int(n)
        rows[0].append(gap * n if op == "D" else text(query[q : q + n]))
        rows[1].append({"=": "|", "X": "."}.get(op, gap) * n)
        rows[2].append(gap * n if op == "I" else text(target[t : t + n]))
        q += n * (op != "D")
        t += n * (op != "I")
    return "".join(rows[0]), "".join(rows[1]), "".join(rows[2])


def pretty(query: str, target: str, path: bytes, end: int, mode: str = "NW", width: int = 50) -> str:
    """Blocks of a target, bar and query row, with the first and last index in each."""
    t = end - sum(op != 1 for op in path) if mode == "HW" else -1
    q = -1
    lines = []
    for at in range(0, len(path), width):
        ops = path[at : at + width]
        row_t, bars, row_q = "", "", ""
        first_t, first_q = t + (ops[0] != 1), q + (ops[0] != 2)
        for op in ops:
            t += op != 1
            q += op != 2
            row_t += "-" if op == 1 else target[t]
            row_q += "-" if op == 2 else query[q]
            bars += "|" if op == 0 else " "
        lines.append(f"T: {row_t} ({max(first_t, 0)} - {t})\n   {bars}\nQ: {row_q} ({max(first_q, 0)} - {q})\n")
    return "\n".join(lines)


def score_line(index: int, score: int, starts, ends) -> str:
    """One line of a score table: index, score, locations; '?' for an unknown start."""
    places = " ".join(f"({'?' if not starts else starts[i]}, {e})" for i, e in enumerate(ends or []))
    return f"#{index}: {score}  {len(ends or [])} [ {places} ]" if places else f"#{index}: {score}  0 [ ]"
