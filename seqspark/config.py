"""Alignment settings."""

from __future__ import annotations

from dataclasses import dataclass

MODES = ("NW", "SHW", "HW")
TASKS = ("distance", "locations", "path")
FORMATS = ("standard", "extended")

#: Nucleotide ambiguity codes and the bases each stands for.
IUPAC_CODES = {"R": "AG", "Y": "CT", "S": "GC", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}

IUPAC = tuple((code, base) for code, bases in IUPAC_CODES.items() for base in bases)
CASE_INSENSITIVE = tuple((chr(c), chr(c).lower()) for c in range(65, 91))


@dataclass(frozen=True)
class AlignConfig:
    """mode: NW (global), SHW (prefix of the target) or HW (anywhere in the target).
    task: distance and end locations; locations adds starts; path adds the alignment.
    k: largest distance of interest, negative for no bound. equalities: pairs of
    symbols that count as equal (symmetric, not transitive). max_alphabet: an
    error above so many distinct symbols in a pair (None: no limit).
    path_bytes: size of stored columns from which a path is found by dividing the pair.
    before_start: whether an end of -1 (query wholly before the target) is
    reported as the reference convention has it, or never."""

    k: int = -1
    mode: str = "NW"
    task: str = "distance"
    equalities: tuple = ()
    max_alphabet: int | None = None
    before_start: bool = True
    path_bytes: int = 1 << 20

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}, not {self.mode!r}")
        if self.task not in TASKS:
            raise ValueError(f"task must be one of {TASKS}, not {self.task!r}")
        object.__setattr__(self, "k", -1 if self.k is None else int(self.k))
        object.__setattr__(self, "equalities", tuple((a, b) for a, b in self.equalities))
