"""Names for inner columns."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fresh(frames: list[DataFrame], *names: str) -> list[str]:
    """The names, longer by underscores until no column of the frames is called so (in any case)."""
    taken = {c.lower() for df in frames for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
