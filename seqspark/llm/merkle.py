"""A Merkle manifest of a dataset: one tree a group (source), and one over their roots.

The nodes of a level are numbered from 0 within their group. A bucket holds
fanout^levels consecutive ones; one task collapses a bucket by that many levels at a
time (superblock reduction), and the buckets' roots are collapsed likewise until each
group has one. On the way back a bucket's nodes get their siblings inside the bucket,
followed by the bucket's own proof from above.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqspark.llm.common import ascii_lower, materialise

#: Children of a node, and levels that a bucket is collapsed by at once.
FANOUT, LEVELS = 16, 2


def leaf_digest(columns: list[Column]) -> Column:
    """Hex SHA-256 of the values, each as UTF-8 byte count, colon and value, or - if null."""
    parts = []
    for c in columns:
        s = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def places(df: DataFrame, group: str | None, order: list[str]) -> DataFrame:
    """df with i, the place of each row among those of its group (from 0), and n, their number.

    Rows are dealt out by ranges of (group, order), so a group of any size is spread over
    tasks; only the counts of each task and group are added up."""
    keys = [F.col(c).asc_nulls_first() for c in ([group] if group else []) + order]
    one = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at_", F.monotonically_increasing_id())
    one = materialise(one.withColumn("task_", F.shiftright("at_", 33)), "places")
    by = ["task_"] + ([group] if group else [])
    spans = one.groupBy(*by).agg(F.min("at_").alias("first_"), F.count(F.lit(1)).alias("rows_"))
    whole = Window.partitionBy(group) if group else Window.partitionBy()
    before = whole.orderBy("task_").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(
        F.col("task_").alias("t_"),
        *([F.col(group).alias("g_")] if group else []),
        (F.coalesce(F.sum("rows_").over(before), F.lit(0)) - F.col("first_")).alias("shift_"),
        F.sum("rows_").over(whole).alias("n"),
    )
    match = one["task_"] == spans["t_"]
    if group:
        match &= one[group].eqNullSafe(spans["g_"])
    return one.join(spans, match).select(*df.columns, (F.col("at_") + F.col("shift_")).alias("i"), "n")


def _hash(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def tiers(nodes: list[str], levels: int, n: int, fanout: int) -> list[list[str]]:
    """The levels above a bucket's nodes, nodes included: as many as asked for, fewer
    where the n nodes of the group's level need no more."""
    out, left = [nodes], n
    for _ in range(levels):
        if left <= 1:
            break
        low = out[-1]
        out.append([_hash(low[a : a + fanout]) for a in range(0, len(low), fanout)])
        left = -(-left // fanout)
    return out


def siblings(all_tiers: list[list[str]], j: int, fanout: int) -> list[tuple[str, str]]:
    """For each level below the top, the digests left and right of node j's ancestor in its run."""
    out = []
    for tier in all_tiers[:-1]:
        a = j // fanout * fanout
        out.append(("".join(tier[a:j]), "".join(tier[j + 1 : a + fanout])))
        j //= fanout
    return out


def fold(leaf: str, proof: list[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings lead to."""
    for left, right in proof:
        leaf = sha256(f"{left}{leaf}{right}".encode()).hexdigest()
    return leaf


def _packed(texts) -> list[bytes]:
    return [bytes.fromhex(x) for x in texts]


_NODE = "g bigint, i bigint, n bigint, d binary"
_PROOF = "g bigint, i bigint, before array<binary>, after array<binary>, subroot binary, root binary"


def _up(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """The roots of the buckets: the nodes of a level so much higher."""
    block = fanout**levels

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows, n = rows.sort_values("i"), int(rows["n"].iloc[0])
        top = tiers([d.hex() for d in rows["d"]], levels, n, fanout)[-1]
        return pd.DataFrame({"g": [key[0]], "i": [key[1]], "n": [-(-n // block)], "d": _packed(top)})

    return nodes.groupBy("g", F.expr(f"i div {block}").alias("bucket")).applyInPandas(run, _NODE)


def _upper(upper: pd.DataFrame) -> tuple[list[tuple[str, str]], bytes, bytes]:
    one = upper.iloc[0]
    return [(b.hex(), a.hex()) for b, a in zip(one["before"], one["after"], strict=True)], one["subroot"], one["root"]


def _down(nodes: DataFrame, upper: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Proofs of nodes from those of their buckets."""
    block = fanout**levels

    def run(key: tuple, rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        proof, subroot, root = _upper(above)
        own = tiers([d.hex() for d in rows["d"]], levels, int(rows["n"].iloc[0]), fanout)
        paths = [siblings(own, j, fanout) + proof for j in range(len(rows))]
        return pd.DataFrame({"g": rows["g"], "i": rows["i"], "before": [_packed(b for b, _ in p) for p in paths], "after": [_packed(a for _, a in p) for p in paths], "subroot": [subroot] * len(rows), "root": [root] * len(rows)})

    return nodes.groupBy("g", F.expr(f"i div {block}").alias("bucket")).cogroup(upper.groupBy("g", F.col("i").alias("bucket"))).applyInPandas(run, _PROOF)


def _heights(nodes: DataFrame, most: int, fanout: int, levels: int) -> list[DataFrame]:
    """The given nodes, and above them the roots of buckets, up to one node a group."""
    out = [nodes]
    while most > 1:
        out.append(materialise(_up(out[-1], fanout, levels), "nodes"))
        most = -(-most // fanout**levels)
    return out


def manifest(df: DataFrame, columns: list[str], group: str, key: str, altered: DataFrame | None = None, tampered: Column | None = None, fanout: int = FANOUT, levels: int = LEVELS, proofs: bool = False) -> DataFrame:
    """One row per row of df: key, leaf, subroot, root, proof_sha256, folded_root and
    verified, digests as lowercase hex; with proofs also before and after: the siblings'
    digests (hex, put together) on each level, from the leaf's run up to the root.

    A leaf is the digest of `columns`. Leaves of a group ascend by key; while a group has
    several nodes, every `fanout` consecutive ones become the digest of their concatenation
    (the last run may be shorter, even one). Subroots, ordered by group, become the root in
    the same way. tampered: true for rows whose text is lower-cased (A-Z) before
    verification, which folds the changed leaf with the original siblings.

    Null groups form a group of their own, ordered first; null keys come first in theirs.
    Rows of equal keys are ordered by leaf; equal leaves are repeats, of which each has its
    place. A null or empty text gives an ordinary leaf that lower-casing leaves as it is;
    texts are hashed by the JVM at any length. Other columns aren't looked at, whatever
    their names; an empty table gives no rows (it has no root).

    Leaves are written once, sorted by ranges and written with their places; the trees'
    tasks hold one bucket of fanout^levels nodes and its proof.
    """
    low = [ascii_lower(F.col(c)) if c == "text" else F.col(c) for c in columns]
    hit = F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)
    kind = df.schema[key].dataType.simpleString()
    leaves = df.select(
        F.col(key).alias("key"),
        F.col(group).alias("grp"),
        F.unhex(leaf_digest([F.col(c) for c in columns])).alias("leaf"),
        F.when(hit, F.unhex(leaf_digest(low))).alias("other"),
        F.monotonically_increasing_id().alias("row"),
    )
    leaves = materialise(leaves, "leaves")
    groups = places(leaves.groupBy("grp").agg(F.count(F.lit(1)).alias("size")), None, ["grp"])
    groups = materialise(groups.select(F.col("grp").alias("of"), F.col("i").alias("g"), "size", F.col("n").alias("groups")), "groups")
    most, n_groups = groups.agg(F.max("size"), F.max("groups")).first()
    numbered = places(leaves, "grp", ["key", "leaf", "row"])
    base = numbered.join(groups.select("of", "g"), F.col("grp").eqNullSafe(F.col("of"))).select("g", "i", "n", F.col("leaf").alias("d"), F.col("key").cast("string").alias("key"), "other")
    base = materialise(base, "base")

    trees = _heights(base.select("g", "i", "n", "d"), most or 0, fanout, levels)
    tops = trees[-1].select(F.lit(0).cast("bigint").alias("g"), F.col("g").alias("i"), F.lit(n_groups or 0).cast("bigint").alias("n"), "d")
    above = _heights(tops, n_groups or 0, fanout, levels)
    none = F.array().cast("array<binary>")
    proof = above[-1].select("g", "i", none.alias("before"), none.alias("after"), F.col("d").alias("subroot"), F.col("d").alias("root"))
    for nodes in above[-2::-1]:
        proof = materialise(_down(nodes, proof, fanout, levels), "proofs")
    # a group's number becomes its name again, and its top node the only one of its tree
    proof = proof.drop("subroot").join(tops.select("i", F.col("d").alias("subroot")), "i").select(F.col("i").alias("g"), F.lit(0).cast("bigint").alias("i"), "before", "after", "subroot", "root")
    for nodes in trees[-2:0:-1]:
        proof = materialise(_down(nodes, proof, fanout, levels), "proofs")
    block = fanout**levels if len(trees) > 1 else 1
    depth = levels if len(trees) > 1 else 0

    def run(key_: tuple, rows: pd.DataFrame, upper: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        up, subroot, root = _upper(upper)
        rest = "".join(b + a for b, a in up)
        own = tiers([d.hex() for d in rows["d"]], depth, int(rows["n"].iloc[0]), fanout)
        shas, folded, befores, afters = [], [], [], []
        for j, (leaf, other) in enumerate(zip(own[0], rows["other"], strict=True)):
            path = siblings(own, j, fanout)
            shas.append(_hash([*(b + a for b, a in path), rest]))
            folded.append(fold(leaf if other is None else other.hex(), path + up))
            if proofs:
                befores.append([b for b, _ in path + up])
                afters.append([a for _, a in path + up])
        n = len(rows)
        out = {"key": rows["key"].to_numpy(), "leaf": own[0], "subroot": [subroot.hex()] * n, "root": [root.hex()] * n, "proof_sha256": shas, "folded_root": folded, "verified": np.array([f == root.hex() for f in folded], bool)}
        return pd.DataFrame(out | ({"before": befores, "after": afters} if proofs else {}))

    schema = "key string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + ", before array<string>, after array<string>" * proofs
    out = base.groupBy("g", F.expr(f"i div {block}").alias("bucket")).cogroup(proof.groupBy("g", F.col("i").alias("bucket"))).applyInPandas(run, schema)
    return out.select(F.col("key").cast(kind).alias(key), *out.columns[1:])
