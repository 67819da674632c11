"""Merkle manifest of a table by a cogrouped subtree exchange.

Rows are leaves; the leaves of a group (a source), and above them the groups' roots, are hashed ``FAN`` by ``FAN`` up to one
root. Nodes are worked on in superblocks of ``FAN ** HEIGHT`` consecutive ones. Going up, every superblock is reduced to
one node, until each group is one node. Going down, the nodes of a superblock meet the outer nodes that its proofs
need (the siblings on the way from the superblock to the root) in one cogroup, which finishes the local reduction,
joins the inner and outer parts of each proof and, at the leaves, folds them to the root. A group of any size
is many superblocks; what a superblock gets from outside are two digests a level.

Proofs are checked on a tampered copy: leaves that were changed must not fold to the root.

Defined results: every null field is ``-``; a null source is a group of its own, the first; rows of one id are ordered
by their leaf, null ids come first and are never tampered with; repeated rows are leaves each; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ranked, stored

FAN, HEIGHT = 3, 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A proof is a list of steps, bottom first: the digests left of the node, then those right of it.
PATH = "array<struct<left:string,right:string>>"
PATHS = f"part long, pos long, path {PATH}"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(columns: dict[str, Column]) -> Column:
    """The digest of a row's fields: each ``-`` if null, else its number of bytes, a colon and itself."""
    parts = []
    for name in FIELDS:
        value = columns[name].cast("string")
        parts.append(F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts), 256)


def manifest_leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, changed): ``changed`` is the leaf of the tampered row, which lost its line breaks."""
    columns = {n: F.col(n) for n in FIELDS}
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = leaf_of(columns | {"text": F.replace(F.col("text"), F.lit("\n"), F.lit(""))})
    return docs.select("doc_id", "source", leaf_of(columns).alias("leaf"), F.when(tampered, changed).alias("changed"))


def levels(nodes: list[str], height: int | None) -> list[list[str]]:
    """The nodes and the levels above them: ``height`` of them, or up to a single node."""
    out = [nodes]
    while len(out) <= height if height is not None else len(out[-1]) > 1:
        now = out[-1]
        out.append([digest("".join(now[i : i + FAN])) for i in range(0, len(now), FAN)])
    return out


def inner_paths(tree: list[list[str]]) -> Iterator[list[tuple[str, str]]]:
    """For each node of the lowest level, the siblings on its way to the top."""
    for at in range(len(tree[0])):
        path = []
        for level in tree[:-1]:
            run = at - at % FAN
            path.append(("".join(level[run:at]), "".join(level[at + 1 : run + FAN])))
            at //= FAN
        yield path


def _tree(frame: pd.DataFrame, height: int) -> list[list[str]]:
    """Superblocks of a larger group have all levels; a group of one superblock ends at its single node."""
    return levels(frame["node"].tolist(), height if int(frame["n"].iloc[0]) > FAN**height else None)


def _block(height: int) -> Column:
    return F.floor(F.col("pos") / FAN**height).cast("long").alias("block")


def reduce_blocks(nodes: DataFrame, height: int) -> DataFrame:
    """One level of superblocks up: from (part, pos, n, node) to the same of the superblocks' tops."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pos")
        size = FAN**height
        at, n = int(frame["pos"].iloc[0]) // size, -(-int(frame["n"].iloc[0]) // size)
        return pd.DataFrame({"part": frame["part"].iloc[:1], "pos": [at], "n": [n], "node": _tree(frame, height)[-1]})

    return nodes.groupBy("part", _block(height)).applyInPandas(run, "part long, pos long, n long, node string")


Path = list[tuple[str, str]]


def exchange(nodes: DataFrame, outer: DataFrame, finish: Callable[[pd.DataFrame, Iterator[Path], Path, pd.Series], dict], schema: str, height: int) -> DataFrame:
    """Cogroup nodes (part, pos, n, node, ...) with their superblocks' own rows (part, pos, path, ...). ``finish`` gets a
    superblock's nodes, the inner part of each one's path, the outer part of all, and the superblock's row."""
    columns = [c.split()[0] for c in schema.split(", ")]

    def met(frame: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        if frame.empty:
            return pd.DataFrame({c: [] for c in columns})
        frame, above = frame.sort_values("pos"), above.iloc[0]
        found = finish(frame, inner_paths(_tree(frame, height)), [(s["left"], s["right"]) for s in above["path"]], above)
        return pd.DataFrame(found)[columns]

    met_outer = outer.withColumnRenamed("pos", "block").groupBy("part", "block")
    return nodes.groupBy("part", _block(height)).cogroup(met_outer).applyInPandas(met, schema)


def _paths(frame: pd.DataFrame, inner: Iterator[Path], beyond: Path, above: pd.Series) -> dict:
    steps = [[{"left": a, "right": b} for a, b in path + beyond] for path in inner]
    return {"part": frame["part"].tolist(), "pos": frame["pos"].tolist(), "path": steps}


def _proofs(frame: pd.DataFrame, inner: Iterator[Path], beyond: Path, above: pd.Series) -> dict:
    """Each leaf's proof and the root that its tampered or original row folds to."""
    far, proofs, folded = "".join(a + b for a, b in beyond), [], []
    for leaf, changed, path in zip(frame["node"], frame["changed"], inner, strict=True):
        proofs.append(digest("".join(a + b for a, b in path) + far))
        now = changed if isinstance(changed, str) else leaf
        for a, b in itertools.chain(path, beyond):
            now = digest(a + now + b)
        folded.append(now)
    return {"id": frame["id"].tolist(), "leaf": frame["node"].tolist(), "subroot": [above["subroot"]] * len(folded), "proof_sha256": proofs, "folded_root": folded}


def climb(nodes: DataFrame, height: int) -> list[DataFrame]:
    """The nodes and the levels of superblocks above them; in the last, every part is one node."""
    out = [nodes]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > 1:
        out.append(stored(reduce_blocks(out[-1], height)))
    return out


def descend(steps: list[DataFrame], outer: DataFrame, height: int) -> DataFrame:
    """The paths (part, pos, path) of the superblocks just above the lowest of ``steps``; ``outer`` has those of the parts."""
    for nodes in reversed(steps[1:-1]):
        outer = stored(exchange(nodes, outer, _paths, PATHS, height))
    return outer


def merkle_manifest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    kind = dict(docs.dtypes)["doc_id"]
    leaves = stored(manifest_leaves(docs))
    sources = leaves.groupBy("source").agg(F.count("*").alias("n"))
    sources = stored(ranked(sources, [], ["source"]).select("source", F.col("rank").cast("long").alias("part"), "n"))
    placed = ranked(leaves, ["source"], ["source", "doc_id", "leaf"]).withColumnRenamed("rank", "pos").withColumnRenamed("source", "_source")
    placed = placed.join(sources, F.col("_source").eqNullSafe(F.col("source")))
    # ids as text: pandas would turn numbers with nulls into floats
    placed = placed.select("part", F.col("pos").cast("long").alias("pos"), "n", F.col("leaf").alias("node"), F.col("doc_id").cast("string").alias("id"), "changed")
    placed = stored(placed)

    inside = climb(placed.select("part", "pos", "n", "node"), height)
    n_sources = F.lit(sources.count()).cast("long")
    subroots = stored(inside[-1].select(F.lit(0).cast("long").alias("part"), F.col("part").alias("pos"), n_sources.alias("n"), "node"))
    across = climb(subroots, height)
    top = across[-1].select("part", "pos", F.from_json(F.lit("[]"), PATH).alias("path"))
    of_sources = stored(exchange(subroots, descend(across, top, height), _paths, PATHS, height))
    outer = descend(inside, of_sources.select(F.col("pos").alias("part"), F.lit(0).cast("long").alias("pos"), "path"), height)
    outer = outer.join(subroots.select(F.col("pos").alias("part"), F.col("node").alias("subroot")), "part")
    schema = "id string, leaf string, subroot string, proof_sha256 string, folded_root string"
    proofs = exchange(placed, outer, _proofs, schema, height)
    root = across[-1].first()
    root = F.lit(root["node"] if root else None).cast("string")
    return proofs.select(F.col("id").cast(kind).alias("doc_id"), "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))
