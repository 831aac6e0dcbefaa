"""Merkle manifest of a dataset: a tree of arity 16 for each source, and one over the sources.

Leaves are hashed in the JVM, sorted once by (source, key) and numbered by counts of the sorted partitions, so no source is ever in
one task. Aligned blocks of 16^3 leaves are dealt to tasks. A task goes through its blocks leaf by leaf with a fractal traversal: for each
level it holds the run of siblings that the current path needs (existing) and builds the next run (desired) a few hashes at a time, and so
emits successive authentication paths while holding one block's digests at most. The roots of blocks are nodes of the next trees, for which the
same is done, until each source has one node; then once more over the sources. What the upper trees give is one path a block, which is put before its leaves.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notemill.llm import common as C

ARITY, HEIGHT = 16, 3
#: Rows of offsets (one for each sorted partition and source in it) that are broadcast; beyond it they are joined by a shuffle.
SMALL = 50_000
PATH = "array<struct<at:int,run:array<string>>>"


def digest(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


class Traversal:
    """Authentication paths of successive leaves.

    leaves: a block's digests. height: levels up to its root. Runs of level 0 are slices of leaves; those above are computed, and of each
    level only the run in use (existing) and a part of the next one (desired) are held. A path is a list of (place in the run, run).
    """

    def __init__(self, leaves: list[str], height: int, arity: int = ARITY):
        self.leaves, self.height, self.arity = leaves, height, arity
        self.counts = [len(leaves)]
        for _ in range(height):
            self.counts.append(-(-self.counts[-1] // arity))
        self.most = 0
        self.existing = [self._run(level, 0) for level in range(height)]
        self.desired: list[list[str]] = [[] for _ in range(height)]
        self.root = self._node(height, 0)

    def _node(self, level: int, at: int) -> str:
        """A node from the leaves below it, at most one run of each level at a time."""
        if not level:
            return self.leaves[at]
        return digest([self._node(level - 1, i) for i in range(at * self.arity, min((at + 1) * self.arity, self.counts[level - 1]))])

    def _run(self, level: int, run: int) -> list[str]:
        low = run * self.arity
        return [self._node(level, i) for i in range(low, min(low + self.arity, self.counts[level]))]

    def __iter__(self):
        for leaf in range(len(self.leaves)):
            at, path = leaf, []
            for level in range(self.height):
                run, place = divmod(at, self.arity)
                path.append((place, self.existing[level]))
                at = run
            yield path
            self.most = max(self.most, sum(map(len, self.existing)) + sum(map(len, self.desired)))
            self._advance(leaf)

    def _advance(self, leaf: int) -> None:
        """After a leaf: each level's next run grows by the node that is due by now; a run that its path leaves is exchanged for the next one."""
        span = 1
        for level in range(self.height):
            span *= self.arity  # leaves below a run of this level
            run, inside = divmod(leaf, span)
            first, desired = (run + 1) * self.arity, self.desired[level]
            due = min(-(-self.arity * (inside + 1) // span), self.counts[level] - first)
            while len(desired) < due:
                desired.append(self._node(level, first + len(desired)))
            if inside == span - 1:
                self.existing[level], self.desired[level] = desired, []


def folded(leaf: str, path: list[tuple[int, list[str]]]) -> str:
    """The root that a leaf and its siblings give."""
    for place, run in path:
        leaf = digest([*run[:place], leaf, *run[place + 1 :]])
    return leaf


def siblings(path: list[tuple[int, list[str]]]) -> list[str]:
    return [d for place, run in path for i, d in enumerate(run) if i != place]


def height(n: int) -> int:
    """Levels of a tree of n leaves, at most those of a block."""
    levels = 0
    while n > 1 and levels < HEIGHT:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def numbered(rows: DataFrame, group: list[str], order: list[str], tag: str) -> DataFrame:
    """rows with pos (from 0, by order within group) and n (rows of the group), without bringing a group together."""
    ranged = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    held = C.written(ranged.withColumn("_at", F.monotonically_increasing_id()), tag).withColumn("_part", F.shiftright("_at", 33))
    counts = held.groupBy("_part", *group).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    upto = Window.partitionBy(*group).orderBy("_part")
    whole = Window.partitionBy(*group)
    offsets = C.written(counts.select("_part", *group, (F.sum("_n").over(upto) - F.col("_n") - F.col("_first")).alias("_shift"), F.sum("_n").over(whole).alias("n")), f"{tag}-offsets")
    if offsets.count() <= SMALL:
        offsets = F.broadcast(offsets)
    same = [held._part == offsets._part, *[held[g].eqNullSafe(offsets[g]) for g in group]]
    return held.join(offsets, same).select(*[held[c] for c in rows.columns], (F.col("_at") + F.col("_shift")).alias("pos"), "n")


def in_blocks(nodes: DataFrame, head: DataFrame | None = None) -> DataFrame:
    """nodes by (source, block) in order of pos, each block in one piece; a row of head, with the path above a block, stands before its nodes (pos -1)."""
    block = nodes.withColumn("block", F.expr(f"pos div {ARITY**HEIGHT}"))
    if head is not None:
        block = block.withColumn("above", F.lit(None).cast(PATH)).unionByName(head.withColumns({"pos": F.lit(-1).cast("bigint"), "n": F.lit(0).cast("bigint")}), allowMissingColumns=True)
    return block.repartition("source", "block").sortWithinPartitions("source", "block", "pos")


def _blocks(batches, columns: list[str]):
    """Lists of rows (as dicts) of one block after the other."""
    at, held = None, []
    for batch in batches:
        for row in batch.select(columns).to_pylist():
            if (here := (row["source"], row["block"])) != at:
                if held:
                    yield held
                at, held = here, []
            held.append(row)
    if held:
        yield held


def _paths(batches):
    """Each node's path in its block, and for pos 0 of a block its root too."""
    schema = pa.schema([("source", pa.string()), ("block", pa.int64()), ("pos", pa.int64()), ("root", pa.string()), ("path", pa.list_(pa.struct([("at", pa.int32()), ("run", pa.list_(pa.string()))])))])
    for rows in _blocks(batches, ["source", "block", "pos", "n", "digest"]):
        walk = Traversal([r["digest"] for r in rows], height(rows[0]["n"]))
        out = []
        for r, path in zip(rows, walk):
            out.append({"source": r["source"], "block": r["block"], "pos": r["pos"], "root": walk.root, "path": [{"at": a, "run": run} for a, run in path]})
            if len(out) == 256:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)


def _roots(batches):
    schema = pa.schema([("source", pa.string()), ("pos", pa.int64()), ("digest", pa.string())])
    for rows in _blocks(batches, ["source", "block", "n", "digest"]):
        root = Traversal([r["digest"] for r in rows], height(rows[0]["n"])).root
        yield pa.RecordBatch.from_pylist([{"source": rows[0]["source"], "pos": rows[0]["block"], "digest": root}], schema=schema)


def block_roots(nodes: DataFrame, tag: str) -> DataFrame:
    """(source, pos, digest, n) of the blocks of nodes, as nodes of the next tree."""
    roots = in_blocks(nodes.select("source", "pos", "n", "digest")).mapInArrow(_roots, "source string, pos bigint, digest string")
    counts = nodes.where("pos = 0").select(F.col("source").alias("_s"), F.expr(f"(n + {ARITY**HEIGHT - 1}) div {ARITY**HEIGHT}").alias("n"))
    roots = C.written(roots, tag)
    return roots.join(counts, roots.source.eqNullSafe(F.col("_s"))).drop("_s")


def above(nodes: DataFrame, tag: str) -> DataFrame:
    """(source, pos, path, top): each node's path to the one node that its source ends in, and that node's digest."""
    nodes = nodes.select("source", "pos", "n", "digest")
    paths = C.written(in_blocks(nodes).mapInArrow(_paths, f"source string, block bigint, pos bigint, root string, path {PATH}"), f"{tag}-paths")
    if (nodes.agg(F.max("n")).first()[0] or 0) <= ARITY**HEIGHT:
        return paths.select("source", "pos", "path", F.col("root").alias("top"))
    upper = above(C.written(block_roots(nodes, f"{tag}-roots"), f"{tag}-nodes"), f"{tag}-up").select(F.col("source").alias("_s"), F.col("pos").alias("_b"), F.col("path").alias("_p"), "top")
    return paths.join(upper, paths.source.eqNullSafe(F.col("_s")) & (paths.block == F.col("_b"))).select("source", "pos", F.concat("path", "_p").alias("path"), "top")


def _proofs(key: str):
    def run(batches):
        for rows in _blocks(batches, ["source", "block", "pos", "n", "key", "digest", "tampered", "subroot", "root", "above"]):
            head, leaves = rows[0], rows[1:]
            upper = [(p["at"], p["run"]) for p in head["above"]]
            rest = siblings(upper)
            walk, out = Traversal([r["digest"] for r in leaves], height(leaves[0]["n"])), []
            for r, path in zip(leaves, walk):
                root = folded(r["tampered"] or r["digest"], [*path, *upper])
                out.append((r["key"], r["source"], r["digest"], head["subroot"], head["root"], digest([*siblings(path), *rest]), root, root == head["root"]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), *[pa.string()] * 6, pa.bool_()])], [key, "source", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return run


def leaf(*fields: Column) -> Column:
    """SHA-256 of the fields, each as its UTF-8 byte count, a colon and its value; null as a dash."""
    told = [F.when(f.isNull(), "-").otherwise(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string"))) for f in fields]
    return F.sha2(F.concat(*told).cast("binary"), 256)


def manifest(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), tampered: Column | None = None, changed: Column | None = None) -> DataFrame:
    """Per row of docs: key, source, leaf, subroot (of its source), root, proof_sha256, folded_root, verified.

    A leaf is the hash of `fields`. Leaves of a source ascend by key, null keys first; repeated keys by leaf, equal rows in any order. Sources
    ascend bytewise, null (a source like any other) first. While a tree has several nodes, every 16 consecutive ones become their hash; a lone leaf is its source's subroot. proof_sha256 is the
    hash of the siblings from leaf to root. Rows for which `changed` holds (null: not) are folded with `tampered` in place of their text. Null fields count as a dash;
    texts of any length are hashed whole; columns of other names are ignored; an empty table gives no rows. key is an integer.
    """
    name = lambda f: F.col(f"`{f}`")
    rows = docs.select(name(source).cast("string").alias("source"), name(key).cast("bigint").alias("key"), leaf(*[name(f) for f in fields]).alias("digest"),
                       *([F.when(changed, leaf(*[tampered if f == text else name(f) for f in fields])).alias("tampered")] if changed is not None else [F.lit(None).cast("string").alias("tampered")]))
    # written, so that what ranges are cut by isn't hashed twice; _row parts equal rows
    leaves = numbered(C.written(C.with_row(rows), "leaves"), ["source"], ["key", "digest", "_row"], "sorted").drop("_row")
    blocks = C.written(block_roots(leaves, "roots"), "block-nodes")
    paths = C.written(above(blocks, "upper"), "upper")
    subroots = paths.where("pos = 0").select(F.lit("").alias("all"), "source", F.col("top").alias("subroot"))
    tops = C.written(numbered(subroots, ["all"], ["source"], "sources"), "subroots")
    over = above(tops.select(F.col("all").alias("source"), "pos", "n", F.col("subroot").alias("digest")), "over").select(F.col("pos").alias("_pos"), F.col("path").alias("_over"), F.col("top").alias("root"))
    tops = tops.join(over, tops.pos == F.col("_pos")).select(F.col("source").alias("_s"), "subroot", "root", "_over")
    head = paths.join(tops, paths.source.eqNullSafe(F.col("_s"))).select("source", F.col("pos").alias("block"), F.concat("path", "_over").alias("above"), "subroot", "root")
    done = in_blocks(leaves, C.written(head, "heads")).select("source", "block", "pos", "n", "key", "digest", "tampered", "subroot", "root", "above")
    return done.mapInArrow(_proofs(key), f"{key} bigint, source string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
