"""SimHash near-dedup with vantage-point trees.

Of fingerprints cut into p parts, two that differ in r bits or fewer differ in at most r // p bits of some part: for r = 2
and halves, in one bit of one half. So there is a tree for each part, over the Hamming distance within it, and a query's
radius there is r // p. A node of a tree splits fingerprints by their distance to a vantage fingerprint; the triangle inequality
says which side a query's ball can reach. Leaves are the shards: each fingerprint has its home leaf and is sent, as a query, to the leaves that its ball overlaps
(those after its home; the other direction finds the same pair). Inside a leaf a smaller tree prunes on, and what it
leaves is compared over all 64 bits, in blocks.

A leaf returns links that connect the same fingerprints as all its pairs do, at most one for each fingerprint. The components
of all leaves' links are found by joins that let every fingerprint point to the smallest it can reach.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from notemill.llm import common as C

SEED, SHINGLE, RADIUS, PARTS = 42, 3, 2, 2
#: Fingerprints in a leaf on average; the sample that trees are cut by (8 bytes each on the driver); a block of comparisons.
LEAF, SAMPLE, BLOCK = 2048, 65_536, 256


def parts_of(n: int) -> list[int]:
    """Masks of n parts of 64 bits."""
    ends = [64 * i // n for i in range(n + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(ends, ends[1:])]


def fingerprint_of(words: list[bytes], shingle: int = SHINGLE) -> list[int]:
    """The hashes of a text's shingles."""
    if not words:
        return []
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    whole, ends, at = b" ".join(words), [], 0
    for w in words:
        at += len(w) + 1
        ends.append(at)
    h = xxhash.xxh64_intdigest
    return [h(whole[a : b - 1], SEED) for a, b in zip([0, *ends], ends[shingle - 1 :])]


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for low in range(0, len(hashes), 1 << 16):
        part = hashes[low : low + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0]) if len(hashes) else 0


def _prints(shingle: int, once: bool):
    def run(batches):
        for batch in batches:
            out = []
            for t in batch.column(2).cast(pa.binary()).to_pylist():
                hashes = fingerprint_of(t.lower().split(), shingle) if t else []
                out.append(majority(np.array(sorted(set(hashes)) if once else hashes, "<u8")))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(out, np.uint64).view(np.int64))], ["_row", "key", "fp"])

    return run


def _far(a: np.ndarray, b, mask: int) -> np.ndarray:
    return np.bitwise_count((a ^ b) & np.uint64(mask)).astype(np.int16)


def plant(sample: np.ndarray, mask: int, leaves: float, seed: int = 7) -> list[tuple]:
    """A tree as nodes (vantage, radius, inner child, outer child); a child below 0 is leaf -1-child. The first node is the root."""
    rng, nodes, n_leaves = np.random.default_rng(seed), [], [0]

    def grow(part: np.ndarray, leaves: float) -> int:
        if leaves > 1 and len(part) >= 16:
            best = None
            for v in rng.choice(part, min(8, len(part)), replace=False):
                d = _far(part, v, mask)
                for r in np.unique(d)[:-1]:
                    inner, border = np.count_nonzero(d <= r), np.count_nonzero((d == r) | (d == r + 1))
                    # rows that both sides get, against how well the halves are shared out
                    cost = (border + len(part) * 0.05) / min(inner, len(part) - inner)
                    if best is None or cost < best[0]:
                        best = cost, v, int(r), d <= r
            if best is not None:
                at, share = len(nodes), np.count_nonzero(best[3]) / len(part)
                nodes.append(None)
                inner = grow(part[best[3]], leaves * share)
                nodes[at] = (int(best[1]), best[2], inner, grow(part[~best[3]], leaves * (1 - share)))
                return at
        n_leaves[0] += 1
        return -n_leaves[0]

    grow(sample, leaves)
    return nodes


def route(nodes: list[tuple], mask: int, points: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(point, leaf) for the leaves that a ball of radius `reach` around each point overlaps; reach 0: its home."""
    if not nodes:
        return np.arange(len(points)), np.zeros(len(points), np.int64)
    found, todo = [], [(0, np.arange(len(points)))]
    while todo:
        node, at = todo.pop()
        if node < 0:
            found.append((at, np.full(len(at), -1 - node)))
        elif len(at):
            vantage, radius, inner, outer = nodes[node]
            d = _far(points[at], np.uint64(vantage), mask)
            todo += [(inner, at[d - reach <= radius]), (outer, at[d + reach > radius])]
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


def placed(nodes: list[tuple], mask: int, points: np.ndarray, reach: int):
    """(point, leaf, at home) of each point's home and of the later leaves that its ball overlaps."""
    p, home = route(nodes, mask, points, 0)
    of = np.empty(len(points), np.int64)
    of[p] = home
    q, leaf = route(nodes, mask, points, reach)
    keep = leaf >= of[q]
    q, leaf = q[keep], leaf[keep]
    return q, leaf, leaf == of[q]


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Adds the links a-b to a forest in which every entry points to the smallest of its set."""
    while len(a):
        a, b = parent[a], parent[b]
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := parent[parent], parent):
            parent[:] = up


def _compare(points: np.ndarray, home: np.ndarray, guest: np.ndarray, parent: np.ndarray, radius: int) -> None:
    """Unites the pairs of home with home and with guest (places in points) within radius bits, over all bits."""
    everyone = np.concatenate([home, guest if len(home) else home])
    for low in range(0, len(everyone), BLOCK):
        some = everyone[low : low + BLOCK]
        mine, theirs = parent[some], parent[home]
        # members of the largest set so far are not compared with one another again: a dense group costs little more than its first block
        large = np.bincount(theirs).argmax()
        for rows, columns in ((some[mine == large], home[theirs != large]), (some[mine != large], home)):
            i, j = np.nonzero(np.bitwise_count(points[rows][:, None] ^ points[columns][None, :]) <= radius)
            unite(parent, rows[i], columns[j])


def leaf_links(points: np.ndarray, home: np.ndarray, mask: int, radius: int = RADIUS, parts: int = PARTS) -> np.ndarray:
    """For each point of a leaf the smallest place that its links reach; points may be in any number."""
    parent = np.arange(len(points))
    inside, outside = np.flatnonzero(home), np.flatnonzero(~home)
    nodes = plant(points[inside][:: max(1, len(inside) // SAMPLE)], mask, len(inside) / LEAF, 11) if len(inside) > 2 * LEAF else []
    if not nodes:
        _compare(points, inside, outside, parent, radius)
        return parent
    p, leaf, own = placed(nodes, mask, points[inside], radius // parts)
    g, gleaf = route(nodes, mask, points[outside], radius // parts)
    order, gorder = np.argsort(leaf, kind="stable"), np.argsort(gleaf, kind="stable")
    for k in np.unique(leaf):
        a, b = np.searchsorted(leaf[order], [k, k + 1])
        c, d = np.searchsorted(gleaf[gorder], [k, k + 1])
        some = order[a:b]
        _compare(points, inside[p[some[own[some]]]], np.concatenate([inside[p[some[~own[some]]]], outside[g[gorder[c:d]]]]), parent, radius)
    return parent


def fingerprints(docs: DataFrame, key: str, text: str, shingle: int = SHINGLE, once: bool = False) -> DataFrame:
    """_row, key, fp (as a signed number) of each row."""
    kind = docs.schema[key].dataType.simpleString()
    rows = C.with_row(docs.select(F.col(key).alias("key"), F.col(text).alias("text"))).select("_row", "key", "text")
    return rows.mapInArrow(_prints(shingle, once), f"_row bigint, key {kind}, fp bigint")


def links(prints: DataFrame, radius: int = RADIUS, parts: int = PARTS) -> DataFrame:
    """Links (a, b) with a > b among the distinct fingerprints of column fp; they connect what all pairs within radius connect."""
    spark, masks, reach = prints.sparkSession, parts_of(parts), radius // parts
    n = prints.count()
    leaves = max(1.0, n / LEAF)
    # the sample: those with the smallest hashes, so the same ones whenever it is taken again
    sample = [r[0] for r in prints.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(min(SAMPLE, int(32 * leaves) + 1)).collect()] if leaves > 1 else []
    sample = np.array(sample, np.int64).view(np.uint64)
    trees = spark.sparkContext.broadcast([plant(sample, mask, leaves, seed) for seed, mask in enumerate(masks)])

    def send(batches):
        for batch in batches:
            points = batch.column(0).to_numpy().view(np.uint64)
            for t, mask in enumerate(masks):
                p, leaf, own = placed(trees.value[t], mask, points, reach)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), t, np.int32)), pa.array(leaf, pa.int64()), pa.array(points[p].view(np.int64)), pa.array(own)], ["tree", "leaf", "fp", "home"])

    def solve(group: pa.Table) -> pa.Table:
        points = group.column("fp").to_numpy().view(np.uint64)
        order = np.argsort(points.view(np.int64), kind="stable")
        points = points[order]
        parent = leaf_links(points, group.column("home").to_numpy()[order], masks[group.column("tree")[0].as_py()], radius, parts)
        some = np.flatnonzero(parent != np.arange(len(parent)))
        signed = points.view(np.int64)
        return pa.table({"a": signed[some], "b": signed[parent[some]]})

    sent = prints.select("fp").mapInArrow(send, "tree int, leaf bigint, fp bigint, home boolean")
    return sent.groupBy("tree", "leaf").applyInArrow(solve, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node that node reaches. edges: a, b with a > b. Rounds of joins; each round's links are written."""
    edges = C.written(edges.distinct(), "links")
    before = None
    while True:
        # large star: a node's larger neighbours move to its smallest
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        # small star: a node and its smaller neighbours move to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = C.written(moved.union(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, once: bool = False, radius: int = RADIUS, parts: int = PARTS) -> DataFrame:
    """Per row of docs: _row, key, fingerprint (16 hex digits), component_id (smallest key that links reach), group_row (the row that stands for the component).

    Words: A-Z lower-cased, cut at ASCII white space; shingles of `shingle` words, repeats included unless `once`, a shorter text whole.
    Links: fingerprints that differ in `radius` bits or fewer. Null and
    empty texts have fingerprint zero and link to each other like any other. Repeated rows and keys count singly; null keys are never
    the smallest unless all are null. Rows with equal fingerprints are one point, so copies cost nothing.
    """
    rows = C.written(fingerprints(docs, key, text, shingle, once), "prints")
    points = C.written(rows.groupBy("fp").agg(F.min(F.struct(F.col("key").isNull().alias("none"), "key", "_row")).alias("best")), "points")
    roots = components(links(points, radius, parts))
    named = points.join(roots, points.fp == roots.node, "left").select("fp", "best", F.coalesce("root", "fp").alias("root"))
    smallest = named.groupBy("root").agg(F.min("best").alias("best"))
    of = named.select("fp", "root").join(smallest, "root").select("fp", F.col("best.key").alias("component_id"), F.col("best._row").alias("group_row"))
    return rows.join(of, "fp").select("_row", F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "group_row")


#: What a near copy is: the share of 5-word shingles that two texts have in common.
COPY_WORDS, COPY_SHARE = 5, 0.8
#: Rows and shingles of a block on average: what one task compares at once, in about 100 bytes a shingle.
COPY_ROWS, COPY_GRAMS = 4096, 1 << 20
#: Rows whose shingles say on average which ones are frequent, and how many of those are kept. They give the order of shingles only, never the result.
OFTEN_ROWS, OFTEN = 8192, 1 << 17


def shingle_sets(column: pa.Array):
    """(first row, last row + 1, owner, gram) for runs of texts: each text's distinct shingle hashes in order; a shorter text is one shingle, one without words has none."""
    for low, high, data, offsets in C.text_chunks(column, C.CHUNK_BYTES // 4):
        words = C.Words(data, offsets, solid=True)
        hashes, first, counts = words.hashes(), words.first, words.counts
        grams = C.gram_hashes(hashes, COPY_WORDS)
        owner = np.repeat(np.arange(high - low), counts)
        whole = np.flatnonzero(owner[: len(grams)] == owner[COPY_WORDS - 1 :][: len(grams)]) if len(grams) else np.zeros(0, np.int64)
        short = np.flatnonzero((counts > 0) & (counts < COPY_WORDS))
        less = [C.gram_hashes(hashes[first[i] : first[i + 1]], int(counts[i])) for i in short]
        owner = np.concatenate([owner[whole], short])
        gram = np.concatenate([grams[whole], *less]).view(np.int64)
        order = np.lexsort((gram, owner))
        owner, gram = owner[order], gram[order]
        new = np.ones(len(gram), bool)
        new[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
        yield low, high, owner[new], gram[new]


def _ends(owner: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)


def _shingle_sets(batches):
    """Puts the shingles in the place of the text, the last column."""
    for batch in batches:
        *others, texts = batch.columns
        for low, high, owner, gram in shingle_sets(texts):
            lists = pa.ListArray.from_arrays(pa.array(_ends(owner, high - low)), pa.array(gram))
            yield pa.RecordBatch.from_arrays([*(c.slice(low, high - low) for c in others), lists], [*batch.schema.names[:-1], "grams"])


def _need(x: np.ndarray) -> np.ndarray:
    return np.ceil(x - 1e-9).astype(np.int64)


def _first_shingles(often):
    """A row's first shingles in the order (frequency in the sample, hash); a row without any counts as having shingle 0."""

    def run(batches):
        known, counts = often.value
        for batch in batches:
            for low, high, owner, gram in shingle_sets(batch.column(2)):
                size = np.bincount(owner, minlength=high - low)
                if len(known):
                    at = np.minimum(np.searchsorted(known, gram), len(known) - 1)
                    order = np.lexsort((gram, np.where(known[at] == gram, counts[at], 0), owner))
                    owner, gram = owner[order], gram[order]
                place = np.arange(len(owner)) - _ends(owner, high - low)[:-1][owner]
                first = place < (size - _need(COPY_SHARE * size) + 1)[owner]
                none = np.flatnonzero(size == 0)
                owner, gram = np.concatenate([owner[first], none]), np.concatenate([gram[first], np.zeros(len(none), np.int64)])
                order = np.argsort(owner, kind="stable")
                lists = pa.ListArray.from_arrays(pa.array(_ends(owner[order], high - low)), pa.array(gram[order]))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(low, high - low) for i in (0, 1)), pa.array(size, pa.int64()), lists], ["_row", "_key", "n", "grams"])

    return run


def _often(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles of a sample of rows, sorted, and their counts there."""
    share = min(1.0, OFTEN_ROWS / max(1, rows.count()))
    some = rows.where(F.pmod(F.xxhash64("_key"), F.lit(1 << 30)) < int(share * (1 << 30))).select(F.lit(0).cast("bigint").alias("_row"), "text")
    found = some.mapInArrow(_shingle_sets, "_row bigint, grams array<bigint>").select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("rows"))
    top = found.where("rows > 2").orderBy(F.desc("rows"), "gram").limit(OFTEN).toArrow()
    grams, counts = top.column("gram").to_numpy(), top.column("rows").to_numpy()
    order = np.argsort(grams)
    return grams[order], counts[order]


def _met(batches):
    """Of entries in order of bucket: those whose bucket another row has as well, each with the bucket's first row and the one before it. Only a bucket's first entry is held back."""
    first = held = late = None  # the first entry of the bucket at hand, the same while no other has come, and the last one
    for batch in batches:
        bucket, entry = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(bucket):
            continue
        if held is not None:
            bucket, entry = np.concatenate([[held[0]], bucket]), np.concatenate([[held[1]], entry])
        start = np.ones(len(bucket), bool)
        start[1:] = bucket[1:] != bucket[:-1]
        goes_on = held is None and first is not None and bucket[0] == first[0]
        begin = np.flatnonzero(start)
        run = np.cumsum(start) - 1
        head = entry[begin][run]
        if goes_on:
            head[run == 0] = first[1]
        size = np.diff(np.append(begin, len(bucket)))
        before = np.where(start, entry, np.roll(entry, 1))
        if goes_on:
            before[0] = late
        late = entry[-1]
        keep = size[run] > 1
        if goes_on:
            keep[run == 0] = True
        last = begin[-1]
        alone = size[-1] == 1 and not (goes_on and len(begin) == 1)
        first = (bucket[last], head[last])
        held = first if alone else None
        yield pa.RecordBatch.from_arrays([pa.array(bucket[keep]), pa.array(entry[keep] >> 1), pa.array((entry[keep] & 1) == 1), pa.array(head[keep] >> 1), pa.array(before[keep] >> 1)], ["bucket", "_row", "lead", "head", "before"])


def _could(common, n, m) -> Column:
    """Whether texts of n and m shingles, of which the first ones have `common` in common, can share COPY_SHARE.

    Of the one whose first shingles end earlier in the order, all the others are ceil(COPY_SHARE * n) - 1.
    """
    need = lambda x: F.ceil(x - 1e-6)
    near = F.least(n, m) >= COPY_SHARE * F.greatest(n, m) - 1e-6
    return near & (common + need(COPY_SHARE * F.greatest(n, m)) - 1 >= need(COPY_SHARE / (1 + COPY_SHARE) * (n + m)))


def linked(sizes: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """For each of some rows (their shingle sets one after the other) the smallest row that it is linked to, over others too."""
    n = len(sizes)
    order = np.argsort(grams, kind="stable")
    gram = grams[order]
    new = np.ones(len(gram), bool)
    new[1:] = gram[1:] != gram[:-1]
    begin = np.flatnonzero(new).astype(np.int32)  # of each shingle's run of rows
    run = np.cumsum(new, dtype=np.int32) - 1
    at = np.repeat(np.arange(n, dtype=np.int32), sizes)[order]
    of = np.empty(len(order), np.int32)
    of[order] = run
    del gram, new, run, order
    length_of = np.diff(np.append(begin, len(at))).astype(np.int32)
    ends, root = np.concatenate([[0], np.cumsum(sizes)]), np.full(n, -1)
    for seed in range(n):
        if root[seed] >= 0:
            continue
        root[seed], todo = seed, [seed]
        while todo:
            i = todo.pop()
            mine = of[ends[i] : ends[i + 1]]
            mine = mine[length_of[mine] > 1]
            low, length = begin[mine], length_of[mine]
            places = np.repeat(low - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum()) if len(length) else np.zeros(0, np.int64)
            common = np.bincount(at[places], minlength=n)
            alike = np.flatnonzero((common >= COPY_SHARE * (sizes[i] + sizes - common) - 1e-9) & (root < 0))
            root[alike] = seed
            todo += alike.tolist()
    return root


def _links(group: pa.Table) -> pa.Table:
    """(a, b): the rows of a block and the smallest that each is tied to."""
    group = group.combine_chunks().sort_by([("none", "ascending"), ("key", "ascending"), ("file", "ascending"), ("at", "ascending")])
    lists = group.column("grams").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    root = linked(lists.value_lengths().to_numpy().astype(np.int64), lists.flatten().to_numpy())
    some = pa.array(np.flatnonzero(root != np.arange(len(root))))
    row = group.column("_row")
    return pa.table({"a": row.take(some), "b": row.take(pa.array(root).take(some))})


def _settled(live: DataFrame, shingled) -> tuple[DataFrame, DataFrame]:
    """(links a, b within families; _row, cell of each row). live: _row, family, n and the parts of the key. shingled: adds the shingles to rows by file and at.

    A family is cut into blocks of bounded size, each compared whole; the first row of each group found there stands for it and is dealt to new
    blocks, until a family is one block or hardly any groups meet any more. Of rows with equal cells all links, or some that tie the same rows together, are known:
    a cell is a family that was one block from the start, else a group.
    """
    links = cells = None
    level = 0
    while True:
        sizes = live.groupBy("family").agg(F.count("*").alias("rows"), F.sum("n").alias("grams"))
        blocks = F.ceil(F.greatest(F.col("rows") / COPY_ROWS, F.col("grams") / COPY_GRAMS)).cast("bigint")
        sizes = C.written(sizes.select("family", "rows", F.greatest(blocks, F.lit(1)).alias("blocks")), "families")
        dealt = C.written(live.join(sizes, "family").withColumn("block", F.pmod(F.xxhash64("_row", F.lit(level)), "blocks")), "blocks")
        # a row's place in a block goes with it to its text, so that shingles are shuffled once, to their block
        some = shingled(dealt.where("rows > 1").select("family", "block", "_row", "none", "key", "file", "at"))
        found = C.written(some.groupBy("family", "block").applyInArrow(_links, "a bigint, b bigint"), "copies")
        links = found if links is None else links.union(found)
        if cells is None:
            cells = dealt.select("_row", F.when(F.col("blocks") == 1, F.col("family")).alias("cell"))
        large = dealt.where("blocks > 1")
        before = large.count()
        rest = C.written(large.join(found.select(F.col("a").alias("_row")), "_row", "left_anti").drop("rows", "blocks", "block"), "live")
        # when this stops is a matter of work only: groups that have not met yet are compared through their buckets
        if not before or rest.count() > 0.95 * before:
            break
        live, level = rest, level + 1
    groups = components(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))).toDF("_row", "root")
    cells = cells.join(groups, "_row", "left").select("_row", F.coalesce("cell", "root", "_row").alias("cell"))
    return links, C.written(cells, "cells")


def near_copies(keys: C.Keyed) -> DataFrame:
    """_key of the rows of common.Keyed that are near copies, by a chain of links, of a smaller row that stays.

    Two texts are linked if they share COPY_SHARE of their distinct 5-word shingles (words: A-Z lower-cased, cut at ASCII white space; a
    shorter text is one shingle; texts without words, null and empty ones too, are linked to each other only). Of the rows that links
    connect the smallest stays, whatever the size of a group: COPY_ROWS and COPY_GRAMS change the work, not the result. Very long texts are taken whole.
    Rows are ordered by key, null keys last, repeated rows by their place; each is judged by itself. An empty table gives no rows.

    Candidates: rows that could be linked have a shingle in common among the first of each, in any one order for all rows; frequent ones
    come last. A bucket holds the rows with a shingle among their first. Families are what the fingerprint trees and, within buckets, each row with the first and the one before it
    tie together, if they have a quarter of what they need in common there; they are compared in whole blocks, so that only pairs
    of different families, or of different groups of a family of several blocks, are made from the buckets. What is written on the way is removed at the end.
    """
    with C.scratch(keys.rows.sparkSession) as keep:
        return keep(_near_copies(keys), "copies")


def _near_copies(keys: C.Keyed) -> DataFrame:
    rows, spark = keys.rows, keys.rows.sparkSession
    kind = rows.schema["_key"].dataType.simpleString()
    often = spark.sparkContext.broadcast(_often(rows))
    firsts = C.with_row(rows.select("_key", "text")).select("_row", "_key", "text").mapInArrow(_first_shingles(often), f"_row bigint, _key {kind}, n bigint, grams array<bigint>")
    firsts = C.written(firsts, "firsts")
    # of two linked texts the smaller has the bucket among still fewer first ones
    lead = F.col("place") < F.col("n") - F.ceil(2 * COPY_SHARE / (1 + COPY_SHARE) * F.col("n") - 1e-6) + 1
    each = firsts.select("_row", "n", F.posexplode("grams").alias("place", "bucket")).select("bucket", (F.col("_row") * 2 + F.when(lead, 1).otherwise(0)).alias("entry"))
    each = each.repartition("bucket").sortWithinPartitions("bucket", "entry").mapInArrow(_met, "bucket bigint, _row bigint, lead boolean, head bigint, before bigint")
    entries = C.written(each, "buckets")
    places = lambda df: df.withColumns({"file": F.col("_key.file"), "at": F.col("_key.at")})
    size = lambda name, row: firsts.select(F.col("_row").alias(row), F.col("n").alias(name))

    def shingled(ids: DataFrame) -> DataFrame:
        """ids, read from files, with the grams of the texts at their file and at; only these texts are cut, and hardly any others are shuffled."""
        texts = C.sieved(places(rows.select("_key", "text")), ids, ["file", "at"]).where("_maybe").select("file", "at", "text")
        schema = StructType(list(ids.schema.fields)).add("grams", ArrayType(LongType()))
        return ids.join(texts, ["file", "at"]).select(*ids.columns, "text").mapInArrow(_shingle_sets, schema)

    # families
    head = entries.select("_row", F.explode(F.array_distinct(F.array("head", "before"))).alias("head")).where("_row <> head").groupBy("_row", "head").agg(F.count("*").alias("common"))
    head = head.join(size("n", "_row"), "_row").join(size("m", "head"), "head").where(_could(F.col("common") * 4, F.col("n"), F.col("m")))
    near = near_dedup(rows, "_key", "text", shingle=1, once=True).where("_key <> component_id").select("_key", "component_id")
    here = C.written(places(firsts).select("_row", "file", "at"), "places")
    near = near.select(F.col("_key.file").alias("file"), F.col("_key.at").alias("at"), F.col("component_id.file").alias("file2"), F.col("component_id.at").alias("at2")).join(here, ["file", "at"])
    near = near.join(here.toDF("_row2", "file2", "at2"), ["file2", "at2"])
    edges = head.select("_row", "head").union(near.select("_row", "_row2")).select(F.greatest("_row", "head").alias("a"), F.least("_row", "head").alias("b"))
    roots = components(edges)
    family = C.written(roots.union(roots.select("root", "root").distinct()).toDF("_row", "family"), "family")
    live = firsts.select("_row", "n", F.col("_key.none").alias("none"), F.col("_key.key").alias("key"), F.col("_key.file").alias("file"), F.col("_key.at").alias("at")).join(family, "_row")
    links, cells = _settled(C.written(live, "live"), shingled)

    # pairs of rows that were not compared yet; a row without a family is its own
    rest = entries.select("bucket", "_row", "lead").join(cells, "_row", "left").withColumn("cell", F.coalesce("cell", "_row"))
    mixed = rest.groupBy("bucket").agg(((F.min("cell") != F.max("cell")) & F.max("lead")).alias("mixed")).where("mixed").select("bucket")
    rest = C.written(rest.join(mixed, "bucket").join(size("n", "_row"), "_row"), "rest")
    other = rest.select("bucket", F.col("_row").alias("other"), F.col("n").alias("m"), F.col("cell").alias("cell2"))
    pairs = rest.where("lead").join(other, "bucket").where("cell <> cell2 and n <= m").where(F.col("n") >= COPY_SHARE * F.col("m") - 1e-6)
    pairs = C.written(pairs.select(F.least("_row", "other").alias("x"), F.greatest("_row", "other").alias("y")).distinct(), "pairs")
    ids = lambda: C.written(pairs.select(F.explode(F.array("x", "y")).alias("_row")).distinct(), "ids")
    of = lambda df, name: df.select(F.col("_row").alias(name), F.col("grams").alias(f"g{name}"), *([F.col("n").alias(f"n{name}")] if "n" in df.columns else []))
    common = F.size(F.array_intersect("gx", "gy"))
    # what first shingles two rows have in common, both have among those that other rows have too
    some = entries.select("_row", "bucket").join(ids(), "_row", "left_semi").groupBy("_row").agg(F.collect_list("bucket").alias("grams"))
    some = C.written(some.join(size("n", "_row"), "_row"), "some")
    pairs = C.written(pairs.join(of(some, "x"), "x").join(of(some, "y"), "y").where(_could(common, F.col("nx"), F.col("ny"))).select("x", "y"), "pairs")
    named = C.written(places(firsts.select("_row", "_key").join(ids(), "_row", "left_semi")).select("_row", "file", "at"), "sets-rows")
    sets = C.written(shingled(named).select("_row", "grams"), "sets")
    pairs = pairs.join(of(sets, "x"), "x").join(of(sets, "y"), "y")
    across = pairs.where(common >= COPY_SHARE * (F.size("gx") + F.size("gy") - common) - 1e-9).select("y", "x")
    groups = components(links.union(across).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    groups = C.written(groups.union(groups.select("root", "root").distinct()).toDF("_row", "root").join(firsts.select("_row", "_key"), "_row"), "groups")
    least = groups.groupBy("root").agg(F.min("_key").alias("least"))
    return groups.join(least, "root").where("_key <> least").select("_key")
