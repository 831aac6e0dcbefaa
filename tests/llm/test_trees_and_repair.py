"""Nearest neighbours, Merkle manifests and conversation repair against brute force, on awkward rows too."""

import hashlib
import itertools
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from notemill.llm import merkle, neighbours, oracles, queries, repair

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11 ---------------------------------------------------------------------------------------------------------------
def _nearest(rows, k=5, by=50):
    """By comparing every pair."""
    fine = [(i, v, np.array(e, float)) for i, (v, e) in enumerate(rows) if e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    out = []
    for i, v, a in fine:
        if v is None or v % by:
            continue
        found = sorted(((-(a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())), w is None, w or 0) for j, w, b in fine if j != i and len(a) == len(b)))
        out += [(v, r + 1, None if none else w, round(-s, 9)) for r, (s, none, w) in enumerate(found[:k])]
    return sorted(out, key=repr)


def _vectors(spark, rows):
    df = spark.createDataFrame([(v, None if e is None else [None if x is None else float(x) for x in e]) for v, e in rows], "vec_id bigint, embedding array<double>")
    return df.select("*", F.lit(1).alias("_row"), F.lit(2).alias("score"), F.lit(3).alias("shard"))


def _told(df):
    return sorted(((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in df.collect()), key=repr)


@pytest.mark.parametrize("shard_rows", [7, 100_000])
def test_nearest_on_awkward_rows(spark, shard_rows):
    rng = np.random.default_rng(1)
    rows = [(i, list(rng.normal(size=4))) for i in range(60)] + [(100, [1, 2, 3, 4])] * 2 + [(i, [1, 2, 3, 4]) for i in range(101, 120)] + [(i, [2, 4, 6, 8]) for i in range(140, 155)]
    rows += [(150, None), (200, []), (250, [0, 0, 0, 0]), (300, [1, None, 2, 3]), (350, [float("nan"), 1, 1, 1]), (400, [float("inf"), 1, 1, 1]), (None, [1, 2, 3, 4]), (450, [1, 0]), (451, [1, 1]), (500, [1, 1, 1]), (550, [1e200, 0, 0, 1e200]), (600, [1e-200, 0, 0, 1e-200])]
    got = _told(neighbours.nearest(_vectors(spark, rows), shard_rows=shard_rows))
    # squares over and under the range of doubles: scaled by a power of two for the comparison
    want = _nearest([(v, e if e is None else [None if x is None else x * (2.0**-660 if v == 550 else 2.0**660 if v == 600 else 1) for x in e]) for v, e in rows])
    assert got == want


def test_nearest_ties_take_the_smaller_id(spark):
    rows = [(i, [1, i % 3, 0]) for i in range(300)]
    assert _told(neighbours.nearest(_vectors(spark, rows), shard_rows=64)) == _nearest(rows)


def test_nearest_of_nothing(spark):
    assert neighbours.nearest(_vectors(spark, []).limit(0)).collect() == []
    assert neighbours.nearest(_vectors(spark, [(0, [1, 2])])).collect() == []


def test_tree_prunes_and_factor_one_is_exact():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    v = centres[rng.integers(0, 40, 6000)] + rng.normal(scale=0.05, size=(6000, 16))
    n, asks = np.arange(6000), np.arange(0, 6000, 50)
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    want = np.argsort(-(unit[asks] @ unit.T - 3 * (asks[:, None] == n)), axis=1)[:, :5]
    compared = []
    for factor, least in ((1.0, 1.0), (3.0, 0.9)):
        shard = neighbours.Shard(v, n, n, np.zeros(6000, bool), 5, leaf=64)
        q, place, _ = shard.search(v[asks], asks, factor)
        found = [set(shard.ids[place[q == i]]) for i in range(len(asks))]
        recall = np.mean([len(f & set(w)) / 5 for f, w in zip(found, want)])
        assert recall >= least
        compared.append(shard.compared / len(asks) / 6000)
    assert compared[1] <= compared[0] < 0.2


def test_op11_is_the_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = sorted((q, r, v, round(s, 9)) for q, r, v, s in con.sql(f"select query_id, rank, vec_id, score from ({oracles.ORACLES['op11_neighbours']})").fetchall())
    assert want and _told(queries.op11_neighbours(spark, SF)) == sorted(want, key=repr)


# 12 ---------------------------------------------------------------------------------------------------------------
def _levels(nodes, arity):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + arity])) for i in range(0, len(out[-1]), arity)])
    return out


def _proof(levels, at, arity):
    path = []
    for level in levels[:-1]:
        run, place = divmod(at, arity)
        path.append((place, level[run * arity : run * arity + arity]))
        at = run
    return path


@pytest.mark.parametrize("arity,n", [(2, 1), (2, 2), (2, 7), (2, 8), (3, 10), (3, 27), (16, 15), (16, 16), (16, 17), (16, 255), (16, 257), (16, 4095), (16, 4096)])
def test_traversal(arity, n):
    leaves = [sha(str(i)) for i in range(n)]
    levels = _levels(leaves, arity)
    walk = merkle.Traversal(leaves, len(levels) - 1, arity)
    assert walk.root == levels[-1][0]
    for i, path in enumerate(walk):
        assert path == _proof(levels, i, arity) and merkle.folded(leaves[i], path) == walk.root
    # two runs a level at most, besides the leaves themselves
    assert walk.most <= 2 * arity * (len(levels) - 1)


def _manifest(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    leaf = lambda *f: sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in f))
    by = {}
    for d, s, *rest in rows:
        by.setdefault(s, []).append((d is not None, d or 0, leaf(d, s, *rest), (d, s, *rest)))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: _levels([x[2] for x in sorted(by[s], key=lambda x: x[:3])], 16) for s in order}
    top, out = _levels([trees[s][-1][0] for s in order], 16), []
    for k, s in enumerate(order):
        for i, (_, _, h, (d, _, lang, n, text)) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            path = _proof(trees[s], i, 16) + _proof(top, k, 16)
            hit = d is not None and zlib.crc32(str(d).encode()) % 5 == 0
            now = leaf(d, s, lang, n, text if text is None or not hit else re.sub("[A-Z]", lambda m: m[0].lower(), text))
            fold = merkle.folded(now, path)
            out.append((d, h, trees[s][-1][0], top[-1][0], sha("".join(x for p, run in path for j, x in enumerate(run) if j != p)), fold, fold == top[-1][0]))
    return sorted(out, key=repr)


def _spark_manifest(df):
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    got = merkle.manifest(df, tampered=F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), changed=changed)
    return sorted((tuple(r) for r in got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def test_manifest_on_awkward_rows(spark):
    rows = [(i, f"s{i % 3}", "en", i, f"Text {i} É") for i in range(120)]
    rows += [(5, "s0", "en", 1, "A"), (5, "s0", "en", 1, "A"), (None, "s0", None, None, None), (None, None, "en", 2, ""), (7, None, "é", None, "X" * 300_000), (9, "É", "", 0, None), (10, "", "x", 1, "漢字 😀 OK")]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").select("*", F.lit(1).alias("pos"), F.lit(2).alias("digest"), F.lit(3).alias("block"), F.lit(4).alias("_row"))
    assert _spark_manifest(df) == _manifest(rows)
    assert merkle.manifest(df.limit(0)).collect() == []
    assert _spark_manifest(df.where("source = ''")) == _manifest(rows[-1:])


def test_manifest_of_many_sources_and_blocks(spark):
    """A source of more than one block, more sources than one block of the upper tree has."""
    rows = [(i, "hot" if i < 5000 else f"s{i}", None, i, "T") for i in range(9200)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").repartition(7)
    assert _spark_manifest(df) == _manifest(rows)


def test_op12_is_the_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    assert sorted(map(tuple, queries.op12_merkle(spark, SF).collect())) == sorted(con.sql(oracles.ORACLES["op12_merkle"]).fetchall())


# 13 ---------------------------------------------------------------------------------------------------------------
def _every_repair(rows):
    """(cost, audit, repaired lines) over all edits: rows with role, text, fault; at most two inserts before each row and two at the end."""
    best = None
    options = []
    for role, text, fault in rows:
        mine = [("D", 3, None)]
        if fault not in ("blank", "duplicate"):
            more = fault == "truncated"
            mine += [("K", more, (role, text)), ("R", 2 + more, ("user", text)), ("R", 2 + more, ("assistant", text))]
        options.append(mine)
    inserts = [p for n in range(3) for p in itertools.product((("user", ""), ("assistant", "")), repeat=n)]
    for chosen in itertools.product(*options):
        for extra in itertools.product(inserts, repeat=len(rows) + 1):
            cost = sum(c for _, c, _ in chosen) + 2 * sum(map(len, extra))
            if best and cost > best[0]:
                continue
            audit, out = "", []
            for more, (edit, _, row) in zip(extra, [*chosen, ("", 0, None)]):
                audit += "I" * len(more) + edit
                out += [*more, *([row] if row else [])]
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out)) and all(r for r, _ in out) and (best is None or (cost, audit) < best[:2]):
                best = cost, audit, "\n".join(f"{r}:{t}" for r, t in out)
    return best


def _result(rows):
    """Of rows (turn, role, text) in order: what repair() gives, the edits by trying all."""
    told, seen = [], set()
    for _, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        told.append((role, text, "blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated"))
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    faults = [f for _, _, f in told]
    cost, audit, lines = _every_repair(told)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha(lines))


def test_repair_is_the_best_of_all_edits(spark):
    rng = np.random.default_rng(3)
    texts, roles = ["A.", "B", "", " \t\n", "Ü!", "C?  ", "A.", "x\x0b"], ["user", "assistant", "system", "tool", "user", "assistant", ""]
    rows, want = [], {}
    for conv in range(160):
        mine = sorted(((None if rng.random() < 0.1 else int(rng.integers(0, 9)), roles[rng.integers(0, 7)], texts[rng.integers(0, 8)]) for _ in range(rng.integers(1, 4))), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        rows += [(conv, *r, False) for r in mine]
        want[conv] = _result(mine)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, gone boolean").withColumns({"fault": F.lit("x"), "_again": F.lit(1), "kind": F.lit(2)})
    for block in (1, 2, 256):
        assert {r.conv_id: tuple(r)[1:] for r in repair.repair(df, block).collect()} == want


def test_repair_of_nulls_gone_and_empty(spark):
    rows = [(1, 0, "user", "A.", True), (None, None, None, None, False), (2, None, "user", "A.", False), (2, None, "assistant", "B.", None)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, gone boolean")
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair(df).collect()}
    assert got[1] == (0, 0, 0, 0, 0, 0, "", sha(""))
    assert got[None] == (0, 1, 0, 0, 0, 3, "D", sha(""))
    assert got[2] == _result([(None, "assistant", "B."), (None, "user", "A.")])
    assert repair.repair(df.limit(0)).collect() == []


def _by_table(rows):
    """The best edits by a table over (row, state), for conversations of any length: (cost, audit)."""
    best = {0: (0, "")}
    for role, _, fault in rows + [("", "", None)]:
        for _ in range(4):
            for s, (c, a) in list(best.items()):
                for i, t in repair.MOVES[s].items():
                    if i != "s":
                        best[t] = min(best.get(t, (1e9, "")), (c + 2, a + "I"))
        if fault is None:
            break
        after = {}
        for s, (c, a) in best.items():
            put = lambda t, cost, e: after.__setitem__(t, min(after.get(t, (1e9, "")), (c + cost, a + e)))  # noqa: B023, E731
            put(s, 3, "D")
            if fault not in ("blank", "duplicate"):
                for i, t in repair.MOVES[s].items():
                    if i == role[:1]:
                        put(t, fault == "truncated", "K")
                    elif i != "s":
                        put(t, 2 + (fault == "truncated"), "R")
        best = after
    return min(best[s] for s in (0, 3) if s in best)


def test_op13_and_a_long_conversation(spark):
    """The damage, counts and edits over the whole table, told anew in plain Python; and one conversation over many blocks."""
    import pandas as pd

    table = pd.read_parquet(f"{SF}/conversations.parquet")
    want, got = {}, {r.conv_id: r for r in queries.op13_repair(spark, SF).collect()}
    for conv, part in table.groupby("conv_id"):
        rows = []
        for r in part.sort_values("turn").itertuples():
            kind = zlib.crc32(f"{conv}:{r.turn}".encode()) % 20
            row = (r.turn, "user" if kind == 4 else r.role, "" if kind == 1 else re.sub("[.!?]", "", r.text) if kind == 2 else r.text)
            rows += [] if kind == 0 else [row, row] if kind == 3 else [row]
        told, seen = [], set()
        for _, role, text in rows:
            solid = text.rstrip(" \t\n\x0b\x0c\r")
            told.append((role, text, "blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated"))
            seen.add((role, text))
        want[conv] = (_by_table(told), [sum(f == x for *_, f in told) for x in ("blank", "duplicate", "truncated")])
    assert {c: ((r.cost, r.audit), [r.blank, r.duplicate, r.truncated]) for c, r in got.items()} == want

    rng = np.random.default_rng(4)
    rows = [(1, t, ["user", "assistant", "system"][rng.integers(0, 3)], ["Yes.", f"Row {t}.", f"Cut {t}", ""][rng.integers(0, 4)], False) for t in range(3000)]
    told, seen = [], set()
    for _, _, role, text, _ in rows:
        told.append((role, text, "blank" if not text else "duplicate" if (role, text) in seen else "" if text[-1] == "." else "truncated"))
        seen.add((role, text))
    r = repair.repair(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, gone boolean")).first()
    assert (r.cost, r.audit) == _by_table(told) and r.gaps == 0
