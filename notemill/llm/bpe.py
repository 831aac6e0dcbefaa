"""Byte-level BPE by backtracking, and decoding by an offset table.

The encoder needs no merge loop. Aho-Corasick gives, for each position of a piece, the longest vocabulary entry that
starts there. A token may follow another only if BPE would really leave the two side by side; a table of pairs, filled
as pairs come up, holds the answers. Where a token doesn't fit, the next shorter one is tried, and where none fits the
previous token is given up; a position found to be a dead end is never entered again, so the work stays linear in the
piece. The tokens left are exactly those of the merges.

Decoding gathers bytes from one array that holds all entries end to end, by a table of their offsets.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache
from itertools import accumulate, pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: White space and the split pattern of byte-level BPE.
SPACE = r"\t-\r \x85\xa0  -     　"
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Pieces that a worker remembers at most (and half as many as pairs), and the longest such piece.
CACHE_PIECES, CACHE_CHARS = 500_000, 64


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    def __init__(self, path: str, remember: int = CACHE_PIECES):
        self.remember = remember
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        as_bytes = lambda s: bytes(alphabet[c] for c in s)
        ids: dict[bytes, int] = {as_bytes(k): v for k, v in spec["model"]["vocab"].items()}
        self.byte_id = [ids[bytes([b])] for b in range(256)]
        # rank: bytes come first, then the merges in their order; parts: what the merge that made an entry joined
        self.rank: dict[int, int] = {i: -1 for i in self.byte_id}
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = (as_bytes(x) for x in (m if isinstance(m, list) else m.split(" ")))
            whole, pair = ids[a + b], (ids[a], ids[b])
            self.joined[pair] = whole
            if whole not in self.rank:
                self.rank[whole], self.parts[whole] = r, pair
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.ids = {b: i for b, i in ids.items() if i in self.rank}
        self.size = {i: len(b) for b, i in ids.items()}
        self.prefix: dict[int, int] = {}
        self.at = ahocorasick.Automaton()
        for b, i in self.ids.items():
            self.at.add_word(b.decode("latin-1"), (len(b), i))
        self.at.make_automaton()
        self.fits_table: dict[tuple[int, int], bool] = {}
        self.split = regex.compile(SPLIT)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cache: dict[str, tuple[int, ...]] = {}
        entries = dict.fromkeys(range(max([*ids.values(), *self.special.values()]) + 1), b"")
        entries |= {i: b for b, i in ids.items()} | {i: s.encode() for s, i in self.special.items()}
        lengths = np.array([len(b) for b in entries.values()], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        self.blob = np.frombuffer(b"".join(entries.values()), np.uint8)

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges leave `left` and `right` apart when their bytes stand side by side.

        The merges that build both are undone from the latest on. At each step the two entries at the border could have
        been joined instead; they would have been, if that merge comes before the one undone last.
        """
        pair = (left, right)
        if (known := self.fits_table.get(pair)) is not None:
            return known
        a, b, rank, good = left, right, self.rank, True
        # no merge outranks the end of all; ties: the left of two equal merges goes first
        before = (1 << 60, 0)
        while True:
            j = self.joined.get((a, b))
            if j is not None and (rank[j], 1) < before:
                good = False
                break
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                break
            if ra > rb:
                before, a = (ra, 0), self.parts[a][1]
            else:
                before, b = (rb, 2), self.parts[b][0]
        if len(self.fits_table) >= 2 * self.remember:
            self.fits_table.clear()
        self.fits_table[pair] = good
        return good

    def shorter(self, token: int) -> int:
        """The longest entry that begins `token` and is shorter; -1 if there is none."""
        known = self.prefix.get(token)
        if known is None:
            whole = self.blob[self.offsets[token] : self.offsets[token + 1]].tobytes()
            known = self.prefix[token] = next((self.ids[whole[:n]] for n in range(len(whole) - 1, 0, -1) if whole[:n] in self.ids), -1)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        text, n, size, fits, table = piece.decode("latin-1"), len(piece), self.size, self.fits, self.fits_table
        # about half of all pieces need no second thought: the longest entries one after the other already fit
        out = [i for _, (_, i) in self.at.iter_long(text)]
        for pair in pairwise(out):
            if not (table[pair] if pair in table else fits(*pair)):
                break
        else:
            return out
        long = dict(zip(accumulate(map(size.__getitem__, out), initial=0), out))
        dead = bytearray(n + 1)
        out, at, token = [], 0, long[0]
        while at < n:
            while token >= 0 and (dead[at + size[token]] or out and not fits(out[-1], token)):
                token = self.shorter(token)
            if token >= 0:
                out.append(token)
                at += size[token]
                if at < n and (token := long.get(at, -1)) < 0:
                    token = long[at] = next(self.at.iter_long(text, at))[1][1]
            else:
                dead[at] = 1
                at -= size[token := out.pop()]
                token = self.shorter(token)
        return out

    def encode(self, text: str) -> list[int]:
        if self.cut is not None and any(s in text for s in self.special):
            return [i for part in self.cut.split(text) if part for i in ([self.special[part]] if part in self.special else self._plain(part))]
        return self._plain(text)

    def _plain(self, text: str) -> list[int]:
        out: list[int] = []
        cache = self.cache
        for piece in self.split.findall(text):
            ids = cache.get(piece)
            if ids is None:
                ids = self.encode_piece(piece.encode("utf-8"))
                if len(piece) <= CACHE_CHARS:
                    if len(cache) >= self.remember:
                        cache.clear()
                    cache[piece] = ids
            out += ids
        return out

    def decode_bytes(self, ids) -> bytes:
        ids = np.asarray(ids, np.int64)
        if not len(ids):
            return b""
        start = self.offsets[ids]
        n = self.offsets[ids + 1] - start
        ends = np.cumsum(n)
        return self.blob[np.repeat(start - (ends - n), n) + np.arange(ends[-1])].tobytes()

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(2)
def load(path: str, remember: int = CACHE_PIECES) -> Bpe:
    return Bpe(path, remember)


def bpe_encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", digests: bool = False, remember: int = CACHE_PIECES) -> DataFrame:
    """Per row of docs: key, n_tokens, ids, decoded; with digests, ids_sha256 and decoded_sha256 in place of the two long columns.

    path: a byte-level BPE file of the tokenizers library, present on every executor. A null or empty text has no ids.
    Repeated rows and keys are encoded one by one, null keys too; texts of any length are encoded whole. Other columns are ignored. remember bounds
    a worker's memory of pieces and changes nothing else.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens bigint, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string")

    def run(batches):
        bpe = load(path, remember)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                ids = [bpe.encode(t) if t else [] for t in part.column(1).to_pylist()]
                columns = [part.column(0), pa.array(map(len, ids), pa.int64())]
                if digests:
                    columns += [pa.array([hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(bpe.decode_bytes(x)).hexdigest() for x in ids], pa.string())]
                else:
                    columns += [pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in ids], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [key, "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))])

    return docs.select(key, text).mapInArrow(run, schema)
