"""Matches with offsets, and the ways to keep spans apart.

Spark has no expression that tells where a pattern matches, so `found` reads the texts once, in Arrow batches, and adds each row's matches as an
array with what stands around them. All that follows (values, confidence, overlap, replacement) is an expression over that array: a text and its
spans stay in one row, nothing is joined back by key and nothing is shuffled; rows with equal or null keys never mix.

Plain ASCII texts are matched a column at a time by Arrow's regular expressions (RE2), which mark the matches; rules that RE2 lacks (looking around) are tried
by Python where RE2 finds the rule without its conditions. Other texts are read by Python one by one: there a rule is looked for only in texts that hold one of
the words that each of its matches must hold (`needles`), so rules that meet nothing cost little.

Offsets are code points, the end exclusive. Empty matches are left out. A null text has no spans.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache, reduce
from re import _parser as parser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, LongType, MapType, StringType, StructField, StructType

_TEXTS = ("match", "pre", "post")
SPAN = StructType([StructField("rule", IntegerType()), StructField("start", LongType()), StructField("end", LongType()), *[StructField(n, StringType()) for n in _TEXTS]])


#: Characters whose lower case is another one than that which a pattern in any case takes them for.
_ODD = re.compile("[\u0130\u0131\u017f]")


def needles(pattern: str) -> list[str]:
    """Lower-case ASCII pieces of which every match has one, in some case; empty if there are none to tell by."""
    try:
        return sorted(_pieces(parser.parse(pattern)) or ())
    except re.error:
        return []


def may(low: Column, pattern: str) -> Column:
    """Whether a text may match the pattern in any case of ASCII letters, by its lower case."""
    return reduce(lambda a, w: a | F.contains(low, F.lit(w)), needles(pattern), F.lit(False)) if needles(pattern) else F.lit(True)


def _pieces(tree) -> set[str] | None:
    """Of a sequence the piece, or the pieces of its alternatives, whose shortest is longest."""
    told, run = [], ""
    for op, arg in [*tree, (None, None)]:
        if op is parser.LITERAL and arg < 128:
            run += chr(arg).lower()
            continue
        if op is parser.AT:
            continue
        if run:
            told.append({run})
        run, inner = "", None
        if op is parser.SUBPATTERN:
            inner = _pieces(arg[3])
        elif op is parser.BRANCH:
            each = [_pieces(t) for t in arg[1]]
            inner = set().union(*each) if all(each) else None
        elif op in (parser.MAX_REPEAT, parser.MIN_REPEAT, parser.POSSESSIVE_REPEAT) and arg[0] > 0:
            inner = _pieces(arg[2])
        if inner:
            told.append(inner)
    return max(told, key=lambda ps: (min(map(len, ps)), -len(ps)), default=None)


def _compiled(patterns: list[str]) -> list[tuple[int, re.Pattern, list[str]]]:
    return [(i, re.compile(p), needles(p)) for i, p in enumerate(patterns)]


def _columned(patterns: list[str]) -> list[tuple]:
    """Compiled rules with what by_column() says of each."""
    return list(_columned_once(tuple(patterns)))


@lru_cache(64)
def _columned_once(patterns: tuple[str, ...]) -> list[tuple]:
    # a Python worker has many tasks with the same rules
    return [(*rule, by_column(p)) for rule, p in zip(_compiled(patterns), patterns)]


def _worth(t: str, rules: list[tuple]) -> list[tuple[int, re.Pattern]]:
    """The rules that may match t."""
    if not t.isascii() and _ODD.search(t):
        return [(i, p) for i, p, *_ in rules]
    low = t.lower()
    return [(i, p) for i, p, words, *_ in rules if not words or any(w in low for w in words)]


#: Characters that Python takes for white space and RE2 doesn't, and the two that mark matches.
_UNLIKE = r"[\x01\x02\x0B\x1C-\x1F]"
#: Texts that are matched at a time.
_ROWS = 2048
#: What a pattern may be made of so that RE2 and Python match the same in plain texts. $ isn't in it: Python's also stands before a last line feed.
_SAME = {parser.LITERAL, parser.NOT_LITERAL, parser.ANY, parser.IN, parser.SUBPATTERN, parser.BRANCH, parser.MAX_REPEAT, parser.MIN_REPEAT}
_PLACES = {parser.AT_BEGINNING, parser.AT_BOUNDARY, parser.AT_NON_BOUNDARY}
_LOOK = re.compile(r"\(\?<?[!=](?:[^()\\]|\\.)*\)")


def _alike(tree) -> bool:
    for op, arg in tree:
        if op is parser.AT:
            if arg not in _PLACES:
                return False
        elif op not in _SAME:
            return False
        elif op is parser.SUBPATTERN and (arg[1] or arg[2] or not _alike(arg[3])):
            return False
        elif op is parser.BRANCH and not all(map(_alike, arg[1])):
            return False
        elif op in (parser.MAX_REPEAT, parser.MIN_REPEAT):
            low, high, body = arg
            # the two go round an empty body in different ways
            if low > 1000 or (high is not parser.MAXREPEAT and high > 1000) or (high != 1 and body.getwidth()[0] == 0) or not _alike(body):
                return False
    return True


def _bare(tree) -> list:
    """The tree as lists, without looking around."""
    plain = lambda x: _bare(x) if isinstance(x, parser.SubPattern) else [plain(y) for y in x] if isinstance(x, (list, tuple)) else x
    return [(op, plain(arg)) for op, arg in tree if op not in (parser.ASSERT, parser.ASSERT_NOT)]


def by_column(pattern: str) -> tuple[str, bool] | None:
    """The pattern for RE2 and whether it is the whole rule (else only the places where the rule can begin are in its matches); None: Python alone can tell."""
    try:
        tree, bare = parser.parse(pattern), _LOOK.sub("", pattern)
        told = parser.parse(bare)
        if tree.state.flags & ~(re.IGNORECASE | re.MULTILINE | re.UNICODE) or "[[:" in bare or "{," in bare or told.getwidth()[0] == 0 or not _alike(told) or _bare(tree) != _bare(told):
            return None
        pc.match_substring_regex(pa.array([""]), bare)
    except (re.error, pa.ArrowInvalid):
        return None
    return bare, bare == pattern


def _marked(texts: pa.Array, pattern: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of the pattern's matches in plain texts, in order."""
    made = pc.replace_substring_regex(texts, pattern, "\x01\\0\x02")
    offsets = np.frombuffer(made.buffers()[1], np.int32)[made.offset : made.offset + len(made) + 1]
    data = np.frombuffer(made.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    start, end = np.flatnonzero(data == 1), np.flatnonzero(data == 2)
    begins = offsets[:-1] - offsets[0]
    row = np.searchsorted(begins, start, "right") - 1
    # marks that stand before a match in its text
    marks = 2 * (np.arange(len(row)) - np.searchsorted(row, row)) + begins[row]
    return row, start - marks, end - marks - 1


def _within(p: re.Pattern, texts: pa.Array, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of the matches of p, all of which begin within the given places."""
    out, last, t, at = [], -1, "", 0
    for r, a, b in zip(row.tolist(), start.tolist(), end.tolist()):
        if r != last:
            last, t, at = r, texts[r].as_py(), 0
        if b > at:
            m = p.search(t, max(a, at))
            at = m.end() if m else len(t)
            if m:
                out.append((r, *m.span()))
    return tuple(np.array(out, np.int64).reshape(-1, 3).T)


def _cut(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The pieces of data from start to end."""
    ends = np.cumsum(np.r_[0, end - start])
    at = np.arange(ends[-1]) + np.repeat(start - ends[:-1], end - start)
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data[at]))


def _hits(texts: pa.Array, rule: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of a rule's matches in plain texts, in order."""
    _, p, _, column = rule
    if column:
        hits = _marked(texts, column[0])
        return hits if column[1] else _within(p, texts, *hits)
    hits = [(r, *m.span()) for r, t in enumerate(texts.to_pylist()) for m in p.finditer(t) if m.end() > m.start()]
    return tuple(np.array(hits, np.int64).reshape(-1, 3).T)


def hits(texts: pa.Array, pattern: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of the pattern's matches, in order; texts must be plain()."""
    return _hits(texts, _columned([pattern])[0])


def plain(texts: pa.Array, unlike: str = "") -> np.ndarray:
    """Whether each text is plain ASCII that all engines read alike: without odd white space, marks and what the class `unlike` names. A null text is."""
    odd = _UNLIKE[:-1] + unlike + "]"
    return pc.fill_null(pc.and_(pc.string_is_ascii(texts), pc.invert(pc.match_substring_regex(texts, odd))), True).to_numpy(zero_copy_only=False)


def _plain_spans(texts: pa.Array, rules: list[tuple], before: int, after: int | None) -> tuple[np.ndarray, pa.StructArray]:
    """Row and span of all matches in plain texts, in order of row, rule and start."""
    told = []
    for rule in rules:
        row, start, end = _hits(texts, rule)
        told.append((row, np.full(len(row), rule[0]), start, end))
    row, rule, start, end = (np.concatenate([t[k] for t in told] or [np.zeros(0, np.int64)]).astype(np.int64) for k in range(4))
    order = np.argsort(row, kind="stable")
    row, rule, start, end = row[order], rule[order], start[order], end[order]
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    base, limit = offsets[row], offsets[row + 1]
    if after is None:
        lines = np.r_[np.flatnonzero(data == 10), len(data)]
        stop = np.minimum(lines[np.searchsorted(lines, base + end)], limit)
    else:
        stop = np.minimum(base + end + after, limit)
    pieces = _cut(data, base + start, base + end), _cut(data, np.maximum(base, base + start - before), base + start), _cut(data, base + end, stop)
    return row, pa.StructArray.from_arrays([pa.array(rule, pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), *pieces], ["rule", "start", "end", *_TEXTS])


def _spans(texts: pa.Array, rules: list[tuple], before: int, after: int | None, failed: Callable[[int, Exception], None] | None = None) -> pa.Array:
    """Each text's spans. failed: told of a text's row and error where a search of it fails; else errors are raised."""
    alike = plain(texts)
    place, other = np.flatnonzero(alike), np.flatnonzero(~alike)
    fast = pc.fill_null(texts if len(place) == len(texts) else texts.take(pa.array(place)), "")
    row, spans = _plain_spans(fast, rules, before, after)
    row = place[row]
    if len(other):
        rows, parts = [], []
        for r, t in zip(other.tolist(), texts.take(pa.array(other)).to_pylist()):
            try:
                found = [hit for i, p in _worth(t, rules) for hit in _matches(t, i, p, before, after)]
            except (RecursionError, ValueError, MemoryError) as e:
                if not failed:
                    raise
                failed(r, e)
                found = []
            rows += [r] * len(found)
            parts += found
        columns = list(zip(*parts)) or [[]] * 6
        more = pa.StructArray.from_arrays([pa.array(c, f) for c, f in zip(columns, [pa.int32(), pa.int64(), pa.int64(), *[pa.string()] * 3])], ["rule", "start", "end", *_TEXTS])
        row = np.concatenate([row, np.array(rows, np.int64)])
        order = np.argsort(row, kind="stable")
        row, spans = row[order], pa.concat_arrays([spans, more]).take(pa.array(order))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(texts) + 1)), pa.int32()), spans)


def _firsts(lists: pa.ListArray) -> pa.ListArray:
    """Of each row's spans, in order of start and rule, those that overlap none already kept: what apart() gives for that order."""
    ends, spans = lists.offsets.to_numpy(), lists.values
    rule, start, end = (spans.field(n).to_numpy() for n in ("rule", "start", "end"))
    row = np.repeat(np.arange(len(lists)), np.diff(ends))
    order = np.lexsort((rule, start, row))
    keep, last, stop = [], -1, 0
    for i, r, a, b in zip(order.tolist(), row[order].tolist(), start[order].tolist(), end[order].tolist()):
        # what is kept of a row ends where its last one ends, as no later one begins before
        if r != last or a >= stop:
            keep.append(i)
            last, stop = r, b
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[keep], np.arange(len(lists) + 1)), pa.int32()), spans.take(pa.array(keep, pa.int64())))


#: Bytes at the beginning of a word by which places in texts are chosen.
_HEAD = 3


@lru_cache(16)
def _heads(words: tuple[str, ...]) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray]]]:
    """The sums of three bytes with which a word may begin, and (place, sum, bytes) of each word."""
    told = [(i, np.frombuffer(w.encode(), np.uint8)) for i, w in enumerate(words)]
    told = [(i, int(_sums(w[:_HEAD])[0]), w) for i, w in told]
    begins = np.zeros(1 << 16, bool)
    begins[[k for _, k, _ in told]] = True
    return begins, told


def _sums(data: np.ndarray) -> np.ndarray:
    wide = data.astype(np.uint16)
    return wide[:-2] ^ (wide[1:-1] << 5) ^ (wide[2:] << 10)


def held(texts: pa.Array, words: list[str]) -> np.ndarray:
    """Row by word: whether the text's lower case holds the word (lower-case ASCII, three characters at least). A null text holds none.

    Plain ASCII texts are read once for all words: places where three bytes begin a word are compared with the words that begin so.
    """
    if not all(w.isascii() and w == w.lower() and len(w) >= _HEAD for w in words):
        raise ValueError("words must be lower-case ASCII of three characters at least")
    out = np.zeros((len(texts), len(words)), bool)
    plain = pc.fill_null(pc.string_is_ascii(texts), True).to_numpy(zero_copy_only=False)
    other = np.flatnonzero(~plain)
    for r, t in zip(other.tolist(), texts.take(pa.array(other)).to_pylist()):
        out[r] = [w in t.lower() for w in words]
    low = pc.ascii_lower(pc.fill_null(pc.if_else(pa.array(plain), texts, ""), ""))
    offsets = np.frombuffer(low.buffers()[1], np.int32)[low.offset : low.offset + len(low) + 1].astype(np.int64)
    data = np.frombuffer(low.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    if len(data) < _HEAD or not words:
        return out
    offsets, (begins, told) = offsets - offsets[0], _heads(tuple(words))
    sums = _sums(data)
    place = np.flatnonzero(begins[sums])
    place = place[np.argsort(sums[place], kind="stable")]
    sums, row = sums[place], np.searchsorted(offsets, place, "right") - 1
    for i, k, w in told:
        a, b = np.searchsorted(sums, np.array([k, k + 1]))
        at, of = place[a:b], row[a:b]
        within = at + len(w) <= offsets[of + 1]
        at, of = at[within], of[within]
        for j, byte in enumerate(w):
            if not len(at):
                break
            same = data[at + j] == byte
            at, of = at[same], of[same]
        out[of, i] = True
    return out


def _flags(values: np.ndarray) -> pa.Array:
    n, m = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * m, pa.int32()), pa.array(values.ravel()))


def _slices(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            yield batch.slice(at, _ROWS)


def found(docs: DataFrame, rules: list[tuple], text: str = "text", before: int = 0, after: int | None = 0, only: list[int] | None = None, keep: bool = True, words: list[str] | None = None, first: bool = False) -> DataFrame:
    """docs with a column spans, in order of rule (the place in rules; a rule's first field is its pattern) and start.

    pre: up to `before` characters before the match; post: up to `after` after it (None: to the end of its line). only: places of the rules that are looked for; keep: whether the text stays.
    first: in order of start and rule, and only those that overlap none before. words: adds a column held, which says for each word, as held() does, whether the text holds it.
    """
    place, stay = docs.columns.index(text), [i for i, c in enumerate(docs.columns) if keep or c != text]
    names = [*[docs.columns[i] for i in stay], "spans", *(["held"] if words else [])]
    patterns = [r[0] for r in rules]

    def run(batches):
        compiled = [rule for rule in _columned(patterns) if only is None or rule[0] in only]
        for batch in _slices(batches):
            more = [_flags(held(batch.column(place), words))] if words else []
            spans = _spans(batch.column(place), compiled, before, after)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in stay], _firsts(spans) if first else spans, *more], names)

    schema = StructType([docs.schema.fields[i] for i in stay]).add("spans", ArrayType(SPAN))
    return docs.mapInArrow(run, schema.add("held", ArrayType(BooleanType())) if words else schema)


def reading(docs: DataFrame, columns: dict[str, tuple[Callable[[pa.Array], pa.Array], DataType]], text: str = "text") -> DataFrame:
    """docs with more columns, each worked out from a batch of texts (a function of them, and its type), in one reading."""
    place, names = docs.columns.index(text), [*docs.columns, *columns]

    def run(batches):
        for batch in _slices(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, *[make(batch.column(place)) for make, _ in columns.values()]], names)

    schema = StructType(list(docs.schema.fields))
    for name, (_, kind) in columns.items():
        schema = schema.add(name, kind)
    return docs.mapInArrow(run, schema)


def first_places(patterns: list[str], words: list[list[str]]) -> tuple[Callable[[pa.Array], pa.Array], DataType]:
    """For reading(): a struct of places (for each pattern where it first matches, from 1; 0: nowhere) and hits (for each list how many of its words the lower-cased text holds). Classes are ASCII; a null text has null."""
    kind = StructType().add("places", ArrayType(IntegerType())).add("hits", ArrayType(IntegerType()))
    every = list(dict.fromkeys(w for ws in words for w in ws))
    pieces = {p: ns if (ns := needles(p)) and min(map(len, ns)) >= _HEAD else [] for p in patterns}
    sought = list(dict.fromkeys([*[w for w in every if len(w) >= _HEAD], *[n for ns in pieces.values() for n in ns]]))

    def make(texts: pa.Array) -> pa.Array:
        alike = plain(texts)
        place, other = np.flatnonzero(alike), np.flatnonzero(~alike)
        fast = pc.fill_null(texts.take(pa.array(place)), "")
        places, hits = np.zeros((len(texts), len(patterns)), np.int32), np.zeros((len(texts), len(words)), np.int32)
        there = dict(zip(sought, held(fast, sought).T)) if sought else {}
        low = pc.ascii_lower(fast)
        there |= {w: pc.match_substring(low, w).to_numpy(zero_copy_only=False) for w in every if len(w) < _HEAD}
        for i, ws in enumerate(words):
            hits[place, i] = sum((there[w].astype(np.int32) for w in ws), np.zeros(len(place), np.int32))
        compiled = [(i, re.compile(p, re.ASCII), needles(p)) for i, p in enumerate(patterns)]
        for (i, p, _), (*_, column) in zip(compiled, _columned(patterns)):
            at = np.flatnonzero(reduce(np.logical_or, [there[n] for n in pieces[patterns[i]]])) if pieces[patterns[i]] else np.arange(len(place))
            some = fast.take(pa.array(at))
            if column and column[1]:
                found = pc.find_substring_regex(some, column[0]).to_numpy(zero_copy_only=False) + 1
            else:
                found = [m.start() + 1 if (m := p.search(t)) else 0 for t in some.to_pylist()]
            places[place[at], i] = found
        for r, t in zip(other.tolist(), texts.take(pa.array(other)).to_pylist()):
            for i, p in _worth(t, compiled):
                m = p.search(t)
                places[r, i] = m.start() + 1 if m else 0
            hits[r] = [sum(w in t.lower() for w in ws) for ws in words]
        as_lists = lambda v: pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32()), pa.array(v.ravel()))
        return pa.StructArray.from_arrays([as_lists(places), as_lists(hits)], ["places", "hits"], mask=pc.is_null(texts))

    return make, kind


def found_each(docs: DataFrame, asks: dict[str, tuple[list[tuple], int, int | None]], text: str = "text", more: dict[str, tuple[Callable[[pa.Array], pa.Array], DataType]] | None = None) -> DataFrame:
    """docs with a column of spans, as found() gives them, for each of asks (name: rules, before, after), and component_errors, in one pass over the texts. more: columns as in reading(), put last.

    A component whose rules can't be compiled or whose search fails on a text has no spans there and its message in component_errors (a map by
    name; empty where all went well); the others go on.
    """
    more = more or {}
    place, names = docs.columns.index(text), [*docs.columns, *asks, "component_errors", *more]

    def run(batches):
        compiled, broken = {}, {}
        for name, (rules, _, _) in asks.items():
            try:
                compiled[name] = _columned([r[0] for r in rules])
            except (re.error, TypeError) as e:
                broken[name] = f"{type(e).__name__}: {e}"
        for batch in _slices(batches):
            errors, arrays = [dict(broken) for _ in range(batch.num_rows)], []
            for name, (_, before, after) in asks.items():
                note = lambda r, e, name=name: errors[r].update({name: f"{type(e).__name__}: {e}"})
                arrays.append(_spans(batch.column(place), compiled.get(name, []), before, after, note))
            told = pa.array([list(e.items()) for e in errors], pa.map_(pa.string(), pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays, told, *[make(batch.column(place)) for make, _ in more.values()]], names)

    schema = StructType(list(docs.schema.fields))
    for name in asks:
        schema = schema.add(name, ArrayType(SPAN))
    schema = schema.add("component_errors", MapType(StringType(), StringType()))
    for name, (_, kind) in more.items():
        schema = schema.add(name, kind)
    return docs.mapInArrow(run, schema)


def _matches(t: str, i: int, p: re.Pattern, before: int, after: int | None):
    for m in p.finditer(t):
        a, b = m.span()
        if a < b:
            stop = b + after if after is not None else t.find("\n", b)
            yield i, a, b, m.group(), t[max(0, a - before) : a], t[b:stop] if stop >= 0 else t[b:]


def scan(docs: DataFrame, pattern: str, key: str = "doc_id", text: str = "text", before: int = 0, after: int | None = 0) -> DataFrame:
    """key, start, end, match (pre and post too where asked for): a row for each match of pattern."""
    return scan_many(docs, [(pattern,)], key, text, before, after).drop("rule")


def scan_many(docs: DataFrame, rules: list[tuple], key: str = "doc_id", text: str = "text", before: int = 0, after: int | None = 0) -> DataFrame:
    """key, rule, start, end, match (pre and post too where asked for) of every rule's matches."""
    rows = found(docs.select(key, text), rules, text, before, after, keep=False).select(key, F.inline("spans"))
    return rows.drop(*([] if before else ["pre"]), *([] if after != 0 else ["post"]))


def field(rules: list[tuple], i: int, rule: Column) -> Column:
    """Field i of a span's rule."""
    return F.element_at(F.lit([r[i] for r in rules]), rule + 1)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _ranked(spans: Column, order: Callable[[Column], list[Column]]) -> Column:
    # not array_sort, which calls an expression for each comparison
    return F.sort_array(F.transform(spans, lambda x: F.struct(F.struct(*order(x)).alias("o"), x.alias("x"))))


def _overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def apart(spans: Column, order: Callable[[Column], list[Column]], against: Callable[[Column, Column], Column] = _overlap) -> Column:
    """Greedily in the given order, the spans that stand against none already kept."""
    add = lambda acc, y: F.when(F.exists(acc, lambda k: against(k, y["x"])), acc).otherwise(F.concat(acc, F.array(y["x"])))
    return let(spans, lambda s: F.aggregate(_ranked(s, order), F.filter(s, lambda x: F.lit(False)), add))


def apart_by(name: str) -> Callable[[Column, Column], Column]:
    """For `apart`: spans with different values of a field don't stand against each other."""
    return lambda a, b: (a[name] == b[name]) & _overlap(a, b)


def _longer(x: Column, last: Column) -> Column:
    return x["end"] - x["start"] > last["end"] - last["start"]


def longest(spans: Column, order: Callable[[Column], list[Column]], better: Callable[[Column, Column], Column] = _longer) -> Column:
    """In the given order (start first): a span that overlaps the last kept one replaces it if it is better (longer), else goes."""

    def add(acc: Column, y: Column) -> Column:
        x, last = y["x"], F.get(acc, F.size(acc) - 1)
        fits = (F.size(acc) == 0) | (x["start"] >= last["end"])
        return F.when(fits, F.concat(acc, F.array(x))).when(better(x, last), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(x))).otherwise(acc)

    return let(spans, lambda s: F.aggregate(_ranked(s, order), F.filter(s, lambda x: F.lit(False)), add))


def rewritten(text: Column, spans: Column) -> Column:
    """text with its spans (start, end, new; in order, none overlap) written over."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        kept = F.substring(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int"))
        return F.struct(x["end"].alias("at"), F.concat(acc["out"], kept, x["new"]).alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, add, rest)).otherwise(text)
