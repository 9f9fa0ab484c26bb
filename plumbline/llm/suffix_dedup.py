"""Repeated byte strings of all documents: enhanced suffix arrays over shared anchors, scanned for maximal repeat groups.

A string of `LENGTH` bytes repeats if it also starts earlier: in a document with a smaller id, or earlier in the same one.

* Anchors. Each window of `LENGTH` bytes picks, by content alone, the k-gram with the smallest hash (the leftmost of equals).
  Equal windows pick the same k-gram at the same offset, so a repeat can only be found among places that share an anchor.
* Shared anchors. The (k-gram, document) rows are sorted once over all partitions by k-gram and document; neighbours that
  agree are shared. A k-gram of any frequency is spread over as many partitions as its rows fill. The rows at a
  partition's edge count as shared, which costs a look and changes nothing.
* Suffix arrays. The places of one shared k-gram, each with the bytes its windows cover, are sorted by what follows; common
  prefixes of neighbours give the interval tree in one stack scan. Inside each interval the same is done with the bytes before
  the anchor, read backwards: an interval of both whose members differ on the left and on the right is a maximal repeat group
  (maximal within the windows of the anchor; a longer repeat is a chain of such groups). It holds all occurrences.
* Removal. Every occurrence but the first of each group is removed; this is the same as judging each string on its own,
  because a repeated string's occurrences are those of the maximal repeat around it.

Places of a document with equal bytes around the same k-gram are merged where the text is read. K-grams with more than
`MEMBERS` different places, in one document or in many, are not gathered in a task. Equal surroundings are first merged by an
aggregate (all but the first are repeats as a whole); the different ones that stay are cut to the windows that start near or
far from the k-gram and grouped by the longer string these share, again and again until a group has few places. That way is
exact too, no group of copies meets in one task, and a place moves as one or two rows instead of one per window.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import batches as B
from plumbline.llm.store import land, land_by

LENGTH, GRAM, MEMBERS, TREE = 100, 40, 1_500, 48
LAST = 2**63 - 1
_POSITION = np.uint64((1 << 20) - 1)
PART = B.PIECE - 4 * LENGTH


def _anchors(data: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows that pick the same k-gram: first and last window start, place of the k-gram, row, hash."""
    none = np.zeros(0, np.int64)
    n = len(data)
    if n < length:
        return none, none, none, none, none.view(np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(B.table("byte")[data] * B.table("up")[:n], out=sums[1:])
    h = B.mix((sums[gram:] - sums[:-gram]) * B.table("down")[: n - gram + 1])
    least = (h & ~_POSITION) | np.arange(len(h), dtype=np.uint64)
    width, need = 1, length - gram + 1
    while width * 2 <= need:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < need:
        least = np.minimum(least[: len(least) - (need - width)], least[need - width :])
    at = (least & _POSITION).astype(np.int64)
    start = np.unique(np.concatenate([np.flatnonzero(at[1:] != at[:-1]) + 1, bounds[:-1][bounds[:-1] < len(at)]]))
    row = np.searchsorted(bounds, start, side="right") - 1
    end = np.minimum(np.append(start[1:], len(at)) - 1, bounds[row + 1] - length)
    good = end >= start
    start, end, row = start[good], end[good], row[good]
    return start, end, at[start], row, h[at[start]]


def anchors(t: B.Texts, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The same for all rows; a row longer than `PART` bytes is taken in overlapping parts."""
    lo = 0
    while lo < t.rows:
        hi = max(lo + 1, int(np.searchsorted(t.bounds, t.bounds[lo] + PART, side="right")) - 1)
        begin, stop = int(t.bounds[lo]), int(t.bounds[hi])
        for at in range(begin, max(stop, begin + 1), PART):
            to = min(stop, at + PART + length - 1) if hi == lo + 1 else stop
            cut = t.bounds[lo : hi + 1].clip(at, to) - at
            start, end, place, row, h = _anchors(t.data[at:to], cut, length, gram)
            yield start + at, end + at, place + at, row + lo, h
        lo = hi


def _keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """doc (null ids come last), tk (names the text where an id repeats), text as bytes."""
    return docs.select(*names(id_col, text), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))


def shared(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, doc, lead) of k-grams that stand at two places or more, by one sort over all partitions.

    A k-gram has a row per different place of a document (at least two if it repeats there; above `MEMBERS` they are not
    counted on, which decides the same); `lead` marks one row per k-gram and document.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.slices(batches):
            doc = batch.column(0).to_numpy()
            t = B.texts(batch.column(1))
            for start, end, place, row, h in anchors(t, length, gram):
                order = np.lexsort((h, row))
                start, end, place, row, h = (x[order] for x in (start, end, place, row, h))
                third = np.zeros(len(h), bool)  # a k-gram's first two places in a row tell that it repeats there
                third[2:] = (h[2:] == h[:-2]) & (row[2:] == row[:-2])
                opens = np.flatnonzero(third & ~np.append(False, third[:-1])) - 2
                closes = np.flatnonzero(third & ~np.append(third[1:], False)) + 1
                for lo, hi in zip(opens.tolist(), closes.tolist(), strict=True):  # of the others, those with new bytes around count
                    seen: set[tuple[int, bytes]] = set()
                    for i in range(lo, hi):
                        if len(seen) > MEMBERS:
                            break
                        mark = int(place[i] - start[i]), t.data[start[i] : end[i] + length].tobytes()
                        if mark not in seen:
                            seen.add(mark)
                            third[i] = False
                yield pa.RecordBatch.from_arrays([pa.array(h[~third].view(np.int64)), pa.array(doc[row[~third]])], ["h", "doc"])

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, np.ndarray] | None = None
        first = True
        for batch in batches:
            h, doc = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if held is not None:
                h, doc = np.append(held[0], h), np.append(held[1], doc)
            if len(h) < 3:
                held = h, doc
                continue
            same = h[1:] == h[:-1]
            keep = np.append(same, True) | np.append(first, same)
            # the first row is judged already unless it opens the partition, the last waits for the next batch
            lo, hi = 0 if first else 1, len(h) - 1
            lead = np.append(True, ~(same & (doc[1:] == doc[:-1])))
            out = np.flatnonzero(keep[lo:hi]) + lo
            yield pa.RecordBatch.from_arrays([pa.array(h[out]), pa.array(doc[out]), pa.array(lead[out])], ["h", "doc", "lead"])
            held, first = (h[-2:], doc[-2:]), False
        if held is not None:
            at = slice(None) if first else slice(1, None)
            same = (held[0][1:] == held[0][:-1]) & (held[1][1:] == held[1][:-1])
            yield pa.RecordBatch.from_arrays([pa.array(held[0][at]), pa.array(held[1][at]), pa.array(np.append(True, ~same)[at])], ["h", "doc", "lead"])

    rows = keyed.select("doc", "text").mapInArrow(emit, "h bigint, doc bigint")
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, "h", "doc").sortWithinPartitions("h", "doc").mapInArrow(neighbours, "h bigint, doc bigint, lead boolean")


FEW, MANY, SPAN = 0, 1, 2
PLACES = "kind bigint, key bigint, h bigint, off bigint, doc bigint, tk bigint, start bigint, end bigint, context binary"
COLUMNS = ["kind", "key", "h", "off", "doc", "tk", "start", "end", "context"]


def _batch(columns: tuple[list, ...]) -> pa.RecordBatch:
    done = pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:-1]), pa.array(columns[-1], pa.binary())], COLUMNS)
    for column in columns:
        column.clear()
    return done


def places(touched: DataFrame, length: int, gram: int) -> DataFrame:
    """Places of shared k-grams with the bytes of their windows, of two kinds by how many documents share the k-gram, and as
    spans what repeats inside a document with the same bytes around it. Only places of few-shared k-grams are keyed by it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, ...] = tuple([] for _ in COLUMNS)
        for batch in B.slices(batches):
            doc, tk = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            few, many = ([np.unique(x.values.to_numpy()).view(np.uint64) for x in batch.column(i)] for i in (3, 4))
            t = B.texts(batch.column(2))
            raw = t.data.tobytes()
            seen: set[tuple[int, int, bytes]] = set()
            at_row, last = -1, None

            def put(*values) -> None:
                for column, value in zip(out, values, strict=True):
                    column.append(value)

            def put_span(row: int, span: list[int]) -> None:
                put(SPAN, hash((row, span[0])), 0, 0, int(doc[row]), int(tk[row]), *span, None)  # noqa: B023

            for start, end, place, row, h in anchors(t, length, gram):
                for lo, hi in zip(*(lambda c: (c, [*c[1:], len(row)]))(np.flatnonzero(np.append(True, row[1:] != row[:-1])).tolist() if len(row) else []), strict=True):  # noqa: B023
                    r = int(row[lo])
                    if r != at_row:
                        if last:
                            put_span(at_row, last)
                        seen, at_row, last = set(), r, None
                    kinds = np.where(np.isin(h[lo:hi], few[r]), FEW, np.where(np.isin(h[lo:hi], many[r]), MANY, -1))
                    here = np.flatnonzero(kinds >= 0)
                    base = int(t.bounds[r])
                    for kind, s, e, p, key in zip(kinds[here].tolist(), start[here + lo].tolist(), end[here + lo].tolist(), place[here + lo].tolist(), h[here + lo].view(np.int64).tolist(), strict=True):
                        context = raw[s : e + length]
                        mark = (key, p - s, context)
                        if mark not in seen:
                            seen.add(mark)
                            put(kind, key if kind == FEW else hash((r, s)), key, p - s, int(doc[r]), int(tk[r]), s - base, e + length - base, context)
                        elif last and s - base <= last[1]:
                            last[1] = max(last[1], e + length - base)
                        else:
                            if last:
                                put_span(r, last)
                            last = [s - base, e + length - base]
            if last:
                put_span(at_row, last)
            yield _batch(out)

    return touched.select("doc", "tk", "text", "few", "many").mapInArrow(run, PLACES)


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """The tree of common-prefix intervals of a sorted list, by a stack scan: (depth, first, last) of each with depth >= least."""
    stack: list[tuple[int, int]] = []
    for i, depth in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            if d >= least:
                yield d, first, i
        if not stack or stack[-1][0] < depth:
            stack.append((depth, first))


def repeat_groups(right: list[bytes], left: list[bytes], length: int) -> Iterator[tuple[int, int, list[int]]]:
    """Maximal repeat groups around an anchor: (bytes before, bytes from the anchor on, members).

    `right` is what each place holds from the anchor on, `left` what it holds before it, read backwards.
    """
    order = sorted(range(len(right)), key=right.__getitem__)
    ahead = [_common(right[a], right[b]) for a, b in zip(order, order[1:], strict=False)]
    longest = max(map(len, left))
    for r, lo, hi in intervals(ahead, length - longest):
        members = order[lo : hi + 1]
        rank = {m: i for i, m in enumerate(members, lo)}
        back = sorted(members, key=left.__getitem__)
        behind = [_common(left[a], left[b]) for a, b in zip(back, back[1:], strict=False)]
        for d, x, y in intervals(behind, max(0, length - r)):
            group = back[x : y + 1]
            ranks = sorted(rank[m] for m in group)
            # members that all go on alike to the right belong to a deeper interval
            if len(group) == len(members) or min(min(ahead[a:b]) for a, b in zip(ranks, ranks[1:], strict=False)) == r:
                yield d, r, group


def covered(right: list[bytes], left: list[bytes], length: int, at: list[tuple[int, int]] | None = None) -> list[tuple[int, int] | None]:
    """For each place, in order of position: how far the repeats reach that stand at an earlier place (bytes before the anchor,
    bytes from it on), or None. `at` gives the positions where some are equal, as those of texts that share an id.

    All of them hold the anchor, so together they are one span. Few places go through their maximal repeat groups; for many,
    common prefixes of each with all others are running minima over the two enhanced suffix arrays, one place at a time.
    """
    n = len(right)
    if n <= TREE and at is None:
        reach: list[tuple[int, int] | None] = [None] * n
        for d, r, group in repeat_groups(right, left, length):
            for m in group:
                if m != min(group):
                    reach[m] = (max(d, reach[m][0]), max(r, reach[m][1])) if reach[m] else (d, r)
        return reach

    def sorted_side(side: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = sorted(range(n), key=side.__getitem__)
        near = np.array([_common(side[a], side[b]) for a, b in zip(order, order[1:], strict=False)], np.int32)
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        return np.array(order), rank, near

    def shared_with(m: int, side: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        order, rank, near = side
        at, out = int(rank[m]), np.zeros(n, np.int32)
        out[order[at + 1 :]] = np.minimum.accumulate(near[at:])
        out[order[:at][::-1]] = np.minimum.accumulate(near[:at][::-1])
        return out

    ahead, behind = sorted_side(right), sorted_side(left)
    reach = [None] * n
    for m in range(1, n):
        earlier = bisect_left(at, at[m]) if at else m
        r, d = shared_with(m, ahead)[:earlier], shared_with(m, behind)[:earlier]
        good = r + d >= length
        if good.any():
            reach[m] = int(d[good].max()), int(r[good].max())
    return reach


def _solve(rows: DataFrame, length: int) -> DataFrame:
    """Spans to remove among places of k-grams with few members; the other rows pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: tuple[list, ...] = tuple([] for _ in COLUMNS)

        def put(row: tuple) -> None:
            for column, value in zip(out, row, strict=True):
                column.append(value)

        def settle() -> None:
            kinds: dict[tuple[int, int, bytes], tuple] = {}
            for row in sorted(held, key=lambda x: (x[4], x[6])):  # by document and start
                _, _, h, off, doc, tk, start, end, context = row
                if (first := kinds.setdefault((h, off, context), row)) is not row and (first[4], first[6]) != (doc, start):
                    put((SPAN, 0, 0, 0, doc, tk, start, end, None))  # the same bytes around the same k-gram stand earlier
            held.clear()
            groups: dict[int, list[tuple]] = {}
            for row in kinds.values():
                groups.setdefault(row[2], []).append(row)
            for group in groups.values():
                if len(group) > 1:
                    reach = covered([g[8][g[3] :] for g in group], [g[8][: g[3]][::-1] for g in group], length)
                    for row, found in zip(group, reach, strict=True):
                        if found:
                            put((SPAN, 0, 0, 0, row[4], row[5], row[6] + row[3] - found[0], row[6] + row[3] + found[1], None))

        key = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != FEW:
                    put(row)
                    continue
                if row[1] != key:
                    settle()
                    key = row[1]
                held.append(row)
            yield _batch(out)
        settle()
        yield _batch(out)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(run, PLACES)


def _halves(kinds: DataFrame, length: int) -> DataFrame:
    """Each place once per half of its group's offsets `lo` to `hi` that it has windows for, cut to these windows; the group is
    named by the bytes that all windows of the half hold."""
    middle = F.expr("(lo + hi) div 2")
    half = F.explode(F.array(F.struct(F.col("lo").alias("a"), middle.alias("b")), F.struct((middle + 1).alias("a"), F.col("hi").alias("b"))))
    most, least = F.least("off", F.col("half.b")), F.greatest(F.col("off") - F.length("context") + length, F.col("half.a"))
    cut = kinds.where("lo < hi").withColumn("half", half).withColumn("most", most).withColumn("least", least).where("least <= most")
    cut = cut.select(F.col("half.a").alias("lo"), F.col("half.b").alias("hi"), F.col("most").alias("off"), "doc", "tk", (F.col("start") + F.col("off") - F.col("most")).alias("start"),
                     F.expr(f"substring(context, cast(off - most + 1 as int), cast(most - least + {length} as int))").alias("context"), "group")
    held = F.expr(f"substring(context, cast(off - lo + 1 as int), cast(lo + {length} - hi as int))")
    return cut.withColumn("group", F.xxhash64("group", "lo", "hi", held))


def _reached(rows: DataFrame, length: int) -> DataFrame:
    """(doc, tk, start, end): what repeats of the different places (group, off, doc, tk, start, context) of each group, none of
    which has more than `MEMBERS`."""
    schema = "doc bigint, tk bigint, start bigint, end bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[dict] = []

        def settle() -> None:
            if len(held) > 1:
                held.sort(key=lambda x: (x[2], x[4] + x[1], x[3]))  # by document and place of the k-gram
                at = [(x[2], x[4] + x[1]) for x in held]
                found = covered([x[5][x[1] :] for x in held], [x[5][: x[1]][::-1] for x in held], length, at if len(set(at)) < len(at) else None)
                out.extend({"doc": x[2], "tk": x[3], "start": x[4] + x[1] - f[0], "end": x[4] + x[1] + f[1]} for x, f in zip(held, found, strict=True) if f)
            held.clear()

        key = None
        types = pa.schema([(c, pa.int64()) for c in ("doc", "tk", "start", "end")])
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != key:
                    settle()
                    key = row[0]
                held.append(row)
            yield pa.RecordBatch.from_pylist(out, types)
            out.clear()
        settle()
        yield pa.RecordBatch.from_pylist(out, types)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select("group", "off", "doc", "tk", "start", "context").repartition(parts, "group").sortWithinPartitions("group").mapInArrow(run, schema)


def _frequent(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """The same for k-grams with many members, halved until few are left.

    A group's windows start `lo` to `hi` bytes before the k-gram. Equal surroundings are merged by an aggregate, all but the first
    are repeats as a whole. Up to `MEMBERS` different ones are solved in a task; more are cut to either half of the offsets and
    grouped by the bytes that all windows of the half hold, which equal windows share. Groups of one offset hold equal windows,
    so halving ends; a place has at most one row in either half.
    """
    place = F.struct("doc", "start", "tk")
    part = rows.select(F.lit(0).cast("bigint").alias("lo"), F.lit(length - gram).cast("bigint").alias("hi"), "off", "doc", "tk", "start", "context", F.col("h").alias("group"))
    found = []
    while True:
        named = part.withColumn("name", F.unhex(F.md5("context")))
        kinds = land(named.groupBy("group", "lo", "hi", "off", "name").agg(F.min(place).alias("p"), F.first("context").alias("context"), F.count(F.lit(1)).alias("n"))
                     .select("group", "lo", "hi", "off", "name", "p.doc", "p.start", "p.tk", "context", "n"), "kinds")
        firsts = kinds.where("n > 1").select("group", "lo", "hi", "off", "name", F.col("doc").alias("doc1"), F.col("start").alias("start1"))
        ends = named.withColumn("end", F.col("start") + F.length("context")).drop("context")
        whole = ends.join(firsts, ["group", "lo", "hi", "off", "name"]).where("doc <> doc1 or start <> start1")
        large = land(kinds.groupBy("group").agg(F.count(F.lit(1)).alias("places")).where(F.col("places") > MEMBERS).select("group"), "large")
        found += [whole.select("doc", "tk", "start", "end"), _reached(kinds.join(F.broadcast(large), "group", "left_anti"), length)]
        if large.isEmpty():
            return reduce(DataFrame.union, found)
        part = land(_halves(kinds.join(F.broadcast(large), "group"), length), "halves")


def names(id_col: str = "doc_id", text: str = "text") -> list:
    """The columns doc and tk by which `remove_repeats` names a row."""
    return [F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST)).alias("doc"), F.xxhash64(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("tk")]


def shortened(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` with their texts cut; bytes of a character that was cut apart go with it. Null texts stay null."""
    cut = remove_repeats(docs, id_col, text)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([b.decode("utf-8", "ignore") for b in batch.column(2).to_pylist()], pa.string())], ["doc", "tk", "shorter"])

    cut = cut.select("doc", "tk", "kept").mapInArrow(spell, "doc bigint, tk bigint, shorter string")
    doc, tk = names(id_col, text)
    joined = docs.select(F.struct("*").alias("row"), doc, tk).join(cut, ["doc", "tk"], "left")
    return joined.select(*(F.coalesce("shorter", F.col("row")[c]).alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc, tk, spans, kept) for each document that holds repeated strings: the removed spans and the bytes that stay.

    Documents that do not come back keep all their bytes. `doc` is the id (null ids: 2^63 - 1, after all others), `tk` is
    xxhash64 of the text's bytes; the pair names a row of `docs`. Null texts count as empty. Rows that repeat an id and a text
    are one document; texts that share an id are compared by start. Other columns are left out.
    """
    keyed = _keyed(docs, id_col, text)
    again = not keyed.groupBy("doc", "tk").count().where("count > 1").isEmpty()
    both = land(shared(keyed, length, gram), "shared")
    often = land(both.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MEMBERS).select("h", F.lit(True).alias("often")), "often")
    told = both.where("lead").join(often, "h", "left")
    wanted = told.groupBy("doc").agg(F.collect_list(F.when(F.col("often").isNull(), F.col("h"))).alias("few"), F.collect_list(F.when(F.col("often"), F.col("h"))).alias("many"))
    touched = land_by(keyed.join(land(wanted, "wanted"), "doc").select("doc", "tk", "text", "few", "many"), "touched", "doc")
    solved = land(_solve(places(touched, length, gram), length), "solved")
    spans = solved.where(F.col("kind") == SPAN).select("doc", "tk", "start", "end")
    if not often.isEmpty():
        spans = spans.union(_frequent(solved.where(F.col("kind") == MANY), length, gram))
    listed = spans.groupBy("doc").agg(F.collect_set(F.struct("tk", "start", "end")).alias("spans"))
    schema = "doc bigint, tk bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.slices(batches):
            chosen, merged, kept = [], [], []
            for i, (tk, body, given) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True)):
                raw, runs, parts, at = body.as_buffer().to_pybytes(), [], [], 0
                for s, e in sorted((x["start"], x["end"]) for x in given if x["tk"] == tk):
                    if runs and s <= runs[-1]["end"]:
                        runs[-1]["end"] = max(runs[-1]["end"], e)
                    else:
                        runs.append({"start": s, "end": e})
                if not runs:
                    continue
                for x in runs:
                    parts.append(raw[at : x["start"]])
                    at = x["end"]
                chosen.append(i)
                merged.append(runs)
                kept.append(b"".join([*parts, raw[at:]]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(chosen, pa.int64())) for c in (0, 1)), pa.array(merged, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], ["doc", "tk", "spans", "kept"])

    left = touched.select("doc", "tk", "text").join(listed, "doc").mapInArrow(cut, schema)
    return left.dropDuplicates(["doc", "tk"]) if again else left
