"""Operator 5: exact repeats of at least `least` bytes, by sharded enhanced suffix arrays.

Texts are UTF-8 bytes, and no match crosses a text. Every window of `least` bytes belongs to one seed: the k-gram with the
least hash in it. Equal windows have equal seeds, so the windows of one seed meet in one shard; what a run of windows of
one seed spans is its context.

1. Each task finds its seeds' contexts and folds equal ones into the first; the hashes of seed and context go to the
   seed's shard, which folds what is equal there. All but the first of folded contexts are repeats; the first carries a
   mark that it stands for several.
2. The bytes of contexts that are marked, or whose seed has others, go to the seed's shard, which builds a suffix array of
   the windows with common-prefix lengths and walks its interval tree by a stack: intervals of `least` or more whose
   occurrences differ to the left are the maximal repeats, reported with all occurrences; a marked context is an interval
   of its own. All but the first of each are repeats. A seed with very many contexts (one in a common passage's edge)
   would fill one shard, so each of its windows goes by its own hash instead, and meets its equals in a suffix array there.
3. Repeats are joined to their texts, and the bytes that they cover are cut out or reported. `groups` gives each maximal
   repeat with every place of it, those of folded contexts included.

Order is by (doc_id, start); null ids come first. Rows of one doc_id with different texts count as different documents,
by a hash of their text; a row repeated in full is the same document, and gets the same answer. Null text counts as
empty; texts of any length are worked on in overlapping parts. Folded contexts are told apart by hashes of 112 bits with
their seed's; whatever meets in a suffix array is compared byte by byte. An empty table gives no rows; columns other than
key and text pass through `without_repeats`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import BLOCK, Hasher, column_bytes, give_back, group_starts, least_in_windows, spans
from .packets import gather, pack, split, unpack
from .shared import lean, settle, table, tasks

LEAST = 100
SEED = 32
#: Contexts that a task holds before it sends them off.
HELD = 300_000
#: Contexts of one seed from which on its windows are dealt by themselves.
MANY = 1_000
#: Bytes of contexts in one suffix array.
ARRAY = 1 << 20
#: Bytes of a long text worked on at once.
LONG = 4 << 20

#: Columns of the packets: of contexts' hashes, of repeats, of contexts to resolve, of bytes.
HASHED = ["<u4", "<u2", "<u4", "<u2", "<i8", "<i8", "<u4", "u1", "u1"]
REPEATS = ["<i8", "<i8", "<u4", "<u4"]
OPEN = ["<u8", "u1", "<i8", "<i8", "<u4", "u1"]
#: Key, document, start, bytes, mark, and the start of the context that it lies in.
BYTES = ["<u8", "<i8", "<i8", "<u4", "<u4", "u1", "<u4"]
#: A folded context's place and the place of what it was folded into.
FOLDED = ["<i8", "<i8", "<u4", "<i8", "<i8", "<u4"]
PACKET = "target int, kind int, blob binary"
IS_HASHED, IS_REPEAT, IS_OPEN, IS_BYTES, IS_FOLDED = range(5)
#: Marks of a context: its seed has very many, and it stands for several.
HOT, TWICE = 1, 2


def contexts(data: np.ndarray, offsets: np.ndarray, hasher: Hasher, least: int = LEAST, seed: int = SEED):
    """Text, first window, number of windows, seed's hash and context's hash of each run of windows of one seed."""
    n = len(data)
    none = np.empty(0, np.int64)
    if n < least:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    kgrams = hasher.load(data).windows(seed)
    keys = (kgrams & ~np.uint64(0xFFFFFF)) | np.arange(len(kgrams), dtype=np.uint64)
    at = (least_in_windows(keys, least - seed + 1) & np.uint64(0xFFFFFF)).astype(np.int64)
    del keys
    crossing = np.zeros(n + 1, np.int32)
    np.add.at(crossing, np.maximum(offsets[1:] - least + 1, offsets[:-1]), 1)
    np.add.at(crossing, offsets[1:], -1)
    inside = np.cumsum(crossing)[: len(at)] == 0
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | ~inside[:-1]
    new &= inside
    first = np.flatnonzero(new)
    stop = np.ones(len(at), bool)
    stop[:-1] = (at[1:] != at[:-1]) | ~inside[1:]
    stop &= inside
    last = np.flatnonzero(stop)
    return np.searchsorted(offsets, first, "right") - 1, first, last - first + 1, kgrams[at[first]], hasher.slices(first, last + least)


def text_parts(column, least: int) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, first byte, bytes, offsets): ranges of texts, or overlapping parts of a long one."""
    data, offsets = column_bytes(column)
    for i, j in spans(offsets, BLOCK):
        a, b = int(offsets[i]), int(offsets[j])
        if b - a <= LONG:
            yield i, j, 0, data[a:b], offsets[i : j + 1] - a
        else:
            for s in range(a, b - least + 1, LONG):
                e = min(b, s + LONG + least - 1)
                yield i, j, s - a, data[s:e], np.array([0, e - s])
    give_back()


def maximal_repeats(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: int = LEAST, twice: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(length, positions) of every maximal repeat of `least` or more bytes among the slices starts..ends: strings that occur
    at two places or more, which no occurrence can extend to the left or right in common with all others. Slices marked in `twice` stand for several equal ones: such a slice is a repeat by itself, unless it is found within an interval of its length."""
    if not len(starts):
        return
    room = np.maximum(ends - starts - least + 1, 0)
    of = np.repeat(np.arange(len(starts)), room)
    at = np.arange(len(of)) - np.repeat(np.cumsum(room) - room, room) + starts[of]
    if not len(at):
        return
    # windows that occur once can't be in an interval
    hashes = Hasher(keep=2 * ARRAY).load(data).slices(at, at + least)
    order = np.argsort(hashes, kind="stable")
    new = group_starts(hashes[order])
    met = ~new
    met[:-1] |= ~new[1:]
    if twice is not None:
        met |= twice[of[order]] & (at[order] == starts[of[order]])
    pick = order[met]
    at, of = at[pick], of[pick]
    if not len(at):
        return
    # suffix array: sort by the bytes of the window, eight at a time
    words = [np.zeros(len(at), np.uint64) for _ in range(-(-least // 8))]
    for k in range(least):
        words[k // 8] = (words[k // 8] << np.uint64(8)) | data[at + k]
    same_limit = ends[of] - at
    # beyond the window, suffixes follow byte by byte to their slice's end
    order = np.lexsort(words[::-1])
    group = np.cumsum(group_starts(*(w[order] for w in words))) - 1
    order = _deepen(data, at, same_limit, order, group, least)
    at, of, limit = at[order], of[order], same_limit[order]
    prefix = np.zeros(len(at) + 1, np.int64)
    prefix[1:-1] = _common(data, at[:-1], at[1:], np.minimum(limit[:-1], limit[1:]))
    left = np.where(at > starts[of], data[np.maximum(at - 1, 0)].astype(np.int64), -1)
    if twice is not None:
        whole = twice[of] & (at == starts[of])
        for i in np.flatnonzero(whole & (prefix[:-1] < limit) & (prefix[1:] < limit)).tolist():
            yield int(limit[i]), at[i : i + 1]
    stack: list[list[int]] = []  # [length, first, left byte or -1 if they differ]
    mark = left.tolist()
    for i, depth in enumerate(prefix[1:].tolist()):
        first, lefts = i, mark[i]
        while stack and stack[-1][0] > depth:
            length, a, seen = stack.pop()
            seen = seen if seen == lefts and seen >= 0 else -1
            if seen < 0 and length >= least:
                yield length, at[a : i + 1]
            first, lefts = a, seen
        if stack and stack[-1][0] == depth:
            if stack[-1][2] != lefts:
                stack[-1][2] = -1
        elif depth >= least:
            stack.append([depth, first, lefts])


def _common(data: np.ndarray, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of the suffixes at a and b, up to limit."""
    got = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    while len(live):
        live = live[got[live] < limit[live]]
        live = live[data[a[live] + got[live]] == data[b[live] + got[live]]]
        got[live] += 1
    return got


def _deepen(data: np.ndarray, at: np.ndarray, limit: np.ndarray, order: np.ndarray, group: np.ndarray, depth: int) -> np.ndarray:
    """Sort suffixes of equal groups by what follows `depth` bytes."""
    while True:
        size = np.bincount(group)
        live = np.flatnonzero(size[group] > 1)
        live = live[group_rest(limit[order[live]], group[live], depth)]
        if not len(live):
            return order
        rows = order[live]
        nxt = np.where(limit[rows] > depth, data[np.minimum(at[rows] + depth, len(data) - 1)].astype(np.int64), -1)
        by = np.lexsort((nxt, group[live]))
        order = order.copy()
        order[live] = rows[by]
        fresh = np.zeros(len(order), np.int64)
        fresh[live[1:]] = (nxt[by][1:] != nxt[by][:-1]) & (group[live][1:] == group[live][:-1])
        group = np.cumsum(group_starts(group).astype(np.int64) + (fresh > 0) > 0) - 1
        depth += 1


def group_rest(limit: np.ndarray, group: np.ndarray, depth: int) -> np.ndarray:
    """Rows of groups in which some suffix goes on beyond depth."""
    if not len(group):
        return np.empty(0, np.int64)
    most = np.zeros(int(group.max()) + 1, np.int64)
    np.maximum.at(most, group, limit)
    return np.flatnonzero(most[group] > depth)


def _rows(*packets: tuple[int, tuple[list[int], list[bytes]]]) -> Iterator[pa.RecordBatch]:
    for kind, (targets, blobs) in packets:
        for i in range(0, len(targets), 64):
            yield pa.RecordBatch.from_arrays([pa.array(targets[i : i + 64], pa.int32()), pa.array([kind] * len(targets[i : i + 64]), pa.int32()), pa.array(blobs[i : i + 64], pa.binary())], names=["target", "kind", "blob"])


def _home(doc: np.ndarray, tie: np.ndarray, n: int) -> np.ndarray:
    return ((doc ^ tie) % n).astype(np.int64)


def _numbers(column) -> np.ndarray:
    return column.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False).astype(np.int64)


def _later(keys: list[np.ndarray], doc: np.ndarray, tie: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by keys, then place; which rows begin a group of equal keys; which lie at a later place than their group's first."""
    order = np.lexsort((at, tie, doc, *keys[::-1]))
    new = group_starts(*(k[order] for k in keys)) if len(order) else np.empty(0, bool)
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(order) else order
    d, t, a = doc[order], tie[order], at[order]
    return order, new, ~new & ((d != d[head]) | (t != t[head]) | (a != a[head]))


def _folded(order: np.ndarray, new: np.ndarray, later: np.ndarray, doc: np.ndarray, tie: np.ndarray, at: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Packets of what was folded, and into what."""
    own, into = order[later], order[np.flatnonzero(new)[np.cumsum(new) - 1][later]]
    return split(np.zeros(len(own), int), [doc[own], tie[own], at[own].astype("<u4"), doc[into], tie[into], at[into].astype("<u4")])


def find_contexts(least: int, seed: int, n: int, groups: bool = False):
    """Step 1 of a task: from rows (doc, tie, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(keep=LONG + least)
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            h1, h2, doc, tie, at, count = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order, new, later = _later([h1, h2], doc, tie, at)
            several = np.zeros(len(order), bool)
            several[order[np.flatnonzero(new)[np.cumsum(new) - 1][later]]] = True
            own = np.sort(order[new])
            gone = order[later]
            low, high = np.uint64(0xFFFFFFFF), np.uint64(0xFFFF)
            yield from _rows(
                (IS_HASHED, split((h1[own] % np.uint64(n)).astype(np.int64), [(h1[own] >> np.uint64(16) & low).astype("<u4"), (h1[own] >> np.uint64(48)).astype("<u2"), (h2[own] & low).astype("<u4"), (h2[own] >> np.uint64(32) & high).astype("<u2"), doc[own], tie[own], at[own].astype("<u4"), count[own].astype("u1"), several[own].astype("u1")])),
                (IS_REPEAT, split(_home(doc[gone], tie[gone], n), [doc[gone], tie[gone], at[gone].astype("<u4"), (count[gone] + least - 1).astype("<u4")])),
                *([(IS_FOLDED, _folded(order, new, later, doc, tie, at))] if groups else []),
            )

        for batch in batches:
            docs, ties = _numbers(batch.column(0)), _numbers(batch.column(1))
            for i, _, base, data, offsets in text_parts(batch.column(2), least):
                of, at, count, h1, h2 = contexts(data, offsets, hasher, least, seed)
                held.append((h1, h2, docs[i + of], ties[i + of], at - offsets[of] + base, count))
                if sum(len(x[0]) for x in held) > HELD:
                    yield from flush()
        if held:
            yield from flush()

    return run


def match_contexts(least: int, n: int, many: int, groups: bool = False):
    """Step 1 of a shard: from packets of contexts' hashes, repeats and contexts to resolve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: list[bytes] = []
        for batch in batches:
            kinds = batch.column(1).to_numpy()
            for kind, target, blob in zip(kinds, batch.column(0).to_pylist(), batch.column(2)):
                if kind == IS_HASHED:
                    blobs.append(blob.as_py())
                else:
                    yield from _rows((int(kind), ([target], [blob.as_py()])))
        low1, high1, low2, high2, doc, tie, at, count, several = gather(blobs, HASHED)
        blobs.clear()
        if not len(doc):
            return
        h1 = low1.astype(np.uint64) | high1.astype(np.uint64) << np.uint64(32)
        h2 = low2.astype(np.uint64) | high2.astype(np.uint64) << np.uint64(32)
        order, new, later = _later([h1, h2], doc, tie, at)
        give_back()
        gone = order[later]
        # the first of each context: marked if it stands for several, open if so or if its seed has others
        kept = order[new]
        twice = np.add.reduceat(later | (several[order] > 0), np.flatnonzero(new)) > 0
        seeds = np.cumsum(group_starts(h1[kept])) - 1
        size = np.bincount(seeds)[seeds]
        still = (size > 1) | twice
        kept, marks = kept[still], (np.where(size > many, HOT, 0) | np.where(twice, TWICE, 0))[still].astype("u1")
        home = _home(doc[kept], tie[kept], n)
        yield from _rows(
            (IS_REPEAT, split(_home(doc[gone], tie[gone], n), [doc[gone], tie[gone], at[gone], (count[gone].astype("<u4") + (least - 1)).astype("<u4")])),
            (IS_OPEN, split(home, [h1[kept], marks, doc[kept], tie[kept], at[kept], count[kept]])),
            *([(IS_FOLDED, _folded(order, new, later, doc, tie, at))] if groups else []),
        )

    return run


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], pa.RecordBatch | None]]:
    """Of a partition sorted by kind: first all packets, then batches of documents."""
    blobs: list[bytes] = []
    told = False
    for batch in batches:
        kinds = batch.column(batch.schema.get_field_index("kind")).to_numpy()
        packets = batch.filter(pa.array(kinds >= 0)).column(batch.schema.get_field_index("blob"))
        blobs += [b.as_py() for b in packets]
        docs = batch.filter(pa.array(kinds < 0))
        if len(docs):
            yield (blobs, None) if not told else ([], None)
            told = True
            yield [], docs


def _by_place(doc: np.ndarray, tie: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, dict[tuple[int, int], tuple[int, int]]]:
    """An order by place, and each document's rows in it."""
    order = np.lexsort((at, tie, doc))
    d, t = doc[order], tie[order]
    cut = np.flatnonzero(group_starts(d, t)) if len(order) else np.empty(0, int)
    return order, {(int(d[a]), int(t[a])): (a, b) for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(d)])}


def _distinct_windows(hashes: np.ndarray, doc: np.ndarray, tie: np.ndarray, at: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows to send on, and which equal, byte by byte, one that is sent and comes before them."""
    order, new, later = _later([hashes], doc, tie, at)
    head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    same = (windows[order] == windows[head]).all(axis=1)
    return order[new | ~same], order[later & same]


def fetch_contexts(least: int, n: int, groups: bool = False):
    """Step 2 of a task: from contexts to resolve, then documents; to contexts' bytes by seed, or windows' by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(keep=LONG + least)
        where: dict = {}
        seen: set[tuple[int, int]] = set()
        for blobs, docs in _documents(batches):
            if docs is None:
                if blobs:
                    h1, marks, doc, tie, at, count = gather(blobs, OPEN)
                    order, where = _by_place(doc, tie, at)
                    h1, marks, at, count = h1[order], marks[order], at[order].astype(np.int64), count[order].astype(np.int64)
                continue
            heads: list[tuple[np.ndarray, ...]] = []
            bodies: list[np.ndarray] = []
            hot: list[tuple[np.ndarray, ...]] = []
            ids, ties = _numbers(docs.column(docs.schema.get_field_index("doc"))), _numbers(docs.column(docs.schema.get_field_index("tie")))
            texts = docs.column(docs.schema.get_field_index("text"))
            for k, place in enumerate(zip(ids.tolist(), ties.tolist())):
                if place not in where or place in seen:
                    continue
                seen.add(place)
                rows = np.arange(*where[place])
                text = np.frombuffer((texts[k].as_py() or "").encode(), np.uint8)
                is_hot = (marks[rows] & HOT) > 0
                cold = rows[~is_hot]
                size = count[cold] + least - 1
                heads.append((h1[cold], np.full(len(cold), place[0]), np.full(len(cold), place[1]), at[cold], size, marks[cold], at[cold]))
                bodies.append(text[np.repeat(at[cold] - np.cumsum(size) + size, size) + np.arange(size.sum())])
                if is_hot.any():
                    rows = rows[is_hot]
                    begin = np.repeat(at[rows] - np.cumsum(count[rows]) + count[rows], count[rows]) + np.arange(count[rows].sum())
                    found = hasher.load(text).slices(begin, begin + least)
                    hot.append((found, np.full(len(begin), place[0]), np.full(len(begin), place[1]), begin, np.repeat(marks[rows], count[rows]), np.repeat(at[rows], count[rows]), text[begin[:, None] + np.arange(least)]))
            if hot:
                found, doc_, tie_, begin, mark, context, windows = (np.concatenate(x) for x in zip(*hot))
                if groups:
                    kept = np.arange(len(found))
                else:
                    kept, gone = _distinct_windows(found, doc_, tie_, begin, windows)
                    yield from _rows((IS_REPEAT, split(_home(doc_[gone], tie_[gone], n), [doc_[gone], tie_[gone], begin[gone].astype("<u4"), np.full(len(gone), least, "<u4")])))
                heads.append((found[kept], doc_[kept], tie_[kept], begin[kept], np.full(len(kept), least), mark[kept], context[kept]))
                bodies.append(windows[kept].ravel())
            if heads:
                columns = [np.concatenate(x) for x in zip(*heads)]
                data = np.concatenate(bodies)
                starts = np.cumsum(columns[4]) - columns[4]
                target = (columns[0] % np.uint64(n)).astype(np.int64)
                order = np.argsort(target, kind="stable")
                edge = np.append(np.flatnonzero(group_starts(target[order])), len(order)) if len(order) else np.zeros(1, int)
                for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                    mine = order[a:b]
                    size = columns[4][mine]
                    body = data[np.repeat(starts[mine] - np.cumsum(size) + size, size) + np.arange(size.sum())]
                    head = pack([c[mine].astype(t) for c, t in zip(columns, BYTES)])
                    yield from _rows((IS_BYTES, ([int(target[mine[0]])], [np.array([len(head)], "<i8").tobytes() + head + pack([body])])))

    return run


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Of a shard's packets: key, document, start, size, mark and context of each slice, its place in the bytes, and the bytes, in ranges of whole keys of about ARRAY bytes."""
    parts: list[tuple[list[np.ndarray], np.ndarray]] = []
    for batch in batches:
        for blob in batch.column(2):
            raw = blob.as_py()
            cut = 8 + int(np.frombuffer(raw[:8], "<i8")[0])
            parts.append((unpack(raw[8:cut], BYTES), unpack(raw[cut:], ["u1"])[0]))
    if not parts:
        return
    columns = [np.concatenate([p[0][i] for p in parts]) for i in range(len(BYTES))]
    data = np.concatenate([p[1] for p in parts])
    parts.clear()
    h1, doc, tie, at, size, marks, context = columns
    size = size.astype(np.int64)
    starts = np.cumsum(size) - size
    order = np.argsort(h1, kind="stable")
    edge = np.append(np.flatnonzero(group_starts(h1[order])), len(order))
    total = np.concatenate(([0], np.cumsum(size[order])))
    g = 0
    while g < len(edge) - 1:
        e = max(g + 1, int(np.searchsorted(total[edge], total[edge[g]] + ARRAY, "right")) - 1)
        rows = order[edge[g] : edge[e]]
        g = e
        lengths = size[rows]
        begin = np.cumsum(lengths) - lengths
        text = data[np.repeat(starts[rows] - begin, lengths) + np.arange(lengths.sum())]
        yield doc[rows], tie[rows], at[rows].astype(np.int64), lengths, (marks[rows] & TWICE) > 0, context[rows], begin, text


def resolve(least: int, n: int):
    """Step 2 of a shard: from bytes to repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def kept() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kinds = batch.column(1).to_numpy()
                passed.append(batch.filter(pa.array(kinds == IS_REPEAT)))
                yield batch.filter(pa.array(kinds == IS_BYTES))

        passed: list[pa.RecordBatch] = []
        for doc, tie, at, lengths, twice, _, begin, text in _slices(kept()):
            yield from passed
            passed.clear()
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for length, places in maximal_repeats(text, begin, begin + lengths, least, twice):
                if len(places) < 2:
                    continue
                row = np.searchsorted(begin, places, "right") - 1
                pos = at[row] + places - begin[row]
                first = np.lexsort((pos, tie[row], doc[row]))[0]
                after = (doc[row] != doc[row[first]]) | (tie[row] != tie[row[first]]) | (pos != pos[first])
                out.append((row[after], pos[after], np.full(int(after.sum()), length)))
            if out:
                row, pos, length = (np.concatenate(x) for x in zip(*out))
                yield from _rows((IS_REPEAT, split(_home(doc[row], tie[row], n), [doc[row], tie[row], pos.astype("<u4"), length.astype("<u4")])))
        yield from passed
        give_back()

    return run


GROUP = "group_id long, length long, doc long, tie long, context long, shift long"


def name_groups(least: int):
    """From bytes to the places of every maximal repeat: its number is a hash of its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, tie, at, lengths, twice, context, begin, text in _slices(batches):
            rows: list[tuple[np.ndarray, ...]] = []
            for length, places in maximal_repeats(text, begin, begin + lengths, least, twice):
                row = np.searchsorted(begin, places, "right") - 1
                number = int.from_bytes(hashlib.blake2b(text[places[0] : places[0] + length].tobytes(), digest_size=8).digest(), "little", signed=True)
                rows.append((np.full(len(places), number), np.full(len(places), length), doc[row], tie[row], context[row], at[row] + places - begin[row] - context[row]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*rows)], names=[f.split()[0] for f in GROUP.split(", ")])

    return run


def groups(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, seed: int = SEED, many: int = MANY) -> DataFrame:
    """Every maximal repeat among the windows of one seed, with all its places: group_id, length, the document's key, start. Places in folded contexts come by joins from the contexts that they were folded into, so no group is gathered anywhere."""
    n = tasks(lean(df.sparkSession))
    found, bytes_ = _opened(df, n, key, text, least, seed, many, True)
    places = settle(bytes_.where(F.col("kind") == IS_BYTES).repartitionById(n, "target").mapInArrow(name_groups(least), GROUP))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(2):
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in gather([blob.as_py()], FOLDED)], names=["doc", "tie", "at", "doc_", "tie_", "context"])

    folded = settle(found.where(F.col("kind") == IS_FOLDED).mapInArrow(pairs, "doc long, tie long, at long, doc_ long, tie_ long, context long"))
    # a context folded in a task went into one that may have been folded in the shard
    again = folded.select(F.col("doc").alias("doc_"), F.col("tie").alias("tie_"), F.col("at").alias("context"), F.col("doc_").alias("doc__"), F.col("tie_").alias("tie__"), F.col("context").alias("context__"))
    folded = folded.join(again, ["doc_", "tie_", "context"], "left").select("doc", "tie", "at", *[F.coalesce(f"{c}__", f"{c}_" if c != "context" else c).alias(f"{c}_") for c in ("doc", "tie", "context")])
    others = places.select("group_id", "length", F.col("doc").alias("doc_"), F.col("tie").alias("tie_"), F.col("context").alias("context_"), "shift").join(folded, ["doc_", "tie_", "context_"])
    all_ = places.select("group_id", "length", "doc", "tie", (F.col("context") + F.col("shift")).alias("start")).unionByName(others.select("group_id", "length", "doc", "tie", (F.col("at") + F.col("shift")).alias("start")))
    null = F.lit(-(2**63)).cast("long")
    return all_.distinct().select("group_id", "length", F.when(F.col("doc") != null, F.col("doc")).alias(key), "start")


def _dealt(df: DataFrame, n: int, key: str, text: str) -> DataFrame:
    """Rows with their document's number, tie-breaker and home, apart from their own columns in `row`."""
    body = F.coalesce(F.col(text), F.lit(""))
    at = df.select(F.col(key).cast("long").alias("doc"), F.xxhash64(body).alias("tie"), body.alias("text"), F.struct(*[F.col(c) for c in df.columns if c != text]).alias("row"))
    null = F.lit(-(2**63)).cast("long")
    return at.withColumn("target", F.pmod(F.coalesce("doc", null).bitwiseXOR(F.col("tie")), F.lit(n).cast("long")).cast("int"))


def _opened(df: DataFrame, n: int, key: str, text: str, least: int, seed: int, many: int, groups: bool) -> tuple[DataFrame, DataFrame]:
    """Packets of step 1, and of the bytes that step 2 resolves."""
    docs = _dealt(df, n, key, text)
    sent = docs.select("doc", "tie", "text").mapInArrow(find_contexts(least, seed, n, groups), PACKET)
    found = settle(sent.repartitionById(n, "target").mapInArrow(match_contexts(least, n, many, groups), PACKET))
    asked = found.where(F.col("kind") == IS_OPEN).select("target", "kind", "blob", F.lit(None).cast("long").alias("doc"), F.lit(None).cast("long").alias("tie"), F.lit(None).cast("string").alias("text"))
    rows = docs.select("target", F.lit(-1).alias("kind"), F.lit(None).cast("binary").alias("blob"), "doc", "tie", "text")
    both = asked.unionByName(rows).repartitionById(n, "target").sortWithinPartitions(F.desc("kind"))
    return found, both.mapInArrow(fetch_contexts(least, n, groups), PACKET)


def repeats(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, seed: int = SEED, many: int = MANY) -> DataFrame:
    """Packets of all repeats, by their document's home; for `joined`."""
    n = tasks(lean(df.sparkSession))
    found, bytes_ = _opened(df, n, key, text, least, seed, many, False)
    resolved = settle(bytes_.repartitionById(n, "target").mapInArrow(resolve(least, n), PACKET))
    return found.where(F.col("kind") == IS_REPEAT).unionByName(resolved)


def joined(df: DataFrame, found: DataFrame, cut, schema: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """cut(text bytes, spans) gives a tuple of new columns for each document; spans are its maximal runs of repeated bytes, as an array of (start, end). Columns other than text come first."""
    n = tasks(lean(df.sparkSession))
    docs = _dealt(df, n, key, text)
    null = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema}
    packets = found.select("target", "kind", "blob", *[null[c] for c in ("doc", "tie", "text", "row")])
    rows = docs.select("target", F.lit(-1).alias("kind"), F.lit(None).cast("binary").alias("blob"), "doc", "tie", "text", "row")
    both = packets.unionByName(rows).repartitionById(n, "target").sortWithinPartitions(F.desc("kind"))
    made = T.StructType([T.StructField("row", docs.schema["row"].dataType), *T._parse_datatype_string(schema)])
    kinds = None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where: dict = {}
        nothing = np.empty((0, 2), np.int64)
        for blobs, docs in _documents(batches):
            if docs is None:
                if blobs:
                    doc, tie, at, size = gather(blobs, REPEATS)
                    order, where = _by_place(doc, tie, at)
                    at, end = at[order].astype(np.int64), at[order].astype(np.int64) + size[order]
                continue
            ids, ties = _numbers(docs.column(docs.schema.get_field_index("doc"))), _numbers(docs.column(docs.schema.get_field_index("tie")))
            texts = docs.column(docs.schema.get_field_index("text"))
            for i in range(0, len(docs), 256):
                out = []
                for k in range(i, min(i + 256, len(docs))):
                    span = nothing
                    if rows := where.get((int(ids[k]), int(ties[k]))):
                        a, b = at[rows[0] : rows[1]], np.maximum.accumulate(end[rows[0] : rows[1]])
                        new = np.concatenate(([True], a[1:] > b[:-1]))
                        span = np.column_stack((a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)]))
                    out.append(cut((texts[k].as_py() or "").encode(), span))
                part = docs.slice(i, 256)
                columns = [part.column(part.schema.get_field_index("row"))] + [pa.array(c, t) for c, t in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=made.names)

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in made.fields[1:]]
    return both.mapInArrow(run, made).select("row.*", *made.names[1:])


def digest(text: bytes, span: np.ndarray) -> tuple[int, int, int, str]:
    kept = hashlib.sha256()
    here = 0
    for a, b in span.tolist():
        kept.update(text[here:a])
        here = b
    kept.update(text[here:])
    return len(text), int((span[:, 1] - span[:, 0]).sum()), len(span), kept.hexdigest()


def cut_out(text: bytes, span: np.ndarray) -> tuple[str]:
    """The text without its repeats; a character that a span cuts stays whole."""
    out, here = [], 0
    for a, b in span.tolist():
        while a < len(text) and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        if b > a:
            out.append(text[here:a])
            here = b
    return (b"".join([*out, text[here:]]).decode(),)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: what every document loses to strings of 100 bytes that also start earlier."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return joined(docs, repeats(docs), digest, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document without its repeated bytes; n_chars follows."""
    cut = joined(docs, repeats(docs), cut_out, "text string")
    return cut.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)
