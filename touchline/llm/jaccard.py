"""Operator 6: documents whose sets of word shingles have a Jaccard similarity of at least 0.8, and their components.

A partition of the universe, by size band, finds the candidates. Two sets of sizes a and b that link differ in at most
H(a, b) shingles. Each band cuts the universe of shingles into segments; of the segments that hold anything of a set, more
than H agree in full with a partner's unless all others differ, so a set with more than H such segments shares one with
every partner. A set's signatures are the hashes of its segments, under its own band and the one below.

Which signatures a set needs is a matter of cost:
- first only shingles that few documents have are dealt to segments, so that common passages make no candidates;
- a set with too few of those also deals all its shingles;
- one with too few filled segments even so adds the one-deletion neighbourhood of each segment, which counts double;
- and if that is too little, its empty segments as well.
Each step is taken by both sets of a pair or isn't needed, so none is missed.

Sets with equal signatures are candidates of the member that is in most such groups, unless sizes or sketches (counts of
their shingles by hash) prove them too far apart; whole sets of 64-bit hashes decide. Members of one group that are in
different components afterwards are compared with each other too, in blocks, sketches first. Equal sets are one node from
the start, so copies cost nothing but their own row.

Words are runs of other than ASCII white space, A-Z lower-cased. Fewer than five words form one shingle. Null and empty
texts, and texts of white space, have no shingle and link with nothing. Rows with equal ids are documents of their own;
null ids count only where a component has no other. Very long texts are sets like others; an empty table gives no rows;
extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import LOWER, Hasher, give_back, group_starts, mix, text_blocks, words
from .components import components
from .packets import gather, pack, split, unpack
from .shared import asked_only, lean, lookup, settle, table, tasks

WORDS = 5
#: Similarity of at least NUMERATOR / 100.
NUMERATOR = 80
#: A shingle is common if this share of the documents has it.
COMMON = 0.0005
#: No shingle of fewer documents is common.
FEW = 20
#: Documents whose shingles a task counts together; it reports those that half the share of them have.
TOGETHER = 4_000
NO_ID = np.iinfo(np.int64).max
#: Signatures that a task holds before it sends them off.
HELD = 500_000

IS_SIGNED, IS_NODE = 0, 1
PACKET = "target int, kind int, blob binary"
SIGNED, NODES = ["<u4", "<u8"], ["<i8", "<i8", "<u8", "<u4", "<u4"]


def shingle_sets(column, size: int = WORDS) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of each text) of consecutive ranges of a text column."""
    letters, order = Hasher(), Hasher(base=0xD1342543DE82EF95)
    for i, j, data, offsets in text_blocks(column):
        data = LOWER[data]
        starts, ends, of = words(data, offsets)
        none = np.empty(0, np.uint64)
        if not len(starts):
            yield i, [none] * (j - i)
            continue
        order.load(letters.load(data).slices(starts, ends))
        runs = order.windows(size)
        cut = np.searchsorted(of, np.arange(j - i + 1)).tolist()
        out = []
        for a, b in zip(cut, cut[1:]):
            if b - a >= size:
                out.append(np.unique(runs[a : b - size + 1]))
            else:
                out.append(order.slices(np.array([a]), np.array([b])) if b > a else none)
        yield i, out


def node_of(shingles: np.ndarray) -> int:
    """A set's hash; equal sets are one node."""
    return int(mix(np.array([mix(shingles ^ np.uint64(0x2545F4914F6CDD1D)).sum(dtype=np.uint64) + np.uint64(len(shingles))]))[0])


class Bands:
    """Size bands such that a set's partners are in its own band or a neighbouring one, and their numbers of segments."""

    def __init__(self, numerator: int = NUMERATOR, most: int = 1 << 26):
        self.numerator = numerator
        self.lows = [1]
        while self.lows[-1] <= most:
            self.lows.append(self.lows[-1] * 100 // numerator + 1)
        self.tops = np.array([b - 1 for b in self.lows[1:]], np.int64)
        self.segments = np.maximum(1, (self.tops * 0.27).astype(np.int64) + 2)
        self.lows = np.array(self.lows, np.int64)
        #: The least size that can have a larger partner.
        self.least = next(n for n in range(1, 1000) if n * 100 // numerator > n)

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.lows, n, "right") - 1

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Shingles that two linked sets of these sizes have on one side only, at most."""
        return (a + b) * (100 - self.numerator) // (100 + self.numerator)

    def differ_most(self, n: np.ndarray, band: np.ndarray) -> np.ndarray:
        """The most for any partner under this band: in a set's own band the larger sets, in the one below its sets."""
        own = self.of(n) == band
        return np.where(own, self.differ(n, n * 100 // self.numerator), self.differ(n, np.minimum(n, self.tops[band])))


def signatures(sets: list[np.ndarray], common: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of sets, and the set of each."""
    n = np.array([len(s) for s in sets], np.int64)
    # below four shingles only equal sets link
    rows = np.flatnonzero(n >= bands.least)
    if not len(rows):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    band = bands.of(n[rows])
    lower = band > 0
    member = np.concatenate((rows, rows[lower]))
    band = np.concatenate((band, band[lower] - 1))
    out: list[tuple[np.ndarray, np.ndarray]] = []
    rare = [s if not len(common) else s[~_within(s, common)] for s in (sets[r] for r in rows)]
    by_row = dict(zip(rows.tolist(), rare))
    most = bands.differ_most(n[member], band)
    filled = _deal([by_row[m] for m in member.tolist()], member, band, bands, 1, out)
    short = filled <= most
    if short.any():
        member, band, most = member[short], band[short], most[short]
        own = [sets[m] for m in member.tolist()]
        filled = _deal(own, member, band, bands, 2, out)
        short = filled <= most
        if short.any():
            member, band, most = member[short], band[short], most[short]
            own = [sets[m] for m in member.tolist()]
            points = _deal(own, member, band, bands, 3, out, deletions=True)
            short = points <= most
            if short.any():
                _deal([own[i] for i in np.flatnonzero(short)], member[short], band[short], bands, 4, out, deletions=True, empty=True)
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def _within(values: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_, values)
    return sorted_[np.minimum(at, len(sorted_) - 1)] == values


def _deal(sets: list[np.ndarray], member: np.ndarray, band: np.ndarray, bands: Bands, level: int, out: list, deletions: bool = False, empty: bool = False) -> np.ndarray:
    """Add the signatures of one level to out; returns the points of each set: one for each filled segment, with deletions two for each of two shingles or more."""
    m = bands.segments[band]
    base = np.cumsum(m) - m
    total = int(m.sum())
    size = np.array([len(s) for s in sets], np.int64)
    of = np.repeat(np.arange(len(sets)), size)
    flat = np.concatenate(sets) if len(sets) else np.empty(0, np.uint64)
    salt = mix(band.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level if level < 3 else 3))
    slot = base[of] + (mix(flat ^ salt[of]) % m[of].astype(np.uint64)).astype(np.int64)
    code = mix(flat + np.uint64(0x632BE59BD9B4E019))
    sums = np.zeros(total, np.uint64)
    np.add.at(sums, slot, code)
    count = np.bincount(slot, minlength=total)
    owner = np.repeat(np.arange(len(sets)), m)
    place = mix(salt[owner] + np.arange(total, dtype=np.uint64) - base[owner].astype(np.uint64) + np.uint64(level * 0xC2B2AE3D27D4EB4F % 2**64))
    sign = lambda s, c, p: mix(s + p + c.astype(np.uint64) * np.uint64(0xFF51AFD7ED558CCD))
    kept = np.flatnonzero(count > 0 if not empty else count >= 0)
    out.append((sign(sums[kept], count[kept], place[kept]), member[owner[kept]]))
    if deletions:
        kept = np.flatnonzero(count[slot] > (0 if empty else 1))
        at = slot[kept]
        out.append((sign(sums[at] - code[kept], count[at] - 1, place[at]), member[of[kept]]))
    points = np.bincount(owner[count > 0], minlength=len(sets))
    return points + (np.bincount(owner[count > 1], minlength=len(sets)) if deletions else 0)


def common_shingles(df: DataFrame, text: str, share: float = COMMON) -> np.ndarray:
    """Shingles of at least about `share` of the documents, sorted. There can't be more than a mean set's size over `share` of them, whatever the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        docs = 0

        def flush() -> pa.RecordBatch:
            found, count = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint64), np.empty(0, int))
            told = count >= max(3, int(share / 2 * docs))
            return pa.RecordBatch.from_pydict({"shingle": np.append(found[told].astype(np.int64), 0), "n": np.append(count[told], 0).astype(np.int64), "docs": np.append(np.zeros(int(told.sum()), np.int64), docs)})

        for batch in batches:
            for _, sets in shingle_sets(batch.column(0)):
                held += sets
                docs += len(sets)
                if docs >= TOGETHER:
                    yield flush()
                    held.clear()
                    docs = 0
        if docs:
            yield flush()

    counted = df.select(text).mapInArrow(run, "shingle long, n long, docs long").groupBy("shingle").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counted = settle(counted)
    docs = counted.agg(F.sum("docs")).first()[0] or 0
    rows = counted.where((F.col("n") >= max(float(FEW), share * docs)) & (F.col("docs") == 0)).select("shingle").toArrow()
    return np.sort(rows.column("shingle").to_numpy().astype(np.int64).astype(np.uint64))


def _rows(*packets: tuple[int, tuple[list[int], list[bytes]]]) -> Iterator[pa.RecordBatch]:
    for kind, (targets, blobs) in packets:
        if targets:
            yield pa.RecordBatch.from_arrays([pa.array(targets, pa.int32()), pa.array([kind] * len(targets), pa.int32()), pa.array(blobs, pa.binary())], names=["target", "kind", "blob"])


def _nodes(doc: np.ndarray, tie: np.ndarray, node: np.ndarray, size: np.ndarray, sketches: list[bytes], n: int) -> tuple[list[int], list[bytes]]:
    """Packets of documents by their node: columns, and the sketches one after another."""
    target = (node % np.uint64(n)).astype(np.int64)
    order = np.argsort(target, kind="stable")
    edge = np.append(np.flatnonzero(group_starts(target[order])), len(order)).tolist()
    blobs = []
    for a, b in zip(edge, edge[1:]):
        mine = order[a:b]
        head = pack([doc[mine], tie[mine], node[mine], size[mine], np.array([len(sketches[k]) for k in mine], "<u4")])
        blobs.append(np.array([len(head)], "<i8").tobytes() + head + pack([np.frombuffer(b"".join(sketches[k] for k in mine), np.uint8)]))
    return target[order[edge[:-1]]].tolist(), blobs


def _read_nodes(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    cut = 8 + int(np.frombuffer(blob[:8], "<i8")[0])
    doc, tie, node, size, width = unpack(blob[8:cut], NODES)
    ends = np.concatenate(([0], np.cumsum(width))).astype(np.int32)
    return doc, node, size, tie, pa.BinaryArray.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(ends), pa.py_buffer(unpack(blob[cut:], ["u1"])[0].tobytes())])


def sign(common, n: int):
    """From rows (doc, tie, text) to packets of signatures, and of each document's node, size and sketch (of equal ones in a task, the first's)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands()
        frequent = common.value
        held: list[tuple[np.ndarray, np.ndarray]] = []
        docs: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]] = []
        seen: set[int] = set()

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                sig, node = (np.concatenate(x) for x in zip(*held))
                yield from _rows((IS_SIGNED, split((sig % np.uint64(n)).astype(np.int64), [(sig >> np.uint64(32)).astype("<u4"), node])))
            if docs:
                doc, tie, node, size = (np.concatenate(x) for x in list(zip(*docs))[:4])
                yield from _rows((IS_NODE, _nodes(doc, tie, node, size, [s for x in docs for s in x[4]], n)))
            held.clear()
            docs.clear()
            give_back()

        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)
            ties = batch.column(1).to_numpy()
            for i, sets in shingle_sets(batch.column(2)):
                size = np.array([*map(len, sets)], "<u4")
                node = np.array([node_of(s) for s in sets], np.uint64)
                fresh = [k for k, x in enumerate(node.tolist()) if x not in seen and not seen.add(x)]
                sketches = [b""] * len(sets)
                for k in fresh:
                    sketches[k] = sketch(sets[k]) if size[k] >= bands.least else b""
                docs.append((ids[i : i + len(sets)], ties[i : i + len(sets)], node, size, sketches))
                sig, of = signatures([sets[k] for k in fresh], frequent, bands)
                held.append((sig, node[np.array(fresh, int)[of]] if len(of) else np.empty(0, np.uint64)))
                if sum(len(x[0]) for x in held) > HELD:
                    yield from flush()
                if len(seen) > 1_000_000:
                    seen.clear()
        yield from flush()

    return run


#: What a shard tells: documents (doc, node, n, tie, sketch), pairs (a, b) of groups of two, members (group, node) of larger groups.
TOLD_SCHEMA = "kind int, a long, b long, n int, tie long, data binary"
IS_DOC, IS_PAIR, IS_MEMBER = range(3)


def meet():
    """From packets to documents, the pairs that alone have a signature in common, and members of larger groups."""

    def table_of(kind: int, a: np.ndarray, b: np.ndarray, n: np.ndarray | None = None, tie: np.ndarray | None = None, data: pa.Array | None = None) -> Iterator[pa.RecordBatch]:
        step = 100_000 if data is None else 10_000
        for i in range(0, len(a), step):
            size = len(a[i : i + step])
            columns = [np.full(size, kind, np.int32), a[i : i + size].astype(np.int64), b[i : i + size].astype(np.int64), *((x[i : i + size] if x is not None else np.zeros(size)).astype(t) for x, t in ((n, np.int32), (tie, np.int64)))]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.nulls(size, pa.binary()) if data is None else data.slice(i, size)], names=["kind", "a", "b", "n", "tie", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed: list[bytes] = []
        for batch in batches:
            for kind, blob in zip(batch.column(1).to_numpy(), batch.column(2)):
                if kind == IS_SIGNED:
                    signed.append(blob.as_py())
                else:
                    yield from table_of(IS_DOC, *_read_nodes(blob.as_py()))
        sig, node = gather(signed, SIGNED)
        signed.clear()
        if not len(sig):
            return
        order = np.argsort(sig, kind="stable")
        sig = sig[order]
        new = group_starts(sig)
        many = ~new
        many[:-1] |= ~new[1:]
        sig, node = sig[many], node[order[many]]
        order = np.lexsort((node, sig))
        sig, node = sig[order], node[order]
        fresh = group_starts(sig, node)
        sig, node = sig[fresh], node[fresh]
        if not len(sig):
            return
        new = group_starts(sig)
        group = np.cumsum(new) - 1
        head = np.flatnonzero(new)
        size = np.bincount(group)
        two = head[size == 2]
        pairs = np.column_stack((node[two], node[two + 1]))
        pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))]
        pairs = pairs[group_starts(pairs[:, 0], pairs[:, 1])] if len(pairs) else pairs
        yield from table_of(IS_PAIR, pairs[:, 0], pairs[:, 1])
        # groups of equal members are told once
        name = np.add.reduceat(mix(node ^ np.uint64(0x94D049BB133111EB)), head)
        first = np.zeros(len(head), bool)
        first[np.unique(name, return_index=True)[1]] = True
        told = (first & (size > 2))[group]
        yield from table_of(IS_MEMBER, name[group][told], node[told])
        give_back()

    return run


#: Counts of shingles by hash, for a bound on how far two sets differ: as many counts as LONG for sets larger than MANY.
SHORT, LONG, MANY = 256, 1024, 500
#: Sets that a hub is compared with in one place, and members of a group that are compared in one.
SALT, MEMBERS = 256, 2_000
IS_HUB, IS_OTHER = range(2)
SHIPPED = "to long, salt int, role int, node long, data binary"


def sketch(shingles: np.ndarray) -> bytes:
    width = SHORT if len(shingles) <= MANY else LONG
    return np.minimum(np.bincount((shingles >> np.uint64(40)).astype(np.int64) & (width - 1), minlength=width), 255).astype(np.uint8).tobytes()


def apart(sketches_a: list[bytes], sketches_b: list[bytes]) -> np.ndarray:
    """For each pair of sketches, the shingles that the two sets have on one side only, at least. Counts above 255 count as 255, which lowers the bound only."""
    out = np.zeros(len(sketches_a), np.int64)
    narrow = np.array([min(len(x), len(y)) for x, y in zip(sketches_a, sketches_b)], np.int64)
    for width in np.unique(narrow).tolist():
        rows = np.flatnonzero(narrow == width)
        x, y = (_folded([s[i] for i in rows.tolist()], width) for s in (sketches_a, sketches_b))
        out[rows] = np.abs(x - y).sum(axis=1)
    return out


def _folded(sketches: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(sketches), width), np.int16)
    wide = np.array([len(x) for x in sketches])
    for w in np.unique(wide).tolist():
        rows = np.flatnonzero(wide == w)
        flat = np.frombuffer(b"".join(sketches[i] for i in rows.tolist()), np.uint8).reshape(len(rows), -1, width)
        out[rows] = flat.sum(axis=1, dtype=np.int16)
    return out


def likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) that neither sizes nor sketches prove too far apart. nodes: (node, n, data)."""
    bands = Bands()
    side = lambda s: nodes.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("data").alias(f"data_{s}"))
    sized = lookup(lookup(pairs.select("a", "b"), side("a").drop("data_a"), "a"), side("b"), "b").where(f"100 * least(n_a, n_b) >= {NUMERATOR} * greatest(n_a, n_b)")
    both = lookup(sized, side("a").drop("n_a"), "a").select("a", "b", "n_a", "n_b", "data_a", "data_b")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 512):
                part = batch.slice(i, 512)
                n_a, n_b = (part.column(c).to_numpy().astype(np.int64) for c in (2, 3))
                near = apart(part.column(4).to_pylist(), part.column(5).to_pylist()) <= bands.differ(n_a, n_b)
                yield part.select(["a", "b"]).filter(pa.array(near))

    return settle(both.mapInArrow(test, "a long, b long"))


def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (node, places, text) to each place's copy of the set."""
    for batch in batches:
        nodes, places = batch.column(0).to_pylist(), batch.column(1)
        for i, sets in shingle_sets(batch.column(2)):
            rows = []
            for k, s in enumerate(sets):
                if np.uint64(node_of(s)).astype(np.int64) == nodes[i + k]:
                    data = s.tobytes()
                    rows += [(p["to"], p["salt"], p["role"], nodes[i + k], data) for p in places[i + k].as_py()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["to", "salt", "role", "node", "data"])


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From whole sets of 64-bit hashes, sorted by place and role, to the links of each hub."""
    place, hub = None, np.empty(0, np.uint64)
    for batch in batches:
        role = batch.column(2).to_numpy()
        rows: list[tuple] = []
        to, salt, node, data = (batch.column(i) for i in (0, 1, 3, 4))
        for i in range(len(batch)):
            here = to[i].as_py(), salt[i].as_py()
            if role[i] == IS_HUB:
                place, hub = here, np.frombuffer(data[i].as_py(), np.uint64)
            elif place == here:
                other = np.frombuffer(data[i].as_py(), np.uint64)
                both = np.intersect1d(hub, other, assume_unique=True).size
                if 100 * both >= NUMERATOR * (len(hub) + len(other) - both):
                    rows.append((here[0], node[i].as_py()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["a", "b"])


def verified(df: DataFrame, pairs: DataFrame, nodes: DataFrame, key: str, text: str) -> DataFrame:
    """Links among distinct pairs (a, b), where many pairs may share an a. nodes: (node, doc), a document that has the node's set. A set is sent to each of its hubs once, and a hub's own set to as many places as its partners fill."""
    n = tasks(df.sparkSession)
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SALT).cast("int").alias("salts"))
    others = lookup(pairs, salts, "a").select(F.col("b").alias("node"), F.col("a").alias("to"), F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(IS_OTHER).alias("role"))
    hubs = salts.select(F.col("a").alias("node"), F.col("a").alias("to"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(IS_HUB).alias("role"))
    wanted = others.unionByName(hubs).groupBy("node").agg(F.collect_list(F.struct("to", "salt", "role")).alias("places"))
    wanted = settle(wanted.join(nodes.select("node", "doc"), "node"))
    docs = df.select(F.coalesce(F.col(key), F.lit(int(NO_ID)).cast("long")).alias("doc"), F.col(text).alias("text"))
    # several rows may have the doc's id, and a set's first comer is enough
    found = asked_only(docs, wanted.select("doc"), ["doc"]).join(wanted, "doc").select("node", "places", "text")
    sent = found.mapInArrow(ship, SHIPPED).repartition(n, "to", "salt").sortWithinPartitions("to", "salt", "role", "node")
    return settle(sent.mapInArrow(compare, "a long, b long"))


def near_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From members of parts of groups (group, low, high, block, node, comp, n, data), sorted by part, to the pairs of different components that their sketches don't rule out. Part (low, high) holds two blocks of a group and compares one with the other, or one block with itself."""
    bands = Bands()
    held: list[pa.RecordBatch] = []
    asked: set[tuple[int, int]] = set()

    def flush(group: pa.Table) -> Iterator[pa.RecordBatch]:
        node, comp, n, block = (group.column(c).to_numpy() for c in ("node", "comp", "n", "block"))
        cross = group.column("low")[0].as_py() != group.column("high")[0].as_py()
        order = np.argsort(n, kind="stable")
        node, comp, n, block = node[order], comp[order], n[order].astype(np.int64), block[order]
        raw = [group.column("data")[int(i)].as_py() for i in order]
        counts = _folded(raw, SHORT)
        out: list[tuple[int, int]] = []
        for i in range(len(node)):
            # partners that are not smaller, up to the largest that can link
            j = np.arange(i + 1, int(np.searchsorted(n, n[i] * 100 // bands.numerator, "right")))
            j = j[comp[j] != comp[i]]
            if cross:
                j = j[block[j] != block[i]]
            if not len(j):
                continue
            most = bands.differ(n[i], n[j])
            close = np.abs(counts[j] - counts[i]).sum(1) <= most
            j, most = j[close], most[close]
            j = j[apart([raw[i]] * len(j), [raw[k] for k in j.tolist()]) <= most] if len(j) else j
            for k in j.tolist():
                pair = (int(min(node[i], node[k])), int(max(node[i], node[k])))
                if pair not in asked:
                    asked.add(pair)
                    out.append(pair)
        if len(asked) > 200_000:
            asked.clear()
        if out:
            a, b = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        key = np.array([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("group", "low", "high")])
        cut = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), len(batch)]
        for x, y in zip(cut, cut[1:]):
            if y > x and held and [held[-1].column(c)[0].as_py() for c in ("group", "low", "high")] != key[:, x].tolist():
                yield from flush(pa.Table.from_batches(held))
                held = []
            if y > x:
                held.append(batch.slice(x, y - x))
    if held:
        yield from flush(pa.Table.from_batches(held))
    give_back()


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, n_shingles, component_id, the least key that its links reach."""
    given = lambda c: F.when(F.col(c) < int(NO_ID), F.col(c))
    return classes(df, key, text).select(given("doc").alias(key), F.col("n").cast("long").alias("n_shingles"), given("low.doc").alias("component_id"))


def classes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc (its key, NO_ID for null), tie (a hash of its text), n (its shingles), low (doc and tie of the least document that its links reach)."""
    spark = lean(df.sparkSession)
    n = tasks(spark)
    common = spark.sparkContext.broadcast(common_shingles(df, text))
    sent = df.select(F.col(key).cast("long"), F.xxhash64(text).alias("tie"), text).mapInArrow(sign(common, n), PACKET)
    met = settle(sent.repartitionById(n, "target").mapInArrow(meet(), TOLD_SCHEMA))
    docs = met.where(F.col("kind") == IS_DOC).select(F.col("a").alias("doc"), F.col("b").alias("node"), "n", "tie", "data")
    nodes = settle(docs.where("n > 0").groupBy("node").agg(F.min(F.struct("doc", "tie")).alias("least"), F.first("n").alias("n"), F.max("data").alias("data")).select("node", "least", "least.doc", "n", "data"))
    members = settle(met.where(F.col("kind") == IS_MEMBER).select(F.col("a").alias("group"), F.col("b").alias("node")).distinct())
    # a group's hub is the member that is in most groups: of edited copies, the one that they were made of
    often = members.groupBy("node").agg(F.count(F.lit(1)).alias("groups"))
    hub = members.join(often, "node").groupBy("group").agg(F.max(F.struct("groups", "node")).getField("node").alias("a"))
    spokes = lookup(members, hub, "group").where("a <> node").select("a", F.col("node").alias("b"))
    pairs = settle(met.where(F.col("kind") == IS_PAIR).select("a", "b").unionByName(spokes).distinct())
    links = verified(df, likely(pairs, nodes), nodes, key, text)
    label = components(links)
    # members of one signature that are still apart; a large group is compared by pairs of blocks
    placed = members.join(label, "node", "left").select("group", "node", F.coalesce("comp", "node").alias("comp"))
    split_up = placed.groupBy("group").agg(F.min("comp").alias("least"), F.max("comp").alias("greatest"), F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("blocks")).where("least <> greatest").select("group", "blocks")
    blocked = lookup(placed, split_up, "group").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    parts = blocked.join(nodes.select("node", "n", "data"), "node").select("group", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "comp", "n", "data")
    more = parts.repartition(n, "group", "low", "high").sortWithinPartitions("group", "low", "high").mapInArrow(near_pairs, "a long, b long").distinct()
    tried = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = settle(more.join(tried, ["a", "b"], "left_anti"))
    if not more.isEmpty():
        again = verified(df, more, nodes, key, text)
        if not again.isEmpty():
            label = components(links.unionByName(again))
    least = settle(nodes.join(label, "node", "left").select("node", "least", F.coalesce("comp", "node").alias("comp")))
    lowest = least.groupBy("comp").agg(F.min("least").alias("low"))
    reach = lookup(least.select("node", "comp"), lowest, "comp").select("node", "low")
    found = lookup(docs.where("n > 0").select("doc", "tie", "node", "n"), reach, "node").select("doc", "tie", "n", "low")
    return found.unionByName(docs.where("n = 0").select("doc", "tie", "n", F.struct("doc", "tie").alias("low")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every document's shingles and component."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the document with the least id stays (of one id's, one text); repeated rows stay once."""
    found = classes(docs)
    kept = found.where((F.col("doc") == F.col("low.doc")) & (F.col("tie") == F.col("low.tie"))).select(F.col("doc").alias("key"), F.col("tie").alias("hash")).distinct()
    whole = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.coalesce(F.col("doc_id"), F.lit(int(NO_ID)).cast("long")).alias("key"), F.xxhash64("text").alias("hash"))
    return whole.join(kept, ["key", "hash"], "left_semi").dropDuplicates(["key", "hash"]).select("row.*")
