"""Operator 8: n-gram language-model scores from an Elias-Fano trie.

Tokens are runs of other than ASCII white space, A-Z lower-cased, and one end a text. Two marks stand before a text. The
first level of the trie holds the words' hashes in rising order, so that a word's rank is its id, with exact counts. Below
it, a path of two words leads to a pair, and one more to a triple; every one that occurs is kept, singletons too. On both
levels a rising sequence of pointers tells where a node's children begin, and a child is found as the successor of its
number in that range, relative to its context. All sequences are Elias-Fano coded; probabilities are 16-bit steps of their
logarithm, rounded down.

The trie is cut into shards, whose number follows the tokens. A pair and all that follows it lie in one shard, by its
first word; pairs of a word that alone would fill more than a shard's share are dealt to several by their second. Every
task counts a shard's triples and writes its file to the shared folder; scoring tasks map the files into memory and look
up each block's distinct words, pairs and triples.

With D the discount, a context's smoothed probability is max(c(context, w) - D, 0) / c(context), plus what that leaves of
the context's mass times the probability of the context without its first word; an unseen context leaves all. Words have
p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)), unknown ones with c = 0.

Null text counts as empty: its one token is the end. Without any text to learn from, N and V are 0 and p is 1 for all.
Very long texts are blocks of their own. Rows of equal ids are scored and learnt from one by one; columns other than the
key are not read.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import LOWER, Hasher, give_back, group_starts, mix, text_blocks, words
from .eliasfano import Children, Sequence, encode, padded
from .packets import gather, split
from .quality import fold
from .shared import lean, local_path, shared_folder, table

#: Tokens of a shard of pairs and triples, about, and parts of the input whose words share a shard.
SHARE, PARTS = 3_000_000, 4
DISCOUNT = 0.75
#: Steps of log10 probabilities, and bytes of text looked up at once.
STEP = 1 / 4096
BLOCK = 4 << 20
#: Entries that a task holds before it sends them off.
HELD = 1_500_000

END = mix(np.array([0xE4D], np.uint64))[0]
PACKET = "target int, blob binary"
COUNTED = ["<u8", "<u4"]
BUILT = "shard int, entries long, tokens long, name string, hot array<long>, used array<double>"


def tokens(data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of a block of texts in order, ends included, and the text of each."""
    n = len(offsets) - 1
    data = LOWER[data]
    starts, ends, of = words(data, offsets)
    found = hasher.load(data).slices(starts, ends) if len(starts) else np.empty(0, np.uint64)
    at = np.searchsorted(of, np.arange(n), "right")
    return np.insert(found, at, END), np.insert(of, at, np.arange(n))


def _shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _floor(shard: int, shards: int) -> int:
    """The least hash of a shard."""
    return -(-(shard << 32) // shards) << 32


def _packets(made: tuple[list[int], list[bytes]]) -> Iterator[pa.RecordBatch]:
    if made[0]:
        yield pa.RecordBatch.from_arrays([pa.array(made[0], pa.int32()), pa.array(made[1], pa.binary())], names=["target", "blob"])


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    found: dict[int, list[bytes]] = {}
    for batch in batches:
        for target, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
            found.setdefault(target, []).append(blob.as_py())
    while found:
        yield found.popitem()


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, back = np.unique(keys, return_inverse=True)
    return found, np.bincount(back, counts, len(found)).astype(np.int64)


def count_words(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(keep=BLOCK)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            found, n = _summed(*(np.concatenate(x) for x in zip(*held)))
            held.clear()
            yield from _packets(split(_shard(found, shards), [found, n.astype("<u4")]))

        for batch in batches:
            for _, _, data, offsets in text_blocks(batch.column(0), BLOCK):
                held.append(np.unique(tokens(data, offsets, hasher)[0], return_counts=True))
                if sum(len(x[0]) for x in held) > HELD:
                    yield from flush()
        if held:
            yield from flush()

    return run


class Shelf:
    """Where a level's files are: in the shared folder. Tasks write them there themselves, and workers map them into memory; where the folder isn't mounted, both go through the file system that its URI names."""

    def __init__(self, spark: SparkSession, level: str):
        self.uri = shared_folder(spark)
        self.level, self.id = level, uuid.uuid4().hex[:12]
        self.folder = local_path(self.uri)
        if self.folder:
            os.makedirs(self.folder, exist_ok=True)
        else:
            system, place = fs.FileSystem.from_uri(self.uri)  # raises before any work if workers couldn't reach it
            system.create_dir(place)

    def put(self, shard: int, data: bytes) -> str:
        """Called by a task; a second attempt replaces the file by an equal one."""
        name = f"{self.level}-{self.id}-{shard:05d}"
        if not self.folder:
            system, place = fs.FileSystem.from_uri(f"{self.uri}/{name}")
            with system.open_output_stream(place) as f:
                f.write(data)
            return name
        part = f"{self.folder}/.{name}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, f"{self.folder}/{name}")
        return name

    def open(self, name: str) -> np.ndarray:
        if self.folder:
            return np.memmap(f"{self.folder}/{name}", np.uint8, "r")
        system, place = fs.FileSystem.from_uri(f"{self.uri}/{name}")
        with system.open_input_file(place) as f:
            return np.frombuffer(f.read_buffer(), np.uint8)


def _built(shard: int, entries: int, n: int, name: str, hot: np.ndarray | None = None, used: np.ndarray | None = None) -> pa.RecordBatch:
    lists = [pa.array([[] if x is None else x.tolist()], pa.list_(t)) for x, t in ((hot, pa.int64()), (used, pa.float64()))]
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([entries], pa.int64()), pa.array([n], pa.int64()), pa.array([name]), *lists], names=["shard", "entries", "tokens", "name", "hot", "used"])


def build_words(shelf: Shelf, shards: int):
    """A shard of the first level: hashes, counts up to 254 in a byte, and the larger ones apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, blobs in _by_shard(batches):
            found, n = _summed(*gather(blobs, COUNTED))
            big = np.flatnonzero(n >= 255)
            floor, top = _floor(shard, shards), _floor(shard + 1, shards)
            parts = [np.array([len(found), len(big)], "<i8"), np.minimum(n, 255).astype("u1"), big.astype("<i8"), n[big].astype("<i8"), *encode(found - np.uint64(floor), top - floor)]
            yield _built(shard, len(found), int(n.sum()), shelf.put(shard, padded(parts)))
        give_back()

    return run


class Words:
    """The first level: ids and counts of words. Ids from `size` on: the mark before a text, and what follows its end."""

    def __init__(self, shelf: Shelf, rows: list, shards: int):
        self.shelf, self.shards = shelf, shards
        self.names = {r["shard"]: r["name"] for r in rows}
        sizes = {r["shard"]: r["entries"] for r in rows}
        self.bases = np.concatenate(([0], np.cumsum([sizes.get(s, 0) for s in range(shards)])))
        self.size = int(self.bases[-1])
        self.total = sum(r["tokens"] for r in rows)
        self._open: dict[int, tuple] = {}
        self.texts = int(self.find(np.array([END]))[1][0])

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    def _level(self, shard: int) -> tuple:
        if shard not in self._open:
            data = self.shelf.open(self.names[shard])
            n, big = (int(x) for x in data[:16].view("<i8"))
            at = 16 + n + -n % 8
            self._open[shard] = data[16 : 16 + n], data[at : at + 8 * big].view("<i8"), data[at + 8 * big : at + 16 * big].view("<i8"), Sequence(data, at + 16 * big)
        return self._open[shard]

    @staticmethod
    def _counts(level: tuple, rank: np.ndarray) -> np.ndarray:
        small, big, large, _ = level
        n = small[rank].astype(np.int64)
        if len(big):
            more = np.flatnonzero(n == 255)
            n[more] = large[np.minimum(np.searchsorted(big, rank[more]), len(big) - 1)]
        return n

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """hashes: rising. Ids (-1: unknown) and counts."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        cut = np.searchsorted(_shard(hashes, self.shards), np.arange(self.shards + 1))
        for shard in np.flatnonzero(np.diff(cut)).tolist():
            if shard in self.names:
                a, b = cut[shard], cut[shard + 1]
                level = self._level(shard)
                got = level[3].find(hashes[a:b] - np.uint64(_floor(shard, self.shards)))
                known = got >= 0
                ids[a:b][known] = got[known] + self.bases[shard]
                counts[a:b][known] = self._counts(level, got[known])
        return ids, counts

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Counts of rising ids of words."""
        out = np.zeros(len(ids), np.int64)
        cut = np.searchsorted(ids, self.bases)
        for shard in np.flatnonzero(np.diff(cut)).tolist():
            a, b = cut[shard], cut[shard + 1]
            out[a:b] = self._counts(self._level(shard), ids[a:b] - self.bases[shard])
        return out


class Homes:
    """The shard of each pair. A word with more than a shard's share of the tokens has as many shards as it fills, by the pair's second word."""

    def __init__(self, vocabulary: Words):
        self.shards = max(1, -(-vocabulary.total // SHARE))
        self.room, self.size = max(1, vocabulary.total // self.shards), vocabulary.size + 2

    def hot(self, count: np.ndarray) -> np.ndarray:
        return count > self.room

    def of(self, a: np.ndarray, count: np.ndarray, b: np.ndarray) -> np.ndarray:
        home = (a.astype(np.float64) / self.size * self.shards).astype(np.int64)
        hot = np.flatnonzero(self.hot(count))
        spread = mix(b[hot].astype(np.uint64)) % (-(-count[hot] // self.room)).astype(np.uint64)
        home[hot] = (home[hot] + spread.astype(np.int64)) % self.shards
        return home


class Block:
    """Distinct words, pairs and triples of a block of texts. Numbers of words are the block's own, by hash; the mark before a text is the one after the last, what follows its end the next."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, hasher: Hasher, vocabulary: Words, homes: Homes):
        found, self.of = tokens(data, offsets, hasher)
        hashes, self.word = np.unique(found, return_inverse=True)
        ids, counts = vocabulary.find(hashes)
        n = len(hashes)
        self.ids = np.concatenate((ids, [vocabulary.size, vocabulary.size + 1]))
        self.counts = np.concatenate((counts, [2 * vocabulary.texts, 0]))
        first = group_starts(self.of) if len(self.of) else np.empty(0, bool)
        before = np.empty(len(self.word), np.int64)
        before[1:] = self.word[:-1]
        before[first] = n
        # the pair of both marks is the last
        pairs, pair = np.unique(np.append(before * (n + 2) + self.word, n * (n + 2) + n), return_inverse=True)
        self.a, self.b = pairs // (n + 2), pairs % (n + 2)
        self.pair = pair[:-1]
        context = np.empty(len(self.word), np.int64)
        context[1:] = self.pair[:-1]
        context[first] = pair[-1]
        self.last = np.flatnonzero(np.append(first[1:], True)) if len(first) else np.empty(0, np.int64)
        self.context = context
        self.homes = homes.of(self.ids[self.a], self.counts[self.a], self.ids[self.b])
        self.after = n + 1

    def triples(self, ends: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pair, word and the triple of each token; with `ends`, also what follows each text's end."""
        context, word = self.context, self.word
        if ends:
            context, word = np.append(context, self.pair[self.last]), np.append(word, np.full(len(self.last), self.after))
        found, back = np.unique(context << 32 | word, return_inverse=True)
        return found >> 32, found & 0xFFFFFFFF, back


def count_triples(vocabulary: Words, homes: Homes, kinds: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(keep=BLOCK)
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            target, *columns = (np.concatenate(x) for x in zip(*held))
            held.clear()
            yield from _packets(split(target, columns))

        for batch in batches:
            for _, _, data, offsets in text_blocks(batch.column(0), BLOCK):
                block = Block(data, offsets, hasher, vocabulary, homes)
                pair, word, back = block.triples(True)
                n = np.bincount(back, minlength=len(pair))
                held.append((block.homes[pair].astype(np.uint16 if homes.shards < 1 << 16 else np.int64), *(block.ids[x].astype(k) for x, k in zip((block.a[pair], block.b[pair], word), kinds)), n.astype(kinds[3])))
                if sum(len(x[0]) for x in held) > HELD:
                    yield from flush()
        if held:
            yield from flush()
        give_back()

    return run


def _steps(p: np.ndarray) -> np.ndarray:
    """Steps below probability 1, rounded down to a lesser probability; 65535 stands for 0."""
    with np.errstate(divide="ignore"):
        return np.minimum(np.ceil(np.minimum(-np.log10(p), 1e6) / STEP), 65535).astype("<u2")


_VALUES = np.append(10.0 ** (-STEP * np.arange(65535)), 0.0)


def build_triples(shelf: Shelf, vocabulary: Words, homes: Homes, kinds: list[str], discount: float):
    """A shard of the lower levels: words that begin pairs, their second words, and the triples' third; shares of all, and what contexts leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark, after = vocabulary.size, vocabulary.size + 1
        for shard, blobs in _by_shard(batches):
            a, b, w, n = gather(blobs, kinds)
            blobs.clear()
            order = np.lexsort((w, b, a))
            a, b, w, n = a[order], b[order], w[order], n[order].astype(np.int64)
            head = np.flatnonzero(group_starts(a, b, w))
            a, b, w, n = a[head], b[head], w[head], np.add.reduceat(n, head)
            new_pair = group_starts(a, b)
            pair_at, pair = np.flatnonzero(new_pair), np.cumsum(new_pair) - 1
            follows = w != after
            of_pair = np.bincount(pair, n)
            of_context = np.bincount(pair, np.where(follows, n, 0))
            pair, w, n = pair[follows], w[follows], n[follows]
            share = (n - discount) / of_context[pair]
            rest = np.maximum(1 - np.bincount(pair, share, len(pair_at)), 0)
            a, b = a[pair_at].astype(np.int64), b[pair_at].astype(np.int64)
            new_word = group_starts(a)
            word_at, word = np.flatnonzero(new_word), np.cumsum(new_word) - 1
            first = a[word_at]
            known = first < mark
            count = np.full(len(first), vocabulary.texts, np.int64)
            count[known] = vocabulary.counts(first[known])
            pair_share = np.where(b == mark, 0.0, (of_pair - discount) / count[word])
            used = np.bincount(word, pair_share, len(first))
            hot = homes.hot(np.where(known, count, 2 * vocabulary.texts))
            parts = [
                np.array([len(first), len(a), len(w)], "<i8"),
                _steps(np.maximum(1 - used, 0)),
                _steps(pair_share),
                _steps(rest),
                _steps(share),
                *encode(first.astype(np.uint64), after),
                *Children.encode(np.bincount(word, minlength=len(first)), b),
                *Children.encode(np.bincount(pair, minlength=len(a)), w),
            ]
            yield _built(shard, len(w), 0, shelf.put(shard, padded(parts)), first[hot], used[hot])
            give_back()

    return run


class Triples:
    """The lower levels."""

    def __init__(self, shelf: Shelf, rows: list, homes: Homes):
        self.shelf, self.homes = shelf, homes
        self.names = {r["shard"]: r["name"] for r in rows}
        used: dict[int, float] = {}
        for r in sorted(rows, key=lambda r: r["shard"]):
            for word, u in zip(r["hot"], r["used"]):
                used[word] = used.get(word, 0.0) + u
        #: What words in several shards leave, as few as there are shards.
        self.hot = np.array(sorted(used), np.int64)
        self.hot_rest = _VALUES[_steps(np.maximum(1 - np.array([used[i] for i in sorted(used)]), 0))]
        self._open: dict[int, tuple] = {}

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    def _level(self, shard: int) -> tuple:
        if shard not in self._open:
            data = self.shelf.open(self.names[shard])
            sizes = data[:24].view("<i8").tolist()
            at, steps = 24, []
            for n in (sizes[0], sizes[1], sizes[1], sizes[2]):
                steps.append(data[at : at + 2 * n].view("<u2"))
                at += 2 * n + -2 * n % 8
            first = Sequence(data, at)
            pairs = Children(data, first.end)
            self._open[shard] = *steps, first, pairs, Children(data, pairs.end)
        return self._open[shard]

    def rests(self, ids: np.ndarray, rest: np.ndarray) -> None:
        """Put in what hot words leave."""
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, ids), len(self.hot) - 1)
            there = self.hot[at] == ids
            rest[there] = self.hot_rest[at[there]]

    def look_up(self, block: Block) -> tuple[np.ndarray, ...]:
        """Of the block's pairs: the share of the second word after the first, and what the first leaves; of its triples (as `block.triples(False)` numbers them): the share of the third word after the pair, and what the pair leaves."""
        a, b = block.ids[block.a], block.ids[block.b]
        share2, left2 = np.zeros(len(a)), np.ones(len(a))
        pair, word, back = block.triples(False)
        share3, left3 = np.zeros(len(pair)), np.ones(len(pair))
        ids = block.ids[word]
        order = np.argsort(block.homes.astype(np.uint16 if self.homes.shards < 1 << 16 else np.int64), kind="stable")
        order = order[a[order] >= 0]
        home = block.homes[order]
        cut = np.append(np.flatnonzero(group_starts(home)), len(home)) if len(home) else np.zeros(1, np.int64)
        begin = np.searchsorted(pair, np.arange(len(a) + 1))
        for s, e in zip(cut[:-1].tolist(), cut[1:].tolist()):
            shard = int(home[s])
            if shard not in self.names:
                continue
            rests1, shares2, rests2, shares3, first, pairs, triples = self._level(shard)
            mine = order[s:e]
            new = group_starts(a[mine])
            node = first.find(a[mine][new])
            there = np.flatnonzero(node >= 0)
            ranges = np.zeros((3, len(node)), np.int64)
            ranges[:, there] = pairs.ranges(node[there])
            left = np.ones(len(node))
            left[there] = _VALUES[rests1[node[there]]]
            of = np.cumsum(new) - 1
            left2[mine] = left[of]
            asked = np.flatnonzero((node[of] >= 0) & (b[mine] >= 0))
            got = np.full(len(mine), -1, np.int64)
            got[asked] = pairs.find(*ranges[:, of[asked]], b[mine][asked])
            found = np.flatnonzero(got >= 0)
            got, mine = got[found], mine[found]
            share2[mine] = _VALUES[shares2[got]]
            # the triples that follow the pairs found here
            size = begin[mine + 1] - begin[mine]
            at = np.repeat(begin[mine] - np.cumsum(size) + size, size) + np.arange(size.sum())
            left3[at] = np.repeat(_VALUES[rests2[got]], size)
            ranges = np.repeat(np.array(triples.ranges(got)), size, axis=1)
            known = np.flatnonzero((ids[at] >= 0) & (ranges[0] < ranges[1]))
            child = triples.find(*ranges[:, known], ids[at][known])
            share3[at[known][child >= 0]] = _VALUES[shares3[child[child >= 0]]]
        self.rests(a, left2)
        return share2, left2, share3, left3, back


class Model:
    def __init__(self, vocabulary: Words, triples: Triples):
        self.vocabulary, self.triples = vocabulary, triples
        self.under = max(vocabulary.total + 0.5 * (vocabulary.size + 1), 0.5)

    def block(self, data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, ...]:
        """Text, known or not, base probability and probability of each token of a block."""
        block = Block(data, offsets, hasher, self.vocabulary, self.triples.homes)
        share2, left2, share3, left3, triple = self.triples.look_up(block)
        counts = block.counts[block.word]
        base = (counts + 0.5) / self.under
        p = share2[block.pair] + left2[block.pair] * base
        return block.of, counts > 0, base, share3[triple] + left3[triple] * p


def train(df: DataFrame, text: str = "text", discount: float = DISCOUNT) -> Model:
    """A model of all of df's texts."""
    lean(df.sparkSession)
    spark, texts = df.sparkSession, df.select(text)
    first = Shelf(spark, "words")
    shards = max(1, texts.rdd.getNumPartitions() // PARTS)
    counted = texts.mapInArrow(count_words(shards), PACKET).repartitionById(shards, "target")
    vocabulary = Words(first, counted.mapInArrow(build_words(first, shards), BUILT).collect(), shards)
    homes, second = Homes(vocabulary), Shelf(spark, "triples")
    kinds = ["<u4" if vocabulary.size < 2**32 - 2 else "<u8"] * 3 + ["<u4"]
    paired = texts.mapInArrow(count_triples(vocabulary, homes, kinds), PACKET).repartitionById(homes.shards, "target")
    rows = paired.mapInArrow(build_triples(second, vocabulary, homes, kinds, discount), BUILT).collect()
    return Model(vocabulary, Triples(second, rows, homes))


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, n_known, train_tokens, base_score, score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(keep=BLOCK)
        for batch in batches:
            for i, j, data, offsets in text_blocks(batch.column(1), BLOCK):
                of, known, base, p = model.block(data, offsets, hasher)
                n = j - i
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, n),
                        pa.array(np.bincount(of, minlength=n)),
                        pa.array(np.bincount(of[known], minlength=n)),
                        pa.array(np.full(n, model.vocabulary.total)),
                        pa.array(np.bincount(of, np.log10(base), n)),
                        pa.array(np.bincount(of, np.log10(np.maximum(p, 1e-300)), n)),
                    ],
                    names=["key", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"key {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every document scored by a model of those whose fold is not 1."""
    docs = table(spark, sf_dir, "documents")
    held_out: Column = fold() == 1
    found = score(docs, train(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
