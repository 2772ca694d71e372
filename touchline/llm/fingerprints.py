"""Operator 1: document fingerprints as Merkle trees.

A text's lines are its paragraphs; a section ends at a blank line, or after a paragraph whose digest ends in three zero
bits, so that an edit moves the borders of one section only. A paragraph's digest is over its raw bytes, a section's over
its paragraphs' digests, the root over the sections'. A fingerprint spells the whole tree: the root (32 hexadecimal
digits) and ":", then sections after one another with "/" between, each its digest (16 digits), "=" and its paragraphs
with "." between, each its digest (16) and its pieces' codes (6 each). Pieces are runs of words that end at a word of a
chosen hash or a greatest length. Equal texts have equal fingerprints, different texts different roots; descending from
two roots that differ into the branches that do locates every edit, of white space, order and number, too. The share of
equal codes tells how alike two texts are.

Null text counts as empty, and the empty text has a fingerprint without codes. Two fingerprints without codes are alike
(1) if equal, else not at all (0). Very long texts are fingerprinted like others, one at a time. An empty table gives no
rows; columns other than key and text are not read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import Hasher, column_bytes, words
from .shared import table, tasks

#: A piece ends at one word in so many, and after twice as many words at the latest.
PIECE = 4
#: Bytes of text worked on at once.
STEP = 1 << 20
LINE = 10
#: Bytes of sections' and paragraphs' digests that a fingerprint spells.
SHOWN = 8
#: Keys of the sample that the ranges' borders are taken from, for each task.
SAMPLED = 100


def _digest(kind: bytes, data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16, person=kind).digest()


def fingerprints(texts: list[bytes], hasher: Hasher) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Fingerprints of UTF-8 texts; also all piece codes and the text of each."""
    data, offsets = column_bytes(pa.array(texts, pa.large_binary()))
    starts, ends, of = words(data, offsets)
    codes = np.empty(0, np.uint64)
    owner = np.empty(0, np.int64)
    first = np.empty(0, np.int64)
    if len(starts):
        hasher.load(data)
        last = hasher.slices(starts, ends) % np.uint64(PIECE) == 0
        line = np.searchsorted(np.flatnonzero(data == LINE), starts)
        last[:-1] |= (line[1:] != line[:-1]) | (of[1:] != of[:-1])
        last[-1] = True
        here = np.arange(len(last))
        since = here - np.concatenate(([0], np.maximum.accumulate(np.where(last, here + 1, 0))[:-1]))
        last |= since % (2 * PIECE) == 2 * PIECE - 1
        tail = np.flatnonzero(last)
        head = np.concatenate(([0], tail[:-1] + 1))
        first = starts[head]
        codes = hasher.slices(first, ends[tail]) >> np.uint64(40)
        owner = of[head]
    spelled = codes.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:].tobytes().hex()
    out, base = [], 0
    for k, text in enumerate(texts):
        lines = text.split(b"\n")
        at = int(offsets[k])
        borders = np.searchsorted(first, at + np.concatenate(([0], np.cumsum([len(x) + 1 for x in lines])))).tolist()
        end = int(np.searchsorted(owner, k, "right"))
        sections: list[tuple[list[bytes], list[str]]] = [([], [])]
        for i, x in enumerate(lines):
            d = _digest(b"paragraph", x)
            sections[-1][0].append(d)
            # the last border may reach into the next text by one byte, the first is never before this one
            sections[-1][1].append(d[:SHOWN].hex() + spelled[6 * borders[i] : 6 * min(borders[i + 1], end)])
            if (not x.strip() or d[-1] & 7 == 0) and i + 1 < len(lines):
                sections.append(([], []))
        digests = [_digest(b"section", b"".join(ds)) for ds, _ in sections]
        spelt = "/".join(f"{d[:SHOWN].hex()}={'.'.join(ps)}" for d, (_, ps) in zip(digests, sections))
        out.append(f"{_digest(b'root', b''.join(digests)).hex()}:{spelt}")
    return out, codes, owner


def likenesses(codes_a: np.ndarray, pair_a: np.ndarray, codes_b: np.ndarray, pair_b: np.ndarray, n: int) -> np.ndarray:
    """For each of n pairs: twice the codes in common over all codes; NaN where neither side has any."""
    at_a, n_a = np.unique(pair_a.astype(np.int64) << 24 | codes_a.astype(np.int64), return_counts=True)
    at_b, n_b = np.unique(pair_b.astype(np.int64) << 24 | codes_b.astype(np.int64), return_counts=True)
    both, i, j = np.intersect1d(at_a, at_b, assume_unique=True, return_indices=True)
    common = np.bincount(both >> 24, np.minimum(n_a[i], n_b[j]), n)
    total = np.bincount(pair_a, minlength=n) + np.bincount(pair_b, minlength=n)
    return np.where(total > 0, 2 * common / np.maximum(total, 1), np.nan)


def tree(fingerprint: str) -> tuple[str, list[tuple[str, list[tuple[str, str]]]]]:
    """Root, and of each section its digest and its paragraphs' digests and codes."""
    root, _, rest = fingerprint.partition(":")
    sections = []
    for section in rest.split("/"):
        digest, _, paragraphs = section.partition("=")
        sections.append((digest, [(p[: 2 * SHOWN], p[2 * SHOWN :]) for p in paragraphs.split(".")]))
    return root, sections


def _codes(fingerprint: str) -> np.ndarray:
    plain = "".join(codes for _, paragraphs in tree(fingerprint)[1] for _, codes in paragraphs)
    return np.array([int(plain[i : i + 6], 16) for i in range(0, len(plain), 6)], np.uint64)


def likeness(a: str, b: str) -> float:
    """How alike two fingerprints are, from 0 to 1."""
    x, y = _codes(a), _codes(b)
    got = likenesses(x, np.zeros(len(x), int), y, np.zeros(len(y), int), 1)[0]
    return float(a == b) if np.isnan(got) else float(got)


def differing(a: str, b: str) -> list[tuple[str, tuple[int, int], tuple[int, int]]]:
    """The edits that lead from a's text to b's, by descending from the roots: equal sections are left, the paragraphs of others compared. Each is "replace", "delete" or "insert", and the paragraphs (lines, from 0, the end excluded) of a and of b that it concerns."""
    (root_a, in_a), (root_b, in_b) = tree(a), tree(b)
    if root_a == root_b:
        return []
    at_a, at_b = ([0, *itertools.accumulate(len(ps) for _, ps in x)] for x in (in_a, in_b))
    out = []
    for op, i, j, k, m in SequenceMatcher(None, [d for d, _ in in_a], [d for d, _ in in_b], False).get_opcodes():
        if op == "equal":
            continue
        below = SequenceMatcher(None, *([d for _, ps in x for d, _ in ps] for x in (in_a[i:j], in_b[k:m])), False)
        out += [(o, (at_a[i] + p, at_a[i] + q), (at_b[k] + r, at_b[k] + t)) for o, p, q, r, t in below.get_opcodes() if o != "equal"]
    return out


def edited_text(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _bucket(key: Column, hash_: Column, borders: list[int], times: Counter) -> Column:
    """The range of a key among sorted distinct borders, found by halving. A border that stands several times has as many ranges, in rising order of the hash."""
    if not borders:
        return F.lit(0)
    below = [0, *itertools.accumulate(times[b] for b in borders)]
    values, before = F.lit(borders), F.lit(below)
    step = lambda at, _: F.when(at["lo"] >= at["hi"], at).otherwise(
        F.when(F.get(values, ((at["lo"] + at["hi"]) / 2).cast("int")) < key, F.struct((((at["lo"] + at["hi"]) / 2).cast("int") + 1).alias("lo"), at["hi"].alias("hi"))).otherwise(
            F.struct(at["lo"].alias("lo"), ((at["lo"] + at["hi"]) / 2).cast("int").alias("hi"))
        )
    )
    found = F.aggregate(F.sequence(F.lit(1), F.lit(len(borders).bit_length() + 1)), F.struct(F.lit(0).alias("lo"), F.lit(len(borders)).alias("hi")), step)["lo"]
    equal = F.get(values, found) == key
    ranges = F.get(before, found + 1) - F.get(before, found)
    part = F.least((hash_.cast("double") / 2.0**64 + 0.5) * ranges, ranges - 1)
    return (F.get(before, found) + F.when(equal, F.floor(part)).otherwise(0)).cast("int")


def compare_with_next(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document with the one after it in falling order of key (null keys last, equal keys by a falling hash of their text; after the last comes the first): fingerprints of the text and of the text whose last half is replaced by the other's beginning, and how alike they are.

    Documents are dealt by ranges of the key; a key that fills several ranges is dealt by the hash. The greatest of each
    range is also sent to the range above, so that each range holds what follows its own last. Only a sample of the keys
    and the ranges' greatest ones, in number bounded by the tasks', reach the driver; rows meet them by a binary search
    and by a join.
    """
    df = df.select(F.col(key).cast("long").alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn("_hash", F.xxhash64("_text"))
    n = tasks(df.sparkSession)
    least = F.lit(-(2**63)).cast("long")
    place = F.coalesce("_key", least)
    share = min(1.0, SAMPLED * n / max(1, df.count()))
    sampled = sorted(r[0] for r in df.select(place).sample(share, seed=7).collect())
    borders = [sampled[i * len(sampled) // n] for i in range(1, n)] if sampled else []
    times = Counter(borders)
    df = df.withColumn("_bucket", _bucket(place, F.col("_hash"), sorted(times), times))
    order = F.struct(F.col("_key").isNotNull().alias("known"), place.alias("key"), F.col("_hash").alias("hash"))
    tops = df.groupBy("_bucket").agg(F.max(order).alias("top")).orderBy("_bucket").collect()
    above = [*tops[1:], *tops[:1]]
    sends = df.sparkSession.createDataFrame(
        [(r["_bucket"], r["top"]["key"], r["top"]["hash"], up["_bucket"], 2 if k == len(tops) - 1 else 1) for k, (r, up) in enumerate(zip(tops, above))],
        "_bucket int, _top long, _top_hash long, _to int, _rank int",
    )
    sent = F.when((place == F.col("_top")) & (F.col("_hash") == F.col("_top_hash")), F.array(F.struct(F.col("_to").alias("to"), F.col("_rank").alias("rank")))).otherwise(F.array().cast("array<struct<to:int,rank:int>>"))
    own = F.array(F.struct(F.col("_bucket").alias("to"), F.lit(0).alias("rank")))
    dealt = df.join(F.broadcast(sends), "_bucket").select("_key", "_hash", "_text", F.inline(F.concat(own, sent)))
    dealt = dealt.repartitionById(len(borders) + 1, F.col("to"))
    dealt = dealt.sortWithinPartitions("to", "rank", F.desc_nulls_last("_key"), F.desc("_hash"), F.desc("_text")).select("_key", "_text", "rank", "to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        held: list[tuple[int | None, str, int, int]] = []
        size = 0

        def flush() -> pa.RecordBatch | None:
            m = len(held) - 1
            texts = [x[1] for x in held]
            edited = [edited_text(texts[i], texts[i + 1]) for i in range(m)]
            raw = [x.encode() for x in edited]
            prints, codes, owner = fingerprints([x.encode() for x in texts] + raw, hasher)
            of_text, of_next, of_edited = owner < m, (owner >= 1) & (owner <= m), owner > m
            to_edited = likenesses(codes[of_text], owner[of_text], codes[of_edited], owner[of_edited] - m - 1, m)
            to_next = likenesses(codes[of_text], owner[of_text], codes[of_next], owner[of_next] - 1, m)
            same = lambda got, shift: [float(prints[i] == prints[i + shift]) if np.isnan(g) else float(g) for i, g in enumerate(got)]
            rows = [
                (held[i][0], len(texts[i]), hashlib.sha256(raw[i]).hexdigest(), prints[i], prints[m + 1 + i], a, b)
                for i, (a, b) in enumerate(zip(same(to_edited, m + 1), same(to_next, 1)))
                if held[i][2] == 0
            ]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), KINDS)], names=NAMES) if rows else None

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if held and held[-1][3] != row[3]:
                    if len(held) > 1 and (made := flush()):
                        yield made
                    held, size = [], 0
                held.append(row)
                size += len(row[1])
                if size > STEP and len(held) > 1:
                    if made := flush():
                        yield made
                    held, size = held[-1:], len(row[1])
        if len(held) > 1 and (made := flush()):
            yield made

    return dealt.mapInArrow(run, f"{NAMES[0]} long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").withColumnRenamed(NAMES[0], key)


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: every document's fingerprint, and its likeness to its edited text and to the next document."""
    return compare_with_next(table(spark, sf_dir, "documents"))
