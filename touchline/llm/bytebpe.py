"""Operator 3: byte-level BPE encoding and decoding over Arrow batches.

The `tokenizers` library's BPE model merges each piece once per worker; pieces are found by the split pattern, mapped
byte by byte to the model's printable characters, and looked up in a bounded memo. Token ids and character offsets come
out as arrays. Decoding takes each id's bytes from the reversed table and joins the bytes before it reads characters, so
a character split over several tokens is whole again.

Null text: no ids. Empty text: no ids. Null ids, and ids outside the table: no bytes. Very long texts are steps of their
own. Repeated rows, ties of ids and extra columns pass through untouched; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import column_bytes, spans
from .shared import table

#: Pieces that a worker remembers before it starts anew.
MEMO = 400_000
#: Texts of one step, in bytes.
STEP = 1 << 20


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else the next from U+0100 on."""
    kept = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_list(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The pair that makes each token of two or more bytes, by rank: what is left of its bytes when all merges of lower ranks are done."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            at = [ranks.get(a + b, rank) for a, b in zip(parts, parts[1:])]
            low = min(at)
            if low >= rank:
                break
            i = at.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


class ByteBPE:
    """ranks: token bytes to ids. pattern: what splits a text before the merges."""

    def __init__(self, ranks: dict[bytes, int], merges: list[tuple[bytes, bytes]], pattern: str):
        from tokenizers.models import BPE

        self.alphabet = byte_alphabet()
        spelled = lambda b: "".join(map(self.alphabet.__getitem__, b))
        self.model = BPE(vocab={spelled(t): i for t, i in ranks.items()}, merges=[(spelled(a), spelled(b)) for a, b in merges], ignore_merges=True)
        self.find = regex.compile(pattern).findall
        self.latin = str.maketrans({chr(b): c for b, c in enumerate(self.alphabet)})
        size = max(ranks.values(), default=-1) + 1
        back = {c: b for b, c in enumerate(self.alphabet)}
        table: list[bytes] = [b""] * size
        for text, i in self.model_vocab(ranks, spelled):
            table[i] = bytes(map(back.__getitem__, text))
        # the last row stands for ids outside the table: they have no bytes
        self.token_bytes = pa.array([*table, b""], pa.large_binary())
        self.token_length = np.array([*map(len, table), 0], np.int64)
        self.memo: dict[str, bytes] = {}

    @staticmethod
    def model_vocab(ranks, spelled):
        return ((spelled(t), i) for t, i in ranks.items())

    def piece(self, text: str) -> bytes:
        """The ids of one piece as little-endian 32-bit numbers."""
        ids = [t.id for t in self.model.tokenize(text.encode().decode("latin-1").translate(self.latin))]
        return np.array(ids, "<i4").tobytes()

    def ids(self, text: str) -> bytes:
        pieces = self.find(text)
        try:
            return b"".join(map(self.memo.__getitem__, pieces))
        except KeyError:
            if len(self.memo) > MEMO:
                self.memo.clear()
            for p in set(pieces).difference(self.memo):
                self.memo[p] = self.piece(p)
            return b"".join(map(self.memo.__getitem__, pieces))

    def offsets(self, ids: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First character of each token and the one after its last; tokens that share a character share its number."""
        data = np.frombuffer(text.encode(), np.uint8)
        number = np.append(np.cumsum((data & 0xC0) != 0x80) - 1, len(text))
        ends = np.cumsum(self.token_length[ids])
        starts = ends - self.token_length[ids]
        return number[starts], number[np.maximum(ends - 1, 0)] + 1 if len(ids) else ends

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The bytes of consecutive lists of ids, one after another, and the offsets of each list's bytes."""
        ids = np.where((ids >= 0) & (ids < len(self.token_length)), ids, len(self.token_length) - 1)
        ends = np.concatenate(([0], np.cumsum(self.token_length[ids])))
        return self.token_bytes.take(pa.array(ids, pa.int32())), ends[np.concatenate(([0], np.cumsum(lengths)))]


@lru_cache(maxsize=2)
def _definition(path: str) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]]]:
    ranks = read_ranks(path)
    return ranks, merge_list(ranks)




class _Handle:
    """A broadcast vocabulary (its file bounds its size); equal keys share one coder in a worker."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        self.key, self.pattern = path, pattern
        self.broadcast = spark.sparkContext.broadcast(_definition(path))

    def coder(self) -> ByteBPE:
        if (got := _KEPT.get((self.key, self.pattern))) is None:
            _KEPT.clear()
            got = _KEPT[self.key, self.pattern] = ByteBPE(*self.broadcast.value, self.pattern)
        return got


_KEPT: dict[tuple[str, str], ByteBPE] = {}


def _with(batch: pa.RecordBatch, i: int, j: int, names: list[str], **new: pa.Array) -> pa.RecordBatch:
    part = batch.slice(i, j - i)
    return pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(n)) for n in names] + [*new.values()], names=[*names, *new])


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", offsets: tuple[str, str] | None = None) -> DataFrame:
    """Add array<int> `ids`; with `offsets`, also arrays of the first character of each token and the one after its last. The text column stays only if it is named otherwise than the new ones; a column that bears a new one's name is replaced."""
    handle = _Handle(df.sparkSession, path, pattern)
    new = [ids, *(offsets or ())]
    names = [c for c in df.columns if c not in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = handle.coder()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            _, at = column_bytes(texts)
            for i, j in spans(at, STEP):
                rows = [t or "" for t in texts.slice(i, j - i).to_pylist()]
                found = [np.frombuffer(coder.ids(t), "<i4") for t in rows]
                ends = np.concatenate(([0], np.cumsum([*map(len, found)]))).astype(np.int32)
                flat = np.concatenate(found) if found else np.empty(0, np.int32)
                lists = lambda x: pa.ListArray.from_arrays(pa.array(ends), pa.array(x, pa.int32()))  # noqa: E731, B023
                made = {ids: lists(flat)}
                if offsets:
                    pairs = [coder.offsets(f, t) for f, t in zip(found, rows)]
                    made |= {n: lists(np.concatenate([p[k] for p in pairs]).astype(np.int32)) for k, n in enumerate(offsets)}
                yield _with(batch, i, j, names, **made)

    array = T.ArrayType(T.IntegerType())
    schema = T.StructType([df.schema[c] for c in names] + [T.StructField(n, array) for n in new])
    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add binary `out`: the bytes that the ids stand for. Null ids: no bytes."""
    handle = _Handle(df.sparkSession, path, pattern)
    names = [c for c in df.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = handle.coder()
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids))
            n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            step = np.concatenate(([0], np.cumsum(n))) * 4
            for i, j in spans(step, STEP):
                taken, ends = coder.decode(lists.slice(i, j - i).flatten().fill_null(-1).to_numpy(zero_copy_only=False), n[i:j])
                made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(ends.astype(np.int64)), taken.buffers()[2]]) if len(taken) else pa.array([b""] * (j - i), pa.large_binary())
                yield _with(batch, i, j, names, **{out: made.cast(pa.binary())})

    schema = T.StructType([df.schema[c] for c in names] + [T.StructField(out, T.BinaryType())])
    return df.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: every whole text encoded and decoded again."""
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern).drop("text")
    return decode(coded, path, pattern).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
