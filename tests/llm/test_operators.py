"""Each operator against a plain version of itself, and its defined results in odd cases."""

import base64
import hashlib
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from touchline.llm import bytebpe, eliasfano, fingerprints, jaccard, language, maintext, neighbours, packing, passages, quality, registry, repeats, shared
from touchline.llm.blocks import Hasher, column_bytes, least_in_windows, words
from touchline.llm.components import components

ODD = [(None, "a b c d e f", "u"), (1, None, "v"), (1, "", "v"), (3, " \n\t ", None), (3, "ab" * 100, None), (3, "ab" * 100, None), (2**60, "x" + "ab" * 100 + "é", "w")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty texts, ties, repeated rows, and an extra column whose name an operator uses, too."""
    return spark.createDataFrame(ODD, "doc_id long, text string, target string")


@pytest.fixture(scope="module")
def documents(spark, sf):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lowered(text))


# ---- shared parts ----


def test_words_and_hashes():
    texts = ["", "a b", None, " x\x0by ", "é", "ab"]
    data, offsets = column_bytes(pa.array(texts))
    starts, ends, of = words(data, offsets)
    assert [(bytes(data[a:b]).decode(), int(t)) for a, b, t in zip(starts, ends, of)] == [("a", 1), ("b", 1), ("x", 3), ("y", 3), ("é", 4), ("ab", 5)]
    h = Hasher().load(np.frombuffer(b"abcabcab", np.uint8))
    assert h.windows(3)[0] == h.windows(3)[3] == h.slices(np.array([0]), np.array([3]))[0] and len(set(h.windows(3).tolist())) == 3
    keys = np.random.default_rng(0).integers(0, 99, 50).astype(np.uint64)
    for w in (1, 2, 3, 7, 8, 13):
        assert least_in_windows(keys, w).tolist() == [min(keys[i : i + w]) for i in range(51 - w)]


@pytest.mark.parametrize("n, universe", [(0, 5), (1, 1), (5, 7), (1000, 1 << 40), (20000, 1 << 63), (3000, 3500)])
def test_elias_fano(n, universe):
    dice = np.random.default_rng(n)
    v = np.unique(dice.integers(0, universe, n, dtype=np.uint64))
    dense = np.unique(np.concatenate((v, dice.integers(0, min(universe, 9000), n, dtype=np.uint64))))
    for values in (v, dense):
        s = eliasfano.Sequence(np.frombuffer(eliasfano.padded(eliasfano.encode(values, universe)), np.uint8))
        asked = np.concatenate((values, dice.integers(0, universe, 500, dtype=np.uint64)))
        rank = {x: i for i, x in enumerate(values.tolist())}
        assert s.find(asked).tolist() == [rank.get(x, -1) for x in asked.tolist()]


def test_components(spark):
    dice = random.Random(1)
    edges = [(dice.randrange(300), dice.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1040)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in got} and set(got) == {x for e in edges for x in e if e[0] != e[1]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 1 ----


def plain_tree(text):
    """Root, and digests of sections and paragraphs, by the book."""
    of = lambda kind, data: hashlib.blake2b(data, digest_size=16, person=kind).digest()
    sections = [[]]
    lines = text.encode().split(b"\n")
    for i, line in enumerate(lines):
        sections[-1].append(of(b"paragraph", line))
        if (not line.strip() or sections[-1][-1][-1] % 8 == 0) and i + 1 < len(lines):
            sections.append([])
    digests = [of(b"section", b"".join(x)) for x in sections]
    return of(b"root", b"".join(digests)).hex(), [(d.hex()[:16], [p.hex()[:16] for p in x]) for d, x in zip(digests, sections)]


def dice_of_codes(a, b):
    x, y = (Counter(c[i : i + 6] for _, ps in fingerprints.tree(p)[1] for _, c in ps for i in range(0, len(c), 6)) for p in (a, b))
    return 2 * sum((x & y).values()) / (sum(x.values()) + sum(y.values())) if x or y else float(a == b)


@pytest.mark.parametrize("sampled", [fingerprints.SAMPLED, 1])
def test_fingerprints(spark, sf, documents, monkeypatch, sampled):
    monkeypatch.setattr(fingerprints, "SAMPLED", sampled)
    got = by_id(registry.QUERIES["op1_fingerprints"](spark, sf))
    order = sorted(documents, reverse=True)
    for i, d in enumerate(order):
        text, following = documents[d], documents[order[(i + 1) % len(order)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        r, after = got[d], got[order[(i + 1) % len(order)]]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        for print_, of in ((r["fingerprint"], text), (r["edited_fingerprint"], edited)):
            root, sections = fingerprints.tree(print_)
            assert (root, [(x, [p for p, _ in ps]) for x, ps in sections]) == plain_tree(of)
        assert r["near_edited"] == pytest.approx(dice_of_codes(r["fingerprint"], r["edited_fingerprint"])) == pytest.approx(fingerprints.likeness(r["fingerprint"], r["edited_fingerprint"]))
        assert r["near_next"] == pytest.approx(dice_of_codes(r["fingerprint"], after["fingerprint"]))
    long = [r for d, r in got.items() if len(documents[d]) > 200]
    assert sum(r["near_edited"] > r["near_next"] for r in long) > 0.95 * len(long)
    assert len({r["fingerprint"] for r in got.values()}) == len(set(documents.values()))


def changed(a, b):
    (x, y), _, _ = fingerprints.fingerprints([a.encode(), b.encode()], Hasher())
    return fingerprints.differing(x, y)


def test_fingerprints_locate_edits():
    lines = [f"line {i} has a few words of its own, {i * 7}" + ("\n" if i % 9 == 8 else "") for i in range(40)]
    text = "\n".join(lines)
    put = lambda i, *new: "\n".join([*text.split("\n")[:i], *new, *text.split("\n")[i + 1 :]])
    own = text.split("\n")
    assert changed(text, text) == []
    assert changed(text, put(20, "another line")) == [("replace", (20, 21), (20, 21))]
    assert changed(text, put(20, own[20] + "  ")) == [("replace", (20, 21), (20, 21))]  # trailing spaces
    assert changed(text, put(20, own[20], "")) == [("insert", (21, 21), (21, 22))]  # a blank line
    assert changed(text, put(20, own[20], own[20])) in ([("insert", (21, 21), (21, 22))], [("insert", (20, 20), (20, 21))])  # a repeated line
    assert changed(put(20, own[20], "x"), text) == [("delete", (21, 22), (21, 21))]
    moved = changed(text, "\n".join([*own[:12], own[13], own[12], *own[14:]]))
    assert moved and all(12 <= i <= j <= 14 for _, (i, j), _ in moved)
    assert changed("", "x") == [("replace", (0, 1), (0, 1))]


def test_fingerprints_of_one_key_in_many_rows(spark):
    """A key with a third of the rows is dealt to several tasks, and the chain goes through all of them."""
    rows = [(7 if i % 3 == 0 else i, f"text {i} of its own") for i in range(600)] + [(None, f"null {i}") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    buckets = df.withColumn("b", fingerprints._bucket(F.col("doc_id"), F.xxhash64("text"), [3, 7, 90], Counter([3, 7, 7, 7, 7, 90]))).where("doc_id = 7").groupBy("b").count().collect()
    assert len(buckets) == 4 and all(1 <= r["b"] <= 4 for r in buckets)
    got = fingerprints.compare_with_next(df).collect()
    assert len(got) == len(rows)
    prints = {t: fingerprints.fingerprints([t.encode()], Hasher())[0][0] for _, t in rows}
    order = [r[1] for r in df.withColumn("h", F.xxhash64("text")).orderBy(F.desc_nulls_last("doc_id"), F.desc("h")).select("doc_id", "text").collect()]
    nexts = {prints[t]: order[(i + 1) % len(order)] for i, t in enumerate(order)}
    texts = {p: t for t, p in prints.items()}
    for r in got:
        text, following = texts[r["fingerprint"]], nexts[r["fingerprint"]]
        assert r["edited_sha256"] == hashlib.sha256(fingerprints.edited_text(text, following).encode()).hexdigest()


def test_fingerprints_of_odd_rows(spark, odd):
    assert fingerprints.compare_with_next(odd).count() == len(ODD)
    assert fingerprints.compare_with_next(odd.limit(0)).count() == 0
    one = fingerprints.compare_with_next(odd.where("doc_id = 3").limit(1)).first()
    assert one["near_next"] == 1.0


# ---- 2 ----


def test_packing():
    dice = random.Random(2)
    sizes = sorted((min(8192, int(dice.lognormvariate(6, 1))) for _ in range(3000)), reverse=True)
    bins, offsets, lengths = packing.pack(sizes)
    used = Counter()
    for s, b, o in zip(sizes, bins, offsets):
        assert o == used[b]
        used[b] += s
    assert all(used[b] <= lengths[b] and lengths[b] in packing.LENGTHS for b in used)
    assert all(used[b] > lengths[b] // 2 or lengths[b] == 512 for b in used)  # downsized
    assert sum(sizes) / sum(lengths) > 0.97
    assert packing.pack([]) == ([], [], [])


def test_longer_bins_win():
    bins, _, lengths = packing.pack([600] * 39)
    assert lengths == [2048] * 13 and [bins.count(k) for k in range(13)] == [3] * 13


def least_cost(sizes):
    """The cost of the best packing of a few pieces, by trying all."""
    whole = (1 << len(sizes)) - 1
    total = [sum(s for k, s in enumerate(sizes) if m >> k & 1) for m in range(whole + 1)]
    one = [packing.cost(next((x for x in packing.LENGTHS if x >= t), 1 << 40)) for t in total]
    best = [0.0] + [math.inf] * whole
    for m in range(1, whole + 1):
        low, rest = m & -m, m & (m - 1)
        part = rest
        while True:
            best[m] = min(best[m], one[part | low] + best[m ^ (part | low)])
            if not part:
                break
            part = (part - 1) & rest
    return best[whole]


@pytest.mark.parametrize("seed", range(4))
def test_packing_is_near_the_optimum(seed):
    dice = random.Random(seed)
    share = []
    for _ in range(25):
        sizes = sorted((min(8192, max(1, int(dice.lognormvariate(6.2, 1)))) for _ in range(8)), reverse=True)
        made = sum(map(packing.cost, packing.pack(sizes)[2]))
        fixed = sum(map(packing.cost, packing.fill(sizes, packing.LENGTHS, lambda i: next(x for x in packing.LENGTHS if x >= sizes[i]))[2]))
        assert made <= fixed
        share.append(made / least_cost(sizes))
    assert min(share) >= 1 - 1e-9 and sum(share) / len(share) < 1.03 and max(share) < 1.15


def test_bins_shrink_and_beat_the_fixed_rule():
    """Bins opened longer than needed and shrunk in the end are cheaper than bins of the first piece's length."""
    won = shrunk = 0
    for seed in range(30):
        dice = random.Random(seed)
        sizes = sorted((dice.choice((300, 340, 600, 680, 1100)) for _ in range(40)), reverse=True)
        opened = {}
        bins, _, lengths = packing.fill(sizes, packing.LENGTHS, lambda i: opened.setdefault(i, next(x for x in packing.LENGTHS if x >= max(2048, sizes[i]))))
        fixed = packing.fill(sizes, packing.LENGTHS, lambda i: next(x for x in packing.LENGTHS if x >= sizes[i]))[2]
        made = packing.pack(sizes)[2]
        shrunk += sum(a > b for a, b in zip(opened.values(), lengths))
        won += sum(map(packing.cost, made)) < sum(map(packing.cost, fixed))
    assert won >= 25 and shrunk >= 10


def test_groups_are_bounded_by_pieces(spark, monkeypatch):
    """Few documents of many pieces make many groups; rows of one id are spread by their texts."""
    monkeypatch.setattr(packing, "GROUP", 10)
    df = spark.createDataFrame([(None if i % 2 else 1, f"w{i} " * (2_000 * i)) for i in range(30)], "doc_id long, text string")
    rows = packing.pack_documents(df, lengths=(512, 1024)).collect()
    assert sum(r["n_tokens"] for r in rows) == sum(2_000 * i for i in range(30))
    groups = Counter(r["bin_group"] for r in rows)
    assert len(groups) > 50 and max(groups.values()) < 40


def test_packed_documents(spark, odd):
    rows = packing.pack_documents(odd.unionByName(spark.createDataFrame([(9, "w " * 20000, "x")], odd.schema))).collect()
    long = sorted((r["piece"], r["first_token"], r["n_tokens"]) for r in rows if r["doc_id"] == 9)
    assert long == [(0, 0, 8192), (1, 8192, 8192), (2, 16384, 3616)]
    assert sum(r["doc_id"] == 1 and r["n_tokens"] == 0 for r in rows) == 2 and len(rows) == len(ODD) + 3
    assert packing.pack_documents(odd.limit(0)).count() == 0


# ---- 3 ----


@pytest.fixture(scope="module")
def reference_coder():
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_equals_the_library(spark, sf, documents, reference_coder):
    got = by_id(registry.QUERIES["op3_byte_bpe"](spark, sf))
    for d, text in documents.items():
        ids = reference_coder.encode_ordinary(text)
        want = len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()
        assert want == (got[d]["n_tokens"], got[d]["ids_sha256"], got[d]["decoded_sha256"])


def test_encoding_of_odd_texts(spark, odd, reference_coder):
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    texts = ["a \x1c b", "\x85\x85 z", " \xa0\xa0q", "héé 😀😀 ñ", "١٢٣ ½ abc", "it's we'll  \n\n  x\t", "​​ a", "𝟘𝟙 x²³", "<|endoftext|>"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = bytebpe.decode(bytebpe.encode(df, path, pattern, offsets=("first", "after")), path, pattern).collect()
    for r in rows:
        assert r["ids"] == reference_coder.encode_ordinary(r["text"]) and bytes(r["decoded"]).decode() == r["text"]
        assert [r["text"][a:b] for a, b in zip(r["first"], r["after"])] and r["first"][0] == 0 and r["after"][-1] == len(r["text"])
    again = bytebpe.decode(bytebpe.encode(odd, path, pattern), path, pattern).collect()
    assert len(again) == len(ODD) and all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in again)
    assert bytebpe.decode(bytebpe.encode(odd.limit(0), path, pattern), path, pattern).count() == 0


def test_decoding_of_ids_outside_the_table(spark):
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    df = spark.createDataFrame([(1, [64, 50_256, 65]), (2, [10**9, -1]), (3, None), (4, [64, None, 65]), (5, [])], "doc_id long, ids array<int>")
    got = {r["doc_id"]: bytes(r["decoded"]) for r in bytebpe.decode(df, path, pattern).collect()}
    assert got[1] == got[4] and len(got[1]) == 2 and got[2] == got[3] == got[5] == b""


def test_encoding_of_a_very_long_text(spark, reference_coder):
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    dice = random.Random(9)
    text = " ".join(dice.choice(["river", "Stein", "naïve", "12", "...", "\n"]) + str(dice.randrange(99)) for _ in range(400_000))
    assert len(text) > 1 << 21
    (row,) = bytebpe.decode(bytebpe.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), path, pattern), path, pattern).collect()
    assert row["ids"] == reference_coder.encode_ordinary(text) and bytes(row["decoded"]).decode() == text


# ---- 4 ----


def test_updates_and_scores_by_the_book():
    """Follow-the-regularised-leader coordinate by coordinate, and a score as a sparse dot product."""
    dice = random.Random(5)
    model, z, n = quality.FTRL(buckets=20), Counter(), Counter()

    def weight(i):
        if abs(z[i]) <= quality.L1:
            return 0.0
        return -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(200):
        at, label = dice.sample(range(21), 5), dice.randrange(2)
        x = [dice.uniform(0, 2) for _ in at]
        p = 1 / (1 + math.exp(-sum(weight(i) * v for i, v in zip(at, x))))
        for i, v in [(i, (p - label) * v) for i, v in zip(at, x)]:
            sigma = (math.sqrt(n[i] + v * v) - math.sqrt(n[i])) / quality.ALPHA
            z[i], n[i] = z[i] + v - sigma * weight(i), n[i] + v * v
        model.learn(np.array(at), np.array(x), label)
    assert model.weights() == pytest.approx([weight(i) for i in range(21)])
    weights = np.random.default_rng(1).normal(size=quality.BUCKETS + 1).astype(np.float32)
    texts = ["", "One two, one two!", "ÉÉ x9 ... 12", " \n"]
    data, offsets = column_bytes(pa.array(texts))
    at, of = quality.features(data, offsets, Hasher())
    for k, got in enumerate(quality.scores(weights, data, offsets, Hasher())):
        mine = Counter(at[of == k].tolist())
        dot = sum(float(weights[i]) * c * quality.SCALE / sum(mine.values()) for i, c in mine.items()) + float(weights[-1])
        assert got == pytest.approx(1 / (1 + math.exp(-dot)), rel=1e-4)


def test_quality_on_held_out_rows(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    got = by_id(registry.QUERIES["op4_quality"](spark, sf))
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(got[d]["score"], y) for d, y in labels.items() if d in got and got[d]["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for d, r in got.items())
    good, bad = ([s for s, y in held if y == k] for k in (1, 0))
    assert sum(g > b for g in good for b in bad) > 0.95 * len(good) * len(bad)


def test_quality_of_odd_rows(spark, odd):
    weights = quality.train([])
    rows = quality.score(odd, weights).collect()
    assert [r["score"] for r in rows] == [0.5] * len(ODD)
    labels = spark.createDataFrame([(3, 1), (2**60, 0), (77, 1), (1, None)], "doc_id long, quality int")
    assert quality.score(odd, quality.fit(odd, labels)).count() == len(ODD)
    assert quality.score(odd.limit(0), weights).count() == 0
    assert (quality.fit(odd, labels.limit(0)) == 0).all()


# ---- 5 ----


def plain_repeats(rows, least=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = t.encode()
        gone = bytearray(len(b))
        for a in range(len(b) - least + 1):
            if (w := b[a : a + least]) in seen:
                gone[a : a + least] = b"\1" * least
            else:
                seen.add(w)
        runs = sum(bool(x) and not (k and gone[k - 1]) for k, x in enumerate(gone))
        out[i] = len(b), sum(gone), runs, hashlib.sha256(bytes(c for c, x in zip(b, gone) if not x)).hexdigest()
    return out


DIGEST = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def digests(df, **more):
    return {r["doc_id"]: tuple(r[c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in repeats.joined(df, repeats.repeats(df, **more), repeats.digest, DIGEST).collect()}


@pytest.mark.parametrize("many", [1, 1000])
def test_repeats(spark, sf, documents, many):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    assert digests(df, many=many) == plain_repeats(documents.items())


@pytest.mark.parametrize("many", [1, 1000])
def test_groups_hold_every_place(spark, many):
    """Each group's places all hold its bytes, and every repeated window lies in a group with all its places."""
    dice = random.Random(6)
    word = lambda: "".join(dice.choice("abcdefgh") for _ in range(7))
    passage = [" ".join(word() for _ in range(40)) for _ in range(3)]
    docs = [(i, " ".join([word(), dice.choice(passage)[dice.randrange(60) :], word(), dice.choice(passage)])) for i in range(25)] + [(None, passage[0]), (90, passage[0])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    at = defaultdict(set)
    for r in repeats.groups(df, many=many).collect():
        at[r["group_id"], r["length"]].add((r["doc_id"], r["start"]))
    text = dict(docs)
    windows = defaultdict(set)
    for d, t in docs:
        for i in range(len(t) - 99):
            windows[t[i : i + 100]].add((d, i))
    covered = defaultdict(set)
    for (_, n), places in at.items():
        assert len({text[d][i : i + n] for d, i in places}) == 1 and len(places) > 1
        for k in range(n - 99):
            d, i = next(iter(places))
            covered[text[d][i + k : i + k + 100]] |= {(d, i + k) for d, i in places}
    assert {w for w, p in windows.items() if len(p) > 1} == set(covered)
    assert all(covered[w] == windows[w] for w in covered)


def test_repeats_of_very_long_texts(spark):
    """Texts over 4 MB are worked on in parts; a copy across a part's border is found whole."""
    dice = np.random.default_rng(8)
    long = dice.integers(97, 123, 9_000_000).astype(np.uint8).tobytes().decode()
    border = repeats.LONG
    docs = [(1, long), (2, "start " + long[border - 5_000 : border + 5_000] + " end"), (3, "x" * 50 + long[2 * border - 70 : 2 * border + 70])]
    got = digests(spark.createDataFrame(docs, "doc_id long, text string"))
    assert got[1][1] == 0 and got[2][1:3] == (10_000, 1) and got[3][1:3] == (140, 1)


def test_repeats_in_small_alphabets(spark):
    dice = random.Random(4)
    base = ["".join(dice.choice("ab") for _ in range(400)) for _ in range(3)]
    docs = []
    for i in range(40):
        t = dice.choice(base)[dice.randrange(100) :]
        docs.append((i, t[: dice.randrange(len(t))] + dice.choice(["", "é", "a" * 150]) + dice.choice(base)[: dice.randrange(300)]))
    assert digests(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)) == plain_repeats(docs)


def test_maximal_repeats():
    dice = np.random.default_rng(1)
    for _ in range(40):
        least = int(dice.integers(3, 7))
        docs = [bytes(dice.integers(97, 99, int(dice.integers(0, 40))).astype(np.uint8)) for _ in range(4)]
        ends = np.cumsum([len(d) for d in docs])
        starts = ends - [len(d) for d in docs]
        data = np.frombuffer(b"".join(docs), np.uint8)
        got = {bytes(data[p[0] : p[0] + n]): sorted(p.tolist()) for n, p in repeats.maximal_repeats(data, starts, ends, least)}
        at = defaultdict(list)
        for d, s in zip(docs, starts):
            for i in range(len(d)):
                for j in range(i + least, len(d) + 1):
                    at[d[i:j]].append((int(s) + i, i, d))
        want = {}
        for k, found in at.items():
            before = {d[i - 1] if i else -n for n, (_, i, d) in enumerate(found, 1)}
            after = {d[i + len(k)] if i + len(k) < len(d) else -n for n, (_, i, d) in enumerate(found, 1)}
            if len(found) > 1 and len(before) > 1 and len(after) > 1:
                want[k] = sorted(p for p, _, _ in found)
        assert got == want


def test_repeats_of_odd_rows(spark, odd):
    rows = repeats.joined(odd, repeats.repeats(odd), repeats.digest, DIGEST).collect()
    assert sorted((r["n_bytes"], r["n_removed"]) for r in rows) == [(0, 0), (0, 0), (4, 0), (11, 0), (200, 198), (200, 198), (203, 200)]
    kept = repeats.without_repeats(spark, odd.withColumn("n_chars", F.lit(0)), "")
    assert kept.columns == ["doc_id", "text", "target", "n_chars"] and kept.count() == len(ODD)
    assert repeats.without_repeats(spark, odd.withColumn("n_chars", F.lit(0)).limit(0), "").count() == 0


def test_cut_characters_stay_whole():
    text = "ééé".encode()
    assert repeats.cut_out(text, np.array([[1, 5]])) == ("éé",)
    assert repeats.cut_out(text, np.array([[0, 6]])) == ("",)


# ---- 6 ----


def plain_components(docs):
    sets = {}
    for i, t in docs:
        w = tokens(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    both = Counter(p for found in holders.values() for p in itertools.combinations(sorted(found), 2))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in both.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def linked(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df).collect()}


def test_jaccard(spark, sf, documents):
    assert linked(spark.read.parquet(f"{sf}/documents.parquet")) == plain_components(documents.items())


@pytest.mark.parametrize("few", [2, 10**9])
def test_jaccard_near_the_threshold(spark, monkeypatch, few):
    """With every repeated shingle common, and with none."""
    monkeypatch.setattr(jaccard, "FEW", few)
    if few < 20:  # hot keys are salted, and groups compared in blocks
        monkeypatch.setattr(jaccard, "MEMBERS", 3)
        monkeypatch.setattr(jaccard, "SALT", 3)
        monkeypatch.setattr(shared, "SALT", 3)
    dice = random.Random(3)
    base = [[f"w{dice.randrange(5000)}" for _ in range(dice.choice([6, 8, 9, 10, 12, 20, 40, 120, 600]))] for _ in range(40)]
    docs = []
    for i in range(700):
        b = list(dice.choice(base))
        for _ in range(dice.choice([0, 0, 1, 1, 2, max(1, len(b) // 60)])):
            k, r = dice.randrange(len(b)), dice.random()
            if r < 0.4:
                b[k] = f"w{dice.randrange(5000)}"
            elif r < 0.6:
                b.insert(k, f"x{dice.randrange(99)}")
            elif r < 0.8:
                b += [f"y{dice.randrange(99)}"] * dice.randrange(1, 3)
            else:
                b = b[1:] or b
        docs.append((i, " ".join(b)))
    assert linked(spark.createDataFrame(docs, "doc_id long, text string").repartition(8)) == plain_components(docs)


def test_jaccard_of_odd_rows(spark, odd):
    rows = jaccard.near_duplicates(odd).collect()
    assert sorted((r["n_shingles"], r["component_id"] is None) for r in rows) == [(0, False), (0, False), (0, False), (1, False), (1, False), (1, False), (2, True)]
    stayed = jaccard.one_of_each(spark, odd, "")
    assert stayed.columns == odd.columns and stayed.where("doc_id = 3").count() == 2
    assert jaccard.near_duplicates(odd.limit(0)).count() == 0


# ---- 7 ----


def test_main_text_of_the_pages(spark, sf):
    got = by_id(registry.QUERIES["op7_main_text"](spark, sf), "page_id")
    import html

    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        article = r["html"].partition("<article>")[2].partition("</article>")[0]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"</?b>", "", p).replace("<br>", " "))).strip() for p in re.split(r"</?(?:h1|p)>", article)]
        assert got[r["page_id"]]["text"] == "\n".join(filter(None, blocks))


def test_main_text_of_other_layouts():
    page = """<html><head><title>t</title></head><body><header><h1>Site</h1><nav><a href=1>Home</a> <a href=2>News</a></nav></header>
    <div class="cookie-notice"><p>We use cookies to improve your experience. By continuing you accept all of them in every way.</p></div>
    <main><h1>A headline</h1><p>First paragraph of the story, with a <a href=x>link</a> and enough words to be read as prose by anyone &amp; all.</p>
    <aside><p>Related: other stories that you may like to read, if time permits you to do so today.</p></aside>
    <p>Second paragraph. It is rather short.</p><ul><li>one</li><li>two</li></ul></main><section id="comments"><h2>Comments</h2>
    <p>I liked this story very much, thanks for writing it and sharing it with all of us here.</p></section><form><label>Mail</label><input></form><footer>&copy; 2020</footer>"""
    want = "A headline\nFirst paragraph of the story, with a link and enough words to be read as prose by anyone & all.\nSecond paragraph. It is rather short.\none\ntwo"
    assert maintext.main_text(page) == want
    assert maintext.main_text(None) == maintext.main_text("") == maintext.main_text("<script>var a = '<p>x</p>'</script>") == ""
    assert maintext.main_text("<p>a < b & c") == "a < b & c"


def test_minimum_cut_is_the_cheapest_labelling():
    dice = random.Random(6)
    for _ in range(60):
        n = dice.randrange(1, 8)
        lean = [dice.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, dice.uniform(0, 2)) for a in range(n) for b in range(a + 1, n) if dice.random() < 0.5]
        cost = lambda keep: sum(max(0, x) if not k else max(0, -x) for x, k in zip(lean, keep)) + sum(c for a, b, c in edges if keep[a] != keep[b])  # noqa: E731, B023
        assert cost(maintext.minimum_cut(lean, edges)) == pytest.approx(min(map(cost, itertools.product([True, False], repeat=n))))


@pytest.mark.parametrize("tag", ["<p title=Bob's>", '<img alt="5" tall">', "<p =\">", "<p title = 'a > b' id=x'y>"])
def test_main_text_after_stray_quotes(spark, tag):
    said = "The ferry left at noon, and the whole village came to see it go. It carried grain, letters and two goats."
    page = f"<article>{tag}<p>{said}</p><p class=\"b\">It didn't return that winter, and nobody spoke of it, as far as we know.</p></article>"
    ((text,),) = maintext.extract(spark.createDataFrame([(1, page)], "page_id long, html string")).select("text").collect()
    assert said in text and "that winter" in text and "Bob" not in text and "tall" not in text


@pytest.mark.parametrize("opening", ['<p title="the hidden gem">', '<p aria-hidden="false">', "<p data=it's>", '<p data-id="sidebar">', '<p title="class=nav">', "<p data-hidden>"])
def test_only_an_attributes_own_name_and_value_count(opening):
    said = "The ferry left at noon, and the whole village came to see it go. It carried grain, letters and two goats."
    assert maintext.main_text(f"<article><h1>Ferry</h1>{opening}{said}</p></article>") == f"Ferry\n{said}"
    assert maintext.main_text(f"<article><h1>Ferry</h1><p HIDDEN>{said}</p><p>It has <math><mi>n</mi></math> goats on board, all in all.</p></article>") == "Ferry\nIt has n goats on board, all in all."


def test_long_pages_take_linear_time():
    import time

    page = "<nav><a href=1>Home</a></nav><article>" + "".join(f"<p>Paragraph {i} tells of a day at sea and of the people who went there.</p>" + ("<div class=ad>Buy now!</div>" if i % 3 == 0 else "") for i in range(40_000)) + "</article>"
    began = time.time()
    text = maintext.main_text(page)
    assert text.count("\n") == 39_999 and "Buy" not in text and time.time() - began < 30
    deep = "<div>" * 20_000 + "<p>Some words of a story, told at the bottom of it all, far below the surface.</p>"
    assert "bottom" in maintext.main_text(deep) and time.time() - began < 40


def test_class_names_are_learnt(spark):
    """What a site's own names mean is learnt from pages that have article elements, and holds for those that haven't."""
    dice = random.Random(2)
    prose = lambda n: " ".join(dice.choice(["river", "stone", "night", "walks", "under", "bright", "old"]) for _ in range(n)) + "."
    kept, lost = [], []
    rows = []
    for i in range(120):
        body, offer = [prose(14) for _ in range(3)], prose(30)
        text = "".join(f'<p class="zork">{p}</p>' for p in body)
        story = f"<article>{text}</article>" if i % 4 else f"<div>{text}</div>"
        rows.append((i, f'<body><div class="qux"><p>{offer}</p></div>{story}</body>'))
        kept.append("\n".join(body))
        lost.append(offer)
    df = spark.createDataFrame(rows, "page_id long, html string")
    weights = maintext.fit(df)
    got = {r["page_id"]: r["text"] for r in maintext.extract(df, weights=weights).collect()}
    assert all(got[i] == kept[i] for i in got)
    assert any(lost[i] in r["text"] for i, r in by_id(maintext.extract(df), "page_id").items())  # the prior can't know
    assert maintext.fit(df.limit(0)) is None
    assert maintext.fit(spark.createDataFrame([(1, "<p>Words that nothing tells about."), (2, None)], "page_id long, html string")) is None


def test_main_text_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "t"), (1, "", "u"), (None, "<p>Hello there, you.", None)], "page_id long, html string, text string")
    assert [r["text"] for r in maintext.extract(df).collect()] == ["", "", "Hello there, you."]
    assert maintext.extract(df.limit(0)).count() == 0


# ---- 8 ----


def smoothed(words_of, learnt, discount=0.75):
    """Counts, and the exact log10 probability of a list of words."""
    c = Counter(w for i in learnt for w in words_of[i])
    under = sum(c.values()) + 0.5 * (len(c) + 1)
    pairs, triples, context = Counter(), Counter(), Counter()
    for i in learnt:
        for u, v, w in zip(["<2>", "<1>", *words_of[i]], ["<1>", *words_of[i]], words_of[i]):
            pairs[v, w] += 1
            context[v,] += 1
            triples[u, v, w] += 1
            context[u, v] += 1
    rest = {}
    for grams in (pairs, triples):
        for g, n in grams.items():
            rest[g[:-1]] = rest.get(g[:-1], 1.0) - (n - discount) / context[g[:-1]]

    def log10(words):
        total = 0.0
        for u, v, w in zip(["<2>", "<1>", *words], ["<1>", *words], words):
            p = (c[w] + 0.5) / under
            for grams, g in ((pairs, (v, w)), (triples, (u, v, w))):
                p = ((grams[g] - discount) / context[g[:-1]] if g in grams else 0.0) + max(rest.get(g[:-1], 1.0), 0.0) * p
            total += math.log10(p)
        return total

    return c, under, log10


@pytest.mark.parametrize("share", [language.SHARE, 4_000])
def test_language_model(spark, sf, documents, monkeypatch, share):
    """Singletons count, and words with more than a shard's share of the tokens are as exact as others."""
    monkeypatch.setattr(language, "SHARE", share)
    words_of = {i: [*tokens(t), None] for i, t in documents.items()}
    learnt = [i for i in words_of if zlib.crc32(str(i).encode()) % 5 != 1]
    c, under, log10 = smoothed(words_of, learnt)
    sums = Counter()
    for i, r in by_id(registry.QUERIES["op8_language_model"](spark, sf)).items():
        x = words_of[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(x), sum(c[w] > 0 for w in x), sum(c.values()), i not in learnt)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.5) / under) for w in x))
        exact = log10(x)
        assert abs(r["score"] - exact) < 0.001 * len(x) and r["score"] <= exact + 1e-6
        if r["held_out"]:
            sums.update(base=r["base_score"], model=r["score"])
    assert sums["model"] > sums["base"]


def test_hot_words_have_many_shards(spark, monkeypatch):
    """A third of all pairs begin with one word."""
    monkeypatch.setattr(language, "SHARE", 500)
    dice = random.Random(3)
    texts = {i: " ".join(x for _ in range(20) for x in ("the", f"w{dice.randrange(300)}", f"w{dice.randrange(30)}")) for i in range(60)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    model = language.train(df)
    assert len(model.triples.hot) == 1 and len(model.triples.names) > 3
    words_of = {i: [*tokens(t), None] for i, t in texts.items()}
    _, _, log10 = smoothed(words_of, words_of)
    for i, r in by_id(language.score(df, model)).items():
        assert abs(r["score"] - log10(words_of[i])) < 0.001 * len(words_of[i])


def test_language_model_of_a_very_long_text(spark, monkeypatch):
    """A text longer than a block is one block; blocks don't change scores."""
    dice = random.Random(4)
    texts = [(1, " ".join(f"w{dice.randrange(900)}" for _ in range(40_000))), (2, "w1 w2 w3"), (3, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    whole = {i: r["score"] for i, r in by_id(language.score(df, language.train(df))).items()}
    monkeypatch.setattr(language, "BLOCK", 1 << 12)
    for i, r in by_id(language.score(df, language.train(df))).items():
        assert r["score"] == pytest.approx(whole[i])
    _, _, log10 = smoothed({i: [*tokens(t), None] for i, t in texts}, [1, 2, 3])
    assert abs(whole[1] - log10([*tokens(texts[0][1]), None])) < 40


@pytest.mark.parametrize("seed", range(3))
def test_children_of_a_level(seed):
    dice = np.random.default_rng(seed)
    counts = dice.integers(0, 6, 80)
    lists = [np.sort(dice.choice(30, k, replace=False)) for k in counts]
    at = np.concatenate(([0], np.cumsum(counts)))
    level = eliasfano.Children(np.frombuffer(eliasfano.padded(eliasfano.Children.encode(counts, np.concatenate(lists))), np.uint8), 0)
    ranges = level.ranges(np.arange(80))
    assert ranges[0].tolist() == at[:-1].tolist() and ranges[1].tolist() == at[1:].tolist()
    for x in range(31):
        assert level.find(*ranges, np.full(80, x)).tolist() == [at[i] + n.tolist().index(x) if x in n else -1 for i, n in enumerate(lists)]


def test_language_model_without_a_mounted_folder(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    mounted = language.score(docs, language.train(docs)).collect()
    monkeypatch.setattr(language, "local_path", lambda uri: None)
    assert sorted(language.score(docs, language.train(docs)).collect()) == sorted(mounted)


def test_language_model_of_odd_rows(spark, odd):
    rows = language.score(odd, language.train(odd)).collect()
    assert sorted(r["n_tokens"] for r in rows) == [1, 1, 1, 2, 2, 2, 7]
    unlearnt = language.score(odd, language.train(odd.limit(0))).collect()
    assert {(r["n_known"], r["score"]) for r in unlearnt} == {(0, 0.0)}
    assert language.score(odd.limit(0), language.train(odd)).count() == 0


# ---- 9 ----


def test_passages(spark, sf, documents):
    found = registry.QUERIES["op9_passages"](spark, sf).collect()
    words_of = {i: tokens(t) for i, t in documents.items()}
    covered = defaultdict(set)
    for r in found:
        covered[r["doc_id"]].update(range(r["first_word"], r["first_word"] + r["n_words"]))
        x = words_of[r["doc_id"]][r["first_word"] :][: r["n_words"]]
        y = words_of[r["source_doc_id"]][r["source_first_word"] :][: r["source_n_words"]]
        assert min(len(x), len(y)) >= 50 and r["identity"] >= 0.8
        import difflib

        assert sum(b.size for b in difflib.SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks()) >= 0.95 * r["matched_words"]
    seen, whole, missed = {}, 0, 0
    for i in sorted(words_of):
        w = words_of[i]
        for a in range(len(w) - 49):
            k = tuple(w[a : a + 50])
            if seen.setdefault(k, i) != i:
                whole += 1
                missed += len(covered[i] & set(range(a, a + 50))) < 45
    assert whole > 1000 and missed <= 0.005 * whole


def test_fuzzy_passage_and_odd_rows(spark, odd):
    line = [f"a{i}" for i in range(60)]
    fuzzy = ["q", *(w if i % 13 else "zz" for i, w in enumerate(line)), "r"]
    df = spark.createDataFrame([(1, " ".join(line)), (4, " ".join(fuzzy)), (5, " ".join(line[::-1])), (6, " ".join(line[:49]))], "doc_id long, text string")
    (r,) = passages.passages(df).collect()
    assert (r["doc_id"], r["source_doc_id"], r["n_words"], r["matched_words"]) == (4, 1, 59, 55)
    assert passages.passages(odd).count() == 0 and passages.passages(odd.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [1, 12])
def test_passage_whose_halves_stand_elsewhere(spark, parts):
    line = [f"a{i}" for i in range(60)]
    pad = lambda k: [f"{k}{i}" for i in range(70)]
    docs = [(1, pad("c") + line[:30] + pad("d")), (2, pad("e") + line[30:] + pad("f")), (3, pad("g") + line + pad("h")), (4, pad("i") + line[:30] + pad("j")), (5, pad("k") + line[30:] + pad("l")), (6, pad("m") + line + pad("n"))]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string").repartition(parts)
    found = {(r["doc_id"], r["source_doc_id"], r["first_word"], r["n_words"]) for r in passages.passages(df).collect()}
    assert found == {(6, 3, 70, 60)}


@pytest.mark.parametrize("most", [passages.MOST, 0])
def test_passage_whose_every_seed_stands_elsewhere(spark, monkeypatch, most):
    """All seeds of the last document's passage stand in others before and after the only one that has all of it; and so if all seeds are hot."""
    monkeypatch.setattr(passages, "MOST", most)
    line = [f"a{i}" for i in range(60)]
    pad = lambda k: [f"{k}{i}" for i in range(70)]
    parts = [part for _ in range(3) for part in (line[:34], line[26:])]
    docs = [pad(f"{k}b") + part + pad(f"{k}c") for k, part in enumerate([*parts, line, *parts, line])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string").repartition(1)
    found = {(r["doc_id"], r["source_doc_id"], r["n_words"], r["class_doc_id"], r["class_first_word"]) for r in passages.passages(df).collect()}
    assert found == {(13, 6, 60, 6, 70)}


@pytest.mark.parametrize("most", [passages.MOST, 0])
def test_passages_against_all_pairs(spark, monkeypatch, most):
    """Any two places with a passage in common, by brute force over diagonals, are covered and have one class; and so if all seeds are hot."""
    monkeypatch.setattr(passages, "MOST", most)
    dice = random.Random(5)
    lines = [[f"w{dice.randrange(3_000)}" for _ in range(dice.randrange(9, 32))] for _ in range(40)]
    docs = []
    for k in range(150):
        words = [w for _ in range(dice.randrange(1, 6)) for w in (*lines[min(39, int(dice.expovariate(0.1)))], *(f"{k}x{dice.random()}" for _ in range(dice.choice([0, 0, 0, 40]))))]
        docs.append([w if dice.random() < 0.94 else f"{k}y{i}" for i, w in enumerate(words)])
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    classes_of = defaultdict(set)
    for r in passages.passages(df).collect():
        one = r["class_doc_id"], r["class_first_word"]
        for doc, first, size in ((r["doc_id"], r["first_word"], r["n_words"]), (r["source_doc_id"], r["source_first_word"], r["source_n_words"])):
            for i in range(first, first + size):
                classes_of[doc, i].add(one)
    assert all(len(c) == 1 for c in classes_of.values())
    wanted = lost = 0
    for a, b in itertools.combinations(range(len(docs)), 2):
        for shift in range(-len(docs[a]) + 50, len(docs[b]) - 49):
            start = max(0, -shift)
            same = np.array([docs[a][i] == docs[b][i + shift] for i in range(start, min(len(docs[a]), len(docs[b]) - shift))])
            if same.sum() < 40:
                continue
            total = np.append(0, np.cumsum(same))
            for i in np.flatnonzero((total[50:] - total[:-50] >= 40) & same[:-49] & same[49:]).tolist():
                wanted += 1
                left, right = (set().union(*(classes_of.get((doc, at + k), set()) for k in range(50))) for doc, at in ((a, start + i), (b, start + i + shift)))
                lost += not left & right
    assert wanted > 30 and not lost


def test_rows_of_one_word_are_of_one_class(spark):
    """Rows of one word are linked with the first of them, not each with each."""
    pad = lambda k: [f"{k}{i}" for i in range(70)]
    docs = [pad(f"{k}b") + ["the"] * (60 + k % 9) + pad(f"{k}c") for k in range(40)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string").repartition(3)
    found = passages.passages(df).collect()
    assert {r["doc_id"] for r in found} == set(range(1, 40)) and len(found) < 100
    assert {(r["class_doc_id"], r["class_first_word"]) for r in found} == {(0, 70)}


def test_chains_with_too_few_words_in_common_are_not_aligned():
    row, rest = np.full(80, 7, "<u4"), np.arange(100, 180, dtype="<u4")
    place = np.array([[0], [0], [4]])
    assert passages.hopeful([(place, row, np.append(row[:12], rest)), (place, rest, rest), (place, row, row[:60])], 50, 0.8).tolist() == [False, True, True]


def test_passages_keep_no_more_on_disk_than_they_need(spark, sf, monkeypatch):
    """What a step shuffled is gone when it ends, packets when they are aligned; what goes to the earlier documents is shuffled in parts."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        found = [manager.getAllFiles().apply(i) for i in range(manager.getAllFiles().size())]
        return {f.getName(): f.length() for f in found if f.getName().startswith("shuffle_")}

    known, settled = shuffled(), []

    def settle(df, *more, **named):
        settled.append(shared.settle(df, *more, **named))
        return settled[-1]

    monkeypatch.setattr(passages, "settle", settle)
    df = spark.read.parquet(f"{sf}/documents.parquet")
    found = passages.passages(df)
    left = sum(size for name, size in shuffled().items() if name not in known)
    assert left < sum(len(r["text"] or "") for r in df.collect()) / 20
    gone = [all(not os.path.exists(f.removeprefix("file://")) for f in part.inputFiles()) for part in settled]
    assert gone == [True] * 3 + [False] * passages.ROUNDS and found.count() > 0


@pytest.mark.parametrize("identity", [0.8, 0.85, 0.9])
def test_passages_of_low_identity(spark, identity):
    """A brute-force alignment of each pair says which have a passage; all of these are found."""
    dice = random.Random(int(identity * 100))
    docs, wanted = [], set()
    for k in range(60):
        line = [f"{k}a{i}" for i in range(60)]
        changed = range(4, 60, round(1 / (1 - identity))) if k % 2 else dice.sample(range(60), round(60 * (1 - identity)))
        copy = [f"{k}z{i}" if i in set(changed) else w for i, w in enumerate(line)]
        same = [a == b for a, b in zip(line, copy)]
        if any(sum(same[i:j]) >= 0.8 * (j - i) for i in range(11) for j in range(i + 50, 61)):
            wanted.add((1000 + k, k))
        docs += [(k, line), (1000 + k, [f"{k}q{i}" for i in range(9)] + copy + [f"{k}r{i}" for i in range(9)])]
    found = passages.passages(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")).collect()
    assert len(wanted) == 60 and {(r["doc_id"], r["source_doc_id"]) for r in found} == wanted
    assert all(r["n_words"] >= 50 and r["identity"] >= 0.8 for r in found)


def test_chains_are_the_best():
    x, y, size = (np.array(c) for c in ([0, 10, 20, 30], [0, 50, 10, 20], [6, 20, 6, 6]))
    assert sorted(map(tuple, passages.chains(x, y, size))) == [(0, 2, 3), (1,)]
    # a great fragment far away doesn't hide a small one nearby
    x, y, size = (np.array(c) for c in ([0, 400, 410], [0, 400, 410], [200, 6, 30]))
    assert sorted(map(tuple, passages.chains(x, y, size))) == [(0,), (1, 2)]


@pytest.mark.parametrize("seed", range(5))
def test_chains_against_all_predecessors(seed):
    dice = np.random.default_rng(seed)
    x, y, size = dice.integers(0, 900, 120), dice.integers(0, 900, 120), dice.integers(4, 20, 120)
    by = np.lexsort((y, x))
    x, y, size = x[by], y[by], size[by]
    best = np.zeros(120)
    for i in range(120):
        best[i] = size[i]
        for j in range(i):
            gap = x[i] - x[j] - size[j], y[i] - y[j] - size[j]
            if x[j] < x[i] and y[j] < y[i] and min(gap) >= -passages.SEED and max(gap) <= passages.GAP:
                best[i] = max(best[i], best[j] + size[i] - passages.SKIP * sum(gap) + min(0, *gap))
    # what a chain found is worth, by its own links
    made = 0.0
    for chain in passages.chains(x, y, size):
        worth = float(size[chain[0]])
        for j, i in zip(chain, chain[1:]):
            gap = x[i] - x[j] - size[j], y[i] - y[j] - size[j]
            assert x[j] < x[i] and y[j] < y[i] and max(gap) < 2 * passages.GAP
            worth += size[i] - passages.SKIP * sum(gap) + min(0, *gap)
        made = max(made, worth)
    assert made >= best.max() - 1e-9


def test_extensions_are_alignments():
    """Many at a time give what one at a time does: words used, and score."""
    dice = random.Random(7)
    problems = []
    for _ in range(300):
        a = [dice.randrange(12) for _ in range(dice.choice([0, 1, 5, 30, 64]))]
        b = [x if dice.random() < 0.8 else dice.randrange(12) for x in a for _ in range(dice.choice([1, 1, 1, 1, 0, 2]))] + [dice.randrange(12) for _ in range(dice.randrange(10))]
        problems.append((a, b[:74]))
    score = lambda columns: sum(1 if c == passages.MATCH else -4.0 for c in columns)
    used = lambda columns: (sum(c != passages.EARLIER for c in columns), score(columns))
    for (a, b), got in zip(problems, passages.extensions(problems, 4.0, 40.0, 64)):
        assert used(got.tolist()) == pytest.approx(used(passages._align(a, b, 4.0, 40.0)))
        i = j = 0
        for c in got.tolist():
            assert c not in (passages.MATCH, passages.MISMATCH) or (a[i] == b[j]) == (c == passages.MATCH)
            i, j = i + (c != passages.EARLIER), j + (c != passages.LATER)
    assert passages.extensions([], 4.0, 40.0) == []


def test_every_stretch_of_a_chain(spark):
    """Two copied passages with forty changed words between them: both are found, though one chain joins them."""
    one, two = ([f"{k}{i}" for i in range(60)] for k in "ab")
    docs = [(1, one + [f"c{i}" for i in range(40)] + two), (2, ["x", *one, *[f"d{i}" for i in range(40)], *two, "y"])]
    found = passages.passages(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["first_word"], r["n_words"], r["source_first_word"]) for r in found) == [(2, 1, 60, 0), (2, 101, 60, 100)]


def test_passages_of_a_very_long_text(spark):
    """A passage near the end of a text of 300,000 words."""
    long = [f"w{i}" for i in range(300_000)]
    found = passages.passages(spark.createDataFrame([(1, " ".join(long)), (2, "a b c " + " ".join(long[299_000:299_080]) + " d e f")], "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["first_word"], r["n_words"], r["source_first_word"]) for r in found] == [(2, 3, 80, 299_000)]


# ---- 10 ----


@pytest.mark.parametrize("shard", [60, 100_000])
def test_neighbours(spark, sf, shard):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = df.collect()
    v, ids = np.array([r["embedding"] for r in rows], float), np.array([r["vec_id"] for r in rows])
    got = defaultdict(list)
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, shard=shard).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    for i in np.flatnonzero(ids % 20 == 0):
        s = v @ v[i]
        s[i] = -np.inf
        best = np.lexsort((ids, -s))[:20]
        assert [x[1] for x in sorted(got[ids[i]])] == ids[best].tolist()
        assert [x[2] for x in sorted(got[ids[i]])] == pytest.approx(s[best].tolist())
    relaxed = neighbours.nearest(df, F.col("vec_id") % 20 == 0, factor=1.3, shard=shard).collect()
    exact = {(q, x[1]) for q, found in got.items() for x in found}
    assert len({(r["query_id"], r["vec_id"]) for r in relaxed} & exact) >= 0.9 * len(exact)


def test_small_leaves_stay_exact():
    dice = np.random.default_rng(3)
    v = dice.normal(size=(600, 3)) * dice.uniform(0.1, 3, (600, 1))
    ids = np.arange(600)
    tops = {}
    for q, c, _ in neighbours.best_of_shard(v, ids, iter([(ids[:50], v[:50], np.full(50, -np.inf))]), 5, 1.0, float(np.linalg.norm(v, axis=1).max())):
        for a, b in zip(q.tolist(), c.tolist()):
            tops.setdefault(a, []).append(b)
    for i in range(50):
        s = v @ v[i]
        s[i] = -np.inf
        assert tops[i] == np.lexsort((ids, -s))[:5].tolist()


@pytest.mark.parametrize("shard", [40, 100_000])
def test_neighbours_in_clusters(spark, shard):
    """Clusters, one vector that a third of all rows hold, and vectors of very different lengths; exact, and without sending queries everywhere."""
    dice = np.random.default_rng(5)
    centre = dice.normal(size=(8, 16)) * 5
    v = centre[dice.integers(0, 8, 600)] + dice.normal(size=(600, 16)) * 0.2
    v[::3] = v[0]
    v[1::50] *= 3
    ids = np.arange(600)
    df = spark.createDataFrame([(int(i), x.tolist(), "e") for i, x in zip(ids, v)], "vec_id long, embedding array<double>, _v string")
    got = defaultdict(list)
    for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0, shard=shard).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"]))
    for i in ids[::20]:
        s = v @ v[i]
        s[i] = -np.inf
        found = [x[1] for x in sorted(got[i])]
        best = np.lexsort((ids, -np.round(s, 9)))[:20]
        assert np.allclose(np.sort(s[found]), np.sort(s[best])) and len(set(found)) == 20
    cells = neighbours.Cells(centre, shard)
    cell, far = cells.nearest(v)
    cells.settle([{"_cell": c, "n": int((cell == c).sum()), "radius": far[cell == c].max(), "norm": np.linalg.norm(v[cell == c], axis=1).max()} for c in np.unique(cell).tolist()])
    assert shard > 40 or cells.total > 8
    reached = np.array([np.sort(v @ q)[-21] for q in v])
    row, to = cells.further(v, reached, cell)
    for i in range(600):
        missing = [c for c in range(8) if c != cell[i] and c not in to[row == i]]
        assert not len(missing) or (v[np.isin(cell, missing)] @ v[i]).max(initial=-np.inf) < reached[i]
    assert len(row) < 0.8 * 600 * 7


def test_neighbours_of_huge_vectors(spark):
    """A vector whose squared length is beyond doubles takes no part."""
    df = spark.createDataFrame([(20, [1.0, 1.0]), (1, [1e200, 0.0]), (2, [1e100, 0.0]), (3, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0).orderBy("rank").collect()] == [2, 3]


def test_neighbours_of_odd_rows(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (None, [1.0, 1.0]), (3, None), (4, [nan, 1.0]), (20, [1.0, 1.0]), (20, [1.0, 1.0]), (5, [1.0, None]), (7, [1.0, 0.0]), (8, [1.0, 2.0, 3.0])], "vec_id long, embedding array<float>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.nearest(df, F.col("vec_id") % 20 == 0).orderBy("rank").collect()]
    assert got == [(20, 1, 1, 1.0), (20, 2, 7, 1.0)]
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
