"""MinHash near-dedup by a multi-index Hamming join of b-bit signatures.

A document's set holds its distinct word shingles; a document with fewer words than a shingle has its
whole sequence as the one element. Signatures have `symbols` entries of 16 bits, the minima of as many
hash functions. They are cut into chunks of four symbols, and a join of signatures under a Hamming
distance of 2 * chunks - 1 symbols follows from the pigeonhole principle: some chunk of such a pair
has at most one error. Each chunk is therefore indexed four times, each time with one symbol masked;
every pair under the distance meets in some key. The number of chunks is the smallest for which a pair
at the similarity threshold exceeds that distance with a probability of at most `miss`.

Copies with equal sets are one class from the start, and only class representatives are joined.
Within the rows of a key, links are found without writing out all pairs: each representative is
first held against the smallest one that it meets most often; then only rows of keys that still
span several components are compared across components, best pairs first, until no pair that a key
brought together is left unverified across components. Every link is confirmed on the full sets.

Null texts and texts without words have an empty set and link with nothing. Repeated rows share
their class. An empty table gives an empty result; columns beside id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import CACHE_LIMIT, as_bytes, checkpointed, lowered_words, scratch, stored
from seqloom.llm.graph import components, forest

CHUNK = 4
#: Hash functions in all; those beyond the index are kept to 8 bits and only thin out candidates.
FUNCTIONS = 128
#: Rows of a key up to which they are compared as one group, and rows of a block beyond that.
GROUP, BLOCK = 128, 1024
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit depends on every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a limit."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_LIMIT:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """The sorted distinct hashes of a document's shingles, from the hashes of its words."""
    n = len(words)
    if n == 0:
        return words
    span = min(n, width)
    h = np.full(n - span + 1, span, np.uint64)
    for j in range(span):
        h = mixed(h + words[j : n - span + 1 + j]) * _MULTIPLIER
    return np.unique(h)


def chunks_for(percent: int, miss: float = 1e-6) -> int:
    """The fewest chunks for which a pair at the threshold is under the distance but for `miss`."""
    p = 1 - percent / 100
    for c in range(1, 64):
        k, radius = CHUNK * c, 2 * c - 1
        if sum(math.comb(k, e) * p**e * (1 - p) ** (k - e) for e in range(radius + 1, k + 1)) <= miss:
            return c
    return 64


def allowed(percent: int, count: int, miss: float = 1e-6) -> int:
    """Unequal entries among count hash functions that a pair at the threshold exceeds only with `miss`."""
    p, tail = 1 - percent / 100, 0.0
    for e in range(count, -1, -1):
        tail += math.comb(count, e) * p**e * (1 - p) ** (count - e)
        if tail > miss:
            return e
    return 0


def hash_functions(k: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mixed(np.arange(1, 2 * k + 1, dtype=np.uint64) * _MULTIPLIER)
    return seeds[:k] | np.uint64(1), seeds[k:]


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray, symbols: int) -> bytes:
    """The minima of the hash functions, in pieces that bound memory: 16-bit symbols of the first, 8 bits of the others."""
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        np.minimum(low, ((shingles[at : at + 2048, None] ^ b) * a).min(0), out=low)
    low = mixed(low)
    return (low[:symbols] & np.uint64(0xFFFF)).astype(np.uint16).tobytes() + (low[symbols:] & np.uint64(0xFF)).astype(np.uint8).tobytes()


def symbols_of(sigs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(16-bit symbols, 8-bit entries) of signatures, a row each."""
    both = np.frombuffer(b"".join(sigs), np.uint8).reshape(len(sigs), -1)
    symbols = both.shape[1] - FUNCTIONS
    return np.ascontiguousarray(both[:, : 2 * symbols]).view(np.uint16), both[:, 2 * symbols :]


def signatures(df: DataFrame, width: int, chunks: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, digest, sig) of every row."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = hash_functions(FUNCTIONS)
        cache = WordHashes()
        for batch in batches:
            n, digests, sigs = [], [], []
            for data in as_bytes(batch.column(1)):
                s = shingle_set(cache.of(lowered_words(data or b"")), width)
                n.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(signature(s, a, b, CHUNK * chunks) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], names=["id", "n", "digest", "sig"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, n bigint, digest binary, sig binary")


def keys(reps: DataFrame) -> DataFrame:
    """(key, id): a row for each chunk and masked symbol; the key holds the three others and its number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                if part.num_rows == 0:
                    continue
                sig = symbols_of(part.column(1).to_pylist())[0].astype(np.uint64)
                ids = np.asarray(part.column(0).to_numpy(zero_copy_only=False))
                out = all_keys(sig)
                yield pa.RecordBatch.from_arrays([pa.array(out.ravel().view(np.int64)), pa.array(np.repeat(ids, out.shape[1]))], names=["key", "id"])

    return reps.select("id", "sig").mapInArrow(run, "key bigint, id bigint")


def all_keys(sig: np.ndarray) -> np.ndarray:
    """rows x (chunk, masked symbol) of 64-bit keys."""
    cols = []
    for c in range(sig.shape[1] // CHUNK):
        for m in range(CHUNK):
            a, b, d = (sig[:, c * CHUNK + j] for j in range(CHUNK) if j != m)
            cols.append(a | (b << np.uint64(16)) | (d << np.uint64(32)) | (np.uint64(c * CHUNK + m) << np.uint64(48)))
    return np.stack(cols, 1)


def full_sets(ids: DataFrame, df: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(id, s): the whole sets of the documents named by ids(id), as sorted hashes; their texts are read again."""
    texts = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t")).join(ids, "id", "left_semi")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sets = [shingle_set(cache.of(lowered_words(x or b"")), width).tobytes() for x in as_bytes(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["id", "s"])

    return stored(texts.mapInArrow(make, "id bigint, s binary"), "sets", "none")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs(a, b) with `linked`, decided on the full sets(id, s)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    full = pairs.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b").join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
    return checkpointed(full.select("a", "b", "sa", "sb").mapInArrow(compare, "a bigint, b bigint, linked boolean").distinct())


def intersections(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each x with each y, as products of presence over slices of what both sides hold."""
    nx, ny = np.array([len(s) for s in xs]), np.array([len(s) for s in ys])
    code, which = np.unique(np.concatenate([*xs, *ys]), return_inverse=True)
    row = np.concatenate([np.repeat(np.arange(len(xs)), nx), np.repeat(np.arange(len(ys)), ny)])
    is_x = np.arange(len(which)) < nx.sum()
    shared = (np.bincount(which[is_x], minlength=len(code)) > 0) & (np.bincount(which[~is_x], minlength=len(code)) > 0)
    column = np.cumsum(shared) - 1
    keep = shared[which]
    row, column, is_x = row[keep], column[which[keep]], is_x[keep]
    order = np.argsort(column, kind="stable")
    row, column, is_x = row[order], column[order], is_x[order]
    out = np.zeros((len(xs), len(ys)), np.float32)
    for lo in range(0, int(shared.sum()), 2048):
        a, b = np.searchsorted(column, [lo, lo + 2048])
        r, c, x = row[a:b], column[a:b] - lo, is_x[a:b]
        left, right = np.zeros((len(xs), 2048), np.float32), np.zeros((len(ys), 2048), np.float32)
        left[r[x], c[x]] = 1
        right[r[~x], c[~x]] = 1
        out += left @ right.T
    return out.astype(np.int64)


def near(pairs: DataFrame, reps: DataFrame, percent: int, radius: int) -> DataFrame:
    """pairs(a, b) that sizes and signatures allow, with their distance over all hash functions."""
    most = allowed(percent, FUNCTIONS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                (x, x8), (y, y8) = (symbols_of(batch.column(i).to_pylist()) for i in (2, 3))
                d = (x != y).sum(1)
                fine, d = d <= radius, (d + (x8 != y8).sum(1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d)], names=["a", "b", "d"]).filter(pa.array(fine & (d <= most)))

    left = reps.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sig").alias("ga"))
    right = reps.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("gb"))
    both = pairs.join(left, "a").join(right, "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    return both.select("a", "b", "ga", "gb").mapInArrow(run, "a bigint, b bigint, d bigint")


def alone(ids: DataFrame, sets: DataFrame) -> DataFrame:
    """(id, u): how many of a document's shingles none of the other documents named by ids(id) has; only where that's not 0."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                held = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column(1)]
                owner = np.repeat(part.column(0).to_numpy(zero_copy_only=False), [len(s) for s in held])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held)), pa.array(owner, pa.int64())], names=["e", "id"])

    held = sets.join(ids, "id", "left_semi").mapInArrow(spread, "e bigint, id bigint").groupBy("e").agg(F.min("id").alias("id"), F.max("id").alias("other")).where("id = other")
    return checkpointed(held.groupBy("id").agg(F.count("*").alias("u")))


class Rows:
    """Rows of a key as arrays."""

    def __init__(self, ids, labels, sizes, alone, sigs):
        self.id, self.c, self.n, self.u = (np.asarray(x, np.int64) for x in (ids, labels, sizes, alone))
        self.symbols, self.more = symbols_of(list(sigs))
        self.keys = all_keys(self.symbols.astype(np.uint64))

    def may(self, r: int, other: Rows, percent: int) -> np.ndarray:
        """Which of the other rows are in another component than row r, and of a size that allows a link."""
        inner = np.minimum(self.n[r] - self.u[r], other.n - other.u)  # shingles that nobody else has are in no intersection
        return (other.c != self.c[r]) & (100 * inner >= percent * (self.n[r] + other.n - inner))

    def pairs(self, key: int, percent: int, radius: int, most: int) -> np.ndarray:
        """(a, b, d) of pairs in different components that may be links, and for which this is the first key shared."""
        this, out = np.array([key], np.int64).view(np.uint64)[0], [np.empty((0, 3), np.int64)]
        for r in range(len(self.id)):
            ok = self.may(r, self, percent)
            ok[: r + 1] = False
            ok = np.flatnonzero(ok)
            d = (self.symbols[ok] != self.symbols[r]).sum(1)
            ok, d = ok[d <= radius], d[d <= radius]
            d = d + (self.more[ok] != self.more[r]).sum(1)
            ok, d = ok[d <= most], d[d <= most]
            if len(ok):
                first = self.keys[r][(self.keys[ok] == self.keys[r]).argmax(1)] == this
                ok, d = ok[first], d[first]
                out.append(np.stack([np.minimum(self.id[ok], self.id[r]), np.maximum(self.id[ok], self.id[r]), d], 1))
        return np.concatenate(out)


def block_links(pdf, percent: int):
    """A forest of the links between a block of minor rows and a block of all rows, decided on the full sets."""
    x, y = pdf[pdf.minor], pdf[~pdf.minor]
    if x.empty or y.empty:
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    nx, ny = x.n.to_numpy(), y.n.to_numpy()
    both = intersections([np.frombuffer(s, np.uint64) for s in x.s], [np.frombuffer(s, np.uint64) for s in y.s])
    hit = (100 * both >= percent * (nx[:, None] + ny - both)) & (x.c.to_numpy()[:, None] != y.c.to_numpy())
    xi, yi = x.id.to_numpy(), y.id.to_numpy()
    found = forest((int(a), int(b)) for r in np.flatnonzero(hit.any(1)) for a, b in zip([xi[r]] * int(hit[r].sum()), yi[hit[r]], strict=True))
    return pd.DataFrame({"a": list(found), "b": list(found.values())}, dtype="int64")


def block_survivors(pdf, percent: int, radius: int, most: int):
    """Of a block of minor rows and a block of all rows, by sizes and signatures, those that may have a link in the other block, for which this is the first key shared."""
    this = np.array([pdf.key.iat[0]], np.int64).view(np.uint64)[0]
    x, y = pdf[pdf.minor], pdf[~pdf.minor]
    rows = [Rows(z.id, z.c, z.n, z.u, z.sig) for z in (x, y) if len(z)]
    if len(rows) < 2:
        return pdf[["key", "i", "j", "minor", "id"]].iloc[:0]
    a, b = rows
    hit_a, hit_b = np.zeros(len(a.id), bool), np.zeros(len(b.id), bool)
    for r in range(len(a.id)):
        ok = np.flatnonzero(a.may(r, b, percent))
        d = (b.symbols[ok] != a.symbols[r]).sum(1)
        ok, d = ok[d <= radius], d[d <= radius]
        ok = ok[d + (b.more[ok] != a.more[r]).sum(1) <= most]
        if len(ok):
            ok = ok[a.keys[r][(b.keys[ok] == a.keys[r]).argmax(1)] == this]
        hit_a[r], hit_b[ok] = len(ok) > 0, True
    return pd.concat([x[hit_a], y[hit_b]])[["key", "i", "j", "minor", "id"]]


def across(keyed: DataFrame, labels: DataFrame, reps: DataFrame, sets: DataFrame, percent: int, radius: int) -> tuple[DataFrame, DataFrame | None]:
    """Pairs (a, b, d) that meet in a small key, lie in different components and may be links; links(a, b) from large keys.

    keyed: (key, id, count) of keys with several rows. Only keys that span components are looked at.
    A document many of whose shingles are its own can't be linked, however many it resembles; what is
    left is compared by sizes and signatures in small keys. In large ones, rows outside the most frequent
    component, in blocks, meet the blocks of all rows. First their signatures meet, which are short, and name
    the rows that may have a link in a block; full sets follow for these alone, and a block returns a forest
    of its links. So a signature is sent once per block of the other side, a set only where it is needed.
    """
    most = allowed(percent, FUNCTIONS)
    named = keyed.join(labels.select(F.col("v").alias("id"), F.col("m").alias("c")), "id", "left").select("key", "id", F.coalesce("c", "id").alias("c"))
    named = checkpointed(named)

    def spanning(rows: DataFrame) -> DataFrame:
        span = rows.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.count("*").alias("count")).where("lo <> hi").select("key", "count")
        return rows.join(checkpointed(span), "key")

    open_rows = checkpointed(spanning(named))
    own = alone(open_rows.select("id").distinct(), sets)
    # rows that can't be linked go, and keys that no longer span components
    able = reps.join(own, "id", "left").withColumn("u", F.coalesce("u", F.lit(0))).where((F.col("n") - F.col("u")) * 100 >= F.col("n") * percent)
    able = checkpointed(able)
    rows = open_rows.drop("count").join(able.select("id"), "id", "left_semi").select("key", "id", "c")
    rows = checkpointed(spanning(checkpointed(rows)).join(able, "id").select("key", "id", "c", "n", "u", "sig", "count"))

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.empty((0, 3), np.int64)]
            for key, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                members = Rows(*(x.values.field(k).to_numpy(zero_copy_only=False) for k in range(5)))
                found.append(members.pairs(key, percent, radius, most))
            got = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(got[:, k])) for k in range(3)], names=["a", "b", "d"])

    few = rows.where(F.col("count") <= GROUP).groupBy("key").agg(F.collect_list(F.struct("id", "c", "n", "u", "sig")).alias("x"))
    found = few.mapInArrow(group, "a bigint, b bigint, d bigint").distinct()

    many = checkpointed(rows.where(F.col("count") > GROUP).drop("count"))
    if many.isEmpty():
        return found, None
    sizes = many.groupBy("key", "c").agg(F.count("*").alias("m"))
    main = sizes.groupBy("key").agg(F.max(F.struct("m", "c")).alias("x"), F.sum("m").alias("all")).select("key", F.col("x.c").alias("main"), F.ceil((F.col("all") - F.col("x.m")) / BLOCK).alias("mb"), F.ceil(F.col("all") / BLOCK).alias("ab"))
    marked = many.join(checkpointed(main), "key")
    salt, columns = F.xxhash64("id"), ["id", "c", "n", "u", "sig"]
    every = marked.select("key", F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("i"), F.pmod(salt, F.col("ab")).alias("j"), F.lit(False).alias("minor"), *columns)
    minor = marked.where("c <> main").select("key", F.pmod(salt, F.col("mb")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("ab") - 1)).alias("j"), F.lit(True).alias("minor"), *columns)
    met = every.union(minor).groupBy("key", "i", "j").applyInPandas(lambda pdf: block_survivors(pdf, percent, radius, most), "key bigint, i bigint, j bigint, minor boolean, id bigint")
    full = checkpointed(met).join(many.select("key", "id", "c", "n"), ["key", "id"]).join(sets, "id")
    links = full.groupBy("key", "i", "j").applyInPandas(lambda pdf: block_links(pdf, percent), "a bigint, b bigint")
    return found, checkpointed(links.distinct())


def classes(df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", miss: float = 1e-6) -> DataFrame:
    """One row per row of df: id, n_shingles, component_id (the smallest id linked, itself included), kept.

    Ids are integers. Two documents are linked if their sets' Jaccard similarity reaches percent / 100.
    """
    chunks = chunks_for(percent, miss)
    radius = 2 * chunks - 1
    made = stored(signatures(df, width, chunks, id_col, text_col).select(F.col("id").cast("bigint").alias("id"), "n", "digest", "sig"), "signatures")
    alike = made.where("n > 0 and id is not null").groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.count("*").alias("copies"))
    alike = stored(alike, "classes")
    reps = alike.select("id", "n", "sig")

    with scratch(df.sparkSession) as keep:
        every = keys(reps)
        lead = checkpointed(every.groupBy("key").agg(F.min("id").alias("lead"), F.count("*").alias("count")).where("count > 1"))
        keyed = stored(every.join(lead, "key"), "keyed")  # keys with one row end here
        votes = keyed.where("lead <> id").groupBy("lead", "id").agg(F.count("*").alias("n"))
        star = votes.groupBy("id").agg(F.max(F.struct("n", -F.col("lead"))).alias("x")).select((-F.col("x.col2")).alias("a"), F.col("id").alias("b"))
        # texts are read a second time, once, for the sets of all documents that meet another in a key
        sets = full_sets(keyed.select("id").distinct(), df, width, id_col, text_col)
        tried = verified(checkpointed(near(star, reps, percent, radius).select("a", "b")), sets, percent)
        links = tried.where("linked").select("a", "b")
        labels = components(links)
        narrow = keyed.select("key", "id")
        enough = max(20_000, reps.count() // 4)
        for rounds in range(3):
            pairs, more = across(narrow, labels, reps, sets, percent, radius)
            pairs = checkpointed(pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti"))
            total = pairs.count()
            last = rounds == 2 or total <= enough
            if not last:  # hold each document against its nearest first; most pairs then fall within components
                best = pairs.select(F.col("a").alias("x"), "a", "b", "d").union(pairs.select(F.col("b").alias("x"), "a", "b", "d"))
                pairs = best.groupBy("x").agg(F.min(F.struct("d", "a", "b")).alias("y")).select("y.a", "y.b").distinct()
            known = labels.select(F.col("v").alias("a"), F.col("m").alias("b"))
            if total:
                new = verified(checkpointed(pairs.select("a", "b")), sets, percent)
                tried = checkpointed(tried.union(new))
                known = known.union(new.where("linked").select("a", "b"))
            labels = components(known.union(more) if more is not None else known)
            if last:
                break
        keep(labels)
    rep = alike.where("copies > 1").select("digest", F.col("id").alias("rep"))
    known = made.select("id", "n", "digest").join(rep, "digest", "left").select("id", "n", F.coalesce("rep", "id").alias("rep"))
    named = known.join(labels.select(F.col("v").alias("rep"), "m"), "rep", "left").select("id", "n", F.coalesce("m", "rep").alias("m"))
    return named.select(F.col("id").cast(df.schema[id_col].dataType).alias(id_col), F.col("n").alias("n_shingles"), F.col("m").alias("component_id"), (F.col("id") == F.col("m")).alias("kept"))


