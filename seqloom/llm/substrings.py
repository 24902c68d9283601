"""Substring dedup with prefix-partitioned suffix trees over words.

A suffix is a document from some word on; what matters of it are its first `window` words. Repeats are
found in two passes over the chunks of the corpus (see corpus), both by request and reply:

1. A sieve. Each suffix has a code of 64 bits: 40 for the whole window, by which suffixes spread evenly over
   groups, and 8 each for the first word, the first four and the first eight, all from hashes of those words.
   A suffix whose code no other chunk has can repeat within its chunk alone, where words are compared; it goes
   no further.
2. Suffix trees. The suffixes that are left are dealt by prefixes of variable length: put first, the bits of
   prefixes order codes so that equal beginnings lie together, and a histogram over short prefixes shows which
   of them fit into memory together and which must be split by longer ones.
   Every group builds its subtree from words: suffixes are sorted word by word, the lengths of common
   prefixes of neighbours give the tree's internal nodes, and those as deep as the window are repeats.
   The leaf with the smallest document decides; the windows of all others are repeats, and runs of
   overlapping ones are maximal repeats. Codes decide nothing here, so equal codes of different words
   (as will happen among very many windows) remove nothing.

A chunk of documents sends each distinct window once, with its smallest document: for the chunk's other
documents it is a repeat already. So a passage that a third of all documents share reaches its group once
per chunk. Replies are one bit per window sent.

Null texts have no words. Documents with a null id never count as smaller. Rows that repeat an id
don't make each other's words repeats. An empty table gives an empty result, as do texts that are all
shorter than a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import checkpointed, released, scratch
from seqloom.llm.corpus import CHUNK_TOKENS, GROUP_KEYS, NO_ID, Chunk, chunked, pack, pack_sorted, rows, stretches, unpack, unpack_sorted
from seqloom.llm.neardup import mixed

#: Bits of the prefixes that are counted, and of what follows them, by which large ones are split.
COUNTED, SPLIT = 12, 24
#: Suffixes of a tree, as each brings its words: fewer than the bare codes of a sieve.
TREE_KEYS = GROUP_KEYS // 2
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def paths(chunk: Chunk, window: int, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(code, word position) of every suffix with at least a window of words in its document."""
    w = chunk.hashes()[chunk.tokens] if len(chunk.tokens) else np.empty(0, np.uint64)
    n = len(w) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    room = np.repeat(chunk.starts + chunk.lens, chunk.lens)[:n] - np.arange(n)
    h, out = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    levels = {1: 16, max(1, window // 3): 8, max(1, 2 * window // 3): 0}
    for j in range(window):
        h = (h ^ w[j : j + n]) * _MULTIPLIER
        h ^= h >> np.uint64(29)
        if j + 1 in levels:
            out |= (mixed(h) >> np.uint64(56)) << np.uint64(levels[j + 1])
    out |= mixed(h) & np.uint64(0xFFFFFFFFFF000000)
    at = np.flatnonzero(room >= window)
    return (out[at] >> np.uint64(64 - bits)) << np.uint64(64 - bits), at


def prefixed(code: np.ndarray) -> np.ndarray:
    """Codes with the bits of prefixes first."""
    return code << np.uint64(40) | code >> np.uint64(24)


class Prefixes:
    """Groups of suffixes by prefixes of variable length, in the order of prefixes."""

    def __init__(self, counts: np.ndarray, limit: int):
        self.pieces = np.maximum(1, -(-counts // limit))
        base, held, group = np.zeros(len(counts), np.int64), 0, 0
        for p, (count, pieces) in enumerate(zip(counts.tolist(), self.pieces.tolist(), strict=True)):
            if held and (pieces > 1 or held + count > limit):
                group, held = group + 1, 0
            base[p] = group
            if pieces > 1:
                group += pieces
            else:
                held += count
        self.base, self.count = base, group + 1

    def of(self, path: np.ndarray) -> np.ndarray:
        prefix = (path >> np.uint64(64 - COUNTED)).astype(np.int64)
        below = ((path >> np.uint64(64 - COUNTED - SPLIT)) & np.uint64((1 << SPLIT) - 1)).astype(np.int64)
        return self.base[prefix] + (below * self.pieces[prefix] >> SPLIT)


class Windows:
    """A chunk's distinct windows in the order of codes: code (`path`), smallest and largest document, positions and where each one's begin."""

    def __init__(self, chunk: Chunk, window: int, bits: int):
        path, at = paths(chunk, window, bits)
        order = np.argsort(path, kind="stable")
        path, at = path[order], at[order]
        self.chunk, self.window = chunk, window
        new = np.ones(len(path), bool)
        if len(path):
            new[1:] = path[1:] != path[:-1]
            twin = np.flatnonzero(~new)
            unlike = np.zeros(len(twin), bool)
            for j in range(window):
                unlike |= chunk.tokens[at[twin] + j] != chunk.tokens[at[twin - 1] + j]
            if unlike.any():  # equal codes, other words: such a run is put in the order of its words
                run = np.cumsum(new) - 1
                for r in np.unique(run[twin[unlike]]):
                    lo, hi = np.searchsorted(run, [r, r + 1])
                    _, kind = np.unique(self._words(at[lo:hi]), axis=0, return_inverse=True)
                    kind = kind.reshape(-1)
                    turn = np.argsort(kind, kind="stable")
                    at[lo:hi] = at[lo:hi][turn]
                    new[lo + 1 : hi] = np.diff(kind[turn]) != 0
        self.first = np.flatnonzero(new)
        self.at, self.path = at, path[self.first]
        doc = np.repeat(chunk.ids, chunk.lens)[at]
        self.least = np.minimum.reduceat(doc, self.first) if len(doc) else doc
        self.most = np.maximum.reduceat(doc, self.first) if len(doc) else doc

    def _words(self, at: np.ndarray) -> np.ndarray:
        out = np.empty((len(at), self.window), np.uint32)
        for j in range(self.window):
            out[:, j] = self.chunk.tokens[at + j]
        return out

    def words(self, which: np.ndarray) -> np.ndarray:
        """windows x words: the chunk's word numbers of some distinct windows."""
        return self._words(self.at[self.first[which]])


def common_prefixes(words: np.ndarray) -> np.ndarray:
    """For each sorted suffix, how many words it shares with the one before; 0 for the first."""
    out = np.zeros(len(words), np.int64)
    alike = np.ones(max(0, len(words) - 1), bool)
    for j in range(words.shape[1]):
        alike &= words[1:, j] == words[:-1, j]
        out[1:] += alike
    return out


class SuffixTree:
    """The suffix tree of a group's windows, as an array of nodes.

    words: suffixes x window, a number for each word; doc: each suffix's document. Leaves are the sorted
    suffixes. An internal node is a largest run of leaves whose neighbours share at least `depth` words, and
    some no more; a node holds all nodes within its run.
    """

    def __init__(self, words: np.ndarray, doc: np.ndarray):
        self.words, self.doc = words, doc
        self.leaves = np.lexsort(self._packed())
        self.lcp = common_prefixes(words[self.leaves])

    def _packed(self) -> list[np.ndarray]:
        """Sort keys, the last one first: as many word numbers as fit into 63 bits each."""
        size = max(1, int(self.words.max(initial=0)).bit_length())
        per = max(1, 63 // size)
        keys = []
        for lo in range(0, self.words.shape[1], per):
            key = np.zeros(len(self.words), np.int64)
            for j in range(lo, min(self.words.shape[1], lo + per)):
                key = key << size | self.words[:, j].astype(np.int64)
            keys.append(key)
        return keys[::-1]

    def nodes(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(depth, first leaf, last leaf) of the internal nodes of at least a depth, level by level."""
        out = [np.empty((0, 3), np.int64)]
        for d in range(depth, self.words.shape[1] + 1):
            inside = np.concatenate((self.lcp >= d, [False])).astype(np.int8)
            edges = np.flatnonzero(np.diff(inside)).reshape(-1, 2)  # neighbours of a run share d words; the first pair starts a leaf earlier
            if len(edges):
                least = np.minimum.reduceat(np.append(self.lcp, 0), (edges + 1).ravel())[::2]
                out.append(np.column_stack((least, edges))[least == d])
        return tuple(np.concatenate(out).T)

    def repeats(self, window: int) -> np.ndarray:
        """For each suffix, in the order given, whether a node as deep as a window holds a smaller document."""
        out = np.zeros(len(self.doc), bool)
        _, first, last = self.nodes(window)
        if len(first):
            doc = self.doc[self.leaves]
            least = np.minimum.reduceat(np.append(doc, 0), np.stack([first, last + 1], 1).ravel())[::2]
            inside = np.repeat(first - np.concatenate(([0], np.cumsum(last - first + 1)[:-1])), last - first + 1) + np.arange((last - first + 1).sum())
            out[self.leaves[inside]] = doc[inside] > np.repeat(least, last - first + 1)
        return out


def settle_codes(pdf: pd.DataFrame) -> pd.DataFrame:
    """The replies of one group of the sieve: for each chunk, a bit per code sent, whether another chunk with another document has it; then how many such suffixes short prefixes have."""
    found = [unpack_sorted(path, np.uint64) for path in pdf.path]
    docs = [unpack_sorted(ids, np.int64)[unpack(which, np.uint32)] for ids, which in zip(pdf.ids, pdf.which, strict=True)]
    path, doc = np.concatenate(found), np.concatenate(docs)
    order = np.argsort(path, kind="stable")
    first = np.flatnonzero(np.diff(path[order], prepend=~path[order[:1]]) != 0)
    several = np.minimum.reduceat(doc[order], first) < np.maximum.reduceat(doc[order], first)
    shared = np.empty(len(path), bool)
    shared[order] = np.repeat(several, np.diff(np.append(first, len(path))))
    prefix, n = np.unique((prefixed(path[shared]) >> np.uint64(64 - COUNTED)).astype(np.int64), return_counts=True)
    counts = pd.DataFrame({"chunk": [None], "group": [pdf.group.iat[0]], "bits": [None], "prefix": [prefix], "n": [n]})
    return pd.concat([_replies(pdf, shared, [len(x) for x in found]).assign(prefix=None, n=None), counts]).astype({"chunk": "Int64"})


def settle_words(pdf: pd.DataFrame, window: int) -> pd.DataFrame:
    """The replies of one subtree: for each chunk, a bit per suffix sent, whether a smaller document has its window."""
    numbers: dict[bytes, int] = {}
    local, docs = [], []
    for vocab, words, ids, which in zip(pdf.vocab, pdf.words, pdf.ids, pdf.which, strict=True):
        names = zstandard.ZstdDecompressor().decompress(vocab).split(b" ")
        own = np.fromiter((numbers.setdefault(w, len(numbers)) for w in names), np.uint32, len(names))
        local.append(own[unpack(words, np.uint32)].reshape(-1, window))
        docs.append(unpack_sorted(ids, np.int64)[unpack(which, np.uint32)])
    tree = SuffixTree(np.concatenate(local), np.concatenate(docs))  # in the order in which words came, which serves as well as any
    return _replies(pdf, tree.repeats(window), [len(x) for x in local])


def _replies(pdf: pd.DataFrame, bits: np.ndarray, sizes: list[int]) -> pd.DataFrame:
    packed = [np.packbits(x).tobytes() for x in np.split(bits, np.cumsum(sizes)[:-1])]
    return pd.DataFrame({"chunk": pdf.chunk, "group": pdf.group, "bits": packed})


def answered(group: np.ndarray, replies: dict[int, bytes]) -> np.ndarray:
    """The bits of replies by group, put where the group's number stands."""
    out = np.zeros(len(group), bool)
    order = np.argsort(group, kind="stable")
    for g, lo, hi in stretches(group[order]):
        out[order[lo:hi]] = np.unpackbits(np.frombuffer(replies[g], np.uint8), count=hi - lo)
    return out


def deduplicated(df: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", tokens: int = CHUNK_TOKENS, limit: int = GROUP_KEYS, tree_limit: int = TREE_KEYS, bits: int = 64) -> DataFrame:
    """One row per row of df: id, n_words, repeats array<struct<start,end>> of word positions, kept text.

    A word is removed if a window that holds it also starts in a document with a smaller id; kept words
    are joined by one space. tokens, limit and tree_limit bound chunks, groups of the sieve and trees; bits is
    how many bits of path codes the sieve looks at. None of them changes the result.
    """
    spark = df.sparkSession
    columns = ["ids", "lens", "vocab", "tokens"]
    parts = "group bigint, chunk bigint"

    def groups_of(counts: DataFrame, most: int) -> Prefixes:
        # one number for each of 2^COUNTED prefixes comes to the driver, whatever the corpus
        total = np.zeros(1 << COUNTED, np.int64)
        for prefix, n in counts.groupBy("prefix").agg(F.sum("n").alias("n")).collect():
            total[prefix] = n
        return Prefixes(total, most)

    def message(group: int, chunk: int, *packed: bytes) -> list[pa.Array]:
        return [pa.array([group], pa.int64()), pa.array([chunk], pa.int64()), *(pa.array([c], pa.binary()) for c in packed)]

    with scratch(spark) as keep:
        store = keep(chunked(df, id_col, text_col, False, tokens))
        total = store.agg(F.sum("size").alias("n")).first().n or 0
        width = np.uint64(max(1, -(-total // limit)))

        def sieve(code: np.ndarray) -> np.ndarray:
            return ((code >> np.uint64(32)) * width >> np.uint64(32)).astype(np.int64)

        def send_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for chunk, *row in rows(batches):
                w = Windows(Chunk(*row), window, bits)
                for g, lo, hi in stretches(sieve(w.path)):
                    ids, which = np.unique(w.least[lo:hi], return_inverse=True)
                    yield pa.RecordBatch.from_arrays(message(g, chunk, pack_sorted(w.path[lo:hi]), pack_sorted(ids), pack(which.astype(np.uint32))), names=["group", "chunk", "path", "ids", "which"])

        sent = store.select("chunk", *columns).mapInArrow(send_codes, f"{parts}, path binary, ids binary, which binary")
        first = checkpointed(sent.groupBy("group").applyInPandas(settle_codes, "chunk bigint, group bigint, bits binary, prefix array<bigint>, n array<bigint>"))
        trees = groups_of(first.where("chunk is null").select(F.explode(F.arrays_zip("prefix", "n")).alias("x")).select("x.prefix", "x.n"), tree_limit)
        first = first.where("chunk is not null").select("chunk", "group", "bits")
        del sent
        released(spark)  # the codes' shuffle, before that of the words is written

        def send_words(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            """The windows of a chunk that others may have, with their words."""
            chunk = Chunk(*left.loc[0, columns])
            w = Windows(chunk, window, bits)
            some = np.flatnonzero(answered(sieve(w.path), dict(zip(right.group, right.bits, strict=True))))
            out = []
            group = trees.of(prefixed(w.path[some]))
            order = np.argsort(group, kind="stable")
            for g, lo, hi in stretches(group[order]):
                mine = some[order[lo:hi]]
                words = w.words(mine)
                used = np.zeros(len(chunk.words), bool)
                used[words] = True
                number = np.cumsum(used, dtype=np.uint32) - np.uint32(1)
                vocab = zstandard.ZstdCompressor(level=1).compress(b" ".join([chunk.words[u] for u in np.flatnonzero(used).tolist()]))
                ids, of = np.unique(w.least[mine], return_inverse=True)
                out.append((g, left.chunk.iat[0], vocab, pack(number[words].ravel()), pack_sorted(ids), pack(of.astype(np.uint32))))
            return pd.DataFrame(out, columns=["group", "chunk", "vocab", "words", "ids", "which"])

        sent = store.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInPandas(send_words, "group bigint, chunk bigint, vocab binary, words binary, ids binary, which binary")
        second = checkpointed(sent.groupBy("group").applyInPandas(lambda pdf: settle_words(pdf, window), "chunk bigint, group bigint, bits binary"))
        told = keep(checkpointed(first.withColumn("tree", F.lit(False)).union(second.withColumn("tree", F.lit(True)))))

    def finish(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        chunk = Chunk(*left.loc[0, columns])
        w = Windows(chunk, window, bits)
        sieved, settled = (dict(zip(x.group, x.bits, strict=True)) for x in (right[~right.tree.astype(bool)], right[right.tree.astype(bool)]))
        some = np.flatnonzero(answered(sieve(w.path), sieved))
        repeat = np.zeros(len(w.path), bool)
        repeat[some] = answered(trees.of(prefixed(w.path[some])), settled)
        sizes = np.diff(np.append(w.first, len(w.at)))
        doc = np.repeat(chunk.ids, chunk.lens)
        starts = np.zeros(len(chunk.tokens) + 1, np.int64)
        starts[w.at[np.repeat(repeat, sizes) | (doc[w.at] > np.repeat(w.least, sizes))]] = 1
        run = np.cumsum(starts[:-1])
        covered = run - np.concatenate((np.zeros(min(window, len(run)), np.int64), run[:-window])) > 0
        out = {"id": [], "n_words": [], "repeats": [], "kept": []}
        words = np.array([w.decode("utf-8", "replace") for w in chunk.words] or [""], object)
        for doc_id, start, n in zip(chunk.ids.tolist(), chunk.starts.tolist(), chunk.lens.tolist(), strict=True):
            gone = covered[start : start + n]
            edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
            out["id"].append(None if doc_id == NO_ID else doc_id)
            out["n_words"].append(n)
            out["repeats"].append([{"start": a, "end": b} for a, b in edges.reshape(-1, 2).tolist()])
            tokens = chunk.tokens[start : start + n]
            out["kept"].append(" ".join(words[tokens[~gone] if len(edges) else tokens].tolist()))
        return pd.DataFrame(out).astype({"id": "Int64"})

    done = store.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(finish, "id bigint, n_words bigint, repeats array<struct<start:bigint,end:bigint>>, kept string")
    return done.withColumn("id", F.col("id").cast(df.schema[id_col].dataType)).withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns from the operator's rows."""
    removed = F.aggregate("repeats", F.lit(0).cast("bigint"), lambda a, r: a + r["end"] - r["start"])
    return found.select(id_col, "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
