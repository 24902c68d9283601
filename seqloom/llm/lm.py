"""Language-model scoring with a weighted backoff automaton of order three.

Tokens are words with A-Z lower-cased, then one end per document; a start stands before the first. The
model is Witten-Bell smoothed, trigrams over bigrams over additively smoothed words, as an automaton:

* a state for each history seen in training: a pair of symbols, one symbol, or none (the root);
* from a history h, an arc for each word w seen after it, weighing
  log10((c(h w) + T(h) P(w | h')) / (C(h) + T(h))), with C(h) the tokens seen after h, T(h) the distinct
  ones and h' the history without its first symbol; the arc leads to the longest history that is a
  state: h's last symbol with w, or w, or none;
* from each history a failure arc to h', weighing log10(T(h) / (C(h) + T(h)));
* from the root an arc for every word, weighing log10 P(w), P(w) = (c(w) + a) / (N + a (V + 1)).

A text is read once, left to right, with a state: the arc of the next word is taken where there is one, or
the failure arc and then what the state that it leads to has. Texts are read side by side, long ones in
pieces: as a state depends on the last two symbols alone, a piece reads these two first, unweighed.

Counts cover all training documents. They are found by request and reply (see corpus). Chunks send their
distinct bigrams with training counts; groups of histories, cut further by words where one history is
large, sum them. Trigrams follow, but only those that other chunks may have: where no other chunk sent a
bigram, what begins with it or ends in it is counted where it is. Distinct words after a bigram go along
as numbers then. No part of the model is broadcast but N and V.

A null text counts as an empty one and has the end as its only token. Repeated rows count as often as
they occur. A null id is hashed as an empty string. An empty table gives an empty result; without
training documents every score is that of unseen words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.common import scratch, stored
from seqloom.llm.corpus import GROUP_KEYS, NO_ID, Chunk, chunked, pack, pack_sorted, rows, stretches, unpack, unpack_sorted
from seqloom.llm.neardup import mixed

#: Tokens of a chunk; bits of history hashes that are counted to form groups, and bits that split a group.
CHUNK_TOKENS, COUNTED, SPLIT = 1_250_000, 12, 16
#: Tokens of a piece of a text that is read side by side with others.
PIECE = 256
ADD = 0.1
# Hashes of the two symbols that are no words.
END, START = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b" end", b" start"))
CODE = np.uint64((1 << 64) - (1 << 16))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def held_out(ids: np.ndarray, every: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(b"" if i == NO_ID else b"%d" % i) % every == 0 for i in ids.tolist()), bool, len(ids))


class Reading:
    """A chunk's symbols, start to end of each text, and its distinct bigrams and trigrams with training counts."""

    def __init__(self, chunk: Chunk, every: int):
        self.ids, self.held = chunk.ids, held_out(chunk.ids, every)
        self.hash = np.concatenate([chunk.hashes(), [END, START]]).astype(np.uint64)
        self.end, self.start = len(self.hash) - 2, len(self.hash) - 1
        self.lens = chunk.lens + 1  # tokens: words and the end
        self.first = np.cumsum(self.lens + 1) - self.lens - 1  # where the start of each text stands
        total = int((self.lens + 1).sum())
        self.symbol = np.full(total, self.end, np.int64)
        words = np.ones(total, bool)
        words[self.first] = words[self.first + self.lens] = False
        self.symbol[words] = chunk.tokens
        self.symbol[self.first] = self.start
        self.train = np.repeat(~self.held, self.lens + 1)
        token = np.ones(total, bool)
        token[self.first] = False
        self.tokens = np.flatnonzero(token)

    def words(self) -> None:
        """count: training tokens of each symbol; order, place: symbols by hash, and back."""
        self.count = np.bincount(self.symbol[self.tokens], self.train[self.tokens], minlength=len(self.hash)).astype(np.int64)
        self.order = np.argsort(self.hash)
        self.place = np.empty_like(self.order)
        self.place[self.order] = np.arange(len(self.order))

    def pair_hash(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        return mixed(mixed(self.hash[u]) + self.hash[v] * _MULTIPLIER)

    def code(self, symbol: np.ndarray) -> np.ndarray:
        """A 64-bit code of a word within its history; only the 48 upper bits are sent."""
        return mixed(self.hash[symbol]) & CODE

    def bigrams(self) -> None:
        """pair_u, pair_v, pair_count: distinct bigrams in the order of their first, then second symbol's hash; pair: each token's."""
        self.words()
        s, size = self.place, len(self.hash)
        key = s[self.symbol[self.tokens - 1]] * size + s[self.symbol[self.tokens]]
        kinds, which = np.unique(key, return_inverse=True)
        self.pair_u, self.pair_v = self.order[kinds // size], self.order[kinds % size]
        self.pair_count = np.bincount(which, self.train[self.tokens], minlength=len(kinds)).astype(np.int64)
        self.pair = np.full(len(self.symbol), -1, np.int64)
        self.pair[self.tokens] = which

    def trigrams(self) -> None:
        """three_h, three_t, three_count: distinct trigrams as the bigrams that they begin with and end in, by the hash of the former, then that of the last symbol."""
        self.pair_key = self.pair_hash(self.pair_u, self.pair_v)
        by = np.argsort(self.pair_key)
        place = np.empty_like(by)
        place[by] = np.arange(len(by))
        at = self.tokens[self.pair[self.tokens - 1] >= 0]
        key = place[self.pair[at - 1]] * len(self.hash) + self.place[self.symbol[at]]
        kinds, which = np.unique(key, return_inverse=True)
        self.three_h, self.three_t = by[kinds // len(self.hash)], np.empty(len(kinds), np.int64)
        self.three_t[which] = self.pair[at]
        self.three_count = np.bincount(which, self.train[at], minlength=len(kinds)).astype(np.int64)

    def elsewhere(self, shared: np.ndarray) -> np.ndarray:
        """Which trigrams other chunks may have, from which bigrams they do."""
        return shared[self.three_h] & shared[self.three_t]


class Groups:
    """Groups of n-grams by ranges of history hashes; a large range is cut by further bits of them, one that a large history must be in by codes of words."""

    def __init__(self, counts: np.ndarray, limit: int):
        self.hot = counts > max(limit, 4 * float(np.median(counts)))
        self.pieces = np.maximum(1, -(-counts // limit))
        base, held, group = np.zeros(len(counts), np.int64), 0, 0
        for p, (count, pieces) in enumerate(zip(counts.tolist(), self.pieces.tolist(), strict=True)):
            if held and (pieces > 1 or held + count > limit):
                group, held = group + 1, 0
            base[p] = group
            group, held = (group + pieces, 0) if pieces > 1 else (group, held + count)
        self.base = base

    def split(self, history: np.ndarray) -> np.ndarray:
        """Whether the words after a history may lie in several groups."""
        return self.hot[(history >> np.uint64(64 - COUNTED)).astype(np.int64)]

    def of(self, history: np.ndarray, code: np.ndarray) -> np.ndarray:
        p = (history >> np.uint64(64 - COUNTED)).astype(np.int64)
        inner = np.where(self.hot[p], code >> np.uint64(64 - SPLIT), (history << np.uint64(COUNTED)) >> np.uint64(64 - SPLIT))
        return self.base[p] + (inner.astype(np.int64) * self.pieces[p] >> SPLIT)


class BackoffAutomaton:
    """The part of the automaton that a chunk's texts can visit.

    States are numbers: 0 the root, 1 + s the history of symbol s, 1 + symbols + p that of bigram p. Arcs lie in
    a table of their (state, symbol) by hash; fail and fail_weight have a state each, root a weight and root_next
    a state for each symbol.
    """

    def __init__(self, symbols: int, state: np.ndarray, symbol: np.ndarray, weight: np.ndarray, following: np.ndarray, fail: np.ndarray, fail_weight: np.ndarray, root: np.ndarray, root_next: np.ndarray):
        self.symbols = np.uint64(symbols)
        key = self._key(state, symbol)
        order = np.argsort(key)
        self.key, self.weight, self.following = key[order], weight[order], following[order]
        self.shift = np.uint64(64 - max(1, len(key).bit_length()))
        cells = np.bincount((self.key >> self.shift).astype(np.int64), minlength=1 << int(64 - self.shift))
        self.begin = np.concatenate([[0], np.cumsum(cells)])
        self.fail, self.fail_weight, self.root, self.root_next = fail, fail_weight, root, root_next

    def _key(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        return mixed(state.astype(np.uint64) * self.symbols + symbol.astype(np.uint64))

    def arcs(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The arc of each state and symbol, -1 without one."""
        key = self._key(state, symbol)
        cell = (key >> self.shift).astype(np.int64)
        at, stop = self.begin[cell], self.begin[cell + 1]
        out = np.full(len(key), -1, np.int64)
        open_ = np.flatnonzero(at < stop)
        while len(open_):
            hit = self.key[at[open_]] == key[open_]
            out[open_[hit]] = at[open_[hit]]
            open_ = open_[~hit]
            at[open_] += 1
            open_ = open_[at[open_] < stop[open_]]
        return out

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weights, states) after reading a symbol in each state."""
        weight, out, state = np.zeros(len(state)), np.empty(len(state), np.int64), state.copy()
        open_ = np.arange(len(state))
        while len(open_):
            rooted = state[open_] == 0
            done = open_[rooted]
            weight[done] += self.root[symbol[done]]
            out[done] = self.root_next[symbol[done]]
            open_ = open_[~rooted]
            arc = self.arcs(state[open_], symbol[open_])
            done, arc_of = open_[arc >= 0], arc[arc >= 0]
            weight[done] += self.weight[arc_of]
            out[done] = self.following[arc_of]
            open_ = open_[arc < 0]
            weight[open_] += self.fail_weight[state[open_]]
            state[open_] = self.fail[state[open_]]
        return weight, out

    def traverse(self, reading: Reading, piece: int = PIECE) -> np.ndarray:
        """Summed weights of each text, read from its start with a state that is carried on."""
        pieces = -(-reading.lens // piece)
        text = np.repeat(np.arange(len(reading.lens)), pieces)
        number = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = reading.first[text] + 1 + number * piece
        left = np.minimum(piece, reading.lens[text] - number * piece)
        state = np.full(len(text), self.root_next[reading.start], np.int64)
        later = np.flatnonzero(number > 0)
        state[later] = 0
        for back in (2, 1):
            state[later] = self.step(state[later], reading.symbol[begin[later] - back])[1]
        order = np.argsort(-left, kind="stable")  # long pieces first: those that go on are a prefix
        begin, left, state, sums = begin[order], left[order], state[order], np.zeros(len(order))
        for i in range(int(left.max(initial=0))):
            k = int(np.searchsorted(-left, -i, side="left"))
            weight, state[:k] = self.step(state[:k], reading.symbol[begin[:k] + i])
            sums[:k] += weight
        return np.bincount(text[order], sums, minlength=len(reading.lens))


def settle_grams(pdf: pd.DataFrame, told: bool, passed) -> pd.DataFrame:
    """Total counts of one group's n-grams.

    Rows: history, sizes (arcs of each), code, count, and `only`, distinct words that are counted in the chunk.
    For each chunk: twice the totals, and one more where several chunks sent the n-gram, and, if told, T of each
    history; then a row of heads, the T of the histories that passed(histories) chooses.
    """
    heads_of, owners, codes, counts, onlys = [], [], [], [], []
    for history, sizes, code, count, only in zip(pdf.history, pdf.sizes, pdf.code, pdf["count"], pdf.only, strict=True):
        heads_of.append(unpack_sorted(history, np.uint64))
        owners.append(np.repeat(heads_of[-1], unpack(sizes, np.uint32)))
        codes.append(unpack(code, np.uint64))
        counts.append(unpack(count, np.uint32))
        onlys.append(unpack(only, np.uint32) if only is not None else np.zeros(len(heads_of[-1]), np.uint32))
    owner, code, count = np.concatenate(owners), np.concatenate(codes), np.concatenate(counts).astype(np.int64)
    order = np.lexsort((code, owner))
    so, sc = owner[order], code[order]
    new = np.ones(len(so), bool)
    new[1:] = (so[1:] != so[:-1]) | (sc[1:] != sc[:-1])
    first = np.flatnonzero(new)
    total = np.add.reduceat(count[order], first) if len(first) else count
    every, several = np.empty_like(count), np.diff(np.append(first, len(so))) > 1
    every[order] = np.repeat(2 * total + several, np.diff(np.append(first, len(so))))
    heads, which = np.unique(np.concatenate(heads_of), return_inverse=True)
    kinds = np.bincount(which, np.concatenate(onlys), minlength=len(heads)).astype(np.int64)
    kinds += np.bincount(np.searchsorted(heads, so[first][total > 0]), minlength=len(heads))
    replies = [pack(x) for x in np.split(every, np.cumsum([len(x) for x in codes])[:-1])]
    known = [pack(x) if told else None for x in np.split(kinds[which], np.cumsum([len(x) for x in heads_of])[:-1])]
    out = pd.DataFrame({"chunk": pdf.chunk, "part": pdf.group, "x": replies, "y": known})
    some = (kinds > 0) & passed(heads)
    more = pd.DataFrame({"chunk": [None], "part": [pdf.group.iat[0]], "x": [pack_sorted(heads[some])], "y": [pack(kinds[some])]})
    return pd.concat([out, more]).astype({"chunk": "Int64"})


def settle_sums(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Replies of one bucket of keys: the total of the numbers sent for each key, and T of it from the heads. A row without chunk has N and V."""
    keys = [unpack_sorted(x, np.uint64) for x in left["keys"]]
    counts = [unpack(x, np.uint32).astype(np.int64) for x in left["count"]]
    if not keys:
        return pd.DataFrame({"chunk": [], "part": [], "x": [], "y": [], "n": [], "v": []}).astype({"chunk": "Int64", "part": "int64", "n": "int64", "v": "int64"})
    key, which = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(which, np.concatenate(counts), minlength=len(key)).astype(np.int64)
    kind = np.zeros(len(key), np.int64)
    for heads, kinds in zip(right.heads, right.kinds, strict=True):
        h, k = unpack_sorted(heads, np.uint64), unpack(kinds, np.int64)
        at = np.minimum(np.searchsorted(key, h), len(key) - 1)
        asked = key[at] == h
        np.add.at(kind, at[asked], k[asked])
    split = np.split(which, np.cumsum([len(x) for x in keys])[:-1])
    real = key != START
    out = pd.DataFrame({"chunk": left.chunk, "part": left.bucket, "x": [pack(total[x]) for x in split], "y": [pack(kind[x]) for x in split], "n": 0, "v": 0})
    more = pd.DataFrame({"chunk": [None], "part": [left.bucket.iat[0]], "x": [None], "y": [None], "n": [int(total[real].sum())], "v": [int((total[real] > 0).sum())]})
    return pd.concat([out, more]).astype({"chunk": "Int64"})


def laid_out(groups: np.ndarray, parts: pd.DataFrame, column: str) -> np.ndarray:
    """The numbers of replies by group, put where the group numbers stand."""
    out = np.zeros(len(groups), np.int64)
    order = np.argsort(groups, kind="stable")
    replies = dict(zip(parts.part, parts[column], strict=True))
    for g, lo, hi in stretches(groups[order]):
        out[order[lo:hi]] = unpack(replies[g], np.int64)
    return out


GRAMS = "group bigint, chunk bigint, history binary, sizes binary, code binary, count binary, only binary"
ASKS = "bucket bigint, chunk bigint, keys binary, count binary"
SUMS = "chunk bigint, part bigint, x binary, y binary, n bigint, v bigint"


def gram_rows(chunk: int, group: np.ndarray, history: np.ndarray, code: np.ndarray, count: np.ndarray, heads: np.ndarray | None = None, head_group: np.ndarray | None = None, only: np.ndarray | None = None) -> list[tuple]:
    """The messages of a chunk's n-grams, sorted by history, to their groups; heads: histories that a message has besides, with what `only` counts."""
    out = []
    order = np.argsort(group, kind="stable")
    parts = {g: order[lo:hi] for g, lo, hi in stretches(group[order])}
    besides: dict[int, np.ndarray] = {}
    if heads is not None:
        by = np.argsort(head_group, kind="stable")
        besides = {g: by[lo:hi] for g, lo, hi in stretches(head_group[by])}
    none = np.empty(0, np.int64)
    for g in parts.keys() | besides.keys():
        part, extra = parts.get(g, none), besides.get(g, none)
        head, inverse = np.unique(np.concatenate([history[part], heads[extra]]) if len(extra) else history[part], return_inverse=True)
        sizes = np.bincount(inverse[: len(part)], minlength=len(head)).astype(np.uint32)
        counted = None
        if len(extra):
            counted = np.zeros(len(head), np.uint32)
            np.add.at(counted, inverse[len(part) :], only[extra])
        out.append((g, chunk, pack_sorted(head), pack(sizes), pack(code[part]), pack(count[part].astype(np.uint32)), None if counted is None else pack(counted)))
    return out


def table_of(made: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(made, columns=[c.split(" ")[0] for c in schema.split(", ")])


def scored(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 10, tokens: int = CHUNK_TOKENS, limit: int = GROUP_KEYS, buckets: int | None = None) -> DataFrame:
    """One row per row of df: id, held_out (crc32(id as text) mod every is 0), n_tokens, n_known, train_tokens, base_score, score.

    tokens, limit and buckets bound chunks, groups of n-grams and tables of words; none of them changes the result.
    """
    columns = ["ids", "lens", "vocab", "tokens"]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two, three = np.zeros(1 << COUNTED, np.int64), np.zeros(1 << COUNTED, np.int64)
        top = np.uint64(64 - COUNTED)
        for row in rows(batches):  # a history has at most as many distinct words after it as it occurs
            r = Reading(Chunk(*row), every)
            seen = np.bincount(r.symbol, minlength=len(r.hash))
            np.add.at(two, (r.hash >> top).astype(np.int64), np.minimum(seen, len(r.hash)))
            three += np.bincount((r.pair_hash(r.symbol[r.tokens - 1], r.symbol[r.tokens]) >> top).astype(np.int64), minlength=len(three))
        both = np.concatenate([two, three])
        some = np.flatnonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(both[some])], names=["prefix", "n"])

    def bucket_of(h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(40)).astype(np.int64) * buckets) >> 24

    def send_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, *row in rows(batches):
            r = Reading(Chunk(*row), every)
            r.bigrams()
            history, code = r.hash[r.pair_u], r.code(r.pair_v)
            yield pa.RecordBatch.from_pandas(table_of(gram_rows(chunk, groups2.of(history, code), history, code, r.pair_count), GRAMS), schema=gram_type, preserve_index=False)

    def send_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, *row in rows(batches):
            r = Reading(Chunk(*row), every)
            r.words()
            h, c = r.hash[r.order], r.count[r.order].astype(np.uint32)
            c[h == START] = (~r.held).sum()  # a start is followed by a token, and is none
            made = [(b, chunk, pack_sorted(h[lo:hi]), pack(c[lo:hi])) for b, lo, hi in stretches(bucket_of(h))]
            yield pa.RecordBatch.from_pandas(table_of(made, ASKS), schema=ask_type, preserve_index=False)

    def send_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for heads, kinds in rows(batches):
            h, k = unpack_sorted(heads, np.uint64), unpack(kinds, np.int64)
            for b, lo, hi in stretches(bucket_of(h)):
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([pack_sorted(h[lo:hi])], pa.binary()), pa.array([pack(k[lo:hi])], pa.binary())], names=["bucket", "heads", "kinds"])

    def with_pairs(left: pd.DataFrame, right: pd.DataFrame) -> tuple[Reading, np.ndarray, np.ndarray]:
        """A chunk's reading with its trigrams, the totals of its bigrams, and whether other chunks have them."""
        r = Reading(Chunk(*left.loc[0, columns]), every)
        r.bigrams()
        r.trigrams()
        both = laid_out(groups2.of(r.hash[r.pair_u], r.code(r.pair_v)), right, "x")
        return r, both >> 1, both & 1 > 0

    def send_trigrams(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Messages to groups of trigrams; rows with a null group ask a bucket for the T of histories that are split."""
        r, _, shared = with_pairs(left, right)
        chunk, sent = int(left.chunk.iat[0]), r.elsewhere(shared)
        part = np.flatnonzero(sent)
        history, code = r.pair_key[r.three_h[part]], r.code(r.pair_v[r.three_t[part]])
        at_home = np.bincount(r.three_h, (r.three_count > 0) & ~sent, minlength=len(shared)).astype(np.uint32)
        used = np.zeros(len(shared), bool)
        used[r.three_h] = True
        head = np.flatnonzero(shared & used)
        key = r.pair_key[head]
        split = groups3.split(key)
        made = gram_rows(chunk, groups3.of(history, code), history, code, r.three_count[part], key[~split], groups3.of(key[~split], np.zeros((~split).sum(), np.uint64)), at_home[head[~split]])
        order = np.argsort(key[split], kind="stable")
        k, only = key[split][order], at_home[head[split]][order]
        asks = [(-1 - b, chunk, pack_sorted(k[lo:hi]), None, None, pack(only[lo:hi]), None) for b, lo, hi in stretches(bucket_of(k))]
        return table_of(made + asks, GRAMS)

    def settle_trigrams(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf.group.iat[0] < 0:  # asks go on as they are
            return pd.DataFrame({"chunk": pdf.chunk, "part": pdf.group, "x": pdf.history, "y": pdf["count"]}).astype({"chunk": "Int64"})
        return settle_grams(pdf, True, groups3.split)

    spark = df.sparkSession
    gram_type = pa.schema([(c.split(" ")[0], pa.int64() if c.endswith("bigint") else pa.binary()) for c in GRAMS.split(", ")])
    ask_type = pa.schema([(c.split(" ")[0], pa.int64() if c.endswith("bigint") else pa.binary()) for c in ASKS.split(", ")])
    reply = "chunk bigint, part bigint, x binary, y binary"
    with scratch(spark) as keep:
        store = keep(chunked(df, id_col, text_col, True, tokens))
        buckets = buckets or max(4, min(4096, store.count()))
        # two numbers for each of 2^COUNTED hash prefixes come to the driver, whatever the corpus
        counts = np.zeros(2 << COUNTED, np.int64)
        for prefix, n in store.select(*columns).mapInArrow(counted, "prefix int, n bigint").groupBy("prefix").agg(F.sum("n").alias("n")).collect():
            counts[prefix] = n
        groups2, groups3 = Groups(counts[: 1 << COUNTED], limit), Groups(counts[1 << COUNTED :], limit)

        pairs = stored(store.select("chunk", *columns).mapInArrow(send_pairs, GRAMS).groupBy("group").applyInPandas(lambda pdf: settle_grams(pdf, False, lambda heads: np.ones(len(heads), bool)), reply), "bigrams", "none")
        words = store.select("chunk", *columns).mapInArrow(send_words, ASKS)
        heads = pairs.where("chunk is null").select("x", "y").mapInArrow(send_heads, "bucket bigint, heads binary, kinds binary")
        told = stored(words.groupBy("bucket").cogroup(heads.groupBy("bucket")).applyInPandas(settle_sums, SUMS), "words", "none")
        row = told.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
        n_train, v_train = int(row.n or 0), int(row.v or 0)

        pairs = pairs.where("chunk is not null").select("chunk", "part", "x")
        asked = store.groupBy("chunk").cogroup(pairs.groupBy("chunk")).applyInPandas(send_trigrams, GRAMS)
        threes = stored(asked.groupBy("group").applyInPandas(settle_trigrams, reply), "trigrams", "none")
        asks = threes.where("part < 0").select((-F.col("part") - 1).alias("bucket"), "chunk", F.col("x").alias("keys"), F.col("y").alias("count"))
        heads = threes.where("part >= 0 AND chunk is null").select("x", "y").mapInArrow(send_heads, "bucket bigint, heads binary, kinds binary")
        split = stored(asks.groupBy("bucket").cogroup(heads.groupBy("bucket")).applyInPandas(settle_sums, SUMS), "split", "none")
        none = F.lit(None).cast("binary").alias("y")
        every_reply = (
            pairs.select("chunk", F.lit(2).alias("kind"), "part", "x", none)
            .union(told.where("chunk is not null").select("chunk", F.lit(1).alias("kind"), "part", "x", "y"))
            .union(threes.where("chunk is not null AND part >= 0").select("chunk", F.lit(3).alias("kind"), "part", "x", "y"))
            .union(split.where("chunk is not null").select("chunk", F.lit(4).alias("kind"), "part", "x", "y"))
        )
        replies = keep(stored(every_reply, "replies", "none"))

    def finish(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        r, total2, shared = with_pairs(left, right[right.kind == 2])
        size, pairs_n = len(r.hash), len(r.pair_u)
        words = right[right.kind == 1]
        count, kinds = np.zeros(size, np.int64), np.zeros(size, np.int64)
        count[r.order] = laid_out(bucket_of(r.hash[r.order]), words, "x")
        kinds[r.order] = laid_out(bucket_of(r.hash[r.order]), words, "y")

        sent = r.elsewhere(shared)
        total3, kinds3 = r.three_count.copy(), np.bincount(r.three_h, r.three_count > 0, minlength=pairs_n).astype(np.int64)
        part = np.flatnonzero(sent)
        used = np.zeros(pairs_n, bool)
        used[r.three_h] = True
        head = np.flatnonzero(shared & used)
        head = head[np.argsort(r.pair_key[head], kind="stable")]
        key = r.pair_key[head]
        split = groups3.split(key)
        threes = right[right.kind == 3]
        group = groups3.of(r.pair_key[r.three_h[part]], r.code(r.pair_v[r.three_t[part]]))
        total3[part] = laid_out(group, threes, "x") >> 1
        whole, which = np.unique(key[~split], return_inverse=True)
        kinds3[head[~split]] = laid_out(groups3.of(whole, np.zeros(len(whole), np.uint64)), threes, "y")[which]
        asked = right[right.kind == 4]
        place = bucket_of(key[split])
        kinds3[head[split]] = laid_out(place, asked, "x") + laid_out(place, asked, "y")

        with np.errstate(divide="ignore", invalid="ignore"):
            p = (count + ADD) / (n_train + ADD * (v_train + 1))
            p2 = (total2 + kinds[r.pair_u] * p[r.pair_v]) / (count + kinds)[r.pair_u]  # in training, a token follows every word and start
            back = np.where(kinds[r.pair_u] > 0, p2, p[r.pair_v])  # probability of a bigram's last symbol after its first
            p3 = (total3 + kinds3[r.three_h] * back[r.three_t]) / (total2 + kinds3)[r.three_h]
            fall2, fall3 = np.log10(kinds / (count + kinds)), np.log10(kinds3 / (total2 + kinds3))
            root = np.log10(p)
        one = np.where(kinds > 0, 1 + np.arange(size), 0)  # the state of a symbol's history
        two = np.where(kinds3 > 0, 1 + size + np.arange(pairs_n), one[r.pair_v])
        arcs2, arcs3 = np.flatnonzero(total2 > 0), np.flatnonzero(total3 > 0)
        fst = BackoffAutomaton(
            size,
            np.concatenate([1 + r.pair_u[arcs2], 1 + size + r.three_h[arcs3]]),
            np.concatenate([r.pair_v[arcs2], r.pair_v[r.three_t[arcs3]]]),
            np.log10(np.concatenate([p2[arcs2], p3[arcs3]])),
            np.concatenate([two[arcs2], two[r.three_t[arcs3]]]),
            np.concatenate([np.zeros(1 + size, np.int64), one[r.pair_v]]),
            np.concatenate([[0.0], fall2, fall3]),
            root,
            one,
        )
        score = fst.traverse(r)
        text = np.repeat(np.arange(len(r.lens)), r.lens)
        token = r.symbol[r.tokens]
        base = np.bincount(text, root[token], minlength=len(r.lens))
        known = np.bincount(text, count[token] > 0, minlength=len(r.lens)).astype(np.int64)
        ids = pd.array([None if i == NO_ID else i for i in r.ids.tolist()], dtype="Int64")
        return pd.DataFrame({"id": ids, "held_out": r.held, "n_tokens": r.lens, "n_known": known, "train_tokens": n_train, "base_score": base, "score": score})

    done = store.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInPandas(finish, "id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return done.withColumn("id", F.col("id").cast(df.schema[id_col].dataType)).withColumnRenamed("id", id_col)
