"""Near-dedup of vectors and documents, components, and substring dedup against plain versions."""

import hashlib
import random

import numpy as np
import pytest
from helpers import SCHEMA, awkward, components, lowered, words_of

from seqloom.llm import graph, hnsw, neardup, substrings
from seqloom.llm.corpus import Chunk, pack, pack_sorted, unpack, unpack_sorted


def test_components_equal_a_plain_search(spark):
    rng = random.Random(3)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7)]
    got = {r.v: r.m for r in graph.components(spark.createDataFrame(links, "a bigint, b bigint").repartition(7)).collect()}
    want = components({x for pair in links for x in pair}, links)
    assert got == {v: m for v, m in want.items() if v != m}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def vectors():
    rng = np.random.default_rng(1)
    base = rng.normal(size=(12, 8))
    rows = [(i, (base[i % 12] + rng.normal(scale=0.12, size=8)).tolist(), i % 3 if i % 11 else None, "x", 1) for i in range(160)]
    rows += [(200, rows[1][1], 1, None, 2), (201, rows[1][1], 1, None, 2), (202, None, 1, "x", 2), (203, [0.0] * 8, 1, "x", 2), (204, [float("nan")] * 8, 1, "x", 2)]
    return rows + [(205, [1.0, None] * 4, 1, "x", 2), (206, [1.0, 2.0], 1, "x", 2), (207, [], 2, "x", 2), (208, [float("inf")] * 8, 2, "x", 2), rows[5]]


@pytest.mark.parametrize("shard", [8192, 16])
def test_vectors_link_as_in_brute_force(spark, shard):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int, id string, m int")
    got = sorted(map(tuple, hnsw.classes(df, 0.9, shard=shard).collect()))
    ok = [r[1] is not None and len(r[1]) > 0 and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) and r[2] is not None for r in rows]
    count, links = [0] * len(rows), []
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            if i != j and ok[i] and ok[j] and a[2] == b[2] and len(a[1]) == len(b[1]) and np.dot(a[1], b[1]) / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.9:
                count[i] += 1
                links.append((a[0], b[0]))
    label = components([r[0] for r in rows], links)
    assert sum(count) > 100
    assert got == sorted((r[0], c, label[r[0]], r[0] == label[r[0]]) for r, c in zip(rows, count, strict=True))


def test_vectors_of_an_empty_table(spark):
    assert hnsw.classes(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0


def test_a_dense_group_wider_than_the_beam_is_found_whole():
    rng = np.random.default_rng(2)
    x = hnsw.unit(np.concatenate([rng.normal(size=(500, 16)), np.ones((300, 16)) + rng.normal(scale=0.05, size=(300, 16))]))
    found = hnsw.linked(hnsw.Graph(x.astype(np.float32)), x, x, 0.93)
    assert (found == (x @ x.T >= 0.93)).mean() > 0.99999


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_documents_link_as_in_brute_force(spark, width, percent):
    rows = awkward()
    got = sorted(map(tuple, neardup.classes(spark.createDataFrame(rows, SCHEMA), width, percent).collect()))
    sets = []
    for r in rows:
        w = lowered(r[1])
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    links = [(rows[i][0], rows[j][0]) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and a and b and 100 * len(a & b) >= percent * len(a | b)]
    label = components([r[0] for r in rows], links)
    assert len(links) > 8
    assert got == sorted((r[0], len(s), label[r[0]], r[0] == label[r[0]]) for r, s in zip(rows, sets, strict=True))


def test_every_pair_under_the_distance_shares_a_key():
    rng = np.random.default_rng(4)
    chunks = 9
    a = rng.integers(0, 1 << 16, (400, 4 * chunks)).astype(np.uint64)
    b = a.copy()
    for row in b:
        row[rng.choice(4 * chunks, 2 * chunks - 1, replace=False)] += np.uint64(1)
    assert (neardup.all_keys(a) == neardup.all_keys(b & np.uint64(0xFFFF))).any(1).all()


def test_large_keys_are_compared_in_blocks(spark, monkeypatch):
    """Two families that meet in keys, and chains within them, with groups and blocks of a few rows."""
    monkeypatch.setattr(neardup, "GROUP", 3)
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(40):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(120)] = f"x{rng.randrange(99)}"
        texts.append(" ".join(w))
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 85).collect()}
    sets = [{tuple(w[i : i + 3]) for i in range(118)} for w in (t.split() for t in texts)]
    links = [(i, j) for i in range(40) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    assert got == components(range(40), links)


def test_documents_of_an_empty_table(spark):
    assert neardup.classes(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_packed_arrays_come_back():
    rng = np.random.default_rng(0)
    for x in (rng.integers(0, 9, 100).astype(np.uint32), np.empty(0, np.int64), rng.integers(-5, 5, 33)):
        assert (unpack(pack(x), x.dtype) == x).all()
    x = np.sort(rng.integers(0, 1 << 63, 1000).astype(np.uint64) * 2)
    assert (unpack_sorted(pack_sorted(x), np.uint64) == x).all()


def plain_repeats(rows, window):
    least = {}
    for r in rows:
        w = words_of(r[1])
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            least[key] = min(least.get(key, r[0]), r[0])
    out = []
    for r in rows:
        w = words_of(r[1])
        gone = {k for i in range(len(w) - window + 1) if least[tuple(w[i : i + window])] < r[0] for k in range(i, i + window)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((r[0], len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("tokens", "limit", "bits"), [(2_000_000, 2_000_000, 64), (300, 200, 64), (300, 200, 6)])
def test_repeated_windows_go_as_in_brute_force(spark, tokens, limit, bits):
    """With six bits, most codes are shared by windows of other words: words alone decide."""
    rows = awkward(seed=9)
    passage = " ".join(f"p{i}" for i in range(30))
    rows += [(1000 + i, f"start{i} " + passage + f" end{i}" * 3, None, None, None, None, None, None, None, None, None) for i in range(20)]
    found = substrings.deduplicated(spark.createDataFrame(rows, SCHEMA).repartition(3), 13, tokens=tokens, limit=limit, tree_limit=limit, bits=bits)
    got = sorted(map(tuple, substrings.digest(found).collect()))
    assert got == plain_repeats(rows, 13)
    assert sum(r[2] for r in got) > 500


def test_null_ids_never_make_repeats(spark):
    text = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(None, text), (None, text), (5, text), (7, text)], "doc_id bigint, text string")
    got = {(r.doc_id, r.n_removed) for r in substrings.digest(substrings.deduplicated(df)).collect()}
    assert got == {(None, 20), (5, 0), (7, 20)}
    assert substrings.deduplicated(df.where("false")).count() == 0


def test_short_texts_have_no_windows(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "c"), (3, None), (4, "")], "doc_id bigint, text string")
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in substrings.digest(substrings.deduplicated(df.repartition(3))).collect()) == [(1, 2, 0), (2, 1, 0), (3, 0, 0), (4, 0, 0)]
    long = " ".join(f"w{i}" for i in range(20))
    mixed = df.union(spark.createDataFrame([(9, long), (8, long)], "doc_id bigint, text string")).repartition(6)  # some chunks have no window
    assert {r.doc_id: r.n_removed for r in substrings.digest(substrings.deduplicated(mixed)).collect()} == {1: 0, 2: 0, 3: 0, 4: 0, 8: 0, 9: 20}


def test_a_suffix_tree_has_the_nodes_of_its_suffixes():
    rng = np.random.default_rng(7)
    words = rng.integers(0, 3, (200, 5)).astype(np.uint32)
    doc = rng.integers(0, 40, 200)
    tree = substrings.SuffixTree(words, doc)
    order = [tuple(w) for w in words[tree.leaves].tolist()]
    assert order == sorted(order)
    for depth in (1, 2, 4, 5):
        runs = {}
        for d in range(depth, 6):
            for prefix in {x[:d] for x in order}:
                leaves = [i for i, x in enumerate(order) if x[:d] == prefix]
                if len(leaves) > 1:
                    runs[leaves[0], leaves[-1]] = d  # the deepest prefix that the leaves share
        assert {(f, la): d for d, f, la in zip(*(x.tolist() for x in tree.nodes(depth)), strict=True)} == runs
    least = {}
    for w, d in zip(map(tuple, words.tolist()), doc.tolist(), strict=True):
        least[w] = min(d, least.get(w, d))
    assert tree.repeats(5).tolist() == [d > least[w] for w, d in zip(map(tuple, words.tolist()), doc.tolist(), strict=True)]


def test_groups_follow_path_order():
    counts = np.random.default_rng(5).integers(0, 50, 1 << substrings.COUNTED)
    counts[7] = 5000
    groups = substrings.Prefixes(counts, 100)
    path = np.sort(np.random.default_rng(6).integers(0, 1 << 62, 5000).astype(np.uint64) * np.uint64(4))
    assert (np.diff(groups.of(path)) >= 0).all()
    assert groups.of(path).max() < groups.count


def test_chunks_hold_their_documents(spark):
    from seqloom.llm.corpus import chunked, rows

    given = awkward()
    store = chunked(spark.createDataFrame(given, SCHEMA), "doc_id", "text", False, 200)
    back = []
    for r in store.select("ids", "lens", "vocab", "tokens").collect():
        c = Chunk(*map(bytes, r))
        back += [(i, [c.words[t] for t in c.tokens[s : s + n]]) for i, s, n in zip(c.ids, c.starts, c.lens, strict=True)]
    assert sorted(back) == sorted((r[0], words_of(r[1])) for r in given)
    assert rows
