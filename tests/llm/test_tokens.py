"""Token counts, and the alignment of two tokenizers, against the libraries and plain versions."""

import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from helpers import SCHEMA, awkward
from tokenizers import Tokenizer

from seqloom.llm import alignment, bytebpe, tokencount

ODD = [
    "<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>", "<|endoftext", "  two  spaces ", " ", "\n\n x\t\ty \n", "a▁b", "it's we'll '' 's", "x\x00y", "\x85\x1c\x1f", "　wide\xa0space",
    "é ‍ \U0001f468‍\U0001f469 ﻿", "՘ ꟝1 \U0003fc2c", "日本語の文章", "<s> </s> <unk> <0x41>", "١٢٣ ⅷ ²", "z" * 3000, "word " * 400,
]
LETTERS = " \t\n  'stlm12é日ab!?՘​　▁\x00\x85"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    more = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 40))) for _ in range(150)]
    texts = [*ODD, *more, *ODD[:3]]
    return awkward() + [(1000 + i, t, None, None, None, None, "n", 1, "h", None, 0.5) for i, t in enumerate(texts)] + [(None, "no id", *[None] * 9), (None, None, *[None] * 9)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def plain():
    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tool.encode_special_tokens = True
    return tool


@pytest.fixture(scope="module")
def piece():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_token_counts_are_the_librarys(docs, rows):
    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = [(r[0], len((r[1] or "").encode()), n := len(tool.encode(r[1] or "", add_special_tokens=False).ids), n > 100) for r in rows]
    for table in (None, {}):  # with a first tier, and without
        found = [tuple(r) for r in tokencount.token_counts(docs, limit=100, table=table).collect()]
        assert sorted(map(str, found)) == sorted(map(str, expected))


def test_token_counts_of_piece_models(docs, rows, piece):
    path = public_tokenizers.path("piece_bpe_32k.model")
    found = tokencount.token_counts(docs, tokenizer=path).select("doc_id", "n_tokens").collect()
    assert sorted(map(str, map(tuple, found))) == sorted(str((r[0], len(piece.encode(r[1] or "")))) for r in rows)


def test_the_table_of_frequent_parts_has_the_most_frequent_ones(docs, rows):
    tool = bytebpe.encoder(tokencount.TOKENIZER, bytebpe.load(tokencount.TOKENIZER))
    counts = Counter(x for r in rows for some in tool.parts(r[1] or "") for x in some if len(x) <= bytebpe.PART_LONGEST)
    table = tokencount.frequent(docs)
    assert list(table) == sorted(counts, key=lambda x: (-counts[x], x))
    assert len(tokencount.frequent(docs, most=50)) == 50 and " word" in tokencount.frequent(docs, most=1)
    assert all(n == len(tool.encode(x)) for x, n in table.items())
    assert tokencount.unpacked(tokencount.packed(table)) == {k: v for k, v in table.items() if "\0" not in k}
    assert tokencount.unpacked(tokencount.packed({})) == {}
    assert tokencount.frequent(docs, sample=0) == {} and tokencount.frequent(docs.limit(0)) == {}


def test_a_full_cache_is_emptied_and_goes_on():
    made = []
    kept = bytebpe.Kept(lambda part: made.append(part) or len(part), limit=3 * bytebpe.ENTRY + 40)
    assert [kept[x] for x in ("a", "bb", "a", "ccc", "dddd", "a", "e" * 65)] == [1, 2, 1, 3, 4, 1, 65]
    assert made == ["a", "bb", "ccc", "dddd", "a", "e" * 65] and "e" * 65 not in kept and len(kept) <= 3


def test_long_texts_are_cut_where_no_part_crosses(plain, piece):
    rng = random.Random(9)
    text = "".join(rng.choice("  \n'stabé日1!") for _ in range(4000))
    one = bytebpe.ByteLevel(bytebpe.load(tokencount.TOKENIZER), special=False)
    two = bytebpe.Pieces(bytebpe.load(alignment.SECOND))
    size = bytebpe.SLICE
    try:
        for bytebpe.SLICE in (1, 7, 500):
            assert len(list(bytebpe.slices(text))) > 3 and "".join(bytebpe.slices(text)) == text
            assert [i for some in one.parts(text) for x in some for i in one.encode(x)] == plain.encode(text, add_special_tokens=False).ids
            assert [i for some in two.parts(text) for x in some for i in two.encode(x)] == piece.encode(text)
    finally:
        bytebpe.SLICE = size


def test_characters_that_are_settled_are_cut_alike(plain):
    """Every character of the table that counts as settled is classed as by the library's own pattern."""
    every = [chr(c) for c in [*range(0x3000), *range(0xA000, 0xD800, 3), *range(0xF900, 0x11000), *range(0x11000, 0x110000, 97)]]
    some = [c for c in every if bytebpe.settled(c)]
    assert len(some) > 15_000 and not bytebpe.settled("\U0003fc2c")
    text = "".join(f"a{c}1{c}!{c}{c} {c}" for c in some)
    assert bytebpe._PARTS.findall(text) == [text[a:b] for _, (a, b) in plain.pre_tokenizer.pre_tokenize_str(text)]


def test_files_of_another_form_are_refused():
    with pytest.raises(ValueError, match="neither"):
        bytebpe.encoder("x.txt", b"")
    with pytest.raises(ValueError, match="normaliser"):
        bytebpe.encoder("word_bpe_49k.json", bytebpe.load(public_tokenizers.path("word_bpe_49k.json")))
    with pytest.raises(ValueError, match="byte-level"):
        alignment.Aligner((alignment.SECOND, bytebpe.load(alignment.SECOND)), (alignment.FIRST, bytebpe.load(alignment.FIRST)))


# alignment
def spelled(text, plain, piece):
    """(id, from, to) of both tokenizers' tokens over space+text, or None."""
    if not text:
        return None
    back = bytebpe.unicode_bytes()
    a = [(i, bytes(back[c] for c in plain.id_to_token(i)) if i != 50256 else b"<|endoftext|>") for i in plain.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(piece.id_to_piece(i)[3:5], 16)]) if piece.is_byte(i) else piece.id_to_piece(i).replace("▁", " ").encode()) for i in piece.encode(text)]
    if any(b"".join(x for _, x in side) != (" " + text).encode() for side in (a, b)):
        return None
    out = []
    for side in (a, b):
        at, spans = 0, []
        for i, x in side:
            spans.append((i, at, at + len(x)))
            at += len(x)
        out.append(spans)
    return out


def brute(rows, plain, piece, overlapping=False):
    """All of it token by token."""
    per, counts = [], Counter()
    for doc, text, *_ in rows:
        sides = spelled(text, plain, piece)
        if sides is None:
            per.append((doc, 0, 0, 0, [], ""))
            continue
        a, b = sides
        cuts = sorted({x[2] for x in a} & {x[2] for x in b})
        lo, groups = 0, []
        for hi in cuts:
            groups.append("|".join(",".join(str(i) for i, f, t in side if lo <= f and t <= hi) for side in (a, b)))
            lo = hi
        if overlapping:
            links = [(i, j) for i, f, t in a for j, g, u in b if max(f, g) < min(t, u)]
        else:
            ends = {u: j for j, _, u in b}
            links = [(i, ends[t]) for i, _, t in a if t in ends]
        counts.update(links)
        per.append((doc, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = defaultdict(int)
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    return [(doc, na, nb, ng, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), h) for doc, na, nb, ng, links, h in per]


@pytest.mark.parametrize(("overlapping", "size", "hot"), [(False, 1_000_000, 1 << 15), (False, 300, 40), (False, 300, 0), (True, 2000, 40)])
def test_alignment_is_that_of_the_tokens_one_by_one(docs, rows, plain, piece, overlapping, size, hot):
    found = alignment.align(docs, overlapping=overlapping, chunk_links=size, hot=hot).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, brute(rows, plain, piece, overlapping)))


def test_tokens_and_their_overlaps(docs, rows, plain, piece):
    by = defaultdict(list)
    for r in alignment.tokens(docs).collect():
        by[r.doc_id].append((r.a_ids, r.b_ids, list(zip(r.a, r.b, r.together, strict=True))))
    for doc, text, *_ in rows:
        a, b = spelled(text, plain, piece) or ([], [])
        pairs = [(i, j, t == u) for i, (_, f, t) in enumerate(a) for j, (_, g, u) in enumerate(b) if max(f, g) < min(t, u)]
        assert ([x[0] for x in a], [x[0] for x in b], pairs) in by[doc]


def test_no_rows_give_none(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert tokencount.token_counts(none).collect() == [] and alignment.align(none).collect() == [] and alignment.tokens(none).collect() == []
