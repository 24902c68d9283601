"""Small tables with awkward rows, and plain versions of what operators do."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id int, n string, copies int, h string, part string, v double"


def words_of(text):
    return (text or "").encode().split()


def lowered(text):
    return (text or "").encode().lower().split()


def awkward(n=60, seed=5):
    """Rows with nulls in every column, empty and long texts, ties, near copies and repeated rows."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 160))) for _ in range(n)]
    for i in range(8):
        w = texts[i].split()
        for _ in range(max(1, len(w) // 40)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    texts += [texts[0], texts[0], texts[1].upper(), " ".join(texts[2:30]), None, "", " \t\n", "é", "日本 語", "a b", "a b", "12345 %%"]
    rows = [(i, t, rng.choice(["x", "y", None]), rng.choice(["s1", "s2", "s3", "é", None]), None if t is None else len(t), None, "n", 1, "h", None, 0.5) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (*rows[4][:3], None, *rows[4][4:])]


def components(ids, links):
    label = {i: i for i in ids}
    while True:
        moved = False
        for a, b in links:
            low = min(label[a], label[b])
            for x in (a, b):
                if label[x] != low:
                    label[x], moved = low, True
        if not moved:
            return label
