"""Other forms of model files: version 2 text, binary version 3, background files; and what kind a file is.

Version 2 text has scores in thousandths of a bit against a null model that it states; what it can't say (transitions of
the last node, insert emissions) is filled in when read. The binary form is the little-endian dump of version 3/f:
a magic word, flags, sizes, probabilities in single precision, strings with their lengths, annotation lines, statistics.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.alphabet import ALPHABETS, background
from seqloom.operators.profile import Model, composition, consensus
from seqloom.sources.hmmfile import MAGIC, SCHEMA, parse, record

# Fixed values of the formats: magic words and flags of the binary form, numbers of alphabets, order of statistics.
BINARY = 0xE8EDEDBA
FLAGS = {"descr": 1 << 1, "rf": 1 << 2, "cs": 1 << 3, "stats": 1 << 7, "map": 1 << 8, "acc": 1 << 9, "ga": 1 << 10, "tc": 1 << 11, "nc": 1 << 12, "compo": 1 << 14, "checksum": 1 << 15, "consensus": 1 << 16, "mm": 1 << 17}
ALPHABET_NUMBERS = {"rna": 1, "dna": 2, "amino": 3}
STATS = ("msv_mu", "msv_lambda", "vit_mu", "vit_lambda", "fwd_tau", "fwd_lambda")
UNSET = -99999.0
MAGIC2 = re.compile(r"[A-Z]+2\.0\b")


def score2(p: float, null: float) -> str:
    """A probability as thousandths of a bit, `*` for zero."""
    return "*" if p <= 0 else str(int(np.floor(0.5 + 1000 * np.log2(p / null))))


def prob2(score: str, null: float) -> float:
    return 0.0 if score == "*" else null * 2.0 ** (int(score) / 1000)


def render_v2(model: Model, magic: str = "PROFILE2.0") -> str:
    letters, f, m = ALPHABETS[model.alphabet], model.bg, model.m
    long = 350 if model.alphabet == "amino" else 1000
    loop, move = score2(long / (long + 1), 1), score2(1 / (long + 1), 1)
    row = lambda scores: " ".join(f"{s:>6}" for s in scores)
    yes = lambda value: "no" if value is None else "yes"
    out = [f"{magic}  [seqloom]", f"NAME  {model.name}"]
    out += [f"{tag:<5} {value}" for tag, value in (("ACC", model.acc), ("DESC", model.descr), ("LENG", m), ("ALPH", "Amino" if model.alphabet == "amino" else "Nucleic"), ("RF", yes(model.rf)), ("CS", yes(model.cs)), ("MAP", yes(model.map)), ("NSEQ", model.nseq)) if value is not None]
    out += [f"{tag.upper():<5} {a:.1f} {b:.1f}" for tag, (a, b) in model.cutoffs.items()]
    out += [f"XT     {row([move, loop, score2(0.5, 1), score2(0.5, 1), move, loop, move, loop])}", f"NULT   {row([loop, move])}", f"NULE   {row(score2(x, 1 / len(f)) for x in f)}"]
    out += ["HMM      " + "      ".join(letters), "       " + row(["m->m", "m->i", "m->d", "i->m", "i->i", "d->m", "d->d", "b->m", "m->e"])]
    out.append("       " + row([score2(1 - model.t[0, 2], 1), "*", score2(model.t[0, 2], 1)]))
    ins = model.ins if model.ins is not None else np.tile(f, (m + 1, 1))
    note = lambda line, k: "-" if line is None else line[k - 1]
    for k in range(1, m + 1):
        last = k == m
        out.append(f" {k:5d} {row(score2(p, q) for p, q in zip(model.mat[k], f, strict=True))}" + (f" {model.map[k - 1]:5d}" if model.map is not None else ""))
        out.append(f" {note(model.rf, k):>5} {row('*' if last else score2(p, q) for p, q in zip(ins[k], f, strict=True))}")
        out.append(f" {note(model.cs, k):>5} {row([*('*' if last else score2(p, 1) for p in model.t[k]), score2(model.t[0, 0], 1) if k == 1 else '*', '0' if last else '*'])}")
    return "\n".join([*out, "//"]) + "\n"


def parse_v2(text: str) -> Model:
    """One model from version 2 text, each distribution scaled to sum to one. It has no calibration: that is another model's statistics."""
    lines = [x.split() for x in text.splitlines() if x.strip()]
    if not lines or not MAGIC2.match(lines[0][0]):
        raise ValueError("not a version 2 model")
    head = next(i for i, w in enumerate(lines) if w[0] == "HMM")
    tags = {w[0]: w[1:] for w in lines[1:head]}
    alphabet = {"amino": "amino", "nucleic": "dna"}[tags["ALPH"][0].lower()]
    size, m = len(ALPHABETS[alphabet]), int(tags["LENG"][0])
    null = [prob2(s, 1 / size) for s in tags["NULE"]] if "NULE" in tags else background(alphabet)
    mat, t = np.zeros((m + 1, size)), np.zeros((m + 1, 7))
    begin = lines[head + 2]
    t[0] = [prob2(begin[0], 1), 0, prob2(begin[2], 1), 1, 0, 1, 0]
    places: list[int] = []
    marks: dict[str, list[str]] = {"rf": [], "cs": []}
    for k in range(1, m + 1):
        match, insert, move = lines[head + 3 * k : head + 3 * k + 3]
        if int(match[0]) != k:
            raise ValueError(f"{tags['NAME'][0]}: node {k} is missing")
        mat[k] = [prob2(s, q) for s, q in zip(match[1 : size + 1], null, strict=True)]
        places += [int(w) for w in match[size + 1 : size + 2]]
        marks["rf"].append(insert[0])
        marks["cs"].append(move[0])
        t[k] = [1, 0, 0, 1, 0, 1, 0] if k == m else [prob2(s, 1) for s in move[1:8]]
    mat[1:] /= mat[1:].sum(1, keepdims=True)
    for part in (slice(0, 3), slice(3, 5), slice(5, 7)):
        t[:, part] /= np.maximum(t[:, part].sum(1, keepdims=True), 1e-300)
    has = lambda tag: tags.get(tag, ["no"])[0].lower() == "yes"
    model = Model(tags["NAME"][0], mat, t, np.tile(background(alphabet), (m + 1, 1)), alphabet, " ".join(tags["ACC"]) if "ACC" in tags else None, " ".join(tags["DESC"]) if tags.get("DESC") else None)
    model.nseq = int(tags["NSEQ"][0]) if "NSEQ" in tags else None
    model.map = places if has("MAP") and len(places) == m else None
    model.rf, model.cs = ("".join(marks[x]) if has(x.upper()) else None for x in ("rf", "cs"))
    model.cutoffs = {x.lower(): (float(tags[x][0]), float(tags[x][1].rstrip(";"))) for x in ("GA", "TC", "NC") if x in tags}
    model.consensus = consensus(model)
    return model


def to_binary(model: Model) -> bytes:
    has = {name: getattr(model, name, None) is not None for name in ("descr", "rf", "cs", "map", "acc", "checksum", "consensus", "mm")}
    has |= {name: name in model.cutoffs for name in ("ga", "tc", "nc")} | {"stats": bool(model.stats), "compo": True}
    m, ins = model.m, model.ins if model.ins is not None else np.tile(model.bg, (model.m + 1, 1))
    floats = lambda x: np.asarray(x, "<f4").tobytes()
    number = lambda *x: struct.pack(f"<{len(x)}i", *x)
    string = lambda s: number(0) if s is None else number(len(s.encode()) + 1) + s.encode() + b"\0"
    line = lambda s: b" " + s.encode("ascii") + b"\0"
    out = [struct.pack("<I", BINARY), number(sum(FLAGS[k] for k, v in has.items() if v), m, ALPHABET_NUMBERS[model.alphabet]), floats(model.mat[1:]), floats(ins), floats(model.t), string(model.name)]
    out += [string(getattr(model, name)) for name in ("acc", "descr") if has[name]]
    out += [line(getattr(model, name)) for name in ("rf", "mm", "consensus", "cs") if has[name]]
    out += [string(None), number(-1 if model.nseq is None else model.nseq), floats([-1 if model.eff_nseq is None else model.eff_nseq]), number(-1 if model.max_length is None else model.max_length), string(None)]
    out += [number(0, *model.map)] if has["map"] else []
    out += [struct.pack("<I", model.checksum or 0), floats([model.stats.get(s, UNSET) for s in STATS])]
    out += [floats([x for kind in ("ga", "tc", "nc") for x in model.cutoffs.get(kind, (UNSET, UNSET))]), floats(composition(model))]
    return b"".join(out)


def from_binary(data: bytes, at: int = 0) -> tuple[Model, int]:
    """A model and where the next one begins."""
    def take(kind: str, count: int) -> list:
        nonlocal at
        size = struct.calcsize(f"<{count}{kind}")
        if at + size > len(data):
            raise ValueError("a binary model is cut short")
        out = struct.unpack_from(f"<{count}{kind}", data, at)
        at += size
        return list(out)

    def floats(*shape: int) -> np.ndarray:
        return np.array(take("f", int(np.prod(shape)))).reshape(shape)

    def string() -> str | None:
        size = take("i", 1)[0]
        return bytes(take("B", size)[:-1]).decode() if size else None

    if take("I", 1)[0] != BINARY:
        raise ValueError("not a binary model of version 3/f")
    flags, m, kind = take("i", 3)
    has = {name: bool(flags & bit) for name, bit in FLAGS.items()}
    alphabet = next(a for a, n in ALPHABET_NUMBERS.items() if n == kind)
    size = len(ALPHABETS[alphabet])
    mat = np.vstack([np.zeros((1, size)), floats(m, size)])
    ins, t = floats(m + 1, size), floats(m + 1, 7)
    model = Model(string() or "", mat, t, ins, alphabet)
    model.acc, model.descr = (string() if has[name] else None for name in ("acc", "descr"))
    for name in ("rf", "mm", "consensus", "cs"):
        if has[name]:
            setattr(model, name, bytes(take("B", m + 2)[1:-1]).decode())
    string()
    nseq, eff, longest = take("i", 1)[0], floats(1)[0], take("i", 1)[0]
    string()
    model.nseq, model.eff_nseq, model.max_length = (None if v < 0 else v for v in (nseq, float(eff), longest))
    model.map = take("i", m + 1)[1:] if has["map"] else None
    checksum, stats, cutoffs = take("I", 1)[0], floats(6), floats(3, 2)
    model.checksum = checksum if has["checksum"] else None
    model.stats = dict(zip(STATS, stats.tolist(), strict=True)) if has["stats"] else {}
    model.cutoffs = {k: tuple(c.tolist()) for k, c in zip(("ga", "tc", "nc"), cutoffs, strict=True) if has[k]}
    if has["compo"]:
        floats(size)
    return model, at


def kind_of(data: bytes) -> str:
    """binary, text3, text2 or unknown, from the first bytes of a file."""
    if data[:4] == struct.pack("<I", BINARY):
        return "binary"
    first = data[:200].lstrip().decode("utf-8", "replace")
    return "text3" if MAGIC.match(first) else "text2" if MAGIC2.match(first) else "unknown"


def models_of(data: bytes) -> Iterator[Model]:
    """The models of a file of any known kind."""
    kind = kind_of(data)
    if kind == "unknown":
        raise ValueError("no model file of a known kind")
    if kind == "binary":
        at = 0
        while at < len(data):
            model, at = from_binary(data, at)
            yield model
        return
    for text in re.split(r"(?m)^//\s*$", data.decode()):
        if text.strip():
            yield (parse if kind == "text3" else parse_v2)(text.lstrip())


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """A row per model of files of mixed kinds in any store; a file is read by one task, so large ones belong into the text form of read_models."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data in pdf.content:
                yield pd.DataFrame([record(m) for m in models_of(bytes(data))])

    return files.mapInPandas(run, SCHEMA)


def fetch_listed(models: DataFrame, keys: DataFrame) -> DataFrame:
    """Models whose name or accession is among keys(key)."""
    k = keys.select("key").where("key is not null").distinct()
    return models.join(k, (F.col("name") == F.col("key")) | (F.col("acc") == F.col("key")), "left_semi")


def duplicate_names(models: DataFrame) -> DataFrame:
    """(name, n) of names that an index can't hold, as several models have them."""
    return models.groupBy("name").agg(F.count("*").alias("n")).where("n > 1")


def render_background(f: np.ndarray, alphabet: str = "amino") -> str:
    return "\n".join([alphabet, *(f"{a} {x:.6f}" for a, x in zip(ALPHABETS[alphabet], f, strict=True))]) + "\n"


def parse_background(text: str) -> tuple[str, np.ndarray]:
    """(alphabet, frequencies) of a background file: an alphabet's name, then a letter and its frequency per line; # begins a comment."""
    words = " ".join(line.split("#")[0] for line in text.splitlines()).split()
    alphabet, letters = words[0].lower(), words[1::2]
    given = {a.upper(): float(x) for a, x in zip(letters, words[2::2], strict=True)}
    f = np.array([given[a] for a in ALPHABETS[alphabet]])
    if len(given) != len(f) or abs(f.sum() - 1) > 1e-3:
        raise ValueError("frequencies of all letters must be given once and sum to 1")
    return alphabet, f / f.sum()
