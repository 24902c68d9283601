"""Profile model files, text form of version 3: parsed per model, rendered from a Model.

Probabilities are written as minus natural logs with five decimals, '*' for zero.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.alphabet import ALPHABETS
from seqloom.operators.profile import Model, composition

# Names of files' alphabets, and of calibration lines.
NAMES = {"amino": "amino", "dna": "DNA", "rna": "RNA"}
STATS = {"MSV": ("msv_mu", "msv_lambda"), "VITERBI": ("vit_mu", "vit_lambda"), "FORWARD": ("fwd_tau", "fwd_lambda")}
MAGIC = re.compile(r"[A-Z]+3/[a-f]\b")
FLAGS = (("RF", "rf"), ("MM", "mm"), ("CONS", "consensus"), ("CS", "cs"), ("MAP", "map"))

SCHEMA = (
    "name string, acc string, descr string, m int, max_length int, alphabet string, nseq int, eff_nseq double, checksum bigint, "
    "stats map<string,double>, cutoffs map<string,array<double>>, nodes array<struct<k:int,mat:array<double>,ins:array<double>,t:array<double>,map:int,consensus:string,rf:string,mm:string,cs:string>>"
)


def _numbers(words: list[str]) -> np.ndarray:
    return np.array([0.0 if w == "*" else float(np.exp(-float(w))) for w in words])


def parse(text: str) -> Model:
    """One model from its text."""
    lines = [x for x in text.splitlines() if x.strip()]
    if not lines or not MAGIC.match(lines[0]):
        raise ValueError("not a version 3 model")
    tags: dict[str, str] = {}
    stats: dict[str, float] = {}
    cutoffs: dict[str, tuple[float, float]] = {}
    at = 1
    while not lines[at].startswith("HMM "):
        tag, _, value = lines[at].strip().partition(" ")
        value = value.strip()
        if tag == "STATS":
            _, kind, a, b = value.split()
            stats |= dict(zip(STATS[kind], (float(a), float(b)), strict=True))
        elif tag in ("GA", "TC", "NC"):
            a, b = value.rstrip(";").split()[:2]
            cutoffs[tag.lower()] = (float(a), float(b.rstrip(";")))
        else:
            tags[tag] = value
        at += 1
    alphabet = tags["ALPH"].lower()
    m, k = int(tags["LENG"]), len(ALPHABETS[alphabet])
    at += 2
    if lines[at].split()[0] == "COMPO":
        at += 1
    mat, ins, t = np.zeros((m + 1, k)), np.zeros((m + 1, k)), np.zeros((m + 1, 7))
    ins[0], t[0] = _numbers(lines[at].split()), _numbers(lines[at + 1].split())
    at += 2
    notes: dict[str, list] = {name: [] for _, name in FLAGS}
    for node in range(1, m + 1):
        words = lines[at].split()
        if int(words[0]) != node:
            raise ValueError(f"{tags.get('NAME')}: node {node} is missing")
        mat[node] = _numbers(words[1 : k + 1])
        rest = words[k + 1 :]
        if len(rest) >= 5:
            for name, value in zip(("map", "consensus", "rf", "mm", "cs"), rest, strict=False):
                notes[name].append(value)
        elif len(rest) == 4:  # the older forms have no consensus
            for name, value in zip(("map", "rf", "cs"), (rest[0], rest[-2], rest[-1]), strict=True):
                notes[name].append(value)
        ins[node], t[node] = _numbers(lines[at + 1].split()), _numbers(lines[at + 2].split())
        at += 3
    has = {name: tags.get(flag, "no").lower() == "yes" for flag, name in FLAGS}
    line = lambda name: "".join(notes[name]) if has[name] and len(notes[name]) == m else None
    model = Model(tags["NAME"], mat, t, ins, alphabet, tags.get("ACC"), tags.get("DESC"), stats=stats, cutoffs=cutoffs)
    model.nseq = int(tags["NSEQ"]) if "NSEQ" in tags else None
    model.eff_nseq = float(tags["EFFN"]) if "EFFN" in tags else None
    model.max_length = int(tags["MAXL"]) if "MAXL" in tags else None
    model.checksum = int(tags["CKSUM"]) if "CKSUM" in tags else None
    model.map = [int(x) for x in notes["map"]] if has["map"] and len(notes["map"]) == m else None
    model.consensus, model.rf, model.mm, model.cs = line("consensus"), line("rf"), line("mm"), line("cs")
    return model


def render(model: Model, magic: str = "PROFILE3/f") -> str:
    """The text of a model, version 3/f; other programs want the magic word of their own as first line."""
    number = lambda x: "      *" if x <= 0 else f"{-np.log(x) + 0.0:7.5f}"
    row = lambda xs: "  ".join(number(x) for x in xs)
    letters = ALPHABETS[model.alphabet]
    out = [f"{magic} [seqloom]", f"NAME  {model.name}"]
    out += [f"{tag:<5} {value}" for tag, value in (("ACC", model.acc), ("DESC", model.descr), ("LENG", model.m), ("MAXL", model.max_length), ("ALPH", NAMES[model.alphabet])) if value is not None]
    out += [f"{flag:<5} {'yes' if getattr(model, name) is not None else 'no'}" for flag, name in FLAGS]
    out += [f"{tag:<5} {value}" for tag, value in (("NSEQ", model.nseq), ("EFFN", model.eff_nseq), ("CKSUM", model.checksum)) if value is not None]
    out += [f"{tag.upper():<5} {a:.2f} {b:.2f};" for tag, (a, b) in model.cutoffs.items()]
    out += [f"STATS LOCAL {kind} {model.stats[a]:.4f} {model.stats[b]:.5f}" for kind, (a, b) in STATS.items() if a in model.stats]
    out += ["HMM          " + "        ".join(letters), "            " + "     ".join(["m->m", "m->i", "m->d", "i->m", "i->i", "d->m", "d->d"])]
    ins = model.ins if model.ins is not None else np.tile(model.bg, (model.m + 1, 1))
    out += ["  COMPO   " + row(composition(model)), "          " + row(ins[0]), "          " + row(model.t[0])]
    note = lambda values, k: values[k - 1] if values is not None else "-"
    for k in range(1, model.m + 1):
        marks = " ".join(str(note(v, k)) for v in (model.map, model.consensus, model.rf, model.mm, model.cs))
        out += [f"{k:7d}   {row(model.mat[k])}  {marks}", "          " + row(ins[k]), "          " + row(model.t[k])]
    return "\n".join([*out, "//"]) + "\n"


def record(model: Model) -> dict:
    """A model as a row of SCHEMA."""
    note = lambda values, k: None if values is None or k == 0 else values[k - 1]
    ins = model.ins if model.ins is not None else np.tile(model.bg, (model.m + 1, 1))
    nodes = [{"k": k, "mat": model.mat[k].tolist(), "ins": ins[k].tolist(), "t": model.t[k].tolist(), "map": note(model.map, k), "consensus": note(model.consensus, k), "rf": note(model.rf, k), "mm": note(model.mm, k), "cs": note(model.cs, k)} for k in range(model.m + 1)]
    return {"name": model.name, "acc": model.acc, "descr": model.descr, "m": model.m, "max_length": model.max_length, "alphabet": model.alphabet, "nseq": model.nseq, "eff_nseq": model.eff_nseq, "checksum": model.checksum, "stats": model.stats, "cutoffs": {k: list(v) for k, v in model.cutoffs.items()}, "nodes": nodes}


def from_record(row) -> Model:
    """The model of such a row."""
    nodes = sorted(row["nodes"], key=lambda x: x["k"])
    stack = lambda name: np.array([x[name] for x in nodes])
    line = lambda name: None if any(x[name] is None for x in nodes[1:]) else [x[name] for x in nodes[1:]]
    text = lambda name: None if line(name) is None else "".join(line(name))
    return Model(row["name"], stack("mat"), stack("t"), stack("ins"), row["alphabet"], row["acc"], row["descr"], row["nseq"], row["eff_nseq"], row["max_length"], line("map"), text("consensus"), text("rf"), text("mm"), text("cs"), row["checksum"], dict(row["stats"] or {}), {k: tuple(v) for k, v in (row["cutoffs"] or {}).items()})


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """A row per model of text files in any store; files are split between models."""
    text = spark.read.option("lineSep", "\n//").text(path).select(F.regexp_replace("value", r"^\s+", "").alias("value")).where("value <> ''")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([record(parse(t)) for t in pdf.value])

    return text.mapInPandas(run, SCHEMA)


def fetch(models: DataFrame, *keys: str) -> DataFrame:
    """Models by name or accession."""
    return models.where(F.col("name").isin(*keys) | F.col("acc").isin(*keys))


def press(models: DataFrame, path: str) -> None:
    """Models as Parquet, by alphabet: what a search reads instead of text."""
    models.write.partitionBy("alphabet").parquet(path)
