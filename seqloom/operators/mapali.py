"""Alignments onto a model: the one it came from, laid out again, alone or together with new sequences; and what aligned residues are worth.

A row of the given alignment is already aligned: its columns that the model's map names are nodes, what stands between is inserted.
Rows and new sequences are taken apart in the same way (build.PARTS), each by itself, in tasks; what they must agree on is the
width of each insert, one number a node, which build.rows_of sums up before it lays rows out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.alphabet import digitize
from seqloom.operators import build as B
from seqloom.operators import kernels as K
from seqloom.operators.profile import Model, configure, relative_entropy


def row_parts(aseq: str, columns: list[int], doctored: bool = False) -> tuple[list[str], list[str], list[str], list[str]]:
    """(match, post, inserts, marks) of an aligned row, as build.aligned_parts gives for a sequence; columns, from 1, are the nodes 1, 2, ...

    doctored: as a model is built from it, an insertion beside a deletion becomes a match.
    """
    m = len(columns)
    match, inserts = ["-"] * (m + 1), [""] * (m + 1)
    node_of = dict(zip(columns, range(1, m + 1), strict=True))
    node, path = 0, []
    for column, c in enumerate(aseq, 1):
        if column in node_of:
            node = node_of[column]
            path.append(("M" if c.isalpha() else "D", node, column))
        elif c.isalpha():
            path.append(("I", node, column))
    for state, k, column in B.without_delete_insert(path) if doctored else path:
        c = aseq[column - 1]
        if state == "M":
            match[k] = c.upper()
        elif state == "I":
            inserts[k] += c.lower()
    return match, ["."] * (m + 1), inserts, ["." * len(x) for x in inserts]


def parts_of(rows: DataFrame, columns: list[int], doctored: bool = False) -> DataFrame:
    """rows(name, aseq) of an alignment as build.PARTS; null rows are rows of gaps. Rows must reach to the last column."""
    last = max(columns, default=0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, aseq in zip(pdf.name, pdf.aseq, strict=True):
                if aseq and len(aseq) < last:
                    raise ValueError(f"{name} has {len(aseq)} columns, the model's map names column {last}")
                out.append((name, *row_parts(aseq or "", columns, doctored)))
            yield pd.DataFrame(out, columns=["name", "match", "post", "inserts", "marks"])

    return rows.select("name", "aseq").mapInPandas(run, B.PARTS)


def realigned(rows: DataFrame, columns: list[int], doctored: bool = False) -> DataFrame:
    """(name, aseq, pp): an alignment laid out by its match columns, inserts in lower case and no wider than a row needs; doctored, what a model is built from."""
    return B.rows_of(parts_of(rows, columns, doctored), len(columns))


def with_alignment(sequences: DataFrame, model: Model, rows: DataFrame) -> DataFrame:
    """(name, aseq, pp): new sequences(name, seq) in one alignment with the one that the model came from, rows(row_idx, name, aseq).

    Residues of the given rows stay where they are: nodes are the columns that the model's map names. A model without a map
    or checksum, or one whose checksum is not that of the rows in their order, is refused. Posteriors of given rows are unknown: dots.
    """
    if model.map is None or model.checksum is None:
        raise ValueError(f"{model.name} has no map of its alignment's columns, or no checksum")
    if B.chained_checksum(rows) != model.checksum:
        raise ValueError(f"these rows are not those that {model.name} came from")

    return B.rows_of(parts_of(rows, list(model.map)).unionByName(B.parts_of(sequences, model)), model.m)


# what aligned residues are worth
def decoded_posterior(code: Column) -> Column:
    """The probability that a posterior's code stands for: * for 1, a digit for its tenth, 0 for a little more than nothing, a dot for none."""
    return F.when(code == "*", 1.0).when(code == "0", 0.01).when(code.rlike("^[1-9]$"), code.try_cast("double") / 10.0).otherwise(0.0)


def posterior_line(aligned: DataFrame) -> DataFrame:
    """(apos, posterior, code) of each column of rows(name, aseq, pp): the mean over rows that have a residue and a code there, and its code; a dot without any."""
    letters, codes = F.split("aseq", ""), F.split("pp", "")
    cells = aligned.select(F.posexplode(F.arrays_zip(letters.alias("c"), codes.alias("p")))).where("col.c <> ''").select((F.col("pos") + 1).alias("apos"), "col.c", "col.p")
    known = F.col("c").rlike("[A-Za-z]") & (F.col("p") != ".")
    mean = F.avg(F.when(known, decoded_posterior(F.col("p"))))
    out = cells.groupBy("apos").agg(mean.alias("posterior"))
    digit = F.floor(F.round((F.col("posterior") + 0.05) * 10, 9)).cast("int").cast("string")
    return out.select("apos", "posterior", F.when(F.col("posterior").isNull(), ".").when(F.col("posterior") + 0.05 >= 1, "*").otherwise(digit).alias("code"))


def residue_statistics(sequences: DataFrame, model: Model) -> DataFrame:
    """(name, pos, node, matched, posterior, relent, bits) of every residue of sequences(name, seq) that is aligned to a node.

    On the path of the best expected accuracy: matched residues have the node's relative entropy and their own log-odds in bits,
    inserted ones neither. A residue that the alphabet doesn't know has the node's expectation over the background.
    """
    p, f = configure(model, multihit=False), model.bg
    relent, bits = np.append(0.0, relative_entropy(model.mat, f)), p.msc / np.log(2)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            names = [(n, digitize(s, model.alphabet)) for n, s in zip(pdf.name, pdf.seq, strict=True) if s]
            rows = []
            for (name, codes), post in zip(names, K.decoded(p, [c for _, c in names], full=True), strict=True):
                for state, k, i, q in K.optimal_accuracy(p, post)[1]:
                    if state == "M":
                        rows.append((name, i, k, True, float(q), float(relent[k]), float(bits[codes[i - 1], k])))
                    elif state == "I":
                        rows.append((name, i, k, False, float(q), None, None))
            yield pd.DataFrame(rows, columns=["name", "pos", "node", "matched", "posterior", "relent", "bits"])

    return sequences.select("name", "seq").mapInPandas(run, f"name {sequences.schema['name'].dataType.simpleString()}, pos int, node int, matched boolean, posterior double, relent double, bits double")
