"""Rows of alignments by identity: links, single-linkage clusters, and splits of a family into training and test rows.

Rows are (msa_id, row_idx, aseq). Equal rows are one row with a number from the start, so pairs are formed among
distinct rows of an alignment alone, block by block; identity() says the same as a Column over two rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.session import cut


def _letters(aseq: Column) -> Column:
    return F.length(F.regexp_replace(aseq, "[^A-Za-z]", ""))


def identity(a: Column, b: Column) -> Column:
    """Equal residues of two aligned rows over the residues of the shorter one; 0 where one has none."""
    same = F.zip_with(F.split(F.upper(a), ""), F.split(F.upper(b), ""), lambda x, y: ((x == y) & x.rlike("^[A-Z]$")).cast("int"))
    shorter = F.least(_letters(a), _letters(b))
    return F.when(shorter > 0, F.aggregate(same, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0))) / shorter).otherwise(0.0)


def distinct_rows(rows: DataFrame) -> DataFrame:
    """(msa_id, aseq, rep, n): equal rows as one, named by the smallest row_idx."""
    return rows.groupBy("msa_id", "aseq").agg(F.min("row_idx").alias("rep"), F.count("*").alias("n"))


#: Distinct rows of an alignment in a block.
BLOCK = 1024


def _coded(rows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Residues as numbers above zero, zero for what is none, and the number of residues of each row."""
    width = max(map(len, rows), default=0)
    text = np.array([r.upper().ljust(width, "-") for r in rows], f"U{max(1, width)}")
    code = text.view(np.uint32).reshape(len(rows), -1)
    code = np.where((code >= ord("A")) & (code <= ord("Z")), code, 0).astype(np.uint8)
    return code, (code > 0).sum(1)


def identity_links(rows: DataFrame, least: float) -> DataFrame:
    """(msa_id, a, b, pid) of distinct rows a < b of an alignment with at least an identity.

    Rows are dealt to blocks by hash, as many as an alignment's number of rows fills; each two blocks of an alignment meet in a row of
    their own, whatever the size of the alignment, and are compared as arrays. At the identities that are asked for, rows need
    not share any stretch, so all pairs are looked at; links alone are given. Null rows have none.
    """
    d = distinct_rows(rows.where("aseq is not null"))
    sizes = d.groupBy("msa_id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    packed = cut(d.join(sizes, "msa_id").groupBy("msa_id", F.pmod(F.xxhash64("aseq"), F.col("blocks")).cast("int").alias("block")).agg(F.collect_list("rep").alias("reps"), F.collect_list("aseq").alias("seqs")))
    first = sizes.select("msa_id", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x"))
    meet = first.select("msa_id", "x", F.explode(F.sequence(F.col("x"), F.col("blocks") - 1)).alias("y"))
    one, two = (packed.select("msa_id", F.col("block").alias(n), F.col("reps").alias(f"{n}_reps"), F.col("seqs").alias(f"{n}_seqs")) for n in "xy")
    met = meet.join(one, ["msa_id", "x"]).join(two, ["msa_id", "y"])
    kind, key = rows.schema["msa_id"].dataType.simpleString(), rows.schema["row_idx"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for msa, x, y, a_reps, a_seqs, b_reps, b_seqs in pdf.itertuples(index=False):
                (codes, lengths) = _coded([*a_seqs, *b_seqs])
                n, out = len(a_seqs), []
                for i in range(n):
                    low = i + 1 + n if x == y else n  # a block with itself: later rows alone
                    same = ((codes[low:] == codes[i]) & (codes[i] > 0)).sum(1)
                    shorter = np.minimum(lengths[low:], lengths[i])
                    pid = np.divide(same, shorter, out=np.zeros(len(same)), where=shorter > 0)
                    out += [(msa, *sorted((a_reps[i], b_reps[low - n + j])), float(pid[j])) for j in np.flatnonzero(pid >= least).tolist()]
                yield pd.DataFrame(out, columns=["msa_id", "a", "b", "pid"])

    return met.select("msa_id", "x", "y", "x_reps", "x_seqs", "y_reps", "y_seqs").mapInPandas(run, f"msa_id {kind}, a {key}, b {key}, pid double")


def linked_sets(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """(msa_id, v, root): for each vertex(msa_id, v) the smallest one that links(msa_id, a, b) lead to.

    Every round takes the smallest label of all neighbours, then the label of that label, so that paths halve.
    """
    both = cut(links.select("msa_id", "a", "b").union(links.select("msa_id", F.col("b").alias("a"), F.col("a").alias("b"))))
    label = cut(vertices.select("msa_id", "v", F.col("v").alias("root")))
    while True:
        other = label.select("msa_id", F.col("v").alias("b"), F.col("root").alias("near"))
        least = both.join(other, ["msa_id", "b"]).groupBy("msa_id", F.col("a").alias("v")).agg(F.min("near").alias("near"))
        low = cut(label.join(least, ["msa_id", "v"], "left").select("msa_id", "v", F.least("root", "near").alias("root"), F.col("root").alias("before")))
        jump = low.select("msa_id", F.col("v").alias("root"), F.col("root").alias("far"))
        following = cut(low.join(jump, ["msa_id", "root"]).select("msa_id", "v", F.col("far").alias("root"), "before"))
        if following.where("root <> before").isEmpty():
            return following.select("msa_id", "v", "root")
        label = following.drop("before")


def single_linkage(rows: DataFrame, least: float) -> DataFrame:
    """(msa_id, row_idx, cluster) of every row; a cluster is named by its smallest row."""
    d = distinct_rows(rows)
    label = linked_sets(d.select("msa_id", F.col("rep").alias("v")), identity_links(rows, least))
    named = d.join(label.withColumnRenamed("v", "rep"), ["msa_id", "rep"]).select("msa_id", "aseq", F.col("root").alias("cluster"))
    return rows.join(named, ["msa_id", "aseq"]).select("msa_id", "row_idx", "cluster")


def effective_number(rows: DataFrame, least: float = 0.62) -> DataFrame:
    """(msa_id, eff_nseq): the number of single-linkage clusters."""
    return single_linkage(rows, least).groupBy("msa_id").agg(F.count_distinct("cluster").cast("double").alias("eff_nseq"))


def without_fragments(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows whose residues span more than a share of the alignment's columns."""
    span = F.length(F.regexp_replace("aseq", "^[^A-Za-z]+|[^A-Za-z]+$", ""))
    return rows.where(span > F.lit(threshold) * F.length("aseq"))


def split_by_cluster(rows: DataFrame, least: float) -> DataFrame:
    """(msa_id, row_idx, part): the largest cluster trains, the one of the smallest name among equals; all others test."""
    c = single_linkage(rows, least)
    sizes = c.groupBy("msa_id", "cluster").agg(F.count("*").alias("n"))
    best = sizes.groupBy("msa_id").agg(F.max(F.struct("n", (-F.col("cluster")).alias("c"))).alias("x")).select("msa_id", (-F.col("x.c")).alias("train"))
    return c.join(best, "msa_id").select("msa_id", "row_idx", F.when(F.col("cluster") == F.col("train"), "train").otherwise("test").alias("part"))


def drawn(key: Column, seed: int) -> Column:
    """A reproducible random order of keys."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def filtered_by_cluster(rows: DataFrame, least: float, seed: int = 42) -> DataFrame:
    """(msa_id, row_idx): one row of each cluster, drawn at random."""
    pick = F.min(F.struct(drawn(F.col("row_idx"), seed).alias("d"), "row_idx"))
    return single_linkage(rows, least).groupBy("msa_id", "cluster").agg(pick.alias("x")).select("msa_id", "x.row_idx")


def independent_set(rows: DataFrame, least: float, seed: int = 42) -> DataFrame:
    """(msa_id, row_idx): a largest set without links that a greedy walk in random order finds, among distinct rows.

    All rows that come before their undecided neighbours are taken at once and their neighbours leave, round by round:
    that is the walk's result, in as many rounds as its longest chain of decisions.
    """
    d = distinct_rows(rows)
    left = cut(d.select("msa_id", F.col("rep").alias("v"), drawn(F.col("rep"), seed).alias("d")))
    links = identity_links(rows, least).select("msa_id", "a", "b")
    both = cut(links.union(links.select("msa_id", F.col("b").alias("a"), F.col("a").alias("b"))))
    taken = None
    while not left.isEmpty():
        a, b = (left.select("msa_id", F.col("v").alias(n), F.col("d").alias(f"{n}d")) for n in ("a", "b"))
        near = cut(both.join(a, ["msa_id", "a"]).join(b, ["msa_id", "b"]))
        first = cut(left.join(near.where("bd < ad").select("msa_id", F.col("a").alias("v")), ["msa_id", "v"], "left_anti").select("msa_id", "v"))
        gone = near.join(first.withColumnRenamed("v", "b"), ["msa_id", "b"], "left_semi").select("msa_id", F.col("a").alias("v"))
        left = cut(left.join(first.union(gone), ["msa_id", "v"], "left_anti"))
        taken = first if taken is None else taken.union(first)
    return (taken if taken is not None else left.select("msa_id", "v")).select("msa_id", F.col("v").alias("row_idx"))


def split_violations(rows: DataFrame, split: DataFrame, least: float) -> DataFrame:
    """(msa_id, violations): linked pairs of a training and a test row, 0 for a valid split."""
    parts = distinct_rows(rows).select("msa_id", F.col("rep").alias("row_idx")).join(split, ["msa_id", "row_idx"])
    a, b = (parts.select("msa_id", F.col("row_idx").alias(n), F.col("part").alias(f"{n}_part")) for n in ("a", "b"))
    across = identity_links(rows, least).join(a, ["msa_id", "a"]).join(b, ["msa_id", "b"]).where("a_part <> b_part")
    counts = across.groupBy("msa_id").agg(F.count("*").alias("n"))
    return split.select("msa_id").distinct().join(counts, "msa_id", "left").select("msa_id", F.coalesce("n", F.lit(0)).alias("violations"))


# sequences for benchmarks
def shuffled(seq: Column, key: Column) -> Column:
    """The letters of a sequence in a reproducible random order that its key draws."""
    order = F.array_sort(F.transform(F.sequence(F.lit(1), F.length(seq)), lambda i: F.struct(F.md5(F.concat_ws(":", key.cast("string"), i.cast("string"))).alias("d"), i.alias("i"))))
    return F.when(F.length(seq) > 0, F.array_join(F.transform(order, lambda x: F.substring(seq, x["i"], F.lit(1))), "")).otherwise("")


def positives(domains: DataFrame, flanks: DataFrame, flank: int) -> DataFrame:
    """(name, seq, start, end): each domain(query, n, seq) between shuffled segments of the flank sequence(n, source) of its number."""
    left = shuffled(F.substring("source", 1, flank), F.concat(F.lit("left"), "n"))
    right = shuffled(F.substring("source", flank + 1, flank), F.concat(F.lit("right"), "n"))
    out = domains.join(flanks, "n").select(F.concat("query", F.lit("/"), "n").alias("name"), left.alias("l"), "seq", right.alias("r"))
    return out.select("name", F.concat("l", "seq", "r").alias("seq"), (F.length("l") + 1).alias("start"), (F.length("l") + F.length("seq")).alias("end"))


def negatives(flanks: DataFrame) -> DataFrame:
    """(name, seq): shuffled sequences of sources(n, source)."""
    return flanks.select(F.concat(F.lit("decoy"), "n").alias("name"), shuffled(F.col("source"), F.concat(F.lit("decoy"), "n")).alias("seq"))


def classified(query: Column, target: Column) -> Column:
    """1 where a target was made from the query (its name, a slash, more), -1 for a decoy, 0 for what doesn't count."""
    return F.when(F.startswith(target, F.concat(query, F.lit("/"))), 1).when(F.startswith(target, F.lit("decoy")), -1).otherwise(0)


def in_ranges(df: DataFrame, keys: list[str], buckets: int | None = None) -> DataFrame:
    """df with `bucket`: ranges of keys of about as many rows each, whatever the keys' scale, ties included if the keys tell rows apart; as many as shuffles have partitions, if not told otherwise.

    Spark cuts ranges at quantiles of a sample; rows are kept as they were dealt, as a sample drawn again might cut elsewhere.
    """
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(buckets, *keys).withColumn("bucket", F.spark_partition_id()))


def numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """df with each row's place, from 0, in the order of keys that tell rows apart."""
    cut_ = in_ranges(df, keys)
    sums = cut_.groupBy("bucket").agg(F.count("*").alias("s"))
    before = sums.select("bucket", (F.sum("s").over(Window.orderBy("bucket")) - F.col("s")).alias("base"))  # a row per range
    inner = F.row_number().over(Window.partitionBy("bucket").orderBy(*keys))
    return cut_.withColumn("inner", inner).join(F.broadcast(before), "bucket").withColumn(name, F.col("base") + F.col("inner") - 1).drop("bucket", "base", "inner")


def roc_curve(results: DataFrame, steps: int = 3, buckets: int | None = None) -> DataFrame:
    """(x, false_per_query, true_positives): positives ranked before more than 10^(x / steps) decoys a query, for results(id, query, target, evalue).

    Ranks need a total order: results are cut into ranges of E-values and ids, decoys are counted by range and then within
    one. Ties are broken by id. The first point holds all that comes before the first decoy.
    """
    r = results.withColumn("class", classified(F.col("query"), F.col("target"))).where(F.col("class") != 0)
    cut_ = in_ranges(r, ["evalue", "id"], buckets)
    queries = cut_.agg(F.count_distinct("query").alias("nq"))
    decoy = (F.col("class") == -1).cast("bigint")
    sums = cut_.groupBy("bucket").agg(F.sum(decoy).alias("s"))
    before = sums.select("bucket", (F.sum("s").over(Window.orderBy("bucket")) - F.col("s")).alias("base"))  # a row per range
    inner = F.sum(decoy).over(Window.partitionBy("bucket").orderBy("evalue", "id"))
    ranked = cut_.withColumn("inner", inner).join(F.broadcast(before), "bucket").where("class = 1").withColumn("fp", F.col("base") + F.col("inner")).crossJoin(F.broadcast(queries))  # one row
    least = F.ceil(-F.log10(F.col("nq").cast("double")) * steps)  # where one decoy lies
    x = F.when(F.col("fp") == 0, least - 1).otherwise(F.ceil(F.round(F.log10(F.col("fp") / F.col("nq")) * steps, 9)))
    points = ranked.groupBy(x.alias("x")).agg(F.count("*").alias("n"))
    return points.select("x", F.round(F.pow(F.lit(10.0), F.col("x") / steps), 6).alias("false_per_query"), F.sum("n").over(Window.orderBy("x")).alias("true_positives"))  # a row per step of a decade


# intervals of ROC curves
def draws(name: str, samples: int, seed: int) -> np.ndarray:
    """A draw from the unit exponential for each sample: 32 bits of md5(seed:block:name) each, four to a block, so that a name draws the same wherever it is met."""
    data = b"".join(hashlib.md5(f"{seed}:{k}:{name}".encode()).digest() for k in range(-(-samples // 4)))
    return -np.log((np.frombuffer(data, ">u4")[:samples] + 0.5) / 2**32)


def summed(names: DataFrame, column: str, samples: int, seed: int) -> tuple[int, np.ndarray]:
    """(how many, sum of their draws by sample) of distinct names. Tasks sum their own; a row for each sample comes to the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(samples), 0
        for pdf in batches:
            for name in pdf.iloc[:, 0]:
                total += draws(name, samples, seed)
                n += 1
        yield pd.DataFrame({"b": np.arange(samples + 1), "s": np.append(total, n)})

    rows = names.select(F.col(column)).distinct().mapInPandas(run, "b int, s double").groupBy("b").agg(F.sum("s").alias("s")).collect()
    by = {r.b: r.s for r in rows}
    return int(by.get(samples, 0)), np.array([by.get(b, 0.0) for b in range(samples)])


def roc_intervals(results: DataFrame, samples: int = 500, interval: float = 0.95, steps: int = 3, top: float = 10.0, seed: int = 42, buckets: int | None = None) -> DataFrame:
    """(x, false_per_query, mean, lower, upper): shares of positives before more than 10^(x / steps) decoys a query, by Bayesian bootstrap.

    Each sample weighs queries and targets by Dirichlet draws; a result weighs as its query times its target, and a curve is
    made with these weights. results(id, query, target, evalue) are ranked by E-value and id, once for all samples: a task has a range
    of ranks, adds up decoys' weights of all samples side by side, and gives the positives' weights for each step. What comes to
    the driver is a number for each sample and range, and one for each sample and step. Positives are those among results;
    a curve without any gives no rows. A null E-value, query, target or id takes no part.
    """
    whole = results.where("id is not null and query is not null and target is not null and evalue is not null")
    r = whole.withColumn("class", classified(F.col("query"), F.col("target")))
    dealt = in_ranges(r.where(F.col("class") != 0).select("id", "query", "target", "evalue", "class"), ["evalue", "id"], buckets)
    (n_queries, query_sums), (n_targets, target_sums) = summed(dealt, "query", samples, seed), summed(dealt, "target", samples, seed)
    if not n_queries:
        return results.sparkSession.createDataFrame([], "x int, false_per_query double, mean double, lower double, upper double")
    base, last = int(np.floor(round(-np.log10(n_queries) * steps, 9))), int(np.ceil(round(np.log10(top) * steps, 9)))
    scale = n_targets / (query_sums * target_sums)  # of a decoy's weight in decoys a query

    def weights(pdf: pd.DataFrame, lo: int, known: dict) -> np.ndarray:
        rows = []
        for query, target in zip(pdf["query"].iloc[lo : lo + 512], pdf["target"].iloc[lo : lo + 512], strict=True):
            if query not in known:
                if len(known) * samples > 1 << 22:
                    known.clear()
                known[query] = draws(query, samples, seed)
            rows.append(known[query] * draws(target, samples, seed))
        return np.array(rows) * scale

    def decoys(pdf: pd.DataFrame) -> pd.DataFrame:
        bad, known = pdf[pdf["class"] == -1], {}
        total = np.zeros(samples)
        for lo in range(0, len(bad), 512):
            total += weights(bad, lo, known).sum(0)
        return pd.DataFrame({"bucket": [pdf.bucket.iat[0]], "s": [total]})

    sums = {x.bucket: np.array(x.s) for x in dealt.groupBy("bucket").applyInPandas(decoys, "bucket int, s array<double>").collect()}
    before, total = {}, np.zeros(samples)
    for bucket in sorted(sums):
        before[bucket] = total
        total = total + sums[bucket]
    shared = results.sparkSession.sparkContext.broadcast(before)

    def positives_by_step(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, known = pdf.sort_values(["evalue", "id"], kind="stable"), {}
        false = shared.value[pdf.bucket.iat[0]].copy()
        out = np.zeros((last - base + 2, samples))
        for lo in range(0, len(pdf), 512):
            w = weights(pdf, lo, known)
            good = pdf["class"].iloc[lo : lo + 512].to_numpy() == 1
            passed = np.cumsum(np.where(good[:, None], 0, w), axis=0) + false
            with np.errstate(divide="ignore"):
                x = np.ceil(np.round(np.log10(passed[good]) * steps, 9))
            at = np.clip(np.nan_to_num(x, neginf=base), base, last + 1).astype(int) - base
            for b in range(samples):
                out[:, b] += np.bincount(at[:, b], w[good, b], minlength=len(out))
            false = passed[-1]
        return pd.DataFrame({"x": np.repeat(np.arange(base, last + 2), samples), "b": np.tile(np.arange(samples), last - base + 2), "tp": out.ravel()})

    points = dealt.groupBy("bucket").applyInPandas(positives_by_step, "x int, b int, tp double").groupBy("x", "b").agg(F.sum("tp").alias("tp"))
    share = F.try_divide(F.sum("tp").over(Window.partitionBy("b").orderBy("x")), F.sum("tp").over(Window.partitionBy("b")))
    tail = int(samples * (1 - interval) / 2 + 1e-9)
    curve = points.withColumn("share", share).where((F.col("x") <= last) & F.col("share").isNotNull()).groupBy("x").agg(F.avg("share").alias("mean"), F.array_sort(F.collect_list("share")).alias("all"))
    # a row for each step and sample
    return curve.select("x", F.round(F.pow(F.lit(10.0), F.col("x") / steps), 6).alias("false_per_query"), "mean", F.col("all")[tail].alias("lower"), F.col("all")[min(samples - 1, samples - tail)].alias("upper"))
