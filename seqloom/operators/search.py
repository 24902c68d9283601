"""Profile search: targets through a cascade of filters, domains, thresholds and ranked tables.

Models are broadcast, in groups whose bytes are bounded; targets stay where they are, so a search has no
shuffle before thresholds. One pass over a batch of targets gives, for each model, the counters of each
filter and the hits that passed; thresholds need the number of targets and of reported targets, so they
follow as aggregations over the hits, which are few.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions import scores as S
from seqloom.functions.alphabet import digitize
from seqloom.operators import kernels as K
from seqloom.operators.ensemble import envelopes_many
from seqloom.operators.profile import Model, composition, configure, relative_entropy
from seqloom.session import cut

LN2 = float(np.log(2))
#: Bytes of models broadcast at once; more models are searched in further passes.
MODEL_BYTES = 64 << 20
#: Cells of a batch in a kernel: targets are grouped by length so that a batch stays under this.
BATCH_CELLS = 1 << 19
#: The same for kernels of a cascade, which keep a row of nodes for a target and no more: what a batch costs goes with its longest target.
CASCADE_CELLS = 1 << 22


@dataclass(frozen=True)
class Config:
    """Thresholds of filters, reporting and inclusion. z and dom_z replace the counts of targets."""

    f1: float = S.F1
    f2: float = S.F2
    f3: float = S.F3
    bias: bool = True
    null2: bool = True
    e: float = S.E_REPORT
    t: float | None = None
    dom_e: float = S.E_REPORT
    dom_t: float | None = None
    inc_e: float = S.E_INCLUDE
    inc_t: float | None = None
    inc_dom_e: float = S.E_INCLUDE
    inc_dom_t: float | None = None
    z: float | None = None
    dom_z: float | None = None
    seed: int = 42

    def maximal(self) -> Config:
        """Without filters."""
        return replace(self, f1=1.0, f2=1.0, f3=1.0, bias=False)

    def cutoffs(self, model: Model, kind: str) -> Config:
        """With a model's own bit-score cutoffs: ga, tc or nc."""
        if kind not in model.cutoffs:
            raise ValueError(f"{model.name} has no {kind.upper()} cutoffs")
        seq, dom = model.cutoffs[kind]
        return replace(self, t=seq, inc_t=seq, dom_t=dom, inc_dom_t=dom)


def calibrated(model: Model, seed: int = 42, n: int = 200, stages: tuple[str, ...] = ("msv", "vit", "fwd")) -> Model:
    """The model with location and slope of each stage's scores, fitted to scores of random sequences."""
    wanted = {"msv": "msv_mu", "vit": "vit_mu", "fwd": "fwd_tau"}
    if {wanted[s] for s in stages} <= model.stats.keys():
        return model
    f, rng = model.bg, np.random.default_rng(seed)
    p = configure(model)
    lam = LN2 + 1.44 / (model.m * max(1e-6, float(relative_entropy(model.mat, f).mean())))
    draw = lambda length: K.batch(list(rng.choice(len(f), (n, length), p=f)))
    null = lambda length: length * np.log(length / (length + 1)) + np.log(1 / (length + 1))
    mu = lambda x: float(-np.log(np.mean(np.exp(-lam * x))) / lam)
    x, lengths = draw(200)
    stats = dict(model.stats)
    for stage, kernel in (("msv", K.msv), ("vit", K.viterbi_int)):
        if stage in stages:
            stats |= {f"{stage}_mu": mu((np.minimum(kernel(p, x, lengths), 1e3) - null(200)) / LN2), f"{stage}_lambda": lam}
    if "fwd" in stages:
        x, lengths = draw(100)
        gmu, glam = fit_gumbel((K.forward(p, x, lengths) - null(100)) / LN2)
        stats |= {"fwd_tau": float(gmu - np.log(-np.log1p(-0.04)) / glam + np.log(0.04) / lam), "fwd_lambda": lam}
    return replace(model, stats=stats)


def calibrated_all(spark, models: list[Model], seed: int = 42, stages: tuple[str, ...] = ("msv", "vit", "fwd"), alone: int = 4) -> list[Model]:
    """The models, each calibrated; more than a few are simulated in tasks."""
    wanted = {"msv": "msv_mu", "vit": "vit_mu", "fwd": "fwd_tau"}
    todo = [k for k, m in enumerate(models) if not {wanted[s] for s in stages} <= m.stats.keys()]
    if len(todo) <= alone:
        return [calibrated(m, seed, stages=stages) for m in models]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"k": pdf.k, "stats": [calibrated(pickle.loads(m), seed, stages=stages).stats for m in pdf.model]})

    rows = spark.createDataFrame([(k, pickle.dumps(models[k])) for k in todo], "k int, model binary")
    parts = rows.repartition(min(len(todo), 4 * spark.sparkContext.defaultParallelism), "k")
    stats = {r.k: r.stats for r in parts.mapInPandas(run, "k int, stats map<string,double>").collect()}  # three numbers a model
    return [replace(m, stats=stats[k]) if k in stats else m for k, m in enumerate(models)]


def fit_gumbel(x: np.ndarray) -> tuple[float, float]:
    """Maximum-likelihood (mu, lambda) by Newton steps on lambda."""
    lam = np.pi / np.sqrt(6 * max(1e-9, x.var()))
    y = x - x.min()
    for _ in range(100):
        w = np.exp(-lam * y)
        a, b, c = w.sum(), (y * w).sum(), (y * y * w).sum()
        value, slope = 1 / lam - y.mean() + b / a, -1 / lam**2 + (b / a) ** 2 - c / a
        step = value / slope
        lam = max(lam / 2, lam - step)
        if abs(step) < 1e-9:
            break
    return float(x.min() - np.log(np.exp(-lam * y).mean()) / lam), float(lam)


DOMAIN = "struct<ienv:int,jenv:int,iali:int,jali:int,hmm_from:int,hmm_to:int,envsc:double,corr:double,oasc:double,bits:double,dombias:double,lnp:double,model:string,aseq:string,pp:string>"
RAW = f"model string, seq_id bigint, name string, kind string, n bigint, residues bigint, past_msv bigint, past_bias bigint, past_vit bigint, past_fwd bigint, len int, m int, msv_bits double, vit_bits double, pre_score double, score double, lnp double, nregions int, domains array<{DOMAIN}>"


def _aligned(seq: str, path: list, consensus: str) -> tuple[str, str, str]:
    """Model line, target line and posterior line of a domain's path."""
    top, bottom, pp = [], [], []
    for state, k, i, post in path:
        top.append("." if state == "I" else consensus[k - 1])
        bottom.append("-" if state == "D" else seq[i - 1].lower() if state == "I" else seq[i - 1].upper())
        pp.append("." if state == "D" else "*" if post + 0.05 >= 1 else str(int((post + 0.05) * 10)))
    return "".join(top), "".join(bottom), "".join(pp)


def spans_of(p, posts: list, codes: list[np.ndarray]) -> list[list[tuple[int, int]]]:
    """Envelopes of the domains of each of some targets. A region with several domains is divided by an ensemble of sampled paths."""
    found = [K.regions(post) for post in posts]
    several = [(t, i, j) for t, (post, some) in enumerate(zip(posts, found, strict=True)) for i, j in some if K.is_multidomain(post, i, j)]
    # parts of a target are scored with the whole one's length model
    divided = dict(zip(several, envelopes_many(p, [codes[t][i - 1 : j] for t, i, j in several], [len(codes[t]) for t, _, _ in several]), strict=True))
    return [[span for i, j in some for span in ([(a + i - 1, b + i - 1) for a, b in divided.get((t, i, j), ())] or [(i, j)])] for t, some in enumerate(found)]


def domain(uni, sub, seq: str, codes: np.ndarray, i: int, j: int, consensus: str, stats: dict, use_null2: bool = True) -> dict | None:
    """The domain in an envelope i..j of a target, from the decoding of that part; None if its best path has no node."""
    n, part = len(codes), codes[i - 1 : j]
    null = n * np.log(n / (n + 1)) + np.log(1 / (n + 1))
    flank = (n - (j - i + 1)) * np.log(n / (n + 3))
    oasc, path = K.optimal_accuracy(uni, sub)
    path = [(s, k, r + i - 1, q) for s, k, r, q in path if s in "MID"]
    while path and path[0][0] == "D":
        path.pop(0)
    while path and path[-1][0] == "D":
        path.pop()
    if not path:
        return None
    odds = K.null2(uni, sub, 1, len(part))
    corr = float(np.log(odds[part]).sum()) if use_null2 else 0.0
    dombias = float(np.logaddexp(0, np.log(S.OMEGA) + corr)) if use_null2 else 0.0
    bits = (sub.score + flank - (null + dombias)) / LN2
    lnp = min(0.0, -stats["fwd_lambda"] * (bits - stats["fwd_tau"]))
    top, bottom, pp = _aligned(seq, path, consensus)
    return {"ienv": i, "jenv": j, "iali": path[0][2], "jali": path[-1][2], "hmm_from": path[0][1], "hmm_to": path[-1][1], "envsc": sub.score, "corr": corr, "oasc": oasc, "bits": bits, "dombias": dombias, "lnp": lnp, "model": top, "aseq": bottom, "pp": pp}


def domains(p, seqs: list[str], codes: list[np.ndarray], consensus: str, stats: dict, use_null2: bool = True) -> list[tuple[int, list[dict]]]:
    """(envelopes, domains) of each of some targets: all are decoded at once, then all envelopes."""
    spans = spans_of(p, K.decoded(p, codes), codes)
    flat = [(t, i, j) for t, some in enumerate(spans) for i, j in some]
    uni = replace(p, multihit=False)
    found: list[list[dict]] = [[] for _ in codes]
    for lo in range(0, len(flat), 512):  # lattices are held for as many envelopes
        part = flat[lo : lo + 512]
        subs = K.decoded(uni, [codes[t][i - 1 : j] for t, i, j in part], [len(codes[t]) for t, _, _ in part], full=True)
        for (t, i, j), sub in zip(part, subs, strict=True):
            d = domain(uni, sub, seqs[t], codes[t], i, j, consensus, stats, use_null2)
            if d:
                found[t].append(d)
    return [(len(s), d) for s, d in zip(spans, found, strict=True)]


def cascade(model: Model, config: Config, ids: list, names: list, seqs: list[str], codes: list[np.ndarray] | None = None, msv: np.ndarray | None = None, copies: np.ndarray | None = None) -> pd.DataFrame:
    """Counters and hits of a batch of targets against one calibrated model; codes, scores of the first filter and numbers of copies, which counters count, may be given."""
    f, p, stats = model.bg, configure(model), model.stats
    compo = composition(model)
    codes = [digitize(s, model.alphabet) for s in seqs] if codes is None else codes
    lengths = np.array([len(c) for c in codes], np.int64)
    copies = np.ones(len(codes), np.int64) if copies is None else copies
    some = np.flatnonzero(lengths > 0)
    null = np.zeros(len(codes))
    null[some] = lengths[some] * np.log(lengths[some] / (lengths[some] + 1)) + np.log(1 / (lengths[some] + 1))
    filters = null.copy()

    def run(kernel, which: np.ndarray) -> np.ndarray:
        """kernel(codes, lengths) of some targets, in batches of like lengths."""
        out = np.full(len(codes), -np.inf)
        which = which[np.argsort(lengths[which], kind="stable")]
        at = 0
        while at < len(which):
            size = max(1, min(512, CASCADE_CELLS // (int(lengths[which[min(len(which) - 1, at + 511)]]) + model.m)))
            part = which[at : at + size]
            out[part] = kernel(*K.batch([codes[i] for i in part]))
            at += size
        return out

    gumbel = lambda x, mu, lam: -np.expm1(-np.exp(-lam * (x - mu)))
    msv = run(lambda x, n: K.msv(p, x, n), some) if msv is None else msv
    msv_bits = (msv - null) / LN2
    with np.errstate(over="ignore"):
        past = some[gumbel(msv_bits[some], stats["msv_mu"], stats["msv_lambda"]) <= config.f1]
        counts = {"past_msv": int(copies[past].sum())}
        if config.bias:
            filters[past] += run(lambda x, n: K.bias_nulls(f, compo, model.m, x, n), past)[past]
            past = past[gumbel((msv[past] - filters[past]) / LN2, stats["msv_mu"], stats["msv_lambda"]) <= config.f1]
        counts["past_bias"] = int(copies[past].sum())
        vit = np.full(len(codes), np.nan)
        sure = gumbel((msv[past] - filters[past]) / LN2, stats["msv_mu"], stats["msv_lambda"]) <= config.f2
        weak = past[~sure]
        if len(weak):
            vit[weak] = run(lambda x, n: K.viterbi_int(p, x, n), weak)[weak]
            passed = gumbel((vit[weak] - filters[weak]) / LN2, stats["vit_mu"], stats["vit_lambda"]) <= config.f2
            past = np.sort(np.concatenate([past[sure], weak[passed]]))
        counts["past_vit"] = int(copies[past].sum())
        fwd = run(lambda x, n: K.forward(p, x, n), past)
        tail = np.minimum(0, -stats["fwd_lambda"] * ((fwd[past] - filters[past]) / LN2 - stats["fwd_tau"]))
        past = past[np.exp(tail) <= config.f3]
    counts["past_fwd"] = int(copies[past].sum())
    rows = [{"model": model.name, "kind": "count", "n": int(copies.sum()), "residues": int((copies * lengths).sum()), **counts}]
    consensus = model.consensus or "x" * model.m
    for i, (count, doms) in zip(past, domains(p, [seqs[i] for i in past], [codes[i] for i in past], consensus, stats, config.null2), strict=True):
        if not doms:
            continue
        n = int(lengths[i])
        bias = float(np.logaddexp(0, np.log(S.OMEGA) + sum(d["corr"] for d in doms))) if config.null2 else 0.0
        pre, score = (fwd[i] - null[i]) / LN2, (fwd[i] - (null[i] + bias)) / LN2
        good = [d for d in doms if d["envsc"] - d["corr"] > 0]
        length = sum(d["jenv"] - d["ienv"] + 1 for d in good)
        if good:
            total = sum(d["envsc"] for d in good) + (n - length) * np.log(n / (n + 3))
            own = float(np.logaddexp(0, np.log(S.OMEGA) + sum(d["corr"] for d in good))) if config.null2 else 0.0
            if (total - (null[i] + own)) / LN2 > score:
                pre, score = (total - null[i]) / LN2, (total - (null[i] + own)) / LN2
        lnp = min(0.0, -stats["fwd_lambda"] * (score - stats["fwd_tau"]))
        rows.append({"model": model.name, "seq_id": ids[i], "name": names[i], "kind": "hit", "len": n, "m": model.m, "msv_bits": msv_bits[i], "vit_bits": (vit[i] - null[i]) / LN2, "pre_score": pre, "score": score, "lnp": lnp, "nregions": count, "domains": doms})
    out = pd.DataFrame([{c: row.get(c) for c in COLUMNS} for row in rows], columns=COLUMNS)
    objects = {c: "Int64" for c in WHOLE} | {c: object for c in ("name", "domains")}
    out = out.astype(objects)
    out[["name", "domains"]] = out[["name", "domains"]].where(out[["name", "domains"]].notna(), None)
    return out


COLUMNS = [c.split(" ")[0] for c in RAW.split(", ")]
WHOLE = [c.split(" ")[0] for c in RAW.split(", ") if c.endswith((" int", " bigint"))]


def balanced(df: DataFrame) -> DataFrame:
    """df dealt over at least two partitions a core: a file's rows may all lie in one of its splits, however many there are."""
    if df.isStreaming:
        return df
    return df.repartition(max(2 * df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()))


def grouped(models: list[Model]) -> list[list[Model]]:
    """models in groups of one alphabet and at most MODEL_BYTES, each broadcast at once."""
    groups: list[list[Model]] = [[]]
    size = 0
    for m in sorted(models, key=lambda m: m.alphabet):
        own = m.mat.nbytes * 3 + m.t.nbytes * 2
        if groups[-1] and (size + own > MODEL_BYTES or groups[-1][0].alphabet != m.alphabet):
            groups.append([])
            size = 0
        groups[-1].append(m)
        size += own
    return groups


def raw_hits(sequences: DataFrame, models: list[Model], config: Config) -> DataFrame:
    """sequences(seq_id, name, seq) against every model: rows of kind count and hit."""
    out = None
    for group in grouped(calibrated_all(sequences.sparkSession, models, config.seed)):
        shared = sequences.sparkSession.sparkContext.broadcast(group)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            models = shared.value
            profiles = [configure(m) for m in models]
            for pdf in batches:
                which, seqs = pd.factorize(pdf.seq.fillna(""))  # equal targets of a batch are searched once
                seqs = list(seqs)
                codes = [digitize(s, models[0].alphabet) for s in seqs]
                scores = K.msv_many(profiles, codes)
                copies = np.bincount(which, minlength=len(seqs))
                for k, model in enumerate(models):
                    found = cascade(model, config, list(range(len(seqs))), [None] * len(seqs), seqs, codes, scores[:, k], copies)
                    yield for_copies(found, which, copies, pdf.seq_id.to_numpy(), pdf.name.to_numpy())

        part = balanced(sequences.select("seq_id", "name", "seq")).mapInPandas(run, RAW)
        out = part if out is None else out.unionByName(part)
    return out


def for_copies(found: pd.DataFrame, which: np.ndarray, copies: np.ndarray, ids: np.ndarray, names: np.ndarray) -> pd.DataFrame:
    """A cascade's rows over distinct sequences, each hit given to all targets that have its sequence; which has the sequence of each target."""
    hit = (found.kind == "hit").to_numpy()
    own = found.seq_id[hit].to_numpy(np.int64)
    many = copies[own]
    order, starts = np.argsort(which, kind="stable"), np.cumsum(copies) - copies
    target = order[np.repeat(starts[own], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
    out = found.take(np.repeat(np.flatnonzero(hit), many))
    out["seq_id"], out["name"] = pd.array(ids[target], "Int64"), names[target]
    return pd.concat([found[~hit], out], ignore_index=True) if len(out) else found[~hit]


def counters(raw: DataFrame) -> DataFrame:
    """Targets, residues and passes of each filter, per model."""
    names = ["n", "residues", "past_msv", "past_bias", "past_vit", "past_fwd"]
    return raw.where("kind = 'count'").groupBy("model").agg(*[F.sum(c).alias(c) for c in names])


def thresholded(raw: DataFrame, config: Config, by_model: bool = True) -> DataFrame:
    """Hits with E-values, reported and included, best domain first; domains with their own.

    Z is the number of targets (per model), domZ that of reported targets.
    """
    hits = raw.where("kind = 'hit'").drop("kind", "n", "residues", "past_msv", "past_bias", "past_vit", "past_fwd")
    z = raw.where("kind = 'count'").groupBy("model").agg(F.sum("n").alias("z"))
    hits = hits.join(F.broadcast(z), "model")  # a row per model
    if config.z is not None:
        hits = hits.withColumn("z", F.lit(float(config.z)))
    hits = hits.withColumn("evalue", F.exp("lnp") * F.col("z"))
    passes = lambda e, t, score, value: F.col(score) >= t if t is not None else F.col(value) <= e
    hits = hits.withColumn("reported", passes(config.e, config.t, "score", "evalue"))
    hits = hits.withColumn("included", F.col("reported") & passes(config.inc_e, config.inc_t, "score", "evalue"))
    dz = F.lit(float(config.dom_z)) if config.dom_z is not None else F.sum(F.col("reported").cast("double")).over(Window.partitionBy("model"))
    hits = hits.withColumn("dom_z", dz)

    def marked(d):
        c, i = F.exp(d["lnp"]) * F.col("dom_z"), F.exp(d["lnp"]) * F.col("z")
        rep = F.col("reported") & ((d["bits"] >= config.dom_t) if config.dom_t is not None else (c <= config.dom_e))
        inc = rep & F.col("included") & ((d["bits"] >= config.inc_dom_t) if config.inc_dom_t is not None else (c <= config.inc_dom_e))
        return d.withField("c_evalue", c).withField("i_evalue", i).withField("reported", rep).withField("included", inc)

    hits = hits.withColumn("domains", F.transform("domains", marked))
    best = F.array_max(F.transform("domains", lambda d: F.struct(d["bits"].alias("bits"), (-d["iali"]).alias("at"), d["i_evalue"].alias("i_evalue"), (d["dombias"] / LN2).alias("bias"))))
    return hits.withColumn("best", best)


def ranked(hits: DataFrame) -> DataFrame:
    """Reported hits in rank order: best P-value first, then name and id."""
    order = Window.partitionBy("model").orderBy(F.col("lnp"), F.col("score").desc(), "name", "seq_id")
    return hits.where("reported").withColumn("rank", F.row_number().over(order))


def tblout(hits: DataFrame) -> DataFrame:
    """One row per reported target."""
    doms = F.size("domains")
    return ranked(hits).select(
        F.col("name").alias("target_name"), F.col("model").alias("query_name"), F.col("evalue").alias("full_evalue"), F.col("score").alias("full_score"), (F.col("pre_score") - F.col("score")).alias("full_bias"),
        F.col("best.i_evalue").alias("dom_evalue"), F.col("best.bits").alias("dom_score"), F.col("best.bias").alias("dom_bias"), F.col("nregions").alias("reg"), doms.alias("dom"),
        F.size(F.filter("domains", lambda d: d["reported"])).alias("rep"), F.size(F.filter("domains", lambda d: d["included"])).alias("inc"), "rank",
    )


def domtblout(hits: DataFrame) -> DataFrame:
    """One row per reported domain; acc is the mean posterior of its aligned residues."""
    rows = ranked(hits).withColumn("d", F.explode(F.filter("domains", lambda d: d["reported"])))
    number = F.row_number().over(Window.partitionBy("model", "seq_id").orderBy("d.iali", "d.ienv"))
    return rows.select(
        F.col("name").alias("target_name"), "seq_id", F.col("len").alias("tlen"), F.col("model").alias("query_name"), F.col("m").alias("qlen"), F.col("evalue").alias("full_evalue"), F.col("score").alias("full_score"),
        number.alias("dom_no"), F.size(F.filter("domains", lambda d: d["reported"])).alias("dom_of"), F.col("d.c_evalue").alias("c_evalue"), F.col("d.i_evalue").alias("i_evalue"), F.col("d.bits").alias("dom_score"),
        (F.col("d.dombias") / LN2).alias("dom_bias"), "d.hmm_from", "d.hmm_to", F.col("d.iali").alias("ali_from"), F.col("d.jali").alias("ali_to"), F.col("d.ienv").alias("env_from"), F.col("d.jenv").alias("env_to"),
        (F.col("d.oasc") / (1 + F.abs(F.col("d.jenv") - F.col("d.ienv")))).alias("acc"), F.col("d.model").alias("hmm_line"), F.col("d.aseq").alias("ali_line"), F.col("d.pp").alias("pp_line"),
    )


def msv_search(sequences: DataFrame, models: list[Model], config: Config | None = None) -> DataFrame:
    """Targets of each model ranked by the ungapped filter alone: model, seq_id, name, len, bits, p, evalue, rank.

    The kernel sees batches of targets; scores, P- and E-values are Column expressions.
    """
    config = config or Config()
    some = sequences.where("seq is not null and seq <> ''").select("seq_id", "name", "seq")
    z = float(config.z) if config.z is not None else float(some.count())
    scored = None
    for group in grouped(calibrated_all(sequences.sparkSession, models, config.seed, ("msv",))):
        shared = sequences.sparkSession.sparkContext.broadcast(group)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            models = shared.value
            profiles = [configure(m) for m in models]
            mu, lam = (np.array([m.stats[c] for m in models]) for c in ("msv_mu", "msv_lambda"))
            names = np.array([m.name for m in models], object)
            for pdf in batches:
                codes = [digitize(s, models[0].alphabet) for s in pdf.seq]
                lengths = np.array([len(c) for c in codes])
                nats = K.msv_many(profiles, codes)
                # pairs that no count of targets can bring under the threshold stay where they are
                with np.errstate(over="ignore"):
                    p = -np.expm1(-np.exp(-lam * ((nats - (lengths * np.log(lengths / (lengths + 1)) + np.log(1 / (lengths + 1)))[:, None]) / LN2 - mu)))
                i, k = np.nonzero(p * z <= config.e * (1 + 1e-9))
                yield pd.DataFrame({"model": names[k], "mu": mu[k], "lambda": lam[k], "seq_id": pdf.seq_id.to_numpy()[i], "name": pdf.name.to_numpy()[i], "len": lengths[i], "nats": nats[i, k]})

        part = balanced(some).mapInPandas(run, "model string, mu double, lambda double, seq_id bigint, name string, len int, nats double")
        scored = part if scored is None else scored.unionByName(part)
    scored = scored.withColumn("bits", S.bits(F.col("nats"), S.null1(F.col("len"))))
    scored = scored.withColumn("p", S.gumbel_p(F.col("bits"), F.col("mu"), F.col("lambda")))
    hits = scored.withColumn("evalue", F.col("p") * F.lit(z)).where(F.col("evalue") <= config.e)
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("model").orderBy("p", F.col("bits").desc(), "seq_id"))).drop("nats", "mu", "lambda")  # hits are few: thresholds bound them


def search(sequences: DataFrame, models: list[Model], config: Config | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits with thresholds, counters) of every model against every sequence; computed once and kept in the checkpoint folder."""
    config = config or Config()
    raw = cut(raw_hits(sequences, models, config))
    return thresholded(raw, config), counters(raw)


def scan(sequences: DataFrame, models: list[Model], config: Config | None = None) -> DataFrame:
    """Every sequence against a collection of models: Z is the number of models, ranks are per sequence."""
    config = config or Config()
    raw = raw_hits(sequences, models, config)
    hits = thresholded(raw, replace(config, z=float(config.z or len(models)), dom_z=config.dom_z))
    order = Window.partitionBy("seq_id").orderBy("lnp", F.col("score").desc(), "model")
    return hits.where("reported").withColumn("rank", F.row_number().over(order))


def iterate(sequences: DataFrame, query: Model, rebuild, rounds: int = 5, config: Config | None = None, keep: str | None = None) -> tuple[DataFrame, int]:
    """Search, rebuild the model from included hits, and repeat until no new target is included.

    rebuild(model, hits) gives the next model; it sees included hits alone, whose number thresholds bound. With keep, a
    folder, each round's model and alignment of included domains are left there, as round1/model, round1/alignment and so on.
    """
    config = config or Config(inc_e=1e-3, inc_dom_e=1e-3)
    known = None
    model, hits = query, None
    for step in range(1, rounds + 1):
        hits, _ = search(sequences, [model], config)
        included = hits.where("included")
        found = included.select("seq_id").distinct()
        if keep:
            from seqloom.operators.build import domain_alignment
            from seqloom.sources.hmmfile import SCHEMA, record

            sequences.sparkSession.createDataFrame([record(model)], SCHEMA).write.mode("overwrite").parquet(f"{keep}/round{step}/model")
            domain_alignment(included, model.m).write.mode("overwrite").parquet(f"{keep}/round{step}/alignment")
        if (found if known is None else found.join(known, "seq_id", "left_anti")).isEmpty():
            return hits, step
        known = cut(found if known is None else known.union(found).distinct())
        model = rebuild(model, included)
    return hits, rounds


def compact_sequences(hits: DataFrame) -> DataFrame:
    """A short table of reported targets: n counts all domains, reported or not."""
    return ranked(hits).select("name", F.col("score").alias("bits"), "evalue", F.size("domains").alias("n"), (F.col("pre_score") - F.col("score")).alias("bias"), "rank")


def compact_domains(hits: DataFrame) -> DataFrame:
    """A short table of reported domains, ordered over all targets of a model by P-value."""
    rows = ranked(hits).withColumn("d", F.explode(F.filter("domains", lambda d: d["reported"])))
    order = Window.partitionBy("model").orderBy("d.lnp", F.col("d.bits").desc(), "seq_id", "d.ienv")
    return rows.select("name", F.col("d.bits").alias("bits"), F.col("d.i_evalue").alias("i_evalue"), F.row_number().over(order).alias("hit_no"), (F.col("d.dombias") / LN2).alias("bias"), F.col("d.ienv").alias("env_from"), F.col("d.jenv").alias("env_to"), F.col("d.iali").alias("ali_from"), F.col("d.jali").alias("ali_to"), "d.hmm_from", "d.hmm_to")


def simulated(spark, model: Model, n: int = 1000, length: int = 100, seed: int = 42) -> DataFrame:
    """(i, msv, vit, fwd): bit scores of random sequences drawn from the model's background, each by its own number."""
    p, f = configure(model), model.bg
    null = length * np.log(length / (length + 1)) + np.log(1 / (length + 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, lengths = K.batch([np.random.default_rng([seed, int(i)]).choice(len(f), length, p=f) for i in pdf.id])
            bits = lambda s: (s - null) / LN2
            yield pd.DataFrame({"i": pdf.id, "msv": bits(K.msv(p, x, lengths)), "vit": bits(K.viterbi(p, x, lengths)), "fwd": bits(K.forward(p, x, lengths))})

    return spark.range(n).mapInPandas(run, "i bigint, msv double, vit double, fwd double")
