"""Model construction from alignments, as DataFrame operations over (msa_id, row_idx, aseq) rows.

Columns of an alignment are rows of an exploded table keyed by (msa_id, apos); weights, consensus columns
and counts are aggregations over it. Gaps are '-' and '.', missing data '~'.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.alphabet import ALPHABETS, background, digitize
from seqloom.operators.priors import Prior
from seqloom.operators.priors import prior as standard
from seqloom.operators.profile import DD, DM, II, IM, MD, MI, MM, Model, relative_entropy


def distinct_rows(msa: DataFrame) -> DataFrame:
    """(msa_id, row_idx, aseq, n): equal rows of an alignment as one, under the smallest of their numbers, with how many they are."""
    return msa.groupBy("msa_id", "aseq").agg(F.min("row_idx").alias("row_idx"), F.count("*").alias("n"))


def cells(msa: DataFrame) -> DataFrame:
    """(msa_id, row_idx, apos, c): one row per cell, apos from 1, letters in upper case; and n, the row's number of copies, where msa has it."""
    parts = F.filter(F.split(F.upper("aseq"), ""), lambda c: c != "")
    n = _n_of(msa)
    return msa.select("msa_id", "row_idx", *n, F.posexplode(parts).alias("p", "c")).select("msa_id", "row_idx", (F.col("p") + 1).alias("apos"), "c", *n)


def _n_of(df: DataFrame) -> list[str]:
    return ["n"] if "n" in df.columns else []


def _copies(df: DataFrame) -> Column:
    """How many equal rows of an alignment a row of cells or states stands for."""
    return F.col("n") if "n" in df.columns else F.lit(1)


def is_residue(c: Column) -> Column:
    return c.rlike("^[A-Za-z]$")


def position_weights(cell: DataFrame) -> DataFrame:
    """(msa_id, row_idx, weight): a column gives each residue 1 / (kinds * copies of its kind), a row gets the mean over its residues, and weights sum to the number of rows.

    Of cells with numbers of copies, weight is that of each copy.
    """
    r = cell.where(is_residue(F.col("c")))
    copies = r.groupBy("msa_id", "apos", "c").agg(F.sum(_copies(cell)).alias("copies"))
    kinds = copies.withColumn("kinds", F.count("*").over(Window.partitionBy("msa_id", "apos")))
    share = cell.join(kinds, ["msa_id", "apos", "c"], "left").groupBy("msa_id", "row_idx").agg(F.sum(1.0 / (F.col("copies") * F.col("kinds"))).alias("s"), F.count("copies").alias("used"), F.first(_copies(cell)).alias("n"))
    every = share.withColumn("raw", F.coalesce(F.col("s") / F.nullif("used", F.lit(0)), F.lit(0.0)))
    w = Window.partitionBy("msa_id")
    total, rows = F.sum(F.col("raw") * F.col("n")).over(w), F.sum("n").over(w)
    return every.select("msa_id", "row_idx", F.when(total > 0, F.col("raw") / total * rows).otherwise(1.0).alias("weight"))


def _weighed(df: DataFrame, weights: DataFrame) -> DataFrame:
    """Cells or states with the weight of the rows that they stand for. Both sides grow with the alignment's rows, so neither is sent to the driver."""
    return df.join(weights.hint("merge"), ["msa_id", "row_idx"]).withColumn("weight", F.col("weight") * _copies(df))


def consensus_columns(cell: DataFrame, weights: DataFrame, symfrac: float = 0.5) -> DataFrame:
    """(msa_id, apos, occupied, is_match, k): match columns are those whose weighted residue share reaches symfrac; k numbers them."""
    w = _weighed(cell.where("c <> '~'"), weights)
    share = w.groupBy("msa_id", "apos").agg((F.sum(F.when(is_residue(F.col("c")), F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("occupied"))
    out = share.withColumn("is_match", F.col("occupied") >= symfrac)
    return out.withColumn("k", F.sum(F.col("is_match").cast("int")).over(Window.partitionBy("msa_id").orderBy("apos")))


def emission_counts(cell: DataFrame, weights: DataFrame, columns: DataFrame) -> DataFrame:
    """(msa_id, k, c, count): weighted residues of each match column."""
    match = columns.where("is_match").select("msa_id", "apos", "k")
    return _weighed(cell.where(is_residue(F.col("c"))).join(match, ["msa_id", "apos"]), weights).groupBy("msa_id", "k", "c").agg(F.sum("weight").alias("count"))


def states(cell: DataFrame, columns: DataFrame) -> DataFrame:
    """(msa_id, row_idx, apos, k, state): M or D in match columns, I for residues elsewhere; and n where cells have it."""
    s = cell.join(columns.select("msa_id", "apos", "is_match", "k"), ["msa_id", "apos"])
    residue = is_residue(F.col("c"))
    state = F.when(F.col("is_match") & residue, "M").when(F.col("is_match"), "D").when(residue, "I")
    return s.withColumn("state", state).where("state is not null").select("msa_id", "row_idx", "apos", "k", "state", *_n_of(cell))


def transition_counts(state: DataFrame, weights: DataFrame) -> DataFrame:
    """(msa_id, k, move, count): weighted steps that leave node k, from the begin state (k = 0) on; a step between D and I is not one of a model and is left out."""
    w = Window.partitionBy("msa_id", "row_idx").orderBy("apos")
    step = state.withColumn("from_state", F.lag("state").over(w)).withColumn("from_k", F.lag("k").over(w))
    move = F.concat(F.coalesce("from_state", F.lit("M")), F.col("state"))
    step = step.withColumn("move", move).withColumn("node", F.coalesce("from_k", F.lit(0))).where("move not in ('DI', 'ID')")
    return _weighed(step, weights).groupBy("msa_id", F.col("node").alias("k"), "move").agg(F.sum("weight").alias("count"))


def capped_inserts(counts: DataFrame, longest: float) -> DataFrame:
    """transition_counts' rows, the steps within an insert of a node being at most `longest` times those that begin one."""
    begun = counts.where("move = 'MI'").select("msa_id", "k", F.col("count").alias("begun"))
    cap = F.least("count", F.coalesce("begun", F.lit(0.0)) * longest)
    return counts.join(begun, ["msa_id", "k"], "left").withColumn("count", F.when(F.col("move") == "II", cap).otherwise(F.col("count"))).drop("begun")


def renormalised(counts: DataFrame, *keys: str) -> DataFrame:
    """counts as shares of their sum over keys: probabilities without a prior; nothing where the sum is 0."""
    return counts.withColumn("p", F.col("count") / F.nullif(F.sum("count").over(Window.partitionBy(*keys)), F.lit(0.0)))


def is_valid_row(aseq: Column) -> Column:
    """Whether missing data stands at the ends of a row alone."""
    return aseq.rlike("^~*[^~]*~*$")


def model_names(msa: DataFrame, given: str | None = None, file: str | None = None) -> DataFrame:
    """msa(msa_id, msa_name) with `name` and `problem`: the name given, else the alignment's own, else the file's without directory and suffix.

    Only the name that the alignment has itself will do where there are several alignments.
    """
    several = F.count("*").over(Window.partitionBy()) > 1 if msa.limit(2).count() > 1 else F.lit(False)
    tail = F.lit(file.rsplit("/", 1)[-1].rsplit(".", 1)[0] if file else None).cast("string")
    own = F.col("msa_name")
    name = F.when(~several, F.coalesce(F.lit(given).cast("string"), own, tail)).otherwise(own)
    problem = F.when(several & F.lit(given is not None), "a name is given for several alignments").when(several & own.isNull(), "an alignment has no name").when(name.isNull(), "no name")
    return msa.withColumn("name", name).withColumn("problem", problem)


def checksum(rows: DataFrame) -> DataFrame:
    """(msa_id, checksum): Jenkins' one-at-a-time hash, 32 bits, of an alignment's rows in order. An alignment is gathered in one row."""
    mask = F.lit(0xFFFFFFFF)
    cut = lambda v: v.bitwiseAND(mask)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", "aseq"))), lambda x: x["aseq"]), "")

    def step(v, c):
        v = cut(v + F.ascii(c))
        v = cut(v + F.shiftleft(v, 10))
        return v.bitwiseXOR(F.shiftright(v, 6))

    def last(v):
        v = cut(v + F.shiftleft(v, 3))
        v = v.bitwiseXOR(F.shiftright(v, 11))
        return cut(v + F.shiftleft(v, 15))

    folded = F.aggregate(F.filter(F.split("t", ""), lambda c: c != ""), F.lit(0).cast("bigint"), step, last)
    return rows.groupBy("msa_id").agg(text.alias("t")).select("msa_id", folded.alias("checksum"))


def chained_checksum(rows: DataFrame) -> int | None:
    """checksum() of the rows(row_idx, aseq) of one alignment of any length, None without rows: as each letter's step needs the one before, a task reads them in order and keeps one number."""
    import pandas as pd

    def run(batches):
        v, any_ = 0, False
        for pdf in batches:
            for aseq in pdf.aseq:
                any_ = True
                for c in aseq or "":
                    v = (v + ord(c)) & 0xFFFFFFFF
                    v = (v + (v << 10)) & 0xFFFFFFFF
                    v ^= v >> 6
        v = (v + (v << 3)) & 0xFFFFFFFF
        v ^= v >> 11
        if any_:
            yield pd.DataFrame({"checksum": [(v + (v << 15)) & 0xFFFFFFFF]})

    found = rows.select("row_idx", "aseq").repartition(1).sortWithinPartitions("row_idx", "aseq").mapInPandas(run, "checksum bigint").first()
    return found.checksum if found else None


def justified(inserts: Column, width: Column) -> Column:
    """Inserted residues in a gap of a width: the first half flush left, the rest flush right."""
    left = F.ceil(F.length(inserts) / 2).cast("int")
    return F.concat(F.substring(inserts, F.lit(1), left), F.repeat(F.lit("."), (width - F.length(inserts)).cast("int")), F.substring(inserts, left + 1, F.length(inserts)))


def annotation_lines(columns: DataFrame, masked: DataFrame | None = None) -> DataFrame:
    """(msa_id, rf, mm): a letter per column, x or . for match columns, m or . for masked(msa_id, k) nodes."""
    mask = columns.withColumn("masked", F.lit(False)) if masked is None else columns.join(masked.withColumn("masked", F.lit(True)), ["msa_id", "k"], "left")
    line = lambda test: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("apos", test.alias("c")))), lambda x: x["c"]), "")
    m = F.col("is_match") & F.coalesce("masked", F.lit(False))
    return mask.groupBy("msa_id").agg(line(F.when(F.col("is_match"), "x").otherwise(".")).alias("rf"), line(F.when(m, "m").otherwise(".")).alias("mm"))


# numbers of one alignment: models are small, alignments of one family bounded by their columns
def dirichlet_mean(counts: np.ndarray, mixture: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Mean posterior probabilities of counts under a Dirichlet mixture (weights, components x letters)."""
    from math import lgamma

    weight, alpha = mixture
    gamma = np.vectorize(lgamma)
    total = counts.sum()
    ln = np.log(weight) + gamma(alpha.sum(1)) - gamma(alpha.sum(1) + total) + (gamma(alpha + counts) - gamma(alpha)).sum(1)
    post = np.exp(ln - ln.max())
    post /= post.sum()
    return (post[:, None] * (counts + alpha) / (total + alpha.sum(1))[:, None]).sum(0)


def estimate(name: str, emissions: np.ndarray, transitions: np.ndarray, nseq: int, alphabet: str = "amino", prior: Prior | None = None, eff: float | None = None, target: float | None = None, exponential: bool = False) -> Model:
    """A model from weighted counts: effective sequence number by relative entropy, then mean posterior estimates.

    emissions: (M + 1) x K, transitions: (M + 1) x 7.
    """
    f = background(alphabet)
    m = len(emissions) - 1
    prior = prior or standard(alphabet)
    mixture = (prior.weights, prior.match)
    target = {"amino": 0.59, "dna": 0.62, "rna": 0.62}[alphabet] if target is None else target
    goal = max(target, (45 - np.log2(2 / (m * (m + 1)))) / m)

    def scaled(x: float) -> np.ndarray:
        if exponential:
            return np.where(emissions > 0, np.power(np.maximum(emissions, 1e-300), x), 0)
        return emissions * (x / nseq)

    def entropy_at(x: float) -> float:
        mat = np.vstack([np.zeros(len(f)), *[dirichlet_mean(c, mixture) for c in scaled(x)[1:]]])
        return float(relative_entropy(mat, f).mean())

    if eff is None:
        low, high = 0.0, 1.0 if exponential else float(nseq)
        eff = high
        if entropy_at(high) > goal:
            while high - low > 0.01 * (0.1 if exponential else 1):
                eff = (low + high) / 2
                low, high = (low, eff) if entropy_at(eff) > goal else (eff, high)
            eff = (low + high) / 2
    scale = 1.0 if exponential else eff / nseq
    mat = np.vstack([np.zeros(len(f)), *[dirichlet_mean(c, mixture) for c in scaled(eff)[1:]]])
    t = np.zeros((m + 1, 7))
    for k in range(m + 1):
        c = transitions[k] * scale
        t[k, MM : MD + 1] = dirichlet_mean(c[MM : MD + 1], (np.ones(1), prior.moves[0][None]))
        t[k, IM : II + 1] = dirichlet_mean(c[IM : II + 1], (np.ones(1), prior.moves[1][None]))
        t[k, DM : DD + 1] = dirichlet_mean(c[DM : DD + 1], (np.ones(1), prior.moves[2][None]))
    t[0, DM:] = [1, 0]
    t[m, MM], t[m, MI], t[m, MD], t[m, DM], t[m, DD] = *dirichlet_mean(transitions[m, MM : MI + 1] * scale, (np.ones(1), prior.moves[0][None, :2])), 0, 1, 0
    inserts = np.tile(prior.insert / prior.insert.sum(), (m + 1, 1))  # inserts aren't counted: they keep the prior's mean
    return Model(name, mat, t, inserts, alphabet, nseq=nseq, eff_nseq=float(eff))


def from_alignment(name: str, rows: list[str], alphabet: str = "amino", symfrac: float = 0.5, weights: np.ndarray | None = None, reference: str | None = None, mask: str | None = None, fragments: float = 0.5, weigh_common: bool = False, copies: np.ndarray | None = None, **options) -> Model:
    """A model from one alignment held in memory; reference marks match columns by hand; copies counts equal rows given once. Rows that span at most a share `fragments` of the columns have missing data, not deletions, at their ends."""
    rows = mark_fragments(rows, fragments)
    grid = np.array([list(r.upper()) for r in rows])
    residue = np.char.isalpha(grid)
    missing = grid == "~"
    copies = np.ones(len(rows)) if copies is None else np.asarray(copies, float)
    if weights is None:  # by position, over all columns or those that most rows occupy
        common = copies @ residue >= (0.5 * np.maximum(1, copies @ ~missing) if weigh_common else 1)
        weights, used = np.zeros(len(rows)), np.zeros(len(rows))
        for col in np.flatnonzero(common) if common.any() else range(grid.shape[1]):
            on = residue[:, col]
            _, which = np.unique(grid[on, col], return_inverse=True)
            if len(which):
                counts = np.bincount(which, copies[on])
                weights[on] += 1 / (len(counts) * counts[which])
                used[on] += 1
        weights = copies * weights / np.maximum(1, used)
        weights = weights / weights.sum() * copies.sum() if weights.sum() else copies
    seen = (weights[:, None] * ~missing).sum(0)
    share = np.divide((weights[:, None] * residue).sum(0), seen, out=np.zeros(grid.shape[1]), where=seen > 0)
    match = marked_columns(reference) if reference else share >= symfrac
    if not match.any():
        raise ValueError(f"{name}: no match columns")
    return _modelled(name, *path_counts(grid, match, weights, alphabet, mask), match, int(copies.sum()), alphabet, mask, **options)


def marked_columns(reference: str) -> np.ndarray:
    return np.array([c not in ".-~ " for c in reference])


def path_counts(grid: np.ndarray, match: np.ndarray, weights: np.ndarray, alphabet: str, mask: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(emissions, transitions) of rows of letters in upper case, each with its weight; masked columns count nothing, so the prior's mean stays."""
    letters, columns = ALPHABETS[alphabet], np.flatnonzero(match)
    m, number = len(columns), np.cumsum(match)
    residue, missing = np.char.isalpha(grid), grid == "~"
    emissions, transitions = np.zeros((m + 1, len(letters))), np.zeros((m + 1, 7))
    names = {"MM": MM, "MI": MI, "MD": MD, "IM": IM, "II": II, "DM": DM, "DD": DD}
    for r in range(len(grid)):
        code = digitize("".join(grid[r]), alphabet)
        path = [("M" if residue[r, c] else "D", int(number[c]), c) if match[c] else ("I", int(number[c]), c) for c in range(grid.shape[1]) if residue[r, c] or (match[c] and not missing[r, c])]
        before, node = "M", 0
        for state, k, col in without_delete_insert(path):
            if before + state in names:
                transitions[node, names[before + state]] += weights[r]
            if state == "M" and code[col] < len(letters) and not (mask and mask[columns[k - 1]] == "m"):
                emissions[k, code[col]] += weights[r]
            before, node = state, k
        if node == m:
            transitions[m, names[before + "M"]] += weights[r]  # to the end state
    return emissions, transitions


def _modelled(name: str, emissions: np.ndarray, transitions: np.ndarray, match: np.ndarray, nseq: int, alphabet: str, mask: str | None = None, **options) -> Model:
    """A model from weighted counts, with the map of its columns, consensus and mask."""
    from seqloom.operators.profile import consensus

    columns = np.flatnonzero(match)
    model = estimate(name, emissions, transitions, nseq, alphabet, **options)
    model.map = [int(c) + 1 for c in columns]
    model.mm = "".join(mask[c] for c in columns) if mask else None
    model.consensus = consensus(model, model.mm)
    return model


def from_table(name: str, rows: DataFrame, reference: str, alphabet: str = "amino", fragments: float = 0.5, **options) -> Model:
    """from_alignment() of any number of rows(aseq, n), n equal ones each; reference marks match columns.

    Two passes in tasks, one for the letters of columns, which give rows their weights, one for what rows count with these weights. Only
    sums over rows come to the driver: a number for each letter of a column, and the counts of a model.
    """
    import pandas as pd

    match = marked_columns(reference)
    if not match.any():
        raise ValueError(f"{name}: no match columns")

    def grids(batches):
        for pdf in batches:
            if len(pdf):
                yield np.array([list(r.upper()) for r in mark_fragments(pdf.aseq.tolist(), fragments)]), pdf.n.to_numpy(float)

    def letters(batches):
        for grid, n in grids(batches):
            residue = np.char.isalpha(grid)
            for col in range(grid.shape[1]):
                kinds, which = np.unique(grid[residue[:, col], col], return_inverse=True)
                yield pd.DataFrame({"col": col, "c": kinds.astype(object), "n": np.bincount(which, n[residue[:, col]], len(kinds))})

    some = rows.select("aseq", "n")
    copies: dict[int, dict[str, float]] = {}
    for r in some.mapInPandas(letters, "col int, c string, n double").groupBy("col", "c").agg(F.sum("n").alias("n")).collect():
        copies.setdefault(r.col, {})[r.c] = r.n

    def counts(batches):
        for grid, n in grids(batches):
            gain = np.array([[1 / (len(copies[k]) * copies[k][c]) if c in copies.get(k, ()) else 0.0 for k, c in enumerate(row)] for row in grid])
            weights = n * gain.sum(1) / np.maximum(1, (gain > 0).sum(1)) if copies else n
            emissions, transitions = path_counts(grid, match, weights, alphabet)
            numbers = np.concatenate([[n.sum(), weights.sum()], emissions.ravel(), transitions.ravel()])
            yield pd.DataFrame({"at": np.arange(len(numbers)), "x": numbers})

    sums = {r["at"]: r.x for r in some.mapInPandas(counts, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()}
    if not sums:
        raise ValueError(f"{name}: no rows")
    nseq, total, *numbers = (sums[k] for k in range(len(sums)))
    numbers, nodes = np.array(numbers) * nseq / total, int(match.sum()) + 1
    cut = nodes * len(ALPHABETS[alphabet])
    return _modelled(name, numbers[:cut].reshape(nodes, -1), numbers[cut:].reshape(nodes, -1), match, int(nseq), alphabet, **options)


def rebuilder(query: str, **options):
    """rebuild(model, included) for an iterative search that began with the sequence query.

    The next model comes from the alignment of the included domains and the query's row. The nodes stay
    the query's residues, so their columns are the reference; domains keep the paths they were found with.
    Equal rows are counted where they are, so what comes to the driver is one row per distinct domain.
    """
    from pyspark.sql import functions as F

    def rebuild(model: Model, included: DataFrame) -> Model:
        d = included.select(F.explode(F.filter("domains", lambda d: d["included"])).alias("d"))
        found = sorted(d.groupBy("d.hmm_from", "d.model", "d.aseq").count().collect())
        columns, reference = aligned_domains(query, [(r[0], r[1], r[2]) for r in found])
        following = from_alignment(model.name, columns, model.alphabet, reference=reference, copies=np.array([1, *[r[3] for r in found]]), **options)
        following.f = model.f
        return following

    return rebuild


def aligned_domains(query: str, domains: list[tuple[int, str, str]]) -> tuple[list[str], str]:
    """(rows, reference) of the query and of domains (first node, model line, target line); columns of inserts have '.' as reference."""
    m = len(query)
    placed, widths = [], [0] * (m + 1)
    for first, top, bottom in [(1, "x" * m, query.upper()), *domains]:
        match, inserts, k = ["-"] * (m + 1), [""] * (m + 1), first - 1
        for node, residue in zip(top, bottom, strict=True):
            if node == ".":
                inserts[k] += residue.lower()
            else:
                k += 1
                match[k] = residue
        widths = [max(w, len(i)) for w, i in zip(widths, inserts, strict=True)]
        placed.append((match, inserts))
    rows = ["".join((match[k] if k else "") + inserts[k].ljust(widths[k], ".") for k in range(m + 1)) for match, inserts in placed]
    return rows, "".join(("x" if k else "") + "." * widths[k] for k in range(m + 1))


def without_delete_insert(path: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """A path in which a delete next to an insert, which models don't have, is a match that emits the insert's residue."""
    out: list[tuple[str, int, int]] = []
    for step in path:
        if out and out[-1][0] == "D" and step[0] == "I":
            out[-1] = ("M", out[-1][1], step[2])
        elif out and out[-1][0] == "I" and step[0] == "D":
            out[-1] = ("M", step[1], out[-1][2])
        else:
            out.append(step)
    return out


def mark_fragments(rows: list[str], threshold: float = 0.5) -> list[str]:
    """Rows whose residues span at most a share of the alignment get '~' for the gaps at their ends."""
    out = []
    for r in rows:
        at = [i for i, c in enumerate(r) if c.isalpha()]
        if at and at[-1] - at[0] + 1 <= threshold * len(r):
            r = "~" * at[0] + r[at[0] : at[-1] + 1] + "~" * (len(r) - at[-1] - 1)
        out.append(r)
    return out


def aligned_parts(model: Model, seq: str) -> tuple[list[str], list[str], list[str], list[str]]:
    """(match letters, their posterior codes, inserts, their codes) of a sequence on the path of best accuracy, by node 0..M; node 0 and M hold the flanks."""
    from seqloom.operators import kernels as K
    from seqloom.operators.profile import configure

    m = model.m
    match, post = ["-"] * (m + 1), ["."] * (m + 1)
    inserts, marks = [""] * (m + 1), [""] * (m + 1)
    if seq:
        p = configure(model, multihit=False)
        _, path = K.optimal_accuracy(p, K.Posterior(p, digitize(seq, model.alphabet)))
        for state, k, i, q in path:
            code = "*" if q + 0.05 >= 1 else str(int((q + 0.05) * 10))
            if state == "M":
                match[k], post[k] = seq[i - 1].upper(), code
            elif state in "INC":
                node = 0 if state == "N" else m if state == "C" else k
                inserts[node] += seq[i - 1].lower()
                marks[node] += code
    return match, post, inserts, marks


def laid_out(match: list[str], post: list[str], inserts: list[str], marks: list[str], widths: list[int]) -> tuple[str, str]:
    """(aligned row, posterior row) for the widths of the insert columns behind each node: the first half of an insert keeps left, the
    second right; the flank before the first node is flush right, the one after the last flush left."""
    m, row, pp = len(match) - 1, [], []
    for k in range(m + 1):
        if k:
            row.append(match[k])
            pp.append(post[k])
        n = len(inserts[k])
        cut, gap = 0 if k == 0 else n if k == m else (n + 1) // 2, "." * (widths[k] - n)
        row.append(inserts[k][:cut] + gap + inserts[k][cut:])
        pp.append(marks[k][:cut] + gap + marks[k][cut:])
    return "".join(row), "".join(pp)


def align(model: Model, names: list[str], seqs: list[str]) -> list[tuple[str, str, str]]:
    """(name, aligned row, posterior row) of each sequence: match columns in upper case, inserts in lower case with '.' for padding."""
    parts = [aligned_parts(model, s) for s in seqs]
    widths = [max((len(p[2][k]) for p in parts), default=0) for k in range(model.m + 1)]
    return [(name, *laid_out(*p, widths)) for name, p in zip(names, parts, strict=True)]


PARTS = "name string, match array<string>, post array<string>, inserts array<string>, marks array<string>"


def rows_of(parts: DataFrame, m: int) -> DataFrame:
    """(name, aseq, pp) of aligned parts: the width of every insert column is the greatest that any row needs, which is one
    aggregation; then rows are laid out with these widths. Only the widths, one per node, come to the driver."""
    import pandas as pd
    from pyspark.sql import functions as F

    from seqloom.session import cut

    made = cut(parts)
    widths = [0] * (m + 1)
    for r in made.select(F.posexplode(F.transform("inserts", F.length)).alias("k", "w")).groupBy("k").agg(F.max("w").alias("w")).collect():
        widths[r.k] = r.w

    def rows(batches):
        for pdf in batches:
            yield pd.DataFrame([(n, *laid_out(list(a), list(b), list(c), list(d), widths)) for n, a, b, c, d in zip(pdf.name, pdf.match, pdf.post, pdf.inserts, pdf.marks, strict=True)], columns=["name", "aseq", "pp"])

    return made.mapInPandas(rows, "name string, aseq string, pp string")


def parts_of(sequences: DataFrame, model: Model) -> DataFrame:
    """PARTS of sequences(name, seq), each aligned to a model by itself; a task aligns equal ones once."""
    import pandas as pd

    from seqloom.operators import kernels as K
    from seqloom.operators import search as R

    def parts(batches):
        aligned = K.once(lambda s: aligned_parts(model, s))
        for pdf in batches:
            found = [aligned(s or "") for s in pdf.seq]
            yield pd.DataFrame({"name": pdf.name, **{c: [f[i] for f in found] for i, c in enumerate(("match", "post", "inserts", "marks"))}})

    return R.balanced(sequences.select("name", "seq")).mapInPandas(parts, PARTS)


def alignment(sequences: DataFrame, model: Model) -> DataFrame:
    """(name, aseq, pp): sequences(name, seq) as rows of one alignment to a model, each aligned by itself."""
    return rows_of(parts_of(sequences, model), model.m)


def domain_alignment(hits: DataFrame, m: int) -> DataFrame:
    """(name, aseq, pp): the included domains of hits to a model of m nodes as rows of one alignment, on the paths they were found with.

    A row is named by its target and the residues that it spans.
    """
    import pandas as pd
    from pyspark.sql import functions as F

    d = hits.select("name", F.explode(F.filter("domains", lambda d: d["included"])).alias("d"))
    d = d.select(F.concat("name", F.lit("/"), "d.iali", F.lit("-"), "d.jali").alias("name"), F.col("d.hmm_from").alias("first"), F.col("d.model").alias("top"), F.col("d.aseq").alias("bottom"), F.col("d.pp").alias("codes"))

    def parts(batches):
        for pdf in batches:
            out = []
            for name, first, top, bottom, codes in zip(pdf.name, pdf["first"], pdf.top, pdf.bottom, pdf.codes, strict=True):
                match, post, inserts, marks, k = ["-"] * (m + 1), ["."] * (m + 1), [""] * (m + 1), [""] * (m + 1), first - 1
                for node, residue, code in zip(top, bottom, codes, strict=True):
                    if node == ".":
                        inserts[k] += residue.lower()
                        marks[k] += code
                    else:
                        k += 1
                        match[k], post[k] = residue, code
                out.append((name, match, post, inserts, marks))
            yield pd.DataFrame(out, columns=["name", "match", "post", "inserts", "marks"])

    return rows_of(d.mapInPandas(parts, PARTS), m)


def emit(model: Model, n: int, seed: int = 42) -> list[str]:
    """n sequences sampled from the core model, begin to end."""
    rng = np.random.default_rng(seed)
    letters, out = ALPHABETS[model.alphabet], []
    ins = model.ins if model.ins is not None else np.tile(model.bg, (model.m + 1, 1))
    for _ in range(n):
        seq, state, k = [], "M", 0
        while True:
            row = model.t[k]
            if state == "M":
                state = "MID"[rng.choice(3, p=row[MM : MD + 1] / row[MM : MD + 1].sum())]
            elif state == "I":
                state = "MI"[rng.choice(2, p=row[IM : II + 1] / row[IM : II + 1].sum())]
            else:
                state = "MD"[rng.choice(2, p=row[DM : DD + 1] / row[DM : DD + 1].sum())]
            if state != "I":
                k += 1
            if k > model.m:
                break
            if state == "M":
                seq.append(letters[rng.choice(len(letters), p=model.mat[k] / model.mat[k].sum())])
            elif state == "I":
                seq.append(letters[rng.choice(len(letters), p=ins[k] / ins[k].sum())].lower())
        out.append("".join(seq))
    return out
