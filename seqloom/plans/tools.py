"""Named queries of the tools around a search: splits for benchmarks, traces, indexes, reports, exchange formats."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from seqloom.functions.alphabet import AMINO, background
from seqloom.operators import clusters as C
from seqloom.operators import profile as P
from seqloom.plans.catalog import LOGO, NATION_MODEL, QUANTISED, SQL, STRIP, WORD_CELLS, nation_models, query, r6, segments, table

# part names as rows of one alignment per brand
BRANDS = "(SELECT p_brand AS msa_id, p_partkey AS row_idx, rpad(upper(replace(p_name, ' ', '-')), 16, '-') AS aseq FROM part)"
PID = "len(list_filter(range(1, 17), lambda i: substr(a.aseq, i::INT, 1) = substr(b.aseq, i::INT, 1) AND substr(a.aseq, i::INT, 1) <> '-')) / least(length(replace(a.aseq, '-', '')), length(replace(b.aseq, '-', '')))::DOUBLE"
LINKS = f"d AS (SELECT msa_id, aseq, min(row_idx) AS rep FROM {BRANDS} GROUP BY ALL), ln AS (SELECT a.msa_id, a.rep AS a, b.rep AS b, {PID} AS pid FROM d a JOIN d b ON a.msa_id = b.msa_id AND a.rep < b.rep WHERE {PID} >= 0.62)"
CLUSTERS = f"""{LINKS}, ed AS (SELECT msa_id, a, b FROM ln UNION ALL SELECT msa_id, b, a FROM ln),
re AS (SELECT msa_id, rep AS v, rep AS m FROM d UNION SELECT re.msa_id, ed.b, re.m FROM re JOIN ed ON ed.msa_id = re.msa_id AND ed.a = re.v),
ro AS (SELECT msa_id, v, min(m) AS cluster FROM re GROUP BY ALL), cl AS (SELECT r.msa_id, r.row_idx, cluster FROM {BRANDS} r JOIN d ON d.msa_id = r.msa_id AND d.aseq = r.aseq JOIN ro ON ro.msa_id = d.msa_id AND v = rep)"""


def brands(spark, d):
    return table(spark, d, "part").select(F.col("p_brand").alias("msa_id"), F.col("p_partkey").alias("row_idx"), F.rpad(F.upper(F.replace("p_name", F.lit(" "), F.lit("-"))), 16, "-").alias("aseq"))


@query(f"WITH {LINKS} SELECT msa_id, a, b, round(pid, 6) AS pid FROM ln")
def identity_links(spark, d):
    return C.identity_links(brands(spark, d), 0.62).select("msa_id", "a", "b", r6(F.col("pid")).alias("pid"))


@query(f"WITH RECURSIVE {CLUSTERS} SELECT msa_id, count(DISTINCT cluster)::DOUBLE AS eff_nseq FROM cl GROUP BY msa_id")
def effective_number_clusters(spark, d):
    return C.effective_number(brands(spark, d))


@query(f"""WITH RECURSIVE {CLUSTERS}, sz AS (SELECT msa_id, cluster, count(*) AS n FROM cl GROUP BY ALL), tt AS (SELECT msa_id, sum(n) / count(*)::DOUBLE AS each FROM sz GROUP BY msa_id)
SELECT msa_id, row_idx, round(each / n, 6) AS weight FROM cl JOIN sz USING (msa_id, cluster) JOIN tt USING (msa_id)""")
def cluster_weights(spark, d):
    from seqloom.operators import weights

    return weights.cluster_weights(brands(spark, d), 0.62).select("msa_id", "row_idx", r6(F.col("weight")).alias("weight"))


@query()
def tree_weights(spark, d):
    """Weights of part names by the guide tree of their brand."""
    from seqloom.operators import weights

    return weights.tree_weights(brands(spark, d)).select("msa_id", "row_idx", r6(F.col("weight")).alias("weight"))


@query(f"""WITH RECURSIVE {CLUSTERS}, sz AS (SELECT msa_id, cluster, row_number() OVER (PARTITION BY msa_id ORDER BY count(*) DESC, cluster) AS r FROM cl GROUP BY msa_id, cluster)
SELECT msa_id, row_idx, CASE WHEN r = 1 THEN 'train' ELSE 'test' END AS part FROM cl JOIN sz USING (msa_id, cluster)""")
def benchmark_split(spark, d):
    return C.split_by_cluster(brands(spark, d), 0.62)


@query(f"SELECT DISTINCT p_brand AS msa_id, 0::BIGINT AS violations FROM part")
def benchmark_validate(spark, d):
    rows = brands(spark, d)
    return C.split_violations(rows, C.split_by_cluster(rows, 0.62), 0.62)


@query(f"WITH RECURSIVE {CLUSTERS} SELECT msa_id, arg_min(row_idx, md5('42:' || row_idx)) AS row_idx FROM cl GROUP BY msa_id, cluster")
def benchmark_filter(spark, d):
    return C.filtered_by_cluster(brands(spark, d), 0.62)


@query(f"""WITH RECURSIVE {LINKS}, ed AS (SELECT msa_id, a, b FROM ln UNION ALL SELECT msa_id, b, a FROM ln),
ne AS (SELECT d.msa_id, rep, coalesce(list(b) FILTER (b IS NOT NULL), []) AS near FROM d LEFT JOIN ed ON ed.msa_id = d.msa_id AND ed.a = rep GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY msa_id ORDER BY md5('42:' || rep)) AS r FROM ne),
wk AS (SELECT msa_id, 1 AS r, [rep] AS chosen FROM rk WHERE r = 1 UNION ALL
       SELECT wk.msa_id, rk.r::INT, CASE WHEN len(list_intersect(near, chosen)) = 0 THEN list_append(chosen, rep) ELSE chosen END FROM wk JOIN rk ON rk.msa_id = wk.msa_id AND rk.r = wk.r + 1)
SELECT msa_id, unnest(chosen) AS row_idx FROM wk WHERE r = (SELECT max(r) FROM rk WHERE rk.msa_id = wk.msa_id)""")
def benchmark_independent_set(spark, d):
    return C.independent_set(brands(spark, d), 0.62)


@query(f"SELECT msa_id, row_idx FROM {BRANDS} WHERE length(regexp_replace(aseq, '^[^A-Za-z]+|[^A-Za-z]+$', '', 'g')) > 0.6 * length(aseq)")
def benchmark_fragments(spark, d):
    return C.without_fragments(brands(spark, d), 0.6).select("msa_id", "row_idx")


SHUFFLE = "(SELECT string_agg(substr({s}, i::INT, 1), '' ORDER BY md5({k} || ':' || i), i) FROM (SELECT unnest(range(1, length({s}) + 1)) AS i))"
FLANKS = "(SELECT p_partkey AS n, upper(replace(p_name || p_type, ' ', '')) AS source FROM part)"


def flanks(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("n"), F.upper(F.replace(F.concat("p_name", "p_type"), F.lit(" "), F.lit(""))).alias("source"))


@query(f"""WITH x AS (SELECT 'nation' || (n % 25) AS query, n, substr(source, 1, 8) AS l, n_name AS seq, substr(source, 9, 8) AS r FROM {FLANKS} JOIN nation ON n_nationkey = n % 25),
y AS (SELECT query, n, coalesce({SHUFFLE.format(s='l', k="('left' || n)")}, '') AS l, seq, coalesce({SHUFFLE.format(s='r', k="('right' || n)")}, '') AS r FROM x)
SELECT query || '/' || n AS name, l || seq || r AS seq, (length(l) + 1)::INT AS start, (length(l) + length(seq))::INT AS "end" FROM y""")
def benchmark_positives(spark, d):
    names = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("seq"))
    domains = flanks(spark, d).select("n").join(F.broadcast(names), F.col("n") % 25 == F.col("n_nationkey")).select(F.concat(F.lit("nation"), "n_nationkey").alias("query"), "n", "seq")
    return C.positives(domains, flanks(spark, d), 8)


@query(f"SELECT 'decoy' || n AS name, {SHUFFLE.format(s='source', k="('decoy' || n)")} AS seq FROM {FLANKS}")
def benchmark_negatives(spark, d):
    return C.negatives(flanks(spark, d))


RESULTS = """(SELECT o_orderkey AS id, 'q' || (o_custkey % 10) AS query, CASE WHEN o_orderkey % 5 = 0 THEN 'decoy' || o_orderkey WHEN o_orderkey % 3 = 0 THEN 'q' || (o_custkey % 10) || '/' || o_orderkey ELSE 'q' || (o_custkey % 10) || '1/' || o_orderkey END AS target,
(o_totalprice * (CASE WHEN o_orderkey % 5 = 0 THEN 1.5 ELSE 0.5 END))::DOUBLE AS evalue FROM orders)"""


def results(spark, d):
    q, k = F.concat(F.lit("q"), (F.col("o_custkey") % 10).cast("string")), F.col("o_orderkey")
    target = F.when(k % 5 == 0, F.concat(F.lit("decoy"), k)).when(k % 3 == 0, F.concat(q, F.lit("/"), k)).otherwise(F.concat(q, F.lit("1/"), k))
    return table(spark, d, "orders").select(k.alias("id"), q.alias("query"), target.alias("target"), (F.col("o_totalprice").cast("double") * F.when(k % 5 == 0, 1.5).otherwise(0.5)).alias("evalue"))


@query(f"SELECT id, CASE WHEN starts_with(target, query || '/') THEN 1 WHEN starts_with(target, 'decoy') THEN -1 ELSE 0 END AS class FROM {RESULTS}")
def roc_classes(spark, d):
    return results(spark, d).select("id", C.classified(F.col("query"), F.col("target")).alias("class"))


@query(f"""WITH c AS (SELECT *, CASE WHEN starts_with(target, query || '/') THEN 1 WHEN starts_with(target, 'decoy') THEN -1 ELSE 0 END AS class FROM {RESULTS}),
k AS (SELECT *, sum(CASE WHEN class = -1 THEN 1 ELSE 0 END) OVER (ORDER BY evalue, id) AS fp, (SELECT count(DISTINCT query) FROM c WHERE class <> 0) AS nq FROM c WHERE class <> 0),
x AS (SELECT CASE WHEN fp = 0 THEN ceil(-log10(nq::DOUBLE) * 3) - 1 ELSE ceil(round(log10(fp::DOUBLE / nq) * 3, 9)) END::BIGINT AS x FROM k WHERE class = 1)
SELECT x, round(pow(10, x / 3.0), 6) AS false_per_query, sum(count(*)) OVER (ORDER BY x)::BIGINT AS true_positives FROM x GROUP BY x""")
def roc_curve(spark, d):
    return C.roc_curve(results(spark, d))


#: A sample's draw for a name, in SQL.
DRAW = "-ln((('0x' || substr(md5('42:' || (b // 4) || ':' || {}), (1 + 8 * (b % 4))::INT, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE)"
SAMPLES = 20


@query(f"""WITH c AS (SELECT * FROM (SELECT *, CASE WHEN starts_with(target, query || '/') THEN 1 WHEN starts_with(target, 'decoy') THEN -1 ELSE 0 END AS class FROM {RESULTS}) WHERE class <> 0),
b AS (SELECT unnest(range(0, {SAMPLES})) AS b), n AS (SELECT count(DISTINCT query) AS nq, count(DISTINCT target) AS nt, floor(round(-log10(count(DISTINCT query)) * 3, 9))::INT AS base, 3 AS last FROM c),
qd AS (SELECT b, query, {DRAW.format('query')} AS w FROM (SELECT DISTINCT query FROM c), b), td AS (SELECT b, target, {DRAW.format('target')} AS w FROM (SELECT DISTINCT target FROM c), b),
s AS (SELECT b, (SELECT sum(w) FROM qd WHERE qd.b = b.b) AS qs, (SELECT sum(w) FROM td WHERE td.b = b.b) AS ts FROM b),
k AS (SELECT b, class, evalue, id, qd.w * td.w * nt / (qs * ts) AS w FROM c JOIN qd USING (query) JOIN td USING (target, b) JOIN s USING (b) CROSS JOIN n),
f AS (SELECT b, class, w, sum(CASE WHEN class = -1 THEN w ELSE 0 END) OVER (PARTITION BY b ORDER BY evalue, id) AS fp FROM k),
x AS (SELECT b, w, CASE WHEN fp = 0 THEN base ELSE least(last + 1, greatest(base, ceil(round(log10(fp) * 3, 9)))) END AS x FROM f, n WHERE class = 1),
g AS (SELECT b, unnest(range(base, last + 1)) AS x FROM b, n),
h AS (SELECT g.x, g.b, (SELECT coalesce(sum(w), 0) FROM x WHERE x.b = g.b AND x.x <= g.x) / (SELECT sum(w) FROM x WHERE x.b = g.b) AS share FROM g),
o AS (SELECT x, avg(share) AS mean, list_sort(list(share)) AS shares FROM h GROUP BY x)
SELECT x::INT AS x, round(pow(10, x / 3.0), 6) AS false_per_query, round(mean, 6) AS mean, round(shares[3], 6) AS lower, round(shares[19], 6) AS upper FROM o""")
def roc_intervals(spark, d):
    """Curves of twenty bootstrap samples, and the interval that holds four fifths of them."""
    found = C.roc_intervals(results(spark, d), SAMPLES, interval=0.8)
    return found.select("x", "false_per_query", *[r6(F.col(c)).alias(c) for c in ("mean", "lower", "upper")])


# traces: the states that rows of an alignment pass through
def _columns(rows):
    """(cells, columns) of rows of alignments, all rows counted in full; equal rows are taken once, with their number."""
    from pyspark.sql import Window

    from seqloom.operators import build as B

    cell = B.cells(B.distinct_rows(rows))
    share = cell.groupBy("msa_id", "apos").agg((F.sum(F.when(B.is_residue(F.col("c")), F.col("n")).otherwise(0)) / F.sum("n") >= 0.5).alias("is_match"))
    return cell, share.withColumn("k", F.sum(F.col("is_match").cast("int")).over(Window.partitionBy("msa_id").orderBy("apos")))


def _states(spark, d):
    from seqloom.operators import build as B

    return B.states(B.cells(segments(spark, d)), _columns(segments(spark, d))[1])


@query(f"WITH {NATION_MODEL} SELECT msa_id, row_idx, state, count(*)::BIGINT AS n FROM st WHERE state IS NOT NULL GROUP BY ALL")
def state_usage(spark, d):
    return _states(spark, d).groupBy("msa_id", "row_idx", "state").agg(F.count("*").alias("n"))


def _trace(spark, d):
    """(msa_id, row_idx, trace): states of a row as an array in the order of columns."""
    return _states(spark, d).groupBy("msa_id", "row_idx").agg(F.array_sort(F.collect_list(F.struct("apos", "state", "k"))).alias("trace"))


@query(f"WITH {NATION_MODEL} SELECT msa_id, row_idx, string_agg(state, '' ORDER BY apos) AS path, string_agg(state, '' ORDER BY apos DESC) AS back FROM st WHERE state IS NOT NULL GROUP BY ALL")
def trace_reverse(spark, d):
    path = F.transform("trace", lambda x: x["state"])
    return _trace(spark, d).select("msa_id", "row_idx", F.array_join(path, "").alias("path"), F.array_join(F.reverse(path), "").alias("back"))


@query(f"""WITH {NATION_MODEL} SELECT msa_id, row_idx, min(CASE WHEN state = 'M' THEN k END)::BIGINT AS k1, max(CASE WHEN state = 'M' THEN k END)::BIGINT AS k2, 1::BIGINT AS i1, count(CASE WHEN state IN ('M', 'I') THEN 1 END)::BIGINT AS i2 FROM st WHERE state IS NOT NULL GROUP BY ALL""")
def trace_domains(spark, d):
    """First and last node, and residue, of each row's passage through the model."""
    nodes = F.transform(F.filter("trace", lambda x: x["state"] == "M"), lambda x: x["k"])
    return _trace(spark, d).select("msa_id", "row_idx", F.array_min(nodes).cast("bigint").alias("k1"), F.array_max(nodes).cast("bigint").alias("k2"), F.lit(1).cast("bigint").alias("i1"), F.size(F.filter("trace", lambda x: x["state"] != "D")).cast("bigint").alias("i2"))


# exact strings by a transform index
STRINGS = "(SELECT s_suppkey AS query, substr(seq, 2, 3) AS pattern FROM supplier JOIN {PARTS} ON p_partkey = s_suppkey WHERE length(seq) >= 4)"
PLACES = f"(SELECT query, p_partkey AS target, i::BIGINT AS pos FROM (SELECT p_partkey, seq, unnest(range(1, length(seq) + 1)) AS i FROM {{PARTS}}) JOIN {STRINGS} ON substr(seq, i::INT, length(pattern)) = pattern)"


def _part_index(spark, d):
    from seqloom.operators import fmindex
    from seqloom.plans.catalog import parts

    return fmindex.build_index(parts(spark, d).select(F.col("p_partkey").alias("target"), "seq"), overlap=50, block=1 << 14)


def _strings(spark, d):
    """Letters 2 to 4 of the part that has a supplier's number."""
    from seqloom.plans.catalog import parts

    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("query"))
    return parts(spark, d).join(s, F.col("p_partkey") == F.col("query")).where("length(seq) >= 4").select("query", F.substring("seq", 2, 3).alias("pattern"))


@query(f"SELECT query, target, pos FROM {PLACES}")
def fm_positions(spark, d):
    from seqloom.operators import fmindex

    return fmindex.find(_part_index(spark, d), _strings(spark, d))


@query(f"SELECT query, count(target)::BIGINT AS n FROM {STRINGS} LEFT JOIN {PLACES} USING (query) GROUP BY query")
def fm_counts(spark, d):
    from seqloom.operators import fmindex

    return fmindex.find(_part_index(spark, d), _strings(spark, d), counts_only=True).groupBy("query").agg(F.sum("n").alias("n"))


@query("SELECT p_partkey AS target, md5(seq) AS digest FROM {PARTS} WHERE seq <> ''")
def fm_text(spark, d):
    """Sequences read back from the transform."""
    from seqloom.operators import fmindex

    return fmindex.restored(_part_index(spark, d)).select("target", F.md5("part").alias("digest"))


@query("SELECT sum(length(seq))::BIGINT AS letters, count(*)::BIGINT AS parts FROM {PARTS} WHERE seq <> ''")
def fm_metadata(spark, d):
    return _part_index(spark, d).agg(F.sum("n").cast("bigint").alias("letters"), F.sum(F.size("parts")).cast("bigint").alias("parts"))


@query("""SELECT page_id, unnest(list_transform(range(1, len(runs) + 1), lambda i: runs[i])) AS run FROM (SELECT page_id, list_transform(regexp_extract_all(coalesce(html, ''), '[BDEFHIJKLMNOPQRSUVWXYZbdefhijklmnopqrsuvwxyz]+'), lambda x: upper(x)) AS runs FROM pages)""")
def ambiguity_runs(spark, d):
    """Runs of letters that are none of A, C, G and T."""
    return table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit("[BDEFHIJKLMNOPQRSUVWXYZbdefhijklmnopqrsuvwxyz]+"), F.lit(0))).alias("run")).select("page_id", F.upper("run").alias("run"))


@query("""SELECT p_partkey, substr(s, 3, 6) AS forward, reverse(translate(substr(s, 3, 6), 'ACGT', 'TGCA')) AS backward FROM (SELECT p_partkey, regexp_replace(upper(p_name || p_type), '[^ACGT]', '', 'g') AS s FROM part)""")
def extract_range(spark, d):
    from seqloom.functions.alphabet import reverse_complement

    part = F.substring(F.regexp_replace(F.upper(F.concat("p_name", "p_type")), "[^ACGT]", ""), 3, 6)
    return table(spark, d, "part").select("p_partkey", part.alias("forward"), reverse_complement(part).alias("backward"))


# exchange and reports
@query("SELECT o_orderkey AS hit, o_custkey AS target, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice::DOUBLE END AS score, o_orderpriority AS label FROM orders")
def hits_roundtrip(spark, d):
    """Hits packed into Arrow streams and unpacked again."""
    from seqloom.sources import wire

    hits = table(spark, d, "orders").select(F.col("o_orderkey").alias("hit"), F.struct(F.col("o_custkey").alias("target"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice").cast("double")).alias("score")).alias("domain"), F.col("o_orderpriority").alias("label"))
    back = wire.unpacked(wire.packed(hits), hits.schema)
    return back.select("hit", "domain.target", "domain.score", "label")


@query("SELECT o_custkey % 50 AS model, count(*)::BIGINT AS nhits, sum(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END)::BIGINT AS nreported FROM orders GROUP BY ALL")
def statistics_roundtrip(spark, d):
    """Counters as JSON and back."""
    from seqloom.sources import wire

    stats = table(spark, d, "orders").groupBy((F.col("o_custkey") % 50).alias("model")).agg(F.count("*").alias("nhits"), F.sum((F.col("o_totalprice") > 100000).cast("bigint")).alias("nreported"))
    kind = stats.schema["model"].dataType.simpleString()
    return stats.select(wire.as_json(F.struct("*")).alias("json")).select(wire.from_json(F.col("json"), f"model {kind}, nhits bigint, nreported bigint").alias("x")).select("x.*")


REQUESTS = "(SELECT n_nationkey AS id, n_name AS name, length(n_name) AS e FROM nation)"


@query(f"SELECT id, 'nation' || id AS name, upper(name) AS seq, CAST(e AS VARCHAR) AS e, CASE WHEN id % 2 = 0 THEN '' END AS maxi, '1..' || id AS ranges, NULL::VARCHAR AS problem FROM {REQUESTS}")
def parse_requests(spark, d):
    """Requests of a search service, one per nation, taken apart."""
    from seqloom.sources import wire

    n = table(spark, d, "nation")
    options = F.concat(F.lit("@--seqdb_ranges 1.."), "n_nationkey", F.lit(" -E "), F.length("n_name"), F.when(F.col("n_nationkey") % 2 == 0, F.lit(" --max")).otherwise(F.lit("")))
    text = F.concat(options, F.lit("\n>nation"), "n_nationkey", F.lit(" a nation\n"), F.upper("n_name"), F.lit("\n//"))
    c = wire.parsed_request(text)
    return n.select(F.col("n_nationkey").alias("id"), c["name"].alias("name"), c["seq"].alias("seq"), c["options"]["-E"].alias("e"), c["options"]["--max"].alias("maxi"), c["options"]["--seqdb_ranges"].alias("ranges"), c["problem"].alias("problem"))


@query("SELECT (doc_id % 4)::BIGINT AS shard, count(*)::BIGINT AS sequences, sum(length(seq))::BIGINT AS residues FROM {DOCS} GROUP BY ALL")
def shard_counts(spark, d):
    """Sequences and residues of each shard of a collection dealt in turn."""
    from seqloom.plans.catalog import docs
    from seqloom.sources import wire

    s = docs(spark, d).select("doc_id", F.length("seq").alias("n"))
    parts = [s.where(wire.of_shard(F.col("doc_id"), k, 4)).agg(F.lit(k).cast("bigint").alias("shard"), F.count("*").alias("sequences"), F.sum("n").alias("residues")) for k in range(4)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.where("sequences > 0")


@query("""SELECT o_orderkey AS rank, rtrim(lpad(format('{:.2g}', o_totalprice::DOUBLE * pow(10, -(o_custkey % 12))), 9, ' ') || ' ' || lpad(printf('%.1f', o_orderkey / 8.0::DOUBLE), 6, ' ') || ' ' || lpad(printf('%.1f', (o_custkey % 40) / 8.0::DOUBLE), 5, ' ') || '  ' || lpad(printf('%.1f', (o_custkey % 16) / 4.0::DOUBLE), 5, ' ') || ' ' || lpad((o_custkey % 7)::VARCHAR, 2, ' ') || '  ' || rpad('target' || o_custkey, 18, ' ') || ' ' || CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '' END) AS line FROM orders""")
def target_report(spark, d):
    from seqloom.sources import report

    o = table(spark, d, "orders")
    hits = o.select(F.col("o_orderkey").alias("rank"), (F.col("o_totalprice").cast("double") * F.concat(F.lit("1e"), -(F.col("o_custkey") % 12)).cast("double")).alias("evalue"), (F.col("o_orderkey") / 8.0).alias("score"), ((F.col("o_custkey") % 40) / 8.0).alias("bias"),
                    ((F.col("o_custkey") % 16) / 4.0).alias("exp"), (F.col("o_custkey") % 7).alias("n"), F.concat(F.lit("target"), "o_custkey").alias("name"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("descr"))
    return report.target_lines(hits)


@query("""WITH x AS (SELECT a.c_custkey AS key, rpad(upper(a.c_mktsegment || a.c_name), 40, '-') AS m, rpad(upper(a.c_mktsegment || 'X' || a.c_name), 40, '-') AS t FROM customer a)
SELECT key, block::INT AS block, substr(m, (block * 16 + 1)::INT, 16) AS model_line, (SELECT string_agg(CASE WHEN substr(m, i::INT, 1) = substr(t, i::INT, 1) THEN substr(m, i::INT, 1) ELSE ' ' END, '' ORDER BY i) FROM (SELECT unnest(range(block * 16 + 1, least(40, block * 16 + 16) + 1)) AS i)) AS match_line,
substr(t, (block * 16 + 1)::INT, 16) AS target_line, substr(m, (block * 16 + 1)::INT, 16) AS pp_line FROM x, (SELECT unnest(range(0, 3)) AS block)""")
def alignment_report(spark, d):
    from seqloom.sources import report

    c = table(spark, d, "customer")
    m, t = F.rpad(F.upper(F.concat("c_mktsegment", "c_name")), 40, "-"), F.rpad(F.upper(F.concat("c_mktsegment", F.lit("X"), "c_name")), 40, "-")
    return report.alignment_blocks(c.select(F.col("c_custkey").alias("key"), m.alias("hmm_line"), t.alias("ali_line"), m.alias("pp_line")), 16)


@query("SELECT max(length(c_name))::INT AS c_name, max(length(c_custkey::VARCHAR))::INT AS c_custkey, max(length(c_mktsegment))::INT AS c_mktsegment FROM customer")
def format_widths(spark, d):
    from seqloom.sources import report

    return report.widths(table(spark, d, "customer"), "c_name", "c_custkey", "c_mktsegment")


def _udtf_sql() -> str:
    from seqloom.plans.catalog import _msv_sql

    scale = 4.328085122666891
    return f"""SELECT p_partkey::BIGINT AS seq_id, round(((xj - floor(-{scale!r} * ln(3.0 / (n + 3)) + 0.5) - 190) / {scale!r} - 3.0 - (n * ln(n / (n + 1)) + ln(1 / (n + 1)))) / ln(2), 6) AS bits
        FROM ({_msv_sql()}) JOIN (SELECT p_partkey, length(seq)::DOUBLE AS n FROM {{PARTS}}) USING (p_partkey)"""


@query(_udtf_sql())
def sql_table_function(spark, d):
    """A search as a table function in SQL."""
    from seqloom.functions import tables
    from seqloom.plans.catalog import parts

    tables.register(spark)
    parts(spark, d).select(F.col("p_partkey").cast("bigint").alias("seq_id"), "seq").createOrReplaceTempView("seqloom_targets")
    return spark.sql("SELECT seq_id, round(bits, 6) AS bits FROM word_search(TABLE(seqloom_targets), 'STEEL')")


# kernels and paths against a model of one word
def _paths(spark, d, make, schema: str, distinct: bool = False):
    """make's rows for part names, or for those that differ: then the smallest p_partkey stands for its copies."""
    from seqloom.operators import kernels as K
    from seqloom.operators import profile as P
    from seqloom.operators import search as R
    from seqloom.plans.catalog import parts, word_model

    p = P.configure(word_model())
    df = parts(spark, d).where("seq <> ''").select("p_partkey", "seq")
    if distinct:
        df = df.groupBy("seq").agg(F.min("p_partkey").alias("p_partkey")).select("p_partkey", "seq")
    names = ["p_partkey", *[c.split(" ")[0] for c in schema.split(", ")]]

    def run(batches):
        import pandas as pd

        from seqloom.functions.alphabet import digitize

        rows = K.once(lambda s: list(make(p, digitize(s))))
        for pdf in batches:
            yield pd.DataFrame([(k, *row) for k, s in zip(pdf.p_partkey, pdf.seq, strict=True) for row in rows(s)], columns=names)

    return R.balanced(df).mapInPandas(run, f"p_partkey {df.schema['p_partkey'].dataType.simpleString()}, {schema}")


@query(SQL["viterbi_score"])
def viterbi_trace_score(spark, d):
    """The best path's score, summed again over its states and steps."""
    from seqloom.operators import tracing

    return _paths(spark, d, lambda p, x: [(round(tracing.path_score(p, x, tracing.viterbi_path(p, x)), 6),)], "score double")


@query(f"WITH RECURSIVE {WORD_CELLS.emissions()}, {WORD_CELLS.sequences()}, {WORD_CELLS.forward()} SELECT p_partkey, round(ln(max(greatest({', '.join(f'm{k}' for k in WORD_CELLS.nodes)}))), 6) AS score FROM f WHERE i > 0 GROUP BY p_partkey")
def hybrid_score(spark, d):
    from seqloom.operators import kernels as K

    return _paths(spark, d, lambda p, x: [(round(float(K.hybrid(p, x[None, :], np.array([len(x)]))[0]), 6),)], "score double")


@query(f"WITH RECURSIVE {WORD_CELLS.emissions()}, {WORD_CELLS.sequences()}, {WORD_CELLS.forward(only=(2, 3, 4))} SELECT p_partkey, round(ln(cc * mv), 6) AS score FROM f WHERE i = n")
def forward_banded(spark, d):
    """Forward over the band of the three inner nodes."""
    from seqloom.operators import kernels as K

    return _paths(spark, d, lambda p, x: [(round(K.forward_banded(p, x, np.full(len(x), 2), np.full(len(x), 4)), 6),)], "score double")


@query()
def viterbi_trace_domains(spark, d):
    """Passages of the best path through the model, with the composition that their states have."""
    from seqloom.operators import tracing

    def make(p, x):
        path = tracing.viterbi_path(p, x)
        return [(n, *dom, round(float(tracing.null2_of_path(p, path)[0]), 6)) for n, dom in enumerate(tracing.path_domains(path), 1)]

    return _paths(spark, d, make, "domain int, first int, last int, first_node int, last_node int, null2_a double")


# other forms of models
@query(f"WITH {NATION_MODEL} SELECT 'nation' || msa_id AS name, k::INT AS k, residue, floor(0.5 + 1000 * log2(p / f))::INT AS score FROM em")
def model_text_v2(spark, d):
    """Scores as version 2 text has them."""
    from seqloom.sources import modelforms

    def make(m):
        lines = modelforms.render_v2(m).splitlines()
        at = next(i for i, x in enumerate(lines) if x.startswith("HMM "))
        return [(k, a, int(s)) for k in range(1, m.m + 1) for a, s in zip(AMINO, lines[at + 3 * k].split()[1:21], strict=True)]

    return nation_models(spark, d, make, "k int, residue string, score int")


@query(f"WITH {NATION_MODEL} SELECT 'nation' || msa_id AS name, k::INT AS k, residue, round(p, 5) AS p FROM em")
def model_binary_roundtrip(spark, d):
    from seqloom.sources import modelforms

    def make(m):
        (back,) = modelforms.models_of(modelforms.to_binary(m))
        return [(k, a, round(float(back.mat[k, i]) + 1e-9, 5)) for k in range(1, m.m + 1) for i, a in enumerate(AMINO)]

    return nation_models(spark, d, make, "k int, residue string, p double")


@query("SELECT residue, round(f, 5) AS f FROM {BG}")
def background_file(spark, d):
    from seqloom.sources import modelforms

    _, f = modelforms.parse_background(modelforms.render_background(background("amino")))
    return spark.createDataFrame([(a, round(float(x), 5)) for a, x in zip(AMINO, f, strict=True)], "residue string, f double")


@query(f"WITH {QUANTISED} SELECT 'nation' || msa_id AS name, k::INT AS k, residue, (bias - greatest(0, least(255, bias - sign(x) * floor(abs(x) + 0.5))))::INT AS gain FROM qs")
def ssv_scores(spark, d):
    """What a cell of the ungapped filter adds."""
    def make(m):
        cost, bias = P.quantise_msv(P.configure(m))
        return [(k, a, int(bias - cost[i, k])) for i, a in enumerate(AMINO) for k in range(1, m.m + 1)]

    return nation_models(spark, d, make, "k int, residue string, gain int")


@query(f"""WITH {NATION_MODEL}, ow AS (SELECT msa_id, m, k, CASE WHEN k = m THEN 0 ELSE 1 + trunc(ln(1e-7 / mi) / ln(ii)) END AS own FROM tr WHERE k > 0),
sh AS (SELECT msa_id, m, k, own / sum(own) OVER (PARTITION BY msa_id) AS s FROM ow)
SELECT 'nation' || a.msa_id AS name, a.k::INT AS k, round(CASE WHEN a.k = a.m THEN 0 ELSE sum(CASE WHEN b.k <= a.k THEN b.s ELSE 0 END) END, 6) AS prefix, round(sum(CASE WHEN b.k >= a.k - 1 AND b.k < a.m THEN b.s ELSE 0 END), 6) AS suffix
FROM sh a JOIN sh b ON a.msa_id = b.msa_id GROUP BY a.msa_id, a.k, a.m""")
def window_shares(spark, d):
    """Shares of a match's length before and after each node."""
    return nation_models(spark, d, lambda m: [(k, round(float(a), 6), round(float(b), 6)) for k, (a, b) in enumerate(zip(*P.window_shares(m), strict=True), 1)], "k int, prefix double, suffix double")


@query(f"WITH {NATION_MODEL} SELECT 'nation' || msa_id AS name, round(sum(exp(e) * (m - k + 1)), 6) AS total FROM (SELECT *, ln(occ / sum(occ * (m - k + 1)) OVER (PARTITION BY msa_id)) AS e FROM oc) GROUP BY msa_id")
def profile_validation(spark, d):
    """Local entries, each counted as often as it has exits, sum to one."""
    def make(m):
        e = np.exp(P.configure(m).entry[1:])
        return [(round(float((e * np.arange(m.m, 0, -1)).sum()), 6),)]

    return nation_models(spark, d, make, "total double")


# alignments
@query(f"WITH {NATION_MODEL} SELECT msa_id, k::BIGINT AS k, move, round(CASE WHEN move = 'II' THEN least(n, coalesce(mi, 0) * 2) ELSE n END, 6) AS n FROM (SELECT *, max(CASE WHEN move = 'MI' THEN n END) OVER (PARTITION BY msa_id, k) AS mi FROM (SELECT msa_id, coalesce(fk, 0) AS k, coalesce(fs, 'M') || state AS move, count(*)::DOUBLE AS n FROM sx GROUP BY ALL))")
def insert_cap(spark, d):
    from seqloom.operators import build as B

    states = B.states(*_columns(segments(spark, d)))
    unit = states.select("msa_id", "row_idx").distinct().withColumn("weight", F.lit(1.0))
    return B.capped_inserts(B.transition_counts(states, unit), 2.0).select("msa_id", F.col("k").cast("bigint").alias("k"), "move", r6(F.col("count")).alias("n"))


@query(f"WITH {NATION_MODEL} SELECT msa_id, k::BIGINT AS k, residue, round(n / sum(n) OVER (PARTITION BY msa_id, k), 6) AS p FROM ec")
def renormalised_emissions(spark, d):
    from seqloom.operators import build as B

    cell, columns = _columns(segments(spark, d))
    match = cell.where(B.is_residue(F.col("c"))).join(columns.where("is_match").select("msa_id", "apos", "k"), ["msa_id", "apos"])
    counts = match.groupBy("msa_id", "k", F.col("c").alias("residue")).agg(F.sum("n").cast("double").alias("count"))
    return B.renormalised(counts, "msa_id", "k").select("msa_id", F.col("k").cast("bigint").alias("k"), "residue", r6(F.col("p")).alias("p"))


@query("SELECT c_custkey, regexp_matches(s, '^~*[^~]*~*$') AS valid FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '~~' || c_name || '~' WHEN c_custkey % 3 = 1 THEN c_name || '~' || c_name ELSE c_name END AS s FROM customer)")
def msa_validation(spark, d):
    from seqloom.operators import build as B

    name, k = F.col("c_name"), F.col("c_custkey") % 3
    row = F.when(k == 0, F.concat(F.lit("~~"), name, F.lit("~"))).when(k == 1, F.concat(name, F.lit("~"), name)).otherwise(name)
    return table(spark, d, "customer").select("c_custkey", B.is_valid_row(row).alias("valid"))


@query("SELECT n_nationkey AS msa_id, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS name, CASE WHEN n_nationkey % 2 = 1 THEN 'an alignment has no name' END AS problem FROM nation")
def model_naming(spark, d):
    from seqloom.operators import build as B

    named = table(spark, d, "nation").select(F.col("n_nationkey").alias("msa_id"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("msa_name"))
    return B.model_names(named, file="dir/family.sto").select("msa_id", "name", "problem")


@query("""WITH RECURSIVE t AS (SELECT msa_id, string_agg(aseq, '' ORDER BY row_idx) AS t FROM {MSA} GROUP BY msa_id),
w AS (SELECT msa_id, t, 0 AS i, 0::BIGINT AS v FROM t UNION ALL
      SELECT msa_id, t, i + 1, xor(b, b >> 6) FROM (SELECT *, (a + (a << 10)) & 4294967295 AS b FROM (SELECT *, (v + ascii(substr(t, i + 1, 1))) & 4294967295 AS a FROM w WHERE i < length(t))))
SELECT msa_id, (y + (y << 15)) & 4294967295 AS checksum FROM (SELECT msa_id, xor(x, x >> 11) AS y FROM (SELECT msa_id, (v + (v << 3)) & 4294967295 AS x FROM w WHERE i = length(t)))""")
def msa_checksum(spark, d):
    from seqloom.operators import build as B

    return B.checksum(segments(spark, d))


@query("SELECT p_partkey, substr(s, 1, ceil(length(s) / 2.0)::INT) || repeat('.', 40 - length(s)) || substr(s, ceil(length(s) / 2.0)::INT + 1) AS line FROM (SELECT p_partkey, lower(seq) AS s FROM {PARTS})")
def insert_justification(spark, d):
    from seqloom.operators import build as B
    from seqloom.plans.catalog import parts

    s = F.lower("seq")
    return parts(spark, d).select("p_partkey", B.justified(s, F.lit(40)).alias("line"))


@query(f"WITH {NATION_MODEL} SELECT msa_id, string_agg(CASE WHEN is_match THEN 'x' ELSE '.' END, '' ORDER BY apos) AS rf, string_agg(CASE WHEN is_match AND k % 3 = 0 THEN 'm' ELSE '.' END, '' ORDER BY apos) AS mm FROM mc GROUP BY msa_id")
def msa_annotation(spark, d):
    from seqloom.operators import build as B

    columns = _columns(segments(spark, d))[1]
    return B.annotation_lines(columns, columns.where("is_match AND k % 3 = 0").select("msa_id", "k").distinct())


# statistics, sets and scans
@query(f"WITH {LOGO}, h AS (SELECT msa_id, k, -sum(p * log2(p)) AS h FROM p GROUP BY ALL) SELECT msa_id, round((SELECT -sum(f * log2(f)) FROM {{BG}}) - avg(h), 6) AS info FROM h GROUP BY msa_id")
def mean_match_info(spark, d):
    from seqloom.plans.catalog import _logo

    f = background("amino")
    h0 = float(-(f * np.log2(f)).sum())
    h = _logo(spark, d).groupBy("msa_id", "k").agg((-F.sum(F.col("p") * F.log2("p"))).alias("h"))
    return h.groupBy("msa_id").agg(r6(F.lit(h0) - F.avg("h")).alias("info"))


@query("SELECT DISTINCT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey % 2 = 0")
def set_except(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).subtract(table(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_nationkey").alias("k")))


@query("SELECT source, count(CASE WHEN lang = 'en' THEN 1 END)::BIGINT AS en, count(CASE WHEN lang = 'de' THEN 1 END)::BIGINT AS de, count(CASE WHEN lang = 'fr' THEN 1 END)::BIGINT AS fr FROM documents GROUP BY source")
def pivot_counts(spark, d):
    p = table(spark, d, "documents").groupBy("source").pivot("lang", ["en", "de", "fr"]).agg(F.count(F.lit(1)))
    return p.select("source", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("en", "de", "fr")])


@query("SELECT l_suppkey, round(quantile_cont(l_extendedprice::DOUBLE, 0.5), 4) AS median, round(quantile_cont(l_extendedprice::DOUBLE, 0.9), 4) AS high FROM lineitem GROUP BY l_suppkey")
def exact_percentiles(spark, d):
    q = lambda x: F.round(F.percentile(F.col("l_extendedprice").cast("double"), F.lit(x)), 4)
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(q(0.5).alias("median"), q(0.9).alias("high"))


@query("SELECT coalesce(a.k, b.k) AS k, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey + 5 AS k, count(*)::BIGINT AS n FROM customer GROUP BY ALL) a FULL JOIN (SELECT s_nationkey AS k, count(*)::BIGINT AS n FROM supplier GROUP BY ALL) b ON a.k = b.k")
def full_outer_counts(spark, d):
    a = table(spark, d, "customer").groupBy((F.col("c_nationkey") + 5).alias("k")).agg(F.count("*").alias("customers"))
    return a.join(table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers")), "k", "full")


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp, dayofweek(ts)::INT + 1 AS weekday, date_diff('day', DATE '2020-01-01', ts::DATE)::BIGINT AS days FROM events")
def date_functions(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("stamp"), F.dayofweek("ts").alias("weekday"), F.datediff(F.to_date("ts"), F.lit("2020-01-01").cast("date")).cast("bigint").alias("days"))


@query("SELECT doc_id, floor(start / 50000)::BIGINT AS block FROM (SELECT doc_id, coalesce(sum(length(seq)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM {DOCS})")
def residue_blocks(spark, d):
    """Targets in blocks of about as many residues, in the order of their ids."""
    from seqloom.plans.catalog import cumulative, docs

    s = docs(spark, d).select("doc_id", F.length("seq").cast("bigint").alias("n"))
    return cumulative(s, "doc_id", "n").select("doc_id", F.floor(F.col("start") / 50000).alias("block"))


@query("SELECT page_id, length(regexp_replace(coalesce(html, ''), '[^A-Za-z]', '', 'g'))::BIGINT AS n FROM pages WHERE length(regexp_replace(coalesce(html, ''), '[^A-Za-z]', '', 'g')) > 0")
def target_lengths(spark, d):
    """Lengths of targets found again from their windows."""
    from seqloom.operators import intervals as I

    s = table(spark, d, "pages").select("page_id", F.regexp_replace(F.coalesce("html", F.lit("")), "[^A-Za-z]", "").alias("seq"))
    return I.windows(s, "seq", 400, 100).groupBy("page_id").agg(F.max(F.col("start") + F.length("part") - 1).cast("bigint").alias("n"))


@query(f"WITH {WORD_CELLS.accuracy()} SELECT p_partkey, round(cc, 6) AS accuracy FROM oa WHERE i = n")
def optimal_accuracy_score(spark, d):
    from seqloom.operators import kernels as K

    return _paths(spark, d, lambda p, x: [(round(K.optimal_accuracy(p, K.Posterior(p, x))[0], 6),)], "accuracy double")


@query(SQL["forward_backward_posterior"])
def batched_decoding(spark, d):
    """Forward scores of the batched decoding, and the same total put together from both of its sweeps at the first position."""
    from seqloom.operators import kernels as K
    from seqloom.operators import profile as P_
    from seqloom.plans.catalog import parts, word_model

    p = P_.configure(word_model())
    df = parts(spark, d).where("seq <> ''").select("p_partkey", "seq")

    def run(batches):
        import pandas as pd

        from seqloom.functions.alphabet import digitize

        for pdf in batches:
            found = K.decoded(p, [digitize(s) for s in pdf.seq])
            # every path emits the first residue somewhere, so the posteriors there sum to one
            total = [float(np.log(f.n[1] + f.j[1] + f.c[1] + f.match[1].sum() + f.insert[1].sum())) for f in K.decoded(p, [digitize(s) for s in pdf.seq], full=True)]
            yield pd.DataFrame({"p_partkey": pdf.p_partkey, "forward": [round(f.score, 6) for f in found], "backward": [round(f.score + t, 6) for f, t in zip(found, total, strict=True)]})

    return df.mapInPandas(run, f"p_partkey {df.schema['p_partkey'].dataType.simpleString()}, forward double, backward double")


@query(f"WITH {WORD_CELLS.accuracy()} SELECT p_partkey, round(ln(z), 6) AS forward, round(cc, 6) AS accuracy FROM oa JOIN z USING (p_partkey) WHERE i = n")
def checkpointed_accuracy(spark, d):
    """Forward scores and expected accuracies of part names, decoded in stretches between kept rows."""
    from seqloom.operators import checkpoint

    def both(p, x):
        found = checkpoint.Decoded(p, x)
        return [(round(found.score, 6), round(found.accuracy, 6))]

    return _paths(spark, d, both, "forward double, accuracy double")


def _matrix_sql() -> str:
    from seqloom.sources import matrix

    f = background("amino")
    lam = matrix.scale_of(matrix.parse_matrix(matrix.plain_matrix(5, -4)), f)
    return f"""WITH j AS (SELECT a.residue AS a, b.residue AS b, a.f * b.f * exp({lam!r} * CASE WHEN a.residue = b.residue THEN 5 ELSE -4 END) AS p FROM {{BG}} a CROSS JOIN {{BG}} b)
SELECT a, b, round(p / sum(p) OVER (PARTITION BY a), 6) AS p FROM j""".replace("{BG} a", "(SELECT * FROM {BG}) a").replace("{BG} b", "(SELECT * FROM {BG}) b")


@query(_matrix_sql())
def matrix_conditionals(spark, d):
    """What single-sequence models emit under a matrix of scores."""
    from seqloom.sources import matrix

    f = background("amino")
    joint = matrix.joint_probabilities(matrix.parse_matrix(matrix.plain_matrix(5, -4)), f)
    m = P.single_sequence("all", AMINO, joint)
    return spark.createDataFrame([(a, b, round(float(m.mat[i + 1, j]), 6)) for i, a in enumerate(AMINO) for j, b in enumerate(AMINO)], "a string, b string, p double")


@query("SELECT id, target AS first, row_number() OVER (PARTITION BY target ORDER BY lnp, id)::BIGINT AS rank FROM (SELECT id, target, lnp FROM " + "(SELECT l_suppkey AS target, l_orderkey * 10 + l_linenumber AS id, -l_extendedprice::DOUBLE AS lnp FROM lineitem)" + ") QUALIFY rank <= 3")
def merged_hit_lists(spark, d):
    """The best three hits of each target, from lists that were sorted apart: each list sends its best three, not all."""
    from pyspark.sql import Window

    from seqloom.plans.catalog import spans

    h = spans(spark, d).select("id", "target", "lnp").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(8)))
    best = lambda df, *keys: df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("lnp", "id"))).where("rank <= 3")
    return best(best(h, "target", "part"), "target").select("id", F.col("target").alias("first"), F.col("rank").cast("bigint").alias("rank"))


def _ssv_sql(least: int = 14) -> str:
    """Ungapped stretches by diagonals: sums along each, cut where a sum is lowest so far."""
    p = P.configure(P.single_sequence("word", "STEEL"))
    cost, bias = P.quantise_msv(p)
    rows = ", ".join(f"('{a}', {k}, {int(bias - cost[i, k])})" for i, a in enumerate(AMINO) for k in range(1, p.m + 1))
    return f"""WITH g AS (SELECT * FROM (VALUES {rows}) AS t(r, k, gain)),
c AS (SELECT p_partkey, i - k AS diagonal, i, k, sum(gain) OVER (PARTITION BY p_partkey, i - k ORDER BY i) AS total FROM (SELECT p_partkey, seq, unnest(range(1, length(seq) + 1)) AS i FROM {{PARTS}}) JOIN g ON r = substr(seq, i::INT, 1)),
l AS (SELECT *, least(0, coalesce(min(total) OVER (PARTITION BY p_partkey, diagonal ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS low FROM c),
s AS (SELECT *, total - least(low, total) AS score, sum(CASE WHEN total <= low THEN 1 ELSE 0 END) OVER (PARTITION BY p_partkey, diagonal ORDER BY i) AS part FROM l)
SELECT p_partkey, min(i)::INT AS first, arg_max(i, score * 1000 - i)::INT AS last, arg_max(k, score * 1000 - i)::INT AS node, max(score)::INT AS score FROM s WHERE score > 0 GROUP BY p_partkey, diagonal, part HAVING max(score) >= {least}"""


@query(_ssv_sql())
def ssv_windows(spark, d):
    """Ungapped stretches of part names that resemble a word."""
    from seqloom.operators import kernels as K

    return _paths(spark, d, lambda p, x: K.ssv_windows(p, x, 14), "first int, last int, node int, score int")


# model files
ITEMS = f"(SELECT item_id, {STRIP.format('text')} AS seq FROM benchmark)"


def _item_models(spark, d):
    """A model of each benchmark passage, as a row of a table of models; built in tasks."""
    from seqloom.functions.alphabet import letters
    from seqloom.sources import hmmfile

    def run(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame([hmmfile.record(P.single_sequence(f"item{i}", s)) for i, s in zip(pdf.item_id, pdf.seq, strict=True)])

    items = table(spark, d, "benchmark").select("item_id", letters(F.col("text")).alias("seq")).where("item_id is not null and seq <> ''")
    return items.mapInPandas(run, hmmfile.SCHEMA)


@query(f"SELECT 'item' || item_id AS name, length(seq)::INT AS m, seq AS consensus FROM {ITEMS} WHERE item_id IS NOT NULL AND seq <> ''")
def model_files(spark, d):
    """Models written as binary files by tasks, and read again at their records' places."""
    import uuid

    from seqloom.session import shared_folder
    from seqloom.sources import modelsource

    modelsource.register(spark)
    folder = f"{shared_folder(spark)}/models-{uuid.uuid4().hex}"
    _item_models(spark, d).write.format("profile_models").option("path", folder).mode("append").save()
    back = spark.read.format("profile_models").option("path", folder).option("partbytes", 1 << 18).load()
    return back.select("name", "m", F.array_join(F.transform(F.filter("nodes", lambda n: n["k"] > 0), lambda n: n["consensus"]), "").alias("consensus"))


@query(f"SELECT 'item' || item_id AS name, length(seq)::INT AS m, substr(seq, 1, 1) AS first FROM {ITEMS} WHERE item_id IS NOT NULL AND length(seq) >= 60")
def late_profiles(spark, d):
    """Models pressed into a collection: those that survive by what the first filter reads are read whole, and the likeliest residue of their first node is looked up."""
    import uuid

    from seqloom.session import shared_folder
    from seqloom.sources import modelsource

    folder = f"{shared_folder(spark)}/pressed-{uuid.uuid4().hex}"
    modelsource.press(_item_models(spark, d), folder)
    survivors = modelsource.filter_parts(spark, folder).where("m >= 60").select("name")
    best = F.array_position(F.col("node.mat"), F.array_max(F.col("node.mat"))).cast("int")
    whole = modelsource.rest_of(spark, folder, survivors).withColumn("node", F.filter("nodes", lambda n: n["k"] == 1)[0])
    return whole.select("name", "m", F.substring(F.lit(AMINO), best, F.lit(1)).alias("first"))


# random sequences
@query("SELECT p_partkey, pair, count(*)::BIGINT AS n FROM (SELECT p_partkey, substr(seq, i::INT, 2) AS pair FROM (SELECT p_partkey, seq, unnest(range(1, length(seq))) AS i FROM {PARTS})) GROUP BY ALL")
def pair_shuffles(spark, d):
    """Pairs of neighbouring letters in part names that were shuffled with their pairs kept: those of the names."""
    from seqloom.operators import sampling
    from seqloom.plans.catalog import parts

    s = sampling.shuffled_rows(parts(spark, d).select(F.col("p_partkey").alias("key"), "seq"), "di").where("length(seq) > 1")
    pairs = F.transform(F.sequence(F.lit(1), F.length("seq") - 1), lambda i: F.substring(F.col("seq"), i, F.lit(2)))
    return s.select(F.col("key").alias("p_partkey"), F.explode(pairs).alias("pair")).groupBy("p_partkey", "pair").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, r AS letter, count(*)::BIGINT AS n FROM (SELECT p_partkey, unnest(regexp_extract_all(seq, '.')) AS r FROM {PARTS}) GROUP BY ALL")
def letter_shuffles(spark, d):
    """Letters of part names that were shuffled: those of the names."""
    from seqloom.operators import sampling
    from seqloom.plans.catalog import parts

    s = sampling.shuffled_rows(parts(spark, d).select(F.col("p_partkey").alias("key"), "seq"), "mono")
    return s.select(F.col("key").alias("p_partkey"), F.explode(F.filter(F.split("seq", ""), lambda c: c != "")).alias("letter")).groupBy("p_partkey", "letter").agg(F.count("*").alias("n"))


@query()
def tail_p_values(spark, d):
    """How likely random sequences of twelve letters are to score what part names do against a word's model, in whole bits."""
    from seqloom.operators import kernels as K
    from seqloom.operators import tail
    from seqloom.plans.catalog import word_model

    def bits(p, x):
        n = len(x)
        null = n * np.log(n / (n + 1)) + np.log(1 / (n + 1))
        return [(float(np.floor((K.forward(p, x[None, :], np.array([n]))[0] - null) / np.log(2))),)]

    scores = _paths(spark, d, bits, "bits double", distinct=True).select("bits").distinct()
    found = tail.p_values(tail.samples(spark, word_model(), 12, 2000), scores)
    return found.select("bits", F.round("p", 12).alias("p"), F.round("error", 12).alias("error"))


# part names as one alignment
NAMES16 = "(SELECT p_partkey, rpad(upper(replace(p_name, ' ', '-')), 16, '-') AS aseq FROM part)"


def _names16(spark, d):
    """(rows, columns): part names as rows of sixteen columns, and those columns that at least half of them occupy."""
    from seqloom.operators import build as B

    rows = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("name"), F.rpad(F.upper(F.replace("p_name", F.lit(" "), F.lit("-"))), 16, "-").alias("aseq"))
    share = rows.select(F.posexplode(F.split("aseq", "")).alias("at", "c")).where("c <> ''").groupBy((F.col("at") + 1).alias("apos")).agg(F.avg(B.is_residue(F.col("c")).cast("int")).alias("share"))
    return rows, sorted(r.apos for r in share.where("share >= 0.5").collect())  # sixteen at most


@query(f"""WITH c AS (SELECT p_partkey, k AS apos, substr(aseq, k::INT, 1) AS c FROM {NAMES16}, (SELECT unnest(range(1, 17)) AS k)),
s AS (SELECT apos, avg(CASE WHEN c <> '-' THEN 1 ELSE 0 END) >= 0.5 AS is_match FROM c GROUP BY apos),
n AS (SELECT apos, is_match, sum(is_match::INT) OVER (ORDER BY apos) AS k FROM s), z AS (SELECT max(k) AS m FROM n),
x AS (SELECT p_partkey, k, coalesce(max(CASE WHEN is_match THEN c END), '') AS residue, coalesce(string_agg(lower(c), '' ORDER BY apos) FILTER (NOT is_match AND c <> '-'), '') AS ins FROM c JOIN n USING (apos) GROUP BY ALL),
a AS (SELECT p_partkey, k, residue, ins FROM x UNION ALL SELECT p_partkey, 0, '', '' FROM {NAMES16} WHERE p_partkey NOT IN (SELECT p_partkey FROM x WHERE k = 0)),
w AS (SELECT k, max(length(ins)) AS w FROM a GROUP BY k),
l AS (SELECT p_partkey, k, residue, ins, w, CASE WHEN k = 0 THEN 0 WHEN k = m THEN length(ins) ELSE (length(ins) + 1) // 2 END AS cut FROM a JOIN w USING (k), z)
SELECT p_partkey::VARCHAR AS name, string_agg(residue || substr(ins, 1, cut::INT) || repeat('.', (w - length(ins))::INT) || substr(ins, (cut + 1)::INT), '' ORDER BY k) AS aseq FROM l GROUP BY p_partkey""")
def realigned_rows(spark, d):
    """Part names as an alignment, laid out again by the columns that most of them occupy."""
    from seqloom.operators import mapali

    rows, columns = _names16(spark, d)
    return mapali.realigned(rows, columns).select("name", "aseq")


@query("SELECT p_partkey, CASE WHEN p_size % 12 = 11 THEN 1.0::DOUBLE WHEN p_size % 12 = 10 THEN 0.0::DOUBLE WHEN p_size % 12 = 0 THEN 0.01::DOUBLE ELSE (p_size % 12) / 10.0::DOUBLE END AS p FROM part")
def pp_decode(spark, d):
    """Codes of posteriors, made of part sizes, as probabilities."""
    from seqloom.operators import mapali

    code = F.substring(F.lit("0123456789.*"), (F.col("p_size") % 12 + 1).cast("int"), F.lit(1))
    return table(spark, d, "part").select("p_partkey", mapali.decoded_posterior(code).alias("p"))


@query()
def mapped_alignment(spark, d):
    """Segments of customers as new rows beside the part names that a model was built from."""
    from seqloom.operators import build as B
    from seqloom.operators import mapali
    from seqloom.session import cut

    rows, columns = _names16(spark, d)
    names = rows.groupBy(F.coalesce("aseq", F.lit("-" * 16)).alias("aseq")).agg(F.count("*").alias("n")).withColumn("less", -F.col("n"))
    family = cut(C.numbered(names, ["less", "aseq"], "row_idx").select("row_idx", F.concat(F.lit("row"), "row_idx").alias("name"), "aseq"))  # all different names, frequent ones first
    model = B.from_table("names", family.withColumn("n", F.lit(1)), "".join("x" if k in columns else "." for k in range(1, 17)))
    model.checksum = B.chained_checksum(family)
    new = table(spark, d, "customer").select(F.concat(F.lit("customer"), "c_custkey").alias("name"), F.upper("c_mktsegment").alias("seq"))
    return mapali.with_alignment(new, model, family)


@query("SELECT TRUE AS even")
def hits_alignment(spark, d):
    """Included domains of a search as one alignment: all rows are equally long, posteriors too."""
    from seqloom.operators import build as B
    from seqloom.operators import search as R
    from seqloom.plans.catalog import PART_FILTERS, search_parts

    hits, _ = search_parts(spark, d, R.Config(**PART_FILTERS, e=1000.0, inc_e=500.0, inc_dom_e=500.0), ("STEEL",))
    rows = B.domain_alignment(hits.where("included"), 5)
    return rows.agg((F.count_distinct(F.length("aseq")) + F.count_if(F.length("aseq") != F.length("pp")) <= 1).alias("even"))
