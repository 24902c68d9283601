"""SQL for the recursions of a profile over sequences: what the queries of kernels are held against.

A profile of few nodes becomes columns, one or three a node, and positions become the steps of a recursive
query. Sums and products of odds are written out as the definitions have them, with none of the kernels'
batching, scaling or scans.
"""

from __future__ import annotations

import numpy as np

from seqloom.functions.alphabet import AMINO
from seqloom.operators import profile as P
from seqloom.operators.profile import DD, DM, IM, II, MD, MI, MM, Model


class Recursion:
    """Columns and expressions of a model's profile; source is SQL of a table (key, seq)."""

    def __init__(self, model: Model, source: str, key: str):
        self.model, self.source, self.key = model, source, key
        self.p = P.configure(model)
        self.m = self.p.m
        self.nodes = range(1, self.m + 1)
        self.t, self.entry = (np.exp(x).astype(object) for x in (self.p.tsc, self.p.entry))  # plain numbers, written out as such

    def emissions(self) -> str:
        """(r, e1, ...): odds of a residue in each node."""
        rows = ", ".join(f"('{a}', {', '.join(repr(float(np.exp(self.p.msc[i, k]))) for k in self.nodes)})" for i, a in enumerate(AMINO))
        return f"em AS (SELECT * FROM (VALUES {rows}) AS x(r, {', '.join(f'e{k}' for k in self.nodes)}))"

    def sequences(self) -> str:
        return f"s AS (SELECT {self.key}, seq, length(seq) AS n, length(seq) / (length(seq) + 3.0::DOUBLE) AS lp, 3.0::DOUBLE / (length(seq) + 3) AS mv FROM {self.source} WHERE length(seq) > 0)"

    def deletes(self, m, best: bool) -> dict[int, str]:
        """Delete states from this position's match columns m(k)."""
        out = {}
        for k in range(2, self.m + 1):
            terms = [f"{m(j)} * {float(self.t[j, MD] * np.prod(self.t[j + 1 : k, DD]))!r}" for j in range(1, k)]
            out[k] = f"greatest({', '.join(terms)})" if best else " + ".join(terms)
        return out

    def _total(self, terms: list[str], best: bool) -> str:
        return f"greatest({', '.join(terms)})" if best and len(terms) > 1 else f"({' + '.join(terms)})"

    def forward(self, name: str = "f", best: bool = False, only: tuple[int, ...] = ()) -> str:
        """CTE name(key, i, m1.., i1.., d2.., en, nn, jj, bb, cc) in odds; with best, the best path instead of all; only: the nodes of a band."""
        t, m = self.t, self.m
        total = lambda *x: self._total(list(x), best)
        states = [*[f"m{k}" for k in self.nodes], *[f"i{k}" for k in range(1, m)], *[f"d{k}" for k in range(2, m + 1)]]
        new_m = {k: total(*([f"m{k - 1} * {t[k - 1, MM]!r}", f"i{k - 1} * {t[k - 1, IM]!r}"] if k > 1 else []), *([f"d{k - 1} * {t[k - 1, DM]!r}"] if k > 2 else []), f"bb * {self.entry[k]!r}") + f" * e{k}" for k in self.nodes}
        new_i = {k: total(f"m{k} * {t[k, MI]!r}", f"i{k} * {t[k, II]!r}") for k in range(1, m)}
        dele = self.deletes(lambda k: f"m{k}", best)
        if only:
            new_m, new_i, dele = ({k: v if k in only else "0.0::DOUBLE" for k, v in cells.items()} for cells in (new_m, new_i, dele))
        inner = ", ".join([f"{v} AS m{k}" for k, v in new_m.items()] + [f"{v} AS i{k}" for k, v in new_i.items()])
        ends = total(*[f"m{k}" for k in self.nodes], *[f"d{k}" for k in range(2, m + 1)])
        carry = f"{self.key}, seq, n, lp, mv"
        fixed = ["en", "nn", "jj", "bb", "cc"]
        return f"""{name} AS (
    SELECT {carry}, 0 AS i, {', '.join(f'0.0::DOUBLE AS {c}' for c in states)}, 0.0::DOUBLE AS en, 1.0::DOUBLE AS nn, 0.0::DOUBLE AS jj, mv AS bb, 0.0::DOUBLE AS cc FROM s
    UNION ALL
    SELECT {carry}, i, {', '.join(states)}, en, nn, jj, {total('nn', 'jj')} * mv, cc FROM (
        SELECT * REPLACE ({total('jj * lp', 'en * 0.5')} AS jj, {total('cc * lp', 'en * 0.5')} AS cc, nn * lp AS nn) FROM (
            SELECT * REPLACE ({ends} AS en) FROM (
                SELECT {carry}, i, {', '.join(f'm{k}' for k in self.nodes)}, {', '.join(f'i{k}' for k in range(1, m))}, {', '.join(f'{v} AS d{k}' for k, v in dele.items())}, {', '.join(fixed)} FROM (
                    SELECT {carry}, i + 1 AS i, {inner}, {', '.join(fixed)} FROM {name} JOIN em ON r = substr(seq, i + 1, 1) WHERE i < n)))))"""

    def backward(self, name: str = "b") -> str:
        """CTE name(key, i, m1.., i1.., d1.., en, nn, jj, bb, cc) in odds, from the last position down to 0."""
        t, m = self.t, self.m
        states = [*[f"m{k}" for k in self.nodes], *[f"i{k}" for k in range(1, m)], *[f"d{k}" for k in self.nodes]]
        carry = f"{self.key}, seq, n, lp, mv"

        def cells(later, inserts) -> str:
            """States of a position from en, the later match scores and the next inserts."""
            d = {m: "en"}
            for k in range(m - 1, 0, -1):
                d[k] = f"(en + {later(k + 1)} * {t[k, DM]!r} + ({d[k + 1]}) * {t[k, DD]!r})"
            match = {k: f"en + {later(k + 1)} * {t[k, MM]!r} + {inserts(k)} * {t[k, MI]!r} + {d[k + 1]} * {t[k, MD]!r}" for k in range(1, m)} | {m: "en"}
            ins = {k: f"{later(k + 1)} * {t[k, IM]!r} + {inserts(k)} * {t[k, II]!r}" for k in range(1, m)}
            return ", ".join([f"{v} AS m{k}" for k, v in match.items()] + [f"{v} AS i{k}" for k, v in ins.items()] + [f"{d[k]} AS d{k}" for k in self.nodes])

        begin = " + ".join(f"{self.entry[k]!r} * l{k}" for k in self.nodes)
        order = ", ".join(states)
        return f"""{name} AS (
    SELECT {carry}, i, {order}, en, 0.0::DOUBLE AS nn, 0.0::DOUBLE AS jj, 0.0::DOUBLE AS bb, cc FROM (SELECT *, {cells(lambda k: '0.0::DOUBLE', lambda k: '0.0::DOUBLE')} FROM (SELECT *, n AS i, mv * 0.5 AS en, mv AS cc FROM s))
    UNION ALL
    SELECT {carry}, i, {order}, en, nn, jj, bb, cc FROM (
        SELECT {carry}, i, {cells(lambda k: f'l{k}', lambda k: f'p{k}')}, en, nn, jj, bb, cc FROM (
            SELECT *, (cc + jj) * 0.5 AS en FROM (
                SELECT *, nx * lp + bb * mv AS nn, jx * lp + bb * mv AS jj, cx * lp AS cc FROM (
                    SELECT *, {begin} AS bb FROM (
                        SELECT {carry}, i - 1 AS i, {', '.join(f'm{k} * e{k} AS l{k}' for k in self.nodes)}, {', '.join(f'i{k} AS p{k}' for k in range(1, m))}, nn AS nx, jj AS jx, cc AS cx
                        FROM {name} JOIN em ON r = substr(seq, i, 1) WHERE i > 0))))))"""

    def decoded(self) -> str:
        """CTEs up to po(key, i, n, total, u1.. match and v1.. insert posteriors, mocc, gone (N, J, C), btot, etot) for positions 0..n."""
        k = self.key
        match = ", ".join(f"f.m{j} * b.m{j} / z AS u{j}" for j in self.nodes)
        ins = ", ".join(f"f.i{j} * b.i{j} / z AS v{j}" for j in range(1, self.m))
        return f"""RECURSIVE {self.emissions()}, {self.sequences()}, {self.forward()}, {self.backward()},
z AS (SELECT {k}, cc * mv AS z FROM f WHERE i = n),
x AS (SELECT f.{k}, f.i, f.n, z, f.lp, {match}, {ins}, f.bb * b.bb / z AS begins, f.en * b.en / z AS ends, b.nn AS bn, b.jj AS bj, b.cc AS bc, f.nn AS fn, f.jj AS fj, f.cc AS fc
      FROM f JOIN b ON f.{k} = b.{k} AND f.i = b.i JOIN z ON z.{k} = f.{k}),
g AS (SELECT *, pn + pj + pc AS gone FROM (SELECT *, coalesce(lag(fn) OVER w * lp * bn / z, 0) AS pn, coalesce(lag(fj) OVER w * lp * bj / z, 0) AS pj, coalesce(lag(fc) OVER w * lp * bc / z, 0) AS pc FROM x WINDOW w AS (PARTITION BY {k} ORDER BY i))),
po AS (SELECT *, CASE WHEN i = 0 THEN 0 ELSE 1 - gone END AS mocc, coalesce(sum(begins) OVER (PARTITION BY {k} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS btot,
       coalesce(sum(CASE WHEN i > 0 THEN ends END) OVER (PARTITION BY {k} ORDER BY i), 0) AS etot FROM g)"""

    def accuracy(self) -> str:
        """CTEs up to oa(key, i, n, cc): the most residues that a path can be expected to place right, up to each position."""
        k, m = self.key, self.m
        top = lambda *v: f"greatest({', '.join(v)})"
        cells = [*[f"m{j}" for j in self.nodes], *[f"i{j}" for j in range(1, m)], *[f"d{j}" for j in range(2, m + 1)]]
        new_m = {j: top("o.bb", *([f"o.m{j - 1}", f"o.i{j - 1}"] if j > 1 else []), *([f"o.d{j - 1}"] if j > 2 else []), "-1e9") + f" + p.u{j}" for j in self.nodes}
        new_i = {j: top(f"o.m{j}", f"o.i{j}") + f" + p.v{j}" for j in range(1, m)}
        dele = {j: top(*[f"m{q}" for q in range(1, j)], "-1e9") for j in range(2, m + 1)}
        low = ", ".join(f"-1e9::DOUBLE AS {c}" for c in cells)
        return f"""{self.decoded()},
oa AS (
    SELECT {k}, 0 AS i, n, {low}, 0::DOUBLE AS nn, -1e9::DOUBLE AS jj, 0::DOUBLE AS bb, -1e9::DOUBLE AS cc FROM po WHERE i = 0
    UNION ALL
    SELECT {k}, i, n, {', '.join(cells)}, nn + pn, greatest(jj + pj, en), greatest(nn + pn, jj + pj, en), greatest(cc + pc, en) FROM (
        SELECT *, {top(*[f'm{j}' for j in self.nodes], *[f'd{j}' for j in range(2, m + 1)])} AS en FROM (
            SELECT *, {', '.join(f'{v} AS d{j}' for j, v in dele.items())} FROM (
                SELECT o.{k}, p.i, o.n, {', '.join([f'{v} AS m{j}' for j, v in new_m.items()] + [f'{v} AS i{j}' for j, v in new_i.items()])}, o.nn, o.jj, o.cc, p.pn, p.pj, p.pc FROM oa o JOIN po p ON p.{k} = o.{k} AND p.i = o.i + 1))))"""

    def regions(self) -> str:
        """CTEs up to rg(key, first, last), the regions, by a walk over positions."""
        k = self.key
        return f"""{self.decoded()},
wk AS (
    SELECT {k}, 0 AS i, n, -1 AS start, FALSE AS open, -1 AS first, -1 AS last FROM po WHERE i = 0
    UNION ALL
    SELECT {k}, i, n, CASE WHEN last >= 0 THEN -1 ELSE start END, open AND last < 0, first, last FROM (
        SELECT {k}, i, n, start, open, CASE WHEN closes OR (open AND i = n) THEN start ELSE -1 END AS first, CASE WHEN closes OR (open AND i = n) THEN i ELSE -1 END AS last FROM (
            SELECT w.{k}, p.i, p.n, w.open AND p.mocc - (p.etot - q.etot) < 0.1 AS closes,
                   CASE WHEN NOT w.open AND (p.mocc - (p.btot - q.btot) < 0.1 OR w.start < 0) THEN p.i ELSE w.start END AS start,
                   w.open OR p.mocc >= 0.25 AS open
            FROM wk w JOIN po p ON p.{k} = w.{k} AND p.i = w.i + 1 JOIN po q ON q.{k} = w.{k} AND q.i = w.i))),
rg AS (SELECT {k}, first, last FROM wk WHERE last >= 0)"""


def bias_sql(model: Model, source: str, key: str) -> str:
    """CTEs up to bs(key, lnodds): the two-state composition null."""
    f, compo, m = model.bg, P.composition(model), model.m
    stay0, stay1 = 400 / 401, (m / 8) / (m / 8 + 1)
    rows = ", ".join(f"('{a}', {float(compo[i] / f[i])!r})" for i, a in enumerate(AMINO))
    return f"""RECURSIVE od AS (SELECT * FROM (VALUES {rows}) AS x(r, o)),
s AS (SELECT {key}, seq, length(seq) AS n FROM {source} WHERE length(seq) > 0),
w AS (
    SELECT {key}, seq, n, 0 AS i, 0.999::DOUBLE AS a, 0.001::DOUBLE AS b FROM s
    UNION ALL
    SELECT {key}, seq, n, i + 1, a2, b2 * o FROM (
        SELECT *, CASE WHEN i = 0 THEN a ELSE a * {stay0!r} + b * {1 - stay1!r} END AS a2, CASE WHEN i = 0 THEN b ELSE a * {1 - stay0!r} + b * {stay1!r} END AS b2 FROM w WHERE i < n) JOIN od ON r = substr(seq, i + 1, 1)),
bs AS (SELECT {key}, ln(a + b) AS lnodds FROM w WHERE i = n)"""


class CascadeSql:
    """SQL of the counters of a cascade of filters for one calibrated model, without the library's batching: a pass of its own for each stage."""

    def __init__(self, model: Model, source: str, key: str, prefix: str):
        self.model, self.source, self.key, self.x = model, source, key, prefix
        self.r = Recursion(model, source, key)

    def msv(self) -> str:
        """CTE {x}m(key, n, xj, over): the 8-bit ungapped filter."""
        x, r, m = self.x, self.r, self.r.m
        cost, bias = P.quantise_msv(r.p)
        scale = float(3 / np.log(2))
        unit = lambda s: int(min(255, max(0, np.floor(-scale * s + 0.5))))
        tbm, tec = unit(np.log(2 / (m * (m + 1)))), unit(np.log(0.5))
        rows = ", ".join(f"('{a}', {', '.join(str(cost[i, k]) for k in r.nodes)})" for i, a in enumerate(AMINO))
        before = lambda k: f"d{k - 1}" if k > 1 else "0"
        cells = ", ".join(f"greatest(0, least(255, greatest({before(k)}, b) + {bias}) - c{k}) AS e{k}" for k in r.nodes)
        top = f"greatest({', '.join(f'e{k}' for k in r.nodes)})"
        return f"""{x}c AS (SELECT * FROM (VALUES {rows}) AS t(r, {', '.join(f'c{k}' for k in r.nodes)})),
{x}w AS (
    SELECT {self.key}, seq, n, tjb, 0 AS i, 0 AS j, FALSE AS over, greatest(0, {190 - tbm} - tjb) AS b, {', '.join(f'0 AS d{k}' for k in r.nodes)} FROM (
        SELECT {self.key}, seq, length(seq) AS n, greatest(0, least(255, floor(-{scale!r} * ln(3.0 / (length(seq) + 3)) + 0.5)))::INT AS tjb FROM {self.source} WHERE length(seq) > 0)
    UNION ALL
    SELECT {self.key}, seq, n, tjb, i, nj, over OR {top} >= {255 - bias}, greatest(0, greatest(190, nj) - tjb - {tbm}), {', '.join(f'e{k}' for k in r.nodes)} FROM (
        SELECT *, greatest(j, greatest(0, {top} - {tec})) AS nj FROM (SELECT {self.key}, seq, n, tjb, i + 1 AS i, j, over, {cells} FROM {x}w JOIN {x}c ON r = substr(seq, i + 1, 1) WHERE i < n))),
{x}m AS (SELECT {self.key}, n, over, (j - tjb - 190) / {scale!r} - 3.0 AS nats FROM {x}w WHERE i = n)"""

    def viterbi(self) -> str:
        """CTE {x}v(key, nats): the 16-bit gapped filter."""
        x, r, m = self.x, self.r, self.r.m
        t, e, entry = (P.quantise_viterbi(v) for v in (r.p.tsc, r.p.msc, r.p.entry))
        scale = float(500 / np.log(2))
        half = int(np.floor(scale * np.log(0.5) + 0.5))
        rows = ", ".join(f"('{a}', {', '.join(str(e[i, k]) for k in r.nodes)})" for i, a in enumerate(AMINO))
        top = lambda *v: f"greatest({', '.join(v)})"
        new_m = {k: top(*([f"m{k - 1} + {t[k - 1, MM]}", f"i{k - 1} + {t[k - 1, IM]}"] if k > 1 else []), *([f"d{k - 1} + {t[k - 1, DM]}"] if k > 2 else []), f"b + {entry[k]}", "-99999") + f" + s{k}" for k in r.nodes}
        new_i = {k: top(f"m{k} + {t[k, MI]}", f"i{k} + {t[k, II]}") for k in range(1, m)}
        dele = {k: top(*[f"m{j} + {t[j, MD] + int(t[j + 1 : k, DD].sum())}" for j in range(1, k)], "-99999") for k in range(2, m + 1)}
        names = [*[f"m{k}" for k in r.nodes], *[f"i{k}" for k in range(1, m)], *[f"d{k}" for k in range(2, m + 1)]]
        ends = top(*[f"m{k}" for k in r.nodes], *[f"d{k}" for k in range(2, m + 1)])
        carry = f"{self.key}, seq, n, mv"
        return f"""{x}s AS (SELECT * FROM (VALUES {rows}) AS t(r, {', '.join(f's{k}' for k in r.nodes)})),
{x}z AS (
    SELECT {carry}, 0 AS i, {', '.join(f'-32768 AS {c}' for c in names)}, 12000 + mv AS b, -32768 AS j, -32768 AS c FROM (SELECT {self.key}, seq, length(seq) AS n, floor({scale!r} * ln(3.0 / (length(seq) + 3)) - 0.5 + 1)::INT AS mv FROM {self.source} WHERE length(seq) > 0)
    UNION ALL
    SELECT {carry}, i, {', '.join(names)}, greatest(12000, greatest(j, en + {half})) + mv, greatest(j, en + {half}), greatest(c, en + {half}) FROM (
        SELECT *, {ends} AS en FROM (
            SELECT *, {', '.join(f'{v} AS d{k}' for k, v in dele.items())} FROM (
                SELECT {carry}, i + 1 AS i, {', '.join([f'{v} AS m{k}' for k, v in new_m.items()] + [f'{v} AS i{k}' for k, v in new_i.items()])}, j, c FROM {x}z JOIN {x}s ON r = substr(seq, i + 1, 1) WHERE i < n)))),
{x}v AS (SELECT {self.key}, (c + mv - 12000) / {scale!r} - 3.0 AS vit FROM {x}z WHERE i = n)"""

    def crossings(self, nats: float) -> str:
        """CTE {x}y(key, pos, node): where the gapped filter reaches so many nats and begins anew, in targets of their own length."""
        x, r, m = self.x, self.r, self.r.m
        t, e, entry = (P.quantise_viterbi(v) for v in (r.p.tsc, r.p.msc, r.p.entry))
        scale = float(500 / np.log(2))
        half = int(np.floor(scale * np.log(0.5) + 0.5))
        rows = ", ".join(f"('{a}', {', '.join(str(e[i, k]) for k in r.nodes)})" for i, a in enumerate(AMINO))
        top = lambda *v: f"greatest({', '.join(v)})"
        new_m = {k: top(*([f"m{k - 1} + {t[k - 1, MM]}", f"i{k - 1} + {t[k - 1, IM]}"] if k > 1 else []), *([f"d{k - 1} + {t[k - 1, DM]}"] if k > 2 else []), f"b + {entry[k]}", "-32768") + f" + s{k}" for k in r.nodes}
        new_i = {k: top(f"m{k} + {t[k, MI]}", f"i{k} + {t[k, II]}") for k in range(1, m)}
        dele = {k: top(*[f"m{j} + {t[j, MD] + int(t[j + 1 : k, DD].sum())}" for j in range(1, k)], "-99999") for k in range(2, m + 1)}
        names = [*[f"m{k}" for k in r.nodes], *[f"i{k}" for k in range(1, m)], *[f"d{k}" for k in range(2, m + 1)]]
        carry = f"{self.key}, seq, n, mv, least"
        anew = ", ".join(f"CASE WHEN crossed THEN -32768 ELSE {c} END AS {c}" for c in names)
        return f"""{x}s AS (SELECT * FROM (VALUES {rows}) AS t(r, {', '.join(f's{k}' for k in r.nodes)})),
{x}z AS (
    SELECT {carry}, 0 AS i, {', '.join(f'-32768 AS {c}' for c in names)}, 12000 + mv AS b, -32768 AS j, -32768 AS en, FALSE AS crossed FROM (
        SELECT *, ceil(({nats!r} + 3.0) * {scale!r} - ({half}) - mv + 12000) AS least FROM (
            SELECT {self.key}, seq, length(seq) AS n, floor({scale!r} * ln(3.0 / (length(seq) + 3)) - 0.5 + 1)::INT AS mv FROM {self.source} WHERE length(seq) > 0))
    UNION ALL
    SELECT {carry}, i, {', '.join(names)}, CASE WHEN en >= least THEN b ELSE greatest(12000, greatest(j, en + {half})) + mv END, CASE WHEN en >= least THEN j ELSE greatest(j, en + {half}) END, en, en >= least FROM (
        SELECT *, {top(*[f'm{k}' for k in r.nodes])} AS en FROM (
            SELECT *, {', '.join(f'{v} AS d{k}' for k, v in dele.items())} FROM (
                SELECT {carry}, i + 1 AS i, {', '.join([f'{v} AS m{k}' for k, v in new_m.items()] + [f'{v} AS i{k}' for k, v in new_i.items()])}, b, j FROM (SELECT * REPLACE ({anew}) FROM {x}z) JOIN {x}s ON r = substr(seq, i + 1, 1) WHERE i < n)))),
{x}y AS (SELECT * FROM (SELECT {self.key}, i AS pos, en, unnest([{', '.join(map(str, r.nodes))}]) AS node, unnest([{', '.join(f'm{k}' for k in r.nodes)}]) AS best FROM {x}z WHERE crossed) WHERE best = en)"""

    def forward(self) -> str:
        """CTE {x}f(key, fwd)."""
        x, r = self.x, self.r
        return ", ".join([r.emissions().replace("em AS", f"{x}em AS", 1), r.sequences().replace("s AS", f"{x}sq AS", 1), r.forward(f"{x}fo").replace("FROM s\n", f"FROM {x}sq\n").replace("JOIN em ON", f"JOIN {x}em ON"), f"{x}f AS (SELECT {self.key}, ln(cc * mv) AS fwd FROM {x}fo WHERE i = n)"])

    def bias(self) -> str:
        """CTE {x}b(key, lnodds)."""
        x = self.x
        text = bias_sql(self.model, self.source, self.key).removeprefix("RECURSIVE ")
        for old, new in (("od AS", f"{x}od AS"), ("JOIN od", f"JOIN {x}od"), ("\ns AS", f"\n{x}bq AS"), ("FROM s\n", f"FROM {x}bq\n"), ("\nw AS", f"\n{x}bw AS"), ("FROM w WHERE", f"FROM {x}bw WHERE"), ("\nbs AS", f"\n{x}b AS")):
            text = text.replace(old, new)
        return text

    def counters(self, f1: float, f2: float, f3: float) -> tuple[str, str]:
        """(CTEs, SELECT) of the model's row of counters."""
        x, st, key = self.x, self.model.stats, self.key
        p = lambda v, stage: f"(1 - exp(-exp(-{st[stage + '_lambda']!r} * ({v} / ln(2) - {st[stage + '_mu']!r}))))"
        first = f"(over OR {p('(nats - nul)', 'msv')} <= {f1})"
        second = f"(over OR {p('(nats - nul - lnodds)', 'msv')} <= {f1})"
        third = f"(over OR {p('(nats - nul - lnodds)', 'msv')} <= {f2} OR {p('(vit - nul - lnodds)', 'vit')} <= {f2})"
        fourth = f"(exp(least(0, -{st['fwd_lambda']!r} * ((fwd - nul - lnodds) / ln(2) - {st['fwd_tau']!r}))) <= {f3})"
        ctes = ",\n".join([self.msv(), self.viterbi(), self.forward(), self.bias(), f"{x}a AS (SELECT *, n * ln(n / (n + 1.0::DOUBLE)) + ln(1 / (n + 1.0::DOUBLE)) AS nul FROM {x}m JOIN {x}v USING ({key}) JOIN {x}f USING ({key}) JOIN {x}b USING ({key}))"])
        passed = lambda *tests: f"count(CASE WHEN {' AND '.join(tests)} THEN 1 END)::BIGINT"
        row = f"SELECT '{self.model.name}' AS model, (SELECT count(*) FROM {self.source})::BIGINT AS n, (SELECT sum(length(seq)) FROM {self.source})::BIGINT AS residues, {passed(first)} AS past_msv, {passed(first, second)} AS past_bias, {passed(first, second, third)} AS past_vit, {passed(first, second, third, fourth)} AS past_fwd FROM {x}a"
        return ctes, row
