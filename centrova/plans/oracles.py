"""DuckDB SQL for the queries of ``plans.queries``."""

from __future__ import annotations

from centrova.functions.draws import uniform_sql
from centrova.functions.measures import MEASURES
from centrova.plans.queries import K, SEED

EMB = "e AS (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS f FROM embeddings)"

_AGG = {
    "SQRL2": "sum((p.v - c.v) * (p.v - c.v))",
    "L1": "sum(abs(p.v - c.v))",
    "L2": "sqrt(sum((p.v - c.v) * (p.v - c.v)))",
    "COSINE_DISTANCE": "acos(greatest(-1, least(1, sum(p.v * c.v) / (sqrt(sum(p.v * p.v)) * sqrt(sum(c.v * c.v))))) ) / pi()",
}


def _dist(which: str, k: int = K, name: str = "d") -> str:
    return f"{name} AS (SELECT p.id, c.id AS cid, {_AGG[which]} AS d FROM e p JOIN e c ON p.f = c.f WHERE c.id < {k} GROUP BY p.id, c.id)"


BEST = "a AS (SELECT id, cid, d FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, cid) AS r FROM d) WHERE r = 1)"

#: Orders by nation and priority, 0 where there are none, and shares with a prior of 1.
COUNTS = """n AS (SELECT c_nationkey::BIGINT AS id, o_orderpriority AS f, count(*)::DOUBLE AS v FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2),
g AS (SELECT i.id, k.f, coalesce(n.v, 0) AS v FROM (SELECT DISTINCT id FROM n) i CROSS JOIN (SELECT DISTINCT f FROM n) k LEFT JOIN n ON n.id = i.id AND n.f = k.f),
s AS (SELECT id, sum(v) AS s FROM g GROUP BY id),
pr AS (SELECT g.id, g.f, g.v, s.s, (g.v + 1) / (s.s + 5) AS p FROM g JOIN s USING (id)),
pair AS (SELECT a.id AS i, b.id AS j, a.v AS x, b.v AS y, a.p AS p, b.p AS q, a.s AS sx, b.s AS sy, a.s / (a.s + b.s) AS lam FROM pr a JOIN pr b ON a.f = b.f AND a.id < b.id)"""

_JSD = "sum(0.5 * p * ln(2 * p / (p + q)) + 0.5 * q * ln(2 * q / (p + q)))"
_UW = "sum(lam * p * ln(p / (lam * p + (1 - lam) * q)) + (1 - lam) * q * ln(q / (lam * p + (1 - lam) * q)))"
_SQ = "sum((x - y) * (x - y))"
PAIR = {
    "L1": "sum(abs(x - y))",
    "L2": f"sqrt({_SQ})",
    "SQRL2": _SQ,
    "JSM": f"sqrt(greatest(0, {_JSD}))",
    "JSD": _JSD,
    "MKL": "sum(p * ln(p / q))",
    "HELLINGER": "sqrt(sum((sqrt(p) - sqrt(q)) * (sqrt(p) - sqrt(q))))",
    "BHATTACHARYYA_METRIC": "sqrt(greatest(0, 1 - sum(sqrt(p * q))))",
    "BHATTACHARYYA_DISTANCE": "-ln(sum(sqrt(p * q)))",
    "TVD": "sum(abs(p - q)) / 2",
    "LLR": f"max(sx + sy) * {_UW}",
    "REVERSE_MKL": "sum(q * ln(q / p))",
    "UWLLR": _UW,
    "ITAKURA_SAITO": "sum(p / q - ln(p / q) - 1)",
    "REVERSE_ITAKURA_SAITO": "sum(q / p - ln(q / p) - 1)",
    "COSINE_DISTANCE": "acos(greatest(-1, least(1, sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y)))))) / pi()",
    "PROBABILITY_COSINE_DISTANCE": "acos(greatest(-1, least(1, sum(p * q) / (sqrt(sum(p * p)) * sqrt(sum(q * q)))))) / pi()",
    "COSINE_SIMILARITY": "greatest(-1, least(1, sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y)))))",
    "SYMMETRIC_ITAKURA_SAITO": "sum(0.5 * (2 * p / (p + q) - ln(2 * p / (p + q)) - 1) + 0.5 * (2 * q / (p + q) - ln(2 * q / (p + q)) - 1))",
    "RSYMMETRIC_ITAKURA_SAITO": "sum(0.5 * ((p + q) / (2 * p) - ln((p + q) / (2 * p)) - 1) + 0.5 * ((p + q) / (2 * q) - ln((p + q) / (2 * q)) - 1))",
    "SRLRT": f"sqrt(greatest(0, max(sx + sy) * {_UW}))",
    "SRULRT": f"sqrt(greatest(0, {_UW}))",
    "PSL2": "sum((p - q) * (p - q))",
    "PL2": "sqrt(sum((p - q) * (p - q)))",
    "L3": "pow(sum(pow(abs(x - y), 3)), 1.0 / 3)",
    "L4": "pow(sum(pow(abs(x - y), 4)), 0.25)",
    "LINF": "max(abs(x - y))",
    "SQRL1": "pow(sum(abs(x - y)), 2)",
    "SQRL3": "pow(sum(pow(abs(x - y), 3)), 2.0 / 3)",
    "SQRL4": "sqrt(sum(pow(abs(x - y), 4)))",
    "SQRLINF": "pow(max(abs(x - y)), 2)",
}

SUPPLIER = """q AS (SELECT l_suppkey::BIGINT AS id, l_returnflag || l_linestatus AS k, sum(l_quantity)::DOUBLE AS v FROM lineitem GROUP BY 1, 2),
l AS (SELECT q.id, q.v, r.f FROM q JOIN (SELECT k, row_number() OVER (ORDER BY k) - 1 AS f FROM (SELECT DISTINCT k FROM q)) r USING (k))"""

WEIGHTED = f"w AS (SELECT a.id, a.cid, a.d AS f, (a.id % 4 + 1)::DOUBLE AS w FROM a)"

_CORE = f"""WITH {EMB}, {_dist('SQRL2')}, {BEST}, {WEIGHTED},
b AS (SELECT id, cid, w, {{f}} AS f FROM w),
c AS (SELECT cid, count(*)::DOUBLE AS n_c, sum(w) AS w_c, sum(w * f) AS f_c FROM b GROUP BY cid),
t AS (SELECT sum(w_c) AS w_all, sum(f_c) AS f_all FROM c),
s AS (SELECT b.id, b.w, {{s}} AS s FROM b JOIN c USING (cid), t),
m AS (SELECT sum(s) AS mass FROM s), pr AS (SELECT id, w, s / mass AS prob FROM s, m)"""
_ALPHA = f"(16 * ln({K}.0e0) + 32)"
_SENS = {
    "BFL": "(b.w * b.f / f_all + b.w / (w_c * n_c)) / 2",
    "VX": "b.w * b.f / f_all + 1 / n_c",
    "FL": "b.w * b.f / f_all",
    "LBK": f"{_ALPHA} * b.f / (f_all / w_all) + 2 * {_ALPHA} * f_c / (w_c * (f_all / w_all)) + 4 * w_all / w_c",
    "LFKF": f"{_ALPHA} * b.w * (b.f + f_c / w_c) + 2 * f_all / w_c",
}


def _core(method: str) -> str:
    return _CORE.replace("{f}", "f * f" if method == "LFKF" else "f").replace("{s}", _SENS[method])


_RACE = f"ln({uniform_sql('id', 1, SEED)}) / prob"
PLACES = """pe AS (
  SELECT c_custkey::BIGINT + 1000 AS a, c_nationkey::BIGINT + 100 AS b, 1.0::DOUBLE AS w FROM customer
  UNION ALL SELECT n_nationkey::BIGINT + 100, n_regionkey::BIGINT, 2.0::DOUBLE FROM nation
), be AS (SELECT a, b, w FROM pe UNION ALL SELECT b, a, w FROM pe)"""


def _kmeanspp() -> str:
    u = [uniform_sql("id", r, SEED) for r in range(3)]
    dist = "SELECT p.id, c.id AS cid, sum((p.v - c.v) * (p.v - c.v)) AS d FROM e p JOIN e c ON p.f = c.f"
    return f"""WITH {EMB}, ids AS (SELECT DISTINCT id FROM e),
c0 AS (SELECT id FROM ids ORDER BY ln({u[0]}) DESC, id LIMIT 1),
d0 AS ({dist} WHERE c.id IN (SELECT id FROM c0) GROUP BY p.id, c.id),
m0 AS (SELECT id, min(d) AS d FROM d0 GROUP BY id),
c1 AS (SELECT id FROM m0 WHERE d > 0 AND id NOT IN (SELECT id FROM c0) ORDER BY ln({u[1]}) / d DESC, id LIMIT 1),
d1 AS ({dist} WHERE c.id IN (SELECT id FROM c0 UNION ALL SELECT id FROM c1) GROUP BY p.id, c.id),
m1 AS (SELECT id, min(d) AS d FROM d1 GROUP BY id),
c2 AS (SELECT id FROM m1 WHERE d > 0 AND id NOT IN (SELECT id FROM c0 UNION ALL SELECT id FROM c1) ORDER BY ln({u[2]}) / d DESC, id LIMIT 1)
SELECT 0::BIGINT AS place, id FROM c0 UNION ALL SELECT 1, id FROM c1 UNION ALL SELECT 2, id FROM c2"""


def _kcenter() -> str:
    dist = "SELECT p.id, c.id AS cid, sqrt(sum((p.v - c.v) * (p.v - c.v))) AS d FROM e p JOIN e c ON p.f = c.f"
    sql, chosen = f"WITH {EMB}, c0 AS (SELECT 0::BIGINT AS id)", "SELECT id FROM c0"
    for r in range(1, 4):
        sql += f", d{r} AS ({dist} WHERE c.id IN ({chosen}) GROUP BY p.id, c.id), m{r} AS (SELECT id, min(d) AS d FROM d{r} GROUP BY id), c{r} AS (SELECT id FROM m{r} WHERE id NOT IN ({chosen}) ORDER BY d DESC, id LIMIT 1)"
        chosen += f" UNION ALL SELECT id FROM c{r}"
    return sql + " " + " UNION ALL ".join(f"SELECT {r}::BIGINT AS place, id FROM c{r}" for r in range(4))


def _medians(kind: str) -> str:
    if kind == "tvd":
        return f"""WITH {COUNTS}, x AS (SELECT g.id % 3 AS cid, dense_rank() OVER (ORDER BY g.f) - 1 AS feature, g.v / s.s AS v FROM g JOIN s USING (id))
SELECT cid, feature, round(median(v), 6) AS value FROM x GROUP BY cid, feature"""
    if kind == "l1":
        return f"WITH {EMB} SELECT id % 3 AS cid, f::BIGINT AS feature, round(median(v), 6) AS value FROM e GROUP BY 1, 2"
    return f"""WITH {EMB}, x AS (SELECT id % 3 AS cid, f, v, sum((id % 7 + 1)::DOUBLE) AS w FROM e GROUP BY 1, 2, 3),
y AS (SELECT cid, f, v, sum(w) OVER (PARTITION BY cid, f ORDER BY v ROWS UNBOUNDED PRECEDING) AS cum, sum(w) OVER (PARTITION BY cid, f) AS tot FROM x)
SELECT cid, f::BIGINT AS feature, round(min(v), 6) AS value FROM y WHERE cum >= tot / 2 GROUP BY cid, f"""


def oracle_sql() -> dict[str, str]:
    out = {f"assign_{m.lower()}": f"WITH {EMB}, {_dist(m)}, {BEST} SELECT id, cid, round(d, 6) AS cost FROM a" for m in _AGG}
    out |= {f"pairwise_{m.lower()}": f"WITH {COUNTS} SELECT i, j, round({PAIR[m]}, 6) AS dist FROM pair GROUP BY i, j" for m in MEASURES}
    out |= {f"coreset_probs_{m.lower()}": f"{_core(m)} SELECT id, round(prob, 9) AS prob FROM pr" for m in _SENS}
    out |= {"l1_median": _medians("l1"), "weighted_median": _medians("weighted"), "tvd_median": _medians("tvd")}
    out["compare_l1"] = f"WITH {EMB}, {_dist('L1')} SELECT id AS i, cid AS j, round(d, 6) AS dist FROM d"
    out["lloyd_step"] = f"WITH {EMB}, {_dist('SQRL2')}, {BEST} SELECT a.cid, e.f::BIGINT AS feature, round(avg(e.v), 6) AS value FROM a JOIN e USING (id) GROUP BY 1, 2"
    step = "x{r} AS (SELECT a{p}.cid, e.f, avg(e.v) AS v FROM a{p} JOIN e USING (id) GROUP BY 1, 2), d{r} AS (SELECT p.id, c.cid, sum((p.v - c.v) * (p.v - c.v)) AS d FROM e p JOIN x{r} c ON p.f = c.f GROUP BY 1, 2), a{r} AS (SELECT id, cid, d FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, cid) AS n FROM d{r}) WHERE n = 1)"
    out["lloyd_2_iter"] = f"WITH {EMB}, {_dist('SQRL2')}, {BEST.replace('a AS', 'a0 AS', 1)}, {step.replace('{p}', '0').replace('{r}', '1')}, {step.replace('{p}', '1').replace('{r}', '2')} SELECT cid, count(*) AS n, round(sum(d), 4) AS cost FROM a2 GROUP BY cid"
    out["knn_k5"] = f"WITH {EMB}, d AS (SELECT p.id, c.id AS nb, sum((p.v - c.v) * (p.v - c.v)) AS d FROM e p JOIN e c ON p.f = c.f AND p.id <> c.id GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, nb) AS rank FROM d) SELECT id, nb AS neighbour, rank, round(d, 6) AS dist FROM r WHERE rank <= 5"
    out["row_sum"] = f"WITH {EMB} SELECT id, round(sum(v), 6) AS total FROM e GROUP BY id"
    out["row_var"] = f"WITH {EMB} SELECT id, round(var_pop(v), 6) AS variance FROM e GROUP BY id"
    out["col_sum"] = f"WITH {SUPPLIER} SELECT f AS feature, round(sum(v), 6) AS total FROM l GROUP BY f"
    out["col_var"] = f"WITH {SUPPLIER}, n AS (SELECT count(DISTINCT id)::DOUBLE AS n FROM l) SELECT f AS feature, round((sum(v * v) - sum(v) * sum(v) / max(n)) / max(n), 2) AS variance FROM l, n GROUP BY f"
    out["hvg_topn"] = f"WITH {EMB}, n AS (SELECT count(*)::DOUBLE AS n FROM embeddings) SELECT f::BIGINT AS feature, round((sum(v * v) - sum(v) * sum(v) / max(n)) / max(n), 6) AS variance FROM e, n GROUP BY f ORDER BY 2 DESC, 1 LIMIT 10"
    out["nnz_per_row"] = f"WITH {SUPPLIER} SELECT id, count(*) FILTER (v <> 0) AS nnz FROM l GROUP BY id"
    out["counthist"] = "SELECT p_size::BIGINT AS value, count(*) AS n, min(p_partkey) AS first, max(p_partkey) AS last FROM part GROUP BY p_size"
    out["argmaxcount"] = "SELECT id, arg_min(v, (-n, v))::DOUBLE AS mode FROM (SELECT l_orderkey AS id, l_linenumber % 3 AS v, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY id"
    out["coreset_sample_parity"] = f"{_core('BFL')} SELECT id, round(w / (prob * 50), 4) AS weight FROM pr WHERE prob > 0 ORDER BY {_RACE} DESC, id LIMIT 50"
    out["uniform_coreset"] = f"SELECT o_orderkey AS id, round((SELECT count(*) FROM orders) / 100.0e0, 6) AS weight FROM orders ORDER BY ln({uniform_sql('o_orderkey', 0, SEED)}) DESC, id LIMIT 100"
    out["kmeanspp_parity"], out["kcenter_greedy"] = _kmeanspp(), _kcenter()
    out["localsearchpp_delta"] = f"""WITH {EMB}, {_dist('SQRL2')},
o AS (SELECT id, cid, d, row_number() OVER (PARTITION BY id ORDER BY d, cid) AS r FROM d),
b AS (SELECT x.id, x.cid, x.d AS d1, y.d AS d2 FROM o x JOIN o y ON x.id = y.id WHERE x.r = 1 AND y.r = 2),
z AS (SELECT p.id, sum((p.v - c.v) * (p.v - c.v)) AS d FROM e p JOIN e c ON p.f = c.f WHERE c.id = 17 GROUP BY p.id),
g AS (SELECT sum(least(z.d - b.d1, 0)) AS g FROM b JOIN z USING (id))
SELECT cid, round(max(g) + sum(least(z.d, d2) - least(z.d, d1)), 4) AS delta FROM b JOIN z USING (id), g GROUP BY cid"""
    out["soft_responsibilities"] = f"WITH {EMB}, {_dist('SQRL2')}, x AS (SELECT id, cid, exp(-2 * d) AS x FROM d) SELECT id, cid, round(x / sum(x) OVER (PARTITION BY id), 6) AS resp FROM x"
    out["distortion"] = f"""{_core('BFL')}, k AS (SELECT id, w / (prob * 50) AS kw FROM pr WHERE prob > 0 ORDER BY {_RACE} DESC, id LIMIT 50)
SELECT round((SELECT sum(w * f) FROM w), 3) AS full_cost, round((SELECT sum(kw * f) FROM k JOIN w USING (id)), 3) AS estimate"""
    out["erase_empty"] = f"""WITH {SUPPLIER}, x AS (SELECT id, f, greatest(v - 1000, 0) AS v FROM l),
r AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM (SELECT id FROM x GROUP BY id HAVING sum(v) > 0)),
c AS (SELECT f, row_number() OVER (ORDER BY f) - 1 AS n FROM (SELECT f FROM x GROUP BY f HAVING sum(v) > 0))
SELECT r.n AS id, c.n AS feature, round(v, 6) AS value FROM x JOIN r USING (id) JOIN c USING (f)"""
    out["submatrix"] = f"WITH {EMB} SELECT r.place, c.feature, round(e.v, 6) AS value FROM (VALUES (0::BIGINT, 3), (1, 1), (2, 3)) r(place, id) JOIN e ON e.id = r.id JOIN (VALUES (0::BIGINT, 0), (1, 5), (2, 5)) c(feature, f) ON c.f = e.f"
    out["concat"] = f"WITH {SUPPLIER} SELECT p.part, count(*) AS n, round(sum(v), 2) AS total FROM l, (VALUES (0::BIGINT), (1)) p(part) GROUP BY p.part"
    out["normalised_columns"] = f"WITH {SUPPLIER}, n AS (SELECT f, sqrt(sum(v * v)) AS n FROM l GROUP BY f) SELECT f AS feature, round(sum(v / n), 6) AS total FROM l JOIN n USING (f) GROUP BY f"
    out["components"] = f"WITH RECURSIVE {PLACES}, r AS (SELECT DISTINCT a AS id, a AS c FROM be UNION SELECT be.b, r.c FROM r JOIN be ON be.a = r.id AND r.c < 100) SELECT id, min(c) AS component FROM r GROUP BY id"
    out["sssp"] = f"WITH RECURSIVE {PLACES}, r AS (SELECT v::BIGINT AS id, 0.0::DOUBLE AS d, v::BIGINT AS s FROM (VALUES (0), (1)) t(v) UNION SELECT be.b, r.d + be.w, r.s FROM r JOIN be ON be.a = r.id WHERE r.d < 10) SELECT id, round(min(d), 6) AS dist, arg_min(s, (d, s)) AS source FROM r GROUP BY id"
    out["kmedian_exhaustive"] = f"""WITH {COUNTS}, t AS (SELECT a.id AS i, b.id AS j, sum(abs(a.p - b.p)) / 2 AS d FROM pr a JOIN pr b USING (f) GROUP BY 1, 2),
c AS (SELECT x.i AS f1, y.i AS f2, sum(least(x.d, y.d)) AS cost FROM t x JOIN t y ON x.j = y.j AND x.i < y.i GROUP BY 1, 2) SELECT round(min(cost), 6) AS cost FROM c"""
    return out
