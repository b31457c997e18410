"""Independent SQL (DuckDB dialect) for every registered query.

Each statement recomputes the fixture from the base tables and the operator
from its definition. Trainers are unrolled: one group of materialised CTEs
per iteration. Doubles are rounded to 6 decimals exactly like the Spark side."""

from __future__ import annotations

import math

from ..sources import fixtures as fx
from . import catalog as C

POS = ", ".join(f"'{p}'" for p in fx.POSITIVE_PRIORITIES)
NEG_ONE, ONE = "-1.0::DOUBLE", "1.0::DOUBLE"


def _w(idx: str) -> str:
    return f"((({idx}) * {fx.FXW_MULT}) % {fx.FXW_MOD} - {fx.FXW_SHIFT})::DOUBLE / {fx.FXW_DIV}"


LAB = f"""lab AS (SELECT o_orderkey + 1 AS row_id,
  CASE WHEN o_orderpriority IN ({POS}) THEN {ONE} ELSE {NEG_ONE} END AS y FROM orders)"""
ENT = f"""ent AS (SELECT l_orderkey + 1 AS row_id, l_suppkey + 1 AS idx,
  sum(l_quantity) / {fx.QUANTITY_SCALE} AS val FROM lineitem GROUP BY 1, 2)"""
FXS = "fxs AS (SELECT e.row_id, l.y, e.idx, e.val FROM ent e JOIN lab l USING (row_id))"
RY = "ry AS (SELECT row_id, any_value(y) AS y FROM fxs GROUP BY row_id)"
DIM = "dim AS (SELECT max(idx) AS d FROM fxs)"
NN = "nn AS (SELECT count(*) AS n FROM ry)"
DW = "dw AS (SELECT idx, sum(y * val) / (SELECT n FROM nn) AS w FROM fxs GROUP BY idx)"
WT = f"wt AS (SELECT idx, {_w('idx')} AS w FROM (SELECT unnest(range(1::BIGINT, d + 1)) AS idx FROM dim))"
FXP = f"""rp AS (SELECT row_id, y, q / sqrt(sum(q * q) OVER ()) AS p
  FROM (SELECT row_id, y, ((row_id * {fx.FXP_MULT}) % {fx.FXP_MOD} + 1)::DOUBLE AS q FROM ry))"""
DENSE = """de AS (SELECT vec_id + 1 AS row_id, CASE WHEN label < 5 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS y,
  generate_subscripts(embedding, 1)::BIGINT AS idx, unnest(embedding)::DOUBLE AS val FROM embeddings)"""
TWO = f"""tw AS (SELECT o_orderkey + 1 AS row_id,
  CASE WHEN o_orderpriority IN ({POS}) THEN {ONE} ELSE {NEG_ONE} END AS y,
  o_totalprice / 100000.0 AS x1, (o_custkey % 10)::DOUBLE / 10.0 AS x2 FROM orders)"""
TWO_LONG = """twl AS (SELECT row_id, y, 1::BIGINT AS idx, x1 AS val FROM tw
  UNION ALL SELECT row_id, y, 2::BIGINT AS idx, x2 AS val FROM tw)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


BASE = [LAB, ENT, FXS, RY, DIM, NN]


def _sigmoid(z: str) -> str:
    return f"(1.0 / (1.0 + exp(-({z}))))"


def _g(z: str) -> str:
    return f"(1.0 / (1.0 + exp({z})))"


def _uniform(key: str, seed: int) -> str:
    return f"(('0x' || substr(md5('{seed}:' || ({key})::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0)"


# --- sources ---------------------------------------------------------------

def parse_sql() -> str:
    return _with(*BASE) + """SELECT row_id, y, (row_number() OVER (PARTITION BY row_id ORDER BY idx) - 1)::BIGINT AS pos,
  idx, round(val, 6) AS val FROM fxs"""


def parse_plain_sql() -> str:
    return _with(*BASE, "ln AS (SELECT row_id, row_number() OVER (ORDER BY row_id) AS line FROM ry)") + """SELECT line, y,
  (row_number() OVER (PARTITION BY row_id ORDER BY idx) - 1)::BIGINT AS pos, idx, round(val, 6) AS val
FROM fxs JOIN ln USING (row_id)"""


def line_ids_sql() -> str:
    return _with(*BASE) + "SELECT row_number() OVER (ORDER BY row_id) AS line, 'row ' || row_id AS value FROM ry"


def parse_edge_sql() -> str:
    return _with(*BASE, """pp AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY idx) - 1 AS up,
  row_number() OVER (PARTITION BY row_id ORDER BY idx DESC) - 1 AS down,
  count(*) OVER (PARTITION BY row_id) AS n FROM fxs)""") + """SELECT row_id, y,
  (CASE WHEN row_id % 5 = 0 THEN down ELSE up END)::BIGINT AS pos, idx, round(val, 6) AS val FROM pp WHERE row_id % 5 <> 4
UNION ALL SELECT row_id, y, n::BIGINT, idx, round(val, 6) FROM pp WHERE row_id % 5 = 1 AND up = 0
UNION ALL SELECT row_id, y, NULL, NULL, NULL FROM ry WHERE row_id % 5 = 4"""


def parse_positional_sql() -> str:
    return _with(DENSE) + "SELECT row_id, y, (idx - 1)::BIGINT AS pos, round(val, 6) AS x FROM de"


def parse_dense_last_wins_sql() -> str:
    return _with(*BASE) + """SELECT row_id, idx,
  round(CASE WHEN idx = min(idx) OVER (PARTITION BY row_id) THEN val + 1 ELSE val END, 6) AS x
FROM fxs WHERE val <> 0"""


# --- scores and coefficients -------------------------------------------------

SCORE_E = f"""se AS (SELECT l.row_id, any_value(l.y) AS y, coalesce(sum(e.val * w.w), 0.0) + {C.BIAS} AS score
  FROM lab l LEFT JOIN ent e USING (row_id) LEFT JOIN wt w ON w.idx = e.idx GROUP BY l.row_id)"""


def score_sparse_sql() -> str:
    return _with(*BASE, WT, SCORE_E) + "SELECT row_id, round(score, 6) AS score FROM se"


def score_dense_sql() -> str:
    return _with(DENSE) + f"SELECT row_id, round(sum(val * {_w('idx')}), 6) AS score FROM de GROUP BY row_id"


def score_shifted_sql() -> str:
    w1, w2 = _w("1"), _w("2")
    return _with(TWO) + f"SELECT row_id, round(({w1} * x1 + {w2} * x2) - {w1} - {w2}, 6) AS score FROM tw"


def coef_gd_sql() -> str:
    return _with(*BASE, WT, SCORE_E) + \
        f"SELECT row_id, round(({_sigmoid('y * score')} - 1.0) * y, 6) AS coef FROM se"


def coef_primal_sql() -> str:
    return _with(*BASE, WT, SCORE_E) + \
        f"SELECT row_id, round({_g('y * score')}, 6) AS g, round(y * {_g('y * score')}, 6) AS coef FROM se"


# --- per-row gradients and sums ------------------------------------------------

DENSE_GRAD = f"""dsc AS (SELECT row_id, any_value(y) AS y, sum(val * {_w('idx')}) AS score FROM de GROUP BY row_id),
dg AS (SELECT de.row_id, (de.idx - 1)::BIGINT AS pos, ({_sigmoid('dsc.y * dsc.score')} - 1.0) * dsc.y * de.val AS g
  FROM de JOIN dsc USING (row_id))"""


def row_grad_dense_sql() -> str:
    return _with(DENSE, DENSE_GRAD) + "SELECT row_id, pos, round(g, 6) AS g FROM dg"


def sum_dense_sql() -> str:
    return _with(DENSE, DENSE_GRAD) + "SELECT pos, round(sum(g), 6) AS g FROM dg GROUP BY pos"


def _sparse_grad_cte(with_bias: bool) -> str:
    b = C.BIAS if with_bias else 0.0
    coef = f"({_sigmoid('s.y * s.score')} - 1.0) * s.y"
    if not with_bias:
        return f"""sc AS (SELECT f.row_id, any_value(f.y) AS y, sum(f.val * w.w) + {b} AS score
  FROM fxs f JOIN wt w USING (idx) GROUP BY f.row_id),
rg AS (SELECT f.row_id, f.idx, {coef} * f.val AS g FROM fxs f JOIN sc s USING (row_id))"""
    return f"""sc AS (SELECT l.row_id, any_value(l.y) AS y, coalesce(sum(e.val * w.w), 0.0) + {b} AS score
  FROM lab l LEFT JOIN ent e USING (row_id) LEFT JOIN wt w ON w.idx = e.idx GROUP BY l.row_id),
rg AS (SELECT e.row_id, e.idx, {coef} * e.val AS g FROM ent e JOIN sc s USING (row_id)
  UNION ALL SELECT s.row_id, 0::BIGINT AS idx, {coef} AS g FROM sc s)"""


def row_grad_sparse_sql() -> str:
    return _with(*BASE, WT, _sparse_grad_cte(False)) + "SELECT row_id, idx, round(g, 6) AS g FROM rg"


def row_grad_bias_sql() -> str:
    return _with(*BASE, WT, _sparse_grad_cte(True)) + "SELECT row_id, idx, round(g, 6) AS g FROM rg"


def sum_sparse_sql() -> str:
    return _with(*BASE, WT, _sparse_grad_cte(False)) + "SELECT idx, round(sum(g), 6) AS g FROM rg GROUP BY idx"


def sum_sparse_bias_sql() -> str:
    return _with(*BASE, WT, _sparse_grad_cte(True)) + "SELECT idx, round(sum(g), 6) AS g FROM rg GROUP BY idx"


def _weighted_cte(active: bool) -> str:
    where = f"WHERE p.p > {float(C.R_ACTIVE)} / (SELECT n FROM nn)" if active else ""
    c = f"s.y * {_g('s.y * s.score')}"
    return f"""ap AS (SELECT p.row_id, p.y, p.p FROM rp p {where}),
sc AS (SELECT a.row_id, any_value(a.y) AS y, any_value(a.p) AS p, sum(f.val * w.w) + {C.BIAS} AS score
  FROM ap a JOIN fxs f USING (row_id) JOIN wt w ON w.idx = f.idx GROUP BY a.row_id),
rg AS (SELECT f.row_id, f.idx, {c} * s.p * f.val AS g FROM fxs f JOIN sc s USING (row_id)
  UNION ALL SELECT s.row_id, 0::BIGINT AS idx, {c} AS g FROM sc s)"""


def row_grad_weighted_sql() -> str:
    return _with(*BASE, WT, FXP, _weighted_cte(False)) + "SELECT row_id, idx, round(g, 6) AS g FROM rg"


def sum_active_sql() -> str:
    return _with(*BASE, WT, FXP, _weighted_cte(True)) + "SELECT idx, round(sum(g), 6) AS g FROM rg GROUP BY idx"


def active_rows_sql() -> str:
    return _with(*BASE, FXP) + \
        f"SELECT row_id, round(p, 6) AS p FROM rp WHERE p > {float(C.R_ACTIVE)} / (SELECT n FROM nn)"


# --- dual ----------------------------------------------------------------------

J = C.J_FIXED
XJ = f"xj AS (SELECT r.row_id, r.y, r.p, coalesce(f.val, 0.0) AS x FROM rp r LEFT JOIN fxs f ON f.row_id = r.row_id AND f.idx = {J})"
WS = f"ws AS (SELECT sum(w * w) AS len, max(CASE WHEN idx = {J} THEN w END) AS wj FROM wt)"
EST = f"""est AS (SELECT xj.row_id, xj.p,
  CASE WHEN ws.wj <> 0 THEN xj.x * ws.len / ws.wj ELSE 0.0 END + {C.BIAS} * xj.y AS s FROM xj, ws)"""


def _factor(s: str) -> str:
    es = f"({C.ETA} * ({s}))"
    return f"(1.0 - {es} + {es} * {es})"


def _clip(s: str, c: float) -> str:
    return f"greatest(least({s}, {c}), -{c})"


DUAL = [*BASE, WT, FXP, XJ, WS, EST]


def dual_lookup_sql() -> str:
    return _with(*BASE, FXP, XJ) + "SELECT row_id, round(x, 6) AS x_j FROM xj"


def dual_estimate_sql() -> str:
    return _with(*DUAL) + "SELECT row_id, round(s, 6) AS s FROM est"


def dual_clip_sql() -> str:
    return _with(*DUAL) + f"SELECT row_id, round({_clip('s', 1.0 / C.ETA)}, 6) AS s FROM est"


def dual_factor_sql() -> str:
    return _with(*DUAL) + f"SELECT row_id, round({_factor(_clip('s', 1.0 / C.ETA))}, 6) AS factor FROM est"


def dual_pairs_sql() -> str:
    return _with(*DUAL) + f"SELECT row_id, round({_factor('s')}, 6) AS factor FROM est"


def dual_count_check_sql() -> str:
    return _with(*DUAL) + """SELECT count(*)::BIGINT AS n_pairs, count(DISTINCT row_id)::BIGINT AS n_distinct,
  (SELECT n FROM nn)::BIGINT AS n_rows,
  (count(*) = (SELECT n FROM nn) AND count(DISTINCT row_id) = (SELECT n FROM nn))::BIGINT AS ok FROM est"""


def step_p_sql() -> str:
    return _with(*DUAL) + f"""SELECT row_id, round(q / sqrt(sum(q * q) OVER ()), 6) AS p
FROM (SELECT row_id, p * {_factor('s')} * (CASE WHEN row_id % 2 = 0 THEN {_factor('s')} ELSE 1.0 END) AS q FROM est)"""


# --- norms, sampling, init -------------------------------------------------------

def l2_norm_sql() -> str:
    return _with(*BASE, WT, FXP) + """SELECT round(sum(w * w), 6) AS w_sumsq, round(sqrt(sum(w * w)), 6) AS w_norm,
  round((SELECT sqrt(sum(p * p)) FROM rp), 6) AS p_norm FROM wt"""


def unit_weights_sql() -> str:
    return _with(*BASE, DW) + "SELECT idx, round(w / sqrt(sum(w * w) OVER ()), 6) AS w FROM dw"


def cum_weight_sql() -> str:
    return _with(*BASE, DW) + \
        "SELECT idx, round(sum(w * w) OVER (ORDER BY idx ROWS UNBOUNDED PRECEDING), 6) AS cum FROM dw"


def _draw_sql(table: str, key: str, weight: str, name: str) -> str:
    return f"""cw AS (SELECT {key} AS k, {weight} AS wt2,
  sum({weight}) OVER (ORDER BY {key} ROWS UNBOUNDED PRECEDING) AS cum, sum({weight}) OVER () AS tot FROM {table}),
dr AS (SELECT range AS draw, range / {float(C.N_DRAWS)} AS u FROM range({C.N_DRAWS}))
SELECT dr.draw, coalesce(min(cw.k) FILTER (WHERE cw.cum > dr.u * cw.tot),
                         (SELECT max(k) FROM cw WHERE wt2 <> 0))::BIGINT AS {name}
FROM dr, cw GROUP BY dr.draw"""


def sample_feature_sql() -> str:
    return _with(*BASE, DW) + ", " + _draw_sql("dw", "idx", "w * w", "idx")


def sample_row_sql() -> str:
    return _with(*BASE, FXP) + ", " + _draw_sql("rp", "row_id", "p * p", "row_id")


def bias_sign_sql() -> str:
    return _with(*BASE, FXP) + "SELECT round(sum(p * y), 6) AS pys, sign(sum(p * y))::DOUBLE AS b FROM rp"


def step_weights_sql() -> str:
    coef = f"({_sigmoid('s.y * s.score')} - 1.0) * s.y"
    return _with(*BASE, WT) + f""", sc AS (SELECT r.row_id, r.y, sum(f.val * w.w) + {C.BIAS} AS score
  FROM ry r JOIN fxs f USING (row_id) JOIN wt w ON w.idx = f.idx GROUP BY r.row_id, r.y),
g AS (SELECT f.idx, sum({coef} * f.val) AS g FROM fxs f JOIN sc s USING (row_id) GROUP BY f.idx)
SELECT w.idx, round(w.w - coalesce(g.g, 0.0), 6) AS w FROM wt w LEFT JOIN g USING (idx)
UNION ALL SELECT 0::BIGINT AS idx, round({C.BIAS} - (SELECT sum({coef}) FROM sc s), 6) AS w"""


def step_row_sql() -> str:
    scale = math.sqrt(2.0 * C.ITERS)
    return _with(*BASE, WT, FXP) + f""", cw AS (SELECT row_id, p * p AS wt2,
  sum(p * p) OVER (ORDER BY row_id ROWS UNBOUNDED PRECEDING) AS cum, sum(p * p) OVER () AS tot FROM rp),
pick AS (SELECT coalesce(min(row_id) FILTER (WHERE cum > {C.U_ROW} * tot),
                         max(row_id) FILTER (WHERE wt2 <> 0)) AS i FROM cw),
one AS (SELECT f.idx, f.val, f.y FROM fxs f WHERE f.row_id = (SELECT i FROM pick)),
sc AS (SELECT any_value(o.y) AS y, sum(o.val * w.w) + {C.BIAS} AS score FROM one o JOIN wt w USING (idx)),
g AS (SELECT o.idx, sum(s.y * {_g('s.y * s.score')} / {scale} * o.val) AS g FROM one o, sc s GROUP BY o.idx)
SELECT w.idx, round(w.w + coalesce(g.g, 0.0), 6) AS w FROM wt w LEFT JOIN g USING (idx)"""


def init_zero_sql() -> str:
    return _with(*BASE) + "SELECT unnest(range(1::BIGINT, d + 1)) AS idx, 0.0::DOUBLE AS w FROM dim"


def init_p_sql() -> str:
    return _with(*BASE) + "SELECT row_id, round(1.0 / sqrt((SELECT n FROM nn)), 6) AS p FROM ry"


def init_uniform_sql() -> str:
    return _with(*BASE) + f"""SELECT idx, round(2.0 * {_uniform('idx', C.SEED)} - 1.0, 6) AS w
FROM (SELECT unnest(range(1::BIGINT, d + 1)) AS idx FROM dim)"""


# --- trainers (unrolled) -----------------------------------------------------------

def _gd_unrolled(entries: str, rows: str, d_expr: str, n_expr: str, *, shifted: bool,
                 fit_bias: bool, uniform: bool) -> tuple[list[str], str, str]:
    """Batch GD over ``entries(row_id, y, idx, val)``; returns the CTEs and
    the names of the final weight table and bias."""
    init = (f"SELECT idx, 2.0 * {_uniform('idx', C.SEED)} - 1.0 AS w" if uniform
            else "SELECT idx, 0.0::DOUBLE AS w")
    ctes = [f"w0 AS MATERIALIZED ({init} FROM (SELECT unnest(range(1::BIGINT, ({d_expr}) + 1)) AS idx))",
            "b0 AS MATERIALIZED (SELECT 0.0::DOUBLE AS b)",
            f"n0 AS MATERIALIZED (SELECT ({n_expr})::DOUBLE AS n)"]
    for t in range(1, C.ITERS + 1):
        p = t - 1
        shift = (f"- (SELECT sum(w) FROM w{p} WHERE idx <= 2)" if shifted
                 else f"+ (SELECT b FROM b{p})")
        ctes.append(f"""s{t} AS MATERIALIZED (SELECT r.row_id, any_value(r.y) AS y,
  coalesce(sum(e.val * w.w), 0.0) {shift} AS score
  FROM {rows} r LEFT JOIN {entries} e ON e.row_id = r.row_id LEFT JOIN w{p} w ON w.idx = e.idx GROUP BY r.row_id)""")
        ctes.append(f"c{t} AS MATERIALIZED (SELECT row_id, ({_sigmoid('y * score')} - 1.0) * y AS c FROM s{t})")
        ctes.append(f"""g{t} AS MATERIALIZED (SELECT e.idx, sum(c.c * e.val) AS g FROM {entries} e
  JOIN c{t} c USING (row_id) GROUP BY e.idx)""")
        ctes.append(f"""w{t} AS MATERIALIZED (SELECT w.idx, w.w + (-1.0 / (SELECT n FROM n0)) * coalesce(g.g, 0.0) AS w
  FROM w{p} w LEFT JOIN g{t} g USING (idx))""")
        nb = (f"(SELECT b FROM b{p}) + (-1.0 / (SELECT n FROM n0)) * (SELECT coalesce(sum(c), 0.0) FROM c{t})"
              if fit_bias else f"(SELECT b FROM b{p})")
        ctes.append(f"b{t} AS MATERIALIZED (SELECT {nb} AS b)")
    return ctes, f"w{C.ITERS}", f"b{C.ITERS}"


def train_shifted_sql() -> str:
    ctes, w, _ = _gd_unrolled("twl", "tw", "2", "SELECT count(*) FROM tw", shifted=True, fit_bias=False,
                              uniform=True)
    return _with(TWO, TWO_LONG, *ctes) + f"SELECT idx, round(w, 6) AS w FROM {w}"


def _gd_trace(ctes: list[str], *base: str, bias: bool) -> str:
    b = lambda t: f", round((SELECT b FROM b{t}), 6) AS b" if bias else ""
    rows = [f"""SELECT {t + 1}::BIGINT AS iter, round((SELECT w FROM w{t} WHERE idx = 1), 6) AS w1,
  round((SELECT w FROM w{t} WHERE idx = 2), 6) AS w2{b(t)}""" for t in range(C.ITERS)]
    return _with(*base, *ctes) + "\nUNION ALL ".join(rows)


def trace_gd_sql() -> str:
    ctes, _, _ = _gd_unrolled("twl", "tw", "2", "SELECT count(*) FROM tw", shifted=True, fit_bias=False, uniform=True)
    return _gd_trace(ctes, TWO, TWO_LONG, bias=False)


def train_gd_sparse_sql() -> str:
    ctes, w, _ = _gd_unrolled("fxs", "ry", "SELECT d FROM dim", "SELECT n FROM nn", shifted=False, fit_bias=False,
                              uniform=True)
    return _with(*BASE, *ctes) + f"SELECT idx, round(w, 6) AS w FROM {w}"


def train_gd_sql() -> str:
    rows = "drw AS (SELECT DISTINCT row_id, y FROM de)"
    ctes, w, _ = _gd_unrolled("de", "drw", "SELECT max(idx) FROM de", "SELECT count(*) FROM drw",
                              shifted=False, fit_bias=False, uniform=True)
    return _with(DENSE, rows, *ctes) + f"SELECT idx, round(w, 6) AS w FROM {w}"


def _t2_ctes():
    return _gd_unrolled("fxs", "ry", "SELECT d FROM dim", "SELECT n FROM nn", shifted=False,
                        fit_bias=True, uniform=False)


def train_gd_bias_sql() -> str:
    ctes, w, b = _t2_ctes()
    return _with(*BASE, *ctes) + f"""SELECT idx, round(w, 6) AS w FROM {w}
UNION ALL SELECT 0::BIGINT AS idx, round(b, 6) AS w FROM {b}"""


def trace_gd_bias_sql() -> str:
    return _gd_trace(_t2_ctes()[0], *BASE, bias=True)


def model_rows_sql() -> str:
    ctes, w, b = _t2_ctes()
    return _with(*BASE, *ctes) + f"""SELECT idx, round(w, 6) AS w FROM {w}
UNION ALL SELECT (SELECT d FROM dim) + 1 AS idx, round(b, 6) AS w FROM {b}"""


def _pick(table: str, key: str, weight: str, u: float, alias: str) -> str:
    """First key whose cumulative weight exceeds u * total; else the last
    key of non-zero weight."""
    return f"""(SELECT coalesce(min(k) FILTER (WHERE cum > {u} * tot), max(k) FILTER (WHERE wt2 <> 0)) AS {alias}
  FROM (SELECT {key} AS k, {weight} AS wt2, sum({weight}) OVER (ORDER BY {key} ROWS UNBOUNDED PRECEDING) AS cum,
               sum({weight}) OVER () AS tot FROM {table}))"""


def _race(table: str, key: str, weight: str, tag: str, alias: str) -> str:
    """Winner of the exponential race with the seeded uniform of ``tag``."""
    u = f"('0x' || substr(md5('{tag}:' || {key}::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0"
    return f"""(SELECT arg_min({key}, -ln(1.0 - {u}) / ({weight})) AS {alias} FROM {table} WHERE {weight} > 0)"""


def _race_draws(table: str, key: str, weight: str, alias: str) -> str:
    u = f"('0x' || substr(md5('{C.RACE_SEED}:' || k || ':' || {key}::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0"
    return f"""SELECT k AS draw, arg_min({key}, -ln(1.0 - {u}) / ({weight})) AS {alias}
FROM {table}, (SELECT unnest(range({C.N_DRAWS})) AS k) WHERE {weight} > 0 GROUP BY k"""


def sample_feature_race_sql() -> str:
    return _with(*BASE, DW) + _race_draws("dw", "idx", "w * w", "j")


def sample_row_race_sql() -> str:
    return _with(*BASE, FXP) + _race_draws("rp", "row_id", "p * p", "i")


def _t3_ctes(r: str = "floor(sqrt((SELECT n FROM ne)))", w_step: str = "1.0", b_step: str = "(1.0 / (SELECT n FROM ne))",
             race: bool = False) -> tuple[list[str], str]:
    """Over every order; those without line items have empty vectors."""
    ctes = ["ne AS (SELECT count(*) AS n FROM lab)",
            "w0 AS MATERIALIZED (SELECT unnest(range(1::BIGINT, (SELECT d FROM dim) + 1)) AS idx, 0.0::DOUBLE AS w)",
            "b0 AS MATERIALIZED (SELECT 0.0::DOUBLE AS b)",
            "p0 AS MATERIALIZED (SELECT row_id, 1.0 / sqrt((SELECT n FROM ne)) AS p FROM lab)"]
    trace = []
    for t in range(1, C.ITERS + 1):
        p = t - 1
        ctes.append(f"""s{t} AS MATERIALIZED (SELECT r.row_id, r.y, q.p,
  coalesce(sum(f.val * w.w), 0.0) + (SELECT b FROM b{p}) AS score
  FROM lab r JOIN p{p} q USING (row_id) LEFT JOIN fxs f ON f.row_id = r.row_id LEFT JOIN w{p} w ON w.idx = f.idx
  WHERE q.p > {r} / (SELECT n FROM ne) GROUP BY r.row_id, r.y, q.p)""")
        ctes.append(f"c{t} AS MATERIALIZED (SELECT row_id, p, y * {_g('y * score')} AS c FROM s{t})")
        ctes.append(f"""g{t} AS MATERIALIZED (SELECT f.idx, sum(c.c * c.p * f.val) AS g FROM fxs f
  JOIN c{t} c USING (row_id) GROUP BY f.idx)""")
        ctes.append(f"""w{t} AS MATERIALIZED (SELECT w.idx, w.w + {w_step} * coalesce(g.g, 0.0) AS w
  FROM w{p} w LEFT JOIN g{t} g USING (idx))""")
        ctes.append(f"""b{t} AS MATERIALIZED (SELECT (SELECT b FROM b{p})
  + {b_step} * (SELECT coalesce(sum(c), 0.0) FROM c{t}) AS b)""")
        pick = (_race(f"w{t}", "idx", "w * w", f"{C.RACE_SEED}:w{t}", "j") if race
                else _pick(f"w{t}", "idx", "w * w", C.U_FEATURE, "j"))
        ctes.append(f"""j{t} AS MATERIALIZED (SELECT k.j, (SELECT sum(w * w) FROM w{t}) AS len,
  (SELECT w FROM w{t} WHERE idx = k.j) AS wj FROM {pick} k)""")
        s = (f"CASE WHEN jj.wj <> 0 THEN coalesce(f.val, 0.0) * jj.len / jj.wj ELSE 0.0 END"
             f" + (SELECT b FROM b{t}) * r.y")
        ctes.append(f"""q{t} AS MATERIALIZED (SELECT r.row_id, q.p * {_factor(s)} AS p
  FROM lab r JOIN p{p} q USING (row_id) CROSS JOIN j{t} jj
  LEFT JOIN fxs f ON f.row_id = r.row_id AND f.idx = jj.j)""")
        ctes.append(f"p{t} AS MATERIALIZED (SELECT row_id, p / sqrt(sum(p * p) OVER ()) AS p FROM q{t})")
        trace.append(f"""SELECT {t}::BIGINT AS iter, round((SELECT w FROM w{t} WHERE idx = 1), 6) AS w1,
  round((SELECT w FROM w{t} WHERE idx = 2), 6) AS w2, round((SELECT b FROM b{t}), 6) AS b,
  (SELECT j FROM j{t})::BIGINT AS j""")
    return ctes, "\nUNION ALL ".join(trace)


def _unit(w: str, b: str) -> str:
    return f""", nrm AS (SELECT sqrt(sum(w * w)) AS r FROM {w})
SELECT idx, round(w / r, 6) AS w FROM {w}, nrm UNION ALL SELECT 0::BIGINT AS idx, round(b / r, 6) AS w FROM {b}, nrm"""


def train_gd_bias_whole_step_sql() -> str:
    ctes, w, b = _gd_unrolled("fxs", "ry", "SELECT d FROM dim", "1", shifted=False, fit_bias=True, uniform=False)
    return _with(*BASE, *ctes).rstrip() + _unit(w, b)


def train_primal_dual_whole_step_sql() -> str:
    ctes, _ = _t3_ctes(w_step="(SELECT n FROM ne)", b_step="1.0")
    return _with(*BASE, *ctes).rstrip() + _unit(f"w{C.ITERS}", f"b{C.ITERS}")


def train_primal_dual_race_sql() -> str:
    return train_primal_dual_sql(race=True)


def train_primal_dual_sql(**how) -> str:
    ctes, _ = _t3_ctes(**how)
    w, b = f"w{C.ITERS}", f"b{C.ITERS}"
    return _with(*BASE, *ctes) + f"""SELECT idx, round(w, 6) AS w FROM {w}
UNION ALL SELECT 0::BIGINT AS idx, round(b, 6) AS w FROM {b}"""


def train_none_active_sql() -> str:
    return _with(*BASE) + """SELECT unnest(range(1::BIGINT, d + 1)) AS idx, 0.0::DOUBLE AS w FROM dim
UNION ALL SELECT 0::BIGINT AS idx, 0.0::DOUBLE AS w"""


def train_trace_sql() -> str:
    ctes, trace = _t3_ctes()
    return _with(*BASE, *ctes) + trace


def _t4_ctes(race: bool = False) -> tuple[list[str], list[str]]:
    scale = math.sqrt(2.0 * C.ITERS)
    clip = 1.0 / C.ETA
    ctes = ["w0 AS MATERIALIZED (SELECT unnest(range(1::BIGINT, (SELECT d FROM dim) + 1)) AS idx, 0.0::DOUBLE AS w)",
            "b0 AS MATERIALIZED (SELECT 0.0::DOUBLE AS b, 0.0::DOUBLE AS b_avg)",
            "p0 AS MATERIALIZED (SELECT row_id, 1.0 / sqrt((SELECT n FROM nn)) AS p FROM ry)"]
    trace = []
    for t in range(1, C.ITERS + 1):
        p = t - 1
        row = (_race(f"p{p}", "row_id", "p * p", f"{C.RACE_SEED}:{t}", "i") if race
               else _pick(f"p{p}", "row_id", "p * p", C.U_ROW, "i"))
        feature = (_race(f"w{t}", "idx", "w * w", f"{C.RACE_SEED}:w{t}", "j") if race
                   else _pick(f"w{t}", "idx", "w * w", C.U_FEATURE, "j"))
        ctes.append(f"i{t} AS MATERIALIZED {row}")
        ctes.append(f"""o{t} AS MATERIALIZED (SELECT f.idx, f.val, f.y FROM fxs f WHERE f.row_id = (SELECT i FROM i{t}))""")
        ctes.append(f"""sc{t} AS MATERIALIZED (SELECT any_value(o.y) AS y,
  sum(o.val * w.w) + (SELECT b FROM b{p}) AS score FROM o{t} o JOIN w{p} w USING (idx))""")
        ctes.append(f"""g{t} AS MATERIALIZED (SELECT o.idx, sum(s.y * {_g('s.y * s.score')} / {scale} * o.val) AS g
  FROM o{t} o, sc{t} s GROUP BY o.idx)""")
        ctes.append(f"""v{t} AS MATERIALIZED (SELECT w.idx, w.w + coalesce(g.g, 0.0) AS w
  FROM w{p} w LEFT JOIN g{t} g USING (idx))""")
        ctes.append(f"""w{t} AS MATERIALIZED (SELECT idx, CASE WHEN nr > 0 THEN w / nr ELSE w END AS w
  FROM v{t}, (SELECT sqrt(sum(w * w)) AS nr FROM v{t}))""")
        ctes.append(f"""b{t} AS MATERIALIZED (SELECT sign(sum(q.p * r.y))::DOUBLE AS b,
  ((SELECT b_avg FROM b{p}) * {t - 1} + sign(sum(q.p * r.y))::DOUBLE) / {t} AS b_avg
  FROM p{p} q JOIN ry r USING (row_id))""")
        ctes.append(f"""j{t} AS MATERIALIZED (SELECT k.j, CASE WHEN (SELECT sum(w * w) FROM w{t}) > 0 THEN 1.0 ELSE 0.0 END AS len,
  (SELECT w FROM w{t} WHERE idx = k.j) AS wj FROM {feature} k)""")
        s = (f"CASE WHEN jj.wj <> 0 THEN coalesce(f.val, 0.0) * jj.len / jj.wj ELSE 0.0 END"
             f" + (SELECT b FROM b{t}) * r.y")
        ctes.append(f"""q{t} AS MATERIALIZED (SELECT r.row_id, q.p * {_factor(_clip(s, clip))} AS p
  FROM ry r JOIN p{p} q USING (row_id) CROSS JOIN j{t} jj
  LEFT JOIN fxs f ON f.row_id = r.row_id AND f.idx = jj.j)""")
        ctes.append(f"p{t} AS MATERIALIZED (SELECT row_id, p / sqrt(sum(p * p) OVER ()) AS p FROM q{t})")
        trace.append(f"SELECT {t}::BIGINT AS iter, b, round(b_avg, 6) AS b_avg FROM b{t}")
    return ctes, trace


def train_sampled_race_sql() -> str:
    return train_sampled_sql(race=True)


def train_sampled_sql(race: bool = False) -> str:
    ctes, _ = _t4_ctes(race)
    return _with(*BASE, *ctes) + f"""SELECT idx, round(w, 6) AS w FROM w{C.ITERS}
UNION ALL SELECT 0::BIGINT AS idx, round(b_avg, 6) AS w FROM b{C.ITERS}"""


def bias_running_mean_sql() -> str:
    ctes, trace = _t4_ctes()
    return _with(*BASE, *ctes) + "\nUNION ALL ".join(trace)


ORACLES: dict[str, str] = {
    "parse_indexed": parse_sql(),
    "parse_plain": parse_plain_sql(),
    "parse_edge": parse_edge_sql(),
    "line_ids": line_ids_sql(),
    "parse_positional": parse_positional_sql(),
    "parse_dense_last_wins": parse_dense_last_wins_sql(),
    "score_sparse": score_sparse_sql(),
    "score_sparse_blocked": score_sparse_sql(),
    "score_dense": score_dense_sql(),
    "score_shifted": score_shifted_sql(),
    "coef_gd": coef_gd_sql(),
    "coef_primal": coef_primal_sql(),
    "row_grad_dense": row_grad_dense_sql(),
    "row_grad_sparse": row_grad_sparse_sql(),
    "row_grad_bias": row_grad_bias_sql(),
    "row_grad_weighted": row_grad_weighted_sql(),
    "row_grad_weighted_blocked": row_grad_weighted_sql(),
    "active_rows": active_rows_sql(),
    "sum_dense": sum_dense_sql(),
    "sum_sparse": sum_sparse_sql(),
    "sum_sparse_bias": sum_sparse_bias_sql(),
    "sum_active": sum_active_sql(),
    "dual_lookup": dual_lookup_sql(),
    "dual_estimate": dual_estimate_sql(),
    "dual_clip": dual_clip_sql(),
    "dual_factor": dual_factor_sql(),
    "dual_pairs": dual_pairs_sql(),
    "dual_count_check": dual_count_check_sql(),
    "l2_norm": l2_norm_sql(),
    "unit_weights": unit_weights_sql(),
    "cum_weight": cum_weight_sql(),
    "sample_feature": sample_feature_sql(),
    "sample_row": sample_row_sql(),
    "sample_feature_race": sample_feature_race_sql(),
    "sample_row_race": sample_row_race_sql(),
    "bias_sign": bias_sign_sql(),
    "bias_running_mean": bias_running_mean_sql(),
    "step_weights": step_weights_sql(),
    "step_row": step_row_sql(),
    "step_p": step_p_sql(),
    "init_zero": init_zero_sql(),
    "init_p": init_p_sql(),
    "init_uniform": init_uniform_sql(),
    "train_shifted": train_shifted_sql(),
    "train_gd": train_gd_sql(),
    "train_gd_sparse": train_gd_sparse_sql(),
    "train_gd_bias": train_gd_bias_sql(),
    "train_gd_bias_blocked": train_gd_bias_sql(),
    "train_none_active": train_none_active_sql(),
    "trace_gd": trace_gd_sql(),
    "trace_gd_bias": trace_gd_bias_sql(),
    "train_gd_bias_whole_step": train_gd_bias_whole_step_sql(),
    "train_primal_dual": train_primal_dual_sql(),
    "train_primal_dual_blocked": train_primal_dual_sql(),
    "train_primal_dual_indexed": train_primal_dual_sql(),
    "train_sampled_indexed": train_sampled_sql(),
    "train_primal_dual_whole_step": train_primal_dual_whole_step_sql(),
    "train_primal_dual_race": train_primal_dual_race_sql(),
    "train_sampled_race": train_sampled_race_sql(),
    "train_sampled": train_sampled_sql(),
    "model_rows": model_rows_sql(),
    "model_text": model_rows_sql(),
    "train_trace": train_trace_sql(),
}
