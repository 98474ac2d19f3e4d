"""Registered queries of the simulation and inference operators, with their DuckDB counterparts.

The tables at hand have no particles, so events and embeddings stand in: each user is a trial, each
event a point placed by its id, each embedding a cylinder placed by its id.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seepkit.functions.geometry import capsule_gap, support
from seepkit.functions.inference import z_value
from seepkit.functions.rng import u01
from seepkit.operators import contact, inference, optimise, percolation
from seepkit.operators.connectivity import components
from seepkit.plans.steps import STEPS, Step, agreement, audit, freeze, gated, marks, run_steps, thaw
from seepkit.sources.shared import is_planning, new_path, saved
from seepkit.sources.tables import table

SEED, REACH, CLOSE = 42, 0.25, 0.05
FILLS = list(range(10, 71, 10))
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def _r(c: Column | str, digits: int = 8) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def _sql_u(key: str) -> str:
    return f"(('0x' || substr(md5('{SEED}:' || {key}), 1, 8))::BIGINT / 4294967296.0)"


Z = z_value(0.05)
_WILSON = "round((k / n + {z} * {z} / (2 * n) - {z} * sqrt(k / n * (1 - k / n) / n + {z} * {z} / (4 * n * n))) / (1 + {z} * {z} / n), 8) AS lo, round((k / n + {z} * {z} / (2 * n) + {z} * sqrt(k / n * (1 - k / n) / n + {z} * {z} / (4 * n * n))) / (1 + {z} * {z} / n), 8) AS hi"
_TAIL = "list_sum(list_transform(range({a}, {b}), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(mid) + (n - i) * ln(1 - mid))))"


def _sql_exact(counts: str, by: str, alpha: float) -> str:
    """Clopper-Pearson by 60 halvings in SQL."""
    low, high = _TAIL.format(a="k", b="n + 1"), _TAIL.format(a="0", b="k + 1")
    return f"""WITH RECURSIVE c AS ({counts}),
    lows AS (SELECT {by}, k, n, 0.0::DOUBLE AS a, 1.0::DOUBLE AS b, 0 AS t FROM c UNION ALL
      SELECT {by}, k, n, CASE WHEN {low} >= {alpha / 2} THEN a ELSE mid END, CASE WHEN {low} >= {alpha / 2} THEN mid ELSE b END, t + 1
      FROM (SELECT *, (a + b) / 2 AS mid FROM lows WHERE t < 60)),
    highs AS (SELECT {by}, k, n, 0.0::DOUBLE AS a, 1.0::DOUBLE AS b, 0 AS t FROM c UNION ALL
      SELECT {by}, k, n, CASE WHEN {high} <= {alpha / 2} THEN a ELSE mid END, CASE WHEN {high} <= {alpha / 2} THEN mid ELSE b END, t + 1
      FROM (SELECT *, (a + b) / 2 AS mid FROM highs WHERE t < 60))
    SELECT c.{by}, c.k, c.n, CASE WHEN c.k = 0 THEN 0.0 ELSE round((l.a + l.b) / 2, 7) END AS lo, CASE WHEN c.k = c.n THEN 1.0 ELSE round((h.a + h.b) / 2, 7) END AS hi
    FROM c JOIN lows l ON l.t = 60 AND l.{by} = c.{by} JOIN highs h ON h.t = 60 AND h.{by} = c.{by}"""


@query(f"SELECT event_id, {_sql_u('event_id::VARCHAR')} AS u FROM events")
def seeded_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events", "event_id").select("event_id", u01(SEED, "event_id").alias("u"))


_FLAGS = "SELECT l_returnflag, count(*) FILTER (l_discount >= 0.05) AS k, count(*) AS n FROM lineitem GROUP BY l_returnflag"


@query(f"SELECT l_returnflag, k, n, {_WILSON.format(z=repr(Z))} FROM ({_FLAGS})")
def wilson_by_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = inference.proportions(table(spark, sf_dir, "lineitem", "l_returnflag", "l_discount"), ["l_returnflag"], F.col("l_discount") >= 0.05)
    return inference.with_wilson(counts).withColumns({"lo": _r("lo"), "hi": _r("hi")})


_USERS = "SELECT user_id, count(*) FILTER (event_type = 'purchase') AS k, count(*) AS n FROM events GROUP BY user_id"


@query(_sql_exact(_USERS, "user_id", 0.05))
def clopper_pearson_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = inference.proportions(table(spark, sf_dir, "events", "user_id", "event_type"), ["user_id"], F.col("event_type") == "purchase")
    return inference.with_clopper_pearson(counts).withColumns({"lo": _r("lo", 7), "hi": _r("hi", 7)})


_TYPES = "SELECT event_type, count(*) FILTER (value > 50) AS k, count(*) AS n FROM events GROUP BY event_type"


@query(f"SELECT event_type, k, n, {_WILSON.format(z=repr(z_value(0.05 / 5)))}, 0.01::DOUBLE AS alpha_each FROM ({_TYPES})")
def bonferroni_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = inference.proportions(table(spark, sf_dir, "events", "event_type", "value"), ["event_type"], F.col("value") > 50)
    return inference.with_bonferroni(counts, 0.05).withColumns({"lo": _r("lo"), "hi": _r("hi"), "alpha_each": _r("alpha_each")})


@query(_sql_exact("SELECT quality, count(*) FILTER (toxic = 1) AS k, count(*) AS n FROM labels GROUP BY quality", "quality", 0.05))
def label_toxic_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = inference.proportions(table(spark, sf_dir, "labels", "quality", "toxic"), ["quality"], F.col("toxic") == 1)
    return inference.with_clopper_pearson(counts).withColumns({"lo": _r("lo", 7), "hi": _r("hi", 7)})


@query("SELECT p_partkey, p_retailprice, p_size FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_retailprice <= a.p_retailprice AND b.p_size >= a.p_size AND (b.p_retailprice < a.p_retailprice OR b.p_size > a.p_size))")
def pareto_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return optimise.pareto_2d(table(spark, sf_dir, "part", "p_partkey", "p_retailprice", "p_size"), "p_retailprice", "p_size")


_SUPPLIERS = "SELECT l_suppkey, round(avg(l_discount), 8) AS discount, round(avg(l_tax), 8) AS tax, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_suppkey"


@query(f"WITH s AS ({_SUPPLIERS}) SELECT * FROM s a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.tax <= a.tax AND b.discount >= a.discount AND b.quantity >= a.quantity AND (b.tax < a.tax OR b.discount > a.discount OR b.quantity > a.quantity))")
def pareto_kd(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem", "l_suppkey", "l_discount", "l_tax", "l_quantity")
    per = rows.groupBy("l_suppkey").agg(_r(F.avg("l_discount")).alias("discount"), _r(F.avg("l_tax")).alias("tax"), F.sum("l_quantity").alias("quantity"))
    return optimise.pareto_kd(per, ["tax"], ["discount", "quantity"])


_WORST = "SELECT l_suppkey, max(tax) AS worst, max(idle) AS other FROM (SELECT l_suppkey, date_trunc('month', l_shipdate) AS m, round(avg(l_tax), 8) AS tax, round(100 - avg(l_quantity), 8) AS idle FROM lineitem GROUP BY 1, 2) GROUP BY 1"


def _scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem", "l_suppkey", "l_shipdate", "l_tax", "l_quantity")
    return rows.groupBy("l_suppkey", F.trunc("l_shipdate", "month").alias("m")).agg(_r(F.avg("l_tax")).alias("tax"), _r(100 - F.avg("l_quantity")).alias("idle"))


@query(f"WITH w AS ({_WORST}) SELECT * FROM w a WHERE NOT EXISTS (SELECT 1 FROM w b WHERE b.worst <= a.worst AND b.other <= a.other AND (b.worst < a.worst OR b.other < a.other))")
def minimax_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return optimise.minimax_front(_scenarios(spark, sf_dir), ["l_suppkey"], "tax", "idle")


@query(f"""WITH w AS ({_WORST}), r AS (SELECT min(worst) a, max(worst) b, min(other) c, max(other) d FROM w)
SELECT l_suppkey, worst, other, round(greatest((worst - a) / (b - a), (other - c) / (d - c)), 8) AS minimax FROM w, r ORDER BY minimax, l_suppkey LIMIT 1""")
def minimax_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    worst = optimise.worst_case(_scenarios(spark, sf_dir), ["l_suppkey"], ["tax", "idle"]).select("l_suppkey", F.col("tax").alias("worst"), F.col("idle").alias("other"))
    return optimise.minimax_point(worst, ["worst", "other"], ["l_suppkey"]).withColumn("minimax", _r("minimax"))


_BOUND = 12.0
_UNITS = "SELECT " + ", ".join(f"round(min(p_retailprice) FILTER (p_size % 3 = {i}) / 1000 + {i}, 2) AS c{i}" for i in range(3)) + " FROM part"


@query(f"WITH u AS ({_UNITS}) SELECT a.x::INT AS x1, b.x::INT AS x2, c.x::INT AS x3, round(a.x * c0 + b.x * c1 + c.x * c2, 8)::DOUBLE AS cost FROM range(30) a(x), range(30) b(x), range(30) c(x), u WHERE a.x * c0 + b.x * c1 + c.x * c2 <= {_BOUND} + 1e-9")
def int_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return optimise.int_scan(spark, _unit_costs(spark, sf_dir), _BOUND).withColumn("cost", _r("cost"))


@query(f"""WITH p AS (SELECT count(*) FILTER (p_size <= 10) AS small, count(*) FILTER (p_size > 40) AS large, count(*) AS n FROM part)
SELECT a.x::INT AS x1, b.x::INT AS x2, round(a.x * 3.0 + b.x * 5.0, 8)::DOUBLE AS cost FROM range(100) a(x), range(100) b(x), p
WHERE a.x * 3.0 + b.x * 5.0 <= 200 AND a.x * small / n + b.x * large / n >= 10 ORDER BY cost, x1, x2 LIMIT 1""")
def design_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    yields = table(spark, sf_dir, "part", "p_size").agg((F.count(F.when(F.col("p_size") <= 10, 1)) / F.count("*")).alias("y1"), (F.count(F.when(F.col("p_size") > 40, 1)) / F.count("*")).alias("y2"))
    designs = optimise.int_scan(spark, [3.0, 5.0], 200.0).join(F.broadcast(yields))  # one row
    return optimise.min_cost(designs, F.col("x1") * F.col("y1") + F.col("x2") * F.col("y2") >= 10, ["x1", "x2"]).select("x1", "x2", _r("cost").alias("cost"))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events", "event_id", "user_id")
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return rows.select(F.col("user_id").alias("trial"), i.alias("i"), "event_id", u01(SEED, "event_id", F.lit("x")).alias("x"), u01(SEED, "event_id", F.lit("y")).alias("y"))


_POINTS = f"SELECT user_id AS trial, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, event_id, {_sql_u('event_id::VARCHAR || ' + chr(39) + ':x' + chr(39))} AS x, {_sql_u('event_id::VARCHAR || ' + chr(39) + ':y' + chr(39))} AS y FROM events"


def _upright(rows: DataFrame, trial: str, i: str, r: float, h: float, place: str | None = None) -> DataFrame:
    """trial, i (or the column ``place``) and body: cylinders with vertical axes, placed in the unit cube by
    their ids."""
    centre = {f"c{k}": u01(SEED, i, F.lit(k)) for k in "xyz"}
    fields = centre | {"ax": F.lit(0.0), "ay": F.lit(0.0), "az": F.lit(1.0), "r": F.lit(r), "h": F.lit(h)}
    return rows.select(F.col(trial).alias("trial"), F.col(place or i).alias("i"), F.struct(*(c.alias(k) for k, c in fields.items())).alias("body"))


def _sql_upright(rows: str, trial: str, key: str, r: float, h: float, tol: float, i: str | None = None) -> str:
    """The same bodies, and their contacts: beside each other by r, above each other by h."""
    at = ", ".join(f"{_sql_u(f'{key}::VARCHAR || {chr(39)}:{k}{chr(39)}')} AS c{k}" for k in "xyz")
    beside, above = f"greatest(0, sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2) - {2 * r!r})", f"greatest(0, abs(a.cz - b.cz) - {2 * h!r})"
    return f"""bodies AS (SELECT {trial} AS trial, {i or key} AS i, {at} FROM {rows}),
touching AS (SELECT * FROM (SELECT a.trial, a.i, b.i AS j, sqrt({beside} ** 2 + {above} ** 2) AS dist FROM bodies a JOIN bodies b ON a.trial = b.trial AND a.i < b.i) WHERE dist <= {tol!r})"""


_EVENT_BODY = (0.05, 0.05, 0.01)
_EVENTS = _sql_upright("events", "user_id", "event_id", *_EVENT_BODY)


@query(f"WITH {_EVENTS} SELECT trial, i, j, round(dist, 5) AS dist FROM touching")
def contact_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, h, tol = _EVENT_BODY
    bodies = _upright(table(spark, sf_dir, "events", "user_id", "event_id"), "user_id", "event_id", r, h)
    return contact.contacts(bodies, tol).withColumn("dist", _r("dist", 5))


@query(f"""WITH RECURSIVE {_EVENTS}, both_ways AS (SELECT i AS src, j AS dst FROM touching UNION ALL SELECT j, i FROM touching),
reach AS (SELECT src AS node, src AS other FROM both_ways UNION SELECT r.node, b.dst FROM reach r JOIN both_ways b ON b.src = r.other)
SELECT node, min(other) AS comp FROM reach GROUP BY node""")
def components_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(contact_pairs(spark, sf_dir), "i", "j")


_THICK = (0.12, 0.1, 0.02)


def _thick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _upright(table(spark, sf_dir, "embeddings", "label", "vec_id"), "label", "vec_id", *_THICK[:2])


@query(f"""WITH RECURSIVE {_sql_upright("embeddings", "label", "vec_id", *_THICK)}, both_ways AS (SELECT trial, i, j FROM touching UNION ALL SELECT trial, j, i FROM touching),
reach AS (SELECT trial, i FROM bodies WHERE cx - {_THICK[0]} <= 0.0 UNION SELECT r.trial, b.j FROM reach r JOIN both_ways b ON b.trial = r.trial AND b.i = r.i),
ends AS (SELECT trial FROM bodies WHERE cx - {_THICK[0]} <= 0.0 UNION SELECT trial FROM bodies WHERE cx + {_THICK[0]} >= 1.0 UNION SELECT trial FROM touching)
SELECT trial, trial IN (SELECT r.trial FROM reach r JOIN bodies b ON b.trial = r.trial AND b.i = r.i WHERE b.cx + {_THICK[0]} >= 1.0) AS hit FROM ends""")
def upright_connected(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = saved(_thick(spark, sf_dir), "bodies")  # read several times, and dear to place
    edges = contact.contact_chains(bodies, _THICK[2])
    return contact.connected(edges, contact.touches(bodies, "x", 0.0, -1), contact.touches(bodies, "x", 1.0, 1))


_CRIT = f"""pts AS ({_POINTS}), e AS (SELECT a.trial, a.i AS s, b.i AS d FROM pts a JOIN pts b ON a.trial = b.trial AND a.i <> b.i AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {REACH * REACH!r}),
walk AS (SELECT trial, i AS node, i AS m FROM pts WHERE x <= {REACH} UNION SELECT w.trial, e.d, greatest(w.m, e.d) FROM walk w JOIN e ON e.trial = w.trial AND e.s = w.node),
crit AS (SELECT t.trial, c.crit FROM (SELECT DISTINCT trial FROM pts) t LEFT JOIN (SELECT w.trial, min(w.m) + 1 AS crit FROM walk w JOIN pts p ON p.trial = w.trial AND p.i = w.node AND p.x >= {1 - REACH} GROUP BY w.trial) c ON c.trial = t.trial)"""


@query(f"WITH RECURSIVE {_CRIT} SELECT trial, crit FROM crit")
def critical_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percolation.critical_fill(_points(spark, sf_dir), REACH)


@query(f"WITH RECURSIVE {_CRIT} SELECT trial, crit FROM crit")
def point_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by bottlenecks of spanning forests."""
    return percolation.point_fill(_points(spark, sf_dir), REACH)


@query(f"WITH RECURSIVE {_CRIT} SELECT trial, CASE WHEN crit <= 40 THEN crit END AS crit FROM crit")
def prefix_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percolation.critical_fill(percolation.prefix(_points(spark, sf_dir), 40), REACH)


_SAMPLE = ", ".join(f"{_sql_u(f'trial::VARCHAR || {chr(39)}:{chr(39)} || i::VARCHAR || {chr(39)}:{k}{chr(39)}')} AS {k}" for k in "xyzuv")


@query(f"""SELECT trial, i, round(2.0 * x, 6) AS cx, round(2.0 * y, 6) AS cy, round(2.0 * z, 6) AS cz, round(sqrt(1 - (2 * u - 1) ** 2) * cos(2 * {math.pi!r} * v), 6) AS ax,
round(sqrt(1 - (2 * u - 1) ** 2) * sin(2 * {math.pi!r} * v), 6) AS ay, round(2 * u - 1, 6) AS az FROM (SELECT trial, i, {_SAMPLE}
FROM (SELECT trial, unnest(range(n))::INT AS i FROM (SELECT c_nationkey AS trial, count(*) AS n FROM customer GROUP BY 1)) WHERE i < 40)""")
def sampled_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation is a trial, with as many cylinders as it has customers; of each the design of the first 40."""
    trials = table(spark, sf_dir, "customer", "c_nationkey").groupBy(F.col("c_nationkey").alias("trial")).agg(F.count("*").alias("n"))
    made = percolation.prefix(percolation.place_cylinders(trials, SEED, box=2.0), 40)
    return made.select("trial", "i", *(_r(f"body.{f}", 6).alias(f) for f in ("cx", "cy", "cz", "ax", "ay", "az")))


@query(f"WITH RECURSIVE {_CRIT} SELECT trial, coalesce(crit <= 30, false) AS hit FROM crit")
def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percolation.spans(critical_fill(spark, sf_dir), 30)


@query(f"WITH RECURSIVE {_CRIT} SELECT trial, true AS agree FROM crit")
def spans_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans by incremental union-find, against components of the contact graph of the same design."""
    points = saved(percolation.prefix(_points(spark, sf_dir), 30), "points")  # read several times
    edges = percolation.point_contacts(points, REACH)
    hits = contact.connected(edges, points.filter(F.col("x") <= REACH).select("trial", "i"), points.filter(F.col("x") >= 1 - REACH).select("trial", "i"))
    graph = points.select("trial").distinct().join(hits, "trial", "left").select("trial", F.coalesce("hit", F.lit(False)).alias("hit"))
    return agreement(percolation.spans(percolation.critical_fill(points, REACH), 30), graph, ["trial"])


_CURVE = f"SELECT n_fill, count(*) FILTER (crit <= n_fill) AS k, count(*) AS trials FROM crit, unnest({FILLS}::BIGINT[]) f(n_fill) GROUP BY n_fill"


@query(f"WITH RECURSIVE {_CRIT} SELECT *, round(k / trials, 8) AS p_hat FROM ({_CURVE})")
def percolation_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percolation.percolation_curve(critical_fill(spark, sf_dir), FILLS).withColumn("p_hat", _r("p_hat"))


_TUBE = (0.11, 0.11, 0.01)
_PLACED = "(SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place FROM events)"
_FILL = f"""{_sql_upright(_PLACED, "user_id", "event_id", *_TUBE, i="place")},
steps AS (SELECT trial, i AS s, j AS d FROM touching UNION ALL SELECT trial, j, i FROM touching),
walk AS (SELECT trial, i AS node, i AS m FROM bodies WHERE cx - {_TUBE[0]!r} <= {_TUBE[2]!r} UNION SELECT w.trial, e.d, greatest(w.m, e.d) FROM walk w JOIN steps e ON e.trial = w.trial AND e.s = w.node),
crit AS (SELECT t.trial, c.crit FROM (SELECT DISTINCT trial FROM bodies) t LEFT JOIN (SELECT w.trial, min(w.m) + 1 AS crit FROM walk w JOIN bodies b ON b.trial = w.trial AND b.i = w.node AND b.cx + {_TUBE[0]!r} >= 1 - {_TUBE[2]!r} GROUP BY w.trial) c ON c.trial = t.trial)"""


def _tubes(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = _points(spark, sf_dir).select("trial", "i", "event_id")
    return _upright(placed, "trial", "event_id", *_TUBE[:2], place="i")


@query(f"WITH RECURSIVE {_FILL} SELECT trial, crit FROM crit")
def cylinder_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upright cylinders, each user's events in order, until they join two faces of the unit cube."""
    return percolation.cylinder_fill(_tubes(spark, sf_dir), _TUBE[2])


@query(f"WITH RECURSIVE {_FILL} SELECT *, round(k / trials, 8) AS p_hat FROM ({_CURVE})")
def cylinder_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percolation.percolation_curve(cylinder_fill(spark, sf_dir), FILLS).withColumn("p_hat", _r("p_hat"))


_LEVEL = 0.05 / len(FILLS)


@query(f"""WITH RECURSIVE {_CRIT}, c AS (SELECT n_fill, k, trials AS n FROM ({_CURVE})),
lows AS (SELECT n_fill, k, n, 0.0::DOUBLE AS a, 1.0::DOUBLE AS b, 0 AS t FROM c WHERE k > 0 UNION ALL
SELECT n_fill, k, n, CASE WHEN p >= {_LEVEL} THEN a ELSE mid END, CASE WHEN p >= {_LEVEL} THEN mid ELSE b END, t + 1
FROM (SELECT *, {_TAIL.format(a="k", b="n + 1")} AS p FROM (SELECT *, (a + b) / 2 AS mid FROM lows WHERE t < 60)))
SELECT min(n_fill) AS n_fill FROM lows WHERE t = 60 AND (a + b) / 2 >= 0.5""")
def min_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.min_fill(percolation.percolation_curve(critical_fill(spark, sf_dir), FILLS), 0.5)


def _bodies(spark: SparkSession, sf_dir: str, r: float = 0.05, h: float = 0.15) -> DataFrame:
    ids = table(spark, sf_dir, "embeddings", "vec_id", "label")

    def u(k: str) -> Column:
        return u01(SEED, "vec_id", F.lit(k))

    z, phi = 2 * u("u") - 1, 2 * math.pi * u("v")
    s = F.sqrt(1 - z * z)
    fields = {"cx": u("x"), "cy": u("y"), "cz": u("z"), "ax": s * F.cos(phi), "ay": s * F.sin(phi), "az": z, "r": F.lit(r), "h": F.lit(h)}
    return ids.select(F.col("label").alias("trial"), F.col("vec_id").alias("i"), F.struct(*(v.alias(k) for k, v in fields.items())).alias("body"))


def _sql_v(k: str) -> str:
    return _sql_u(f"vec_id::VARCHAR || ':{k}'")


_BODIES = f"""bodies AS (SELECT trial, i, cx, cy, cz, sqrt(1 - z * z) * cos(phi) AS ax, sqrt(1 - z * z) * sin(phi) AS ay, z AS az, 0.05 AS r, 0.15 AS h
FROM (SELECT label AS trial, vec_id AS i, {_sql_v('x')} AS cx, {_sql_v('y')} AS cy, {_sql_v('z')} AS cz, 2 * {_sql_v('u')} - 1 AS z, 2 * {math.pi!r} * {_sql_v('v')} AS phi FROM embeddings))"""


@query(f"""WITH {_BODIES}, s AS (SELECT *, 0.6 * ax + 0.8 * az AS g FROM bodies), t AS (SELECT *, 0.6 - g * ax AS px, 0.0 - g * ay AS py, 0.8 - g * az AS pz FROM s)
SELECT i, round(cx + (CASE WHEN g >= 0 THEN h ELSE -h END) * ax + r / sqrt(px * px + py * py + pz * pz) * px, 6) AS x,
round(cy + (CASE WHEN g >= 0 THEN h ELSE -h END) * ay + r / sqrt(px * px + py * py + pz * pz) * py, 6) AS y,
round(cz + (CASE WHEN g >= 0 THEN h ELSE -h END) * az + r / sqrt(px * px + py * py + pz * pz) * pz, 6) AS z FROM t""")
def support_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = support(F.col("body"), F.lit(0.6), F.lit(0.0), F.lit(0.8))
    return _bodies(spark, sf_dir).withColumn("p", p).select("i", *(_r(f"p.{a}", 6).alias(a) for a in "xyz"))


_AT = "(ww + ({s}) * ({s}) + ({t}) * ({t}) - 2 * ({s}) * ({t}) * ab + 2 * ({s}) * aw - 2 * ({t}) * bw)"


@query(f"""WITH {_BODIES}, d AS (SELECT a.i, b.i AS j, a.h, a.r, a.ax * b.ax + a.ay * b.ay + a.az * b.az AS ab,
a.ax * (a.cx - b.cx) + a.ay * (a.cy - b.cy) + a.az * (a.cz - b.cz) AS aw, b.ax * (a.cx - b.cx) + b.ay * (a.cy - b.cy) + b.az * (a.cz - b.cz) AS bw,
(a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2 + (a.cz - b.cz) ** 2 AS ww FROM bodies a JOIN bodies b ON b.i = a.i + 1),
e AS (SELECT *, (ab * bw - aw) / (1 - ab * ab) AS s0, (bw - ab * aw) / (1 - ab * ab) AS t0,
least({_AT.format(s='h', t='greatest(-h, least(h, bw + h * ab))')}, {_AT.format(s='-h', t='greatest(-h, least(h, bw - h * ab))')}, {_AT.format(s='greatest(-h, least(h, h * ab - aw))', t='h')}, {_AT.format(s='greatest(-h, least(h, -h * ab - aw))', t='-h')}) AS ends FROM d)
SELECT i, j, round(sqrt(greatest(0, CASE WHEN abs(s0) <= h AND abs(t0) <= h THEN least(ends, {_AT.format(s='s0', t='t0')}) ELSE ends END)) - 2 * r, 6) AS gap FROM e""")
def capsule_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _bodies(spark, sf_dir).select("i", F.col("body").alias("a"))
    b = _bodies(spark, sf_dir).select((F.col("i") - 1).alias("i"), F.col("i").alias("j"), F.col("body").alias("b"))
    return a.join(b, "i").select("i", "j", _r(capsule_gap(F.col("a"), F.col("b")), 6).alias("gap"))


_CLOSE = 0.05


@query(f"""WITH {_BODIES}, d AS (SELECT a.trial, a.i, b.i AS j, a.h, a.r, a.ax * b.ax + a.ay * b.ay + a.az * b.az AS ab,
a.ax * (a.cx - b.cx) + a.ay * (a.cy - b.cy) + a.az * (a.cz - b.cz) AS aw, b.ax * (a.cx - b.cx) + b.ay * (a.cy - b.cy) + b.az * (a.cz - b.cz) AS bw,
(a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2 + (a.cz - b.cz) ** 2 AS ww FROM bodies a JOIN bodies b ON a.trial = b.trial AND a.i < b.i),
e AS (SELECT *, (ab * bw - aw) / (1 - ab * ab) AS s0, (bw - ab * aw) / (1 - ab * ab) AS t0,
least({_AT.format(s='h', t='greatest(-h, least(h, bw + h * ab))')}, {_AT.format(s='-h', t='greatest(-h, least(h, bw - h * ab))')}, {_AT.format(s='greatest(-h, least(h, h * ab - aw))', t='h')}, {_AT.format(s='greatest(-h, least(h, -h * ab - aw))', t='-h')}) AS ends FROM d)
SELECT * FROM (SELECT trial, i, j, round(sqrt(greatest(0, CASE WHEN abs(s0) <= h AND abs(t0) <= h THEN least(ends, {_AT.format(s='s0', t='t0')}) ELSE ends END)) - 2 * r, 6) AS gap FROM e
WHERE sqrt(ww) <= 2 * sqrt(r * r + h * h) + {_CLOSE!r}) WHERE gap <= {_CLOSE!r}""")
def capsule_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of all capsules of a trial that come near each other."""
    # the rounded gap decides, so pairs half a last digit beyond it are asked for; the spheres decide as they are
    near = contact.capsule_gaps(_bodies(spark, sf_dir), _CLOSE + 1e-6, _CLOSE)
    return near.select("trial", "i", "j", _r("gap", 6).alias("gap")).filter(F.col("gap") <= _CLOSE)


def _sql_nearest(source: str, point: str, body: str, out: str) -> str:
    """The rows of ``source`` with the point of a body nearest to a point of the row."""
    xyz = "xyz"
    offset = ", ".join(f"{point}{k} - {body}.c{k} AS d{k}" for k in xyz)
    height = " + ".join(f"d{k} * {body}.a{k}" for k in xyz)
    side = ", ".join(f"d{k} - t * {body}.a{k} AS s{k}" for k in xyz)
    place = ", ".join(f"{body}.c{k} + greatest(-{body}.h, least({body}.h, t)) * {body}.a{k} + CASE WHEN n <= {body}.r THEN s{k} ELSE s{k} * {body}.r / n END AS {out}{k}" for k in xyz)
    return f"""SELECT * EXCLUDE (dx, dy, dz, t, sx, sy, sz, n), {place} FROM (SELECT *, sqrt(sx * sx + sy * sy + sz * sz) AS n FROM
(SELECT *, {side} FROM (SELECT *, {height} AS t FROM (SELECT *, {offset} FROM {source}))))"""


def _sql_distances(tol: float, rounds: int = 600) -> str:
    """Distances of bodies that are near enough for their spheres, by projections from one to the other and back,
    with momentum that starts anew when it leads uphill."""
    xyz = "xyz"
    dot = lambda a, b: " + ".join(f"({a.format(k)}) * ({b.format(k)})" for k in xyz)
    there = _sql_nearest("(SELECT w.*, c.a, c.b FROM way w JOIN near c USING (trial, i, j) WHERE k < " + str(rounds) + ")", "y", "b", "q")
    back = _sql_nearest(f"({there})", "q", "a", "p")
    uphill = dot("y{0} - p{0}", "p{0} - x{0}") + " > 0"
    apart = dot("x{0} - q{0}", "x{0} - q{0}")
    last = _sql_nearest(f"(SELECT w.*, c.a, c.b FROM way w JOIN near c USING (trial, i, j) WHERE k = {rounds})", "x", "b", "q")
    return f"""near AS (SELECT a.trial, a.i, b.i AS j, a, b FROM bodies a JOIN bodies b ON a.trial = b.trial AND a.i < b.i
AND sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2 + (a.cz - b.cz) ** 2) <= sqrt(a.r * a.r + a.h * a.h) + sqrt(b.r * b.r + b.h * b.h) + {tol!r}),
way AS (SELECT trial, i, j, a.cx AS xx, a.cy AS xy, a.cz AS xz, a.cx AS yx, a.cy AS yy, a.cz AS yz, 1.0::DOUBLE AS m, 0 AS k FROM near UNION ALL
SELECT trial, i, j, px, py, pz, {', '.join(f'p{k} + f * (p{k} - x{k})' for k in xyz)}, g, k + 1 FROM (SELECT *, CASE WHEN up THEN 0.0 ELSE (m - 1) / g END AS f FROM
(SELECT *, CASE WHEN up THEN 1.0 ELSE (1 + sqrt(1 + 4 * m * m)) / 2 END AS g FROM (SELECT *, {uphill} AS up FROM ({back}))))),
gaps AS (SELECT trial, i, j, sqrt({apart}) AS dist FROM ({last}))"""


@query(f"WITH RECURSIVE {_BODIES}, {_sql_distances(0.0)} SELECT trial, i, j, round(dist, 6) AS dist FROM gaps WHERE dist <= 1e-8")
def cylinder_contact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contact.contacts(saved(_bodies(spark, sf_dir), "bodies"), slack=1e-8).withColumn("dist", _r("dist", 6))


_NEAR = 0.02


@query(f"WITH RECURSIVE {_BODIES}, {_sql_distances(_NEAR)} SELECT trial, i, j, round(dist, 5) AS dist, true AS agree FROM gaps WHERE dist <= {_NEAR!r}")
def cylinder_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances by Gilbert-Johnson-Keerthi, and whether they lie within the bounds that projections give."""
    found = contact.verified(saved(_bodies(spark, sf_dir), "bodies"), _NEAR)
    agree = (F.col("dist") >= F.col("lo") - 1e-6) & (F.col("dist") <= F.col("hi") + 1e-6) & (F.col("hi") - F.col("lo") <= 1e-4)
    return found.select("trial", "i", "j", _r("dist", 5).alias("dist"), agree.alias("agree"))


@query(f"""WITH {_BODIES} SELECT trial, i FROM bodies WHERE cx + h * abs(ax) + r * sqrt(greatest(0, 1 - ax * ax)) >= 0.95""")
def touching_face(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contact.touches(_bodies(spark, sf_dir), "x", 0.95, 1)


_ENDS = "SELECT trial, i FROM bodies WHERE cx {0} (h * abs(ax) + r * sqrt(greatest(0, 1 - ax * ax))) {1}"


@query(f"""WITH RECURSIVE {_BODIES}, {_sql_distances(_NEAR)}, touching AS (SELECT trial, i, j FROM gaps WHERE dist <= {_NEAR!r}),
both_ways AS (SELECT trial, i, j FROM touching UNION ALL SELECT trial, j, i FROM touching), low AS ({_ENDS.format('-', '<= 0.1')}), high AS ({_ENDS.format('+', '>= 0.9')}),
reach AS (SELECT trial, i FROM low UNION SELECT r.trial, b.j FROM reach r JOIN both_ways b ON b.trial = r.trial AND b.i = r.i),
ends AS (SELECT trial FROM low UNION SELECT trial FROM high UNION SELECT trial FROM touching)
SELECT trial, trial IN (SELECT r.trial FROM reach r JOIN high h ON h.trial = r.trial AND h.i = r.i) AS hit FROM ends""")
def cylinder_connected(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = saved(_bodies(spark, sf_dir), "bodies")
    return contact.connected(contact.contact_chains(bodies, 0.02), contact.touches(bodies, "x", 0.1, -1), contact.touches(bodies, "x", 0.9, 1))


_KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id", "labels": "doc_id", "conversations": "conv_id"}


@query("""SELECT 'lineitem' AS name, 'discount' AS "check", count(*) AS rows, count(*) FILTER (NOT (l_discount BETWEEN 0 AND 0.1)) AS broken FROM lineitem UNION ALL
SELECT 'lineitem', 'quantity', count(*), count(*) FILTER (NOT (l_quantity BETWEEN 1 AND 40)) FROM lineitem UNION ALL """ + " UNION ALL ".join(f"SELECT '{t}', 'key', count(*), count(*) FILTER ({k} IS NULL) FROM {t}" for t, k in _KEYS.items()))
def audit_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = {"discount": F.col("l_discount").between(0, 0.1), "quantity": F.col("l_quantity").between(1, 40)}
    found = []
    for name, key in _KEYS.items():
        checks = {"key": F.col(key).isNotNull()} | (ranges if name == "lineitem" else {})
        found.append(audit(table(spark, sf_dir, name), **checks).select(F.lit(name).alias("name"), "check", "rows", "broken"))
    return reduce(DataFrame.union, found)


_FROZEN = {"region": ("r_regionkey", "r_name"), "nation": ("n_nationkey", "n_name", "n_regionkey"), "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")}


def _sql_marks(name: str, columns: tuple[str, ...]) -> str:
    row = f"md5(concat_ws(chr(31), {', '.join(f'coalesce({c}::VARCHAR, chr(2))' for c in columns)}))"
    sums = [f"sum(('0x' || substr({row}, {at}, 8))::BIGINT)::BIGINT AS mark{i}" for i, at in ((1, 1), (2, 9))]
    return f"SELECT '{name}' AS name, count(*) AS rows, {', '.join(sums)} FROM {name}"


@query(" UNION ALL ".join(_sql_marks(n, c) for n, c in _FROZEN.items()))
def freeze_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables frozen in the shared folder, checked against their digests, and digested."""
    found = []
    for name, columns in _FROZEN.items():
        path = new_path(spark, f"frozen-{name}")
        frozen = thaw(spark, path, freeze(table(spark, sf_dir, name, *columns), path))
        found.append(frozen.agg(F.lit(name).alias("name"), *marks(frozen)))
    return reduce(DataFrame.union, found)


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def gated_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_totalprice")
    good = gated("orders", rows, new_path(spark, "gated"), keys=F.col("o_orderkey").isNotNull(), prices=F.col("o_totalprice") >= 0)
    return good.groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query(" UNION ALL ".join(f"SELECT '{n}' AS step, count(*) AS rows FROM ({ORACLES[n]})" for n in STEPS))
def stepped_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four steps, each written to the shared folder and read again."""
    made = run_steps(spark, sf_dir, 1, len(STEPS), out=new_path(spark, "steps"))
    return reduce(DataFrame.union, [df.agg(F.lit(n).alias("step"), F.count("*").alias("rows")) for n, df in made.items()])


_PLANS = {"contact_pairs": ("events", "trial,i,j,dist"), "percolation_curve": ("events", "n_fill,k,trials,p_hat"), "min_fill": ("events", "n_fill"), "pareto_part": ("part", "p_partkey,p_retailprice,p_size")}


@query(" UNION ALL ".join(f"SELECT '{n}' AS step, '{t}' AS source, count(*) AS rows, '{c}' AS names FROM {t}" for n, (t, c) in _PLANS.items()))
def planned_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dry run of all steps: the tables that each would read, their rows, and the columns it would return."""
    plans = run_steps(spark, sf_dir, 1, len(STEPS), dry_run=True)
    read = {n: sorted({re.search(r"/([a-z]+)\.parquet(/|$)", f).group(1) for f in df.inputFiles()}) for n, df in plans.items()}
    found = [table(spark, sf_dir, t).agg(F.lit(n).alias("step"), F.lit(t).alias("source"), F.count("*").alias("rows"), F.lit(",".join(plans[n].columns)).alias("names")) for n, ts in read.items() for t in ts]
    return reduce(DataFrame.union, found)


_GAINS, _DEAR, _TARGET = [1.0, 2.0, 3.0], 200.0, 0.5


def _unit_costs(spark: SparkSession, sf_dir: str) -> list[float]:
    """The least price of three kinds of part, in thousands, with a surcharge by kind: one row."""
    kinds = [F.round(F.min(F.when(F.col("p_size") % 3 == i, F.col("p_retailprice"))) / 1000 + i, 2) for i in range(3)]
    return list(table(spark, sf_dir, "part", "p_size", "p_retailprice").agg(*kinds).first())


def _sql_design(need: str) -> str:
    return f"""SELECT a.x AS x1, b.x AS x2, c.x AS x3, round(a.x * c0 + b.x * c1 + c.x * c2, 8)::DOUBLE AS cost FROM range(80) a(x), range(80) b(x), range(80) c(x), u, ({need}) n(need)
WHERE a.x + 2 * b.x + 3 * c.x >= need AND a.x * c0 + b.x * c1 + c.x * c2 <= {_DEAR} ORDER BY round(a.x * c0 + b.x * c1 + c.x * c2, 9), x1, x2, x3 LIMIT 1"""


@query(f"WITH RECURSIVE {_CRIT}, u AS ({_UNITS}) {_sql_design(f'SELECT min(n_fill) FROM ({_CURVE}) WHERE k / trials >= {_TARGET}')}")
def design_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest numbers of three kinds of body that fill as much as half of all trials need to span."""
    curve = percolation_curve(spark, sf_dir)
    need = curve.agg(F.min(F.when(F.col("p_hat") >= _TARGET, F.col("n_fill")))).first()[0]
    return optimise.cheapest_design(spark, _unit_costs(spark, sf_dir), _GAINS, need, _DEAR)[0].withColumn("cost", _r("cost"))


def _edges_step(spark: SparkSession, sf_dir: str, inputs: dict) -> DataFrame:
    return percolation.filling_edges(_tubes(spark, sf_dir), _TUBE[2])


def _curve_step(spark: SparkSession, sf_dir: str, inputs: dict) -> DataFrame:
    trials = table(spark, sf_dir, "events", "user_id").select(F.col("user_id").alias("trial"))
    return percolation.percolation_curve(percolation.fill_of_edges(inputs["cylinder_edges"], trials), FILLS)


def _least_step(spark: SparkSession, sf_dir: str, inputs: dict) -> DataFrame:
    return inference.min_fill(inputs["cylinder_curve"], _TARGET)


def _design_step(spark: SparkSession, sf_dir: str, inputs: dict) -> DataFrame:
    if is_planning():  # what it would search is known from the step before only
        return optimise.shell(spark, [1.0] * len(_GAINS), _GAINS, 1.0, 0.0, 1.0)
    return optimise.cheapest_design(spark, _unit_costs(spark, sf_dir), _GAINS, inputs["cylinder_least"].first()[0], _DEAR)[0]


CYLINDER_STEPS = (
    Step("cylinder_edges", _edges_step, checks=lambda: {"bodies": F.col("v") >= 0, "order": F.col("w") > F.col("v")}),
    Step("cylinder_curve", _curve_step, ("cylinder_edges",), lambda: {"counts": F.col("k").between(0, F.col("trials"))}),
    Step("cylinder_least", _least_step, ("cylinder_curve",)),
    Step("cylinder_design", _design_step, ("cylinder_least",), lambda: {"cost": F.col("cost") <= _DEAR}),
)
_LOWS = f"""lows AS (SELECT n_fill, k, n, 0.0::DOUBLE AS a, 1.0::DOUBLE AS b, 0 AS t FROM (SELECT n_fill, k, trials AS n FROM ({_CURVE})) WHERE k > 0 UNION ALL
SELECT n_fill, k, n, CASE WHEN p >= {_LEVEL} THEN a ELSE mid END, CASE WHEN p >= {_LEVEL} THEN mid ELSE b END, t + 1
FROM (SELECT *, {_TAIL.format(a="k", b="n + 1")} AS p FROM (SELECT *, (a + b) / 2 AS mid FROM lows WHERE t < 60)))"""


@query(f"""WITH RECURSIVE {_FILL}, {_LOWS}, u AS ({_UNITS}) SELECT 'cylinder_edges' AS step, (SELECT count(*) FROM touching) + (SELECT count(*) FROM bodies WHERE cx - {_TUBE[0]!r} <= {_TUBE[2]!r}) + (SELECT count(*) FROM bodies WHERE cx + {_TUBE[0]!r} >= 1 - {_TUBE[2]!r}) AS rows, NULL::DOUBLE AS cost
UNION ALL SELECT 'cylinder_curve', count(*), NULL FROM ({_CURVE}) UNION ALL SELECT 'cylinder_least', 1, NULL
UNION ALL SELECT 'cylinder_design', count(*), max(cost) FROM ({_sql_design(f'SELECT min(n_fill) FROM lows WHERE t = 60 AND (a + b) / 2 >= {_TARGET}')})""")
def cylinder_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four questions as steps that read each other's stored results, in two runs."""
    out = new_path(spark, "steps")
    made = run_steps(spark, sf_dir, 1, 2, out=out, steps=CYLINDER_STEPS)
    made |= run_steps(spark, sf_dir, 3, 4, out=out, steps=CYLINDER_STEPS)
    costs = {"cylinder_design": _r(F.max("cost"))}
    return reduce(DataFrame.union, [df.agg(F.lit(n).alias("step"), F.count("*").alias("rows"), costs.get(n, F.lit(None).cast("double")).alias("cost")) for n, df in made.items()])
