"""Queries over structures as graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import graphs
from ..operators import corpus, coverage, structures
from ..operators.corpus import split_of
from ..sources.files import largest_degree
from ..sources.staging import staged
from .registry import query
from .views import ATOMS_SQL, CONF_SQL, SETS_SQL, atoms, conformers, superposed_sql, true_and_generated

#: Atoms of a made-up structure; components below and above these bounds are N and O, others C.
ATOMS, LOW, HIGH = 5, -0.05, 0.05

_SYMBOL = f"CASE WHEN x < {LOW} THEN 'N' WHEN x > {HIGH} THEN 'O' ELSE 'C' END"
_STRINGS = f"v_s AS (SELECT conf_id, conf_id % 2 = 1 AS ring, list_transform(xyz[1:{ATOMS}], lambda x: {_SYMBOL}) AS s FROM v_conf)"
_ROUND = f"list_transform(range({ATOMS}), lambda k: array_to_string(list_concat(s[k + 1 : {ATOMS}], s[1:k]), ''))"


def _strings(spark, sf_dir):
    """(conf_id, text, other): chains and rings of five atoms, and the same written from the third atom on."""
    x = F.transform(F.slice("xyz", 1, ATOMS), lambda v: F.when(v < LOW, "N").when(v > HIGH, "O").otherwise("C"))
    at = lambda *order: F.concat(*(F.lit(o) if isinstance(o, str) else F.col("s")[o] for o in order))
    rows = conformers(spark, sf_dir).select("conf_id", x.alias("s"))
    ring = F.col("conf_id") % 2 == 1
    text = F.when(ring, at(0, "1", 1, 2, 3, 4, "1")).otherwise(at(0, 1, 2, 3, 4))
    other = F.when(ring, at(2, "%12", 1, "(", 0, 4, 3, "%12)")).otherwise(at(2, "(", 1, 0, ")", 3, 4))
    return rows.select("conf_id", text.alias("text"), other.alias("other"))


@query(f"""WITH {CONF_SQL}, {_STRINGS}, c AS (SELECT conf_id, CASE WHEN ring THEN 'r' || list_min(list_concat({_ROUND}, list_transform({_ROUND}, lambda t: reverse(t)))) ELSE 'c' || least(array_to_string(s, ''), reverse(array_to_string(s, ''))) END AS k FROM v_s)
SELECT conf_id, count(*) OVER (PARTITION BY k) AS same, min(conf_id) OVER (PARTITION BY k) AS first FROM c""")
def same_graph(spark, sf_dir):
    """Structure strings that say the same graph as another, however that is written: an equi-join on canonical keys."""
    s = _strings(spark, sf_dir)
    # one row a graph before the join: members of a common graph don't meet in pairs
    there = s.groupBy(graphs.graph_key("other").alias("k")).agg(F.count("*").alias("same"), F.min("conf_id").alias("first"))
    return s.select("conf_id", graphs.graph_key("text").alias("k")).join(there, "k").select("conf_id", "same", "first")


_TURNED = f"list_concat({', '.join(f'b[{3 * k + 1}:{3 * k + 3}]' for k in reversed(range(ATOMS)))})"
_FIRST = f"f AS (SELECT key, arg_min(xyz, conf_id)[1:{3 * ATOMS}] AS a FROM v_true GROUP BY key), p AS (SELECT key, conf_id AS j, a, xyz[1:{3 * ATOMS}] AS b FROM v_gen JOIN f USING (key)), w AS (SELECT key, j, a, b FROM p UNION ALL SELECT key, j, a, {_TURNED} AS b FROM p)"


@query(f"WITH {SETS_SQL}, {_FIRST}, r AS ({superposed_sql('SELECT * FROM w', ATOMS, 'key, j')}) SELECT key, j, round(min(r), 6) AS r FROM r GROUP BY key, j")
def symmetric_distance(spark, sf_dir):
    """Each generated member's chain of five equal atoms against its key's first true one: the nearer of both directions, hydrogens aside."""
    symbol, pick = F.lit("C"), lambda a, k, c: F.element_at(a, 3 * k + c)
    points = F.transform(F.sequence(F.lit(0), F.lit(ATOMS - 1)), lambda k: F.struct(symbol.alias("sym"), *(pick(F.col("xyz"), k, c + 1).alias(n) for c, n in enumerate("xyz"))))
    # a hydrogen at each end, which the distance leaves out
    ends = F.array(*(F.struct(F.lit("H").alias("sym"), *(pick(F.col("xyz"), F.lit(k), c + 1).alias(n) for c, n in enumerate("xyz"))) for k in (ATOMS, ATOMS + 1)))
    links = [(k, k + 1) for k in range(1, ATOMS)] + [(1, ATOMS + 1), (ATOMS, ATOMS + 2)]
    bonds = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(1).alias("order")) for a, b in links))
    true, gen = true_and_generated(spark, sf_dir)
    first = true.groupBy("key").agg(F.min_by("xyz", "conf_id").alias("xyz")).select("key", F.concat(points, ends).alias("a"))
    rows = gen.select("key", F.col("conf_id").alias("j"), F.concat(points, ends).alias("b")).join(first, "key")
    return rows.select("key", "j", F.round(graphs.symmetric_rmsd("a", bonds, "b", bonds), 6).alias("r"))


_MINIMA = f"x AS ({superposed_sql(f'SELECT a.key, a.conf_id AS i, b.conf_id AS j, a.xyz[1:{3 * ATOMS}] AS a, b.xyz[1:{3 * ATOMS}] AS b FROM v_true a JOIN v_gen b ON a.key = b.key', ATOMS, 'key, i, j')}), y AS ({superposed_sql(f'SELECT key, i, j, a, {_TURNED} AS b FROM (SELECT a.key, a.conf_id AS i, b.conf_id AS j, a.xyz[1:{3 * ATOMS}] AS a, b.xyz[1:{3 * ATOMS}] AS b FROM v_true a JOIN v_gen b ON a.key = b.key)', ATOMS, 'key, i, j')}), m AS (SELECT key, i, j, least(x.r, y.r) AS r FROM x JOIN y USING (key, i, j))"


@query(f"""WITH {SETS_SQL}, {_MINIMA} SELECT key, round(cov_r, 6) AS cov_r, round(cov_p, 6) AS cov_p, round(mat_r, 6) AS mat_r, round(mat_p, 6) AS mat_p FROM
(SELECT key, avg(CASE WHEN m < 0.15 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS cov_r, avg(m) AS mat_r FROM (SELECT key, i, min(r) AS m FROM m GROUP BY key, i) GROUP BY key) JOIN
(SELECT key, avg(CASE WHEN m < 0.15 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS cov_p, avg(m) AS mat_p FROM (SELECT key, j, min(r) AS m FROM m GROUP BY key, j) GROUP BY key) USING (key)""")
def symmetric_coverage(spark, sf_dir):
    """Coverage and matching by the symmetric distance, over all pairs of a key."""
    points = F.transform(F.sequence(F.lit(0), F.lit(ATOMS - 1)), lambda k: F.struct(F.lit("C").alias("sym"), *(F.element_at("xyz", 3 * k + c + 1).alias(n) for c, n in enumerate("xyz"))))
    bonds = F.array(*(F.struct(F.lit(k).alias("a"), F.lit(k + 1).alias("b"), F.lit(1).alias("order")) for k in range(1, ATOMS)))
    true, gen = (x.select("key", "conf_id", points.alias("atoms"), bonds.alias("bonds")) for x in true_and_generated(spark, sf_dir))
    out = coverage.covmat(coverage.symmetric_extremes(true, gen), 0.15)
    return out.select("key", *(F.round(c, 6).alias(c) for c in ("cov_r", "cov_p", "mat_r", "mat_p")))


#: Points as places in Angstrom, and the elements of the views' symbols.
SPREAD = 9.0
ELEMENTS = {"C": "C", "N": "N", "O": "O", "c": "C", "NH2+": "N", "cH": "C", "Cl": "Cl", "C@H": "C"}
_CASE = lambda values, of: f"CASE {of} {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in values.items())} END"
_MOST = {e: structures.AT_MOST[e] for e in set(ELEMENTS.values())}
_BONDS = f"""{ATOMS_SQL}, pt AS (SELECT conf_id, pos, {_CASE(ELEMENTS, 'sym')} AS e, x * {SPREAD}::DOUBLE AS x, y * {SPREAD}::DOUBLE AS y, z * {SPREAD}::DOUBLE AS z FROM v_atoms),
pr AS (SELECT a.conf_id, a.pos AS a, b.pos AS b, a.e AS ea, b.e AS eb, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d FROM pt a JOIN pt b ON a.conf_id = b.conf_id AND a.pos < b.pos),
nr AS (SELECT * FROM pr WHERE d > {structures.LEAST} AND d < {_CASE({e: structures.RADII[e] for e in _MOST}, 'ea')} + {_CASE({e: structures.RADII[e] for e in _MOST}, 'eb')} + {structures.SLACK}),
en AS (SELECT conf_id, a, b, d, a AS me, b AS far, {_CASE(_MOST, 'ea')} AS most FROM nr UNION ALL SELECT conf_id, a, b, d, b, a, {_CASE(_MOST, 'eb')} FROM nr),
bd AS (SELECT conf_id, a, b, any_value(d) AS d FROM (SELECT *, row_number() OVER (PARTITION BY conf_id, me ORDER BY d, far) AS k FROM en) WHERE k <= most GROUP BY conf_id, a, b HAVING count(*) = 2)"""


def _placed(spark, sf_dir):
    elements = F.create_map(*(F.lit(x) for item in ELEMENTS.items() for x in item))
    return atoms(spark, sf_dir).select("conf_id", "pos", elements[F.col("sym")].alias("sym"), *((F.col(c) * SPREAD).alias(c) for c in "xyz"))


@query(f"WITH {_BONDS} SELECT conf_id, CAST(a + 1 AS INT) AS a, CAST(b + 1 AS INT) AS b, round(d, 6) AS length FROM bd")
def perceived_bonds(spark, sf_dir):
    """Bonds by distance among each member's points taken as atoms."""
    found = structures.contacts(_placed(spark, sf_dir), "conf_id")
    return found.select("conf_id", "a", "b", F.round("length", 6).alias("length"))


_KEYS = f"{_STRINGS}, gk AS (SELECT conf_id, CASE WHEN ring THEN 'r' || list_min(list_concat({_ROUND}, list_transform({_ROUND}, lambda t: reverse(t)))) ELSE 'c' || least(array_to_string(s, ''), reverse(array_to_string(s, ''))) END AS graph FROM v_s)"
_DEGREES = f"dg AS (SELECT conf_id, max(n) AS degree FROM (SELECT conf_id, me, count(*) AS n FROM (SELECT conf_id, a AS me FROM bd UNION ALL SELECT conf_id, b FROM bd) GROUP BY conf_id, me) GROUP BY conf_id)"


@query(f"""WITH {_BONDS}, {_KEYS}, {_DEGREES}, t AS (SELECT CASE WHEN conf_id % 10 <= 7 THEN 'train' WHEN conf_id % 10 = 8 THEN 'valid' ELSE 'test' END AS split, key AS geom, graph, CASE WHEN degree > 3 THEN 'large_degree' WHEN graph LIKE 'cO%' THEN 'oxygen_first' END AS reason FROM v_conf JOIN gk USING (conf_id) LEFT JOIN dg USING (conf_id)),
g AS (SELECT split, geom, count(*) AS i, count(*) FILTER (WHERE reason IS NULL) AS o, count(DISTINCT graph) FILTER (WHERE reason IS NULL) > 1 AS several FROM t GROUP BY split, geom),
f AS (SELECT split, string_agg(reason || ':' || n, ',' ORDER BY reason) AS failures FROM (SELECT split, reason, count(*) AS n FROM t WHERE reason IS NOT NULL GROUP BY split, reason) GROUP BY split)
SELECT split, CAST(sum(i) AS BIGINT) AS rows_in, CAST(sum(o) AS BIGINT) AS rows_out, count(*) AS groups_in, count(*) FILTER (WHERE o > 0) AS groups_out, count(*) FILTER (WHERE several) AS several_graphs, coalesce(any_value(failures), '') AS failures FROM g LEFT JOIN f USING (split) GROUP BY split""")
def failure_report(spark, sf_dir):
    """Splits of structures: dropped for an atom with more than three bonds, or chains that may be written from an oxygen; groups with several graphs; a histogram of reasons."""
    c = conformers(spark, sf_dir).select("conf_id", F.col("key").alias("geom"))
    bonds = structures.contacts(_placed(spark, sf_dir), "conf_id").groupBy("conf_id").agg(F.collect_list(F.struct("a", "b")).alias("bonds"))
    keys = staged(_strings(spark, sf_dir).select("conf_id", "text", graphs.graph_key("text").alias("graph")), "graph-keys")
    # of both ways to write a chain SQL takes the smaller: it begins with O if both ends are oxygens
    oxygen = (F.col("conf_id") % 2 == 0) & F.col("text").startswith("O") & F.col("text").endswith("O")
    # graph keys are few distinct texts: their table on disk is far smaller than in memory, so it is no broadcast
    rows = c.join(keys.hint("merge"), "conf_id").join(bonds, "conf_id", "left")
    reason = F.when(largest_degree(F.col("bonds")) > 3, "large_degree").when(oxygen, "oxygen_first")
    out = corpus.failure_report(rows.select(split_of(F.col("conf_id")).alias("split"), "geom", "graph", reason.alias("reason")), ["split"])
    line = F.array_join(F.transform(F.map_entries("failures"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return out.withColumn("failures", line)
