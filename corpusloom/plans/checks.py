"""Queries over check matrices."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import checks as op
from ..session import table
from .registry import query
from .views import CHECK_SQL, check_matrix

CHECKS = ["good", "clean", "english", "long_enough"]
_SUM = " + ".join(f"CAST({c} AS INT)" for c in CHECKS)
_AVG = ", ".join(f"round(avg(CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS {c}" for c in CHECKS)
_PASS = f"CASE WHEN {_SUM} = 4 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


@query(f"WITH {CHECK_SQL} SELECT conf, ({_SUM}) / 4.0::DOUBLE AS fraction, {_SUM} = 4 AS passed FROM v_check")
def pass_fraction(spark, sf_dir):
    return check_matrix(spark, sf_dir).select("conf", op.fraction(CHECKS).alias("fraction"), op.passed(CHECKS).alias("passed"))


@query(f"WITH {CHECK_SQL} SELECT CASE WHEN grouping(key) = 1 THEN 'ALL' ELSE key END AS key, {_AVG}, round(100 * avg({_PASS}), 6) AS pass_percentage, count(*) AS n, coalesce(string_agg(DISTINCT error, ';' ORDER BY error), '') AS errors FROM v_check GROUP BY GROUPING SETS ((key), ())")
def pass_rates(spark, sf_dir):
    return op.pass_rates(check_matrix(spark, sf_dir), "key", CHECKS)


@query(f"WITH {CHECK_SQL}, k AS (SELECT key, {', '.join(f'avg(CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS {c}' for c in CHECKS)}, avg({_PASS}) AS p FROM v_check WHERE error IS NULL GROUP BY key) SELECT {', '.join(f'round(avg({c}), 6) AS {c}' for c in CHECKS)}, round(100 * avg(p), 6) AS pass_percentage, count(*) AS n_keys FROM k")
def pass_rates_macro(spark, sf_dir):
    return op.pass_rates_macro(check_matrix(spark, sf_dir), "key", CHECKS)


@query(f"WITH {CHECK_SQL} SELECT key, round(100 * avg({_PASS}), 6) AS pass_percentage FROM v_check GROUP BY key HAVING round(100 * avg({_PASS}), 6) < 18")
def failed_keys(spark, sf_dir):
    return op.pass_rates(check_matrix(spark, sf_dir), "key", CHECKS).filter("key <> 'ALL' and pass_percentage < 18").select("key", "pass_percentage")


@query(f"WITH {CHECK_SQL}, m AS (SELECT unnest(['off', 'basic', 'geometry', 'full']) AS mode) SELECT mode, count(*) AS checked, count(*) FILTER (WHERE CASE mode WHEN 'off' THEN true WHEN 'basic' THEN good WHEN 'geometry' THEN good AND clean ELSE good AND clean AND english AND long_enough END) AS passed FROM v_check, m GROUP BY mode")
def check_gate(spark, sf_dir):
    gates = F.array(*(F.struct(F.lit(m).alias("mode"), op.gate(CHECKS, m, {"basic": 1, "geometry": 2})[0].alias("ok")) for m in ("off", "basic", "geometry", "full")))
    rows = check_matrix(spark, sf_dir).select(F.inline(gates))
    return rows.groupBy("mode").agg(F.count("*").alias("checked"), F.count_if("ok").alias("passed"))


#: Nine modules, the fifth of three checks; those that a document has no field for are made of its length.
MODULES = [["long_enough"], ["good"], ["clean"], ["english"], ["c1", "c2", "c3"], ["c4"], ["c5"], ["c6"], ["c7"]]
_LENGTHS = {f"c{k}": f"n_chars % {n} <> 0" for k, n in enumerate((29, 31, 37, 11, 13, 17, 19), 1)}
_FIRST = {"off": [], "basic": MODULES[:4], "geometry": MODULES[:5], "full": MODULES}
_OK = " ".join(f"WHEN '{m}' THEN {' AND '.join(f'coalesce({c}, false)' for x in first for c in x) or 'true'}" for m, first in _FIRST.items())


@query(f"WITH {CHECK_SQL}, c AS (SELECT v.*, {', '.join(f'{e} AS {c}' for c, e in _LENGTHS.items())} FROM v_check v JOIN documents d ON d.doc_id = v.conf), m AS (SELECT unnest({list(_FIRST)}) AS mode) SELECT mode, count(*) AS checked, count(*) FILTER (WHERE CASE mode {_OK} END) AS passed FROM c, m GROUP BY mode")
def check_gate_modules(spark, sf_dir):
    """How many rows pass the four, five or nine modules of a mode."""
    lengths = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("conf"), *(F.expr(e).alias(c) for c, e in _LENGTHS.items()))
    gates = F.array(*(F.struct(F.lit(m).alias("mode"), op.gate(MODULES, m)[0].alias("ok")) for m in _FIRST))
    rows = check_matrix(spark, sf_dir).join(lengths, "conf").select(F.inline(gates))
    return rows.groupBy("mode").agg(F.count("*").alias("checked"), F.count_if("ok").alias("passed"))


@query(f"WITH {CHECK_SQL} SELECT round(avg(({_SUM}) / 4.0::DOUBLE), 6) AS avg, round(avg({_PASS}), 6) AS bool FROM v_check")
def check_means(spark, sf_dir):
    return op.means(check_matrix(spark, sf_dir), CHECKS)


_POSED = f"{CHECK_SQL}, p AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY conf) - 1 AS pos, {_SUM} = 4 AS ok FROM v_check), e AS (SELECT key, count(*) + CASE WHEN length(key) % 2 = 0 THEN 3 ELSE -3 END AS n FROM v_check GROUP BY key)"


@query(f"WITH {_POSED}, s AS (SELECT key, unnest(range(0, n)) AS pos FROM e) SELECT key, pos, coalesce(ok, false) AS passed FROM s LEFT JOIN p USING (key, pos)")
def pass_vector(spark, sf_dir):
    """Vectors of an expected length: three positions more than there are rows for some keys, three fewer for others."""
    m = check_matrix(spark, sf_dir).withColumn("pos", F.row_number().over(Window.partitionBy("key").orderBy("conf")) - 1)
    expected = m.groupBy("key").agg((F.count("*") + F.when(F.length("key") % 2 == 0, 3).otherwise(-3)).alias("n"))
    return op.pass_vector(m, expected, "key", "pos", CHECKS)
