"""Views of the test tables in the shape of point sets, corpus rows, rollouts, checks and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table

SYMBOLS = ("C", "N", "O", "c", "NH2+", "cH", "Cl", "C@H")
SCALE = 2.8
DELTA = 0.75


def conformers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, conf_id, xyz): 21 points a vector."""
    xyz = F.transform(F.slice("embedding", 1, 63), lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("key"), F.col("vec_id").alias("conf_id"), xyz.alias("xyz"))


def true_and_generated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Even ids are the truth, odd ones generated; key 9 has nothing generated."""
    all_ = conformers(spark, sf_dir)
    return all_.filter("conf_id % 2 = 0"), all_.filter("conf_id % 2 = 1 and key <> 9")


CONF_SQL = "v_conf AS (SELECT label AS key, vec_id AS conf_id, list_transform(embedding[1:63], lambda x: CAST(x AS DOUBLE)) AS xyz FROM embeddings)"
SETS_SQL = f"{CONF_SQL}, v_true AS (SELECT * FROM v_conf WHERE conf_id % 2 = 0), v_gen AS (SELECT * FROM v_conf WHERE conf_id % 2 = 1 AND key <> 9)"
RMSD_SQL = "sqrt(list_sum(list_transform(list_zip(a.xyz, b.xyz), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) / 21)"
PAIRS_SQL = f"{SETS_SQL}, pairs AS (SELECT a.key, a.conf_id AS i, b.conf_id AS j, {SCALE} * {RMSD_SQL} AS r FROM v_true a JOIN v_gen b ON a.key = b.key)"


def superposed_sql(source: str, n: int, keep: str) -> str:
    """``keep`` and r of a source with n points each in a and b: their RMSD after the best rotation and shift.

    The largest root of the quaternion matrix's characteristic polynomial, whose coefficients are invariants of the covariance, by Newton's steps from above."""
    axes = range(3)
    mean = ", ".join(f"list_sum(list_transform(range({n}), lambda p: {x}[3 * p + {k + 1}])) / {n} AS {x}{k}" for x in "ab" for k in axes)
    at = lambda x, k: f"({x}[3 * p + {k + 1}] - {x}{k})"
    over = lambda e: f"list_sum(list_transform(range({n}), lambda p: {e}))"
    m = ", ".join(f"{over(f'{at('a', k)} * {at('b', j)}')} AS m{k}{j}" for k in axes for j in axes)
    g = " + ".join(over(f"{at(x, k)} * {at(x, k)}") for x in "ab" for k in axes)
    squares = " + ".join(f"m{k}{j} * m{k}{j}" for k in axes for j in axes)
    det = "m00 * (m11 * m22 - m12 * m21) - m01 * (m10 * m22 - m12 * m20) + m02 * (m10 * m21 - m11 * m20)"
    gram = " + ".join(f"pow({' + '.join(f'm{i}{k} * m{i}{j}' for i in axes)}, 2)" for k in axes for j in axes)
    slope = "(4 * l * l * l + 2 * c2 * l + c1)"
    root = f"list_reduce(list_prepend(g / 2, list_transform(range(100), lambda x: CAST(x AS DOUBLE))), lambda l, x: CASE WHEN {slope} = 0 THEN l ELSE l - (l * l * l * l + c2 * l * l + c1 * l + c0) / {slope} END)"
    return f"""SELECT {keep}, sqrt(greatest(0, (g - 2 * {root}) / {n})) AS r FROM (SELECT {keep}, g, -2 * ({squares}) AS c2, -8 * ({det}) AS c1, 2 * ({gram}) - pow({squares}, 2) AS c0
FROM (SELECT {keep}, {m}, {g} AS g FROM (SELECT {keep}, a, b, {mean} FROM ({source}))))"""


def atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conf_id, pos, sym, x, y, z), one row for each point."""
    symbols = F.array(*map(F.lit, SYMBOLS))
    xyz = conformers(spark, sf_dir).select("conf_id", "xyz", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("pos"))
    at = lambda k: F.element_at("xyz", F.col("pos") * 3 + k)
    return xyz.select("conf_id", "pos", F.element_at(symbols, F.col("pos") % 8 + 1).alias("sym"), at(1).alias("x"), at(2).alias("y"), at(3).alias("z"))


ATOMS_SQL = f"{CONF_SQL}, v_atoms AS (SELECT conf_id, pos, (['{"', '".join(SYMBOLS)}'])[pos % 8 + 1] AS sym, xyz[pos * 3 + 1] AS x, xyz[pos * 3 + 2] AS y, xyz[pos * 3 + 3] AS z FROM v_conf, (SELECT unnest(range(0, 21)) AS pos))"


def trunc_sql(x: str, p: int = 4) -> str:
    t = f"(CASE WHEN {x} >= 0 THEN floor({x} * 1e{p}) ELSE ceil({x} * 1e{p}) END / 1e{p})"
    return f"printf('%.{p}f', CASE WHEN abs({t}) < 1e-{p} THEN 0.0::DOUBLE ELSE {t} END)"


ENRICHED_SQL = f"{ATOMS_SQL}, v_enriched AS (SELECT conf_id, string_agg('[' || sym || ']<' || {trunc_sql('x')} || ',' || {trunc_sql('y')} || ',' || {trunc_sql('z')} || '>', '' ORDER BY pos) AS enriched FROM v_atoms GROUP BY conf_id)"


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conf_id, enriched): the points of a conformer as one string."""
    from ..functions import codec

    one = codec.encode_enriched(F.col("atoms"))
    points = conformers(spark, sf_dir)
    symbols = F.array(*map(F.lit, SYMBOLS))
    at = lambda p, k: F.element_at("xyz", p * 3 + k)
    built = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda p: F.struct(F.element_at(symbols, p % 8 + 1).alias("sym"), at(p, 1).alias("x"), at(p, 2).alias("y"), at(p, 3).alias("z")))
    return points.select("conf_id", built.alias("atoms")).select("conf_id", one.alias("enriched"))


#: ASCII white space, as a run; both engines read it the same way.
_BLANKS = "[ \\t\\r\\n]+"


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(geom, conf, canonical, embedded, lang): whole texts, and the same in lower case with single spaces."""
    docs = table(spark, sf_dir, "documents")
    canonical = F.trim(F.regexp_replace(F.lower("text"), _BLANKS, " "))
    return docs.select(F.col("source").alias("geom"), F.col("doc_id").alias("conf"), canonical.alias("canonical"), F.col("text").alias("embedded"), "lang")


CORPUS_SQL = f"v_mol AS (SELECT source AS geom, doc_id AS conf, trim(regexp_replace(lower(text), '{_BLANKS}', ' ', 'g')) AS canonical, text AS embedded, lang FROM documents)"


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(group_id, pos, prompt, completion): conversations as generations: unclosed for role system, as prompted for assistant, without vowels for others."""
    c = table(spark, sf_dir, "conversations")
    block = F.when(F.col("role") == "assistant", F.trim("text")).otherwise(F.trim(F.regexp_replace("text", "[aeiou]", "")))
    text = F.when(F.col("role") == "system", F.concat(F.lit("[CONFORMER]"), "text")).otherwise(F.concat(F.lit("[CONFORMER]"), block, F.lit("[/CONFORMER]")))
    return c.select(F.col("conv_id").alias("group_id"), F.col("turn").alias("pos"), F.concat(F.lit("[SMILES]"), F.trim("text"), F.lit("[/SMILES]")).alias("prompt"), text.alias("completion"))


ROLLOUT_SQL = """v_rollout AS (SELECT conv_id AS group_id, turn AS pos, '[SMILES]' || trim(text) || '[/SMILES]' AS prompt,
  CASE WHEN role = 'system' THEN '[CONFORMER]' || text WHEN role = 'assistant' THEN '[CONFORMER]' || trim(text) || '[/CONFORMER]' ELSE '[CONFORMER]' || trim(regexp_replace(text, '[aeiou]', '', 'g')) || '[/CONFORMER]' END AS completion FROM conversations)"""


def check_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conf, key, four boolean checks, error): documents with their labels; no label counts as failed."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars"), table(spark, sf_dir, "labels")
    j = docs.join(labels, "doc_id", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    error = F.when(F.col("quality").isNull(), F.concat(F.lit("no label "), F.col("lang")))
    return j.select(F.col("doc_id").alias("conf"), F.col("source").alias("key"), yes(F.col("quality") == 1).alias("good"), yes(F.col("toxic") == 0).alias("clean"), (F.col("lang") == "en").alias("english"), (F.col("n_chars") >= 100).alias("long_enough"), error.alias("error"))


CHECK_SQL = """v_check AS (SELECT d.doc_id AS conf, d.source AS key, coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 0, false) AS clean, d.lang = 'en' AS english, d.n_chars >= 100 AS long_enough,
  CASE WHEN l.quality IS NULL THEN 'no label ' || d.lang END AS error FROM documents d LEFT JOIN labels l USING (doc_id))"""
