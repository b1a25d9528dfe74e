"""Queries over corpus rows: filters, splits, look-ups, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import corpus as op
from ..operators.ordering import global_index, shuffle_key
from ..session import table
from .registry import query
from .views import CORPUS_SQL, corpus

_REASON = "CASE WHEN regexp_matches(canonical, '[.][a-z]') THEN 'dotted' WHEN length(embedded) < 400 THEN 'short' END"
_SPLIT = "CASE WHEN conf % 10 <= 7 THEN 'train' WHEN conf % 10 = 8 THEN 'valid' ELSE 'test' END"
_TAGGED = f"{CORPUS_SQL}, t AS (SELECT *, {_REASON} AS reason, {_SPLIT} AS split FROM v_mol)"


def _tagged(spark, sf_dir):
    m = corpus(spark, sf_dir)
    reason = F.when(F.col("canonical").rlike("[.][a-z]"), "dotted").when(F.length("embedded") < 400, "short")
    return m.withColumn("reason", reason).withColumn("split", op.split_of(F.col("conf")))


@query(f"WITH {_TAGGED}, r AS (SELECT geom, conf, row_number() OVER (PARTITION BY geom ORDER BY conf) AS n FROM t WHERE reason IS NULL) SELECT geom, conf FROM r WHERE n <= 5")
def filter_topn_per_group(spark, sf_dir):
    """The first five rows of each group that pass the filters; they are applied first."""
    return op.first_per_group(_tagged(spark, sf_dir).filter("reason is null").select("geom", "conf"), ["geom"], ["conf"], 5)


@query(f"WITH {CORPUS_SQL} SELECT geom, conf FROM v_mol WHERE lower(embedded) = canonical AND lang = 'en'")
def clean_filter(spark, sf_dir):
    """Rows whose text is stored in canonical form, but for case."""
    return corpus(spark, sf_dir).filter((F.lower("embedded") == F.col("canonical")) & (F.col("lang") == "en")).select("geom", "conf")


@query("WITH p AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) SELECT conv_id, turn, coalesce(regexp_replace(text, '[@/\\\\ ]', '', 'g') = regexp_replace(nxt, '[@/\\\\ ]', '', 'g'), false) AS same FROM p")
def graph_match(spark, sf_dir):
    """Whether two strings say the same graph once stereo marks and spaces are gone; a missing one matches nothing."""
    from pyspark.sql import Window

    bare = lambda c: F.regexp_replace(c, r"[@/\\ ]", "")
    p = table(spark, sf_dir, "conversations").withColumn("nxt", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return p.select("conv_id", "turn", F.coalesce(bare("text") == bare("nxt"), F.lit(False)).alias("same"))


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").filter("quality = 1"), "doc_id", "left_semi")


@query("SELECT doc_id, CASE WHEN doc_id % 10 <= 7 THEN 'train' WHEN doc_id % 10 = 8 THEN 'valid' ELSE 'test' END AS split FROM documents")
def split_assign(spark, sf_dir):
    """Rows joined to a table of split indices; an index without a row would stop the query."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    index = spark.createDataFrame([(k, "train" if k <= 7 else "valid" if k == 8 else "test") for k in range(10)], "last long, split string")
    j = docs.withColumn("last", F.pmod("doc_id", F.lit(10))).join(F.broadcast(index), "last", "left")
    return j.select("doc_id", F.coalesce("split", F.raise_error(F.lit("no split for this index"))).alias("split"))


@query("SELECT CASE WHEN quality = 0 THEN 'test' WHEN toxic = 1 THEN 'valid' ELSE 'train' END AS split, d.doc_id, d.source FROM labels l JOIN documents d USING (doc_id)")
def split_by_index(spark, sf_dir):
    """Rows that a stored index names; one without a row would stop the query."""
    split = F.when(F.col("quality") == 0, "test").when(F.col("toxic") == 1, "valid").otherwise("train")
    index = table(spark, sf_dir, "labels").select(split.alias("split"), F.col("doc_id").alias("idx"))
    return op.split_rows(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", index)


@query(f"WITH {CORPUS_SQL}, o AS (SELECT geom, conf, row_number() OVER (ORDER BY geom, conf) - 1 AS idx FROM v_mol) SELECT geom, conf, idx, CASE WHEN idx % 10 < 7 THEN 'train' WHEN idx % 10 < 9 THEN 'valid' END AS split FROM o WHERE idx % 10 < 9")
def running_index_split(spark, sf_dir):
    """Split by a position that counts on over all groups; rows in neither set are left out."""
    idx = global_index(corpus(spark, sf_dir).select("geom", "conf"), "geom", "conf")
    last = F.pmod("idx", F.lit(10))
    return idx.withColumn("split", F.when(last < 7, "train").when(last < 9, "valid")).filter("split is not null")


@query("SELECT CASE WHEN length(text) < 400 THEN 'short' ELSE 'long' END AS part, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents WHERE length(text) > 0 GROUP BY 1")
def split_by_length(spark, sf_dir):
    n = F.length("text")
    return table(spark, sf_dir, "documents").filter(n > 0).groupBy(F.when(n < 400, "short").otherwise("long").alias("part")).agg(F.count("*").alias("n"), F.sum(n).alias("chars"))


@query("SELECT conv_id, turn, '[SMILES]' || trim(text) || '[/SMILES]' AS prompt FROM conversations WHERE length(trim(text)) > 0 AND length(trim(text)) + 17 <= 150")
def prompt_filter(spark, sf_dir):
    p = text.build_prompt(F.trim("text"))
    return table(spark, sf_dir, "conversations").filter(F.length(F.trim("text")) > 0).select("conv_id", "turn", p.alias("prompt")).filter(F.length("prompt") <= 150)


@query(f"WITH {CORPUS_SQL} SELECT conf, length(canonical) > 0 AND length(embedded) >= 16 AND length(canonical) + length(embedded) <= 4000 AS valid FROM v_mol")
def unit_validity(spark, sf_dir):
    return corpus(spark, sf_dir).select("conf", text.unit_validity(F.col("canonical"), F.col("embedded"), 16, 4000).alias("valid"))


@query("SELECT doc_id FROM documents ORDER BY md5('17:0:' || doc_id) LIMIT 100")
def seeded_sample(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").orderBy(shuffle_key(17, 0, F.col("doc_id")), "doc_id").limit(100)


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('17:3:' || doc_id)) - 1 AS idx FROM documents")
def seeded_shuffle(spark, sf_dir):
    keyed = table(spark, sf_dir, "documents").select("doc_id", shuffle_key(17, 3, F.col("doc_id")).alias("k"))
    return global_index(keyed, "k", "doc_id").select("doc_id", "idx")


@query("SELECT o_custkey, max(o_orderdate) AS latest FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') GROUP BY o_custkey ORDER BY latest DESC, o_custkey LIMIT 50")
def anti_topk(spark, sf_dir):
    """The latest fifty keys that nothing is finished for."""
    o = table(spark, sf_dir, "orders")
    open_ = o.join(o.filter("o_orderstatus = 'F'").select("o_custkey"), "o_custkey", "left_anti")
    return open_.groupBy("o_custkey").agg(F.max("o_orderdate").alias("latest")).orderBy(F.desc("latest"), "o_custkey").limit(50)


@query("SELECT c_name, c_custkey FROM customer ORDER BY c_name LIMIT 100")
def topn_by_key(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_name", "c_custkey").orderBy("c_name").limit(100)


@query("SELECT doc_id, length(text) AS n FROM documents ORDER BY n, doc_id LIMIT 200")
def order_by_length(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("n")).orderBy("n", "doc_id").limit(200)


_KEYS = "k AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'none/' || page_id ELSE url END AS url FROM pages), t AS (SELECT CASE WHEN page_id % 2 = 0 THEN url ELSE replace(url, '/', '_') END AS name, min(page_id) AS target FROM pages GROUP BY 1)"


@query(f"WITH {_KEYS} SELECT k.url, coalesce(min(a.target), min(b.target), -1) AS target FROM k LEFT JOIN t a ON k.url = a.name LEFT JOIN t b ON replace(k.url, '/', '_') = b.name GROUP BY k.url")
def fallback_lookup(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    keys = pages.select(F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("none/"), "page_id")).otherwise(F.col("url")).alias("url")).distinct()
    names = pages.groupBy(F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.translate("url", "/", "_")).alias("name")).agg(F.min("page_id").alias("target"))
    return op.fallback_lookup(keys, names, "url", "name", "target").fillna(-1, ["target"])


@query("SELECT doc_id, nullif(trim(CASE WHEN l.quality = 0 THEN ' ' ELSE 'fixed-' || d.source END), '') AS corrected FROM documents d LEFT JOIN labels l USING (doc_id)")
def corrections_lookup(spark, sf_dir):
    """Corrections by key: blank ones count as none."""
    j = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    raw = F.when(F.col("quality") == 0, " ").otherwise(F.concat(F.lit("fixed-"), "source"))
    return j.select("doc_id", F.nullif(F.trim(raw), F.lit("")).alias("corrected"))


@query("SELECT canonical, arg_min(doc_id, doc_id) AS doc_id FROM (SELECT text AS canonical, doc_id FROM documents) GROUP BY canonical")
def first_wins(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("text").alias("canonical"), "doc_id", F.col("doc_id").alias("line"))
    return op.first_wins(d, "canonical", "doc_id", "line")


@query(f"WITH {CORPUS_SQL} SELECT DISTINCT geom, canonical FROM v_mol")
def mapping_distinct(spark, sf_dir):
    by_digest = corpus(spark, sf_dir).groupBy("geom", F.sha2("canonical", 256).alias("d")).agg(F.first("canonical").alias("canonical"))
    return by_digest.select("geom", "canonical").orderBy("geom", "canonical")


@query(f"WITH {CORPUS_SQL} SELECT count(*) AS pairs FROM (SELECT DISTINCT geom, canonical FROM v_mol)")
def distinct_pairs(spark, sf_dir):
    slim = corpus(spark, sf_dir).select("geom", F.sha2("canonical", 256).alias("text"))
    return slim.agg(F.countDistinct("geom", "text").alias("pairs"))


@query(f"WITH {CORPUS_SQL} SELECT geom, lang, count(*) AS n FROM v_mol GROUP BY geom, lang")
def value_counts(spark, sf_dir):
    return corpus(spark, sf_dir).groupBy("geom", "lang").agg(F.count("*").alias("n"))


@query(f"WITH {CORPUS_SQL}, c AS (SELECT geom, lang, count(*) AS n, min(conf) AS f FROM v_mol GROUP BY geom, lang), o AS (SELECT *, row_number() OVER (PARTITION BY geom ORDER BY n DESC, f) AS r FROM c) SELECT geom, lang, n FROM o WHERE r = 1")
def stable_mode(spark, sf_dir):
    return op.stable_mode(corpus(spark, sf_dir), ["geom"], "lang", "conf")


_REPORT = """count(*) AS rows_in, count(*) FILTER (WHERE reason IS NULL) AS rows_out, count(DISTINCT geom) AS groups_in, count(DISTINCT geom) FILTER (WHERE reason IS NULL) AS groups_out,
count(*) FILTER (WHERE reason = 'dotted') AS dotted, count(*) FILTER (WHERE reason = 'short') AS short, count(DISTINCT canonical) FILTER (WHERE reason IS NULL) AS distinct_canonical"""
_RATES = "*, round(groups_out / greatest(groups_in, 1), 6) AS success_rate, round(rows_out / greatest(groups_out, 1), 6) AS average"


@query(f"WITH {_TAGGED} SELECT {_RATES} FROM (SELECT split, {_REPORT} FROM t GROUP BY split)")
def split_report(spark, sf_dir):
    return op.split_report(_tagged(spark, sf_dir), ["split"])


@query(f"WITH {_TAGGED} SELECT {_RATES} FROM (SELECT split, {_REPORT} FROM t GROUP BY ROLLUP (split))")
def split_report_rollup(spark, sf_dir):
    return op.split_report(_tagged(spark, sf_dir), ["split"], total=True)


@query(f"WITH {_TAGGED} SELECT reason, count(*) AS n FROM t WHERE reason IS NOT NULL GROUP BY reason")
def failure_histogram(spark, sf_dir):
    return _tagged(spark, sf_dir).filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


@query("SELECT 'region' AS dataset, r_name AS name FROM region UNION ALL SELECT 'nation', n_name FROM nation UNION ALL SELECT 'supplier', s_name FROM supplier")
def union_all_datasets(spark, sf_dir):
    part = lambda t, c: table(spark, sf_dir, t).select(F.lit(t).alias("dataset"), F.col(c).alias("name"))
    return part("region", "r_name").unionByName(part("nation", "n_name")).unionByName(part("supplier", "s_name"))
