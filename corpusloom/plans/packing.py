"""Queries over packed samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import packing as op
from ..session import table
from ..sources.staging import staged
from .registry import query
from .views import CORPUS_SQL, corpus

SEQ = 2048
#: whole: all tokens of a unit; n_tokens: those that fit a sample with a separator
_UNITS = f"{CORPUS_SQL}, u AS (SELECT conf, '[SMILES]' || canonical || '[/SMILES][CONFORMER]' || embedded || '[/CONFORMER]' AS unit FROM v_mol WHERE length(canonical) > 0 AND length(embedded) >= 16), n AS (SELECT conf, unit, length(unit) AS whole, least(length(unit), {SEQ - 1}) AS n_tokens FROM u)"


def _units(spark, sf_dir):
    m = corpus(spark, sf_dir)
    m = m.filter(text.unit_validity(F.col("canonical"), F.col("embedded")))  # the cheap test first
    return m.select("conf", text.build_unit(F.col("canonical"), F.col("embedded")).alias("unit"))


def _whole(spark, sf_dir):
    """Units in full, as chunk packing reads them: (conf, n_tokens), staged, so that texts are read and put into canonical form once."""
    marks = F.length(text.build_unit(F.lit(""), F.lit("")))
    lengths = staged(corpus(spark, sf_dir).select("conf", F.length("canonical").alias("a"), F.length("embedded").alias("b")), "lengths")
    return lengths.filter("a > 0 and b >= 16").select("conf", (F.col("a") + F.col("b") + marks).cast("long").alias("n_tokens"))


def _sizes(spark, sf_dir):
    """Units cut to fit a sample, as best-fit packing reads them."""
    return _whole(spark, sf_dir).withColumn("n_tokens", F.least("n_tokens", F.lit(SEQ - 1).cast("long")))


@query(f"WITH {_UNITS} SELECT conf, CAST(n_tokens AS INT) AS n_tokens, CAST(list_sum(list_transform(string_split(left(unit, {SEQ - 1}), ''), lambda c: ord(c))) AS BIGINT) AS code_sum FROM n")
def unit_tokens(spark, sf_dir):
    t = op.truncated(op.char_tokens(F.col("unit")), SEQ)
    return _units(spark, sf_dir).select("conf", t.alias("t")).select("conf", F.size("t").alias("n_tokens"), F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + x).alias("code_sum"))


@query(f"WITH {_UNITS}, t AS (SELECT conf, list_transform(string_split(left(unit, {SEQ - 1}), ''), lambda c: ord(c)) AS t FROM n), s AS (SELECT conf, len(t) AS n, list_concat(t, list_transform(range(0, {SEQ} - len(t)), lambda i: 0)) AS s FROM t) SELECT conf, n, md5(array_to_string(s, ' ')) AS sample, md5(array_to_string(list_transform(range(1, {SEQ + 1}), lambda i: CASE WHEN i >= n + 1 OR i = {SEQ} THEN -100 ELSE s[i + 1] END), ' ')) AS labels FROM s")
def label_shift(spark, sf_dir):
    """Samples with labels: a unit, its separator and padding; digests of both."""
    t = op.truncated(op.char_tokens(F.col("unit")), SEQ)
    s = _units(spark, sf_dir).select("conf", t.alias("t")).select("conf", F.size("t").alias("n"), op.finalize(F.col("t"), SEQ, 0).alias("s"))
    digest = lambda a: F.md5(F.array_join(a.cast("array<string>"), " "))
    return s.select("conf", F.col("n").cast("long").alias("n"), digest(F.col("s")).alias("sample"), digest(op.labels(F.col("s"), F.col("n") + 1)).alias("labels"))


_LAID = f"{_UNITS}, l AS (SELECT conf, whole, sum(whole) OVER (ORDER BY conf) AS stop FROM n), c AS (SELECT conf, stop - whole AS start, stop, unnest(range(CAST((stop - whole) // {SEQ + 1} AS BIGINT), CAST((stop - 1) // {SEQ + 1} + 1 AS BIGINT))) AS block FROM l)"
_PIECES = f"{_LAID}, p AS (SELECT block, conf, CAST(greatest(start, block * {SEQ + 1}) - start AS BIGINT) AS \"from\", CAST(least(stop, (block + 1) * {SEQ + 1}) - start AS BIGINT) AS \"to\" FROM c)"


@query(f'WITH {_PIECES} SELECT block, conf, "from", "to" FROM p')
def pack_chunk(spark, sf_dir):
    return op.pack_chunks(_whole(spark, sf_dir), ["conf"], SEQ)


@query(f'WITH {_PIECES}, b AS (SELECT block, count(*) AS items, sum("to" - "from") AS used FROM p GROUP BY block) SELECT count(*) AS samples, CAST(sum(items) AS BIGINT) AS items, CAST(sum(used) AS BIGINT) AS tokens, CAST(count(*) * {SEQ + 1} - sum(used) AS BIGINT) AS padding, round(sum(used) / (count(*) * {SEQ + 1}), 6) AS utilization FROM b')
def token_accounting(spark, sf_dir):
    p = op.pack_chunks(_whole(spark, sf_dir), ["conf"], SEQ)
    bins = p.groupBy("block").agg(F.count("*").alias("items"), F.sum(F.col("to") - F.col("from")).alias("used"))
    return op.accounts(bins, SEQ + 1)


@query(f"WITH {_UNITS}, s AS (SELECT count(*) AS sampled, count(*) FILTER (WHERE length(embedded) >= 400) AS valid, CAST(sum(CASE WHEN length(embedded) >= 400 THEN least(length(embedded), {SEQ - 1}) + 1 END) AS BIGINT) AS size FROM v_mol WHERE conf % 10 = 0), a AS (SELECT count(*) AS lines FROM v_mol), e AS (SELECT valid / sampled AS valid_ratio, CAST(floor(lines * (valid / sampled)) AS BIGINT) AS valid_lines, {SEQ} / (size / valid) AS per_sample FROM s, a) SELECT round(valid_ratio, 6) AS valid_ratio, valid_lines, CAST(floor(valid_lines / per_sample) AS BIGINT) AS samples, CAST(ceil(floor(valid_lines / per_sample) / 48) AS BIGINT) AS batches, CAST(floor(valid_lines / per_sample) * {SEQ} AS BIGINT) AS tokens FROM e")
def token_extrapolation(spark, sf_dir):
    """From every tenth line to all lines: an estimate is the feature here."""
    m = corpus(spark, sf_dir)
    n = F.length("embedded")
    s = m.filter("conf % 10 = 0").agg(F.count("*").alias("sampled"), F.count_if(n >= 400).alias("valid"), F.sum(F.when(n >= 400, F.least(n, F.lit(SEQ - 1)) + 1)).alias("size")).first()
    out = op.extrapolate(s["sampled"], s["valid"], m.count(), SEQ / (s["size"] / s["valid"]), 48, SEQ)
    return spark.createDataFrame([(round(out["valid_ratio"], 6), out["valid_lines"], out["samples"], out["batches"], out["tokens"])], "valid_ratio double, valid_lines long, samples long, batches long, tokens long")


def _each(bins):
    """Packed units with their shard and bin."""
    return bins.select(F.explode("units").alias("unit"), F.col("shard").cast("long").alias("shard"), "bin", "used")


#: Best fit step by step: of the first units of a shard's line that fit the open bin the one that leaves least room, the first of equals; where none fits the bin is closed.
_FIT = f"""WITH RECURSIVE {_UNITS}, k AS (SELECT greatest(1, CAST(ceil(sum(n_tokens) / {op.SHARD_TOKENS}) AS BIGINT)) AS shards FROM n),
q AS MATERIALIZED (SELECT conf % shards AS shard, conf AS unit, n_tokens + 1 AS size, row_number() OVER (PARTITION BY conf % shards ORDER BY conf) AS i FROM n, k),
r AS (SELECT shard, list({{'i': i, 'unit': unit, 'size': size}} ORDER BY i) FILTER (WHERE i <= {op.LOOKAHEAD}) AS line, CAST({op.LOOKAHEAD + 1} AS BIGINT) AS nxt, CAST(0 AS BIGINT) AS used, CAST(0 AS BIGINT) AS bin, CAST(NULL AS BIGINT) AS unit, CAST(NULL AS BIGINT) AS at FROM q GROUP BY shard
UNION ALL
SELECT s.shard, CASE WHEN best IS NULL THEN line WHEN q.i IS NULL THEN list_filter(line, lambda w: w.i <> best.i) ELSE list_append(list_filter(line, lambda w: w.i <> best.i), {{'i': q.i, 'unit': q.unit, 'size': q.size}}) END,
  CASE WHEN best IS NULL THEN nxt ELSE nxt + 1 END, CASE WHEN best IS NULL THEN 0 ELSE used + best.size END, CASE WHEN best IS NULL THEN bin + 1 ELSE bin END, best.unit, s.bin
FROM (SELECT *, list_sort(list_transform(list_filter(line, lambda w: w.size <= {SEQ} - used), lambda w: {{'room': {SEQ} - used - w.size, 'i': w.i, 'unit': w.unit, 'size': w.size}}))[1] AS best FROM r WHERE len(line) > 0) s LEFT JOIN q ON q.shard = s.shard AND q.i = s.nxt),
"""
_BINS = f"{_FIT} b AS (SELECT r.shard, r.at AS bin, r.unit, q.size FROM r JOIN q ON q.shard = r.shard AND q.unit = r.unit) SELECT unit, shard, bin, CAST(sum(size) OVER (PARTITION BY shard, bin) AS BIGINT) AS used FROM b"


@query(_BINS)
def pack_bestfit(spark, sf_dir):
    """The bin of every unit: shards by unit number, units in order."""
    sizes = _sizes(spark, sf_dir)
    shards = op.shards_for(sizes)
    return _each(op.pack_best_fit(sizes, "conf", "conf", SEQ, shards, by=F.pmod("conf", F.lit(shards))))


@query(f"WITH {_UNITS} SELECT count(*) AS units, CAST(sum(n_tokens + 1) AS BIGINT) AS tokens, CAST(sum(conf) AS BIGINT) AS id_sum FROM n")
def pack_conservation(spark, sf_dir):
    """Units and tokens after packing; the SQL counts those before."""
    sizes = _sizes(spark, sf_dir)
    bins = op.pack_best_fit(sizes, "conf", "conf", SEQ, shards=op.shards_for(sizes))
    return bins.agg(F.sum(F.size("units")).alias("units"), F.sum("used").alias("tokens"), F.sum(F.aggregate("units", F.lit(0).cast("long"), lambda a, x: a + x)).alias("id_sum"))


@query(_BINS)
def stream_pack(spark, sf_dir):
    """The same bins from a stateful stream that is read to its end."""
    from ..streaming.pack import pack_stream

    sizes = _sizes(spark, sf_dir)
    shards = op.shards_for(sizes)
    return _each(pack_stream(sizes.select(F.col("conf").alias("unit"), "n_tokens"), SEQ, shards, files=2, by=F.pmod("unit", F.lit(shards))))


_BLOCKS = f"""{_PIECES}, x AS (SELECT block, string_split(string_agg(substr(unit, "from" + 1, "to" - "from"), '' ORDER BY p.conf), '') AS c FROM p JOIN n ON n.conf = p.conf GROUP BY block HAVING sum("to" - "from") = {SEQ + 1}), w AS (SELECT block, list_transform(c, lambda v: ord(v)) AS w FROM x)"""


@query(f"WITH {_BLOCKS} SELECT block, md5(array_to_string(w[1:{SEQ}], ' ')) AS x, md5(array_to_string(w[2:{SEQ + 1}], ' ')) AS y FROM w")
def chunk_pairs(spark, sf_dir):
    """Digests of the inputs and next tokens of every full block; the tokens at the end that fill none are dropped."""
    units = _units(spark, sf_dir).select("conf", op.char_tokens(F.col("unit")).alias("t"))
    digest = lambda a: F.md5(F.array_join(F.col(a).cast("array<string>"), " ")).alias(a)
    return op.chunk_pairs(units, ["conf"], "t", SEQ).select("block", digest("x"), digest("y"))


@query("SELECT time_bucket(INTERVAL 1 day, ts) AS day, event_type, count(*) AS n, round(avg(CASE WHEN value > 50 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS rate FROM events GROUP BY 1, 2")
def stream_rates(spark, sf_dir):
    """Daily rates over a watermarked stream, read to its end: what the batch query gives."""
    from ..streaming.rates import daily_rates

    return daily_rates(spark, f"{sf_dir}/events.parquet")


@query("WITH l AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS b FROM documents), s AS (SELECT sum(b) AS sb, count(*) AS sl FROM l WHERE doc_id % 10 = 0), w AS (SELECT sum(b) AS wb, count(*) AS wl FROM l), e AS (SELECT sb * (wl / sl) AS expected, CAST(wb AS DOUBLE) AS actual FROM s, w) SELECT round(expected, 6) AS expected_bytes, actual AS actual_bytes, round(abs(expected - actual), 6) AS difference, round(100 * abs(expected - actual) / actual, 6) AS difference_pct FROM e")
def byte_check(spark, sf_dir):
    """Bytes that every tenth line leads to expect, against all: an estimate is the feature here."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("lines"), (F.octet_length(F.coalesce("text", F.lit(""))) + 1).alias("n_bytes"))
    out = op.check_bytes(lines.filter("doc_id % 10 = 0"), lines)
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@query("SELECT key, vec_id, place FROM (SELECT label AS key, vec_id, row_number() OVER (PARTITION BY label ORDER BY md5('5:' || vec_id), vec_id) AS place FROM embeddings) WHERE place <= 20")
def array_sample(spark, sf_dir):
    """Twenty of each key's ids: sampling is the feature here. ``op.sampled`` does the same with arrays that are given."""
    v = table(spark, sf_dir, "embeddings").select(F.col("label").alias("key"), "vec_id")
    return op.sample_rows(v, "key", "vec_id", 20, 5)


@query()
def unit_tokens_bpe(spark, sf_dir):
    """Units by a public vocabulary, cut to fit a sample: tests hold the tokens against the library that made it."""
    import public_tokenizers

    units = op.vocabulary_tokens(_units(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return units.select("conf", F.size("tokens").alias("whole"), op.truncated(F.col("tokens"), SEQ).alias("t")).select("conf", "whole", F.size("t").alias("n_tokens"), F.md5(F.array_join(F.col("t").cast("array<string>"), " ")).alias("tokens_md5"))
