"""One query for each operator, over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, conversations, exact_dedup, license_texts, licenses, mixing, pii, quality, simhash, token_counts, toxicity, vector_codes, warc
from .common import hex64, new_folder
from .oracles import conversations_sql, vector_codes_sql

#: The rank file of the tokenizer queries, of the installed public vocabularies.
RANKS = "byte_bpe_multi_50k.tiktoken"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = RANKS) -> tuple[str, str]:
    """Path and split pattern of a public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), hex64(F.col("fp")).alias("fingerprint"), "component_id")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_read(spark, sf_dir, "embeddings"), query_every=50, k=5)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_read(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, cap=2.0)
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_read(spark, sf_dir, "documents"), *vocabulary()).withColumnRenamed("id", "doc_id")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_read(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = quality.fit(docs, _read(spark, sf_dir, "labels"))
    scored = quality.score(docs, model).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "warc")
    warc.write_archive(_read(spark, sf_dir, "pages"), path)
    return warc.summary(warc.read_archive(spark, path))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_groups(_read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha256").alias("text_sha256"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every document before and after three edits of it: words put in, a stretch cut out, a line put first."""
    docs = _read(spark, sf_dir, "documents")
    where = F.pmod(F.xxhash64("doc_id"), F.lit(4000))
    steps = F.array(
        F.struct(F.lit(1).alias("seq"), where.alias("at"), F.lit(0).alias("removed"), F.lit(" as edited later,").alias("added")),
        F.struct(F.lit(2).alias("seq"), F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4000)).alias("at"), F.lit(30).alias("removed"), F.lit("").alias("added")),
        F.struct(F.lit(3).alias("seq"), F.lit(0).cast("long").alias("at"), F.lit(0).alias("removed"), F.lit("Revised.\n").alias("added")),
    )
    edits = docs.select("doc_id").distinct().select(F.col("doc_id").alias("id"), F.inline(steps))
    path, pattern = vocabulary()
    counted = token_counts.recount(token_counts.build(docs, path, pattern), edits, path, pattern, ids=docs.select("doc_id"))
    return counted.select(F.col("id").alias("doc_id"), "tokens_before", "tokens_after", "chars_after", "chars_encoded")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_read(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.report(_read(spark, sf_dir, "conversations")).withColumnRenamed("id", "conv_id")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash, op2_ann, op3_mixing, op4_licenses, op5_bpe, op6_pii, op7_quality, op8_warc, op9_exact_dedup, op10_token_counts, op11_vector_codes, op12_conversations, op13_toxicity)
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP8_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id,
             row_number() OVER (PARTITION BY payload_digest ORDER BY page_id) AS rn FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes < 100 OR rn = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes < 100 OR rn = 1 THEN NULL ELSE first_id END AS refers_to
FROM f"""

OP9_SQL = f"""
WITH d AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256, {_LOWER} AS t FROM documents),
g AS (SELECT *, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g"""

_ACCOUNTS = "|".join(rf"{country}[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, countries in pii.IBAN_LENGTHS.items() for country in countries)
_PII_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[ -]?[0-9])+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": rf"\b(?:{_ACCOUNTS})\b",
    "secret": r"\b(?:[0-9A-Fa-f]{64}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{32}|AKIA[A-Z0-9]{16}|gh[opsu]_[A-Za-z0-9]{36})\b",
}
_D = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_D}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(reverse({_D}), i, 1) AS INT) ELSE (CAST(substr(reverse({_D}), i, 1) AS INT) * 2) % 10 + (CAST(substr(reverse({_D}), i, 1) AS INT) // 5) END)) % 10 = 0"
_TURNED = "(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4))"
_MOD97 = f"list_reduce(list_prepend(0, list_transform(range(1, length({_TURNED}) + 1), lambda i: CASE WHEN substr({_TURNED}, i, 1) BETWEEN '0' AND '9' THEN ascii(substr({_TURNED}, i, 1)) - 48 ELSE ascii(substr({_TURNED}, i, 1)) - 55 END)), lambda a, b: CASE WHEN b < 10 THEN (a * 10 + b) % 97 ELSE (a * 100 + b) % 97 END) = 1"
_PII_OK = {
    "email": "true",
    "ip": "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR lpad(ltrim(p, '0'), 3, '0') > '255')) = 0",
    "card": f"length({_D}) BETWEEN 14 AND 19 AND {_LUHN}",
    "phone": f"length({_D}) BETWEEN 10 AND 15",
    "iban": _MOD97,
    "secret": "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]')",
}


def _pii_sql() -> str:
    parts = []
    for rank, (kind, pattern) in enumerate(_PII_PATTERNS.items()):
        plain, near = pii.SCORES[kind]
        around = f"translate(around, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        score = f"CASE WHEN regexp_matches({around}, '{pii.CONTEXT[kind]}') THEN '{near}' ELSE '{plain}' END"
        parts.append(f"""SELECT rid, {rank} AS rank, '{kind}' AS kind, m, start, {score} AS score FROM (
  SELECT rid, unnest(found) AS m, unnest(list_transform(range(1, len(found) + 1), lambda i: right(parts[i], {pii.NEAR}) || chr(10) || left(parts[i + 1], {pii.NEAR}))) AS around, unnest(list_transform(range(1, len(found) + 1), lambda i:
         list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0))) AS start
  FROM (SELECT rid, regexp_extract_all(t, '{pattern}') AS found, regexp_split_to_array(t, '{pattern}') AS parts FROM d WHERE regexp_matches(t, '{pattern}'))
) WHERE {_PII_OK[kind]}""")
    found = "\nUNION ALL\n".join(parts)
    item = "kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + length(m) AS BIGINT)"
    counts = ", ".join(f"CAST(count(*) FILTER (WHERE rank = {i}) AS BIGINT) AS n_{k}" for i, k in enumerate(pii.BASE))
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({found}),
j AS (SELECT rid, {counts}, string_agg({item}, ',' ORDER BY start, rank) FILTER (WHERE rank < 4) AS base, string_agg({item}, ',' ORDER BY start, rank) AS spans, string_agg(score, ',' ORDER BY start, rank) AS scores FROM s GROUP BY rid)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in pii.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM d LEFT JOIN j USING (rid)"""


def _license_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def canonical(x: str) -> str:
        out = f"regexp_replace(lower(coalesce({x}, '')), '\r\n?', '\n', 'g')"
        out = f"replace(regexp_replace({out}, {quote(licenses.COPYRIGHT_LINE)}, ' ', 'g'), '&', ' and ')"
        out = rf"trim(regexp_replace({out}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
        for pattern, same, _ in licenses.EQUIVALENT:
            same = same.replace("$1", "\\1").replace("$2", "\\2")
            out = f"regexp_replace({out}, {quote(pattern)}, {quote(same)}, 'g')"
        return out

    known = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in license_texts.KNOWN)
    long = ", ".join(f"('{digest}', '{name}')" for name, digest, _ in license_texts.LONG)
    return f"""
WITH k AS (SELECT digest, min(license) AS license FROM (SELECT sha256({canonical('body')}) AS digest, license FROM (VALUES {known}) v(license, body) UNION ALL SELECT * FROM (VALUES {long}) w(digest, license)) GROUP BY 1),
d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
l AS (SELECT rid, unnest(string_split(regexp_replace(coalesce(text, ''), '\r\n?', '\n', 'g'), '\n')) AS line FROM d),
n AS (SELECT rid, string_agg(DISTINCT k.license, ',' ORDER BY k.license) AS notices FROM l JOIN k ON sha256({canonical('line')}) = k.digest GROUP BY rid),
b AS (SELECT DISTINCT array_to_string(w[1:{licenses.ANCHOR_WORDS}], ' ') AS anchor, len(w) AS words FROM (SELECT string_split({canonical('body')}, ' ') AS w FROM (VALUES {known}) v(license, body)) WHERE len(w) >= {licenses.LEAST_WORDS}),
c AS MATERIALIZED (SELECT rid, doc_id, {canonical('text')} AS c FROM d),
p AS (SELECT rid, anchor, words, string_split(' ' || c || ' ', ' ' || anchor || ' ') AS parts FROM c JOIN b ON contains(' ' || c || ' ', ' ' || anchor || ' ')),
o AS (SELECT rid, words, string_split(trim(list_reduce(list_prepend('', parts[i + 1:]), lambda x, y: x || ' ' || anchor || ' ' || y)), ' ')[1:words] AS w FROM (SELECT *, unnest(range(1, len(parts))) AS i FROM p)),
s AS (SELECT rid, string_agg(DISTINCT k.license, ',' ORDER BY k.license) AS contained FROM o JOIN k ON sha256(array_to_string(w, ' ')) = k.digest WHERE len(w) = words GROUP BY rid)
SELECT doc_id, sha256(c) AS digest, k.license, coalesce(notices, '') AS notices, coalesce(contained, '') AS contained
FROM c LEFT JOIN n USING (rid) LEFT JOIN s USING (rid) LEFT JOIN k ON sha256(c) = k.digest"""


ORACLES = {"op4_licenses": _license_sql(), "op6_pii": _pii_sql(), "op8_warc": OP8_SQL, "op9_exact_dedup": OP9_SQL, "op11_vector_codes": vector_codes_sql(), "op12_conversations": conversations_sql()}
