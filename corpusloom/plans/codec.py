"""Queries over structure strings and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codec, text
from ..session import table
from .registry import query
from .views import ATOMS_SQL, CONF_SQL, ENRICHED_SQL, atoms, conformers, enriched, trunc_sql

LOW, HIGH, WIDTH = -0.5, 0.5, 0.05
_LIST = lambda pattern: f"regexp_extract_all(enriched, '{pattern}')"
_STRIP = lambda s: f"regexp_replace(regexp_replace(regexp_replace({s}, '\\s+', '', 'g'), '<[^>]*>', '', 'g'), '\\[(?:([Cc])H\\d*|(Cl|Br|[BCNOPSFIbcnops]))\\]', '\\1\\2', 'g')"


@query(f"SELECT l_orderkey, l_linenumber, {trunc_sql('(l_extendedprice / 7 - 3000)')} AS cut FROM lineitem")
def truncate_fixed(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.truncate_fixed(F.col("l_extendedprice") / 7 - 3000).alias("cut"))


_V = "(CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity / 8 END)"


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN {_V} IS NULL THEN 'N/A' ELSE rtrim(rtrim(printf('%.4f', trunc({_V} * 1e4) / 1e4), '0'), '.') END AS shown FROM lineitem")
def format_float(spark, sf_dir):
    v = F.when(F.col("l_linenumber") == 7, F.lit(None).cast("double")).otherwise(F.col("l_quantity") / 8)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.format_float(v).alias("shown"))


@query(f"WITH {ENRICHED_SQL} SELECT conf_id, enriched FROM v_enriched")
def encode_enriched(spark, sf_dir):
    return enriched(spark, sf_dir)


@query(f"WITH {ENRICHED_SQL} SELECT conf_id, {_STRIP('enriched')} AS plain FROM v_enriched")
def strip_text(spark, sf_dir):
    return enriched(spark, sf_dir).select("conf_id", codec.strip_text(F.col("enriched")).alias("plain"))


@query(f"WITH {ENRICHED_SQL}, p AS (SELECT conf_id, {_STRIP('enriched')} AS s FROM v_enriched), t AS (SELECT conf_id, s, regexp_extract_all(s, '\\[[^\\]]+\\]|%\\d{{2,}}|[=#:/\\\\-]|[()]|\\.|\\d|Cl|Br|[BCNOPSFIH]|[cnopsb]') AS f FROM p) SELECT conf_id, len(f) AS n_tokens, array_to_string(f, ' ') AS tokens FROM t WHERE length(array_to_string(f, '')) = length(s)")
def tokenize_text(spark, sf_dir):
    p = enriched(spark, sf_dir).select("conf_id", codec.tokenize_plain(codec.strip_text(F.col("enriched"))).alias("t")).filter("t is not null")
    return p.select("conf_id", F.size("t").cast("long").alias("n_tokens"), F.array_join("t.text", " ").alias("tokens"))


@query(f"WITH {ENRICHED_SQL}, e AS (SELECT conf_id, CASE WHEN conf_id % 10 = 0 THEN enriched || 'C' ELSE enriched END AS enriched FROM v_enriched), t AS (SELECT conf_id, enriched, {_LIST('\\[[^\\]]+\\]<[^>]*>|%\\d{2,}|[=#:/\\\\-]|[()]|\\d|\\.')} AS f FROM e) SELECT conf_id, length(array_to_string(f, '')) = length(enriched) AS parsed, CAST(CASE WHEN length(array_to_string(f, '')) = length(enriched) THEN len(f) ELSE 0 END AS INT) AS n_tokens FROM t")
def tokenize_enriched(spark, sf_dir):
    """Every tenth string has a stray character behind it and doesn't parse."""
    e = enriched(spark, sf_dir).withColumn("enriched", F.when(F.col("conf_id") % 10 == 0, F.concat("enriched", F.lit("C"))).otherwise(F.col("enriched")))
    t = e.select("conf_id", codec.tokenize_enriched(F.col("enriched")).alias("t"))
    return t.select("conf_id", F.col("t").isNotNull().alias("parsed"), F.coalesce(F.size("t"), F.lit(0)).alias("n_tokens"))


#: Atoms whose letters run into one another: Sc or S and c, Co or C and o, Cn or C and n.
AMBIGUOUS = ("C", "o", "Sc", "S", "c", "Co", "n", "Cn")
_CHOSEN = f"list_transform(xyz[1:12], lambda v: (['{"', '".join(AMBIGUOUS)}'])[CAST(floor(abs(v) * 1000) AS BIGINT) % {len(AMBIGUOUS)} + 1])"


def _ambiguous(spark, sf_dir):
    symbols = F.array(*map(F.lit, AMBIGUOUS))
    chosen = F.transform(F.slice("xyz", 1, 12), lambda v: F.element_at(symbols, (F.floor(F.abs(v) * 1000) % len(AMBIGUOUS) + 1).cast("int")))
    return conformers(spark, sf_dir).select("conf_id", "xyz", chosen.alias("atoms"))


@query(f"WITH {CONF_SQL} SELECT conf_id, array_to_string({_CHOSEN}, '') AS text, array_to_string({_CHOSEN}, ' ') AS tokens FROM v_conf")
def tokenize_steered(spark, sf_dir):
    """Strings of atoms whose letters could be split in other ways, split as the list of atoms says."""
    rows = _ambiguous(spark, sf_dir).withColumn("text", F.array_join("atoms", ""))
    return rows.select("conf_id", "text", F.array_join(codec.tokenize_steered(F.col("text"), F.col("atoms"))["text"], " ").alias("tokens"))


_POINT = " || ',' || ".join(trunc_sql(f"xyz[3 * i + {c}]") for c in (1, 2, 3))


@query(f"""WITH {CONF_SQL}, a AS (SELECT conf_id, xyz, {_CHOSEN} AS s FROM v_conf), e AS (SELECT conf_id, unnest(range(0, 12)) AS i, s, xyz FROM a)
SELECT conf_id, CASE WHEN conf_id % 6 <> 0 THEN string_agg('[' || s[i + 1] || ']<' || {_POINT} || '>', '' ORDER BY i) END AS enriched FROM e GROUP BY conf_id""")
def annotate_text(spark, sf_dir):
    """Plain strings with their atoms' coordinates; every sixth has one atom less than coordinates and none comes out."""
    rows = _ambiguous(spark, sf_dir)
    points = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: F.slice("xyz", k * 3 + 1, 3))
    atoms_ = F.when(F.col("conf_id") % 6 == 0, F.slice("atoms", 1, 11)).otherwise(F.col("atoms"))
    rows = rows.select("conf_id", points.alias("points"), atoms_.alias("atoms")).withColumn("text", F.array_join("atoms", ""))
    return rows.select("conf_id", codec.annotate(F.col("text"), F.col("points"), F.col("atoms")).alias("enriched"))


_COORDS = "list_transform(string_split(regexp_extract(tok, '<([^>]*)>', 1), ','), lambda p: CAST(p AS DOUBLE))"


@query(f"WITH {ENRICHED_SQL}, t AS (SELECT conf_id, unnest({_LIST('\\[[^\\]]+\\]<[^>]*>')}) AS tok FROM v_enriched), c AS (SELECT conf_id, {_COORDS} AS c FROM t) SELECT conf_id, round(sum(c[1]), 6) AS sx, round(sum(c[2]), 6) AS sy, round(sum(c[3]), 6) AS sz FROM c GROUP BY conf_id")
def parse_coords(spark, sf_dir):
    t = enriched(spark, sf_dir).select("conf_id", F.explode(codec.tokenize_enriched(F.col("enriched"))).alias("t")).filter("t.coords is not null")
    return t.groupBy("conf_id").agg(*(F.round(F.sum(F.element_at("t.coords", k + 1)), 6).alias(f"s{c}") for k, c in enumerate("xyz")))


@query(f"WITH {ENRICHED_SQL}, d AS (SELECT conf_id, {_STRIP('enriched')} AS plain, list_transform({_LIST('\\[[^\\]]+\\]<[^>]*>')}, lambda tok: {_COORDS}) AS cs FROM v_enriched) SELECT conf_id, plain, len(cs)::INT AS n_atoms, cs[1][1] AS x0, cs[21][3] AS z20 FROM d")
def decode_enriched(spark, sf_dir):
    d = enriched(spark, sf_dir).select("conf_id", codec.decode_enriched(F.col("enriched")).alias("d"))
    return d.select("conf_id", "d.plain", F.size("d.coords").alias("n_atoms"), F.element_at(F.element_at("d.coords", 1), 1).alias("x0"), F.element_at(F.element_at("d.coords", 21), 3).alias("z20"))


@query(f"WITH {ENRICHED_SQL}, l AS (SELECT conf_id, unnest(regexp_extract_all(replace(enriched, '[C]', '~C'), '(?:\\[[^\\]]+\\]|Cl|Br|[A-Za-z])<[^>]*>')) AS tok FROM v_enriched) SELECT conf_id, count(*) AS n_atoms, string_agg(DISTINCT regexp_extract(tok, '^([^<]*)', 1), ' ' ORDER BY regexp_extract(tok, '^([^<]*)', 1)) AS kinds FROM l GROUP BY conf_id")
def decode_legacy(spark, sf_dir):
    """Bare carbons after a stray mark: gaps are skipped, all atoms are found."""
    d = enriched(spark, sf_dir).select("conf_id", F.explode(codec.decode_loose(F.replace("enriched", F.lit("[C]"), F.lit("~C")))).alias("a"))
    return d.groupBy("conf_id").agg(F.count("*").alias("n_atoms"), F.array_join(F.array_sort(F.collect_set("a.text")), " ").alias("kinds"))


_BIN = f"CAST(len(list_filter(list_transform(range(0, 20), lambda k: {LOW}::DOUBLE + k * {WIDTH}::DOUBLE), lambda e: e <= x)) AS INT)"


@query(f"WITH {ATOMS_SQL} SELECT conf_id, pos::INT AS pos, {_BIN} AS bin FROM v_atoms")
def bin_index(spark, sf_dir):
    return atoms(spark, sf_dir).select("conf_id", "pos", codec.bin_index(F.col("x"), codec.bin_edges(LOW, HIGH, WIDTH)).alias("bin"))


@query(f"WITH {ATOMS_SQL}, b AS (SELECT {_BIN} AS bin, x FROM v_atoms) SELECT bin, count(*) AS n, round({LOW}::DOUBLE + (bin - 0.5::DOUBLE) * {WIDTH}::DOUBLE, 6) AS center FROM b GROUP BY bin")
def bin_center(spark, sf_dir):
    b = atoms(spark, sf_dir).select(codec.bin_index(F.col("x"), codec.bin_edges(LOW, HIGH, WIDTH)).alias("bin"))
    return b.groupBy("bin").agg(F.count("*").alias("n")).select("bin", "n", F.round(codec.bin_center(F.col("bin"), LOW, WIDTH), 6).alias("center"))


@query(f"WITH {ATOMS_SQL}, b AS (SELECT conf_id, pos, {_BIN} AS bin, CAST('0x' || substr(md5('9:' || conf_id || ':' || pos), 1, 8) AS BIGINT) / 4294967296::DOUBLE AS u FROM v_atoms) SELECT conf_id, CAST(pos AS INT) AS pos, round({LOW}::DOUBLE + (bin - 1 + u) * {WIDTH}::DOUBLE, 6) AS drawn FROM b")
def bin_draw(spark, sf_dir):
    b = atoms(spark, sf_dir).select("conf_id", "pos", codec.bin_index(F.col("x"), codec.bin_edges(LOW, HIGH, WIDTH)).alias("bin"))
    return b.select("conf_id", "pos", F.round(codec.bin_draw(F.col("bin"), LOW, WIDTH, 9, F.col("conf_id"), F.col("pos")), 6).alias("drawn"))


_GRID = lambda c: f"lpad(CAST(greatest(0, least(20, CAST(floor(({c} + 0.5) / 0.05) AS INT) + 1)) AS VARCHAR), 3, '0')"


@query(f"WITH {ATOMS_SQL} SELECT conf_id, string_agg('[' || sym || ']<' || {_GRID('x')} || ',' || {_GRID('y')} || ',' || {_GRID('z')} || '>', '' ORDER BY pos) AS binned FROM v_atoms GROUP BY conf_id")
def encode_binned(spark, sf_dir):
    i = [codec.bin_index_even(F.col(c), LOW, WIDTH, 20) for c in "xyz"]
    one = F.concat(F.lit("["), "sym", F.lit("]"), codec.encode_binned(F.array(*i), 20))
    rows = atoms(spark, sf_dir).select("conf_id", "pos", one.alias("t"))
    return rows.groupBy("conf_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda s: s["t"]), "").alias("binned"))


@query(f"WITH {ATOMS_SQL} SELECT regexp_replace('[' || sym || ']', '^\\[([Cc])H\\d*\\]$', '[\\1]') AS desc_text, count(*) AS n FROM v_atoms GROUP BY 1")
def normalize_desc(spark, sf_dir):
    return atoms(spark, sf_dir).groupBy(codec.normalize_descriptor(F.concat(F.lit("["), "sym", F.lit("]"))).alias("desc_text")).agg(F.count("*").alias("n"))


_H, _Q = "(pos % 4)", "(pos % 5 - 2)"


@query(f"WITH {ATOMS_SQL} SELECT '[' || sym || CASE WHEN {_H} = 0 THEN '' WHEN {_H} = 1 THEN 'H' ELSE 'H' || {_H} END || CASE WHEN {_Q} = 0 THEN '' WHEN {_Q} > 0 THEN '+' ELSE '-' END || CASE WHEN abs({_Q}) > 1 THEN CAST(abs({_Q}) AS VARCHAR) ELSE '' END || ']' AS desc_text, count(*) AS n FROM v_atoms GROUP BY 1")
def format_desc(spark, sf_dir):
    d = codec.format_descriptor(F.col("sym"), F.col("pos") % 4, F.col("pos") % 5 - 2)
    return atoms(spark, sf_dir).groupBy(d.alias("desc_text")).agg(F.count("*").alias("n"))


@query(f"WITH {ENRICHED_SQL}, s AS (SELECT conf_id, enriched || CASE WHEN conf_id % 2 = 0 THEN '/C' ELSE '' END AS s FROM v_enriched) SELECT contains(s, '@') AS chiral, regexp_matches(s, '\\[[^\\]]*H[0-9]*[^\\]]*\\]') AS hydrogens, regexp_matches(s, '\\[[^\\]]*[+-][0-9]*[^\\]]*\\]') AS charged, regexp_matches(s, '[\\\\/]') AS directed, count(*) AS n FROM s GROUP BY ALL")
def regex_flags(spark, sf_dir):
    s = enriched(spark, sf_dir).select(F.concat("enriched", F.when(F.col("conf_id") % 2 == 0, "/C").otherwise("")).alias("s"))
    flags = {"chiral": "@", "hydrogens": r"\[[^\]]*H[0-9]*[^\]]*\]", "charged": r"\[[^\]]*[+-][0-9]*[^\]]*\]", "directed": r"[\\/]"}
    return s.select(*(F.rlike("s", F.lit(p)).alias(k) for k, p in flags.items())).groupBy(*flags).agg(F.count("*").alias("n"))


@query("SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages")
def extract_between(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.extract_between(F.col("html"), "<title>", "</title>").alias("title"))


@query("SELECT conv_id, turn, '[SMILES]' || role || '[/SMILES][CONFORMER]' || text || '[/CONFORMER]' AS unit FROM conversations")
def build_unit(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.build_unit(F.col("role"), F.col("text")).alias("unit"))


@query("WITH g AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) SELECT conv_id, CAST(copy AS INT) AS copy, '[SMILES]' || conv_id || '[/SMILES][CONFORMER]' AS prompt FROM (SELECT conv_id, unnest(range(1, greatest(2 * n, 1) + 1)) AS copy FROM g)")
def prompt_expand(spark, sf_dir):
    """Twice as many prompts as there are members of a group, one at least."""
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    rows = g.select("conv_id", F.explode(F.sequence(F.lit(1), F.greatest(2 * F.col("n"), F.lit(1)).cast("int"))).alias("copy"))
    return rows.select("conv_id", "copy", text.build_prompt(F.col("conv_id").cast("string"), True).alias("prompt"))


@query(r"SELECT page_id, substr(translate(url, '/\', '__'), 1, 250) || '.pickle' AS file FROM pages")
def filename_sanitize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.safe_filename(F.col("url")).alias("file"))


_AB = "text AS a, substr(text, 2 - (conv_id % 2)::INT) AS b"


@query(f"WITH p AS (SELECT conv_id, turn, {_AB} FROM conversations) SELECT conv_id, turn, round(CASE WHEN a = b THEN 1.0::DOUBLE WHEN length(a) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: substr(a, i, 1) = substr(b, i, 1)))::DOUBLE / length(a) END, 6) AS score FROM p")
def match_reward(spark, sf_dir):
    p = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("a"), F.substr("text", F.lit(2) - (F.col("conv_id") % 2).cast("int")).alias("b"))
    return p.select("conv_id", "turn", F.round(text.match_score(F.col("a"), F.col("b")), 6).alias("score"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE json_valid(props)")
def jsonl_parse(spark, sf_dir):
    """Rows whose JSON doesn't parse are left out."""
    parsed = F.from_json("props", "k long, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return table(spark, sf_dir, "events").select("event_id", parsed.alias("p")).filter("p is not null and p._bad is null").select("event_id", "p.k")


@query("SELECT source, count(*) AS lines, CAST(sum(strlen(text) + 1) AS BIGINT) AS n_bytes FROM documents GROUP BY source")
def line_byte_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("lines"), F.sum(F.octet_length("text") + 1).alias("n_bytes"))


@query("WITH o AS (SELECT source, strlen(text) + 1 AS b, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) SELECT source, CAST(sum(b) AS BIGINT) AS n_bytes FROM o WHERE n <= 10 GROUP BY source")
def prefix_bytes(spark, sf_dir):
    from pyspark.sql import Window

    d = table(spark, sf_dir, "documents").select("source", "doc_id", (F.octet_length("text") + 1).alias("b"))
    return d.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).filter("n <= 10").groupBy("source").agg(F.sum("b").alias("n_bytes"))
