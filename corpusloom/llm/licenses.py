"""Licence scan: texts brought to a canonical form and looked up among known licences by digest.

DataFrame functions only. A text goes through the rules once, its line breaks kept; the whole text, its
lines and its stretches are then cut from that. Lines whose canonical length no known text has are left out
unhashed. A stretch begins with the first words of a known text, wherever that is wrapped or commented out, and has as
many words. Lines and stretches, each once for a document, meet the known digests in a join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, staged
from .license_texts import KNOWN, LONG

#: Words and spellings that count as the same once only letters, digits and single spaces are left: (pattern, what stands for it, a part that any match has).
EQUIVALENT = (
    (r"(^|[ \n])(sub)?licence", "$1$2license", "licence"),
    (r"(^|[ \n])non infringement( |\n|$)", "$1noninfringement$2", "non infringement"),
    (r"(^|[ \n])merchantibility( |\n|$)", "$1merchantability$2", "merchantibility"),
    (r"(^|[ \n])authorisation( |\n|$)", "$1authorization$2", "authorisation"),
    (r"(^|[ \n])organisation( |\n|$)", "$1organization$2", "organisation"),
    (r"(^|[ \n])copyright (?:owner|owners|holder)( |\n|$)", "$1copyright holders$2", "copyright "),
    (r"(^|[ \n])https ", "$1http ", "https "),
)
#: A line that only says whose the text is: it differs from copy to copy.
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(?:copyright\b|\(c\)|©)[^\n]*(?:\(c\)|©|\d{4}|<year>|\[year\]|\[yyyy\])[^\n]*$|^[^\p{L}\p{N}\n]*all rights reserved\.?[^\p{L}\p{N}\n]*$"
#: One of these is in any such line.
COPYRIGHT_HINTS = ("copyright", "(c)", "©", "all rights reserved")

#: Words that a stretch begins with, and those that a known text has at least to be looked for within others.
ANCHOR_WORDS, LEAST_WORDS = 6, 12


def _rule(pattern: str, same: str, part: str) -> Callable[[Column], Column]:
    return lambda v: F.when(F.contains(v, F.lit(part)), F.regexp_replace(v, pattern, same)).otherwise(v)


def _same(x: Column) -> Column:
    for pattern, same, part in EQUIVALENT:
        x = let(x, _rule(pattern, same, part))
    return x


def canonical_lines(text: Column) -> Column:
    """Lower case, copyright lines gone, punctuation and white space as single spaces, equivalent spellings made one; line breaks stay."""
    out = F.replace(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))

    def owned(x: Column) -> Column:
        hint = F.lit(False)
        for part in COPYRIGHT_HINTS:
            hint = hint | F.contains(x, F.lit(part))
        return F.when(hint, F.regexp_replace(x, COPYRIGHT_LINE, " ")).otherwise(x)

    out = let(out, owned)
    out = F.replace(out, F.lit("&"), F.lit(" and "))
    return _same(F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " "))


def whole(lines: Column) -> Column:
    """The canonical text of canonical lines: one line."""
    return F.trim(_same(F.regexp_replace(lines, r"[ \n]+", " ")))


def canonical(text: Column) -> Column:
    return whole(canonical_lines(text))


def known_digests(spark: SparkSession, known: tuple[tuple[str, str], ...] = KNOWN, digests: tuple[tuple[str, str, int], ...] = LONG) -> DataFrame:
    """(digest, license, size) of known texts, and of licences given by their digest and canonical length; of two with one digest the smaller name stands."""
    rows = spark.createDataFrame(list(known), "license string, body string").select("license", canonical(F.col("body")).alias("body"))
    rows = rows.select(F.sha2("body", 256).alias("digest"), "license", F.length("body").alias("size"))
    if digests:
        rows = rows.unionByName(spark.createDataFrame([(d, name, n) for name, d, n in digests], "digest string, license string, size int"))
    return rows.groupBy("digest").agg(F.min("license").alias("license"), F.min("size").alias("size"))


def anchors(spark: SparkSession, known: tuple[tuple[str, str], ...]) -> list[tuple[str, list[int]]]:
    """The first words of known texts that are long enough, with the numbers of words of those that begin so. For a list of licences: all of it reaches the driver."""
    body = spark.createDataFrame(list(known), "license string, body string").select(canonical(F.col("body")).alias("body"))
    words = body.select(F.split("body", " ").alias("w")).filter(F.size("w") >= LEAST_WORDS)
    first = words.groupBy(F.array_join(F.slice("w", 1, ANCHOR_WORDS), " ").alias("anchor")).agg(F.sort_array(F.collect_set(F.size("w"))).alias("sizes"))
    return [(r["anchor"], r["sizes"]) for r in first.orderBy("anchor").collect()]


def _stretches(text: Column, begins: list[tuple[str, list[int]]]) -> Column:
    """Digests of the stretches of a canonical text that begin like a known one and are as long; they may overlap."""
    none = F.array().cast("array<string>")
    found = []
    for anchor, sizes in begins:
        # looked ahead only, so that a stretch within another is found too; anchors have letters, digits and spaces alone
        each = [F.regexp_extract_all(text, F.lit(rf"(?<![^ ])(?=({anchor}(?: [^ ]+){{{n - ANCHOR_WORDS}}})(?![^ ]))"), F.lit(1)) for n in sizes]
        found.append(F.when(F.contains(text, F.lit(anchor)), F.transform(F.flatten(F.array(*each)), lambda x: F.sha2(x, 256))).otherwise(none))
    return F.array_distinct(F.flatten(F.array(*found))) if found else none


def scan(docs: DataFrame, known: DataFrame | tuple[tuple[str, str], ...] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (doc_id, digest, license, notices, contained).

    ``license`` names the known licence that the entire text is, or is null; ``notices`` lists, sorted and
    comma-joined, those that some entire line is (empty: none), and ``contained`` those of ``LEAST_WORDS`` words or more that some stretch of
    the text is, line breaks, comment signs and copyright lines aside. ``known`` is a table of (digest, license,
    size) as ``known_digests`` gives, of any length, for which no stretches are looked for, or (license, text) pairs; without it the library's own
    list is taken. Null and empty texts, and texts or lines without a letter or digit, match nothing.
    Repeated rows and null ids come back as they are."""
    spark = docs.sparkSession
    begins: list[tuple[str, list[int]]] = []
    if not isinstance(known, DataFrame):
        begins = anchors(spark, KNOWN if known is None else known)
        known = known_digests(spark) if known is None else known_digests(spark, known, ())
    known = staged(known.filter("size > 0").select("digest", "license", "size"), "licences")
    sizes = {r["size"] for r in known.select("size").distinct().collect()}  # at most as many as the longest known text has characters
    bits = F.lit(bytes(n in sizes for n in range(max(sizes, default=0) + 1)))
    text = F.col("lines")
    rows = docs.select(F.col(id_col).alias("doc_id"), canonical_lines(F.col(text_col)).alias("lines"))
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    fits = F.filter(lines, lambda x: F.substring(bits, F.length(x) + 1, F.lit(1)) == F.lit(b"\x01"))
    of_whole = let(whole(text), lambda w: F.struct(F.sha2(w, 256).alias("digest"), _stretches(w, begins).alias("stretches")))
    rows = rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", of_whole.alias("of"), F.transform(F.array_distinct(fits), lambda x: F.sha2(x, 256)).alias("lines"))
    rows = staged(rows.select("rid", "doc_id", "of.digest", "of.stretches", "lines"), "canonical")
    part = lambda c: F.transform(c, lambda x: F.struct(F.lit(c).alias("part"), x.alias("said")))
    said = rows.filter("size(lines) + size(stretches) > 0").select("rid", F.inline(F.concat(part("lines"), part("stretches"))))
    said = said.join(known.select(F.col("digest").alias("said"), F.col("license").alias("notice")), "said")
    named = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(F.col("part") == c, F.col("notice")))), ",")
    notices = said.groupBy("rid").agg(named("lines").alias("notices"), named("stretches").alias("contained"))
    out = rows.drop("lines", "stretches").join(notices, "rid", "left").join(known.select("digest", "license"), "digest", "left")
    return out.select("doc_id", "digest", "license", *(F.coalesce(c, F.lit("")).alias(c) for c in ("notices", "contained")))
