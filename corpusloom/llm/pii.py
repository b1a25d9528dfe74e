"""Personal data and secrets: regular expressions propose spans, checksums confirm them, context words set their scores.

DataFrame functions only. A kind's spans come from splitting a text at its matches: the lengths of the parts and
of the matches, added up by doubling steps, are the positions. No list grows a match at a time and no span looks
at the whole text, so n matches take n log n steps. The patterns below match exactly what the plain ones in the
comments do, leftmost first, but can't recurse or backtrack over more than a match.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: Characters of an account number by country, as registered.
IBAN_LENGTHS = {
    15: ("NO",), 16: ("BE",), 18: ("DK", "FI", "FK", "FO", "GL", "NL", "SD"), 19: ("MK", "SI"), 20: ("AT", "BA", "EE", "KZ", "LT", "LU", "MN", "XK"),
    21: ("CH", "CR", "HR", "LI", "LV"), 22: ("BG", "BH", "DE", "GB", "GE", "IE", "ME", "RS", "VA"), 23: ("AE", "GI", "IL", "IQ", "OM", "SO", "TL"),
    24: ("AD", "CZ", "ES", "MD", "PK", "RO", "SA", "SE", "SK", "TN", "VG"), 25: ("LY", "PT", "ST"), 26: ("IS", "TR"), 27: ("BI", "DJ", "FR", "GR", "IT", "MC", "MR", "SM"),
    28: ("AL", "AZ", "BY", "CY", "DO", "GT", "HN", "HU", "LB", "NI", "PL", "SV"), 29: ("BR", "EG", "PS", "QA", "UA"), 30: ("JO", "KW", "MU", "YE"), 31: ("MT", "SC"), 32: ("LC",), 33: ("RU",),
}
_IBAN = "|".join(rf"(?:{'|'.join(countries)})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}" for n, countries in IBAN_LENGTHS.items())
#: kind -> (pattern, condition that any text with a match meets, checked first)
# email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
# ip    [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
# card  [0-9]([\x20-]?[0-9])+
# phone \+[0-9][\x20().0-9-]+[0-9]
# iban  a word that begins with a country and two digits, as long as the country's numbers, single spaces not counted
# secret  a word of 32, 40 or 64 hexadecimal digits, or a key with a well-known beginning
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": rf"(?<![A-Za-z0-9_])(?:{_IBAN})(?![A-Za-z0-9_])",
    "secret": r"(?<![A-Za-z0-9_])(?:[0-9A-Fa-f]{64}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{32}|AKIA[A-Z0-9]{16}|gh[opsu]_[A-Za-z0-9]{36})(?![A-Za-z0-9_])",
}
HINTS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "secret": r"[0-9A-Za-z]{20}"}
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "secret")
#: Words (A-Z lower-cased) that make a kind more likely.
CONTEXT = {
    "email": r"(?:^|[^a-z0-9_])(?:e-?mail|mail|contact|write|address)",
    "ip": r"(?:^|[^a-z0-9_])(?:ip|host|server|address|network)(?:$|[^a-z0-9_])",
    "card": r"(?:^|[^a-z0-9_])(?:card|visa|mastercard|credit|payment|karte|carte|tarjeta)",
    "phone": r"(?:^|[^a-z0-9_])(?:phone|call|tel|tél|mobile|fax)",
    "iban": r"(?:^|[^a-z0-9_])(?:iban|bank|account|konto|compte|cuenta)",
    "secret": r"(?:^|[^a-z0-9])(?:token|key|secret|password|passwd|pwd|credential)",
}
#: They count within so many characters before or after a span, as far as the next match of its kind.
NEAR = 40
#: Score of a confirmed span without and with a context word near.
SCORES = {"email": (0.9, 1.0), "ip": (0.6, 0.9), "card": (0.8, 1.0), "phone": (0.7, 0.95), "iban": (0.9, 1.0), "secret": (0.5, 0.95)}
_SPAN = "struct<start:int,rank:int,stop:int,match:string,kind:string,score:double,first_byte:int,last_byte:int>"


def _running(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """Each value added up with all before it, in doubling steps: ``values`` is a name bound by ``let``."""
    steps = F.filter(F.array(*(F.lit(1 << k) for k in range(31))), lambda s: s < F.size(values))
    step = lambda a, s: F.transform(a, lambda v, i: F.when(i >= s, add(v, F.get(a, i - s))).otherwise(v))
    return F.aggregate(steps, values, step)


def _sums(values: Column) -> Column:
    return let(values, lambda v: _running(v, lambda a, b: a + b))


def _lowered(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    """Whether the digits of a match pass Luhn: from the right, every second one doubled, its digits added."""
    d = F.split(F.reverse(_digits(m)), "")
    values = F.transform(F.filter(d, lambda c: c != ""), lambda c, i: F.when(i % 2 == 1, (c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, c: a + c) % 10 == 0


def _mod97(m: Column) -> Column:
    """Whether an account number leaves 1: the first four characters moved to the end, letters as 10 to 35."""
    plain = F.regexp_replace(m, " ", "")
    turned = F.split(F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4)), "")
    chars = F.filter(turned, lambda c: c != "")
    step = lambda a, c: F.when(c.between("0", "9"), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(chars, F.lit(0), step) == 1


def _confirmed(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        parts = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.lpad(p, 3, "0") <= "255"))
    if kind == "iban":
        return _mod97(m)
    if kind == "secret":
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    n = F.length(_digits(m))
    if kind == "card":
        return F.when(n.between(14, 19), _luhn(m)).otherwise(F.lit(False))
    return n.between(10, 15)


def _spans(kind: str, text: Column) -> Column:
    """Array of a kind's confirmed spans, code points and bytes, ends exclusive."""
    pattern, (plain, near) = PATTERNS[kind], SCORES[kind]

    def of_matches(b: Column) -> Column:
        ends = _sums(F.transform(b["m"], lambda m, i: F.length(F.get(b["p"], i)) + F.length(m)))
        byte_ends = _sums(F.transform(b["m"], lambda m, i: F.octet_length(F.get(b["p"], i)) + F.octet_length(m)))
        return let(F.struct(b["m"].alias("m"), b["p"].alias("p"), ends.alias("e"), byte_ends.alias("b")), at_ends)

    def at_ends(b: Column) -> Column:
        def span(m: Column, i: Column) -> Column:
            stop, last = F.get(b["e"], i), F.get(b["b"], i)
            around = F.concat_ws("\n", F.right(F.get(b["p"], i), F.lit(NEAR)), F.left(F.get(b["p"], i + 1), F.lit(NEAR)))
            score = F.when(_lowered(around).rlike(CONTEXT[kind]), near).otherwise(plain)
            return F.struct((stop - F.length(m)).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), stop.alias("stop"), m.alias("match"), F.lit(kind).alias("kind"), score.alias("score"), (last - F.octet_length(m)).alias("first_byte"), last.alias("last_byte"))

        return F.transform(b["m"], lambda m, i: F.when(_confirmed(kind, m), span(m, i)))

    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))
    spans = F.filter(let(found, of_matches), lambda s: s.isNotNull()).cast(f"array<{_SPAN}>")
    return F.when(text.rlike(HINTS[kind]), spans).otherwise(F.array().cast(f"array<{_SPAN}>"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id, text, spans), spans array<struct<start, rank, stop, match, kind, score, ...>> by start and kind.

    Positions are code points, ends exclusive (``first_byte`` and ``last_byte`` the same in bytes). The base
    kinds are those of ``BASE``; account numbers (iban) confirmed by mod 97 and secrets come on top. Scores
    rise where a context word stands near. Null texts are empty and have no spans; repeated rows and null ids
    come back as they are; spans of different kinds may overlap, and ties in start go by kind."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.select("id", "text", F.array_sort(F.concat(*(_spans(k, F.col("text")) for k in KINDS))).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def report(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores) of every document."""
    found = find(docs, **how)
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    of_kind = lambda i: F.filter("spans", lambda s: s["rank"] == i)
    counts = [F.size(of_kind(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)]
    scores = F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",")
    return found.select(F.col("id").alias("doc_id"), *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"), scores.alias("scores"))


def redact(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """(id, redacted): spans that score ``least`` or more replaced by [KIND]; overlapping ones become one, named by the first."""
    found = find(docs).select("id", "text", F.filter("spans", lambda s: s["score"] >= least).alias("spans"))

    def merged(b: Column) -> Column:
        """Runs of overlapping spans: a span whose start no earlier one reaches begins a run, the furthest end so far ends it."""
        far = let(F.transform(b["s"], lambda s: s["last_byte"]), lambda v: _running(v, lambda x, y: F.greatest(x, y)))
        return let(F.struct(b["s"].alias("s"), far.alias("far")), heads)

    def heads(b: Column) -> Column:
        index = F.transform(b["s"], lambda s, i: F.when((i == 0) | (s["first_byte"] >= F.get(b["far"], i - 1)), i))
        return let(F.struct(b["s"].alias("s"), b["far"].alias("far"), F.filter(index, lambda i: i.isNotNull()).alias("h")), runs)

    def runs(b: Column) -> Column:
        end = lambda j: F.get(b["far"], F.coalesce(F.get(b["h"], j + 1), F.size(b["s"])) - 1)
        return F.transform(b["h"], lambda i, j: F.struct(F.get(b["s"], i)["first_byte"].alias("start"), end(j).alias("stop"), F.get(b["s"], i)["kind"].alias("kind")))

    def cut(b: Column) -> Column:
        """Slices of bytes take no longer far into the text than at its start."""
        piece = lambda at, stop: F.substring(b["t"], at + 1, stop - at).cast("string")
        before = lambda j: F.coalesce(F.get(b["r"], j - 1)["stop"], F.lit(0))
        said = F.transform(b["r"], lambda r, j: F.concat(piece(before(j), r["start"]), F.lit("["), F.upper(r["kind"]), F.lit("]")))
        return F.concat(F.array_join(said, ""), piece(before(F.size(b["r"])), F.octet_length(b["t"])))

    merged_runs = let(F.struct(F.col("spans").alias("s")), merged)
    redacted = let(F.struct(F.col("text").cast("binary").alias("t"), merged_runs.alias("r")), cut)
    return found.select("id", redacted.alias("redacted"))
