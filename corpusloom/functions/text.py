"""Text and number formatting as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prompt and block tags of training text.
SMILES, CONFORMER = ("[SMILES]", "[/SMILES]"), ("[CONFORMER]", "[/CONFORMER]")


def truncate_fixed(x: Column, places: int = 4) -> Column:
    """``x`` cut (not rounded) to ``places`` decimals, as text; never a negative zero. Null stays null."""
    if places < 0:
        raise ValueError("places must not be negative")
    scale = float(10**places)
    t = F.when(x >= 0, F.floor(x * scale).cast("double")).otherwise(F.ceil(x * scale).cast("double")) / scale
    return F.when(x.isNotNull(), F.format_string(f"%.{places}f", F.when(F.abs(t) < 1 / scale, F.lit(0.0)).otherwise(t)))


def format_float(x: Column, places: int = 4) -> Column:
    """Cut like ``truncate_fixed``, without trailing zeros; "N/A" for null and NaN."""
    fixed = truncate_fixed(F.nanvl(x, F.lit(None).cast("double")), places)
    short = F.when(F.contains(fixed, F.lit(".")), F.regexp_replace(fixed, r"\.?0+$", "")).otherwise(fixed)
    return F.coalesce(short, F.lit("N/A"))


def extract_between(text: Column, start: str, end: str) -> Column:
    """What stands between the first start mark and the first end mark after it; "" if either is missing."""
    quote = lambda s: r"\Q" + s + r"\E"
    return F.regexp_extract(text, f"(?s){quote(start)}(.*?){quote(end)}", 1)


def build_unit(canonical: Column, embedded: Column, newline: bool = False) -> Column:
    parts = [F.lit(SMILES[0]), canonical, F.lit(SMILES[1] + CONFORMER[0]), embedded, F.lit(CONFORMER[1] + ("\n" if newline else ""))]
    return F.concat(*parts)


def build_prompt(canonical: Column, open_block: bool = False) -> Column:
    return F.concat(F.lit(SMILES[0]), canonical, F.lit(SMILES[1] + (CONFORMER[0] if open_block else "")))


def unit_validity(canonical: Column, embedded: Column, least: int = 16, most: int | None = None) -> Column:
    """Whether both parts are there, the second is long enough and, given a cap, both together are not too long."""
    ok = (F.length(F.coalesce(canonical, F.lit(""))) > 0) & (F.length(F.coalesce(embedded, F.lit(""))) >= max(least, 1))
    return ok if most is None else ok & (F.length(canonical) + F.length(embedded) <= most)


def safe_filename(name: Column, most: int = 250, suffix: str = ".pickle") -> Column:
    """Slashes as underscores, cut to ``most`` characters, with a suffix."""
    return F.concat(F.substring(F.translate(name, "/\\", "__"), 1, most), F.lit(suffix))


def match_score(prompt: Column, answer: Column) -> Column:
    """1 if equal, else the share of the prompt's characters that the answer has in place; an empty prompt gives 0 unless equal."""
    chars = lambda x: F.filter(F.split(x, ""), lambda c: c != "")
    same = F.size(F.filter(F.zip_with(chars(prompt), chars(answer), lambda x, y: x == y), lambda met: met))
    return F.when(prompt == answer, 1.0).otherwise(F.coalesce(F.try_divide(same.cast("double"), F.length(prompt)), F.lit(0.0)))


def without_prompt(text: Column, prompt: Column) -> Column:
    """The text after its prompt, if it starts with it."""
    return F.when(text.startswith(prompt), F.substring(text, F.length(prompt) + 1, F.length(text))).otherwise(text)


def preview(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def run_name(text: Column) -> Column:
    """Letters, digits, dots, underscores and hyphens stay; every other run of characters is one hyphen."""
    return F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "-")
