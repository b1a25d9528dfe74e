"""The codec for Spark SQL: functions and a table function of named encoders, registered on a session."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from . import codec

#: Encoders by name: a pattern of a string's tokens, and whether atoms carry coordinates.
ENCODERS = {"plain": (codec.PLAIN, False), "enriched": (codec.ENRICHED, True)}
#: Names that stand for others.
ALIASES = {"cartesian": "enriched", "cartesian_v2": "enriched"}


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _replaced(column: str, *steps: tuple[str, str]) -> str:
    for pattern, by in steps:
        column = f"regexp_replace({column}, {_quoted(pattern)}, {_quoted(by)})"
    return column


#: Functions of the session by name: parameters, result and body, which Spark puts in place of a call and optimises like the caller's own.
FUNCTIONS = {
    "strip_text": ("s STRING", "STRING", _replaced("s", (r"\s+", ""), ("<[^>]*>", ""), (codec._ORGANIC, "$1$2"))),
    "normalize_descriptor": ("d STRING", "STRING", _replaced("d", (r"^\[([Cc])H\d*\]$", "[$1]"))),
    "format_descriptor": ("sym STRING, hydrogens INT, charge INT", "STRING", "concat('[', sym, CASE WHEN hydrogens = 0 THEN '' WHEN hydrogens = 1 THEN 'H' ELSE concat('H', hydrogens) END, CASE WHEN charge > 0 THEN '+' WHEN charge < 0 THEN '-' ELSE '' END, CASE WHEN abs(charge) > 1 THEN string(abs(charge)) ELSE '' END, ']')"),
    "bin_index_even": ("x DOUBLE, low DOUBLE, width DOUBLE, n INT", "INT", "greatest(0, least(n, int(floor((x - low) / width)) + 1))"),
    "bin_center": ("i INT, low DOUBLE, width DOUBLE", "DOUBLE", "low + (i - 0.5D) * width"),
}


class Tokens:
    """Rows (pos, type, text[, coords]) of a string's tokens; no rows for a string that doesn't parse."""

    @staticmethod
    def analyze(name: AnalyzeArgument, text: AnalyzeArgument) -> AnalyzeResult:
        found = ALIASES.get(name.value, name.value) if name.isConstantExpression else None
        if found not in ENCODERS:
            raise ValueError(f"unknown encoder {name.value!r}: one of {', '.join(sorted([*ENCODERS, *ALIASES]))}")
        schema = StructType().add("pos", IntegerType()).add("type", StringType()).add("text", StringType())
        return AnalyzeResult(schema.add("coords", ArrayType(DoubleType())) if ENCODERS[found][1] else schema)

    def eval(self, name: str, text: str | None) -> Iterator[tuple]:
        pattern, with_coords = ENCODERS[ALIASES.get(name, name)]
        rows, at = [], 0
        for pos, m in enumerate(re.finditer(pattern, text or "")):
            token = m.group()
            coords = None
            if with_coords and token[0] == "[":
                numbers = [[n.group() for n in re.finditer(codec.NUMBER, part)] for part in token[token.index("<") + 1 : -1].split(",")]
                if len(numbers) != 3 or not all(numbers):
                    return
                coords = [float(n[-1]) for n in numbers]
            if m.start() != at:
                return
            at = m.end()
            atom = token[0] == "[" or token[0].isalpha()
            kind = ("atom_with_coords" if with_coords else "atom") if atom else "nonatom"
            rows.append((pos, kind, token.partition("<")[0], coords) if with_coords else (pos, kind, token))
        if at == len(text or ""):
            yield from rows


def register(spark: SparkSession) -> None:
    """Make ``tokens(encoder, text)`` and the functions above known to SQL of this session; what was registered before is replaced."""
    spark.udtf.register("tokens", udtf(Tokens))
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
