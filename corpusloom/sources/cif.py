"""CIF files: all their blocks and loops, cells, symmetry; atoms at Cartesian places."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ATOM = "struct<label:string,sym:string,x:double,y:double,z:double>"
_KIND = pa.list_(pa.struct([("label", pa.string()), ("sym", pa.string()), ("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64())]))
#: Text fields between lines that begin with a semicolon, comments, quoted strings (a quote ends one only before white space), bare words.
_TOKEN = re.compile(r"^;(?P<field>.*?)(?:^;|\Z)|#[^\n]*|(?P<quote>['\"])(?P<quoted>.*?)(?P=quote)(?=\s|\Z)|(?P<word>[^\s#]\S*)", re.MULTILINE | re.DOTALL)
_CELL = ("length_a", "length_b", "length_c", "angle_alpha", "angle_beta", "angle_gamma")
_OPERATORS = ("_symmetry_equiv_pos_as_xyz", "_space_group_symop_operation_xyz", "_space_group_symop.operation_xyz")
_TERM = re.compile(r"([+-]?)(?:(\d+(?:\.\d*)?|\.\d+)(?:/(\d+))?\*?)?([xyz])?")
#: Atoms nearer than this, in Angstrom, are one atom.
SAME = 0.1


def tokens(text: str) -> Iterator[tuple[str, bool]]:
    """(value, quoted) in order; comments are left out. Quoted values and text fields never are keywords or names."""
    for m in _TOKEN.finditer(text.replace("\r\n", "\n").replace("\r", "\n")):
        if m["field"] is not None:
            yield m["field"].removesuffix("\n"), True
        elif m["quoted"] is not None:
            yield m["quoted"], True
        elif m["word"] is not None:
            yield m["word"], False


def blocks(text: str) -> Iterator[tuple[str, dict[str, list[str]]]]:
    """(name, items) of each data block: every name in lower case with the list of its values, one outside of loops."""
    name, items, names, values = None, {}, [], []
    looped = False

    def close() -> None:
        for k, tag in enumerate(names):
            items[tag] = values[k :: len(names)]

    for value, quoted in tokens(text):
        low = value.lower()
        if not quoted and (low.startswith(("data_", "save_", "global_")) or low in ("loop_", "stop_") or low[0] == "_"):
            if low[0] == "_" and looped and not values:
                names.append(low)
                continue
            close()
            names, values, looped = [], [], low == "loop_"
            if low.startswith("data_"):
                if name is not None:
                    yield name, items
                name, items = value[5:], {}
            elif low[0] == "_":
                names = [low]
        elif names:
            values.append(value)
            if not looped and len(values) > 1:
                values.pop()  # a name has one value; more are stray
    close()
    if name is not None:
        yield name, items


def number(value: str | None) -> float | None:
    """A number without its uncertainty in brackets; None for . and ? and what is none."""
    try:
        return float(re.sub(r"\(.*\)$", "", value or ""))
    except ValueError:
        return None


def axes(cell: list[float]) -> np.ndarray | None:
    """Columns a, b, c of a cell: a along x, b in the plane of x and y. None for angles that close no cell."""
    a, b, c = cell[:3]
    alpha, beta, gamma = (math.radians(x) for x in cell[3:])
    x, y = math.cos(beta), (math.cos(alpha) - math.cos(beta) * math.cos(gamma)) / math.sin(gamma) if math.sin(gamma) else math.nan
    rest = 1 - x * x - y * y
    if not rest > 0 or min(a, b, c) <= 0:
        return None
    return np.array([[a, b * math.cos(gamma), c * x], [0, b * math.sin(gamma), c * y], [0, 0, c * math.sqrt(rest)]])


def operator(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Matrix and shift of an operator as ``-x,y+1/2,-z``; None if it doesn't read as one."""
    rows, shift = np.zeros((3, 3)), np.zeros(3)
    parts = re.sub(r"\s", "", text.lower()).split(",")
    if len(parts) != 3:
        return None
    for k, part in enumerate(parts):
        at = 0
        while at < len(part):
            m = _TERM.match(part, at)
            if not m or m.end() == at or m[2] is None and m[4] is None:
                return None
            size = (-1 if m[1] == "-" else 1) * (float(m[2]) / float(m[3] or 1) if m[2] else 1.0)
            if m[4]:
                rows[k, "xyz".index(m[4])] += size
            else:
                shift[k] += size
            at = m.end()
    return rows, shift


def _symbol(text: str) -> str:
    found = re.match(r"[A-Za-z]{1,2}", text or "")
    return found[0].capitalize() if found else ""


def _unique(places: np.ndarray, matrix: np.ndarray, seen: list[np.ndarray]) -> list[np.ndarray]:
    """Places (fractions, within the cell) that are none of those seen, in periodic distance."""
    out: list[np.ndarray] = []
    for p in places:
        apart = np.array([*seen, *out]).reshape(-1, 3) - p
        if not len(apart) or np.linalg.norm((apart - np.round(apart)) @ matrix.T, axis=1).min() >= SAME:
            out.append(p)
    return out


def structure(items: dict[str, list[str]], expand: bool) -> tuple[list[float] | None, list[dict] | None]:
    """Cell and atoms of a block. ``expand`` fills the cell by all symmetry operators, atoms on special places once; without it they are as listed."""
    cell = [number((items.get(f"_cell_{c}") or items.get(f"_cell.{c}") or [None])[0]) for c in _CELL]
    cell = None if None in cell else cell
    get = lambda name: items.get(f"_atom_site_{name}") or items.get(f"_atom_site.{name}")
    labels, symbols = get("label") or get("label_atom_id") or get("id"), get("type_symbol")
    fractions, places = [get(f"fract_{c}") for c in "xyz"], [get(f"cartn_{c}") for c in "xyz"]
    labels = labels or symbols
    given = fractions if all(fractions) else places if all(places) else None
    matrix = axes(cell) if cell else None
    if not labels or given is None or given is fractions and matrix is None:
        return cell, None
    at = np.array([[math.nan if (v := number(x)) is None else v for x in column] for column in given]).T
    rows = [(label, _symbol((symbols or labels)[k])) for k, label in enumerate(labels)]
    if given is fractions:
        if expand:
            found = [operator(t) for name in _OPERATORS for t in items.get(name, [])]
            turns = [f for f in found if f is not None] or [(np.eye(3), np.zeros(3))]
            full, kept, seen = [], [], {}
            for (label, sym), p in zip(rows, at):
                images = [(m @ p + s) % 1.0 for m, s in turns] if np.isfinite(p).all() else [p]
                # of one element only: two that share a place are disorder, not one atom
                new = _unique(np.array(images), matrix, seen.setdefault((sym, label), []))
                seen[sym, label] += new
                kept += new
                full += [(label, sym)] * len(new)
            rows, at = full, np.array(kept).reshape(-1, 3)
        at = at @ matrix.T
    null = lambda v: None if math.isnan(v) else float(v)
    return cell, [{"label": label, "sym": sym, **{c: null(v) for c, v in zip("xyz", p)}} for (label, sym), p in zip(rows, at)]


def read_cif(spark: SparkSession, path: str, expand: bool = False) -> DataFrame:
    """(file, block, cell, atoms) of the data blocks of CIF files: cell lengths and angles, atoms (label, sym, x, y, z) in Angstrom.

    A block without cell or atoms has null there; a missing coordinate is null. ``expand`` fills the cell by symmetry."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, text in zip(*(column.to_pylist() for column in batch.columns)):
                found = [(name, *structure(items, expand)) for name, items in blocks(text)]
                if found:
                    names, cells, atoms = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(found)), pa.array(names), pa.array(cells, pa.list_(pa.float64())), pa.array(atoms, _KIND)], ["file", "block", "cell", "atoms"])

    return raw.mapInArrow(run, f"file string, block string, cell array<double>, atoms array<{ATOM}>")
