"""Readers and writers of the corpus's file formats."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordering import chunk, global_index, shuffle_key
from .staging import _file_system, staged

ROW = "canonical_smiles string, embedded_smiles string, geom_id string, _bad string"


def expand_paths(spark: SparkSession, *paths: str, suffix: str = ".jsonl") -> list[str]:
    """The files that paths stand for, sorted, each once: globs matched, folders searched through for ``suffix``, files kept. None at all is an error."""
    found: set[str] = set()
    for path in paths:
        system, where = _file_system(spark, path)
        for status in system.globStatus(where) or []:
            if not status.isDirectory():
                found.add(status.getPath().toString())
                continue
            files = system.listFiles(status.getPath(), True)
            while files.hasNext():
                name = files.next().getPath().toString()
                if name.endswith(suffix):
                    found.add(name)
    if not found:
        raise FileNotFoundError(f"no files at {', '.join(paths) or 'no paths'}")
    return sorted(found)


def read_jsonl(spark: SparkSession, *paths: str) -> DataFrame:
    """Corpus rows of files, globs or folders (searched through, ``*.jsonl`` only), fields trimmed, missing ones "". ``_bad`` holds lines that don't parse."""
    if not paths:
        raise ValueError("no paths given")
    rows = spark.read.schema(ROW).option("columnNameOfCorruptRecord", "_bad").json(expand_paths(spark, *paths))
    clean = lambda c: F.trim(F.coalesce(c, F.lit(""))).alias(c)
    return rows.select(clean("canonical_smiles"), clean("embedded_smiles"), "geom_id", "_bad")


def good_rows(rows: DataFrame) -> DataFrame:
    return rows.filter("_bad is null").drop("_bad")


def bad_row_count(rows: DataFrame) -> int:
    """How many lines didn't parse. The rows are staged first: the corrupt column alone can't be read from JSON."""
    return staged(rows, "json").filter("_bad is not null").count()


def line_counts(spark: SparkSession, path: str) -> DataFrame:
    """(file, lines, n_bytes), line ends included."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return text.groupBy("file").agg(F.count("*").alias("lines"), F.sum(F.octet_length("value") + 1).alias("n_bytes"))


def write_jsonl(df: DataFrame, path: str, key: str, seed: int = 0, rows_per_file: int = 1_000_000) -> None:
    """Compact JSON lines in seeded order, ``rows_per_file`` to a file; an earlier result is replaced, never appended to."""
    keyed = global_index(df.withColumn("_k", shuffle_key(seed, 0, F.col(key))), "_k", key, out="_i")
    dealt = keyed.withColumn("_c", chunk(F.col("_i"), rows_per_file)).repartition("_c").sortWithinPartitions("_c", "_i")
    dealt.drop("_k", "_i").write.mode("overwrite").partitionBy("_c").option("maxRecordsPerFile", rows_per_file).json(path)


def read_corrections(spark: SparkSession, path: str) -> DataFrame:
    """(key, corrected) of a CSV with a header: first and third column, blanks as null; a file of fewer columns corrects nothing."""
    raw = spark.read.option("header", "true").csv(path)
    fixed = F.nullif(F.trim(F.col(raw.columns[2])), F.lit("")) if len(raw.columns) >= 3 else F.lit(None).cast("string")
    return raw.select(F.col(raw.columns[0]).alias("key"), fixed.alias("corrected"))


def read_split_indices(spark: SparkSession, path: str) -> DataFrame:
    """(split, idx) of index files: JSON objects of lists (split by name), or plain NumPy arrays of whole numbers, one file a split, named after it. Pickled arrays are refused."""
    raw = spark.read.format("binaryFile").load(expand_paths(spark, path, suffix=""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io
        import json

        import numpy as np

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                stem, _, kind = name.rpartition("/")[2].rpartition(".")
                found = json.loads(content) if kind == "json" else {stem: np.load(io.BytesIO(content), allow_pickle=False).ravel()}
                for split, values in found.items():
                    yield pa.RecordBatch.from_arrays([pa.array([split] * len(values), pa.string()), pa.array(values, pa.int64())], ["split", "idx"])

    return raw.select("path", "content").mapInArrow(run, "split string, idx long")


def read_prompts(spark: SparkSession, path: str, most: int = 150) -> DataFrame:
    value = F.trim("value")
    return spark.read.text(path).select(value.alias("prompt")).filter((F.length("prompt") > 0) & (F.length("prompt") <= most))


def read_token_prompts(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(key, ids) of the first ``n`` keys of a JSON object of lists; values that aren't lists of whole numbers are empty."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "raw"))
    ids = F.coalesce(F.from_json("raw", "array<int>"), F.array().cast("array<int>"))
    return raw.select("key", F.when(F.exists(ids, lambda x: x.isNull()), F.array().cast("array<int>")).otherwise(ids).alias("ids")).orderBy("key").limit(n)


def read_sdf(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, name, n_atoms, atoms, bonds, props) of each record of SDF files (V2000), ``pos`` counting a file's records from 0.

    atoms array<struct<sym, x, y, z>>, bonds array<struct<a, b, order>>. Records are split at their end marks
    by the reader, so a file of any size is read in parallel: a record's place is that in its split plus the
    records of earlier splits. A record whose counts line doesn't parse has null atoms and bonds."""
    meta = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block")]
    raw = spark.read.option("lineSep", "$$$$").text(path).select(*meta, F.monotonically_increasing_id().alias("_row"), F.regexp_replace("value", r"^\r?\n", "").alias("value"))
    raw = raw.filter(F.trim(F.regexp_replace("value", r"[\r\n]", "")) != "")
    lines = F.split("value", r"\r?\n")
    part = lambda a, i: F.try_element_at(a, F.lit(i))
    count = lambda at: F.try_to_number(F.trim(F.substring(part(lines, 4), at, 3)), F.lit("999")).cast("int")
    n, m = count(1), F.coalesce(count(4), F.lit(0))
    cells = lambda line: F.split(F.trim(line), r"\s+")
    atom = lambda line: F.struct(part(cells(line), 4).alias("sym"), *(part(cells(line), k + 1).try_cast("double").alias(c) for k, c in enumerate("xyz")))
    number = lambda line, at: F.trim(F.substring(line, at, 3)).try_cast("int")
    bond = lambda line: F.struct(*(number(line, at).alias(c) for c, at in (("a", 1), ("b", 4), ("order", 7))))
    atoms = F.when(n.isNotNull(), F.transform(F.slice(lines, F.lit(5), n), atom))
    bonds = F.when(n.isNotNull(), F.transform(F.slice(lines, n + 5, m), bond))
    found = F.regexp_extract_all("value", F.lit(r"> *<([^>]+)>[^\n]*\n([^\r\n]*)"), F.lit(0))
    entries = F.transform(found, lambda e: F.struct(F.regexp_extract(e, r"> *<([^>]+)>", 1).alias("key"), F.regexp_extract(e, r"> *<[^>]+>[^\n]*\n([^\r\n]*)", 1).alias("value")))
    rows = raw.select("file", "_block", "_row", F.trim(part(lines, 1)).alias("name"), n.alias("n_atoms"), atoms.alias("atoms"), bonds.alias("bonds"), F.map_from_entries(F.array_distinct(entries)).alias("props"))
    # one row a split
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    splits = raw.groupBy("file", "_block").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy("file", "_block").orderBy("_row")) - 1
    return rows.withColumn("_at", within).join(splits, ["file", "_block"]).select("file", (F.col("_before") + F.col("_at")).alias("pos"), "name", "n_atoms", "atoms", "bonds", "props")


def largest_degree(bonds: Column) -> Column:
    """The most bonds that one atom of a structure has; 0 without bonds."""
    ends = F.concat(F.transform(bonds, lambda x: x["a"]), F.transform(bonds, lambda x: x["b"]))
    return F.coalesce(F.array_max(F.transform(F.array_distinct(ends), lambda e: F.size(F.filter(ends, lambda x: x == e)))), F.lit(0))


def with_index(structures: DataFrame, *order: str, key: str = "name") -> DataFrame:
    """Structures with their number over all files, and it and the name as properties ``mol_index`` and ``mol_id``."""
    numbered = global_index(structures, *order, out="mol_index")
    more = F.create_map(F.lit("mol_index"), F.col("mol_index").cast("string"), F.lit("mol_id"), F.coalesce(F.col(key), F.lit("")))
    kept = F.map_filter(F.coalesce("props", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin("mol_index", "mol_id"))
    return numbered.withColumn("props", F.map_concat(kept, more))


def checked_reload(written: DataFrame, read: DataFrame, key: str, value: str) -> DataFrame:
    """The rows read, once each key is known to have the value that was written; a missing, extra or changed one stops the job."""
    w, r = written.select(F.col(key).alias("_k"), F.col(value).alias("_v"), F.lit(1).alias("_w")), read.withColumn("_r", F.lit(1))
    both = r.join(w, F.col(key).eqNullSafe(F.col("_k")), "full")
    ok = (F.col("_w") == 1) & (F.col("_r") == 1) & F.col(value).eqNullSafe(F.col("_v"))
    fail = F.raise_error(F.concat(F.lit("not as written: "), F.coalesce(F.col(key).cast("string"), F.col("_k").cast("string"), F.lit("null"))))
    return both.filter(F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(fail.cast("boolean"))).select(*read.columns)


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    """(file, frame, n_atoms, comment, atoms) of XYZ files, a row for each structure in a file; exponents written as ``*^`` are read too.

    Where a structure's first line is no number, that row has no atoms and the file ends there."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")

    def structures(text: str) -> Iterator[tuple]:
        lines, at, frame = text.splitlines(), 0, 0
        while at < len(lines) and (lines[at].strip() or not frame):
            n = int(lines[at]) if lines[at].strip().isdigit() else None
            cells = [line.replace("*^", "e").split() for line in lines[at + 2 : at + 2 + (n or 0)]]
            atoms = [{"sym": c[0] if c else None, **{k: _number(c, i + 1) for i, k in enumerate("xyz")}} for c in cells]
            yield frame, n, lines[at + 1] if at + 1 < len(lines) else None, None if n is None else atoms
            if n is None:
                return
            at, frame = at + 2 + n, frame + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("sym", pa.string()), ("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64())]))
        for batch in batches:
            for file, text in zip(*(column.to_pylist() for column in batch.columns)):
                rows = list(structures(text))
                for some in (rows[k : k + 1024] for k in range(0, len(rows), 1024)):
                    frame, n, comment, atoms = zip(*some)
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(some)), pa.array(frame, pa.int32()), pa.array(n, pa.int32()), pa.array(comment, pa.string()), pa.array(atoms, kind)], ["file", "frame", "n_atoms", "comment", "atoms"])

    return raw.mapInArrow(run, "file string, frame int, n_atoms int, comment string, atoms array<struct<sym:string,x:double,y:double,z:double>>")


def _number(cells: list[str], at: int) -> float | None:
    try:
        return float(cells[at])
    except (IndexError, ValueError):
        return None


def write_sdf(df: DataFrame, path: str) -> None:
    """SDF text of (name, atoms, props) and, where there is such a column, bonds: coordinates to four decimals, properties as data items."""
    pad = lambda x, n: F.lpad(x, n, " ")
    line = lambda a: F.concat(*(pad(F.format_string("%.4f", a[c]), 10) for c in "xyz"), F.lit(" "), F.rpad(a["sym"], 3, " "), F.lit(" 0  0  0  0  0  0  0  0  0  0  0  0"))
    link = lambda x: F.concat(*(pad(x[c].cast("string"), 3) for c in ("a", "b", "order")), F.lit("  0\n"))
    bonds = F.coalesce("bonds", F.array()) if "bonds" in df.columns else F.array()
    links = F.array_join(F.transform(bonds, link), "") if "bonds" in df.columns else F.lit("")
    counts = F.concat(pad(F.size("atoms").cast("string"), 3), pad(F.size(bonds).cast("string"), 3), F.lit("  0  0  0  0  0  0  0  0999 V2000"))
    props = F.array_join(F.transform(F.map_entries("props"), lambda e: F.concat(F.lit(">  <"), e["key"], F.lit(">\n"), e["value"], F.lit("\n\n"))), "")
    body = F.concat(F.coalesce("name", F.lit("")), F.lit("\n\n\n"), counts, F.lit("\n"), F.array_join(F.transform("atoms", line), "\n"), F.lit("\n"), links, F.lit("M  END\n"), F.coalesce(props, F.lit("")), F.lit("$$$$"))
    df.select(body.alias("value")).write.mode("overwrite").text(path)


def read_cif_atoms(spark: SparkSession, path: str) -> DataFrame:
    """(file, label, sym, x, y, z): the first plain atom-site loop of CIF files, fractional coordinates, uncertainties in brackets dropped. ``cif.read_cif`` reads all of a file."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_extract("value", r"(?s)loop_\s*((?:\s*_atom_site_(?!aniso)\w+[ \t]*\r?\n)+)(.*?)(?=\r?\n\s*(?:loop_|_|#|data_|\s*$))", 0).alias("loop"))
    names = F.regexp_extract_all("loop", F.lit(r"_atom_site_(\w+)"), F.lit(1))
    rows = F.filter(F.split(F.regexp_replace("loop", r"(?s)^loop_.*_atom_site_\w+[ \t]*\r?\n", ""), r"\r?\n"), lambda s: F.trim(s) != "")
    r = raw.select("file", names.alias("names"), F.explode(rows).alias("row")).withColumn("cells", F.split(F.trim("row"), r"\s+"))
    at = lambda name: F.try_element_at("cells", F.array_position("names", name).cast("int"))
    number = lambda name: F.regexp_replace(at(name), r"\(.*\)", "").try_cast("double")
    has = lambda name: F.array_contains("names", name)
    sym = F.when(has("type_symbol"), at("type_symbol")).otherwise(F.regexp_extract(at("label"), "^[A-Za-z]+", 0))
    return r.filter(has("fract_x") & has("label")).select("file", at("label").alias("label"), sym.alias("sym"), *(number(f"fract_{c}").alias(c) for c in "xyz"))


def write_lines(df: DataFrame, path: str, order: list[str], line: Column) -> None:
    """A text report, one line a row, in order."""
    df.orderBy(*order).select(line.alias("value")).write.mode("overwrite").text(path)
