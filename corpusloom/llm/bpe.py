"""Byte-level BPE: whole texts encoded, long ones in overlapping chunks that are stitched where they agree.

A long text is cut into chunks that overlap. Each is pre-tokenised on its own; the first boundary that two
neighbours share in their overlap is where the later one has fallen into step. From there to the next such
point the chunk's pre-tokens are the text's own, and the pieces are encoded apart. Where neighbours share no
boundary (a run longer than the overlap), the earlier piece goes on to the next place where a pre-token surely
begins. Decoding concatenates the tokens' bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, small_batches, staged

#: Characters of a chunk, and of its overlap with the next.
CHUNK_CHARS = 32_768
OVERLAP = 1_024
#: A boundary so close to a chunk's end may depend on what follows (a contraction cut short).
UNSURE = 4


@cache
def tokenizer(path: str, pattern: str):
    """The tiktoken encoding of a rank file, loaded once in each worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@cache
def _token_bytes(path: str, pattern: str) -> list[bytes]:
    enc = tokenizer(path, pattern)
    return [enc.decode_single_token_bytes(i) for i in range(enc.n_vocab)]


def _texts(column: pa.Array) -> Iterator[str]:
    for value in column:
        yield value.as_py() or ""


def pre_token_starts(text: str, pattern: str) -> list[int]:
    import regex

    return [m.start() for m in regex.finditer(pattern, text)]


def _cut(rows: DataFrame, chunk_chars: int, overlap: int) -> DataFrame:
    """(rid, id, k, n, chunk) of long texts; n: chunks of the text. Slicing a Python string takes constant time at any offset."""
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 16):
            for i, text in enumerate(_texts(batch.column(2))):
                n = -(-len(text) // chunk_chars)
                for some in (range(at, min(n, at + 64)) for at in range(0, n, 64)):
                    m = len(some)
                    same = pa.array([i] * m, pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(same), batch.column(1).take(same), pa.array(list(some), pa.int32()), pa.array([n] * m, pa.int32()), pa.array([text[k * chunk_chars : (k + 1) * chunk_chars + overlap] for k in some])],
                        ["rid", "id", "k", "n", "chunk"],
                    )

    tagged = rows.select(F.monotonically_increasing_id().alias("rid"), "id", "text")
    return tagged.mapInArrow(run, f"rid long, id {kind}, k int, n int, chunk string")


def sure(text: str, at: int) -> bool:
    """Whether a pre-token surely begins at ``at``, whatever stands further left or right: a space between letters."""
    return 0 < at < len(text) - 1 and text[at] == " " and text[at - 1].isalpha() and text[at + 1].isalpha()


def first_sure(text: str, at: int = 1) -> int:
    """The first such place from ``at`` on, or -1."""
    while (at := text.find(" ", at)) > 0 and not sure(text, at):
        at += 1
    return at if at > 0 else -1


def _stitches(chunks: DataFrame, pattern: str, chunk_chars: int, overlap: int) -> DataFrame:
    """(rid, k, piece, start): the piece, counted from 1, in which chunk k ends, and where that begins.

    A chunk begins a piece where it shares a boundary with one that is in step, or else at the first sure
    boundary within it; one that has neither goes to the piece before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 16):
            heads, tails, sures = [], [], []
            for k, n, chunk in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), _texts(batch.column(3))):
                base, end = k * chunk_chars, len(chunk) - (UNSURE if k + 1 < n else 0)
                # behind white space a cut would change what the pattern sees ahead of it
                starts = [s for s in pre_token_starts(chunk, pattern) if 0 < s <= end and not chunk[s - 1].isspace()]
                heads.append([base + s for s in starts if s <= overlap - UNSURE] if k else [])
                tails.append([base + s for s in starts if s > chunk_chars])
                at = first_sure(chunk) if k else 0
                sures.append(base + at if 0 <= at < chunk_chars else None)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(heads, longs), pa.array(tails, longs), pa.array(sures, pa.int64())], ["rid", "k", "head", "tail", "sure"])

    seen = chunks.select("rid", "k", "n", "chunk").mapInArrow(run, "rid long, k int, head array<long>, tail array<long>, sure long")
    by = Window.partitionBy("rid").orderBy("k")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    met = seen.withColumn("met", F.array_min(F.array_intersect(F.lag("tail").over(by), "head"))).drop("head", "tail")
    # in step: since the last chunk with a sure boundary, every chunk has met the one before
    met = met.withColumn("since", F.count("sure").over(so_far))
    met = met.withColumn("step", F.min((F.col("met").isNotNull() | F.col("sure").isNotNull()).cast("int")).over(Window.partitionBy("rid", "since").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)) == 1)
    start = F.when(F.col("k") == 0, F.lit(0).cast("long")).otherwise(F.coalesce(F.when(F.lag("step").over(by), F.col("met")), "sure"))
    starts = met.withColumn("start", start)
    begun = F.last("start", ignorenulls=True).over(so_far)
    return starts.select("rid", "k", F.count("start").over(so_far).alias("piece"), begun.alias("start"))


def _digest(ids: list[int], data: bytes) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(data).hexdigest()


def _parts(docs: DataFrame, pattern: str, id_col: str, text_col: str, chunk_chars: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    """(id, text) of texts that fit a chunk, and (rid, id, piece, k, text) of the chunks' shares of longer ones' pieces."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    n = F.coalesce(F.length("text"), F.lit(0))
    chunks = staged(_cut(rows.filter(n > chunk_chars), chunk_chars, overlap), "chunks")
    stitched = chunks.join(staged(_stitches(chunks, pattern, chunk_chars, overlap), "stitches"), ["rid", "k"])
    kind = dict(rows.dtypes)["id"]

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What a chunk gives to the piece before, if that ends in it, and to its own."""
        for batch in small_batches(batches, 16):
            at, piece, texts = [], [], []
            for i, (k, p, start, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), _texts(batch.column(5)))):
                begin = max(start - k * chunk_chars, 0)
                at += [i, i]
                piece += [p - 1, p]
                texts += [text[:begin], text[begin:chunk_chars]]
            taken = batch.take(pa.array(at, pa.int32()))
            yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), pa.array(piece, pa.int64()), taken.column(2), pa.array(texts, pa.string())], ["rid", "id", "piece", "k", "text"])

    shares = stitched.select("rid", "id", "k", "piece", "start", "chunk").mapInArrow(share, f"rid long, id {kind}, piece long, k int, text string")
    return rows.filter(n <= chunk_chars), shares.filter("text <> ''").repartition("rid", "piece").sortWithinPartitions("rid", "piece", "k")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array, int, str]]:
    """(rid, id, piece, text) of each piece, its shares put together: one piece in memory at a time."""
    at, doc, held = None, None, []
    for batch in small_batches(batches, 16):
        for i, (rid, piece, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), _texts(batch.column(4)))):
            if (rid, piece) != at:
                if held:
                    yield at[0], doc, at[1], "".join(held)
                at, doc, held = (rid, piece), batch.column(1).slice(i, 1), []
            held.append(text)
    if held:
        yield at[0], doc, at[1], "".join(held)


def encode_parts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP) -> tuple[DataFrame, DataFrame]:
    """(id, ids) of texts that fit a chunk, and (rid, id, k, ids) of the pieces of longer ones.

    ``rid`` tells rows apart even where ids repeat. Null texts are empty and have no tokens. A run longer than
    the overlap is encoded with the text up to the next boundary, however far that is."""
    texts, shares = _parts(docs, pattern, id_col, text_col, chunk_chars, overlap)
    kind = dict(texts.dtypes)["id"]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path, pattern).encode_ordinary
        for batch in small_batches(batches, 128):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encode(t) for t in _texts(batch.column(1))], pa.list_(pa.int32()))], ["id", "ids"])

    def piece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path, pattern).encode_ordinary
        for rid, doc, k, text in _pieces(batches):
            yield pa.RecordBatch.from_arrays([pa.array([rid], pa.int64()), doc, pa.array([k], pa.int64()), pa.array([encode(text)], pa.list_(pa.int32()))], ["rid", "id", "k", "ids"])

    return texts.mapInArrow(whole, f"id {kind}, ids array<int>"), shares.mapInArrow(piece, f"rid long, id {kind}, k long, ids array<int>")


def encode(docs: DataFrame, path: str, pattern: str, **how) -> DataFrame:
    """(id, ids) of every row, the pieces of long texts joined in order."""
    short, pieces = encode_parts(docs, path, pattern, **how)
    joined = pieces.groupBy("rid", "id").agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("p")).select("id", F.flatten("p.ids").alias("ids"))
    return short.unionByName(joined)


def decode(encoded: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """The rows with ``decoded`` (binary) in place of the ids: the tokens' bytes, concatenated. Null ids decode to nothing."""
    others = [c for c in encoded.columns if c != ids_col]
    kinds = dict(encoded.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _token_bytes(path, pattern)
        for batch in small_batches(batches, 128):
            ids = batch.column(len(others))
            flat, ends = ids.flatten().to_pylist(), 0
            out = []
            for n in ids.value_lengths().fill_null(0).to_pylist():
                out.append(b"".join(map(table.__getitem__, flat[ends : ends + n])))
                ends += n
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(others))), pa.array(out, pa.binary())], [*others, "decoded"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in others), "decoded binary"])
    return encoded.select(*others, ids_col).mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row: encoded, and decoded again from the ids.

    Ids and bytes of a short text stay in the task that makes them. The pieces of a long text go on as
    (joined ids, decoded bytes) and are hashed in order, one piece in memory at a time."""
    texts, shares = _parts(docs, pattern, id_col, text_col, chunk_chars, overlap)
    kind = dict(texts.dtypes)["id"]
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, table = tokenizer(path, pattern), _token_bytes(path, pattern)
        for batch in small_batches(batches, 128):
            found = []
            for text in _texts(batch.column(1)):
                ids = enc.encode_ordinary(text)
                found.append(_digest(ids, b"".join(map(table.__getitem__, ids))))
            n, a, b = zip(*found)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names)

    def piece(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, table = tokenizer(path, pattern), _token_bytes(path, pattern)
        for rid, doc, k, text in _pieces(batches):
            ids = enc.encode_ordinary(text)
            values = [[rid], [k], [len(ids)], [",".join(map(str, ids)).encode()], [b"".join(map(table.__getitem__, ids))]]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            rid, k, m, joined, data = (pa.array(v, t) for v, t in zip(values, types))
            yield pa.RecordBatch.from_arrays([rid, doc, k, m, joined, data], ["rid", "id", "k", "m", "joined", "decoded"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, head = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([head, pa.array([n], pa.int64()), pa.array([a.hexdigest()]), pa.array([b.hexdigest()])], names)

        for batch in small_batches(batches, 16):
            for i, (rid, m, joined, data) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), as_bytes(batch.column(3)), as_bytes(batch.column(4)))):
                if rid != at:
                    if head is not None:
                        yield out()
                    at, head, n, a, b = rid, batch.column(1).slice(i, 1), 0, hashlib.sha256(), hashlib.sha256()
                if m:
                    a.update(b"," * bool(n) + joined)
                n += m
                b.update(data)
        if head is not None:
            yield out()

    parts = shares.mapInArrow(piece, f"rid long, id {kind}, k long, m long, joined binary, decoded binary")
    parts = parts.repartition("rid").sortWithinPartitions("rid", "k").select("rid", "id", "m", "joined", "decoded")
    return texts.mapInArrow(whole, schema).unionByName(parts.mapInArrow(together, schema))
