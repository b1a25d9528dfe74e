"""Conversation structure repair: the cheapest edits that give s?(ua)+, by dynamic programming over a shared trie.

A conversation's rows in order are a signature, one symbol a row: the role's initial and the row's first fault.
Sorted signatures are walked as the paths of a prefix trie: what a signature shares with the one before is on
the stack already, so that a shared prefix's layers are worked out once. A layer has, for each role that the
output may end in, the least cost and the place of its edits among the others' in ASCII order; less its
smallest cost it is one of few, and what a symbol makes of it is remembered. Answers are read off at terminals.

A conversation may be of any length: rows get places by range partitions and running sums, symbols meet in
blocks of at most ``BLOCK`` rows, and so does the text that is laid out again; only the string of edits of a
conversation, which is its result, and its hash state are ever whole in a task.

Null roles and texts are one space; null ids are a conversation, null turns come first. Rows of one turn are
ordered by role and the SHA-256 of their text; equal rows are folded and counted. A role that isn't
written s..., u... or a... (also an empty one) can't be kept. A table without rows has no result.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.packing import running_total
from .common import staged

#: Rows of a conversation that a task lays out, about.
BLOCK = 4_096
#: Bytes of text that go on at once where a conversation has several blocks.
PIECE_BYTES = 1 << 18
ROLES = ("s", "u", "a", "o")
FAULTS = ("none", "blank", "duplicate", "truncated")
#: A symbol is the letter at 4 * role + fault.
SYMBOLS = "abcdefghijklmnop"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Fixed by the output's form s?(ua)+: states are nothing yet, s, u and a; which state an inserted or re-roled row leads to, and a kept one.
NEXT = (2, 2, 3, 2)
KEPT = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}
LEGAL = {(0, 1), (1, 2), (2, 1)}
ROLE_NAMES = {2: "user", 3: "assistant"}

Layer = tuple  # of (state, cost, rank), cost 0 at least once


def damaged(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, role, text, n) after the damage that a row's id and turn ask for; n: how often it is there now."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(space(id_col), F.lit(":"), space(turn_col)).cast("binary")) % 20
    role, text = space(role_col), space(text_col)
    text = F.when(hit == 1, "").when(hit == 2, F.translate(text, ".!?", "")).otherwise(text)
    return rows.filter(hit != 0).select(F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), F.when(hit == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.when(hit == 3, 2).otherwise(1).cast("long").alias("n"))


def _key() -> Column:
    """One text for each different (conv, turn, role, digest), nulls told apart."""
    return F.sha2(F.to_json(F.struct("conv", "turn", "role", "digest")), 256)


def _initial(role: Column) -> Column:
    """Place of a role's initial in ROLES."""
    first = F.substring(role, 1, 1)
    return F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)


def _symbols(rows: DataFrame) -> DataFrame:
    """Slim rows (conv, turn, role, digest, n, symbols): the signature's letters of a row and its copies."""
    last = F.substring(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), -1, 1)
    fault = F.when(last == "", 1).when(last.isin(".", "!", "?"), 0).otherwise(3).alias("fault")
    slim = rows.select("conv", "turn", "role", "digest", fault, "n").groupBy("conv", "turn", "role", "digest", "fault").agg(F.sum("n").alias("n"))
    slim = staged(slim, "slim")
    first = F.min(F.struct(F.col("turn").isNotNull().alias("some"), "turn")).alias("first")
    firsts = staged(slim.filter("fault <> 1").groupBy("conv", "role", "digest").agg(first), "firsts")
    same = slim["conv"].eqNullSafe(firsts["conv"]) & (slim["role"] == firsts["role"]) & (slim["digest"] == firsts["digest"])
    both = slim.join(firsts, same, "left").select(slim["*"], F.coalesce(F.col("first.turn").eqNullSafe(F.col("turn")), F.lit(False)).alias("is_first"))
    letter = lambda fault: F.substring(F.lit(SYMBOLS), _initial(F.col("role")) * 4 + fault + 1, F.lit(1))
    again = F.col("n").cast("int")
    own = F.when(F.col("fault") == 1, F.repeat(letter(F.lit(1)), again)).when(F.col("is_first"), F.concat(letter(F.col("fault")), F.repeat(letter(F.lit(2)), again - 1))).otherwise(F.repeat(letter(F.lit(2)), again))
    return both.select("conv", "turn", "role", "digest", "n", own.alias("symbols"))


class Trie:
    """Layers along the current path of a prefix trie, and counts of faults and of illegal neighbours."""

    def __init__(self) -> None:
        self.layers: list[Layer] = [((0, 0, 0),)]
        self.known = {self.layers[0]: 0}
        self.steps: dict[tuple[int, int], tuple[int, int, dict[int, tuple[int, str]]]] = {}
        self.path, self.computed = "", 0
        self.at, self.cost, self.illegal = array("q", [0]), array("q", [0]), array("q", [0])
        self.counts = [array("q", [0]) for _ in FAULTS]

    def _layer(self, before: Layer, symbol: int) -> tuple[Layer, int, dict[int, tuple[int, str]]]:
        """The layer behind a row, its least cost, and for each state the one it comes from with the edits in between."""
        role, fault = divmod(symbol, 4)
        more = TRUNCATED if fault == 3 else 0
        best: dict[int, tuple[int, int, str, int]] = {}
        for start, cost, rank in before:
            state, edits = start, ""
            for _ in range(3):  # a third insert leads nowhere that a first doesn't
                ways = [("D", state, DELETE)]
                if fault not in (1, 2):
                    ways += [("R", NEXT[state], REROLE + more)]
                    if (state, role) in KEPT:
                        ways += [("K", KEPT[state, role], KEEP + more)]
                for edit, to, price in ways:
                    found = (cost + price, rank, edits + edit, start)
                    best[to] = min(best.get(to, found), found)
                state, edits, cost = NEXT[state], edits + "I", cost + INSERT
        least = min(c for c, *_ in best.values())
        order = sorted(best, key=lambda s: best[s][1:3])
        layer = tuple((s, best[s][0] - least, order.index(s)) for s in sorted(best))
        return layer, least, {s: (best[s][3], best[s][2]) for s in best}

    def go(self, signature: str) -> None:
        """Move to a signature's end; layers that the path so far shares with it stay."""
        shared = 0
        for a, b in zip(self.path, signature):
            if a != b:
                break
            shared += 1
        for values in (self.at, self.cost, self.illegal, *self.counts):
            del values[shared + 1 :]
        for i in range(shared, len(signature)):
            symbol = SYMBOLS.index(signature[i])
            key = (self.at[i], symbol)
            if key not in self.steps:
                layer, least, back = self._layer(self.layers[key[0]], symbol)
                if layer not in self.known:
                    self.known[layer] = len(self.layers)
                    self.layers.append(layer)
                self.steps[key] = (self.known[layer], least, back)
            to, least, _ = self.steps[key]
            self.at.append(to)
            self.cost.append(self.cost[i] + least)
            legal = not i or (SYMBOLS.index(signature[i - 1]) // 4, symbol // 4) in LEGAL
            self.illegal.append(self.illegal[i] + (not legal))
            for fault, values in enumerate(self.counts):
                values.append(values[i] + (symbol % 4 == fault))
        self.computed += len(signature) - shared
        self.path = signature

    def answer(self) -> tuple[int, int, int, int, int, str]:
        """blank, duplicate, truncated, illegal, cost and edits of the path."""
        ends = []
        for start, cost, rank in self.layers[self.at[-1]]:
            state, edits = start, ""
            for _ in range(3):
                if state in (0, 3):
                    ends.append((cost, rank, edits, start))
                state, edits, cost = NEXT[state], edits + "I", cost + INSERT
        cost, _, edits, state = min(ends)
        out = [edits]
        for i in range(len(self.path) - 1, -1, -1):
            state, edits = self.steps[self.at[i], SYMBOLS.index(self.path[i])][2][state]
            out.append(edits)
        blank, duplicate, truncated = (self.counts[k][-1] for k in (1, 2, 3))
        return blank, duplicate, truncated, self.illegal[-1], self.cost[-1] + cost, "".join(reversed(out))


ANSWER = "signature string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def repairs(signatures: DataFrame) -> DataFrame:
    """The answer to each different signature: sorted ranges of them are walked as tries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        for batch in batches:
            found = []
            for signature in batch.column(0).to_pylist():
                trie.go(signature)
                found.append((signature, *trie.answer()))
            kinds = [pa.string(), *[pa.int64()] * 5, pa.string()]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*found), kinds)], [c.split()[0] for c in ANSWER.split(", ")])

    different = staged(signatures.select("signature").distinct(), "different")
    return different.repartitionByRange("signature").sortWithinPartitions("signature").mapInArrow(run, ANSWER)


def _edits_of_blocks(answered: DataFrame) -> DataFrame:
    """(conv, block, blocks, edits, state): the edits of each block's rows, and the state that the output has before them."""
    kind = dict(answered.dtypes)["conv"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (audit, signature, blocks, sizes) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3, 4)))):
                out, state, at, row = [], 0, 0, 0
                for k, size in enumerate(sizes):
                    begin, before = at, state
                    end = row + size
                    while at < len(audit) and (row < end or k + 1 == len(sizes)):
                        edit = audit[at]
                        if edit == "K":
                            state = KEPT[state, SYMBOLS.index(signature[row]) // 4]
                        elif edit != "D":
                            state = NEXT[state]
                        row += edit != "I"
                        at += 1
                    out.append((audit[begin:at], before))
                edits, states = zip(*out)
                same = batch.column(0).take(pa.array([i] * len(out), pa.int32()))
                yield pa.RecordBatch.from_arrays([same, pa.array(blocks, pa.int64()), pa.array([len(out)] * len(out), pa.int64()), pa.array(edits, pa.string()), pa.array(states, pa.int64())], ["conv", "block", "blocks", "edits", "state"])

    return answered.select("conv", "audit", "signature", "blocks", "sizes").mapInArrow(run, f"conv {kind}, block long, blocks long, edits string, state long")


def _laid_out(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv, block, k, sha256, piece): a conversation's hash where it has one block, else its text in pieces."""
    kind = dict(rows.dtypes)["conv"]
    none = lambda t: F.lit(None).cast(t)
    first = edits.select("conv", "block", F.lit(0).alias("row"), none("long").alias("start"), "blocks", "edits", "state", none("string").alias("role"), none("string").alias("text"), F.lit(0).cast("long").alias("n"))
    rest = rows.select("conv", "block", F.lit(1).alias("row"), "start", none("long").alias("blocks"), none("string").alias("edits"), none("long").alias("state"), "role", "text", "n")
    dealt = first.unionByName(rest).repartition("conv", "block").sortWithinPartitions("conv", "block", "row", "start")
    names = ["conv", "block", "k", "sha256", "piece"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv = None

        def out(sha: str | None, piece: bytes | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([conv, pa.array([block], pa.int64()), pa.array([k], pa.int64()), pa.array([sha], pa.string()), pa.array([piece], pa.binary())], names)

        def line(role: str, text: str) -> None:
            data = ("\n" if state else "").encode() + f"{role}:{text}".encode()
            hashed.update(data) if blocks == 1 else held.extend(data)

        def inserts() -> None:
            nonlocal at, state
            while at < len(edits) and edits[at] == "I":
                line(ROLE_NAMES[NEXT[state]], "")
                state, at = NEXT[state], at + 1

        def finish() -> Iterator[pa.RecordBatch]:
            inserts()
            if blocks == 1:
                yield out(hashed.hexdigest(), None)
            elif held:
                yield out(None, bytes(held))

        for batch in batches:
            for i, (is_row, of, letters, begin, role, text, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 4, 5, 6, 7, 8, 9)))):
                if not is_row:
                    if conv is not None:
                        yield from finish()
                    conv, block, blocks, edits, state = batch.column(0).slice(i, 1), batch.column(1)[i].as_py(), of, letters, begin
                    at, k, hashed, held = 0, 0, hashlib.sha256(), bytearray()
                    continue
                for _ in range(n):
                    inserts()
                    edit, at = edits[at], at + 1
                    if edit == "D":
                        continue
                    to = NEXT[state] if edit == "R" else KEPT[state, ROLES.index(role[:1])]
                    line(ROLE_NAMES[to] if edit == "R" else role, text)
                    state = to
                    if len(held) >= PIECE_BYTES:
                        yield out(None, bytes(held))
                        k += 1
                        held.clear()
        if conv is not None:
            yield from finish()

    return dealt.mapInArrow(run, f"conv {kind}, block long, k long, sha256 string, piece binary")


def _hashed(pieces: DataFrame) -> DataFrame:
    """(conv, sha256) of each conversation's pieces in order, one in memory at a time."""
    kind = dict(pieces.dtypes)["conv"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None
        for batch in batches:
            for i, piece in enumerate(batch.column(1)):
                own = batch.column(0).slice(i, 1)
                if conv is None or own != conv:
                    if conv is not None:
                        yield pa.RecordBatch.from_arrays([conv, pa.array([state.hexdigest()])], ["conv", "sha256"])
                    conv, state = own, hashlib.sha256()
                state.update(piece.as_py())
        if conv is not None:
            yield pa.RecordBatch.from_arrays([conv, pa.array([state.hexdigest()])], ["conv", "sha256"])

    return pieces.repartition("conv").sortWithinPartitions("conv", "block", "k").select("conv", "piece").mapInArrow(run, f"conv {kind}, sha256 string")


def repair(rows: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Answers and texts of rows (conv, turn, role, text, n), which are read twice: for all but their texts, then for these.

    The first table has a row for each conversation: (conv, gaps, blank, duplicate, truncated, illegal, cost, audit). The
    second has the SHA-256 of what the edits give: (conv, sha256), of ``role:text`` lines."""
    rows = rows.withColumn("digest", F.sha2("text", 256))
    laid = running_total(_symbols(rows), ["conv", "turn", "role", "digest"], "n")
    laid = staged(laid.select("conv", "turn", "role", "digest", "n", "symbols", "start"), "laid")
    begins = staged(laid.groupBy("conv").agg(F.min("start").alias("begin")), "begins").withColumnRenamed("conv", "of")
    placed = laid.join(begins, F.col("conv").eqNullSafe(F.col("of"))).withColumn("block", F.floor((F.col("start") - F.col("begin")) / block))
    placed = staged(placed.drop("of", "begin"), "placed")
    by_turn = placed.groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    pieces = placed.groupBy("conv", "block").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "symbols"))), lambda x: x["symbols"]), "").alias("piece"))
    whole = F.sort_array(F.collect_list(F.struct("block", "piece"))).alias("p")
    signed = pieces.groupBy("conv").agg(whole).select("conv", F.array_join(F.col("p.piece"), "").alias("signature"), F.col("p.block").alias("blocks"), F.transform("p", lambda x: F.length(x["piece"])).alias("sizes"))
    signed = staged(signed, "signatures")
    answered = staged(signed.join(staged(repairs(signed), "repairs"), "signature"), "answers")
    gaps = by_turn.withColumnRenamed("conv", "of")
    answers = answered.join(gaps, F.col("conv").eqNullSafe(F.col("of"))).select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    # equal rows meet once, by a key that the join's side is dealt by already
    once = rows.select(_key().alias("k"), "role", "text").dropDuplicates(["k"])
    own = placed.select(_key().alias("k"), "conv", "block", "start", "n")
    texts = _laid_out(once.join(own, "k").select("conv", "block", "start", "role", "text", "n"), _edits_of_blocks(answered))
    texts = staged(texts, "texts")
    hashes = texts.filter("sha256 is not null").select("conv", "sha256").unionByName(_hashed(texts.filter("piece is not null")))
    return answers, hashes


def report(table: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation, damaged and repaired."""
    answers, hashes = repair(damaged(table, id_col, turn_col, role_col, text_col), block)
    ids = table.select(F.col(id_col).alias("id")).distinct()
    answers, hashes = answers.withColumnRenamed("conv", "a"), hashes.withColumnRenamed("conv", "h")
    all_ = ids.join(answers, F.col("id").eqNullSafe(F.col("a")), "left").join(hashes, F.col("id").eqNullSafe(F.col("h")), "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return all_.select("id", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
