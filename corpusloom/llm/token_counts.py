"""Edit-aware token counts: a segment tree of pre-token runs per document, re-encoded only where edits touch.

A document is cut into leaves at places where a pre-token begins, in any script: near the end of a leaf a
space between letters, where one surely does, or else the next boundary that the pattern finds from the leaf's
start. No leaf ends in white space, which is all that the pattern looks ahead over, so that leaves are encoded apart and their
counts summed up a binary tree. Edits change the texts of leaves and mark them. Then each run of marked leaves
is pre-tokenised from a boundary that no edit reaches until a boundary coincides with that of a later leaf; what lies
between is encoded once, cut anew, and the sums on the paths to the root are updated, or, where leaves
were added, the sums of the tree. Only a single pre-token, or a run of white space, can make a leaf long.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import UNSURE, _texts, sure, tokenizer
from .common import small_batches, staged

#: Characters of a leaf, at least; characters behind them in which a space between letters is looked for first.
LEAF, SURE_WITHIN = 768, 64
#: Documents, and numbers in their trees, that are sent on at once.
SEND_ROWS, SEND_NUMBERS = 256, 1 << 17
#: Documents of one id that a task recounts, about, where the ids are counted beforehand.
COPIES = 1_024


@cache
def _pattern(pattern: str):
    import regex

    return regex.compile(pattern)


def _cuts(text: str, boundaries: Callable[[int], Iterator[int]], leaf: int) -> list[int]:
    """Where leaves begin, and the text's end. ``boundaries`` gives those behind a known one in order."""
    cuts = [0]
    while (at := cuts[-1] + leaf) < len(text):
        found = text.find(" ", at, at + SURE_WITHIN)
        while found > 0 and not sure(text, found):
            found = text.find(" ", found + 1, at + SURE_WITHIN)
        if found < 0:
            found = next((s for s in boundaries(cuts[-1]) if s >= at and not text[s - 1].isspace()), -1)
        if found < 0:
            break
        cuts.append(found)
    return [*cuts, len(text)]


def leaf_sizes(text: str, pattern: str, leaf: int = LEAF) -> list[int]:
    """Lengths of the leaves of a text."""
    finditer = _pattern(pattern).finditer
    cuts = _cuts(text, lambda at: (m.start() for m in finditer(text, at)), leaf)
    return [b - a for a, b in zip(cuts, cuts[1:])]


def _tree(values: list[int]) -> list[int]:
    """Sums of a complete binary tree over the leaves: the root at 1, the children of i at 2i and 2i+1."""
    n = 1
    while n < len(values):
        n *= 2
    out = [0] * n + values + [0] * (n - len(values))
    for i in range(n - 1, 0, -1):
        out[i] = out[2 * i] + out[2 * i + 1]
    return out


def _put(tree: list[int], leaf: int, value: int) -> None:
    i = len(tree) // 2 + leaf
    change = value - tree[i]
    while i:
        tree[i] += change
        i //= 2


def _leaf_at(chars: list[int], at: int) -> tuple[int, int]:
    """The leaf that holds character ``at`` (the last non-empty one at the end of the text) and its first character."""
    at, start, i = min(at, chars[1] - 1), 0, 1
    while i < len(chars) // 2:
        i *= 2
        if at >= chars[i]:
            at -= chars[i]
            start += chars[i]
            i += 1
    return i - len(chars) // 2, start


class Counted:
    """A document's leaves and trees of characters and tokens. ``encoded`` counts the characters encoded for edits."""

    def __init__(self, text: str, chars: list[int], tokens: list[int], leaf: int = LEAF):
        self.chars, self.tokens, self.leaf, self.encoded = chars, tokens, leaf, 0
        self.texts, at = [], 0
        for n in chars[len(chars) // 2 :]:
            self.texts.append(text[at : at + n])
            at += n
        #: 1 for leaves that an edit has changed, 2 where it is so near the first character that it may move the boundary there.
        self.marks = bytearray(len(self.texts))

    def edit(self, at: int, removed: int, added: str) -> None:
        """Change the text; token counts are right again after ``settle``."""
        n = self.chars[1]
        at = min(max(at, 0), n)
        end = min(at + max(removed, 0), n)
        if at == end and not added:
            return
        first, start = _leaf_at(self.chars, at) if n else (0, 0)
        last, begin = _leaf_at(self.chars, end - 1) if end > at else (first, start)
        mark = 2 if at - start < UNSURE else 1
        part = self.texts[first][: at - start] + added + self.texts[last][end - begin if end > at else at - start :]
        mark = max(mark, *self.marks[first : last + 1]) if part else 2
        pieces = [part[k : k + self.leaf] for k in range(0, len(part), self.leaf)] if len(part) > 2 * self.leaf else [part]
        self._lay(first, last, pieces, [0] * len(pieces), bytes([mark] + [2] * (len(pieces) - 1)))

    def settle(self, pattern: str, count: Callable[[str], int]) -> None:
        """Encode what edits have touched."""
        done, regions = -1, []
        marked = [i for i, mark in enumerate(self.marks) if mark]
        for i in marked:
            if i <= done:
                continue
            first, known = i, 0
            if self.marks[i] == 2:
                while first > done + 1 and known < UNSURE:
                    first -= 1
                    known += len(self.texts[first])
            part, last, starts = self._resynchronise(first, i, pattern)
            cuts = _cuts(part, lambda s, starts=starts: (x for x in starts[bisect_left(starts, s) :]), self.leaf) if len(part) > 2 * self.leaf else [0, len(part)]
            regions.append((first, last, [part[a:b] for a, b in zip(cuts, cuts[1:])]))
            self.encoded += len(part)
            done = last
        for first, last, pieces in reversed(regions):  # places further left stay what they are
            self._lay(first, last, pieces, [count(x) if x else 0 for x in pieces], bytes(len(pieces)))

    def _resynchronise(self, first: int, last: int, pattern: str) -> tuple[str, int, list[int]]:
        """The text from leaf ``first`` to where a boundary of the new text is the beginning of a leaf behind ``last``, that text's last leaf and boundaries."""
        finditer, leaves = _pattern(pattern).finditer, len(self.texts)
        part, starts, at = "".join(self.texts[first : last + 1]), [], 0
        while True:
            ahead, k = "", last + 1
            while k < leaves and len(ahead) < UNSURE:
                ahead += self.texts[k]
                k += 1
            met, length = not ahead or not part, len(part)
            window = part + ahead
            for m in finditer(window, at):
                s = m.start()
                if s >= length:
                    met = met or s == length and not part[-1].isspace()
                    break
                if not s or not window[s - 1].isspace():  # what begins in white space may hang on more of it
                    if not starts or s > starts[-1]:
                        starts.append(s)
                    at = s
            if met:
                return part, last, starts
            last += 1
            while not self.texts[last]:
                last += 1
            part += self.texts[last]

    def _lay(self, first: int, last: int, new: list[str], counts: list[int], marks: bytes) -> None:
        """Put leaves in the place of leaves first to last."""
        sizes, room = [len(x) for x in new], last - first + 1
        if len(new) <= room:
            spare = [0] * (room - len(new))
            self.texts[first : last + 1] = new + [""] * len(spare)
            self.marks[first : last + 1] = marks + bytes(len(spare))
            for k, (n, m) in enumerate(zip(sizes + spare, counts + spare)):
                _put(self.chars, first + k, n)
                _put(self.tokens, first + k, m)
            return
        old = self.tokens[len(self.tokens) // 2 :]
        after = zip(self.texts[last + 1 :], old[last + 1 :], self.marks[last + 1 :])
        # empty leaves on the left stay: places there are still to be used
        rows = [*zip(self.texts[:first], old[:first], self.marks[:first]), *zip(new, counts, marks), *(r for r in after if r[0] or r[2])]
        self.chars, self.tokens = _tree([len(x) for x, _, _ in rows]), _tree([m for _, m, _ in rows])
        spare = len(self.chars) // 2 - len(rows)
        self.texts = [x for x, _, _ in rows] + [""] * spare
        self.marks = bytearray([m for _, _, m in rows] + [0] * spare)


def build(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF) -> DataFrame:
    """(id, text, chars, tokens): each document with its trees; tokens[1] is its count. Null texts are empty."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path, pattern).encode_ordinary
        for batch in small_batches(batches, 128):
            texts, chars, tokens = list(_texts(batch.column(1))), [], []
            for text in texts:
                sizes, at, counts = leaf_sizes(text, pattern, leaf), 0, []
                for n in sizes:
                    counts.append(len(encode(text[at : at + n])))
                    at += n
                chars.append(_tree(sizes))
                tokens.append(_tree(counts))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(chars, longs), pa.array(tokens, longs)], ["id", "text", "chars", "tokens"])

    return rows.mapInArrow(run, f"id {kind}, text string, chars array<long>, tokens array<long>")


def recount(built: DataFrame, edits: DataFrame, path: str, pattern: str, leaf: int = LEAF, ids: DataFrame | None = None) -> DataFrame:
    """(id, tokens_before, tokens_after, chars_after, chars_encoded, chars, tokens) of every document after its edits.

    ``edits`` has (id, seq, at, removed, added): at character ``at`` (kept within the text), ``removed``
    characters go and ``added`` comes. They apply in order of seq (then of the other columns); null numbers
    count as 0 and a null ``added`` as empty. Edits of unknown documents and of a null id are ignored, so a
    document without id keeps its text; such documents are dealt out evenly, however many they are.
    Documents of one id all get its edits. A task holds the edits of one id and streams its documents, however
    many, one at a time; with ``ids`` (the documents' id column, counted beforehand) those of an id that more than
    ``COPIES`` have are dealt out to several tasks, each of which gets the edits. ``built`` is best what ``build``
    makes of stored documents: rows that a shuffle puts in another order when it runs again would be dealt anew.
    ``chars_encoded`` counts what all edits together make it encode, a place that several touch once."""
    kind = dict(built.dtypes)["id"]
    longs = "array<long>"
    zero = F.lit(0).cast("long")
    number = lambda c: F.coalesce(F.col(c).cast("long"), zero).alias(c)
    steps = edits.filter("id is not null").select(F.col("id").cast(kind), F.lit(0).alias("step"), number("seq"), number("at"), number("removed"), F.coalesce("added", F.lit("")).alias("text"), F.lit(None).cast(longs).alias("chars"), F.lit(None).cast(longs).alias("tokens"), zero.alias("deal"))
    if ids is not None:
        often = ids.select(F.col(ids.columns[0]).cast(kind).alias("id")).groupBy("id").agg(F.ceil(F.count("*") / COPIES).alias("parts"))
        often = staged(often.filter("id is not null and parts > 1"), "often")
        steps = steps.join(often, "id", "left").withColumn("deal", F.explode(F.expr("sequence(0L, coalesce(parts, 1) - 1)"))).drop("parts")
        # numbered before the join, whose rows come in another order when a task runs again
        built = built.withColumn("row", F.monotonically_increasing_id()).join(often, "id", "left")
    else:
        built = built.withColumn("row", F.monotonically_increasing_id()).withColumn("parts", F.lit(1).cast("long"))
    deal = F.when(F.col("id").isNull(), F.col("row")).otherwise(F.pmod("row", F.coalesce("parts", F.lit(1).cast("long"))))
    texts = built.select("id", F.lit(1).alias("step"), zero.alias("seq"), zero.alias("at"), zero.alias("removed"), "text", "chars", "tokens", deal.alias("deal"))
    both = steps.unionByName(texts).repartition("id", "deal").sortWithinPartitions("id", "deal", "step", "seq", "at", "removed", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path, pattern).encode_ordinary
        count = lambda s: len(encode(s))
        held: list[tuple[int, int, str]] = []
        done: list[tuple] = []
        at, numbers = None, 0

        def sent(id_type: pa.DataType) -> pa.RecordBatch:
            types = [id_type, *[pa.int64()] * 4, *[pa.list_(pa.int64())] * 2]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done), types)], ["id", "tokens_before", "tokens_after", "chars_after", "chars_encoded", "chars", "tokens"])

        for batch in small_batches(batches, 128):
            ids, kinds, ats, cuts, deals = (batch.column(k).to_pylist() for k in (0, 1, 3, 4, 8))
            id_type = batch.schema.field(0).type
            for i, key in enumerate(ids):
                if (key, deals[i]) != at:
                    held, at = [], (key, deals[i])
                text = batch.column(5)[i].as_py()
                if kinds[i] == 0:
                    held.append((ats[i], cuts[i], text))
                    continue
                chars, tokens = (batch.column(k)[i].as_py() for k in (6, 7))
                doc, before = Counted(text, chars, tokens, leaf), tokens[1]
                for edit in held:
                    doc.edit(*edit)
                doc.settle(pattern, count)
                done.append((key, before, doc.tokens[1], doc.chars[1], doc.encoded, doc.chars, doc.tokens))
                numbers += 2 * len(doc.chars)
                if len(done) >= SEND_ROWS or numbers >= SEND_NUMBERS:
                    yield sent(id_type)
                    done, numbers = [], 0
        if done:
            yield sent(id_type)

    return both.mapInArrow(run, f"id {kind}, tokens_before long, tokens_after long, chars_after long, chars_encoded long, chars {longs}, tokens {longs}")
