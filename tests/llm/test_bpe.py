import hashlib
import random

import pytest

from corpusloom.llm import bpe, token_counts
from corpusloom.llm.queries import vocabulary

PATH, PATTERN = vocabulary()


def texts():
    rng = random.Random(4)
    parts = ["word", " the", "'s", "'ll", "  ", "\n\n", "\t", "é", " 日本語", "12345", "!?", "...", "😀", " ", " A", "don't", "<|endoftext|>"]
    rows = [None, "", " ", "x", "<|endoftext|>", "a" * 900, " " * 900, "don't " * 300, "日本語" * 300, "a" * 200 + " b" * 300, "\n" * 50 + "end" + "'" * 70]
    return rows + ["".join(rng.choices(parts, k=rng.randint(1, 400))) for _ in range(60)]


@pytest.mark.parametrize("chunk, overlap", [(1 << 15, 1024), (64, 16), (100, 40), (33, 33)])
def test_like_the_library(spark, docs_of, chunk, overlap):
    rows = [(d, t) for d, t in enumerate(texts())] + [(3, "x"), (5, "a" * 900), (None, "no id " * 40)]
    enc = bpe.tokenizer(PATH, PATTERN)
    want = []
    for d, t in rows:
        ids = enc.encode_ordinary(t or "")
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want.append(str((d, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode()))))
    got = bpe.digests(docs_of(rows), PATH, PATTERN, chunk_chars=chunk, overlap=overlap).collect()
    assert sorted(str((r["id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"])) for r in got) == sorted(want)


def test_encode_and_decode(spark, docs_of):
    rows = list(enumerate(texts()))
    encoded = bpe.encode(docs_of(rows), PATH, PATTERN, chunk_chars=50, overlap=20)
    enc = bpe.tokenizer(PATH, PATTERN)
    assert {r["id"]: r["ids"] for r in encoded.collect()} == {d: enc.encode_ordinary(t or "") for d, t in rows}
    assert {r["id"]: r["decoded"].decode() for r in bpe.decode(encoded, PATH, PATTERN).collect()} == {d: t or "" for d, t in rows}


def test_goes_on_in_pieces_behind_a_run_without_boundaries(spark, docs_of):
    """A run of letters over a border joins two chunks, no more; a text in which chunks can't agree stays one piece."""
    words = "some plain words, not many of them. " * 400
    text = words[:900] + "x" * 200 + words[: 13 * 1000 - 1100]
    parts = bpe.encode_parts(docs_of([(1, text), (2, "y" * 5000)]), PATH, PATTERN, chunk_chars=1000, overlap=64)[1]
    ids = {}
    for r in parts.orderBy("id", "k").collect():
        ids.setdefault(r["id"], []).append(r["ids"])
    assert len(ids[1]) >= 11 and len(ids[2]) == 1
    enc = bpe.tokenizer(PATH, PATTERN)
    assert [sum(x, []) for x in (ids[1], ids[2])] == [enc.encode_ordinary(text), enc.encode_ordinary("y" * 5000)]


def test_empty(spark, docs_of):
    none = docs_of([(1, "x")]).filter("doc_id < 0")
    assert bpe.digests(none, PATH, PATTERN).count() == 0 and bpe.encode(none, PATH, PATTERN).count() == 0


@pytest.mark.parametrize("leaf", [1, 20, 1024])
def test_edited_counts(spark, docs_of, leaf, monkeypatch):
    monkeypatch.setattr(token_counts, "COPIES", 2)
    rng = random.Random(leaf)
    rows = [(d, t) for d, t in enumerate(texts())] + [(3, "the same id again"), (None, "no id"), (None, "no id"), (None, "none either"), (70, "plain words only, " * 40), *((71, f"copy {k % 3} of a document") for k in range(9))]
    edits, now = [], [t or "" for _, t in rows]
    for d in [None, *range(len(rows))]:
        for seq in range(rng.randint(0, 5)):
            at, cut, add = rng.randint(-3, 500), rng.choice([0, 1, 5, 60]), rng.choice(["", " ", "x", " new words", "'s", "\n", "日"])
            edits.append((d, seq, at, cut, add if rng.random() < 0.9 else None))
            for i, (e, _) in enumerate(rows):
                if e == d and d is not None:
                    t, a = now[i], min(max(at, 0), len(now[i]))
                    now[i] = t[:a] + (edits[-1][4] or "") + t[a + cut :]
    edits.append((9999, 0, 0, 0, "nobody"))
    df = spark.createDataFrame(edits, "id long, seq long, at long, removed long, added string")
    built = token_counts.build(docs_of(rows), PATH, PATTERN, leaf=leaf)
    enc = bpe.tokenizer(PATH, PATTERN)
    got = token_counts.recount(built, df, PATH, PATTERN, leaf, docs_of(rows).select("doc_id") if leaf != 20 else None).collect()
    want = sorted(str((d, len(enc.encode_ordinary(t or "")), len(enc.encode_ordinary(n)), len(n))) for (d, t), n in zip(rows, now))
    assert sorted(str((r["id"], r["tokens_before"], r["tokens_after"], r["chars_after"])) for r in got) == want


def test_edits_encode_little(spark, docs_of):
    docs = docs_of([(1, "plain words only, " * 5000)])
    edits = spark.createDataFrame([(1, k, 900 * k, 3, " changed") for k in range(10)], "id long, seq long, at long, removed long, added string")
    r = token_counts.recount(token_counts.build(docs, PATH, PATTERN), edits, PATH, PATTERN).first()
    assert r["chars_encoded"] < 10 * 2500 and r["tokens"][1] == r["tokens_after"]


def test_many_edits_at_one_place_encode_little_each():
    """800 appends, settled one by one: each re-encodes a leaf or two, however long the document has become; also in the middle, and of long texts."""
    enc = bpe.tokenizer(PATH, PATTERN)
    count = lambda x: len(enc.encode_ordinary(x))
    for place in (lambda n: n, lambda n: n // 2):
        doc, text = token_counts.Counted("", [0, 0], [0, 0]), ""
        for k in range(800):
            added, before, at = " and some more words appended %d" % k, doc.encoded, place(len(text))
            doc.edit(at, 0, added)
            doc.settle(PATTERN, count)
            text = text[:at] + added + text[at:]
            assert doc.encoded - before <= 4096
        assert "".join(doc.texts) == text and doc.tokens[1] == count(text) and doc.chars[1] == len(text)
        assert max(map(len, doc.texts)) <= 2 * token_counts.LEAF + 40
    doc.edit(0, 0, "a long passage of words " * 1000)
    doc.settle(PATTERN, count)
    before = doc.encoded
    doc.edit(12_000, 5, "!")
    doc.settle(PATTERN, count)
    assert doc.encoded - before <= 4096 and doc.tokens[1] == count("".join(doc.texts))


def unspaced():
    rng = random.Random(9)
    pick = lambda chars, n: "".join(rng.choices(chars, k=n))
    return {
        "chinese": "".join(pick([chr(c) for c in range(0x4E00, 0x5E00)], rng.randint(5, 30)) + rng.choice("，。！") for _ in range(11_000)),
        "code": "\n".join(f"    x{k}[{k % 7}]+=f(y{k * 3},'a{k}');if(z!={k}){{++n;}}" for k in range(4_500)),
        "table": "\n".join(",".join(str(rng.randrange(10**6)) for _ in range(8)) for _ in range(4_000)),
        "base64": "\n".join(pick("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 76) for _ in range(2_700)),
    }


@pytest.mark.parametrize("kind", ["chinese", "code", "table", "base64"])
def test_texts_without_spaces_between_letters_have_leaves(kind):
    enc = bpe.tokenizer(PATH, PATTERN)
    count = lambda x: len(enc.encode_ordinary(x))
    text = unspaced()[kind]
    sizes = token_counts.leaf_sizes(text, PATTERN)
    assert sum(sizes) == len(text) > 180_000 and len(sizes) >= 100
    at, counts = 0, []
    for n in sizes:
        counts.append(count(text[at : at + n]))
        at += n
    assert sum(counts) == count(text)
    doc = token_counts.Counted(text, token_counts._tree(sizes), token_counts._tree(counts))
    rng = random.Random(1)
    for k in range(20):
        at, before = rng.randrange(len(text)), doc.encoded
        cut, add = (0, rng.choice(["q", "9", "\n", " ", "的"])) if k % 2 else (1, "")
        doc.edit(at, cut, add)
        doc.settle(PATTERN, count)
        text = text[:at] + add + text[at + cut :]
        assert doc.encoded - before <= 4096 and doc.tokens[1] == count(text)
    assert "".join(doc.texts) == text


@pytest.mark.parametrize("seed", range(12))
def test_edits_settled_together_against_counting_anew(seed):
    enc = bpe.tokenizer(PATH, PATTERN)
    count = lambda x: len(enc.encode_ordinary(x))
    rng = random.Random(seed)
    parts = ["word ", "don't", " 1234567", "\n\n", "   ", "的话", "'", "'re", "!!", "\t \n ", "ÀB", "_x", "\r\n", "a"]
    text = "".join(rng.choices(parts, k=rng.randint(0, 400)))
    leaf = rng.choice([1, 4, 16, 60])
    sizes = token_counts.leaf_sizes(text, PATTERN, leaf)
    ends = [sum(sizes[: k + 1]) for k in range(len(sizes))]
    doc = token_counts.Counted(text, token_counts._tree(sizes), token_counts._tree([count(text[b - n : b]) for n, b in zip(sizes, ends)]), leaf)
    assert doc.tokens[1] == count(text)
    for _ in range(30):
        for _ in range(rng.randint(0, 4)):
            at, cut, add = rng.randint(0, len(text) + 2), rng.choice([0, 0, 1, 3, 40]), "".join(rng.choices(parts, k=rng.choice([0, 1, 1, 2, 30])))
            doc.edit(at, cut, add)
            at = min(at, len(text))
            text = text[:at] + add + text[at + cut :]
        doc.settle(PATTERN, count)
        assert "".join(doc.texts) == text and (doc.chars[1], doc.tokens[1]) == (len(text), count(text))
        assert not any(doc.marks)
