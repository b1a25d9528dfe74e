import hashlib
import random
import re

import pytest

from corpusloom.llm import exact_dedup as op


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(lower(t), []).append(d)
    out, done = [], set()
    for d, t in rows:
        g = groups[lower(t)]
        keep = max((x for x in g if x is not None), default=None)
        kept = d == keep and lower(t) not in done
        if kept:
            done.add(lower(t))
        out.append((d, keep, len(g), kept, hashlib.sha256(lower(t).encode()).hexdigest()))
    return sorted(map(str, out))


ROWS = [(1, "Abc"), (2, "aBC"), (3, "abcé"), (4, "ABCÉ"), (5, None), (6, ""), (6, ""), (7, "x" * 1000), (8, "X" * 1000), (9, "x" * 999 + "y"), (10, "x" * 1001), (None, "null id"), (None, "NULL id"), (11, "\x00"), (12, "\x00\x00"), (13, " abc"), (14, "日本語" * 50), (15, "日本語" * 50)]


@pytest.mark.parametrize("chunk_bytes", [4, 8, 64, 1 << 22])
def test_like_brute_force(spark, docs_of, chunk_bytes):
    got = op.exact_groups(docs_of(ROWS), chunk_bytes=chunk_bytes).collect()
    assert sorted(str((r["id"], r["keep_id"], r["group_size"], r["kept"], r["sha256"])) for r in got) == brute(ROWS)


def test_chunks_compose():
    rng = random.Random(0)
    for n in (0, 1, 5, 8, 400, 70_000):
        data = bytes(rng.randrange(256) for _ in range(n))
        limbs = [int.from_bytes((data + b"\0" * 3)[i : i + 4], "little") for i in range(0, n, 4)]
        want = 0
        for w in limbs:
            want = (want * op.BASE + w) % op.P
        assert op.chunk_hash(data) == want
        for cut in (4, 16, n // 8 * 4):
            assert op.chunk_hash(data[cut:], op.chunk_hash(data[:cut])) == want


def collision():
    """Two lower-case ASCII texts of 12 bytes with one fingerprint: differences (x, y, z) with x*B^2 + y*B + z = 0 mod P, y and z brought near 0 by a short lattice basis."""
    u, v = (op.P, 0), (op.BASE, -1)  # rows (z, y) with y*B + z = 0
    while abs(v[0]) > 1 << 31:
        n = u[0] // v[0]
        u, v = v, (u[0] - n * v[0], u[1] - n * v[1])
    det = u[0] * v[1] - u[1] * v[0]
    good = [c for c in range(32, 127) if not 65 <= c <= 90]

    def limb(d):
        """Four good bytes that are four good bytes again with d added."""
        out, carry = [], 0
        for b in (d % (1 << 32)).to_bytes(4, "little"):
            some = [a for a in good if (a + b + carry) % 256 in good]
            if not some:
                return None
            out.append(some[len(some) // 2])
            carry = (out[-1] + b + carry) // 256
        x = int.from_bytes(bytes(out), "little")
        return x if 0 <= x + d < 1 << 32 else None

    rng = random.Random(1)
    for _ in range(100_000):
        x = rng.randrange(1, 1 << 30)
        z, y = -x * op.BASE**2 % op.P, 0
        i, j = round((z * v[1] - y * v[0]) / det), round((y * u[0] - z * u[1]) / det)
        d = (x, y - i * u[1] - j * v[1], z - i * u[0] - j * v[0])
        first = [limb(k) for k in d] if all(abs(k) < 1 << 32 for k in d) else [None]
        if None not in first:
            return tuple(b"".join(w.to_bytes(4, "little") for w in words) for words in (first, [a + k for a, k in zip(first, d)]))
    raise AssertionError("none found")


def test_colliding_fingerprints_are_told_apart(spark, docs_of):
    s, t = collision()
    assert s != t and op.chunk_hash(s) == op.chunk_hash(t)
    rows = [(1, s.decode()), (2, t.decode()), (3, s.decode().upper()), (4, t.decode()), (5, "plain")]
    got = op.exact_groups(docs_of(rows)).collect()
    assert sorted(str((r["id"], r["keep_id"], r["group_size"], r["kept"], r["sha256"])) for r in got) == brute(rows)


def test_drop_copies(spark, docs_of):
    kept = op.drop_copies(docs_of(ROWS))
    assert kept.columns == docs_of(ROWS).columns
    assert sorted(str((r["doc_id"], lower(r["text"]))) for r in kept.collect()) == sorted(str((eval(x)[0], lower(t))) for x, t in {x: t for x in brute(ROWS) if eval(x)[3] for d, t in ROWS if d == eval(x)[0] and hashlib.sha256(lower(t).encode()).hexdigest() == eval(x)[4]}.items())


def test_rows_that_share_or_lack_ids(spark, docs_of):
    rows = [(None, "a"), (None, "b"), (None, "A"), (5, "c"), (5, "d"), (5, "D"), (6, "É"), (7, "é"), (None, None)]
    kept = sorted(str((r["doc_id"], lower(r["text"]))) for r in op.drop_copies(docs_of(rows)).collect())
    assert kept == sorted(str(x) for x in [(None, "a"), (None, "b"), (5, "c"), (5, "d"), (6, "É"), (7, "é"), (None, "")])


def test_empty(spark, docs_of):
    assert op.exact_groups(docs_of(ROWS).filter("doc_id < 0")).count() == 0


def test_repeated_rows_in_stretches_and_huge_copies(spark, docs_of):
    rows = [(None, "same")] * 11 + [(4, "same")] * 7 + [(9, "X" * 300 + "a")] * 5 + [(8, "x" * 300 + "A"), (7, "x" * 300 + "b"), (7, None)]
    got = op.exact_groups(docs_of(rows), chunk_bytes=64, stretch=3).collect()
    assert sorted(str((r["id"], r["keep_id"], r["group_size"], r["kept"], r["sha256"])) for r in got) == brute(rows)


def test_huge_texts_of_one_fingerprint_are_told_apart(spark, docs_of, monkeypatch):
    monkeypatch.setattr(op, "COMPARE_BYTES", 4)
    s, t = (x.decode() for x in collision())
    rows = [(1, s), (2, t), (3, s.upper()), (4, t), (5, "plain")]
    got = op.exact_groups(docs_of(rows), chunk_bytes=4).collect()
    assert sorted(str((r["id"], r["keep_id"], r["group_size"], r["kept"], r["sha256"])) for r in got) == brute(rows)
