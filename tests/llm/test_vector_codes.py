import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from corpusloom.llm import queries, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, v string, dim int, code string"


def frame(spark, rows):
    return spark.createDataFrame([(i, x, y, "x", -1, "c") for i, x, y in rows], SCHEMA)


def plain(rows, parts=8, entries=16, rounds=6):
    """Codes, errors and digest by loops over Python integers; all vectors of one length."""
    kept = [(i, [math.floor(4096 * c) for c in x], y) for i, x, y in rows if x is not None and all(c is not None and math.isfinite(c) for c in x)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    part = lambda v, p: v[p * width : (p + 1) * width]
    books = [[part(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assign(v):
        return [min(range(len(books[p])), key=lambda e: (far(part(v, p), books[p][e]), e)) for p in range(parts)]

    for _ in range(rounds):
        found = [assign(v) for _, v, _ in kept]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [part(v, p) for (_, v, _), f in zip(kept, found) if f[p] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    out, sums = [], {}
    for i, v, y in kept:
        code = assign(v)
        error = sum(far(part(v, p), books[p][e]) for p, e in enumerate(code))
        sums[y] = sums.get(y, 0) + error
        out.append((i, "".join(f"{e:02x}" for e in code), error, y))
    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    return sorted(((i, code, error, sums[y], digest) for i, code, error, y in out), key=str)


def got(df, **how):
    return sorted(((r["id"], r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in vector_codes.compress(df, **how).collect()), key=str)


def vectors(n, dim=16, seed=0):
    rng = random.Random(seed)
    near = lambda x: float(np.float32(x))
    middles = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(12)]
    return [(i, [near(c + rng.gauss(0, 0.2)) for c in rng.choice(middles)], rng.choice([0, 1, 2, None])) for i in range(n)]


def test_same_as_brute_force(spark):
    rows = vectors(150)
    rows += [(500, None, 1), (501, [1.0] * 15 + [None], 1), (502, [float("nan")] * 16, 1), (503, [float("inf")] * 16, 1), (None, rows[3][1], None), (7, rows[7][1], 2)]
    rows += [(600 + k, rows[5][1], 0) for k in range(200)]  # equal vectors, a hot label
    assert got(frame(spark, rows).repartition(5)) == plain(rows)


@pytest.mark.parametrize("n", [1, 3, 15, 16, 17])
def test_fewer_vectors_than_entries(spark, n):
    rows = vectors(n, 8, n)
    assert got(frame(spark, rows)) == plain(rows)


def test_empty_and_all_left_out(spark):
    assert got(frame(spark, [])) == []
    assert got(frame(spark, [(1, None, 1), (2, [None], 1)])) == []


def test_lengths_have_codebooks_of_their_own(spark):
    a, b = vectors(40, 16, 1), [(i + 100, x, y) for i, x, y in vectors(40, 24, 2)]
    found = {r["id"]: (r["code"], r["error"], r["codebooks_sha256"]) for r in vector_codes.compress(frame(spark, a + b)).collect()}
    for rows in (a, b):
        for i, code, error, _, digest in plain(rows):
            assert found[i] == (code, error, digest)


def test_lengths_that_parts_do_not_divide(spark):
    rows = vectors(60, 13, 3)
    filled = [(i, x + [0.0] * 3, y) for i, x, y in rows]
    assert got(frame(spark, rows)) == plain(filled)
    none = got(frame(spark, [(1, [], 1), (2, [], None)]))
    assert [r[:4] for r in none] == [(1, "00" * 8, 0, 0), (2, "00" * 8, 0, 0)]


def test_huge_components_do_not_overflow(spark):
    rows = [(1, [3e38] * 8, 1), (2, [-3e38] * 8, 1), (3, [0.0] * 8, 1)]
    assert all(r[2] >= 0 for r in got(frame(spark, rows), rounds=2))


def test_decoding_gives_the_entries(spark):
    rows = vectors(100, 16, 4)
    ints = vector_codes.staged(vector_codes.integers(frame(spark, rows).select("vec_id", "embedding"), "embedding"), "t")
    books = vector_codes.learn(ints, "vec_id")
    coded = vector_codes.encode(ints, books)
    decoded = {r["vec_id"]: (r["error"], r["decoded"]) for r in vector_codes.decode(coded.withColumn("of", coded["error"]), books, 16).collect()}
    for i, x, _ in rows:
        error, back = decoded[i]
        assert error == sum((math.floor(4096 * a) - round(4096 * b)) ** 2 for a, b in zip(x, back))


def test_same_as_sql(spark, tmp_path):
    rows = vectors(120, 64, 5) + [(900, None, 1), (901, [float("nan")] * 64, 1)]
    frame(spark, rows).select("vec_id", "embedding", "label").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    out = queries.op11_vector_codes(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(queries.ORACLES["op11_vector_codes"])
    assert sorted(map(tuple, out.select(*want.columns).collect())) == sorted(want.fetchall())
    assert len(want.fetchall()) == 120
