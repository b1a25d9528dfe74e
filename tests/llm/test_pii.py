import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from corpusloom.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, reversed(digits)))) % 10 == 0


def brute(text):
    found = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda: 14 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 10 <= len(digits) <= 15}[kind]()
            if ok:
                found.append((m.start(), rank, kind, m.end()))
    found.sort()
    counts = [sum(f[2] == k for f in found) for k in BASE]
    return (*counts, hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in found).encode()).hexdigest())


def rows():
    rng = random.Random(8)
    bits = ["a@b.c", "@", ".", "x_y%z+", "-", " ", "1", "255", "256", "4111 1111 1111 1111", "4111-1111-1111-1112", "+49 (30) 123-4567", "+1", "0", "00000000000000", "é", "😀", "\n", "e@f", "GB82 WEST 1234 5698 7654 32", "192.168.0.1", "1.2.3.4.5.6.7.8", "_d@e.f", "()", "378282246310005"]
    texts = [None, "", "a@b.c_d@e.f", "a@b.c.@x.y", "1.2.3.004", "5555555555554444 5", "+" * 50, "".join(["😀a@b.co"] * 3)]
    texts += ["".join(rng.choices(bits, k=rng.randint(1, 25))) for _ in range(600)]
    texts += ["9" * 20_000, "1 " * 20_000, "a." * 20_000, "1." * 20_000, "+1" + "(" * 20_000, "x" * 50_000 + "@y.z", "A" * 30_000, "a@b" + ".c" * 20_000]
    return list(enumerate(texts)) + [(3, "x@y.zz"), (3, "x@y.zz"), (None, "n@o.id")]


def test_like_the_plain_patterns(spark, docs_of):
    data = rows()
    got = pii.report(docs_of(data)).collect()
    assert sorted(str((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"])) for r in got) == sorted(str((d, *brute(t))) for d, t in data)


def test_account_numbers_scores_and_redaction(spark, docs_of):
    text = "my iban: GB82 WEST 1234 5698 7654 32, not GB83 WEST 1234 5698 7654 32; mail bob@x.org"
    found = pii.find(docs_of([(1, text)])).first()["spans"]
    assert [(s["kind"], s["match"], s["score"]) for s in found] == [("iban", "GB82 WEST 1234 5698 7654 32", 1.0), ("email", "bob@x.org", 1.0)]
    assert text[found[0]["start"] : found[0]["stop"]] == found[0]["match"]
    assert pii.redact(docs_of([(1, text)])).first()["redacted"] == "my iban: [IBAN], not GB83 WEST 1234 5698 7654 32; mail [EMAIL]"
    assert pii.find(docs_of([(1, "bob@x.org")])).first()["spans"][0]["score"] == 0.9


def accounts(text):
    """Account numbers by the definition: a word that begins with a country and two digits, as long as that country's numbers."""
    lengths = {c: n for n, countries in pii.IBAN_LENGTHS.items() for c in countries}
    out, at = [], 0
    while at < len(text):
        n, stop, held = lengths.get(text[at : at + 2]), at, ""
        if n and not (at and re.match("[A-Za-z0-9_]", text[at - 1])) and re.match("[0-9]{2}", text[at + 2 : at + 4]):
            while len(held) < n and stop < len(text):
                gap = len(held) >= 4 and text[stop] == " "
                if not re.match("[A-Z0-9]", text[stop + gap : stop + gap + 1]):
                    break
                held, stop = held + text[stop + gap], stop + gap + 1
            if len(held) == n and not re.match("[A-Za-z0-9_]", text[stop : stop + 1]):
                if int("".join(str(int(c, 36)) for c in held[4:] + held[:4])) % 97 == 1:
                    out.append((at, stop))
                at = stop
                continue
        at += 1
    return out


def test_account_numbers_by_the_definition(spark, docs_of):
    rng = random.Random(3)
    bits = ["GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "FR1420041010050500013M02606", "NO9386011117947", "XX12 3456 7890 1234", " ", " ", "A", "OK", "9", "_", "x", "GB", "32", "\n"]
    texts = ["IBAN DE89370400440532013000 OK", "IBAN: GB82 WEST 1234 5698 7654 32 AND more", "DE89 3704 0044 0532 0130 00 DE89 3704 0044 0532 0130 00"]
    texts += ["".join(rng.choices(bits, k=rng.randint(1, 12))) for _ in range(400)]
    found = {r["id"]: [(s["start"], s["stop"]) for s in r["spans"] if s["kind"] == "iban"] for r in pii.find(docs_of(list(enumerate(texts)))).collect()}
    assert found == {i: accounts(t) for i, t in enumerate(texts)}
    assert [len(found[i]) for i in range(3)] == [1, 1, 2]


def test_secrets(spark, docs_of):
    token = "027aea05eb92c454086e6575cd38d76a884acaff"
    data = [(1, f'token = "{token}"'), (2, f"see {token}."), (3, "1" * 40), (4, "a" + token)]
    got = {r["id"]: [(s["match"], s["score"]) for s in r["spans"] if s["kind"] == "secret"] for r in pii.find(docs_of(data)).collect()}
    assert got == {1: [(token, 0.95)], 2: [(token, 0.5)], 3: [], 4: []}


def test_redacts_overlapping_spans_whole(spark, docs_of):
    data = [(1, "+378282246310005 é a@b.co,b@c.de"), (2, None), (3, "😀 nothing")]
    got = {r["id"]: r["redacted"] for r in pii.redact(docs_of(data)).collect()}
    assert got == {1: "[PHONE] é [EMAIL],[EMAIL]", 2: "", 3: "😀 nothing"}


def test_time_in_proportion_to_the_matches(spark, docs_of):
    def seconds(n):
        text = " ".join(f"user{i}@host.org" for i in range(n))
        docs = docs_of([(1, text)])
        began = time.perf_counter()
        assert pii.report(docs).first()["n_email"] == n
        assert pii.redact(docs).first()["redacted"].count("[EMAIL]") == n
        return time.perf_counter() - began

    seconds(2_000)
    few, many = seconds(10_000), seconds(100_000)
    assert many < 20 * max(few, 0.5)


def test_domain_that_begins_with_a_hyphen(spark, docs_of):
    data = [(1, "a@-b.c"), (2, "x@-.y"), (3, "a@.b")]
    got = pii.report(docs_of(data)).collect()
    assert sorted(str((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"])) for r in got) == sorted(str((d, *brute(t))) for d, t in data)
    assert sum(r["n_email"] for r in got) == 2


def test_no_python_in_the_plan(spark, docs_of):
    plan = pii.report(docs_of([(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty(spark, docs_of):
    assert pii.report(docs_of([(1, "x")]).filter(F.col("doc_id") < 0)).count() == 0
