import hashlib
import itertools
import random
import re
import zlib
from functools import cache

import duckdb
import pytest

from corpusloom.llm import conversations, queries

SCHEMA = "conv_id long, turn long, role string, text string, conv string, n int, block int"
COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", 0, 1) for r in rows], SCHEMA)


def damage(rows):
    """Rows of each conversation after damage, in order."""
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if h == 1:
            text = ""
        elif h == 2:
            text = re.sub("[.!?]", "", text)
        elif h == 4:
            role = "user"
        own.extend([(turn, role, text)] * (0 if h == 0 else 2 if h == 3 else 1))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest())
    return {conv: sorted(own, key=key) for conv, own in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def enumerated(rows, found):
    """Cheapest edits among all of up to two inserts between rows; for three rows at most."""
    best = None
    inserts = [[("I", r) for r in c] for k in range(3) for c in itertools.product(("user", "assistant"), repeat=k)]
    for gaps in itertools.product(inserts, repeat=len(rows) + 1):
        for edits in itertools.product(("K", "D", ("R", "user"), ("R", "assistant")), repeat=len(rows)):
            audit, roles, lines, cost = "", "", [], 0
            for i, gap in enumerate(gaps):
                for _, role in gap:
                    audit, roles, cost = audit + "I", roles + role[0], cost + 5
                    lines.append(f"{role}:")
                if i == len(rows):
                    break
                _, role, text = rows[i]
                edit = edits[i]
                if edit == "D":
                    audit, cost = audit + "D", cost + 2
                    continue
                if found[i] in ("blank", "duplicate") or not role:
                    cost += 10_000
                cost += 5 * (found[i] == "truncated") + (edit != "K")
                role = role if edit == "K" else edit[1]
                audit, roles = audit + edit[0], roles + role[:1]
                lines.append(f"{role}:{text}")
            if re.fullmatch("(s?(ua)+)?", roles):
                best = min(best or (cost, audit, lines), (cost, audit, lines))
    return best


def stepped(rows, found):
    """The same by whole strings for each state, for conversations of any length."""
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}
    best = {"": (0, "", ())}

    def inserted(best):
        out = {}
        for state, (cost, audit, lines) in best.items():
            for _ in range(4):
                out[state] = min(out.get(state, (cost, audit, lines)), (cost, audit, lines))
                state = after[state]
                cost, audit, lines = cost + 5, audit + "I", (*lines, f"{name[state]}:")
        return out

    for (_, role, text), fault in zip(rows, found):
        new = {}
        for state, (cost, audit, lines) in inserted(best).items():
            ways = [(state, cost + 2, audit + "D", lines)]
            if fault not in ("blank", "duplicate"):
                more, to = 5 * (fault == "truncated"), after[state]
                ways.append((to, cost + 1 + more, audit + "R", (*lines, f"{name[to]}:{text}")))
                if role[:1] == to or (state, role[:1]) == ("", "s"):
                    ways.append((role[:1], cost + more, audit + "K", (*lines, f"{role}:{text}")))
            for to, *rest in ways:
                new[to] = min(new.get(to, tuple(rest)), tuple(rest))
        best = new
    ends = inserted(best)
    return min(ends[s] for s in ("", "a") if s in ends)


def plain(rows, solve=stepped):
    out = {}
    for conv, own in damage(rows).items():
        found = faults(own)
        turns = [t for t, _, _ in own if t is not None]
        cost, audit, lines = solve(own, found)
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:])]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def got(df, **how):
    rows = conversations.report(df, **how).collect()
    assert len({r["id"] for r in rows}) == len(rows)
    return {r["id"]: tuple(r[c] for c in COLUMNS) for r in rows}


def made(n, longest, seed=0):
    rng = random.Random(seed)
    texts = ["One.", "Two!", "Three?", "No end", "No end ", "", " \t", "Same.", "Ünd.\n", None]
    roles = ["user", "assistant", "system", "tool", None, "u", ""]
    rows = []
    for conv in range(n):
        for k in range(rng.randint(0, longest)):
            rows.append((conv if conv else None, rng.choice([k, k, k, k + 3, None]), rng.choices(roles, [8, 8, 3, 1, 1, 1, 1])[0], rng.choices(texts, [4, 4, 4, 2, 1, 1, 1, 2, 1, 1])[0]))
    return rows


def test_same_as_all_edits(spark):
    rows = [r for r in made(60, 3, 1) if r[2] != ""]
    want = {conv: found for conv, found in plain(rows, lambda a, f: enumerated(a, f) if len(a) <= 3 else stepped(a, f)).items()}
    assert got(frame(spark, rows)) == want


def test_long_ones_and_blocks(spark):
    rows = made(40, 30, 2) + [(1000, k, "user" if k % 2 else "assistant", f"Text {k}{'.' if k % 7 else ''}") for k in range(300)]
    want = plain(rows)
    assert got(frame(spark, rows)) == want
    assert got(frame(spark, rows).repartition(7), block=16) == want


def test_repeated_rows_are_folded(spark):
    rows = made(10, 6, 3) + [(77, 5, "user", "Hot.")] * 700 + [(77, 6, "assistant", "Well.")] + [(78, 1, "user", " ")] * 50
    assert got(frame(spark, rows), block=64) == plain(rows)


def test_one_text_over_many_turns(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", "Again.") for k in range(400)]
    assert got(frame(spark, rows), block=50) == plain(rows)


def test_very_long_texts(spark):
    rows = [(5, k, "user" if k % 2 == 0 else "assistant", "long text. " * 40_000 + f"{k}.") for k in range(20)]
    assert got(frame(spark, rows), block=4) == plain(rows)


def test_dropped_and_empty(spark):
    assert got(frame(spark, [])) == {}
    gone = next((c, t) for c in range(100) for t in range(20) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    found = got(frame(spark, [(*gone, "user", "Gone.")]))
    assert found == {gone[0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}


def test_shared_prefixes_are_worked_out_once():
    trie = conversations.Trie()
    words = sorted({"eimeim", "eimei", "eimeime", "eimeipi", "aeim", "aeimei"})
    for w in words:
        trie.go(w)
        fresh = conversations.Trie()
        fresh.go(w)
        assert trie.answer() == fresh.answer()
    assert trie.computed == len({w[:k] for w in words for k in range(1, len(w) + 1)})


@cache
def _symbols(role, fault):
    return conversations.SYMBOLS["suao".index(role) * 4 + conversations.FAULTS.index(fault or "none")]


@pytest.mark.parametrize("seed", range(20))
def test_trie_against_strings(seed):
    rng = random.Random(seed)
    rows = [(0, rng.choice(["user", "assistant", "system", "other"]), "x") for _ in range(rng.randint(0, 40))]
    found = [rng.choices(["", "blank", "duplicate", "truncated"], [6, 1, 1, 2])[0] for _ in rows]
    trie = conversations.Trie()
    trie.go("".join(_symbols(r[1][0], f) for r, f in zip(rows, found)))
    cost, audit, _ = stepped(rows, found)
    assert trie.answer()[4:] == (cost, audit)


def test_same_as_sql(spark, tmp_path):
    rows = made(60, 9, 5)
    frame(spark, rows).select("conv_id", "turn", "role", "text").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    out = queries.op12_conversations(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.sql(queries.ORACLES["op12_conversations"])
    assert sorted(map(str, map(tuple, out.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))
