import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from trellis.llm import conversations as C

VALID = re.compile("(s?(ua)+)?")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if d == 0:
            continue
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        out += [(conv, turn, "user" if d == 4 else role, text)] * (1 + (d == 3))
    return out


def cheapest(rows, faults):
    """Uniform-cost search over (row, state of the pattern), by (cost, audit): no layers, no segments."""
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    todo, done = [(0, "", 0, "", ())], set()
    while todo:
        cost, audit, i, state, out = heapq.heappop(todo)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, audit, out
        for r, name in (("u", "user"), ("a", "assistant")):
            if r in after[state]:
                heapq.heappush(todo, (cost + 5, audit + "I", i, r, (*out, (name, ""))))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(todo, (cost + 2, audit + "D", i + 1, state, out))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 * (faults[i] == "truncated")
                if role[:1] and role[:1] in after[state]:
                    heapq.heappush(todo, (cost + more, audit + "K", i + 1, role[0], (*out, (role, text))))
                for r, name in (("u", "user"), ("a", "assistant")):
                    if r in after[state]:
                        heapq.heappush(todo, (cost + more + 1, audit + "R", i + 1, r, (*out, (name, text))))
    raise AssertionError


def order(turn, role, text):
    return turn is not None, turn or 0, role[:64].encode(), text[:64].encode(), hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).hexdigest()


def brute(rows, ids):
    found = []
    for conv in ids:
        own = sorted((k[1:] for k in rows if k[0] == conv), key=lambda k: order(*k))
        turns = {t for t, _, _ in own if t is not None}
        lines, faults, seen = [(r, x) for _, r, x in own], [], set()
        for r, x in lines:
            shown = re.findall(r"[^\x20\x09-\x0D]", x)
            faults.append("blank" if not shown else "duplicate" if (r, x) in seen else "" if shown[-1] in ".!?" else "truncated")
            seen.add((r, x))
        initials = [r[:1] for r, _ in lines]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        cost, audit, out = cheapest(lines, faults)
        assert VALID.fullmatch("".join(r[0] for r, _ in out))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        sha = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest()
        found.append((conv, gaps, *map(faults.count, ("blank", "duplicate", "truncated")), illegal, cost, audit, sha))
    return sorted(found, key=repr)


def conversations(seed=1, n=60, most=14):
    r = random.Random(seed)
    rows = []
    says = ["Yes.", "No!", "Why?", "and so on", "", " \n", "Well. ", "é…", "Line one.\nLine two", "?", None, "x" * 5000 + "."]
    for conv in range(n):
        roles = itertools.cycle(["user", "assistant"])
        for turn in range(r.randint(1, most)):
            role = r.choice([next(roles)] * 6 + ["system", "user", "assistant", "tool", "", None, "sys", "Üser"])
            rows.append((conv, turn if r.random() < 0.95 else None, role, r.choice(says) if r.random() < 0.5 else f"Line {r.randint(0, 60)}."))
    rows += [(None, t, "user", "Without an id.") for t in (0, 1, None)] + [(None, 2, "assistant", "Yes.")]
    rows += [rows[3], rows[3], rows[10]] + [(900, None, "user", "Hi."), (901, 5, "assistant", ""), (902, -3, "system", "Rule.")]
    return rows


def table(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.select("*", *(F.lit(i).alias(c) for i, c in enumerate(["seg", "at", "fault", "sign", "d", "twice", "signature", "a.b", "first"])))


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def test_the_query(spark, tmp_path):
    rows = conversations()
    table(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    got = rows_of(C.op13_conversations(spark, str(tmp_path)))
    assert got == brute(damage(rows), {r[0] for r in rows})
    assert {type(v) for r in got for v in r[1:7]} == {int}


def test_no_rows(spark, tmp_path):
    table(spark, []).write.parquet(f"{tmp_path}/conversations.parquet")
    assert C.op13_conversations(spark, str(tmp_path)).count() == 0


def test_all_rows_dropped(spark, tmp_path):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    table(spark, [(gone, 0, "user", "Hi.")]).write.parquet(f"{tmp_path}/conversations.parquet")
    assert rows_of(C.op13_conversations(spark, str(tmp_path))) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


@pytest.mark.parametrize(("rows", "size"), [(1, 1 << 20), (2, 1 << 20), (3, 40), (7, 1 << 20)])
def test_segments_give_the_same(spark, rows, size):
    """Conversations cut into segments of a few rows: same costs, edits, counts and rows."""
    given = [x for x in conversations(2, 40, 25) if x[3] is None or len(x[3]) < 100]
    r = random.Random(3)
    given += [(5000, t, r.choice(["user", "assistant", "system", "tool"]), r.choice(["Yes.", "No", "", f"Said {t}.", f"Cut {t}"])) for t in range(300)]
    report, repaired = C.repair(table(spark, damage(given)).repartition(6), rows, size)
    hashes = {x.conv_id: x.sha256 for x in C.digests(repaired).collect()}
    got = sorted(((*(x[c] for c in COLUMNS[:-1]), hashes.get(x.conv_id, hashlib.sha256().hexdigest())) for x in report.collect()), key=repr)
    kept = damage(given)
    assert got == brute(kept, {x[0] for x in kept})


@pytest.mark.parametrize("seed", range(3))
def test_trie_shares_prefixes(seed, monkeypatch):
    r = random.Random(seed)
    signatures = sorted({"".join(r.choice("suaxSUAXD") for _ in range(r.randint(0, 9))) for _ in range(400)} | {"ua" * 20, "ua" * 20 + "s"})
    steps, plain = [], C.next_layer
    monkeypatch.setattr(C, "next_layer", lambda layer, sign: steps.append(sign) or plain(layer, sign))
    answers = list(C.solve(iter(signatures)))
    assert len(steps) == len({s[:i] for s in signatures for i in range(1, len(s) + 1)})
    for s, layer in zip(signatures, answers, strict=True):
        alone = C.first_layer()
        for sign in s:
            alone = plain(alone, sign)
        assert layer == alone


def test_repaired_rows_are_a_table(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "Hello."), (1, 3, "assistant", "Yes"), (2, 0, "assistant", "Yes.")]
    report, repaired = C.repair(table(spark, rows))
    assert {r.conv_id: (r.cost, r.audit) for r in report.collect()} == {1: (3, "KKRD"), 2: (2, "D")}
    assert [(r.edit, r.role, r.text) for r in repaired.orderBy("conv_id", "seg", "place").collect()] == [("K", "system", "Be kind."), ("K", "user", "Hi."), ("R", "assistant", "Hello.")]
