import hashlib
import itertools
import random
import re
import zlib

from tests.compare import connect, difference
from trackloom.llm import conversation_repair as repair
from trackloom.llm.queries import QUERIES, SQL

TABLE = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\v\f\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        draw, role, text = zlib.crc32(name.encode()) % 20, role if role is not None else " ", text if text is not None else " "
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        out += [(conv, turn, "user" if draw == 4 else role, text)] * (0 if draw == 0 else 2 if draw == 3 else 1)
    return out


def faults(lines):
    seen, found = set(), []
    for _, role, text in lines:
        body = text.rstrip(WHITE)
        found.append("blank" if not body else "duplicate" if (role, text) in seen
                     else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return found


def exhaustive(lines, found):
    """Every sequence of edits with at most two insertions between rows."""
    best = None
    for edits in itertools.product("DKR", repeat=len(lines)):
        for gaps in itertools.product((0, 1, 2), repeat=len(lines) + 1):
            audit = "".join("I" * g + e for g, e in zip(gaps, (*edits, "")))
            for led in (False, True):
                at, cost, kept, good = 0, 0, [], True
                for edit in audit:
                    place = "s" if led and not kept else "ua"[(len(kept) - led) % 2]
                    whole = {"s": "", "u": "user", "a": "assistant"}[place]
                    if edit == "I":
                        kept.append((whole, ""))
                        cost += 2
                        good &= place != "s"
                        continue
                    _, role, text = lines[at]
                    must, late = found[at] in ("blank", "duplicate"), found[at] == "truncated"
                    at += 1
                    if edit == "D":
                        cost += 3
                        continue
                    good &= not must and (role[:1] == place if edit == "K" else place != "s")
                    cost += late + (2 if edit == "R" else 0)
                    kept.append((role if edit == "K" else whole, text))
                if good and (len(kept) - led) % 2 == 0 and not (led and len(kept) == 1) and (best is None or (cost, audit) < best[:2]):
                    best = cost, audit, kept
    return best


def forward(lines, found):
    """The same by one pass over the rows; for long conversations."""
    follow = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}

    def inserts(best):
        for _ in range(2):
            for p, (cost, audit) in list(best.items()):
                q = 3 if p == 2 else 2
                best[q] = min(best.get(q, (1 << 60, "")), (cost + 2, audit + "I"))
        return best

    best = inserts({0: (0, "")})
    for (_, role, _), fault in zip(lines, found):
        after = {}
        for p, (cost, audit) in best.items():
            ways = [(p, 3, "D")]
            if fault not in ("blank", "duplicate"):
                ways += [(follow[p, x], c + (fault == "truncated"), e) for x, c, e in
                         ((role[:1], 0, "K"), ("u", 2, "R"), ("a", 2, "R")) if (p, x) in follow]
            for q, weight, edit in ways:
                after[q] = min(after.get(q, (1 << 60, "")), (cost + weight, audit + edit))
        best = inserts(after)
    return min(best[p] for p in (0, 3) if p in best)


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        lines = [r[1:] for r in damage([r for r in rows if r[0] == conv])]
        lines.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        found, turns = faults(lines), [r[0] for r in lines if r[0] is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(lines))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
                     *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal), lines, found
    return out


def query(frame):
    got = repair.repair_conversations(repair.damaged(frame)).collect()
    assert len({r.conv for r in got}) == len(got)
    return {r.conv: r for r in got}


def counts(row):
    return row.gaps, row.blank, row.duplicate, row.truncated, row.illegal


def test_against_sql(spark, folder):
    assert difference(QUERIES["op11_lightest_repair"](spark, folder), connect(folder), SQL["op11_lightest_repair"]) is None


def test_against_every_edit(spark):
    generator, table = random.Random(5), []
    roles, texts = ("user", "assistant", "system", "tool", "", None), ("Yes.", "No!", "cut", " ", "", None, "Eh?\n", "no end\f")
    for conv in range(60):
        for _ in range(generator.randint(0, 4)):
            table.append((conv, generator.choice((None, 0, 1, 2, 3, 9)), generator.choice(roles), generator.choice(texts)))
    table += [(None, 1, "user", "Hi."), (None, None, "assistant", "Ho."), (-3, 5, "system", "Only.")]
    frame = spark.createDataFrame(table, TABLE).repartition(5)
    for name in ("conv", "n", "digest", "audit", "part"):
        frame = frame.selectExpr("*", f"'clash' AS {name}")
    got, want = query(frame), expected(table)
    assert got.keys() == want.keys()
    for conv, (numbers, lines, found) in want.items():
        if len(lines) <= 4:
            cost, audit, kept = exhaustive(lines, found)
            text = "\n".join(f"{role}:{text}" for role, text in kept)
            assert (got[conv].cost, got[conv].audit) == (cost, audit)
            assert got[conv].repaired_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (*counts(got[conv]), got[conv].cost, got[conv].audit) == (*numbers, *forward(lines, found))


def test_long_and_hot_conversations(spark, monkeypatch):
    monkeypatch.setattr(repair, "FRAGMENT", 8)
    generator = random.Random(9)
    table = [(0, k // 2, generator.choice(("user", "assistant", "system", "x")), generator.choice(("A.", "B", "", f"{k}.", f"{k}")))
             for k in range(3000)]
    table += [(1, 7, "user", "the same.")] * 500 + [(2, k, "user", "line." * 20000) for k in range(3)]
    table += [(3, k, ("user", "assistant")[k % 2], f"t{k}.") for k in range(1000)] + [(c, 1, "user", "Q?") for c in range(4, 200)]
    got, want = query(spark.createDataFrame(table, TABLE).repartition(6)), expected(table)
    for conv, (numbers, lines, found) in want.items():
        assert (*counts(got[conv]), got[conv].cost, got[conv].audit) == (*numbers, *forward(lines, found)), conv


def test_agenda_over_blocks_is_that_over_rows():
    generator = random.Random(2)
    for n in (0, 1, 7, 40, 200):
        steps = [repair.step(generator.choice("suax"), generator.choice("DTKK"), generator.randint(1, 3)) for _ in range(n)]
        folding = repair.Folding()
        for one in steps:
            folding.add(repair.block([one]))
        (value,) = repair.lightest(steps, 0, repair.GOALS).values()
        assert folding.best() == value


def test_empty_table(spark):
    assert query(spark.createDataFrame([], TABLE)) == {}
