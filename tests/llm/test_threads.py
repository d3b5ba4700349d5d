import random
from datetime import datetime, timedelta

from parleyspark.llm.threads import NIL, rebuild

SCHEMA = "uuid string, conversation_uuid string, sender string, text string, created_at string, updated_at string, parent_message_uuid string, loaded_at timestamp, turn int, role string"


def brute(rows):
    last = {}
    for r in rows:
        if r[0] and r[1]:
            last[(r[1], r[0])] = r
    convs = {}
    for (c, _), r in last.items():
        convs.setdefault(c, []).append(r)
    out = set()
    for c, ms in convs.items():
        ids = {m[0]: m for m in ms}
        up = {m[0]: None if m[6] in (None, "", NIL) else m[6] for m in ms}
        if any(p is not None and p not in ids for p in up.values()):
            continue
        key = lambda i: (datetime.fromisoformat(ids[i][4]), i)

        def loops(i):
            seen = set()
            while i is not None:
                if i in seen:
                    return True
                seen.add(i)
                i = up[i]
            return False

        if any(loops(i) for i in ids):
            continue
        if all(p is None for p in up.values()):
            thread = sorted(ids, key=key)
        else:
            thread = [max((i for i in ids if up[i] is None), key=key)]
            while kids := [i for i in ids if up[i] == thread[-1]]:
                thread.append(max(kids, key=key))
        roles = [{"human": "human", "user": "human", "assistant": "assistant"}.get((ids[i][2] or "").strip().lower()) for i in thread]
        texts = [(ids[i][3] or "").replace("​", "").strip() for i in thread]
        if not all(roles) or not all(texts) or roles[0] != "human" or any(a == "human" and b != "assistant" for a, b in zip(roles, [*roles[1:], None])):
            continue
        out |= {(c, n + 1, i, r) for n, (i, r) in enumerate(zip(thread, roles))}
    return out


def check(spark, rows):
    got = {tuple(r) for r in rebuild(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)
    return got


def test_random_conversations(spark):
    rnd = random.Random(4)
    day = datetime(2025, 1, 1)
    rows = []
    for c in range(150):
        n = rnd.randint(1, 7)
        flat = rnd.random() < 0.2
        for k in range(n):
            p = None if flat or not k else rnd.choice([f"{c}-{k - 1}"] * 12 + [f"{c}-{rnd.randrange(k)}"] * 3 + [f"{c}-{rnd.randrange(n)}", "missing", None, "0-0"])
            sender = rnd.choice(["Human ", "user"] if k % 2 == 0 else ["assistant", " ASSISTANT"]) if rnd.random() < 0.97 else rnd.choice(["tool", None, "", "human"])
            text = "hi" if rnd.random() < 0.97 else rnd.choice([None, "", "  ", "​"])
            at = day + timedelta(minutes=rnd.choice([k, k, k, 0]))
            rows.append((f"{c}-{k}", f"c{c}", sender, text, at.isoformat() + "+00:00", at.isoformat() + "+00:00", p if k else rnd.choice([None, "", NIL]), at, 1, "x"))
    assert len({r[0] for r in check(spark, rows + rows[::7])}) > 20


def test_versions_and_ends(spark):
    assert check(spark, []) == set()
    t = "2025-01-01T00:00:00Z"
    rows = [("a", "c", "human", "old", t, t, None, None, 0, ""), ("a", "c", "human", "new", "2025-01-01T09:00:00+09:00", "2025-01-02T00:00:00Z", None, None, 0, ""), ("b", "c", "assistant", "x" * 200_000, "2025-01-01T00:01:00Z", t, "a", None, 0, ""), (None, "c", "human", "x", t, t, None, None, 0, ""), ("z", None, "human", "x", t, t, None, None, 0, "")]
    assert {tuple(r) for r in rebuild(spark.createDataFrame(rows, SCHEMA)).collect()} == {("c", 1, "a", "human"), ("c", 2, "b", "assistant")}
    log = spark.createDataFrame([(*r, "edit") for r in rows] + [("d", "c", "human", "x", "2025-01-01T00:02:00Z", t, "b", None, 0, "", "create"), ("d", "c", "human", "x", "2025-01-01T00:02:00Z", "2025-01-03T00:00:00Z", "b", None, 0, "", "DELETE")], SCHEMA + ", op string")
    assert rebuild(log, op="op").count() == 2
    assert rebuild(log).count() == 0
