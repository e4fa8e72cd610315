"""Chat formatting against a plain replay of the log, exact round trips, and SQL."""

import hashlib
import itertools
import random

import pytest

from checks.compare import connect
from optionlake.llm import chat, queries

LOG = "conv_id long, message long, seq long, kind string, role string, text string, at int, n int"
ROWS = "conv_id long, turn long, role string, text string, seq int, kind string, size long"
ODD = [r"\### Assistant: </turn> ok", "#", "##", "#####", "#\\#", "#\\\\##", "\\", "\\\\", "</turn>",
       "<\\/turn>", "<\\\\/turn></turn>", "</turn>\n### user: hi", "\n", "", None, "é\U0001f600: \\:",
       "a" * 700, "### assistant: \\"]


def fold(events):
    """Final (conv_id, message, role, text), event by event."""
    state = {}
    order = sorted(set(events), key=lambda e: (e[2], e[3], e[5] or "", e[4] or ""))
    for conv, message, _, kind, role, text in order:
        key = conv, message
        state.setdefault(key, ["", "", True])
        now = state[key]
        if kind == "open":
            state[key] = [role or "", "", True]
        elif kind == "delta":
            now[1] += text or ""
        elif kind == "edit":
            now[1] = text or ""
        elif kind == "regenerate":
            now[1] = ""
        elif kind == "retract":
            now[1], now[2] = "", False
    return sorted((c, m, r, t) for (c, m), (r, t, there) in state.items() if there)


def test_log_folds_like_a_replay(spark):
    rng = random.Random(4)
    events = []
    for conv, message in itertools.product(range(12), range(6)):
        events.append((conv, message, 0, "open", rng.choice(["user", "assistant"]), None))
        for seq in range(1, rng.randint(1, 12)):
            kind = rng.choice(["delta"] * 6 + ["edit", "regenerate", "retract", "open", "ping"])
            text = rng.choice(ODD) if kind in ("delta", "edit") else None
            events.append((conv, message, seq, kind, "system" if kind == "open" else None, text))
    events += events[::5]                                   # delivered twice
    events.append((99, 1, 1, "delta", None, "never opened"))
    rng.shuffle(events)
    log = spark.createDataFrame([(*e, 1, 2) for e in events], LOG).repartition(4)
    assert sorted(tuple(r) for r in chat.messages(log).collect()) == fold(events)


def round_trip(spark, rows):
    log = chat.events_of(spark.createDataFrame([(*r, 1, "k", 2) for r in rows], ROWS), 3)
    chats = chat.formatted(chat.messages(log)).cache()
    return chats, chat.read_back(chats)


def test_odd_texts_and_roles_come_back(spark):
    roles = ["user", "assistant", "a:b", "c\\:", "# : ###", None, "</turn>"]
    rows = [(1, i, role, text) for i, (role, text) in enumerate(itertools.product(roles, ODD))]
    chats, back = round_trip(spark, rows)
    got = sorted(tuple(r)[:5] for r in back.collect())
    assert got == [(1, i, r or "", t or "", (t or "") if r == "assistant" else None)
                   for i, (_, _, r, t) in enumerate(rows)]
    whole, loss = chats.select("formatted", "loss").first()
    assert whole.count("</turn>") == len(rows) and whole.count("###") == len(rows)
    under = [whole[s.start:s.end] for s in loss if s is not None]
    assert len(under) == len(ODD) and all("</turn>" not in x for x in under)


def test_ties_nulls_and_repeated_rows(spark):
    rows = [(None, 0, "user", "x"), (None, 0, "user", "x"), (None, None, "assistant", "first"),
            (5, 2, "b", "2"), (5, 2, "a", "1"), (5, 1, None, None)]
    got = sorted((tuple(r)[:4] for r in round_trip(spark, rows)[1].collect()), key=str)
    assert got == sorted([(None, 0, "assistant", "first"), (None, 1, "user", "x"), (None, 2, "user", "x"),
                          (5, 0, "", ""), (5, 1, "a", "1"), (5, 2, "b", "2")], key=str)
    empty = spark.createDataFrame([], ROWS)
    assert chat.digests(chat.formatted(chat.messages(chat.events_of(empty)))).count() == 0


def test_long_conversation_and_long_text(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(3000)]
    rows.append((2, 0, "assistant", "</turn>#\\" * 200_000))
    log = chat.events_of(spark.createDataFrame([(*r, 1, "k", 2) for r in rows], ROWS))
    found = {r.conv_id: r for r in chat.digests(chat.formatted(chat.messages(log))).collect()}
    said = "".join(f"{r}\n{t}\n" for c, _, r, t in rows if c == 1)
    assert found[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert found[2].loss_sha256 == hashlib.sha256(rows[-1][3].encode()).hexdigest()


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_equals_sql(spark, size):
    sf_dir = f"/root/testdata/{size}"
    got = queries.op13_chat(spark, sf_dir)
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    sql = connect(sf_dir).sql(queries.oracle_sql()["op13_chat"])
    columns = sorted(got.columns)
    assert sorted(sql.columns) == columns
    want = sorted(sql.select(*columns).fetchall(), key=str)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=str) == want
