import hashlib
import random

from pathlode.llm import chat, queries
from pyspark.sql import functions as F

SCHEMA = "conv_id long, seq long, kind string, msg string, role string, text string, formatted string"


def log(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


def test_fold_deltas_edits_and_regenerations(spark):
    rows = [
        (1, 0, "message", None, "user", "hi"),
        (1, 1, "delta", "m1", "assistant", "wro"),
        (1, 2, "delta", "m1", "assistant", "ng"),
        (1, 3, "regenerate", "m1", "assistant", ""),
        (1, 5, "delta", "m1", None, "ght"),
        (1, 4, "delta", "m1", None, "ri"),
        (1, 6, "delta", "m2", "user", "typo"),
        (1, 7, "edit", "m2", "user", "fixed"),
        (1, 8, "delta", "m2", "user", "!"),
    ]
    out = chat.format_chats(log(spark, rows)).select("conv_id", chat.parse_chats(F.col("formatted")).alias("t"), "formatted", "spans").first()
    assert [(t.role, t.text) for t in out.t] == [("user", "hi"), ("assistant", "right"), ("user", "fixed!")]
    assert [out.formatted.encode()[s.start : s.start + s.bytes] for s in out.spans] == [b"right"]


def test_round_trip_of_control_strings_nulls_ties_and_repeats(spark):
    hard = ["\\### Assistant: </turn> ok", "</turn>\n", "####", "\\", "a:\nb", "", "</", "<</turn>>", "é☃\U0001f600", "x" * 50_000]
    rows = [(1, i, "message", None, "assistant" if i % 2 else "user:\n", t) for i, t in enumerate(hard)]
    rows += [(2, 0, None, None, None, None), (2, 0, None, None, None, None), (None, 0, "message", None, "assistant", "z")]
    got = {r.conv_id: r for r in chat.chat_digests(chat.format_chats(log(spark, rows))).collect()}
    said = "".join(f"{'assistant' if i % 2 else 'user:' + chr(10)}\n{t}\n" for i, t in enumerate(hard))
    loss = "".join(t for i, t in enumerate(hard) if i % 2)
    assert got[1].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert (got[1].n_turns, got[1].loss_chars) == (len(hard), len(loss))
    assert got[1].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert (got[2].n_turns, got[2].loss_chars) == (2, 0)
    assert got[None].loss_chars == 1


def test_empty_log(spark):
    assert chat.chat_digests(chat.format_chats(log(spark, []))).count() == 0


def fold(events):
    """Messages of a log in plain Python: (role, text) in order."""
    found = {}
    for k, (_, seq, kind, msg, role, text) in enumerate(events):
        name = ("=", k) if kind in (None, "message") else ("/", msg)
        found.setdefault(name, []).append((seq is None, seq or 0, kind or "message", role or "", "" if kind == "open" else text or ""))
    out = []
    for own in found.values():
        own.sort()
        body = ""
        for _, _, kind, _, text in own:
            body = text if kind in ("edit", "regenerate", "message") else body + text
        role = next((e[3] for e in own if e[3]), "")
        out.append((own[0][:2], role, body))
    return [(r, t) for _, r, t in sorted(out)]


def test_random_logs_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for conv in range(25):
        for _ in range(rng.randrange(1, 40)):
            kind = rng.choice(["open", "delta", "delta", "delta", "edit", "regenerate", "message", None])
            rows.append((conv, rng.choice([None, *range(60)]), kind, rng.choice("abc"), rng.choice([None, "user", "assistant"]), rng.choice([None, "", "x\\", "é</turn>\n", "## #"])))
    got = {r.conv_id: [(t.role, t.text) for t in r.t] for r in chat.format_chats(log(spark, rows)).select("conv_id", chat.parse_chats(F.col("formatted")).alias("t")).collect()}
    for conv in range(25):
        assert sorted(got[conv]) == sorted(fold([r for r in rows if r[0] == conv]))


def test_written_turns_come_out_of_the_fold(spark):
    texts = [None, "", "é" * 9000, "a\n" * 5000, "\U0001f600" * 4097]
    rows = [(1, k, "assistant", t, "clash") for k, t in enumerate(texts)] + [(1, None, "user", "late", "x"), (1, 0, "assistant", None, "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, kind string")
    events = chat.turns_as_events(turns.drop("kind"))
    assert events.where("kind = 'delta'").count() == 9
    plan = chat.format_chats(events)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_max" in plan and "regenerate" in plan
    got = chat.format_chats(events).select(chat.parse_chats(F.col("formatted")).alias("t")).first().t
    assert [(t.role, t.text) for t in got] == [("assistant", "")] * 2 + [("assistant", t or "") for t in texts[1:]] + [("user", "late")]


def test_very_many_turns_take_linear_time(spark):
    turns = spark.range(60_000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('turn ', id) AS text")
    got = chat.chat_digests(chat.format_chats(chat.turns_as_events(turns))).first()
    assert got.n_turns == 60_000 and got.loss_chars == sum(len(f"turn {k}") for k in range(1, 60_000, 2))


def test_query_has_the_fold_in_its_plan(spark):
    plan = queries.op1_chat(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regenerate" in plan and "array_max" in plan
