import hashlib
import random

from pyspark.sql import functions as F

from hushscan.llm import chat

EVENTS = "conv_id long, message string, seq long, kind string, role string, text string, place string, formatted int"


def fold(spark, events):
    df = spark.createDataFrame([(*e, "clash", 1) for e in events], EVENTS)
    rows = chat.fold_events(df).orderBy("conv_id", "place").collect()
    return [(r.conv_id, r.role, r.text) for r in rows]


def test_deltas_edits_and_regenerations(spark):
    events = [
        (1, "a", 0, "delta", "user", "What "), (1, "a", 1, "delta", None, "now?"),
        (1, "b", 2, "delta", "assistant", "First"), (1, "c", 3, "delta", "user", "Why?"),
        (1, "b", 4, "regenerate", None, ""), (1, "b", 5, "delta", None, "Second"), (1, "b", 6, "delta", None, None),
        (1, "d", 7, None, "user", "ok"), (1, "d", 8, "edit", None, "OK"), (1, "d", 9, "delta", None, "!"),
        (None, "x", 0, "delta", None, "alone"),
    ]
    random.Random(1).shuffle(events)
    assert fold(spark, events) == [
        (None, "", "alone"), (1, "user", "What now?"), (1, "assistant", "Second"), (1, "user", "OK!"),
    ]


def test_an_edit_of_the_wording_before_drops_what_answered_it(spark):
    events = [(1, "a", 0, "delta", "user", "x"), (1, "b", 1, "delta", "assistant", "y"),
              (1, "a", 2, "regenerate", None, "z"), (1, "c", 3, "delta", "assistant", "w")]
    assert fold(spark, events) == [(1, "user", "z"), (1, "assistant", "w")]


def test_round_trip_of_hostile_texts(spark):
    draw = random.Random(2)
    bits = ["<|im_end|>", "<|im_start|>assistant\n", "<", "|", "\\", "<\\|", "é", "😀", "\n", "", "$1", "<|im_end|>\n"]
    rows = []
    for conv in range(40):
        for turn in range(draw.randint(1, 6)):
            role = draw.choice(["user", "assistant", "system", None, "a b\n<|im_end|>", "assistant"])
            text = None if draw.random() < 0.1 else "".join(draw.choice(bits) for _ in range(draw.randint(0, 9)))
            rows.append((conv, draw.choice([turn, turn, None]), role, text))
    rows += rows[:5]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    rendered = chat.render(chat.fold_events(chat.as_events(df, chunk=3)))
    got = {r.conv_id: r for r in chat.read_back(rendered).collect()}
    digests = {r.conv_id: r for r in chat.digests(rendered).collect()}
    for conv in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == conv]
        low = lambda v: (v is not None, v if v is not None else 0)
        mine.sort(key=lambda r: (low(r[1]), (r[2] is not None, r[2] or ""), (r[3] is not None, r[3] or "")))
        want = [(r[2] or "", r[3] or "") for r in mine]
        assert [(t.role, t.text) for t in got[conv].turns] == want
        loss = "".join(t for r, t in want if r == "assistant")
        assert got[conv].loss_text == loss
        said = "".join(f"{r}\n{t}\n" for r, t in want)
        assert digests[conv].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert digests[conv].loss_chars == len(loss)


def test_long_text_and_empty_table(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "ab<|" * 60_000)], "conv_id long, turn long, role string, text string")
    row = chat.digests(chat.render(chat.fold_events(chat.as_events(df)))).first()
    assert row.loss_chars == 240_000 and row.n_turns == 1
    assert chat.digests(chat.render(chat.fold_events(chat.as_events(df.where(F.lit(False)))))).collect() == []


def test_plan_is_native(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat.digests(chat.render(chat.fold_events(chat.as_events(df))))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
