import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from acrely.llm import chat_format

PIECES = st.text(alphabet=st.sampled_from(list("ab\\<>/:0 \n")) | st.characters(codec="utf-8"), max_size=20)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a<b\\", ""]), PIECES), max_size=5))
def test_round_trip(turns):
    flat = chat_format.Flattener()
    for role, text in turns:
        flat.visit_turn(role, [{"kind": "text", "text": text}])
    row = flat.row(1)
    assert [(r, "".join(x for _, x in parts)) for r, parts in chat_format.read_back(row["formatted"])] == turns
    learnt = "".join(chat_format.unescape(row["formatted"][s["first"]:s["end"]]) for s in row["loss"])
    assert learnt == "".join(t for r, t in turns if r == "assistant")


def test_attachments(spark):
    part = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
    rows = [
        (5, 1, "user", [("text", "see <image:0>", None, None, None, None, None), ("image", None, "s3/x.png", 57, 28, None, None),
                        ("audio", None, "y.wav", None, None, 2.0, None)]),
        (5, 0, "system", []), (5, 2, "assistant", [("text", "a b", None, None, None, None, None), ("document", None, "z", None, None, None, 3)]),
        (6, None, None, None)]
    turns = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{part}>")
    out = {r.conv_id: r for r in chat_format.format_chats(turns).collect()}
    assert out[5].formatted == (
        "<turn>system<body></turn><turn>user<body>see \\<image:0><image:0><audio:1></turn><turn>assistant<body>a b<document:2></turn>")
    assert [(a.placeholder, a.ref, a.turn, a.tokens) for a in out[5].attachments] == [
        ("<image:0>", "s3/x.png", 1, 3), ("<audio:1>", "y.wav", 1, 50), ("<document:2>", "z", 2, 3000)]
    assert out[5].tokens == 2 + 3 + 50 + 2 + 3000
    assert [out[5].formatted[s.first:s.end] for s in out[5].loss] == ["a b"]
    assert list(chat_format.read_back(out[5].formatted))[1] == ("user", [("text", "see <image:0>"), ("image", "0"), ("audio", "1")])
    assert out[6].formatted == "<turn><body></turn>"


def test_unknown_kind_is_refused():
    with pytest.raises(ValueError, match="video"):
        chat_format.Flattener().visit_turn("user", [{"kind": "video"}])


def test_odd_turns(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, 0, "assistant", "x"), (None, None, None, None), (2, 0, "assistant", None)]
    rows += [(3, i, "assistant", "long " * 2000) for i in range(40)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    out = chat_format.digests(chat_format.format_chats(turns.withColumn("parts", chat_format.text_part(F.col("text"))))).collect()
    assert sorted((r.conv_id or 0, r.n_turns, r.loss_chars) for r in out) == [(0, 2, 1), (1, 3, 0), (2, 1, 0), (3, 40, 400_000)]
    assert chat_format.format_chats(turns.limit(0).withColumn("parts", chat_format.text_part(F.col("text")))).count() == 0


def test_null_parts_and_ids_of_any_type(spark):
    part = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
    text = lambda t: ("text", t, None, None, None, None, None)
    rows = [("b/1", 0, "user", [None, text("x"), (None, "lost", None, None, None, None, None)]), ("a", 0, "assistant", [text("y"), None]), (None, 0, "user", None)]
    turns = spark.createDataFrame(rows, f"conv_id string, turn long, role string, parts array<{part}>")
    out = {r.conv_id: r.formatted for r in chat_format.format_chats(turns).collect()}
    assert out == {"b/1": "<turn>user<body>x</turn>", "a": "<turn>assistant<body>y</turn>", None: "<turn>user<body></turn>"}
    assert dict(chat_format.format_turns(turns).dtypes)["conv_id"] == "string"
    assert {r.conv_id for r in chat_format.digests(chat_format.format_turns(turns)).collect()} == set(out)


def test_turns_are_the_pieces_of_the_whole(spark):
    rng, part = random.Random(5), "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
    kinds = [lambda: ("text", rng.choice(["a <b> \\", "", None, "é"]), None, None, None, None, None), lambda: ("image", None, "r", 30, 30, None, None),
             lambda: ("audio", None, "s", None, None, 1.5, None)]
    rows = [(c, t, rng.choice(["user", "assistant"]), [rng.choice(kinds)() for _ in range(rng.randint(0, 4))]) for c in range(20) for t in range(rng.randint(1, 9))]
    turns = spark.createDataFrame(rows, f"conv_id int, turn long, role string, parts array<{part}>")
    whole = {r.conv_id: r for r in chat_format.format_chats(turns).collect()}
    pieces = {}
    for r in chat_format.format_turns(turns).orderBy("conv_id", "place").collect():
        pieces.setdefault(r.conv_id, []).append(r)
    for c, rows_ in pieces.items():
        assert "".join(r.piece for r in rows_) == whole[c].formatted and [r.place for r in rows_] == list(range(whole[c].n_turns))
        assert [s for r in rows_ for s in r.loss] == whole[c].loss and [a for r in rows_ for a in r.attachments] == whole[c].attachments
        assert sum(r.tokens for r in rows_) == whole[c].tokens and all(whole[c].formatted[r.start:].startswith(r.piece) for r in rows_)
    both = [sorted(chat_format.digests(f(turns)).collect()) for f in (chat_format.format_chats, chat_format.format_turns)]
    assert both[0] == both[1] and len(both[0]) == 20


def test_a_long_conversation_is_never_one_string(spark, monkeypatch):
    monkeypatch.setattr(chat_format.Flattener, "row", None)
    turns = spark.range(3000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "repeat('word ', 400) AS text")
    out = chat_format.digests(chat_format.format_turns(turns.withColumn("parts", chat_format.text_part(F.col("text"))))).collect()
    assert [(r.n_turns, r.loss_chars) for r in out] == [(3000, 1500 * 2000)]


def test_tokens_of_a_public_vocabulary(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    count = chat_format.tokenizer_count(tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)
    assert count("hello world") == 2
