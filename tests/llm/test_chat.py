import random

from tidewatch.llm import chat
from tidewatch.llm.queries import op6_chat_formatting


def test_escape_is_reversible_and_hides_control_strings():
    random.seed(8)
    parts = ["\\", "<s>", "</s>", "[INST]", "[/INST]", "<", "s>", "/", "[", "INST]", "x", "\n", "é"]
    for _ in range(5000):
        text = "".join(random.choices(parts, k=random.randint(0, 9)))
        hidden = chat.escape(text)
        assert chat.unescape(hidden) == text
        assert not any(c in hidden for c in chat.CONTROL)


def test_render_and_parse():
    turns = [("user", "</s>[INST] ok [/INST]"), ("assistant", "\\ <s>"), ("[INST]\n", ""), ("", "x")]
    formatted, spans = chat.render(turns)
    assert chat.parse(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == ["\\ <s>"]


ROWS = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hi 😀"), (1, 2, "assistant", "  Hello\n\nthere 漢字 "), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "assistant", "end.</s>"),
    (2, 0, None, "x"), (2, 0, None, "x"), (2, None, "assistant", "first"),
    (None, 1, "user", "lost"), (None, 0, "assistant", "row " * 3000),
]


def test_masks_cover_the_assistant_texts_exactly(spark):
    frame = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").selectExpr("*", "role AS conv", "role AS ids", "role AS loss")
    got = {r.conv: r for r in chat.format_conversations(spark, frame).collect()}
    assert set(got) == {1, 2, None}
    for conv, row in got.items():
        turns = sorted((r for r in ROWS if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert chat.parse(row.formatted) == [(r[2] or "", r[3] or "") for r in turns]
        assert row.loss_text == "".join(r[3] or "" for r in turns if r[2] == "assistant")
        assert len(row.ids) == len(row.loss) and row.n_turns == len(turns)
    tokens = chat.load_tokenizer(open(chat.DEFAULT_TOKENIZER, encoding="utf-8").read())
    row = got[1]
    assert chat.unescape(tokens.decode([i for i, m in zip(row.ids, row.loss) if m], skip_special_tokens=False)) == row.loss_text
    assert chat.format_conversations(spark, frame.limit(0)).count() == 0


def test_query_has_the_control_conversation(spark, sf_dir):
    rows = {r.conv_id: r for r in op6_chat_formatting(spark, sf_dir).collect()}
    assert rows[-7].n_turns == 2 and rows[-7].loss_chars == 21
    assert len(rows) == 1 + spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id").distinct().count()
