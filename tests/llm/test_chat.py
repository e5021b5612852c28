import hashlib

from hypothesis import given
from hypothesis import strategies as st

from quernstone.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, seq string, loss int"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)


@given(st.text(alphabet="<|\\im_startend>a\n", max_size=40))
def test_escape_round_trip(text):
    assert chat.unescape(chat.escape(text)) == text
    assert "<|" not in chat.escape(text)
    assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


def test_read_back(spark):
    rows = [(1, 0, "system", "be <|im_end|>"), (1, 1, "user", "hé\n<\\|"), (1, 2, "assistant", "😀 ok"), (1, 3, "assistant", "twice"), (2, 1, "assistant", None), (2, None, "user", "first"), (3, 0, None, ""), (None, 0, "user", "x"), (2, 1, "assistant", None)]
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(turns(spark, rows))).collect()}

    def sha(parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    assert got[1].n_turns == 4 and got[1].turns_sha256 == sha(f"{r}\n{t}\n" for _, _, r, t in rows[:4])
    assert (got[1].loss_chars, got[1].loss_sha256, got[1].valid) == (9, sha(["😀 ok", "twice"]), False)
    assert got[2].turns_sha256 == sha(["user\nfirst\n", "assistant\n\n", "assistant\n\n"]) and not got[2].valid
    assert got[None].n_turns == 1 and got[None].valid and got[3].n_turns == 1
    assert chat.format_conversations(turns(spark, [])).collect() == []


def test_segments_carry_loss_flags(spark):
    seg = chat.format_conversations(turns(spark, [(1, 0, "user", "q"), (1, 1, "assistant", "a")])).collect()
    assert "".join(s.text for s in seg) == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n"
    assert [s.text for s in seg if s.loss] == ["a"]
    assert [s.seq for s in seg] == [0, 1, 2, 3, 4, 5]


def test_machine():
    m = chat.Machine()
    assert m.allows("", "system") and m.allows("tool", "tool") and not m.allows("user", "user") and not m.allows("nobody", "user")
