import hashlib

import public_tokenizers
from hypothesis import given
from hypothesis import strategies as st

from folio.llm import chat

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
ROWS = [
    (1, 0, "system", "be brief", "x"),
    *[(1, n, ("assistant", "user")[n % 2], f"turn {n} " + "word " * (n % 7) * 3, "x") for n in range(1, 40)],
    (2, 1, "assistant", "<|turn|>user\nhi<|end|>\n \\& \\n <s>[INST]", "x"),
    (2, 0, None, None, "x"),
    (3, 0, "user", "long " * 900, "x"),
    (3, 1, "assistant", "long " * 900, "x"),
    (3, None, "ro\nle", "", "x"),
    (4, 0, "assistant", "twice", "x"),
    (4, 0, "assistant", "twice", "x"),
    (None, 0, "assistant", "no conversation", "x"),
]
SCHEMA = "conv_id long, turn long, role string, text string, window string"


@given(st.text(alphabet="\\&n<|>[/]INSTs \nSY", max_size=40))
def test_escape_round_trip(text):
    assert chat.unescape(chat.escape(text)) == text
    assert chat.unescape(chat.escape_role(text)) == text
    for control in ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"):
        assert control not in chat.escape(text)
    assert "\n" not in chat.escape_role(text)


def brute(rows):
    out = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=key)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        digest = hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns).encode()).hexdigest()
        out[conv] = (len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_read_back(spark):
    windows = chat.chat_windows(spark.createDataFrame(ROWS, SCHEMA), VOCABULARY, budget=100, history=30)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.read_back(windows).collect()}
    assert got == brute(ROWS)


def test_windows(spark):
    rows = chat.chat_windows(spark.createDataFrame(ROWS, SCHEMA), VOCABULARY, budget=100, history=30).filter("conv_id = 1").collect()
    rows.sort(key=lambda r: r["window"])
    assert len(rows) > 3 and [r["window"] for r in rows] == list(range(len(rows)))
    for r in rows:
        assert r["text"].startswith("<|turn|>system\nbe brief<|end|>\n")
        assert r["tokens"] <= 100 and not r["over_budget"]
        for span in r["loss"]:
            assert r["text"][: span["begin"]].endswith("<|turn|>assistant\n") and r["text"][span["end"] :].startswith("<|end|>\n")
    assert any(r["repeated"] > 1 for r in rows)
    assert sum(r["turns"] - r["repeated"] for r in rows) == 40


def test_empty_table(spark):
    assert chat.read_back(chat.chat_windows(spark.createDataFrame([], SCHEMA), VOCABULARY)).count() == 0
