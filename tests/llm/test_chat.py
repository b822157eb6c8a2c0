import hashlib
import random

from lockstep.llm import chat


def formatted(spark, rows):
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return {r["conv_id"]: r for r in chat.read_back(chat.masked_text(chat.format_conversations(turns))).collect()}


def digest(turns):
    return hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest()


def test_control_strings_survive(spark):
    alphabet = ["[INST]", "[/INST]", "</s>", "<s>", "\\", "[\\INST]", "<\\\\/s>", "a", " ", "\n", "é", "[", "<", "INST]", "s>", "$1", ""]
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "[INST]", "to\\ol"]), "".join(rng.choices(alphabet, k=rng.randint(0, 8))))
            for c in range(120) for t in range(rng.randint(1, 5))]
    out = formatted(spark, rows)
    assert len(out) == 120
    for c, row in out.items():
        own = [(r, x) for k, _, r, x in rows if k == c]
        said = "".join(x for r, x in own if r == "assistant")
        assert row["turns_sha256"] == digest(own) and row["n_turns"] == len(own)
        assert row["loss_chars"] == len(said) and row["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()


def test_only_conflicting_turns_are_escaped(spark):
    out = formatted(spark, [(1, 0, "user", "plain"), (1, 1, "assistant", "see </s>"), (2, 0, "user", "a \\ b [x]")])
    assert out[1]["formatted"] == "[INST]user[/INST]plain</s>[INST]assistant[/INST]see <\\/s></s>"
    assert out[1]["escaped_turns"] == 1 and out[2]["escaped_turns"] == 0
    mask = out[1]["loss_mask"]
    assert [out[1]["formatted"][m["start"]:m["end"]] for m in mask] == ["see <\\/s>"]


def test_order_nulls_ties_and_empty(spark):
    rows = [(1, 2, "user", "c"), (1, None, "user", "a"), (1, 1, "user", "z"), (1, 1, "user", "b"), (1, 1, "user", "b"),
            (2, 0, None, None), (None, 0, "assistant", "lost"), (3, 0, "user", "long " * 100_000)]
    out = formatted(spark, rows)
    assert out[1]["turns_sha256"] == digest([("user", x) for x in "abbzc"])
    assert out[2]["turns_sha256"] == digest([("", "")]) and out[2]["loss_chars"] == 0
    assert out[None]["loss_chars"] == 4
    assert formatted(spark, []) == {}
