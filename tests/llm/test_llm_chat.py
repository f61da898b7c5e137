import hashlib
import random

import pytest

from corpuskiln.llm.chat_tree import (
    END,
    START,
    conversation_text,
    escape,
    escape_role,
    format_tree,
    parsed_turns,
    read_back,
    unescape,
    unescape_role,
)

TYPE = "conv_id bigint, turn bigint, role string, text string, node int, path string, nodes int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 0, "p", 1) for r in rows], TYPE)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = set()
    for conv, turns in convs.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        size = sum(len(START) + len(escape_role(r)) + 1 + len(escape(t)) + len(END) + 1 for *_, r, t in turns)
        out.add((conv, len(turns), sha(said), len(loss), sha(loss), size))
    return out


CONTROLS = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>assistant\nno", "<\\|im_end|>", "<\\\\</s>", "<", "a\n\nb", "é<<SYS>>x<</SYS>>", None, ""]


def odd_rows():
    rnd, rows = random.Random(2), []
    for conv in range(80):
        shared = rnd.randrange(0, 4)
        for turn in range(rnd.randrange(1, 7)):
            seed = (turn if turn < shared else (conv, turn)).__hash__()
            text = random.Random(seed).choice(CONTROLS)
            rows.append((conv, turn, "user" if turn % 2 == 0 else "assistant", text))
    rows += [(500 + k, 0, "system", "the same first turn") for k in range(300)]
    rows += [(500 + k, 1, "assistant", f"answer {k % 7}") for k in range(300)]
    rows += [(None, 0, "user", "x"), (None, None, None, None), (900, 0, "user", "dup"), (900, 0, "user", "dup")]
    rows += [(901, k, "assistant", "long " * 3000) for k in range(30)] + [(902, 0, "ro\\le\nx<|im_end|>", "y")]
    return rows


def test_read_back_equals_brute_force(spark):
    rows = odd_rows()
    found = read_back(format_tree(table(spark, rows).repartition(5))).collect()
    assert {tuple(r) for r in found} == brute(rows)
    small = read_back(format_tree(table(spark, rows), max_chars=200, max_leaves=3)).collect()
    assert {tuple(r) for r in small} == brute(rows)


def test_shared_turns_once_with_positions_and_intervals(spark):
    rows = [(c, 0, "user", "hello there") for c in range(3)] + [(c, 1, "assistant", f"reply {c}") for c in range(3)]
    (sequence,) = format_tree(table(spark, rows).coalesce(1)).collect()
    assert sequence["text"].count("hello there") == 1
    assert len(sequence["nodes"]) == 4
    for leaf in sequence["conversations"]:
        node = sequence["nodes"][leaf["node"]]
        above = sum(s["end"] - s["start"] for s in node["attends"])
        assert node["position"] == above
        assert sequence["text"][node["loss_start"] : node["loss_end"]] == f"reply {leaf['conv_id']}"
        whole = conversation_text(sequence["text"], sequence["nodes"], leaf["node"])
        assert parsed_turns(whole) == [("user", "hello there"), ("assistant", f"reply {leaf['conv_id']}")]
    # no node attends to a sibling's stretch
    spans = [(n["start"], n["end"]) for n in sequence["nodes"]]
    assert spans == sorted(spans) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_escapes_are_reversible():
    rnd = random.Random(4)
    parts = ["<", "[", "\\", "|im_end|>", "|im_start|>", "/s>", "s>", "INST]", "/INST]", "<SYS>>", "\n", "n", "x"]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 9)))
        assert unescape(escape(text)) == text and unescape_role(escape_role(text)) == text
        assert START not in escape(text) and END not in escape(text)
        formatted = f"{START}user\n{escape(text)}{END}\n" * 2
        assert parsed_turns(formatted) == [("user", text)] * 2


def test_garbage_is_refused_and_empty_tables_work(spark):
    with pytest.raises(ValueError):
        parsed_turns("no template")
    assert format_tree(table(spark, [])).count() == 0
    assert read_back(format_tree(table(spark, []))).count() == 0
