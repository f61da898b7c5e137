"""Chat formatting with a prefix tree: turns that conversations share are emitted once.

Conversations are sorted by the digests of their turns over the whole cluster, so
those with the same beginning lie side by side. One pass over a sorted partition
walks the prefix tree depth-first: it goes back to the last turn in common and
emits what follows. A sequence is a stretch of this walk, of at most ``MAX_CHARS``
code points (more only for a single longer conversation) and ``MAX_LEAVES``
conversations; the next one starts with its shared turns again. A first turn that
a third of all conversations share is thus spread over many tasks and sequences.

A node is one turn: its place in the sequence, its parent, the position id of its
first code point (positions count along the path from the root), the intervals of
its ancestors that it may attend to (merged where they touch), and the stretch
under the loss mask (the text of an assistant turn).

Template: ``<|im_start|>`` role newline text ``<|im_end|>`` newline. A control string
inside a text gets one backslash after its first character, and one more if it has
some there already, so unescaping takes one away and no text is ambiguous.

Defined cases: a null text or role is empty. Rows of a conversation go by turn, then
role and text, nulls first; repeated rows are turns of their own. Rows with a null
conv_id form one conversation. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template, and control strings of common templates without their first character.
START, END = "<|im_start|>", "<|im_end|>"
CONTROL_TAILS = (
    r"\|im_start\|>",
    r"\|im_end\|>",
    r"\|startoftext\|>",
    r"\|endoftext\|>",
    "s>",
    "/s>",
    r"INST\]",
    r"/INST\]",
    "<SYS>>",
    "</SYS>>",
)
LOSS_ROLE = "assistant"
MAX_CHARS = 65_536
MAX_LEAVES = 2_048

CONTROL = r"([<\[])(\\*)(" + "|".join(CONTROL_TAILS) + ")"
_ESCAPE = re.compile(CONTROL)
_UNESCAPE = re.compile(r"([<\[])\\(\\*)(" + "|".join(CONTROL_TAILS) + ")")
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.S)

SPAN = "struct<start:bigint,end:bigint>"
SEQUENCE_TYPE = (
    "sequence_id bigint, text string, "
    f"nodes array<struct<start:bigint,end:bigint,parent:int,position:bigint,loss_start:bigint,loss_end:bigint,attends:array<{SPAN}>>>, "
    "conversations array<struct<conv_id:bigint,node:int>>"
)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def gathered(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns, path): the turns of each conversation in order, and the key that sorts shared beginnings together."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turn = F.struct(F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"))
    turns = conversations.groupBy(F.col("conv_id").cast("bigint").alias("conv_id")).agg(
        F.array_sort(F.collect_list(turn), _by_turn).alias("turns")
    )

    def key(t: Column) -> Column:
        return F.substring(F.md5(F.concat(F.octet_length(t["role"]).cast("string"), F.lit(":"), t["role"], t["text"])), 1, 16)

    return turns.withColumn("path", F.array_join(F.transform("turns", key), ""))


def _by_turn(a: Column, b: Column) -> Column:
    """Turn (null first), then role, then text."""
    order = F.lit(0)
    for name in ("text", "role", "turn"):
        x, y = a[name], b[name]
        order = (
            F.when(x.isNull() & y.isNotNull(), -1)
            .when(x.isNotNull() & y.isNull(), 1)
            .when(x < y, -1)
            .when(x > y, 1)
            .otherwise(order)
        )
    return order


class _Walk:
    """The sequence being written: its text, nodes, conversations, and the open path from the root."""

    def __init__(self):
        self.parts: list[str] = []
        self.length = 0
        self.nodes: list[dict] = []
        self.leaves: list[dict] = []
        self.path: list[tuple[tuple[str, str], int]] = []

    def shared(self, turns: list[tuple[str, str]]) -> int:
        n = 0
        while n < min(len(turns), len(self.path)) and self.path[n][0] == turns[n]:
            n += 1
        return n

    def add(self, conv_id, turns: list[tuple[str, str]]) -> None:
        del self.path[self.shared(turns) :]
        for role, text in turns[len(self.path) :]:
            head, body = f"{START}{escape_role(role)}\n", escape(text)
            start, parent = self.length, self.path[-1][1] if self.path else -1
            end = start + len(head) + len(body) + len(END) + 1
            above = self.nodes[parent] if self.path else None
            loss = start + len(head)
            self.nodes.append(
                {
                    "start": start,
                    "end": end,
                    "parent": parent,
                    "position": above["position"] + above["end"] - above["start"] if above else 0,
                    "loss_start": loss,
                    "loss_end": loss + (len(body) if role == LOSS_ROLE else 0),
                    "attends": _joined(above) if above else [],
                }
            )
            self.parts.append(f"{head}{body}{END}\n")
            self.length = end
            self.path.append(((role, text), len(self.nodes) - 1))
        self.leaves.append({"conv_id": conv_id, "node": self.path[-1][1]})


def _joined(above: dict) -> list[dict]:
    spans = above["attends"]
    if spans and spans[-1]["end"] == above["start"]:
        return [*spans[:-1], {"start": spans[-1]["start"], "end": above["end"]}]
    return [*spans, {"start": above["start"], "end": above["end"]}]


def _size(turns: list[tuple[str, str]]) -> int:
    return sum(len(role) + len(text) + len(START) + len(END) + 2 for role, text in turns)


def format_tree(
    conversations: DataFrame, max_chars: int = MAX_CHARS, max_leaves: int = MAX_LEAVES
) -> DataFrame:
    """Sequences (sequence_id, text, nodes, conversations) of all conversations."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first_id, written, walk = TaskContext.get().partitionId() << 32, 0, _Walk()

        def row() -> pd.DataFrame:
            columns = [[first_id + written], ["".join(walk.parts)], [walk.nodes], [walk.leaves]]
            return pd.DataFrame(dict(zip(("sequence_id", "text", "nodes", "conversations"), columns, strict=True)))

        for batch in batches:
            for conv_id, found in zip(batch["conv_id"], batch["turns"], strict=True):
                turns = [(t["role"], t["text"]) for t in found]
                fresh = _size(turns[walk.shared(turns) :])
                if walk.leaves and (walk.length + fresh > max_chars or len(walk.leaves) >= max_leaves):
                    yield row()
                    written, walk = written + 1, _Walk()
                walk.add(None if pd.isna(conv_id) else int(conv_id), turns)
        if walk.leaves:
            yield row()

    rows = gathered(conversations)
    ordered = rows.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    return ordered.select("conv_id", "turns").mapInPandas(run, SEQUENCE_TYPE)


def conversation_text(text: str, nodes, node: int) -> str:
    """A conversation's formatted text: what its last turn attends to, and that turn."""
    own = nodes[node]
    return "".join(text[s["start"] : s["end"]] for s in own["attends"]) + text[own["start"] : own["end"]]


def parsed_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn; anything outside the template is an error."""
    turns, at = [], 0
    for found in _TURN.finditer(formatted):
        if found.start() != at:
            break
        turns.append((unescape_role(found[1]), unescape(found[2])))
        at = found.end()
    if at != len(formatted):
        raise ValueError(f"not in the template at {at}")
    return turns


def loss_texts(text: str, nodes, node: int) -> list[str]:
    """The unescaped texts under the loss mask on the path to ``node``, in order."""
    found = []
    while node >= 0:
        own = nodes[node]
        if own["loss_end"] > own["loss_start"]:
            found.append(unescape(text[own["loss_start"] : own["loss_end"]]))
        node = own["parent"]
    return found[::-1]


def read_back(sequences: DataFrame) -> DataFrame:
    """Per conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read from the sequences."""
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for text, nodes, leaves in zip(batch["text"], batch["nodes"], batch["conversations"], strict=True):
                rows = []
                for leaf in leaves:
                    formatted = conversation_text(text, nodes, leaf["node"])
                    turns = parsed_turns(formatted)
                    said = "".join(f"{role}\n{body}\n" for role, body in turns)
                    loss = "".join(loss_texts(text, nodes, leaf["node"]))
                    rows.append((leaf["conv_id"], len(turns), _sha(said), len(loss), _sha(loss), len(formatted)))
                frame = pd.DataFrame(rows, columns=names)
                yield frame.astype({"conv_id": "Int64"})

    return sequences.mapInPandas(
        run,
        "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    )


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()
