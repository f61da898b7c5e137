import random

import pyarrow as pa
from llm_cases import ODD_TEXTS
from tokenizers import Tokenizer

from corpuskiln.llm.tokenizer_files import tokenizer_path
from corpuskiln.llm.wordbpe import batch_ids, slices

PATH = tokenizer_path()
LIBRARY = Tokenizer.from_file(PATH)
PARTS = "abÀéß÷×ªµ .,!*_-'s<|>\0\x1c\x85\xa09²ΣİKå|)]}/+=̊"
SPECIAL = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|endoftext|>...", "x<|startoftext|>y.", "don't stop.-_ a_b A.B", "\0 a \0", "..."]


def check(texts):
    ids, n = batch_ids(PATH, pa.array(texts, pa.string()))
    at = 0
    for text, size in zip(texts, n.tolist(), strict=True):
        assert ids[at : at + size].tolist() == LIBRARY.encode(text or "", add_special_tokens=False).ids, text
        at += size
    assert at == len(ids)


def test_ids_of_batches_equal_the_library():
    rnd = random.Random(2)
    check(["".join(rnd.choice(PARTS) for _ in range(30)) for _ in range(3000)] + SPECIAL + ODD_TEXTS)
    for texts in ([], [None], ["", ""], ["..."], ["word"], ["<|x"]):
        check(texts)


def test_sliced_arrays_and_row_ranges():
    texts = [f"text number {k}, with words. " * (k % 5) for k in range(100)]
    whole = pa.array([*texts, None], pa.string())
    ids, n = batch_ids(PATH, whole.slice(10, 20))
    want = [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts[10:30]]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])
    ranges = list(slices(whole))
    assert ranges[0][0] == 0 and ranges[-1][1] == 101 and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:]))
