"""Where the vocabulary file of the tokenizer lies: a parameter, never a copy in this repository."""

from __future__ import annotations

import os

WORD_BPE = "word_bpe_49k.json"


def tokenizer_path(name: str = WORD_BPE) -> str:
    """The file in the folder that CORPUSKILN_TOKENIZERS names, else that of the installed package of public tokenizers."""
    folder = os.environ.get("CORPUSKILN_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
