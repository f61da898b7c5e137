"""Parameters of the corpus jobs. The defaults are fixed values of the workload."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CleaningConfig:
    """Thresholds of the heuristic filter."""

    line_max: float = 1000
    line_mean: float = 100
    alpha_frac: float = 0.25
    min_token_ratio: float = 1.5
    filter_proba: float = 0.7
    scan_width: int = 5
    keyword_coeff: float = 0.05
    min_assignments: int = 4
    seed: int = 1


@dataclass(frozen=True)
class NearDupConfig:
    """MinHash and Jaccard settings of near-duplicate removal."""

    jaccard_threshold: float = 0.85
    num_perm: int = 256
    min_tokens: int = 10
    # rows of one bucket, cluster or group of copies that may share a task
    hot_rows: int = 1_000_000
    # ids per star centre; bounds the degree of a vertex in the candidate graph
    chunk: int = 65_536
    # undecided members of a cluster compared with each other in the first round, and at most in a later one
    pivots: int = 16
    max_pivots: int = 1024


@dataclass(frozen=True)
class PackingConfig:
    seq_length: int = 1024
    separator: str = "<|endoftext|>"
    max_doc_tokens: int | None = None
    # a buffer takes documents until it holds the text of about so many sequences
    buffer_sequences: int = 1024
    chars_per_token: float = 3.6


@dataclass(frozen=True)
class GenerationConfig:
    n_samples: int = 5
    batch_size: int = 5
    num_tasks: int | None = None
    prompt_tokens: int = 512
    # fixed values: where a generated function body ends
    stop_strings: tuple[str, ...] = ("\nclass", "\ndef", "\n#", "\n@", "\nprint", "\nif")


CLONE_THRESHOLD_LINES = 6
SPLIT_TEST_FRACTION = 0.2
SPLIT_SEED = 1
TRAIN_SHUFFLE_SEED = 1
EVAL_SHUFFLE_SEED = 42
SHUFFLE_BUFFER = 1000
SAMPLES_PER_FILE = 100_000
