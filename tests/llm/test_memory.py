"""What a Python worker still holds when a task has ended."""

import os
import re
from types import SimpleNamespace

import numpy as np
import pandas as pd
import public_tokenizers
import pytest

from quillspark.llm import token_files, toxicity

PATH = public_tokenizers.path("word_bpe_49k.json")
NO_LABELS = SimpleNamespace(value=(np.zeros(0, np.int64), np.zeros(0, np.int8)))


def held_mb():
    with open("/proc/self/smaps_rollup") as f:
        return int(re.search(r"\nPss_Anon:\s+(\d+)", f.read())[1]) / 1024


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="Linux's")
def test_free_memory_is_given_back():
    random = np.random.default_rng(1)

    def batches():
        for k in range(6):
            texts = [" ".join(f"w{x}" for x in random.integers(0, 50_000, 300)) for _ in range(700)]
            yield pd.DataFrame({"text": texts, "id": 0, "known": False, "label": k % 2})

    run = toxicity._counter(NO_LABELS)
    before = held_mb()
    assert sum(map(len, run(batches()))) > 1_000_000
    assert held_mb() - before < 40


def test_encoder_goes_with_other_tasks():
    one = pd.DataFrame({"doc_id": ["1"], "text": [b"some words"]})
    token_files._encoder.cache_clear()
    write = token_files._encoded(PATH, 2, 10)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(token_files, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
        blocks = [list(write(iter([one]))) for _ in range(2)]
    assert len(blocks[0]) == len(blocks[1]) == 1 and blocks[0][0].equals(blocks[1][0])
    assert token_files._encoder.cache_info().currsize == 1 and token_files._encoder.cache_info().misses == 1
    assert list(toxicity._counter(NO_LABELS)(iter([]))) == []
    assert token_files._encoder.cache_info().currsize == token_files._tokenizer.cache_info().currsize == 0
