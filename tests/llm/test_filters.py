"""The filters of the passage search stay packed in a worker."""

import pickle
import tracemalloc

import numpy as np
from pyspark import cloudpickle

from spendlens.llm import decontaminate


def test_filters_stay_packed():
    rng = np.random.default_rng(2)
    words = ["".join(map(chr, rng.integers(97, 123, 6))) for _ in range(2000)]
    texts = [" ".join(rng.choice(words, 200)) for _ in range(50)]
    find = pickle.loads(cloudpickle.dumps(decontaminate._finder([(k, t[:90]) for k, t in enumerate(texts[:20])], 0.2, 4, 0.95)))
    decontaminate.once_per_process("symbols", decontaminate._symbols)
    tracemalloc.start()
    try:
        found = find(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert [k in x for k, x in enumerate(found[:20])] == [True] * 20
    assert peak < 32e6
