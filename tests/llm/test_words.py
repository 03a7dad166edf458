import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rowloom.llm import fingerprints as fp
from rowloom.llm import near_dup as nd
from rowloom.llm.resharding import minimum_cost_flow
from rowloom.llm.words import shingles, windows, words_of

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB z9.é\n日", max_size=40)), max_size=12))
def test_words_as_by_regex(texts):
    w = words_of(pa.array(texts, pa.string()))
    lowered = [bytes(w.buffer[a:b]).lower() for a, b in zip(w.start, w.end, strict=True)]
    got = [lowered[a:b] for a, b in zip(w.first, w.first[1:], strict=False)]
    # ASCII only is lower-cased: bytes.lower() does the same
    assert got == [WORD.findall((t or "").encode().lower()) for t in texts]
    assert len(set(w.hash.tolist())) == len(set(lowered))
    _, at = windows(w, 3)
    assert len(at) == sum(max(0, len(g) - 2) for g in got)
    found, times, begin = shingles(w, 3)
    for i, g in enumerate(got):
        want = {tuple(g[j : j + 3]) for j in range(max(1, len(g) - 2))} if g else set()
        assert begin[i + 1] - begin[i] == len(want)
    assert len(found) == len(times) == begin[-1]


def test_words_longer_than_a_piece():
    w = words_of(pa.array(["a " + "x" * 3_000_000 + " b"], pa.string()))
    assert (w.end - w.start).tolist() == [1, 3_000_000, 1]


def test_darts_agree_as_often_as_the_weighted_jaccard_similarity():
    rng = np.random.default_rng(1)
    elements = rng.integers(1, 2**63, 120).astype(np.uint64)
    a, b = rng.integers(0, 6, 120).astype(float), rng.integers(0, 6, 120).astype(float)
    both = np.concatenate([elements, elements])
    found = nd.dart_signatures(both, np.concatenate([a, b]), np.array([0, 120, 240]), 2000)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((found[0] == found[1]).mean() - want) < 0.05
    assert (nd.dart_signatures(elements[:0], a[:0], np.array([0, 0]), 8) == 0).all()


def test_one_permutation_likeness():
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in rng.integers(0, 10**9, 1200)]
    other = words[:900] + [f"v{i}" for i in range(300)]
    a, b, empty, short = fp.fingerprints([" ".join(words), " ".join(other), "!?", "two words"])
    assert abs(fp.likeness(a, b) - 0.6) < 0.12
    assert fp.likeness(a, a) == 1.0 and fp.likeness(a, empty) == 0.0 and fp.likeness(empty, empty) == 1.0
    assert len(a) == len(short) == fp.BINS * fp.BITS // 8 and empty == b""


@pytest.mark.parametrize("seed", range(5))
def test_flow_costs_least(seed):
    rng = np.random.default_rng(seed)
    supply, cost = rng.integers(0, 50, 4).tolist(), rng.integers(0, 9, (4, 6)).astype(float)
    capacity = [sum(supply) // 6 + 1] * 6
    flow = minimum_cost_flow(supply, capacity, cost)
    assert flow.sum(1).tolist() == supply and (flow.sum(0) <= capacity).all() and (flow >= 0).all()
    # no cycle of the residual network lowers the cost
    n, m = flow.shape
    dist = np.zeros(n + m)
    for _ in range(n + m + 1):
        new = dist.copy()
        for i in range(n):
            for j in range(m):
                new[n + j] = min(new[n + j], dist[i] + cost[i, j])
                if flow[i, j] > 0:
                    new[i] = min(new[i], dist[n + j] - cost[i, j])
        if (new == dist).all():
            break
        dist = new
    else:
        pytest.fail("a cheaper flow exists")
