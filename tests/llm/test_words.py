import random
import tracemalloc

import numpy as np
import pyarrow as pa

from flowward.llm import words as W
from llm.helpers import ALPHANUMERIC, SPACED, lower

ALPHABET = "ab Zé\n\t\x0b日-_9\x85\x1c|🙂"


def texts(n=400, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 50))) for _ in range(n)] + ["", None, "x" * 700_000 + " y"]


def test_words_are_those_of_the_pattern():
    column = texts()
    for table, pattern in ((W.SPACED, SPACED), (W.ALPHANUMERIC, ALPHANUMERIC)):
        for part in W.chunks(pa.array(column), limit=700):
            words = W.find_words(part, table)
            raw = part.data.tobytes()
            for row in range(part.last - part.first):
                a, b = words.bounds[row], words.bounds[row + 1]
                found = [raw[s:e].decode() for s, e in zip(words.starts[a:b], words.ends[a:b])]
                assert [lower(w) for w in found] == pattern.findall(lower(column[part.first + row]))


def test_equal_words_and_only_they_share_a_hash():
    seen = {}
    for part in W.chunks(pa.array(texts(3000, 2)), limit=5000):
        words = W.find_words(part, W.SPACED)
        raw = part.data.tobytes()
        for s, e, h in zip(words.starts, words.ends, W.word_hashes(part, words, lower=True)):
            assert seen.setdefault(int(h), lower(raw[s:e].decode())) == lower(raw[s:e].decode())
    assert len(set(seen.values())) == len(seen)


def test_windows_stay_inside_their_row():
    part = next(W.chunks(pa.array(["a b c", "", "d", "e f"])))
    words = W.find_words(part, W.SPACED)
    assert W.window_starts(words, 2).tolist() == [True, True, False, False, True, False]
    assert len(W.window_hashes(np.zeros(1, np.uint64), 2)) == 0


def test_sliced_and_empty_columns():
    column = pa.array(["a", "b c", None, "d"]).slice(1, 2)
    part = next(W.chunks(column))
    assert W.find_words(part, W.SPACED).counts.tolist() == [2, 0]
    assert list(W.chunks(pa.array([], pa.string()))) == []


def test_gathering_of_any_runs_takes_room_for_the_result_only():
    rng = np.random.default_rng(3)
    flat = rng.integers(0, 256, 1 << 20, dtype=np.uint8)
    counts = rng.integers(0, 9, 1_500_000)
    counts[[0, 7, -1]] = 0, 600_000, 0
    starts = rng.integers(0, len(flat) - 600_000, len(counts))
    tracemalloc.start()
    found = W.gather(flat, starts, counts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.tobytes() == b"".join(flat[s : s + n].tobytes() for s, n in zip(starts.tolist(), counts.tolist(), strict=True))
    assert peak < 64 << 20, peak  # two numbers a run and the result
    assert not len(W.gather(flat, starts[:0], counts[:0])) and not len(W.gather(flat, starts[:1], counts[:1]))
