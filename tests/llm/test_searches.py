"""Searches for many needles, and how much text is hashed at once."""

import numpy as np
import pyarrow as pa

from skuloom.llm import collinear_chains, suffixes


def test_upper_bounds_are_searched_for_needles_that_occur(monkeypatch):
    text = "abracadabra" * 3
    needles = ["a", "abra", "abracadabraa", "z", "ra", "rab", "c", "dd", "bra"]
    symbols = np.array([ord(c) for c in text] + [0] * 16, np.uint32)
    array = suffixes.suffix_array(symbols, 0, len(text), 16)
    flat, need = np.array([ord(c) for c in "".join(needles)], np.uint32), np.array([len(x) for x in needles])
    asked, bound = [], suffixes._bound
    monkeypatch.setattr(suffixes, "_bound", lambda *a: asked.append(len(a[3])) or bound(*a))
    low, high = suffixes.search(array, symbols, flat, np.cumsum(need) - need, need)
    found = {x: sorted(array[a:b].tolist()) for x, a, b in zip(needles, low, high, strict=True)}
    assert found == {x: [i for i in range(len(text)) if text.startswith(x, i)] for x in needles}
    assert asked == [len(needles), sum(x in text for x in needles)]


def test_passages_hash_a_megabyte_at_once(monkeypatch):
    seen, hashes = [], collinear_chains.word_hashes
    monkeypatch.setattr(collinear_chains, "word_hashes", lambda data, offsets: seen.append(len(data)) or hashes(data, offsets))
    texts = pa.array([" ".join(f"w{(i * 7919 + k) % 5003}" for k in range(20_000)) for i in range(40)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), texts], ["id", "text"])
    for step in (collinear_chains._seeds, collinear_chains._run_keys, collinear_chains._word_blocks):
        assert sum(b.num_rows for b in step(iter([batch]))) and max(seen) <= 1 << 20


def test_search_begins_at_the_first_two_symbols(monkeypatch):
    rng = np.random.default_rng(5)
    symbols = np.concatenate([rng.integers(0, 4, 300), np.zeros(8, np.int64)]).astype(np.uint32)
    array = suffixes.suffix_array(symbols, 0, 300, 8)
    need = rng.integers(1, 8, 200)
    flat = rng.integers(0, 5, int(need.sum())).astype(np.uint32)
    place = np.cumsum(need) - need
    narrow = suffixes.search(array, symbols, flat, place, need)
    begin, end = suffixes._begun(array, symbols, flat, place, need)
    assert (end - begin).max() < 200 and (end - begin)[need > 1].max() < 60
    wide = suffixes.search(array, symbols.astype(np.uint64), flat.astype(np.uint64), place, need)  # no pairs are packed
    for a, b in zip(narrow, wide, strict=True):
        assert np.array_equal(a[narrow[1] > narrow[0]], b[wide[1] > wide[0]])
    assert np.array_equal(narrow[1] - narrow[0], wide[1] - wide[0])
