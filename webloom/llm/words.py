"""Words of many texts at once, as arrays of hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BREAK = r"[^\p{L}\p{N}]+"


def word_lists(texts: list[str | None] | pa.Array, accents: bool = True) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words (longest runs of letters and digits, lower-cased) one after the other, and each text's number of them; a null text has none."""
    low = pc.utf8_lower(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string()))
    if not accents:
        low = pc.replace_substring_regex(pc.utf8_normalize(low, form="NFD"), pattern=r"\p{Mn}+", replacement="")
    lists = pc.split_pattern_regex(pc.fill_null(low, ""), BREAK)
    flat = lists.flatten()
    real = pc.not_equal(flat, "")
    owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())[real.to_numpy(zero_copy_only=False)]
    return flat.filter(real).dictionary_encode(), np.bincount(owner, minlength=len(lists))


def word_hashes(texts: list[str | None] | pa.Array, accents: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """As word_lists, each word as its 64-bit hash."""
    words, counts = word_lists(texts, accents)
    table = np.array([xxhash.xxh3_64_intdigest(w) for w in words.dictionary.to_pylist()], np.uint64)
    return (table[words.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)), counts


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within each text, one after the other, and each text's number of them."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(len(counts), np.int64)
    h = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[j : n - k + 1 + j])
    ends = np.cumsum(counts)
    owner = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(n - k + 1) + k <= ends[owner[: n - k + 1]]
    return h[inside], np.maximum(counts - k + 1, 0)
