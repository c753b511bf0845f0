"""Words of whole texts as hashes: A-Z lower-cased, words `[^\\x20\\x09-\\x0D]+`."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash


def hash_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words one text after another, and the number of words of each text. No text is null."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = lists.flatten().dictionary_encode()
    words, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    counts = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    if "" in words:  # what stands before leading and after trailing white space
        keep = codes != words.index("")
        counts = np.bincount(np.repeat(np.arange(len(counts)), counts)[keep], minlength=len(counts))
        codes = codes[keep]
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))[codes], counts


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: nearby values become unrelated."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, width: int = 5) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct word shingles; with fewer words, of the whole sequence."""
    hashes, counts = hash_words(texts)
    ends = np.cumsum(counts)
    with np.errstate(over="ignore"):
        rolled = hashes[: max(0, len(hashes) - width + 1)].copy()
        for j in range(1, width):
            rolled = mix(rolled) + hashes[j : j + len(rolled)]
        rolled = mix(rolled)
    out = []
    for end, n in zip(ends.tolist(), counts.tolist()):
        if n >= width:
            out.append(np.unique(rolled[end - n : end - width + 1]))
        elif n:
            with np.errstate(over="ignore"):
                whole = np.uint64(n)
                for h in hashes[end - n : end]:
                    whole = mix(whole) + h
            out.append(np.array([mix(whole)], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
