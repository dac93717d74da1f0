"""Repetition rules from a suffix array of each text's words.

A text is a sequence of words. Its suffixes are sorted by prefix doubling (the order of words is that
of their hashes), where only suffixes that still equal another one are sorted again. Neighbours'
longest common prefixes bound the LCP intervals, each a right-maximal repeated substring with all its
places; a suffix's deepest interval is the longer of its two neighbour prefixes, so the union of the
spans of all intervals of `least` words or more is the union of those.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hashed_words, keep_rows, mixed, prefix_hash, span_hash, text_blocks

_U = np.uint64

#: Fixed by the base rules: symbols that count.
SYMBOLS = b"#*$%&|<>"

#: The method's limits, the pair that caught most texts with planted passages while it rejected at most
#: 0.5 % of the clean ones, both of even ids; the README has their figures on odd ids.
MAX_PERCENT, MAX_LONGEST_PERCENT = 15, 8


def repeats(words: np.ndarray, first: np.ndarray, least: int) -> np.ndarray:
    """For each word of the texts (text t has words[first[t]:first[t+1]]): how many words from there on stand elsewhere in the text too; 0 if fewer than `least`."""
    n = len(words)
    longest = np.zeros(n, dtype=np.int64)
    size = np.diff(first)
    if n == 0 or size.max() <= least:
        return longest
    text = np.repeat(np.arange(len(size)), size)
    end = np.repeat(first[1:], size)
    rank = np.empty(n, dtype=np.int64)  # where the suffix's group of equals begins in the suffix array
    active = np.lexsort((words, text))
    split = np.concatenate([[True], (words[active[1:]] != words[active[:-1]]) | (text[active[1:]] != text[active[:-1]])])
    old, h = np.zeros(n, dtype=np.int64), 1
    while True:
        begin = np.flatnonzero(split)
        count = np.diff(np.append(begin, len(active)))
        group_old = np.concatenate([[True], old[1:] != old[:-1]])
        base = np.flatnonzero(group_old)[np.cumsum(group_old) - 1]
        rank[active] = np.repeat(old[begin] + begin - base[begin], count)
        active = active[np.repeat(count > 1, count)]
        if not len(active):
            break
        behind = np.where(active + h < end[active], rank[np.minimum(active + h, n - 1)] + 1, 0)
        key = (rank[active].astype(np.uint64) << _U(32)) | behind.astype(np.uint64)
        order = np.argsort(key, kind="stable")
        active, key = active[order], key[order]
        split = np.concatenate([[True], key[1:] != key[:-1]])
        old = rank[active]
        h *= 2
    sa = np.empty(n, dtype=np.int64)
    sa[rank] = np.arange(n)
    prefix = prefix_hash(words)
    a, b = sa[:-1], sa[1:]
    near = np.flatnonzero((text[a] == text[b]) & (words[a] == words[b]) & (a + least <= end[a]) & (b + least <= end[b]))
    a, b = a[near], b[near]
    near = span_hash(prefix, a, a + least) == span_hash(prefix, b, b + least)
    a, b = a[near], b[near]
    common = np.zeros(len(a), dtype=np.int64)
    for step in [1 << k for k in range(int(size.max()).bit_length(), -1, -1)]:
        more = common + step
        fits = (a + more <= end[a]) & (b + more <= end[b])
        i = np.flatnonzero(fits)
        same = span_hash(prefix, a[i], a[i] + more[i]) == span_hash(prefix, b[i], b[i] + more[i])
        common[i[same]] = more[i[same]]
    np.maximum.at(longest, a, common)
    np.maximum.at(longest, b, common)
    longest[longest < least] = 0
    return longest


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


def _rules(least: int, max_percent: int, max_longest: int, min_words: int, base_percent: int, max_longest_percent: int):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "repeat_chars", "longest_repeat"]
    schema = pa.schema([("_row", pa.int64()), *((n, pa.int64()) for n in names), ("base_failed", pa.bool_()), ("kept", pa.bool_())])
    is_symbol = np.zeros(256, dtype=np.int64)
    is_symbol[list(SYMBOLS)] = 1

    def run(batches):
        for batch in batches:
            for (rows,), texts in text_blocks(batch, ["_row"]):
                words, first, raw, s, e = hashed_words(texts)
                n_words = np.diff(first)
                points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                word_chars = points[e] - points[s]
                bounds = np.concatenate([[0], np.cumsum([len(t or b"") + 1 for t in texts])])
                symbols = _sums(is_symbol[raw], np.minimum(bounds, len(raw)))
                dup_lines = []
                for t in texts:
                    seen, again = set(), 0
                    for line in (t or b"").split(b"\n"):
                        if line in seen:
                            again += 1
                        elif line.strip():
                            seen.add(line)
                    dup_lines.append(again)
                longest = repeats(words, first, least)
                at = np.flatnonzero(longest)
                change = np.bincount(at, minlength=len(words) + 1) - np.bincount(at + longest[at], minlength=len(words) + 1)
                covered = np.cumsum(change[:-1]) > 0
                repeated, repeat_chars, chars = _sums(covered, first), _sums(np.where(covered, word_chars, 0), first), _sums(word_chars, first)
                top = np.zeros(len(texts), dtype=np.int64)
                np.maximum.at(top, np.repeat(np.arange(len(texts)), n_words), longest)
                failed = (n_words < min_words) | (100 * repeated > base_percent * n_words)
                kept = ~failed & (100 * repeat_chars <= max_percent * chars) & (top <= max_longest) & (100 * top <= max_longest_percent * n_words)
                columns = [n_words, chars, symbols, np.array(dup_lines), repeated, repeat_chars, top]
                yield pa.record_batch([rows, *(pa.array(c, pa.int64()) for c in columns), pa.array(failed), pa.array(kept)], schema=schema)

    return run


OUT = "_row long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, repeat_chars long, longest_repeat long, base_failed boolean, kept boolean"


def judged(docs: DataFrame, least: int = 8, max_percent: int = MAX_PERCENT, max_longest: int = 100, min_words: int = 20, base_percent: int = 30, max_longest_percent: int = MAX_LONGEST_PERCENT) -> DataFrame:
    """One row per row of `docs` (doc_id, text), in one pass without a shuffle: doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, repeat_chars (characters of the repeated words), longest_repeat (words), base_failed, kept.

    Words are [^\\x20\\x09-\\x0D]+. The base rules fail a text of fewer than `min_words` words, or with over
    `base_percent` % of its words in repeats of `least` words or more. The method keeps the others whose
    repeats cover at most `max_percent` % of the word characters and are at most `max_longest` words and
    `max_longest_percent` % of the text's words long.
    Null, empty and blank texts: no words, base_failed. Repeated rows: each is judged. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("_row"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_rules(least, max_percent, max_longest, min_words, base_percent, max_longest_percent), OUT).withColumnRenamed("_row", "doc_id")


def passing(docs: DataFrame, least: int = 8, max_percent: int = MAX_PERCENT, max_longest: int = 100, min_words: int = 20, base_percent: int = 30, max_longest_percent: int = MAX_LONGEST_PERCENT) -> DataFrame:
    """The rows of `docs` that judged() keeps, with all their columns."""
    return keep_rows(docs, _rules(least, max_percent, max_longest, min_words, base_percent, max_longest_percent))
