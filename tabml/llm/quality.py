"""Quality rules: word and line counts, and repetition found with a suffix array of each text's words.

The suffix array is built for a slice of rows at once by prefix doubling (a rank is the place of a suffix among all
of the slice; only tied suffixes are ranked again). Words carry their row, so no repeat crosses rows. The ranks of
each doubling give the longest common prefix of suffix-array neighbours; the larger of a position's two values is
the longest substring that starts there and occurs again in the text. The union of these spans over ``MIN_REPEAT``
words gives the covered share, the largest value the longest repeat. Both have a limit of their own, below what the base rule lets pass.

Nulls: a null text has no word, so base_failed. Empty and one-word texts likewise. A text is one row of one task,
and its memory is a multiple of its own length (24 bytes a word and doubling). Repeated rows are judged each; an empty
table gives no rows; other columns are not read, so clashing names do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabml.llm import textnum as T

MIN_WORDS = 50
REPEAT_PCT = 50
#: A repeat counts from this many words on; shorter ones are ordinary phrases.
MIN_REPEAT = 8
#: Share of words under repeats, and words of the longest repeat against the text, above which a text is rejected. Both are far under
#: REPEAT_PCT, which bounds the covered share of any text that passes the base rule.
MAX_COVERED = 0.25
MAX_LONGEST = 0.1
#: A sentence of so many words said twice is ordinary in a text of any length (clean documents: 13 words at most).
ORDINARY = 16
SYMBOLS = b"#*$%&|<>"
SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "covered double, longest long, base_failed boolean, kept boolean")


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return c[bounds[1:]] - c[bounds[:-1]]


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs twice or more."""
    _, inv, n = np.unique(keys, return_inverse=True, return_counts=True)
    return n[inv] > 1


def suffix_ranks(ids: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Ranks by the first 1, 2, 4, ... words until all suffixes differ. ``end``: where each position's row ends."""
    n = len(ids)
    _, inv, count = np.unique(ids, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - count)[inv]
    levels, width = [rank], 1
    tied = np.flatnonzero(count[inv] > 1)
    while len(tied):
        nxt = tied + width
        second = np.where(nxt < end[tied], rank[np.minimum(nxt, n - 1)] + 1, 0)
        key = rank[tied] * (n + 2) + second
        order = np.argsort(key, kind="stable")
        k = key[order]
        new = np.r_[True, k[1:] != k[:-1]]
        group = np.r_[True, (k[1:] // (n + 2)) != (k[:-1] // (n + 2))]
        at = np.arange(len(k))
        first_equal = np.maximum.accumulate(np.where(new, at, 0))
        first_group = np.maximum.accumulate(np.where(group, at, 0))
        idx = tied[order]
        rank = rank.copy()
        rank[idx] += first_equal - first_group
        levels.append(rank)
        last = np.r_[new[1:], True]
        tied = np.sort(idx[~(new & last)])
        width *= 2
    return levels


def longest_repeats(ids: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each position the most words that start there and also start elsewhere in its row."""
    n = len(ids)
    if n < 2:
        return np.zeros(n, dtype=np.int64)
    levels = suffix_ranks(ids, end)
    order = np.empty(n, dtype=np.int64)
    order[levels[-1]] = np.arange(n)
    a, b = order[:-1], order[1:]
    lcp = np.zeros(n - 1, dtype=np.int64)
    for j in range(len(levels) - 1, -1, -1):
        pa_, pb = a + lcp, b + lcp
        ok = (pa_ < end[a]) & (pb < end[b])
        same = ok & (levels[j][np.minimum(pa_, n - 1)] == levels[j][np.minimum(pb, n - 1)])
        lcp[same] += 1 << j
    out = np.zeros(n, dtype=np.int64)
    out[b] = lcp
    out[a] = np.maximum(out[a], lcp)
    return out


def measure(w: T.Words) -> dict[str, np.ndarray]:
    rows = len(w.offsets) - 1
    h = w.hashes(lower=False)
    n_words = np.diff(w.first)
    lead = (w.data & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(lead, dtype=np.int64)])
    word_chars = row_sums(chars[w.end] - chars[w.start], w.first)
    n_symbols = row_sums(np.isin(w.data, np.frombuffer(SYMBOLS, np.uint8)), w.offsets)
    # lines: cut at \n and at row bounds; empty rows have no line with a word
    cut = np.unique(np.concatenate([w.offsets, np.flatnonzero(w.data == 10) + 1]))
    ls, le = cut[:-1], cut[1:]
    if len(ls):
        le = le - (w.data[le - 1] == 10)
    has = np.searchsorted(w.start, le) > np.searchsorted(w.start, ls)
    ls, le = ls[has], le[has]
    line_row = np.searchsorted(w.offsets, ls, side="right") - 1
    lk = T.mix(T.span_hash(T.prefix_sums(w.data), ls, le) + line_row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 1)
    _, once = np.unique(lk, return_index=True)
    n_dup_lines = np.bincount(line_row, minlength=rows) - np.bincount(line_row[once], minlength=rows)
    own = T.mix(h + w.row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 2)  # a word of a row
    end = w.first[1:][w.row]
    n = len(h)
    three = np.arange(n) + 3 <= end
    twice = np.zeros(n + 2, dtype=bool)
    if three.any():
        i = np.flatnonzero(three)
        k = T.mix(T.mix(own[i]) + T.mix(own[i + 1], 3) * np.uint64(3) + T.mix(own[i + 2], 4) * np.uint64(5))
        twice[i] = repeated(k)
    in_three = twice[:n].copy()
    in_three[1:] |= twice[: max(n - 1, 0)]
    in_three[2:] |= twice[: max(n - 2, 0)]
    n_repeat = row_sums(in_three, w.first)
    d = longest_repeats(own, end)
    long_ = d >= MIN_REPEAT
    edge = np.zeros(n + 1, dtype=np.int64)
    i = np.flatnonzero(long_)
    np.add.at(edge, i, 1)
    np.add.at(edge, i + d[i], -1)
    covered_words = row_sums(np.cumsum(edge)[:n] > 0, w.first)
    longest = np.zeros(rows, dtype=np.int64)
    np.maximum.at(longest, w.row, d)
    many = np.maximum(n_words, 1)
    covered = covered_words / many
    base_failed = (n_words < MIN_WORDS) | (100 * n_repeat > REPEAT_PCT * n_words)
    kept = (~base_failed & (covered_words <= np.maximum(MAX_COVERED * many, 2 * ORDINARY))
            & (longest <= np.maximum(MAX_LONGEST * many, ORDINARY)))
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines,
            "n_repeat_words": n_repeat, "covered": covered, "longest": longest, "base_failed": base_failed, "kept": kept}


def judge_quality(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with one column ``quality``, a struct of the counts and verdicts in ``SCHEMA``."""
    from tabml.llm.columns import add_struct

    def run(column: pa.Array) -> dict[str, np.ndarray]:
        got = [measure(w) for _, _, w in T.word_slices(column)]
        return {k: np.concatenate([g[k] for g in got]) if got else np.zeros(0) for k in
                ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered", "longest", "base_failed", "kept")}

    return add_struct(docs, text_col, "quality", SCHEMA, run)
