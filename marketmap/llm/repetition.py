"""Quality rules by repetition inside a document: suffix array, longest-common-prefix intervals, spans.

The words of a text are numbered and their suffix array is built by prefix doubling (numpy, several texts at a
time: their numbers do not overlap, so no prefix is shared between texts). The rank arrays of the doublings
give the longest common prefix of neighbouring suffixes. Each LCP interval (a run of the suffix array that shares
a prefix, as long as possible) whose occurrences are preceded by different words is a maximal repeated substring. The
occurrences' spans are united: since an interval that is not maximal to the left lies inside longer spans, the union is
that of [p, p + longest prefix shared by suffix p). A document is dropped when the words covered by repeats of
LEAST words or more exceed SHARE percent, or when the longest repeat exceeds LONGEST words.

The base counts come from the same array: words in 3-word windows found twice are those covered by repeats of
three words or more.

Texts are read whole. Edge cases: null, empty and blank texts have no words (and fail for their number); ties and
repeated rows are judged one by one; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Words of a repeat that counts (more than a sentence or notice said twice), percent of words covered, words of the
#: longest repeat.
LEAST, SHARE, LONGEST = 20, 30, 100
#: Base rule: least number of words, percent of words in repeated windows of three words.
MIN_WORDS, WINDOW, WINDOW_SHARE = 50, 3, 50
#: Words whose suffixes are sorted together (a longer text alone).
GROUP_WORDS = 200_000
_SYMBOLS = b"#*$%&|<>"
_NO_CHAR = b" \t\n\x0b\x0c\r" + bytes(range(0x80, 0xC0))  # white space, and all but the first byte of a code point


def suffix_order(ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of ``ids``, and the ranks by the first 1, 2, 4, ... numbers (equal where these are equal)."""
    n = len(ids)
    order = np.argsort(ids)
    rank, active = _split(order, ids[order], np.zeros(n, np.int64), np.zeros(n, np.int64))
    levels, h = [rank.astype(np.int32)], 1
    while len(active):
        after = active + h
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        key = rank[active] * (n + 1) + second + 1
        o = np.argsort(key)
        active = active[o]
        rank, active = _split(active, key[o], rank, rank[active])
        levels.append(rank.astype(np.int32))
        h *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out, levels


def _split(members: np.ndarray, key: np.ndarray, rank: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New ranks of ``members`` (in order of ``key``; ``group``: where their present group starts), and those that still share
    theirs. A group's rank is the place where it starts."""
    if not len(members):
        return rank, members
    at = np.arange(len(members))
    first = np.concatenate(([True], key[1:] != key[:-1]))
    start = np.maximum.accumulate(np.where(first, at, 0))
    old = np.concatenate(([True], group[1:] != group[:-1]))
    old_start = np.maximum.accumulate(np.where(old, at, 0))
    rank = rank.copy()
    rank[members] = group + start - old_start
    alone = first & np.concatenate((first[1:], [True]))
    return rank, members[~alone]


def shared_prefixes(order: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """lcp[r]: numbers shared at the start by the suffixes of ranks r - 1 and r (lcp[0] = 0)."""
    n = len(order)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    at = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]]) + 1
    i, j, long = order[at - 1], order[at], np.zeros(len(at), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        a, b = i + long, j + long
        inside = np.maximum(a, b) < n
        same = inside & (levels[level][np.minimum(a, n - 1)] == levels[level][np.minimum(b, n - 1)])
        long += np.where(same, 1 << level, 0)
    lcp[at] = long
    return lcp


@dataclass(frozen=True)
class Repeat:
    """A maximal repeated substring: words ``starts[k]`` to ``starts[k] + length``."""

    length: int
    starts: tuple[int, ...]


def _intervals(lcp: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """LCP intervals (length, first rank, last rank) of ``least`` or more, by a stack over the ranks that reach it."""
    at = np.flatnonzero(lcp >= least).tolist()
    stack: list[tuple[int, int]] = []  # (length, first rank)
    for k, r in enumerate(at):
        value = int(lcp[r])
        first = r - 1
        while stack and stack[-1][0] > value:
            length, first = stack.pop()
            yield length, first, r - 1
        if not stack or stack[-1][0] < value:
            stack.append((value, first))
        if k + 1 == len(at) or at[k + 1] != r + 1:
            while stack:
                length, first = stack.pop()
                yield length, first, r


def maximal_intervals(ids: np.ndarray, order: np.ndarray, lcp: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """The LCP intervals whose occurrences do not all follow the same number."""
    before = np.where(order > 0, ids[order - 1], -1)
    changes = np.concatenate(([0], np.cumsum(before[1:] != before[:-1])))
    for length, a, b in _intervals(lcp, least):
        if changes[b] > changes[a]:
            yield length, a, b


def maximal_repeats(words: list, least: int = LEAST) -> list[Repeat]:
    """The maximal repeated substrings of ``least`` words or more."""
    ids = _numbers(words, 0)[0]
    order, levels = suffix_order(ids)
    lcp = shared_prefixes(order, levels)
    return [Repeat(length, tuple(sorted(order[a:b + 1].tolist())))
            for length, a, b in maximal_intervals(ids, order, lcp, least)]


def _numbers(words: list, base: int) -> tuple[np.ndarray, int]:
    """A number for each distinct word, from ``base`` on."""
    known: dict = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    return ids + base, base + len(known)


def _covered(longest: np.ndarray, least: int, edges: np.ndarray) -> np.ndarray:
    """Words of each text inside the united spans [p, p + longest[p]) of ``least`` or more."""
    n = len(longest)
    at = np.flatnonzero(longest >= least)
    change = np.bincount(at, minlength=n + 1) - np.bincount(at + longest[at], minlength=n + 1)
    inside = np.concatenate(([0], np.cumsum(np.cumsum(change[:n]) > 0)))
    return inside[edges[1:]] - inside[edges[:-1]]


def repetition_of(texts: list[list], least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each list of words: words in repeated windows, words covered by repeats, longest repeat, number of maximal
    repeats."""
    parts, base = [], 0
    for words in texts:
        ids, base = _numbers(words, base)
        parts.append(ids)
    edges = np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64)))
    none = np.zeros(len(texts), np.int64)
    if not edges[-1]:
        return none, none, none, none
    ids = np.concatenate(parts)
    order, levels = suffix_order(ids)
    lcp = shared_prefixes(order, levels)
    longest = np.empty(len(ids), np.int64)
    longest[order] = np.maximum(lcp, np.append(lcp[1:], 0))
    top = none.copy()
    text_of = np.repeat(np.arange(len(texts)), np.diff(edges))
    np.maximum.at(top, text_of, np.where(longest >= least, longest, 0))
    count = np.bincount([text_of[order[a]] for _, a, _ in maximal_intervals(ids, order, lcp, least)], minlength=len(texts))
    return _covered(longest, WINDOW, edges), _covered(longest, least, edges), top, count


def quality_by_repetition(docs: DataFrame, least: int = LEAST, share: int = SHARE, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, covered_words,
    longest_repeat, n_repeats of every document."""

    def judged(ids: list, raw: list[bytes]) -> pa.RecordBatch:
        words = [t.split() for t in raw]  # bytes split at the six ASCII white-space signs alone
        windows, covered, top, count = repetition_of(words, least)
        n = np.array([len(w) for w in words], np.int64)
        lines = [[x for x in t.split(b"\n") if x.strip()] for t in raw]
        failed = (n < MIN_WORDS) | (100 * windows > WINDOW_SHARE * n)
        kept = ~failed & (100 * covered <= share * n) & (top <= longest)
        cols = [pa.array(ids, pa.int64()), pa.array(n), pa.array([len(t.translate(None, _NO_CHAR)) for t in raw], pa.int64()),
                pa.array([len(t) - len(t.translate(None, _SYMBOLS)) for t in raw], pa.int64()),
                pa.array([len(x) - len(set(x)) for x in lines], pa.int64()), pa.array(windows.astype(np.int64)),
                pa.array(failed), pa.array(kept), pa.array(covered.astype(np.int64)), pa.array(top),
                pa.array(count.astype(np.int64))]
        return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raw, size = [], [], 0
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                ids.append(doc)
                raw.append(text or b"")
                size += len(raw[-1]) // 6
                if size >= GROUP_WORDS:
                    yield judged(ids, raw)
                    ids, raw, size = [], [], 0
            yield judged(ids, raw)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)


SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, covered_words long, longest_repeat long, n_repeats long")

# Repeats of k words or more cover what the k-word windows found twice cover, and one of more than LONGEST words is a
# window of LONGEST + 1 words found twice.
ORACLE_SQL = rf"""
with t as (select row_number() over () rid, doc_id, coalesce(text, '') text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') w from documents),
starts as (select rid, w, len(w) n, unnest(range(1, len(w) + 1)) i from t),
grams as (
  select rid, i, {WINDOW} k, hash(w[i:i + {WINDOW} - 1]) g from starts where i + {WINDOW} - 1 <= n union all
  select rid, i, {LEAST}, hash(w[i:i + {LEAST} - 1]) from starts where i + {LEAST} - 1 <= n union all
  select rid, i, {LONGEST} + 1, hash(w[i:i + {LONGEST}]) from starts where i + {LONGEST} <= n),
twice as (select rid, k, i from (select rid, k, i, count(*) over (partition by rid, k, g) c from grams) where c > 1),
spans as (select rid, k, i, lead(i) over (partition by rid, k order by i) nxt from twice),
covered as (select rid, k, sum(least(k, coalesce(nxt - i, k)))::bigint c from spans group by rid, k),
lines as (select rid, count(*) - count(distinct l) d from (select rid, unnest(string_split(text, chr(10))) l from t)
  where regexp_matches(l, '[^\x20\x09-\x0D]') group by rid),
f as (select t.doc_id, len(w) n, len(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) wc,
    len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) ns, coalesce(d, 0) dl, coalesce(a.c, 0) r3,
    coalesce(b.c, 0) cov, x.rid is not null too_long
  from t left join lines using (rid) left join covered a on a.rid = t.rid and a.k = {WINDOW}
  left join covered b on b.rid = t.rid and b.k = {LEAST}
  left join covered x on x.rid = t.rid and x.k = {LONGEST} + 1)
select doc_id, n::bigint as n_words, wc::bigint as word_chars, ns::bigint as n_symbols, dl::bigint as n_dup_lines,
  r3 as n_repeat_words, n < {MIN_WORDS} or 100 * r3 > {WINDOW_SHARE} * n as base_failed,
  not (n < {MIN_WORDS} or 100 * r3 > {WINDOW_SHARE} * n) and 100 * cov <= {SHARE} * n and not too_long as kept
from f"""
