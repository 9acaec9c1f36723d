import random
import re

import pytest

from marketmap.llm import components, near_dedup
from tests.llm.conftest import ODD


def sets_of(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def brute(rows, k, percent=80):
    sets = [(i, sets_of(t, k)) for i, t in rows]
    label = {i: i for i, _ in rows}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((root(i), root(j)))
                label[q] = p
    return {i: (len(s), root(i)) for i, s in sets}


def corpus(seed, groups, copies, edits):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(groups):
        base = [rng.choice(vocab) for _ in range(60)]
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((n, " ".join(w).title() if rng.random() < 0.3 else " ".join(w)))
            n += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("words,groups,copies,edits", [(2, 6, 5, 6), (2, 2, 40, 7), (5, 2, 30, 3)])
def test_components_equal_brute_force(docs_of, monkeypatch, words, groups, copies, edits):
    monkeypatch.setattr(near_dedup, "GROUP_BLOCK", 8)
    rows = corpus(words * 100 + copies, groups, copies, edits) + [(1000, None), (1001, ""), (1002, "solo"), (1003, "SOLO")]
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs_of(rows), words).collect()}
    assert out == brute(rows, words)


def test_odd_rows(docs_of):
    out = near_dedup.near_duplicates(docs_of(ODD), 2).collect()
    assert len(out) == len(ODD)
    by = {(r["doc_id"], r["component_id"], r["kept"]) for r in out}
    assert {(1, 1, True), (2, 2, True), (3, 3, True), (6, 6, True), (7, 6, False)} <= by


def test_empty_table(docs_of):
    assert near_dedup.near_duplicates(docs_of([])).count() == 0


def test_words_split_at_ascii_space_in_long_texts():
    text = "a b Cd\x0bE\x1cf " + "x" * 50 + " y"
    h = near_dedup.word_hashes(text)
    assert len(h) == len(re.findall(r"[^\x20\x09-\x0D]+", text))
    long = "ab cd " * 400000
    h = near_dedup.word_hashes(long)
    assert len(h) == 800000 and len(set(h.tolist())) == 2


def test_pruning_keeps_pairs_at_the_threshold():
    least = near_dedup.least_matches(80)
    assert least == sorted(least) and all(m < 0.8 * n for m, n in zip(least, range(40, 201, 40)))


def test_components_of_chains_cycles_and_lone_nodes(spark):
    links = [(i + 1, i) for i in range(10, 90)] + [(200, 201), (201, 202), (202, 200), (200, 201), (300, 300)]
    random.Random(7).shuffle(links)
    found = components.connected_components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()
    assert sorted(map(tuple, found)) == [*((i, 10) for i in range(10, 91)), (200, 200), (201, 200), (202, 200), (300, 300)]
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
