import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from marketmap.llm import packing, token_binary
from marketmap.llm.queries import tokenizer_path
from marketmap.llm.tokens import Encoder
from tests.llm.conftest import ODD

TRICKY = ["", " ", "  a  b", "a\n\nb", "a \n b", "it's\tok  x", "nb sp  x", "Ünï  cödé ß\r\nq",
          "<|endoftext|> hi", "don't \x1c x\x85y", "a | b|c", "é ́x", "x\n", "\nx", "a  ", "日本語 text"]


def ids_of(name, texts, end):
    t = Tokenizer.from_file(tokenizer_path(name))
    return [np.array(e.ids + end, "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name,space", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_cached_encoder_equals_the_library(name, space, monkeypatch):
    monkeypatch.setattr("marketmap.llm.tokens.CACHE_WORDS", 50)
    texts = TRICKY + ["the quick brown fox " * 5 + str(i) for i in range(50)] + TRICKY
    got = list(Encoder(tokenizer_path(name), space).encode(texts))
    assert got == [x.tobytes() for x in ids_of(name, texts, [])]


@pytest.mark.parametrize("name,space", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_added_tokens_are_the_librarys(name, space):
    t = Tokenizer.from_file(tokenizer_path(name))
    texts = TRICKY + ["a <|endoftext|> b", "x<|endoftext|>y", " <|endoftext|>", " a <|endoftext|>\n b  ", "<|startoftext|>",
                      "<|ENDOFTEXT|> A", "<|endoftext|><|endoftext|>", "a <| endoftext |> b"]
    got = list(Encoder(tokenizer_path(name), space).encode(texts))
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want


def test_documents_with_added_tokens(docs_of):
    rows = [(1, "a <|endoftext|> b"), (2, "next words"), (3, "<|startoftext|>x")]
    for name, end, out in (
            ("word_bpe_49k.json", 1, lambda d, p: packing.pack(d, p).groupBy("doc_id").agg({"doc_tokens": "max"})),
            ("byte_bpe_50k.json", 1, lambda d, p: token_binary.round_trip(d, p).select("doc_id", "n_tokens"))):
        t = Tokenizer.from_file(tokenizer_path(name))
        want = {i: len(t.encode(x, add_special_tokens=False).ids) + end for i, x in rows}
        assert {r[0]: r[1] for r in out(docs_of(rows), tokenizer_path(name)).collect()} == want


def test_packing(docs_of):
    texts = [t for _, t in ODD] + ["lorem ipsum dolor " * n for n in range(0, 900, 7)]
    rows = list(enumerate(texts))
    out = packing.pack(docs_of(rows).coalesce(3), tokenizer_path("word_bpe_49k.json"), with_ids=True).collect()
    want = dict(zip(range(len(rows)), ids_of("word_bpe_49k.json", texts, [1])))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in out:
        ids = want[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert r["ids"] == ids.tolist() and r["ids_crc32"] == zlib.crc32(ids.tobytes())
        assert r["doc_tokens"] == len(want[r["doc_id"]])
        by_doc[r["doc_id"]].append((r["start"], r["length"]))
        by_seq[r["sequence_id"]].append((r["offset"], r["length"], r["tier"], r["step_group"]))
    for doc, pieces in by_doc.items():
        at = 0
        for start, n in sorted(pieces):
            assert start == at and n > 0
            at += n
        assert at == len(want[doc])
    assert set(by_doc) == set(want)
    steps = defaultdict(int)
    for sequence, pieces in by_seq.items():
        at = 0
        for offset, n, tier, step in sorted(pieces):
            assert offset == at
            at += n
        assert at == tier <= 2048 and at & (at - 1) == 0  # no window needs padding
        steps[sequence >> 36, tier, step] += at
    assert max(steps.values()) <= packing.STEP_TOKENS
    assert packing.pack(docs_of([]), tokenizer_path("word_bpe_49k.json")).count() == 0


def test_step_groups_span_partitions(docs_of):
    rows = [(i, "lorem ipsum dolor " * (5 + i * 37 % 900)) for i in range(150)]
    docs = docs_of(rows).repartition(5)
    out = packing.pack(docs, tokenizer_path("word_bpe_49k.json")).collect()
    assert len({r["sequence_id"] >> 36 for r in out}) == 5
    windows = {(r["sequence_id"], r["tier"], r["step_group"]) for r in out}
    assert len(windows) == len({s for s, _, _ in windows})
    sizes = defaultdict(lambda: defaultdict(int))
    for _, tier, step in windows:
        sizes[tier][step] += tier
    assert len(sizes[2048]) > 5
    for tier, by_step in sizes.items():
        assert sorted(by_step) == list(range(len(by_step)))
        full = [by_step[k] for k in range(len(by_step) - 1)]
        assert set(full) <= {packing.STEP_TOKENS} and by_step[len(by_step) - 1] <= packing.STEP_TOKENS


def test_coder_round_trip_and_damage():
    rng = np.random.default_rng(1)
    blocks = [rng.zipf(1.3, n).clip(0, 50256).astype(np.uint32) for n in (500, 0, 1, 64, 700)]
    blocks += [np.zeros(300, np.uint32), np.full(400, 65535, np.uint32), rng.integers(0, 65536, 300).astype(np.uint32)]
    coded = token_binary.encode_blocks(blocks)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(blocks, token_binary.decode_blocks(coded)))
    assert len(coded[5]) < 100 and (token_binary.decode_blocks([coded[3]])[0] == blocks[3]).all()
    bad = coded[0][:40] + bytes([coded[0][40] ^ 1]) + coded[0][41:]
    with pytest.raises(ValueError):
        token_binary.decode_blocks([bad])
    with pytest.raises(ValueError):
        token_binary.encode_blocks([np.array([1 << 16], np.uint32)])


def text_ids(n):
    """Ids of words that follow each other unevenly, as in texts."""
    rng = np.random.default_rng(5)
    words = [rng.integers(1, 50257, rng.integers(1, 5)) for _ in range(20000)]
    at = (rng.zipf(1.2, n) - 1) % len(words)
    return np.concatenate([words[i] for i in at])[:n].astype(np.uint32)


def test_coder_is_smaller_than_zlib_and_quick():
    ids = text_ids(400_000)
    blocks = [ids[a:a + token_binary.BLOCK_IDS] for a in range(0, len(ids), token_binary.BLOCK_IDS)]
    began = time.process_time()
    coded = token_binary.encode_blocks(blocks)
    assert all(map(np.array_equal, blocks, token_binary.decode_blocks(coded)))
    assert (time.process_time() - began) / len(ids) < 2e-6  # it took over 5 when each id was four steps
    assert sum(map(len, coded)) < sum(len(zlib.compress(b.astype("<u2").tobytes())) for b in blocks)


def test_coder_lanes(monkeypatch):
    monkeypatch.setattr(token_binary, "LANE_IDS", 8)
    rng = np.random.default_rng(2)
    blocks = [rng.integers(0, top, n).astype(np.uint32) for n in range(1, 45) for top in (1, 3, 1 << 16)]
    blocks.append(np.arange(1 << 16, dtype=np.uint32))  # every id is seen
    blocks.append(np.concatenate((blocks[-1], blocks[-1][::-1], text_ids(3000))))
    coded = token_binary.encode_blocks(blocks)
    assert all(map(np.array_equal, blocks, token_binary.decode_blocks(coded)))
    for p in (coded[100], coded[-1]):
        for cut in (p[:20], p[:-2], p[:12] + p[14:], b"MMB1" + p[4:], p[:4] + bytes([p[4] ^ 1]) + p[5:]):
            with pytest.raises(ValueError):
                token_binary.decode_blocks([cut])


def test_kept_words_are_bounded_and_right(monkeypatch):
    monkeypatch.setattr("marketmap.llm.tokens.CACHE_WORDS", 60)
    monkeypatch.setattr("marketmap.llm.tokens.RUN_CHARS", 300)
    rng = np.random.default_rng(3)
    words = ["alpha", "béta", "gamma.", "delta***", "it's", "x--", "Ünï,", "q'", "42%", "日本。", "e\u0301!", "don't?"]
    words += [f"w{i}" + ".,;"[i % 3] for i in range(60)]
    texts = TRICKY + [(" \n"[i % 9 == 0]).join(rng.choice(words, 12)) for i in range(150)] + TRICKY
    texts += ["a  long text " * 20, "a\x1fb c", "one\xa0two. three", "one two.\u3000three", "tail. ", " head."]
    for name, space in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        encoder = Encoder(tokenizer_path(name), space)
        for _ in range(2):
            assert list(encoder.encode(texts)) == [x.tobytes() for x in ids_of(name, texts, [])]
            assert len(encoder.words) == len(encoder.word_ids) <= 60
            assert max(len(w.encode()) for w in encoder.words.to_pylist()) <= 64  # a text that is not cut is not kept


def test_token_files(docs_of, monkeypatch):
    monkeypatch.setattr(token_binary, "BLOCK_IDS", 64)
    texts = [t for _, t in ODD[:4]] + ["alpha beta gamma " * n for n in (1, 50, 3, 200, 0, 7)]
    rows = list(zip((9, 8, 30, 2, 4, 5, 6, 7, 1, 0), texts))
    out = token_binary.round_trip(docs_of(rows), tokenizer_path("byte_bpe_50k.json")).orderBy("doc_id").collect()
    at = 0
    for r, (i, t) in zip(out, sorted(rows, key=lambda x: x[0])):
        ids = ids_of("byte_bpe_50k.json", [t], [0])[0]
        assert tuple(r) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert len(out) == len(rows)
    assert token_binary.round_trip(docs_of([]), tokenizer_path("byte_bpe_50k.json")).count() == 0


def test_joined_crc():
    shifts = token_binary._crc_shifts()
    a, b = b"hello world" * 9, b"\x00\x01more" * 1234
    assert token_binary.join_crc(zlib.crc32(a), zlib.crc32(b), len(b), shifts) == zlib.crc32(a + b)
