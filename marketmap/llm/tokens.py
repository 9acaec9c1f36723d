"""Token ids of whole texts by a public tokenizer file, with a bounded word cache.

Both vocabularies split a text before their merges, and a single space between two non-space characters
is always such a split; so ids of a text are the ids of its words (each with the space before it, where the
vocabulary keeps spaces) one after the other. Distinct words go through the tokenizers library once and
are then found among those kept. A line with any other white space is encoded as a whole, and so is a text that
holds an added token of the file ("<|endoftext|>"), which is one id as the library has it.
"""

from __future__ import annotations

import gc
import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words kept (those used last first; whole texts are not) and their longest in bytes, and characters encoded at once.
CACHE_WORDS, WORD_BYTES, RUN_CHARS = 600_000, 64, 1 << 24
#: White space but " " and "\\n"; one of it, that marks where a text is cut.
_OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
_CUT = "\x1f"


class Encoder:
    """``keeps_space``: the vocabulary's words begin with the space before them (byte level)."""

    def __init__(self, path: str, keeps_space: bool):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one task on each core already
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.keeps_space = keeps_space
        # Between words of one call: a sign that is a word, and one id, of its own.
        self.between = "\n" if keeps_space else " | "
        (self.between_id,) = self.tokenizer.encode(self.between, add_special_tokens=False).ids
        self.model = self.tokenizer.model
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)  # the words are kept here
        self.has_added = re.compile("|".join(map(re.escape, self.added)) or r"(?!)").search
        # A word of Latin letters is one piece for the merges, as its bytes' signs, in the case of the file.
        letters = (" " if keeps_space else "") + "[A-Za-zÀ-ÖØ-öø-ÿ]+"
        self.is_letters = re.compile(letters).fullmatch
        # The byte level splits such a word from ASCII signs after it.
        self.is_ended = re.compile(rf"({letters})([!-&(-/:-@\[-`{{-~]+)" if keeps_space else r"(?!)").fullmatch
        signs = ByteLevel(add_prefix_space=False, use_regex=False)
        self.signs = {i: signs.pre_tokenize_str(chr(i))[0][0] for i in (0x20, *range(0xC0, 0x100))}
        normal = self.tokenizer.normalizer
        self.lowers = normal is not None and normal.normalize_str("Ab") == "ab"
        # Words kept and their ids; Arrow's arrays take a fraction of a dictionary's memory.
        self.words, self.word_ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def _one_by_one(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _encode(self, texts: list[str]) -> list[bytes]:
        (found,) = self.tokenizer.encode_batch_fast([self.between.join(texts)], add_special_tokens=False)
        ids = np.array(found.ids, "<u4")
        ends = np.append(np.flatnonzero(ids == self.between_id), len(ids))
        if len(ends) != len(texts):
            return self._one_by_one(texts)
        raw, out, a = ids.tobytes(), [], 0
        for b in (4 * ends).tolist():
            out.append(raw[a:b])
            a = b + 4
        return out

    def _ids_of(self, distinct: pa.LargeStringArray) -> pa.LargeBinaryArray:
        """Ids of distinct words, which are the newest of those kept from now on."""
        # Finding words costs by the number of those looked among: the newest, twice as many.
        words, word_ids = self.words[:2 * len(distinct)], self.word_ids[:2 * len(distinct)]
        at = pc.index_in(distinct, value_set=words)
        new = distinct.filter(at.is_null())
        collects = gc.isenabled()
        gc.disable()  # learning makes many small objects and no cycles
        try:
            learned = self._learned(new.to_numpy(zero_copy_only=False).tolist())
        finally:
            if collects:
                gc.enable()
        at = at.fill_null(-1).to_numpy().astype(np.int64)
        hits = at[at >= 0]
        at[at < 0] = len(words) + np.arange(len(new))
        out = pa.concat_arrays([word_ids, learned]).take(pa.array(at))
        if 6 * len(distinct) >= len(self.words):  # a short run leaves them as they are
            unused = np.ones(len(self.words), bool)
            unused[hits] = False
            rest = pa.array(np.flatnonzero(unused)[:max(CACHE_WORDS - len(distinct), 0)])
            short = pc.less_equal(pc.binary_length(distinct), WORD_BYTES)
            self.words = pa.concat_arrays([distinct.filter(short)[:CACHE_WORDS], self.words.take(rest)])
            self.word_ids = pa.concat_arrays([out.filter(short)[:CACHE_WORDS], self.word_ids.take(rest)])
        return out

    def _learned(self, words: list[str]) -> pa.LargeBinaryArray:
        """Ids of distinct words that are not kept."""
        new = set(words)
        ended = {m[0]: m.groups() for m in map(self.is_ended, words) if m}
        new.update(chain.from_iterable(ended.values()))
        new.difference_update(ended)
        found: dict[str, bytes] = {}
        letters = list(filter(self.is_letters, new))
        for some in (list(filter(str.isascii, letters)), [w for w in letters if not w.isascii()]):
            found.update(zip(some, self._plain_words(some)))
        new.difference_update(letters)
        sign = self.between.strip(" ")
        alone = [w for w in new if sign in w or not w or (self.keeps_space and w[0] != " ") or self._marked(w)]
        new = list(new.difference(alone))
        for a in range(0, len(new), 500):
            found.update(zip(new[a:a + 500], self._encode(new[a:a + 500])))
        if alone:
            found.update(zip(alone, self._one_by_one(alone)))
        found.update((w, found[a] + found[b]) for w, (a, b) in ended.items())
        return pa.array(list(map(found.__getitem__, words)), pa.large_binary())

    def _marked(self, text: str) -> bool:
        return self.has_added(text) is not None

    def _plain_words(self, words: list[str]) -> list[bytes]:
        """Ids of words of Latin letters (after a space, where the vocabulary keeps spaces)."""
        pieces = "\n".join(words)
        pieces = pieces.lower() if self.lowers else pieces
        pieces = pieces.replace(" ", self.signs[0x20]) if pieces.isascii() else pieces.translate(self.signs)
        tokenize, id_of = self.model.tokenize, attrgetter("id")
        ids, ends = array("I"), []
        for piece in pieces.split("\n") if words else ():
            ids.extend(map(id_of, tokenize(piece)))
            ends.append(4 * len(ids))
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def _split(self, text: str) -> list[str]:
        """Parts whose ids are those of the text, one after the other."""
        if self._marked(text):
            return [text]
        if not self.keeps_space:
            # White space is dropped: words can be cut at any of it.
            return text.replace("\n", " ").split(" ")
        out = []
        lines = text.split("\n")
        for i, line in enumerate(lines):
            words = line.split(" ")
            # Cut only where a single "\n" or " " stands between two other characters.
            if "" in words or any(map(str.isspace, words)) or not _plain(line):
                return [text]
            if i:
                out.append("\n")
            out.append(words[0])
            out += [" " + w for w in words[1:]]
        return out

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        run, size = [], 0
        for text in texts:
            run.append(text)
            size += len(text)
            if size >= RUN_CHARS:
                full, run, size = run, [], 0
                yield from self._run(full)
        yield from self._run(run)

    def _run(self, texts: list[str]) -> Iterator[bytes]:
        # Each distinct part is looked up once; the ids of all parts are then taken by number.
        starts, ends, found = self._parts(texts)
        taken = self._ids_of(found.dictionary).take(found.indices)
        del found
        pa.default_memory_pool().release_unused()
        _, offsets, data = taken.buffers()
        raw = memoryview(data or b"")
        cuts = np.frombuffer(offsets, np.int64)
        for x, y in zip(cuts[starts].tolist(), cuts[ends].tolist()):
            yield bytes(raw[x:y])

    def _parts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, pa.DictionaryArray]:
        """Parts of all texts as numbers of distinct ones, and where each text's begin and end."""
        if self.keeps_space:
            return self._spaced_parts(texts)
        if any(map(self._marked, texts)):
            parts = [self._split(t) for t in texts]
            edges = np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64)))
            return edges[:-1], edges[1:], pa.array(list(chain.from_iterable(parts)), pa.large_string()).dictionary_encode()
        words = pc.split_pattern(pa.array([t.replace("\n", " ") for t in texts], pa.large_string()), " ")
        edges = words.offsets.to_numpy().astype(np.int64)
        return edges[:-1], edges[1:], words.flatten().dictionary_encode()

    def _spaced_parts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, pa.DictionaryArray]:
        """As _parts, for a vocabulary that keeps spaces. A text is cut as _split does where a single " " or "\\n" stands
        between all its words; in any other text _split finds the parts."""
        plain = np.array([_even(t) and not self._marked(t) for t in texts], bool)
        parts = pc.split_pattern(pa.array([t.replace(" ", _CUT + " ").replace("\n", _CUT + "\n" + _CUT) if p else None
                                           for t, p in zip(texts, plain)], pa.large_string()), _CUT)
        others = [self._split(t) for t, p in zip(texts, plain) if not p]
        edges = parts.offsets.to_numpy().astype(np.int64)
        starts, ends = edges[:-1].copy(), edges[1:].copy()
        cuts = edges[-1] + np.concatenate(([0], np.cumsum([len(p) for p in others], dtype=np.int64)))
        starts[~plain], ends[~plain] = cuts[:-1], cuts[1:]
        found = parts.flatten()
        if others:
            found = pa.concat_arrays([found, pa.array(list(chain.from_iterable(others)), pa.large_string())])
        return starts, ends, found.dictionary_encode()


@lru_cache(maxsize=1)
def _kept(path: str, keeps_space: bool) -> Encoder:
    return Encoder(path, keeps_space)


def worker_encoder(tokenizer: str | Callable[[], str], keeps_space: bool) -> Encoder:
    """The encoder of this worker process, kept with its known words from task to task. ``tokenizer``: path of the
    file, or a function that finds it on this machine."""
    return _kept(tokenizer() if callable(tokenizer) else tokenizer, keeps_space)


def _even(text: str) -> bool:
    """No white space in the text but single " " or "\\n" between two other characters."""
    return not (text[:1] in " \n" or text[-1] in " \n" or "  " in text or "\n\n" in text or " \n" in text or "\n " in text
                or any(c in text for c in _OTHER_SPACE))


def _plain(line: str) -> bool:
    """No white space in the line but single spaces."""
    return len(line.split()) == line.count(" ") + 1
