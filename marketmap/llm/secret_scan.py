"""Secret scan: pattern spans plus credential values that are hard to guess.

Base spans come from three patterns (assign, access, hex). The method adds spans of kind ``guess``:
values that stand in a credential context (``pwd:``, ``passphrase is``, ``Authorization: Bearer`` ...)
and whose guess cost is high. The cost, in bits, is that of the cheapest segmentation of the value into
dictionary words, dates, repeats, keyboard walks and brute-force spans, found by dynamic programming
over the positions of the value; the work is linear in its length.

Edge cases: null text counts as empty; a text without spans has empty ``spans`` and the digest of the
empty string; repeated rows are reported one by one; extra columns are ignored; whole texts and values of
any length are processed.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# [0-9a-f]+ of 24 characters or more: a leftmost match is a whole run, so the length can stand in the pattern.
HEX = re.compile(r"[0-9a-f]{24,}")
# A name and its sign; the value is read from there.
NAMED = re.compile(
    r"""(?<![A-Za-z0-9_-])([A-Za-z0-9_-]++)["'`]?(?:\x20*(?:=>|[:=])|\x20+is\b)\x20*(?:(?:bearer|basic)\x20+)?""",
    re.IGNORECASE | re.ASCII)
# A credential word in a name, set off by _, -, a digit or a camel-case border (AWS_SECRET_ACCESS_KEY, userPass, db_pass2).
CREDENTIAL = re.compile(
    r"(?:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z]))"
    r"(?i:password|passwd|passphrase|passcode|pwd|pass|secret|token|api[_-]?key|access[_-]?key|private[_-]?key"
    r"|client[_-]?secret|credentials?|login|auth|authorization|bearer)(?:(?![A-Za-z])|(?<=[a-z])(?=[A-Z]))", re.ASCII)
# A quoted value runs to its closing quote. A bare one runs to white space or a quote; signs that close the text
# around it, a tag, a call's arguments and the next name of a list are not part of it.
QUOTED = re.compile(r"""(["'`])((?:(?!\1)[^\\\r\n]|\\[^\r\n])*+)\1(?![A-Za-z0-9])""", re.ASCII)
BARE = re.compile(r"""["'`]?([A-Za-z_][A-Za-z0-9_.]*+(?=\()|(?:(?![,;&][A-Za-z_][A-Za-z0-9_-]*+["'`]?[:=]|</?[A-Za-z][A-Za-z0-9]*+[\s/>]|<!--)[^\s"'`])*+)""",
                  re.ASCII)
NAME = re.compile(r"([A-Za-z0-9_-]++)[:=]", re.ASCII)
CLOSING, SHORTEST = ",;.)>]}", 6

# Common password words by rank, and keyboard rows.
WORDS = (
    "password qwerty dragon monkey letmein football baseball master shadow sunshine princess welcome login admin "
    "superman batman trustno michael jordan hunter buster soccer hockey killer george charlie andrew michelle love "
    "jessica pepper access thunder summer winter spring autumn ginger computer internet secret cheese test user root "
    "guest default changeme hello freedom whatever starwars flower orange purple silver golden diamond matrix "
    "mustang maggie cookie chocolate samsung google apple banana coffee pass token key server service system network "
    "database backup office company money family friend forever lucky angel heart black white green yellow blue red "
    "happy music guitar tiger eagle falcon ranger phoenix rocket london paris berlin madrid monday tuesday friday "
    "january february march april june july august september october november december example sample placeholder "
    "redacted removed your here insert the and for not with this that from value string none null true false").split()
KEYBOARD = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz", "9876543210")
LEET = str.maketrans("0134578@$!", "oieastbasi")
RANKS = {w: i + 1 for i, w in enumerate(WORDS)}
LONGEST_WORD = max(map(len, WORDS))
REACH = max(LONGEST_WORD, 10)  # a date has at most 10 characters
DATE = re.compile(r"(?:19|20)\d\d(?:[-./]?(?:0[1-9]|1[0-2])(?:[-./]?(?:0[1-9]|[12]\d|3[01]))?)?"
                  r"|(?:0[1-9]|[12]\d|3[01])[-./]?(?:0[1-9]|1[0-2])[-./]?(?:19|20)\d\d")
MIN_BITS = 45.0
SEGMENT_BITS = 1.5


def _walk_steps() -> dict[tuple[str, str], bool]:
    steps = {}
    for row in KEYBOARD:
        for a, b in zip(row, row[1:]):
            steps[a, b] = steps[b, a] = True
    return steps


_STEPS = _walk_steps()


def _char_bits(value: str) -> float:
    """Brute force: bits per character of the smallest usual alphabet that holds the value."""
    if re.fullmatch(r"[0-9]+", value):
        return math.log2(10)
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value):
        return 4.0
    size = sum(n for p, n in ((r"[a-z]", 26), (r"[A-Z]", 26), (r"[0-9]", 10), (r"[^A-Za-z0-9]", 33)) if re.search(p, value))
    return math.log2(size)


def guess_bits(value: str) -> float:
    """Bits of the cheapest segmentation of ``value``; 0 for an empty value."""
    n = len(value)
    low, per_char = value.lower(), _char_bits(value) if value else 0.0
    plain = low.translate(LEET)
    dates = {}
    for i in range(n):
        if value[i].isdigit():
            if m := DATE.match(value, i):
                dates[i] = m.end()
    best = [0.0] + [math.inf] * n

    def step(i: int, j: int, bits: float) -> None:
        if best[i] + bits < best[j]:
            best[j] = best[i] + bits

    same = walk = 0  # where the run of one character, and the walk, that reach i began
    for i in range(n):
        if i and low[i] != low[i - 1]:
            same = i
        if i and (low[i - 1], low[i]) not in _STEPS:
            walk = i
        step(i, i + 1, per_char)
        # Runs and walks end at i + 1 and may begin where a word or date that began before them ends, which is less than
        # REACH behind their start. Behind a piece that lies inside, a longer run is cheaper, as its cost is the
        # logarithm of its length.
        for k in range(same, min(i - 1, same + REACH)):
            step(k, i + 1, per_char + math.log2(i + 1 - k) + SEGMENT_BITS)
        for k in range(walk, min(i - 1, walk + REACH)):
            step(k, i + 1, math.log2(47) + 1 + math.log2(i + 1 - k) + SEGMENT_BITS)
        if i in dates:
            step(i, dates[i], (7.0 if dates[i] - i == 4 else 15.5) + SEGMENT_BITS)
        for j in range(i + 3, min(n, i + LONGEST_WORD) + 1):
            rank = RANKS.get(plain[i:j])
            if rank:
                varied = (value[i:j] != low[i:j]) + (low[i:j] != plain[i:j])
                step(i, j, math.log2(rank) + 1 + varied + SEGMENT_BITS)
    return best[n]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns, by start and kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def credential_values(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the values that stand in a credential context; they do not overlap."""
    done = 0
    for m in NAMED.finditer(text):
        if m.start() < done or not CREDENTIAL.search(m[1]):
            continue
        if value := QUOTED.match(text, m.end()):
            start, end = value.span(2)
        else:
            value = BARE.match(text, m.end())
            start = value.start(1)
            end = start + len(value[1].rstrip(CLOSING))
            if (name := NAME.fullmatch(text, start, end)) and CREDENTIAL.search(name[1]):
                continue  # "login: password: ..."
        done = end
        if end - start >= SHORTEST:
            yield start, end


def guess_spans(text: str, min_bits: float = MIN_BITS) -> list[tuple[int, int, int]]:
    """(start, kind, end) of values in a credential context that take at least ``min_bits`` to guess."""
    return [(a, 3, b) for a, b in credential_values(text) if guess_bits(text[a:b]) >= min_bits]


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame, min_bits: float = MIN_BITS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                base = base_spans(text or "")
                more = guess_spans(text or "", min_bits)
                kinds = [k for _, k, _ in base]
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2),
                             hashlib.sha256(_joined(base).encode()).hexdigest(),
                             _joined(sorted(base + more)), len(more)))
            cols = list(zip(*rows)) or [[]] * 6
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types))],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(
        scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long")
