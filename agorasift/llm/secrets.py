"""Secret scans: keyword prefilter, anchored expressions, embedded checksums."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
from pyspark.sql import DataFrame, types as T

from agorasift.llm.arrow import map_texts


@dataclass(frozen=True)
class Kind:
    """One kind of secret.

    ``keywords`` are lower-case strings, one of which every match begins with
    (in either case); ``pattern`` is matched at their hits alone.  Where
    ``run`` is given instead, matches are maximal runs of the characters that
    ``run`` maps to a word character, and the keyword is ``least`` of them.
    ``valid`` drops failing matches after they were passed over.  A pattern
    must not read a long run again from each hit inside it.
    """

    name: str
    pattern: re.Pattern[bytes]
    keywords: tuple[str, ...] = ()
    run: bytes = b""
    least: int = 0
    valid: Callable[[re.Match[bytes]], bool] = lambda m: True


def luhn(digits: bytes) -> bool:
    doubled = [sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits.decode()))]
    return len(set(digits)) > 1 and sum(doubled) % 10 == 0


def _base62(number: int, width: int) -> str:
    alphabet = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    out = ""
    while number:
        number, at = divmod(number, 62)
        out = alphabet[at] + out
    return out.rjust(width, "0")


def crc_token(match: re.Match[bytes]) -> bool:
    """The last six characters are the CRC-32 of those before, in base 62."""
    body = match.group(2)
    return _base62(zlib.crc32(body[:-6]), 6).encode() == body[-6:]


# kinds in the order in which they are listed; the first three are the base
KINDS = (
    Kind("assign", re.compile(
        rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE),
        ("password", "passwd", "secret", "token", "apikey", "api_key"), valid=lambda m: len(m.group(2)) >= 6),
    Kind("access", re.compile(rb"AKIA[A-Z0-9]+"), ("akia",), valid=lambda m: len(m.group()) >= 20),
    Kind("hex", re.compile(rb"[0-9a-f]+"), run=b"0123456789abcdef", least=24),
    Kind("issued", re.compile(rb"(ghp|gho|ghu|ghs|ghr|npm)_([A-Za-z0-9]{36})(?![A-Za-z0-9])"),
         ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"), valid=crc_token),
    Kind("signed", re.compile(rb"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}"), ("eyj",)),
    Kind("key", re.compile(rb"-----BEGIN [A-Z ]*PRIVATE KEY-----"), ("-----begin ",)),
    Kind("card", re.compile(rb"[0-9]+"), run=b"0123456789", least=13,
         valid=lambda m: len(m.group()) <= 19 and luhn(m.group())),
)
BASE = ("assign", "access", "hex")


class Scanner:
    """Finds spans (start, end, kind) in UTF-8 bytes."""

    def __init__(self, kinds: tuple[Kind, ...] = KINDS):
        self.kinds = kinds
        self.words = ahocorasick.Automaton()
        for at, kind in enumerate(kinds):
            for word in kind.keywords:
                self.words.add_word(word, (len(word), at))
        self.words.make_automaton()
        self.runs = [(at, bytes(0x78 if c in k.run else 0x20 for c in range(256)), b"x" * k.least)
                     for at, k in enumerate(kinds) if k.run]

    def hits(self, text: bytes) -> Iterator[tuple[int, int]]:
        """(kind, start) of each keyword, from left to right within a kind."""
        lower = text.lower().decode("latin-1")  # one character per byte
        for end, (length, at) in self.words.iter(lower):
            yield at, end - length + 1
        for at, classes, word in self.runs:
            marked = text.translate(classes)
            start = marked.find(word)
            while start >= 0:
                yield at, start
                stop = marked.find(b" ", start)
                start = marked.find(word, stop) if stop >= 0 else -1

    def spans(self, text: bytes) -> list[tuple[int, int, int]]:
        found, passed = [], [0] * len(self.kinds)
        for at, start in self.hits(text):
            kind = self.kinds[at]
            match = kind.pattern.match(text, start) if start >= passed[at] else None
            if match:
                passed[at] = match.end()
                if kind.valid(match):
                    found.append((start, match.end(), at))
        return sorted(found, key=lambda s: (s[0], s[2]))


def _points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans in code points instead of bytes."""
    if text.isascii() or not spans:
        return spans
    places, points, last = {}, 0, 0
    for byte in sorted({b for s in spans for b in s[:2]}):
        points += len(text[last:byte].decode())
        last, places[byte] = byte, points
    return [(places[a], places[b], kind) for a, b, kind in spans]


def scan(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """doc_id and ``found``: array of (kind, start, end) in code points, end exclusive, by start, then kind as listed.

    An Aho-Corasick automaton over all keywords reads each whole text once (for
    kinds without a keyword, a run of characters of their class stands for
    one); expressions are tried only where a keyword begins; what has a
    checksum must carry the right one.  Matches of one kind do not overlap;
    those that fail a check are passed over all the same.

    Defined cases: a null or empty text has no spans; repeated rows are scanned
    alike; an empty table gives an empty table; other columns are not read.
    No shuffle.
    """
    kind = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])

    def start():
        scanner = Scanner(kinds)

        def one(text: bytes):
            spans = _points(text, scanner.spans(text))
            return ([{"kind": kinds[k].name, "start": a, "end": b} for a, b, k in spans],)

        return one

    return map_texts(docs, "text", ["doc_id"], T.StructType([T.StructField("found", T.ArrayType(kind))]), start)
