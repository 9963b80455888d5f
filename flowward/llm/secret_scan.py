"""Secrets in whole texts.

An Aho-Corasick automaton finds the keywords; regular expressions are anchored at the hits only;
what carries a checksum of its own is checked by it. Runs of hexadecimal digits have no keyword:
every eighth character is looked at, and a run is followed where four of these in a row are digits.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The kinds in their order, and what precedes an assigned value.
KINDS = ("assign", "access", "hex", "forge_token", "package_token", "extended_key")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
FORGE_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")
PACKAGE_PREFIX = "npm_"
EXTENDED_KEY_PREFIX = "xprv"

ASSIGN = re.compile(
    r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
SPARSE_HEX = re.compile(r"[0-9a-f]{4,}")
CHECKED_TOKEN = re.compile(r"(?:gh[opusr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
EXTENDED_KEY = re.compile(r"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])")

MIN_VALUE, MIN_ACCESS, MIN_HEX, STEP = 8, 16, 32, 8
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"

SCHEMA = (
    "doc_id long, n_assign long, n_access long, n_hex long, n_checked long, base_sha256 string, spans string"
)


def _automaton() -> ahocorasick.Automaton:
    """Every keyword in every mixture of cases, so that no text has to be lower-cased."""
    auto = ahocorasick.Automaton()
    for word in ASSIGN_WORDS:
        for letters in itertools.product(*({c, c.upper()} for c in word)):
            auto.add_word("".join(letters), (len(word), "assign"))
    for word, kind in [
        ("AKIA", "access"),
        (EXTENDED_KEY_PREFIX, "extended_key"),
        *((p, "forge_token") for p in FORGE_PREFIXES),
        (PACKAGE_PREFIX, "package_token"),
    ]:
        auto.add_word(word, (len(word), kind))
    auto.make_automaton()
    return auto


def crc_suffix(body: str) -> str:
    """The six base-62 digits of a token's CRC-32."""
    value, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = BASE62[digit] + digits
    return digits


def base58_valid(text: str) -> bool:
    """Whether the last four of a base-58 string's bytes are the double SHA-256 of the others."""
    value = 0
    for c in text:
        value = value * 58 + BASE58.index(c)
    raw = value.to_bytes(82, "big") if value < 1 << 656 else b""
    return raw[-4:] == hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] if raw else False


def _at(pattern: re.Pattern, kind: str, text: str, pos: int) -> tuple[int, bool]:
    """Where the anchored match ends (``pos`` if there is none) and whether it is a finding."""
    found = pattern.match(text, pos)
    if not found:
        return pos, False
    if kind == "assign":
        return found.end(), found.end(1) - found.start(1) >= MIN_VALUE
    if kind == "access":
        return found.end(), found.end() - pos >= MIN_ACCESS
    if kind == "extended_key":
        return found.end(), base58_valid(found.group())
    return found.end(), crc_suffix(found.group(1)) == found.group(2)


_PATTERNS = {
    "assign": ASSIGN,
    "access": ACCESS,
    "forge_token": CHECKED_TOKEN,
    "package_token": CHECKED_TOKEN,
    "extended_key": EXTENDED_KEY,
}


def find_spans(text: str, auto: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(start, place of the kind in ``KINDS``, end) of all findings, in order."""
    spans: list[tuple[int, int, int]] = []
    hits = sorted((end - length + 1, kind) for end, (length, kind) in auto.iter(text))
    free = dict.fromkeys(KINDS, 0)
    for start, kind in hits:
        if start >= free[kind]:
            end, good = _at(_PATTERNS[kind], kind, text, start)
            free[kind] = max(free[kind], end)
            if good:
                spans.append((start, KINDS.index(kind), end))
    for run in _hex_runs(text):
        spans.append((run[0], 2, run[1]))
    return sorted(spans)


def _hex_runs(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for sparse in SPARSE_HEX.finditer(text[STEP - 1 :: STEP]):
        for place in range(*sparse.span()):
            at = place * STEP + STEP - 1
            if at < done:
                continue
            start = at
            while start > done and text[start - 1] in "0123456789abcdef":
                start -= 1
            done = HEX.match(text, at).end()
            if done - start >= MIN_HEX:
                yield start, done


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    auto = _automaton()
    for batch in batches:
        rows: dict[str, list] = {k: [] for k in ("assign", "access", "hex", "checked", "sha", "spans")}
        for value in batch.column(1):
            spans = find_spans(value.as_py() or "", auto)
            kinds = [kind for _, kind, _ in spans]
            for place, name in enumerate(KINDS[:3]):
                rows[name].append(kinds.count(place))
            rows["checked"].append(sum(kind > 2 for kind in kinds))
            base = _joined([s for s in spans if s[1] < 3])
            rows["sha"].append(hashlib.sha256(base.encode()).hexdigest())
            rows["spans"].append(_joined(spans))
        counts = [pa.array(rows[k], pa.int64()) for k in ("assign", "access", "hex", "checked")]
        texts = [pa.array(rows[k], pa.string()) for k in ("sha", "spans")]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *counts, *texts],
            ["doc_id", "n_assign", "n_access", "n_hex", "n_checked", "base_sha256", "spans"],
        )


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All secrets of every text, one row per input row.

    Spans are ``kind:start:end`` in code points with an exclusive end, of the whole match, ordered by
    start and then kind. ``assign``, ``access`` and ``hex`` are the base kinds; the other kinds pass only
    if their embedded checksum holds. Null texts and empty texts have no findings. A null id stays null,
    repeated rows are judged each by itself, other columns of ``docs`` are not read.
    """
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(_scan, SCHEMA)


def redact(text: str | None, spans: str, mask: str = "[secret]") -> str | None:
    """``text`` with its found spans (as ``scan_secrets`` gives them) replaced; overlaps go as one."""
    if not text or not spans:
        return text
    merged: list[list[int]] = []
    for _, start, end in (s.split(":") for s in spans.split(",")):
        if merged and int(start) < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], int(end))
        else:
            merged.append([int(start), int(end)])
    for start, end in reversed(merged):
        text = text[:start] + mask + text[end:]
    return text
