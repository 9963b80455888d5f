"""Small tables for the operators on texts, and plain Python versions of what they compute."""

from __future__ import annotations

import re
from collections import defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALPHANUMERIC = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def documents(spark, texts, extra=False):
    """A documents table of ``texts``: strings or (doc_id, text) pairs."""
    rows = [(k, t, "en", f"src{k % 3}", len(t or "")) if not isinstance(t, tuple) else (t[0], t[1], "en", "s", 0) for k, t in enumerate(texts)]
    table = spark.createDataFrame(rows, DOCS)
    if extra:  # names the operators use themselves
        for name in ("kept", "rank", "node", "line", "key", "n_words", "bands", "score", "id", "word", "hub", "pos"):
            table = table.selectExpr("*", f"'mine' AS {name}")
    return table


def odd_texts() -> list:
    """Nulls, empty and blank texts, ties, and one very long text."""
    return [(1, None), (2, ""), (3, " \n\t\n "), (None, "a b c"), (None, None), (4, "a b c"), (4, "a b c"), (5, "x " * 60_000), (6, "x" * 300_000)]


def shingles(text: str | None, width: int = 5) -> set:
    words = SPACED.findall(lower(text))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def classes(rows: list[tuple[int, str]]) -> dict[int, int]:
    """doc_id to the least doc_id of its class, by comparing all pairs."""
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                one, two = find(a), find(b)
                root[max(one, two)] = min(one, two)
    return {d: find(d) for d in ids}


def repeated_words(words: list[str]) -> int:
    seen = defaultdict(list)
    for i in range(len(words) - 2):
        seen[tuple(words[i : i + 3])].append(i)
    return len({p for at in seen.values() if len(at) > 1 for i in at for p in (i, i + 1, i + 2)})


def deduped(rows: list[tuple[int, str]], least: int) -> dict[int, list[int]]:
    """doc_id to its removed line numbers: lines of runs of ``least`` words that stood earlier, run by run."""
    runs: dict[tuple, list] = defaultdict(list)
    for doc, text in sorted(rows):
        lines = [(n, x, len(SPACED.findall(x))) for n, x in enumerate((text or "").split("\n"))]
        lines = [x for x in lines if x[2]]
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                if sum(x[2] for x in lines[a : b + 1]) >= least:
                    runs[tuple(x[1] for x in lines[a : b + 1])].append((doc, a, [x[0] for x in lines[a : b + 1]]))
    gone: dict[int, set] = defaultdict(set)
    for places in runs.values():
        first = min(places)[:2]
        for doc, at, lines in places:
            if (doc, at) > first:
                gone[doc].update(lines)
    return {doc: sorted(gone[doc]) for doc, _ in rows}
