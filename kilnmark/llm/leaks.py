"""Problem 8: passages of held-out test items inside a large corpus.

One Aho-Corasick automaton holds blocks of the normalised items and every text is scanned once. A shared run of m words
contains a whole block of b words that starts at a multiple of b in the item, if 2 b - 1 <= m; so only these blocks are
patterns, and each hit is grown word by word to the whole shared run, whose ends are mapped back to the original text.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .worker import kept

RUN = 15  # words in a row that make a leak
ITEMS_MAX = 32 << 20  # characters of items in one automaton; more are scanned for in several rounds

# Every byte that is no ASCII letter or digit becomes a blank, letters become small: positions stay the same.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def plain(text: str) -> bytes:
    """text with one byte a character: small ASCII letters, digits, blanks for all else."""
    return text.encode("ascii", "replace").translate(_PLAIN)


def build(items: list[tuple[int, list[str]]], run: int) -> ahocorasick.Automaton:
    b = (run + 1) // 2
    blocks: dict[str, list[tuple[int, int]]] = {}
    for n, (_, words) in enumerate(items):
        for at in range(0, len(words) - b + 1, b):
            blocks.setdefault(" " + " ".join(words[at : at + b]) + " ", []).append((n, at))
    found = ahocorasick.Automaton()
    for text, places in blocks.items():
        found.add_word(text, (len(text), places))
    if blocks:
        found.make_automaton()
    return found


def passages(text: str, items: list[tuple[int, list[str]]], found: ahocorasick.Automaton, run: int) -> list[tuple[int, int, int, int]]:
    """(item index, first character, end character, words) of all maximal shared runs of at least `run` words."""
    if not len(found):
        return []
    flat = plain(text)
    words = flat.decode("ascii").split()
    if len(words) < run:
        return []
    line = " " + " ".join(words) + " "
    out: list[tuple[int, int, int, int]] = []
    done: dict[tuple[int, int], int] = {}
    at_char = at_word = 0
    for end, (size, places) in found.iter(line):
        start = end - size + 1
        at_word += line.count(" ", at_char, start) if start >= at_char else -line.count(" ", start, at_char)
        at_char = start
        for n, w in places:
            shift = at_word - w  # a run lies on one diagonal of document and item words
            if done.get((n, shift), -1) > at_word:
                continue
            own, i, j = items[n][1], at_word, w
            while i and j and words[i - 1] == own[j - 1]:
                i, j = i - 1, j - 1
            e, f = at_word, w
            while e < len(words) and f < len(own) and words[e] == own[f]:
                e, f = e + 1, f + 1
            done[(n, shift)] = e
            if e - i >= run:
                out.append((n, i, e, e - i))
    if not out:
        return []
    places_of = [m.span() for m in re.finditer(rb"[a-z0-9]+", flat)]
    return [(n, places_of[i][0], places_of[e - 1][1], k) for n, i, e, k in out]


def leaked_passages(documents: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """doc_id, item_id, start, stop, words: all passages of at least `run` words that a document shares with an item.

    A word is an unbroken run of ASCII letters and digits, case apart; start and stop are character positions in the
    document's text. Null and empty texts share nothing; items of fewer than `run` words can't leak; repeated rows are
    each reported; extra columns are ignored; empty tables give an empty result. Items travel to all tasks, at most
    ITEMS_MAX characters at a time; a larger set is scanned for in several rounds."""
    sized = items.filter("text is not null")
    total = sized.agg(F.sum(F.length("text"))).first()[0] or 0
    rounds = -(-total // ITEMS_MAX) if total else 1
    schema = "doc_id long, item_id long, start long, stop long, words int"
    parts = []
    for r in range(rounds):
        own = sized if rounds == 1 else sized.filter(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == r)
        known = [(x["item_id"], plain(x["text"]).decode("ascii").split()) for x in own.select("item_id", "text").toLocalIterator()]
        known = [(i, w) for i, w in known if len(w) >= run]
        held = documents.sparkSession.sparkContext.broadcast(known)
        name = uuid.uuid4().hex

        def scan(batches: Iterator[pa.RecordBatch], held=held, name=name) -> Iterator[pa.RecordBatch]:
            known = held.value
            found = kept(("automaton", name), lambda: build(known, run))
            for b in batches:
                rows = [(d, known[n][0], s, e, k) for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) if t.is_valid for n, s, e, k in passages(t.as_py(), known, found, run)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["doc_id", "item_id", "start", "stop", "words"])

        parts.append(documents.select("doc_id", "text").mapInArrow(scan, schema))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def leaks(documents: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """doc_id, item_id, each pair once."""
    return leaked_passages(documents, items, run).select("doc_id", "item_id").distinct()
