"""Spans of a reasoning text: restarts, announced checks, repeated sentences; offsets are UTF-8 bytes.

A text's spans and segments need no other text, so they are found where it lies; a row is a text of its own, also
where ids repeat.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import lexicon
from ..functions import text as t
from ..functions.scan import words

#: Patterns of starting over, after what each match holds in lower case; the second for the lower case of plain text, where a match counts if it begins a word.
_RESTARTS = [(literal, regex.compile("(?i)" + p.format(b=r"\b", s=r"\s+")), re.compile(p.format(b="", s=r"[\t-\r ]+"))) for literal, p in lexicon.RESTARTS]
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_")
#: Letters that match s, k and i whatever the case, and aren't their upper case.
_ODD = re.compile("[\u017f\u212a\u0130\u0131]")
#: Letters whose lower case is longer or depends on others.
_UNEVEN = re.compile("[\u0130\u03a3]")
_END = re.compile("[.!?。！？]")
SCHEMA = "id string, start int, end int, kind string, note string"
#: Texts of which rows are returned at once.
AT_ONCE = 500


def _bytes(text: str, spans: list[tuple]) -> list[tuple]:
    """``spans`` of ``text`` (start, end, ...) with places in bytes for those in characters."""
    if not spans or text.isascii():
        return spans
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    at = np.zeros(len(points) + 1, "i8")
    np.cumsum(1 + (points > 0x7F).view("i1") + (points > 0x7FF).view("i1") + (points > 0xFFFF).view("i1"), out=at[1:])
    return [(int(at[a]), int(at[b]), *rest) for a, b, *rest in spans]


def _begun(p: re.Pattern, low: str) -> Iterator[re.Match]:
    """Matches in plain text that begin a word, as if ``p`` said so."""
    at = 0
    while m := p.search(low, at):
        begins = m.start() == 0 or low[m.start() - 1] not in _WORD
        if begins:
            yield m
        at = m.end() if begins else m.start() + 1


def phrase_spans(text: str) -> list[tuple[int, int, str, str]]:
    """Restart and verification spans of one text, by start and end."""
    plain = text.isascii()
    low, back = text.lower(), None
    if not plain and _UNEVEN.search(text):  # places are carried along
        letters = [ch.lower() for ch in text]
        low, back = "".join(letters), [i for i, c in enumerate(letters) for _ in c]
    odd = not plain and _ODD.search(text)
    out = []
    for literal, p, lower in _RESTARTS:
        if odd or literal in low:
            out += [(m.start(), m.end(), "restart", "starts over") for m in (_begun(lower, low) if plain else p.finditer(text))]
    for phrase in lexicon.EXPLICIT:
        i = low.find(phrase)
        while i >= 0:
            end = i + len(phrase)
            a, b = (back[i], back[end - 1] + 1) if back else (i, end)
            out.append((a, b, "verification", "checks itself"))
            i = low.find(phrase, end)
    return sorted(_bytes(text, out))


def pieces(text: str) -> Iterator[tuple[int, int]]:
    """Consecutive pieces, each up to a terminator that is its eleventh character or a later one, the last one the rest."""
    at = 0
    while m := _END.search(text, at + 10):
        yield at, m.end()
        at = m.end()
    if at < len(text):
        yield at, len(text)


def repeated(text: str) -> list[tuple[int, int, str, int]]:
    """Sentences of 15 characters or more that stood in the text before: start, end, wording, and their number."""
    seen, out = Counter(), []
    for a, b in pieces(text):
        norm = " ".join(words(text[a:b].lower()))
        if len(norm) >= 15:
            seen[norm] += 1
            if seen[norm] > 1:
                out.append((a, b, norm, seen[norm]))
    return _bytes(text, out)


def spans_of(text: str) -> list[tuple[int, int, str, str]]:
    """All spans of one text."""
    return phrase_spans(text) + [(a, b, "repetition", f"occurrence {nth}") for a, b, _, nth in repeated(text)]


def sweep(size: int, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Segments from 0 to ``size`` between all edges of spans (start, end, kind), each with the kinds that cover it."""
    begins, ends = defaultdict(list), defaultdict(list)
    for a, b, kind in spans:
        if (a := max(a, 0)) < (b := min(b, size)):
            begins[a].append(kind)
            ends[b].append(kind)
    edges = sorted({0, size, *begins, *ends})
    over, out = Counter(), []
    for a, b in zip(edges, edges[1:]):
        over.update(begins.get(a, ()))
        over.subtract(ends.get(a, ()))
        out.append((a, b, ",".join(sorted(k for k, n in over.items() if n > 0))))
    return out


def _each(df: DataFrame, find: Callable, schema: str) -> DataFrame:
    """Rows (id, ...) of ``find`` of the other columns of each row of ``df`` (id, ...)."""
    kinds = [{"string": pa.string(), "int": pa.int32()}[f.dataType.simpleString()] for f in StructType.fromDDL(schema)]
    names = [f.name for f in StructType.fromDDL(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, len(whole), AT_ONCE):
                rows = [(i, *r) for i, *x in zip(*(c.to_pylist() for c in whole.slice(k, AT_ONCE).columns), strict=True) for r in find(*x)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return df.mapInArrow(run, schema)


def _texts(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").cast("string").alias("id"), t.extract_thinking(F.col("thinking")).alias("x"))


def repetitions(df: DataFrame) -> DataFrame:
    """Sentences of 15 characters or more of ``df`` (id, x) that stood in the text before, with their number."""
    found = _each(df.select("id", "x"), lambda x: repeated(x or ""), "id string, start int, end int, norm string, nth int")
    return found.select("id", "start", "end", F.lit("repetition").alias("kind"), F.concat(F.lit("occurrence "), F.col("nth").cast("string")).alias("note"), "norm", "nth")


def annotate(df: DataFrame) -> DataFrame:
    """All spans of ``df`` (id, thinking), ordered by id, start and end."""
    return _each(_texts(df), lambda x: spans_of(x or ""), SCHEMA).orderBy("id", "start", "end")


def text_segments(df: DataFrame) -> DataFrame:
    """``segments`` of all spans of ``df`` (id, thinking), text by text; empty texts have none."""
    return _each(_texts(df), lambda x: sweep(len(x.encode()), [s[:3] for s in spans_of(x)]) if x else [], "id string, start int, end int, kinds string")


def segments(spans: DataFrame, lengths: DataFrame) -> DataFrame:
    """A flat partition of each text: (id, start, end, kinds) between all edges of spans (id, start, end, kind) and the ends in ``lengths`` (id, len)."""
    found = spans.groupBy("id").agg(F.collect_list(F.struct("start", "end", "kind")).alias("spans"))
    rows = lengths.select("id", "len").join(found, "id", "left").withColumn("id", F.col("id").cast("string"))
    ends = lambda s, n: (s["start"] or 0, n if s["end"] is None else s["end"], s["kind"])
    return _each(rows, lambda n, found: sweep(n, [ends(s, n) for s in found or ()]), "id string, start int, end int, kinds string")


def repetition_groups(df: DataFrame) -> DataFrame:
    """Repeated sentences by wording without closing punctuation: occurrences and the first repeat's start."""
    key = F.regexp_replace("norm", r"[.!?,;:。！？，；：]+$", "")
    return repetitions(df).groupBy("id", key.alias("key")).agg((F.count("*") + 1).alias("total"), F.min("start").alias("first"))
