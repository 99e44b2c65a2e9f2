"""Text primitives as Spark columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon

CJK = "[㐀-䶿一-鿿぀-ヿ가-힯]"
TAGS = ("think", "reasoning", "thought")
#: A terminator ends a sentence once it is the eleventh character or a later one.
SENTENCE = r"(?s)\G.{10,}?[.!?。！？]"
_SPACES = r"(?U)\s+"
#: All that (?U)\s matches.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trim_u(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.btrim(c, F.lit(WHITE))


def extract_thinking(c: Column) -> Column:
    """What stands in the first of the tags that is opened and closed again, trimmed; else the whole text."""

    def inside(t: str) -> Column:
        after = F.substr(c, F.instr(c, F.lit(f"<{t}>")) + len(t) + 2)
        return F.when(F.contains(c, F.lit(f"<{t}>")) & F.contains(after, F.lit(f"</{t}>")), F.substring_index(after, f"</{t}>", 1))

    return trim_u(F.coalesce(*map(inside, TAGS), c))


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``c``, which is evaluated once however often ``use`` refers to it."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def token_count(c: Column) -> Column:
    """Words between white space; half of the characters for a single run that holds CJK."""
    chars = F.char_length(F.regexp_replace(c, _SPACES, ""))
    half = F.greatest((chars / 2).cast("int"), F.lit(1))
    return once(F.regexp_count(c, F.lit(r"(?U)\S+")), lambda n: F.when((n == 1) & F.regexp_like(c, F.lit(CJK)), half).otherwise(n))


def normalize(c: Column) -> Column:
    """Lower case, words joined by single spaces."""
    return F.regexp_replace(trim_u(F.lower(c)), _SPACES, " ")


def sentences(c: Column) -> Column:
    """Trimmed sentences: pieces that end in a terminator, and the rest if it has three words."""

    def trimmed(pieces: Column) -> Column:
        at = F.aggregate(pieces, F.lit(1), lambda n, p: n + F.char_length(p))  # where the rest begins
        rest = F.filter(F.array(trim_u(F.substr(c, at))), lambda r: token_count(r) >= 3)
        return F.concat(F.transform(pieces, trim_u), rest)

    return once(F.regexp_extract_all(c, F.lit(SENTENCE), F.lit(0)), trimmed)


def paragraphs(c: Column) -> Column:
    """Normalised paragraphs of five words or more."""
    return F.filter(F.transform(F.split(c, "\n\n", -1), normalize), lambda p: token_count(p) >= 5)


def _fixed(text: Column, index: Column) -> Column:
    """``index`` (bytes) moved back to where a character of the binary ``text`` begins."""
    inside = lambda i: (F.substring(text, i + 1, F.lit(1)) >= F.unhex(F.lit("80"))) & (F.substring(text, i + 1, F.lit(1)) <= F.unhex(F.lit("BF")))
    return F.when((index <= 0) | ~inside(index), index).when(~inside(index - 1), index - 1).when(~inside(index - 2), index - 2).otherwise(index - 3)


def byte_slice(binary: Column, start: Column, end: Column | None = None) -> Column:
    """The characters from one byte offset to another (to the end), both moved back to where a character begins."""
    a = _fixed(binary, start)
    b = _fixed(binary, end) if end is not None else F.octet_length(binary)
    return F.decode(F.substring(binary, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int")), "UTF-8")


def div(a: Column, b: int) -> Column:
    return F.floor(a / b).cast("int")


def tail(binary: Column) -> Column:
    """The end of a text in which a conclusion is looked for: all, 55, 40 or 30 per cent of its bytes."""
    n = F.octet_length(binary)
    return byte_slice(binary, n - F.when(n < 200, n).when(n < 800, div(n * 55, 100)).when(n < 2000, div(n * 40, 100)).otherwise(div(n.cast("long") * 30, 100)))


def final(binary: Column) -> Column:
    n = F.octet_length(binary)
    return byte_slice(binary, n - F.when(n < 200, n).otherwise(div(n.cast("long") * 12, 100)))


def late(binary: Column) -> Column:
    n = F.octet_length(binary)
    return byte_slice(binary, n - div(n.cast("long") * 40, 100))


def middle(binary: Column) -> Column:
    n = F.octet_length(binary)
    return byte_slice(binary, div(n, 4), div(n.cast("long") * 3, 4))


def count_phrase(c: Column, phrase: Column) -> Column:
    return ((F.octet_length(c) - F.octet_length(F.replace(c, phrase, F.lit("")))) / F.octet_length(phrase)).cast("int")


def phrase_array(phrases: tuple[str, ...]) -> Column:
    return F.split(F.lit("|".join(phrases)), r"\|")


def count_phrases(c: Column, phrases: tuple[str, ...]) -> Column:
    """Occurrences of each phrase, summed; phrases may overlap one another."""
    return once(c, lambda c: F.aggregate(phrase_array(phrases), F.lit(0), lambda n, p: n + count_phrase(c, p)))


def distinct_phrases(c: Column, phrases: tuple[str, ...]) -> Column:
    return once(c, lambda c: F.size(F.filter(phrase_array(phrases), lambda p: F.contains(c, p))))


def restarts(c: Column, low: Column) -> Column:
    """Matches of all restart patterns in ``c``; ``low`` is its lower case, in which a plain search rules most of them out."""
    odd = F.regexp_like(c, F.lit("[ſK]"))  # letters that match s and k but aren't their upper case
    total = F.lit(0)
    for literal, p in lexicon.RESTARTS:
        total = total + F.when(F.contains(low, F.lit(literal)) | odd, F.regexp_count(c, F.lit("(?iU)" + p.format(b=r"\b", s=r"\s+")))).otherwise(0)
    return total


def without_code(c: Column) -> Column:
    """Lines outside of fenced code, each ended by a line feed."""
    lines = F.replace(c, F.lit("\r\n"), F.lit("\n"))
    lines = F.when((lines == "") | F.endswith(lines, F.lit("\n")), lines).otherwise(F.concat(lines, F.lit("\n")))
    fenced = F.regexp_replace(lines, r"(?U)(?s)(?<=\n|^)[^\S\n]*```[^\n]*\n.*?(?:(?<=\n)[^\S\n]*```[^\n]*\n|\z)", "")
    return F.when(F.contains(c, F.lit("```")), fenced).otherwise(lines)


def chunks(c: Column, n: int) -> Column:
    """``n`` chunks of equal length in characters; the last takes the rest. ``c`` and its length are taken once, not for every chunk."""

    def cut(c: Column, total: Column) -> Column:
        k = F.least(F.lit(n), total)
        size = F.floor(total / k).cast("int")
        return F.transform(F.sequence(F.lit(0), k - 1), lambda i: c.substr(i * size + 1, F.when(i + 1 == k, total).otherwise(size)))

    return once(c, lambda c: once(F.char_length(c), lambda total: F.when(total > 0, cut(c, total)).otherwise(F.array().cast("array<string>"))))


def normalize_answer(c: Column) -> Column:
    return F.lower(trim_u(F.regexp_replace(trim_u(c), r"[.,]+$", "")))


_NUMBER = r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


def number(c: Column) -> Column:
    """A decimal number as double, null for anything else."""
    return F.when(F.regexp_like(c, F.lit(_NUMBER)), c.try_cast("double"))


def answers_match(answer: Column, expected: Column) -> Column:
    """Equal after normalisation, or numbers that differ by less than 1e-9."""
    a, b = normalize_answer(answer), normalize_answer(expected)
    return (a == b) | F.coalesce(F.abs(number(a) - number(b)) < 1e-9, F.lit(False))


def split_completion(raw: Column) -> tuple[Column, Column]:
    """Thinking and answer of a completion."""
    thinking = F.when(F.contains(raw, F.lit("<think>")), extract_thinking(raw)).otherwise("")
    return thinking, trim_u(F.substring_index(raw, "</think>", -1))


def judge_score(reply: Column, low: float = 0, high: float = 100) -> Column:
    """The first number in range after the word score, else the first in range at all."""
    def first(c: Column) -> Column:
        found = F.regexp_extract_all(c, F.lit(r"(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)"), F.lit(0))
        return F.get(F.filter(F.transform(found, lambda x: F.regexp_replace(x, r"\.$", "").try_cast("double")), lambda x: x.between(low, high)), F.lit(0))

    low_reply = F.lower(reply)
    after = F.when(F.contains(low_reply, F.lit("score")), F.substring(low_reply, F.locate("score", low_reply) + 5, F.char_length(low_reply)))
    return F.coalesce(first(after), first(low_reply))


def dataset_of(c: Column) -> Column:
    """An id without its last part."""
    return F.regexp_replace(c, "_[^_]*$", "")


def host_of(url: Column) -> Column:
    """Host and port of a URL, without scheme, path and user."""
    rest = F.regexp_replace(url, r"^[^:/?#]*://", "")
    return F.regexp_replace(F.regexp_extract(rest, r"^[^/?#]*", 0), r"^.*@", "")


def slug(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9.-]", "_")


def escape_html(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def head_tail(c: Column, limit: int = 12_000, head: int = 6_000, end: int = 4_000, mark: str = "\n[...]\n") -> Column:
    """A long text's beginning and end around a mark."""
    return F.when(F.char_length(c) > limit, F.concat(F.left(c, F.lit(head)), F.lit(mark), F.right(c, F.lit(end)))).otherwise(c)


def band(score: Column) -> Column:
    return F.when(score < 50, "red").when(score < 75, "amber").otherwise("green")


def css_band(avg: Column) -> Column:
    return F.when(avg >= 80, "good").when(avg >= 50, "okay").otherwise("bad")
