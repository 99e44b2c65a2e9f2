"""What scoring counts in a text: phrases, repeated sentences and paragraphs, languages of chunks.

Several hundred phrases are looked for in every text and in slices of it. One Arrow function over a batch does all
of that in one visit; as columns, each phrase is a pass of its own through interpreted expressions. The columns of
``text`` and ``language`` say the same and serve single uses.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import language, lexicon
from .text import CJK, WHITE

#: What one visit may count, with the fields of each.
PARTS = {
    "tokens": ("tokens",),
    "restarts": ("restarts",),
    "markers": ("strong", "medium", "weak", "double", "breaks"),
    "ending": ("concl", "delimiters", "uncertain", "closed", "echoed"),
    "checks": ("late_e", "late_i", "mid_e", "mid_i"),
    "repeats": ("paragraphs", "distinct_paragraphs", "sentences", "thrice"),
    "languages": ("langs", "plain_chars"),
    "problem": ("problem_tokens", "math", "code"),
}
_WHITE = "\t-\r \x85\xa0  -     　"
#: White space to ``str.split`` only.
_CONTROL = "\x1c\x1d\x1e\x1f"
_WORD = re.compile(f"[^{_WHITE}]+")
_END = re.compile("[.!?。！？]")
_CJK = re.compile(CJK)
_INDENT = f"[{_WHITE}]*".replace("\t-\r", "\t\x0b-\r")
_FENCED = re.compile(rf"(?:(?<=\n)|\A){_INDENT}```[^\n]*\n.*?(?:(?<=\n){_INDENT}```[^\n]*\n|\Z)", re.S)
#: Letters whose lower case is longer or depends on others.
_UNEVEN = re.compile("[\u0130\u03a3]")
#: Letters that match others than their lower case, or have two letters as theirs.
_ODD = re.compile("[\u017f\u212a\u0130]")
_LETTERS = regex.compile(r"\p{L}+")
#: The same for texts without letters beyond Latin ones.
_LATIN, _BEYOND = re.compile("[a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f]+"), re.compile("[\u0250-\U0010ffff]")
#: Before a letter: where a word begins.
_BEGIN = r"(?<![\p{Alphabetic}\p{M}\p{Nd}\p{Pc}‌‍])"
_RESTARTS = tuple((literal, re.compile(p.format(b="", s=f"[{_WHITE}]+")), regex.compile("(?i)" + p.format(b=_BEGIN, s=f"[{_WHITE}]+"))) for literal, p in lexicon.RESTARTS)
_FREE = regex.compile(_BEGIN)
#: Of a word, one in the digits to base 2^32 of each language that has it; so a sum counts for all languages at once.
_LANGS_OF: dict[str, int] = {}
_LANGS = sorted(language.WORDS)
for _k, _lang in enumerate(_LANGS):
    for _w in set(language.WORDS[_lang].split()):
        _LANGS_OF[_w] = _LANGS_OF.get(_w, 0) + (1 << 32 * _k)
#: Of plain text, all but letters to spaces.
_SPACED = {k: " " for k in range(128) if not chr(k).isalpha()}
_OWN = tuple((_LANGS.index(lang), tuple(letters[1:-1])) for lang, letters in language.LETTERS.items())
_SCRIPTS = tuple((lang, re.compile(letters), share) for lang, letters, share in language.SCRIPTS)
_HIGH = re.compile("[\u0400-\uffff]")


def _grouped(phrases: tuple[str, ...], *parts: str) -> tuple[tuple[bytes, tuple[bytes, ...]], ...]:
    """``phrases`` by what they share, so that one search rules many out; those beyond plain text come last."""
    plain, out = [p for p in phrases if p.isascii()], []
    for part in parts:
        out.append((part.encode(), tuple(p.encode() for p in plain if part in p)))
        plain = [p for p in plain if part not in p]
    out.append((b"", tuple(p.encode() for p in plain)))
    return tuple(out), tuple(p.encode() for p in phrases if not p.isascii())


_MARKERS = _grouped(lexicon.STRONG, ") ", "step "), _grouped(lexicon.MEDIUM), _grouped(lexicon.WEAK, "let me ")
_CHECKS = _grouped(lexicon.EXPLICIT, "check", "verify", "let me ", "confirm"), _grouped(lexicon.IMPLICIT, "consistent", "this ", "confirms", "expected")
_CONCLUSIONS, _DELIMITERS, _UNCERTAIN = (tuple([p.encode() for p in phrases if p.isascii() or not plain] for plain in (False, True)) for phrases in (lexicon.CONCLUSIONS, lexicon.DELIMITERS, lexicon.UNCERTAIN))
_MATH, _CODE = _grouped(lexicon.MATH_WORDS), _grouped(lexicon.CODE_WORDS)


def _total(b: bytes, groups, plain: bool) -> int:
    n = sum(sum(map(b.count, phrases)) for part, phrases in groups[0] if part in b)
    return n if plain else n + sum(map(b.count, groups[1]))


def words(text: str) -> list[str]:
    """Words between white space as Unicode has it."""
    return _WORD.findall(text) if any(c in text for c in _CONTROL) else text.split()


def tokens(text: str, found: list[str]) -> int:
    """The token count of a text with these words."""
    if len(found) == 1 and not text.isascii() and _CJK.search(text):
        return max(len(found[0]) // 2, 1)
    return len(found)


def _part(b: bytes, i: int, j: int | None = None) -> bytes:
    """``b`` between two places, both moved back to where a character begins."""
    def starts(i: int) -> int:
        while 0 < i < len(b) and b[i] & 0xC0 == 0x80:
            i -= 1
        return i

    return b[starts(i) : len(b) if j is None else starts(j)]


def without_code(text: str) -> str:
    """Lines outside of fenced code, each ended by a line feed."""
    lines = text.replace("\r\n", "\n")
    if lines and not lines.endswith("\n"):
        lines += "\n"
    return _FENCED.sub("", lines) if "```" in text else lines


def restarts(text: str, low: str) -> int:
    """Matches of all restart patterns."""
    if not text.isascii() and _ODD.search(text):
        return sum(len(p.findall(text)) for _, _, p in _RESTARTS)
    n = 0
    for literal, p, _ in _RESTARTS:
        at = 0
        while literal in low and (m := p.search(low, at)):  # the pattern, where a word begins
            begins = bool(_FREE.match(low, m.start()))
            n += begins
            at = m.end() if begins else m.start() + 1
    return n


def repeats(text: str) -> tuple[int, int, int, int]:
    """Paragraphs, different ones, sentences, and sentences that occur three times or more."""
    even = text.isascii() or not _UNEVEN.search(text)
    low = text.lower() if even else text  # where lower case is letter by letter, all at once
    paragraphs = []
    for p in low.split("\n\n"):
        found = words(p if even else p.lower())
        if tokens(p, found) >= 5:
            paragraphs.append(" ".join(found))
    cuts = [0]
    while m := _END.search(low, cuts[-1] + 10):  # a terminator ends a sentence from its eleventh character on
        cuts.append(m.end())
    rest = low[cuts[-1] :]
    if tokens(rest, words(rest)) >= 3:
        cuts.append(len(low))
    n, thrice = len(cuts) - 1, 0
    if n >= 3:
        sentences = (low[a:b] for a, b in zip(cuts, cuts[1:]))
        thrice = sum(k >= 3 for k in Counter(" ".join(words(p if even else p.lower())) for p in sentences).values())
    return len(paragraphs), len(set(paragraphs)), n, thrice


def _most(found: list[str], low: str) -> str:
    """The Latin language with the most words of its own among ``found`` and letters in ``low``."""
    packed = sum([_LANGS_OF[w] for w in found if w in _LANGS_OF])
    score = [packed >> 32 * k & 0xFFFFFFFF for k in range(len(_LANGS))]
    if not low.isascii():
        for k, letters in _OWN:
            score[k] += sum(map(low.count, letters))
    best = max(score)
    return _LANGS[score.index(best)] if best else "Eng"


def detect(chunk: str) -> str:
    """The language of a chunk."""
    if chunk.isascii():
        return _most(chunk.lower().translate(_SPACED).split(), "")
    n = len(chunk)
    if _HIGH.search(chunk):
        for lang, letters, share in _SCRIPTS:
            if len(letters.findall(chunk)) * share >= n:
                return lang
    low = chunk.lower()
    return _most((_LETTERS if _BEYOND.search(low) else _LATIN).findall(low), low)


def languages(plain: str, chunks: int, least: int) -> list[str]:
    """Languages of the chunks of ``least`` words or more; none for a short text."""
    total = len(plain)
    if total < 100:
        return []
    k = min(chunks, total)
    size = total // k
    cuts = [*range(0, k * size, size), total]
    letters = plain.lower().translate(_SPACED) if plain.isascii() else None
    out = []
    for a, b in zip(cuts, cuts[1:]):
        p = plain[a:b]
        if tokens(p, words(p)) >= least:
            out.append(_most(letters[a:b].split(), "") if letters is not None else detect(p))
    return out


def counted(parts: tuple[str, ...], chunks: int, least: int):
    """An Arrow function of text, its lower case (null for plain text), start of the answer, problem and its lower case to a struct of the fields of ``parts``."""
    fields = [f for p in parts for f in PARTS[p]]
    kinds = {f: pa.list_(pa.string()) if f == "langs" else pa.bool_() if f in ("closed", "echoed") else pa.int32() for f in fields}

    def one(x: str | None, low: str | None, snippet: str | None, problem: str | None, problem_low: str | None) -> list:
        x = x or ""
        low = x.lower() if low is None else low
        plain = low.isascii()
        out: list = []
        b = low.encode() if "markers" in parts or "ending" in parts or "checks" in parts else b""
        n = len(b)
        for p in parts:
            if p == "tokens":
                out.append(tokens(x, words(x)))
            elif p == "restarts":
                out.append(restarts(x, low))
            elif p == "markers":
                out += [_total(b, g, plain) for g in _MARKERS] + [x.count("\n\n"), x.count("\n")]
            elif p == "ending":
                tail = b if n < 200 else _part(b, n - (n * 55 // 100 if n < 800 else n * 40 // 100 if n < 2000 else n * 30 // 100))
                final = b if n < 200 else _part(b, n - n * 12 // 100)
                out += [sum([w in tail for w in _CONCLUSIONS[plain]]), sum([w in tail for w in _DELIMITERS[plain]]), sum([w in final for w in _UNCERTAIN[plain]])]
                out += [final.decode().rstrip(WHITE).endswith((".", "!", "。", "！")), (snippet or "").encode() in tail]
            elif p == "checks":
                late, middle = (b, b"") if len(low) < 50 else (_part(b, n - n * 40 // 100), _part(b, n // 4, n * 3 // 4))
                out += [_total(s, g, plain) for s in (late, middle) for g in _CHECKS]
            elif p == "repeats":
                out += repeats(x)
            elif p == "problem":
                problem = problem or ""
                q = problem.lower() if problem_low is None else problem_low
                signs = 0 if problem.isascii() else sum(map(problem.count, lexicon.MATH_SIGNS))
                out += [tokens(problem, words(problem)), signs + _total(q.encode(), _MATH, q.isascii()), _total(q.encode(), _CODE, q.isascii())]
            else:
                body = without_code(x)
                out += [languages(body, chunks, least), len(body)]
        return out

    def run(*columns: pa.Array) -> pa.Array:
        rows = [one(*r) for r in zip(*(c.to_pylist() for c in columns), strict=True)]
        made = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
        return pa.StructArray.from_arrays([pa.array(c, kinds[f]) for f, c in zip(fields, made, strict=True)], names=fields)

    # as it is costly, it must not be evaluated once for each field that is read
    return F.arrow_udf(run, "struct<" + ", ".join(f"{f}: {'array<string>' if f == 'langs' else 'boolean' if f in ('closed', 'echoed') else 'int'}" for f in fields) + ">").asNondeterministic()


def scan(parts: tuple[str, ...], chunks: int, least: int, x: str = "_x", low: str = "_lower", snippet: str | None = None, problem: str | None = None) -> Column:
    lower = lambda c, low: F.when(F.octet_length(c) > F.char_length(c), low)  # noqa: E731  # of plain text Python makes it
    none = F.lit("")
    return counted(parts, chunks, least)(F.col(x), lower(x, F.col(low)), F.col(snippet) if snippet else none, F.col(problem) if problem else none, lower(problem, F.lower(problem)) if problem else none)
