"""Personal data by candidate gradient boosting.

Generators with high recall propose overlapping spans: everything that may be an e-mail address, an
IP address, a card or a phone number, spelt out, split up or disguised. Boosted trees judge each
candidate by its format and its context: what stands next to it, how its run of digits goes on, and how
near words stand that speak of such data or of other numbers. A threshold calibrated on held-out
candidates selects. Spans that the plain patterns find always stay; the trees only add.

The trees learn from all documents; those of a quarter set the threshold instead. Made-up data in disguise
are planted in stretches of each, as are look-alikes such as dates, order and serial numbers: planted data
are positive. Negative are look-alikes, candidates that cut planted data wrongly, and all candidates of the
documents themselves that touch no plain span. So no label repeats a feature. Bins, trees and threshold come
from sums over all these candidates, wherever they lie.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BLOCK_ROWS, CODES, EQUAL_ROWS, STEP, Bins, Block, Boosted, Near, Spread, codes, counts, grown, total
from .shared import clear, keep, made, shared_folder, slices

KINDS = ("email", "ip", "card", "phone")
#: Candidates to learn from that the driver takes; more stay where they are, which gives the same trees.
NEAR_ROWS = 200_000
PRECISION = 0.99
#: Share of the held-out documents' own candidates that may be selected.
MOST_OWN = 0.001
#: Characters of context on each side.
AROUND = 32

_ANY = re.compile(r"[0-9@]")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a run of digits that can't begin a match can't end one or begin one within, so runs are taken whole
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# \+?\(?[0-9] and more digits, written so that the search jumps to what can begin it; so is _LOOSE_IP
_RUN = re.compile(r"[+(0-9](?:(?<=[0-9])|(?<=\()[0-9]|(?<=\+)\(?[0-9])(?:[ ().\-/]{0,2}[0-9])*+")
_GROUP = re.compile(r"\+?\(?[0-9]++")
#: Digits that a card and a phone number may have; 15 and the prefix 00 for the latter.
CARD_DIGITS, PHONE_DIGITS = (12, 19), (7, 17)
#: Groups of a stretch within a run; a whole run may have as many as digits.
GROUPS = 8
_LOOSE_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]{0,2}(?:(?: ?(?:\[\.\]|\(\.\)|\{\.\}|\[dot\]|\(dot\)|\.) ?| dot )[0-9]{1,3}){3}(?![0-9])")
# what every match of _LOOSE_MAIL ends in, from its at on; texts without it are not scanned for local parts
_HINT = re.compile(r"(?:(?:\(at\)|\[at\]|\{at\}|<at>|@) ?| at )[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\{dot\}) ?|\.| dot )[A-Za-z0-9-]", re.I)
_LOOSE_MAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?: ?(?:\(at\)|\[at\]|\{at\}|<at>|@) ?| at )[A-Za-z0-9-]{1,63}(?:(?: ?(?:\(dot\)|\[dot\]|\{dot\}) ?|\.| dot )[A-Za-z0-9-]{1,63}){1,5}", re.I)
_AT = re.compile(r" ?(?:\(at\)|\[at\]|\{at\}|<at>) ?| at ", re.I)
_DOT = re.compile(r" ?(?:\(dot\)|\[dot\]|\{dot\}|\[\.\]|\(\.\)|\{\.\}) ?| dot | ?\. ?", re.I)
#: Words that speak of each kind, and of other numbers.
_CUES = tuple(
    re.compile(rf"\b(?:{words})\b", re.I)
    for words in (
        r"e-?mails?|mail|contact|write|reach|correo|courriel|adresse|schreib\w*|escrib\w*|écri\w*",
        r"ips?|hosts?|server|address|node|addr|dirección|adresse|ping|login",
        r"cards?|visa|mastercard|amex|credit|debit|pay\w*|carte|karte|tarjeta|cc|kreditkarte",
        r"tel|phones?|call|fax|mobile|cell|whatsapp|sms|telefon\w*|téléphone|teléfono|anruf\w*|appel\w*|llam\w*|dial",
        r"version|release|section|isbn|issn|doi|page|pages|no|nr|id|order|license|serial|ticket|invoice|part|item|model|ref|date|since|total|look|arrive\w*|meet|visit|see|hosted|chapter|build|patent|commande|seite|página|bestellung|pedido",
    )
)
#: Made-up data and look-alikes that each document receives.
PLANTED = 2
#: Candidates whose features are held at once.
AT_ONCE = 50_000
#: Stands between texts that are read as one; no pattern crosses it and no context is seen beyond it.
BETWEEN = "\n" * (AROUND + 2)
#: Scores from here on, in log-odds, are 1.
SURE = 37
FEATURES = 40
_NONE = np.zeros(0, dtype=np.int64)


def luhn(digits: str) -> bool:
    total = 0
    for k, x in enumerate(reversed(digits)):
        d = ord(x) - 48
        if k & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) that the plain patterns find, in order; kind is a place in KINDS."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        left = at
        while left > done and text[left - 1] in _LOCAL_SET:
            left -= 1
        if left < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((left, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-18:]) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 38 and 12 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def _sums(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x) + 1, dtype=np.int64)
    np.cumsum(x, out=out[1:])
    return out


class Candidates:
    """What the generators propose in one text: ``start``, ``kind`` and ``end`` of each span; spans may overlap."""

    def __init__(self, text: str):
        self.text = text
        self._read = False
        self.start = self.kind = self.end = _NONE
        number = self._numbers()
        ips = [m.span() for m in _LOOSE_IP.finditer(text)]
        mails = [m.span() for m in _LOOSE_MAIL.finditer(text)] if _HINT.search(text) else []
        if not (len(number[0]) or ips or mails):
            return
        other = np.array(ips + mails, dtype=np.int64).reshape(-1, 2)
        kinds = np.r_[np.ones(len(ips), dtype=np.int64), np.zeros(len(mails), dtype=np.int64)]
        self.start, self.kind, self.end = (np.concatenate(x) for x in zip(number[:3], (other[:, 0], kinds, other[:, 1]), strict=True))
        self.runs = [np.concatenate([x, np.zeros(len(other), dtype=np.int64)]) for x in number[3:]]

    def __len__(self) -> int:
        return len(self.start)

    def _numbers(self) -> list[np.ndarray]:
        """Of each run of digit groups all stretches of up to GROUPS groups that have a permitted number of digits, and the run itself.

        With start, kind and end: largest, smallest, first and last group, and digits of the run before and after.
        """
        groups, run = [], []
        for k, m in enumerate(_RUN.finditer(self.text)):
            if m.end() - m.start() >= PHONE_DIGITS[0]:
                found = [g.span() for g in _GROUP.finditer(self.text, m.start(), m.end())]
                groups += found
                run += [k] * len(found)
        if not groups:
            return [_NONE] * 9
        g, run = np.array(groups, dtype=np.int64), np.array(run)
        code = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        digit = _sums((code >= 48) & (code <= 57))
        size = digit[g[:, 1]] - digit[g[:, 0]]
        total = _sums(size)
        head = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        run_from = np.repeat(total[head], np.diff(np.r_[head, len(run)]))
        run_to = np.repeat(total[np.r_[head[1:], len(run)]], np.diff(np.r_[head, len(run)]))
        most, least, out = size, size, []

        def add(i: np.ndarray, n: np.ndarray | int, high: np.ndarray, low: np.ndarray) -> None:
            """Stretches of ``n`` more groups from each group of ``i``."""
            digits = total[i + n + 1] - total[i]
            for kind, (few, many) in ((2, CARD_DIGITS), (3, PHONE_DIGITS)):
                hit = np.flatnonzero((digits >= few) & (digits <= many))
                x, y = i[hit], (i + n)[hit]
                out.append([g[x, 0], np.full(len(x), kind), g[y, 1], high[hit], low[hit], size[x], size[y], total[x] - run_from[x], run_to[x] - total[y + 1]])

        for n in range(min(GROUPS, len(run))):
            last = size[n:]
            most, least = np.maximum(most[: len(last)], last), np.minimum(least[: len(last)], last)
            i = np.flatnonzero((run[n:] == run[: len(last)]) & (total[n + 1 :] - total[: len(last)] <= CARD_DIGITS[1]))
            if not len(i):
                break
            add(i, n, most[i], least[i])
        long_ = np.diff(np.r_[head, len(run)]) > GROUPS
        if long_.any():
            add(head[long_], (np.diff(np.r_[head, len(run)]) - 1)[long_], np.maximum.reduceat(size, head)[long_], np.minimum.reduceat(size, head)[long_])
        return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [_NONE] * 9

    def without(self, spans: list[tuple[int, int, int]]) -> np.ndarray:
        """Places of the candidates that touch none of ``spans``."""
        if not spans:
            return np.arange(len(self))
        mask = np.zeros(len(self.text), dtype=bool)
        for s, _, e in spans:
            mask[s:e] = True
        sums = _sums(mask)
        return np.flatnonzero(sums[self.end] == sums[self.start])

    def _prepare(self) -> None:
        text = self.text
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        digit = (code >= 48) & (code <= 57)
        letter = ((code | 32) >= 97) & ((code | 32) <= 122) | (code >= 0xC0)
        space = (code == 32) | (code >= 9) & (code <= 13)
        #: 0 outside or white, 1 letter, 2 digit, 3 other
        self._class = np.r_[np.where(space, 0, np.where(letter, 1, np.where(digit, 2, 3))), 0, 0].astype(np.int8)
        self._code = np.r_[code, 0]
        self._digits = _sums(digit)
        self._groups = _sums(digit & ~np.r_[False, digit[:-1]])
        self._signs = [_sums(code == ord(c)) for c in "- ./("]
        order = np.cumsum(digit) - 1
        value = np.where(digit, code.astype(np.int64) - 48, 0)
        double = np.where(digit, value * 2 - 9 * (value > 4), 0)
        self._luhn = [_sums(np.where(order % 2 == k, value, double)) for k in (0, 1)]
        found = [[m.span() for m in c.finditer(text)] for c in _CUES]
        self._cues = [(np.array([-(1 << 40), *(e for _, e in f)]), np.array([*(s for s, _ in f), 1 << 40])) for f in found]
        self._read = True

    def features(self, at: np.ndarray) -> np.ndarray:
        """Format and context of the candidates at these places, (FEATURES, candidates)."""
        if not self._read:
            self._prepare()
        s, k, e = self.start[at], self.kind[at], self.end[at]
        out = np.zeros((FEATURES, len(at)), dtype=np.float32)
        digits = self._digits[e] - self._digits[s]
        last = self._digits[e] - 1
        luhn_sum = np.where(last % 2 == 0, self._luhn[0][e] - self._luhn[0][s], self._luhn[1][e] - self._luhn[1][s])
        first = self._code[s]
        signs = [x[e] - x[s] for x in self._signs]
        before = np.where(s > 0, self._class[s - 1], 0)
        rows = [k, digits, e - s, self._groups[e] - self._groups[s], *(x[at] for x in self.runs), (luhn_sum % 10 == 0) & (k == 2), first == 43, *signs, sum((x > 0).astype(int) for x in signs[:4])]
        rows += [(first == 48) & (self._code[s + 1] == 48), (first - 48) * 10 + np.where((self._code[s + 1] >= 48) & (self._code[s + 1] <= 57), self._code[s + 1] - 48, 0).astype(np.int64)]
        rows += [before, self._class[e], np.where(s > 1, self._class[s - 2], 0), self._class[np.minimum(e + 1, len(self._class) - 1)]]
        near = np.stack([np.minimum(s - ends[np.searchsorted(ends, s, side="right") - 1], AROUND) for ends, _ in self._cues])
        rows += [near[np.minimum(k, 3), np.arange(len(at))], near[4], np.where(np.arange(4)[:, None] == k, AROUND, near[:4]).min(axis=0)]
        ahead = np.stack([np.minimum(starts[np.searchsorted(starts, e)] - e, AROUND) for _, starts in self._cues])
        rows += [ahead[np.minimum(k, 3), np.arange(len(at))], ahead[4]]
        n = len(rows)
        for j, x in enumerate(rows):
            out[j] = x
        for j in np.flatnonzero(k < 2).tolist():
            span = self.text[s[j] : e[j]]
            out[n:, j] = (_mail_features if k[j] == 0 else _ip_features)(span, FEATURES - n)
        return out


def _mail_features(span: str, n: int) -> list[float]:
    sign = _AT.search(span) or re.search(r" ?@ ?", span)
    local, domain = span[: sign.start()], span[sign.end() :]
    dots = [m.group() for m in _DOT.finditer(domain)]
    labels = _DOT.split(domain)
    out = [
        len(local), sum(map(str.isdigit, local)), sum(c in "._+-" for c in local), float(local.islower()), len(dots), len(labels[-1]), float(labels[-1].isalpha() and labels[-1].islower()),
        float("@" in sign.group()), float(sign.group().strip().isalpha()), float(any(d.strip() == "." for d in dots)), float(any(d.strip().isalpha() for d in dots)), float(any(d == "." for d in dots)), float(labels[0].islower()),
    ]
    return (out + [0.0] * n)[:n]


def _ip_features(span: str, n: int) -> list[float]:
    parts = [int(x) for x in re.findall("[0-9]+", span)]
    sign = re.search("[0-9]([^0-9]+)", span)[1]
    return ([max(parts), min(parts), sum(p > 9 for p in parts), float("[" in sign or "(" in sign or "{" in sign), float("dot" in sign), sign.count(" ")] + [0.0] * n)[:n]


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) that the generators propose; they may overlap."""
    c = Candidates(text)
    return list(zip(c.start.tolist(), c.kind.tolist(), c.end.tolist(), strict=True))


def _digits_of(rng: random.Random, n: int) -> str:
    return str(rng.randrange(10 ** (n - 1), 10**n))


def _name(rng: random.Random) -> str:
    return "".join(rng.choice("bcdfglmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))


def _in_fours(digits: str, sep: str) -> str:
    return sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))


def _card(rng: random.Random) -> str:
    body = rng.choice("3456") + _digits_of(rng, rng.choice([12, 13, 14, 14, 14, 14, 15, 17]))
    return body + next(c for c in "0123456789" if luhn(body + c))


def _made_up(rng: random.Random) -> tuple[int, str, str, str]:
    """Kind (-1 for a look-alike), what stands before, the span, what stands after."""
    kind = rng.choice([0, 1, 2, 3, 3, -1, -1, -1, -1, -1])
    d = lambda n: _digits_of(rng, n)
    cue = lambda *words: rng.choice([*(f"{w}{x} " for w in words for x in ("", ":", " is")), "", ""])
    doc = lambda: rng.choice(["order ", "ISBN ", "no. ", "ref ", "serial ", "invoice ", "id ", "total ", "page ", "", "", ""])
    if kind == 0:
        at, dot = rng.choice([(" at ", " dot "), ("(at)", "."), (" [at] ", " [dot] "), ("{at}", "{dot}"), (" (AT) ", " (DOT) "), (" @ ", "."), (" at ", "."), ("<at>", "."), (" AT ", " DOT ")])
        local = rng.choice([_name(rng), f"{_name(rng)}.{_name(rng)}", f"{_name(rng)}{rng.randint(1, 99)}", f"{_name(rng)}_{_name(rng)}"])
        domain = dot.join([_name(rng), *([_name(rng)] if rng.random() < 0.2 else []), rng.choice(["com", "org", "net", "de", "fr", "es", "io", "co.uk".replace(".", dot)])])
        before = rng.choice(["mail ", "email: ", "write to ", "contact ", "reach me: ", "correo: "]) if at == " at " and dot == "." else cue("mail", "email", "write to", "contact", "courriel", "correo")
        return 0, before, local + at + domain, ""
    if kind == 1:
        return 1, cue("ip", "host", "server", "address", "node"), rng.choice(["[.]", " . ", "(.)", " dot ", "[dot]", "{.}"]).join(str(rng.randint(0 if k else 1, 255)) for k in range(4)), ""
    if kind == 2:
        n = _card(rng)
        if rng.random() < 0.3:  # the expiry date is none of it
            return 2, cue("card", "visa", "carte", "tarjeta"), _in_fours(n, rng.choice([" ", "-"])), f" {rng.randint(1, 12):02d}/{rng.randint(24, 33)}"
        return 2, cue("card", "visa", "credit card", "pay by", "karte"), _in_fours(n, rng.choice([".", "/", "- ", ". "])), ""
    if kind == 3:
        form = rng.randrange(9)
        words = ("call", "tel", "phone", "fax", "mobile", "telefon", "téléphone")
        if form < 4:
            span = (f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"00{d(2)} {d(3)} {d(3)} {d(3)}", f"+{d(2)}.{d(3)}.{d(3)}.{d(3)}")[form]
            if rng.random() < 0.3:  # in a list or table
                return 3, rng.choice([f"{rng.randint(2020, 2026)}-{rng.randint(1, 12):02d}-{rng.randint(10, 28)} ", f"{rng.randint(1, 99)} "]), span, rng.choice(["", f" {rng.randint(1, 9)}"])
            return 3, cue(*words), span, ""
        span = (f"{d(3)}.{d(3)}.{d(4)}", f"+{d(2)}/{d(3)}/{d(6)}", f"0{d(2)} {d(4)} {d(4)}", d(10), f"0{d(3)}/{d(7)}")[form - 4]
        return 3, rng.choice([f"{w}{x} " for w in words for x in ("", ":", " is")]), span, ""  # only words tell these from other numbers
    form = rng.randrange(14)
    y, m, n = rng.randint(1950, 2030), rng.randint(1, 12), rng.randint(1, 28)
    bad = _card(rng)
    bad = bad[:-1] + str((int(bad[-1]) + rng.randint(1, 9)) % 10)
    span = (
        f"{y}-{m:02d}-{n:02d} {rng.randint(10, 23)}", f"97{rng.choice('89')}-{d(1)}-{d(2)}-{d(6)}-{d(1)}", d(rng.randint(7, 19)), f"{y}-{y + rng.randint(1, 60)}", bad, _in_fours(bad, rng.choice(". /-")), f"{d(3)}.{d(3)}.{d(4)}",
        f"{d(2)} {d(3)} {d(3)} {d(3)}", f"{n:02d}/{m:02d}/{y} {d(3)}", f"{d(4)} {d(4)}", f"0{d(2)} {d(4)} {d(4)}", f"{rng.choice(['look', 'us', 'arrive', 'them', _name(rng)])} at {_name(rng)}.{rng.choice(['com', 'org', 'net', 'Then', 'The'])}", f"{rng.randint(1, 9)} . {rng.randint(0, 40)} . {rng.randint(0, 40)} . {rng.randint(0, 9)}", d(10),
    )[form]
    before = rng.choice(["", "", "visit "]) if form == 11 else rng.choice(["version ", "section ", "release "]) if form == 12 else doc()
    return -1, before, span, ""


def examples_of(texts: list[str], seeds: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """From documents: features (FEATURES, rows), labels, whether a row is of the document itself, and the document's place."""
    pieces, planted, size = [], [], 0
    for i, (text, seed) in enumerate(zip(texts, seeds, strict=True)):
        c = Candidates(text)
        if len(c):
            at = c.without(base_spans(text))
            for part in (at[k : k + AT_ONCE] for k in range(0, len(at), AT_ONCE)):
                yield c.features(part), np.zeros(len(part), dtype=bool), np.ones(len(part), dtype=bool), np.full(len(part), i)
        rng = random.Random(seed)
        piece = ""
        for _ in range(PLANTED):
            kind, before, span, after = _made_up(rng)
            p = text.find(" ", rng.randrange(len(text) + 1)) + 1  # a word's beginning, or the text's
            piece += text[max(0, p - 2 * AROUND) : p] + before
            planted.append((i, size + len(piece), kind, size + len(piece) + len(span)))
            piece += f"{span}{after}{rng.choice([' ', '. ', ', '])}{text[p : p + 2 * AROUND]} "
        pieces.append(piece + BETWEEN)
        size += len(pieces[-1])
    text = "".join(pieces)
    c = Candidates(text)
    if not len(c):
        return
    free = c.without(base_spans(text))
    free = free[np.argsort(c.start[free], kind="stable")]
    start, end = c.start[free], c.end[free]
    longest = int((end - start).max(initial=0))
    rows, label, doc = [], [], []
    for i, s, kind, e in planted:
        lo, hi = np.searchsorted(start, [s - longest, e])  # all that may touch it
        at = free[lo:hi][end[lo:hi] > s]
        rows.append(at)
        label.append((c.kind[at] == kind) & (np.abs(c.start[at] - s) <= 1) & (c.end[at] == e))
        doc.append(np.full(len(at), i))
    at, y, place = np.concatenate(rows), np.concatenate(label), np.concatenate(doc)
    for k in range(0, len(at), AT_ONCE):
        part = slice(k, k + AT_ONCE)
        yield c.features(at[part]), y[part], np.zeros(len(at[part]), dtype=bool), place[part]


def examples(text: str, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From one document: features (FEATURES, rows), labels, and whether a row is of the document itself."""
    got = [g[:3] for g in examples_of([text], [seed])]
    if not got:
        return np.zeros((FEATURES, 0), dtype=np.float32), np.zeros(0, dtype=bool), np.zeros(0, dtype=bool)
    x, y, own = zip(*got, strict=True)
    return np.concatenate(x, axis=1), np.concatenate(y), np.concatenate(own)


class Model:
    """Trees and the threshold that selects; without trees nothing is added."""

    def __init__(self, trees: Boosted | None, threshold: float):
        self.trees, self.threshold = trees, threshold

    def spans(self, texts: list[str]) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
        """For each text its base spans and all its spans."""
        out: list[tuple[list, list]] = []
        chosen: dict[int, list[tuple[float, int, int, int]]] = {}
        held: list[tuple[int, Candidates, np.ndarray]] = []
        size = 0

        def judge() -> None:
            nonlocal held, size
            if held:
                p = self.trees.score(np.concatenate([c.features(at) for _, c, at in held], axis=1).T, self.threshold)
                done = 0
                for i, c, at in held:
                    mine = p[done : done + len(at)]
                    done += len(at)
                    hit = np.flatnonzero(mine >= self.threshold)
                    if len(hit):
                        x = at[hit]
                        chosen.setdefault(i, []).extend(zip((-mine[hit]).tolist(), c.start[x].tolist(), c.kind[x].tolist(), c.end[x].tolist(), strict=True))
            held, size = [], 0

        for i, text in enumerate(texts):
            base = base_spans(text) if _ANY.search(text) else []
            out.append((base, list(base)))
            if not self.trees:
                continue
            c = Candidates(text)
            if not len(c):
                continue
            at = c.without(base)
            for part in (at[k : k + AT_ONCE] for k in range(0, len(at), AT_ONCE)):
                held.append((i, c, part))
                size += len(part)
                if size >= AT_ONCE:
                    judge()
        judge()
        for i, found in chosen.items():
            taken: list[int] = []  # ascending starts and ends by turns, of spans apart
            for _, s, k, e in sorted(found):  # the likelier of overlapping ones
                at = bisect_right(taken, s)
                if at % 2 == 0 and (at == len(taken) or taken[at] >= e):
                    taken[at:at] = [s, e]
                    out[i][1].append((s, k, e))
            out[i][1].sort()
        return out


def _held(seed: int) -> bool:
    return (seed >> 24) % 4 == 0


def staged(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the candidates of all documents, as (held, n, body): codes of the features, label and whether it is the document's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=1)
        wait: dict[bool, list[np.ndarray]] = {False: [], True: []}

        def block(held: bool) -> pa.RecordBatch:
            rows = np.concatenate(wait[held], axis=1)
            wait[held] = []
            return pa.RecordBatch.from_arrays([pa.array([held]), pa.array([rows.shape[1]], pa.int32()), pa.array([zip_.compress(rows.tobytes())], pa.binary())], names=["held", "n", "body"])

        for batch in slices(batches):
            seeds = batch.column(0).to_pylist()
            out = np.array([_held(h) for h in seeds])
            for x, y, own, place in examples_of([t.as_py() or "" for t in batch.column(1)], seeds):
                rows = np.concatenate([codes(x), [y.astype(np.uint8), own.astype(np.uint8)]])
                for held in (False, True):
                    mine = rows[:, out[place] == held]
                    if mine.shape[1]:
                        wait[held].append(mine)
                        if sum(w.shape[1] for w in wait[held]) >= BLOCK_ROWS:
                            yield block(held)
        yield from (block(held) for held in (False, True) if wait[held])

    chosen = docs.select(F.coalesce(F.xxhash64(F.col(id_col)), F.lit(0)).alias("h"), F.col(text_col).cast("string").alias("text"))
    return keep(chosen.mapInArrow(run, "held boolean, n int, body binary"), path, compression="none")


def _rows(n: int, body: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(body), dtype=np.uint8).reshape(FEATURES + 2, n)


def _read(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    return (_rows(n, body.as_py()) for n, body in zip(batch.column("n").to_pylist(), batch.column("body"), strict=True))


def _many(parts: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """The rows of ``parts`` in arrays of about EQUAL_ROWS."""
    wait: list[np.ndarray] = []
    for part in parts:
        wait.append(part)
        if sum(w.shape[1] for w in wait) >= EQUAL_ROWS:
            yield np.concatenate(wait, axis=1)
            wait = []
    if wait:
        yield np.concatenate(wait, axis=1)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near_rows: int = NEAR_ROWS) -> Model:
    """Trains on the candidates of all documents; a quarter of these, by a hash of their ids, set the threshold.

    Up to ``near_rows`` candidates to learn from are added up by the driver, more by tasks. Seeds are hashes of ids,
    and sums are of whole numbers, so the model depends on the rows alone.
    """
    begun = made()
    at = shared_folder(docs.sparkSession, "candidates")
    table = staged(docs, at, id_col, text_col)
    learn, held = table.filter("not held").select("n", "body"), table.filter("held").select("n", "body")
    parts = table.rdd.getNumPartitions()
    count = total(learn, parts, lambda batch: sum(counts(rows) for rows in _read(batch)), (FEATURES + 2, CODES)).astype(np.int64)
    wrong, right = count[FEATURES, :2].tolist()
    model = Model(None, 2.0)
    if wrong and right:
        bins, trees = Bins(count[:FEATURES]), Boosted(depth=4)
        base = trees.start(wrong + right, right)
        if wrong + right <= near_rows:
            rows = np.concatenate([_rows(r.n, r.body) for r in learn.collect()], axis=1)
            trees.grow(Near(list(Block.of(rows[:FEATURES], rows[FEATURES], bins, base)), bins))
        else:

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for rows in _many(r for batch in batches for r in _read(batch)):
                    for b in Block.of(rows[:FEATURES], rows[FEATURES], bins, base):
                        yield pa.RecordBatch.from_arrays([pa.array([len(b.y)], pa.int32()), pa.array([b.packed()], pa.binary())], names=["n", "body"])

            trees.grow(Spread(learn.mapInArrow(run, Spread.SCHEMA), bins))
        model = Model(trees, _calibrated(held, trees.steps, bins, base))
    clear(docs.sparkSession, begun)
    return model


def _calibrated(held: DataFrame, trees: list, bins: Bins, base: int) -> float:
    """The threshold by all candidates of the held-out documents, counted by score; scores below 0.5 can't be it and are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in _read(batch):
                f = grown(bins.of(r[:FEATURES]), trees, np.full(r.shape[1], base, dtype=np.int32))
                score, to = np.unique(np.clip(f, -1, SURE * STEP), return_inverse=True)
                sums = [np.bincount(to, w, minlength=len(score)).astype(np.int64) for w in (np.ones(len(f)), r[FEATURES], r[FEATURES + 1])]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (score, *sums)], names=["f", "n", "y", "own"])

    got = held.mapInArrow(run, "f long, n long, y long, own long").groupBy("f").agg(*(F.sum(c).alias(c) for c in ("n", "y", "own"))).collect()
    f, n, y, own = (np.array([r[c] for r in got], dtype=np.int64) for c in ("f", "n", "y", "own"))
    return threshold(1 / (1 + np.exp(f / -STEP)), y, own, n)


def train(x: np.ndarray, y: np.ndarray, own: np.ndarray, held: np.ndarray) -> Model:
    """Trees on the rows that aren't held out; those held out set the threshold."""
    if len(set(y[~held].tolist())) < 2:
        return Model(None, 2.0)
    trees = Boosted(depth=4).fit(x[~held], y[~held])
    return Model(trees, threshold(trees.score(x[held]), y[held], own[held]))


def threshold(p: np.ndarray, y: np.ndarray, own: np.ndarray, size: np.ndarray | None = None, precision: float = PRECISION, most: float = MOST_OWN) -> float:
    """The smallest score from 0.5 on at which the candidates selected reach ``precision`` and no more than a share ``most`` of the documents' own are among them; 2 if there is none.

    With ``size`` each score stands for so many candidates, and ``y`` and ``own`` are numbers of them.
    """
    if not len(p):
        return 2.0
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(y[order]) / np.cumsum(np.ones(len(p)) if size is None else size[order])
    good = (right >= precision) & (np.cumsum(own[order]) <= most * own.sum()) & (p[order] >= 0.5) & np.r_[p[order][1:] != p[order][:-1], True]
    return float(p[order][np.flatnonzero(good)[-1]]) if good.any() else 2.0


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """One row per row of ``docs``: id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    The counts and base_sha256 are of the plain patterns' spans; spans lists these and what the trees
    add, as kind:start:end in code points, by start and kind. A null text is empty. Null and repeated ids
    stay as they are; an empty table gives an empty result; other columns are not looked at. Without
    candidates to learn from, nothing is added. Whole texts are read, in time linear in their length.
    """
    model = model or fit(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = model.spans([t.as_py() or "" for t in batch.column(1)])
            counts = [pa.array([sum(s[1] == k for s in base) for base, _ in found], pa.int64()) for k in range(4)]
            sha = [hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(sha, pa.string()), pa.array([_joined(s) for _, s in found], pa.string())], names=["row_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    out = docs.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "row_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    return out.withColumnRenamed("row_id", id_col)


def redact_pii(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", model: Model | None = None) -> DataFrame:
    """``docs`` with every span in ``text_col`` replaced by its kind in brackets; all rows and columns stay, null texts too."""
    model = model or fit(docs, id_col, text_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(at).to_pylist()
            found = model.spans([t or "" for t in texts])
            new = []
            for text, (_, spans) in zip(texts, found, strict=True):
                if spans:
                    parts, done = [], 0
                    for s, k, e in spans:
                        if s >= done:
                            parts += [text[done:s], f"[{KINDS[k].upper()}]"]
                        done = max(done, e)
                    text = "".join(parts) + text[done:]
                new.append(text)
            yield batch.set_column(at, batch.schema.names[at], pa.array(new, pa.string()))

    return docs.mapInArrow(run, docs.schema)
