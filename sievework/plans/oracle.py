"""The same operators in DuckDB SQL, written apart from the Spark expressions; only phrase lists and patterns are shared."""

from __future__ import annotations

from ..functions import language as lid
from ..functions import lexicon
from ..functions.knots import KNOTS
from . import traces

_SET = r"\t\n\x0b\x0c\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS, NWS = f"[{_SET}]", f"[^{_SET}]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def trim(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{WS}+', ''), '{WS}+$', '')"


def n_of(c: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({c}, {q(pattern)})) AS INT)"


def tokens(c: str) -> str:
    w = n_of(c, NWS + "+")
    return f"(CASE WHEN {w} = 0 THEN 0 WHEN {w} >= 2 OR NOT regexp_matches({c}, '[㐀-䶿一-鿿぀-ヿ가-힯]') THEN {w} ELSE CAST(greatest(length(regexp_replace({c}, '{WS}+', '', 'g')) // 2, 1) AS INT) END)"


def normal(c: str) -> str:
    return f"regexp_replace({trim(f'lower({c})')}, '{WS}+', ' ', 'g')"


def one(c: str, p: str) -> str:
    return f"((strlen({c}) - strlen(replace({c}, {q(p)}, ''))) // {len(p.encode())})"


def many(c: str, phrases: tuple[str, ...]) -> str:
    return "CAST(" + " + ".join(one(c, p) for p in phrases) + " AS INT)"


def distinct(c: str, phrases: tuple[str, ...]) -> str:
    return "(" + " + ".join(f"contains({c}, {q(p)})::INT" for p in phrases) + ")"


def restarts(c: str) -> str:
    edge = r"(?:^|[^\p{L}\p{N}\p{M}_])"
    return "(" + " + ".join(n_of(c, "(?i)" + p.format(b=edge, s=WS + "+")) for _, p in lexicon.RESTARTS) + ")"


def back(h: str, i: str) -> str:
    """Byte offset ``i`` in hex text ``h``, moved to a character's first byte."""
    inside = lambda k: f"substr({h}, 2 * ({i} - {k}) + 1, 2) BETWEEN '80' AND 'BF'"
    return f"(CASE WHEN {i} <= 0 OR NOT ({inside(0)}) THEN {i} WHEN NOT ({inside(1)}) THEN {i} - 1 WHEN NOT ({inside(2)}) THEN {i} - 2 ELSE {i} - 3 END)"


def cut(h: str, a: str, b: str | None = None) -> str:
    start = back(h, a)
    end = back(h, b) if b else f"(length({h}) // 2)"
    return f"decode(unhex(substr({h}, CAST(2 * {start} + 1 AS BIGINT), CAST(2 * greatest({end} - {start}, 0) AS BIGINT))))"


def plain(c: str) -> str:
    lines = f"replace({c}, chr(13) || chr(10), chr(10))"
    body = f"(CASE WHEN {lines} = '' OR suffix({lines}, chr(10)) THEN {lines} ELSE {lines} || chr(10) END)"
    blank = f"[{_SET.replace(chr(92) + 'n', '')}]*"
    fence = rf"(?s)\n{blank}```[^\n]*(?:\n.*?)??(?:\n{blank}```[^\n]*|\z)"
    led = f"regexp_replace(chr(10) || left({body}, length({body}) - 1), {q(fence)}, '', 'g')"
    return f"(CASE WHEN contains({c}, '```') THEN (CASE WHEN {led} = '' THEN '' ELSE substr({led}, 2) || chr(10) END) ELSE {body} END)"


def detect(c: str) -> str:
    low = f"lower({c})"
    spaced = f"(' ' || regexp_replace({low}, '[^\\p{{L}}]+', '  ', 'g') || ' ')"
    scores = []
    for lang in sorted(lid.WORDS):
        s = n_of(spaced, f" (?:{'|'.join(lid.WORDS[lang].split())}) ")
        if lang in lid.LETTERS:
            s += " + " + n_of(low, lid.LETTERS[lang])
        scores.append(f"{{'s': -({s}), 'l': '{lang}'}}")
    best = f"list_min([{', '.join(scores)}])"
    latin = f"(CASE WHEN {best}.s < 0 THEN {best}.l ELSE 'Eng' END)"
    scripts = " ".join(f"WHEN {n_of(c, letters)} * {share} >= greatest(length({c}), 1) THEN '{lang}'" for lang, letters, share in lid.SCRIPTS)
    return f"(CASE WHEN regexp_matches({c}, '[Ѐ-￿]') THEN (CASE {scripts} ELSE {latin} END) ELSE {latin} END)"


def f(x: str) -> str:
    return f"CAST({x} AS FLOAT)"


def number(c: str) -> str:
    return rf"(CASE WHEN regexp_matches({c}, '^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$') THEN TRY_CAST({c} AS DOUBLE) END)"


def answer(c: str) -> str:
    return f"lower({trim(f'regexp_replace({trim(c)}, {q("[.,]+$")}, {q("")})')})"


def calibrate(raw: str) -> str:
    table = "[" + ", ".join(f"{k}::FLOAT" for k in KNOTS) + "]"
    hi = f"len(list_filter({table}, lambda k: k < {raw}))"
    lo_k, hi_k = f"{table}[{hi}]", f"{table}[{hi} + 1]"
    span = f"({hi_k} - {lo_k})"
    return f"(CASE WHEN {raw} <= {KNOTS[0]}::FLOAT THEN 0::FLOAT WHEN {raw} >= {KNOTS[-1]}::FLOAT THEN 100::FLOAT WHEN {span} <= 1.1920929e-7::FLOAT THEN {f(f'{hi} - 1')} ELSE least(greatest({f(f'{hi} - 1')} + ({raw} - {lo_k}) / {span}, 0::FLOAT), 100::FLOAT) END)"


def complexity(c: str) -> str:
    low = f"lower({c})"
    math = f"(length({c}) - length(translate({c}, {q(lexicon.MATH_SIGNS)}, '')) + {many(low, lexicon.MATH_WORDS)})"
    code = many(low, lexicon.CODE_WORDS)
    return f"least(least({f(tokens(c))} / 150::FLOAT, 0.4::FLOAT) + least({f(math)} * 0.1::FLOAT, 0.3::FLOAT) + least({f(code)} * 0.15::FLOAT, 0.3::FLOAT), 1::FLOAT)"


_TAGS = " ".join(f"WHEN regexp_matches(thinking, '(?s)<{t}>.*?</{t}>') THEN regexp_extract(thinking, '(?s)<{t}>(.*?)</{t}>', 1)" for t in ("think", "reasoning", "thought"))
_CHUNKED = f"list_filter(list_transform(range(least(10, length(plain_))), lambda i: substring(plain_, i * (length(plain_) // least(10, length(plain_))) + 1, CASE WHEN i + 1 = least(10, length(plain_)) THEN length(plain_) ELSE length(plain_) // least(10, length(plain_)) END)), lambda c: {tokens('c')} >= 20)"
_SENT = "(?s).{10,}?[.!?。！？]"
_REST = trim(f"regexp_replace(x, {q(_SENT)}, '', 'g')")
_SENTENCES = f"list_transform(list_concat(list_transform(regexp_extract_all(x, {q(_SENT)}), lambda s: {trim('s')}), CASE WHEN {tokens(_REST)} >= 3 THEN [{_REST}] ELSE [] END), lambda s: {normal('s')})"
_PARAGRAPHS = f"list_filter(list_transform(string_split(x, chr(10) || chr(10)), lambda p: {normal('p')}), lambda p: {tokens('p')} >= 5)"

STAGES = f"""
traces AS ({traces.ORACLE}),
s1 AS (SELECT *, {trim(f"CASE {_TAGS} ELSE thinking END")} AS x FROM traces),
s2 AS (SELECT *, lower(x) AS low, {tokens('x')} AS tok, hex(encode(lower(x))) AS h, strlen(lower(x)) AS len FROM s1),
s3 AS (SELECT *, {cut('h', '(len - CASE WHEN len < 200 THEN len WHEN len < 800 THEN len * 55 // 100 WHEN len < 2000 THEN len * 40 // 100 ELSE len * 30 // 100 END)')} AS tail,
         {cut('h', '(len - CASE WHEN len < 200 THEN len ELSE len * 12 // 100 END)')} AS fin, {cut('h', '(len - len * 40 // 100)')} AS late, {cut('h', '(len // 4)', '(len * 3 // 4)')} AS mid,
         {plain('x')} AS plain_, {restarts('x')} AS n_restart, {_PARAGRAPHS} AS paras, {_SENTENCES} AS sents FROM s2),
s4 AS (SELECT *, CASE WHEN length(plain_) >= 100 THEN list_transform({_CHUNKED}, lambda c: {detect('c')}) ELSE [] END AS langs,
         regexp_replace(fin, '{WS}+$', '') AS fin_end, left(lower(answer), 60) AS snip,
         {many('low', lexicon.STRONG)} AS strong, {many('low', lexicon.MEDIUM)} AS medium, {many('low', lexicon.WEAK)} AS weak, {one('x', chr(10) * 2)} AS dbl, {one('x', chr(10))} AS sgl,
         CASE WHEN length(low) < 50 THEN {many('low', lexicon.EXPLICIT)} ELSE {many('late', lexicon.EXPLICIT)} END AS le, CASE WHEN length(low) < 50 THEN {many('low', lexicon.IMPLICIT)} ELSE {many('late', lexicon.IMPLICIT)} END AS li,
         CASE WHEN length(low) < 50 THEN 0 ELSE {many('mid', lexicon.EXPLICIT)} END AS me, CASE WHEN length(low) < 50 THEN 0 ELSE {many('mid', lexicon.IMPLICIT)} END AS mi,
         {distinct('tail', lexicon.CONCLUSIONS)} AS concl, {distinct('tail', lexicon.DELIMITERS)} AS delim, {distinct('fin', lexicon.UNCERTAIN)} AS unsure, {complexity('problem')} AS cplx FROM s3),
s5 AS (SELECT *, {f('n_restart')} / greatest({f('tok')} / 1000::FLOAT, 1::FLOAT) AS density,
         CASE WHEN length(plain_) < 100 OR len(langs) = 0 THEN 0 ELSE len(langs) - list_max(list_transform(langs, lambda a: len(list_filter(langs, lambda b: b = a)))) END AS off,
         least(CASE concl WHEN 0 THEN 0 WHEN 1 THEN 15 WHEN 2 THEN 22 ELSE 25 END + CASE WHEN regexp_matches(fin_end, '[.!。！]$') THEN 10 ELSE 0 END, 35) AS conv,
         CASE WHEN (length(snip) >= 3 OR (regexp_matches(snip, '^[\\p{{N}}.\\-+/=%±×−÷]{{1,2}}$') AND regexp_matches(snip, '\\p{{N}}')) OR (length(snip) = 1 AND strlen(snip) > 1)) AND contains(tail, snip) THEN 25 ELSE 0 END AS echo,
         greatest(sgl - 2 * dbl, 0) AS single, {f('dbl')} + {f('greatest(sgl - 2 * dbl, 0)')} * 0.5::FLOAT AS eff,
         CASE WHEN len(paras) = 0 THEN 1::FLOAT ELSE {f('len(list_distinct(paras))')} / {f('len(paras)')} END AS uniq,
         len(list_filter(list_distinct(sents), lambda s: len(list_filter(sents, lambda o: o = s)) >= 3)) AS thrice,
         500::FLOAT + cplx * 4000::FLOAT AS expected,
         least(greatest(1::FLOAT - {f('greatest(tok - 50, 0)')} / 4950::FLOAT, 0.2::FLOAT), 1::FLOAT) AS te,
         {answer('answer')} = {answer('expected_answer')} OR coalesce(abs({number(answer('answer'))} - {number(answer('expected_answer'))}) < 1e-9, false) AS accurate FROM s4),
dims AS (SELECT *, greatest(100::FLOAT - density * 8::FLOAT, 0::FLOAT) AS efficiency_score,
         CASE WHEN off <= 1 THEN 100::FLOAT ELSE greatest(100::FLOAT - ({f('off')} - 1::FLOAT) * 15::FLOAT, 0::FLOAT) END AS language_score,
         CASE WHEN length(plain_) < 100 THEN 'unknown_short' WHEN len(langs) = 0 THEN 'unknown_no_valid_chunks' ELSE list_min(list_filter(langs, lambda a: len(list_filter(langs, lambda b: b = a)) = len(langs) - off)) END AS detected_language,
         off > 1 AS is_language_mixed,
         {f("least(conv + echo + CASE WHEN delim > 0 THEN 20 ELSE 0 END + CASE WHEN unsure > 0 THEN 0 ELSE 20 END, 100)")} AS answer_alignment_score,
         CASE WHEN tok < 10 THEN 50::FLOAT WHEN dbl + single = 0 AND tok > 200 THEN least({f('strong * 3 + medium * 2 + weak')} / greatest({f('tok')} / 100::FLOAT, 1::FLOAT) * 5::FLOAT + least(eff * 8::FLOAT, 40::FLOAT), 40::FLOAT)
              ELSE least({f('strong * 3 + medium * 2 + weak')} / greatest({f('tok')} / 100::FLOAT, 1::FLOAT) * 5::FLOAT + least(eff * 8::FLOAT, 40::FLOAT), 100::FLOAT) END AS structural_score,
         100::FLOAT * (1::FLOAT - least(greatest(1::FLOAT - uniq, CASE WHEN len(sents) = 0 THEN 0::FLOAT ELSE {f('thrice')} / {f('len(sents)')} END) * 3::FLOAT, 1::FLOAT)) AS repetition_score,
         {f('tok')} / expected AS ratio,
         {f("CASE WHEN length(low) < 50 THEN CASE WHEN le > 0 THEN 80 WHEN li > 0 THEN 70 ELSE 50 END WHEN le >= 2 THEN 100 WHEN le = 1 AND li >= 1 THEN 95 WHEN le = 1 THEN 85 WHEN li >= 2 THEN 80 WHEN li = 1 THEN 70 WHEN me >= 1 THEN 65 WHEN mi >= 1 THEN 55 ELSE 30 END")} AS verification_score,
         {f("CASE WHEN tok <= 30 THEN 5 WHEN tok <= 100 THEN 30 WHEN tok < 200 THEN 60 WHEN tok <= 3000 THEN 100 WHEN tok <= 5000 THEN 90 WHEN tok <= 10000 THEN 70 WHEN tok <= 20000 THEN 40 ELSE 15 END")} AS length_score,
         CASE WHEN expected_answer IS NULL THEN 100::FLOAT WHEN accurate THEN 100::FLOAT * (te * 2::FLOAT) / (te + 1::FLOAT) ELSE 0::FLOAT END AS accuracy_efficiency_score,
         le + li + me + mi > 0 AS has_self_verification FROM s5),
over_ AS (SELECT *, {f("CASE WHEN ratio <= 1 THEN 100 WHEN ratio <= 1.5 THEN 90 WHEN ratio <= 2.5 THEN 70 WHEN ratio <= 4 THEN 40 ELSE 10 END")} AS overthinking_score, answer_alignment_score >= 50 AS answer_in_trace_end FROM dims),
raw_ AS (SELECT *, least(greatest(efficiency_score * 0.2::FLOAT + language_score * 0.12::FLOAT + answer_alignment_score * 0.18::FLOAT + structural_score * 0.1::FLOAT + repetition_score * 0.15::FLOAT + overthinking_score * 0.1::FLOAT + verification_score * 0.08::FLOAT + length_score * 0.07::FLOAT + accuracy_efficiency_score * 0::FLOAT, 0::FLOAT), 100::FLOAT) AS raw_score FROM over_),
scored AS (SELECT *, {calibrate('raw_score')} AS quality_score FROM raw_)"""


def r4(c: str) -> str:
    return f"round(CAST({c} AS DOUBLE), 4)"


def over_scored(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([STAGES.strip(), *ctes]) + "\n" + body
