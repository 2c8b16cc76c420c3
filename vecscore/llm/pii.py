"""Personal data: base rules, and candidates that boosted trees choose from. DataFrame expressions only.

Base spans (email, ip, card, phone) are found by the patterns in BASE, leftmost and without overlap per kind, and
checked (address parts, Luhn sum, number of digits). Beyond them two generators propose with high recall and let
proposals overlap: from each group of digits to each later one, with up to two separators between groups and at most
19 digits, outside base spans (as a phone number and as a card number), and addresses whose signs are spelled out (``name (at) host (dot) org``). A proposal's features are its
format (digits, groups, separators, Luhn sum, ending) and its context (key words to the left, what touches it).
Per kind, gradient-boosted trees of depth 2 score them; a proposal becomes a span if its score reaches the kind's
threshold and it overlaps no base span and no chosen span of a kind before it; of its own kind's the one of higher
score stands. The thresholds are calibrated: the least scores at which
the precision on held-out rows is PRECISION. The trees are fitted on TRAINING_ROWS invented sentences, made from a
seed and put through the same expressions, so features cannot differ between fitting and use.

A pattern puts a mark before and after each match; splitting at the marks gives the pieces between and inside, and
prefix sums of their lengths the positions, in blocks, so that a text with very many matches stays linear. The
patterns are possessive and start at the beginning of a run only, which finds the same matches without going back.

Nulls: a null text is empty: no spans, the hash of nothing. Null ids pass through, equal rows give equal rows, an empty
table gives an empty result. The mark in a text is taken as another control character, which no pattern holds either.
Only doc_id and text are read.
"""

from __future__ import annotations

import functools
import math
import random
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MARK, OTHER = "\u0001", "\u0002"
BLOCK = 256
KINDS = ("email", "ip", "card", "phone")
#: The base patterns, so written that a search never goes back over a run.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators beyond the base, and the kinds that each proposes.
LOOSE = {
    "number": (r"\+?\(?[0-9]++", ("card", "phone")),
    "spelled": (
        r"(?i)(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\]|\{at\}|\x20at\x20)\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\]|\{dot\}|\x20dot\x20)\x20?[A-Za-z0-9-]++)++",
        ("email",),
    ),
}
#: What a text must hold for a pattern to be tried at all.
NEEDS = {"email": "t like '%@%'", "ip": "t like '%.%'", "phone": "t like '%+%'", "spelled": "t rlike '(?i)[(\\\\[{ ]at[)\\\\]} ]'", "number": "t rlike '(?:[0-9][ ()./-]{0,3}+){7}'"}
LEFT, RIGHT = 24, 4
#: Digits of a number, at most and at least; and how many proposals before or after one in order of start can overlap it.
MOST, LEAST, NEAR = 19, 7, 19 * 9
PRECISION, TRAINING_ROWS, TREES, RATE = 0.99, 1500, 24, 0.3

_DIGITS = "regexp_replace(s, '[^0-9]', '')"


def _luhn(digits: str) -> str:
    """SQL for the Luhn check of a column of digits; the last digit is not doubled."""
    one = f"cast(substring({digits}, length({digits}) - i, 1) as int)"
    return f"(length({digits}) > 0 and aggregate(sequence(0, greatest(length({digits}) - 1, 0)), 0, (a, i) -> a + case when i % 2 = 0 then {one} when {one} > 4 then 2 * {one} - 9 else 2 * {one} end) % 10 = 0)"


#: Checks of base matches, over a match's text ``s``.
CHECKS = {
    "email": "true",
    "ip": "not exists(split(s, '[.]'), p -> length(ltrim('0', p)) > 3 or cast(concat('0', right(ltrim('0', p), 3)) as int) > 255)",
    "card": f"length({_DIGITS}) between 16 and 19 and {_luhn(_DIGITS)}",
    "phone": f"length({_DIGITS}) between 8 and 15",
}
_WORDS = {
    "phone": r"(?i)(?:phone|tel|call|fax|mobile|cell|whatsapp|sms)",
    "card": r"(?i)(?:card|visa|amex|credit|debit|payment)",
    "email": r"(?i)(?:mail|contact|write|reach|address)",
    "else": r"(?i)(?:order|invoice|id|sku|isbn|version|page|total|ref|serial|part|build|lines?|figure|between)\b",
}


def _flag(sql: str) -> str:
    return f"cast({sql} as int)"


#: Whether other digits stand before and after a number.
BESIDE = {"before": _flag(r"l rlike '[0-9][ ()./-]{0,3}$'"), "after": _flag(r"r rlike '^[ ()./+-]{0,3}[0-9]'")}
#: Features by kind: name -> SQL over a proposal's text ``s``, digits ``d``, left and right context ``l`` and ``r``.
FEATURES = {
    "card": {
        "digits": "length(d)", "luhn": _flag(_luhn("d")), "separators": "length(s) - length(d)", "fours": _flag(r"s rlike '^[0-9]{4}([ -][0-9]{4}){2,3}$|^[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}$'"), "odd": _flag(r"length(s) > length(d) and not s rlike '^[0-9]{4}(?: [0-9]{4}){2,3}$|^[0-9]{4}(?:-[0-9]{4}){2,3}$|^[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}$'"),
        "issuer": _flag("substring(d, 1, 1) between '3' and '6'"), "card_word": _flag(f"l rlike r'{_WORDS['card']}'"), "other_word": _flag(f"l rlike r'{_WORDS['else']}'"),
        "joined": _flag(r"l rlike '[A-Za-z0-9_.+$#=/-]$' or r rlike '^[A-Za-z0-9_=/-]'"), **BESIDE,
    },
    "phone": {
        "digits": "length(d)", "separators": "length(s) - length(d)", "bracket": _flag("s like '(%'"), "plus": _flag(r"s rlike '^[+][0-9]{1,3}[ .-]?[(]?[0-9]{3}[)]?[ ./-]{1,2}[0-9]{3}[ .-][0-9]{4}$'"), "groups": _flag(r"s rlike '^[(]?[0-9]{3}[)]?[ ./-]{1,2}[0-9]{3}[ .-][0-9]{4}$'"),
        "date": _flag(r"s rlike '^[0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{1,4}'"), "phone_word": _flag(f"l rlike r'{_WORDS['phone']}'"), "other_word": _flag(f"l rlike r'{_WORDS['else']}|{_WORDS['card']}'"),
        "joined": _flag(r"l rlike '[A-Za-z0-9_.+$#=/-]$' or r rlike '^[A-Za-z0-9_=/-]'"), **BESIDE,
    },
    "email": {
        "bracketed": _flag(r"s rlike '(?i)[(\\[{]at[)\\]}]'"), "dot_word": _flag(r"s rlike '(?i)[(\\[{ ]dot[)\\]} ]'"), "ending": _flag(r"s rlike '(?i)[^a-z0-9](com|org|net|edu|io|gov|info|de|fr|es|uk)$'"),
        "mail_word": _flag(f"l rlike r'{_WORDS['email']}'"), "spaces": "length(s) - length(replace(s, ' ', ''))", "letters": _flag(r"s rlike '^[A-Za-z]'"),
    },
}
#: Proposals outside these numbers of digits are none.
RANGE = {"card": "length(d) between 13 and 19", "phone": "length(d) between 7 and 15", "email": "true"}


def _matches(df: DataFrame, name: str, pattern: str) -> DataFrame:
    """Add array column ``name`` of (start, end, s, l, r): each match of ``pattern`` in column ``t`` with what is around."""
    marked = F.regexp_replace("t", F.lit(pattern), F.lit(f"{MARK}$0{MARK}"))
    if name in NEEDS:
        marked = F.when(F.expr(NEEDS[name]), marked).otherwise(F.lit(""))
    p, at = f"_{name}_p", f"_{name}_at"
    df = df.withColumn(p, F.split(marked, MARK))
    blocks = f"transform(sequence(0, (size({p}) - 1) div {BLOCK}), b -> slice({p}, b * {BLOCK} + 1, {BLOCK}))"
    sums = f"transform({blocks}, k -> aggregate(k, 0L, (a, x) -> a + char_length(x)))"
    df = df.withColumn(at, F.expr(f"case when size({p}) > 1 then aggregate({sums}, array(0L), (a, x) -> array_append(a, element_at(a, -1) + x)) end"))
    inside = f"aggregate(k, named_struct('n', element_at({at}, b + 1), 'o', cast(array() as array<bigint>)), (a, x) -> named_struct('n', a.n + char_length(x), 'o', array_append(a.o, a.n)), a -> a.o)"
    df = df.withColumn(at, F.expr(f"case when size({p}) > 1 then flatten(transform({blocks}, (k, b) -> {inside})) end"))
    found = f"transform(sequence(1, size({p}) - 2, 2), i -> named_struct('start', {at}[i], 'end', {at}[i + 1], 's', {p}[i], 'l', right({p}[i - 1], {LEFT}), 'r', left({p}[i + 1], {RIGHT})))"
    none = "cast(array() as array<struct<start: bigint, end: bigint, s: string, l: string, r: string>>)"
    return df.withColumn(name, F.expr(f"case when size({p}) > 1 then {found} else {none} end")).drop(p, at)


def _base(df: DataFrame) -> DataFrame:
    """Add array columns email, ip, card and phone of base spans (start, end, s, l, r)."""
    for kind, pattern in BASE.items():
        df = _matches(df, kind, pattern)
    return df.withColumns({kind: F.expr(f"filter(transform({kind}, x -> named_struct('x', x, 'ok', {_over_match(CHECKS[kind])})), y -> y.ok).x") for kind in KINDS})


def _over_match(sql: str) -> str:
    """``sql`` over ``s`` as SQL over the match ``x``."""
    return f"element_at(transform(array(x.s), s -> {sql}), 1)"


def _bound(name: str, value: str, sql: str) -> str:
    """``sql`` with ``name`` bound once to ``value``."""
    return f"element_at(transform(array({value}), {name} -> {sql}), 1)"


def _cover(spans: str) -> str:
    """SQL for bytes, one for each place up to the last of ``spans`` (apart and in order): 1 in a span, 0 between."""
    gap = "x.start - case when i = 0 then 0L else v[i - 1].end end"
    made = f"cast(array_join(transform(v, (x, i) -> repeat('0', cast({gap} as int)) || repeat('1', cast(x.end - x.start as int))), '') as binary)"
    return _bound("v", spans, made)


def _apart(x: str, covers: list[str]) -> str:
    """SQL for whether the span ``x`` meets none of ``covers``."""
    return " and ".join(["true", *[f"locate('1', cast(substring({c}, cast({x}.start as int) + 1, cast({x}.end - {x}.start as int)) as string)) = 0" for c in covers]])


def _over_covers(covers: Sequence[str], sql: Callable[[list[str]], str]) -> str:
    """``sql`` of names to which the columns ``covers`` are bound once each."""
    out = sql([f"m{i}" for i in range(len(covers))])
    for i, c in enumerate(covers):
        out = _bound(f"m{i}", c, out)
    return out


def _numbers() -> str:
    """SQL for the proposals made of neighbouring groups of digits in ``_groups``: each start with each end in reach.

    A group in a base span is not free and stands in none.
    """
    digits = "length(ltrim('(+', {0}.s))"
    linked = f"a.e >= 0 and y.free and y.start - a.e <= 2 and y.l rlike '^[ ()./-]*$' and y.s not like '+%' and a.n + {digits.format('y')} <= {MOST}"
    step = f"case when {linked} then named_struct('n', a.n + {digits.format('y')}, 'e', y.end, 'j', a.j + 1, 'out', case when a.n + {digits.format('y')} >= {LEAST} then array_append(a.out, a.j + 1) else a.out end) else named_struct('n', a.n, 'e', -1L, 'j', a.j, 'out', a.out) end"
    first = f"named_struct('n', {digits.format('g')}, 'e', g.end, 'j', i, 'out', case when {digits.format('g')} >= {LEAST} then array(i) else cast(array() as array<int>) end)"
    ends = f"case when g.free and {digits.format('g')} <= {MOST} then aggregate(slice(_groups, i + 2, {MOST - 1}), {first}, (a, y) -> {step}, a -> a.out) else cast(array() as array<int>) end"
    text = "g.s || array_join(transform(slice(_groups, i + 2, j - i), y -> y.l || y.s), '')"
    left = f"right(array_join(transform(slice(_groups, greatest(i - {LEFT}, 0) + 1, least(i, {LEFT})), y -> y.l || y.s), '') || g.l, {LEFT})"
    right = f"left(_groups[j].r || array_join(transform(slice(_groups, j + 2, {RIGHT}), y -> y.s || y.r), ''), {RIGHT})"
    return f"flatten(transform(_groups, (g, i) -> transform({ends}, j -> named_struct('start', g.start, 'end', _groups[j].end, 's', {text}, 'l', {left}, 'r', {right}))))"


def _bare() -> str:
    """SQL for the number ``x`` without the signs before its first digit: a card has none."""
    lead = "(length(x.s) - length(ltrim('(+', x.s)))"
    return f"named_struct('start', x.start + {lead}, 'end', x.end, 's', ltrim('(+', x.s), 'l', right(x.l || left(x.s, {lead}), {LEFT}), 'r', x.r)"


def _proposals(df: DataFrame, covers: tuple[str, ...] = ()) -> DataFrame:
    """Add array columns try_card, try_phone and try_email of (start, end, and the features of the kind)."""
    for name, (pattern, kinds) in LOOSE.items():
        df = _matches(df, f"{name}", pattern)
        if name == "number":
            free = _over_covers(covers, lambda bound: f"transform(number, g -> named_struct('start', g.start, 'end', g.end, 's', g.s, 'l', g.l, 'r', g.r, 'free', {_apart('g', bound)}))")
            df = df.withColumn("_groups", F.expr(free))
            df = df.withColumn(name, F.expr(f"case when size(_groups) > 0 then {_numbers()} else number end")).drop("_groups")
        for kind in kinds:
            each = f"transform({name}, x -> {_bare()})" if kind == "card" else name
            fields = ", ".join(f"'{f}', {sql}" for f, sql in FEATURES[kind].items())
            # The text, digits and contexts are bound once each, by transforms over arrays of one.
            bound = f"filter(transform({each}, x -> named_struct('x', x, 'd', regexp_replace(x.s, '[^0-9]', ''))), y -> element_at(transform(array(y.d), d -> {RANGE[kind]}), 1))"
            made = f"element_at(transform(array(y.x.s), s -> element_at(transform(array(y.d), d -> element_at(transform(array(y.x.l), l -> element_at(transform(array(y.x.r), r -> named_struct('start', y.x.start, 'end', y.x.end, {fields})), 1)), 1)), 1)), 1)"
            df = df.withColumn(f"try_{kind}", F.expr(f"transform({bound}, y -> {made})"))
        df = df.drop(name)
    return df


# --- fitting ---------------------------------------------------------------------------------------------


#: In sentences being made: what opens personal data of each kind, and what closes it.
_OPEN, _CLOSE = {"card": "\u0003", "phone": "\u0004", "email": "\u0005"}, "\u0006"


def _read(marked: str) -> tuple[str, set[tuple[str, int, int]]]:
    """The sentence without its marks, and the (kind, start, end) they stand for."""
    kinds, text, spans, open_ = {c: k for k, c in _OPEN.items()}, "", set(), None
    for c in marked:
        if c in kinds:
            open_ = kinds[c], len(text)
        elif c == _CLOSE:
            spans.add((*open_, len(text)))
        else:
            text += c
    return text, spans


def _sentences(seed: int, rows: int) -> list[tuple[str, set[tuple[str, int, int]]]]:
    """(text, its personal data as (kind, start, end)): invented, from a seed."""
    r = random.Random(seed)
    digits = lambda n: "".join(str(r.randrange(10)) for _ in range(n))
    some = lambda *x: r.choice(x)

    def card(n: int, valid: bool, any_issuer: bool = False) -> str:
        d = ("" if any_issuer else some("4", "5", "37", "6")) + digits(n)
        d = d[: n - 1]
        total = sum(2 * int(c) - 9 * (int(c) > 4) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(d)))
        d += str((-total + (0 if valid else r.randrange(1, 10))) % 10)
        return d if n != 16 or r.random() < 0.5 else some(" ", "-").join(d[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return some(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}")

    def whole(n: int, valid: bool) -> str:
        """As the base rules have it: the sum counts, whoever issued it."""
        return card(n, valid, r.random() < 0.5)

    word = lambda: "".join(r.choice("aeiounrstlmd") for _ in range(r.randrange(2, 9)))
    plain = lambda: " ".join(word() for _ in range(r.randrange(2, 6)))
    mine = lambda kind, s, true=True: f"{_OPEN[kind]}{s}{_CLOSE}" if true else s
    abroad = lambda: f"+{r.randrange(1, 100)}{some(' ', ' ', '-')}{phone()}"
    ip = lambda: ".".join(str(r.randrange(256)) for _ in range(4))
    out = []
    for _ in range(rows):
        k = r.randrange(17)
        if k == 0:
            out.append(f"{plain()} {some('card', 'credit card:', 'visa', 'payment by')} {mine('card', card(some(13, 14, 15), True))} {plain()}")
        elif k == 1:
            out.append(f"{plain()} {some('card', 'order', 'id', 'serial', word())} {card(some(13, 15, 16, 17), False)} {plain()}")
        elif k == 2:
            out.append(f"{plain()} {some('order', 'id', 'isbn', 'ref', word())}{some(' ', ' #', '=')}{card(some(13, 14, 15), r.random() < 0.1)} {plain()}")
        elif k == 3:
            out.append(f"{plain()} {some('phone', 'tel:', 'call', 'fax', 'mobile')} {mine('phone', phone())} {plain()}")
        elif k == 4:
            out.append(f"{plain()} {mine('phone', phone(), r.random() < 0.8)}{some('', '.', ',')} {plain()}")
        elif k == 5:
            out.append(f"{plain()} {some('version', 'order', 'page', word(), word())} {some(digits(some(7, 8, 10, 12)), f'20{digits(2)}-0{digits(1)}-1{digits(1)}', f'{digits(2)}/{digits(2)}/20{digits(2)}', f'{digits(3)} {digits(4)}', f'{digits(4)}.{digits(4)}')} {plain()}")
        elif k == 6:
            out.append(f"{plain()} {some('$', '=', 'x', 'a_')}{some(digits(9), phone())}{some('', 'f', '_b')} {plain()}")
        elif k in (7, 8):
            at, dot = some((" (at) ", " (dot) "), ("[at]", "[dot]"), ("(at)", "."), (" at ", " dot "))
            address = f"{word()}{some('', '.' + word())}{at}{word()}{dot}{some('com', 'org', 'net', 'io')}"
            out.append(f"{plain()} {some('mail ', 'contact ', word() + ' ', 'write to ')}{mine('email', address)} {plain()}")
        elif k == 9:
            out.append(f"{plain()} {word()} at {word()}{some('. ', '. ', '.')}{word()}{some('', 'es', 'de')} {plain()}")
        elif k == 10:
            out.append(f"{plain()} {word()} at {word()} dot {word()} {plain()}")
        elif k == 11:
            out.append(f"{plain()} {digits(some(7, 9, 11, 14, 15))} {plain()}")
        elif k in (12, 13):  # numbers next to numbers, from here on
            two = [mine("card", whole(some(16, 16, 16, 17, 18, 19), ok), ok) for ok in (r.random() < 0.8, r.random() < 0.8)]
            out.append(f"{plain()} {some(' '.join(two), f'{two[0]} {ip()}', f'{digits(some(1, 2, 4))} {two[0]}', f'{two[0]} {digits(some(1, 2, 4))}')} {plain()}")
        elif k == 14:
            out.append(f"{plain()} {some('', 'call ')}{mine('phone', abroad())} {some(ip(), ip(), digits(some(2, 4, 16)), mine('phone', abroad()))} {plain()}")
        elif k == 15:
            out.append(f"{plain()} {some('phone', 'tel:', 'call')} {mine('phone', phone())} {some(digits(some(1, 2, 4)), ip(), *[mine('phone', phone()) for _ in range(6)])} {plain()}")
        else:
            d, at = whole(some(13, 15, 16, 17, 18, 19), True).replace(" ", "").replace("-", ""), [0]  # its sum fits by chance
            while at[-1] < len(d):
                at.append(at[-1] + some(1, 2, 3, 3, 5, 6))
            out.append(f"{plain()} {some('', 'call ')}{some(' ', ' ', '.', '-', '/').join(d[a:b] for a, b in zip(at, at[1:]))} {plain()}")
    return [_read(x) for x in out]


def boost(rows: list[list[float]], labels: list[bool], trees: int = TREES, rate: float = RATE) -> tuple[float, list]:
    """Logistic gradient boosting: (bias, trees); a tree is (feature, cut, left, right), a leaf a number; left is <= cut."""
    import numpy as np

    x, y = np.array(rows, float), np.array(labels, float)
    bias = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    f = np.full(len(y), bias)

    def leaf(at, g, h):
        return float(rate * g[at].sum() / (h[at].sum() + 1.0))

    def grow(at, g, h, depth):
        best, whole = (1e-9, None, None), g[at].sum() ** 2 / (h[at].sum() + 1.0)
        for j in range(x.shape[1]) if depth else ():
            for cut in np.unique(x[at, j])[:-1]:
                left = at & (x[:, j] <= cut)
                right = at & ~left
                gain = g[left].sum() ** 2 / (h[left].sum() + 1.0) + g[right].sum() ** 2 / (h[right].sum() + 1.0) - whole
                if gain > best[0]:
                    best = (gain, j, float(cut))
        if best[1] is None:
            return leaf(at, g, h)
        left = at & (x[:, best[1]] <= best[2])
        return best[1], best[2], grow(left, g, h, depth - 1), grow(at & ~left, g, h, depth - 1)

    made = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        made.append(grow(np.ones(len(y), bool), y - p, p * (1 - p), 2))
        f = f + np.array([score(made[-1], r) for r in x])
    return bias, made


def score(tree, row) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def threshold(scores: list[float], labels: list[bool]) -> float | None:
    """The least score from which on the precision is PRECISION; none if there is no such."""
    ranked, right, best = sorted(zip(scores, labels), reverse=True), 0, None
    for n, (s, y) in enumerate(ranked, 1):
        right += y
        if right >= PRECISION * n and (n == len(ranked) or ranked[n][0] < s):
            best = s
    return best


@functools.lru_cache(maxsize=4)
def _fitted(spark: SparkSession, seed: int) -> dict[str, tuple[float, list, float | None]]:
    said = _sentences(seed, TRAINING_ROWS)
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(said)], "i int, t string")
    got = _proposals(df).select("i", *[f"try_{k}" for k in FEATURES]).collect()  # TRAINING_ROWS rows
    models = {}
    for kind, features in FEATURES.items():
        rows = [(r.i, [float(p[f]) for f in features], (kind, p.start, p.end) in said[r.i][1]) for r in got for p in r[f"try_{kind}"]]
        fit, held = [x for x in rows if x[0] % 2], [x for x in rows if not x[0] % 2]
        bias, trees = boost([x for _, x, _ in fit], [y for _, _, y in fit])
        models[kind] = bias, trees, threshold([bias + sum(score(t, x) for t in trees) for _, x, _ in held], [y for _, _, y in held])
    return models


def _tree_sql(tree, names: list[str]) -> str:
    if not isinstance(tree, tuple):
        return f"{tree:.12f}D"
    return f"case when p.{names[tree[0]]} <= {tree[1]}D then {_tree_sql(tree[2], names)} else {_tree_sql(tree[3], names)} end"


# --- use ---------------------------------------------------------------------------------------------------


def _chosen(scored: str, k: int) -> str:
    """SQL for the spans of kind ``k`` among ``scored`` (start, end, score) that may overlap.

    Those that no overlapping one outranks (by score, then length, then start) come first; of what does not overlap
    these, the leftmost. An overlap is never further than NEAR places, so both are linear, and so are the blocks.
    """
    near = f"slice({{0}}, greatest(i - {NEAR}, 0) + 1, least(i, {NEAR}) + {NEAR} + 1)"
    meets = "y.start < x.end and x.start < y.end"
    above = "(y.score > x.score or y.score = x.score and (y.end - y.start > x.end - x.start or y.end - y.start = x.end - x.start and y.start < x.start))"
    tops = f"transform(v, (x, i) -> named_struct('start', x.start, 'end', x.end, 'top', not exists({near.format('v')}, y -> {meets} and {above})))"
    left = f"filter(w, (x, i) -> x.top or not exists({near.format('w')}, y -> y.top and {meets}))"
    none = "cast(array() as array<struct<k: int, start: bigint, end: bigint>>)"
    take = f"aggregate(b, named_struct('at', a.at, 'out', {none}), (c, x) -> case when x.start < c.at then c else named_struct('at', x.end, 'out', array_append(c.out, named_struct('k', {k}, 'start', x.start, 'end', x.end))) end)"
    blocks = f"transform(sequence(0, (size(u) - 1) div {BLOCK}), n -> slice(u, n * {BLOCK} + 1, {BLOCK}))"
    walk = f"aggregate({blocks}, named_struct('at', 0L, 'out', cast(array() as array<array<struct<k: int, start: bigint, end: bigint>>>)), (a, b) -> {_bound('z', take, 'named_struct(' + chr(39) + 'at' + chr(39) + ', z.at, ' + chr(39) + 'out' + chr(39) + ', array_append(a.out, z.out))')}, a -> flatten(a.out))"
    walked = f"case when size(u) > 0 then {walk} else {none} end"
    return _bound("v", scored, _bound("w", tops, _bound("u", left, walked)))


def find(docs: DataFrame, seed: int = 5) -> DataFrame:
    """``doc_id, text`` and array columns ``base`` and ``spans`` of (kind, start, end) for each row of ``docs``, in code points."""
    df = docs.select("doc_id", "text", F.translate(F.coalesce(F.col("text"), F.lit("")), MARK, OTHER).alias("t"))
    df = _base(df)
    df = df.withColumn("_base", F.expr("concat(" + ", ".join(f"transform({k}, x -> named_struct('k', {i}, 'start', x.start, 'end', x.end))" for i, k in enumerate(KINDS)) + ")")).drop(*KINDS)
    taken, covers = "_base", [f"_c{i}" for i in range(len(KINDS))]
    df = df.withColumns({c: F.expr(_cover(f"filter(_base, x -> x.k = {i})")) for i, c in enumerate(covers)})
    df = _proposals(df, covers)
    for kind, (bias, trees, least) in _fitted(docs.sparkSession, seed).items():
        if least is None:
            continue
        names = list(FEATURES[kind])
        total = " + ".join([f"{bias:.12f}D", *[f"({_tree_sql(t, names)})" for t in trees]])
        scored = _over_covers(covers, lambda bound: f"transform(filter(try_{kind}, p -> {_apart('p', bound)}), p -> named_struct('start', p.start, 'end', p.end, 'score', {total}))")
        chosen = _chosen(f"filter({scored}, p -> p.score >= {least - 1e-9:.12f}D)", KINDS.index(kind))
        df = df.withColumn(f"_new_{kind}", F.expr(f"case when size(try_{kind}) > 0 then {chosen} else slice(_base, 1, 0) end"))
        df = df.withColumns({f"_with_{kind}": F.expr(f"concat({taken}, _new_{kind})"), f"_c_{kind}": F.expr(_cover(f"_new_{kind}"))})
        taken = f"_with_{kind}"
        covers.append(f"_c_{kind}")
    return df.select("doc_id", "text", F.col("_base").alias("base"), F.array_sort(F.col(taken)).alias("spans"))


def _said(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans); the counts are of base spans."""
    found = find(docs)
    counts = [F.expr(f"cast(size(filter(base, x -> x.k = {i})) as bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_said(F.col("base")).cast("binary"), 256).alias("base_sha256"), _said(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """(doc_id, text): each span replaced by its kind in brackets; where spans overlap, the one that starts first stands."""
    found = find(docs).withColumn("_by", F.expr("array_sort(transform(spans, x -> named_struct('start', x.start, 'end', x.end, 'k', x.k)))"))
    names = "array(" + ", ".join(f"'[{k}]'" for k in KINDS) + ")"
    walk = f"aggregate(_by, named_struct('at', 0L, 'out', ''), (a, x) -> case when x.start < a.at then a else named_struct('at', x.end, 'out', a.out || substring(text, cast(a.at as int) + 1, cast(x.start - a.at as int)) || element_at({names}, x.k + 1)) end, a -> a.out || substring(text, cast(a.at as int) + 1))"
    return found.select("doc_id", F.expr(f"case when size(_by) = 0 then text else {walk} end").alias("text"))
