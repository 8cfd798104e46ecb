"""Personal values replaced by pseudonyms of the same format.

Numbers are looked for by format and validated (check digits, ranges, calendar), from every
place where one may begin. If a match isn't valid, as it has run into the number behind it,
its shorter readings are tried, and the scan goes on inside it. A valid one is written as digits in a mixed radix, run through a keyed Feistel network over
these digits, and rendered in its own format again, with its check digits made anew.
That is a permutation of the format's values: equal values get equal pseudonyms in all
documents, different ones different pseudonyms, and who has the key can invert it. All
of it is column expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
KEY = "change-me"

# Formats, tried in this order.
FORMATS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    "date": r"(?<![\d.-])(?:\d{4}(?:-\d{2}-\d{2}|/\d{2}/\d{2}|\.\d{2}\.\d{2})"
    r"|\d{2}(?:-\d{2}-\d{4}|/\d{2}/\d{4}|\.\d{2}\.\d{4}))(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\d)"
    r"|(?<![\d+])(?!\+0\.\d+(?![ .-]?\d))\+\d(?:[ .-]?\d){6,14}(?!\d)|(?<![\d.-])\d{3}([.-])\d{3}\1\d{4}(?![\d-])",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])[0-9a-f]{32,64}(?![A-Za-z0-9])",
    "card": r"(?<![\d.,-])\d(?:[ -]?\d){12,18}(?!\d|[.,-]\d)",
}
# Characters looked at from where a number may begin; no format but the email's is as long.
WINDOW = 80
# Shapes that are tried before longer readings. Cards stand unbroken or in their usual groups.
CARD_SHAPE = r"(?:\d{13,19}|\d{4}([ -])(?:\d{4}\1\d{4}\1\d{4}|\d{6}\1\d{4,5}))(?!\d)"
# Phones of ten digits behind +1 or an area code, and others up to where a number of another kind begins.
PHONE_SHAPE = r"(?:\+1[ .-]?\(?\d{3}|\([2-9]\d{2})\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)"
NEXT = (
    r"(?:\d{1,3}(?:\.\d{1,3}){3}|\d{4}([-/.])\d{2}\1\d{2}|\d{2}([-/.])\d{2}\2\d{4}|\d{3}-\d{2}-\d{4}"
    r"|\d{3}([.-])\d{3}\3\d{4}|\d{4}([ -])(?:\d{4}\4\d{4}\4\d{4}|\d{6}\4\d{4,5})|\d{13,19})(?!\d)"
)
PHONE_BOUNDS = (
    rf"(?:\+\d{{1,3}}[ .-]?)?\(\d{{2,4}}\)[ .-]?\d{{2,4}}(?:(?: (?!{NEXT})|[.-])?\d{{2,4}}){{1,4}}(?!\d)",
    rf"\+\d(?:(?: (?!{NEXT})|[.-])?\d){{6,14}}(?!\d)",
)
# Country codes as phones without separators begin, which stay; others have three digits.
COUNTRIES = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
# Lengths of account numbers by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FO FI GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC",
    33: "RU",
}
# The first date that is permuted, and how many days; 17 * 4297 of them.
FIRST_DAY, DAYS = "1900-01-01", (17, 4297)
# Social security numbers have an area from 1 to 899 without 666, a group and a serial above 0.
AREAS, GROUPS, SERIALS = 898, 99, 9999


def pattern(kinds: tuple[str, ...], groups: int = 0) -> str:
    """One pattern for all kinds, the back reference numbered as it stands behind ``groups`` others."""
    parts = []
    for kind in kinds:
        parts.append(FORMATS[kind].replace("\\1", f"\\{groups + 1}"))
        groups += kind == "phone"
    return "|".join(f"(?:{p})" for p in parts)


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


# Days as yyyy-mm-dd from the formats; with slashes the month stands first if it can.
_YMD = "concat(substr(m, 1, 4), '-', substr(m, 6, 2), '-', substr(m, 9, 2))"
_DMY = "concat(substr(m, 7, 4), '-', substr(m, 4, 2), '-', substr(m, 1, 2))"
_MDY = "concat(substr(m, 7, 4), '-', substr(m, 1, 2), '-', substr(m, 4, 2))"
_ORDER = f"""CASE WHEN m RLIKE '^[0-9]{{4}}' THEN 'ymd'
    WHEN substr(m, 3, 1) = '/' AND try_cast({_MDY} AS date) IS NOT NULL THEN 'mdy'
    WHEN try_cast({_DMY} AS date) IS NOT NULL THEN 'dmy' ELSE 'mdy' END"""
_DAY = f"""datediff(try_cast(CASE {_ORDER} WHEN 'ymd' THEN {_YMD} WHEN 'dmy' THEN {_DMY}
    ELSE {_MDY} END AS date), date'{FIRST_DAY}')"""
_DIGITS = "regexp_replace({m}, '[^0-9]', '')"


def _luhn(digits: str) -> str:
    """SQL of the Luhn sum of a digit string, the last digit being the check digit."""
    digit = f"cast(substr({digits}, length({digits}) + 1 - i, 1) AS int)"
    return f"""aggregate(sequence(1, length({digits})), 0, (s, i) -> s +
        CASE WHEN i % 2 = 1 THEN {digit} ELSE cast({digit} * 2 div 10 AS int) + {digit} * 2 % 10 END)"""


def _mod97(text: str) -> str:
    """SQL of an account number's remainder: its first four characters moved to the end."""
    moved = f"concat(substr({text}, 5), substr({text}, 1, 4))"
    return f"""aggregate(sequence(1, length({text})), 0, (s, i) ->
        CASE WHEN substr({moved}, i, 1) BETWEEN '0' AND '9'
        THEN (s * 10 + ascii(substr({moved}, i, 1)) - 48) % 97
        ELSE (s * 100 + ascii(substr({moved}, i, 1)) - 55) % 97 END)"""


_VALID = {
    "email": "true",
    "date": f"coalesce({_DAY} BETWEEN 0 AND {DAYS[0] * DAYS[1] - 1}, false)",
    "ssn": """substr(m, 1, 3) NOT IN ('000', '666') AND substr(m, 1, 1) <> '9'
        AND substr(m, 5, 2) <> '00' AND substr(m, 8, 4) <> '0000'""",
    "phone": f"length({_DIGITS.format(m='m')}) BETWEEN 7 AND 15",
    "ip": "forall(split(m, '[.]'), o -> cast(o AS int) <= 255)",
    "iban": f"{_mod97('replace(m, chr(32), chr(0))').replace('chr(0)', _literal(''))} = 1",
    "secret": "m RLIKE '[0-9]' AND m RLIKE '[a-f]'",
    "card": f"{_luhn(_DIGITS.format(m='m'))} % 10 = 0 AND {_DIGITS.format(m='m')} RLIKE '[1-9]'",
}

# Where the permuted characters of a format lie, from and to; those outside stay.
_FROM = f"""CASE c.kind WHEN 'iban' THEN 5
    WHEN 'phone' THEN CASE WHEN c.m LIKE '+%' THEN
        length(regexp_extract(c.m, '^[+](?:[0-9]{{1,3}}(?![0-9])|{COUNTRIES}|[0-9]{{3}})', 0)) + 1 ELSE 1 END
    ELSE 1 END"""
_TO = """CASE c.kind WHEN 'card' THEN length(c.m) - 1
    WHEN 'email' THEN length(c.m) - length(regexp_extract(c.m, '[^.]+$', 0)) ELSE length(c.m) END"""
_CHARS = f"""transform(sequence(1, length(c.m)), i -> named_struct(
    'code', ascii(substr(c.m, i, 1)), 'own', i BETWEEN {_FROM} AND {_TO}))"""
_BASE = """CASE WHEN NOT x.own THEN x.code WHEN x.code BETWEEN 48 AND 57 THEN 48
    WHEN x.code BETWEEN 65 AND 90 THEN 65 WHEN x.code BETWEEN 97 AND 122 THEN 97 ELSE x.code END"""
_RADIX = """CASE WHEN NOT x.own THEN 1 WHEN x.code BETWEEN 48 AND 57 THEN 10
    WHEN c.kind = 'secret' THEN 6 WHEN x.code BETWEEN 65 AND 90 OR x.code BETWEEN 97 AND 122 THEN 26
    ELSE 1 END"""


def readings(kind: str) -> str:
    """SQL of the readings of a match ``m``, first in ``w``, the preferred ones first.

    Where groups may belong to the number behind, the usual shape stands first, then all
    that ends with a group, the longest first.
    """
    if kind not in ("phone", "iban", "card"):
        return "array(m)"
    cuts = {"phone": "[ .-]", "iban": " ", "card": "[ -]"}[kind]
    shorter = f"""transform(filter(sequence(length(m), 1, -1), i -> i = length(m) OR
        substr(m, i + 1, 1) RLIKE '^{cuts}$'), i -> substr(m, 1, i))"""
    if kind == "phone":
        usual = ", ".join(f"regexp_extract(w, {_literal('^' + p)}, 0)" for p in (PHONE_SHAPE, *PHONE_BOUNDS))
        return f"concat(array({usual}), {shorter})"
    if kind == "iban":
        sizes = " ".join(
            f"WHEN substr(m, 1, 2) IN ({', '.join(map(_literal, names.split()))}) THEN {size}"
            for size, names in IBAN_LENGTHS.items()
        )
        return f"""concat(filter({shorter}, r -> length(replace(r, ' ', '')) = CASE {sizes} END), {shorter})"""
    # A card in its usual shape is no part of a longer one.
    inside = rf"(?<!\d)(?=({CARD_SHAPE}))".replace("\\1", "\\2")
    shaped = f"regexp_extract_all(r, {_literal(inside)}, 1)"
    return f"""concat(array(regexp_extract(w, {_literal('^' + CARD_SHAPE)}, 0)),
        filter({shorter}, r -> NOT exists({shaped}, x -> {_luhn(_DIGITS.format(m='x'))} % 10 = 0)))"""


def coded(kinds: tuple[str, ...]) -> str:
    """SQL of the first valid value in ``t``, one character and what follows it, as (m, kind), or null."""
    cases = []
    for k in kinds:
        greedy = f"substr(regexp_extract(t, {_literal(f'(?s)^.(?:{FORMATS[k]})')}, 0), 2)"
        valid = f"m RLIKE {_literal(f'^(?:{FORMATS[k]})$')} AND {_VALID[k]}"
        read = f"flatten(transform(filter(array({greedy}), m -> m <> ''), m -> {readings(k)}))"
        read = f"flatten(transform(array(substr(t, 2)), w -> {read}))" if "(w," in read else read
        cases.append(f"get(transform(filter({read}, m -> {valid}), m -> named_struct('m', m, 'kind', '{k}')), 0)")
    return f"coalesce({', '.join(cases)})"


# SQL of the values that stay, from left to right, each with the text behind it: what begins
# inside one before it goes. Pieces begin where a value may; ``c`` is the value, if any.
_KEPT = """aggregate(arrays_zip(slice(_pieces, 2, size(_pieces)), _coded), named_struct('skip', 0, 'out',
        cast(array() AS array<struct<m: string, kind: string, tail: string>>)),
    (s, x) -> CASE WHEN s.skip > 0 THEN named_struct('skip', greatest(s.skip - length(x.`0`), 0), 'out',
            array_append(s.out, named_struct('m', '', 'kind', cast(NULL AS string), 'tail', substr(x.`0`, s.skip + 1))))
        ELSE named_struct('skip', greatest(coalesce(length(x._coded.m), 0) - length(x.`0`), 0), 'out',
            array_append(s.out, named_struct('m', coalesce(x._coded.m, ''), 'kind', x._coded.kind,
                'tail', substr(x.`0`, coalesce(length(x._coded.m), 0) + 1)))) END,
    s -> s.out)"""


def digits() -> str:
    """SQL of a coded match ``c`` with ``v``, its digits in a mixed radix, and ``r``, the radices."""
    m = "c.m"
    day = _DAY.replace("(m,", "(c.m,").replace("m RLIKE", "c.m RLIKE")
    area = f"cast(substr({m}, 1, 3) AS int)"
    values = f"""CASE WHEN c.kind IS NULL THEN array()
        WHEN c.kind = 'date' THEN array({day} div {DAYS[1]}, {day} % {DAYS[1]})
        WHEN c.kind = 'ssn' THEN array({area} - CASE WHEN {area} > 666 THEN 2 ELSE 1 END,
            cast(substr({m}, 5, 2) AS int) - 1, cast(substr({m}, 8, 4) AS int) - 1)
        WHEN c.kind = 'ip' THEN transform(split({m}, '[.]'), o -> cast(o AS int))
        ELSE transform({_CHARS}, x -> x.code - ({_BASE})) END"""
    radices = f"""CASE WHEN c.kind IS NULL THEN array()
        WHEN c.kind = 'date' THEN array({DAYS[0]}, {DAYS[1]})
        WHEN c.kind = 'ssn' THEN array({AREAS}, {GROUPS}, {SERIALS})
        WHEN c.kind = 'ip' THEN array(256, 256, 256, 256)
        ELSE transform({_CHARS}, x -> {_RADIX}) END"""
    return f"""named_struct('m', c.m, 'kind', c.kind,
        'v', cast({values} AS array<bigint>), 'r', cast({radices} AS array<bigint>))"""


def feistel(key: str, rounds: int = ROUNDS) -> str:
    """SQL of coded digits ``d`` with ``v`` permuted.

    In turn one half of the digits gets a keyed hash of the other half added, each digit
    modulo its radix: a bijection for any radices. Digits of radix 1 stay.
    """
    other = """array_join(filter(v, (y, j) -> (j < size(v) div 2) <> (k % 2 = 0)), ',')"""
    drawn = f"""cast(conv(substr(sha2(concat_ws('|', {_literal(key)}, d.kind, k, i, {other}), 256),
        1, 15), 16, 10) AS bigint)"""
    return f"""named_struct('m', d.m, 'kind', d.kind, 'v', aggregate(sequence(1, {rounds}), d.v, (v, k) ->
        transform(v, (x, i) -> CASE WHEN (i < size(v) div 2) = (k % 2 = 0) AND d.r[i] > 1
            THEN (x + {drawn}) % d.r[i] ELSE x END)))"""


def rendered() -> str:
    """SQL of permuted digits ``c`` in their format again."""
    chars = f"""array_join(transform({_CHARS}, (x, i) ->
        CASE WHEN x.own AND ({_RADIX}) > 1 THEN chr(({_BASE}) + c.v[i]) ELSE substr(c.m, i + 1, 1) END), '')"""
    day = f"date_add(date'{FIRST_DAY}', cast(c.v[0] * {DAYS[1]} + c.v[1] AS int))"
    order = _ORDER.replace("(m,", "(c.m,").replace("m RLIKE", "c.m RLIKE")
    mark = "substr(c.m, CASE WHEN c.m RLIKE '^[0-9]{4}' THEN 5 ELSE 3 END, 1)"
    shaped = f"""CASE {order} WHEN 'ymd' THEN date_format({day}, 'yyyy-MM-dd')
        WHEN 'dmy' THEN date_format({day}, 'dd-MM-yyyy') ELSE date_format({day}, 'MM-dd-yyyy') END"""
    zero = _DIGITS.format(m=f"concat(substr({chars}, 1, length(c.m) - 1), '0')")
    # The check digits of an account number are 98 minus the remainder with 00 in their place.
    plain = f"replace(concat(substr(c.m, 1, 2), '00', substr({chars}, 5)), ' ', '')"
    return f"""CASE c.kind
        WHEN 'date' THEN replace({shaped}, '-', {mark})
        WHEN 'ssn' THEN concat(lpad(c.v[0] + CASE WHEN c.v[0] >= 665 THEN 2 ELSE 1 END, 3, '0'), '-',
            lpad(c.v[1] + 1, 2, '0'), '-', lpad(c.v[2] + 1, 4, '0'))
        WHEN 'ip' THEN array_join(c.v, '.')
        WHEN 'card' THEN concat(substr({chars}, 1, length(c.m) - 1), (10 - {_luhn(zero)} % 10) % 10)
        WHEN 'iban' THEN concat(substr(c.m, 1, 2), lpad(98 - {_mod97(plain)}, 2, '0'), substr({chars}, 5))
        ELSE {chars} END"""


def pseudonymise(
    docs: DataFrame, key: str = KEY, kinds: tuple[str, ...] = tuple(FORMATS), rounds: int = ROUNDS
) -> DataFrame:
    """``docs`` with pseudonyms in ``text``, and ``found``: array of (kind, value, pseudonym).

    All rows and columns stay; a column called found is replaced. Values that aren't
    valid (a wrong check digit, an impossible date) stay as they are and aren't listed.
    Null text stays null and has nothing found. ``found`` holds the values themselves:
    select what is to be published.
    """
    docs = docs.drop("found")
    starts = "(?=" + pattern(kinds) + ")"
    numbers = tuple(k for k in kinds if k != "email")
    ahead = [FORMATS["email"]] * ("email" in kinds) + [f"(?={pattern(numbers, 1)})(?s:.{{1,{WINDOW}}})"] * bool(numbers)
    windows = f"(?=({'|'.join(ahead)}))"
    # Every format holds a digit or an @. The blank before the text makes the first piece its own.
    some = docs.withColumn("_some", F.expr("coalesce(text RLIKE '[0-9@]', false)"))
    steps = [
        ("_pieces", f"CASE WHEN _some THEN split(concat(' ', text), {_literal(starts)}, -1) ELSE array() END"),
        ("_windows", f"CASE WHEN size(_pieces) > 1 THEN regexp_extract_all(text, {_literal(windows)}, 1) ELSE array() END"),
        ("_coded", f"""transform(transform(_windows, (w, i) -> concat(right(_pieces[i], 1), w)),
            t -> {coded(kinds)})"""),
        ("_kept", _KEPT),
        ("_digits", f"transform(_kept, c -> {digits()})"),
        ("_permuted", f"transform(_digits, d -> {feistel(key, rounds)})"),
        ("_named", f"""transform(_permuted, c -> named_struct('kind', c.kind, 'value', c.m,
            'pseudonym', CASE WHEN c.kind IS NULL THEN '' ELSE {rendered()} END))"""),
    ]
    for name, sql in steps:
        some = some.withColumn(name, F.expr(sql))
    replaced = """CASE WHEN size(_kept) = 0 THEN text ELSE concat(substr(_pieces[0], 2),
        array_join(zip_with(_named, _kept, (n, k) -> concat(n.pseudonym, k.tail)), '')) END"""
    return some.select(
        *[F.col(f"`{c}`") if c != "text" else F.expr(replaced).alias("text") for c in docs.columns],
        F.expr("filter(_named, n -> n.kind IS NOT NULL)").alias("found"),
    )
