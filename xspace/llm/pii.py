"""Format-preserving Feistel pseudonyms for personal data, in SQL expressions only.

A value found in a text is checked (check digits, ranges, calendar), permuted by a
keyed Feistel network within its own format, and put back with its separators. The
permutation is the same everywhere, so equal values stay equal across documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

ROUNDS = 8
# Patterns of the kinds.
# Runs are possessive and start at their first character, so no text is quadratic.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "token": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36})(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "date": r"(?<![0-9./-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./](?:19|20)[0-9]{2})(?![0-9]|[./-][0-9])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
    # 3-3-4 with dots, hyphens or a bracketed area; + and a country code; in spaces, without
    # separators or with another bracketed area only in a national form or after a cue
    "phone": r"(?<![0-9A-Za-z+])(?:(?:\+[0-9]{1,3}[ .-]?|1[ .-])?(?:\([0-9]{3}\) ?[0-9]{3}[ .-]|[0-9]{3}[.-][0-9]{3}[.-])[0-9]{4}(?![0-9A-Za-z])"
    r"|\+[1-9](?:[ .-]?\(?[0-9]\)?){6,14}(?![0-9A-Za-z])|(?:1 )?[2-9][0-9]{2} [2-9][0-9]{2} [0-9]{4}(?![0-9A-Za-z])"
    r"|\(0[0-9]{1,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9A-Za-z])"
    r"|(?=[0-9(])(?<=\b(?i:tel|telephone|phone|mobile|cell|call|dial|fax|sms|whatsapp)(?: (?i:no|nr|number))?[.:]{0,2} {0,2})"
    r"(?:\([0-9]{2,5}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|[0-9]{3} [0-9]{3} [0-9]{4}|[0-9]{10})(?![0-9A-Za-z]))",
}
# Each kind is looked for in the text that valid values of the kinds before it have left.
ORDER = ("email", "token", "iban", "date", "ip", "ssn", "phone", "card")
# Kinds of several groups are found as whole runs of groups, and tried within them.
RUNS = {
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}[A-Z0-9]*+(?![a-z])(?: [A-Z0-9]++(?![a-z]))*+",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,}+(?![A-Za-z])",
}
GROUPS = {"iban": ("[A-Z0-9]+ ?", 12), "card": ("[0-9]+[ -]?", 19)}  # a group; most groups of a value
COUNTRY = "^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
# Digits after a country code, least and most; other codes have 6 to 12.
NATIONAL = {
    1: (10, 10), 7: (10, 10), 20: (8, 10), 27: (9, 9), 30: (10, 10), 31: (9, 9), 32: (8, 9), 33: (9, 9), 34: (9, 9),
    36: (8, 9), 39: (6, 11), 40: (9, 9), 41: (9, 9), 43: (7, 13), 44: (9, 10), 45: (8, 8), 46: (7, 10), 47: (8, 8),
    48: (9, 9), 49: (7, 13), 51: (8, 9), 52: (10, 10), 54: (10, 11), 55: (10, 11), 56: (9, 9), 57: (10, 10), 60: (8, 10),
    61: (9, 9), 62: (8, 12), 63: (8, 10), 64: (8, 10), 65: (8, 8), 66: (8, 9), 81: (9, 10), 82: (8, 10), 84: (9, 10),
    86: (10, 11), 90: (10, 10), 91: (10, 10), 92: (9, 10), 351: (9, 9), 353: (7, 9), 420: (9, 9), 421: (9, 9), 852: (8, 8),
    886: (8, 9), 966: (8, 9), 971: (8, 9), 972: (8, 9),
}
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
HEX = DIGITS + "abcdef"
# Dates are permuted within 1900-01-01 .. 2099-12-31.
FIRST_DAY, N_DAYS, DAY_BASE = "DATE '1900-01-01'", 73049, 271


def quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def is_kind(m: str, kind: str) -> str:
    """The whole match has the form of a kind (neighbours were checked when it was found)."""
    form = KINDS[kind]
    form = form[form.index(")") + 1 :]
    return f"{m} RLIKE {quoted('^(?:' + form + ')$')}"


def _shifted(part: str, other: str, round_: str, key: str, hexes: str, v: str) -> str:
    """``part`` with each letter or digit moved within its class by a keyed stream of ``other``."""
    ch = f"substring({part}, {v}, 1)"
    stream = (
        f"CAST(conv(substring(sha2(concat({quoted(key)}, '|', {round_}, '|', ({v} - 1) DIV 16, '|', {other}), 256),"
        f" 4 * (({v} - 1) % 16) + 1, 4), 16, 10) AS int)"
    )
    move = lambda abc: (
        f"substring('{abc}', (instr('{abc}', {ch}) - 1 + {stream}) % {len(abc)} + 1, 1)"
    )
    one = (
        f"CASE WHEN {hexes} AND instr('{HEX}', {ch}) > 0 THEN {move(HEX)}"
        f" WHEN instr('{DIGITS}', {ch}) > 0 THEN {move(DIGITS)}"
        f" WHEN instr('{LOWER}', {ch}) > 0 THEN {move(LOWER)}"
        f" WHEN instr('{UPPER}', {ch}) > 0 THEN {move(UPPER)} ELSE {ch} END"
    )
    return (
        f"CASE WHEN length({part}) = 0 THEN '' ELSE"
        f" array_join(transform(sequence(1, length({part})), {v} -> {one}), '') END"
    )


def feistel(s: str, key: str, hexes: str = "false", tag: str = "f") -> str:
    """Permutation of the strings that have a letter, digit or separator where ``s`` has one."""
    a, i, v = f"{tag}_a", f"{tag}_i", f"{tag}_v"
    start = f"named_struct('l', substring({s}, 1, length({s}) DIV 2), 'r', substring({s}, length({s}) DIV 2 + 1))"
    right = f"named_struct('l', {a}.l, 'r', {_shifted(f'{a}.r', f'{a}.l', i, key, hexes, v)})"
    left = f"named_struct('l', {_shifted(f'{a}.l', f'{a}.r', i, key, hexes, v)}, 'r', {a}.r)"
    return (
        f"aggregate(sequence(1, {ROUNDS}), {start},"
        f" ({a}, {i}) -> IF({i} % 2 = 1, {right}, {left}), {a} -> concat({a}.l, {a}.r))"
    )


def feistel_number(x: str, base: int, key: str, tag: str) -> str:
    """Permutation of 0 .. base^2 - 1."""
    a, i = f"{tag}_a", f"{tag}_i"
    prf = f"CAST(conv(substring(sha2(concat({quoted(key)}, '|{tag}|', {i}, '|', {a}.r), 256), 1, 12), 16, 10) AS bigint)"
    return (
        f"aggregate(sequence(1, {ROUNDS}), named_struct('l', ({x}) DIV {base}, 'r', ({x}) % {base}),"
        f" ({a}, {i}) -> named_struct('l', {a}.r, 'r', ({a}.l + {prf}) % {base}), {a} -> {a}.l * {base} + {a}.r)"
    )


def walked(x: str, step, valid, tag: str, steps: int = 64) -> str:
    """Cycle walking: permute ``x`` until the value is valid again (within ``steps``: never missed in practice)."""
    w, n = f"{tag}_w", f"{tag}_n"
    return f"aggregate(sequence(0, {steps}), {x}, ({w}, {n}) -> IF({n} > 0 AND {valid(w)}, {w}, {step(w)}))"


def luhn(d: str, tag: str) -> str:
    """Luhn sum of a digit string."""
    a, i = f"{tag}_a", f"{tag}_i"
    digit = f"CAST(substring({d}, length({d}) + 1 - {i}, 1) AS int)"
    return (
        f"aggregate(sequence(1, length({d})), 0, ({a}, {i}) -> {a} + IF({i} % 2 = 1, {digit},"
        f" 2 * {digit} - IF({digit} > 4, 9, 0)))"
    )


def mod97(s: str, tag: str) -> str:
    """Remainder by 97 of a string whose letters count as 10 .. 35."""
    a, i = f"{tag}_a", f"{tag}_i"
    value = f"(instr('{DIGITS + UPPER}', substring({s}, {i}, 1)) - 1)"
    return (
        f"aggregate(sequence(1, length({s})), 0, ({a}, {i}) ->"
        f" ({a} * IF({value} > 9, 100, 10) + {value}) % 97)"
    )


def placed(m: str, chars: str, form: str, tag: str) -> str:
    """``m`` with its characters of the class ``form`` replaced by those of ``chars`` in turn."""
    i = f"{tag}_i"
    return (
        f"array_join(transform(sequence(1, length({m})), {i} -> IF(substring({m}, {i}, 1) RLIKE '^{form}$',"
        f" substring({chars}, length(regexp_replace(substring({m}, 1, {i}), '[^{form[1:]}', '')), 1),"
        f" substring({m}, {i}, 1))), '')"
    )


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _date_parts(m: str) -> dict[str, str]:
    """How a match can be read as a date: its pattern and the calendar day."""
    piece = lambda k: f"split({m}, '[-./]')[{k}]"
    day = lambda y, mo, d: f"try_to_date(concat_ws('-', {y}, lpad({mo}, 2, '0'), lpad({d}, 2, '0')), 'yyyy-MM-dd')"
    return {
        "ymd": f"IF({m} LIKE '%-%', {day(piece(0), piece(1), piece(2))}, NULL)",
        "dmy": f"IF({m} LIKE '%-%', NULL, {day(piece(2), piece(1), piece(0))})",
        "mdy": f"IF({m} LIKE '%-%', NULL, {day(piece(2), piece(0), piece(1))})",
    }


def _country_digits(m: str, d: str) -> str:
    """Leading digits of a phone number that its pseudonym keeps: country code or trunk zero."""
    return (
        f"CASE WHEN {m} LIKE '+%' THEN length(regexp_extract({d}, {quoted(COUNTRY)}, 0))"
        f" WHEN {m} LIKE '(0%' AND NOT {d} RLIKE '^[0-9]{{10}}$' THEN 1"
        f" ELSE greatest(length({d}) - 10, 0) END"
    )


def _is_phone(m: str) -> str:
    """A number with + has a length its country uses and is no decimal; the other forms say what they are."""
    d = _digits(m)
    listed = "|".join(f"{c}[0-9]{{{lo},{hi}}}" for c, (lo, hi) in NATIONAL.items())
    others = f"(?!{'|'.join(map(str, NATIONAL))}){COUNTRY[1:]}[0-9]{{6,12}}"
    grouped = quoted(r"(?:\([0-9]{3}\) ?[0-9]{3}[ .-]|[0-9]{3}[.-][0-9]{3}[.-])[0-9]{4}$")
    decimal = quoted(r"^\+[0-9]+[.][0-9]+$")
    planned = f"NOT {m} RLIKE {decimal} AND {d} RLIKE {quoted(f'^(?:{listed}|{others})$')}"
    trunk = f"NOT {m} LIKE '(0%' OR length({d}) BETWEEN 9 AND 11"
    return f"CASE WHEN {m} RLIKE {grouped} THEN true WHEN {m} LIKE '+%' THEN {planned} ELSE {trunk} END"


def kind_tests(m: str) -> dict[str, str]:
    """Per kind, whether a match of its pattern holds what its form promises."""
    d, compact = _digits(m), f"replace({m}, ' ', '')"
    date = f"coalesce({', '.join(_date_parts(m).values())})"
    octets = f"forall(split({m}, '[.]'), o -> CAST(o AS int) <= 255 AND (length(o) = 1 OR NOT startswith(o, '0')))"
    ssn = f"{d} RLIKE '^(?!000|666|9)[0-9]{{3}}(?!00)[0-9]{{2}}(?!0000)[0-9]{{4}}$'"
    iban = mod97(f"concat(substring({compact}, 5), substring({compact}, 1, 4))", "im") + " = 1"
    return {
        "email": "true", "token": f"{m} RLIKE '[0-9]'", "iban": f"{is_kind(m, 'iban')} AND length({compact}) <= 34 AND {iban}",
        "date": f"{date} IS NOT NULL", "ip": octets, "ssn": ssn,
        "card": f"length({d}) BETWEEN 13 AND 19 AND {luhn(d, 'kl')} % 10 = 0", "phone": _is_phone(m),
    }


def _piece(text: str, kind: str = "''") -> str:
    return f"named_struct('t', {text}, 'k', {kind})"


def _pieces_of_run(m: str, kind: str) -> str:
    """A run of groups cut into valid values and the rest: leftmost first, longest first, at group borders."""
    group, most = GROUPS[kind]
    joined = lambda a, n: f"array_join(slice(rg, {a} + 1, {n}), '')"
    value = lambda j: f"regexp_replace({joined('ri', f'{j} - ri + 1')}, '[ -]$', '')"
    valid = _let(value("rj"), "rv", kind_tests("rv")[kind])
    ends = f"filter(sequence(least(ri + {most - 1}, size(rg) - 1), ri, -1), rj -> {valid})"
    # acc: pieces, first group not yet in a piece
    hit = (
        f"named_struct('out', concat(ra.out, array({_piece(joined('ra.at', 'ri - ra.at'))}, {_piece('rx', quoted(kind))},"
        f" {_piece('substring(' + joined('ri', 're[0] - ri + 1') + ', length(rx) + 1)')})), 'at', re[0] + 1)"
    )
    tried = _let(ends, "re", f"IF(size(re) = 0, ra, {_let(value('re[0]'), 'rx', hit)})")
    start = "named_struct('out', CAST(array() AS array<struct<t:string,k:string>>), 'at', 0)"
    body = (
        f"aggregate(sequence(0, size(rg) - 1), {start}, (ra, ri) -> IF(ri < ra.at, ra, {tried}),"
        f" ra -> concat(ra.out, array({_piece(joined('ra.at', 'size(rg) - ra.at'))})))"
    )
    return _let(f"regexp_extract_all({m}, {quoted(group)}, 0)", "rg", body)


def cut_sql(t: str, kind: str) -> str:
    """Pieces (t, k) of a text: valid values of a kind, and the text between them."""
    pattern = quoted(RUNS.get(kind, KINDS[kind]))
    one = _pieces_of_run("cm", kind) if kind in RUNS else f"array({_piece('cm', f'IF({kind_tests(chr(99) + chr(109))[kind]}, {quoted(kind)}, {quoted(str())})')})"
    tried = f"transform(cf, cm -> {one})"
    both = (
        f"flatten(zip_with(split({t}, {pattern}, -1), cp, (cg, cq) ->"
        f" concat(array({_piece('cg')}), coalesce(cq, CAST(array() AS array<struct<t:string,k:string>>)))))"
    )
    # text around a failing candidate stays one piece
    whole = (
        f"aggregate({both}, CAST(array() AS array<struct<t:string,k:string>>), (ca, cx) ->"
        f" IF(cx.k = '' AND size(ca) > 0 AND element_at(ca, -1).k = '',"
        f" concat(slice(ca, 1, size(ca) - 1), array({_piece('concat(element_at(ca, -1).t, cx.t)')})), concat(ca, array(cx))))"
    )
    plain = f"array({_piece(t)})"
    checked = _let(tried, "cp", f"IF(exists(cp, cq -> exists(cq, cx -> cx.k <> '')), {whole}, {plain})")
    return _let(f"regexp_extract_all({t}, {pattern}, 0)", "cf", f"IF(size(cf) = 0, {plain}, {checked})")


def pseudonym_sql(m: str, kind: str, key: str) -> str:
    """The pseudonym of a match of a kind; other matches unchanged."""
    d = _digits(m)
    body = f"substring({d}, 1, length({d}) - 1)"
    card = _let(
        feistel(body, key + "card", tag="c"), "nb",
        placed(m, f"concat(nb, (10 - {luhn(chr(99) + 'oncat(nb, ' + chr(39) + '0' + chr(39) + ')', 'cl')} % 10) % 10)", "[0-9]", "cp"),
    )
    ssn_ok = lambda x: f"{x} RLIKE '^(?!000|666|9)[0-9]{{3}}(?!00)[0-9]{{2}}(?!0000)[0-9]{{4}}$'"
    ssn_step = lambda x: feistel(x, key + "ssn", tag="s")
    ssn = _let(walked(d, ssn_step, ssn_ok, "s"), "ns", placed(m, "ns", "[0-9]", "sp"))
    # a phone number keeps its country code, and whether its digits are a North American number
    area = lambda x: f"({x} RLIKE '^[2-9][0-9]{{2}}[2-9][0-9]{{6}}$')"
    phone_step = lambda x: feistel(x, key + "phone", tag="p")
    national = _let(f"substring({d}, {_country_digits(m, d)} + 1)", "pd", walked(
        "pd", phone_step, lambda x: f"{area(x)} = {area('pd')}", "pw"
    ))
    phone = _let(f"concat(substring({d}, 1, {_country_digits(m, d)}), {national})", "np", placed(m, "np", "[0-9]", "pp"))
    compact = f"replace({m}, ' ', '')"
    iban = _let(
        feistel(f"substring({compact}, 5)", key + "iban", tag="i"), "ni",
        placed(m, f"concat(substring({compact}, 1, 2), lpad(98 - {mod97(f'concat(ni, substring({compact}, 1, 2), {chr(39)}00{chr(39)})', 'iz')}, 2, '0'), ni)", "[0-9A-Z]", "ip"),
    )
    number = "aggregate(split({m}, '[.]'), 0L, (oa, ox) -> oa * 256 + CAST(ox AS int))".replace("{m}", m)
    ip = _let(
        feistel_number(number, 65536, key + "ip", "o"), "no",
        "concat_ws('.', shiftright(no, 24), shiftright(no, 16) & 255, shiftright(no, 8) & 255, no & 255)",
    )
    step = lambda x: feistel_number(x, DAY_BASE, key + "date", "d")
    read = _date_parts(m)

    first, second = (f"split({m}, '[-./]')[{k}]" for k in range(2))
    on = lambda x: f"date_add({FIRST_DAY}, CAST({x} AS int))"
    width = lambda x, like: f"IF(length({like}) = 2, lpad({x}, 2, '0'), CAST({x} AS string))"

    # readings: y-m-d, both (day and month up to 12), day first only, month first only; the
    # day moves among those of its reading whose digits are as many
    fits = lambda x, like: f"(length({like}) = 2 OR {x} < 10)"
    within = lambda x: (
        f"CASE WHEN {x} >= {N_DAYS} THEN false WHEN dk.ymd IS NOT NULL THEN true"
        f" WHEN dk.dmy IS NULL THEN dayofmonth({on(x)}) > 12 AND {fits(f'month({on(x)})', 'dk.a')}"
        f" ELSE (dayofmonth({on(x)}) <= 12) = (dk.mdy IS NOT NULL)"
        f" AND {fits(f'dayofmonth({on(x)})', 'dk.a')} AND {fits(f'month({on(x)})', 'dk.b')} END"
    )
    day = f"CAST(datediff(coalesce(dk.ymd, dk.dmy, dk.mdy), {FIRST_DAY}) AS bigint)"
    seps = "substring({m}, length(dk.a) + 1, 1)", "substring({m}, length(dk.a) + length(dk.b) + 2, 1)"
    put = lambda a, b: (
        f"concat({width(a, 'dk.a')}, {seps[0]}, {width(b, 'dk.b')}, {seps[1]}, year(dn))".replace("{m}", m)
    )
    written = (
        f"CASE WHEN dk.ymd IS NOT NULL THEN CAST(dn AS string)"
        f" WHEN dk.dmy IS NOT NULL THEN {put('dayofmonth(dn)', 'month(dn)')} ELSE {put('month(dn)', 'dayofmonth(dn)')} END"
    )
    parts = ", ".join(f"'{name}', {sql}" for name, sql in read.items())
    date = _let(
        f"named_struct({parts}, 'a', {first}, 'b', {second})", "dk",
        _let(on(walked(day, step, within, "d", 192)), "dn", written),
    )
    # of an address all but the last label is permuted
    local = f"substring({m}, 1, length({m}) - length(substring_index({m}, '.', -1)) - 1)"
    email = f"concat({feistel(local, key + 'email', tag='e')}, '.', substring_index({m}, '.', -1))"
    # the prefix that tells an issuer's tokens stays
    head = f"CASE WHEN {m} LIKE 'AKIA%' OR {m} LIKE 'gh__%' AND {m} LIKE '%\\_%' THEN substring({m}, 1, 4) ELSE '' END"
    is_hex = f"{m} RLIKE '^[0-9a-f]+$'"
    token = f"concat({head}, {feistel(f'substring({m}, length({head}) + 1)', key + 'token', is_hex, 't')})"
    cases = {"email": email, "token": token, "iban": iban, "date": date, "ip": ip, "ssn": ssn, "card": card, "phone": phone}
    return "CASE " + " ".join(f"WHEN {kind} = '{k}' THEN {sql}" for k, sql in cases.items()) + f" ELSE {m} END"


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", counts: bool = False) -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced by keyed pseudonyms.

    Addresses, hexadecimal and issuer tokens, IBANs, dates, IPv4 addresses, social
    security, card and phone numbers are replaced if valid; everything else of a text
    stays as it is, and so do null and empty texts, other columns and the row count.
    With ``counts`` a column ``n_<kind>`` per kind follows; an input column of that name
    gives way to it. A date is read day first where both readings are calendar days, and
    its pseudonym has the same readings and as many digits, so equal pseudonyms come from
    equal dates. Phone numbers are 3-3-4 groups divided by dots, hyphens or a bracketed
    area, whatever their digits; a + with a country code and as many digits as that country
    uses; North American numbers in spaces; an area with its trunk zero in brackets; and,
    right after a word such as "tel", ten digits in a row or any bracketed area. Country
    code and trunk zero stay. A kind is looked for in what valid values of the kinds before
    it left, and cards and IBANs at all group borders of longer runs. Repeated rows get
    equal texts; an empty table gives no rows.
    """
    text, held = f"`{text_col}`", "_known"
    taken = {c.lower() for c in docs.columns}
    while held in taken:
        held += "_"
    none = "CAST(array() AS array<struct<t:string,k:string>>)"
    known = docs.withColumn(held, F.expr(f"CASE WHEN {text} RLIKE '[0-9@]' THEN array({_piece(text)}) ELSE {none} END"))
    for kind in ORDER:
        cut = f"flatten(transform({held}, kx -> IF(kx.k = '', {cut_sql('kx.t', kind)}, array(kx))))"
        known = known.withColumn(held, F.expr(cut))
    joined = f"array_join(transform({held}, pm -> {pseudonym_sql('pm.t', 'pm.k', key)}), '')"
    out = {text_col: F.expr(f"CASE WHEN size({held}) > 1 THEN {joined} ELSE {text} END")}
    tally = {
        f"n_{k}": F.expr(f"CAST(coalesce(size(filter({held}, kx -> kx.k = '{k}')), 0) AS bigint)") for k in KINDS
    }
    tally = tally if counts else {}
    named = [out.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns if c.lower() not in tally]
    return known.select(*named, *[c.alias(n) for n, c in tally.items()])
