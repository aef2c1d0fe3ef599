"""Format-preserving pseudonyms of personal data, in DataFrame functions alone.

Found values are validated, then put through a keyed Feistel network over
their own format: the same value gives the same pseudonym in every document,
different values of a format give different ones, and with the key the step
can be reversed.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"

#: A credential's value: what stands in quotes, or all up to white space or a quote but the punctuation at its end.
_QUOTED = r"(?:\"[^\"\r\n]{6,200}(?=\"|$)|'[^'\r\n]{6,200}(?='|$))"
_OPEN = r"[\"']?[^\s\"']{7,}[^\s\"'.,;:!?)\]}]"
_MARK = r"[\"']?\s{0,2}[=:]\s{0,2}"
#: Names whose value is a credential whatever it looks like, and those that prose uses too: their value is in quotes or has a digit.
_NAMED = rf"(?i:password|passwd|pwd|api[_-]?key){_MARK}(?:{_QUOTED}|{_OPEN})"
_VAGUE = rf"(?i:secret|token){_MARK}(?:{_QUOTED}|(?=\S{{0,80}}\d){_OPEN})"
#: What a number's run of groups doesn't go into: days of expiry, social security and telephone numbers, dates.
_OTHERS = r"\d{1,4}/\d|\d{3}-\d{2}-\d{4}(?![\w-])|\d{3}-\d{3}-\d{4}(?![\w-])|(?:19|20)\d\d-\d\d-\d\d(?![\w-])|\d\d-\d\d-(?:19|20)\d\d(?![\w-])"

#: Kinds in the order in which they are tried at a place of the text. Quantifiers of groups have ends, so that the matcher's stack has one too.
PATTERNS = {
    "email": r"(?<![\p{L}\p{M}\p{N}_.%+-])[\p{L}\p{M}\p{N}_.%+-]{1,64}+@(?:[\p{L}\p{M}\p{N}-]{1,63}+\.){1,8}\p{L}{2,24}(?![\p{L}\p{M}\p{N}_-])",
    "secret": rf"(?<!\w)AKIA[A-Z0-9]{{16}}(?!\w)|{_NAMED}|{_VAGUE}",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}+(?!\w)|(?: [A-Z0-9]{4}){2,9}(?: [A-Z0-9]{1,3})?(?!\w|[-/.]\d))",
    "ip": rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)",
    "date": r"(?<![\w.-])(?:(?:19|20)\d\d([-/.])\d\d\1\d\d|\d\d([-/.])\d\d\2(?:19|20)\d\d)(?!(?!T\d)[\w-]|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": rf"(?<![\w.+-])\d(?:(?:[ -](?!{_OTHERS}))?\d){{12,200}}(?![\w-]|\.\d)",
    "phone": r"(?<![\w+])\+\d{1,3}(?:[ .-]?\(?\d{1,4}\)?){2,5}(?!\w)|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])",
}
#: The dates' back references hold here too, as no kind before them has a capturing group.
ANY = "|".join(PATTERNS.values())
#: What each kind holds at least one of; texts without are left as they are after one quick look.
HINT = r"[0-9@]|AKIA|(?i:passw|pwd|secret|token|api[_-]?key)"

#: How cards are written behind other numbers of their run: fours (and three), American Express and Diners, or in one piece.
CARD_FORMS = (r"^\d{4}([ -])\d{4}\1\d{4}\1\d{4}\1\d{3}(?!\d)", r"^\d{4}([ -])\d{4}\1\d{4}\1\d{4}(?!\d)", r"^\d{4}[ -]\d{6}[ -]\d{4,5}(?!\d)", r"^\d{13,19}(?!\d)")

#: A country code at the start of an international number: fixed values of the numbering plan, of one or two digits, or else three.
COUNTRY = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"

ROUNDS = 8
#: Days of the years 1900 to 2099, 73,049, as the product of the two sides of their Feistel network.
DAY_SIDES = (319, 229)
#: Valid area numbers (001 to 899 but 666) times valid groups, and valid serials.
SSN_SIDES = (898 * 99, 9999)


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def _digest(key: str, tweak: Column, turn: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), tweak, turn.cast("string"), half), 256)


def _moved(char: Column, by: Column, alphabets: tuple[str, ...]) -> Column:
    """``char`` moved on by ``by`` places within the alphabet that holds it; as it is if none does."""
    out = char
    for letters in reversed(alphabets):
        place = F.instr(F.lit(letters), char)
        fits = (F.length(char) > 0) if letters.isascii() else (F.octet_length(char) > 1)
        out = F.when(fits & (place > 0), F.substr(F.lit(letters), (place - 1 + by) % len(letters) + 1, F.lit(1))).otherwise(out)
    return out


def _bare(value: Column) -> Column:
    """The digits of a number, so that equal numbers are linked however they are written."""
    return F.regexp_replace(value, "[^0-9]", "")


def _relaid(value: Column, digits: Column) -> Column:
    """``value`` with ``digits`` in the places of its own."""
    at = lambda k: F.length(_bare(F.substr(value, F.lit(1), k)))
    char = lambda k: F.substr(value, k, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), lambda k: F.when(char(k).rlike("[0-9]"), F.substr(digits, at(k), F.lit(1))).otherwise(char(k))), "")


DIGITS = ("0123456789",)
HEX = ("0123456789abcdef",)
CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _letters(first: int, last: int) -> str:
    return "".join(c for c in map(chr, range(first, last + 1)) if c.isalpha())


#: Letters of further scripts: Latin (lower, capital, extended), Greek, Cyrillic, Kana, Hangul, Han.
SCRIPTS = tuple(_letters(a, b) for a, b in ((0xDF, 0xFF), (0xC0, 0xDE), (0x100, 0x17F), (0x3B1, 0x3C9), (0x391, 0x3A9), (0x430, 0x44F), (0x410, 0x42F), (0x3041, 0x3096), (0x30A1, 0x30FA), (0xAC00, 0xD7A3), (0x4E00, 0x9FA5)))


def permute_chars(value: Column, key: str, tweak: Column, alphabets: tuple[str, ...]) -> Column:
    """A Feistel network over a string: each character stays in its alphabet, others stay what they are.

    In each round the characters of one half move by amounts that a keyed
    digest of the other half gives; then the halves change roles. A string
    with one such character has an empty or fixed other half and still moves.
    """
    chars = F.filter(F.split(value, ""), lambda c: F.length(c) > 0)

    def turn(state: Column, r: Column) -> Column:
        def shifted(digest: Column) -> Column:
            def one(c: Column, i: Column) -> Column:
                by = F.conv(F.substr(digest, F.pmod(i * 4, F.lit(60)) + 1, F.lit(4)), 16, 10).cast("int")
                return _moved(c, by, alphabets)

            return F.transform(state["x"], one)

        return F.struct(state["y"].alias("x"), _let(_digest(key, tweak, r, F.array_join(state["y"], "")), shifted).alias("y"))

    def run(all_chars: Column) -> Column:
        half = F.floor(F.size(all_chars) / 2).cast("int")
        start = F.struct(F.slice(all_chars, F.lit(1), half).alias("x"), F.slice(all_chars, half + 1, F.size(all_chars)).alias("y"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: F.array_join(F.concat(s["x"], s["y"]), ""))

    return F.when(F.length(value) > 0, _let(chars, run)).otherwise(value)


def permute_pair(a: Column, b: Column, sides: tuple[int, int], key: str, tweak: Column) -> Column:
    """A Feistel network over pairs of numbers below ``sides``: struct(x, y)."""

    def turn(state: Column, r: Column) -> Column:
        def number(half: Column) -> Column:
            return F.conv(F.substring(_digest(key, tweak, r, half.cast("string")), 1, 15), 16, 10).cast("long")

        odd = r % 2 == 1
        x = F.when(odd, F.pmod(state["x"] + number(state["y"]), F.lit(sides[0]))).otherwise(state["x"])
        y = F.when(odd, state["y"]).otherwise(F.pmod(state["y"] + number(state["x"]), F.lit(sides[1])))
        return F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(a.cast("long").alias("x"), b.cast("long").alias("y")), turn)


def _digit_list(value: Column) -> Column:
    return F.transform(F.filter(F.split(value, ""), lambda c: c.rlike("[0-9]")), lambda c: c.cast("int"))


def luhn_rest(value: Column) -> Column:
    """Luhn sum of a number's digits, modulo 10: 0 for a valid one."""
    return F.aggregate(F.transform(F.reverse(_digit_list(value)), lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)), F.lit(0), lambda s, d: s + d) % 10


def mod97(value: Column) -> Column:
    """Remainder of an IBAN-like string, letters read as 10 to 35."""

    def step(rest: Column, c: Column) -> Column:
        n = F.ascii(c)
        return F.when(n < 58, rest * 10 + (n - 48)).otherwise(rest * 100 + (n - 55)) % 97

    return F.aggregate(F.filter(F.split(value, ""), lambda c: F.length(c) > 0), F.lit(0), step)


def _valid_start(value: Column, least: int, most: int, valid) -> Column:
    """How long the longest valid start of ``value`` is that ends with a group and has from ``least`` to ``most`` letters and digits; null if none is."""

    def fits(n: Column) -> Column:
        start = F.substr(value, F.lit(1), n)
        return F.substr(value, n + 1, F.lit(1)).isin("", " ", "-") & F.length(F.regexp_replace(start, "[ -]", "")).between(least, most) & valid(start)

    longest = F.least(F.length(value), F.lit(2 * most))
    return F.when(longest >= least, F.get(F.filter(F.sequence(longest, F.lit(least), F.lit(-1)), fits), F.lit(0)))


def _parts_made(value: Column, length_at, made) -> Column:
    """struct(value, n): ``value`` with ``made`` of its valid parts, ``n`` of them, and what is before, between and behind as it is; n is 0 if it has none.

    ``length_at`` gives the length of the part that begins at a group's
    place, or null. Parts are taken from the left, so a short number before,
    between or behind cards or IBANs hides none.
    """

    def step(state: Column, p: Column) -> Column:
        def joined(n: Column) -> Column:
            text = F.concat(state["text"], F.substr(value, state["at"], p - state["at"]), _let(F.substr(value, p, n), made))
            return F.when(n.isNotNull(), F.struct((p + n).alias("at"), text.alias("text"), (state["n"] + 1).alias("n"))).otherwise(state)

        return _let(F.when(p >= state["at"], length_at(p)), joined)

    starts = F.filter(F.sequence(F.lit(1), F.length(value)), lambda p: (p == 1) | F.substr(value, p - 1, F.lit(1)).isin(" ", "-"))
    begin = F.struct(F.lit(1).alias("at"), F.lit("").alias("text"), F.lit(0).alias("n"))
    return F.aggregate(starts, begin, step, lambda s: F.struct(F.concat(s["text"], F.substr(value, s["at"])).alias("value"), s["n"].alias("n")))


def _card(value: Column, key: str) -> Column:
    def finished(moved: Column) -> Column:
        # The digit that makes the sum 0 stands where it counts once.
        return F.concat(moved, F.pmod(10 - luhn_rest(F.concat(moved, F.lit("0"))), F.lit(10)).cast("string"))

    def made(card: Column) -> Column:
        whole = _let(permute_chars(F.substr(_bare(card), F.lit(1), F.length(_bare(card)) - 1), key, F.lit("card"), DIGITS), finished)
        return _let(whole, lambda digits: _relaid(card, digits))

    valid = lambda card: luhn_rest(card) == 0

    def length_at(p: Column) -> Column:
        # At the run's own start groups of any length count; elsewhere only a card's usual forms, as tables of numbers hold many that are right by chance.
        forms = [F.regexp_extract(F.substr(value, p, F.lit(24)), form, 0) for form in CARD_FORMS]
        laid_out = F.coalesce(*(_let(form, lambda card: F.when((F.length(card) > 0) & valid(card), F.length(card))) for form in forms))
        return F.when(p == 1, _valid_start(value, 13, 19, valid)).otherwise(laid_out)

    return _parts_made(value, length_at, made)


def _iban(value: Column, key: str) -> Column:
    compact = lambda iban: F.regexp_replace(iban, " ", "")

    def valid(iban: Column) -> Column:
        return mod97(F.concat(F.substr(compact(iban), F.lit(5)), F.substring(iban, 1, 4))) == 1

    def made(iban: Column) -> Column:
        country = F.substring(iban, 1, 2)

        def finished(body: Column) -> Column:
            rest = mod97(F.concat(body, country, F.lit("00")))
            return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), body)

        whole = _let(permute_chars(F.substr(compact(iban), F.lit(5)), key, F.lit("iban"), CLASSES), finished)
        return F.when(F.instr(iban, " ") > 0, F.regexp_replace(whole, "(.{4})(?=.)", "$1 ")).otherwise(whole)

    def length_at(p: Column) -> Column:
        return _let(F.substr(value, p), lambda rest: F.when(rest.rlike(r"^[A-Z]{2}\d{2}"), _valid_start(rest, 15, 34, valid)))

    return _parts_made(value, length_at, made)


def _ip(value: Column, key: str) -> Column:
    def pair(octets: Column) -> Column:
        at = lambda k: octets[k].cast("int")
        return permute_pair(at(0) * 256 + at(1), at(2) * 256 + at(3), (65536, 65536), key, F.lit("ip"))

    show = lambda p: F.concat_ws(".", F.shiftright(p["x"], 8), p["x"] % 256, F.shiftright(p["y"], 8), p["y"] % 256)
    return _let(_let(F.split(value, r"\."), pair), show)


def _ssn(value: Column, key: str) -> Column:
    area, group, serial = (F.substring(value, s, n).cast("int") for s, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area >= 1) & (area <= 899) & (area != 666) & (group > 0) & (serial > 0)
    rank = F.when(area > 666, area - 2).otherwise(area - 1)

    def show(p: Column) -> Column:
        a = F.floor(p["x"] / 99)
        a = F.when(a >= 665, a + 2).otherwise(a + 1)
        return F.concat_ws("-", F.lpad(a.cast("string"), 3, "0"), F.lpad((p["x"] % 99 + 1).cast("string"), 2, "0"), F.lpad((p["y"] + 1).cast("string"), 4, "0"))

    return F.when(valid, _let(permute_pair(rank * 99 + group - 1, serial - 1, SSN_SIDES, key, F.lit("ssn")), show))


def _date(value: Column, key: str) -> Column:
    """Year first, or else day first, or else month first: the first reading that is a day."""
    first = "1900-01-01"

    def read(year: Column, month: Column, day: Column, form: str) -> Column:
        date = F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-MM-dd")
        n = F.datediff(date, F.lit(first).cast("date"))
        moved = permute_pair(F.floor(n / DAY_SIDES[1]), n % DAY_SIDES[1], DAY_SIDES, key, F.lit("date"))
        return F.when(date.isNotNull(), _let(moved, lambda p: F.date_format(F.date_add(F.lit(first).cast("date"), (p["x"] * DAY_SIDES[1] + p["y"]).cast("int")), form)))

    part = lambda s, n: F.substring(value, s, n)
    bare = F.when(value.rlike(r"^\d{4}"), read(part(1, 4), part(6, 2), part(9, 2), "yyyyMMdd")).otherwise(
        F.coalesce(read(part(7, 4), part(4, 2), part(1, 2), "ddMMyyyy"), read(part(7, 4), part(1, 2), part(4, 2), "MMddyyyy"))
    )
    year_first = value.rlike(r"^\d{4}")
    mark = F.when(year_first, part(5, 1)).otherwise(part(3, 1))

    def joined(d: Column) -> Column:
        at = lambda s, n: F.substring(d, s, n)
        return F.when(year_first, F.concat(at(1, 4), mark, at(5, 2), mark, at(7, 2))).otherwise(F.concat(at(1, 2), mark, at(3, 2), mark, at(5, 4)))

    return _let(bare, joined)


def _secret(value: Column, key: str) -> Column:
    head = F.regexp_extract(value, r"^(AKIA|[^=:]*[=:]\s*[\"']?)", 1)
    rest = F.substr(value, F.length(head) + 1)
    tweak = F.lit("secret")
    return F.concat(head, F.when(rest.rlike("^[0-9a-f]+$"), permute_chars(rest, key, tweak, HEX)).otherwise(permute_chars(rest, key, tweak, CLASSES + SCRIPTS)))


def _email(value: Column, key: str) -> Column:
    end = F.regexp_extract(value, r"(\.\p{L}+)$", 1)
    return F.concat(permute_chars(F.substr(value, F.lit(1), F.length(value) - F.length(end)), key, F.lit("email"), CLASSES + SCRIPTS), end)


def _phone(value: Column, key: str) -> Column:
    def made(digits: Column) -> Column:
        head = F.when(value.startswith("+"), F.regexp_extract(digits, COUNTRY, 0)).otherwise("")
        moved = F.concat(head, permute_chars(F.substr(digits, F.length(head) + 1), key, F.lit("phone"), DIGITS))
        return F.when(F.length(digits).between(8, 15), _let(moved, lambda d: _relaid(value, d)))

    return _let(_bare(value), made)


_MAKERS = {"email": _email, "secret": _secret, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone}


#: Kinds whose matches can hold several values, and other numbers.
_RUNS = ("iban", "card")


def pseudonym(value: Column, key: str) -> Column:
    """struct(kind, value, n): a match's kind, the match with its pseudonyms, and their number; kind null, n 0 and the match as it is where nothing in it is valid."""

    def row(kind: Column, made: Column, n: Column) -> Column:
        return F.struct(kind.alias("kind"), made.alias("value"), n.alias("n"))

    def kept(kind: str):
        if kind in _RUNS:
            return lambda made: row(F.when(made["n"] > 0, F.lit(kind)), made["value"], made["n"])
        return lambda made: row(F.when(made.isNotNull(), F.lit(kind)), F.coalesce(made, value), F.when(made.isNotNull(), 1).otherwise(0))

    out = row(F.lit(None).cast("string"), value, F.lit(0))
    for kind in reversed(PATTERNS):
        out = F.when(value.rlike(f"^(?:{PATTERNS[kind]})$"), _let(_MAKERS[kind](value, key), kept(kind))).otherwise(out)
    return out


#: The setting that holds the key, and what stands for it where a session sets none: results are then repeatable, and not secret.
KEY_SETTING, OPEN_KEY = "spark.tidemark.pii.key", "change me"


def session_key(spark: SparkSession) -> str:
    """The key that the session sets. Without one the open key, with a warning."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        warnings.warn(f"{KEY_SETTING} is not set: pseudonyms under the open key can be reversed by anyone", stacklevel=2)
    return key or OPEN_KEY


def pseudonymise(df: DataFrame, key: str, text_col: str = "text", count_col: str | None = None, kinds_col: str | None = None) -> DataFrame:
    """``df`` with the personal data in ``text_col`` replaced, all other columns as they are.

    Emails (all but the top-level name), credentials, IBANs (with right check
    digits), IPv4 addresses, dates from 1900 to 2099, social security
    numbers, card numbers (with a right Luhn digit) and telephone numbers
    (but the country code) that pass their kind's validation give way to
    their pseudonym under ``key``; numbers that fail it stay. A card or an
    IBAN is found before, between and behind other numbers too: behind them a
    card in its usual forms (``CARD_FORMS``), and within a run of 201 digits.
    A credential goes up to white space or its closing quote. Cards, IBANs
    and telephone numbers keep their separators, which don't enter the
    pseudonym. In mail names letters of Latin, Greek, Cyrillic, Kana, Hangul
    and Han move within their script. One narrow
    pass of JVM functions: no shuffle, no state, so repeated rows and any
    skew are harmless and links between documents need no lookup.

    ``count_col`` and ``kinds_col``, if given, are added: the number of
    replacements and their kinds, sorted and comma-separated ('' for none).
    A null text stays null (0 and ''), an empty one empty; repeated rows and
    an empty table give as many rows. Time and memory grow with a text's
    length.

    ``key`` is the deployment's own; a name that the session sets is read by
    ``session_key``.
    """
    text = F.col(f"`{text_col}`")
    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    held = "pii"
    while held in df.columns or held in (count_col, kinds_col):
        held += "_"
    rows = df.withColumn(held, F.when(text.rlike(HINT), F.struct(F.split(text, ANY, -1).alias("between"), F.transform(found, lambda m: pseudonym(m, key)).alias("found"))))
    between, made = F.col(f"{held}.between"), F.col(f"{held}.found")
    whole = F.array_join(F.flatten(F.zip_with(between, F.transform(made, lambda m: m["value"]), lambda b, m: F.array(b, F.coalesce(m, F.lit(""))))), "")
    kinds = F.filter(F.transform(made, lambda m: m["kind"]), lambda k: k.isNotNull())
    if count_col:
        rows = rows.withColumn(count_col, F.coalesce(F.aggregate(made, F.lit(0), lambda n, m: n + m["n"]), F.lit(0)))
    if kinds_col:
        rows = rows.withColumn(kinds_col, F.coalesce(F.array_join(F.array_sort(F.array_distinct(kinds)), ","), F.lit("")))
    return rows.withColumn(text_col, F.when(F.size(made) > 0, whole).otherwise(text)).drop(held)
