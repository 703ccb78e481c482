"""Format-preserving pseudonyms for personal data, as column expressions.

Values are found by one pattern, validated (Luhn, mod 97, calendar, octets,
assigned number ranges, telephone numbering plans) and replaced by a keyed
permutation of their own format, a Feistel network of ``ROUNDS`` rounds with
SHA-256 as its round function.  Equal values have equal pseudonyms in all
documents, different values different ones, and the shape (separators, length,
case, check digits) stays.  Numbers that fail validation are left alone, with
all their parts: a card or IBAN among other digits or words is found by its
checksum.

Over a product of two rings Z_a x Z_b the rounds add a keyed function of one
half to the other, in turn, which permutes the product whatever a and b are.
Where only a part of the product is valid, the permutation is applied until it
gives a valid value, which permutes the valid ones.  Texts (e-mail names,
secrets) are permuted by halves of characters, each within its own class:
digits, small and capital letters, hex digits, or the letters of its script
(``SCRIPTS``; letters of others stay in their places).

Formats: dates keep their order and separators, and are written without zeros
in front if day or month was.  Addresses of private networks stay in their
network; loopback, link-local, multicast and reserved ones, and numbers of four
parts after "version" or the like, are left alone.  Telephone numbers keep
their country code; those of the North American plan need valid area and
exchange codes, others a country code and 7 to 15 digits.

Null texts stay null and have zero counts; empty texts stay empty; long texts
are taken whole.  Repeated rows and ids are treated each, an empty table gives
no rows.  Columns of the input other than the text are kept as they are, those
with names like the counts' included, which then give way to the counts in
``pseudonymise``; ``replaced`` changes no column but the text.

The key must be given; whoever knows it may undo the pseudonyms.  It is part
of the query plan, so whoever may read plans knows it.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.durable import unused

ROUNDS = 8

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Characters of an IBAN by country.
_LENGTHS = {15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM TL SO", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}
_IBAN = "|".join(rf"(?:{'|'.join(names.split())})\d{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, names in _LENGTHS.items())
KINDS = {
    # possessive and anchored by what precedes, so that scanning stays linear
    "secret": r"(?i:(?<![\p{L}\p{N}])(?:api[_-]?key|access[_-]?key|auth[_-]?token|token|secret|passwd|password)[\"']?\s{0,3}[:=]\s{0,3}[\"']?)[A-Za-z0-9_/+=-]{12,}+|(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9_-]{20,}+)",
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+",
    # a known country's length first, then any
    "iban": rf"(?<![A-Za-z0-9])(?:{_IBAN}|[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?)(?![A-Za-z0-9])",
    "ip": rf"(?<![\w.])(?<!(?i:version|release|build|ver|rev|\bv)[ .:]{{0,2}}){_OCTET}(?:\.{_OCTET}){{3}}(?!\w|\.\d)",
    "date": r"(?<![\w/.-])(?:\d{4}-\d{2}-\d{2}(?=T\d)|(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\w/-]|\.\d))",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+.-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)",
}
# all digits of a run, up to a value of another kind; which of them are a card is found by checksum
KINDS["card"] = rf"(?<![\w-])\d(?:(?![ -](?:{KINDS['date']}|{KINDS['ssn']}|{KINDS['phone']}|{KINDS['ip']}))[ -]?\d){{12,254}}(?![\w])"
#: Cards as they are printed, for those among other numbers.
PRINTED = r"^(?:\d{13,19}|\d{4}(?:[ -]\d{4}){2,3}(?:[ -]\d{1,4})?|\d{4}[ -]\d{6}[ -]\d{4,5}|\d{6}[ -]\d{7,13}|\d{8}[ -]\d{8})$"
#: What a value of the kind may start with, tried before its pattern.
_STARTS = {"secret": "[AaTtSsPpGg]", "email": r"[\p{L}\p{N}._%+-]", "iban": r"[A-Z]{2}\d{2}"}
# no value starts within a word
PATTERN = r"(?<![A-Za-z0-9])(?:" + "|".join(f"(?={start})(?:{KINDS[kind]})" for kind, start in _STARTS.items()) + r"|(?=[\d+(])(?:" + "|".join(f"(?:{p})" for kind, p in KINDS.items() if kind not in _STARTS) + "))"

#: Calling codes of one and two digits; all others have three.
_CALLING = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
#: First and last letters of scripts: Latin with marks, Greek, Cyrillic, Armenian, Hebrew, Arabic, Devanagari, Thai, Georgian, kana, Han, Hangul.
SCRIPTS = [(0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F), (0x391, 0x3A1), (0x3A3, 0x3A9), (0x3B1, 0x3C9), (0x400, 0x40F), (0x410, 0x42F), (0x430, 0x44F), (0x450, 0x45F), (0x531, 0x556), (0x561, 0x586), (0x5D0, 0x5EA), (0x620, 0x64A), (0x904, 0x939), (0xE01, 0xE2E), (0x10D0, 0x10F0), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3)]

_DIGITS, _SMALL, _HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"


def _prf(key: str, domain: str, i: Column, x: Column) -> Column:
    """60 pseudo-random bits of round ``i`` and the value ``x``."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(domain), i.cast("string"), x.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(a: Column, b: Column, na: Column, nb: Column, key: str, domain: str) -> Column:
    """Struct (a, b): a permutation of Z_na x Z_nb, for each na and nb."""
    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    def turn(s: Column, i: Column) -> Column:
        other = F.when(i % 2 == 0, s["b"]).otherwise(s["a"])
        added = _prf(key, domain, i, other)
        return F.when(i % 2 == 0, F.struct(F.pmod(s["a"] + added, na).alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), F.pmod(s["b"] + added, nb).alias("b")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _then(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def permuted_digits(digits: Column, key: str, domain: str) -> Column:
    """Another string of as many digits (2 to 34)."""
    half = (F.length(digits) / 2).cast("int")
    rest = F.length(digits) - half
    power = lambda n: F.rpad(F.lit("1"), n + 1, "0").cast("long")
    a, b = F.substring(digits, F.lit(1), half).cast("long"), F.substring(digits, half + 1, rest).cast("long")
    mixed = feistel(a, b, power(half), power(rest), key, domain)
    return _then(mixed, lambda s: F.concat(F.lpad(s["a"].cast("string"), half, "0"), F.lpad(s["b"].cast("string"), rest, "0")))


def luhn_sum(digits: Column) -> Column:
    """Sum by Luhn, the last digit counted as it is."""
    at = F.transform(F.split(F.reverse(digits), ""), lambda c, i: _then(c.cast("int"), lambda d: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)))
    return F.aggregate(at, F.lit(0), lambda s, d: s + d)


def mod97(text: Column) -> Column:
    value = lambda c: F.instr(F.lit(_DIGITS + _SMALL.upper()), c) - 1
    return F.aggregate(F.split(text, ""), F.lit(0), lambda s, c: _then(value(c), lambda v: F.pmod(F.when(v < 10, s * 10 + v).otherwise(s * 100 + v), F.lit(97))))


def filled(template: Column, characters: Column, blank: str) -> Column:
    """``template`` with its characters of class ``blank`` taken in order."""
    done = F.aggregate(
        F.split(template, ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("k")),
        lambda s, c: F.when(c.rlike(blank), F.struct(F.concat(s["out"], F.substring(characters, s["k"], F.lit(1))).alias("out"), (s["k"] + 1).alias("k"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["k"].alias("k"))),
    )
    return done["out"]


def only(text: Column, blank: str) -> Column:
    return F.regexp_replace(text, f"[^{blank}]", "")


def parts(hit: Column, valid, changed) -> Column:
    """``hit`` with its valid runs of groups changed, the leftmost and longest
    first: struct of the new ``value`` and ``n``, how many there were.

    Groups are what single blanks or dashes separate; a run has ten at most.
    """
    def scan(groups: Column) -> Column:
        size = F.size(groups)
        at = lambda i: F.length(F.array_join(F.slice(groups, F.lit(1), i), " ")) + F.when(i > 0, 2).otherwise(1)
        run = lambda i, j: F.substring(hit, at(i), at(j) + F.length(F.get(groups, j)) - at(i))
        before = lambda i: F.when(i > 0, F.substring(hit, at(i) - 1, F.lit(1))).otherwise("")

        def step(s: Column, i: Column) -> Column:
            ends = F.sequence(F.least(i + 9, size - 1), i, F.lit(-1))
            best = F.get(F.filter(ends, lambda j: valid(run(i, j))), F.lit(0))
            taken = lambda j: F.when(j.isNull(), F.struct(F.concat(s["value"], before(i), F.get(groups, i)).alias("value"), s["n"].alias("n"), (i + 1).alias("free"))).otherwise(F.struct(F.concat(s["value"], before(i), changed(run(i, j))).alias("value"), (s["n"] + 1).alias("n"), (j + 1).alias("free")))
            return F.when(i < s["free"], s).otherwise(_then(best, taken))

        return F.aggregate(F.sequence(F.lit(0), size - 1), F.struct(F.lit("").alias("value"), F.lit(0).alias("n"), F.lit(0).alias("free")), step)

    return _then(F.split(hit, "[ -]"), scan)


def _luhn(hit: Column) -> Column:
    return _then(only(hit, "0-9"), lambda d: F.when(F.length(d).between(13, 19), F.pmod(luhn_sum(d), F.lit(10)) == 0).otherwise(False))


def card(hit: Column, key: str) -> Column:
    """Luhn numbers of the same length for the run, or for the cards in it.

    A run that is a Luhn number is one; else those of its parts that are
    printed like cards are changed.  Struct of ``value`` and ``n``.
    """
    def changed(one: Column) -> Column:
        def by_digits(digits: Column) -> Column:
            body = permuted_digits(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
            checked = _then(body, lambda b: F.concat(b, F.pmod(10 - F.pmod(luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")))
            return filled(one, checked, r"\d")

        return _then(only(one, "0-9"), by_digits)

    printed = lambda x: F.when(x.rlike(PRINTED), _luhn(x)).otherwise(False)
    return F.when(_luhn(hit), F.struct(changed(hit).alias("value"), F.lit(1).alias("n"))).otherwise(_then(parts(hit, printed, changed), lambda s: F.struct(s["value"].alias("value"), s["n"].alias("n"))))


def iban(hit: Column, key: str) -> Column:
    """Country and letters stay; account digits and check digits change.

    If the whole fails its check, so do the parts of it that pass.  Struct of
    ``value`` and ``n``.
    """
    def valid(one: Column) -> Column:
        ok = lambda x: (mod97(F.concat(F.substring(x, F.lit(5), F.length(x)), F.substring(x, 1, 4))) == 1) & (F.length(only(F.substring(x, F.lit(5), F.length(x)), "0-9")) >= 2)
        return F.when(one.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9 ]{8,}$"), _then(only(one, "A-Z0-9"), ok)).otherwise(False)

    def changed(one: Column) -> Column:
        def by_plain(plain: Column) -> Column:
            country, account = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
            other = filled(account, permuted_digits(only(account, "0-9"), key, "iban"), r"\d")
            new = _then(other, lambda x: F.concat(country, F.lpad((98 - mod97(F.concat(x, country, F.lit("00")))).cast("string"), 2, "0"), x))
            return filled(one, new, "[A-Z0-9]")

        return _then(only(one, "A-Z0-9"), by_plain)

    return F.when(valid(hit), F.struct(changed(hit).alias("value"), F.lit(1).alias("n"))).otherwise(_then(parts(hit, valid, changed), lambda s: F.struct(s["value"].alias("value"), s["n"].alias("n"))))


def ip(hit: Column, key: str) -> Column:
    """Private addresses within their network, public ones among themselves."""
    def changed(p: Column) -> Column:
        n = lambda i: F.get(p, F.lit(i)).cast("long")
        high, low = n(0) * 256 + n(1), n(2) * 256 + n(3)
        octets = lambda x: F.concat_ws(".", F.floor(x / 256).cast("string"), F.pmod(x, F.lit(256)).cast("string"))
        both = lambda a, b: F.concat_ws(".", octets(a), octets(b))
        first = lambda a: F.floor(a / 256)
        of_12 = lambda a: a.between(172 * 256 + 16, 172 * 256 + 31)
        special = lambda a: first(a).isin(0, 10, 127) | (first(a) >= 224) | of_12(a) | a.isin(192 * 256 + 168, 169 * 256 + 254)

        def walk(s: Column, _: Column) -> Column:
            step = lambda m: F.struct(m["a"].alias("a"), m["b"].alias("b"), (~special(m["a"])).alias("done"))
            return F.when(s["done"], s).otherwise(_then(feistel(s["a"], s["b"], F.lit(65536), F.lit(65536), key, "ip"), step))

        start = F.struct(high.alias("a"), low.alias("b"), F.lit(False).alias("done"))
        public = _then(F.aggregate(F.sequence(F.lit(1), F.lit(64)), start, walk), lambda s: both(s["a"], s["b"]))
        of_8 = _then(feistel(F.pmod(high, F.lit(256)), low, F.lit(256), F.lit(65536), key, "ip 10"), lambda s: both(s["a"] + 10 * 256, s["b"]))
        within_12 = _then(feistel(high - (172 * 256 + 16), low, F.lit(16), F.lit(65536), key, "ip 172"), lambda s: both(s["a"] + 172 * 256 + 16, s["b"]))
        of_16 = _then(feistel(n(2), n(3), F.lit(256), F.lit(256), key, "ip 192"), lambda s: both(F.lit(192 * 256 + 168), s["a"] * 256 + s["b"]))
        return F.when(n(0) == 10, of_8).when(of_12(high), within_12).when(high == 192 * 256 + 168, of_16).when(special(high), hit).otherwise(public)

    return _then(F.split(hit, r"\."), changed)


def ssn(hit: Column, key: str) -> Column:
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""
    def changed(p: Column) -> Column:
        area, group, serial = (F.get(p, F.lit(i)).cast("long") for i in range(3))
        ok = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        a = F.when(area > 666, area - 2).otherwise(area - 1)
        mixed = feistel(a, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, "ssn")
        shown = lambda x, n: F.lpad(x.cast("string"), n, "0")
        new = _then(mixed, lambda s: F.concat_ws("-", shown(F.when(s["a"] >= 665, s["a"] + 2).otherwise(s["a"] + 1), 3), shown(F.floor(s["b"] / 9999) + 1, 2), shown(F.pmod(s["b"], F.lit(9999)) + 1, 4)))
        return F.when(ok, new).otherwise(hit)

    return _then(F.split(hit, "-"), changed)


def date(hit: Column, key: str) -> Column:
    """Another day of 1900 to 2099 (73049 = 17 * 4297 days), written alike.

    Day/month order is read as month/day with slashes if that is a day, else
    as day/month; with dots as day.month.  Numbers that are no day of those
    years are left alone.
    """
    part = F.split(hit, r"[-/.]")
    at = lambda i: F.get(part, F.lit(i))
    two = lambda x: F.lpad(x, 2, "0")
    iso = F.when(hit.contains("-"), hit)
    monthly = F.when(hit.contains("/"), F.concat_ws("-", at(2), two(at(0)), two(at(1))))
    daily = F.when(~hit.contains("-"), F.concat_ws("-", at(2), two(at(1)), two(at(0))))
    to_day = lambda x: F.try_to_timestamp(x, F.lit("yyyy-MM-dd")).cast("date")

    def changed(s: Column) -> Column:
        first = F.coalesce(s["iso"], s["monthly"])
        day = F.coalesce(first, s["daily"])
        index = F.datediff(day, F.lit("1900-01-01").cast("date")).cast("long")
        mixed = feistel(F.floor(index / 4297), F.pmod(index, F.lit(4297)), F.lit(17), F.lit(4297), key, "date")
        new = F.date_add(F.lit("1900-01-01").cast("date"), _then(mixed, lambda m: (m["a"] * 4297 + m["b"]).cast("int")))
        short = (F.length(at(0)) < 2) | (F.length(at(1)) < 2)
        as_ = lambda d, long, bare: F.when(short, F.date_format(d, bare)).otherwise(F.date_format(d, long))
        written = _then(new, lambda d: F.when(hit.contains("-"), F.date_format(d, "yyyy-MM-dd")).when(hit.contains("."), as_(d, "dd.MM.yyyy", "d.M.yyyy")).when(s["monthly"].isNotNull(), as_(d, "MM/dd/yyyy", "M/d/yyyy")).otherwise(as_(d, "dd/MM/yyyy", "d/M/yyyy")))
        return F.when(day.between(F.lit("1900-01-01").cast("date"), F.lit("2099-12-31").cast("date")), written).otherwise(hit)

    return _then(F.struct(to_day(iso).alias("iso"), to_day(monthly).alias("monthly"), to_day(daily).alias("daily")), changed)


def phone(hit: Column, key: str) -> Column:
    """Country code stays; the digits after it are permuted together."""
    code = F.regexp_extract(hit, rf"^\+({_CALLING}|\d{{3}})", 1)

    def changed(c: Column) -> Column:
        body = F.when(hit.startswith("+"), F.substring(hit, F.length(c) + 2, F.length(hit))).otherwise(hit)

        def by_digits(d: Column) -> Column:
            three = lambda i: F.substring(d, i, 3).cast("long") - 200
            american = d.rlike(r"^[2-9]\d{2}[2-9]\d{6}$")
            mixed = feistel(three(1) * 800 + three(4), F.substring(d, 7, 4).cast("long"), F.lit(640000), F.lit(10000), key, "phone")
            shown = _then(mixed, lambda s: F.concat((F.floor(s["a"] / 800) + 200).cast("string"), (F.pmod(s["a"], F.lit(800)) + 200).cast("string"), F.lpad(s["b"].cast("string"), 4, "0")))
            other = (c != "") & (c != "1") & (F.length(d) + F.length(c)).between(7, 15) & (F.length(d) >= 4)
            new = F.when(c.isin("", "1"), F.when(american, shown)).when(other, permuted_digits(d, key, "phone"))
            return F.when(new.isNull(), hit).otherwise(F.concat(F.substring(hit, F.lit(1), F.length(hit) - F.length(body)), filled(body, new, r"\d")))

        return _then(only(body, "0-9"), by_digits)

    return _then(code, changed)


def _in_script(c: Column, add: Column) -> Column:
    """The letter ``add`` places on, in turn, among those of its script."""
    def moved(n: Column) -> Column:
        out = n
        for low, high in SCRIPTS:
            out = F.when(n.between(low, high), low + F.pmod(n - low + add, F.lit(high - low + 1))).otherwise(out)
        return F.decode(F.unhex(F.lpad(F.hex(out), 4, "0")), "UTF-16BE")

    coded = F.hex(F.encode(c, "UTF-16BE"))
    return F.when(F.length(coded) == 4, _then(F.conv(coded, 16, 10).cast("long"), moved)).otherwise(c)


def permuted_text(text: Column, key: str, domain: str, hexadecimal: bool = False) -> Column:
    """Characters moved within their classes; others stay where they are."""

    def shifted(half: Column, other: Column, i: Column) -> Column:
        stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit(domain), i.cast("string"), other), 512)

        def moved(c: Column, k: Column, pad: Column) -> Column:
            add = F.conv(F.substring(pad, 2 * F.pmod(k, F.lit(63)) + 1, F.lit(4)), 16, 10).cast("int") + k
            within = lambda alphabet: F.substring(F.lit(alphabet), F.pmod(F.instr(F.lit(alphabet), c) - 1 + add, F.lit(len(alphabet))) + 1, F.lit(1))
            if hexadecimal:
                return F.when(c.rlike("[0-9a-f]"), within(_HEX)).otherwise(c)
            return F.when(c.rlike("[0-9]"), within(_DIGITS)).when(c.rlike("[a-z]"), within(_SMALL)).when(c.rlike("[A-Z]"), within(_SMALL.upper())).when(c > "\x7f", _in_script(c, add)).otherwise(c)

        return _then(stream, lambda pad: F.array_join(F.transform(F.split(half, ""), lambda c, k: moved(c, k, pad)), ""))

    cut = F.ceil(F.length(text) / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), cut).alias("a"), F.substring(text, cut + 1, F.length(text)).alias("b"))
    turn = lambda s, i: F.when(i % 2 == 0, F.struct(shifted(s["a"], s["b"], i).alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), shifted(s["b"], s["a"], i).alias("b")))
    return _then(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn), lambda s: F.concat(s["a"], s["b"]))


def email(hit: Column, key: str) -> Column:
    """Name and domain labels change; the top-level domain stays."""
    top = F.regexp_extract(hit, r"\.[^.]*$", 0)
    return F.concat(permuted_text(F.substring(hit, F.lit(1), F.length(hit) - F.length(top)), key, "email"), top)


def secret(hit: Column, key: str) -> Column:
    value = F.regexp_extract(hit, r"[A-Za-z0-9_/+=-]{12,}$", 0)

    def changed(v: Column) -> Column:
        head = F.substring(hit, F.lit(1), F.length(hit) - F.length(v))
        return F.concat(head, F.when(v.rlike("^[0-9a-f]+$"), permuted_text(v, key, "hex", True)).otherwise(permuted_text(v, key, "secret")))

    return _then(value, changed)


_PSEUDONYMS = {"secret": secret, "email": email, "iban": iban, "ip": ip, "date": date, "ssn": ssn, "phone": phone, "card": card}


def _kind(hit: Column) -> Column:
    """The first kind whose pattern takes all of the value."""
    found = F.lit(None).cast("string")
    for name, pattern in reversed(KINDS.items()):
        # what preceded the value is no part of it any more
        found = F.when(hit.rlike(f"^(?:{pattern})$"), name).otherwise(found)
    return found


def _replacement(hit: Column, key: str) -> Column:
    def by_kind(kind: Column) -> Column:
        one = lambda value: _then(value, lambda v: F.struct(v.alias("value"), F.when(v != hit, 1).otherwise(0).alias("n")))
        out = F.struct(hit.alias("value"), F.lit(0).alias("n"))  # what no kind takes whole stays
        for name, pseudonym in _PSEUDONYMS.items():
            new = pseudonym(hit, key)
            out = F.when(kind == name, new if name in ("iban", "card") else one(new)).otherwise(out)
        return _then(out, lambda x: F.struct(kind.alias("kind"), x["value"].alias("value"), x["n"].alias("n")))

    return _then(_kind(hit), by_kind)


def _found(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, str]:
    """``docs`` with the replaced values of each text in order, and that column."""
    raw, hits = unused(docs, "__raw"), unused(docs, "__hits")
    found = docs.withColumn(raw, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    return found.withColumn(hits, F.transform(raw, lambda h: _replacement(h, key))).drop(raw), hits


def _rewritten(text: str, hits: str) -> Column:
    between = F.split(text, PATTERN, -1)
    joined = _then(between, lambda p: F.concat(F.get(p, F.lit(0)), F.array_join(F.transform(hits, lambda h, i: F.concat(h["value"], F.get(p, i + 1))), "")))
    return F.when(F.size(hits) > 0, joined).otherwise(F.col(text))


def session_key(spark: SparkSession) -> str:
    """The key in spark.marlstone.pseudonyms.key; a random one, which the
    session then keeps, if none is set."""
    name = "spark.marlstone.pseudonyms.key"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, secrets.token_hex(16))
    return spark.conf.get(name)


def replaced(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with its text replaced and its columns as they were."""
    found, hits = _found(docs, key, text)
    return found.withColumn(text, _rewritten(text, hits)).select(*docs.columns)


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text, and per kind how many values were changed."""
    found, hits = _found(docs.select("doc_id", "text"), key, "text")
    count = lambda kind: F.aggregate(hits, F.lit(0), lambda n, h: n + F.when(h["kind"] == kind, h["n"]).otherwise(0))
    counts = [F.coalesce(count(k), F.lit(0)).cast("long").alias(f"n_{k}") for k in _PSEUDONYMS]
    return found.select("doc_id", _rewritten("text", hits).alias("text"), *counts)
