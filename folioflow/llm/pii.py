"""PII: format-preserving Feistel pseudonyms, in DataFrame operations alone.

Numbers and dates that pass their format's test are permuted within that format under a key:
a card number becomes another of the same length that passes the Luhn test, a date another date,
a phone number another of the same layout, an IPv4 address another address. The permutation is a
Feistel network over mixed radices: a value's rank in its format is split into two numbers below
a and b, and each round adds a keyed hash of one to the other, modulo its radix. A permutation
has no collisions, so equal values stay linked across documents and different ones stay apart.
Strings without a rank, the characters of e-mail addresses and of quoted secrets, go through the
same network character by character, each within its own class (letters, hexadecimal letters,
digits) and case.

The round function is HMAC-SHA256, composed of sha2 from the key's two pads.

Edge cases: a null text stays null; an empty one stays empty; numbers that fail their test stay
as they are; a card is found beside other numbers of the same run; equal values in one text get equal pseudonyms; upper-case e-mail addresses and
secrets get the pseudonym of their lower-case form, in upper case; all columns but the text
are handed on unchanged, in their order, whatever their names; repeated rows get the same pseudonyms; very long texts,
addresses and secrets are worked on whole, in time that grows with their length; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: The setting that has the key, and the key of sessions without it: as it is published here, it hides nothing from anyone who reads this.
KEY_SETTING = "spark.folioflow.pii.key"
DEFAULT_KEY = b"folioflow demonstration key"

#: Runs of one class alone: no group repeats, so that a long address takes no stack.
_EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-][A-Za-z0-9.\-]*\.[A-Za-z]{2,}(?![A-Za-z0-9])"
_IP = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d]|\.\d)"
_DATE = r"(?<![\d\-])\d{4}-\d{2}-\d{2}(?![\d\-])"
#: Month, day and year; a first number above 12 is no month, and such a date stays.
_SLASHED = r"(?<![\d/.\-])(?:0[1-9]|1[0-2])/(?:0[1-9]|[12]\d|3[01])/\d{4}(?![\d/])"
_SSN = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
#: Ten digits after an optional 1; without the 1 a dot, a hyphen or parentheses have to mark the area code.
_NANP = (
    r"(?:\+1[ .\-]?(?:\(\d{3}\)|\d{3})[ .\-]?\d{3}[ .\-]?\d{4}"
    r"|(?<![\d.+\-])(?:1[ .\-]?)?(?:\(\d{3}\)[ .\-]?\d{3}[ .\-]?|\d{3}[.\-]\d{3}[.\-])\d{4})(?!\d|[.\-]\d)"
)
#: What a longer number beside it must not swallow.
_OTHER = rf"{_NANP}|{_IP}|{_DATE}|{_SLASHED}|{_SSN}|{_EMAIL}"
_CARD_LIKE = r"\d{4}(?:[ \-]\d{4}){3}|\d{4}[ \-]\d{6}[ \-]\d{4}|\d{13}"
_ABROAD = rf"\+[2-9](?:(?![ .\-/](?:{_CARD_LIKE}|{_OTHER}))[ .\-/]?\(?\d\)?){{6,14}}(?!\d)"
#: The longest run of digit groups; the cards in it are found by their check digits. Possessive: a long run takes no stack.
_RUN = rf"(?<!\d)(?!{_OTHER})\d(?:[ \-]?(?!{_OTHER})\d){{12,}}+"
_BARE = rf"(?!{_OTHER}|{_ABROAD}|{_RUN})"
_VALUE = r"[A-Za-z0-9+/_=\-]{8,}+"
#: Without quotes after a colon, where prose may follow, a secret has to have a digit.
_MARK = r"(?i:token|secret|password|passwd|api_?key|key)[\"']?\s*+"
_SECRET = rf"{_MARK}(?:[=:]\s*+(?:\"{_VALUE}\"|'{_VALUE}')|=\s*+{_BARE}{_VALUE}|:\s*+{_BARE}(?=[A-Za-z+/_=\-]*+\d){_VALUE})"
#: Secrets that their own beginning tells; what isn't of a fixed length has to have a digit.
_PREFIXED = (
    r"(?<![A-Za-z0-9_\-])(?:AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|gh[opsur]_[A-Za-z0-9]{36}(?![0-9A-Za-z])"
    r"|(?:sk-|Bearer\s)(?=[A-Za-z._~+/=\-]*+\d)[A-Za-z0-9._~+/=\-]{20,}+)"
)

#: What may be private, in the order of their alternatives. Lookarounds keep a match from being part of a longer one.
PATTERNS = {"email": _EMAIL, "secret": _SECRET, "prefixed": _PREFIXED, "phone": rf"{_NANP}|{_ABROAD}", "ip": _IP, "date": _DATE, "slashed": _SLASHED, "ssn": _SSN, "card": _RUN}
ANY = "|".join(PATTERNS.values())
#: Groups that cards are printed in, and the first digits of the usual issuers.
CARD_GROUPS = r"^(\d+|\d{4}([ -]\d{4}){2,3}[ -]\d{1,4}|\d{4}[ -]\d{6}[ -]\d{4,5})$"
ISSUERS = r"^([3456]|2(22[1-9]|2[3-9]|[3-6]|7[01]|720))"
#: Any 400 years of the calendar have 189 * 773 days.
DATE_RADIX, FIRST_DATE = (189, 773), "1800-01-01"
SSN_RADIX = (898 * 99, 9999)


class Hmac:
    """HMAC-SHA256 as a column: hexadecimal of the hash of a string column."""

    def __init__(self, key: bytes) -> None:
        key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
        self.inner, self.outer = (F.lit(bytearray(b ^ pad for b in key)) for pad in (0x36, 0x5C))

    def __call__(self, message: Column) -> Column:
        inside = F.unhex(F.sha2(F.concat(self.inner, F.encode(message, "UTF-8")), 256))
        return F.sha2(F.concat(self.outer, inside), 256)


def _number(hexadecimal: Column) -> Column:
    return F.conv(hexadecimal, 16, 10).cast("long")


def permute(rank: Column, a: int, b: int, hmac: Hmac, kind: str) -> Column:
    """A keyed permutation of the numbers below a * b."""
    if a * b > 2**53:
        raise ValueError("ranks above 2^53 aren't exact here")
    start = F.struct(F.floor(rank / b).cast("long").alias("x"), F.pmod(rank, F.lit(b)).cast("long").alias("y"))

    def turn(state: Column, k: Column) -> Column:
        add = lambda side: _number(F.substring(hmac(F.concat_ws("|", F.lit(kind), k, side)), 1, 15))
        even = k % 2 == 0
        return F.struct(
            F.when(even, F.pmod(state["x"] + F.pmod(add(state["y"]), F.lit(a)), F.lit(a))).otherwise(state["x"]).alias("x"),
            F.when(even, state["y"]).otherwise(F.pmod(state["y"] + F.pmod(add(state["x"]), F.lit(b)), F.lit(b))).alias("y"),
        )

    return F.aggregate(F.array(*map(F.lit, range(ROUNDS))), start, turn, lambda s: s["x"] * b + s["y"])


def permute_digits(digits: Column, hmac: Hmac, kind: str) -> Column:
    """A keyed permutation of strings of n digits, 2 <= n <= 30: the halves are the two numbers."""
    n = F.length(digits)
    left = F.floor(n / 2).cast("int")
    power = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
    start = F.struct(
        F.substring(digits, F.lit(1), left).cast("long").alias("x"), F.substring(digits, left + 1, n).cast("long").alias("y")
    )

    def turn(state: Column, k: Column) -> Column:
        add = lambda side: _number(F.substring(hmac(F.concat_ws("|", F.lit(kind), n, k, side)), 1, 15))
        even = k % 2 == 0
        return F.struct(
            F.when(even, F.pmod(state["x"] + F.pmod(add(state["y"]), power(left)), power(left))).otherwise(state["x"]).alias("x"),
            F.when(even, state["y"]).otherwise(F.pmod(state["y"] + F.pmod(add(state["x"]), power(n - left)), power(n - left))).alias("y"),
        )

    return F.aggregate(
        F.array(*map(F.lit, range(ROUNDS))),
        start,
        turn,
        lambda s: F.concat(F.lpad(s["x"].cast("string"), left, "0"), F.lpad(s["y"].cast("string"), n - left, "0")),
    )


def permute_characters(value: Column, hmac: Hmac, kind: str, letters: int = 26) -> Column:
    """A keyed permutation of lower-case strings that keeps every character's class; letters: how many the alphabet has."""
    n = F.length(value)
    left = F.floor(n / 2).cast("int")

    def shifted(side: Column, other: Column, k: Column) -> Column:
        """Each character of side moved within its class by a byte of the hash of other; 32 characters to a hash."""

        def block(text: Column, b: Column) -> Column:
            """32 characters by one hash, which is made once for all of them."""
            chars = F.filter(F.split(text, ""), lambda c: c != "")
            by = lambda stream, i: _number(F.substring(stream, i * 2 + 1, F.lit(2)))
            moved = lambda stream: F.transform(
                chars,
                lambda c, i: F.when(c.rlike("^[0-9]$"), F.char(F.pmod(F.ascii(c) - 48 + by(stream, i), F.lit(10)) + 48))
                .when(c.rlike("^[a-z]$"), F.char(F.pmod(F.ascii(c) - 97 + by(stream, i), F.lit(letters)) + 97))
                .otherwise(c),
            )
            return F.array_join(F.flatten(F.transform(F.array(hmac(F.concat_ws("|", F.lit(kind), n, k, b, other))), moved)), "")

        return F.array_join(F.transform(F.regexp_extract_all(side, F.lit("(?s).{1,32}"), 0), block), "")

    def turn(state: Column, k: Column) -> Column:
        even = k % 2 == 0
        return F.struct(
            F.when(even, shifted(state["x"], state["y"], k)).otherwise(state["x"]).alias("x"),
            F.when(even, state["y"]).otherwise(shifted(state["y"], state["x"], k)).alias("y"),
        )

    start = F.struct(F.substring(value, F.lit(1), left).alias("x"), F.substring(value, left + 1, n).alias("y"))
    return F.aggregate(F.array(*map(F.lit, range(ROUNDS))), start, turn, lambda s: F.concat(s["x"], s["y"]))


# -- formats -----------------------------------------------------------------------------


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of digits, the last of which isn't doubled."""
    values = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c: c.cast("int"))
    doubled = F.transform(values, lambda v, i: F.when(i % 2 == 0, v).otherwise(F.when(v >= 5, v * 2 - 9).otherwise(v * 2)))
    return F.aggregate(doubled, F.lit(0), lambda a, v: a + v)


def _layout(original: Column, digits: Column) -> Column:
    """digits put into the places that original has digits in."""
    return F.aggregate(
        F.filter(F.split(original, ""), lambda c: c != ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda s, c: F.struct(
            F.concat(s["out"], F.when(c.rlike("^[0-9]$"), F.substring(digits, s["at"], F.lit(1))).otherwise(c)).alias("out"),
            (s["at"] + F.when(c.rlike("^[0-9]$"), 1).otherwise(0)).alias("at"),
        ),
        lambda s: s["out"],
    )


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _one_card(value: Column, hmac: Hmac) -> Column:
    payload = permute_digits(F.substring(_digits(value), F.lit(1), F.length(_digits(value)) - 1), hmac, "card")
    # The check digit completes the permuted payload.
    checked = F.aggregate(F.array(payload), F.lit(""), lambda _, p: F.concat(p, F.pmod(10 - luhn_sum(F.concat(p, F.lit("0"))) % 10, F.lit(10)).cast("string")))
    return _layout(value, checked)


def _card(run: Column, hmac: Hmac) -> Column:
    """run with every card in it replaced: a run may hold other numbers beside a card, or several cards.

    Cards begin and end at groups. Of spans that overlap, one in the groups and with the first digits of cards wins, then the
    leftmost, then the longest. Part of a run counts only if its groups but the last have three digits at least:
    otherwise nearly every list of small numbers would hold a valid span.
    """
    groups = F.split(run, "(?<=[ -])")
    bound = F.array(F.struct(groups.alias("groups"), F.transform(groups, lambda g: F.length(_digits(g))).alias("sizes")))

    def spans(b: Column) -> Column:
        last = F.size(b["sizes"]) - 1
        total = lambda i, j: F.aggregate(F.slice(b["sizes"], i + 1, j - i + 1), F.lit(0), lambda a, n: a + n)
        long_groups = lambda i, j: F.forall(F.slice(b["sizes"], i + 1, j - i), lambda n: n >= 3)
        text = lambda i, j: F.array_join(F.slice(b["groups"], i + 1, j - i + 1), "")
        some = F.transform(
            F.filter(F.sequence(F.lit(0), last), lambda i: (i == 0) | (F.get(b["sizes"], i) >= 3)),
            lambda i: F.transform(
                F.filter(F.sequence(i, F.least(i + 18, last)), lambda j: (long_groups(i, j) | ((i == 0) & (j == last))) & total(i, j).between(13, 19)),
                lambda j: F.struct(i.alias("first"), F.regexp_replace(text(i, j), "[ -]$", "").alias("card")),
            ),
        )
        valid = F.filter(F.flatten(some), lambda c: luhn_sum(_digits(c["card"])) % 10 == 0)
        at = lambda i: F.length(F.array_join(F.slice(b["groups"], F.lit(1), i), "")) + 1
        return F.transform(valid, lambda c: F.struct(at(c["first"]).alias("at"), c["card"].alias("card")))

    ranked = F.array_sort(
        F.transform(
            F.flatten(F.transform(bound, spans)),
            lambda c: F.struct(
                (F.when(c["card"].rlike(CARD_GROUPS), 0).otherwise(2) + F.when(c["card"].rlike(ISSUERS), 0).otherwise(1)).alias("rank"),
                c["at"].alias("at"),
                (-F.length(c["card"])).alias("shorter"),
                c["card"].alias("card"),
            ),
        )
    )
    none = F.array().cast("array<struct<rank:int,at:int,shorter:int,card:string>>")
    chosen = F.aggregate(
        ranked,
        none,
        lambda a, c: F.when(F.exists(a, lambda o: (o["at"] < c["at"] - c["shorter"]) & (c["at"] < o["at"] - o["shorter"])), a).otherwise(F.concat(a, F.array(c))),
    )
    return F.aggregate(
        chosen,
        run,
        lambda s, c: F.concat(F.substring(s, F.lit(1), c["at"] - 1), _one_card(c["card"], hmac), F.substring(s, c["at"] - c["shorter"], F.length(s))),
    )


def _phone(value: Column, hmac: Hmac) -> Column:
    """The ten digits of the plan of +1, in any layout; a leading 1 stays."""
    digits = _digits(value)
    return _layout(value, F.concat(F.substring(digits, F.lit(1), F.length(digits) - 10), permute_digits(F.substring(digits, F.length(digits) - 9, F.lit(10)), hmac, "phone")))


def _phone_abroad(value: Column, hmac: Hmac) -> Column:
    """All digits but the first two, which have the country or the start of it."""
    digits = _digits(value)
    return _layout(value, F.concat(F.substring(digits, 1, 2), permute_digits(F.substring(digits, F.lit(3), F.length(digits)), hmac, "phone abroad")))


def _ip(value: Column, hmac: Hmac) -> Column:
    parts = F.transform(F.split(value, r"\."), lambda p: p.cast("long"))
    valid = F.forall(parts, lambda p: p <= 255) & ~value.rlike(r"(^|\.)0\d")
    rank = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p)
    back = lambda r: F.concat_ws(".", F.shiftright(r, 24), F.shiftright(r, 16).bitwiseAND(255), F.shiftright(r, 8).bitwiseAND(255), r.bitwiseAND(255))
    return F.when(valid, F.aggregate(F.array(permute(rank, 1 << 16, 1 << 16, hmac, "ip")), F.lit(""), lambda _, r: back(r))).otherwise(value)


def _date(value: Column, hmac: Hmac) -> Column:
    rank = F.datediff(F.try_to_date(value), F.lit(FIRST_DATE).cast("date")).cast("long")
    moved = F.date_add(F.lit(FIRST_DATE).cast("date"), permute(rank, *DATE_RADIX, hmac, "date").cast("int")).cast("string")
    return F.when((rank >= 0) & (rank < DATE_RADIX[0] * DATE_RADIX[1]), moved).otherwise(value)


def _slashed(value: Column, hmac: Hmac) -> Column:
    """A date with slashes goes where the same date with hyphens does."""
    whole = F.concat_ws("-", F.substring(value, 7, 4), F.substring(value, 1, 2), F.substring(value, 4, 2))
    moved = _date(whole, hmac)
    return F.when(moved != whole, F.concat_ws("/", F.substring(moved, 6, 2), F.substring(moved, 9, 2), F.substring(moved, 1, 4))).otherwise(value)


def _prefixed(value: Column, hmac: Hmac) -> Column:
    head = F.regexp_extract(value, r"^(?:AKIA|gh[opsur]_|sk-|Bearer\s)", 0)
    body = F.substring(value, F.length(head) + 1, F.length(value) - F.length(head))
    return F.concat(head, _cased(body, permute_characters(F.lower(body), hmac, "secret")))


def _ssn(value: Column, hmac: Hmac) -> Column:
    area, group, serial = (F.substring(value, *p).cast("long") for p in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    rank = ((area - 1 - F.when(area > 666, 1).otherwise(0)) * 99 + group - 1) * 9999 + serial - 1

    def back(r: Column) -> Column:
        low = F.floor(r / (99 * 9999)) + 1
        parts = (low + F.when(low >= 666, 1).otherwise(0), F.pmod(F.floor(r / 9999), F.lit(99)) + 1, F.pmod(r, F.lit(9999)) + 1)
        return F.concat_ws("-", *(F.lpad(p.cast("long").cast("string"), n, "0") for p, n in zip(parts, (3, 2, 4), strict=True)))

    return F.when(valid, F.aggregate(F.array(permute(rank, *SSN_RADIX, hmac, "ssn")), F.lit(""), lambda _, r: back(r))).otherwise(value)


def _cased(original: Column, lower: Column) -> Column:
    """lower with upper-case letters where original has them."""
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    return F.array_join(F.zip_with(chars(lower), chars(original), lambda c, o: F.when(o.rlike("^[A-Z]$"), F.upper(c)).otherwise(c)), "")


def _email(value: Column, hmac: Hmac) -> Column:
    name = F.regexp_extract(value, r"^(.*)\.[^.]*$", 1)
    return F.concat(_cased(name, permute_characters(F.lower(name), hmac, "email")), F.regexp_extract(value, r"\.[^.]*$", 0))


def _secret(value: Column, hmac: Hmac) -> Column:
    head, quote = F.regexp_extract(value, r"^[^=:]*[=:]\s*[\"']?", 0), F.regexp_extract(value, r"[\"']?$", 0)
    body = F.substring(value, F.length(head) + 1, F.length(value) - F.length(head) - F.length(quote))
    moved = F.when(body.rlike("^[0-9A-Fa-f]+$"), permute_characters(F.lower(body), hmac, "hex", 6)).otherwise(permute_characters(F.lower(body), hmac, "secret"))
    return F.concat(head, _cased(body, moved), quote)


#: How a match is told from the others, and its pseudonym.
KINDS = (
    (rf"^{_MARK}[=:]", _secret),
    (r"^(?:AKIA|gh[opsur]_|sk-|Bearer\s)", _prefixed),
    (r"@", _email),
    (r"^\+[2-9]", _phone_abroad),
    (rf"^{_NANP}$", _phone),
    (r"^\d+\.\d+\.\d+\.\d+$", _ip),
    (r"^\d{4}-\d{2}-\d{2}$", _date),
    (r"^\d{2}/\d{2}/\d{4}$", _slashed),
    (r"^\d{3}-\d{2}-\d{4}$", _ssn),
)


def pseudonym(value: Column, key: bytes = DEFAULT_KEY) -> Column:
    """The pseudonym of one match of ANY."""
    hmac = Hmac(key)
    choice = F.when(value.isNull(), value)
    for pattern, make in KINDS:
        choice = choice.when(value.rlike(pattern), make(value, hmac))
    return choice.otherwise(_card(value, hmac))


def session_key(df: DataFrame) -> bytes:
    """The key of KEY_SETTING, or the public one where the session has none."""
    named = df.sparkSession.conf.get(KEY_SETTING, None)
    return named.encode() if named else DEFAULT_KEY


def pseudonymise(df: DataFrame, text_col: str = "text", key: bytes | None = None) -> DataFrame:
    """df with the private values in text_col replaced; its columns, whatever their names, and their order stay. key: by default the session's."""
    key = session_key(df) if key is None else key
    held = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(f"`{text_col}`").alias("text"))
    # Cheap tests first: every format has an at sign, a digit, or a secret's mark.
    found = held.withColumn("found", F.when(F.col("text").rlike(r"[0-9@\"=]|:\s*+'|gh[opsur]_|AKIA"), F.regexp_extract_all("text", F.lit(ANY), 0)))
    some = F.size("found") > 0
    staged = found.withColumn("between", F.when(some, F.split("text", ANY, -1))).withColumn("new", F.when(some, F.transform("found", lambda v: pseudonym(v, key))))
    joined = F.concat(
        F.array_join(F.transform("found", lambda v, i: F.concat(F.get("between", i), F.get("new", i))), ""),
        F.get("between", F.size("found")),
    )
    columns = [F.when(some, joined).otherwise(F.col("text")).alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in df.columns]
    return staged.select(*columns)
