"""Format-preserving pseudonyms for personal data, in native column expressions.

Identifiers are found by pattern and validated (Luhn sum and issuer for cards, ranges for addresses and
dates), then permuted within their format by a keyed Feistel network: letters stay letters, digits stay
digits, a card keeps a valid check digit, an address stays an address, a date stays a date. The
permutation depends on the key and the kind alone, so equal values stay linked across documents, and
different values stay different.

Null texts stay null; texts without identifiers come back as they are. Rows are treated one by one:
repeated rows and ties do not matter. Columns named like a count (``n_<kind>``) are replaced by it where counts are asked
for; all others come back as they are, whatever their names.

The key is a secret: give it, or name it in the session's ``KEY_SETTING``. Without either a demo key is taken,
whose pseudonyms anyone can undo.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import fresh

DEFAULT_KEY = "wardline-demo-key"
KEY_SETTING = "spark.wardline.pii.key"
ROUNDS = 4

#: Patterns by kind, in order of precedence. Each begins where no such run can have begun before, so that
#: a search is linear in runs of any length.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9\-])",
    "secret": r"(?<![A-Za-z0-9])[0-9A-Fa-f]{32,64}(?![A-Za-z0-9])",
    "ip": r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])",
    "date": r"(?<![0-9A-Za-z.\-/])(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}(?:(?=T[0-9]{2}:)|(?![0-9A-Za-z]|[.\-/][0-9]))"
    r"|(?<![0-9A-Za-z.\-/])[0-9]{2}\.[0-9]{2}\.(?:19|20)[0-9]{2}(?![0-9A-Za-z]|[.\-/][0-9])",
    "ssn": r"(?<![0-9A-Za-z\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    # Numbers of the country code 1 end after ten more digits, all others after fifteen in all, whatever follows.
    "phone": r"(?<![0-9A-Za-z])\+1[ .\-]?(?:\([0-9]{3}\)|[0-9]{3})[ .\-]?[0-9]{3}[ .\-]?[0-9]{4}(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z])\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9]{2,4}(?:[ .\-]?~no card~[0-9]{2,4}){1,3}(?<!~sixteen~)(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z+)])\([0-9]{3}\)[ .\-]?[0-9]{3}[ .\-][0-9]{4}(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z.\-])[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4}(?![0-9A-Za-z]|[.\-][0-9])",
    "card": r"(?<![0-9A-Za-z])[2-6](?:[ \-]?[0-9]){12,18}(?![0-9A-Za-z])",
}
# A look behind takes no repeated groups: sixteen digits are spelled out.
PATTERNS["phone"] = PATTERNS["phone"].replace("~sixteen~", r"[0-9][ .()\-]{0,3}" * 15 + "[0-9]")
KINDS = tuple(PATTERNS)
#: Where a phone number's next group would be the beginning of a card, the number ends.
_BEFORE_CARD = "~no card~"
#: What matches nothing; stands for the cards of a text without any.
_NO_CARD = "(?!)"
#: The cards of a text are worked out first, as only their check digit tells where one ends; ``~cards~`` stands for them.
_ANY = "|".join(f"(?:{p})" for p in [*(p for k, p in PATTERNS.items() if k != "card"), "~cards~"])
#: Every place where a card can begin, with the longest text that it can have and what follows that.
_CARD_WINDOW = r"(?<![0-9A-Za-z])(?=([2-6](?:[ \-]?[0-9]){12,18}(?:[0-9A-Za-z]|[ \-][0-9])?))"
#: How a card can be written, in order of preference: in its usual groups, unbroken, in any groups with nothing
#: after them, then in groups of four digits or more, the longest first.
_CARD_FORMS = [
    r"^[0-9]{4}(?:[ \-][0-9]{4}){3}[ \-][0-9]{3}(?![0-9A-Za-z])",
    r"^[0-9]{4}(?:[ \-][0-9]{4}){3}(?![0-9A-Za-z])",
    r"^[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5}(?![0-9A-Za-z])",
    r"^[0-9]{13,19}(?![0-9A-Za-z])",
    r"^[0-9](?:[ \-]?[0-9]){12,18}(?![0-9A-Za-z]|[ \-][0-9])",
    *(rf"^(?=[0-9]{{4,}}(?:[ \-][0-9]{{4,}})*(?![0-9]))(?:[ \-]?[0-9]){{{n}}}(?<![ \-][0-9]{{1,3}})(?![0-9A-Za-z])" for n in range(19, 12, -1)),
]
#: Every valid identifier has one of these; most texts have neither.
_NECESSARY = "[0-9@]"
_ISSUER = r"^(?:4|5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[47]|6(?:011|5|4[4-9]))"
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def _chars(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _alphabet(char: Column) -> Column:
    return F.when(char.rlike("^[0-9]$"), F.lit(_DIGITS)).when(char.rlike("^[a-z]$"), F.lit(_LOWER)).when(char.rlike("^[A-Z]$"), F.lit(_UPPER)).otherwise("")


def _shifted(half: Column, stream: Column, hex_only: bool) -> Column:
    """Each character moved within its alphabet by its own byte of the key stream (hex digits)."""

    def moved(key_stream: Column) -> Column:
        def move(char: Column, i: Column) -> Column:
            letters = _alphabet(char)
            if hex_only:
                letters = F.when(char.rlike("^[a-f]$"), "abcdef").when(char.rlike("^[A-F]$"), "ABCDEF").otherwise(letters)
            byte = F.conv(F.substring(key_stream, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")
            place = F.pmod(F.instr(letters, char) - 1 + byte, F.length(letters))
            return F.when(F.length(letters) == 0, char).otherwise(F.substring(letters, place + 1, F.lit(1)))

        return F.transform(half, move)

    # A stream that stood unbound in the lambda would be worked out for each character.
    return _one_by_one(stream, moved)


def feistel(text: Column, kind: str, key: str, hex_only: bool = False) -> Column:
    """A keyed permutation of the texts with the same classes of characters in the same places.

    The two halves take turns: each moves by a stream that is drawn from the key, the kind, the round
    and the other half.
    """
    chars = _chars(text)
    middle = F.ceil(F.length(text) / 2).cast("int")
    state = F.struct(F.slice(chars, F.lit(1), middle).alias("a"), F.slice(chars, middle + 1, F.length(text)).alias("b"))

    # Rounds are folded so that each half is worked out once, whatever the number of rounds.
    def one(pair: Column, number: Column) -> Column:
        stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), number.cast("string"), F.array_join(pair["b"], "")).cast("binary"), 256)
        moved = _shifted(pair["a"], stream, hex_only)
        return F.struct(pair["b"].alias("a"), moved.alias("b"))

    # An even number of rounds brings the halves back to their sides.
    done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), state, one)
    return F.concat(F.array_join(done["a"], ""), F.array_join(done["b"], ""))


def luhn_digit(digits: Column) -> Column:
    """The check digit that makes a number of these digits pass the Luhn test."""
    n = F.length(digits)
    total = F.aggregate(
        F.transform(_chars(digits), lambda c, i: _luhn_weight(c.try_cast("int"), (n - i) % 2 == 1)),
        F.lit(0),
        lambda a, x: a + x,
    )
    return F.pmod(F.lit(10) - total % 10, F.lit(10)).cast("string")


def _luhn_weight(digit: Column, doubled: Column) -> Column:
    return F.when(~doubled, digit).when(digit > 4, 2 * digit - 9).otherwise(2 * digit)


def _in_format(original: Column, digits: Column) -> Column:
    """``digits`` in the places of the digits of ``original``."""

    def placed(new: Column) -> Column:
        def put(state: Column, char: Column) -> Column:
            is_digit = char.rlike("^[0-9]$")
            return F.struct(
                F.concat(state["out"], F.when(is_digit, F.substring(new, state["n"] + 1, F.lit(1))).otherwise(char)).alias("out"),
                (state["n"] + is_digit.cast("int")).alias("n"),
            )

        return F.aggregate(_chars(original), F.struct(F.lit("").alias("out"), F.lit(0).alias("n")), put)["out"]

    return _one_by_one(digits, placed)


def _card(value: Column, key: str) -> Column:
    def other(digits: Column) -> Column:
        # The first digit tells the issuer and the last one checks the others.
        inner = feistel(F.substring(digits, F.lit(2), F.length(digits) - 2), "card", key)
        body = F.concat(F.substring(digits, 1, 1), inner)
        return _one_by_one(body, lambda b: F.concat(b, luhn_digit(b)))

    return _in_format(value, _one_by_one(F.regexp_replace(value, "[^0-9]", ""), other))


def _number_feistel(left: Column, right: Column, left_size: int, right_size: int, kind: str, key: str) -> tuple[Column, Column]:
    """A permutation of pairs of numbers below the two sizes."""

    def stream(number: int, other: Column) -> Column:
        return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), F.lit(str(number)), other.cast("string")).cast("binary"), 256), 1, 12), 16, 10).cast("long")

    for number in range(0, ROUNDS, 2):
        left = F.pmod(left + stream(number, right), F.lit(left_size))
        right = F.pmod(right + stream(number + 1, left), F.lit(right_size))
    return left, right


def _one_by_one(value: Column, make) -> Column:
    """``make`` applied to a value that is worked out once, although it is used often."""
    return F.element_at(F.transform(F.array(value), make), 1)


def _ip(value: Column, key: str) -> Column:
    parts = F.split(value, r"\.")
    pair = F.struct((parts[0].try_cast("int") * 256 + parts[1].try_cast("int")).alias("a"), (parts[2].try_cast("int") * 256 + parts[3].try_cast("int")).alias("b"))
    for number in map(str, range(ROUNDS)):

        def turn(p: Column) -> Column:
            byte = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("ip"), F.lit(number), p["b"].cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("long")
            return F.struct(p["b"].alias("a"), F.pmod(p["a"] + byte, F.lit(65536)).cast("int").alias("b"))

        pair = _one_by_one(pair, turn)
    return _one_by_one(pair, lambda p: F.concat_ws(".", F.floor(p["a"] / 256), p["a"] % 256, F.floor(p["b"] / 256), p["b"] % 256))


def _date(value: Column, key: str) -> Column:
    """Years 1900 to 2099 with the 365 days of a common year; leap days among leap days."""
    year, day = F.substring(value, 1, 4).try_cast("int") - 1900, F.dayofyear(F.try_to_date(F.concat(F.lit("2001"), F.substring(value, 5, 6)), "yyyy-MM-dd")) - 1
    new_year, new_day = _number_feistel(year, day, 200, 365, "date", key)
    common = F.concat((new_year + 1900).cast("string"), F.date_format(F.date_add(F.lit("2001-01-01"), new_day.cast("int")), "-MM-dd"))
    # Leap years from 1904 to 2096: 49 of them.
    nth = F.floor((year - 4) / 4)
    shift = F.conv(F.substring(F.sha2(F.lit(f"{key}|leap").cast("binary"), 256), 1, 12), 16, 10).cast("long")
    leap = F.concat((1904 + 4 * F.pmod(nth + shift, F.lit(49))).cast("string"), F.lit("-02-29"))
    return F.when(day.isNotNull(), common).otherwise(leap)


def _is_dotted(date: Column) -> Column:
    return F.substring(date, 3, 1) == "."


def _iso(date: Column) -> Column:
    """Year first: a date written day first (``31.12.1985``) has the pseudonym of the same day."""
    return F.when(_is_dotted(date), F.concat_ws("-", F.substring(date, 7, 4), F.substring(date, 4, 2), F.substring(date, 1, 2))).otherwise(date)


def _is(kind: str):
    return lambda v: v["kind"] == kind


def _whole(pattern: str) -> str:
    return f"^(?:{pattern.replace(_BEFORE_CARD, '')})$"


def _is_card(value: Column) -> Column:
    def valid(digits: Column) -> Column:
        n = F.length(digits)
        return n.between(13, 19) & digits.rlike(_ISSUER) & (luhn_digit(F.substring(digits, F.lit(1), n - 1)) == F.substring(digits, n, F.lit(1)))

    return _one_by_one(F.regexp_replace(value, "[^0-9]", ""), valid)


def _cards(text: Column) -> Column:
    """The different valid cards of a text: of each place the first form that passes the check."""

    def first_valid(window: Column) -> Column:
        forms = F.array(*[F.regexp_extract(window, form, 0) for form in _CARD_FORMS])
        return F.get(F.filter(F.array_distinct(forms), lambda c: (c != "") & _is_card(c)), F.lit(0))

    return F.array_compact(F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(_CARD_WINDOW), F.lit(1))), first_valid))


def _pattern(cards: Column) -> Column:
    """What to search a text with these cards for."""
    # The longest first, as a card may be the beginning of another one.
    longest_first = F.array_sort(F.array_distinct(cards), lambda a, b: F.length(b) - F.length(a))
    some = F.concat(F.lit("(?<![0-9A-Za-z])(?:"), F.array_join(longest_first, "|"), F.lit(")(?![0-9A-Za-z])"))
    any_card = F.replace(F.lit(_ANY), F.lit("~cards~"), some)
    any_card = F.replace(any_card, F.lit(_BEFORE_CARD), F.concat(F.lit("(?!"), some, F.lit(")")))
    return F.when(F.size(cards) > 0, any_card).otherwise(_ANY.replace("~cards~", _NO_CARD).replace(_BEFORE_CARD, ""))


def kind_of(value: Column) -> Column:
    """The kind of a match that passes its validation, else null."""
    octets = F.split(value, r"\.")
    digits = F.regexp_replace(value, "[^0-9]", "")
    valid = {
        "email": F.lit(True),
        # A run of letters only, or of one figure, is a word or a rule, not a secret.
        "secret": value.rlike("[0-9]") & value.rlike("[A-Fa-f]"),
        "ip": F.forall(octets, lambda x: x.try_cast("int") <= 255),
        "date": F.try_to_date(_iso(value), "yyyy-MM-dd").isNotNull(),
        "ssn": ~value.rlike("^(?:000|666|9)|-00-|-0000$"),
        "phone": F.length(digits).between(7, 15),
        "card": _is_card(value),
    }
    return F.coalesce(*[F.when(value.rlike(_whole(p)) & valid[kind], kind) for kind, p in PATTERNS.items()])


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    """The pseudonym of a validated value; a value without a kind stays."""
    at = F.instr(value, "@")
    made = {
        "email": F.concat(feistel(F.substring(value, F.lit(1), at - 1), "email", key), F.substring(value, at, F.length(value))),
        "secret": feistel(value, "secret", key, hex_only=True),
        "ip": _ip(value, key),
        "date": _one_by_one(_date(_iso(value), key), lambda d: F.when(_is_dotted(value), F.concat_ws(".", F.substring(d, 9, 2), F.substring(d, 6, 2), F.substring(d, 1, 4))).otherwise(d)),
        "ssn": feistel(value, "ssn", key),
        # The country code stays where it is.
        "phone": F.concat(F.regexp_extract(value, r"^(?:\+[0-9]{1,3}(?=[ .\-(]))?", 0), feistel(F.regexp_replace(value, r"^\+[0-9]{1,3}(?=[ .\-(])", ""), "phone", key)),
        "card": _card(value, key),
    }
    return F.coalesce(*[F.when(kind == k, v) for k, v in made.items()], value)


def pseudonymised(df: DataFrame, text_col: str = "text", key: str | None = None, counts: bool = True) -> DataFrame:
    """``df`` with its text under pseudonyms and, with ``counts``, ``n_<kind>``: how many values of each kind it had."""
    key = key or df.sparkSession.conf.get(KEY_SETTING, None) or DEFAULT_KEY
    text = F.col(text_col)
    whole, pattern, values = (fresh(df, n) for n in ("__text", "__pattern", "__values"))
    # Only texts that can have an identifier are cut up.
    found = df.withColumn(whole, F.when(text.rlike(_NECESSARY), text))
    found = found.withColumn(pattern, _pattern(_cards(F.col(whole))))
    found = found.withColumn(values, F.regexp_extract_all(whole, F.col(pattern), F.lit(0)))
    some = F.size(values) > 0
    found = found.withColumn(values, F.when(some, F.transform(values, lambda v: F.struct(v.alias("value"), kind_of(v).alias("kind")))))
    new = F.transform(values, lambda v: pseudonym(v["value"], v["kind"], key))
    between = F.split(whole, F.col(pattern), -1)
    rebuilt = F.array_join(F.zip_with(between, new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    results = {text_col: F.when(F.col(values).isNotNull(), rebuilt).otherwise(text)}
    if counts:
        results |= {f"n_{k}": F.when(some, F.size(F.filter(values, _is(k)))).otherwise(0) for k in KINDS}
    return found.withColumns(results).drop(whole, pattern, values)


__all__ = ["KINDS", "PATTERNS", "feistel", "kind_of", "luhn_digit", "pseudonym", "pseudonymised"]
