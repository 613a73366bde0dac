"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Card numbers (Luhn), IPv4 addresses, dates, phone and social security numbers,
mail addresses and secrets are found, validated, and permuted under a key
within their own format: a card becomes a valid card, a date a date of the
same layout, an address an address; every character stays in its class. The
permutation is a Feistel network, so different values stay different, and it
depends on the key and the value alone, so equal values stay linked across
documents, also when they are written with other separators.

Nothing is shuffled: each text is cut at the matches and put together again.

Defined results: NULL text stays NULL, empty text empty; candidates that fail
validation (a 16-digit number that is no card, 2024-02-31) stay as they are;
a repeated row gets a repeated result; an empty table gives an empty result;
a text of any length is read whole; other columns are kept by
``pseudonymised``, whatever their names (but ``_found``, which it replaces).
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirescope.llm.common import packed

ROUNDS = 8
# Dates are permuted among the days of these years.
FIRST_DAY, DAYS = "1900-01-01", 73049  # to 2099-12-31
_SIDE = 271  # halves of a day number; the least whose square holds all days
_WALK = 12

# A pattern for each kind, in order of precedence. Repeats are possessive or
# bounded and begin where no part of a longer run precedes, so that a text is
# read once.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "secret": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}(?![0-9A-Za-z])"
              r"|(?i:password|passwd|secret|token|api_key)[ ]{0,3}[=:][ ]{0,3}[\x22']?[A-Za-z0-9_/+.-]{8,}+)",
    "ip": r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])",
    "date": r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?![0-9A-Za-z]|[./-][0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}"
             r"|\([0-9]{3}\)[ ]?[0-9]{3}-[0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9A-Za-z]|-[0-9])",
    "card": r"(?<![0-9A-Za-z.+-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z]|-[0-9])",
}
KINDS = tuple(PATTERNS)
# No kind begins inside a word; testing that first leaves most places at once.
ANY = "(?<![A-Za-z0-9])(?:" + "|".join(PATTERNS.values()) + ")"


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _upto(n: Column) -> Column:
    """1 .. n, nothing for 0."""
    return F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))


def _stream(key: str, tweak: str, turn: Column, half: Column) -> Column:
    """128 hexadecimal digits from the key, the turn and the other half."""
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), turn.cast("string"), half), 512)


def _number(hexadecimal: Column, at, digits: int = 4) -> Column:
    return F.conv(F.substr(hexadecimal, F.lit(at) if isinstance(at, int) else at, F.lit(digits)), 16, 10).cast("int")


def _shifted(text: Column, stream: Column) -> Column:
    """Each character moved within its class by the stream."""
    return _let(stream, lambda known: _moved(text, known))


def _moved(text: Column, stream: Column) -> Column:
    def one(c: Column, i: Column) -> Column:
        by = _number(stream, (i % 32) * 4 + 1)
        code = F.ascii(c)
        move = lambda low, size: F.char(low + (code - low + by) % size)
        return (F.when(c.between("0", "9"), move(48, 10)).when(c.between("a", "z"), move(97, 26))
                .when(c.between("A", "Z"), move(65, 26)).otherwise(c))
    return F.array_join(F.transform(F.split(text, ""), one), "")


def permuted_text(s: Column, key: str, tweak: str) -> Column:
    """Feistel permutation of a text among the texts of its length whose
    characters have the same classes, place by place."""
    return _let(s, lambda known: _permuted(known, key, tweak))


def _permuted(s: Column, key: str, tweak: str) -> Column:
    half = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(F.substr(s, F.lit(1), half).alias("a"), F.substr(s, half + 1, F.length(s)).alias("b"))

    def turn(acc: Column, r: Column) -> Column:
        even = r % 2 == 0
        return F.struct(
            F.when(even, _shifted(acc["a"], _stream(key, tweak, r, acc["b"]))).otherwise(acc["a"]).alias("a"),
            F.when(even, acc["b"]).otherwise(_shifted(acc["b"], _stream(key, tweak, r, acc["a"]))).alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda acc: F.concat(acc["a"], acc["b"]))


def permuted_number(n: Column, side: int, size: int, key: str, tweak: str) -> Column:
    """Feistel permutation of 0 .. size - 1; what falls outside is permuted
    again until it falls inside (``side`` squared holds ``size`` closely)."""
    def once(x: Column) -> Column:
        start = F.struct(F.floor(x / side).cast("int").alias("a"), (x % side).cast("int").alias("b"))

        def turn(acc: Column, r: Column) -> Column:
            mixed = acc["a"] + _number(_stream(key, tweak, r, acc["b"].cast("string")), 1, 6)
            return F.struct(acc["b"].alias("a"), (mixed % side).alias("b"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn,
                           lambda acc: acc["a"].cast("long") * side + acc["b"])
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(_WALK)), F.lit(-1).cast("long"),
                       lambda acc, i: F.when((acc >= 0) & (acc < size), acc).otherwise(once(F.when(acc < 0, n).otherwise(acc))))
    return F.when((walk >= 0) & (walk < size), walk).otherwise(n)


def luhn_sum(digits: Column, from_right: int) -> Column:
    """Sum of the digits, every second one doubled; ``from_right`` is the place
    of the last digit, counted from 0."""
    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        odd = (F.length(digits) - i + from_right) % 2 == 1
        twice = d * 2
        return acc + F.when(odd, twice - F.when(twice > 9, 9).otherwise(0)).otherwise(d)
    return F.aggregate(_upto(F.length(digits)), F.lit(0), add)


def _refilled(match: Column, value: Column, kept: str = "0-9") -> Column:
    """``match`` with its characters of a class replaced, in order, by ``value``."""
    # What stands between those characters, each piece followed by a new one:
    # the cost grows with the length, not with its square.
    return _let(F.split(match, f"[{kept}]", -1), lambda cut: F.concat(F.array_join(F.zip_with(
        F.slice(cut, F.lit(1), F.size(cut) - 1), F.split(value, ""), lambda g, c: F.concat(g, c)), ""), F.element_at(cut, -1)))


def _card(m: Column, key: str) -> Column:
    # The first digit, which names the issuer's branch, and the validity stay.
    def new(d: Column) -> Column:
        payload = F.concat(F.substr(d, F.lit(1), F.lit(1)),
                           permuted_text(F.substr(d, F.lit(2), F.length(d) - 2), key, "card"))
        checked = _let(payload, lambda p: F.concat(p, ((10 - luhn_sum(p, 1) % 10) % 10).cast("string")))
        return F.when(luhn_sum(d, 0) % 10 == 0, _refilled(m, checked))
    return _let(_digits(m), new)


def _ip(m: Column, key: str) -> Column:
    part = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    high, low = part[0] * 256 + part[1], part[2] * 256 + part[3]

    def turn(acc: Column, r: Column) -> Column:
        mixed = acc["a"] + _number(_stream(key, "ip", r, acc["b"].cast("string")), 1)
        return F.struct(acc["b"].alias("a"), (mixed % 65536).alias("b"))
    whole = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(high.alias("a"), low.alias("b")), turn,
                        lambda acc: F.concat_ws(".", *[x.cast("string") for h in (acc["a"], acc["b"])
                                                       for x in (F.floor(h / 256).cast("int"), h % 256)]))
    return F.when(F.forall(part, lambda x: x <= 255), whole)


def _date(m: Column, key: str) -> Column:
    iso = m.rlike("^[0-9]{4}-")
    d = _digits(m)
    cut = lambda a, n: F.substr(d, F.lit(a), F.lit(n))
    text = F.when(iso, F.concat_ws("-", cut(1, 4), cut(5, 2), cut(7, 2))).otherwise(
        F.concat_ws("-", cut(5, 4), cut(3, 2), cut(1, 2)))
    day = F.datediff(text.try_cast("date"), F.lit(FIRST_DAY).cast("date"))
    new = F.date_add(F.lit(FIRST_DAY).cast("date"), permuted_number(day, _SIDE, DAYS, key, "date").cast("int"))
    digits = F.when(iso, F.date_format(new, "yyyyMMdd")).otherwise(F.date_format(new, "ddMMyyyy"))
    return F.when(day.between(0, DAYS - 1), _refilled(m, digits))


def _phone(m: Column, key: str) -> Column:
    # The country code stays; what follows it is permuted.
    code = F.regexp_extract(m, r"^(\+[0-9]{1,3}(?=[ .(-]))?", 0)
    rest = F.substr(m, F.length(code) + 1, F.length(m))
    return _let(rest, lambda r: F.concat(code, _refilled(r, permuted_text(_digits(r), key, "phone"))))


def _letters(m: Column, key: str, tweak: str, prefix: str) -> Column:
    """Letters and digits after ``prefix`` (a pattern of what stays)."""
    head = F.regexp_extract(m, prefix, 0)
    rest = F.substr(m, F.length(head) + 1, F.length(m))
    kept = "A-Za-z0-9"
    return _let(rest, lambda r: F.concat(head, _refilled(
        r, permuted_text(F.regexp_replace(r, f"[^{kept}]", ""), key, tweak), kept)))


def _email(m: Column, key: str) -> Column:
    # The top-level domain stays, and has letters only.
    top = F.regexp_extract(m, r"\.[A-Za-z]{2,}$", 0)
    return F.when(top != "", F.concat(_letters(F.substr(m, F.lit(1), F.length(m) - F.length(top)), key, "email", "^"), top))


def _kind(m: Column) -> Column:
    """Number of the kind whose pattern a match is, from 0."""
    out = F.lit(len(KINDS) - 1)
    for i in reversed(range(len(KINDS) - 1)):
        out = F.when(m.rlike(f"^(?:{PATTERNS[KINDS[i]]})$"), i).otherwise(out)
    return out


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    """Pseudonym of one match, NULL where it fails validation."""
    secret = r"^(?:AKIA|[A-Za-z_]+[ ]*[=:][ ]*[\x22']?)"
    made = {"email": _email(m, key), "secret": _letters(m, key, "secret", secret), "ip": _ip(m, key),
            "date": _date(m, key), "phone": _phone(m, key), "card": _card(m, key),
            "ssn": _refilled(m, permuted_text(_digits(m), key, "ssn"))}
    out = F.lit(None).cast("string")
    for i, name in enumerate(KINDS):
        out = F.when(kind == i, made[name]).otherwise(out)
    return out


def pseudonymised(docs: DataFrame, key: str, with_values: bool = False) -> DataFrame:
    """``docs`` (all columns) with pseudonyms in ``text``, and ``_found``: an
    array of ``(kind, pseudonym)`` in the order of the text; ``with_values``
    puts the raw value between the two, which is personal data."""
    rows, column = packed(docs, "text")
    cut = rows.withColumn("_m", F.when(F.col("text").rlike("[0-9@=:]"), F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))
                          .otherwise(F.array().cast("array<string>")))
    kinds = F.array(*map(F.lit, KINDS))
    found = F.size("_m") > 0
    cut = cut.withColumns({
        "_k": F.when(found, F.transform("_m", lambda m: F.struct(m.alias("value"), _kind(m).alias("k")))),
        "_g": F.when(found, F.split("text", ANY, -1))})
    cut = cut.withColumn("_p", F.transform("_k", lambda x: F.struct(
        F.get(kinds, x["k"]).alias("kind"), x["value"].alias("value"), pseudonym(x["value"], x["k"], key).alias("pseudonym"))))
    # The text between the matches, each followed by what stands for the match.
    joined = F.concat(F.array_join(F.zip_with(
        F.slice("_g", 1, F.size("_p")), F.transform("_p", lambda p: F.coalesce(p["pseudonym"], p["value"])),
        lambda g, p: F.concat(g, p)), ""), F.element_at("_g", -1))
    text = F.when(F.col("_p").isNull(), F.col("text")).otherwise(joined)
    fields = ["kind", "value", "pseudonym"] if with_values else ["kind", "pseudonym"]
    none = F.array().cast(f"array<struct<{','.join(f'{f}:string' for f in fields)}>>")
    replaced = F.transform(F.filter("_p", lambda p: p["pseudonym"].isNotNull()), lambda p: F.struct(*[p[f].alias(f) for f in fields]))
    return cut.select(*[text.alias(c) if c == "text" else column(c) for c in docs.columns if c != "_found"],
                      F.coalesce(replaced, none).alias("_found"))
