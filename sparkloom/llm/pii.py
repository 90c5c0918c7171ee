"""Format-preserving pseudonyms by keyed Feistel permutations, in DataFrame expressions only.

Card numbers (Luhn), telephone numbers (+1, area code from 2), IPv4 addresses and calendar dates are found, validated
and permuted within their format: a card number stays a valid one of the same length, first digit and spacing, a date a
date from 1900 to 2099. The permutation depends on the secret alone, so equal values stay linked over all documents and
different ones stay apart. Cards are looked for at each group of a run of digit groups, so a year, an expiry date or a
security code beside one doesn't hide it. E-mail names are permuted among those with letters, digits and capitals in the same places; the
domain stays. Values that fail validation stay.

Defined cases: a null text stays null; repeated rows change alike; an empty table gives no rows; other columns stay, but for those named as the counts, which
are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._common import TMP, drop_tmp, fenced

ROUNDS = 8
FIRST_DAY, DAYS = "1900-01-01", 73_049
#: A run of groups from one of four digits on, with 13 digits at least, or digits alone; it may hold other numbers besides cards.
CARD = r"(?<![0-9A-Za-z])(?:(?=[0-9](?:[ -]?[0-9]){12})[0-9]{4}(?:[ -][0-9]{1,7})+|[0-9]{13,19})(?![0-9A-Za-z])"
#: What a card can be at a group's start, longest first: groups of four with or without a last one of up to three digits, other
#: lengths of the last group, 4-6-5, or digits alone.
CARD_FORMS = tuple(f"^{x}(?![0-9])" for x in ("[0-9]{4}(?:[ -][0-9]{4}){3}[ -][0-9]{1,3}", "[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,7}", "[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}", "[0-9]{13,19}"))
PHONE = r"\+1[ .-]?\(?[2-9][0-9]{2}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"
IP = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.]*[0-9])"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
DATES = ((r"(?<![0-9])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9])", "yyyy-MM-dd"), (r"(?<![0-9.])[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?![0-9])", "dd.MM.yyyy"), (r"(?<![0-9/])[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9/])", "MM/dd/yyyy"))


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value evaluated once."""
    return F.transform(F.array(value), f)[0]


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, key: str, kind: str) -> Column:
    """Struct (l, r): a keyed permutation of the pairs below (left_size, right_size), sizes up to 10**9."""

    def mix(i: Column, half: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), left_size.cast("string"), right_size.cast("string"), half.cast("string")), 256)
        return F.conv(F.substring(digest, 1, 14), 16, 10).cast("long")

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))

    def turn(s: Column, i: Column) -> Column:
        odd = i % 2 == 1
        return F.struct(F.when(odd, (s["l"] + mix(i, s["r"])) % left_size).otherwise(s["l"]).alias("l"), F.when(odd, s["r"]).otherwise((s["r"] + mix(i, s["l"])) % right_size).alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def permute_digits(digits: Column, key: str, kind: str) -> Column:
    """A string of 2 to 18 digits, permuted among those of its length."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    size = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
    done = feistel(F.substring(digits, F.lit(1), u), F.substring(digits, u + 1, n - u), size(u), size(n - u), key, kind)
    return _let(done, lambda s: F.concat(F.lpad(s["l"].cast("string"), u, "0"), F.lpad(s["r"].cast("string"), n - u, "0")))


def _luhn(digits: Column, doubled: int) -> Column:
    """The Luhn sum; digits at odd (1) or even (0) places from the right are doubled."""
    n = F.length(digits)

    def term(i: Column) -> Column:
        d = F.substring(digits, n + 1 - i, F.lit(1)).cast("int")
        return F.when(i % 2 == doubled, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), term), F.lit(0), lambda a, x: a + x)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _refill(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced in order."""
    at = lambda i: F.length(_digits(F.substring(shape, F.lit(1), i)))
    char = lambda i: F.substring(shape, i, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), lambda i: F.when(char(i).rlike("[0-9]"), F.substring(digits, at(i), F.lit(1))).otherwise(char(i))), "")


def _card(m: Column, key: str) -> Column:
    """Struct (s, n): the run m with its n cards permuted, each the longest valid one at the first group that begins one."""

    def new(d: Column) -> Column:
        body = F.concat(F.substring(d, 1, 1), permute_digits(F.substring(d, F.lit(2), F.length(d) - 2), key, "card"))
        return _let(body, lambda b: F.concat(b, ((10 - _luhn(b, 1) % 10) % 10).cast("string")))

    def at(state: Column, i: Column) -> Column:
        rest = F.substring(m, i, F.length(m))
        starts = (i >= state["next"]) & ((i == 1) | F.substring(m, i - 1, F.lit(1)).isin(" ", "-"))
        forms = F.when(starts, F.array(*[F.regexp_extract(rest, f, 0) for f in CARD_FORMS])).otherwise(F.array().cast("array<string>"))
        valid = F.filter(forms, lambda c: (c != "") & (_luhn(_digits(c), 0) % 10 == 0))
        same = F.struct(F.when(i >= state["next"], F.concat(state["s"], F.substring(m, i, F.lit(1)))).otherwise(state["s"]).alias("s"), state["n"].alias("n"), state["next"].alias("next"))
        changed = lambda c: F.struct(F.concat(state["s"], _refill(c, new(_digits(c)))).alias("s"), (state["n"] + 1).alias("n"), (i + F.length(c)).alias("next"))
        return _let(F.get(valid, F.lit(0)), lambda c: F.when(c.isNotNull(), changed(c)).otherwise(same))

    start = F.struct(F.lit("").alias("s"), F.lit(0).cast("long").alias("n"), F.lit(1).alias("next"))
    return F.aggregate(F.sequence(F.lit(1), F.length(m)), start, at, lambda x: F.struct(x["s"].alias("s"), x["n"].alias("n")))


def _phone(m: Column, key: str) -> Column:
    return _let(_digits(m), lambda d: _refill(m, F.concat(F.substring(d, 1, 2), permute_digits(F.substring(d, 3, 9), key, "phone"))))


def _ip(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    pair = lambda o, i: F.get(o, F.lit(i)) * 256 + F.get(o, F.lit(i + 1))
    byte = lambda v, s: F.concat_ws(".", F.floor(v[s] / 256).cast("string"), (v[s] % 256).cast("string"))
    size = F.lit(65536).cast("long")
    return _let(octets, lambda o: F.when(F.array_max(o) <= 255, _let(feistel(pair(o, 0), pair(o, 2), size, size, key, "ip"), lambda v: F.concat_ws(".", byte(v, "l"), byte(v, "r")))).otherwise(m))


def _date(m: Column, form: str, key: str) -> Column:
    """Cycle walking over 17 bits: the permutation is applied until it falls on a day of the range."""
    day = F.datediff(F.try_to_timestamp(m, F.lit(form)).cast("date"), F.lit(FIRST_DAY).cast("date")).cast("long")
    apply = lambda x: _let(feistel(F.floor(x / 512), x % 512, F.lit(256).cast("long"), F.lit(512).cast("long"), key, "date"), lambda s: s["l"] * 512 + s["r"])
    walked = lambda d: F.aggregate(F.sequence(F.lit(1), F.lit(64)), apply(d), lambda x, _: F.when(x < DAYS, x).otherwise(apply(x)))
    valid = lambda d: (d >= 0) & (d < DAYS)
    return _let(day, lambda d: F.when(valid(d), F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), walked(d).cast("int")), form)).otherwise(m))


def _email(m: Column, key: str) -> Column:
    """The name permuted within its shape: a Feistel network on its two halves, in which each letter or digit of one half is moved on by a hash of
    the other half. So two names of one shape never meet, and names that differ in case alone stay alike. Other characters and the domain stay."""
    name, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    low, up, ten = (F.lit(x) for x in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"))

    def moved(half: Column, by: Column) -> Column:
        def one(i: Column, digest: Column) -> Column:
            c, step = F.substring(half, i, F.lit(1)), F.conv(F.substring(digest, (i * 2) % 126 + 1, F.lit(2)), 16, 10).cast("int")
            at = lambda alphabet, n: F.substring(alphabet, (F.instr(alphabet, c) - 1 + step) % n + 1, F.lit(1))
            return F.when(F.instr(low, c) > 0, at(low, 26)).when(F.instr(up, c) > 0, at(up, 26)).when(F.instr(ten, c) > 0, at(ten, 10)).otherwise(c)

        each = _let(by, lambda d: F.array_join(F.transform(F.sequence(F.lit(1), F.length(half)), lambda i: one(i, d)), ""))
        return F.when(F.length(half) > 0, each).otherwise("")

    def turn(state: Column, i: Column) -> Column:
        other = F.when(i % 2 == 0, state["l"]).otherwise(state["r"])
        by = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), i.cast("string"), F.lower(other), F.lower(domain)), 512)
        return F.struct(F.when(i % 2 == 0, state["l"]).otherwise(moved(state["l"], by)).alias("l"), F.when(i % 2 == 0, moved(state["r"], by)).otherwise(state["r"]).alias("r"))

    cut = F.floor(F.length(name) / 2).cast("int")
    start = F.struct(F.substring(name, F.lit(1), cut).alias("l"), F.substring(name, cut + 1, F.length(name)).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda x: F.concat(x["l"], x["r"], F.lit("@"), domain))


def _counted(f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """Struct (s, n): f of a value, and 1 if that is another."""
    return lambda m: _let(f(m), lambda x: F.struct(x.alias("s"), (x != m).cast("long").alias("n")))


def _kinds(key: str) -> list[tuple[str, str, Callable[[Column], Column]]]:
    in_form = lambda form: lambda m: _date(m, form, key)
    dates = [(f"date{i}", p, _counted(in_form(f))) for i, (p, f) in enumerate(DATES)]
    return [("email", EMAIL, _counted(lambda m: _email(m, key))), ("ip", IP, _counted(lambda m: _ip(m, key))), ("card", CARD, lambda m: _card(m, key)), ("phone", PHONE, _counted(lambda m: _phone(m, key))), *dates]


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with its text changed and n_email, n_ip, n_card, n_phone, n_date (values replaced)."""
    df, names = docs.withColumn(f"{TMP}text", F.col(text_col)), []
    for name, pattern, new in _kinds(key):
        text = F.col(f"{TMP}text")
        df = df.withColumn(f"{TMP}old", F.when(text.rlike(pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
        df = df.withColumn(f"{TMP}new", F.transform(f"{TMP}old", new))
        df = df.withColumn(f"{TMP}n_{name}", F.aggregate(f"{TMP}new", F.lit(0).cast("long"), lambda n, x: n + x["n"]))
        joined = F.array_join(F.zip_with(F.split(text, pattern, -1), f"{TMP}new", lambda gap, x: F.concat(gap, F.coalesce(x["s"], F.lit("")))), "")
        df = df.withColumn(f"{TMP}text", F.when(F.size(f"{TMP}old") > 0, joined).otherwise(text)).drop(f"{TMP}old", f"{TMP}new")
        df = fenced(df, [f"{TMP}text", f"{TMP}n_{name}"])
        names.append(name)
    dates = sum((F.col(f"{TMP}n_{n}") for n in names if n.startswith("date")), F.lit(0).cast("long"))
    out = df.withColumns({text_col: F.col(f"{TMP}text"), "n_date": dates} | {f"n_{n}": F.col(f"{TMP}n_{n}") for n in names if not n.startswith("date")})
    return drop_tmp(out)


def op9(docs: DataFrame, key: str = "a secret of the deployment") -> DataFrame:
    return pseudonymize(docs.select("doc_id", "text"), key).select("doc_id", "text", "n_email", "n_ip", "n_card", "n_phone", "n_date")
