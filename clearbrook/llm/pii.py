"""Personal data replaced by surrogates, with DataFrame functions only.

A surrogate depends on a secret key and the entity alone, so an entity has the same one in every text. Numbers
go through a keyed permutation of their digits (a Feistel network), which keeps them distinct by construction;
names, mail addresses and secrets are spelled from a keyed digest, and collisions are looked for over all
entities of the input and resolved. Layout, letter case, gender, script, check digits and the class of an address
(private, public, ...) follow the original.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clearbrook.llm.shared import load, set_aside, staged

MALE = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Signor", "г-н", "Κύριος"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Signora", "г-жа", "Κυρία"]
NEUTRAL = ["Dr", "Prof", "Mx"]
TITLES = MALE + FEMALE + NEUTRAL
#: Syllables of made-up names: consonant and vowel, 32 for each script.
SYLLABLES = {
    "Latin": [c + v for c in "bdklmnrt" for v in "aeio"],
    "Cyrillic": [c + v for c in "бдклмнрт" for v in "аеио"],
    "Greek": [c + v for c in "βδκλμνρτ" for v in "αειο"],
}
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
NAME = r"\p{Lu}(?:\p{L}+|['’]\p{L}+)(?:[-'’](?!s(?!\p{L}))\p{L}+)*+"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "secret": r"(?i:(?<![a-z0-9])(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}(?:[\"'][^\s\"']{8,}+|[\p{L}\p{N}_/+.=!@#$%^&*~?|:\\-]{7,}[\p{L}\p{N}_/+=!@#$%^&*~|\\-]))|(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|sk-[A-Za-z0-9_-]{20,}+|(?=[0-9a-f]*[a-f])(?=[0-9a-f]*[0-9])[0-9a-f]{32,}+)(?![A-Za-z0-9])",
    # Written in groups, all but the bank's code hold a digit (so that no word after it is taken), but for three countries.
    "iban": r"(?<![A-Za-z0-9])(?:(?=(?:[A-Z]*\d){8})[A-Z]{2}\d{2}[A-Z0-9]{11,30}|NO\d{2} \d{4} \d{4} \d{3}|MT\d{2}(?: [A-Z0-9]{4}){6} [A-Z0-9]{3}|SC\d{2} [A-Z]{4}(?: \d{4}){5} [A-Z]{3}|MU\d{2} [A-Z]{4}(?: \d{4}){4} \d{3}[A-Z] [A-Z]{2}|[A-Z]{2}\d{2} [A-Z0-9]{4}(?: (?=[A-Z]{0,3}\d)[A-Z0-9]{4}){2,6}(?: (?=[A-Z]{0,2}\d)[A-Z0-9]{1,3})?|[A-Z]{2}\d{2}(?: ?\d{4}){3,6}(?: ?\d{1,3})?)(?![A-Za-z0-9])",
    "ip": rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)",
    "card": r"(?<!\d)(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{13,19})(?!\d)",
    "name": rf"(?<!\p{{L}})(?:(?:{'|'.join(TITLES)})\.? )++{NAME}(?: {NAME})?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text with none of these has no entity and isn't searched further.
HINT = rf"[0-9@]|(?i:token|secret|passw|_key|-key|apikey)|(?:{'|'.join(TITLES)})\.? "
ROUNDS = 4
#: Columns that ``pseudonymise`` adds or uses.
OUTPUTS = ["surrogate_text", "entities", "_m", "_e", "_p", "_again", "_tokens", "_row", "_notes"]
#: The session's setting that holds the secret key of the registered query and the pipeline.
KEY_SETTING = "spark.clearbrook.surrogate.key"
ENTITY = "array<struct<type:string,gap:int,length:int,surrogate:string,id:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _number(digest: Column, at: int) -> Column:
    return F.conv(F.substring(digest, at, 12), 16, 10).cast("long")


def _keyed(key: str, *parts: Column | str | int) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]), 256)


def _permuted(key: str, kind: str, left: Column, right: Column, left_size: Column, right_size: Column, salt: Column) -> Column:
    """struct(l, r): a keyed permutation of the pairs with l < left_size and r < right_size."""

    def step(s: Column, i: Column) -> Column:
        r = F.pmod(s["r"] + _number(_keyed(key, kind, salt, i, "r", s["l"]), 1), right_size)
        return _let(r, lambda r: F.struct(F.pmod(s["l"] + _number(_keyed(key, kind, salt, i, "l", r), 1), left_size).alias("l"), r.alias("r")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), F.struct(left.alias("l"), right.alias("r")), step)


def _ten_to(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, F.lit("0")).cast("long")


def _digits_permuted(key: str, kind: str, digits: Column) -> Column:
    """Other digits of the same number, two at least and 18 at most; permutes all numbers of that many digits."""

    def halves(d: Column) -> Column:
        n = F.length(d)
        a = F.floor(n / 2).cast("int")
        mixed = _permuted(key, kind, F.substring(d, F.lit(1), a).cast("long"), F.substring(d, a + 1, n).cast("long"), _ten_to(a), _ten_to(n - a), n)
        return _let(mixed, lambda s: F.concat(F.lpad(s["l"].cast("string"), a, F.lit("0")), F.lpad(s["r"].cast("string"), n - a, F.lit("0"))))

    return _let(digits, halves)


def _laid_out(original: Column, digits: Column) -> Column:
    """``original`` with its digits replaced in order."""
    char = lambda i: F.substring(original, i, F.lit(1))
    nth = lambda i: F.length(F.regexp_replace(F.substring(original, F.lit(1), i), r"\D", ""))
    return _let(digits, lambda d: F.array_join(F.transform(F.sequence(F.lit(1), F.length(original)), lambda i: F.when(char(i).rlike("[0-9]"), F.substring(d, nth(i), F.lit(1))).otherwise(char(i))), ""))


def _luhn(digits: Column) -> Column:
    """The check digit for ``digits``."""
    n = F.length(digits)
    doubled = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    value = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + F.when(F.pmod(n - i, F.lit(2)) == 0, doubled(value(i))).otherwise(value(i)))
    return F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"\D", "")


def _tail(m: Column, n: int) -> Column:
    """The last ``n`` digits of m, all if it has fewer."""
    return F.right(_digits(m), F.lit(n))


def _card(key: str, m: Column) -> Column:
    """First digit and validity stay; a wrong check digit stays as wrong by as much."""

    def body(d: Column) -> Column:
        n = F.length(d)
        first, middle, last = F.substring(d, 1, 1), F.substring(d, F.lit(2), n - 2), F.substring(d, n, F.lit(1)).cast("int")
        off = last - _luhn(F.concat(first, middle))
        return _let(F.concat(first, _digits_permuted(key, "card", middle)), lambda x: _laid_out(m, F.concat(x, F.pmod(_luhn(x) + off, F.lit(10)).cast("string"))))

    return _let(_digits(m), body)


def _tail_permuted(key: str, kind: str, m: Column, n: int) -> Column:
    """The last ``n`` digits of m permuted, those before them kept."""
    return _let(_digits(m), lambda d: _laid_out(m, F.concat(F.substring(d, F.lit(1), F.length(d) - F.length(F.right(d, F.lit(n)))), _digits_permuted(key, kind, F.right(d, F.lit(n))))))


def _ip(key: str, m: Column) -> Column:
    """The first octet stays and so does the class: addresses of a reserved block (of 10, 100.64, 127, 169.254, 172.16, 192.168 or above 223) are permuted within it, others outside it."""
    part = lambda k: F.get(F.split(m, r"\."), F.lit(k)).cast("long")
    n = lambda x: F.lit(x).cast("long")
    dotted = lambda *xs: F.concat_ws(".", *[x.cast("string") for x in xs])

    def body(a: Column) -> Column:
        first, second, low = a["a"], a["b"], a["c"] * 256 + a["d"]
        mixed = lambda left, size: _permuted(key, "ip", left, low, n(size), n(65536), first * 256 + size)
        out = lambda s, back: dotted(first, back(s["l"]), F.floor(s["r"] / 256), F.pmod(s["r"], F.lit(256)))

        def block(at: int, size: int) -> Column:
            """Second octets from ``at`` are the reserved block, of ``size``."""
            inside = _let(mixed(second - at, size), lambda s: out(s, lambda v: v + at))
            outside = _let(mixed(F.when(second < at, second).otherwise(second - size), 256 - size), lambda s: out(s, lambda v: F.when(v < at, v).otherwise(v + size)))
            return F.when(second.between(at, at + size - 1), inside).otherwise(outside)

        whole = _let(mixed(second, 256), lambda s: out(s, lambda v: v))
        lowest = _let(_permuted(key, "ip", a["c"], a["d"], n(256), n(256), first), lambda s: dotted(first, second, s["l"], s["r"]))
        two = ((first == 192) & (second == 168)) | ((first == 169) & (second == 254))
        return F.when(two, lowest).when(first == 172, block(16, 16)).when(first == 100, block(64, 64)).when(first == 192, block(168, 1)).when(first == 169, block(254, 1)).otherwise(whole)

    return _let(F.struct(*[part(k).alias(x) for k, x in enumerate("abcd")]), body)


def _spelled(digest: Column, at: int, n: int, script: str = "Latin") -> Column:
    table = F.array(*[F.lit(s) for s in SYLLABLES[script]])
    return F.concat(*[F.get(table, F.pmod(F.conv(F.substring(digest, at + 2 * k, 2), 16, 10).cast("int"), F.lit(32))) for k in range(n)])


def _suffix(key: str, rank: Column) -> Column:
    """Four syllables for a rank among entities of one first surrogate (below 2^20), a permutation of it."""
    size = F.lit(1024).cast("long")
    table = F.array(*[F.lit(x) for x in SYLLABLES["Latin"]])
    of = lambda v: F.concat(F.get(table, F.floor(v / 32).cast("int")), F.get(table, F.pmod(v, F.lit(32)).cast("int")))
    return _let(_permuted(key, "rank", F.floor(rank / 1024), F.pmod(rank, size), size, size, F.lit(0)), lambda s: F.concat(of(s["l"]), of(s["r"])))


def _remainder(bban: Column, country: Column, check: Column) -> Column:
    """Of an IBAN by 97, with A as 10 to Z as 35."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda a, c: F.pmod(a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c), F.lit(97))
    return F.aggregate(F.split(F.concat(bban, country, check), ""), F.lit(0), step)


def _iban(key: str, m: Column) -> Column:
    """The country stays. Digits after the check digits are permuted, letters shifted by the new digits and their place, whatever the layout. Check digits are right again, or wrong by as much as they were."""

    def digits(d: Column) -> Column:
        n = F.length(d)
        # A permutation takes 18 digits; of more, those in front have one of their own (two at least).
        head = F.when(n <= 18, 0).otherwise(F.greatest(n - 18, F.lit(2)))
        front = F.when(head == 0, "").otherwise(_digits_permuted(key, "iban front", F.substring(d, F.lit(1), head)))
        return F.concat(front, _digits_permuted(key, "iban", F.substring(d, head + 1, n)))

    def lettered(made: Column) -> Column:
        def char(c: Column, i: Column) -> Column:
            place = F.length(F.replace(F.substring(made, F.lit(1), i + 1), F.lit(" "), F.lit("")))
            shifted = F.pmod(F.ascii(c) - 65 + _number(_keyed(key, "iban letter", place, _digits(made)), 1), F.lit(26).cast("long"))
            return F.when(c.rlike("[A-Z]"), F.char(shifted + 65)).otherwise(c)

        return F.array_join(F.transform(F.split(made, ""), char), "")

    def checked(rest: Column) -> Column:
        bare = lambda x: F.replace(x, F.lit(" "), F.lit(""))
        country, was = F.substring(m, 1, 2), F.substring(m, 3, 2)
        right = lambda bban: 98 - _remainder(bban, country, F.lit("00"))
        off = F.pmod(was.cast("int") - right(bare(F.substring(m, F.lit(5), F.length(m)))), F.lit(97))
        return F.concat(country, F.lpad((F.pmod(right(bare(rest)) - 2 + off, F.lit(97)) + 2).cast("string"), 2, "0"), rest)

    rest = F.substring(m, F.lit(5), F.length(m))
    return _let(_let(_laid_out(rest, _let(_digits(rest), digits)), lettered), checked)


def _email(digest: Column, m: Column) -> Column:
    local = F.substring_index(m, "@", 1)
    two = F.concat(_spelled(digest, 1, 5), F.lit("."), _spelled(digest, 13, 5))
    return F.concat(two, F.when(local.rlike("[0-9]"), F.concat(F.lit("."), F.lpad(F.pmod(_number(digest, 25), F.lit(10000)).cast("string"), 4, "0"))).otherwise(""), F.lit("@mail"), F.pmod(_number(digest, 40), F.lit(10)).cast("string"), F.lit(".example.com"))


def _secret_parts(m: Column) -> tuple[Column, Column]:
    head = F.regexp_extract(m, r"^(?i)((?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?)", 1)
    return head, F.substring(m, F.length(head) + 1, F.length(m))


def _secret(digest: Column, value: Column) -> Column:
    stream = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.length(value) / 64).cast("int")), lambda k: F.sha2(F.concat(digest, k.cast("string")), 256)), "")
    hexed = F.substring(stream, F.lit(1), F.length(value))
    return F.when(value == F.upper(value), F.upper(hexed)).otherwise(hexed)


def _case_of(original: Column, made: Column) -> Column:
    return F.when((F.length(original) > 1) & (original == F.upper(original)), F.upper(made)).otherwise(F.initcap(made))


def _in_script(suffix: Column, script: str) -> Column:
    return suffix if script == "Latin" else F.translate(suffix, "bdklmnrtaeio", "бдклмнртаеио" if script == "Cyrillic" else "βδκλμνρταειο")


def _by_script(word: Column, of: Callable[[str], Column]) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), of("Cyrillic")).when(word.rlike(r"\p{IsGreek}"), of("Greek")).otherwise(of("Latin"))


def _name_stem(digest: Column, word: Column, given: bool, suffix: Column) -> Column:
    """A made-up family name, or a given name without its ending, in the word's script."""
    return _by_script(word, lambda script: F.concat(_spelled(digest, 1, 4 if given else 6, script), _in_script(suffix, script)))


def _ending(word: Column, gender: Column) -> Column:
    ends = {"Latin": ("n", "na"), "Cyrillic": ("н", "на"), "Greek": ("ς", "να")}
    return _by_script(word, lambda script: F.when(gender == "f", ends[script][1]).when(gender == "m", ends[script][0]).otherwise(""))


def _kind_of(m: Column) -> Column:
    """The pattern that a match comes from, by its form."""
    return (
        F.when(m.rlike(rf"^(?:{PATTERNS['secret']})$"), "secret").when(m.contains("@"), "email").when(m.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$"), "ip").when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(m.rlike(r"^[A-Z]{2}\d{2}[ A-Z\d]+$"), "iban").when(m.rlike(r"^(?:\+|\(|\d{3}[.-]\d{3}[.-])"), "phone").when(m.rlike(r"^[\d -]+$"), "card").otherwise("name")
    )


def _bare(words: Column) -> Column:
    return F.transform(words, lambda w: F.regexp_replace(w, r"\.$", ""))


def _name_parts(words: Column) -> Column:
    """struct(titles, names) of the words of a name; the last word is always a name."""
    title = lambda w, i: F.regexp_replace(w, r"\.$", "").isin(*TITLES) & (i < F.size(words) - 1)
    return F.struct(F.filter(words, title).alias("titles"), F.filter(words, lambda w, i: ~title(w, i)).alias("names"))


def _entity(key: str, notes: Column | None, m: Column) -> Column:
    """struct(kind, surrogate, tokens): tokens are the parts whose surrogates must be distinct, with their keyed ids. ``notes`` has, by id, the rank for a suffix (in a form that no first surrogate has) and the gender of given names that stand without one."""

    def id_of(kind: str, canonical: Column) -> Column:
        return F.substring(_keyed(key, "id", kind, canonical), 1, 24)

    def digest_of(token: Column) -> Column:
        return F.sha2(F.concat(F.lit(key), token, F.lit("0")), 256)

    def suffix_of(token: Column) -> Column:
        return F.lit("") if notes is None else _let(F.element_at(notes, token)["rank"], lambda n: F.when(n.isNull(), "").otherwise(_suffix(key, n)))

    def widened(kind: str, made: Column, suffix: Column) -> Column:
        if notes is None or kind not in ("email", "secret"):
            return made
        wide = F.concat(F.substring_index(made, "@", 1), F.lit("."), suffix, F.lit("@"), F.substring_index(made, "@", -1)) if kind == "email" else F.concat(made, F.lit("_"), suffix)
        return F.when(suffix == "", made).otherwise(wide)

    def out(kind: str, surrogate: Column, *tokens: tuple[str, Column, Column], gender: Column | None = None) -> Column:
        gender = F.lit(None).cast("string") if gender is None else gender
        return F.struct(F.lit(kind).alias("kind"), surrogate.alias("surrogate"), F.array(*[F.struct(F.lit(k).alias("kind"), i.alias("id"), s.alias("made"), gender.alias("gender")) for k, i, s in tokens]).alias("tokens"))

    def digested(kind: str, canonical: Column, made: Callable[[Column], Column], around: Callable[[Column], Column] = lambda s: s) -> Column:
        return _let(id_of(kind, canonical), lambda i: _let(widened(kind, made(digest_of(i)), suffix_of(i)), lambda s: out(kind, around(s), (kind, i, s))))

    def numbered(kind: str, made: Column, n: int) -> Column:
        return _let(made, lambda s: out(kind, s, (kind, id_of(kind, _tail(m, n)), _tail(s, n))))

    head, value = _secret_parts(m)

    def named(w: Column) -> Column:
        """Titles stay. The family name and, if there is one, the given name have surrogates of their own, each the same wherever it stands."""
        family, given, titles = F.element_at(w["names"], -1), F.get(w["names"], F.lit(0)), F.array_join(w["titles"], " ")
        said = F.when(F.arrays_overlap(_bare(w["titles"]), F.array(*[F.lit(t) for t in MALE])), "m").when(F.arrays_overlap(_bare(w["titles"]), F.array(*[F.lit(t) for t in FEMALE])), "f").otherwise("n")
        space = F.when(F.size(w["titles"]) > 0, " ").otherwise("")
        one = _let(id_of("family", F.lower(family)), lambda i: _let(_name_stem(digest_of(i), family, False, suffix_of(i)), lambda s: out("name", F.concat(titles, space, _case_of(family, s)), ("family", i, s))))

        def both(i: Column) -> Column:
            gender = said if notes is None else F.when(said == "n", F.coalesce(F.element_at(notes, i["g"])["gender"], said)).otherwise(said)
            stems = F.struct(_name_stem(digest_of(i["f"]), family, False, suffix_of(i["f"])).alias("f"), _name_stem(digest_of(i["g"]), given, True, suffix_of(i["g"])).alias("g"))
            return _let(stems, lambda s: out("name", F.concat(titles, space, _case_of(given, F.concat(s["g"], _ending(given, gender))), F.lit(" "), _case_of(family, s["f"])), ("family", i["f"], s["f"]), ("given", i["g"], s["g"]), gender=said))

        two = _let(F.struct(id_of("family", F.lower(family)).alias("f"), id_of("given", F.lower(given)).alias("g")), both)
        return F.when(F.size(w["names"]) > 1, two).otherwise(one)

    words = F.split(m, " ")
    kind = _kind_of(m)
    return (
        F.when(kind == "email", digested("email", F.lower(m), lambda d: _email(d, m)))
        .when(kind == "secret", digested("secret", value, lambda d: _secret(d, value), lambda s: F.concat(head, s)))
        .when(kind == "ip", _let(_ip(key, m), lambda s: out("ip", s, ("ip", id_of("ip", m), s))))
        .when(kind == "ssn", numbered("ssn", _tail_permuted(key, "ssn", m, 9), 9))
        .when(kind == "iban", _let(_iban(key, m), lambda s: out("iban", s, ("iban", id_of("iban", F.replace(m, F.lit(" "), F.lit(""))), F.replace(s, F.lit(" "), F.lit(""))))))
        .when(kind == "phone", numbered("phone", _tail_permuted(key, "phone", m, 10), 10))
        .when(kind == "card", numbered("card", _card(key, m), 19))
        .otherwise(_let(_name_parts(words), named))
    )


def _replaced(df: DataFrame, text: str, key: str, notes: Column | None = None) -> DataFrame:
    hit = F.col(text).rlike(HINT)
    df = df.withColumn("_m", F.when(hit, F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0))))
    # Names met with a title are found without one as well: whole, and family names alone.
    titled = rf"^(?:{'|'.join(TITLES)})\.? (?=\p{{Lu}})"
    names = F.transform(F.filter("_m", lambda m: m.rlike(titled)), lambda m: _name_parts(F.split(m, " "))["names"])
    forms = F.array_distinct(F.flatten(F.array(F.transform(F.filter(names, lambda w: F.size(w) > 1), lambda w: F.array_join(w, " ")), F.transform(names, lambda w: F.element_at(w, -1)))))
    df = df.withColumn("_again", F.when(F.size("_m") > 0, F.array_join(F.filter(forms, lambda w: F.length(w) > 2), "|")))
    df = df.withColumn("_again", F.when(F.col("_again") != "", F.concat(F.lit(ANY + r"|(?<![\p{L}\p{N}_.@-])(?:"), "_again", F.lit(r")(?![\p{L}\p{N}_@-])"))))
    df = df.withColumn("_m", F.when(F.col("_again").isNull(), F.col("_m")).otherwise(F.regexp_extract_all(F.col(text), F.col("_again"), F.lit(0))))
    df = df.withColumn("_e", F.when(F.size("_m") > 0, F.transform("_m", lambda m: _entity(key, notes, m))))
    df = df.withColumn("_p", F.when(F.size("_m") > 0, F.when(F.col("_again").isNull(), F.split(F.col(text), ANY, -1)).otherwise(F.split(F.col(text), F.col("_again"), -1))))
    rebuilt = F.array_join(F.zip_with("_p", "_e", lambda p, e: F.concat(p, F.coalesce(e["surrogate"], F.lit("")))), "")
    entity = lambda e, i: F.struct(e["kind"].alias("type"), F.length(F.get("_p", i)).alias("gap"), F.length(F.get("_m", i)).alias("length"), e["surrogate"].alias("surrogate"), e["tokens"][0]["id"].alias("id"))
    return df.withColumns(
        {
            "surrogate_text": F.when(F.col("_e").isNull(), F.col(text)).otherwise(rebuilt),
            "entities": F.coalesce(F.transform("_e", entity), F.expr(f"cast(array() as {ENTITY})")),
            "_tokens": F.flatten(F.transform("_e", lambda e: e["tokens"])),
        }
    ).drop("_m", "_e", "_p", "_again")


def pseudonymise(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``df`` with surrogate_text and entities: type, gap (characters since the entity before), length, surrogate and a keyed id.

    The same entity has the same surrogate in all texts, whatever its layout or letter case, for whoever holds the
    secret ``key``; different ones have different surrogates: entities of one first surrogate are ranked in a table
    over the whole input, and all but one get a suffix from their rank. Names are found after titles, and without one
    where the same text has them with one. A given name's ending shows the gender of its title; without such a
    title it is the one that all titles of the name in the input agree on. Titles stay.

    A null text stays null, an empty one empty, both without entities; texts of any length are read whole; repeated
    rows are treated alike; an empty table gives an empty one. Results are written to the shared folder. Input columns
    named like an output stay as ``<name>_in``.
    """
    df = set_aside(df, OUTPUTS)
    text = text if text in df.columns else f"{text}_in"
    done = staged(_replaced(df, text, key).withColumn("_row", F.monotonically_increasing_id()), "surrogates")
    tokens = done.where(F.size("_tokens") > 0).select("_row", F.explode("_tokens").alias("t")).select("_row", "t.*")
    distinct = tokens.select("kind", "made", "id").distinct()
    shared = distinct.groupBy("kind", "made").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    rank = F.row_number().over(Window.partitionBy("kind", "made").orderBy("id")) - 1
    ranks = distinct.join(shared, ["kind", "made"]).select("id", rank.cast("long").alias("rank"), F.lit(None).cast("string").alias("gender")).where("rank > 0")
    has = lambda g: F.max(F.col("gender") == g)
    said = tokens.where("kind = 'given'").groupBy("id").agg(has("m").alias("m"), has("f").alias("f"), has("n").alias("n"))
    genders = said.where("n and m <> f").select("id", F.lit(None).cast("long").alias("rank"), F.when(F.col("m"), "m").otherwise("f").alias("gender"))
    notes = staged(ranks.unionByName(genders).groupBy("id").agg(F.max("rank").alias("rank"), F.max("gender").alias("gender")), "notes")
    if notes.isEmpty():
        return done.drop("_tokens", "_row")
    changed = tokens.select("_row", "id", F.col("gender").alias("_said")).distinct().join(notes, "id").where("rank is not null or _said = 'n'")
    rows = changed.select("_row").distinct()
    by_row = tokens.select("_row", "id").distinct().join(rows, "_row", "left_semi").join(notes, "id").groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("id", F.struct("rank", "gender")))).alias("_notes"))
    by_row = staged(by_row, "notes-of-rows")
    again = _replaced(done.join(by_row, "_row").drop("surrogate_text", "entities", "_tokens"), text, key, F.col("_notes")).drop("_notes", "_tokens", "_row")
    rest = done.join(by_row, "_row", "left_anti").drop("_tokens", "_row")
    return rest.unionByName(staged(again, "surrogates-again").select(*rest.columns))


def surrogate_key(spark: SparkSession) -> str:
    """The secret in the session's ``KEY_SETTING``; where it is unset, a random one, which gives each run surrogates of its own."""
    return spark.conf.get(KEY_SETTING, None) or secrets.token_hex(32)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pseudonymise(load(spark, sf_dir, "documents").select("doc_id", "text"), key=surrogate_key(spark))
    return done.select("doc_id", F.col("surrogate_text").alias("text"), F.size("entities").cast("long").alias("n_entities"), "entities")
