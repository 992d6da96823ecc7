"""Surrogates for personal data, with DataFrame functions only.

Detected entities are replaced by keyed surrogates of the same type and form: digits by digits, letters by letters of the
same script and case, separators kept; a checksum residue, a mail domain's ending, an address's octet range and the gender
of a titled name are kept as well. An entity has one surrogate wherever and in whatever spelling it occurs, and a name's
parts are mapped part by part, so mentions still refer to the same person.

Distinctness is checked over the whole corpus: the table of distinct entities is grouped by surrogate, and all but one of
those that meet, or that meet a real entity, are keyed anew until none is left. A family name is settled once, for all who
bear it, and a given name among the bearers of its family name; a mail site once for all its addresses, and a mailbox
within its site. Each new keying of a name makes it longer, and later ones lengthen everything else but addresses of hosts,
so no number of entities ends a job. Texts are never shuffled for that. The few entities that had to be keyed anew are
joined back by a key of the text; all others are mapped in place.

The key is a setting of the session, ``spark.lodestone.surrogates.key``. Without it every call draws a key of its own that
nobody can look up, so that surrogates agree within a call only.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lodestone.llm.columns import text_key, text_of, unused
from lodestone.plans.scratch import Scratch

KEY = "spark.lodestone.surrogates.key"  # the setting with the secret; the same key gives the same surrogates
ATTEMPTS = 40        # keyings tried for an entity before its type counts as exhausted
SAME_LENGTH = 2      # keyings anew after which mailboxes, mail sites and phones grow by a sign each time
FIXED_LENGTH = 12    # the same for cards, ids and bank accounts, whose length is part of their form
ROWS = 2_000         # entities that one task settles

# Titles by gender and script, and the names given in their place.
TITLES = {"m": ("Mr", "Mister", "Sir", "Herr", "Señor", "Sr", "Monsieur", "Господин", "Κύριος"),
          "f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Señora", "Sra", "Madame", "Mme", "Госпожа", "Κυρία"),
          "?": ("Dr", "Doctor", "Prof", "Professor", "Доктор", "Профессор")}
NAMES = {
    ("latin", "m"): "Adrian Bruno Carl David Emil Felix Gabriel Hugo Ivan Jonas Leo Martin Oscar Paul Simon Victor".split(),
    ("latin", "f"): "Alma Bianca Clara Diana Elena Flora Greta Helena Irene Julia Laura Maria Nora Paula Sara Vera".split(),
    ("cyrillic", "m"): "Борис Виктор Глеб Денис Егор Кирилл Павел Роман".split(),
    ("cyrillic", "f"): "Алла Вера Дарья Ирина Лидия Нина Ольга Софья".split(),
    ("greek", "m"): "Άγγελος Γιώργος Λεωνίδας Μάρκος Νίκος Πέτρος".split(),
    ("greek", "f"): "Άννα Δήμητρα Ελένη Ζωή Μαρία Σοφία".split(),
}
SYLLABLES = {"latin": "ba den fal gor hel kim lan mor nes pol rin sten tal ver wik zan".split(),
             "cyrillic": "ба ден фал гор хел ким лан мор нес пол рин сте тал вер вик зан".split(),
             "greek": "βα δεν φαλ γορ λεν κιμ λαν μορ νεσ πολ ριν στε ταλ βερ βικ ζαν".split()}
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâäçèéêëíîïñóôöùúûü",
             "ÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ", "абвгдежзиклмнопрстуфхцчшэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ",
             "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ")
# Signs for letters and digits outside the alphabets, by the first class that has them; the last two have all others.
OTHERS = ((r"\p{IsHan}", "安白北长成大东方高光广海和华江金京来林明南平青清山石水天文西小新星阳永友雨元云中"),
          (r"\p{IsHiragana}", "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわ"),
          (r"\p{IsKatakana}", "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワ"),
          (r"\p{IsHangul}", "가나다라마바사아자차카타파하고노도로모보소오조초코토포호구누두루무부수우주추"),
          (r"[\p{IsArabic}&&\p{L}]", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"), (r"[\p{IsHebrew}&&\p{L}]", "אבגדהוזחטיכלמנסעפצקרשת"),
          (r"[\p{IsDevanagari}&&\p{L}]", "अआइईउऊकखगघचछजझटठडढतथदधनपफबभमयरलवशषसह"),
          (r"[\p{IsThai}&&\p{L}]", "กขคงจฉชซญดตถทธนบปผฝพฟภมยรลวสหอ"),
          (r"[\p{IsCyrillic}&&\p{Lu}]", ALPHABETS[6]), (r"[\p{IsCyrillic}&&\p{L}]", ALPHABETS[5]),
          (r"[\p{IsGreek}&&\p{Lu}]", ALPHABETS[8]), (r"[\p{IsGreek}&&\p{L}]", ALPHABETS[7]),
          (r"[\p{IsLatin}&&\p{Lu}]", ALPHABETS[4]), (r"[\p{IsLatin}&&\p{L}]", ALPHABETS[3]),
          (r"\p{N}", ALPHABETS[0]), (r"\p{L}", ALPHABETS[1]))

_TITLE = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_OWN_NETS = r"^(?:10|127|169\.254|192\.168|172\.(?:1[6-9]|2\d|3[01]))\."  # addresses that mean nothing outside a network
_OTHER_NETS = (23, 31, 45, 52, 64, 78, 89, 91, 104, 128, 142, 151, 163, 178, 185, 198, 203, 217)
_H = "[0-9A-Fa-f]{1,4}"
_PATTERNS = {  # the first that fits names the type
    "email": r"[\p{L}\p{N}][\p{L}\p{N}._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ip": rf"(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
    "ipv6": rf"(?=[0-9A-Fa-f:]*\d)(?:(?:{_H}:){{7}}{_H}|(?:{_H}:){{1,6}}(?::{_H}){{1,6}})(?![\p{{L}}\p{{N}}:])",
    "secret": r"(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![\p{L}\p{N}])",
    "token": r"(?:(?:sk|pk|rk)_(?:live|test)_[A-Za-z0-9]{10,}|A[KS]IA[0-9A-Z]{16}|gh[opsur]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}"
             r"|AIza[0-9A-Za-z_-]{30,})(?![\p{L}\p{N}])",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "phone": r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)"
             r"|\(\d{3}\) ?\d{3}-\d{4}(?!\d)|\d{3}[.-]\d{3}[.-]\d{4}(?!\d)|\d{3} \d{3} \d{4}(?! ?\d)"
             r"|00[1-9]\d{0,2}[ .-]\d{1,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|\(0[1-9]\d{0,3}\) ?\d{3,8}(?:[ -]\d{2,5})?(?!\d)"
             r"|0[1-9]\d{1,3}[ /]\d{3,8}(?:[ -]\d{2,5})?(?!\d)",
    "id": r"\d{3}-\d{2}-\d{4}(?!\d)",
    "card": r"\d{4}([ -]?)\d{4}[ -]?\d{4}[ -]?\d{1,7}(?![\p{L}\p{N}])",
    "name": rf"(?:{_TITLE})\.? \p{{Lu}}[\p{{L}}'’-]+(?: \p{{Lu}}[\p{{L}}'’-]+)?(?![\p{{L}}])",
}
KINDS = tuple(_PATTERNS)
_ENTITY = r"(?<![\p{L}\p{N}])(?:" + "|".join(p.replace("([ -]?)", "[ -]?") for p in _PATTERNS.values()) + ")"


# --- parts ------------------------------------------------------------------

def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once and named: without that its whole expression is repeated at every use."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _chars(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(
        text, i, F.lit(1)))).otherwise(F.array().cast("array<string>"))


def _byte(digest: Column, at: Column) -> Column:
    return F.conv(F.substring(digest, 1 + 2 * (at % 64), F.lit(2)), 16, 10).cast("int")


def _pick(values: str | list[str], byte: Column) -> Column:
    if isinstance(values, str):
        return F.substring(F.lit(values), 1 + byte % len(values), F.lit(1))
    return F.get(F.array(*[F.lit(v) for v in values]), byte % len(values))


def _like(char: Column, byte: Column, wide: bool) -> Column:
    """A character of the same kind: digit, or letter of the same script and case. A letter of a script without signs here
    becomes a Latin one; what is neither letter nor digit stays."""
    out = F.when(F.lit(False), char)
    for letters in ALPHABETS:
        out = out.when(F.instr(F.lit(letters), char) > 0, _pick(letters, byte))
    for sort, letters in OTHERS if wide else ():
        out = out.when(char.rlike(sort), _pick(letters, byte))
    return out.otherwise(char)


def _alike(text: Column, digest: Column, wide: bool = False) -> Column:
    """A text of the same form; a leading digit other than 0 stays other than 0. ``wide`` if it may have other than ASCII."""
    def replaced(t, d):
        signs = F.transform(_chars(t), lambda c, i: F.struct(c.alias("c"), _byte(d, i).alias("b")))
        return F.array_join(F.transform(signs, lambda x: _like(x["c"], x["b"], wide)), "")

    led = lambda t, out: F.when(t.rlike("^[1-9]") & out.startswith("0"), F.concat(
        F.lit("7"), F.substring(out, 2, 1 << 20))).otherwise(out)
    return _let(F.struct(text.alias("t"), digest.alias("d")), lambda x: _let(replaced(x["t"], x["d"]), lambda out: led(x["t"], out)))


def _luhn(digits: Column) -> Column:
    """The checksum residue of a string of digits."""
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    values = F.transform(_let(F.reverse(digits), _chars), lambda c, i: F.when(
        i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, b: a + b) % 10


def _mod97(account: Column) -> Column:
    """A bank account's number modulo 97, country and check digits last, letters as 10 to 35."""
    moved = F.concat(F.substring(account, 5, 64), F.substring(account, 1, 4))
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.coalesce(F.try_to_number(c, F.lit("9")).cast("int"), F.lit(0))) % 97).otherwise(
        (a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(_let(moved, _chars), F.lit(0), step)


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")


def _by_script(word: Column, make) -> Column:
    script = _script(word)
    return F.when(script == "cyrillic", make("cyrillic")).when(script == "greek", make("greek")).otherwise(make("latin"))


def kind_of(raw: Column) -> Column:
    out = F.when(raw.contains("@"), "email")
    for kind, pattern in list(_PATTERNS.items())[1:]:
        out = out.when(raw.rlike(f"^(?:{pattern})$"), kind)
    return out


def normal_of(kind: Column, raw: Column) -> Column:
    """What all spellings of an entity share. A name is its title's gender, ``m``, ``f`` or ``?``, and the bare name."""
    digits = F.regexp_replace(raw, "[^0-9]", "")
    title = F.regexp_extract(raw, rf"^({_TITLE})", 1)
    gender = F.when(title.isin(*TITLES["m"]), "m").when(title.isin(*TITLES["f"]), "f").otherwise("?")
    return (F.when(kind.isin("email", "secret"), F.lower(raw)).when(kind == "ip", raw)
            .when(kind == "iban", F.replace(raw, F.lit(" "), F.lit("")))
            .when(kind == "ipv6", F.lower(raw)).when(kind == "token", raw)
            .when(kind == "name", F.concat(gender, F.lit(":"), F.lower(F.regexp_replace(raw, rf"^(?:{_TITLE})\.? ", ""))))
            .when(kind == "phone", F.concat(F.regexp_extract(raw, r"^\+\d{1,3}", 0), F.lit(":"), F.regexp_replace(
                raw, r"^\+\d{1,3}|[^0-9]", "")))
            .otherwise(digits))


def _digest(key: str, attempt: Column, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *parts, attempt.cast("string")), 512)


def _syllables(script: str, digest: Column, n: Column) -> Column:
    return F.initcap(F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: _pick(SYLLABLES[script], _byte(digest, i))), ""))


def parts_of(normal: Column) -> tuple[Column, Column, Column]:
    """Gender, given name and family name of a name's normal form. A single name is a family name."""
    bare = F.substring(normal, 3, 1 << 20)
    return F.substring(normal, 1, 1), F.substring_index(bare, " ", 1), F.substring_index(bare, " ", -1)


def family_of(last: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a family name, a syllable longer with each attempt."""
    digest = _digest(key, attempt, F.lit("last"), last)
    return _by_script(last, lambda s: _syllables(s, digest, 4 + attempt))


def given_of(gender: Column, first: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a given name: one of the list, from the first new keying on with a second part that grows."""
    digest = _digest(key, attempt, F.lit("first"), gender, first)
    male = F.when(gender == "?", _byte(digest, F.lit(9)) % 2 == 0).otherwise(gender == "m")
    listed = lambda s: F.when(male, _pick(NAMES[s, "m"], _byte(digest, F.lit(0)))).otherwise(
        _pick(NAMES[s, "f"], _byte(digest, F.lit(0))))
    return _by_script(first, lambda s: F.when(attempt > 0, F.concat(listed(s), F.lit("-"), _syllables(
        s, F.sha2(digest, 512), 1 + attempt))).otherwise(listed(s)))


def site_of(domain: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a mail site: its ending stays."""
    ending = F.substring_index(domain, ".", -1)
    site = F.substring(domain, F.lit(1), F.length(domain) - F.length(ending) - 1)
    grown = F.concat(site, F.repeat(F.lit("a"), F.greatest(attempt - SAME_LENGTH, F.lit(0))))
    return F.concat(_alike(grown, _digest(key, attempt, F.lit("site"), domain)), F.lit("."), ending)


def mailbox_of(normal: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a mail address's local part."""
    grown = F.concat(F.substring_index(normal, "@", 1), F.repeat(F.lit("a"), F.greatest(attempt - SAME_LENGTH, F.lit(0))))
    return _alike(grown, _digest(key, attempt, F.lit("email"), normal), wide=True)


def surrogate_of(kind: Column, normal: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a normal form, itself a normal form."""
    return _let(_digest(key, attempt, kind, normal), lambda own: _surrogate(kind, normal, attempt, key, own))


def _surrogate(kind: Column, normal: Column, attempt: Column, key: str, own: Column) -> Column:
    more = F.greatest(attempt - SAME_LENGTH, F.lit(0))
    later = F.repeat(F.lit("0"), F.greatest(attempt - FIXED_LENGTH, F.lit(0)))
    email = F.concat(mailbox_of(normal, attempt, key), F.lit("@"), site_of(F.substring_index(normal, "@", -1), F.lit(0), key))
    nets = F.array(*[F.lit(str(n)) for n in _OTHER_NETS])
    kept = F.size(F.split(F.regexp_extract(normal, _OWN_NETS, 0), r"\.")) - 1  # octets that say it is a network's own
    octets = F.transform(F.split(normal, r"\."), lambda o, i: F.when(i < kept, o).when((i == 0), F.get(
        nets, _byte(own, i) % len(_OTHER_NETS))).otherwise((1 + _byte(own, i) % 254).cast("string")))
    hexes = F.array_join(F.transform(_chars(normal), lambda c, i: F.when(
        c == ":", c).otherwise(_pick("123456789abcdef", _byte(own, i)))), "")
    ipv6 = F.when(normal.rlike("^(?:f[cd]|fe[89ab]|2001:0?db8:)"), F.concat(
        F.substring_index(normal, ":", 1), F.substring(hexes, F.length(F.substring_index(normal, ":", 1)) + 1, F.lit(64)))).otherwise(hexes)
    head = F.regexp_extract(normal, "^(?:[sprk]{2}_(?:live|test)_|A[KS]IA|gh[opsur]_|xox[abprs]-|AIza)", 0)
    token = F.concat(head, _alike(F.substring(normal, F.length(head) + 1, F.lit(1 << 20)), own))
    digits = _alike(F.concat(normal, later), own)
    residue = lambda d: (F.substring(d, -1, 1).cast("int") + _luhn(normal) - _luhn(d) + 10) % 10
    card = _let(digits, lambda d: F.concat(F.substring(d, F.lit(1), F.length(d) - 1), residue(d).cast("string")))
    country = F.substring(normal, 1, 2)
    sums = lambda account: F.lpad(
        (98 - _mod97(F.concat(country, F.lit("00"), account))).cast("string"), 2, "0")  # a valid number stays valid
    iban = _let(_alike(F.concat(F.substring(normal, 5, 64), later), F.sha2(own, 512)), lambda account: F.concat(
        country, F.when(_mod97(normal) == 1, sums(account)).otherwise(_alike(F.substring(normal, 3, 2), own)), account))
    gender, first, last = parts_of(normal)
    family = family_of(last, attempt, key)
    name = F.concat(gender, F.lit(":"), F.when(normal.contains(" "), F.concat(
        given_of(gender, first, attempt, key), F.lit(" "), family)).otherwise(family))
    code = F.substring_index(normal, ":", 1)
    number = F.substring_index(normal, ":", -1)
    zeros = F.regexp_extract(number, "^0*", 0)
    phone = F.concat(code, F.lit(":"), zeros, _alike(F.concat(F.substring(number, F.length(zeros) + 1, F.lit(64)), F.repeat(F.lit("0"), more)), own))
    return (F.when(kind == "email", email).when(kind == "ipv6", ipv6).when(kind == "token", token).when(kind == "ip", F.array_join(octets, ".")).when(kind == "card", card)
            .when(kind == "secret", F.substring(F.repeat(own, F.ceil(F.length(normal) / 128).cast("int")), F.lit(1), F.length(normal))).when(kind == "phone", phone)
            .when(kind == "iban", iban).when(kind == "name", name).otherwise(digits))


def render(kind: Column, raw: Column, normal: Column) -> Column:
    """A surrogate's normal form in the spelling of the entity that it replaces."""
    before = lambda i, keep: F.length(F.regexp_replace(F.substring(raw, F.lit(1), i), f"[^{keep}]", ""))
    signs = F.when(kind == "phone", F.regexp_replace(normal, "[^0-9]", "")).otherwise(normal)
    filled = lambda keep: F.array_join(F.transform(_chars(raw), lambda c, i: F.when(
        c.rlike(f"[{keep}]"), F.substring(signs, before(i, keep) + 1, F.lit(1))).otherwise(c)), "")
    # a mail's local part may have grown: signs added before the at sign stay small, those after it follow the entity again
    head, more = F.instr(raw, "@") - 1, F.length(normal) - F.length(raw)
    model = lambda i: F.when(i < head, F.substring(raw, i + 1, F.lit(1))).when(i < head + more, "").otherwise(
        F.substring(raw, i + 1 - more, F.lit(1)))
    cased = F.array_join(F.transform(_chars(normal), lambda c, i: F.when(model(i) != F.lower(model(i)), F.upper(c)).otherwise(c)), "")
    grown = lambda keep: F.concat(filled(keep), F.substring(signs, 1 + F.length(F.regexp_replace(raw, f"[^{keep}]", "")), F.lit(1 << 20)))
    bare = F.regexp_replace(raw, rf"^(?:{_TITLE})\.? ", "")
    named = F.when((bare == F.upper(bare)) & (F.length(bare) > 1), F.upper(F.substring(normal, 3, 1 << 20))).otherwise(F.substring(normal, 3, 1 << 20))
    capital = (raw == F.upper(raw)) & (raw != F.lower(raw))
    title = F.regexp_extract(raw, rf"^((?:{_TITLE})\.? )", 1)
    return (F.when(kind.isin("email", "secret", "ipv6"), F.when(raw == F.lower(raw), normal).when(capital, F.upper(normal)).otherwise(cased)).when(kind.isin("ip", "token"), normal)
            .when(kind == "iban", grown("A-Z0-9")).when(kind == "name", F.concat(title, named)).otherwise(grown("0-9")))


# --- whole tables -----------------------------------------------------------

def _found(text: Column) -> Column:
    """``raw, kind, normal`` of the entities of a text, in order."""
    titled = reduce(lambda a, b: a | b, [text.contains(t) for ts in TITLES.values() for t in ts])
    # every pattern needs a digit, an at sign, a title, a token's sign or a secret's 32 hex digits, which may all be letters
    raw = F.when(text.rlike("[0-9@]|[a-f]{32}|[A-F]{32}|[A-Z]{20}|AIza|xox|gh[opsur]_|_live_|_test_") | titled, F.regexp_extract_all(text, F.lit(f"({_ENTITY})"), 1)).otherwise(
        F.array().cast("array<string>"))
    kinds = F.transform(raw, lambda r: F.struct(r.alias("raw"), kind_of(r).alias("kind")))
    return F.transform(kinds, lambda e: F.struct(e["raw"].alias("raw"), e["kind"].alias("kind"),
                                                 normal_of(e["kind"], e["raw"]).alias("normal")))


def rekeyed(entities: DataFrame, key: str, scratch: Scratch, attempts: int = ATTEMPTS) -> DataFrame:
    """``kind, normal, surrogate`` of those distinct entities whose first surrogate would meet another or a real one.

    Names are settled in parts: as kind ``family`` the family names, as kind ``given`` names with a given one, which must
    only differ from others of the same family name. Mail addresses too: as kind ``site`` their sites, as kind ``mailbox``
    addresses, which must only differ from others of the same site. No family name's or site's surrogate is a real one, so
    no whole name or address is.
    """
    normal, names, mails = F.col("normal"), entities.filter("kind = 'name'"), entities.filter("kind = 'email'")
    gender, first, last = parts_of(normal)
    domain = F.substring_index(normal, "@", -1)
    settled = (entities.filter("kind not in ('name', 'email')").select("kind", "normal")
               .unionByName(names.select(F.lit("family").alias("kind"), last.alias("normal")).distinct())
               .unionByName(names.filter(normal.contains(" ")).select(F.lit("given").alias("kind"), "normal"))
               .unionByName(mails.select(F.lit("site").alias("kind"), domain.alias("normal")).distinct())
               .unionByName(mails.select(F.lit("mailbox").alias("kind"), "normal")))
    settled = scratch.write(settled, "settled")
    parts = max(1, min(settled.count() // ROWS, 8 * settled.sparkSession.sparkContext.defaultParallelism))
    # rows are few bytes and much work: by their number, not by their size
    spread = lambda df: df.repartition(parts) if parts > 1 else df
    give = lambda df: spread(df).withColumn("surrogate", F.when(F.col("kind") == "family", family_of(
        normal, F.col("attempt"), key)).when(F.col("kind") == "given", given_of(gender, first, F.col("attempt"), key)).when(
        F.col("kind") == "site", site_of(normal, F.col("attempt"), key)).when(
        F.col("kind") == "mailbox", mailbox_of(normal, F.col("attempt"), key)).otherwise(
        surrogate_of(F.col("kind"), normal, F.col("attempt"), key)))
    table = scratch.write(give(settled.select("kind", "normal", F.lit(0).alias("attempt"))), "attempt-0")
    real = table.filter("kind not in ('given', 'mailbox')").select("kind", F.when(
        F.col("kind") == "family", F.lower(normal)).otherwise(normal).alias("shown"))
    for turn in range(1, attempts + 1):
        shown = table.withColumn("shown", F.when(F.col("kind") == "given", F.concat("surrogate", F.lit(" "), last)).when(
            F.col("kind") == "mailbox", F.concat("surrogate", F.lit("@"), domain)).when(
            F.col("kind") == "family", F.lower("surrogate")).otherwise(F.col("surrogate")))
        # an entity that keeps its attempt goes before one that was moved, then the smaller before the larger
        keeper = shown.groupBy("kind", "shown").agg(F.min(F.struct("attempt", "normal")).alias("keeper"), F.count("*").alias("n"))
        shared = (shown.join(keeper.filter("n > 1"), ["kind", "shown"])
                  .filter(F.col("keeper") != F.struct("attempt", "normal")))
        taken = shown.join(real, ["kind", "shown"], "left_semi")
        moved = scratch.write(shared.select("kind", "normal").unionByName(taken.select("kind", "normal")).distinct(), f"moved-{turn}")
        if moved.isEmpty():
            moved = table.filter("attempt > 0").select("kind", "normal", "surrogate")
            of = lambda kind, name: moved.filter(F.col("kind") == kind).select(F.col("normal").alias(name), F.col("surrogate").alias(kind))
            whole = (names.select("kind", "normal", last.alias("_last")).join(of("family", "_last"), "_last", "left")
                     .join(of("given", "normal"), "normal", "left").filter("family is not null or given is not null"))
            family = F.coalesce("family", family_of(F.col("_last"), F.lit(0), key))
            given = F.coalesce("given", given_of(gender, first, F.lit(0), key))
            posted = (mails.select("kind", "normal", domain.alias("_site")).join(of("site", "_site"), "_site", "left")
                      .join(of("mailbox", "normal"), "normal", "left").filter("site is not null or mailbox is not null"))
            address = F.concat(F.coalesce("mailbox", mailbox_of(normal, F.lit(0), key)), F.lit("@"),
                               F.coalesce("site", site_of(F.col("_site"), F.lit(0), key)))
            return (moved.filter("kind not in ('family', 'given', 'site', 'mailbox')").unionByName(whole.select("kind", "normal", F.concat(
                gender, F.lit(":"), F.when(normal.contains(" "), F.concat(given, F.lit(" "), family)).otherwise(family)).alias("surrogate")))
                .unionByName(posted.select("kind", "normal", address.alias("surrogate"))))
        stay = table.join(moved, ["kind", "normal"], "left_anti")
        again = table.join(moved, ["kind", "normal"], "left_semi").withColumn("attempt", F.lit(turn)).drop("surrogate")
        table = scratch.write(stay.unionByName(give(again)), f"attempt-{turn}")
    raise ValueError(f"no distinct surrogates left after {attempts} keyings")


def with_surrogates(docs: DataFrame, text: str = "text", key: str | None = None) -> DataFrame:
    """``docs`` with surrogates in ``text`` and the replaced entities in ``pii``, a list of ``raw, kind, surrogate``.

    All rows and other columns stay; a column ``pii`` is replaced. A null or empty text has no entities and stays. A name
    is detected by its title, and its parts map alike whether they come together or the last alone: all bearers of a family
    name keep one in common. Repeated rows get the same surrogates, as do reruns with the key (by default that of the
    setting ``KEY``). Long texts are searched whole; an empty table stays empty.
    """
    spark = docs.sparkSession
    key = key or spark.conf.get(KEY, None) or secrets.token_hex(32)
    scratch = Scratch(spark, "pii")
    found, special_of, pieces_of, key_of = unused(docs.drop("pii"), "_found", "_special", "_pieces", "_k")
    entity = F.col(found)
    entities = scratch.write(
        docs.select(F.explode(_found(text_of(text))).alias("e")).select("e.kind", "e.normal").distinct(), "entities")
    special = scratch.write(rekeyed(entities, key, scratch), "rekeyed")
    keyed = docs.withColumn(found, _found(text_of(text)))
    if special.isEmpty():
        keyed = keyed.withColumn(special_of, F.lit(None).cast("map<string,string>"))
    else:
        own = (docs.select(text_key(text_of(text)).alias("k"), F.explode(_found(text_of(text))).alias("e"))
               .select("k.a", "k.b", "e.kind", "e.normal").distinct().join(special, ["kind", "normal"])
               .groupBy(F.struct("a", "b").alias(key_of)).agg(F.map_from_entries(F.collect_list(F.struct(
                   F.concat_ws("|", "kind", "normal"), "surrogate"))).alias(special_of)))
        keyed = keyed.withColumn(key_of, text_key(text_of(text))).join(scratch.write(own, "special"), key_of, "left").drop(key_of)
    known = F.transform(entity, lambda e: F.struct(e["raw"].alias("raw"), e["kind"].alias("kind"), F.coalesce(
        F.try_element_at(special_of, F.concat_ws("|", e["kind"], e["normal"])),
        surrogate_of(e["kind"], e["normal"], F.lit(0), key)).alias("normal")))
    shown = F.transform(known, lambda e: F.struct(e["raw"].alias("raw"), e["kind"].alias("kind"),
                                                  render(e["kind"], e["raw"], e["normal"]).alias("surrogate")))
    pieces = F.split(F.col(text), _ENTITY)
    woven = F.array_join(F.transform(F.col(pieces_of), lambda p, i: F.concat(
        p, F.coalesce(F.get(F.col("pii"), i)["surrogate"], F.lit("")))), "")
    return (keyed.withColumn("pii", F.when(F.size(found) > 0, shown).otherwise(
                F.array().cast("array<struct<raw:string,kind:string,surrogate:string>>")))
            .withColumn(pieces_of, F.when(F.size(found) > 0, pieces))
            .withColumn(text, F.when(F.col(pieces_of).isNull(), F.col(text)).otherwise(woven)).select(*[c for c in docs.columns if c != "pii"], "pii"))


def counts(pii: Column) -> list[Column]:
    """Number of replaced entities of each type."""
    count = lambda kind: F.size(F.filter(pii, lambda e: e["kind"] == kind)).cast("long")
    return [count(kind).alias(f"n_{kind}") for kind in KINDS]
