"""Personal data replaced by keyed surrogates of the same type.

Everything is DataFrame expressions; no Python runs on rows.

Entities are e-mail addresses, telephone numbers, card numbers, IPv4 and IPv6 addresses and persons
named after titles: all their names, initials and particles, and their family names alone
elsewhere in the same text.  An entity's canonical form (digits only, lower case) and a secret key
give its surrogate by SHA-256, so every mention of it, in any document and any spelling,
gets the same one, written in the mention's own format: separators, capitals, country
codes, issuer digits, valid and invalid check digits, top-level domains, the script of
letters and the gender of a title are kept.

Collision checks: all distinct entities of the corpus get their first surrogate; those whose
surrogate is another entity's, or occurs as an entity itself, draw again until all are
distinct.  Domains and family names are parts of many entities and are made distinct first,
in the same way.  Surrogates get longer with the draws, so that forms with few members do
not run out.  Only redrawn entities are looked up when texts are rewritten.

Scale: documents without entities are scanned and passed on, never shuffled.  Documents with
entities are stored once with their mentions; only mentions and distinct entities are
shuffled, pre-aggregated, so a frequent entity is one row.

Defined results for odd input: a NULL text stays NULL, an empty one empty; repeated documents
are rewritten alike, whatever their ids; an empty table gives an empty result; extra columns
are kept whatever their names.  Texts and entities of any length are read whole; the matcher
takes no stack for repetitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from soundrows.llm.frames import Renamed
from soundrows.llm.quality import let
from soundrows.session import stored

# Groups that may repeat without a bound are possessive: the matcher of the JVM recurses once
# for each repetition that it may have to give back, and a long text would exhaust its stack.
# A domain of ASCII letters ends where another script follows without a blank.
EMAIL = (
    r"(?<![\p{L}\p{M}\p{N}._%+-])[\p{L}\p{M}\p{N}._%+-]++@"
    r"(?:[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++(?![\p{IsLatin}\p{M}])"
    r"|[\p{L}\p{M}\p{N}-]++(?:\.[\p{L}\p{M}\p{N}-]++)++)"
)
PHONE = (
    r"(?<![\w+])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,5}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,5}(?!\w)"
    r"|(?<![\w+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,5}){2,5}(?!\w)"
    r"|(?<![\w.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![\w-])"
    r"|(?=[2-9])(?<![\w.+-])(?<![0-9] )[2-9][0-9]{2} [0-9]{3}[ -][0-9]{4}(?![\w-]| [0-9])"
    # National numbers with their zero: 9 to 12 digits, no dates.
    r"|(?=0)(?<![\w.+/-])(?=0(?:[ /-]?[0-9]){8,11}(?![\w-]))(?![0-9]{2}[/-][0-9]{2}[/-][0-9]{4}(?![0-9]))"
    r"0[0-9]{1,4}(?:[ /-][0-9]{2,8}){1,4}(?![\w-])"
)
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IP = rf"(?<![\w.])(?:{OCTET}\.){{3}}{OCTET}(?!\w|\.[0-9])"
HEX = "[0-9A-Fa-f]{1,4}"
IPV6 = (
    r"(?=[0-9A-Fa-f]{0,4}:)(?<![\w:.])(?=[A-Fa-f:]*[0-9])"
    rf"(?:(?:{HEX}:){{7}}{HEX}"
    r"|(?=[0-9A-Fa-f:]*::)(?![0-9A-Fa-f:]*::[0-9A-Fa-f:]*::)(?![0-9A-Fa-f:]*:::)"
    rf"(?:{HEX}(?::{HEX})*+::(?:{HEX}(?::{HEX})*+)?|::{HEX}(?::{HEX})*+))(?![\w:]|\.[0-9])"
)
# In one run, or grouped 4-4-4-4, 4-4-4-4-3, and 4-6-5 or 4-6-4 with a first 3.
CARD_NUMBER = (
    r"(?:[0-9]{13,19}|[0-9]{4}([ -])(?:[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?:\1[0-9]{3})?"
    r"|(?<=3[0-9]{3}[ -])[0-9]{6}\1[0-9]{4,5}))"
)
CARD = rf"(?<![\w.-]){CARD_NUMBER}(?![\w-])"
#: Titles that tell a gender, and those that do not.
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Sir", "Господин", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία")
NEUTRAL = ("Dr", "Prof")
SPELLINGS = {t for title in (*MALE, *FEMALE, *NEUTRAL) for t in (title, title.upper())}
TITLES = "|".join(sorted(SPELLINGS, key=lambda t: (-len(t), t)))
#: Titles in a chain ("Prof. Dr. med."), with what follows them in small letters.
TITLED = rf"(?:(?:{TITLES})\.?(?:-Ing\.)? (?:(?:med|phil|rer|nat|jur|pol|oec|theol|habil|h\. ?c)\.? )*+)++"
PARTICLES = "von|van|der|den|dem|de|del|della|di|da|do|dos|das|la|le|du|ten|ter|zu|zur|zum|af|av|bin|ibn|al|el|y|e"
NO_NAME = rf"(?!(?:{TITLES}|Jr|II|III|IV)(?![\p{{L}}\p{{M}}]))"
WORD = rf"{NO_NAME}\p{{Lu}}(?:[\p{{L}}\p{{M}}]++|['’-](?!s(?!\p{{L}}))\p{{L}})++"
INITIAL = r"\p{Lu}\.?(?:-?\p{Lu}\.)*+"
#: A name with the initials and particles before it.
NAMED = rf"(?:(?:{INITIAL}|{PARTICLES}) )*+{WORD}"
# Titles alone match, too, and stay as they are: a chain of titles is looked at once.
PERSON = rf"(?<![\p{{L}}\p{{N}}]){TITLED}(?:{NAMED}(?: {NAMED})*+)?+"
# The only group is the card's separator; it comes first so that \1 is right.
ENTITY = "|".join((CARD, EMAIL, IP, IPV6, PHONE, PERSON))
#: A text without any of this has no entity; most texts are done with this one quick look.
FIRST_LETTERS = "".join(sorted({title[0] for title in SPELLINGS}))
TRACE = rf"[@0-9]|(?=[{FIRST_LETTERS}])(?:{TITLES})"

NO_ENTITY = "none"
TYPES = ("email", "phone", "card", "ip", "person")
DIGITS = "0123456789"
#: Alphabets by script: letters, consonants, vowels, endings of female, male and other names.
SCRIPTS = {
    "latin": ("abcdefghijklmnopqrstuvwxyz", "bdfgklmnprstvz", "aeiou", ("a", "o", "e")),
    "cyrillic": ("абвгдежзиклмнопрстуфхцчшэюя", "бвгдзклмнпрст", "аеиоу", ("а", "ан", "и")),
    "greek": ("αβγδεζηθικλμνξοπρστυφχψω", "βγδκλμνπρστφ", "αεηιο", ("α", "ος", "η")),
}
#: After so many draws a surrogate gets longer by one character or syllable: forms with few
#: members run out otherwise.  IPv4 addresses cannot; after so many draws they become IPv6.
LONGER_AFTER = 4
OTHER_IP_AFTER = 32
#: What a telephone number keeps: the country's digits, or the zeros of a national number.
KEPT_DIGITS = (
    r"^(?:\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{1,3})|0+)"
)


def type_of(mention: Column) -> Column:
    return (
        F.when(mention.contains("@"), "email")
        .when(without_title(mention) == "", NO_ENTITY)
        .when(~mention.rlike("[0-9]"), "person")
        .when(mention.contains(":") | mention.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"), "ip")
        .when(mention.rlike(rf"^{CARD_NUMBER}$"), "card")
        .otherwise("phone")
    )


def without_title(mention: Column) -> Column:
    return F.regexp_replace(mention, f"^{TITLED}", "")


def title_of(mention: Column) -> Column:
    return mention.substr(F.lit(1), F.length(mention) - F.length(without_title(mention)))


def gender_of(mention: Column) -> Column:
    """The gender that any title of the chain tells."""
    titles = F.split(F.lower(title_of(mention)), "[ .]+")
    told = lambda some: F.arrays_overlap(titles, F.array(*[F.lit(t.lower()) for t in some]))
    return F.when(told(FEMALE), "f").when(told(MALE), "m").otherwise("n")


def full_ipv6(address: Column) -> Column:
    """All eight groups of four hex digits."""

    def groups(part: Column) -> Column:
        some = F.filter(F.split(part, ":"), lambda g: g != "")
        return F.transform(some, lambda g: F.lpad(g, 4, "0"))

    left = groups(F.substring_index(address, "::", 1))
    right = F.when(address.contains("::"), groups(F.substring_index(address, "::", -1))).otherwise(groups(F.lit("")))
    missing = F.array_repeat(F.lit("0000"), F.greatest(F.lit(0), 8 - F.size(left) - F.size(right)))
    return F.array_join(F.concat(left, missing, right), ":")


def canonical(kind: Column, mention: Column) -> Column:
    """What all spellings of an entity share.  A person's gender belongs to it."""
    return (
        F.when(kind == "card", F.regexp_replace(mention, "[^0-9]", ""))
        .when(kind == "phone", F.regexp_replace(mention, r"[^0-9+]", ""))
        .when(kind == "person", F.concat(gender_of(mention), F.lit(":"), F.lower(without_title(mention))))
        .when((kind == "ip") & mention.contains(":"), full_ipv6(F.lower(mention)))
        .otherwise(F.lower(mention))
    )


def stream(key: str, kind: Column, value: Column, draw: Column, length: Column) -> Column:
    """Keyed pseudo-random numbers below 256, at least ``length`` of them, as an array."""

    seed = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, value, draw.cast("string")).cast("binary"), 256)

    def block(seed: Column, j: Column) -> Column:
        return F.sha2(F.concat_ws("\x1f", seed, j.cast("string")).cast("binary"), 256)

    def numbers(digits: Column) -> Column:
        pair = lambda k: F.conv(digits.substr(2 * k + 1, F.lit(2)), 16, 10).cast("int")
        return F.transform(F.sequence(F.lit(0), F.lit(31)), pair)

    places = F.sequence(F.lit(0), F.floor(length / 32).cast("int"))
    return let(seed, lambda s: F.flatten(F.transform(places, lambda j: numbers(block(s, j)))))


def number(numbers: Column, place: Column) -> Column:
    """The number at a place (from 0)."""
    return F.get(numbers, place)


def pick(alphabet: str, n: Column) -> Column:
    return F.lit(alphabet).substr(n % len(alphabet) + 1, F.lit(1))


def styled(char: Column, n: Column) -> Column:
    """Another character of the same kind and script; separators stay."""
    out = F.when(char.rlike("^[0-9]$"), pick(DIGITS, n))
    for script, pattern in (("cyrillic", r"^\p{IsCyrillic}$"), ("greek", r"^\p{IsGreek}$"), ("latin", r"^\p{L}$")):
        letter = pick(SCRIPTS[script][0], n)
        out = out.when(char.rlike(pattern), F.when(char == F.lower(char), letter).otherwise(F.upper(letter)))
    return out.otherwise(char)


def restyled(text: Column, numbers: Column) -> Column:
    chars = F.split(text, "")
    return F.array_join(F.transform(chars, lambda c, i: styled(c, number(numbers, i))), "")


def check_sum(digits: Column) -> Column:
    """Luhn sum of digits that are followed by a check digit."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.struct(c.alias("c"), i.alias("i")))

    def weight(x: Column) -> Column:
        d = F.coalesce(x["c"].try_cast("int"), F.lit(0))
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(x["i"] % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.transform(values, weight), F.lit(0), lambda a, b: a + b)


def body(digits: Column) -> Column:
    return digits.substr(F.lit(1), F.length(digits) - 1)


def check_gap(digits: Column) -> Column:
    """How far the last digit is from a right check digit."""
    last = digits.substr(F.length(digits), F.lit(1)).cast("int")
    return (check_sum(body(digits)) + last) % 10


def longer(text: Column, mark: str, draw: Column) -> Column:
    """The text with so many more marks as the draw asks for."""
    return F.concat(text, F.repeat(F.lit(mark), F.floor(draw / LONGER_AFTER).cast("int")))


def card_surrogate(digits: Column, draw: Column, numbers: Column) -> Column:
    """The issuer digit stays; right check digits stay right and wrong ones wrong."""
    inner = longer(body(digits).substr(F.lit(2), F.length(digits)), "0", draw)
    new = F.concat(digits.substr(F.lit(1), F.lit(1)), restyled(inner, numbers))
    return let(
        new, lambda n: F.concat(n, ((check_gap(digits) + 10 - check_sum(n) % 10) % 10).cast("string"))
    )


def phone_surrogate(number: Column, draw: Column, numbers: Column) -> Column:
    """The country stays, so that the checked value is the one that is written."""
    kept = F.regexp_extract(number, KEPT_DIGITS, 0)
    national = longer(number.substr(F.length(kept) + 1, F.length(number)), "0", draw)
    return F.concat(kept, restyled(national, numbers))


def domain_surrogate(domain: Column, draw: Column, numbers: Column) -> Column:
    """The top level stays."""
    top = F.substring_index(domain, ".", -1)
    name = domain.substr(F.lit(1), F.length(domain) - F.length(top) - 1)
    return F.concat(restyled(longer(name, "a", draw), numbers), F.lit("."), top)


def email_surrogate(address: Column, key: str, draw: Column, part: Column, numbers: Column) -> Column:
    """The local part by the address, the domain by itself."""
    local = F.substring_index(address, "@", 1)
    domain = part_surrogate(key, "domain", F.substring_index(address, "@", -1), part)
    return F.concat(restyled(longer(local, "a", draw), numbers), F.lit("@"), domain)


def ip_surrogate(numbers: Column) -> Column:
    octets = F.transform(
        F.sequence(F.lit(0), F.lit(3)),
        lambda i: F.when(i == 0, number(numbers, i) % 223 + 1).otherwise(number(numbers, i)).cast("string"),
    )
    return F.array_join(octets, ".")


def ipv6_surrogate(numbers: Column) -> Column:
    """A global address, with all groups."""
    byte = lambda i: F.lpad(F.lower(F.hex(number(numbers, i))), 2, "0")
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.concat(byte(2 * i), byte(2 * i + 1)))
    return F.overlay(F.array_join(groups, ":"), F.lit("2"), 1)


def name_like(token: Column, numbers: Column, syllables: Column, ending: Column | None) -> Column:
    """A name of the token's script, from syllables; ``ending`` tells the gender."""

    def of(script: str) -> Column:
        _, consonants, vowels, endings = SCRIPTS[script]
        parts = F.transform(
            F.sequence(F.lit(0), syllables - 1),
            lambda i: F.concat(pick(consonants, number(numbers, 2 * i)), pick(vowels, number(numbers, 2 * i + 1))),
        )
        name = F.array_join(parts, "")
        if ending is not None:
            last = F.when(ending == "f", endings[0]).when(ending == "m", endings[1]).otherwise(endings[2])
            name = F.concat(name, pick(consonants, number(numbers, 2 * syllables)), last)
        return name

    return (
        F.when(token.rlike(r"\p{IsCyrillic}"), of("cyrillic"))
        .when(token.rlike(r"\p{IsGreek}"), of("greek"))
        .otherwise(of("latin"))
    )


def more(draw: Column) -> Column:
    """Syllables beyond the usual ones."""
    return F.floor(draw / LONGER_AFTER).cast("int")


def part_surrogate(key: str, kind: str, value: Column, draw: Column) -> Column:
    """The surrogate of a domain or a family name, wherever it is a part."""
    hashed = stream(key, F.lit(kind), value, draw, F.length(value) + 2 * more(draw) + 32)
    if kind == "domain":
        return let(hashed, lambda h: domain_surrogate(value, draw, h))
    return let(hashed, lambda h: name_like(value, h, more(draw) + 4, None))


def person_surrogate(value: Column, key: str, draw: Column, part: Column) -> Column:
    """Every name by itself, so that a family name alone gets the same; particles stay."""
    gender, name = F.substring_index(value, ":", 1), F.substring_index(value, ":", -1)
    new_family = part_surrogate(key, "family", F.substring_index(name, " ", -1), part)

    def before(token: Column) -> Column:
        by_token = stream(key, F.concat(F.lit("given"), gender), token, draw, 2 * more(draw) + 32)
        initial = token.rlike(r"^\p{L}(?:[.-]|$)") & (more(draw) == 0)
        fresh = let(
            by_token,
            lambda h: F.when(initial, restyled(token, h)).otherwise(name_like(token, h, more(draw) + 2, gender)),
        )
        return F.when(token.rlike(rf"^(?:{PARTICLES})$"), token).otherwise(fresh)

    tokens = F.split(name, " ")
    others = F.transform(F.slice(tokens, F.lit(1), F.size(tokens) - 1), before)
    return F.concat(gender, F.lit(":"), F.array_join(F.concat(others, F.array(new_family)), " "))


def surrogate(key: str, kind: Column, value: Column, draw: Column, part: Column) -> Column:
    """The canonical surrogate of a canonical entity; ``part`` is the draw of its part."""
    return let(
        stream(key, kind, value, draw, F.length(value) + more(draw)),
        lambda h: F.when(kind == "email", email_surrogate(value, key, draw, part, h))
        .when((kind == "ip") & (value.contains(":") | (draw >= OTHER_IP_AFTER)), ipv6_surrogate(h))
        .when(kind == "ip", ip_surrogate(h))
        .when(kind == "card", card_surrogate(value, draw, h))
        .when(kind == "person", person_surrogate(value, key, draw, part))
        .otherwise(phone_surrogate(value, draw, h)),
    )


def surrogate_of_part(key: str, kind: Column, value: Column, draw: Column) -> Column:
    return F.when(kind == "domain", part_surrogate(key, "domain", value, draw)).otherwise(
        part_surrogate(key, "family", value, draw)
    )


def filled(mention: Column, digits: Column) -> Column:
    """The mention with its digits replaced in turn; digits that are left over follow."""
    chars = F.split(mention, "")
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"))

    def step(state: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        n = state["n"] + F.when(digit, 1).otherwise(0)
        return F.struct(
            F.concat(state["text"], F.when(digit, digits.substr(n, F.lit(1))).otherwise(c)).alias("text"),
            n.alias("n"),
        )

    return F.aggregate(
        chars, start, step, lambda state: F.concat(state["text"], digits.substr(state["n"] + 1, F.length(digits)))
    )


def cased(mention: Column, text: Column) -> Column:
    """The text with capitals where the mention has them; what is longer stays small."""
    return F.array_join(
        F.zip_with(
            F.split(mention, ""), F.split(text, ""),
            lambda m, t: F.when((m != F.lower(m)), F.upper(t)).otherwise(t),
        ),
        "",
    )


def named(mention: Column, name: Column) -> Column:
    """The title, and the names with the mention's capitals; a family name alone is the last."""
    old = F.split(without_title(mention), " ")
    new = F.split(name, " ")
    new = F.slice(new, F.size(new) - F.size(old) + 1, F.size(old))

    def like(m: Column, t: Column) -> Column:
        return F.when(m.rlike(r"^\P{Ll}+$"), F.upper(t)).when(m == F.lower(m), t).otherwise(F.initcap(t))

    return F.concat(title_of(mention), F.array_join(F.zip_with(old, new, like), " "))


def written(kind: Column, mention: Column, new: Column) -> Column:
    """A canonical surrogate in the format of a mention."""
    return (
        F.when(kind == NO_ENTITY, mention).when(kind == "email", F.concat(*[
            cased(F.substring_index(mention, "@", side), F.substring_index(new, "@", side)) if side else F.lit("@")
            for side in (1, 0, -1)
        ]))
        .when(kind == "ip", new)
        .when(kind == "person", named(mention, F.substring_index(new, ":", -1)))
        .otherwise(filled(mention, F.replace(new, F.lit("+"), F.lit(""))))
    )


def wrapped(pattern: Column | str):
    """The pattern as one group; the card's separator becomes the second one."""
    if isinstance(pattern, str):
        return f"({pattern})".replace("\\1", "\\2")
    return F.concat(F.lit(wrapped(ENTITY)[:-1]), pattern, F.lit(")"))


def mentions(text: Column) -> Column:
    """All mentions of a text in order: array of (type, text, canonical form)."""

    def one(m: Column) -> Column:
        return let(
            type_of(m),
            lambda kind: F.struct(kind.alias("type"), m.alias("text"), canonical(kind, m).alias("value")),
        )

    found = F.when(text.rlike(TRACE), F.regexp_extract_all(text, F.lit(wrapped(ENTITY)), F.lit(1)))
    return F.transform(F.coalesce(found, F.array().cast("array<string>")), one)


def family_of(value: Column) -> Column:
    return F.substring_index(F.substring_index(value, ":", -1), " ", -1)


def bare_names(found: Column) -> Column:
    """The pattern of the family names of a text's persons, as an alternative; NULL without."""
    persons = F.filter(found, lambda m: m["type"] == "person")
    names = F.flatten(
        F.transform(
            persons,
            lambda m: F.array(
                F.substring_index(m["text"], " ", -1), F.initcap(family_of(m["value"])), F.upper(family_of(m["value"]))
            ),
        )
    )
    longest = F.reverse(F.sort_array(F.transform(F.array_distinct(names), lambda n: F.struct(F.length(n), n.alias("n")))))
    either = F.array_join(F.transform(longest, lambda x: x["n"]), "|")
    pattern = F.concat(F.lit(r"|(?<![\p{L}\p{N}])(?:"), either, F.lit(r")(?![\p{L}\p{M}\p{N}])"))
    return F.when(F.size(persons) > 0, pattern)


def with_bare_names(text: Column, found: Column, names: Column) -> Column:
    """All mentions, also family names without a title: those of the first such person."""
    persons = F.filter(found, lambda m: m["type"] == "person")

    def one(m: Column) -> Column:
        first = F.filter(persons, lambda p: family_of(p["value"]) == F.lower(m))
        kind = type_of(m)
        bare = (kind == "person") & (without_title(m) == m)
        value = F.coalesce(F.when(bare, F.get(first, F.lit(0))["value"]), canonical(kind, m))
        return F.struct(kind.alias("type"), m.alias("text"), value.alias("value"))

    every = F.regexp_extract_all(text, wrapped(names), F.lit(1))
    return F.when(names.isNull(), found).otherwise(F.transform(every, one))


def drawn_apart(entities: DataFrame, given: Callable[[Column], Column]) -> DataFrame:
    """Entities (type, value, ...) with the draw whose surrogate no other one has or is.

    ``given`` makes the surrogate of a draw.  Only entities whose surrogate is taken draw
    again, so a round is as large as the entities and rounds end when none is left: forms
    get longer with the draws.
    """
    drawn = stored(entities.withColumn("draw", F.lit(0)), "entities")
    originals = drawn.select("type", F.lit(None).cast("string").alias("value"), F.col("value").alias("taken"), F.lit(-1).alias("draw"))
    while True:
        taken = drawn.withColumn("taken", given(F.col("draw")))
        first = (
            taken.select("type", "value", "taken", "draw")
            .unionByName(originals)
            .groupBy("type", "taken")
            .agg(F.min(F.struct("draw", "value")).alias("first"), F.count(F.lit(1)).alias("n"))
            .filter("n > 1")
        )
        lost = taken.join(first, ["type", "taken"]).filter(
            (F.col("first.draw") < 0) | (F.col("first.value") != F.col("value"))
        )
        lost = stored(lost.select("type", "value"), "lost")
        if not lost.limit(1).count():
            return drawn
        again = drawn.join(lost.withColumn("again", F.lit(1)), ["type", "value"], "left")
        drawn = stored(again.withColumn("draw", F.col("draw") + F.coalesce("again", F.lit(0))).drop("again"), "entities")


def redrawn(entities: DataFrame, key: str) -> DataFrame:
    """Entities (type, value) that do not have the first surrogate: their draw, and their part's."""
    kind, value = F.col("type"), F.col("value")
    domain, family = F.substring_index(value, "@", -1), family_of(value)
    with_part = entities.select(
        kind, value,
        F.when(kind == "email", "domain").when(kind == "person", "family").alias("part_type"),
        F.when(kind == "email", domain).when(kind == "person", family).alias("part_value"),
    )
    parts = with_part.filter("part_type is not null").select(
        F.col("part_type").alias("type"), F.col("part_value").alias("value")
    ).distinct()
    parts = drawn_apart(parts, lambda draw: surrogate_of_part(key, kind, value, draw)).filter("draw > 0")
    named_parts = parts.toDF("part_type", "part_value", "part")
    placed = with_part.join(named_parts, ["part_type", "part_value"], "left") if parts.limit(1).count() else (
        with_part.withColumn("part", F.lit(None).cast("int"))
    )
    whole = placed.select(kind, value, F.coalesce("part", F.lit(0)).alias("part"))
    drawn = drawn_apart(whole, lambda draw: surrogate(key, kind, value, draw, F.col("part")))
    return drawn.filter("draw > 0 or part > 0")


def rewritten(text: Column, found: Column, names: Column, key: str, draws: Column) -> Column:
    """The text with every mention replaced; ``draws`` has its draw and its part's for each."""
    fresh = F.transform(
        F.arrays_zip(found.alias("m"), draws.alias("d")),
        lambda x: written(
            x["m"]["type"], x["m"]["text"],
            surrogate(key, x["m"]["type"], x["m"]["value"], x["d"]["draw"], x["d"]["part"]),
        ),
    )
    between = F.when(names.isNull(), F.split(text, ENTITY, -1)).otherwise(
        F.split(text, F.concat(F.lit(ENTITY), names), -1)
    )
    return F.array_join(
        F.zip_with(between, fresh, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""
    )


def pseudonymized(docs: DataFrame, key: str, text: str = "text", length: str | None = None) -> DataFrame:
    """All documents with all columns, surrogates in their texts, and ``n_<type>`` counts.

    ``length`` names a column that holds the length of the text, to be kept right.  A count
    column that would clash gets an underscore.
    """
    renamed = Renamed(docs)
    own = renamed.column(text)
    marked = renamed.frame.withColumn("_found", mentions(own))
    some = F.exists("_found", lambda m: m["type"] != NO_ENTITY)
    clean = marked.filter(~some)
    dirty = marked.filter(some).withColumn("_names", bare_names(F.col("_found")))
    dirty = dirty.withColumn("_found", with_bare_names(own, F.col("_found"), F.col("_names")))
    dirty = stored(dirty.withColumn("_row", F.monotonically_increasing_id()), "mentions")
    flat = dirty.select("_row", F.posexplode("_found").alias("_place", "_m"))
    flat = flat.select("_row", "_place", "_m.type", "_m.value").filter(F.col("type") != NO_ENTITY)
    entities = flat.select("type", "value").distinct()
    again = redrawn(stored(entities, "entities"), key)
    first = F.struct(F.lit(0).alias("draw"), F.lit(0).alias("part"))
    none = F.transform("_found", lambda m: first)
    if again.limit(1).count():
        drawn = flat.join(again, ["type", "value"]).groupBy("_row").agg(
            F.map_from_entries(F.collect_list(F.struct("_place", F.struct("draw", "part").alias("d")))).alias("_draws")
        )
        dirty = dirty.join(drawn, "_row", "left")
        some = F.transform("_found", lambda m, i: F.coalesce(F.try_element_at("_draws", i), first))
        draws = F.when(F.col("_draws").isNull(), none).otherwise(some)
    else:
        draws = none
    fresh = dirty.withColumn(renamed.name(text), rewritten(own, F.col("_found"), F.col("_names"), key, draws))
    if length:
        kind = docs.schema[length].dataType
        fresh = fresh.withColumn(renamed.name(length), F.length(own).cast(kind))
    columns = [*renamed.frame.columns, "_found"]
    every = clean.select(*columns).unionByName(fresh.select(*columns))
    taken = [c.lower() for c in docs.columns]

    def count(kind: str) -> Column:
        of_kind = F.filter("_found", lambda m: m["type"] == kind)
        return F.size(of_kind).cast("long").alias(f"n_{kind}" + "_" * (f"n_{kind}" in taken))

    counts = [count(kind) for kind in TYPES]
    return renamed.back(every, counts)
