"""Keyed surrogates for personal data, in DataFrame functions only.

Mail, IPv4 and IPv6 addresses, card, account (IBAN), identity and phone numbers, hexadecimal secrets, keys with a known prefix, and
names after a form of address are found by one pattern, in the texts that a cheap one lets through. An entity's canonical form (lower
case, or its digits; keys as they are) gets a surrogate from SHA-256 of key, type, form and attempt; it keeps the type, number of
digits, a phone number's country code, validity of a card's or account's check digits, an account's country, a key's prefix, the
host's ending, and a name's gender and script. A name is all capitalised words after forms of address; each word is a form of its own,
and its bare repeats in the same document are replaced too. The last of several words, or the only one, is a family name, which has no
gender and is shared by all who bear it. Gender of the others is unknown after Dr or Prof alone; it is then taken from a name in the
document with a common word. A surrogate that two forms share, or that is itself an original, is drawn again for the later form
until all differ, so entities stay distinct, and all spellings of one form get one surrogate, in the spelling of each place.

Phone numbers are those with separators, with a plus or two zeros in front (E.164), and bare ones of ten digits in the North American
plan or of ten to eleven after a zero; other bare runs of fewer than 13 digits are not taken for numbers of persons.

Defined results: null texts stay null and empty ones empty; texts without entities are unchanged; repeated rows get equal results;
an empty table gives no rows; other columns are ignored, whatever their names. Forms whose space is small don't run out: names get
longer with each attempt, mail, phone, card and identity numbers after a few, a short IPv6 address becomes a whole one, and so does an
IPv4 address after twelve.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, busy_tasks, text_key

# Forms of address by gender, and first names by gender and script.
HE, SHE = "Mr|Herr|Monsieur|Señor|Sr|Господин|Κύριος", "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Госпожа|Κυρία"
NAMES = {
    "he-latin": ["Adrian", "Bruno", "Conrad", "Dario", "Emil", "Felix", "Gregor", "Hugo", "Ivo", "Jonas", "Konrad", "Leon"],
    "she-latin": ["Alma", "Berta", "Clara", "Dora", "Edith", "Flora", "Greta", "Hanna", "Ida", "Julia", "Klara", "Lena"],
    "he-cyrillic": ["Андрей", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Захар", "Игорь"],
    "she-cyrillic": ["Анна", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Ирина"],
    "he-greek": ["Αντώνης", "Βασίλης", "Γιώργος", "Δημήτρης", "Ηλίας", "Θωμάς"],
    "she-greek": ["Άννα", "Βασιλική", "Γεωργία", "Δήμητρα", "Ελένη", "Ζωή"],
}
NAMES |= {f"any-{x}": NAMES[f"he-{x}"] + NAMES[f"she-{x}"] for x in ("latin", "cyrillic", "greek")}
# Family names by script.
NAMES |= {
    "family-latin": ["Arden", "Brandt", "Corvin", "Dahl", "Ekman", "Forster", "Grau", "Holm", "Imhof", "Jansen", "Keller", "Lund"],
    "family-cyrillic": ["Авер", "Бунин", "Волков", "Громов", "Дёмин", "Ершов", "Жуков", "Зотов"],
    "family-greek": ["Αλεξίου", "Βλάχος", "Γεωργίου", "Δούκας", "Ιωάννου", "Κωστής"],
}
#: Forms of address that tell no gender, and 16 syllables of each script that lengthen names which collide.
NEUTRAL = "Dr|Prof|Professor|Doctor|Doktor|Доктор|Профессор|Δρ"
HE, SHE, NEUTRAL = (f"{x}|{x.upper()}" for x in (HE, SHE, NEUTRAL))
SYLLABLES = {
    "latin": "ba ro mi len ta vi so ke dan lu fe gor ni pas te ram".split(),
    "cyrillic": "ба ро ми лен та ви со ке дан лу фе гор ни пас те рам".split(),
    "greek": "βα ρο μι λεν τα βι σο κε δαν λου φε γορ νι πασ τε ραμ".split(),
}
#: Letters that replace others of their script in addresses, 16 each.
LETTERS = {"cyrillic": "абвгдежзиклмнопр", "greek": "αβγδεζηθικλμνξοπ"}
MAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}](?:[\p{L}\p{N}\p{M}._%+-]{0,62}[\p{L}\p{N}\p{M}])?@[\p{L}\p{N}](?:[\p{L}\p{N}\p{M}-]{0,62}\.)+[\p{L}]{2,18}"
IPV4 = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)"
SECRET = r"(?<![0-9A-Za-z])(?=[A-Fa-f]*\d)(?=\d*[A-Fa-f])[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])"
CARD = r"(?<![\d])\d(?:[ -]?\d){12,18}(?![\d])"
# Numbers in groups: a whole run of 13 to 19 digits is a card, as are four groups of four, wherever they end; both are tried before PHONE, which would take their front.
CARD_RUN = r"(?<![\d+])(?<!\d[ .-])(?!00)\d(?:[ -]?\d){12,18}(?![ -]?\d)"
CARD_FOURS = r"(?<![\d+])\d{4}(?:[ -]\d{4}){3}(?!\d)"
PHONE = r"(?<![\d])(?:(?:\+|00)\d{1,3}[ .-]?)?(?:\(\d{2,4}\) ?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?![\d])"
E164 = r"(?<![\d+])\+[1-9](?:[ .()-]{0,2}\d){7,14}(?!\d)|(?<![\d.,+-])00[1-9](?:[ .()-]{0,2}\d){7,13}(?!\d)"
PLAIN_PHONE = r"(?<![\p{L}\d.,+_#/=-])(?:[2-9]\d{2}[2-9]\d{6}|0[1-9]\d{8,9})(?![\p{L}\d_/=-]|[.,]\d)"
IDENTITY = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
IBAN = r"(?<![0-9A-Za-z])(?=[A-Z]{2}(?:[A-Z ]*\d){10})[A-Z]{2}\d{2}(?:[0-9A-Z]{11,30}|(?: [0-9A-Z]{4}){2,7}(?: [0-9A-Z]{1,3})?)(?![0-9A-Za-z])"
IPV6 = r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|(?:[0-9A-Fa-f]{1,4}:){1,7}:|::(?:[0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4})(?![0-9A-Za-z:])"
# Prefixes of public key formats.
KEY_PREFIX = "sk-|AKIA|gh[pousr]_|xox[abprs]-|AIza"
_JWT = r"eyJ[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]{8,}+"
KEY = rf"(?<![0-9A-Za-z_.-])(?:(?:{KEY_PREFIX})[0-9A-Za-z_-]{{16,}}+|{_JWT})"
TITLE = f"(?:{HE}|{SHE}|{NEUTRAL})"
_PART = rf"(?!{TITLE}(?!\p{{L}}))(?:\p{{Lu}}['’])?\p{{Lu}}\p{{L}}++(?:-\p{{Lu}}\p{{L}}++){{0,3}}"
_JOINT = r"(?:\p{Lu}\. ?){0,3}(?:(?:von|van|de|der|den|del|du|di|da|dos|la|le|zu|zur|af|bin|al|ter|ten) ){0,3}"
NAME = rf"(?<= )(?=\p{{L}})(?<=(?<!\p{{L}}){TITLE}\.? ){_JOINT}{_PART}(?: {_JOINT}{_PART}){{0,4}}"
#: A capitalised word of a name, or an initial.
NAME_WORD = r"\p{Lu}\p{L}*"
ENTITY = "|".join((KEY, MAIL, IPV4, IPV6, SECRET, IBAN, IDENTITY, CARD_RUN, CARD_FOURS, PHONE, E164, CARD, PLAIN_PHONE, NAME))
#: What every text with an entity has; found at a glance, while the pattern above looks around at each letter.
SIGNS = ("[0-9](?:[ .()+-]{0,2}[0-9]){6}|[0-9][.][0-9]{1,3}[.][0-9]", "[0-9A-Fa-f]{32}|:[0-9A-Fa-f]{0,4}:", f"{KEY_PREFIX}|eyJ|(?=[A-ZА-ЯΑ-Ω])(?:[A-Z]{{2}}[0-9]{{2}}|{TITLE}[.]? )")


#: Kinds of names.
IS_NAME = "^(?:s?he|any|family)-"


def _kind(ent: Column, before: Column) -> Column:
    """Type of an entity; for names with gender, from the forms of address before ("any" if they tell none), and script."""
    script = F.when(ent.rlike(r"\p{IsCyrillic}"), "cyrillic").when(ent.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    after = lambda titles: before.rlike(rf"(?<!\p{{L}})(?:{titles})\.? (?:(?:{NEUTRAL})\.? )*$")
    name = F.concat(F.when(after(SHE), "she-").when(after(HE), "he-").otherwise("any-"), script)
    kind = F.when(ent.rlike(f"^(?:{KEY})$"), "key").when(ent.contains("@"), "mail").when(ent.rlike(f"^{IPV4}$"), "ip").when(ent.rlike(f"^{IPV6}$"), "ip6").when(ent.rlike(f"^{IBAN}$"), "iban").when(ent.rlike(f"^{IDENTITY}$"), "identity")
    return kind.when(~ent.rlike("[0-9]"), name).when(ent.rlike(f"^{SECRET}$"), "secret").when(ent.rlike(f"^(?:{PHONE}|{E164}|{PLAIN_PHONE})$"), "phone").otherwise("card")


def _canon(kind: Column, ent: Column) -> Column:
    return F.when(kind.isin("phone", "card", "identity"), F.regexp_replace(ent, r"\D", "")).when(kind == "iban", F.replace(ent, F.lit(" "), F.lit(""))).when(kind == "key", ent).otherwise(F.lower(ent))


def _mod97(text: Column) -> Column:
    """Remainder by 97 of capitals and digits, a capital read as a number from 10 on."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda r, c: F.when(c == "", r).otherwise((r * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97))


def _byte(h: Column, i: Column) -> Column:
    return F.conv(F.substring(h, (i % 63) + 1, F.lit(2)), 16, 10).cast("int")


def _surrogate(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    h = F.sha2(F.concat_ws("|", F.lit(key), kind, canon, attempt.cast("string")), 256)
    h2 = F.sha2(F.concat(h, F.lit("2")), 256)
    # Forms of little space get longer after some attempts.
    more = lambda after: F.greatest(attempt - after, F.lit(0))
    long = F.concat(canon, F.when(kind.isin("phone", "card", "identity"), F.repeat(F.lit("1"), more(6))).otherwise(""))
    digit = lambda i, low=0: ((_byte(h, i) + _byte(h2, i) * 7) % (10 - low) + low).cast("string")
    chars = F.split(canon, "")
    latin = lambda i: F.char(F.lit(97) + (_byte(h, i) + _byte(h2, i) * 5) % 26)
    other = lambda c, i: F.when(c.rlike(r"\p{IsCyrillic}"), F.element_at(F.split(F.lit(LETTERS["cyrillic"]), ""), (_byte(h, i) + _byte(h2, i)) % 16 + 1)).when(c.rlike(r"\p{IsGreek}"), F.element_at(F.split(F.lit(LETTERS["greek"]), ""), (_byte(h, i) + _byte(h2, i)) % 16 + 1)).otherwise(latin(i))
    same = F.array_join(F.transform(F.split(long, ""), lambda c, i: F.when(c.rlike(r"[0-9]"), F.when((i == 0) & (c != "0"), digit(i, 1)).otherwise(digit(i))).when(c.rlike("[a-z]"), latin(i)).when(c.rlike(r"\p{L}"), other(c, i)).otherwise(c)), "")
    letter = lambda i, first: F.char(F.lit(ord(first)) + (_byte(h, i) + _byte(h2, i) * 5) % 26)
    as_is = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[0-9]"), digit(i)).when(c.rlike("[a-z]"), letter(i, "a")).when(c.rlike("[A-Z]"), letter(i, "A")).otherwise(c)), "")
    prefix = F.regexp_extract(canon, f"^(?:{KEY_PREFIX}|eyJ)", 0)
    secret = F.concat(prefix, F.substring(as_is, F.length(prefix) + 1, F.length(canon)))
    account = F.substring(as_is, F.lit(5), F.length(canon))
    country = F.substring(canon, F.lit(1), F.lit(2))
    valid = _mod97(F.concat(F.substring(canon, F.lit(5), F.length(canon)), F.substring(canon, F.lit(1), F.lit(4)))) == 1
    check = F.lpad((98 - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
    iban = F.concat(country, F.when(valid, check).otherwise(F.substring(as_is, F.lit(3), F.lit(2))), account)
    hexes = F.array_join(F.transform(F.sequence(F.lit(1), F.ceil(F.length(canon) / 64).cast("int")), lambda i: F.sha2(F.concat(h, i.cast("string")), 256)), "")
    hexed = F.substring(hexes, F.lit(1), F.length(canon))
    whole = F.concat(F.lit("fd"), F.substring(h, 1, 2), *[F.concat(F.lit(":"), F.substring(h, 3 + 4 * i, 4)) for i in range(7)])
    ip6 = F.when(attempt > 3, whole).otherwise(F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[0-9a-f]"), F.substring(h, i % 63 + 1, F.lit(1))).otherwise(c)), ""))
    ip = F.array_join(F.transform(F.array(*map(F.lit, (1, 9, 17, 25))), lambda i: (F.conv(F.substring(h, i, F.lit(6)), 16, 10).cast("int") % 254 + 1).cast("string")), ".")
    ip = F.when(attempt > 12, whole).otherwise(ip)
    ending = F.regexp_extract(canon, r"\.\p{L}{2,18}$", 0)
    front = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(attempt, F.lit(1))), lambda i: F.when(i <= more(3), latin(i + 40)).otherwise("")), "")
    mail = F.concat(front, F.substring(same, F.lit(1), F.length(canon) - F.length(ending)), ending)

    def luhn(digits: Column) -> Column:
        """Sum of digits, every second one from the second last doubled."""
        n = F.length(digits)
        return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + F.when((n - i) % 2 == 1, (F.substring(digits, i, F.lit(1)).cast("int") * 2) % 10 + F.when(F.substring(digits, i, F.lit(1)) >= "5", 1).otherwise(0)).otherwise(F.substring(digits, i, F.lit(1)).cast("int")))

    stem = F.concat(F.substring(same, F.lit(1), F.length(long) - 1), F.lit("0"))
    card = F.when(luhn(canon) % 10 == 0, F.concat(F.substring(stem, F.lit(1), F.length(long) - 1), ((10 - luhn(stem) % 10) % 10).cast("string"))).otherwise(same)
    out = F.when(kind == "mail", mail).when(kind == "ip", ip).when(kind == "ip6", ip6).when(kind == "identity", same).when(kind == "secret", hexed).when(kind == "card", card).when(kind == "phone", F.concat(F.substring(canon, F.lit(1), F.greatest(F.length(canon) - 10, F.lit(0))), F.substring(same, F.greatest(F.length(canon) - 10, F.lit(0)) + 1, F.length(long))))
    for name, options in NAMES.items():
        pick = F.element_at(F.array(*map(F.lit, options)), _byte(h, F.lit(0)) % len(options) + 1)
        # lists are short, so names that collide get as many syllables as there were attempts: each one makes the space 16 times as large
        syllables = F.array(*map(F.lit, SYLLABLES[name.split("-")[1]]))
        tail = F.transform(F.sequence(F.lit(1), F.greatest(attempt, F.lit(1))), lambda i: F.element_at(syllables, _byte(h2, i * 2) % 16 + 1))  # noqa: B023
        out = out.when(kind == name, F.when(attempt < 2, pick).otherwise(F.concat(pick, F.array_join(tail, ""))))
    return F.when(kind == "key", secret).when(kind == "iban", iban).otherwise(F.lower(out))


def _written(kind: Column, ent: Column, surrogate: Column) -> Column:
    """The surrogate as the entity is written: separators of numbers, capitals of words; digits beyond the entity's follow it."""
    digits = F.array_join(F.transform(F.split(ent, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(surrogate, F.length(F.regexp_replace(F.substring(ent, F.lit(1), i + 1), r"\D", "")), F.lit(1))).otherwise(c)), "")
    digits = F.concat(digits, F.substring(surrogate, F.length(F.regexp_replace(ent, r"\D", "")) + 1, F.length(surrogate)))
    spaced = F.array_join(F.transform(F.split(ent, ""), lambda c, i: F.when(c == " ", c).otherwise(F.substring(surrogate, F.length(F.replace(F.substring(ent, F.lit(1), i + 1), F.lit(" "), F.lit(""))), F.lit(1)))), "")
    named = F.when(F.length(ent) == 1, F.upper(F.substring(surrogate, 1, 1))).when((ent == F.upper(ent)) & (ent != F.lower(ent)), F.upper(surrogate)).otherwise(F.concat(F.upper(F.substring(surrogate, 1, 1)), F.substring(surrogate, F.lit(2), F.length(surrogate))))
    return F.when(kind.isin("phone", "card", "identity"), digits).when(kind == "iban", spaced).when(kind.rlike(IS_NAME), named).when(kind.isin("mail", "secret", "ip6") & (ent == F.upper(ent)) & (ent != F.lower(ent)), F.upper(surrogate)).otherwise(surrogate)


def surrogates(forms: DataFrame, key: str, max_attempts: int = 40) -> DataFrame:
    """kind, canon, surrogate for distinct kind, canon. Each round draws only the colliding forms again."""
    scratch = Scratch(forms.sparkSession, "surrogates")
    # Forms are few bytes and dear to draw, so they are dealt by their number and not by their size.
    forms = forms.repartition(max(1, -(-forms.count() // 2000)))
    state = scratch.save(forms.select("kind", "canon", F.lit(0).alias("attempt")).withColumn("surrogate", _surrogate(key, F.col("kind"), F.col("canon"), F.col("attempt"))), "0")
    group = F.regexp_replace("kind", IS_NAME + ".*", "name")
    for n in range(1, max_attempts + 1):
        firsts = state.groupBy(group.alias("g"), "surrogate").agg(F.min(F.struct("attempt", "canon", "kind")).alias("owner"), F.count("*").alias("c")).filter("c > 1")
        shared = state.join(firsts, (group == F.col("g")) & (state["surrogate"] == firsts["surrogate"])).filter(F.struct("attempt", "canon", "kind") > F.col("owner")).select("kind", "canon")
        originals = state.select(group.alias("g"), F.col("canon").alias("taken")).distinct()
        own = state.join(originals, (group == F.col("g")) & (F.col("surrogate") == F.col("taken"))).select("kind", "canon")
        bad = scratch.save(shared.unionByName(own).distinct(), f"bad-{n}")
        if not bad.limit(1).count():
            return state.select("kind", "canon", "surrogate")
        drawn = state.join(bad, ["kind", "canon"], "left_semi").repartition(max(1, -(-bad.count() // 2000)))
        attempt = F.col("attempt") + 1
        drawn = drawn.select("kind", "canon", attempt.alias("attempt"), _surrogate(key, F.col("kind"), F.col("canon"), attempt).alias("surrogate"))
        state = scratch.save(state.join(bad, ["kind", "canon"], "left_anti").unionByName(drawn), str(n))
        scratch.drop(str(n - 1), f"bad-{n}")
    raise ValueError("surrogates still collide; a type's space is used up")


def replace_pii(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text (with surrogates), n_entities, kinds (the types found, sorted)."""
    scratch = Scratch(docs.sparkSession, "pii")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tk", text_key("text"))
    words = lambda e: F.regexp_extract_all(e, F.lit(r"\p{Lu}\p{L}+"), F.lit(0))
    sign = F.col("text").contains("@")
    for pattern in SIGNS:
        sign = sign | F.col("text").rlike(pattern)
    some = src.filter(sign).repartition(busy_tasks(docs.sparkSession), "doc_id", "tk").dropDuplicates(["doc_id", "tk"]).withColumn("es", F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0))).filter(F.size("es") > 0)
    # Words of names after a form of address are entities of the document wherever they stand alone.
    some = some.withColumn("ws", F.array_distinct(F.flatten(F.transform(F.filter("es", lambda e: ~e.rlike("[0-9@]")), words))))
    some = some.withColumn("bare", F.array_join(F.array_distinct(F.concat("ws", F.transform("ws", F.upper))), "|"))
    repeat = F.concat(F.lit(ENTITY + r"|(?<!\p{L})(?:"), "bare", F.lit(")(?:[ -](?:"), "bare", F.lit(r"))*(?!\p{L})"))
    some = some.withColumn("pattern", F.when(F.size("ws") > 0, repeat).otherwise(ENTITY))
    some = some.select("doc_id", "tk", "pattern", F.when(F.size("ws") > 0, F.regexp_extract_all("text", F.col("pattern"), F.lit(0))).otherwise(F.col("es")).alias("es"), F.split("text", F.col("pattern"), -1).alias("parts"))
    before = lambda i: F.substring(F.col("parts")[i], F.greatest(F.length(F.col("parts")[i]) - 39, F.lit(1)), F.lit(40))
    each = F.transform("es", lambda e, i: F.struct(i.alias("i"), e.alias("e"), _kind(e, before(i)).alias("kind"), before(i).rlike(rf"(?<!\p{{L}}){TITLE}\.? $").alias("addressed")))
    some = some.select("doc_id", "tk", "parts", each.alias("each"))

    def resolved(x: Column, names: str) -> Column:
        """The kind of a name of unknown gender: that of the first of names that shares a word."""
        low = lambda e: F.transform(words(e), F.lower)
        same = F.filter(names, lambda y: F.arrays_overlap(low(y["e"]), low(x["e"])))
        return F.when(x["kind"].startswith("any-"), F.coalesce(F.get(same, F.lit(0))["kind"], x["kind"])).otherwise(x["kind"])

    put_kind = lambda x, names: F.struct(x["i"], x["e"], resolved(x, names).alias("kind"), x["addressed"])
    some = some.withColumn("told", F.filter("each", lambda x: x["kind"].rlike("^s?he-")))
    some = some.withColumn("each", F.transform("each", lambda x: F.when(x["addressed"], put_kind(x, "told")).otherwise(x)))
    some = some.withColumn("known", F.filter("each", lambda x: x["addressed"] & x["kind"].rlike(IS_NAME)))
    some = some.withColumn("each", F.transform("each", lambda x: put_kind(x, "known")))
    some = scratch.save(some.select("doc_id", "tk", "parts", "each"), "some")
    last = lambda e: F.lower(F.element_at(F.regexp_extract_all(e, F.lit(NAME_WORD), F.lit(0)), -1))
    families = F.transform(F.filter("each", lambda x: x["addressed"] & x["kind"].rlike(IS_NAME)), lambda x: last(x["e"]))
    found = some.select("doc_id", "tk", families.alias("families"), F.explode("each").alias("x")).select("doc_id", "tk", "families", "x.i", "x.e", "x.kind")
    # A name is replaced word by word, so that its words are coreferent by themselves.
    pieces = F.when(F.col("kind").rlike(IS_NAME), F.regexp_extract_all("e", F.lit(NAME_WORD), F.lit(0))).otherwise(F.array("e"))
    # The last word of a name with a form of address is a family's, wherever it stands in the document.
    pieces = F.transform(pieces, lambda w: F.struct(w.alias("w"), F.when(F.col("kind").rlike(IS_NAME) & F.array_contains("families", F.lower(w)), F.regexp_replace("kind", IS_NAME, "family-")).otherwise(F.col("kind")).alias("of")))
    found = found.select("doc_id", "tk", "i", "e", "kind", F.posexplode(pieces).alias("j", "p")).select("doc_id", "tk", "i", "j", "e", "kind", "p.w", "p.of")
    found = scratch.save(found.withColumn("canon", _canon(F.col("of"), F.col("w"))), "found")
    forms = scratch.save(found.select(F.col("of").alias("kind"), "canon").distinct(), "forms")
    new = surrogates(forms, key)
    put = found.join(new.withColumnRenamed("kind", "of"), ["of", "canon"]).select("doc_id", "tk", F.struct("i", "j", _written(F.col("of"), F.col("w"), F.col("surrogate")).alias("s"), "kind", "e").alias("r"))
    put = put.groupBy("doc_id", "tk").agg(F.array_sort(F.collect_list("r")).alias("ws"))  # bounded by the document's own entities
    mixed = lambda parts, new: F.array_join(F.flatten(F.zip_with(parts, new, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    whole = lambda r: F.struct(r["i"], F.when(r["kind"].rlike(IS_NAME), mixed(F.split(r["e"], NAME_WORD, -1), F.transform(F.filter("ws", lambda w: w["i"] == r["i"]), lambda w: w["s"]))).otherwise(r["s"]).alias("s"), r["kind"])
    put = put.select("doc_id", "tk", F.transform(F.filter("ws", lambda r: r["j"] == 0), whole).alias("rs"))
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.tk") == F.col(f"{b}.tk"))
    put = some.alias("s").join(put.alias("p"), same("s", "p")).select("s.doc_id", "s.tk", mixed(F.col("parts"), F.transform("rs", lambda r: r["s"])).alias("new"), F.transform("rs", lambda r: r["kind"]).alias("ks"))
    put = scratch.save(put, "put")
    scratch.drop("some", "found", "forms")
    j = src.alias("d").join(put.alias("p"), same("d", "p"), "left")
    none = F.array().cast("array<string>")
    return j.select("d.doc_id", F.coalesce("new", "text").alias("text"), F.coalesce(F.size("ks"), F.lit(0)).cast("long").alias("n_entities"), F.coalesce(F.array_sort(F.array_distinct("ks")), none).alias("kinds"))
