"""Personal data replaced by surrogates (DataFrame operations only).

E-mail addresses, IPv4 and IPv6 addresses, bank accounts (IBAN with valid check digits), payment cards (15 or 16 digits,
Luhn-valid), phone numbers (international, or national with a leading 0 or an area code in brackets) and names after a
title are detected by one pattern. An entity is what is left without its dress: case, spaces, dots, brackets and a name's
title do not make another entity, so "Mr. John" and "Mister JOHN", or +49 30 1234567 and +49-30-1234567, get the same
surrogate everywhere (coreference). Every word of a name is an entity of the gender of its title, so "Mr John Smith" and
a later "Mr Smith" agree. The surrogate is put into the dress of each mention: case, punctuation and layout stay.

Surrogates are keyed and of their entity's type and form: letters become letters, digits digits; cards stay Luhn-valid,
accounts keep country and valid check digits, octets stay 1-254, country codes of phones and top-level domains stay;
names come from the list of the title's gender (titles without one have a list of their own) and of the name's script,
or, in scripts without a list, from letters of that script, or of the name itself.

Two entities of a type never share a surrogate (distinctness): surrogates of all entities are compared, and whichever
collides with another or with a real entity takes the next attempt of its keyed sequence. Entities whose first attempt
stands, nearly all, need no lookup when texts are rewritten; the exceptions are joined by document on narrow rows, by
broadcast up to ``EXCEPTIONS`` of them (counted first).

Not found: names without a title, and a national number is another entity than its international form.

Defined results: null text stays null, empty text stays empty, both without entities; repeated rows each get the
same result; columns other than doc_id and text are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import attach, staged, text_or_empty, unstage

EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]+\.)+\p{L}{2,}"
IPV4 = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])"
IPV6 = r"(?<![0-9A-Fa-f:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5})(?![0-9A-Fa-f:])"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"
CARD = r"(?<![0-9-])(?:(?:[0-9]{4}[ -]?){3}[0-9]{4}|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5})(?![0-9-])"
PHONE = (
    r"(?<![0-9+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}(?![0-9])"
    r"|(?<![0-9+)])\([0-9]{2,5}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?<![0-9+./-])0[0-9]{2,4}[ /-][0-9]{6,8}(?![0-9])"
)
#: Titles by gender, and names by gender and script.
MALE_TITLES = ("Mr", "Mister", "Herr", "Monsieur", "Señor", "Господин", "Κύριος")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Госпожа", "Κυρία")
OTHER_TITLES = ("Dr", "Doctor", "Prof", "Professor", "Mx")
NAMES = {
    "m": {
        "latin": "adam bruno carl david emil felix georg hugo ivan jonas karl leo martin noah oscar paul",
        "cyrillic": "антон борис виктор глеб денис егор иван кирилл",
        "greek": "αλέξης γιάννης δημήτρης ηλίας κώστας νίκος πέτρος σπύρος",
    },
    "f": {
        "latin": "anna bella clara dora emma flora greta helena irene julia karla laura maria nora olga paula",
        "cyrillic": "анна вера галина дарья елена жанна ирина ксения",
        "greek": "άννα ελένη ζωή ιωάννα κατερίνα μαρία νίκη σοφία",
    },
    "n": {
        "latin": "alder birch brook dale field forest glen heath hill lake marsh moor ridge stone vale wood",
        "cyrillic": "белов волин громов дубов зимин клёнов лесов полев",
        "greek": "βράχος δάσος κάμπος λίμνης ξύλος πέτρας ρίζος σταυρός",
    },
}
#: Vowels and consonants that make up the end of a listed name, 16 to a script; letters of scripts without a list.
TAILS = {"latin": "aeiouaeiounrslmt", "cyrillic": "аеиоуаеиоунрслмт", "greek": "αειουαειουνρσλμτ"}
LETTERS = {
    "Arabic": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي",
    "Hebrew": "אבגדהוזחטיכלמנסעפצקרשת",
    "Devanagari": "कखगघचछजझटठडढणतथदधनपफबभमयरलवशषसह",
    "Han": "安邦长春德飞光国海和华江金康乐林明宁平青荣山天文祥新雪阳永云志中",
    "Hiragana": "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわ",
    "Katakana": "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワ",
    "Hangul": "가나다라마바사아자차카타파하고노도로모보소오조초코토포호",
}
TITLE = rf"(?:{'|'.join(sorted(MALE_TITLES + FEMALE_TITLES + OTHER_TITLES, key=len, reverse=True))})\.? "
WORD = r"(?:[\p{Lu}\p{Lo}][\p{L}\p{M}'’-]*[\p{L}\p{M}]|\p{Lo}|\p{Lu}\.)"
NAME = rf"(?<![\p{{L}}\p{{N}}]){TITLE}{WORD}(?: {WORD}){{0,3}}"
PATTERNS = {"email": EMAIL, "ipv6": IPV6, "ipv4": IPV4, "iban": IBAN, "card": CARD, "phone": PHONE, "name": NAME}
_STARTS = r"(?<![\p{L}\p{N}._%+-])"
#: All of them, those first that begin a word, so that places inside words fail at once; and what a text with any of them has.
ANY = rf"{_STARTS}(?:{EMAIL.removeprefix(_STARTS)}|{IPV6}|{IBAN}|(?=\p{{Lu}}){NAME})|(?=[0-9+(])(?:{IPV4}|{CARD}|{PHONE})"
MAYBE = rf"@|[0-9][0-9.]|[0-9A-Fa-f]:[0-9A-Fa-f:]|{TITLE}"
MAX_ATTEMPTS = 40
EXCEPTIONS = 200_000
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Country codes of phone numbers: of one, two, else three digits.
_CODE = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"


def let(value: Column, use) -> Column:
    """``use`` of a value that is written, and computed, once."""
    return F.get(F.transform(F.array(value), use), 0)


def _chars(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def kind_of(match: Column) -> Column:
    """The type of a match of ANY."""
    out = F.lit("name")
    for kind, pattern in reversed([p for p in PATTERNS.items() if p[0] != "name"]):
        out = F.when(match.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a string of digits."""
    step = lambda c, i: F.when(F.pmod(i, F.lit(2)) == 0, c).when(c > 4, c * 2 - 9).otherwise(c * 2)
    return F.aggregate(F.transform(F.transform(_chars(F.reverse(digits)), lambda c: c.cast("int")), step), F.lit(0), lambda s, x: s + x)


def _mod_97(text: Column) -> Column:
    """The number that a text of digits and letters (10 to 35) writes, modulo 97."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.call_function("instr", F.lit(_UPPER), c) + 9)
    return F.aggregate(F.transform(_chars(text), value), F.lit(0), lambda s, x: F.pmod(F.when(x > 9, s * 100 + x).otherwise(s * 10 + x), F.lit(97)))


def is_entity(match: Column, kind: Column | None = None) -> Column:
    """False for a match that only looks like a card or an account."""
    kind = kind_of(match) if kind is None else kind
    plain = F.regexp_replace(match, "[ -]", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    return F.when(kind == "card", F.pmod(_luhn_sum(plain), F.lit(10)) == 0).when(kind == "iban", _mod_97(turned) == 1).otherwise(F.lit(True))


def undressed(match: Column, kind: Column) -> Column:
    """The entity of a match (for a name see name_words)."""
    return F.when(kind == "phone", F.regexp_replace(match, "[^0-9+]", "")).when(kind.isin("card", "iban"), F.regexp_replace(match, "[ -]", "")).otherwise(F.lower(match))


def gender_of(name: Column) -> Column:
    title = F.regexp_extract(name, r"^(\S+?)\.? ", 1)
    return F.when(title.isin(*MALE_TITLES), F.lit("m")).when(title.isin(*FEMALE_TITLES), F.lit("f")).otherwise(F.lit("n"))


def name_words(name: Column) -> Column:
    """The words after the title."""
    return F.slice(F.split(name, " "), 2, F.size(F.split(name, " ")))


def entities_of(match: Column) -> Column:
    """The entities of a match: an array of structs kind, entity; empty if it only looks like one."""
    of = lambda k, e: F.struct(k.alias("kind"), e.alias("entity"))
    named = let(F.concat(F.lit("name-"), gender_of(match)), lambda kind: F.transform(name_words(match), lambda w: of(kind, F.lower(w))))
    none = F.array().cast("array<struct<kind:string,entity:string>>")
    return let(kind_of(match), lambda kind: F.when(kind == "name", named).when(is_entity(match, kind), F.array(of(kind, undressed(match, kind)))).otherwise(none))


def _byte(digest: Column, i: Column) -> Column:
    return F.conv(F.substring(digest, (F.pmod(i, F.lit(64)) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _pick(symbols: str, n: Column) -> Column:
    return F.substring(F.lit(symbols), F.pmod(n, F.lit(len(symbols))) + 1, F.lit(1))


def _shaped(text: Column, digest: Column, letters: str = _LOWER) -> Column:
    """Digits to digits, letters to letters of their alphabet (Cyrillic to Cyrillic); all else stays."""
    put = lambda c, i: (
        F.when(c.rlike("[0-9]"), _pick(_DIGITS, _byte(digest, i)))
        .when(c.rlike("[a-z]"), _pick(letters, _byte(digest, i)))
        .when(c.rlike("[A-Z]"), _pick(_UPPER, _byte(digest, i)))
        .when(c.rlike(r"\p{IsCyrillic}"), _pick("абвгдежзиклмнопрстуфхцчшэюя", _byte(digest, i)))
        .when(c.rlike(r"\p{L}"), _pick(_LOWER, _byte(digest, i)))
        .otherwise(c)
    )
    return F.array_join(F.transform(_chars(text), put), "")


def _name(kind: Column, word: Column, digest: Column) -> Column:
    """A word of a name: from the list of its gender and script with a keyed end; else letters of its script or its own."""
    by_script = lambda of, other: F.coalesce(*[F.when(word.rlike(rf"^\p{{Is{script.title()}}}"), of(script)) for script in TAILS], other)
    lists = lambda script: F.element_at(F.create_map(*[F.lit(x) for g in NAMES for x in (f"name-{g}", NAMES[g][script])]), kind)
    letters = F.coalesce(*[F.when(word.rlike(rf"^\p{{Is{script}}}"), F.lit(x)) for script, x in LETTERS.items()], word)
    n = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    any_of = lambda symbols, n: F.substring(symbols, (F.pmod(n, F.length(symbols)) + 1).cast("int"), F.lit(1))
    drawn = let(letters, lambda x: F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(F.length(word) - 1, F.lit(1))), lambda i: any_of(x, _byte(digest, i))), ""))
    listed = let(F.split(by_script(lists, F.lit("")), " "), lambda x: F.element_at(x, (F.pmod(n, F.size(x)) + 1).cast("int")))
    tail = F.coalesce(*[F.when(word.rlike(rf"^\p{{Is{script.title()}}}"), F.translate(F.substring(digest, 9, 4), "0123456789abcdef", x)) for script, x in TAILS.items()], F.lit(""))
    made = F.when(F.length(tail) > 0, F.concat(listed, tail)).otherwise(drawn)
    return F.when(word.rlike(r"^\p{L}\.$"), F.concat(any_of(by_script(lambda x: F.lit(TAILS[x]), F.lit(_LOWER)), n), F.lit("."))).otherwise(made)


def surrogate(kind: Column, entity: Column, attempt: Column, key: str) -> Column:
    """The attempt-th surrogate of an entity: keyed, of its type and form."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), kind, attempt.cast("string"), entity), 512)
    return let(digest, lambda d: let(_shaped(entity, d), lambda shaped: _surrogate(kind, entity, d, shaped)))


def _surrogate(kind: Column, entity: Column, digest: Column, shaped: Column) -> Column:
    local, top = F.substring_index(entity, "@", 1), F.concat(F.lit("."), F.substring_index(entity, ".", -1))
    host = F.regexp_extract(entity, r"@(.*)\.[^.]+$", 1)
    mail = F.concat(F.substring(shaped, F.lit(1), F.length(local)), F.lit("@"), F.substring(shaped, F.length(local) + 2, F.length(host)), top)
    octet = lambda i: (F.pmod(F.conv(F.substring(digest, 8 * i + 1, 6), 16, 10).cast("long"), F.lit(254)) + 1).cast("string")
    code = F.when(entity.rlike(r"^\+"), F.regexp_extract(entity, _CODE, 0)).otherwise(F.substring(entity, 1, 1))
    phone = F.concat(code, F.substring(shaped, F.length(code) + 1, F.length(entity)))
    body = F.concat(F.substring(entity, 1, 1), F.substring(shaped, F.lit(2), F.length(entity) - 2))
    card = let(body, lambda b: F.concat(b, F.pmod(F.lit(10) - F.pmod(_luhn_sum(F.concat(b, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")))
    country, account = F.substring(entity, 1, 2), F.substring(shaped, F.lit(5), F.length(entity))
    iban = F.concat(country, F.lpad((F.lit(98) - _mod_97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0"), account)
    out = F.when(kind == "email", mail).when(kind == "ipv4", F.concat_ws(".", *[octet(i) for i in range(4)])).when(kind == "ipv6", _shaped(entity, digest, "abcdef"))
    out = out.when(kind == "iban", iban).when(kind == "card", card).when(kind == "phone", phone)
    return out.otherwise(_name(kind, entity, digest))


def _cased(like: Column, text: Column) -> Column:
    """Upper case where all of ``like`` is, a capital where its first letter is one."""
    head = F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)))
    return F.when((F.upper(like) == like) & (F.lower(like) != like) & (F.length(like) > 1) & ~like.rlike(r"\.$"), F.upper(text)).when(F.substring(like, 1, 1) != F.lower(F.substring(like, 1, 1)), head).otherwise(text)


def dressed(match: Column, kind: Column, made: Column) -> Column:
    """A surrogate in the layout of a match: characters put where the match has them, in its case."""
    place = lambda i: F.length(F.regexp_replace(F.substring(match, F.lit(1), i + 1), "[ ./()-]", ""))
    poured = F.array_join(F.transform(_chars(match), lambda c, i: F.when(c.rlike("[ ./()-]"), c).otherwise(F.substring(made, place(i), F.lit(1)))), "")
    same_case = F.array_join(F.transform(_chars(match), lambda c, i: F.when(c != F.lower(c), F.upper(F.substring(made, i + 1, F.lit(1)))).otherwise(F.substring(made, i + 1, F.lit(1)))), "")
    return F.when(kind == "ipv4", made).when(kind.isin("email", "ipv6"), same_case).otherwise(poured)


def entity_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """entities (kind, entity; distinct) to staged rows kind, entity, attempt, surrogate: no two of a kind alike, none a real entity."""
    make = lambda df: df.select("kind", "entity", "attempt", surrogate(F.col("kind"), F.col("entity"), F.col("attempt"), key).alias("surrogate"))
    now = staged(make(entities.select("kind", "entity", F.lit(0).alias("attempt"))), "pii-surrogates")
    for _ in range(MAX_ATTEMPTS):
        real = now.select("kind", F.col("entity").alias("surrogate"), F.lit(True).alias("real"))
        rank = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("attempt", "entity"))
        judged = now.withColumn("rank", rank).join(real, ["kind", "surrogate"], "left").withColumn("bad", (F.col("rank") > 1) | F.col("real").isNotNull())
        if judged.where("bad").isEmpty():
            return now
        before, now = now, staged(make(judged.select("kind", "entity", (F.col("attempt") + F.col("bad").cast("int")).alias("attempt"))), "pii-surrogates")
        unstage(before)
    raise RuntimeError(f"surrogates still collide after {MAX_ATTEMPTS} attempts")


def pseudonymize(docs: DataFrame, *, key: str) -> DataFrame:
    """One row per document: doc_id, text (surrogates in place of entities), n_entities, kinds (sorted, distinct, comma-joined)."""
    t = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64(text_or_empty(F.col("text"))).alias("_h"))
    matches = F.when(F.col("text").rlike(MAYBE), F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))
    seen = t.select("doc_id", "_h", F.explode(F.array_distinct(matches)).alias("match"))
    seen = staged(seen.select("doc_id", "_h", F.explode(entities_of(F.col("match"))).alias("e")).select("doc_id", "_h", "e.kind", "e.entity"), "pii-occurrences")
    made = entity_surrogates(seen.select("kind", "entity").distinct(), key)
    later = made.where("attempt > 0").select("kind", "entity", "surrogate")
    named = F.struct(F.concat_ws("|", "kind", "entity").alias("key"), "surrogate")
    exceptions = seen.join(later, ["kind", "entity"]).groupBy("doc_id", "_h").agg(F.map_from_entries(F.collect_set(named)).alias("later"))
    exceptions = staged(exceptions, "pii-exceptions")
    unstage(seen)
    joined = attach(t, F.broadcast(exceptions) if exceptions.count() <= EXCEPTIONS else exceptions, ["doc_id", "_h"])
    joined = joined.withColumn("found", F.coalesce(matches, F.array().cast("array<string>")))
    of = lambda kind, e: F.coalesce(F.try_element_at("later", F.concat_ws("|", kind, e)), surrogate(kind, e, F.lit(0), key))

    def put(m: Column) -> Column:
        word = lambda gender: lambda w: let(of(gender, F.lower(w)), lambda made: _cased(w, made))
        named = let(F.concat(F.lit("name-"), gender_of(m)), lambda gender: F.array_join(F.transform(name_words(m), word(gender)), " "))
        other = lambda kind: let(undressed(m, kind), lambda e: let(of(kind, e), lambda made: dressed(m, kind, made)))
        return let(kind_of(m), lambda kind: F.when(kind == "name", F.concat(F.substring_index(m, " ", 1), F.lit(" "), named)).when(is_entity(m, kind), other(kind)).otherwise(m))

    woven = F.flatten(F.zip_with(F.split("text", ANY, -1), F.transform("found", put), lambda a, b: F.array(a, F.coalesce(b, F.lit("")))))
    kinds = F.filter(F.transform("found", lambda m: let(kind_of(m), lambda kind: F.when(is_entity(m, kind), kind))), lambda k: k.isNotNull())
    return joined.select("doc_id", F.when(F.size("found") > 0, F.array_join(woven, "")).otherwise(F.col("text")).alias("text"), F.when(F.size("found") > 0, kinds).otherwise(F.array().cast("array<string>")).alias("kinds")).select(
        "doc_id", "text", F.size("kinds").cast("long").alias("n_entities"), F.array_join(F.array_sort(F.array_distinct("kinds")), ",").alias("kinds")
    )


def op9_pii(spark, sf_dir: str) -> DataFrame:
    """The key of a deployment is its own; the registered query takes that of the session, or a fixed one."""
    key = spark.conf.get("spark.millrace.pii.key", "key of the registered query")
    return pseudonymize(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), key=key)
