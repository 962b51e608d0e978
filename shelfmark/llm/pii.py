"""PII: surrogate generation, with DataFrame functions only.

Entities are found by pattern: e-mail addresses, telephone, card and social security numbers, IPv4 and
MAC addresses, IBANs, long hexadecimal tokens, keys by their usual prefixes, quoted secrets, dates of birth and street addresses, and persons: after titles and
degrees, after words that introduce a name, or by a common given name before a family name; particles between the names are part of it and stay. The kind is that
of the first pattern that matches the whole entity, in the order in which they are looked for. A document's persons are also found where
their names stand bare, in the same case or in capitals. Each entity is
brought to a canonical form, its unit (digits of a number, lower case of an address, the given and
family names of a person one by one), and units get surrogates from SHA-256 of a key, the kind, the
unit and an attempt number:

- kind and format stay: the mention's punctuation, country code, length, letter case, a key's prefix, (of a card)
  leading digit and Luhn validity, (of an IBAN) country and validity of the check digits;
- surrogates lie in ranges that nobody owns where the kind has one: addresses under a reserved domain, IPs for benchmarks or in
  the reserved class, telephone exchange 555, social security areas that aren't issued, locally administered MACs;
- a date of birth keeps its order and separators and is a day on which nobody alive was born; an address keeps the kind of street, and lengths;
- a person keeps the title, and the names' gender (from the title, else from the given name) and
  script (Latin or Cyrillic);
- one unit has one surrogate wherever it stands, so coreference holds over the whole corpus;
- a collision check gives every unit a surrogate that no other unit of its kind has and that is itself
  no unit of the corpus: units that lose the check try again with the next attempt, and later attempts draw from wider ranges.

Scale: the patterns run over each text once; texts and what was found are written to the shared folder, and rows without an entity pass
through from there without a shuffle. Those with one are split at their entities and written again. Units are distinct before they are
checked, the check's joins are on the surrogate and the unit together, mentions of heavy units are dealt
out over salts, and a text is shuffled once, only if it has an entity.

Null text stays null and has no entity. Texts without an entity come back unchanged; every pattern is bounded, so
that very long texts take a time in proportion. Ties: of units that draw one surrogate the first by code point gets it. Repeated rows
are rewritten alike and each keep their row. Only the id and the text are read, so other columns may have any name. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import OWN, checkpoint, heavy_keys, salted_join, written

KEY = "shelfmark-surrogates-1"
ROUNDS = 64

#: Titles by gender; x leaves it to the given name.
TITLES = {
    "m": ("Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Sr", "пан", "г-н"),
    "f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Srta", "пані", "г-жа"),
    "x": ("Dr", "Prof", "Professor"),
}
#: Given names by script and gender.
GIVEN = {
    "latin_m": ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Louis", "Martin", "Noah", "Oscar", "Paul", "Robert", "Samuel", "Thomas", "Victor", "Walter", "John", "James", "Peter"),
    "latin_f": ("Anna", "Berta", "Clara", "Diana", "Emma", "Flora", "Greta", "Helen", "Irene", "Julia", "Karin", "Laura", "Maria", "Nina", "Olga", "Paula", "Rosa", "Sara", "Teresa", "Vera", "Wilma", "Jane", "Mary", "Alice"),
    "cyrillic_m": ("Андрій", "Борис", "Віктор", "Григорій", "Дмитро", "Захар", "Іван", "Кирило", "Лука", "Максим", "Назар", "Олег"),
    "cyrillic_f": ("Алла", "Богдана", "Віра", "Галина", "Дарина", "Зоя", "Ірина", "Катерина", "Лідія", "Марія", "Надія", "Ольга"),
}
#: Syllables that names are made of, and their endings by gender.
SYLLABLES = {
    "latin": ("ba", "be", "bo", "da", "de", "do", "fa", "fe", "ga", "go", "ka", "ke", "ko", "la", "le", "lo", "ma", "me", "mo", "na", "ne", "no", "pa", "pe", "ra", "re", "ro", "sa", "se", "ta", "te", "to"),
    "cyrillic": ("ба", "бе", "бо", "ва", "ве", "га", "го", "да", "де", "до", "за", "зе", "ка", "ке", "ко", "ла", "ле", "ло", "ма", "ме", "мо", "на", "не", "но", "па", "ра", "ре", "ро", "са", "се", "та", "то"),
}
ENDINGS = {"latin_m": "n", "latin_f": "lia", "latin_x": "r", "cyrillic_m": "н", "cyrillic_f": "ля", "cyrillic_x": "р"}
#: Degrees that follow a title, words that introduce a name, particles of names.
DEGREES = ("med", "phil", "jur", "rer", "nat", "ing", "habil", "hc", "h.c")
INTRODUCTIONS = ("my name is", "mein name ist", "ich heiße", "je m'appelle", "je m’appelle", "mon nom est", "me llamo", "mi nombre es", "мене звати")
PARTICLES = ("von", "van", "der", "den", "de", "del", "della", "di", "da", "dos", "du", "la", "zu", "zur", "ter", "bin", "ibn", "al")
#: Words before a date of birth, and kinds of streets: after the name, or at its end.
BORN = ("born on", "born", "date of birth", "dob", "geboren am", "geboren", "geb.", "née le", "né le", "nacida el", "nacido el", "народилася", "народився")
STREETS = ("Street", "Road", "Avenue", "Lane", "Drive", "Boulevard", "St", "Rd", "Ave", "Ln", "Blvd")
STREET_ENDS = ("straße", "strasse", "gasse", "platz", "allee", "weg")
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_TITLE = "(?iu:" + "|".join(t for ts in TITLES.values() for t in ts) + ")"
_NAME = r"\p{Lu}[\p{L}'’\-]*"

_INTRO = "(?iu:" + "|".join(INTRODUCTIONS) + "):?"
_PARTICLE = "(?:" + "|".join(PARTICLES) + ")"
#: What stands before a person's names and stays.
_HEAD = rf"(?:{_TITLE}\.?(?:[ \t]+(?iu:{'|'.join(d.replace('.', r'\.') for d in DEGREES)}|{_TITLE})\.?){{0,3}}|{_INTRO})[ \t]+"
_PARTICLES = rf"(?:{_PARTICLE}[ \t]+){{0,3}}"
_GIVEN = "(?:" + "|".join(n for names in GIVEN.values() for n in names) + ")"


def _starts(*words: str) -> str:
    """What words begin with: tells most places apart before the words are tried."""
    return "[" + "".join(sorted({c for w in words for c in (w[0].upper(), w[0].lower())})) + "]"


_TITLES = [t for ts in TITLES.values() for t in ts]
_FIRST = _starts(*_TITLES, *INTRODUCTIONS)
_EDGE = r"(?![\p{L}\p{N}])"

EMAIL = r"[\p{L}\p{N}_][\p{L}\p{N}._%+\-]{0,255}@[\p{L}\p{N}\-]{1,255}(?:\.[\p{L}\p{N}\-]{1,255}){0,16}\.\p{L}{2,63}"
HEX = rf"[0-9A-Fa-f]{{32,64}}{_EDGE}"
IP = rf"(?<!\.)(?:{_OCTET}\.){{3}}{_OCTET}(?![\p{{L}}\p{{N}}]|\.[0-9])"
MAC = r"(?<!:)(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}(?![\p{L}\p{N}:])"
SSN = r"(?<!-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}\-])"
IBAN = rf"[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{4}}[0-9]{{7}}[A-Z0-9]{{0,18}}{_EDGE}"
CARD = rf"(?:[0-9]{{13,19}}|[0-9]{{4}}[ \-][0-9]{{4}}[ \-][0-9]{{4}}[ \-][0-9]{{1,7}}|[0-9]{{4}}[ \-][0-9]{{6}}[ \-][0-9]{{5}}){_EDGE}"
PHONE = (
    rf"(?<!\+)(?:\+?1[ .\-]?)?(?:\([0-9]{{3}}\)[ .\-]?|[0-9]{{3}}[ .\-])[0-9]{{3}}[ .\-][0-9]{{4}}{_EDGE}"
    rf"|\+(?=(?:[ .\-]?\(?[0-9]\)?){{8}})[0-9]{{1,3}}(?:[ .\-]?\(?[0-9]{{1,5}}\)?){{2,5}}{_EDGE}|0[0-9]{{2,4}}[ /\-][0-9]{{5,8}}{_EDGE}"
)
#: What keys of well-known services begin with.
PREFIX = "(?:AKIA|ASIA|AIza|sk-|gh[pousr]_|xox[abprs]-)"
TOKEN = rf"(?:(?:AKIA|ASIA)[0-9A-Z]{{16}}|AIza[0-9A-Za-z_\-]{{35}}|sk-[A-Za-z0-9_\-]{{20,200}}|gh[pousr]_[A-Za-z0-9]{{30,255}}|xox[abprs]-[A-Za-z0-9\-]{{10,250}}){_EDGE}"
PERSON = rf"(?={_FIRST}){_HEAD}{_PARTICLES}{_NAME}(?:[ \t]+{_PARTICLES}{_NAME}){{0,2}}|(?=\p{{Lu}}){_GIVEN}(?:-{_NAME})?[ \t]+{_PARTICLES}{_NAME}"
_BORN = rf"(?={_starts(*BORN)})(?iu:{'|'.join(w.replace('.', r'\.') for w in BORN)}):?[ \t]{{1,2}}"
BIRTH = rf"{_BORN}(?:[0-9]{{1,2}}[./\-][0-9]{{1,2}}[./\-](?:19|20)[0-9]{{2}}|(?:19|20)[0-9]{{2}}-[0-9]{{1,2}}-[0-9]{{1,2}}){_EDGE}"
STREET = (
    rf"[0-9]{{1,5}} (?:\p{{Lu}}[\p{{L}}'’\-]{{2,40}} ){{1,3}}(?:{'|'.join(STREETS)}){_EDGE}"
    rf"|(?=\p{{Lu}})[\p{{L}}\-]{{2,40}}(?:{'|'.join(STREET_ENDS)}) [0-9]{{1,4}}[a-z]?{_EDGE}"
)
SECRET = r"""(?<=["'])(?<=(?i:token|secret|password|passwd|api[_\-]?key)\s{0,2}[=:]\s{0,2}["'])[^"'\s]{6,}"""
#: In the order in which they are tried.
PATTERNS = (("email", EMAIL), ("hex", HEX), ("ip", IP), ("mac", MAC), ("ssn", SSN), ("iban", IBAN), ("card", CARD), ("phone", PHONE), ("token", TOKEN), ("birth", BIRTH), ("street", STREET), ("person", PERSON))
#: All but secrets begin after anything but a letter or a digit.
ENTITY = r"(?<![\p{L}\p{N}])(?:" + "|".join(p for _, p in PATTERNS) + ")|" + SECRET
#: What every entity has in it, cheap to look for.
HINT = rf"[0-9@]|[=:]\s{{0,2}}[\"']|{PREFIX}|(?={_FIRST})(?<![\p{{L}}\p{{N}}])(?:{_TITLE}\.?|{_INTRO})[ \t]|(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}]){_GIVEN}[ \t\-]"
#: Numbers have their format put back by ``_refill``.
_NUMBERS = ("card", "phone", "ssn")


def kind_of(e: Column) -> Column:
    """The kind of an entity that ENTITY matched: the first pattern that matches all of it; a secret if none does."""
    found = F.lit("secret")
    for kind, pattern in reversed(PATTERNS):
        found = F.when(e.rlike(rf"\A(?:{pattern})\z"), kind).otherwise(found)
    return found


def _digits(e: Column) -> Column:
    return F.regexp_replace(e, "[^0-9]", "")


def _names(e: Column) -> Column:
    """A person's names and the particles between them, without what stands before."""
    return F.split(F.regexp_replace(e, rf"\A{_HEAD}", ""), r"[ \t]+")


def _birthday(e: Column) -> Column:
    """A date of birth as year, month, day; the middle one of three is the month."""
    parts = F.split(F.regexp_replace(e, rf"\A{_BORN}", ""), r"[./\-]")
    part = lambda i: F.lpad(F.element_at(parts, i), 2, "0")
    year_first = F.length(F.element_at(parts, 1)) == 4
    return F.concat_ws("-", F.element_at(parts, F.when(year_first, 1).otherwise(3)), part(2), F.lpad(F.element_at(parts, F.when(year_first, 3).otherwise(1)), 2, "0"))


def _script(name: Column) -> Column:
    return F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")


def _gender(e: Column) -> Column:
    title = lambda g: e.rlike("^(?iu:" + "|".join(TITLES[g]) + r")\.?[ \t]")
    first = F.lower(F.element_at(_names(e), 1))
    known = lambda g: first.isin([n.lower() for key, names in GIVEN.items() if key.endswith(g) for n in names])
    return F.when(title("f"), "f").when(title("m"), "m").when(known("_f"), "f").when(known("_m"), "m").otherwise("x")


def units(e: Column) -> Column:
    """The units of an entity, as texts of kind and canonical form; the empty text for a particle of a name."""
    kind = kind_of(e)
    names = _names(e)
    group = F.concat(_gender(e), F.lit("|"))
    named = F.transform(names, lambda x, i: F.when(x.rlike(rf"\A{_PARTICLE}\z"), "").otherwise(F.concat(F.when(i == F.size(names) - 1, F.lit("family|")).otherwise(F.concat(F.lit("given_"), group)), F.lower(x))))
    digits = _digits(e)
    number = F.when((kind == "phone") & (F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).otherwise(digits)
    abroad = (kind == "phone") & e.startswith("+") & ~((F.length(digits) == 11) & digits.startswith("1"))
    one = F.when(abroad, F.concat(F.lit("+"), digits)).when(kind.isin(*_NUMBERS), number).when(kind.isin("secret", "iban", "token"), e).when(kind == "birth", _birthday(e)).otherwise(F.lower(e))
    return F.when(kind == "person", named).otherwise(F.array(F.concat(kind, F.lit("|"), one)))


def _at(hashed: Column, i: Column) -> Column:
    """Byte i of a long hex text, as a number."""
    return F.conv(F.substr(hashed, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _alike(text: Column, hashed: Column, start: int = 0) -> Column:
    """A text with each letter and digit replaced by one of its class and case."""
    latin, cyrillic = F.lit("abcdefghijklmnopqrstuvwxyz"), F.lit("абвгдежзиклмнопрстуфхцчш")

    def char(c: Column, i: Column) -> Column:
        byte = _at(hashed, i + start)
        low = F.when(c.rlike(r"\p{IsCyrillic}"), F.substr(cyrillic, byte % 24 + 1, F.lit(1))).otherwise(F.substr(latin, byte % 26 + 1, F.lit(1)))
        letter = F.when(c == F.lower(c), low).otherwise(F.upper(low))
        return F.when(c.rlike("[0-9]"), (byte % 10).cast("string")).when(c.rlike(r"\p{L}"), letter).otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), char), "")


def _luhn_sum(digits: Column) -> Column:
    """The Luhn sum of digits, the last one counting once."""
    n = F.length(digits)
    part = lambda i: F.substr(digits, i, F.lit(1)).cast("int")
    value = lambda i: F.when(F.pmod(n - i, F.lit(2)) == 1, F.when(part(i) * 2 > 9, part(i) * 2 - 9).otherwise(part(i) * 2)).otherwise(part(i))
    return F.aggregate(F.transform(F.sequence(F.lit(1), n), value), F.lit(0), lambda a, x: a + x)


def _mod97(text: Column) -> Column:
    """The remainder of a text of digits and capitals (A is 10) by 97."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), lambda a, c: F.pmod(F.when(c.rlike("[0-9]"), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55), F.lit(97)))


def surrogate(unit: Column, attempt: Column, key: str = KEY) -> Column:
    """The candidate for a unit (kind|canonical form) at an attempt."""
    kind, value = F.substring_index(unit, "|", 1), F.regexp_replace(unit, r"^[^|]*\|(?:[mfx]\|)?", "")
    seed = F.concat_ws("|", F.lit(key), unit, attempt.cast("string"))
    hashed = F.concat(F.sha2(seed.cast("binary"), 256), F.sha2(F.concat(F.lit("+"), seed).cast("binary"), 256))
    n = F.length(value)
    digits = _alike(value, hashed)
    # a card keeps its first digit; a valid one stays valid
    body = F.concat(F.substring(value, 1, 1), F.substr(digits, F.lit(2), n - 2))
    check = F.pmod(F.lit(10) - _luhn_sum(F.concat(body, F.lit("0"))) % 10, F.lit(10)).cast("string")
    card = F.concat(body, F.when(_luhn_sum(value) % 10 == 0, check).otherwise(F.substr(digits, n, F.lit(1))))
    byte = lambda k, most=256, least=0: (_at(hashed, F.lit(k)) % most + least).cast("string")
    ip = F.when(attempt == 0, F.concat_ws(".", F.lit("198"), byte(0, 2, 18), byte(1), byte(2))).otherwise(F.concat_ws(".", byte(0, 15, 240), byte(1), byte(2), byte(3, 254, 1)))
    # ten digits: the first one and exchange 555, later an area that no number has; those of other countries keep two digits of the code
    ten = F.when(attempt < 4, F.concat(F.substring(value, 1, 1), F.substring(digits, 2, 2), F.lit("555"), F.substring(digits, 7, 4))).otherwise(F.concat(byte(1, 2), F.substring(digits, 2, 9)))
    phone = F.when(value.startswith("+") & (attempt < 16), F.concat(F.substring(value, 1, 3), F.substr(digits, F.lit(4)))).when(n == 10, ten).otherwise(digits)
    ssn = F.concat(F.lit("9"), F.substring(digits, 2, 2), byte(5, 5), F.substr(digits, F.lit(5)))
    mac = F.concat(F.substring(hashed, 1, 1), F.substr(F.lit("26ae"), _at(hashed, F.lit(7)) % 4 + 1, F.lit(1)), F.lit(":"), F.concat_ws(":", *[F.substring(hashed, 2 * k + 1, 2) for k in range(1, 6)]))
    land, account = F.substring(value, 1, 2), F.substr(digits, F.lit(5))
    valid = _mod97(F.concat(F.substr(value, F.lit(5)), F.substring(value, 1, 4))) == 1
    iban = F.concat(land, F.when(valid, F.lpad((F.lit(98) - _mod97(F.concat(account, land, F.lit("00")))).cast("string"), 2, "0")).otherwise(F.substring(digits, 3, 2)), account)
    start = F.regexp_extract(value, rf"\A{PREFIX}", 0)
    token = F.concat(start, F.substr(digits, F.length(start) + 1))
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    of_domain = F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), domain).cast("binary"), 256)
    more = F.when(attempt > 0, F.substring(hashed, 65, 8)).otherwise("")
    last = F.substring_index(domain, ".", -1)
    email = F.concat(_alike(local, hashed), more, F.lit("@"), _alike(F.lit("abcdefgh"), of_domain), F.lit(".example."), F.when(last.isin("com", "net", "org"), last).otherwise("com"))
    year = F.conv(F.substring(hashed, 1, 7), 16, 10).cast("int") % F.when(attempt == 0, 100).otherwise(900)
    two = lambda k: F.lpad(byte(k, 12, 1), 2, "0")
    birth = F.concat_ws("-", (F.when(attempt == 0, 1800).otherwise(1000) + year).cast("string"), two(4), two(5))
    longer = F.when(attempt > 2, F.translate(F.substring(hashed, 65, 6), "0123456789", "ghijklmnop")).otherwise("")
    before = rf"(?iu)\A(.*?)( (?:{'|'.join(STREETS)})|(?:{'|'.join(STREET_ENDS)}) .*)\z"
    name, rest = F.regexp_extract(value, before, 1), F.regexp_extract(value, before, 2)
    street = F.concat(_alike(name, hashed), longer, F.when(rest.startswith(" "), rest).otherwise(F.concat(F.substring_index(rest, " ", 1), F.lit(" "), _alike(F.substring_index(rest, " ", -1), hashed, 40))))
    script, gender = _script(value), F.regexp_extract(unit, r"\|([mfx])\|", 1)

    def made(of: str, end: str) -> Column:
        count = F.lit(3) + attempt if end == "_x" else F.lit(2) + attempt
        spoken = F.transform(F.sequence(F.lit(1), count), lambda i: F.element_at(F.array(*[F.lit(s) for s in SYLLABLES[of]]), _at(hashed, i) % len(SYLLABLES[of]) + 1))
        return F.concat(F.array_join(spoken, ""), F.lit(ENDINGS[of + end]))

    def given(of: str, end: str) -> Column:
        pool = [n.lower() for k, names in GIVEN.items() if k.startswith(of) and (end == "_x" or k.endswith(end)) for n in names]
        first = F.element_at(F.array(*[F.lit(n) for n in pool]), F.conv(F.substring(hashed, 1, 7), 16, 10).cast("int") % len(pool) + 1)
        return F.when(attempt == 0, first).otherwise(made(of, end))

    per_script = lambda f: F.when(script == "cyrillic", f("cyrillic")).otherwise(f("latin"))
    names = F.when(kind == "family", per_script(lambda s: made(s, "_x"))).when(gender == "f", per_script(lambda s: given(s, "_f"))).when(gender == "m", per_script(lambda s: given(s, "_m"))).otherwise(per_script(lambda s: given(s, "_x")))
    return (
        F.when(kind == "email", email).when(kind == "hex", F.substr(hashed, F.lit(1), n)).when(kind == "ip", ip)
        .when(kind == "birth", birth).when(kind == "street", street).when(kind == "mac", mac).when(kind == "iban", iban).when(kind == "token", token)
        .when(kind == "card", card).when(kind == "phone", phone).when(kind == "ssn", ssn).when(kind == "secret", digits).otherwise(names)
    )


def assign(found: DataFrame, key: str = KEY) -> DataFrame:
    """Distinct units (column unit) to surrogates that differ from each other and from every unit."""
    space = lambda c: F.when(F.substring_index(c, "|", 1).startswith("given"), "given").otherwise(F.substring_index(c, "|", 1))
    value = F.regexp_replace("unit", r"^[^|]*\|(?:[mfx]\|)?", "")
    real = found.select(space(F.col("unit")).alias("space"), value.alias("surrogate")).distinct()
    # by number: rows as short as these would else all be made in one task
    tasks = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pending = found.select("unit").repartition(tasks, "unit").withColumn("attempt", F.lit(0))
    done = None
    for _ in range(ROUNDS):
        tried = pending.withColumn("surrogate", surrogate(F.col("unit"), F.col("attempt"), key)).withColumn("space", space(F.col("unit")))
        free = tried.join(real, ["space", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done, ["space", "surrogate"], "left_anti")
        first = free.groupBy("space", "surrogate").agg(F.min("unit").alias("unit"))
        won = checkpoint(first.select("space", "surrogate", "unit"))
        done = won if done is None else done.unionByName(won)
        pending = checkpoint(pending.join(won.select("unit"), "unit", "left_anti").withColumn("attempt", F.col("attempt") + 1)).repartition(tasks, "unit")
        if pending.isEmpty():
            return done.select("unit", "surrogate")
    raise ValueError(f"no free surrogates after {ROUNDS} rounds: the space of some kind is used up")


def _refill(e: Column, number: Column) -> Column:
    """A number's new digits (a country code's old ones before them) in the format of a mention."""
    old, number = _digits(e), _digits(number)
    full = F.concat(F.substr(old, F.lit(1), F.length(old) - F.length(number)), number)
    chars = F.filter(F.split(e, ""), lambda c: c != "")
    return F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[0-9]"), F.substr(full, F.length(_digits(F.substr(e, F.lit(1), i + 1))), F.lit(1))).otherwise(c)), "")


def _cased(new: Column, old: Column) -> Column:
    return F.when((F.upper(old) == old) & (F.lower(old) != old) & (F.length(old) > 1), F.upper(new)).otherwise(new)


def replacement(e: Column, kind: Column, own: Column, known: Column) -> Column:
    """What stands for a mention of a kind with units, by the map of its row's units."""
    one = known[F.element_at(own, 1)]
    capital = lambda u: F.concat(F.upper(F.substring(known[u], 1, 1)), F.substring(known[u], 2, 1000))
    names = F.zip_with(own, _names(e), lambda u, x: F.when(u == "", x).otherwise(_cased(capital(u), x)))
    person = F.concat(F.regexp_extract(e, rf"\A{_HEAD}", 0), F.array_join(names, " "))
    year, month, day = (F.element_at(F.split(one, "-"), i) for i in (1, 2, 3))
    old = F.regexp_replace(e, rf"\A{_BORN}", "")
    mark = lambda i: F.element_at(F.regexp_extract_all(old, F.lit("[^0-9]"), 0), i)
    birth = F.concat(F.regexp_extract(e, rf"\A{_BORN}", 0), F.when(old.rlike(r"\A[0-9]{4}"), one).otherwise(F.concat(day, mark(1), month, mark(2), year)))
    chars = F.filter(F.split(one, ""), lambda c: c != "")
    street = F.array_join(F.transform(chars, lambda c, i: F.when(F.substr(e, i + 1, F.lit(1)).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c)), "")
    return (
        F.when(kind == "person", person).when(kind == "birth", birth).when(kind == "street", street).when(kind == "name", _cased(capital(F.element_at(own, 1)), e)).when(kind.isin(*_NUMBERS), _refill(e, one))
        .when(kind.isin("secret", "iban", "token"), one).otherwise(_cased(one, e))
    )


def _persons(found: Column) -> Column:
    """(name, lower-case name, unit) of the persons' names, family names first; particles and names of one letter left out."""
    titled = F.filter(found, lambda e: kind_of(e) == "person")
    each = F.flatten(F.transform(titled, lambda e: F.zip_with(_names(e), units(e), lambda x, u: F.struct((~u.startswith("family|")).alias("given"), x.alias("name"), F.lower(x).alias("low"), u.alias("unit")))))
    return F.array_sort(F.array_distinct(F.filter(each, lambda x: (F.length(x["name"]) > 1) & (x["unit"] != ""))))


def pseudonymise(docs: DataFrame, key: str = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text with surrogates, n_entities, kinds) of every row."""
    row, found, names, pattern, mention = (OWN + x for x in ("row", "found", "names", "pattern", "mention"))
    none = F.array().cast("array<string>")
    thin = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    read = written(thin.withColumn(found, F.when(F.col("text").rlike(HINT), F.regexp_extract_all("text", F.lit(ENTITY), 0)).otherwise(none)))
    plain = read.filter(F.size(found) == 0).select(id_col, "text", F.lit(0).cast("long").alias("n_entities"), F.lit("").alias("kinds"))
    rows = read.filter(F.size(found) > 0).withColumn(row, F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")), "text").cast("binary")))
    # the names that stand bare: the row's own pattern
    rows = rows.withColumn(names, _persons(F.col(found)))
    bare = F.array_join(F.array_distinct(F.flatten(F.transform(names, lambda x: F.array(x["name"], F.upper(x["name"]))))), "|")
    rows = rows.withColumn(pattern, F.when(F.size(names) == 0, ENTITY).otherwise(F.concat(F.lit(ENTITY + r"|(?<![\p{L}\p{N}])(?:"), bare, F.lit(r")(?![\p{L}\p{N}])"))))
    rows = rows.select(id_col, row, names, F.split("text", F.col(pattern), -1).alias("parts"), F.when(F.size(names) == 0, F.col(found)).otherwise(F.regexp_extract_all("text", F.col(pattern), 0)).alias(found))

    def of(e: Column) -> Column:
        hit = F.try_element_at(F.filter(names, lambda x: x["low"] == F.lower(e)), F.lit(1))
        return F.when(hit.isNotNull(), F.struct(e.alias("e"), F.lit("name").alias("kind"), F.array(hit["unit"]).alias("units"))).otherwise(F.struct(e.alias("e"), kind_of(e).alias("kind"), units(e).alias("units")))

    rows = written(rows.select(id_col, row, "parts", F.transform(found, of).alias(mention)))
    mentions = checkpoint(rows.select(row, F.explode(F.array_distinct(F.flatten(F.transform(mention, lambda m: m["units"])))).alias("unit")).filter("unit <> ''").distinct())
    counts = checkpoint(mentions.groupBy("unit").agg(F.count(F.lit(1)).alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    chosen = assign(counts, key)
    known = salted_join(mentions, chosen, "unit", heavy_keys(counts, "unit", "n", total), F.col(row), "inner").groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct("unit", "surrogate"))).alias(f"{OWN}known"))
    # rows of one id and text are one key, however many they are
    alike = checkpoint(rows.groupBy(row).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    told = salted_join(rows, known, row, heavy_keys(alike, row, "n", alike.agg(F.sum("n")).first()[0] or 0), F.monotonically_increasing_id(), "inner")
    new = F.array_join(F.zip_with("parts", F.transform(mention, lambda m: replacement(m["e"], m["kind"], m["units"], F.col(f"{OWN}known"))), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    kinds = F.array_sort(F.array_distinct(F.transform(mention, lambda m: F.when(m["kind"] == "name", "person").otherwise(m["kind"]))))
    told = told.select(id_col, new.alias("text"), F.size(mention).cast("long").alias("n_entities"), F.array_join(kinds, ",").alias("kinds"))
    return plain.unionByName(told)
