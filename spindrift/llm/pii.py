"""Personal data replaced by keyed surrogates, in DataFrame operations only.

One regular expression finds the entities of a text, left to right. Every entity has a canonical form
(lower-cased address, bare digits, ...), so that all spellings of one entity get one surrogate wherever
they occur (coreference). A surrogate is derived from SHA-256 of key, type, canonical form and a round
number, and has its entity's type and format: digits become digits, letters letters of the same case,
separators stay, card numbers keep their length and first digit and stay valid under Luhn's rule,
addresses move to reserved domains, IP addresses to the reserved class E, names keep gender and script.

Distinctness: surrogates of all distinct entities are compared in one aggregation; of several entities with
one surrogate the smallest keeps it, the others, and any surrogate that is itself an entity of the input,
are derived anew with the next round number until no collision is left. From round ``GROW`` on a surrogate gets a digit more each
round (a domain's name has it before the @, an IP address after a colon), so that even an entity with a single letter or digit among
thousands of its like finds one. A run of marks without letters or digits (a blank to fill in) is no secret.

Only entities and the texts that hold them are shuffled, these by a number of their row, so that copies
of one text don't meet in one task; clean texts pass through their scan unchanged.
Nulls stay null, empty texts empty, an empty table empty; repeated rows are treated alike; a column that has the
name of the count is replaced, all others pass through. Texts are never shortened. Names are found after a title,
after words that announce one ("my name is", "Contact") where two capitalised words follow, or by one of some
common given names: there is no model of names here, so others are missed (README).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_table, let, write_table

#: Titles by gender (or of either), words that announce a name, and given names by gender and script, to find and to make names.
TITLES = {
    "m": ("Mr", "Herr", "Señor", "Monsieur", "Sir", "г-н", "κ"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "г-жа", "κα"),
    "": ("Dr", "Prof", "Doctor", "Professor"),
}
CUES = ("my name is", "My name is", "ich heiße", "Ich heiße", "me llamo", "Me llamo", "je m'appelle", "Je m'appelle", "меня зовут", "Меня зовут", "με λένε", "Με λένε", "Name:", "Dear", "Contact", "contact", "Call", "call", "Signed", "signed")
GIVEN = {
    ("m", "latin"): tuple("Ahmed Alan Andreas Antonio Carlos Charles Christian Daniel David Diego Francisco Frank Hans Henry Jack James Jean John Jorge José Juan Klaus Li Luis Mark Martin Michael Miguel Mohammed Omar Paul Peter Pierre Raj Robert Stefan Thomas Wei William Wolfgang".split()),
    ("f", "latin"): tuple("Aisha Alice Anna Ana Carmen Charlotte Claire Elizabeth Emily Emma Fatima Helen Ingrid Isabel Jane Jennifer Julia Karen Katrin Laura Linda Lucia Margaret Maria María Marie Mary Mei Monika Nicole Olivia Patricia Priya Sabine Sarah Sofia Sophie Susan Ursula Yuki".split()),
    ("m", "cyrillic"): ("Александр", "Алексей", "Андрей", "Дмитрий", "Иван", "Михаил", "Николай", "Пётр", "Сергей", "Юрий"),
    ("f", "cyrillic"): ("Анна", "Елена", "Екатерина", "Ирина", "Мария", "Наталья", "Ольга", "Светлана", "Татьяна", "Юлия"),
    ("m", "greek"): ("Γιάννης", "Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος"),
    ("f", "greek"): ("Άννα", "Ελένη", "Ιωάννα", "Κατερίνα", "Μαρία", "Σοφία"),
}
#: Syllables of made-up surnames by script.
SYLLABLES = {
    "latin": ("bar", "cor", "dal", "fen", "gor", "hal", "kel", "lan", "mar", "nor", "pel", "ran", "sel", "tor", "van", "wel"),
    "cyrillic": ("бар", "вол", "гор", "дал", "кел", "лан", "мар", "нор", "пел", "ран", "сел", "тор", "фен", "хар", "цел", "шор"),
    "greek": ("βαρ", "γορ", "δελ", "καλ", "λαν", "μαρ", "νικ", "παλ", "ραν", "σελ", "τορ", "φεν", "χαλ", "ψαρ", "ζαν", "θερ"),
}

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_GIVEN = "|".join(n for ns in GIVEN.values() for n in ns)
_TITLE = "|".join(t for ts in TITLES.values() for t in ts)
_CUE = "|".join(CUES)
_NAME = r"\p{Lu}[\p{Ll}'’-]{1,40}"
_SECRET = r"(?i:password|passwd|pwd|secret|token|api_key|apikey)[ ]{0,1}[=:][ ]{0,1}[\"']{0,1}"
#: Type -> Java pattern; together they are one alternation, tried in this order.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "ip": rf"(?=[0-9])(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9])(?!\.[0-9])",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"(?=[3-6])(?<![0-9])(?:[3-6][0-9]{12,18}|[3-6][0-9]{3}(?:[ -][0-9]{4}){3})(?![0-9])",
    "ssn": r"(?=[0-9])(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?=[0-9+(])(?:(?<![0-9+(])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])|(?<![0-9+(])\+[0-9]{1,3}[ .-]?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?<![0-9+])\+[0-9](?:[ .()-]{0,2}[0-9]){7,14}(?![0-9]))",
    "access_key": r"\bA[KS]IA[A-Z0-9]{16}\b",
    "secret": rf"(?<=[=:\"'\x20])(?=[A-Za-z0-9_+/-]{{8}})(?<={_SECRET})(?=[_+/-]*+[A-Za-z0-9])[A-Za-z0-9_+/-]{{8,}}+",
    "name": rf"(?=\p{{Lu}})(?<!\p{{L}})(?:(?<=\b(?:{_TITLE})\.?\x20){_NAME}(?:\x20{_NAME})?|(?<=\b(?:{_CUE})\x20)(?!(?:{_TITLE})\b){_NAME}\x20{_NAME}|(?:{_GIVEN})\x20{_NAME})",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A cheap test that every text with an entity passes: one look at a character's class decides nearly everywhere.
MAYBE = rf"[0-9@=:]|(?=[A-Za-z\u0370-\u044F])(?<!\p{{L}})(?:A[KS]IA|(?:{_TITLE})\.?\x20\p{{Lu}}|(?:{_GIVEN}|{_CUE})\x20\p{{Lu}})"
#: Rounds of collision checks after which surrogates grow by a digit a round, so that they can't be used up.
GROW = 3


def luhn_sum(digits: Column, doubled_from: int) -> Column:
    """Luhn's sum of a digit string; positions from the right with parity ``doubled_from`` are doubled."""
    xs = F.transform(F.reverse(F.split(digits, "")), lambda c: F.expr("0") + F.coalesce(F.try_to_number(c, F.lit("9")).cast("int"), F.lit(0)))
    terms = F.transform(xs, lambda x, i: F.when(i % 2 == doubled_from, x * 2 - F.when(x > 4, 9).otherwise(0)).otherwise(x))
    return F.aggregate(terms, F.lit(0), lambda a, x: a + x)


def kind(value: Column) -> Column:
    """Type of a found entity: the first pattern that matches all of it; names and secrets have no context here."""
    tests = [(t, F.regexp_like(value, F.lit(f"^(?:{PATTERNS[t]})$"))) for t in PATTERNS if t not in ("secret", "name")]
    is_name = F.regexp_like(value, F.lit(rf"^{_NAME}(?:\x20{_NAME})?$")) & ~value.rlike("[0-9]")
    return reduce(lambda out, x: F.when(x[1], F.lit(x[0])).otherwise(out), reversed(tests), F.when(is_name, F.lit("name")).otherwise(F.lit("secret")))


def canonical(t: Column, value: Column) -> Column:
    return F.when(t.isin("card", "phone", "ssn"), F.regexp_replace(value, "[^0-9]", "")).when(t.isin("email"), F.lower(value)).when(t == "iban", F.regexp_replace(value, " ", "")).otherwise(value)


def entities(text: Column) -> Column:
    """Entities of a text in order. Card numbers must pass Luhn's check; others of that shape stay."""
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def _pick(options: tuple[str, ...], code: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (code % len(options) + 1).cast("int"))


def surrogate(t: Column, value: Column, canon: Column, gender: Column, nonce: Column, key: str) -> Column:
    """The replacement of one spelling; what varies comes from the canonical form alone."""
    seed = F.concat_ws("|", F.lit(key), t, canon, nonce.cast("string"))
    stream = F.concat(*(F.sha2(F.concat(seed, F.lit(f"|{i}")), 256) for i in range(2)))
    code = lambda h, i: F.conv(F.substr(h, (i % 60) * 2 + 1, F.lit(2)), 16, 10).cast("int")

    def scramble(v: Column, h: Column) -> Column:
        """Letters and digits renewed in place; the n-th one depends on n, so separators don't matter."""
        chars = F.split(v, "")

        def renew(c: Column, i: Column) -> Column:
            nth = F.length(F.regexp_replace(F.substr(v, F.lit(1), i + 1), "[^A-Za-z0-9]", ""))
            k = code(h, nth)
            return F.when(c.rlike("[0-9]"), F.chr(k % 10 + 48)).when(c.rlike("[a-z]"), F.chr(k % 26 + 97)).when(c.rlike("[A-Z]"), F.chr(k % 26 + 65)).otherwise(c)

        return F.array_join(F.transform(chars, renew), "")

    # SHA-256 has 64 hexadecimal digits; each round of growth shows one more of them, as a decimal one
    longer = F.substr(F.translate(F.sha2(F.concat(seed, F.lit("|more")), 256), "abcdef", "012345"), F.lit(1), F.greatest(nonce - GROW, F.lit(0)))

    def email(h: Column) -> Column:
        host = F.concat(F.lit("mail"), F.lpad(F.conv(F.substr(h, F.lit(121), F.lit(4)), 16, 10), 5, "0"), F.lit(".example."), _pick(("com", "net", "org"), code(h, F.lit(59))))
        return F.concat(scramble(F.substring_index(value, "@", 1), h), longer, F.lit("@"), host)

    def ip(h: Column) -> Column:
        return F.concat_ws(".", (code(h, F.lit(0)) % 15 + 240).cast("string"), *(code(h, F.lit(i)).cast("string") for i in (1, 2, 3)))

    def card(h: Column) -> Column:
        digits = F.regexp_replace(value, "[^0-9]", "")
        body = F.concat(F.substr(digits, F.lit(1), F.lit(1)), F.substr(scramble(digits, h), F.lit(2), F.length(digits) - 2))
        whole = let(body, lambda b: F.concat(b, ((F.lit(10) - luhn_sum(b, 0) % 10) % 10).cast("string")))
        return F.when(value.rlike("[ -]"), F.regexp_replace(whole, "([0-9]{4})(?=[0-9])", F.concat(F.lit("$1"), F.regexp_extract(value, "[ -]", 0)))).otherwise(whole)

    def phone(h: Column) -> Column:
        country = F.regexp_extract(value, r"^\+(?:[17]|[0-9]{2})", 0)  # the same digits in every spelling
        return F.concat(country, F.substr(scramble(value, h), F.length(country) + 1))

    def name(h: Column) -> Column:
        script = F.when(canon.rlike(r"\p{IsCyrillic}"), "cyrillic").when(canon.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
        out = F.lit("")
        for s, sy in SYLLABLES.items():
            given = F.when(gender == "f", _pick(GIVEN["f", s], code(h, F.lit(0)))).when(gender == "m", _pick(GIVEN["m", s], code(h, F.lit(0)))).otherwise(_pick(GIVEN["f", s] + GIVEN["m", s], code(h, F.lit(0))))
            # a syllable more with each round, so that no number of distinct names exhausts the surnames
            last = F.initcap(F.array_join(F.transform(F.sequence(F.lit(1), nonce + 4), lambda i: _pick(sy, code(h, i))), ""))
            out = F.when(script == s, F.when(value.contains(" "), F.concat(given, F.lit(" "), last)).otherwise(last)).otherwise(out)
        return out

    def made(h: Column) -> Column:
        fixed = F.when(t == "access_key", F.concat(F.substr(value, F.lit(1), F.lit(4)), F.substr(scramble(value, h), F.lit(5)))).when(t == "iban", F.concat(F.substr(value, F.lit(1), F.lit(2)), F.substr(scramble(value, h), F.lit(3)))).when(t == "ssn", F.concat(F.lit("9"), F.substr(scramble(value, h), F.lit(2))))
        out = fixed.when(t == "email", email(h)).when(t == "ip", ip(h)).when(t == "card", card(h)).when(t == "phone", phone(h)).when(t == "name", name(h)).otherwise(scramble(value, h))
        # the large expression stands here once
        return F.concat(out, F.when((nonce <= GROW) | t.isin("email", "name"), "").when(t == "ip", F.concat(F.lit(":"), longer)).otherwise(longer))

    return let(stream, made)


def genders(text: Column, value: Column) -> Column:
    """Gender of a name by its title or given name; null if neither tells."""
    first = F.substring_index(value, " ", 1)
    own = reduce(lambda out, g: F.when(first.isin(*(n for (k, _), ns in GIVEN.items() if k == g for n in ns)), F.lit(g)).otherwise(out), ("m", "f"), F.lit(None).cast("string"))
    titled = lambda g: F.regexp_like(text, F.concat(F.lit(rf"\b(?:{'|'.join(TITLES[g])})\.?\x20\Q"), value, F.lit(r"\E")))
    return F.coalesce(own, F.when(titled("m"), F.lit("m")).when(titled("f"), F.lit("f")))


def mapping(found: DataFrame, key: str) -> DataFrame:
    """(type, value, gender) of all spellings -> with ``canon`` and ``surrogate``; distinct entities stay distinct.

    Collisions are looked for among canonical forms, which all spellings of one entity share."""
    spelt = found.groupBy("type", "value").agg(F.min("gender").alias("gender")).withColumn("canon", canonical(F.col("type"), F.col("value")))
    # one spelling stands for each entity in the collision checks
    one = spelt.groupBy("type", "canon").agg(F.min("value").alias("value"), F.min("gender").alias("gender")).withColumn("nonce", F.lit(0))
    originals = spelt.select(F.col("canon").alias("core")).distinct().withColumn("taken", F.lit(True))
    one = last = write_table(one, "pii-entities")
    while True:
        s = one.withColumn("core", canonical(F.col("type"), surrogate(F.col("type"), F.col("value"), F.col("canon"), F.col("gender"), F.col("nonce"), key)))
        # several entities with one surrogate: the smallest keeps it
        owner = s.groupBy("core").agg(F.min(F.struct("nonce", "type", "canon")).alias("o"))
        judged = s.join(owner, "core").join(originals, "core", "left")
        again = (F.struct("nonce", "type", "canon") != F.col("o")) | F.coalesce("taken", F.lit(False))
        judged = write_table(judged.select("type", "canon", "value", "gender", "nonce", again.alias("again")), "pii-round")
        drop_table(last)
        last = judged
        if judged.filter("again").limit(1).count() == 0:
            one = judged
            break
        one = judged.withColumn("nonce", F.col("nonce") + F.col("again").cast("int")).drop("again")
    nonces = one.select("type", "canon", "nonce", F.col("gender").alias("g"))
    whole = spelt.join(nonces, ["type", "canon"]).withColumn("gender", F.coalesce("g", "gender"))
    return whole.select("type", "value", "canon", surrogate(F.col("type"), F.col("value"), F.col("canon"), F.col("gender"), F.col("nonce"), key).alias("surrogate"))


def pseudonymise(df: DataFrame, key: str, text: str = "text", count: str = "n_entities") -> DataFrame:
    """Replace the entities in ``text`` by surrogates and add ``count``, the entities replaced."""
    own = [c for c in df.columns if c != count]
    df = df.select(*own)
    t = F.col(text)
    dirty = F.when(t.rlike(MAYBE), t.rlike(PATTERN)).otherwise(F.lit(False))
    clean = df.filter(~dirty).withColumn(count, F.lit(0).cast("long"))
    # written once: the row number is fixed from here on, and the expensive pattern has been run
    held = df.filter(dirty).withColumn("__sd_row", F.monotonically_increasing_id()).withColumn("__sd_found", entities(t))
    held = write_table(held, "pii-texts")
    seen = held.select("__sd_row", t.alias("text"), F.explode(F.array_distinct("__sd_found")).alias("value")).withColumn("type", kind(F.col("value")))
    # a number that fails Luhn's check is no card, but a secret if the text calls it one
    failed = (F.col("type") == "card") & (luhn_sum(F.regexp_replace("value", "[^0-9]", ""), 1) % 10 != 0)
    secret = F.regexp_like("text", F.concat(F.lit(_SECRET), F.lit(r"\Q"), F.col("value"), F.lit(r"\E")))
    seen = seen.withColumn("type", F.when(failed, F.when(secret, F.lit("secret"))).otherwise(F.col("type"))).filter("type is not null")
    gender = F.when(F.col("type") == "name", genders(F.col("text"), F.col("value")))
    seen = write_table(seen.select("__sd_row", "type", "value", gender.alias("gender")), "pii-found")
    spelt = mapping(seen, key)
    pairs = seen.join(spelt, ["type", "value"]).groupBy("__sd_row").agg(F.map_from_entries(F.collect_list(F.struct("value", "surrogate"))).alias("__sd_map"))
    joined = held.join(pairs, "__sd_row", "left").withColumn("__sd_map", F.coalesce("__sd_map", F.create_map().cast("map<string,string>")))
    swap = lambda v, m: F.coalesce(F.try_element_at(m, v), v)

    def rebuild(parts: Column) -> Column:
        return F.array_join(F.zip_with(parts, "__sd_found", lambda s, e: F.concat(s, F.coalesce(swap(e, F.col("__sd_map")), F.lit("")))), "")

    number = let(F.map_keys("__sd_map"), lambda known: F.size(F.filter("__sd_found", lambda e: F.array_contains(known, e))).cast("long"))
    changed = joined.select(*(let(F.split(t, PATTERN, -1), rebuild).alias(c) if c == text else F.col(c) for c in own), number.alias(count))
    return clean.unionByName(changed)
