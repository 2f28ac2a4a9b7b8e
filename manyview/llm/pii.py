r"""Surrogates for personal data (operator 9, DataFrame operations only).

Entities are found by patterns: e-mail addresses, secrets, IP addresses, phone, card and social security numbers, IBANs,
and names. A name is what follows a title or an introduction ("my name is"), or a given name of the lists below with a
capitalised word after it. Mentions of one entity have one canonical form (letters lower-cased, separators left out; secrets
keep both), so an entity has the same surrogate wherever and however it is written. A surrogate comes from SHA-512 over a key,
the type, the canonical form and an attempt number: digits become digits, letters letters and symbols symbols, e-mail domains
keep their last label, phone numbers their country code, card numbers and IBANs valid check digits, IP addresses stay IP
addresses, and names are drawn for the gender of the given name, else of the title, and for the script of the name (Latin, Greek,
Cyrillic; names in other scripts become Latin ones). A mention keeps its separators and its upper case.

Collision checks: over all entities of a type, a surrogate that two entities share, or that is an entity of the corpus itself,
is given up by all but the first, which try the next attempt, until none collide. Names grow by a syllable with each attempt and
all else by a character with each attempt after PLAIN_ATTEMPTS, so that no number of entities can use up a form.

Where mentions meet surrogates, those of an entity with a large share of all mentions are dealt over salts.

Defined results: a null text stays null and has no entities; rows with a null doc_id, repeated rows and rows that share a
doc_id are each rewritten; an empty table gives no rows; columns other than doc_id and text are not read. "Mr. Smith" and "Mr. John
Smith" count as two entities, as nothing in a text tells whether they are one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from manyview.llm.common import cut, table, text_or_empty
from manyview.operators.skew import hot_keys, joined_by_hot_key

#: The key of a session that sets none. It is public, so surrogates made with it can be recomputed by anyone.
KEY, KEY_SETTING = "a key that the caller should replace", "spark.manyview.pii.key"
PLAIN_ATTEMPTS = 3
#: Titles by the gender that they show; n: none.
TITLES = {
    "m": "Mr Monsieur Herr Señor Sr Don Sir Lord".split(),
    "f": "Mrs Ms Miss Mme Mlle Madame Frau Señora Sra Doña Lady".split(),
    "n": "Dr Prof Professor Doctor".split(),
}
#: Given names that surrogates are drawn from, and that show a name without a title.
GIVEN = {
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Martin Noah Oscar Paul Robert Simon Thomas Victor".split(),
    ("latin", "f"): "Anna Berta Clara Diana Emma Flora Greta Helena Irene Julia Karin Laura Maria Nina Olga Paula Rosa Sofia Teresa Vera".split(),
    ("greek", "m"): "Αλέξανδρος Βασίλης Γιώργος Δημήτρης Κώστας Νίκος".split(),
    ("greek", "f"): "Άννα Βασιλική Ελένη Κατερίνα Μαρία Σοφία".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Ева Инна Клара Лидия Мария Нина Ольга".split(),
}
#: Further common given names.
KNOWN = {
    "m": "James John Michael William Richard Joseph Charles Daniel Matthew Anthony Steven Andrew Peter Hans Klaus Jürgen Stefan Pierre Jean Jacques François José Juan Carlos Miguel Luis".split(),
    "f": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Margaret Lisa Nancy Sandra Ursula Monika Petra Claire Camille Nathalie Carmen Ana Lucía Isabel Marta".split(),
}
SYLLABLES = {
    "latin": "ba be bo da do fa ga go ha ho ka ko la le lo ma mo na no pa ra re ro sa so ta to va ve vo".split(),
    "greek": "βα γα δα θα κα λα μα να πα ρα σα τα βο γο δο κο λο μο νο πο ρο σο το".split(),
    "cyrillic": "ба бо ва во га до жа ка ко ла ло ма мо на но па ра ро са та".split(),
}
SYMBOLS = "!#$%&*+-=?@^_~"
PARTICLES = "von van de der du la di da del den ter dos"

_NAME = r"\p{Lu}(?:[\p{L}\-]++|['’](?!s\b)\p{L})++"
_PARTICLES = rf"(?:(?:{'|'.join(PARTICLES.split())}) )*+"
_FULL = rf"{_PARTICLES}{_NAME}(?: \p{{Lu}}\.)?(?: {_PARTICLES}{_NAME})?"
_TITLE = "|".join(form for titles in TITLES.values() for title in titles for form in (title, title.upper()))
_NAMED = {g: sorted({x for (_, gender), names in GIVEN.items() if gender == g for x in names} | set(KNOWN[g])) for g in "mf"}
_LISTED = rf"(?=\p{{Lu}})(?iu:{'|'.join(_NAMED['m'] + _NAMED['f'])})"
_INTRODUCED = r"(?<=[Mm]y name is |[Nn]ame: |[Ss]incerely, |[Rr]egards, |[Ss]igned by )"
_SECRET_NAME = r"(?=[TtSsPpAa])\b(?i:(?:token|secret|password|passwd|pwd|api[_\-]?key)\"?\s{0,3}[=:]\s{0,3})"
#: Most begin with a cheap look at the next character, as they are tried at each place of each text.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]++(?:\.[\p{L}\p{N}\-]++)++",
    "secret": rf"{_SECRET_NAME}(?:\"[^\"\r\n]{{4,}}+\"|'[^'\r\n]{{4,}}+'|(?=[^\s\"',;]*\d)[^\s\"',;()\[\]{{}}]{{8,}}+)"
    r"|(?=[0-9a-fA-F]{32})(?<![\p{L}\p{N}])[0-9a-fA-F]{32,}+(?![\p{L}\p{N}])",
    "ip": r"(?=\d)(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)",
    "phone": r"\+\d{1,3}[ .\-]?\(?\d{2,4}\)?(?:[ .\-]?\d{2,4}){2,3}(?!\d)|\(\d{3}\) ?\d{3}-\d{4}(?!\d)",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "card": r"(?<!\d)\d(?:[ \-]?\d){12,18}(?!\d)",
    "person": rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}])(?:(?:(?:{_TITLE})\.? )++{_FULL}|(?:Mr|Mrs|Ms)\. (?!(?:and|or|the|of|is|was|in|to|who)\b)\p{{Ll}}{{2,}}+"
    rf"|{_LISTED}(?: {_LISTED}(?= ))*+(?: \p{{Lu}}\.)? {_PARTICLES}{_NAME}|{_INTRODUCED}{_FULL})",
}
ANY = "|".join(PATTERNS.values())


def mentions_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def type_of(mention: Column) -> Column:
    """A name may hang on what stands before it, so it is what nothing else is."""
    known = [(kind, pattern) for kind, pattern in PATTERNS.items() if kind != "person"]
    return F.coalesce(*[F.when(mention.rlike(f"^(?:{pattern})$"), F.lit(kind)) for kind, pattern in known], F.lit("person"))


def parts_of(kind: Column, mention: Column) -> tuple[Column, Column, Column]:
    """What stays of a mention (the name of a secret, a title, a country code), what is replaced, and a closing quote."""
    stays = (
        F.when(kind == "secret", F.regexp_extract(mention, rf"^{_SECRET_NAME}[\"']?", 0))
        .when(kind == "person", F.regexp_extract(mention, rf"^(?:(?:{_TITLE})\.? )++", 0))
        .when(kind == "phone", F.regexp_extract(mention, r"^\+\d{1,3}(?=[ .\-(])|^", 0))
        .otherwise(F.lit(""))
    )
    quote = F.when((kind == "secret") & F.substring(stays, -1, 1).isin('"', "'"), F.substring(stays, -1, 1)).otherwise(F.lit(""))
    return stays, F.substring(mention, F.length(stays) + 1, F.length(mention) - F.length(stays) - F.length(quote)), quote


def gender_of(stays: Column, name: Column) -> Column:
    """That of the given name, else of a title, else n."""
    first = F.lower(F.substring_index(name, " ", 1))
    listed = F.when(name.contains(" "), F.coalesce(*[F.when(first.isin([x.lower() for x in _NAMED[g]]), F.lit(g)) for g in "mf"]))
    shown = [F.when(F.upper(stays).rlike(rf"(?:^| )(?:{'|'.join(TITLES[g]).upper()})\.? "), F.lit(g)) for g in "mf"]
    return F.coalesce(listed, *shown, F.lit("n"))


def canonical(kind: Column, mention: Column) -> Column:
    stays, body, _ = parts_of(kind, mention)
    return (
        F.when(kind.isin("email", "ip"), F.lower(body))
        .when(kind == "person", F.concat(gender_of(stays, body), F.lit(" "), F.lower(body)))
        .when(kind == "phone", F.concat(F.regexp_replace(stays, r"\D", ""), F.lit("/"), F.regexp_replace(body, r"\D", "")))
        .when(kind == "secret", F.when(body.rlike("^[0-9a-fA-F]+$"), F.lower(body)).otherwise(body))
        .otherwise(F.lower(F.regexp_replace(body, r"[^\p{L}\p{N}]", "")))
    )


def _byte(digest: Column, at: Column | int) -> Column:
    """The at-th byte (from 0) of a hex digest, as a number."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.substring(digest, 2 * at + 1, F.lit(2)), 16, 10).cast("int")


def _number(digest: Column, at: Column | int) -> Column:
    return _byte(digest, at) * 256 + _byte(digest, at + 1)


def _pick(words: list[str], number: Column) -> Column:
    return F.get(F.array(*[F.lit(w) for w in words]), F.pmod(number, F.lit(len(words))))


def _of(alphabet: str, number: Column) -> Column:
    return F.substring(F.lit(alphabet), F.pmod(number, F.lit(len(alphabet))) + 1, F.lit(1))


def _replaced(body: Column, salt: Column, lower: str = "abcdefghijklmnopqrstuvwxyz", symbols: bool = False) -> Column:
    """Each digit and letter (and symbol) of a string replaced by one that hashes of the salt give, others kept."""

    def one(c: Column, i: Column) -> Column:
        number = _number(F.sha2(F.concat(salt, F.lit(":"), i.cast("string")).cast("binary"), 512), 0)
        out = F.when(c.rlike(r"\p{N}"), _of("0123456789", number)).when(c.rlike(r"\p{Lu}"), _of(lower.upper(), number)).when(c.rlike(r"\p{L}"), _of(lower, number))
        return (out.when(c != " ", _of(SYMBOLS, number)) if symbols else out).otherwise(c)

    return F.array_join(F.transform(F.split(body, ""), one), "")


def _more(salt: Column, attempt: Column, digits: bool = False) -> Column:
    """A character for each attempt after the plain ones; none before."""
    n = F.greatest(attempt - PLAIN_ATTEMPTS, F.lit(0))
    hexed = F.sha2(F.concat(salt, F.lit("|more")).cast("binary"), 512)
    return F.substring(F.translate(hexed, "abcdef", "012345") if digits else F.translate(hexed, "0123456789", "ghijklmnop"), F.lit(1), n)


def _luhn(digits: Column) -> Column:
    """The check sum of a number, modulo 10."""
    value = lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0))
    return F.aggregate(F.transform(F.reverse(F.split(digits, "")), value), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10


def _remainder(characters: Column) -> Column:
    """Of lower-case letters and digits, read as a number in which letters stand for 10 to 35, divided by 97."""

    def step(a: Column, c: Column) -> Column:
        letter = c.rlike("[a-z]")
        return F.pmod(a * F.when(letter, 100).otherwise(10) + F.when(letter, F.ascii(c) - 87).otherwise(F.coalesce(c.cast("int"), F.lit(0))), F.lit(97))

    return F.aggregate(F.filter(F.split(characters, ""), lambda c: c != ""), F.lit(0), step)


def _person(canon: Column, digest: Column, attempt: Column) -> Column:
    name, shown = F.substring(canon, 3, 1_000_000), F.substring(canon, 1, 1)
    gender = F.when(shown == "n", F.when(_byte(digest, 60) % 2 == 0, F.lit("m")).otherwise(F.lit("f"))).otherwise(shown)
    initial = F.when(name.rlike(r" \p{L}\. "), F.concat(_of("abcdefghijklmnopqrstuvwxyz".upper(), _byte(digest, 61)), F.lit(". "))).otherwise(F.lit(""))

    def named(script: str) -> Column:
        syllable = lambda i: _pick(SYLLABLES[script], _number(digest, 2 + 2 * i))
        family = F.initcap(F.array_join(F.transform(F.sequence(F.lit(0), 3 + F.least(attempt, F.lit(24))), syllable), ""))
        given = F.when(gender == "f", _pick(GIVEN[script, "f"], _number(digest, 0))).otherwise(_pick(GIVEN[script, "m"], _number(digest, 0)))
        return F.when(name.contains(" "), F.concat(given, F.lit(" "), initial, family)).otherwise(family)

    drawn = F.when(name.rlike(r"^[\p{IsCyrillic}]"), named("cyrillic")).when(name.rlike(r"^[\p{IsGreek}]"), named("greek")).otherwise(named("latin"))
    return F.concat(shown, F.lit(" "), drawn)


def surrogate(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The canonical form of the replacement, but for the upper case of names."""
    salt = F.concat_ws("|", F.lit(key), kind, canon, attempt.cast("string"))
    digest = F.sha2(salt.cast("binary"), 512)
    letters, digits = _more(salt, attempt), _more(salt, attempt, digits=True)
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    last = F.substring_index(domain, ".", -1)
    head = F.substring(domain, F.lit(1), F.length(domain) - F.length(last))
    email = F.concat(_replaced(local, salt), letters, F.lit("@"), _replaced(head, F.concat(F.lit(key), F.lit("|domain|"), domain)), last)
    octets = [(F.pmod(_number(digest, 2 * i), F.lit(223 if not i else 256)) + (1 if not i else 0)).cast("string") for i in range(4)]
    address = F.concat(F.concat_ws(".", *octets), F.when(F.length(digits) > 0, F.concat(F.lit("."), digits)).otherwise(F.lit("")))
    phone = F.concat(F.substring_index(canon, "/", 1), F.lit("/"), _replaced(F.substring_index(canon, "/", -1), salt), digits)
    begun = F.concat(_replaced(F.substring(canon, F.lit(1), F.length(canon) - 1), salt), digits)
    card = F.concat(begun, F.pmod(_luhn(canon) - _luhn(F.concat(begun, F.lit("0"))), F.lit(10)).cast("string"))
    country, account = F.substring(canon, 1, 2), F.concat(_replaced(F.substring(canon, 5, 1_000), salt), digits)
    check = F.lpad((F.lit(98) - _remainder(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
    secret = F.when(canon.rlike("^[0-9a-f]+$"), F.concat(_replaced(canon, salt, "abcdef"), digits)).otherwise(F.concat(_replaced(canon, salt, symbols=True), letters))
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", address)
        .when(kind == "phone", phone)
        .when(kind == "card", card)
        .when(kind == "person", _person(canon, digest, attempt))
        .when(kind == "iban", F.concat(country, check, account))
        .when(kind == "secret", secret)
        .otherwise(F.concat(_replaced(canon, salt), digits))
    )


def rendered(kind: Column, mention: Column, replacement: Column) -> Column:
    """A replacement in a mention's form: its separators, and upper case where it has letters in upper case."""
    stays, body, quote = parts_of(kind, mention)
    plain = F.when(kind == "phone", F.substring_index(replacement, "/", -1)).otherwise(replacement)
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(a: Column, c: Column) -> Column:
        new = F.substring(plain, a["at"], F.lit(1))
        cased = F.when(c.rlike(r"\p{Lu}"), F.upper(new)).otherwise(new)
        inside = c.rlike(r"[\p{L}\p{N}]")
        return F.struct(F.concat(a["out"], F.when(inside, cased).otherwise(c)).alias("out"), (a["at"] + inside.cast("int")).alias("at"))

    filled = F.aggregate(F.split(body, ""), start, step, lambda a: F.concat(a["out"], F.substring(plain, a["at"], F.length(plain))))
    upper = (body == F.upper(body)) & (body != F.lower(body))
    whole = F.when(kind == "person", F.substring(replacement, 3, 1_000_000)).otherwise(replacement)
    hexed = (kind == "secret") & body.rlike("^[0-9a-fA-F]+$")
    whole = F.when(upper & (kind.isin("email", "person") | hexed), F.upper(whole)).otherwise(whole)
    return F.concat(stays, F.when(kind.isin("email", "ip", "person", "secret"), whole).otherwise(filled), quote)


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, replacement) of distinct entities (kind, canon); within a kind no two replacements are the same, none an entity.

    Persons are compared by their names alone, in lower case: the gender that stands before a name is not seen in a text."""
    now = cut(entities.withColumn("attempt", F.lit(0)).withColumn("replacement", surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), key)))

    def shown(column: str) -> Column:
        return F.when(F.col("kind") == "person", F.lower(F.substring(column, 3, 1_000_000))).otherwise(F.col(column))

    own = now.select("kind", shown("canon").alias("shown"))
    while True:
        seen = now.withColumn("shown", shown("replacement"))
        real = seen.join(own, ["kind", "shown"], "left_semi").select("kind", "canon")
        nth = F.row_number().over(Window.partitionBy("kind", "shown").orderBy("attempt", "canon"))
        clash = seen.withColumn("nth", nth).where("nth > 1").select("kind", "canon").unionAll(real).distinct()
        clash = cut(clash.withColumn("clash", F.lit(1)))
        if clash.isEmpty():
            return now.select("kind", "canon", "replacement")
        tried = now.join(clash, ["kind", "canon"], "left").withColumn("attempt", F.col("attempt") + F.coalesce("clash", F.lit(0)))
        again = F.when(F.col("clash") == 1, surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), key)).otherwise(F.col("replacement"))
        now = cut(tried.select("kind", "canon", "attempt", again.alias("replacement")))


def mentions(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, nth, mention, kind, canon) of each mention."""
    each = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(mentions_in(text_or_empty())).alias("nth", "mention"))
    typed = each.withColumn("kind", type_of(F.col("mention")))
    return typed.withColumn("canon", canonical(F.col("kind"), F.col("mention")))


def pseudonymise(docs: DataFrame, key: str = KEY) -> DataFrame:
    """(doc_id, n_entities, kinds, text) of each row: the text with every mention replaced."""
    found = cut(mentions(docs))
    counted = cut(found.groupBy("kind", "canon").agg(F.count(F.lit(1)).alias("n")))
    table_ = surrogates(counted.select("kind", "canon"), key)
    filled = joined_by_hot_key(found, table_, hot_keys(counted, ["kind", "canon"], found.count()), ["kind", "canon"]).withColumn("new", rendered(F.col("kind"), F.col("mention"), F.col("replacement")))
    by_doc = filled.groupBy(F.col("doc_id").alias("of_id"), F.col("text_key").alias("of_text")).agg(F.sort_array(F.collect_set(F.struct("nth", "new", "kind"))).alias("found"))
    keyed = docs.select("doc_id", "text").withColumn("text_key", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_text"))
    joined = keyed.join(by_doc.hint("shuffle_hash"), same, "left")
    parts = F.zip_with(F.split("text", ANY, -1), F.col("found.new"), lambda part, new: F.concat(part, F.coalesce(new, F.lit(""))))
    text = F.when(F.col("found").isNull(), F.col("text")).otherwise(F.array_join(parts, ""))
    kinds = F.coalesce(F.array_join(F.array_sort(F.array_distinct("found.kind")), ","), F.lit(""))
    return joined.select("doc_id", F.coalesce(F.size("found"), F.lit(0)).cast("long").alias("n_entities"), kinds.alias("kinds"), text.alias("text"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates in place of personal data; the key is the session's KEY_SETTING."""
    return pseudonymise(table(spark, sf_dir, "documents"), spark.conf.get(KEY_SETTING, KEY))
