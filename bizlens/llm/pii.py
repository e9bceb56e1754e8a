"""PII replacement with keyed, type-consistent surrogates.

One pattern finds e-mail addresses, secrets, IPv4 addresses, IBANs, card and
social-security numbers, phone numbers, and names behind a form of address. A
surrogate depends on a key, the kind and the entity's normal form alone, so one
entity has one surrogate in the whole corpus (coreference), however it is written:
e-mail and name case, phone and card punctuation do not count, and "Mr. Smith" and
"Mr. John Smith" share the surname's. Surrogates keep the format (punctuation,
lengths, valid Luhn and IBAN check digits, hexadecimal secrets), a given name's
gender and a name's script (Latin, Cyrillic or Greek).

Collisions are checked over the corpus: of entities of a kind that drew the same
surrogate the first in order keeps it, and no surrogate may be a real entity of the
corpus; the others draw again until none is left. Only DataFrame functions are used.

Defined cases: null and empty texts and texts without entities stay as they are
(0 entities); repeated rows get the same text; all other columns pass through,
whatever their names. Only distinct entities and the texts that hold some are
shuffled; a text with many copies is looked up once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlens.llm.common import cut_lineage, table

KEY = "bizlens surrogates"

_ADDRESS = {
    "m": "Mr|Sir|Herr|Monsieur|Señor|Sr|г-н|Господин|Κύριος",
    "f": "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|г-жа|Госпожа|Κυρία",
    "n": "Dr|Prof",
}
_ADDRESSES = "|".join(_ADDRESS.values())
_LABEL = r"(?i:password|passwd|pwd|token|secret|api[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?"
_NAME = r"(?:\p{Lu}['’])?\p{Lu}\p{Ll}+(?:['’-]\p{Lu}\p{Ll}+){0,3}"
_TOKENS = "AKIA|gh[pousr]_|xox[abeoprs]-|AIza|Bearer "
#: Draws after which a format is taken to be exhausted.
MAX_DRAWS = 64
#: In the order in which they are tried at a place.
PATTERNS = {
    # possessive and bounded: one step per label, and at most the lengths that mail has
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,256}+@[\p{L}\p{N}-]{1,63}+(?:\.[\p{L}\p{N}-]{1,63}+){1,127}+",
    "secret": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abeoprs]-[A-Za-z0-9-]{10,250}|"
    r"AIza[A-Za-z0-9_-]{35}|Bearer [A-Za-z0-9._~+/-]{16,4000}+=?=?|"
    + _LABEL
    + r"[A-Za-z0-9+/_-]{8,})(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?!\.?[0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9-])"
    r"|(?<![0-9A-Za-z])\+[0-9]{8,14}(?![0-9])"
    r"|(?<![0-9A-Za-z])\+[0-9]{1,3}(?=(?:[ .()-]{0,3}[0-9]){6})(?:[ .-]{1,2}\(?[0-9]{1,8}\)?){1,6}(?![0-9])"
    r"|(?<![0-9A-Za-z])\([0-9]{2,5}\)[ .-]?[0-9]{5,8}(?![0-9-])",
    "card": r"(?<![0-9A-Za-z.-])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,7})(?![0-9A-Za-z])",
    "name": r"(?<!\p{L})(?:" + _ADDRESSES + rf")\.? {_NAME}(?: (?:\p{{Lu}}\. )?{_NAME})?(?!\p{{L}})",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Every entity holds one of these characters or strings; looking for them is cheap,
#: so the pattern itself only runs over texts that have one.
_MARKS = "[0-9@=:]"
_STRINGS = ["AKIA", "AIza", "Bearer ", "xox", *(f"gh{c}_" for c in "pousr"), *_ADDRESSES.split("|")]

#: Given names by gender and script, and syllables for surnames (own choice).
GIVEN = {
    "m:latin": "Adam Bruno David Emil Felix Hugo Leon Martin Oscar Paul Simon Victor",
    "f:latin": "Alice Clara Diana Elena Flora Ida Julia Laura Maria Nora Rosa Vera",
    "n:latin": "Alex Andrea Chris Dominique Kim Luca Nicola Robin Sacha Sasha Toni Yael",
    "m:cyrillic": "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Олег Роман",
    "f:cyrillic": "Алла Вера Галина Дарья Елена Зоя Инна Кира Лидия Мария Нина Ольга",
    "n:cyrillic": "Валя Женя Саша Шура Слава Паша",
    "m:greek": "Άρης Γιάννης Κώστας Λεωνίδας Νίκος Πέτρος",
    "f:greek": "Άννα Δάφνη Ελένη Ζωή Ιρις Μαρία",
    "n:greek": "Άγγελος Αλέξης Χάρης Φώτης",
}
SYLLABLES = {
    "latin": "ba ben cor da del fin gar hal jor ka lan mar nel or pal ren sal tor val wes",
    "cyrillic": "ба вен гор да зел кар лан мор нел ор пал рен сал тор фед хал",
    "greek": "βα γεν δορ ζα κελ λαν μαρ νελ πορ ραν σαλ τορ φιν χαρ",
}


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _chars(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))


def _kind(found: Column) -> Column:
    """Which pattern found the text; the alternatives differ in their forms."""
    return (
        F.when(F.contains(found, F.lit("@")), "email")
        .when(found.rlike(r"^(?:AKIA[0-9A-Z]{16}$|gh[pousr]_|xox[abeoprs]-|AIza|Bearer |" + _LABEL + ")"), "secret")
        .when(found.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), "ip")
        .when(found.rlike(r"^[A-Z]{2}[0-9]{2}[ A-Z0-9]"), "iban")
        .when(found.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(found.rlike(r"^(?:\+|\(|[0-9]{3}[ .-][0-9]{3,4}[ .-][0-9]{3,4}$)"), "phone")
        .when(found.rlike("^[0-9]"), "card")
        .otherwise("name")
    )


def _script(name: Column) -> Column:
    return F.when(name.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(name.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")


def _unit(lead, kind, norm, raw) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        *(as_column(c).alias(n) for c, n in ((lead, "lead"), (kind, "kind"), (norm, "norm"), (raw, "raw")))
    )


def _units(found: Column) -> Column:
    """What of the entity is replaced: text kept before it, kind, normal form, text."""
    kind = _kind(found)
    label = F.regexp_extract(found, f"^(?:{_TOKENS}|" + _LABEL + ")", 0)
    secret = F.substr(found, F.length(label) + 1)
    country = F.regexp_extract(found, r"^\+[0-9]{1,3}(?:[ .-]|(?=\())[ ]?|^\+[0-9]{2}", 0)
    phone = F.substr(found, F.length(country) + 1)
    address = F.regexp_extract(found, r"^(?:" + _ADDRESSES + r")\.? ", 0)
    name = F.split(F.substr(found, F.length(address) + 1), " ")
    title = F.regexp_replace(address, r"\.? $", "")
    gender = F.when(title.rlike(f"^(?:{_ADDRESS['m']})$"), "m").when(title.rlike(f"^(?:{_ADDRESS['f']})$"), "f").otherwise("n")
    last, script = F.element_at(name, -1), _script(F.element_at(name, -1))
    given = F.element_at(name, 1)
    surname = lambda lead: _unit(lead, F.concat(F.lit("surname:"), script), F.lower(last), last)
    return (
        F.when(kind == "email", F.array(_unit("", "email", F.lower(found), found)))
        .when(kind == "secret", F.array(_unit(label, "secret", secret, secret)))
        .when(kind == "phone", F.array(_unit(country, "phone", _digits(phone), phone)))
        .when(kind.isin("card", "ssn"), F.array(_unit("", kind, _digits(found), found)))
        .when(kind == "iban", F.array(_unit("", "iban", F.replace(found, F.lit(" "), F.lit("")), found)))
        .when(kind == "ip", F.array(_unit("", "ip", found, found)))
        .when(F.size(name) == 1, F.array(surname(address)))
        .otherwise(
            F.array(
                _unit(address, F.concat(F.lit("given:"), gender, F.lit(":"), script), F.lower(given), given),
                surname(F.lit(" ")),
            )
        )
    )


def _luhn_sum(digits: Column) -> Column:
    doubled = F.transform(
        F.reverse(_chars(digits)),
        lambda c, i: F.when(i % 2 == 1, (c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5)).otherwise(c.cast("int")).cast("int"),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x)


def _mod97(text: Column) -> Column:
    value = lambda c: F.conv(c, 36, 10).cast("int")
    return F.aggregate(
        _chars(text),
        F.lit(0),
        lambda a, c: F.when(value(c) < 10, (a * 10 + value(c)) % 97).otherwise((a * 100 + value(c)) % 97).cast("int"),
    )


def surrogate(kind: Column, norm: Column, attempt: int, key: str = KEY, digest: Column | None = None) -> Column:
    """The ``attempt``-th surrogate of a normal form. ``digest``: that of ``norm``, where it
    is at hand; it is looked at for every character."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, F.lit(str(attempt)), F.sha2(norm, 256) if digest is None else digest)
    stream = F.concat(*(F.sha2(F.concat(F.lit(x), seed).cast("binary"), 512) for x in "01"))
    byte = lambda i: F.conv(F.substr(stream, (i * 2) % 256 + 1, F.lit(2)), 16, 10).cast("int")
    at = lambda i: F.lit(i)
    letters = lambda first: (lambda i: F.char(F.lit(ord(first)) + byte(i) % 26))
    lower, upper = letters("a"), letters("A")
    digit = lambda i: (byte(i) % 10).cast("string")
    alike = lambda c, i: (
        F.when(c.rlike("[0-9]"), digit(i)).when(c.rlike(r"\p{Ll}"), lower(i)).when(c.rlike(r"\p{Lu}"), upper(i)).otherwise(c)
    )
    mapped = F.array_join(F.transform(_chars(norm), alike), "")
    positive = F.array_join(F.transform(_chars(norm), lambda c, i: (byte(i) % 9 + 1).cast("string")), "")
    hexed = F.array_join(F.transform(_chars(norm), lambda c, i: F.lower(F.hex((byte(i) % 16).cast("long")))), "")

    local, domain = F.substring_index(mapped, "@", 1), F.substring_index(mapped, "@", -1)
    top = F.substring_index(norm, ".", -1)
    # a short address has few surrogates of its form: later draws may be longer
    more = F.concat(F.lit(""), *(lower(at(200 + k)) for k in range(min(max(attempt - 2, 0), 16))))
    email = F.concat(
        local, F.lit("@"), F.substring_index(domain, ".", 1), more, F.lit(".example"),
        F.when(top.isin("com", "net", "org"), F.concat(F.lit("."), top)).otherwise(""),
    )
    body = F.concat(F.substring(norm, 1, 1), F.substr(mapped, F.lit(2), F.length(norm) - 2))
    check = ((10 - _luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string")
    card = F.concat(body, F.when(_luhn_sum(norm) % 10 == 0, check).otherwise(F.substr(mapped, F.length(norm))))
    country, account = F.substring(norm, 1, 2), F.substr(mapped, F.lit(5))
    iban = F.concat(
        country, F.lpad((98 - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0"), account
    )
    # 240.0.0.0/4 is no host's; should it not suffice, later draws use all addresses
    first = byte(at(0)) % 16 + 240 if attempt < 8 else byte(at(0))
    ip = F.concat_ws(".", *(x.cast("string") for x in (first, byte(at(1)), byte(at(2)), byte(at(3)))))
    script = F.substring_index(kind, ":", -1)

    def pick(choices: dict[str, str], place: int, chosen: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, words in choices.items():
            parts = words.split()
            listed = F.array(*map(F.lit, parts))
            out = F.when(chosen == name, F.element_at(listed, byte(at(place)) % len(parts) + 1)).otherwise(out)
        return out

    syllables = F.initcap(F.concat(*(pick(SYLLABLES, k, script) for k in range(3 + min(attempt, 20)))))
    given = pick(GIVEN, 60, F.substr(kind, F.lit(7)))
    if attempt:
        given = F.concat(given, F.lit("-"), syllables)
    return (
        F.when(kind == "email", email)
        .when(kind == "secret", F.when(norm.rlike("^[0-9a-f]+$"), hexed).otherwise(mapped))
        .when(kind == "ip", ip)
        .when(kind == "iban", iban)
        .when(kind == "card", card)
        .when(kind.isin("phone", "ssn"), positive)
        .when(kind.startswith("surname:"), syllables)
        .otherwise(given)
    )


def _written(unit: Column, drawn: Column) -> Column:
    """The surrogate in the form in which the entity was written."""
    raw, kind = unit["raw"], unit["kind"]
    place = lambda i: F.length(F.regexp_replace(F.substr(raw, F.lit(1), i + 1), "[^A-Za-z0-9]", ""))
    spaced = F.array_join(
        F.transform(_chars(raw), lambda c, i: F.when(c.rlike("[A-Za-z0-9]"), F.substr(drawn, place(i), F.lit(1))).otherwise(c)),
        "",
    )
    return F.concat(
        unit["lead"],
        F.when(kind.isin("card", "ssn", "phone", "iban"), spaced)
        .when(kind.isin("email") & (F.upper(raw) == raw), F.upper(drawn))
        .otherwise(drawn),
    )


def distinct_surrogates(units: DataFrame, key: str = KEY) -> DataFrame:
    """kind, norm, drawn: a surrogate for each distinct (kind, norm), different from
    every other surrogate and from every real entity of the kind."""
    units = cut_lineage(units.distinct().withColumn("digest", F.sha2("norm", 256)))
    real = units.select("kind", F.col("norm").alias("taken"))
    done, left, attempt = None, units, 0
    while True:
        drawn = left.withColumn("drawn", surrogate(F.col("kind"), F.col("norm"), attempt, key, F.col("digest")))
        form = F.when(F.col("kind").rlike("^(?:given|surname)"), F.lower("drawn")).otherwise(F.col("drawn"))
        drawn = drawn.withColumn("taken", form)
        free = drawn.join(real, ["kind", "taken"], "left_anti")
        won = free.groupBy("kind", "taken").agg(F.min(F.struct("norm", "drawn")).alias("w"))
        won = cut_lineage(won.select("kind", "w.norm", "w.drawn", "taken"))
        done = won if done is None else done.unionByName(won)
        real = real.unionByName(won.select("kind", "taken"))
        left = cut_lineage(left.join(won, ["kind", "norm"], "left_anti"))
        attempt += 1
        if left.isEmpty():
            return done.select("kind", "norm", "drawn")
        if attempt == MAX_DRAWS:
            short = left.groupBy("kind", F.length("norm").alias("n")).count().limit(5).collect()
            raise RuntimeError(f"no free surrogates of the form after {attempt} draws: {short}")


def _any_of(text: Column, strings: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in strings])


def _fresh(name: str, taken: list[str]) -> str:
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def replace(docs: DataFrame, key: str = KEY, count: str | None = None) -> DataFrame:
    """``docs`` with every entity in ``text`` replaced; n_chars, where there is such a
    column, follows the new text. ``count`` names a column for the entities' number."""
    hash_, drawn_, parts_, number = (
        _fresh(n, [*docs.columns, count or ""]) for n in ("_hash", "_drawn", "_parts", "_n")
    )
    text = F.col("text")
    may_hold = F.coalesce(text.rlike(_MARKS) | _any_of(text, _STRINGS), F.lit(False))
    plain = docs.where(~may_hold).withColumn(number, F.lit(0).cast("long"))
    held = docs.where(may_hold)
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    digest = F.sha2(text.cast("binary"), 256)
    # one row for each distinct text with entities
    texts = held.select(digest.alias("h"), found.alias("f")).groupBy("h").agg(F.first("f").alias("f"))
    rows = texts.select("h", F.posexplode("f").alias("p", "found")).select(
        "h", "p", F.posexplode(_units(F.col("found"))).alias("q", "u")
    )
    rows = cut_lineage(rows)
    drawn = distinct_surrogates(rows.select("u.kind", "u.norm"), key)
    written = rows.withColumn("kind", F.col("u.kind")).withColumn("norm", F.col("u.norm")).join(
        drawn, ["kind", "norm"]
    )
    written = written.select("h", "p", F.struct("q", _written(F.col("u"), F.col("drawn")).alias("s")).alias("x"))
    # an entity's units in order, then a text's entities in order
    one = F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["s"]), "")
    whole = written.groupBy("h", "p").agg(one.alias("s"))
    by_text = whole.groupBy("h").agg(F.sort_array(F.collect_list(F.struct("p", "s"))).alias("x"))
    by_text = by_text.select(F.col("h").alias(hash_), F.transform("x", lambda x: x["s"]).alias(drawn_))

    parts = F.col(parts_)
    after = F.slice(parts, F.lit(2), F.size(parts))
    told = F.array_join(F.zip_with(F.col(drawn_), after, lambda d, p: F.concat(d, p)), "")
    new_text = F.concat(F.get(parts, F.lit(0)), F.coalesce(told, F.lit("")))
    changed = (
        held.withColumn(hash_, digest)
        .join(by_text, hash_, "left")
        .withColumn(parts_, F.when(F.col(drawn_).isNull(), F.array(text)).otherwise(F.split(text, PATTERN, -1)))
        .withColumn(number, (F.size(parts) - 1).cast("long"))
        .withColumn("text", new_text)
        .drop(hash_, drawn_, parts_)
    )
    if "n_chars" in docs.columns:
        kept = F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType)
        changed = changed.withColumn("n_chars", kept)
    out = plain.unionByName(changed)
    return out.withColumnRenamed(number, count) if count else out.drop(number)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace(docs, count="n_entities")
