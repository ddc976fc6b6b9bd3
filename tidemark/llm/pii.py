"""Personal data replaced by keyed surrogates (operator 9, DataFrame functions only).

Found are e-mail addresses, telephone, card, account and identity numbers, IP addresses, secrets (long
hexadecimal strings and key-like tokens) and names after a title. Each entity, in a canonical form that
is the same for all its spellings, gets one surrogate everywhere (coreference), drawn by a keyed hash:
of the same type and shape, digits for digits and letters for letters, case by case, with the same
separators. Card numbers and IBANs keep valid check digits where the original has them, and wrong ones
where it hasn't; addresses end in the reserved domain .example, so they are nobody's. A person's gender is
what the titles of the same full name tell, else those of the same given name, else a list of names; where
none tells, the surrogate is a name of either gender.

A draw that meets another surrogate or any real entity of its pool is drawn again (distinctness), those that
met each other but the first. Later draws are longer by a few letters or digits, or, of IP addresses, longer
addresses of the range for documentation, so a full shape is left within some rounds: no surrogate is ever
its original or another real entity.

Only texts that hold an entity are shuffled. A hot entity's occurrences are joined to the table of
surrogates, both written tables, so adaptive execution may split them.

Null and empty texts, and those without an entity, stay as they are; very long texts are searched whole. Rows
with null or repeated ids are replaced each. An empty table gives an empty one. Other columns stay, whatever
their names; a column n_chars is kept in step with the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import scratch, shielded, staged, unshielded, wide_key

_LEFT, _RIGHT = r"(?<![\p{L}\p{N}_.@+-])", r"(?![\p{L}\p{N}_@-])"
#: Titles before names, by the gender they tell.
MALE = ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don", "господин", "г-н", "κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña", "госпожа", "г-жа", "κυρία")
NEUTRAL = ("Dr", "Prof", "Doctor", "Professor")
_NAME = r"\p{Lu}[\p{L}'’-]+"
#: In this order: what an earlier kind takes, a later one doesn't see.
KINDS = (
    ("email", rf"{_LEFT}[A-Za-z0-9](?:[A-Za-z0-9._%+-]{{0,63}})@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{{0,62}})\.){{1,8}}[A-Za-z]{{2,24}}(?![A-Za-z0-9@-])"),
    ("ip", r"(?<![\p{N}.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![\p{N}]|\.[0-9])"),
    ("secret", rf"{_LEFT}(?:[0-9a-f]{{32,128}}|[0-9A-F]{{32,128}}|AKIA[0-9A-Z]{{16}}|(?:sk|pk|ghp|gho|xox[bp])[-_][A-Za-z0-9]{{16,80}}){_RIGHT}"),
    ("iban", rf"{_LEFT}[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?{_RIGHT}"),
    ("card", r"(?<![\p{L}\p{N}_.+-])[0-9](?:[ -]?[0-9]){12,18}(?![\p{L}\p{N}_-])"),
    ("identity", r"(?<![\p{L}\p{N}_.+-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}_-])"),
    ("phone", r"(?:(?<![\p{L}\p{N}_+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,5}\)[ .-]?)?[0-9]{2,5}(?:[ .-]?[0-9]{2,5}){1,4}|(?<![\p{L}\p{N}_(])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|(?<![\p{L}\p{N}_.+-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![\p{L}\p{N}_-])"),
    ("person", rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join((*MALE, *FEMALE, *NEUTRAL))})\.?[ \xA0]{_NAME}(?:[ \xA0]{_NAME}){{0,2}}"),
)
PATTERN = "|".join(f"(?:{p})" for _, p in KINDS)
#: No text without a character of these has an entity; cheap, so it goes first.
_HINT = rf"[0-9@]|AKIA|(?:sk|pk|ghp|gho|xox[bp])[-_]|[a-f]{{32}}|[A-F]{{32}}|(?:{'|'.join((*MALE, *FEMALE, *NEUTRAL))})\.?[ \xA0]"

#: Surrogate given names by script and gender, and syllables of surrogate family names.
GIVEN = {
    ("latin", "m"): ("Adrian", "Bruno", "Caspar", "Damian", "Edgar", "Felix", "Gregor", "Hugo", "Ivo", "Jonas", "Kilian", "Leon", "Marius", "Nils", "Oskar", "Pascal"),
    ("latin", "f"): ("Adele", "Beata", "Carla", "Dora", "Elsa", "Flora", "Greta", "Helena", "Ines", "Julia", "Klara", "Livia", "Mara", "Nora", "Olga", "Paula"),
    ("cyrillic", "m"): ("Антон", "Борис", "Вадим", "Глеб", "Денис", "Егор", "Захар", "Игорь"),
    ("cyrillic", "f"): ("Анна", "Вера", "Галина", "Дарья", "Елена", "Зоя", "Ирина", "Лидия"),
    ("greek", "m"): ("Άρης", "Βασίλης", "Γιώργος", "Δημήτρης", "Ηλίας", "Κώστας", "Μάριος", "Νίκος"),
    ("greek", "f"): ("Άννα", "Βασιλική", "Γεωργία", "Δήμητρα", "Ελένη", "Ζωή", "Μαρία", "Νίκη"),
    ("latin", "n"): ("Alexis", "Andrea", "Charlie", "Dominique", "Eden", "Jamie", "Kim", "Luca", "Noel", "Quinn", "Robin", "Sam", "Sascha", "Toni", "Valery", "Yael"),
    ("cyrillic", "n"): ("Саша", "Женя", "Валя", "Слава"),
    ("greek", "n"): ("Αλεξία", "Φώτις", "Χάρις", "Σάσα"),
}
#: Frequent given names that tell a gender where no title does, besides those above.
KNOWN = {
    "m": "alexander andreas antonio carlos charles christian daniel david edward francisco frank george hans henri henry ivan jack jacques james jean john jose josé juan karl klaus luis manuel mark martin max michael miguel nicolas paul pedro peter philippe pierre richard robert stefan thomas walter william иван пётр алексей сергей николай владимир дмитрий михаил γιάννης παύλος πέτρος".split(),
    "f": "alice ana anna anne barbara carmen catherine charlotte christine claire clara elena elisabeth elizabeth emily emma eva hannah isabel isabelle jane jennifer julie karen laura linda lisa louise lucia margaret maria marie marta martha mary monika nicole patricia petra rosa sabine sarah sofia sophie susan susanne ursula мария анна ольга татьяна наталья елена светлана екатерина κατερίνα σοφία".split(),
}
SYLLABLES = {
    "latin": ("ba", "del", "fen", "gar", "hol", "kem", "lin", "mar", "nor", "pel", "ros", "sten", "tal", "ver", "win", "zor"),
    "cyrillic": ("ба", "дел", "фен", "гар", "хол", "кем", "лин", "мар", "нор", "пел", "рос", "тал", "вер", "вин", "зор", "сан"),
    "greek": ("βα", "δελ", "φεν", "γαρ", "κεμ", "λιν", "μαρ", "νορ", "πελ", "ροσ", "ταλ", "βερ", "ζορ", "σαν", "μιλ", "θεν"),
}


def kind_of(match: Column) -> Column:
    out = F.lit(KINDS[-1][0])
    for kind, pattern in reversed(KINDS[:-1]):
        out = F.when(match.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def _title(match: Column) -> Column:
    return F.regexp_extract(match, rf"^({'|'.join((*MALE, *FEMALE, *NEUTRAL))})\.?[ \xA0]", 1)


def _script(name: Column) -> Column:
    return F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").when(name.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _hex_number(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("long")


def stream(secret: str, *parts: Column) -> Column:
    """256 hexadecimal digits that the key and the parts determine."""
    seed = F.concat_ws("\x1f", F.lit(secret), *parts)
    return F.concat(*(F.sha2(F.concat(F.lit(f"{i}\x1f"), seed), 256) for i in range(4)))


def _drawn(stream: Column, i: Column) -> Column:
    """The i-th number of the stream, of 0 to 255; it starts again after 128."""
    return _hex_number(F.substring(stream, F.pmod(i, F.lit(128)) * 2 + 1, F.lit(2)))


def _pick(items: tuple[str, ...], number: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, items)), (F.pmod(number, F.lit(len(items))) + 1).cast("int"))


def _longer(nonce: Column, free: int) -> Column:
    """How many characters a draw has more than its original: none of the first free draws, one more each time from then on."""
    return F.greatest(F.lit(0), nonce.cast("int") - free + 1)


def _extra(letters: str, drawn: Column, count: Column) -> Column:
    """count characters more; they follow on the stream's end."""
    each = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: F.substring(F.lit(letters), F.pmod(_drawn(drawn, 127 - i), F.lit(len(letters))) + 1, F.lit(1)))
    return F.when(count > 0, F.array_join(each, "")).otherwise("")


def _syllable(items: tuple[str, ...], drawn: Column):
    return lambda i: _pick(items, _drawn(drawn, i + 10))


def _appended(items: tuple[str, ...], drawn: Column):
    return lambda i: F.concat(F.lit("-"), _pick(items, _drawn(drawn, i + 10)))


def _reshaped(text: Column, drawn: Column, hexadecimal: Column) -> Column:
    """Other digits for digits and letters for letters of the same case; in hexadecimal strings, of the same alphabet."""

    def one(c: Column, i: Column) -> Column:
        n = _drawn(drawn, i)
        digit = F.substring(F.lit("0123456789"), F.pmod(n, F.lit(10)) + 1, F.lit(1))
        low = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), F.pmod(n, F.lit(26)) + 1, F.lit(1))
        base = F.substring(F.lit("0123456789abcdef"), F.pmod(n, F.lit(16)) + 1, F.lit(1))
        return (
            F.when(hexadecimal & c.rlike("[0-9a-f]"), base).when(hexadecimal & c.rlike("[0-9A-F]"), F.upper(base))
            .when(c.rlike("[0-9]"), digit).when(c.rlike("[a-z]"), low).when(c.rlike("[A-Z]"), F.upper(low)).otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, ""), one), "")


def luhn(digits: Column) -> Column:
    """The sum by Luhn's rule of all digits, the last one not doubled, modulo 10."""

    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(F.pmod(i, F.lit(2)) == 1, twice).otherwise(d)

    return F.pmod(F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda a, b: a + b), F.lit(10))


def _checked(original: Column, digits: Column) -> Column:
    """digits with the last one so that Luhn's rule holds for them exactly if it does for original."""
    head = F.substring(digits, F.lit(1), F.length(digits) - 1)
    right = F.pmod(10 - luhn(F.concat(head, F.lit("0"))), F.lit(10))
    last = F.substring(digits, F.length(digits), F.lit(1)).cast("int")
    other = F.when(last == right, F.pmod(last + 1, F.lit(10))).otherwise(last)
    return F.concat(head, F.when(luhn(original) == 0, right).otherwise(other).cast("string"))


def mod97(iban: Column) -> Column:
    """An account number's remainder, its first four signs last and letters as 10 to 35; 1 of a valid one."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.transform(F.split(turned, ""), value), F.lit(0), lambda a, v: F.pmod(a * F.when(v > 9, 100).otherwise(10) + v, F.lit(97)))


def _account(original: Column, rest: Column) -> Column:
    """The account number of original's country with rest after its check digits, which are right if original's are."""
    country = F.substring(original, 1, 2)
    right = 98 - mod97(F.concat(country, F.lit("00"), rest))
    wrong = F.pmod(right - 1, F.lit(97)) + 2
    return F.concat(country, F.lpad(F.when(mod97(original) == 1, right).otherwise(wrong).cast("string"), 2, "0"), rest)


def surrogate(kind: Column, canon: Column, nonce: Column, secret: str) -> Column:
    """The nonce-th surrogate of an entity in its canonical form."""
    drawn = stream(secret, kind, canon, nonce.cast("string"))
    number = _hex_number(F.substring(drawn, F.lit(1), F.lit(8)))
    octet = lambda i: (F.pmod(_drawn(drawn, F.lit(i)) * 256 + _drawn(drawn, F.lit(i + 1)), F.lit(254)) + 1).cast("string")
    ip = F.when(nonce < 12, F.concat_ws(".", *(octet(2 * i) for i in range(4)))).otherwise(F.concat(F.lit("2001:db8"), *(F.concat(F.lit(":"), F.substring(drawn, 4 * i + 1, 4)) for i in range(6))))
    local, domain = F.substring_index(canon, "@", 1), F.regexp_extract(canon, r"@(.*)\.[a-z]+$", 1)
    address = _reshaped(F.concat(local, F.lit("@"), domain), drawn, F.lit(False))
    more = _extra("abcdefghijklmnopqrstuvwxyz", drawn, _longer(nonce, 2))
    email = F.concat(F.substring_index(address, "@", 1), more, F.lit("@"), F.substring_index(address, "@", -1), F.lit(".example"))
    iban = _account(canon, F.concat(_reshaped(F.substring(canon, F.lit(5), F.length(canon)), drawn, F.lit(False)), _extra("0123456789", drawn, _longer(nonce, 12))))
    prefix = F.when(kind == "card", 1).when(kind == "phone", F.locate(":", canon)).otherwise(0)
    more = _extra("0123456789", drawn, _longer(nonce, 4))
    digits = F.concat(F.substring(canon, F.lit(1), prefix), _reshaped(F.substring(canon, prefix + 1, F.length(canon)), drawn, F.lit(False)), more)
    secret_head = F.regexp_extract(canon, r"^(AKIA|(?:sk|pk|ghp|gho|xox[bp])[-_])", 1)
    hexed = F.when(canon.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), _reshaped(canon, drawn, kind == "secret")).otherwise(F.concat(secret_head, _reshaped(F.substring(canon, F.length(secret_head) + 1, F.length(canon)), drawn, F.lit(False))))
    name = F.lit(None).cast("string")
    for (script, gender), items in GIVEN.items():
        # from the third draw on, each appends one name more, so the supply doesn't end
        more = F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), nonce.cast("int"))), _appended(items, drawn))
        more = F.when(nonce >= 2, F.array_join(more, "")).otherwise("")
        name = F.when(kind == f"given_{gender}_{script}", F.concat(_pick(items, number), more)).otherwise(name)
    for script, items in SYLLABLES.items():
        parts = F.transform(F.sequence(F.lit(0), 2 + nonce.cast("int")), _syllable(items, drawn))
        name = F.when(kind == f"family_{script}", F.initcap(F.array_join(parts, ""))).otherwise(name)
    return (
        F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "secret", hexed)
        .when(kind == "iban", iban).when(kind == "card", _checked(canon, digits)).when(kind.isin("phone", "identity"), digits).otherwise(name)
    )


def pool(kind: Column) -> Column:
    """What a surrogate must differ in: names of all genders and scripts stand together."""
    return F.when(kind.startswith("given_"), "given").when(kind.startswith("family_"), "family").otherwise(kind)


def _entities(match: Column) -> Column:
    """The match's entities: kind, canonical form and, of a given name, the family's; two for a person with several names.

    A given name after a title that tells no gender is of kind given_?_<script>; gendered() finds it.
    """
    kind = kind_of(match)
    digits = F.regexp_replace(match, "[^0-9]", "")
    country = F.regexp_extract(match, r"^\+([0-9]{1,3})[ .(-]", 1)  # stays
    number = F.concat(country, F.lit(":"), F.substring(digits, F.length(country) + 1, F.length(digits)))
    canon = F.when(kind == "email", F.lower(match)).when(kind == "phone", number).when(kind.isin("card", "identity"), digits).when(kind == "iban", F.regexp_replace(match, " ", "")).otherwise(match)
    title = _title(match)
    name = F.regexp_replace(F.regexp_replace(match, rf"^(?:{'|'.join((*MALE, *FEMALE, *NEUTRAL))})\.?[ \xA0]", ""), "\xa0", " ")
    family, given = F.regexp_extract(name, r"([^ ]+)$", 1), F.regexp_extract(name, r"^(.*) [^ ]+$", 1)
    gender = F.when(title.isin(*FEMALE), "f").when(title.isin(*MALE), "m").otherwise("?")
    pair = lambda k, c, m: F.struct(k.alias("kind"), c.alias("canon"), m.cast("string").alias("mate"))
    none = F.lit(None)
    people = F.array(pair(F.concat(F.lit("family_"), _script(family)), F.lower(family), none))
    both = F.array_append(people, pair(F.concat(F.lit("given_"), gender, F.lit("_"), _script(given)), F.lower(given), F.lower(family)))
    return F.when(kind != "person", F.array(pair(kind, canon, none))).when(given != "", both).otherwise(people)


def _written(match: Column, new: Column) -> Column:
    """match with its entities replaced: new has the surrogates in the order of _entities()."""
    kind = kind_of(match)
    first = F.element_at(new, 1)
    first = F.when(kind == "phone", F.regexp_replace(first, ":", "")).otherwise(first)

    def at_digit(c: Column, i: Column, source: Column, which: str) -> Column:
        before = F.length(F.regexp_replace(F.substring(match, F.lit(1), i + 1), f"[^{which}]", ""))
        return F.when(c.rlike(f"[{which}]"), F.substring(source, before, F.lit(1))).otherwise(c)

    digits = F.array_join(F.transform(F.split(match, ""), lambda c, i: at_digit(c, i, first, "0-9")), "")
    signs = F.array_join(F.transform(F.split(match, ""), lambda c, i: at_digit(c, i, first, "0-9A-Z")), "")
    rest = lambda signs: F.substring(first, F.length(F.regexp_replace(match, f"[^{signs}]", "")) + 1, F.length(first))  # noqa: E731  what a longer surrogate has more
    digits, signs = F.concat(digits, rest("0-9")), F.concat(signs, rest("0-9A-Z"))
    head = F.regexp_extract(match, rf"^((?:{'|'.join((*MALE, *FEMALE, *NEUTRAL))})\.?[ \xA0])", 1)
    person = F.when(F.size(new) > 1, F.concat(head, F.element_at(new, 2), F.lit(" "), first)).otherwise(F.concat(head, first))
    cased = F.array_join(F.transform(F.split(first, ""), lambda c, i: F.when(F.substring(match, i + 1, F.lit(1)).rlike("[A-Z]"), F.upper(c)).otherwise(c)), "")
    email = F.when((match == F.upper(match)), F.upper(first)).otherwise(cased)
    return F.when(kind == "person", person).when(kind.isin("card", "phone", "identity"), digits).when(kind == "iban", signs).when(kind == "email", email).otherwise(first)


def gendered(single: DataFrame) -> DataFrame:
    """single with a gender for each given name of kind given_?_<script>: m, f, or n where nothing tells."""
    told = single.filter(F.col("kind").rlike("^given_[mf]_")).groupBy("canon", "mate").agg(F.sum(F.when(F.col("kind").startswith("given_f_"), 1).otherwise(-1)).alias("vote"))
    told = staged(told, "genders")
    most = lambda vote: F.when(vote > 0, "f").when(vote < 0, "m")
    full = told.select("canon", "mate", most(F.col("vote")).alias("by_full"))
    given = told.groupBy("canon").agg(most(F.sum("vote")).alias("by_given"))
    listed = F.lit(None).cast("string")
    for gender in ("m", "f"):
        names = {*KNOWN[gender], *(n.lower() for (_, g), items in GIVEN.items() if g == gender for n in items)}
        listed = F.when(F.substring_index("canon", " ", 1).isin(*sorted(names)), gender).otherwise(listed)
    open_rows = single.filter(F.col("kind").startswith("given_?_")).join(full, ["canon", "mate"], "left").join(given, "canon", "left")
    gender = F.coalesce("by_full", "by_given", listed, F.lit("n"))
    closed = open_rows.withColumn("kind", F.concat(F.lit("given_"), gender, F.substring("kind", 8, 99))).select(*single.columns)
    return single.filter(~F.col("kind").startswith("given_?_")).union(closed)


def surrogates(entities: DataFrame, secret: str) -> DataFrame:
    """entities: distinct (kind, canon). With new: different for each of a pool, and no real entity of the pool."""
    group = pool(F.col("kind"))
    real = staged(entities.select(group.alias("pool"), F.col("canon").alias("spelled")).distinct(), "real")
    settled, open_rows = None, entities.select("kind", "canon", F.lit(0).alias("nonce"))
    while True:
        drawn = open_rows.withColumn("new", surrogate(F.col("kind"), F.col("canon"), F.col("nonce"), secret)).withColumn("pool", group)
        drawn = drawn.withColumn("spelled", F.when(F.col("pool").isin("given", "family"), F.lower("new")).otherwise(F.col("new")))
        first = F.row_number().over(Window.partitionBy("pool", "spelled").orderBy("canon", "kind")) == 1
        taken = real if settled is None else real.union(settled.select("pool", "spelled"))
        marked = drawn.withColumn("first", first).join(taken.distinct().withColumn("taken", F.lit(True)), ["pool", "spelled"], "left")
        marked = staged(marked.withColumn("good", F.col("first") & F.col("taken").isNull()).drop("first", "taken"), "drawn")
        good, again = marked.filter("good"), marked.filter("NOT good")
        settled = good if settled is None else settled.union(good)
        if not again.limit(1).count():
            return settled.select("kind", "canon", "new")
        open_rows = again.select("kind", "canon", (F.col("nonce") + 1).alias("nonce"))


def replace(docs: DataFrame, secret: str, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """docs with the entities of its texts replaced; count_col, if named, is how many of them were. secret: the surrogates' key."""
    plain, names = shielded(docs, drop=(count_col,) if count_col else ())
    text = F.col(names[text_col]).cast("string")
    holds = F.coalesce(text.rlike(_HINT) & text.rlike(PATTERN), F.lit(False))
    key = wide_key(F.col(names[id_col]), text)
    matches = plain.filter(holds).select(key.alias("key"), F.posexplode(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).alias("at", "match"))
    found = staged(matches.distinct().withColumn("entities", _entities(F.col("match"))), "matches")
    single = found.select("key", "at", "match", F.posexplode("entities").alias("part", "entity")).select("key", "at", "match", "part", "entity.kind", "entity.canon", "entity.mate")
    single = staged(gendered(single).drop("mate"), "entities-found")
    entities = staged(single.select("kind", "canon").distinct(), "entities")
    with scratch(docs.sparkSession) as kept:
        kept.append(staged(surrogates(entities, secret), "surrogates"))
    new = kept[0]
    parts = single.join(new, ["kind", "canon"]).groupBy("key", "at", "match").agg(F.array_sort(F.collect_list(F.struct("part", "new"))).alias("new"))
    written = parts.select("key", "at", _written(F.col("match"), F.col("new.new")).alias("new"))
    texts = staged(written.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "new"))).alias("new")), "replacements")
    marked = plain.filter(holds).withColumn("key", key).join(texts, "key")
    pieces = F.split(text, PATTERN, -1)
    woven = F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(F.col("new.new"), i.cast("int")), F.lit("")))), "")
    marked = marked.withColumn("woven", woven)
    lengths = {names["n_chars"]: F.char_length("woven").cast(docs.schema["n_chars"].dataType)} if "n_chars" in names else {}
    changed = marked.withColumns({names[text_col]: F.col("woven")} | lengths).withColumn("n", F.size("new").cast("long"))
    both = changed.select(*names.values(), "n").union(plain.filter(~holds).select(*names.values(), F.lit(0).cast("long").alias("n")))
    more = [F.col("n").alias(count_col)] if count_col else []
    return unshielded(both, names, *more)
