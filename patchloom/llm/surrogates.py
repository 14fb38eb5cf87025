"""Personal data replaced by keyed surrogates.

Entities are found by one pattern: mail addresses, telephone numbers, IPv4 addresses,
payment cards, social security numbers, bank accounts (IBAN), secrets, and names after a
title. Each is reduced to a canonical form (lower case, digits only), so that all ways of
writing it, in all documents, share one surrogate. A surrogate comes from a keyed digest
of kind and canonical form: a digit becomes a digit, a letter a letter of the same
script, a card number stays valid. Punctuation and case of each place are kept.

Names are replaced word by word: a family name keeps its surrogate wherever it stands, a
given name gets one of the same gender and script. Within a document all mentions of a
given and a family name are one person, whose gender any title can tell (also that of the
family name alone, where only one person has it; else a title anywhere in the corpus);
full names and family names that were met after a title are found without one, too.

Surrogates that two entities share, or that equal an entity found in the corpus, are
drawn again; name-like words grow longer with the draws, and what short numbers leave over
after ``MAX_DRAWS`` gets the numbers that are still free, by rank. Only where more than
half of all numbers of a length are entities can a surrogate equal another one's original.

Only DataFrame functions are used. What a row's text becomes depends on the text alone, so
null and repeated ids, and repeated rows, need no care. Null texts stay null, texts
without entities stay as they are, and all other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from patchloom.llm.tools import stored, unused

LETTERS = "abcdefghijklmnopqrstuvwxyz"
CYRILLIC = "абвгдежзиклмнопрстуфхцчшщэюя"

MALE_TITLES = ("Mr", "Mister", "Herr", "Monsieur", "Señor", "Господин")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mademoiselle", "Señora", "Señorita", "Госпожа")
OPEN_TITLES = ("Dr", "Prof", "Professor", "Доктор")

GIVEN = {
    ("m", "latin"): ("Adam", "Bruno", "Carl", "Daniel", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Nils", "Oscar", "Paul"),
    ("f", "latin"): ("Anna", "Berta", "Clara", "Diana", "Elena", "Frida", "Greta", "Helena", "Irene", "Julia", "Klara", "Laura", "Maria", "Nora", "Olga", "Paula"),
    ("m", "cyrillic"): ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Захар", "Игорь", "Кирилл", "Лев", "Марк", "Никита", "Олег", "Павел", "Роман", "Семён"),
    ("f", "cyrillic"): ("Анна", "Богдана", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Ирина", "Кира", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Римма"),
}

# Sounds of name-like words, per script: before the vowel, the vowel, after it.
SOUNDS = {
    "latin": ("b br d dr f g gr h k kl l m n p r s st t tr v".split(), "a e i o u".split(), ["", "l", "n", "r", "s", "t", "m", "rn"]),
    "cyrillic": ("б бр в г гр д ж з к кл л м н п р с ст т х ч".split(), "а е и о у".split(), ["", "л", "н", "р", "с", "т", "м", "рн"]),
}
# Ends of given names by gender, and of family names.
ENDS = {("m", "latin"): "in", ("f", "latin"): "a", ("m", "cyrillic"): "ин", ("f", "cyrillic"): "а", ("family", "latin"): "er", ("family", "cyrillic"): "енко"}

_NOT_BEFORE = r"(?<![\p{L}\p{N}_.+%-])"
_TITLES = "|".join((*MALE_TITLES, *FEMALE_TITLES, *OPEN_TITLES))
MAIL = rf"{_NOT_BEFORE}[\p{{L}}\p{{N}}_.+%-]++@[\p{{L}}\p{{N}}-]+(?:\.[\p{{L}}\p{{N}}-]+)+"
NAME = rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLES})\.? \p{{Lu}}\p{{Ll}}+(?:[ -]\p{{Lu}}\p{{Ll}}+){{0,3}}"
IP = r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\p{L}\p{N}]|\.\d)"
SSN = r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])"
CARD = r"(?<![\p{L}\p{N}.+-])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?![\p{L}\p{N}])"
PHONE = (r"(?<![\p{L}\p{N}.+(-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}"
         r"|\(\d{2,5}\)[ .-]?\d{2,4}(?:[ .-]?\d{2,4}){1,3}|\d{3}[.-]\d{3}[.-]\d{4})(?![\p{L}\p{N}])")
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
SECRET = (r"(?<![\p{L}\p{N}])(?:[0-9a-fA-F]{32,}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{20,}"
          r"|xox[abpr]-[A-Za-z0-9-]{10,})(?![\p{L}\p{N}])")
KINDS = (("mail", MAIL), ("name", NAME), ("secret", SECRET), ("ip", IP), ("ssn", SSN), ("card", CARD), ("phone", PHONE), ("iban", IBAN))
ANY = "|".join(f"(?:{p})" for _, p in KINDS)
# Every kind has a digit, an @, a title or the start of a secret; most texts have none and skip the long pattern.
HINT = rf"[@0-9]|(?:{_TITLES})\.? |AKIA|gh[pousr]_|sk-|xox[abpr]-|[a-fA-F]{{32}}"
# Letters of a digest stream that one entity uses; longer entities use it again from its start.
STREAM = 60
MAX_DRAWS = 20


def _kind(entity: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(KINDS):
        out = F.when(entity.rlike(rf"^(?:{pattern})$"), name).otherwise(out)
    return out


def _canonical(kind: Column, entity: Column) -> Column:
    digits = F.regexp_replace(entity, r"[^0-9]", "")
    return (F.when(kind.isin("phone", "card", "ssn"), digits)
            .when(kind == "iban", F.regexp_replace(entity, " ", "")).otherwise(F.lower(entity)))


def _gender(entity: Column) -> Column:
    title = F.regexp_extract(entity, r"^(\p{L}+)", 1)
    return F.when(title.isin(*FEMALE_TITLES), "f").when(title.isin(*MALE_TITLES), "m")


def _stream(key: str, kind: Column, canonical: Column, draw: Column) -> Column:
    """120 hexadecimal digits that only the key's holder can tell from chance."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canonical, draw.cast("string"), F.lit(key)), 512)


def _number(stream: Column, at: Column | int) -> Column:
    """0 .. 255 from place ``at`` (from 1, around after STREAM) of a stream."""
    at = F.lit(at) if isinstance(at, int) else at
    place = F.pmod(at - 1, F.lit(STREAM)) * 2 + 1
    return F.conv(F.substring(stream, place, F.lit(2)), 16, 10).cast("int")


def _pick(values: str, stream: Column, at: Column) -> Column:
    return F.substring(F.lit(values), F.pmod(_number(stream, at), F.lit(len(values))) + 1, F.lit(1))


def _letters(text: Column, stream: Column) -> Column:
    """Every letter and digit replaced by one of its kind and script."""
    chars = F.split(text, "")
    return F.array_join(F.transform(chars, lambda c, i: (
        F.when(c.rlike(r"[0-9]"), _pick("0123456789", stream, i + 1))
        .when(c.rlike(r"\p{IsCyrillic}"), _pick(CYRILLIC, stream, i + 1))
        .when(c.rlike(r"\p{L}"), _pick(LETTERS, stream, i + 1)).otherwise(c))), "")


def _luhn(body: Column) -> Column:
    """``body`` with its check digit."""
    chars = F.split(F.reverse(body), "")
    double = lambda c, i: F.when(i % 2 == 0, F.when(c * 2 > 9, c * 2 - 9).otherwise(c * 2)).otherwise(c)
    total = F.aggregate(F.transform(chars, lambda c, i: double(c.cast("int"), i)), F.lit(0), lambda a, b: a + b)
    return F.concat(body, F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10)).cast("string"))


def _surrogate(key: str, kind: Column, canonical: Column, draw: Column) -> Column:
    """Canonical surrogate of a canonical entity."""
    stream = _stream(key, kind, canonical, draw)
    free = _letters(canonical, stream)
    mail = F.concat(_letters(F.regexp_extract(canonical, r"^(.*)\.[^.]*$", 1), stream), F.regexp_extract(canonical, r"(\.[^.]*)$", 1))
    octet = [F.pmod(_number(stream, k), F.lit(254)) + 1 for k in range(1, 5)]
    card = _luhn(F.concat(F.substring(canonical, 1, 1), F.substring(free, F.lit(2), F.char_length(canonical) - 2)))
    # the country and area part keeps its first digit, so the length of codes stays plausible
    phone = F.concat(F.substring(canonical, 1, 1), F.substring(free, F.lit(2), F.char_length(canonical)))
    iban = F.concat(F.substring(canonical, 1, 2), F.upper(F.substring(free, F.lit(3), F.char_length(canonical))))
    hexes = F.array_join(F.transform(F.split(canonical, ""), lambda c, i: (
        F.when(c.rlike("[g-z]"), _pick(LETTERS, stream, i + 1)).when(c.rlike("[0-9a-f]"), _pick("0123456789abcdef", stream, i + 1))
        .otherwise(c))), "")
    secret = F.when(canonical.rlike("^[0-9a-f]+$"), hexes).otherwise(
        F.concat(F.regexp_extract(canonical, r"^(akia|gh[pousr]_|sk-|xox[abpr]-)", 1),
                 F.regexp_replace(free, r"^(?:.{4}|.{3})", "")))
    return (F.when(kind == "mail", mail).when(kind == "ip", F.concat_ws(".", *[o.cast("string") for o in octet]))
            .when(kind == "card", card).when(kind == "phone", phone).when(kind == "ssn", free).when(kind == "iban", iban)
            .when(kind == "secret", secret).when(kind == "given", _given(stream, canonical, draw))
            .when(kind == "family", _sounded(stream, canonical.rlike(r"\p{IsCyrillic}"), "family", draw)))


def _sounded(stream: Column, cyrillic: Column, use: str, draw: Column) -> Column:
    """A name-like word, one syllable longer after every three draws."""
    def word(script: str) -> Column:
        onsets, vowels, codas = (F.array(*map(F.lit, sounds)) for sounds in SOUNDS[script])
        part = lambda sounds, at: F.get(sounds, F.pmod(_number(stream, at), F.size(sounds)))
        syllables = F.transform(F.sequence(F.lit(0), F.floor(draw / 3).cast("int") + (1 if use == "family" else 0)), lambda k: F.concat(
            part(onsets, 3 * k + 3), part(vowels, 3 * k + 4), part(codas, 3 * k + 5)))
        return F.initcap(F.concat(F.array_join(syllables, ""), F.lit(ENDS[use, script])))

    return F.when(cyrillic, word("cyrillic")).otherwise(word("latin"))


def _given(stream: Column, canonical: Column, draw: Column) -> Column:
    """A given name of ``gender:name``: a common one first, then name-like words."""
    known = F.substring(canonical, 1, 1)
    gender = F.when(known.isin("f", "m"), known).otherwise(F.when(_number(stream, 1) % 2 == 0, "f").otherwise("m"))
    cyrillic = canonical.rlike(r"\p{IsCyrillic}")
    out = F.lit(None).cast("string")
    for (g, script), names in GIVEN.items():
        common = F.get(F.array(*map(F.lit, names)), F.pmod(_number(stream, 2), F.lit(len(names))))
        chosen = F.when(draw < 2, common).otherwise(_sounded(stream, cyrillic, g, draw))
        out = F.when((gender == g) & (cyrillic == F.lit(script == "cyrillic")), chosen).otherwise(out)
    return out


def _placed(kind: Column, entity: Column, surrogate: Column) -> Column:
    """A surrogate in the writing of one place: its punctuation, blanks and case."""
    slot = r"[0-9]"
    digits = F.array_join(F.transform(F.split(entity, ""), lambda c, i: F.when(
        c.rlike(slot), F.substring(surrogate, F.length(F.regexp_replace(F.substring(entity, F.lit(1), i + 1), "[^0-9]", "")), F.lit(1))
    ).otherwise(c)), "")
    iban = F.array_join(F.transform(F.split(entity, ""), lambda c, i: F.when(
        c != " ", F.substring(surrogate, F.length(F.regexp_replace(F.substring(entity, F.lit(1), i + 1), " ", "")), F.lit(1))
    ).otherwise(c)), "")
    cased = F.when((entity == F.upper(entity)) & (entity != F.lower(entity)), F.upper(surrogate)).otherwise(surrogate)
    return F.when(kind.isin("phone", "card", "ssn"), digits).when(kind == "iban", iban).otherwise(cased)


NAME_KINDS = ("given", "family")


def _plain(kind: Column, form: Column) -> Column:
    """The form under which an entity and a surrogate must not meet: names by their letters alone."""
    return F.when(kind.isin(*NAME_KINDS), F.lower(F.regexp_replace(form, "^[mf?]:", ""))).otherwise(form)


def assign(entities: DataFrame, key: str) -> DataFrame:
    """``kind, canonical, surrogate`` for distinct ``kind, canonical``: distinct surrogates
    that equal no entity."""
    group = F.when(F.col("kind").isin(*NAME_KINDS), "name").otherwise(F.col("kind"))
    known = entities.select(group.alias("group"), _plain(F.col("kind"), F.col("canonical")).alias("plain")).distinct().withColumn("taken", F.lit(True))
    todo, settled, draw = entities, None, 0
    while True:
        drawn = todo.withColumn("surrogate", _surrogate(key, F.col("kind"), F.col("canonical"), F.lit(draw)))
        drawn = drawn.select("kind", "canonical", "surrogate", group.alias("group"), _plain(F.col("kind"), F.col("surrogate")).alias("plain"))
        # of those that share a surrogate the smallest keeps it, unless it is an entity's own form or was given before
        first = Window.partitionBy("group", "plain").orderBy("kind", "canonical")
        judged = drawn.withColumn("nth", F.row_number().over(first)).join(known, ["group", "plain"], "left")
        judged = stored(judged.withColumn("fits", F.col("taken").isNull() & (F.col("nth") == 1)).drop("taken", "nth"), "drawn")
        good = judged.filter("fits").drop("fits")
        settled = good if settled is None else settled.unionByName(good)
        todo = judged.filter("NOT fits").select("kind", "canonical")
        if todo.isEmpty():
            return settled.select("kind", "canonical", "surrogate")
        known = known.unionByName(good.select("group", "plain").withColumn("taken", F.lit(True)))
        draw += 1
        if draw == MAX_DRAWS:
            ranked = _by_rank(todo.filter(F.col("kind").isin(*SHORT_KINDS)), settled, entities, key)
            settled = settled.select("kind", "canonical", "surrogate").unionByName(ranked).withColumns(
                {"group": group, "plain": _plain(F.col("kind"), F.col("surrogate"))})
            todo = todo.join(ranked, ["kind", "canonical"], "left_anti")


# Kinds whose surrogates are numbers of a fixed length, and the longest whose numbers are ranked.
SHORT_KINDS = ("phone",)
RANKED_DIGITS = 7


def _by_rank(todo: DataFrame, settled: DataFrame, entities: DataFrame, key: str) -> DataFrame:
    """Free numbers for short entities that no draw has settled: first those that are no entity,
    then, if there are too few, any that was not given yet."""
    short = todo.filter(F.length("canonical") <= RANKED_DIGITS).withColumn("digits", F.length("canonical"))
    out = None
    for taken in (settled.select("kind", F.col("surrogate").alias("number")).unionByName(entities.select("kind", F.col("canonical").alias("number"))),
                  settled.select("kind", F.col("surrogate").alias("number"))):
        left = short if out is None else short.join(out, ["kind", "canonical"], "left_anti")
        used = taken if out is None else taken.unionByName(out.select("kind", F.col("surrogate").alias("number")))
        numbers = left.select("kind", "digits").distinct().withColumn(
            "n", F.explode(F.sequence(F.lit(0).cast("long"), F.pow(F.lit(10), F.col("digits")).cast("long") - 1)))
        free = numbers.withColumn("number", F.lpad(F.col("n").cast("string"), F.col("digits"), F.lit("0"))).join(used, ["kind", "number"], "left_anti")
        shuffled = lambda c: Window.partitionBy("kind", "digits").orderBy(F.sha2(F.concat_ws("\x1f", F.lit(key), F.col(c)), 256))
        ranked = left.withColumn("rank", F.row_number().over(shuffled("canonical"))).join(
            free.withColumn("rank", F.row_number().over(shuffled("number"))), ["kind", "digits", "rank"])
        given = stored(ranked.select("kind", "canonical", F.col("number").alias("surrogate")), "ranked")
        out = given if out is None else out.unionByName(given)
    return out


def _people(names: DataFrame) -> DataFrame:
    """``key, entity, title, given, family, gender`` of mentions after a title, from ``key, entity``."""
    title = F.regexp_extract("entity", rf"^(?:{_TITLES})\.? ", 0)
    words = names.withColumns({"title": title, "shown": _gender(F.col("entity")), "family": F.substring_index("entity", " ", -1)})
    rest = F.expr("substring(entity, length(title) + 1, length(entity) - length(title) - length(family))")
    words = words.withColumn("given", F.trim(rest))
    full = words.filter("given != ''")
    alone = words.filter("given = ''")
    person = ["key", "family", "given"]
    told = full.groupBy(*person).agg(F.min("shown").alias("told"))
    # a family name alone speaks for its only bearer in the document
    only = told.groupBy("key", "family").agg(F.count(F.lit(1)).alias("bearers")).filter("bearers = 1").drop("bearers")
    hinted = alone.join(only, ["key", "family"]).groupBy("key", "family").agg(F.min("shown").alias("hinted"))
    elsewhere = told.filter("told IS NOT NULL").groupBy("family", "given").agg(F.min("told").alias("elsewhere"))
    known = told.join(hinted, ["key", "family"], "left").join(elsewhere, ["family", "given"], "left").select(
        *person, F.coalesce("told", "hinted", "elsewhere", F.lit("?")).alias("gender"))
    return words.join(known, person, "left").select("key", "entity", "title", "given", "family", F.coalesce("gender", F.lit("?")).alias("gender"))


def _name_pieces(people: DataFrame) -> DataFrame:
    """``key, entity, at, before, kind, canonical`` of every word of every way a person is written:
    as after the title, in full, and by the family name."""
    forms = F.array(
        F.struct(F.col("entity"), F.col("title"), F.col("given")),
        F.struct(F.concat_ws(" ", F.when(F.col("given") != "", F.col("given")), "family").alias("entity"), F.lit("").alias("title"), F.col("given")),
        F.struct(F.col("family").alias("entity"), F.lit("").alias("title"), F.lit("").alias("given")))
    # a mention without a given name says nothing about others that have one
    written = people.select("key", "gender", "family", F.explode(forms).alias("f")).select("key", "gender", "family", "f.*").groupBy(
        "key", "entity", "title", "given", "family").agg(F.max("gender").alias("gender"))
    def pieces(text: Column, kind: str, prefix: Column) -> Column:
        return F.transform(F.filter(F.regexp_extract_all(text, F.lit(r"[ -]?[^ -]+"), F.lit(0)), lambda w: w != ""), lambda w: F.struct(
            F.regexp_extract(w, "^[ -]?", 0).alias("before"), F.lit(kind).alias("kind"),
            F.concat(prefix, F.lower(F.regexp_replace(w, "^[ -]", ""))).alias("canonical")))
    given = F.when(F.col("given") != "", pieces(F.col("given"), "given", F.concat("gender", F.lit(":")))).otherwise(
        F.array().cast("array<struct<before:string,kind:string,canonical:string>>"))
    family = pieces(F.concat(F.when(F.col("given") != "", " ").otherwise(""), "family"), "family", F.lit(""))
    return written.select("key", "entity", "title", F.posexplode(F.concat(given, family)).alias("at", "p")).select("key", "entity", "title", "at", "p.*")


def _found(text: Column, pattern: Column) -> Column:
    return F.regexp_extract_all(text, pattern, F.lit(0))


def replace(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """``docs`` with surrogates in ``text_col``; ``count_col`` adds the number of places."""
    text = F.col(text_col)
    has = F.coalesce(F.when(text.rlike(HINT), text.rlike(ANY)), F.lit(False))
    mark, table_col, count = (unused(docs, name) for name in ("_text", "_surrogates", count_col or "_count"))
    with_any, clean = docs.filter(has).withColumn(mark, F.md5(text.cast("binary"))), docs.filter(~has)
    place = with_any.select(F.col(mark).alias("key"), F.explode(F.array_distinct(_found(text, F.lit(ANY)))).alias("entity")).distinct()
    place = stored(place.withColumn("kind", _kind(F.col("entity"))), "entities")
    others = place.filter("kind != 'name'").withColumn("canonical", _canonical(F.col("kind"), F.col("entity")))
    pieces = stored(_name_pieces(_people(place.filter("kind = 'name'").select("key", "entity"))), "pieces")
    mapped = assign(others.select("kind", "canonical").union(pieces.select("kind", "canonical")).distinct(), key)
    pairs = others.join(mapped, ["kind", "canonical"]).select(
        "key", "entity", _placed(F.col("kind"), F.col("entity"), F.col("surrogate")).alias("written"), F.lit(False).alias("bare"))
    # the words of one name: a few rows per mention
    named = pieces.join(mapped, ["kind", "canonical"]).groupBy("key", "entity", "title").agg(
        F.sort_array(F.collect_list(F.struct("at", F.concat("before", "surrogate").alias("word")))).alias("words"))
    named = named.select("key", "entity", F.concat("title", F.array_join(F.transform("words", lambda w: w["word"]), "")).alias("written"),
                         (F.col("title") == "").alias("bare"))
    # the distinct entities of one text: bounded by it
    listed = pairs.unionByName(named).groupBy("key").agg(
        F.map_from_entries(F.collect_list(F.struct("entity", "written"))).alias("map"),
        F.array_sort(F.collect_list(F.when(F.col("bare"), F.struct((-F.length("entity")).alias("n"), "entity")))).alias("bare"))
    names = F.array_join(F.transform("bare", lambda b: b["entity"]), "|")
    pattern = F.when(F.size("bare") > 0, F.concat(F.lit(ANY + r"|(?<![\p{L}\p{N}])(?:"), names, F.lit(r")(?![\p{L}\p{N}])")))
    table = listed.select(F.col("key").alias(mark), F.struct("map", pattern.alias("pattern")).alias(table_col))
    joined = with_any.join(table, mark, "left")
    own = F.col(table_col)

    def rewritten(pattern: Column) -> Column:
        found = _found(text, pattern)
        between = F.split(text, pattern, -1)
        return F.struct(F.array_join(F.transform(between, lambda piece, i: F.concat(
            piece, F.coalesce(F.element_at(own["map"], F.get(found, i)), F.lit("")))), "").alias("text"), F.size(found).alias("n"))

    # most texts have no name, and their pattern is compiled once
    done = F.when(own["pattern"].isNull(), rewritten(F.lit(ANY))).otherwise(rewritten(own["pattern"]))
    made = joined.withColumn(table_col, done)
    columns = [F.col(c) if c != text_col else F.col(f"{table_col}.text").alias(text_col) for c in docs.columns]
    out = made.select(*columns, F.col(f"{table_col}.n").alias(count)).unionByName(clean.select("*", F.lit(0).alias(count)))
    return out if count_col else out.drop(count)
