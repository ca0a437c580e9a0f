"""Personal data: keyed, type-consistent surrogates, in DataFrame functions only.

Detected entities (mail addresses, IBANs, network addresses, card numbers, social security numbers,
phone numbers, names after a form of address) are replaced by surrogates of their own kind. A
surrogate is a function of a secret key and the entity in canonical form, so one entity has one
surrogate everywhere, however it is written (coreference): phone numbers with and without separators or
country code, IBANs and cards with and without spaces, mail addresses in any case. It keeps the layout:
every digit becomes a digit, every letter a letter of the same case and script, the country code of a phone
and the country of an IBAN stay, card numbers and IBANs stay valid or invalid, network addresses stay
in range.

Names are replaced part by part: a family name has one surrogate wherever it stands, a given name one of the gender
that the form of address shows. Further mentions of a name in the same text, whole or by the family name alone,
are replaced alike.

Distinctness is checked over all entities of the table: where two entities would get the same
surrogate, or one a surrogate that is a real entity, all but the least of them move to their next
attempt, until no collision is left. From the WIDER-th attempt on surrogates are longer than what they stand for, by
one more digit with each (after a colon for network addresses), so this ends even where all values of a
format are in use. Only these exceptions are stored and joined; every other surrogate is computed in its row.

Null texts stay null. Repeated rows are treated alike, a null doc_id is kept. Columns of any other name stay as
they are. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, drop

#: Forms of address, by gender. Fixed values.
MALE = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "Господин"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña", "Госпожа"]
#: Given and family name parts of surrogates, by script and gender. Fixed values.
GIVEN = {
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leo Martin Noah Oscar Paul Robin Simon Tomas Victor".split(),
    ("latin", "f"): "Alma Berta Clara Diana Emma Flora Greta Helena Irene Julia Karla Laura Maria Nora Olga Paula Rosa Sara Tilda Vera".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег Павел Роман Семён Тимур".split(),
    ("cyrillic", "f"): "Анна Белла Вера Галина Дарья Елена Жанна Зоя Ирина Клара Лидия Мария Нина Ольга Полина Раиса".split(),
}
HEADS = {"latin": "Bal Cor Den Fal Gar Hol Kes Lam Mar Nor Pel Rad Sol Tor Val Wen".split(), "cyrillic": "Бал Вор Гор Дан Жар Зор Кол Лав Мир Нов Пол Род Сав Тол Хар Чар".split()}
MIDDLES = {"latin": "a e i o an en in on ar er or al el il us ak".split(), "cyrillic": "а е и о ан ен ин он ар ер ор ал ел ил ус ак".split()}
TAILS = {"latin": "by dal den ford gard holm land lin man mond ner rick son stad ton wald".split(), "cyrillic": "ов ев ин ский цев лин мин дин нов ков лов мов ров сов тов чев".split()}

#: Calling codes of countries: one digit, two, else three. Fixed values.
COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-689][0-9]{2})"
#: From this attempt on surrogates are longer than their entities.
WIDER = 8

_TITLE = "|".join(sorted(MALE + FEMALE, key=len, reverse=True))
#: One expression for each kind; the first that fits at a place decides.
KINDS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]+(?:\.[\p{L}\p{N}\-]+)+",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ip": r"(?<![\p{N}.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![\p{N}]|\.[0-9])",
    "card": r"(?<![\p{L}\p{N}+])[0-9](?:[ \-]?[0-9]){12,18}(?![\p{L}\p{N}])",
    "ssn": r"(?<![\p{N}\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{N}\-])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .\-]?[0-9]{2,4}){1,4}|\([0-9]{2,4}\)[ .\-]?[0-9]{3,4}[ .\-]?[0-9]{3,4}|[0-9]{3}[.\-][0-9]{3,4}[.\-][0-9]{4})(?![\p{L}\p{N}])",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLE})\.? \p{{Lu}}[\p{{L}}'\-]+(?: \p{{Lu}}[\p{{L}}'\-]+)?",
}
ENTITY = "|".join(KINDS.values())
#: What a text must hold to be worth a full search.
HINT = rf"[@0-9]|{_TITLE}"


def kind_of(m: Column) -> Column:
    """The kind whose expression covers the whole match; earlier kinds first."""
    out = F.lit("name")
    for k, p in reversed(list(KINDS.items())[:-1]):
        bare = p.split(")", 1)[1] if p.startswith("(?<!") else p
        out = F.when(m.rlike(rf"^(?:{bare})$"), F.lit(k)).otherwise(out)
    return out


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def canonical(kind: Column, m: Column) -> Column:
    """One spelling for all spellings of an entity that is no name."""
    return (
        F.when(kind == "email", F.lower(m))
        .when(kind == "iban", F.replace(m, F.lit(" "), F.lit("")))
        .when(kind == "phone", digits(F.regexp_replace(m, COUNTRY, "")))
        .when(kind == "ip", m)
        .otherwise(digits(m))
    )


def untitled(m: Column) -> Column:
    """A name without its form of address."""
    return F.regexp_replace(m, rf"^(?:{_TITLE})\.? ", "")


def family(m: Column) -> Column:
    return F.regexp_extract(m, "([^ ]+)$", 1)


def given(m: Column) -> Column:
    """gender|given name|family name; empty if the name has one part."""
    first = F.regexp_extract(untitled(m), "^([^ ]+) ", 1)
    return F.when(first == "", first).otherwise(F.concat_ws("|", gender(m), first, family(m)))


def atoms(m: Column) -> Column:
    """What gets a surrogate of its own in a match: kind and canon of its parts."""
    kind = kind_of(m)
    part = lambda k, c: F.struct(k.alias("kind"), c.alias("canon"))
    parts = F.filter(F.array(part(F.lit("family"), family(m)), part(F.lit("given"), given(m))), lambda x: x["canon"] != "")
    return F.when(kind == "name", parts).otherwise(F.array(part(kind, canonical(kind, m))))


def gender(m: Column) -> Column:
    return F.when(m.rlike(rf"^(?:{'|'.join(MALE)})\.? "), F.lit("m")).otherwise(F.lit("f"))


def numbers(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """64 keyed numbers of 0..65535 for an entity."""
    head = lambda i: F.sha2(F.concat_ws(":", F.lit(key), kind, attempt.cast("string"), F.lit(str(i)), canon).cast("binary"), 256)
    hexes = F.concat(*[head(i) for i in range(4)])
    return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.conv(F.substr(hexes, i * 4 + 1, F.lit(4)), 16, 10).cast("int"))


def _let(value: Column, f) -> Column:
    """f(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _letter(c: Column, v: Column) -> Column:
    """A character of the same class, case and script."""
    pick = lambda letters: F.substr(F.lit(letters), v % len(letters) + 1, F.lit(1))
    return (
        F.when(c.rlike("[0-9]"), (v % 10).cast("string"))
        .when(c.rlike("[a-z]"), pick("abcdefghijklmnopqrstuvwxyz"))
        .when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        .when(c.rlike("[а-яё]"), pick("абвгдежзиклмнопрстуфхцчшэюя"))
        .when(c.rlike("[А-ЯЁ]"), pick("АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"))
        .when(c.rlike(r"\p{Ll}"), pick("äéíñóöüçèà"))
        .when(c.rlike(r"\p{Lu}"), pick("ÄÉÍÑÓÖÜÇÈÀ"))
        .otherwise(c)
    )


def _spelt(m: Column, n: Column, keep: int = 0) -> Column:
    """m with every letter and digit (after the first `keep` characters) changed by its place."""
    return F.array_join(
        F.transform(F.split(m, "(?!^)"), lambda c, i: F.when(i < keep, c).otherwise(_letter(c, F.element_at(n, i % 64 + 1) + F.floor(i / 64).cast("int")))), ""
    )


def _characters(s: Column) -> Column:
    return F.array_remove(F.split(s, "(?!^)"), "")


def _luhn(d: Column) -> Column:
    """Luhn sum of a digit string, whose last digit is not doubled."""
    size = F.char_length(d)
    each = F.transform(F.split(d, "(?!^)"), lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))
    part = F.transform(each, lambda c, i: F.when((size - i) % 2 == 0, F.when(c > 4, c * 2 - 9).otherwise(c * 2)).otherwise(c))
    return F.aggregate(part, F.lit(0), lambda s, x: s + x)


def _laid(m: Column, new: Column, keep: str, skip: Column | None = None) -> Column:
    """new in the layout of m: characters that match `keep`, after the first `skip`, give way in order; what is left over follows."""
    skip = F.lit(0) if skip is None else skip
    tail = F.substr(m, skip + 1)
    count = lambda s: F.char_length(F.regexp_replace(s, f"[^{keep}]", ""))
    at = lambda i: count(F.substr(tail, F.lit(1), i)) + 1
    body = F.transform(F.split(tail, "(?!^)"), lambda c, i: F.when(c.rlike(f"[{keep}]"), F.substr(new, at(i), F.lit(1))).otherwise(c))
    return F.concat(F.substr(m, F.lit(1), skip), F.array_join(body, ""), F.substr(new, count(tail) + 1))


def _mod97(s: Column) -> Column:
    """An IBAN's remainder: its first four characters at the end, letters as 10 to 35."""
    turned = _characters(F.concat(F.substr(s, F.lit(5)), F.substr(s, F.lit(1), F.lit(4))))
    step = lambda r, c: F.when(c.rlike("[0-9]"), r * 10 + F.coalesce(c.try_cast("int"), F.lit(0))).otherwise(r * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(turned, F.lit(0), step)


def _iban(canon: Column, body: Column) -> Column:
    """The country, then check digits that are right if they were, then the new body."""
    land = F.substr(canon, F.lit(1), F.lit(2))
    right = 98 - _mod97(F.concat(land, F.lit("00"), body))
    check = F.when(_mod97(canon) == 1, right).otherwise(F.when(right == 98, 2).otherwise(right + 1))
    return F.concat(land, F.lpad(check.cast("string"), 2, "0"), body)


def _email(canon: Column, n: Column, more: Column) -> Column:
    """Local part and domain change letter by letter; the domain's last label stays, so it remains of its sort."""
    local = F.regexp_extract(canon, "^(.*)@", 1)
    label = F.regexp_extract(canon, r"@(.*)\.[^.]*$", 1)
    last = F.regexp_extract(canon, r"(\.[^.]*)$", 1)
    return F.concat(_spelt(local, n), more, F.lit("@"), _spelt(label, F.reverse(n)), last)


def _pick(words: list[str], n: Column, k: Column | int) -> Column:
    return F.element_at(F.array(*map(F.lit, words)), F.element_at(n, k) % len(words) + 1)


def _family(canon: Column, n: Column, attempt: Column) -> Column:
    """A made-up family name of the same script, longer with each attempt."""

    def of(script: str) -> Column:
        middle = F.array_join(F.transform(F.sequence(F.lit(1), 2 + attempt), lambda k: _pick(MIDDLES[script], n, 10 + k % 50)), "")
        return F.concat(_pick(HEADS[script], n, 2), middle, _pick(TAILS[script], n, 3))

    return F.when(canon.rlike("[Ѐ-ӿ]"), of("cyrillic")).otherwise(of("latin"))


def _given(canon: Column, n: Column, attempt: Column) -> Column:
    """A given name of the same gender and script; one more, after a hyphen, with each attempt."""
    of = lambda *key: F.array_join(F.transform(F.sequence(F.lit(0), attempt), lambda k: _pick(GIVEN[key], n, 1 + k % 60)), "-")
    by_gender = lambda script: F.when(canon.startswith("m|"), of(script, "m")).otherwise(of(script, "f"))
    return F.when(canon.rlike("[Ѐ-ӿ]"), by_gender("cyrillic")).otherwise(by_gender("latin"))


def replacement(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """The surrogate of an entity in canonical form; for a given name the name alone."""
    seed = F.when(kind == "given", F.regexp_extract(canon, r"^(.*)\|", 1)).otherwise(canon)

    def made(n: Column) -> Column:
        more = F.when(attempt < WIDER, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), attempt - WIDER + 1)), lambda k: (F.element_at(n, 64 - k % 40) % 10).cast("string")), ""))
        fresh = F.array_join(F.transform(_characters(canon), lambda c, i: (F.element_at(n, i % 64 + 1) % 10).cast("string")), "")
        ip = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (F.element_at(n, i) % 254 + 1).cast("string")), ".")
        body = F.concat(F.substr(fresh, F.lit(1), F.char_length(canon) - 1), more)
        tail = (10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10
        last = F.when(_luhn(canon) % 10 == 0, tail).otherwise((tail + 1 + F.element_at(n, 64) % 9) % 10)
        return (
            F.when(kind == "email", _email(canon, n, more))
            .when(kind == "iban", _let(F.concat(_spelt(F.substr(canon, F.lit(5)), n), more), lambda b: _iban(canon, b)))
            .when(kind == "ip", F.concat(ip, F.when(more == "", "").otherwise(F.concat(F.lit(":"), more))))
            .when(kind == "card", F.concat(body, last.cast("string")))
            .when(kind == "family", _family(canon, n, attempt))
            .when(kind == "given", _given(canon, n, attempt))
            .otherwise(F.concat(fresh, more))
        )

    return _let(numbers(key, kind, seed, attempt), made)


def surrogate(key: str, kind: Column, m: Column, attempt) -> Column:
    """The replacement of a match, in its layout; attempt(kind, canon) gives the number of an entity's attempt."""
    of = lambda k, canon: replacement(key, k, canon, attempt(k, canon))
    country = F.char_length(F.regexp_extract(m, COUNTRY, 0))

    def laid(x: Column) -> Column:
        return (
            F.when(kind.isin("email", "ip"), x)
            .when(kind == "iban", _laid(m, x, "A-Z0-9"))
            .when(kind == "phone", _laid(m, x, "0-9", country))
            .otherwise(_laid(m, x, "0-9"))
        )

    title = F.regexp_extract(m, rf"^((?:{_TITLE})\.? )", 1)
    return F.when(kind == "name", F.concat(title, surrogate_name(key, m, attempt))).otherwise(_let(of(kind, canonical(kind, m)), laid))


def surrogate_name(key: str, m: Column, attempt) -> Column:
    """The new name for a match that is a name, without the form of address."""
    of = lambda k, canon: replacement(key, F.lit(k), canon, attempt(F.lit(k), canon))
    last = of("family", family(m))
    return F.when(given(m) == "", last).otherwise(F.concat_ws(" ", of("given", given(m)), last))


def mentions(piece: Column, names: Column) -> Column:
    """A piece of text between entities with the further mentions of names (old, new, old_family, new_family) replaced."""
    alone = lambda s: F.concat(F.lit(r"(?<![\p{L}\p{N}\-'])"), s, F.lit(r"(?![\p{L}\p{N}\-]|'(?!s(?!\p{L}))\p{L})"))
    whole = F.aggregate(names, piece, lambda s, x: F.regexp_replace(s, alone(x["old"]), x["new"]))
    return F.aggregate(names, whole, lambda s, x: F.regexp_replace(s, alone(x["old_family"]), x["new_family"]))


#: Stands around entities while a text is taken apart.
MARK = "\u0001"


def pieces(text: Column) -> Column:
    """The text cut at its entities: what lies between them at even places, they themselves at odd ones; one search a text."""
    marked = F.split(F.regexp_replace(text, ENTITY, f"{MARK}$0{MARK}"), MARK)
    between, found = F.split(text, ENTITY, -1), F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))
    woven = F.flatten(F.zip_with(between, found, lambda a, b: F.when(b.isNull(), F.array(a)).otherwise(F.array(a, b))))
    # a text that holds the mark itself is searched twice
    return F.when(~text.rlike(HINT), F.array(text)).when(text.contains(MARK), woven).otherwise(marked)


def entities_in(cut_text: Column) -> Column:
    return F.filter(cut_text, lambda x, i: i % 2 == 1)


def matches(docs: DataFrame) -> DataFrame:
    """k1, k2 (hashes of the text), m: the different matches of every text that has one."""
    d = docs.select(F.xxhash64("text").alias("k1"), F.hash("text").alias("k2"), F.array_distinct(entities_in(pieces(F.col("text")))).alias("found"))
    return d.where(F.size("found") > 0).select("k1", "k2", F.explode("found").alias("m"))


def entities(found: DataFrame) -> DataFrame:
    """kind and canon of every different entity; found has m."""
    return found.select("m").distinct().select(F.explode(atoms(F.col("m"))).alias("a")).select("a.*").distinct()


def exceptions(known: DataFrame, key: str) -> DataFrame:
    """kind, canon, attempt of the entities whose first surrogate would collide; known is entities() as a stored table.

    Of given names only those with the same family name must differ, and each from itself.
    """
    kind, canon = F.col("kind"), F.col("canon")
    moved = None
    while True:  # each attempt from WIDER on has ten times the room of the one before
        if moved is None:
            at = known.withColumn("attempt", F.lit(0))
        else:
            at = known.join(moved, ["kind", "canon"], "left").withColumn("attempt", F.coalesce("attempt", F.lit(0)))
        new = replacement(key, kind, canon, F.col("attempt"))
        new = F.when(kind == "given", F.concat_ws("|", F.regexp_extract(canon, "^(.)", 1), new, F.regexp_extract(canon, r"\|([^|]*)$", 1))).otherwise(new)
        at = cut(at.select("kind", "canon", "attempt", new.alias("new")), "pii-surrogates")
        first = at.groupBy("kind", "new").agg(F.min("canon").alias("owner"), F.count(F.lit(1)).alias("n"))
        shared = at.join(first.where("n > 1"), ["kind", "new"]).where("canon <> owner").select("kind", "canon", "attempt")
        real = at.where("kind <> 'given'").join(known.select("kind", F.col("canon").alias("new")), ["kind", "new"], "left_semi").select("kind", "canon", "attempt")
        itself = at.where("kind = 'given' AND new = canon").select("kind", "canon", "attempt")
        again = shared.union(real).union(itself).distinct().withColumn("attempt", F.col("attempt") + 1)
        rest = at.where("attempt > 0").select("kind", "canon", "attempt").join(again.select("kind", "canon"), ["kind", "canon"], "left_anti")
        both = cut(rest.withColumn("open", F.lit(False)).union(again.select("kind", "canon", "attempt", F.lit(True))), "pii-exceptions")
        settled = not both.where("open").limit(1).count()
        drop(at)
        drop(moved)
        moved = both.drop("open")
        moved._tidemark_path = both._tidemark_path
        if settled:
            return moved


def replace_entities(docs: DataFrame, key: str, count: bool = False) -> DataFrame:
    """docs with every entity in text replaced; with count, also n_entities and the kinds replaced, by kind.

    The columns of docs stay as they are, but for text. Further mentions of names are not counted.
    """
    found = cut(matches(docs), "pii-matches")
    known = cut(entities(found), "pii-entities")
    odd = exceptions(known, key)
    drop(known)
    names = docs.columns
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in names if c != "text"], F.lit(0).alias("_")).alias("_row"), F.col("text").alias("_text"))
    if odd.limit(1).count():
        # texts that hold an exception get a list of their attempts; k1, k2 stand for the text
        hit = found.withColumn("a", F.explode(atoms(F.col("m")))).select("k1", "k2", "a.*").distinct().join(odd, ["kind", "canon"])
        lists = hit.groupBy("k1", "k2").agg(F.collect_list(F.struct("kind", "canon", "attempt")).alias("_odd"))
        lists = cut(lists, "pii-lists").withColumnsRenamed({"k1": "_l1", "k2": "_l2"})
        d = d.join(lists, (F.xxhash64("_text") == F.col("_l1")) & (F.hash("_text") == F.col("_l2")), "left")
        attempt = lambda k, c: F.coalesce(F.get(F.filter("_odd", lambda x: (x["kind"] == k) & (x["canon"] == c)), F.lit(0))["attempt"], F.lit(0))
    else:
        attempt = lambda k, c: F.lit(0)
    d = d.withColumn("_cut", pieces(F.col("_text")))
    d = d.withColumn("_found", F.when(F.size("_cut") > 1, F.transform(entities_in(F.col("_cut")), lambda m: F.struct(kind_of(m).alias("kind"), m.alias("m")))).otherwise(F.array().cast("array<struct<kind:string,m:string>>")))
    d = d.withColumn("_new", F.transform("_found", lambda x: surrogate(key, x["kind"], x["m"], attempt)))
    named = F.array_distinct(
        F.transform(
            F.filter("_found", lambda x: x["kind"] == "name"),
            lambda x: F.struct(
                untitled(x["m"]).alias("old"), surrogate_name(key, x["m"], attempt).alias("new"), family(x["m"]).alias("old_family"), F.regexp_extract(surrogate_name(key, x["m"], attempt), "([^ ]+)$", 1).alias("new_family")
            ),
        )
    )
    d = d.withColumn("_names", named)
    woven = F.transform("_cut", lambda x, i: F.when(i % 2 == 1, F.get("_new", F.floor(i / 2).cast("int"))).when(F.size("_names") > 0, mentions(x, F.col("_names"))).otherwise(x))
    whole = F.when(F.size("_found") > 0, F.array_join(woven, "")).otherwise(F.col("_text"))
    out = [whole.alias("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in names]
    if count:
        of_kind = lambda k: F.size(F.filter("_found", lambda x: x["kind"] == k))
        out += [F.size("_found").cast("bigint").alias("n_entities"), *[of_kind(k).cast("bigint").alias(f"n_{k}") for k in KINDS]]
    return d.select(*out)
