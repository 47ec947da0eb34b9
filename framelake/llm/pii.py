"""Personal data replaced by keyed surrogates of the same type and format, with built-in functions only.

Entities are found by one pattern: addresses of mail, payment cards, phone and social security numbers, IPv4
addresses, and names after a form of address. An entity's canonical form (digits alone, lower case) decides
its surrogate, so that all its spellings in all documents are replaced alike, each in its own layout:

- numbers go through a keyed Feistel network of modular additions over their two halves, a one-to-one map of
  the numbers of that length (cards keep their check sum, phones the digits before the last ten);
- IPv4 addresses go through the same network over their two 16-bit halves;
- mail addresses get keyed letters and digits in the places of the old ones, and a keyed domain;
- names get a given name that fits the form of address (and script) and a family name made of syllables. The
  family name's surrogate follows from the family name (the last part) alone, so that a person with and without
  given name agree; in the same document, the name without a form of address is replaced as well (not counted).

Those of mail, family names and given names can collide. All different entities are gathered once; surrogates that
two of them share, or that are a real mail address or family name, are found, and all but the first of such a group
(the real ones: all) are made anew, until there are none. The few remade ones are joined to the documents that hold
them; all other documents are rewritten where they lie. Numbers are one-to-one by construction; one may be another's.

The key is an argument without a default: it is a secret, as the map of numbers can be undone with it. Any run of 13
to 19 digits is treated as a card, whether or not its check sum holds, as long numbers of other kinds identify too.

Null texts stay null, with no entities; repeated rows are rewritten alike; empty tables give no rows; other
columns are not read. Texts without entities stay as they are.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

ROUNDS = 4
_EDGE, _END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
MAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}"
IP = rf"(?<![\p{{L}}\p{{N}}_.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\p{{L}}\p{{N}}_]|\.\d)"
SSN = rf"{_EDGE}\d{{3}}-\d{{2}}-\d{{4}}{_END}"
PHONE = rf"(?:\+\d{{1,3}}[ .-]?(?:\(\d{{2,4}}\)|\d{{2,4}})(?:[ .-]?\d{{2,4}}){{2,3}}|{_EDGE}\d{{3}}[.-]\d{{3}}[.-]\d{{4}}|(?<![\p{{L}}\p{{N}}_])\(\d{{3}}\) ?\d{{3}}[ .-]\d{{4}}){_END}"
CARD = rf"{_EDGE}\d(?:[ -]?\d){{12,18}}{_END}"
_MALE, _FEMALE, _ANY = "Mr|Herr|Monsieur|Señor|г-н", "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|г-жа", "Dr|Prof"
_TITLE = rf"(?:{_MALE}|{_FEMALE}|{_ANY})\.? "
_PARTICLE = "(?:von|van|vom|der|den|dem|de|del|della|di|da|do|dos|das|du|des|la|las|los|le|zu|zur|zum|und zu|ten|ter|bin|ibn|al|el|y|af|av|фон|де) "
#: One part of a name: inner capitals, hyphens and apostrophes, but no form of address, no suffix and no possessive s.
_PART = rf"(?!{_TITLE}|(?:Jr|Sr|II|III|IV){_END})(?:(?:\p{{Lu}}\. (?=\p{{Lu}}))|(?:(?:d|l|dell)['’]|(?:al|el)-)?\p{{Lu}}[\p{{L}}\p{{M}}]*+(?:['’-](?!s{_END})\p{{L}}[\p{{L}}\p{{M}}]*+)*+)"
NAME = rf"{_EDGE}(?:{_TITLE})+(?:{_PARTICLE})*{_PART}(?:(?<= ){_PART}| (?:{_PARTICLE})*{_PART})*{_END}"
ANY = "|".join((MAIL, SSN, IP, PHONE, CARD, NAME))

#: Given names by form of address and script, and syllables of family names (fixed values).
GIVEN = {
    ("m", "latin"): "Adam Boris Carl Daniel Erik Felix Georg Hugo Ivan Jonas Karl Leon Martin Noah Oscar Paul",
    ("f", "latin"): "Anna Berta Clara Diana Elena Frida Greta Helga Irene Julia Katrin Laura Maria Nora Olga Paula",
    ("x", "latin"): "Alex Robin Sascha Kim Toni Jordan Casey Morgan Taylor Jamie Riley Quinn Avery Rowan Skyler Charlie",
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег Павел Роман Сергей Тимур",
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Ксения Лариса Мария Нина Ольга Полина Рита Софья",
    ("x", "cyrillic"): "Саша Женя Валя Слава Шура Ника Мика Тоша Паша Лёша Вася Гоша Даня Лиля Тоня Юля",
}
SYLLABLES = {"latin": "ba be di do fa fe ga ko la le ma mi na ro sa ta", "cyrillic": "ба бе ди до фа фе га ко ла ле ма ми на ро са та"}


def _hash(key: str, *parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts])), 1, 15), 16, 10).cast("long")


def _feistel(key: str, left: Column, right: Column, m: Column, n: Column, tag: Column) -> tuple[Column, Column]:
    for r in range(ROUNDS):
        if r % 2:
            right = F.pmod(right + F.pmod(_hash(key, tag, F.lit(r), left), n), n)
        else:
            left = F.pmod(left + F.pmod(_hash(key, tag, F.lit(r), right), m), m)
    return left, right


def _number(key: str, digits: Column, kind: Column) -> Column:
    """A one-to-one, keyed map of the digit strings of each length and kind."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    ten = lambda k: F.pow(F.lit(10.0), k).cast("long")
    left, right = _feistel(key, F.substring(digits, F.lit(1), half).cast("long"), F.substring(digits, half + 1, n - half).cast("long"), ten(half), ten(n - half), F.concat(kind, n.cast("string")))
    return F.concat(F.lpad(left.cast("string"), half, "0"), F.lpad(right.cast("string"), n - half, "0"))


def _luhn(digits: Column) -> Column:
    """Sum of the check rule modulo 10, with the last digit counted as it is."""
    back = F.split(F.reverse(digits), "")
    each = F.transform(back, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, 2 * c.cast("int") - 9).otherwise(2 * c.cast("int"))))
    return F.pmod(F.aggregate(each, F.lit(0), lambda a, b: a + b), F.lit(10))


def _card(key: str, digits: Column) -> Column:
    """Keyed but for the last digit, which keeps the check sum what it was."""
    head = _number(key, F.substring(digits, F.lit(1), F.length(digits) - 1), F.lit("card"))
    return F.concat(head, F.pmod(_luhn(digits) - _luhn(F.concat(head, F.lit("0"))), F.lit(10)).cast("string"))


def _ip(key: str, text: Column) -> Column:
    o = F.transform(F.split(text, r"\."), lambda x: x.cast("long"))
    a, b = _feistel(key, o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), F.lit("ip"))
    return F.concat_ws(".", *[x.cast("string") for x in (F.shiftright(a, 8), a.bitwiseAND(F.lit(255)), F.shiftright(b, 8), b.bitwiseAND(F.lit(255)))])


def _letters(key: str, seed: Column, like: Column) -> Column:
    """Keyed letters and digits in the layout of `like`: letters for letters, digits for digits, the rest as it is."""
    stream = F.concat(F.md5(F.concat_ws("|", F.lit(key), seed, F.lit("0"))), F.md5(F.concat_ws("|", F.lit(key), seed, F.lit("1"))))
    chars = F.split(like, "")
    at = lambda i: F.conv(F.substring(stream, F.pmod(i * 2, F.lit(62)) + 1, F.lit(2)), 16, 10).cast("int")
    return F.concat_ws("", F.transform(chars, lambda c, i: F.when(c.rlike(r"\p{N}"), F.pmod(at(i), F.lit(10)).cast("string")).when(c.rlike(r"\p{L}"), F.char(97 + F.pmod(at(i), F.lit(26)))).otherwise(c)))


def _mail(key: str, mail: Column, attempt: Column) -> Column:
    user, domain = F.substring_index(mail, "@", 1), F.substring_index(mail, "@", -1)
    # short users get more letters, so that there are enough of them to tell all addresses apart
    return F.concat(_letters(key, F.concat_ws("|", mail, attempt), F.concat(F.lit("aaaaaa"), user)), F.lit("@"), _letters(key, F.concat(F.lit("domain|"), domain), F.regexp_replace(F.substring_index(domain, ".", 1), r".*", "aaaaaaaa")), F.lit(".example"))


def _syllables(script: Column, h, n: int) -> Column:
    made = F.lit(None).cast("string")
    for s, parts in SYLLABLES.items():
        table = F.array(*map(F.lit, parts.split()))
        made = F.coalesce(made, F.when(script == s, F.initcap(F.concat(*[table[h(i)] for i in range(1, n + 1)]))))
    return made


def _family(key: str, name: Column, attempt: Column) -> Column:
    """canonical is script|family name."""
    return _syllables(F.split(name, r"\|")[0], lambda i: F.pmod(_hash(key, name, attempt, F.lit(i)), F.lit(16)).cast("int"), 6)


def _given(key: str, name: Column, attempt: Column) -> Column:
    """canonical is gender|script|given names; a remade one has a second part, so that there are enough of them."""
    gender, script = F.split(name, r"\|")[0], F.split(name, r"\|")[1]
    h = lambda i: F.pmod(_hash(key, name, attempt, F.lit(i)), F.lit(16)).cast("int")
    given = F.lit(None).cast("string")
    for (g, s), names in GIVEN.items():
        given = F.coalesce(given, F.when((gender == g) & (script == s), F.array(*map(F.lit, names.split()))[h(0)]))
    return F.when(attempt > 0, F.concat_ws("-", given, _syllables(script, h, 4))).otherwise(given)


def _bare(e: Column) -> Column:
    """A name without its forms of address."""
    return F.regexp_replace(e, rf"^(?:{_TITLE})+", "")


def _last(name: Column) -> Column:
    return F.substring_index(name, " ", -1)


def _typed(e: Column) -> Column:
    """kind and canonical form of an entity, and of a name's given names (null without)."""
    digits = F.regexp_replace(e, r"\D", "")
    title, rest = F.regexp_extract(e, rf"^(?:{_TITLE})+", 0), F.regexp_replace(_bare(e), "’", "'")
    gender = F.when(title.rlike(rf"{_EDGE}(?:{_MALE})\.? "), "m").when(title.rlike(rf"{_EDGE}(?:{_FEMALE})\.? "), "f").otherwise("x")
    script = F.when(rest.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    family = F.lower(_last(rest))
    words = F.trim(F.regexp_replace(F.substring(rest, F.lit(1), F.length(rest) - F.length(family)), rf"{_EDGE}{_PARTICLE}", ""))
    given = F.when(words != "", F.concat_ws("|", gender, script, F.lower(words)))
    s = lambda kind, canonical, given=F.lit(None).cast("string"): F.struct(F.lit(kind).alias("kind"), canonical.alias("canonical"), given.alias("given"))
    return (
        F.when(e.contains("@"), s("mail", F.lower(e))).when(e.rlike(rf"^{SSN}$"), s("ssn", digits)).when(e.rlike(rf"^{IP}$"), s("ip", e))
        .when(e.rlike(rf"^(?:{PHONE})$"), s("phone", F.when(F.length(digits) > 10, F.right(digits, F.lit(10))).otherwise(digits)))
        .when(e.rlike(r"^\d"), s("card", digits)).otherwise(s("name", F.concat_ws("|", script, family), given))
    )


def _surrogate(key: str, kind: Column, canonical: Column, attempt: Column) -> Column:
    """The canonical form of an entity's surrogate."""
    return F.when(kind == "mail", _mail(key, canonical, attempt)).when(kind == "ip", _ip(key, canonical)).when(kind == "card", _card(key, canonical)).when(kind == "name", _family(key, canonical, attempt)).when(kind == "given", _given(key, canonical, attempt)).otherwise(_number(key, canonical, kind))


def _surrogates(key: str, entities: DataFrame) -> DataFrame:
    return entities.withColumn("surrogate", _surrogate(key, F.col("kind"), F.col("canonical"), F.col("attempt")))


def _laid_out(e: Column, kind: Column, surrogate: Column) -> Column:
    """The surrogate in the layout of one occurrence."""
    before = lambda i: F.length(F.regexp_replace(F.substring(e, F.lit(1), i), r"\D", ""))
    skip = F.length(F.regexp_replace(e, r"\D", "")) - F.length(surrogate)
    digit = lambda i: F.substring(surrogate, before(i) - skip + 1, F.lit(1))
    number = F.concat_ws("", F.transform(F.split(e, ""), lambda ch, i: F.when(ch.rlike(r"\d") & (before(i) >= skip), digit(i)).otherwise(ch)))
    upper = lambda x: F.when(e == F.upper(e), F.upper(x)).otherwise(x)
    return F.when(kind == "mail", upper(surrogate)).when(kind == "ip", surrogate).when(kind == "name", F.concat(F.regexp_extract(e, rf"^(?:{_TITLE})+", 0), surrogate)).otherwise(number)


def _may_hold(text: Column) -> Column:
    """False only for texts without any entity: a cheap look before the full pattern."""
    titles = [text.contains(t) for t in f"{_MALE}|{_FEMALE}|{_ANY}".split("|")]
    return functools.reduce(lambda a, b: a | b, titles, text.contains("@") | text.rlike(r"\d\D{0,3}\d\D{0,3}\d\D{0,3}\d"))


def entities_of(text: Column) -> Column:
    """All entities of a text in order, each with its kind and canonical form."""
    found = F.when(_may_hold(text), F.regexp_extract_all(text, F.lit(ANY), 0)).otherwise(F.array().cast("array<string>"))
    return F.transform(found, lambda e: F.struct(e.alias("e"), _typed(e).alias("t")))


def _gendered(entities: Column) -> Column:
    """Given names after a form of address for either gender take the gender that the document tells elsewhere.

    So Mr. John Smith and Dr. John Smith of one document are one person; of two genders the first by name counts.
    """
    told = F.array_sort(F.array_distinct(F.transform(F.filter(entities, lambda x: x["t"]["given"].rlike("^[mf]")), lambda x: F.concat_ws("|", F.substring(x["t"]["given"], 3, 1 << 20), F.lit(""), x["t"]["canonical"], F.lit(""), x["t"]["given"]))))
    who = lambda t: F.concat_ws("|", F.substring(t["given"], 3, 1 << 20), F.lit(""), t["canonical"], F.lit(""))
    same = lambda t: F.try_element_at(F.filter(told, lambda y: y.startswith(F.concat(who(t), F.lit("|")))), F.lit(1))
    given = lambda t: F.when(t["given"].startswith("x|"), F.coalesce(F.substring_index(same(t), "||", -1), t["given"])).otherwise(t["given"])
    return F.transform(entities, lambda x: F.struct(x["e"].alias("e"), F.struct(x["t"]["kind"].alias("kind"), x["t"]["canonical"].alias("canonical"), given(x["t"]).alias("given")).alias("t")))


def _real(kind: Column, surrogate: Column) -> Column:
    """What the surrogate would be as an entity's canonical form, to find it among the real ones."""
    script = F.when(surrogate.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    return F.when(kind == "name", F.concat_ws("|", script, F.lower(surrogate))).otherwise(F.lower(surrogate))


def collisions(entities: DataFrame, key: str) -> DataFrame | None:
    """kind, canonical and surrogate of the entities whose first surrogate is another's too, or is a real entity; None if there are none.

    entities (kind, canonical) are different and should be a written table.
    """
    fixed, attempt = None, 0
    real = entities.where("kind in ('mail', 'name')").select("kind", F.col("canonical").alias("real"))
    now = _surrogates(key, entities.where("kind in ('mail', 'name', 'given')").withColumn("attempt", F.lit(0)))
    first = now
    while True:
        least = now.groupBy("kind", "surrogate").agg(F.min("canonical").alias("keeper"), F.count("*").alias("n")).where("n > 1").select("kind", "surrogate", "keeper")
        shared = now.join(least, ["kind", "surrogate"]).where("canonical <> keeper").select("kind", "canonical")
        taken = now.withColumn("real", _real(F.col("kind"), F.col("surrogate"))).join(real, ["kind", "real"], "left_semi").select("kind", "canonical")
        again = written(shared.union(taken).distinct(), "again")
        if again.isEmpty():
            return fixed
        attempt += 1
        made = _surrogates(key, again.withColumn("attempt", F.lit(attempt)))
        kept = fixed.join(again, ["kind", "canonical"], "left_anti") if fixed is not None else None
        fixed = written(made.drop("attempt") if kept is None else kept.unionByName(made.drop("attempt")), "remade")
        now = first.join(fixed.select("kind", "canonical"), ["kind", "canonical"], "left_anti").select("kind", "canonical", "surrogate").unionByName(fixed.select("kind", "canonical", "surrogate"))


def _keys(x: Column) -> Column:
    """What of an entity gets a surrogate of its own: it, and a name's given names."""
    t = x["t"]
    return F.array(F.struct(t["kind"].alias("kind"), t["canonical"].alias("canonical")), F.struct(F.lit("given").alias("kind"), t["given"].alias("canonical")))


def with_surrogates(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_entities and the text with each entity replaced; who has the key can undo the numbers' surrogates."""
    if not key:
        raise ValueError("surrogates need a secret key")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # a generated column is worked out once a row, where a projected one is once for each of its uses
    listed = docs.select("doc_id", "text", F.explode_outer(F.array(entities_of(F.col("text")))).alias("entities"))
    doubtful = F.exists("entities", lambda x: x["t"]["given"].startswith("x|")) & F.exists("entities", lambda x: x["t"]["given"].rlike("^[mf]"))
    listed = listed.withColumn("entities", F.when(doubtful, _gendered(F.col("entities"))).otherwise(F.col("entities")))
    some = listed.where("size(entities) > 0").select("doc_id", F.xxhash64("text").alias("tag"), F.explode(F.flatten(F.transform("entities", _keys))).alias("t")).where("t.canonical is not null").select("doc_id", "tag", "t.kind", "t.canonical").distinct()
    some = written(some, "entities")
    fixed = collisions(written(some.select("kind", "canonical").distinct(), "distinct-entities"), key)
    if fixed is None:
        listed = listed.withColumn("remade", F.lit(None).cast("map<string,string>"))
    else:
        mine = some.join(fixed, ["kind", "canonical"]).groupBy("doc_id", "tag").agg(F.map_from_entries(F.collect_list(F.struct("canonical", "surrogate"))).alias("remade")).withColumnRenamed("doc_id", "id")
        listed = listed.withColumn("tag0", F.xxhash64("text")).join(mine, F.expr("doc_id <=> id and tag0 = tag"), "left").drop("id", "tag", "tag0")
    gaps = F.when(F.size("entities") > 0, F.split("text", ANY, -1))
    rewritten = _rewritten(key, listed, gaps)
    return rewritten.select(F.col("doc_id").alias(id_col), F.size("entities").alias("n_entities"), F.col("new_text").alias(text_col))


def _rewritten(key: str, listed: DataFrame, gaps: Column) -> DataFrame:
    made = lambda kind, canonical: F.coalesce(F.element_at("remade", canonical), _surrogate(key, kind, canonical, F.lit(0)))
    own = F.transform("entities", lambda x: F.struct(x["e"].alias("e"), x["t"]["kind"].alias("kind"), made(x["t"]["kind"], x["t"]["canonical"]).alias("surrogate"), F.when(x["t"]["given"].isNotNull(), made(F.lit("given"), x["t"]["given"])).alias("given")))
    # generated, as in with_surrogates, to be worked out once a row
    listed = listed.select("*", F.explode_outer(F.array(own)).alias("own"))
    new = F.transform("own", lambda x: _laid_out(x["e"], x["kind"], F.when(x["kind"] == "name", F.concat_ws(" ", x["given"], x["surrogate"])).otherwise(x["surrogate"])))
    # names as written, the longest first, for their mentions without a form of address
    entry = lambda word, by: F.struct((-F.length(word)).alias("order"), word.alias("word"), by.alias("by"))
    names = F.transform(F.filter("own", lambda x: x["kind"] == "name"), lambda x: F.array(entry(_bare(x["e"]), F.concat_ws(" ", x["given"], x["surrogate"])), entry(_last(_bare(x["e"])), x["surrogate"])))
    listed = listed.select("*", F.explode_outer(F.array(F.array_sort(F.array_distinct(F.flatten(names))))).alias("names"))
    again = lambda g: F.aggregate("names", g, lambda text, n: F.regexp_replace(text, F.concat(F.lit(_EDGE + r"\Q"), n["word"], F.lit(r"\E" + _END)), n["by"]))
    both = F.concat_ws("", F.flatten(F.zip_with(gaps, new, lambda g, e: F.array(again(g), F.coalesce(e, F.lit(""))))))
    return listed.withColumn("new_text", F.when(F.size("entities") > 0, both).otherwise(F.col("text"))).withColumn("entities", F.coalesce("entities", F.filter(entities_of(F.lit("")), lambda x: F.lit(True))))
