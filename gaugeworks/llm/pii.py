"""Surrogates for personal data and secrets: keyed, type-consistent, distinct and coreferent.

One pass over the texts finds entities (one alternation of linear patterns) and writes them beside the rows;
the second pass replaces them from there. An entity has a canonical form (an e-mail address in lower case, a
number's digits, a North American number without its country code, a person's names without the title), so that
one entity has one surrogate in all spellings and documents; the surrogate keeps the format of each spelling:
separators, letter case, lengths, a card's first digit and check digit, an IBAN's country and check digits, a
name's gender and script. Its characters come from a keyed SHA-512.

People are found by their titles. Each word of such a name has a surrogate of its own, keyed by the word and the
title's gender, and is replaced wherever it stands in that text as a word: "Mrs. Anna Smith", "Ms. Smith" and a
bare "Anna Smith" stay one person. The text's first title for a word decides its gender. (Time is linear in the
text times the number of different names in it.)

Collision check over the whole corpus: where two entities of a kind share a surrogate, or a surrogate is itself
an entity of the corpus, all but the first are drawn again with a counter, until none is left. From the second
time on the format widens by a character each time, so that a small format runs out for no one. Only redrawn
entities are ever joined back to documents, and only they are looked up again.

Defined results. Null text stays null with 0 entities; empty text stays empty; a text without entities is
unchanged to the byte; repeated rows and ids change alike; other columns pass through untouched, whatever their
names (an input column named n_entities or kinds gives way to the operator's own).
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, table, unwrapped, wrapped, written

#: The key of surrogates where the session sets none (tests): set KEY_CONF to a secret of your own.
KEY, KEY_CONF = "gaugeworks-surrogates", "spark.gaugeworks.pii.key"

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_TITLES_F = r"Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Госпожа|госпожа|Κυρία|κυρία"
_TITLES_M = r"Mr|Herr|Monsieur|Señor|Господин|господин|Κύριος|κύριος"
#: kind -> pattern, in the order of trial. Runs are possessive and anchored, so time is linear in the text.
KINDS: dict[str, str] = {
    "pem": r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----[^-]++-----END [A-Z ]{0,32}PRIVATE KEY-----",
    "jwt": r"\beyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+",
    "secret": r"(?i:\b(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key))[\"']?\s{0,3}[=:]\s{0,3}[\"']?(?=[^\s\"'<>,;]{0,64}\d)[^\s\"'<>,;]{6,}+",
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}+",
    "cloud_key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "ipv6": r"(?<![\w:])(?=[A-Fa-f:]{0,40}\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\w-])\d{3}-\d{3}-\d{4}(?![\w-])",
    "card": r"(?<![\w.-])[2-6](?:[ -]?\d){12,18}(?![\w-])",
    "national_id": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "ip": rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)",
    "person_f": rf"\b(?:{_TITLES_F})\.? \p{{Lu}}\p{{Ll}}++(?: \p{{Lu}}\p{{Ll}}++)?+",
    "person_m": rf"\b(?:{_TITLES_M})\.? \p{{Lu}}\p{{Ll}}++(?: \p{{Lu}}\p{{Ll}}++)?+",
}
UNION = "|".join(f"(?:{p})" for k, p in KINDS.items() if not k.startswith("person"))
TITLED = "|".join(f"(?:{p})" for k, p in KINDS.items() if k.startswith("person"))
#: No entity is without a digit or one of these marks, and no titled name without one of a title's letters: plain
#: searches for bytes, so that most texts never meet a long pattern.
MARKS = ("@", "AKIA", "ASIA", "eyJ", "PRIVATE KEY-----")
TITLE_MARKS = ("Mr", "Ms", "Miss", "Frau", "Herr", "Madame", "Mme", "Monsieur", "Señor", "Sra", "оспо", "υρία", "ύριος")
NUMBERS = ("phone", "card", "national_id")
_FOUND = "array<struct<entity:string,kind:string,canons:array<string>>>"


def _any(text: Column, marks: tuple[str, ...]) -> Column:
    return reduce(or_, [text.contains(m) for m in marks])


def kind_of(entity: Column) -> Column:
    """The first kind that fits; null for what only looks like a card or an IBAN: its check digits are wrong."""
    out = None
    for k, p in KINDS.items():
        if k.startswith("person"):
            continue  # found by the names of the text
        found = entity.rlike(f"^(?:{p})$")
        if k == "card":
            found = found & (_luhn(F.regexp_replace(entity, r"\D", "")) == 0)
        elif k == "iban":
            found = found & (_mod97(F.regexp_replace(entity, " ", "")) == 1)
        out = F.when(found, k) if out is None else out.when(found, k)
    return out


def _mod97(iban: Column) -> Column:
    """The remainder of an IBAN without blanks, its first four characters moved to the end: 1 if it is valid."""
    moved = F.split(F.concat(iban.substr(F.lit(5), F.length(iban)), F.substring(iban, 1, 4)), "")
    code = lambda c: F.ascii(c)
    return F.aggregate(F.filter(moved, lambda c: c != ""), F.lit(0), lambda t, c: F.when(code(c) >= 65, (t * 100 + code(c) - 55) % 97).otherwise((t * 10 + code(c) - 48) % 97))


def _luhn(digits: Column) -> Column:
    """0 for a valid number."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 1, (d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")).otherwise(d.cast("int")))
    return F.aggregate(F.filter(each, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x) % 10


def head_of(entity: Column, kind: Column) -> Column:
    """What stays as it is: a secret's name, a key's prefix, an IBAN's country, a phone's country code, a card's first digit."""
    return (
        F.when(kind == "secret", F.regexp_extract(entity, r"^[^=:]*[=:]\s*[\"']?", 0))
        .when(kind == "cloud_key", F.substring(entity, 1, 4))
        .when(kind == "jwt", F.substring(entity, 1, 3))
        .when(kind == "pem", F.regexp_extract(entity, r"^-----BEGIN [^-]*-----", 0))
        .when(kind == "iban", F.substring(entity, 1, 2))
        .when(kind == "phone", F.regexp_extract(entity, r"^(?:\+1(?=[ .(-]|\d{10}$)|\+\d{1,3}(?=[ .(-]))", 0))
        .when(kind == "card", F.substring(entity, 1, 1))
        .otherwise("")
    )


def canonical(entity: Column, kind: Column) -> Column:
    """What all spellings of an entity share (of the kinds but persons)."""
    digits = F.regexp_replace(entity, r"\D", "")
    return (
        F.when(kind.isin("email", "ipv6"), F.lower(entity))
        .when(kind == "phone", F.when(entity.startswith("+1"), F.regexp_replace(digits, r"^1(?=\d{10}$)", "")).otherwise(digits))
        .when(kind.isin(*NUMBERS), digits)
        .when(kind == "iban", F.regexp_replace(entity, " ", ""))
        .when(kind == "secret", entity.substr(F.length(head_of(entity, kind)) + 1, F.length(entity)))
        .otherwise(entity)
    )


def _byte(seed: Column, i: Column) -> Column:
    """The i-th byte of the keyed stream."""
    block = F.sha2(F.concat(seed, F.lit("|"), F.floor(i / 64).cast("string")), 512)
    return F.conv(F.substring(block, (2 * (i % 64) + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _letter(alphabet: str, n: Column) -> Column:
    return F.substring(F.lit(alphabet), (n % len(alphabet) + 1).cast("int"), F.lit(1))


_SCRIPTS = {  # consonants and vowels; endings by gender
    r"\p{IsCyrillic}": ("бвгдзклмнпрст", "аеиоу", "а", "н"),
    r"\p{IsGreek}": ("βγδζκλμνπρστ", "αεοηι", "α", "ς"),
    r".": ("bcdfgklmnprstv", "aeiou", "a", "n"),
}


def _name(word: Column, seed: Column, female: Column, extra: Column) -> Column:
    """A capitalized word of the same script: syllables, and an ending for the gender."""

    def by_script(value) -> Column:
        out = None
        for script, letters in _SCRIPTS.items():
            out = F.when(word.rlike(script), F.lit(value(letters))) if out is None else out.when(word.rlike(script), F.lit(value(letters)))
        return out

    # consonants and vowels take turns; one expression serves all places and scripts, which keeps the plan small
    of = lambda j: F.when(j % 2 == 0, by_script(lambda s: s[0])).otherwise(by_script(lambda s: s[1]))
    drawn = F.transform(F.sequence(F.lit(0), 7 + 2 * extra), lambda j: F.struct(of(j).alias("of"), _byte(seed, j).alias("b")))
    letters = F.array_join(F.transform(drawn, lambda x: F.substring(x.of, (x.b % F.length(x.of) + 1).cast("int"), F.lit(1))), "")
    ending = F.when(female, by_script(lambda s: s[0][6] + s[2])).otherwise(by_script(lambda s: s[3]))
    return F.coalesce(F.initcap(F.concat(letters, ending)), word)


def surrogates(found: Column, key: str = KEY) -> Column:
    """array<struct<entity, kind, canons, attempts>> -> the surrogates, null where the kind is null.

    Letters and digits are numbered in the canonical form, so that all spellings of an entity agree. The
    steps are nested transforms, so that each step's values are computed once.
    """

    def widened(attempt: Column) -> Column:
        return F.greatest(F.lit(0), attempt - 1)

    def parts(e: Column) -> Column:
        return F.struct(
            e.kind.alias("kind"),
            head_of(e.entity, e.kind).alias("head"),
            e.entity.alias("entity"),
            e.canons.alias("canons"),
            e.attempts.alias("attempts"),
            F.concat_ws("|", F.lit(key), e.kind, e.canons[0], e.attempts[0].cast("string")).alias("seed"),
            widened(e.attempts[0]).alias("extra"),
        )

    def rests(x: Column) -> Column:
        rest = x.entity.substr(F.length(x.head) + 1, F.length(x.entity))
        more = lambda c: F.repeat(F.lit(c), x.extra)
        wide = (
            F.when(x.kind == "email", F.concat(more("a"), rest))
            .when(x.kind.isin(*NUMBERS, "iban"), F.concat(rest, more("0")))
            .when(x.kind.isin("secret", "cloud_key", "jwt"), F.concat(rest, more("a")))
            .otherwise(rest)
        )
        return F.struct(*[x[n].alias(n) for n in ("kind", "head", "seed", "entity", "canons", "attempts", "extra")], wide.alias("rest"))

    def limits(x: Column) -> Column:
        numbers = x.kind.isin(*NUMBERS)
        # places in the canonical form, which has a country code's digits but for +1
        skip = F.when((x.kind == "phone") & (x.head == "+1"), 0).otherwise(F.length(F.regexp_replace(x.head, r"\D", "")))
        before = lambda ch, i: F.when(numbers, skip + i - F.length(F.regexp_replace(F.substring(x.rest, F.lit(1), i), r"\d", ""))).when(x.kind == "iban", F.length(F.regexp_replace(F.substring(x.rest, F.lit(1), i), " ", ""))).otherwise(i)
        chars = F.filter(F.split(x.rest, ""), lambda c: c != "")
        kept = F.when(x.kind == "email", F.length(F.substring_index(x.rest, ".", -1))).when(x.kind == "pem", F.length(F.regexp_extract(x.rest, r"-----END [^-]*-----$", 0))).otherwise(0)
        return F.struct(
            *[x[n].alias(n) for n in ("kind", "head", "seed", "entity", "canons", "attempts", "extra")],
            (F.length(x.rest) - kept).alias("tail"),
            (((x.kind == "secret") & x.rest.rlike(r"^[0-9a-f]+$")) | (x.kind == "ipv6")).alias("hexed"),
            skip.alias("skip"),
            F.transform(F.transform(chars, lambda c, i: F.struct(c.alias("c"), i.alias("i"), before(c, i).alias("n"))), lambda y: F.struct(y.c.alias("c"), y.i.alias("i"), y.n.alias("n"), _byte(x.seed, y.n).alias("b"))).alias("chars"),
        )

    def drawn(x: Column) -> Column:
        low, up, ten = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
        one = lambda y: (
            F.when((y.i >= x.tail) | (y.c == ":"), y.c)
            .when(x.hexed & y.c.between("A", "F"), _letter("0123456789ABCDEF", y.b))
            .when(x.hexed, _letter("0123456789abcdef", y.b))
            .when((x.kind == "phone") & (y.n == x.skip) & y.c.between("2", "9"), _letter("23456789", y.b))
            .when(y.c.between("0", "9"), _letter(ten, y.b))
            .when(y.c.between("A", "Z"), _letter(up, y.b))
            .when(y.c.between("a", "z"), _letter(low, y.b))
            .otherwise(y.c)
        )
        octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.when(i == 0, _byte(x.seed, i) % 212 + 11).otherwise(_byte(x.seed, i)).cast("string")), ".")
        port = F.when(x.extra > 0, F.concat(F.lit(":"), (10000 + (_byte(x.seed, F.lit(4)) * 256 + _byte(x.seed, F.lit(5))) % 50000).cast("string"))).otherwise("")
        words = F.transform(F.split(x.entity, " "), lambda w, i: _name(w, F.concat_ws("|", F.lit(key), F.lit("person"), F.get(x.canons, i), F.get(x.attempts, i).cast("string")), F.get(x.canons, i).startswith("f:"), widened(F.get(x.attempts, i))))
        made = (
            F.when(x.kind == "ip", F.concat(octets, port))
            .when(x.kind.startswith("person"), F.array_join(words, " "))
            .otherwise(F.concat(x.head, F.array_join(F.transform(x.chars, one), "")))
        )
        return F.struct(x.kind.alias("kind"), made.alias("made"))

    def checked(x: Column) -> Column:
        digits = F.regexp_replace(F.substring(x.made, F.lit(1), F.length(x.made) - 1), r"\D", "")
        luhn = F.pmod(10 - _luhn(F.concat(digits, F.lit("0"))), F.lit(10)).cast("string")
        country, rest = F.substring(x.made, 1, 2), x.made.substr(F.lit(5), F.length(x.made))
        iban = F.lpad((98 - _mod97(F.regexp_replace(F.concat(country, F.lit("00"), rest), " ", ""))).cast("string"), 2, "0")
        return F.when(x.kind == "card", F.concat(F.substring(x.made, F.lit(1), F.length(x.made) - 1), luhn)).when(x.kind == "iban", F.concat(country, iban, rest)).when(x.kind.isNotNull(), x.made)

    for step in (parts, rests, limits, drawn, checked):
        found = F.transform(found, step)
    return found


def find_entities(rows: DataFrame) -> DataFrame:
    """rows (row_, text) with pattern (of what the text may hold) and found: array<struct<entity, kind, canons>> in the order of the text, null if there is none."""
    titled = F.when(_any(F.col("text"), TITLE_MARKS), F.regexp_extract_all("text", F.lit(TITLED), F.lit(0)))
    gender = lambda t: F.when(t.rlike(rf"^(?:{_TITLES_F})\b"), "f").otherwise("m")
    words = lambda t: F.transform(F.slice(F.split(t, " "), F.lit(2), F.lit(2)), lambda w: F.struct(w.alias("word"), gender(t).alias("gender")))
    named = F.when(F.size("titled") > 0, F.flatten(F.transform("titled", words)))
    names = F.array_distinct(F.transform("named", lambda x: x.word))
    rows = rows.select("*", titled.alias("titled")).select("row_", "text", named.alias("named")).select("*", names.alias("names"))
    one = F.array_join("names", "|")
    name = F.concat(F.lit(r"|(?<![\p{L}\p{M}\d])(?:"), one, F.lit(r")(?: (?:"), one, F.lit(r"))*+(?![\p{L}\p{M}\d])"))
    hinted = F.col("names").isNotNull() | _any(F.col("text"), MARKS) | F.col("text").rlike("[0-9]")
    rows = rows.select("*", F.when(hinted, F.concat(F.lit(UNION), F.coalesce(name, F.lit("")))).alias("pattern"))
    rows = rows.select("*", F.regexp_extract_all("text", F.col("pattern"), F.lit(0)).alias("raw"))
    of = lambda w: F.concat(F.element_at(F.filter("named", lambda x: x.word == w), 1).gender, F.lit(":"), w)
    is_name = lambda e: F.coalesce(F.array_contains("names", F.substring_index(e, " ", 1)), F.lit(False))
    persons = F.transform("raw", lambda e: F.struct(e.alias("entity"), F.when(is_name(e), F.transform(F.split(e, " "), of)).alias("canons")))
    kinds = F.transform(persons, lambda x: F.struct(x.entity.alias("entity"), F.when(x.canons.isNotNull(), F.concat(F.lit("person_"), F.substring(x.canons[0], 1, 1))).otherwise(kind_of(x.entity)).alias("kind"), x.canons.alias("canons")))
    full = F.transform(kinds, lambda x: F.struct(x.entity.alias("entity"), x.kind.alias("kind"), F.coalesce(x.canons, F.array(canonical(x.entity, x.kind))).alias("canons")))
    some = F.size("raw") > 0
    return rows.select("row_", F.when(some, F.col("pattern")).alias("pattern"), F.when(some, full).alias("found"))


def _group(kind: Column) -> Column:
    return F.substring_index(kind, "_", 1)


def atoms(found: Column) -> Column:
    """What has a surrogate of its own: each word of a name, and every other entity as a whole. array<struct<grp, canon, kind, entity>>."""
    each = lambda e: F.transform(e.canons, lambda c: F.struct(_group(e.kind).alias("grp"), c.alias("canon"), e.kind.alias("kind"), F.when(e.kind.startswith("person"), c.substr(F.lit(3), F.length(c))).otherwise(e.entity).alias("entity")))
    return F.flatten(F.transform(F.filter(found, lambda e: e.kind.isNotNull()), each))


def redrawn(entities: DataFrame, key: str = KEY) -> DataFrame | None:
    """grp, canon and attempt of the entities (of atoms) whose first surrogate collides; None if there are none.

    One aggregation over all entities and first surrogates finds the values claimed twice. After that only the
    redrawn are looked up, as a broadcast where they are few, in what is real and what has been drawn.
    """
    every = written(entities.groupBy("grp", "canon").agg(F.min("kind").alias("kind"), F.min("entity").alias("entity")))

    def drawn(df: DataFrame, attempt: int) -> DataFrame:
        one = F.struct("entity", "kind", F.array("canon").alias("canons"), F.array(F.lit(attempt)).alias("attempts"))
        made = surrogates(F.array(one), key)[0]
        df = df.select("grp", "canon", "kind", "entity", made.alias("made"))
        return df.withColumn("made", F.when(F.col("grp") == "person", F.col("made")).otherwise(canonical(F.col("made"), F.col("kind"))))

    value = F.when(F.col("grp") == "person", F.expr("substring(canon, 3)")).otherwise(F.col("canon"))
    real = every.select("grp", value.alias("made"))
    first = written(drawn(every, 0))
    claims = first.select("grp", "made", "canon").union(real.select("grp", "made", F.lit(None).cast("string")))
    claims = claims.groupBy("grp", "made").agg(F.min("canon").alias("by"), F.count("canon").alias("n"), F.count_if(F.col("canon").isNull()).alias("real"))
    twice = written(claims.where("n > 0 and (n > 1 or real > 0)"))
    if twice.isEmpty():
        return None
    bad = first.join(broadcast_if_small(twice), ["grp", "made"]).where("real > 0 or canon != by")
    todo, taken, out, attempt = written(bad.select("grp", "canon", "kind", "entity")), [real, first.select("grp", "made")], [], 0
    while not todo.isEmpty():
        attempt += 1
        new = written(drawn(todo, attempt))
        asked = broadcast_if_small(new.select("grp", "made").distinct())
        held = reduce(DataFrame.union, [t.join(asked, ["grp", "made"], "left_semi") for t in taken]).distinct().withColumn("held", F.lit(True))
        own = new.groupBy("grp", "made").agg(F.min("canon").alias("by"))
        state = written(new.join(broadcast_if_small(own), ["grp", "made"]).join(broadcast_if_small(written(held)), ["grp", "made"], "left").withColumn("bad", F.col("held").isNotNull() | (F.col("canon") != F.col("by"))))
        out.append(state.where("not bad").select("grp", "canon", F.lit(attempt).alias("attempt")))
        taken.append(new.select("grp", "made"))
        todo = state.where("bad").select("grp", "canon", "kind", "entity")
    return reduce(DataFrame.union, out)


def replace_pii(docs: DataFrame, key: str | None = None, own: bool = True) -> DataFrame:
    """docs with text rewritten, and (if own) n_entities and kinds."""
    key = key or docs.sparkSession.conf.get(KEY_CONF, KEY)
    rows = written(find_entities(wrapped(docs, text=docs["text"])))
    some = rows.where("found is not null")
    again = redrawn(some.select(F.inline(atoms(F.col("found")))), key)
    if again is None:
        rows = rows.select("*", F.lit(None).cast("map<string,int>").alias("attempts"))
    else:
        ids = some.select(F.xxhash64("row_.text").alias("tk"), F.explode(F.array_distinct(F.transform(atoms(F.col("found")), lambda e: F.struct(e.grp.alias("grp"), e.canon.alias("canon"))))).alias("e")).distinct()
        maps = ids.select("tk", "e.grp", "e.canon").join(broadcast_if_small(written(again)), ["grp", "canon"]).groupBy("tk").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "grp", "canon"), "attempt"))).alias("attempts"))
        maps = written(maps)
        rows = rows.select("*", F.when(F.col("found").isNotNull(), F.xxhash64("row_.text")).alias("tk")).join(broadcast_if_small(maps), "tk", "left")
    tried = lambda kind, c: F.coalesce(F.try_element_at(F.col("attempts"), F.concat_ws("|", _group(kind), c)), F.lit(0))
    drawn = surrogates(F.transform("found", lambda e: F.struct(e.entity.alias("entity"), e.kind.alias("kind"), e.canons.alias("canons"), F.transform(e.canons, lambda c: tried(e.kind, c)).alias("attempts"))), key)
    made = F.zip_with("found", drawn, lambda e, x: F.coalesce(x, e.entity))
    rows = rows.select("row_", "found", F.when(F.col("found").isNotNull(), made).alias("made"), F.when(F.col("found").isNotNull(), F.split("row_.text", F.col("pattern"), -1)).alias("between"))
    text = F.when(F.col("found").isNull(), F.col("row_.text")).otherwise(F.array_join(F.zip_with("between", "made", lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""))
    real = F.filter(F.coalesce("found", F.array().cast(_FOUND)), lambda e: e.kind.isNotNull())
    rows = rows.select("row_", text.alias("made_"), F.size(real).cast("long").alias("n_entities"), F.transform(real, lambda e: e.kind).alias("kinds"))
    return unwrapped(rows, *(["n_entities", "kinds"] if own else []), put={next(c for c in docs.columns if c.lower() == "text"): F.col("made_")})


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
