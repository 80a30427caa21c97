"""Keyed surrogates for personal data, in Spark columns only.

Entities (mail addresses, phone and card numbers, IP addresses, titled names) are found by one pattern. Each distinct
entity, in a normal form that its spellings share, gets a replacement that is a keyed hash in its own format: digits stay
digits, a valid card number stays valid, a mail address keeps its make-up, a name keeps gender and script. A replacement
that two entities draw, or that is itself an entity of the corpus, is drawn anew in rounds until all are distinct; so
equal entities stay equal across documents and different ones stay different. Names, mail addresses and phone numbers
grow with the draws; IP addresses and card numbers can't, and if they find no free value the run fails.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.session import Scratch

# Titles of address by gender; other titles carry none.
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Mme", "Mlle", "Señora", "Sra", "Госпожа", "Κυρία")
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος")
OTHER_TITLES = ("Dr", "Prof")
_NAME = r"\p{Lu}[\p{L}'’-]{1,40}"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "ip": r"(?<![0-9.])(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9+])(?:[0-9]{4}[ -]){3}[0-9]{4}(?![0-9])|(?<![0-9A-Za-z+])[0-9]{15,16}(?![0-9A-Za-z])",
    "phone": r"(?:(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?)(?:\([0-9]{2,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])|(?<![0-9A-Za-z])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9A-Za-z.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])",
    "name": r"(?<![\p{L}\p{N}])(?:" + "|".join((*FEMALE_TITLES, *MALE_TITLES, *OTHER_TITLES)) + r")\.? " + _NAME + f"(?: {_NAME})?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
_MAYBE = r"[0-9@]|(?:" + "|".join((*FEMALE_TITLES, *MALE_TITLES, *OTHER_TITLES)) + r")\.? \p{Lu}"
ROUNDS = 40  # draws; what grows is distinct long before
# What made-up names are built from, by script.
SYLLABLES = {
    "latin": (("ba", "be", "da", "do", "fa", "ka", "ke", "la", "lo", "ma", "me", "na", "no", "pa", "ra", "ri", "sa", "so", "ta", "ti", "va", "vo"), "a", "en"),
    "cyrillic": (("ба", "ве", "га", "да", "до", "ка", "ле", "ли", "ма", "мо", "на", "не", "ра", "ри", "са", "со", "та", "ти", "ва"), "а", "ин"),
    "greek": (("βα", "γε", "δα", "κα", "λε", "λι", "μα", "μο", "να", "νε", "ρα", "ρι", "σα", "σο", "τα", "τι"), "α", "ος"),
}


def _kind(entity: Column) -> Column:
    out = F.lit("name")
    for kind in ("phone", "card", "ip", "email"):
        out = F.when(entity.rlike(f"^(?:{PATTERNS[kind]})$"), F.lit(kind)).otherwise(out)
    return out


def entities(text: Column) -> Column:
    """All entities of a text in order, as found; an empty array for null."""
    return F.when(text.rlike(_MAYBE), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _parts(entity: Column, kind: Column) -> Column:
    """Array of (kind, normal) that the replacement of an entity is built from."""
    part = lambda k, n: F.struct(k.alias("kind") if isinstance(k, Column) else F.lit(k).alias("kind"), n.alias("normal"))
    title = F.regexp_extract(entity, r"^(\p{L}+)", 1)
    words = F.split(F.regexp_replace(entity, r"^\p{L}+\.? ", ""), " ")
    gender = F.when(title.isin(*FEMALE_TITLES), "f").when(title.isin(*MALE_TITLES), "m").otherwise("n")
    script = F.when(entity.rlike(r"\p{IsCyrillic}"), "cyrillic").when(entity.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    family = part(F.concat(F.lit("family-"), script), F.lower(F.element_at(words, -1)))
    given = part(F.concat(F.lit("given-"), gender, F.lit("-"), script), F.lower(F.element_at(words, 1)))
    names = F.when(F.size(words) > 1, F.array(given, family)).otherwise(F.array(family))
    number = F.array(part(kind, F.when(kind.isin("phone", "card"), _digits(entity)).otherwise(F.lower(entity))))
    return F.when(kind == "name", names).otherwise(number)


def _stream(kind: Column, normal: Column, key: str, attempt: Column) -> Column:
    """128 keyed decimal digits or so, as text of hex characters."""
    return F.concat(*[F.sha2(F.concat_ws("\u0001", F.lit(key), F.lit(str(i)), kind, normal, attempt.cast("string")), 256) for i in range(2)])


def _number(stream: Column, at: Column, below: Column) -> Column:
    """The number of 3 hex characters at ``at`` modulo ``below``."""
    return F.conv(F.substring(stream, F.lit(1) + at * 3, F.lit(3)), 16, 10).cast("int") % below


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))


def draw(kind: Column, normal: Column, key: str, attempt: Column) -> Column:
    """The replacement of a normal form: again a normal form of the same kind. Names grow by a syllable every second
    attempt, mail addresses and phone numbers by a letter or digit every fourth."""
    s = _stream(kind, normal, key, attempt)
    n = F.greatest(F.length(normal), F.lit(1))
    spot = F.sequence(F.lit(1), n)
    letter = lambda i, c: F.when(
        c.rlike("[0-9]"), _number(s, i % 40, F.lit(10)).cast("string")
    ).when(c.rlike("[a-z]"), F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), _number(s, i % 40, F.lit(26)) + 1, F.lit(1))).otherwise(c)
    make = F.array_join(F.transform(spot, lambda i: letter(i, F.substring(normal, i, F.lit(1)))), "")
    suffix = F.regexp_extract(normal, r"(\.[a-z0-9-]+)$", 1)
    more = (attempt / 4).cast("int")
    letters = F.transform(F.sequence(F.lit(0), more), lambda i: F.when(i > 0, F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), _number(s, (i + 20) % 40, F.lit(26)) + 1, F.lit(1))).otherwise(""))
    email = F.concat(F.regexp_extract(make, r"^(.*)@", 1), F.array_join(letters, ""), F.lit("@"), F.regexp_extract(make, r"@([^.]*)", 1), F.lit(".example"), F.when(suffix == "", ".com").otherwise(suffix))
    octet = lambda i: (_number(s, F.lit(i), F.lit(223)) + 1).cast("string")
    ip = F.concat_ws(".", *[octet(i) for i in range(4)])
    plain = F.array_join(F.transform(F.sequence(F.lit(1), n + more), lambda i: _number(s, i % 40, F.lit(10)).cast("string")), "")
    phone = F.concat(F.substring(normal, 1, 1), F.when(n + more > 1, F.concat((_number(s, F.lit(0), F.lit(8)) + 2).cast("string"), F.substring(plain, F.lit(3), n + more))).otherwise(F.lit("")))
    body = F.concat(F.substring(normal, 1, 1), F.substring(plain, F.lit(2), n - 2))
    check = F.concat(body, ((F.lit(10) - _luhn(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))
    card = F.when(_luhn(normal) % 10 == 0, check).otherwise(F.concat(body, ((F.lit(11) - _luhn(F.concat(body, F.lit("0"))) % 10) % 10).cast("string")))
    out = F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "phone", phone).when(kind == "card", card)
    for script, (syllables, female, male) in SYLLABLES.items():
        pick = lambda i: F.element_at(F.array(*[F.lit(x) for x in syllables]), _number(s, i, F.lit(len(syllables))) + 1)
        rest = F.transform(F.sequence(F.lit(3), F.lit(4) + ((attempt - 1) / 2).cast("int")), lambda i: pick(i % 40))
        longer = F.when(attempt > 0, F.array_join(rest, "")).otherwise(F.lit(""))  # room for what collided
        given = F.concat(pick(F.lit(0)), pick(F.lit(1)), longer)
        stem = F.concat(pick(F.lit(0)), pick(F.lit(1)), pick(F.lit(2)), longer)
        out = out.when(kind == f"family-{script}", F.concat(stem, F.lit(male)))
        for gender, end in (("f", female), ("m", male), ("n", "")):
            out = out.when(kind == f"given-{gender}-{script}", F.concat(given, F.lit(end)))
    return out


def surrogate_table(parts: DataFrame, key: str) -> DataFrame:
    """(kind, normal, surrogate) of distinct (kind, normal): within a kind no surrogate occurs twice or is itself an entity."""
    scratch = Scratch(parts.sparkSession, "surrogates")
    real = scratch.save(parts.select("kind", "normal").distinct(), "real")
    now = real.withColumn("attempt", F.lit(0))
    taken, n, step = None, 1, 0
    while n:
        drawn = now.withColumn("surrogate", draw(F.col("kind"), F.col("normal"), key, F.col("attempt")))
        claims = drawn.select("kind", "surrogate", "normal", "attempt", F.lit(1).alias("order"))
        claims = claims if taken is None else claims.union(taken.select("kind", "surrogate", "normal", "attempt", F.lit(0)))
        claims = claims.union(real.select("kind", F.col("normal").alias("surrogate"), F.lit(None).cast("string"), F.lit(0), F.lit(-1)))
        first = claims.groupBy("kind", "surrogate").agg(F.min(F.struct("order", "normal")).alias("first"))
        judged = drawn.join(first, ["kind", "surrogate"]).withColumn("wins", F.col("first.normal").eqNullSafe(F.col("normal")) & (F.col("first.order") == 1))
        judged, n = scratch.save_counted(judged.select("kind", "normal", "attempt", "surrogate", "wins"), f"round{step}", ~F.col("wins"))
        won = judged.where("wins").drop("wins")
        taken = won if taken is None else taken.union(won)
        now = judged.where("not wins").select("kind", "normal", (F.col("attempt") + 1).alias("attempt"))
        step += 1
        if n and step >= ROUNDS:
            raise RuntimeError(f"{n} entities found no free surrogate in {step} draws (kinds {sorted(r.kind for r in now.select('kind').distinct().collect())})")
    return taken.select("kind", "normal", "surrogate")


def _dressed(entity: Column, kind: Column, parts: Column) -> Column:
    """The surrogate in the clothes of the entity: its separators, its case, its title."""
    one = F.element_at(parts, 1)
    spelled = F.aggregate(
        F.split(entity, ""),
        F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda acc, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(acc.out, F.substring(one, acc.at, F.lit(1))).alias("out"), (acc.at + 1).alias("at"))).otherwise(F.struct(F.concat(acc.out, c).alias("out"), acc.at.alias("at"))),
        lambda acc: F.concat(acc.out, F.substring(one, acc.at, F.length(one))),  # digits that it has grown by
    )
    title = F.regexp_extract(entity, r"^(\p{L}+\.? )", 1)
    name = F.concat(title, F.array_join(F.transform(parts, lambda p: F.initcap(p)), " "))
    upper = F.when(entity == F.upper(entity), F.upper(one)).otherwise(one)
    return F.when(kind == "name", name).when(kind.isin("phone", "card"), spelled).otherwise(upper)


def replace_private(docs: DataFrame, key: str) -> DataFrame:
    """Per input row: doc_id, text with surrogates for all entities, and n_email, n_ip, n_card, n_phone, n_name.

    Null texts stay null and empty ones empty; a text without entities is unchanged. Repeated rows give equal rows; a
    null doc_id is kept. Columns other than doc_id and text are not read. Only texts with entities are shuffled.
    """
    base = docs.select("doc_id", "text").withColumn("found", entities(F.col("text")))
    rows = Scratch(docs.sparkSession, "private").save(base.where(F.size("found") > 0).withColumn("row_key", F.xxhash64("doc_id", "text")).dropDuplicates(["row_key"]).select("row_key", "found"), "found")
    each = rows.select("row_key", F.posexplode("found").alias("at", "entity")).withColumn("kind", _kind(F.col("entity")))
    parts = each.select("row_key", "at", F.posexplode(_parts(F.col("entity"), F.col("kind"))).alias("part", "p")).select("row_key", "at", "part", "p.kind", "p.normal")
    named = parts.join(surrogate_table(parts, key), ["kind", "normal"])
    whole = named.groupBy("row_key").agg(F.array_sort(F.collect_list(F.struct("at", "part", "surrogate"))).alias("drawn"))  # one document's own
    some = base.where(F.size("found") > 0).withColumn("row_key", F.xxhash64("doc_id", "text")).join(whole, "row_key")
    # The entities are few per text; each takes its own parts from the sorted list.
    own = lambda i: F.transform(F.filter("drawn", lambda d: d["at"] == i), lambda d: d["surrogate"])
    fill = F.transform("found", lambda e, i: _dressed(e, _kind(e), own(i)))
    between = F.split("text", ANY, -1)
    done = F.concat_ws("", F.transform(F.arrays_zip(between.alias("b"), fill.alias("f")), lambda z: F.concat(z["b"], F.coalesce(z["f"], F.lit("")))))
    kinds = F.transform("found", lambda e: _kind(e))
    count = {f"n_{k}": (F.size("found") - F.size(F.array_remove(kinds, k))).cast("long") for k in PATTERNS}
    out = ["doc_id", "text", *count]
    changed = some.withColumns(count).withColumn("text", done).select(*out)
    same = base.where(F.size("found") <= 0).withColumns({k: F.lit(0).cast("long") for k in count}).select(*out)
    return changed.union(same)
