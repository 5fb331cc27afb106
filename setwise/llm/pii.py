"""PII: surrogates for personal data and secrets, in DataFrame functions only.

One pattern finds e-mail addresses, phone numbers, payment cards, social security numbers, IPv4 and IPv6 addresses, bank
accounts, access keys, passwords and tokens, and persons after a title (names without one are not found). Each entity
gets a replacement made by a stream of HMAC-SHA-512, under the caller's key, of its kind and form: digits stay digits,
capitals capitals, separators stay; cards keep a right check digit, addresses right octets, names their script and the
gender of the title, if it has one. The same entity gets the same surrogate everywhere (coreference), in whatever document.

Collision checks: the distinct entities (combined before the shuffle, so a frequent one is no hot key) are compared
by surrogate, names word by word; those that share one, or whose surrogate is itself an entity of the table, take their
next stream until none is left. Entities with other than the first stream, usually none, reach their documents as a map
joined by doc_id, or by text without one.

Null texts stay null; empty ones and texts without an entity stay as they are, byte for byte. Repeated rows are treated
alike. Other columns of the input are kept whatever their names; one named like the count is replaced by it. 16-digit
numbers that fail the card checksum are no entities. Overlapping matches: the first one in the text, and of several at
one place the first kind in KINDS.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setwise.llm import common

#: The setting with the key of the registered queries, and their key where it is unset, which is no secret.
KEY_SETTING, KEY = "spark.setwise.pii.key", "surrogates-1"
_B, _E = r"(?<![0-9A-Za-z])", r"(?![0-9A-Za-z])"
#: Titles, by the gender that they tell.
WOMAN = r"Mrs\.?|Ms\.?|Miss|Madam|Frau|Señora|Madame|Г-жа|г-жа|Госпожа|госпожа|Κυρία|κυρία"
MAN = r"Mr\.?|Herr|Señor|Monsieur|Г-н|г-н|Господин|господин|Κύριος|κύριος"
ANYONE = r"Dr\.?|Prof\.?|Д-р|д-р|Δρ\.?"
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "secret": r"""(?<=(?i:password|passwd|secret|token|api_key)(?:=|="|: | = "|: "))[0-9A-Za-z_/+.-]{8,}""",
    "key": _B + r"AKIA[0-9A-Z]{16}" + _E,
    "iban": _B + r"[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?" + _E,
    "card": _B + r"[3-6][0-9]{3}(?:[ -]?[0-9]{4}){3}" + _E,
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9A-Za-z])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-]?[0-9]{2,4}){2,3}(?![0-9])|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9A-Za-z.-])[2-9][0-9]{2}(?:-[2-9][0-9]{2}-|\.[2-9][0-9]{2}\.)[0-9]{4}(?![0-9A-Za-z]|[.-][0-9])",
    "ip6": r"(?<![0-9A-Za-z:.])(?=[A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "ip": r"(?<![0-9A-Za-z.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9A-Za-z]|\.[0-9])",
    "woman": rf"(?=\p{{Lu}})(?<=(?<!\p{{L}})(?:{WOMAN}) )\p{{Lu}}\p{{L}}+(?: \p{{Lu}}\p{{L}}+)?",
    "man": rf"(?=\p{{Lu}})(?<=(?<!\p{{L}})(?:{MAN}) )\p{{Lu}}\p{{L}}+(?: \p{{Lu}}\p{{L}}+)?",
    "person": rf"(?=\p{{Lu}})(?<=(?<!\p{{L}})(?:{ANYONE}) )\p{{Lu}}\p{{L}}+(?: \p{{Lu}}\p{{L}}+)?",
}
PATTERN = "|".join(f"(?:{x})" for x in KINDS.values())
#: What every entity has: texts without it are passed on at once.
HINT = r"[0-9@]|AKIA|(?i:password|passwd|secret|token|api_key)|Mr|Ms|Miss|Madam|Frau|Herr|Señor|Monsieur|[Гг]-|[Гг]оспо|[Κκ]ύρι|[Κκ]υρία|Dr|Prof|[Дд]-р|Δρ"
#: Rounds of the collision check, each of which leaves a vanishing part of what was; collisions beyond them are an error.
ROUNDS = 64
#: Kinds that are told by the title in front.
PERSONS = {"woman": WOMAN, "man": MAN, "person": ANYONE}
_SYLLABLES = {"latin": ["al", "be", "cor", "da", "el", "fi", "gan", "ho", "is", "ju", "ka", "lor", "mi", "na", "os", "ru"], "cyrillic": ["ал", "бе", "вор", "да", "ел", "фи", "ган", "го", "ис", "ка", "лор", "ми", "на", "ос", "ру", "те"], "greek": ["αλ", "βε", "γορ", "δα", "ελ", "φι", "καν", "λο", "ις", "μα", "νορ", "πι", "ρα", "ος", "τυ", "σε"]}


def _lit(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _kind(e: str, before: str) -> str:
    """SQL for the kind of an entity that the pattern found after a text: by its format, else by what stands before it."""
    order = ("email", "key", "card", "ssn", "ip", "ip6", "iban", "phone")
    return "CASE " + " ".join(f"WHEN {e} RLIKE {_lit('^(?:' + KINDS[k].replace(_B, '').replace(_E, '') + ')$')} THEN '{k}'" for k in order) + "".join(f" WHEN {before} RLIKE {_lit(rf'(?<!\p{{L}})(?:{x}) $')} THEN '{k}'" for k, x in PERSONS.items()) + " ELSE 'secret' END"


def _luhn(d: str) -> str:
    """SQL for the weighted sum of a string of digits, the last one of weight one."""
    digit = f"cast(substr({d}, length({d}) - i, 1) AS int)"
    return f"aggregate(sequence(0, length({d}) - 1), 0, (s, i) -> s + CASE WHEN i % 2 = 0 THEN {digit} ELSE 2 * {digit} - 9 * int(2 * {digit} > 9) END)"


def _let(value: str, name: str, body: str) -> str:
    """SQL for body with name bound to value, worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _byte(i: str) -> str:
    return f"cast(conv(substr(st, 1 + 2 * (({i}) % 128), 2), 16, 10) AS int)"


def _masked(e: str, hexed: bool = False) -> str:
    """SQL for e with digits, capitals and small letters exchanged for others of the same sort."""
    c = f"substr({e}, i, 1)"
    n = 6 if hexed else 26
    return f"array_join(transform(sequence(1, length({e})), i -> CASE WHEN {c} RLIKE '[0-9]' THEN cast({_byte('i')} % 10 AS string) WHEN {c} RLIKE '[A-Z]' THEN char(65 + {_byte('i')} % {n}) WHEN {c} RLIKE '[a-z]' THEN char(97 + {_byte('i')} % {n}) ELSE {c} END), '')"


def _forms(w: str) -> str:
    """SQL for a made-up name in the script of w: as a woman's given name, a man's, and a surname.

    No ending is the end of another, so two words share a form only if they share all.
    """
    make = {}
    for script, syllables in _SYLLABLES.items():
        a = "array(" + ", ".join(map(_lit, syllables)) + ")"
        ends = {"latin": ("a", "o", "en"), "cyrillic": ("а", "ий", "ин"), "greek": ("α", "ος", "ης")}[script]
        stem = f"array_join(transform(sequence(1, 6), i -> {a}[{_byte('i')} % 16]), '')"
        make[script] = f"transform(array({', '.join(map(_lit, ends))}), x -> initcap(concat({stem}, x)))"
    return rf"CASE WHEN {w} RLIKE '\\p{{IsCyrillic}}' THEN {make['cyrillic']} WHEN {w} RLIKE '\\p{{IsGreek}}' THEN {make['greek']} ELSE {make['latin']} END"


def _stream(of: str, attempt: str, key: str) -> str:
    """SQL for 128 bytes in hex: two HMAC-SHA-512 of a text and the stream's number."""
    block = (hashlib.sha512(key.encode()).digest() if len(key.encode()) > 128 else key.encode()).ljust(128, b"\0")
    inner, outer = (f"X'{bytes(b ^ pad for b in block).hex()}'" for pad in (0x36, 0x5C))
    return "concat(" + ", ".join(f"sha2(concat({outer}, unhex(sha2(concat({inner}, cast(concat_ws('|', {of}, {attempt}, {k}) AS binary)), 512))), 512)" for k in (0, 1)) + ")"


def _forms_of(w: str, attempt: str, key: str) -> str:
    """SQL for the forms of a name's word by its own stream, so that the surname alone gets what it gets in the whole name."""
    return _let(_stream(f"concat('name|', {w})", attempt, key), "st", _forms(w))


def _other(e: str, attempt: str, key: str) -> str:
    """SQL for the surrogate of an entity that is no person, its kind in `kind`."""
    digits = f"regexp_replace({e}, '[^0-9]', '')"
    card = _let(f"concat(substr({digits}, 1, 1), array_join(transform(sequence(2, 15), i -> cast({_byte('i')} % 10 AS string)), ''))", "d15", _let(f"concat(d15, cast((10 - {_luhn("concat(d15, '0')")} % 10) % 10 AS string))", "d16", f"array_join(transform(sequence(1, length({e})), i -> CASE WHEN substr({e}, i, 1) RLIKE '[0-9]' THEN substr(d16, length(regexp_replace(substr({e}, 1, i), '[^0-9]', '')), 1) ELSE substr({e}, i, 1) END), '')"))
    email = f"concat({_masked(f"split({e}, '@')[0]")}, '@mail', {', '.join(f'lower(char(97 + {_byte(str(100 + k))} % 26))' for k in range(6))}, '.example.com')"
    ip = f"concat_ws('.', 1 + {_byte('1')} % 223, {_byte('2')}, {_byte('3')}, {_byte('4')})"
    phone = rf"concat(regexp_extract({e}, '^(\\+[0-9]{{1,3}}(?=[ .(-])[ .-]?)?', 0), {_masked(rf"regexp_replace({e}, '^\\+[0-9]{{1,3}}(?=[ .(-])[ .-]?', '')")})"
    secret = f"CASE WHEN {e} RLIKE '^[0-9a-f]+$' THEN {_masked(e, True)} ELSE {_masked(e)} END"
    body = f"CASE kind WHEN 'email' THEN {email} WHEN 'key' THEN concat('AKIA', {_masked(f'substr({e}, 5)')}) WHEN 'iban' THEN concat(substr({e}, 1, 2), {_masked(f'substr({e}, 3)')}) WHEN 'card' THEN CASE WHEN {_luhn(digits)} % 10 = 0 THEN {card} ELSE {e} END WHEN 'ssn' THEN concat('9', {_masked(f'substr({e}, 2)')}) WHEN 'ip' THEN {ip} WHEN 'ip6' THEN {_masked(e, True)} WHEN 'phone' THEN {phone} ELSE {secret} END"
    return _let(_stream(f"concat(kind, '|', {e})", attempt, key), "st", body)


def _id(e: str, person: bool) -> str:
    """SQL for what tells entities apart: a name's word isn't the secret of the same text."""
    return f"concat('name|', {e})" if person else e


def surrogate_sql(e: str, before: str, attempt: Callable[[str], str], key: str) -> str:
    """SQL for the surrogate of entity e after a text; attempt gives the SQL for the stream's number of an id."""
    form = "CASE WHEN size(ws) = 1 OR k = 1 OR kind = 'person' THEN 2 WHEN kind = 'woman' THEN 0 ELSE 1 END"
    person = _let(f"split({e}, ' ')", "ws", f"array_join(transform(ws, (w, k) -> ({_forms_of('w', attempt(_id('w', True)), key)})[{form}]), ' ')")
    return _let(_kind(e, before), "kind", f"CASE WHEN kind IN ('woman', 'man', 'person') THEN {person} ELSE {_other(e, attempt(_id(e, False)), key)} END")


def _found(text: str) -> str:
    return f"CASE WHEN {text} RLIKE {_lit(HINT)} THEN regexp_extract_all({text}, {_lit(PATTERN)}, 0) END"


def _with_found(text: str, body: str) -> str:
    """SQL for body with the entities of text in fs and the parts of text around them in parts; null without any."""
    return _let(_found(text), "fs", f"CASE WHEN size(fs) > 0 THEN {_let(f'split({text}, {_lit(PATTERN)}, -1)', 'parts', body)} END")


#: What stands before entity n, with the entity before that: a title or a field's name may be part of it.
_BEFORE = "CASE WHEN n > 0 THEN concat(fs[n - 1], parts[n]) ELSE parts[n] END"


def _entities(text: str) -> str:
    """SQL for the entities of text with their kinds, persons word by word with kind 'name'."""
    one = _let(_kind("e", "before"), "kind", "CASE WHEN kind IN ('woman', 'man', 'person') THEN transform(split(e, ' '), w -> struct('name' AS kind, w AS entity)) ELSE array(struct(kind AS kind, e AS entity)) END")
    return _with_found(text, f"flatten(transform(fs, (e, n) -> {_let(_BEFORE, 'before', one)}))")


def entities(docs: DataFrame) -> DataFrame:
    """Distinct entities with their kinds, in columns kind and entity; persons word by word."""
    return docs.select(F.explode(F.expr(_entities("text"))).alias("x")).select("x.kind", "x.entity").distinct()


def later_streams(found: DataFrame, key: str) -> DataFrame | None:
    """id, attempt of those that collide at the first stream; None if none does. Raises if collisions remain."""
    found = common.materialize(found.withColumn("id", F.expr(f"CASE WHEN kind = 'name' THEN {_id('entity', True)} ELSE {_id('entity', False)} END")), "entities")
    state = found.withColumn("attempt", F.lit(0))
    forms = F.expr(f"CASE WHEN kind = 'name' THEN {_forms_of('entity', 'attempt', key)} ELSE array({_other('entity', 'attempt', key)}) END")
    for _ in range(ROUNDS):
        made = common.materialize(state.withColumn("forms", forms).withColumn("s", F.col("forms")[0]), "surrogates")
        free = (F.col("kind") == "name") | (F.col("s") != F.col("entity"))  # others stay as they are on purpose
        taken = made.filter(free).select("s", F.explode("forms").alias("form")).join(found.select(F.col("entity").alias("form")), "form", "left_semi").select("s").distinct().withColumn("own", F.lit(None).cast("string"))
        shared = made.groupBy("s").agg(F.count("*").alias("n"), F.min("id").alias("own")).filter("n > 1").select("s", "own")
        bad = shared.join(taken.select("s"), "s", "left_anti").unionAll(taken)
        if bad.isEmpty():
            break
        hit = made.join(bad, "s").filter("own is null or own <> id").filter(free).select("id", F.lit(1).alias("more"))
        state = made.select("kind", "entity", "id", "attempt").join(hit, "id", "left").select("kind", "entity", "id", (F.col("attempt") + F.coalesce("more", F.lit(0))).alias("attempt"))
    else:
        raise RuntimeError(f"surrogates still collide after {ROUNDS} rounds")
    later = made.filter("attempt > 0").select("id", "attempt")
    return None if later.isEmpty() else later


def _fresh(name: str, docs: DataFrame) -> str:
    """A column name that docs doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def surrogates(docs: DataFrame, key: str, count: str | None = "n_entities") -> DataFrame:
    """docs with text rewritten under a key, in its own columns, and the number of entities in a column `count`, if asked for."""
    with common.bounded_parser(docs.sparkSession):
        return _surrogates(docs, key, count)


def _surrogates(docs: DataFrame, key: str, count: str | None) -> DataFrame:
    later = later_streams(entities(docs), key)
    out, attempt = docs, lambda _: "0"
    row_id, streams, made = (_fresh(x, docs) for x in ("pii_row", "pii_streams", "pii_made"))
    if later is not None:
        # rows that share a number share a map, which holds what is right for both
        row = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
        of = "CASE WHEN x.kind = 'name' THEN " + _id("x.entity", True) + " ELSE " + _id("x.entity", False) + " END"
        pairs = docs.select(row.alias(row_id), F.explode(F.expr(_entities("text"))).alias("x")).select(row_id, F.expr(of).alias("id")).distinct().join(later, "id")
        maps = pairs.groupBy(row_id).agg(F.map_from_entries(F.collect_set(F.struct("id", "attempt"))).alias(streams))
        out, attempt = docs.withColumn(row_id, row).join(maps, row_id, "left"), lambda x: f"coalesce(try_element_at({streams}, {x}), 0)"
    one = _let(_BEFORE, "before", surrogate_sql("e", "before", attempt, key))
    text = f"array_join(flatten(zip_with(parts, transform(fs, (e, n) -> {one}), (p, s) -> array(p, coalesce(s, '')))), '')"
    card = _lit("^(?:" + KINDS["card"].replace(_B, "").replace(_E, "") + ")$")
    is_entity = f"e -> NOT (e RLIKE {card} AND {_luhn("regexp_replace(e, '[^0-9]', '')")} % 10 <> 0)"
    both = F.expr(_with_found("text", f"struct({text} AS new, cast(size(filter(fs, {is_entity})) AS bigint) AS n)"))
    out = out.withColumn(made, both)
    columns = [F.coalesce(F.col(made)["new"], F.col("text")).alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns if c != count]
    return out.select(*columns, *([F.coalesce(F.col(made)["n"], F.lit(0).cast("long")).alias(count)] if count else []))


def key_of(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, KEY)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text with surrogates, n_entities of every document."""
    return surrogates(common.table(spark, sf_dir, "documents").select("doc_id", "text"), key_of(spark))
