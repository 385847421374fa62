"""Replacing personal data by keyed surrogates, with built-in functions only.

Detected entities (e-mail, phone, card, bank account and social security numbers, IP addresses,
secrets, titled names and later mentions of such names in the same document) get a surrogate of the same type that a keyed hash of their normal form
picks: same length and format, same script, names of the same gender, cards with the same
check-sum verdict. Equal entities get equal surrogates everywhere (coreference). All
surrogates of a type are compared with each other and with all real values; where two meet, all but the first
draw again, until different entities have different surrogates. A format that leaves too few values is lengthened: from the fifth
draw on surrogates get two more letters or digits (e-mail: in the local part, IP addresses: one more number, others: at the end) with every draw.

Calling codes, the class of an IP address (private, loopback, link-local, multicast, public) and whether the check digits of a card or a
bank account number are right stay as they are.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

# Titles that tell a name and its gender.
TITLES_M = "Mr|Herr|Monsieur|Señor|Sr|Sir|господин"
TITLES_F = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|госпожа"

#: A domain has at most 127 parts. No pattern repeats a group without a bound or backtracks into one: Java would recurse.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]++\.){1,126}[\p{L}]{2,}+"
SECRET_WORD = r"(?i:token|secret|key|password|passwd|pwd)[\x22']?[ ]{0,2}"
SECRET = rf"(?<={SECRET_WORD}[=:][ ]{{0,2}}[\x22']?)[A-Za-z0-9_+/=-]{{12,}}+|(?<![A-Za-z0-9])[0-9a-f]{{32,}}+(?![A-Za-z0-9])"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
IP = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
#: A word of a name: an apostrophe only inside, and not that of a possessive.
NAME_WORD = r"\p{Lu}(?:[\p{L}-]|'(?=\p{L})(?!s(?!\p{L})))++"
NAME = rf"(?<![\p{{L}}\p{{N}}])(?:{TITLES_F}|{TITLES_M})\.? {NAME_WORD}(?: {NAME_WORD})?"
ENTITY = "|".join(f"(?:{p})" for p in (EMAIL, SECRET, IBAN, IP, SSN, PHONE, CARD, NAME))
#: A text that has no digit or @, and neither titles nor secret words in their places, has no entity.
HINT = rf"[0-9@]|(?:{TITLES_F}|{TITLES_M})\.? \p{{Lu}}"
SECRET_HINT = rf"(?<={SECRET_WORD})[=:]"
#: Key of the hash. Whoever has it can recompute surrogates: pass your own.
KEY = "rollmill"

# Calling codes of one and two digits (all others have three).
CALLING_CODE = r"^\\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"

# Letters to draw from by script, and syllables of made-up names.
LATIN = "abcdefghijklmnopqrstuvwxyz"
CYRILLIC = "абвгдежзиклмнопрстуфхцчшэюя"
GREEK = "αβγδεζηθικλμνξοπρστυφχψω"
HAN = "安白成大方高和江林明平青山水天文小新元正"
SYLLABLES = ["ba", "de", "fi", "go", "hu", "ka", "le", "mi", "no", "pu", "ra", "se", "ti", "vo", "wa", "ze"]
SYLLABLES_CYRILLIC = ["ба", "де", "фи", "го", "ху", "ка", "ле", "ми", "но", "пу", "ра", "се", "ти", "во", "ва", "зе"]


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _people(found: Column) -> Column:
    """The different titled names among a document's values, as ``(gender, full)``; full is the name without title."""
    titled = F.filter(found, lambda v: v.rlike(f"^(?:{NAME})$"))
    return F.array_distinct(F.transform(titled, lambda v: F.struct(F.when(v.rlike(f"^(?:{TITLES_F})\\.? "), "f").otherwise("m").alias("gender"), _untitled(v).alias("full"))))


def _untitled(value: Column) -> Column:
    return F.regexp_replace(value, rf"^(?:{TITLES_F}|{TITLES_M})\.? ", "")


def _person(value: Column, people: Column) -> Column:
    """Whom of a document's people a value names, with the name in full if the document has it; null if none."""
    name, titled = F.lower(_untitled(value)), value.rlike(f"^(?:{NAME})$")
    female = value.rlike(f"^(?:{TITLES_F})\\.? ")
    same = lambda p: (~titled | (female == (p["gender"] == "f"))) & ((F.lower(p["full"]) == name) | F.lower(p["full"]).endswith(F.concat(F.lit(" "), name)))
    meant = F.filter(people, same)
    return F.get(F.concat(F.filter(meant, lambda p: p["full"].contains(" ")), meant), 0)


def _with_names(people: Column) -> Column:
    """The pattern of a document's entities: the common one and the full and last names of its people."""
    names = F.array_distinct(F.concat(F.transform(people, lambda p: p["full"]), F.transform(people, lambda p: F.substring_index(p["full"], " ", -1))))
    longest = F.reverse(F.array_sort(F.transform(names, lambda n: F.struct(F.length(n).alias("n"), n.alias("name")))))
    return F.concat(F.lit(ENTITY + r"|(?<![\p{L}\p{N}])(?:"), F.array_join(F.transform(longest, lambda x: x["name"]), "|"), F.lit(r")(?![\p{L}\p{N}])"))


def typed(values: DataFrame) -> DataFrame:
    """Adds ``type`` and ``norm`` to rows with an entity's ``value`` and ``person``: what is the same entity has the same norm."""
    full = lambda p: F.col("value").rlike(f"^(?:{p})$")
    kind = (
        F.when(F.col("value").contains("@"), "email").when(full(IP), "ip").when(full(SSN), "ssn")
        .when(F.col("person").isNotNull(), F.concat(F.lit("name_"), F.col("person.gender")))
        .when(full(r"[0-9](?:[ -]?[0-9]){12,18}"), "card").when(full(r"[+(]?[0-9][0-9 .()+-]*"), "phone")
        .when(full(IBAN), "iban").otherwise("secret")
    )
    values = values.withColumn("type", kind)
    bare = F.regexp_replace("value", r"[^A-Za-z0-9]", "")
    norm = (
        F.when(F.col("type").isin("card", "ssn", "iban"), bare)
        .when(F.col("type") == "phone", F.concat(F.when(F.col("value").startswith("+"), "+").otherwise(""), bare))
        .when(F.col("type").isin("name_m", "name_f"), F.lower("person.full"))
        .when(F.col("type") == "email", F.lower("value")).otherwise(F.col("value"))
    )
    return values.withColumn("norm", norm)


#: Number i (0 .. 65535) of an entity's stream: 32 of them in each SHA-512 of key, type, norm, draw and block.
_DRAW = "cast(conv(substr(element_at(stream, cast(i div 32 as int) + 1), cast(i % 32 as int) * 4 + 1, 4), 16, 10) as int)"


def _letter(alphabet: str) -> str:
    return f"substr({_sql(alphabet)}, 1 + {_DRAW} % {len(alphabet)}, 1)"


def _surrogate() -> str:
    """SQL for the surrogate of ``norm``; needs ``type, stream, draw``."""
    lower = rf"CASE WHEN c rlike '[0-9]' THEN cast(CASE WHEN i = 0 AND c <> '0' THEN 1 + {_DRAW} % 9 ELSE {_DRAW} % 10 END as string) WHEN lower(c) rlike '[a-z]|\\p{{IsLatin}}' THEN {_letter(LATIN)} WHEN c rlike '\\p{{IsCyrillic}}' THEN {_letter(CYRILLIC)} WHEN c rlike '\\p{{IsGreek}}' THEN {_letter(GREEK)} WHEN c rlike '\\p{{L}}' THEN {_letter(HAN)} ELSE c END"
    cased = f"CASE WHEN c <> lower(c) THEN upper({lower}) ELSE {lower} END"
    each = lambda text, body: f"array_join(transform(split({text}, ''), (c, i) -> {body}), '')"
    # a secret of hexadecimal digits stays one
    hexed = f"CASE WHEN c rlike '[0-9a-f]' THEN substr('0123456789abcdef', 1 + {_DRAW} % 16, 1) ELSE c END"
    # two more letters or digits with every draw from the fifth on
    more = "CASE WHEN draw < 4 THEN array() ELSE sequence(64, 61 + 2 * least(draw - 2, 13)) END"
    letters, digits = (f"array_join(transform({more}, i -> {x}), '')" for x in (_letter(LATIN), f"cast({_DRAW} % 10 as string)"))
    end = "length(norm) - instr(reverse(norm), '.')"
    email = f"concat(replace({each(f'left(norm, {end})', cased)}, '@', concat({letters}, '@')), substr(norm, {end} + 1))"
    octet = lambda n: f"cast(substring_index(substring_index(norm, '.', {n}), '.', -1) as int)"
    # the numbers of an address that its class fixes; a public one starts with 11 to 126, a private one that leaves too little with 10
    fixed = f"CASE WHEN {octet(1)} = 192 AND {octet(2)} = 168 THEN 2 WHEN {octet(1)} = 172 AND {octet(2)} BETWEEN 16 AND 31 THEN 2 WHEN {octet(1)} = 169 AND {octet(2)} = 254 THEN 2 WHEN {octet(1)} IN (0, 10, 127) OR {octet(1)} >= 224 THEN 1 ELSE 0 END"
    ip = f"array_join(concat(transform(sequence(1, 4), i -> CASE WHEN i <= {fixed} THEN substring_index(substring_index(norm, '.', i), '.', -1) WHEN i = 1 THEN cast(11 + {_DRAW} % 116 as string) ELSE cast(1 + {_DRAW} % 254 as string) END), transform({more}, i -> cast(1 + {_DRAW} % 254 as string))), '.')"
    luhn = lambda text, shift: f"aggregate(sequence(1, length({text})), 0, (s, p) -> s + CASE WHEN (length({text}) - p + {shift}) % 2 = 1 THEN cast(substr({text}, p, 1) as int) * 2 - CASE WHEN cast(substr({text}, p, 1) as int) > 4 THEN 9 ELSE 0 END ELSE cast(substr({text}, p, 1) as int) END)"
    body = f"concat({each('left(norm, length(norm) - 1)', cased)}, {digits})"
    card = f"element_at(transform(array({body}), b -> concat(b, cast(pmod({luhn('norm', 0)} - {luhn('b', 1)}, 10) as string))), 1)"
    # right check digits of an account number, and how far the given ones are from these
    rest = lambda text: f"aggregate(split(concat({text}, left(norm, 2), '00'), ''), 0, (s, c) -> CASE WHEN c rlike '[0-9]' THEN (s * 10 + cast(c as int)) % 97 ELSE (s * 100 + ascii(c) - 55) % 97 END)"
    off = f"cast(substr(norm, 3, 2) as int) + {rest('substr(norm, 5)')}"
    account = f"concat(substr({each('norm', cased)}, 5), {digits})"
    iban = f"element_at(transform(array({account}), b -> concat(left(norm, 2), lpad(cast(pmod({off} - {rest('b')} - 2, 97) + 2 as string), 2, '0'), b)), 1)"
    code = f"regexp_extract(norm, '{CALLING_CODE}', 0)"
    phone = f"concat({code}, {each(f'substr(norm, length({code}) + 1)', cased)}, {digits})"

    def name(ending: str, ending_cyrillic: str) -> str:
        made = lambda syllables, last: f"initcap(concat(array_join(transform(sequence(0, 2 + draw), j -> element_at(array({', '.join(map(_sql, syllables))}), 1 + element_at(transform(array(w * 16 + j), i -> {_DRAW}), 1) % 16)), ''), {_sql(last)}))"
        return rf"array_join(transform(split(norm, ' '), (x, w) -> CASE WHEN x rlike '\\p{{IsCyrillic}}' THEN {made(SYLLABLES_CYRILLIC, ending_cyrillic)} ELSE {made(SYLLABLES, ending)} END), ' ')"

    return f"""CASE type WHEN 'email' THEN {email} WHEN 'ip' THEN {ip} WHEN 'card' THEN {card} WHEN 'iban' THEN {iban} WHEN 'phone' THEN {phone}
        WHEN 'name_m' THEN {name('n', 'н')} WHEN 'name_f' THEN {name('la', 'ла')}
        WHEN 'secret' THEN CASE WHEN norm rlike '^[0-9a-f]+$' THEN concat({each('norm', hexed)}, {digits}) ELSE concat({each('norm', cased)}, {letters}) END
        ELSE concat({each('norm', cased)}, {digits}) END"""


def _drawn(entities: DataFrame, key: str) -> DataFrame:
    """``entities (type, norm, draw)`` with their ``surrogate`` of that draw."""
    blocks = "sequence(0, greatest(2, cast(length(norm) div 32 as int)))"
    stream = F.expr(f"transform({blocks}, b -> sha2(concat_ws('|', {_sql(key)}, type, norm, cast(draw as string), cast(b as string)), 512))")
    return entities.withColumn("stream", stream).withColumn("surrogate", F.expr(_surrogate())).drop("stream")


def surrogates(entities: DataFrame, key: str = KEY, max_draws: int = 40) -> DataFrame:
    """``(type, norm, surrogate)`` for rows ``(type, norm)`` that all differ.

    Of several entities of a type with one surrogate the least norm keeps it; the others, and any whose
    surrogate is a real value, draw again. Different entities end with different surrogates: formats grow with the draws.
    """
    settled, open_ = None, entities.select("type", "norm").withColumn("draw", F.lit(0))
    real = entities.select("type", F.lower("norm").alias("taken"))
    for draw in range(max_draws):
        drawn = materialize(_drawn(open_, key).withColumn("folded", F.lower("surrogate")), "drawn")
        least = drawn.groupBy("type", "folded").agg(F.min("norm").alias("norm"))
        taken = real if settled is None else real.unionByName(settled.select("type", F.lower("surrogate").alias("taken")))
        good = drawn.join(least, ["type", "folded", "norm"], "left_semi").join(taken.withColumnRenamed("taken", "folded"), ["type", "folded"], "left_anti")
        good = materialize(good.select("type", "norm", "surrogate"), "settled")
        settled = good if settled is None else settled.unionByName(good)
        rest = drawn.join(good, ["type", "norm"], "left_anti").select("type", "norm", F.lit(draw + 1).alias("draw"))
        open_ = materialize(rest, "open")
        if open_.isEmpty():
            return settled
    raise RuntimeError(f"surrogates still collide after {max_draws} draws")


def _rendered() -> str:
    """SQL for the surrogate in a value's own format."""
    own = "replace(surrogate, '+', '')"
    filled = f"aggregate(split(value, ''), struct('' as s, 0 as k), (z, c) -> CASE WHEN c rlike '[A-Za-z0-9]' THEN struct(concat(z.s, substr({own}, z.k + 1, 1)) as s, z.k + 1 as k) ELSE struct(concat(z.s, c) as s, z.k as k) END, z -> concat(z.s, substr({own}, z.k + 1)))"
    same_case = "array_join(transform(split(surrogate, ''), (c, i) -> CASE WHEN substr(value, i + 1, 1) <> lower(substr(value, i + 1, 1)) THEN upper(c) ELSE c END), '')"
    title = f"regexp_extract(value, {_sql(f'^(?:{TITLES_F}|{TITLES_M})')} || {_sql(chr(92) + '.? ')}, 0)"
    return rf"CASE WHEN type IN ('phone', 'card', 'ssn', 'iban') THEN {filled} WHEN type = 'email' AND value <> norm THEN {same_case} WHEN type LIKE 'name%' THEN concat({title}, CASE WHEN instr(substr(value, length({title}) + 1), ' ') = 0 THEN substring_index(surrogate, ' ', -1) ELSE surrogate END) ELSE surrogate END"


def replace_pii(docs: DataFrame, text_col: str = "text", key: str = KEY) -> DataFrame:
    """The rows of ``docs`` as ``__row`` with ``safe_text`` and ``n_entities``.

    Null and empty texts stay as they are, repeated rows are treated alike, texts may be of any length. Only texts with entities are
    written and joined; the others pass where they lie. Entities are told apart by type and normal form in the whole input. Of two entities
    of a type that draw the same surrogate the one with the smaller normal form keeps it.
    """
    rows = docs.select(F.struct("*").alias("__row"), F.col(text_col).alias("__text"))
    # plain searches first: they cost a fraction of a pattern with many branches
    named = reduce(or_, [F.col("__text").contains(w) for w in (*TITLES_F.split("|"), *TITLES_M.split("|"))])
    assigned = (F.col("__text").contains("=") | F.col("__text").contains(":")) & F.col("__text").rlike(SECRET_HINT)
    hint = F.col("__text").rlike("[0-9@]") | assigned | (named & F.col("__text").rlike(HINT))
    found = F.when(hint, F.regexp_extract_all("__text", F.lit(ENTITY), F.lit(0)))
    # a column that depends on the task keeps the filters above this step, so that it runs once a row
    rows = rows.withColumn("__found", F.coalesce(found, F.array().cast("array<string>"))).withColumn("__task", F.spark_partition_id())
    has = materialize(rows.where("size(__found) > 0 AND __task >= 0").withColumn("__key", F.monotonically_increasing_id()), "with-entities")
    # later mentions of a document's people count as entities too; few documents have any
    people = _people(F.col("__found"))
    has = has.withColumn("__people", people).withColumn("__pattern", F.when(F.size("__people") > 0, _with_names(F.col("__people"))).otherwise(F.lit(ENTITY)))
    has = has.withColumn("__found", F.when(F.size("__people") > 0, F.regexp_extract_all("__text", F.col("__pattern"), F.lit(0))).otherwise(F.col("__found")))
    mentions = F.transform(F.array_distinct("__found"), lambda v: F.struct(v.alias("value"), F.when(F.size("__people") > 0, _person(v, F.col("__people"))).alias("person")))
    mentions = has.select("__key", F.inline(mentions))
    values = materialize(typed(mentions.select("value", "person").distinct()), "values")
    chosen = surrogates(values.select("type", "norm").distinct(), key)
    # a hot value is joined from a small table: broadcast below the session's threshold, split by AQE beyond it
    shown = materialize(values.join(chosen, ["type", "norm"]).select("value", "person", F.expr(_rendered()).alias("safe")).withColumnsRenamed({"value": "__value", "person": "__person"}), "shown")
    pairs = mentions.join(shown, (F.col("value") == F.col("__value")) & F.col("person").eqNullSafe(F.col("__person"))).select("__key", "value", "safe")
    maps = pairs.groupBy("__key").agg(F.map_from_entries(F.collect_list(F.struct("value", "safe"))).alias("__map"))
    out = has.join(maps, "__key")
    parts = F.split("__text", F.col("__pattern"), -1)
    safe = F.array_join(F.zip_with(parts, F.transform("__found", lambda v: F.col("__map")[v]), lambda p, v: F.concat(p, F.coalesce(v, F.lit("")))), "")
    out = out.select("__row", safe.alias("safe_text"), F.size("__found").cast("long").alias("n_entities"))
    rest = rows.where("size(__found) = 0 AND __task >= 0").select("__row", F.col("__text").alias("safe_text"), F.lit(0).cast("long").alias("n_entities"))
    return out.unionByName(rest)
