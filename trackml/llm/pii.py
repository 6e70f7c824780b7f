"""Surrogates for personal data, with DataFrame and SQL functions only.

Detection.  One pattern finds e-mail addresses (also of international domains),
IPv4 and IPv6 addresses, phone, card, account (IBAN) and social security
numbers, access keys, ``password=`` style secrets, and persons after a title.
It runs over each text once; what it found, and what lies between, is staged
with the rows.  A person's parts are entities of their own (given name with the
title's gender, surname), so "Ms. Ada King" and "Ms. King" share their surname's
surrogate.

Coreference.  A name that a title introduces is replaced wherever it stands as
a word of the same document.  A given name after a title without gender takes
the gender that other titles give the same given name and surname anywhere, if
they agree, so "Dr. Ada King" and "Ms. Ada King" are one person.

Surrogates.  An entity is a kind and a normal form (digits of a number, lower
case of an address or name).  Its surrogate follows from a keyed SHA-256 over
kind, normal form and attempt, so equal entities get equal surrogates in every
document, and it keeps the type: lengths, character classes, separators, the
top-level domain, country code or key prefix, private address ranges, check
digits (a valid card or account number stays valid), script and case of names,
and the ending that marks a name's gender.

Collisions.  Surrogates of all entities are compared by grouping, all kinds of
names together: where two entities share one, all but the first try again with
the next attempt, as does a surrogate that equals a real entity.  This repeats
until all are distinct.

Texts.  Only documents with a match are joined with the surrogates of their
mentions; the others pass through one projection.

Defined cases: a null text stays null, an empty one empty.  Rows that repeat
are replaced alike.  All columns are kept, in order; only ``text`` changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackml.llm.scratch import Scratch

KEY_SETTING = "spark.trackml.pii.key"
#: used where the session names no key; set one in production
DEFAULT_KEY = "trackml-development-key"
MAX_ATTEMPTS = 64

# Titles by gender: fixed values
MALE = ("Mr", "Herr", "Señor", "Sr", "Don", "Monsieur", "Signor", "Господин", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Doña", "Madame", "Mme", "Signora",
          "Госпожа", "Κυρία")
NEUTRAL = ("Dr", "Prof")

_TITLE = f"(?:{'|'.join(sorted(MALE + FEMALE + NEUTRAL, key=lambda t: (-len(t), t)))})"
_SECRET = r"(?i:password|passwd|pwd|secret|api_key|apikey|access_token)="

# Patterns (Java syntax): fixed values
EMAIL = r"(?<![\w.%+-])[A-Za-z0-9._%+-]++@[\p{L}0-9-]+(?:\.[\p{L}0-9-]+)*\.\p{L}{2,}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
IP = rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)"
IP6 = (r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"
       r"|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?)"
       r"(?![\w:])")
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = (r"(?<![\d-])(?:\d{13,19}|\d{4} \d{4} \d{4} \d{1,7}|\d{4}-\d{4}-\d{4}-\d{1,7}"
        r"|\d{4} \d{6} \d{5})(?![\d-])")
PHONE = (r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)"
         r"|(?<![\w.,/-])0\d{2,4}[ /-]\d{3,4}[ -]?\d{3,4}(?![\d.,/-])"
         r"|\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}([.-])\d{3}\1\d{4}(?![\d.-])")
ACCESS_KEY = (r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}"
              r"|sk-[A-Za-z0-9]{20,})(?![A-Za-z0-9])")
SECRET = rf"(?<!\w){_SECRET}[^\s\"',;&<>]{{3,}}[^\s\"',;&<>.!?:)]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
PERSON = rf"(?<!\p{{L}}){_TITLE}\.? \p{{Lu}}\p{{Ll}}+(?:-\p{{Lu}}\p{{Ll}}+)?(?: \p{{Lu}}\p{{Ll}}+(?:-\p{{Lu}}\p{{Ll}}+)?)?(?!\p{{L}})"
PATTERN = "|".join((EMAIL, SECRET, ACCESS_KEY, IBAN, IP, IP6, SSN, PHONE, CARD, PERSON))
#: every match holds a digit, an @, a double colon, a secret's name or a title
HINT = rf"[0-9@]|::|{_SECRET}|{_TITLE}"
#: words of a text and what lies between them
_WORDS = r"\p{L}+(?:-\p{L}+)*|[^\p{L}]+"


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _kind(m: str) -> str:
    """SQL for the kind of the match ``m``."""
    return f"""CASE WHEN {m} RLIKE {_quoted('^' + _SECRET)} THEN 'secret'
      WHEN {m} LIKE '%@%' THEN 'email'
      WHEN {m} LIKE '%:%:%' THEN 'ip6'
      WHEN {m} RLIKE {_quoted(r'^(AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_|^sk-')} THEN 'key'
      WHEN {m} RLIKE {_quoted(r'^[A-Z]{2}[0-9]{2}')} THEN 'iban'
      WHEN {m} RLIKE {_quoted(r'^([0-9]{1,3}[.]){3}[0-9]{1,3}$')} THEN 'ip'
      WHEN {m} RLIKE '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' THEN 'ssn'
      WHEN {m} RLIKE {_quoted(r'^[+(]|^0[0-9]{2,4}[ /-]|^[0-9]{3}([.-])[0-9]{3}\1[0-9]{4}$')} THEN 'phone'
      WHEN {m} RLIKE '^[0-9]' THEN 'card' ELSE 'person' END"""


def _parts(m: str) -> str:
    """SQL for a match's entities: kind, normal form and spelling, joined by blanks."""
    male, female = (", ".join(_quoted(t) for t in own) for own in (MALE, FEMALE))
    title = f"rtrim('.', split({m}, ' ')[0])"
    return f"""CASE {_kind(m)}
      WHEN 'person' THEN transform(split({m}, ' '), (t, i) -> named_struct(
        'kind', CASE WHEN i = 0 THEN 'title'
                     WHEN i = 1 AND size(split({m}, ' ')) = 3 THEN
                       CASE WHEN {title} IN ({male}) THEN 'given_m'
                            WHEN {title} IN ({female}) THEN 'given_f' ELSE 'given' END
                     ELSE 'surname' END,
        'norm', lower(t), 'raw', t,
        'owner', CASE WHEN i = 1 THEN lower(get(split({m}, ' '), 2)) END))
      ELSE array(named_struct('kind', {_kind(m)}, 'norm', CASE {_kind(m)}
        WHEN 'secret' THEN substr({m}, instr({m}, '=') + 1)
        WHEN 'email' THEN lower({m}) WHEN 'ip6' THEN lower({m})
        WHEN 'key' THEN {m} WHEN 'ip' THEN {m} WHEN 'iban' THEN replace({m}, ' ', '')
        ELSE regexp_replace({m}, '[^0-9+]', '') END,
        'raw', {m}, 'owner', CAST(NULL AS STRING))) END"""


def _letter(script: str) -> str:
    """SQL for a letter of a script, by the byte array ``b``."""
    letters = "àáâäèéêëìíîïòóôöùúûü" if script == "accented" else "".join(SCRIPTS[script][:2])
    return f"substr('{letters}', b[i % 128] % {len(letters)} + 1, 1)"


def _mapped(text: str, lower: str = "char(97 + b[i % 128] % 26)") -> str:
    """SQL that replaces letters and digits of ``text`` by class, with the byte array ``b``."""
    return f"""array_join(transform(filter(split({text}, ''), c -> c <> ''), (c, i) -> CASE
      WHEN c BETWEEN 'a' AND 'z' THEN {lower}
      WHEN c BETWEEN 'A' AND 'Z' THEN char(65 + b[i % 128] % 26)
      WHEN c BETWEEN '0' AND '9' THEN char(48 + b[i % 128] % 10)
      WHEN c RLIKE '\\\\p{{IsCyrillic}}' THEN {_letter('cyrillic')}
      WHEN c RLIKE '\\\\p{{IsGreek}}' THEN {_letter('greek')}
      WHEN c RLIKE '\\\\p{{L}}' THEN {_letter('accented')} ELSE c END), '')"""


def _luhn(digits: str) -> str:
    """SQL for the Luhn sum of digits that a check digit will follow."""
    return f"""aggregate(transform(filter(split(reverse({digits}), ''), c -> c <> ''), (c, i) ->
      CASE WHEN i % 2 = 1 THEN int(c) WHEN int(c) > 4 THEN 2 * int(c) - 9 ELSE 2 * int(c) END),
      0, (a, x) -> a + x)"""


def _mod97(chars: str) -> str:
    """SQL for the number that upper-case letters (A is 10) and digits spell, modulo 97."""
    spelled = f"""array_join(transform(filter(split({chars}, ''), c -> c <> ''),
      c -> CASE WHEN c BETWEEN 'A' AND 'Z' THEN string(ascii(c) - 55) ELSE c END), '')"""
    return f"""aggregate(filter(split({spelled}, ''), c -> c <> ''), 0,
      (a, c) -> (a * 10 + int(c)) % 97)"""


# Letters of invented names by script, consonants then vowels: fixed values
SCRIPTS = {
    "cyrillic": ("бвгдзклмнпрст", "аеиоу", "а", "н"),
    "greek": ("βγδζκλμνπρστ", "αειου", "α", "ς"),
    "latin": ("bdfgklmnprstv", "aeiou", "a", "n"),
}


def _name(kind: str) -> str:
    """SQL for an invented name in the script of ``norm``; given names end by gender."""
    def spell(consonants: str, vowels: str, female: str, male: str) -> str:
        syllables = f"""array_join(transform(sequence(0, 2 + b[127] % 2 + attempt div 4), i -> concat(
          substr('{consonants}', b[2 * i] % {len(consonants)} + 1, 1),
          substr('{vowels}', b[2 * i + 1] % {len(vowels)} + 1, 1))), '')"""
        return f"""concat({syllables}, CASE {kind}
          WHEN 'given_f' THEN '{consonants[5]}{female}' WHEN 'given_m' THEN '{male}'
          WHEN 'given' THEN '' ELSE '{consonants[9]}' END)"""

    return f"""CASE WHEN norm RLIKE '\\\\p{{IsCyrillic}}' THEN {spell(*SCRIPTS['cyrillic'])}
      WHEN norm RLIKE '\\\\p{{IsGreek}}' THEN {spell(*SCRIPTS['greek'])}
      ELSE {spell(*SCRIPTS['latin'])} END"""


def _surrogate() -> str:
    """SQL for the surrogate's normal form from ``kind, norm, attempt`` and bytes ``b``."""
    hex_letters = "substr('abcdef', b[i % 128] % 6 + 1, 1)"
    private = "regexp_extract(norm, '^(10|127|192[.]168|172[.](1[6-9]|2[0-9]|3[01]))[.]', 1)"
    octets = "concat_ws('.', b[1] % 254 + 1, b[2] % 254 + 1, b[3] % 254 + 1)"
    head = "substr(norm, 1, length(norm) - length(substring_index(norm, '.', -1)) - 1)"
    base = f"concat(substr(norm, 1, 1), {_mapped('substr(norm, 2, length(norm) - 2)')})"
    valid = f"(({_luhn('substr(norm, 1, length(norm) - 1)')} + int(substr(norm, -1))) % 10)"
    account = _mapped("substr(norm, 5)")
    code = "regexp_extract(norm, '^([+](1|7|[2-9][0-9])|0)', 1)"
    hexed = """array_join(transform(filter(split(norm, ''), c -> c <> ''), (c, i) -> CASE
      WHEN c = ':' THEN c ELSE substr('0123456789abcdef', b[i % 128] % 15 + 2, 1) END), '')"""
    grown = "substr('qxzwvkjyhgfd', 1, CASE WHEN attempt < 4 THEN 0 ELSE attempt div 4 END)"
    return f"""CASE kind
      WHEN 'email' THEN concat({grown}, {_mapped(head)}, '.', substring_index(norm, '.', -1))
      WHEN 'secret' THEN concat(CASE WHEN norm RLIKE '^[0-9a-f]+$' THEN {_mapped('norm', hex_letters)}
                                     ELSE {_mapped('norm')} END, {grown})
      WHEN 'key' THEN concat(regexp_extract(norm, '^(AKIA|ASIA|gh._|sk-)', 1),
        {_mapped("regexp_replace(norm, '^(AKIA|ASIA|gh._|sk-)', '')")})
      WHEN 'ip' THEN CASE
        WHEN {private} = '' THEN concat(11 + b[0] % 100, '.', {octets})
        WHEN {private} LIKE '%.%' THEN concat({private}, '.', substring_index({octets}, '.', -2))
        ELSE concat({private}, '.', {octets}) END
      WHEN 'ip6' THEN CASE WHEN norm RLIKE '^fe80:' THEN concat('fe80', substr({hexed}, 5))
        ELSE {hexed} END
      WHEN 'phone' THEN concat({code}, char(50 + b[100] % 8),
        {_mapped(f"substr(norm, length({code}) + 2)")})
      WHEN 'ssn' THEN concat(char(49 + b[100] % 5), {_mapped('substr(norm, 2)')})
      WHEN 'iban' THEN concat(substr(norm, 1, 2), lpad(string(98 - {_mod97(
          f"concat({account}, substr(norm, 1, 2), '00')")}), 2, '0'), {account})
      WHEN 'card' THEN concat({base}, string((20 - {_luhn(base)} % 10 + {valid}) % 10))
      ELSE {_name('kind')} END"""


def _rendered() -> str:
    """SQL that writes the surrogate ``sur`` in the spelling of ``raw``."""
    refilled = """aggregate(filter(split(raw, ''), c -> c <> ''),
      named_struct('o', '', 'k', CASE WHEN sur LIKE '+%' THEN 1 ELSE 0 END),
      (a, c) -> CASE WHEN c RLIKE '[A-Z0-9]' THEN named_struct(
          'o', concat(a.o, substr(sur, a.k + 1, 1)), 'k', a.k + 1)
        ELSE named_struct('o', concat(a.o, c), 'k', a.k) END, a -> a.o)"""
    return f"""CASE WHEN kind = 'title' THEN raw
      WHEN kind = 'secret' THEN concat(substr(raw, 1, instr(raw, '=')), sur)
      WHEN kind IN ('key', 'ip') THEN sur
      WHEN kind IN ('phone', 'ssn', 'card', 'iban') THEN {refilled}
      WHEN kind IN ('email', 'ip6') THEN CASE WHEN raw = upper(raw) THEN upper(sur) ELSE sur END
      ELSE concat(upper(substr(sur, 1, 1)), substr(sur, 2)) END"""


def _with_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """``kind, norm, attempt, sur``; the key enters only through the hash."""
    blocks = ", ".join(f"sha2(concat_ws('|', {_quoted(key)}, kind, norm, attempt, {k}), 256)"
                       for k in range(4))
    return (entities.withColumn("h", F.expr(f"concat({blocks})"))
            .withColumn("b", F.expr("transform(sequence(0, 127), i -> "
                                    "int(conv(substr(h, 2 * i + 1, 2), 16, 10)))"))
            .select("kind", "norm", "attempt", F.expr(_surrogate()).alias("sur")))


#: names are told apart whatever part of a name they are
_FAMILY = "CASE WHEN kind LIKE 'given%' OR kind = 'surname' THEN 'name' ELSE kind END"


def surrogates(scratch: Scratch, entities: DataFrame, key: str) -> DataFrame:
    """``kind, norm, sur``, one row per entity, all surrogates of a kind distinct and new."""
    real = scratch.put("real", entities.distinct())
    # spread by count: the expressions cost far more than the rows' bytes tell
    tasks = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))
    known = scratch.put("try0", _with_surrogates(
        real.withColumn("attempt", F.lit(0)).repartition(tasks, "kind", "norm"), key))
    family = F.expr(_FAMILY).alias("family")
    for attempt in range(1, MAX_ATTEMPTS + 1):
        first = known.groupBy(family, "sur").agg(F.min(F.struct("norm", "kind")).alias("owner"))
        taken = real.select(family, F.col("norm").alias("sur"), F.lit(True).alias("real")) \
            .distinct()
        judged = known.withColumn("family", family).join(first, ["family", "sur"]).join(
            taken, ["family", "sur"], "left")
        again = F.col("real").isNotNull() | (F.struct("norm", "kind") != F.col("owner"))
        judged = scratch.put(f"judged{attempt}", judged.select(
            "kind", "norm", "attempt", "sur", again.alias("again")))
        if judged.where("again").isEmpty():
            scratch.drop(f"judged{attempt}", "real")
            return known.select("kind", "norm", "sur")
        retried = _with_surrogates(judged.where("again").select(
            "kind", "norm", (F.col("attempt") + 1).alias("attempt")), key)
        known = scratch.put(f"try{attempt}", judged.where("not again").drop("again")
                            .union(retried))
        scratch.drop(f"judged{attempt}", f"try{attempt - 1}")
    raise ValueError(f"surrogates still collide after {MAX_ATTEMPTS} attempts")


def one_person(mentions: DataFrame) -> DataFrame:
    """Given names without gender get the one that their person has elsewhere."""
    known = mentions.where("kind IN ('given_m', 'given_f')").groupBy("norm", "owner").agg(
        F.min("kind").alias("low"), F.max("kind").alias("high")).where("low = high").select(
        "norm", "owner", F.col("low").alias("known"))
    open_ = mentions.where("kind = 'given'").join(known, ["norm", "owner"], "left").withColumn(
        "kind", F.coalesce("known", "kind"))
    return mentions.where("kind <> 'given'").union(open_.select(mentions.columns))


def found(text: Column) -> Column:
    """All matches in a text; texts without a hint are not searched."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))) \
        .otherwise(F.array().cast("array<string>"))


def pseudonymize(docs: DataFrame, key: str | None = None) -> DataFrame:
    """The same rows with surrogates in ``text``; columns as they are."""
    return replaced(docs, key).select("row.*")


def replaced(docs: DataFrame, key: str | None = None) -> DataFrame:
    """``row`` (all columns, text replaced) and ``n_entities``, the number of mentions."""
    spark = docs.sparkSession
    key = key if key is not None else spark.conf.get(KEY_SETTING, DEFAULT_KEY)
    scratch = Scratch(spark, "pii")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    # the pattern's one pass over all texts
    rows = rows.withColumn("found", found(F.col("row.text"))).withColumn(
        "hit", F.size("found") > 0)
    rows = scratch.put("rows", rows.withColumn(
        "between", F.when(F.col("hit"), F.split(F.col("row.text"), PATTERN, -1))))
    # rows are told apart by id and text, so that equal rows share one entry
    held = rows.where("hit").select(
        "row", "found", "between", F.xxhash64("row.doc_id", "row.text").alias("k1"),
        F.xxhash64("row.text", "row.doc_id").alias("k2"))
    mentions = scratch.put("mentions", held.select(
        "k1", "k2", F.posexplode("found").alias("pos", "m")).select(
        "k1", "k2", "pos", F.posexplode(F.expr(_parts("m"))).alias("part", "e")).select(
        "k1", "k2", "pos", "part", "e.kind", "e.norm", "e.raw", "e.owner").distinct())
    mentions = scratch.put("persons", one_person(mentions))
    scratch.drop("mentions")
    known = surrogates(scratch, mentions.where("kind <> 'title'").select("kind", "norm"), key)
    written = mentions.join(known, ["kind", "norm"], "left").select(
        "k1", "k2", F.expr(f"{_FAMILY} = 'name'").alias("is_name"), "raw",
        F.struct("pos", "part", F.expr(_rendered()).alias("text")).alias("w"))
    lists = scratch.put("lists", written.groupBy("k1", "k2").agg(
        F.sort_array(F.collect_set("w")).alias("ws"),
        F.sort_array(F.collect_set(F.when(F.col("is_name"), F.struct(
            "raw", F.col("w.text").alias("text"))))).alias("names")))
    scratch.drop("persons")

    def renamed(piece: Column) -> Column:
        """A piece between matches, with the document's names replaced."""
        words = F.regexp_extract_all(piece, F.lit(_WORDS), F.lit(0))
        return F.array_join(F.transform(words, lambda t: F.coalesce(
            F.get(F.filter("names", lambda n: n["raw"] == t), F.lit(0))["text"], t)), "")

    changed = held.join(lists, ["k1", "k2"]).select(
        "row", "ws", F.size("found").alias("n_entities"),
        F.when(F.size("names") > 0, F.transform("between", renamed)).otherwise(
            F.col("between")).alias("between"))
    text = F.concat(F.array_join(F.transform("ws", lambda w: F.concat(
        F.when(w["part"] == 0, F.get("between", w["pos"])).otherwise(" "), w["text"])), ""),
        F.element_at("between", -1))
    changed = changed.select(F.col("row").withField("text", text).alias("row"), "n_entities")
    return rows.where("not hit").select("row", F.lit(0).alias("n_entities")).union(changed)
