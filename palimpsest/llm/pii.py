"""Operator 4, personal data replaced by keyed surrogates, in DataFrame functions only.

Entities are found by one pattern; a card number has to pass the Luhn test and an IBAN its check digits, else the number
is something else and stays. Every distinct entity of the corpus (its type and normal form: lower case, or digits only
for telephone and card numbers) draws a surrogate from SHA-256 of key, type, normal form and attempt.
Draws are checked over the corpus: a surrogate that two entities drew, or that is itself an entity there, is drawn
again by all but the first, until none is left. So distinct entities stay distinct, and the same entity gets the
same surrogate everywhere (a surname also with another first name). Surrogates keep the type, separators, length,
letter case, check digits that fit, the country of telephone numbers and IBANs, the first digit of cards, and for names
gender (from the title, where it tells) and script. Titles may stand in a row, and names have particles, apostrophes and
hyphens. A name found by its title is replaced in the rest of its text too, where it stands without one: whole, or the
surname or a first name alone.

Cases: null texts stay null, empty ones empty; equal rows and copies get equal results; an empty table gives an
empty result; all other columns pass through, but columns whose names begin with "_pii_" are replaced. A text and its
entities are held whole by a task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .staging import join_hot, staged

#: Titles ahead of names, of women, of men and of either; German ones take fewer names, as nouns have
#: capitals; particles of names; common Chinese surnames, and the titles behind them.
WOMEN = "Mrs|Ms|Miss|Lady|Frau|Fräulein|Madame|Mademoiselle|Mme|Mlle|Señora|Señorita|Sra|Srta|Госпожа|Κυρία|MRS|MISS|FRAU|MME"
MEN = "Mr|Sir|Lord|Herrn|Herr|Monsieur|Señor|Господин|Κύριος|MR|HERR"
EITHER = "Mx|Dr|Prof|DR|PROF"
GERMAN = "Herrn?|Frau|Fräulein|HERR|FRAU"
PARTICLES = "von|van|vom|zu|zur|der|den|de|del|della|di|da|dos|du|la|le|ter|ten|bin|ibn|al|el"
HAN_SURNAMES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦方白邹孟熊秦邱江尹薛段雷侯龙史陶黎贺顾毛郝龚邵万钱严武戴莫孔向汤"
HAN_TITLES = "先生|女士|小姐"

_TITLE = f"(?:{WOMEN}|{MEN}|{EITHER})"
_PART = r"(?:\p{Lu}['’])?\p{Lu}\p{Ll}++(?:\p{Lu}\p{Ll}++)?+"
_SMALL = f"(?:(?:{PARTICLES}) ){{0,2}}"
_RUN = rf"{_TITLE}\.?(?: {_TITLE}\.?(?= ))*+"
#: A run of titles and up to three names with particles; in capitals after a title in capitals, two.
NAME = (
    rf"(?:(?<![\p{{L}}\p{{N}}])(?={_TITLE}[. ])(?:(?={GERMAN}){_RUN} {_SMALL}{_PART}(?:[ \-]{_SMALL}{_PART})?|{_RUN} {_SMALL}{_PART}(?:[ \-]{_SMALL}{_PART}){{0,2}}"
    rf"|(?=\p{{Lu}}{{2}}){_RUN} \p{{Lu}}{{2,}}+(?:[ \-]\p{{Lu}}{{2,}}+)?(?!\p{{Ll}}))|[{HAN_SURNAMES}]\p{{IsHan}}{{1,2}}(?:{HAN_TITLES}))"
)

#: One pattern for each type, tried in this order. Runs are possessive and begin at their first
#: character, so that a very long text takes linear time.
PATTERNS = {
    "email": r"(?<![^\x00-\x20@,;:\"'()<>|\[\]{}!?#$&*=/\\^~`])[^\x00-\x20@,;:\"'()<>|\[\]{}!?#$&*=/\\^~`]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++){1,8}+",
    "key": r"(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,64}+)(?![0-9A-Za-z])",
    "hex": r"[0-9A-Fa-f]{32,128}+(?![0-9A-Za-z])",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "ip6": r"(?=[0-9A-Fa-f]{1,4}:)(?<![:.])(?=[0-9A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})(?![0-9A-Za-z:]|\.[0-9])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:(?:\+[0-9]{1,3}[ .\-]?)?\([0-9]{2,4}\)[ .\-]?[0-9]{3,4}[ .\-]?[0-9]{3,4}(?![0-9])|\+[0-9]{1,3}(?:[ .\-][0-9](?=[ .\-]))?(?:[ .\-]?[0-9]{2,4}){2,5}(?![0-9])|(?<![.\-])[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4}(?![0-9\-]))",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "card": r"(?<![0-9.])(?:[0-9]{4}([ \-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{13,19}+)(?![0-9])",
    "name": NAME,
}

#: Every text with an entity has one of these; cheap tests before the patterns.
SIGNS = [r"[0-9](?:[0-9]|\.[0-9]{1,3}\.[0-9])", r"[0-9A-Fa-f]{32}"]
MARKS = ["@", "AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "::", "Mr", "Ms", "Mx", "Miss", "Dr.", "Dr ", "Prof", "Sir ", "Lord ", "Lady ", "Herr", "Frau", "Fräulein", "Monsieur", "Madame", "Mademoiselle", "Mme", "Mlle", "Señor", "Sra", "Srta", "Господин", "Госпожа", "Κύριος", "Κυρία", "MR", "MISS", "DR ", "DR.", "PROF", "HERR", "FRAU", "MME", *HAN_TITLES.split("|")]

#: Telephone codes of countries by their number of digits, one or two; the others have three.
COUNTRY = r"^(\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})|[0-9])"

#: Syllables of names and the endings of women's and men's first names, by script.
SYLLABLES = {
    "latin": (["ba", "be", "co", "da", "do", "fa", "ga", "ka", "la", "le", "ma", "mi", "na", "ne", "ro", "sa"], "lina", "rand"),
    "cyrillic": (["ба", "ве", "го", "да", "до", "за", "ка", "ко", "ла", "ле", "ма", "ми", "на", "не", "ро", "са"], "лина", "ранд"),
    "han": (["安", "宁", "文", "书", "嘉", "思", "明", "若", "清", "雨", "泽", "远", "青", "林", "星", "海"], "娜", "强"),
    "greek": (["βα", "γε", "δο", "ζα", "θε", "κα", "κο", "λα", "λε", "μα", "μι", "να", "νε", "ρο", "σα", "τα"], "λίνα", "ράνδος"),
}

#: Rounds of draws after which an address is drawn from a wider space (IPv6 for IPv4).
WIDEN = 8


def any_entity() -> str:
    """All patterns in one; a look at the first character spares most positions the rest."""
    p = PATTERNS
    return f"{p['email']}|(?<![0-9A-Za-z])(?=[0-9A-Za-gs])(?:{p['key']}|{p['hex']}|{p['iban']}|{p['ip6']})|(?=[0-9+(])(?:{p['ip']}|{p['phone']}|{p['ssn']}|{p['card']})|(?=[MDPSLHFГΚ]|\\p{{IsHan}}){p['name']}"


def signs(text: Column) -> Column:
    tests = [text.rlike(s) for s in SIGNS] + [text.contains(m) for m in MARKS]
    return reduce(lambda a, b: a | b, tests)


def kind(match: Column) -> Column:
    out = F.lit("name")
    for name, p in reversed([(n, p) for n, p in PATTERNS.items() if n != "name"]):
        out = F.when(match.rlike(rf"^(?:{p})$"), F.lit(name)).otherwise(out)
    return out


def normal(match: Column, type_: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    return F.when(type_ == "phone", F.concat(F.when(match.startswith("+"), "+").otherwise(""), digits)).when(type_.isin("card", "ssn"), digits).when(type_ == "iban", F.lower(F.replace(match, F.lit(" "), F.lit("")))).otherwise(F.lower(match))


def _mod97(iban: Column) -> Column:
    """The remainder of an IBAN in lower case: its country and check digits go behind, letters count from 10."""
    moved = F.concat(F.substr(iban, F.lit(5)), F.substring(iban, 1, 4))
    value = lambda i: F.conv(F.substring(moved, i, F.lit(1)), 36, 10).cast("int")
    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), lambda rest, i: (rest * F.when(value(i) < 10, 10).otherwise(100) + value(i)) % 97)


def genuine(type_: Column, norm: Column) -> Column:
    """Whether the check digits of a card number or an IBAN fit; other types have none."""
    return F.when(type_ == "card", F.call_function("luhn_check", norm)).when(type_ == "iban", _mod97(norm) == 1).otherwise(True)


def _script(text: Column) -> Column:
    return F.when(text.rlike(r"\p{IsHan}"), "han").when(text.rlike(r"\p{IsCyrillic}"), "cyrillic").when(text.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _stream(secret: str, *parts: Column) -> Column:
    """128 hexadecimal digits of a keyed hash."""
    text = F.concat_ws("|", F.lit(secret), *parts)
    return F.concat(F.sha2(text, 256), F.sha2(F.concat(text, F.lit("|2")), 256))


def _letters(hexes: Column) -> Column:
    return F.translate(hexes, "0123456789abcdef", "ghijklmnopabcdef")


def _digits(hexes: Column) -> Column:
    """36 decimal digits."""
    return F.concat(*[F.lpad(F.substring(F.conv(F.substring(hexes, 1 + 15 * i, 15), 16, 10), -12, 12), 12, "0") for i in range(3)])


def _name(hexes: Column, script: Column, gender: Column | None, n: Column) -> Column:
    """n syllables (at most one for each of the 128 digits) and, for a first name, the gender's ending."""
    out = None
    for s, (syllables, female, male) in SYLLABLES.items():
        table = F.array(*map(F.lit, syllables))
        built = F.initcap(F.array_join(F.transform(F.sequence(F.lit(1), F.least(n, F.lit(128))), lambda i: F.element_at(table, F.conv(F.substring(hexes, i, F.lit(1)), 16, 10).cast("int") + 1)), ""))
        if gender is not None:
            built = F.concat(built, F.when(gender == "f", female).when(gender == "m", male).otherwise(""))
        out = F.when(script == s, built) if out is None else out.when(script == s, built)
    return out


def draw(secret: str, type_: Column, norm: Column, attempt: Column) -> Column:
    """A surrogate's normal form; the same length as the entity's where the type has a fixed form."""
    h = _stream(secret, type_, norm, attempt.cast("string"))
    octet = lambda i: F.conv(F.substring(h, 1 + 2 * i, 2), 16, 10)
    size = F.length(norm)
    number = F.substring(_digits(h), 1, 36)
    ip = F.when(attempt < WIDEN, F.concat((F.lit(240) + F.conv(F.substring(h, 1, 1), 16, 10).cast("int") % 15).cast("string"), F.lit("."), octet(1), F.lit("."), octet(2), F.lit("."), octet(3))).otherwise(F.concat(F.lit("fd"), F.substring(h, 1, 2), *[F.concat(F.lit(":"), F.substring(h, 3 + 4 * i, 4)) for i in range(7)]))
    extra = F.floor(attempt / 4).cast("int")  # longer numbers after some rounds
    more = F.floor(attempt / 2).cast("int")  # and longer names, so that no number of names fills the space
    code = F.regexp_extract(norm, COUNTRY, 1)
    # A card's last digit makes it pass the Luhn test.
    body = F.concat(F.substring(norm, 1, 1), F.substr(number, F.lit(1), size + extra - 2))
    card = F.concat(body, F.filter(F.array(*[F.lit(str(i)) for i in range(10)]), lambda c: F.call_function("luhn_check", F.concat(body, c)))[0])
    place = lambda i: F.substring(number, i - 4, F.lit(1))
    account = F.array_join(F.transform(F.sequence(F.lit(5), size + extra), lambda i: F.when(F.substring(norm, i, F.lit(1)).rlike("[a-z]"), F.translate(place(i), "0123456789", "abcdefghij")).otherwise(place(i))), "")
    check = F.lpad((98 - _mod97(F.concat(F.substring(norm, 1, 2), F.lit("00"), account))).cast("string"), 2, "0")
    hexes = F.length(F.regexp_replace(norm, "[^0-9a-f]", ""))
    wide = F.concat(F.lit("fd"), F.substring(h, 1, 2), *[F.concat(F.lit(":"), F.substring(h, 3 + 4 * i, 4)) for i in range(7)])
    return (
        F.when(type_ == "none", F.lit("-"))
        .when(type_ == "email", F.concat(_letters(F.substring(h, 1, 12)), F.lit("@"), _letters(F.substring(_stream(secret, F.lit("domain"), F.substring_index(norm, "@", -1)), 1, 8)), F.lit(".example")))
        .when(type_ == "ip", ip)
        .when(type_ == "ip6", F.when(attempt >= WIDEN, wide).when(hexes < 6, F.substr(h, F.lit(1), hexes)).otherwise(F.concat(F.lit("fd"), F.substr(h, F.lit(1), hexes - 2))))
        .when(type_ == "phone", F.concat(code, F.substr(number, F.lit(1), F.greatest(size - F.length(code), F.lit(7)) + extra)))
        .when(type_ == "card", card)
        .when(type_ == "ssn", F.concat(F.lit("9"), F.substr(number, F.lit(1), size + extra - 1)))
        .when(type_ == "iban", F.concat(F.substring(norm, 1, 2), check, account))
        .when(type_ == "key", F.concat(F.regexp_extract(norm, "^(akia|gh._|sk-)", 1), F.substr(F.concat(h, h), F.lit(1), size - F.length(F.regexp_extract(norm, "^(akia|gh._|sk-)", 1)))))
        .when(type_ == "hex", F.substr(h, F.lit(1), size))
        .when(type_.startswith("first:"), _name(h, F.element_at(F.split(type_, ":"), 3), F.element_at(F.split(type_, ":"), 2), more + 3))
        .otherwise(_name(h, F.element_at(F.split(type_, ":"), 2), None, more + 5))
    )


def titles(match: Column) -> Column:
    """The run of titles ahead of a name, with its last space."""
    return F.regexp_extract(match, rf"^((?:{_TITLE}\.? )*)", 1)


def tokens(match: Column) -> Column:
    """A name without its titles, in pieces: names, particles, and what stands between."""
    return F.regexp_extract_all(F.regexp_replace(match, rf"^(?:{_TITLE}\.? )+", ""), F.lit(r"[^ \-]+|[ \-]"), F.lit(0))


def _is_name(token: Column) -> Column:
    return token.rlike(r"^\p{Lu}")


def parts(matches: DataFrame) -> DataFrame:
    """A row for each drawn part of a match: itself, or first names and surname. What only looks like a card or an IBAN
    is of kind none."""
    title = titles(F.col("match"))
    script = _script(F.col("match"))
    gender = F.when(title.rlike(rf"(?:^| )(?:{WOMEN})\.? ") | F.col("match").rlike("(?:女士|小姐)$"), "f").when(title.rlike(rf"(?:^| )(?:{MEN})\.? ") | F.col("match").rlike("先生$"), "m").otherwise("u")
    typed = matches.withColumn("type", kind(F.col("match"))).withColumn("norm", normal(F.col("match"), F.col("type")))
    typed = typed.withColumn("type", F.when(genuine(F.col("type"), F.col("norm")), F.col("type")).otherwise("none")).withColumn("names", F.filter(tokens(F.col("match")), _is_name))
    first = F.concat_ws(":", F.lit("first"), gender, script)
    named = F.transform("names", lambda n, i: F.struct(F.when(i < F.size("names") - 1, first).otherwise(F.concat_ws(":", F.lit("surname"), script)).alias("type"), F.lower(n).alias("norm")))
    han = F.struct(first.alias("type"), F.regexp_replace("match", f"(?:{HAN_TITLES})$", "").alias("norm"))
    own = F.struct(F.col("type"), F.when(F.col("type") == "none", "").otherwise(F.col("norm")).alias("norm"))
    found = F.when(F.col("type") != "name", F.array(own)).when(script == "han", F.array(han)).otherwise(named)
    return typed.select(*matches.columns, F.col("type").alias("kind"), F.posexplode(found).alias("part", "of")).select(*matches.columns, "kind", "part", "of.type", "of.norm")


def surrogates(entities: DataFrame, secret: str) -> DataFrame:
    """type, norm, value for distinct (type, norm); values are distinct in a type and none is a norm of that type."""
    entities = staged(entities.distinct(), "pii-entities")
    waiting, done, attempt = entities.select("type", "norm"), None, 0
    while attempt == 0 or not waiting.isEmpty():
        drawn = waiting.withColumn("value", draw(secret, F.col("type"), F.col("norm"), F.lit(attempt)))
        # Names are drawn with a capital.
        taken = entities.select("type", F.when(F.col("type").rlike("^(first|surname):"), F.initcap("norm")).otherwise(F.col("norm")).alias("value"))
        taken = taken if done is None else taken.unionByName(done.select("type", "value"))
        first = drawn.groupBy("type", "value").agg(F.min("norm").alias("norm")).join(taken, ["type", "value"], "left_anti")
        first = staged(first.select("type", "norm", "value"), "pii-surrogates")
        waiting = staged(waiting.join(first, ["type", "norm"], "left_anti"), "pii-waiting")
        done = first if done is None else done.unionByName(first)
        attempt += 1
    return done


def render(match: Column, type_: Column, value: Column) -> Column:
    """The surrogate in the separators and letter case of the match."""
    digits = F.split(F.regexp_replace(value, r"^\+", ""), "")
    laid = F.array_join(F.zip_with(F.split(match, "[0-9]", -1), digits, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")
    upper = (F.upper(match) == match) & (F.lower(match) != match)
    spaced = F.regexp_replace(F.upper(value), "(.{4})(?=.)", "$1 ")
    hexes = F.array_join(F.zip_with(F.split(match, "[0-9A-Fa-f]", -1), F.split(value, ""), lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")
    hexes = F.when(value.contains(":"), value).otherwise(hexes)
    return F.when(type_ == "none", match).when(type_.isin("phone", "card", "ssn"), laid).when(type_ == "ip6", F.when(upper, F.upper(hexes)).otherwise(hexes)).when(type_ == "iban", F.when(match.contains(" "), spaced).otherwise(F.upper(value))).when(upper, F.upper(value)).otherwise(value)


def untitled(piece: Column, names: Column) -> Column:
    """Text between entities, with the names that titles have shown (full, surname and their surrogates) replaced."""
    word = lambda name: F.concat(F.lit(r"(?<![\p{L}\p{N}])"), name, F.lit(r"(?![\p{L}\p{N}])"))

    def one(text: Column, name: Column) -> Column:
        # All full names come before all surnames alone, in the order of names.
        return F.when(F.instr(text, name["old"]) > 0, F.regexp_replace(text, word(name["old"]), name["new"])).otherwise(text)

    return F.aggregate(names, piece, one)


def replace_pii(docs: DataFrame, secret: str, text: str = "text") -> DataFrame:
    """docs with the entities in text replaced, and _pii_types added: the types of the entities, in their order.
    secret: the key that surrogates are drawn with; who has it can't get entities back, but can test guesses."""
    docs = docs.drop(*[c for c in docs.columns if c.lower().startswith("_pii_")])
    pattern = F.lit(any_entity())
    has = F.coalesce(signs(F.col(text)) & F.col(text).rlike(any_entity()), F.lit(False))
    keyed = docs.where(has).withColumn("_pii_key", F.md5(F.col(text).cast("binary")))
    found = keyed.select(F.col("_pii_key").alias("key"), F.posexplode(F.regexp_extract_all(F.col(text), pattern, F.lit(0))).alias("pos", "match"))
    # Copies are one text, with their number.
    found = found.groupBy("key", "pos").agg(F.min("match").alias("match"), F.count("*").alias("copies"))
    found = staged(parts(found).withColumn("of", F.struct("type", "norm")), "pii-found")
    values = surrogates(found.select("type", "norm"), secret).withColumn("of", F.struct("type", "norm")).select("of", "value")
    times = found.groupBy("of").agg(F.count("*").alias("times"))
    values = staged(values.join(times, "of"), "pii-values")
    one = F.when(F.col("kind") == "name", F.col("value")).otherwise(render(F.col("match"), F.col("kind"), F.col("value")))
    by_match = join_hot(found, values, "of", "times").groupBy("key", "pos", "match", "kind", "copies").agg(F.array_sort(F.collect_list(F.struct("part", one.alias("value")))).alias("made"))
    made = F.array_join(F.col("made.value"), "")
    # Names in capitals stay so.
    loud = ~F.col("match").rlike(r"\p{Ll}") & F.col("match").rlike(r"^\p{Lu}")
    news = F.transform("made.value", lambda v: F.when(loud, F.upper(v)).otherwise(v))
    pieces_of = tokens(F.col("match"))
    whole = F.array_join(F.transform(pieces_of, lambda t, i: F.when(_is_name(t), F.element_at(news, F.size(F.filter(F.slice(pieces_of, F.lit(1), i + 1), _is_name)))).otherwise(t)), "")
    bare = F.when((F.col("kind") == "name") & ~F.col("match").rlike(r"\p{IsHan}"), whole).otherwise("")
    han = F.col("match").rlike(r"\p{IsHan}")
    name = F.when(han, F.concat(news[0], F.regexp_extract("match", f"({HAN_TITLES})$", 1))).otherwise(F.concat(titles(F.col("match")), bare))
    by_match = by_match.withColumns({"new": F.when(F.col("kind") == "name", name).otherwise(made), "olds": F.filter(pieces_of, _is_name), "news": news, "bare": bare, "whole": F.array_join(pieces_of, "")})
    by_text = by_match.groupBy("key").agg(F.max("copies").alias("copies"), F.array_sort(F.collect_list(F.struct("pos", F.col("new").alias("made"), "kind", "match", "whole", "bare", "olds", "news"))).alias("_pii_made")).withColumnRenamed("key", "_pii_key")
    titled = F.filter("_pii_made", lambda m: (m["kind"] == "name") & (F.size(m["olds"]) > 0))
    pair = lambda old, new: F.struct(old.alias("old"), new.alias("new"))
    full = F.transform(titled, lambda m: pair(m["whole"], m["bare"]))
    surname = F.transform(titled, lambda m: pair(F.element_at(m["olds"], -1), F.element_at(m["news"], -1)))
    first = F.flatten(F.transform(titled, lambda m: F.zip_with(F.slice(m["olds"], F.lit(1), F.size(m["olds"]) - 1), F.slice(m["news"], F.lit(1), F.size(m["olds"]) - 1), pair)))
    by_text = staged(by_text.withColumn("_pii_names", F.array_distinct(F.concat(full, surname, first))), "pii-texts")
    pieces = F.split(F.col(text), pattern, -1)
    pieces = F.when(F.size("_pii_names") > 0, F.transform(pieces, lambda p: untitled(p, F.col("_pii_names")))).otherwise(pieces)
    spliced = F.array_join(F.zip_with(pieces, F.col("_pii_made.made"), lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")
    replaced = join_hot(keyed, by_text, "_pii_key", "copies").withColumn(text, spliced).withColumn("_pii_types", F.filter(F.col("_pii_made.kind"), lambda k: k != "none")).select(*docs.columns, "_pii_types")
    return replaced.unionByName(docs.where(~has).withColumn("_pii_types", F.array().cast("array<string>")))
