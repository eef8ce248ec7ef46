"""Personal data and secrets replaced by surrogates, with DataFrame functions only.

Entities: e-mail addresses, phone numbers, payment cards, IPv4 addresses, social security numbers,
IBANs, access keys, assigned secrets (``password=...``) and names after a title. A surrogate is drawn
from SHA-512 of the key, the kind and the entity's canonical form, and laid out as the mention was: digits
for digits, letters for letters of the same case and script, hex for hex, separators in place. Card numbers and IBANs with right
check digits get surrogates with right ones. A name is replaced word by word, each with an ending of the title's gender, so that
``Mr Smith`` is the same person as ``Mr John Smith``. So an entity's mentions, however they are laid out, get one
surrogate all over the corpus without any join (coreference).

Collision check: the distinct entities of the corpus are gathered once. Where two share a surrogate, or a
surrogate is itself an entity of the corpus, all but one draw again, until none do. The few that drew
again are joined to the documents that mention them; where there are none, there is no join.

A text is searched twice, once for the entities and once to replace them; the work grows with a text's length, whatever stands in it.

Defined results: a null text stays null and an empty one empty; texts without entities stay as they are,
character for character. Repeated rows get equal results. All other columns pass through untouched,
`n_chars` included, but for one named `n_entities`, which the result's replaces. A phone number has seven digits at least. Its country code stays where seven
or more follow, in every layout; else the code is replaced too, as fewer digits would run out of surrogates. A number of 16 digits is a card; one
of 13 to 19 is one if its check digit is right, and else stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm import _common

#: Titles that announce a name, by the gender that they state.
MALE = "Mr|Mister|Herr|Monsieur|Señor|Signor|господин|Господин"
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mademoiselle|Señora|Señorita|Signora|госпожа|Госпожа"

#: Most rounds of drawing again; each leaves a small part of the last one's collisions.
ROUNDS = 40

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: A secret has a letter or digit, and is no e-mail address (which has a form of its own).
_VALUE = r"(?=[^\s\"'<>]*[\p{L}0-9])(?![\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+\.[\p{L}\p{N}])"
#: A secret without quotes; marks at its end belong to the sentence.
_BARE = r"[^\s\"'<>]*[^\s\"'<>.,;:!?)\]}]"
#: A country code (as ITU E.164 assigns them) before seven digits or more, whatever stands between.
_NATIONAL = r"^(\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|(?!1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])\d{3}))(?=(?:[ .()-]{0,2}\d){7})"
#: The forms of entities, the more special ones first. A group without an upper bound is possessive, as Java takes a level of its stack for each turn of others.
PATTERN = "|".join((
    r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++",
    rf"(?<![\p{{L}}\p{{N}}])(?i:passwords?|passwd|pwd|secret|(?:auth|access|api|bearer|secret)?[_-]?(?:token|key))[\"']?\s{{0,3}}(?:[:=]\s{{0,3}}(?:\"{_VALUE}[^\"\s]+(?=\")|'{_VALUE}[^'\s]+(?='))|=(?![=>~])\s{{0,3}}[\"']?{_VALUE}{_BARE}|:\s{{0,3}}[\"']?{_VALUE}(?=[^\s\"'<>]*[0-9])(?=[^\s\"'<>]{{6}}){_BARE})",
    r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    r"(?<![A-Za-z0-9])(?:gh[pousr]_|sk-|xox[bap]-)[A-Za-z0-9-]{20,}",
    r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)",
    r"(?<![\d+-])\d{3}-\d{2}-\d{4}(?![\d-])",
    r"(?<![\d.,-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?![\d-])",
    r"(?<![\p{L}\d])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)(?<=" + r"\d[ .()-]{0,2}" * 6 + r"\d)",
    r"(?<![\p{L}\d])\(\d{3}\) ?\d{3}[-. ]\d{4}(?!\d)",
    r"(?<![\p{L}\d.-])\d{3}[-.]\d{3}[-.]\d{4}(?![\d.-])",
    rf"(?<!\p{{L}})(?:{MALE}|{FEMALE})\.?[ \xa0]\p{{Lu}}\p{{Ll}}+(?:[ -]\p{{Lu}}\p{{Ll}}+)?",
))
#: What every entity has in it; a text without is left alone at once.
HINT = rf"[@0-9]|(?i:passw|pwd|secret|token|key|gh[pousr]_|sk-|xox)|(?<!\p{{L}})(?:{MALE}|{FEMALE})\.?[ \xa0]"


def _let(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x), with x worked out once however often `use` names it."""
    return F.transform(F.array(x), use)[0]


def _entity(m: Column) -> Column:
    """kind, the part to leave, the part to replace and the canonical forms of a mention, one for each word of a name."""
    return _let(m, lambda m: _let(_kind(m), lambda kind: _let(_lead(m, kind), lambda lead: _let(F.substring(m, F.length(lead) + 1, F.length(m)), lambda value: _let(_canons(kind, value), lambda canons: F.struct(kind.alias("kind"), lead.alias("lead"), value.alias("value"), canons.alias("canons"), F.get(canons, 0).alias("canon")))))))


def _weights(digits: Column) -> Column:
    """The sum of digits by which a card number is checked: every second one from the right counts twice, less nine if it is over nine."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b)


def _card(m: Column) -> Column:
    digits = F.regexp_replace(m, "[ -]", "")
    return (F.length(digits) == 16) | (_weights(digits) % 10 == 0)


def _rest(code: Column) -> Column:
    """The number of an IBAN, its first four characters last and letters as numbers from ten on, modulo 97."""
    turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def _kind(m: Column) -> Column:
    return (
        F.when(m.rlike(r"^[A-Za-z_-]+[\"']?\s*[:=]"), "secret")
        .when(m.contains("@"), "email")
        .when(m.rlike(rf"^(?:{MALE})\.?[ \xa0]"), "man")
        .when(m.rlike(rf"^(?:{FEMALE})\.?[ \xa0]"), "woman")
        .when(m.rlike(r"^(?:AKIA|ASIA|gh[pousr]_|sk-|xox[bap]-)"), "access")
        .when(m.rlike(r"^[A-Z]{2}\d{2}"), "iban")
        .when(m.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), "ip")
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(m.rlike(r"^(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})$"), F.when(_card(m), "card").otherwise("number"))
        .otherwise("phone")
    )


def _lead(m: Column, kind: Column) -> Column:
    return (
        F.when(kind.isin("man", "woman"), F.regexp_extract(m, rf"^((?:{MALE}|{FEMALE})\.?[ \xa0])", 1))
        .when(kind == "secret", F.regexp_extract(m, r"^([^:=]*[:=]\s*[\"']?)", 1))
        .when(kind == "access", F.regexp_extract(m, r"^(AKIA|ASIA|gh[pousr]_|sk-|xox[bap]-)", 1))
        .when(kind == "iban", F.substring(m, 1, 2))
        .when((kind == "phone") & m.rlike(_NATIONAL), F.regexp_extract(m, _NATIONAL, 1))
        .when((kind == "phone") & m.startswith("+"), "+")
        .otherwise("")
    )


def _canons(kind: Column, value: Column) -> Column:
    one = F.when(kind == "email", F.lower(value)).when(kind.isin("phone", "card", "ssn", "iban"), F.regexp_replace(value, "[^0-9A-Za-z]", "")).otherwise(value)
    return F.when(kind.isin("man", "woman"), F.split(F.lower(value), "[ -]")).when(kind == "number", F.array().cast("array<string>")).otherwise(F.array(one))


def _bytes(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *parts), 512)


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(letters: str, n: Column) -> Column:
    return F.substring(F.lit(letters), n % len(letters) + 1, F.lit(1))


def _chars(x: Column) -> Column:
    return F.when(F.length(x) > 0, F.split(x, "")).otherwise(F.array().cast("array<string>"))


def _likewise(x: Column, stream: Column) -> Column:
    """Each character drawn anew from its own class; hex stays hex."""

    def one(c: Column, n: Column, hexed: Column) -> Column:
        return (
            F.when(hexed, _pick("0123456789abcdef", n))
            .when(c.rlike("[0-9]"), _pick("0123456789", n))
            .when(c.rlike("[a-z]"), _pick("abcdefghijklmnopqrstuvwxyz", n))
            .when(c.rlike("[A-Z]"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", n))
            .when(c.rlike("[а-яё]"), _pick("абвгдежзиклмнопрстуфхцчшэюя", n))
            .when(c.rlike("[α-ωά-ώ]"), _pick("αβγδεζηθικλμνξοπρστυφχψω", n))
            .when(c.rlike(r"\p{L}"), _pick("abcdefghijklmnopqrstuvwxyz", n))
            .otherwise(c)
        )

    # Longer ones have their characters' bytes from the 64 of the stream again and again.
    hexed = x.rlike("^(?=.*[0-9])(?=.*[a-f])[0-9a-f]{8,}$")
    return _let(hexed, lambda hexed: F.array_join(F.transform(_chars(x), lambda c, i: _let(_byte(stream, i), lambda n: one(c, n, hexed))), ""))


def _name(w: Column, stream: Column, attempt: Column, woman: Column) -> Column:
    """A word of a name, of syllables of its script, with an ending of the gender."""
    sounds = (("бвгдклмнпрст", "аеиоу", "а", "н"), ("βγδκλμνπρστ", "αειοω", "α", "ς"), ("bdfgklmnprstv", "aeiou", "a", "n"))

    def of(consonants: str, vowels: str, hers: str, his: str) -> Column:
        many = F.sequence(F.lit(0), attempt + 2)
        syllables = F.transform(many, lambda j: F.concat(_pick(consonants, _byte(stream, j * 2)), _pick(vowels, _byte(stream, j * 2 + 1))))
        body = F.array_join(syllables, "")
        return F.when(woman, F.concat(F.substring(body, F.lit(1), F.length(body) - 1), F.lit(hers))).otherwise(F.concat(body, F.lit(his)))

    return F.when(w.rlike("[а-яё]"), of(*sounds[0])).when(w.rlike("[α-ωά-ώ]"), of(*sounds[1])).otherwise(of(*sounds[2]))


def _checked(kind: Column, country: Column, canon: Column, drawn: Column) -> Column:
    """The drawn number with check digits as right as the real one's."""
    body = F.substring(drawn, F.lit(1), F.length(drawn) - 1)
    card = F.concat(body, ((10 - _weights(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))
    tail = F.substring(drawn, F.lit(3), F.length(drawn))
    iban = F.concat(F.lpad((98 - _rest(F.concat(country, F.lit("00"), tail))).cast("string"), 2, "0"), tail)
    return F.when((kind == "card") & (_weights(canon) % 10 == 0), card).when((kind == "iban") & (_rest(F.concat(country, canon)) == 1), iban).otherwise(drawn)


def _surrogate(key: str, kind: Column, country: Column, canon: Column, attempt: Column) -> Column:
    """The canonical form of an entity's surrogate; country: the letters before an IBAN's digits."""

    def email(stream: Column, fixed: Column, host: Column) -> Column:
        longer = F.when(attempt > 0, F.substring(F.conv(F.substring(stream, 97, 12), 16, 10), F.lit(1), attempt + 1)).otherwise("")
        there = _let(_bytes(key, F.lit("domain"), host), lambda own: _likewise(host, own))
        return F.concat(_likewise(F.substring_index(canon, "@", 1), stream), longer, F.lit("@"), there, fixed)

    def of(stream: Column) -> Column:
        # Reserved example domains and the last label stay; a domain has one surrogate for all its addresses.
        domain = F.substring_index(canon, "@", -1)
        fixed = F.regexp_extract(domain, r"((?:(?<![^.])example)?\.[^.]+)$", 1)
        mail = _let(fixed, lambda fixed: _let(F.substring(domain, F.lit(1), F.length(domain) - F.length(fixed)), lambda host: email(stream, fixed, host)))
        octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_byte(stream, i * 2) * 256 + _byte(stream, i * 2 + 1)) % 254 + 1), ".")
        # A secret drawn again gets as many characters more, so that short ones never run out.
        more = F.when(attempt > 0, F.substring(F.sha2(F.concat(stream, F.lit("more")), 512), F.lit(1), F.least(attempt, F.lit(ROUNDS)))).otherwise("")
        return F.when(kind == "secret", F.concat(_likewise(canon, stream), more)).when(kind == "email", mail).when(kind == "ip", octets).when(kind.isin("man", "woman"), _name(canon, stream, attempt, kind == "woman")).when(kind.isin("card", "iban"), _let(_likewise(canon, stream), lambda drawn: _checked(kind, country, canon, drawn))).otherwise(_likewise(canon, stream))

    family = F.when(kind.isin("man", "woman"), "name").otherwise(kind)
    return _let(_bytes(key, family, canon, attempt.cast("string")), of)


def _laid_out(kind: Column, value: Column, found: Column) -> Column:
    """The surrogate as the mention was written."""
    loud = (F.upper(value) == value) & value.rlike(r"\p{L}")
    named = F.when(loud, F.upper(found)).otherwise(F.when(kind.isin("man", "woman"), F.initcap(found)).otherwise(found))
    slots = F.transform(_chars(value), lambda c, i: F.when(c.rlike("[0-9A-Za-z]"), F.substring(found, F.length(F.regexp_replace(F.substring(value, F.lit(1), i + 1), "[^0-9A-Za-z]", "")), F.lit(1))).otherwise(c))
    return F.when(kind.isin("phone", "card", "ssn", "iban"), F.array_join(slots, "")).when(kind.isin("email", "man", "woman"), named).otherwise(found)


def mentions(text: Column) -> Column:
    """All mentions of entities in a text, in order."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _parts(text: Column) -> Column:
    """The text cut at its mentions: what lies between them, and the mentions, in one search."""
    mark = "\x01"
    cut = F.split(F.regexp_replace(text, PATTERN, f"{mark}$0{mark}"), mark, -1)
    alternating = _let(cut, lambda x: F.struct(F.filter(x, lambda _, i: i % 2 == 0).alias("between"), F.filter(x, lambda _, i: i % 2 == 1).alias("found")))
    # A text that holds the mark itself is searched twice.
    twice = F.struct(F.split(text, PATTERN, -1).alias("between"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)).alias("found"))
    return F.when(text.contains(mark), twice).when(text.rlike(HINT), alternating)


def _entities(docs: DataFrame, *columns: Column) -> DataFrame:
    """(kind, country, canon) of the distinct mentions of `text`, by document."""
    found = docs.select(*columns, F.explode(F.array_distinct(mentions(F.col("text")))).alias("m")).select(*columns, _entity(F.col("m")).alias("e"))
    country = F.when(F.col("e.kind") == "iban", F.col("e.lead")).otherwise("")
    return found.select(*columns, F.col("e.kind").alias("kind"), country.alias("country"), F.explode("e.canons").alias("canon"))


def redrawn(docs: DataFrame, key: str, text: str = "text") -> DataFrame | None:
    """(kind, country, canon, attempt) of the entities whose first surrogate collides; None if none does."""
    kind, country, canon = F.col("kind"), F.col("country"), F.col("canon")
    real = _common.stash(_entities(docs.select(F.col(text).alias("text"))).distinct(), "entities")
    drawn = real.withColumn("attempt", F.lit(0))
    for _ in range(ROUNDS):
        drawn = drawn.withColumn("surrogate", _surrogate(key, kind, country, canon, F.col("attempt")))
        first = drawn.groupBy("kind", "country", "surrogate").agg(F.min(F.struct("attempt", "canon")).alias("first"))
        taken = real.select(F.col("kind").alias("k"), F.col("country").alias("l"), F.col("canon").alias("c"))
        checked = drawn.join(first, ["kind", "country", "surrogate"]).join(taken, (kind == F.col("k")) & (country == F.col("l")) & (F.col("surrogate") == F.col("c")), "left")
        again = (F.col("first.canon") != canon) | F.col("c").isNotNull()
        now = _common.stash(checked.select("kind", "country", "canon", (F.col("attempt") + again.cast("int")).alias("attempt"), again.alias("again")), "drawn")
        sums = now.agg(F.count_if("again").alias("left"), F.count_if(F.col("attempt") > 0).alias("redrawn")).head()
        drawn = now.drop("again")
        if not sums.left:
            return drawn.where("attempt > 0") if sums.redrawn else None
    raise RuntimeError(f"surrogates still collide after {ROUNDS} rounds: a format has too few values")


def replace(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """`docs` with every mention of an entity replaced, and `n_entities` (int) added."""
    kept = [c for c in docs.columns if c != "n_entities"]
    again = redrawn(docs, key, text)
    # The row's own columns stay in a structure of their own, so that no name clashes.
    work = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.col(f"`{text}`").alias("text"))
    work = work.withColumn("parts", _parts(F.col("text"))).withColumn("found", F.coalesce("parts.found", F.array().cast("array<string>")))
    if again is not None:
        named = lambda *names: F.concat_ws("\x1f", *names)
        hit = _entities(docs.select(F.col(text).alias("text")).withColumn("id", F.md5("text")), F.col("id")).distinct()
        hit = hit.join(again, ["kind", "country", "canon"]).groupBy(F.col("id").alias("of")).agg(F.map_from_entries(F.collect_list(F.struct(named("kind", "country", "canon").alias("k"), F.col("attempt").alias("v")))).alias("again"))
        hit = _common.stash(hit, "redrawn")
        # Texts without an entity find nothing, wherever they are dealt.
        own = F.when(F.size("found") > 0, F.md5("text")).otherwise(F.concat(F.lit("-"), F.xxhash64("row").cast("string")))
        work = work.withColumn("id", own).join(hit, F.col("id") == F.col("of"), "left")
    else:
        work = work.withColumn("again", F.lit(None).cast("map<string,int>"))

    def new(m: Column) -> Column:
        def of(e: Column) -> Column:
            country = F.when(e["kind"] == "iban", e["lead"]).otherwise("")

            def one(canon: Column) -> Column:
                attempt = F.coalesce(F.element_at("again", F.concat_ws("\x1f", e["kind"], country, canon)), F.lit(0))
                return _let(attempt, lambda n: _surrogate(key, e["kind"], country, canon, n))

            found = F.array_join(F.transform(e["canons"], one), " ")
            return F.struct(F.when(e["kind"] == "number", m).otherwise(F.concat(e["lead"], _let(found, lambda found: _laid_out(e["kind"], e["value"], found)))).alias("new"), (e["kind"] != "number").cast("int").alias("n"))

        return _let(_entity(m), of)

    work = work.withColumn("done", F.transform("found", new))
    joined = F.array_join(F.zip_with("parts.between", "done.new", lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")
    changed = F.when(F.size("found") > 0, joined).otherwise(F.col("text"))
    count = F.aggregate("done.n", F.lit(0), lambda a, b: a + b)
    return work.select(*(changed.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in kept), count.alias("n_entities"))
