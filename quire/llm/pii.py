"""PII surrogates by DataFrame functions only (op5).

Entities are found by one alternation of patterns, evaluated once over every text: e-mail,
IPv4, international and common national phone numbers, US social security numbers,
payment cards, and personal names, which are known by titles (``TITLES``) or by a
common given name (``GIVEN``) and reach over all capitalised words, initials and particles (``PARTICLES``) that follow, up to
a mark or a small letter. Names without either, street addresses and national
numbers without separators are not found.

An entity is made of parts, and a part has a kind and a canonical form in which its spellings
agree: digits for phones, cards and SSNs, case folded local part and domain of an
e-mail, given names and surnames of a person, those joined by a hyphen each by itself. A given name has one
surrogate, whatever title stands before it: of the gender that all its mentions agree on. Every distinct part of the corpus gets one
keyed surrogate: a SHA-256 stream over (key, kind, canonical form, attempt) fills the
form, so a valid card number gets a valid one, a given name one of its gender, a
surname one in its script, a domain one below a reserved name. A surrogate that
another part of its kind has, or that is some real part, is replaced by that of the next attempt; later
attempts add syllables or digits, so that the space grows much faster than what is left and the
attempts end. A surrogate is then written in the format of each mention: its
separators, its capitals. So "Mr. John Smith", "Mr Smith" and "SMITH" behind a title share
a surname, and "+1 555 123 4567" and "+1-555-123-4567" a number.

Edge cases: a null text stays null. Texts without entities are returned as they are
and never shuffled. Repeated rows get equal results. Extra columns are dropped; rows that repeat a
doc_id with other texts are told apart by a hash of the text. Everything between entities is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import keyed_join, materialize

# Titles by gender, given names by gender and script, sounds of made names by script.
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Lady", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Srta", "Doña", "Госпожа", "Κυρία"),
    "m": ("Mr", "Mister", "Sir", "Lord", "Herr", "Monsieur", "Señor", "Sr", "Don", "Господин", "Κύριος"),
    "n": ("Dr", "Prof", "Professor", "Доктор"),
}
GIVEN = {
    ("f", "latin"): ("Alma", "Alice", "Anna", "Bella", "Carmen", "Clara", "Dora", "Elena", "Elisabeth", "Elsa", "Emma", "Frida", "Greta", "Hanna", "Ida", "Ingrid", "Jane", "Julia", "Karin", "Klara", "Laura", "Lena", "Lucia", "Maria", "Marie", "Mary", "Monika", "Nora", "Olga", "Paula", "Sarah", "Sofia", "Susan", "Teresa"),
    ("m", "latin"): ("Adam", "Albert", "Bruno", "Carl", "Carlos", "David", "Emil", "Felix", "Georg", "George", "Hans", "Hugo", "Ivan", "Jack", "James", "Jean", "John", "Jonas", "José", "Juan", "Karl", "Klaus", "Leon", "Luis", "Max", "Michael", "Nils", "Otto", "Paul", "Peter", "Pierre", "Robert", "Thomas", "William"),
    ("f", "cyrillic"): ("Анна", "Вера", "Дарья", "Елена", "Ирина", "Лидия", "Мария", "Нина"),
    ("m", "cyrillic"): ("Антон", "Борис", "Виктор", "Денис", "Егор", "Иван", "Олег", "Павел"),
    ("f", "greek"): ("Άννα", "Ελένη", "Μαρία", "Σοφία"),
    ("m", "greek"): ("Γιώργος", "Κώστας", "Νίκος", "Πέτρος"),
}
PARTICLES = "von van vom zu zur ter ten den der de del della di da das dos du la le bin ibn al".split()
SOUNDS = {"latin": ("b d f g k l m n p r s t v z", "a e i o u"), "cyrillic": ("б в г д ж з к л м н п р с т", "а е и о у"), "greek": ("β γ δ ζ θ κ λ μ ν π ρ σ τ φ", "α ε ι ο")}
ENDINGS = {
    ("f", "latin"): "na la ra sa", ("m", "latin"): "n r s rt", ("n", "latin"): "ni lo ri", ("s", "latin"): "ler mann ton sen dal wick",
    ("f", "cyrillic"): "на ла ра", ("m", "cyrillic"): "н р слав", ("n", "cyrillic"): "ко ло", ("s", "cyrillic"): "нов ров мов лев",
    ("f", "greek"): "να λη ρα", ("m", "greek"): "νος ρης λος", ("n", "greek"): "νι λο", ("s", "greek"): "κης δης νος",
}
ALPHABETS = {"a-z": "abcdefghijklmnopqrstuvwxyz", "A-Z": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "а-я": "абвгдежзиклмнопрстуфхцчшщэюя", "А-Я": "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ"}

_LOCAL = r"[\p{L}\p{N}._%+-]"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_ALONE, _ENDS = r"(?<![0-9.,/+-])", r"(?![.,-]?[0-9])"
_WORD = r"\p{Lu}\p{L}*(?:['’-]\p{Lu}\p{L}*)*"
_TITLE = r"(?:M\.|(?:" + "|".join(x for group in TITLES.values() for t in group for x in (t, t.upper())) + r")\b\.?)"
_ANY = rf"(?:\p{{Lu}}\.(?=[ -])|{_WORD})"  # an initial or a word
_PARTICLES = "(?:(?:" + "|".join(PARTICLES) + ") )*"
_PIECE = r"(?U)([ -]?(?:\p{Ll}\p{L}* )*)(\p{Lu}\.|\p{Lu}[\p{L}'’]*)"  # what stands before a piece of a name, and the piece
_NATIONAL = (
    r"(?<![0-9])\([0-9]{2,5}\)[ ./-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])",
    _ALONE + r"[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}" + _ENDS,
    _ALONE + r"0[0-9]{2,4}[ /-][0-9]{5,8}" + _ENDS,
    _ALONE + r"0[0-9](?:[ .-][0-9]{2}){4}" + _ENDS,
)
KINDS = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "ipv4": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])(?:[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9+])\+(?=(?:[ ./()-]{0,2}[0-9]){7})[0-9]{1,3}(?:[ ./-]?\([0-9]{1,4}\))?(?:[ ./-]?[0-9]{1,4}){2,6}(?![0-9])|" + "|".join(_NATIONAL),
    "name": rf"(?<![\p{{L}}\p{{N}}_])(?:(?:{_TITLE} )+{_PARTICLES}{_ANY}|(?:" + "|".join(n for group in GIVEN.values() for n in group) + rf") {_PARTICLES}{_ANY})(?: {_PARTICLES}{_ANY}){{0,4}}",
}
# One look at a character excludes most places before the costly alternatives.
_NUMBERS = "|".join(KINDS[k] for k in ("ipv4", "ssn", "card", "phone"))
PATTERN = rf"(?U)(?:{KINDS['email']})|(?=[0-9+(])(?:{_NUMBERS})|(?=\p{{Lu}}){KINDS['name']}"
SPELLED, LAST = 2, 16  # attempts that keep the length of the form; the attempt that is not checked any more


def kind_of(entity: Column) -> Column:
    out = F.lit("name")
    for kind in ("phone", "card", "ssn", "ipv4", "email"):
        out = F.when(entity.rlike("(?U)^(?:" + KINDS[kind] + ")$"), kind).otherwise(out)
    return out


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def script_of(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _feminine(word: Column) -> Column:
    """Whether a Slavic surname has the feminine ending."""
    return F.lower(word).rlike("(?:ов|ев|ёв|ин|ын)а$")


def _named(gender: str) -> list[str]:
    return [n.lower() for (g, _), names in GIVEN.items() if g == gender for n in names]


def parts(entity: Column, kind: Column) -> Column:
    """array of struct(lead, kind, name, piece): what stands before a part, its kind, canonical form and spelling."""

    def part(lead: Column, kind: Column, name: Column, piece: Column) -> Column:
        return F.struct(lead.alias("lead"), kind.alias("kind"), name.alias("name"), piece.alias("piece"))

    none = F.lit("")
    local, domain = F.substring_index(entity, "@", 1), F.substring_index(entity, "@", -1)
    email = F.array(part(none, F.concat(F.lit("local@"), F.lower(domain)), F.lower(local), local), part(F.lit("@"), F.lit("domain"), F.lower(domain), domain))
    plus = F.when(entity.startswith("+"), "+").otherwise("")
    number = F.when(kind == "phone", F.concat(plus, digits(entity))).when(kind == "ipv4", entity).otherwise(digits(entity))
    rest = F.regexp_replace(entity, f"(?U)^(?:{_TITLE} )+", "")
    head = F.substr(entity, F.lit(1), F.length(entity) - F.length(rest))
    women, men = ("(?U)(?:^|[ ])(?:" + "|".join(x for t in TITLES[g] for x in (t, t.upper())) + r")\.? " for g in "fm")
    titled = F.when(head.rlike(women), "f").when(head.rlike(men) | head.rlike(r"(?:^| )M\. "), "m")
    leads, pieces = (F.regexp_extract_all(rest, F.lit(_PIECE), F.lit(i)) for i in (1, 2))
    begun = lambda x: x.startswith(" ")
    last = F.size(F.filter(leads, begun))

    def person_part(piece: Column, k: Column) -> Column:
        """Pieces of the last word are a surname, those of the first a given name; between them stand given names that are known or initials, and surnames."""
        own = F.get(leads, k)
        word = F.size(F.filter(F.slice(leads, F.lit(1), k + 1), begun))
        known = F.when(F.lower(piece).isin(_named("f")), "f").when(F.lower(piece).isin(_named("m")), "m")
        initial = piece.rlike(r"^\p{Lu}\.$")
        given = (word < last) & ((word == 0) | known.isNotNull() | initial)
        gender = F.when(initial, "n").otherwise(F.coalesce(titled, known, F.lit("n")))
        form = F.when(_feminine(piece), F.regexp_replace(F.lower(piece), "а$", "")).otherwise(F.lower(piece))
        kind = F.concat(F.when(given, gender).otherwise("s"), F.lit(":"), script_of(piece))
        return part(F.when(k == 0, F.concat(head, own)).otherwise(own), kind, F.when(given, F.lower(piece)).otherwise(form), piece)

    person = F.transform(pieces, person_part)
    return F.when(kind == "email", email).when(kind == "name", person).otherwise(F.array(part(none, kind, number, entity)))


def stream(key: str, attempt: int) -> Column:
    """128 hex digits that depend on the key, a part's kind and name, and the attempt."""
    seed = F.concat_ws("\u001f", F.lit(key), "kind", "name", F.lit(str(attempt)))
    return F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("\u001f2")), 256))


def _value(stream: Column, place: Column) -> Column:
    """A number from 0 to 65535 at a place of the stream."""
    return F.conv(F.substring(stream, F.pmod(place * 4, F.lit(124)) + 1, F.lit(4)), 16, 10).cast("int")


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _refill(text: Column, stream: Column, keep: Column) -> Column:
    """text with new digits for digits and new letters of the same case and script for letters, but for its first keep characters."""

    def new(c: Column, i: Column) -> Column:
        v = _value(stream, i)
        out = F.when(c.rlike("[0-9]"), F.substring(F.lit("0123456789"), v % 10 + 1, F.lit(1)))
        for span, letters in ALPHABETS.items():
            out = out.when(c.rlike(f"[{span}]"), F.substring(F.lit(letters), v % len(letters) + 1, F.lit(1)))
        out = out.when(c.rlike(r"\p{Lu}"), F.substring(F.lit("ÁÉÍÓÚ"), v % 5 + 1, F.lit(1))).when(c.rlike(r"\p{L}"), F.substring(F.lit("áéíóú"), v % 5 + 1, F.lit(1)))
        return F.when(i < keep, c).otherwise(out.otherwise(c))

    return F.array_join(F.transform(_chars(text), new), "")


def _luhn(number: Column) -> Column:
    """Sum of the Luhn check over a string of digits."""
    doubled = F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)])
    terms = F.transform(F.reverse(_chars(number)), lambda c, i: F.when(i % 2 == 1, F.element_at(doubled, c.cast("int") + 1)).otherwise(c.cast("int")))
    return F.aggregate(terms, F.lit(0), lambda a, x: a + x)


def _made(stream: Column, kind: Column, attempt: int) -> Column:
    """A name of the kind's gender and script, of more syllables with each attempt."""
    script = F.substring_index(kind, ":", -1)

    def by_script(i: int) -> Column:
        return F.when(script == "cyrillic", SOUNDS["cyrillic"][i]).when(script == "greek", SOUNDS["greek"][i]).otherwise(SOUNDS["latin"][i])

    def one(options: Column, place: Column) -> Column:
        letters = F.split(options, " ")
        return F.element_at(letters, _value(stream, place) % F.size(letters) + 1)

    ends = F.create_map(*[F.lit(x) for (gender, of), e in ENDINGS.items() for x in (f"{gender}:{of}", e)])[kind]
    syllables = F.transform(F.sequence(F.lit(0), F.lit(min(13, 2 + attempt) - 1)), lambda i: F.concat(one(by_script(0), 2 * i), one(by_script(1), 2 * i + 1)))
    out = F.concat(F.array_join(syllables, ""), one(ends, F.lit(29)))
    if attempt == 0:
        names = F.create_map(*[F.lit(x) for (gender, of), names in GIVEN.items() for x in (f"{gender}:{of}", " ".join(names).lower())])[kind]
        out = F.coalesce(one(names, F.lit(30)), out)
    return out


def surrogate(s: Column, kind: Column, name: Column, attempt: int) -> Column:
    """The surrogate of a canonical part, from its stream."""
    extra = 3 * max(0, attempt - SPELLED + 1)
    letters = F.translate(F.substring(s, 66, 2 * extra), "0123456789", "ghijklmnop") if extra else F.lit("")
    more = F.regexp_replace(F.translate(F.substring(s, 66, extra), "abcdef", "012345"), "[^0-9]", "0") if extra else F.lit("")
    ipv4 = F.array_join(F.transform(F.array(*[F.lit(i) for i in range(4)]), lambda i: (_value(s, i + 3) % 254 + 1).cast("string")), ".")
    if attempt > 6:  # only when a large part of all addresses is taken
        ipv4 = F.concat(F.lit("2001:db8:"), F.array_join(F.transform(F.array(*[F.lit(i) for i in range(6)]), lambda i: F.substring(s, i * 4 + 1, F.lit(4))), ":"))
    one = F.lit(1)
    card = F.concat(_refill(name, s, one), more)
    body = F.regexp_replace(card, "[0-9]$", "")
    check = F.pmod(10 - F.pmod(_luhn(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10))
    card = F.when(_luhn(name) % 10 == 0, F.concat(body, check.cast("string"))).otherwise(card)
    domain = F.concat(F.translate(F.substring(s, 1, 10 + extra), "0123456789", "ghijklmnop"), F.lit(".example.com"))
    return (
        F.when(kind.startswith("local@"), F.concat(_refill(name, s, F.lit(0)), letters))
        .when(kind == "domain", domain)
        .when(kind == "ipv4", ipv4)
        .when(kind == "phone", F.concat(_refill(name, s, F.when(name.startswith("+"), 2).otherwise(1)), more))
        .when(kind == "card", card)
        .when(kind == "ssn", F.concat(_refill(name, s, F.lit(0)), more))
        .otherwise(_made(s, kind, attempt))
    )


def dictionary(real: DataFrame, key: str) -> DataFrame:
    """(kind, name, n, surrogate) of the distinct parts of real (kind, name, n), all surrogates of a scope distinct and none a real part.

    Given names of all genders are one scope. The attempts end: each has a space many times that of
    the one before, and the last one, of 128 bits, is taken as it comes.
    """
    scope = F.when(F.col("kind").rlike("^[fmn]:"), "given").otherwise(F.col("kind"))
    real = materialize(real.withColumn("scope", scope))
    settled, pending = None, real
    for attempt in range(LAST + 1):
        tried = pending.withColumn("stream", stream(key, attempt)).withColumn("surrogate", surrogate(F.col("stream"), F.col("kind"), F.col("name"), attempt)).drop("stream")
        taken = real.select(F.col("scope").alias("k"), F.col("name").alias("c"))
        if settled is not None:
            taken = taken.union(settled.select("scope", "surrogate"))
        first = tried.groupBy("scope", "surrogate").agg(F.min(F.struct("kind", "name")).alias("one"))
        won = first.join(taken, (F.col("scope") == F.col("k")) & (F.col("surrogate") == F.col("c")), "left_anti").select(F.col("one.kind").alias("wk"), F.col("one.name").alias("wn"))
        tried = materialize(tried.join(won, (F.col("kind") == F.col("wk")) & (F.col("name") == F.col("wn")), "left").withColumn("won", F.col("wk").isNotNull()).drop("wk", "wn"))
        now = tried.where(F.col("won") | F.lit(attempt == LAST)).drop("won")
        settled = now if settled is None else settled.unionByName(now)
        pending = tried.where("not won").drop("won", "surrogate")
        if pending.isEmpty():
            break
    return settled.drop("scope")


def shown(piece: Column, kind: Column, new: Column) -> Column:
    """A surrogate in the format of a mention: its separators, its capitals."""
    figures, ready = digits(new), kind.isin("phone", "card", "ssn")
    filled = F.transform(_chars(piece), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(figures, F.length(digits(F.substring(piece, F.lit(1), i + 1))), F.lit(1))).otherwise(c))
    number = F.concat(F.array_join(filled, ""), F.substring(figures, F.length(digits(piece)) + 1, F.lit(200)))
    cased = F.array_join(F.transform(_chars(new), lambda c, i: F.when(F.substring(piece, i + 1, F.lit(1)).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c)), "")
    titled = F.concat(F.upper(F.substring(new, 1, 1)), F.substring(new, F.lit(2), F.lit(200)))
    loud = (piece == F.upper(piece)) & piece.rlike(r"\p{L}") & (F.length(piece) > 1)
    name = F.when(_feminine(piece) & (kind == "s:cyrillic"), F.concat(new, F.when(loud, "А").otherwise("а"))).otherwise(new)
    name = F.when(loud, F.upper(name)).otherwise(F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, F.lit(2), F.lit(200))))
    return (
        F.when(ready, number)
        .when(piece.rlike(r"^\p{Lu}\.$") & kind.rlike("^[fmn]:"), F.concat(F.upper(F.substring(new, 1, 1)), F.lit(".")))
        .when(kind.rlike("^[fmns]:"), name)
        .when(loud, F.upper(new))
        .when(kind.startswith("local@"), cased)
        .when((kind == "domain") & piece.rlike(r"^\p{Lu}"), titled)
        .otherwise(new)
    )


def settled_names(real: DataFrame, key: str) -> DataFrame:
    """dictionary of real, in which a given name is one part whatever its titles: of the gender that its mentions agree on, else of neither."""
    given, script = F.col("kind").rlike("^[fmn]:"), F.substring_index("kind", ":", -1)
    told = lambda g: F.max(F.col("kind").startswith(f"{g}:")).over(W.partitionBy(given, script, "name"))
    gender = F.when(told("f") & ~told("m"), "f").when(told("m") & ~told("f"), "m").otherwise("n")
    one = materialize(real.withColumn("as", F.when(given, F.concat(gender, F.lit(":"), script)).otherwise(F.col("kind"))))
    made = dictionary(one.groupBy(F.col("as").alias("kind"), "name").agg(F.sum("n").alias("n")), key).select(F.col("kind").alias("m_kind"), F.col("name").alias("m_name"), "surrogate")
    return one.join(made, (F.col("as") == F.col("m_kind")) & (F.col("name") == F.col("m_name"))).select("kind", "name", "n", "surrogate")


def pseudonymise(docs: DataFrame, secret: str = "quire", text: str = "text", key: str = "doc_id") -> DataFrame:
    """op5: (key, text with surrogates, n_entities) of every row."""
    marked = materialize(docs.select(F.col(key).alias("id"), F.col(text).alias("body"), F.xxhash64(text).alias("h"), F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0)).alias("found")))
    plain, hits = marked.where(F.coalesce(F.size("found"), F.lit(0)) < 1), marked.where(F.size("found") > 0)
    entities = hits.select("id", "h", "found").dropDuplicates(["id", "h"]).select("id", "h", F.posexplode("found").alias("at", "entity")).withColumn("kind", kind_of(F.col("entity")))
    pieces = materialize(entities.select("id", "h", "at", F.posexplode(parts(F.col("entity"), F.col("kind"))).alias("p", "part")).select("id", "h", "at", "p", "part.*"))
    table = materialize(settled_names(pieces.groupBy("kind", "name").agg(F.count("*").alias("n")), secret).select(F.col("kind").alias("k"), F.col("name").alias("c"), "n", "surrogate"))
    named = keyed_join(pieces, table, (F.col("kind") == F.col("k")) & (F.col("name") == F.col("c")), "n")
    new = F.concat("lead", shown(F.col("piece"), F.col("kind"), F.col("surrogate")))
    lists = named.groupBy("id", "h").agg(F.array_sort(F.collect_list(F.struct("at", "p", new.alias("s")))).alias("new")).withColumnsRenamed({"id": "l_id", "h": "l_h"})
    joined = hits.join(lists, F.col("id").eqNullSafe(F.col("l_id")) & (F.col("h") == F.col("l_h"))).withColumn("between", F.split("body", PATTERN, -1))
    mixed = F.transform("new", lambda x: F.concat(F.when(x["p"] == 0, F.get("between", x["at"])).otherwise(""), x["s"]))
    whole = F.concat(F.array_join(mixed, ""), F.element_at("between", -1))
    out = plain.select(F.col("id").alias(key), F.col("body").alias(text), F.lit(0).cast("long").alias("n_entities"))
    return out.union(joined.select("id", whole, F.size("found").cast("long")))


__all__ = ["GIVEN", "KINDS", "TITLES", "dictionary", "parts", "pseudonymise", "shown", "surrogate"]
