"""Surrogates for personal data, as DataFrame expressions.

Mail and network addresses, phone, card, account and social security numbers,
dates of birth, secrets, passwords and names after a form of address are found
by one pattern; a name so found is replaced in all of its document, also where
it stands alone later. Every distinct entity has one keyed replacement for the
whole corpus, so mentions of the same thing stay mentions of the same thing: a
phone number with and without its country code is one, a family's name is one
for its men and women, and a first name has the gender that most of its forms
of address give it. A replacement is of the entity's type: names keep gender,
case and script, addresses their punctuation and length, numbers their
punctuation, length, and whether their check digit holds. Replacements are
checked against each other and against all entities of the corpus; those that
collide are drawn again, longer if need be, until none does.

The entities found are a small table that is joined by key, keys with very many
mentions by broadcast; only documents with entities are taken apart and put
together again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, let, spread_join, stage

#: Forms of address by gender.
MALE = ("Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "Господин")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Sra", "Doña", "Госпожа")
NEUTRAL = ("Dr", "Prof", "Professor", "Doktor", "Docteur", "Доктор", "Профессор", "[Mm]y name is", "[Ii]ch heiße", "[Jj]e m['’]appelle", "[Mm]e llamo", "[Мм]еня зовут")
#: Syllables of made-up names by script, and how first names end by gender.
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ka ke la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se".split(),
    "cyrillic": "ба бе бо да де до фа фе га го ка ке ла ле ли ло ма ме ми мо на не ни но па пе ра ре ри ро са се".split(),
    "greek": "βα βε βο γα γε γο δα δε δο θα κα κε κο λα λε λι λο μα με μι μο να νε νι νο πα πε ρα ρι ρο σα τα".split(),
    "armenian": "բա բե բո գա գե գո դա դե դո կա կե կո լա լե լի լո մա մե մի մո նա նե նի նո պա պե ռա ռի ռո սա տա վա".split(),
    "georgian": "ბა ბე ბო გა გე გო და დე დო კა კე კო ლა ლე ლი ლო მა მე მი მო ნა ნე ნი ნო პა პე რა რი რო სა ტა ვა".split(),
}
ENDINGS = {"latin": {"m": "rd", "f": "ssa", "": "th"}, "cyrillic": {"m": "рд", "f": "сса", "": "т"}, "greek": {"m": "ρης", "f": "σσα", "": "θι"}, "armenian": {"m": "րդ", "f": "ուշ", "": "թ"}, "georgian": {"m": "რდ", "f": "სსა", "": "თ"}}
LASTS = {"latin": "n", "cyrillic": "нов", "greek": "ν", "armenian": "ն", "georgian": "ნ"}
#: Endings of Slavic family names of women; these names are one with the men's.
WOMAN = r"(?:(?<=ов|ев|ёв|ин|ын)а|(?<=ск|цк)ая)$"
POSSESSIVE = r"['’]s$"
#: Rounds of drawing after which a name has one more syllable, and syllables added at most; rounds after which a number gets longer.
LONGER, MORE, SHORT = 3, 16, 12

# Repeated groups are possessive: Java matches others by recursion, which a long text would overflow.
_TITLE = r"(?:" + "|".join(MALE + FEMALE + NEUTRAL) + r")\.?[ \t](?:(?:Dr|Prof)\.?[ \t])*+"
_PERSON = r"(?<![\p{L}])" + _TITLE + r"\p{Lu}[\p{L}'’-]++(?:[ \t]\p{Lu}[\p{L}'’-]++)?"
_NAMED = f"^({_TITLE})" + r"(\S+)(?:([ \t])(\S+))?$"
#: What a password or a date of birth follows.
_KEYWORD = r"(?<![\p{L}\p{N}])(?i:(?:password|passwd|passphrase|pwd|api[_-]?key|secret[_-]?key|access[_-]?token|passport(?:[ _-]?(?:no|number))?\.?)[\"']?\s{0,3}[:=]\s{0,3}[\"']?)"
_CREDENTIAL = _KEYWORD + r"[^\s\"',;<>]{6,}+"
_BIRTH = r"(?<![\p{L}\p{N}])(?i:(?:born(?: on)?|date of birth|birth ?date|dob|geboren(?: am)?|née? le|nacid[oa] el)\s{0,2}:?\s{1,3})"
_BORN = _BIRTH + r"(?:\d{4}[./-]\d{1,2}[./-]\d{1,2}|\d{1,2}[./-]\d{1,2}[./-]\d{2,4})(?!\d)"
_IP6 = r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]{0,38}\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])"
_EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}_%+-][\p{L}\p{N}._%+-]*+@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++"
_HEX = r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,}+)(?![0-9A-Za-z])"
_IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"
_IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)"
_SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
_CARD = r"(?<!\d)(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{13,19})(?!\d)"
_PHONE = r"(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<!\d)\+\d{8,15}(?!\d)"
#: In the order in which they are tried.
KINDS = (("email", _EMAIL), ("credential", _CREDENTIAL), ("secret", _HEX), ("iban", _IBAN), ("ip6", _IP6), ("ip", _IP), ("born", _BORN), ("ssn", _SSN), ("card", _CARD), ("phone", _PHONE), ("person", _PERSON))
PATTERN = "|".join(f"(?:{p})" for _, p in KINDS)
#: What a text needs to hold any entity; cheap to search.
HINT = r"[@0-9]|(?<!\p{L})(?:" + "|".join(MALE + FEMALE + NEUTRAL) + r")\.?[ \t]\p{Lu}|[0-9A-Fa-f]{32}|(?i:passw|passphrase|pwd|api.?key|secret.?key|access.?token|passport)"

_PART = "struct<kind:string,raw:string,canon:string>"


def _kind(raw: Column) -> Column:
    out = F.lit("person")
    for name, p in reversed(KINDS[:-1]):
        out = F.when(raw.rlike(f"^(?:{p})$"), F.lit(name)).otherwise(out)
    return out


def _parts(raw: Column) -> Column:
    """The parts of a match: one entity, or a form of address to keep, a first and a last name."""
    kind = _kind(raw)
    digits = F.regexp_replace(raw, r"\D", "")
    # A country code of up to three digits before the ten of a number is no part of it.
    phone = F.when(F.length(digits).between(11, 13), F.substring(digits, -10, 10)).otherwise(digits)
    canon = F.when(kind.isin("ip", "secret"), raw).when(kind.isin("email", "ip6"), F.lower(raw)).when(kind == "iban", F.replace(raw, F.lit(" "))).when(kind == "phone", phone).otherwise(digits)
    part = lambda k, r, c: F.struct(k.alias("kind"), r.alias("raw"), c.alias("canon"))
    keep = lambda x: part(F.lit("keep"), x, F.lit(None).cast("string"))
    after = lambda k, head, new: let(F.regexp_extract(raw, head, 0), lambda x: let(F.substr(raw, F.length(x) + 1), lambda v: F.array(keep(x), part(F.lit(new), v, v))))
    at = lambda i: F.regexp_extract(raw, _NAMED, i)
    head, one, gap, two = at(1), at(2), at(3), at(4)
    title = F.regexp_extract(head, r"^[^.\s]+", 0)
    gender = F.when(title.isin(*MALE), "m").when(title.isin(*FEMALE), "f").otherwise("")
    others = [k for k in SYLLABLES if k != "latin"]
    script = lambda x: F.coalesce(*[F.when(x.rlike(rf"\p{{Is{k.capitalize()}}}"), k) for k in others], F.lit("latin"))
    last = lambda x: part(F.concat_ws(":", F.lit("last"), script(x)), x, family(x))
    first = part(F.concat_ws(":", F.lit("first"), script(one), gender), one, F.regexp_replace(F.lower(one), POSSESSIVE, ""))
    named = F.when(two == "", F.array(keep(head), last(one))).otherwise(F.array(keep(head), first, keep(gap), last(two)))
    parts = F.when(kind == "person", named).when(kind == "credential", after(kind, _KEYWORD, "password")).when(kind == "born", after(kind, _BIRTH, "born"))
    return parts.otherwise(F.array(part(kind, raw, canon))).cast(f"array<{_PART}>")


def family(name: Column) -> Column:
    """What a family's names have in common."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), POSSESSIVE, ""), WOMAN, "")


def _luhn(digits: Column) -> Column:
    """The check digit that follows a string of digits."""
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: (F.substring(digits, i, 1).cast("int") * F.when((n - i) % 2 == 0, 2).otherwise(1)))
    total = F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x))
    return (10 - total % 10) % 10


def surrogate(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The replacement of an entity in its canonical form: a function of the key, the entity and the attempt."""
    first = F.sha2(F.concat_ws("|", F.lit(key), kind, canon, attempt.cast("string")), 256)
    return let(first, lambda h: let(F.concat(h, F.sha2(F.concat(h, F.lit("+")), 256)), lambda more: _drawn(kind, canon, attempt, key, h, more)))


def _drawn(kind: Column, canon: Column, attempt: Column, key: str, h: Column, more: Column) -> Column:
    """A replacement from 64 and 128 random hex digits."""
    digits = F.translate(more, "abcdef", "274859")
    n = F.length(canon)
    byte = lambda i, m, low: (F.conv(F.substring(h, i, 4), 16, 10).cast("int") % m + low).cast("string")
    ip = F.concat_ws(".", byte(1, 223, 1), byte(9, 256, 0), byte(17, 256, 0), byte(25, 254, 1))
    # Documentation addresses, of which there are enough for what an IPv4 address can't be drawn for.
    ip = F.when(attempt < SHORT, ip).otherwise(F.concat(F.lit("2001:db8"), *[F.concat(F.lit(":"), F.substring(more, 4 * i + 1, 4)) for i in range(6)]))
    longer = F.greatest(F.lit(0), F.floor((attempt - SHORT) / LONGER)).cast("int")
    n = n + longer
    known = F.length(canon)
    body = F.concat(F.substring(canon, 1, 1), F.substring(digits, F.lit(1), n - 2))
    held = (F.substring(canon, -1, 1).cast("int") - _luhn(F.substring(canon, F.lit(1), known - 1)) + 10) % 10
    card = let(body, lambda b: F.concat(b, ((_luhn(b) + held) % 10).cast("string")))
    phone = F.concat((F.substring(digits, 1, 1).cast("int") % 8 + 2).cast("string"), F.substring(digits, F.lit(2), n - 1))
    ssn = F.concat(F.lit("9"), F.substring(digits, F.lit(1), n - 1))
    # A date in the mention's order: a year of four digits from 1900 on, later ones the more often it was drawn, or one of two; a month; a day that all months have.
    number = lambda i, m: F.conv(F.substring(h, i, 6), 16, 10).cast("int") % m
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    year = F.when(canon.rlike(r"^\d{1,2}\D\d{1,2}\D\d{2}$") & (attempt < SHORT), two(number(1, 100))).otherwise((number(1, 120 + 60 * attempt) + 1900).cast("string"))
    day, month, mark = two(number(8, 28) + 1), two(number(15, 12) + 1), F.regexp_extract(canon, r"\D", 0)
    born = F.when(canon.rlike(r"^\d{4}"), F.concat(year, mark, month, mark, day)).otherwise(F.concat(day, mark, month, mark, year))
    # Secrets and accounts: each character one of its own class.
    chars = F.split(canon, "")
    is_hex = canon.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
    head = F.when(kind == "iban", 2).when(canon.rlike("^AKIA"), 4).when(canon.rlike("^gh[pousr]_"), 4).when(canon.rlike("^sk-"), 3).otherwise(0)
    of = F.struct(head.alias("head"), is_hex.alias("hex"), (is_hex & canon.rlike("[A-F]")).alias("upper"))  # looked at once, not for each character

    def masked_by(k):
        def of_class(c, i):
            x = F.substring(more, F.pmod(i, F.lit(128)) + 1, 1)
            return (
                F.when(i < k["head"], c).when(k["upper"], F.upper(x)).when(k["hex"] | (kind == "ip6") & c.rlike("[0-9a-f]"), x)
                .when(c.rlike(r"\d"), F.translate(x, "abcdef", "274859"))
                .when(c.rlike("[A-Z]"), F.translate(x, "0123456789abcdef", "GHJKLMNPQRSTUVWX"))
                .when(c.rlike(r"\p{L}"), F.translate(x, "0123456789abcdef", "ghjkmnpqrstuvwxy"))
                .otherwise(c)
            )

        return F.array_join(F.transform(chars, of_class), "")

    added = F.substring(F.translate(more, "0123456789", "ghjkmnpqrs"), F.lit(64), longer)
    masked = F.concat(let(of, masked_by), F.when(kind == "ip6", "").otherwise(added))
    # Of a mail address the name part by the address, the rest by the domain; it ends in a name that is no one's.
    of_domain = F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), F.substring_index(canon, "@", -1)), 256)
    letter = lambda x, c, i: F.when(c.rlike(r"[\p{L}\p{N}]"), F.translate(F.substring(x, F.pmod(i, F.length(x)) + 1, 1), "0123456789abcdef", "aeiouklmnprstvbd")).otherwise(c)
    spelt = lambda text, x: F.array_join(F.transform(F.split(text, ""), lambda c, i: letter(x, c, i)), "")
    local = F.concat(spelt(F.substring_index(canon, "@", 1), more), F.substring(F.translate(more, "0123456789", "aeiouklmnp"), F.lit(64), F.floor(attempt / LONGER).cast("int")))
    email = F.concat(local, F.lit("@"), let(of_domain, lambda x: spelt(F.regexp_replace(F.substring_index(canon, "@", -1), r"\.[^.]*$", ""), x)), F.lit(".example"))
    script, gender, is_last = F.get(F.split(kind, ":"), F.lit(1)), F.get(F.split(kind, ":"), F.lit(2)), kind.startswith("last")
    by_script = lambda value: F.coalesce(*[F.when(script == k, value(k)) for k in SYLLABLES])
    chosen = by_script(lambda k: F.array(*[F.lit(s) for s in SYLLABLES[k]]))
    at = F.concat(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: i * 8 + F.when(is_last, 33).otherwise(1)), F.slice(F.array(*[F.lit(61 + 4 * j) for j in range(1, MORE + 1)]), F.lit(1), F.least(F.floor(attempt / LONGER).cast("int"), F.lit(MORE))))
    pick = lambda syl: F.transform(at, lambda i: F.element_at(syl, (F.conv(F.substring(more, i, 4), 16, 10).cast("int") % F.size(syl) + 1).cast("int")))
    stem = F.initcap(F.array_join(let(chosen, pick), ""))
    end = by_script(lambda k: F.when(is_last, LASTS[k]).otherwise(F.coalesce(*[F.when(gender == g, e) for g, e in ENDINGS[k].items()])))
    names = F.when(kind.rlike("^(first|last):"), F.concat(stem, end))
    return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", phone).when(kind == "ssn", ssn).when(kind == "born", born).when(kind.isin("secret", "iban", "ip6", "password"), masked).otherwise(names)


def dictionary(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, surrogate) for the distinct (kind, canon) of entities.

    No two entities of a kind share a replacement and none is an entity of the
    corpus. Those that would are drawn again; only they change in a round.
    Replacements get longer with the rounds, so none runs out.
    """
    known = stage(entities.select("kind", "canon").distinct())
    group = lambda c: F.substring_index(c, ":", 1)
    drawn = stage(known.withColumn("attempt", F.lit(0)).withColumn("surrogate", surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), key)))
    real = known.select(group(F.col("kind")).alias("g"), F.col("canon").alias("s")).distinct().withColumn("real", F.lit(True))
    while True:
        at = drawn.withColumn("g", group(F.col("kind"))).withColumn("s", F.when(F.col("kind").rlike("^(first|last)"), F.lower("surrogate")).otherwise(F.col("surrogate")))
        nth = F.row_number().over(Window.partitionBy("g", "s").orderBy("attempt", "kind", "canon"))
        marked = stage(at.withColumn("nth", nth).join(real, ["g", "s"], "left").withColumn("bad", (F.col("nth") > 1) | F.col("real").isNotNull()).select("kind", "canon", "attempt", "surrogate", "bad"))
        discard(drawn)
        if not marked.where("bad").limit(1).count():
            return marked.select("kind", "canon", "surrogate")
        again = F.col("attempt") + F.col("bad").cast("int")
        drawn = stage(marked.select("kind", "canon", again.alias("attempt"), F.when(F.col("bad"), surrogate(F.col("kind"), F.col("canon"), again, key)).otherwise(F.col("surrogate")).alias("surrogate")))
        discard(marked)


def _in_format(kind: Column, raw: Column, new: Column) -> Column:
    """A replacement with the punctuation of the mention; addresses keep its case, names its case and endings."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("i"))

    def step(digits):
        def one(acc, c):
            take = c.rlike("[0-9A-Za-z]")
            return F.struct(F.concat(acc["out"], F.when(take, F.coalesce(F.get(digits, acc["i"]), c)).otherwise(c)).alias("out"), (acc["i"] + take.cast("int")).alias("i"))

        return one

    def dressed(digits):
        made = F.aggregate(F.split(raw, ""), start, step(digits))
        return let(made, lambda x: F.concat(x["out"], F.array_join(F.slice(digits, x["i"] + 1, F.greatest(F.lit(0), F.size(digits) - x["i"])), "")))

    code = F.regexp_replace(raw, r"\D", "")
    whole = F.when((kind == "phone") & F.length(code).between(11, 13), F.concat(F.substr(code, F.lit(1), F.length(code) - 10), new)).otherwise(new)
    cased = lambda old: F.array_join(F.transform(F.split(new, ""), lambda c, i: F.when(F.coalesce(F.get(old, i), F.lit("")).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c)), "")
    by_case = let(F.split(raw, ""), cased)
    return F.when(kind.isin("card", "phone", "ssn", "iban"), let(F.split(whole, ""), dressed)).when(kind.isin("email", "ip6"), by_case).when(kind.rlike("^(first|last)"), _name(raw, new)).otherwise(new)


def _name(raw: Column, new: Column) -> Column:
    """A name in the case and with the ending of the mention."""
    ended = F.when(F.regexp_replace(F.lower(raw), POSSESSIVE, "").rlike(WOMAN) & new.rlike(r"\p{IsCyrillic}$"), F.concat(new, F.lit("а"))).otherwise(new)
    owned = F.concat(ended, F.regexp_extract(raw, POSSESSIVE, 0))
    return F.when((F.upper(raw) == raw) & (F.length(raw) > 1), F.upper(owned)).otherwise(owned)


def _later(piece: Column, names: Column) -> Column:
    """(text, n): a text with the names that stand in it replaced, and how many. names: replacements by family()."""
    key = lambda w: F.when(w.rlike(r"^\p{Lu}"), family(w))
    plain = lambda w: F.when(w.rlike(r"^\p{Lu}"), F.regexp_replace(F.lower(w), POSSESSIVE, ""))
    found = lambda w: F.coalesce(F.try_element_at(names, plain(w)), F.try_element_at(names, key(w)))
    words = F.regexp_extract_all(piece, F.lit(r"[\p{L}'’-]+|[^\p{L}'’-]+"), F.lit(0))

    def swapped(ws):
        each = F.transform(ws, lambda w: let(found(w), lambda x: F.struct(F.when(x.isNull(), w).otherwise(_name(w, x)).alias("w"), x.isNotNull().cast("int").alias("n"))))
        return let(each, lambda xs: F.struct(F.array_join(xs["w"], "").alias("text"), F.aggregate(xs["n"], F.lit(0), lambda a, n: a + n).alias("n")))

    return let(words, swapped)


def replaced(docs: DataFrame, key: str = "surrogates", doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, text with replacements, n_entities long, kinds array<string>.

    A null text stays null, an empty one empty, both without entities; very
    long texts are searched whole. Rows with equal ids or texts are replaced
    alike and each have their row; an empty table has none. Other columns
    aren't read, so none can clash.
    """
    slim = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    may = F.coalesce(F.col("text").rlike(HINT), F.lit(False))
    found = slim.where(may).withColumn("found", F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)))
    # Numbered as the table is written; rows where the hint was wrong have no entity.
    taken = stage(
        found.select("doc_id", F.when(F.size("found") > 0, F.split("text", PATTERN, -1)).otherwise(F.array("text")).alias("pieces"), F.transform("found", _parts).alias("parts"))
        .withColumn("row", F.monotonically_increasing_id())
    )
    mentions = taken.select("row", F.posexplode("parts").alias("pos", "p")).select("row", "pos", F.posexplode("p").alias("sub", "x")).select("row", "pos", "sub", "x.*")
    mine = stage(mentions.where("kind <> 'keep'").withColumn("g", F.substring_index("kind", ":", 1)))
    # An entity's kind: that of most mentions, those that tell a gender before others.
    kinds = mine.groupBy("g", "canon", "kind").agg(F.count(F.lit(1)).alias("n"))
    kinds = kinds.groupBy("g", "canon").agg(F.max(F.struct((~F.col("kind").endswith(":")).alias("told"), "n", "kind"))["kind"].alias("kind"))
    words = dictionary(kinds, key).select(F.substring_index("kind", ":", 1).alias("g"), "canon", "surrogate")
    known = stage(spread_join(mine, words, ["g", "canon"]).select("row", "pos", "sub", "kind", "canon", "surrogate", _in_format(F.col("kind"), F.col("raw"), F.col("surrogate")).alias("new")))
    kept = mentions.where("kind = 'keep'").select("row", "pos", "sub", "kind", F.col("raw").alias("new"))
    each = known.select("row", "pos", "sub", "kind", "new").unionByName(kept).groupBy("row", "pos").agg(F.array_sort(F.collect_list(F.struct("sub", "new"))).alias("n"), F.max(F.when(F.col("kind") != "keep", F.substring_index("kind", ":", 1))).alias("kind"))
    per_row = each.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", F.array_join("n.new", "").alias("new")))).alias("new"), F.array_sort(F.collect_set("kind")).alias("kinds"))
    names = known.where("kind LIKE 'first:%' OR kind LIKE 'last:%'").groupBy("row", "canon").agg(F.max(F.struct(F.col("kind").startswith("last").alias("last"), "surrogate"))["surrogate"].alias("surrogate"))
    names = names.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("canon", "surrogate"))).alias("names"))
    rows = taken.where(F.size("parts") > 0).join(per_row, "row").join(names, "row", "left")
    plain = F.struct(F.lit(None).cast("string").alias("text"), F.lit(0).alias("n"))
    pieces = F.transform("pieces", lambda x: F.when(F.col("names").isNull(), plain.withField("text", x)).otherwise(_later(x, F.col("names"))))
    rows = rows.select("doc_id", "kinds", "parts", F.col("new.new").alias("new"), pieces.alias("pieces"))
    whole = F.array_join(F.zip_with("pieces.text", "new", lambda a, n: F.concat(a, F.coalesce(n, F.lit("")))), "")
    more = F.aggregate("pieces.n", F.lit(0), lambda a, n: a + n)
    with_some = rows.select("doc_id", whole.alias("text"), (F.size("parts") + more).cast("long").alias("n_entities"), "kinds")
    none = F.array().cast("array<string>").alias("kinds")
    without = taken.where(F.size("parts") == 0).select("doc_id", F.element_at("pieces", 1).alias("text"), F.lit(0).cast("long").alias("n_entities"), none)
    rest = slim.where(~may).select("doc_id", "text", F.lit(0).cast("long").alias("n_entities"), none)
    return reduce(DataFrame.unionByName, (with_some, without, rest))
