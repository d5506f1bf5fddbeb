"""Personal data and secrets replaced by keyed surrogates of the same kind; DataFrame functions only.

Mentions are found by one pattern.  What a mention refers to is its *canonical* form (an address in lower case, a
number's digits, each part of a name), so that differently written mentions of one entity get one surrogate.  A
surrogate is drawn by a keyed hash of kind, canonical form and attempt, in the entity's own format: digits for
digits, letters for letters, check digits made right, given names of the same gender, names in the same script.
The distinct entities of the whole table are checked: no two of a kind share a surrogate and none gets one that is
another's real value; those that would are drawn again, after some attempts from a wider format.  What holds no letter or digit to
replace (a masked secret) is no entity and stays as written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checked_broadcast, settle
from .common import fresh, quoted

KEY = "surrogates"
#: Attempts after which a secret or an address may be replaced by a longer one.
NARROW = 6

# How entities are written, titles that tell a gender, and names to draw from.
_SECRET = r"(?:(?<!\w)(?:AKIA[A-Z0-9]{16}|ghp_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})(?!\w)|(?<!\w)(?i:password|passwd|pwd|secret|api_key|apikey|token)\s?[=:]\s?[\"']?[^\s\"']{6,})"
_SECRET_LEAD = r"^(?:AKIA|ghp_|sk-|(?i:password|passwd|pwd|secret|api_key|apikey|token)\s?[=:]\s?[\"']?)"
_EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-][A-Za-z0-9.\-]*\.[A-Za-z]{2,}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IP = rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)"
_IBAN = r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"
_SSN = r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])"
_PHONE = r"(?<![\w+])(?:\+\d{1,3}(?:[ .\-]?(?:\(\d{1,4}\)|\d{2,4})){2,5}|(?:\(\d{3}\) ?|\d{3}[.\-])\d{3}[ .\-]\d{4})(?!\w)"
_CARD = r"(?<![\w+])\d(?:[ \-]?\d){12,18}(?!\w)"
_MALE = r"(?:Mr\.?|Herr|Monsieur|Señor|Sr\.|господин|г-н)"
_FEMALE = r"(?:Mrs\.?|Ms\.?|Miss|Frau|Madame|Mme|Señora|Sra\.|госпожа|г-жа)"
_NAME = rf"(?<!\w)(?:{_MALE}|{_FEMALE})(?: \p{{Lu}}[\p{{L}}\-']+){{1,3}}"
_KINDS = [("secret", _SECRET), ("email", _EMAIL), ("iban", _IBAN), ("ip", _IP), ("ssn", _SSN), ("phone", _PHONE), ("card", _CARD), ("name", _NAME)]
ANY = "|".join(f"(?:{rx})" for _, rx in _KINDS)
#: Every mention holds a digit, an @ or one of these words, which is quick to see.
_HINT = rf"[0-9@]|(?i:password|passwd|pwd|secret|api_key|apikey|token)|ghp_|sk-|AKIA|{_MALE} |{_FEMALE} "
_GIVEN_MALE = ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leo", "Martin", "Noah", "Oscar", "Paul"]
_GIVEN_FEMALE = ["Alice", "Bella", "Clara", "Diana", "Emma", "Flora", "Greta", "Helen", "Irene", "Julia", "Karin", "Laura", "Maria", "Nora", "Olga", "Paula"]
_GIVEN_MALE_CYRILLIC = ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Максим", "Олег", "Павел", "Роман", "Семён", "Тимур", "Фёдор"]
_GIVEN_FEMALE_CYRILLIC = ["Алла", "Белла", "Вера", "Галина", "Дарья", "Елена", "Зоя", "Ирина", "Клара", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Раиса", "Софья"]
# Letters to draw from for letters beyond ASCII, by script and case; letters of other scripts, and all that no case fits, become plain ones.
_SCRIPTS = [(r"[\p{IsCyrillic}&&\p{Lu}]", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"), (r"\p{IsCyrillic}", "абвгдежзиклмнопрстуфхцчшэюя"), (r"[\p{IsGreek}&&\p{Lu}]", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"),
            (r"\p{IsGreek}", "αβγδεζηθικλμνξοπρστυφχψω"), (r"\p{IsHan}", "山川水火木金土日月人口中大小上下左右田石"), (r"\p{IsHiragana}", "あいうえおかきくけこさしすせそたちつてと"), (r"\p{IsKatakana}", "アイウエオカキクケコサシスセソタチツテト"),
            (r"\p{IsHangul}", "가나다라마바사아자차카타파하고노도로모보"), (r"\p{IsArabic}", "ابتثجحخدذرزسشصضطعغفقكلمنهوي"), (r"\p{IsHebrew}", "אבגדהוזחטיכלמנסעפצקרשת"), (r"\p{Lu}", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
            (r"\p{L}", "abcdefghijklmnopqrstuvwxyz"), (r"\p{N}", "0123456789")]
_SYLLABLES = ["ba", "co", "du", "fe", "gi", "ha", "ko", "lu", "ma", "ne", "po", "ri", "sa", "to", "vi", "ze"]
_SYLLABLES_CYRILLIC = ["ба", "во", "гу", "де", "жи", "за", "ко", "лу", "ма", "не", "по", "ри", "са", "то", "фи", "хо"]


def _anchored(rx: str) -> str:
    return f"^(?:{rx})$"


def mentions(text: Column) -> Column:
    """All mentions in a text, in order."""
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _chars(text: Column) -> Column:
    return F.split(text, "")


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """Sum of a number's digits, every second one doubled, counted from the right; ``doubled`` 1: from the second on."""
    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == doubled, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def _mod97(text: Column) -> Column:
    """Remainder of a number in which a letter stands for 10 to 35."""
    def add(acc: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (acc * 10 + c.cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97).cast("int")

    return F.aggregate(_chars(text), F.lit(0), add)


def kind_of(mention: Column) -> Column:
    """The kind of a mention; null where a check digit shows that it is none."""
    out = F.lit(None).cast("string")
    for kind, rx in reversed(_KINDS):
        good = mention.rlike(_anchored(rx))
        if kind == "card":
            good = good & (_luhn_sum(_digits(mention), 1) % 10 == 0)
        if kind == "iban":
            plain = F.replace(mention, F.lit(" "), F.lit(""))
            good = good & (_mod97(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))) == 1)
        out = F.when(good, F.lit(kind)).otherwise(out)
    return out


def _name_parts(mention: Column) -> Column:
    """(kind, canon) of the names after the title."""
    words = F.split(mention, " ")
    sex = F.when(words[0].rlike(_anchored(_MALE)), "male").otherwise("female")
    last = F.size(words) - 1

    def part(word: Column, i: Column) -> Column:
        script = F.when(word.rlike(r"\p{IsCyrillic}"), "_cyrillic").otherwise("")
        family = F.when(script == "", "family").otherwise(F.concat(F.lit("family_"), sex, script))
        return F.struct(F.when(i == last - 1, family).otherwise(F.concat(F.lit("given_"), sex, script)).alias("kind"), F.lower(word).alias("canon"))

    return F.transform(F.slice(words, 2, 10), part)


def _parts(mention: Column, kind: Column) -> Column:
    """The entities of a mention of that kind as an array of (kind, canon): one, or one for each part of a name."""
    canon = (F.when(kind == "email", F.lower(mention)).when(kind.isin("phone", "card", "ssn"), _digits(mention))
             .when(kind == "iban", F.replace(mention, F.lit(" "), F.lit(""))).otherwise(mention))
    none = F.array().cast("array<struct<kind:string,canon:string>>")
    free = F.when(kind == "secret", F.regexp_replace(mention, _SECRET_LEAD, "")).when(kind == "email", F.regexp_replace(mention, r"\.[^.]*$", "")).otherwise(mention)
    return (F.when(kind == "name", _name_parts(mention)).when(kind.isNull() | ~free.rlike(r"[\p{L}\p{N}]"), none)
            .otherwise(F.array(F.struct(kind.alias("kind"), canon.alias("canon")))))


def analysed(found: Column) -> Column:
    """Mentions as (m, p): the mention and its entities, none where a check digit fails.

    Each step is a transform of its own, so that a kind is found once however often it is asked for.
    """
    kinds = F.transform(found, lambda m: F.struct(m.alias("m"), kind_of(m).alias("k")))
    return F.transform(kinds, lambda x: F.struct(x["m"].alias("m"), _parts(x["m"], x["k"]).alias("p")))


def _draw(hexes: Column, i: Column) -> Column:
    """The i-th number 0 to 255 of an entity's keyed stream (i from 0), an array of hexadecimal digits."""
    return F.conv(F.concat(F.get(hexes, i * 2), F.get(hexes, i * 2 + 1)), 16, 10).cast("int")


def _pick(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), n % len(values) + 1)


def _moved(c: Column, n: Column) -> Column:
    """A letter or digit of the same script and case; other characters stay."""
    out = (F.when(c.rlike("[0-9]"), (n % 10).cast("string")).when(c.rlike("[a-z]"), F.chr(n % 26 + 97)).when(c.rlike("[A-Z]"), F.chr(n % 26 + 65)))
    for rx, letters in _SCRIPTS:
        out = out.when(c.rlike(rx), F.substring(F.lit(letters), n % len(letters) + 1, F.lit(1)))
    return out.otherwise(c)


def _like(canon: Column, hexes: Column, kept: Column, until: Column, hexadecimal: Column) -> Column:
    """Letters for letters and digits for digits; characters up to ``kept`` and after ``until`` stay."""
    bounds = F.struct(kept.alias("kept"), until.alias("until"), hexadecimal.alias("hexadecimal"))
    return _let(bounds, lambda b: F.array_join(F.transform(_chars(canon), lambda c, i: _within(c, i, hexes, b)), ""))


def _within(c: Column, i: Column, hexes: Column, bounds: Column) -> Column:
    n = _draw(hexes, i)
    return (F.when((i < bounds["kept"]) | (i >= bounds["until"]), c)
            .when(bounds["hexadecimal"] & c.rlike("[0-9a-f]"), F.substring(F.lit("0123456789abcdef"), n % 16 + 1, F.lit(1))).otherwise(_moved(c, n)))


def _names(values: list[str], hexes: Column, count: Column, between: str) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(0), count - 1), lambda i: _pick(values, _draw(hexes, i))), between)


def surrogate(kind: Column, canon: Column, attempt: Column, key: str = KEY) -> Column:
    """What an entity becomes at an attempt; later attempts draw from more: longer names, and longer secrets and addresses where a format is so narrow that its values run out."""
    own = F.sha2(F.concat_ws("|", F.lit(key), kind, attempt, canon), 256)  # the text itself is hashed once, however long it is
    stream = _let(own, lambda o: F.flatten(F.transform(F.sequence(F.lit(0), (F.length(canon) / 60).cast("int")), lambda b: F.split(F.sha2(F.concat_ws("|", F.lit(key), b, o), 512), ""))))
    return _let(stream, lambda hexes: _drawn(kind, canon, attempt, hexes))


def _drawn(kind: Column, canon: Column, attempt: Column, hexes: Column) -> Column:
    size, no, zero = F.length(canon), F.lit(False), F.lit(0)
    email = _like(canon, hexes, zero, size - F.length(F.substring_index(canon, ".", -1)) - 1, no)
    prefix = F.length(F.regexp_extract(canon, _SECRET_LEAD, 0))
    secret = _like(canon, hexes, prefix, size, F.substring(canon, prefix + 1, size).rlike("^[0-9a-f]+$"))
    random = _like(canon, hexes, zero, size, no)
    lead = F.greatest(size - 10, zero)  # a country code stays, area and exchange begin with 2 to 9
    phone = F.array_join(F.transform(_chars(canon), lambda c, i: F.when(i < lead, c)
                                     .when((size > 9) & ((i == lead) | (i == lead + 3)), (_draw(hexes, i) % 8 + 2).cast("string"))
                                     .otherwise((_draw(hexes, i) % 10).cast("string"))), "")
    body = F.concat(F.substring(canon, 1, 1), F.substring(random, F.lit(2), size - 2))
    card = F.concat(body, ((10 - _luhn_sum(body, 0) % 10) % 10).cast("string"))
    account = F.substring(random, F.lit(5), size)
    country = F.substring(canon, 1, 2)
    iban = F.concat(country, F.lpad((98 - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0"), account)
    ip = F.concat_ws(".", (_draw(hexes, zero) % 223 + 1).cast("string"), _draw(hexes, F.lit(1)).cast("string"), _draw(hexes, F.lit(2)).cast("string"), _draw(hexes, F.lit(3)).cast("string"))
    wider = F.when(attempt < NARROW, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(0), attempt - NARROW), lambda i: F.chr(_draw(hexes, i) % 26 + 97)), ""))
    some, more = (attempt / 3 + 1).cast("int"), (attempt / 3 + 3).cast("int")
    return (F.when(kind == "email", F.concat(wider, email)).when(kind == "secret", F.concat(secret, wider)).when(kind == "phone", phone).when(kind == "card", card)
            .when(kind == "ip", ip).when(kind == "iban", iban)
            .when(kind == "given_male", F.lower(_names(_GIVEN_MALE, hexes, some, "-")))
            .when(kind == "given_female", F.lower(_names(_GIVEN_FEMALE, hexes, some, "-")))
            .when(kind == "given_male_cyrillic", F.lower(_names(_GIVEN_MALE_CYRILLIC, hexes, some, "-")))
            .when(kind == "given_female_cyrillic", F.lower(_names(_GIVEN_FEMALE_CYRILLIC, hexes, some, "-")))
            .when(kind == "family", _names(_SYLLABLES, hexes, more, ""))
            .when(kind == "family_male_cyrillic", F.concat(_names(_SYLLABLES_CYRILLIC, hexes, more, ""), F.lit("нов")))
            .when(kind == "family_female_cyrillic", F.concat(_names(_SYLLABLES_CYRILLIC, hexes, more, ""), F.lit("нова")))
            .otherwise(random))


def assign(entities: DataFrame, key: str = KEY) -> DataFrame:
    """Rows (kind, canon, stand_in) for distinct entities: stand-ins of a kind are distinct and no entity's own value."""
    entities = settle(entities.select("kind", "canon").distinct())
    done, waiting, attempt = None, entities, 0
    while True:
        drawn = settle(waiting.withColumn("stand_in", surrogate(F.col("kind"), F.col("canon"), F.lit(attempt), key)))
        first = drawn.groupBy("kind", "stand_in").agg(F.min("canon").alias("canon"))
        taken = entities.select("kind", F.col("canon").alias("stand_in"))
        if done is not None:
            taken = taken.union(done.select("kind", "stand_in"))
        good = settle(first.join(taken, ["kind", "stand_in"], "left_anti").select("kind", "canon", "stand_in"))
        done = good if done is None else done.union(good)
        waiting = settle(drawn.drop("stand_in").join(good, ["kind", "canon"], "left_anti"))
        if not waiting.head(1):
            return done
        attempt += 1


def _written_like(mention: Column, stand_in: Column, moved: str) -> Column:
    """A stand-in in a mention's layout: characters matching ``moved`` are replaced in turn, capitals stay capitals."""
    def lay_out(x: Column) -> Column:
        places = F.aggregate(x["m"], F.struct(F.array().cast("array<string>").alias("o"), F.lit(0).alias("i")), lambda acc, c: _next(acc, c, x["s"]), lambda a: a["o"])
        return F.array_join(places, "")

    def _next(acc: Column, c: Column, own: Column) -> Column:
        one = F.get(own, acc["i"])
        one = F.when(c.rlike(r"\p{Lu}"), F.upper(one)).otherwise(one)
        moves = c.rlike(moved)
        return F.struct(F.array_append(acc["o"], F.when(moves, one).otherwise(c)).alias("o"), (acc["i"] + moves.cast("int")).alias("i"))
    return _let(F.struct(_chars(mention).alias("m"), _chars(stand_in).alias("s")), lay_out)


def _rendered(mention: Column, own: Column, stand_ins: Column) -> Column:
    """A mention with its entities ``own`` replaced; ``stand_ins`` maps kind:canon to stand-in."""
    look = lambda p: stand_ins[F.concat(p["kind"], F.lit(":"), p["canon"])]
    kind, one = own[0]["kind"], look(own[0])
    word = lambda p, w: F.when(w == F.upper(w), F.upper(look(p))).otherwise(F.initcap(F.replace(look(p), F.lit("-"), F.lit("- "))))
    words = F.split(mention, " ")
    name = F.concat_ws(" ", words[0], F.array_join(F.zip_with(own, F.slice(words, 2, 10), lambda p, w: F.replace(word(p, w), F.lit("- "), F.lit("-"))), " "))
    out = (F.when(F.size(own) == 0, mention).when(kind.rlike("^(given|family)"), name)
           .when(kind.isin("phone", "card", "ssn"), _written_like(mention, one, "[0-9]"))
           .when((kind == "email") & (F.length(one) > F.length(mention)), one)
           .when(kind == "email", F.array_join(F.zip_with(_chars(mention), _chars(one), lambda c, o: F.when(c.rlike(r"\p{Lu}"), F.upper(o)).otherwise(o)), ""))
           .when(kind == "iban", _written_like(mention, one, r"\S")).otherwise(one))
    return F.coalesce(out, mention)


def with_surrogates(docs: DataFrame, text: str = "text", count: str | None = "n_entities", key: str = KEY) -> DataFrame:
    """``docs`` with every mention in ``text`` replaced; ``count`` adds the number of mentions under a free name.

    Texts without a mention, null and empty texts stay as they are (0 mentions); repeated rows are replaced alike, and
    the same entity alike in all rows; other columns pass through; an empty table gives an empty table.
    """
    body = quoted(text)
    held = body.rlike(_HINT) & body.rlike(ANY)
    number = fresh(docs, count or "n_entities")
    plain = docs.where(~F.coalesce(held, F.lit(False))).withColumn(number, F.lit(0).cast("long"))
    found, mark, table = fresh(docs, "mentions"), fresh(docs, "text_hash"), fresh(docs, "stand_ins")
    marked = docs.where(held).withColumn(found, analysed(mentions(body))).withColumn(mark, F.xxhash64(body))
    # a text's entities; equal texts once, so that a text with many copies weighs as one
    entities = settle(marked.select(F.col(mark).alias("h"), F.explode(F.array_distinct(F.flatten(F.transform(quoted(found), lambda x: x["p"])))).alias("p"))
                      .select("h", "p.kind", "p.canon").distinct())
    chosen = assign(entities, key)
    per_text = (entities.join(chosen, ["kind", "canon"]).groupBy("h")
                .agg(F.map_from_entries(F.collect_list(F.struct(F.concat("kind", F.lit(":"), "canon"), "stand_in"))).alias(table)).withColumnRenamed("h", mark + "of"))
    joined = marked.join(checked_broadcast(per_text), quoted(mark) == quoted(mark + "of"), "left")
    pieces = F.split(body, ANY, -1)
    new = F.array_join(F.zip_with(pieces, F.transform(quoted(found), lambda x: _rendered(x["m"], x["p"], quoted(table))), lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")
    changed = F.when(quoted(table).isNull(), body).otherwise(new)
    n = F.size(F.filter(quoted(found), lambda x: F.size(x["p"]) > 0)).cast("long")
    replaced = joined.select(*[(changed if c == text else quoted(c)).alias(c) for c in docs.columns], n.alias(number))
    out = plain.unionByName(replaced)
    return out if count else out.drop(number)
