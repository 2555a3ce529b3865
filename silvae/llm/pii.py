"""Surrogates for personal data and secrets, with built-in functions only.

Every entity found is replaced by a keyed surrogate of its own type and format. The surrogate is a
keyed permutation of the entity's characters within their classes: a Feistel network whose halves
shift each other, one step of each character, and the network backwards. So it is one-to-one and
leaves no entity as it was: the same entity always gets the same surrogate, different entities of a
format different ones, and no table of the corpus has to be kept. Where a permutation would leave
the set it must stay in, it is applied again until it is back. ``clashes`` checks the result.
"""

from __future__ import annotations

import hashlib
import hmac
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silvae.llm.store import free, fresh, materialize

#: Given names by gender and script. A known name is replaced by another of its list.
NAMES = {
    ("m", "latin"): "James John Robert Michael William David Richard Joseph Thomas Daniel Paul Mark Peter Hans Karl Jean Pierre Louis Carlos Juan José Miguel Luis".split(),
    ("f", "latin"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Sarah Karen Anna Emma Laura Julia Marie Claire Sophie Camille Carmen Lucía María Elena Ingrid Petra".split(),
    ("m", "cyrillic"): "Иван Пётр Алексей Дмитрий Сергей Николай Михаил Андрей Павел Борис Виктор".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Ирина Светлана Татьяна Юлия Вера Надежда".split(),
}
#: Titles as they stand before a name.
TITLES = ["Mr.", "Mr", "Herr", "Monsieur", "M.", "Señor", "Sr.", "Don", "Г-н", "Mrs.", "Mrs", "Ms.", "Ms", "Frau", "Madame", "Mme", "Señora", "Sra.", "Doña", "Г-жа", "Dr.", "Prof."]
#: Second labels below which a country's domains are given out.
SECOND = ["co", "com", "org", "net", "ac", "gov", "edu"]

_DIGITS = "0123456789"
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Letters of hexadecimal values stay such, so that these stay what they are and nothing else becomes one.
_CODE_CHARS = ["abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", _DIGITS, "+/", "-_.", "!@#$%^&*~"]
#: Letters stay within vowels or consonants of their case and script, so that names can still be said.
_PLAIN = ["aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "áéíóúàèêôîûëïäöü", "ÁÉÍÓÚÀÈÊÔÎÛËÏÄÖÜ", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "АЕИОУЭЮЯ", "БВГДЖЗКЛМНПРСТФХЦЧШЩ"]


def _other_letters(taken: str) -> list[str]:
    """All other letters that have a case, by case and block of 256 code points; blocks of a single one go together."""
    parts: dict[tuple[str, int], str] = {}
    for c in map(chr, range(0x80, 0x1F000)):
        if (case := unicodedata.category(c)) in ("Lu", "Ll") and c not in taken:
            key = case, ord(c) >> 8
            parts[key] = parts.get(key, "") + c
    out = [x for x in parts.values() if len(x) > 1]
    for case in ("Lu", "Ll"):
        lone = "".join(x for (k, _), x in parts.items() if k == case and len(x) == 1)
        if len(lone) == 1:
            out = [x + lone if unicodedata.category(x[0]) == case and x is next(y for y in out if unicodedata.category(y[0]) == case) else x for x in out]
        elif lone:
            out.append(lone)
    return out


#: Every letter with a case is in one of these, so that none stays as it was.
_SAID = _PLAIN + _other_letters("".join(_PLAIN))

_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,6}\.[A-Za-z]{2,24}"
#: A key word, alone or with words joined to it, and its value: quoted up to the closing quote, else up to white space.
_SAYS = r"(?:(?<![A-Za-z0-9])(?i:password|passwd|pwd|secret|api[_-]?key|access[_-]?key|private[_-]?key|token)|(?<=[a-z0-9])(?:Password|Secret|ApiKey|AccessKey|Token))(?:[_-][A-Za-z0-9]{1,20}){0,3}"
_SECRET = rf"""{_SAYS}["']?[ ]{{0,3}}[=:][ ]{{0,3}}(?:"[^"\n]{{4,}}+"|'[^'\n]{{4,}}+'|["']?(?=[^\s"']{{0,200}}[\p{{L}}\p{{N}}])[^\s"']{{6,}}+)"""
_JWT = r"(?<![A-Za-z0-9_.-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"
_KEY = r"\bAKIA[0-9A-Z]{16}\b"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_IP = rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])"
_HEX4 = "[0-9A-Fa-f]{1,4}"
_IP6 = rf"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]{{0,39}}[0-9])(?:(?:{_HEX4}:){{7}}{_HEX4}|(?:{_HEX4}:){{1,6}}(?::{_HEX4}){{1,6}})(?![0-9A-Za-z:])"
_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_CARD = r"(?<![0-9+-])[3-6][0-9]{3}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9-])"
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_PHONE = r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4})(?![0-9A-Za-z])"
#: Country codes: no code is the beginning of another, and those not listed have three digits.
_CODE = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{1,3})"
#: Inner capitals, upper case, and an apostrophe before a capital are parts of a name.
_NAME_PART = r"(?:\p{Lu}\p{L}{0,10}['’]\p{Lu}\p{L}{1,24}|\p{Lu}\p{L}{1,24})"
_NAME_WORD = rf"{_NAME_PART}(?:-{_NAME_PART})?"
_ANY_TITLE = "|".join(t.replace(".", r"\.") for t in sorted({x for t in TITLES for x in (t, t.upper())}, key=lambda t: (-len(t), t)))
_NO_TITLE = rf"(?!(?:{_ANY_TITLE})(?![\p{{L}}\p{{N}}]))"
_NAME = rf"(?<![\p{{L}}\p{{N}}])(?:{_ANY_TITLE}) {_NO_TITLE}{_NAME_WORD}(?: {_NO_TITLE}{_NAME_WORD})?"

#: The kinds, in the order in which they are tried at a place, and the start that tells a match's kind.
KINDS = {"email": _EMAIL, "secret": _SECRET, "key": _KEY, "jwt": _JWT, "iban": _IBAN, "ip": _IP, "ip6": _IP6, "card": _CARD, "ssn": _SSN, "phone": _PHONE, "name": _NAME}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
#: What stands beside a word that is a name's, and nothing more.
_WORD_EDGE = r"[\p{L}\p{N}-]"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _mac(key: str, *parts: Column) -> Column:
    """HMAC-SHA256 of the parts under the key, as 64 hexadecimal digits."""
    k = hashlib.sha256(key.encode()).digest().ljust(64, b"\0")
    pad = lambda x: F.lit(bytes(b ^ x for b in k))
    inner = F.sha2(F.concat(pad(0x36), F.concat_ws("|", *parts).cast("binary")), 256)
    return F.sha2(F.concat(pad(0x5C), F.unhex(inner)), 256)


#: The alphabets of each tweak. An address of version 4 is four characters of its own: a first octet of a host (1 to 223), and any other.
_HOST, _OCTET_AT = 0x1000, 0x2000
ALPHABETS = {
    "email": [_LOWER, _DIGITS], "domain": [_LOWER, _DIGITS], "country": [_LOWER, _DIGITS], "secret": _CODE_CHARS + _SAID[4:], "jwt": _CODE_CHARS, "key": [_UPPER, _DIGITS], "iban": [_UPPER, _DIGITS],
    "ip": ["".join(chr(_HOST + i) for i in range(1, 224)), "".join(chr(_OCTET_AT + i) for i in range(256))],
    "ip6": ["abcdef", "ABCDEF", _DIGITS], "card": [_DIGITS], "ssn": [_DIGITS], "phone": [_DIGITS], "name": _SAID, "family": _SAID,
}


def _alphabet(tweak: Column) -> Column:
    """The characters of a tweak's alphabets, and for each of them where its alphabet begins and how long it is."""
    out = None
    for name, parts in ALPHABETS.items():
        starts = [sum(map(len, parts[:i])) for i in range(len(parts))]
        numbers = lambda of: F.expr(f"array({','.join(str(of(i)) for i, p in enumerate(parts) for _ in p)})")  # noqa: B023, E731
        one = F.struct(F.lit("".join(parts)).alias("chars"), numbers(lambda i: starts[i]).alias("start"), numbers(lambda i: len(parts[i])).alias("size"))  # noqa: B023
        out = F.when(tweak == name, one) if out is None else out.when(tweak == name, one)
    return out


#: Rounds of the network (r, sign): there, a step of each character, and back.
_STEPS = "array(" + ", ".join(f"named_struct('r', {r}, 'sign', {sign})" for r, sign in [(0, 1), (1, 1), (2, 1), (3, 1), (4, 1), (3, -1), (2, -1), (1, -1), (0, -1)]) + ")"


def _once(value: Column, tweak: Column, alphabet: Column, key: str) -> Column:
    """One pass of the permutation: a keyed one-to-one replacement that keeps length and the alphabet of each character.

    In an even round the second half is shifted, character by character, by digits of a digest of the
    first, in an odd one the first by the second. In between each character that is in an alphabet
    moves one step, so a string with such a character never stays as it was."""

    def turn(acc: Column, step: Column) -> Column:
        r, h = step["r"], F.floor(F.length(acc) / 2).cast("int")
        a, b, odd, all_ = F.substring(acc, F.lit(1), h), F.substring(acc, h + 1, F.length(acc)), step["r"] % 2 == 1, step["r"] == 4
        cut = F.struct(F.when(all_, acc).when(odd, a).otherwise(b).alias("half"), F.when(all_, "").when(odd, b).otherwise(a).alias("other"))

        def shifted(x: Column) -> Column:
            blocks = F.transform(F.sequence(F.lit(0), F.floor(F.length(x["half"]) / 16).cast("int")), lambda n: _mac(key, tweak, r.cast("string"), n.cast("string"), x["other"]))

            def moved(stream: Column) -> Column:
                def char(c: Column, i: Column) -> Column:
                    at = F.instr(alphabet["chars"], c)
                    by = F.when(all_, 1).otherwise(F.conv(F.substring(stream, i * 4 + 1, F.lit(4)), 16, 10).cast("int") * step["sign"])
                    start = F.element_at(alphabet["start"], at)
                    return F.when((c == "") | (at == 0), c).otherwise(F.substring(alphabet["chars"], start + F.pmod(at - 1 - start + by, F.element_at(alphabet["size"], at)) + 1, F.lit(1)))

                return F.array_join(F.transform(F.split(x["half"], ""), char), "")

            return _let(F.when(all_, "").otherwise(F.array_join(blocks, "")), lambda stream: F.when(odd, F.concat(moved(stream), x["other"])).otherwise(F.concat(x["other"], moved(stream))))

        return _let(cut, shifted)

    return F.aggregate(F.expr(_STEPS), value, turn)


def permute(value: Column, tweak: Column, key: str, most: int = 8) -> Column:
    """The permutation of a tweak, applied again while the result has left the set it must stay in: names that are not known, domains without a registry's label."""
    leaves = lambda x: F.when(tweak == "name", _known(x)).when(tweak == "country", F.substring_index(x, ".", -1).isin(SECOND)).otherwise(F.lit(False))
    return _let(_alphabet(tweak), lambda alphabet: F.aggregate(F.sequence(F.lit(0), F.lit(most)), value, lambda acc, n: F.when((n == 0) | leaves(acc), _once(acc, tweak, alphabet, key)).otherwise(acc)))


def _refill(form: Column, chars: Column, cls: str = "[0-9]") -> Column:
    """The characters of a class in ``form`` replaced in order, all else as it was."""
    return F.array_join(F.zip_with(F.split(form, cls), F.concat(F.split(chars, ""), F.array(F.lit(""))), lambda s, d: F.concat(s, F.coalesce(d, F.lit("")))), "")


def _only_digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _cased(form: Column, low: Column) -> Column:
    """Lower-case text in the letters' case of ``form``."""
    return F.array_join(F.zip_with(F.split(form, ""), F.split(low, ""), lambda o, n: F.when(o.rlike("^[A-Z]$"), F.upper(n)).otherwise(n)), "")


def _registry(m: Column) -> tuple[Column, Column, Column]:
    """A mail address's domain in lower case: its own part, what is a registry's, and the tweak of the first."""
    labels = F.split(F.lower(F.substring_index(m, "@", -1)), r"\.")
    n = F.size(labels)
    country = (n > 2) & (F.length(F.element_at(labels, -1)) == 2)
    kept = F.when(country & F.element_at(labels, -2).isin(SECOND), 2).otherwise(1)
    own, rest = F.array_join(F.slice(labels, F.lit(1), n - kept), "."), F.array_join(F.slice(labels, n - kept + 1, kept), ".")
    return own, rest, F.when(country & (kept == 1), "country").otherwise("domain")


def luhn(digits: Column) -> Column:
    """The check digit that follows ``digits``."""
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, F.floor(d.cast("int") * 2 / 10) + (d.cast("int") * 2) % 10).otherwise(d.cast("int")).cast("int"))
    return F.pmod(F.lit(10) - F.aggregate(doubled, F.lit(0), lambda acc, x: acc + x), F.lit(10))


def _card_body(m: Column) -> Column:
    d = _only_digits(m)
    return F.substring(d, F.lit(1), F.length(d) - 1)


def is_card(m: Column) -> Column:
    """Whether the last digit is the check digit; other numbers of that length are no cards."""
    return luhn(_card_body(m)) == F.substring(m, -1, 1).cast("int")


def _mod97(s: Column) -> Column:
    """The remainder by 97 of a text in which letters stand for 10 to 35."""
    value = lambda c: F.instr(F.lit(_DIGITS + _UPPER), c) - 1
    return F.aggregate(F.split(s, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise((acc * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97).cast("int"))


def is_iban(m: Column) -> Column:
    d = F.replace(m, F.lit(" "), F.lit(""))
    return _mod97(F.concat(F.substring(d, F.lit(5), F.length(d)), F.substring(d, 1, 4))) == 1


def given_names(key: str) -> dict[str, str]:
    """Each known name's surrogate: the next of its list in an order that the key gives."""
    out = {}
    for names in NAMES.values():
        order = sorted(names, key=lambda n: hmac.new(key.encode(), n.encode(), "sha256").digest())
        out |= dict(zip(order, order[1:] + order[:1], strict=True))
    out |= {a.upper(): b.upper() for a, b in out.items()}
    return out


def _known(name: Column) -> Column:
    return name.isin(*(x for names in NAMES.values() for n in names for x in (n, n.upper())))


def _name_words(m: Column, key: str) -> Column:
    """(word, surrogate) of each word after a title, the surname first. A single word that is no known given name is a surname.

    A known given name becomes another of its gender and script, an unknown one is permuted."""
    table = given_names(key)
    given = F.when(F.size(F.split(m, " ")) > 2, True).otherwise(_known(F.element_at(F.split(m, " "), 2)))
    words = F.transform(F.slice(F.split(m, " "), 2, 2), lambda w, i: F.struct(w.alias("word"), F.when((i == 0) & given, "name").otherwise("family").alias("tweak")))

    def one(x: Column) -> Column:
        at = F.array_position(F.array(*map(F.lit, table)), x["word"])
        other = F.when((x["tweak"] == "name") & (at > 0), F.try_element_at(F.array(*map(F.lit, table.values())), at.cast("int"))).otherwise(permute(x["word"], x["tweak"], key))
        return F.struct(x["word"].alias("word"), other.alias("surrogate"))

    return F.transform(F.reverse(words), one)


def kind(m: Column) -> Column:
    """The kind of a match of ``ANY``; null for numbers without their check digits, and for other text."""
    out = None
    for name, p in KINDS.items():
        whole = m.rlike(f"^(?:{p})$")
        sure = {"card": is_card, "iban": is_iban}.get(name)
        value = F.when(sure(m), name) if sure else F.lit(name)
        out = F.when(whole, value) if out is None else out.when(whole, value)
    return out


def _unspaced(m: Column) -> Column:
    return F.replace(m, F.lit(" "), F.lit(""))


def _secret_head(m: Column) -> Column:
    return F.regexp_extract(m, r"^[^=:]*[=:] *[\"']?", 0)


def _octet(o: Column, i: Column) -> Column:
    """The character that stands for an octet; from its two bytes, as char() gives one byte only."""
    n = o.cast("int")
    code = F.when((i == 0) & n.between(1, 223), n + _HOST).otherwise(n + _OCTET_AT)
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def apart(m: Column, k: Column) -> Column:
    """(tweak, value) of the parts of a match that its surrogate is made from; none for names."""
    d, rest = _only_digits(m), lambda s, n: F.substring(s, n, F.length(s))
    code = F.when(m.startswith("+"), F.length(F.regexp_extract(d, _CODE, 0))).otherwise(F.lit(0))
    own, _, tweak = _registry(m)
    octets = F.array_join(F.transform(F.split(m, r"\."), _octet), "")
    part = lambda t, v: F.struct((F.lit(t) if isinstance(t, str) else t).alias("tweak"), v.alias("value"))
    return (
        F.when(k == "email", F.array(part("email", F.lower(F.substring_index(m, "@", 1))), part(tweak, own)))
        .when(k == "secret", F.array(part(k, rest(m, F.length(_secret_head(m)) + 1)))).when(k == "key", F.array(part(k, rest(m, F.lit(5))))).when(k == "jwt", F.array(part(k, rest(m, F.lit(4))))).when(k == "iban", F.array(part(k, rest(_unspaced(m), F.lit(5)))))
        .when(k == "ip", F.array(part(k, octets))).when(k == "ip6", F.array(part(k, m))).when(k == "card", F.array(part(k, rest(_card_body(m), F.lit(2))))).when(k == "ssn", F.array(part(k, d)))
        .when(k == "phone", F.array(part(k, rest(d, code + 1))))
    )


def together(m: Column, k: Column, new: Column) -> Column:
    """The surrogate of a match from its permuted parts: check digits made anew, and all that was no part as it stood. Null for names."""
    a, d = F.element_at(new, 1), _only_digits(m)
    _, registry, _ = _registry(m)
    country, card = F.substring(m, 1, 2), F.concat(F.substring(d, 1, 1), a)
    check = F.lpad((98 - _mod97(F.concat(a, country, F.lit("00")))).cast("string"), 2, "0")
    octet = lambda c: F.when(F.ascii(c) < _OCTET_AT, F.ascii(c) - _HOST).otherwise(F.ascii(c) - _OCTET_AT).cast("string")
    return (
        F.when(k == "email", F.concat(_cased(F.substring_index(m, "@", 1), a), F.lit("@"), _cased(F.substring_index(m, "@", -1), F.concat(F.try_element_at(new, F.lit(2)), F.lit("."), registry))))
        .when(k == "secret", F.concat(_secret_head(m), a)).when(k == "key", F.concat(F.lit("AKIA"), a)).when(k == "jwt", F.concat(F.lit("eyJ"), a)).when(k == "iban", _refill(m, F.concat(country, check, a), "[A-Z0-9]"))
        .when(k == "ip", F.array_join(F.transform(F.split(a, ""), octet), ".")).when(k == "ip6", a).when(k == "card", _refill(m, F.concat(card, luhn(card).cast("string")))).when(k == "ssn", _refill(m, a))
        .when(k == "phone", _refill(m, F.concat(F.substring(d, F.lit(1), F.length(d) - F.length(a)), a)))
    )


def surrogate(m: Column, k: Column, key: str) -> Column:
    """The replacement of one match of a kind other than a name."""
    return _let(F.transform(apart(m, k), lambda x: permute(x["value"], x["tweak"], key)), lambda new: together(m, k, new))


def replace_entities(docs: DataFrame, key: str, text_col: str = "text", out: str | None = None, found: str | None = None) -> DataFrame:
    """``docs`` with the text in ``out`` (default: in place) and, in ``found``, an array of (kind, entity, surrogate).

    Kinds: e-mail addresses, passwords and tokens after their key word, access keys, web tokens, IBANs and payment
    cards with right check digits, IPv4 and IPv6 addresses, social security and telephone numbers, and
    names after a title, with every other mention of their words in the document. Of matches that
    overlap the one that begins first is taken, of those the first in this order. A null text stays
    null, an empty one empty, and a text without entities as it was; repeated rows get the same result,
    and long texts are taken whole. ``out`` and ``found`` must not be other columns of ``docs``. A
    projection: rows are not moved.
    """
    free(docs, *(x for x in (found, out) if x and x != text_col))
    t = F.col(f"`{text_col}`").cast("string")
    hits, words, all_, done = (fresh(docs, x) for x in ("hits", "words", "all", "done"))
    some = docs.withColumn(hits, F.when(t.rlike(ANY), F.regexp_extract_all(t, F.lit(ANY), 0)))
    titled = F.filter(hits, lambda m: m.rlike(f"^(?:{_NAME})$"))
    some = some.withColumn(words, F.when(F.size(titled) > 0, F.array_distinct(F.flatten(F.transform(titled, lambda m: _name_words(m, key))))))
    spoken = F.array_join(F.transform(words, lambda x: x["word"]), "|")
    wide = F.concat(F.lit(f"{ANY}|(?<!{_WORD_EDGE})(?:"), spoken, F.lit(f")(?!{_WORD_EDGE})"))
    named = F.col(words).isNotNull()
    some = some.withColumn(all_, F.when(named, F.regexp_extract_all(t, wide, F.lit(0))).otherwise(F.col(hits)))

    def mention(m: Column) -> Column:
        """The words of a name, each by its surrogate, behind the title if there is one; null if none of them is known."""
        w = F.split(m, " ")
        new = F.transform(w, lambda x: F.try_element_at(F.filter(words, lambda y: y["word"] == x), F.lit(1))["surrogate"])
        return F.when(F.element_at(new, -1).isNotNull(), F.array_join(F.zip_with(w, new, lambda x, y: F.coalesce(y, x)), " "))

    def one(m: Column) -> Column:
        k = kind(m)
        return _let(F.struct(k.alias("kind"), F.when(k.isNull() | (k == "name"), mention(m)).alias("said")), lambda x: F.struct(
            F.coalesce(x["kind"], F.when(x["said"].isNotNull(), "name")).alias("kind"), m.alias("entity"), F.coalesce(x["said"], surrogate(m, x["kind"], key), m).alias("surrogate")))

    some = some.withColumn(done, F.transform(all_, one))
    pieces = F.when(named, F.split(t, wide, -1)).otherwise(F.split(t, ANY, -1))
    joined = F.array_join(F.zip_with(pieces, F.concat(F.col(done)["surrogate"], F.array(F.lit(""))), lambda p, s: F.concat(p, s)), "")
    some = some.withColumn(out or text_col, F.when(F.size(done) > 0, joined).otherwise(t))
    if found:
        some = some.withColumn(found, F.coalesce(F.filter(done, lambda x: x["kind"].isNotNull()), F.expr("cast(array() as array<struct<kind: string, entity: string, surrogate: string>>)")))
    return some.drop(hits, words, all_, done)


def canonical(kind_: Column, x: Column) -> Column:
    """What two spellings of one entity have in common: letters of no case in addresses, digits of numbers, a name without its title."""
    digits = F.concat(F.when(x.startswith("+"), "+").otherwise(""), _only_digits(x))
    value = F.when(kind_.isin("phone", "card", "ssn"), digits).when(kind_ == "iban", F.replace(x, F.lit(" "), F.lit(""))).when(kind_ == "email", F.lower(x)).when(kind_ == "secret", F.regexp_replace(x, r"^[^=:]*[=:] *[\"']?", ""))
    title = F.substring_index(x, " ", 1).isin(*TITLES)
    return value.when((kind_ == "name") & title, F.substring(x, F.length(F.substring_index(x, " ", 1)) + 2, F.length(x))).otherwise(x)


def clashes(found: DataFrame, col: str = "found") -> DataFrame:
    """(kind, surrogate, entities): surrogates that stand for more than one entity, spellings apart. None, if all is well."""
    one = found.select(F.explode(col).alias("x")).select("x.kind", canonical(F.col("x.kind"), F.col("x.surrogate")).alias("surrogate"), canonical(F.col("x.kind"), F.col("x.entity")).alias("entity")).distinct()
    return one.groupBy("kind", "surrogate").agg(F.count("*").alias("entities")).where("entities > 1")


def taken(found: DataFrame, col: str = "found") -> DataFrame:
    """(kind, surrogate): surrogates that are themselves entities of the corpus, and so may point at another person. Names count with both their words."""
    x = found.select(F.explode(col).alias("x"))
    both = F.lit(" ")
    side = lambda c, name: x.select("x.kind", canonical(F.col("x.kind"), F.col(f"x.{c}")).alias(name)).where((F.col("kind") != "name") | F.contains(name, both)).distinct()
    return side("surrogate", "surrogate").join(side("entity", "entity").withColumnRenamed("entity", "surrogate"), ["kind", "surrogate"], "left_semi")


def replace_checked(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", clash: str = "n_clashes", found: str = "found") -> DataFrame:
    """``replace_entities`` with ``found`` and, in ``clash``, how many of a row's surrogates stand for other entities of the corpus too, or are entities of it.

    The result is written once. Only entities are shuffled; rows are joined with the clashes, if there are any at all."""
    free(docs, clash)
    kept = materialize(replace_entities(docs, key, text_col, found=found), "surrogates")
    bad = materialize(clashes(kept, found).select("kind", "surrogate").union(taken(kept, found)).distinct(), "clashes")
    if bad.isEmpty():
        return kept.withColumn(clash, F.lit(0).cast("long"))
    each = kept.select(id_col, F.explode(F.array_distinct(found)).alias("x")).select(id_col, "x.kind", canonical(F.col("x.kind"), F.col("x.surrogate")).alias("surrogate"))
    n = each.distinct().join(bad, ["kind", "surrogate"]).groupBy(id_col).agg(F.count("*").alias(clash))
    return kept.join(n, id_col, "left").withColumn(clash, F.coalesce(clash, F.lit(0).cast("long")))
