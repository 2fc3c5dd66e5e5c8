"""Texts that look the same but are made of different characters.

Mapped in SQL: invisible characters go, kinds of space become the space,
presentation forms become the character they present, and letters of another
script inside a word become the letters they stand for. What remains, composed or
decomposed accents, is equal under Spark's accent- and case-sensitive Unicode
collation: values are grouped under it, each class gets a canonical member, and
the member is joined back to every value.
"""

from __future__ import annotations

import unicodedata
from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import checkpoint

#: Rows of a class that one piece of its expansion takes on one side.
PIECE = 1000
COLLATION = "UNICODE"  # tertiary strength: accents and case count

#: Letters of other scripts that stand for Latin ones (fixed values).
_CYRILLIC = "аеорсухіјѕһԁԛԝѵӏАВЕКМНОРСТУХІЈЅҮԚԜѴӀ"
_CYRILLIC_AS = "aeopcyxijshdqwvlABEKMHOPCTYXIJSYQWVI"
_GREEK = "οανρυιΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϲ"
_GREEK_AS = "oavpuiABEZHIKMNOPTYXCc"
#: Latin letters that stand for Cyrillic ones in a word that is otherwise Cyrillic (fixed values).
_LATIN = "aeopcyxijsABEKMHOPCTYXIJS"
_LATIN_AS = "аеорсухіјѕАВЕКМНОРСТУХІЈЅ"


def _with_accents(letters: str, stand_for: str, first: int, last: int) -> tuple[str, str]:
    """The pairs, and each letter of the range that is one of them under accents, for the same letter under the same accents."""
    pairs = dict(zip(letters, stand_for))
    for code in range(first, last + 1):
        base, *marks = unicodedata.normalize("NFD", chr(code))
        accented = unicodedata.normalize("NFC", pairs.get(base, "") + "".join(marks))
        if marks and base in pairs and len(accented) == 1:
            pairs.setdefault(chr(code), accented)
    return "".join(pairs), "".join(pairs.values())


CYRILLIC, CYRILLIC_AS = _with_accents(_CYRILLIC, _CYRILLIC_AS, 0x400, 0x52F)
GREEK, GREEK_AS = _with_accents(_GREEK, _GREEK_AS, 0x370, 0x3FF)
LATIN, LATIN_AS = _with_accents(_LATIN, _LATIN_AS, 0xC0, 0x24F)

#: Kinds of decomposition whose result looks the same; superscripts, subscripts, fractions and circled forms do not.
_SAME_LOOK = {"<wide>", "<narrow>", "<compat>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>", "<vertical>", "<small>", "<square>"}
#: Compatibility characters that look unlike their decomposition (fixed values).
_UNLIKE = frozenset("ſﬅﬆϐϑϕϖϰϱϵ϶ϴẛ·ŀĿŉ")

# letters and marks of the scripts that mix
_WORD = r"([\p{IsLatin}\p{IsCyrillic}\p{IsGreek}\p{M}]+|[^\p{IsLatin}\p{IsCyrillic}\p{IsGreek}\p{M}]+)"
_LATIN_LETTER, _CYRILLIC_LETTER, _GREEK_LETTER = r"\p{IsLatin}", r"\p{IsCyrillic}", r"\p{IsGreek}"
_JOINED = r"(?<![\p{So}\p{Sk}️\p{IsArabic}\p{IsDevanagari}\p{IsBengali}\p{IsTamil}\p{IsTelugu}\p{IsKannada}\p{IsMalayalam}\p{IsSinhala}])"
#: Default-ignorable and format characters; joiners and presentation selectors stay where they change the look.
INVISIBLE = (
    r"[­͏؜ᅟᅠ឴឵᠋-᠏​‎‏‪-‮⁠-⁯ㅤ︀-︎﻿ﾠ\x{E0000}-\x{E0FFF}"
    r"\x{00}-\x{08}\x{0E}-\x{1F}\x{7F}]|" + _JOINED + r"[‌‍️]"
)
VISIBLE = r"[^\p{Z}\p{Cc}\p{Cf}\x{34F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{3164}\x{FFA0}\x{FE00}-\x{FE0F}]"
SPACES = r"[\p{Zs}&&[^\x{1680}]]"


@cache
def presentation_forms() -> tuple[dict[str, str], dict[str, str]]:
    """(char -> char, char -> several) for every presentation form, by rule from the Unicode data."""
    one, more = {}, {}
    for code in range(0xA1, 0x20000):
        c = chr(code)
        kind, *rest = unicodedata.decomposition(c).split() or [""]
        if kind not in _SAME_LOOK or c in _UNLIKE:
            continue
        out = "".join(chr(int(x, 16)) for x in rest)
        if out.startswith(" ") or unicodedata.category(c) == "Zs":  # spacing accents, spaces
            continue
        while True:  # a form of a form
            deeper = "".join(one.get(x) or more.get(x) or x for x in out)
            if deeper == out:
                break
            out = deeper
        (one if len(out) == 1 else more)[c] = out
    return one, more


def _class(chars: str) -> str:
    return "[" + "".join(rf"\x{{{ord(c):X}}}" for c in chars) + "]"


def _mixed_words(text: Column) -> Column:
    """Words of two scripts in one script, if every letter of the other one is a look-alike; other words stay."""
    cyr, gre, lat = _class(CYRILLIC), _class(GREEK), _class(LATIN)

    def word(w: Column) -> Column:
        is_lat, is_cyr, is_gre = w.rlike(_LATIN_LETTER), w.rlike(_CYRILLIC_LETTER), w.rlike(_GREEK_LETTER)
        foreign_ok = ~w.rlike(rf"[{_CYRILLIC_LETTER}&&[^{cyr[1:-1]}]]") & ~w.rlike(rf"[{_GREEK_LETTER}&&[^{gre[1:-1]}]]")
        to_latin = F.translate(w, CYRILLIC + GREEK, CYRILLIC_AS + GREEK_AS)
        greek_gone = F.translate(w, GREEK, GREEK_AS)
        to_cyrillic = F.translate(greek_gone, LATIN, LATIN_AS)
        return (
            F.when(is_lat & (is_cyr | is_gre) & foreign_ok, to_latin)
            .when(is_cyr & (is_lat | is_gre) & ~greek_gone.rlike(rf"[{_LATIN_LETTER}&&[^{lat[1:-1]}]]") & ~greek_gone.rlike(_GREEK_LETTER), to_cyrillic)
            .otherwise(w)
        )

    words = F.regexp_extract_all(text, F.lit(_WORD), F.lit(1))
    some = text.rlike(rf"[{_CYRILLIC_LETTER}{_GREEK_LETTER}]")
    return F.when(some, F.array_join(F.transform(words, word), "")).otherwise(text)


#: Blocks of ordinary characters; presentation forms, spaces and ignorable characters inside them are cut out by rule.
_BLOCKS = ((0x20, 0x7E), (0x09, 0x0A), (0x0D, 0x0D), (0xA1, 0x24F), (0x300, 0x34E), (0x370, 0x52F), (0x2010, 0x2027), (0x3001, 0x3002), (0x3041, 0x30FF), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3))


@cache
def _odd() -> str:
    """Class of the characters that may need mapping: all but the ordinary ones, in few ranges."""
    one, more = presentation_forms()
    ranges = []
    for first, last in _BLOCKS:
        start = first
        for code in [*range(first, last + 1), None]:
            if code is None or chr(code) in one or chr(code) in more or code == 0xAD:
                end = (last if code is None else code - 1)
                if start <= end:
                    ranges.append(rf"\x{{{start:X}}}-\x{{{end:X}}}")
                start = (code or 0) + 1
    return "[^" + "".join(ranges) + "]"


def with_look(df: DataFrame, value: str = "value") -> DataFrame:
    """Adds ``look``: equal-looking values are equal under ``COLLATION`` there. Null stays null; ordinary text costs two tests."""
    one, more = presentation_forms()
    text = F.col(value)
    several = F.create_map(*[F.lit(x) for pair in more.items() for x in pair])
    unfolded = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(several[c], c)), "")
    # most texts hold no character that stands for several
    unfolded = F.when(text.rlike(_class(more)), unfolded).otherwise(text)
    plain = F.translate(unfolded, "".join(one), "".join(one.values()))
    plain = F.regexp_replace(F.regexp_replace(plain, INVISIBLE, ""), SPACES, " ")
    df = df.withColumn("_plain", F.when(text.rlike(_odd()), plain).otherwise(text))
    return df.withColumn("look", _mixed_words(F.col("_plain"))).drop("_plain")


def values_of(df: DataFrame, group: str, key: str | None, value: Column, field: str) -> DataFrame:
    """Distinct ``grp, field, key, value`` of one text field; without a key column the value is its own key."""
    out = df.select(F.col(group).alias("grp"), F.lit(field).alias("field"), (F.col(key) if key else F.lit(None).cast("string")).alias("key"), value.alias("value"))
    out = out.filter(F.col("value").rlike(VISIBLE) & F.col("grp").isNotNull())
    out = out.withColumn("key", F.col("key" if key else "value"))
    return out.filter(F.col("key").isNotNull()).distinct()


def canonical_members(values: DataFrame) -> DataFrame:
    """``grp, field, value, canonical, variants`` of distinct (grp, field, value) rows.

    ``canonical`` is the least member by (needs mapping, code points) of the class
    under the collation: the plain spelling if it occurs, else the same disguised
    one for all. ``variants`` counts the different spellings of the class. Texts
    without any visible character have no look and form no class.
    """
    # mapped once, used twice: for the classes and for joining their members back
    mapped = checkpoint(with_look(values.select("grp", "field", "value").distinct()))
    mapped = mapped.withColumn("odd", (F.col("look") != F.col("value")).cast("int")).withColumn("look", F.collate("look", COLLATION))
    classes = mapped.groupBy("grp", "field", "look").agg(F.min(F.struct("odd", "value"))["value"].alias("canonical"), F.count(F.lit(1)).alias("variants"))
    return mapped.join(classes, ["grp", "field", "look"]).select("grp", "field", "value", "canonical", "variants")


def lookalike_classes(values: DataFrame) -> DataFrame:
    """``grp, field, key, class_id, variants``: each row whose value has an equal-looking other spelling, with its class.

    The whole relation in one row per key: two keys of one class and different
    values are a pair. ``class_id`` is the digest of the canonical member.
    """
    many = canonical_members(values).filter("variants > 1")
    member = many.select("grp", "field", "value", F.sha2("canonical", 256).alias("class_id"), "variants")
    return values.join(member, ["grp", "field", "value"]).select("grp", "field", "key", "class_id", "variants").distinct()


def lookalike_pairs(values: DataFrame) -> DataFrame:
    """``grp, field, key_a, key_b`` with key_a < key_b: values that look the same and differ in characters.

    ``values`` comes from :func:`values_of`. Rows of equal characters are copies,
    no pair. Pairs are built from class representatives: only classes of two or
    more spellings are expanded, each row meeting rows of *other* spellings only.
    Null values, null keys and null groups take part in nothing; repeated rows
    count once; empty tables give no rows; texts of any length are taken whole.
    """
    many = canonical_members(values).filter("variants > 1")
    # a digest stands for the text from here on
    member = many.select("grp", "field", "value", F.sha2("canonical", 256).alias("cls"), F.sha2("value", 256).alias("spelling"))
    rows = checkpoint(values.join(member, ["grp", "field", "value"]).select("grp", "field", "key", "cls", "spelling").distinct())
    # a large class is expanded in pieces: each takes a part of one side and all of the other
    size = rows.groupBy("grp", "field", "cls").agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("int").alias("pieces"))
    sized = rows.join(size, ["grp", "field", "cls"])
    a = sized.withColumn("piece", F.pmod(F.xxhash64("key"), F.col("pieces")).cast("int")).alias("a")
    b = sized.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).alias("b")
    same = reduce(Column.__and__, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("grp", "field", "cls", "piece")])
    return (
        a.join(b, same & (F.col("a.spelling") != F.col("b.spelling")) & (F.col("a.key") < F.col("b.key")))
        .select("a.grp", "a.field", F.col("a.key").alias("key_a"), F.col("b.key").alias("key_b"))
        .distinct()
    )
