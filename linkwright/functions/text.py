"""Text normalization as column expressions; everything here stays in the JVM.

Token lists travel as arrays inside the functions and as space-joined strings in
records, so null and the empty string are the same value everywhere.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

#: Letters folded one to one, and those that become two.
FOLD_FROM = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ"
FOLD_TO = "aaaaaaceeeeiiiinoooooouuuuyy"
FOLD_PAIRS = {"ß": "ss", "œ": "oe", "æ": "ae"}


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def fold_ascii(c: Column) -> Column:
    """Lower case, with Latin letters and marks folded; other scripts are left for the transliterator."""
    folded = F.translate(F.lower(c), FOLD_FROM, FOLD_TO)
    return reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), FOLD_PAIRS.items(), folded)


def words(c: Column, breaks: str = r"\s+") -> Column:
    """Non-empty parts between ``breaks``."""
    return F.filter(F.split(c, breaks), lambda t: t != "")


def lookup(table: dict[str, str], c: Column) -> Column:
    """``table[c]``, else ``c``; the table is small and fixed."""
    entries = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(entries, c), c)


def has_native_script(c: Column) -> Column:
    return c.rlike("[ऀ-෿]")


def script_of(c: Column) -> Column:
    """Script of the first native character, or 'latin'."""
    first = F.regexp_extract(c, "([ऀ-෿])", 1)
    names = reduce(
        lambda rest, kv: F.when(first.rlike(f"[{chr(kv[1])}-{chr(kv[1] + 0x7F)}]"), kv[0]).otherwise(rest), fixed.SCRIPTS.items(), F.lit("latin")
    )
    return F.when(first == "", "latin").otherwise(names)


def deleet(t: Column) -> Column:
    """Digits read as letters in tokens with at least twice as many letters as other characters."""
    letters = F.length(F.regexp_replace(t, "[^a-z]", ""))
    mixed = ~t.rlike("^([a-z]+|[0-9]+)$")
    return F.when(mixed & (letters >= 2 * (F.length(t) - letters)), F.translate(t, *fixed.LEET)).otherwise(t)


def name_tokens(c: Column) -> Column:
    """Tokens of an ASCII lower-case name."""
    s = F.regexp_replace(c, fixed.ID_TAG, " ")
    s = F.regexp_replace(s, fixed.MS_PREFIX, " ")
    s = F.replace(F.replace(s, F.lit("&"), F.lit(" and ")), F.lit("+"), F.lit(" and "))
    s = F.regexp_replace(s, fixed.DOTTED, "")
    s = F.regexp_replace(s, fixed.WEBSITE, "$1")
    canonical = F.transform(words(F.regexp_replace(s, fixed.NOT_ALNUM, " ")), lambda t: lookup(fixed.NAME_CANON, deleet(t)))
    return words(F.array_join(canonical, " "))


def without_legal(tokens: Column, country: Column, french: bool = True) -> Column:
    """Legal forms and fillers dropped; order and repeats stay. ``french``: also the fillers of French names."""
    legal = F.array(*[F.lit(x) for x in fixed.LEGAL])
    noise = F.array(*[F.lit(x) for x in fixed.FR_NAME_NOISE])
    return F.filter(tokens, lambda t: ~F.array_contains(legal, t) & ~(F.lit(french) & (country == "france") & F.array_contains(noise, t)))


def name_parts(c: Column, country: Column, french: bool = True) -> Column:
    """Struct of full, core, compact and alias of an ASCII lower-case name."""
    parts = F.filter(F.split(c, fixed.ALIAS), lambda p: F.trim(p) != "")
    several = F.size(parts) > 1
    full = name_tokens(c)
    core = without_legal(F.when(several, name_tokens(F.try_element_at(parts, F.lit(1)))).otherwise(full), country, french)
    alias = without_legal(F.when(several, name_tokens(F.try_element_at(parts, F.lit(-1)))).otherwise(F.array().cast("array<string>")), country, french)
    return F.struct(
        F.array_join(full, " ").alias("name_full"),
        F.array_join(core, " ").alias("core"),
        F.array_join(core, "").alias("compact"),
        F.array_join(alias, " ").alias("alias"),
    )


def lite(c: Column) -> Column:
    """Lower-case ASCII words; nothing dropped or reordered."""
    return F.trim(F.regexp_replace(fold_ascii(c), fixed.NOT_ALNUM, " "))


def unglue(t: Column) -> Column:
    """A token with digits and words set apart by spaces; words, numbers and ordinals stay."""
    plain = t.rlike(r"^([a-z]+|[0-9]+|[0-9]+(st|nd|rd|th))$")
    spaced = F.regexp_replace(F.regexp_replace(t, r"([0-9]+(?:st|nd|rd|th)?)([a-z]{3,})", "$1 $2"), r"([a-z]{3})([0-9])", "$1 $2")
    return F.when(plain, t).otherwise(spaced)


def french_token(t: Column) -> Column:
    """Street types and house suffixes of a French address token, space-joined."""
    number = F.regexp_extract(t, r"^no([0-9]+)$", 1)
    house, suffix = F.regexp_extract(t, r"^([0-9]+)(bis|ter|b|t)$", 1), F.regexp_extract(t, r"^([0-9]+)(bis|ter|b|t)$", 2)
    return (
        F.when(number != "", number)
        .when(house != "", F.concat_ws(" ", house, lookup(fixed.FR_ADDR_CANON, suffix)))
        .otherwise(lookup(fixed.FR_ADDR_CANON, t))
    )


def state_of(country: Column, component: Column) -> Column:
    """State named by an address component, or null."""
    entries = F.create_map(*[F.lit(x) for c, k, s in fixed.state_rows() for x in (f"{c}|{k}", s)])
    return F.try_element_at(entries, F.concat_ws("|", country, component))


def address_parts(c: Column, country: Column, french: bool = True) -> Column:
    """Struct of addr, state and nums of an address: states are taken out, numbers listed once, words canonical."""
    in_france = F.lit(french) & (country == "france")
    raw = F.when(in_france, F.translate(c, "°º", "oo")).otherwise(c)
    kept = F.filter(F.transform(F.split(fold_ascii(raw), ","), lambda x: F.trim(x)), lambda x: ~x.isin(fixed.NULLISH))
    parts = F.transform(kept, lambda x: F.trim(F.regexp_replace(x, fixed.NOT_ALNUM, " ")))
    states = F.filter(F.transform(parts, lambda x: state_of(country, x)), lambda x: x.isNotNull())
    tokens = words(F.array_join(F.transform(words(F.array_join(F.filter(parts, lambda x: state_of(country, x).isNull()), " ")), unglue), " "))
    tokens = words(F.array_join(F.transform(tokens, lambda t: F.when(in_france, french_token(t)).otherwise(t)), " "))
    digits = F.regexp_extract_all(F.array_join(tokens, " "), F.lit("([0-9]+)"), 1)
    nums = F.transform(digits, lambda d: F.when(d.rlike("^0+$"), "0").otherwise(F.ltrim(d, F.lit("0"))))
    stop = F.array(*[F.lit(x) for x in fixed.ADDR_STOP])
    canonical = F.transform(tokens, lambda t: lookup(fixed.ADDR_CANON, t))
    kept_words = F.filter(canonical, lambda t: ~F.array_contains(stop, t) & ~t.rlike("^[0-9]+$"))
    return F.struct(
        F.array_join(kept_words, " ").alias("addr"),
        F.array_join(F.array_distinct(states), "|").alias("state"),
        F.array_join(F.array_distinct(nums), " ").alias("nums"),
    )


def address_components(c: Column) -> Column:
    """Raw comma components: lower case, other characters than letters and digits as spaces."""
    return F.transform(F.split(F.lower(c), ","), lambda x: F.trim(F.regexp_replace(x, r"[^\p{L}0-9]+", " ")))


def name_text(compact: Column, name_full: Column) -> Column:
    """What the name view of blocking compares."""
    return F.when(compact != "", compact).otherwise(name_full)


def address_text(core: Column, alias: Column, addr: Column, nums: Column) -> Column:
    """What the address view of blocking compares; numbers are marked."""
    return F.concat_ws(" ", core, alias, addr, F.regexp_replace(nums, r"(\S+)", "#$1"))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def char_ngrams(c: Column, n: int) -> Column:
    """Distinct n-grams of the letters and digits; a shorter text is its own."""

    def grams(s: Column) -> Column:
        many = F.regexp_extract_all(s, F.lit(f"(?=(.{{{n}}}))"), 1)  # in one pass; a substring is found from the start of the text
        return F.when(F.length(s) >= n, F.array_distinct(many)).when(s == "", F.array().cast("array<string>")).otherwise(F.array(s))

    return bound(F.regexp_replace(F.lower(c), "[^a-z0-9]", ""), grams)


def padded_shingles(c: Column, k: int = 3) -> Column:
    """Distinct k-grams of the text between two spaces."""
    s = F.concat(F.lit(" "), c, F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.length(s) - (k - 1)), lambda i: F.substring(s, i, F.lit(k)))
    return F.when(F.length(s) >= k, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def clean_token_set(c: Column, min_length: int = 3) -> Column:
    stop = F.array(*[F.lit(x) for x in fixed.EDA_STOPWORDS])
    found = F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1)
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) >= min_length) & ~F.array_contains(stop, t)))


def postal_code(address: Column, country: Column) -> Column:
    """Last six-digit PIN or five-digit ZIP of an address; null elsewhere."""
    pin = F.regexp_extract_all(address, F.lit(r"\b([1-9][0-9]{5})\b"), 1)
    zip_ = F.regexp_extract_all(address, F.lit(r"\b([0-9]{5}(?:-[0-9]{4})?)\b"), 1)
    return F.when(country == "india", F.try_element_at(pin, F.lit(-1))).when(country == "us", F.substring(F.try_element_at(zip_, F.lit(-1)), 1, 5))


def homoglyph_fold(c: Column) -> Column:
    return F.translate(c, *fixed.HOMOGLYPHS)


def script_tokens(c: Column) -> Column:
    """Tokens between explicit separators, for texts in scripts whose marks are not word characters."""
    return words(F.lower(c), fixed.TOKEN_BREAKS)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def agreement(a: Column, b: Column) -> Column:
    """match, mismatch, one_missing or both_missing of two values."""
    both = a.isNotNull() & b.isNotNull()
    return F.when(both, F.when(a == b, "match").otherwise("mismatch")).when(a.isNotNull() | b.isNotNull(), "one_missing").otherwise("both_missing")
