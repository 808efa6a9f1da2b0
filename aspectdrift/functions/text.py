"""Text expressions with Unicode semantics: trimming, normalising, hashing, counting words."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

#: All that counts as white space, written out because \s alone is ASCII here.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
SPACES = "".join(map(chr, (0x20, *range(0x09, 0x0E), *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


#: Decimal digits of all scripts but ASCII, and what they stand for.
DIGITS = "".join(c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c) == "Nd")
VALUES = "".join(str(unicodedata.decimal(c)) for c in DIGITS)


def ascii_digits(text: Column) -> Column:
    """Digits of any script as 0 to 9."""
    return F.when(text.rlike(r"[\P{ASCII}&&\p{Nd}]"), F.translate(text, DIGITS, VALUES)).otherwise(text)


@F.pandas_udf(StructType().add("nfc", StringType()).add("nfkc", StringType()))
def _forms(s: pd.Series) -> pd.DataFrame:
    """Both normal forms of each text in one crossing; nulls, which most rows are, stay null."""
    out = pd.DataFrame({"nfc": None, "nfkc": None}, index=s.index, dtype=object)
    some = s[s.notna()]
    for name, form in (("nfc", "NFC"), ("nfkc", "NFKC")):
        out.loc[some.index, name] = [unicodedata.normalize(form, x) for x in some]
    return out


#: Characters that are their own NFC and NFKC and don't combine: ASCII, and Latin letters as most European and Vietnamese texts have them.
STABLE = r"\x00-\x7F\u00A1\u00A7\u00AB\u00B0\u00BB\u00BF-\u0131\u0134-\u013E\u0141-\u0148\u014A-\u017E\u0180-\u01C3\u1EA0-\u1EF9"


def unstable(text: Column) -> Column:
    """Whether text has other than STABLE characters. A long class is slow to match, so only what is beyond ASCII meets it."""
    beyond = F.regexp_replace(text, r"[\x00-\x7F]++", "")
    return (F.length(text) < F.octet_length(text)) & beyond.rlike(f"[^{STABLE}]")


def unicode_forms(text: Column) -> Column:
    """struct(nfc, nfkc). Text of STABLE characters is its own form; only other texts are sent to Python."""
    made = _forms(F.when(unstable(text), text))
    return F.struct(F.coalesce(made["nfc"], text).alias("nfc"), F.coalesce(made["nfkc"], text).alias("nfkc"))


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def nfc(text: Column, forms: bool = True) -> Column:
    """Trimmed NFC; null is empty. forms=False leaves out the normal form, for text known to be in it."""
    text = F.coalesce(text, F.lit(""))
    return trim(unicode_forms(text)["nfc"] if forms else text)


def words_only(text: Column) -> Column:
    """Lower-cased, whatever is no letter, number or underscore as single spaces, trimmed."""
    return F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "))


def norm_text(text: Column, forms: bool = True) -> Column:
    """Lower-cased NFKC with punctuation as single spaces, trimmed; null is empty."""
    text = F.coalesce(text, F.lit(""))
    return words_only(unicode_forms(text)["nfkc"] if forms else text)


def norm_start(text: Column, n: int, forms: bool = True) -> Column:
    """The first n characters of norm_text, from the first 3 n where these tell: STABLE characters don't change by what
    follows, so if more than n come out of them, the whole text gives the same. All other texts are normalised whole."""
    text = F.coalesce(text, F.lit(""))
    start = F.substring(text, 1, 3 * n)
    short = words_only(start)
    tells = (start != text) & (F.length(short) > n + 1) & ~unstable(start)
    rest = F.when(~tells, text)  # null where the start tells, so nothing is normalised there
    return F.substring(F.when(tells, short).otherwise(words_only(unicode_forms(rest)["nfkc"] if forms else rest)), 1, n)


def joined(*normed: Column) -> Column:
    """norm_text of texts put together with a sign or space between, from their normal forms."""
    return F.array_join(F.filter(F.array(*normed), lambda x: x != ""), " ")


def text_hash(text: Column, forms: bool = True) -> Column:
    return F.md5(norm_text(text, forms))


def word_count(text: Column) -> Column:
    text = trim(F.coalesce(text, F.lit("")))
    return F.when(text == "", 0).otherwise(F.size(F.split(text, f"{SPACE}+"))).cast("int")


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def quad_uid(review_uid: Column, phi: Column, code: Column, opinion: Column, forms: bool = True) -> Column:
    """A short name of a quad; not unique, since it has 24 bits of the opinion and neither aspect nor sentiment."""
    short = F.substring(text_hash(F.coalesce(opinion, F.lit("None")), forms), 1, 6)
    return F.concat_ws("_", review_uid.cast("string"), phi, code, short)


def match_key(aspect: Column, code: Column, opinion: Column, sentiment: Column, forms: bool = True) -> Column:
    none = F.lit("")
    return F.struct(norm_text(aspect, forms).alias("a"), F.coalesce(code, none).alias("c"), norm_text(opinion, forms).alias("o"), F.coalesce(sentiment, none).alias("s"))


def uniform(seed: int, *key: Column) -> Column:
    """A number in [0, 1) from the md5 of seed and key; the same on any partitioning and in any engine."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def draw_order(seed: int, *key: Column) -> Column:
    """Rows in this order are a random permutation; its first k a uniform sample."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key]))
