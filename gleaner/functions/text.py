"""Text, hash and identity columns; all stay in the JVM unless the name says otherwise."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F

ID_PREFIX = "gl_"
WORD = r"[\p{L}\p{N}_]+"
TERM = r"[\p{L}\p{N}\p{Co}]+"
# Letters with a diacritic of the Latin-1 block and what they fold to.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
FOLDED = "aaaaaaceeeeiiiinooooouuuuyy"
# White space that str.strip() takes, and what of it Unicode calls white space (the separators below U+0020 are none).
BLANKS = " \t\n\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
EDGES = BLANKS + "\x1c\x1d\x1e\x1f"
# How addresses are spelled out, and what their parts hold.
AT_WORDS, DOT_WORDS = "at chez", "dot point"
LOCAL_CHARS, LABEL_CHARS = "A-Za-z0-9._%+-", "A-Za-z0-9-"
# How phone numbers begin, what may stand after a digit, and how many digits follow.
PHONE_STARTS, PHONE_GAPS, PHONE_LEAST, PHONE_DIGITS = "+33 0", "().-", 8, 10

# The same as classes of patterns; those of ASCII alone are much faster to search for.
_ascii = r"\t\x0b\x0c\r"
_wide = r"\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_line_end = f"[ {_ascii}{_wide}]+(?=\\n|\\z)"
_gap, _wide_gap = rf"[ \n{_ascii}\x1c-\x1f]+", rf"[ \n{_ascii}\x1c-\x1f{_wide}]+"
_uneven, _wide_uneven = rf"  |[\n{_ascii}\x1c-\x1f]", rf"  |[\n{_ascii}\x1c-\x1f{_wide}]"


def _folds() -> tuple[str, str]:
    """Latin letters with one diacritic and their base letters; at the end, to be deleted, the combining marks themselves."""
    letters, bases = ACCENTED, FOLDED
    for code in [*range(0x100, 0x250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) == 2 and parts[0].isascii() and chr(code) == chr(code).lower():
            letters, bases = letters + chr(code), bases + parts[0]
    return letters + "".join(map(chr, range(0x300, 0x370))), bases


_MARKED, _BARE = _folds()


def column(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_ascii(x) -> Column:
    return F.octet_length(column(x)) == F.char_length(column(x))


def strip(x) -> Column:
    return F.btrim(column(x), F.lit(EDGES))


def normalized_content(x) -> Column:
    """In NFC, line ends as \\n, no white space at line ends, at most one blank line in a row, stripped.

    Each pass runs only on texts that need it, which a plain search tells.
    """
    text = composed(x)
    text = F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, r"\r\n?", "\n")).otherwise(text)
    ragged = text.rlike(rf"[ {_ascii}]\n") | (~is_ascii(text) & text.rlike(rf"[{_wide}]\n"))
    text = F.when(ragged, F.regexp_replace(text, _line_end, "")).otherwise(text)
    return strip(F.when(F.contains(text, F.lit("\n\n\n")), F.regexp_replace(text, r"\n{3,}", "\n\n")).otherwise(text))


def content_hash(x) -> Column:
    return F.sha2(normalized_content(x), 256)


def text_hash(x) -> Column:
    return F.sha2(column(x), 256)


def stable_id(kind: str, *parts) -> Column:
    """Prefix, kind and the first 24 hex digits of sha256 over the parts joined by U+001F."""
    joined = F.concat_ws("\x1f", *[column(p).cast("string") for p in parts])
    return F.concat(F.lit(ID_PREFIX + kind.replace("-", "_") + "_"), F.substring(F.sha2(joined, 256), 1, 24))


def normalized_text(x) -> Column:
    """No control characters but \\n and \\t, no-break spaces as spaces, runs of blanks as one, at most one blank line, stripped."""
    clean = F.regexp_replace(F.regexp_replace(column(x), r"[\x00-\x08\x0b-\x1f\x7f]", ""), "\u00a0", " ")
    return strip(F.regexp_replace(F.regexp_replace(clean, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def tokens(x) -> Column:
    """Lower-case words of letters, digits and underscores, in order."""
    return F.regexp_extract_all(F.lower(column(x)), F.lit(WORD), 0)


def casefolded(x) -> Column:
    return F.replace(F.lower(column(x)), F.lit("ß"), F.lit("ss"))


def word_set(x) -> Column:
    """Distinct case-folded words."""
    return F.array_distinct(F.regexp_extract_all(casefolded(x), F.lit(WORD), 0))


def folded(x) -> Column:
    """Lower case without the diacritics of Latin letters that have one; ß, ø and ligatures stay."""
    return F.translate(F.lower(column(x)), _MARKED, _BARE)


def terms(x) -> Column:
    """Index terms: folded runs of letters and digits; an underscore ends a term."""
    return F.regexp_extract_all(folded(x), F.lit(TERM), 0)


def token_count(x) -> Column:
    """White-space separated tokens."""
    parts = F.when(is_ascii(x), F.split(column(x), _gap)).otherwise(F.split(column(x), _wide_gap))
    return F.size(F.filter(parts, lambda t: t != ""))


def collapsed(x) -> Column:
    uneven = F.when(is_ascii(x), column(x).rlike(_uneven)).otherwise(column(x).rlike(_wide_uneven))
    return F.lower(strip(F.when(uneven, F.regexp_replace(column(x), _wide_gap, " ")).otherwise(column(x))))


def nfc(x) -> Column:
    """Canonical composition, which the engine has no function for (Arrow batches)."""

    def batch(x: pd.Series) -> pd.Series:
        return x.map(lambda s: s if s is None else unicodedata.normalize("NFC", s))

    return F.pandas_udf(batch, "string")(column(x))


def composed(x) -> Column:
    """``nfc`` of texts that may need it; those with nothing above U+02FF are composed already and go to no Python worker."""
    text = column(x)
    return F.coalesce(nfc(F.when(~is_ascii(text) & text.rlike("[^\\u0000-\\u02ff]"), text)), text)


def folded_any(x) -> Column:
    """Lower case without combining marks, any script (Arrow batches)."""

    def batch(x: pd.Series) -> pd.Series:
        return x.map(lambda s: s if s is None else "".join(c for c in unicodedata.normalize("NFD", s.lower()) if not unicodedata.combining(c)))

    return F.pandas_udf(batch, "string")(column(x))


def token_f1(a, b) -> Column:
    """Set-based F1 of two texts' words; null if either has none, 0 without overlap."""
    left, right = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    common = F.size(F.array_intersect(left, right)).cast("double")
    p, r = common / F.size(left), common / F.size(right)
    return F.when((F.size(left) == 0) | (F.size(right) == 0), None).when(common == 0, 0.0).otherwise(2 * p * r / (p + r))


def embedding_text(title, heading, text) -> Column:
    """Distinct non-empty title, heading and text, one a line."""
    parts = F.array(*[F.coalesce(strip(p), F.lit("")) for p in (title, heading, text)])
    return F.array_join(F.array_distinct(F.filter(parts, lambda p: p != "")), "\n")


def with_role(x, role: str) -> Column:
    """Exactly one ``query: `` or ``passage: `` prefix."""
    return F.concat(F.lit(f"{role}: "), F.regexp_replace(column(x), r"^(query|passage): ", ""))


def _spelled(words: str) -> str:
    """One of the words, brackets and blanks around it optional."""
    return r"\s*[(\[]?\s*(?:" + words.replace(" ", "|") + r")\s*[)\]]?\s*"


_dot = re.compile(_spelled(DOT_WORDS), re.I)
_address = re.compile(rf"\b([{LOCAL_CHARS}]+){_spelled(AT_WORDS)}((?:[{LABEL_CHARS}]+{_spelled(DOT_WORDS)})+[{LABEL_CHARS}]+)\b", re.I)
_phone = re.compile("(?:" + "|".join(map(re.escape, PHONE_STARTS.split())) + rf")\s?(?:[0-9][\s{PHONE_GAPS}]?){{{PHONE_LEAST},}}")


def _written_address(text: str) -> str:
    """Spelled addresses of a text written with signs; what that brings about is looked at again until nothing changes."""
    while (found := _address.sub(lambda m: f"{m[1]}@{'.'.join(_dot.split(m[2]))}", text)) != text:
        text = found
    return text


def deobfuscated_email(x) -> Column:
    """``a (at) b (dot) c`` as ``a@b.c``: brackets are optional, ``chez`` and ``point`` count too; other text stays (Arrow batches, texts without the words are not sent)."""

    def batch(x: pd.Series) -> pd.Series:
        return x.map(lambda s: s if s is None else _written_address(s))

    text = column(x)
    some = text.rlike(f"(?i){AT_WORDS.replace(' ', '|')}") & text.rlike(f"(?i){DOT_WORDS.replace(' ', '|')}")
    return F.coalesce(F.pandas_udf(batch, "string")(F.when(some, text)), text)


def _paired(number: str) -> str:
    digits = re.findall("[0-9]", number)
    return " ".join(a + b for a, b in zip(digits[::2], digits[1::2])) if len(digits) == PHONE_DIGITS else number


def spelled_out(text: str) -> str:
    """Addresses and phone numbers of a text written plainly."""
    return _phone.sub(lambda m: _paired(m[0]), _written_address(text))


def phone_pairs(x) -> Column:
    """Phone numbers of exactly ten digits as five pairs; others stay (Arrow batches)."""

    def batch(x: pd.Series) -> pd.Series:
        return x.map(lambda s: s if s is None else _phone.sub(lambda m: _paired(m[0]), s))

    return F.pandas_udf(batch, "string")(column(x))


def cosine(a, b) -> Column:
    """Dot product over the product of norms; 0 where a norm is 0; surplus dimensions are ignored."""
    a, b = column(a), column(b)
    n = F.least(F.size(a), F.size(b))
    dot = F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    size = l2_norm(a) * l2_norm(b)
    return F.when(size == 0, 0.0).otherwise(dot / size)


def l2_norm(a) -> Column:
    return F.sqrt(F.aggregate(column(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalized(a) -> Column:
    norm = l2_norm(a)
    return F.when(norm == 0, F.transform(column(a), lambda x: x.cast("double"))).otherwise(F.transform(column(a), lambda x: x.cast("double") / norm))


def hash_embedding(text, dims: int = 384, seed: int = 0, role: str = "document") -> Column:
    """Deterministic unit vector: blocks of sha256(seed, role, text, counter), read as big-endian 32-bit numbers mapped to [-1, 1]."""
    payload = F.concat_ws("\x00", F.lit(str(seed)), F.lit(role), column(text))
    blocks = F.sequence(F.lit(0), F.lit(-(-dims // 8) - 1))
    digests = F.transform(blocks, lambda k: F.sha2(F.concat_ws("\x00", payload, k.cast("string")), 256))
    numbers = F.flatten(F.transform(digests, lambda d: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.conv(F.substr(d, j * 8 + 1, F.lit(8)), 16, 10).cast("double") / F.lit(2147483647.5) - 1)))
    return l2_normalized(F.slice(numbers, 1, dims))
