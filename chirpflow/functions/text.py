"""Text column expressions: tokenizers, cleaning, whole-word counts, snippets.

Everything here is a built-in Spark expression, so it runs inside whole-stage
code generation on the executors; nothing calls back into Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- Fixed values: patterns that must give the same tokens as the reference ---
# Word tokenizer (Python's Unicode-aware \b\w+\b; Java's bare \w is ASCII only):
P_TOKEN = r"[\p{L}\p{N}_]+"
# Clean-then-split tokenizer: delete URLs and every character that is not a-z
# or whitespace, then split on whitespace (Unicode-aware, so NBSP separates):
P_CLEAN = r"(?U)http\S+|[^a-z\s]"
P_SPACE = r"(?U)\s+"
# Word-character class used for whole-word boundaries:
WORD_CHARS = r"\p{L}\p{N}_"
# Long-text cut and snippet length:
MAX_TEXT_CHARS = 10000
SNIPPET_CHARS = 150
# Word-break classes of the standard analyzer (Unicode text segmentation, rules WB4 to WB13b).
# Scripts written without spaces: an ideograph or hiragana sign is a token of its own, katakana
# and South-East Asian runs are one token each.
SINGLE = r"\p{IsHan}\p{IsHiragana}"
KATAKANA = r"\p{IsKatakana}\u30FC\uFF70\u3031-\u3035\u309B\u309C\u30A0"
COMPLEX = r"\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
EXTEND = r"\p{M}\u00AD\u200C\u200D"     # marks and format characters stay with what they follow
MID_LETTER = r":\u00B7\u0387\u05F4\u2027\uFE13\uFE55\uFF1A"
MID_NUMBER = r",;\u037E\u0589\u060C\u060D\u066C\u07F8\u2044\uFE10\uFE14\uFE50\uFE54\uFF0C\uFF1B"
MID_BOTH = r"'.\u2018\u2019\u2024\uFE52\uFF07\uFF0E"
CONNECTOR = r"\p{Pc}"                     # underscore and its like join words, numbers and katakana
MAX_TOKEN_CHARS = 255                    # longer tokens are cut into pieces of this length
# --- end of fixed values ---


def _word_break_pattern() -> str:
    """One token of the standard analyzer, as the states of its word-break rules.

    letters: a letter, then letters and marks, then any number of (mid-letter character, letters);
    digits: the same with digits and mid-number characters; a word is letters and digits in any
    order, or katakana; connectors join words and may stand at both ends. A mid character between
    a letter and a digit, at an end or doubled is a break. The quantifiers never give back
    characters, and a chain of more than MAX_TOKEN_CHARS mid characters is cut there, so that a
    pathological text costs neither time nor stack.
    """
    # Latin letters come first in the union: most characters are decided by a range comparison
    any_letter = rf"a-z\u00DF-\u00F6\u00F8-\u024F[\p{{L}}\p{{Nl}}&&[^{SINGLE}{KATAKANA}{COMPLEX}]]"
    letter = rf"[{any_letter}]"
    digit = r"\p{Nd}"
    more_letters = rf"[{any_letter}{EXTEND}]*+"
    letters = rf"{letter}{more_letters}(?:[{MID_LETTER}{MID_BOTH}][{EXTEND}]*+{letter}{more_letters}){{0,{MAX_TOKEN_CHARS}}}+"
    digits = rf"{digit}[{digit}{EXTEND}]*+(?:[{MID_NUMBER}{MID_BOTH}][{EXTEND}]*+{digit}[{digit}{EXTEND}]*+){{0,{MAX_TOKEN_CHARS}}}+"
    katakana = rf"[{KATAKANA}][{KATAKANA}{EXTEND}]*+"
    word = rf"(?:(?:{letters}|{digits}){{1,{MAX_TOKEN_CHARS}}}+|{katakana})"
    joined = rf"{word}(?:[{CONNECTOR}][{CONNECTOR}{EXTEND}]*+{word}){{0,{MAX_TOKEN_CHARS}}}+"
    token = rf"[{CONNECTOR}{EXTEND}]*+{joined}[{CONNECTOR}{EXTEND}]*+|[{SINGLE}][{EXTEND}]*+|[{COMPLEX}][{COMPLEX}{EXTEND}]*+"
    # no token starts with an ASCII character other than these: blanks are passed over at once
    return rf"(?![\x00-/:-@\[-^`{{-\x7F])(?:{token})"


P_STANDARD = _word_break_pattern()

# Characters Python's str.strip() removes, built from the rule str.isspace().
PY_WHITESPACE = "".join(c for c in map(chr, range(0x110000)) if c.isspace())


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def word_tokens(text) -> Column:
    """Lower-cased word tokens; one-character tokens are kept."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(P_TOKEN), 0)


def standard_tokens(text) -> Column:
    """Lower-cased tokens of the standard analyzer (word breaks of ``_word_break_pattern``)."""
    tokens = F.regexp_extract_all(F.lower(_col(text)), F.lit(P_STANDARD), 0)
    too_long = F.exists(tokens, lambda t: F.char_length(t) > MAX_TOKEN_CHARS)
    pieces = F.flatten(F.transform(tokens, lambda t: F.regexp_extract_all(t, F.lit(rf"(?s).{{1,{MAX_TOKEN_CHARS}}}"), 0)))
    return F.when(too_long, pieces).otherwise(tokens)


def clean_split(text) -> Column:
    """Lower, delete URLs and non a-z characters, split on whitespace.

    Characters are deleted, not replaced: ``don't`` -> ``dont``, ``a-b`` -> ``ab``.
    """
    cleaned = F.regexp_replace(F.lower(_col(text)), P_CLEAN, "")
    return F.filter(F.split(cleaned, P_SPACE), lambda x: x != "")


TOKENIZERS = {
    "word": word_tokens,
    "standard": standard_tokens,
    "clean": clean_split,
}


def tokenize(text, tokenizer: str = "word") -> Column:
    try:
        return TOKENIZERS[tokenizer](text)
    except KeyError:
        raise ValueError(f"unknown tokenizer {tokenizer!r}; use one of {sorted(TOKENIZERS)}")


def with_token_counts(df: DataFrame, text, tokenizer: str, keep: list[Column]) -> DataFrame:
    """One row for each row of ``df`` and distinct token of its text -> (keep..., term, tf).

    Counted inside the row: the tokens are sorted, and a term's count is the distance between the
    places where it and the next term begin. Nothing is shuffled. A null text gives no rows."""
    sorted_ = df.select(*keep, F.sort_array(tokenize(text, tokenizer)).alias("_s"))
    names = [c for c in sorted_.columns if c != "_s"]
    numbers = F.when(F.size("_s") > 0, F.sequence(F.lit(0), F.size("_s") - 1))
    places = F.filter(numbers, lambda i: (i == 0) | (F.get("_s", i) != F.get("_s", i - 1)))
    begun = sorted_.select(*names, "_s", places.alias("_at"))
    entry = F.transform(
        "_at", lambda a, j: F.struct(F.get("_s", a).alias("term"), (F.coalesce(F.get("_at", j + 1), F.size("_s")) - a).cast("long").alias("tf"))
    )
    return begun.select(*names, F.inline(entry))


def whole_word_pattern(word: str) -> str:
    """Regex matching ``word`` (lower-cased, quoted) as a whole word."""
    return f"(?<![{WORD_CHARS}]){java_quote(word.lower())}(?![{WORD_CHARS}])"


def java_quote(s: str) -> str:
    """Literal-quote ``s`` for a Java regex (as ``Pattern.quote`` does)."""
    return "\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def whole_word_count(text, word: str) -> Column:
    """Occurrences of ``word`` as a whole word in lower-cased text (map side, no explode)."""
    return F.regexp_count(F.lower(_col(text)), F.lit(whole_word_pattern(word)))


def strip(text) -> Column:
    """Python-style strip: removes all Unicode whitespace at both ends (no regex)."""
    return F.btrim(_col(text), F.lit(PY_WHITESPACE))


def is_blank(text) -> Column:
    return F.coalesce(strip(text) == "", F.lit(True))


def snippet(text, n: int = SNIPPET_CHARS) -> Column:
    t = _col(text)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)
