"""Text cleaning, tokenising and joining as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# They must equal the ones users of this data rely on.
PUNCTUATION = "!�“”\"#$%&'()【】（）／《》・*+,-./–:;<=>?@[]^_`{|}~—～’、。"
LINK_PATTERNS = [
    r"https?://[a-z!$-_]+",
    r"<[^>]+>",
    r"\[[^\]]+\]\([^\)]+\)",
    r"\[[^\]]+\]\s*\([^\)]*\)",
    r"\[[^\]]+\]",
    r"\([^\)]+\)",
]
STOP_WORDS = "at based in of for on and to an using with the by we be is are can".split()
ORG_STOP_WORDS = (
    "university univ china department dept laboratory lab school al et institute inst college chinese beijing "
    "journal science international key sciences research academy state center univers scienc depart institut "
    "laboratori"
).split()
PREFIXES = {
    "title": "<title>",
    "abstract": "<abstract>",
    "question": "<question>",
    "body": "<body>",
    "answer": "<llm answer>",
    "summary": "<llm summarize>",
}
SEPARATOR = "[SEP]"

PUNCTUATION_CLASS = "[" + "".join("\\" + c if c in "[]^-\\" else c for c in PUNCTUATION) + "]+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim_all(c) -> Column:
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


def words(c) -> Column:
    """Whitespace-separated words, empty array for blank text."""
    return F.filter(F.split(_c(c), r"(?U)\s+"), lambda w: w != "")


def spaced(c) -> Column:
    """Pieces between single spaces; empty pieces count."""
    return F.split(_c(c), " ")


def clean(c) -> Column:
    """Lower-case text with punctuation and line breaks as single spaces; NULL becomes ''."""
    t = F.lower(trim_all(c))
    t = F.translate(t, "\n \\‐", "    ")
    t = F.regexp_replace(t, PUNCTUATION_CLASS, " ")
    return F.coalesce(trim_all(F.regexp_replace(t, r"(?U)\s{2,}", " ")), F.lit(""))


def digits_to_zero(w: Column) -> Column:
    return F.regexp_replace(w, r"\d+", "0")


def filter_tokens(tokens, stop_words: Sequence[str], stem=None) -> Column:
    """Drop stop words and numbers, digit runs to 0, optional stem, drop tokens of one character."""
    kept = F.filter(_c(tokens), lambda w: ~w.isin(*stop_words) & ~w.rlike(r"^\d+$"))
    mapped = F.transform(kept, digits_to_zero)
    if stem is not None:
        mapped = F.transform(mapped, stem)
    return F.filter(mapped, lambda w: F.length(w) > 1)


def _nothing() -> Column:
    return F.array().cast("array<string>")


def tokens(c, stop_words: Sequence[str]) -> Column:
    """Tokens of an already cleaned text; none for '' and 'null'."""
    c = _c(c)
    return F.when(c.isin("null", ""), _nothing()).otherwise(filter_tokens(spaced(c), stop_words))


def tokens_light(c) -> Column:
    c = _c(c)
    return F.when(c.isin("null", ""), _nothing()).otherwise(F.transform(spaced(c), digits_to_zero))


def org_tokens(c, stop_words: Sequence[str]) -> Column:
    """Distinct sorted tokens of an organisation, ``['NULL']`` when nothing is left."""
    t = F.sort_array(F.array_distinct(filter_tokens(spaced(clean(c)), [*stop_words, *ORG_STOP_WORDS])))
    return F.when(F.size(t) == 0, F.array(F.lit("NULL"))).otherwise(t)


def shorten(c, n: int) -> Column:
    """More than n words: the first and last n//2 with '...' between; else the text as it is."""
    w, half = words(c), n // 2
    ends = F.concat(
        F.array_join(F.slice(w, 1, half), " "), F.lit("..."), F.array_join(F.slice(w, -half, half), " ")
    )
    return F.when(F.size(w) > n, ends).otherwise(_c(c))


def first_words(c, n: int) -> Column:
    return F.array_join(F.slice(spaced(c), 1, n), " ")


def remove_links(c) -> Column:
    out = _c(c)
    for p in LINK_PATTERNS:
        out = F.regexp_replace(out, p, "")
    return out


def remove_special(c) -> Column:
    """Everything that is neither a word character nor white space to a space, then control white space."""
    t = F.regexp_replace(_c(c), r"(?U)[^\w\s]", " ")
    return F.regexp_replace(t, "[\\t\\n\\r\\a\\f\\x0b\\x08]", " ")


def remove_newlines(c) -> Column:
    return F.replace(_c(c), F.lit("\n"), F.lit(""))


def tagged(field: str, c) -> Column:
    return F.concat(F.lit(PREFIXES[field] + " "), _c(c))


def join_sentences(cols: Sequence, default: str) -> Column:
    """Non-empty fields, each ended by exactly one dot, joined; ``default`` when all are empty."""
    ended = [
        F.when(F.length(_c(c)) > 0, F.concat(F.regexp_replace(_c(c), r"\.+$", ""), F.lit("."))).otherwise("")
        for c in cols
    ]
    text = F.concat(*ended)
    return F.when(text == "", F.lit(default)).otherwise(text)


def pair_text(a, b) -> Column:
    return F.concat(_c(a), F.lit(SEPARATOR), _c(b))


def parse_list(c) -> Column:
    """Array from a printed list such as ``['a', 'b']``."""
    return words(F.translate(F.regexp_replace(_c(c), r"[\[\]']", ""), "\n\r,", "   "))


ANSWER_TASK = (
    "You answer technical questions posted on the Internet as a researcher in cutting-edge technology: "
    "straightforward, clear, with the relevant technical keywords."
)
SUMMARY_TASK = (
    "You summarise technical questions posted on the Internet so that they are easy to understand, "
    "with the relevant technical keywords."
)


def prompt(task: str, question) -> Column:
    """Instruction, constraints (150 words at most, no links) and the question."""
    head = f"### Instruction\n{task}\n\n### Constraints\nAt most 150 words.\nNo URLs or links.\n\n### Technical Question\n"
    return F.concat(F.lit(head), _c(question), F.lit("\n\n### Output\n"))


# ---- names ---------------------------------------------------------------------------------------


def canonical_name(c, glue: str = "") -> Column:
    """Order-free form of a cleaned person name built from its first three non-numeric tokens."""
    n = F.filter(spaced(c), lambda w: ~w.rlike(r"^\d+$"))
    at = lambda i: F.get(n, F.lit(i))
    join = lambda *p: F.concat_ws(glue, *p)
    two = F.least(join(at(0), at(1)), join(at(1), at(0)))
    three = F.least(join(at(0), at(1), at(2)), join(at(2), at(1), at(0)))
    return (
        F.when(F.size(n) > 2, three)
        .when(F.size(n) == 2, two)
        .when((F.size(n) == 1) & (at(0) != ""), at(0))
        .otherwise(F.lit("NULL"))
    )


def clean_year(c) -> Column:
    """Year as an integer; 0 and '' are no year."""
    return F.nullif(trim_all(_c(c).cast("string")).try_cast("int"), F.lit(0))


# ---- scripts -------------------------------------------------------------------------------------

CJK = r"[\p{IsHan}\p{InHiragana}\p{IsKatakana}⺀-⿟々-〇]+"


def has_cjk(c) -> Column:
    return _c(c).rlike(CJK)


def cjk_runs(c) -> Column:
    return F.regexp_extract_all(_c(c), F.lit(CJK), F.lit(0))
