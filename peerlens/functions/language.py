"""Language of a text by a vote of its function words, and by script for scripts that decide it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peerlens.functions import text as X
from peerlens.runtime import spread

# Frequent function words per language.
FUNCTION_WORDS = {
    "de": "der die das und zu den von mit ist des dem nicht ein eine auf für sich auch als werden",
    "en": "the of and to in is that for it with as was on by this are from or an which",
    "es": "el los las del que en un una por con para no es se al como más su pero sus",
    "fr": "le la les des du et est un une dans pour qui que sur au par plus ne pas avec",
    "it": "il di che è della per un una con non sono del alla nel dei le gli più anche come",
    "ru": "и в не на что с по как это из у за от так к но для же то его",
}
KNOWN = ["en", "de", "zh", "fr", "es", "ru", "it"]
# Unicode blocks of the scripts that decide a language.
HAN, KANA = r"[\u3400-\u4DBF\u4E00-\u9FFF]", r"[\u3040-\u30FF]"


def votes(words) -> Column:
    """Per language that has any of its function words among ``words``: (minus their number, language), smallest first."""
    every = sorted({w for ws in FUNCTION_WORDS.values() for w in ws.split()})
    count = lambda own, lang: F.struct((-F.size(F.filter(own, lambda w: w.isin(*FUNCTION_WORDS[lang].split())))).alias("n"), F.lit(lang).alias("lang"))
    # The lambda holds the few function words of the text, so that they are picked once and counted six times.
    counted = F.transform(F.array(F.filter(words, lambda w: w.isin(*every))), lambda own: F.array(*[count(own, lang) for lang in FUNCTION_WORDS]))
    return F.filter(F.element_at(counted, 1), lambda v: v["n"] < 0)


def detect(df: DataFrame, key: str, text: str, name: str = "language") -> DataFrame:
    """Add the language: ``Nothing`` for empty text, ``ja`` with kana, ``zh`` with other Han, else the most voted (ties by name), else ``Other``.

    All inside the row; nothing is shuffled.
    """
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    found = (
        F.when(F.coalesce(F.length(X.trim_all(text)), F.lit(0)) == 0, "Nothing")
        .when(F.col(text).rlike(KANA), "ja")
        .when(F.col(text).rlike(HAN), "zh")
        .otherwise(F.coalesce(F.array_min(votes(words))["lang"], F.lit("Other")))
    )
    return spread(df).withColumn(name, found)
