"""Languages of titles and pages."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Language(NamedTuple):
    name: str
    tag: str
    english: str


# fixed values: languages of the site in their own name, subtag and English name
LANGUAGES = [
    Language("العربية", "ar", "Arabic"),
    Language("Bosanski", "bs", "Bosnian"),
    Language("Български", "bg", "Bulgarian"),
    Language("বাংলা", "bn", "Bangla"),
    Language("Català", "ca", "Catalan"),
    Language("Čeština", "cs", "Czech"),
    Language("Dansk", "da", "Danish"),
    Language("Deutsch", "de", "German"),
    Language("Ελληνικά", "el", "Greek"),
    Language("English", "en", "English"),
    Language("Esperanto", "eo", "Esperanto"),
    Language("Español", "es", "Spanish"),
    Language("فارسی", "fa", "Persian"),
    Language("Suomi", "fi", "Finnish"),
    Language("Français", "fr", "French"),
    Language("עברית", "he", "Hebrew"),
    Language("हिन्दी", "hi", "Hindi"),
    Language("Hrvatski", "hr", "Croatian"),
    Language("Magyar", "hu", "Hungarian"),
    Language("Bahasa Indonesia", "id", "Indonesian"),
    Language("Italiano", "it", "Italian"),
    Language("日本語", "ja", "Japanese"),
    Language("한국어", "ko", "Korean"),
    Language("Lietuvių", "lt", "Lithuanian"),
    Language("文言文", "lzh", "Chinese (Classical)"),
    Language("Norsk Bokmål", "nb", "Norwegian (Bokmål)"),
    Language("Nederlands", "nl", "Dutch"),
    Language("Polski", "pl", "Polish"),
    Language("Português", "pt", "Portuguese"),
    Language("Română", "ro", "Romanian"),
    Language("Русский", "ru", "Russian"),
    Language("Slovenčina", "sk", "Slovak"),
    Language("Slovenščina", "sl", "Slovenian"),
    Language("Српски", "sr", "Serbian"),
    Language("Svenska", "sv", "Swedish"),
    Language("ไทย", "th", "Thai"),
    Language("Türkçe", "tr", "Turkish"),
    Language("Українська", "uk", "Ukrainian"),
    Language("Tiếng Việt", "vi", "Vietnamese"),
    Language("粵語", "yue", "Cantonese"),
    Language("简体中文", "zh-hans", "Chinese (Simplified)"),
    Language("正體中文", "zh-hant", "Chinese (Traditional)"),
]
# fixed values: languages written from right to left
RTL_TAGS = ["ar", "he"]
# fixed values: languages with a wiki of their own
EXTERNAL_TAGS = ["de", "ja", "sv", "zh-hans"]
# fixed values: languages of this wiki
INTERNAL_TAGS = [
    "ar", "bs", "bg", "ca", "cs", "da", "el", "en", "es", "fi", "fr", "he", "hr", "hu", "id", "it", "ko", "lt", "nl",
    "pl", "pt", "ru", "sk", "sr", "th", "tr", "uk", "zh-hant",
]
# fixed values: tags that HTML spells otherwise
HTML_CODES = {"zh-hans": "zh-Hans", "zh-hant": "zh-Hant"}

LOCAL_LANGUAGE = "English"
LANGUAGE_NAMES = [lang.name for lang in LANGUAGES]
LANGUAGE_TAGS = [lang.tag for lang in LANGUAGES]
INTERLANGUAGE_TAGS = EXTERNAL_TAGS + INTERNAL_TAGS

_SUFFIXED = r"^(.*?)[ _]\(([^()]+)\)$"
_MASTER_CATEGORY = r"^[Cc]ategory[ _]?:[ _]?([^()]+)$"


def language_table(spark: SparkSession) -> DataFrame:
    """The 42 languages as a small table: name, tag, english, internal, external, rtl."""
    rows = [
        (x.name, x.tag, x.english, x.tag in INTERNAL_TAGS, x.tag in EXTERNAL_TAGS, x.tag in RTL_TAGS)
        for x in LANGUAGES
    ]
    return spark.createDataFrame(
        rows, "name string, tag string, english string, internal boolean, external boolean, rtl boolean"
    )


def _lookup(column: Column, pairs: list[tuple[str, str]]) -> Column:
    mapping = F.create_map(*[F.lit(part) for pair in pairs for part in pair])
    return F.try_element_at(mapping, column)


def tag_of_language(name: Column) -> Column:
    return _lookup(name, [(x.name, x.tag) for x in LANGUAGES])


def language_of_tag(tag: Column) -> Column:
    return _lookup(F.lower(tag), [(x.tag, x.name) for x in LANGUAGES])


def _suffix_language(title: Column) -> Column:
    """Language name in the parentheses that decide, '' when the title has no such part."""
    whole = F.regexp_extract(title, _SUFFIXED, 2)
    base = F.regexp_extract(F.substring_index(title, "/", 1), _SUFFIXED, 2)
    category = F.regexp_extract(title, _MASTER_CATEGORY, 1)
    return (
        F.when(title.rlike(_SUFFIXED), whole)
        .when(F.contains(title, F.lit("/")) & F.substring_index(title, "/", 1).rlike(_SUFFIXED), base)
        .otherwise(category)
    )


def title_language(title: Column) -> Column:
    """Language of a title in its localised form; titles without a known one are English."""
    found = _suffix_language(title)
    return F.when(found.isin(LANGUAGE_NAMES), found).otherwise(F.lit(LOCAL_LANGUAGE))


def pure_title(title: Column, every_part: bool = True) -> Column:
    """Title without the language suffix of the page and, by default, of its subpage parts."""
    found = _suffix_language(title)
    first = F.substring_index(title, "/", 1)
    whole = title.rlike(_SUFFIXED)
    base = F.contains(title, F.lit("/")) & first.rlike(_SUFFIXED)
    stripped = F.when(whole, F.regexp_extract(title, _SUFFIXED, 1)).otherwise(
        F.when(base, F.regexp_extract(first, _SUFFIXED, 1)).otherwise(title)
    )
    rest = F.when(~whole & base, F.substring(title, F.length(first) + 1, F.length(title))).otherwise("")
    if every_part:
        same_language = lambda part: F.regexp_extract(part, _SUFFIXED, 2) == found
        parts = F.transform(
            F.split(stripped, "/"),
            lambda part: F.when(same_language(part), F.regexp_extract(part, _SUFFIXED, 1)).otherwise(part),
        )
        stripped = F.array_join(parts, "/")
    return F.when(found.isin(LANGUAGE_NAMES), F.concat(stripped, rest)).otherwise(title)


def localized_title(title: Column, language: Column, every_part: bool = True) -> Column:
    """Inverse of :func:`pure_title`; NULL for an unknown language name."""
    suffix = F.concat(F.lit(" ("), language, F.lit(")"))
    internal = tag_of_language(language).isin(INTERNAL_TAGS)
    parts = F.array_join(F.transform(F.split(title, "/"), lambda part: F.concat(part, suffix)), "/")
    all_parts = internal & F.contains(title, F.lit("/")) & F.lit(every_part)
    return (
        F.when(~language.isin(LANGUAGE_NAMES), F.lit(None).cast("string"))
        .when(language == LOCAL_LANGUAGE, title)
        .when(F.lower(title) == F.concat(F.lit("category:"), F.lower(language)), title)
        .when(all_parts, parts)
        .otherwise(F.concat(title, suffix))
    )


def html_code(tag: Column) -> Column:
    return F.coalesce(_lookup(tag, list(HTML_CODES.items())), tag)


def text_direction(tag: Column) -> Column:
    return F.when(tag.isin(RTL_TAGS), F.lit("rtl")).otherwise(F.lit("ltr"))
