"""Language codes and their names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes and names of the languages that can be translated into.
NAMES = {
    "en": "English", "de": "German", "it": "Italian", "fr": "French", "pt": "Portuguese", "sq": "Albanian", "es": "Spanish", "uk": "Ukrainian", "ru": "Russian", "sh": "Serbo-Croatian", "tr": "Turkish",
    "nl": "Dutch", "pl": "Polish", "zh": "Chinese", "ja": "Japanese", "ko": "Korean", "ar": "Arabic", "hi": "Hindi", "vi": "Vietnamese", "th": "Thai", "sv": "Swedish", "da": "Danish", "no": "Norwegian", "fi": "Finnish", "cs": "Czech", "el": "Greek", "he": "Hebrew", "ro": "Romanian", "hu": "Hungarian",
    "bg": "Bulgarian", "hr": "Croatian", "sr": "Serbian", "bs": "Bosnian", "mk": "Macedonian", "sl": "Slovenian", "sk": "Slovak", "et": "Estonian", "lv": "Latvian", "lt": "Lithuanian", "ga": "Irish", "mt": "Maltese", "is": "Icelandic",
    "id": "Indonesian", "ms": "Malay", "tl": "Tagalog", "bn": "Bengali", "ta": "Tamil", "te": "Telugu", "mr": "Marathi", "ur": "Urdu", "fa": "Persian",
    "af": "Afrikaans", "sw": "Swahili", "zu": "Zulu", "am": "Amharic", "eu": "Basque", "ca": "Catalan", "gl": "Galician", "cy": "Welsh", "br": "Breton",
}


def language_name(code: Column) -> Column:
    """The name, or the code itself if it is not known."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in NAMES.items() for x in kv)), code), code)


def supported(code: Column) -> Column:
    return F.coalesce(code.isin(*NAMES), F.lit(False))


def needs_translation(wanted: Column, detected: Column) -> Column:
    return F.coalesce(wanted, F.lit("")).cast("string").rlike(".") & (F.lower(wanted) != F.lower(F.coalesce(detected, F.lit(""))))
