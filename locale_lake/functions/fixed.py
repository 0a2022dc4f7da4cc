"""The file format and the consumer of the files define them."""

from __future__ import annotations

# --- fixed values: tag names that never hold human text (compared in lower case)
DENIED_TAGS = (
    "defname", "class", "parentname", "workertype", "compclass", "thingclass",
    "texpath", "graphicclass", "shaderclass", "soundtype", "drawertype",
    "researchviewx", "researchviewy", "packageid", "identifier", "hediff",
    "def", "recipeuser", "thingdef", "damagedef", "statdef", "verbclass",
    "jobdef", "workgiverdef", "traitdef", "genedef", "driverclass",
    "jobclass", "workgiverclass", "mentalstateclass",
    "incidentclass", "gizmoclass", "interactionclass",
    "storeas", "tile", "faction", "sitepartdefs", "worldobject", "worldobjects",
    "insignal", "outsignal", "delayticks", "value1", "value2",
    "storesitepartsparamsas", "sitepartsparams",
    "stuffcategories", "thingcategories", "associatedmemes", "conflictingmemes",
    "styles", "altitudelayer", "impact",
    "installablesegmenttypes", "installablemoduleslottypes",
    "installablemoduletypes", "installablesegmentslottypes",
)

# --- fixed values: case-sensitive tag endings that mark a reference
DENIED_SUFFIXES = ("TypeID", "SlotID", "DefName")

# --- fixed values: the characters that count as whitespace
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# --- fixed values: shapes of values that are data, not text
NUMBER = r"^-?\d+(\.\d+)?%?$"
PATH = r"^[\w/\\.-]+$"
HEX_COLOUR = r"^#[0-9A-Fa-f]{3,8}$"
DOTTED_IDENTIFIER = r"^[A-Za-z][A-Za-z0-9_]*(\.[A-Za-z][A-Za-z0-9_]*)+$"
RULE_STRING = r"^([\w.\[\]]+(?:\([^)]*\))?\s*)->(.*)$"
RULE_LIST_TAG = "rulesstrings"

# --- fixed values: markup that must survive translation unchanged
MARKUP = {
    "braces": r"\{\w+\}|\[\w+\]|</?color(?:=[^>]*)?>|\\n|\\r"
              r"|^[\w.\[\]]+(?:\([^)]*\))?\s*->",
    "html": r"<[^>]*>",
}

# --- fixed values: scripts that cannot occur in the named target languages
FOREIGN_SCRIPT = r"[\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7A3}]"
FOREIGN_SCRIPT_TARGETS = ("ru",)

# --- fixed values: thresholds
LONG_TEXT_CHARS = 200
TRIVIAL_MAX_CHARS = 12
TRUNCATION_MIN_WORDS = 4
TRUNCATION_RATIO = 0.7
REWRITE_BATCH = 12
CHECK_BATCH = 20
RETRY_DELAYS_SECONDS = (2, 5, 10, 20)
MIN_ANSWER_TOKENS = 200
ANSWER_TOKENS_PER_ITEM = 60
REQUEST_SECONDS = 120
PARALLEL_REQUESTS = 2
MAX_REQUEST_SECONDS = 480

# --- the stand-in word for a protected term: letters that no language starts a word with
TERM_TOKEN = "Wjx"

# --- fixed values: folder names of languages
LANGUAGE_FOLDERS = {
    "ru": "Russian", "en": "English", "de": "German", "fr": "French",
    "es": "Spanish", "it": "Italian", "pl": "Polish", "pt": "Portuguese",
    "uk": "Ukrainian", "zh": "ChineseSimplified", "ja": "Japanese",
    "ko": "Korean", "cs": "Czech", "nl": "Dutch", "tr": "Turkish",
}

# --- fixed values: articles and determiners that are not nouns
NON_NOUNS = {
    "de": (
        "der", "die", "das", "den", "dem", "des",
        "ein", "eine", "einer", "einem", "einen", "eines",
        "kein", "keine", "keiner", "keinem", "keinen", "keines",
    ),
    "fr": (
        "le", "la", "les", "un", "une", "des", "du", "au", "aux",
        "ce", "cet", "cette", "ces",
    ),
}

# --- fixed values: letters a noun is made of
NOUN_LETTERS = {"ru": "[А-ЯЁа-яё]+"}
NOUN_LETTERS_LATIN = "[A-Za-zÀ-ÖØ-öø-ÿß]+"

# --- fixed values: change operations that can carry text
TEXT_OPERATIONS = ("PatchOperationAdd", "PatchOperationReplace", "PatchOperationInsert")
ADDRESS = r"^/?Defs/([\w.]+)\[([^\]]+)\](?:/(.+))?$"
ADDRESS_NAME = r"""defName\s*=\s*["']([^"']+)["']"""
ADDRESS_ITEM = r"^li\[(\d+)\]$"
ADDRESS_SEGMENT = r"^\w+$"

# --- fixed values: version tags
VERSION_TAG = r"(?i)^v?(\d+)\.(\d+)$"
DEFAULT_VERSION = "1.6"
