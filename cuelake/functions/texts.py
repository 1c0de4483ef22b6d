"""Tokens, cues and references in spoken sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes that contractions end in, and what they stand for.
CONTRACTIONS = (("n't\\b", " not"), ("'re\\b", " are"), ("'ve\\b", " have"), ("'ll\\b", " will"), ("'d\\b", " would"), ("'m\\b", " am"))
# What opens a question, and patterns of each cue of a hook, with the cues' weights.
QUESTION_OPENERS = ("what", "why", "how", "when", "where", "who", "which", "did", "have", "is", "are", "can", "should", "will")
HOOK_PATTERNS = {
    "curiosity_gap": r"\b(secret|mistake|truth|turns out|the thing is|little did|crazy part|actually|realized|surprising|here'?s (the|what|why))\b",
    "second_person": r"\b(you|your|yourself|you're|you've|you'll)\b",
    "superlative": r"\b(best|worst|biggest|only|never|nobody|no one|everyone|always|most|first|hardest|easiest|fastest)\b",
    "negation": r"\b(not|never|don'?t|doesn'?t|didn'?t|can'?t|won'?t|stop|avoid|wrong)\b",
    "numeral": r"\d",
}
HOOK_WEIGHTS = {"question": 0.30, "curiosity_gap": 0.30, "second_person": 0.20, "superlative": 0.15, "negation": 0.10, "numeral": 0.10}
HOOK_WORDS = 15
# Words and phrases by which a sentence points back, and those by which it doesn't.
PRONOUNS = ("he", "she", "it", "they", "him", "her", "them", "his", "hers", "its", "their", "theirs", "himself", "herself", "itself", "themselves")
DEMONSTRATIVES = ("this", "that", "these", "those")
BACKREFS = ("as i said", "as i mentioned", "like i said", "like i mentioned", "as we discussed", "going back to", "back to that", "that's why", "thats why", "which is why", "that's when", "thats when", "so anyway", "anyway", "as a result", "because of that", "after that", "the same thing", "same thing", "that said")
CONNECTIVES = ("so", "and", "but", "then", "now", "well", "okay", "ok", "yeah", "right", "actually", "basically", "obviously", "anyway", "however", "because", "since", "plus", "also", "though", "although")
PLEONASTIC_IT = (
    r"^it\s*'?s?\s+(been|going|about|time|cold|hot|hard|easy|important|possible|impossible|worth|clear|obvious|likely|unlikely|true|false|funny|weird|crazy|nice|good|bad|great|late|early|okay|fine)\b"
    r"|^it\s+(is|was|has|had|will|would|takes|took|seems|seemed|turns|turned|looks|looked|appears|appeared|feels|felt|happens|happened|occurred|matters|mattered)\b"
    r"|^it\s*'?s?\s*(rain|snow|pour|drizzle|hail|thunder)(s|ed|ing)?\b"
    r"|^it\s*'?s\b(?=\s+(a|an|the|not|no|just|only|all|so|too|very|really)\b)"
)
DEICTIC_NOUNS = ("week", "weekend", "month", "year", "morning", "afternoon", "evening", "night", "day", "time", "summer", "winter", "spring", "fall", "season", "video", "channel", "episode", "lesson", "podcast", "series", "clip", "course", "session", "one")
# Phrases that mark a turn in a story.
DISCOURSE_MARKERS = ("but then", "here's the thing", "what nobody tells you", "turns out", "and then", "the truth is", "what i realized", "looking back", "here's what happened", "little did i know", "the crazy part")
QUESTION_WORDS = ("what", "why", "how", "when", "where", "who", "which")


def _words(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def tokens(text: Column) -> Column:
    """Search tokens: runs of letters, digits and apostrophes, in lower case."""
    return _words(F.lower(text), "[a-z0-9']+")


def expand_contractions(text: Column) -> Column:
    for pattern, full in CONTRACTIONS:
        text = F.regexp_replace(text, f"(?i){pattern}", full)
    return text


def terms(text: Column) -> Column:
    """Words of ASCII letters, contractions expanded, in lower case."""
    return _words(expand_contractions(F.lower(text)), r"\b[a-zA-Z]+\b")


def word_count(text: Column) -> Column:
    """Words that white space parts; 0 of a blank text."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def ngrams(words: Column, n: int) -> Column:
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))


def squash(text: Column) -> Column:
    """White space as single spaces, none at the ends, in lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def letters_only(text: Column) -> Column:
    """Lower case without what is neither letter, digit nor space."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9 ]", "")


def first_words(text: Column, n: int, mark: str = "...") -> Column:
    """The first n words, with a mark if there were more."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.when(F.size(words) <= n, F.array_join(words, " ")).otherwise(F.concat(F.array_join(F.slice(words, 1, n), " "), F.lit(mark)))


def hook_cues(text: Column) -> dict[str, Column]:
    """Each cue as 0.0 or 1.0, from the first HOOK_WORDS words."""
    window = F.slice(tokens(text), 1, HOOK_WORDS)
    joined = F.array_join(window, " ")
    asks = F.lower(F.trim(text)).endswith("?") | F.coalesce(F.get(window, F.lit(0)).isin(*QUESTION_OPENERS), F.lit(False))
    return {"question": asks.cast("double")} | {name: joined.rlike(pattern).cast("double") for name, pattern in HOOK_PATTERNS.items()}


def hook_lexical(text: Column) -> Column:
    """The cues' weighted sum, 1 at most."""
    cues = hook_cues(text)
    return F.least(F.lit(1.0), sum((cues[k] * w for k, w in HOOK_WEIGHTS.items()), F.lit(0.0)))


def _head(token: Column) -> Column:
    return F.split_part(token, F.lit("'"), F.lit(1))


def points_back(text: Column) -> Column:
    """Whether a sentence, as an opening line, refers to something said before. Its words are found once and bound to a lambda's name."""
    low = F.lower(F.trim(text))

    def by_word(words: Column) -> Column:
        leads = [F.coalesce(F.get(words, F.lit(k)).isin(*CONNECTIVES), F.lit(False)) for k in range(3)]
        skip = F.when(~leads[0], 0).when(~leads[1], 1).when(~leads[2], 2).otherwise(3)
        first = _head(F.get(words, skip))
        second = F.coalesce(_head(F.get(words, skip + 1)), F.lit(""))
        rest = F.array_join(F.slice(words, skip + 1, F.size(words)), " ")
        return F.when(first == "it", ~rest.rlike("(?i)" + PLEONASTIC_IT)).when(first.isin(*PRONOUNS), True).when(first.isin(*DEMONSTRATIVES), ~second.isin(*DEICTIC_NOUNS)).otherwise(False)

    back = low.rlike("^(" + "|".join(BACKREFS) + ")")
    said = F.get(F.transform(F.array(_words(low, "[a-zA-Z']+")), by_word), F.lit(0))
    return F.when(F.coalesce(low, F.lit("")) == "", False).when(back, True).otherwise(F.coalesce(said, F.lit(False)))


def without_phrases(text: Column, phrases: list[str]) -> Column:
    """The text without whole occurrences of the phrases, white space and punctuation mended."""
    for phrase in phrases:
        text = F.regexp_replace(text, rf"(?i)(?<!\w)\Q{phrase}\E(?!\w)", "")
    text = F.regexp_replace(text, r"\s+", " ")
    return F.trim(F.regexp_replace(text, r" +([,.;:!?])", "$1"))


def video_id(url: Column) -> Column:
    """The 11 characters that name a video, from an address or as they are; null if there are none."""
    found = F.regexp_extract(url, r"(?:v=|youtu\.be/|/shorts/|/embed/)([A-Za-z0-9_-]{11})", 1)
    return F.when(found != "", found).when(url.rlike("^[A-Za-z0-9_-]{11}$"), url)


def content_id(content: Column, prefix: str = "local-") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(content), 1, 12))


def host(url: Column) -> Column:
    return F.lower(F.parse_url(url, F.lit("HOST")))


def title_of(name: Column) -> Column:
    """A file's name without its ending as a title."""
    return F.initcap(F.regexp_replace(F.regexp_replace(name, r"\.[A-Za-z0-9]+$", ""), "[-_]+", " "))
