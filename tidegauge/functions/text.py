"""Text helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidegauge.runtime import ladder

# Keyword lists of the feedback classes, in order of precedence.
BUG_PHRASES = ["crash", "error", "exception", "broke", "fails", "doesn't work", "stack trace", "silently"]
FEATURE_PHRASES = ["could you add", "would be nice", "feature request", "wish", "suggestion", "support for"]
QUESTION_PHRASES = ["how do i", "where is", "what does", "why does", "?"]

# Emoji of turn-in commands.
FILM, CAMERA, LINK, GROUP = "\U0001F39E", "\U0001F4F8", "\U0001F517", "\U0001F91C"

# Patterns for text that must not be published.
SENSITIVE = {
    "account_id": r"\b7656119\d{10}\b",
    "credential_assignment": r"(?i)\b(?:client[_ -]?access[_ -]?key|enrollment[_ -]?(?:key|token)|bearer|password|"
                             r"invite[_ -]?token)\s*[=:]\s*[\"']?[A-Za-z0-9+/_=-]{12,}",
    "credential_query": r"(?i)[?&](?:access[_-]?key|bearer|invite|key|token)=[^&\s]{8,}",
    "private_path": r"(?i)C:\\Users\\[A-Za-z0-9._-]+\\",
    "ipv4": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
}


def contains_any(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


def slug(text: Column, sep: str = "-", fallback: str = "") -> Column:
    """Lower case, runs of other characters to one separator, separators trimmed off the ends."""
    low = F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), "[^a-z0-9]+", sep)
    return F.coalesce(F.nullif(F.trim(low, F.lit(sep)), F.lit("")), F.lit(fallback))


def clean_name(text: Column, prefix: str = "", width: int = 40) -> Column:
    """Display name: white space collapsed, quotes and an optional leading word removed, cut to a width."""
    flat = F.trim(F.trim(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), F.lit('"')))
    if prefix:
        flat = F.regexp_replace(flat, rf"(?i)^(the\s+)?{prefix}\s+", "")
    return F.substring(flat, 1, width)


def fold_key(text: Column) -> Column:
    """Comparison key: part before the dot mark, lower case, no apostrophes, one final ``s`` of longer words removed."""
    base = F.lower(F.regexp_replace(F.element_at(F.split(text, " \u00b7 "), 1), "'", ""))
    words = F.filter(F.split(base, r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.when(F.length(w) > 3, F.regexp_replace(w, "s$", ""))
                                    .otherwise(w)), " ")


def detail_kv(detail: Column, name: str, kind: str = "string") -> Column:
    """Value of a ``name=value`` token bounded by white space; NULL when absent or of another type."""
    found = F.regexp_extract(detail, rf"(?:^|\s){name}=(\S+)", 1)
    return F.nullif(found, F.lit("")).try_cast(kind)


def natural_key(text: Column) -> Column:
    """Letters, number (-1 without one), letters - so that ``t2`` sorts before ``t10``; other texts sort by themselves."""
    pattern = r"^([A-Za-z]*)(\d*)([A-Za-z]*)$"
    fits = text.rlike(pattern)
    return F.struct(F.when(fits, F.regexp_extract(text, pattern, 1)).otherwise(text).alias("head"),
                    F.when(fits, F.coalesce(F.regexp_extract(text, pattern, 2).try_cast("bigint"), F.lit(-1)))
                    .otherwise(F.lit(0)).alias("number"),
                    F.when(fits, F.regexp_extract(text, pattern, 3)).otherwise("").alias("rest"))


def first_sentence(text: Column) -> Column:
    """Up to the first sentence end; the whole text when there is none."""
    flat = F.trim(F.coalesce(text, F.lit("")))
    return F.coalesce(F.nullif(F.regexp_extract(flat, r"(?s)^(.*?[.!?])(?:\s|$)", 1), F.lit("")), flat)


def sheet_letter(index: Column) -> Column:
    """0-based column index to spreadsheet letters (A..Z, AA..ZZ, AAA..), for any BIGINT; null below 0."""
    start = F.struct(F.lit("").alias("text"), index.cast("bigint").alias("left"))

    def step(done: Column, _: Column) -> Column:
        letter = F.char(F.lit(65) + F.pmod(done["left"], F.lit(26)).cast("int"))
        more = F.struct(F.concat(letter, done["text"]).alias("text"), (F.call_function("div", done["left"], F.lit(26)) - 1).cast("bigint").alias("left"))
        return F.when(done["left"] >= 0, more).otherwise(done)
    # 14 letters name more columns than a BIGINT can count
    return F.when(index >= 0, F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step, lambda done: done["text"]))


def classify(text: Column) -> Column:
    """bug, feature, question or NULL: first list with a hit."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return ladder((contains_any(low, BUG_PHRASES), "bug"), (contains_any(low, FEATURE_PHRASES), "feature"),
                  (contains_any(low, QUESTION_PHRASES), "question"))


def evidence_spec(command: Column, requirements: Column) -> Column:
    """What a turn-in asks for, from the empty ``slot:`` marks of its command and the emoji of its text."""
    command = F.coalesce(command, F.lit(""))
    slots = F.regexp_extract_all(command, F.lit(r"(\w+):(?=\s|$)"), 1)
    images = F.filter(slots, lambda s: s.rlike(r"^image\d*$"))
    return F.struct(
        F.size(images).alias("screenshots"),
        F.coalesce(requirements, F.lit("")).contains(FILM).alias("video_alternative"),
        command.contains("summons_url:").alias("link"),
        command.contains("participants:").alias("group_turnin"),
        (command.contains("summons_notes:") | command.contains("badge_notes:")).alias("notes"))


def credited_name(command: Column) -> Column:
    """Value of the parameter naming what the command credits; NULL when the parameter is missing."""
    pattern = r"(?:summons_type|badge_name):\s*(.*?)(?=\s+\w+:|$)"
    return F.when(command.rlike(r"(?:summons_type|badge_name):"), F.trim(F.regexp_extract(command, pattern, 1)))


def browser_family(agent: Column) -> Column:
    """First known browser tag in an agent string and whether the device is mobile."""
    # Tag order matters, later families carry earlier tags too.
    tags = [("Edg", "Edge"), ("OPR", "Opera"), ("Chrome", "Chrome"), ("Firefox", "Firefox"), ("Safari", "Safari")]
    mobile = ["Android", "iPhone", "iPad", "Mobile"]
    agent = F.coalesce(agent, F.lit(""))
    name = ladder(*[(agent.contains(tag), label) for tag, label in tags], default="other")
    return F.concat(name, F.lit(" / "), F.when(contains_any(agent, mobile), "Mobile").otherwise("Desktop"))
