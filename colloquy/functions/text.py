"""Column-level text rules. All of it stays in the JVM, but for rare characters and entities."""
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from colloquy import constants as K
from colloquy.functions.probs import let

# ASCII, Latin-1 letters and the apostrophe variants: text made of these is unchanged by NFKC. Judged in one possessive
# pass from the start: a search for a character outside the class begins anew at every place, which is many times slower.
_NFKC_ALREADY = "\\A[\\x00-\\x7FÀ-ÿ‘’ʼ–—“”]*+\\z"
# The same without the apostrophe variants: text made of these needs no character mapping at all.
_UNMAPPED = "\\A[\\x00-\\x5F\\x61-\\x7FÀ-ÿ–—“”]*+\\z"


def _compat_table() -> tuple[str, str]:
    """Single characters whose NFKC form is one other character, by rule from the Unicode data."""
    pairs = [(chr(c), unicodedata.normalize("NFKC", chr(c))) for c in range(0xA0, 0x10000)
             if not 0xD800 <= c < 0xE000]
    pairs = [(a, b) for a, b in pairs if a != b and len(b) == 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_COMPAT_FROM, _COMPAT_TO = _compat_table()


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(text: Column) -> Column:
    """NFKC of any text. Rows without characters that may change send only NULLs to the Arrow UDF."""
    return F.coalesce(_nfkc(F.when(~text.rlike(_NFKC_ALREADY), text)), text)


def nfkc_stable(df: DataFrame, *cols: str) -> DataFrame:
    """NFKC for the given columns, once, at ingest."""
    for c in cols:
        df = df.withColumn(c, nfkc(F.col(c)))
    return df


def normalize_text(text: Column) -> Column:
    """Recogniser-style text: lower case, letters/digits/marks/inner apostrophes, single spaces.

    Ordinary text takes one scan, one lower-casing and one replacement; mapping characters and
    judging apostrophes happens only where there are any.
    """
    def spaced(s: Column) -> Column:
        return F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}\p{M}']+", " ")

    def judged(s: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(
            spaced(s), r"(?<![\p{L}\p{N}])'|'(?![\p{L}\p{N}])", " "), " +", " ")

    def mapped(t: Column) -> Column:
        return F.when(~t.rlike(_UNMAPPED), F.regexp_replace(F.translate(t, _COMPAT_FROM, _COMPAT_TO), "[’‘ʼ`]", "'")).otherwise(t)

    return F.trim(let(let(text, mapped), lambda s: F.when(F.contains(s, F.lit("'")), judged(s)).otherwise(spaced(s))))


def normalize_any(text: Column) -> Column:
    """`normalize_text` of text that was not made NFKC at ingest. Not for use inside array functions."""
    return normalize_text(nfkc(text))


def words(normalized: Column) -> Column:
    """Words of already single-spaced text; empty text has no words."""
    return F.when(normalized == "", F.array().cast("array<string>")).otherwise(
        F.split(normalized, " "))


def padded(number: Column, width: int) -> Column:
    """Digits with leading zeros up to `width`; longer numbers stay whole."""
    digits = number.cast("string")
    return F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), F.lit("0"))


def n_words(normalized: Column) -> Column:
    return F.when(normalized == "", F.lit(0)).otherwise(
        F.length(normalized) - F.length(F.replace(normalized, F.lit(" "), F.lit(""))) + 1)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clean_transcript(raw: Column) -> Column:
    s = F.regexp_replace(raw, r"<<[^<>]*>>", " ")
    s = F.regexp_replace(s, r"<[^<>]*>", " ")
    s = F.regexp_replace(s, r"(?U)\{[FDCEA]\s", " ")
    s = F.regexp_replace(s, r"(?U)-/|--|/|#|\(\(|\)\)|[\[\]{}+]|(?<!\S)-(?!\S)", " ")
    s = F.regexp_replace(s, r"(?U)\s+([,.?!])", "$1")
    s = F.regexp_replace(s, r"(?U)(^|\s)[,.]+(?=\s|$)", " ")
    return collapse(s)


_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
             ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


def unescape_common(text: Column) -> Column:
    """The entities that messages carry in practice; `&amp;` last so nothing is unescaped twice."""
    s = text
    for name, char in _ENTITIES:
        s = F.replace(s, F.lit(name), F.lit(char))
    return F.when(F.contains(text, F.lit("&")), s).otherwise(text)


@F.pandas_udf(StringType())
def _unescape_rest(s: pd.Series) -> pd.Series:
    import html

    return s.map(lambda t: None if t is None else html.unescape(t))


def unescape(text: Column) -> Column:
    """All HTML entities, once. Only texts with one outside the common set go through Arrow."""
    common = "|".join(name[1:] for name, _ in _ENTITIES)
    rare = text.rlike(f"&(?!(?:{common}))#?\\w+")
    return F.coalesce(_unescape_rest(F.when(rare, text)), unescape_common(text))


def clean_message(text: Column, is_agent: Column) -> Column:
    """A raw message without entities, links, mentions, masks and agents' signatures."""
    s = F.regexp_replace(unescape(text), r"(?U)https?://\S+", " ")
    s = F.regexp_replace(s, r"(?U)@\w+", " ")
    s = collapse(F.regexp_replace(s, r"(?U)__\w+__", " "))
    signed = F.regexp_replace(s, r"(?U)\s[\^*~]\s?[A-Za-z]{1,12}\s*$", "")
    return F.trim(F.when(is_agent, signed).otherwise(s))


def act_class(act_tag: Column) -> Column:
    tag = F.element_at(F.split(act_tag, r"\s*[,;]\s*"), 1)
    base = F.regexp_replace(F.regexp_replace(tag, r"(.)\^.*", "$1"), r"[()@*]", "")
    merged = base
    for group in dict.fromkeys(K.MERGED_TAGS.values()):
        merged = F.when(base.isin([t for t, g in K.MERGED_TAGS.items() if g == group]),
                        group).otherwise(merged)
    out = F.when(tag.isin(*K.WHOLE_TAGS), tag)
    for old, new in K.RENAMED_TAGS.items():
        out = out.when(tag == old, new)
    return out.otherwise(merged)


def is_minor(act: Column, normalized: Column, max_words: int = K.MINIMAL_MAX_WORDS) -> Column:
    return act.isin(*K.BACKCHANNEL_TAGS, *K.NOISE_TAGS) | (
        act.isin(*K.MINIMAL_RESPONSE_TAGS) & (n_words(normalized) <= max_words))


def ends_unit(raw: Column) -> Column:
    r = F.regexp_replace(raw, r"(?U)\s+$", "")
    return r.endswith("/") & ~r.endswith("-/")


def abandoned(raw: Column) -> Column:
    return F.regexp_replace(raw, r"(?U)\s+$", "").endswith("-/")


def claims_floor(minor: Column, normalized: Column) -> Column:
    return ~minor & (normalized != "")


def _count_in(found: Column, vocabulary) -> Column:
    lookup = F.array(*[F.lit(w) for w in dict.fromkeys(vocabulary)])
    return F.size(F.filter(found, lambda w: F.array_contains(lookup, w)))


def looks_english(text: Column) -> Column:
    ascii_share = F.length(F.regexp_replace(text, r"[^\x00-\x7F]", "")) / F.length(text)
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z']+"), F.lit(0))
    english, other = _count_in(found, K.ENGLISH_WORDS), _count_in(found, K.OTHER_LANGUAGE_WORDS)
    return F.when(text == "", False).otherwise(
        (ascii_share > 0.97) & (english >= 1) & (english > other))


def cue_flag(text: Column) -> Column:
    return text.rlike("(?iU)" + K.ESCALATION_CUES)


def last_word(normalized: Column) -> Column:
    return F.substring_index(normalized, " ", -1)


def opens_with(normalized: Column, form: Column) -> Column:
    return (normalized == form) | F.startswith(normalized, F.concat(form, F.lit(" ")))


def first_words(text: Column, n: int) -> Column:
    return F.substring_index(collapse(text), " ", n)


def ngram_features(user: Column, context: Column) -> Column:
    """User 1- and 2-grams, then context words tagged `ctx:`. Both inputs are normalised text."""
    def grams(u: Column) -> Column:
        most = F.greatest(F.size(u) - 1, F.lit(0))
        return F.concat(u, F.zip_with(F.slice(u, 1, most), F.slice(u, 2, most), lambda a, b: F.concat_ws(" ", a, b)))

    return F.concat(let(let(user, words), grams), F.transform(let(context, words), lambda w: F.concat(F.lit("ctx:"), w)))


def lexical_branch(normalized: Column) -> Column:
    w = words(normalized)
    fillers = F.array(*[F.lit(x) for x in K.FILLER_WORDS])
    back = F.array(*[F.lit(x) for x in K.BACKCHANNEL_WORDS])
    return (F.when(F.size(F.array_except(w, fillers)) == 0, "empty_or_filler")
            .when((F.size(w) <= 3) & (F.size(F.array_except(w, back)) == 0), "backchannel_words")
            .otherwise("other"))


def json_string(text: Column) -> Column:
    """One JSON string literal, non-ASCII kept."""
    quoted = F.to_json(F.array(F.coalesce(text, F.lit(""))))
    return F.substring(quoted, F.lit(2), F.length(quoted) - 2)


def serialize_state(state: Column) -> Column:
    """The four state fields as one JSON text, in fixed order, with ", " and ": " separators."""
    turns = F.transform(state["recent_turns"], lambda t: F.concat(
        F.lit('{"speaker": '), json_string(t["speaker"]), F.lit(', "text": '),
        json_string(t["text"]), F.lit("}")))
    return F.concat(
        F.lit('{"agent_speaking": '), state["agent_speaking"].cast("string"),
        F.lit(', "recent_turns": ['), F.array_join(turns, ", "),
        F.lit('], "agent_last_utterance": '), json_string(state["agent_last_utterance"]),
        F.lit(', "user_partial": '), json_string(state["user_partial"]), F.lit("}"))


def opener_pick(row_id: Column) -> Column:
    from colloquy.functions.hashing import hex_int

    i = hex_int(F.sha2(row_id, 256), 1, 8) % len(K.AGENT_OPENERS)
    return F.element_at(F.array(*[F.lit(o) for o in K.AGENT_OPENERS]), (i + 1).cast("int"))


def stratum(cue: Column, agent_last: Column) -> Column:
    return F.concat(F.when(cue, "cue").otherwise("plain"), F.lit("/"),
                    F.when(F.coalesce(agent_last, F.lit("")) != "", "reply").otherwise("opener"))


def labeller_prompt(turns: Column, agent_last: Column, message: Column) -> Column:
    tail = F.slice(turns, F.greatest(F.size(turns) - 1, F.lit(1)), 2)
    lines = F.array_join(F.transform(tail, lambda t: F.concat_ws(": ", t.speaker, t.text)), "\n")
    return F.concat(
        F.lit("Earlier turns:\n"), F.when(F.size(turns) > 0, lines).otherwise("(none)"),
        F.lit("\n\nAgent's last reply:\n"),
        F.when(F.coalesce(agent_last, F.lit("")) != "", agent_last).otherwise(
            "(none: the customer opened the thread)"),
        F.lit("\n\nCustomer's message:\n"), message)


def baseline_prompt(state_json: Column, event: str) -> Column:
    parts = []
    for q in K.EVENT_QUESTIONS[event]:
        options = "\n".join(f"  - {label}: {text}" for label, text in zip(
            K.DECISION_LABELS[q], K.OPTION_TEXT[q]))
        parts.append(f'Question "{q}": {K.QUESTION_TEXT[q]}\nOptions:\n{options}')
    return F.concat(F.lit("State:\n"), state_json, F.lit("\n\n" + "\n\n".join(parts)))
