"""Text functions. All return Columns of built-in expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L

# The patterns of tokens and of capital phrases.
TOKEN = r"[A-Za-z0-9][A-Za-z0-9\-\._]*"
CAPS = r"\b(?:[A-Z0-9][A-Z0-9/\-]*(?:\s+[A-Z0-9][A-Z0-9/\-]*){0,4})\b"


def _all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(0))


def words(values: Iterable[str]) -> Column:
    return F.array(*map(F.lit, values))


def contains_any(c: Column, values: Iterable[str]) -> Column:
    """Whether any of the strings stands anywhere in ``c``, inside words too."""
    return F.exists(words(values), lambda w: F.contains(F.coalesce(c, F.lit("")), w))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def collapse(c: Column, width: int | None = None) -> Column:
    out = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    return out if width is None else F.left(out, F.lit(width))


def tokenize(c: Column) -> Column:
    """Tokens in order; lower case unless they hold a digit."""
    # Most are in lower case already and aren't searched for a digit.
    return F.transform(_all(c, TOKEN), lambda t: F.when((F.lower(t) == t) | t.rlike("[0-9]"), t).otherwise(F.lower(t)))


def distinct_ignoring_case(terms: Column) -> Column:
    """First of each term whatever its case, in order."""
    return F.filter(terms, lambda t, i: F.array_position(F.transform(terms, F.lower), F.lower(t)) == i + 1)


def salient_terms(c: Column) -> Column:
    """Capital phrases, then fault words, without repeats."""
    caps = F.filter(
        F.transform(_all(c, CAPS), strip),
        lambda p: (F.length(p) >= 3) & ~F.upper(p).isin(*L.CAPS_STOP) & ~p.rlike("^[0-9]+$"),
    )
    faults = F.filter(words(L.FAULT_WORDS), lambda w: F.contains(F.lower(F.coalesce(c, F.lit(""))), w))
    return F.get(F.transform(F.array(F.concat(caps, faults)), distinct_ignoring_case), F.lit(0))


def salience(c: Column) -> Column:
    return F.array_join(salient_terms(c), " ")


def fallback_tokens(c: Column) -> Column:
    return F.filter(tokenize(c), lambda t: (F.length(t) >= 3) & ~t.isin(*L.FALLBACK_STOP))


def terms(c: Column, pattern: str, stop: Iterable[str] = ()) -> Column:
    """Lower-cased matches of ``pattern`` in order, stop words left out."""
    found, stop = _all(F.lower(c), pattern), tuple(stop)
    return F.filter(found, lambda t: ~t.isin(*stop)) if stop else found


def content_terms(c: Column) -> Column:
    return F.array_distinct(terms(c, r"[a-z][a-z\-]{3,}", L.GENERAL_WORDS))


def scorer_words(c: Column) -> Column:
    return terms(c, r"[a-z][a-z\-]{2,}", L.SCORER_STOP)


def short_terms(c: Column) -> Column:
    return terms(c, r"[a-z0-9]{3,}")


def exact_part_words(c: Column) -> Column:
    """Words of four letters or more, without the component study's own stop list."""
    return terms(c, r"[a-z][a-z\-]{3,}", L.COMPONENT_STOP)


def where_words(c: Column) -> Column:
    """Words of four letters or more, without the location study's own stop list."""
    return terms(c, r"[a-z][a-z\-]{3,}", L.LOCATION_STOP)


def alnum_tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits, in order."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")


def long_tokens(c: Column, least: int = 3) -> Column:
    """``alnum_tokens`` of ``least`` characters or more."""
    return F.filter(alnum_tokens(c), lambda t: F.length(t) >= least)


def chain_text(component: Column, signature: Column, raw: Column) -> Column:
    """A node's description within a chain: the first of the three that isn't empty, collapsed to 200 characters."""
    first = F.coalesce(F.nullif(component, F.lit("")), F.nullif(signature, F.lit("")), raw)
    return collapse(first, 200)


def response_text(body: Column) -> Column:
    """What a chat model's JSON answer says, ``message.content``; null without it."""
    return F.get_json_object(body, "$.message.content")


def half_even(c: Column, places: int = 0) -> Column:
    """Rounded with ties to the even neighbour."""
    return F.bround(c, places)


def normalized(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " "))


def squeezed(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]", "")


def turns(c: Column, least: int = 12, most: int | None = None) -> Column:
    """Clauses after ``.`` or ``;`` and space, of ``least`` characters or more, the first ``most`` of them; else the whole text."""
    cut = F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"([.;])\s+", "$1\u0001"), "\u0001")
    kept = F.filter(F.transform(cut, strip), lambda s: F.length(s) >= least)
    kept = kept if most is None else F.slice(kept, 1, most)
    return F.get(F.transform(F.array(kept), lambda k: F.when(F.size(k) > 0, k).otherwise(F.array(strip(F.coalesce(c, F.lit("")))))), F.lit(0))


def diagnostic_text(c: Column, keep_whole: bool = False, aftermath: str = L.AFTERMATH) -> Column:
    """Sentences of 8 characters or more that don't speak of the aftermath, as the study's pattern has it."""
    kept = F.filter(turns(c, 8), lambda s: (F.length(s) >= 8) & ~s.rlike("(?i)" + aftermath))
    joined = F.array_join(kept, " ")
    return F.when(joined == "", F.coalesce(c, F.lit(""))).otherwise(joined) if keep_whole else joined


def channels(c: Column, vocabulary: Column | None = None) -> Column:
    """struct(signals, speech): capital phrases, vocabulary words and numbers; all other words."""
    vocab = words(L.PANEL_WORDS) if vocabulary is None else vocabulary
    caps = F.filter(
        F.transform(_all(c, CAPS), strip),
        lambda p: (F.length(p) >= 2) & ~F.upper(p).isin(*L.CAPS_STOP) & ~p.rlike("^[0-9]+$"),
    )
    caps_words = F.filter(F.flatten(F.transform(caps, lambda p: F.split(F.lower(p), "[^A-Za-z0-9]+"))), lambda w: w != "")
    used = F.filter(tokenize(c), lambda t: (F.length(t) >= 2) & ~F.lower(t).isin(*L.CHANNEL_STOP))
    signal = lambda t: F.array_contains(vocab, F.lower(t)) | F.array_contains(caps_words, F.lower(t)) | t.rlike("[0-9]")
    signals = F.concat(caps, F.filter(used, lambda t: signal(t) & ~F.array_contains(caps_words, F.lower(t))))
    return F.struct(
        strip(F.array_join(signals, " ")).alias("signals"),
        strip(F.array_join(F.filter(used, lambda t: ~signal(t)), " ")).alias("speech"),
    )


def crew_lines(exchange: Column) -> Column:
    """The crew's own words of a quoted exchange: no ground lines, instructions, notes or brackets."""
    text = F.regexp_replace(F.coalesce(exchange, F.lit("")), r"\[[^\]]*\]", " ")
    text = F.regexp_replace(text, r"(?i)^.*?crew report[^:]*:", "")
    pieces = F.transform(F.split(text, r"\d{2,3}:\d{2}:\d{2}|\(\d+\)|\||->| / "), strip)
    speaker = r"^[A-Za-z()/ .]+?:\s*"
    # Fixed value: who speaks from the ground.
    ground = r"(?i)\b(CC|CAPCOM|CAP\s*COM|HOUSTON)\b|\(cap ?com\)"
    crew = F.filter(
        pieces, lambda p: (F.length(p) >= 5) & ~F.regexp_extract(p, r"^([A-Za-z()/ .]+?):", 1).rlike(ground)
    )
    said = F.transform(crew, lambda p: F.regexp_replace(strip(F.regexp_replace(p, speaker, "")), r"""^['"\s]+|['"\s]+$""", ""))
    # Openings of instructions, and labels of editors.
    orders = (
        r"(?i)^(we'?d like|we would like|would you|could you|can you|cycle|pull|verify|suggest|"
        r"go ahead|copy|roger|understand|we're go|we got you|okay\.? copy)"
    )
    labels = (
        r"(?i)\b(CREW REPORT|CREW FAULT|CLARIFYING QUESTION|FIRST CORRECTIVE INSTRUCTION|"
        r"CORRECTIVE INSTRUCTION|FTI|abnormal let|ground then|contractor|simulations|rev \d)\b"
    )
    own = F.filter(said, lambda s: (s != "") & ~s.rlike(orders))
    clean = F.transform(own, lambda s: F.regexp_replace(F.regexp_replace(s, labels, " "), r"\([^)]*\)", " "))
    return collapse(F.array_join(clean, " "))


#: Matches that one step of ``match_spans`` adds up; appending more to one array copies it each time.
_SPAN_BLOCK = 256


def match_spans(c: Column, pattern: str) -> Column:
    """Array of (start, end, hit) of the leftmost non-overlapping matches, in characters; null for null.

    The text between matches and the matches themselves, in turn, add up to the positions:
    first within blocks of matches, then over the blocks, so time grows with the matches.
    """
    parts = F.arrays_zip(F.split(c, pattern, -1).alias("gap"), F.regexp_extract_all(c, F.lit(pattern), F.lit(0)).alias("hit"))
    block = "struct<at:int,out:array<struct<start:int,end:int,hit:string>>>"

    def step(a: Column, p: Column) -> Column:
        start = a["at"] + F.length(p["gap"])
        end = start + F.coalesce(F.length(p["hit"]), F.lit(0))
        span = F.array(F.struct(start.alias("start"), end.alias("end"), p["hit"].alias("hit")))
        # Behind the last match stands a gap alone.
        return F.struct(end.alias("at"), F.when(p["hit"].isNull(), a["out"]).otherwise(F.concat(a["out"], span)).alias("out")).cast(block)

    empty = F.struct(F.lit(0).alias("at"), F.array().alias("out")).cast(block)
    blocks = lambda p: F.transform(
        F.sequence(F.lit(1), F.size(p), F.lit(_SPAN_BLOCK)), lambda first: F.aggregate(F.slice(p, first, _SPAN_BLOCK), empty, step)
    )
    starts = lambda b: F.aggregate(
        b, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x["at"]))
    )
    shifted = lambda b, at: F.transform(
        b["out"], lambda s: F.struct((s["start"] + at).alias("start"), (s["end"] + at).alias("end"), s["hit"].alias("hit"))
    )
    placed = lambda b: F.flatten(F.transform(F.arrays_zip(b.alias("b"), F.slice(starts(b), 1, F.size(b)).alias("at")), lambda x: shifted(x["b"], x["at"])))
    # A transform of one element names what is used twice.
    let = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    return F.when(c.isNotNull(), let(parts, lambda p: let(blocks(p), placed)))


def elapsed_seconds(c: Column) -> Column:
    """Seconds of ``H:M:S``; null unless there are three whole numbers."""
    p = F.split(c, ":")
    n = [F.get(p, F.lit(i)).try_cast("int") for i in range(3)]
    return F.when(F.size(p) == 3, n[0] * 3600 + n[1] * 60 + n[2])


def duration(c: Column) -> Column:
    """Seconds in words: s, min s, or h min."""
    s = c.cast("int")
    part = lambda x: x.cast("int").cast("string")
    return (
        F.when(s < 60, F.concat(part(s), F.lit(" s")))
        .when(s < 3600, F.concat(part(F.floor(s / 60)), F.lit(" min "), part(s % 60), F.lit(" s")))
        .otherwise(F.concat(part(F.floor(s / 3600)), F.lit(" h "), part(F.floor(s % 3600 / 60)), F.lit(" min")))
    )
