"""Text to structured events, as column expressions: cause sentences, types, direction, certainty, continuation, stages, values, names, titles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Our own vocabulary, plain data: (name, markers), first name first in rank. Longer markers of all names are tried before shorter ones.
TYPES = (("CONTRACT", ("of the", "der")), ("POLICY", ("with", "nicht")), ("EARNINGS", ("that", "que")), ("SUPPLY", ("from", "para")), ("MARKET", ("in the", "und")))
FALLBACK = "OTHER"
CERTAINTY = (("CONFIRMED", ("the", "ist")), ("EXPECTED", ("that", "est")), ("ANTICIPATION", ("for", "por")))
UP, DOWN, MIXED = ("ing", "aux"), ("tion", "ung"), ("while", "aber")
CONTINUATION = ("again", "on the", "en la")
STAGES = (("RUMOR", ("or ",)), ("PROPOSED", ("by ", "von ")), ("AGREED", ("and ", "und ")), ("COMPLETED", ("was ", "war ")))
ACTIONS = ("is ", "was ", "es ", "ist ")


def alternation(vocabulary: tuple) -> str:
    """A pattern of all markers, longest first: what it finds from left to right is the leftmost, then longest, claim of spans."""
    markers = sorted({m for _, ms in vocabulary for m in ms}, key=lambda m: (-len(m), m))
    return "(" + "|".join(markers) + ")"


def cause_sentence(text: Column) -> Column:
    """The text without one trailing parenthetical and the white space around."""
    return F.trim(F.regexp_replace(text, r"[ ]*\([^()]*\)[ ]*$", ""))


def types(text: Column, vocabulary: tuple = TYPES) -> Column:
    """Names whose markers claim a span, in rank order; FALLBACK alone without any."""
    claimed = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(alternation(vocabulary)), 1))
    # no lambda functions here and below: they aren't compiled, and what they go over is made anew for every use
    named = F.array_except(F.array(*[F.when(F.arrays_overlap(claimed, F.array(*map(F.lit, ms))), F.lit(name)) for name, ms in vocabulary]), F.array(F.lit(None).cast("string")))
    return F.when(F.size(named) > 0, named).otherwise(F.array(F.lit(FALLBACK)))


def primary_type(text: Column, vocabulary: tuple = TYPES) -> Column:
    """The name of the leftmost claimed span."""
    first = F.regexp_extract(F.lower(text), alternation(vocabulary), 1)
    named = F
    for name, ms in vocabulary:
        named = named.when(first.isin(*ms), name)
    return named.otherwise(FALLBACK)


def last_end(text: Column, marker: str) -> Column:
    """Where the last occurrence of marker ends; null without any."""
    at = F.locate(marker[::-1], F.reverse(text))
    return F.when(at > 0, F.length(text) - at + 1)


def rightmost(text: Column, vocabulary: tuple, otherwise: str) -> Column:
    """The name whose marker ends last; the longer marker on ties, then the earlier rank."""
    low = F.lower(text)
    end = {m: last_end(low, m) for _, ms in vocabulary for m in ms}
    found = F.array(*[F.when(end[m].isNotNull(), F.struct(end[m].alias("end"), F.lit(len(m)).alias("size"), F.lit(-i).alias("rank"), F.lit(name).alias("name"))) for i, (name, ms) in enumerate(vocabulary) for m in ms])
    return F.coalesce(F.array_max(found)["name"], F.lit(otherwise))


def certainty(text: Column) -> Column:
    return rightmost(text, CERTAINTY, "UNSPECIFIED")


def direction(text: Column) -> Column:
    """MIXED if a mixing word stands anywhere, else the direction of the word that ends last."""
    low = F.lower(text)
    mixed = F.lit(False)
    for m in MIXED:
        mixed = mixed | F.contains(low, F.lit(m))
    return F.when(mixed, "MIXED").otherwise(rightmost(text, (("UP", UP), ("DOWN", DOWN)), "UNKNOWN"))


def continuation(text: Column) -> Column:
    """The earliest marker that this goes on from before; null without any."""
    low = F.lower(text)
    found = F.array(*[F.when(F.locate(m, low) > 0, F.struct(F.locate(m, low).alias("at"), F.lit(m).alias("marker"))) for m in CONTINUATION])
    return F.array_min(found)["marker"]


def stage(text: Column) -> Column:
    """The stage whose marker ends last; RUMOR only where no concrete stage stands."""
    concrete = rightmost(text, STAGES[1:], "")
    return F.when(concrete != "", concrete).otherwise(rightmost(text, STAGES[:1], "UNSPECIFIED"))


def action(text: Column) -> Column:
    """marker and object: the earliest action marker (longest on ties) and the text before it; nulls without any."""
    low = F.lower(text)
    found = F.array(*[F.when(F.locate(m, low) > 0, F.struct(F.locate(m, low).alias("at"), F.lit(-len(m)).alias("shorter"), F.lit(m).alias("marker"))) for m in ACTIONS])
    first = F.array_min(found)
    return F.struct(F.trim(first["marker"]).alias("marker"), F.trim(F.substring(text, F.lit(1), first["at"] - 1)).alias("object"))


def basis(window: Column) -> Column:
    """What a value stands for, by the words around it; in order of precedence."""
    has = lambda *words: F.rlike(F.lower(window), F.lit("|".join(words)))
    return F.when(has("of the", "total"), "TOTAL_PROJECT").when(has("share"), "COMPANY_SHARE").when(has("up to", " to "), "UP_TO").when(has("at least", " in "), "LOWER_BOUND").when(has("about", " and "), "ESTIMATE").when(has("between"), "RANGE").otherwise("EXACT")


def normalized_name(name: Column) -> Column:
    """Lower case, without corporate forms and white space."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"\b(inc|corp|co|ltd|plc|ag|sa)\b\.?|\(.*?\)", ""), r"[\s#]+", "")


def normalized_title(title: Column) -> Column:
    """Without bracketed parts, in lower case, every run of other signs than letters and digits one space."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(title, r"\[[^\]]*\]|\([^)]*\)", " ")), r"[^\p{L}\p{N}]+", " "))


def name_tokens(name: Column, stop: tuple[str, ...] = ("small", "large")) -> Column:
    """Parts of a name between slashes, commas, parentheses, dots and white space, without stop words and parts of one letter; each once, in order."""
    parts = F.split(F.lower(name), r"[/,()\s.]+")
    return F.array_distinct(F.filter(parts, lambda p: (F.length(p) >= 2) & ~p.isin(*stop)))


def inferred_date(title: Column, published: Column) -> Column:
    """The [M/D] of a title in the year that puts it nearest to the day of publication (ties: not after it, then earlier); else that day."""
    m, d = (F.nullif(F.regexp_extract(title, r"\[([0-9]{1,2})/([0-9]{1,2})\]", g), F.lit("")) for g in (1, 2))
    near = F.array(*[F.try_to_date(F.concat_ws("-", (F.year(published) + y).cast("string"), F.lpad(m, 2, "0"), F.lpad(d, 2, "0"))) for y in (-1, 0, 1)])
    ranked = F.transform(F.filter(near, lambda x: x.isNotNull()), lambda x: F.struct(F.abs(F.date_diff(x, published)).alias("away"), (x > published).alias("after"), x.alias("day")))
    return F.when(m.isNull(), published).otherwise(F.coalesce(F.array_min(ranked)["day"], published))
