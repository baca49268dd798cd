"""Names of a dictionary table in texts: a join on the words that names begin with, checks of the rest, and leftmost longest spans.

The dictionary is a table of any size, never a pattern. Texts give a row for each word and pair of words; these meet the names that begin
so in one equality join, to which the dictionary is broadcast only while it has at most BROADCAST_NAMES names. What
meets is checked against the text, resolved by the day of the text, and its spans are thinned text by text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_NAMES = 100_000
#: Particles that may follow a name within its word, and marks of a company's legal form.
PARTICLES = "은는이가을를와과의도에로"
LEGAL_FORMS = r"\s+|\(주\)|㈜|주식회사"

#: Characters of a text that go with a key, to compare a name before its text comes together again; longer names wait for that.
_AHEAD = 48

_RUN = re.compile(r"[^\W_]+")
_ALNUM = r"[\p{L}\p{N}]"


def normalized_company(name: Column) -> Column:
    """Lower case, without white space and legal forms."""
    return F.regexp_replace(F.lower(name), LEGAL_FORMS, "")


def _forms(word: str) -> list[str]:
    """A word, and what stands before each particle inside it."""
    return [word, *(word[:i] for i, c in enumerate(word) if i and c in PARTICLES)]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a key of a text; the text itself goes with the first one only."""
    for batch in batches:
        row, first, start, key, ahead = [], [], [], [], []
        for i, text in enumerate(batch.column(batch.schema.get_field_index("text")).to_pylist()):
            runs = [(m.start(), m.group().lower()) for m in _RUN.finditer(text or "")]
            for n, ((at, word), (_, following)) in enumerate(zip(runs, [*runs[1:], (0, None)], strict=False)):
                found = _forms(word) if following is None else [*_forms(word), *(f"{word} {f}" for f in _forms(following))]
                row.extend([i] * len(found))
                first.extend([None] * len(found))
                start.extend([at] * len(found))
                key.extend(found)
                ahead.extend([text[at : at + _AHEAD]] * len(found))
                if n == 0:
                    first[-len(found)] = i
        ids = batch.select(["text_id", "as_of"]).take(pa.array(row, pa.int64()))
        whole = batch.drop_columns(["text_id", "as_of"]).take(pa.array(first, pa.int64()))
        yield pa.RecordBatch.from_arrays([*ids.columns, pa.array(start, pa.int32()), pa.array(key, pa.string()), pa.array(ahead, pa.string()), *whole.columns], names=["text_id", "as_of", "start", "key", "ahead", *whole.schema.names])


def names(aliases: DataFrame) -> DataFrame:
    """aliases: alias, code, valid_from, valid_to (null: open), known. One row a spelling: name (lower case), key (its first word or two), offset of
    the first word, windows (of the aliases that are the same when normalized, one a validity: valid_from, valid_to, least and greatest code, whether
    some code is null, known of any). However many companies share a spelling, it has no more windows than they have validities."""
    a = aliases.where(F.rlike("alias", F.lit(_ALNUM))).withColumn("same", normalized_company(F.col("alias")))
    validity = a.groupBy("same", "valid_from", "valid_to").agg(F.min("code").alias("least"), F.max("code").alias("greatest"), F.max(F.col("code").isNull()).alias("unnamed"), F.max(F.coalesce("known", F.lit(False))).alias("known"))
    windows = validity.groupBy("same").agg(F.collect_list(F.struct("valid_from", "valid_to", "least", "greatest", "unnamed", "known")).alias("windows"))
    words = F.regexp_extract_all("name", F.lit(f"({_ALNUM}+)"), F.lit(1))
    spelled = a.select("same", F.lower("alias").alias("name")).distinct().join(windows, "same")
    key = F.when(F.size(words) == 1, words[0]).otherwise(F.concat_ws(" ", words[0], F.get(words, F.lit(1))))
    return spelled.select("name", key.alias("key"), (F.regexp_instr("name", F.lit(_ALNUM)) - 1).alias("offset"), "windows")


def _longest(spans: Column) -> Column:
    """Of spans (start, end, ...) those that a reader takes from left to right, the longest first."""
    ordered = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    none = F.slice(spans, 1, 0)
    last = lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0))
    return F.aggregate(ordered, none, lambda acc, x: F.when(x["start"] >= last(acc), F.concat(acc, F.array(x))).otherwise(acc))


def mentions(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """texts: text_id (unique), text, as_of (null: any day). Adds spans to the texts that have some: structs of start and end (code points, end
    exclusive), name, status (RESOLVED, UNKNOWN_STOCK_CODE, AMBIGUOUS_ALIAS, OUT_OF_VALIDITY) and code (of resolved ones), in text order.

    A name stands at a word's beginning and ends with the word or before a particle; case plays no part. Spans are the
    leftmost, then longest, and don't overlap. A name of several companies on its day is ambiguous.
    """
    kinds = dict(texts.dtypes)
    others = [c for c in texts.columns if c not in ("text_id", "as_of")]
    keys = texts.select("text_id", "as_of", *others).mapInArrow(_keys, f"text_id {kinds['text_id']}, as_of date, start int, key string, ahead string, " + ", ".join(f"`{c}` {kinds[c]}" for c in others))
    dictionary = names(aliases)
    if dictionary.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES:
        dictionary = F.broadcast(dictionary)
    first = F.col("start") - F.col("offset")
    size = F.length("name") - F.col("offset")
    meets = F.coalesce((first >= 0) & ((size > _AHEAD) | (F.lower(F.substring("ahead", F.lit(1), size)) == F.substring("name", F.col("offset") + 1, size))), F.lit(False))
    met = keys.join(dictionary, "key", "left").withColumn("meets", meets).where(F.col("meets") | F.col("text").isNotNull())
    day = F.col("as_of")
    valid = F.filter("windows", lambda w: day.isNull() | (F.coalesce(w["valid_from"] <= day, F.lit(True)) & F.coalesce(w["valid_to"] >= day, F.lit(True))))
    met = met.withColumn("valid", valid)
    least, unnamed = F.array_min(F.transform("valid", lambda w: w["least"])), F.exists("valid", lambda w: w["unnamed"])
    several = F.coalesce((least < F.array_max(F.transform("valid", lambda w: w["greatest"]))) | unnamed, F.lit(False)) & least.isNotNull()
    known = F.exists("valid", lambda w: w["known"])
    status = F.when(F.size("valid") == 0, "OUT_OF_VALIDITY").when(several, "AMBIGUOUS_ALIAS").when(known, "RESOLVED").otherwise("UNKNOWN_STOCK_CODE")
    span = F.struct(first.alias("start"), (first + F.length("name")).alias("end"), "name", status.alias("status"), F.when(status == "RESOLVED", least).alias("code"))
    met = met.select(*texts.columns, F.when(F.col("meets"), span).alias("span"))
    found = met.groupBy("text_id").agg(F.collect_set("span").alias("spans"), *[F.max(c).alias(c) for c in texts.columns if c != "text_id"]).where(F.size("spans") > 0)

    def stands(s: Column) -> Column:
        before, after = F.substring(F.col("text"), s["start"], F.when(s["start"] > 0, F.lit(1)).otherwise(0)), F.substring(F.col("text"), s["end"] + 1, F.lit(1))
        whole = F.lower(F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])) == s["name"]
        return whole & ~F.rlike(before, F.lit(_ALNUM)) & (~F.rlike(after, F.lit(_ALNUM)) | F.rlike(after, F.lit(f"[{PARTICLES}]")))

    found = found.where(F.exists("spans", stands)).withColumn("spans", F.filter("spans", stands))
    return found.select(*texts.columns, _longest(F.col("spans")).alias("spans"))
