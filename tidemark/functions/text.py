"""Column functions over text: catalyst classification, clauses, values, URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Our own vocabulary: type, and words that speak for it. Rank is the order of rows.
VOCABULARY = (("CONTRACT", ("the", "der")), ("POLICY", ("with", "nicht")), ("EARNINGS", ("that", "que")), ("SUPPLY", ("from", "para")))


def catalyst_type(text: Column) -> Column:
    """The type whose first word stands leftmost in the lower-cased text; ties by vocabulary order; null without any."""
    low = F.lower(text)
    at = [F.struct(F.when(F.locate(w, low) > 0, F.locate(w, low)).otherwise(None).alias("at"), F.lit(i).alias("rank"), F.lit(t).alias("type")) for i, (t, ws) in enumerate(VOCABULARY) for w in ws]
    return F.array_min(F.filter(F.array(*at), lambda x: x["at"].isNotNull()))["type"]


def canonical_url(url: Column) -> Column:
    """https, no www or m host prefix, no fragment, no tracking parameter ref or utm_*, no trailing slash; the host as it is (article_url has it in lower case)."""
    u = F.regexp_replace(F.trim(url), "#.*$", "")
    u = F.regexp_replace(u, "^http://", "https://")
    u = F.regexp_replace(u, r"^https://(www|m)\.", "https://")
    u = F.regexp_replace(u, r"([?&])(ref|utm_[a-z]+)=[^&]*", "$1")
    u = F.regexp_replace(u, "&+", "&")
    u = F.regexp_replace(u, r"\?&", "?")
    return F.regexp_replace(u, r"[?&/]+$", "")


def first_number(text: Column) -> Column:
    """The first run of digits of 9 at most, as a whole number; null without any."""
    return F.try_to_number(F.nullif(F.regexp_extract(text, "([0-9]{1,9})", 1), F.lit("")), F.lit("999999999")).cast("long")


# Parameters that only follow readers around.
TRACKING = ("cmpid", "fbclid", "gclid", "igshid", "ref", "spm")
_URL = r"^\s*((?i:https?))://(?:[^/?#@]*@)?([^/?#:]+)(?::([0-9]+))?([^?#]*)(?:\?([^#]*))?"


def article_url(url: Column) -> Column:
    """One spelling of an article's address: https, the host in lower case without www, no default port, no fragment, no tracking parameters, the others in
    order of name and value, no slash at the end; null for what is no absolute web address."""
    part = lambda i: F.regexp_extract(url, _URL, i)
    host = F.regexp_replace(F.lower(part(2)), r"^www\.", "")
    port = F.when((part(3) != "") & ~part(3).isin("80", "443"), F.concat(F.lit(":"), part(3))).otherwise("")
    plain = lambda c: F.coalesce(F.try_url_decode(c), c)
    coded = lambda c: F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    pieces = F.filter(F.split(part(5), "&"), lambda x: x != "")
    pairs = F.transform(pieces, lambda x: F.struct(plain(F.split(x, "=", 2)[0]).alias("k"), plain(F.coalesce(F.get(F.split(x, "=", 2), F.lit(1)), F.lit(""))).alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(*TRACKING) & ~F.startswith(F.lower(p["k"]), F.lit("utm_"))))
    query = F.array_join(F.transform(kept, lambda p: F.concat(coded(p["k"]), F.lit("="), coded(p["v"]))), "&")
    path = F.regexp_replace(part(4), "/+$", "")
    whole = F.concat(F.lit("https://"), host, port, F.when(path == "", "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(F.rlike(url, F.lit(_URL)), whole)
