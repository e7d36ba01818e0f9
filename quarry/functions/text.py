"""Column functions for text and addresses. Character classes are spelled out, so that engines agree on them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quarry.functions import as_column as c

#: Words that keyword extraction leaves out, words of good and of bad news, hints of a language.
STOPWORDS = ["and", "are", "for", "from", "that", "the", "this", "with", "was"]
POSITIVE = ["beat", "gain", "good", "growth", "improve", "positive", "profit", "rise", "strong", "up"]
NEGATIVE = ["bad", "decline", "down", "drop", "fall", "loss", "miss", "negative", "risk", "weak"]
HINTS = {"en": ["the", "and", "of", "to"], "es": ["el", "la", "de", "que"], "fr": ["le", "les", "des", "une"], "de": ["der", "die", "und", "das"]}
#: Query parameters that say where a reader came from.
TRACKING = ["fbclid", "gclid", "mc_cid", "mc_eid", "ref"]


def words(text: Column | str) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(c(text)), F.lit("([a-z0-9]+)"), 1)


def collapse(text: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(c(text), r"[ \t\n\x0B\f\r]+", " "), "^ | $", "")


def content_hash(text: Column | str) -> Column:
    """SHA-256 of the lower-case text with collapsed white space."""
    return F.sha2(F.lower(collapse(text)), 256)


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def url_authority(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def url_domain(url: Column | str) -> Column:
    """The host without user, port and a leading `www.`."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(url_authority(c(url)), "^.*@", ""), ":[0-9]*$", ""), r"^www\.", "")


def canonical_url(url: Column | str, strip_slash: bool = False) -> Column:
    """Lower-case scheme and host, no default port, fragment or tracking parameters, the others sorted."""
    u = F.trim(c(url))
    host = F.regexp_replace(url_authority(u), ":(80|443)$", "")
    path = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    path = F.when(path == "", "/").otherwise(path)
    if strip_slash:
        path = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/+$", ""))
    query = F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)
    name = lambda p: F.lower(F.substring_index(p, "=", 1))
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~name(p).startswith("utm_") & ~name(p).isin(TRACKING)))
    return F.concat(url_scheme(u), F.lit("://"), host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def sentences(text: Column | str) -> Column:
    """Pieces that end in `.`, `!` or `?` before white space or the end, collapsed; a rest without an end counts."""
    return sentences_of(collapse(text))


def sentences_of(collapsed: Column | str) -> Column:
    found = F.regexp_extract_all(c(collapsed), F.lit(r"([^.!?]+[.!?]*)"), 1)
    return F.filter(F.transform(found, lambda s: F.trim(s)), lambda s: s != "")


def hashtags(text: Column | str) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(c(text), F.lit("(#[A-Za-z0-9_]{2,})"), 1), lambda t: F.lower(t)))


def sentiment(text: Column | str) -> Column:
    """(good words - bad words) / (good words + bad words), 0 without any."""
    return sentiment_of(words(text))


def sentiment_of(found: Column) -> Column:
    good, bad = F.size(F.filter(found, lambda w: w.isin(POSITIVE))), F.size(F.filter(found, lambda w: w.isin(NEGATIVE)))
    return F.when(good + bad > 0, (good - bad) / (good + bad)).otherwise(0.0)


def language(text: Column | str, fallback: str = "und") -> Column:
    """The language with the most hint words; of equals the first by name."""
    return language_of(F.split(F.lower(collapse(text)), " "), fallback)


def language_of(found: Column, fallback: str = "und") -> Column:
    hits = lambda hints: F.size(F.filter(found, lambda w: w.isin(hints)))
    scores = F.array(*[F.struct((-hits(hints)).alias("n"), F.lit(name).alias("name")) for name, hints in HINTS.items()])
    best = F.array_sort(scores)[0]
    return F.when(best["n"] < 0, best["name"]).otherwise(fallback)


def repeated_tokens(text: Column | str) -> Column:
    """Twelve words or more, of which over 35 % repeat an earlier one."""
    return repeats(words(text))


def repeats(found: Column) -> Column:
    return (F.size(found) >= 12) & ((F.size(found) - F.size(F.array_distinct(found))) / F.greatest(F.lit(1), F.size(found)) > 0.35)


def jaccard(a: Column, b: Column) -> Column:
    """Size of the intersection over that of the union; two empty sets have 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def title_spans(text: Column | str) -> Column:
    """Distinct runs of up to five capitalised ASCII words."""
    return F.array_distinct(F.regexp_extract_all(c(text), F.lit(r"([A-Z][a-z]+(?: [A-Z][a-z]+){0,4})"), 1))
