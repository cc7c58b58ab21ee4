"""Text functions as Column expressions; all but paragraph_spans run inside the JVM."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner import config

_TOKEN = re.compile(config.TOKEN, re.I)


def query_terms(text: str, stop_words: tuple[str, ...] = config.STOP_WORDS) -> list[str]:
    """terms() for a text that the caller has in hand."""
    return [t.lower() for t in _TOKEN.findall(text) if t.lower() not in stop_words]


def terms(text: Column, stop_words: tuple[str, ...] = config.STOP_WORDS) -> Column:
    """Lower-case tokens without stop words, in order, repeats kept."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit("(?iu)(" + config.TOKEN + ")"), 1), F.lower), lambda t: ~t.isin(*stop_words))


def related(token: Column, term: str) -> Column:
    """Equal, or both of five characters or more and one within the other."""
    if len(term) < 5:
        return token == term
    return (token == term) | ((F.length(token) >= 5) & (token.contains(term) | F.lit(term).contains(token)))


def related_columns(a: Column, b: Column) -> Column:
    return (a == b) | ((F.length(a) >= 5) & (F.length(b) >= 5) & (a.contains(b) | b.contains(a)))


def sentences(text: Column) -> Column:
    """Split after . ! ? with white space and at line ends; trimmed, without empty ones."""
    parts = F.split(text, r"(?U)(?<=[.!?])\s+|\n+")
    return F.filter(F.transform(parts, trim_space), lambda s: s != "")


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse_space(text: Column) -> Column:
    return trim_space(F.regexp_replace(text, r"(?U)\s+", " "))


def word_count(text: Column) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))


def checksum(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def key(prefix: str, *parts: Column) -> Column:
    """prefix and 24 hex digits over the parts, joined by NUL."""
    return F.concat(F.lit(prefix), F.left(F.sha2(F.concat_ws("\x00", *parts), 256), F.lit(24)))


def matches(text: Column, pattern: str) -> Column:
    """Case-insensitive search with Unicode classes."""
    return text.rlike("(?iuU)" + pattern)


def confidence(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.35, "medium").otherwise("low")


def rounded(x: Column, digits: int = 4) -> Column:
    """Half up by floor, which engines agree on."""
    return F.floor(x * 10**digits + 0.5) / F.lit(float(10**digits))


def page_quality(content: Column, query: str, factor: float = 0.45) -> Column:
    """A short page with a placeholder notice counts less, unless the query asks for such a notice."""
    if re.search(config.PLACEHOLDER_NOTICE, query, re.I):
        return F.lit(1.0)
    return F.when(matches(content, config.PLACEHOLDER_NOTICE) & (word_count(content) <= 80), factor).otherwise(1.0)


def words(text: Column) -> Column:
    """Runs of letters, digits and underscores, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), 1)


def language_code(declared: Column) -> Column:
    """en-GB and en_GB to en."""
    return F.regexp_extract(F.lower(declared), r"^([^-_]*)", 1)


def language_by_words(text: Column) -> Column:
    """en or sv by marker words: three or more, and two more than the other has; else null."""
    seen = F.array_distinct(words(text))
    en, sv = (F.size(F.array_intersect(seen, F.array(*map(F.lit, config.HEURISTIC_WORDS[k])))) for k in ("en", "sv"))
    return F.when((en >= sv) & (en >= 3) & (en - sv >= 2), "en").when((sv > en) & (sv >= 3) & (sv - en >= 2), "sv")


def language_mismatch(text: Column, language: str) -> Column:
    """Whether some sentence has two or more marker words of the other language, and two more than of its own."""
    if language not in config.MISMATCH_WORDS:
        return F.lit(False)
    own, other = (F.array(*map(F.lit, config.MISMATCH_WORDS[k])) for k in (language, "sv" if language == "en" else "en"))
    clean = F.regexp_replace(text, r"(?U)\[[^\]]*\]|https?://\S+|\b\w*[_-]\w*\b", " ")

    def opposite(s: Column) -> Column:
        seen = F.array_distinct(F.regexp_extract_all(F.lower(s), F.lit(r"(?U)([^\W\d_]+)"), 1))
        there = F.size(F.array_intersect(seen, other))
        return (there >= 2) & (there >= F.size(F.array_intersect(seen, own)) + 2)

    return F.exists(F.split(clean, r"(?U)(?<=[.!?])\s+|\n+"), opposite)


def strip_citations(text: Column) -> Column:
    """Without [id] marks; no space before punctuation; white space collapsed."""
    bare = F.regexp_replace(text, r"\s*\[[A-Za-z0-9_-]+\]", " ")
    return collapse_space(F.regexp_replace(collapse_space(bare), r" +([.,;:!?])", "$1"))


def strip_thinking(text: Column) -> Column:
    return trim_space(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""))


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(\d+(?:[.,]\d+)?)"), 1)


def numbers_supported(claim: Column, evidence: Column) -> Column:
    """Every number of the claim is one of the evidence."""
    return F.size(F.array_except(numbers(claim), numbers(evidence))) == 0


def category_of(text: Column) -> Column:
    """product, service, company or information, by words of title and headings."""
    seen = words(text)
    out = F.lit("information")
    for name, own in reversed(config.CATEGORY_WORDS):
        out = F.when(F.arrays_overlap(seen, F.array(*map(F.lit, own))), name).otherwise(out)
    return out


def has_phrase(text: Column, phrase: str) -> Column:
    """The phrase as it is, between word boundaries, case-insensitive."""
    return text.rlike(r"(?iuU)(?<!\w)" + _quoted(phrase) + r"(?!\w)")


def _quoted(literal: str) -> str:
    return r"\Q" + literal.replace(r"\E", r"\E\\E\Q") + r"\E"


def bounded_int(text: Column, default: int, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(text.try_cast("int"), F.lit(default))))


def file_title(name: Column) -> Column:
    """A file's name as a title: without folder and extension, underscores and hyphens as spaces."""
    stem = F.regexp_replace(F.regexp_extract(name, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return collapse_space(F.regexp_replace(stem, "[_-]", " "))


def unsafe_label(text: Column) -> Column:
    """Whether a label has markup or a character of Unicode category C."""
    return text.rlike(r"[\p{C}<>]")


def unsafe_source_text(text: Column) -> Column:
    """Whether a source's text has markup, instructions, or control characters that are no white space."""
    return text.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F<>]") | matches(text, config.INJECTION)


def stamp_with_zone(text: Column) -> Column:
    """The time of an ISO-8601 text that names its zone; null for others."""
    return F.when(text.rlike(r"(Z|[+-]\d\d:\d\d)$"), F.try_to_timestamp(text))


def paragraph_spans(text: Column, mark: str = "\n\n") -> Column:
    """array<struct<start,stop,label>> of a text's parts between marks: each begins at the running sum of lengths and stops where the next begins, the last at the text's end.

    Running sums have no linear form among the array functions (a fold copies its array at each part), so this is an
    Arrow function; its work grows with the text. A null text has no spans: null.
    """

    def part(texts: pa.Array) -> pa.Array:
        ends, missing, starts, stops, labels = [0], [], [], [], []
        for t in texts.to_pylist():
            missing.append(t is None)
            parts = [] if t is None else t.split(mark)
            begin = np.cumsum([0, *(len(p) + len(mark) for p in parts)])
            starts.append(begin[:-1])
            stops.append(np.minimum(begin[1:], 0 if t is None else len(t)))
            labels.extend(parts)
            ends.append(len(labels))
        fields = [pa.array(np.concatenate([np.empty(0, np.int64), *x]).astype(np.int32)) for x in (starts, stops)]
        values = pa.StructArray.from_arrays([*fields, pa.array(labels, pa.string())], ["start", "stop", "label"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array(missing, pa.bool_()))

    @F.arrow_udf("array<struct<start: int, stop: int, label: string>>")
    def spans(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([part(texts.slice(at, 64)) for at in range(0, max(1, len(texts)), 64)])  # 64 texts are Python objects at once

    return spans(text)


#: Public routes, exact ones before beginnings: (method, path, whether exact, class). Fixed values.
PUBLIC_ROUTES = (("POST", "/api/widget/session", True, "chat"), ("POST", "/api/chat", True, "chat"), ("GET", "/api/appointments/", False, "appointments"))


def route_class(method: Column, path: Column, routes: tuple = PUBLIC_ROUTES) -> Column:
    """The class of a public route, null for others; a widget's path counts as the plain one if it isn't listed itself."""
    plain = F.regexp_replace(path, "^/api/widget/", "/api/")
    out = F.lit(None).cast("string")
    for own_method, own_path, exact, name in reversed(sorted(routes, key=lambda r: not r[2])):
        fits = ((path == own_path) | (plain == own_path)) if exact else plain.startswith(own_path)
        out = F.when((method == own_method) & fits, name).otherwise(out)
    return out
