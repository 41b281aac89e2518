"""Column functions on text."""

import re
import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from attest import vocabulary as V


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value made once however often it is used: an alias in a plan may be made anew at each use."""
    return F.transform(F.array(value), use)[0]


def _empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def normalize(c: Column) -> Column:
    """Line ends as \\n, no control characters but tab and \\n, no white space at the ends."""
    lines = F.regexp_replace(_empty(c), "\r\n?", "\n")
    clean = F.regexp_replace(lines, r"[\x00-\x08\x0B-\x1F\x7F]", "")
    return F.regexp_replace(clean, r"\A\s+|\s+\z", "")


def sha256_hex(c: Column) -> Column:
    return F.sha2(_empty(c), 256)


def token_estimate(c: Column, chars_per_token: int = 4) -> Column:
    return F.ceil(F.length(_empty(c)) / chars_per_token).cast("int")


def plain_words(c: Column, kept: str = string.ascii_lowercase + string.digits) -> Column:
    """Lower case, with one space for each run of other characters than the kept ones, none at the ends.

    Characters are mapped, not matched, which takes a fraction of the time; runs of spaces are looked for where there is one.
    """
    low = F.lower(_empty(c))
    other = F.translate(low, kept + " ", "")
    clean = F.call_function("translate", low, other, F.repeat(F.lit(" "), F.length(other)))
    return F.trim(F.when(F.contains(clean, F.lit("  ")), F.regexp_replace(clean, " +", " ")).otherwise(clean))


def norm_label(c: Column) -> Column:
    return plain_words(c)


def phrase(c: Column) -> Column:
    """Tokens of letters and digits with one space around each: a run of tokens is a substring."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(_empty(c)), "[^a-z0-9]+", " ")), F.lit(" "))


def phrase_contains(text: Column, part: Column, least: int = 3) -> Column:
    """Whether the part's tokens, three at least, are a run of the text's."""
    p = phrase(part)
    return (F.size(F.split(F.trim(p), " ")) >= least) & F.contains(phrase(text), p)


def entity_key(c: Column) -> Column:
    """Lower case, one space, no punctuation at the ends, less one trailing designator."""
    edge = "[" + re.escape(V.EDGE_PUNCTUATION) + "]+"
    x = F.trim(F.regexp_replace(F.lower(F.trim(_empty(c))), r"[\s\p{Z}]+", " "))
    x = F.regexp_replace(x, f"^{edge}|{edge}$", "")
    tail = "|".join(re.escape(d) for d in V.DESIGNATORS)
    return F.trim(F.regexp_replace(x, rf"^(.*\S)\s+(?:{tail})$", "$1"))


def token_difference(a: Column, b: Column) -> Column:
    """Which tokens of two keys only one of them has."""
    x, y = F.split(a, " "), F.split(b, " ")
    only_a, only_b = F.array_sort(F.array_except(x, y)), F.array_sort(F.array_except(y, x))
    left = F.when(F.size(only_a) > 0, F.concat(F.lit("only in first: "), F.array_join(only_a, ", ")))
    right = F.when(F.size(only_b) > 0, F.concat(F.lit("only in second: "), F.array_join(only_b, ", ")))
    return F.when((F.size(only_a) == 0) & (F.size(only_b) == 0), F.lit("same tokens, different order")).otherwise(F.concat_ws("; ", left, right))


def query_tokens(c: Column, most: int = 12) -> Column:
    """Searchable words of a query: three letters or more, no stop terms, the first twelve."""
    words = F.split(norm_label(c), " ")
    return F.slice(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(V.STOP_TERMS)), 1, most)


def surface_map() -> Column:
    """Surface form -> token of the corpus, as a literal map."""
    pairs = {s: target for target, surfaces in V.EXPANSIONS.items() for s in surfaces.split() if s != target}
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def expansions(tokens: Column) -> Column:
    """The pairs (surface, token) that apply to query tokens, in order, each once."""
    table = surface_map()
    known = F.array_distinct(F.filter(tokens, lambda t: F.map_contains_key(table, t)))
    return F.transform(known, lambda t: F.struct(t.alias("surface"), F.element_at(table, t).alias("target")))


def applied_expansions(tokens: Column) -> Column:
    """The expansions that apply, as a map from surface to target."""
    return F.map_from_entries(expansions(tokens))


def expanded_query(tokens: Column) -> Column:
    """The full-text query: every token, and the corpus token it maps to."""
    table = surface_map()
    plus = F.transform(tokens, lambda t: F.when(F.map_contains_key(table, t), F.concat(F.lit("+"), t, F.lit(" +"), F.element_at(table, t))).otherwise(F.concat(F.lit("+"), t)))
    return F.array_join(plus, " ")


def search_terms(tokens: Column) -> Column:
    """Distinct terms to search for."""
    return F.array_distinct(F.concat(tokens, F.transform(expansions(tokens), lambda x: x["target"])))


def like_escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("%"), F.lit("\\%")), F.lit("_"), F.lit("\\_"))


def truncate_ellipsis(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("…"))).otherwise(c)


def evidence_query(subject: Column, claim: Column, predicate: Column, obj: Column) -> Column:
    """What is searched for a claim."""
    none_if_blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.concat_ws(" ", none_if_blank(subject), none_if_blank(claim), none_if_blank(F.replace(predicate, F.lit("_"), F.lit(" "))), none_if_blank(obj))


def title_of(filename: Column) -> Column:
    """Title from a file name: no folder, no extension, words for _ and -, at most 500 characters."""
    name = F.regexp_replace(F.regexp_extract(_empty(filename), r"([^/\\]*)$", 1), r"\.[^.]*$", "")
    words = F.trim(F.regexp_replace(name, "[_-]+", " "))
    return F.when(words == "", F.lit("Untitled document")).otherwise(F.substring(words, 1, 500))


def safe_filename(c: Column) -> Column:
    return F.substring(F.regexp_replace(_empty(c), r'[\x00-\x1F<>:"\\|?*]', "_"), 1, 512)


def round_places(c: Column, places: int) -> Column:
    """Half up on the binary value, as floor(x * 10^n + 0.5) / 10^n."""
    return F.floor(c * 10**places + 0.5) / float(10**places)
