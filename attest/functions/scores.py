"""Column functions that score claims and settle verdicts."""

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from attest import vocabulary as V

from .text import plain_words, round_places

VERDICTS = ["SUPPORTED", "CONTRADICTED", "EXAGGERATED", "INSUFFICIENT_EVIDENCE", "SOURCE_MISSING"]


def claim_plain(c: Column) -> Column:
    return plain_words(c, string.ascii_lowercase + string.digits + "-")


def claim_tokens(plain: Column) -> Column:
    """Words of a plain claim; hyphens are kept."""
    return F.split(plain, " ")


def _if_any(some: Column, hits: Column) -> Column:
    """The hits where there are some, else none: most claims have none, and looking is cheap."""
    return F.when(some, hits).otherwise(F.array().cast("array<struct<term:string,place:int>>"))


def weasel_hits(t: Column) -> Column:
    """Hedging words in order, as (term, place). t: a column of tokens, not an expression, so that it is made once."""
    return _if_any(F.exists(t, lambda x: x.isin(V.WEASEL_TERMS)), _weasels(t))


def _weasels(t: Column) -> Column:
    return F.filter(F.transform(t, lambda x, i: F.struct(x.alias("term"), i.alias("place"))), lambda h: h["term"].isin(V.WEASEL_TERMS))


def absolute_hits(t: Column) -> Column:
    """Overstating words in order, but those right after a negation."""
    return _if_any(F.exists(t, lambda x: x.isin(V.ABSOLUTE_TERMS)), _absolutes(t))


def _absolutes(t: Column) -> Column:
    placed = F.transform(t, lambda x, i: F.struct(x.alias("term"), i.alias("place")))
    return F.filter(placed, lambda h: h["term"].isin(V.ABSOLUTE_TERMS) & ~F.coalesce(F.get(t, h["place"] - 1).isin(V.NEGATORS), F.lit(False)))


def phrase_hits(plain: Column) -> Column:
    """Overstating phrases, phrase by phrase; their place is -1. A phrase is searched for where the text has what it begins with."""
    begins = lambda p: F.contains(plain, F.lit(p.split("(")[0]))
    none = F.array().cast("array<string>")
    found = F.concat(*(F.when(begins(p), F.regexp_extract_all(plain, F.lit(rf"\b{p}\b"), 0)).otherwise(none) for p in V.ABSOLUTE_PHRASES))
    some = F.lit(False)
    for p in V.ABSOLUTE_PHRASES:
        some = some | begins(p)
    return _if_any(some, F.transform(found, lambda x: F.struct(x.alias("term"), F.lit(-1).alias("place"))))


def rule_penalty(weasels: Column, absolutes: Column, per_weasel: float = 0.04, per_absolute: float = 0.06, most: float = 0.4) -> Column:
    return round_places(F.least(weasels * per_weasel + absolutes * per_absolute, F.lit(most)), 3)


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(F.isnan(c), F.lit(low)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), c)))


def fuse_score(score: Column, penalty: Column) -> Column:
    """The judge's score less the penalty of wording; null without a score."""
    return F.when(score.isNotNull(), round_places(clamp(clamp(score) * (1 - clamp(penalty))), 3))


def resolve_verdict(judge: Column, evidence: Column, penalty: Column, score: Column) -> Column:
    """The effective verdict: no evidence overrules the judge, and so does overstatement on thin evidence."""
    base = F.coalesce(judge, F.lit("INSUFFICIENT_EVIDENCE"))
    overstated = (base == "SUPPORTED") & (penalty >= 0.10) & (score.isNull() | (score < 0.6))
    return F.when(evidence.isin("NO_EVIDENCE", "CROSS_CORPUS_ATTEMPT_BLOCKED"), F.lit("SOURCE_MISSING")).when(overstated, F.lit("EXAGGERATED")).otherwise(base)


def needs_adjudication(verdict: Column, evidence: Column) -> Column:
    return (evidence != "EVIDENCE_FOUND") | F.coalesce(verdict.isin("CONTRADICTED", "EXAGGERATED", "SOURCE_MISSING"), F.lit(False))


def initial_state(verdict: Column, evidence: Column) -> Column:
    return F.when(needs_adjudication(verdict, evidence), F.lit("CONTESTED")).otherwise(F.lit("MACHINE_ONLY"))


def rule_explanation(weasels: Column, absolutes: Column, penalty: Column) -> Column:
    """In words: distinct terms in order and the penalty. weasels, absolutes: arrays of terms."""
    names = lambda a: F.array_join(F.array_distinct(a), ", ")
    hedged = F.when(F.size(weasels) > 0, F.concat(F.lit("Hedging terms detected: "), names(weasels), F.lit(". A hedged claim asserts less than an unhedged one.")))
    over = F.when(F.size(absolutes) > 0, F.concat(F.lit("Absolute terms detected: "), names(absolutes), F.lit(". Absolutes overstate the generality of what the evidence can support.")))
    rest = F.format_string("Rule penalty %.3f.", penalty)
    nothing = F.lit("No hedging or overstatement markers detected. Rule penalty 0.000.")
    return F.when((F.size(weasels) == 0) & (F.size(absolutes) == 0), nothing).otherwise(F.concat_ws(" ", hedged, over, rest))
