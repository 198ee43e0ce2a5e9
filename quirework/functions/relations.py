"""Relation names, concept endpoints, and the gate that a quote has to pass. All are expressions of the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quirework.functions import vocab
from quirework.functions.text import normalized_phrase, strip

WELL_FORMED = r"^[A-Z][A-Z0-9_]{0,63}\z"


def is_well_formed(c: Column) -> Column:
    return F.coalesce(c.rlike(WELL_FORMED), F.lit(False))


def normalize_relation(c: Column) -> Column:
    """The canonical name, a well-formed other one as it is, or '' for what can't be a name.

    Names in the vocabulary are looked up at once; only others are cleaned and tested.
    """
    known = F.create_map(*[F.lit(x) for pair in [*vocab.CANONICAL_OF.items(), *((n, n) for n in vocab.CANONICAL)] for x in pair])
    raw = F.regexp_replace(F.regexp_replace(F.upper(strip(F.coalesce(c, F.lit("")))), "[ -]", "_"), "_+", "_")
    raw = F.regexp_replace(raw, r"^_|_\z", "")
    slow = F.transform(F.array(raw), lambda r: F.when(is_well_formed(r), F.coalesce(F.try_element_at(known, r), r)).otherwise(""))
    return F.coalesce(F.try_element_at(known, F.translate(F.upper(c), " -", "__")), slow[0])


def _tokens(phrase: Column) -> Column:
    return F.split(phrase, " ")


def endpoint_phrase_ok(phrase: Column) -> Column:
    """``is_concept_endpoint`` of a phrase that is normalised already."""
    words = _tokens(phrase)
    lone = (F.size(words) == 1) & phrase.isin(*vocab.LONE)
    edge = F.element_at(words, 1).isin(*vocab.EDGE) | F.element_at(words, -1).isin(*vocab.EDGE)
    return (phrase != "") & ~lone & ~edge


def is_concept_endpoint(c: Column) -> Column:
    """Whether a name is a concept: not empty, not a lone function word, without a clause word at either end."""
    return endpoint_phrase_ok(normalized_phrase(c))


def is_feature(c: Column) -> Column:
    """Whether it can be had: its last word is a component; not a number, an amount or an idiom."""
    return _feature_phrase(normalized_phrase(c))


def _feature_phrase(p: Column) -> Column:
    amount = F.replace(p, F.lit(" "), F.lit("")).rlike(r"(?i)^(?:[\d.,]+(?:k|m|b|%|percent)?|[$€£¥][\d.,]+|[\d.,]+[$€£¥])\z")
    first, last = F.element_at(_tokens(p), 1), F.element_at(_tokens(p), -1)
    return ~amount & ~first.isin("little", "seen", "advantage") & last.isin(*vocab.FEATURES)


def is_result(c: Column) -> Column:
    """Whether it can be achieved: one of its words is a result, and it isn't a point."""
    return _result_phrase(normalized_phrase(c))


def _result_phrase(p: Column) -> Column:
    words = _tokens(p)
    return F.arrays_overlap(words, F.array(*[F.lit(x) for x in vocab.RESULTS])) & (F.element_at(words, -1) != "point")


def is_grounded(name: Column, normalized_text: Column) -> Column:
    """Whether the name's words stand in the text, between word boundaries."""
    p = normalized_phrase(name)
    return (p != "") & F.contains(F.concat(F.lit(" "), normalized_text, F.lit(" ")), F.concat(F.lit(" "), p, F.lit(" ")))


def _term(phrase: Column) -> Column:
    return F.concat(F.lit(r"(?<!\w)(?:an? |the )?"), phrase, F.lit(r"(?!\w)"))


def _pattern(wording: str, source: Column, target: Column) -> list[Column]:
    """The parts of the wording, with terms from columns."""
    marked = vocab.fill(wording, "\0S\0", "\0T\0", long_source="\0S\0")
    return [{"S": source, "T": target}.get(p, F.lit(p)) for p in marked.split("\0") if p]


def _any(wordings: list[str], source: Column, target: Column, both_ways: bool) -> Column:
    """One expression for all wordings of a relation, which may hold either way."""
    ways = [(source, target), (target, source)] if both_ways else [(source, target)]
    parts: list[Column] = []
    for w in wordings:
        for a, b in ways:
            parts += [F.lit("|" if parts else "(?U)(?:"), *_pattern(w, a, b)]
    return F.concat(*parts, F.lit(")"))


def quote_supports(quote: Column, source: Column, relation: Column, target: Column) -> Column:
    """Whether the quote states the relation between the two, in one of its wordings; false whenever in doubt.

    Sentence signs become a word of their own, so no wording reaches across them. Wordings are tried only where both
    names stand in the quote, for patterns of columns are compiled for each row. Names, relation and text are made once
    and bound, which keeps the plan small.
    """
    text = normalized_phrase(F.regexp_replace(quote, "[.!?;:]+", " relationboundary "))
    given = F.struct(text.alias("text"), normalized_phrase(source).alias("s"), normalize_relation(relation).alias("rel"), normalized_phrase(target).alias("t"))
    return F.coalesce(F.transform(F.array(given), _states)[0], F.lit(False))


def _states(x: Column) -> Column:
    text, rel = x["text"], x["rel"]
    s, t = _term(x["s"]), _term(x["t"])
    first = F.element_at(_tokens(x["t"]), 1)
    limits = ((rel != "HAS_FEATURE") | _feature_phrase(x["t"])) & ((rel != "ACHIEVES") | _result_phrase(x["t"])) & ((rel != "REQUIRES") | ~first.isin("less", "more", "that"))
    pattern = F.lit(None).cast("string")
    for r in vocab.CANONICAL:
        pattern = F.when(rel == r, _any([w for q, w in vocab.WORDINGS if q == r], s, t, both_ways=r == "RELATES_TO")).otherwise(pattern)
    words = F.filter(F.split(F.lower(rel), "_"), lambda w: w != "")
    middle = F.concat(F.lit(r"\s+(?:(?:is|are|was|were)\s+)?(?:"), F.array_join(words, r"\s+"), F.lit("|"), F.array_join(words, ""), F.lit(r")\s+(?:(?:by|with|from|on|to)\s+)?"))
    novel = F.concat(F.lit("(?U)(?:"), s, middle, t, F.lit("|"), t, middle, s, F.lit(")"))
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    there = [F.contains(padded, F.concat(F.lit(" "), x[c], F.lit(" "))) for c in ("s", "t")]
    return (rel != "") & endpoint_phrase_ok(x["s"]) & endpoint_phrase_ok(x["t"]) & limits & there[0] & there[1] & F.regexp_like(text, F.coalesce(pattern, novel))


def _named(priority: int, relation: str) -> Callable[[Column], Column]:
    return lambda p: F.struct(F.lit(priority).alias("priority"), F.lit(relation).alias("relation"), strip(F.substring_index(p, "\2", 1)).alias("source"), strip(F.substring_index(p, "\2", -1)).alias("target"))


def local_pairs(text: Column) -> Column:
    """All (priority, relation, source, target) that the wordings, filled with noun phrases, find in a text.

    A wording is tried only on texts that have one of its relation's trigger words, and its own landmark. Its pattern is
    slow, so it goes over a text once and puts signs, which no noun phrase has, about what it finds.
    """
    none = F.array().cast("array<struct<priority:int,relation:string,source:string,target:string>>")
    plain = F.translate(text, "\1\2\3", "\4\4\4")
    by_relation: dict[str, list[Column]] = {}
    for i, (relation, wording) in enumerate(vocab.WORDINGS):
        pattern = "(?iu)" + vocab.fill(wording, vocab.NOUN, vocab.NOUN, long_source=vocab.LONG_NOUN)
        s, t = (1, 2) if vocab.source_first(wording) else (2, 1)
        pairs = F.regexp_extract_all(F.regexp_replace(plain, pattern, f"\1${s}\2${t}\3"), F.lit("\1([^\1\3]*\2[^\1\3]*)\3"), F.lit(1))
        by_relation.setdefault(relation, []).append(F.when(text.rlike("(?iu)" + vocab.landmark(wording)), F.transform(pairs, _named(i, relation))).otherwise(none))
    found = [F.when(text.rlike(rf"(?i)\b(?:{vocab.TRIGGERS[r]})"), F.concat(*columns)).otherwise(none) for r, columns in by_relation.items()]
    return F.when(text.rlike(r"(?i)\b(?:" + "|".join(vocab.TRIGGERS.values()) + ")"), F.concat(*found)).otherwise(none)
