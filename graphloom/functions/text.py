"""Text functions as Column expressions; they run inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from graphloom import vocab


def upper_snake(name: Column) -> Column:
    """Spaces and hyphens to underscores, other marks dropped, upper case; RELATED_TO if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"^\s+|\s+$", ""), r"[\s\-]+", "_"), r"[^A-Za-z0-9_]", "")
    return F.when((s == "") | s.isNull(), F.lit("RELATED_TO")).otherwise(F.upper(s))


def upper_id(name: Column) -> Column:
    return F.translate(F.upper(name), " -", "__")


def stable_id(name: Column, label: Column) -> Column:
    """Slug of at most 32 characters and 8 hex digits of a hash of name and label."""
    slug = F.substring(upper_id(F.trim(name)), 1, 32)
    digest = F.substring(F.sha2(F.concat(F.lower(F.trim(name)), F.lit("::"), F.lower(F.trim(F.coalesce(label, F.lit(""))))), 256), 1, 8)
    return F.concat(slug, F.lit("_"), digest)


def display_name(name: Column, label: Column) -> Column:
    kind = F.trim(F.coalesce(label, F.lit("")))
    return F.when(kind == "", name).otherwise(F.concat(name, F.lit(" ("), kind, F.lit(")")))


def strip_legal_suffixes(name: Column) -> Column:
    """Lower case, single spaces, and one pass over the legal suffixes in their order."""
    n = F.regexp_replace(F.trim(F.lower(name)), r"\s+", " ")
    for s in vocab.LEGAL_SUFFIXES:
        n = F.trim(F.regexp_replace(n, re.escape(s) + "$", ""))
    return n


def same_without_suffix(a: Column, b: Column) -> Column:
    """Equal after the suffixes are stripped, with at least four characters left."""
    x, y = strip_legal_suffixes(a), strip_legal_suffixes(b)
    return (x == y) & (F.length(x) >= 4)


def normalise_english(t: Column) -> Column:
    """Lower case; control characters dropped (so words parted by a line break join); backticks and dashes made plain."""
    s = F.regexp_replace(F.lower(t), r"\p{C}", "")
    s = F.regexp_replace(F.regexp_replace(s, "`", "'"), "[–—]", "-")
    return F.trim(F.regexp_replace(s, r"[\s\p{Z}]+", " "))


def detect_script(t: Column, mixed_below: float = 0.40) -> Column:
    """Language by script: en without Indian letters, mixed if they are too few, else the most frequent script's."""
    counts = [(lang, F.regexp_count(t, F.lit(f"[{r}]"))) for lang, r in vocab.SCRIPT_RANGES]
    indic = reduce(lambda a, b: a + b, [c for _, c in counts])
    total = indic + F.regexp_count(t, F.lit("[a-zA-Z]"))
    top = F.greatest(*[c for _, c in counts])
    best = F.coalesce(*[F.when(c == top, F.lit(lang)) for lang, c in counts])
    return F.when(F.coalesce(indic, F.lit(0)) == 0, F.lit("en")).when(indic / total < mixed_below, F.lit("mixed")).otherwise(best)


def transliterate(t: Column) -> Column:
    """Devanagari to Latin letters, one by one; other characters stay."""
    table = F.create_map(*[F.lit(x) for kv in vocab.DEVANAGARI_LATIN.items() for x in kv])
    return F.array_join(F.transform(F.split(t, ""), lambda c: F.coalesce(table[c], c)), "")


def rewrite_synonyms(t: Column) -> Column:
    for pattern, value in vocab.SYNONYMS:
        t = F.regexp_replace(t, "(?i)" + pattern, value)
    return t


def spans(t: Column, sizes: Sequence[int] = (4, 3, 2, 1)) -> Column:
    """Candidate mentions: runs of words, longest first and left to right, without those of stopwords only."""
    words = F.filter(F.split(F.trim(t), r"\s+"), lambda w: w != "")
    stop = F.array(*[F.lit(w) for w in vocab.STOPWORDS])

    def of(size: int) -> Column:
        n = F.size(words) - size + 1
        starts = F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        runs = F.transform(starts, lambda i: F.slice(words, i, size))
        named = F.filter(runs, lambda r: F.exists(r, lambda w: ~F.array_contains(stop, F.lower(w))))
        return F.transform(named, lambda r: F.regexp_replace(F.lower(F.array_join(r, " ")), r"^[?.,!]+|[?.,!]+$", ""))

    return F.array_distinct(F.flatten(F.array(*[of(s) for s in sizes])))


def aliases(t: Column, token_fallback: bool = True) -> Column:
    """Names to try for a mention: of the first key that it is, starts or ends with or holds as a word; else of its words."""
    q = F.trim(F.lower(t))
    padded = F.concat(F.lit(" "), q, F.lit(" "))
    keys = list(vocab.ALIASES.items())
    names = lambda v: F.array(*[F.lit(x) for x in v])
    # one map lookup instead of a chain of 80 comparisons: the first key, in table order, that the mention holds as words
    order = F.array(*[F.lit(k) for k, _ in keys])
    table = F.create_map(*[x for k, v in keys for x in (F.lit(k), names(v))])
    first = F.get(F.filter(order, lambda k: F.contains(padded, F.concat(F.lit(" "), k, F.lit(" ")))), F.lit(0))
    out = table[first]
    if not token_fallback:
        # without a word boundary at the other side
        loose = F.get(F.filter(order, lambda k: F.startswith(q, k) | F.endswith(q, k) | F.contains(padded, F.concat(F.lit(" "), k, F.lit(" ")))), F.lit(0))
        return F.coalesce(table[loose], F.array().cast("array<string>"))
    words = F.array_distinct(F.flatten(F.transform(F.split(q, r"\s+"), lambda w: F.coalesce(table[w], F.array().cast("array<string>")))))
    return F.coalesce(out, words)


def link_relations(t: Column) -> Column:
    """Distinct relation types whose phrases occur in the text, longest phrase first."""
    q = F.lower(t)
    ordered = sorted(vocab.PREDICATES.items(), key=lambda kv: -len(kv[0]))
    hits = [F.when(F.contains(q, F.lit(k)), F.array(*[F.lit(r) for r in v])).otherwise(F.array().cast("array<string>")) for k, v in ordered]
    return F.array_distinct(F.flatten(F.array(*hits)))


def _by_length() -> list[tuple[str, str]]:
    return sorted(vocab.TEMPORAL_WORDS.items(), key=lambda kv: -len(kv[0]))


def temporal_operator(t: Column, whole_words: bool = False) -> Column:
    """Comparison asked for by the longest temporal word in the text; a substring counts unless ``whole_words``."""
    q, out = F.lower(t), F.lit(None).cast("string")
    for word, op in reversed(_by_length()):
        hit = q.rlike(rf"\b{word}\b") if whole_words else F.contains(q, F.lit(word))
        out = F.when(hit, F.lit(op)).otherwise(out)
    return out


def temporal_reference(t: Column) -> Column:
    """What follows that word, trimmed of marks; null if nothing does."""
    q, out = F.lower(t), F.lit(None).cast("string")
    for word, _ in reversed(_by_length()):
        found = F.regexp_extract(q, word + r"\s+([a-z0-9\s/,-]{3,30})", 1)
        ref = F.regexp_replace(F.trim(F.regexp_replace(found, r"^\s+|\s+$", "")), r"[.,?]+$", "")
        out = F.when(F.contains(q, F.lit(word)), F.when(found != "", ref)).otherwise(out)
    return out


def relation_confidence(t: Column) -> Column:
    return F.when(F.size(link_relations(t)) > 0, F.lit(0.9)).when(temporal_operator(t).isNotNull(), F.lit(0.4)).otherwise(F.lit(0.3))


def classify_question(t: Column) -> Column:
    q = F.lower(t)
    any_of = lambda patterns: reduce(lambda a, b: a | b, [q.rlike(p) for p in patterns])
    return F.when(any_of(vocab.CHAIN_PATTERNS), "multi_hop_chain").when(any_of(vocab.INTERSECTION_PATTERNS), "multi_hop_intersection").when(any_of(vocab.TEMPORAL_PATTERNS), "temporal").otherwise("single_hop")


def between_entities(t: Column) -> Column:
    """[A, B] of the first form that fits; null if none does."""
    q = F.trim(t)
    forms = [F.when(q.rlike(p), F.array(F.trim(F.regexp_extract(q, p, 1)), F.trim(F.regexp_extract(q, p, 2)))) for p in vocab.BETWEEN_PATTERNS]
    return F.coalesce(*forms)


def quote_replacement(c: Column) -> Column:
    """A column's value as a literal replacement in regexp_replace."""
    return F.regexp_replace(c, r"([\\$])", r"\\$1")


def resolve_pronouns(t: Column, entity: Column, event: Column) -> Column:
    """Pronouns replaced by the last entity, then references to events by the last event; a null leaves them."""
    first = F.when(entity.isNotNull(), F.regexp_replace(t, F.lit(vocab.ENTITY_PRONOUNS), quote_replacement(entity))).otherwise(t)
    return F.when(event.isNotNull(), F.regexp_replace(first, F.lit(vocab.EVENT_PRONOUNS), quote_replacement(event))).otherwise(first)


def is_result_noise(name: Column) -> Column:
    return F.trim(F.coalesce(name, F.lit(""))).rlike(vocab.RESULT_NOISE)


def is_build_noise(name: Column) -> Column:
    n = F.trim(F.coalesce(name, F.lit("")))
    return (F.length(n) < 2) | n.rlike(vocab.BUILD_NOISE)


def is_never_merged(name: Column) -> Column:
    n = F.trim(name)
    return reduce(lambda a, b: a | b, [n.rlike(p) for p in vocab.NEVER_MERGED])


def is_protected_pair(a: Column, b: Column) -> Column:
    return F.exists(F.array(*[F.lit(x) for x in vocab.PROTECTED_TOKENS]), lambda p: F.contains(a, p) & F.contains(b, p))


def whole_word_match(name: Column, term: Column) -> Column:
    """The term is the name, or its first, last or an inner word."""
    return F.contains(F.concat(F.lit(" "), F.lower(name), F.lit(" ")), F.concat(F.lit(" "), F.lower(term), F.lit(" ")))


def relation_phrase(rel: Column, answers: bool = False) -> Column:
    """A relation type as words: by table, else in lower case with spaces."""
    phrases = vocab.ANSWER_PHRASES if answers else vocab.STEP_PHRASES
    table = F.create_map(*[F.lit(x) for kv in phrases.items() for x in kv])
    return F.coalesce(table[F.upper(rel)], F.replace(F.lower(rel), F.lit("_"), F.lit(" ")))


def strip_fence(t: Column) -> Column:
    """Text without a Markdown fence around it."""
    s = F.trim(t)
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def is_step_line(t: Column) -> Column:
    return F.trim(t).rlike(r"^Step\s+\d+")


def strip_direction_tokens(t: Column) -> Column:
    return F.trim(F.regexp_replace(t, r"<2[a-z]{2}>", ""))


def same_answer(a: Column, b: Column) -> Column:
    """Equal but for case and white space."""
    plain = lambda c: F.regexp_replace(F.trim(F.lower(c)), r"\s+", " ")
    return plain(a) == plain(b)


def keywords(t: Column, longer_than: int = 3) -> Column:
    """Words of more than ``longer_than`` letters, marks taken as spaces."""
    w = F.split(F.trim(F.regexp_replace(F.lower(t), r"[^\w\s]", " ")), r"\s+")
    return F.array_distinct(F.filter(w, lambda x: F.length(x) > longer_than))


def any_keyword(fields: Sequence[Column], words: Sequence[str]) -> Column:
    """Any keyword in any field, case aside."""
    hits = [F.contains(F.lower(f), F.lit(w.lower())) for f in fields for w in words]
    return reduce(lambda a, b: a | b, [F.coalesce(h, F.lit(False)) for h in hits])
