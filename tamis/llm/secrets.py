"""Secret scans by a trigram inverted index, in DataFrame functions only.

1. ``trigram_query`` derives from a rule's regex which trigrams every match must hold: a list of
   alternatives, each a set of trigrams (None: no trigram is mandatory, the rule scans every text).
2. ``postings`` is the inverted index over the wanted trigrams: one row per text and trigram it holds.
3. ``candidates`` intersects postings: a text is a candidate of a rule if it holds all trigrams of one
   of the rule's alternatives.
4. ``scan`` runs each regex on its candidates, and the rules without mandatory trigrams on all texts.

Texts are keyed by a 64-bit hash of id and text. Two rows with one key share their candidate rules, which
can only add a verification, never lose a match; so repeated ids and rows need no care.

A match is judged after it is found: leftmost, non-overlapping, then dropped if its ``group`` is shorter
than ``least`` code points. Spans count code points, end exclusive. A private key's match is all of it: from its BEGIN
line through its END line, or to the end of the text if that line is missing.

Defined cases: a null text is an empty one; a null id is a key like others; a text without matches has
empty lists; an empty table gives an empty result. Regexes use the syntax that Java, RE2 and Python share;
``(?i)`` folds ASCII letters.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _parser as regex_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 0  # code points that the group must have
    group: int = 0  # must end where the match ends
    tail: str = ""  # carries a match on; matches any rest of a text, so that no match is lost


RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]{32,}", 32),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]+", 36),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 35),
    Rule("stripe", r"sk_live_[A-Za-z0-9]+", 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", tail=r"(?s:.*?)(?:-----END [A-Z ]*PRIVATE KEY-----|\z)"),
)

MOST_STRINGS = 48  # exact strings followed side by side while a regex is read


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives of mandatory trigrams (lower case) of a regex; None if some match needs none."""
    found = _absorb(_query(regex_parser.parse(pattern)))
    return None if frozenset() in found else sorted(found, key=sorted)


def _absorb(alternatives: set[frozenset[str]]) -> set[frozenset[str]]:
    return {a for a in alternatives if not any(b < a for b in alternatives)}


def _strings(op: str, value) -> set[str] | None:
    """All strings an element matches, lower case; None if they are not few."""
    if op == "LITERAL":
        return {chr(value).lower()}
    if op == "IN":
        if any(str(kind) not in ("LITERAL", "RANGE") for kind, _ in value):
            return None
        chars = {chr(x).lower() for kind, v in value for x in ([v] if str(kind) == "LITERAL" else range(v[0], v[1] + 1))}
        return chars if len(chars) <= 8 else None
    if op == "SUBPATTERN":
        return _sequence_strings(value[-1])
    if op == "BRANCH":
        parts = [_sequence_strings(b) for b in value[1]]
        return None if None in parts else set().union(*parts)
    if op == "MAX_REPEAT" and value[1] != regex_parser.MAXREPEAT and value[1] <= 8:
        inner = _sequence_strings(value[2])
        if inner is None or sum(len(inner) ** n for n in range(value[0], value[1] + 1)) > MOST_STRINGS:
            return None
        return {"".join(x) for n in range(value[0], value[1] + 1) for x in product(inner, repeat=n)}
    return None


def _sequence_strings(items) -> set[str] | None:
    out = {""}
    for op, value in items:
        more = _strings(str(op), value)
        if more is None or len(out) * len(more) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


def _query(items) -> set[frozenset[str]]:
    """Runs of exact strings give trigrams; what lies between runs adds what it needs itself."""
    out, run = {frozenset()}, {""}

    def close() -> None:
        nonlocal out, run
        here = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}
        out, run = _absorb({a | b for a in out for b in _absorb(here)}), {""}

    for op, value in items:
        op = str(op)
        more = _strings(op, value)
        if more is not None and len(run) * len(more) <= MOST_STRINGS:
            run = {a + b for a in run for b in more}
            continue
        close()
        if more is not None:
            run = more
        elif op == "SUBPATTERN":
            out = _absorb({a | b for a in out for b in _query(value[-1])})
        elif op == "BRANCH":
            out = _absorb({a | b for a in out for branch in value[1] for b in _query(branch)})
        elif op in ("MAX_REPEAT", "MIN_REPEAT") and value[0] > 0:
            out = _absorb({a | b for a in out for b in _query(value[2])})
    close()
    return out


def _keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    return df.select(F.xxhash64(F.col(key), whole).alias("row_key"), whole.alias("text"), F.col(key).alias("id"))


def postings(keyed: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, row_key) of the wanted trigrams in the lower-case texts."""
    low = F.lower(F.col("text"))
    held = F.filter(F.array(*[F.lit(t) for t in trigrams]), lambda t: F.contains(low, t))
    return keyed.select("row_key", F.explode(held).alias("trigram"))


def candidates(keyed: DataFrame, rules: tuple[Rule, ...]) -> DataFrame | None:
    """(row_key, kinds): the rules that have all trigrams of one of their alternatives in the text."""
    wanted = [(r.kind, n, t, len(a)) for r in rules for n, a in enumerate(trigram_query(r.pattern) or []) for t in sorted(a)]
    if not wanted:
        return None
    # the table of alternatives is as long as the rules, whatever the documents
    table = keyed.sparkSession.createDataFrame(wanted, "kind string, alternative int, trigram string, needed int")
    index = postings(keyed, sorted({w[2] for w in wanted}))
    hits = index.join(F.broadcast(table), "trigram").groupBy("row_key", "kind", "alternative", "needed")
    full = hits.agg(F.size(F.collect_set("trigram")).alias("held")).where("held = needed")
    return full.groupBy("row_key").agg(F.collect_set("kind").alias("kinds"))


SPAN = "array<struct<start:int,place:int,end:int,value:int>>"


def rule_spans(text: Column, rule: Rule, place: int) -> Column:
    """Spans of a rule's matches: start, place of the rule, end, start of the group.

    Matches and the gaps between them alternate, so their lengths add up to positions.
    """
    whole = rule.pattern + rule.tail
    pattern = F.lit(whole)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.transform(F.split(text, whole, -1), F.length)
    sizes = F.transform(hits, F.length)
    groups = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length) if rule.group else sizes

    def total(parts: Column, count: Column) -> Column:
        return F.aggregate(F.slice(parts, F.lit(1), count), F.lit(0), lambda a, b: a + b)

    def span(size: Column, at: Column) -> Column:
        start = total(gaps, at + 1) + total(sizes, at)
        group = F.get(groups, at)
        end = start + size
        return F.struct(
            start.alias("start"), F.lit(place).alias("place"), end.alias("end"), (end - group).alias("value"), (group >= rule.least).alias("long")
        )

    kept = F.filter(F.transform(sizes, span), lambda s: s["long"])
    bare = F.transform(kept, lambda s: F.struct(s["start"], s["place"], s["end"], s["value"]))
    return F.when(F.rlike(text, pattern), bare).otherwise(F.lit(None).cast(SPAN))


def _with_spans(keyed: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """A keyed table with the secrets of each text, ordered by start and then by rule."""
    found = candidates(keyed, rules)
    if found is not None:
        keyed = keyed.join(found, "row_key", "left")
    parts = []
    for place, rule in enumerate(rules):
        spans = rule_spans(F.col("text"), rule, place)
        if trigram_query(rule.pattern) is not None:
            spans = F.when(F.array_contains("kinds", rule.kind), spans)
        parts.append(F.coalesce(spans, F.array().cast(SPAN)))
    return keyed.withColumn("spans", F.array_sort(F.concat(*parts)))


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, text, spans) of every row of ``df``."""
    return _with_spans(_keyed(df, key, text), rules).select("id", "text", "spans")


def redact(df: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` with the values of its secrets masked. A null text stays null."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rest = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != text])
    packed = df.select(F.xxhash64(F.col(key), whole).alias("row_key"), whole.alias("text"), rest.alias("rest"), F.col(text).isNull().alias("none"))
    clean = F.when(~F.col("none"), redacted(F.col("text"), F.col("spans")))
    masked = _with_spans(packed, rules).select("rest", clean.alias("clean"))
    return masked.select(*[F.col("clean").alias(c) if c == text else F.col(f"rest.`{c}`").alias(c) for c in df.columns])


def redacted(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with the values of its spans replaced; overlapping values become one mask."""
    values = F.array_sort(F.transform(spans, lambda s: F.struct(s["value"].alias("start"), s["end"].alias("end"))))

    def reached(count: Column) -> Column:
        return F.aggregate(F.slice(values, F.lit(1), count), F.lit(0), lambda a, s: F.greatest(a, s["end"]))

    def piece(span: Column, at: Column) -> Column:
        upto = reached(at)
        kept = F.substr(text, upto + 1, F.greatest(span["start"] - upto, F.lit(0)))
        return F.when((at > 0) & (span["start"] <= upto), F.lit("")).otherwise(F.concat(kept, F.lit(mask)))

    rest = F.substr(text, reached(F.size(values)) + 1)
    return F.when(F.size(values) > 0, F.concat(F.array_join(F.transform(values, piece), ""), rest)).otherwise(text)
