"""Secret scan through a trigram inverted index.

Each rule's regex is turned into a Boolean trigram query: an OR of ANDs of
lower-cased trigrams that every match must hold. The postings of those
trigrams (trigram, document) are joined with the queries' terms and
intersected by document; only candidates are verified with the regex. A rule
without mandatory trigrams (a bare character class) scans every document.
The index covers the trigrams that some rule asks for, over whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as K
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: An exact set of strings wider than this ends the run of exact parts; the query gets weaker, not wrong.
MAX_EXACT = 64


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    group: int = 0
    min_length: int = 0
    base: bool = False


#: The base rules.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, True),
    # maximal runs of 32 and more are the runs of [0-9a-f]+ that are long enough
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, True),
)
#: Further rules.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
)
RULES = BASE_RULES + MORE_RULES


def _exact(node) -> set[str] | None:
    """All strings a node can match, or None if they are many or open."""
    op, arg = node
    if op is K.LITERAL:
        return {chr(arg).lower()}
    if op is K.IN:
        out: set[str] = set()
        for kind, value in arg:
            if kind is K.LITERAL:
                out.add(chr(value).lower())
            elif kind is K.RANGE and value[1] - value[0] < 8:
                out |= {chr(x).lower() for x in range(value[0], value[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if op is K.SUBPATTERN:
        return _exact_all(arg[3])
    if op is K.BRANCH:
        parts = [_exact_all(x) for x in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if op is K.MAX_REPEAT and arg[1] == 1:
        inner = _exact_all(arg[2])
        return None if inner is None else (inner | {""} if arg[0] == 0 else inner)
    if op is K.MAX_REPEAT and arg[0] == arg[1] and arg[1] <= 16:
        inner = _exact_all(arg[2])
        return None if inner is None or len(inner) != 1 else {next(iter(inner)) * arg[0]}
    return None


def _exact_all(nodes) -> set[str] | None:
    out = {""}
    for n in nodes:
        s = _exact(n)
        if s is None or len(s) * len(out) > MAX_EXACT:
            return None
        out = {a + b for a, b in product(out, s)}
    return out


def trigram_query(regex: str) -> list[frozenset[str]] | None:
    """OR of ANDs of trigrams that every match holds; None if there is no such query."""
    best: list[frozenset[str]] | None = None
    run: set[str] = {""}

    def close() -> None:
        nonlocal best
        grams = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in run}
        if all(grams):
            kept = [g for g in grams if not any(o < g for o in grams)]
            if best is None:
                best = kept
            elif len(best) * len(kept) <= MAX_EXACT:
                best = list({a | b for a, b in product(best, kept)})

    def walk(nodes) -> None:
        nonlocal run
        for n in nodes:
            s = _exact(n)
            if s is not None and len(s) * len(run) <= MAX_EXACT:
                run = {a + b for a, b in product(run, s)}
                continue
            close()
            run = {""} if s is None else s
            if s is None and n[0] is K.SUBPATTERN:
                walk(n[1][3])
                close()
                run = {""}

    walk(parser.parse(regex))
    close()
    return sorted(best, key=sorted) if best else None


def postings(docs: DataFrame, grams: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The inverted index: a row ``(gram, id, th)`` for each gram that a text holds in either case."""
    lowered = docs.select(F.col(doc_id).alias("id"), F.xxhash64(text_or_empty(text)).alias("th"),
                          F.lower(text_or_empty(text)).alias("lt"))
    held = F.filter(F.array(*[F.when(F.contains("lt", F.lit(g)), F.lit(g)) for g in grams]), lambda g: g.isNotNull())
    return lowered.select("id", "th", F.explode(held).alias("gram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, th, kinds)``: rules of which a document holds all trigrams of some clause."""
    spark = docs.sparkSession
    terms = [(g, r.kind, k, len(clause)) for r in rules for k, clause in enumerate(trigram_query(r.regex) or [])
             for g in sorted(clause)]
    if not terms:
        return spark.createDataFrame([], "id long, th long, kinds array<string>")
    asked = spark.createDataFrame(terms, "gram string, kind string, clause int, n int")
    found = postings(docs, sorted({t[0] for t in terms}), doc_id, text)
    # broadcast: one row for each trigram of the rules, which are a parameter
    hit = (found.join(F.broadcast(asked), "gram").groupBy("id", "th", "kind", "clause", "n")
           .agg(F.collect_set("gram").alias("grams")).where(F.size("grams") == F.col("n")))
    return hit.groupBy("id", "th").agg(F.collect_set("kind").alias("kinds"))


def _spans(rule: Rule, order: int, text: Column) -> Column:
    """Spans (start, order, end) of a rule's matches, leftmost first and not overlapping, in code points."""
    pattern = F.lit(rule.regex)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    part = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    between = F.split(text, rule.regex, -1)
    rows = F.arrays_zip(F.slice(between, F.lit(1), F.size(whole)).alias("gap"), whole.alias("whole"), part.alias("part"))
    empty = F.array().cast("array<struct<s:int,k:int,e:int,n:int>>")

    def step(acc: Column, row: Column) -> Column:
        start = acc["at"] + F.char_length(row["gap"])
        end = start + F.char_length(row["whole"])
        span = F.struct(start.alias("s"), F.lit(order).alias("k"), end.alias("e"), F.char_length(row["part"]).alias("n"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    found = F.aggregate(rows, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])
    return F.filter(found, lambda x: x["n"] >= rule.min_length)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every secret of every text: ``docs`` with an array column ``secret_spans`` of (kind, start, end, value).

    A null text counts as empty. Offsets are code points, the end exclusive;
    rows are returned as often as they came, whatever their ids.
    """
    kinds = [r.kind for r in rules]
    scanned = [trigram_query(r.regex) is None for r in rules]
    cand = candidates(docs, rules, doc_id, text).select(F.col("id").alias("__id"), F.col("th").alias("__cth"),
                                                        F.col("kinds").alias("__kinds"))
    own = docs.withColumn("__th", F.xxhash64(text_or_empty(text)))
    joined = own.join(cand, F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__cth")), "left")
    body = text_or_empty(text)
    none = F.array().cast("array<struct<s:int,k:int,e:int,n:int>>")
    parts = []
    for i, r in enumerate(rules):
        asked = body.rlike(r.regex)
        if not scanned[i]:
            asked = F.coalesce(F.array_contains("__kinds", r.kind), F.lit(False)) & asked
        parts.append(F.when(asked, _spans(r, i, body)).otherwise(none))
    names = F.array(*[F.lit(k) for k in kinds])
    spans = F.transform(F.sort_array(F.concat(*parts)), lambda x: F.struct(
        F.get(names, x["k"]).alias("kind"), x["s"].alias("start"), x["e"].alias("end"),
        F.substring(body, x["s"] + 1, x["e"] - x["s"]).alias("value")))
    return joined.withColumn("secret_spans", spans).drop("__id", "__cth", "__kinds", "__th")
