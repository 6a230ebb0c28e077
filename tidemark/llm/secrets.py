"""Secret scans with a trigram index: which texts can match a rule is read from postings, then verified.

From each rule's pattern follows a Boolean query of trigrams that any match must hold.  Texts are indexed by the
trigrams of all queries, in blocks of bounded size, so that a trigram in every text has no endless list; each query
is answered by intersecting and uniting lists within a block.  Only its candidates are searched for a rule.  A rule
without such trigrams searches every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 16384
MOST_STRINGS = 64
MOST_CHOICES = 8


def either(word: str) -> str:
    """Pattern of an ASCII word in either case, the same in every engine."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """``pattern`` holds one group, the value of at least ``least`` characters.  Without trigrams to look up, ``probe``
    may name a cheaper pattern that every match holds."""

    kind: str
    pattern: str
    least: int = 0
    probe: str = ""


KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
VALUE = "[A-Za-z0-9+/_.=-]+"
BASE = (
    Rule("assign", "(?:" + "|".join(map(either, KEYWORDS)) + r""")["']?\x20*[:=]\x20*["']?(""" + VALUE + ")", 8),
    Rule("access", "(AKIA[A-Z0-9]{12,})"),  # a shorter run can hold no longer match
    Rule("hex", "([0-9a-f]{32,})", probe="[0-9a-f]{32}"),
)
# A key runs to its END line, with header lines before the body; without one, over lines of base64 and a short last line.
_LINES = r"[\s\\]+[A-Za-z0-9+/=]{16,}"
_KEY_END = r"[^-]*(?:-[^-]+){0,64}-----END [A-Z ]{0,40}PRIVATE KEY-----"
_KEY_HEADERS = r"(?:\s+[A-Za-z]+-[A-Za-z]+:\x20[^\r\n]*){0,8}"
_KEY_LINES = rf"(?:(?:{_LINES}){{60}}[A-Za-z0-9+/=\r\n\\]*|(?:{_LINES}){{1,59}}(?:[\s\\]+[A-Za-z0-9+/]+={{0,2}}(?:[\r\n]|$))?)"
MORE = (
    Rule("github", "(gh[pousr]_[A-Za-z0-9]{36,255})"),
    Rule("google", "(AIza[A-Za-z0-9_-]{35})"),
    Rule("jwt", r"(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})"),
    Rule("pem", rf"(-----BEGIN [A-Z ]{{0,40}}PRIVATE KEY-----(?:{_KEY_END}|{_KEY_HEADERS}{_KEY_LINES})?)"),
    Rule("slack", "(xox[abprs]-[A-Za-z0-9-]{10,})"),
    Rule("stripe", "([rs]k_live_[A-Za-z0-9]{16,})"),
    Rule("url", "([A-Za-z][A-Za-z0-9+.-]{1,20}://[A-Za-z0-9._%-]*:[A-Za-z0-9._%!~*-]{3,}@)"),
)
RULES = BASE + MORE

Query = list[frozenset[str]]  # alternatives, each of trigrams that must all be there


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[k:k + 3] for k in range(len(text) - 2))


def trigram_query(pattern: str) -> Query:
    """Alternatives of lower-case trigrams of which every match holds one in full; empty if there is no such need."""
    terms = _terms(re._parser.parse(pattern))  # noqa: SLF001 - the parse tree of the standard library
    whole = [reduce(frozenset.union, some, frozenset()) for some in product(*terms)] if terms else []
    return [q for q in dict.fromkeys(whole) if not any(o < q for o in whole)]


def _terms(tree) -> list[Query]:
    """Queries that all must hold for a concatenation."""
    terms: list[Query] = []
    now = {""}

    def flush() -> None:
        nonlocal now
        need = [trigrams(s) for s in sorted(now)]
        if all(need):
            terms.append([q for q in need if not any(o < q for o in need)])
        now = {""}

    for op, arg in tree:
        strings, inner = _strings(str(op), arg)
        if strings is not None and len(now) * len(strings) <= MOST_STRINGS:
            now = {a + b for a in now for b in strings}
            continue
        flush()
        if strings is not None:
            now = strings
        terms.extend(inner)
    flush()
    return terms


def _strings(op: str, arg) -> tuple[set[str] | None, list[Query]]:
    """All strings of one item if they are few, else the queries that it alone requires."""
    if op == "LITERAL":
        return {chr(arg).lower()}, []
    if op == "IN":
        if all(str(o) == "LITERAL" for o, _ in arg) and len(arg) <= 2 * MOST_CHOICES:
            chars = {chr(c).lower() for _, c in arg}
            return (chars, []) if len(chars) <= MOST_CHOICES else (None, [])
        return None, []
    if op == "SUBPATTERN":
        return _sequence(arg[-1])
    if op == "BRANCH":
        parts = [_sequence(p) for p in arg[1]]
        if all(s is not None for s, _ in parts):
            found = set().union(*(s for s, _ in parts))
            return (found, []) if len(found) <= MOST_STRINGS else (None, [])
        return None, []
    if op in ("MAX_REPEAT", "MIN_REPEAT"):
        least, most, item = arg
        strings, inner = _sequence(item)
        if least == 0 and most == 1 and strings is not None:
            return strings | {""}, []
        return None, inner if least else []
    return None, []


def _sequence(tree) -> tuple[set[str] | None, list[Query]]:
    now: set[str] | None = {""}
    for op, arg in tree:
        strings, _ = _strings(str(op), arg)
        now = {a + b for a in now for b in strings} if now is not None and strings is not None else None
        if now is None or len(now) > MOST_STRINGS:
            return None, _terms(tree)
    return now, []


def candidates(keyed: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(row_key, rules) of a table (row_key, text): bits of the indexed rules whose query the text's trigrams answer."""
    queries = {k: trigram_query(r.pattern) for k, r in enumerate(rules)}
    grams = sorted({g for q in queries.values() for some in q for g in some})
    number = {g: k for k, g in enumerate(grams)}
    blocks = max(1, keyed.count() // BLOCK_ROWS)
    # the text in small letters is bound once, as the only element of an array, and not made anew for every trigram
    found = F.transform(F.array(F.lower("text")), lambda low: F.array_compact(F.array(*[F.when(low.contains(g), F.lit(k)) for k, g in enumerate(grams)])))
    present = F.get(found, F.lit(0))
    postings = (
        keyed.select("row_key", present.alias("grams")).where(F.size("grams") > 0)
        .withColumn("block", F.pmod(F.col("row_key"), F.lit(blocks)))
        .select("block", "row_key", F.explode("grams").alias("gram"))
        .groupBy("block", "gram").agg(F.collect_set("row_key").alias("rows"))  # a block's distinct rows, however often they repeat
    )
    index = postings.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("gram", "rows"))).alias("lists"))

    def rows_of(query: Query) -> Column:
        def listed(g: str) -> Column:
            return F.coalesce(F.col("lists")[number[g]], F.array().cast("array<long>"))
        return reduce(F.array_union, [F.array_distinct(reduce(F.array_intersect, map(listed, sorted(some)))) for some in query])

    answers = F.array(*[F.struct(F.lit(1 << k).cast("long").alias("rule"), rows_of(q).alias("rows")) for k, q in queries.items() if q])
    return (
        index.select(F.explode(answers).alias("a")).select("a.rule", F.explode("a.rows").alias("row_key"))
        .groupBy("row_key").agg(F.bit_or("rule").alias("rules"))
    )


def rule_spans(rule: Rule, order: int) -> Column:
    """Array of (start, rank, kind, end) in code points of the rule's matches, in order.

    The pattern takes the gap before each match along, so gaps and matches add up to positions; the empty match at
    the end keeps the search linear.
    """
    outer = rf"([\s\S]*?)({rule.pattern}|\z)"
    parts = [F.regexp_extract_all("text", F.lit(outer), F.lit(g)) for g in (1, 2, 3)]
    rows = F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("gap", "hit", "value"))])
    rows = F.transform(rows, lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit"), F.length(x["value"]).alias("value")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        begin = s["at"] + x["gap"]
        span = F.struct(begin.alias("start"), F.lit(order).alias("rank"), F.lit(rule.kind).alias("kind"), (begin + x["hit"]).alias("end"))
        good = (x["hit"] > 0) & (x["value"] >= rule.least)
        return F.struct((begin + x["hit"]).alias("at"), F.when(good, F.array_append(s["out"], span)).otherwise(s["out"]).alias("out"))
    return F.aggregate(rows, start, step, lambda s: s["out"])


def joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def find_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(row, text, found): the row as a struct, its whole text and the sorted spans of all rules.

    A null text has none.  Repeated rows each get their row; ids may be null or repeated.
    """
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("row_key"), "text", F.struct("*").alias("row"))
    hits = candidates(keyed.select("row_key", "text"), rules)
    nothing = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    columns = []
    for k, rule in enumerate(rules):
        if trigram_query(rule.pattern):
            asked = F.coalesce(F.col("rules"), F.lit(0)).bitwiseAND(F.lit(1 << k).cast("long")) != 0
        else:
            asked = F.col("text").rlike(rule.probe) if rule.probe else F.col("text").isNotNull()
        columns.append(F.when(asked, rule_spans(rule, k)).otherwise(nothing))
    rows = keyed.select("row_key", "row").join(hits, "row_key", "left").select("row", F.col("row.text").alias("text"), "rules")
    return rows.select("row", "text", F.array_sort(F.concat(*columns)).alias("found"))


def secret_spans(docs: DataFrame, more: tuple[Rule, ...] = MORE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row."""
    def of_kind(kind: str):
        return lambda s: s["kind"] == kind

    base = [r.kind for r in BASE]
    found = find_spans(docs.select("doc_id", "text"), BASE + more)
    return found.select(
        F.col("row.doc_id").alias("doc_id"),
        *[F.size(F.filter("found", of_kind(k))).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(joined(F.filter("found", lambda s: s["rank"] < len(base))), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )


def redacted(docs: DataFrame, more: tuple[Rule, ...] = MORE, mask: str = "[SECRET]") -> DataFrame:
    """The rows of ``docs``; in ``text``, each stretch covered by spans is replaced by the mask."""
    found = find_spans(docs, BASE + more)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s: Column, x: Column) -> Column:
        fresh = x["start"] >= s["at"]
        piece = F.when(fresh, F.concat(s["out"], F.substring("text", s["at"] + 1, x["start"] - s["at"]), F.lit(mask))).otherwise(s["out"])
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), piece.alias("out"))
    clean = F.aggregate("found", start, step, lambda s: F.concat(s["out"], F.substring("text", s["at"] + 1, F.length("text"))))
    text = F.when(F.size("found") > 0, clean).otherwise(F.col("text"))
    return found.select(*[text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns])


def secret_sql(more: tuple[Rule, ...] = MORE) -> str:
    """The same rows in DuckDB, every rule searched in every text."""
    parts = []
    for k, rule in enumerate(BASE + more):
        outer = rf"([\s\S]*?)({rule.pattern}|\z)".replace("'", "''")
        parts.append(f"""SELECT doc, {k} AS rank, '{rule.kind}' AS kind, unnest(range(len(g))) AS i, g, h, v, {rule.least} AS least FROM (
          SELECT doc, regexp_extract_all(text, '{outer}', 1) AS g, regexp_extract_all(text, '{outer}', 2) AS h, regexp_extract_all(text, '{outer}', 3) AS v FROM d)""")
    def text_of(where: str) -> str:
        return f"coalesce(string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, rank, e) {where}, '')"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS doc, doc_id, coalesce(text, '') AS text FROM documents),
    hits AS ({' UNION ALL '.join(parts)}),
    spans AS (SELECT doc, rank, kind, coalesce(list_sum(list_transform(g[1:i + 1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(h[1:i], lambda x: length(x))), 0) AS b, length(h[i + 1]) AS n FROM hits WHERE h[i + 1] <> '' AND length(v[i + 1]) >= least),
    named AS (SELECT doc, rank, kind, b::BIGINT AS b, (b + n)::BIGINT AS e FROM spans)
    SELECT any_value(doc_id) AS doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
      sha256({text_of("FILTER (rank < 3)")}) AS base_sha256, {text_of('')} AS spans
    FROM d LEFT JOIN named USING (doc) GROUP BY doc"""
