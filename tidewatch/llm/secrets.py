"""Secret scans through an index of mandatory trigrams, in SQL functions only."""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from re import _constants as _code
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import written


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: The group whose length decides, and the least length.
    group: int = 0
    least: int = 0
    #: A pattern that a text holds if it holds a match that is long enough.
    screen: str = ""


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either_case("api") + "_?" + _either_case("key")

#: The kinds that are counted.
BASE = (
    Rule("assign", rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16, r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]+", 0, 32, r"[0-9a-f]{32,}"),
)
#: Kinds that only add spans.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]+", 0, 40, r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abp]-[0-9A-Za-z-]+", 0, 20, r"xox[abp]-[0-9A-Za-z-]{15,}"),
)
RULES = BASE + MORE
MASK = "[secret]"


# --- trigram queries -------------------------------------------------------------------------

#: Alternatives, each a set of trigrams that all must occur; the empty set demands nothing.
Query = frozenset[frozenset[str]]
_ANY: Query = frozenset([frozenset()])


def _grams(strings: set[str]) -> Query:
    return frozenset(frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in strings)


def _both(a: Query, b: Query) -> Query:
    """Both must hold; alternatives that demand more than another are dropped."""
    joined = {x | y for x, y in itertools.product(a, b)}
    return frozenset(x for x in joined if not any(y < x for y in joined))


def _walk(parsed) -> tuple[set[str] | None, Query]:
    """The strings that a parsed pattern matches, if they are few, and what must occur in any match."""
    exact: set[str] | None = {""}
    must = _ANY

    def close() -> None:
        nonlocal exact, must
        if exact is not None:
            must = _both(must, _grams(exact))
        exact = None

    for op, arg in parsed:
        strings: set[str] | None = None
        inner = _ANY
        if op is _code.LITERAL:
            strings = {chr(arg).lower()}
        elif op is _code.IN and all(x[0] is _code.LITERAL for x in arg) and len({chr(x[1]).lower() for x in arg}) <= 4:
            strings = {chr(x[1]).lower() for x in arg}
        elif op is _code.SUBPATTERN:
            strings, inner = _walk(arg[3])
        elif op is _code.BRANCH:
            parts = [_walk(x) for x in arg[1]]
            if all(p[0] is not None for p in parts):
                strings = set().union(*(p[0] for p in parts))
            else:
                inner = frozenset().union(*(p[1] if p[0] is None else _grams(p[0]) for p in parts))
        elif op is _code.MAX_REPEAT and arg[1] == 1 and arg[0] == 0:
            some, _ = _walk(arg[2])
            strings = None if some is None else some | {""}
        elif op is _code.MAX_REPEAT and arg[0] >= 1:
            some, inner = _walk(arg[2])
            inner = inner if some is None else _grams(some)
        if strings is not None and exact is not None and len(exact) * len(strings) <= 64:
            exact = {a + b for a in exact for b in strings}
        else:
            close()
            must = _both(must, inner if strings is None else _grams(strings))
            exact = strings if strings is not None else {""}
    return exact if must == _ANY else None, must if exact is None else _both(must, _grams(exact))


def trigram_query(pattern: str) -> Query:
    """Which lower-cased trigrams a text must hold for the pattern to match; an empty alternative: any text."""
    exact, must = _walk(_parser.parse(pattern))
    query = _grams(exact) if exact is not None else must
    return _ANY if frozenset() in query else query


# --- index -----------------------------------------------------------------------------------


#: A row is known by its id and a digest of its text, so no null or repeated id gathers rows.
_KEY = "struct(doc_id, xxhash64(text) as h)"


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, rules array<string>): the documents, as _KEY, that hold all trigrams of an alternative of a rule.

    The inverted index has a posting for each trigram that some rule asks for and each document whose
    text holds it. An alternative's postings are intersected by counting them for each document.
    """
    spark = docs.sparkSession
    asked = [(r.kind, k, sorted(grams)) for r in rules for k, grams in enumerate(sorted(map(sorted, trigram_query(r.pattern)))) if grams]
    trigrams = sorted({g for *_, grams in asked for g in grams})
    present = F.array_compact(F.array(*(F.when(F.contains(F.col("low"), F.lit(g)), F.lit(g)) for g in trigrams)))
    # A projection of its own, so that a text is lower-cased once and not for each trigram.
    postings = docs.select(F.expr(_KEY).alias("key"), F.lower("text").alias("low")).select("key", F.explode(present).alias("trigram"))
    wanted = spark.createDataFrame([(kind, k, len(grams), g) for kind, k, grams in asked for g in grams], "kind string, branch int, need int, trigram string")
    # As many rows as the rules have trigrams, so the broadcast is bounded.
    met = (
        postings.join(F.broadcast(wanted), "trigram")
        .groupBy("key", "kind", "branch", "need")
        .agg(F.size(F.collect_set("trigram")).alias("found"))
        .where("found = need")
    )
    return met.groupBy("key").agg(F.collect_set("kind").alias("rules"))


# --- verification ----------------------------------------------------------------------------

_NO_SPANS = "cast(array() as array<struct<start:int,kind:int,end:int>>)"


def _spans(rule: Rule, number: int, text: Column) -> Column:
    """The rule's matches in ``text`` as (start, kind's number, end), without those that are too short.

    What lies between matches, and the matches, are laid end to end to get offsets.
    """
    pattern = F.lit(rule.pattern)
    gaps, hits = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    decisive = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else hits
    pieces = F.zip_with(
        F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(F.length(g).alias("g"), F.length(h).alias("h"))),
        decisive,
        lambda p, d: F.struct(p["g"].alias("g"), p["h"].alias("h"), (F.length(d) >= rule.least).alias("ok")),
    )
    start = F.struct(F.lit(0).alias("at"), F.expr(_NO_SPANS).alias("out"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + p["g"]
        end = begin + p["h"]
        new = F.array(F.struct(begin.alias("start"), F.lit(number).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(p["ok"], F.concat(acc["out"], new)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(pieces, start, step, lambda acc: acc["out"])


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with ``spans array<struct<start, kind, end>>`` in order of start and kind; kind counts ``rules``.

    Offsets are code points, ends exclusive. Rules without mandatory trigrams scan every text, the
    others the candidates of the index. Null texts hold nothing; repeated rows and ids are all
    verified on their own text; all columns of ``docs`` stay, but for one called ``spans``.
    """
    # Written first, so that Spark knows the candidates' size: few are broadcast and no text is
    # shuffled; beyond Spark's threshold both sides are shuffled by key.
    found = written(candidates(docs.select("doc_id", "text"), rules))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "spans")).alias("row"), "text", F.expr(_KEY).alias("_key"))
    joined = rows.join(found, rows["_key"].eqNullSafe(found["key"]), "left")
    parts = []
    for number, rule in enumerate(rules):
        text = F.col("text")
        holds = text.rlike(rule.screen or rule.pattern)
        if trigram_query(rule.pattern) != _ANY:
            holds = F.array_contains("rules", rule.kind) & holds
        parts.append(F.when(holds, _spans(rule, number, text)).otherwise(F.expr(_NO_SPANS)))
    return joined.select("row.*", F.array_sort(F.concat(*parts)).alias("spans"))


def _listed(spans: Column, rules: tuple[Rule, ...]) -> Column:
    names = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def secret_columns(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every document.

    Null and empty texts have no spans; an empty table gives no rows; other columns are ignored.
    """
    found = find_secrets(docs.select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = {k})) as long)").alias(f"n_{r.kind}") for k, r in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(_listed(base, RULES), 256).alias("base_sha256"), _listed(F.col("spans"), RULES).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with MASK in place of every secret; overlapping secrets share a mask.

    Null and empty texts stay as they are, repeated rows are masked alike, an empty table gives no
    rows, and other columns keep their values whatever they are called.
    """
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        before = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], before, F.lit(MASK))).otherwise(acc["out"]).alias("out"))

    masked = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    packed = docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("all"))
    kept = find_secrets(packed).select("all", F.when(F.size("spans") > 0, masked).otherwise(F.col("text")).alias("text"))
    return kept.select(*(F.col("text") if c == "text" else F.col("all").getField(c).alias(c) for c in docs.columns))
