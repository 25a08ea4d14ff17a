"""Statements as tables of tokens: parentheses, clauses and subqueries by windows over a statement, and what can be read off them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Strings, quoted names, comments, placeholders, names with their dots, numbers, operators of two characters, all other characters.
TOKEN = (
    r"'(?:[^']|'')*'|\"[^\"]*\"|--[^\n]*|/\*(?s:.*?)\*/|\$\d+|\?|[\p{L}_][\p{L}\p{N}_$]*(?:\.(?:[\p{L}_][\p{L}\p{N}_$]*|\*))*"
    r"|\d+(?:\.\d+)?|<>|!=|<=|>=|\|\||::|[^\s]"
)
CLAUSES = ("SELECT", "FROM", "WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "SET", "VALUES", "INTO", "UNION", "ON", "UPDATE", "DELETE", "INSERT", "JOIN")
WORDS = (
    *CLAUSES, "AND", "OR", "NOT", "IN", "IS", "NULL", "LIKE", "ILIKE", "BETWEEN", "EXISTS", "BY", "AS", "DISTINCT", "ALL", "ANY", "SOME", "CASE", "WHEN", "THEN", "ELSE", "END",
    "ASC", "DESC", "LEFT", "RIGHT", "FULL", "INNER", "OUTER", "CROSS", "NATURAL", "USING", "OFFSET", "INTERSECT", "EXCEPT", "TRUE", "FALSE", "WITH", "FOR",
)
COMPARES = ("=", "<", ">", "<=", ">=", "<>", "!=")

#: Weight of a node of a statement's tree for each level below the root.
FADES = 0.8


def tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """A row for each token of a statement but comments: (key, pos, token, word, kind, depth, scope, caller, leads, nest, query, clause).

    ``word`` is the token in upper case; ``kind`` one of text, quoted, mark (a placeholder), number,
    word, name, sign. ``depth`` counts open parentheses, which belong inside, as do closing ones;
    ``scope`` is the place of the one that is open (-1: none), ``caller`` the word before it and
    ``leads`` the word after it. ``nest`` counts the subqueries around a token, ``query`` is the
    scope of the innermost (-1: the statement itself), ``clause`` the last clause word at the scope's
    own level. Statements are distinct by ``key``, whose rows one task sorts once. A NULL or empty text has no tokens.
    """
    rows = df.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0))).alias("pos", "token")).where(~F.col("token").startswith("--") & ~F.col("token").startswith("/*"))
    first = F.substring("token", 1, 1)
    named = first.rlike(r"[\p{L}_]")
    kind = (
        F.when(first == "'", "text").when(first == '"', "quoted").when((first == "?") | F.col("token").rlike(r"^\$\d+$"), "mark").when(first.rlike("[0-9]"), "number")
        .when(named & F.upper("token").isin(*WORDS), "word").when(named, "name").otherwise("sign")
    )
    opens, closes = F.col("token") == "(", F.col("token") == ")"
    line = Window.partitionBy(key).orderBy("pos")
    now = rows.withColumns({"kind": kind, "word": F.upper("token")}).withColumns(
        {
            "depth": F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(line) + F.when(closes, 1).otherwise(0),
            "_before": F.lag("word").over(line),
            "_named": F.lag("kind").over(line) == "name",
            "_after": F.lead("word").over(line),
        }
    )
    level = Window.partitionBy(key, "depth").orderBy("pos")
    now = now.withColumn("scope", F.coalesce(F.max(F.when(opens, F.col("pos"))).over(level), F.lit(-1)))
    scope = Window.partitionBy(key, "depth", "scope").orderBy("pos")
    opened = lambda c: F.when(F.col("scope") >= 0, F.first(c).over(scope))
    now = now.withColumns({"caller": opened("_before"), "called": F.coalesce(opened("_named"), F.lit(False)), "leads": opened("_after")})
    sub = F.coalesce(F.col("leads") == "SELECT", F.lit(False))
    now = now.withColumn("nest", F.sum(F.when(opens & sub, 1).when(closes & sub, -1).otherwise(0)).over(line) + F.when(closes & sub, 1).otherwise(0))
    nested = Window.partitionBy(key, "nest").orderBy("pos")
    now = now.withColumn("query", F.coalesce(F.max(F.when(opens & sub, F.col("pos"))).over(nested), F.lit(-1)))
    clause = F.last(F.when(F.col("kind").eqNullSafe("word") & F.col("word").isin(*CLAUSES), F.col("word")), ignorenulls=True).over(scope)
    return now.withColumn("clause", clause).drop("_before", "_named", "_after")


def in_clause(rows: DataFrame, key: str) -> DataFrame:
    """Adds ``part``: the last clause word of the innermost subquery around a token, whatever parentheses are open within it."""
    own = F.col("scope") == F.col("query")
    within = Window.partitionBy(key, "nest", "query").orderBy("pos")
    word = F.when(own & (F.col("kind") == "word") & F.col("word").isin(*CLAUSES), F.col("word"))
    return rows.withColumn("part", F.last(word, ignorenulls=True).over(within))


def probes(df: DataFrame, key: str, text: str) -> DataFrame:
    """What a statement's tokens show, a row for each key: tables, columns, functions, calls, in_lists, longest_list, subqueries, height, joins, marks, normalised.

    ``tables`` follow FROM, JOIN, INTO or UPDATE, also after commas; ``columns`` are compared in the
    WHERE of the statement itself; ``functions`` are called in any WHERE; ``in_lists`` counts IN with values, ``longest_list``
    their most; ``height`` is how deep subqueries are nested; ``marks`` are the placeholders, and a statement is
    ``normalised`` if it has any, and no text or number beside them. Arrays are sorted and distinct.
    """
    rows = in_clause(tokens(df, key, text), key)
    line = Window.partitionBy(key).orderBy("pos")
    rows = rows.withColumns({"_prev": F.lag("word").over(line), "_next": F.lead("word").over(line), "_prev_comma": F.lag("token").over(line) == ","})
    is_name = F.col("kind").isin("name", "quoted")
    listed = is_name & (F.col("part").isin("FROM", "JOIN", "INTO", "UPDATE")) & (F.col("scope") == F.col("query"))
    table = listed & (F.col("_prev").isin("FROM", "JOIN", "INTO", "UPDATE", "ONLY") | (F.col("_prev_comma") & (F.col("part") == "FROM")))
    column = is_name & (F.col("part") == "WHERE") & (F.col("query") == -1) & (F.col("_next").isin(*COMPARES, "LIKE", "ILIKE", "IN", "IS", "BETWEEN", "NOT"))
    call = F.when(F.col("token").eqNullSafe("(") & F.col("called") & (F.col("part") == "WHERE"), F.lower("caller"))
    values = F.col("caller").eqNullSafe("IN") & ~F.col("leads").eqNullSafe("SELECT")
    found = rows.groupBy(key).agg(
        F.array_sort(F.collect_set(F.when(table, F.lower("token")))).alias("tables"),
        F.array_sort(F.collect_set(F.when(column, F.lower("token")))).alias("columns"),
        F.array_sort(F.collect_set(call)).alias("functions"),
        F.count(call).alias("calls"),
        F.count_if(values & (F.col("token") == "(")).alias("in_lists"),
        F.count_if(F.col("leads").eqNullSafe("SELECT") & (F.col("token") == "(")).alias("subqueries"),
        F.max("nest").alias("height"),
        F.count_if((F.col("kind") == "word") & (F.col("word") == "JOIN")).alias("joins"),
        F.array_sort(F.collect_set(F.when(F.col("kind") == "mark", F.col("token")))).alias("marks"),
        F.bool_or(F.col("kind").isin("text", "number")).alias("_literal"),
    )
    lists = rows.where(values).groupBy(key, "scope").agg((F.count_if(F.col("token") == ",") + 1).alias("n")).groupBy(key).agg(F.max("n").alias("longest_list"))
    return found.join(lists, key, "left").withColumns({"longest_list": F.coalesce("longest_list", F.lit(0)), "normalised": (F.size("marks") > 0) & ~F.col("_literal")}).drop("_literal")


def tree_nodes(df: DataFrame, key: str, text: str, literals: bool = True) -> DataFrame:
    """(key, path, item, level, n): the clauses of a statement and of its subqueries, and what stands in them, n times.

    A clause has an empty item and the level of its query; its items are what commas, or AND and OR
    outside BETWEEN, part at the query's own level, at the level below. A subquery's path is that of the clause
    it stands in and its number there; its own clauses are two levels below. Without ``literals`` texts and numbers are alike.
    """
    rows = in_clause(tokens(df, key, text), key)
    own = F.col("scope") == F.col("query")
    within = Window.partitionBy(key, "nest", "query").orderBy("pos")
    parts = F.when(own & F.col("word").isin("BETWEEN", "AND", "OR"), F.col("word"))
    rows = rows.withColumn("_open", F.last(parts, ignorenulls=True).over(within)).withColumn("_open", F.lag("_open").over(within))
    between = F.col("_open") == "BETWEEN"
    head = own & (F.col("kind") == "word") & F.col("word").isin(*CLAUSES)
    cut = head | (own & ((F.col("token") == ",") | (F.col("word") == "OR") | ((F.col("word") == "AND") & ~F.coalesce(between, F.lit(False)))))
    edge = (F.col("pos") == F.col("query")) | (own & (F.col("token") == ")")) | (F.col("token") == ";")
    shown = F.when(~F.lit(literals) & F.col("kind").isin("text", "number"), "?").when(F.col("kind").isin("text", "quoted"), F.col("token")).otherwise(F.lower("token"))
    rows = rows.withColumns({"_no": F.sum(cut.cast("int")).over(within), "_cut": cut, "_edge": edge, "_shown": shown})
    pieces = rows.where(~F.col("_cut") & ~F.col("_edge") & F.col("part").isNotNull()).groupBy(key, "query", "part", "_no")
    items = pieces.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_shown"))), lambda t: t["_shown"]), " ").alias("item"))
    clauses = rows.where(head).select(key, "query", F.col("word").alias("part"), F.lit("").alias("item")).distinct()
    # Where a subquery stands: the query and clause around its opening parenthesis.
    line = Window.partitionBy(key).orderBy("pos")
    starts = rows.where((F.col("token") == "(") & (F.col("pos") == F.col("query"))).select(key, F.col("query").alias("child"), F.col("nest").alias("level"))
    around = Window.partitionBy(key, "_level").orderBy("pos")
    both = rows.select(key, "pos", F.col("nest").alias("_level"), "query", "part").unionByName(starts.select(key, F.col("child").alias("pos"), (F.col("level") - 1).alias("_level"), F.lit(None).cast("int").alias("query"), F.lit(None).cast("string").alias("part")))
    placed = both.withColumns({"_query": F.last("query", ignorenulls=True).over(around), "_part": F.last("part", ignorenulls=True).over(around)}).where("query is null")
    number = Window.partitionBy(key, "_query", "_part").orderBy("pos")
    nested = placed.select(key, F.col("pos").alias("child"), "_query", F.concat(F.lower(F.coalesce("_part", F.lit(""))), F.lit("/"), F.row_number().over(number)).alias("step"), (F.col("_level") + 1).alias("level"))
    paths = df.select(key, F.lit(-1).alias("query"), F.lit("").alias("path"), F.lit(0).alias("level"))
    now, k = paths, 1
    deepest = nested.agg(F.max("level")).first()[0] or 0
    while k <= deepest:
        below = nested.where(F.col("level") == k).join(now.select(key, F.col("query").alias("_query"), F.col("path").alias("_above")), [key, "_query"])
        now = below.select(key, F.col("child").alias("query"), F.concat("_above", F.lit("/"), "step").alias("path"), F.lit(2 * k).alias("level"))
        paths, k = paths.unionByName(now), k + 1
    nodes = clauses.unionByName(items.drop("_no")).join(paths, [key, "query"])
    level = F.col("level") + F.when(F.col("item") == "", 0).otherwise(1)
    return nodes.groupBy(key, F.concat("path", F.lit("/"), F.lower("part")).alias("path"), "item", level.alias("level")).agg(F.count(F.lit(1)).alias("n"))


def tree_similarity(pairs: DataFrame, a: str, b: str, nodes: DataFrame, key: str) -> DataFrame:
    """``pairs`` with ``similarity``: over the nodes of the first statement's tree that the second has too, 0.8 to the power of their level."""
    left = pairs.select(a, b).distinct().join(nodes.select(F.col(key).alias(a), "path", "item", "level", "n"), a)
    both = left.join(nodes.select(F.col(key).alias(b), "path", "item"), [b, "path", "item"])
    scores = both.groupBy(a, b).agg(F.sum(F.col("n") * F.pow(F.lit(FADES), F.col("level"))).alias("similarity"))
    return pairs.join(scores, [a, b], "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))


def _joined(rows: DataFrame, key: str, piece: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", piece.alias("piece")))), lambda t: t["piece"]), "")


def standardised(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, standard): each statement on one line without comments, its words in upper and its names in lower case, spaced alike.

    Texts and quoted names stay as they are. A NULL or empty text has no row.
    """
    line = Window.partitionBy(key).orderBy("pos")
    rows = tokens(df, key, text).withColumns({"_prev": F.lag("token").over(line), "_prev_kind": F.lag("kind").over(line)})
    tight = F.col("token").isin(",", ")", ";", ".", "::") | F.col("_prev").isin("(", ".", "::") | ((F.col("token") == "(") & (F.col("_prev_kind") == "name")) | F.col("_prev").isNull()
    shown = F.when(F.col("kind") == "word", F.col("word")).when(F.col("kind") == "name", F.lower("token")).otherwise(F.col("token"))
    return rows.groupBy(key).agg(_joined(rows, key, F.concat(F.when(tight, "").otherwise(" "), shown)).alias("standard"))


def numbered(df: DataFrame, key: str, text: str, literals: bool = False) -> DataFrame:
    """(key, numbered, marks): each ? as $1, $2, ... in order, with ``literals`` each text and number too; all else as it is, ? in texts and comments too.

    ``marks`` counts them. A NULL text has no row.
    """
    found, gaps = F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0)), F.split(F.col(text), TOKEN, -1)
    parts = F.arrays_zip(gaps.alias("gap"), F.concat(found, F.array(F.lit(""))).alias("token"))
    rows = df.where(F.col(text).isNotNull()).select(key, F.posexplode(parts).alias("pos", "p")).select(key, "pos", "p.gap", "p.token")
    mark = (F.col("token") == "?") | (F.lit(literals) & F.col("token").rlike("^['0-9]"))
    count = F.sum(mark.cast("int")).over(Window.partitionBy(key).orderBy("pos"))
    rows = rows.withColumns({"_mark": mark, "_n": count})
    piece = F.concat("gap", F.when(F.col("_mark"), F.concat(F.lit("$"), F.col("_n").cast("string"))).otherwise(F.col("token")))
    return rows.groupBy(key).agg(_joined(rows, key, piece).alias("numbered"), F.count_if("_mark").alias("marks"))


def prepared(df: DataFrame, key: str, text: str, name: Column) -> DataFrame:
    """(key, statements): what prepares a statement under ``name``, explains it with NULL for each placeholder, and lets it go."""
    named = df.select(key, name.alias("_name"))
    body = F.regexp_replace(F.trim("numbered"), r"[;\s]+$", "")
    given = F.when(F.col("marks") > 0, F.concat(F.lit("("), F.array_join(F.array_repeat(F.lit("NULL"), F.col("marks").cast("int")), ","), F.lit(")"))).otherwise("")
    lines = F.array(F.concat(F.lit("prepare "), "_name", F.lit(" as "), body), F.concat(F.lit("explain execute "), "_name", given), F.concat(F.lit("deallocate prepare "), "_name"))
    return numbered(df, key, text).join(named, key).select(key, lines.alias("statements"))
