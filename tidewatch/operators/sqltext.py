"""Statement texts: templates, kinds, hashes, patterns, similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.similarity import nearest
from tidewatch.sources.store import shuffled

KINDS = ("SELECT", "UPDATE", "DELETE", "INSERT")


def unify(sql: Column) -> Column:
    """One line, no comments, spaces around operators, upper case."""
    out = F.regexp_replace(sql, r"--[^\n]*", " ")
    out = F.regexp_replace(out, r"/\*[^*]*\*+([^/*][^*]*\*+)*/", " ")
    out = F.regexp_replace(out, r"([<>!=]=|<>|[=<>])", " $1 ")
    return F.upper(F.trim(F.regexp_replace(out, r"\s+", " ")))


def templatise(sql: Column) -> Column:
    """Literals, numbers and $n become ?; the rows of VALUES go."""
    out = F.regexp_replace(unify(sql), r"VALUES ?\(.*\)", "VALUES")
    out = F.regexp_replace(out, r"'[^']*'", "?")
    return F.regexp_replace(out, r"(\$[0-9]+|\b[0-9]+(\.[0-9]+)?\b)", "?")


def workload_template(sql: Column, mark: str = "@@@") -> Column:
    """Literals become a mark, keeping case and spacing."""
    out = F.regexp_replace(sql, r"'[^']*'", mark)
    return F.regexp_replace(out, r"\b[0-9]+(\.[0-9]+)?\b", mark)


def kind_letter(sql: Column) -> Column:
    head = F.upper(F.ltrim(sql))
    out = F.lit("O")
    for kind in reversed(KINDS):
        out = F.when(head.startswith(kind), kind[0]).otherwise(out)
    return out


def kind_contained(sql: Column) -> Column:
    up, out = F.upper(sql), F.lit("OTHER")
    for kind in reversed(KINDS):
        out = F.when(up.contains(kind), kind).otherwise(out)
    return out


def touches_system_table(sql: Column) -> Column:
    return F.upper(sql).contains("PG_")


def _codes(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))


def dek_hash(text: Column) -> Column:
    """Knuth's hash on 32 bits, from the length."""
    step = lambda h, c: F.shiftleft(h, 5).bitwiseXOR(F.shiftright(h, 27)).bitwiseXOR(c).bitwiseAND(F.lit(4294967295))
    return F.aggregate(_codes(text), F.length(text).cast("long"), step)


def djb_hash(text: Column) -> Column:
    """Bernstein's hash on 32 bits."""
    return F.aggregate(_codes(text), F.lit(5381).cast("long"), lambda h, c: (h * 33 + c).bitwiseAND(F.lit(4294967295)))


def duration_seconds(text: Column) -> Column:
    """1d2h3m4s in seconds; parts may be missing."""
    part = lambda unit: F.coalesce(F.nullif(F.regexp_extract(text, rf"(\d+){unit}", 1), F.lit("")).cast("long"), F.lit(0))
    return part("w") * 604_800 + part("d") * 86_400 + part("h") * 3_600 + part("m") * 60 + part("s")


def step_ms(total_seconds: Column, interval: int) -> Column:
    """None for ranges up to an hour, else coarser in proportion."""
    return F.when(total_seconds > 3600, F.floor(total_seconds * interval / 3600 * 1000).cast("long"))


def epoch_seconds(text: Column) -> Column:
    return F.unix_timestamp(F.split_part(text, F.lit("."), F.lit(1)), "yyyy-MM-dd HH:mm:ss")


def patterns(sql: Column) -> dict[str, Column]:
    """What a statement's text shows of costly forms."""
    up = F.upper(sql)
    return {
        "leading_wildcard": up.rlike(r"LIKE\s+'%"),
        "trailing_wildcard": up.rlike(r"LIKE\s+'[^']*%'"),
        "random_order": up.rlike(r"ORDER\s+BY\s+RANDOM\(\)"),
        "count_distinct": up.rlike(r"COUNT\(\s*DISTINCT"),
        "count_all": up.rlike(r"COUNT\(\s*\*\s*\)"),
    }


def statements(df: DataFrame, script: str) -> DataFrame:
    """A row for each statement of a script."""
    parts = F.filter(F.transform(F.split(script, ";"), lambda s: F.trim(s)), lambda s: s != "")
    return df.withColumn("statement", F.explode(parts))


def fill_parameters(sql: Column, values: Column) -> Column:
    """$1, $2, ... replaced by the values, the highest number first."""
    numbered = F.reverse(F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1))))
    return F.when(F.size(values) == 0, sql).otherwise(F.aggregate(numbered, sql, lambda s, k: F.replace(s, F.concat(F.lit("$"), k.cast("string")), F.element_at(values, k))))


def strip_parameters(sql: Column) -> Column:
    return F.regexp_replace(sql, r"(?i);?\s*parameters:.*$", "")


def index_parts(indexdef: Column) -> dict[str, Column]:
    """Columns, uniqueness and scope of an index definition."""
    inside = F.regexp_extract(indexdef, r"\(([^)]*)\)", 1)
    return {
        "columns": F.transform(F.split(inside, ","), lambda c: F.trim(c)),
        "is_unique": F.upper(indexdef).contains("CREATE UNIQUE"),
        "scope": F.when(F.upper(indexdef).rlike(r"\)\s+GLOBAL"), "global").when(F.upper(indexdef).rlike(r"\)\s+LOCAL"), "local").otherwise(""),
    }


def list_overlap(a: Column, b: Column) -> Column:
    """Shared words over the longer list."""
    return F.size(F.array_intersect(a, b)) / F.nullif(F.greatest(F.size(a), F.size(b)), F.lit(0))


def inverse_levenshtein(a: Column, b: Column) -> Column:
    """1 / distance; NULL for equal texts."""
    return 1 / F.nullif(F.levenshtein(a, b), F.lit(0))


def char_cosine(df: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """(key, cosine) of the character counts of two texts."""
    chars = lambda c, n: df.select(key, F.explode(F.filter(F.split(c, ""), lambda x: x != "")).alias("_c")).groupBy(key, "_c").agg(F.count(F.lit(1)).alias(n))
    both = chars(a, "_a").join(chars(b, "_b"), [key, "_c"], "full").na.fill(0, ["_a", "_b"])
    sums = both.groupBy(key).agg((F.sum(F.col("_a") * F.col("_b")) / F.nullif(F.sqrt(F.sum(F.col("_a") * F.col("_a")).cast("double")) * F.sqrt(F.sum(F.col("_b") * F.col("_b")).cast("double")), F.lit(0.0))).alias("cosine"))
    return sums


def illegal(sql: Column) -> Column:
    return ~F.upper(F.ltrim(sql)).rlike(r"^(SELECT|UPDATE|DELETE|INSERT|WITH|CREATE|ALTER|DROP)\b")


def iterated_mean(durations: Column) -> Column:
    """((first + second) / 2 + third) / 2 ...: later ones weigh more."""
    return F.aggregate(F.slice(durations, F.lit(2), F.greatest(F.size(durations) - 1, F.lit(0))), F.element_at(durations, 1), lambda a, x: (a + x) / 2)


def duration_model(history: DataFrame, template: str, order: str, duration: str, last: int = 10) -> DataFrame:
    """(template, mean, expected): of the last executions their mean, and their iterated mean in time order."""
    from tidewatch.operators.results import top_in_group

    recent = top_in_group(history, [template], [F.col(order).desc()], last)
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, duration))), lambda s: s[duration])
    return recent.groupBy(template).agg(F.avg(duration).alias("mean"), listed.alias("_d")).select(template, "mean", iterated_mean(F.col("_d")).alias("expected"))


# --- execution plans -----------------------------------------------------------------------------


def plan_nodes(df: DataFrame, key: str, text: str) -> DataFrame:
    """A row for each operator of an indented plan text: (key, node, level, name, start_cost, total_cost, rows, width)."""
    line = F.posexplode(F.split(text, "\n"))
    head = r"^\s*(?:->\s+)?(.+?)\s+\(cost=([0-9.]+)\.\.([0-9.]+) rows=([0-9]+) width=([0-9]+)\)"
    lines = df.select(key, line.alias("node", "_line")).where(F.col("_line").rlike(head))
    part = lambda k: F.regexp_extract("_line", head, k)
    return lines.select(
        key, F.col("node").cast("long").alias("node"), F.length(F.regexp_extract("_line", r"^(\s*)", 1)).cast("long").alias("indent"), part(1).alias("name"),
        part(2).cast("double").alias("start_cost"), part(3).cast("double").alias("total_cost"), part(4).cast("long").alias("rows"), part(5).cast("long").alias("width"),
    )


def plan_tree(nodes: DataFrame, key: str) -> DataFrame:
    """Adds ``parent``: the last node above with a smaller indent."""
    from pyspark.sql import Window

    above = Window.partitionBy(key).orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.collect_list(F.struct("node", "indent")).over(above)
    return nodes.withColumn("parent", F.array_max(F.transform(F.filter(seen, lambda n: n["indent"] < F.col("indent")), lambda n: n["node"])))


def own_cost(tree: DataFrame, key: str) -> DataFrame:
    """Adds ``own_cost``: the total less that of its costliest child, or, where a node starts before that child ends, less the latest start of a child."""
    children = tree.where("parent is not null").groupBy(key, F.col("parent").alias("node")).agg(F.max("total_cost").alias("_total"), F.max("start_cost").alias("_start"))
    total, start = F.coalesce("_total", F.lit(0.0)), F.coalesce("_start", F.lit(0.0))
    below = F.when(F.col("start_cost") >= total, total).otherwise(start)
    return tree.join(shuffled(children), [key, "node"], "left").withColumn("own_cost", F.col("total_cost") - below).drop("_total", "_start")


def sorted_operators(tree: DataFrame, key: str) -> DataFrame:
    """Adds ``place``: operators by own cost, largest first, sorts before all others."""
    from pyspark.sql import Window

    order = Window.partitionBy(key).orderBy(F.col("name").contains("Sort").desc(), F.col("own_cost").desc(), "node")
    return tree.withColumn("place", F.row_number().over(order))


def plan_complexity(nodes: DataFrame, key: str) -> DataFrame:
    """(key, joins, height) of each plan; a level is a distinct indent."""
    join = F.col("name").rlike("Join|Nested Loop")
    return nodes.groupBy(key).agg(F.count_if(join).alias("joins"), F.count_distinct("indent").alias("height"))


def poor_joins(tree: DataFrame, key: str, rate: float = 0.02, nested: int = 10_000, large: int = 50_000) -> DataFrame:
    """(key, node, reason): costly joins, and whether their inputs are too large for their kind."""
    inputs = tree.where("parent is not null").groupBy(key, F.col("parent").alias("node")).agg(F.min("rows").alias("_least"), F.max("rows").alias("_most"))
    whole = tree.groupBy(key).agg(F.max("total_cost").alias("_whole"))
    costly = tree.where(F.col("name").rlike("Join|Nested Loop")).join(inputs, [key, "node"]).join(whole, key).where(F.col("own_cost") >= rate * F.col("_whole"))
    reason = F.when(F.col("name").contains("Nested Loop") & (F.col("_least") >= nested), "nested loop over large inputs").when(F.col("name").contains("Merge"), "merge join").when(F.col("_most") >= large, "large join").otherwise("costly join")
    return costly.withColumn("reason", reason).select(key, "node", "reason")


def nearest_templates(statements: DataFrame, text: str, templates: DataFrame, template: str, k: int) -> DataFrame:
    """Each row of ``statements`` with its ``k`` most similar templates by inverse edit distance, but for equal ones: adds ``template`` and ``similarity``.

    Ties go by template. Distinct texts meet distinct templates; repeated rows get the same answers each, a NULL text none.
    """
    from tidewatch.operators.results import top_in_group

    head = F.lit(0).alias("head")
    near = nearest(statements.select(head, F.col(text).alias("text")), templates.select(head, F.col(template).alias("text")), k, equal=False)
    best = top_in_group(near, ["text"], [F.col("distance"), F.col("known")], k)
    return statements.join(best.select(F.col("text").alias(text), F.col("known").alias(template), (1 / F.col("distance")).alias("similarity")), text)


def placeholders(sql: Column) -> Column:
    """Each ? becomes $1, $2, ... in order."""
    parts = F.split(sql, r"\?")
    numbered = F.transform(parts, lambda p, k: F.when(k == 0, p).otherwise(F.concat(F.lit("$"), k.cast("string"), p)))
    return F.array_join(numbered, "")


def formatted(sql: Column) -> Column:
    """Keywords in upper case at the beginning of lines."""
    out = F.trim(F.regexp_replace(sql, r"\s+", " "))
    for word in ("select", "from", "where", "group by", "having", "order by", "limit", "union all", "set", "values"):
        out = F.regexp_replace(out, rf"(?i)\s*\b{word.replace(' ', ' +')}\b", f"\n{word.upper()}")
    return F.trim(F.regexp_replace(out, r"^\n", ""))


def fine_template(sql: Column, tables: list[str], columns: list[str]) -> Column:
    """A template whose tables and columns have no names either."""
    out = templatise(sql)
    for names, mark in ((tables, "tab"), (columns, "col")):
        out = F.regexp_replace(out, rf"\b({'|'.join(n.upper() for n in names)})\b", mark) if names else out
    return out


def keyword(template: Column) -> Column:
    """The statement's first word where a model keeps templates of it apart, else OTHER."""
    first = F.split_part(F.trim(template), F.lit(" "), F.lit(1))
    return F.when(first.isin(*KINDS), first).otherwise("OTHER")


def predict_duration(statements: DataFrame, model: DataFrame, text: str, k: int = 3) -> DataFrame:
    """(text, seconds, status) of each distinct statement.

    ``model`` has (template, mean, expected). Illegal texts are told first. A known template takes its
    ``expected``; another takes the ``mean`` of its ``k`` nearest templates of the same keyword, by edit
    distance, weighted by similarity (of equal similarity the larger mean, then the later template);
    where the model has no template of the keyword there is no information. NULL texts are left out.
    """
    from tidewatch.operators.results import top_in_group

    asked = statements.select(text).where(F.col(text).isNotNull()).distinct().withColumn("template", templatise(F.col(text))).withColumn("head", keyword(F.col("template")))
    known = model.select("template", "mean", "expected", keyword(F.col("template")).alias("head"))
    bad = asked.where(illegal(F.col(text))).select(text, F.lit(None).cast("double").alias("seconds"), F.lit("Suspect illegal sql").alias("status"))
    legal = asked.where(~illegal(F.col(text))).join(known.select("template", "expected"), "template", "left")
    exact = legal.where("expected is not null").select(text, F.col("expected").alias("seconds"), F.lit("Fine match").alias("status"))
    rest = legal.where("expected is null").select(text, "head", "template")
    met = nearest(rest.select("head", F.col("template").alias("text")), known.select("head", F.col("template").alias("text")), k)
    valued = met.join(known.select("head", F.col("template").alias("known"), "mean"), ["head", "known"])
    best = top_in_group(valued, ["head", "text"], [F.col("distance"), F.col("mean").desc(), F.col("known").desc()], k)
    guessed = best.groupBy("head", F.col("text").alias("template")).agg((F.sum(F.col("mean") / F.col("distance")) / F.sum(1 / F.col("distance"))).alias("seconds"))
    status = F.when(F.col("seconds").isNull(), "No SQL information").otherwise("No SQL template found")
    return exact.unionByName(bad).unionByName(rest.join(guessed, ["head", "template"], "left").select(text, "seconds", status.alias("status")))
