"""Question-answer examples from nodes, edges and summaries.

All choices are seeded hashes of the node id and all limits break ties on the id,
so a run repeats. A limit comes before the length filter and is not back-filled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.scalar import hash_number, pick, shuffle_order, text_or_none
from graphloom.operators.graph import out_degree_topk

MIN_SUMMARY = 20
POOL = 1000

# The wording of prompts; {} takes the node's name, {type} its type.
PROMPTS = {
    "discovery": ["Is there support for {}?", "Does this codebase offer {}?", "Can I find {} in this project?", "What does the project provide as {}?"],
    "explain": ["What does {} do internally?", "Explain {}.", "Why does {} exist?", "Describe the {type} {}."],
    "howto": ["How do I use {}?", "Show me how to apply {}.", "What is the way to run {}?", "Give an example of {}."],
    "diagnostics": ["What raises {}?", "How can {} be resolved?", "Why do I see {}?", "In which cases does {} arise?"],
}


def _fill(template: str) -> Column:
    parts: list[Column] = []
    for i, part in enumerate(template.replace("{type}", "\0").split("{}")):
        if i:
            parts.append(F.col("name"))
        for j, piece in enumerate(part.split("\0")):
            if j:
                parts.append(F.col("type"))
            parts.append(F.lit(piece))
    return F.concat(*parts)


def _examples(rows: DataFrame, category: str, prefix: str, answer: Column, metadata: Column) -> DataFrame:
    """Number the survivors by rank; rows has id, name, type, summary, rank."""
    kept = rows.filter(F.length(F.coalesce("summary", F.lit(""))) >= MIN_SUMMARY)
    pos = F.row_number().over(Window.orderBy("rank")) - 1  # at most the requested count of rows
    prompt = pick("id", category, [_fill(t) for t in PROMPTS[category]])
    return kept.withColumn("pos", pos).select(
        F.format_string(prefix + "_%04d", "pos").alias("id"),
        F.lit(category).alias("type"),
        prompt.alias("prompt"),
        answer.alias("response"),
        F.array("id").alias("refs"),
        F.to_json(metadata, {"ignoreNullFields": "false"}).alias("metadata"),
    )


def _ranked(rows: DataFrame, order: list[Column], count: int) -> DataFrame:
    top = rows.orderBy(*order).limit(count)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def _with_summary(rows: DataFrame, summaries: DataFrame) -> DataFrame:
    s = summaries.select("id", "summary", F.col("context.neighbors").alias("near"), F.col("context.lines").alias("lines"))
    return rows.join(s, "id", "left").withColumn("near", F.coalesce("near", F.array().cast("array<string>")))


def _near(lead: str, k: int) -> Column:
    return F.when(F.size("near") > 0, F.concat(F.lit(lead), F.array_join(F.slice("near", 1, k), ", "), F.lit(".")))


def discovery(nodes: DataFrame, summaries: DataFrame, count: int) -> DataFrame:
    rows = _ranked(nodes.filter(F.col("type") == "capability"), [F.col("id")], count)
    answer = F.concat(F.lit("Yes, '"), "name", F.lit("' does this. "), "summary")
    meta = F.struct(F.col("name").alias("node_name"), F.col("type").alias("node_type"), F.col("path").alias("file"), F.col("lang").alias("language"))
    return _examples(_with_summary(rows, summaries), "discovery", "discovery", answer, meta)


def explain(nodes: DataFrame, edges: DataFrame, summaries: DataFrame, count: int) -> DataFrame:
    top = out_degree_topk(nodes, edges, count, ["capability", "concept", "class"])
    rows = _ranked(top, [F.desc("edge_count"), F.col("id")], count)
    at = F.when(F.col("lines").isNotNull(), F.concat(F.lit("See lines "), "lines", F.lit(" of "), text_or_none("path"), F.lit(".")))
    answer = F.concat_ws(" ", "summary", _near("Its neighbours are ", 3), at)
    meta = F.struct(F.col("name").alias("node_name"), F.col("type").alias("node_type"), F.col("path").alias("file"))
    return _examples(_with_summary(rows, summaries), "explain", "explain", answer, meta)


def howto(nodes: DataFrame, summaries: DataFrame, count: int, seed: str = "howto") -> DataFrame:
    recipes = nodes.filter(F.col("type") == "recipe").orderBy("id").limit(2 * count)
    able = nodes.filter(F.col("type") == "capability").orderBy("id").limit(count)
    rows = _ranked(recipes.unionByName(able), shuffle_order("id", seed), count)
    answer = F.concat_ws(" ", "summary", F.concat(F.lit("It is kept in "), text_or_none("path"), F.lit(".")), _near("Use it together with ", 2))
    meta = F.struct(F.col("name").alias("node_name"), F.col("path").alias("file"))
    return _examples(_with_summary(rows, summaries), "howto", "howto", answer, meta)


def throwers(errors: DataFrame, nodes: DataFrame, edges: DataFrame, k: int = 3) -> DataFrame:
    """id, throwers: names of the first k nodes by id with a throws edge to the error."""
    e = edges.filter(F.col("relationship") == "throws").join(errors.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    w = Window.partitionBy("target_id").orderBy("source_id")
    top = e.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
    named = top.join(nodes.select(F.col("id").alias("source_id"), "name"), "source_id")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("r", "name"))), lambda x: x["name"])
    return named.groupBy(F.col("target_id").alias("id")).agg(listed.alias("throwers"))


def diagnostics(nodes: DataFrame, edges: DataFrame, summaries: DataFrame, count: int) -> DataFrame:
    rows = _ranked(nodes.filter(F.col("type") == "error"), [F.col("id")], count)
    rows = _with_summary(rows, summaries).join(throwers(rows, nodes, edges), "id", "left")
    raised = F.when(F.size("throwers") > 0, F.concat(F.lit("Code that raises it: "), F.array_join("throwers", ", "), F.lit(".")))
    answer = F.concat_ws(" ", "summary", raised, F.concat(F.lit("Look into "), text_or_none("path"), F.lit(".")))
    meta = F.struct(F.col("name").alias("error_name"), F.col("path").alias("file"))
    return _examples(rows, "diagnostics", "diagnostic", answer, meta)


def negatives(positives: DataFrame, nodes: DataFrame, summaries: DataFrame, k: int = 2, exclude_self: bool = False) -> DataFrame:
    """k wrong answers for each positive, each about a node of the pool of the first 1000 ids.

    The pool is numbered and drawn from by an equi-join on a hash, not a cross join.
    With exclude_self, the next node of the pool replaces a draw that hits the true one.
    """
    pool = _ranked(nodes.select("id", "name", "type", "path"), [F.col("id")], POOL)
    pool = pool.join(summaries.select("id", "summary"), "id", "left")
    n = pool.agg(F.count("*").alias("n"))
    wrong = pool.select(
        (F.col("rank") - 1).cast("bigint").alias("slot"), F.col("id").alias("w_id"), F.col("name").alias("w_name"), F.col("type").alias("w_type"), F.col("path").alias("w_path"),
        F.substring(F.coalesce("summary", F.lit("")), 1, 100).alias("w_text"),
    )
    at = F.row_number().over(Window.orderBy("id")) - 1
    each = positives.withColumn("pos", at).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))) if k > 0 else positives.withColumn("pos", at).withColumn("i", F.lit(0)).limit(0)
    each = each.withColumn("key", F.concat_ws("#", "id", F.col("i").cast("string"))).join(F.broadcast(n))  # n is one row
    each = each.withColumn("slot", hash_number("key", "negative") % F.col("n"))
    if exclude_self:
        own = each.join(wrong.select("slot", "w_id"), "slot", "left").withColumn("_hit", F.col("w_id") == F.col("refs")[0])
        each = own.withColumn("slot", F.when(F.col("_hit"), (F.col("slot") + 1) % F.col("n")).otherwise(F.col("slot"))).drop("w_id", "_hit")
    says = [
        F.concat(F.lit("That is '"), "w_name", F.lit("', a "), "w_type", F.lit(". "), "w_text"),
        F.concat(F.lit("Look at '"), "w_name", F.lit("' in "), text_or_none("w_path"), F.lit(". "), "w_text"),
        F.concat(F.lit("This concerns '"), "w_name", F.lit("'. "), "w_text"),
    ]
    tail = F.to_json(F.struct(F.lit(True).alias("is_negative"), F.col("id").alias("original_id")))
    meta = F.concat(F.expr("substring(metadata, 1, length(metadata) - 1)"), F.lit(","), F.substring(tail, 2, 1 << 20))
    number = F.col("pos") * k + F.col("i")
    return each.join(wrong, "slot").select(
        F.concat_ws("_", "id", F.lit("neg"), F.col("i").cast("string"), number.cast("string")).alias("id"),
        "type",
        "prompt",
        pick("key", "wording", says).alias("response"),
        F.array("w_id").alias("refs"),
        meta.alias("metadata"),
    )


def generate_all(nodes: DataFrame, edges: DataFrame, summaries: DataFrame, counts: dict[str, int], k: int = 2, stage: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """All categories with a positive count, and k negatives for each.

    stage may write the answers, a few rows a requested example, and read them back, as they are
    read twice: by themselves and by the wrong answers.
    """
    makers = {
        "discovery": lambda c: discovery(nodes, summaries, c),
        "explain": lambda c: explain(nodes, edges, summaries, c),
        "howto": lambda c: howto(nodes, summaries, c),
        "diagnostics": lambda c: diagnostics(nodes, edges, summaries, c),
    }
    out = None
    for category, make in makers.items():
        if counts.get(category, 0) > 0:
            part = make(counts[category])
            out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no category has a positive count")
    if k <= 0:
        return out
    out = stage(out)
    return out.unionByName(negatives(out, nodes, summaries, k))


def chosen_ids(nodes: DataFrame, edges: DataFrame, count: int) -> DataFrame:
    """id of every node that some category, with so many examples, or the pool of wrong answers takes.

    The choices read no summaries, so that only those of these few nodes need be made.
    """
    of = lambda kind, n: nodes.filter(F.col("type") == kind).select("id").orderBy("id").limit(n)
    top = out_degree_topk(nodes, edges, count, ["capability", "concept", "class"]).select("id")
    pool = nodes.select("id").orderBy("id").limit(POOL)
    return of("capability", count).unionByName(of("recipe", 2 * count)).unionByName(of("error", count)).unionByName(top).unionByName(pool).distinct()


def shuffled(examples: DataFrame, seed: str = "shuffle") -> DataFrame:
    """Examples in a seeded order."""
    return examples.orderBy(*shuffle_order("id", seed))
