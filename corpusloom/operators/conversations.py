"""Conversations: validity, targets, identities, duplicates, reply trees, generated dialogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import folded, has_email, has_phone, message_text
from corpusloom.storage import stored

ROLES = ("system", "user", "assistant")


def assembled(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """(id, messages array<struct<content, role>>) in the order of turns, contents normalised. A conversation is one row, as training needs it."""
    m = F.struct(F.col(turn_col).alias("t"), message_text(F.col("text")).alias("content"), F.col("role").alias("role"))
    return turns.groupBy(id_col).agg(F.array_sort(F.collect_list(m)).alias("m")).select(id_col, F.transform("m", lambda x: F.struct(x["content"].alias("content"), x["role"].alias("role"))).alias("messages"))


def is_valid(messages: Column) -> Column:
    """Known roles, no empty content, no role twice in a row but system, a user turn, an assistant turn at the end, two messages at least."""
    n = F.size(messages)
    known = F.forall(messages, lambda m: m["role"].isin(*ROLES) & (m["content"] != ""))
    pairs = F.arrays_zip(F.slice(messages, F.lit(1), F.greatest(n - 1, F.lit(0))).alias("a"), F.slice(messages, F.lit(2), F.greatest(n - 1, F.lit(0))).alias("b"))
    alternate = F.forall(pairs, lambda p: (p["a"]["role"] != p["b"]["role"]) | (p["b"]["role"] == "system"))
    return (n >= 2) & known & alternate & F.exists(messages, lambda m: m["role"] == "user") & (F.element_at(messages, -1)["role"] == "assistant")


def targets(messages: Column, final_only: bool = False) -> Column:
    """Positions of the assistant's messages, or of the last one."""
    every = F.filter(F.sequence(F.lit(0), F.size(messages) - 1), lambda i: F.get(messages, i)["role"] == "assistant")
    return F.array(F.array_max(every)) if final_only else every


def conversation_id(messages: Column) -> Column:
    return F.sha2(F.to_json(messages), 256)


def near_key(df: DataFrame, messages_col: str = "messages", id_col: str = "conv_id") -> DataFrame:
    """(id, near_key): a hash of roles and contents that formatting, case and marks don't change; signs of arithmetic stay."""
    rows = df.select(id_col, F.posexplode(messages_col).alias("i", "m"))
    part = F.concat(F.col("m.role"), F.regexp_replace(folded(F.col("m.content")), r"(?U)[^\w+\-*/×÷]+", ""), F.lit("\x00"))
    return rows.select(id_col, "i", part.alias("part")).groupBy(id_col).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "part"))), lambda x: x["part"]), ""), 256).alias("near_key"))


def deduplicated(df: DataFrame, key: str, order: list[str], merge_targets: bool = True) -> DataFrame:
    """The first conversation of each key; target positions of all its copies are joined if asked."""
    own = Window.partitionBy(key).orderBy(*order)
    first = df.withColumn("_place", F.row_number().over(own)).where("_place = 1").drop("_place")
    if not merge_targets:
        return first
    joined = df.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("targets")))).alias("_targets"))
    return first.join(joined, key).withColumn("targets", F.col("_targets")).drop("_targets")


def alerts(df: DataFrame, messages_col: str = "messages") -> DataFrame:
    """One row: conversations with an e-mail address or a telephone number, and of unusual length."""
    text = F.to_json(messages_col)
    one = lambda test: F.coalesce(F.sum(F.when(test, 1).otherwise(0)), F.lit(0)).alias
    return df.agg(one(has_email(text))("email"), one(has_phone(text))("phone"), one((F.length(text) > 100_000) | (F.size(messages_col) > 64))("anomalous_length"))


def _valid_reply() -> Column:
    return ~F.col("deleted").eqNullSafe(True) & ~F.col("review_result").eqNullSafe(False) & (F.col("tree_state") == "ready_for_export") & F.col("role").isin("prompter", "assistant") & (message_text(F.col("text")) != "")


def best_paths(tree: DataFrame, depth: int = 64) -> DataFrame:
    """(message_tree_id, messages): from each root the best valid child, by rank (null last) and then id, as far as there is one. A round of joins a level."""
    rows = tree.where(_valid_reply()).select("message_id", "parent_id", "message_tree_id", "role", "rank", message_text(F.col("text")).alias("content"))
    best = Window.partitionBy("parent_id").orderBy(F.col("rank").asc_nulls_last(), "message_id")
    child = stored(rows.where("parent_id IS NOT NULL").withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n"), "children")
    role = F.when(F.col("role") == "prompter", "user").otherwise("assistant")
    message = F.struct(F.col("content"), role.alias("role"))
    open_ = rows.where("parent_id IS NULL AND role = 'prompter'").select("message_tree_id", F.col("message_id").alias("at"), F.array(message).alias("messages"))
    done = None
    for _ in range(depth):
        open_ = stored(open_, "paths")
        step = open_.join(child.select(F.col("parent_id").alias("at"), F.col("message_id").alias("next"), message.alias("m")), "at", "left")
        ended = step.where("next IS NULL").select("message_tree_id", "messages")
        done = ended if done is None else done.unionByName(ended)
        open_ = step.where("next IS NOT NULL").select("message_tree_id", F.col("next").alias("at"), F.concat("messages", F.array("m")).alias("messages"))
        if open_.isEmpty():
            break
    return done


def reply_paths(tree: DataFrame, depth: int = 64) -> DataFrame:
    """(message_id, messages): every valid assistant message with all that came before it; paths through an invalid or repeated message, or that no prompter began, are left out."""
    rows = stored(tree.select("message_id", "parent_id", "role", message_text(F.col("text")).alias("content"), _valid_reply().alias("valid")), "tree")
    role = F.when(F.col("role") == "prompter", "user").otherwise("assistant")
    message = F.struct(F.col("content"), role.alias("role"))
    open_ = rows.where("valid AND role = 'assistant'").select("message_id", F.col("parent_id").alias("up"), F.array(message).alias("messages"), F.array("message_id").alias("seen"), F.col("role").alias("top"))
    done = None
    above = rows.select(F.col("message_id").alias("up"), F.col("parent_id").alias("next"), message.alias("m"), F.col("valid"), F.col("role").alias("above_role"))
    for _ in range(depth):
        open_ = stored(open_, "ancestry")
        step = open_.join(above, "up", "left")
        ended = step.where("valid IS NULL AND top = 'prompter'").select("message_id", "messages")
        done = ended if done is None else done.unionByName(ended)
        open_ = step.where(F.col("valid") & ~F.array_contains("seen", F.col("up"))).select("message_id", F.col("next").alias("up"), F.concat(F.array("m"), "messages").alias("messages"), F.concat("seen", F.array("up")).alias("seen"), F.col("above_role").alias("top"))
        if open_.isEmpty():
            break
    return done


def arithmetic(spark: SparkSession, low: int, high: int, templates: list[str], seed: str = "arithmetic") -> DataFrame:
    """(question, answer): sums, differences and products of all pairs in a range, worded by a template that a hash picks."""
    n = high - low + 1
    grid = spark.range(n * n).select((F.floor(F.col("id") / n) + low).cast("int").alias("a"), (F.col("id") % n + low).cast("int").alias("b"))
    ops = F.array(*(F.struct(F.lit(s).alias("sign"), v.alias("value")) for s, v in (("+", F.col("a") + F.col("b")), ("-", F.col("a") - F.col("b")), ("*", F.col("a") * F.col("b")))))
    rows = grid.select("a", "b", F.explode(ops).alias("o")).withColumn("expression", F.concat_ws(" ", "a", "o.sign", "b"))
    turn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), "expression"), 256), 1, 2), 16, 10).cast("int") % len(templates)
    return rows.select(F.replace(F.element_at(F.array(*map(F.lit, templates)), turn + 1), F.lit("{}"), F.col("expression")).alias("question"), F.col("o.value").cast("string").alias("answer"))
