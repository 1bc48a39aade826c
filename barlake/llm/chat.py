"""Reply trees as conversations, with built-in functions only.

Messages point to the message they answer.  Self-joins that double the jump
length enumerate the path from every leaf up to its root, branches are ranked by
score within their tree, and each chosen path becomes one formatted conversation.

The template of a turn is ``<|turn|>role<|text|>text</s>``.  In roles and texts a
backslash is put after every ``<`` and ``[``, so no control string of this or of
bracket templates can occur inside them; taking one backslash off after each such
character gives the text back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, materialize

TURN, TEXT, END = "<|turn|>", "<|text|>", "</s>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<"), F.lit("<\\")), F.lit("["), F.lit("[\\"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\"), F.lit("<")), F.lit("[\\"), F.lit("["))


def chain_tree(conversations: DataFrame) -> DataFrame:
    """Conversations by turn as reply trees: each row answers the row before it.

    Rows without a conversation id form one conversation of their own.  Rows of
    one turn are put in order by role and text, so repeats stay and the result
    is the same at every run.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    w = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = conversations.select(F.col("conv_id").alias("tree"), "turn", role.alias("role"), text.alias("text"))
    rows = rows.withColumn("node", F.row_number().over(w).cast("long"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def leaf_paths(tree: DataFrame) -> DataFrame:
    """``(tree, leaf, node, up)``: each node of the path above each leaf, ``up`` steps away.

    ``tree(tree, node, parent)``.  A parent that is no node counts as none.  After
    round r every path is known for 2**r steps, so the rounds grow with the
    logarithm of the depth.  A node without an id is left out.  Nodes on a cycle
    have no leaf, and a leaf whose way up ends in a cycle has no root: neither gives
    a path.  Nodes must not be repeated.
    """
    nodes = tree.select(F.col("tree"), F.col("node"), F.col("parent"))
    known = nodes.select(F.col("tree").alias("_t"), F.col("node").alias("_n")).distinct()
    jump = nodes.join(known, nodes["tree"].eqNullSafe(known["_t"]) & (nodes["parent"] == known["_n"]))
    jump = jump.select("tree", "node", F.col("parent").alias("to"))
    jump = materialize(jump, "jumps")
    parents = jump.select(F.col("tree").alias("_t"), F.col("to").alias("_n")).distinct()
    paths = nodes.join(parents, nodes["tree"].eqNullSafe(parents["_t"]) & (nodes["node"] == parents["_n"]), "left_anti")
    paths = paths.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up"))
    step, longest = 1, None
    while not jump.isEmpty():
        if step > 64:
            longest = longest or nodes.groupBy("tree").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
            if step > longest:  # what still goes up goes round
                lost = jump.select(F.col("tree").alias("_t"), F.col("node").alias("_n"))
                return paths.join(lost, paths["tree"].eqNullSafe(lost["_t"]) & (paths["leaf"] == lost["_n"]), "left_anti")
        j = jump.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), "to")
        far = paths.join(j, paths["tree"].eqNullSafe(j["_t"]) & (paths["node"] == j["_n"]))
        before = [jump, *([paths] if step > 1 else [])]
        paths = materialize(
            paths.union(far.select("tree", "leaf", F.col("to").alias("node"), (F.col("up") + step).alias("up"))), "paths"
        )
        k = jump.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("to").alias("_to"))
        jump = jump.join(k, jump["tree"].eqNullSafe(k["_t"]) & (jump["to"] == k["_n"]))
        jump = materialize(jump.select("tree", "node", F.col("_to").alias("to")), "jumps")
        forget(*before)
        step *= 2
    return paths


def format_branches(tree: DataFrame, branches: int = 1, learn_role: str = "assistant") -> DataFrame:
    """One row per chosen branch: tree, leaf, rank, formatted, loss_spans.

    ``tree(tree, node, parent, role, text, score)``.  A branch's score is the mean
    of its messages' scores (null: 0); ties go to the longer branch, then to the
    smaller leaf.  The best ``branches`` of each tree are kept.  ``loss_spans`` are
    (start, length) code-point ranges of ``formatted`` that hold the escaped texts
    of ``learn_role``.  Of rows that repeat a node the least by (parent, role, text,
    score) counts, nulls first.  Other columns are left out; no row gives no row.
    """
    one = tree.groupBy("tree", "node").agg(F.min(F.struct("parent", "role", "text", "score")).alias("r"))
    tree = one.select("tree", "node", "r.*")
    paths = leaf_paths(tree)
    body = tree.select(
        F.col("tree").alias("_t"),
        F.col("node").alias("_n"),
        F.concat(F.lit(TURN), escape(F.coalesce("role", F.lit(""))), F.lit(TEXT)).alias("head"),
        escape(F.coalesce("text", F.lit(""))).alias("body"),
        F.coalesce(F.col("role") == learn_role, F.lit(False)).alias("learn"),
        F.coalesce(F.col("score"), F.lit(0.0)).alias("score"),
    )
    # the turns travel once; branch ranks are worked out on ids and scores alone
    on = paths["tree"].eqNullSafe(body["_t"]) & (paths["node"] == body["_n"])
    scored = paths.join(body.select("_t", "_n", "score"), on).groupBy("tree", "leaf").agg(F.avg("score").alias("mean"), F.count("*").alias("n"))
    best = Window.partitionBy("tree").orderBy(F.desc("mean"), F.desc("n"), "leaf")
    chosen = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= branches)
    chosen = chosen.select(F.col("tree").alias("_ct"), F.col("leaf").alias("_cl"), "rank")
    turns = paths.join(chosen, paths["tree"].eqNullSafe(F.col("_ct")) & (paths["leaf"] == F.col("_cl")))
    turns = turns.select("tree", "leaf", "rank", "node", "up")
    turns = turns.join(body, turns["tree"].eqNullSafe(body["_t"]) & (turns["node"] == body["_n"]))
    head, size = F.length("head"), F.length("head") + F.length("body") + len(END)
    along = Window.partitionBy("tree", "leaf", "rank").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("at", F.coalesce(F.sum(size).over(along), F.lit(0)))
    span = F.when(F.col("learn"), F.struct((F.col("at") + head).alias("start"), F.length("body").cast("long").alias("length")))
    return (
        turns.withColumn("turn", F.struct((-F.col("up")).alias("k"), F.concat("head", "body", F.lit(END)).alias("s"), span.alias("span")))
        .groupBy("tree", "leaf", "rank")
        .agg(F.sort_array(F.collect_list("turn")).alias("turns"))
        .select(
            "tree",
            "leaf",
            "rank",
            F.array_join(F.col("turns.s"), "").alias("formatted"),
            F.filter(F.col("turns.span"), lambda x: x.isNotNull()).alias("loss_spans"),
        )
    )


def read_turns(formatted: Column) -> Column:
    """The (role, text) pairs of a formatted conversation."""
    pieces = F.filter(F.split(formatted, r"<\|turn\|>", -1), lambda x: x != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.element_at(F.split(p, r"<\|text\|>", 2), 1)).alias("role"),
            unescape(F.regexp_replace(F.element_at(F.split(p, r"<\|text\|>", 2), 2), "</s>$", "")).alias("text"),
        ),
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(
        F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, s["length"].cast("int")))), ""
    )
