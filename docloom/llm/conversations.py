"""Ordered conversations from message rows.

Every message gets a pointer to its parent: the given one, or the message before it in its session. Roots and positions
come from pointer jumping: in each round every open row takes over its pointer's pointer, so the rounds grow with the
logarithm of the longest conversation. Rows whose pointer names no row are orphans; rows still open when the rounds
exceed the logarithm of the row count lie on, or behind, a cycle. Given pointers can branch; ``paths`` then gives each
path from a root to a leaf as a conversation.

Every row jumps, whether its pointer was given or comes from the order. No step holds a session in one task: to find the
rows before, a session is read in blocks of the order column, and from there on rows meet by their ids alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, strip_blanks

# Usual words for the two speakers and for system rows.
USER_ROLES = ("user", "human", "customer", "client", "prompter", "visitor", "me", "usr", "end_user", "end-user")
ASSISTANT_ROLES = ("assistant", "ai", "bot", "model", "chatbot", "gpt", "agent", "asst", "ai_assistant")
SYSTEM_ROLES = ("system", "sys", "developer")

BLOCK = 1_000_000
#: Open rows that are sent to all tasks rather than shuffled.
FEW = 20_000


def speaker(role: Column | str) -> Column:
    """``user``, ``assistant``, ``system`` or ``other`` (foreign, blank or null) for a role as written."""
    r = F.lower(strip_blanks(role))
    return (
        F.when(r.isin(*USER_ROLES), "user").when(r.isin(*ASSISTANT_ROLES), "assistant").when(r.isin(*SYSTEM_ROLES), "system").otherwise("other")
    )


def with_previous(df: DataFrame, key: str, order: str, values: dict[str, Column], block: int = BLOCK) -> DataFrame:
    """``df`` with ``prev_<name>`` for each of ``values``: its value in the row before, by ``order``, of the same ``key``.

    ``prev_<name>`` is null in a key's first row. ``order`` must be a unique whole number within ``key``. A key is
    looked at in blocks of ``block`` order values; one small row for each block joins them.
    """
    df = df.withColumn("_block", F.floor(F.col(order) / block)).withColumn("_vals", F.struct(*[v.alias(n) for n, v in values.items()]))
    within = Window.partitionBy(key, "_block").orderBy(order)
    along = Window.partitionBy(key).orderBy("_block")
    blocks = df.groupBy(key, "_block").agg(F.max_by("_vals", order).alias("_last")).select(key, "_block", F.lag("_last").over(along).alias("_before"))
    seen = df.withColumn("_prev", F.lag("_vals").over(within)).withColumn("_place", F.row_number().over(within))
    out = seen.join(blocks, [key, "_block"]).withColumn("_prev", F.when(F.col("_place") == 1, F.col("_before")).otherwise(F.col("_prev")))
    return out.withColumns({f"prev_{n}": F.col(f"_prev.{n}") for n in values}).drop("_block", "_vals", "_prev", "_place", "_before")


def resolve(links: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """Root and distance of every row of ``links(id, parent)``.

    Result: ``id, root, depth, state``. A row without parent is a root at depth 0. ``state`` is ``ok``, ``orphan`` (the
    chain ends in a parent that is no row; root is the last row found) or ``cycle`` (root and depth are null).
    ``id`` must be unique; a null id is left out. Empty input gives no rows.
    """
    links = links.where(F.col("id").isNotNull())
    ids = links.select(F.col("id").alias("_known"))
    # rows without parent take no part in the join, so that they do not meet under one empty key
    some, none = links.where(F.col("parent").isNotNull()), links.where(F.col("parent").isNull())
    start = some.join(ids, some.parent == F.col("_known"), "left").unionByName(none.withColumn("_known", F.lit(None).cast(dict(ids.dtypes)["_known"]))).select(
        "id",
        F.when(F.col("_known").isNull(), F.col("id")).otherwise(F.col("parent")).alias("ptr"),
        F.col("_known").isNotNull().cast("long").alias("depth"),
        F.col("_known").isNull().alias("done"),
        (F.col("parent").isNotNull() & F.col("_known").isNull()).alias("orphan"),
    )
    state = cut(start)
    total, still = state.agg(F.count("*"), F.count_if(~F.col("done"))).first()
    most_rounds = most_rounds or math.ceil(math.log2(max(total, 2))) + 1
    settled = None
    for _ in range(most_rounds):
        if not still:
            break
        # only open rows are joined and written again; the side that they meet has each id once
        opened, rest = state.where(~F.col("done")), state.where("done")
        known = state if settled is None else settled.unionByName(state)
        p = known.select(*[F.col(c).alias(f"p_{c}") for c in ("id", "ptr", "depth", "done", "orphan")])
        few = still <= FEW
        jumped = (F.broadcast(opened) if few else opened).join(p, F.col("ptr") == F.col("p_id")).select(
            "id", F.col("p_ptr").alias("ptr"), (F.col("depth") + F.col("p_depth")).alias("depth"), F.col("p_done").alias("done"), F.col("p_orphan").alias("orphan")
        )
        settled = rest if settled is None else settled.unionByName(rest)
        state = cut(jumped.repartition(1) if few else jumped)
        still = state.where(~F.col("done")).count()
    return (state if settled is None else settled.unionByName(state)).select(
        "id",
        F.when(F.col("done"), F.col("ptr")).alias("root"),
        F.when(F.col("done"), F.col("depth")).alias("depth"),
        F.when(~F.col("done"), "cycle").when(F.col("orphan"), "orphan").otherwise("ok").alias("state"),
    )


def paths(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Each path from a root to a leaf of ``links(id, parent)`` as a conversation: ``leaf, root, turn, id``.

    ``turn`` is 0 for the root. Rows on or behind a cycle, or whose chain ends in a parent that is no row, are left out
    with all below them. In round k every row of a path so far also gives its ancestor 2^k steps up, found by pointer
    jumping. A message stands in the path of every leaf below it. ``known``: what ``resolve`` gave for these rows, if it
    has run.
    """
    known = resolve(links) if known is None else known
    good = cut(links.where(F.col("id").isNotNull()).select("id", "parent").join(known.where("state = 'ok'"), "id"))
    leaves = good.join(good.where("parent is not null").select(F.col("parent").alias("id")).distinct(), "id", "left_anti")
    found = cut(leaves.select(F.col("id").alias("leaf"), "root", "id", "depth"))
    jump = good.where("parent is not null").select("id", F.col("parent").alias("up"))
    longest = good.agg(F.max("depth")).first()[0] or 0
    for k in range(int(longest).bit_length()):
        higher = found.join(jump, "id").select("leaf", "root", F.col("up").alias("id"), (F.col("depth") - (1 << k)).alias("depth"))
        found = cut(found.unionByName(higher))
        jump = cut(jump.join(jump.select(F.col("id").alias("up"), F.col("up").alias("_next")), "up").select("id", F.col("_next").alias("up")))
    return found.select("leaf", "root", F.col("depth").alias("turn"), "id")


def rebuild(messages: DataFrame, parent: str | None = None, block: int = BLOCK, with_content: bool = True) -> DataFrame:
    """Messages as nodes of conversations.

    ``messages`` needs ``id, session_id, role, content``; other columns are ignored. Result, one row for each user,
    assistant or foreign row that counts: ``session_id`` (lower case, trimmed), ``id``, ``speaker``, ``content``,
    ``has_text``, ``parent`` and its ``parent_speaker``, ``root``, ``depth`` (0-based position on the root-to-leaf
    path), ``state``. Foreign rows hang on nothing and have depth null.

    A row without id or session takes no part; an id counts once; system rows are skipped; a row with the speaker and
    content of the row just before it is a repeated send and is dropped (two null contents are the same).
    With ``parent`` (a column of ids) the given tree is followed instead of the order in the session.
    ``with_content=False`` leaves the texts out (null).
    """
    rows = (
        messages.select(
            F.col("id").cast("long").alias("id"),
            F.lower(strip_blanks("session_id")).alias("session_id"),
            speaker("role").alias("speaker"),
            F.struct(F.xxhash64("content").alias("h"), F.length("content").alias("n")).alias("mark"),
            F.coalesce(strip_blanks("content") != "", F.lit(False)).alias("has_text"),
            *([F.col(parent).cast("long").alias("_given")] if parent else []),
        )
        .where(F.col("id").isNotNull() & F.col("session_id").isNotNull())
        .dropDuplicates(["id"])
        .where(F.col("speaker") != "system")
    )
    mark = F.struct("speaker", "mark.h", "mark.n")
    sent = with_previous(rows, "session_id", "id", {"mark": mark}, block)
    kept = sent.where(F.col("prev_mark").isNull() | ~F.col("prev_mark").eqNullSafe(mark)).drop("prev_mark", "mark")
    foreign = kept.where(F.col("speaker") == "other")
    said = kept.where(F.col("speaker") != "other")
    if parent:
        of = said.select(F.col("id").alias("_given"), F.col("speaker").alias("parent_speaker"))
        said, foreign = said.join(of, "_given", "left").withColumn("parent", F.col("_given")).drop("_given"), foreign.drop("_given")
    else:
        said = with_previous(said, "session_id", "id", {"id": F.col("id"), "speaker": F.col("speaker")}, block)
        said = said.withColumnsRenamed({"prev_id": "parent", "prev_speaker": "parent_speaker"})
    said = cut(said)
    said = said.join(resolve(said.select("id", "parent")), "id")
    out = said.unionByName(foreign, allowMissingColumns=True)
    if with_content:  # texts join at the end, so that no round and no window carries them
        out = out.join(messages.where("id is not null").select(F.col("id").cast("long").alias("id"), "content").dropDuplicates(["id"]), "id", "left")
    else:
        out = out.withColumn("content", F.lit(None).cast("string"))
    return out.select("session_id", "id", "speaker", "content", "has_text", "parent", "parent_speaker", "root", "depth", "state")


def defects(nodes: DataFrame, sessions: DataFrame) -> DataFrame:
    """``session_id, defect`` of the conversations to leave out, over the sessions of either input.

    ``empty`` stands alone; ``missing_reply`` and ``broken`` can both hold. A session without rows is empty.
    """
    known = sessions.select(F.lower(strip_blanks("id")).alias("session_id")).where("session_id is not null").distinct().withColumn("known", F.lit(1))
    user, said = F.col("speaker") == "user", F.col("speaker") != "other"
    of = nodes.groupBy("session_id").agg(
        F.count_if(said & F.col("has_text")).alias("texts"),
        F.count_if(user).alias("asked"),
        F.count_distinct(F.when((F.col("speaker") == "assistant") & F.col("has_text") & (F.col("parent_speaker") == "user"), F.col("parent"))).alias("answered"),
        F.count_if(
            ~said | ((F.col("speaker") == "assistant") & ((F.col("depth") == 0) | (F.col("parent_speaker") == "assistant"))) | (F.col("state") != "ok")
        ).alias("breaks"),
    )
    both = of.join(known, "session_id", "full_outer")
    found = F.when(F.coalesce("texts", F.lit(0)) == 0, F.array(F.lit("empty"))).otherwise(
        F.array_compact(
            F.array(
                F.when(F.col("asked") > F.col("answered"), "missing_reply"),
                F.when((F.col("breaks") > 0) | F.col("known").isNull(), "broken"),
            )
        )
    )
    return both.select("session_id", F.explode(found).alias("defect"))


def found(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """``session_id, defect`` of the conversations to leave out."""
    return defects(rebuild(messages, with_content=False), sessions)


def conversations(messages: DataFrame, sessions: DataFrame, parent: str | None = None) -> DataFrame:
    """Whole conversations, one row for each message: ``session_id, root, turn, speaker, content, turns``.

    A conversation is a path from a root to a leaf; where given parents branch, a message stands in each path that it
    is part of. Sessions with a defect are left out.
    """
    nodes = cut(rebuild(messages, parent))
    good = cut(nodes.join(defects(nodes, sessions).select("session_id").distinct(), "session_id", "left_anti"))
    along = paths(good.select("id", "parent"), good.select("id", "root", "depth", "state"))
    sizes = along.groupBy("leaf").agg((F.max("turn") + 1).alias("turns"))
    return along.join(sizes, "leaf").join(good.select("id", "session_id", "speaker", "content"), "id").select("session_id", "root", "turn", "speaker", "content", "turns")
