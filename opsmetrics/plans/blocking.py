"""Blocking graphs: heads, chains, counts and trees.

A session names at most one session that blocks it, so chains are followed by pointer
doubling: after round i every session points 2^i steps up. A chain of depth d takes
log2(d) rounds, whatever the number of sessions, and each round writes its rows once.
``keys`` separates captures; sessions of different captures never meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.scalars import format_duration, int_avg, int_div, like, one_line, pad_left, rules, slice_statement
from ..operators.ranking import top_k_per_group
from ..operators.windows import BLOCK, as_list, range_blocks, running
from ..session import materialise


def is_blocked(blk: str = "blk") -> Column:
    return F.coalesce(F.col(blk), F.lit(0)) != 0


# --- heads -----------------------------------------------------------------

def head_blockers(requests: DataFrame, keys=None) -> DataFrame:
    """Ids that block someone and are not blocked, with or without a row of their own."""
    keys = as_list(keys)
    blocked = requests.where(is_blocked())
    ids = blocked.select(*keys, F.col("blk").alias("sid")).distinct()
    return ids.join(blocked.select(*keys, "sid"), keys + ["sid"], "left_anti")


def head_blocker_rows(requests: DataFrame, keys=None) -> DataFrame:
    """Requests that block someone and are not blocked."""
    keys = as_list(keys)
    blockers = requests.where(is_blocked()).select(*keys, F.col("blk").alias("sid")).distinct()
    return requests.where(~is_blocked()).join(blockers, keys + ["sid"], "left_semi")


def head_blocker_report(sessions: DataFrame, connections: DataFrame, requests: DataFrame, tasks: DataFrame,
                        waits: DataFrame, texts: DataFrame) -> DataFrame:
    """Sessions that head a chain or are blocked, with their longest wait and their text.

    The flag is 1 for a session that blocks others and is idle or not blocked itself.
    """
    longest = top_k_per_group(waits, "task_address", [F.desc("wait_duration_ms"), "blocking_session_id"], 1)
    longest = longest.select("task_address", F.col("blocking_session_id").alias("blocked_by"), "wait_type", "wait_duration_ms")
    r = requests.select("session_id", F.col("blk").alias("request_blk"), "request_id", "command", "sql_handle")
    blocking = requests.where(is_blocked()).select(F.col("blk").alias("session_id")).distinct().withColumn("blocks", F.lit(True))
    handle = F.coalesce("sql_handle", "most_recent_sql_handle")
    rows = (sessions.where("is_user_process").join(connections, "session_id", "left").join(r, "session_id", "left")
            .join(tasks, ["session_id", "request_id"], "left").join(longest, "task_address", "left")
            .join(blocking, "session_id", "left"))
    blocks = F.coalesce("blocks", F.lit(False))
    head = blocks & (F.col("request_blk").isNull() | (F.col("request_blk") == 0))
    stuck = F.coalesce(F.col("request_blk") > 0, F.lit(False))
    return (rows.where(head | stuck).withColumn("head_blocker", F.when(head, "1").otherwise(""))
            .withColumn("sql_handle", handle).join(texts, "sql_handle", "left")
            .select("head_blocker", "session_id", "login_name", "status", "blocked_by", "wait_type", "wait_duration_ms",
                    "command", "text"))


# --- chains ----------------------------------------------------------------

def chains(edges: DataFrame, keys=None, cut: Column | None = None, with_path: bool = False) -> DataFrame:
    """Head and distance of every session whose chain ends at a session that is not blocked.

    ``edges`` has sid and blk. A session that blocks itself is blocked without a head.
    ``cut`` is a condition on a blocker's row; chains are not followed below such rows.
    Chains that run into a cycle or out of the table have no head and are left out.
    Returns keys, sid, head, level and, if asked, the path of ids from the head down.
    """
    keys = as_list(keys)
    lost = F.coalesce(F.col("blk") == F.col("sid"), F.lit(False))
    if cut is not None:
        stops = edges.where(cut).select(*keys, F.col("sid").alias("blk")).distinct().withColumn("_stop", F.lit(True))
        edges = edges.join(stops, keys + ["blk"], "left")
        lost = lost | F.col("_stop").isNotNull()
    free = ~is_blocked()
    extra = {"path": F.array("sid")} if with_path else {}
    state = materialise(edges.select(*keys, "sid", F.when(~free & ~lost, F.col("blk")).alias("up"),
                                     F.when(free, 0).otherwise(1).cast("bigint").alias("level"),
                                     F.when(free, F.col("sid")).alias("head"), *[c.alias(n) for n, c in extra.items()]))
    closed_before = -1
    while True:
        closed, still_open = state.agg(F.count_if(F.col("up").isNull()), F.count("up")).first()
        if closed == closed_before or not still_open:
            break
        closed_before = closed
        state = materialise(_jump(state, keys, with_path))
    return state.where("up is null and head is not null").drop("up")


def _jump(state: DataFrame, keys: list, with_path: bool) -> DataFrame:
    """Replace each pointer by the pointer of the session it names."""
    path = ["path"] if with_path else []
    over = state.select(*keys, F.col("sid").alias("up"), *[F.col(c).alias(f"_{c}") for c in ["up", "level", "head"] + path])
    moved = state.where("up is not null").join(over, keys + ["up"], "inner")
    moved = moved.select(*keys, "sid", F.col("_up").alias("up"), (F.col("level") + F.col("_level")).alias("level"),
                         F.col("_head").alias("head"), *[F.concat("_path", "path").alias("path") for _ in path])
    return state.where("up is null").unionByName(moved)


def blocking_hierarchy(edges: DataFrame, keys=None, payload=()) -> DataFrame:
    """Every session of every chain: head, level, own wait, and columns carried from the head."""
    keys = as_list(keys)
    cut = F.col("wait_type").isin(*V.PARALLEL_WAITS) if "wait_type" in edges.columns else None
    found = chains(edges, keys, cut)
    heads = edges.where(is_blocked()).select(*keys, F.col("blk").alias("head")).distinct()
    found = found.join(heads, keys + ["head"], "left_semi")
    rows = found.join(edges, keys + ["sid"], "inner")
    if payload:
        top = edges.select(*keys, F.col("sid").alias("head"), *[F.col(c).alias(f"head_{c}") for c in payload])
        rows = rows.join(top, keys + ["head"], "left")
    return rows


def wait_class(wait_type="wait_type", resource: str | None = None) -> Column:
    """Kind of wait that holds up a chain."""
    steps = []
    if resource:
        steps.append((like(wait_type, "LCK%") & F.contains(F.col(resource), F.lit("[COMPILE]")),
                      F.concat(F.lit("COMPILE ("), F.coalesce(resource, F.lit("")), F.lit(")"))))
    steps += [(like(wait_type, "LCK%"), "LOCK BLOCKING"), (like(wait_type, "PAGELATCH%"), "PAGELATCH_* WAITS"),
              (like(wait_type, "PAGEIOLATCH%"), "PAGEIOLATCH_* WAITS")]
    return F.left(rules(steps, F.col(wait_type)), F.lit(40))


def _procedure_name() -> Column:
    """The start of a procedure's definition, from its CREATE on; empty for other batches."""
    at = F.instr(F.left("text", F.lit(512)), "CREATE ")
    name = F.when(at > 0, F.substr("text", at, F.lit(50))).otherwise(F.left("text", F.lit(49)))
    return F.coalesce(F.when(F.col("object_id").isNotNull(), _spaced(name)), F.lit(""))


def _running_statement() -> Column:
    """The statement between the offsets, 1000 characters at most. No start is the beginning; no end is byte 8192."""
    start = int_div(F.coalesce("statement_start_offset", F.lit(0)), 2)
    end = F.coalesce("statement_end_offset", F.lit(8192))
    length = F.when(end <= 0, F.lit(8193)).otherwise(int_div(end, 2) - start + 1)
    return F.coalesce(F.left(_spaced(F.substr("text", (start + 1).cast("int"), length.cast("int"))), F.lit(1000)), F.lit(""))


def _spaced(text: Column) -> Column:
    return F.translate(text, "\r\n", "  ")


def head_blocker_summary(edges: DataFrame, keys=None, resource: str | None = None, heads: DataFrame | None = None) -> DataFrame:
    """Per head and kind of wait: sessions held up, their wait times and the depth of the chain.

    With ``heads`` (sid, object_id, text, offsets and plan_handle of sessions) also what the head runs.
    """
    keys = as_list(keys)
    rows = blocking_hierarchy(edges, keys).where("level > 0")
    ms = F.coalesce("wait_ms", F.lit(0))
    summary = (rows.groupBy(*keys, F.col("head").alias("head_blocker_session_id"),
                            wait_class("wait_type", resource).alias("blocking_resource_wait_type"))
               .agg(F.count(F.lit(1)).alias("blocked_task_count"), F.sum(ms).alias("tot_wait_duration_ms"),
                    int_avg(ms).alias("avg_wait_duration_ms"), F.max("wait_ms").alias("max_wait_duration_ms"),
                    F.max("level").alias("max_blocking_chain_depth")))
    if heads is None:
        return summary
    runs = heads.select(*keys, F.col("sid").alias("head_blocker_session_id"), _procedure_name().alias("head_blocker_proc_name"),
                        F.coalesce("object_id", F.lit(0)).alias("head_blocker_proc_objid"), _running_statement().alias("stmt_text"),
                        F.col("plan_handle").alias("head_blocker_plan_handle"))
    return summary.join(runs, [*keys, "head_blocker_session_id"], "left").fillna(
        {"head_blocker_proc_name": "", "head_blocker_proc_objid": 0, "stmt_text": ""})


# --- counts ----------------------------------------------------------------

def blocked_counts(edges: DataFrame, keys=None) -> DataFrame:
    """Sessions held up by each session, directly or through others.

    A session that blocks itself counts as free. Sessions in a cycle hold up each other
    and all that hangs below any of them.
    """
    keys = as_list(keys)
    known = edges.select(*keys, F.col("sid").alias("blk")).distinct()
    blocked = is_blocked() & (F.col("blk") != F.col("sid"))
    links = (edges.where(blocked).join(known, keys + ["blk"], "left_semi")
             .select(*keys, "sid", F.col("blk").alias("up")))
    nodes = materialise(edges.select(*keys, "sid").distinct().join(links, keys + ["sid"], "left"))
    sizes, rest = _subtree_sizes(nodes, keys)
    if rest is None:
        return sizes.select(*keys, "sid", (F.col("size") - 1).alias("blocked_session_count"))
    rings = _rings(rest, nodes, keys)
    cut = nodes.join(rings, keys + ["sid"], "left").withColumn("up", F.when(F.col("ring").isNull(), F.col("up")))
    sizes, _ = _subtree_sizes(materialise(cut.select(*keys, "sid", "up")), keys)
    sizes = sizes.join(rings, keys + ["sid"], "left")
    whole = sizes.where("ring is not null").groupBy(*keys, "ring").agg(F.sum("size").alias("ring_size"))
    total = F.coalesce("ring_size", "size")
    return (sizes.join(whole, keys + ["ring"], "left")
            .select(*keys, "sid", (total - 1).alias("blocked_session_count")))


def _subtree_sizes(nodes: DataFrame, keys: list) -> tuple[DataFrame, DataFrame | None]:
    """(sid, size) by doubling; also the links still open when a cycle keeps them so."""
    state = nodes.withColumn("size", F.lit(1).cast("bigint"))
    open_before = -1
    while True:
        open_now = state.where("up is not null").count()
        if open_now == 0:
            return state.drop("up"), None
        if open_now == open_before:
            return state.drop("up"), state.where("up is not null").select(*keys, "sid", "up")
        open_before = open_now
        gain = (state.where("up is not null").groupBy(*keys, F.col("up").alias("sid"))
                .agg(F.sum("size").alias("_gain")))
        over = state.select(*keys, F.col("sid").alias("up"), F.col("up").alias("_up"))
        state = materialise(state.join(gain, keys + ["sid"], "left").join(over, keys + ["up"], "left")
                            .select(*keys, "sid", F.col("_up").alias("up"),
                                    (F.col("size") + F.coalesce("_gain", F.lit(0))).alias("size")))


def _rings(links: DataFrame, nodes: DataFrame, keys: list) -> DataFrame:
    """Sessions on cycles, labelled by the smallest id of their cycle.

    ``links`` point some fixed number of steps up and never end. Doubled until the set of
    sessions pointed at stops shrinking, they point at cycle members only. The labels then
    travel along the single steps of ``nodes``, doubled in turn.
    """
    state, before = links, -1
    while True:
        targets = state.select(*keys, F.col("up").alias("sid")).distinct()
        now = targets.count()
        if now == before:
            break
        before = now
        over = state.select(*keys, F.col("sid").alias("up"), F.col("up").alias("_up"))
        state = materialise(state.join(over, keys + ["up"], "inner").select(*keys, "sid", F.col("_up").alias("up")))
    ring = materialise(nodes.join(targets, keys + ["sid"], "left_semi").withColumn("ring", F.least("sid", "up")))
    while True:
        over = ring.select(*keys, F.col("sid").alias("up"), F.col("up").alias("_up"), F.col("ring").alias("_ring"))
        after = materialise(ring.join(over, keys + ["up"], "inner")
                            .select(*keys, "sid", F.col("_up").alias("up"), F.least("ring", "_ring").alias("ring"),
                                    (F.col("_ring") < F.col("ring")).alias("moved")))
        ring = after.drop("moved")
        if after.where("moved").isEmpty():
            return ring.select(*keys, "sid", "ring")


# --- trees and pairs -------------------------------------------------------

def blocking_tree(history: DataFrame, runtime: str = "runtime", text: str = "batch_text", banner: str = "",
                  width: int = 10) -> DataFrame:
    """Printed trees per capture: one line per session below each session that blocks another.

    A blocker that is itself blocked prints its own tree too, so a session shows up once
    for each blocker above it. Sort by capture and ``sort_path``.
    """
    found = chains(history, runtime, with_path=True)
    loop = F.coalesce(F.col("blk") == F.col("sid"), F.lit(False))
    anchors = (history.where(is_blocked() & ~loop).select(runtime, F.col("blk").alias("anchor")).distinct())
    starts = F.sequence(F.lit(1), F.size("path"))
    lines = (found.withColumn("_from", F.explode(starts))
             .withColumn("anchor", F.element_at("path", F.col("_from").cast("int")))
             .join(anchors, [runtime, "anchor"], "left_semi")
             .withColumn("depth", (F.size("path") - F.col("_from")).cast("bigint"))
             .join(history.select(runtime, "sid", "blk", text), [runtime, "sid"], "inner"))
    ids = F.slice("path", F.col("_from").cast("int"), F.size("path"))
    branch = F.concat(F.repeat(F.lit("|   "), F.greatest(F.col("depth") - 1, F.lit(0)).cast("int")),
                      F.when(F.col("depth") > 0, "|-- ").otherwise(""))
    line = F.concat(F.when(F.col("depth") == 0, banner).otherwise(""), F.col(runtime).cast("string"), F.lit(" " * 17),
                    branch, F.col("sid").cast("string"), F.lit(" "), F.coalesce(one_line(text, " "), F.lit("")))
    sort_path = F.array_join(F.transform(ids, lambda i: pad_left(i, width)), "")
    return lines.select(runtime, "anchor", "sid", "depth", sort_path.alias("sort_path"), line.alias("blocking_tree"))


def tree_numbers(edges: DataFrame, keys=None) -> DataFrame:
    """Place of every session in the printed order of the trees: keys, sid, depth, number (from 1) and size of its subtree.

    Sort by ``number`` and indent by ``depth`` to print; what hangs below a session has the ``size - 1`` numbers behind its own. So
    a subtree is an interval, and no row holds a path. A session's place among its siblings is a running sum
    of their subtree sizes, cut into ranges, and the places add up along the chain by pointer doubling. Sessions whose
    chains end in a cycle or outside the table have no place and are left out.
    """
    keys = as_list(keys)
    links = chains(edges, keys).join(edges.select(*keys, "sid", "blk"), keys + ["sid"])
    up = F.when(F.col("level") > 0, F.col("blk"))
    nodes = materialise(links.select(*keys, "sid", up.alias("up"), F.col("level").cast("bigint").alias("depth")))
    sizes, _ = _subtree_sizes(nodes.select(*keys, "sid", "up"), keys)
    nodes = nodes.join(sizes.select(*keys, "sid", "size"), keys + ["sid"])
    siblings = keys + ["up"]
    ranged = range_blocks(nodes, *[F.col(c).asc_nulls_first() for c in siblings], "sid")
    placed = running(ranged, siblings, ["sid"], BLOCK, {"before": "size"}, exclusive=True)
    # Every step down takes one number for the parent and those of the siblings before.
    step = F.coalesce("before", F.lit(0)) + F.lit(1)
    state = materialise(placed.select(*keys, "sid", "up", "depth", "size", step.cast("bigint").alias("number")))
    while not state.where("up is not null").isEmpty():
        over = state.select(*keys, F.col("sid").alias("up"), F.col("up").alias("_up"), F.col("number").alias("_number"))
        state = materialise(state.join(over, keys + ["up"], "left").select(
            *keys, "sid", F.col("_up").alias("up"), "depth", "size", (F.col("number") + F.coalesce("_number", F.lit(0))).alias("number")))
    return state.select(*keys, "sid", "depth", "number", "size")


def blocking_pairs(requests: DataFrame, texts: DataFrame, waits: DataFrame) -> DataFrame:
    """Each blocked session next to its blocker, with both texts and the wait."""
    text = lambda who: texts.select(F.col("session_id").alias(f"{who}_session_id"), F.col("text").alias(f"{who}_sql_text"))
    known = requests.select(F.col("sid").alias("blocking_session_id"))
    return (requests.where(is_blocked()).select(F.col("sid").alias("blocked_session_id"), F.col("blk").alias("blocking_session_id"))
            .join(known, "blocking_session_id", "inner")
            .join(text("blocked"), "blocked_session_id").join(text("blocking"), "blocking_session_id")
            .join(waits.select(F.col("session_id").alias("blocked_session_id"), "wait_type", "wait_duration_ms"), "blocked_session_id"))


def blocked_processes(requests: DataFrame, texts: DataFrame) -> DataFrame:
    return requests.where("blk > 0").join(texts.select(F.col("session_id").alias("sid"), "text"), "sid")


def lock_contention(locks: DataFrame, waits: DataFrame, requests: DataFrame, texts: DataFrame) -> DataFrame:
    """Waiting locks with waiter and blocker, their batches and the waiter's statement."""
    r = (requests.join(texts, "sql_handle", "inner")
         .select("session_id", "text", slice_statement("text", "statement_start_offset", "statement_end_offset").alias("statement")))
    waiter = r.select(F.col("session_id").alias("request_session_id"), F.col("text").alias("waiter_batch"), F.col("statement").alias("waiter_statement"))
    blocker = r.select(F.col("session_id").alias("blocking_session_id"), F.col("text").alias("blocker_batch"))
    return (locks.join(waits, F.col("lock_owner_address") == F.col("resource_address"), "inner")
            .join(waiter, "request_session_id", "left").join(blocker, "blocking_session_id", "left")
            .select("resource_type", "entity_id", "request_mode", F.col("request_session_id").alias("waiter_session_id"),
                    "wait_duration_ms", "waiter_batch", "waiter_statement",
                    F.col("blocking_session_id").alias("blocker_session_id"), "blocker_batch"))
