"""Chat formatting: tool calls linked to their results, ordered, validated, and written as canonical JSON.

Calls and results are hash-joined by (conversation, identifier). A call may name calls it depends on; the
order is topological: a call is ready at its own turn, or, where a dependency is ready no earlier, right behind it
(its depth is one more). Conversations of at most FEW_CALLS rows are dealt out once, and many at a time are ordered and
numbered where they arrive; nothing else of them is shuffled. For larger ones: where a log has no such late dependency,
its order is settled by one join. Else the dependencies are split into connected components, in logarithmic rounds; those with a late dependency are ordered
component by component, each in linear time in one task, since a component is what a conversation's calls ask of
each other and holds identifiers only. Components of more than MOST_CALLS calls are settled by joins instead, with the same result: chains
of calls that depend on one other alone are contracted by doubling pointers, and only the others take rounds. A call on, or behind, a cycle is marked; such calls stand last in their conversation.
Their positions are numbered over range partitions, so a conversation with a third of all rows is spread like any other.
Arguments are parsed and checked against the tool's JSON schema, and each call with its result becomes one line of
canonical JSON: keys sorted, no spaces, unescaped UTF-8.

Defined cases: a call or result whose identifier is null matches nothing and is a row of its own, placed by its turn
alone (what it depends on is not followed); of repeated calls or results with one identifier
the first (turn, then text) stands and `n_calls`, `n_results` count them; calls without a result are
`unanswered`, results without a call `orphan`; dependencies that name no call of the conversation make a
call `dangling` but don't order it; arguments that aren't JSON, or a tool without schema, are invalid; null
texts are JSON null; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .support import connected_components, discard, read, shuffle_width, small, stage

#: The tool that a user's turn calls in plain conversations: the answer is the next turn.
REPLY = {
    "type": "object",
    "required": ["prompt", "turn"],
    "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}},
    "additionalProperties": False,
}
_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def violation(value: object, schema: dict, at: str = "$") -> str | None:
    """The first breach of a JSON schema (type, enum, required, properties, additionalProperties, items,
    lengths and bounds), or None."""
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds or []
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    fits = {"number": number, "integer": number and float(value).is_integer()} | {k: isinstance(value, t) for k, t in _KINDS.items()}
    if kinds and not any(fits.get(k, False) for k in kinds):
        return f"{at}: not {' or '.join(kinds)}"
    if "enum" in schema and value not in schema["enum"]:
        return f"{at}: not in enum"
    if number and not schema.get("minimum", value) <= value <= schema.get("maximum", value):
        return f"{at}: out of bounds"
    if isinstance(value, (str, list)) and not schema.get("minLength" if isinstance(value, str) else "minItems", 0) <= len(value) <= schema.get("maxLength" if isinstance(value, str) else "maxItems", len(value)):
        return f"{at}: length"
    if isinstance(value, list):
        return next((v for i, x in enumerate(value) if (v := violation(x, schema.get("items", {}), f"{at}[{i}]"))), None)
    if isinstance(value, dict):
        known = schema.get("properties", {})
        if missing := [k for k in schema.get("required", []) if k not in value]:
            return f"{at}: no {missing[0]}"
        if schema.get("additionalProperties", True) is False and (extra := sorted(set(value) - set(known))):
            return f"{at}: unknown {extra[0]}"
        return next((v for k in sorted(known) if k in value and (v := violation(value[k], known[k], f"{at}.{k}"))), None)
    return None


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def linked(calls: DataFrame, results: DataFrame) -> DataFrame:
    """conv_id, call_id, turn, name, arguments, depends_on, n_calls, result, n_results and status."""
    known, call, result = "call_id is not null", F.struct("turn", "name", "arguments", "depends_on"), F.struct("turn", "content")
    c = calls.where(known).groupBy("conv_id", "call_id").agg(F.min(call).alias("c"), F.count(F.lit(1)).alias("n_calls"))
    r = results.where(known).groupBy("conv_id", "call_id").agg(F.min(result).alias("r"), F.count(F.lit(1)).alias("n_results"))
    both = c.join(r, ["conv_id", "call_id"], "full_outer")
    nameless = calls.where(f"not ({known})").select("conv_id", "call_id", call.alias("c"), F.lit(1).cast("long").alias("n_calls"))
    both = both.unionByName(nameless, True).unionByName(results.where(f"not ({known})").select("conv_id", "call_id", result.alias("r"), F.lit(1).cast("long").alias("n_results")), True)
    status = F.when(F.col("c").isNull(), "orphan").when(F.col("r").isNull(), "unanswered").otherwise("linked")
    return both.select(
        "conv_id", "call_id", F.coalesce("c.turn", "r.turn").alias("turn"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"),
        F.coalesce("c.depends_on", F.array().cast("array<string>")).alias("depends_on"), F.coalesce("n_calls", F.lit(0)).alias("n_calls"),
        F.col("r.content").alias("result"), F.coalesce("n_results", F.lit(0)).alias("n_results"), status.alias("status"),
    )


#: Rows of a conversation that is ordered whole where it arrives.
FEW_CALLS = 200
#: Calls of a component that one task orders; ids and turns take some hundred bytes each.
MOST_CALLS = 500_000


def peeled(nodes: list[int], turns: dict[int, int | None], edges: list[tuple[int, int]]) -> dict[int, tuple[int | None, int, bool]]:
    """(ready, depth, cyclic) of each call, from its turn and the edges (call, dependency): calls whose dependencies are
    all settled are taken off one after another; what is left is on, or behind, a cycle."""
    behind: dict[int, list[int]] = {}
    waits = dict.fromkeys(nodes, 0)
    for call, on in edges:
        behind.setdefault(on, []).append(call)
        waits[call] += 1
    out: dict[int, tuple[int | None, int, bool]] = {n: (turns[n], 0, True) for n in nodes}
    key = lambda n: (out[n][0] is not None, out[n][0] or 0, out[n][1])  # noqa: E731  a null turn is before all others
    todo = [n for n in nodes if not waits[n]]
    while todo:
        n = todo.pop()
        out[n] = (*out[n][:2], False)
        for call in behind.get(n, ()):
            if key(n) >= key(call):
                out[call] = (out[n][0], out[n][1] + 1, True)
            waits[call] -= 1
            if not waits[call]:
                todo.append(call)
    return out


def ordered(rows: DataFrame) -> DataFrame:
    """`rows` (staged) with ready, depth (the order's key), cyclic and dangling."""
    keys = ["conv_id", "call_id"]
    edges = rows.select("conv_id", "call_id", F.explode("depends_on").alias("on")).distinct()
    at = rows.where("call_id is not null").select("conv_id", F.col("call_id").alias("on"), F.col("turn").alias("on_turn"))
    loose = edges.join(at, ["conv_id", "on"], "left_anti").select(*keys).distinct().withColumn("dangling", F.lit(True))
    out = rows.join(loose, keys, "left").withColumn("dangling", F.coalesce("dangling", F.lit(False)))
    own = rows.where("call_id is not null").select(*keys, "turn")
    known = edges.join(at, ["conv_id", "on"]).join(own, keys)
    late = stage(known.where("on_turn >= turn or turn is null").select("conv_id").distinct(), "chat-late")
    if late.isEmpty():
        return out.withColumns({"ready": F.col("turn"), "depth": F.lit(0), "cyclic": F.lit(False)})
    moved = _settled(stage(known.join(small(late), "conv_id", "left_semi"), "chat-edges"))
    return out.join(moved, keys, "left").withColumns({"ready": F.when(F.col("depth").isNotNull(), F.col("ready")).otherwise(F.col("turn")), "cyclic": F.coalesce("cyclic", F.lit(False)), "depth": F.coalesce("depth", F.lit(0))})


def _settled(known: DataFrame) -> DataFrame:
    """conv_id, call_id, ready, depth and cyclic of the calls that the edges `known` (conv_id, call_id, on, turn, on_turn)
    name, in components that have a late edge."""
    node = lambda c: F.xxhash64("conv_id", c)
    e = known.select("conv_id", "call_id", "on", "turn", "on_turn", node("call_id").alias("a"), node("on").alias("b"))
    # A call that depends on itself has no edge to another, but is a component as well.
    groups = connected_components(e.where("a <> b").select("a", "b"))
    mine = e.join(small(groups.select(F.col("node").alias("a"), "component")), "a", "left").withColumn("component", F.coalesce("component", "a"))
    late = mine.where("on_turn >= turn or turn is null").select("component").distinct()
    mine = stage(mine.join(small(late), "component", "left_semi"), "chat-components")
    sizes = mine.groupBy("component").agg(F.count(F.lit(1)).alias("edges"))
    big = stage(sizes.where(F.col("edges") > MOST_CALLS).select("component"), "chat-big")
    side = small(big)

    def order(found: pa.Table) -> pa.RecordBatch:
        """Any number of whole components at once."""
        rows = found.to_pydict()
        names = {n: (c, k) for n, c, k in zip(rows["b"], rows["conv_id"], rows["on"], strict=True)} | {n: (c, k) for n, c, k in zip(rows["a"], rows["conv_id"], rows["call_id"], strict=True)}
        turns = dict(zip(rows["b"], rows["on_turn"], strict=True)) | dict(zip(rows["a"], rows["turn"], strict=True))
        done = peeled(list(names), turns, list(zip(rows["a"], rows["b"], strict=True)))
        columns = zip(*((*names[n], *done[n]) for n in names), strict=True) if names else [[]] * 5
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "call_id", "ready", "depth", "cyclic"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last component so far, for it may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            component = batch.column(0)
            last = pc.index(component, component[batch.num_rows - 1]).as_py()
            if last or held and held[-1].column(0)[0] != component[0]:
                yield order(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield order(pa.Table.from_batches(held))

    schema = "conv_id long, call_id string, ready long, depth int, cyclic boolean"
    usual = mine.join(side, "component", "left_anti").select("component", "conv_id", "call_id", "on", "turn", "on_turn", "a", "b")
    usual = usual.repartition(shuffle_width(known.sparkSession), "component").sortWithinPartitions("component").mapInArrow(run, schema)
    return usual if big.isEmpty() else usual.unionByName(_relaxed(stage(mine.join(side, "component", "left_semi"), "chat-relaxed")))


def _later(a: Column, b: Column) -> Column:
    """The later of two (ready, depth); a null ready is before all others."""
    return F.greatest(a, b)


def _behind(k: Column, steps: Column) -> Column:
    """(ready, depth) of a call that many steps behind one that is settled at k."""
    return F.struct(k["ready"].alias("ready"), (k["depth"] + steps).alias("depth"))


def _contracted(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """n, at, steps, own and head of every call: it is settled at the later of `own` and `steps` behind the call `at`. Calls
    that depend on one call alone hang on it, and on what that hangs on: pointers double with each join, so a chain of
    any length takes its logarithm. Other calls are heads, `at` themselves; what hangs on a circle never gets to one."""
    one = edges.groupBy("a").agg(F.min("b").alias("b"), F.count(F.lit(1)).alias("deps")).where("deps = 1 and a <> b").select(F.col("a").alias("n"), "b")
    start = calls.select("n", F.struct(F.col("turn").alias("ready"), F.lit(0).cast("long").alias("depth")).alias("own")).join(one, "n", "left")
    state = stage(start.select("n", F.coalesce("b", "n").alias("at"), F.col("b").isNotNull().cast("long").alias("steps"), "own", F.col("b").isNull().alias("head")), "chat-chains")
    rounds = max(1, state.count()).bit_length() + 1  # by then only circles have not ended
    for _ in range(rounds):
        up = state.select(F.col("n").alias("at"), F.col("at").alias("up"), F.col("steps").alias("more"), F.col("own").alias("over"))
        moved = state.join(up, "at").where("up <> at")
        if moved.isEmpty():
            break
        both = state.join(up, "at")
        step = stage(both.select("n", F.col("up").alias("at"), (F.col("steps") + F.col("more")).alias("steps"), F.when(F.col("at") == F.col("n"), F.col("own")).otherwise(_later(F.col("own"), _behind(F.col("over"), F.col("steps")))).alias("own"), "head"), "chat-chains")
        discard(state)
        state = step
    return state


def _relaxed(e: DataFrame) -> DataFrame:
    """The same by joins. Chains are contracted first, so only calls that depend on several take rounds: those whose
    dependencies are all settled are settled round by round, as many as the longest way through such calls has; what
    is left is on, or behind, a cycle."""
    calls = e.select("conv_id", F.col("call_id"), F.col("a").alias("n"), F.col("turn")).union(e.select("conv_id", "on", "b", "on_turn")).distinct()
    calls = stage(calls, "chat-calls")
    edges = stage(e.select("a", "b").distinct(), "chat-pairs")
    hung = _contracted(calls, edges)
    heads = hung.where("head").select("n", "own")
    links = edges.join(heads.select(F.col("n").alias("a")), "a", "left_semi").join(hung.select(F.col("n").alias("b"), "at", "steps", F.col("own").alias("least")), "b")
    links = stage(links.select("a", "at", (F.col("steps") + 1).alias("steps"), _behind(F.col("least"), F.lit(1).cast("long")).alias("least")), "chat-links")
    # What waits for itself, or for a circle of calls that each depend on one, is never free.
    never = links.where("a = at").select("a").union(links.join(heads.select(F.col("n").alias("at")), "at", "left_anti").select("a"))
    never = stage(never.select(F.col("a").alias("n")).distinct(), "chat-never")
    open_ = stage(heads.select("n", F.col("own").alias("k")), "chat-open")
    done = None
    while True:
        waiting = links.join(open_.select(F.col("n").alias("at")), "at", "left_semi").select(F.col("a").alias("n"))
        free = stage(open_.join(waiting.union(never).distinct(), "n", "left_anti"), "chat-free")
        if free.isEmpty():
            break
        done = free if done is None else done.union(free)
        best = links.join(free.select(F.col("n").alias("at"), "k"), "at").groupBy(F.col("a").alias("n")).agg(F.max(_later(_behind(F.col("k"), F.col("steps")), F.col("least"))).alias("best"))
        rest = open_.join(free.select("n"), "n", "left_anti").join(best, "n", "left")
        open_ = stage(rest.select("n", F.when(F.col("best").isNotNull(), _later(F.col("k"), F.col("best"))).otherwise(F.col("k")).alias("k")), "chat-open")
    found = open_.select(F.col("n").alias("at"), "k", F.lit(True).alias("cyclic"))
    found = found if done is None else found.union(done.select("n", "k", F.lit(False)))
    out = calls.join(hung, "n").join(found, "at", "left").withColumn("cyclic", F.coalesce("cyclic", F.lit(True)))
    alone = F.struct(F.col("turn").alias("ready"), F.lit(0).cast("long").alias("depth"))
    k = F.when(F.col("head"), F.col("k")).when(F.col("cyclic"), alone).otherwise(_later(F.col("own"), _behind(F.col("k"), F.col("steps"))))
    return out.select("conv_id", "call_id", k["ready"].alias("ready"), k["depth"].cast("int").alias("depth"), "cyclic")


def positions(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Number the rows of each group from 0 in this order, without bringing a group into one task: rows are
    numbered in range partitions, and a group's first number is taken off, which stands beside each partition's part
    of the group."""
    spread = rows.repartitionByRange(shuffle_width(rows.sparkSession), group, *order).withColumn("_pid", F.spark_partition_id())
    spread = stage(spread, "positions", "zstd")
    counts = spread.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))  # one row for each partition
    before = counts.select("_pid", F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    nth = F.row_number().over(Window.partitionBy("_pid").orderBy(group, *order)) - 1
    placed = spread.withColumn("_nth", nth).join(F.broadcast(before), "_pid").withColumn("_at", F.col("_base") + F.col("_nth"))
    parts = placed.groupBy("_pid", group).agg(F.min("_at").alias("_first"))
    parts = parts.select(F.col("_pid").alias("_p"), F.col(group).alias("_g"), F.min("_first").over(Window.partitionBy(group)).alias("_first"))
    both = placed.join(parts, (F.col("_pid") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    return both.withColumn(name, (F.col("_at") - F.col("_first")).cast("long")).drop("_pid", "_nth", "_base", "_at", "_first", "_g", "_p")


def _ranked(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Each value's place among the distinct values in ascending order (a null is -1), and those values."""
    coded = column.dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    place = np.empty(len(order) + 1, np.int64)
    place[np.asarray(order)] = np.arange(len(order))
    place[-1] = -1
    return place[coded.indices.fill_null(len(order)).to_numpy(zero_copy_only=False)], coded.dictionary.take(order)


def _fanned(edge_at: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The places from edge_at[n] to edge_at[n + 1] of every node."""
    size = edge_at[nodes + 1] - edge_at[nodes]
    return np.repeat(edge_at[nodes] - (np.cumsum(size) - size), size) + np.arange(size.sum())


def whole_conversations(conv: pa.Array, call_id: pa.Array, turn: pa.Array, depends_on: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, cyclic, dangling) of the rows of whole conversations, which stand together: all of them are peeled at
    once, the calls whose dependencies are settled round by round."""
    n = len(conv)
    (group, _), (turn_rank, _) = _ranked(conv), _ranked(turn)
    asked, parent = pc.list_flatten(depends_on), pc.list_parent_indices(depends_on).to_numpy(zero_copy_only=False).astype(np.int64)
    names, _ = _ranked(pa.concat_arrays([call_id, asked]))
    mine, asked = names[:n], names[n:]
    # Calls by (conversation, identifier): rows without an identifier are not found, and ask for nothing.
    width = int(names.max(initial=0)) + 1
    rows = np.flatnonzero(mine >= 0)
    key = group[rows] * width + mine[rows]
    order = np.argsort(key)
    rows, key = rows[order], key[order]
    parent, asked = parent[mine[parent] >= 0], asked[mine[parent] >= 0]
    wanted = group[parent] * width + asked
    at = np.minimum(np.searchsorted(key, wanted), max(len(key) - 1, 0))
    found = (key[at] == wanted) & (asked >= 0) if len(parent) else np.zeros(0, bool)
    dangling = np.zeros(n, bool)
    dangling[parent[~found]] = True
    edges = np.unique(rows[at[found]] * n + parent[found])  # by what is asked for
    on, call = edges // max(n, 1), edges % max(n, 1)
    edge_at = np.searchsorted(on, np.arange(n + 1))
    waits = np.bincount(call, minlength=n)
    # (ready, depth) as one number: a depth is less than n, and a null turn is before all others.
    ready = (turn_rank + 1) * (n + 1)
    cyclic, free = np.ones(n, bool), np.flatnonzero(waits == 0)
    while len(free):
        cyclic[free] = False
        onward = _fanned(edge_at, free)
        np.maximum.at(ready, call[onward], ready[on[onward]] + 1)
        np.subtract.at(waits, call[onward], 1)
        behind = np.unique(call[onward])
        free = behind[waits[behind] == 0]
    order = np.lexsort((turn_rank, mine, ready, cyclic, group))
    position = np.empty(n, np.int64)
    first = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0]) if n else np.zeros(0, np.int64)
    position[order] = np.arange(n) - np.repeat(first, np.diff(np.r_[first, n]))
    return position, cyclic, dangling


def arranged(rows: DataFrame, counted: DataFrame) -> DataFrame:
    """`rows` with position, cyclic and dangling. `counted` has a conv_id for each row, or for more."""
    many = counted.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > FEW_CALLS) | F.col("conv_id").isNull())
    many = stage(many.select("conv_id"), "chat-many")
    none = many.isEmpty()
    side = small(many.where("conv_id is not null"))
    few = rows if none else rows.where("conv_id is not null").join(side, "conv_id", "left_anti").select(*rows.columns)
    at = [rows.columns.index(c) for c in ("conv_id", "call_id", "turn", "depends_on")]

    def place(table: pa.Table) -> Iterator[pa.RecordBatch]:
        whole = table.combine_chunks()
        found = whole_conversations(*(whole.column(k).chunk(0) for k in at))
        for name, values in zip(("position", "cyclic", "dangling"), found, strict=True):
            whole = whole.append_column(name, pa.array(values))
        yield from whole.to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the last conversation so far, for it may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column(at[0])
            last = pc.index(conv, conv[batch.num_rows - 1]).as_py()
            if last or held and held[-1].column(at[0])[0] != conv[0]:
                if held or last:
                    yield from place(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield from place(pa.Table.from_batches(held))

    schema = ", ".join(f"`{c}` {t}" for c, t in [*rows.dtypes, ("position", "bigint"), ("cyclic", "boolean"), ("dangling", "boolean")])
    out = few.repartition(shuffle_width(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id").mapInArrow(run, schema)
    if none:
        return out
    large = stage(rows.join(side, "conv_id", "left_semi").select(*rows.columns).unionByName(rows.where("conv_id is null")), "chat-linked", "zstd")
    large = positions(ordered(large), "conv_id", ["cyclic", "ready", "depth", "call_id", "turn"], "position")
    return out.unionByName(large.select(*out.columns))


def formatted(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row for each call or orphan result: conv_id, position, call_id, name, status, dangling, cyclic,
    n_calls, n_results, valid, error and json. `schemas` is a table of the tools' parameters."""
    rows = arranged(linked(calls, results), calls.select("conv_id").union(results.select("conv_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"valid": [], "error": [], "json": []}
            for call_id, name, arguments, result, status in zip(*(batch.column(c).to_pylist() for c in ("call_id", "name", "arguments", "result", "status")), strict=True):
                value, error = None, None
                if status != "orphan":
                    try:
                        value = json.loads(arguments or "")
                        error = violation(value, schemas[name]) if name in schemas else "no schema"
                    except ValueError:
                        value, error = arguments, "not JSON"
                line = {"call": None if status == "orphan" else {"arguments": value, "id": call_id, "name": name}, "result": None if status == "unanswered" else {"content": result, "id": call_id}}
                out["valid"].append(status != "orphan" and error is None)
                out["error"].append(error)
                out["json"].append(canonical(line))
            kept = ["conv_id", "position", "call_id", "name", "status", "dangling", "cyclic", "n_calls", "n_results"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out["valid"], pa.bool_()), pa.array(out["error"], pa.string()), pa.array(out["json"], pa.string())], [*kept, *out])

    rows = rows.select(F.col("conv_id").cast("long"), "position", "call_id", "name", "arguments", "result", "status", "dangling", "cyclic", F.col("n_calls").cast("long"), F.col("n_results").cast("long"))
    return rows.mapInArrow(run, "conv_id long, position long, call_id string, name string, status string, dangling boolean, cyclic boolean, n_calls long, n_results long, valid boolean, error string, json string")


def turns_as_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plain conversations as calls and results: a user's turn calls `reply` and depends on the user's turn
    before it; any other turn answers the turn before it (a system's first turn answers none)."""
    ids = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role"), F.col("text"))
    user = rows.where("role = 'user'")
    arguments = F.to_json(F.struct(F.col("text").alias("prompt"), F.col("turn")), {"ignoreNullFields": "false"})
    earlier = user.select("conv_id", (F.col("turn") + 2).alias("turn")).distinct().withColumn("after", F.lit(True))
    calls = user.join(earlier, ["conv_id", "turn"], "left")
    calls = calls.select("conv_id", ids(F.col("turn")).alias("call_id"), "turn", F.lit("reply").alias("name"), arguments.alias("arguments"), F.when(F.col("after"), F.array(ids(F.col("turn") - 2))).otherwise(F.array().cast("array<string>")).alias("depends_on"))
    results = rows.where("role is null or role <> 'user'").select("conv_id", ids(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as ordered, validated calls with their results."""
    calls, results = turns_as_calls(read(spark, sf_dir, "conversations"))
    return formatted(calls, results, {"reply": REPLY})


def chat_call_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of calls that ask for each other, also for later ones and in circles: each order's line numbers are
    calls, and a line asks for the lines that its part and its supplier name."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    # Lines go out by order once; the later groupings find them there.
    rows = lines.repartition(shuffle_width(spark), "l_orderkey").groupBy(F.col("l_orderkey").alias("conv_id"), F.col("l_linenumber").cast("long").alias("turn")).agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    line = lambda n: F.concat(F.lit("c"), n.cast("string"))
    calls = rows.select("conv_id", line(F.col("turn")).alias("call_id"), "turn", F.lit("f").alias("name"), F.lit("{}").alias("arguments"), F.array(line(F.col("p") % 11 + 1), line(F.col("s") % 9 + 1)).alias("depends_on"))
    # Two of three orders' lines don't ask for themselves.
    calls = calls.withColumn("depends_on", F.when(F.col("conv_id") % 3 > 0, F.filter("depends_on", lambda x: x != F.col("call_id"))).otherwise(F.slice("depends_on", 1, 1)))
    none = calls.limit(0).select("conv_id", "call_id", "turn", F.col("name").alias("content"))
    rows = linked(calls, none).select("conv_id", "call_id", "turn", "depends_on")
    return arranged(rows, lines.select(F.col("l_orderkey").alias("conv_id"))).select("conv_id", "call_id", "position", "dangling", "cyclic")
