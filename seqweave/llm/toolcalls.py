"""Tool-call linking: calls and results joined by identifier, ordered, validated, as canonical JSON.

Messages carry calls as a JSON list `tool_calls` of {"id", "name", "arguments", "after"?} and results by the
column `tool_call_id`. A call is linked with the result of its identifier in its conversation. Its place is the
message that made it; a call that names calls in `after` stands behind each of them, so it moves to the place of
the last one if that is later than its own, and among calls of one place its level is one more than theirs. Arguments
are checked against a schema of required and optional names with their types, and everything is written as JSON
with sorted names and no white space. Only DataFrame functions are used.

Ordering. Only conversations with a call that names one of its own or a later message need any work. Those of up to
LOCAL names in `after` are solved each in a row of their own, call after call. Larger ones, of any size, stay tables:
chains of calls that name one call are shortened by pointer doubling, in a logarithmic number of joins, and calls that
name several are settled in rounds. Both are exact and find cycles exactly. No conversation of unbounded size is gathered.

Every message leaves at least one row, with a status. Calls: `ok`; `invalid` (arguments are no JSON object, miss a
required name, or have an unknown name or a wrong type); `unknown_tool`; `no_result`; `cyclic` (on a cycle or behind one:
no order exists; place is the own message, level null); the first that applies of cyclic, unknown_tool, invalid, no_result
counts. `repeated_call` (an identifier that an earlier call has, ties by content) and `no_id` (a call without identifier) take no part in the order. Results are part of their call's JSON; `orphan_result` has no call,
`repeated_result` is a later one of its call, ties by text. `malformed`: tool_calls is no JSON list of objects. `text`: the words of a
message, unless it is a result, or has calls and no words. `unplaced`: a message of a null conversation or turn.

Names in `after` that no call has are ignored; null text is empty; repeated rows each count; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqweave.llm.common import discard, let, reliable

CALLS = "array<struct<id:string,name:string,arguments:string,after:array<string>>>"
#: name -> (required, optional), each argument name -> type of the JSON value.
SCHEMAS = {
    "answer": ({"question": "STRING", "turn": "BIGINT"}, {"short": "BOOLEAN"}),
    "search": ({"query": "STRING"}, {"limit": "BIGINT"}),
    "translate": ({"text": "STRING", "to": "STRING"}, {}),
}
#: Most names in `after`, over all calls of a conversation, that are solved in one row.
LOCAL = 4000
KEY = ["conv_id", "call_id"]


def quoted(c: Column) -> Column:
    """A string as JSON; null: null."""
    json = F.to_json(F.to_variant_object(F.struct(c.alias("x"))))  # {"x":...}
    return F.when(c.isNull(), "null").otherwise(F.substring(json, F.lit(6), F.length(json) - 6))


def spoken() -> Column:
    """A message's words as JSON."""
    return F.concat(F.lit('{"content":'), quoted(F.col("text")), F.lit(',"role":'), quoted(F.col("role")), F.lit("}"))


def linked(messages: DataFrame, schemas: dict = SCHEMAS, local: int = LOCAL) -> DataFrame:
    """conv_id, call_id, name, place, level, status, json. Order by conv_id, place, level, call_id; words have level -1.

    messages: conv_id, turn, role, text, tool_calls (JSON), tool_call_id.
    """
    nothing = F.lit(None).cast("string")
    rows = messages.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"), "tool_calls", "tool_call_id")
    placed = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    rows = rows.withColumn("made", F.when(placed, F.from_json("tool_calls", CALLS)))

    # Messages themselves.
    malformed = F.col("tool_calls").isNotNull() & F.col("made").isNull()
    status = F.when(~placed, "unplaced").when(malformed, "malformed").when(F.col("tool_call_id").isNull() & ((F.col("text") != "") | F.col("tool_calls").isNull()), "text")
    raw = F.concat(F.lit('{"content":'), quoted(F.col("text")), F.lit(',"role":'), quoted(F.col("role")), F.lit(',"tool_calls":'), quoted(F.col("tool_calls")), F.lit("}"))
    words = rows.withColumn("status", status).filter("status is not null")
    json = F.when(F.col("status") == "malformed", raw).otherwise(spoken())
    words = words.select("conv_id", nothing.alias("call_id"), nothing.alias("name"), F.col("turn").alias("place"), F.lit(-1).alias("level"), "status", json.alias("json"))

    # Calls; the first of an identifier counts.
    calls = rows.filter(F.size("made") > 0).select("conv_id", "turn", F.explode("made").alias("c"))
    calls = calls.select("conv_id", "turn", F.col("c.id").alias("call_id"), "c.name", "c.arguments", "c.after")
    first = W.partitionBy(*KEY).orderBy("turn", "name", "arguments", "after")  # a window of one identifier
    known = reliable(calls.filter("call_id is not null").withColumn("nth", F.row_number().over(first)))
    chosen = ordered(known.filter("nth = 1").drop("nth"), local)
    other = known.filter("nth > 1").drop("nth").withColumn("status", F.lit("repeated_call")).unionByName(calls.filter("call_id is null").withColumn("status", F.lit("no_id")))

    # Results; the first of an identifier counts.
    results = rows.filter(placed & F.col("tool_call_id").isNotNull()).select("conv_id", F.col("tool_call_id").alias("call_id"), F.struct("turn", "text", "role").alias("r"))
    results = results.withColumn("nth", F.row_number().over(W.partitionBy(*KEY).orderBy("r")))

    both = chosen.withColumn("called", F.lit(True)).join(results, KEY, "full").withColumn("v", F.try_parse_json("arguments"))
    listed, valid = F.lit(False), F.lit(False)
    for name, (required, optional) in schemas.items():
        listed |= F.col("name") == name
        valid |= (F.col("name") == name) & fits(required, optional)
    status = (
        F.when(F.col("called").isNull() & (F.col("nth") == 1), "orphan_result").when(F.col("nth") > 1, "repeated_result").when(F.col("cyclic"), "cyclic")
        .when(~F.coalesce(listed, F.lit(False)), "unknown_tool").when(~F.coalesce(valid, F.lit(False)), "invalid").when(F.col("nth").isNull(), "no_result").otherwise("ok")
    )
    answer = F.concat(F.lit('{"content":'), quoted(F.col("r.text")), F.lit(',"id":'), quoted(F.col("call_id")), F.lit(',"role":'), quoted(F.col("r.role")), F.lit("}"))
    both = both.withColumn("status", status)
    alone = F.col("status").isin("orphan_result", "repeated_result")
    both = both.select(
        "conv_id", "call_id", F.when(~alone, F.col("name")).alias("name"), F.when(alone, F.col("r.turn")).otherwise(F.col("place")).alias("place"),
        F.when(alone, 0).otherwise(F.col("level")).alias("level"), "status", F.when(alone, answer).otherwise(exchange(F.col("r.text"))).alias("json"),
    )
    other = other.withColumn("v", F.try_parse_json("arguments"))
    other = other.select("conv_id", "call_id", "name", F.col("turn").alias("place"), F.lit(0).alias("level"), "status", exchange(nothing).alias("json"))
    return both.unionByName(other).unionByName(words)


def exchange(result: Column) -> Column:
    """A call and its result as JSON."""
    return F.concat(
        F.lit('{"arguments":'), F.coalesce(F.to_json("v"), F.lit("null")), F.lit(',"id":'), quoted(F.col("call_id")), F.lit(',"name":'), quoted(F.col("name")),
        F.lit(',"result":'), quoted(result), F.lit("}"),
    )


def fits(required: dict[str, str], optional: dict[str, str]) -> Column:
    """Whether the variant v is an object with these names and types and no others."""
    kind = lambda k: F.schema_of_variant(F.try_variant_get("v", f"$.{k}", "variant"))
    names = F.json_object_keys(F.to_json("v"))
    ok = names.isNotNull() & (F.size(F.array_except(names, F.array(*map(F.lit, [*required, *optional])))) == 0)
    for k, t in required.items():
        ok &= F.coalesce(kind(k) == t, F.lit(False))
    for k, t in optional.items():
        ok &= F.coalesce(kind(k) == t, ~F.array_contains(names, k))
    return ok


def later(k: Column, by) -> Column:
    """The key (place, level) so many levels on."""
    return F.struct(k["place"].alias("place"), (k["level"] + by).alias("level"))


def ordered(calls: DataFrame, local: int) -> DataFrame:
    """calls with place, level and cyclic; place and level, as a pair, are larger than those of every call named in `after`.

    Identifiers are unique in a conversation.
    """
    turns = calls.select("conv_id", F.col("call_id").alias("on"), F.col("turn").alias("on_turn"))
    edges = calls.select(*KEY, "turn", F.explode(F.array_distinct("after")).alias("on")).filter("on is not null")
    edges = reliable(edges.join(turns, ["conv_id", "on"]))
    work = edges.groupBy("conv_id").agg(F.count("*").alias("n"), F.max(F.col("turn") <= F.col("on_turn")).alias("late"))
    work = reliable(work.filter("late").select("conv_id", "n"))
    keys = solved_in_rows(edges.join(work.filter(F.col("n") <= local).drop("n"), "conv_id"))
    if work.filter(F.col("n") > local).limit(1).count():
        keys = keys.unionByName(solved_in_tables(reliable(edges.join(work.filter(F.col("n") > local).drop("n"), "conv_id", "left_semi"))))
    out = calls.join(reliable(keys), KEY, "left").withColumn("cyclic", F.coalesce("cyclic", F.lit(False)))
    level = F.when(~F.col("cyclic"), F.coalesce("k.level", F.lit(0)))
    return out.withColumn("place", F.coalesce("k.place", "turn")).withColumn("level", level).drop("k")


def solved_in_rows(edges: DataFrame) -> DataFrame:
    """conv_id, call_id, k (place, level), cyclic of the calls that name others, for conversations of bounded size.

    A round settles the calls all of whose named calls are settled; it is repeated in the row until nothing moves.
    """
    every = edges.select(*KEY, "turn").unionByName(edges.select("conv_id", F.col("on").alias("call_id"), F.col("on_turn").alias("turn"))).distinct()
    every = every.withColumn("at", F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "call_id")) - 1)
    named = edges.select(*KEY, "on").join(every.select("conv_id", F.col("call_id").alias("on"), F.col("at").alias("on_at")), ["conv_id", "on"])
    named = named.groupBy(*KEY).agg(F.collect_list("on_at").alias("named"))
    every = every.join(named, KEY, "left").select("conv_id", F.struct("at", "call_id", "turn", F.coalesce("named", F.array().cast("array<int>")).alias("named")).alias("x"))
    rows = every.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("xs"))

    def own(turn):
        return F.struct(turn.cast("long").alias("place"), F.lit(0).alias("level"))

    def settle(xs, ks):
        def one(x, i):
            open_ = F.exists(x["named"], lambda p: F.get(ks, p).isNull())
            behind = F.array_max(F.transform(x["named"], lambda p: later(F.get(ks, p), 1)))
            return F.when(F.get(ks, i).isNotNull(), F.get(ks, i)).when(~open_, F.greatest(own(x["turn"]), behind))

        return F.transform(xs, one)

    def state(ks, left, moves):
        return F.struct(ks.alias("ks"), left.alias("left"), moves.alias("moves"))

    def round_(xs, s):
        new = let(settle(xs, s["ks"]), lambda ks: state(ks, F.size(F.filter(ks, lambda k: k.isNull())), F.lit(True)))
        return F.when(s["moves"], let(new, lambda n: state(n["ks"], n["left"], n["left"] < s["left"]))).otherwise(s)

    start = F.transform("xs", lambda x: F.when(F.size(x["named"]) == 0, own(x["turn"])))
    ks = F.aggregate(F.sequence(F.lit(1), F.size("xs")), state(start, F.size("xs"), F.lit(True)), lambda s, _: round_(F.col("xs"), s))["ks"]
    rows = rows.select("conv_id", F.inline(F.arrays_zip(F.col("xs").alias("x"), ks.alias("k"))))
    return rows.filter(F.size("x.named") > 0).select("conv_id", "x.call_id", "k", F.col("k").isNull().alias("cyclic"))


def solved_in_tables(edges: DataFrame) -> DataFrame:
    """The same for conversations of any size.

    What a call makes of the key x of a call that it stands behind, directly or through others, is max(a, x + d levels), and
    such steps put together are one again. A chain of calls that name one call each is so reduced to one step from where it
    begins. Calls that name several are settled once all steps to them begin at settled ones.
    """
    many = edges.groupBy(*KEY).agg(F.count("*").alias("n"))
    edges = reliable(edges.join(many, KEY))
    step = F.struct(F.col("turn").alias("place"), F.lit(0).alias("level"))
    going, done, cyclic, n = edges.filter("n = 1").select(*KEY, F.col("on").alias("begin"), step.alias("a"), F.lit(1).alias("d")), None, None, 0
    singles = going = reliable(going)
    most, reach = going.count(), 1
    while True:
        nxt = singles.select("conv_id", F.col("call_id").alias("begin"), F.col("begin").alias("b_"), F.col("a").alias("a_"), F.col("d").alias("d_"))
        both = reliable(going.join(nxt, ["conv_id", "begin"], "left"))
        ends = both.filter("b_ is null").select(*KEY, "begin", "a", "d")
        done = ends if done is None else done.unionByName(ends)
        moved = both.filter("b_ is not null").select(*KEY, F.col("b_").alias("begin"), F.greatest(F.col("a"), later(F.col("a_"), F.col("d"))).alias("a"), (F.col("d") + F.col("d_")).alias("d"))
        going = reliable(moved)
        n = going.count()
        if not n:
            break
        if reach > most:  # further than there are calls: on a cycle or behind one
            cyclic = going
            break
        reach *= 2
        singles = reliable(going.unionByName(done))  # all chains, as far as they are known
    done = reliable(done)
    # Steps to the calls that name several; those that begin in a cycle are never settled.
    through = done.select("conv_id", F.col("call_id").alias("on"), "begin", "a", "d")
    wide = edges.filter("n > 1").join(through, ["conv_id", "on"], "left")
    first = F.coalesce(later(F.col("a"), 1), step)
    open_ = reliable(wide.select(*KEY, F.coalesce("begin", "on").alias("begin"), F.greatest(first, step).alias("a"), (F.coalesce("d", F.lit(0)) + 1).alias("d")))
    named = edges.select(*KEY).distinct()
    fresh = edges.select("conv_id", F.col("on").alias("call_id"), "on_turn").distinct().join(named, KEY, "left_anti")
    fresh = reliable(fresh.select(*KEY, F.struct(F.col("on_turn").alias("place"), F.lit(0).alias("level")).alias("k")))
    settled, part = fresh, None
    while True:
        begun = fresh.select("conv_id", F.col("call_id").alias("begin"), "k")
        hit = open_.join(begun, ["conv_id", "begin"]).select(*KEY, F.greatest(F.col("a"), later(F.col("k"), F.col("d"))).alias("k"))
        hit = hit if part is None else hit.unionByName(part)
        hit = reliable(hit.groupBy(*KEY).agg(F.max("k").alias("k")))
        left = reliable(open_.join(begun, ["conv_id", "begin"], "left_anti"))
        waiting = left.select(*KEY).distinct()
        new = reliable(hit.join(waiting, KEY, "left_anti"))
        if not new.limit(1).count():
            break
        part = reliable(hit.join(waiting, KEY, "left_semi"))
        discard(open_, hit)
        settled, fresh, open_ = settled.unionByName(new), new, left
    begun = reliable(settled)
    ends = begun.select("conv_id", F.col("call_id").alias("begin"), "k")
    chains = done.join(ends, ["conv_id", "begin"], "left").select(*KEY, F.greatest(F.col("a"), later(F.col("k"), F.col("d"))).alias("k"), F.col("k").isNull().alias("cyclic"))
    joined = edges.filter("n > 1").select(*KEY).distinct().join(begun, KEY, "left").select(*KEY, "k", F.col("k").isNull().alias("cyclic"))
    out = chains.withColumn("k", F.when(~F.col("cyclic"), F.col("k"))).unionByName(joined)
    if cyclic is not None:
        out = out.unionByName(cyclic.select(*KEY, F.lit(None).cast("struct<place:bigint,level:int>").alias("k"), F.lit(True).alias("cyclic")))
    return out


def as_messages(conversations: DataFrame) -> DataFrame:
    """Turns as messages with tool calls, since `conversations` holds none.

    A user's turn t calls a tool as call_t, on its whole text, and on some also as more_t; the assistant's turn t + 1 is the
    result of one of them. Calls of every third conversation name later ones, of the next third earlier ones, of the last
    either; some arguments do not fit, some tools are unknown, some lists are cut off and some identifiers missing. Which
    follows from the length of the text.
    """
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("n", F.length("text"))
    ident = lambda word, t: F.concat(F.lit(word), t.cast("string"))
    t, n, text = F.col("turn"), F.col("n"), F.col("text")
    name = F.when(n % 5 == 0, "search").when(n % 5 == 1, "translate").when(n % 25 == 4, "forecast").otherwise("answer")
    limit = F.when(n % 10 == 0, F.to_variant_object(F.struct(t.cast("string").alias("x")))).otherwise(F.to_variant_object(F.struct(t.alias("x"))))
    arguments = (
        F.when(n % 13 == 1, "not JSON").when(name == "search", F.to_json(F.struct(text.alias("query"), F.variant_get(limit, "$.x", "variant").alias("limit"))))
        .when(name == "translate", F.to_json(F.struct(text.alias("text"), F.when(n % 7 > 0, "en").alias("to")))).when(name == "forecast", F.to_json(F.struct("text")))
        .otherwise(F.to_json(F.struct(t.alias("turn"), (n < 80).alias("short"), text.alias("question"))))
    )
    forward = (F.col("conv_id") % 3 == 0) | ((F.col("conv_id") % 3 == 2) & (n % 4 == 1))
    after = F.when(forward, F.array(ident("call_", t + 1), ident("call_", t + 2))).otherwise(F.array(ident("call_", t - 1), ident("call_", t - 2)))
    main = F.struct(ident("call_", t).alias("id"), name.alias("name"), arguments.alias("arguments"), after.alias("after"))
    more = F.struct(F.when(n % 17 != 3, ident("more_", t)).alias("id"), F.lit("answer").alias("name"), F.to_json(F.struct(t.alias("turn"), F.lit("more").alias("question"))).alias("arguments"), F.array(ident("call_", t)).alias("after"))
    made = F.to_json(F.when(n % 3 == 0, F.array(more, main)).otherwise(F.array(main)))
    made = F.when(n % 19 == 5, F.concat(F.lit('[{"id":"'), ident("call_", t), F.lit('"'))).otherwise(made)
    result = F.when(n % 6 == 0, ident("more_", t - 1)).otherwise(ident("call_", t - 1))
    return rows.select("conv_id", "turn", "role", "text", F.when(F.col("role") == "user", made).alias("tool_calls"), F.when(F.col("role") == "assistant", result).alias("tool_call_id"))


def query(spark, sf_dir: str) -> DataFrame:
    return linked(as_messages(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


_Q = "CAST(to_json({}) AS VARCHAR)"
ORACLE = f"""
WITH RECURSIVE c AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM conversations),
u AS (SELECT *, n % 19 = 5 AS cut, CASE WHEN n % 5 = 0 THEN 'search' WHEN n % 5 = 1 THEN 'translate' WHEN n % 25 = 4 THEN 'forecast' ELSE 'answer' END AS name,
      conv_id % 3 = 0 OR conv_id % 3 = 2 AND n % 4 = 1 AS forward FROM c WHERE role = 'user'),
k AS (SELECT conv_id, turn, 'call_' || turn AS call_id, name, CASE WHEN n % 13 = 1 THEN 'null'
        WHEN name = 'search' THEN '{{"limit":' || CASE WHEN n % 10 = 0 THEN '"' || turn || '"' ELSE '' || turn END || ',"query":' || {_Q.format('text')} || '}}'
        WHEN name = 'translate' THEN '{{"text":' || {_Q.format('text')} || CASE WHEN n % 7 > 0 THEN ',"to":"en"' ELSE '' END || '}}' WHEN name = 'forecast' THEN '{{"text":' || {_Q.format('text')} || '}}'
        ELSE '{{"question":' || {_Q.format('text')} || ',"short":' || CASE WHEN n < 80 THEN 'true' ELSE 'false' END || ',"turn":' || turn || '}}' END AS arguments,
        n % 13 = 1 OR name = 'search' AND n % 10 = 0 OR name = 'translate' AND n % 7 = 0 AS wrong,
        CASE WHEN forward THEN ['call_' || (turn + 1), 'call_' || (turn + 2)] ELSE ['call_' || (turn - 1), 'call_' || (turn - 2)] END AS after FROM u WHERE NOT cut
      UNION ALL SELECT conv_id, turn, CASE WHEN n % 17 <> 3 THEN 'more_' || turn END, 'answer', '{{"question":"more","turn":' || turn || '}}', false, ['call_' || turn] FROM u WHERE n % 3 = 0 AND NOT cut),
e AS (SELECT k.conv_id, k.call_id, k.turn, x.on_id FROM k, LATERAL (SELECT unnest(after) AS on_id) x WHERE call_id IS NOT NULL AND EXISTS (SELECT 1 FROM k o WHERE o.conv_id = k.conv_id AND o.call_id = x.on_id)),
reach AS (SELECT conv_id, call_id, on_id FROM e UNION SELECT r.conv_id, r.call_id, e.on_id FROM reach r JOIN e ON e.conv_id = r.conv_id AND e.call_id = r.on_id),
cyc AS (SELECT DISTINCT r.conv_id, r.call_id FROM reach r WHERE EXISTS (SELECT 1 FROM reach q WHERE q.conv_id = r.conv_id AND q.call_id = q.on_id AND q.call_id = r.on_id)),
v AS (SELECT conv_id, call_id, turn AS place, 0 AS level FROM k WHERE call_id IS NOT NULL AND (conv_id, call_id) NOT IN (SELECT conv_id, call_id FROM cyc)
      UNION SELECT e.conv_id, e.call_id, CASE WHEN v.place >= e.turn THEN v.place ELSE e.turn END, CASE WHEN v.place >= e.turn THEN v.level + 1 ELSE 0 END
      FROM v JOIN e ON e.conv_id = v.conv_id AND e.on_id = v.call_id WHERE (e.conv_id, e.call_id) NOT IN (SELECT conv_id, call_id FROM cyc)),
o AS (SELECT conv_id, call_id, place, level FROM v QUALIFY row_number() OVER (PARTITION BY conv_id, call_id ORDER BY place DESC, level DESC) = 1),
r AS (SELECT conv_id, turn, text, CASE WHEN n % 6 = 0 THEN 'more_' ELSE 'call_' END || (turn - 1) AS call_id FROM c WHERE role = 'assistant')
SELECT k.conv_id, k.call_id, k.name, CASE WHEN k.call_id IS NULL THEN k.turn ELSE coalesce(o.place, k.turn) END AS place,
       CAST(CASE WHEN k.call_id IS NULL THEN 0 ELSE o.level END AS INTEGER) AS level,
       CASE WHEN k.call_id IS NULL THEN 'no_id' WHEN o.level IS NULL THEN 'cyclic' WHEN k.name = 'forecast' THEN 'unknown_tool' WHEN wrong THEN 'invalid' WHEN r.turn IS NULL THEN 'no_result' ELSE 'ok' END AS status,
       '{{"arguments":' || arguments || ',"id":' || coalesce('"' || k.call_id || '"', 'null') || ',"name":"' || k.name || '","result":' || coalesce({_Q.format('r.text')}, 'null') || '}}' AS json
FROM k LEFT JOIN o ON o.conv_id = k.conv_id AND o.call_id = k.call_id LEFT JOIN r ON r.conv_id = k.conv_id AND r.call_id = k.call_id
UNION ALL SELECT conv_id, call_id, NULL, turn, 0, 'orphan_result', '{{"content":' || {_Q.format('text')} || ',"id":"' || call_id || '","role":"assistant"}}'
FROM r WHERE (conv_id, call_id) NOT IN (SELECT conv_id, call_id FROM k WHERE call_id IS NOT NULL)
UNION ALL SELECT conv_id, NULL, NULL, turn, -1, 'text', '{{"content":' || {_Q.format('text')} || ',"role":"' || role || '"}}' FROM c WHERE role <> 'assistant' AND NOT (role = 'user' AND (n % 19 = 5 OR text = ''))
UNION ALL SELECT conv_id, NULL, NULL, turn, -1, 'malformed', '{{"content":' || {_Q.format('text')} || ',"role":"user","tool_calls":"[{{\\"id\\":\\"call_' || turn || '\\""}}' FROM u WHERE cut
"""
