"""Named queries over the driver's tables, and the SQL that gives the same rows from the original data.

Sequences: texts of `benchmark` (the smallest item is the reference), values of `events` by user (the smallest user is
the reference), quantities of `lineitem` by order, purchases among `events` as bits, and document lengths.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqweave.functions import bits as B
from seqweave.functions import symbols as S
from seqweave.operators import index as I
from seqweave.operators import matching as M
from seqweave.operators import suffixes
from seqweave.plans import folds, strategies
from seqweave.sources import files

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def new_folder(spark) -> str:
    """A new place in the folder that all executors share; a local session may have none."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that all executors share")
    return f"{(top or tempfile.mkdtemp(prefix='index-')).rstrip('/')}/{uuid.uuid4().hex}"


def texts(spark, d):
    """Inputs and the reference: all items but the first, and the first."""
    b = read(spark, d, "benchmark")
    first = b.agg(F.min("item_id")).first()[0]
    s = M.symbols_of(b, "item_id", "text")
    return s.filter(F.col("input_id") != first), s.filter(F.col("input_id") == first).select("symbols")


def values(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").alias("input_id"), "ts", "event_id", F.round(F.col("value") * 100).cast("long").alias("v"))
    s = e.groupBy("input_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "v"))), lambda x: x.v).alias("symbols"))
    first = e.agg(F.min("input_id")).first()[0]
    return s.filter(F.col("input_id") != first), s.filter(F.col("input_id") == first).select("symbols")


def orders(spark, d):
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q"))
    return rows.groupBy(F.col("l_orderkey").alias("input_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "q"))), lambda x: x.q).alias("symbols"))


def purchases(spark, d):
    return read(spark, d, "events").select(F.lit(0).cast("long").alias("vec_id"), F.col("event_id").cast("long").alias("pos"), (F.col("event_type") == "purchase").cast("int").alias("bit"))


def lengths(spark, d):
    return read(spark, d, "documents").select(F.lit(0).cast("long").alias("vec_id"), F.col("doc_id").alias("idx"), (F.col("n_chars") % 16).alias("len"))


def as_text(df: DataFrame, column: str = "symbols") -> DataFrame:
    return df.withColumn("text", S.render(F.col(column), True)).drop(column)


def index(spark, d, name: str, **options) -> I.Index:
    if name == "differential":
        return I.encode(*values(spark, d), strategies.config(name, **options))
    return I.encode(*texts(spark, d), strategies.config(name, **options))


# The original data, in SQL.
_TEXT = "r AS (SELECT text AS rt FROM benchmark ORDER BY item_id LIMIT 1), i AS (SELECT item_id AS input_id, text FROM benchmark WHERE item_id <> (SELECT min(item_id) FROM benchmark))"
_MATCH = (
    f"{_TEXT}, p AS (SELECT input_id, text, unnest(range(0, length(text))) AS pos FROM i), "
    "q AS (SELECT input_id, text, pos, unnest(range(1, length(text) - pos + 1)) AS l FROM p), "
    "b AS (SELECT input_id, text, pos, max(l) AS len FROM q, r WHERE contains(rt, substr(text, pos + 1, l)) GROUP BY ALL), "
    "m AS MATERIALIZED (SELECT p.input_id, p.pos, CASE WHEN len IS NOT NULL THEN CAST(instr(rt, substr(p.text, p.pos + 1, len)) - 1 AS BIGINT) END AS ptr, CAST(coalesce(len, 0) AS BIGINT) AS len "
    "FROM p LEFT JOIN b USING (input_id, pos), r)"
)
_CLASSIC = (
    f"{_MATCH}, n AS (SELECT input_id, count(*) AS n FROM m GROUP BY 1), "
    "c AS MATERIALIZED (SELECT m.input_id, pos, ptr, CASE WHEN len > 1 THEN least(len, n - pos - 1) ELSE 0 END AS cl FROM m JOIN n USING (input_id)), "
    "s(input_id, pos) AS (SELECT input_id, CAST(0 AS BIGINT) FROM n UNION ALL SELECT s.input_id, CAST(s.pos + c.cl + 1 AS BIGINT) FROM s JOIN c ON s.input_id = c.input_id AND s.pos = c.pos JOIN n ON n.input_id = s.input_id WHERE s.pos + c.cl + 1 < n.n), "
    "e AS (SELECT input_id, pos AS start, CASE WHEN cl > 0 THEN ptr ELSE pos END AS target, cl AS copy_len FROM s JOIN c USING (input_id, pos))"
)
_VALUES = "v AS (SELECT user_id AS input_id, list(CAST(round(value * 100) AS BIGINT) ORDER BY ts, event_id) AS symbols FROM events WHERE user_id <> (SELECT min(user_id) FROM events) GROUP BY 1)"
_ORDERS = "o AS (SELECT l_orderkey AS input_id, list(CAST(l_quantity AS BIGINT) ORDER BY l_linenumber, CAST(l_quantity AS BIGINT)) AS symbols FROM lineitem GROUP BY 1)"
_BITS = "b AS (SELECT CAST(0 AS BIGINT) AS vec_id, CAST(event_id AS BIGINT) AS pos, CAST(event_type = 'purchase' AS INTEGER) AS bit FROM events)"
_LENS = "l AS (SELECT CAST(0 AS BIGINT) AS vec_id, doc_id AS idx, n_chars % 16 AS len FROM documents)"
_AUTOMATIC = f"WITH RECURSIVE {_MATCH}, {folds.adaptive(4, 14, 16, 2)}"
_SPACE = "SELECT count(*) AS n, count(*) FILTER (is_block) AS b, sum(lit_len) AS l FROM f"
_DIFFERENCES = f"{_VALUES.replace('v AS', 'a AS')}, z AS (SELECT list(CAST(round(value * 100) AS BIGINT) ORDER BY ts, event_id) AS symbols FROM events WHERE user_id = (SELECT min(user_id) FROM events)), {folds.DIFFERENCES}"
_DIFFERENTIAL = f"WITH RECURSIVE {_DIFFERENCES}, {folds.differential()}"
_ORIGINAL = f"WITH {_TEXT} SELECT input_id, text FROM i"


# Matching.
@query(f"WITH {_MATCH} SELECT input_id, pos, ptr, len FROM m")
def match_stats_text(spark, d):
    return M.matches_long(M.matches_wide(texts(spark, d)[0], M.reference_symbols(texts(spark, d)[1])))


@query(f"WITH {_MATCH} SELECT input_id, pos, ptr, len FROM m WHERE len >= 8")
def match_stats_min_len(spark, d):
    return match_stats_text(spark, d).filter("len >= 8")


@query(f"WITH {_MATCH} SELECT input_id, pos, ptr, len FROM m WHERE len >= 4")
def match_stats_seeds(spark, d):
    return M.matches_by_seeds(*texts(spark, d), 4)


@query(f"""WITH {_TEXT}, a AS (SELECT input_id, text, unnest(range(0, length(text) - 7)) AS s FROM i), z AS (SELECT rt, unnest(range(0, length(rt) - 7)) AS p FROM r),
h AS (SELECT input_id, text, rt, s, p FROM a JOIN z ON substr(text, s + 1, 8) = substr(rt, p + 1, 8) WHERE s = 0 OR p = 0 OR substr(text, s, 1) <> substr(rt, p, 1))
SELECT input_id, s AS start, p AS ptr, CAST(list_max(list_filter(range(8, least(length(text) - s, length(rt) - p) + 1), lambda l: substr(text, s + 1, l) = substr(rt, p + 1, l))) AS BIGINT) AS len FROM h""")
def maximal_exact_matches(spark, d):
    return M.maximal_matches(*texts(spark, d), 8)


@query(f"WITH {_DIFFERENCES} SELECT input_id, pos, ptr, len FROM m")
def diff_match_stats(spark, d):
    inputs, ref = (x.withColumn("symbols", S.difference(F.col("symbols"))) for x in values(spark, d))
    return M.matches_long(M.matches_wide(inputs, M.reference_symbols(ref)))


# Parsing.
@query(f"""WITH RECURSIVE {_CLASSIC}, n2 AS (SELECT input_id, start, copy_len, target FROM e),
x AS (SELECT input_id, 'C' AS kind, start AS pos, target AS ptr, copy_len AS len FROM n2 WHERE copy_len > 0 UNION ALL SELECT input_id, 'L', start + copy_len, NULL, 1 FROM n2)
SELECT input_id, row_number() OVER (PARTITION BY input_id ORDER BY pos) - 1 AS ord, kind, pos, ptr, CAST(len AS BIGINT) AS len FROM x""")
def parse_classic(spark, d):
    inputs, ref = texts(spark, d)
    return I.events_of(M.matches_wide(inputs, M.reference_symbols(ref)), "classic")


@query(f"WITH RECURSIVE {_MATCH}, {folds.threshold()} {folds.EVENTS}")
def parse_threshold(spark, d):
    inputs, ref = texts(spark, d)
    return I.events_of(M.matches_wide(inputs, M.reference_symbols(ref)), "threshold")


@query(f"WITH RECURSIVE {_MATCH}, {folds.adaptive(8, 30, 15, 1)} {folds.EVENTS}")
def parse_adaptive(spark, d):
    inputs, ref = texts(spark, d)
    return I.events_of(M.matches_wide(inputs, M.reference_symbols(ref)), "adaptive", **strategies.parametric())


@query(f"{_AUTOMATIC} {folds.EVENTS}")
def parse_adaptive_auto(spark, d):
    inputs, ref = texts(spark, d)
    return I.events_of(M.matches_wide(inputs, M.reference_symbols(ref)), "adaptive", **strategies.automatic())


# Phrases.
@query(f"WITH RECURSIVE {_CLASSIC} SELECT input_id, row_number() OVER (PARTITION BY input_id ORDER BY start) - 1 AS subphrase, start, copy_len, CAST(1 AS BIGINT) AS lit_len, target, target - start AS delta FROM e")
def phrases_classic(spark, d):
    return index(spark, d, "classic").phrases.select("input_id", "subphrase", "start", "copy_len", "lit_len", "target", "delta")


@query(f"{_AUTOMATIC}, {folds.phrases()} SELECT {folds.PHRASES} FROM f")
def phrases_adaptive(spark, d):
    return index(spark, d, "automatic").phrases.drop("lits")


@query(f"{_DIFFERENTIAL}, {folds.difference_phrases()} SELECT {folds.PHRASES} FROM f")
def phrases_differential(spark, d):
    return index(spark, d, "differential").phrases.drop("lits")


@query(f"{_AUTOMATIC}, {folds.phrases(3)} SELECT input_id, subphrase, start, copy_len, lit_len, lit_offset FROM f")
def literal_split(spark, d):
    c = strategies.config("automatic")
    return I.encode(*texts(spark, d), I.IndexConfig(**{**c.__dict__, "literal_bits": 2})).phrases.select("input_id", "subphrase", "start", "copy_len", "lit_len", "lit_offset")


@query(f"{_DIFFERENTIAL}, {folds.difference_phrases(limit=16)} SELECT input_id, phrase, CAST(sum(copy_len + lit_len) AS BIGINT) AS length FROM f GROUP BY 1, 2")
def phrase_limit_split(spark, d):
    return index(spark, d, "differential", limit=16).phrases.groupBy("input_id", "phrase").agg(F.sum(F.col("copy_len") + F.col("lit_len")).alias("length"))


@query(f"{_AUTOMATIC}, {folds.phrases()} SELECT input_id, subphrase, phrase, block_ptr + diff AS pointer FROM f")
def block_pointers(spark, d):
    return index(spark, d, "automatic").pointers()


def positions(inputs: DataFrame) -> DataFrame:
    """input_id, pos: every position."""
    return inputs.filter(F.size("symbols") > 0).select("input_id", F.explode(F.sequence(F.lit(0).cast("long"), F.size("symbols").cast("long") - 1)).alias("pos"))


# Queries on an index.
@query(f"WITH {_TEXT} SELECT input_id, CAST(length(text) AS BIGINT) AS n FROM i")
def index_size(spark, d):
    return index(spark, d, "threshold").size()


@query(f"WITH RECURSIVE {_CLASSIC}, k AS (SELECT input_id, start, copy_len, row_number() OVER (PARTITION BY input_id ORDER BY start) - 1 AS subphrase FROM e) SELECT input_id, unnest(range(start, start + copy_len + 1)) AS pos, subphrase, start FROM k")
def locate_position(spark, d):
    return index(spark, d, "classic").locate(positions(texts(spark, d)[0])).select("input_id", "pos", "subphrase", "start")


@query(f"WITH RECURSIVE {_CLASSIC} SELECT input_id, count(*) AS subphrases FROM e GROUP BY 1")
def phrase_count(spark, d):
    return index(spark, d, "classic").counts().select("input_id", "subphrases")


@query(f"WITH {_TEXT}, p AS (SELECT input_id, text, unnest(range(0, length(text))) AS pos FROM i) SELECT input_id, pos, CAST(ascii(substr(text, pos + 1, 1)) AS BIGINT) AS sym FROM p")
def symbol_at(spark, d):
    inputs, _ = texts(spark, d)
    at = inputs.filter(F.size("symbols") > 0).select("input_id", F.explode(F.sequence(F.lit(0), F.size("symbols") - 1)).alias("pos")).withColumn("pos", F.col("pos").cast("long"))
    return index(spark, d, "automatic").symbol_at(at)


_RANGES = "x AS (SELECT input_id, text, unnest(range(0, 10)) AS range_id FROM i), y AS (SELECT input_id, text, range_id, range_id * length(text) // 12 AS b, range_id * length(text) // 12 + 5 * range_id + 1 AS e FROM x)"


def ranges(inputs: DataFrame) -> DataFrame:
    rows = inputs.select("input_id", F.size("symbols").cast("long").alias("n"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("range_id")).withColumn("range_id", F.col("range_id").cast("long"))
    begin = F.floor(F.col("range_id") * F.col("n") / 12)
    return rows.select("input_id", "range_id", begin.alias("begin"), (begin + 5 * F.col("range_id") + 1).alias("end"))


@query(f"WITH {_TEXT}, {_RANGES} SELECT input_id, range_id, substr(text, b + 1, e - b) AS text FROM y")
def extract_range(spark, d):
    return as_text(index(spark, d, "automatic").extract(ranges(texts(spark, d)[0])))


@query(f"WITH RECURSIVE {_CLASSIC} SELECT input_id, row_number() OVER (PARTITION BY input_id ORDER BY start) - 1 AS range_id, substr(text, start + 1, copy_len) AS text FROM e JOIN i USING (input_id) QUALIFY copy_len > 0")
def extract_fast_path(spark, d):
    i = index(spark, d, "classic")
    spans = i.phrases.select("input_id", F.col("subphrase").alias("range_id"), F.col("start").alias("begin"), (F.col("start") + F.col("copy_len")).alias("end"))
    return as_text(i.extract_fast(spans))


@query(_ORIGINAL)
def decode_classic(spark, d):
    return as_text(index(spark, d, "classic").decode())


@query(_ORIGINAL)
def decode_threshold(spark, d):
    return as_text(index(spark, d, "threshold").decode())


@query(_ORIGINAL)
def decode_automatic(spark, d):
    return as_text(index(spark, d, "automatic").decode())


@query(_ORIGINAL)
def decode_parametric(spark, d):
    return as_text(index(spark, d, "parametric").decode())


@query(f"WITH {_VALUES} SELECT input_id, array_to_string(symbols, ' ') AS text FROM v")
def decode_differential(spark, d):
    return index(spark, d, "differential").decode().select("input_id", S.render(F.col("symbols"), False).alias("text"))


@query(f"WITH {_VALUES} SELECT input_id, unnest(range(0, len(symbols))) AS pos, unnest(symbols) AS sym FROM v")
def lcp_value_at(spark, d):
    return index(spark, d, "differential").symbol_at(positions(values(spark, d)[0]))


@query(f"WITH {_VALUES}, k AS (SELECT *, unnest(range(0, (len(symbols) + 6) // 7)) AS range_id FROM v) SELECT input_id, range_id, array_to_string(symbols[range_id * 7 + 1 : range_id * 7 + 11], ' ') AS text FROM k")
def lcp_range(spark, d):
    rows = values(spark, d)[0].filter(F.size("symbols") > 0)
    r = rows.select("input_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.size("symbols") - 1) / 7))).alias("range_id"))
    r = r.select("input_id", "range_id", (F.col("range_id") * 7).alias("begin"), (F.col("range_id") * 7 + 11).alias("end"))
    return index(spark, d, "differential").extract(r).select("input_id", "range_id", S.render(F.col("symbols"), False).alias("text"))


@query(f"{_DIFFERENTIAL}, {folds.difference_phrases()} SELECT input_id, subphrase, unnest(range(start, start + lit_len + copy_len)) AS pos FROM f")
def lcp_phrase_id(spark, d):
    return index(spark, d, "differential").phrase_id(positions(values(spark, d)[0]))


@query(f"""{_DIFFERENTIAL}, {folds.difference_phrases()}, k AS (SELECT f.*, symbols, start + lit_len + copy_len AS stop FROM f JOIN a USING (input_id))
SELECT input_id, subphrase, unnest(range(start, stop)) AS pos, start AS begin, stop AS end, array_to_string(symbols[start + 1 : stop], ' ') AS text FROM k""")
def lcp_iterator_position(spark, d):
    return index(spark, d, "differential").around(positions(values(spark, d)[0])).withColumn("text", S.render(F.col("symbols"), False)).drop("symbols")


@query(f"""{_DIFFERENTIAL}, {folds.difference_phrases()}, k AS (SELECT f.*, symbols, start + lit_len + copy_len AS stop, unnest(range(start, start + lit_len + copy_len)) AS pos FROM f JOIN a USING (input_id))
SELECT input_id, pos, CAST(3 AS BIGINT) AS step, pos + 3 AS target, CASE WHEN pos + 3 < stop THEN symbols[pos + 4] END AS sym FROM k""")
def lcp_iterator_advance(spark, d):
    return index(spark, d, "differential").advance(positions(values(spark, d)[0]).withColumn("step", F.lit(3).cast("long")))


@query(f"{_DIFFERENTIAL}, {folds.difference_phrases()} SELECT input_id, subphrase, start, target - start AS \"offset\", copy_len + lit_len AS length, lit_len, copy_len, target FROM f")
def lcp_walk_parsing(spark, d):
    return index(spark, d, "differential").walk()


@query(f"{_DIFFERENTIAL}, {folds.difference_phrases()} SELECT input_id, count(*) AS subphrases, count(*) FILTER (is_block) AS phrases, max(start + copy_len + lit_len) AS n FROM f GROUP BY 1")
def lcp_phrases_and_size(spark, d):
    i = index(spark, d, "differential")
    return i.counts().join(i.size(), "input_id")


@query(f"{_AUTOMATIC}, {folds.phrases()} SELECT input_id, count(*) AS subphrases, count(*) FILTER (is_block) AS phrases FROM f GROUP BY 1")
def phrases_and_blocks(spark, d):
    return index(spark, d, "automatic").counts()


@query(f"{_AUTOMATIC}, {folds.phrases()} SELECT input_id, subphrase, start FROM f UNION ALL SELECT input_id, count(*), max(start + copy_len + lit_len) FROM f GROUP BY 1")
def start_subphrase(spark, d):
    i = index(spark, d, "automatic")
    asked = i.counts().select("input_id", F.explode(F.sequence(F.lit(0).cast("long"), "subphrases")).alias("subphrase"))
    return i.start_subphrase(asked)


@query(f"{_AUTOMATIC}, {folds.phrases()} SELECT input_id, subphrase, start, block_ptr + diff AS pointer, copy_len + lit_len AS length FROM f WHERE subphrase >= 2")
def parse_from_subphrase(spark, d):
    return index(spark, d, "automatic").from_subphrase(2)


@query(f"{_AUTOMATIC}, {folds.phrases()}, lk AS (SELECT f.*, text, unnest(range(0, lit_len)) AS j FROM f JOIN i USING (input_id)) SELECT input_id, subphrase, lit_offset + j AS lit_pos, CAST(ascii(substr(text, start + copy_len + j + 1, 1)) AS BIGINT) AS sym FROM lk")
def literal_access(spark, d):
    return index(spark, d, "automatic").literals()


@query(f"WITH {_TEXT} SELECT input_id, unnest(range(0, (length(text) + 1023) // 1024)) AS chunk, substr(text, unnest(range(0, (length(text) + 1023) // 1024)) * 1024 + 1, 1024) AS text FROM i")
def decompress_chunks(spark, d):
    return as_text(index(spark, d, "automatic").decode_chunks())


@query(f"WITH {_TEXT} SELECT input_id, true AS same, CAST(NULL AS BIGINT) AS first_mismatch FROM i")
def decode_check(spark, d):
    inputs, ref = texts(spark, d)
    return I.encode(inputs, ref, strategies.config("automatic")).check(inputs)


@query(f"WITH {_TEXT} SELECT input_id, length(text) <= 20 AS same, CASE WHEN length(text) > 20 THEN CAST(20 AS BIGINT) END AS first_mismatch FROM i")
def first_mismatch(spark, d):
    inputs, ref = texts(spark, d)
    other = inputs.withColumn("symbols", F.transform("symbols", lambda x, k: F.when(k == 20, x + 1).otherwise(x)))
    return I.encode(inputs, ref, strategies.config("automatic")).check(other)


@query(f"WITH RECURSIVE {_CLASSIC} SELECT input_id, row_number() OVER (PARTITION BY input_id ORDER BY start) - 1 AS subphrase, start, target - start AS \"offset\", copy_len + 1 AS length, CAST(1 AS BIGINT) AS lit_len, copy_len, target FROM e")
def walk_parsing(spark, d):
    return index(spark, d, "classic").walk()


@query(_ORIGINAL)
def store_load_roundtrip(spark, d):
    inputs, ref = texts(spark, d)
    path = new_folder(spark)
    I.encode(inputs, ref, strategies.config("parametric")).save(path)
    return as_text(I.Index.load(spark, path, ref, "text").decode())


@query(f"{_AUTOMATIC}, {folds.phrases()} SELECT input_id, count(*) AS subphrases, count(*) FILTER (is_block) AS phrases, max(start + copy_len + lit_len) AS n FROM f GROUP BY 1")
def load_without_reference(spark, d):
    path = new_folder(spark)
    index(spark, d, "automatic").save(path)
    i = I.Index.load(spark, path)
    return i.counts().join(i.size(), "input_id")


@query(_ORIGINAL)
def build_by_seeds(spark, d):
    """The index of matches from the seed join, as for references beyond the automaton, the reference in chunks."""
    inputs, ref = texts(spark, d)
    chunks = M.chunked(ref)
    return as_text(I.encode(inputs, chunks, strategies.config("automatic"), M.matches_by_seeds(inputs, chunks, 4)).decode())


@query(_ORIGINAL)
def build_with_rules(spark, d):
    """Phrases cut at every tenth position by one rule, and blocks begun behind long literals by another."""
    inputs, ref = texts(spark, d)
    tenth = lambda source, target, copy, lit: (min(copy, 10 - source % 10), min(lit, 10))
    return as_text(I.encode(inputs, ref, strategies.config("automatic"), rules=(tenth,), splits=(lambda pointer, p: p.lit_len > 8,)).decode())


@query(f"WITH {_TEXT} SELECT 'f' || lpad(CAST(row_number() OVER (ORDER BY input_id) - 1 AS VARCHAR), 6, '0') AS file, text FROM i")
def build_from_files(spark, d):
    """Inputs and reference written as files, read again, encoded and decoded."""
    inputs, ref = texts(spark, d)
    folder = new_folder(spark)
    named = inputs.withColumn("file", F.concat(F.lit("f"), F.lpad((F.row_number().over(W.orderBy("input_id")) - 1).cast("string"), 6, "0")))  # a row per item
    as_text(named.select("file", "symbols")).repartition("file").write.partitionBy("file").option("lineSep", "\u0001").text(f"{folder}/inputs")
    as_text(ref).coalesce(1).write.option("lineSep", "\u0001").text(f"{folder}/reference")
    read = files.read_inputs(spark, f"{folder}/inputs/*/*.txt").withColumn("symbols", F.expr("filter(symbols, x -> x <> 1)"))
    source = files.read_reference(spark, f"{folder}/reference/*.txt").withColumn("symbols", F.expr("filter(symbols, x -> x <> 1)"))
    out = as_text(I.encode(read, source, strategies.config("threshold")).decode()).join(read.select("input_id", F.regexp_extract("path", "file=(f[0-9]+)", 1).alias("file")), "input_id")
    return out.select("file", "text")


@query(_ORIGINAL)
def reuse_matches(spark, d):
    inputs, ref = texts(spark, d)
    found = M.matches_wide(inputs, M.reference_symbols(ref))
    return as_text(I.encode(inputs, ref, strategies.config("threshold"), found).decode())


@query(f"{_AUTOMATIC}, {folds.phrases()}, {folds.STATISTICS}")
def parse_stats(spark, d):
    return I.statistics(index(spark, d, "automatic"))


@query(f"""WITH RECURSIVE {_CLASSIC}, t AS (SELECT count(*) AS n, sum(CASE WHEN f THEN 1 ELSE 0 END) AS b FROM (SELECT row_number() OVER w = 1 OR copy_len > 0 AND target - start <> coalesce(last_value(CASE WHEN copy_len > 0 THEN target - start END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS f FROM e WINDOW w AS (PARTITION BY input_id ORDER BY start)))
SELECT u.component, CAST(u.bits AS BIGINT) AS bits FROM t, LATERAL (VALUES ('boundaries', n * 2), ('differences', 0), ('literal_lengths', n * 8), ('literals', n * 32), ('pointers', b * 32), ('total', n * 42 + b * 32)) u(component, bits)""")
def space_breakdown(spark, d):
    return I.space(index(spark, d, "classic"))


@query(f"""{_AUTOMATIC}, {folds.phrases()}, c AS ({_SPACE}) SELECT '{{"name":"index","bits":' || CAST(n * 14 + b * 28 + l * 32 AS BIGINT) || ',"children":[{{"component":"boundaries","bits":' || n * 2 || '}},{{"component":"differences","bits":' || (n - b) * 4
|| '}},{{"component":"literal_lengths","bits":' || n * 8 || '}},{{"component":"literals","bits":' || CAST(l * 32 AS BIGINT) || '}},{{"component":"pointers","bits":' || b * 32 || '}}]}}' AS json FROM c""")
def space_tree(spark, d):
    return I.size_tree(index(spark, d, "automatic"))


@query(f"""{_AUTOMATIC}, {folds.phrases()}, c AS ({_SPACE}) SELECT '<ul><li>index: ' || CAST(n * 14 + b * 28 + l * 32 AS BIGINT) || ' bits<ul><li>boundaries: ' || n * 2 || ' bits</li><li>differences: ' || (n - b) * 4
|| ' bits</li><li>literal_lengths: ' || n * 8 || ' bits</li><li>literals: ' || CAST(l * 32 AS BIGINT) || ' bits</li><li>pointers: ' || b * 32 || ' bits</li></ul></li></ul>' AS html FROM c""")
def space_page(spark, d):
    return I.size_page(index(spark, d, "automatic"))


# Bits and sums.
@query(f"WITH {_BITS} SELECT vec_id, pos, bit, CAST(coalesce(sum(bit) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rank1, CAST(pos - coalesce(sum(bit) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS rank0 FROM b")
def rank1(spark, d):
    return B.rank1(purchases(spark, d))


@query(f"WITH {_BITS} SELECT vec_id, row_number() OVER (ORDER BY pos) AS k, pos FROM b WHERE bit = 1")
def select1(spark, d):
    return B.select1(purchases(spark, d))


@query(f"WITH {_BITS}, s AS (SELECT vec_id, row_number() OVER (ORDER BY pos) AS k, pos FROM b WHERE bit = 1) SELECT * FROM s WHERE k >= 100")
def ones_from_k(spark, d):
    return B.ones_from(purchases(spark, d), 100)


@query(f"WITH {_BITS} SELECT vec_id, pos // 32 AS word, CAST(sum(bit * (1::BIGINT << CAST(pos % 32 AS INTEGER))) AS BIGINT) AS value FROM b GROUP BY ALL")
def chunked_bits(spark, d):
    return B.words(purchases(spark, d))


@query(f"WITH {_BITS} SELECT a.vec_id, a.pos, CAST(12 AS BIGINT) AS len, CAST(sum(b.bit * (1::BIGINT << CAST(b.pos - a.pos AS INTEGER))) AS BIGINT) AS value FROM b a JOIN b ON b.pos >= a.pos AND b.pos < a.pos + 12 GROUP BY ALL")
def word_read(spark, d):
    p = purchases(spark, d)
    return B.word_read(B.words(p), p.select("vec_id", "pos", F.lit(12).cast("long").alias("len")))


@query(f"WITH {_BITS} SELECT vec_id, pos, bit FROM b")
def bits_from_positions(spark, d):
    p = purchases(spark, d)
    return B.from_positions(p.filter("bit = 1"), p.groupBy("vec_id").agg((F.max("pos") + 1).alias("n")))


@query(f"WITH {_LENS} SELECT vec_id, idx, len, CAST(sum(len) OVER (ORDER BY idx) AS BIGINT) AS total FROM l")
def prefix_sum(spark, d):
    return B.prefix_sum(lengths(spark, d), "vec_id", "idx", "len", "total")


@query(f"WITH {_LENS} SELECT vec_id, idx, CAST(row_number() OVER (ORDER BY idx) AS BIGINT) AS total FROM l")
def prefix_trivial(spark, d):
    return B.prefix_sum(lengths(spark, d).withColumn("one", F.lit(1)), "vec_id", "idx", "one", "total").select("vec_id", "idx", "total")


@query("SELECT range AS byte, CAST((range & 3) + ((range >> 2) & 3) + ((range >> 4) & 3) + ((range >> 6) & 3) AS BIGINT) AS total FROM range(256)")
def byte_sum_table(spark, d):
    return B.byte_sums(spark, 2)


# Symbols.
@query(f"WITH {_ORDERS} SELECT input_id, array_to_string(list_transform(range(1, len(symbols) + 1), lambda i: symbols[i] - coalesce(symbols[i - 1], 0)), ' ') AS d FROM o")
def first_difference(spark, d):
    return orders(spark, d).select("input_id", S.render(S.difference(F.col("symbols")), False).alias("d"))


@query("SELECT l_orderkey, l_linenumber, q - coalesce(lag(q) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, q), 0) AS d FROM (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(l_quantity AS BIGINT) AS q FROM lineitem)")
def first_difference_rows(spark, d):
    rows = read(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.col("l_quantity").cast("long").alias("q"))
    return rows.select("l_orderkey", "l_linenumber", S.difference_rows("l_orderkey", ["l_linenumber", "q"], "q").alias("d"))


@query(f"WITH {_ORDERS} SELECT input_id, array_to_string(symbols, ' ') AS x FROM o")
def undo_difference(spark, d):
    return orders(spark, d).select("input_id", S.render(S.undo_difference(S.difference(F.col("symbols"))), False).alias("x"))


@query("SELECT event_id, CASE WHEN u >= 32768 THEN u - 65536 ELSE u END AS v FROM (SELECT event_id, ((CAST(round(value * 1000) AS BIGINT) % 65536) + 65536) % 65536 AS u FROM events)")
def int_truncate_signed(spark, d):
    return read(spark, d, "events").select("event_id", S.to_signed(F.round(F.col("value") * 1000).cast("long"), 16).alias("v"))


@query("SELECT s AS source, t AS target, t AS recovered FROM (SELECT unnest(range(0, 49152, 997)) AS s), (SELECT unnest(range(0, 49152, 1009)) AS t)")
def target_reinterpret(spark, d):
    s, t = spark.range(0, 49152, 997).toDF("source"), spark.range(0, 49152, 1009).toDF("target")
    rows = s.crossJoin(F.broadcast(t))  # 50 rows each
    return rows.withColumn("recovered", S.retarget(F.col("source"), S.to_signed(F.col("target") - F.col("source"), 16), F.lit(49152), 16))


_DNA = "n AS (SELECT item_id, regexp_replace(translate(upper(regexp_replace(text, '[^a-zA-Z]', 'N', 'g')), 'BDEFHIJKLMOPQRSUVWXYZ', 'ACGTACGTACGTACGTACGTA'), '[^ACGTN]', 'N', 'g') AS s FROM benchmark)"


def dna(spark, d):
    t = F.translate(F.upper(F.regexp_replace("text", "[^a-zA-Z]", "N")), "BDEFHIJKLMOPQRSUVWXYZ", "ACGTACGTACGTACGTACGTA")
    return read(spark, d, "benchmark").select("item_id", F.regexp_replace(t, "[^ACGTN]", "N").alias("s"))


@query(f"""WITH {_DNA}, c AS (SELECT item_id, unnest(range(0, length(s))) AS k, unnest(list_transform(range(1, length(s) + 1), lambda j: CAST(translate(substr(s, j, 1), 'ACGTN', '01320') AS BIGINT))) AS code FROM n)
SELECT item_id, k // 16 AS word, CAST(sum(code * (1::BIGINT << CAST(k % 16 * 2 AS INTEGER))) AS BIGINT) AS value FROM c GROUP BY 1, 2""")
def dna_pack(spark, d):
    return dna(spark, d).select("item_id", F.posexplode(S.pack(S.dna_codes(F.col("s")), 2)).alias("word", "value")).withColumn("word", F.col("word").cast("long"))


@query(f"WITH {_DNA} SELECT item_id, translate(s, 'ACGTN', '01320') AS codes FROM n")
def dna_pack_unpack(spark, d):
    return dna(spark, d).select("item_id", F.array_join(F.transform(S.unpack(S.pack(S.dna_codes(F.col("s")), 2), 2, F.length("s")), lambda x: x.cast("string")), "").alias("codes"))


@query(f"WITH {_DNA} SELECT item_id, s FROM n")
def dna_unpack(spark, d):
    return dna(spark, d).select("item_id", S.dna_letters(S.dna_codes(F.col("s")), S.n_positions(F.col("s"))).alias("s"))


@query(f"WITH {_DNA} SELECT item_id, array_to_string(list_filter(range(0, length(s)), lambda i: substr(s, i + 1, 1) = 'N'), ' ') AS at FROM n")
def n_positions(spark, d):
    return dna(spark, d).select("item_id", S.render(S.n_positions(F.col("s")), False).alias("at"))


@query(f"WITH {_ORDERS} SELECT input_id, array_to_string(list_transform(symbols, lambda x: x % 16), ' ') AS x FROM o")
def fractional_pack(spark, d):
    return orders(spark, d).select("input_id", S.render(S.unpack(S.pack(F.col("symbols"), 4), 4, F.size("symbols")), False).alias("x"))


@query(f"WITH {_ORDERS} SELECT input_id, array_to_string(list_transform(symbols, lambda x: CASE WHEN x >= 5 AND x < 30 THEN x ELSE 30 END), ' ') AS small, CAST(len(list_filter(symbols, lambda x: x < 5 OR x >= 30)) AS BIGINT) AS escaped FROM o")
def escape_pack(spark, d):
    p = S.escape_pack(F.col("symbols"), 5, 30)
    return orders(spark, d).select("input_id", S.render(p["small"], False).alias("small"), F.size(p["exceptions"]).cast("long").alias("escaped"))


@query(f"WITH {_ORDERS} SELECT input_id, array_to_string(symbols, ' ') AS x FROM o")
def escape_unpack(spark, d):
    return orders(spark, d).select("input_id", S.render(S.escape_unpack(S.escape_pack(F.col("symbols"), 0, 255 % 40), 255 % 40), False).alias("x"))


@query("SELECT CAST(min(l_quantity) AS BIGINT) AS least, CAST(max(l_quantity) AS BIGINT) AS most FROM lineitem")
def alphabet_range(spark, d):
    return read(spark, d, "lineitem").agg(F.min("l_quantity").cast("long").alias("least"), F.max("l_quantity").cast("long").alias("most"))


@query("SELECT event_id, v, CASE WHEN min(v) OVER () < 1 THEN v + 1 - min(v) OVER () ELSE v END AS shifted FROM (SELECT event_id, CAST(round(value * 100) AS BIGINT) - 50 AS v FROM events)")
def alphabet_shift(spark, d):
    return S.shifted_alphabet(read(spark, d, "events").select("event_id", (F.round(F.col("value") * 100).cast("long") - 50).alias("v")), "v")


@query(f"WITH {_TEXT}, s AS (SELECT input_id, list_transform(range(1, length(text) + 1), lambda k: CAST(ascii(substr(text, k, 1)) AS INTEGER)) AS x FROM i), p AS (SELECT input_id, unnest(range(0, len(x))) AS pos, x FROM s) SELECT input_id, row_number() OVER (PARTITION BY input_id ORDER BY x[pos + 1 :]) - 1 AS rank, pos FROM p")
def suffix_array_small(spark, d):
    return suffixes.suffix_array(texts(spark, d)[0], 1024)


@query(f"""WITH {_TEXT}, s AS (SELECT input_id, list_transform(range(1, length(text) + 1), lambda k: CAST(ascii(substr(text, k, 1)) AS INTEGER)) AS x FROM i), p AS (SELECT input_id, unnest(range(0, len(x))) AS pos, x FROM s),
a AS (SELECT input_id, row_number() OVER w - 1 AS rank, x[pos + 1 :] AS y, lag(x[pos + 1 :]) OVER w AS z FROM p WINDOW w AS (PARTITION BY input_id ORDER BY x[pos + 1 :]))
SELECT input_id, rank, CASE WHEN z IS NULL THEN 0 ELSE CAST(coalesce(list_min(list_filter(range(0, least(len(y), len(z))), lambda k: y[k + 1] <> z[k + 1])), least(len(y), len(z))) AS BIGINT) END AS lcp FROM a""")
def lcp_array_small(spark, d):
    return suffixes.lcp_array(texts(spark, d)[0], 1024)


@query(f"WITH {_TEXT} SELECT input_id, text AS shown FROM i")
def render_symbols(spark, d):
    return texts(spark, d)[0].select("input_id", S.render(F.col("symbols"), True).alias("shown"))


@query(f"WITH {_TEXT}, s AS (SELECT input_id, list_transform(range(1, length(text) + 1), lambda k: CAST(ascii(substr(text, k, 1)) AS INTEGER)) AS x FROM i), p AS (SELECT input_id, unnest(range(0, len(x))) AS pos, x FROM s) SELECT input_id, row_number() OVER (PARTITION BY input_id ORDER BY x[pos + 1 :]) - 1 AS rank, CASE WHEN pos > 0 THEN CAST(x[pos] AS BIGINT) END AS sym FROM p")
def bwt_small(spark, d):
    return suffixes.bwt(texts(spark, d)[0], 1024)


@query("SELECT event_id, v, v AS again FROM (SELECT event_id, CAST(round(value * 100) AS BIGINT) - 50 AS v FROM events)")
def alphabet_unshift(spark, d):
    rows = read(spark, d, "events").select("event_id", (F.round(F.col("value") * 100).cast("long") - 50).alias("v"))
    least = rows.agg(F.min("v")).first()[0]
    shifted = S.shifted_alphabet(rows, "v").withColumnRenamed("v", "original")
    return S.unshifted_alphabet(shifted, "shifted", least).select("event_id", F.col("original").alias("v"), F.col("v").alias("again"))


@query("SELECT l_orderkey, l_linenumber, t - e > -17 AND t - e < 16 AS relative FROM (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_linenumber * 10 AS e, CAST(l_quantity AS BIGINT) AS t FROM lineitem)")
def is_relative(spark, d):
    rows = read(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.col("l_quantity").cast("long").alias("t"))
    return rows.select("l_orderkey", "l_linenumber", S.is_relative(F.col("l_linenumber") * 10, F.col("t"), 4).alias("relative"))
