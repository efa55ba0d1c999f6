"""SQL of the folds over matches: parses and the phrases they are stored as, by recursion from step to step.

A step (b, s, p, size) of an input is a literal of the positions from b to s and a copy of `size` symbols at s that reads at
p; at the end s is the input's length n and size 0. Each text below is a list of WITH members, after those that give the
matches m (input_id, pos, ptr, len).
"""

from __future__ import annotations

LISTS = "g AS MATERIALIZED (SELECT input_id, CAST(count(*) AS BIGINT) AS n, list(ptr ORDER BY pos) AS ptr, list(len ORDER BY pos) AS len FROM m GROUP BY 1)"
#: Events of steps.
EVENTS = (
    "SELECT input_id, row_number() OVER (PARTITION BY input_id ORDER BY pos) - 1 AS ord, kind, pos, ptr, len FROM "
    "(SELECT input_id, 'L' AS kind, b AS pos, CAST(NULL AS BIGINT) AS ptr, s - b AS len FROM t WHERE s > b UNION ALL SELECT input_id, 'C', s, p, size FROM t WHERE size > 0)"
)


def threshold(reach: int = 30, least: int = 15) -> str:
    """t: steps of the threshold parser."""
    first = f"list_filter(range(nb, least(n, nb + {reach} + 1)), lambda s: g.len[s + 1] > 0 AND abs(g.ptr[s + 1] - target) < {reach})[1]"
    return (
        f"{LISTS}, x AS (SELECT input_id, list(c ORDER BY pos) AS nxt FROM (SELECT input_id, pos, min(CASE WHEN len >= {least} THEN pos END) OVER (PARTITION BY input_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS c FROM m) GROUP BY 1), "
        "w(input_id, b, s, p, size, nb, target) AS (SELECT input_id, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT), coalesce(ptr[1], 0) FROM g "
        "UNION ALL SELECT input_id, nb, s, ptr[s + 1], coalesce(len[s + 1], 0), s + coalesce(len[s + 1], 0), ptr[s + 1] + len[s + 1] FROM "
        f"(SELECT w.input_id, nb, n, ptr, len, CAST(coalesce({first}, nxt[nb + 1], n) AS BIGINT) AS s FROM w JOIN g ON w.input_id = g.input_id JOIN x ON x.input_id = g.input_id WHERE nb < n)), "
        "t AS MATERIALIZED (SELECT input_id, b, s, p, size FROM w WHERE b IS NOT NULL)"
    )


def adaptive(rel_bits: int, look_ahead: int, min_abs: int, min_rel: int) -> str:
    """t: steps of the adaptive parser."""
    high, low = 1 << rel_bits, -(1 << rel_bits) - 1

    def relative(i: str, ref: str) -> str:
        d = f"g.ptr[s + 1] - ({ref} + s - ({i}))"
        return f"list_filter(range({i}, least(n, {i} + {look_ahead} + 1)), lambda s: g.len[s + 1] >= {min_rel} AND {d} > {low} AND {d} < {high})"

    behind = relative("m.pos + m.len", "m.ptr + m.len")
    return (
        f"{LISTS}, k AS (SELECT m.input_id, m.pos, m.len > 0 AND (m.len >= {min_abs} OR m.pos + m.len < n AND len({behind}) > 0) AS ok FROM m JOIN g ON m.input_id = g.input_id), "
        "x AS (SELECT input_id, list(c ORDER BY pos) AS nxt FROM (SELECT input_id, pos, min(CASE WHEN ok THEN pos END) OVER (PARTITION BY input_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS c FROM k) GROUP BY 1), "
        "w(input_id, b, s, p, size, nb, ref) AS (SELECT input_id, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM g "
        "UNION ALL SELECT input_id, nb, s, ptr[s + 1], coalesce(len[s + 1], 0), s + coalesce(len[s + 1], 0), CASE WHEN near IS NULL THEN ptr[s + 1] + len[s + 1] ELSE ref + s - nb + len[s + 1] END FROM "
        "(SELECT *, CAST(coalesce(near, nxt[nb + 1], n) AS BIGINT) AS s FROM "
        f"(SELECT w.input_id, nb, ref, n, ptr, len, nxt, CASE WHEN b IS NOT NULL THEN {relative('nb', 'ref')}[1] END AS near FROM w JOIN g ON w.input_id = g.input_id JOIN x ON x.input_id = g.input_id WHERE nb < n))), "
        "t AS MATERIALIZED (SELECT input_id, b, s, p, size FROM w WHERE b IS NOT NULL)"
    )


def phrases(cap: int = 255, diff_bits: int = 4) -> str:
    """f: the phrase table of steps t, copies with the literals behind them."""
    low, high = -(1 << diff_bits - 1), (1 << diff_bits - 1) - 1
    return (
        "pa AS (SELECT input_id, s AS source, p AS target, size AS copy, coalesce(lead(s - b) OVER (PARTITION BY input_id ORDER BY s), 0) AS lit FROM t "
        "UNION ALL SELECT input_id, 0, 0, 0, s FROM t WHERE b = 0 AND s > 0), "
        f"pj AS (SELECT *, unnest(range(0, greatest(1, CAST(ceil(lit / {cap}) AS BIGINT)))) AS j FROM pa WHERE copy + lit > 0), "
        f"pi AS (SELECT input_id, CASE WHEN j = 0 THEN source ELSE source + copy + j * {cap} END AS start, CASE WHEN j = 0 THEN copy ELSE 0 END AS copy_len, least({cap}, lit - j * {cap}) AS lit_len, CASE WHEN j = 0 THEN target ELSE target + copy END AS target FROM pj), "
        "pk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY input_id ORDER BY start) - 1 AS subphrase, target - start AS delta, coalesce(sum(lit_len) OVER (PARTITION BY input_id ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lit_offset FROM pi), "
        "fo(input_id, subphrase, phrase, is_block, block_ptr) AS (SELECT input_id, subphrase, CAST(0 AS BIGINT), true, delta FROM pk WHERE subphrase = 0 UNION ALL "
        "SELECT input_id, subphrase, phrase + CAST(new AS BIGINT), new, CASE WHEN new THEN delta ELSE block_ptr END FROM "
        f"(SELECT pk.*, phrase, block_ptr, copy_len > 0 AND NOT delta - block_ptr BETWEEN {low} AND {high} AS new FROM fo JOIN pk ON pk.input_id = fo.input_id AND pk.subphrase = fo.subphrase + 1)), "
        "f AS MATERIALIZED (SELECT pk.input_id, pk.subphrase, phrase, start, copy_len, lit_len, target, delta, is_block, block_ptr, CASE WHEN copy_len > 0 THEN delta - block_ptr ELSE 0 END AS diff, CAST(lit_offset AS BIGINT) AS lit_offset "
        "FROM pk JOIN fo ON pk.input_id = fo.input_id AND pk.subphrase = fo.subphrase)"
    )


PHRASES = "input_id, subphrase, phrase, start, copy_len, lit_len, target, delta, is_block, block_ptr, diff, lit_offset"

STATISTICS = (
    "st(input_id, subphrase, last, moved, relative) AS (SELECT input_id, CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), false FROM (SELECT DISTINCT input_id FROM f) UNION ALL "
    "SELECT f.input_id, f.subphrase, CASE WHEN f.delta - last BETWEEN -8 AND 7 THEN last ELSE f.delta END, f.delta - last, f.delta - last BETWEEN -8 AND 7 FROM st JOIN f ON f.input_id = st.input_id AND f.subphrase = st.subphrase + 1), "
    "su AS (SELECT f.input_id, sum(copy_len + lit_len) AS length, count(*) FILTER (NOT relative) AS absolute, count(*) FILTER (relative) AS relative, count(*) AS total, sum(lit_len) AS literals, sum(abs(moved)) FILTER (relative) AS moved, "
    "sum(greatest(-moved, 0)) FILTER (relative) AS ins, sum(greatest(moved, 0)) FILTER (relative) AS dels, sum(CASE WHEN moved >= 0 THEN lit_len ELSE greatest(lit_len + moved, 0) END) FILTER (relative) AS subs "
    "FROM f JOIN st ON st.input_id = f.input_id AND st.subphrase = f.subphrase GROUP BY 1) "
    "SELECT input_id, CAST(length AS BIGINT) AS length, absolute, relative, total, CAST(literals AS BIGINT) AS literals, literals / total AS literals_per_phrase, moved / nullif(relative, 0) AS avg_difference, "
    "ins / nullif(relative, 0) AS avg_insertions, dels / nullif(relative, 0) AS avg_deletions, subs / nullif(relative, 0) AS avg_substitutions FROM su"
)

#: m: matches of first differences; a (input_id, symbols) are the inputs, z (symbols) the reference. o: both as lists.
DIFFERENCES = (
    "o AS MATERIALIZED (SELECT a.input_id, a.symbols AS own, z.symbols AS ref FROM a, z), "
    "da AS (SELECT input_id, symbols, unnest(range(0, len(symbols))) AS pos FROM a), db AS (SELECT input_id, pos, symbols[pos + 1] - coalesce(symbols[pos], 0) AS d FROM da), "
    "dc AS (SELECT symbols, unnest(range(0, len(symbols))) AS p FROM z), dd AS (SELECT p, symbols[p + 1] - coalesce(symbols[p], 0) AS d FROM dc), "
    "de AS (SELECT input_id, pos, p, pos - row_number() OVER (PARTITION BY input_id, p - pos ORDER BY pos) AS island FROM db JOIN dd USING (d)), "
    "df AS (SELECT input_id, pos, p, max(pos) OVER (PARTITION BY input_id, p - pos, island) - pos + 1 AS l FROM de), "
    "dm AS (SELECT input_id, pos, max(l) AS l, arg_min(p, -l * 1000000000 + p) AS p FROM df GROUP BY 1, 2), "
    "m AS MATERIALIZED (SELECT db.input_id, db.pos, dm.p AS ptr, coalesce(l, 0) AS len FROM db LEFT JOIN dm ON dm.input_id = db.input_id AND dm.pos = db.pos)"
)


def differential(rel_bits: int = 4, look_ahead: int = 8, min_abs: int = 4, min_rel: int = 1) -> str:
    """t: steps of the differential parser; copies may begin one symbol before a match of differences."""
    high, low = 1 << rel_bits, -(1 << rel_bits) - 1
    near = lambda p, at: f"({p}) - ({at}) > {low} AND ({p}) - ({at}) < {high}"
    stretched = "i.nl > 0 AND i.np > 0 AND own[i.pos + 1] = ref[i.np] AND i.nl >= CASE WHEN i.len > 0 AND own[i.pos + 1] = ref[i.ptr + 1] THEN i.len ELSE 0 END"

    def ahead(i: str, at: str, of: str = "") -> str:
        return f"list_filter(range({i} + 1, least(n, {i} + {look_ahead} + 2)), lambda s: {of}len[s + 1] >= {min_rel} AND {near(f'{of}ptr[s + 1]', f'{at} + s - ({i})')})"

    def follows(i: str, at: str) -> str:
        return f"({i} < n AND (h.es[{i} + 1] > {min_rel} AND {near(f'h.ep[{i} + 1]', at)} OR len({ahead(i, at, 'h.')}) > 0))"

    return (
        "ei AS (SELECT *, lead(ptr) OVER (PARTITION BY input_id ORDER BY pos) AS np, coalesce(lead(len) OVER (PARTITION BY input_id ORDER BY pos), 0) AS nl FROM m), "
        f"ej AS (SELECT i.input_id, i.pos, i.ptr, i.len, CASE WHEN {stretched} THEN i.np - 1 WHEN i.len > 0 AND own[i.pos + 1] = ref[i.ptr + 1] THEN i.ptr ELSE 0 END AS ep, "
        f"CASE WHEN {stretched} THEN i.nl + 1 WHEN i.len > 0 AND own[i.pos + 1] = ref[i.ptr + 1] THEN i.len ELSE 0 END AS es FROM ei i JOIN o USING (input_id)), "
        "h AS MATERIALIZED (SELECT input_id, CAST(count(*) AS BIGINT) AS n, list(ptr ORDER BY pos) AS ptr, list(len ORDER BY pos) AS len, list(ep ORDER BY pos) AS ep, list(es ORDER BY pos) AS es FROM ej GROUP BY 1), "
        f"ek AS (SELECT e.input_id, e.pos, e.len > 0 AND (e.len >= {min_abs} OR {follows('(e.pos + e.len)', '(e.ptr + e.len)')}) AS fp, e.es > 0 AND (e.es >= {min_abs} OR {follows('(e.pos + e.es)', '(e.ep + e.es)')}) AS fe FROM ej e JOIN h USING (input_id)), "
        "el AS (SELECT input_id, list(fe ORDER BY pos) AS fe, list(c ORDER BY pos) AS nxt FROM (SELECT *, min(CASE WHEN fp THEN pos END) OVER (PARTITION BY input_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS c FROM ek) GROUP BY 1), "
        "w(input_id, b, s, p, size, nb, ra) AS (SELECT input_id, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM h UNION ALL "
        "SELECT input_id, nb, s, p, size, s + size, CASE WHEN r IS NULL THEN p + size ELSE ra + s - nb + size END FROM "
        "(SELECT *, CASE WHEN s = n THEN 0 WHEN ext THEN ep[s + 1] ELSE ptr[s + 1] END AS p, CASE WHEN s = n THEN 0 WHEN ext THEN es[s + 1] ELSE len[s + 1] END AS size FROM "
        "(SELECT *, CAST(coalesce(r, CASE WHEN fe[nb + 1] THEN nb ELSE nxt[nb + 1] END, n) AS BIGINT) AS s, CASE WHEN r IS NULL THEN fe[nb + 1] ELSE rext END AS ext FROM "
        f"(SELECT *, CASE WHEN rext THEN nb WHEN b IS NOT NULL THEN {ahead('nb', 'ra')}[1] END AS r FROM "
        f"(SELECT w.input_id, b, nb, ra, h.n, h.ptr, h.len, h.ep, h.es, fe, nxt, b IS NOT NULL AND h.es[nb + 1] > {min_rel} AND {near('h.ep[nb + 1]', 'ra')} AS rext FROM w JOIN h ON h.input_id = w.input_id JOIN el ON el.input_id = w.input_id WHERE nb < h.n))))), "
        "t AS MATERIALIZED (SELECT input_id, b, s, p, size FROM w WHERE b IS NOT NULL)"
    )


def difference_phrases(cap: int = 3, limit: int = 1024, diff_bits: int = 4) -> str:
    """f: the phrase table of differential steps t, copies with the literals before them, cut at the cap and the limit."""
    low, high = -(1 << diff_bits - 1), (1 << diff_bits - 1) - 1
    return (
        "pb(input_id, start, lits, target, copy, st, sl, sp, sc) AS (SELECT input_id, b, s - b, CASE WHEN size > 0 THEN p ELSE s END, size, CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM t UNION ALL "
        f"SELECT input_id, CASE WHEN cut THEN start + {cap} ELSE start + lits + now END, CASE WHEN cut THEN lits - {cap} WHEN odd THEN 1 ELSE 0 END, CASE WHEN cut THEN target WHEN odd THEN target + now + 1 ELSE target + now END, "
        f"CASE WHEN cut THEN copy WHEN odd THEN copy - now - 1 ELSE copy - now END, start, CASE WHEN cut THEN {cap} ELSE lits END, CASE WHEN cut THEN target - (lits - {cap}) ELSE target END, CASE WHEN cut THEN 0 ELSE now END FROM "
        "(SELECT q.*, NOT cut AND copy > now AND own[start + lits + now + 1] <> ref[target + now + 1] AS odd FROM "
        f"(SELECT input_id, start, lits, target, copy, lits > {cap} AS cut, least(copy, {limit} - lits) AS now FROM pb WHERE lits + copy > 0) q JOIN o USING (input_id))), "
        "pk AS MATERIALIZED (SELECT input_id, st AS start, sl AS lit_len, sp AS target, sc AS copy_len, sp - (st + sl) AS delta, row_number() OVER (PARTITION BY input_id ORDER BY st) - 1 AS subphrase, "
        "coalesce(sum(sl) OVER (PARTITION BY input_id ORDER BY st ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lit_offset FROM pb WHERE st IS NOT NULL), "
        "fo(input_id, subphrase, phrase, is_block, block_ptr, length) AS (SELECT input_id, subphrase, CAST(0 AS BIGINT), true, delta, lit_len + copy_len FROM pk WHERE subphrase = 0 UNION ALL "
        "SELECT input_id, subphrase, phrase + CAST(new AS BIGINT), new, CASE WHEN new THEN delta ELSE block_ptr END, CASE WHEN new THEN 0 ELSE length END + lit_len + copy_len FROM "
        f"(SELECT pk.*, phrase, block_ptr, length, copy_len > 0 AND NOT delta - block_ptr BETWEEN {low} AND {high} OR length + lit_len + copy_len > {limit} AS new FROM fo JOIN pk ON pk.input_id = fo.input_id AND pk.subphrase = fo.subphrase + 1)), "
        "f AS MATERIALIZED (SELECT pk.input_id, pk.subphrase, phrase, start, copy_len, lit_len, target, delta, is_block, block_ptr, CASE WHEN copy_len > 0 THEN delta - block_ptr ELSE 0 END AS diff, CAST(lit_offset AS BIGINT) AS lit_offset "
        "FROM pk JOIN fo ON pk.input_id = fo.input_id AND pk.subphrase = fo.subphrase)"
    )
