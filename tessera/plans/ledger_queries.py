"""Ledger queries and their DuckDB SQL, over a trail derived from the ``events`` table."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ledger as L
from .research_queries import rounded

D, BAR, TAIL_BAR, SEEN, NOW = 6, 0.6, 0.9, ("view", "click"), "2024-03-01 00:00:00"
_FAM = "(user_id % 3 + 1 + CASE WHEN event_id % 97 = 0 THEN 10 ELSE 0 END)"
_SKETCH = ", ".join(f"CAST({_FAM} * {(j + 2) * (j + 3) * 17} % 23 AS DOUBLE) - 11 + CAST(event_id * {j + 1} % 5 AS DOUBLE) / 5" for j in range(8))
_MH = ", ".join(f"({_FAM} * {(j + 7) * 31} + CASE WHEN event_id % 4 = {j % 4} THEN event_id ELSE 0 END) % 1009" for j in range(8))
#: The trail's columns as expressions that Spark and DuckDB read alike.
COLUMNS = {
    "id": "event_id", "ts": "ts", "user_id": "user_id", "source_hash": "concat('h', CAST(user_id % 97 AS STRING))", "horizon": "CAST(5 + 5 * (event_id % 3) AS INT)", "stage": "event_type", "lane": "CAST(user_id % 6 AS INT)",
    "verdict": "CASE WHEN event_type = 'purchase' AND user_id % 10 = 0 THEN 'pass' WHEN event_type = 'signup' THEN 'needs_review' ELSE 'fail' END",
    "ic_ir": "CASE WHEN event_id % 11 <> 0 THEN CAST(event_id * 7919 % 2001 - 1000 AS DOUBLE) / 1000 END", "spread_ir": "CASE WHEN event_id % 7 <> 0 THEN CAST(event_id * 104729 % 2001 - 1000 AS DOUBLE) / 800 END",
    "n": "20 + event_id % 37", "k_frac": "CASE WHEN event_id % 3 = 0 THEN CAST(0.1 AS DOUBLE) ELSE CAST(0.2 AS DOUBLE) END", "cost_model": "CASE WHEN event_id % 5 = 0 THEN 'v2' END", "g3": "CAST(event_id % 5 - 2 AS DOUBLE) / 10", "g4": "3 + CAST(event_id % 3 AS DOUBLE) / 2",
}
TRAIL_SQL = f"trail AS (SELECT {', '.join(f'{e} AS {c}' for c, e in COLUMNS.items())}, [{_SKETCH}] AS sketch, [{_MH}] AS mh FROM events)"
_LAST = f"{TRAIL_SQL}, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_hash, horizon ORDER BY ts DESC, id DESC) AS k FROM trail) WHERE k = 1)"


def trail(spark, d):
    cols = [F.expr(e).alias(c) for c, e in COLUMNS.items()]
    return spark.read.parquet(f"{d}/events.parquet").select(*cols, F.expr(f"array({_SKETCH})").alias("sketch"), F.expr(f"array({_MH})").alias("mh"))


def forest(spark, d):
    before = F.lag("id", 1).over(Window.partitionBy("user_id").orderBy("ts", "id"))
    return trail(spark, d).withColumn("p", before).select("id", F.when(F.col("id") % 5 != 0, F.col("p")).alias("parent"), "ts").where("id % 7 <> 3")  # so some parents are absent


def chain(spark, d):
    return L.family_chain(trail(spark, d))


def cards(s, d):
    t = trail(s, d)
    return L.rescue_cards(t, t.where("verdict = 'pass'").select("source_hash").distinct(), t.where("stage = 'error'"))


def sketched_cards(s, d):
    """A card for each source's latest trial of horizon 5, one in nine without a p."""
    last = L.latest(trail(s, d).where("horizon = 5"), "source_hash")
    return last.select(F.col("source_hash").alias("key"), F.when(F.col("id") % 9 != 0, 1 - F.abs("ic_ir")).alias("p"), "sketch")


def statuses(s, d):
    last = L.latest(trail(s, d), "source_hash")
    return last.select("source_hash", F.when(F.col("id") % 3 == 0, "frontier").when(F.col("id") % 3 == 1, F.col("verdict")).alias("status"))


QUERIES = {
    "ledger_summary": lambda s, d: L.trail_summary(trail(s, d)),
    "ledger_registry": lambda s, d: L.registry_view(trail(s, d)),
    "ledger_explored": lambda s, d: L.explored(s.read.parquet(f"{d}/part.parquet").select(F.col("p_name").alias("name")), trail(s, d).select(F.concat_ws(" ", "stage", "verdict").alias("name")), "view fail part 7", 20),
    "ledger_family_chain": lambda s, d: chain(s, d).select("lane", "rn", "id"),
    "ledger_family_marginal": lambda s, d: rounded(L.family_marginal(chain(s, d))),
    "ledger_family_convergence": lambda s, d: rounded(L.family_convergence(chain(s, d))),
    "ledger_tail_telemetry": lambda s, d: rounded(L.tail_telemetry(trail(s, d), TAIL_BAR)),
    "ledger_tail": lambda s, d: rounded(L.tail_ledger(trail(s, d), SEEN).select("source_hash", "horizon", "k_frac", "cost_model", "id", "spread_ir")),
    "ledger_near_misses": lambda s, d: rounded(L.near_misses(L.tail_ledger(trail(s, d), SEEN), TAIL_BAR).select("source_hash", "horizon", "id", "spread_ir")),
    "ledger_deepen_queue": lambda s, d: rounded(L.near_miss_queue(trail(s, d), BAR)),
    "ledger_representative": lambda s, d: rounded(L.representative(trail(s, d))),
    "ledger_graph_families": lambda s, d: L.graph_families(forest(s, d)),
    "ledger_rescue_cards": lambda s, d: rounded(cards(s, d)),
    "ledger_card_families": lambda s, d: L.card_families(sketched_cards(s, d)),
    "ledger_follow_rate": lambda s, d: rounded(L.follow_rate(trail(s, d).where("id % 10 = 0").select("id", "ts", F.col("source_hash").alias("key")), trail(s, d).where("stage = 'purchase'").select("ts", F.col("source_hash").alias("key")))),
    "ledger_reconcile": lambda s, d: rounded(L.reconcile(trail(s, d).where("stage = 'click' and ic_ir is not null").select(F.col("source_hash").alias("key"), "ts", F.col("ic_ir").alias("score")), trail(s, d).where("stage = 'purchase'").select(F.col("source_hash").alias("key"), "ts", F.col("spread_ir").alias("gain")))),
    "ledger_frontier": lambda s, d: L.frontier(statuses(s, d), L.near_miss_queue(trail(s, d), BAR)),
    "ledger_coverage": lambda s, d: rounded(L.coverage(trail(s, d))),
    "ledger_exhaustion": lambda s, d: rounded(L.exhaustion(trail(s, d), NOW)),
    "ledger_budget": lambda s, d: rounded(L.selection_budget(trail(s, d).where("stage = 'purchase'").select(F.concat("stage", F.lit("|"), F.col("lane").cast("string")).alias("band")))),
}
_CHAIN = f"""{TRAIL_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY ts DESC, id DESC) AS rn FROM trail), h AS (SELECT lane, sketch AS s0, mh AS m0 FROM r WHERE rn = 1),
pos AS (SELECT r.id, unnest(sketch) AS x, unnest(s0) AS y, unnest(mh) AS a, unnest(m0) AS b FROM r JOIN h USING (lane)),
sim AS (SELECT id, CASE WHEN stddev_samp(x) * stddev_samp(y) > 0 THEN corr(x, y) END AS rho, avg(CASE WHEN a = b THEN 1.0::DOUBLE ELSE 0 END) AS share FROM pos GROUP BY id),
brk AS (SELECT lane, min(rn) AS b FROM r JOIN sim USING (id) WHERE rn > 1 AND NOT (coalesce(abs(rho) >= 0.6, false) OR share >= 0.25) GROUP BY lane),
chain AS (SELECT r.* FROM r LEFT JOIN brk USING (lane) WHERE b IS NULL OR rn < b)"""
_LO, _HI = (repr(NormalDist().inv_cdf(1 - p)) for p in (0.30, 0.05))
_QUEUE = f"""{_LAST}, tt AS (SELECT *, (abs(spread_ir) - {BAR}) * sqrt(n - 1) / sqrt(greatest(1e-8, 1 - g3 * spread_ir + (g4 - 1) / 4 * spread_ir * spread_ir)) AS t FROM last WHERE abs(spread_ir) >= 0.75),
adm AS (SELECT DISTINCT source_hash FROM trail WHERE verdict = 'pass'),
queue AS (SELECT id, source_hash, horizon, t, (SELECT count(*) FROM trail v WHERE v.lane = tt.lane AND v.ts > tt.ts AND v.source_hash <> tt.source_hash) AS variants FROM tt WHERE t >= {_LO} AND t < {_HI} AND source_hash NOT IN (SELECT source_hash FROM adm))"""
_REP = f"""{TRAIL_SQL}, rep AS (SELECT source_hash, arg_max(id, row(ts, id)) FILTER (ic_ir IS NOT NULL) AS id, arg_max(ic_ir, row(ts, id)) FILTER (ic_ir IS NOT NULL) AS ic_ir, min(ts) AS first_seen, arg_min(verdict, row(ts, id)) AS first_verdict FROM trail GROUP BY 1)"""
_CARDS = f"""{_REP}, card AS (SELECT source_hash, id, ic_ir, (SELECT count(*) FROM trail j WHERE j.stage = 'error' AND j.source_hash = rep.source_hash) AS tries, source_hash IN (SELECT source_hash FROM trail WHERE verdict = 'pass') AS adm FROM rep),
cards AS (SELECT source_hash, id, ic_ir, tries, CASE WHEN adm THEN 'admitted' WHEN ic_ir IS NULL THEN 'no_result' WHEN tries >= 120 THEN 'exhausted' WHEN abs(ic_ir) < 0.25 THEN 'too_weak' ELSE 'open' END AS status FROM card)"""
_LEDGER = f"{TRAIL_SQL}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_hash, horizon, k_frac, coalesce(cost_model, 'legacy') ORDER BY ts DESC, id DESC) AS k FROM trail WHERE stage IN ('view', 'click') AND spread_ir IS NOT NULL) WHERE k = 1)"
_r = lambda c: f"round({c}, {D}) AS {c}"
ORACLES = {
    "ledger_summary": f"WITH {TRAIL_SQL} SELECT verdict, count(*) AS trials, count(DISTINCT (source_hash, horizon)) AS pairs, count(DISTINCT source_hash) AS sources, max(ts) AS newest FROM trail GROUP BY 1",
    "ledger_registry": f"WITH {_LAST}, f AS (SELECT horizon, coalesce(abs(ic_ir) >= 0.5, false) AS i, coalesce(spread_ir >= 0.75, false) AS s FROM last) SELECT horizon, count(*) FILTER (i AND NOT s) AS ic_only, count(*) FILTER (s AND NOT i) AS tail_only, count(*) FILTER (i AND s) AS dual, count(*) AS \"all\" FROM f GROUP BY 1",
    "ledger_explored": f"""WITH {TRAIL_SQL}, u AS (SELECT p_name AS name, 'preset' AS origin FROM part UNION SELECT stage || ' ' || verdict, 'trial' FROM trail)
      SELECT name, origin, CAST(len(list_intersect(list_distinct(regexp_split_to_array(lower(name), '[^a-z0-9]+')), ['view', 'fail', 'part', '7'])) AS INTEGER) AS score FROM u WHERE score > 0 ORDER BY score DESC, name, origin LIMIT 20""",
    "ledger_family_chain": f"WITH {_CHAIN} SELECT lane, CAST(rn AS INTEGER) AS rn, id FROM chain",
    "ledger_family_marginal": f"""WITH {_CHAIN}, a AS (SELECT lane, abs(ic_ir) AS a, row_number() OVER (PARTITION BY lane ORDER BY rn) AS r, count(*) OVER (PARTITION BY lane) AS n, max(abs(ic_ir)) OVER (PARTITION BY lane) AS best FROM chain WHERE ic_ir IS NOT NULL),
      g AS (SELECT lane, count(*) AS family, max(best) AS best, max(a) FILTER (r <= greatest(5, least(10, n // 2))) AS recent, max(a) FILTER (r > greatest(5, least(10, n // 2))) AS before, min(r) FILTER (a >= best - 1e-9) - 1 AS plateau FROM a GROUP BY 1), e AS (SELECT *, family >= 5 AND before IS NOT NULL AS enough FROM g)
      SELECT lane, family, enough, {', '.join(f'CASE WHEN enough THEN round({c}, {D}) END AS {c}' for c in ('best', 'recent', 'before'))}, CASE WHEN enough THEN CAST(plateau AS BIGINT) END AS plateau, CASE WHEN enough THEN round(recent - before, {D}) END AS marginal FROM e""",
    "ledger_family_convergence": f"""WITH {_CHAIN}, k AS (SELECT lane, source_hash, horizon, max(rn) AS pos, arg_min(abs(ic_ir), rn) FILTER (ic_ir IS NOT NULL) AS ic, arg_min(spread_ir, rn) FILTER (spread_ir IS NOT NULL) AS sp FROM chain GROUP BY ALL),
      i AS (SELECT lane, count(*) AS n, max(v) FILTER (r <= 5) AS a, max(v) FILTER (r > 5 AND r <= 10) AS b FROM (SELECT lane, ic AS v, row_number() OVER (PARTITION BY lane ORDER BY pos) AS r FROM k WHERE ic IS NOT NULL) GROUP BY 1),
      j AS (SELECT lane, count(*) AS n, max(v) FILTER (r <= 5) AS a, max(v) FILTER (r > 5 AND r <= 10) AS b FROM (SELECT lane, sp AS v, row_number() OVER (PARTITION BY lane ORDER BY pos) AS r FROM k WHERE sp IS NOT NULL) GROUP BY 1)
      SELECT i.lane, i.n AS ic_n, round(i.a, {D}) AS ic_recent, round(i.b, {D}) AS ic_before, coalesce(j.n, 0) AS sp_n, round(j.a, {D}) AS sp_recent, round(j.b, {D}) AS sp_before,
        coalesce(i.n >= 10 AND i.a - i.b < 0.02, false) AND NOT coalesce(j.n >= 10 AND j.a - j.b >= 0.02, false) AS converged FROM i LEFT JOIN j USING (lane)""",
    "ledger_tail_telemetry": f"""WITH RECURSIVE {_LAST}, s AS (SELECT * FROM last WHERE spread_ir IS NOT NULL), lk AS (SELECT p.id AS a, q.id AS b FROM s p JOIN s q ON p.horizon = q.horizon AND p.id <> q.id AND len(list_filter(list_zip(p.mh, q.mh), lambda z: z[1] = z[2])) >= 2),
      wk AS (SELECT id AS key, id AS family FROM s UNION SELECT lk.b, wk.family FROM wk JOIN lk ON lk.a = wk.key), fm AS (SELECT key, min(family) AS family FROM wk GROUP BY 1)
      SELECT horizon, count(*) AS entries, count(DISTINCT family) AS n_eff, list_sort(list(n))[CAST(count(*) // 2 + 1 AS BIGINT)] AS periods, round(max(spread_ir), {D}) AS best, count(*) FILTER (spread_ir >= {TAIL_BAR} - 0.10 AND spread_ir < {TAIL_BAR}) AS near_misses FROM s JOIN fm ON fm.key = s.id GROUP BY 1""",
    "ledger_tail": f"WITH {_LEDGER} SELECT source_hash, horizon, k_frac, coalesce(cost_model, 'legacy') AS cost_model, id, {_r('spread_ir')} FROM l",
    "ledger_near_misses": f"WITH {_LEDGER} SELECT source_hash, horizon, id, {_r('spread_ir')} FROM l WHERE spread_ir >= {TAIL_BAR} - 0.10 AND spread_ir < {TAIL_BAR} ORDER BY ts DESC, id DESC LIMIT 3",
    "ledger_deepen_queue": f"WITH {_QUEUE} SELECT id, source_hash, horizon, {_r('t')}, variants FROM queue",
    "ledger_representative": f"WITH {_REP} SELECT source_hash, id, {_r('ic_ir')}, first_seen, first_verdict FROM rep",
    "ledger_graph_families": f"""WITH RECURSIVE {TRAIL_SQL}, nodes AS (SELECT id, ts, CASE WHEN id % 5 <> 0 THEN p END AS parent FROM (SELECT id, ts, lag(id) OVER (PARTITION BY user_id ORDER BY ts, id) AS p FROM trail) WHERE id % 7 <> 3),
      lk AS (SELECT id AS a, parent AS b FROM nodes WHERE parent IS NOT NULL UNION SELECT parent, id FROM nodes WHERE parent IS NOT NULL), wk AS (SELECT id AS key, id AS family FROM nodes UNION SELECT a, a FROM lk UNION SELECT lk.b, wk.family FROM wk JOIN lk ON lk.a = wk.key),
      fm AS (SELECT key, min(family) AS family FROM wk GROUP BY 1) SELECT id, family, count(*) OVER (PARTITION BY family) AS size, CAST(row_number() OVER (PARTITION BY family ORDER BY ts, id) AS INTEGER) AS depth FROM nodes JOIN fm ON fm.key = nodes.id""",
    "ledger_rescue_cards": f"WITH {_CARDS} SELECT source_hash, id, {_r('ic_ir')}, tries, status FROM cards",
    "ledger_card_families": f"""WITH RECURSIVE {TRAIL_SQL}, one AS (SELECT source_hash AS key, CASE WHEN id % 9 <> 0 THEN 1 - abs(ic_ir) END AS p, sketch FROM (SELECT *, row_number() OVER (PARTITION BY source_hash ORDER BY ts DESC, id DESC) AS r FROM trail WHERE horizon = 5) WHERE r = 1),
      nodes AS (SELECT *, row_number() OVER (ORDER BY key) AS i FROM one), pairs AS (SELECT p.i AS pi, q.i AS qi FROM nodes p JOIN nodes q ON p.i > q.i AND abs((SELECT corr(z[1], z[2]) FROM (SELECT unnest(list_zip(p.sketch, q.sketch)) AS z))) >= 0.6),
      walk(i, leaders, lead) AS (SELECT 0::BIGINT, CAST([] AS BIGINT[]), NULL::BIGINT UNION ALL SELECT n.i, CASE WHEN m IS NULL THEN list_append(leaders, n.i) ELSE leaders END, coalesce(m, n.i)
        FROM (SELECT walk.i + 1 AS i, leaders, list_min(list_intersect(leaders, (SELECT list(qi) FROM pairs WHERE pi = walk.i + 1))) AS m FROM walk) n JOIN nodes USING (i)),
      j AS (SELECT nodes.key, p, lead FROM walk JOIN nodes USING (i)), h AS (SELECT lead, arg_min(key, struct_pack(a := p IS NULL, b := coalesce(p, 0), c := key)) AS representative, count(*) AS members FROM j GROUP BY 1)
      SELECT key, representative, members FROM j JOIN h USING (lead)""",
    "ledger_follow_rate": f"""WITH {TRAIL_SQL}, h AS (SELECT *, EXISTS (SELECT 1 FROM trail e WHERE e.stage = 'purchase' AND e.source_hash = t.source_hash AND e.ts BETWEEN t.ts AND t.ts + INTERVAL 48 HOUR) AS hit FROM trail t WHERE id % 10 = 0)
      SELECT count(*) FILTER (hit) AS followed, count(*) AS total, round(count(*) FILTER (hit) / count(*), {D}) AS rate FROM h""",
    "ledger_reconcile": f"""WITH {TRAIL_SQL}, s AS (SELECT source_hash, arg_max(ic_ir, row(ts, ic_ir)) AS score, max(ts) AS seen_at FROM trail WHERE stage = 'click' AND ic_ir IS NOT NULL GROUP BY 1),
      p AS (SELECT score, spread_ir AS gain FROM trail JOIN s USING (source_hash) WHERE stage = 'purchase' AND spread_ir IS NOT NULL AND seen_at <= ts),
      q AS (SELECT *, (row_number() OVER (ORDER BY score, gain) - 1) * 5 // count(*) OVER () AS b, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rs, rank() OVER (ORDER BY gain) + (count(*) OVER (PARTITION BY gain) - 1) / 2.0 AS rg FROM p)
      SELECT CAST(least(4, b) AS INTEGER) AS bucket, count(*) AS n, round(avg(score), {D}) AS score, round(avg(gain), {D}) AS gain, round((SELECT corr(rs, rg) FROM q), {D}) AS rho FROM q GROUP BY 1""",
    "ledger_frontier": f"""WITH {_QUEUE}, st AS (SELECT source_hash, arg_max(id, row(ts, id)) AS id, arg_max(verdict, row(ts, id)) AS v FROM trail GROUP BY 1), su AS (SELECT source_hash, CASE WHEN id % 3 = 0 THEN 'frontier' WHEN id % 3 = 1 THEN v END AS status FROM st)
      SELECT source_hash FROM su WHERE status IS NULL OR status = 'frontier' UNION SELECT source_hash FROM queue""",
    "ledger_coverage": f"WITH {TRAIL_SQL} SELECT lane, horizon, count(*) AS trials, max(ts) AS newest, round(max(abs(ic_ir)), {D}) AS best, CASE WHEN count(*) >= 800 THEN 'exhausted' WHEN count(*) >= 400 THEN 'worn' ELSE 'fresh' END AS tier FROM trail GROUP BY ALL",
    "ledger_exhaustion": f"""WITH {TRAIL_SQL}, g AS (SELECT lane, count(*) AS trials, (epoch(TIMESTAMP '{NOW}') - epoch(max(ts))) / 86400 AS age FROM trail GROUP BY 1),
      own AS (SELECT * FROM (SELECT lane, id, sketch, row_number() OVER (PARTITION BY lane ORDER BY md5(CAST(id AS VARCHAR)), id) AS r FROM trail) WHERE r <= 20),
      oth AS (SELECT * FROM (SELECT g.lane, t.id, t.sketch, row_number() OVER (PARTITION BY g.lane ORDER BY md5(CAST(t.id AS VARCHAR)), t.id) AS r FROM g JOIN trail t ON t.lane <> g.lane) WHERE r <= 20),
      ia AS (SELECT lane, CASE WHEN count(c) >= 3 THEN avg(c) END AS intra FROM (SELECT p.lane, abs((SELECT CASE WHEN stddev_samp(z[1]) * stddev_samp(z[2]) > 0 THEN corr(z[1], z[2]) END FROM (SELECT unnest(list_zip(p.sketch, q.sketch)) AS z))) AS c FROM own p JOIN own q ON p.lane = q.lane AND p.id < q.id) GROUP BY 1),
      ie AS (SELECT lane, CASE WHEN count(c) >= 3 THEN avg(c) END AS inter FROM (SELECT p.lane, abs((SELECT CASE WHEN stddev_samp(z[1]) * stddev_samp(z[2]) > 0 THEN corr(z[1], z[2]) END FROM (SELECT unnest(list_zip(p.sketch, q.sketch)) AS z))) AS c FROM own p JOIN oth q ON p.lane = q.lane) GROUP BY 1)
      SELECT lane, trials, {_r('intra')}, {_r('inter')}, {_r('age')}, CASE WHEN trials >= 2 AND intra >= 0.6 THEN 'exhausted' WHEN trials >= 2 AND intra >= 0.4 THEN 'fading' WHEN trials >= 3 AND inter >= 0.5 THEN CASE WHEN trials >= 10 THEN 'exhausted' ELSE 'fading' END WHEN trials >= 10 AND age > 14 THEN 'fading' ELSE 'fresh' END AS tier
      FROM g LEFT JOIN ia USING (lane) LEFT JOIN ie USING (lane)""",
    "ledger_budget": f"WITH {TRAIL_SQL} SELECT stage || '|' || lane AS band, count(*) AS spent, greatest(0, 60 - count(*)) AS remaining, count(*) >= 60 AS sealed, round(0.05 / 60, {D})::DOUBLE AS alpha_weight, round(count(*) * 0.05 / 60, {D})::DOUBLE AS alpha_spent FROM trail WHERE stage = 'purchase' GROUP BY 1",
}
