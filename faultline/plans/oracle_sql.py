"""Independent SQL for the registered queries, for a second engine over the same tables."""

from __future__ import annotations

from ..constants import (BM25_B, BM25_EPSILON, BM25_K1, CAUSES, CHUNK_OVERLAP, CHUNK_SIZE, CONTAMINATION, DISCLAIMER, FEATURE_LABELS, FEATURES,
                         GENERAL_RECOMMENDATIONS, HASH_DIMS, LIMIT_NO_RUNBOOK, MASKS,
                         MAX_LOG_CHARS, MAX_LOG_LINES, MIN_CHUNK_CHARS, NO_INCIDENT, NO_RISING_TEXT, N_TREES,
                         PLAN_AUTO, PLAN_HEAD, PLAN_TAIL, PLAN_TEXT, QUERY_FALLBACK, QUERY_HEAD, QUERY_HINTS,
                         REASON_NO_DIRECT, REASON_NORMAL, RISING_HEADER, SEED, SIGNAL_NAMES,
                         SIGNAL_QUERIES, SIGNALS, SUBSAMPLE, UNDETERMINED)
from ..sources.tables import RUNBOOKS
from . import fixed_forest, round_trips

NL = "chr(10)"
NL_PLAN = "\n".join(f"{i} {tool}: {text}" for i, (tool, text) in enumerate(PLAN_TEXT, 1))


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def mask(x: str) -> str:
    for pattern, new in MASKS:
        x = f"regexp_replace({x}, {lit(pattern)}, {lit(new)}, 'g')"
    return x


def rnd(x: str, digits: int) -> str:
    """Through the correctly rounded decimal text."""
    return f"format('{{:.{digits}f}}', ({x})::DOUBLE)::DOUBLE"


def fixed(x: str, digits: int) -> str:
    return f"format('{{:.{digits}f}}', ({x})::DOUBLE)"


def percent(x: str) -> str:
    return f"format('{{:.0f}}%', ({x})::DOUBLE * 100)"


def r6(cols: list[str]) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in cols)


# ------------------------------------------------------------------ log lines
LOG = r"""
ev AS (SELECT event_id AS id, ts, user_id AS u, event_type AS t, value AS v,
              strftime(ts, '%H%M%S') AS clock FROM events),
log0 AS (
  SELECT id AS "LineId", strftime(ts, '%y%m%d') AS "Date",
    CASE WHEN id % 101 = 0 THEN '999999'
         WHEN id % 7 = 0 THEN clock::INT::VARCHAR || '.0' ELSE clock END AS "Time",
    u AS "Pid",
    CASE WHEN id % 97 = 0 THEN NULL
         WHEN t = 'error' THEN CASE WHEN v >= 200 THEN 'FATAL' ELSE 'ERROR' END
         WHEN t = 'signup' THEN 'warning' WHEN t = 'view' THEN ' info '
         WHEN t = 'purchase' THEN 'DEBUG' ELSE 'INFO' END AS "Level",
    'dfs.' || t AS "Component",
    CASE id % 8
      WHEN 0 THEN 'Receiving block blk_' || id || ' src: /10.0.0.1:50010'
      WHEN 1 THEN 'PacketResponder 1 for block blk_' || id || ' terminating'
      WHEN 2 THEN 'Lost heartbeat from datanode 10.0.0.' || u
      WHEN 3 THEN 'Connection reset by peer 10.0.0.' || u
      WHEN 4 THEN 'No space left on device for volume /data/' || u
      WHEN 5 THEN 'NameNode is in safe mode, edit log failed to load'
      WHEN 6 THEN 'blk_' || id || ' could only be replicated to 0 nodes'
      ELSE 'Verification succeeded for blk_' || id END AS "Content",
    'E' || (id % 14 + 1) AS "EventId", 'T' || (id % 14 + 1) AS "EventTemplate"
  FROM ev),
log AS (
  SELECT *, 0 AS pos FROM log0
  UNION ALL SELECT *, 1 FROM log0 WHERE "LineId" % 50 = 0
  UNION ALL SELECT "LineId", "Date", "Time", "Pid", 'INFO', "Component", 'repeated line id',
                   "EventId", "EventTemplate", 2 FROM log0 WHERE "LineId" % 53 = 0)"""


def six(x: str) -> str:
    t = rf"regexp_replace({strip(x)}, '\.0+$', '')"
    return f"CASE WHEN length({t}) >= 6 THEN {t} ELSE lpad({t}, 6, '0') END"


STAMPED = f"""
st0 AS (SELECT *, ({six('"Date"')}) || ({six('"Time"')}) AS txt FROM log),
stamped AS (SELECT * EXCLUDE (txt),
  CASE WHEN regexp_matches(txt, '^[0-9]{{12}}$') THEN try_strptime(
    CASE WHEN substr(txt, 1, 2) >= '69' THEN '19' ELSE '20' END || txt, '%Y%m%d%H%M%S') END AS "Timestamp"
  FROM st0)"""


def level(x: str = '"Level"') -> str:
    u = f"upper({strip(f'coalesce({x}, ' + lit('UNKNOWN') + ')')})"
    return f"CASE WHEN {u} = '' THEN 'UNKNOWN' WHEN {u} = 'WARNING' THEN 'WARN' ELSE {u} END"


def flag_columns(lv: str, content: str) -> str:
    text = f"lower(coalesce({content}, ''))"
    cols = [f"({lv} = 'ERROR')::INT AS is_error", f"({lv} IN ('WARN', 'WARNING'))::INT AS is_warning",
            f"({lv} = 'INFO')::INT AS is_info", f"({lv} = 'FATAL')::INT AS is_fatal"]
    cols += [f"regexp_matches({text}, {lit(p)})::INT AS {n}_signal" for n, p, _, _ in SIGNALS]
    cols += [f"(regexp_matches({text}, {lit(p)}) AND {lv} IN ('ERROR', 'FATAL'))::INT AS {flag}"
             for _, p, flag, _ in SIGNALS]
    return ", ".join(cols)


# Exact duplicates are removed first and repeated LineIds second.
CLEAN = """
dd AS (SELECT "LineId", "Date", "Time", "Pid", "Level", "Component", "Content", "EventId",
              "EventTemplate", "Timestamp", min(pos) AS pos FROM stamped GROUP BY ALL),
cleaned AS (SELECT * FROM dd QUALIFY row_number() OVER (PARTITION BY "LineId" ORDER BY pos) = 1)"""
LINES = f"""
lines0 AS (SELECT * REPLACE ({level()} AS "Level") FROM cleaned WHERE "Timestamp" IS NOT NULL),
lines AS (SELECT *, time_bucket(INTERVAL '10 minutes', "Timestamp") AS time_window,
          {flag_columns('"Level"', '"Content"')} FROM lines0)"""
FEATS = """
feats0 AS (SELECT time_window, count(*)::BIGINT AS logs_per_window,
  sum(is_error)::BIGINT AS error_count, sum(is_warning)::BIGINT AS warning_count,
  sum(is_info)::BIGINT AS info_count, sum(is_fatal)::BIGINT AS fatal_count,
  sum(heartbeat_failure)::BIGINT AS heartbeat_failures, sum(block_error)::BIGINT AS block_errors,
  sum(replication_error)::BIGINT AS replication_errors, sum(network_error)::BIGINT AS network_errors,
  sum(disk_error)::BIGINT AS disk_errors,
  count(DISTINCT "Component")::BIGINT AS unique_components,
  count(DISTINCT "EventId")::BIGINT AS unique_event_ids,
  count(DISTINCT "Pid")::BIGINT AS unique_processes
  FROM lines GROUP BY time_window),
feats AS (SELECT *, error_count::DOUBLE / logs_per_window AS error_ratio,
  warning_count::DOUBLE / logs_per_window AS warning_ratio,
  fatal_count::DOUBLE / logs_per_window AS fatal_ratio FROM feats0)"""
INC = """
inc AS (SELECT row_number() OVER (ORDER BY time_window)::BIGINT AS incident_no,
  printf('INC-%03d', row_number() OVER (ORDER BY time_window)) AS incident_id, * FROM feats)"""
BASE = [LOG, STAMPED, CLEAN, LINES, FEATS, INC]
TO_LINES = [LOG, STAMPED, CLEAN, LINES]
RAW_COLS = '"LineId", "Date", "Time", "Pid", "Level", "Component", "Content", "EventId", "EventTemplate"'

SIG = "sigs AS (SELECT time_window, " + ", ".join(
    f"count(*) FILTER (WHERE {s}_signal = 1 AND \"Level\" IN ('WARN', 'ERROR', 'FATAL'))::BIGINT AS {s}"
    for s in SIGNAL_NAMES) + " FROM lines GROUP BY time_window)"
RANK = ("CASE \"Level\" WHEN 'FATAL' THEN 0 WHEN 'ERROR' THEN 1 WHEN 'WARN' THEN 2 WHEN 'UNKNOWN' THEN 3 "
        "WHEN 'DEBUG' THEN 4 WHEN 'INFO' THEN 5 ELSE 3 END")
SHOWN = f"""shown AS (SELECT time_window,
  row_number() OVER (PARTITION BY time_window ORDER BY {RANK}, "Timestamp", "LineId") AS line_no,
  "LineId", "Timestamp", "Level", coalesce("Component", 'nan') AS component,
  coalesce("EventId", 'nan') AS event_id, left(coalesce("Content", 'nan'), {MAX_LOG_CHARS}) AS content
  FROM lines QUALIFY line_no <= {MAX_LOG_LINES})"""


def zstats() -> str:
    cols = ", ".join(
        f"avg({c}::DOUBLE) AS m_{c}, CASE WHEN stddev_pop({c}::DOUBLE) = 0 THEN 1 "
        f"ELSE stddev_pop({c}::DOUBLE) END AS s_{c}" for c in FEATURES)
    return f"zs AS (SELECT {cols} FROM feats)"


def similar_ctes() -> list[str]:
    z = ", ".join(f"({c}::DOUBLE - m_{c}) / s_{c} AS z_{c}" for c in FEATURES)
    d = " + ".join(f"(a.z_{c} - b.z_{c}) * (a.z_{c} - b.z_{c})" for c in FEATURES)
    return [zstats(),
            f"zi AS (SELECT incident_no, {z} FROM inc, zs)",
            f"""prs AS (SELECT a.incident_no, b.incident_no AS other, sqrt({d}) AS dist
                FROM zi a, zi b WHERE a.incident_no <> b.incident_no),
sim AS (SELECT incident_no, other, dist,
  row_number() OVER (PARTITION BY incident_no ORDER BY round(dist, 9), other) AS rank FROM prs
  QUALIFY rank <= 3),
sims AS (SELECT s.incident_no, s.rank::INT AS rank, i.incident_id AS similar_id,
  {rnd('1.0::DOUBLE/(1.0::DOUBLE+dist)', 4)} AS similarity, i.time_window AS window_start,
  i.logs_per_window AS n_logs, i.error_count
  FROM sim s JOIN inc i ON i.incident_no = s.other)"""]


# ------------------------------------------------------------------ text and retrieval
def clean_md(x: str) -> str:
    x = rf"regexp_replace({x}, '\r\n|\r', {NL}, 'g')"
    x = f"replace({x}, chr(9), '    ')"
    x = f"regexp_replace({x}, '(?m) +$', '', 'g')"
    x = rf"regexp_replace({x}, '(?m)^\s*---+\s*$', '', 'g')"
    x = rf"regexp_replace({x}, '\n{{3,}}', {NL} || {NL}, 'g')"
    return strip(x)


def tokens(x: str) -> str:
    return (rf"list_filter(list_transform(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}\p{{M}}_.\-]+'), "
            "lambda t: trim(t, '.-')), lambda t: t <> '')")


SECTIONED = r"""
kd0 AS (SELECT 'doc_' || doc_id AS source, '# doc_' || doc_id || chr(10) || text AS c FROM documents),
kd1 AS (SELECT source, regexp_replace(c, '(?m)^([A-H])', '## Part \1' || chr(10) || '\1', 'g') AS c FROM kd0),
kd2 AS (SELECT source, regexp_replace(c, '(?m)^([I-M])', '### Point \1' || chr(10) || '\1', 'g') AS c FROM kd1),
kd AS (SELECT source, regexp_replace(c, '(?m)^([NO])',
  '```' || chr(10) || '# not a heading' || chr(10) || '```' || chr(10) || '\1', 'g') AS c FROM kd2)"""

# Line by line: a running count of fence lines tells code from text, and headings number sections.
SECTIONS = SECTIONED + f""",
kl AS (SELECT source, unnest(string_split({clean_md('c')}, chr(10))) AS line,
  generate_subscripts(string_split({clean_md('c')}, chr(10)), 1) AS n FROM kd),
kf AS (SELECT *, sum(CASE WHEN line LIKE '```%' OR line LIKE '~~~%' THEN 1 ELSE 0 END)
  OVER (PARTITION BY source ORDER BY n) AS fence FROM kl),
kh AS (SELECT *, CASE WHEN fence % 2 = 0 AND regexp_matches(line, '^#{{1,3}} ') THEN
  length(regexp_extract(line, '^(#+)', 1)) END AS lvl FROM kf),
ks AS (SELECT *, sum(CASE WHEN lvl IS NOT NULL THEN 1 ELSE 0 END)
  OVER (PARTITION BY source ORDER BY n) AS sec FROM kh),
kb AS (SELECT source, sec::INT AS section_no, {strip('string_agg(line, chr(10) ORDER BY n)')} AS body,
  max(lvl) AS lvl, {strip("max(CASE WHEN lvl IS NOT NULL THEN regexp_extract(line, '^#+ +(.*)$', 1) END)")} AS title
  FROM ks GROUP BY source, sec),
kn AS (SELECT * FROM kb WHERE body <> ''),
k1 AS (SELECT *, max(CASE WHEN lvl = 1 THEN section_no END) OVER w AS p1,
  max(CASE WHEN lvl = 2 THEN section_no END) OVER w AS p2,
  max(CASE WHEN lvl = 3 THEN section_no END) OVER w AS p3
  FROM kn WINDOW w AS (PARTITION BY source ORDER BY section_no)),
sec AS (SELECT a.source, a.section_no, a.body, b1.title AS h1,
  CASE WHEN a.p2 > coalesce(a.p1, -1) THEN b2.title END AS h2,
  CASE WHEN a.p3 > greatest(coalesce(a.p1, -1), coalesce(a.p2, -1)) THEN b3.title END AS h3
  FROM k1 a LEFT JOIN kn b1 ON b1.source = a.source AND b1.section_no = a.p1
  LEFT JOIN kn b2 ON b2.source = a.source AND b2.section_no = a.p2
  LEFT JOIN kn b3 ON b3.source = a.source AND b3.section_no = a.p3)"""


def _cut(out: str, src: str, keys: str, no: str, sep: str) -> str:
    """Texts of `src` (keys, t) cut before each separator: pieces (keys, no, t)."""
    return f"""
{out}_0 AS (SELECT {keys}, unnest(string_split(t, {sep})) AS p, generate_subscripts(string_split(t, {sep}), 1) AS {no} FROM {src}),
{out} AS (SELECT {keys}, {no}, CASE WHEN {no} = 1 THEN p ELSE {sep} || p END AS t FROM {out}_0 WHERE {no} > 1 OR p <> '')"""


# Pieces with their place (a, b, c, d) and depth; pieces next to each other of one depth and parent are a
# run. Chunks of a run follow one another: the running sums of lengths give the end of each and its overlap.
SIZE_SPLIT = f"""
long AS (SELECT source, section_no, body AS t FROM sec WHERE length(body) > {CHUNK_SIZE}),""" + _cut(
    "pa", "long", "source, section_no", "a", f"{NL} || {NL}") + "," + _cut(
    "pb", f"(SELECT * FROM pa WHERE length(t) >= {CHUNK_SIZE})", "source, section_no, a", "b", NL) + "," + _cut(
    "pc", f"(SELECT * FROM pb WHERE length(t) >= {CHUNK_SIZE})", "source, section_no, a, b", "c", "' '") + f""",
pd AS (SELECT source, section_no, a, b, c, unnest(range(0, length(t) - {CHUNK_OVERLAP}, {CHUNK_SIZE - CHUNK_OVERLAP})) AS d, t FROM pc
  WHERE length(t) >= {CHUNK_SIZE}),
leafs AS (SELECT source, section_no, 1 AS depth, a, 0 AS b, 0 AS c, 0 AS d, t FROM pa WHERE length(t) < {CHUNK_SIZE}
  UNION ALL SELECT source, section_no, 2, a, b, 0, 0, t FROM pb WHERE length(t) < {CHUNK_SIZE}
  UNION ALL SELECT source, section_no, 3, a, b, c, 0, t FROM pc WHERE length(t) < {CHUNK_SIZE}
  UNION ALL SELECT source, section_no, 4, a, b, c, d, substr(t, d + 1, {CHUNK_SIZE}) FROM pd),
parents AS (SELECT *, [depth, CASE WHEN depth > 1 THEN a END, CASE WHEN depth > 2 THEN b END, CASE WHEN depth > 3 THEN c END,
  CASE WHEN depth > 3 THEN d END] AS parent FROM leafs),
runs0 AS (SELECT *, CASE WHEN parent IS DISTINCT FROM lag(parent) OVER w THEN 1 ELSE 0 END AS fresh FROM parents
  WINDOW w AS (PARTITION BY source, section_no ORDER BY a, b, c, d)),
runs1 AS (SELECT *, sum(fresh) OVER (PARTITION BY source, section_no ORDER BY a, b, c, d) AS run FROM runs0),
runs AS (SELECT source, section_no, run, list(t ORDER BY a, b, c, d) AS ts,
  list_transform(range(0, count(*) + 1), lambda i: coalesce(list_sum(list(length(t) ORDER BY a, b, c, d)[1:i]), 0)::BIGINT) AS s
  FROM runs1 GROUP BY source, section_no, run),
packed AS (SELECT source, section_no, run, ts, s, 0::BIGINT AS f,
    len(list_filter(s[2:], lambda x: x <= {CHUNK_SIZE}))::BIGINT AS e FROM runs UNION ALL
  SELECT source, section_no, run, ts, s, g, g + len(list_filter(s[g + 2:], lambda x: x - s[g + 1] <= {CHUNK_SIZE})) FROM (
    SELECT *, e - len(list_filter(s[1:e], lambda x: s[e + 1] - x <= least({CHUNK_OVERLAP}, {CHUNK_SIZE} - length(ts[e + 1])))) AS g
    FROM packed WHERE e < len(ts))),
cut AS (SELECT source, section_no, run, f, {strip("array_to_string(ts[f + 1:e], '')")} AS t FROM packed
  UNION ALL SELECT source, section_no, 0, 0, body FROM sec WHERE length(body) <= {CHUNK_SIZE}),
chunk AS (SELECT (row_number() OVER (ORDER BY source, section_no, run, f) - 1)::BIGINT AS chunk_id, * FROM cut
  WHERE length(t) >= {MIN_CHUNK_CHARS})"""


def embed_ctes(name: str, table: str, key: str, text: str) -> str:
    """Hashed unit vectors in long form (key, dim, v) from a table."""
    hexv = " + ".join(f"(strpos('0123456789abcdef', substr(h, {i}, 1)) - 1) * {16 ** (4 - i)}"
                      for i in range(1, 5))
    return f"""
{name}_t AS (SELECT {key} AS k, unnest({tokens(text)}) AS t FROM {table}),
{name}_h AS (SELECT k, md5(t) AS h FROM {name}_t),
{name}_c AS (SELECT k, ({hexv}) % {HASH_DIMS} AS dim,
  sum(CASE WHEN substr(h, 5, 1) < '8' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS w FROM {name}_h GROUP BY ALL),
{name}_n AS (SELECT k, sqrt(sum(w * w)) AS nrm FROM {name}_c GROUP BY k),
{name}_k AS (SELECT {key} AS k FROM {table}),
{name} AS (SELECT kk.k, d.dim::INT AS dim, CASE WHEN n.nrm > 0 THEN coalesce(c.w, 0) / n.nrm ELSE 0 END AS v
  FROM {name}_k kk CROSS JOIN (SELECT unnest(range({HASH_DIMS})) AS dim) d
  LEFT JOIN {name}_n n ON n.k = kk.k LEFT JOIN {name}_c c ON c.k = kk.k AND c.dim = d.dim)"""


def bm25_ctes(docs: str, queries: str) -> str:
    """Scores sc(q, k, s) from docs(k, content, source) and queries(q, txt)."""
    return f"""
dt AS (SELECT k, {tokens('content')} AS ts FROM {docs}),
dl AS (SELECT k, len(ts) AS dl FROM dt),
tf AS (SELECT k, t, count(*) AS tf FROM (SELECT k, unnest(ts) AS t FROM dt) GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(dl) AS av FROM dl),
tr AS (SELECT t, count(*)::BIGINT AS df, ln(any_value(n) - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS raw
  FROM tf, st GROUP BY t),
ti AS (SELECT t, df, CASE WHEN raw < 0 THEN {BM25_EPSILON}::DOUBLE * (SELECT avg(raw) FROM tr) ELSE raw END AS idf FROM tr),
qt AS (SELECT q, t, count(*) AS qtf FROM (SELECT q, unnest({tokens('txt')}) AS t FROM {queries}) GROUP BY ALL),
sc AS (SELECT qt.q, tf.k, sum(qtf * idf * (tf * ({BM25_K1}::DOUBLE + 1)) /
  (tf + {BM25_K1}::DOUBLE * (1 - {BM25_B}::DOUBLE + {BM25_B}::DOUBLE * dl / av))) AS s
  FROM qt JOIN ti USING (t) JOIN tf USING (t) JOIN dl ON dl.k = tf.k, st GROUP BY ALL),
qk AS (SELECT q, k, coalesce(s, 0.0::DOUBLE) AS s FROM (SELECT DISTINCT q FROM {queries}) CROSS JOIN
  (SELECT k FROM {docs}) LEFT JOIN sc USING (q, k)),
sp AS (SELECT q, k, s, row_number() OVER (PARTITION BY q ORDER BY round(s, 9) DESC, k) AS r FROM qk
  QUALIFY r <= 10)"""


def hybrid_ctes(docs: str, queries: str, max_distance: str = "0.9", min_bm25: str = "2.0",
                top_k: int = 3) -> str:
    """Hits hit(q, rank, source, k, d2, s, rrf, content)."""
    return bm25_ctes(docs, queries) + "," + embed_ctes("dv", docs, "k", "content") + "," + embed_ctes(
        "qv", f"(SELECT DISTINCT q, txt FROM {queries})", "q", "txt") + f""",
dn0 AS (SELECT qv.k AS q, dv.k AS k, sum((qv.v - dv.v) * (qv.v - dv.v)) AS d2
  FROM qv JOIN dv ON qv.dim = dv.dim GROUP BY ALL),
dn AS (SELECT q, k, d2, row_number() OVER (PARTITION BY q ORDER BY round(sqrt(d2), 9), k) AS r FROM dn0
  QUALIFY r <= 10),
fu AS (SELECT coalesce(dn.q, sp.q) AS q, coalesce(dn.k, sp.k) AS k, dn.d2, dn.r AS dr, sp.r AS sr,
  coalesce(0.7::DOUBLE / (60 + dn.r), 0) + coalesce(0.3::DOUBLE / (60 + sp.r), 0) AS rrf
  FROM dn FULL OUTER JOIN sp ON dn.q = sp.q AND dn.k = sp.k),
hit AS (SELECT fu.q, row_number() OVER (PARTITION BY fu.q
    ORDER BY round(rrf, 12) DESC, dr ASC NULLS LAST, sr) AS rank,
  doc.source, fu.k, d2, qk.s, rrf, doc.content
  FROM fu JOIN qk ON qk.q = fu.q AND qk.k = fu.k JOIN {docs} doc ON doc.k = fu.k
  WHERE (d2 IS NOT NULL AND d2 <= {max_distance}) OR qk.s >= {min_bm25}
  QUALIFY rank <= {top_k})"""


DOCS = "docs AS (SELECT doc_id AS k, 'doc_' || doc_id AS source, text AS content FROM documents)"
BQ = "bq AS (SELECT item_id AS q, text AS txt FROM benchmark)"
RB = "rb AS (SELECT row_number() OVER (ORDER BY source) - 1 AS k, source, content FROM (VALUES " + ", ".join(
    f"({lit(s)}, {lit(t)})" for s, t in RUNBOOKS) + ") v(source, content))"


EXPECTED = """
ex AS (SELECT item_id AS q, any_value(b.text) AS txt, 'doc_' || min(doc_id) AS e FROM benchmark b JOIN documents d
  ON contains(d.text, b.text) GROUP BY item_id)"""
FIRST_RANK = """
fr AS (SELECT ex.q, min(rank) AS r FROM ex LEFT JOIN hit ON hit.q = ex.q AND hit.source = ex.e GROUP BY ex.q)"""


# ------------------------------------------------------------------ evidence
def line_evidence_cte() -> str:
    w = "CASE WHEN \"Level\" IN ('FATAL', 'ERROR') THEN 3.0::DOUBLE WHEN \"Level\" = 'WARN' THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END"
    sev = "\"Level\" IN ('WARN', 'ERROR', 'FATAL')"
    cols = []
    for i, c in enumerate(CAUSES):
        m = f"regexp_matches(content, {lit('(?i)' + c[2])})"
        cols.append(f"sum(CASE WHEN {m} THEN {w} ELSE 0 END) AS log_{i}")
        note = "'[' || \"Level\" || '] ' || left(masked, 80)"
        # first occurrence of each distinct note, in line order
        cols.append(
            f"list_sort(list_distinct(list(CASE WHEN {m} AND {sev} THEN "
            f"struct_pack(f := first_no_{i}, v := {note}) END) ))[1:4] AS nl_{i}")
    first = ", ".join(
        f"min(CASE WHEN regexp_matches(content, {lit('(?i)' + c[2])}) AND {sev} THEN line_no END) "
        f"OVER (PARTITION BY time_window, '[' || \"Level\" || '] ' || left(masked, 80)) AS first_no_{i}"
        for i, c in enumerate(CAUSES))
    return f"""
sm AS (SELECT *, {mask('content')} AS masked FROM shown),
sf AS (SELECT *, {first} FROM sm),
le AS (SELECT time_window, {', '.join(cols)},
  list('[' || "Level" || '] ' || masked ORDER BY line_no) FILTER (WHERE {sev} AND line_no <= 3) AS severe_lines,
  max(CASE WHEN line_no = 1 AND {sev} THEN left(masked, 120) END) AS lead_line,
  bool_or({sev}) AS any_severe FROM sf GROUP BY time_window)"""


def suspicious_cte() -> str:
    names = [s for s in SIGNAL_NAMES if s in SIGNAL_QUERIES]
    rows = " UNION ALL ".join(
        f"SELECT time_window, {i} AS no, '{s}' AS signal, {s} AS n, {lit(SIGNAL_QUERIES[s])} AS query FROM sigs"
        for i, s in enumerate(names))
    return f"""
su0 AS ({rows}),
su AS (SELECT time_window, row_number() OVER (PARTITION BY time_window ORDER BY n DESC, no) AS search_no,
  signal, n, query FROM su0 WHERE n > 0 QUALIFY search_no <= 2)"""


def query_cte() -> str:
    hints = ", ".join(f"CASE WHEN {f} > 0 THEN {lit(w)} END" for f, w in QUERY_HINTS)
    return f"""
aq0 AS (SELECT i.*, le.* EXCLUDE (time_window),
  list_filter([{hints}], lambda h: h IS NOT NULL)[1:3] AS hs FROM inc i LEFT JOIN le USING (time_window)),
aq AS (SELECT *, CASE WHEN len(hs) = 0 AND lead_line IS NULL THEN {lit(QUERY_FALLBACK)}
  ELSE array_to_string(list_filter(list_concat([{lit(QUERY_HEAD)}], hs, [lead_line]), lambda h: h IS NOT NULL), ' ')
  END AS auto_query FROM aq0)"""


CASES = BASE + [SIG, SHOWN, line_evidence_cte(), suspicious_cte(), query_cte()]
SCORE = (f"so AS (SELECT incident_no, {rnd('raw', 4)} AS anomaly_score, {rnd('raw', 4)} > 0.5 AS is_anomaly FROM "
         "(SELECT incident_no, least(1.0::DOUBLE, 0.1::DOUBLE + 0.08::DOUBLE * logs_per_window * error_ratio "
         "+ 0.05::DOUBLE * warning_count + 0.2::DOUBLE * fatal_count) AS raw FROM inc))")


def verdict_ctes(with_hits: bool) -> str:
    """ca: long cause rows; ve: one verdict per incident."""
    rows = []
    for i, (cause, key, _, _, feature, _) in enumerate(CAUSES):
        feat = f"least({feature}::DOUBLE, 5.0)" if feature else "0.0::DOUBLE"
        note = (f"CASE WHEN {feature} > 0 THEN {feature} || ' ERROR/FATAL line(s) counted by feature {feature}' END"
                if feature else "NULL::VARCHAR")
        if with_hits:
            points = (f"coalesce((SELECT sum(CASE WHEN contains(lower(h.source), '{key}') THEN "
                      "CASE h.rank WHEN 1 THEN 1.5::DOUBLE WHEN 2 THEN 1.0::DOUBLE WHEN 3 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END "
                      "* CASE WHEN h.position = 1 THEN 1.0 ELSE 0.5 END ELSE 0 END) "
                      "FROM hp h WHERE h.incident_no = aq.incident_no), 0.0)")
            rnotes = (f"coalesce((SELECT list('runbook ' || h.source ORDER BY h.position) FROM hp h "
                      f"WHERE h.incident_no = aq.incident_no AND contains(lower(h.source), '{key}')), []::VARCHAR[])")
        else:
            points, rnotes = "0.0::DOUBLE", "[]::VARCHAR[]"
        rows.append(
            f"SELECT incident_no, {i} AS no, {lit(cause)} AS cause, coalesce(log_{i}, 0) + {feat} AS direct, "
            f"{points} AS pts, list_filter(list_concat(list_transform(coalesce(nl_{i}, []), lambda x: x.v), "
            f"[{note}], {rnotes}), lambda x: x IS NOT NULL) AS notes FROM aq")
    return f"""
ca0 AS ({' UNION ALL '.join(rows)}),
ca AS (SELECT *, direct + pts AS total FROM ca0),
tot AS (SELECT incident_no, sum(total) AS all_total,
  string_agg(cause || ' ' || {fixed('total', 1)}, ', ' ORDER BY total DESC, no) FILTER (WHERE total > 0) AS listing,
  string_agg(cause || '=' || printf('%.2f', {rnd('total', 2)}), ',' ORDER BY no) AS cause_scores
  FROM ca GROUP BY incident_no),
best AS (SELECT * FROM ca WHERE direct >= 1.5 QUALIFY row_number() OVER (PARTITION BY incident_no ORDER BY total DESC, no) = 1),
v0 AS (SELECT aq.*, so.anomaly_score, so.is_anomaly, b.cause AS top, b.total AS top_total, b.notes AS top_notes,
  t.all_total, t.listing, t.cause_scores,
  (error_count > 0 OR fatal_count > 0 OR warning_count > 0 OR coalesce(any_severe, false)) AS trouble,
  CASE WHEN t.all_total > 0 THEN b.total / t.all_total ELSE 0 END AS share
  FROM aq JOIN so USING (incident_no) JOIN tot t USING (incident_no) LEFT JOIN best b USING (incident_no)),
v1 AS (SELECT *, (NOT is_anomaly AND NOT trouble) AS quiet, (is_anomaly OR trouble) AS suspect FROM v0),
v2 AS (SELECT *, CASE WHEN quiet THEN {lit(NO_INCIDENT)} WHEN top IS NULL AND suspect THEN {lit(UNDETERMINED)}
    WHEN top IS NULL THEN {lit(NO_INCIDENT)} ELSE top END AS root_cause,
  CASE WHEN quiet THEN least(0.9::DOUBLE, greatest(0.5::DOUBLE, 0.9::DOUBLE - 0.5::DOUBLE * anomaly_score))
    WHEN top IS NULL AND suspect THEN 0.2::DOUBLE + 0.2::DOUBLE * anomaly_score
    WHEN top IS NULL THEN 0.5::DOUBLE
    ELSE least(0.95::DOUBLE, greatest(0.05::DOUBLE, 0.4::DOUBLE * share + 0.35::DOUBLE * least(1.0::DOUBLE, top_total / 8.0::DOUBLE)
      + 0.25::DOUBLE * anomaly_score)) END AS conf FROM v1),
ve AS (SELECT *, {rnd('conf', 2)} AS confidence,
  concat_ws({NL},
    CASE WHEN listing IS NOT NULL THEN 'Root-cause scores: ' || listing END,
    CASE WHEN quiet THEN {lit(REASON_NORMAL)} WHEN top IS NULL THEN {lit(REASON_NO_DIRECT)}
      ELSE top || ' has the strongest combined evidence (' || {percent('share')} || ' of all matched evidence).' END,
    CASE WHEN NOT quiet AND top IS NOT NULL AND len(top_notes) > 0 THEN
      'Supported by: ' || array_to_string(top_notes[1:4], '; ') END,
    'ML anomaly score ' || {fixed('anomaly_score', 2)} || ': ' || CASE WHEN is_anomaly THEN 'abnormal' ELSE 'normal' END
      || ' compared with training windows.',
    {lit(DISCLAIMER)}) AS explanation,
  CASE root_cause {' '.join(f"WHEN {lit(n)} THEN {lit(chr(10).join(a))}" for n, a in
       [(c[0], c[5]) for c in CAUSES] + list(GENERAL_RECOMMENDATIONS.items()))} END AS recommendations FROM v2)"""


# Hits of every search of every incident; equal texts are searched once.
HITS = """
se AS (SELECT i.incident_no, su.search_no, su.query FROM su JOIN inc i USING (time_window)
  UNION ALL SELECT incident_no, 99, auto_query FROM aq),
qs AS (SELECT DISTINCT query AS q, query AS txt FROM se),""" + hybrid_ctes("rb", "qs") + """,
hs0 AS (SELECT se.incident_no, se.search_no, h.rank, h.source, h.k FROM se JOIN hit h ON h.q = se.query),
hs1 AS (SELECT * FROM hs0 QUALIFY row_number() OVER (PARTITION BY incident_no, k ORDER BY search_no, rank) = 1),
hp AS (SELECT *, row_number() OVER (PARTITION BY incident_no ORDER BY search_no, rank) AS position FROM hs1)"""

FACTORS = "fc0 AS (" + " UNION ALL ".join(
    f"SELECT incident_no, {i} AS no, '{c}' AS feature, {c}::DOUBLE AS value, "
    f"{c}::DOUBLE * {0.01 * (i + 1) * (1 if i % 2 == 0 else -1)!r}::DOUBLE AS c FROM inc"
    for i, c in enumerate(FEATURES)) + f"""),
fc1 AS (SELECT *, sum(abs(c) ORDER BY no) OVER (PARTITION BY incident_no ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS tt FROM fc0),
fc2 AS (SELECT *, abs(c) / CASE WHEN tt = 0 THEN 1.0::DOUBLE ELSE tt END AS sh,
  row_number() OVER (PARTITION BY incident_no ORDER BY abs(c) DESC, no) AS rank FROM fc1),
fc AS (SELECT incident_no, rank::INT AS rank, feature, value, {rnd('c', 4)} AS contribution,
  CASE WHEN c > 0 THEN 'increases' ELSE 'decreases' END AS direction, {rnd('sh', 4)} AS share,
  CASE WHEN sh >= 0.6 THEN 'Strong' WHEN sh >= 0.3 THEN 'Medium' ELSE 'Weak' END AS strength FROM fc2)"""


def report_sql() -> str:
    labels = ", ".join(f"CASE WHEN {f} > 0 THEN {f} || ' {label}' END" for f, label in FEATURE_LABELS)
    items = f"""
fi AS (SELECT incident_no, list('ML factor: ' || replace(feature, '_', ' ') || ' = ' || value::VARCHAR || ' ('
  || lower(strength) || ' contribution)' ORDER BY rank) AS fl FROM fc WHERE rank <= 3 AND direction = 'increases' GROUP BY 1),
rs AS (SELECT incident_no, list(source ORDER BY p) AS runbooks FROM
  (SELECT incident_no, source, min(position) AS p FROM hp GROUP BY ALL) GROUP BY 1),
sl AS (SELECT incident_no, string_agg(similar_id || ':' || printf('%.4f', similarity), ',' ORDER BY rank) AS txt,
  max(CASE WHEN rank = 1 THEN CASE WHEN similarity >= 0.3 THEN 'Most similar incident: ' || similar_id || ' (similarity '
    || {fixed('similarity', 2)} || ')' ELSE 'No close match among other incidents (best similarity '
    || {fixed('similarity', 2)} || ')' END END) AS best FROM sims GROUP BY 1),
fm AS (SELECT incident_no, 'shap: ' || string_agg(feature || ' ' || printf('%.4f', contribution + 0.0), ', ' ORDER BY rank) AS ml
  FROM fc WHERE rank <= 5 GROUP BY 1),
sp2 AS (SELECT time_window, list('Check ' || signal || ': ' || n || ' WARN/ERROR/FATAL line(s) mention it' ORDER BY search_no) AS ps
  FROM su GROUP BY 1),
rp AS (SELECT ve.*, coalesce(fl, []) AS fl, coalesce(rs.runbooks, []) AS rbs, sl.txt AS sim_txt, sl.best, coalesce(ps, []) AS ps,
  coalesce(severe_lines, []) AS sv, ml AS ml_explanation,
  list_filter([{labels}, CASE WHEN fatal_count > 0 THEN fatal_count || ' FATAL line(s) in the window' END,
    CASE WHEN error_ratio >= 0.1 THEN 'Error ratio is ' || {percent('error_ratio')} || ' of all lines' END],
    lambda x: x IS NOT NULL) AS lg
  FROM ve LEFT JOIN fi USING (incident_no) LEFT JOIN fm USING (incident_no) LEFT JOIN rs USING (incident_no) LEFT JOIN sl USING (incident_no)
  LEFT JOIN sp2 USING (time_window)),
rq AS (SELECT *, list_concat(['ML anomaly score ' || {fixed('anomaly_score', 2)} || ' (' || CASE WHEN is_anomaly
    THEN 'ABOVE' ELSE 'below' END || ' the anomaly threshold)'], fl, lg, sv,
  list_transform(rbs, lambda s: 'Runbook match: ' || s), CASE WHEN best IS NULL THEN [] ELSE [best] END) AS ev,
  list_concat(['ml'], list_transform(fl, lambda x: 'ml'), list_transform(lg, lambda x: 'log'),
    list_transform(sv, lambda x: 'log'), list_transform(rbs, lambda x: 'runbook'),
    CASE WHEN best IS NULL THEN [] ELSE ['history'] END) AS kinds,
  list_concat([{', '.join(f"struct_pack(t := '{t}', p := {lit(p)})" for t, p in PLAN_HEAD)}],
    list_transform(ps, lambda x: struct_pack(t := 'search_runbook', p := x)),
    [{', '.join(f"struct_pack(t := '{t}', p := {lit(p)})" for t, p in (PLAN_AUTO, PLAN_TAIL))}]) AS pl FROM rp)"""
    return ctes(*CASES, SCORE, RB, HITS, verdict_ctes(True), FACTORS, *similar_ctes(), items) + f"""
SELECT incident_no, incident_id, time_window AS window_start, anomaly_score, is_anomaly, root_cause, confidence,
  array_to_string(ev, {NL}) AS evidence, array_to_string(kinds, ',') AS evidence_types, explanation, recommendations,
  cause_scores, array_to_string(rbs, ',') AS runbooks, coalesce(sim_txt, '') AS similar_incidents,
  concat_ws({NL}, CASE WHEN logs_per_window > {MAX_LOG_LINES} THEN 'Only the {MAX_LOG_LINES} most severe of '
    || logs_per_window || ' log lines were analysed.' END,
    CASE WHEN len(rbs) = 0 THEN {lit(LIMIT_NO_RUNBOOK)} END) AS limitations, ml_explanation,
  array_to_string(list_transform(pl, lambda x, i: i || ' ' || x.t || ': ' || x.p), {NL}) AS plan FROM rq"""


_PHRASES = ["DataNode heartbeat failure", "network timeout", "something feels slow",
            "disk full, no space left", "replication pending error on storage"]
# Questions: those that name an incident (byid), and the others (free).
QUESTIONS = f"""
ut AS (SELECT conv_id * 100 + turn AS query_id, text FROM conversations WHERE role = 'user'),
uq AS (SELECT query_id, {strip("CASE WHEN query_id % 5 = 1 THEN 'please look at inc-' || (query_id % 4999) || ' for me' "
      f"WHEN query_id % 3 = 0 THEN [{', '.join(lit(p) for p in _PHRASES)}][query_id % {len(_PHRASES)} + 1] || ' ' || text ELSE text END")} AS txt FROM ut),
un AS (SELECT *, regexp_extract(txt, {lit(r'(?i)(\bINC[-_ ]?\d+\b)')}, 1) AS raw FROM uq WHERE txt <> ''),
byid AS (SELECT query_id, txt, try_cast(regexp_extract(raw, '(\\d+)$', 1) AS BIGINT) AS no FROM un WHERE raw <> ''),
free AS (SELECT query_id, txt FROM un WHERE raw = '')""".replace("(\\\\d+)", "(\\d+)")
CAUSE_DOCS = ("cd AS (SELECT doc_id AS k, [" + ", ".join(lit(c[1]) for c in CAUSES) + f"][doc_id % {len(CAUSES)} + 1] || '_' || doc_id || '.md' AS source, "
              "text AS content FROM documents)")


def free_ctes(searched: bool) -> list[str]:
    """Reports fv of the free questions; without a search there are no hits."""
    if searched:
        hits = ["fqs AS (SELECT DISTINCT txt AS q, txt FROM free)", hybrid_ctes("cd", "fqs"), """
fh AS (SELECT f.query_id, h.rank, h.source, row_number() OVER (PARTITION BY f.query_id ORDER BY h.rank) AS position FROM free f JOIN hit h ON h.q = f.txt)"""]
        hits = [CAUSE_DOCS, *hits]
    else:
        hits = ["fh AS (SELECT query_id, 0 AS rank, txt AS source, 0 AS position FROM free WHERE false)"]
    rows = " UNION ALL ".join(
        f"SELECT query_id, {i} AS no, {lit(c[0])} AS cause, "
        f"CASE WHEN regexp_matches(txt, {lit('(?i)' + c[2])}) THEN 2.0::DOUBLE ELSE 0 END + "
        f"CASE WHEN regexp_matches(txt, {lit('(?i)' + c[3])}) THEN 1.0::DOUBLE ELSE 0 END AS direct, "
        f"coalesce((SELECT sum(CASE h.rank WHEN 1 THEN 1.5::DOUBLE WHEN 2 THEN 1.0::DOUBLE WHEN 3 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END "
        f"* CASE WHEN h.position = 1 THEN 1.0 ELSE 0.5 END) FROM fh h WHERE h.query_id = free.query_id AND contains(lower(h.source), '{c[1]}')), 0.0) AS pts, "
        f"list_concat(CASE WHEN regexp_matches(txt, {lit('(?i)' + c[2])}) THEN ['matches your description'] ELSE [] END, "
        f"coalesce((SELECT list('runbook ' || h.source ORDER BY h.position) FROM fh h WHERE h.query_id = free.query_id "
        f"AND contains(lower(h.source), '{c[1]}')), []::VARCHAR[])) AS notes FROM free"
        for i, c in enumerate(CAUSES))
    return hits + [f"""
fs AS (SELECT *, direct + pts AS total FROM ({rows})),
fa AS (SELECT query_id, sum(total) AS tt, string_agg(cause || ' ' || {fixed('total', 1)}, ', ' ORDER BY total DESC, no) FILTER (WHERE total > 0) AS listing,
  string_agg(cause || '=' || printf('%.2f', {rnd('total', 2)}), ',' ORDER BY no) AS cause_scores FROM fs GROUP BY 1),
fb AS (SELECT * FROM fs WHERE direct >= 1.5 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY total DESC, no) = 1),
fr2 AS (SELECT query_id, list(source ORDER BY p) AS rbs FROM (SELECT query_id, source, min(position) AS p FROM fh GROUP BY ALL) GROUP BY 1),
fv AS (SELECT f.query_id, f.txt, coalesce(fb.cause, {lit(UNDETERMINED)}) AS root_cause,
  {rnd('CASE WHEN fb.cause IS NULL THEN 0.2::DOUBLE ELSE least(0.95::DOUBLE, greatest(0.05::DOUBLE, 0.4::DOUBLE * (fb.total / fa.tt) + 0.35::DOUBLE * least(1.0::DOUBLE, fb.total / 8.0::DOUBLE))) END', 2)} AS confidence,
  concat_ws({NL}, CASE WHEN listing IS NOT NULL THEN 'Root-cause scores: ' || listing END,
    CASE WHEN fb.cause IS NULL THEN {lit(REASON_NO_DIRECT)} ELSE fb.cause || ' has the strongest combined evidence (' || {percent('fb.total / fa.tt')} || ' of all matched evidence).' END,
    CASE WHEN len(fb.notes) > 0 THEN 'Supported by: ' || array_to_string(fb.notes[1:4], '; ') END, {lit(DISCLAIMER)}) AS explanation,
  cause_scores, coalesce(rbs, []) AS rbs FROM free f JOIN fa USING (query_id) LEFT JOIN fb USING (query_id) LEFT JOIN fr2 USING (query_id))"""]


def analyze_sql() -> str:
    advice = "CASE root_cause " + " ".join(f"WHEN {lit(n)} THEN {lit(chr(10).join(a))}" for n, a in
                                           [(c[0], c[5]) for c in CAUSES] + list(GENERAL_RECOMMENDATIONS.items())) + " END"
    kept = ["window_start", "anomaly_score", "is_anomaly", "root_cause", "confidence", "evidence", "evidence_types", "explanation", "recommendations",
            "cause_scores", "runbooks", "similar_incidents", "limitations", "ml_explanation", "plan"]
    return ctes(f"rep AS ({report_sql()})", QUESTIONS, *free_ctes(True)) + f"""
SELECT b.query_id, b.txt AS query, incident_id, incident_id IS NOT NULL AS found, {', '.join(kept)} FROM byid b LEFT JOIN rep ON rep.incident_no = b.no
UNION ALL
SELECT query_id, txt, NULL, true, NULL, NULL, NULL, root_cause, confidence,
  array_to_string(list_transform(rbs, lambda s: 'Runbook match: ' || s), {NL}), array_to_string(list_transform(rbs, lambda s: 'runbook'), ','),
  explanation, {advice}, cause_scores, array_to_string(rbs, ','), '', CASE WHEN len(rbs) = 0 THEN {lit(LIMIT_NO_RUNBOOK)} ELSE '' END,
  NULL, {lit(NL_PLAN)} FROM fv"""


def log_sql() -> str:
    """Entries lg of the investigation log: reports of even and odd incidents, and answers, each as of its time."""
    return ctes(*CASES, SCORE, verdict_ctes(False), QUESTIONS, *free_ctes(False)) + f""",
lg AS (SELECT incident_no AS entry, incident_id, NULL::VARCHAR AS query, root_cause, confidence, anomaly_score,
    CASE WHEN incident_no % 2 = 0 THEN '2035-03-01 10:00:00' ELSE '2035-03-02 10:00:00' END AS generated_at FROM ve
  UNION ALL SELECT b.query_id, v.incident_id, CASE WHEN v.incident_id IS NULL THEN b.txt END, v.root_cause, v.confidence, v.anomaly_score, '2035-03-03 12:00:00'
    FROM byid b LEFT JOIN ve v ON v.incident_no = b.no
  UNION ALL SELECT query_id, NULL, txt, root_cause, confidence, NULL, '2035-03-03 12:00:00' FROM fv)
"""


def metric_ctes(src: str) -> str:
    """Curve and one-row ranking metrics from src(label, anomaly_score)."""
    return f"""
g AS (SELECT anomaly_score AS s, sum(label)::DOUBLE AS p, sum(1 - label)::DOUBLE AS n FROM {src} GROUP BY 1),
cu AS (SELECT *, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS fp,
  sum(p) OVER () AS p0, sum(n) OVER () AS n0 FROM g),
rk AS (SELECT round(sum(n / n0 * (tp - p / 2) / p0), 6) AS roc_auc, round(sum(p / p0 * tp / (tp + fp)), 6) AS pr_auc FROM cu)"""


def quantile_row(q: float) -> str:
    return f"SELECT {q}::DOUBLE AS q, " + ", ".join(
        f"round(quantile_cont({c}::DOUBLE, {q}), 6) AS {c}" for c in FEATURES) + " FROM feats"


SPOILT = {
    "error_count": "CASE WHEN hour(time_window) = 3 THEN NULL ELSE error_count::DOUBLE END",
    "error_ratio": "CASE WHEN hour(time_window) = 4 THEN NULL ELSE error_ratio END",
    "warning_ratio": "CASE WHEN hour(time_window) = 5 THEN NULL ELSE warning_ratio END",
    "logs_per_window": "CASE WHEN hour(time_window) = 6 THEN NULL ELSE logs_per_window::DOUBLE END",
    "fatal_count": "NULL::DOUBLE",
}
LABELLED = ("ls AS (SELECT doc_id, toxic AS label, (n_chars % 1000)::DOUBLE / 1000.0::DOUBLE AS anomaly_score "
            "FROM documents JOIN labels USING (doc_id))")


def _valid_ctes(src: str = "SELECT * FROM stamped", absent: tuple[str, ...] = ()) -> list[str]:
    """The report row `vd` of the lines that `src` selects; columns in `absent` are taken for missing."""
    cols = [c for c in ["LineId", "Date", "Time", "Pid", "Level", "Component", "Content", "EventId", "EventTemplate"] if c not in absent]
    listing = "concat_ws(', ', " + ", ".join(
        f"CASE WHEN count(*) FILTER (WHERE \"{c}\" IS NULL) > 0 THEN '{c}=' || count(*) FILTER (WHERE \"{c}\" IS NULL) END"
        for c in cols) + ")"
    bad = "false" if "Level" in absent else (f"\"Level\" IS NOT NULL AND upper({strip(chr(34) + 'Level' + chr(34))}) NOT IN "
                                             "('INFO', 'WARN', 'WARNING', 'ERROR', 'FATAL', 'DEBUG')")
    missing = "NULL" if not absent else lit("Missing required columns: " + ", ".join(absent))
    return [f"""
vs AS ({src}),
va AS (SELECT count(*) AS n, {listing} AS nulls, count(*) FILTER (WHERE "Timestamp" IS NULL) AS bt,
  count(*) FILTER (WHERE {bad}) AS bl, count(*) - count(DISTINCT "LineId") AS dl FROM vs),
vb AS (SELECT count(*) AS u FROM (SELECT DISTINCT {', '.join(f'"{c}"' for c in cols)} FROM vs)),
vc AS (SELECT *, n - u AS dr FROM va, vb),
vd AS (SELECT *, concat_ws(' | ', {missing}, CASE WHEN n = 0 THEN 'DataFrame is empty.' END,
    CASE WHEN n > 0 AND bt = n THEN 'No valid timestamps found.' END) AS errors,
  concat_ws(' | ', CASE WHEN nulls <> '' THEN 'Missing values: ' || nulls END,
    CASE WHEN dr > 0 THEN dr || ' duplicate rows' END, CASE WHEN dl > 0 THEN dl || ' duplicate LineIds' END,
    CASE WHEN bt > 0 AND bt < n THEN bt || ' invalid timestamps' END,
    CASE WHEN bl > 0 THEN bl || ' invalid log levels' END) AS warnings FROM vc)"""]


def _valid_sql(absent: tuple[str, ...] = ()) -> str:
    return ctes(LOG, STAMPED, *_valid_ctes(absent=absent)) + f"""
SELECT (errors = '' AND warnings = '') AS is_valid, errors = '' AS can_process, errors, warnings,
  {lit(" | ".join(absent))} AS missing_columns, nulls AS missing_values, n::BIGINT AS n_rows, dr::BIGINT AS duplicate_rows,
  dl::BIGINT AS duplicate_line_ids, bt::BIGINT AS invalid_timestamps, bl::BIGINT AS invalid_log_levels FROM vd"""


def _gate_sql() -> str:
    parts = []
    for name, src, absent in (("whole", "SELECT * FROM stamped", ()), ("no_level", "SELECT * FROM stamped", ("Level",)),
                              ("sound", "SELECT * FROM stamped WHERE pos = 0 AND \"Level\" IS NOT NULL AND \"Time\" <> '999999'", ())):
        failed = "CASE WHEN errors <> '' THEN 'Validation failed: ' || replace(errors, ' | ', '; ') END"
        strictly = f"coalesce({failed}, CASE WHEN warnings <> '' THEN 'Strict validation failed: ' || replace(warnings, ' | ', '; ') END)"
        parts.append("(" + ctes(*_valid_ctes(src, absent)) + f"SELECT '{name}' AS input, 'lenient' AS mode, {failed} AS reason FROM vd "
                     f"UNION ALL SELECT '{name}', 'strict', {strictly} FROM vd)")
    return ctes(LOG, STAMPED) + "SELECT input, mode, reason IS NULL AS passed, reason FROM (" + " UNION ALL ".join(parts) + ")"


def build() -> dict[str, str]:
    sql: dict[str, str] = {}
    lines, base = ctes(*TO_LINES), ctes(*BASE)
    feats = ctes(*TO_LINES, FEATS)
    feat_cols = ", ".join(f"round({c}, 6) AS {c}" if c.endswith("_ratio") else c for c in FEATURES)

    sql["validate_report"] = _valid_sql()
    sql["validate_missing_columns"] = _valid_sql(("Level", "EventTemplate"))
    sql["validation_gate"] = _gate_sql()
    sql["null_counts"] = ctes(LOG) + "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE \"{c}\" IS NULL)::BIGINT AS null_count FROM log"
        for c in ["LineId", "Date", "Time", "Pid", "Level", "Component", "Content", "EventId",
                  "EventTemplate"]) + ") WHERE null_count > 0"
    sql["duplicate_rows"] = ctes(LOG) + (
        f"SELECT ((SELECT count(*) FROM log) - count(*))::BIGINT AS duplicate_rows FROM (SELECT DISTINCT {RAW_COLS} FROM log)")
    sql["duplicate_line_ids"] = ctes(LOG) + (
        "SELECT (count(*) - count(DISTINCT \"LineId\"))::BIGINT AS duplicate_line_ids FROM log")
    sql["invalid_timestamps"] = ctes(LOG, STAMPED) + (
        "SELECT count(*) FILTER (WHERE \"Timestamp\" IS NULL)::BIGINT AS invalid_timestamps FROM stamped")
    sql["invalid_levels"] = ctes(LOG) + (
        "SELECT count(*) FILTER (WHERE lv IS NOT NULL AND upper(trim(lv)) NOT IN "
        "('INFO','WARN','WARNING','ERROR','FATAL','DEBUG'))::BIGINT AS invalid_log_levels FROM "
        "(SELECT CASE WHEN \"LineId\" % 13 = 0 THEN 'BOGUS' ELSE \"Level\" END AS lv FROM log)")
    sql["clean_logs"] = ctes(LOG, STAMPED, CLEAN) + f"SELECT {RAW_COLS}, pos FROM cleaned"
    sql["parsed_logs"] = ctes(LOG, STAMPED) + (
        'SELECT "LineId", pos, "Date", "Time", "Timestamp", hour("Timestamp")::INT AS hour, '
        'minute("Timestamp")::INT AS minute, second("Timestamp")::INT AS second FROM stamped')
    sql["normalized_levels"] = ctes(LOG) + f'SELECT "LineId", pos, {level()} AS "Level" FROM log'
    norm = f"upper({strip('coalesce(' + chr(34) + 'Level' + chr(34) + ', ' + lit('UNKNOWN') + ')')})"
    sql["signal_flags"] = ctes(LOG) + (
        f'SELECT "LineId", pos, {flag_columns(norm, chr(34) + "Content" + chr(34))} FROM log')
    sql["preprocessed_logs"] = lines + (
        'SELECT "LineId", "Timestamp", time_window, "Level", "Component", "Pid", "EventId", "Content" FROM lines')
    sql["masked_text"] = ctes(LOG) + f"SELECT \"LineId\", pos, {mask(chr(34) + 'Content' + chr(34))} AS masked FROM log"

    sql["window_features"] = feats + f"SELECT time_window, {feat_cols} FROM feats"
    sql["stream_window_features"] = sql["window_features"]
    sql["level_counts"] = lines + 'SELECT time_window, "Level", count(*)::BIGINT AS n FROM lines GROUP BY ALL'
    sql["signal_counts"] = ctes(*TO_LINES, SIG) + "SELECT * FROM sigs"
    sql["component_lists"] = lines + (
        "SELECT time_window, array_to_string(list_sort(list(DISTINCT \"Component\"))[1:10], ' | ') AS components "
        "FROM lines WHERE \"Component\" IS NOT NULL GROUP BY time_window")
    sql["value_counts"] = ctes(LOG, f'nl AS (SELECT * REPLACE ({level()} AS "Level") FROM log)') + " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{c}' AS column_name, \"{c}\" AS value, count(*)::BIGINT AS n FROM nl "
        f"WHERE \"{c}\" IS NOT NULL GROUP BY \"{c}\" ORDER BY n DESC, value LIMIT 10)"
        for c in ("Level", "Component", "EventId"))
    sql["zscores"] = ctes(*TO_LINES, FEATS, zstats()) + "SELECT time_window, " + ", ".join(
        f"round(({c}::DOUBLE - m_{c}) / s_{c}, 6) AS {c}" for c in FEATURES) + " FROM feats, zs"
    sql["feature_quantiles"] = feats + " UNION ALL ".join(quantile_row(q) for q in (0.05, 0.5, 0.95))
    spoilt = ", ".join(f"{SPOILT.get(c, c + '::DOUBLE')} AS {c}" for c in FEATURES)
    sql["imputed_features"] = ctes(*TO_LINES, FEATS, f"sp AS (SELECT time_window, {spoilt} FROM feats)",
                                   "md AS (SELECT " + ", ".join(
                                       f"coalesce(median({c}), 0) AS m_{c}" for c in FEATURES) + " FROM sp)") + (
        "SELECT time_window, " + ", ".join(f"round(coalesce({c}, m_{c}), 6) AS {c}" for c in FEATURES)
        + " FROM sp, md")

    listing = ("SELECT incident_no, incident_id, time_window AS window_start, logs_per_window AS n_logs, "
               "fatal_count, error_count, warning_count FROM inc ORDER BY ")
    sql["incident_list_time"] = base + listing + "incident_no"
    sql["incident_list_severity"] = base + listing + (
        "fatal_count DESC, error_count DESC, warning_count DESC, incident_no LIMIT 100")
    sql["incident_count"] = base + "SELECT count(*)::BIGINT AS n_incidents FROM inc"
    sql["incident_summary"] = ctes(*BASE, SIG, """
lv AS (SELECT time_window, string_agg("Level" || '=' || n, ',' ORDER BY "Level") AS level_counts FROM
  (SELECT time_window, "Level", count(*) AS n FROM lines GROUP BY ALL) GROUP BY 1),
ct AS (SELECT time_window, count(*) FILTER (WHERE "Level" = 'ERROR') AS e, count(*) FILTER (WHERE "Level" = 'WARN') AS w,
  count(*) FILTER (WHERE "Level" = 'FATAL') AS f,
  array_to_string(list_sort(list(DISTINCT "Component"))[1:10], ' | ') AS components FROM lines GROUP BY 1)""") + (
        "SELECT incident_no, incident_id, time_window AS window_start, time_window + INTERVAL '10 minutes' AS window_end, "
        "logs_per_window AS n_logs, level_counts, e::BIGINT AS n_errors, w::BIGINT AS n_warnings, f::BIGINT AS n_fatal, components, "
        + ", ".join(f"{s} AS {s}_lines" for s in SIGNAL_NAMES)
        + " FROM inc JOIN lv USING (time_window) JOIN ct USING (time_window) JOIN sigs USING (time_window)")
    chrono = ('SELECT l."LineId", l."Timestamp", l."Level", l."Component", l."Pid", l."EventId", l."Content", '
              "i.incident_no, i.incident_id FROM lines l JOIN inc i USING (time_window)")
    sql["incident_lines_chrono"] = base + chrono
    sql["incident_first_lines"] = base + chrono + (
        ' QUALIFY row_number() OVER (PARTITION BY time_window ORDER BY "Timestamp", "LineId") <= 2')
    sql["incident_top_lines"] = ctes(*BASE, SHOWN) + f"""
SELECT line_no::INT AS line_no, "LineId", "Timestamp", "Level", component, event_id, content, incident_no, incident_id,
  logs_per_window AS total_logs, least(logs_per_window, {MAX_LOG_LINES})::BIGINT AS shown FROM shown JOIN inc USING (time_window)"""
    sql["incident_feature_rows"] = base + (
        f"SELECT incident_id, time_window, {feat_cols} FROM inc WHERE incident_no = 3")
    sql["resolve_ids"] = base + r"""
SELECT a.raw_id, i.incident_id, i.incident_id IS NOT NULL AS found FROM
  (SELECT unnest(['inc_' || incident_no, ' INC ' || incident_no || ' ', 'Inc-000' || incident_no, incident_no::VARCHAR,
    'INC-9' || lpad(incident_no::VARCHAR, 9, '0'), 'INC-' || incident_no || 'x']) AS raw_id FROM inc) a
LEFT JOIN inc i ON i.incident_no = try_cast(nullif(regexp_extract(a.raw_id, '(?i)^\s*(?:INC[-_ ]?)?0*(\d+)\s*$', 1), '') AS BIGINT)"""
    sql["similar_incidents"] = ctes(*BASE, *similar_ctes()) + "SELECT * FROM sims"

    dirty = ("replace(text, '. ', '.  ' || chr(13) || chr(10) || chr(9) || '---- ' || chr(13) || chr(10) || repeat(chr(10), 3))")
    sql["clean_text"] = f"SELECT doc_id, md5(c) AS digest, length(c)::INT AS n FROM (SELECT doc_id, {clean_md(dirty)} AS c FROM documents)"
    sql["token_lists"] = (f"SELECT doc_id, len(t)::INT AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM "
                          f"(SELECT doc_id, {tokens('text')} AS t FROM documents)")
    sql["sections"] = ctes(SECTIONS) + (
        "SELECT source, section_no, h1, h2, h3, length(body)::INT AS n, md5(body) AS digest FROM sec")
    sql["section_numbers"] = ctes(SECTIONS) + (
        "SELECT source, section_no, (row_number() OVER (ORDER BY source, section_no) - 1)::BIGINT AS chunk_id "
        "FROM sec WHERE length(body) >= 20")
    sql["chunks"] = "WITH RECURSIVE " + SECTIONS + "," + SIZE_SPLIT + (
        " SELECT chunk_id, chunk.source, h1, h2, h3, t AS content FROM chunk JOIN sec USING (source, section_no)")
    sql["document_names"] = ("SELECT 'doc_' || doc_id AS source, "
                             "length('# doc_' || doc_id || chr(10) || text)::INT AS n FROM documents")

    sql["term_weights"] = ctes(DOCS, BQ, bm25_ctes("docs", "bq")) + "SELECT t AS term, df, round(idf, 6) AS idf FROM ti"
    sql["text_embeddings"] = ctes(embed_ctes("dv", "documents", "doc_id", "text")) + (
        "SELECT k AS doc_id, dim, round(v, 6) AS v FROM dv")
    sql["bm25_top"] = ctes(DOCS, BQ, bm25_ctes("docs", "bq")) + (
        "SELECT q AS query_id, k AS chunk_id, round(s, 6) AS bm25_score, r::INT AS sparse_rank FROM sp")
    sql["dense_knn"] = """
SELECT query_id, rank::INT AS rank, point_id, round(d2, 6) AS distance FROM (
  SELECT a.vec_id AS query_id, b.vec_id AS point_id,
    list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE))) AS d2,
    row_number() OVER (PARTITION BY a.vec_id ORDER BY round(sqrt(d2), 9), b.vec_id) AS rank
  FROM embeddings a, embeddings b QUALIFY rank <= 3)"""
    hybrid = ctes(DOCS, BQ, hybrid_ctes("docs", "bq"))
    sql["hybrid_top"] = hybrid + (
        "SELECT q AS query_id, rank::INT AS rank, source, k AS chunk_id, round(d2, 6) AS dense_distance, "
        "round(s, 6) AS bm25_score, round(rrf, 9) AS rrf_score FROM hit")
    block = "'[Source ' || rank || ': ' || source || ']' || chr(10) || content"
    sql["context_blocks"] = ctes(DOCS, BQ, hybrid_ctes("docs", "bq"), f"""
bl AS (SELECT q, rank, {block} AS b, sum(length({block})) OVER (PARTITION BY q ORDER BY rank) AS tot FROM hit)""") + (
        "SELECT q AS query_id, length(c)::INT AS n, md5(c) AS digest FROM (SELECT q, "
        "string_agg(b, chr(10) || chr(10) ORDER BY rank) AS c FROM bl WHERE rank = 1 OR tot <= 6000 GROUP BY q)")
    sql["retrieval_stats"] = hybrid + (
        "SELECT bq.q AS query_id, count(hit.k)::BIGINT AS number_of_results, "
        "coalesce(string_agg(source, ' | ' ORDER BY rank), '') AS sources FROM bq LEFT JOIN hit ON hit.q = bq.q GROUP BY bq.q")
    sql["retrieval_eval"] = ctes(DOCS, EXPECTED, hybrid_ctes("docs", "ex", "1e300", "0.0"), FIRST_RANK) + (
        "SELECT count(*)::BIGINT AS n_queries, round(avg(coalesce(r = 1, false)::INT), 6) AS top_1_accuracy, "
        "round(avg((r IS NOT NULL)::INT), 6) AS top_k_recall, 3::INT AS top_k, round(avg(coalesce(1.0::DOUBLE / r, 0)), 6) AS mrr FROM fr")
    sql["retrieval_cases"] = ctes(DOCS, EXPECTED, hybrid_ctes("docs", "ex", "1e300", "0.0"), FIRST_RANK) + (
        "SELECT ex.q AS query_id, e AS expected_source, r::INT AS first_rank, coalesce(r = 1, false) AS hit_at_1, "
        "r IS NOT NULL AS hit_at_k, round(coalesce(1.0::DOUBLE / r, 0), 6) AS reciprocal_rank FROM ex JOIN fr ON fr.q = ex.q")
    sql["rejected_queries"] = """
WITH u AS (SELECT conv_id * 100 + turn AS n, text FROM conversations WHERE role = 'user'),
v AS (SELECT n, CASE WHEN n % 5 = 0 THEN '  ' || chr(9) WHEN n % 7 = 0 THEN '!!! ??' WHEN n % 11 = 0 THEN NULL ELSE text END AS q FROM u)
SELECT n AS query_id, CASE WHEN q IS NULL THEN 'Query must be a string.' WHEN trim(q, ' ' || chr(9)) = '' THEN 'Query cannot be empty.'
  ELSE 'Query has no searchable terms.' END AS reason FROM v
WHERE q IS NULL OR NOT regexp_matches(q, '[\\p{L}\\p{N}_]')""".replace("\\\\", "\\")

    cases = ctes(*CASES)
    sql["suspicious_queries"] = ctes(*TO_LINES, SIG, suspicious_cte()) + (
        "SELECT time_window, search_no::INT AS search_no, signal, n, query FROM su")
    sql["evidence_query"] = cases + "SELECT incident_no, auto_query FROM aq"
    sql["log_evidence"] = cases + "SELECT incident_no, " + ", ".join(
        f"log_{i}, array_to_string(list_transform(coalesce(nl_{i}, []), lambda x: x.v), ' | ') AS notes_{i}"
        for i in range(len(CAUSES))) + ", coalesce(array_to_string(severe_lines, ' | '), '') AS severe_lines FROM aq"
    sql["feature_evidence"] = base + " UNION ALL ".join(
        f"SELECT incident_no, {lit(c[0])} AS cause, " + (
            f"least({c[4]}::DOUBLE, 5.0::DOUBLE) AS points, CASE WHEN {c[4]} > 0 THEN {c[4]} || "
            f"' ERROR/FATAL line(s) counted by feature {c[4]}' ELSE '' END AS notes FROM inc" if c[4]
            else "0.0::DOUBLE AS points, '' AS notes FROM inc") for c in CAUSES)
    sql["root_cause"] = ctes(*CASES, SCORE, verdict_ctes(False)) + (
        "SELECT incident_no, root_cause, confidence, cause_scores, explanation, recommendations FROM ve")
    sql["incident_report"] = report_sql()
    plan_rows = " UNION ALL ".join(
        [f"SELECT incident_no, {i} AS o, '{t}' AS tool, {lit(p)} AS purpose FROM inc"
         for i, (t, p) in enumerate(PLAN_HEAD)]
        + ["SELECT incident_no, 10 + search_no, 'search_runbook', 'Check ' || signal || ': ' || n || "
           "' WARN/ERROR/FATAL line(s) mention it' FROM su JOIN inc USING (time_window)"]
        + [f"SELECT incident_no, {o}, '{t}', {lit(p)} FROM inc"
           for o, (t, p) in ((20, PLAN_AUTO), (30, PLAN_TAIL))])
    sql["investigation_plan"] = ctes(*BASE, SIG, suspicious_cte()) + (
        f"SELECT incident_no, row_number() OVER (PARTITION BY incident_no ORDER BY o)::INT AS step, tool, purpose FROM ({plan_rows})")
    sql["analyze_text"] = analyze_sql()

    sql["investigation_log"] = log_sql() + "SELECT * FROM lg"
    sql["latest_investigations"] = log_sql() + "SELECT * EXCLUDE (anomaly_score) FROM lg ORDER BY generated_at DESC, entry DESC, incident_id LIMIT 30"
    sql["calibrated_score"] = ctes(*TO_LINES, FEATS, """
dc AS (SELECT time_window, 0.3::DOUBLE - 0.05::DOUBLE * logs_per_window - 0.4::DOUBLE * error_ratio AS d FROM feats),
sd AS (SELECT greatest(stddev_pop(d), 1e-6) AS s FROM dc)""") + (
        "SELECT time_window, round(1 / (1 + exp(greatest(-50.0::DOUBLE, least(50.0::DOUBLE, d / s)))), 6) AS anomaly_score, "
        "d < 0 AS is_anomaly FROM dc, sd")
    sql["factor_ranking"] = ctes(*BASE, FACTORS) + (
        "SELECT incident_no, rank, feature, round(value, 6) AS value, contribution, direction, share, strength FROM fc")
    sql["factor_text"] = ctes(*BASE, FACTORS, """
rf AS (SELECT incident_no, '- ' || replace(feature, '_', ' ') || ' = ' || value::VARCHAR || ' → ' || strength AS t, rank,
  row_number() OVER (PARTITION BY incident_no ORDER BY rank) AS n FROM fc WHERE direction = 'increases'),
rt AS (SELECT incident_no, string_agg(t, chr(10) ORDER BY rank) AS t FROM rf WHERE n <= 4 GROUP BY 1)""") + (
        f"SELECT inc.incident_no, CASE WHEN t IS NULL THEN {lit(NO_RISING_TEXT)} ELSE {lit(RISING_HEADER)} || t END AS explanation "
        "FROM inc LEFT JOIN rt USING (incident_no)")

    sql["labeled_metrics"] = ctes(LABELLED, metric_ctes("ls"), """
cm AS (SELECT count(*)::BIGINT AS n_samples, sum(label)::BIGINT AS n_positive,
  count(*) FILTER (WHERE label = 1 AND anomaly_score > 0.5)::BIGINT AS tp, count(*) FILTER (WHERE label = 0 AND anomaly_score > 0.5)::BIGINT AS fp,
  count(*) FILTER (WHERE label = 1 AND anomaly_score <= 0.5)::BIGINT AS fn, count(*) FILTER (WHERE label = 0 AND anomaly_score <= 0.5)::BIGINT AS tn FROM ls)""") + (
        "SELECT n_samples, n_positive, tp, fp, fn, tn, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision, "
        "round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall, "
        "round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, "
        "round((tp + tn)::DOUBLE / n_samples, 6) AS accuracy, roc_auc, pr_auc FROM cm, rk")
    kinds = []
    for kind, label in (("toxic", "toxic"), ("poor", "1 - quality")):
        kinds.append(f"SELECT '{kind}' AS kind, roc_auc, pr_auc FROM (" + ctes(
            f"ls AS (SELECT {label} AS label, (n_chars % 97)::DOUBLE / 97.0::DOUBLE AS anomaly_score "
            "FROM documents JOIN labels USING (doc_id))", metric_ctes("ls")) + "SELECT * FROM rk)")
    sql["ranking_metrics"] = " UNION ALL ".join(kinds)
    sql["score_summary"] = ctes(LABELLED) + (
        "SELECT count(*)::BIGINT AS n_samples, round(avg((anomaly_score > 0.5)::INT), 6) AS anomaly_rate, "
        "round(avg(anomaly_score), 6) AS score_mean, round(quantile_cont(anomaly_score, 0.95), 6) AS score_p95, "
        "round(max(anomaly_score), 6) AS score_max FROM ls")
    sql["labelled_windows"] = feats + (
        "SELECT time_window, logs_per_window, error_count, (error_count > 1)::INT AS label FROM feats "
        "WHERE minute(time_window) % 20 = 0")
    sql["label_coverage"] = feats + (
        "SELECT count(*)::BIGINT AS n_windows, count(*) FILTER (WHERE minute(time_window) % 20 = 0)::BIGINT AS n_labelled, "
        "round(avg((minute(time_window) % 20 = 0)::INT), 6) AS coverage FROM feats")
    sql["similar_incidents_indexed"] = sql["similar_incidents"]
    sql["similar_incidents_blocks"] = sql["similar_incidents"]
    sql["bm25_blocks"] = sql["bm25_top"]
    sql["dense_knn_blocks"] = sql["dense_knn"]
    sql |= fixed_forest.oracle(feats, ctes(*BASE))
    sql |= round_trips.oracle(sql, ctes(LOG))
    sql["stream_scores"] = sql["fixed_forest_scores"]
    sql["training_rows"] = sql["window_features"]
    rows = f"least({SUBSAMPLE}, (SELECT count(*) FROM feats))::BIGINT"
    sql["forest_shape"] = feats + (
        f"SELECT {N_TREES}::BIGINT AS n_trees, {rows} AS root_rows, {N_TREES} * {rows} AS leaf_rows, {N_TREES}::BIGINT AS more_leaves, "
        "true AS within_depth, 0::BIGINT AS wrong_nodes")
    sql["training_summary"] = feats + (
        f"SELECT {N_TREES}::BIGINT AS n_estimators, {SEED}::BIGINT AS random_state, count(*) AS n_samples, {len(FEATURES)}::BIGINT AS n_features, "
        f"'{CONTAMINATION}' AS contamination_setting, true AS all_rows_scored, true AS same_rate, true AS within_setting FROM feats")
    return sql
