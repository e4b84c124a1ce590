"""The same results in SQL for DuckDB."""

from __future__ import annotations

from lateweave.functions.text import PY_WHITESPACE
from lateweave.schemas import DOMAINS, METRICS

_DOMAINS = "[" + ", ".join(f"'{d}'" for d in DOMAINS) + "]"
_STRIP = " || ".join(f"chr({ord(c)})" for c in PY_WHITESPACE)

_TOK = """tok AS (
  SELECT (vec_id // 8)::varchar AS id, (vec_id % 8)::int AS pos, embedding::double[] AS v, label
  FROM embeddings)"""

_WHOLE = "list_dot_product(list_transform(range(64), lambda i: (i + 1)::double), v)"
_LINEAR = ("1 / (1 + exp(-(list_dot_product("
           "list_transform(range(64), lambda i: (((i % 7) - 3) / 4.0)::double), v) + 0.5)))")
_RELU = ("greatest(list_dot_product(list_transform(range(64), "
         "lambda i: (((i % {m}) - {s}) / 2.0)::double), v) + ({b}), 0)")
_MLP = ("1 / (1 + exp(-(" + _RELU.format(m=5, s=2, b=0.1) + " - 0.5 * "
        + _RELU.format(m=3, s=1, b=-0.1) + " + 0.25)))")


def _scores(weight: str = "1.0", score: str = "sum(m * w)", split: str = "'all'",
            hide: str = "false") -> str:
    """CTEs up to ``scored(split, qid, doc_id, score)``: every query against its split."""
    return f"""WITH {_TOK},
  s AS (SELECT id, {split} AS split FROM tok WHERE pos = 0),
  side AS (SELECT tok.*, s.split, {weight} AS w, {hide} AS hide FROM tok JOIN s USING (id)),
  best AS (
    SELECT q.split, q.id AS qid, q.pos, any_value(q.w) AS w, d.id AS doc_id,
           max(CASE WHEN d.hide THEN -1e4 ELSE list_dot_product(q.v, d.v) END) AS m
    FROM side q JOIN side d ON q.split = d.split GROUP BY ALL),
  scored AS (SELECT split, qid, doc_id, {score} AS score FROM best GROUP BY ALL)"""


_NORM = "sum(m * w) / greatest(sum(w), 1e-6)"
_BY_DOMAIN = f"list_extract({_DOMAINS}, label + 1)"


def _ranked(k: int, **scores) -> str:
    return _scores(**scores) + f""",
  ranked AS (
    SELECT split, qid, doc_id, score,
           row_number() OVER (PARTITION BY split, qid ORDER BY score DESC, doc_id)::int AS rank
    FROM scored QUALIFY rank <= {k})"""


_OUT = "SELECT split, qid, doc_id, round(score, 6) AS score, rank FROM "

_EXCLUDED = """,
  kept AS (
    SELECT * EXCLUDE (rank),
           row_number() OVER (PARTITION BY split, qid ORDER BY rank)::int AS rank
    FROM ranked WHERE doc_id <> qid)"""

_GOLD = """,
  gold AS (SELECT DISTINCT s.split, id AS qid, (id::bigint + label + 1)::varchar AS doc_id
           FROM tok JOIN s USING (id))"""


def _metrics(ranking: str) -> str:
    """CTEs up to ``per_query``: one column per metric."""
    def column(metric: str) -> str:
        name, _, k = metric.partition("@")
        if name == "map":
            return f'coalesce(sum(hit / rank) / any_value(g), 0) AS "{metric}"'
        if name == "recall":
            return f'coalesce(sum((rank <= {k})::int) / any_value(g), 0) AS "{metric}"'
        ideal = f"list_sum(list_transform(range(1, least({k}, any_value(g)) + 1), lambda i: 1 / log2(i + 1)))"
        return (f"coalesce(sum(CASE WHEN rank <= {k} THEN 1 / log2(rank + 1) END), 0) / {ideal} "
                f'AS "{metric}"')

    return f""",
  hits AS (
    SELECT split, qid, rank, row_number() OVER (PARTITION BY split, qid ORDER BY rank) AS hit
    FROM {ranking} SEMI JOIN gold USING (split, qid, doc_id)),
  judged AS (SELECT split, qid, count(*) AS g FROM gold GROUP BY ALL),
  per_query AS (
    SELECT j.split, j.qid, {', '.join(column(m) for m in METRICS)}
    FROM judged j LEFT JOIN hits h ON j.split = h.split AND j.qid = h.qid GROUP BY j.split, j.qid),
  means AS (SELECT split, {', '.join(f'avg("{m}") AS "{m}"' for m in METRICS)}
            FROM per_query GROUP BY split),
  long AS (UNPIVOT means ON {', '.join(f'"{m}"' for m in METRICS)} INTO NAME metric VALUE value)"""


_DOMAIN_RUN = (_ranked(100, weight=_LINEAR, score=_NORM, split=_BY_DOMAIN)
               + _EXCLUDED + _GOLD + _metrics("kept"))
_DOMAIN_PLAIN = _ranked(100, split=_BY_DOMAIN) + _GOLD + _metrics("ranked")

_REPORT = _DOMAIN_RUN + f""",
  report AS (
    SELECT e.split, value * 100 AS pct
    FROM (SELECT unnest({_DOMAINS}) AS split) e
    LEFT JOIN (SELECT * FROM long WHERE metric = 'ndcg@10') m ON e.split = m.split)"""

_FEATURES = f"""WITH {_TOK},
  near AS (
    SELECT q.id::bigint AS triple_id, q.pos, any_value(q.v) AS v,
           max(CASE WHEN d.id::bigint = q.id::bigint + 1 THEN list_dot_product(q.v, d.v) END) AS p,
           max(CASE WHEN d.id::bigint = q.id::bigint + 2 THEN list_dot_product(q.v, d.v) END) AS n
    FROM tok q JOIN tok d ON d.id::bigint - q.id::bigint IN (1, 2) GROUP BY q.id, q.pos),
  delta AS (SELECT triple_id, pos, v, p - n AS delta FROM near
            WHERE p IS NOT NULL AND n IS NOT NULL)"""


def _loss(mode: str) -> str:
    x = "sum(w * delta)" + ("" if mode == "unnorm" else " / greatest(sum(w), 1e-6)")
    return f"""SELECT '{mode}' AS mode, round(avg(greatest(-x, 0) + ln(1 + exp(-abs(x)))), 6) AS loss,
    count(*) AS n_triples
  FROM (SELECT triple_id, {x} AS x FROM (SELECT *, {_LINEAR} AS w FROM delta) GROUP BY triple_id)"""


_DOCS_DIM = """dim AS (
  SELECT doc_id::varchar AS doc_id, coalesce(b.text, d.text) AS content
  FROM documents d FULL JOIN benchmark b ON b.item_id = d.doc_id)""".replace(
    "doc_id::varchar AS doc_id", "coalesce(d.doc_id, b.item_id)::varchar AS doc_id")

_HQ_FIELDS = """
    doc_id, 'in ' || lang || ' ' || source AS query,
    CASE WHEN lang = 'es' THEN '' ELSE (doc_id + 1)::varchar END AS pos_id,
    CASE WHEN lang IN ('en', 'es') THEN '' ELSE 'about ' || source END AS prefix,
    CASE WHEN lang = 'de' THEN text WHEN lang = 'fr' THEN ' ' || text
         WHEN source = 'src0' THEN '' ELSE source || ' ' || text END AS negative"""

_HQ = f"""{_DOCS_DIM},
  rec AS (SELECT {_HQ_FIELDS} FROM documents),
  resolved AS (
    SELECT rec.doc_id, query,
           CASE WHEN prefix <> '' THEN prefix || ' ' || coalesce(content, pos_id)
                ELSE coalesce(content, pos_id) END AS positive, negative
    FROM rec LEFT JOIN dim ON dim.doc_id = pos_id),
  hq AS (SELECT query, positive, negative FROM resolved
         WHERE length(positive) > 10 AND length(negative) > 10)"""

_TURNS = """turns AS (
    SELECT u.conv_id, u.turn, u.text AS query, a.text AS answer
    FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
    WHERE u.role = 'user' AND a.role = 'assistant')"""

_VL = f"""flat AS (
    SELECT conv_id, turn, 'turn ' || turn || ' ' || turns.query AS query,
           CASE WHEN turn = 0 THEN chr(8195) || chr(10) || answer || chr(8195) || chr(10)
                ELSE trim(chr(8195) || chr(10) || 're: ' || answer || chr(8195) || chr(10), {_STRIP}) END AS positive,
           CASE WHEN turn = 2 THEN turns.query || chr(8195) || chr(10) ELSE trim(turns.query, {_STRIP}) END AS negative
    FROM turns),
  vl AS (SELECT * FROM flat WHERE length(positive) > 10 AND length(negative) > 10)"""

_PROMPTED_RECORDS = f"""prompted_records AS (
    SELECT 'turn' || t.turn AS split, t.conv_id, t.turn, s.text AS prompt, t.query AS asked,
           string_split(t.answer, chr(10)) AS pos, string_split(o.answer, chr(10)) AS neg
    FROM turns t LEFT JOIN turns o ON o.conv_id = t.conv_id + 1 AND o.turn = t.turn
    LEFT JOIN (SELECT * FROM conversations WHERE role = 'system') s ON s.conv_id = t.conv_id),
  formatted AS (
    SELECT *, trim(coalesce(prompt, ''), {_STRIP}) AS p, trim(coalesce(asked, ''), {_STRIP}) AS a
    FROM prompted_records),
  queried AS (
    SELECT *, CASE WHEN p <> '' AND a <> '' THEN p || chr(10) || 'Query: ' || a
                   WHEN p <> '' THEN p ELSE a END AS query FROM formatted)"""

_PROMPTED = f"""{_PROMPTED_RECORDS},
  by_pos AS (SELECT split, conv_id, turn, query, trim(unnest(pos[1:2]), {_STRIP}) AS positive, neg
             FROM queried WHERE query <> ''),
  by_neg AS (SELECT split, conv_id, turn, query, positive, trim(unnest(neg[1:4]), {_STRIP}) AS negative
             FROM by_pos),
  prompted AS (SELECT * FROM by_neg WHERE length(positive) >= 10 AND length(negative) >= 10)"""

_MERGED = f"""WITH {_TURNS}, {_PROMPTED}, {_HQ}, {_VL},
  merged AS (
    SELECT 'prompted' AS source, query, positive, negative FROM prompted
    UNION ALL SELECT 'hq', query, positive, negative FROM hq
    UNION ALL SELECT 'vl', query, positive, negative FROM vl)"""

_SHUFFLED = """WITH placed AS (
    SELECT *, md5('42:' || doc_id) AS shuffle_key,
           row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS place,
           count(*) OVER () AS total FROM documents)
  """

_PAIRS = """pairs AS (SELECT doc_id::varchar AS qid, unnest([quality, toxic])::varchar AS doc_id
                      FROM labels)"""
_QRELS = f"""WITH {_PAIRS},
  qrels AS (SELECT DISTINCT 'all' AS split, qid, doc_id FROM pairs
            WHERE qid IN (SELECT item_id::varchar FROM benchmark))"""

_SOURCES = """WITH wanted AS (SELECT DISTINCT source AS split FROM documents),
  have AS (SELECT DISTINCT source AS split FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)"""

_TRAILING = """SELECT event_id + 1 AS step, value AS loss,
    round(avg(value) OVER (ORDER BY event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 9)
      AS trailing_mean FROM events"""

_GATED = f"WITH {_TOK}, gated AS (SELECT *, {_BY_DOMAIN} AS split, {_LINEAR} AS w FROM tok)"


def _stats(std: str) -> str:
    return f"""{_GATED} SELECT split, round(avg(w), 6) AS mean, round({std}(w), 6) AS std,
      round(min(w), 6) AS min, round(max(w), 6) AS max FROM gated GROUP BY split"""


_GRADIENT = f"""{_FEATURES},
  gated AS (SELECT *, {_LINEAR} AS w FROM delta),
  pull AS (SELECT triple_id, -1 / (1 + exp(sum(w * delta))) AS g FROM gated GROUP BY triple_id),
  dz AS (SELECT v, g * delta * w * (1 - w) AS z FROM gated JOIN pull USING (triple_id)),
  n AS (SELECT count(*) AS n FROM pull),
  gradient AS (
    SELECT 'w' AS param, i::int AS idx, sum(z * v[i + 1]) / any_value(n) AS grad
    FROM dz, n, range(64) r(i) GROUP BY i
    UNION ALL SELECT 'b', 0, sum(z) / any_value(n) FROM dz, n)"""



def _fit(steps: int, lr: float, start: str = "CASE WHEN i = 64 THEN 0.5 ELSE ((i % 7) - 3) / 4.0 END",
         batches: int = 1, log: bool = False, features: str = _FEATURES) -> str:
    """AdamW without decay, written out step by step; index 64 is the bias."""
    batch = f"('0x' || substr(md5(triple_id::varchar), 1, 7))::bigint % {batches}"
    sql = f"""{features},
  theta0 AS (
    SELECT i, ({start})::double AS x,
           0::double AS a, 0::double AS s FROM range(65) r(i))"""
    for k in range(1, steps + 1):
        sql += f""",
  par{k} AS (SELECT list(x ORDER BY i) FILTER (i < 64) AS w, max(x) FILTER (i = 64) AS b
             FROM theta{k - 1}),
  gated{k} AS (SELECT triple_id, v, delta, 1 / (1 + exp(-(list_dot_product(w, v) + b))) AS g
               FROM delta, par{k} WHERE {batch} = {(k - 1) % batches}),
  pull{k} AS (SELECT triple_id, -1 / (1 + exp(sum(g * delta))) AS p FROM gated{k} GROUP BY triple_id),
  dz{k} AS (SELECT v, p * delta * g * (1 - g) AS z FROM gated{k} JOIN pull{k} USING (triple_id)),
  grad{k} AS (SELECT i, sum(z * CASE WHEN i < 64 THEN v[i + 1] ELSE 1 END)
                        / (SELECT count(*) FROM pull{k}) AS g
              FROM dz{k}, range(65) r(i) GROUP BY i),
  clip{k} AS (SELECT i, g * least(1, 1 / (sqrt(sum(g * g) OVER ()) + 1e-6)) AS g FROM grad{k}),
  moment{k} AS (SELECT i, x, 0.9::double * a + 0.1::double * g AS a,
                       0.999::double * s + 0.001::double * g * g AS s
                FROM theta{k - 1} JOIN clip{k} USING (i)),
  theta{k} AS (SELECT i, x - {lr} * (a / (1 - 0.9::double ^ {k}))
                             / (sqrt(s / (1 - 0.999::double ^ {k})) + 1e-8) AS x, a, s FROM moment{k})"""
    if log:
        return sql + "\n  " + " UNION ALL ".join(f"""
  SELECT {k}::bigint AS step, round((SELECT avg(greatest(-x, 0) + ln(1 + exp(-abs(x)))) FROM (
           SELECT sum(g * delta) AS x FROM gated{k} GROUP BY triple_id)), 6) AS loss,
         round(avg(g), 6) AS head_w_mean, round(stddev_samp(g), 6) AS head_w_std, round(min(g), 6) AS head_w_min,
         round(max(g), 6) AS head_w_max, round((SELECT x FROM theta{steps} WHERE i = 64), 6) AS bias
  FROM gated{k}""" for k in range(1, steps + 1))
    return sql + f"""
  SELECT CASE WHEN i = 64 THEN 'b' ELSE 'w' END AS param, (i % 64)::int AS idx, round(x, 8) AS value
  FROM theta{steps}"""


def _mixed(rows: str, columns: str) -> str:
    """Triples in seeded order, with their place; equal rows are numbered."""
    return f"""SELECT query, positive, negative, row_number() OVER (
        ORDER BY md5(concat_ws(':', '42', {columns}, copy)), {columns}, copy) AS place
      FROM (SELECT *, row_number() OVER (PARTITION BY {columns}) - 1 AS copy FROM {rows})"""


_WORDS = """WITH words AS (
    SELECT {id}, list_filter(string_split(text, ' '), lambda w: w <> '') AS ws FROM {table}),
  spread AS (SELECT {id}, unnest(ws) AS word, unnest(range(len(ws)))::int AS pos FROM words),
  raw AS (SELECT {id}, pos, list_transform(range(16), lambda i:
            ('0x' || substr(md5(word), (2 * i + 1)::int, 2))::int - 127.5::double) AS r FROM spread),
  vectors AS (SELECT {id}, pos, list_transform(r, lambda x:
                (x / sqrt(list_dot_product(r, r)))::float::double) AS v FROM raw)"""


_TEXT_RUN = f"""WITH qtokens AS (
    SELECT item_id, unnest(list_filter(string_split(text, ' '), lambda w: w <> '')) AS word
    FROM benchmark),
  qwords AS (SELECT item_id, word, count(*) AS n FROM qtokens GROUP BY ALL),
  dtokens AS (
    SELECT doc_id, unnest(list_filter(string_split(text, ' '), lambda w: w <> '')) AS word
    FROM documents),
  dwords AS (SELECT DISTINCT doc_id, word FROM dtokens),
  raw AS (SELECT word, list_transform(range(16), lambda i:
            ('0x' || substr(md5(word), (2 * i + 1)::int, 2))::int - 127.5::double) AS r
          FROM (SELECT word FROM qwords UNION SELECT word FROM dwords)),
  vectors AS (SELECT word, list_transform(r, lambda x:
                (x / sqrt(list_dot_product(r, r)))::float::double) AS v FROM raw),
  sims AS (
    SELECT a.word AS q, b.word AS d, list_dot_product(a.v, b.v) AS sim
    FROM (SELECT * FROM vectors WHERE word IN (SELECT word FROM qwords)) a,
         (SELECT * FROM vectors WHERE word IN (SELECT word FROM dwords)) b),
  best AS (SELECT q AS word, doc_id, max(sim) AS m FROM dwords JOIN sims ON d = dwords.word
           GROUP BY ALL),
  weights AS (SELECT word, {_LINEAR.replace('range(64)', 'range(16)')} AS w FROM vectors),
  scored AS (
    SELECT item_id::varchar AS qid, doc_id::varchar AS doc_id,
           sum(n * w * m) / greatest(sum(n * w), 1e-6) AS score
    FROM qwords JOIN best USING (word) JOIN weights USING (word) GROUP BY item_id, doc_id),
  ranked AS (
    SELECT 'biology' AS split, qid, doc_id, score,
           row_number() OVER (PARTITION BY qid ORDER BY round(score, 10) DESC, doc_id)::int AS rank
    FROM scored QUALIFY rank <= 100),
  kept AS (
    SELECT * EXCLUDE (rank),
           row_number() OVER (PARTITION BY split, qid ORDER BY rank)::int AS rank
    FROM ranked WHERE doc_id <> (qid::bigint + 1)::varchar),
  gold AS (
    SELECT 'biology' AS split, item_id::varchar AS qid, unnest([item_id, item_id + 7])::varchar AS doc_id
    FROM benchmark)"""


# Query tokens of the triples and their best matches among the words of either text.
_TEXT_FEATURES = f"""WITH {_TURNS}, {_VL},
  triples AS (SELECT conv_id * 1000 + turn AS triple_id, query, positive, negative FROM vl),
  asked AS (SELECT triple_id, unnest(ws) AS word, unnest(range(len(ws)))::int AS pos FROM (
    SELECT triple_id, list_filter(string_split(query, ' '), lambda w: w <> '')[1:256] AS ws FROM triples)),
  held AS (SELECT DISTINCT triple_id, side, unnest(list_filter(string_split(text, ' '), lambda w: w <> '')[1:2048]) AS word
           FROM (SELECT triple_id, 'p' AS side, positive AS text FROM triples
                 UNION ALL SELECT triple_id, 'n', negative FROM triples)),
  raw AS (SELECT word, list_transform(range(16), lambda i:
            ('0x' || substr(md5(word), (2 * i + 1)::int, 2))::int - 127.5::double) AS r
          FROM (SELECT word FROM asked UNION SELECT word FROM held)),
  vectors AS (SELECT word, list_transform(r, lambda x: (x / sqrt(list_dot_product(r, r)))::float::double) AS v FROM raw),
  near AS (
    SELECT a.triple_id, a.pos, any_value(q.v) AS v,
           max(CASE WHEN side = 'p' THEN list_dot_product(q.v, d.v) END) AS p,
           max(CASE WHEN side = 'n' THEN list_dot_product(q.v, d.v) END) AS n
    FROM asked a JOIN vectors q USING (word) JOIN held h ON h.triple_id = a.triple_id JOIN vectors d ON d.word = h.word
    GROUP BY a.triple_id, a.pos),
  delta AS (SELECT triple_id, pos, v, p - n AS delta FROM near)"""


def _narrow(sql: str, dim: int = 16) -> str:
    """The statements of the fit for vectors of another size."""
    return (sql.replace("range(65)", f"range({dim + 1})").replace("i < 64", f"i < {dim}")
            .replace("i = 64", f"i = {dim}").replace("i % 64", f"i % {dim}"))


def _small_run() -> str:
    """The run over texts with two corpora, shorter texts and no exclusions."""
    words = "unnest(list_filter(string_split(text, ' '), lambda w: w <> ''))"
    split = "CASE WHEN lang = 'en' THEN 'scifact' ELSE 'fiqa2018' END AS split"
    return (_TEXT_RUN
            .replace(f"item_id, {words}", f"item_id, {words[:-1]}[1:64])")
            .replace(f"doc_id, {words}", f"doc_id, {words[:-1]}[1:512])")
            .replace("SELECT item_id::varchar AS qid, doc_id::varchar AS doc_id,",
                     f"SELECT {split}, item_id::varchar AS qid, doc_id::varchar AS doc_id,")
            .replace("JOIN weights USING (word) GROUP BY item_id, doc_id",
                     "JOIN weights USING (word) JOIN documents USING (doc_id) GROUP BY ALL")
            .replace("SELECT 'biology' AS split, qid, doc_id, score", "SELECT split, qid, doc_id, score")
            .replace("PARTITION BY qid ORDER", "PARTITION BY split, qid ORDER")
            .replace("WHERE doc_id <> (qid::bigint + 1)::varchar", "")
            .replace("SELECT 'biology' AS split, item_id::varchar AS qid", "SELECT split, item_id::varchar AS qid")
            .replace("FROM benchmark)", "FROM benchmark, (VALUES ('scifact'), ('fiqa2018')) names(split))"))


ORACLE: dict[str, str] = {
    "maxsim_topk": _ranked(10) + _OUT + "ranked",
    "maxsim_topk_passes": _ranked(10) + _OUT + "ranked",
    "weighted_maxsim_topk": _ranked(10, weight=_LINEAR, score=_NORM) + _OUT + "ranked",
    "mlp_unnorm_maxsim_topk": _ranked(10, weight=_MLP) + _OUT + "ranked",
    "masked_maxsim_topk": _ranked(
        100, hide="(label = 9 OR max(CASE WHEN pos = 0 AND label = 0 THEN 1 ELSE 0 END) "
                  "OVER (PARTITION BY id) = 1)") + _OUT + "ranked",
    "exclude_after_topk": _ranked(10) + _EXCLUDED + _OUT + "kept",
    "display_rank": _scores(split=_BY_DOMAIN) + """
      SELECT split, qid, rank, round(score, 6) AS score, top.doc_id, substr(text, 1, 60) AS preview
      FROM (SELECT *, row_number() OVER (PARTITION BY split, qid ORDER BY score DESC, doc_id::bigint DESC)::int
              AS rank FROM scored QUALIFY rank <= 5) top
      LEFT JOIN documents d ON d.doc_id::varchar = top.doc_id""",
    "rank_scored_table": """
      SELECT event_type AS split, user_id::varchar AS qid, event_id::varchar AS doc_id, value AS score,
             row_number() OVER (PARTITION BY event_type, user_id
                                ORDER BY value DESC, event_id::varchar)::int AS rank
      FROM events QUALIFY rank <= 5""",
    "maxsim_pairs": f"""WITH {_TOK},
      best AS (
        SELECT q.id AS qid, q.pos, any_value({_LINEAR.replace(', v)', ', q.v)')}) AS w,
               max(list_dot_product(q.v, d.v)) AS m,
               max(CASE WHEN d.label < 5 THEN list_dot_product(q.v, d.v) ELSE -1e4 END) AS c
        FROM tok q JOIN tok d ON d.id::bigint = q.id::bigint + 1 GROUP BY q.id, q.pos)
      SELECT qid, round(sum(m), 6) AS plain, round(sum(c), 6) AS masked,
             round(sum(m * w) / greatest(sum(w), 1e-6), 6) AS norm, round(sum(m * w), 6) AS unnorm,
             round(sum(c * w) / greatest(sum(w), 1e-6), 6) AS masked_norm
      FROM best GROUP BY qid""",
    "gate_linear": f"{_GATED} SELECT id, pos, round(w, 6) AS w FROM gated",
    "gate_mlp": f"WITH {_TOK} SELECT id, pos, round({_MLP}, 6) AS w FROM tok",
    "gate_mlp_arrow": f"WITH {_TOK} SELECT id, pos, round({_MLP}, 6) AS w FROM tok",
    "gate_mlp_wide": f"""WITH {_TOK}
      SELECT id, pos, round(1 / (1 + exp(-(list_sum(list_transform(range(32), lambda j:
               (((j % 3) - 1) / 4.0)::double * greatest(list_dot_product(
                 list_transform(range(64), lambda i: (((i + 2 * j) % 7 - 3) / 8.0)::double), v)
                 + ((j % 5) - 2) / 10.0, 0))) + 0.25))), 6) AS w
      FROM tok WHERE id <> '3' UNION ALL SELECT '3', NULL, NULL""",
    "gate_stats_population": _stats("stddev_pop"),
    "gate_stats_sample": _stats("stddev_samp"),
    "token_deltas": f"{_FEATURES} SELECT triple_id, pos, round(delta, 6) AS delta FROM delta",
    "gate_pairwise_loss": f"{_FEATURES} {_loss('unnorm')} UNION ALL {_loss('norm')}",
    "aligned_triple_deltas": f"{_FEATURES} SELECT triple_id, pos, round(delta, 6) AS delta FROM delta",
    "gate_score_loss": f"{_FEATURES} SELECT loss, n_triples FROM ({_loss('unnorm')})",
    "gate_linear_gradient": f"{_GRADIENT} SELECT param, idx, round(grad, 8) AS grad FROM gradient",
    "gate_fit_one_step": f"""{_GRADIENT},
      clipped AS (
        SELECT param, idx, grad * least(1, 1 / (sqrt(sum(grad * grad) OVER ()) + 1e-6)) AS g
        FROM gradient)
      SELECT param, idx, round(
        CASE WHEN param = 'b' THEN 0.5 ELSE ((idx % 7) - 3) / 4.0 END::double
        - 5e-4 * g / (abs(g) + 1e-8), 8) AS value
      FROM clipped""",
    "gate_mlp_gradient": f"""{_FEATURES},
      hidden AS (SELECT *, [{_RELU.format(m=5, s=2, b=0.1)}, {_RELU.format(m=3, s=1, b=-0.1)}] AS h,
                        {_MLP} AS w FROM delta),
      pull AS (SELECT triple_id, -1 / (1 + exp(sum(w * delta))) AS g FROM hidden GROUP BY triple_id),
      dz AS (SELECT v, h, g * delta * w * (1 - w) AS z FROM hidden JOIN pull USING (triple_id)),
      n AS (SELECT count(*) AS n FROM pull),
      back AS (SELECT v, j, z * [1.0, -0.5][j + 1] * (h[j + 1] > 0)::int AS z
               FROM dz, range(2) r(j))
      SELECT 'w' AS param, j::int AS idx, round(sum(z * h[j + 1]) / any_value(n), 8) AS grad
      FROM dz, n, range(2) r(j) GROUP BY j
      UNION ALL SELECT 'b', 0, round(sum(z) / any_value(n), 8) FROM dz, n
      UNION ALL SELECT 'b1', j::int, round(sum(z) / any_value(n), 8) FROM back, n GROUP BY j
      UNION ALL SELECT 'w1', (j * 64 + i)::int, round(sum(z * v[i + 1]) / any_value(n), 8)
      FROM back, n, range(64) r(i) GROUP BY j, i""",
    "gate_fit_four_steps": _fit(4, 0.05),
    "gate_fit": _fit(5, 5e-4, "CASE WHEN i = 64 THEN 5 ELSE 0 END", batches=2, log=True),
    "gate_saved": _fit(1, 5e-4),
    "gate_from_triples": _narrow(_fit(2, 0.05, features=_TEXT_FEATURES)),
    "gate_starts": f"""WITH {_TOK} SELECT id, pos, round(1 / (1 + exp(-5::double)), 12) AS linear,
        round(1 / (1 + exp(-5::double)), 12) AS two_layer FROM tok""",
    "step_log_rows": """
      SELECT 'run-' || event_id % 2 AS run, event_id - event_id % 2 AS step, value AS loss,
             round(avg(value) OVER (PARTITION BY event_id % 2 ORDER BY event_id
                                    ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 9) AS trailing_mean
      FROM events""",
    "small_corpora_run": _small_run() + _metrics("kept") + """
      SELECT 'run' AS run_id, split, 64::int AS qlen, metric, round(value, 6) AS value FROM long""",
    "manifest_rows": """
      SELECT (doc_id % 4)::int AS part, count(*) AS n, 'good' AS state FROM documents GROUP BY ALL""",
    "required_columns": f"""WITH {_TURNS}
      SELECT query, answer AS positive, 'true' AS negative FROM turns""",
    "domain_metrics": _DOMAIN_RUN + "SELECT split, metric, round(value, 6) AS value FROM long",
    "domain_metrics_plain": _DOMAIN_PLAIN + "SELECT split, metric, round(value, 6) AS value FROM long",
    "query_level_metrics": _ranked(100) + _EXCLUDED + _GOLD + _metrics("kept")
    + "SELECT split, qid, " + ", ".join(
        f'round("{m}", 6) AS {m.replace("@", "_at_")}' for m in METRICS) + " FROM per_query",
    "evaluation_run": _DOMAIN_RUN + """
      SELECT 'run' AS run_id, split, (CASE WHEN split LIKE '%pony%' THEN 32 ELSE 256 END)::int AS qlen,
             metric, round(value, 6) AS value FROM long""",
    "text_topk": _TEXT_RUN + _OUT + "kept",
    "text_evaluation": _TEXT_RUN + _metrics("kept") + """
      SELECT 'run' AS run_id, split, 256::int AS qlen, metric, round(value, 6) AS value FROM long""",
    "split_report": _REPORT + """
      SELECT split, round(pct, 4) AS pct, CASE WHEN pct IS NULL THEN 'missing' ELSE 'done' END AS status
      FROM report""",
    "macro_mean": _REPORT + """
      SELECT round(avg(pct), 4) AS mean_pct, count(pct) AS n_present, count(*) AS n_expected
      FROM report""",
    "gold_qrels": f"WITH {_TOK}, s AS (SELECT id, {_BY_DOMAIN} AS split FROM tok WHERE pos = 0)"
                  + _GOLD + "SELECT split, qid, doc_id, 1::int AS rel FROM gold",
    "judged_ranking": _ranked(100, split=_BY_DOMAIN) + _EXCLUDED + _GOLD + """
      SELECT k.split, k.qid, k.doc_id, k.rank, (g.doc_id IS NOT NULL)::int AS rel
      FROM kept k LEFT JOIN gold g USING (split, qid, doc_id)""",
    "qrels_sets": _QRELS + "SELECT split, qid, doc_id, 1::int AS rel FROM qrels",
    "qrels_set_sizes": _QRELS + """
      SELECT 'all' AS split, item_id::varchar AS qid, count(doc_id) AS n_gold
      FROM benchmark LEFT JOIN qrels ON qid = item_id::varchar GROUP BY item_id""",
    "resume_runs": """
      SELECT DISTINCT 'run' AS run_id, source AS split,
             (CASE WHEN source LIKE '%src1%' THEN 32 ELSE 256 END)::int AS qlen
      FROM documents WHERE source NOT IN
        (SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)""",
    "splits_found": _SOURCES + "SELECT split FROM wanted SEMI JOIN have USING (split)",
    "splits_missing": _SOURCES + "SELECT split FROM wanted ANTI JOIN have USING (split)",
    "last_wins": """
      SELECT id::varchar AS doc_id, text AS content FROM (
        SELECT doc_id - doc_id % 2 AS id, text, 0 AS part, doc_id AS row FROM documents
        UNION ALL SELECT item_id - item_id % 2, text, 1, item_id FROM benchmark)
      QUALIFY row_number() OVER (PARTITION BY id ORDER BY part DESC, row DESC) = 1""",
    "resolve_by_id": f"""WITH {_HQ} SELECT doc_id, query, positive, negative FROM resolved
      WHERE length(positive) > 10 AND length(negative) > 10""",
    "resolve_hot_ids": "WITH " + _HQ.replace(
        "SELECT " + _HQ_FIELDS + " FROM documents",
        f"""SELECT doc_id, query, CASE WHEN lang = 'en' THEN '7' WHEN lang = 'fr' THEN NULL ELSE pos_id END AS pos_id,
            CASE WHEN lang IN ('en', 'fr') THEN 'about' ELSE prefix END AS prefix, negative
            FROM (SELECT lang, {_HQ_FIELDS} FROM documents)""")
    + "SELECT doc_id, query, positive, negative FROM resolved",
    "flatten_pairs": f"WITH {_TURNS}, {_VL} SELECT * FROM vl",
    "explode_triples": f"WITH {_TURNS}, {_PROMPTED} SELECT * FROM prompted",
    "prompted_queries": f"WITH {_TURNS}, {_PROMPTED_RECORDS} SELECT conv_id, turn, query FROM queried",
    "strip_text": f"""SELECT conv_id, turn,
        trim(chr(12288) || chr(28) || ' ' || text || ' ' || chr(133) || chr(10), {_STRIP}) AS text,
        CASE WHEN role = 'user' THEN role ELSE '' END AS role FROM conversations""",
    "merged_triples": _MERGED + "SELECT * FROM merged",
    "triple_counts": _MERGED + """,
      raw AS (SELECT 'prompted' AS source FROM prompted_records
              UNION ALL SELECT 'hq' FROM documents UNION ALL SELECT 'vl' FROM turns),
      both_sides AS (SELECT source, 1 AS r, 0 AS t FROM raw UNION ALL SELECT source, 0, 1 FROM merged)
      SELECT coalesce(source, 'TOTAL') AS source, sum(r)::bigint AS raw_rows, sum(t)::bigint AS triples
      FROM both_sides GROUP BY ROLLUP (source)""",
    "corpus_sizes": f"""WITH {_TOK}
      SELECT {_BY_DOMAIN} AS split, count(*) AS queries, count(*) AS docs
      FROM tok WHERE pos = 0 GROUP BY ALL""",
    "shuffled": _SHUFFLED + "SELECT doc_id, shuffle_key, n_chars, place FROM placed",
    "split_train": _SHUFFLED + "SELECT * EXCLUDE (shuffle_key, place, total) FROM placed "
                               "WHERE place > ceil(0.15 * total)",
    "split_test": _SHUFFLED + "SELECT * EXCLUDE (shuffle_key, place, total) FROM placed "
                              "WHERE place <= ceil(0.15 * total)",
    "limited_batches": _SHUFFLED + "SELECT * EXCLUDE (shuffle_key, place, total) FROM placed "
                                   "WHERE place <= 96",
    "jsonl_triples": f"""WITH {_TURNS}, {_PROMPTED} SELECT CASE WHEN turn < 2 THEN 'pony' ELSE 'aops' END AS split,
      query, positive, negative FROM prompted""",
    "triple_build": _MERGED + _mixed("merged WHERE source <> 'vl'", "source, query, positive, negative"),
    "prompted_build": f"WITH {_TURNS}, {_PROMPTED} " + _mixed("prompted", "query, positive, negative"),
    "eval_tables": """WITH chosen AS (
        SELECT * FROM documents WHERE source IN (SELECT 'src' || i FROM range(20) r(i)))
      SELECT source AS split, 'queries' AS part, doc_id || '/' || md5(text) AS item FROM chosen
      UNION ALL SELECT source, 'corpus', doc_id || '/' || md5(coalesce(b.text, c.text))
      FROM chosen c LEFT JOIN benchmark b ON b.item_id = c.doc_id
      UNION ALL SELECT DISTINCT source, 'qrels', doc_id || '/' || unnest([quality, toxic])
      FROM chosen JOIN labels USING (doc_id)""",
    "latest_version": """
      SELECT 'pony' AS split, doc_id::varchar AS qid, text AS query, doc_id::varchar AS gold, text
      FROM documents""",
    "non_empty_text": f"""WITH {_PAIRS}
      SELECT 'corpus' AS part, doc_id || '/' || md5(text) AS item FROM documents
      WHERE text <> '' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
      UNION ALL SELECT 'queries', item_id || '/' || md5(text) FROM benchmark WHERE length(text) <= 150
      UNION ALL SELECT DISTINCT 'qrels', qid || '/' || doc_id FROM pairs
      WHERE qid IN (SELECT item_id::varchar FROM benchmark WHERE length(text) <= 150)""",
    "text_fallback": "SELECT doc_id::varchar AS doc_id, text, '' AS none FROM documents",
    "route_lengths": f"""WITH {_TOK}
      SELECT {_BY_DOMAIN} AS split, id AS qid,
             (CASE WHEN {_BY_DOMAIN} LIKE '%pony%' THEN 32 ELSE 256 END)::int AS qlen
      FROM tok WHERE pos = 0""",
    "truncated_tokens": f"""WITH {_TOK} SELECT id, pos, label, round({_WHOLE}, 6) AS v_sum FROM tok
      WHERE pos < CASE WHEN label < 5 THEN 3 ELSE 6 END""",
    "normalised_tokens": f"""WITH {_TOK}
      SELECT id, pos, round({_WHOLE} / sqrt(list_dot_product(v, v)), 6) AS u_sum, 1.0::double AS norm
      FROM tok""",
    "drift": f"""WITH {_TOK},
      per_token AS (
        SELECT id, list_max(list_transform(v, lambda x: abs(
                 x * (CASE WHEN label = 3 THEN 1.5 ELSE 1.01 END)::double - x))) AS h,
               CASE WHEN id::int > 20
                    THEN list_max(list_transform(v, lambda x: abs(x * 0.01::double))) ELSE 0 END AS t
        FROM tok)
      SELECT id, round(max(h), 6) AS head_drift, round(max(t), 6) AS tail_max,
             max(h) <= 5e-2 AND max(t) >= 1e-4 AS ok
      FROM per_token GROUP BY id""",
    "embedded_documents": _WORDS.format(id="doc_id", table="documents") + f"""
      SELECT doc_id, count(*)::int AS n_tokens, round(sum({_WHOLE.replace('64', '16')}), 3) AS toks_sum
      FROM vectors GROUP BY doc_id""",
    "embedded_queries": _WORDS.format(id="item_id", table="benchmark")
    + f"SELECT item_id, pos, round({_LINEAR.replace('range(64)', 'range(16)')}, 5) AS w FROM vectors",
    "trailing_loss": _TRAILING,
    "reported_steps": f"SELECT * FROM ({_TRAILING}) WHERE step % 50 = 0",
}
