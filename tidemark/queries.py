"""Queries over the driver's tables, one for each operator, and their DuckDB SQL.

Documents stand for segments, benchmark items for symptoms, conversations for sessions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import lexicons as L
from .functions import text as T
from .operators import analysis, evals, filters, graph, index, pages, ranks, reports, routing, sessions
from .plans import diagnose
from .plans.lineage import cut, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _t(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def _segments(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "documents").select(
        F.col("doc_id").alias("ord"), F.col("text").alias("raw_text"), F.lit("").alias("signature"), F.lit("").alias("component"),
        F.col("source").alias("source_doc"), "lang",
    )


def _symptoms(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("symptom"))


def _r(c: str, n: int = 6):
    return F.round(c, n).alias(c)


# --- shared SQL ---------------------------------------------------------------------------------


def _q(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(map(_q, values)) + "]"


def _any(c: str, values) -> str:
    return "(" + " OR ".join(f"contains({c}, {_q(v)})" for v in values) + ")"


TOK = r"[CASE WHEN regexp_matches(t, '[0-9]') THEN t ELSE lower(t) END FOR t IN regexp_extract_all({0}, '[A-Za-z0-9][A-Za-z0-9\-\._]*')]"
BOIL = (
    "(len(regexp_extract_all(lower({0}), '[a-z]{{3,}}')) < 6 OR " + _any("lower({0})", L.BOILERPLATE_MARKERS) +
    " OR ((length(lower({0})) - length(replace(lower({0}), 'figure', ''))) // 6 + (length(lower({0})) - length(replace(lower({0}), ' page ', ''))) // 6 >= 3"
    " AND len(regexp_extract_all(lower({0}), '[a-z]{{3,}}')) < 50)"
    " OR ((contains(lower({0}), 'basic date') OR contains(lower({0}), 'changed')) AND len(regexp_extract_all(lower({0}), '[a-z]{{3,}}')) < 12))"
)
ASCII = "regexp_replace({0}, '[^\\x00-\\x7F]', '_', 'g')"
CAPS = r"regexp_extract_all(" + ASCII + r", '\b(?:[A-Z0-9][A-Z0-9/\-]*(?:\s+[A-Z0-9][A-Z0-9/\-]*){{0,4}})\b')"
SALIENT = (
    "([trim(p) FOR p IN " + CAPS + " IF length(trim(p)) >= 3 AND NOT list_contains(" + _list(L.CAPS_STOP) +
    ", upper(trim(p))) AND NOT regexp_matches(trim(p), '^[0-9]+$')] || [w FOR w IN " + _list(L.FAULT_WORDS) + " IF contains(lower({0}), w)])"
)
SALIENCE = "array_to_string([t FOR t, i IN {0} IF list_position([lower(x) FOR x IN {0}], lower(t)) = i], ' ')"
CONTENT = "list_distinct([t FOR t IN regexp_extract_all(lower({0}), '[a-z][a-z\\-]{{3,}}') IF NOT list_contains(" + _list(L.GENERAL_WORDS) + ", t)])"
def _index_sql(text: str = "text", tag: str = "") -> str:
    return f"""
seg{tag} AS (SELECT doc_id AS ord, {TOK.format(text)} AS toks FROM documents WHERE NOT {BOIL.format('text')}),
st{tag} AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM seg{tag}),
po{tag} AS (SELECT ord, any_value(dl) AS dl, tok, count(*) AS tf FROM (SELECT ord, len(toks) AS dl, unnest(toks) AS tok FROM seg{tag}) GROUP BY ord, tok),
dfr{tag} AS (SELECT tok, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM po{tag}, st{tag} GROUP BY tok, n),
vo{tag} AS (SELECT tok, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM dfr{tag}) ELSE raw END AS idf FROM dfr{tag})"""


_BM25 = _index_sql()


def _scores(name: str, source: str, tag: str = "") -> str:
    return f"""{name} AS (
  SELECT query_id, ord, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM (SELECT query_id, tok, count(*) AS qtf FROM (SELECT query_id, unnest(toks) AS tok FROM {source}) GROUP BY ALL) q
  JOIN vo{tag} USING (tok) JOIN po{tag} USING (tok), st{tag} GROUP BY query_id, ord)"""


_QL = f"ql AS (SELECT item_id AS query_id, {TOK.format('text')} AS toks FROM benchmark)"


def _literal(s: SparkSession, d: str) -> tuple[index.Index, DataFrame]:
    idx = index.build_index(filters.clean_corpus(_segments(s, d)), F.col("raw_text"))
    return idx, _symptoms(s, d).select("query_id", T.tokenize(F.col("symptom")).alias("toks"))


def _entered(s: SparkSession, d: str, depth: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, edges, scores): each query's eight entries and the scores that walks of ``depth`` steps from them can ask for."""
    (idx, asked), edges = _literal(s, d), cut(_doc_edges(s, d))
    entries = cut(graph.pick_entries(index.best(idx, asked, 16), edges, 8))
    scores = index.score(idx, asked, pairs=graph.within(entries, edges, depth)).withColumn("score", F.round("score", 9))
    return entries, edges, cut(scores)


# --- text and filters ---------------------------------------------------------------------------


@query("boilerplate_filter", f"SELECT doc_id, {BOIL.format('text')} AS dropped FROM documents")
def _(s, d):
    return _t(s, d, "documents").select("doc_id", filters.is_boilerplate(F.col("text")).alias("dropped"))


_PROBES = ("the Rover TV camera froze", "main bus b undervolt", "water entered the suit loop during EVA", "PLSS fan stopped", "core drill stuck", "")


@query(
    "gate_terms",
    "WITH p AS (SELECT unnest(" + _list(_PROBES) + ") AS probe UNION ALL SELECT text FROM benchmark) SELECT probe, nullif(regexp_extract(probe, "
    + _q("(?i)" + "|".join(L.OUT_OF_DOMAIN)) + "), '') AS term FROM p",
)
def _(s, d):
    probes = s.range(1).select(F.explode(T.words(_PROBES)).alias("probe")).union(_t(s, d, "benchmark").select("text"))
    return probes.select("probe", filters.out_of_domain(F.col("probe")).alias("term"))


@query("tokenize_df", f"SELECT tok, count(*) AS df FROM (SELECT unnest(list_distinct({TOK.format('text')})) AS tok FROM documents) GROUP BY tok")
def _(s, d):
    docs = _t(s, d, "documents")
    return docs.select(F.explode(F.array_distinct(T.tokenize(F.col("text")))).alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("df"))


_SCORER = "[t FOR t IN regexp_extract_all(lower(text), '[a-z][a-z\\-]{2,}') IF NOT list_contains(" + _list(L.SCORER_STOP) + ", t)]"


@query(
    "idf_table",
    f"WITH w AS (SELECT unnest(list_distinct({_SCORER})) AS tok FROM documents) "
    "SELECT tok, count(*) AS df, round(ln((SELECT count(*) FROM documents) / (count(*) + 1)), 6) AS idf FROM w GROUP BY tok",
)
def _(s, d):
    return evals.idf_table(_t(s, d, "documents"), T.scorer_words(F.col("text"))).select("tok", "df", _r("idf"))


@query(
    "collection_freq",
    "WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) AS tok FROM documents) "
    "SELECT tok, count(*) AS df, round(ln((SELECT count(*) FROM documents) / (count(*) + 1)), 6) AS idf FROM w GROUP BY tok",
)
def _(s, d):
    return evals.idf_table(_t(s, d, "documents"), T.short_terms(F.col("text")), distinct=False).select("tok", "df", _r("idf"))


@query(
    "salience_terms",
    f"WITH a AS (SELECT doc_id, {SALIENT.format('text')} AS ts FROM documents) SELECT doc_id, {SALIENCE.format('ts')} AS salience FROM a",
)
def _(s, d):
    return _t(s, d, "documents").select("doc_id", T.salience(F.col("text")).alias("salience"))


@query(
    "content_term_counts",
    f"SELECT doc_id, len({CONTENT.format('text')}) AS n_terms FROM documents",
)
def _(s, d):
    return _t(s, d, "documents").select("doc_id", F.size(T.content_terms(F.col("text"))).cast("long").alias("n_terms"))


_TURNS = r"[trim(x, chr(9) || chr(10) || chr(13) || ' ') FOR x IN string_split(regexp_replace({0}, '([.;])\s+', '\1' || chr(1), 'g'), chr(1))]"


@query(
    "sentence_turns",
    f"WITH a AS (SELECT doc_id, text, [x FOR x IN {_TURNS.format('text')} IF length(x) >= 12] AS k FROM documents) "
    "SELECT doc_id, CASE WHEN len(k) > 0 THEN len(k) ELSE 1 END AS n_turns, CASE WHEN len(k) > 0 THEN k[1] ELSE trim(text, chr(9) || chr(10) || chr(13) || ' ') END AS first_turn FROM a",
)
def _(s, d):
    a = _t(s, d, "documents").select("doc_id", T.turns(F.col("text")).alias("k"))
    return a.select("doc_id", F.size("k").cast("long").alias("n_turns"), F.get("k", F.lit(0)).alias("first_turn"))


@query(
    "normalized_text",
    "SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))) AS digest, "
    "md5(regexp_replace(lower(text), '[^a-z0-9]', '', 'g')) AS squeezed FROM documents",
)
def _(s, d):
    return _t(s, d, "documents").select("doc_id", F.md5(T.normalized(F.col("text"))).alias("digest"), F.md5(T.squeezed(F.col("text"))).alias("squeezed"))


@query(
    "chain_text",
    r"SELECT doc_id, left(trim(regexp_replace(text, '\s+', ' ', 'g')), 200) AS label FROM documents",
)
def _(s, d):
    return _t(s, d, "documents").select("doc_id", T.collapse(F.col("text"), 200).alias("label"))


_SUBS = "CASE doc_id % 6 WHEN 0 THEN 'gnc' WHEN 1 THEN ' EPS ' WHEN 2 THEN 'cabin ether' WHEN 3 THEN '' WHEN 4 THEN 'crew-health' END"


def _subsystem():
    m = F.col("doc_id") % 6
    return F.when(m == 0, "gnc").when(m == 1, " EPS ").when(m == 2, "cabin ether").when(m == 3, "").when(m == 4, "crew-health")


@query(
    "scope_labels",
    f"WITH a AS (SELECT doc_id, lower(coalesce({_SUBS}, '')) AS s, text FROM documents) SELECT doc_id, "
    f"CASE WHEN {_any('s', L.LABEL_OUT)} THEN false WHEN {_any('s', L.LABEL_IN)} THEN true END AS label, "
    f"CASE WHEN {_any('s', L.AUDIT_OUT)} THEN false WHEN {_any('s', L.AUDIT_IN)} THEN true END AS audited, {_any('s', L.IN_SUBSYSTEMS)} AS in_corpus, "
    f"NOT {_any('s', L.UNFAIR_SUBSYSTEMS)} AND NOT regexp_matches(text, {_q('(?i)' + L.UNKNOWABLE)}) AS fair FROM a",
)
def _(s, d):
    sub = _subsystem()
    return _t(s, d, "documents").select(
        "doc_id", filters.scope_label(sub).alias("label"), filters.scope_label(sub, True).alias("audited"),
        filters.is_in_corpus(sub).alias("in_corpus"), filters.is_fair(sub, F.col("text")).alias("fair"),
    )


@query(
    "domain_filter",
    f"WITH a AS (SELECT doc_id, lower(coalesce({_SUBS}, 'None') || ' ' || text) AS s FROM documents) SELECT doc_id, NOT {_any('s', L.OUT_SUBSYSTEMS)} AS inside FROM a",
)
def _(s, d):
    return _t(s, d, "documents").select("doc_id", filters.in_corpus_domain(_subsystem(), F.col("text")).alias("inside"))


_ALIAS = "CASE k " + " ".join(f"WHEN {_q(k)} THEN {_q('|'.join(v))}" for k, v in L.ALIASES.items()) + " END"


@query(
    "alias_match",
    f"""WITH a AS (SELECT doc_id, lower(trim(coalesce({_SUBS}, ''))) AS k, lower({ASCII.format('text')}) AS t FROM documents),
b AS (SELECT doc_id, t, k, {_ALIAS} AS known, [w FOR w IN regexp_split_to_array(k, '[^a-z0-9]+') IF length(w) >= 3] AS own FROM a)
SELECT doc_id, regexp_matches(t, coalesce(known, CASE WHEN len(own) > 0 THEN array_to_string([regexp_escape(w) FOR w IN own], '|') ELSE regexp_escape(k) END))
  AND doc_id % 10 <> 9 AS named FROM b""",
)
def _(s, d):
    return _t(s, d, "documents").select(
        "doc_id", filters.names_subsystem(F.col("text"), _subsystem(), F.col("doc_id") % 10 == 9).alias("named")
    )


@query(
    "channel_split",
    rf"""WITH a AS (SELECT item_id, [trim(p) FOR p IN {CAPS.format('text')} IF length(trim(p)) >= 2 AND NOT list_contains({_list(L.CAPS_STOP)}, upper(trim(p))) AND NOT regexp_matches(trim(p), '^[0-9]+$')] AS caps,
  [t FOR t IN {TOK.format('text')} IF length(t) >= 2 AND NOT list_contains({_list(L.CHANNEL_STOP)}, lower(t))] AS used FROM benchmark),
b AS (SELECT item_id, caps, used, [w FOR w IN flatten([regexp_split_to_array(lower(p), '[^A-Za-z0-9]+') FOR p IN caps]) IF w <> ''] AS cw FROM a)
SELECT item_id, trim(array_to_string(caps || [t FOR t IN used IF (list_contains({_list(L.PANEL_WORDS)}, lower(t)) OR regexp_matches(t, '[0-9]')) AND NOT list_contains(cw, lower(t))], ' ')) AS signals,
  trim(array_to_string([t FOR t IN used IF NOT (list_contains({_list(L.PANEL_WORDS)}, lower(t)) OR regexp_matches(t, '[0-9]') OR list_contains(cw, lower(t)))], ' ')) AS speech FROM b""",
)
def _(s, d):
    return _t(s, d, "benchmark").select("item_id", T.channels(F.col("text")).alias("c")).select("item_id", "c.signals", "c.speech")


_STEMS = "CASE n_nationkey % 6 WHEN 0 THEN 'x-anomaly-' WHEN 1 THEN 'rules-' WHEN 2 THEN 'mp-' WHEN 3 THEN 'fr-' WHEN 4 THEN 'timeline-' ELSE 'zz-' END || lower(n_name)"


def _stem():
    m = F.col("n_nationkey") % 6
    head = F.when(m == 0, "x-anomaly-").when(m == 1, "rules-").when(m == 2, "mp-").when(m == 3, "fr-").when(m == 4, "timeline-").otherwise("zz-")
    return F.concat(head, F.lower("n_name"))


@query(
    "doc_type_case",
    f"""WITH a AS (SELECT n_nationkey, {_STEMS} AS s FROM nation), b AS (SELECT n_nationkey, s,
  [m FOR m IN {_list(L.HISTORICAL)} IF contains(s, m)][1] AS old, [m FOR m IN {_list(L.OPERATIONAL)} IF contains(s, m)][1] AS op FROM a)
SELECT n_nationkey, CASE WHEN contains(s, 'anomaly') OR contains(s, '-report') THEN 'anomaly_report' WHEN contains(s, 'rule') THEN 'flight_rule'
  WHEN contains(s, 'mp') THEN 'malfunction_procedure' WHEN contains(s, 'fr') THEN 'flight_rule' WHEN contains(s, 'ar') THEN 'anomaly_report' ELSE 'malfunction_procedure' END AS doc_type,
  CASE WHEN old IS NULL AND op IS NOT NULL THEN 'OPERATIONAL' ELSE 'HISTORICAL' END AS class, coalesce(old, op, '(none)') AS marker FROM b""",
)
def _(s, d):
    return _t(s, d, "nation").select("n_nationkey", filters.document_type(_stem()).alias("doc_type"), filters.document_class(_stem()).alias("c")).select(
        "n_nationkey", "doc_type", "c.class", "c.marker"
    )


@query(
    "get_seconds",
    """WITH a AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN '55:57:xx' ELSE CAST(user_id AS VARCHAR) || ':' || CAST(event_id % 60 AS VARCHAR) || ':' || CAST(event_id % 47 AS VARCHAR) END AS get FROM events),
b AS (SELECT event_id, TRY_CAST(split_part(get, ':', 1) AS INTEGER) * 3600 + TRY_CAST(split_part(get, ':', 2) AS INTEGER) * 60 + TRY_CAST(split_part(get, ':', 3) AS INTEGER) AS seconds FROM a)
SELECT event_id, seconds, CASE WHEN seconds < 60 THEN seconds || ' s' WHEN seconds < 3600 THEN seconds // 60 || ' min ' || seconds % 60 || ' s' ELSE seconds // 3600 || ' h ' || seconds % 3600 // 60 || ' min' END AS text FROM b""",
)
def _(s, d):
    get = F.when(F.col("event_id") % 9 == 0, "55:57:xx").otherwise(F.concat_ws(":", F.col("user_id").cast("string"), (F.col("event_id") % 60).cast("string"), (F.col("event_id") % 47).cast("string")))
    a = _t(s, d, "events").select("event_id", T.elapsed_seconds(get).alias("seconds"))
    return a.select("event_id", "seconds", F.when(F.col("seconds").isNotNull(), T.duration(F.col("seconds"))).alias("text"))


# --- retrieval ----------------------------------------------------------------------------------


@query(
    "bm25_topk",
    f"WITH {_BM25}, {_QL}, {_scores('sc', 'ql')}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, ord) AS rank FROM sc WHERE score > 0) "
    "SELECT query_id, ord, CAST(rank AS INTEGER) AS rank, round(round(score, 9), 6) AS score FROM r WHERE rank <= 6",
)
def _(s, d):
    return index.best(*_literal(s, d), 6).select("query_id", "ord", "rank", _r("score"))


_FALL = f"[t FOR t IN {TOK.format('text')} IF length(t) >= 3 AND NOT list_contains({_list(L.FALLBACK_STOP)}, t)]"


@query(
    "bm25_fallback",
    f"""WITH {_BM25}, sl AS (SELECT item_id AS query_id, text, {SALIENT.format('text')} AS ts FROM benchmark),
s2 AS (SELECT query_id, text, {SALIENCE.format('ts')} AS sal FROM sl), qs AS (SELECT query_id, {TOK.format('sal')} AS toks FROM s2), {_scores('a', 'qs')},
ok AS (SELECT query_id FROM a GROUP BY query_id HAVING max(score) > 0),
qf AS (SELECT query_id, {_FALL} AS toks FROM s2 WHERE query_id NOT IN (SELECT query_id FROM ok)), {_scores('b', 'qf')},
u AS (SELECT *, 'salience' AS variant FROM a WHERE query_id IN (SELECT query_id FROM ok) UNION ALL SELECT *, 'fallback' FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, ord) AS rank FROM u WHERE score > 0)
SELECT query_id, ord, variant, CAST(rank AS INTEGER) AS rank, round(round(score, 9), 6) AS score FROM r WHERE rank <= 6""",
)
def _(s, d):
    idx = index.build_index(filters.clean_corpus(_segments(s, d)), F.col("raw_text"))
    return index.search(idx, _symptoms(s, d), 6).select("query_id", "ord", "variant", "rank", _r("score"))


@query(
    "coverage_dial",
    """WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) AS tok FROM documents),
q AS (SELECT item_id AS query_id, unnest(CASE WHEN len(ts) = 0 THEN [NULL] ELSE ts END) AS tok FROM (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}')) AS ts FROM benchmark))
SELECT query_id, round(coalesce(count(v.tok) / nullif(count(q.tok), 0), 0.0), 6) AS coverage FROM q LEFT JOIN v USING (tok) GROUP BY query_id""",
)
def _(s, d):
    vocab = _t(s, d, "documents").select(F.explode(T.short_terms(F.col("text"))).alias("tok"))
    return index.coverage(_symptoms(s, d), vocab).select("query_id", _r("coverage"))


@query(
    "rrf_fusion",
    """WITH t AS (SELECT c.c_mktsegment AS query_id, c.c_custkey AS id, count(*) AS n, max(o_totalprice) AS top FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY ALL),
l AS (SELECT query_id, id, 1.0 AS w, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, id) - 1 AS pos FROM t
  UNION ALL SELECT query_id, id, 0.5, row_number() OVER (PARTITION BY query_id ORDER BY top DESC, id) - 1 FROM t)
SELECT query_id, id, round(sum(w / (60 + pos + 1)), 9) AS score FROM l GROUP BY query_id, id""",
)
def _(s, d):
    t = _t(s, d, "customer").join(_t(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey")).groupBy(
        F.col("c_mktsegment").alias("query_id"), F.col("c_custkey").alias("id")
    ).agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("top"))
    lists = [
        t.select("query_id", F.lit(name).alias("list"), "id", (F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(by), "id")) - 1).alias("pos"))
        for name, by in (("count", "n"), ("price", "top"))
    ]
    return index.fuse_rankings(lists[0].union(lists[1]), {"count": 1.0, "price": 0.5}).select("query_id", "id", _r("score", 9))


# --- graphs -------------------------------------------------------------------------------------


def _code(c, head: str):
    return F.concat(F.lit(head), F.lpad(F.floor(c).cast("string"), 7, "0"))


@query(
    "edge_resolution",
    """WITH n AS (SELECT count(*) AS n FROM customer), c AS (SELECT c_custkey AS k, n FROM customer, n),
l AS (SELECT k AS src, 0 AS link, ['id' || lpad(CAST((k * 7 + 1) % n AS VARCHAR), 7, '0')] AS toks FROM c
  UNION ALL SELECT k, 1, ['id' || lpad(CAST((k * 3 + 2) % n AS VARCHAR), 7, '0'), 'grp' || lpad(CAST((k * 3 + 2) % n // 20 AS VARCHAR), 7, '0'), 'unit'] FROM c),
h AS (SELECT k AS dst, unnest(['id' || lpad(CAST(k AS VARCHAR), 7, '0'), 'grp' || lpad(CAST(k // 20 AS VARCHAR), 7, '0')]) AS tok FROM c),
m AS (SELECT src, link, len(toks) AS n, dst, count(*) AS hits FROM (SELECT src, link, toks, unnest(toks) AS tok FROM l) JOIN h USING (tok) WHERE src <> dst GROUP BY ALL),
e AS (SELECT src, dst, min(link) AS link FROM m WHERE hits >= CASE WHEN n <= 2 THEN 1 ELSE greatest(2, n // 2) END GROUP BY src, dst)
SELECT src, dst, CAST(row_number() OVER (PARTITION BY src ORDER BY link, dst) AS INTEGER) AS seq FROM e""",
)
def _(s, d):
    c = _t(s, d, "customer")
    k, n = F.col("c_custkey"), F.col("n")
    two = (k * 3 + 2) % n
    seg = c.crossJoin(F.broadcast(c.agg(F.count(F.lit(1)).alias("n")))).select(
        k.alias("ord"), F.concat_ws(" ", _code(k, "id"), _code(k / 20, "grp")).alias("label"),
        F.array(_code((k * 7 + 1) % n, "id"), F.concat_ws(" ", _code(two, "id"), _code(two / 20, "grp"), F.lit("unit"))).alias("links"),
    )
    return graph.resolve_links(seg)


def _doc_edges(s: SparkSession, d: str) -> DataFrame:
    docs = _t(s, d, "documents").select("doc_id")
    return (
        docs.crossJoin(F.broadcast(docs.agg(F.count(F.lit(1)).alias("n"))))
        .select(F.col("doc_id").alias("src"), F.posexplode(F.array(*[(F.col("doc_id") * m + a) % F.col("n") for m, a in ((3, 1), (7, 2), (11, 3))])).alias("p", "dst"))
        .where("src <> dst").groupBy("src", "dst").agg((F.min("p") + 1).alias("seq"))
    )


_EDGES = """dn AS (SELECT count(*) AS n FROM documents),
ed AS (SELECT src, dst, min(seq) AS seq FROM (SELECT doc_id AS src, unnest([(doc_id * 3 + 1) % n, (doc_id * 7 + 2) % n, (doc_id * 11 + 3) % n]) AS dst, unnest([1, 2, 3]) AS seq FROM documents, dn)
  WHERE src <> dst GROUP BY src, dst)"""


def _chase_sql(depth: int, rel: float = 0.5, tag: str = "") -> str:
    """Walks from w0, as ``fin``; ``tag`` keeps the steps of several settings apart."""
    w = ["w0"] + [f"w{tag}{i + 1}" for i in range(depth)]
    parts, done = [], []
    for i in range(depth):
        parts.append(f"""
o{tag}{i} AS (SELECT w.query_id, w.chain, w.path, w.base, e.dst, coalesce(round(s.score, 9), 0.0) AS s, row_number() OVER (PARTITION BY w.query_id, w.chain ORDER BY coalesce(round(s.score, 9), 0.0) DESC, e.seq) AS r
  FROM {w[i]} w JOIN ed e ON e.src = w.cur LEFT JOIN sc s ON s.query_id = w.query_id AND s.ord = e.dst WHERE NOT list_contains(w.path, e.dst)),
{w[i + 1]} AS (SELECT query_id, chain, dst AS cur, path || [dst] AS path, base FROM o{tag}{i} WHERE r = 1 AND s >= {rel}::DOUBLE * base),
d{tag}{i} AS (SELECT query_id, chain, path FROM {w[i]} w WHERE NOT EXISTS (SELECT 1 FROM {w[i + 1]} x WHERE x.query_id = w.query_id AND x.chain = w.chain))""")
        done.append(f"SELECT * FROM d{tag}{i}")
    return ",".join(parts) + f", fin{tag} AS ({' UNION ALL '.join(done)} UNION ALL SELECT query_id, chain, path FROM {w[depth]})"


_ENTRIES = """r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, ord) AS rank FROM sc WHERE score > 0),
p AS (SELECT r.*, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN ord IN (SELECT src FROM ed) THEN 1 ELSE 0 END DESC, rank) AS chain FROM r WHERE rank <= 16),
w0 AS (SELECT query_id, chain, ord AS cur, [ord] AS path, round(score, 9) AS base FROM p WHERE chain <= 8)"""


@query(
    "chase_bm25",
    f"""WITH {_BM25}, {_QL}, {_scores('sc', 'ql')}, {_EDGES},
{_ENTRIES}, {_chase_sql(3)}
SELECT query_id, CAST(chain AS INTEGER) AS chain, array_to_string(path, '>') AS path FROM fin""",
)
def _(s, d):
    entries, edges, scores = _entered(s, d, 3)
    paths = graph.chase(entries, edges, scores, 0.5, 3)
    return paths.select("query_id", "chain", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query(
    "chase_coverage",
    f"""WITH {_EDGES}, tm AS (SELECT doc_id AS ord, {CONTENT.format('text')} AS terms FROM documents),
idf AS (SELECT tok, ln((SELECT count(*) FROM documents) / (count(*) + 1)) AS idf FROM (SELECT unnest(terms) AS tok FROM tm) GROUP BY tok),
w0 AS (SELECT ord AS chain, ord AS cur, [ord] AS path, terms AS covered FROM tm),
""" + ",".join(f"""
o{i} AS (SELECT w.chain, w.path, w.covered, e.dst, e.seq, t.terms, unnest([x FOR x IN t.terms IF NOT list_contains(w.covered, x)]) AS tok
  FROM w{i} w JOIN ed e ON e.src = w.cur JOIN tm t ON t.ord = e.dst WHERE NOT list_contains(w.path, e.dst)),
g{i} AS (SELECT chain, dst, seq, any_value(path) AS path, any_value(covered) AS covered, any_value(terms) AS terms, round(sum(idf), 9) AS gain FROM o{i} JOIN idf USING (tok) GROUP BY chain, dst, seq),
h{i} AS (SELECT *, row_number() OVER (PARTITION BY chain ORDER BY gain DESC, seq) AS r FROM g{i}),
w{i + 1} AS (SELECT chain, dst AS cur, path || [dst] AS path, list_distinct(covered || terms) AS covered FROM h{i} WHERE r = 1 AND gain > 0),
d{i} AS (SELECT chain, path FROM w{i} WHERE chain NOT IN (SELECT chain FROM w{i + 1}))""" for i in range(2)) + """
SELECT chain AS entry, array_to_string(path, '>') AS path FROM (SELECT * FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT chain, path FROM w2)""",
)
def _(s, d):
    return _coverage_paths(s, d)


def _coverage_paths(s: SparkSession, d: str) -> DataFrame:
    terms = written(_t(s, d, "documents").select(F.col("doc_id").alias("ord"), T.content_terms(F.col("text")).alias("terms")), "terms")
    idf = evals.idf_table(terms, F.col("terms")).select("tok", "idf")
    entries = terms.select(F.lit(0).alias("query_id"), F.col("ord").alias("chain"), "ord", F.lit(1.0).alias("score"))
    paths = graph.chase_coverage(entries, _doc_edges(s, d), terms, idf, max_depth=2)
    return paths.select(F.col("chain").alias("entry"), F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query(
    "bfs_reach",
    f"""WITH RECURSIVE {_EDGES}, f AS (SELECT src, dst FROM ed WHERE seq <= 5), sd AS (SELECT CAST(n_nationkey AS BIGINT) AS query_id, CAST(n_nationkey AS BIGINT) AS node FROM nation WHERE n_nationkey IN (SELECT doc_id FROM documents)),
w(query_id, node, hop) AS (SELECT query_id, node, 0 FROM sd UNION SELECT query_id, dst, hop + 1 FROM w JOIN f ON f.src = w.node WHERE hop < 3)
SELECT query_id, node, min(hop) AS hop FROM w GROUP BY query_id, node""",
)
def _(s, d):
    seeds = _t(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("query_id"), F.col("n_nationkey").cast("long").alias("node"))
    seeds = seeds.join(_t(s, d, "documents").select(F.col("doc_id").alias("node")), "node", "left_semi")
    return graph.reach(seeds, _doc_edges(s, d), 3, 5).select("query_id", "node", "hop")


_ROUTES = f"""WITH {_EDGES}, sd AS (SELECT CAST(n_nationkey AS BIGINT) AS query_id, CAST(n_nationkey AS BIGINT) AS node FROM nation WHERE n_nationkey IN (SELECT doc_id FROM documents)),
st AS MATERIALIZED (SELECT src, dst, CASE WHEN seq = 3 THEN -ln(0.6) ELSE -ln(0.8) END AS step FROM ed), c0 AS MATERIALIZED (SELECT query_id, node, CAST(0 AS DOUBLE) AS cost FROM sd)""" + "".join(
    f""", c{i + 1} AS MATERIALIZED (SELECT query_id, node, min(cost) AS cost FROM (SELECT * FROM c{i} UNION ALL SELECT query_id, dst, cost + step FROM c{i} JOIN st ON st.src = node) GROUP BY query_id, node)"""
    for i in range(24)
)


def _roads(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    seeds = _t(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("query_id"), F.col("n_nationkey").cast("long").alias("node"))
    seeds = seeds.join(_t(s, d, "documents").select(F.col("doc_id").alias("node")), "node", "left_semi")
    return seeds, _doc_edges(s, d).withColumn("cost", F.when(F.col("seq") == 3, -F.ln(F.lit(0.6))).otherwise(-F.ln(F.lit(0.8))))


@query("min_cost_route", _ROUTES + " SELECT query_id, node, round(exp(-cost), 6) AS score FROM c24")
def _(s, d):
    return graph.route(*_roads(s, d)).select("query_id", "node", F.round(F.exp(-F.col("cost")), 6).alias("score"))


@query(
    "routed_segments",
    _ROUTES + """, p AS (SELECT query_id, node, round(cost, 9) AS cost, round(cost, 9) + CASE WHEN node % 7 = 0 THEN 0 ELSE 1 END AS far FROM c24 WHERE node % 3 <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY far, node) AS place FROM p) SELECT query_id, node, round(exp(-cost), 6) AS score, CAST(place AS INTEGER) AS place FROM r WHERE place <= 20""",
)
def _(s, d):
    nodes = _t(s, d, "documents").select(F.col("doc_id").alias("node"), F.when(F.col("doc_id") % 3 == 0, "symptom").otherwise("procedure").alias("kind"))
    boosted = nodes.where("node % 7 = 0")
    costs = graph.nearest_costs(*_roads(s, d), nodes, 20, boosted).withColumn("cost", F.round("cost", 9))
    found = graph.routed_segments(costs, nodes, 20, boosted)
    return found.select("query_id", "node", _r("score"), "place")


@query("best_first_route")
def _(s, d):
    docs = _t(s, d, "documents")
    nodes = docs.select(F.col("doc_id").alias("node"), F.when(F.col("doc_id") % 3 == 0, "symptom").otherwise("procedure").alias("kind"))
    seeds = _t(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("query_id"), F.col("n_nationkey").cast("long").alias("node"))
    edges = _doc_edges(s, d).withColumn("cost", F.when(F.col("seq") == 3, -F.ln(F.lit(0.6))).otherwise(-F.ln(F.lit(0.8))))
    found = routing.best_first(seeds, nodes, edges, boosted=nodes.where("node % 7 = 0"))
    return found.select("query_id", "node", _r("score"), "place")


_PR = "\n".join(
    f""", k{i + 1} AS MATERIALIZED (SELECT nd.node, (0.15 + 0.85 * (SELECT coalesce(sum(rank) FILTER (WHERE node NOT IN (SELECT src FROM st)), 0) FROM k{i})) / (SELECT count(*) FROM nd) + 0.85 * coalesce(g.got, 0) AS rank
  FROM nd LEFT JOIN (SELECT st.dst AS node, sum(k.rank * st.p) AS got FROM st JOIN k{i} k ON k.node = st.src GROUP BY st.dst) g USING (node))"""
    for i in range(120)
)
_PAGERANK = f"""WITH e AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION ALL SELECT 's' || s_suppkey % 40, 'n' || s_nationkey FROM supplier),
nd AS MATERIALIZED (SELECT src AS node FROM e UNION SELECT dst FROM e UNION SELECT 'lone'),
b AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e), w AS (SELECT src, dst, count(*) AS w FROM b GROUP BY ALL),
st AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM w), k0 AS MATERIALIZED (SELECT node, 1.0 / (SELECT count(*) FROM nd) AS rank FROM nd){_PR}"""


def _ranks(s: SparkSession, d: str) -> DataFrame:
    e = _t(s, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst")).union(
        _t(s, d, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey") % 40), F.concat(F.lit("n"), "s_nationkey"))
    )
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).union(s.range(1).select(F.lit("lone"))).distinct()
    return graph.pagerank(nodes, e, tol=1e-8)


@query("pagerank", _PAGERANK + " SELECT node, round(rank, 5) AS rank FROM k120")
def _(s, d):
    return _ranks(s, d).select("node", _r("rank", 5))


@query("minmax_prior", _PAGERANK + " SELECT node, round(0.1 * (rank - min(rank) OVER ()) / (max(rank) OVER () - min(rank) OVER ()), 4) AS prior FROM k120 WHERE node LIKE 'n%'")
def _(s, d):
    ranks = _ranks(s, d)
    return graph.scaled_prior(ranks, ranks.where("node like 'n%'")).select("node", _r("prior", 4))


# --- joins and sessions -------------------------------------------------------------------------


@query("first_match_assign", "SELECT p_partkey, CASE WHEN contains(lower(p_name), 'red') THEN 'colour' WHEN contains(lower(p_name), 'widget') THEN 'thing' WHEN contains(lower(p_name), 'o') THEN 'o' END AS assigned FROM part")
def _(s, d):
    return sessions.first_assignment(_t(s, d, "part"), "p_name", [("Red", "colour"), ("widget", "thing"), ("o", "o")]).select("p_partkey", "assigned")


def _pages(s: SparkSession, d: str) -> DataFrame:
    docs = _t(s, d, "documents").select(F.col("source").alias("doc"), F.col("doc_id").alias("page"), "text", (F.col("doc_id") % 100).cast("double").alias("conf"))
    return pages.page_offsets(docs).drop("text")


_PG = "pg AS (SELECT source AS doc, doc_id AS page, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off, length(text) AS len, doc_id % 100 AS conf FROM documents)"


@query("page_offsets", f"WITH {_PG} SELECT doc, page, off, CAST(len AS INTEGER) AS len FROM pg")
def _(s, d):
    return _pages(s, d).select("doc", "page", "off", "len")


@query(
    "segment_lead",
    f"""WITH {_PG}, ln AS (SELECT doc, max(off + len) AS length FROM pg GROUP BY doc),
m AS (SELECT doc, off AS start, coalesce(lead(off) OVER (PARTITION BY doc ORDER BY off), length) AS "end" FROM pg JOIN ln USING (doc))
SELECT doc, start, "end" FROM m WHERE "end" - start > 20""",
)
def _(s, d):
    p = _pages(s, d)
    marks = p.select("doc", F.col("off").alias("start"), F.lit("h").alias("heading"))
    lengths = p.groupBy("doc").agg(F.max(F.col("off") + F.col("len")).alias("length"))
    return pages.heading_segments(marks, lengths).select("doc", "start", "end")


@query(
    "interval_overlap",
    f"""WITH {_PG}, ln AS (SELECT doc, max(off + len) AS length FROM pg GROUP BY doc),
sg AS (SELECT doc, unnest(range(0, length, 7000)) AS start FROM ln)
SELECT sg.doc, start, start + 3000 AS "end", round(coalesce(avg(conf), 0.0), 6) AS confidence FROM sg LEFT JOIN pg ON pg.doc = sg.doc AND off < start + 3000 AND off + len > start GROUP BY sg.doc, start""",
)
def _(s, d):
    p = _pages(s, d)
    lengths = p.groupBy("doc").agg(F.max(F.col("off") + F.col("len")).alias("length"))
    segs = lengths.select("doc", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(7000).cast("long"))).alias("start")).withColumn("end", F.col("start") + 3000)
    return pages.span_confidence(segs, p).select("doc", "start", "end", _r("confidence"))


@query(
    "positional_join",
    """WITH a AS (SELECT n_regionkey AS g, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS place FROM nation),
b AS (SELECT s_suppkey % 7 AS g, s_name, row_number() OVER (PARTITION BY s_suppkey % 7 ORDER BY s_suppkey) AS place FROM supplier)
SELECT CAST(g AS BIGINT) AS g, n_name, s_name FROM a LEFT JOIN b USING (g, place)""",
)
def _(s, d):
    left = _t(s, d, "nation").select(F.col("n_regionkey").cast("long").alias("g"), "n_name")
    right = _t(s, d, "supplier").select((F.col("s_suppkey") % 7).alias("g"), "s_suppkey", "s_name")
    return sessions.by_position(left, right, "g", "n_name", "s_suppkey").select("g", "n_name", "s_name")


@query("resume_anti_join", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def _(s, d):
    done = _t(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return sessions.not_done(_t(s, d, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query("keyed_last_wins", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def _(s, d):
    return sessions.last_per_key(_t(s, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query(
    "paired_left_join",
    """SELECT c_custkey, a.n AS n_open, b.n AS n_done FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) a ON a.o_custkey = c_custkey
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) b ON b.o_custkey = c_custkey""",
)
def _(s, d):
    o = _t(s, d, "orders")
    part = lambda st, n: o.where(F.col("o_orderstatus") == st).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias(n))
    return _t(s, d, "customer").select("c_custkey").join(part("O", "n_open"), "c_custkey", "left").join(part("F", "n_done"), "c_custkey", "left")


@query(
    "union_cases",
    "SELECT 'customer' AS kind, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_name, s_acctbal, NULL FROM supplier",
)
def _(s, d):
    a = _t(s, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = _t(s, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(b, allowMissingColumns=True)


_CT = "ct AS (SELECT conv_id, turn, text, string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS tr FROM conversations)"


@query("cumulative_transcript", f"WITH {_CT} SELECT conv_id, turn, md5(tr) AS digest, CAST(length(tr) AS INTEGER) AS n_chars FROM ct")
def _(s, d):
    c = sessions.cumulative(_t(s, d, "conversations"), "conv_id", "turn", "text")
    return c.select("conv_id", "turn", F.md5("transcript").alias("digest"), F.length("transcript").alias("n_chars"))


@query(
    "first_hit_turn",
    f"WITH {_CT} SELECT conv_id, count(*) AS n_turns, min(CASE WHEN contains(lower(tr), 'tion the') THEN turn END) AS matched_at FROM ct GROUP BY conv_id",
)
def _(s, d):
    c = sessions.cumulative(_t(s, d, "conversations"), "conv_id", "turn", "text")
    return sessions.first_hits(c, "conv_id", "turn", F.contains(F.lower("transcript"), F.lit("tion the")))


@query(
    "replay_until_hit",
    """WITH a AS (SELECT conv_id, turn, contains(lower(text), 'tion the') AS hit, length(text) AS n FROM conversations),
b AS (SELECT *, coalesce(bool_or(hit) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS before FROM a)
SELECT conv_id, turn, hit, CAST(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS elapsed,
  CAST(max(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS INTEGER) AS best FROM b WHERE NOT before""",
)
def _(s, d):
    rows = _t(s, d, "conversations").withColumn("n", F.length("text"))
    kept = sessions.until_hit(rows, "conv_id", "turn", F.contains(F.lower("text"), F.lit("tion the")))
    out = sessions.best_so_far(sessions.elapsed(kept, "conv_id", "turn", "n"), "conv_id", "turn", "n")
    return out.select("conv_id", "turn", "hit", "elapsed", "best")


# --- statistics ---------------------------------------------------------------------------------


@query(
    "quintiles_last_bin",
    "WITH a AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS rn, count(*) OVER () // 5 AS q FROM customer) "
    "SELECT c_custkey, CAST(CASE WHEN q = 0 THEN 4 ELSE least((rn - 1) // q, 4) END AS INTEGER) AS bin FROM a",
)
def _(s, d):
    return evals.bins_last_wide(_t(s, d, "customer"), "c_acctbal", "c_custkey").select("c_custkey", "bin")


@query(
    "systematic_sample",
    "WITH a AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS rn, greatest(count(*) OVER () // 40, 1) AS step FROM customer) SELECT c_custkey FROM a WHERE rn % step = 0 AND rn < step * 40",
)
def _(s, d):
    return evals.systematic_sample(_t(s, d, "customer").select("c_custkey"), "c_custkey", 40)


@query(
    "percentile_forms",
    """WITH a AS (SELECT event_type, list(value ORDER BY value) AS v, count(value) AS n FROM events GROUP BY event_type)
SELECT event_type, v[CAST(greatest(floor(n * 0.95) - 1, 0) AS BIGINT) + 1] AS p95_low, v[CAST(least(floor(n * 0.95), n - 1) AS BIGINT) + 1] AS p95_high,
  v[CAST(floor(n * 0.05) AS BIGINT) + 1] AS p05, v[n // 2 + 1] AS upper_median FROM a""",
)
def _(s, d):
    return ranks.order_statistics(_t(s, d, "events"), "value", by=["event_type"])


def _labelled(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "documents").join(_t(s, d, "labels"), "doc_id").select(
        F.col("doc_id").alias("id"), "lang", (F.col("n_chars") % 500).cast("double").alias("score"), (F.col("quality") == 1).alias("label"),
        filters.is_boilerplate(F.col("text")).alias("thin"), (F.col("toxic") == 1).alias("toxic"),
    )


@query(
    "auc_rank",
    """WITH a AS (SELECT lang, n_chars % 500 AS x, quality = 1 AS y FROM documents JOIN labels USING (doc_id)),
r AS (SELECT lang, y, rank() OVER (PARTITION BY lang ORDER BY x) + (count(*) OVER (PARTITION BY lang, x) - 1) / 2 AS r FROM a)
SELECT lang, round(coalesce((sum(r) FILTER (WHERE y) - count(*) FILTER (WHERE y) * (count(*) FILTER (WHERE y) + 1) / 2) / (nullif(count(*) FILTER (WHERE y), 0) * nullif(count(*) FILTER (WHERE NOT y), 0)), 0.5), 6) AS auc FROM r GROUP BY lang""",
)
def _(s, d):
    return evals.auc(_labelled(s, d), "score", "label", ["lang"]).select("lang", _r("auc"))


@query(
    "in_out_rates",
    f"SELECT quality = 1 AS label, count(*) AS n, count(*) FILTER (WHERE {BOIL.format('text')}) AS hits, round(count(*) FILTER (WHERE {BOIL.format('text')}) / count(*), 6) AS rate "
    "FROM documents JOIN labels USING (doc_id) GROUP BY 1 HAVING count(*) >= 3",
)
def _(s, d):
    return evals.group_rates(_labelled(s, d), "label", F.col("thin")).select("label", "n", "hits", _r("rate"))


@query("outcome_taxonomy", "SELECT quality = 1 AS loose, toxic = 1 AS strict, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2")
def _(s, d):
    return evals.outcomes(_labelled(s, d), F.col("label"), F.col("toxic"))


@query(
    "pivot_conditions",
    "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1",
)
def _(s, d):
    return _t(s, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)


@query(
    "label_diff",
    "SELECT doc_id, CASE WHEN quality = 1 AND toxic = 1 THEN 'flip' ELSE 'new' END AS change FROM labels WHERE (quality = 1 AND toxic = 1) OR (quality = 0 AND toxic = 0)",
)
def _(s, d):
    lab = _t(s, d, "labels")
    a, b = lab.where("quality = 1").select("doc_id", F.lit(0).alias("was")), lab.select("doc_id", F.col("toxic").alias("now"))
    flips = a.join(b, "doc_id").where("was <> now").select("doc_id", F.lit("flip").alias("change"))
    new = b.where("now = 0").join(a, "doc_id", "left_anti").select("doc_id", F.lit("new").alias("change"))
    return flips.union(new)


@query("pearson", "SELECT round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem")
def _(s, d):
    return evals.pearson(_t(s, d, "lineitem"), "l_quantity", "l_extendedprice").select(_r("r"))


@query("histogram", "SELECT turn, count(*) AS n FROM conversations GROUP BY turn")
def _(s, d):
    return _t(s, d, "conversations").groupBy("turn").agg(F.count(F.lit(1)).alias("n"))


@query(
    "summary_statistics",
    "SELECT event_type, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_pop(value), 6) AS sd, min(value) AS lo, max(value) AS hi FROM events GROUP BY event_type",
)
def _(s, d):
    return _t(s, d, "events").groupBy("event_type").agg(
        F.round(F.avg("value"), 6).alias("mean"), F.round(F.median("value"), 6).alias("median"), F.round(F.stddev_pop("value"), 6).alias("sd"),
        F.min("value").alias("lo"), F.max("value").alias("hi"),
    )


_VOTE = f"""pt AS (SELECT source AS query_id, [t FOR t IN {CONTENT.format('text')} IF t NOT IN ('this', 'that', 'then', 'thth')] AS ts FROM documents),
vt AS (SELECT query_id, term, count(*) AS votes FROM (SELECT query_id, unnest(ts) AS term FROM pt) GROUP BY ALL),
tp AS (SELECT query_id, term, votes FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, term) AS r FROM vt) WHERE r = 1)"""


def _points(s: SparkSession, d: str) -> DataFrame:
    return _t(s, d, "documents").select(
        F.col("source").alias("query_id"), T.content_terms(F.col("text")).alias("terms"), F.array(*map(F.lit, ("this", "that", "then", "thth"))).alias("echo")
    )


@query("consensus_vote", f"WITH {_VOTE} SELECT * FROM tp")
def _(s, d):
    return evals.echo_free_vote(_points(s, d))


@query(
    "citation_dials",
    f"""WITH {_VOTE.replace("FROM documents),", "FROM documents WHERE doc_id + 20 IN (SELECT doc_id FROM documents)),", 1)}, g AS (SELECT source AS query_id, avg(CASE WHEN len(a) = 0 THEN 0.0 ELSE len([x FOR x IN a IF list_contains(b, x)]) / len(a) END) AS g, count(*) AS n_points
  FROM (SELECT x.source, {CONTENT.format('x.text')} AS a, {CONTENT.format('y.text')} AS b FROM documents x JOIN documents y ON y.doc_id = x.doc_id + 20) GROUP BY source),
su AS (SELECT source AS query_id, count(*) FILTER (WHERE contains(lower(text), term)) AS support FROM documents JOIN tp ON tp.query_id = source GROUP BY source)
SELECT query_id, n_points, round(g, 6) AS groundedness, support, term AS consensus_term, votes AS consensus,
  round((g - {L.CITE_MEAN_G}) / {L.CITE_SD_G} + (support - {L.CITE_MEAN_SUPPORT}) / {L.CITE_SD_SUPPORT}, 6) AS citation_score FROM g JOIN tp USING (query_id) JOIN su USING (query_id)""",
)
def _(s, d):
    docs = _t(s, d, "documents")
    docs = docs.join(docs.select((F.col("doc_id") - 20).alias("doc_id"), F.col("text").alias("other")), "doc_id")
    points = docs.select(
        F.col("source").alias("query_id"), T.content_terms(F.col("text")).alias("text_terms"), T.content_terms(F.col("other")).alias("src_terms"),
        F.array(*map(F.lit, ("this", "that", "then", "thth"))).alias("echo"),
    )
    out = evals.citation_dials(points, _t(s, d, "documents").select(F.col("source").alias("query_id"), F.col("text").alias("raw_text")))
    return out.select("query_id", "n_points", _r("groundedness"), "support", "consensus_term", "consensus", _r("citation_score"))


@query(
    "cause_scores",
    f"""WITH w AS (SELECT item_id AS id, list_distinct({_SCORER}) AS ts, lower(CASE WHEN item_id % 5 = 0 THEN 'decline' WHEN item_id % 5 = 1 THEN text ELSE replace(text, 'e', '') END) AS t FROM benchmark),
idf AS (SELECT tok, ln((SELECT count(*) FROM benchmark) / (count(*) + 1)) AS idf FROM (SELECT unnest(ts) AS tok FROM w) GROUP BY tok),
n AS (SELECT id, sum(idf) AS m, count(*) FILTER (WHERE idf >= 2.5) AS k FROM (SELECT id, t, unnest(ts) AS tok FROM w WHERE t <> 'decline') JOIN idf USING (tok) WHERE contains(t, tok) GROUP BY id)
SELECT id, t = 'decline' AS declined, round(coalesce(m, 0.0), 6) AS matched_idf, coalesce(k, 0) AS n_strong, coalesce(k, 0) >= 1 AS right_direction FROM w LEFT JOIN n USING (id)""",
)
def _(s, d):
    m = F.col("item_id") % 5
    rows = _t(s, d, "benchmark").select(
        F.col("item_id").alias("id"), "text", F.when(m == 0, "decline").when(m == 1, F.col("text")).otherwise(F.replace("text", F.lit("e"), F.lit(""))).alias("diagnosis")
    )
    terms = T.scorer_words(F.col("text"))
    idf = evals.idf_table(rows, terms)
    return evals.cause_scores(rows.withColumn("terms", terms), idf, F.col("terms")).select("id", "declined", _r("matched_idf"), "n_strong", "right_direction")


_ANCHORS = ("the", "tion the", "Er-An", "zz unit")


@query(
    "anchor_coverage",
    "WITH a AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) AS t FROM documents) "
    "SELECT doc_id, (contains(t, 'the')::INT + contains(t, 'tion the')::INT + contains(t, 'er an')::INT + contains(t, 'zz unit')::INT) / 4 AS coverage FROM a",
)
def _(s, d):
    return _t(s, d, "documents").select("doc_id", evals.anchor_coverage(F.col("text"), T.words(_ANCHORS))["coverage"].alias("coverage"))


# --- ingestion ----------------------------------------------------------------------------------


def _answers(s: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    triple = lambda su, st, r, o, ot: F.struct(
        F.concat(F.lit(su), k % 9).alias("subject"), F.lit(st).alias("subject_type"), F.lit(r).alias("relation"),
        F.concat(F.lit(o), k % 5).alias("object"), F.lit(ot).alias("object_type"),
    )
    made = F.to_json(F.struct(F.array(
        triple("low ", "Symptom", "indicates", "leak ", "Fault"), triple("pump ", "Component", "locatedIn", "loop ", "Subsystem"),
        triple("step ", "Procedure", "references", "step ", "Procedure"), triple("x", "Gadget", "likes", "y", "Fault"),
    ).alias("triples")))
    return _t(s, d, "supplier").select(k.alias("seg_id"), F.when(k % 7 == 0, "no json").otherwise(made).alias("payload"))


_TR = """tr AS (SELECT s_suppkey AS seg_id, unnest([0, 1, 2, 3]) AS pos, unnest(['low ' || s_suppkey % 9, 'pump ' || s_suppkey % 9, 'step ' || s_suppkey % 9, 'x' || s_suppkey % 9]) AS subject,
  unnest(['Symptom', 'Component', 'Procedure', 'Gadget']) AS subject_type, unnest(['indicates', 'locatedIn', 'references', 'likes']) AS relation,
  unnest(['leak ' || s_suppkey % 5, 'loop ' || s_suppkey % 5, 'step ' || s_suppkey % 5, 'y' || s_suppkey % 5]) AS object, unnest(['Fault', 'Subsystem', 'Procedure', 'Fault']) AS object_type
  FROM supplier WHERE s_suppkey % 7 <> 0)"""


@query("json_triples", f"WITH {_TR} SELECT * FROM tr WHERE pos < 3")
def _(s, d):
    return filters.closed_schema(pages.parsed_triples(_answers(s, d)))


@query(
    "triples_to_segments",
    f"""WITH {_TR}, k AS (SELECT seg_id, max(object) FILTER (WHERE pos = 1) AS subsystem, max(subject) FILTER (WHERE pos = 1) AS component,
  max(subject) FILTER (WHERE pos = 0) AS symptoms, max(object) FILTER (WHERE pos = 2) AS links, list_sort(list_distinct(flatten(list([subject, object])))) AS names FROM tr WHERE pos < 3 GROUP BY seg_id)
SELECT seg_id, subsystem, component, symptoms, links, array_to_string(names, ', ') AS signature FROM k""",
)
def _(s, d):
    seg = pages.triples_to_segments(filters.closed_schema(pages.parsed_triples(_answers(s, d))))
    return seg.select("seg_id", "subsystem", "component", F.array_join("symptoms", "|").alias("symptoms"), F.array_join("links_to", "|").alias("links"), "signature")


@query("event_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(s, d):
    return _t(s, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


# --- studies ------------------------------------------------------------------------------------


_PARTS = "[" + ", ".join(f"'{w}'" for w in ("valve", "relays", "o-ring", "tank-sensor", "leak", "sealing", "fuse", "gimbal-motor", "pump", "noise")) + "]"
_PART_WORDS = ("valve", "relays", "o-ring", "tank-sensor", "leak", "sealing", "fuse", "gimbal-motor", "pump", "noise")


def _causes(s: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    pick = lambda n: F.get(T.words(_PART_WORDS), (k * n % 10).cast("int"))
    return _t(s, d, "supplier").select(k.alias("id"), F.array_distinct(F.array(pick(3), pick(7), F.concat(F.lit("valve-x"), k % 40))).alias("terms"), pick(1).alias("decision"))


_CA = f"""ca AS (SELECT s_suppkey AS id, list_distinct([({_PARTS})[s_suppkey * 3 % 10 + 1], ({_PARTS})[s_suppkey * 7 % 10 + 1], 'valve-x' || s_suppkey % 40]) AS terms, ({_PARTS})[s_suppkey % 10 + 1] AS decision FROM supplier),
idf AS (SELECT tok, ln((SELECT count(*) FROM ca) / (count(*) + 1)) AS idf FROM (SELECT unnest(terms) AS tok FROM ca) GROUP BY tok)"""


@query(
    "component_parts",
    f"""WITH {_CA}, r AS (SELECT id, tok, idf FROM (SELECT id, unnest(terms) AS tok FROM ca) JOIN idf USING (tok) WHERE idf >= 1.0),
p AS (SELECT id, idf, unnest(CASE WHEN contains(tok, '-') AND tok NOT IN ('o-ring', 'b-nut', 'dc-dc', 'quick-disconnect') THEN [x FOR x IN string_split(tok, '-') IF length(x) >= 4] ELSE [tok] END) AS part FROM r),
q AS (SELECT id, part, max(idf) AS idf FROM p WHERE regexp_matches(part, {_q(analysis.PART)}) AND NOT regexp_matches(part, {_q(analysis.MECHANISM + '$')}) AND NOT regexp_matches(part, '(ing|ed)$') GROUP BY id, part)
SELECT id, part, round(idf, 6) AS idf, CAST(row_number() OVER (PARTITION BY id ORDER BY round(idf, 9) DESC, part) AS INTEGER) AS place FROM q""",
)
def _(s, d):
    rows = _causes(s, d)
    idf = evals.idf_table(rows, F.col("terms")).withColumn("idf", F.round("idf", 9))
    # Few suppliers give no idf of 2.5.
    return analysis.components(rows, F.col("terms"), idf, cut=1.0).select("id", "part", _r("idf"), "place")


@query(
    "named_parts",
    f"""WITH {_CA}, e AS (SELECT id, decision, unnest(terms) AS part FROM ca), f AS (SELECT *, regexp_replace(part, 's$', '') AS stem FROM e)
SELECT id, part, contains(decision, stem) OR contains(regexp_replace(decision, '[^a-z0-9]', '', 'g'), regexp_replace(stem, '[^a-z0-9]', '', 'g')) AS strict,
  contains(decision, stem) OR contains(regexp_replace(decision, '[^a-z0-9]', '', 'g'), regexp_replace(stem, '[^a-z0-9]', '', 'g')) OR len([h FOR h IN regexp_split_to_array(lower(part), '[^a-z0-9]+') IF length(h) >= 4 AND (contains(decision, h) OR (ends_with(h, 's') AND contains(decision, h[:-2])))]) > 0 AS loose FROM f""",
)
def _(s, d):
    e = _causes(s, d).select("id", "decision", F.explode("terms").alias("part"))
    return e.select("id", "part", analysis.is_named(F.col("part"), F.col("decision")).alias("strict"), analysis.is_named(F.col("part"), F.col("decision"), True).alias("loose"))


_KIND = f"CASE WHEN regexp_matches(w, {_q('(?i)' + L.WHERE)}) AND regexp_matches(w, {_q('(?i)' + L.WHY)}) THEN 'both' WHEN regexp_matches(w, {_q('(?i)' + L.WHERE)}) THEN 'where' WHEN regexp_matches(w, {_q('(?i)' + L.WHY)}) THEN 'why' ELSE 'other' END"


@query(
    "term_kinds",
    f"WITH t AS (SELECT w, count(*) AS n FROM (SELECT unnest({CONTENT.format('text')}) AS w FROM documents) GROUP BY w) SELECT w AS term, {_KIND} AS kind, n FROM t",
)
def _(s, d):
    terms = _t(s, d, "documents").select(F.explode(T.content_terms(F.col("text"))).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("n")).select("term", analysis.term_kind(F.col("term")).alias("kind"), "n")


@query(
    "cause_composition",
    f"""WITH {_CA}, t AS (SELECT id % 4 AS g, array_to_string(list_sort(terms), ' ') AS t FROM ca),
c AS (SELECT g, len(regexp_extract_all(t, {_q('(?i)' + L.WHERE)})) AS w, len(regexp_extract_all(t, {_q('(?i)' + L.WHY)})) AS y FROM t)
SELECT g, count(*) AS n, CAST(sum(w) AS BIGINT) AS where_words, CAST(sum(y) AS BIGINT) AS why_words, count(*) FILTER (WHERE w > 0) AS has_where, count(*) FILTER (WHERE y > 0) AS has_why,
  count(*) FILTER (WHERE w > 0 AND y > 0) AS has_both FROM c GROUP BY g""",
)
def _(s, d):
    rows = _causes(s, d).select((F.col("id") % 4).alias("g"), F.array_join(F.array_sort("terms"), " ").alias("t"))
    return analysis.composition(rows, "t", "g")


@query(
    "where_coverage",
    f"""WITH {_CA}, n AS (SELECT id, contains(decision, left(tok, 4)) AS hit FROM (SELECT id, decision, unnest(terms) AS tok FROM ca) WHERE regexp_matches(tok, {_q('(?i)' + L.WHERE)})),
s AS (SELECT id, count(*) FILTER (WHERE hit) / count(*) AS share FROM n GROUP BY id)
SELECT count(*) AS n, round(avg(share), 6) AS mean, round(median(share), 6) AS median, round(avg(CASE WHEN share > 0 THEN 1 ELSE 0 END), 6) AS hit_rate FROM s""",
)
def _(s, d):
    e = _causes(s, d).select("id", "decision", F.explode("terms").alias("tok")).where(F.col("tok").rlike("(?i)" + L.WHERE))
    out = analysis.where_coverage(e.select("id", "tok", F.contains("decision", F.left("tok", F.lit(4))).alias("hit")))
    return out.select("n", _r("mean"), _r("median"), _r("hit_rate"))


@query(
    "symptom_graph",
    """WITH s AS (SELECT p_name AS id, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_brand END AS subsystem, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_type END AS component,
  ['low ' || p_size, 'hot ' || p_brand] AS symptoms, ['see ' || p_size] AS links FROM part),
m AS (SELECT id, subsystem, 'symptom::' || lower(unnest(symptoms)) AS y FROM s),
e AS (SELECT subsystem AS src, id AS dst, 'has_procedure' AS kind FROM s WHERE subsystem <> '' UNION ALL SELECT component, id, 'has_procedure' FROM s WHERE component <> ''
  UNION ALL SELECT subsystem, component, 'has_component' FROM s WHERE subsystem <> '' AND component <> ''
  UNION ALL SELECT y, id, 'indicates' FROM m UNION ALL SELECT y, subsystem, 'associated_with' FROM m WHERE subsystem <> '' UNION ALL SELECT id, unnest(links), 'related_to' FROM s)
SELECT kind, src, count(*) AS n, count(DISTINCT dst) AS targets FROM e GROUP BY kind, src""",
)
def _(s, d):
    k = F.col("p_partkey")
    seg = _t(s, d, "part").select(
        F.col("p_name").alias("id"), F.when(k % 3 == 0, "").otherwise(F.col("p_brand")).alias("subsystem"), F.when(k % 4 != 0, F.col("p_type")).alias("component"),
        F.array(F.concat(F.lit("low "), "p_size"), F.concat(F.lit("hot "), "p_brand")).alias("symptoms"), F.array(F.concat(F.lit("see "), "p_size")).alias("links_to"),
    )
    return analysis.symptom_graph(seg)[1].groupBy("kind", "src").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("dst").alias("targets"))


@query(
    "structural_match",
    f"""WITH tm AS (SELECT doc_id AS ord, {CONTENT.format('text')} AS terms FROM documents), q AS (SELECT item_id AS query_id, {CONTENT.format('text')} AS terms FROM benchmark),
idf AS (SELECT tok, ln((SELECT count(*) FROM documents) / (count(*) + 1)) AS idf FROM (SELECT unnest(terms) AS tok FROM tm) GROUP BY tok),
m AS (SELECT query_id, ord, sum(idf) AS s FROM (SELECT query_id, unnest(terms) AS tok FROM q) JOIN idf USING (tok) JOIN (SELECT ord, unnest(terms) AS tok FROM tm) USING (tok) GROUP BY ALL)
SELECT query_id, round(max(s), 6) AS best FROM m GROUP BY query_id""",
)
def _(s, d):
    terms = _t(s, d, "documents").select(F.col("doc_id").alias("ord"), T.content_terms(F.col("text")).alias("terms"))
    asked = _symptoms(s, d).select("query_id", T.content_terms(F.col("symptom")).alias("terms"))
    return analysis.structural_match(asked, terms, evals.idf_table(terms, F.col("terms"))).select("query_id", _r("best"))


@query(
    "operating_point",
    "SELECT round(count(*) FILTER (WHERE quality = 0 AND toxic = 1) / nullif(count(*) FILTER (WHERE toxic = 1), 0), 6) AS catch, "
    "round(count(*) FILTER (WHERE quality = 0 AND toxic = 0) / nullif(count(*) FILTER (WHERE toxic = 0), 0), 6) AS false_flag, "
    "round(count(*) FILTER (WHERE quality = 0 AND toxic = 1) / nullif(count(*) FILTER (WHERE quality = 0), 0), 6) AS precision FROM labels",
)
def _(s, d):
    rows = _t(s, d, "labels").select((F.col("quality") == 0).alias("flag"), (F.col("toxic") == 1).alias("bad"))
    return analysis.operating_point(rows, "flag", "bad").select(_r("catch"), _r("false_flag"), _r("precision"))


@query(
    "turns_report",
    """WITH c AS (SELECT conv_id, CASE WHEN conv_id % 3 <> 0 THEN max(turn) END AS matched_at, sum(length(text)) / 100.0 AS seconds, CASE WHEN conv_id % 4 <> 0 THEN count(*) END AS human_turns FROM conversations GROUP BY conv_id)
SELECT count(*) AS n, count(matched_at) AS matched, round(avg(matched_at), 6) AS mean_turns, round(median(matched_at), 6) AS median_turns, round(avg(seconds), 6) AS mean_seconds,
  count(*) FILTER (WHERE matched_at IS NOT NULL AND human_turns IS NOT NULL) AS paired, count(*) FILTER (WHERE matched_at <= human_turns) AS no_later FROM c""",
)
def _(s, d):
    rows = _t(s, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("m"), (F.sum(F.length("text")) / 100.0).alias("seconds"), F.count(F.lit(1)).alias("h")).select(
        F.when(F.col("conv_id") % 3 != 0, F.col("m")).alias("matched_at"), "seconds", F.when(F.col("conv_id") % 4 != 0, F.col("h")).alias("human_turns"), F.lit(None).cast("double").alias("human_seconds"),
    )
    return analysis.turns_report(rows).select("n", "matched", _r("mean_turns"), _r("median_turns"), _r("mean_seconds"), "paired", "no_later")


# --- without a SQL form -------------------------------------------------------------------------


@query("held_out_auc")
def _(s, d):
    return evals.held_out_auc(_labelled(s, d), "score", "label")


@query("permutation_test")
def _(s, d):
    return evals.permutation_test(_labelled(s, d), "score", "label")


@query("pointwise_diagnosis")
def _(s, d):
    return diagnose.diagnose_points(_symptoms(s, d), _segments(s, d))


# --- walks shown and measured -------------------------------------------------------------------


_HEADING = _q(pages.HEADING)


@query(
    "heading_offsets",
    rf"""WITH d AS (SELECT n_name AS doc, concat_ws(chr(10), '2.4.1 ' || n_name, 'text', 'Procedure 7-2 end', 'MP-ABC-014.3 x') AS text FROM nation),
h AS (SELECT doc, regexp_extract_all(text, {_HEADING}) AS hits, string_split_regex(text, {_HEADING}) AS gaps FROM d),
j AS (SELECT doc, hits, gaps, unnest(range(1, len(hits) + 1)) AS j FROM h)
SELECT doc, CAST(list_sum([length(g) FOR g IN gaps[1:j]]) + coalesce(list_sum([length(x) FOR x IN hits[1:j - 1]]), 0) AS BIGINT) AS start, regexp_extract(hits[j], {_HEADING}, 1) AS heading FROM j""",
)
def _(s, d):
    lines = F.concat_ws("\n", F.concat(F.lit("2.4.1 "), "n_name"), F.lit("text"), F.lit("Procedure 7-2 end"), F.lit("MP-ABC-014.3 x"))
    return pages.headings(_t(s, d, "nation").select(F.col("n_name").alias("doc"), lines.alias("text")))


_LINES = r"""sp AS (SELECT query_id, chain, unnest(path) AS ord, unnest(range(len(path))) AS p FROM fin),
ll AS (SELECT query_id, chain, p, source, CASE WHEN p = 0 THEN '  ' ELSE '    -> ' END || '[C' || chain || '.' || (p + 1) || '] (section) :: ' || left(trim(regexp_replace(text, '\s+', ' ', 'g')), 180) AS line
  FROM sp JOIN documents ON doc_id = ord)"""


@query(
    "chain_diagnosis",
    f"""WITH {_BM25}, gt AS (SELECT item_id AS query_id, text, nullif(regexp_extract(text, {_q("(?i)" + "|".join(L.OUT_OF_DOMAIN))}), '') AS gate_term FROM benchmark),
sl AS (SELECT query_id, text, {SALIENT.format('text')} AS ts FROM gt WHERE gate_term IS NULL), s2 AS (SELECT query_id, text, {SALIENCE.format('ts')} AS sal FROM sl),
qs AS (SELECT query_id, {TOK.format('sal')} AS toks FROM s2), {_scores('sa', 'qs')}, ok AS (SELECT query_id FROM sa GROUP BY query_id HAVING max(score) > 0),
qf AS (SELECT query_id, {_FALL} AS toks FROM s2 WHERE query_id NOT IN (SELECT query_id FROM ok)), {_scores('sb', 'qf')},
sc AS (SELECT * FROM sa WHERE query_id IN (SELECT query_id FROM ok) UNION ALL SELECT * FROM sb), {_EDGES}, {_ENTRIES}, {_chase_sql(3, 0.4)}, {_LINES},
an AS (SELECT query_id, count(DISTINCT chain) AS n_chains, trim(arg_max(line, chain * 10 + p)) AS answer FROM ll GROUP BY query_id),
v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]{{3,}}')) AS tok FROM documents),
qt AS (SELECT query_id, unnest(CASE WHEN len(ts) = 0 THEN [NULL] ELSE ts END) AS tok FROM (SELECT query_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{{3,}}')) AS ts FROM gt)),
cv AS (SELECT query_id, coalesce(count(v.tok) / nullif(count(qt.tok), 0), 0.0)::DOUBLE AS coverage FROM qt LEFT JOIN v USING (tok) GROUP BY query_id)
SELECT query_id, answer IS NULL AS declined, gate_term, coalesce(n_chains, 0) AS n_chains, round(coverage, 6) AS coverage, coverage < {L.COVERAGE_CUT} AS coverage_flag,
  coalesce(answer, {_q(diagnose.DECLINED)}) AS answer FROM gt LEFT JOIN an USING (query_id) LEFT JOIN cv USING (query_id)""",
)
def _(s, d):
    seg = _segments(s, d).withColumn("symptoms", F.array("raw_text"))
    return diagnose.diagnose_chains(_symptoms(s, d), seg, _doc_edges(s, d)).withColumn("coverage", F.round("coverage", 6))


_WALKS = f"WITH {_BM25}, {_QL}, {_scores('sc', 'ql')}, {_EDGES}, {_ENTRIES}"


def _walked(s: SparkSession, d: str) -> DataFrame:
    entries, edges, scores = _entered(s, d, 3)
    return cut(graph.chase(entries, edges, scores, 0.4, 3))


@query(
    "chain_render",
    f"""{_WALKS}, {_chase_sql(3, 0.4)}, {_LINES},
cs AS (SELECT query_id, chain, 'CHAIN ' || chain || ' of ' || coalesce(max(source) FILTER (WHERE p = 0), '') || chr(10) || string_agg(line, chr(10) ORDER BY p) AS t FROM ll GROUP BY query_id, chain)
SELECT query_id, string_agg(t, chr(10) ORDER BY chain) AS block FROM cs GROUP BY query_id""",
)
def _(s, d):
    return diagnose.render_chains(_walked(s, d), _segments(s, d))


@query(
    "chain_profile",
    f"""{_WALKS}, {_chase_sql(3, 0.4)}, vs AS (SELECT query_id, unnest(path) AS ord FROM fin),
a AS (SELECT query_id, count(*) AS visits, count(DISTINCT ord) AS segments, count(DISTINCT source) AS docs FROM vs JOIN documents ON doc_id = ord GROUP BY query_id),
b AS (SELECT query_id, count(*) AS chains, round(avg(len(path)), 6) AS mean_length, round(avg(CASE WHEN len(path) = 1 THEN 1 ELSE 0 END), 6) AS single FROM fin GROUP BY query_id)
SELECT query_id, chains, mean_length, single, visits, segments, docs, round(visits / segments, 6) AS redundancy FROM b JOIN a USING (query_id)""",
)
def _(s, d):
    return analysis.chain_profile(_walked(s, d), _segments(s, d)).withColumns({c: F.round(c, 6) for c in ("mean_length", "single", "redundancy")})


_SWEEP = tuple((rel, depth, f"x{i}{j}_") for i, rel in enumerate((0.4, 0.6)) for j, depth in enumerate((1, 2)))


@query(
    "walk_sweep",
    f"{_WALKS}, tg AS (SELECT item_id AS query_id, {CONTENT.format('text')} AS terms FROM benchmark), tm AS (SELECT doc_id AS ord, {CONTENT.format('text')} AS terms FROM documents)"
    + "".join(f""", {_chase_sql(depth, rel, tag)}, h{tag} AS (SELECT query_id, list_distinct(flatten(list(terms))) AS have FROM (SELECT DISTINCT query_id, unnest(path) AS ord FROM fin{tag}) JOIN tm USING (ord) GROUP BY query_id),
c{tag} AS (SELECT len(list_intersect(terms, coalesce(have, []::VARCHAR[]))) / nullif(len(terms), 0) AS cov FROM tg LEFT JOIN h{tag} USING (query_id))""" for rel, depth, tag in _SWEEP)
    + " UNION ALL ".join(f" SELECT {rel}::DOUBLE AS rel, CAST({depth} AS INTEGER) AS depth, round(avg(cov), 6) AS mean_coverage, count(cov) AS n FROM c{tag}" for rel, depth, tag in _SWEEP),
)
def _(s, d):
    entries, edges, scores = _entered(s, d, 2)
    terms = _t(s, d, "documents").select(F.col("doc_id").alias("ord"), T.content_terms(F.col("text")).alias("terms"))
    targets = _symptoms(s, d).select("query_id", T.content_terms(F.col("symptom")).alias("terms"))
    return analysis.walk_sweep(entries, edges, scores, targets, terms, (0.4, 0.6), (1, 2)).withColumn("mean_coverage", F.round("mean_coverage", 6))


_VARIANTS = {"whole": "text", "terms": "concat_ws(' ', text, source, lang)", "source": "concat_ws(' ', source, lang)"}


@query(
    "index_comparison",
    f"WITH {_QL}" + "".join(f", {_index_sql(text, '_' + v)}, {_scores('sc_' + v, 'ql', '_' + v)}" for v, text in _VARIANTS.items())
    + ", u AS (" + " UNION ALL ".join(f"SELECT '{v}' AS variant, * FROM sc_{v}" for v in _VARIANTS)
    + "), q AS (SELECT *, row_number() OVER (PARTITION BY variant, query_id ORDER BY round(score, 9) DESC, ord) AS rank FROM u WHERE round(score, 9) > 0) "
    "SELECT variant, query_id, ord, CAST(rank AS INTEGER) AS rank FROM q WHERE rank <= 8",
)
def _(s, d):
    seg = filters.clean_corpus(_segments(s, d))
    asked = _symptoms(s, d).select("query_id", T.tokenize(F.col("symptom")).alias("toks"))
    return analysis.index_comparison(seg, {
        "whole": F.col("raw_text"), "terms": reports.term_source(F.col("raw_text"), F.col("source_doc"), F.col("lang")), "source": F.concat_ws(" ", "source_doc", "lang"),
    }, asked)


# --- reports ------------------------------------------------------------------------------------


@query(
    "component_scores",
    f"""WITH {_CA}, p AS (SELECT id, decision, tok AS part, row_number() OVER (PARTITION BY id ORDER BY round(idf, 9) DESC, tok) AS place FROM (SELECT id, decision, unnest(terms) AS tok FROM ca) JOIN idf USING (tok)),
f AS (SELECT id, place, CASE WHEN id % 9 = 0 THEN '' ELSE decision END AS said, part, regexp_replace(part, 's$', '') AS stem FROM p),
h AS (SELECT id, place, contains(said, stem) OR contains(regexp_replace(said, '[^a-z0-9]', '', 'g'), regexp_replace(stem, '[^a-z0-9]', '', 'g')) AS hit,
  len([x FOR x IN regexp_split_to_array(lower(part), '[^a-z0-9]+') IF length(x) >= 4 AND (contains(said, x) OR (ends_with(x, 's') AND contains(said, x[:-2])))]) > 0 AS head FROM f)
SELECT id, bool_or(hit AND place = 1) AS "primary", bool_or(hit) AS any_part, bool_or(hit OR head) AS any_loose, round(avg(CASE WHEN hit THEN 1 ELSE 0 END), 6) AS coverage FROM h GROUP BY id""",
)
def _(s, d):
    rows = _causes(s, d).withColumn("declined", F.col("id") % 9 == 0)
    idf = evals.idf_table(rows, F.col("terms")).withColumn("idf", F.round("idf", 9))
    parts = rows.select("id", F.explode("terms").alias("part")).join(idf.select(F.col("tok").alias("part"), "idf"), "part")
    parts = parts.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("idf"), "part")))
    return analysis.component_scores(rows, parts).select("id", "primary", "any_part", "any_loose", _r("coverage"))


@query(
    "subset_report",
    """WITH x AS (SELECT o_totalprice AS v, o_orderstatus AS st, o_orderpriority AS pr FROM orders)
SELECT 'all' AS subset, count(*) AS n, round(avg(v), 4) AS price FROM x UNION ALL SELECT 'open', count(*), round(avg(v), 4) FROM x WHERE st = 'O'
UNION ALL SELECT 'urgent', count(*), round(avg(v), 4) FROM x WHERE pr LIKE '1%' UNION ALL SELECT 'none', 0, NULL""",
)
def _(s, d):
    subsets = {"all": F.lit(True), "open": F.col("o_orderstatus") == "O", "urgent": F.col("o_orderpriority").startswith("1"), "none": F.lit(None).cast("boolean")}
    return analysis.subset_report(_t(s, d, "orders"), subsets, {"price": F.col("o_totalprice")}).select("subset", "n", _r("price", 4))


@query(
    "lookup_causes",
    """WITH c AS (SELECT p_brand AS symptom, p_name AS cause, p_type AS sub FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) AS r FROM part) WHERE r = 1),
q AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN 'unknown' ELSE 'Brand#' || CAST(s_suppkey % 60 AS VARCHAR) END AS symptom, s_name AS own FROM supplier)
SELECT id, CASE WHEN c.symptom IS NULL THEN own ELSE cause END AS documented_cause, coalesce(sub, '?') AS subsystem FROM q LEFT JOIN c USING (symptom)""",
)
def _(s, d):
    k = F.col("s_suppkey")
    asked = F.when(k % 4 == 0, "unknown").otherwise(F.concat(F.lit("Brand#"), (k % 60).cast("string")))
    decisions = _t(s, d, "supplier").select(k.alias("id"), asked.alias("symptom"), F.col("s_name").alias("documented_cause"))
    causes = _t(s, d, "part").select(F.col("p_partkey").alias("ord"), F.col("p_brand").alias("symptom"), F.col("p_name").alias("documented_cause"), F.col("p_type").alias("subsystem"))
    return reports.with_causes(decisions, causes).select("id", "documented_cause", "subsystem")


@query(
    "entity_occurrences",
    """WITH e AS (SELECT l_orderkey AS seg, 'part ' || l_partkey % 50 AS name, 'component' AS type FROM lineitem UNION SELECT l_orderkey, 'supplier ' || l_suppkey % 50, 'subsystem' FROM lineitem)
SELECT name, type, count(*) AS n, md5(string_agg(CAST(seg AS VARCHAR), ',' ORDER BY seg)) AS segments FROM e GROUP BY name, type""",
)
def _(s, d):
    triples = _t(s, d, "lineitem").select(
        F.col("l_orderkey").alias("seg_id"), F.concat(F.lit("part "), F.col("l_partkey") % 50).alias("subject"), F.lit("component").alias("subject_type"),
        F.concat(F.lit("supplier "), F.col("l_suppkey") % 50).alias("object"), F.lit("subsystem").alias("object_type"),
    )
    found = reports.entity_occurrences(triples)
    return found.select("name", "type", F.size("segments").cast("long").alias("n"), F.md5(F.array_join(F.transform("segments", lambda x: x.cast("string")), ",")).alias("segments"))


@query(
    "fitted_constants",
    "SELECT round(avg(l_discount), 9) AS mean_g, round(stddev_pop(l_discount), 9) AS sd_g, round(avg(l_quantity), 6) AS mean_support, round(stddev_pop(l_quantity), 6) AS sd_support FROM lineitem WHERE l_returnflag <> 'R'",
)
def _(s, d):
    rows = _t(s, d, "lineitem").select(F.col("l_discount").alias("groundedness"), F.col("l_quantity").alias("support"), (F.col("l_returnflag") == "R").alias("declined"))
    return reports.fitted_constants(rows).select(_r("mean_g", 9), _r("sd_g", 9), _r("mean_support"), _r("sd_support"))


@query(
    "coverage_accuracy",
    """WITH x AS (SELECT round(o_totalprice, 2) AS v, o_orderstatus = 'F' AS ok, o_orderpriority LIKE '1%' AS inside FROM orders),
y AS (SELECT 'all' AS scope, * FROM x UNION ALL SELECT 'inside', * FROM x WHERE inside),
r AS (SELECT *, rank() OVER (PARTITION BY scope ORDER BY v) + (count(*) OVER (PARTITION BY scope, v) - 1) / 2 AS rk FROM y)
SELECT scope, count(*) AS n, round(avg(CASE WHEN ok THEN 1 ELSE 0 END), 6) AS accuracy, round(avg(v) FILTER (WHERE ok), 4) AS coverage_right, round(avg(v) FILTER (WHERE NOT ok), 4) AS coverage_wrong,
  round((sum(rk) FILTER (WHERE ok) - count(*) FILTER (WHERE ok) * (count(*) FILTER (WHERE ok) + 1) / 2) / (count(*) FILTER (WHERE ok) * count(*) FILTER (WHERE NOT ok)), 6) AS auc FROM r GROUP BY scope""",
)
def _(s, d):
    rows = _t(s, d, "orders").select(F.round("o_totalprice", 2).alias("coverage"), (F.col("o_orderstatus") == "F").alias("right"), F.col("o_orderpriority").startswith("1").alias("inside"))
    return reports.coverage_accuracy(rows).select("scope", "n", _r("accuracy"), _r("coverage_right", 4), _r("coverage_wrong", 4), _r("auc"))


@query(
    "latency_summary",
    "WITH x AS (SELECT event_id - (SELECT min(event_id) FROM events) AS run, value FROM events), y AS (SELECT value, row_number() OVER (ORDER BY value) AS r, count(*) OVER () AS n FROM x WHERE run >= 2) "
    "SELECT count(*) AS n, round(avg(value), 6) AS mean, max(value) FILTER (WHERE r = greatest(1, CAST(floor(n * 0.95) AS BIGINT))) AS p95, min(value) AS least, max(value) AS most FROM y",
)
def _(s, d):
    e = _t(s, d, "events")
    runs = e.join(F.broadcast(e.agg(F.min("event_id").alias("first")))).select((F.col("event_id") - F.col("first")).alias("run"), F.col("value").alias("seconds"))
    return reports.latency_summary(runs).select("n", _r("mean"), "p95", "least", "most")


@query(
    "segment_texts",
    """SELECT p_partkey, p_name || ' ' || p_type || ' ' || p_brand AS term_source, 'hot ' || p_brand || ' see ' || p_size || ' ' || p_type || ' ' || p_name || ' ' || p_brand AS graph_text,
  'hot ' || p_brand || ' ' || p_name || ' ' || p_type || ' ' || p_brand AS structure, [t FOR t IN regexp_split_to_array(lower(p_name), '[^a-z0-9]+') IF t <> ''][1] AS first_token FROM part""",
)
def _(s, d):
    c = F.col
    hot, see = F.array(F.concat(F.lit("hot "), c("p_brand"))), F.array(F.concat(F.lit("see "), c("p_size")))
    return _t(s, d, "part").select(
        "p_partkey", reports.term_source(c("p_name"), c("p_type"), c("p_brand")).alias("term_source"),
        reports.graph_text(hot, see, c("p_type"), c("p_name"), c("p_brand")).alias("graph_text"),
        reports.segment_structure(hot, c("p_name"), c("p_type"), c("p_brand")).alias("structure"), F.get(T.alnum_tokens(c("p_name")), F.lit(0)).alias("first_token"),
    )


@query("half_even", "SELECT l_linenumber, round_even(CAST(sum(l_quantity) AS DECIMAL(18, 3)) / 8, 0)::DOUBLE AS eighths FROM lineitem GROUP BY l_linenumber")
def _(s, d):
    total = F.sum("l_quantity").cast("decimal(18,3)") / 8
    return _t(s, d, "lineitem").groupBy("l_linenumber").agg(T.half_even(total).cast("double").alias("eighths"))


@query(
    "topk_with_zeros",
    f"WITH {_BM25}, {_QL}, {_scores('sc', 'ql')}, z AS (SELECT item_id AS query_id, ord FROM benchmark, seg), r AS (SELECT query_id, ord, round(coalesce(score, 0.0), 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(score, 0.0), 9) DESC, ord) AS rank "
    "FROM z LEFT JOIN sc USING (query_id, ord)) SELECT query_id, ord, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r WHERE rank <= 8",
)
def _(s, d):
    return index.best(*_literal(s, d), 8, positive=False).select("query_id", "ord", "rank", _r("score"))
